"""Byte-level BPE encoding and decoding by merge replay over a shard of the corpus.

Each task takes the distinct pretokens of its texts as one small corpus. An inverted index from the rank of a token pair
to the positions of that pair is replayed in rank order: every merge is applied to all words of the shard at once and
only the pairs on either side of it are looked up again. A word is encoded once, however often it occurs, and no words
or tokens cross the network. A pretoken that is itself in the vocabulary keeps its rank. Where a merge makes a pair of
lower rank than itself, the words concerned are encoded again one merge at a time, which is the defining order.

Defined cases: null and empty texts have no ids and decode to nothing; repeated rows are encoded alike; other columns of
the input don't matter; a null in the packed ids decodes to nothing; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame

from .common import pick, text_blocks

NONE = np.int32(2**31 - 1)
#: Text bytes encoded together, and distinct pretokens remembered between such blocks.
SHARD_BYTES, REMEMBERED = 8 << 20, 200_000


class Vocabulary:
    """Ranks, token bytes and the rank of each pair of tokens whose bytes together are a token."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        keys, merged = [], []
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def one_by_one(self, word: bytes) -> list[int]:
        """Lowest rank first, leftmost first, one merge at a time, from a heap of pairs; a merge looks up its neighbours only."""
        parts: list[bytes] = [word[i : i + 1] for i in range(len(word))]
        after, before, pair = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1)), [NONE] * len(word)
        heap: list[tuple[int, int]] = []

        def note(i: int) -> None:
            pair[i] = self.ranks.get(parts[i] + parts[after[i]], NONE) if after[i] < len(parts) else NONE
            if pair[i] != NONE:
                heapq.heappush(heap, (pair[i], i))

        for i in range(len(word)):
            note(i)
        while heap:
            rank, i = heapq.heappop(heap)
            if pair[i] != rank:
                continue
            gone = after[i]
            parts[i], parts[gone], pair[gone] = parts[i] + parts[gone], b"", NONE
            after[i] = after[gone]
            if after[i] < len(parts):
                before[after[i]] = i
            note(i)
            if before[i] >= 0:
                note(before[i])
        return [self.ranks[x] for x in parts if x]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words back to back, and how many each has; no word is empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        token = self.single[np.frombuffer(b"".join(words), np.uint8)]
        n = len(token)
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        after[starts[1:] - 1] = -1
        before[starts[:-1]] = -1
        pair = np.full(n, NONE, np.int32)
        at = np.flatnonzero(after >= 0)
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []
        odd: list[np.ndarray] = []

        def note(at: np.ndarray, least: int) -> None:
            """Looks up the pairs that begin at these positions and files them under their rank."""
            found = self.pair_ranks(token[at], token[after[at]])
            pair[at] = found
            some = found != NONE
            if not some.any():
                return
            at, found = at[some], found[some]
            if (found < least).any():
                odd.append(at[found < least])
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            for rank, part in zip(found[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
                if rank not in index:
                    heapq.heappush(heap, rank)
                index[rank].append(part)

        if len(at):
            note(at, -1)
        while heap:
            rank = heapq.heappop(heap)
            parts = index.pop(rank)
            at = np.concatenate(parts) if len(parts) > 1 else parts[0]
            at = at[pair[at] == rank]
            if not len(at):
                continue
            at = np.unique(at)
            if len(at) > 1:  # of overlapping pairs the leftmost wins, then the next that is left
                chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
                if chained.any():
                    place = np.arange(len(at))
                    head = np.maximum.accumulate(np.where(chained, 0, place))
                    at = at[(place - head) % 2 == 0]
            gone = after[at]
            follow = after[gone]
            token[at], token[gone], pair[gone] = rank, -1, NONE
            after[at] = follow
            pair[at] = NONE
            before[follow[follow >= 0]] = at[follow >= 0]
            left = before[at]
            at = np.concatenate([at[follow >= 0], left[left >= 0]])
            if len(at):
                note(np.unique(at), rank)
        kept = token >= 0
        counts = np.add.reduceat(kept, starts[:-1], dtype=np.int64) if len(words) else np.empty(0, np.int64)
        tokens = token[kept]
        if odd:
            wrong = set(np.unique(np.searchsorted(starts, np.concatenate(odd), "right") - 1).tolist())
            parts = np.split(tokens, np.cumsum(counts)[:-1])
            for i in wrong:
                parts[i] = np.array(self.one_by_one(words[i]), np.int32)
            counts, tokens = np.fromiter(map(len, parts), np.int64, len(parts)), np.concatenate(parts)
        return tokens, counts


@lru_cache(maxsize=2)
def vocabulary(lines: bytes) -> Vocabulary:
    return Vocabulary(lines)


class _Numbered(dict):
    """Numbers each new key in order of appearance."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class ShardEncoder:
    """Encodes texts, remembering the tokens of the pretokens it has met."""

    def __init__(self, lines: bytes, pattern: str):
        self.vocabulary, self.split = vocabulary(lines), regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.seen = _Numbered()
        self.tokens, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self) -> None:
        known = len(self.counts)
        words = [w.encode() for w in list(self.seen)[known:]]
        direct = np.array([self.vocabulary.ranks.get(w, -1) for w in words], np.int32)
        rest = [w for w, r in zip(words, direct, strict=True) if r < 0]
        tokens, some = self.vocabulary.replay(rest) if rest else (np.empty(0, np.int32), np.empty(0, np.int64))
        counts = np.ones(len(words), np.int64)
        counts[direct < 0] = some
        starts = np.cumsum(counts) - counts
        joined = np.empty(int(counts.sum()), np.int32)
        joined[starts[direct >= 0]] = direct[direct >= 0]
        joined[np.repeat(direct < 0, counts)] = tokens
        self.starts = np.concatenate([self.starts, starts + len(self.tokens)])
        self.tokens, self.counts = np.concatenate([self.tokens, joined]), np.concatenate([self.counts, counts])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.seen) > REMEMBERED:
            self.forget()
        number = self.seen.__getitem__
        words = [np.fromiter(map(number, self.split(x)), np.int32) for x in texts]
        if len(self.seen) > len(self.counts):
            self._learn()
        out = []
        for x in words:
            n = self.counts[x]
            ends = np.cumsum(n)
            shift = np.repeat(self.starts[x] - (ends - n), n)
            out.append(self.tokens[shift + np.arange(len(shift))])
        return out


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _encode(lines: Broadcast, pattern: str) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ShardEncoder(lines.value, pattern)
        for block in text_blocks(batches, limit=SHARD_BYTES):
            ids = encoder.encode(block.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])

    return run


def _decode(lines: Broadcast) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(lines.value).bytes
        for block in text_blocks(batches, "ids"):
            out = [b"".join(map(table.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in block.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*block.select(["doc_id", "n_tokens", "ids"]).columns, pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def _lines(rows: DataFrame, ranks_path: str) -> Broadcast:
    """The rank file (under 1 MB for 50,000 tokens), read on the driver and broadcast; its size doesn't follow the data."""
    with open(ranks_path, "rb") as f:
        return rows.sparkSession.sparkContext.broadcast(f.read())


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids: the token ids packed as little-endian unsigned 32-bit integers."""
    rows = pick(docs, id_col, text_col)
    return rows.mapInArrow(_encode(_lines(docs, ranks_path), pattern), f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids binary")


def bpe_decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The columns of bpe_encode and decoded: the bytes that the ids stand for."""
    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decode(_lines(encoded, ranks_path)), f"doc_id {kind}, n_tokens long, ids binary, decoded binary")


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bpe_decode of bpe_encode with one Python worker a task, not one for each: workers stay, and each has a vocabulary."""
    rows, lines = pick(docs, id_col, text_col), _lines(docs, ranks_path)
    encode, decode = _encode(lines, pattern), _decode(lines)
    return rows.mapInArrow(lambda batches: decode(encode(batches)), f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids binary, decoded binary")
