"""Benchmark decontamination: rare n-gram seeds join texts to test items, Smith-Waterman alignment scores the copies.

Test items are cut into n-grams of SEED words. A first pass over all texts counts in how many documents each occurs; of
every SPAN neighbouring n-grams of an item the RARE rarest become its seeds, so each stretch of each item keeps seeds,
also where the whole item has been copied into many documents. A second pass finds the seeds in the texts, takes the
passage around each diagonal (document position minus item position) and aligns it with the item: +2 for equal words,
-1 for others, -1 for a gap. Items over PIECE words are aligned in pieces of PIECE words that overlap by half. The passages
of an item that a text holds are added up where they come from different words of the item; the score is that sum over what
an unedited copy would get. An item that is copied in scattered runs is scored by its words in them, whatever lies between:
every seed's diagonal is searched for runs of PART equal words or more. A leak has LEAK of an unedited copy's score, of
items over PIECE words LEAK of a piece's.

Items of fewer than MIN_WORDS words (any item in a script without spaces) are looked up whole: within a text from
SHORT_BYTES bytes on, where the words are ASCII only at word boundaries; shorter ones only as the whole text.

Items are read and broadcast in blocks of at most ITEM_CHARS characters; a larger benchmark means more passes, never a
larger broadcast. Hits stay with their text: no shuffle but of the n-gram counts.

Defined cases: words are runs of letters, digits and non-ASCII bytes, in lower case; null and empty texts and items match
nothing; a passage of fewer than PART words is too short to tell from chance and isn't added to others; repeated rows
of either table give a row each (rows with equal ids: the best of them); other columns of the inputs don't matter; an
empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, staged, text_blocks

SEED, SPAN, RARE, MIN_WORDS, ITEM_CHARS = 3, 4, 2, 5, 8_000_000
#: Share of an unedited copy's score from which a passage counts as a leak.
LEAK = 0.45
#: Words of a piece of a long item; words from which a passage is added to others; bytes of the shortest item looked up within texts.
PIECE, PART, SHORT_BYTES = 60, 8, 20
#: Characters by which items in scripts without spaces are looked up; SHORT_BYTES has as many at least.
_HEAD = 5
#: Words around a seed's diagonal that alignment may wander.
SLACK = 12
_WORD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_WORD).split()


class Seeds:
    """The n-grams of a block of items, by code; the codes of a text's n-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.sizes, texts = [], [], []
        self.owner, self.offset = [], []  # of each aligned entry, an item or a piece of one: the item and the entry's first word
        self.whole: dict[str, list[int]] = {}
        self.short: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
        self.heads: dict[str, list[tuple[str, int]]] = {}
        for i, text in items:
            words = words_of(text or "")
            if not words:
                continue
            k = len(self.ids)
            self.ids.append(i)
            self.sizes.append(len(words))
            if len(words) >= MIN_WORDS:
                starts = [*range(0, len(words) - PIECE, PIECE // 2), len(words) - PIECE] if len(words) > PIECE else [0]
                self.owner += [k] * len(starts)
                self.offset += starts
                texts += [words[a : a + PIECE] for a in starts]
                continue
            joined = b" ".join(words)
            if len(joined) < SHORT_BYTES:
                self.whole.setdefault(joined.decode(), []).append(k)
            elif joined.isascii():
                self.short.setdefault(len(words), {}).setdefault(tuple(words), []).append(k)
            else:
                self.heads.setdefault(joined.decode()[:_HEAD], []).append((joined.decode(), k))
        self.vocabulary: dict[bytes, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in t], np.int64) for t in texts]
        self.base = len(self.vocabulary) + 1
        codes = [self.codes(w) for w in self.words]
        self.item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        self.place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.empty(0, np.int64)
        self.of = np.concatenate(codes) if codes else np.empty(0, np.int64)
        self.all = np.unique(self.of)

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Code of the n-gram at each position, -1 where a word is in no item."""
        n = len(words) - SEED + 1
        if n <= 0:
            return np.empty(0, np.int64)
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(SEED):
            part = words[i : i + n]
            code, known = code * self.base + part, known & (part >= 0)
        # beyond two million words in a block codes wrap around and may meet; alignment tells such seeds apart
        return np.where(known, code & (2**63 - 1), -1)

    def looked_up(self, text: str) -> list[tuple[int, int]]:
        """Items too short for seeds that the text holds whole, and the word after each."""
        if not (self.whole or self.short or self.heads):
            return []
        words = words_of(text)
        joined = b" ".join(words).decode()
        found = dict.fromkeys(self.whole.get(joined, ()), len(words))
        for n, among in self.short.items():
            for i in range(len(words) - n + 1):
                for k in among.get(tuple(words[i : i + n]), ()):
                    found.setdefault(k, i + n)
        if self.heads and not joined.isascii():
            for i in range(len(joined) - _HEAD + 1):
                for whole, k in self.heads.get(joined[i : i + _HEAD], ()):
                    if k not in found and joined.startswith(whole, i):
                        found[k] = joined.count(" ", 0, i + len(whole)) + 1
        return list(found.items())

    def numbers(self, text: str) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def found(self, words: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of a text's n-grams that are among the (sorted) codes, and their index there."""
        code = self.codes(words)
        at = np.flatnonzero(code >= 0)
        if not len(at) or not len(among):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        where = np.minimum(np.searchsorted(among, code[at]), len(among) - 1)
        hit = among[where] == code[at]
        return at[hit], where[hit]

    def choose(self, frequency: np.ndarray) -> None:
        """Keeps, of every SPAN neighbouring n-grams of an item, the RARE in the fewest documents."""
        keep = np.zeros(len(self.of), bool)
        often = frequency[np.searchsorted(self.all, self.of)] if len(self.of) else np.empty(0)
        for i in range(len(self.words)):
            own = np.flatnonzero(self.item == i) if len(self.words) < 64 else np.arange(*np.searchsorted(self.item, [i, i + 1]))
            for start in range(0, max(1, len(own) - SPAN + 1)):
                part = own[start : start + SPAN]
                keep[part[np.argsort(often[part], kind="stable")[:RARE]]] = True
        order = np.argsort(self.of[keep], kind="stable")
        self.item, self.place, self.of = self.item[keep][order], self.place[keep][order], self.of[keep][order]
        self.chosen, self.first = np.unique(self.of, return_index=True)
        self.last = np.append(self.first[1:], len(self.of)) if len(self.first) else self.first

    def diagonals(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and diagonals (text position minus item position) of the seeds in a text, sorted, each pair once."""
        at, which = self.found(words, self.chosen)
        n = self.last[which] - self.first[which] if len(which) else np.empty(0, np.int64)
        if not n.sum():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        rows = np.repeat(self.first[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, diagonal = np.unique(np.stack([self.item[rows], np.repeat(at, n) - self.place[rows]]), axis=1)
        return item, diagonal

    def runs(self, words: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> dict[int, tuple[np.ndarray, int]]:
        """By item: which of its words the text holds in runs of PART or more on these diagonals, and the word after the last."""
        wide = max((len(self.words[i]) for i in np.unique(item)), default=0)
        around = np.concatenate([np.full(wide, -1), words, np.full(wide, -1)])
        out: dict[int, tuple[np.ndarray, int]] = {}
        for start in range(0, len(item), 4096):
            i, d = item[start : start + 4096], diagonal[start : start + 4096]
            left = np.full((len(i), wide), -2, np.int64)
            for k in np.unique(i):
                left[i == k, : len(self.words[k])] = self.words[k]
            same = around[np.clip(d[:, None] + wide + np.arange(wide), 0, len(around) - 1)] == left
            long = np.zeros(same.shape, np.int16)
            for c in range(wide):
                long[:, c] = (long[:, c - 1] + 1 if c else 1) * same[:, c]
            held = long >= PART
            for c in range(wide - 2, -1, -1):
                held[:, c] |= held[:, c + 1] & same[:, c]
            for row in np.flatnonzero(held.any(1)):
                places, k = np.flatnonzero(held[row]), self.owner[i[row]]
                mark, end = out.get(k) or (np.zeros(self.sizes[k], bool), 0)
                mark[self.offset[i[row]] + places] = True
                out[k] = mark, max(end, int(d[row] + places[-1] + 1))
        return out

    def windows(self, item: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and the first word of the passage to align each with; neighbouring diagonals share a passage."""
        items, starts, i = [], [], 0
        while i < len(item):
            items.append(item[i])
            starts.append(diagonal[i])
            j = i + 1
            while j < len(item) and item[j] == item[i] and diagonal[j] - diagonal[i] <= SLACK:
                j += 1
            i = j
        return np.array(items, np.int64), np.array(starts, np.int64) - SLACK


def align(items: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment score of each row's item (padded with -2) with its passage (padded with -1), its end in both."""
    n, wide = passages.shape
    column = np.arange(wide)
    above = np.zeros((n, wide + 1), np.int32)
    best, end, last = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(items.shape[1]):
        match = np.where(passages == items[:, i : i + 1], 2, -1).astype(np.int32)
        row = np.maximum(np.maximum(above[:, :-1] + match, above[:, 1:] - 1), 0)
        row = np.maximum.accumulate(row + column, axis=1) - column  # gaps along the passage
        above[:, 1:] = row
        top = row.argmax(1)
        value = row[np.arange(n), top]
        better = value > best
        best[better], end[better], last[better] = value[better], top[better], i
    return best, end, last


def _added_up(passages: list[tuple[int, int, int]]) -> float:
    """Scores of (score, first, after) passages of an item, the higher first; the others count by their new words."""
    total, held = 0.0, np.zeros(max(p[2] for p in passages), bool)
    for score, first, after in sorted(passages, reverse=True):
        total += score * (1 - held[first:after].mean())
        held[first:after] = True
    return total


def _scan(seeds: Seeds, texts: list[str], leak: float) -> list[tuple[int, int, float, int]]:
    """(text, item, score, word at which the aligned passage ends) of the leaks in a list of texts."""
    rows: list[tuple[int, int, int]] = []
    held: dict[int, np.ndarray] = {}
    scattered: dict[tuple[int, int], tuple[np.ndarray, int]] = {}
    for t, text in enumerate(texts):
        words = seeds.numbers(text)
        seen = seeds.diagonals(words)
        items, starts = seeds.windows(*seen)
        if len(items):
            held[t] = words
            scattered.update({(t, k): found for k, found in seeds.runs(words, *seen).items()})
            rows += [(t, int(i), int(s)) for i, s in zip(items, starts, strict=True)]
    parts: dict[tuple[int, int], list[tuple[int, int, int, int, int, int]]] = {}
    rows.sort(key=lambda r: len(seeds.words[r[1]]))
    for start in range(0, len(rows), 512):
        part = rows[start : start + 512]
        long = max(len(seeds.words[i]) for _, i, _ in part)
        left = np.full((len(part), long), -2, np.int64)
        right = np.full((len(part), long + 2 * SLACK + SLACK), -1, np.int64)
        for k, (t, i, s) in enumerate(part):
            item, words = seeds.words[i], held[t]
            left[k, : len(item)] = item
            piece = words[max(s, 0) : max(s, 0) + len(item) + 3 * SLACK]
            right[k, : len(piece)] = piece
        scores, ends, lasts = align(left, right)
        for (t, i, s), score, end, last in zip(part, scores.tolist(), ends.tolist(), lasts.tolist(), strict=True):
            if score >= 2 * PART or score >= leak * 2 * len(seeds.words[i]):
                parts.setdefault((t, seeds.owner[i]), []).append((score, max(s, 0) + end + 1, i, max(s, 0), end + 1, last + 1))
    out = []
    for t, k in dict.fromkeys([*parts, *scattered]):
        size, least, passages = 2 * seeds.sizes[k], leak * 2 * min(seeds.sizes[k], PIECE), parts.get((t, k), [])
        mark, after = scattered.get((t, k), (np.zeros(0, bool), 0))
        total, end = max(passages)[:2] if passages else (0, after)
        if len(passages) > 1 and (total < least or size > 2 * PIECE):
            ranges = []
            for score, _, i, s, wide, last in passages:  # backwards from its end, the alignment ends where it began
                piece = held[t][s : s + wide][::-1]
                back = align(seeds.words[i][:last][::-1][None], piece[None])[2][0]
                ranges.append((score, seeds.offset[i] + last - 1 - int(back), seeds.offset[i] + last))
            total = max(total, min(_added_up(ranges), size))
        total = max(total, 2 * int(mark.sum()))
        if total >= least:
            out.append((t, k, total / size, end))
    return out + [(t, k, 1.0, end) for t, text in enumerate(texts) for k, end in seeds.looked_up(text)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, leak: float = LEAK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, score (share of an unedited copy's, 0 to 1) and end_word (of the best passage) for each text and item it leaks."""
    spark = docs.sparkSession
    rows = pick(docs, id_col, text_col)
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col("text"), F.monotonically_increasing_id().alias("place"))
    items = staged(items, "items")  # places stay, so that equal items are dealt to blocks like all others
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, ceil(chars / ITEM_CHARS))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}, score double, end_word int"
    out = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("place"), F.lit(blocks)) == b).collect()
        seeds = Seeds([(r["item_id"], r["text"]) for r in block])
        first = spark.sparkContext.broadcast(seeds)

        def count(batches: Iterator[pa.RecordBatch], first=first) -> Iterator[pa.RecordBatch]:
            s = first.value
            total = np.zeros(len(s.all), np.int64)
            for part in text_blocks(batches):
                for text in part.column("text").to_pylist():
                    total[np.unique(s.found(s.numbers(text), s.all)[1])] += 1
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["seed", "n"])

        frequency = np.zeros(len(seeds.all), np.int64)
        if len(seeds.all):  # one row an n-gram of the block at most
            counted = rows.select("text").mapInArrow(count, "seed int, n long").groupBy("seed").agg(F.sum("n").alias("n")).toPandas()
            frequency[counted["seed"].to_numpy(int)] = counted["n"].to_numpy(int)
        seeds.choose(frequency)
        chosen = spark.sparkContext.broadcast(seeds)

        def scan(batches: Iterator[pa.RecordBatch], chosen=chosen) -> Iterator[pa.RecordBatch]:
            s = chosen.value
            for part in text_blocks(batches):
                found = _scan(s, part.column("text").to_pylist(), leak)
                t, i, share, end = zip(*found, strict=True) if found else ((),) * 4
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(t, pa.int64())), pa.array([s.ids[k] for k in i], benchmark_kind), pa.array(share, pa.float64()), pa.array(end, pa.int32())],
                    ["doc_id", "item_id", "score", "end_word"],
                )

        benchmark_kind = pa.int32() if dict(items.dtypes)["item_id"] == "int" else pa.int64() if dict(items.dtypes)["item_id"] == "bigint" else pa.string()
        part = rows.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return out
