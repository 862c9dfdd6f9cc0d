"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole, one marked turn after another, and encoded once with character offsets. The spans of
its turns and of its tokens are both sorted, so binary search finds the tokens of each assistant turn. Control strings in
roles and texts are escaped reversibly: `<`, any number of `~`, `|` gets one `~` more, so the markers, which have none,
occur only where the template puts them.

Defined cases: a null role or text is empty; turns with equal numbers are ordered by role, then text, repeated rows all
stay; a null turn number comes first; a null conv_id is a conversation of its own; an empty text leaves an empty span; a
conversation without assistant turns has an all-false mask; other columns of the input don't matter; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, SAYS, DONE = "<|turn|>", "<|says|>", "<|done|>"
_CONTROL, _ESCAPED = re.compile(r"<(~*)\|"), re.compile(r"<~(~*)\|")
_RENDERED = re.compile(re.escape(TURN) + "(.*?)" + re.escape(SAYS) + "(.*?)" + re.escape(DONE), re.S)
#: Characters and number of conversations encoded together.
BLOCK_CHARS, BLOCK_ROWS = 1 << 18, 256


def escape(text: str) -> str:
    return _CONTROL.sub(r"<~\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation, and where each turn's escaped text lies in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + SAYS, escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, DONE]
        at += len(head) + len(body) + len(DONE)
    return "".join(parts), spans


def parse(rendered: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered conversation."""
    return [(unescape(a), unescape(b)) for a, b in _RENDERED.findall(rendered)]


@lru_cache(maxsize=2)
def tokenizer(definition: str):
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_str(definition)
    t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (TURN, SAYS, DONE)])
    t.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets cover every character
    t.no_padding()
    t.no_truncation()
    return t


def token_mask(starts: np.ndarray, spans: list[tuple[int, int]], wanted: list[bool]) -> np.ndarray:
    """True for the tokens that begin within a wanted span; no token crosses a span's ends, markers stand there."""
    mask = np.zeros(len(starts), bool)
    lo = np.searchsorted(starts, [a for a, _ in spans], "left")
    hi = np.searchsorted(starts, [b for _, b in spans], "left")
    for a, b, use in zip(lo, hi, wanted, strict=True):
        if use:
            mask[a:b] = True
    return mask


def masked_texts(rendered: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The escaped text under each run of masked tokens."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return [rendered[starts[a] : ends[b - 1]] for a, b in edges.reshape(-1, 2)]


def format_chats(turns: DataFrame, tokenizer_path: str, train_on: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, and for each token its id, start, end (packed uint32, code points) and loss_mask (packed bytes).

    Turns meet in one row because the rendered conversation is one value; a conversation is as large as its own text.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = turns.sparkSession.sparkContext.broadcast(f.read())
    empty = F.lit("")
    rows = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce(F.col("role"), empty).alias("role"), F.coalesce(F.col("text"), empty).alias("text")).alias("said"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))

    def encoded(ids: list, conversations: list[list[dict]]) -> pa.RecordBatch:
        drawn = [render([(t["role"], t["text"]) for t in c]) for c in conversations]
        columns: list[list[bytes]] = [[], [], [], []]
        for (_, spans), c, e in zip(drawn, conversations, tokenizer(definition.value).encode_batch([x for x, _ in drawn], add_special_tokens=False), strict=True):
            offsets = np.array(e.offsets, "<u4").reshape(-1, 2)
            mask = token_mask(offsets[:, 0], spans, [t["role"] in train_on for t in c])
            for column, value in zip(columns, (np.array(e.ids, "<u4"), offsets[:, 0], offsets[:, 1], mask.astype(np.uint8)), strict=True):
                column.append(value.tobytes())
        return pa.RecordBatch.from_arrays([ids, pa.array([x for x, _ in drawn], pa.string()), *(pa.array(c, pa.binary()) for c in columns)], ["conv_id", "formatted", "ids", "starts", "ends", "loss_mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                conversations = part.column("turns").to_pylist()
                sizes = np.cumsum([sum(len(t["text"]) for t in c) for c in conversations])
                cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(sizes // BLOCK_CHARS)) + 1, [len(conversations)]]))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    yield encoded(part.column("conv_id").slice(a, b - a), conversations[a:b])

    return whole.mapInArrow(run, f"conv_id {dict(turns.dtypes)['conv_id']}, formatted string, ids binary, starts binary, ends binary, loss_mask binary")


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What a reader finds in the output of format_chats: turns by parsing, loss text by mask and offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("formatted", "starts", "ends", "loss_mask")), strict=True):
                rendered, (starts, ends), mask = row[0], (np.frombuffer(x, "<u4") for x in row[1:3]), np.frombuffer(row[3], np.uint8) > 0
                turns = parse(rendered)
                said = hashlib.sha256()
                for role, text in turns:
                    said.update(f"{role}\n{text}\n".encode())
                loss = "".join(map(unescape, masked_texts(rendered, starts, ends, mask)))
                out.append((len(turns), said.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(rendered)))
            n, turns_hash, chars, loss_hash, size = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(turns_hash, pa.string()), pa.array(chars, pa.int64()), pa.array(loss_hash, pa.string()), pa.array(size, pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = dict(formatted.dtypes)["conv_id"]
    return formatted.select("conv_id", "formatted", "starts", "ends", "loss_mask").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
