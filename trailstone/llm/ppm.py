"""Language-model scores by prediction by partial matching, beside a smoothed unigram base.

Model: a byte-context trie of ORDER bytes and less, pretrained on the training rows' lower-cased texts and kept whole, as
tables: entries (context and symbol with its count) and nodes (contexts with their whole count and their kinds of symbols)
of each order. A symbol is coded in the longest context the trie has: with count c of n and d kinds its probability is
(2c-1)/2n, the escape's is d/2n; after an escape the next shorter context codes it among the symbols not yet excluded, and
below order 0 all bytes left are equally likely. A text is its bytes and one end symbol, so that probabilities of all texts
sum to 1.

The symbol's probability depends on its gram (ORDER bytes and itself) only, so it is found once for each distinct gram of
the corpus, and documents add up their grams' logarithms. One table holds the trie of all orders; grams that weren't learned
look up what all their contexts and shorter grams have there in one join. Grams that make up 1/SHARE of the corpus or more
(so at most SHARE of them, however large the corpus) are looked up from a broadcast, all others in a join. The base does
the same with words: counts of words of at most WORD_BYTES above 1/WORD_SHARE of all tokens are broadcast, all other
words of each text meet their counts in a join on the word itself.

Defined cases: null text is empty: one end token; with no training rows all counts are 0 and all bytes equally likely;
repeated rows are scored apart and count as often as they occur; rows for which `learn` is null don't teach; other columns
of the input don't matter; an empty table gives no rows.

Memory: an executor's Python workers, each with up to 2 * HELD / 3 sums, stand beside a heap that Spark may fill. So texts come
in Arrow batches of BATCH_BYTES where the session has no limit of its own, and BLOCK_BYTES of them are worked on at once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, pick, staged, sums_between, text_blocks, text_bytes

#: SHARE bounds the broadcast grams (16 bytes each), WORD_SHARE and WORD_BYTES the broadcast words.
ORDER, SHARE, WORD_SHARE, WORD_BYTES = 5, 1 << 22, 1 << 19, 64
#: Bytes that UTF-8 never has: they stand before a text and behind it.
START, END = 254, 255
#: Distinct keys that a task adds up before it hands them on are half of HELD; bytes of distinct words.
HELD, HELD_BYTES = 1 << 21, 16 << 20
#: Text bytes in an Arrow batch, and those that a step holds at once (dozens of bytes each); keys in a batch handed on.
BATCH_LIMIT, BATCH_BYTES, BLOCK_BYTES, BATCH_KEYS = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20, 1 << 18, 1 << 17


def _staged(df: DataFrame, name: str) -> DataFrame:
    """The rows staged, Arrow batches on the way to Python being of BATCH_BYTES unless the session says otherwise."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_LIMIT, None) is not None:
        return staged(df, name)
    conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    try:
        return staged(df, name)
    finally:
        conf.unset(BATCH_LIMIT)


def coded_symbols(data: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of the last order+1 bytes at each symbol of each text (its bytes and END), and len+1 offsets."""
    n, sizes = len(at) - 1, np.diff(at)
    stream = np.full(len(data) + n * (order + 1), START, np.uint8)
    owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
    stream[np.arange(len(data)) + owner * (order + 1) + order] = LOWER[data]
    ends = np.cumsum(sizes + order + 1) - 1
    stream[ends] = END
    key = np.zeros(len(stream), np.uint64)
    for k in range(order, -1, -1):
        key[k:] |= stream[: len(stream) - k].astype(np.uint64) << np.uint64(8 * k)
    symbol = np.ones(len(stream), bool)
    begins = ends - sizes - order
    for k in range(order):
        symbol[begins + k] = False
    return key[symbol], at + np.arange(n + 1)


class _Table:
    """Open addressing: places of many 64-bit keys at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.place = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.place[at] < 0
            self.place[at[free]] = left[free]  # of several, the last stays
            lost = self.place[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.place) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key among those the table was made from, or -1."""
        at = self._slot(keys)
        found = self.place[at]
        if not len(self.keys):
            return found
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        at = at[open_]
        while len(open_):
            at = (at + 1) & (len(self.place) - 1)
            found[open_] = now = self.place[at]
            more = (now >= 0) & (self.keys[now] != keys[open_])
            open_, at = open_[more], at[more]
        return found


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts in order, and their counts added up. Empties the list: no more is held than it takes."""
    counts = [c for _, c in parts]
    keys = np.concatenate([k for k, _ in parts])
    parts.clear()
    order = np.argsort(keys, kind="stable")  # the parts are in order already
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, int)
    keys = keys[first]
    counts = np.concatenate(counts)
    counts = counts[order]
    return keys, np.add.reduceat(counts, first) if len(first) else counts


class _Sums:
    """Adds up counts by key in one task, handing on what exceeds HELD / 2 distinct keys."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []  # the first may hold sums, the others wait
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > HELD // 6:
            self.parts, self.waiting = [_merge(self.parts)], 0
            if len(self.parts[0][0]) > HELD // 2:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            keys, counts = _merge(self.parts) if self.waiting else self.parts[0]
            self.parts, self.waiting = [], 0
            for i in range(0, len(keys), BATCH_KEYS):
                some = slice(i, i + BATCH_KEYS)
                yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(counts[some].astype(np.int64))], ["key", "n"])


def _count_grams(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    sums, flag = _Sums(), 1 << 8 * (order + 1)
    for block in text_blocks(batches, limit=BLOCK_BYTES):
        keys, ends = coded_symbols(*text_bytes(block.column("text")), order)
        learned = block.column("learn").to_numpy(zero_copy_only=False).astype(np.uint64)
        keys |= np.repeat(learned * np.uint64(flag), np.diff(ends))
        yield from sums.add(*np.unique(keys, return_counts=True))
    yield from sums.flush()


def gram_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """key, n and m of each gram in the rows' texts: how often it occurs where `learn` holds, and at all."""
    flag = 1 << 8 * (order + 1)

    tagged = rows.select("text", "learn").mapInArrow(lambda batches: _count_grams(batches, order), "key long, n long")
    learned = F.when(F.col("key") >= flag, F.col("n")).otherwise(0)
    return tagged.groupBy(F.col("key").bitwiseAND(flag - 1).alias("key")).agg(F.sum(learned).alias("n"), F.sum("n").alias("m"))


def trie(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """The trie of all orders learned from the grams' n, one row an entry and one a node, by `at`.

    An entry's place is its order above its order+1 bytes, n its count. A node's place has START where an entry has its
    symbol; n is its whole count, kinds how many symbols it has, taken what the next shorter context has of these symbols.
    """
    shift = 8 * (order + 1)
    learned = grams.where("n > 0")
    shorter = [F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1) + (k << shift) for k in range(order)]
    entries = learned.select((F.col("key") + (order << shift)).alias("at"), "n")
    if order:
        entries = entries.unionByName(learned.select(F.explode(F.array(*shorter)).alias("at"), "n").groupBy("at").agg(F.sum("n").alias("n")))
    entries = staged(entries, "entries")
    k = F.shiftright("at", shift)
    # the same symbol after one byte less: at most 256 entries have it
    suffix = F.expr(f"(at & (shiftleft(1L, cast(8 * shiftright(at, {shift}) as int)) - 1)) + shiftleft(shiftright(at, {shift}) - 1, {shift})")
    counts = entries.select(F.col("at").alias("suffix"), F.col("n").alias("taken"))
    longer = entries.withColumn("suffix", F.when(k > 0, suffix)).join(counts, "suffix", "left")
    nodes = longer.groupBy(F.col("at").bitwiseAND(-256).bitwiseOR(START).alias("at")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.sum("taken").alias("taken"))
    return entries.select("at", "n", F.lit(None).cast("long").alias("kinds"), F.lit(None).cast("long").alias("taken")).unionByName(nodes)


def gram_logs(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """key, m and log (log10 of the symbol's probability after its context) for each gram, the trie learned from n."""
    shift = 8 * (order + 1)
    context = Window.partitionBy(F.shiftrightunsigned("key", 8))  # at most 256 rows
    known = grams.where("n > 0").withColumn("whole", F.sum("n").over(context))
    known = known.select("key", "m", (F.log10(2 * F.col("n") - 1) - F.log10(2 * F.col("whole"))).alias("log"))

    # all others ask for their nodes of each order and their entries of the shorter ones, all at once
    places, names = [], []
    for k in range(order + 1):
        own = F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1) + (k << shift)
        places += [own, own.bitwiseAND(-256).bitwiseOR(START)]
        names += [f"c{k}", f"w{k}"]
    asked = grams.where("n = 0").select("key", "m", F.posexplode(F.array(*places)).alias("i", "at"))
    met = asked.join(trie(grams, order), "at", "left").groupBy("key", "m").agg(
        *(F.max(F.when(F.col("i") == i, F.col("n"))).alias(name) for i, name in enumerate(names)),
        *(F.max(F.when(F.col("i") == 2 * k + 1, F.col(x))).alias(f"{x}{k}") for k in range(order + 1) for x in ("kinds", "taken")),
    )
    # below all orders every byte that order 0 doesn't have is equally likely
    log = -F.log10(F.greatest(256 - F.coalesce("kinds0", F.lit(0)), F.lit(1)))
    for k in range(order + 1):
        left, kinds = F.col(f"w{k}"), F.col(f"kinds{k}")
        if k < order:  # a longer context excludes its symbols
            left, kinds = (x - F.coalesce(F.col(f"{y}{k + 1}"), F.lit(0)) for x, y in ((left, "taken"), (kinds, "kinds")))
        escape = F.when(left > 0, F.log10(kinds) - F.log10(2 * left)).otherwise(0.0)  # no such context, or nothing left in it
        hit = F.log10(2 * F.col(f"c{k}") - 1) - F.log10(2 * left)
        log = F.when(F.col(f"c{k}").isNotNull(), hit).otherwise(escape + log)
    return known.unionByName(met.select("key", "m", log.alias("log")))


class _Numbered(dict):
    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def _block_words(block: pa.RecordBatch) -> tuple[list[bytes], list[np.ndarray]]:
    """Distinct words of a block, and for each text the numbers of its words."""
    number, out = _Numbered(), []
    for text in block.column("text").to_pylist():
        words = text.encode().lower().split()  # bytes: A-Z only, ASCII white space only
        out.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
    return list(number), out


def _strings(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word and n: how often each word occurs in the rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        size = 0
        for block in text_blocks(batches, limit=BLOCK_BYTES):
            words, ids = _block_words(block)
            before = len(held)
            held.update(dict(zip(words, np.bincount(np.concatenate(ids), minlength=len(words)).tolist(), strict=True)) if words else {})
            size += sum(map(len, words)) if len(held) > before else 0
            if size > HELD_BYTES:
                size = sum(map(len, held))
            if size > HELD_BYTES // 2 or len(held) > HELD // 8:
                yield pa.RecordBatch.from_arrays([_strings(list(held)), pa.array(held.values(), pa.int64())], ["word", "n"])
                held, size = Counter(), 0
        yield pa.RecordBatch.from_arrays([_strings(list(held)), pa.array(held.values(), pa.int64())], ["word", "n"])

    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _rests(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of each of n rows into its distinct keys, these keys, and how often each occurs."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])) if len(h) else np.empty(0, int)
    return np.searchsorted(owner[first], np.arange(n + 1)).astype(np.int32), h[first], np.diff(np.append(first, len(h))).astype(np.int32)


def lm_scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, share: int = SHARE, word_share: int = WORD_SHARE) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score for each row; `learn` selects training rows by doc_id.

    `share` and `word_share` (most grams and words in a broadcast) decide where work is done, not what comes out."""
    rows = pick(docs, id_col, text_col).withColumn("learn", F.coalesce(learn, F.lit(False)))
    grams = _staged(gram_counts(rows, order), "grams")
    logs = staged(gram_logs(grams, order), "logs")
    symbols = grams.agg(F.sum("m")).first()[0] or 0

    words = _staged(count_words(rows.where("learn")), "words")
    ends = rows.where("learn").count()
    stats = words.agg(F.sum("n"), F.count("*")).first()
    n_all, kinds = (stats[0] or 0) + ends, stats[1] + (ends > 0)
    scale = math.log10(n_all + 0.5 * (kinds + 1))

    often, rare = (logs.where(f"m * {share} {test} {symbols}") for test in (">=", "<"))
    top = often.select("key", "log").toArrow()
    common = words.where((F.col("n") * word_share >= n_all) & (F.octet_length("word") <= WORD_BYTES)).toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((top["key"].to_numpy().view(np.uint64), top["log"].to_numpy(), common["word"].to_pylist(), common["n"].to_numpy()))
    kind = dict(rows.dtypes)["doc_id"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_keys, gram_values, word_keys, word_counts = shared.value
        gram_table, number = _Table(gram_keys), {w.encode(): i for i, w in enumerate(word_keys)}
        gram_values, word_logs = np.append(gram_values, 0.0), np.append(np.log10(word_counts + 0.5), 0.0)  # -1: found elsewhere
        end_log = math.log10(ends + 0.5)
        for block in text_blocks(batches, limit=BLOCK_BYTES):
            n = block.num_rows
            names, ids = _block_words(block)
            size = np.fromiter(map(len, ids), np.int64, n)
            x, owner = np.concatenate(ids), np.repeat(np.arange(n), size)
            at, place = np.append(0, np.cumsum(size)), np.fromiter((number.get(w, -1) for w in names), np.int64, len(names))
            part, known = sums_between(word_logs[place][x], at) + end_log, sums_between((place >= 0)[x], at, np.int64) + (ends > 0)
            away = place[x] < 0
            word_cuts, rest, word_times = _rests(x[away], owner[away], n)
            word_rest = _strings([names[i] for i in rest.tolist()])

            keys, cuts = coded_symbols(*text_bytes(block.column("text")), order)
            place = gram_table.find(keys)
            total, away = sums_between(gram_values[place], cuts), np.flatnonzero(place < 0)
            gram_cuts, gram_rest, gram_times = _rests(keys[away], np.searchsorted(cuts, away, "right") - 1, n)
            lists = [pa.ListArray.from_arrays(c, v) for c, v in ((word_cuts, word_rest), (word_cuts, pa.array(word_times)), (gram_cuts, pa.array(gram_rest.view(np.int64))), (gram_cuts, pa.array(gram_times)))]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(size + 1), pa.array(known), pa.array(part), pa.array(total), *lists],
                ["doc_id", "n_tokens", "known", "part", "total", "words", "word_times", "grams", "gram_times"],
            )

    lists = "words array<string>, word_times array<int>, grams array<long>, gram_times array<int>"
    scored = rows.mapInArrow(score, f"doc_id {kind}, n_tokens long, known long, part double, total double, {lists}")
    scored = _staged(scored.withColumn("row", F.monotonically_increasing_id()), "scored")

    def tail(keys: str, times: str, name: str) -> DataFrame:
        return scored.select("row", F.explode(F.arrays_zip(F.col(keys).alias(name), F.col(times).alias("times"))).alias("w")).select("row", f"w.{name}", "w.times")

    c, times = F.coalesce("n", F.lit(0)), F.col("times")
    by_word = tail("words", "word_times", "word").join(words, "word", "left").select("row", (times * F.log10(c + 0.5)).alias("part"), F.when(c > 0, times).otherwise(0).alias("known"), F.lit(0.0).alias("total"))
    by_gram = tail("grams", "gram_times", "key").join(rare, "key").select("row", F.lit(0.0).alias("part"), F.lit(0).alias("known"), (times * F.col("log")).alias("total"))
    found = by_word.unionByName(by_gram).groupBy("row").agg(*(F.sum(x).alias(f"more_{x}") for x in ("part", "known", "total")))
    more = lambda x: F.col(x) + F.coalesce(f"more_{x}", F.lit(0))
    return scored.drop("words", "word_times", "grams", "gram_times").join(found, "row", "left").select(
        "doc_id", "n_tokens", more("known").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (more("part") - F.col("n_tokens") * scale).alias("base_score"), more("total").alias("score"),
    )
