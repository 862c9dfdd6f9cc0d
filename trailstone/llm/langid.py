"""Language identification by error-correcting output codes.

Each language gets a codeword; for each bit one binary classifier (naive Bayes over hashed byte n-grams of the letters,
the languages with a 1 against those with a 0) predicts that bit, and the codeword with the least weighted logistic loss
wins. The n-gram counts of the training rows are added up on Spark, all of them; what reaches the driver is one count
for each frequent language and n-gram bucket, whatever the number of rows.

Languages of few rows are learned as well, however many there are: their counts stay on Spark, in tiles that every text
meets, and each has a naive Bayes classifier of the same n-grams against every other language. One that wins against all
of them, the frequent ones included, takes the text; the odds of these classifiers join those of the codewords.

Defined cases: a text that is null or has no letter is `und` with score 0, as is every text when nothing could be
learned; training rows with null language or no letters teach nothing; a single learned language is always predicted;
repeated rows count as often as they occur; other columns of the input don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, staged, text_blocks, text_bytes

#: Buckets of hashed n-grams, lengths of the n-grams in bytes.
BUCKETS, SIZES = 1 << 13, (1, 2, 3)
#: Below this difference between the two best codewords' probabilities a prediction is flagged as ambiguous.
AMBIGUOUS = 0.05
#: Languages with codewords at most: those that name at least one in so many rows. Rarer ones meet the texts in tiles.
MOST_LANGUAGES = 512
#: Rare languages of a tile (a tile has 8 MB at most), tiles of a partition, texts that meet a tile at once.
TILE, TILES_TOGETHER, TEXTS_TOGETHER = 128, 8, 512
#: Letters beyond which evidence no longer sharpens the score.
EVIDENCE = 60.0
#: Text bytes whose n-grams a task holds at once, several times their size.
HELD_BYTES = 1 << 18
#: ASCII letters in lower case, any byte of a longer UTF-8 character as it is, all else a space.
_FOLD = np.array([i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256)], np.uint8)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram within a text, and the text's number; n-grams of spaces alone are left out."""
    folded = _FOLD[data]
    owner = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    found, owners = [], []
    code = np.zeros(len(folded), np.uint32)
    for n in range(1, max(SIZES) + 1):
        if len(folded) < n:
            break
        code = code[: len(folded) - n + 1] * np.uint32(257) + folded[n - 1 :] + np.uint32(1)
        if n in SIZES:
            inside = owner[: len(code)] == owner[n - 1 :]
            inside &= (folded[: len(code)] != 32) | (folded[n - 1 :] != 32)
            mixed = (code[inside] * np.uint32(2654435761)) ^ np.uint32(n * 40503)
            found.append(((mixed >> np.uint32(19)) ^ (mixed & np.uint32(BUCKETS - 1))).astype(np.int32) & (BUCKETS - 1))
            owners.append(owner[: len(code)][inside])
    return np.concatenate(found) if found else np.empty(0, np.int32), np.concatenate(owners) if owners else np.empty(0, np.int32)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all distinct splits for up to 5 classes, else the best separated of seeded random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        splits = [[1] + [1 if k >> i & 1 else -1 for i in range(n - 1)] for k in range(2 ** (n - 1) - 1)]
        return np.array(splits, float).T
    rng, best, most = np.random.default_rng(7), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = ((code.shape[1] - code @ code.T) / 2 + np.eye(n) * code.shape[1]).min()
        if apart > most:
            best, most = code, apart
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # how well each bit's classes are apart
    logs: np.ndarray | None = None  # languages x buckets, log probabilities; only where there are rare languages
    rare: DataFrame | None = None  # tiles of rare languages

    @property
    def learned(self) -> bool:
        return bool(self.languages) or self.rare is not None

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probability of each language for each text of a block."""
        found, owner = grams(data, at)
        n = len(at) - 1
        count = np.bincount(owner, minlength=n).astype(float)
        bits = np.stack([np.bincount(owner, self.weights[found, b], n) for b in range(self.weights.shape[1])], 1)
        margin = bits / np.maximum(count, 1)[:, None]
        sure = np.minimum(count / len(SIZES), EVIDENCE)[:, None]
        loss = np.stack([(np.logaddexp(0, -margin * sure * word) * self.trust).sum(1) for word in self.code], 1)
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        return p / p.sum(1, keepdims=True)


def _mean(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Rounded, so that equal languages tie whatever the order in which they were added up."""
    return np.round(total / np.maximum(count, 1), 9)


def _sure(count: np.ndarray) -> np.ndarray:
    return np.minimum(count / len(SIZES), EVIDENCE)


def _sparse_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, bucket, n of each block: only what occurs, so a block of many languages is held as small as its text."""
    for block in text_blocks(batches, limit=HELD_BYTES):
        found, owner = grams(*text_bytes(block.column("text")))
        named = block.column("lang").dictionary_encode()
        kind = np.asarray(named.indices).astype(np.int64)[owner]
        pair, n = np.unique(kind * BUCKETS + found, return_counts=True)
        yield pa.RecordBatch.from_arrays([named.dictionary.take(pa.array(pair // BUCKETS)).cast(pa.string()), pa.array((pair % BUCKETS).astype(np.int32)), pa.array(n)], ["lang", "bucket", "n"])


_TILE = "tile int, langs array<string>, totals array<double>, seats binary, buckets binary, counts binary"


def _tile(rows: pa.Table) -> pa.Table:
    """The counts of a tile's languages, in the order of their names, as one row."""
    named = rows.column("lang").combine_chunks().dictionary_encode()
    names = named.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    seat = np.empty(len(names), np.int32)
    seat[order] = np.arange(len(names))
    seats, n = seat[np.asarray(named.indices)], np.asarray(rows.column("n")).astype(float)
    packed = [seats.tobytes(), np.asarray(rows.column("bucket")).astype(np.int32).tobytes(), n.tobytes()]
    columns = [[rows.column("tile")[0].as_py()], [[names[i] for i in order]], [np.bincount(seats, n, len(names)).tolist()], *([b] for b in packed)]
    kinds = [pa.int32(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["tile", "langs", "totals", "seats", "buckets", "counts"])


def _rare_tiles(rows: DataFrame, languages: int) -> DataFrame | None:
    """All counts of the rows' languages in tiles of about TILE languages; None where no row teaches anything."""
    tiles = -(-languages // TILE)
    counted = rows.mapInArrow(_sparse_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    dealt = counted.select("lang", "bucket", "n", F.pmod(F.xxhash64("lang"), F.lit(tiles)).cast("int").alias("tile"))
    packed = staged(dealt.repartition(-(-tiles // TILES_TOGETHER), "tile").groupBy("tile").applyInArrow(_tile, _TILE), "languages")
    return None if packed.isEmpty() else packed.repartition(-(-tiles // TILES_TOGETHER))


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of up to TEXTS_TOGETHER texts that have a letter, a block a row."""
    for block in text_blocks(batches):
        block = block.filter(pa.array(map(has_letter, block.column("text").to_pylist()), pa.bool_()))
        for a in range(0, block.num_rows, TEXTS_TOGETHER):
            part = block.slice(a, TEXTS_TOGETHER)
            at = pa.array([0, part.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at, part.column(c)) for c in ("text_key", "text")], ["keys", "texts"])


_MET = "text_key binary, tile int, loss double, lang string, next double, odds double, own double, sure double"


def _meet(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each text and tile the likeliest language, its loss (the mean of -log p over the text's n-grams), that of the
    next one, the odds of all against it, and the least loss that a frequent language has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, keys = shared.value.logs, None
        for batch in batches:
            for i in range(batch.num_rows):
                if keys is None or not batch.column("keys")[i].values.equals(keys):  # a block meets tile after tile
                    keys = batch.column("keys")[i].values
                    n = len(keys)
                    found, owner = grams(*text_bytes(batch.column("texts")[i].values))
                    count = np.bincount(owner, minlength=n)[:, None]
                    held = np.bincount(owner.astype(np.int64) * BUCKETS + found, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(float)
                    own = _mean(-(held @ logs.T), count).min(1, initial=np.inf)
                names, totals = batch.column("langs")[i].as_py(), np.asarray(batch.column("totals")[i].values)
                seats, buckets, counts = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("seats", np.int32), ("buckets", np.int32), ("counts", float)))
                # log p is the logarithm of an n-gram never seen, and this much more
                more = np.zeros((BUCKETS, len(names)))
                more[buckets, seats] = np.log(2 * counts + 1)
                never = np.log(0.5) - np.log(totals + 0.5 * BUCKETS)
                loss = _mean(-(held @ more) - count * never, count)
                best, some = loss.argmin(1), np.arange(n)
                least = loss[some, best]
                odds = np.exp(-_sure(count) * (loss - least[:, None])).sum(1)
                loss[some, best] = np.inf
                columns = [keys, pa.array(np.full(n, batch.column("tile")[i].as_py(), np.int32)), pa.array(least), pa.array([names[k] for k in best], pa.string()), pa.array(loss.min(1)), pa.array(odds), pa.array(own), pa.array(_sure(count)[:, 0])]
                yield pa.RecordBatch.from_arrays(columns, ["text_key", "tile", "loss", "lang", "next", "odds", "own", "sure"])

    return run


def fit_language_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Counts n-grams by language over all rows and turns them into the bits' classifiers.

    A value of the language column that names less than 1 / MOST_LANGUAGES of the rows gets no codeword but a place in a
    tile: neither the driver nor a task holds more than MOST_LANGUAGES times BUCKETS numbers, whatever the column holds.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for block in text_blocks(batches, limit=HELD_BYTES):
            data, at = text_bytes(block.column("text"))
            found, owner = grams(data, at)
            named = block.column("lang").dictionary_encode()
            kind = np.asarray(named.indices)[owner]
            for i, lang in enumerate(named.dictionary.to_pylist()):
                total[lang] = total.get(lang, 0) + np.bincount(found[kind == i], minlength=BUCKETS)
        for lang, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], ["lang", "bucket", "n"])

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    named = rows.groupBy("lang").agg(F.count("*").alias("n"))
    seen = named.agg(F.count("*").alias("languages"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    least = seen["n"] / MOST_LANGUAGES
    often = [r["lang"] for r in named.where(F.col("n") >= least).select("lang").collect()]  # MOST_LANGUAGES at most
    others = seen["languages"] - len(often)
    rare = _rare_tiles(rows.where(~F.col("lang").isin(often)), others) if others else None
    rows = rows.where(F.col("lang").isin(often))
    # at most BUCKETS rows for each language
    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    table = np.zeros((len(languages), BUCKETS))
    for i, lang in enumerate(languages):
        own = counted[counted["lang"] == lang]
        table[i, own["bucket"]] = own["n"]
    p = (table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * BUCKETS)
    code, logs = codewords(len(languages)), None if rare is None else np.log(p)
    if len(languages) < 2:
        return LanguageModel(languages, code, np.zeros((BUCKETS, code.shape[1])), np.ones(code.shape[1]), logs, rare)
    weights = np.stack([np.log(p[code[:, b] > 0].mean(0)) - np.log(p[code[:, b] < 0].mean(0)) for b in range(code.shape[1])], 1)
    # the mean margin of a language's own n-grams, at its least over the languages, is what a bit can be trusted for
    apart = ((p @ weights) * code).min(0)
    return LanguageModel(languages, code, weights, np.maximum(apart, 0.01) / max(np.maximum(apart, 0.01).max(), 0.01), logs, rare)


def identify_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous for each row; the model is BUCKETS x bits numbers, broadcast.

    The columns named in `carry` come along in a struct `row`, so a filter on the prediction needs no join.
    """
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, rare=None))
    any_rare = model.rare is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for block in text_blocks(batches, limit=HELD_BYTES):
            letters = np.fromiter(map(has_letter, block.column("text").to_pylist()), bool, block.num_rows)
            letters &= bool(m.languages)
            if m.languages:
                p = m.scores(*text_bytes(block.column("text")))
                best, top = p.argmax(1), np.sort(p, 1)
            else:
                best, top = np.zeros(block.num_rows, int), np.zeros((block.num_rows, 1))
            after = top[:, -2] if top.shape[1] > 1 else np.zeros(block.num_rows)
            close = top[:, -1] - after < AMBIGUOUS
            named = [m.languages[i] if ok else "und" for i, ok in zip(best, letters, strict=True)]
            columns = {"doc_id": block.column("doc_id"), "lang_pred": pa.array(named, pa.string()), "score": pa.array(np.where(letters, top[:, -1], 0.0)), "ambiguous": pa.array(close & letters)}
            if any_rare:
                columns |= {"text_key": block.column("text_key"), "after": pa.array(after)}
            if carry:
                columns["row"] = block.column("row")
            yield pa.RecordBatch.from_pydict(columns)

    along = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")] if carry else []
    rows = pick(docs, id_col, text_col, *along)
    if any_rare:
        rows = rows.withColumn("text_key", F.unhex(F.sha2("text", 256)))
    kinds = dict(rows.dtypes)
    more = ", text_key binary, after double" if any_rare else ""
    found = rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, lang_pred string, score double, ambiguous boolean" + more + (f", row {kinds['row']}" if carry else ""))
    return _with_rare(found, rows, model.rare, shared, carry) if any_rare else found


def _with_rare(found: DataFrame, rows: DataFrame, tiles: DataFrame, shared: Broadcast, carry: tuple[str, ...]) -> DataFrame:
    """The predictions after each text met every tile; what a tile says depends on the text alone, which names it."""
    met = rows.select("text_key", "text").mapInArrow(_pack_texts, "keys array<binary>, texts array<string>").crossJoin(tiles).mapInArrow(_meet(shared), _MET)
    said = F.struct("loss", "lang", "next", "odds", "own", "sure")
    of_text = met.groupBy("text_key", "tile").agg(F.min(said).alias("said")).groupBy("text_key").agg(F.array_sort(F.collect_list("said")).alias("said"))
    both = found.join(of_text, "text_key", "left")
    rare, own, sure = (F.col("said")[0][c] for c in ("loss", "own", "sure"))
    least = F.least(rare, own)

    def odds(loss: Column) -> Column:
        return F.exp(-sure * (loss - least))

    next_rare = F.least(F.array_min(F.transform("said", lambda s: s["next"])), F.array_min(F.transform(F.slice("said", 2, F.greatest(F.size("said"), F.lit(1))), lambda s: s["loss"])))
    codes = F.when(own == float("inf"), 0.0).otherwise(odds(own))
    total = F.aggregate("said", F.when(codes > 0, codes / F.col("score")).otherwise(0.0), lambda sum_, s: sum_ + s["odds"] * odds(s["loss"]))
    takes = rare < own
    score = F.when(takes, odds(rare)).otherwise(codes) / total
    second = F.greatest(odds(next_rare), F.when(takes, codes).otherwise(F.greatest(odds(rare), codes * F.col("after") / F.col("score")))) / total
    heard = F.col("said").isNotNull()
    return both.select(
        "doc_id",
        F.when(heard & takes, F.col("said")[0]["lang"]).otherwise(F.col("lang_pred")).alias("lang_pred"),
        F.when(heard, score).otherwise(F.col("score")).alias("score"),
        F.when(heard, score - second < AMBIGUOUS).otherwise(F.col("ambiguous")).alias("ambiguous"),
        *(["row"] if carry else []),
    )
