import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import brute
from tests.llm.test_pii_and_leaks import slow_alignment
from trailstone.llm.decontaminate import LEAK, MIN_WORDS, words_of

SMALL = "/root/testdata/sf0.001"


def test_run_equals_a_brute_force_version(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    seen, once = set(), []
    for i, t in rows:
        key = re.sub(r"[ \t\n\x0b\x0c\r]+", " ", t)
        if key not in seen:
            seen.add(key)
            once.append((i, t))
    roots = brute([t for _, t in once], 5)[1]
    kept = [x for k, x in enumerate(once) if roots[k] == k]
    items = [w for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if len(w := words_of(r.text or "")) >= MIN_WORDS]
    clean = []
    for i, t in kept:
        words = words_of(t)
        # an item can only reach the mark with that share of its words in the text
        have = set(words)
        close = [w for w in items if sum(x in have for x in w) >= LEAK * len(w)]
        if not any(2 * LEAK * len(w) <= slow_alignment(w, words[a : a + 3 * len(w)]) for w in close for a in range(0, len(words), len(w))):
            clean.append((i, t))
    path = public_tokenizers.path(corpus_pipeline.VOCABULARY)
    import base64

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: (library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in clean}
    got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == want


def test_driver_entry_has_all_eleven():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_rows_are_judged_one_by_one_whatever_their_ids(spark, tmp_path):
    """Null ids, one id with several texts, a leak among them, copies that differ in white space or id only."""
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar papa"
    long = [f"w{i}" for i in range(60)]
    near = " ".join([*long[:59], "changed"])
    rows = [
        (None, f"first {item} end"), (None, "a clean text without an id, long enough to be one of its own"),
        (7, f"second one with quite a few words of its own {item} end"), (7, "another clean text that has the id of a leak and is kept"),
        (8, "a text twice, in white space of  two kinds"), (8, "a text twice, in white space of two kinds"),
        (9, "a copy that lacks an id loses against this one"), (None, "a copy that lacks an id loses against this one"),
        (None, "only rows without ids have this text"), (None, "only rows without ids have this text"),
        (11, " ".join(long)), (11, near), (None, " ".join([*long, "more"])), (12, "the very last one stands for itself"),
        (12, "the very last one stands for itself"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted(((r.doc_id is None, r.doc_id or 0, " ".join(r.text.split())) for r in df.collect()))
    want = lambda keep: sorted((i is None, i or 0, " ".join(t.split())) for k, (i, t) in enumerate(rows) if k in keep)
    docs = corpus_pipeline.staged(stages["exact copies"](spark, docs, str(tmp_path)))
    assert texts(docs) == want({0, 1, 2, 3, 4, 6, 8, 10, 11, 12, 13})
    docs = corpus_pipeline.staged(stages["near copies"](spark, docs, str(tmp_path)))
    kept = texts(docs)
    # the leaks are near copies of nothing (the words around the passage differ); of the long ones one of id 11 stays
    assert [r for r in kept if "w5" not in r[2]] == want({0, 1, 2, 3, 4, 6, 8, 13}) and [r[1] for r in kept if "w5" in r[2]] == [11]
    left = texts(stages["benchmark leaks"](spark, docs, str(tmp_path)))
    assert [r for r in left if "w5" not in r[2]] == want({1, 3, 4, 6, 8, 13}) and len(left) == 7


def test_stages_meet_python_in_batches_of_a_few_mb(spark):
    """Batches of up to 64 MB, Spark's own limit, took an executor beyond its memory."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    def largest():
        texts = spark.range(0, 600, 1, 1).select(F.repeat(F.lit("x"), 40_000).alias("text"))
        return max(r.n for r in texts.mapInArrow(sizes, "n long").collect())

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(corpus_pipeline.BATCH_LIMIT)
        stage(spark, docs.limit(20), SMALL)
        assert largest() < 10 << 20
    spark.conf.set(corpus_pipeline.BATCH_LIMIT, str(2 << 20))  # the session's own limit holds
    corpus_pipeline.tokens(spark, docs, SMALL)
    assert largest() < 3 << 20
    spark.conf.unset(corpus_pipeline.BATCH_LIMIT)


def test_tokens_take_one_worker_a_task(spark):
    """A worker for the encoder and one for the decoder, each with a vocabulary, stayed for all stages after."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = corpus_pipeline.tokens(spark, docs, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
