import itertools
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from trailstone.llm import langid, ppm, quality, toxicity
from trailstone.llm.queries import QUERIES

MIDDLE = "/root/testdata/sf0.01"


def held_out_pairs(spark, name, label):
    rows = QUERIES[name](spark, MIDDLE).toPandas()
    return rows.merge(spark.read.parquet(f"{MIDDLE}/labels.parquet").select("doc_id", F.col(label).alias("y")).toPandas(), on="doc_id")


def area(score, y):
    rank = score.rank()
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_quality_on_held_out_rows(spark):
    d = held_out_pairs(spark, "op5_quality", "quality")
    assert (d["predicted"] == (d["score"] >= 0.3)).all()
    own = d[d["held_out"]]
    assert area(own["score"], own["y"]) > 0.95


def test_toxicity_on_held_out_rows(spark):
    d = held_out_pairs(spark, "op4_toxicity", "toxic")
    assert (d["predicted"] == (d["score"] >= 0.5)).all()
    seen, own = d[~d["held_out"]], d[d["held_out"]]
    assert area(seen["score"], seen["y"]) > 0.95
    assert (own["predicted"] == own["y"]).mean() > 0.85


def test_language_on_held_out_rows(spark):
    rows = QUERIES["op6_language_id"](spark, MIDDLE).toPandas()
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang").toPandas()
    own = rows.merge(docs, on="doc_id")
    own = own[own["held_out"]]
    assert (own["lang"] == own["lang_pred"]).mean() > 0.97
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) for i in own["doc_id"])


@pytest.mark.parametrize("n", [2, 3, 5, 6, 12])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len({tuple(r) for r in code}) == n
    apart = min((a != b).sum() for a, b in itertools.combinations(code, 2))
    assert apart >= (1 if n == 2 else code.shape[1] * 0.25)


def test_one_language_is_always_predicted(spark):
    docs = spark.createDataFrame([(i, "alle meine Entchen", "de") for i in range(9)] + [(99, "123", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify_language(docs, langid.fit_language_model(docs)).collect()}
    assert set(got.values()) == {"de", "und"} and got[99] == "und"


def test_language_scores_equal_decoding_bit_by_bit(spark):
    """Mean weight of a text's n-grams for each bit, logistic loss against each codeword, one text and one bit at a time."""
    names = ["de", "en", "es", "fr", "it", "nl", "pt"]
    docs = spark.createDataFrame([(i, " ".join(f"{names[i % 7]}{(i * k) % 13}ab{i % 7}" for k in range(1, 30)), names[i % 7]) for i in range(70)], "doc_id long, text string, lang string")
    model = langid.fit_language_model(docs)
    assert model.languages == names and model.code.shape[1] > 5
    texts = ["de3ab0 en1ab1", "fr", "pt9ab6 " * 40, "zz"]
    data, at = langid.text_bytes(langid.pa.array(texts))
    got = model.scores(data, at)
    for t, row in zip(texts, got, strict=True):
        found = langid.grams(*langid.text_bytes(langid.pa.array([t])))[0].tolist()
        sure = min(len(found) / len(langid.SIZES), langid.EVIDENCE)
        losses = []
        for word in model.code:
            loss = 0.0
            for b, sign in enumerate(word):
                margin = sum(model.weights[g, b] for g in found) / max(len(found), 1)
                loss += model.trust[b] * math.log1p(math.exp(-margin * sure * sign))
            losses.append(loss)
        p = [math.exp(min(losses) - x) for x in losses]
        assert row == pytest.approx([x / sum(p) for x in p], rel=1e-9)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, len(quality.FEATURES)))
    y = ((x[:, 3] > 0) ^ (x[:, 7] > 0.5)).astype(float)
    model = quality.grow_trees(x[:3000], y[:3000], np.ones(3000))
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    # flattened traversal against a walk row by row
    for row in x[:20]:
        total = model.base
        for at in model.roots:
            while model.feature[at] >= 0:
                at = model.left[at] if row[model.feature[at]] <= model.threshold[at] else model.right[at]
            total += model.value[at]
        assert model.score(row[None])[0] == pytest.approx(1 / (1 + math.exp(-total)))


def test_gradients_of_the_network():
    model = toxicity.ToxicityModel(3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    words = ["you", "are", "Moron!", "fine", "é"]
    grid = np.zeros((3, toxicity.WINDOW), np.int64)
    grid[0, :4], grid[1, :2], grid[2, :5] = [1, 2, 3, 3], [4, 5], [5, 4, 3, 2, 1]
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        z = model.logits(model.inputs(words).astype(np.float64), grid).astype(np.float64)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    g = model.gradients(words, grid, y)
    rng = np.random.default_rng(0)
    for name, value in model.p.items():
        flat, grad = value.reshape(-1), g[name].reshape(-1)
        for i in np.argsort(-np.abs(grad))[:3].tolist() + rng.integers(0, len(flat), 2).tolist():
            old, step = flat[i], 1e-2
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert grad[i] == pytest.approx((up - down) / (2 * step), abs=3e-4), name


def test_windows_reach_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        w = toxicity.windows(np.arange(1, n + 1))
        assert set(w.ravel()) - {0} == set(range(1, n + 1))


def test_network_learns_stems_wherever_they_stand():
    rnd = random.Random(4)
    clean = [f"w{i}" for i in range(300)]
    make = lambda bad: [*(rnd.choice(clean) for _ in range(rnd.randrange(5, 200))), *([rnd.choice(("vilka", "vilkan", "grumps", "vilket"))] if bad else [])]
    texts, y = [], []
    for i in range(240):
        w = make(i % 3 == 0)
        rnd.shuffle(w)
        texts.append(" ".join(w))
        y.append(float(i % 3 == 0))
    model = toxicity.train(texts[:180], np.array(y[:180]), 1 / 3)
    s = model.text_scores(texts[180:])
    assert ((s >= 0.5) == np.array(y[180:])).mean() > 0.9
    assert model.text_scores(["vilkor " + "w1 " * 100])[0] > model.text_scores(["w2 " + "w1 " * 100])[0]


# ---- prediction by partial matching


def contexts_of(texts, order):
    """Counts of the symbols after each context of each length."""
    out = defaultdict(Counter)
    for t in texts:
        s = bytes([ppm.START]) * order + t.encode().lower() + bytes([ppm.END])
        for i in range(order, len(s)):
            for k in range(order + 1):
                out[s[i - k : i]][s[i]] += 1
    return out


def slow_distribution(contexts, context):
    """Probability of each next byte by the definition: longest known context, escape, exclusion."""
    p, left, excluded = {}, 1.0, set()
    for k in range(len(context), -1, -1):
        here = contexts.get(context[len(context) - k :])
        if not here:
            continue
        fresh = {s: n for s, n in here.items() if s not in excluded}
        n = sum(fresh.values())
        if not n:
            continue
        for s, c in fresh.items():
            p[s] = left * (2 * c - 1) / (2 * n)
        left *= len(fresh) / (2 * n)
        excluded |= set(here)
    rest = [s for s in range(256) if s not in excluded]
    for s in rest:
        p[s] = left / len(rest)
    return p


def slow_score(contexts, text, order, seen={}):  # noqa: B006
    s, total = bytes([ppm.START]) * order + text.encode().lower() + bytes([ppm.END]), 0.0
    for i in range(order, len(s)):
        key = id(contexts), s[i - order : i]
        if key not in seen:
            seen[key] = slow_distribution(contexts, s[i - order : i])
            assert sum(seen[key].values()) == pytest.approx(1, abs=1e-9)
        total += math.log10(seen[key][s[i]])
    return total


@pytest.mark.parametrize(("order", "share", "word_share"), [(3, 1, 1), (3, 1 << 23, 1 << 19), (5, 200, 50), (1, 30, 1), (0, 1, 1)])
def test_model_equals_the_definition_wherever_grams_are_looked_up(spark, order, share, word_share):
    rnd = random.Random(order)
    texts = ["".join(rnd.choice("abbccc d") for _ in range(rnd.randrange(30))) for _ in range(40)] + ["Hello hello world", "", None, "é", "hello", "zzz é 漢", "Ccc\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.lm_scores(docs, F.when(F.col("doc_id") == 5, F.lit(None)).otherwise(F.col("doc_id") % 4 != 1), order=order, share=share, word_share=word_share).collect()}
    contexts = contexts_of([t or "" for i, t in enumerate(texts) if i % 4 != 1 and i != 5], order)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].score == pytest.approx(slow_score(contexts, t or "", order), rel=1e-9)


def test_nothing_to_learn_from_leaves_all_bytes_equally_likely(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.score, r.n_known, r.train_tokens) for r in ppm.lm_scores(docs, F.lit(False)).collect()}
    assert got == {1: (pytest.approx(-3 * math.log10(256)), 0, 0), 2: (pytest.approx(-math.log10(256)), 0, 0)}


def test_scores_equal_brute_force_and_beat_the_base_on_what_was_learned(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in QUERIES["op10_lm_score"](spark, folder).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    words = {i: t.encode().lower().split() for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    c, ends = Counter(), 0
    for i, w in words.items():
        if not held[i]:
            c.update(w)
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    contexts = contexts_of([t for i, t in texts.items() if not held[i]], ppm.ORDER)
    for i, w in words.items():
        r = rows[i]
        assert r.score == pytest.approx(slow_score(contexts, texts[i], ppm.ORDER), rel=1e-9)
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    assert sum(r.score for r in rows.values() if not r.held_out) > sum(r.base_score for r in rows.values() if not r.held_out)


def test_tables_find_what_they_hold():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    t = ppm._Table(keys)
    assert (t.find(keys) == np.arange(len(keys))).all()
    assert (t.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert (ppm._Table(keys[:0]).find(keys[:5]) == -1).all()


def test_a_task_counts_grams_in_little_memory_and_hands_them_on_in_small_batches(spark):
    """6 MB of text with few repeated grams took a worker 267 MB, and went on as one batch of 2 million rows."""
    rng = np.random.default_rng(0)
    data = rng.integers(97, 123, 6 << 20, np.uint8)
    texts = [data[i : i + 4096].tobytes().decode() for i in range(0, len(data), 4096)]

    class Rows:
        def select(self, *names):
            return self

        def mapInArrow(self, count, schema):  # noqa: N802
            self.count = count
            return spark.createDataFrame([], schema)

    rows = Rows()
    ppm.gram_counts(rows)
    batches = [pa.record_batch({"text": texts[i : i + 500], "learn": [True] * len(texts[i : i + 500])}) for i in range(0, len(texts), 500)]
    tracemalloc.start()
    try:
        most = total = 0
        for out in rows.count(iter(batches)):
            most, total = max(most, out.num_rows), total + pc.sum(out.column("n")).as_py()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert total == len(data) + len(texts)
    assert peak < 100e6 and most <= 1 << 17


def test_grams_held_in_parts_add_up(monkeypatch):
    monkeypatch.setattr(ppm, "HELD", 600)
    rng, sums, want, got = np.random.default_rng(1), ppm._Sums(), Counter(), Counter()
    handed = []
    for high in [50] * 20 + [5000] * 20 + [50] * 3:
        keys, counts = np.unique(rng.integers(0, high, 90).astype(np.uint64), return_counts=True)
        want.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        handed += sums.add(keys, counts)
    handed += sums.flush()
    for out in handed:
        got.update(dict(zip(out.column("key").to_pylist(), out.column("n").to_pylist(), strict=True)))
    assert got == want and len(handed) > 2 and not list(sums.flush())


def test_texts_meet_the_language_model_in_batches_of_a_few_mb(spark, monkeypatch):
    """Batches of up to 64 MB, Spark's own limit, took an executor beyond its memory."""
    limit, found, staged = "spark.sql.execution.arrow.maxBytesPerBatch", {}, ppm.staged

    def seen(df, name):
        found[name] = spark.conf.get(limit, None)
        return staged(df, name)

    monkeypatch.setattr(ppm, "staged", seen)
    docs = spark.createDataFrame([(1, "ab"), (2, "b c")], "doc_id long, text string")
    spark.conf.unset(limit)
    ppm.lm_scores(docs, F.lit(True))
    assert all(int(found[name] or 64 << 20) <= 8 << 20 for name in ("grams", "words", "scored"))
    assert spark.conf.get(limit, None) is None
    spark.conf.set(limit, str(1 << 20))  # the session's own limit holds
    try:
        ppm.lm_scores(docs, F.lit(True))
        assert {found[name] for name in ("grams", "words", "scored")} == {str(1 << 20)} and spark.conf.get(limit) == str(1 << 20)
    finally:
        spark.conf.unset(limit)


def test_a_column_of_junk_languages_is_no_burden(spark):
    from trailstone.llm import langid

    real = [("the word of that and this with which " * 4 + str(i), "en") for i in range(400)] + [("der und die nicht ein werden für auch " * 4 + str(i), "de") for i in range(400)]
    junk = [(f"zz{i} qq", f"junk{i}") for i in range(20_000)]
    model = langid.fit_language_model(spark.createDataFrame(real * 30 + junk, "text string, lang string"))
    assert model.languages == ["de", "en"]
    docs = spark.createDataFrame([(1, "this with that which and the word"), (2, "nicht werden und auch für die ein")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify_language(docs, model).collect()} == {1: "en", 2: "de"}


def words_of(i, n=12):
    """Words of letters that a language uses more than others."""
    rng = random.Random(i)
    own = rng.sample("abcdefghijklmnopqrstuvwxyz", 6)
    return " ".join("".join(rng.choices(own, k=5)) for _ in range(n))


def test_languages_of_few_rows_are_learned(spark):
    rows = [("the word of that and this with which " + str(i), "en") for i in range(700)] + [("der und die nicht ein werden für auch", "de") for _ in range(700)] + [("eta hau ez da baina zer dugu gure etxean", "eu")]
    model = langid.fit_language_model(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["de", "en"]
    docs = spark.createDataFrame([(1, "gure etxean eta hau"), (1, "gure etxean eta hau"), (2, "nicht werden und auch"), (3, "with the word"), (None, "zer da hau"), (4, None), (5, "12 !")], "doc_id long, text string")
    found = langid.identify_language(docs, model, carry=("text", "doc_id")).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in found) == [("1", "eu"), ("1", "eu"), ("2", "de"), ("3", "en"), ("4", "und"), ("5", "und"), ("None", "eu")]
    assert all(r.row.doc_id == r.doc_id and (0.5 < r.score <= 1 if r.lang_pred != "und" else r.score == 0) for r in found)


@pytest.mark.parametrize("often", [True, False])
def test_rare_languages_equal_one_against_each_other(spark, monkeypatch, often):
    """More languages than codewords are given, in several tiles: the likeliest one by counts of one text at a time."""
    monkeypatch.setattr(langid, "TILE", 50)
    names = [f"l{i:03}" for i in range(600)]
    rows = [(words_of(i), name) for i, name in enumerate(names)] + [(words_of(1000 + k), name) for k, name in enumerate(("aa", "bb")) for _ in range(300 if often else 1)]
    rows.append((words_of(7), "l599b"))  # equal to l007
    model = langid.fit_language_model(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == (["aa", "bb"] if often else [])
    texts = [words_of(i)[5:30] for i in range(0, 600, 13)] + [words_of(7), words_of(1000)[:20], words_of(1001)] + [words_of(2000 + i) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify_language(docs, model).collect()}
    counts = defaultdict(Counter)
    for text, name in rows:
        counts[name].update(langid.grams(*langid.text_bytes(langid.pa.array([text])))[0].tolist())
    assert len(got) == len(texts)
    block = langid.text_bytes(langid.pa.array(texts))
    codes = model.scores(*block) if often else None
    for i, text in enumerate(texts):
        own = langid.grams(*langid.text_bytes(langid.pa.array([text])))[0].tolist()
        sure = min(len(own) / len(langid.SIZES), langid.EVIDENCE)
        mean = {name: round(-sum(math.log((c[g] + 0.5) / (c.total() + 0.5 * langid.BUCKETS)) for g in own) / len(own), 9) for name, c in counts.items()}
        frequent = min((mean[name] for name in model.languages), default=math.inf)
        best, rare = min((v, name) for name, v in mean.items() if name not in model.languages)
        odds = {name: math.exp(-sure * (v - min(best, frequent))) for name, v in mean.items() if name not in model.languages}
        if often:
            odds |= {name: p / max(codes[i]) * math.exp(-sure * (frequent - min(best, frequent))) for name, p in zip(model.languages, codes[i], strict=True)}
        wins = rare if best < frequent else model.languages[codes[i].argmax()]
        total = sum(odds.values())
        first, second = odds.pop(wins) / total, max(odds.values()) / total
        assert got[i].lang_pred == wins
        assert got[i].score == pytest.approx(first, rel=1e-5)
        assert got[i].ambiguous == (first - second < langid.AMBIGUOUS)


def test_languages_that_are_equally_likely(spark):
    from trailstone.llm import langid

    same = [("words that both of them have", lang) for lang in ("aa", "bb") for _ in range(5)]
    model = langid.fit_language_model(spark.createDataFrame(same, "text string, lang string"))
    docs = spark.createDataFrame([(1, "words that both of them have")], "doc_id long, text string")
    r = langid.identify_language(docs, model).first()
    assert (r.lang_pred, r.ambiguous) == ("aa", True) and abs(r.score - 0.5) < 1e-9


def test_long_texts_are_scored_but_not_learned_from(spark, monkeypatch):
    from trailstone.llm import toxicity

    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y, share: seen.append((sorted(map(len, texts)), share)) or toxicity.ToxicityModel())
    monkeypatch.setattr(toxicity, "LONGEST", 50)
    docs = spark.createDataFrame([(1, "a" * 50), (2, "b" * 51), (3, "c"), (4, "é" * 26)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    toxicity.fit_toxicity(docs, labels, F.lit(True))
    assert seen == [([1, 50], 0.5)]
