import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.oracle import assert_same
from trailstone.llm import exact_dedup as ed
from trailstone.llm import near_dedup as nd
from trailstone.llm.components import UnionFind, components
from trailstone.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_exact_query_equals_its_sql(spark):
    assert_same(QUERIES["op9_exact_dedup"](spark, SMALL), ORACLE_SQL["op9_exact_dedup"], SMALL)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000), st.integers(0, 5000))
def test_fingerprints_combine(data, cut):
    cut = min(cut, len(data))
    whole = np.frombuffer(data, np.uint8)
    mark = lambda x: (ed.fingerprints(x, np.array([0, len(x)]))[0], len(x))
    both = ed.combine(mark(whole[:cut]), mark(whole[cut:]))
    assert both[1] == len(data) and (both[0] == mark(whole)[0]).all()
    for k in range(2):
        assert sum(b * pow(int(ed.BASES[k]), i, int(ed.PRIMES[k])) for i, b in enumerate(data)) % int(ed.PRIMES[k]) == mark(whole)[0][k]


def test_collisions_are_resolved(spark):
    rows = [(i, f"text number {i % 7:03d} " + "x" * 20_000) for i in range(30)] + [(100, "short"), (101, "trohs")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in ed.exact_dedup(docs, bits=0).collect()}
    want = {i: (i % 7, sum(j % 7 == i % 7 for j in range(30)), i < 7) for i in range(30)} | {100: (100, 1, True), 101: (101, 1, True)}
    assert got == want


def test_components_equal_union_find(spark):
    rnd = random.Random(2)
    for n, m in ((30, 12), (60, 90), (200, 150)):
        links = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(0, None)]
        sets = UnionFind()
        for a, b in links:
            if b is not None:
                sets.union(a, b)
        got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert all(got.get(i, i) == sets.find(i) for i in range(n))
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.root for r in components(chain).collect()} == {0}
    assert components(chain.limit(0)).count() == 0


def reference_signature(elements):
    """One element, one rank at a time, with its own permutation."""
    out = [2**32 - 1] * nd.REGISTERS
    for e in elements:
        seats = list(range(nd.REGISTERS))
        for rank in range(nd.REGISTERS):
            z = int(nd._mix(np.array([e], np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (rank + 1)) % 2**64))[0])
            k = rank + ((z & 0xFFFFFFFF) * (nd.REGISTERS - rank) >> 32)
            seats[rank], seats[k] = seats[k], seats[rank]
            out[seats[rank]] = min(out[seats[rank]], rank << 25 | z >> 39)
    return out


def test_signatures_equal_the_slow_definition_and_estimate_similarity():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 5, 40, 300, 2000)]
    got = nd.signatures([*sets, np.empty(0, np.uint64)])
    for s, row in zip(sets, got, strict=False):
        assert row.tolist() == reference_signature(s)
    assert (got[-1] == 2**32 - 1).all()
    errors = []
    for _ in range(40):
        common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (160, 20, 20))
        x, y = nd.signatures([np.concatenate([common, a]), np.concatenate([common, b])])
        errors.append((x == y).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.036  # plain MinHash: 0.0354


def brute(texts, k):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    links = UnionFind()
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                links.union(i, j)
    return [len(s) for s in sets], [links.find(i) for i in range(len(sets))]


@pytest.mark.parametrize("k", [2, 5])
def test_near_copies_equal_brute_force(spark, k):
    rnd = random.Random(k)
    words = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(words) for _ in range(rnd.randrange(1, 90))] for _ in range(12)]
    texts = []
    for _ in range(260):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice((0, 0, 1, 2, 3, 5))):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        texts.append(rnd.choice((" ", "  ", "\n")).join(w).upper() if rnd.random() < 0.2 else " ".join(w))
    texts += ["", None, "  ", "one", "one", "One two"]
    # one large group whose members differ from each other in more than from its middle
    middle = [rnd.choice(words) for _ in range(150)]
    for i in range(700):
        w = list(middle)
        for _ in range(i % 9):
            w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    sizes, roots = brute(texts, k)
    got = {r.doc_id: r for r in nd.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=k).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == roots
    assert all(got[i].kept == (roots[i] == i) for i in got)


def test_blocks_of_a_crowded_bucket(spark):
    """More documents alone in their buckets than a block holds: far too alike for bands, too unlike for links."""
    rnd = random.Random(9)
    middle = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(600):
        w = list(middle)
        for j in rnd.sample(range(100), 9):
            w[j] = f"new{rnd.randrange(10**9)}"
        texts.append(" ".join(w))
    texts += texts[:3]
    texts.append(texts[5] + " tail")
    _, roots = brute(texts, 1)
    got = {r.doc_id: r.component_id for r in nd.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=1).collect()}
    assert [got[i] for i in range(len(texts))] == roots


def test_rows_that_share_an_id_are_read_once_each(spark, monkeypatch):
    """5,000 rows of one id, pairs of near copies among them: brute force, and how many texts are read again."""
    from trailstone.llm import near_dedup as nd

    read = spark.sparkContext.accumulator(0)
    sets = nd._sets

    def counted(k):
        run = sets(k)

        def through(batches):
            def tally():
                for b in batches:
                    read.add(b.num_rows)
                    yield b

            return run(tally())

        return through

    monkeypatch.setattr(nd, "_sets", counted)
    texts = [" ".join(f"w{i // 2}x{j}" for j in range(20)) + (" end" if i % 2 else "") for i in range(5000)]
    docs = spark.createDataFrame([(None if i < 2500 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = nd.near_dedup(docs, k=2).collect()
    assert len(rows) == 5000 and sorted(r.n_shingles for r in rows) == [19] * 2500 + [20] * 2500
    assert {(r.doc_id, r.component_id) for r in rows} == {(None, None), (7, 7)}
    assert read.value <= 5000
