"""Hard negatives, shards and conversation repair against brute force."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same, normal
from trailstone.llm import negatives, repair, shards
from trailstone.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_structure_repair"])
def test_equal_to_sql(spark, name):
    assert_same(QUERIES[name](spark, SMALL), ORACLE_SQL[name], SMALL)


# hard negatives


def plain_negatives(rows, anchors, scale=256, positives=5, negatives_=3):
    """rows: (vec_id, label, vector); anchors: the places of the anchors among them."""
    kept = []
    for vec_id, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((vec_id, label, [math.floor(x * scale) for x in v]))
    last = lambda i: math.inf if i is None else i
    out = []
    for i, (a_id, a_label, a) in enumerate(kept):
        if a_id is None or not anchors(a_id):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a, v, strict=False)), last(c), c, label == a_label) for j, (c, label, v) in enumerate(kept) if j != i), key=lambda s: s[:2])
        for p, _, p_id, _ in [s for s in scored if s[3]][:positives]:
            inside = [s for s in scored if not s[3] and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out += [(a_id, p_id, r, s[2], -p, -s[0]) for r, s in enumerate(inside[:negatives_], 1)]
    return sorted(map(repr, out))


def mined(spark, rows, anchor="vec_id % 5 = 0"):
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = negatives.hard_negatives(negatives.whole_vectors(table.withColumn("row", F.lit("x")), F.col("label")), F.expr(anchor))
    return sorted(repr(tuple(r)) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("size", [1.0, 1e5])  # the second beyond exact doubles
def test_negatives_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "LEAST_SLICE", 50)
    monkeypatch.setattr(negatives, "PROBE", 4)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    rows = [(int(i), int(rng.integers(3)), [float(x) for x in (centres[i % 6] + 0.4 * rng.normal(size=12)) * size]) for i in range(300)]
    rows += rows[40:60] + [(1000 + i, rows[i][1], rows[7][2]) for i in range(30)]  # rows that repeat, and copies under other ids and labels
    assert mined(spark, rows) == plain_negatives(rows, lambda i: i % 5 == 0)


def test_negatives_of_odd_rows(spark):
    rows = [(0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (None, 2, [1.0, 1.0]), (5, None, [1.0, 1.0]), (10, 1, None), (15, 1, [None, 1.0]), (20, 2, [float("nan"), 1.0]), (25, 2, [float("inf"), 1.0])]
    rows += [(30, 2, [1.0]), (35, 2, []), (40, 1, [0.5, 2.0]), (41, 2, [0.5, 1.5]), (42, 2, [0.5, 1.5]), (43, 3, [-1.0, -1.0]), (None, 3, [0.7, 1.2])]
    assert mined(spark, rows) == plain_negatives(rows, lambda i: i % 5 == 0)
    assert mined(spark, rows[:0]) == mined(spark, rows, "false") == []


def test_bounds_leave_candidates_unscored():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 32))
    x = np.floor(256 * (centres[rng.integers(8, size=4000)] + 0.02 * rng.normal(size=(4000, 32)))).astype(np.int64)
    order, parent, edge = negatives.spanning_tree(x[:200])
    seat = {int(o): s for s, o in enumerate(order)}
    anchors = [{"v": x[o], "row": int(o), "label": 0, "parent": seat.get(int(parent[o]), -1), "edge": float(edge[o]), "windows": [(-(2**63), 2**63 - 1)]} for o in order]
    part = negatives.Slice(x, np.arange(4000), np.arange(4000), np.zeros(4000, np.int64), float(np.sqrt((x.astype(float) ** 2).sum(1)).max()))
    found = list(negatives.search_block(part, anchors, 5, True))
    for s, a in enumerate(anchors):
        exact = x @ a["v"]
        best = sorted((-int(e), i) for i, e in enumerate(exact) if i != a["row"])[:5]
        assert [(-score, c) for seat_, _, c, score in found if seat_ == s] == best
    assert part.scored < 0.3 * 200 * 4000


# shards


def test_shards_hold_every_row_once(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = QUERIES["op12_external_shuffle"](spark, SMALL).collect()
    plain = sorted((d.doc_id, len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode())) for d in docs.collect())
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == plain
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    check_slots(rows, 40)


def check_slots(rows, n):
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(n)}
    assert sum(map(len, slots.values())) == len(rows)
    assert all(v == list(range(len(v))) for v in slots.values())
    sizes = [len(v) for v in slots.values()]
    assert max(sizes) - min(sizes) <= 1


def test_shuffle_is_a_function_of_rows_and_seed(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    order = lambda frame, seed, **more: [r.doc_id for r in shards.external_shuffle(frame, 7, seed, bucket_bytes=1 << 14, **more).orderBy("shard", "slot").collect()]
    first = order(docs, 1)
    assert first == order(docs.repartition(9, "n_chars"), 1) != order(docs, 2)
    assert sorted(first) != first and sorted(first) == sorted(order(docs, 2))
    # neighbours in the table are no neighbours in the shuffle more often than by chance (about 2 of 200)
    assert sum(abs(a - b) == 1 for a, b in zip(first, first[1:], strict=False)) < 12


def test_shuffle_in_two_passes_by_hand(spark):
    """Each bucket's rows are next to each other, buckets in order, and each is mixed."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    out = shards.external_shuffle(docs, 3, 5, bucket_bytes=1 << 14).orderBy("shard", "slot").collect()
    n = -(-sum(len((r.text or "").encode()) + 16 for r in out) // (1 << 14))
    body = F.struct(F.col("doc_id"), F.col("text"))
    hashed = docs.select("doc_id", F.xxhash64(F.lit(5), body).alias("h1"), F.xxhash64(F.lit(~5), body).alias("h2"))
    bucket = {r.doc_id: r.b for r in hashed.select("doc_id", F.pmod(F.xxhash64(F.lit(5), "h1", "h2", F.lit(0).cast("long")), F.lit(n)).alias("b")).collect()}
    passed = [bucket[r.doc_id] for r in out]
    assert n > 4 and passed == sorted(passed)
    key = {r.doc_id: (r.h1, r.h2) for r in hashed.collect()}
    assert [key[r.doc_id] for r in out] != sorted(key[r.doc_id] for r in out)


def test_a_row_that_fills_a_third(spark, monkeypatch):
    monkeypatch.setattr(shards, "REPEATS", 16)
    monkeypatch.setattr(shards, "_RUN", 64)
    rows = [(i, f"text {i}") for i in range(2000)] + [(7, "again")] * 1000 + [(8, None)] * 30 + [(None, None)] * 3
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")).withColumn("note", F.lit("n"))
    out = shards.external_shuffle(table, 10, 3, keep=["note"], bucket_bytes=1 << 11).collect()
    check_slots(out, 10)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in out))) == sorted(map(repr, rows)) and {r.note for r in out} == {"n"}
    hot = [sum(r.doc_id == 7 and r.text == "again" for r in out if r.shard == s) for s in range(10)]
    assert min(hot) > 40  # a tenth of the copies is 100


def test_shards_of_few_and_no_rows(spark):
    table = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    out = shards.external_shuffle(table, 40).collect()
    assert sorted((r.doc_id, r.text, r.slot) for r in out) == [(1, "a", 0), (2, None, 0)] and out[0].shard != out[1].shard
    assert shards.external_shuffle(table.limit(0), 40).collect() == []


# conversation repair


def plain_repair(rows):
    """Cheapest, then ASCII-least edits of judged rows (role, text, must go, extra), by trying all states row by row."""
    ways = {"": (0, "", ())}

    def better(found, phase, way):
        if phase is not None and (phase not in found or way[:2] < found[phase][:2]):
            found[phase] = way

    def inserted(ways):
        for _ in range(4):
            for phase, (c, a, t) in list(ways.items()):
                role = "assistant" if phase == "u" else "user"
                better(ways, role[0], (c + 3, a + "I", (*t, role + ":")))
        return ways

    may = {"": "su", "s": "u", "u": "a", "a": "u"}
    for role, text, must_go, extra in rows:
        found = {}
        for phase, (c, a, t) in inserted(ways).items():
            better(found, phase, (c + 4, a + "D", t))
            if must_go:
                continue
            if role[:1] and role[:1] in may[phase]:
                better(found, role[:1], (c + extra, a + "K", (*t, f"{role}:{text}")))
            other = "assistant" if phase == "u" else "user"
            better(found, other[0], (c + 3 + extra, a + "R", (*t, f"{other}:{text}")))
        ways = found
    return min((w for p, w in inserted(ways).items() if p in ("", "a")), key=lambda w: w[:2])


def plain_digest(turns):
    """turns: (turn, role, text) of one conversation as it is to be repaired."""
    rows = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] if r[1] is not None else " ").encode(), (r[2] if r[2] is not None else " ").encode()))
    seen, judged, count, before, illegal = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}, None, 0
    for _, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        illegal += before is not None and before + role[:1] not in ("su", "ua", "au")
        before = role[:1]
        judged.append((role, text, fault in ("blank", "duplicate"), 3 if fault == "truncated" else 0))
    cost, audit, lines = plain_repair(judged)
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def random_turns(rng, n):
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None, "umpire"]
    texts = ["Yes.", "No!", "Why?", "cut off", "  ", "", None, "A. \n", "a \t", "more", "é漢?"]
    return [(rng.choice([i, i, i, i + 3, None, i // 2]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randrange(10**6)}{rng.choice(['.', '', '!'])}") for i in range(n)]


@pytest.mark.parametrize("piece", [2, 7, 128])
def test_repair_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    rng = random.Random(piece)
    turns = {c: random_turns(rng, rng.choice([1, 2, 3, 5, 8, 20])) for c in [None, *range(120)]}
    turns[500] = random_turns(rng, 300)
    table = spark.createDataFrame([(c, *t) for c, rows in turns.items() for t in rows], "conv_id long, turn long, role string, text string").withColumn("key", F.lit("x")).withColumn("i", F.lit(1))
    found = repair.repair_digests(repair.repair_conversations(table), table).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == {c: plain_digest(rows) for c, rows in turns.items()} and len(found) == len(turns)


def test_auction_costs_between_phases():
    rng = random.Random(3)
    for _ in range(60):
        codes = "".join(rng.choice("suaSUAx-_") for _ in range(rng.randrange(1, 6)))
        costs = repair.between(codes)
        for start in range(4):
            dist = {(0, start): 0}
            for _ in range(40):  # Bellman-Ford
                for (i, p), d in list(dist.items()):
                    if i < len(codes):
                        for _, cost, j, q in repair.arcs_from(codes, i, p, [0] * 4):
                            dist[j, q] = min(dist.get((j, q), 10**9), d + cost)
            assert [dist.get((len(codes), q)) for q in range(4)] == costs[4 * start : 4 * start + 4]


def test_edits_are_the_repaired_conversation(spark):
    table = spark.createDataFrame([(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "assistant", "A.")], "conv_id long, turn long, role string, text string")
    rows = repair.repair_conversations(table).orderBy("step").collect()
    assert [(r.edit, r.fault, r.turn, r.old_role, r.role, r.text, r.cost) for r in rows] == [
        ("K", None, 0, "system", "system", "S.", 7), ("I", None, None, None, "user", "", 7), ("K", None, 1, "assistant", "assistant", "A.", 7), ("D", "duplicate", 2, "assistant", None, None, 7)]


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(10)] + [(None, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = []
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = "user" if fate == 4 else role or " ", text or " "
        text = {1: "", 2: text.translate({46: None, 33: None, 63: None})}.get(fate, text)
        plain += [(c, t, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    assert sorted(map(repr, map(tuple, repair.damage(table).collect()))) == sorted(map(repr, plain))


def test_tricky_rows(spark, tricky):
    sql = duckdb.connect()
    for name in ("conversations", "embeddings"):
        sql.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tricky}/{name}.parquet/*.parquet'")
    for name in ("op11_hard_negatives", "op13_structure_repair"):
        found, out = QUERIES[name](spark, tricky), sql.sql(ORACLE_SQL[name])
        assert normal([tuple(r) for r in found.collect()], found.columns) == normal(out.fetchall(), out.columns), name
