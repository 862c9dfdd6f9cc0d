"""Conversation structure repair: the cheapest edits that make a conversation (system)? (user assistant)+, or empty.

The rows of a conversation and the part of the pattern that has been written so far span a lattice: a node is (rows read,
phase), arcs are the edits. Keep costs 0, Rerole (to user or assistant) 3, Delete 4, Insert (of an empty user or assistant
turn) 3; blank and duplicate rows must be deleted, truncated ones that stay cost 3 more. The cheapest way through is
found by the auction algorithm: a price at each node, a path that is extended along an arc whose cost and end's price make
up its start's price, and contracted, with its end's price raised, where there is none. Prices start at what the rows left
cost at least, so they stay below the true costs and meet them along the path. With converged prices an arc is tight
exactly where some cheapest way may take it; the result is the ASCII-least sequence of edits along tight arcs, so that of
equally cheap repairs the same one is always chosen. Edits and their letters decide the written row, so it is unique too.

A conversation is numbered over ranges of the sorted table and cut into pieces of PIECE rows, so that a very long one
is worked on by many tasks: each piece but the first gets the costs between its ends from auctions of its own; one pass
backwards over the pieces (four numbers a piece) gives what follows each piece, which are its end's prices; then each
piece has its edits for each phase in which it may be entered, and one pass forwards picks them. Only these two passes see
a whole conversation; they read one small row a piece, stream and hold one piece at a time.

Faults, the first that holds: blank (no character but white space), duplicate (role and text as in an earlier row of the
conversation), truncated (the last character but white space is none of `.!?`).

Defined cases: rows are taken by turn, nulls first, and within a turn by role and text; a null role or text is one space;
a null conversation id is a conversation of its own; roles count by their first character; further columns don't
matter; an empty table gives no rows, and conversations that are mended to nothing have edits D only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import with_ordinal
from .common import staged, text_blocks

#: Costs of the edits; what a truncated row costs that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a conversation that one auction sees.
PIECE = 128
#: Phases: nothing written, a system turn, a user turn, an assistant turn as the last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The phase that an inserted or reroled row leads to, and its role.
NEXT = (USER, USER, ASSISTANT, USER)
WRITES = {USER: "user", ASSISTANT: "assistant"}
#: What may follow the last row: the cost, and the inserts.
ENDS = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
#: Phases from which a row may be kept, by its role's first character, and where that leads.
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: White space of the contracts, for SQL's trim.
_SPACE = " \t\n\x0b\x0c\r"
#: A row as one letter for the auctions: its role's first character (s, u, a; - for others), s, u and a as capitals and - as _
#: where it is truncated; x where it must go.
MUST_GO, OTHER, OTHER_TRUNCATED = "x", "-", "_"


def arcs_from(codes: str, i: int, phase: int, after: list[int | None]) -> list[tuple[str, int, int, int]]:
    """(edit, cost, rows read, phase) of the arcs that leave a node, in the edits' ASCII order; the end is (len(codes) + 1, 0)."""
    if i == len(codes):
        return [] if after[phase] is None else [("", after[phase], i + 1, 0)]
    code, out = codes[i], [("D", DELETE, i + 1, phase), ("I", INSERT, i, NEXT[phase])]
    if code != MUST_GO:
        extra = TRUNCATED if code.isupper() or code == OTHER_TRUNCATED else 0
        if (to := KEEPS.get(code.lower(), {}).get(phase)) is not None:
            out.append(("K", extra, i + 1, to))
        out.append(("R", REROLE + extra, i + 1, NEXT[phase]))
    return out


def _least(code: str) -> int:
    """What a row costs at least."""
    if code == MUST_GO:
        return DELETE
    return min(DELETE, (REROLE if code in (OTHER, OTHER_TRUNCATED) else 0) + (TRUNCATED if code.isupper() or code == OTHER_TRUNCATED else 0))


class Auction:
    """Prices over a piece's lattice, for what follows its end in each phase (None: that phase can't end it)."""

    def __init__(self, codes: str, after: list[int | None]):
        self.codes, self.after = codes, after
        known = [a for a in after if a is not None]
        least, never = min(known), max(known) + 8 * (len(codes) + 4)  # dearer than any way
        self.price = [[0] * 4 for _ in range(len(codes) + 2)]
        self.price[len(codes)] = [never if a is None else a for a in after]
        hopeless = [all(a is None for a in after[lowest:]) for lowest in (START, SYSTEM, USER, USER)]
        for i in range(len(codes) - 1, -1, -1):
            least += _least(codes[i])
            self.price[i] = [never if h else least for h in hopeless]

    def cost(self, phase: int) -> int:
        """The cheapest way from a phase before the first row; there must be one."""
        price, end = self.price, len(self.codes) + 1
        path = [(0, phase)]
        while path[-1][0] != end:
            i, now = path[-1]
            ways = [(cost + price[j][then], (j, then)) for _, cost, j, then in arcs_from(self.codes, i, now, self.after)]
            best, to = min(ways, default=(price[i][now] + 1, None))
            if price[i][now] < best:  # contraction
                price[i][now] = best
                if len(path) > 1:
                    path.pop()
            else:  # extension
                path.append(to)
        return price[0][phase]

    def edits(self, phase: int) -> tuple[str, int]:
        """The ASCII-least edits along tight arcs from a phase whose cost has been found, and the phase at the piece's end."""
        dead: set[tuple[int, int]] = set()
        trail = [("", (0, phase), iter(self._tight(0, phase)))]
        while True:
            _, (i, now), options = trail[-1]
            if i == len(self.codes) and next(options, None):
                return "".join(letter for letter, _, _ in trail), now
            for letter, _, j, then in options:
                if (j, then) not in dead:
                    trail.append((letter, (j, then), iter(self._tight(j, then))))
                    break
            else:
                dead.add((i, now))
                trail.pop()

    def _tight(self, i: int, phase: int) -> list[tuple[str, int, int, int]]:
        return [a for a in arcs_from(self.codes, i, phase, self.after) if a[1] + self.price[a[2]][a[3]] == self.price[i][phase]]


def between(codes: str) -> list[int | None]:
    """Costs from each phase before a piece (major) to each phase behind it; None where there is no way."""
    out: list[int | None] = [None] * 16
    for to in range(4):
        auction = Auction(codes, [0 if p == to else None for p in range(4)])
        for start in range(4):
            if to in (USER, ASSISTANT) or to == start or (start == START and to == SYSTEM and "s" in codes.lower()):
                out[4 * start + to] = auction.cost(start)
    return out


def _lists(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs = [between(codes) if piece else None for piece, codes in _lists(batch, "piece", "codes")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs, pa.list_(pa.int64()))], [*batch.schema.names, "costs"])


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of whole conversations, the last first: what follows each of them, by phase."""
    after: list[int | None] = []
    for batch in batches:
        out = []
        for last, costs in _lists(batch, "last", "costs"):
            if last:
                after = [cost for cost, _ in ENDS]
            out.append(after)
            if costs:
                after = [min(c + a for c, a in zip(costs[4 * p : 4 * p + 4], after, strict=True) if c is not None) for p in range(4)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "piece", "last", "codes")), pa.array(out, pa.list_(pa.int64()))], ["key", "piece", "last", "codes", "after"])


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each phase in which a piece may be entered: the cost from there, the edits, the phase behind it."""
    for batch in batches:
        out = []
        for piece, codes, after in _lists(batch, "piece", "codes", "after"):
            auction = Auction(codes, after)
            found = []
            for phase in range(4) if piece else [START]:
                cost = auction.cost(phase)
                found.append((cost, *auction.edits(phase)))
            out.append([dict(zip(("cost", "edits", "to"), x, strict=True)) for x in found])
        kind = pa.list_(pa.struct([("cost", pa.int64()), ("edits", pa.string()), ("to", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "piece", "last")), pa.array(out, kind)], ["key", "piece", "last", "choices"])


def _forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of whole conversations in order: the phase each is entered in, its edits and the number of those before them."""
    phase = step = cost = 0
    for batch in batches:
        out = []
        for piece, choices in _lists(batch, "piece", "choices"):
            if not piece:
                phase, step, cost = START, 0, choices[0]["cost"]
            chosen = choices[phase if piece else 0]
            out.append((phase, step, cost, chosen["edits"]))
            phase, step = chosen["to"], step + len(chosen["edits"])
        phases, steps, costs, edits = zip(*out, strict=True) if out else ((),) * 4
        arrays = [pa.array(phases, pa.int32()), pa.array(steps, pa.int64()), pa.array(costs, pa.int64()), pa.array(edits, pa.string())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "piece", "last")), *arrays], ["key", "piece", "last", "phase", "step", "cost", "edits"])


#: Columns of the edits besides conv_id.
EDITS = {"step": "long", "edit": "string", "fault": "string", "turn": "long", "old_role": "string", "role": "string", "text": "string", "cost": "long"}


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's edits, then its rows, in order: a row for each edit."""
    phase = step = cost = left = 0
    last, letters = False, iter("")
    for batch in text_blocks(batches):
        out: list[tuple] = []
        for at, r in enumerate(batch.drop_columns(["conv_id", "key"]).to_pylist()):
            if r["edits"] is not None:
                phase, step, cost, last, letters = r["phase"], r["step"], r["cost"], r["last"], iter(r["edits"])
                left = sum(letter != "I" for letter in r["edits"])
                continue
            left -= 1
            edits = []
            for letter in letters:
                edits.append(letter)
                if letter != "I":
                    break
            for letter in edits if left or not last else [*edits, *_ending(edits, phase, r["role"])]:
                read, role, text = letter != "I", None, None
                if letter == "K":
                    phase, role, text = KEEPS[r["role"][:1]][phase], r["role"], r["text"]
                elif letter != "D":
                    phase = NEXT[phase]
                    role, text = WRITES[phase], r["text"] if read else ""
                out.append((at, step, letter, r["fault"] if read else None, r["turn"] if read else None, r["role"] if read else None, role, text, cost))
                step += 1
        at, *columns = zip(*out, strict=True) if out else ((),) * 9
        kinds = {"long": pa.int64(), "string": pa.string()}
        yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(pa.array(at, pa.int64())), *(pa.array(v, kinds[k]) for v, k in zip(columns, EDITS.values(), strict=True))], ["conv_id", *EDITS])


def _ending(edits: list[str], phase: int, role: str) -> str:
    """What is inserted behind the last row, after its edits."""
    for letter in edits:
        phase = KEEPS[role[:1]][phase] if letter == "K" else phase if letter == "D" else NEXT[phase]
    return ENDS[phase][1]


def _key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, step, edit (K, R, D or I), fault, turn, old_role, role, text and the conversation's cost, for each edit.

    By step, rows that have a role are the repaired conversation; deleted ones have none, inserted ones no turn and old_role.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))]
    rows = turns.select(F.col(conv_col).alias("conv_id"), _key(F.col(conv_col)).alias("key"), F.col(turn_col).cast("long").alias("turn"), *said)
    kind = rows.schema["conv_id"].dataType.simpleString()
    placed = staged(with_ordinal(rows.withColumn("tie", F.monotonically_increasing_id()), "turn", "role", "text", "tie", by=["key"]).withColumn("same", F.sha2("text", 256)), "turns")
    seen = staged(placed.groupBy("key", "role", "same").agg(F.count("*").alias("n"), F.min("i").alias("first")).where("n > 1").drop("n"), "seen")
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    fault = F.when(bare == "", "blank").when(F.col("i") > F.col("first"), "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    cut = F.col("fault").eqNullSafe("truncated")
    initial = F.left("role", F.lit(1))
    code = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(initial.isin(*KEEPS), F.when(cut, F.upper(initial)).otherwise(initial)).when(cut, OTHER_TRUNCATED).otherwise(OTHER)
    judged = placed.join(seen, ["key", "role", "same"], "left").withColumn("fault", fault).withColumn("piece", F.expr(f"i DIV {PIECE}"))
    judged = staged(judged.withColumn("code", code).select("conv_id", "key", "piece", "i", "turn", "role", "text", "fault", "code"), "judged")

    letters = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "code"))), lambda x: x["code"]), "")
    pieces = staged(judged.groupBy("key", "piece").agg(letters.alias("codes")), "pieces")
    ends = pieces.groupBy("key").agg(F.max("piece").alias("end"))
    costs = pieces.join(ends, "key").select("key", "piece", (F.col("piece") == F.col("end")).alias("last"), "codes").mapInArrow(_costs, "key string, piece long, last boolean, codes string, costs array<long>")
    after = costs.repartition("key").sortWithinPartitions("key", F.desc("piece")).mapInArrow(_backwards, "key string, piece long, last boolean, codes string, after array<long>")
    choices = after.repartition("key", "piece").mapInArrow(_choices, "key string, piece long, last boolean, choices array<struct<cost: long, edits: string, to: int>>")
    chosen = choices.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(_forwards, "key string, piece long, last boolean, phase int, step long, cost long, edits string")
    chosen = staged(chosen, "chosen")

    both = judged.drop("code").unionByName(chosen, allowMissingColumns=True)
    both = both.repartition("key", "piece").sortWithinPartitions("key", "piece", F.col("i").asc_nulls_first())
    return both.mapInArrow(_write, f"conv_id {kind}, " + ", ".join(f"{n} {k}" for n, k in EDITS.items()))


#: What a conversation's edits come to.
DIGEST = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string", "repaired_sha256": "string"}


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of whole conversations in order: one row each; texts are hashed as they pass."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    done: list[tuple] = []
    ids: list[pa.Array] = []
    key, audit, tally, digest, turns, before = None, [], {}, None, None, None

    def close() -> None:
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
        done.append((gaps, tally["blank"], tally["duplicate"], tally["truncated"], tally["illegal"], tally["cost"], "".join(audit), digest.hexdigest()))

    def out() -> pa.RecordBatch:
        columns = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array(v, kinds[k]) for v, k in zip(columns, DIGEST.values(), strict=True))], ["conv_id", *DIGEST])

    for batch in text_blocks(batches):
        for at, r in enumerate(batch.drop_columns(["conv_id"]).to_pylist()):
            if r["key"] != key:
                if key is not None:
                    close()
                key, audit, digest, turns, before = r["key"], [], hashlib.sha256(), None, None
                tally = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0) | {"cost": r["cost"]}
                mark, said = batch.column("conv_id").slice(at, 1), False
                ids.append(pa.concat_arrays([mark]))
            audit.append(r["edit"])
            if r["role"] is not None:
                digest.update(("\n" * said + f"{r['role']}:{r['text']}").encode())
                said = True
            if r["old_role"] is None:
                continue
            if r["fault"]:
                tally[r["fault"]] += 1
            pair = (before, r["old_role"][:1])
            tally["illegal"] += before is not None and pair not in LEGAL
            before = r["old_role"][:1]
            if r["turn"] is not None:
                turns = (min(turns[0], r["turn"]), r["turn"], turns[2] + (turns[1] != r["turn"])) if turns else (r["turn"], r["turn"], 1)
        if len(done) >= 1024:
            pending = ids.pop()
            yield out()
            done, ids = [], [pending]
    if key is not None:
        close()
        yield out()


#: Initials that may follow each other.
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def repair_digests(edits: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id and the DIGEST columns for every id among `conversations`, zeros and the hash of nothing where there are no edits.

    A hash over a conversation needs its rows in order, so here one task reads all of a conversation; it holds one block of it.
    """
    kind = edits.schema["conv_id"].dataType.simpleString()
    keyed = edits.withColumn("key", _key(F.col("conv_id"))).repartition("key").sortWithinPartitions("key", "step")
    found = keyed.mapInArrow(_digest, f"conv_id {kind}, " + ", ".join(f"{n} {k}" for n, k in DIGEST.items())).withColumn("_key", _key(F.col("conv_id"))).drop("conv_id")
    every = conversations.select("conv_id").distinct().withColumn("_key", _key(F.col("conv_id")))
    nothing = {n: F.lit(0).cast("long") for n in DIGEST} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return every.join(found, "_key", "left").select("conv_id", *(F.coalesce(F.col(n), nothing[n]).alias(n) for n in DIGEST))


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of damaged conversations (nulls: one space), by crc32 of `conv_id:turn` modulo 20.

    0 drops the row, 1 empties its text, 2 takes out `.!?`, 3 repeats it, 4 makes its role user.
    """
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")
