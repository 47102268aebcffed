"""Faults of conversations, and the cheapest repair of each, by a scan of min-plus matrices.

Rows of a conversation go by turn (nulls first), rows of one turn by role, the first letters and a hash of their text,
repeated rows side by side.  The first fault of a row counts: blank (nothing but blanks), duplicate (role and text
stood earlier in the conversation), truncated (the last character that is no blank is none of . ! ?).  Edits: Keep
costs 0, Rerole to user or assistant 1, Delete 2 (the only one for blank and duplicate rows), Insert of an empty user
or assistant row anywhere 5; a truncated row that is not deleted adds 5.  Initials of the roles that are left are an
optional s, then pairs of u and a, or nothing; of the cheapest ways the one whose edits' initials come first counts.

The roles left so far are in one of four states: nothing, s, after u, after a.  What a row does is a 4 x 4 matrix: the
entry from p to q is the cheapest (cost, audit) that leads from p to q by inserts, then the row.  Such matrices multiply
by the least sum, audits joined, and that is associative: audits of equal cost differ by their number of inserts only
if they differ in the rest too, so that none is the beginning of another.  A conversation's rows may lie in several
range partitions; each gives one matrix, a tree of products over its rows.  Across partitions only costs and the order
of the audits move: an audit is one letter there, its rank among its matrix's own.  Each partition's part of the
cheapest path then is the audit of that rank.

The repaired rows are written by a stream over each conversation's rows in order, which holds a batch at a time.  The
hash of a conversation is one number over all its rows in order, so that one task reads a conversation to the end,
though it holds nothing of it but the audit.

Null roles and texts count as one space, a role without letters is one of the roles that cannot be kept, a null
conversation id is an id like others.  An empty table gives no row.
Rows of turns that are repeated are rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import lean, small_batches, stored

BLANKS = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: States of the roles left so far, and what a user's and an assistant's row lead to.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Kinds of a row: the initial of its role (. for any other) by what may be done with it.
INITIALS, FREE, CUT, DEAD = "sua.", 0, 1, 2
LETTERS = "ABCDEFGHIJKL"
#: Rows whose product is remembered as a whole.
SHORT = 12

Matrix = tuple  # 16 entries, (cost, audit) or None, from state p to state q at 4 * p + q


def least(a, b):
    return b if a is None or b is not None and b < a else a


def times(x: Matrix, y: Matrix) -> Matrix:
    out = [None] * 16
    for i, a in enumerate(x):
        if a is None:
            continue
        p, r = divmod(i, 4)
        for q in range(4):
            b = y[4 * r + q]
            if b is None:
                continue
            held, cost = out[4 * p + q], a[0] + b[0]
            if held is None or cost < held[0] or cost == held[0] and a[1] + b[1] < held[1]:
                out[4 * p + q] = (cost, a[1] + b[1])
    return tuple(out)


def _closure() -> Matrix:
    """What inserts alone lead to: none, one, or a pair."""
    one = [(0, "") if i % 5 == 0 else None for i in range(16)]
    for initial in "ua":
        for p, q in STEPS[initial].items():
            one[4 * p + q] = least(one[4 * p + q], (INSERT, "I"))
    return times(tuple(one), tuple(one))


INSERTS = _closure()


def _row(kind: int) -> Matrix:
    initial, fault = INITIALS[kind // 3], kind % 3
    own = [(DELETE, "D") if i % 5 == 0 else None for i in range(16)]
    extra = TRUNCATED if fault == CUT else 0
    edits = [] if fault == DEAD else [(initial, extra, "K"), ("u", extra + REROLE, "R"), ("a", extra + REROLE, "R")]
    for to, cost, letter in edits:
        for p, q in STEPS.get(to, {}).items():
            own[4 * p + q] = least(own[4 * p + q], (cost, letter))
    return times(INSERTS, tuple(own))


ROWS = {letter: _row(i) for i, letter in enumerate(LETTERS)}
UNIT: Matrix = tuple((0, "") if i % 5 == 0 else None for i in range(16))


def tree(own: list[Matrix]) -> Matrix:
    """Product of matrices in order, by pairs of neighbours."""
    while len(own) > 1:
        own = [times(*own[i : i + 2]) if i + 1 < len(own) else own[i] for i in range(0, len(own), 2)]
    return own[0] if own else UNIT


@lru_cache(200_000)
def _short(kinds: str) -> Matrix:
    return tree([ROWS[k] for k in kinds])


def product(kinds: str) -> Matrix:
    return tree([_short(kinds[i : i + SHORT]) for i in range(0, len(kinds), SHORT)])


def cheapest(whole: Matrix):
    """The best (cost, audit) from nothing to an allowed end, inserts at the end included."""
    ends = times(whole, INSERTS)
    return least(ends[NOTHING], ends[ASSISTANT])


def ranks(own: Matrix) -> tuple[list[str], list[int]]:
    """A matrix's audits in order, and of each entry its audit's place there; -1 where there is none."""
    audits = sorted({x[1] for x in own if x is not None})
    place = {a: i for i, a in enumerate(audits)}
    return audits, [-1 if x is None else place[x[1]] for x in own]


@lru_cache(200_000)
def illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


# ---------------------------------------------------------------- rows in order


def _initials(kinds: str) -> str:
    return "".join(INITIALS[LETTERS.index(k) // 3] for k in kinds)


def ordered(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, at (the place in the order of all rows), seg (the range partition), stored."""
    c = F.col
    text = F.coalesce("text", F.lit(" "))
    out = rows.select(c("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.substring(text, 1, 32).alias("head"), F.xxhash64(text).alias("mark"), F.monotonically_increasing_id().alias("tie"))
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "head", "mark", "tie"]
    out = out.repartitionByRange(*order).sortWithinPartitions(*order)
    out = out.select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("at"))
    return stored(out.withColumn("seg", F.shiftright("at", 33)), "turns")


def judged(turns: DataFrame) -> DataFrame:
    """conv, turn, seg, at, fault (blank, duplicate, truncated or null) and kind of every row; no text moves."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    same = [F.xxhash64("conv", "role", "text"), F.xxhash64(F.lit(1), "conv", "role", "text")]
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS[:3]), F.substring("role", 1, 1)), F.lit(0)), F.lit(4))
    initial = F.when(F.substring("role", 1, 1) == "", 4).otherwise(initial) - 1
    rows = turns.select("conv", "turn", "seg", "at", same[0].alias("h"), same[1].alias("g"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"), initial.alias("initial"))
    first = rows.groupBy("h", "g").agg(F.min("at").alias("first"))
    rows = rows.join(first, ["h", "g"])
    fault = F.when(F.col("blank"), "blank").when(F.col("at") > F.col("first"), "duplicate").when(F.col("cut"), "truncated")
    level: Column = F.when(fault.isin("blank", "duplicate"), DEAD).when(fault == "truncated", CUT).otherwise(FREE)
    kind = F.substring(F.lit(LETTERS), (F.col("initial") * 3 + level + 1).cast("int"), F.lit(1))
    return rows.select("conv", "turn", "seg", "at", fault.alias("fault"), kind.alias("kind"))


def parts(rows: DataFrame) -> DataFrame:
    """A row for each conversation and range partition: conv, seg, illegal, first, last, costs, ranks, audits."""
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "kind"))), lambda x: x["kind"]), "")
    texts = rows.groupBy("conv", "seg").agg(kinds.alias("kinds"))
    schema = T.StructType([rows.schema["conv"]]).add("seg", "long").add("illegal", "long").add("first", "string").add("last", "string").add("costs", T.ArrayType(T.LongType())).add("ranks", T.ArrayType(T.IntegerType())).add("audits", T.ArrayType(T.StringType()))

    def run(batches):
        for batch in batches:
            own = [product(k) for k in batch.column("kinds").to_pylist()]
            initials = [_initials(k) for k in batch.column("kinds").to_pylist()]
            listed = [ranks(m) for m in own]
            arrays = [
                batch.column("conv"), batch.column("seg"), pa.array(map(illegal, initials), pa.int64()), pa.array([x[0] for x in initials], pa.string()), pa.array([x[-1] for x in initials], pa.string()),
                pa.array([[-1 if x is None else x[0] for x in m] for m in own], pa.list_(pa.int64())), pa.array([r for _, r in listed], pa.list_(pa.int32())), pa.array([a for a, _ in listed], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return small_batches(texts).mapInArrow(lean(run), schema)


def resolve(segments: list[dict]) -> tuple[int, int, list[int], str]:
    """cost, illegal, the rank of the audit of each segment, inserts at the end: for a conversation's segments in order."""
    matrices = [tuple(None if r < 0 else (c, LETTERS_OF_RANKS[r]) for c, r in zip(s["costs"], s["ranks"], strict=True)) for s in segments]
    cost, path = cheapest(tree(matrices))
    between = "".join(a["last"] + b["first"] + "|" for a, b in zip(segments, segments[1:], strict=False))
    bad = sum(s["illegal"] for s in segments) + sum(pair not in ("su", "ua", "au") for pair in between.split("|")[:-1])
    return cost, bad, [LETTERS_OF_RANKS.index(x) for x in path[: len(segments)]], path[len(segments) :]


LETTERS_OF_RANKS = "abcdefghijklmnop"


def resolved(summaries: DataFrame) -> DataFrame:
    """conv, seg, rank, tail, cost, illegal for each segment; tail, cost and illegal stand at a conversation's last."""
    fields = F.struct("seg", "illegal", "first", "last", "costs", "ranks")
    # a conversation has a segment a partition at most
    whole = summaries.groupBy("conv").agg(F.array_sort(F.collect_list(fields)).alias("segments"))
    schema = T.StructType([summaries.schema["conv"]]).add("seg", "long").add("rank", "integer").add("tail", "string").add("cost", "long").add("illegal", "long")

    def run(batches):
        for batch in batches:
            at, out = [], []
            for i, segments in enumerate(batch.column("segments").to_pylist()):
                cost, bad, picked, tail = resolve(segments)
                for j, (s, r) in enumerate(zip(segments, picked, strict=True)):
                    end = j == len(segments) - 1
                    at.append(i)
                    out.append((s["seg"], r, tail if end else "", cost if end else None, bad if end else None))
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            columns = [pa.array([x[j] for x in out], t) for j, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("conv").take(pa.array(at, pa.int64())), *columns], names=schema.names)

    return small_batches(whole).mapInArrow(lean(run), schema)


# ---------------------------------------------------------------- repaired rows


def _stream(turns: DataFrame, pieces: DataFrame) -> DataFrame:
    """All rows of a conversation one after the other, each segment's audit before its rows."""
    audits = pieces.select("conv", "seg", F.lit(-1).cast("long").alias("at"), F.col("piece").alias("role"), F.lit(None).cast("string").alias("text"))
    rows = turns.select("conv", "seg", "at", "role", "text").unionByName(audits)
    return rows.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "seg", "at")


def _events(batches):
    """(conv, edit, role, text) of each edit in order; at a new segment (conv, None, its audit, None)."""
    state, audit, at, conv, known = NOTHING, "", 0, None, False

    def inserts(upto):
        nonlocal state, at
        while at < upto and audit[at] == "I":
            state = STEPS["a"][state] if state == USER else STEPS["u"][state]
            at += 1
            yield conv, "I", "user" if state == USER else "assistant", ""

    for batch in batches:
        for own, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "at", "role", "text")), strict=True):
            if place < 0:
                yield from inserts(len(audit))
                if not known or own != conv:
                    state, conv, known = NOTHING, own, True
                audit, at = role, 0
                yield conv, None, audit, None
                continue
            yield from inserts(len(audit))
            edit = audit[at]
            at += 1
            if edit == "K":
                state = STEPS[role[0]][state]
            elif edit == "R":
                state = ASSISTANT if state == USER else USER
                role = "user" if state == USER else "assistant"
            yield conv, edit, role, text
    yield from inserts(len(audit))


class Repair:
    """The repair of every conversation of rows (conv_id, turn, role, text)."""

    def __init__(self, rows: DataFrame):
        self.turns = ordered(rows)
        self.rows = stored(judged(self.turns), "kinds")
        segments = stored(parts(self.rows), "segments")
        self.resolved = stored(resolved(segments.drop("audits")), "paths")
        picked = self.resolved.alias("p").join(segments.alias("s"), F.col("p.conv").eqNullSafe(F.col("s.conv")) & (F.col("p.seg") == F.col("s.seg")))
        self.pieces = picked.select("p.conv", "p.seg", F.concat(F.element_at("s.audits", F.col("p.rank") + 1), "p.tail").alias("piece"))

    def faults(self) -> DataFrame:
        """conv, gaps, blank, duplicate, truncated, illegal, cost."""
        n = lambda kind: F.count_if(F.col("fault") == kind).alias(kind)
        span = F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), F.lit(1).cast("long"))
        turns = self.rows.groupBy("conv").agg(span.alias("span"), F.count_distinct("turn").alias("distinct"), n("blank"), n("duplicate"), n("truncated"))
        gaps = F.when(F.col("distinct") == 0, F.lit(0).cast("long")).otherwise(F.col("span") - F.col("distinct"))
        ends = self.resolved.where("cost IS NOT NULL").select(F.col("conv").alias("own"), "illegal", "cost")
        both = turns.join(ends, F.col("conv").eqNullSafe(F.col("own")))
        return both.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost")

    def repaired(self) -> DataFrame:
        """conv_id, position (from 1), edit, role, text: the rows that are left, in order."""
        schema = T.StructType([T.StructField("conv_id", self.turns.schema["conv"].dataType)]).add("position", "long").add("edit", "string").add("role", "string").add("text", "string")

        def run(batches):
            conv, position, known, out = None, 0, False, []
            for own, edit, role, text in _events(batches):
                if not known or own != conv:
                    conv, position, known = own, 0, True
                if edit is not None and edit != "D":
                    position += 1
                    out.append((own, position, edit, role, text))
                if len(out) >= 1000:
                    yield _batch(out, schema)
                    out = []
            yield _batch(out, schema)

        return small_batches(_stream(self.turns, self.pieces)).mapInArrow(lean(run), schema)

    def digests(self) -> DataFrame:
        """conv, audit, repaired_sha256 (of the rows left, role:text, one a line)."""
        schema = T.StructType([self.turns.schema["conv"]]).add("audit", "string").add("repaired_sha256", "string")

        def run(batches):
            conv, known, audit, sha, any_row, out = None, False, [], None, False, []
            for own, edit, role, text in _events(batches):
                if not known or own != conv:
                    if known:
                        out.append((conv, "".join(audit), sha.hexdigest()))
                    conv, known, audit, sha, any_row = own, True, [], hashlib.sha256(), False
                if edit is None:
                    audit.append(role)
                elif edit != "D":
                    sha.update((("\n" if any_row else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    any_row = True
                if len(out) >= 1000:
                    yield _batch(out, schema)
                    out = []
            if known:
                out.append((conv, "".join(audit), sha.hexdigest()))
            yield _batch(out, schema)

        return small_batches(_stream(self.turns, self.pieces)).mapInArrow(lean(run), schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(schema)], names=schema.names)


# ---------------------------------------------------------------- the query


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults that their ids and turns choose: dropped, emptied, cut, repeated or given to the user."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    role = F.when(code == 4, "user").otherwise(one("role"))
    copies = F.when(code == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.where(code != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def repair_digest(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of rows,
    damaged first.  One that has no rows left counts as empty."""
    repair = Repair(damaged(rows))
    every = rows.select("conv_id").distinct()
    faults, digests = repair.faults(), repair.digests()
    out = every.join(faults, every["conv_id"].eqNullSafe(faults["conv"]), "left").drop("conv")
    out = out.join(digests, out["conv_id"].eqNullSafe(digests["conv"]), "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    present = F.col("cost").isNotNull()
    gaps = F.when(present, F.col("gaps")).otherwise(F.lit(0).cast("long")).alias("gaps")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", gaps, *map(count, ("blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
