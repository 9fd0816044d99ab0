"""Conversation structure repair: the cheapest edits that give (system)? (user assistant)+, or nothing.

Turns are kept (0), reroled to user or assistant (3), deleted (4; blank and repeated turns
must go), and empty turns inserted (3); a truncated turn that stays costs 3 more.  What is
retained is a subsequence of turns, kept or reroled.  Between two retained turns all
others are deleted, at a price that is a difference of prefix sums, and the pair of roles
says how many turns must be inserted: u-u, a-a, s-a and a start before a need one, an end
after u one, an end after s two.  So a retained turn costs its own price, the inserts for
the pair, and the least of (cost of the last retained turn - deletions up to it) over
earlier turns of each role, a running minimum for each of four states: nothing yet, s, u, a.

Ties go to the ASCII-least audit, the initials of the edits in order.  In a gap deletions
come before insertions, then.  The audits of two states never are equal, nor one the
beginning of the other (after the same turns they have as many letters that aren't I, the
last letter among them), so their order is a rank of 0 to 3 and no audit is built to compare.

A stretch of turns acts on the states as a matrix of costs and ranks, and matrices are
multiplied: turns are cut into blocks of BLOCK places in the order of (conversation,
turn).  A conversation that reaches over blocks has its matrices made block by block, in
any tasks, and combined, which gives each block the states that it starts and ends in;
then every block is repaired by itself.  Steps recur, so each is worked out once in a task
and kept (_Machine).  A task holds a block of turns without texts, and
a conversation's edits only in its audit.

Defined cases: turns are ordered null first, ties by role and by a hash of the text.  A
null role or text is one space.  An empty role has no initial: it fits nowhere.  A
null conv_id is a conversation of its own.  The roles of kept turns are those whose
initial is s, u or a; turns of other roles are reroled or deleted.  Repeated rows are turns
that repeat.  Texts of any length count whole.  Other columns are ignored, whatever their
names.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from .common import SPACES, spool, unspool
from .sql import CRC_TABLE, crc32

#: Turns of a block.
BLOCK = 20_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing retained yet, and the role retained last.
NOTHING, S, U, A = range(4)
#: Turns to insert before a retained u or a by the state before it, and at the end.
BEFORE = {U: (0, 0, 1, 0), A: (1, 1, 0, 1)}
AT_END = (0, 2, 1, 0)
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
_EMPTY = hashlib.sha256(b"").hexdigest()
_NAMES = {U: "user", A: "assistant"}


def damaged(chats: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of chats, one row in four damaged by the checksum of `conv_id:turn`."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    rows = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("_k")).where("_k <> 0")
    rows = rows.withColumn("_copy", F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def _last_character(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(" " + SPACES)), F.lit(1))


def _placed(chats: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, role, text, state (of its initial), fault (but for duplicates), h (a hash of conversation, role and text), _place and _block."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    rows = chats.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    h = F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.octet_length("role"), "role", "text").cast("binary"))
    initial = F.left("role", F.lit(1))
    state = F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(NOTHING)
    last = _last_character(F.col("text"))
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(CUT_OFF)
    rows = rows.select("*", state.cast("int").alias("state"), fault.cast("int").alias("fault"), h.alias("h"))
    placed = ranked(rows, ["conv_id", F.col("turn").asc_nulls_first(), "role", "h"], "_place", name="repair-turns")
    out = placed.withColumn("_block", F.expr(f"_place div {BLOCK}"))
    out._spool_path = placed._spool_path
    return out


def _step(live: dict, state: int, fault: int) -> dict:
    """The states after one more turn: {state: (cost, order, state before, edits)}; live: {state: (cost, rank, ...)}."""
    best = {t: (cost + DELETE, (rank, "D"), t, "D") for t, (cost, rank, *_) in live.items()}
    if fault in (FINE, CUT_OFF):
        own = TRUNCATED if fault == CUT_OFF else 0
        options = [(U, REROLE, "R"), (A, REROLE, "R")] + ([(state, KEEP, "K")] if state != NOTHING else [])
        for to, price, letter in options:
            for p, (cost, rank, *_) in live.items():
                if to == S:
                    if p != NOTHING:
                        continue
                    edits = letter
                else:
                    edits = "I" * BEFORE[to][p] + letter
                found = (cost + own + price + INSERT * (len(edits) - 1), (rank, edits), p, edits)
                if to not in best or found < best[to]:
                    best[to] = found
    ranks = sorted((order, t) for t, (_, order, _, _) in best.items())
    return {t: (best[t][0], k, *best[t][2:]) for k, (_, t) in enumerate(ranks)}


class _Machine:
    """The steps as moves between sets of states, each worked out once.

    Costs are kept as differences to the least, so sets recur.  What can't lead to the
    cheapest repair goes: an A can do all that S can, and all that NOTHING can but keep an s,
    which it can delete.  Then differences are bounded and the sets are few.
    """

    def __init__(self) -> None:
        self.sets: list[dict] = []
        self.numbers: dict[tuple, int] = {}
        self.moves: dict[tuple, tuple] = {}

    def number(self, live: dict) -> int:
        """live: {state: (cost, rank)}."""
        key = tuple(sorted((t, *v) for t, v in live.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(live)
        return self.numbers[key]

    def move(self, at: int, state: int, fault: int) -> tuple[int, int, dict]:
        """The set after one more turn, the cost that all of its states share, and {state: (state before, edits)}."""
        key = (at, state, fault)
        found = self.moves.get(key)
        if found is None:
            after = _step(self.sets[at], state, fault)
            if A in after:
                spare = {S: 0, NOTHING: DELETE}
                after = {t: v for t, v in after.items() if v[0] <= after[A][0] + spare.get(t, v[0])}
            least = min(v[0] for v in after.values())
            order = sorted(after, key=lambda t: after[t][1])
            number = self.number({t: (after[t][0] - least, k) for k, t in enumerate(order)})
            found = self.moves[key] = number, least, {t: v[2:] for t, v in after.items()}
        return found


def _end(live: dict) -> int:
    """The state that the cheapest repair ends in."""
    return min(live, key=lambda t: (live[t][0] + INSERT * AT_END[t], live[t][1]))


def _groups(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[tuple[list, list]]:
    """Runs of rows with the same first n_keys columns: the key and its rows, which come sorted; a run may span batches."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n_keys] != at:
                if held:
                    yield at, held
                at, held = row[:n_keys], []
            held.append(row[n_keys:])
    if held:
        yield at, held


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    columns = zip(*held, strict=True) if held else [[] for _ in schema.types]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


_MATRIX = pa.schema([("conv_id", pa.int64()), ("_block", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32()))])


def _matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs (-1: can't be, or can't be the cheapest) and ranks of a block's ends by its starts, four by four."""
    machine = _Machine()

    def rows() -> Iterator[tuple]:
        for (conv, block), turns in _groups(batches, 2):
            costs, ranks = [], []
            for start in range(4):
                at, total = machine.number({start: (0, 0)}), 0
                for _, state, fault in turns:
                    at, least, _ = machine.move(at, state, fault)
                    total += least
                live = machine.sets[at]
                costs += [total + live[t][0] if t in live else -1 for t in range(4)]
                ranks += [live[t][1] if t in live else -1 for t in range(4)]
            yield conv, block, costs, ranks

    return _batches(rows(), _MATRIX)


_BORDERS = pa.schema([("conv_id", pa.int64()), ("_block", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_())])


def _borders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states in which each block of a conversation starts and ends, from its matrices in order."""

    def rows() -> Iterator[tuple]:
        for (conv,), blocks in _groups(batches, 1):
            live, came = {NOTHING: (0, 0)}, []
            for _, costs, ranks in blocks:
                best: dict = {}
                for start, (cost, rank) in live.items():
                    for t in range(4):
                        if costs[4 * start + t] >= 0:
                            found = (cost + costs[4 * start + t], (rank, ranks[4 * start + t]), start)
                            best[t] = min(best.get(t, found), found)
                order = sorted((o, t) for t, (_, o, _) in best.items())
                live = {t: (best[t][0], k) for k, (_, t) in enumerate(order)}
                came.append({t: best[t][2] for t in best})
            leave = _end(live)
            found = []
            for (block, *_), before in zip(reversed(blocks), reversed(came), strict=True):
                found.append((conv, block, before[leave], leave, not found))
                leave = before[leave]
            yield from found

    return _batches(rows(), _BORDERS)


_EDITS = pa.schema([("_place", pa.int64()), ("edits", pa.string()), ("roles", pa.list_(pa.string()))])


def _edits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits at each turn and the role that each of them gives (null: none, or its own)."""
    machine = _Machine()

    def rows() -> Iterator[tuple]:
        for _, turns in _groups(batches, 2):
            _, _, _, enter, leave, last = turns[0]
            held, steps = machine.number({NOTHING if enter is None else enter: (0, 0)}), []
            for _, state, fault, *_ in turns:
                held, _, came = machine.move(held, state, fault)
                steps.append(came)
            at = _end(machine.sets[held]) if leave is None else leave
            extra = "I" * AT_END[at] if last or leave is None else ""
            for (place, *_), step in zip(reversed(turns), reversed(steps), strict=True):
                before, edits = step[at]
                # A role follows from what stands before: an inserted turn leads from the state before to the state after.
                roles: list = [None] * len(edits)
                for k in range(len(edits) - 1):
                    roles[k] = _NAMES[U if at == A else A]
                if edits[-1] == "R":
                    roles[-1] = _NAMES[at]
                if extra:
                    edits, roles, extra = edits + extra, roles + (["assistant"] if len(extra) == 1 else ["user", "assistant"]), ""
                yield place, edits, roles
                at = before

    return _batches(rows(), _EDITS)


def repair(chats: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The edits of every conversation in order: conv_id, place, step, edit (K, R, D or I), role, text, and of a turn of chats turn, was (its own role) and fault.

    place and step order a conversation; the rows whose edit isn't D are its repaired turns.
    """
    rows = _placed(chats, conv_col, turn_col, role_col, text_col)
    firsts = rows.where(F.col("fault") != BLANK).groupBy("h").agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("h", "_first")
    firsts = spool(firsts, "repair-repeats")
    again = F.coalesce((F.col("_place") > F.col("_first")) & (F.col("fault") != BLANK), F.lit(False))
    narrow = rows.select("conv_id", "_block", "_place", "state", "fault", "h").join(firsts, "h", "left")
    narrow = spool(narrow.select("conv_id", "_block", "_place", "state", F.when(again, DUPLICATE).otherwise(F.col("fault")).alias("fault")), "repair-narrow")
    unspool(firsts)
    spans = narrow.groupBy("conv_id").agg(F.min("_block").alias("_from"), F.max("_block").alias("_to")).where("_from < _to").select(F.col("conv_id").alias("_c"), F.lit(True).alias("_long"))
    wide = narrow.join(spool(spans, "repair-spans"), F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    matrices = wide.repartition("conv_id", "_block").sortWithinPartitions("conv_id", "_block", "_place").mapInArrow(_matrices, "conv_id long, _block long, costs array<long>, ranks array<int>")
    matrices = spool(matrices, "repair-matrices")
    borders = matrices.repartition("conv_id").sortWithinPartitions("conv_id", "_block").mapInArrow(_borders, "_c long, _b long, enter int, leave int, last boolean")
    borders = spool(borders, "repair-borders")
    unspool(matrices)
    told = narrow.join(borders, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b")), "left").select("conv_id", "_block", "_place", "state", "fault", "enter", "leave", "last")
    edits = told.repartition("conv_id", "_block").sortWithinPartitions("conv_id", "_block", "_place").mapInArrow(_edits, "_place long, edits string, roles array<string>")
    edits = spool(edits.join(narrow.select("_place", F.col("fault").alias("_fault")), "_place"), "repair-edits")
    unspool(narrow, borders)
    steps = rows.join(edits, "_place").select("conv_id", "_place", "turn", "role", "text", F.col("_fault").alias("fault"), "edits", F.posexplode("roles").alias("step", "_role"))
    edit = F.substring("edits", F.col("step") + 1, 1)
    own = edit != "I"
    return steps.select(
        "conv_id", F.col("_place").alias("place"), "step", edit.alias("edit"), F.coalesce("_role", "role").alias("role"), F.when(own, F.col("text")).otherwise("").alias("text"),
        F.when(own, F.col("turn")).alias("turn"), F.when(own, F.col("role")).alias("was"), F.when(own, F.col("fault")).alias("fault"),
    )


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
_DIGEST = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation, from its edits in order; texts are hashed as they come."""

    def rows() -> Iterator[tuple]:
        conv = state = None
        begun = False
        for batch in batches:
            for c, edit, role, text, was, fault in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not begun or c != conv:
                    if begun:
                        yield conv, *counts, "".join(audit), state.hexdigest()
                    conv, counts, audit, state, before, begun, first = c, [0] * 5, [], hashlib.sha256(), None, True, True
                audit.append(edit)
                if edit == "I":
                    counts[4] += INSERT
                else:
                    if fault:
                        counts[fault - 1] += 1
                    counts[3] += before is not None and before + was[:1] not in ("su", "ua", "au")
                    before = was[:1]
                    counts[4] += {"K": KEEP, "R": REROLE, "D": DELETE}[edit] + TRUNCATED * (fault == CUT_OFF and edit != "D")
                if edit != "D":
                    state.update(f"{'' if first else '\n'}{role}:{text}".encode())
                    first = False
        if begun:
            yield conv, *counts, "".join(audit), state.hexdigest()

    return _batches(rows(), _DIGEST, 1000)


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    bad = damaged(chats)
    steps = repair(bad).repartition("conv_id").sortWithinPartitions("conv_id", "place", "step").select("conv_id", "edit", "role", "text", "was", "fault")
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    found = steps.mapInArrow(_digests, f"_c long, {counts}, audit string, repaired_sha256 string")
    gaps = bad.groupBy(F.col("conv_id").alias("_g")).agg(F.expr("try_cast(CAST(max(turn) AS DECIMAL(38, 0)) - min(turn) + 1 - count(DISTINCT turn) AS BIGINT)").alias("gaps"))
    every = chats.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(gaps, F.col("conv_id").eqNullSafe(F.col("_g")), "left").join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *_COUNTS)]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_EMPTY)).alias("repaired_sha256"))


def op13_sql() -> str:
    """A turn at a time: for each role retained last, the least (cost, audit) and what has been repaired so far, carried whole."""
    never = 1_000_000_000
    names = {S: "system", U: "user", A: "assistant"}
    columns = {NOTHING: "n", S: "s", U: "u", A: "a"}
    kind = "STRUCT(cost BIGINT, audit VARCHAR, lines VARCHAR)"

    def state(cost: str, audit: str, lines: str) -> str:
        return f"{{'cost': {cost}, 'audit': {audit}, 'lines': {lines}}}"

    def inserted(before: int, to: int) -> list[str]:
        other = {U: "assistant", A: "user"}[to]
        return [other] * BEFORE[to][before]

    def after(to: int) -> str:
        c = columns[to]
        options = [state(f"x.{c}.cost + {DELETE}", f"x.{c}.audit || 'D'", f"x.{c}.lines")]
        for before in ([] if to == NOTHING else [NOTHING] if to == S else columns):
            b, put = columns[before], [] if to == S else inserted(before, to)
            empty = "".join(f" || chr(10) || '{r}:'" for r in put)
            own = f"CASE WHEN f.fault = {CUT_OFF} THEN {TRUNCATED} ELSE 0 END + {INSERT * len(put)}"
            for letter, price, role, fits in (("K", KEEP, "f.role", f"f.initial = '{c}'"), ("R", REROLE, f"'{names[to]}'", "false" if to == S else "true")):
                cost = f"CASE WHEN {fits} AND f.fault IN ({FINE}, {CUT_OFF}) THEN x.{b}.cost + {price} + {own} ELSE {never} END"
                options.append(state(cost, f"x.{b}.audit || '{'I' * len(put)}{letter}'", f"x.{b}.lines{empty} || chr(10) || {role} || ':' || f.text"))
        return f"CAST(list_sort([{', '.join(options)}])[1] AS {kind}) AS {c}"

    begin = ", ".join(f"CAST({state(str(0 if t == NOTHING else never), chr(39) * 2, chr(39) * 2)} AS {kind}) AS {c}" for t, c in columns.items())
    ends = []
    for t, c in columns.items():
        tail = {0: [], 1: ["assistant"], 2: ["user", "assistant"]}[AT_END[t]]
        ends.append(state(f"x.{c}.cost + {INSERT * len(tail)}", f"x.{c}.audit || '{'I' * len(tail)}'", f"x.{c}.lines" + "".join(f" || chr(10) || '{r}:'" for r in tail)))
    spaces = " || ".join(f"chr({ord(c)})" for c in " " + SPACES)
    return f"""
WITH RECURSIVE {CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations, t),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM k, (SELECT unnest([0, 1]) AS again) WHERE kind <> 0 AND (again = 0 OR kind = 3)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(concat_ws(':', coalesce(CAST(conv_id AS VARCHAR), ''), octet_length(encode(role)), role, text))) AS p FROM d),
q AS (SELECT *, left(role, 1) AS initial, right(rtrim(text, {spaces}), 1) AS last, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) AS nth FROM p),
f AS (SELECT *, CASE WHEN last = '' THEN {BLANK} WHEN nth > 1 THEN {DUPLICATE} WHEN last IN ('.', '!', '?') THEN {FINE} ELSE {CUT_OFF} END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY p) AS above FROM q),
c AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = {BLANK}) AS blank, count(*) FILTER (fault = {DUPLICATE}) AS duplicate,
  count(*) FILTER (fault = {CUT_OFF}) AS truncated, count(*) FILTER (above IS NOT NULL AND above || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
x AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {begin} FROM c
  UNION ALL SELECT x.conv_id, x.i + 1, {", ".join(after(t) for t in columns)} FROM x JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.p = x.i + 1),
e AS (SELECT c.*, list_sort([{", ".join(ends)}])[1] AS best FROM x JOIN c ON c.conv_id IS NOT DISTINCT FROM x.conv_id AND c.n = x.i)
SELECT o.conv_id, {", ".join(f"CAST(coalesce({k}, 0) AS BIGINT) AS {k}" for k in ("gaps", "blank", "duplicate", "truncated", "illegal"))}, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(substr(best.lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
