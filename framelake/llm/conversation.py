"""Operator 13: conversation structure repair by a min-plus matrix scan.

A repaired conversation has role initials s?(ua)+ or nothing. Four states say how far it has come: nothing yet, after a
system, a user, an assistant turn. A turn is a 4x4 matrix over (cost, audit): from state to state, the cheapest edits that
take the turn, any inserts before it included (the insert closure), ties to the ASCII-least audit. Costs add and audits
join in a product, the least wins; the product is associative, so a conversation is the product of its turns in any
grouping. Audits of one entry and one cost are never prefixes of each other (each ends with the letter of a turn), so the
least of a product is the product of the least.

Turns are range-partitioned by (conversation, turn) and sorted. Conversations within a cut are scanned there, all of a
batch in step, and are done in that one pass. Only the first and last conversation of a cut may go on in another one: their
turns leave as they are, at most two conversations a cut. Each (conversation, cut) of those becomes one matrix; matrices
are multiplied in a tree of FAN at a time, by higher-order functions; the root's audit goes back to the cuts, which write
their lines; a hash runs over the lines in order, piece by piece. So no task holds a conversation, but one that its
hash streams through; the matrix of a very long one holds 16 audits of its length.

Defined cases: a null role or text is one space; a role's initial is its first character, case counts; turns go by number,
null first, those of one number by role, then by SHA-256 of the text; repeated rows are duplicates; a null conversation id
is a conversation of its own; a conversation without turns left has zeros, an empty audit and the hash of nothing; an empty
table gives no rows. Other columns are not read. An audit, being one string, is at most 2 GB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, read, small_batches

REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
STATES = 4
FAN = 8
#: Characters of repaired text that travel in one row.
PIECE = 1 << 20
NONE = 1 << 40
#: The state that an inserted or rerolled turn leads to: user, but assistant after a user.
FOLLOW = (2, 2, 3, 2)
INITIALS = "sua"
OK_PAIRS = ((0, 1), (1, 2), (2, 1))
#: What closes a conversation that stands in each state.
CLOSING = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


def kept_state(state: int, initial: int) -> int | None:
    if initial == 0:
        return 1 if state == 0 else None
    if initial == 1:
        return 2 if state != 2 else None
    return 3 if initial == 2 and state == 2 else None


def turn_matrix(initial: int, forced: bool, cut_off: bool) -> list[list[tuple[int, str] | None]]:
    """One turn with the inserts before it; two inserts lead to every state that inserts reach."""
    out: list[list[tuple[int, str] | None]] = [[None] * STATES for _ in range(STATES)]
    for start in range(STATES):
        state = start
        for inserts in range(3):
            cost, said = INSERT * inserts, "I" * inserts
            edits = [(DELETE, "D", state)]
            if not forced:
                edits += [(CUT_OFF * cut_off, "K", kept_state(state, initial)), (REROLE + CUT_OFF * cut_off, "R", FOLLOW[state])]
            for more, letter, to in edits:
                if to is not None and (out[start][to] is None or (cost + more, said + letter) < out[start][to]):
                    out[start][to] = (cost + more, said + letter)
            state = FOLLOW[state]
    return out


#: The sixteen kinds of turn: 4 * initial + 2 * forced + cut_off.
TURNS = [turn_matrix(i, bool(f), bool(c)) for i in range(4) for f in range(2) for c in range(2)]
NAMES = sorted({x[1] for m in TURNS for row in m for x in row if x})
#: Cost and rank of the audit in one number, and the rank alone.
KEYS = np.array([[[x[0] << 8 | NAMES.index(x[1]) if x else NONE << 8 for x in row] for row in m] for m in TURNS], np.int64)
RANKS = (KEYS & 255).astype(np.uint8)
CLOSED = np.array([[c] for c, _ in CLOSING], np.int64)
OPEN = np.where(np.eye(STATES, dtype=bool), 0, NONE).astype(np.int64)


def scan(kinds: np.ndarray, offsets: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of the turns' matrices and `last`, for all runs in step: costs [run, state, column], and [turn, state, column] the state that the least goes to."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    cost = np.tile(last, (len(lengths), 1, 1))
    choice = np.zeros((len(kinds), *last.shape), np.uint8)
    active = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), "left")
    for t, n in enumerate(active):
        runs = order[:n]
        turn = offsets[runs + 1] - 1 - t
        total = KEYS[kinds[turn]][:, :, :, None] + (cost[runs] << 8)[:, None]
        to = total.argmin(2)
        choice[turn] = to
        cost[runs] = np.minimum(np.take_along_axis(total, to[:, :, None], 2)[:, :, 0] >> 8, NONE)
    return cost, choice


def trace(kinds: np.ndarray, offsets: np.ndarray, choice: np.ndarray, start: int, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each turn's audit along the least, and the state that each run ends in."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    active = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), "left")
    state = np.full(len(lengths), start)
    said = np.zeros(len(kinds), np.uint8)
    for t, n in enumerate(active):
        runs = order[:n]
        turn = offsets[runs] + t
        to = choice[turn, state[runs], column]
        said[turn] = RANKS[kinds[turn], state[runs], to]
        state[runs] = to
    return said, state


def differs(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Whether each row but the first differs from the one before; nulls are alike."""
    n = len(column)
    a, b = column.slice(1), column.slice(0, max(n - 1, 0))
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return ~np.asarray(same.to_numpy(zero_copy_only=False) if isinstance(same, pa.Array) else same.to_numpy(), bool)


def turn_gaps(run: np.ndarray, turn: np.ndarray, known: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least, largest and number of different turn numbers of each run, whose rows are in order; 0 of them where none is known."""
    r, t = run[known], turn[known]
    lo, hi, distinct = np.zeros(runs, np.int64), np.zeros(runs, np.int64), np.zeros(runs, np.int64)
    if len(r):
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (t[1:] != t[:-1])
        distinct = np.bincount(r[new], minlength=runs)
        hi[r] = t
        lo[r[::-1]] = t[::-1]
    return lo, hi, distinct


def wrong_pairs(run: np.ndarray, initial: np.ndarray, runs: int) -> np.ndarray:
    a, b = initial[:-1], initial[1:]
    bad = run[:-1] == run[1:]
    for x, y in OK_PAIRS:
        bad &= ~((a == x) & (b == y))
    return np.bincount(run[1:][bad], minlength=runs)


def lines(said: list[str], roles: list[str], texts: list[str], emitted: int, odd: bool, closing: str = "") -> list[str]:
    """The repaired turns, after `emitted` others; odd: the whole conversation has an odd number, so it begins with system."""
    out = []
    for s, role, text in [*zip(said, roles, texts), (closing, None, None)]:
        for letter in s:
            if letter == "D":
                continue
            made = "assistant" if (len(out) + emitted - odd) % 2 else "user"
            out.append(f"{role}:{text}" if letter == "K" else f"{made}:{text if letter == 'R' else ''}")
    return out


def arrays(table: pa.Table) -> dict[str, np.ndarray]:
    out = {c: table.column(c).to_numpy() for c in ("live", "empty", "cut_off", "initial")}
    out["known"] = ~np.asarray(table.column("turn").is_null().to_numpy())
    out["turn"] = pc.fill_null(table.column("turn"), 0).to_numpy()
    return out


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired string"
RAW = "turn long, role string, text string, live boolean, empty boolean, cut_off boolean, initial int, at long"


def whole(parts: list[pa.RecordBatch], schema: pa.Schema, texts: bool) -> pa.RecordBatch:
    """A row for each conversation of the parts, each of which is here from its first turn to its last."""
    table = pa.Table.from_batches(parts)
    conv = table.column("conv_id")
    starts = np.concatenate([[0], np.flatnonzero(differs(conv)) + 1])
    n = len(starts)
    x = arrays(table)
    run = np.zeros(len(conv), np.int64)
    run[starts[1:]] = 1
    run = np.cumsum(run)
    at = np.flatnonzero(x["live"])
    role, text = (table.column(c).take(at).to_pylist() for c in ("role", "text"))
    run, blank, initial = run[at], x["empty"][at], x["initial"][at]
    duplicate = pd.DataFrame({"run": run, "role": role, "text": text}).duplicated().to_numpy() & ~blank
    cut_off = x["cut_off"][at] & ~blank & ~duplicate
    offsets = np.concatenate([[0], np.cumsum(np.bincount(run, minlength=n))])
    kinds = 4 * initial + 2 * (blank | duplicate) + cut_off
    lo, hi, distinct = turn_gaps(run, x["turn"][at], x["known"][at], n)
    cost, choice = scan(kinds, offsets, CLOSED)
    ranks, state = trace(kinds, offsets, choice, 0, 0)
    names = [NAMES[r] for r in ranks]
    audits, repaired = [], []
    for i in range(n):
        a, b = offsets[i], offsets[i + 1]
        closing = CLOSING[state[i]][1]
        audits.append("".join(names[a:b]) + closing)
        odd = (len(audits[-1]) - audits[-1].count("D")) % 2 == 1
        repaired.append("\n".join(lines(names[a:b], role[a:b], text[a:b], 0, odd, closing)))
    count = lambda flag: np.bincount(run[flag], minlength=n)
    made = {
        "conv_id": conv.take(starts),
        "gaps": np.where(distinct > 0, hi - lo + 1 - distinct, 0),
        "blank": count(blank),
        "duplicate": count(duplicate),
        "truncated": count(cut_off),
        "illegal": wrong_pairs(run, initial, n),
        "cost": cost[:, 0, 0],
        "audit": audits,
        "repaired_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in repaired],
    } | ({"repaired": repaired} if texts else {})
    return filled(made, n, schema)


def filled(columns: dict, n: int, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of the schema; columns not given are null."""
    out = []
    for f in schema:
        got = columns.get(f.name)
        got = got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got
        out.append(pa.nulls(n, f.type) if got is None else got.cast(f.type) if isinstance(got, pa.Array) else pa.array(got, f.type))
    return pa.RecordBatch.from_arrays(out, schema=schema)


def fold(texts: bool):
    """Over a sorted cut: conversations that begin and end in it are done, the turns of the first and the last leave as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        pending: list[pa.RecordBatch] = []
        opened, first, previous = False, True, None
        raw = lambda b: filled({c: b.column(c) for c in b.schema.names}, b.num_rows, schema)
        for batch in batches:
            if not batch.num_rows:
                continue
            if schema is None:
                kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
                schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *[(c, kinds[t]) for c, t in (x.split() for x in f"{SUMMARY}, {RAW}".split(", "))]])
            conv = batch.column("conv_id")
            bounds = [0, *(np.flatnonzero(differs(conv)) + 1), batch.num_rows]
            done: list[pa.RecordBatch] = []
            for a, b in zip(bounds, bounds[1:]):
                part = batch.slice(a, b - a)
                if a or not opened or conv[0].as_py() != previous:
                    if opened and not first:
                        done += pending
                    pending, first, opened = [], not opened, True
                if first:
                    yield raw(part)
                else:
                    pending.append(part)
            previous = conv[-1].as_py()
            if done:
                yield whole(done, schema, texts)
        for part in pending:
            yield raw(part)

    return run


SEGMENT = "key string, cut long, turns long, blank long, duplicate long, truncated long, illegal long, first int, last int, lo long, hi long, distinct long, matrix array<array<struct<cost:bigint,audits:array<string>>>>"


def segment(key: tuple, table: pa.Table) -> pa.Table:
    """The matrix and the counts of the turns of a conversation that one cut holds."""
    table = table.sort_by("at").filter(pc.field("live"))
    n = len(table)
    x = arrays(table)
    blank, initial, duplicate = x["empty"], x["initial"], table.column("duplicate").to_numpy()
    cut_off = x["cut_off"] & ~blank & ~duplicate
    kinds = 4 * initial + 2 * (blank | duplicate) + cut_off
    offsets, one = np.array([0, n]), np.zeros(n, np.int64)
    cost, choice = scan(kinds, offsets, OPEN)
    lo, hi, distinct = turn_gaps(one, x["turn"], x["known"], 1)
    matrix = [
        [{"cost": int(cost[0, i, j]), "audits": ["".join(NAMES[r] for r in trace(kinds, offsets, choice, i, j)[0])]} if cost[0, i, j] < NONE else None for j in range(STATES)]
        for i in range(STATES)
    ]
    made = [{
        "key": key[0].as_py(), "cut": key[1].as_py(), "turns": n, "blank": int(blank.sum()), "duplicate": int(duplicate.sum()), "truncated": int(cut_off.sum()),
        "illegal": int(wrong_pairs(one, initial, 1)[0]) if n else 0, "first": int(initial[0]) if n else None, "last": int(initial[-1]) if n else None,
        "lo": int(lo[0]) if distinct[0] else None, "hi": int(hi[0]) if distinct[0] else None, "distinct": int(distinct[0]), "matrix": matrix,
    }]
    element = pa.list_(pa.list_(pa.struct([("cost", pa.int64()), ("audits", pa.list_(pa.string()))])))
    kinds_ = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    names = [f.split(" ", 1) for f in SEGMENT.split(", ")]
    return pa.Table.from_pylist(made, pa.schema([(c, kinds_.get(t, element)) for c, t in names]))


def product(a: Column, b: Column) -> Column:
    """Of two matrices: sums of costs, joined audits, the least of each entry. An entry that nothing reaches is null."""
    each = F.array(*[F.lit(k) for k in range(STATES)])
    through = lambda row, j, k: F.when(row[k].isNotNull() & b[k][j].isNotNull(), F.struct((row[k].cost + b[k][j].cost).alias("cost"), F.concat(row[k].audits, b[k][j].audits).alias("audits")))
    return F.transform(a, lambda row: F.transform(each, lambda j: F.array_min(F.transform(each, lambda k: through(row, j, k)))))


def multiplied(segments: DataFrame) -> DataFrame:
    """key, matrix: the product of each conversation's matrices in order of seg, a tree of FAN at a time."""
    most = segments.agg(F.max("seg")).first()[0] or 0
    level = segments.select("key", "seg", "matrix")
    while True:
        level = level.groupBy("key", F.floor(F.col("seg") / FAN).alias("seg")).agg(F.sort_array(F.collect_list(F.struct("seg", "matrix"))).alias("m"))
        level = level.select("key", "seg", F.aggregate(F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(1))), F.col("m")[0].matrix, lambda a, b: product(a, b.matrix)).alias("matrix"))
        most //= FAN
        if not most:
            return level.select("key", "matrix")


PIECES = "key string, cut long, piece long, text string"


def write_lines(key: tuple, rows: pa.Table, plan: pa.Table) -> pa.Table:
    """The repaired lines of a conversation's part, in pieces; each but the conversation's first line begins with a newline."""
    p = plan.to_pylist()[0]
    rows = rows.sort_by("at")
    said, word = [], ""
    for letter in p["audit"]:
        word += letter
        if letter != "I":
            said.append(word)
            word = ""
    out, held, pieces = [], 0, []
    for line in lines(said, rows.column("role").to_pylist(), rows.column("text").to_pylist(), p["emitted"], p["odd"], p["closing"]):
        out.append(("\n" if pieces or out or p["emitted"] else "") + line)
        held += len(line)
        if held >= PIECE:
            pieces.append("".join(out))
            out, held = [], 0
    if out:
        pieces.append("".join(out))
    n = len(pieces)
    return pa.table({"key": pa.array([key[0].as_py()] * n, pa.string()), "cut": pa.array([key[1].as_py()] * n, pa.int64()), "piece": pa.array(range(n), pa.int64()), "text": pa.array(pieces, pa.string())})


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, repaired_sha256 of pieces that come by key and place; one piece is held at a time."""
    current, h = None, hashlib.sha256()
    give = lambda: pa.RecordBatch.from_pydict({"key": pa.array([current], pa.string()), "repaired_sha256": pa.array([h.hexdigest()], pa.string())})
    for batch in batches:
        for key, text in zip(batch.column("key"), batch.column("text")):
            if key.as_py() != current:
                if current is not None:
                    yield give()
                current, h = key.as_py(), hashlib.sha256()
            h.update(text.as_py().encode())
    if current is not None:
        yield give()


def over_cuts(spark: SparkSession, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The summary and the repaired pieces of conversations that stand in more than one cut, or could."""
    turns = turns.withColumns({"key": F.coalesce(F.concat(F.lit("s"), F.col("conv_id").cast("string")), F.lit("")), "cut": F.shiftright("at", 33)})
    met = turns.select("key", "cut", "turn", "live", "empty", "cut_off", "initial", "at")
    firsts = turns.filter("live and not empty").groupBy("key", "role", F.sha2("text", 256).alias("hash")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("once"))
    met = met.join(firsts, "at", "left").withColumn("duplicate", F.col("live") & ~F.col("empty") & F.col("once").isNull()).drop("once")
    parts = met.groupBy("key", "cut").applyInArrow(segment, SEGMENT)
    order = Window.partitionBy("key").orderBy("cut")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = keep(spark, parts.withColumns({"seg": F.row_number().over(order) - 1, "was": F.last("last", True).over(before), "had": F.last("hi", True).over(before)}), narrow=True)
    fine = F.lit(False)
    for a, b in OK_PAIRS:
        fine = fine | ((F.col("was") == a) & (F.col("first") == b))
    joint = F.when(F.col("was").isNotNull() & F.col("first").isNotNull() & ~fine, 1).otherwise(0)
    counts = parts.groupBy("key").agg(
        F.coalesce(F.max("hi") - F.min("lo") + 1 - F.sum(F.col("distinct") - F.when(F.col("had") == F.col("lo"), 1).otherwise(0)), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        F.sum(F.col("illegal") + joint).alias("illegal"),
    )
    close = F.array(*[F.struct(F.lit(c).cast("long").alias("cost"), F.lit(s).alias("audit")) for c, s in CLOSING])
    ends = F.transform(F.array(*[F.lit(k) for k in range(STATES)]), lambda k: F.when(F.col("matrix")[0][k].isNotNull(), F.struct((F.col("matrix")[0][k].cost + close[k].cost).alias("cost"), F.concat(F.col("matrix")[0][k].audits, F.array(close[k].audit)).alias("audits"))))
    roots = keep(spark, multiplied(parts).select("key", F.array_min(ends).alias("least")).select("key", F.col("least.cost").alias("cost"), F.col("least.audits").alias("audits")))
    size = lambda c: F.length(F.translate(c, "D", ""))
    plan = roots.select("key", (size(F.array_join("audits", "")) % 2 == 1).alias("odd"), F.element_at("audits", -1).alias("end"), F.posexplode("audits").alias("seg", "audit"))
    plan = plan.join(parts.select("key", "seg", "cut"), ["key", "seg"])
    by = Window.partitionBy("key").orderBy("seg")
    plan = plan.withColumn("emitted", F.coalesce(F.sum(size(F.col("audit"))).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plan = plan.withColumn("closing", F.when(F.lead("seg").over(by).isNull(), F.col("end")).otherwise("")).drop("end", "seg")
    rows = turns.filter("live").select("key", "cut", "at", "role", "text")
    pieces = keep(spark, rows.groupBy("key", "cut").cogroup(plan.groupBy("key", "cut")).applyInArrow(write_lines, PIECES))
    sums = pieces.repartition("key").sortWithinPartitions("key", "cut", "piece").mapInArrow(hashed, "key string, repaired_sha256 string")
    ids = turns.groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    out = ids.join(counts, "key").join(roots.select("key", "cost", F.array_join("audits", "").alias("audit")), "key").join(sums, "key", "left")
    out = out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))).drop("key")
    return out, ids.join(pieces, "key").select("conv_id", F.struct("cut", "piece").alias("place"), "text")


def repair(spark: SparkSession, turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", live_col: str | None = None, texts: bool = False):
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: a row for each conversation.

    live_col: where it is false, a row says only that its conversation exists. texts: give also conv_id, place, text, the
    repaired conversations, a long one in pieces that follow each other by place."""
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(" "))
    role = F.coalesce(F.col(role_col), F.lit(" "))
    first = F.substring(role, 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.lit(True).alias("live") if live_col is None else F.col(live_col).alias("live"))
    rows = rows.withColumns({"empty": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "cut_off": ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "initial": initial.cast("int")})
    rows = rows.withColumns({"hash": F.sha2("text", 256), "place": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "hash", "place"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("hash", "place").withColumn("at", F.monotonically_increasing_id())
    kind = turns.schema[id_col].dataType.simpleString()
    found = keep(spark, rows.mapInArrow(fold(texts), f"conv_id {kind}, {SUMMARY}, {RAW}"))
    done = found.filter("audit is not null")
    summary = ["conv_id", *[x.split()[0] for x in SUMMARY.split(", ") if not x.startswith("repaired ")]]
    rest, pieces = over_cuts(spark, found.filter("at is not null").select("conv_id", *[x.split()[0] for x in RAW.split(", ")]))
    out = done.select(*summary).unionByName(rest.select(*summary))
    if not texts:
        return out
    return out, done.select("conv_id", F.lit(None).cast("struct<cut:bigint,piece:bigint>").alias("place"), F.col("repaired").alias("text")).unionByName(pieces)


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, live: faults by crc32 of `conv_id:turn`; 0 drops a row, 1 empties it, 2 takes its full stops, 3 repeats it, 4 makes it the user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("live"), F.explode(F.array_repeat("kind", F.when(F.col("kind") == 3, 2).otherwise(1))).alias("kind"))
    return rows.drop("kind")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark, damage(read(spark, sf_dir, "conversations")), live_col="live")


def _sql() -> str:
    """The same by plain strings, from each conversation's last turn back to its first; a cost of twelve digits stands before its audit."""
    add = lambda v, cost, letter: f"lpad(CAST(CAST(left({v}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || '{letter}' || substr({v}, 13)"
    follow = ["v2", "v2", "v3", "v2"]
    keeps = [[("s", "v1"), ("u", "v2")], [("u", "v2")], [("a", "v3")], [("u", "v2")]]
    edits = [", ".join([add(f"v{s}", 3, "D"), *(f"CASE WHEN may AND initial = '{i}' THEN {add(to, 'cut', 'K')} END" for i, to in keeps[s]), f"CASE WHEN may THEN {add(follow[s], '2 + cut', 'R')} END"]) for s in range(4)]
    plain = ", ".join(f"least({e}) AS p{s}" for s, e in enumerate(edits))
    return rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)
), hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name, t FROM conversations, crc_table
), kinds AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(name) + 1), lambda i: CAST(ascii(substr(name, i, 1)) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM hashed
), broken AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0
), convs AS (
  SELECT conv_id, row_number() OVER () AS conv FROM (SELECT DISTINCT conv_id FROM conversations)
), placed AS (
  SELECT conv, turn, role, text, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos
  FROM broken b JOIN convs c ON b.conv_id IS NOT DISTINCT FROM c.conv_id
), judged AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv ORDER BY pos) AS was,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault
  FROM placed
), counts AS (
  SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (was || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv
), steps AS (
  SELECT conv, n + 1 AS pos, '000000000000' AS v0, '000000000004II' AS v1, '000000000002I' AS v2, '000000000000' AS v3 FROM counts
  UNION ALL
  SELECT conv, pos, least(p0, {add("q2", 2, "I")}), least(p1, {add("q2", 2, "I")}), q2, least(p3, {add("p2", 2, "I")}) FROM (
    SELECT *, least(p2, {add("p3", 2, "I")}) AS q2 FROM (
      SELECT conv, pos, {plain} FROM (
        SELECT s.conv, j.pos, v0, v1, v2, v3, initial, fault NOT IN ('blank', 'duplicate') AS may, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM steps s JOIN judged j ON s.conv = j.conv AND j.pos = s.pos - 1)))
), audits AS (
  SELECT conv, CAST(left(v0, 12) AS BIGINT) AS cost, substr(v0, 13) AS audit FROM steps WHERE pos = 1
), letters AS (
  SELECT conv, audit, unnest(range(1, len(audit) + 1)) AS i FROM audits
), spelled AS (
  SELECT conv, i, substr(audit, i, 1) AS letter, len(replace(left(audit, i), 'I', '')) AS pos, len(replace(left(audit, i), 'D', '')) - 1 - len(replace(audit, 'D', '')) % 2 AS emitted FROM letters
), repaired AS (
  SELECT conv, string_agg(CASE WHEN letter = 'K' THEN role WHEN emitted % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS text
  FROM spelled LEFT JOIN judged USING (conv, pos) WHERE letter <> 'D' GROUP BY conv
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM convs LEFT JOIN counts USING (conv) LEFT JOIN audits USING (conv) LEFT JOIN repaired r USING (conv)
"""


SQL = _sql()
