"""Conversation repair against all edits tried, against a plain program over whole conversations, and on edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from oracle import DATA

from framelake.llm import conversation

SMALL = DATA.replace("sf0.001", "sf0.01")
WHITE = " \t\n\v\f\r"
GOOD = re.compile("(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = text.strip(WHITE)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def all_edits(rows, marks):
    """Every repair of a few turns, at most two inserts in a gap."""
    choices = []
    for (_, _, role, _), mark in zip(rows, marks):
        cut = mark == "truncated"
        edits = [("D", 3, None)]
        if mark not in ("blank", "duplicate"):
            edits += [("K", cut, role[:1]), ("R", 2 + cut, "u"), ("R", 2 + cut, "a")]
        choices.append(edits)
    inserts = [("I" * n, 2 * n, "".join(x)) for n in range(3) for x in itertools.product("ua", repeat=n)]
    best = None
    for combo in itertools.product(*choices):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            roles = gaps[0][2] + "".join((c[2] or "") + g[2] for c, g in zip(combo, gaps[1:]))
            if GOOD.fullmatch(roles):
                got = (sum(c[1] for c in combo) + sum(g[1] for g in gaps), gaps[0][0] + "".join(c[0] + g[0] for c, g in zip(combo, gaps[1:])))
                best = got if best is None or got < best else best
    return best


def from_the_end(rows, marks):
    """(cost, audit) by whole strings, from the last turn back to the first."""
    step = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, ""), "s": (4, "II"), "u": (2, "I"), "a": (0, "")}
    for (_, _, role, _), mark in zip(reversed(rows), reversed(marks)):
        cut, plain = mark == "truncated", {}
        for state, after in best.items():
            options = [(3 + after[0], "D" + after[1])]
            if mark not in ("blank", "duplicate"):
                for to in step[state]:
                    if role[:1] == to:
                        options.append((cut + best[to][0], "K" + best[to][1]))
                    if to != "s":
                        options.append((2 + cut + best[to][0], "R" + best[to][1]))
            plain[state] = min(options)
        for _ in range(3):
            plain = {s: min([plain[s], *((2 + plain[to][0], "I" + plain[to][1]) for to in step[s] if to != "s")]) for s in plain}
        best = plain
    return best[""]


def written(rows, audit):
    emitted = len(audit) - audit.count("D")
    roles = (["system"] if emitted % 2 else []) + ["user", "assistant"] * (emitted // 2)
    out, at = [], 0
    for letter in audit:
        row = None if letter == "I" else rows[at]
        at += letter != "I"
        if letter != "D":
            role = roles[len(out)]
            out.append(f"{row[2]}:{row[3]}" if letter == "K" else f"{role}:{row[3] if letter == 'R' else ''}")
    return "\n".join(out)


def plain(rows, broken=True):
    by = {r[0]: [] for r in rows}
    for r in damaged(rows) if broken else [(c, t, " " if a is None else a, " " if b is None else b) for c, t, a, b in rows]:
        by[r[0]].append(r)
    out = {}
    for conv, turns in by.items():
        turns = in_order(turns)
        marks = faults(turns)
        known = [t for _, t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        cost, audit = from_the_end(turns, marks)
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        text = written(turns, audit)
        out[conv] = (gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(), text)
    return out


COLUMNS = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
SCHEMA = "conv_id long, turn long, role string, text string"


def check(spark, rows, parts, kind="long"):
    df = spark.createDataFrame(rows, SCHEMA.replace("conv_id long", f"conv_id {kind}")).repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        summary, texts = conversation.repair(spark, conversation.damage(df), live_col="live", texts=True)
        got, pieces = summary.collect(), texts.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = plain(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == want[r.conv_id][:-1], r
    by = {}
    for p in sorted(pieces, key=lambda p: p.place or (0, 0)):
        by[p.conv_id] = by.get(p.conv_id, "") + p.text
    assert {c: t for c, t in by.items() if t} == {c: w[-1] for c, w in want.items() if w[-1]}


def invented(rng, convs, most):
    texts = ["Yes.", "No!", "cut off", "", " \n", "Why?", "x.\t", "é…", None, "."]
    roles = ["user", "assistant", "system", "tool", "User", "", "a", None]
    rows = []
    for c in convs:
        for t in range(rng.randrange(1, most)):
            rows.append((c, rng.choice([t, t, t, t + 3, None, 7]), rng.choice(roles[:2] * 4 + roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}."))
    return rows


def test_plain_program_tries_all():
    rng = random.Random(1)
    for n in (0, 1, 1, 2, 2, 2, 3, 3, 3, 3):
        rows = [(0, i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b.", "cut", ""])) for i in range(n)]
        assert from_the_end(rows, faults(rows)) == all_edits(rows, faults(rows))


def test_matrices_multiply_in_any_grouping():
    """The scan's products and the least of them are those of whole strings, for every pair of turns."""
    def times(a, b):
        out = [[None] * 4 for _ in range(4)]
        for i, j in itertools.product(range(4), repeat=2):
            out[i][j] = min(((a[i][k][0] + b[k][j][0], a[i][k][1] + b[k][j][1]) for k in range(4) if a[i][k] and b[k][j]), default=None)
        return out

    rng = random.Random(2)
    for _ in range(200):
        a, b, c = rng.choices(conversation.TURNS, k=3)
        assert times(times(a, b), c) == times(a, times(b, c))


@pytest.mark.parametrize("parts", [1, 40])
def test_against_a_plain_program(spark, parts):
    rng = random.Random(parts)
    check(spark, invented(rng, [*range(60), None, -5, (1 << 62) + 1], 12), parts)


def test_one_conversation_over_many_cuts(spark):
    """A conversation of half of all rows, repeats and null turns among them, goes through cuts, tree and pieces."""
    rng = random.Random(9)
    piece, conversation.PIECE = conversation.PIECE, 500
    try:
        check(spark, invented(rng, range(40), 9) + [(20, rng.choice([t, t // 2, None]), rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"no {rng.randrange(300)}", f"t{t}."])) for t in range(900)] + [(21, 5, "user", "same.")] * 400, 90)
    finally:
        conversation.PIECE = piece


def test_given_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain(rows)
    got = conversation.query(spark, SMALL).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == want[r.conv_id][:-1]


def test_edges(spark):
    long = "word " * 40000
    rows = [("a", 1, "user", long), ("a", 2, "assistant", long + "."), ("b", None, None, None), (None, 3, "user", "x."), ("", 3, "user", "x."), ("c", 0, "system", "s.")]
    check(spark, rows, 2, "string")
    extra = spark.createDataFrame([(*r, True, "k", 1, "h") for r in rows], SCHEMA.replace("conv_id long", "conv_id string") + ", live boolean, key string, at int, hash string")
    want = plain(rows, broken=False)
    got = conversation.repair(spark, extra).collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == {c: w[:-1] for c, w in want.items()}
    assert conversation.repair(spark, extra.limit(0)).collect() == []
