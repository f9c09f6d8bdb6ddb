"""Each operator against SQL, a library, brute force, an exact round trip or held-out accuracy."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from oracle import DATA, connect, same
from pyspark.sql import functions as F

from framelake.llm import common, embedding_dedup, jaccard_join, lattice, language, mixing, pii, registry, sampling, token_count, topk_search, toxicity, url_filter

SMALL = DATA.replace("sf0.001", "sf0.01")


def table(spark, name, sf_dir=DATA):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, name):
    same(registry.QUERIES[name](spark, DATA), registry.SQL[name])


def test_mix_takes_what_it_aims_at(spark):
    rows = mixing.mix_copies(spark, table(spark, "documents", "/root/testdata/sf0.1")).collect()
    aims, took = {}, Counter()
    for r in rows:
        aims[r.source] = (r.target, r.source_size)
        took[r.source] += r.size * r.copies
        assert 0 <= r.copies <= 2
    total = sum(s for _, s in aims.values())
    assert sum(t for t, _ in aims.values()) == pytest.approx(1.5 * total)
    for s, (t, size) in aims.items():
        assert t <= 2 * size and abs(took[s] - t) < 0.05 * t


def test_mix_with_far_ids_and_repeats(spark):
    """One far id, null ids and repeated rows: ranks stay those of the whole order, and no cut holds most rows."""
    rows = [(i, "a b c"[: i % 6], "s") for i in range(6000)] + [(1 << 60, "w", "s")] + [(None, "x y", "s")] * 4000 + [(7, "q", None)] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    parts = []
    kept, mixing.keep = mixing.keep, lambda *a: parts.append(kept(*a)) or parts[-1]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = Counter((r.doc_id, r.source, r.size, r.copies) for r in mixing.mix_copies(spark, docs).collect())
    finally:
        mixing.keep = kept
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    cuts = [r["count"] for r in parts[1].groupBy("cut").count().collect()]
    assert sum(cuts) == len(rows) and max(cuts) < 0.5 * len(rows)
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([{"doc_id": a, "text": b, "source": c} for a, b, c in rows]))
    want = Counter((r[0], r[2], r[1], r[3]) for r in con.execute(f"SELECT doc_id, size, source_size, taken FROM ({mixing.SQL})").fetchall())
    sizes = {s: sum(k[2] * n for k, n in got.items() if k[1] == s) for s in ("s", None)}
    mine = Counter()
    for (i, s, size, copies), n in got.items():
        mine[i, sizes[s], size, size * copies] += n
    assert mine == want


def test_copies_stay_within_the_cap(spark):
    """Far along, where sums of doubles round, an expectation of two copies still gives two."""
    t = spark.range(1 << 22, (1 << 22) + 20000).selectExpr("id + 9007199254700000 as rank", "1 - 1e-16 as u")
    for each in (2.0, 1.9999999999, 0.7):
        got = {r[0] for r in t.select(mixing.crossed(F.col("rank"), F.lit(each), F.col("u"))).distinct().collect()}
        assert max(got) <= math.ceil(each) and min(got) >= math.floor(each) or each == 0.7


def test_top_k_of_repeated_queries(spark):
    """Rows under one id: with equal vectors one query, with others each its own; blocks and rounds change nothing."""
    rng = np.random.default_rng(5)
    x = [(int(i), rng.integers(-90, 90, 20).astype(float).tolist()) for i in rng.permutation(400)]
    x += [(50, x[0][1]), (50, x[0][1]), (100, [1.0] * 20), (9, x[3][1])] + [(1000 + i, x[5][1]) for i in range(300)]
    t = spark.createDataFrame(x, "vec_id long, embedding array<double>").repartition(4)
    asked = t.filter("vec_id % 50 = 0")
    want = Counter()
    for q, v in {(i, tuple(v)) for i, v in x if i % 50 == 0}:
        scores = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(v, w, strict=True)), i) for i, w in x if i != q)[:5]
        want.update((q, r, i, -s) for r, (s, i) in enumerate(scores, 1))
    for block, size in ((4096, 1 << 20), (64, 300)):
        assert Counter(map(tuple, topk_search.search(spark, asked, t, block=block, round_bytes=size).collect())) == want


def test_top_k_like_brute_force():
    rng = np.random.default_rng(0)
    for n, dims in ((0, 4), (1, 4), (40, 3), (300, 50)):
        c, ids = rng.integers(-300, 300, (dims, n)).astype(float), rng.permutation(n).astype(np.int64)
        q, own = c[:, ::7], ids[::7]
        got = topk_search.best(own, q, ids, c, 5)
        want = []
        for i, o in enumerate(own):
            s = sorted(((-int(q[:, i] @ c[:, j]), int(ids[j])) for j in range(n) if ids[j] != o))[:5]
            want += [(int(o), j, -v) for v, j in s]
        assert list(zip(*(x.tolist() for x in got), strict=True)) == want
    big = np.array([[2.0**30], [2.0**30]])
    assert topk_search.best(np.array([0]), big, np.array([1]), big, 5)[2].tolist() == [2**61]


def test_links_like_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 24))
    x = np.concatenate([base, base[rng.integers(0, 60, 500)] + rng.standard_normal((500, 24)) * 0.22, np.repeat(base[:1], 40, 0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), block=32).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    found = sum(r.n_links for r in got.values())
    assert 0.98 * near.sum() <= found <= near.sum() and all(got[i].n_links <= near[i].sum() for i in got)
    assert all(got[i].n_links >= 40 for i in (0, 560))
    assert all(r.component_id <= r.vec_id and r.kept == (r.component_id == r.vec_id) for r in got.values())


def test_copies_cost_no_pairs(spark, monkeypatch):
    """Equal vectors are hashed and compared once; a class of many ids is dealt by salt."""
    monkeypatch.setattr(embedding_dedup, "HOT", 100)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 16))
    near = x[:1] + rng.standard_normal((5, 16)) * 0.05
    vectors = [*np.repeat(x[:1], 20000, 0), *near, *x[1:], *x[1:50]]
    met = []
    inner = embedding_dedup._verify
    monkeypatch.setattr(embedding_dedup, "_verify", lambda *a: met.append(a) or inner(*a))
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark, t).collect()}
    assert met and len(got) == len(vectors)
    u = np.array(vectors[19999 : 19999 + 305])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    assert links[0, 1:6].all()
    hot = 19999 + int(links[0].sum())
    assert {got[i].n_links for i in range(20000)} == {hot} and {got[i].component_id for i in range(20000)} == {0}
    for k in range(1, 6):
        assert got[19999 + k].n_links == 20000 + int(links[k, 1:].sum()) and got[19999 + k].component_id == 0
    assert all(got[20303 + k].component_id == 20004 + k for k in range(1, 50))


def test_ids_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 1.0]), (5, [1.0, 1.0]), (5, None)]
    got = sorted(map(tuple, embedding_dedup.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == [(1, 3, 1, True), (1, 3, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False), (5, 0, 5, True), (5, 0, 5, True)]


def test_hadamard():
    x = np.random.default_rng(0).standard_normal((5, 16))
    assert np.allclose(np.linalg.norm(embedding_dedup.hadamard(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(embedding_dedup.hadamard(embedding_dedup.hadamard(x)), x)


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(p) > 255 for p in m[0].split(".")) or k == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits)) or k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_spans_with_one_start_stand_by_kind():
    field = pii.train(np.zeros((1 << pii.BITS, 5)), np.zeros((5, 5)), np.zeros((5, 5)))
    for text, want in (
        ("4111111111111111@x.com", [(0, 22, 0), (0, 16, 2)]),
        ("1.2.3.4@x.com", [(0, 13, 0), (0, 7, 1)]),
        ("+14155552671@x.com", [(0, 18, 0), (0, 12, 3)]),
        ("000000000000.1.1.1", [(0, 18, 1), (0, 12, 2)]),
    ):
        assert pii.base_spans(text) == want and [s[:3] for s in field.label([text])[0]] == want
    assert pii.redact("x 4111111111111111@x.com y", [(2, 18, 2, True), (2, 24, 0, True)]) == "x [CARD] y"


def test_field_adds_what_patterns_drop_and_ignores_its_batch(spark):
    """A phone that runs on into the next number is dropped by its pattern; the field finds it, whatever texts stand beside it."""
    field = pii.fit(spark, table(spark, "documents", "/root/testdata/sf0.1"))
    text = "ment oument +1 (826) 555-4081 190.137.223.204 du anvio"
    assert plain_spans(text) == [(30, 45, 1)]
    alone = field.label([text])[0]
    assert [(text[s:e], pii.KINDS[k], b) for s, e, k, b in alone] == [("+1 (826) 555-4081", "phone", False), ("190.137.223.204", "ip", True)]
    rnd = random.Random(8)
    pool = [r.text or "" for r in table(spark, "documents", SMALL).limit(300).collect()] + ["a@b.co c@d.ef " * 40, "+1 (555) 555-1234 5551234 " * 30]
    first = {t: field.label([t])[0] for t in pool}
    for _ in range(3):
        rnd.shuffle(pool)
        assert field.label([*pool, text]) == [*(first[t] for t in pool), alone]


def test_base_spans_like_plain_patterns():
    rnd = random.Random(1)
    parts = ["a", "@", ".", "1", "23", "+", "-", " ", "(", "b.c", "x@y.z", "1.2.3.4", "+1 (555) 555-1234", "4111111111111111", "é", "\n", "%"]
    for _ in range(8000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))
        assert pii.base_spans(text) == plain_spans(text)


def test_personal_data(spark):
    docs = table(spark, "documents", SMALL)
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    rows = registry.QUERIES["op4_pii"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain_spans(texts[r.doc_id])
        names = [f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest() and set(names) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, _, k in spans) for i in range(4)]
    field = pii.fit(spark, docs)
    text = "Call +1 (988) 555-2485 today. Later dial 988-555-2485 or 5552485. There were 1234567 cats in 2019."
    assert [(text[s:e], b) for s, e, k, b in field.label([text])[0] if k == 3] == [("+1 (988) 555-2485", True), ("988-555-2485", False), ("5552485", False)]


def test_toxicity_held_out(spark):
    rnd = random.Random(2)
    words = [f"{a}{b}" for a in ("the", "ing", "tion", "and", "or", "est") for b in ("re", "ly", "ou", "ha", "in", "ed")]
    rows, labels = [], []
    for i in range(3000):
        w = [rnd.choice(words) for _ in range(rnd.randrange(30, 90))]
        toxic = rnd.random() < 0.15
        if toxic:
            for _ in range(rnd.randrange(1, 4)):
                w.insert(rnd.randrange(len(w)), rnd.choice(["blockhead", "nincompoop", "zorkling" + rnd.choice("abcdef")]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    grammar = toxicity.fit(spark, docs, known.filter("doc_id % 4 <> 0"))
    got = {r.doc_id: r.predicted for r in toxicity.score(spark, docs, grammar).collect()}
    wrong = sum(got[i] != y for i, y in labels if i % 4 == 0)
    assert wrong <= 5


def clauses(grammar, text):
    return Counter((toxicity.PARTS[i], toxicity.PARTS[t]) for (i, t), n in grammar.patterns(text).items() for _ in range(n))


def test_grammar_composes():
    g = toxicity.Grammar({"fool": 1.0, "idio*": 1.0})
    plain, aimed, after = (0, 0, "none"), (0, 0, "before"), (0, 0, "after")
    for text, want in (
        ("You are a fool. Fine day", [(aimed, None)]),
        ("A fool, he thought", [(plain, None)]),
        ("fool that you are", [(after, None)]),
        ("you are not a fool", [((1, 0, "before"), None)]),
        ("fool you not", [(after, None)]),
        ("not you fool", [((1, 0, "before"), None)]),
        ("fool, not", [(plain, None)]),
        ("not that it would matter much, fool", [(plain, None)]),
        ("not one of us ever thought them fools, fool", [(plain, None)]),
        ("He said a fool, a fool", [((0, 1, "before"), None), ((0, 1, "none"), None)]),
        ('"You fool" is what she heard; you fool', [((0, 1, "before"), None), (aimed, None)]),
        ("fool, he said", [(plain, None)]),
        ("I will kill you; foolish wind. Nothing", [(None, after)]),
        ("they say I never kill idiots", [((1, 1, "before"), (1, 1, "before"))]),
        ("not a fool but in all else you fool", [(aimed, None)]),
        ("nothing here", []),
        ("", []),
    ):
        assert clauses(g, text) == Counter(want), text


def plain_clauses(g, text):
    """The same by loops over the words of each clause."""
    out = Counter()
    for sentence in re.split(r"(?<=[.!?\n])", (text or "").lower()):
        said = quoted = False
        clause, words = [], re.findall(toxicity._TOKEN, sentence)
        for w in [*words, "."]:
            if w in set(toxicity.CLAUSE):
                for kind in ("insult", "threat"):
                    found = []
                    for i, (k, excused) in enumerate(clause):
                        if k == kind:
                            before = [x for x, _ in clause[max(0, i - toxicity.SCOPE) : i]]
                            aims = [j for j, (x, _) in enumerate(clause) if x == "target"]
                            found.append((int("negation" in before), int(excused), "before" if any(j < i for j in aims) else "after" if any(j > i for j in aims) else "none"))
                    clause.append((kind, found))
                insult, threat = (x[1] for x in clause[-2:])
                if insult or threat:
                    out[bool(insult), bool(threat), tuple(sorted({p[:2] for p in insult})), tuple(sorted({p[:2] for p in threat}))] += 1
                clause = []
                if w in set(toxicity.SENTENCE):
                    said = quoted = False
                continue
            k = toxicity.SYMBOLS[g.symbol(w)]
            if k == "quote":
                quoted = not quoted
                continue
            clause.append((k, said or quoted))
            said |= k == "report"
    return out


def test_grammar_like_loops():
    g = toxicity.Grammar({"fool": 1.0, "idio*": 1.0})
    rnd = random.Random(9)
    words = ["you", "not", "said", "fool", "idiots", "kill", '"', ",", ".", "a", "the", "never", "them", "x"]
    for _ in range(4000):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(16)))
        want = plain_clauses(g, text)
        got = Counter()
        for (i, t), n in clauses(g, text).items():
            got[i is not None, t is not None] += n
        assert got == Counter(k[:2] for k, n in want.items() for _ in range(n)), text
        for (i, t), _ in clauses(g, text).items():
            assert any((i is None) == (not w[2]) and (t is None) == (not w[3]) and (i is None or i[:2] in w[2] and sum(i[:2]) == min(map(sum, w[2]))) and (t is None or t[:2] in w[3] and sum(t[:2]) == min(map(sum, w[3]))) for w in want), text


def test_every_match_counts_and_long_texts_are_walked_once():
    w = toxicity.untrained()
    g = toxicity.Grammar({"fool": 1.0}, w)
    x = [g.features("you fool, " * n)[1 + toxicity.PARTS[1:].index((0, 0, "before"))] for n in (1, 4, 5, 50)]
    assert x == sorted(set(x)) and x[0] == 1
    began = time.time()
    assert sum(g.patterns("a fool? " * 60000).values()) == 60000
    assert time.time() - began < 20


def test_language_held_out(spark):
    rows = {r.doc_id: r for r in registry.QUERIES["op7_language"](spark, SMALL).collect()}
    langs = dict(connect(SMALL).execute("SELECT doc_id, lang FROM documents").fetchall())
    held = [i for i in rows if rows[i].held_out]
    assert held and all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in rows)
    assert sum(rows[i].lang_pred == langs[i] for i in held) >= 0.97 * len(held)


def test_distance_like_plain_ranks(spark):
    """The query's languages and scores against out-of-place distances by plain sorting and sums."""
    docs = table(spark, "documents", SMALL)
    top = 300
    profiles = language.fit(spark, docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    place = {lang: {int(h): r for r, h in enumerate(profiles.known[np.argsort(profiles.table[:-1, j], kind="stable")][: (profiles.table[:-1, j] < top).sum()])} for j, lang in enumerate(profiles.langs)}
    rows = {r.doc_id: r for r in registry.QUERIES["op7_language"](spark, SMALL).collect()}
    for doc in docs.limit(120).collect():
        data, offsets = common.utf8(pa.array([doc.text]))
        keys, counts, _ = language.grams(data, offsets)
        own = sorted(zip((-counts).tolist(), (keys & np.uint64((1 << 40) - 1)).tolist(), strict=True))[:top]
        distance = {lang: sum(abs(p[h] - r) if h in p else top for r, (_, h) in enumerate(own)) for lang, p in place.items()}
        best = min(distance, key=lambda x: (distance[x], x))
        assert rows[doc.doc_id].lang_pred == best and rows[doc.doc_id].score == pytest.approx(1 - distance[best] / (top * len(own)))


def test_sample_of_a_language_is_bounded(spark):
    """Those first by the hash, as many as asked for, whatever the language's share of the rows."""
    rows = [(i, f"text {'abcdefgh'[i % 8] * 3}", "en" if i % 50 else "fr") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    profiles = language.fit(spark, docs, per_lang=40)
    assert profiles.langs == ["en", "fr"]
    first = docs.filter("lang = 'en'").withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 11)).orderBy("h").limit(40).select("doc_id", "text", "lang")
    fr = docs.filter("lang = 'fr'").withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 11)).orderBy("h").limit(40).select("doc_id", "text", "lang")
    want = language.fit(spark, first.unionByName(fr), per_lang=40)
    assert (profiles.known == want.known).all() and (profiles.table == want.table).all() and profiles.least == want.least


def test_unlearned_languages_go(spark):
    docs = table(spark, "documents", SMALL)
    profiles = language.fit(spark, docs)
    other = ["Bu gün hava çok güzel ve biz parka gidiyoruz arkadaşlarımla birlikte", "Litwo ojczyzno moja ty jesteś jak zdrowie ile cię trzeba cenić ten tylko się dowie", "Широка страна моя родная много в ней лесов полей и рек"]
    added = spark.createDataFrame([(10**6 + i, t, None, "x", len(t)) for i, t in enumerate(other)], docs.schema)
    kept = {r.doc_id for r in language.keep_identified(spark, docs.unionByName(added), profiles).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert max(kept) < 10**6 and kept == {i for i, t in texts.items() if re.search(r"[^\W\d_]", t or "")}


def test_rank_order_like_plain_counts():
    text = "Été, the theme: a THE end!"
    words = re.findall(r"[^\W\d_]+", text.lower())
    want = Counter()
    for w in words:
        p = f"_{w}_"
        want.update(g for n in (1, 2, 3) for i in range(len(p) - n + 1) if (g := p[i : i + n]) != "_")
    data, offsets = common.utf8(pa.array([text]))
    _, counts, seen = language.grams(data, offsets)
    assert sorted(counts.tolist()) == sorted(want.values()) and seen.tolist() == [sum(map(len, words))]


VOCAB = lattice.Vocab.read()


def plain_viterbi(text):
    known = dict(zip(VOCAB.pieces, VOCAB.scores.tolist(), strict=True))
    x = "▁" + text.replace(" ", "▁") if text else ""
    best, count = [None] * (len(x) + 1), [0] * (len(x) + 1)
    best[0] = 0
    for i in range(len(x)):
        alone = False
        for j in range(i + 1, min(len(x), i + 16) + 1):
            s = known.get(x[i:j])
            if s is not None:
                alone |= j == i + 1
                if best[j] is None or best[i] + s > best[j]:
                    best[j], count[j] = best[i] + s, count[i] + 1
        if not alone and (best[i + 1] is None or best[i] + VOCAB.unknown > best[i + 1]):
            best[i + 1], count[i + 1] = best[i] + VOCAB.unknown, count[i] + len(x[i].encode())
    return count[-1], best[-1]


def test_counts_like_plain_viterbi_and_library():
    from tokenizers import Tokenizer, models

    rnd = random.Random(3)
    parts = ["a", "the", "ing", " ", "  ", "é", "あ", "\n", "tion", "1", "▁", "\x00"]
    texts = ["", "a", "  ", " a", "a ", "x" * 300] + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(600)]
    counter = token_count.Counter(VOCAB)
    got = [counter.of([t]) for t in texts]
    assert [(int(c[0]), int(s[0])) for c, s in got] == [plain_viterbi(t) for t in texts]
    unk = float(VOCAB.unknown + lattice.UNKNOWN)
    own = Tokenizer(models.Unigram([("<unk>", unk), *((f"<0x{b:02X}>", unk) for b in range(256)), *zip(VOCAB.pieces, map(float, VOCAB.scores), strict=True)], unk_id=0, byte_fallback=True))
    for t in [r[0] for r in connect().execute("SELECT text FROM documents LIMIT 60").fetchall()]:
        assert len(own.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) == counter.of([t])[0][0]


def test_count_query_like_plain_viterbi(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, "documents").collect()}
    rows = registry.QUERIES["op2_token_count"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if len(texts[r.doc_id]) < 4000:
            n, score = plain_viterbi(texts[r.doc_id])
            assert r.n_tokens == n and r.best_score == pytest.approx(score / 1000)


def segmentations(x, known):
    if not x:
        yield (), 0
    for j in range(1, len(x) + 1):
        if x[:j] in known:
            for rest, s in segmentations(x[j:], known):
                yield (x[:j], *rest), s + known[x[:j]]


def test_samples_without_replacement():
    known = dict(zip(VOCAB.pieces, VOCAB.scores.tolist(), strict=True))
    alpha, n = 0.3, 6000
    every = list(segmentations("▁the▁at", known))
    p = np.array([math.exp(alpha * s / 1000) for _, s in every])
    p /= p.sum()
    number = {g: i for i, (g, _) in enumerate(every)}
    piece = dict(zip(VOCAB.ids.tolist(), VOCAB.pieces, strict=True))
    encoder = sampling.Encoder(VOCAB, alpha)
    counts, estimate = np.zeros((2, len(p))), np.zeros(len(p))
    for found in encoder.samples(["the at"] * n, np.arange(n).astype(np.uint64), 2, 1):
        ids = [number[tuple(piece[i] for i in f[0].tolist())] for f in found]
        assert len(set(ids)) == 2 and found[0][2] > found[1][2]
        for k, (i, f) in enumerate(zip(ids, found, strict=True)):
            counts[k, i] += 1 / n
            estimate[i] += p[i] / math.exp(f[3]) / n
            assert f[1] == pytest.approx(math.log(p[i]), abs=1e-6)
    second = [sum(p[j] * p[i] / (1 - p[j]) for j in range(len(p)) if j != i) for i in range(len(p))]
    assert abs(counts[0] - p).max() < 0.02 and abs(counts[1] - second).max() < 0.02 and abs(estimate - p).max() < 0.02


def test_samples_are_distinct_and_decode(spark):
    rows = sampling.encode(spark, table(spark, "documents"), k=3).collect()
    by = {}
    for r in rows:
        assert r.decodes
        by.setdefault(r.doc_id, []).append(r.ids_md5)
    assert all(len(set(x)) == 3 for x in by.values())
    again = sampling.encode(spark, table(spark, "documents").repartition(7), k=3).collect()
    assert sorted((r.doc_id, r.sample, r.ids_md5) for r in rows) == sorted((r.doc_id, r.sample, r.ids_md5) for r in again)


def test_url_models():
    counts = Counter()
    for url in ("http://a.com/x", "http://b.com/yy", "http://c.com/"):
        t = url_filter.BEGIN + url + url_filter.END
        for i in range(1, len(t)):
            for k in range(min(4, i) + 1):
                counts[t[i - k : i + 1]] += 1
    letters = {g for g in counts if len(g) == 1}
    m = url_filter.Markov(counts, len(letters) + 1, 4, 1 << 14)
    for context in ("", "h", "com", "zzz"):
        assert sum(math.exp(m.logp(context, c)) for c in letters) + math.exp(m.logp(context, "\x7f")) == pytest.approx(1, abs=1e-9)


def test_url_verdicts(spark):
    pages = table(spark, "pages", SMALL)
    rows = url_filter.judge_urls(spark, pages, url_filter.fit(spark, pages)).collect()
    rules = dict(url_filter.RULES)
    for r, url in zip(sorted(rows, key=lambda r: r.page_id), [x.url for x in pages.orderBy("page_id").collect()], strict=True):
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0].lower()
        path = re.split("[?#]", rest[len(host) :])[0]
        fits = [k for k in rules if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith("/" + k.split("/", 1)[1])]
        assert (r.host, r.path, r.rule) == (host, path, max(fits, key=len, default=None))
        assert r.verdict == (rules[r.rule] if r.rule else "allow" if r.evidence >= r.cut else "block")
    told = [r for r in rows if r.rule]
    assert sum((r.evidence >= r.cut) == (r.verdict == "allow") for r in told) >= 0.95 * len(told)


def brute_groups(texts, width, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize(("width", "percent", "split"), [(4, 85, 4096), (4, 85, 3), (2, 80, 2), (1, 60, 2)])
def test_jaccard_groups_like_brute_force(spark, width, percent, split):
    rnd = random.Random(5)
    base = [[rnd.choice("abcdefghijkl") for _ in range(rnd.randrange(1, 60))] for _ in range(25)]
    texts = []
    for _ in range(220):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            if w:
                j = rnd.randrange(len(w))
                w[j : j + 1] = rnd.choice([[], [rnd.choice("abcxyz")], [w[j], "q"]])
        texts.append(" ".join(w))
    texts += [None, "", " ", "A b", "a B", "x"]
    rows = jaccard_join.Join(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), width, percent, split).run().orderBy("doc_id").collect()
    assert ([r.n_shingles for r in rows], [r.component_id for r in rows]) == brute_groups(texts, width, percent)


def test_pipeline_like_its_parts(spark):
    import corpus_pipeline

    docs = table(spark, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    out = corpus_pipeline.run(spark, DATA)
    ids = Counter(r.doc_id for r in out.collect())
    order = sorted(rows)
    _, groups = brute_groups([rows[i].text for i in order], 5, 80)
    kept = [i for k, i in enumerate(order) if groups[k] == k]
    assert set(ids) <= set(kept) and max(ids.values()) <= 2
    field = pii.fit(spark, docs.filter(F.col("doc_id").isin(kept)))
    masked = {i: t if not (s := field.label([t])[0]) else pii.redact(t, s) for i, t in ((i, rows[i].text) for i in kept)}
    left = spark.createDataFrame([(i, masked[i], rows[i].source) for i in kept], "doc_id long, text string, source string")
    want = {r.doc_id: r.copies for r in mixing.mix_copies(spark, left).collect() if r.copies}
    assert ids == want
    samples = Counter((r.doc_id, r.sample) for r in out.collect())
    assert set(samples.values()) == {1} and {n for _, n in samples} <= {1, 2}
    decoded = {r.doc_id: r.text for r in sampling.decode(spark, out).collect()}
    assert decoded == {i: masked[i] for i in want}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "jaccard", "pii", "mix", "encode"]


def test_pipeline_edges(spark, tmp_path):
    """Empty tables, null ids and texts, repeated rows, and columns with the operators' own names."""
    import corpus_pipeline

    extra = "score double, kept boolean, n string, component string, cells string, copies int, part string, `odd name` string"
    words = "der und die das ist nicht ein eine mit für auf dem den von zu im".split()
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(words) for _ in range(30)), "de", "s") for i in range(30)]
    rows += [rows[0], (None, rows[1][1], "de", None), (None, "noch ein text ohne nummer und mit worten", None, "s"), (100, None, "de", "s"), (101, "", None, None), (102, "schreib an a.b@c.de und an niemand sonst", "de", "t")]
    for name, some in (("full", rows), ("none", [])):
        docs = spark.createDataFrame([(*r, len(r[1] or ""), 1.0, True, "n", "c", "x", 7, "p", "o") for r in some], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
        docs.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs_out = stage(spark, docs, "")
            assert docs_out.columns == docs.columns
        out = corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").collect()
        texts = {r.doc_id: r.text for r in sampling.decode(spark, spark.createDataFrame(out, corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").schema)).collect()} if out else {}
        assert bool(out) == bool(some) and {100, 101}.isdisjoint(texts) and "schreib an [EMAIL] und an niemand sonst" in (texts.get(102) or "schreib an [EMAIL] und an niemand sonst")


def test_url_models_keep_rare_contexts(spark):
    """With far more than 16,384 characters, contexts seen once still count: evidence as of whole models in one process."""
    rows = [f"http://x{i:04d}.example.com/en/{i * 7919 % 10007}" for i in range(700)] + [f"http://www.example.com/en/{i * 31 % 5003}?q={i}" for i in range(700)] + [f"http://x{i}.example.org/é{i}" for i in range(50)]
    pages = spark.createDataFrame(list(enumerate([*rows, None, ""])), "page_id long, url string")
    known, counts = url_filter.Rules(url_filter.RULES), {"allow": Counter(), "block": Counter()}
    for url in rows:
        verdict = known.find(*url_filter.split_url(url))[1]
        if verdict and not url_filter._held(url):
            t = url_filter.BEGIN + url + url_filter.END
            counts[verdict].update(t[i - k : i + 1] for i in range(1, len(t)) for k in range(min(4, i) + 1))
    letters = len({g for c in counts.values() for g in c if len(g) == 1})
    plain = {v: url_filter.Markov(c, letters + 1, 4) for v, c in counts.items()}
    cut_off = url_filter.Markov(counts["block"], letters + 1, 4, 1 << 14)
    assert len(cut_off.step) < len(plain["block"].step)
    got = {r.page_id: r.evidence for r in url_filter.judge_urls(spark, pages, url_filter.fit(spark, pages)).collect()}
    assert len(got) == len(rows) + 2 and got[len(rows)] == got[len(rows) + 1] == 0
    for i, url in enumerate(rows):
        assert abs(got[i] - (plain["allow"].of(url) - plain["block"].of(url)) / (len(url) + 1)) < 1e-9


def test_many_samples_and_copies(spark):
    """More samples than the counter has room for; a row's copies take its samples in turn, whatever stands beside it."""
    found = sampling.Encoder(VOCAB, 0.3).samples(["the cat and the hat"], np.array([5], np.uint64), 40, 1)[0]
    assert len({tuple(f[0].tolist()) for f in found}) == 40 and [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
    rows = [(1, "the cat sat", 2), (2, "a", 3), (3, None, 2), (4, "", 2), (5, "some other words here", 5)]
    make = lambda r: sorted((x.doc_id, x.sample, x.ids_md5, x.inclusion) for x in sampling.encode(spark, spark.createDataFrame(r, "doc_id long, text string, copies int").coalesce(1), copies_col="copies").collect())
    got = make(rows)
    assert Counter(x[0] for x in got) == {1: 2, 2: 3, 3: 2, 4: 2, 5: 5} and got == sorted(x for r in rows for x in make([r]))
    assert len({x[2] for x in got if x[0] == 1}) == 2 and len({x[2] for x in got if x[0] == 5}) == 5
    plain = sampling.encode(spark, spark.createDataFrame(rows, "doc_id long, text string, copies int")).filter("doc_id = 1").collect()
    assert sorted((x.doc_id, x.sample, x.ids_md5, x.inclusion) for x in plain) == [x for x in got if x[0] == 1]


def test_sampling_query_returns_ids(spark):
    rows = registry.QUERIES["op6_sampling"](spark, DATA)
    texts = {r.doc_id: r.text for r in table(spark, "documents", DATA).collect()}
    got = sampling.decode(spark, rows).collect()
    assert {r.doc_id for r in got} == set(texts)
    assert all(r.text == (None if texts[r.doc_id] is None else texts[r.doc_id].replace(lattice.MARK, " ")) for r in got)
