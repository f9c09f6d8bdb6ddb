"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import math

import pytest
from pyspark.sql import functions as F

from framelake.llm import embedding_dedup, jaccard_join, language, mixing, pii, sampling, token_count, topk_search, toxicity, url_filter

LONG = "word " * 5000 + "x" * 30000
TEXTS = [None, "", "   \n\t", "a", "\x00", LONG, "Été à la plage, ÉTÉ!", "mail a.b@c.de or +1 (555) 555-1234 now", "same text here for all of us", "same text here for all of us", "日本語のテキスト", "🙂🙂 ▁ <0x0A>", "+" * 50 + "@" * 50 + "." * 50, "1" * 3000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, n string, size string, id string, part string, component_id string, rank int, `odd name` string"


def _docs(spark, rows=None):
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2"][i % 3], None if t is None else len(t)) for i, t in enumerate(TEXTS)] if rows is None else rows
    rows = rows + [(None, "no id at all", None, None, 3), (3, "a", "en", "s1", 1)] if rows else rows
    return spark.createDataFrame([(*r, 1.0, True, "x", "y", "z", "p", "c", 1, "o") for r in rows], SCHEMA)


@pytest.fixture(params=["full", "empty"])
def docs(request, spark):
    return _docs(spark) if request.param == "full" else _docs(spark, [])


def test_token_count(spark, docs):
    got = token_count.count_tokens(spark, docs).collect()
    assert len(got) == docs.count()
    assert all(r.n_tokens == 0 for r in got if r.doc_id in (0, 1))


def test_pii(spark, docs):
    field = pii.fit(spark, docs)
    got = pii.find_spans(spark, docs, field).collect()
    assert len(got) == docs.count()
    assert all(not r.spans for r in got if r.doc_id in (0, 1, 2))
    masked = pii.mask(spark, docs, field)
    assert masked.columns == docs.columns
    rows = {r.doc_id: r for r in masked.collect()}
    if rows:
        assert rows[7].text == "mail [EMAIL] or [PHONE] now" and rows[7].n_chars == len(rows[7].text)
        assert rows[0].text is None and rows[0].n_chars is None and rows[8].text == TEXTS[8]


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(8, 1), (9, 1), (7, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        got = toxicity.score(spark, docs, toxicity.fit(spark, docs, known)).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_sampling(spark, docs):
    got = sampling.encode(spark, docs, k=3).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {r.doc_id for r in docs.collect()}
    for rows in by.values():
        for r in rows:
            assert r.decodes is None or r.decodes
    if by:
        assert by[0][0].ids is None and by[1][0].ids == []
        back = {(r.doc_id, r.sample): r.text for r in sampling.decode(spark, sampling.encode(spark, docs, k=1)).collect()}
        assert back[10, 1] == TEXTS[10] and back[5, 1] == LONG and back[0, 1] is None


def test_language(spark, docs):
    profiles = language.fit(spark, docs)
    got = {r.doc_id: r for r in language.identify(spark, docs, profiles).collect()}
    assert len(got) == docs.select("doc_id").distinct().count()
    for i in (0, 1, 2, 13):
        assert not got or (got[i].lang_pred, got[i].score) == ("und", 0.0)
    kept = language.keep_identified(spark, docs, profiles, least=0.0)
    assert kept.columns == docs.columns
    assert not got or {0, 1, 2, 13}.isdisjoint({r.doc_id for r in kept.collect()})
    plain = language.keep_identified(spark, docs, language.Profiles({}, 300))
    assert plain.columns == docs.columns and plain.count() <= docs.count()


def test_jaccard(spark, docs):
    got = jaccard_join.jaccard_groups(spark, docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    if by:
        assert by[9].component_id == 8 and by[0].n_shingles == 0 and by[None].component_id is None
    kept = jaccard_join.keep_one(spark, docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(str(i) for i in ids) == sorted(str(i) for i in ([*[i for i in range(14) if i != 9], None] if by else []))


def test_mixing(spark, docs):
    got = mixing.mix_copies(spark, docs).collect()
    assert len(got) == docs.count() and all(0 <= r.copies <= 2 for r in got)
    mixed = mixing.mix_documents(spark, docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in got)


VECTORS = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [math.nan, 1.0]), (8, [math.inf, 1.0]), (9, [3.0]), (None, [1.0, 0.0]), (2, [0.0, 2.0])]


def test_vectors(spark):
    t = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("keys", F.lit("x"))
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark, t).collect()}
    assert {i: got[i].n_links for i in (0, 1, 9)} == {0: 2, 1: 2, 9: 2} and got[9].component_id == 0
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(2, 9)) and got[None].component_id is None and not got[None].kept
    assert embedding_dedup.near_duplicates(spark, t.limit(0)).collect() == []
    found = topk_search.search(spark, t.filter("vec_id in (0, 3)"), t).collect()
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(9, 768 * 256), (1, 65536), (2, 0), (2, 0), (4, 0)]
    assert topk_search.search(spark, t.limit(0), t.limit(0)).collect() == []


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://X.Example.com/en/a?b"), (5, "https://www.example.com/en/"), (6, "http://a.net/es/1#x"), (6, "http://a.net/es/1#x"), (7, "ftp://foo.com"), (8, "http://foo.com/x"), (None, "http://b.org/q"), (9, "://é.com/ü")]
    pages = spark.createDataFrame([(*r, "h", "r") for r in rows], "page_id long, url string, host string, rule string")
    for t in (pages, pages.limit(0)):
        got = {r.page_id: r for r in url_filter.judge_urls(spark, t, url_filter.fit(spark, t)).collect()}
        if got:
            assert (got[4].host, got[4].path, got[4].rule, got[4].verdict) == ("x.example.com", "/en/a", "example.com/en/", "block")
            assert got[5].rule == "www.example.com/en/" and got[6].verdict == "block" and got[7].rule is None and got[8].rule == "com/"
            assert (got[1].host, got[1].path, got[3].host) == ("", "", "") and got[9].rule == "com/"


def test_urls_alike_are_spread(spark):
    """A page table of one URL, mostly: chunks stay small, and all its rows are judged alike."""
    rows = [(1, "http://shop.example.org/a/b")] * 30000 + [(None, None)] * 9000 + [(i, f"http://h{i % 50}.com/p{i}") for i in range(2, 3000)] + [(i, f"http://h{i % 50}.net/es/p{i}") for i in range(3000, 6000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(4)
    sizes = []
    kept, url_filter.keep = url_filter.keep, lambda s, df, *a, **k: (sizes.append(t := kept(s, df, *a, **k)), t)[1]
    try:
        got = url_filter.judge_urls(spark, pages, url_filter.fit(spark, pages)).groupBy("page_id", "verdict", "evidence").count().collect()
    finally:
        url_filter.keep = kept
    assert sum(r["count"] for r in got) == len(rows)
    assert [r["count"] for r in got if r.page_id == 1] == [30000] and [r["count"] for r in got if r.page_id is None] == [9000]
    dealt = [t for t in sizes if "chunk" in t.columns]
    assert dealt and all(t.groupBy("chunk").count().agg(F.max("count")).first()[0] < 1.3 * url_filter.CHUNK for t in dealt)


def test_pipeline_encodes_many_rows_without_id(spark):
    """Thousands of rows alike that have no id: each is a row of the result, and none waits for the others' samples."""
    import corpus_pipeline

    docs = spark.createDataFrame([(None, "eins zwei drei", "x")] * 4000 + [(None, None, "x")] * 3 + [(1, "eins zwei drei", "x")] * 2, "doc_id long, text string, source string").repartition(4)
    got = corpus_pipeline.encoded(spark, docs, "").groupBy("doc_id", "sample", "decodes").count().collect()
    assert sorted((str(r.doc_id), r["sample"], str(r.decodes), r["count"]) for r in got) == [("1", 1, "True", 1), ("1", 2, "True", 1), ("None", 1, "None", 3), ("None", 1, "True", 4000)]
