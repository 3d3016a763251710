"""Every operator and every pipeline stage on awkward rows and on an empty table."""

import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontam, jaccard, langid, license, media, packing, quality, sharding, tokencount, urlrules

IDS = sorted([1, 1, 2, 3, 4, 5, 6, 7])


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect() if r.doc_id is not None)


OPERATORS = {
    "op1": quality.classify, "op2": license.scan, "op4": langid.identify, "op6": sharding.assign, "op7": tokencount.count_tokens,
    "op8": lambda d: media.media_features(media.store_media(d)), "op10": jaccard.near_duplicates,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each(name, edge, empty):
    out = OPERATORS[name](edge)
    assert out.count() == 9 and ids(out) == IDS
    assert OPERATORS[name](empty).count() == 0


def test_quality_values(edge):
    got = {r.doc_id: r for r in quality.classify(edge).collect()}
    assert got[3].score == got[4].score == 0 and not got[3].kept
    assert got[1].score == got[2].score
    kept = quality.keep_good(edge)
    assert kept.columns == edge.columns and {3, 4}.isdisjoint(ids(kept))


def test_license_values(edge):
    got = {r.doc_id: r for r in license.scan(edge).collect()}
    assert (got[7].n_words, got[7].n_base, got[7].first_word, got[7].last_word, got[7].base_labels) == (16, 3, 3, 14, "gpl,mit")
    assert got[7].labels == "gpl,gpl-3.0,mit" and got[7].score == 1.0
    assert (got[3].n_words, got[3].n_base, got[3].first_word, got[3].base_labels, got[3].labels, got[3].score) == (0, 0, None, "", "", 0.0)


def test_language_values(edge, empty):
    got = {r.doc_id: r for r in langid.identify(edge).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[6].lang_pred == "und" and got[6].score == 0
    assert got[1].lang_pred == "en"
    none = langid.identify(edge, langid.Model(empty.selectExpr("lang", "1L code", "1L n").toPandas())).collect()
    assert all(r.lang_pred == "und" and r.accepted for r in none)


def test_packing_values(edge, empty):
    rows = packing.pack(edge).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert [r.length for r in rows if r.doc_id == 3] == [1]
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 5)
    assert all(n == packing.CAPACITY for _, _, n in long[:-1]) and [p for p, _, _ in long] == list(range(len(long))) and long[1][1] == packing.CAPACITY
    assert packing.pack(empty).count() == 0


def test_sharding_values(edge):
    rows = sharding.assign(edge, 4).collect()
    sizes = sorted(sum(r.shard == s for r in rows) for s in range(4))
    assert sizes == [2, 2, 2, 3] and {r.law for r in rows} == {"rows"}
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert [(r.size, r.text_crc32) for r in rows if r.doc_id == 3] == [(16, 0)]


def test_media_values(edge):
    got = {r.doc_id: r for r in media.media_features(media.store_media(edge)).collect()}
    assert (got[3].n_bytes, got[3].payload_bytes) == (0, 64) and got[3].media_sha256 == got[4].media_sha256
    assert got[1].feature == got[2].feature and got[5].payload_bytes % 64 == 0


def test_jaccard_values(edge):
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(edge).collect()}
    assert got[1] == got[2] == (1, 2) and got[3] == (3, 0) and got[4] == (4, 0) and got[None] == (None, 0)
    kept = jaccard.keep_one(edge)
    assert kept.columns == edge.columns and ids(kept) == [1, 3, 4, 5, 6, 7] and kept.count() == 7


def test_decontamination_values(spark, edge, empty):
    bench = spark.createDataFrame([(1, "the old tree stands near the house. It is quiet"), (2, None), (3, "a b"), (None, "jumps over the lazy dog and runs on the")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(edge, bench).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (5, None)]
    assert ids(decontam.keep_clean(edge, bench)) == [3, 4, 6, 7]
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.keep_clean(empty, bench).count() == 0
    assert decontam.contaminated(edge, bench.limit(0)).count() == 0


def test_url_values(spark):
    urls = ["https://A.Example.com/en/7x?q=1", "http://m.example.com/en/8", "https://x.net/de/1#f", "https://b.example.net/de/8/9", "http://y.org/es/", "http://z.org/fr/1", None, "no scheme", "", "https://example.com.evil.org/en/7"]
    rows = spark.createDataFrame([(i, u, "<p>", "block") for i, u in enumerate(urls)] * 2 + [(None, urls[0], None, None)], "page_id long, url string, html string, verdict string")
    out = urlrules.judge(rows)
    assert out.count() == 21
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[1] == ("m.example.com", "/en/8", "com/en/", "block")
    assert got[2][2:] == ("net/de/", "allow") and got[3][2:] == ("example.net/de/8", "block") and got[4][2:] == ("org/es/", "block")
    assert got[6] == got[7] == got[8] == ("", "", None, "allow") and got[9][2] is None
    assert urlrules.judge(rows.limit(0)).count() == 0


def test_token_edits_from_a_table(spark, edge):
    edits = spark.createDataFrame([(1, 1, 0, 3, "A"), (1, 2, 5, 0, " new words "), (3, 1, 0, 0, "three new words"), (4, 1, 99, 5, "x")], "doc_id long, seq int, pos long, n_delete long, insert string")
    docs = tokencount.attach_edits(edge, edits.unionByName(edits.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))))
    assert docs.columns == [*edge.columns, "edits"] and docs.count() == edge.count() and docs.where("doc_id is null").first().edits[0].insert == "three new words"
    got = {r.doc_id: r for r in tokencount.count_tokens(docs, F.col("edits")).collect()}
    assert (got[3].n_tokens, got[3].n_tokens_edited) == (0, 3) and got[4].n_tokens_edited == 1 and got[2].n_tokens == got[2].n_tokens_edited


def test_stages(spark, edge, empty, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "jumps over the lazy dog and runs on")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (edge, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == (0 if docs is empty else packing.pack(docs).count())
