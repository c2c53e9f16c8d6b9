"""Every operator and stage on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest

import corpus_pipeline
from corpus import SCHEMA, documents, odd_rows, prose
from sitegauge.llm import decontaminate, html_text, minhash, mixing, pii, preferences, quality, substrings, toxicity, urlfilter

LABELS = "doc_id bigint, quality int, toxic int"


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, 1, 0), (9, 0, 1), (None, 1, 1), (2, None, 0)], LABELS)


def benchmark(spark):
    return spark.createDataFrame([(1, prose(30, 77)), (2, None), (3, ""), (None, prose(20, 78))], "item_id bigint, text string")


PER_DOCUMENT = {
    "quality": lambda spark, docs: quality.judge_quality(docs),
    "near_duplicates": lambda spark, docs: minhash.near_duplicates(docs),
    "pii": lambda spark, docs: pii.find_pii(docs),
    "toxicity": lambda spark, docs: toxicity.judge_toxicity(docs, labels(spark)),
    "substrings": lambda spark, docs: substrings.remove_repeated(docs),
    "mixing": lambda spark, docs: mixing.mix(docs),
}


@pytest.mark.parametrize("name", list(PER_DOCUMENT))
def test_a_row_per_document(spark, name):
    docs = documents(spark, odd_rows(), clashing=True)
    rows = PER_DOCUMENT[name](spark, docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((d is None, d or 0) for d, _ in odd_rows())


@pytest.mark.parametrize("name", list(PER_DOCUMENT))
def test_an_empty_table(spark, name):
    assert PER_DOCUMENT[name](spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_stages_keep_columns_and_survive_odd_rows(spark, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, odd_rows(), clashing=True)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        assert docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_leaks_of_odd_rows(spark):
    docs = documents(spark, [*odd_rows(), (20, prose(30, 77)), (None, prose(20, 78))], clashing=True)
    rows = decontaminate.find_leaks(docs, benchmark(spark)).collect()
    assert sorted((r.doc_id or -1, r.item_id or -1, r.edits) for r in rows) == [(-1, -1, 0), (20, 1, 0)]
    assert decontaminate.without_leaks(docs, benchmark(spark)).count() == docs.count() - 2


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>" + "word " * 60_000), (None, "u", "no markup at all, but a sentence that goes on"),
            (4, "u", "<p>a<"), (5, "u", "<article><p>cut &am"), (5, "u", "<article><p>cut &am")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'own' AS text", "1 AS n_chars")
    found = {(r.page_id, r.n_chars) for r in html_text.extract_text(pages).select("page_id", "n_chars").collect()}
    assert (1, 0) in found and (2, 0) in found and (3, 299_999) in found and (5, 7) in found
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_odd_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://EXAMPLE.org/es/1"), (5, "HTTP://EXAMPLE.org/es/1"),
            (6, "x://h" + "/p" * 20_000), (7, "http://listed.test/a.html"), (8, "https://www.listed.test/a/?q#f"), (9, "http://É.org/es/")]
    urls = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "'own' AS host", "'own' AS verdict", "'own' AS rule")
    listed = spark.createDataFrame([("http://m.listed.test/a",), ("http://m.listed.test/a",), (None,), ("bad",)], "url string")
    found = {r.page_id: (r.host, r.rule, r.verdict) for r in urlfilter.judge_urls(urls, listed).collect()}
    assert found[1] == found[2] == found[3] == found[4] == ("", None, "allow")
    assert found[5] == ("example.org", "org/es/", "block") and found[9] == ("É.org", "org/es/", "block")
    assert found[7][2] == found[8][2] == "block"
    assert urlfilter.judge_urls(urls, listed).count() == len(rows)
    assert urlfilter.judge_urls(urls.limit(0), listed.limit(0)).count() == 0


def test_odd_conversations(spark):
    schema = "pair_id bigint, turn bigint, role string, text string"
    chosen = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "x"), (1, 2, "assistant", ""), (None, 0, "user", "x"), (2, None, "user", "x"), (3, 0, "user", "only here")]
    rejected = [(1, 0, "user", None), (1, 1, None, "x"), (1, 2, "assistant", "y"), (4, 0, "assistant", "only there")]
    frame = lambda rows: spark.createDataFrame(rows, schema).selectExpr("*", "'own' AS side", "'own' AS rendered")
    rows = preferences.format_preferences(frame(chosen), frame(rejected)).collect()
    assert sorted((r.pair_id, r.side, r.turn) for r in rows) == [
        (1, "chosen", 2), (1, "prompt", 0), (1, "prompt", 1), (1, "rejected", 2), (3, "chosen", 0), (4, "rejected", 0)
    ]
    assert preferences.format_preferences(frame([]), frame([])).count() == 0


def test_internal_names_do_not_clash(spark):
    """Columns named like those the operators use inside stay as they are."""
    names = ["_url", "_rule", "_block", "_m0", "_w0", "_found", "_in", "_row_tid", "_row_id", "_kept_id", "_copies"]
    own = [f"'own' AS `{n}`" for n in names]
    urls = spark.createDataFrame([(1, "http://listed.test/a.html"), (2, "http://free.test/")], "page_id bigint, url string").selectExpr("*", *own)
    listed = spark.createDataFrame([("http://m.listed.test/a",)], "url string")
    found = {r.page_id: r for r in urlfilter.judge_urls(urls, listed).collect()}
    assert (found[1].verdict, found[2].verdict) == ("block", "allow") and all(r[n] == "own" for r in found.values() for n in names)
    docs = documents(spark, [(1, prose(40, 1)), (2, prose(40, 1)), (3, prose(40, 2)), (3, prose(40, 2))]).selectExpr("*", *own)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_contradictory_labels(spark):
    """Rows in any order give the same model: the largest label and the least text count."""
    docs = [(i, ("foul " if i % 3 == 0 else "") + prose(20, i)) for i in range(60)] + [(1, "another text")]
    marks = [(i, 1, int(i % 3 == 0)) for i in range(60)] + [(3, 0, 0), (4, 1, 1)]
    scores = []
    for order in (1, -1):
        frame = spark.createDataFrame(marks[::order], LABELS).repartition(3)
        rows = toxicity.judge_toxicity(documents(spark, docs[::order]).repartition(4), frame).collect()
        scores.append(sorted((r.doc_id, round(r.p_toxic, 9)) for r in rows))
    assert scores[0] == scores[1]
