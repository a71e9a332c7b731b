from __future__ import annotations

import json

from citescope.operators import citations as C
from citescope.operators import pages as P
from citescope.sources import readers as R
from citescope.sources.writers import write_results

ANSWER = {
    "query": "q",
    "response_text": "t",
    "web_search_queries": ["a", "b"],
    "grounding_metadata": [
        {
            "text": "t",
            "links": [{"title": "www.site.co.uk", "redirect_url": "r", "actual_url": "https://x.y/"}],
            "start_index": None,
            "end_index": 54,
        }
    ],
    "has_grounding": True,
}


def test_saved_answers_are_read_pretty_printed(spark, tmp_path):
    path = tmp_path / "answers.json"
    path.write_text(json.dumps([ANSWER], indent=2, ensure_ascii=False), encoding="utf-8")
    answers = R.read_answers(spark, str(path))
    row = answers.first()
    assert row.has_grounding and row.grounding_metadata[0].start_index is None
    links = R.segment_links(answers.withColumnRenamed("query", "query_id"))
    assert C.extract_domains(links).first().domain == "site.co.uk"


def test_saved_results_keep_failures(spark, tmp_path):
    run = {
        "url": "https://h",
        "queries_to_run": 2,
        "generated_queries": [{"query": "q", "type": "Direct"}, {"query": "p", "type": "Generic"}],
        "analysis_results": [
            {"query": "q", "query_type": "Direct", "links": [{"domain": "a.com", "count": 2}], "complete_result": ANSWER},
            {"query": "p", "query_type": "Generic", "links": [], "complete_result": None},
        ],
        "saved_at": "2024-01-01 00:00:00",
    }
    path = tmp_path / "run.json"
    path.write_text(json.dumps(run, indent=2), encoding="utf-8")
    runs = R.read_runs(spark, str(path))
    assert [r.type for r in R.run_queries(runs).orderBy("pos").collect()] == ["Direct", "Generic"]
    rows = R.run_results(runs).orderBy("pos").collect()
    assert [(r.query, r.domain, r["count"]) for r in rows] == [("q", "a.com", 2), ("p", None, None)]
    results = tmp_path / "results.json"
    results.write_text(json.dumps(run["analysis_results"]), encoding="utf-8")
    assert R.read_results(spark, str(results)).where("complete_result IS NULL").count() == 1


def test_http_info(spark, tmp_path):
    path = tmp_path / "http.json"
    path.write_text(
        json.dumps({"page_id": 1, "redirects": [{"from": "a", "to": "b", "status": 301}], "response_headers": {"Server": "x"}})
    )
    row = R.read_http_info(spark, str(path)).selectExpr("page_id", "redirects[0].to AS hop", "response_headers['Server'] AS s").first()
    assert tuple(row) == (1, "b", "x")


def test_record_round_trip(spark, tmp_path):
    html = '<title>é</title><script type="application/ld+json">{"a": 1}</script><a href="/x">y</a>'
    page = spark.createDataFrame(
        [(1, "https://h/", html, html)],
        "page_id long, url string, raw_html string, rendered_html string",
    )
    record = P.crawl_record(page, keep_source=False)
    write_results(record.select("page_id", "meta", "links"), str(tmp_path / "json"))
    line = spark.read.json(str(tmp_path / "json")).first()
    assert line.meta.tags.title == "é" and line.links[0].href == "https://h/x"
    assert "raw_html" not in record.columns


def test_partitioned_write(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "concat('s', id % 2) AS site")
    write_results(df, str(tmp_path / "out"), "parquet", ("site",), max_records_per_file=2)
    assert len(list((tmp_path / "out" / "site=s0").glob("*.parquet"))) >= 3
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.where("site = 's1'").count() == 5


def test_variant_columns_are_written_as_json(spark, tmp_path):
    df = spark.sql("SELECT 1 AS id, parse_json('{\"a\":[1]}') AS v")
    write_results(df, str(tmp_path / "v"))
    assert spark.read.json(str(tmp_path / "v")).first().v == '{"a":[1]}'


def test_pages_are_shuffled_only_on_request(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame([(1, "http://h.example/", "<p>x")], "page_id long, url string, html string").write.parquet(path)

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange")

    assert exchanges(R.read_pages(spark, path)) == 0
    spread = R.read_pages(spark, path, partitions=5)
    assert exchanges(spread) == 1 and spread.rdd.getNumPartitions() == 5
    assert spread.first().raw_html == spread.first().rendered_html == "<p>x"


def test_the_last_fetch_before_the_crawl_counts(spark):
    http = spark.sql(
        "SELECT page_id, timestamp(t) AS fetched_at, status_code, lang AS content_language, CAST(NULL AS string) AS final_url, map('a', lang) AS response_headers FROM VALUES "
        "(1, '2024-01-01', 500, 'a'), (1, '2024-01-03', 200, 'b'), (1, '2024-01-05', 404, 'c'), "
        "(2, NULL, 200, 'd'), (2, '2024-01-01', 200, 'e'), (3, NULL, 200, 'f'), (9, '2024-01-01', 200, 'g') AS t(page_id, t, status_code, lang)"
    )
    html = '<html lang="de">'
    pages = spark.createDataFrame([(i, f"https://h/{i}", html, html) for i in (1, 2, 3, 4)], "page_id long, url string, raw_html string, rendered_html string")
    timed = pages.selectExpr("*", "CASE page_id WHEN 1 THEN timestamp('2024-01-04') WHEN 2 THEN timestamp('2023-01-01') END AS crawled_at")
    last = {r.page_id: r.content_language_header for r in P.page_language(pages, http).collect()}
    assert last == {1: "c", 2: "e", 3: "f", 4: None}
    as_of = {r.page_id: r.content_language_header for r in P.page_language(timed, http).collect()}
    assert as_of == {1: "b", 2: "d", 3: "f", 4: None}
    records = P.crawl_record(timed, http).collect()
    assert {r.page_id: r.http_info and r.http_info.response_headers for r in records} == {
        1: {"a": "b"}, 2: {"a": "d"}, 3: {"a": "f"}, 4: None,
    }


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    import types

    import pytest

    from citescope.sources import scratch

    context = types.SimpleNamespace(master="spark://h:7077", applicationId="x")
    conf = types.SimpleNamespace(get=lambda key, default: default)
    with pytest.raises(ValueError):
        scratch.shared_folder(types.SimpleNamespace(conf=conf, sparkContext=context))
    local = scratch.shared_folder(spark)
    assert scratch.shared_folder(spark) == local
    saved = scratch.Scratch(spark, "test").save(spark.range(3), "rows")
    assert saved.count() == 3
