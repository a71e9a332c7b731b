"""Saved runs, reports that grow run by run, and files that are partly broken."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from citescope.operators import citations as C
from citescope.operators import domains as D
from citescope.operators import runs as U
from citescope.sources import readers as R
from citescope.sources.writers import write_results

SUPPORT = "struct<text:string,start_index:int,end_index:int,chunk_indices:array<int>>"
CHUNK = "struct<uri:string,title:string>"


def tables(spark, n_runs=3, per_run=4):
    runs = spark.createDataFrame([(k, f"https://h{k}", per_run, "2024-01-01 00:00:00") for k in range(n_runs + 1)], "run_id long, url string, queries_to_run int, saved_at string")
    asked, answers = [], []
    for k in range(n_runs):
        for j in range(per_run):
            number = 1000 * k + j
            asked.append((k, number, f"q{j % 3}", "Direct" if j == 0 else "Generic"))
            if j % 4 != 3:
                chunks = [("r/1", "www.a.com"), ("r/2", ""), (None, "x")]
                supports = [("s0", None, 5, [1, 0, 1]), ("s1", 5, 9, [2, 7])] if j != 2 else []
                answers.append((number, f"q{j % 3}", f"text {number}", chunks, supports))
    queries = spark.createDataFrame(asked, "run_id long, query_id long, query string, type string")
    answered = spark.createDataFrame(answers, f"query_id long, query string, response_text string, chunks array<{CHUNK}>, supports array<{SUPPORT}>")
    redirects = spark.createDataFrame([("r/1", "https://a.com/x"), ("r/2", "r/3"), ("r/3", "https://b.co.uk/y")], "redirect_url string, actual_url string")
    counts = C.domain_counts(C.extract_domains(C.answer_links(answered, redirects)))
    return runs, queries, counts, answered, redirects


def rows(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True, default=str) for r in df.collect())


def test_a_saved_run_has_its_queries_and_results(spark):
    saved = {r.run_id: r for r in U.saved_runs(*tables(spark)).collect()}
    assert len(saved) == 4 and all(r.part == 0 for r in saved.values())
    run = saved[1]
    assert [tuple(q) for q in run.generated_queries] == [("q0", "Direct"), ("q1", "Generic"), ("q2", "Generic"), ("q0", "Generic")]
    first, _, third, failed = run.analysis_results
    assert [(d.domain, d["count"]) for d in first.links] == [("b.co.uk", 2), ("a.com", 1)]
    result = first.complete_result
    assert (result.query, result.response_text, result.web_search_queries, result.has_grounding) == ("q0", "text 1000", [], True)
    assert [s.text for s in result.grounding_metadata] == ["s0", "s1"]
    assert [(x.title, x.redirect_url, x.actual_url) for x in result.grounding_metadata[0].links] == [
        ("", "r/2", "https://b.co.uk/y"), ("www.a.com", "r/1", "https://a.com/x"), ("", "r/2", "https://b.co.uk/y"),
    ]
    assert result.grounding_metadata[0].start_index is None and result.grounding_metadata[1].links == []
    assert third.complete_result.has_grounding is False and third.complete_result.grounding_metadata == [] and third.links == []
    assert failed.complete_result is None and failed.links == [] and failed.query_type == "Generic"
    assert saved[3].generated_queries == saved[3].analysis_results == []


def test_written_twice_is_written_once_and_read_back(spark, tmp_path):
    saved = U.saved_runs(*tables(spark)).cache()
    path = str(tmp_path / "runs")
    write_results(saved, path, partition_by=("run_id",), replace=True)
    once = rows(R.read_runs(spark, path, lines=True).select(*sorted(saved.columns)))
    write_results(saved.where("run_id = 1"), path, partition_by=("run_id",), replace=True)
    write_results(saved, path, partition_by=("run_id",), replace=True)
    back = R.read_runs(spark, path, lines=True).select(*sorted(saved.columns))
    assert rows(back) == once == rows(saved.select(*[F.col(c).cast("int") if c == "run_id" else F.col(c) for c in sorted(saved.columns)]))
    changed = saved.where("run_id = 1").withColumn("saved_at", F.lit("2024-02-02 00:00:00"))
    write_results(changed, path, partition_by=("run_id",), replace=True)
    times = {r.run_id: r.saved_at for r in R.read_runs(spark, path, lines=True).collect()}
    assert times == {0: "2024-01-01 00:00:00", 1: "2024-02-02 00:00:00", 2: "2024-01-01 00:00:00", 3: "2024-01-01 00:00:00"}
    with pytest.raises(ValueError):
        write_results(saved, path, replace=True)


def test_a_large_run_has_several_rows(spark):
    runs, queries, counts, answers, redirects = tables(spark, 2, 300)
    saved = U.saved_runs(runs, queries, counts, answers, redirects, results_per_row=50)
    sizes = [(r.run_id, len(r.analysis_results)) for r in saved.collect()]
    assert sum(n for _, n in sizes) == 600 and len(sizes) > 8 and max(n for _, n in sizes) < 120
    listed = saved.select("run_id", F.explode("analysis_results").alias("r")).groupBy("run_id", "r.query", "r.query_type").count()
    assert rows(listed) == rows(queries.groupBy("run_id", "query", F.col("type").alias("query_type")).count())


def test_a_state_of_runs_equals_the_report_of_all(spark, tmp_path):
    _, queries, counts, _, _ = tables(spark, 5, 7)
    path = str(tmp_path / "state")
    for chosen in ("run_id = 3", "run_id < 2", "run_id = 3", "run_id >= 1"):
        U.add_runs(queries.where(chosen), counts, path)
    state = U.read_state(spark, path)
    by_run = U.state_breakdown(state, ("run_id",))
    assert rows(by_run) == rows(C.domain_breakdown(queries, counts, ("run_id",)).select(*by_run.columns))
    # all runs together: texts are shared within a run
    whole = C.domain_breakdown(queries.withColumn("query", F.concat("query", F.lit("/"), "run_id")), counts)
    assert rows(U.state_breakdown(state)) == rows(whole.select(*U.state_breakdown(state).columns))
    assert [r.domain for r in U.top_state_domains(state, 1).collect()] == [C.top_domains(whole, 1).first().domain]
    scan = state.where("run_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in scan


def test_a_changed_run_replaces_its_own_state(spark, tmp_path):
    _, queries, counts, _, _ = tables(spark, 3, 4)
    path = str(tmp_path / "state")
    U.add_runs(queries, counts, path)
    U.add_runs(queries.where("run_id = 2 AND query_id < 2001"), counts, path)
    sizes = {r.run_id: r.queries for r in U.read_state(spark, path).where("domain IS NULL").collect()}
    assert sizes == {0: 4, 1: 4, 2: 1}


# --- broken files

GOOD = {"query": "q", "response_text": "t\nwith \"  },\n  {\" inside", "has_grounding": True, "web_search_queries": [], "grounding_metadata": []}


def test_a_broken_file_costs_its_own_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([GOOD, GOOD], indent=2))
    (tmp_path / "b.json").write_text(json.dumps([GOOD], indent=2)[:-9])
    (tmp_path / "c.json").write_text(json.dumps(GOOD))
    (tmp_path / "d.json").write_text("")
    good, bad = R.checked(spark, str(tmp_path), R.ANSWER, "document")
    assert sorted(r.file.rsplit("/", 1)[1] for r in good.collect()) == ["a.json", "a.json", "c.json"]
    assert [r.file.rsplit("/", 1)[1] for r in bad.collect()] == ["b.json"]
    assert all(r.response_text == GOOD["response_text"] for r in good.collect())


def test_broken_lines_are_listed(spark, tmp_path):
    lines = [json.dumps(GOOD), '{"query": "cut', "", "[1]", json.dumps({"query": "other type", "has_grounding": "maybe"}), json.dumps({"query": "ok", "new": 1})]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    good, bad = R.checked(spark, str(tmp_path), R.ANSWER)
    assert sorted(r.query for r in good.collect()) == ["ok", "q"]
    assert sorted(r.broken for r in bad.collect()) == sorted([lines[1], lines[3], lines[4]])


def test_one_large_indented_file_is_split(spark, tmp_path):
    rng = random.Random(2)
    records = [{**GOOD, "query": f"q{k}", "response_text": "é\n" * rng.randint(0, 200)} for k in range(3000)]
    text = json.dumps(records, indent=2, ensure_ascii=False)
    text = text.replace('"query": "q1234"', '"query" "q1234"')
    (tmp_path / "a.json").write_text(text, encoding="utf-8")
    (tmp_path / "one.json").write_text(json.dumps([records[0]], indent=2, ensure_ascii=False) + "\n")
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "empty.json").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        good, bad = R.checked(spark, str(tmp_path), R.ANSWER, "indented")
        found = good.select("query", "response_text", F.spark_partition_id().alias("task")).collect()
        assert len({r.task for r in found}) > 5
        assert sorted((r.query, r.response_text) for r in found) == sorted(
            (r["query"], r["response_text"]) for r in [*records[:1234], *records[1235:], records[0]]
        )
        (broken,) = bad.collect()
        assert '"query" "q1234"' in broken.broken and broken.file.endswith("a.json")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_records_of_any_shape(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": {"b": [2]}}\nbroken\n\n[3]')
    found = R.read_variants(spark, str(tmp_path / "a.jsonl"))
    values = found.selectExpr("try_variant_get(record, '$.a', 'string') AS a", "record IS NULL AS broken").collect()
    assert sorted(map(tuple, values), key=repr) == sorted([("1", False), ('{"b":[2]}', False), (None, True), (None, False)], key=repr)


# --- suffix rules


def registrable(spark, hosts, rules, **options):
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    found = D.registrable_domains(frame, spark.createDataFrame([(r,) for r in rules], "rule string"), **options)
    return {r.host: r.domain for r in found.collect()}


@pytest.mark.parametrize("sent", [D.SENT_RULES, 0])
def test_rules_wildcards_and_exceptions(spark, sent):
    rules = ["com", "uk", "co.uk", "*.ck", "!www.ck", "blogspot.com", " CO.JP ", "co.uk", "*.kobe.jp", "!city.kobe.jp", None, ""]
    expected = {
        "www.a.b.example.com": "example.com", "x.blogspot.com": "x.blogspot.com", "blogspot.com": "blogspot.com", "com": "com",
        "A.Example.CO.UK": "example.co.uk", "co.uk": "co.uk", "a.b.c.ck": "b.c.ck", "www.ck": "ck", "a.www.ck": "www.ck",
        "x.y.z.co.jp": "z.co.jp", "a.b.c.kobe.jp": "b.c.kobe.jp", "a.city.kobe.jp": "city.kobe.jp", "a.unknown.zz": "unknown.zz",
        "localhost": "localhost", "": "", None: "", "h.example.com:8080": "example.com:8080",
    }
    found = registrable(spark, [*expected, "co.uk"], rules, sent_rules=sent)
    assert found == expected


def test_default_rules_are_the_fixed_sets(spark):
    from citescope.functions import sql as S
    from citescope.functions import urls

    hosts = ["a.b.co.uk", "co.uk", "b.co.uk", "x.or.jp", "a.b.com", "www.x.y.com.au", "www.com.au", "a.com.us", "h", "", "A.B.C.Org.BR", "x.y:80"]
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    plain = S.select(frame, "host", urls.normalize_domain(S.col("host")).alias("domain"))
    assert rows(D.registrable_domains(frame, D.default_rules(spark))) == rows(plain)


def test_ten_thousand_rules_and_a_hot_host(spark):
    rules = spark.range(10_000).selectExpr("concat('s', id, '.test') AS rule")
    hosts = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'a.hot.s7.test' ELSE concat('a.b.s', id * 5, '.test') END AS host")
    joined = D.with_domains(hosts, rules, spread_by="id")
    assert joined.count() == 3000
    found = {r.host: r.domain for r in joined.distinct().collect()}
    assert found["a.hot.s7.test"] == "hot.s7.test" and found["a.b.s5.test"] == "b.s5.test" and found["a.b.s14995.test"] == "s14995.test"
    assert " IN (" not in joined._jdf.queryExecution().executedPlan().toString()
