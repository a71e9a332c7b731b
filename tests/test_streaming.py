from __future__ import annotations

from citescope.operators import audit
from citescope.streaming.incremental import audit_stream, landing_pages


def test_new_pages_are_audited_once(spark, tmp_path):
    landing, target, state = (str(tmp_path / n) for n in ["in", "out", "state"])

    def land(*ids):
        spark.createDataFrame(
            [(i, f"https://h/{i}", "<h1>a</h1>", f"<h1>{i}</h1>" * i) for i in ids],
            "page_id long, url string, raw_html string, rendered_html string",
        ).coalesce(1).write.mode("append").parquet(landing)

    def run():
        query = audit_stream(landing_pages(spark, landing), target, state).trigger(
            availableNow=True
        ).start()
        query.awaitTermination(120)

    land(0, 1)
    run()
    land(2)
    run()
    streamed = spark.read.parquet(target).drop("batch_id")
    batch = audit.structure_analysis(spark.read.parquet(landing))
    assert {tuple(map(str, r)) for r in streamed.collect()} == {
        tuple(map(str, r)) for r in batch.collect()
    }
    assert streamed.count() == 3


def test_files_of_sites_count_from_the_next_batch(spark, tmp_path):
    landing, target, state, files = (str(tmp_path / n) for n in ["in", "out", "state", "files"])
    pages = "page_id long, url string, raw_html string, rendered_html string"

    def land(number, url):
        spark.createDataFrame([(number, url, "<p>", "<p>")], pages).coalesce(1).write.mode("append").parquet(landing)

    def land_file(url):
        content = "# Site llms.txt with instructions for everyone"
        rows = spark.createDataFrame([(url, 200, content)], "file_url string, status int, content string")
        rows.coalesce(1).write.mode("append").parquet(files)

    def run():
        stream = audit_stream(landing_pages(spark, landing), target, state, lambda s: s.read.parquet(files))
        stream.trigger(availableNow=True).start().awaitTermination(120)

    land_file("https://a.com/llms.txt")
    land(1, "https://a.com/x")
    land(2, "https://b.com/x")
    run()
    land_file("https://b.com/ai.txt")
    land(3, "https://b.com/y")
    run()
    rows = {r.page_id: r for r in spark.read.parquet(target).collect()}
    assert {i: r.has_llm_txt for i, r in rows.items()} == {1: True, 2: False, 3: True}
    assert rows[1].batch_id == rows[2].batch_id < rows[3].batch_id


def test_a_batch_that_runs_again_replaces_what_it_wrote(spark, tmp_path):
    from pyspark.sql import DataFrame

    class Caught:
        def foreachBatch(self, write):
            self.write = write
            return self

        def option(self, *_):
            return self

    class Stream:
        writeStream = Caught()

    target = str(tmp_path / "out")
    write = audit_stream(Stream(), target, str(tmp_path / "state")).write
    batch: DataFrame = spark.createDataFrame(
        [(1, "https://h/", "<p>", "<p>")], "page_id long, url string, raw_html string, rendered_html string"
    )
    for _ in range(2):
        write(batch, 7)
    assert [(r.page_id, r.batch_id) for r in spark.read.parquet(target).collect()] == [(1, 7)]
