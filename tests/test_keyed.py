"""Ingest with state by link: restarts, retries by timers, giving up."""

import json
import time

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from claimweave.sources.readers import ARTICLE
from claimweave.streaming.keyed import KEYED, extract_by_link


def put(folder, name, *links):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps({"title": f"T {k}", "link": k, "summary": "s", "text": "x."}) for k in links))


def maker(down):
    def make():
        def model(prompt):
            if f"{down}" in prompt and down:
                raise OSError("down")
            return "{}"

        return [("m", model)]

    return make


def run(spark, tmp_path, make, rows, **options):
    """Runs until so many rows are out, and a little longer, then stops."""
    stream = spark.readStream.schema(ARTICLE).json(str(tmp_path / "in"))
    query = extract_by_link(stream, make=make, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    out, until = [], time.time() + 90
    while time.time() < until and query.isActive and len(out) < rows:
        time.sleep(1)
        try:
            out = spark.read.schema(KEYED).parquet(str(tmp_path / "out")).collect()
        except AnalysisException:
            pass
    time.sleep(2)
    query.stop()
    if query.exception():
        raise query.exception()
    return sorted((r.link, r.tries, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_links_are_extracted_once_and_failures_again(spark, tmp_path):
    conf = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        put(tmp_path / "in", "1", "a", "b", "a")
        assert run(spark, tmp_path, maker("T b"), 2, pause_ms=3_600_000) == [("a", 1, "ok"), ("b", 1, "failed")]
        # up again: known links pass by, whatever has been written; the timer of b isn't due
        put(tmp_path / "in", "2", "b", "c", "a")
        assert run(spark, tmp_path, maker(None), 3, pause_ms=3_600_000) == [("a", 1, "ok"), ("b", 1, "failed"), ("c", 1, "ok")]
        assert {r.n for r in spark.read.parquet(str(tmp_path / "out")).groupBy("link").agg(F.count("*").alias("n")).collect()} == {1}
        # a short pause: d fails until it is given up
        put(tmp_path / "in", "3", "d")
        got = run(spark, tmp_path, maker("T d"), 6, tries=3, pause_ms=200)
        assert [x for x in got if x[0] == "d"] == [("d", 1, "failed"), ("d", 2, "failed"), ("d", 3, "failed")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", conf)
