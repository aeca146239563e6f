import importlib
import json
import sys

from pyspark.sql import functions as F

from quern.sources import records
from quern.streaming import arrivals


def test_requests(spark):
    rows = [json.dumps({"resume_text": "a", "jd_text": "b", "resume_embedding": [1, 2]}), json.dumps({"resume_text": ""}), "{", None]
    got = records.requests(spark.createDataFrame([(r,) for r in rows], "j string"), "j").collect()
    assert [r.error for r in got][:2] == [None, "resume_text is empty"]
    assert got[0].resume_embedding == [1.0, 2.0] and got[0].jd_embedding == []
    assert got[2].error and got[3].error


def test_taxonomy_and_stage(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"version": "1", "skills": [{"canonical_name": "Python", "category": "PL", "aliases": ["py"]}, {"canonical_name": "C", "category": "PL"}]}, indent=1))
    t = records.taxonomy(spark, str(path))
    assert [(r.ord, r.canonical, r.aliases) for r in t.collect()] == [(0, "Python", ["py"]), (1, "C", None)]
    assert [r.canonical for r in records.taxonomy(spark, f"{tmp_path}/none.json", t).collect()] == ["Python", "C"]
    (tmp_path / "bad.json").write_text("{")
    assert records.taxonomy(spark, str(tmp_path / "bad.json"), t).count() == 2
    (tmp_path / "own.json").write_text(records.taxonomy_record(t).first().value)
    assert [(r.canonical, r.aliases) for r in records.taxonomy(spark, str(tmp_path / "own.json")).collect()] == [("Python", ["py"]), ("C", None)]
    records.write_stage(t, str(tmp_path), "parsed", "parquet")
    assert spark.read.parquet(f"{tmp_path}/parsed").count() == 2


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, text string").parquet(f"{tmp_path}/in")
    q = arrivals.score_arrivals(stream, lambda df: df.select("id", F.length("text").alias("n")), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_windows_of_arrivals(spark, tmp_path):
    import datetime as dt

    day = lambda d, h: dt.datetime(2024, 5, d, h)
    rows = spark.createDataFrame([(1, day(1, 3)), (1, day(1, 9)), (1, day(2, 1)), (2, day(1, 4))], "doc_id long, received_at timestamp")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, received_at timestamp").parquet(f"{tmp_path}/in")
    q = arrivals.latest_per_window(stream, "doc_id").writeStream.format("memory").queryName("arrived").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted((r.doc_id, r.n, r.last_at.hour) for r in spark.table("arrived").collect()) == [(1, 1, 1), (1, 2, 9), (2, 1, 4)]


def test_entry_without_the_subpackage(monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "quern.llm", None)
    monkeypatch.setitem(sys.modules, "quern.llm.queries", None)
    names = importlib.reload(e).queries()
    assert "p4_found" in names and "p1_found" not in names
    assert set(e.oracle_sql()) <= set(names)
