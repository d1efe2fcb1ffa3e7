"""Readers, writers and streams on files."""

import json

import pytest
from pyspark.sql import functions as F

from attestary.operators import reports as R
from attestary.sources import readers as S, writers as O
from attestary.streaming import streams as X


def test_templates(spark, tmp_path):
    field = {"id": "1.1", "name": "a", "question": "Q ?", "options": ["x"], "required": True}
    (tmp_path / "Form_One.json").write_text(json.dumps({
        "_reviewed": False, "_recipient_by_canton": {"VD": {"zip": "1000"}},
        "fields": [{"comments": "Section 1"}, field, {"id": "1.2", "preset": "p"}]}))
    (tmp_path / "Form_Two.json").write_text(json.dumps({"fields": [field]}))
    (tmp_path / "Form_Bad.json").write_text('{"fields": [')
    (tmp_path / "other.json").write_text("{}")
    rows = S.read_templates(spark, str(tmp_path)).orderBy("form_id", "ord").collect()
    assert [(r.form_id, r.field_id, r.reviewed, r.ord) for r in rows] == [
        ("One", "1.1", False, 1), ("One", "1.2", False, 2), ("Two", "1.1", True, 0)]
    assert S.read_canton_tables(spark, str(tmp_path)).collect()[0].asDict() == {
        "form_id": "One", "canton": "VD", "name": "zip", "value": "1000"}


def test_dossiers_and_uploads(spark, tmp_path):
    for job in ("A", "B"):
        (tmp_path / job).mkdir()
        for n in (2, 1):
            (tmp_path / job / f"0{n}_doc.md").write_text(f"# {job}{n}\nligne")
    (tmp_path / "A" / "notes.md").write_text("no number")
    rows = S.read_dossiers(spark, str(tmp_path)).orderBy("job_id", "doc_no").collect()
    assert [(r.job_id, r.doc_no, r.markdown[:4]) for r in rows] == [
        ("A", 1, "# A1"), ("A", 2, "# A2"), ("B", 1, "# B1"), ("B", 2, "# B2")]
    files = S.read_uploads(spark, str(tmp_path)).where("job_id = 'B'").orderBy("file_no").collect()
    assert [(r.name, r.file_no, r["head"], r["size"]) for r in files] == [("01_doc.md", 0, "# B1", 10), ("02_doc.md", 1, "# B2", 10)]


def test_ground_truth(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"_meta": {"form_id": "F"}, "fields": {
        "1.1": {"expected": "NE", "tolerance": "exact", "category": "admin"}, "4.1": {"expected": None, "keywords": ["a"]}}}))
    rows = {r.field_id: r for r in S.read_ground_truth(spark, str(tmp_path / "t.json")).collect()}
    assert rows["1.1"].tolerance == "exact" and rows["4.1"].keywords == ["a"] and rows["4.1"].tolerance == "exact"


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert S.read_runs(spark, path).count() == 0
    runs = spark.createDataFrame([("f", 3, 12.34, "completed"), ("f", 1, 5.0, "failed")],
                                 "form_id string, documents int, seconds double, status string")
    O.append_runs(runs.withColumn("ts", F.timestamp_seconds(F.lit(0))), path)
    O.append_runs(runs.withColumn("ts", F.timestamp_seconds(F.lit(60))), path)
    (tmp_path / "runs" / "cut.json").write_text('\n{"ts": "x", "form_id": "g", "seco\n')
    rows = S.read_runs(spark, path)
    assert sorted((r.ts, r.seconds) for r in rows.collect()) == [
        ("1970-01-01T00:00:00+00:00", 12.3), ("1970-01-01T00:01:00+00:00", 12.3)]
    assert R.run_summary(rows).where("form_id = 'f'").first().runs == 2


def test_catalog(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# c\n\n 10.1  One \nbad line here\n20.2\tTwo\n")
    entries, rejects = S.read_catalog(spark, str(tmp_path / "list.txt"))
    assert sorted(map(tuple, entries.collect())) == [("10.1", "One"), ("20.2", "Two")]
    assert [r.line for r in rejects.collect()] == ["bad line here"]


def test_chunks_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([("j", 0, "a", [1.0]), ("k", 0, "b", [0.5])], "job_id string, chunk_no int, text string, embedding array<double>")
    O.write_chunks(chunks, str(tmp_path / "c"))
    assert S is not None and O.read_chunks(spark, str(tmp_path / "c")).count() == 2
    assert [r.text for r in O.read_chunks(spark, str(tmp_path / "c"), "k").collect()] == ["b"]
    O.write_results(chunks.withColumn("form_id", F.lit("F")), str(tmp_path / "r"))
    O.write_report(chunks, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == spark.read.json(str(tmp_path / "j")).count() == 2


EVENT = "job_id string, event_no bigint, t bigint, status string, message string, progress int"


def test_live_status_expires_finished_jobs(spark, tmp_path):
    """Two arrivals: the finished job leaves once an hour and the watermark delay have passed."""
    first = [("done", 1, 0, "pending", "", 0), ("done", 2, 60, "completed", "ok", 100), ("busy", 3, 90, "processing", "", 5)]
    later = [("busy", 4, 20_000, "processing", "still", 6), ("new", 5, 20_001, "failed", "no", 1)]
    for i, rows in enumerate((first, later)):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    stream = (spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
              .parquet(str(tmp_path)).withColumn("ts", F.timestamp_seconds("t")).drop("t"))
    updates = X.drain(X.stream_status(stream), "update")
    got = {r.job_id: (r.status, r.message) for r in X.latest_status(updates).collect()}
    assert got == {"busy": ("processing", "still"), "new": ("failed", "no")}
    assert updates.where("expired").count() == 1


@pytest.mark.parametrize("files", [1, 4])
def test_stream_figures_do_not_depend_on_arrival(spark, tmp_path, files):
    runs = spark.range(100).select(F.col("id").alias("log_no"), F.lit("f").alias("form_id"),
                                   F.lit(1).cast("bigint").alias("documents"), F.col("id").cast("double").alias("seconds"))
    runs.repartition(files).write.parquet(str(tmp_path / "runs"))
    stream = spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "runs"))
    (got,) = X.run_figures(X.drain(X.stream_run_stats(stream), "update")).collect()
    assert (got.runs, got.average_seconds, got.recent_average_seconds) == (100, 49.5, 89.5)


def test_known_contents_over_runs(spark, tmp_path):
    """Contents of earlier runs are not given again; repeats inside a run are one row."""
    from attestary.streaming import streams as X
    rows = [(i, f"h{i % 7}") for i in range(30)]
    files = str(tmp_path / "files")
    spark.createDataFrame(rows[:10], "no int, content_hash string").repartition(3).write.mode("append").parquet(files)
    read = lambda: spark.readStream.schema("no int, content_hash string").parquet(files)
    cache = str(tmp_path / "cache")
    assert sorted(r.content_hash for r in X.new_contents(read(), cache).collect()) == [f"h{i}" for i in range(7)]
    spark.createDataFrame(rows[10:] + [(99, "new"), (98, "new")], "no int, content_hash string").write.mode("append").parquet(files)
    assert [(r.no, r.content_hash) for r in X.new_contents(read(), cache).collect()] == [(98, "new")]
    assert X.new_contents(read(), cache).collect() == []


@pytest.mark.parametrize("parts", [0, 3])
def test_streams_read_one_file_or_a_folder_of_parts(spark, tmp_path, parts):
    """A table of one file has the rows of the same table as a folder, in every query that reads it as a stream."""
    import pandas as pd
    from attestary.plans import load
    rows = pd.DataFrame({"doc_id": range(12), "text": [f"Text {i % 5} of some words" for i in range(12)],
                         "lang": "fr", "source": [f"src{i % 2}" for i in range(12)], "n_chars": 10})
    if parts:
        (tmp_path / "documents.parquet").mkdir()
        for i in range(parts):
            rows[i::parts].to_parquet(tmp_path / "documents.parquet" / f"part-{i}.parquet")
        (tmp_path / "documents.parquet" / "_SUCCESS").write_text("")
    else:
        rows.to_parquet(tmp_path / "documents.parquet")
    queries = load()[0]
    assert queries["stream_chunks"](spark, str(tmp_path)).count() == 12
    assert queries["stream_dedupe"](spark, str(tmp_path)).count() == 5
    # numbers divisible by 3 are known from the first run: texts 0, 3, 1 and 4
    assert [r.doc_id for r in queries["stream_new_contents"](spark, str(tmp_path)).collect()] == [2]
