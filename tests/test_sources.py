import hashlib
import json

import pytest
from pyspark.sql import functions as F

from terravane.sources import evidence, scenes, tables
from terravane.streaming import windows


def test_csv_round_trip_and_provenance(spark, tmp_path):
    schema = "time DATE, v DOUBLE, source STRING"
    (tmp_path / "2018.csv").write_text("time,v,source\n2018-01-01,1.5,a\n2018-02-01,,a\n")
    (tmp_path / "2019.csv").write_text("time,v,source\n2019-01-01,NaN,a\n")
    rows = tables.read_csv(spark, str(tmp_path), schema, provenance=True)
    assert rows.count() == 3 and {r.source_file for r in rows.collect()} == {"2018.csv", "2019.csv"}
    tables.write_csv(rows.drop("source_file"), str(tmp_path / "out"))
    assert tables.read_csv(spark, str(tmp_path / "out"), schema).count() == 3
    (tmp_path / "bad.csv").write_text("time,v,source\nnever,x,a\n")
    with pytest.raises(Exception):
        tables.read_csv(spark, str(tmp_path / "bad.csv"), schema).collect()


def test_tsv_drops_stray_lines(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("<<'EOF'\nID\tYEAR\tTOPIC\nS01\t2023\tone\nS02\t2024\ttwo\nEOF\n")
    rows = tables.read_tsv(spark, str(tmp_path / "s.tsv"), "ID STRING, YEAR STRING, TOPIC STRING", key="ID", header=False)
    assert {r.ID for r in rows.collect() if r.YEAR} == {"S01", "S02", "ID"} - {"ID"}


def test_tsv_keeps_lines_that_do_not_fit(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("ID\tYEAR\nS01\t2023\nS02\tlast year\nS03\t2024\n\t2025\n")
    rows = tables.read_tsv(spark, str(tmp_path / "s.tsv"), "ID STRING, YEAR INT", key="ID")
    assert {(r.ID, r.YEAR) for r in rows.filter("_corrupt_record is null").collect()} == {("S01", 2023), ("S03", 2024)}
    assert [r._corrupt_record for r in rows.filter("_corrupt_record is not null").collect()] == ["S02\tlast year"]
    assert tuple(tables.corrupt(rows.cache()).first()) == (3, 1)


def test_json_documents(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"test": {"m": {"confusion_matrix": [[9, 0], [2, 0]]}}}, indent=2))
    doc = tables.read_json_document(spark, str(tmp_path / "m.json"))
    assert doc.first().test.m.confusion_matrix == [[9, 0], [2, 0]]
    (tmp_path / "w.json").write_text(json.dumps({"id": "x", "title": "t", "abstract_inverted_index": {"The": [0], "the": [2], "end": [1, 3]}}))
    record = evidence.read_literature(spark, str(tmp_path / "w.json"))
    assert record.select(evidence.abstract(F.col("abstract_inverted_index"))).first()[0] == "The end the end"
    assert tuple(evidence.hit_list(record).first()) == ("NA", None, "t")
    (tmp_path / "g.json").write_text(json.dumps({"feed": {"entry": [{"title": "a"}, {"title": "b"}]}}))
    assert [r.title for r in evidence.read_granules(spark, str(tmp_path / "g.json")).collect()] == ["a", "b"]


def test_files_sniffing_and_manifests(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(b"<!DOCTYPE html><p>not found")
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 ...")
    (tmp_path / "c.html").write_bytes(b"<html></html>")
    files = tables.files(spark, str(tmp_path))
    got = {r.path.rpartition("/")[2]: r.accepted for r in evidence.sniffed(files).select("path", "accepted").collect()}
    assert got == {"a.pdf": True, "b.pdf": False, "c.html": True}
    assert tables.first_file(spark, str(tmp_path), "*.pdf").endswith("a.pdf")
    with pytest.raises(FileNotFoundError):
        tables.first_file(spark, str(tmp_path), "*.tif")
    have = evidence.manifest(files)
    assert hashlib.sha256(b"%PDF-1.7 ...").hexdigest() in {r.sha256 for r in have.collect()}
    want = have.filter("path not like '%c.html'").withColumn("sha256", F.when(F.col("path").endswith("b.pdf"), "0").otherwise(F.col("sha256")))
    want = want.union(spark.createDataFrame([("gone", "1")], "path string, sha256 string"))
    got = {r.path.rpartition("/")[2]: r.status for r in evidence.verified(have, want).collect()}
    assert got == {"a.pdf": "equal", "b.pdf": "changed", "c.html": "extra", "gone": "missing"}


def test_scenes(spark):
    rows = [("a", "2018-01-05 10:00:00", {"eo:cloud_cover": "3.5"}, {"red": ("r",), "nir": ("n",), "scl": ("s",)}, 0.0, 0.0, 1.0, 1.0), ("b", "2018-03-02 10:00:00", {}, {"red": ("r",)}, 0.5, 0.5, 2.0, 2.0), ("c", "2018-03-02 10:00:00", {}, None, 5.0, 5.0, 6.0, 6.0)]
    schema = "id string, datetime string, properties map<string,string>, assets map<string,struct<href:string>>, west double, south double, east double, north double"
    all_ = spark.createDataFrame(rows, schema).withColumn("datetime", F.col("datetime").cast("timestamp"))
    found = scenes.search(all_, (0.8, 0.8, 3, 3), "2018-01-05", "2018-03-02")
    assert {r.id for r in found.collect()} == {"a", "b"}
    assert {r.id for r in scenes.with_assets(all_, ["red", "nir", "scl"]).collect()} == {"a"}
    with pytest.raises(Exception, match="assets missing"):
        scenes.requiring_assets(all_, ["scl"]).select("id").collect()
    assert {r.id: r.cloud_cover for r in scenes.cloud_cover(all_).collect()} == {"a": 3.5, "b": None, "c": None}
    with pytest.raises(LookupError):
        scenes.by_id(all_, "z")
    assert [r.scenes for r in scenes.widened(all_, (0, 0, 9, 9), [("2018-02-01", "2018-02-28"), ("2018-01-01", "2018-03-31")]).orderBy("range").collect()] == [3, 0]


def test_overlap_with_open_end(spark):
    rows = spark.createDataFrame([("1998-01-01", None), ("2015-01-01", "2016-01-01"), ("2025-01-01", None)], "s string, e string")
    got = [r[0] for r in rows.select(evidence.overlaps(F.col("s"), F.col("e"), F.lit("2018-01-01"), F.lit("2024-12-31"))).collect()]
    assert got == [True, False, False]


def test_pixels_in_blocks(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"), F.col("id").cast("double").alias("value"))
    tables.write_pixels(rows, str(tmp_path / "p"), block=5)
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 100 and back.select("block_row", "block_col").distinct().count() == 4


def test_stream_takes_what_is_there(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/events.parquet")
    folder = tmp_path / "in"
    source.write.parquet(str(folder))
    stream = spark.readStream.schema(source.schema).parquet(str(folder))
    windows.run_available(windows.daily_counts(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out"))
    whole = windows.daily_counts(source)
    assert got.count() > 0 and got.exceptAll(whole).isEmpty()
