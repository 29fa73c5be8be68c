import json

import numpy as np
import pytest

from tessera.plans import staging
from tessera.sources import readers, writers
from tessera.streaming import ingest


def test_json_lines_skip_blank_and_broken(spark, tmp_path):
    good = {"id": "1501.00001", "title": "T", "authors_parsed": [["Byron", "Ada", ""]], "versions": [{"version": "v1", "created": "x"}]}
    (tmp_path / "a.json").write_text(json.dumps(good) + "\n\n{broken\n" + json.dumps({"id": "2"}) + "\n{\"other\": 1}\n")
    assert readers.json_lines(spark, str(tmp_path / "a.json")).where("id is null").count() == 1 and readers.json_document(spark, str(tmp_path / "none.json")).count() == 0
    rows = readers.json_lines(spark, str(tmp_path / "a.json")).where("id is not null").orderBy("id").collect()
    assert [r.id for r in rows] == ["1501.00001", "2"] and rows[0].authors_parsed == [["Byron", "Ada", ""]]


def test_numpy_vectors(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.eye(3, dtype="float32"))
    np.save(tmp_path / "i.npy", np.array(["a", "b", "c"]))
    assert readers.numpy_vectors(spark, str(tmp_path / "x.npy"), str(tmp_path / "i.npy")).count() == 3
    np.save(tmp_path / "i.npy", np.array(["a"]))
    with pytest.raises(ValueError, match="3 vectors but 1 ids"):
        readers.numpy_vectors(spark, str(tmp_path / "x.npy"), str(tmp_path / "i.npy"))


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", ["x"], 0.5), (2, None, [], float("nan"))], "id int, s string, l array<string>, x double")
    writers.parquet(df, str(tmp_path / "p"), ("id",))
    assert readers.parquet(spark, str(tmp_path / "p"), ("s",)).count() == 2
    with pytest.raises(ValueError, match="no column z"):
        readers.parquet(spark, str(tmp_path / "p"), ("z",))
    writers.csv(df, str(tmp_path / "c"))
    assert {r.l for r in readers.csv(spark, str(tmp_path / "c"), "id int, s string, l string, x double").collect()} == {'["x"]', "[]"}
    writers.json_document(df, str(tmp_path / "j.json"))
    assert json.loads((tmp_path / "j.json").read_text())[1].get("x") is None
    assert readers.first_existing(spark, [str(tmp_path / "none"), str(tmp_path / "p")]).count() == 2
    assert "year" in readers.with_defaults(df).columns


def test_report_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2020, 5)], "year int, count int")
    writers.text_report({"ANNUAL VOLUME": df}, str(tmp_path / "r.txt"))
    found = readers.report_sections(spark, str(tmp_path / "r.txt"), {"annual": "^ANNUAL"}).collect()
    assert [r.text for r in found][-1] == "2020  5"
    with pytest.raises(ValueError, match="more than 10000 rows"):
        writers.text_report({"LONG": spark.range(10_001)}, str(tmp_path / "r.txt"))
    summary = writers.run_summary(str(tmp_path / "s.json"), {"k": 5}, {"papers": df}, silhouette=0.5)
    assert json.loads((tmp_path / "s.json").read_text()) == summary == {"parameters": {"k": 5}, "rows": {"papers": 1}, "silhouette": 0.5}


def test_stream_cleans_like_the_batch(spark, tmp_path):
    raw = {"id": "1501.00001", "title": "A title", "abstract": "word " * 100, "categories": "cs.LG", "update_date": "2016-01-01", "authors": "Ada Byron"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(raw) + "\n" + json.dumps(raw | {"id": "2", "update_date": "2001-01-01"}) + "\n")
    stream = ingest.raw_stream(spark, str(tmp_path / "in"), readers.RAW_SCHEMA).withColumnRenamed("journal-ref", "journal_ref")
    ingest.start_clean(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [r.paper_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["1501.00001"]


def test_release_deletes_what_was_staged(spark):
    from pathlib import Path

    table = staging.staged(spark.range(5))
    folder = Path(table.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists() and staging.release(spark) >= 1 and not folder.exists() and staging.release(spark) == 0
