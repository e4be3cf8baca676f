"""Readers and writers of files."""

import json

import pytest

from tracewright.operators import shaping, statements
from tracewright.sources import tables


def test_json_and_entities(spark, tmp_path):
    rows = spark.createDataFrame([("phone:1", ["1", "2"]), ("phone:2", [])], "entity_id string, phones array<string>")
    tables.write_json(rows, str(tmp_path / "entities"), window_minutes=30)
    back = tables.load_json(spark, str(tmp_path / "entities")).select("entity_id", "phones")
    assert sorted(map(tuple, back.collect())) == [("phone:1", ["1", "2"]), ("phone:2", [])]
    facts = spark.read.json(str(tmp_path / "entities_meta")).first()
    assert (facts["rows"], facts["window_minutes"]) == (2, 30) and facts["generated_at"]
    (tmp_path / "nested.json").write_text(json.dumps({"a": {"b": [1, 2]}}, indent=1))
    assert tables.load_json(spark, str(tmp_path / "nested.json")).first()["a"]["b"] == [1, 2]
    rows.write.parquet(str(tmp_path / "parquet"))
    assert tables.load_entities(spark, str(tmp_path / "parquet")).count() == 2


def test_sampled_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v,w\n" + "".join(f"{i},x,y\n" for i in range(5000)))
    got = tables.sampled_scan(spark, str(tmp_path / "a.csv"), ["v", "k"], 0.1)
    assert got.columns == ["v", "k"] and 300 < got.count() < 700
    rows = spark.range(100).withColumnRenamed("id", "k")
    some = [r["k"] for r in shaping.sampled(rows, 10, "k").collect()]
    assert len(set(some)) == 10 and some == [r["k"] for r in shaping.sampled(rows.repartition(7), 10, "k").collect()]
    assert sorted(r["k"] for r in shaping.shuffled(rows, "k").collect()) == list(range(100)) and shaping.shuffled(rows, "k").first()["k"] == some[0]


def test_places_and_parsers(monkeypatch):
    assert tables.data_dir("/data") == "/data"
    monkeypatch.setenv("TRACEWRIGHT_DATA_DIR", "/elsewhere")
    assert tables.data_dir("/data") == "/elsewhere"
    assert statements.parser_for("hdfc") is statements.column_roles
    with pytest.raises(ValueError, match="no statement parser"):
        statements.parser_for("unknown")


def test_pdf_tables_ask_for_their_library(spark, tmp_path):
    pytest.importorskip("pdfplumber")
    assert tables.load_pdf_tables(spark, str(tmp_path)).count() == 0
