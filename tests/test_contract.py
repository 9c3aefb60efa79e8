"""The driver's contract, keyed changes and streams."""

import importlib
import importlib.util
import sys

import pytest
from ledgerloom.operators.resolution import fold
from ledgerloom.sources import stores
from ledgerloom.sources.ingest import read_binary, read_csv, read_json, read_text
from ledgerloom.streaming.feeds import land_and_upsert, windowed_counts


def test_entry_and_names(spark, sf_dir):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_optional_part(monkeypatch):
    for name in ("ledgerloom.llm", "corpus_pipeline"):  # an import of None is an ImportError
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    assert "flagship_ledger" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names)


def test_keyed_changes(spark):
    state = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, x string, ord int")
    changes = spark.createDataFrame([(1, "z")], "id int, x string")
    assert sorted(map(tuple, stores.updated(state, changes, ["id"]).collect())) == [(1, "z", 1), (2, "b", 1)]
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "id int, x string, ord int")
    assert sorted(map(tuple, stores.upserted(state, new, ["id"], "ord").collect())) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]


def test_single(spark):
    one, two = spark.range(1), spark.range(2)
    assert stores.single(one).count() == 1
    assert stores.maybe_single(spark.range(0)).collect() == []
    with pytest.raises(Exception, match="exactly one row"):
        stores.single(two).collect()


def test_sequential_fold(spark):
    rows = [("k", i, v) for i, v in enumerate([None, "$0", "a", "b"])] + [("m", i, v) for i, v in enumerate(["", "$0"])]
    frame = spark.createDataFrame(rows, "k string, ord int, v string")
    assert dict(map(tuple, frame.groupBy("k").agg(fold("v")).collect())) == {"k": "a", "m": "$0"}


def test_stream_upsert(spark, tmp_path):
    landing = str(tmp_path / "in")
    spark.createDataFrame([("u", 1, "a"), ("w", 1, "b")], "k string, ord int, v string").coalesce(1).write.parquet(landing)
    spark.createDataFrame([("u", 5, "c"), ("u", 3, "d")], "k string, ord int, v string").coalesce(1).write.mode("append").parquet(landing)
    schema = spark.read.parquet(landing).schema
    assert sorted(map(tuple, land_and_upsert(spark, landing, schema, ["k"], "ord").collect())) == [("u", 5, "c"), ("w", 1, "b")]


def test_windowed_counts_stream(spark, tmp_path, sf_dir):
    landing = str(tmp_path / "events")
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(landing)
    stream = windowed_counts(spark.readStream.schema(spark.read.parquet(landing).schema).parquet(landing))
    stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("select sum(n) from w").first()[0] == spark.read.parquet(landing).count()


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny")
    (tmp_path / "b.csv").write_text("k,v\n1,z\n")
    (tmp_path / "c.json").write_text('{"k": 2}\n')
    assert read_text(spark, str(tmp_path / "a.txt")).first()[0] == "x\ny"
    assert read_binary(spark, str(tmp_path / "a.txt")).select("length").first()[0] == 3
    assert tuple(read_csv(spark, str(tmp_path / "b.csv"), "k int, v string").first()) == (1, "z")
    assert tuple(read_json(spark, str(tmp_path / "c.json"), "k int").first()) == (2,)
