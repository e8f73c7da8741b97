"""The bucketed table: upserts and deletes against a dictionary, and what they leave alone."""

import random
from pathlib import Path

import pytest

from lexquarry.sources import buckets

SCHEMA = "k string, part string, n long, v string"


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_against_a_dictionary(spark, tmp_path):
    store, draw, want = str(tmp_path / "t"), random.Random(1), {}
    for step in range(5):
        if step == 3:
            gone = [(k,) for k in draw.sample(sorted(want, key=repr), 15)] + [("not there",)]
            buckets.delete(spark.createDataFrame(gone, "k string"), store)
            for (k,) in gone:
                want.pop(k, None)
        else:
            rows = [(k, draw.choice("xy"), draw.randint(0, 9), f"{step}") for k in
                    draw.sample([None, *(f"k{i}" for i in range(60))], 25)]
            buckets.upsert(spark.createDataFrame(rows, SCHEMA), store, ["k"], buckets=8, layout=["part"])
            want |= {r[0]: r for r in rows}
        assert rows_of(buckets.read(spark, store)) == sorted(want.values(), key=repr)
    ask = [(k,) for k in [None, "k1", "k2", "k59"]]
    found = buckets.lookup(spark, store, spark.createDataFrame(ask, "k string"))
    assert rows_of(found) == sorted((want[k] for (k,) in ask if k in want), key=repr)


def test_versions_of_rows(spark, tmp_path):
    store = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    buckets.upsert(frame([("a", "x", 5, "old"), ("b", "x", 1, "old"), ("b", "x", 3, "later")]), store, ["k"], ["n"], 4)
    buckets.upsert(frame([("a", "x", 2, "late"), ("b", "x", 3, "same")]), store, version=["n"])
    assert rows_of(buckets.read(spark, store)) == [("a", "x", 5, "old"), ("b", "x", 3, "same")]
    assert rows_of(buckets.read(spark, store, version=0)) == [("a", "x", 5, "old"), ("b", "x", 3, "later")]
    with pytest.raises(ValueError):
        buckets.upsert(frame([]), str(tmp_path / "new"))
    with pytest.raises(FileNotFoundError):
        buckets.read(spark, str(tmp_path / "new"))


def test_untouched_buckets_are_neither_read_nor_written(spark, tmp_path):
    store = str(tmp_path / "t")
    buckets.upsert(spark.range(400).selectExpr("id", "'a' as v"), store, ["id"], buckets=16)
    before = buckets.manifest(spark, store)
    new = spark.createDataFrame([(7, "b")], "id long, v string")
    after = buckets.upsert(new, store)
    touched = [b for b in after.held if after.held[b] != before.held[b]]
    assert len(touched) == 1
    files = buckets.lookup(spark, store, new).inputFiles()
    assert files and all(f"/bucket={touched[0]}/" in f for f in files)
    folder = Path(store, "data", after.held[touched[0]])
    assert [p.name for p in folder.glob("bucket=*")] == [f"bucket={touched[0]}"]
    again = buckets.upsert(new, store)
    assert rows_of(buckets.read(spark, store)) == sorted(((i, "b" if i == 7 else "a") for i in range(400)), key=repr)
    assert again.version == 2 and {b: f for b, f in again.held.items() if b not in touched} == {b: f for b, f in before.held.items() if b not in touched}


def test_a_second_writer_fails_and_readers_keep_their_version(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "t")
    buckets.upsert(spark.range(20).selectExpr("id", "'a' as v"), store, ["id"], buckets=4)
    held = buckets.read(spark, store)
    stale = buckets.manifest(spark, store)
    buckets.upsert(spark.range(10).selectExpr("id", "'b' as v"), store)
    with monkeypatch.context() as m:
        now = buckets.manifest
        m.setattr(buckets, "manifest", lambda s, p, v=None: stale if v is None else now(s, p, v))
        with pytest.raises(Exception, match="exists"):
            buckets.upsert(spark.range(5).selectExpr("id", "'c' as v"), store)
    assert {r.v for r in held.collect()} == {"a"}
    assert rows_of(buckets.read(spark, store)) == sorted(((i, "b" if i < 10 else "a") for i in range(20)), key=repr)
    assert buckets.vacuum(spark, store)
    assert buckets.read(spark, store).count() == 20 and buckets.manifest(spark, store, 0) is None
    buckets.delete(spark.range(20), store)
    assert buckets.read(spark, store).count() == 0


def size_of(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_large_buckets_are_added_to_and_rewritten_in_the_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "APPEND_BYTES", 0, raising=False)
    monkeypatch.setattr(buckets, "MOST_LAYERS", 3, raising=False)
    store, draw, want, deepest = str(tmp_path / "t"), random.Random(2), {}, 0
    for step in range(8):
        if step in (2, 5):
            gone = [(k,) for k in draw.sample(sorted(want, key=repr), 12)] + [("not there",)]
            now = buckets.delete(spark.createDataFrame(gone, "k string"), store)
            for (k,) in gone:
                want.pop(k, None)
        else:
            rows = [(k, draw.choice("xy"), draw.randint(0, 9), f"{step}") for k in draw.sample([None, *(f"k{i}" for i in range(40))], 15)]
            now = buckets.upsert(spark.createDataFrame(rows, SCHEMA), store, ["k"], buckets=2, layout=["part"])
            want |= {r[0]: r for r in rows}
        deepest = max(deepest, *map(len, now.layers.values()), 0) if now.layers else deepest
        assert rows_of(buckets.read(spark, store)) == sorted(want.values(), key=repr)
    assert 0 < deepest <= 5
    assert len(buckets.vacuum(spark, store)) > 0
    assert rows_of(buckets.read(spark, store)) == sorted(want.values(), key=repr)


def test_a_delete_and_a_small_upsert_write_little(spark, tmp_path, monkeypatch):
    """Every bucket is touched, and none of its other rows is written again."""
    monkeypatch.setattr(buckets, "APPEND_BYTES", 10_000, raising=False)
    store = str(tmp_path / "t")
    buckets.upsert(spark.range(20000).selectExpr("id", "sha2(string(id), 512) as v"), store, ["id"], buckets=4)
    whole = size_of(store)
    buckets.delete(spark.range(0, 20000, 100), store)
    buckets.upsert(spark.range(20000, 20200).selectExpr("id", "'new' as v"), store)
    assert size_of(store) < 1.1 * whole
    left = buckets.read(spark, store)
    assert left.count() == 20000 and left.where("id % 100 = 0 and id < 20000").isEmpty() and left.where("v = 'new'").count() == 200
