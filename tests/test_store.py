"""Copy-on-write tables: snapshots, what is written, conflicts, failures; files that one process creates."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from tessitura.sources import files
from tessitura.sources.store import Conflict, Store

RULES = {"view_count": "max", "title": "old", "description": "new", "times_fetched": "count"}


def songs(spark, rows):
    return spark.createDataFrame(rows, "song_id string, view_count long, title string, description string, times_fetched int, seq long")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def held(store, table, version=None):
    return {r[0]: tuple(r[1:]) for r in store.read(table, version).collect()}


def test_upsert_and_snapshots(spark, store):
    store.upsert("songs", songs(spark, [("a", 5, "A", "x", 1, 0), ("b", 7, "B", "y", 1, 1), ("a", 9, "late", "z", 1, 2)]), ["song_id"], RULES, buckets=4)
    first = {"a": (9, "A", "z", 2), "b": (7, "B", "y", 1)}
    assert held(store, "songs") == first
    before = store.read("songs")
    store.upsert("songs", songs(spark, [("b", 3, "new", "yy", 1, 0), ("c", 1, "C", "w", 1, 1)]), ["song_id"], RULES)
    assert held(store, "songs") == {"a": (9, "A", "z", 2), "b": (7, "B", "yy", 2), "c": (1, "C", "w", 1)}
    assert held(store, "songs", 0) == first == {r[0]: tuple(r[1:]) for r in before.collect()} and store.versions() == [0, 1]


def test_as_upsert_of_the_whole(spark, store):
    """Many small changes come to what one grouping of everything gives."""
    from tessitura.operators.catalog import upsert

    whole = songs(spark, []).drop("seq")
    for k in range(4):
        new = songs(spark, [(str((i * 7 + k) % 23), i * k, f"t{k}", f"d{k}-{i}", 1, i) for i in range(12)])
        store.upsert("songs", new, ["song_id"], RULES, buckets=8)
        whole = upsert(whole, new, ["song_id"], RULES)
    assert held(store, "songs") == {r[0]: tuple(r[1:]) for r in whole.select("song_id", *RULES).collect()}


def test_writes_grow_with_the_batch(spark, store):
    big = songs(spark, [(str(i), i, "t", "d", 1, i) for i in range(2000)])
    store.upsert("songs", big, ["song_id"], RULES, buckets=32)
    at = store.snapshot().tables["songs"]["at"]
    c = store.change()
    c.upsert("songs", songs(spark, [("5", 99, "n", "n", 1, 0)]), ["song_id"], RULES)
    c.commit()
    now = store.snapshot().tables["songs"]["at"]
    assert len(c.touched["songs"]) == 1 and [b for b in at if at[b] != now[b]] == [str(c.touched["songs"][0])] and len(at) == 32
    assert store.read("songs").count() == 2000 and held(store, "songs")["5"] == (99, "t", "n", 2)
    # the plan of the change reads that bucket alone
    assert c.read_for("songs", spark.createDataFrame([("5",)], "song_id string")).count() < 2000 / 8


def test_failed_change_leaves_the_snapshot(spark, store):
    store.upsert("songs", songs(spark, [("a", 5, "A", "x", 1, 0)]), ["song_id"], RULES, buckets=2)
    bad = songs(spark, [("a", 6, "A", "x", 1, 0)]).withColumn("view_count", F.when(F.col("view_count") > 5, F.raise_error(F.lit("no"))).otherwise(F.lit(1)).cast("long"))
    with pytest.raises(Exception, match="no"):
        store.upsert("songs", bad, ["song_id"], RULES)
    c = store.change()
    c.upsert("songs", songs(spark, [("z", 1, "Z", "z", 1, 0)]), ["song_id"], RULES)  # written, never committed
    assert held(store, "songs") == {"a": (5, "A", "x", 1)} and store.versions() == [0]
    assert len(store.vacuum()) >= 1 and held(store, "songs") == {"a": (5, "A", "x", 1)}


def test_conflict(spark, store):
    one, two = store.change(), store.change()
    for c, v in ((one, 1), (two, 2)):
        c.upsert("songs", songs(spark, [("a", v, f"{v}", "x", 1, 0)]), ["song_id"], RULES, buckets=2)
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert held(store, "songs") == {"a": (1, "1", "x", 1)}


def test_several_tables_at_once(spark, store):
    c = store.change()
    c.upsert("songs", songs(spark, [("a", 1, "A", "x", 1, 0)]), ["song_id"], RULES, buckets=2)
    c.replace("prefs", spark.createDataFrame([(1, "a"), (2, "b")], "user_id long, anchor string"), ["user_id"], buckets=2)
    c.append("log", spark.createDataFrame([(1, "made")], "id long, what string"))
    assert c.read("prefs").count() == 2 and store.versions() == []
    c.commit("jobs", 7)
    assert store.done("jobs", 7) and store.done("jobs", 3) and not store.done("jobs", 8) and not store.done("other", 0)
    c = store.change()
    c.replace("prefs", spark.createDataFrame([(2, "c")], "user_id long, anchor string"), ["user_id"])
    c.delete("songs", spark.createDataFrame([("a",)], "song_id string"))
    c.append("log", spark.createDataFrame([(2, "more")], "id long, what string"))
    with pytest.raises(Conflict):
        c.commit("jobs", 7)
    c.commit("jobs", 8)
    assert held(store, "prefs") == {1: ("a",), 2: ("c",)} and held(store, "songs") == {} and held(store, "songs", 0) != {}
    rows = lambda v=None: sorted(r["id"] for r in store.read_appended("log", v).collect())
    assert rows() == [1, 2] and rows(0) == [1]
    store.compact("log")
    c = store.change()
    c.append("log", spark.createDataFrame([(3, "last")], "id long, what string"))
    c.commit()
    assert rows() == [1, 2, 3] and rows(0) == [1]
    store.vacuum()
    assert rows() == [1, 2, 3] and held(store, "prefs") == {1: ("a",), 2: ("c",)}


def test_empty_and_null_keys(spark, store):
    store.upsert("songs", songs(spark, []), ["song_id"], RULES, buckets=2)
    assert held(store, "songs") == {} and store.snapshot().tables["songs"]["at"] == {}
    store.upsert("songs", songs(spark, [(None, 1, "n", "n", 1, 0), (None, 2, "m", "m", 1, 1)]), ["song_id"], RULES)
    assert held(store, "songs") == {None: (2, "n", "m", 2)}
    with pytest.raises(ValueError):
        store.upsert("songs", songs(spark, [("a", 1, "n", "n", 1, 0)]), ["title"], {"view_count": "max"})


def test_one_of_many_creates(spark, tmp_path):
    for base in (f"file://{tmp_path}/a", f"{tmp_path}/b"):
        won = []
        threads = [threading.Thread(target=lambda i=i: won.append(i) if files.create(spark, f"{base}/x.json", json.dumps([i])) else None) for i in range(16)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert len(won) == 1 and json.loads(files.read_text(spark, f"{base}/x.json")) == won and files.names(spark, base) == ["x.json"]
        files.replace(spark, f"{base}/x.json", "other")
        assert files.read_text(spark, f"{base}/x.json") == "other" and files.names(spark, base) == ["x.json"]
    assert files.read_text(spark, f"{tmp_path}/none") is None and files.names(spark, f"{tmp_path}/none") == []


def test_renames_where_there_are_no_links(spark, tmp_path, monkeypatch):
    """The way of file systems that aren't local."""
    monkeypatch.setattr(files, "_local", lambda path: None)
    path = f"file://{tmp_path}/c/x.json"
    assert files.create(spark, path, "1") and not files.create(spark, path, "2") and files.read_text(spark, path) == "1"
    files.replace(spark, path, "3")
    assert files.read_text(spark, path) == "3" and [n for n in files.names(spark, f"file://{tmp_path}/c") if not n.endswith(".crc")] == ["x.json"]
