"""Stored models: whole versions, keys of settings and inputs, swaps while others read; the lock."""

import os
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.operators import training
from tessitura.operators.model_store import ModelStore, input_versions


@pytest.fixture
def store(spark, tmp_path):
    return ModelStore(spark, f"file://{tmp_path}/models")


def table(spark, n, mark):
    return spark.range(n).select("id", F.lit(mark).alias("mark"))


def fit_of(spark, calls, mark, n=3):
    def fit():
        calls.append(mark)
        return {"users": table(spark, n, mark), "items": table(spark, 2 * n, mark)}, {"mean": 0.5, "mark": mark}

    return fit


def test_refits_when_a_table_or_setting_changes(spark, store, tmp_path):
    calls, source = [], f"file://{tmp_path}/in.parquet"
    table(spark, 3, "x").coalesce(1).write.parquet(source)
    get = lambda mark, **settings: store.get("m", fit_of(spark, calls, mark), settings=settings, inputs=input_versions(spark, [source]))
    one = get("a", rank=4)
    assert one.values == {"mean": 0.5, "mark": "a"} and one.tables["items"].count() == 6 and one.tables["users"].dtypes == table(spark, 1, "x").dtypes
    assert get("b", rank=4).version == one.version and calls == ["a"]
    two = get("c", rank=5)
    assert two.version != one.version and two.values["mark"] == "c"
    table(spark, 4, "y").coalesce(1).write.mode("append").parquet(source)
    three = get("d", rank=5)
    assert three.version != two.version and calls == ["a", "c", "d"] and store.open("m").version == three.version
    assert sorted(store.prune("m", keep=[one.version])) == [two.version] and store.versions("m") == sorted([one.version, three.version])
    store.make_current("m", one.version)
    assert store.open("m").values["mark"] == "a"
    store.forget("m")
    assert store.open("m") is None


def test_failed_fit_leaves_the_current(spark, store):
    store.publish("m", {"users": table(spark, 1, "a")}, {}, settings={}, inputs={})
    bad = table(spark, 1, "b").select(F.raise_error(F.lit("no")).cast("string").alias("x"))
    with pytest.raises(Exception, match="no"):
        store.publish("m", {"users": table(spark, 1, "b"), "bad": bad}, {}, settings={}, inputs={})
    assert store.open("m").tables["users"].first()["mark"] == "a"
    part = next(v for v in store.versions("m") if v != store.open("m").version)
    with pytest.raises(ValueError):
        store.make_current("m", part)
    with pytest.raises(Exception):  # noqa: B017
        store.get("m", lambda: 1 / 0, settings={"other": 1}, inputs={})


def test_a_swap_never_mixes_versions(spark, store):
    """A reader's tables and values are of one version, while another is made current again and again."""
    versions = [store.publish("m", {t: table(spark, 2, mark) for t in ("users", "items")}, {"mark": mark}, settings={}, inputs={}) for mark in "ab"]
    stop, seen = threading.Event(), set()

    def swap():
        k = 0
        while not stop.is_set():
            store.make_current("m", versions[k % 2])
            k += 1

    t = threading.Thread(target=swap)
    t.start()
    try:
        for _ in range(15):
            m = store.open("m")
            marks = {m.values["mark"], *(r["mark"] for t in m.tables.values() for r in t.collect())}
            assert len(marks) == 1
            seen |= marks
    finally:
        stop.set()
        t.join()
    assert seen <= {"a", "b"}


def test_a_stored_ensemble_scores_alike(spark, sf):
    """Scores of the ensemble as fitted and as stored and opened again."""
    from tessitura.operators import ensemble as E
    from tessitura.plans import learned
    from tessitura.plans.frames import split_of
    from tessitura.plans.retrieval import Retriever
    from tessitura.sources.scratch import materialize
    from tessitura.sources.star import Star

    s = Star(spark, sf)
    train = materialize(split_of(spark, sf).where("part = 'train'").drop("part"), "train")
    own = E.Ensemble(train, s.songs(), s.audio_features(), Retriever(spark, sf, train))
    store = learned.models(spark)
    store.publish("test", own.tables(), own.values(), settings={}, inputs={})
    m = store.open("test")
    again = E.Ensemble.restored(m.tables, m.values, s.songs())
    pool = materialize(own.retriever.pool().limit(300).select("user_id", "song_id"), "some")
    got, want = ({(r["user_id"], r["song_id"]): r for r in e.score(pool).collect()} for e in (again, own))
    assert set(got) == set(want) and len(want) > 50
    for k, r in want.items():
        assert np.allclose([got[k][c] for c in r.__fields__[2:]], list(r)[2:], atol=1e-6)


def test_queries_read_what_was_fitted_for_their_tables(spark, sf):
    from tessitura.plans import learned

    learned._retriever(spark, sf)
    name = learned._name(sf, "retriever")
    first = learned.models(spark).open(name).version
    assert learned._unseen(spark, sf).count() > 0 and learned.models(spark).open(name).version == first
    learned.forget(spark, sf)
    assert learned.models(spark).open(name) is None
    learned._retriever(spark, sf)
    assert learned.models(spark).open(name).version != first


@pytest.mark.parametrize("stale", [False, True])
def test_one_of_many_gets_the_lock(spark, tmp_path, stale):
    path = f"file://{tmp_path}/train.lock"
    if stale:
        assert training.acquire_lock(spark, path)
        os.utime(f"{tmp_path}/train.lock", (time.time() - 5 * 3600,) * 2)
    got = []
    threads = [threading.Thread(target=lambda: got.append(training.acquire_lock(spark, path))) for _ in range(16)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(got) == 1 and os.listdir(tmp_path) == ["train.lock"]
