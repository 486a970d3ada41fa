"""The feedback stream: each signal counts once wherever the stream is killed; factors as a sequential run has them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.sources.store import Conflict, Store
from tessitura.streaming import feedback as B
from tessitura.streaming import online

SIZE, MEAN, RATE, REG = 3, 0.1, 0.05, 0.02
FEED = "id long, user_id long, song_id string, signal int, created_at timestamp, rec_session_id string"


def signals(n=120, seed=1, hot=0.5):
    """(id, user, song, signal): half of them of one song and one user."""
    r = np.random.default_rng(seed)
    return [(i, 1 if r.random() < hot else int(r.integers(2, 9)), "hot" if r.random() < hot else f"s{r.integers(12)}", int(r.choice([1, -1, 0]))) for i in range(n)]


def start(seed=2):
    r = np.random.default_rng(seed)
    return {u: r.normal(0, 0.4, SIZE + 1) for u in range(1, 6)}, {s: r.normal(0, 0.4, SIZE + 1) for s in ["hot", *(f"s{i}" for i in range(6))]}


def tables(spark, users, songs):
    of = lambda d, k: spark.createDataFrame([(i, v.tolist(), 0) for i, v in d.items()], f"{k}, vector array<double>, n long")
    return of(users, "user_id long"), of(songs, "song_id string")


def sequential(batches, users, songs):
    """Signals one after another: an id's vector by the other side's as it was when the batch began."""
    users, songs = dict(users), dict(songs)
    for batch in batches:
        p0, q0 = dict(users), dict(songs)
        zero = np.zeros(SIZE + 1)
        for _, u, s, r in sorted(batch):
            for own, other, k, o in ((users, q0, u, s), (songs, p0, s, u)):
                v, w = own.get(k, zero), other.get(o, zero)
                e = r - (MEAN + v[0] + w[0] + v[1:] @ w[1:])
                own[k] = v + 2 * RATE * (e * np.r_[1.0, w[1:]] - REG * v)
    return users, songs


def same(got, want):
    assert set(got) == set(want)
    for k in want:
        assert np.allclose(got[k], want[k], rtol=1e-9, atol=1e-9), k


@pytest.mark.parametrize("partitions,batch", [(1, 1000), (1, 7), (5, 1000), (16, 3), (40, 4)])
def test_steps_as_a_sequential_run(spark, partitions, batch):
    """Ids that lie in one partition, are cut by its ends, or fill several; in Arrow batches of any size."""
    rows, (users, songs) = signals(), start()
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "seq long, user_id long, song_id string, reward int").repartition(3)
        a, b = online.online_step(df, *tables(spark, users, songs), MEAN, SIZE, rate=RATE, reg=REG, partitions=partitions)
        got = [{r[0]: (r["vector"], r["n"]) for r in t.collect()} for t in (a, b)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    want = sequential([rows], users, songs)
    for side, (found, all_of) in enumerate(zip(got, want)):
        touched = {r[1 + side] for r in rows}
        same({k: v for k, (v, _) in found.items()}, {k: all_of[k] for k in touched})
        assert {k: n for k, (_, n) in found.items()} == {k: sum(r[1 + side] == k for r in rows) for k in touched}


def test_batches_of_one_are_the_plain_online_step(spark):
    """Both sides by the vectors before the signal, as a process that takes signals one at a time."""
    rows, (users, songs) = signals(6), start()
    p, q = dict(users), dict(songs)
    zero = np.zeros(SIZE + 1)
    u_table, s_table = tables(spark, users, songs)
    for i, u, s, r in rows:
        v, w = p.get(u, zero), q.get(s, zero)
        e = r - (MEAN + v[0] + w[0] + v[1:] @ w[1:])
        p[u], q[s] = v + 2 * RATE * (e * np.r_[1.0, w[1:]] - REG * v), w + 2 * RATE * (e * np.r_[1.0, v[1:]] - REG * w)
        one = spark.createDataFrame([(i, u, s, r)], "seq long, user_id long, song_id string, reward int")
        a, b = online.online_step(one, u_table, s_table, MEAN, SIZE, rate=RATE, reg=REG)
        same({u: np.array(a.first()["vector"])}, {u: p[u]})
        same({s: np.array(b.first()["vector"])}, {s: q[s]})
        u_table, s_table = tables(spark, p, q)


def test_odd_signals(spark):
    rows = [(1, None, "a", 1), (2, 1, None, 1), (3, 1, "a", None), (4, 9, "new", 1)]
    df = spark.createDataFrame(rows, "seq long, user_id long, song_id string, reward int")
    a, b = online.online_step(df, *tables(spark, *start()), MEAN, SIZE)
    assert [r["user_id"] for r in a.collect()] == [9] and [r["song_id"] for r in b.collect()] == ["new"]
    a, b = online.online_step(df.limit(0), *tables(spark, *start()), MEAN, SIZE)
    assert a.collect() == [] == b.collect()


class Killed(Exception):
    pass


@pytest.mark.parametrize("killed", [None, "before", "after"])
def test_exactly_once(spark, tmp_path, killed):
    """Killed when a batch is written but not committed, or committed but not known to the stream: as if never killed."""
    rows, (users, songs) = signals(40), start()
    batches = [rows[:15], rows[15:16], rows[16:]]
    for k, b in enumerate(batches):
        spark.createDataFrame([(*r, None, f"session{r[0] % 3}") for r in b], FEED).withColumn("created_at", F.timestamp_seconds(F.col("id"))).coalesce(1).write.parquet(f"{tmp_path}/in/f{k}")
        import os
        import shutil

        name = next(n for n in os.listdir(f"{tmp_path}/in/f{k}") if n.endswith(".parquet"))
        shutil.move(f"{tmp_path}/in/f{k}/{name}", f"{tmp_path}/in/{k}.parquet")
        shutil.rmtree(f"{tmp_path}/in/f{k}")
        os.utime(f"{tmp_path}/in/{k}.parquet", (1000 + k, 1000 + k))
    store = Store(spark, f"file://{tmp_path}/store")
    B.seed(store, MEAN, *tables(spark, users, songs), size=SIZE, rate=RATE, reg=REG, buckets=4)
    once = []

    def fail(number):
        if number == 1 and not once:
            once.append(number)
            raise Killed

    def stream(**options):
        source = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        B.run(source, store, f"{tmp_path}/checkpoint", version="v7", buckets=4, **options).awaitTermination()

    if killed == "before":
        with pytest.raises(Exception, match="Killed"):
            stream(before_commit=fail)
    elif killed == "after":
        real = Store.done
        writer = B.batch_writer

        def dies_late(*args, **options):
            write = writer(*args, **options)

            def late(batch, number):
                write(batch, number)
                fail(number)

            return late

        B.batch_writer = dies_late
        try:
            with pytest.raises(Exception, match="Killed"):
                stream()
        finally:
            B.batch_writer = writer
        assert Store.done is real and store.done("feedback", 1)
    stream()
    stream()  # nothing new
    assert sorted(r["id"] for r in store.read_appended("feedback").collect()) == [r[0] for r in rows]
    assert {r["model_version"] for r in store.read_appended("feedback").collect()} == {"v7"}
    assert {r["user_id"]: (r["count"], r["disabled"]) for r in B.dislikes(store).collect()} == {u: (n, n >= 5) for u in {r[1] for r in rows} if (n := sum(r[3] < 0 for r in rows if r[1] == u))}
    want = {}
    for _, u, s, r in rows:
        a = want.setdefault((u, s), [1.0, 1.0, 0])
        a[0 if r > 0 else 1] += abs(r)
        a[2] += 1
    assert {(r["user_id"], r["song_id"]): [r["alpha"], r["beta"], r["n_pulls"]] for r in B.posteriors(store).collect()} == want
    p, q = sequential(batches, users, songs)
    same({r["user_id"]: np.array(r["vector"]) for r in store.read("user_factors").collect()}, p)
    same({r["song_id"]: np.array(r["vector"]) for r in store.read("song_factors").collect()}, q)
    assert len(store.versions()) == 4


def test_another_writer_in_between(spark, tmp_path):
    """A change of another session makes the batch start anew; it gives up after so many."""
    store = Store(spark, f"file://{tmp_path}/store")
    batch = spark.createDataFrame([(1, 1, "a", 1, None)], "id long, user_id long, song_id string, signal int, created_at timestamp")
    left = [2]

    def other(number):
        if left[0]:
            left[0] -= 1
            Store(spark, store.folder).upsert("prefs", spark.createDataFrame([(left[0], "x", 0)], "user_id long, anchor string, seq long"), ["user_id"], {"anchor": "new"}, buckets=1)

    B.batch_writer(store, "f", "v", buckets=1, before_commit=other)(batch, 0)
    assert store.done("f", 0) and store.read("prefs").count() == 2 and store.read_appended("feedback").count() == 1
    left[0] = 9
    with pytest.raises(Conflict):
        B.batch_writer(store, "f", "v", tries=2, buckets=1, before_commit=other)(batch, 1)
    assert not store.done("f", 1)
