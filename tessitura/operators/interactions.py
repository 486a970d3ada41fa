"""The weighted interaction frame, its temporal split, negatives, and offline evaluation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions import scalars as S
from tessitura.operators.order import numbered
from tessitura.sources.scratch import materialize

PAIR = ["user_id", "song_id"]


def frame(listens: DataFrame, feedback: DataFrame, now: str, *, alpha: float = S.ALPHA, half_life_days: float = S.INTERACTION_HALFLIFE_DAYS, legacy_alias: bool = False) -> DataFrame:
    """One row a (user, song): the last feedback by id, else the first listen by id, with a decayed confidence.

    Each source is reduced by key before they meet, with min_by and max_by, so it combines map-side.
    """
    fb = feedback.groupBy(*PAIR).agg(F.max_by(F.struct("signal", F.col("created_at").alias("at")), "id").alias("x")).select(
        *PAIR, F.col("x.signal").cast("double").alias("reward"), S.signal_reward(F.col("x.signal")).alias("plan_reward"), F.col("x.at").alias("timestamp"), F.lit("feedback").alias("source")
    )
    li = listens.groupBy(*PAIR).agg(F.min_by(F.struct("completion_pct", F.col("started_at").alias("at")), "id").alias("x"))
    reward = S.completion_reward(F.col("x.completion_pct"))
    li = li.join(fb.select(*PAIR), PAIR, "left_anti").select(*PAIR, reward.alias("reward"), reward.alias("plan_reward"), F.col("x.at").alias("timestamp"), F.lit("listen").alias("source"))
    both = fb.unionByName(li)
    c = S.half_life(S.confidence(F.col("plan_reward"), alpha, legacy_alias), S.age_seconds(F.col("timestamp"), now) / 86400, half_life_days)
    return both.withColumn("confidence", c).select(*PAIR, "reward", "plan_reward", "confidence", "timestamp", "source")


def cutoff(frame: DataFrame, quantile: float = 0.85):
    """The timestamp at 0-based place min(max(floor(q * n), 1), n - 1) in order; of one row, its own; of none, None.

    Exact and without a global sort in one task: rows are counted by timestamp, so one that many share is one row, the
    counts are range-partitioned and stored, and only the partition that holds the place is sorted.
    """
    counts = frame.groupBy("timestamp").agg(F.count(F.lit(1)).alias("n"))
    dealt = materialize(counts.repartitionByRange("timestamp").withColumn("p", F.spark_partition_id()), "stamps")
    sizes = sorted(dealt.groupBy("p").agg(F.min("timestamp").alias("low"), F.sum("n").alias("n")).select("low", "p", "n").collect())  # a row a partition
    n = sum(r["n"] for r in sizes)
    if not n:
        return None
    k, before = min(max(int(n * quantile), 1), n - 1) if n > 1 else 0, 0
    for r in sizes:
        if before + r["n"] > k:
            upto = F.sum("n").over(Window.orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0))
            return dealt.where(F.col("p") == r["p"]).withColumn("upto", upto).where(F.col("upto") > k - before).agg(F.min("timestamp")).first()[0]
        before += r["n"]
    raise AssertionError("unreachable")


def split(frame: DataFrame, *, quantile: float = 0.85, leave_last: int = 5) -> DataFrame:
    """Add ``part``: 'valid' for rows from the cutoff on and for each user's last positives, else 'train'.

    Guards: if all would be valid, the first half by time is train; if all train, the last fifth is valid. The frame
    is stored once, as several passes read it.
    """
    frame = materialize(frame, "split-frame")
    at = cutoff(frame, quantile)
    # a top-n window is cut before its shuffle, so a user with very many rows costs n of them
    forced = leave_last_rows(frame, leave_last).select(*PAIR, F.lit(True).alias("forced"))
    out = frame.join(forced, PAIR, "left").withColumn("part", F.when(F.col("forced") | (F.col("timestamp") >= F.lit(at)), "valid").otherwise("train")).drop("forced")
    sizes = {r["part"]: r["n"] for r in out.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) == 1:
        (part, n), = sizes.items()
        edge = max(1, n // 2) if part == "valid" else n - max(1, n // 5)
        out = numbered(frame, ["timestamp", *PAIR], "__i").withColumn("part", F.when(F.col("__i") < edge, "train").otherwise("valid")).drop("__i")
    return out


def running_average(feedback: DataFrame) -> DataFrame:
    """Signals of a (user, song) by id, each halved into the average so far: the latest weighs half.

    A pair gathers its own signals only.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("id", "signal"))), lambda x: x.signal.cast("double"))
    pairs = feedback.groupBy(*PAIR).agg(ordered.alias("s"))
    rest = F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0)))
    return pairs.select(*PAIR, F.aggregate(rest, F.get("s", F.lit(0)), lambda a, b: (a + b) / 2).alias("average"))


def leave_last_rows(frame: DataFrame, n: int = 5) -> DataFrame:
    """Each user's last n positives."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("timestamp"), F.desc("song_id")))
    return frame.where("plan_reward > 0").withColumn("r", rank).where(F.col("r") <= n).drop("r")


def fingerprint(frame: DataFrame, value: Column | None = None) -> DataFrame:
    """16 hex digits that stand for the set of ``user|song|value`` lines; the value is the whole second unless given.

    SHA-256 of the number of lines and of their MD5s, combined by exclusive or: any order gives the same, nothing can
    overflow, and it combines map-side, so neither a user nor a task has to gather its lines.
    """
    v = F.round(F.unix_micros("timestamp") / 1e6).cast("long").cast("string") if value is None else value
    md5 = F.md5(F.concat_ws("|", F.col("user_id").cast("string"), "song_id", v))
    words = [F.coalesce(F.bit_xor(F.conv(F.substring(md5, at, 8), 16, 10).cast("long")), F.lit(0)) for at in (1, 9, 17, 25)]
    return frame.agg(F.substring(F.sha2(F.concat_ws("|", F.count(F.lit(1)), *words), 256), 1, 16).alias("frame_hash"))


#: Lines that reach the driver as one compressed block.
LINES = 65_536


def ordered_fingerprint(frame: DataFrame, *values: Column) -> list[str]:
    """For each value, 16 hex digits of the SHA-256 of all ``user|song|value`` texts in order of time, then user and song.

    A running hash has to see the lines one after the other: they stream through the driver, a partition at a time and
    all values in one pass, as blocks of compressed columns (a song or value is written once a block), from which the
    texts are put together there. ``fingerprint`` is the form for large frames.
    """
    names = [f"v{i}" for i in range(len(values))]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            table = pa.table({c: x if pa.types.is_integer(x.type) else x.dictionary_encode() for c, x in zip(table.column_names, table.columns)})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= LINES:
                yield block()
                held = []
        if sum(b.num_rows for b in held):
            yield block()

    columns = frame.select("timestamp", *PAIR, *[v.alias(n) for v, n in zip(values, names)]).orderBy("timestamp", *PAIR).drop("timestamp")
    digests = [hashlib.sha256() for _ in values]
    for (block,) in columns.mapInArrow(blocks, "block binary").toLocalIterator():
        table = pa.ipc.open_stream(block).read_all()
        text = [table.column(c).cast(pa.string()).combine_chunks() for c in table.column_names]
        for digest, value in zip(digests, text[len(PAIR) :]):
            lines = pc.binary_join_element_wise(*[x.cast(pa.large_string()) for x in (*text[: len(PAIR)], value)], pa.scalar("|", pa.large_string()), null_handling="skip")
            ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
            digest.update(lines.buffers()[2][int(ends[0]) : int(ends[-1])])  # all texts, one after the other
    return [d.hexdigest()[:16] for d in digests]


def _bits(*parts: Column) -> Column:
    """32 bits of the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def unit(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of its parts: the same on every engine and partitioning."""
    return (_bits(*parts).cast("double") + 0.5) / float(1 << 32)


#: Times that missing songs are drawn again, each with as many draws as there were, before what is left is enumerated.
ROUNDS = 8


def negatives(frame: DataFrame, songs: DataFrame, *, per_positive: int = 4, tries: int = 1, seed: str = "neg", rounds: int = ROUNDS) -> DataFrame:
    """(user_id, pos, neg, kind): per_positive songs for each positive pair, half drawn evenly, half by popularity, none
    of the user's positives and none twice for a pair. A pair has fewer only where the catalog has no more such songs.

    Draws are from the whole catalog: its songs are numbered once, a draw is a number from a hash, and so an equi-join,
    however large the catalog. A popular draw is an even one that a second hash accepts by the share of the song's
    log10 views in the largest (rejection sampling). There are ``tries`` draws for each song wanted, twice as many of
    the popular kind, as nearly every pair is content with these; pairs that come out short, and they alone, are drawn
    again, which doubles their draws, ``rounds`` rounds at most. Each
    kind takes its first songs in the order of draws. Users still short then like all but a small part of the catalog
    (for others every draw succeeds in one of two, popular ones in one of forty at worst): for these the rest of the
    catalog is enumerated, hardly more rows than they have likes, and taken in the order of a hash.
    """
    wanted = {"uniform": per_positive // 2, "popular": per_positive - per_positive // 2}
    weight = F.log10(F.greatest("view_count", F.lit(10)).cast("double"))
    places = materialize(numbered(songs.groupBy("song_id").agg(F.max(weight).alias("w")), ["song_id"]).select("i", F.col("song_id").alias("neg"), "w"), "places")
    size = places.agg(F.count(F.lit(1)).alias("size"), F.max("w").alias("top"))  # one row
    likes = materialize(frame.where("plan_reward > 0").select("user_id", "song_id").distinct(), "likes")
    liked = likes.withColumnRenamed("song_id", "neg")
    none = F.array().cast("array<struct<k:int,kind:string,neg:string>>")
    of = lambda kind: F.array_distinct(F.transform(F.filter("d", lambda x: x["kind"] == kind), lambda x: x["neg"]))

    def chosen(by_pair: DataFrame) -> DataFrame:
        """by_pair (user, pos, d) with the songs of each kind."""
        even = by_pair.withColumn("uniform", F.slice(of("uniform"), 1, wanted["uniform"]) if wanted["uniform"] else F.array().cast("array<string>"))
        return even.withColumn("popular", F.slice(F.array_except(of("popular"), F.col("uniform")), 1, wanted["popular"]))

    full = (F.size("uniform") == wanted["uniform"]) & (F.size("popular") == wanted["popular"])
    left, done, first, many = likes.select("user_id", F.col("song_id").alias("pos"), none.alias("d")), [], 1, tries
    for _ in range(rounds):
        spans = [(kind, n * (first - 1) * (1 + (kind == "popular")) + 1, n * (first - 1 + many) * (1 + (kind == "popular"))) for kind, n in wanted.items() if n]
        draws = F.concat(*[_numbers(kind, a, z) for kind, a, z in spans])
        drawn = left.select("user_id", "pos", F.explode(draws).alias("x")).select("user_id", "pos", "x.kind", "x.k")
        key = [F.lit(seed), F.col("kind"), F.col("user_id").cast("string"), F.col("pos"), F.col("k").cast("string")]
        drawn = drawn.withColumn("bits", _bits(*key)).join(F.broadcast(size), F.lit(True)).withColumn("i", F.expr("(bits * size) div 4294967296"))
        accepted = (F.col("kind") == "uniform") | (unit(*key, F.lit("accept")) < F.round(F.col("w") / F.col("top"), 6))
        fair = drawn.join(places, "i").where(accepted).join(liked, ["user_id", "neg"], "left_anti")
        # a pair has at most as many rows as draws
        found = fair.groupBy("user_id", "pos").agg(F.array_sort(F.collect_list(F.struct("k", "kind", "neg"))).alias("more"))
        both = left.join(found, ["user_id", "pos"], "left").select("user_id", "pos", F.concat("d", F.coalesce("more", none)).alias("d"))
        step = materialize(chosen(both), "negatives")
        done.append(step.where(full).drop("d"))
        left = step.where(~full).select("user_id", "pos", "d")
        first, many = first + many, 2 * many
        if left.isEmpty():
            break
    else:
        done.append(_enumerated(chosen(left), places, liked, wanted, seed))
    picked = done[0]
    for more in done[1:]:
        picked = picked.unionByName(more)
    tag = lambda kind: F.transform(kind, lambda x: F.struct(x.alias("neg"), F.lit(kind).alias("kind")))
    tagged = F.concat(*map(tag, wanted))
    return picked.select("user_id", "pos", F.explode(tagged).alias("n")).select("user_id", "pos", "n.neg", "n.kind")


def _numbers(kind: str, first: int, last: int) -> Column:
    """An array of (kind, k)."""
    return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("k")))


def _enumerated(short: DataFrame, places: DataFrame, liked: DataFrame, wanted: dict[str, int], seed: str) -> DataFrame:
    """Pairs (user_id, pos, uniform, popular) that are short, filled from all songs that their users don't like."""
    users = short.select("user_id").distinct()
    last = places.agg(F.max("i").alias("last"))  # one row
    block = 4096
    blocks = users.join(F.broadcast(last), F.lit(True)).withColumn("b", F.explode(F.expr(f"sequence(0L, last div {block})"))).repartition("user_id", "b")
    every = blocks.withColumn("i", F.explode(F.expr(f"sequence(b * {block}, least(b * {block} + {block - 1}, last))"))).select("user_id", "i")
    rest = every.join(places.select("i", "neg"), "i").join(liked, ["user_id", "neg"], "left_anti")
    n = sum(wanted.values())
    # songs that a pair has already are among them, so 2 n of the smallest hashes are enough
    order = F.md5(F.concat_ws("|", F.lit(seed), F.lit("rest"), F.col("user_id").cast("string"), F.col("neg")))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("h", "neg"))
    few = rest.withColumn("h", order).withColumn("r", place).where(F.col("r") <= 2 * n).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "neg"))), lambda x: x["neg"]).alias("rest"))
    filled = short.drop("d").join(few, "user_id", "left").withColumn("rest", F.coalesce("rest", F.array().cast("array<string>")))
    left = lambda: F.array_except(F.array_except(F.col("rest"), F.col("uniform")), F.col("popular"))
    filled = filled.withColumn("uniform", F.concat("uniform", F.slice(left(), F.lit(1), F.lit(wanted["uniform"]) - F.size("uniform"))))
    return filled.withColumn("popular", F.concat("popular", F.slice(left(), F.lit(1), F.lit(wanted["popular"]) - F.size("popular")))).drop("rest")


def pairwise(frame: DataFrame, songs: DataFrame, **options) -> DataFrame:
    """(user, positive, negative) triples."""
    return negatives(frame, songs, **options).select("user_id", "pos", "neg")


def hits(ranked: DataFrame, valid: DataFrame, k: int = 10) -> DataFrame:
    """Per user with positives in valid: recall, ndcg, hitrate at k of (user_id, song_id, rank).

    ndcg is over the hits retrieved: it measures their order. standard_ndcg is over all that could be.
    """
    good = valid.where("plan_reward > 0").select("user_id", "song_id").distinct()
    top = ranked.where(F.col("rank") <= k)
    met = top.join(good.withColumn("hit", F.lit(1)), PAIR, "left").groupBy("user_id").agg(
        F.sum(F.coalesce("hit", F.lit(0))).alias("h"), F.sum(F.coalesce("hit", F.lit(0)) / F.log2(F.col("rank") + 1.0)).alias("dcg")
    )
    users = good.groupBy("user_id").agg(F.count(F.lit(1)).alias("relevant"))
    ideal = lambda n: F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    h = F.coalesce("h", F.lit(0))
    return users.join(met, "user_id", "left").select(
        "user_id", (h / F.col("relevant")).alias("recall"), F.when(h > 0, F.col("dcg") / ideal(h)).otherwise(0.0).alias("ndcg"),
        F.when(h > 0, 1.0).otherwise(0.0).alias("hitrate"), F.when(h > 0, F.col("dcg") / ideal(F.least("relevant", F.lit(k)))).otherwise(0.0).alias("standard_ndcg"),
    )


def evaluate(scored: DataFrame, test: DataFrame, k: int = 10) -> DataFrame:
    """One row: rmse of scores against rewards over all of test, and precision, recall and ndcg at k, averaged over users.

    scored: (user, song, score) of the test rows; a user's test songs are ranked by it. Precision is over k, recall over
    the user's positives, ndcg over the hits found; users without positives count in rmse alone.
    """
    j = test.select(*PAIR, "plan_reward").join(scored.select(*PAIR, "score"), PAIR)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "song_id"))
    rows = j.withColumn("rank", place).withColumn("hit", ((F.col("plan_reward") > 0) & (F.col("rank") <= k)).cast("int"))
    users = rows.groupBy("user_id").agg(
        F.sum("hit").alias("h"), F.sum(F.col("hit") / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.count_if(F.col("plan_reward") > 0).alias("relevant"),
        F.sum(F.pow(F.col("plan_reward") - F.col("score"), F.lit(2))).alias("squares"), F.count(F.lit(1)).alias("n"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest("h", F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    good = F.col("relevant") > 0
    zero = F.lit(0.0)
    return users.agg(
        F.sqrt(F.sum("squares") / F.sum("n")).alias("rmse"), F.coalesce(F.avg(F.when(good, F.col("h") / k)), zero).alias("precision"), F.coalesce(F.avg(F.when(good, F.col("h") / F.col("relevant"))), zero).alias("recall"),
        F.coalesce(F.avg(F.when(good, F.when(F.col("h") > 0, F.col("dcg") / ideal).otherwise(0.0))), zero).alias("ndcg"), F.count_if(good).alias("users"), F.coalesce(F.sum("n"), F.lit(0)).alias("interactions"),
    )


def catalog_metrics(ranked: DataFrame, valid: DataFrame, k: int = 10) -> DataFrame:
    """coverage, novelty and diversity of what is recommended to users with positives."""
    users = valid.where("plan_reward > 0").select("user_id").distinct()
    shown = ranked.where(F.col("rank") <= k).join(users, "user_id", "left_semi").groupBy("song_id").agg(F.count(F.lit(1)).alias("n"))
    total = shown.agg(F.sum("n").alias("total"))
    pool = valid.agg(F.count_distinct("song_id").alias("pool"))
    return shown.join(F.broadcast(total), F.lit(True)).agg(
        F.count(F.lit(1)).alias("songs"), F.first("total").alias("total"), F.avg(-F.log2(F.col("n") / F.col("total") + 1e-9)).alias("novelty")
    ).join(F.broadcast(pool), F.lit(True)).select(
        (F.col("songs") / F.greatest("pool", F.lit(1))).alias("coverage"), F.coalesce("novelty", F.lit(0.0)).alias("novelty"), F.least(F.lit(1.0), F.col("songs") / F.coalesce("total", F.lit(1)) * 10).alias("diversity")
    )


def genre_hitrate(ranked: DataFrame, valid: DataFrame, songs: DataFrame, k: int = 10) -> DataFrame:
    good = valid.where("plan_reward > 0").join(songs.select("song_id", "genre_code"), "song_id", "left")
    top = ranked.where(F.col("rank") <= k).select(*PAIR, F.lit(1.0).alias("hit"))
    return good.join(top, PAIR, "left").groupBy(F.coalesce("genre_code", F.lit(S.UNKNOWN_GENRE)).alias("genre_code")).agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("hitrate"))


def should_promote(new_ndcg: Column, new_coverage: Column, prod_ndcg: Column, prod_coverage: Column, tolerance: float = 0.05) -> Column:
    """A higher ndcg, and no relative coverage drop beyond the tolerance; without a production model, always."""
    drop = F.when(prod_coverage > 0, (prod_coverage - new_coverage) / prod_coverage).otherwise(0.0)
    return F.when(prod_ndcg.isNull(), True).otherwise((new_ndcg > prod_ndcg) & (drop <= tolerance))
