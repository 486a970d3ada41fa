"""Serving: candidates, n-way score join, blend, diversity re-ranking, hard rules, explanations — for all users at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions import scalars as S

PAIR = ["user_id", "song_id"]
DRIVERS = [("collaborative fit", "s_svd", 0.4), ("neural pattern match", "s_ncf", 0.4), ("title similarity to your taste", "s_content", 0.3), ("exploration pick", "s_bandit", 0.6), ("trending now", "s_recency", 0.6)]
PARTS = ["svd", "ncf", "content", "bandit", "recency"]
DRIVER_WORDS = {
    "collaborative fit": "people who like what you like return to it", "neural pattern match": "it follows your listening habits", "title similarity to your taste": "its title resembles what you play to the end",
    "exploration pick": "it is a step outside your usual range", "trending now": "many are playing it at the moment",
}


def recently_played(listens: DataFrame, now: str, hours: int = 24) -> DataFrame:
    return listens.where((F.col("started_at") >= F.expr(f"timestamp'{now}' - interval {hours} hour")) & (F.col("started_at") <= F.lit(now).cast("timestamp"))).select(*PAIR).distinct()


def without(candidates: DataFrame, excluded: DataFrame) -> DataFrame:
    """Candidates that are not among (user, song) rows: recently played, blocked, heard."""
    return candidates.join(excluded.select(*PAIR), PAIR, "left_anti")


def blacklisted(prefs: DataFrame) -> DataFrame:
    return prefs.select("user_id", F.explode("blacklist").alias("song_id")).distinct()


def liked_by_others(feedback: DataFrame, user_id: int, n: int = 200) -> DataFrame:
    """Songs other users liked, latest like first."""
    return feedback.where((F.col("user_id") != user_id) & (F.col("signal") > 0)).groupBy("song_id").agg(F.max("created_at").alias("liked_at")).orderBy(F.desc("liked_at"), "song_id").limit(n)


def legacy_candidates(latest_feed: DataFrame, popular: DataFrame, liked: DataFrame, listens: DataFrame, songs: DataFrame, user_id: int, now: str, limit: int = 2000) -> DataFrame:
    """Latest feed, then popular, then liked by others; each once in this order, in the catalog, not played today."""
    parts = latest_feed.select("song_id", F.lit(0).alias("source"), F.col("rank_in_snapshot").cast("int").alias("pos"))
    parts = parts.unionByName(popular.select("song_id", F.lit(1).alias("source"), F.col("pos").cast("int").alias("pos")))
    at = F.row_number().over(Window.orderBy(F.desc("liked_at"), "song_id"))  # of at most 200 rows
    parts = parts.unionByName(liked.select("song_id", F.lit(2).alias("source"), at.alias("pos")))
    played = recently_played(listens.where(F.col("user_id") == user_id), now).select("song_id")
    once = parts.groupBy("song_id").agg(F.min(F.struct("source", "pos")).alias("x")).join(songs.select("song_id"), "song_id", "left_semi").join(played, "song_id", "left_anti")
    return once.orderBy("x.source", "x.pos", "song_id").limit(limit).select("song_id", "x.source", "x.pos")


def inject_heard(candidates: DataFrame, heard: DataFrame, played: DataFrame, songs: DataFrame, n: int = 20) -> DataFrame:
    """Up to n recently heard catalog songs (song_id, heard_at) a user doesn't have yet, marked fresh."""
    users = candidates.select("user_id").distinct()
    some = heard.join(songs.select("song_id"), "song_id", "left_semi").orderBy(F.desc("heard_at"), "song_id").limit(2 * n)
    new = users.join(F.broadcast(some), F.lit(True)).join(candidates.select(*PAIR), PAIR, "left_anti").join(played, PAIR, "left_anti")
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("heard_at"), "song_id"))
    return candidates.select(*PAIR).withColumn("fresh", F.lit(False)).unionByName(new.withColumn("r", r).where(F.col("r") <= n).select(*PAIR, F.lit(True).alias("fresh")))


def score_table(candidates: DataFrame, scores: dict[str, DataFrame]) -> DataFrame:
    """Left-join every model's (user, song, score): column s_<name>; missing is 0, for the bandit 0.5.

    The scores are stacked and pivoted by one aggregation, so the candidates are joined once, not once a model.
    """
    stack = None
    for name, df in scores.items():
        one = df.select(*PAIR, F.lit(name).alias("model"), F.col("score").cast("double").alias("score"))
        stack = one if stack is None else stack.unionByName(one)
    wide = stack.groupBy(*PAIR).agg(*[F.max(F.when(F.col("model") == n, F.col("score"))).alias(f"s_{n}") for n in scores])
    return candidates.join(wide, PAIR, "left").select(*candidates.columns, *[F.coalesce(f"s_{n}", F.lit(0.5 if n == "bandit" else 0.0)).alias(f"s_{n}") for n in scores])


def final_score(blend: Column, bonus: Column, fresh: Column, boost: float = 0.05) -> Column:
    """The blend in [0, 1], plus the music bonus, plus a boost for newly heard tracks; clipped after each step."""
    x = S.clip(S.clip((blend + 1) / 2, 0.0, 1.0) + bonus, 0.0, 1.0)
    return S.clip(x + F.when(fresh, boost).otherwise(0.0), 0.0, 1.0)


def mmr_lambda(slots: Column) -> Column:
    return F.greatest(F.lit(0.4), 0.70 - 0.04 * F.least(slots, F.lit(5)))


def mmr(ranked: DataFrame, vectors: DataFrame | None, depth: int, lam: Column | float = 0.7) -> DataFrame:
    """Maximal marginal relevance over all rows of a user: (user, song, score, genre_code) to (user, song, score, rank), depth a user.

    Each step takes the highest lam * score - (1 - lam) * similarity to what is taken: the largest cosine of the songs'
    vectors, 0 where either has none. Without vectors at all (None), it is 0.3 for each taken song of the genre, up to
    0.9. Ties go to the higher score, then the smaller id. lam: a number or a column of ranked. A user has at most the
    candidate pool's 2,020 rows, so a group is bounded; a step is one product of the user's matrix and a vector.
    """
    rows = ranked.withColumn("__lam", lam if isinstance(lam, Column) else F.lit(float(lam)))
    rows = (rows if vectors is None else rows.join(vectors, "song_id", "left")).select(*PAIR, "score", "genre_code", "__lam", *(["vector"] if vectors is not None else []))
    known = vectors is not None  # the function must not hold the table itself
    kinds = f"user_id long, song_id {ranked.schema['song_id'].dataType.simpleString()}, score double, rank int"

    def one(key: tuple, group: pa.Table) -> pa.Table:
        rel, songs = group.column("score").to_numpy(), np.array(group.column("song_id").to_pylist(), object)
        order = np.lexsort((songs, -rel))
        rel, songs, genre, share = rel[order], songs[order], group.column("genre_code").to_numpy()[order], group.column("__lam")[0].as_py()
        n = len(rel)
        near, seen, same = np.zeros(n), np.zeros(n, bool), np.zeros(n)
        unit, has = None, np.zeros(n, bool)
        if known:
            column = group.column("vector").combine_chunks()
            has = column.is_valid().to_numpy(zero_copy_only=False)
            if has.any():
                flat = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(int(has.sum()), -1)
                unit = np.zeros((n, flat.shape[1]))
                unit[has] = flat / (np.linalg.norm(flat, axis=1, keepdims=True) + 1e-8)
                unit, has = unit[order], has[order]
        left, taken = np.ones(n, bool), []
        while len(taken) < min(depth, n):
            sim = near if known else np.minimum(0.3 * same, 0.9)
            best = int(np.where(left, share * rel - (1 - share) * sim, -np.inf).argmax())
            taken.append(best)
            left[best] = False
            same += genre == genre[best]
            if unit is not None and has[best]:
                cos = unit @ unit[best]
                near = np.where(has, np.where(seen, np.maximum(near, cos), cos), 0.0)
                seen |= has
        return pa.table({"user_id": pa.array([key[0].as_py()] * len(taken), pa.int64()), "song_id": pa.array(songs[taken].tolist(), group.schema.field("song_id").type), "score": pa.array(rel[taken]), "rank": pa.array(np.arange(1, len(taken) + 1, dtype=np.int32))})

    return rows.groupBy("user_id").applyInArrow(one, kinds)


def anchor(ranked: DataFrame, pool: DataFrame, prefs: DataFrame, k: int = 10) -> DataFrame:
    """Cut to k and make sure of each user's anchor song, if it was ranked in the pool (user, song, score).

    An absent anchor takes the last of two or more places, or is added after one.
    """
    top = ranked.where(F.col("rank") <= k).select(*PAIR, "score", "rank")
    has = prefs.where(F.coalesce("anchor_song_id", F.lit("")) != "").select("user_id", F.col("anchor_song_id").alias("song_id"))
    wanted = has.join(top, PAIR, "left_anti").join(pool.select(*PAIR, "score"), PAIR)
    sizes = top.groupBy("user_id").agg(F.max("rank").alias("n"))
    extra = wanted.join(sizes, "user_id").select(*PAIR, "score", F.when(F.col("n") >= 2, F.col("n")).otherwise(F.col("n") + 1).alias("rank"))
    return top.join(extra.select("user_id", "rank"), ["user_id", "rank"], "left_anti").select(*PAIR, "score", "rank").unionByName(extra)


def hard_rules(ranked: DataFrame, songs: DataFrame, prefs: DataFrame, k: int = 10, per_genre: int = 3) -> DataFrame:
    """In this order: blacklist, genre cap, anchor, cut to k."""
    from tessitura.operators.retrieval import cap_per_genre

    allowed = without(ranked, blacklisted(prefs))
    return anchor(cap_per_genre(allowed, songs, per_genre), ranked, prefs, k)


def why(rank: str = "rank", final: str = "final_score") -> Column:
    """The explanation as JSON: rank, final score, breakdown and what drove it."""
    drivers = F.array_compact(F.array(*[F.when(F.col(c) > limit, F.lit(name)) for name, c, limit in DRIVERS]))
    breakdown = F.struct(*[F.round(F.col(f"s_{p}"), 4).alias(p) for p in PARTS])
    return F.to_json(F.struct(F.col(rank).alias("rank"), F.round(F.col(final), 4).alias("final_score"), breakdown.alias("breakdown"), F.when(F.size(drivers) == 0, F.array(F.lit("general popularity"))).otherwise(drivers).alias("drivers")))


def why_in_words(title: Column) -> Column:
    """The first two drivers in words, and the strongest part of the score; on ties, the first in name order."""
    drivers = F.array_compact(F.array(*[F.when(F.col(c) > limit, F.lit(DRIVER_WORDS[name])) for name, c, limit in DRIVERS]))
    best = F.greatest(*[F.col(f"s_{p}") for p in PARTS])
    strongest = None
    for p in sorted(PARTS):
        strongest = (F.when if strongest is None else strongest.when)(F.col(f"s_{p}") == best, p)
    text = F.when(F.size(drivers) == 0, F.lit("it fits your general rotation")).otherwise(F.array_join(F.slice(drivers, 1, 2), "; "))
    return F.concat(title, F.lit(": "), text, F.lit(" (strongest: "), strongest, F.lit(")"))


def priority_queue(sources: list[DataFrame], catalog: DataFrame, exclude: DataFrame, n: int) -> DataFrame:
    """Songs to hear next: (song_id, pos) sources in order, each song at its first place, in the catalog, not excluded."""
    parts = None
    for i, s in enumerate(sources):
        one = s.select("song_id", F.lit(i).alias("source"), F.col("pos").cast("int").alias("pos"))
        parts = one if parts is None else parts.unionByName(one)
    once = parts.groupBy("song_id").agg(F.min(F.struct("source", "pos")).alias("x"))
    return once.join(exclude.select("song_id"), "song_id", "left_anti").join(catalog.select("song_id", "title"), "song_id").orderBy("x.source", "x.pos", "song_id").limit(n).select("song_id", "title", "x.source", "x.pos")


def best_titles(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Rank (wanted_title, wanted_artist, title, artist) candidates of each key: title fits, artist matches, more shared tokens, shorter title."""
    overlap = F.size(F.array_intersect(S.title_tokens(F.col("wanted_title")), S.title_tokens(F.col("title"))))
    scored = pairs.withColumn("ok", S.title_ok(F.col("wanted_title"), F.col("title"))).withColumn("artist_ok", S.artist_match(F.col("wanted_artist"), F.col("artist"))).withColumn("overlap", overlap)
    order = Window.partitionBy(*key).orderBy(F.desc("ok"), F.desc("artist_ok"), F.desc("overlap"), F.length("title"), "title")
    return scored.withColumn("place", F.row_number().over(order))


def record_feedback(history: DataFrame, batch: DataFrame, version: str, *, limit: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Take in a batch of signals (id, user_id, song_id, rec_session_id, signal, created_at): (rows to append to feedback,
    a status for each signal, the arms' new posteriors).

    A status tells the user's dislikes up to that signal, in order of id, and whether they reach the limit, which
    switches recommendations off. History is read as one number a user.
    """
    from tessitura.operators.content import posteriors
    from tessitura.sources.schemas import conform

    rows = conform(batch.withColumn("model_version", F.lit(version)), "feedback")
    before = history.where("signal < 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("before"))
    upto = F.sum(F.when(F.col("signal") < 0, 1).otherwise(0)).over(Window.partitionBy("user_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    n = F.coalesce("before", F.lit(0)) + F.col("upto")
    status = rows.withColumn("upto", upto).join(before, "user_id", "left").select(
        "id", "user_id", "song_id", F.lit("ok").alias("status"), "signal", n.alias("dislike_count"), (n >= limit).alias("auto_disabled"),
        F.when(n >= limit, "Recommendations are off: too many dislikes.").otherwise("Feedback recorded.").alias("message"),
    )
    touched = rows.select(*PAIR).distinct()
    both = history.select(*PAIR, "signal").join(touched, PAIR, "left_semi").unionByName(rows.select(*PAIR, "signal"))
    return rows, status, posteriors(both.select(*PAIR, F.col("signal").cast("double").alias("reward")))


def chunks(text: Iterator[str], size: int = 4000) -> Iterator[str]:
    """Pieces of lines joined up to a message's size; a longer line is cut."""
    held = ""
    for line in text:
        while len(line) > size:
            if held:
                yield held
                held = ""
            yield line[:size]
            line = line[size:]
        if held and len(held) + 1 + len(line) > size:
            yield held
            held = line
        else:
            held = f"{held}\n{line}" if held else line
    if held:
        yield held
