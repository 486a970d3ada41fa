"""Content scoring: TF-IDF of titles, user profiles, and the Thompson bandit's posteriors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions import scalars as S
from tessitura.sources.scratch import materialize

#: Songs whose terms are sent to every task; more are joined.
SENT = 20_000


def terms(songs: DataFrame, text: str = "title") -> DataFrame:
    """(song_id, term, tf, len): counts of each term, and the number of words."""
    w = songs.select("song_id", S.words(F.coalesce(text, F.lit(""))).alias("w"))
    return w.select("song_id", F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("song_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(t: DataFrame) -> DataFrame:
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(df: DataFrame, n_docs: int, least: int = 2, share: float = 0.8) -> DataFrame:
    """Terms in at least ``least`` and at most ``share`` of the documents, with their inverse frequency."""
    idf = F.log((n_docs + 1) / (F.col("df") + 1)) + 1
    return df.where((F.col("df") >= least) & (F.col("df") <= share * n_docs)).withColumn("idf", idf)


def vectors(t: DataFrame, vocab: DataFrame) -> DataFrame:
    """L2-normalised (song_id, term, weight)."""
    raw = t.join(vocab, "term").select("song_id", "term", (F.col("tf") / F.col("len") * F.col("idf")).alias("x"))
    length = raw.groupBy("song_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l"))
    return raw.join(length, "song_id").select("song_id", "term", F.round(F.col("x") / F.col("l"), 9).alias("weight"))


def tfidf(songs: DataFrame, text: str = "title") -> DataFrame:
    t = terms(songs, text)
    return vectors(t, vocabulary(document_frequency(t), songs.count()))


#: Listens of a task: it sorts and sums them by user, song and term.
LISTENS = 100_000


def profiles(listens: DataFrame, vecs: DataFrame, n: int = 200) -> DataFrame:
    """Normalised mean vector of each user's last n listens, weighted by completion (none counts .3, .1 at least).

    Listens of a song are summed before they meet its terms. Users are dealt over as many tasks as there are LISTENS.
    """
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("started_at"), F.desc("id")))
    w = F.greatest(S.falsy(F.col("completion_pct"), 0.3), F.lit(0.1))
    tasks = max(1, -(-listens.count() // LISTENS))
    h = listens.repartition(tasks, "user_id").withColumn("r", r).where(F.col("r") <= n).groupBy("user_id", "song_id").agg(F.sum(w).alias("w"))
    # a row of weight 1 without a term goes with each song: its sum is the weight of the listens that have a vector
    each = h.join(_rows(vecs), "song_id").select("user_id", "w", F.explode(F.concat(F.array(_entry(F.lit(None).cast("string"), F.lit(1.0))), "v")).alias("e"))
    sums = each.groupBy("user_id", F.col("e.term").alias("term")).agg(F.sum(F.col("w") * F.col("e.weight")).alias("x"))
    of_user = sums.groupBy("user_id").agg(F.sum(F.when(F.col("term").isNull(), F.col("x"))).alias("total"), F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "x"))).alias("v"))
    mean = F.transform("v", lambda e: F.struct(e["term"].alias("term"), (e["x"] / F.col("total")).alias("x")))
    of_user = of_user.select("user_id", mean.alias("v")).withColumn("l", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e["x"] * e["x"])))
    return of_user.select("user_id", "l", F.explode("v").alias("e")).select("user_id", "e.term", F.round(F.col("e.x") / F.col("l"), 9).alias("weight"))


def _entry(term: Column, weight: Column) -> Column:
    return F.struct(term.alias("term"), weight.alias("weight"))


def _rows(vecs: DataFrame, key: str = "song_id") -> DataFrame:
    """(key, v): the terms of one song, or user, as one row."""
    return vecs.groupBy(key).agg(F.collect_list(_entry(F.col("term"), F.col("weight"))).alias("v"))


def content_score(candidates: DataFrame, profile: DataFrame, vecs: DataFrame) -> DataFrame:
    """2 cos - 1 of each candidate; 0 where the song has no vector or the user no profile.

    A candidate meets its song's terms and its user's as one row each, so its rows don't grow by the number of terms.
    Where the candidates' songs are few, their terms go to every task, and candidates are shuffled to their user without
    any; where they are many, candidates meet their songs first.
    """
    songs = materialize(_rows(vecs.join(candidates.select("song_id").distinct(), "song_id", "left_semi")), "candidate-terms")
    of_user = profile.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("u"))
    if songs.count() <= SENT:
        j = candidates.join(of_user, "user_id", "left").join(F.broadcast(songs), "song_id", "left")
    else:
        j = candidates.join(songs, "song_id", "left").join(of_user, "user_id", "left")
    cos = F.aggregate("v", F.lit(0.0), lambda s, e: s + e["weight"] * F.coalesce(F.try_element_at("u", e["term"]), F.lit(0.0)))
    return j.select(*candidates.columns, F.when(F.col("u").isNotNull() & F.col("v").isNotNull(), cos * 2 - 1).otherwise(0.0).alias("s_content"))


def posteriors(signals: DataFrame) -> DataFrame:
    """Beta posterior of each arm from (user, song, reward): alpha = 1 + gains, beta = 1 + losses; order-free."""
    r = F.col("reward")
    return signals.groupBy("user_id", "song_id").agg(
        (1 + F.sum(F.greatest(r, F.lit(0.0)))).alias("alpha"), (1 + F.sum(F.greatest(-r, F.lit(0.0)))).alias("beta"), F.count(F.lit(1)).alias("n_pulls")
    )


def bandit_confidence(arms: DataFrame) -> DataFrame:
    a, b = F.col("alpha"), F.col("beta")
    variance = a * b / ((a + b) * (a + b) * (a + b + 1))
    return arms.withColumn("confidence", 1 - F.least(variance * 10, F.lit(1.0)))


def thompson(arms: DataFrame, salt: str = "0") -> DataFrame:
    """A draw from each arm's posterior, the same for the same arm and salt whatever the partitioning."""
    @F.pandas_udf("double")
    def draw(alpha: pd.Series, beta: pd.Series, seed: pd.Series) -> pd.Series:
        return pd.Series([float(np.random.default_rng(s & 0x7FFFFFFFFFFFFFFF).beta(a, b)) for a, b, s in zip(alpha, beta, seed)])

    return arms.withColumn("theta", draw("alpha", "beta", F.xxhash64("user_id", "song_id", F.lit(salt))))


def song_tokens(songs: DataFrame, audio: DataFrame) -> DataFrame:
    """Side-feature tokens of each song for factorisation: genre, language, energy, artist, and what was measured."""
    s = songs.join(audio.select("song_id", "bpm", "musical_key", "mode", "brightness", "danceability"), "song_id", "left")
    tag = lambda kind, v: F.concat(F.lit(kind + ":"), v)
    tempo = F.when(F.col("bpm") > 0, F.when(F.col("bpm") < 90, "slow").when(F.col("bpm") < 130, "mid").otherwise("fast"))
    tokens = F.array(
        tag("genre", F.coalesce("genre_code", F.lit(20)).cast("string")), tag("lang", F.coalesce("language_code", F.lit(0)).cast("string")), tag("energy", S.bucket(F.coalesce("energy_score", F.lit(0.5)))),
        tag("artist", F.substring(F.when(F.coalesce("channel", F.lit("")) == "", "unknown").otherwise(F.col("channel")), 1, 48)), tag("key", F.concat_ws("-", F.col("musical_key"), F.when(F.col("musical_key").isNotNull(), F.col("mode")))),
        tag("tempo", tempo), tag("bright", F.when(F.col("brightness").isNotNull(), S.bucket(F.col("brightness")))), tag("dance", F.when(F.col("danceability").isNotNull(), S.bucket(F.col("danceability")))),
    )
    return s.select("song_id", F.explode(F.filter(tokens, lambda t: t.isNotNull() & (t != "key:"))).alias("token"))


def user_tokens(users: DataFrame, hour: int = 20, dow: int = 4) -> DataFrame:
    return users.select("user_id", F.explode(F.array(F.concat(F.lit("u:"), (F.col("user_id") % 97).cast("string")), F.lit(f"tod:{hour // 6}"), F.lit(f"dow:{dow // 2}"))).alias("token"))


def metadata_vector(songs: DataFrame) -> DataFrame:
    """Twelve numbers a song: popularity, length, title flags, codes and energy; the two unknowns are constants."""
    title = F.coalesce("title", F.lit(""))
    v = F.array(
        F.log10(F.greatest("view_count", F.lit(1)).cast("double")), F.col("like_count") / F.greatest("view_count", F.lit(1)), F.least(F.col("duration") / 600.0, F.lit(1.0)), F.lit(0.0), F.lit(0.5),
        F.least(F.length(title) / 100.0, F.lit(1.0)), S.tag_flag(title, "official").cast("double"), S.tag_flag(title, "lyrics", "lyric video").cast("double"), S.tag_flag(title, "remix", "mashup", "bootleg").cast("double"),
        F.col("language_code") / 9.0, F.col("genre_code") / 20.0, F.col("energy_score"),
    )
    return songs.select("song_id", F.transform(v, lambda x: F.round(x, 6)).alias("features"))


def math_vector(songs: DataFrame, rank: int = 500, total: int = 10_000) -> DataFrame:
    """Eight music-theory priors a song, each in [0, 1]."""
    title, seconds = F.coalesce("title", F.lit("")), F.coalesce("duration", F.lit(0))
    spaces = F.length(title) - F.length(F.replace(title, F.lit(" "), F.lit("")))
    v = F.array(
        S.title_consonance(title), S.groove(title, seconds), F.lit(0.5), F.when(seconds == 0, 0.5).otherwise(F.least(seconds / 600.0, F.lit(1.0))), F.least(F.length(title) / 100.0, F.lit(1.0)),
        S.falsy(F.col("energy_score"), 0.5), F.lit(max(0.0, min(1.0, 1 - rank / total))), F.least((spaces + 1) / 12.0, F.lit(1.0)),
    )
    return songs.select("song_id", F.transform(v, lambda x: F.round(x, 6)).alias("priors"))
