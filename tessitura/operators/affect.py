"""Queries over the listening ledger and measured features: taste graph, profile, mood, similarity, dossier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions import scalars as S

FEEL = ["danceability", "valence", "energy", "brightness", "harmonic_clarity"]


def mood_of(valence: Column) -> Column:
    v = S.falsy(valence, 0.5)
    return F.when(v < 0.35, "low").when(v > 0.6, "high").otherwise("mid")


def taste_nodes(features: DataFrame) -> DataFrame:
    track = features.select(F.concat(F.lit("t:"), "song_id").alias("id"), F.lit("track").alias("kind"), F.col("song_id").alias("label"))
    key = features.where("musical_key <> ''").select(F.concat_ws("-", "musical_key", "mode").alias("label")).distinct().select(F.concat(F.lit("key:"), "label").alias("id"), F.lit("key").alias("kind"), "label")
    mood = features.select(mood_of(F.col("valence")).alias("label")).distinct().select(F.concat(F.lit("mood:"), "label").alias("id"), F.lit("mood").alias("kind"), "label")
    return track.unionByName(key).unionByName(mood)


def successions(ledger: DataFrame, by: list[str]) -> DataFrame:
    """(a, b): each hearing and the next, within ``by`` (a user; the empty list is one listener's own ledger)."""
    return ledger.withColumn("b", F.lead("song_id").over(Window.partitionBy(*by).orderBy("ts", "id"))).where("b is not null").select(F.col("song_id").alias("a"), "b")


def taste_edges(features: DataFrame, ledger: DataFrame, by: list[str]) -> DataFrame:
    """Additive edges (a, b, kind, w): in-key 1, feels 1, followed 1, and 0.5 more where both have the same key.

    Successions are counted before they meet the features. Loops go.
    """
    track = F.concat(F.lit("t:"), "song_id")
    in_key = features.where("musical_key <> ''").select(track.alias("a"), F.concat(F.lit("key:"), F.concat_ws("-", "musical_key", "mode")).alias("b"), F.lit("in-key").alias("kind"), F.lit(1.0).alias("w"))
    feels = features.select(track.alias("a"), F.concat(F.lit("mood:"), mood_of(F.col("valence"))).alias("b"), F.lit("feels").alias("kind"), F.lit(1.0).alias("w"))
    steps = successions(ledger, by).where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    ka, kb = (features.where("musical_key <> ''").select(F.col("song_id").alias(c), F.col("musical_key").alias(f"k{c}")) for c in "ab")
    color = steps.join(ka, "a").join(kb, "b").where("ka = kb")
    name = lambda df, kind, w: df.select(F.concat(F.lit("t:"), "a").alias("a"), F.concat(F.lit("t:"), "b").alias("b"), F.lit(kind).alias("kind"), (F.col("n") * w).alias("w"))
    return in_key.unionByName(feels).unionByName(name(steps, "followed", 1.0)).unionByName(name(color, "same-color", 0.5))


def taste_profile(features: DataFrame) -> DataFrame:
    """One row: home key (most frequent; on ties the first by name), mean bpm of those that have one, mean feel, count."""
    keys = features.where("musical_key <> ''").groupBy(F.concat_ws(" ", "musical_key", "mode").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    home = keys.agg(F.min_by("k", F.struct(-F.col("n"), "k")).alias("home_key"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("keys"))
    rest = features.agg(
        F.coalesce(F.round(F.avg(F.when(F.col("bpm") != 0, F.col("bpm"))), 1), F.lit(0.0)).alias("bpm_mean"), F.coalesce(F.round(F.avg(S.falsy(F.col("valence"), 0.5)), 3), F.lit(0.5)).alias("valence_mean"),
        F.coalesce(F.round(F.avg(S.falsy(F.col("danceability"), 0.5)), 3), F.lit(0.5)).alias("dance_mean"), F.count(F.lit(1)).alias("n"),
    )
    return rest.join(home, F.lit(True)).withColumn("home_key", F.coalesce("home_key", F.lit("?")))


def emotion(ledger: DataFrame, by: list[str], window: int = 10, recent_first: bool = False) -> DataFrame:
    """Weighted mood of each one's last hearings, with its label.

    Weights rise from the newest hearing to the oldest of the window, as they always did; recent_first turns that round.
    """
    w = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("id"))
    last = ledger.withColumn("i", F.row_number().over(w)).where(F.col("i") <= window).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    place = (F.col("n") - F.col("i") + 1) if recent_first else F.col("i")
    last = last.withColumn("w", 0.5 + 0.5 * place / F.col("n"))
    mean = lambda c: F.sum(c * F.col("w")) / F.sum("w")
    out = last.groupBy(*by).agg(mean(F.col("arousal")).alias("arousal"), mean(S.falsy(F.col("valence"), 0.5)).alias("valence"), F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.round("arousal", 3).alias("arousal"), F.round("valence", 3).alias("valence"), S.mood_label(F.col("arousal"), F.col("valence")).alias("label"), "n")


def feel_vector(df: DataFrame) -> DataFrame:
    bpm = F.least(F.coalesce("bpm", F.lit(0.0)) / 200.0, F.lit(1.0))
    return df.withColumn("v", F.array(bpm, *[S.falsy(F.col(c), 0.5) for c in FEEL]))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def feel_seed(mood: str = "", bpm: float = 0, valence: float = -1) -> list[float]:
    first = {"slow": 0.4, "fast": 0.75}.get(mood, min(bpm / 200, 1.0) if bpm else 0.5)
    return [first, {"high": 0.7, "low": 0.3}.get(mood, 0.5), valence if 0 <= valence <= 1 else 0.5, 0.5, 0.3, 0.4]


def feel_like(features: DataFrame, song_id: str | None = None, seed: list[float] | None = None, n: int = 5) -> DataFrame:
    """The n songs nearest in feel to a song (one row, broadcast) or to coordinates."""
    vs = feel_vector(features).select("song_id", "v")
    if song_id is not None:
        one = vs.where(F.col("song_id") == song_id).select(F.col("v").alias("seed")).limit(1)
        vs = vs.where(F.col("song_id") != song_id).join(F.broadcast(one), F.lit(True))
    else:
        vs = vs.withColumn("seed", F.array(*map(F.lit, seed)))
    return vs.select("song_id", F.round(cosine(F.col("seed"), F.col("v")), 6).alias("feel_score")).orderBy(F.desc("feel_score"), "song_id").limit(n)


def parse_lrc(lyrics: DataFrame) -> DataFrame:
    """(song_id, plain) of ``[mm:ss.ff]text`` lines to (song_id, t, line)."""
    rows = lyrics.select("song_id", F.explode(F.split("plain", "\n")).alias("raw"))
    m = F.regexp_extract("raw", r"^\[(\d+):(\d+(?:\.\d+)?)\](.*)$", 1)
    t = F.try_to_number(m, F.lit("999")).cast("double") * 60 + F.regexp_extract("raw", r"^\[(\d+):(\d+(?:\.\d+)?)\]", 2).try_cast("double")
    return rows.where(m != "").select("song_id", t.alias("t"), F.trim(F.regexp_extract("raw", r"^\[\d+:\d+(?:\.\d+)?\](.*)$", 1)).alias("line"))


def lyric_sections(lines: DataFrame, arcs: DataFrame, slice_seconds: int = 10) -> DataFrame:
    """Lines with the arousal of their slice (the last one for later lines) and the section it suggests."""
    i = F.least(F.floor(F.col("t") / slice_seconds).cast("int"), F.size("arousal") - 1)
    j = lines.join(arcs.select("song_id", "arousal"), "song_id").withColumn("level", F.get("arousal", i))
    return j.select("song_id", "t", "line", F.col("level").alias("arousal"), S.lyric_section(F.col("level")).alias("section"))


def captions(features: DataFrame) -> DataFrame:
    c = [F.col(x) for x in ("bpm", "musical_key", "mode", "valence", "energy", "brightness", "harmonic_clarity", "lift", "climax_frac", "voice_pct", "voice_enter_s")]
    return features.select("song_id", S.caption(*c).alias("caption"))


def agent_brief(features: DataFrame, n: int = 12) -> DataFrame:
    """One row of text: the first captions by id."""
    first = captions(features).orderBy("song_id").limit(n)
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("song_id", "caption"))), lambda x: F.concat(x.song_id, F.lit(": "), x.caption)), "\n").alias("brief"))


def brief(features: DataFrame, mood: DataFrame, taste: DataFrame, n: int = 12) -> DataFrame:
    """One row of text: the mood now (label, arousal, valence, n), the home of the taste (home_key, bpm_mean,
    valence_mean), how many tracks were heard, and the first captions. mood and taste have one row, or none."""
    heard = features.agg(F.count(F.lit(1)).alias("heard"))
    m = mood.limit(1).select(F.concat_ws(" ", F.lit("Mood now:"), "label", F.concat(F.lit("(arousal "), F.round("arousal", 3).cast("string"), F.lit(", valence "), F.round("valence", 3).cast("string"), F.lit(", n="), F.col("n").cast("string"), F.lit(")"))).alias("mood"))
    t = taste.limit(1).select(F.concat_ws(" ", F.lit("Taste home:"), "home_key", F.concat(F.lit("about "), F.round("bpm_mean", 1).cast("string"), F.lit(" BPM, valence ")), F.round("valence_mean", 3).cast("string")).alias("taste"))
    rows = heard.join(m, F.lit(True), "left").join(t, F.lit(True), "left").join(agent_brief(features, n), F.lit(True), "left")
    return rows.select(F.concat_ws("\n", F.coalesce("mood", F.lit("Mood now: unheard")), "taste", F.concat(F.lit("Heard: "), F.col("heard").cast("string")), "brief").alias("brief"))


def announcements(features: DataFrame, titles: DataFrame, n: int = 20) -> DataFrame:
    """(song_id, text): what is said of each newly heard track, its title and caption; at most n a batch, by id."""
    c = captions(features).join(titles.select("song_id", "title"), "song_id", "left").orderBy("song_id").limit(n)
    return c.select("song_id", F.concat(F.coalesce("title", "song_id"), F.lit(": "), "caption").alias("text"))
