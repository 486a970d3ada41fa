"""Ingest of track metadata, feeds, upserts, deletes, the registry and the job log.

Stock Parquet has no MERGE: an upsert is the union of old and new rows grouped by key with a rule for each column,
written as a new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.functions import scalars as S

MIN_VIEWS, MAX_SECONDS = 10_000, 600
METADATA = "id string, title string, uploader string, channel string, channel_id string, duration double, view_count long, like_count long, upload_date string, description string, thumbnail string"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of track metadata; broken lines are skipped."""
    return spark.read.schema(METADATA).option("mode", "DROPMALFORMED").json(path)


def quality(df: DataFrame, min_views: int = MIN_VIEWS, max_seconds: int = MAX_SECONDS) -> DataFrame:
    """Rows with an id and a title, enough views, and not known to be too long."""
    named = (F.coalesce("song_id", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "")
    return df.where(named & (F.coalesce("view_count", F.lit(0)) >= min_views) & ~(F.coalesce("duration", F.lit(0)) > max_seconds))


def parse(info: DataFrame, now: str) -> DataFrame:
    """Recorded metadata to typed, tagged and scored songs that pass the quality filter. A row's place of arrival, ``pos``, stays with it."""
    title, text = F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))
    typed = info.select(
        F.col("id").alias("song_id"), "title", F.coalesce("uploader", "channel", F.lit("")).alias("channel"), "channel_id", F.coalesce(F.col("duration").cast("int"), F.lit(0)).alias("duration"),
        F.coalesce("view_count", F.lit(0)).alias("view_count"), F.coalesce("like_count", F.lit(0)).alias("like_count"), "upload_date", text.alias("description"),
        S.genre(title, text).alias("genre_code"), S.language(title).alias("language_code"), S.energy(title).alias("energy_score"), S.mood_tags(title, text).alias("mood_tags"),
        S.tag_flag(title, "official").alias("has_official"), S.tag_flag(title, "lyrics", "lyric video").alias("has_lyric"), S.tag_flag(title, "remix", "mashup", "bootleg").alias("has_remix"),
        *(c for c in info.columns if c == "pos"),
    )
    return quality(typed).withColumn("raw_score", S.raw_score(F.col("view_count"), F.col("like_count"), S.freshness(F.col("upload_date"), now), F.col("energy_score")))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def latest_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the largest order value: one aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__x")).select(*keys, *[F.col(f"__x.{c}").alias(c) for c in rest])


def feed(df: DataFrame, n: int = 100) -> DataFrame:
    """The top n by raw score with their rank. The rank is over n rows only."""
    top = df.orderBy(F.desc("raw_score"), "song_id").limit(n)
    return top.withColumn("rank_in_snapshot", F.row_number().over(Window.orderBy(F.desc("raw_score"), "song_id")))


def unseen(new: DataFrame, known: DataFrame) -> DataFrame:
    """Exact membership dedup against the catalog."""
    return new.join(known.select("song_id"), "song_id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """Merge by key. A rule for each other column: 'new', 'old', 'max', 'sum', or 'count' (new rows, added to old).

    new may have several rows a key, in the order of its column ``seq``; 'new' is then the last and 'old' the first.
    """
    both = old.withColumn("__seq", F.lit(-1).cast("long")).withColumn("__add", F.lit(0)).unionByName(
        new.withColumn("__seq", F.col("seq").cast("long")).withColumn("__add", F.lit(1)).drop("seq"), allowMissingColumns=True
    )
    how = {
        "new": lambda c: F.max_by(c, "__seq"), "old": lambda c: F.min_by(c, "__seq"), "max": lambda c: F.max(c), "sum": lambda c: F.sum(c),
        "count": lambda c: F.coalesce(F.max(F.when(F.col("__add") == 0, F.col(c))), F.lit(0)) + F.sum("__add"),
    }
    return both.groupBy(*keys).agg(*[how[r](c).alias(c) for c, r in rules.items()])


SONG_RULES = {
    "title": "old", "channel": "old", "duration": "old", "view_count": "max", "like_count": "max", "upload_date": "old", "genre_code": "old", "language_code": "old",
    "energy_score": "old", "mood_tags": "old", "description": "new", "first_seen": "old", "last_seen": "new", "times_fetched": "count",
}


def artist_pairs(ranked: DataFrame, first: int = 60) -> DataFrame:
    """Pairs of different artists among the first rows of each snapshot, in name order, counted over all."""
    a = ranked.where(F.col("rank_in_snapshot") <= first).select("snapshot_id", "rank_in_snapshot", "channel")
    b = a.select("snapshot_id", F.col("rank_in_snapshot").alias("r2"), F.col("channel").alias("c2"))
    return a.join(b, "snapshot_id").where("rank_in_snapshot < r2 and channel <> c2").groupBy(F.least("channel", "c2").alias("artist_a"), F.greatest("channel", "c2").alias("artist_b")).agg(F.count(F.lit(1)).alias("co_count"))


def purge(songs: DataFrame, now: str, days: int = 7, fetched: int = 3) -> DataFrame:
    """What stays of the catalog when stale, rarely fetched songs go. Counting the rest is the dry run."""
    return songs.where(~((F.col("last_seen") < F.expr(f"timestamp'{now}' - interval {days} day")) & (F.col("times_fetched") < fetched)))


def retain(feed_songs: DataFrame, now: str, days: int = 7) -> DataFrame:
    return feed_songs.where(F.col("snapshot_id") >= F.expr(f"cast(timestamp'{now}' - interval {days} day as date)"))


def latest_snapshot(feed_songs: DataFrame) -> DataFrame:
    newest = feed_songs.agg(F.max("snapshot_id").alias("snapshot_id"))  # one row
    return feed_songs.join(F.broadcast(newest), "snapshot_id")


def deep_queries(spark: SparkSession, artists: list[str], moods: list[str], charts: list[str], seeds: list[str]) -> DataFrame:
    """The nightly query list: two for each artist, moods, charts, three for each of ten seeds; first place wins."""
    texts = [f"{a} {t}" for a in artists for t in ("discography full songs", "best songs")] + moods + charts
    texts += [t.format(s) for s in seeds[:10] for t in ("songs like {}", "{} similar artists", "{} mix")]
    rows = spark.createDataFrame(list(enumerate(texts)), "pos int, query string")
    return rows.groupBy("query").agg(F.min("pos").alias("pos"))


#: A row's own place, then what makes the choice repeatable where places are equal.
FIRST_COME = ["pos", "title", "view_count", "like_count", "description"]


def deep_feed(info: DataFrame, known: DataFrame, now: str, n: int = 2500) -> DataFrame:
    """The nightly feed of recorded metadata (with ``pos``, the order of arrival): what passes the quality filter, each id
    once, none that is known already, the first n by raw score with their rank."""
    return feed(unseen(first_by(parse(info, now), ["song_id"], FIRST_COME), known), n)


def refresh(info: DataFrame, songs: DataFrame, feed_songs: DataFrame, now: str, n: int = 100) -> tuple[DataFrame, DataFrame]:
    """The hourly refresh: (catalog with the new songs merged in, feed rows with a new snapshot and without old ones)."""
    top = feed(first_by(parse(info, now), ["song_id"], FIRST_COME), n)
    stamp = F.lit(now).cast("timestamp")
    new = top.withColumn("first_seen", stamp).withColumn("last_seen", stamp).withColumn("times_fetched", F.lit(1)).withColumn("seq", F.col("rank_in_snapshot").cast("long"))
    merged = upsert(songs, new.select("song_id", "seq", *[c for c in SONG_RULES if c in new.columns]), ["song_id"], {c: r for c, r in SONG_RULES.items() if c in songs.columns})
    snapshot = top.select(F.to_date(stamp).alias("snapshot_id"), "song_id", "rank_in_snapshot", "raw_score")
    return merged, retain(feed_songs.select(*snapshot.columns).where(F.col("snapshot_id") != F.to_date(stamp)).unionByName(snapshot), now)


def apply_commands(prefs: DataFrame, commands: DataFrame, *, keep: int = 200) -> DataFrame:
    """Preferences after commands (user_id, seq, command, argument): ``never`` blocks a song (in order, once, the last
    ``keep`` stay), ``anchor`` sets the anchor song, ``adventurous`` a level from 0 to 10. Users without preferences get some.

    A user's commands of one batch meet in one row.
    """
    c = commands.groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("command") == "never", F.struct("seq", "argument")))), lambda x: x["argument"]).alias("never"),
        F.max_by(F.when(F.col("command") == "anchor", F.col("argument")), F.when(F.col("command") == "anchor", F.col("seq"))).alias("to"),
        F.max_by(F.when(F.col("command") == "adventurous", F.col("argument")), F.when(F.col("command") == "adventurous", F.col("seq"))).alias("level"),
    )
    none = F.array().cast("array<string>")
    both = prefs.join(c, "user_id", "full_outer").withColumn("__all", F.array_distinct(F.concat(F.coalesce("blacklist", none), F.coalesce("never", none))))
    level = F.when(F.col("level").isNotNull(), F.greatest(F.lit(0), F.least(F.lit(10), F.col("level").cast("int"))) / 10.0)
    return both.select(
        "user_id", F.slice("__all", F.greatest(F.size("__all") - keep + 1, F.lit(1)), keep).alias("blacklist"), F.coalesce("to", "anchor_song_id").alias("anchor_song_id"), F.coalesce(level, "adventurous", F.lit(0.3)).alias("adventurous"),
    )


# Bloom filter: what the exact anti-join replaces, for those who want the bits.


def bloom_false_positives(n: Column, m: int = 2_000_003, k: int = 7) -> Column:
    return F.pow(1 - F.exp(F.lit(-float(k)) * n / float(m)), F.lit(float(k)))


def _halves(key: Column) -> Column:
    """FNV-1a, 64 bits, of the UTF-8 of a string, as its upper and lower 32 bits, so that no product passes a long.

    The prime is 2^40 + 435: the lower half moves up by 8 bits, and both take 435 times their own.
    """
    octets = F.decode(F.coalesce(key, F.lit("")).cast("binary"), "ISO-8859-1")  # a character an octet
    places = F.when(F.length(octets) > 0, F.sequence(F.lit(1), F.length(octets))).otherwise(F.array().cast("array<int>"))
    half = lambda high, low: F.struct(high.cast("long").alias("high"), low.cast("long").alias("low"))

    def step(h: Column, i: Column) -> Column:
        low = h["low"].bitwiseXOR(F.ascii(F.substring(octets, i, F.lit(1))).cast("long"))
        up = h["high"] * 435 + F.shiftright(low * 435, 32) + F.shiftleft(low, 8)
        return half(up.bitwiseAND(F.lit(0xFFFFFFFF)), (low * 435).bitwiseAND(F.lit(0xFFFFFFFF)))

    return F.aggregate(places, half(F.lit(0xCBF29CE4), F.lit(0x84222325)), step)


def bloom_slots(key: Column, m: int = 2_000_003, k: int = 7) -> Column:
    """Slots of a key: (h * p + p * p) mod m for the first k primes p, h its FNV-1a.

    The hash is worked out once for all slots: it goes through an array of one element.
    """
    rest = lambda h: (h["high"] % m * ((1 << 32) % m) + h["low"]) % m
    slots = lambda r: F.array(*[((r * p + p * p) % m).cast("int") for p in S.primes(30)[:k]])
    return F.element_at(F.transform(F.transform(F.array(_halves(key)), rest), slots), 1)


def bloom_filter(keys: DataFrame, column: str = "song_id", m: int = 2_000_003) -> DataFrame:
    """(bits): one row, the m bits as 64-bit words (250 KB by default), whatever the number of keys.

    Words are combined by bitwise or before they are shuffled, so a task sends at most m / 64 rows.
    """
    n = -(-m // 64)
    word, bit = F.expr("slot div 64"), F.expr("shiftleft(1L, slot % 64)")
    some = keys.select(F.explode(bloom_slots(F.col(column), m)).alias("slot")).groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    every = some.unionByName(keys.sparkSession.range(n).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    # n words
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("bits"))


def bloom_unseen(rows: DataFrame, bits: DataFrame, column: str = "song_id", m: int = 2_000_003) -> DataFrame:
    """Rows whose key has a slot that isn't set: surely new. What the filter takes for known by mistake is left out too.

    bits: of ``bloom_filter`` with the same m. Its one row, of a size that m fixes, is broadcast; rows stay where they are.
    """
    is_unset = lambda slot: F.call_function("shiftrightunsigned", F.element_at("__bits", (F.floor(slot / 64) + 1).cast("int")), slot % 64).bitwiseAND(F.lit(1)) == 0
    one = bits.select(F.col("bits").alias("__bits"))
    return rows.join(F.broadcast(one), F.exists(bloom_slots(F.col(column), m), is_unset), "left_semi")


# Registry and jobs.


def registry(history: DataFrame) -> DataFrame:
    """The current entry of each key: the history is the truth."""
    return latest_by(history, ["key"], "id")


def rollback(history: DataFrame, key: str) -> DataFrame:
    """The history row to go back to: the newest of another run than the current one's."""
    h = history.where(F.col("key") == key)
    current = h.agg(F.max_by("run_id", "id").alias("__run"))
    return h.join(F.broadcast(current), F.col("run_id") != F.col("__run")).drop("__run").orderBy(F.desc("id")).limit(1)


def newest(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(n)


def streaks(days: DataFrame, today: str, newest_days: int = 30) -> DataFrame:
    """Consecutive days up to today by user, over each user's newest days: gaps and islands."""
    d = days.select("user_id", "day").distinct().withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("day")))).where(F.col("r") <= newest_days)
    run = d.where(F.date_add("day", F.col("r")) == F.date_add(F.lit(today).cast("date"), 1))
    return d.select("user_id").distinct().join(run.groupBy("user_id").agg(F.count(F.lit(1)).alias("streak")), "user_id", "left").select("user_id", F.coalesce("streak", F.lit(0)).alias("streak"))
