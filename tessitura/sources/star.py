"""The domain tables as views of the star-schema test tables, in Spark and, for checking, in DuckDB SQL.

``NOW`` is a constant, so that ages don't depend on the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"
KEYS = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


class Star:
    """Lazy domain tables of one folder of parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _events(self, *types: str) -> DataFrame:
        return self.raw("events").where(F.col("event_type").isin(*types)).select(
            F.col("event_id").alias("id"), "user_id", F.get_json_object("props", "$.k").alias("song_id"), "event_type", "value", F.col("ts").cast("timestamp").alias("ts")
        )

    def listens(self) -> DataFrame:
        return self._events("view", "click", "signup").select("id", "user_id", "song_id", F.col("ts").alias("started_at"), F.least(F.col("value") / 100, F.lit(1.0)).alias("completion_pct"))

    def feedback(self) -> DataFrame:
        signal = F.when(F.col("event_type") == "purchase", 1).otherwise(-1)
        return self._events("purchase", "error").select("id", "user_id", "song_id", signal.alias("signal"), F.col("ts").alias("created_at"))

    def songs(self) -> DataFrame:
        k = F.col("p_partkey")
        views = F.round(F.col("p_retailprice") * 1000).cast("long")
        return self.raw("part").select(
            k.cast("string").alias("song_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("channel"), (F.lit(120) + F.col("p_size") * 11).cast("int").alias("duration"),
            views.alias("view_count"), F.expr("cast(round(p_retailprice * 1000) as bigint) div (20 + p_partkey % 30)").alias("like_count"),
            F.concat(F.lit("202401"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("upload_date"), (k % 20).cast("int").alias("genre_code"), (k % 10).cast("int").alias("language_code"),
            (F.col("p_size") / 50.0).alias("energy_score"), F.lower("p_type").alias("description"),
            F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(p_partkey % 20 as int))").alias("first_seen"),
            F.expr("timestamp'2024-01-31 12:00:00' - make_interval(0, 0, 0, cast(p_partkey % 15 as int))").alias("last_seen"), (k % 5 + 1).cast("int").alias("times_fetched"),
        )

    def audio_features(self) -> DataFrame:
        k, s = F.col("p_partkey"), F.col("p_size")
        return self.raw("part").where("p_partkey % 3 <> 0").select(
            k.cast("string").alias("song_id"), (F.when(k % 11 == 0, 0.0).otherwise(60.0 + s * 2.5)).alias("bpm"),
            F.element_at(F.array(*map(F.lit, KEYS)), (k % 12 + 1).cast("int")).alias("musical_key"), F.when(k % 2 == 0, "major").otherwise("minor").alias("mode"),
            ((k * 7 % 100) / 100.0).alias("danceability"), ((k * 13 % 101) / 101.0).alias("valence"), (s / 50.0).alias("energy"), ((k * 17 % 97) / 97.0).alias("brightness"),
            ((k * 5 % 89) / 89.0).alias("harmonic_clarity"), ((k * 3 % 50) / 50.0).alias("key_strength"), ((k * 19 % 60) / 60.0).alias("lift"), ((k * 23 % 100) / 100.0).alias("climax_frac"),
            ((k * 29 % 40) / 40.0).alias("voice_pct"), (k % 30).cast("double").alias("voice_enter_s"),
        )

    def ledger(self) -> DataFrame:
        """Listens of measured songs: arousal is clip(.6 energy + .4 danceability)."""
        a = self.audio_features().select("song_id", "bpm", "musical_key", "mode", "danceability", "energy", "valence")
        arousal = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * F.col("energy") + 0.4 * F.col("danceability")))
        return self.listens().join(a, "song_id").select("id", F.col("started_at").alias("ts"), "user_id", "song_id", "bpm", "musical_key", "mode", arousal.alias("arousal"), "valence")

    def feed_songs(self) -> DataFrame:
        """Daily snapshots: songs by number of events that day."""
        from pyspark.sql import Window

        n = self._events("view", "click", "signup", "purchase", "error").groupBy(F.to_date("ts").alias("snapshot_id"), "song_id").agg(F.count(F.lit(1)).alias("n"))
        rank = F.row_number().over(Window.partitionBy("snapshot_id").orderBy(F.desc("n"), "song_id"))
        return n.select("snapshot_id", "song_id", rank.alias("rank_in_snapshot"), F.col("n").cast("double").alias("raw_score"))

    def purchases(self) -> DataFrame:
        """The large interaction log: who ordered what, when."""
        li = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
        o = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("song_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity")
        )


#: The same views for DuckDB, as common table expressions.
CTE: dict[str, str] = {
    "listens": "listens AS (SELECT event_id AS id, user_id, json_extract_string(props, '$.k') AS song_id, ts AS started_at, least(value / 100, 1.0) AS completion_pct FROM events WHERE event_type IN ('view', 'click', 'signup'))",
    "feedback": "feedback AS (SELECT event_id AS id, user_id, json_extract_string(props, '$.k') AS song_id, CASE event_type WHEN 'purchase' THEN 1 ELSE -1 END AS signal, ts AS created_at FROM events WHERE event_type IN ('purchase', 'error'))",
    "songs": "songs AS (SELECT p_partkey::VARCHAR AS song_id, p_name AS title, p_brand AS channel, (120 + p_size * 11)::INT AS duration, round(p_retailprice * 1000)::BIGINT AS view_count, round(p_retailprice * 1000)::BIGINT // (20 + p_partkey % 30) AS like_count, '202401' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') AS upload_date, (p_partkey % 20)::INT AS genre_code, (p_partkey % 10)::INT AS language_code, p_size / 50.0::DOUBLE AS energy_score, lower(p_type) AS description, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (p_partkey % 20) AS first_seen, TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 1 DAY * (p_partkey % 15) AS last_seen, (p_partkey % 5 + 1)::INT AS times_fetched FROM part)",
    "audio": "audio AS (SELECT p_partkey::VARCHAR AS song_id, CASE WHEN p_partkey % 11 = 0 THEN 0.0::DOUBLE ELSE 60.0::DOUBLE + p_size * 2.5::DOUBLE END AS bpm, (['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'])[p_partkey % 12 + 1] AS musical_key, CASE WHEN p_partkey % 2 = 0 THEN 'major' ELSE 'minor' END AS mode, (p_partkey * 7 % 100) / 100.0::DOUBLE AS danceability, (p_partkey * 13 % 101) / 101.0::DOUBLE AS valence, p_size / 50.0::DOUBLE AS energy, (p_partkey * 17 % 97) / 97.0::DOUBLE AS brightness, (p_partkey * 5 % 89) / 89.0::DOUBLE AS harmonic_clarity, (p_partkey * 3 % 50) / 50.0::DOUBLE AS key_strength, (p_partkey * 19 % 60) / 60.0::DOUBLE AS lift, (p_partkey * 23 % 100) / 100.0::DOUBLE AS climax_frac, (p_partkey * 29 % 40) / 40.0::DOUBLE AS voice_pct, (p_partkey % 30)::DOUBLE AS voice_enter_s FROM part WHERE p_partkey % 3 <> 0)",
    "ledger": "ledger AS (SELECT l.id, l.started_at AS ts, l.user_id, song_id, bpm, musical_key, mode, greatest(0.0, least(1.0, 0.6::DOUBLE * energy + 0.4::DOUBLE * danceability)) AS arousal, valence FROM listens l JOIN audio USING (song_id))",
    "feed": "feed AS (SELECT ts::DATE AS snapshot_id, json_extract_string(props, '$.k') AS song_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY count(*) DESC, json_extract_string(props, '$.k')) AS rank_in_snapshot, count(*)::DOUBLE AS raw_score FROM events GROUP BY 1, 2)",
    "purchases": "purchases AS (SELECT o_custkey AS user_id, l_partkey AS song_id, o_orderdate AS ts, l_orderkey AS order_id, l_linenumber AS line, l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
}
_NEEDS = {"ledger": ["listens", "audio"]}


def with_views(*names: str, then: str) -> str:
    """A DuckDB statement over the named views; ``then`` goes on after them, with more CTEs or SELECT."""
    order: list[str] = []
    for n in names:
        for m in [*_NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    head = "WITH RECURSIVE " + ", ".join(CTE[n] for n in order)
    body = then.strip()
    return f"{head}\n{body}" if body[:6].upper() == "SELECT" else f"{head},\n{body}"
