"""Explicit schemas of the domain tables, and conforming older data to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DDL: dict[str, str] = {
    "songs": "song_id string, title string, channel string, channel_id string, duration int, view_count long, like_count long, upload_date string, genre_code int, language_code int, has_official int, has_lyric int, has_remix int, energy_score double, description string, mood_tags string, first_seen timestamp, last_seen timestamp, times_fetched int",
    "artist_graph": "artist_a string, artist_b string, co_count long, updated_at timestamp",
    "companion_prefs": "user_id long, blacklist array<string>, anchor_song_id string, adventurous double",
    "listening_journal": "user_id long, day date, plays long, likes long, top_genre int",
    "blender_weights": "user_id long, mood string, weights array<double>, ndcg10 double",
    "feed_snapshots": "snapshot_id long, fetched_at timestamp, query_used string",
    "feed_songs": "snapshot_id long, song_id string, rank_in_snapshot int, raw_score double",
    "listens": "id long, user_id long, song_id string, started_at timestamp, completion_pct double, source string, context_genre int, context_hour int, context_dow int",
    "feedback": "id long, user_id long, song_id string, rec_session_id string, signal int, created_at timestamp, model_version string",
    "dislike_counts": "user_id long, count long, last_reset timestamp",
    "recommendation_sessions": "session_id string, user_id long, created_at timestamp, model_version string, algorithm string, status string",
    "rec_items": "session_id string, song_id string, rank int, final_score double, svd_score double, ncf_score double, content_score double, bandit_score double, recency_score double, why_top10 string",
    "bandit_arms": "user_id long, song_id string, alpha double, beta double, n_pulls long, last_pulled timestamp",
    "song_embeddings": "song_id string, vector array<float>, dim int, model_version string",
    "user_embeddings": "user_id long, vector array<float>, dim int, model_version string",
    "training_runs": "run_id string, started_at timestamp, finished_at timestamp, n_train long, n_valid long, loss double, notes string, commit_id string, config string, frame_hash string",
    "split_fingerprints": "run_id string, cutoff_ts timestamp, leave_last_n int, frame_hash string, n_train long, n_valid long",
    "model_registry": "key string, run_id string, model_version string, ndcg10 double, updated_at timestamp",
    "registry_history": "id long, key string, run_id string, model_version string, ndcg10 double, updated_at timestamp",
    "model_artifacts": "run_id string, model_name string, model_path string, metrics string",
    "audio_features": "song_id string, bpm double, musical_key string, mode string, key_alt string, danceability double, valence double, energy double, brightness double, harmonic_clarity double, tempo_strength double, key_strength double, climax_frac double, lift double, chroma array<double>, voice_pct double, vibrato_pct double, median_f0 double, f0_lo double, f0_hi double, voice_enter_s double, register string, peak_f0 double, analyzed_at timestamp",
    "audio_arcs": "song_id string, n_windows int, arousal array<double>, valence array<double>, climax_frac double, lift double, melody_10s array<double>, presence_10s array<double>",
    "track_lyrics": "song_id string, plain string, synced array<struct<t:double,line:string>>, source string",
    "audio_fetch_state": "song_id string, attempts long, last_error string",
    "listen_ledger": "id long, ts timestamp, song_id string, title string, source string, bpm double, musical_key string, mode string, arousal double, valence double, caption string",
    "job_runs": "id long, job string, started_at timestamp, secs double, ok int, note string",
}

#: Values of columns that an older table may lack.
DEFAULTS: dict[str, object] = {"genre_code": 20, "language_code": 0, "energy_score": 0.5, "times_fetched": 1, "alpha": 1.0, "beta": 1.0, "adventurous": 0.3, "has_remix": 0, "n_pulls": 0}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Give df the columns, order and types of a table: missing columns get their default, unknown ones go."""
    out = []
    for f in schema(name):
        value = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(DEFAULTS.get(f.name))
        out.append(value.cast(f.dataType).alias(f.name))
    return df.select(*out)
