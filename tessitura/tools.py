"""A line-by-line JSON-RPC tool server over the affect and serving queries: initialize, ping, tools/list, tools/call."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "2024-11-05"
#: Tool name to (description, registered query, arguments). An argument called like a column of the answer chooses its
#: rows; ``top_k`` and ``limit`` bound them by rank and number.
TOOLS: dict[str, tuple[str, str, dict[str, str]]] = {
    "recommend": ("Top songs of a user, or of all, with reasons", "recommend_all", {"user_id": "integer", "top_k": "integer", "slots": "integer", "mood": "string"}),
    "status": ("Counts of songs, listens, feedback and heard tracks", "status_counts", {}),
    "heard_library": ("Every heard track with its measures", "heard_library", {"song_id": "string", "limit": "integer"}),
    "emotion_now": ("Mood of the latest hearings by user", "emotion_now", {"user_id": "integer"}),
    "taste_profile": ("Home key, tempo and feel of what was heard", "taste_profile", {"user_id": "integer"}),
    "feel_like": ("Songs that feel like one, like a mood, or like a tempo and valence", "feel_like", {"song_id": "string", "mood": "string", "bpm": "number", "valence": "number", "limit": "integer"}),
    "dossier": ("All that is known of one song", "dossier", {"song_id": "string"}),
}


def chosen(rows: DataFrame, arguments: dict, limit: int) -> DataFrame:
    """The rows of an answer that a call's arguments ask for."""
    for name, value in arguments.items():
        if name in rows.columns and not isinstance(value, (dict, list)):
            rows = rows.where(F.col(name) == F.lit(value))
    if "rank" in rows.columns:
        rows = rows.where(F.col("rank") <= int(arguments.get("top_k", limit))).orderBy("rank")
    return rows.limit(min(limit, int(arguments.get("limit", limit))))


def with_arguments(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[dict], DataFrame]]:
    """Tools that compute only what their arguments ask for: one user's candidates, a seed's neighbours, one song."""
    from tessitura.operators import affect as A
    from tessitura.plans import feel, learned
    from tessitura.sources.star import Star

    def recommend(a: dict) -> DataFrame:
        users = [int(a["user_id"])] if a.get("user_id") is not None else None
        return learned.recommend(spark, sf_dir, users=users, top_k=int(a.get("top_k") or 10), slots=a.get("slots"), mood=str(a.get("mood") or ""))[0]

    def feel_like(a: dict) -> DataFrame:
        seed = None if a.get("song_id") else A.feel_seed(str(a.get("mood") or ""), float(a.get("bpm") or 0), float(a["valence"]) if a.get("valence") is not None else -1)
        return A.feel_like(Star(spark, sf_dir).audio_features(), song_id=a.get("song_id") or None, seed=seed, n=int(a.get("limit") or 5))

    return {"recommend": recommend, "feel_like": feel_like, "dossier": lambda a: feel.dossier(spark, sf_dir, str(a.get("song_id") or "1"))}


def answer(message: dict, call: Callable[[str], DataFrame], limit: int = 50, direct: dict[str, Callable[[dict], DataFrame]] | None = None) -> dict | None:
    """The reply to one message; notifications have none. Rows of a tool's answer are limited for the wire only.

    call: gives the rows of a registered query, from which the arguments then choose. direct: tools that take their
    arguments themselves.
    """
    method, out = message.get("method"), {"jsonrpc": "2.0", "id": message.get("id")}
    if "id" not in message:
        return None
    if method == "initialize":
        return out | {"result": {"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "tessitura", "version": "1"}}}
    if method == "ping":
        return out | {"result": {}}
    if method == "tools/list":
        return out | {"result": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: {"type": v} for k, v in a.items()}}} for n, (d, _, a) in TOOLS.items()]}}
    if method == "tools/call":
        params = message.get("params") or {}
        name = params.get("name")
        if name in TOOLS:
            arguments = params.get("arguments") or {}
            if direct and name in direct:
                try:
                    found = direct[name](arguments).limit(limit)
                except (TypeError, ValueError) as e:
                    return out | {"error": {"code": -32602, "message": f"arguments of {name}: {e}"}}
            else:
                found = chosen(call(TOOLS[name][1]), arguments, limit)
            rows = [json.loads(r) for r in found.toJSON().collect()]
            return out | {"result": {"content": [{"type": "text", "text": json.dumps(rows, ensure_ascii=False)}]}}
        return out | {"error": {"code": -32602, "message": f"unknown tool {name}"}}
    return out | {"error": {"code": -32601, "message": f"unknown method {method}"}}


def serve(spark: SparkSession, sf_dir: str, lines: Iterable[str] = sys.stdin) -> None:
    from tessitura.plans import registry

    queries, direct = registry()[0], with_arguments(spark, sf_dir)
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            continue
        if (reply := answer(message, lambda name: queries[name](spark, sf_dir), direct=direct)) is not None:
            print(json.dumps(reply, ensure_ascii=False), flush=True)
