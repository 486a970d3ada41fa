"""Scalar functions as Column expressions: rewards, decay, text detection, music priors, words about tracks.

All stay in the JVM. "Falsy" inputs (null or zero) take their default where the domain says so.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PLAN_REWARD = {"full_play": 3.0, "like": 5.0, "partial_play": 1.0, "skip_fast": -2.0, "dislike": -5.0}
LEGACY_REWARD = {"like": 1.0, "dislike": -1.0, "skip_fast": -0.5, "full_play": 0.8, "partial_play": 0.2}
FULL_PLAY, PARTIAL_PLAY = 0.80, 0.30
ALPHA = 2.0
INTERACTION_HALFLIFE_DAYS, LISTEN_HALFLIFE_HOURS, FEED_HALFLIFE_HOURS = 30.0, 168.0, 24.0
GENRES = {
    "lofi": 0, "hip hop": 1, "rap": 2, "pop": 3, "edm": 4, "electronic": 4, "rnb": 5, "r&b": 5, "indie": 6, "rock": 7, "metal": 8, "jazz": 9,
    "classical": 10, "country": 11, "latin": 12, "k-pop": 13, "hindi": 14, "punjabi": 15, "trap": 16, "drill": 17, "soul": 18, "afrobeats": 19,
}
UNKNOWN_GENRE = 20
MOODS = ["4am", "acoustic", "bhajan", "chill", "focus", "folk", "gym", "heartbreak", "lofi", "love", "morning", "night", "party", "romantic", "sad", "soulful", "vibes", "workout"]
ENERGY_WORDS = ["fire", "banger", "heat", "vibe", "lit", "hard", "beast", "crazy", "insane", "anthem", "official", "remix", "live"]
GROOVE_CUES = {
    "dance": 1.0, "club": 0.9, "party": 0.9, "workout": 0.9, "gym": 0.8, "banger": 0.9, "beat": 0.6, "groove": 0.8, "remix": 0.5, "dhol": 0.8,
    "bhangra": 0.9, "salsa": 0.9, "samba": 0.9, "edm": 0.8, "house": 0.8, "anthem": 0.5, "march": 0.6,
}
CALM_CUES = {"lullaby": 1.0, "sleep": 0.9, "ambient": 0.8, "meditation": 0.9, "lofi": 0.6, "acoustic": 0.4, "ballad": 0.5, "slow": 0.7, "night": 0.3}
HARMONY_CUES = {
    "harmony": 1.0, "chorus": 0.8, "choir": 0.9, "duet": 0.7, "acapella": 0.9, "acoustic": 0.6, "unplugged": 0.6, "symphony": 0.8, "orchestra": 0.7,
    "anthem": 0.5, "ballad": 0.5, "soulful": 0.6, "melody": 0.6,
}
TITLE_STOP_WORDS = ["in", "the", "a", "an", "official", "audio", "video", "lyric", "lyrics", "visualizer", "feat", "ft", "hq", "hd", "explicit", "remastered"]
JUST_RATIOS = {0: (1, 1), 2: (9, 8), 3: (6, 5), 4: (5, 4), 5: (4, 3), 7: (3, 2), 9: (5, 3), 12: (2, 1)}
ROUGH_INTERVALS = {1: 0.15, 6: 0.1, 11: 0.2, 10: 0.35, 8: 0.45}
FIFTHS = ["C", "G", "D", "A", "E", "B", "F#", "C#", "Ab", "Eb", "Bb", "F"]
ENHARMONIC = {"G#": "Ab", "D#": "Eb", "A#": "Bb", "Db": "C#", "Gb": "F#"}
BLEND = {
    "als": 0.22, "feature_mf": 0.18, "svd": 0.12, "ncf": 0.08, "two_tower": 0.10, "content": 0.10,
    "bandit": 0.08, "recency": 0.05, "retriever": 0.04, "sequence": 0.03, "freshness": 0.02, "repeat_pen": -0.06,
}
FIXED_BLEND = {"als": 0.22, "feature_mf": 0.14, "svd": 0.10, "ncf": 0.06, "two_tower": 0.08, "content": 0.10, "bandit": 0.08, "recency": 0.05, "retriever": 0.10, "sequence": 0.07}
EVAL_MIXTURE = {"als": 0.35, "two_tower": 0.25, "retriever": 0.25, "sequence": 0.15}
GOLDEN = (1 + math.sqrt(5)) / 2


def falsy(x: Column, default: float) -> Column:
    """Null and zero become the default."""
    return F.coalesce(F.nullif(x, F.lit(0).cast("double")), F.lit(default))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


# Rewards and decay.


def completion_reward(pct: Column) -> Column:
    p = F.coalesce(pct, F.lit(0.0))
    return F.when(p >= FULL_PLAY, PLAN_REWARD["full_play"]).when(p >= PARTIAL_PLAY, PLAN_REWARD["partial_play"]).otherwise(PLAN_REWARD["skip_fast"])


def signal_reward(signal: Column) -> Column:
    return F.when(signal > 0, PLAN_REWARD["like"]).otherwise(PLAN_REWARD["dislike"])


def legacy_reward(r: Column) -> Column:
    """The plan reward of a legacy value, if it is one; any other is clamped to 5 either way."""
    out = None
    for name, value in LEGACY_REWARD.items():
        out = (F.when if out is None else out.when)(r == value, PLAN_REWARD[name])
    return out.otherwise(clip(r, -5.0, 5.0))


def confidence(reward: Column, alpha: float = ALPHA, legacy_alias: bool = False) -> Column:
    """1 + alpha * reward for positive rewards, else 1. legacy_alias: rewards pass the legacy table first, so 1 reads as 5."""
    r = legacy_reward(reward) if legacy_alias else reward
    return F.when(r > 0, 1 + alpha * r).otherwise(F.lit(1.0))


def age_seconds(at: Column, now: str) -> Column:
    return (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(at)) / 1e6


def half_life(x: Column, age: Column, half: float) -> Column:
    return F.when(age <= 0, x).otherwise(x * F.pow(F.lit(0.5), age / half))


def recency(last_seen: Column, now: str) -> Column:
    hours = F.greatest(age_seconds(last_seen, now) / 3600, F.lit(0.0))
    return F.when(last_seen.isNull(), 0.3).otherwise(F.pow(F.lit(0.5), hours / LISTEN_HALFLIFE_HOURS))


def freshness(upload_date: Column, now: str) -> Column:
    hours = age_seconds(F.try_to_timestamp(upload_date, F.lit("yyyyMMdd")), now) / 3600
    return F.coalesce(F.pow(F.lit(0.5), hours / FEED_HALFLIFE_HOURS), F.lit(0.5))


# Titles.


def has_word(text: Column, word: str) -> Column:
    """A word or phrase between characters that are no letters, digits or underscores, in any script."""
    quoted = "".join("\\" + c if not (c.isalnum() or c in " _") else c for c in word)
    return text.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){quoted}([^\p{{L}}\p{{N}}_]|$)")


def _text(title: Column, description: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))


def genre(title: Column, description: Column) -> Column:
    """Code of the longest genre word found; of equally long ones, the first listed."""
    text, out = _text(title, description), None
    for word in sorted(GENRES, key=len, reverse=True):
        out = (F.when if out is None else out.when)(has_word(text, word), GENRES[word])
    return out.otherwise(UNKNOWN_GENRE)


def mood_tags(title: Column, description: Column) -> Column:
    text = _text(title, description)
    return F.concat_ws(",", F.slice(F.array_compact(F.array(*[F.when(has_word(text, m), F.lit(m)) for m in MOODS])), 1, 8))


def language(title: Column) -> Column:
    """Language code by script: 1 Devanagari, 4 Hangul, 8 Han, 3 Spanish letters, else 0."""
    return (
        F.when(title.rlike(r"[\x{0900}-\x{097F}]"), 1).when(title.rlike(r"[\x{AC00}-\x{D7AF}]"), 4).when(title.rlike(r"[\x{4E00}-\x{9FFF}]"), 8)
        .when(F.lower(title).rlike("[ñáéíóúü]"), 3).otherwise(0)
    )


def fibonacci(n: int) -> list[int]:
    a, b, out = 1, 1, []
    for _ in range(n):
        out.append(a)
        a, b = b, a + b
    return out


def primes(limit: int) -> list[int]:
    return [n for n in range(2, limit + 1) if all(n % d for d in range(2, math.isqrt(n) + 1))]


def energy(title: Column) -> Column:
    """Fibonacci weight of the number of energy words in the title, as a share of the twentieth."""
    steps = fibonacci(20)
    hits = sum((F.when(F.lower(title).contains(w), 1).otherwise(0) for w in ENERGY_WORDS), F.lit(0))
    return F.element_at(F.array(*[F.lit(s / steps[-1]) for s in steps]), F.least(hits, F.lit(19)) + 1)


def tag_flag(title: Column, *words: str) -> Column:
    return F.when(F.lower(title).rlike("|".join(words)), 1).otherwise(0)


def raw_score(views: Column, likes: Column, fresh: Column, energy_score: Column) -> Column:
    v, like = F.greatest(F.coalesce(views, F.lit(0)), F.lit(1)).cast("double"), F.coalesce(likes, F.lit(0)).cast("double")
    return F.log10(v) * like / F.greatest(like + F.sqrt(v) * 0.05, F.lit(1.0)) * fresh * (1 + energy_score)


def title_tokens(title: Column) -> Column:
    plain = F.regexp_replace(F.lower(title), r"\(.*?\)", " ")
    return F.array_except(F.regexp_extract_all(plain, F.lit("([a-z0-9]+)"), 1), F.array(*map(F.lit, TITLE_STOP_WORDS)))


def title_ok(wanted: Column, got: Column) -> Column:
    w = title_tokens(wanted)
    need = F.greatest(F.lit(1), F.floor(F.size(w) / 2).cast("int"))
    return (F.size(w) == 0) | (F.size(F.array_intersect(w, title_tokens(got))) >= need)


def artist_match(wanted: Column, got: Column) -> Column:
    w, g = F.lower(F.trim(wanted)), F.lower(F.trim(got))
    return (w == "") | g.contains(w) | w.contains(g)


def words(text: Column) -> Column:
    """Lower case, no punctuation, split on white space; letters of any script."""
    plain = F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", "")
    return F.filter(F.split(plain, r"(?U)\s+"), lambda w: w != "")


def slug(title: Column) -> Column:
    s = F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 60)


def clean_lyrics_title(title: Column) -> Column:
    """Without bracketed parts, tags after a bar, and marketing words."""
    s = F.regexp_replace(title, r"\(.*?\)|\[.*?\]", " ")
    s = F.regexp_replace(s, r"(?i)\b(official|video|audio|lyrics?|visualizer)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_extract(s, r"^([^|]*)", 1), r"\s+", " "))


# Priors from music theory.


def tempo_fit(bpm: Column) -> Column:
    z = (bpm - 120.0) / 35.0
    return F.when(F.coalesce(bpm, F.lit(0.0)) <= 0, 0.5).otherwise(F.exp(-0.5 * z * z))


def _cues(text: Column, table: dict[str, float]) -> Column:
    """Sum of the cue values of a text's words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]+)"), 1)
    cues = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.aggregate(found, F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at(cues, w), F.lit(0.0)))


def groove(title: Column, seconds: Column) -> Column:
    cue = 0.5 + 0.25 * (_cues(title, GROOVE_CUES) - _cues(title, CALM_CUES))
    z = (seconds / 60.0 - 3.5) / 2.0
    return clip(F.when(F.coalesce(seconds, F.lit(0)) > 0, 0.7 * cue + 0.3 * F.exp(-0.5 * z * z)).otherwise(cue), 0.0, 1.0)


def title_consonance(title: Column) -> Column:
    n = F.size(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("([a-z]+)"), 1))
    return F.when(n == 0, 0.5).otherwise(clip(0.5 + _cues(title, HARMONY_CUES) / n * 0.5, 0.0, 1.0))


def title_bonus(title: Column, seconds: Column) -> Column:
    return F.round(clip((title_consonance(title) - 0.5) * 0.08 + (groove(title, seconds) - 0.5) * 0.12, -0.05, 0.10), 4)


def measured_bonus(bpm: Column, key_strength: Column, danceability: Column) -> Column:
    fit = F.when(F.coalesce(bpm, F.lit(0.0)) == 0, 0.5).otherwise(tempo_fit(bpm))
    return F.round(clip((fit - 0.5) * 0.12 + (falsy(key_strength, 0.5) - 0.5) * 0.08 + (falsy(danceability, 0.5) - 0.5) * 0.06, -0.05, 0.12), 4)


def gradus(numerator: int, denominator: int) -> int:
    """Euler's gradus suavitatis of one ratio: 1 plus the prime factors, less one each, of the least common multiple."""
    n, out = math.lcm(numerator, denominator), 1
    for p in range(2, n + 1):
        while n % p == 0:
            n, out = n // p, out + p - 1
    return out


def interval_table() -> list[tuple[int, float]]:
    """(semitones, consonance) of the twelve intervals."""
    smooth = {s: max(0.0, 1 - (gradus(*r) - 1) / 12) for s, r in JUST_RATIOS.items()}
    return [(s, smooth.get(s, ROUGH_INTERVALS.get(s, 0.4))) for s in range(12)]


def interval_consonance(semitones: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for _, c in interval_table()]), (F.abs(semitones) % 12 + 1).cast("int"))


def fifth_distance(a: Column, b: Column, enharmonic: bool = True) -> Column:
    """Steps on the circle of fifths, 6 if a key is unknown. Sharps that the circle spells as flats are read as such
    unless enharmonic is False."""
    circle, flats = F.array(*map(F.lit, FIFTHS)), F.create_map(*[F.lit(x) for kv in ENHARMONIC.items() for x in kv])
    at = lambda k: F.array_position(circle, F.coalesce(F.try_element_at(flats, k), k) if enharmonic else k)
    d = at(a) - at(b)
    return F.when((F.coalesce(at(a), F.lit(0)) == 0) | (F.coalesce(at(b), F.lit(0)) == 0), 6).otherwise(F.least(F.pmod(d, F.lit(12)), F.pmod(-d, F.lit(12)))).cast("int")


def golden_climax(fraction: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(fraction - 1 / GOLDEN) * GOLDEN), F.lit(0.5))


def fibonacci_balance(a: Column, b: Column) -> Column:
    ratio = F.greatest(a, b) / F.nullif(F.least(a, b), F.lit(0.0))
    return F.when((a <= 0) | (b <= 0), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(ratio - GOLDEN) / GOLDEN))


def zipf_prior(rank: Column, total: Column, alpha: float = 1.2) -> Column:
    r, t = F.greatest(rank, F.lit(1)), F.greatest(total, F.lit(1))
    return 0.5 * F.pow(r.cast("double"), F.lit(-alpha)) + 0.5 * (1 - r / t)


# Scores.


def norm(score: Column) -> Column:
    """[-1, 1] to [0, 1], clipped; missing is 0."""
    return clip((F.coalesce(score, F.lit(0.0)) + 1) / 2, 0.0, 1.0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-clip(x, -30.0, 30.0)))


def blend(weights: dict[str, float] = BLEND, prefix: str = "s_") -> Column:
    """2 sigmoid(w . x) - 1 over the score columns; missing scores are 0."""
    z = sum((w * F.coalesce(F.col(prefix + k), F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    return 2 * sigmoid(z) - 1


def weighted(weights: dict[str, float], prefix: str = "s_") -> Column:
    return sum((w * F.coalesce(F.col(prefix + k), F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))


def exploration_slots(level: Column) -> Column:
    """level / 10 * 5, rounded half to even."""
    return F.bround(level / 10 * 5).cast("int")


# Words about tracks, our own.


def bucket(x: Column, low: float = 0.33, high: float = 0.66) -> Column:
    return F.when(x > high, "hi").when(x < low, "lo").otherwise("mid")


def mood_label(arousal: Column, valence: Column) -> Column:
    word = F.when(valence < 0.35, "aching").when(valence > 0.6, "warm").otherwise("wistful")
    return F.concat(F.when(arousal > 0.7, "burning ").when(arousal < 0.35, "quiet ").otherwise(""), word)


def lyric_section(arousal: Column) -> Column:
    return F.when(arousal < 0.3, "verse").when(arousal < 0.5, "lift").otherwise("chorus")


def caption(bpm: Column, key: Column, mode: Column, valence: Column, energy_: Column, brightness: Column, clarity: Column, lift: Column, climax: Column, voice_pct: Column, voice_enter: Column) -> Column:
    """One sentence on a track's measured features: tempo, key, mood, texture, arc, and voice if there is any."""
    tempo = F.when(bpm <= 0, "Untimed").when(bpm < 90, "Slow").when(bpm < 110, "Relaxed").when(bpm < 135, "Driving").otherwise("Racing")
    minor = F.when(valence < 0.35, "mournful").when(valence < 0.55, "pensive").otherwise("gentle")
    major = F.when(valence > 0.6, "bright").when(valence > 0.4, "mellow").otherwise("bittersweet")
    body = F.when(energy_ < 0.4, "soft").when(energy_ < 0.7, "even").otherwise("forceful")
    space = F.when(brightness < 0.35, "close").when(brightness < 0.6, "plain").otherwise("airy")
    focus = F.when(clarity > 0.6, ", clear").when(clarity < 0.3, ", blurred").otherwise("")
    peak = F.when(climax < 0.4, "early").when(climax < 0.8, "past the middle").otherwise("at the end")
    arc = F.when(lift < 0.15, "stays level").otherwise(F.concat(F.when(lift > 0.35, "rises steeply, cresting ").otherwise("rises a little, cresting "), peak))
    beats = F.when(bpm > 0, F.concat(F.lit(" at "), F.round(bpm).cast("int").cast("string"), F.lit(" BPM"))).otherwise("")
    voice = F.when(voice_pct > 0.05, F.concat(F.lit(" A voice enters after "), F.round(voice_enter).cast("int").cast("string"), F.lit(" s."))).otherwise("")
    return F.concat(tempo, F.lit(" "), F.when(mode == "minor", minor).otherwise(major), F.lit(" song in "), F.coalesce(key, F.lit("?")), F.lit(" "), mode, beats, F.lit(": "), body, F.lit(" and "), space, focus, F.lit("; it "), arc, F.lit("."), voice)


def interval_words(seconds: Column) -> Column:
    return F.when(seconds % 3600 == 0, F.concat((seconds / 3600).cast("int").cast("string"), F.lit("h"))).when(seconds % 60 == 0, F.concat((seconds / 60).cast("int").cast("string"), F.lit("m"))).otherwise(F.concat(seconds.cast("string"), F.lit("s")))


#: Why music moves people: topic to (claim, mathematics), in our own words.
CLAIMS: dict[str, tuple[str, str]] = {
    "consonance": ("Notes whose frequencies form small ratios blend.", "Euler's gradus counts the prime factors of a ratio's least common multiple."),
    "entrainment": ("Bodies fall in with a pulse near walking pace.", "A Gaussian around 120 beats a minute, 35 wide."),
    "proportion": ("Climaxes just past the middle feel right.", "The golden section lies at 0.618 of a track."),
    "replay": ("Few songs get most of the plays.", "Zipf: plays fall with rank to the power -1.2."),
    "keys": ("Neighbouring keys share most of their notes.", "Steps on the circle of fifths, six at most."),
}


def track_reasons(title: Column, seconds: Column, channel: Column) -> Column:
    """What speaks for a track by its title, length and artist; never empty."""
    found = F.array_compact(F.array(
        F.when(title_consonance(title) > 0.6, F.lit("consonant")), F.when(groove(title, seconds) > 0.65, F.lit("danceable")),
        F.when(F.lower(title).rlike("anthem|chorus|sing"), F.lit("singable")), F.when(F.trim(F.coalesce(channel, F.lit(""))) != "", F.concat(F.lit("voice of "), channel)),
    ))
    return F.when(F.size(found) == 0, F.array(F.lit("melodic"))).otherwise(found)
