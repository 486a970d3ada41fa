"""The registered opN_ queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import clustering, decontamination, lm, mixing, prefix_trie, quality, rules, sharding, simhash, token_counts, token_files, toxicity, warc
from tessitura.llm._shared import new_folder, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 24)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mixing.mix(table(spark, sf_dir, "documents"), entropy_share=0.95, repetition_limit=2.0, block_tokens=100_000)
    return done.select("doc_id", "source", "copy", "n_tokens", "block", "slot")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = toxicity.classify(docs, table(spark, sf_dir, "labels"))
    probabilities = [F.round(F.col(f"toxicity.{c}"), 6).alias(f"p_{c}") for c in toxicity.LINKS]
    return done.select("doc_id", *probabilities, F.col("is_toxic").alias("toxic"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, token_counts.load_vocabulary()).select("doc_id", "n_pretokens", "n_tokens")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3)
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _remainder(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), (F.col("quality") == 1) & (_remainder(4) != 2))
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out")
    return quality.score_documents(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_remainder(7) == 2, F.lit(False))
    done = lm.score_documents(docs, ~held_out)
    return done.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = warc.read_archives(warc.write_archives(pages, warc.archive_folder(spark)))
    kind = pages.schema["page_id"].dataType
    return found.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")), "v1")
    base = F.col("failed").bitwiseAND(F.lit(rules.POLICIES["base"])) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed", "n_lines", "n_upper", "n_exclamations")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_tokens(table(spark, sf_dir, "documents"), new_folder(spark, "token-files"), token_files.default_tokenizer(), end_id=0, keep=["lang", "source"])
    return token_files.with_checksums(spark, folder)


#: The parameters of op12: components, factor before rounding, centroids, rounds.
DIM, SCALE, CENTROIDS, ROUNDS = 64, 256, 40, 5


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = clustering.integer_vectors(table(spark, sf_dir, "embeddings"), DIM, SCALE)
    done = clustering.yinyang(vectors, clustering.first_centroids(vectors, CENTROIDS, "2:"), ROUNDS)
    return clustering.summarised(done).select(F.col("__id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, members = prefix_trie.rebased(prefix_trie.ordered_turns(table(spark, sf_dir, "conversations")), group=5, heads=9)
    return prefix_trie.build(turns, members).drop("n_ends").withColumnRenamed("saved_bytes", "saved_tokens")


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_language_model": op7_language_model,
    "op8_warc": op8_warc,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
    "op11_token_files": op11_token_files,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_conversation_trie": op13_conversation_trie,
}


ORACLE_SQL: dict[str, str] = {}

def _crc32_sql(octets: str) -> str:
    """DuckDB SQL of the CRC-32 of a list of octets (UBIGINT): the polynomial's division, four bits at a time."""
    table = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(f"{n}::UBIGINT")
    step = lambda c, b: f"xor([{', '.join(table)}][(xor({c}, {b}) & 15)::INT + 1], ({c}) >> 4)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {octets}), lambda c, b: {step(step('c', 'b'), '(b >> 4)')}), 4294967295::UBIGINT)::BIGINT"


ORACLE_SQL["op1_sharding"] = f"""
WITH docs AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::UBIGINT) AS octets FROM documents
), sized AS (
  SELECT doc_id, len(octets)::BIGINT + 8 AS size, {_crc32_sql('octets')} AS text_crc32 FROM docs
), placed AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(size) OVER () AS total FROM sized
), cut AS (
  SELECT *, least(23, start * 24 // total)::INT AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, NULL::INT AS grown_shard FROM cut
"""

ORACLE_SQL["op2_mixing"] = r"""
WITH RECURSIVE counted AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS text_md5, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS n_tokens FROM documents
), sources AS (
  SELECT source, sum(n_tokens)::BIGINT AS all_tokens, sum(n_tokens)::DOUBLE / (SELECT sum(n_tokens) FROM counted) AS p FROM counted GROUP BY source
), spread(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1,
    CASE WHEN (SELECT ln(sum(pow(p, (low + high) / 2))) - (low + high) / 2 * sum(pow(p, (low + high) / 2) * ln(p)) / sum(pow(p, (low + high) / 2)) >= 0.95 * ln(count(*)) - 1e-12 FROM sources) THEN (low + high) / 2 ELSE low END,
    CASE WHEN (SELECT ln(sum(pow(p, (low + high) / 2))) - (low + high) / 2 * sum(pow(p, (low + high) / 2) * ln(p)) / sum(pow(p, (low + high) / 2)) >= 0.95 * ln(count(*)) - 1e-12 FROM sources) THEN high ELSE (low + high) / 2 END
  FROM spread WHERE i < 40
), calm(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1,
    CASE WHEN (SELECT pow(max(p) / min(p), 1 - (low + high) / 2) <= 2.0 FROM sources) THEN low ELSE (low + high) / 2 END,
    CASE WHEN (SELECT pow(max(p) / min(p), 1 - (low + high) / 2) <= 2.0 FROM sources) THEN (low + high) / 2 ELSE high END
  FROM calm WHERE i < 40
), exponent AS (
  SELECT greatest(
    CASE WHEN (SELECT ln(count(*)) - 1e-9 < -sum(p * ln(p)) FROM sources) THEN 1.0 ELSE floor((SELECT low FROM spread WHERE i = 40) * 1e6) / 1e6 END,
    CASE WHEN (SELECT max(p) / min(p) <= 2.0 FROM sources) THEN 0.0 ELSE ceil((SELECT high FROM calm WHERE i = 40) * 1e6) / 1e6 END) AS a
), weights AS (
  SELECT source, all_tokens, greatest(all_tokens, round((SELECT sum(n_tokens) FROM counted)::DOUBLE * pow((SELECT max(p) FROM sources), 1 - (SELECT a FROM exponent)) * pow(p, (SELECT a FROM exponent)))::BIGINT) AS budget FROM sources
), blocks AS (
  SELECT greatest(1, (sum(budget) + 99999) // 100000)::BIGINT AS n FROM weights
), readings AS (
  SELECT c.doc_id, c.source, c.text_md5, c.n_tokens, w.all_tokens, w.budget, unnest(range(1, ceil(w.budget / w.all_tokens::DOUBLE)::INT + 1))::INT AS copy
  FROM counted c JOIN weights w ON c.source IS NOT DISTINCT FROM w.source
), hashed AS (
  SELECT *, md5(concat('mix:', coalesce(doc_id::VARCHAR, '-' || text_md5), ':', copy)) AS h FROM readings
), placed AS (
  SELECT *, (copy - 1) * all_tokens + coalesce(sum(n_tokens) OVER (PARTITION BY source, copy ORDER BY h, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM hashed
), kept AS (
  SELECT *, ((start * (SELECT n FROM blocks)) // budget)::BIGINT AS block FROM placed WHERE start < budget
)
SELECT doc_id, source, copy, n_tokens, block, (row_number() OVER (PARTITION BY block ORDER BY h, source, doc_id, n_tokens) - 1)::BIGINT AS slot FROM kept
"""

ORACLE_SQL["op8_warc"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), s AS (
  SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS best FROM s
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND best IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND best IS DISTINCT FROM page_id THEN best END AS refers_to
FROM r
"""

_WORDS9 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL["op9_decontamination"] = rf"""
WITH items AS (
  SELECT item_id, {_WORDS9} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT coalesce(item_id::VARCHAR, 'null') AS item, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM items WHERE len(w) > 0)
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS9} AS w FROM documents
), starts AS (
  SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs
), hits AS (
  SELECT s.r, s.i, x.size, x.item FROM (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM starts, (SELECT DISTINCT size FROM windows) WHERE i + size - 1 <= len(w)) s
  JOIN windows x ON s.size = x.size AND s.phrase = x.phrase
), words AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS k FROM hits) GROUP BY r
), found AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""

ORACLE_SQL["op10_quality_rules"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, phrase) AS n FROM (
    SELECT r, i, array_to_string(w[i:i + 4], ' ') AS phrase FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) >= 5))
), repeated AS (
  SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS k FROM windows WHERE n > 1) GROUP BY r
), lines AS (
  SELECT r, count(*) AS n, count(DISTINCT line) AS d FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (coalesce(l.n, 0) - coalesce(l.d, 0))::BIGINT AS n_dup_lines, coalesce(x.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0)::BIGINT AS n_lines,
    (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper, (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclamations
  FROM docs LEFT JOIN repeated x USING (r) LEFT JOIN lines l USING (r)
), marked AS (
  SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (10 * n_dup_lines > 3 * n_lines)::INT
    + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT + 32 * (10 * n_upper > 3 * word_chars)::INT + 64 * (2 * n_exclamations > n_words)::INT)::BIGINT AS failed
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) > 0 AS base_failed, failed = 0 AS kept, failed, n_lines, n_upper, n_exclamations FROM marked
"""


def _clusters_sql() -> str:
    """Every round by all distances."""
    parts = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}
)""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, x) - 1)::INT AS j, x AS c FROM (SELECT x, sha256('2:' || vec_id) AS h FROM v ORDER BY h NULLS LAST, x LIMIT {CENTROIDS}))",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min(d * 100000 + j) % 100000 AS j, min(d * 100000 + j) // 100000 AS d
  FROM (SELECT r, j, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i}) GROUP BY r
)""")
        if i < ROUNDS:
            parts.append(f"""m{i} AS (
  SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS c
  FROM (SELECT j, p, sum(x[p]) AS s, count(*)::HUGEINT AS n FROM (SELECT a.j, v.x, unnest(range(1, {DIM + 1})) AS p FROM v JOIN a{i} a USING (r)) GROUP BY j, p) GROUP BY j
), c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN m{i} m ON c.j = m.j)""")
    return "WITH " + ", ".join(parts) + f"""
SELECT v.vec_id, a.j::INT AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM v JOIN a{ROUNDS} a USING (r) JOIN c{ROUNDS} c ON a.j = c.j
"""


ORACLE_SQL["op12_centroid_clusters"] = _clusters_sql()

ORACLE_SQL["op13_conversation_trie"] = f"""
WITH t AS (
  SELECT conv_id, {{'r': coalesce(role, ''), 'x': coalesce(text, '')}} AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list(turn ORDER BY p) AS own, conv_id - conv_id % 5 AS base, {_crc32_sql("list_transform(regexp_extract_all(conv_id::VARCHAR, '.'), lambda d: ascii(d)::UBIGINT)")} % 9 AS h FROM t GROUP BY conv_id
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:len(c.own)]) AS s FROM c LEFT JOIN c b ON b.conv_id = c.base
), prefixes AS (
  SELECT conv_id, len(s) AS n, d, s[1:d] AS prefix FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT d, prefix, min(conv_id) AS id, count(*) AS n_convs, max(n) = d AS leaf, coalesce(strlen(any_value(prefix[d].x)), 0) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends
  FROM prefixes GROUP BY d, prefix
), named AS (
  SELECT p.conv_id, p.d, n.id FROM prefixes p JOIN nodes n ON p.d = n.d AND p.prefix = n.prefix
), up AS (
  SELECT n.id, n.d, a.d AS top_d, a.id AS top, n.leaf, (n.n_convs - 1) * n.bytes AS saved FROM nodes n JOIN named a ON a.conv_id = n.id AND a.d <= n.d
), rolled AS (
  SELECT top, top_d, count(*) FILTER (WHERE d = top_d + 1) AS n_children, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY top, top_d
)
SELECT n.id AS conv_id, n.d AS depth, a.id AS parent_conv_id, n.n_convs, r.n_children, r.n_leaves, r.saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN rolled r ON r.top = n.id AND r.top_d = n.d LEFT JOIN named a ON a.conv_id = n.id AND a.d = n.d - 1
"""
