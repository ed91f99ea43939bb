"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightfield.llm import bpe, debruijn, decontaminate, licenses, nearcopies, neighbours, quality, secrets, suffixes, tokenfile, variants, vectorcodes, warc


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return made.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.bpe_encode(table(spark, sf_dir, "documents"), vocabulary(), keep=["doc_id"])
    return made.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfile.token_files(table(spark, sf_dir, "documents"), vocabulary())
    return tokenfile.crc32(tokenfile.read_token_files(spark, files))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents")).drop("n_lines")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.read_warc(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copies(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = debruijn.remove_earlier(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return made.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = secrets.scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    return made.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_neighbours(table(spark, sf_dir, "embeddings"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.coded_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_bpe, op3_token_files, op4_quality, op5_warc, op6_near_copies, op7_substring_dedup, op8_licenses, op9_decontaminate, op10_secrets, op11_neighbours, op12_variants, op13_vector_codes)}

_QUALITY_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda e: e <> '') AS ws,
             list_filter(string_split(x, chr(10)), lambda e: regexp_matches(e, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i+1] || chr(10) || ws[i+2] AS tri
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
s AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
      FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR (10 * n_dup_lines > 3 * n_lines AND n_lines >= 10)) AS kept FROM b
"""

_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND top > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND top > page_id THEN top END AS refers_to FROM q
"""

_WORDS_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda e: e <> '') AS ws FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
f AS (SELECT k, min(doc_id) AS first FROM v GROUP BY k HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM v JOIN f USING (k) WHERE first < doc_id),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
r AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM e ANTI JOIN g USING (doc_id, j) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id)
"""

#: All pairs: with up to 500 rows the operator's least budget of candidates covers the whole forest.
_NEIGHBOURS_SQL = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), lambda a, b: a + b) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def _codes_sql() -> str:
    """Four rounds and a last assignment, each with its own tables; floors of negative quotients go down."""
    parts = [
        "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "x AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM e, (SELECT unnest(range(4)) AS p))",
        "b0 AS MATERIALIZED (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1)::BIGINT AS k, x AS c FROM x WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT 256))",
    ]
    for i in range(5):
        parts.append(f"d{i} AS (SELECT vec_id, label, p, k, x, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far FROM x JOIN b{i} USING (p))")
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, label, p, any_value(x) AS x, min({{'far': far, 'k': k}}) AS best FROM d{i} GROUP BY vec_id, label, p)")
        if i < 4:
            parts.append(f"s{i} AS (SELECT p, k, j, sum(t) AS t, count(*) AS n FROM (SELECT p, best.k AS k, unnest(x) AS t, unnest(range(len(x))) AS j FROM a{i}) GROUP BY ALL)")
            parts.append(f"m{i} AS (SELECT p, k, list(((t - ((t % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM s{i} GROUP BY p, k)")
            parts.append(f"b{i + 1} AS MATERIALIZED (SELECT p, k, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m USING (p, k))")
    parts.append("h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b4)")
    parts.append("r AS (SELECT vec_id, label, string_agg(lpad(lower(to_hex(best.k)), 2, '0'), '' ORDER BY p) AS code, sum(best.far)::BIGINT AS error FROM a4 GROUP BY vec_id, label)")
    return "WITH " + ", ".join(parts) + " SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r, h"


SQL = {"op4_quality": _QUALITY_SQL, "op5_warc": _WARC_SQL, "op7_substring_dedup": _WORDS_SQL, "op11_neighbours": _NEIGHBOURS_SQL, "op13_vector_codes": _codes_sql()}
