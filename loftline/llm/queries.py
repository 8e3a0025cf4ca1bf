"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loftline.llm import alignment, ann, centroids, decontam, langid, lm, neardup, packing, pii, secrets, suffixdedup, tokenbin, wordblocks


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns that an operator works on; others, whatever their names, stay out."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas in the order they are in."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id",
        *[_count("spans", k).alias(f"n_{k}") for k in ("assign", "access", "hex", "novel")],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select(
        "doc_id",
        *[_count("spans", k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        F.size(base).cast("long").alias("n_entities"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return langid.predict(docs, langid.fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_digests(tokenbin.token_files(_table(spark, sf_dir, "documents", "doc_id", "text")))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "item_id", "edits", "start", "end")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"), words=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordblocks.remove_repeated_words(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(_table(spark, sf_dir, "embeddings", "vec_id", "embedding")).drop("recomputed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_pii": op2_pii,
    "op3_language_id": op3_language_id,
    "op4_packing": op4_packing,
    "op5_token_ids": op5_token_ids,
    "op6_lm_score": op6_lm_score,
    "op7_decontamination": op7_decontamination,
    "op8_nearest": op8_nearest,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_word_repeats": op11_word_repeats,
    "op12_alignment": op12_alignment,
    "op13_centroids": op13_centroids,
}

_WORD_REPEATS = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
places AS (SELECT doc_id, words, unnest(generate_series(1, len(words))) AS p FROM docs),
windows AS (SELECT doc_id, p, words[p] AS word, CASE WHEN p <= len(words) - 19 THEN array_to_string(words[p:p + 19], ' ') END AS w FROM places),
later AS (SELECT doc_id, p, word, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, p) > 1 AS again FROM windows),
covered AS (SELECT doc_id, p, word, coalesce(p - max(CASE WHEN again THEN p END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) < 20, false) AS gone FROM later),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS text FROM covered GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)
"""


def _centroids_sql(k: int = centroids.CENTROIDS, rounds: int = centroids.ROUNDS) -> str:
    """The same clustering with a pair of tables a round."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY mark) - 1 AS k, c AS m FROM (SELECT c, sha256('3:' || vec_id) AS mark FROM v ORDER BY mark LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        near = f"SELECT r, k, list_sum(list_transform(list_zip(c, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v CROSS JOIN c{n}"
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, k, d FROM ({near}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)")
        if n < rounds:
            cells = f"SELECT k, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM a{n} JOIN v USING (r)"
            means = f"SELECT k, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM ({cells}) GROUP BY k, i"
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT k, CAST(coalesce(l, m) AS BIGINT[]) AS m FROM c{n} LEFT JOIN (SELECT k, list(x ORDER BY i) AS l FROM ({means}) GROUP BY k) USING (k))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (k)"""


#: DuckDB SQL of the queries that SQL can express; the others are tested against brute force.
ORACLE: dict[str, str] = {"op11_word_repeats": _WORD_REPEATS, "op13_centroids": _centroids_sql()}
