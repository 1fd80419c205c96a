"""The registered queries: each operator over its whole table, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkwright.llm import (
    alignment,
    ann,
    centroids,
    decontaminate,
    fuzzy_lines,
    language,
    licenses,
    neardup,
    packing,
    pii,
    quality,
    substrings,
    suffix_lm,
)
from linkwright.llm.common import table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op8_suffix_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.report(table(spark, sf_dir, "documents"))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.report(table(spark, sf_dir, "documents"))


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.report(table(spark, sf_dir, "embeddings"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_licenses, op2_packing, op3_decontamination, op4_personal_data, op5_language, op6_near_duplicates,
        op7_substring_dedup, op8_suffix_model, op9_fuzzy_lines, op10_nearest_vectors,
        op11_centroids, op12_alignment, op13_quality,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _centroids_sql(clusters: int = 40, rounds: int = 5) -> str:
    """Rounds of assignment and means one after the other, a row per vector and component."""
    steps, near = [], "SELECT r, c, d FROM ({}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1"
    for i in range(rounds + 1):
        pairs = f"SELECT r, c, sum((p.x - m.x) * (p.x - m.x)) AS d FROM point p JOIN middle{i} m USING (j) GROUP BY r, c"
        steps.append(f"near{i} AS MATERIALIZED ({near.format(pairs)})")
        if i < rounds:
            mean = f"SELECT c, j, floor(sum(x) / count(*)) AS x FROM near{i} JOIN point USING (r) GROUP BY c, j"
            steps.append(f"middle{i + 1} AS MATERIALIZED (SELECT c, j, coalesce(n.x, o.x) AS x FROM middle{i} o LEFT JOIN ({mean}) n USING (c, j))")
    return f"""
    WITH given AS (SELECT row_number() OVER () AS r, vec_id, embedding AS v FROM embeddings WHERE len(embedding) = 64),
    spot AS (SELECT r, vec_id, unnest(v) AS e, unnest(range(64)) AS j FROM given),
    fine AS (SELECT r FROM spot GROUP BY r HAVING count(*) FILTER (WHERE e IS NULL OR NOT isfinite(e)) = 0),
    point AS MATERIALIZED (SELECT r, vec_id, j, floor(256 * CAST(e AS DOUBLE)) AS x FROM spot JOIN fine USING (r)),
    first AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS c FROM given JOIN fine USING (r)),
    middle0 AS MATERIALIZED (SELECT c, j, x FROM first JOIN point USING (r) WHERE c < {clusters}),
    {", ".join(steps)},
    sha AS (SELECT c, sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY j)) AS s FROM middle{rounds} GROUP BY c)
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
           CAST(sum(d) OVER () AS BIGINT) AS inertia, s AS centroid_sha256
    FROM near{rounds} JOIN given USING (r) JOIN sha USING (c)"""


ORACLES: dict[str, str] = {
    "op3_decontamination": f"""
    WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS words FROM documents),
    item AS (SELECT CAST(item_id AS VARCHAR) AS item, words, least(13, len(words)) AS k
             FROM (SELECT item_id, {_ALNUM} AS words FROM benchmark) WHERE len(words) > 0 AND item_id IS NOT NULL),
    spot AS (SELECT item, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM item),
    win AS (SELECT DISTINCT item, k, array_to_string(words[i:i + k - 1], ' ') AS t FROM spot),
    place AS (SELECT r, words, k, unnest(range(1, len(words) - k + 2)) AS i
              FROM doc, (SELECT DISTINCT k FROM win) WHERE len(words) >= k),
    dwin AS (SELECT r, k, i, array_to_string(words[i:i + k - 1], ' ') AS t FROM place),
    hits AS (SELECT DISTINCT r, i, dwin.k AS k, item FROM dwin JOIN win ON dwin.t = win.t AND dwin.k = win.k),
    covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
    named AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
           coalesce(covered.n, 0) > 0 AND 20 * coalesce(covered.n, 0) >= len(words) AS contaminated
    FROM doc LEFT JOIN covered USING (r) LEFT JOIN named USING (r)""",
    "op6_near_duplicates": rf"""
    WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents),
    spot AS (SELECT doc_id, words, least(5, len(words)) AS k, unnest(range(1, len(words) - least(5, len(words)) + 2)) AS i
             FROM doc WHERE len(words) > 0),
    gram AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(words[i:i + k - 1], ' ') AS t FROM spot),
    size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
    met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM gram a JOIN gram b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
    link AS MATERIALIZED (SELECT a, b FROM met JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    reach AS (SELECT doc_id AS node, doc_id AS seen FROM doc UNION SELECT reach.node, link.b FROM reach JOIN link ON link.a = reach.seen)
    SELECT doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, low AS component_id, doc_id = low AS kept
    FROM doc LEFT JOIN size USING (doc_id) JOIN (SELECT node AS doc_id, min(seen) AS low FROM reach GROUP BY node) USING (doc_id)""",
    "op7_substring_dedup": r"""
    WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    spot AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM doc WHERE len(words) >= 50),
    win AS MATERIALIZED (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS t FROM spot),
    hit AS (SELECT doc_id, i FROM win JOIN (SELECT t, min(doc_id) AS low FROM win GROUP BY t) USING (t) WHERE low < doc_id),
    gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM hit) GROUP BY doc_id),
    word AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS p FROM doc JOIN gone USING (doc_id)),
    flat AS (SELECT doc_id, unnest(ps) AS p FROM gone),
    kept AS (SELECT word.doc_id, string_agg(w, ' ' ORDER BY word.p) AS s
             FROM word LEFT JOIN flat ON flat.doc_id = word.doc_id AND flat.p = word.p WHERE flat.p IS NULL GROUP BY word.doc_id)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
           sha256(CASE WHEN ps IS NULL THEN array_to_string(words, ' ') ELSE coalesce(s, '') END) AS kept_sha256
    FROM doc LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op11_centroids": _centroids_sql(),
}
