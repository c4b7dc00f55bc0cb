"""One query for each operator of this subpackage, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, jaccard_join, mixing, quality, substring, suffix_dedup, token_count, topk, toxicity
from .common import table

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.whole_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, rows.where(F.col("vec_id") % 50 == 0), k=5, scale=256)


ORACLE_SQL["op5_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(table(spark, sf_dir, "documents"))


ORACLE_SQL["op8_suffix_array_dedup"] = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM b WHERE length(h) >= 400),
k AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM s),
d AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY k) > 1),
r AS (SELECT doc_id, i, i - max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM d),
n AS (SELECT doc_id, i, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS z FROM n GROUP BY ALL),
pieces AS (
  SELECT doc_id, z AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1000000000) AS z FROM spans
  UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS kept FROM pieces JOIN b USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM b LEFT JOIN kept USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digests(table(spark, sf_dir, "documents"))


ORACLE_SQL["op3_substring_dedup"] = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM s),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM k),
g AS (SELECT DISTINCT doc_id, i + j AS p FROM m, range(50) r(j) WHERE first < doc_id),
a AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM a ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


ORACLE_SQL["op2_jaccard_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
c AS (SELECT doc_id, g, count(*) OVER (PARTITION BY g) AS copies FROM g WHERE len(g) > 0),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM c),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o WHERE k >= 0.8::DOUBLE * (n + m - k) - 1e-9),
t AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a),
class AS (SELECT a AS doc_id, min(b) AS class_id FROM t GROUP BY a),
degree AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(copies, 1) AS n_copies
FROM class LEFT JOIN degree USING (doc_id) LEFT JOIN c USING (doc_id)
"""
