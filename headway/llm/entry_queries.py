"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import decontaminate, jaccard_join, language_id, licenses, line_runs, mixing, prefix_trie, repeats, secret_scan, sharding, token_counts, vector_search, whitening

def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.scan(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), 10))


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return vector_search.top_k(spark, vectors, vectors.where("vec_id % 100 = 0"), 10, 1024)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(spark, _read(spark, sf_dir, "documents"), 400)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(spark, _read(spark, sf_dir, "documents"), 3, 90, 100).drop("row_key", "group_key")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(mixing.plan(spark, _read(spark, sf_dir, "documents"), (5, 2, 1), 3, shards=64))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language_id.fit(spark, docs)
    return language_id.predict(spark, docs.withColumn("held_out", language_id.held_out(F.col("doc_id"))), model, keep=("doc_id", "held_out"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # where the vocabularies are; they are no part of this repository

    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan(spark, _read(spark, sf_dir, "documents")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(_read(spark, sf_dir, "documents")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.report(spark, _read(spark, sf_dir, "documents"), 50)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark, _read(spark, sf_dir, "embeddings"), 32, 64, 1_000_000)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.regular(2, 2, 4)
    return sharding.report(spark, _read(spark, sf_dir, "documents"), tree, sharding.grown(tree, "r0", "r0k0"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(spark, _read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_vector_search, op3_repeats, op4_jaccard_join, op5_mixing, op6_language_id, op7_token_counts, op8_secret_scan, op9_license_scan, op10_line_dedup, op11_whitening, op12_sharding, op13_prefix_trie)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
       FROM b, unnest(generate_series(1, greatest(len(w) - least(10, len(w)) + 1, 0))) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM d, sizes, unnest(generate_series(1, len(w) - n + 1)) AS u(i) WHERE len(w) >= n),
hits AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(generate_series(i, i + n - 1)) AS u(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT vec_id, i, v[i] AS x FROM v, unnest(generate_series(1, len(v))) AS u(i)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM c q JOIN c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""

_OP4 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g
      FROM d, unnest(generate_series(1, len(w) - least(3, len(w)) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 90 * (a.n + b.n - shared)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reach = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""

_OP10 = r"""
WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents),
l AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS line, t[i] AS t, CAST(len(regexp_extract_all(t[i], '[^\x20\x09-\x0D]+')) AS BIGINT) AS w
      FROM raw, unnest(generate_series(1, len(t))) AS u(i)),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM l WHERE w > 0),
pairs AS (SELECT a.doc_id AS da, b.doc_id AS db, b.k - a.k AS diag, b.k AS k, b.line AS line, b.w AS w,
                 b.k - row_number() OVER (PARTITION BY a.doc_id, b.doc_id, b.k - a.k ORDER BY b.k) AS island
          FROM s a JOIN s b ON a.t = b.t AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.k < b.k))),
long AS (SELECT *, sum(w) OVER (PARTITION BY da, db, diag, island) AS words FROM pairs),
gone AS (SELECT DISTINCT db AS doc_id, line, k FROM long WHERE words >= 50),
runs AS (SELECT doc_id, line, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS g FROM gone),
cuts AS (SELECT doc_id, g, min(line) AS a, max(line) + 1 AS b, count(*) AS n FROM runs GROUP BY 1, 2),
-- runs that touch in line numbers are one
step AS (SELECT *, CASE WHEN a = lag(b) OVER (PARTITION BY doc_id ORDER BY a) THEN 0 ELSE 1 END AS head FROM cuts),
named AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY a) AS h FROM step),
whole AS (SELECT doc_id, h, min(a) AS a, max(b) AS b, sum(n) AS n FROM named GROUP BY 1, 2),
per AS (SELECT doc_id, sum(n) AS n, count(*) AS r, string_agg(a || '-' || b, ',' ORDER BY a) AS runs FROM whole GROUP BY 1),
c AS (SELECT raw.doc_id, count(s.k) AS n_lines FROM raw LEFT JOIN s USING (doc_id) GROUP BY 1)
SELECT c.doc_id, n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(r, 0) AS n_runs, coalesce(runs, '') AS runs
FROM c LEFT JOIN per USING (doc_id)
"""

_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: xor(r >> 1, 3988292384::BIGINT * (r & 1)))), 4294967295::BIGINT)"

_OP13 = rf"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS nth, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, nth, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND nth < h
      UNION ALL SELECT c.conv_id, 1, nth, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND nth >= h),
p AS (SELECT conv_id, count(*) OVER w AS depth, list(struct_pack(role := role, text := text)) OVER w AS path, text FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, nth)),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(len(regexp_extract_all(text, '[^ 	-
]+'))) AS words FROM p GROUP BY path, depth
      UNION ALL SELECT [], 0, min(conv_id), count(*), 0 FROM c HAVING count(*) > 0),
m AS (SELECT conv_id, coalesce(max(depth), 0) AS depth, coalesce(arg_max(path, depth), []) AS path FROM c LEFT JOIN p USING (conv_id) GROUP BY conv_id),
e AS (SELECT path, depth, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM m GROUP BY path, depth),
k AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
own AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * words AS saved FROM n LEFT JOIN k ON k.depth = n.depth AND k.path = n.path),
s AS (SELECT path[1:d] AS path, d AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM own, unnest(generate_series(0, depth)) AS u(d) GROUP BY 1, 2)
SELECT own.conv_id, own.depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM own JOIN s ON s.depth = own.depth AND s.path = own.path LEFT JOIN n up ON up.depth = own.depth - 1 AND up.path = own.path[1:own.depth - 1]
LEFT JOIN e ON e.depth = own.depth AND e.path = own.path
"""


def oracle_sql() -> dict[str, str]:
    """The others are tested against brute force, the library or held-out labels."""
    return {"op1_decontamination": _OP1, "op2_vector_search": _OP2, "op4_jaccard_join": _OP4, "op10_line_dedup": _OP10, "op13_prefix_trie": _OP13}
