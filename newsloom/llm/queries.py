"""Named queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import (
    code_compression,
    embedding_dedup,
    kmeans_tree,
    license_scan,
    mixing,
    order_minhash,
    packing,
    quality,
    secret_scan,
    simhash_dedup,
    spelling_variants,
    token_files,
    toxicity,
)
from newsloom.llm.common import table
from newsloom.sources.scratch import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file; the package must be on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op5_simhash_byte_index(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, folder, "documents"))


@query
def op1_rff_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op4_noisy_channel_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op6_hypergeometric_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(table(spark, folder, "documents"))


@query
def op10_secret_lexing(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secrets(table(spark, folder, "documents"))


@query
def op2_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, folder, "documents"))


@query
def op7_residual_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))


@query
def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    place = scratch_folder(spark, "token-files")
    token_files.write(table(spark, folder, "documents"), place, tokenizer_file("byte_bpe_50k.json"))
    return token_files.read(spark, place)


# every pair, and whatever is reachable through links
ORACLES["op3_subspace_pigeonhole"] = """WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS e FROM embeddings),
 ok AS (SELECT vec_id, e, CASE WHEN e IS NOT NULL THEN sqrt(list_dot_product(e, e)) END AS n FROM v WHERE e IS NOT NULL),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
 r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
 c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
 SELECT v.vec_id, coalesce(k.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
 FROM v JOIN c ON c.node = v.vec_id LEFT JOIN k ON k.a = v.vec_id"""


@query
def op3_subspace_pigeonhole(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


@query
def op9_license_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.licenses(table(spark, folder, "documents"))


@query
def op13_trie_frontier(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants.variants(table(spark, folder, "documents"))


def _code_rounds() -> str:
    """Six rounds in SQL: whole parts ``p`` (vec_id, label, part, v); codebooks ``b0`` to ``b6``."""
    far = "list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for k in range(7):
        # distance and entry in one number: the nearest, of equals the first
        steps.append(f"""a{k} AS (SELECT p.vec_id, p.label, p.part, any_value(p.v) AS v, CAST(min({far} * 16 + b.entry) AS HUGEINT) AS best
 FROM p JOIN b{k} b USING (part) GROUP BY ALL)""")
        if k < 6:
            steps.append(f"""m{k} AS (SELECT part, CAST(best % 16 AS INT) AS entry, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x
 FROM (SELECT part, best, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM a{k}) GROUP BY ALL)""")
            steps.append(f"""b{k + 1} AS (SELECT b.part, b.entry, coalesce(n.v, b.v) AS v FROM b{k} b
 LEFT JOIN (SELECT part, entry, list(x ORDER BY i) AS v FROM m{k} GROUP BY ALL) n USING (part, entry))""")
    return ",\n ".join(steps)


ORACLES["op12_dual_tree_codes"] = f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS MATERIALIZED (SELECT vec_id, label, CAST(unnest(range(0, 8)) AS INT) AS part, unnest(list_transform(range(0, 8), lambda j: w[j * (len(w) // 8) + 1:(j + 1) * (len(w) // 8)])) AS v FROM k),
 b0 AS (SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS INT) AS entry, v FROM p
  WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 16)),
 {_code_rounds()},
 c AS (SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', CAST(best % 16 AS INT)), '' ORDER BY part) AS code,
  CAST(sum(best // 16) AS BIGINT) AS error FROM a6 GROUP BY vec_id),
 d AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b6)
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, d"""


@query
def op12_dual_tree_codes(spark: SparkSession, folder: str) -> DataFrame:
    return code_compression.compress(table(spark, folder, "embeddings"))


@query
def op11_kmeans_tree(spark: SparkSession, folder: str) -> DataFrame:
    return kmeans_tree.nearest(table(spark, folder, "embeddings"))
