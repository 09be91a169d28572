"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trovex.llm.common import scratch, table
from trovex.llm.divergence import SQL as DIVERGENCE_SQL
from trovex.llm.manifest import SQL as MANIFEST_SQL
from trovex.llm.repeats import SQL as REPEATS_SQL
from trovex.llm.revisits import SQL as REVISITS_SQL


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trovex.llm.records import read_digests, write_records

    path = scratch(spark, "records")
    write_records(table(spark, sf_dir, "documents"), path, "word_bpe_49k.json", end_id=1)
    return read_digests(spark, path)


def op2_forest_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trovex.llm.quality import judged

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trovex.llm.hmm import scored

    return scored(table(spark, sf_dir, "documents"))


def op4_pq_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trovex.llm.vector_dedup import linked

    return linked(table(spark, sf_dir, "embeddings"))


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trovex.llm.revisits import captures, digests, resolved

    return digests(resolved(captures(table(spark, sf_dir, "pages"))))


def op6_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trovex.llm.sharding import even_tree, sharded

    return sharded(table(spark, sf_dir, "documents"), even_tree(24), even_tree(25))


def op7_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trovex.llm.mixing import mixed

    return mixed(table(spark, sf_dir, "documents"))


def op8_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trovex.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=2, capacity=1024)


def op9_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trovex.llm.jaccard_join import Rule, joined

    return joined(table(spark, sf_dir, "documents"), Rule(3, 90))


def op10_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trovex.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")


def op11_fm_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trovex.llm.repeats import removed

    return removed(table(spark, sf_dir, "documents"))


def op12_systolic_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trovex.llm.divergence import divergences

    return divergences(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trovex.llm.manifest import verified

    return verified(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_records": op1_token_records,
    "op2_forest_quality": op2_forest_quality,
    "op3_hidden_markov": op3_hidden_markov,
    "op4_pq_vector_dedup": op4_pq_vector_dedup,
    "op5_revisits": op5_revisits,
    "op6_weighted_hash_tree": op6_weighted_hash_tree,
    "op7_sainte_lague_mix": op7_sainte_lague_mix,
    "op8_swap_packing": op8_swap_packing,
    "op9_parity_sketch_join": op9_parity_sketch_join,
    "op10_trie_token_counts": op10_trie_token_counts,
    "op11_fm_substring_dedup": op11_fm_substring_dedup,
    "op12_systolic_divergence": op12_systolic_divergence,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: DuckDB SQL for the queries that SQL can express.
SQL: dict[str, str] = {"op5_revisits": REVISITS_SQL, "op11_fm_substring_dedup": REPEATS_SQL, "op12_systolic_divergence": DIVERGENCE_SQL, "op13_merkle_manifest": MANIFEST_SQL}
