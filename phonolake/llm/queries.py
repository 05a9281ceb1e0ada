"""The queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, linededup
from .common import table

#: Where the vocabulary files are: a parameter, by default the installed public files.
VOCABULARY = os.environ.get("PHONOLAKE_VOCABULARY", "byte_bpe_50k.json")


def vocabulary() -> str:
    if os.path.sep in VOCABULARY:
        return VOCABULARY
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .huffman import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hnsw import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import drop_boilerplate, host_of, visible_text

    pages = table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), visible_text(F.col("html")).alias("text"))
    return drop_boilerplate(pages, F.col("host"), F.col("text"), "kept", counts=("n_lines", "n_dropped")).select("page_id", "host", "n_lines", "n_dropped", "kept")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_lm_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lmscore import cross_entropy_difference, good_ids

    return cross_entropy_difference(table(spark, sf_dir, "documents"), good_ids(table(spark, sf_dir, "labels")))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, scored

    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op10_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests

    return digests(table(spark, sf_dir, "documents"), vocabulary())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_huffman_ids, op2_hnsw, op3_simhash, op4_site_lines, op5_decontaminate, op6_lm_difference, op7_licenses, op8_toxicity, op9_pii, op10_bpe_automaton)}
ORACLE_SQL: dict[str, str] = {"op4_site_lines": linededup.PAGES_SQL, "op5_decontaminate": decontam.REPORT_SQL}
