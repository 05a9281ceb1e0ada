"""Sources that several queries share, in both languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import table

#: Tokens of documents with their places, and words between white space.
TOKENS_SQL = r"""
t AS (SELECT doc_id, lang, regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+') AS ws FROM documents),
tok AS (SELECT doc_id, lang, i, ws[i] AS word FROM (SELECT doc_id, lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM t))"""
CHUNKS_SQL = r"""
chunk AS (SELECT doc_id, lang, word FROM (SELECT doc_id, lang, unnest(regexp_split_to_array(text, '[ \t\n\r\f\v]+')) AS word FROM documents) WHERE word <> '')"""
#: Words made to look like phonemes, with a mark in some: enough to drive the phoneme functions over all documents.
PHONEMES_SQL = (
    TOKENS_SQL
    + r""",
ph AS (SELECT word, ps, (length(word) % 7) - 2.5 + (length(word) % 2) * 0.5 AS raw_stress FROM (
  SELECT word, CASE length(word) % 3 WHEN 0 THEN 'ˈ' || p WHEN 1 THEN 'ˌ' || p ELSE p END AS ps
  FROM (SELECT DISTINCT word, translate(word, 'aeiouc', 'æɛɪɒʌʧ') AS p FROM tok)))"""
)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, i, word). Outer generators: else the planner makes each array twice, first to test that it has rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", T.word_tokens(F.col("text")).alias("ws"))
    return docs.select("doc_id", "lang", F.posexplode_outer("ws").alias("p", "word")).filter("p IS NOT NULL").select("doc_id", "lang", (F.col("p") + 1).cast("long").alias("i"), "word")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode_outer(F.split("text", r"[ \t\n\r\f\x0B]+")).alias("word"))
    return docs.filter("word <> ''")


def phonemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, ps, raw_stress)"""
    words = tokens(spark, sf_dir).select("word").distinct()
    p = F.translate("word", "aeiouc", "æɛɪɒʌʧ")
    n = F.length("word")
    ps = F.when(n % 3 == 0, F.concat(F.lit("ˈ"), p)).when(n % 3 == 1, F.concat(F.lit("ˌ"), p)).otherwise(p)
    return words.select("word", ps.alias("ps"), ((n % 7) - 2.5 + (n % 2) * 0.5).alias("raw_stress"))


def spread(df: DataFrame) -> DataFrame:
    """df in two partitions a core at least, for kernels: tables of a few row groups else leave most cores idle. Larger ones
    stay as they are."""
    wanted = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def stress(raw: Column) -> Column:
    """-2, -1, -0.5, 0, 0.5, 1 or 2."""
    return F.when(raw < -1.5, -2.0).when(raw < -0.5, -1.0).when(raw < 0, -0.5).when(raw < 0.5, 0.0).when(raw < 1.5, 0.5).when(raw < 2.5, 1.0).otherwise(2.0)


STRESS_SQL = "CASE WHEN raw_stress < -1.5 THEN -2.0 WHEN raw_stress < -0.5 THEN -1.0 WHEN raw_stress < 0 THEN -0.5 WHEN raw_stress < 0.5 THEN 0.0 WHEN raw_stress < 1.5 THEN 0.5 WHEN raw_stress < 2.5 THEN 1.0 ELSE 2.0 END"


def replaced_sql(column: str, pairs) -> str:
    """Nested replaces, as the Column form has them."""
    for old, new in pairs:
        column = f"replace({column}, '{old.replace(chr(39), chr(39) * 2)}', '{new.replace(chr(39), chr(39) * 2)}')"
    return column
