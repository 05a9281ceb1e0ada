"""A corpus through five of the operators: what one stage leaves is written and becomes the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.llm import bpe, decontam, linededup, simhash, toxicity
from phonolake.llm.common import materialize, table
from phonolake.llm.queries import vocabulary

#: Lines of a source on more than this share of its documents go. Sources here are mixed sites, so it is far below what
#: marks a single site's boilerplate; a document that would lose over half of its text stays whole only if its whole text
#: is as frequent as such a line. Lines of fewer characters than LINE_CHARS repeat by chance and stay.
LINE_RATIO, LINE_HOLDERS, LINE_CHARS, LINE_MOST = 0.003, 5, 8, 0.5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores below one half."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are frequent in their source; n_chars follows the text."""
    names = docs.columns
    out = linededup.drop_boilerplate(docs, F.col("source"), F.col("text"), "_phonolake_kept_text", LINE_RATIO, least_holders=LINE_HOLDERS, least_chars=LINE_CHARS, most=LINE_MOST)
    changed = {"text": F.col("_phonolake_kept_text")}
    if "n_chars" in names:
        same = F.col("_phonolake_kept_text").eqNullSafe(F.col("text"))
        changed["n_chars"] = F.when(same, F.col("n_chars")).otherwise(F.length("_phonolake_kept_text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in names))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of their five-word shingles."""
    return simhash.one_of_similar(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them."""
    return bpe.encode_decode(docs, vocabulary())


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("bpe", encode),
]

#: No SQL: folding, fingerprints and merges are beyond it. The tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return materialize(STAGES[-1][1](spark, docs, sf_dir))
