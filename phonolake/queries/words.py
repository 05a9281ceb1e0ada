"""Word predicates and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from . import query, table
from .common import CHUNKS_SQL, TOKENS_SQL, chunks, tokens

_SHAPE = r"""CASE WHEN s = '' THEN '-' ELSE s END"""
_SHAPE_PARTS = r"""concat(CASE WHEN regexp_matches(word, '[\p{Lu}\p{Ll}]') AND NOT regexp_matches(word, '\p{Ll}') THEN 'U' ELSE '' END,
  CASE WHEN regexp_matches(word, '^\p{Lu}') THEN 'F' ELSE '' END, CASE WHEN regexp_matches(word, '[0-9]') THEN 'D' ELSE '' END, CASE WHEN contains(word, '-') THEN 'H' ELSE '' END)"""


@query(rf"WITH {CHUNKS_SQL}, s AS (SELECT {_SHAPE_PARTS} AS s, regexp_replace(lower(word), '[0-9]', '0', 'g') AS norm FROM chunk WHERE NOT regexp_matches(word, '[İẞ]')) SELECT {_SHAPE} AS shape, norm, count(*) AS n FROM s GROUP BY ALL")
def token_shape_counts(spark, sf_dir):
    words = chunks(spark, sf_dir).filter(~F.col("word").rlike("[İẞ]"))
    return words.groupBy(T.shape(F.col("word")).alias("shape"), T.normalized(F.col("word")).alias("norm")).agg(F.count("*").alias("n"))


@query(rf"WITH {TOKENS_SQL} SELECT right(word, 1) AS s1, right(word, 2) AS s2, right(word, 3) AS s3, left(word, 1) AS p1, count(*) AS n FROM tok GROUP BY ALL")
def suffix_feature_counts(spark, sf_dir):
    w = F.col("word")
    return tokens(spark, sf_dir).groupBy(T.suffix(w, 1).alias("s1"), T.suffix(w, 2).alias("s2"), T.suffix(w, 3).alias("s3"), F.left(w, F.lit(1)).alias("p1")).agg(F.count("*").alias("n"))


@query(
    rf"""WITH {CHUNKS_SQL}, d AS (SELECT DISTINCT word, regexp_replace(word, '(?:ing|''d|ed|''s|st|nd|rd|th|s)$', '') AS rest, string_split(word, '.') AS parts FROM chunk)
SELECT word, regexp_matches(word, '^[0-9]+$') AS digits, regexp_matches(word, '^\p{{L}}+$') AS alpha, regexp_matches(word, '[0-9]') AND regexp_matches(rest, '^-?[0-9,.]+$') AS number_head,
  regexp_matches(word, '[0-9]') AND regexp_matches(rest, '^[0-9,.]+$') AS number_inner, len(parts) = 1 OR (len(parts) = 2 AND length(parts[2]) < 3) AS currency,
  regexp_matches(word, '\p{{Lu}}') AND NOT regexp_matches(word, '\p{{Ll}}') AS all_caps, regexp_matches(word, '(?s)^.+[''’]s$') AS possessive FROM d"""
)
def word_predicates(spark, sf_dir):
    w = F.col("word")
    return chunks(spark, sf_dir).select("word").distinct().select(
        "word", T.is_digits(w).alias("digits"), T.is_alpha(w).alias("alpha"), T.is_number(w).alias("number_head"), T.is_number(w, False).alias("number_inner"), T.is_currency(w).alias("currency"), T.is_all_caps(w).alias("all_caps"), T.is_possessive(w).alias("possessive"),
    )


@query(
    rf"""WITH {TOKENS_SQL}, d AS (SELECT DISTINCT word, lower(word) AS lo, upper(left(word, 1)) || lower(substr(word, 2)) AS cap FROM tok WHERE NOT regexp_matches(word, '[ßİıŉǅ]'))
SELECT word, CASE WHEN length(word) < 2 THEN NULL WHEN word = lo AND word <> cap THEN cap WHEN word <> lo AND word = cap THEN lo END AS variant FROM d"""
)
def grown_variants(spark, sf_dir):
    return tokens(spark, sf_dir).select("word").filter(~F.col("word").rlike("[ßİıŉǅ]")).distinct().select("word", T.grow_variant(F.col("word")).alias("variant"))


@query(
    """SELECT tag, CASE WHEN tag LIKE 'VB%' THEN 'VERB' WHEN tag LIKE 'NN%' THEN 'NOUN' WHEN tag LIKE 'ADV%' OR tag LIKE 'RB%' THEN 'ADV' WHEN tag LIKE 'ADJ%' OR tag LIKE 'JJ%' THEN 'ADJ' ELSE tag END AS parent, count(*) AS n
FROM (SELECT (['VBD', 'NNP', 'NN', 'RBR', 'JJ', 'ADV', 'ADJ', 'IN', NULL])[1 + o_orderkey % 9] AS tag FROM orders) GROUP BY ALL"""
)
def parent_tags(spark, sf_dir):
    tags = F.array(*map(F.lit, ["VBD", "NNP", "NN", "RBR", "JJ", "ADV", "ADJ", "IN", None]))
    rows = table(spark, sf_dir, "orders").select(F.get(tags, (F.col("o_orderkey") % 9).cast("int")).alias("tag"))
    return rows.groupBy("tag", T.parent_tag(F.col("tag")).alias("parent")).agg(F.count("*").alias("n"))


@query(
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{M}]+|\p{Nd}+|[^\s\x0B\p{L}\p{M}\p{Nd}]')) AS BIGINT) AS n_runs,
  CAST(len(list_filter(regexp_extract_all(text, '[\p{L}\p{M}]+|\p{Nd}+|[^\s\x0B\p{L}\p{M}\p{Nd}]'), lambda x: regexp_matches(x, '^\p{Nd}'))) AS BIGINT) AS n_digit_runs FROM documents"""
)
def script_runs(spark, sf_dir):
    from ..operators.sequence import class_runs

    runs = table(spark, sf_dir, "documents").select("doc_id", class_runs(F.col("text")).alias("r"))
    return runs.select("doc_id", F.size("r").cast("long").alias("n_runs"), F.size(F.filter("r", lambda x: x.rlike(r"^\p{Nd}"))).cast("long").alias("n_digit_runs"))


@query(
    r"""SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '([.!?…।])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(s) BETWEEN 20 AND 180)) AS BIGINT) AS n_sentences,
  CAST(len(list_filter(string_split(regexp_replace(text, '([.!?…।])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)), lambda s: len(string_split(s, ' ')) BETWEEN 2 AND 60)) AS BIGINT) AS n_by_words FROM documents"""
)
def sentence_split_filter(spark, sf_dir):
    s = T.sentences(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    by_words = F.filter("s", lambda x: F.size(F.split(x, " ")).between(2, 60))
    return docs.select("doc_id", F.size(F.filter("s", lambda x: F.length(x).between(20, 180))).cast("long").alias("n_sentences"), F.size(by_words).cast("long").alias("n_by_words"))


@query()
def prose_sentence_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.prose_sentences(F.col("text")).alias("s"))
    return docs.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.size(F.filter("s", lambda x: F.size(F.split(x, " ")).between(2, 60))).cast("long").alias("n_by_words"))


@query(r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(html, '<[^>]*>|&[a-zA-Z]+;', ' ', 'g'), '[\p{L}\p{M}\p{N}_]+')) AS word FROM pages) GROUP BY word")
def page_word_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.explode_outer(T.word_tokens(T.strip_markup(F.col("html")))).alias("word")).filter("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n"))


@query(
    """WITH d AS (SELECT doc_id, md5(text) AS h FROM documents)
SELECT doc_id, CAST((16 * list_sum(list_transform(range(1, 32), lambda i: instr('0123456789abcdef', substr(h, i, 1)) - 1)) + instr('0123456789abcdef', substr(h, 32, 1)) - 1) % 20 AS INTEGER) AS bucket FROM d"""
)
def holdout_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.md5_mod20(F.col("text")).cast("int").alias("bucket"))


@query(r"SELECT doc_id, replace(replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r') AS escaped, text AS back FROM documents")
def field_escape(spark, sf_dir):
    escaped = T.escape_field(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", escaped.alias("escaped"), T.unescape_field(escaped).alias("back"))


@query(rf"WITH {TOKENS_SQL} SELECT doc_id, CAST(len(ws) AS BIGINT) AS n, array_to_string(ws, ' ') AS words FROM t")
def json_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.to_json(T.word_tokens(F.col("text"))).alias("j"))
    back = F.from_json("j", "array<string>")
    return docs.select("doc_id", F.size(back).cast("long").alias("n"), F.array_join(back, " ").alias("words"))
