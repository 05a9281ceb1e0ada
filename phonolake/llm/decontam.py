"""Operator 5: benchmark decontamination by a prefix-filtered join, in DataFrame functions only.

An item's windows are its runs of WINDOW words (an item of fewer words is one window). A document holds a window only
if it holds all its words, so of the window's words, ordered by how rare they are in all documents, the first is a
sufficient prefix. Documents meet windows on that word alone; the word's place in the window gives the place where the
window would begin, and candidates that would begin before the document or end after it go at once. What remains is
verified word by word in the same step, where the document's words still are: what moves is one short row for each
document and one for each window that really occurs, never a text. Documents are read twice, once to count words and
once to probe.

Windows are sent to the documents. Their bytes are counted first: of more than MOST_BYTES, as many blocks are made as
it takes, and the documents are probed once for each block. Which items hold a window is joined afterwards.

Defined results: null and empty texts have no words, are never contaminated and, as items, have no windows. Items with
the same words count separately. Repeated document rows are judged each. An empty benchmark gives zeros; an empty
documents table no rows. Other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WINDOW = 10
#: Bytes of windows, or of words to be counted, or of keys of rows to drop, that are broadcast at once.
MOST_BYTES = 32 << 20

# The letters to fold, and the characters that words consist of: letters and digits one by one, which Java's
# matcher finds in a table (ranges it compares one after another, seven times slower).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[" + LOWER + UPPER + "0123456789" + r"\x{80}-\x{10FFFF}]+"

_K = ["_phonolake_k1", "_phonolake_k2"]


def folded(x: Column) -> Column:
    """A-Z lowered. Plain ASCII takes the faster of two equal ways."""
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


def raw_words(text: Column) -> Column:
    """The words of a text as they are written; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def row_keys() -> list[Column]:
    """Two hashes of doc_id and text, which tell rows apart; rows that are equal in both get equal results."""
    return [F.xxhash64("doc_id", "text").alias(_K[0]), F.xxhash64(F.lit(1), "doc_id", "text").alias(_K[1])]


def windows_of(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(w, words, len) of the distinct windows, w being their number, and (w, item_id) of the items that hold them."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), F.transform(raw_words(F.col("text")), folded).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1))
    each = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("words")).distinct()
    grouped = materialize(each.groupBy("words").agg(F.collect_set("item_id").alias("items")).withColumn("w", F.monotonically_increasing_id()))
    return grouped.select("w", "words", F.size("words").alias("len")), grouped.select("w", F.explode("items").alias("item_id"))


def anchored(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows with their rarest word among all words of the documents, as its hash, and its place; those with a word that
    no document has can't occur and go. Words that share a hash are counted together, which can only make the choice of
    the rarest a worse one, never the result."""
    places = windows.select("w", F.posexplode("words").alias("place", "word")).select("w", "place", F.xxhash64("word").alias("h"))
    vocabulary = materialize(places.select("h").distinct())
    each = docs.select(F.explode_outer(raw_words(F.col("text"))).alias("word"))  # outer: else the planner makes the words twice, first to test that there are any
    words = each.select(F.xxhash64(folded(F.col("word"))).alias("h"))
    if 16 * vocabulary.count() <= MOST_BYTES:
        counts = words.join(F.broadcast(vocabulary), "h", "left_semi").groupBy("h").agg(F.count("*").alias("n"))
    else:  # all words are counted before they meet the vocabulary
        counts = words.groupBy("h").agg(F.count("*").alias("n")).join(vocabulary, "h", "left_semi")
    rarest = places.join(counts, "h").groupBy("w").agg(F.count("*").alias("known"), F.min(F.struct("n", "h", "place")).alias("r"))
    return windows.join(rarest, "w").filter("known = len").select("w", "words", "len", "r.h", "r.place")


def blocks_of(anchors: DataFrame) -> list[DataFrame]:
    """The anchored windows in blocks of at most about MOST_BYTES."""
    made = materialize(anchors)
    size = made.agg(F.sum(F.lit(64) + F.aggregate("words", F.lit(0), lambda a, x: a + F.octet_length(x) + 16))).first()[0] or 0
    n = -(-size // MOST_BYTES)
    return [made] if n < 2 else [made.filter(F.pmod(F.xxhash64("w"), F.lit(n)) == i) for i in range(n)]


def occurrences(docs: DataFrame, block: DataFrame, every: bool) -> DataFrame:
    """(keys, doc_id, n, begin, len, w): a row for each window of the block that occurs in a document; with `every`, one
    more for each document, with its number of words as n and no window."""
    words = raw_words(F.col("text"))
    ahead = F.array(F.lit(""))  # no word is empty: this one stands for the document itself
    each = docs.select(*row_keys(), "doc_id", (F.concat(ahead, words) if every else words).alias("ws")).select(*_K, "doc_id", "ws", F.posexplode_outer("ws").alias("at", "word"))
    met = each.withColumn("h", F.xxhash64(folded(F.col("word")))).join(F.broadcast(block), "h", "left" if every else "inner")
    shift = 1 if every else 0
    begin = F.col("at") - shift - F.col("place")
    inside = (begin >= 0) & (begin + F.col("len") + shift <= F.size("ws"))
    there = F.slice("ws", F.greatest(begin, F.lit(0)) + 1 + shift, F.col("len"))
    # joined, not word by word: a function over arrays would end the generated code here, and each word would take along
    # a copy of its document
    held = F.coalesce(inside & (folded(F.array_join(there, " ")) == F.array_join("words", " ")), F.lit(False))
    own = (F.col("at") == 0) if every else F.lit(False)
    rows = met.filter(own | held)
    some = lambda c: F.when(~own, c)
    return rows.select(*_K, "doc_id", F.when(own, F.size("ws") - 1).alias("n"), some(begin).alias("begin"), some(F.col("len")).alias("len"), some(F.col("w")).alias("w"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit, items (sorted ids), contaminated."""
    windows, holders = windows_of(items, window)
    blocks = blocks_of(anchored(docs, windows))
    met = reduce(DataFrame.unionByName, [occurrences(docs, b, i == 0) for i, b in enumerate(blocks)])
    span = F.when(F.col("begin").isNotNull(), F.struct("begin", (F.col("begin") + F.col("len")).alias("end")))
    each = met.groupBy(*_K, "doc_id").agg(F.count("n").alias("rows"), F.max("n").alias("n"), F.collect_set(span).alias("spans"), F.collect_set("w").alias("ws"))
    each = materialize(each)
    of = each.select(*_K, F.explode("ws").alias("w")).join(holders, "w").groupBy(*_K).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    # spans in order of their beginning: each adds what lies past the furthest end so far
    covered = F.aggregate(
        F.sort_array("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, c: F.struct(F.greatest(a["end"], c["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), c["end"] - F.greatest(a["end"], c["begin"]))).alias("n")),
        lambda a: a["n"],
    )
    out = each.join(of, _K, "left").select("doc_id", F.col("n").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"))
    return out.select("doc_id", "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    out = contamination(docs.select("doc_id", "text"), items.select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs, all columns as they are, without contaminated rows."""
    texts = docs.select("doc_id", "text")
    blocks = blocks_of(anchored(texts, windows_of(items.select("item_id", "text"))[0]))
    bad = materialize(reduce(DataFrame.unionByName, [occurrences(texts, b, False) for b in blocks]).select(*_K).distinct())
    if 24 * bad.count() <= MOST_BYTES:
        bad = F.broadcast(bad)
    one, two = row_keys()
    own = docs.withColumns({_K[0]: one, _K[1]: two})
    return own.join(bad, _K, "left_anti").drop(*_K)


#: The same by plain comparison of all runs of words, for DuckDB.
REPORT_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
p AS (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS b FROM i WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[b:b + 9], ' ') AS s FROM p),
g AS (
  SELECT r, b, n, array_to_string(ws[b:b + n - 1], ' ') AS s
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS b FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n)),
o AS (SELECT r, b, n, item_id FROM g JOIN w USING (n, s)),
h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(b, b + n)) AS k FROM o) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256 FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM o) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
