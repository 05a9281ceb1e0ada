"""Dictionary look-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lookup as L
from ..operators import mining as M
from . import query, table
from .common import TOKENS_SQL, tokens

#: A lexicon over the corpus itself: frequent small words are gold, others that occur twice silver; the reading is the word
#: between marks.
_LEX = f"""WITH {TOKENS_SQL}, n AS MATERIALIZED (SELECT word, count(*) AS n FROM tok WHERE NOT contains(word, 'İ') GROUP BY word),
lex AS MATERIALIZED (SELECT word, CASE WHEN n >= 20 THEN 'gold' ELSE 'silver' END AS tier, '/' || word || '/' AS ps FROM n WHERE n >= 2 AND word = lower(word)), v AS MATERIALIZED (SELECT word FROM n)"""


def _words(spark, sf_dir):
    return tokens(spark, sf_dir).filter(~F.col("word").contains("İ")).groupBy("word").agg(F.count("*").alias("n"))


def _lexicon(words):
    return words.filter((F.col("n") >= 2) & (F.col("word") == F.lower("word"))).select("word", F.when(F.col("n") >= 20, "gold").otherwise("silver").alias("tier"), F.concat(F.lit("/"), "word", F.lit("/")).alias("ps"))


@query(
    f"""{_LEX}, k AS (SELECT v.word, CASE WHEN v.word = upper(v.word) AND g.word IS NULL THEN lower(v.word) ELSE v.word END AS key FROM v LEFT JOIN lex AS g ON g.word = v.word AND g.tier = 'gold')
SELECT k.word, coalesce(g.ps, s.ps) AS ps, CAST(CASE WHEN g.ps IS NOT NULL THEN 4 WHEN s.ps IS NOT NULL THEN 3 END AS DOUBLE) AS rating FROM k LEFT JOIN lex AS g ON g.word = key AND g.tier = 'gold' LEFT JOIN lex AS s ON s.word = key AND s.tier = 'silver'"""
)
def lexicon_lookup(spark, sf_dir):
    return L.lexicon_lookup(_words(spark, sf_dir).select("word"), _lexicon(_words(spark, sf_dir))).withColumn("rating", F.col("rating").cast("double"))


_STEMS = """[word, lower(word), CASE WHEN right(word, 2) = 's''' THEN left(word, length(word) - 2) || '''s' END, CASE WHEN right(word, 1) = '''' THEN left(word, length(word) - 1) END,
  CASE WHEN length(word) >= 3 AND right(word, 1) = 's' AND right(word, 2) <> 'ss' THEN left(word, length(word) - 1) END, CASE WHEN right(word, 2) = '''s' OR (length(word) > 4 AND right(word, 2) = 'es' AND right(word, 3) <> 'ies') THEN left(word, length(word) - 2) END,
  CASE WHEN length(word) > 4 AND right(word, 3) = 'ies' THEN left(word, length(word) - 3) || 'y' END, CASE WHEN length(word) >= 4 AND right(word, 1) = 'd' AND right(word, 2) <> 'dd' THEN left(word, length(word) - 1) END,
  CASE WHEN length(word) > 4 AND right(word, 2) = 'ed' AND right(word, 3) <> 'eed' THEN left(word, length(word) - 2) END, CASE WHEN length(word) > 5 AND right(word, 3) = 'ing' THEN left(word, length(word) - 3) END,
  CASE WHEN length(word) >= 5 AND right(word, 3) = 'ing' THEN left(word, length(word) - 3) || 'e' END,
  CASE WHEN length(word) > 5 AND (right(word, 5) = 'cking' OR (right(word, 3) = 'ing' AND substr(word, -4, 1) = substr(word, -5, 1) AND contains('bcdgklmnprstvxz', substr(word, -4, 1)))) THEN left(word, length(word) - 4) END]"""


@query(
    f"""{_LEX}, c AS (SELECT word, ks[i] AS key, i FROM (SELECT word, {_STEMS} AS ks, unnest(range(1, 13)) AS i FROM v) WHERE ks[i] IS NOT NULL),
h AS (SELECT c.word, min_by(lex.word, i) AS hit_key, min_by(lex.ps, i) AS ps FROM c JOIN lex ON lex.word = c.key GROUP BY c.word) SELECT v.word, hit_key, ps FROM v LEFT JOIN h USING (word)"""
)
def cascading_lookup(spark, sf_dir):
    words = _words(spark, sf_dir).select("word")
    return L.first_hit(words, L.stem_candidates(F.col("word")), _lexicon(_words(spark, sf_dir)), "word", ["word"], ["ps"])


@query(f"{_LEX} SELECT v.word, EXISTS (SELECT 1 FROM lex WHERE lex.word = v.word AND tier = 'gold') AS in_gold FROM v WHERE EXISTS (SELECT 1 FROM lex WHERE lex.word = lower(v.word))")
def known_words(spark, sf_dir):
    words, lex = _words(spark, sf_dir), _lexicon(_words(spark, sf_dir))
    known = words.join(lex.select(F.col("word").alias("l")), F.lower("word") == F.col("l"), "left_semi")
    gold = lex.filter("tier = 'gold'").select("word", F.lit(True).alias("g"))
    return known.join(gold, "word", "left").select("word", F.coalesce("g", F.lit(False)).alias("in_gold"))


@query(
    f"""{_LEX}, c AS (SELECT word, ks[i] AS key, i FROM (SELECT word, [word, lower(left(word, 1)) || substr(word, 2), lower(word)] AS ks, unnest(range(1, 4)) AS i FROM v)),
h AS (SELECT c.word, min_by(lex.word, i) AS hit_key FROM c JOIN lex ON lex.word = c.key GROUP BY c.word) SELECT v.word, hit_key FROM v LEFT JOIN h USING (word)"""
)
def case_variant_lookup(spark, sf_dir):
    words = _words(spark, sf_dir).select("word")
    return L.first_hit(words, L.case_variants(F.col("word")), _lexicon(_words(spark, sf_dir)), "word", ["word"], ["ps"]).select("word", "hit_key")


@query(
    f"""WITH {TOKENS_SQL}, p AS (SELECT doc_id, i, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS w1 FROM tok), x AS (SELECT w1, word, count(*) AS n FROM p WHERE w1 IS NOT NULL GROUP BY ALL HAVING count(*) >= 40)
SELECT p.doc_id, count(*) AS n_tokens, count(x.n) AS n_exceptions FROM p LEFT JOIN x USING (w1, word) GROUP BY p.doc_id"""
)
def pair_exceptions(spark, sf_dir):
    """Words and the ones before them come from each document's array, without a sort; the pairs are made once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.word_tokens(F.col("text")).alias("ws"))
    pairs = M.bigram_counts(docs, F.col("ws")).withColumnRenamed("n", "hits").filter("hits >= 40").persist()
    before = F.concat(F.array(F.lit(None).cast("string")), F.col("ws"))
    toks = docs.filter(F.size("ws") > 0).select("doc_id", F.inline_outer(F.arrays_zip(before.alias("w1"), F.col("ws").alias("w2"))).alias("w1", "w2")).filter("w2 IS NOT NULL")
    return toks.join(L.sized(pairs), ["w1", "w2"], "left").groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count("hits").alias("n_exceptions"))


@query(
    """WITH f AS (SELECT doc_id, lang, 'len=' || CAST(length(text) % 7 AS VARCHAR) AS feature FROM documents UNION ALL SELECT doc_id, lang, 'first=' || left(text, 1) FROM documents),
w AS (SELECT feature, lang AS tag, count(*) AS w FROM f GROUP BY ALL), s AS (SELECT f.doc_id, w.tag, sum(w.w) AS score FROM f JOIN w USING (feature) GROUP BY ALL)
SELECT doc_id, tag, CAST(score AS BIGINT) AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, tag DESC) = 1"""
)
def feature_weight_argmax(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    features = F.array(F.concat(F.lit("len="), (F.length("text") % 7).cast("string")), F.concat(F.lit("first="), F.left("text", F.lit(1))))
    each = docs.select("doc_id", "lang", F.explode(features).alias("feature"))
    weights = each.groupBy("feature", F.col("lang").alias("tag")).agg(F.count("*").alias("w"))
    scores = each.select("doc_id", "feature").join(L.sized(weights), "feature").groupBy("doc_id", "tag").agg(F.sum("w").alias("score"))
    return scores.groupBy("doc_id").agg(F.max(F.struct("score", "tag")).alias("m")).select("doc_id", "m.tag", "m.score")


@query(
    """WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part), l AS (SELECT word, '#' || word || '#' AS pad, unnest(range(1, length(word) + 1)) AS i FROM w WHERE word <> ''),
s AS (SELECT DISTINCT 0 AS shape, substr(pad, i, 3) AS key FROM l WHERE word < 'm' UNION ALL SELECT DISTINCT 1, substr(pad, i + 1, 1) FROM l),
e AS (SELECT word, i, min(shape) AS shape, min_by(key, shape) AS key FROM (SELECT l.word, l.i, s.shape, s.key FROM l JOIN s ON (s.shape = 0 AND s.key = substr(pad, i, 3)) OR (s.shape = 1 AND s.key = substr(pad, i + 1, 1))) GROUP BY ALL)
SELECT word, string_agg(upper(key), '' ORDER BY i) AS emission FROM e GROUP BY word"""
)
def backoff_windows(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).filter("word <> ''").distinct()
    padded = F.concat(F.lit("#"), "word", F.lit("#"))
    letters = words.select("word", padded.alias("pad"), F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    wide = letters.filter("word < 'm'").select(F.lit(0).alias("shape"), F.substr("pad", F.col("i"), F.lit(3)).alias("key"))
    narrow = letters.select(F.lit(1).alias("shape"), F.substr("pad", F.col("i") + 1, F.lit(1)).alias("key"))
    segments = wide.union(narrow).distinct().withColumn("chunk", F.upper("key"))
    return L.backoff_windows(words, segments, [(1, 1), (0, 0)]).select("word", F.array_join("emission", "").alias("emission"))


@query(
    """WITH k AS (SELECT DISTINCT c_custkey, length(c_name) % 4 AS n, c_custkey % 3 - 1 AS a, c_name AS w FROM customer)
SELECT c_custkey, concat(n, chr(9), a, chr(9), right(w, 3)) AS k1, concat(n, chr(9), a, chr(9), right(w, 1)) AS k3, concat(-1, chr(9), a, chr(9)) AS k5 FROM k"""
)
def stress_key_backoff(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", L.stress_keys(F.length("c_name") % 4, F.col("c_custkey") % 3 - 1, F.col("c_name")).alias("k"))
    return rows.select("c_custkey", F.get("k", F.lit(0)).alias("k1"), F.get("k", F.lit(2)).alias("k3"), F.get("k", F.lit(4)).alias("k5"))


@query(
    r"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS s, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM documents),
t AS (SELECT doc_id, i, b - length(s) AS begin, b AS stop FROM (SELECT doc_id, i, s, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS b FROM w)),
s AS (SELECT doc_id, 100 AS start, 100 + 10 * (1 + doc_id % 9) AS stop FROM documents)
SELECT t.doc_id, t.i FROM t JOIN s USING (doc_id) WHERE t.begin < s.stop AND s.start < t.stop"""
)
def interval_overlaps(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.posexplode_outer(F.split("text", " ")).alias("p", "word")).filter("word IS NOT NULL")
    end = F.sum(F.length("word") + 1).over(Window.partitionBy("doc_id").orderBy("p")) - 1
    toks = words.select("doc_id", (F.col("p") + 1).cast("long").alias("i"), (end - F.length("word")).alias("begin"), end.alias("end"))
    links = docs.select("doc_id", F.lit(100).alias("start"), (100 + 10 * (1 + F.col("doc_id") % 9)).alias("stop"))
    return L.overlapping(toks, links, ["doc_id"]).select("doc_id", "i")


@query("SELECT a.turn, count(*) AS n, CAST(count_if(a.text = lower(b.text)) AS BIGINT) AS same FROM conversations a JOIN conversations b ON a.turn = b.turn AND a.conv_id = b.conv_id GROUP BY a.turn")
def positional_zip(spark, sf_dir):
    a = table(spark, sf_dir, "conversations")
    b = a.select("conv_id", "turn", F.lower("text").alias("expected"))
    return a.join(b, ["conv_id", "turn"]).groupBy("turn").agg(F.count("*").alias("n"), F.count_if(F.col("text") == F.col("expected")).alias("same"))


@query("SELECT CASE l WHEN 'fr-fr' THEN 'fr' WHEN 'pt-br' THEN 'pt' WHEN 'en-us' THEN 'enus' WHEN 'en-gb' THEN 'engb' ELSE l END AS code, count(*) AS n FROM (SELECT CASE lang WHEN 'en' THEN 'en-us' WHEN 'fr' THEN 'fr-fr' ELSE lang END AS l FROM documents) GROUP BY 1")
def language_codes(spark, sf_dir):
    lang = F.when(F.col("lang") == "en", "en-us").when(F.col("lang") == "fr", "fr-fr").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select(L.language_code(lang).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query()
def longest_prefix_cuts(spark, sf_dir):
    words = F.array(*map(F.lit, ["tion", "th", "the", "ing", "an", "er", "on", "enth"]))
    vocabulary = tokens(spark, sf_dir).select("word").distinct()
    return vocabulary.select("word", F.array_join(L.longest_prefix_cut(F.col("word"), words, 4), "|").alias("pieces"))
