"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lookup as L
from ..operators import mining as M
from . import query, table
from .common import TOKENS_SQL, tokens


@query(f"WITH {TOKENS_SQL} SELECT word, count(*) AS n FROM tok WHERE length(word) <= 40 GROUP BY word HAVING count(*) >= 2")
def vocabulary_counts(spark, sf_dir):
    return M.vocabulary(tokens(spark, sf_dir))


def _pairs(spark, sf_dir, name="documents"):
    return M.bigram_counts(table(spark, sf_dir, name), T.word_tokens(F.lower("text")))


_PAIRS = r"""b AS (SELECT ws[i] AS w1, ws[i + 1] AS w2 FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM (SELECT regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS ws FROM documents WHERE NOT contains(text, 'İ'))))"""


@query(f"WITH {_PAIRS} SELECT w1, w2, count(*) AS n FROM b GROUP BY ALL ORDER BY n DESC, w1, w2 LIMIT 1000")
def bigram_counts_top(spark, sf_dir):
    return _pairs(spark, sf_dir).orderBy(F.desc("n"), "w1", "w2").limit(1000)


@query(
    f"""WITH {_PAIRS}, x AS (SELECT DISTINCT ws[i] AS w1, ws[i + 1] AS w2 FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM (SELECT regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS ws FROM benchmark)))
SELECT w1, w2, count(*) AS n FROM b ANTI JOIN x USING (w1, w2) GROUP BY ALL"""
)
def bigrams_not_in_benchmark(spark, sf_dir):
    return _pairs(spark, sf_dir).join(L.sized(_pairs(spark, sf_dir, "benchmark").select("w1", "w2")), ["w1", "w2"], "left_anti")


@query("SELECT text, min(doc_id) AS doc_id, min_by(lang, doc_id) AS lang FROM documents GROUP BY text")
def dedup_keep_first(spark, sf_dir):
    return M.keep_first(table(spark, sf_dir, "documents").select("text", "doc_id", "lang"), ["text"], "doc_id")


@query(
    f"""WITH {TOKENS_SQL}, c AS (SELECT word, lang, count(*) AS n FROM tok GROUP BY ALL), s AS (SELECT word, sum(n) AS total, max(n) AS n, max(lang) FILTER (lang IS NOT NULL) AS l FROM c GROUP BY word)
SELECT s.word, max(c.lang) AS lang, s.n, CAST(s.total AS BIGINT) AS total FROM s JOIN c ON c.word = s.word AND c.n = s.n WHERE total >= 20 AND s.n >= 0.99 * total GROUP BY s.word, s.n, s.total"""
)
def majority_language(spark, sf_dir):
    return M.majority_label(tokens(spark, sf_dir), "word", "lang", 20, 0.99)


@query(
    f"""WITH {TOKENS_SQL}, x AS (SELECT left(word, 2) AS k, right(word, 1) AS v, doc_id * 100000 + i AS seq FROM tok WHERE length(word) > 2), c AS (SELECT k, v, count(*) AS n, min(seq) AS f FROM x GROUP BY ALL)
SELECT k, v, n FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, f) = 1"""
)
def mode_per_key(spark, sf_dir):
    rows = tokens(spark, sf_dir).filter("length(word) > 2").select(F.left("word", F.lit(2)).alias("k"), F.right("word", F.lit(1)).alias("v"), (F.col("doc_id") * 100000 + F.col("i")).alias("seq"))
    return M.mode_per_key(rows, ["k"], "v", "seq")


@query(f"WITH {TOKENS_SQL}, c AS (SELECT left(word, 1) AS letter, substr(word, 2, 1) AS after, count(*) AS n FROM tok GROUP BY ALL) SELECT letter, after, n, round(ln(n / sum(n) OVER (PARTITION BY letter)), 6) AS lp FROM c")
def letter_log_probability(spark, sf_dir):
    rows = tokens(spark, sf_dir).select(F.left("word", F.lit(1)).alias("letter"), F.substring("word", 2, 1).alias("after"))
    return M.log_probability(rows, "letter", "after").withColumn("lp", F.round("lp", 6))


@query("SELECT event_type, user_id % 10 AS class, count(*) AS n, min_by(event_id, event_id) AS representative FROM events GROUP BY ALL ORDER BY n DESC, event_type, class LIMIT 8")
def context_class_top(spark, sf_dir):
    return M.top_classes(table(spark, sf_dir, "events").withColumn("class", F.col("user_id") % 10), ["event_type", "class"], "event_id", "event_id")


@query("SELECT toxic, quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return M.confusion(rows, "toxic", "quality")


@query(
    """WITH d AS (SELECT lang, text, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, ' ', '  ') ELSE upper(lang) END AS got, CASE WHEN doc_id % 4 = 3 THEN 'oov' ELSE 'ok' END AS flag FROM documents)
SELECT lang, count(*) AS n, CAST(count_if(got = text) AS BIGINT) AS exact, CAST(count_if(got <> text AND regexp_replace(got, '[ \\t\\n\\r\\f\\v]+', ' ', 'g') = regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS BIGINT) AS near, CAST(count_if(flag = 'oov') AS BIGINT) AS unknown FROM d GROUP BY lang"""
)
def parity_buckets(spark, sf_dir):
    got = F.when(F.col("doc_id") % 4 == 0, F.col("text")).when(F.col("doc_id") % 4 == 1, F.replace("text", F.lit(" "), F.lit("  "))).otherwise(F.upper("lang"))
    rows = table(spark, sf_dir, "documents").select("lang", "text", got.alias("got"), F.when(F.col("doc_id") % 4 == 3, "oov").otherwise("ok").alias("flag"))
    return M.parity_report(rows, ["lang"], "got", "text", "flag")


@query("SELECT count(*) AS n, sha256(string_agg(p_name, chr(10) ORDER BY p_name)) AS sha256 FROM part")
def content_checksum(spark, sf_dir):
    return M.checksum(table(spark, sf_dir, "part").filter("p_name IS NOT NULL"), "p_name")


@query("SELECT DISTINCT left(n_name, i) AS prefix FROM (SELECT n_name, unnest(range(1, length(n_name))) AS i FROM nation)")
def prefix_set(spark, sf_dir):
    return M.prefixes(table(spark, sf_dir, "nation"), "n_name")


@query("SELECT left(p_name, 1) AS first, CAST(list_sort(list(DISTINCT length(p_name))) AS VARCHAR) AS lengths FROM part GROUP BY 1")
def first_character_lengths(spark, sf_dir):
    out = M.first_character_lengths(table(spark, sf_dir, "part"), "p_name")
    return out.select("first", F.concat(F.lit("["), F.array_join(F.transform("lengths", lambda x: x.cast("string")), ", "), F.lit("]")).alias("lengths"))


_CASES = f"WITH {TOKENS_SQL}, v AS (SELECT word, max(lang) AS payload FROM tok WHERE NOT contains(word, 'İ') GROUP BY word)"


def _cased(spark, sf_dir):
    return tokens(spark, sf_dir).filter(~F.col("word").contains("İ")).groupBy("word").agg(F.max("lang").alias("payload"))


@query(f"{_CASES} SELECT word, payload FROM v WHERE NOT EXISTS (SELECT 1 FROM v AS l WHERE l.word = lower(v.word) AND l.word <> v.word AND l.payload IS NOT DISTINCT FROM v.payload)")
def redundant_case_pruned(spark, sf_dir):
    return M.drop_redundant_case(_cased(spark, sf_dir), "word", "payload")


@query(f"WITH {TOKENS_SQL}, b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS word FROM benchmark), u AS (SELECT word, 0 AS part FROM b UNION ALL SELECT DISTINCT word, 1 FROM tok) SELECT word, min(part) AS part FROM u GROUP BY word")
def ordered_union(spark, sf_dir):
    first = table(spark, sf_dir, "benchmark").select(F.explode(T.word_tokens(F.col("text"))).alias("word"))
    return M.ordered_union([first, tokens(spark, sf_dir)], "word")


@query("WITH p AS (SELECT n_name AS k, 0 AS part, CAST(n_regionkey AS VARCHAR) AS v FROM nation UNION ALL SELECT upper(r_name), 1, r_name FROM region UNION ALL SELECT n_name, 2, 'own' FROM nation WHERE n_nationkey % 5 = 0) SELECT k, max_by(v, part) AS v FROM p GROUP BY k")
def override_union(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    base = nation.select(F.col("n_name").alias("k"), F.col("n_regionkey").cast("string").alias("v"))
    return M.override_union([base, region.select(F.upper("r_name").alias("k"), F.col("r_name").alias("v")), nation.filter("n_nationkey % 5 = 0").select(F.col("n_name").alias("k"), F.lit("own").alias("v"))], "k", "v")


_SHAPES = [(1, 1), (0, 1), (0, 0)]


def _lettered(spark, sf_dir):
    """Parts' names as words, with the next letter as each letter's chunk: a model to mine without phonemes."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("seq"))
    after = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substr(F.col("word"), i + 1, F.lit(1)), F.lit("!")))
    return words.select("word", F.xxhash64("word").alias("seq"), after.alias("emission"))


_WINDOWS = """w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part), l AS (SELECT word, '#' || word || '#' AS pad, unnest(range(1, length(word) + 1)) AS i FROM w WHERE word <> ''),
x AS (SELECT 0 AS shape, substr(pad, i, 3) AS key, substr(word, i + 1, 1) || '!' AS chunk FROM l UNION ALL SELECT 1, substr(pad, i + 1, 2), substr(word, i + 1, 1) || '!' FROM l UNION ALL SELECT 2, substr(pad, i + 1, 1), substr(word, i + 1, 1) || '!' FROM l),
c AS (SELECT shape, key, chunk, count(*) AS n FROM x GROUP BY ALL)"""


@query(f"WITH {_WINDOWS} SELECT shape, key, max(n) AS n, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY shape, key")
def window_modes(spark, sf_dir):
    windows = M.windows_of(_lettered(spark, sf_dir), _SHAPES)
    total = windows.groupBy("shape", "key").agg(F.count("*").alias("total"))
    return M.mode_windows(windows).select("shape", "key", "n").join(total, ["shape", "key"])


@query(
    f"""WITH {_WINDOWS}, m AS (SELECT shape, key, max_by(chunk, n * 1000 - ascii(chunk)) AS chunk FROM c GROUP BY shape, key),
k2 AS (SELECT key, chunk FROM m WHERE shape = 2), k1 AS (SELECT m.key, m.chunk FROM m LEFT JOIN k2 ON k2.key = substr(m.key, 1, 1) WHERE shape = 1 AND m.chunk IS DISTINCT FROM k2.chunk),
k0 AS (SELECT m.key, m.chunk FROM m LEFT JOIN k1 ON k1.key = substr(m.key, 2, 2) LEFT JOIN k2 ON k2.key = substr(m.key, 2, 1) WHERE shape = 0 AND m.chunk IS DISTINCT FROM coalesce(k1.chunk, k2.chunk))
SELECT 0 AS shape, key, chunk FROM k0 UNION ALL SELECT 1, key, chunk FROM k1 UNION ALL SELECT 2, key, chunk FROM k2"""
)
def windows_pruned(spark, sf_dir):
    windows = M.windows_of(_lettered(spark, sf_dir), _SHAPES).groupBy("shape", "key", "chunk").agg(F.count("*").alias("n"))
    modes = windows.groupBy("shape", "key").agg(F.max_by("chunk", F.col("n") * 1000 - F.ascii("chunk")).alias("chunk"))
    return M.prune_windows(modes, _SHAPES)


@query("SELECT event_type, round(avg(value), 6) AS mean, round(max(abs(value)), 6) AS scale, round(avg(value) - (SELECT avg(value) FROM events), 6) AS centred FROM events GROUP BY event_type")
def row_means(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    grand = events.agg(F.avg("value").alias("grand"))
    rows = events.groupBy("event_type").agg(F.avg("value").alias("m"), F.max(F.abs("value")).alias("s"))
    return rows.crossJoin(F.broadcast(grand)).select("event_type", F.round("m", 6).alias("mean"), F.round("s", 6).alias("scale"), F.round(F.col("m") - F.col("grand"), 6).alias("centred"))


@query("SELECT bucket, n, CAST(sum(n) OVER (ORDER BY bucket) AS BIGINT) AS upto FROM (SELECT user_id % 16 AS bucket, count(*) AS n FROM events GROUP BY 1)")
def bin_offsets(spark, sf_dir):
    from pyspark.sql import Window

    bins = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 16).alias("bucket")).agg(F.count("*").alias("n"))
    return bins.withColumn("upto", F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))  # 16 rows


@query()
def seeded_sample(spark, sf_dir):
    return M.seeded_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 42, 100)
