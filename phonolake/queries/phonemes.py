"""Functions over phoneme strings and punctuation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from . import query, table
from .common import PHONEMES_SQL, STRESS_SQL, TOKENS_SQL, phonemes, replaced_sql, stress, tokens

_V = T.VOWELS
_APPLY = f"""CASE WHEN s < -1 THEN translate(ps, 'ˈˌ', '') WHEN s = -1 OR (s IN (0.0, -0.5) AND contains(ps, 'ˈ')) THEN replace(replace(ps, 'ˌ', ''), 'ˈ', 'ˌ')
  WHEN s IN (0.0, 0.5, 1.0) AND NOT contains(ps, 'ˈ') AND NOT contains(ps, 'ˌ') THEN regexp_replace(ps, '^([^{_V}]*)([{_V}])', '\\1ˌ\\2')
  WHEN s >= 1 AND NOT contains(ps, 'ˈ') AND contains(ps, 'ˌ') THEN replace(ps, 'ˌ', 'ˈ')
  WHEN s > 1 AND NOT contains(ps, 'ˈ') AND NOT contains(ps, 'ˌ') THEN regexp_replace(ps, '^([^{_V}]*)([{_V}])', '\\1ˈ\\2') ELSE ps END"""


@query(f"WITH {PHONEMES_SQL}, x AS (SELECT word, ps, {STRESS_SQL} AS s FROM ph) SELECT word, CAST(s AS DOUBLE) AS stress, {_APPLY} AS stressed, CAST(length(ps) + length(regexp_replace(ps, '[^{T.DIPHTHONGS}]', '', 'g')) AS INTEGER) AS weight FROM x")
def stress_remap(spark, sf_dir):
    s = stress(F.col("raw_stress"))
    return phonemes(spark, sf_dir).select("word", s.alias("stress"), T.apply_stress(F.col("ps"), s).alias("stressed"), T.stress_weight(F.col("ps")).cast("int").alias("weight"))


def _suffix_sql(british: bool) -> str:
    iz, id_ = ("ɪz", "ɪd") if british else ("ᵻz", "ᵻd")
    t = f"WHEN right(ps, 1) <> 't' THEN ps || 'd' {'' if british else f'''WHEN length(ps) < 2 THEN ps || 'ɪd' WHEN regexp_matches(left(right(ps, 2), 1), '[{T.US_TAUS}]') THEN left(ps, length(ps) - 1) || 'ɾᵻd' '''} ELSE ps || '{'ɪd' if british else 'ᵻd'}' END"
    ing = "WHEN regexp_matches(ps, '[əː]$') THEN NULL" if british else f"WHEN length(ps) > 1 AND right(ps, 1) = 't' AND regexp_matches(left(right(ps, 2), 1), '[{T.US_TAUS}]') THEN left(ps, length(ps) - 1) || 'ɾɪŋ'"
    return f"""CASE WHEN regexp_matches(ps, '[ptkfθ]$') THEN ps || 's' WHEN regexp_matches(ps, '[szʃʒʧʤ]$') THEN ps || '{iz}' ELSE ps || 'z' END AS s_form,
  CASE WHEN regexp_matches(ps, '[pkfθʃsʧ]$') THEN ps || 't' WHEN right(ps, 1) = 'd' THEN ps || '{id_}' {t} AS ed_form, CASE {ing} ELSE ps || 'ɪŋ' END AS ing_form"""


@query(f"WITH {PHONEMES_SQL} SELECT word, 'us' AS dialect, {_suffix_sql(False)} FROM ph WHERE ps <> '' UNION ALL SELECT word, 'gb', {_suffix_sql(True)} FROM ph WHERE ps <> ''")
def suffixed_phonemes(spark, sf_dir):
    ph, ps = phonemes(spark, sf_dir).filter("ps <> ''"), F.col("ps")
    form = lambda gb: ph.select("word", F.lit("gb" if gb else "us").alias("dialect"), T.append_s(ps, gb).alias("s_form"), T.append_ed(ps, gb).alias("ed_form"), T.append_ing(ps, gb).alias("ing_form"))
    return form(False).unionByName(form(True))


_FIRST = f"regexp_extract(ps, '[{T.PLAIN_PUNCTUATION}{T.VOWELS}{T.CONSONANTS}]')"


@query(f"WITH {PHONEMES_SQL} SELECT word, CASE WHEN regexp_matches({_FIRST}, '[{T.PLAIN_PUNCTUATION}]') THEN 'punctuation' WHEN regexp_matches({_FIRST}, '[{T.VOWELS}]') THEN 'vowel' WHEN regexp_matches({_FIRST}, '[{T.CONSONANTS}]') THEN 'consonant' END AS context, translate(ps, 'ɾʔ', 'Tt') AS flapless FROM ph")
def vowel_contexts(spark, sf_dir):
    return phonemes(spark, sf_dir).select("word", T.vowel_context(F.col("ps")).alias("context"), T.flaps_to_t(F.col("ps")).alias("flapless"))


_RAW = "replace(replace(replace(word, 'ei', 'e^ɪ'), 'ou', 'o^ʊ'), 'ch', 't^ʃ')"


@query(f"WITH {TOKENS_SQL} SELECT DISTINCT word, {replaced_sql(replaced_sql(_RAW, T.ESPEAK_REMAP), (('^', ''), ('-', ''), ('«', '('), ('»', ')')))} AS phonemes FROM tok")
def espeak_remap(spark, sf_dir):
    raw = T.rewrites(F.col("word"), (("ei", "e^ɪ"), ("ou", "o^ʊ"), ("ch", "t^ʃ")))
    return tokens(spark, sf_dir).select("word").distinct().select("word", T.espeak_remap(raw).alias("phonemes"))


def _fallback_sql(pairs) -> str:
    x = replaced_sql(_RAW, T.FALLBACK_REMAP)
    x = f"replace(regexp_replace({x}, '(\\S)̩', 'ᵊ\\1', 'g'), '̩', '')"
    return f"replace(translate(replace({replaced_sql(x, pairs)}, 'o', 'ɔ'), 'ɾʔ', 'Tt'), '^', '')"


@query(f"WITH {TOKENS_SQL}, d AS (SELECT DISTINCT word FROM tok) SELECT word, {_fallback_sql(T.FALLBACK_US)} AS us, {_fallback_sql(T.FALLBACK_GB)} AS gb FROM d")
def fallback_remap(spark, sf_dir):
    raw = T.rewrites(F.col("word"), (("ei", "e^ɪ"), ("ou", "o^ʊ"), ("ch", "t^ʃ")))
    return tokens(spark, sf_dir).select("word").distinct().select("word", T.fallback_remap(raw).alias("us"), T.fallback_remap(raw, True).alias("gb"))


_LINE = "replace(replace(regexp_replace(text, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g'), chr(10), ' '), '  ', ' ')"


@query(f"SELECT doc_id, CASE WHEN l = '' THEN '' ELSE array_to_string(list_transform(string_split(l, ' '), lambda w: regexp_replace(w, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g') || ' '), '') END AS line FROM (SELECT doc_id, regexp_replace({_LINE}, '\\(.+?\\)', '', 'g') AS l FROM documents)")
def postprocessed_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.postprocess_chunk(F.col("text")).alias("line"))


_MARKS = r"(?:[ \t\n\r\f\v]*[;:,.!?¡¿—…\"«»“”(){}\[\]]+[ \t\n\r\f\v]*)+"


@query(
    rf"""WITH d AS (SELECT conv_id, turn, regexp_extract_all(text, '{_MARKS}') AS m, list_filter(regexp_split_to_array(text, '{_MARKS}'), lambda c: c <> '') AS c, text FROM conversations)
SELECT conv_id, turn, CAST(len(m) AS BIGINT) AS n_marks, CAST(len(c) AS BIGINT) AS n_chunks,
  CASE WHEN len(m) = 0 THEN '' WHEN len(m) = 1 AND m[1] = text THEN 'A' ELSE CASE WHEN starts_with(text, m[1]) THEN 'B' WHEN len(m) = 1 AND ends_with(text, m[1]) THEN 'E' ELSE 'I' END END AS first_place FROM d"""
)
def preserved_marks(spark, sf_dir):
    line = F.col("text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.marks(line).alias("m"), T.chunks(line).alias("c"))
    return rows.select("conv_id", "turn", F.size("m").cast("long").alias("n_marks"), F.size("c").cast("long").alias("n_chunks"), F.coalesce(F.get("m", F.lit(0))["position"], F.lit("")).alias("first_place"))


@query(
    rf"""WITH {TOKENS_SQL}, d AS (SELECT DISTINCT word, CAST(length(word) % 4 AS VARCHAR) || '|' || left(word, 1) AS delta FROM tok)
SELECT word, left(word, 1) || substr(word, 1 + CAST(length(word) % 4 AS INTEGER)) AS headed, left(word, greatest(0, length(word) - CAST(length(word) % 4 AS INTEGER))) || left(word, 1) AS tailed FROM d"""
)
def delta_edits(spark, sf_dir):
    words = tokens(spark, sf_dir).select("word").distinct()
    delta = F.concat((F.length("word") % 4).cast("string"), F.lit("|"), F.left("word", F.lit(1)))
    return words.select("word", T.apply_head(F.col("word"), delta).alias("headed"), T.apply_tail(F.col("word"), delta).alias("tailed"))


@query(
    rf"""WITH {TOKENS_SQL}, d AS (SELECT DISTINCT word, left(word, length(word) // 2) || 'x' || right(word, length(word) % 3) AS v FROM tok),
k AS (SELECT *, list_filter(range(0, least(length(word), length(v)) + 1), lambda k: left(word, k) = left(v, k))[-1] AS front, list_filter(range(0, least(length(word), length(v)) + 1), lambda k: right(word, k) = right(v, k))[-1] AS back FROM d)
SELECT word, CASE WHEN word = v THEN '' ELSE (length(word) - back) || '|' || left(v, length(v) - back) END AS head, CASE WHEN word = v THEN '' ELSE (length(word) - front) || '|' || substr(v, front + 1) END AS tail, v AS headed, v AS tailed FROM k"""
)
def derived_deltas(spark, sf_dir):
    """Edits derived from pairs, and what they make of the first of a pair: the second."""
    size, w, v = F.length("word"), F.col("word"), F.col("v")
    words = tokens(spark, sf_dir).select("word").distinct().withColumn("v", F.concat(F.left(w, F.floor(size / 2).cast("int")), F.lit("x"), F.right(w, size % 3)))
    made = words.select("word", T.head_delta(w, v).alias("head"), T.tail_delta(w, v).alias("tail"))
    return made.select("*", T.apply_head(w, F.col("head")).alias("headed"), T.apply_tail(w, F.col("tail")).alias("tailed"))


@query(
    rf"""WITH {PHONEMES_SQL} SELECT word, nullif(regexp_extract(ps, '([^ˈˌ\-^ \x{{0300}}-\x{{036F}}])[ˈˌ\-^ \x{{0300}}-\x{{036F}}]*$', 1), '') AS last_phoneme,
  CAST(len(regexp_extract_all(ps, '[ˈˌ]*[^ˈˌ][\x{{0300}}-\x{{036F}}{T.MODIFIERS}]*(?:\^(?:.[\x{{0300}}-\x{{036F}}{T.MODIFIERS}]*)?)?')) AS BIGINT) AS n_units FROM ph"""
)
def phoneme_units(spark, sf_dir):
    return phonemes(spark, sf_dir).select("word", T.last_phoneme(F.col("ps")).alias("last_phoneme"), F.size(T.phoneme_units(F.col("ps"))).cast("long").alias("n_units"))


_ZH = "('你好，世界。', '《书》：「一」、二！', '（三）；四？', '【五】．六«七»')"


@query(f"WITH z AS (SELECT unnest({_ZH.replace('(', '[', 1)[:-1]}]) AS zh) SELECT zh, regexp_replace({replaced_sql('zh', T.ZH_PUNCTUATION)}, '^[ ]+|[ ]+$', '', 'g') AS modern, {replaced_sql('zh', T.ZH_PUNCTUATION_LEGACY)} AS legacy FROM z")
def chinese_punctuation(spark, sf_dir):
    rows = spark.sql(f"SELECT explode(array{_ZH}) AS zh")
    return rows.select("zh", T.zh_punctuation(F.col("zh")).alias("modern"), T.zh_punctuation(F.col("zh"), True).alias("legacy"))


_KATA, _HIRA = "".join(map(chr, range(0x30A1, 0x30F7))), "".join(map(chr, range(0x3041, 0x3097)))


@query(f"SELECT p_partkey, translate(k, '{_KATA}', '{_HIRA}') AS hira FROM (SELECT p_partkey, translate(p_name, 'abcdefghijklmnopqrstuvwxyz', '{_KATA[:26]}') AS k FROM part)")
def hiragana(spark, sf_dir):
    kata = F.translate("p_name", "abcdefghijklmnopqrstuvwxyz", _KATA[:26])
    return table(spark, sf_dir, "part").select("p_partkey", T.kata_to_hira(kata).alias("hira"))


@query(
    r"""SELECT f, CASE WHEN regexp_matches(f, '^[+-]?[0-9]+$|^[+-]?0\.5$') THEN 'stress' WHEN regexp_matches(f, '^/.*/$') AND length(f) > 1 THEN 'phonemes' WHEN regexp_matches(f, '^#.*#$') AND length(f) > 1 THEN 'flags' END AS kind,
  CASE WHEN regexp_matches(f, '^[+-]?[0-9]+$|^[+-]?0\.5$') THEN TRY_CAST(ltrim(f, '+') AS DOUBLE) END AS stress,
  CASE WHEN regexp_matches(f, '^/.*/$') AND length(f) > 1 THEN rtrim(substr(f, 2), '/') WHEN regexp_matches(f, '^#.*#$') AND length(f) > 1 THEN rtrim(substr(f, 2), '#') END AS value
FROM (SELECT unnest(['2', '-0.5', '+0.5', '/fənˈimz/', '#a#', '1.5', 'x', '', '/', '-1']) AS f)"""
)
def link_features(spark, sf_dir):
    rows = spark.sql("SELECT explode(array('2', '-0.5', '+0.5', '/fənˈimz/', '#a#', '1.5', 'x', '', '/', '-1')) AS f")
    got = T.feature(F.col("f"))
    return rows.select("f", got["kind"].alias("kind"), got["stress"].alias("stress"), got["value"].alias("value"))
