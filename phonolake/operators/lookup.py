"""Dictionary look-ups as equi-joins: gold before silver, candidate keys in order, widest windows first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a dictionary is broadcast; above, the join is shuffled. A row takes about 100 bytes.
MOST_BROADCAST = 300_000


def sized(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has been counted and is small, else as it is."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def lexicon_lookup(tokens: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """lexicon: (tier, word, ps). Adds ps and rating: gold 4, silver 3, none null. A word in capitals that gold lacks is
    looked up in small letters."""
    gold, silver = (sized(lexicon.filter(F.col("tier") == t).select(F.col("word").alias(f"_{t}"), F.col("ps").alias(f"_{t}_ps")).dropDuplicates([f"_{t}"])) for t in ("gold", "silver"))
    known = tokens.join(gold.select(F.col("_gold").alias("_own"), F.lit(True).alias("_is")), F.col(word) == F.col("_own"), "left")
    keyed = known.withColumn("_key", F.when((F.col(word) == F.upper(word)) & F.col("_is").isNull(), F.lower(word)).otherwise(F.col(word))).drop("_own", "_is")
    out = keyed.join(gold, F.col("_key") == F.col("_gold"), "left").join(silver, F.col("_key") == F.col("_silver"), "left")
    rating = F.when(F.col("_gold_ps").isNotNull(), 4).when(F.col("_silver_ps").isNotNull(), 3)
    return out.withColumns({"ps": F.coalesce("_gold_ps", "_silver_ps"), "rating": rating}).drop("_key", "_gold", "_gold_ps", "_silver", "_silver_ps")


def first_hit(rows: DataFrame, keys: Column, table: DataFrame, table_key: str, ids: list[str], values: list[str]) -> DataFrame:
    """For each row, the values of the first of its candidate keys (an array, in order) that the table has; rows without
    a hit stay, with nulls."""
    each = rows.select(*ids, F.posexplode(keys).alias("_nth", "_key"))
    hits = each.join(sized(table.select(F.col(table_key).alias("_key"), *values)), "_key")
    best = hits.groupBy(*ids).agg(F.min_by(F.struct("_key", *values), "_nth").alias("_hit"))
    return rows.join(best, ids, "left").select(*rows.columns, F.col("_hit._key").alias("hit_key"), *(F.col(f"_hit.{v}").alias(v) for v in values))


def case_variants(word: Column) -> Column:
    """As it is, with the other apostrophe, and each with a small first letter, then all small."""
    other = F.when(word.contains("'"), F.replace(word, F.lit("'"), F.lit("’"))).when(word.contains("’"), F.replace(word, F.lit("’"), F.lit("'")))
    exact = F.array_compact(F.array(word, other))
    folded = F.flatten(F.transform(exact, lambda w: F.array(F.concat(F.lower(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 20)), F.lower(w))))
    return F.array_distinct(F.concat(exact, folded))


def stem_candidates(word: Column) -> Column:
    """The word, in small letters, with a moved or dropped apostrophe, and the stems of -s, -ed and -ing, in order."""
    cut = lambda n: F.left(word, F.length(word) - n)
    n = F.length(word)
    return F.array_distinct(
        F.array_compact(
            F.array(
                word,
                F.lower(word),
                F.when(word.endswith("s'"), F.concat(cut(2), F.lit("'s"))),
                F.when(word.endswith("'"), cut(1)),
                F.when((n >= 3) & word.endswith("s") & ~word.endswith("ss"), cut(1)),
                F.when(word.endswith("'s") | ((n > 4) & word.endswith("es") & ~word.endswith("ies")), cut(2)),
                F.when((n > 4) & word.endswith("ies"), F.concat(cut(3), F.lit("y"))),
                F.when((n >= 4) & word.endswith("d") & ~word.endswith("dd"), cut(1)),
                F.when((n > 4) & word.endswith("ed") & ~word.endswith("eed"), cut(2)),
                F.when((n > 5) & word.endswith("ing"), cut(3)),
                F.when((n >= 5) & word.endswith("ing"), F.concat(cut(3), F.lit("e"))),
                F.when((n > 5) & word.rlike(r"([bcdgklmnprstvxz])\1ing$|cking$"), cut(4)),
            )
        )
    )


def backoff_windows(words: DataFrame, segments: DataFrame, shapes: list[tuple[int, int]], word: str = "word") -> DataFrame:
    """segments: (shape, key, chunk). For each letter the chunk of the first shape whose window it has; the chunks in order
    as `emission`, an empty one where no window is known."""
    side = max(max(s) for s in shapes)
    padded = F.concat(F.lit("#" * side), F.col(word), F.lit("#" * side))
    letters = words.select(word, padded.alias("_padded"), F.explode(F.sequence(F.lit(0), F.length(word) - 1)).alias("_at")).filter(F.length(word) > 0)
    windows = F.array(*(F.struct(F.lit(i).alias("shape"), F.substr(F.col("_padded"), F.col("_at") + (side - left + 1), F.lit(left + right + 1)).alias("key")) for i, (left, right) in enumerate(shapes)))
    each = letters.select(word, "_at", F.explode(windows).alias("_w")).select(word, "_at", "_w.*")
    hits = each.join(sized(segments), ["shape", "key"], "left").groupBy(word, "_at").agg(F.min(F.when(F.col("chunk").isNotNull(), F.struct("shape", "chunk"))).alias("_hit"))
    return hits.groupBy(word).agg(F.sort_array(F.collect_list(F.struct("_at", F.coalesce("_hit.chunk", F.lit("")).alias("chunk")))).alias("_all")).select(word, F.transform("_all", lambda x: x["chunk"]).alias("emission"))


def stress_keys(nuclei: Column, accent: Column, word: Column) -> Column:
    """Keys from special to general: suffixes of three, two, one letters and none, any number of nuclei, anything."""
    key = lambda *parts: F.concat_ws("\t", *parts)
    n, a = nuclei.cast("string"), accent.cast("string")
    return F.array(*(key(n, a, F.right(word, F.lit(k))) for k in (3, 2, 1)), key(n, a, F.lit("")), key(F.lit("-1"), a, F.lit("")), key(F.lit("-1"), F.lit("-1"), F.lit("")))


def longest_prefix_cut(text: Column, words: Column, most: int) -> Column:
    """Greedy longest match of a small word list (an array column): the pieces of text in order; single characters where
    nothing fits."""
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("skip"))

    def step(a: Column, i: Column) -> Column:
        options = F.filter(F.transform(F.sequence(F.lit(most), F.lit(1), F.lit(-1)), lambda n: F.substr(text, i, n)), lambda w: (F.length(w) == 1) | F.array_contains(words, w))
        best = F.get(options, F.lit(0))
        return F.when(a["skip"] > 0, F.struct(a["out"].alias("out"), (a["skip"] - 1).alias("skip"))).otherwise(F.struct(F.array_append(a["out"], best).alias("out"), (F.length(best) - 1).alias("skip")))

    return F.aggregate(F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>")), state, step, lambda a: a["out"])


def overlapping(tokens: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """Spans (start, stop, ...) with the tokens (begin, end, ...) that they overlap: an equi-join on `by`, then the bounds."""
    return tokens.join(spans, by).filter((F.col("begin") < F.col("stop")) & (F.col("start") < F.col("end")))


def with_pair_exceptions(tokens: DataFrame, pairs: DataFrame, by: list[str], order: str, token: str = "token") -> DataFrame:
    """pairs: (w1, w2, ...). Each token with the exception of the pair that it ends, if there is one."""
    before = F.lag(token).over(Window.partitionBy(*by).orderBy(order))
    return tokens.withColumn("w1", before).join(sized(pairs.withColumnRenamed("w2", token)), ["w1", token], "left")


#: Names of languages and the codes of their tables.
LANGUAGE_CODES = {"fr-fr": "fr", "pt-br": "pt", "en-us": "enus", "en-gb": "engb"}


def language_code(lang: Column) -> Column:
    out = F.when(F.lit(False), lang)
    for k, v in LANGUAGE_CODES.items():
        out = out.when(lang == k, v)
    return out.otherwise(lang)
