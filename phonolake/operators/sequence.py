"""Operators that look at neighbours: features, islands, carrying forward, positions, ranks and boundary edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def neighbours(tokens: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """The two values before and after each token, with sentinels past the ends."""
    w = Window.partitionBy(*by).orderBy(order)
    n = F.count("*").over(Window.partitionBy(*by))
    at = F.row_number().over(w)
    return tokens.withColumns(
        {
            "before2": F.coalesce(F.lag(value, 2).over(w), F.when(at == 1, "<S2>").otherwise("<S>")),
            "before1": F.coalesce(F.lag(value, 1).over(w), F.lit("<S>")),
            "after1": F.coalesce(F.lead(value, 1).over(w), F.lit("<E>")),
            "after2": F.coalesce(F.lead(value, 2).over(w), F.when(at == n, "<E2>").otherwise("<E>")),
        }
    )


def islands(tokens: DataFrame, by: list[str], order: str, begins: Column, into: str = "island") -> DataFrame:
    """Numbers runs: a new one wherever `begins` holds."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn(into, F.sum(F.when(begins, 1).otherwise(0)).over(w))


def carried(tokens: DataFrame, by: list[str], order: str, value: Column, reset: Column, into: str) -> DataFrame:
    """The last value so far, forgotten at resets."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    state = F.when(value.isNotNull(), F.struct(value.alias("v"))).when(reset, F.struct(F.lit(None).cast("string").alias("v")))
    return tokens.withColumn(into, F.last(state, ignorenulls=True).over(w).getField("v"))


def clause_position(tokens: DataFrame, by: list[str], order: str) -> DataFrame:
    """only, first, last or middle."""
    w = Window.partitionBy(*by)
    at, n = F.row_number().over(w.orderBy(order)), F.count("*").over(w)
    return tokens.withColumn("place", F.when(n == 1, "only").when(at == 1, "first").when(at == n, "last").otherwise("middle"))


def demote_weakest_half(parts: DataFrame, by: list[str], order: str, ps: str) -> DataFrame:
    """Where more than half of a group's parts have primary stress, the weaker half of the parts is softened."""
    has = F.col(ps).contains(T.PRIMARY)
    spoken = F.coalesce(F.length(ps), F.lit(0)) > 0
    group = Window.partitionBy(*by)
    n, primary = F.count_if(spoken).over(group), F.count_if(spoken & has).over(group)
    rank = F.row_number().over(group.orderBy((~spoken).cast("int"), has.cast("int"), T.stress_weight(F.col(ps)), order))
    weak = spoken & (n >= 2) & (primary > F.floor((n + 1) / 2)) & (rank <= F.floor(n / 2))
    return parts.withColumn(ps, F.when(weak, T.apply_stress(F.col(ps), F.lit(-0.5))).otherwise(F.col(ps)))


def class_runs(text: Column) -> Column:
    """Runs of letters and marks, of digits, and every other character that is no white space on its own."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}]+|\p{Nd}+|[^\s\p{L}\p{M}\p{Nd}]"), F.lit(0))


def merged_tokens(tokens: DataFrame, by: list[str], order: str) -> DataFrame:
    """tokens: text, tag, ws, stress, currency, flags, rating, head, prespace. One row a group: texts with the spaces
    between, the tag of the first token with most capitals, the one stress if all agree, the largest currency, all flags
    in order, the least rating unless one is missing, the rest from the first or last token."""
    capitals = F.length("text") + F.length(F.regexp_replace("text", r"[^\p{Lu}]", ""))
    row = F.struct(F.col(order).alias("at"), "text", "tag", "ws", "head", "prespace")
    out = tokens.groupBy(*by).agg(
        F.sort_array(F.collect_list(row)).alias("_r"),
        F.max_by("tag", F.struct(capitals, -F.col(order))).alias("tag"),
        F.when(F.count_distinct("stress") == 1, F.max("stress")).alias("stress"),
        F.max("currency").alias("currency"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("flags", ""))))), "").alias("flags"),
        F.when(F.count_if(F.col("rating").isNull()) == 0, F.min("rating")).alias("rating"),
    )
    last = F.element_at("_r", -1)
    joined = F.concat(F.array_join(F.transform(F.slice("_r", F.lit(1), F.size("_r") - 1), lambda t: F.concat(t["text"], t["ws"])), ""), last["text"])
    first = F.element_at("_r", 1)
    return out.select(*by, joined.alias("text"), "tag", last["ws"].alias("ws"), "stress", "currency", "flags", "rating", first["head"].alias("head"), first["prespace"].alias("prespace"))


def future_context(words: Column) -> Column:
    """For arrays of sentence length. words: array<struct<text, tag, ps>>. What each word finds after it, from right to left: (vowel, to), where vowel is
    null at the end and after punctuation, and a word without telling characters lets it through."""
    start = F.struct(F.array().cast("array<struct<vowel:boolean,to:boolean>>").alias("out"), F.lit(None).cast("boolean").alias("vowel"), F.lit(False).alias("to"))

    def step(a: Column, w: Column) -> Column:
        kind = T.vowel_context(F.coalesce(w["ps"], F.lit("")))
        vowel = F.when(kind == "punctuation", F.lit(None).cast("boolean")).when(kind == "vowel", True).when(kind == "consonant", False).otherwise(a["vowel"])
        to = w["text"].isin("to", "To") | ((w["text"] == "TO") & w["tag"].isin("TO", "IN"))
        return F.struct(F.array_append(a["out"], F.struct(a["vowel"].alias("vowel"), a["to"].alias("to"))).alias("out"), vowel.alias("vowel"), F.coalesce(to, F.lit(False)).alias("to"))

    return F.reverse(F.aggregate(F.reverse(words), start, step, lambda a: a["out"]))


def future_context_rows(words: DataFrame, by: list[str], order: str) -> DataFrame:
    """The same for rows (text, tag, ps) of texts of any length: adds vowel and to, what each word finds after it."""
    back = Window.partitionBy(*by).orderBy(F.desc(order))
    kind = T.vowel_context(F.coalesce("ps", F.lit("")))
    told = F.when(kind == "punctuation", F.struct(F.lit(None).cast("boolean").alias("v"))).when(kind.isNotNull(), F.struct((kind == "vowel").alias("v")))
    to = F.col("text").isin("to", "To") | ((F.col("text") == "TO") & F.col("tag").isin("TO", "IN"))
    vowel = F.last(told, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)).getField("v")
    return words.withColumns({"vowel": vowel, "to": F.coalesce(F.lag(to).over(back), F.lit(False))})


def future_context_counts(words: Column) -> Column:
    """Of an array of words (letters, marks, digits, without white space) that are their own phonemes: how many have a vowel
    after them, and how many a "to": (vowel, to). Written with one sign for each telling word, those before a vowel are the
    spaces before its sign."""
    vowel, other = "\ue001", "\ue002"
    rest = T.CONSONANTS + T.PLAIN_PUNCTUATION
    signs = F.translate(F.array_join(words, " "), T.VOWELS + rest, vowel * len(T.VOWELS) + other * len(rest))
    first = F.regexp_replace(signs, f"(?<=[{vowel}{other}])[^ ]++|[^{vowel}{other} ]++", "")
    before = F.rtrim(F.regexp_replace(first, f"(?<! ) *+{other}", ""))
    to = F.size(words) - F.size(F.array_remove(F.array_remove(F.slice(words, F.lit(2), F.greatest(F.lit(0), F.size(words) - 1)), "to"), "To")) - 1
    return F.struct((F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))).cast("bigint").alias("vowel"), F.greatest(F.lit(0), to).cast("bigint").alias("to"))


def joined_boundaries(forms: Column) -> Column:
    """forms: array<struct<form, o_nasal, o_len, ctx, tails>>. Each word's front changes by whether the word before ends in
    a nasal, then the end of the word before by the class of this one."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("form"), F.array().cast("array<string>").alias("tails"), F.lit(True).alias("first"))

    def step(a: Column, w: Column) -> Column:
        both = ~a["first"] & (a["form"] != "") & (w["form"] != "")
        head = F.when(both, T.apply_head(w["form"], F.when(T.ends_nasal(a["form"]), w["o_nasal"]).otherwise(w["o_len"]))).otherwise(w["form"])
        tail = F.when(both & (w["ctx"] >= 0) & (w["ctx"] < F.size(a["tails"])), T.apply_tail(a["form"], F.get(a["tails"], w["ctx"]))).otherwise(a["form"])
        return F.struct(F.when(a["first"], a["out"]).otherwise(F.array_append(a["out"], tail)).alias("out"), head.alias("form"), w["tails"].alias("tails"), F.lit(False).alias("first"))

    return F.aggregate(forms, start, step, lambda a: F.when(a["first"], a["out"]).otherwise(F.array_append(a["out"], a["form"])))
