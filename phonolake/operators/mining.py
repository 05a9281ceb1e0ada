"""Corpus statistics: vocabularies, n-grams, majority labels, modes, pruning, hash splits and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vocabulary(words: DataFrame, least: int = 2, longest: int = 40) -> DataFrame:
    """words: (word). Counts of words that occur at least `least` times and aren't too long."""
    return words.filter((F.col("word") != "") & (F.length("word") <= longest)).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def bigrams(tokens: Column) -> Column:
    """Neighbouring pairs (w1, w2) of an array of tokens."""
    last = F.size(tokens) - 1
    return F.when(last > 0, F.zip_with(F.slice(tokens, F.lit(1), last), F.slice(tokens, F.lit(2), last), lambda a, b: F.struct(a.alias("w1"), b.alias("w2"))))


def bigram_rows(tokens: Column) -> Column:
    """The same as rows, for select: a generator of (w1, w2), whose last row has no w2."""
    after = F.slice(tokens, F.lit(2), F.greatest(F.lit(0), F.size(tokens) - 1))
    return F.inline_outer(F.arrays_zip(tokens.alias("w1"), after.alias("w2"))).alias("w1", "w2")


def bigram_counts(docs: DataFrame, tokens: Column) -> DataFrame:
    """(w1, w2, n). Pairs are counted as one text and the length of its first word, which takes less room and fewer steps
    than two texts."""
    rows = docs.select(tokens.alias("_t")).select(bigram_rows(F.col("_t"))).filter("w2 IS NOT NULL")
    per = rows.groupBy(F.concat("w1", "w2").alias("_b"), F.length("w1").alias("_n")).agg(F.count("*").alias("n"))
    return per.select(F.left("_b", F.col("_n")).alias("w1"), F.substr("_b", F.col("_n") + 1).alias("w2"), "n")


def majority_label(rows: DataFrame, key: str, label: str, least: int, share: float) -> DataFrame:
    """Keys with at least `least` rows of which one label has at least `share`."""
    per = rows.groupBy(key, label).agg(F.count("*").alias("n"))
    whole = per.groupBy(key).agg(F.sum("n").alias("total"), F.max(F.struct("n", label)).alias("top"))
    return whole.filter((F.col("total") >= least) & (F.col("top.n") >= share * F.col("total"))).select(key, F.col(f"top.{label}").alias(label), F.col("top.n").alias("n"), "total")


def mode_per_key(rows: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """The most frequent value of each key; of equals the one that came first."""
    per = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(seq).alias("_first"))
    return per.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("_first"))).alias(value), F.max("n").alias("n"))


def keep_first(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row of each key, the first by seq: a min aggregated before it moves."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("_r")).select(*keys, "_r.*")


def ordered_union(parts: list[DataFrame], key: str) -> DataFrame:
    """Union in order; of equal keys the one of the earliest part stays. Adds `part`."""
    out = None
    for i, p in enumerate(parts):
        p = p.select(key).withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out.groupBy(key).agg(F.min("part").alias("part"))


def override_union(parts: list[DataFrame], key: str, value: str) -> DataFrame:
    """Union in which a later part's value replaces an earlier one's."""
    out = None
    for i, p in enumerate(parts):
        p = p.select(key, value).withColumn("_part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out.groupBy(key).agg(F.max_by(value, "_part").alias(value))


def log_probability(rows: DataFrame, given: str, value: str) -> DataFrame:
    """ln of the share of each value among the rows of what is given."""
    per = rows.groupBy(given, value).agg(F.count("*").alias("n"))
    return per.withColumn("lp", F.ln(F.col("n") / F.sum("n").over(Window.partitionBy(given))))


def top_classes(rows: DataFrame, signature: list[str], member: str, seq: str, most: int = 8) -> DataFrame:
    """The most frequent signatures, each with its first member."""
    per = rows.groupBy(*signature).agg(F.count("*").alias("n"), F.min_by(member, seq).alias("representative"))
    return per.orderBy(F.desc("n"), *signature).limit(most)


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    return rows.groupBy(truth, guess).agg(F.count("*").alias("n"))


def parity_report(rows: DataFrame, by: list[str], got: str, expected: str, flag: str) -> DataFrame:
    """Rows, exact ones, ones apart from white space, and unknown ones."""
    same, squeezed = F.col(got) == F.col(expected), lambda c: F.regexp_replace(c, r"\s+", " ")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(same).alias("exact"),
        F.count_if(~same & (squeezed(F.col(got)) == squeezed(F.col(expected)))).alias("near"),
        F.count_if(F.col(flag) == "oov").alias("unknown"),
    )


def checksum(rows: DataFrame, line: str) -> DataFrame:
    """sha256 over the lines in order, and their number: for tables of known, small size, as all lines meet in one row."""
    return rows.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("sha256"))


def prefixes(words: DataFrame, word: str) -> DataFrame:
    """All proper prefixes, each once."""
    return words.filter(F.length(word) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda n: F.left(F.col(word), n))).alias("prefix")).distinct()


def first_character_lengths(words: DataFrame, word: str) -> DataFrame:
    return words.filter(F.length(word) > 0).groupBy(F.left(word, F.lit(1)).alias("first")).agg(F.sort_array(F.collect_set(F.length(word))).alias("lengths"))


def drop_redundant_case(rows: DataFrame, word: str, payload: str) -> DataFrame:
    """Rows whose word isn't in small letters go where the small word has the same payload. Words meet by their small form,
    so rows are made once."""
    small = F.col(word) == F.lower(word)
    own = F.collect_set(F.when(small, F.struct(F.col(payload).alias("p")))).over(Window.partitionBy(F.lower(word)))
    same = F.exists("_own", lambda x: x["p"].eqNullSafe(F.col(payload)))
    return rows.withColumn("_own", own).filter(F.coalesce(small, F.lit(True)) | ~same).drop("_own")


def windows_of(words: DataFrame, shapes: list[tuple[int, int]], word: str = "word", emission: str = "emission") -> DataFrame:
    """(shape, key, chunk, seq) of each letter's windows, for words with a chunk for each letter."""
    side = max(max(s) for s in shapes)
    padded = F.concat(F.lit("#" * side), F.col(word), F.lit("#" * side))
    each = words.select(padded.alias("_padded"), F.col("seq"), F.posexplode(emission).alias("_at", "chunk"))
    cut = F.array(*(F.struct(F.lit(i).alias("shape"), F.substr(F.col("_padded"), F.col("_at") + (side - left + 1), F.lit(left + right + 1)).alias("key")) for i, (left, right) in enumerate(shapes)))
    return each.select(F.explode(cut).alias("_w"), "chunk", F.struct("seq", "_at").alias("seq")).select("_w.shape", "_w.key", "chunk", "seq")


def mode_windows(windows: DataFrame) -> DataFrame:
    per = windows.groupBy("shape", "key", "chunk").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    best = Window.partitionBy("shape", "key").orderBy(F.desc("n"), "first")
    return per.withColumn("_nth", F.row_number().over(best)).filter("_nth = 1").select("shape", "key", "chunk", "n")


def prune_windows(segments: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """Windows that a narrower kept one predicts go, from narrow to wide, so no prediction changes."""
    kept = segments.filter(F.col("shape") == len(shapes) - 1).select("shape", "key", "chunk")
    for i in range(len(shapes) - 2, -1, -1):
        left = shapes[i][0]
        own = segments.filter(F.col("shape") == i).select("shape", "key", "chunk")
        for j in range(i + 1, len(shapes)):
            inner = kept.filter(F.col("shape") == j).select(F.col("key").alias(f"_k{j}"), F.col("chunk").alias(f"_c{j}"))
            own = own.join(inner, F.substr(F.col("key"), F.lit(left - shapes[j][0] + 1), F.lit(shapes[j][0] + shapes[j][1] + 1)) == F.col(f"_k{j}"), "left")
        fallback = F.coalesce(*(F.col(f"_c{j}") for j in range(i + 1, len(shapes))))
        kept = kept.unionByName(own.filter(~F.col("chunk").eqNullSafe(fallback)).select("shape", "key", "chunk"))
    return kept


def seeded_sample(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows in an order that a hash of the key and the seed fixes."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
