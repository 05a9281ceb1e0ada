"""Numbers as words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from . import query, table

_ONES = "[" + ", ".join(f"'{w}'" for w in N.ONES) + "]"
_TENS = "[" + ", ".join(f"'{w}'" for w in N.TENS) + "]"


def _below(n: str) -> str:
    two = f"CASE WHEN {n} % 100 < 20 THEN ({_ONES})[1 + {n} % 100] WHEN {n} % 10 = 0 THEN ({_TENS})[{n} % 100 // 10 - 1] ELSE ({_TENS})[{n} % 100 // 10 - 1] || '-' || ({_ONES})[1 + {n} % 10] END"
    return f"(CASE WHEN {n} >= 100 THEN ({_ONES})[1 + {n} // 100] || ' hundred' || CASE WHEN {n} % 100 > 0 THEN ' and ' ELSE '' END ELSE '' END || CASE WHEN {n} % 100 > 0 OR {n} = 0 THEN {two} ELSE '' END)"


def _cardinal(n: str) -> str:
    return f"(CASE WHEN {n} >= 1000 THEN {_below(f'({n} // 1000)')} || ' thousand' || CASE WHEN {n} % 1000 = 0 THEN '' WHEN {n} % 1000 < 100 THEN ' and ' ELSE ', ' END ELSE '' END || CASE WHEN {n} % 1000 > 0 OR {n} = 0 THEN {_below(f'({n} % 1000)')} ELSE '' END)"


@query(f"SELECT DISTINCT o_orderkey AS n, {_cardinal('o_orderkey')} AS words FROM orders WHERE o_orderkey < 1000000")
def cardinal_english(spark, sf_dir):
    """All keys; the SQL, which stops at thousands, leaves out those from a million on."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n")).distinct()
    small = keys.filter("n < 1000000").select("n", N.cardinal_column(F.col("n")).alias("words"))
    return small.union(N.spelled(keys.filter("n >= 1000000"), "n", "words", lambda n: N.cardinal(int(n))).select("n", "words"))


_Y = "y"
_YEAR = f"CASE WHEN y // 100 = 0 OR y // 100 >= 100 OR (y // 100 % 10 = 0 AND y % 100 < 10) THEN {_cardinal('y')} ELSE {_below('(y // 100)')} || ' ' || CASE WHEN y % 100 = 0 THEN 'hundred' WHEN y % 100 < 10 THEN 'oh-' || {_below('(y % 100)')} ELSE {_below('(y % 100)')} END END"


@query(f"SELECT y, {_YEAR} AS words FROM (SELECT DISTINCT o_orderkey % 3000 AS y FROM orders)")
def year_english(spark, sf_dir):
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3000).alias("y")).distinct().select("y", N.year_column(F.col("y")).alias("words"))


@query()
def ordinal_english(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"))
    return N.spelled(keys, "n", "words", N.ordinal)


@query()
def decimal_english(spark, sf_dir):
    prices = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"))
    return N.spelled(prices, "x", "words", N.decimal)


_K1 = "[" + ", ".join(f"'{w}'" for w in ["", *N.KANA_ONES[1:]]) + "]"
_K10 = "[" + ", ".join(f"'{w}'" for w in ["", "じゅう", *(N.KANA_ONES[d] + "じゅう" for d in range(2, 10))]) + "]"
_K100 = "[" + ", ".join(f"'{w}'" for w in ["", *(N.KANA_HUNDREDS.get(d, N.KANA_ONES[d] + "ひゃく") for d in range(1, 10))]) + "]"
_K1000 = "[" + ", ".join(f"'{w}'" for w in ["", "せん", *(N.KANA_THOUSANDS.get(d, N.KANA_ONES[d] + "せん") for d in range(2, 10))]) + "]"


@query(f"SELECT n, CASE WHEN n = 0 THEN 'ゼロ' ELSE ({_K1000})[1 + n // 1000] || ({_K100})[1 + n // 100 % 10] || ({_K10})[1 + n // 10 % 10] || ({_K1})[1 + n % 10] END AS kana FROM (SELECT DISTINCT o_orderkey % 10000 AS n FROM orders)")
def kana_numbers(spark, sf_dir):
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 10000).alias("n")).distinct().select("n", N.kana_column(F.col("n")).alias("kana"))


@query(f"SELECT o_orderkey, translate(CAST(o_orderkey AS VARCHAR), '0123456789', '{N.HANZI}') AS hanzi, translate(translate(CAST(o_orderkey AS VARCHAR), '0123456789', '०१२३४५६७८९'), '०१२३४५६७८९', '0123456789') AS folded FROM orders")
def hanzi_digits(spark, sf_dir):
    digits = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", N.hanzi_digits_column(digits).alias("hanzi"), N.fold_digits(F.translate(digits, "0123456789", "०१२३४५६७८९")).alias("folded"))


@query()
def hanzi_integers(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("n"))
    return N.spelled(N.spelled(keys, "n", "modern", N.hanzi_integer), "n", "legacy", N.hanzi_legacy)


@query()
def kana_long_numbers(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 7919).cast("string").alias("n"))
    return N.spelled(keys, "n", "kana", N.kana_number)


@query()
def replay_number_words(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"))
    british = N.spelled(keys, "n", "gb", lambda n: " ".join(N.replay_words(int(n), True)))
    return N.spelled(british, "n", "us", lambda n: " ".join(N.replay_words(int(n))))
