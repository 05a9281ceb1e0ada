"""The functions for SQL text: temporary functions of a session, and a table function for tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import numbers as N
from . import phonemes as P


def _reading(read):
    @F.pandas_udf("string")
    def f(values: pd.Series) -> pd.Series:
        known = {v: read(v) for v in values.dropna().unique()}
        return values.map(known).astype(object).where(values.notna(), None)

    return f


class Tokenize:
    """tokenize(text): (nth, token, ws)."""

    def __init__(self):
        from ..operators.kernels import AffixTokenizer

        self.cut = AffixTokenizer()

    def eval(self, text: str) -> Iterator[tuple[int, str, str]]:
        for i, (token, ws) in enumerate(self.cut(text or "")):
            yield i, token, ws


def register(spark: SparkSession) -> None:
    for name, read in {
        "cardinal_words": lambda v: N.cardinal(int(v)), "ordinal_words": lambda v: N.ordinal(int(v)), "year_words": lambda v: N.year(int(v)), "decimal_words": lambda v: N.decimal(float(v)),
        "hanzi_number": lambda v: N.hanzi_number(str(v)), "hanzi_numbers": lambda v: N.hanzi_numbers(str(v)), "kana_number": lambda v: N.kana_number(str(v)),
        "plural_phonemes": lambda v: P.append_s(v, False), "past_phonemes": lambda v: P.append_ed(v, False), "progressive_phonemes": lambda v: P.append_ing(v, False),
    }.items():
        spark.udf.register(name, _reading(read))
    spark.udtf.register("tokenize", F.udtf(Tokenize, returnType="nth int, token string, ws string"))
