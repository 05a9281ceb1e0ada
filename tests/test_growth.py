"""Steps that grew faster than their input, or did more than once what is needed once; each with a plain form beside it."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from phonolake import queries
from phonolake.functions import text as T
from phonolake.operators import mining as M
from phonolake.operators import sequence as Q


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Documents of few words, so that pairs repeat, and some odd ones."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["to", "To", "TO", "ab", "a", "b", "ca", "the", "xyz", "Ünder", "77", "q", "été"]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    rows = list(enumerate([*texts, None, "", "  ", "to", "77 77 77", "to to a 7 7"]))
    folder = tmp_path_factory.mktemp("growth")
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(f"{folder}/documents.parquet")
    return str(folder), {i: re.findall(r"\w+", t or "") for i, t in rows}


def test_bigrams_are_counted_without_a_lambda(spark):
    """pairs were made by an interpreted function and counted as two texts each."""
    df = spark.createDataFrame([(["a", "bc", "ab", "c"],), (["ab", "c", "a", "bc"],), (["x"],), ([],), (None,), (["é", "é", "é"],)], "t array<string>")
    got = M.bigram_counts(df, F.col("t"))
    assert "lambda" not in plan(got)
    assert {(r["w1"], r["w2"]): r["n"] for r in got.collect()} == {("a", "bc"): 2, ("bc", "ab"): 1, ("ab", "c"): 2, ("c", "a"): 1, ("é", "é"): 2}


def test_pair_exceptions_without_a_sort(spark, made):
    """the tokens of all documents were sorted twice, and the pairs made twice."""
    got = queries.QUERIES["pair_exceptions"](spark, made[0])
    assert "Window" not in plan(got) and "Sort" not in plan(got)
    hits = Counter((a, b) for ws in made[1].values() for a, b in zip(ws, ws[1:], strict=False))
    want = {i: (len(ws), sum(hits[p] >= 40 for p in zip(ws, ws[1:], strict=False))) for i, ws in made[1].items() if ws}
    assert {r["doc_id"]: (r["n_tokens"], r["n_exceptions"]) for r in got.collect()} == want and sum(n for _, n in want.values()) > 0


def test_future_contexts_without_a_sort(spark, made):
    """the tokens of all documents were sorted."""
    got = queries.QUERIES["future_contexts"](spark, made[0])
    assert "Window" not in plan(got) and "Sort " not in plan(got)

    def counts(ws):
        vowel, to, kind = 0, sum(w in ("to", "To") for w in ws[1:]), None
        for w in reversed(ws):
            vowel += kind == "v"
            sign = next((c for c in w if c in T.VOWELS + T.CONSONANTS + T.PLAIN_PUNCTUATION), None)
            kind = kind if sign is None else "v" if sign in T.VOWELS else "c"
        return vowel, to

    assert {r["doc_id"]: (r["n_before_vowel"], r["n_before_to"]) for r in got.collect()} == {i: counts(ws) for i, ws in made[1].items() if ws}
    rows = spark.createDataFrame([(["q" * 5, "7"] * 3 + ["7"] * 20_000,)], "ws array<string>").select(Q.future_context_counts(F.col("ws")).alias("c")).first()
    assert tuple(rows["c"]) == (0, 0)


def test_case_is_pruned_from_words_made_once(spark, sf_dir):
    """all tokens were read and counted for each side of a join."""
    assert plan(queries.QUERIES["redundant_case_pruned"](spark, sf_dir)).count("Scan parquet") == 1
    rows = [("A", "x"), ("a", "x"), ("Bb", "x"), ("bb", "y"), ("BB", None), ("C", None), ("c", None), ("D", "x"), (None, "x")]
    got = M.drop_redundant_case(spark.createDataFrame(rows, "word string, lang string"), "word", "lang").collect()
    assert sorted(map(str, (r["word"] for r in got))) == sorted(["a", "Bb", "bb", "BB", "c", "D", "None"]) and set(got[0].asDict()) == {"word", "lang"}


def test_sentences_are_looked_for_at_marks_only(spark):
    """what stands before a mark was looked at from every character."""
    df = spark.createDataFrame([("Mr. Word word " * 600_000 + "end. End",)], "t string").persist()
    df.count()
    seconds = {}
    for name, split in (("plain", T.sentences), ("prose", T.prose_sentences)):
        begin = time.time()
        df.select(F.size(split(F.col("t"))).alias("n")).collect()
        seconds[name] = time.time() - begin
    assert seconds["prose"] < 6 + 3 * seconds["plain"]


def test_aligner_is_the_plain_search():
    """every word took the whole table of ways, cell by cell."""
    from itertools import product

    from phonolake.operators.kernels import Aligner

    rng = random.Random(6)
    for _ in range(60):
        table = {(rng.choice("abt"), rng.choice(["a", "b", "t", "", "ab", "aa"])): rng.choice([-0.1, -1.0, -3.0, -rng.random()]) for _ in range(8)}
        best = Aligner(table)
        for _ in range(10):
            letters = [rng.choice("abtz") for _ in range(rng.randint(0, 5))]
            units = letters if rng.random() < 0.4 else [rng.choice("abt") for _ in range(rng.randint(0, 6))]
            got, ways = best(letters, units), []
            for sizes in product(range(4), repeat=len(letters)):
                if sum(sizes) == len(units):
                    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
                    ways.append([("".join(units[e - n : e])) for n, e in zip(sizes, ends, strict=True)])
            score = lambda w: sum(table.get(z, -12.0) for z in zip(letters, w, strict=True))  # noqa: B023, E731
            assert (got is None) == (not ways) and (got is None or abs(score(got) - max(map(score, ways))) < 1e-9)
