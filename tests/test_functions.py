import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phonolake.functions import numbers as N
from phonolake.functions import phonemes as P
from phonolake.functions import text as T


@pytest.mark.parametrize(
    "ps, stress, want",
    [("hˈɛlO", -2.0, "hɛlO"), ("hˈɛlO", -1.0, "hˌɛlO"), ("kæt", 0.5, "kˌæt"), ("kæt", 2.0, "kˈæt"), ("hˌɛlO", 1.0, "hˈɛlO"), ("kˈæt", None, "kˈæt"), ("tst", 2.0, "tst")],
)
def test_stress(spark, ps, stress, want):
    assert P.apply_stress(ps, stress) == want
    row = spark.createDataFrame([(ps, stress)], "ps string, s double").select(T.apply_stress(F.col("ps"), F.col("s")).alias("x")).first()
    assert row["x"] == want


@pytest.mark.parametrize("ps, us, gb", [("kˈæt", "kˈæts", "kˈæts"), ("dˈɔɡ", "dˈɔɡz", "dˈɔɡz"), ("bˈʌs", "bˈʌsᵻz", "bˈʌsɪz")])
def test_plural(ps, us, gb):
    assert (P.append_s(ps, False), P.append_s(ps, True)) == (us, gb)


def test_past_and_progressive():
    assert [P.append_ed(x, False) for x in ("wˈɔk", "wˈAt")] == ["wˈɔkt", "wˈAɾᵻd"]
    assert P.append_ing("wˈAt", False) == "wˈAɾɪŋ" and P.append_ing("kˈɑː", True) is None


@pytest.mark.parametrize("n, want", [(1234, "one thousand, two hundred and thirty-four"), (0, "zero"), (100, "one hundred"), (1000005, "one million and five"), (21, "twenty-one"), (-5, "minus five")])
def test_cardinal(n, want):
    assert N.cardinal(n) == want


def test_other_english_readings():
    assert N.ordinal(21) == "twenty-first" and N.ordinal(30) == "thirtieth" and N.ordinal(100) == "one hundredth"
    assert [N.year(y) for y in (1984, 1905, 1900, 2000, 2005, 2010)] == ["nineteen eighty-four", "nineteen oh-five", "nineteen hundred", "two thousand", "two thousand and five", "twenty ten"]
    assert N.decimal(3.14) == "three point one four" and N.decimal(5.0) == "five"
    assert N.replay_words(105) == ["one", "hundred", "five"] and N.replay_words(105, True) == ["one", "hundred", "and", "five"]
    with pytest.raises(OverflowError):
        N.cardinal(10**400)


def test_mandarin_readings():
    assert [N.hanzi_integer(x) for x in ("10", "105", "10000")] == ["十", "一百零五", "一万"]
    assert N.hanzi_numbers("8% 1/2 3-5米 25℃ 2024年3月14日") == "百分之八 二分之一 三到五米 二十五摄氏度 二零二四年三月十四日"
    assert N.hanzi_numbers_legacy("114和2024年") == "一百一十四和二零二四年"
    assert N.hanzi_integer("1" * 17) is None


def test_kana_readings():
    got = [N.kana_number(x) for x in "10 300 1000 1001 2024 8000 10000 12345".split()]
    assert got == ["じゅう", "さんびゃく", "せん", "せんいち", "にせんにじゅうよん", "はっせん", "いちまん", "いちまんにせんさんびゃくよんじゅうご"]
    assert N.kana_number("1" * 10) == N.KANA_TOO_LONG


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 999_999))
def test_cardinal_reads_back(n):
    """A plain parser of the words gives the number back."""
    value = {w: i for i, w in enumerate(N.ONES)} | {w: 20 + 10 * i for i, w in enumerate(N.TENS)}
    total = part = 0
    for w in N.cardinal(n).replace("-", " ").replace(",", "").split():
        if w == "hundred":
            part *= 100
        elif w == "thousand":
            total, part = part * 1000, 0
        elif w != "and":
            part += value[w]
    assert total + part == n


@settings(max_examples=200, deadline=None)
@given(st.text("ab,.!? «»()", max_size=30))
def test_marks_come_back(line):
    chunks, marks = P.preserve(line)
    lines = P.restore(chunks, marks)
    if len(lines) == 1:
        assert lines[0].rstrip() == line.rstrip()


def test_preserve():
    assert P.preserve("Hola, mundo!") == (["Hola", "mundo"], [(", ", "I"), ("!", "E")])
    assert P.restore(["Hola", "mundo"], [(", ", "I"), ("!", "E")]) == ["Hola, mundo! "]


def test_words(spark):
    words = ["NASA", "iPhone7", "COVID-19", "the", "sonata", "Sonata", "SoNa", "a"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.shape(F.col("w")).alias("s"), T.normalized(F.col("w")).alias("n"), T.grow_variant(F.col("w")).alias("v"), T.subtokens(F.col("w")).alias("t"))
    got = {r["w"]: r for r in df.collect()}
    assert [got[w]["s"] for w in words[:4]] == ["UF", "D", "UFDH", "-"]
    assert got["iPhone7"]["n"] == "iphone0" and got["iPhone7"]["t"] == ["i", "Phone", "7"]
    assert [got[w]["v"] for w in words[4:]] == ["Sonata", "sonata", None, None]


def test_derived_deltas_make_the_variant(spark):
    pairs = [("kat", "kat"), ("kat", "kad"), ("kat", "bat"), ("", "a"), ("a", ""), ("aa", "aaa"), ("aaa", "aa"), ("a|b", "c|b"), ("日本", "日x本"), ("ab", "ba"), ("x\ny", "x\nz"), (None, "a"), ("😀a", "😀b")]
    w, v = F.col("w"), F.col("v")
    rows = spark.createDataFrame(pairs, "w string, v string").select("w", "v", T.head_delta(w, v).alias("h"), T.tail_delta(w, v).alias("t"))
    for r in rows.select("*", T.apply_head(w, F.col("h")).alias("headed"), T.apply_tail(w, F.col("t")).alias("tailed")).collect():
        assert r["headed"] == r["tailed"] == (None if r["w"] is None else r["v"]), r
    assert [(r["h"], r["t"]) for r in rows.collect()][:3] == [("", ""), ("3|kad", "1|d"), ("1|b", "3|bat")]


def test_prose_sentences_equal_a_walk_over_tokens(spark):
    import random
    import re

    rng = random.Random(3)
    tokens = ["Mr.", "(Dr.", "St.", "etc.", "J.", "“K.", "end.", "end.”", "Why?!", "no", "No.", "the", "The", "3", "“Yes", "(so", "it…", "e.g.", "NO.", "x!)", "Ms..", "ß", "É."]
    rows = [[rng.choice(tokens) for _ in range(rng.randint(1, 14))] for _ in range(400)]

    def plain(row):
        out, now = [], []
        for t, following in zip(row, [*row[1:], ""], strict=True):
            now.append(t)
            m = re.fullmatch(r"""(.*?)[.!?…]+['"”’)\]]*""", t)
            stem = m and m[1].lstrip("“\"'‘([")
            opens = following[:1].isupper() or following[:1].isdigit() or (following and following[0] in "“\"'‘([")
            if m and opens and stem.lower() not in T.ABBREVIATIONS.split() and not (len(stem) == 1 and stem.isupper()):
                out.append(" ".join(now))
                now = []
        return out + [" ".join(now)] * bool(now)

    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)] + [(-1, None), (-2, ""), (-3, " \n")], "i int, t string")
    got = {r["i"]: r["s"] for r in docs.select("i", T.prose_sentences(F.col("t")).alias("s")).collect()}
    assert (got[-1], got[-2], got[-3]) == (None, [], [])
    for i, r in enumerate(rows):
        assert got[i] == plain(r)
