import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from phonolake.operators import kernels as K
from phonolake.operators import lookup as L
from phonolake.operators import sequence as Q
from phonolake.plans import chinese, english, espeak, japanese, seed
from phonolake.queries import pipelines


@pytest.fixture(scope="module")
def reader(spark):
    return english.English(*english.lexicon_tables(seed.lexicon(spark)))


@pytest.mark.parametrize(
    "text, want",
    [
        ("the apple", "ði ˈæpᵊl"),
        ("the walk", "ðə wˈɔk"),
        ("walked to the world.", "wˈɔkt tə ðə wˈɜɹld."),
        ("[zebra](/zˈibɹə/)!", "zˈibɹə!"),
        ("[apple](-2)", "æpᵊl"),
        ("$5", "fˈIv dˈɑləɹz"),
        ("1984", "nIntˈin ˈATi fˈɔɹ"),
        ("NASA", "ˌɛnˌAˌɛsˈA"),
        ("xyzzy", "❓"),
        ("[New York](/nujˈɔɹk/) walk", "nujˈɔɹk wˈɔk"),
    ],
)
def test_english(reader, text, want):
    assert reader(text)[0] == want.replace("ATi", "Ati")


def test_english_plan_with_a_trained_tagger(spark):
    lexicon = spark.createDataFrame([("gold", "read", {"DEFAULT": "ɹˈid", "VBD": "ɹˈɛd"}), ("gold", "we", {"DEFAULT": "wi"})], "tier string, word string, ps map<string,string>")
    weights = spark.createDataFrame([("w=read", "VBD", 5), ("w=read", "VB", 2), ("t1=TO", "VB", 9), ("b", "NN", 1)], "feature string, tag string, w int")
    docs = spark.createDataFrame([(1, "we read"), (2, None)], "doc_id long, text string")
    plain, tagged = english.phonemize(docs, lexicon), english.phonemize(docs, lexicon, weights=weights, known={"we": "PRP"})
    of = lambda df: {r["doc_id"]: r["phonemes"] for r in df.collect()}
    assert of(plain) == {1: "wi ɹˈid", 2: None} and of(tagged) == {1: "wi ɹˈɛd", 2: None}
    tagger = english.trained_tagger(weights, {"we": "PRP"})
    assert tagger(["we", "read"]) == ["PRP", "VBD"] and tagger(["rock"]) == ["NN"]


def test_english_plan(spark):
    rows = english.phonemize(spark.createDataFrame([(1, "the apple"), (2, None), (3, "")], "doc_id long, text string"), seed.lexicon(spark)).orderBy("doc_id").collect()
    assert [r["phonemes"] for r in rows] == ["ði ˈæpᵊl", None, ""] and rows[0]["n_unknown"] == 0 and rows[0]["min_rating"] == 4


def test_added_words(spark):
    e = english.English({}, {})
    e.add_words({"sonata": "sənˈɑtə"})
    assert e("Sonata sonata")[0] == "sənˈɑtə sənˈɑtə"


def test_tokenizer_round_trip():
    cut = K.AffixTokenizer()
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice(["don't", " ", "  ", "(", ")", "a.m.", "word", ",", ".", "\n", "U.S.", "x/y", "!"]) for _ in range(rng.randint(0, 12)))
        got = cut(text)
        assert "".join(t + ws for t, ws in got).lstrip(" ") == text.lstrip(" ") or text.startswith(" ")


def test_best_split_by_force():
    words = {"a": -1.0, "b": -1.5, "ab": -2.0, "abc": -2.4, "c": -1.1, "bc": -1.2}
    for text in map("".join, itertools.product("abc", repeat=5)):
        cost = lambda cut: sum(words.get(w, 0.0) - 3.0 for w in cut)
        cuts = [[text[i:j] for i, j in itertools.pairwise([0, *c, 5])] for n in range(5) for c in itertools.combinations(range(1, 5), n)]
        best = max(cost(c) for c in cuts if all(len(w) == 1 or w in words for w in c))
        assert math.isclose(cost(K.best_split(text, words, 3.0, 3, True)), best)


def test_lattice_by_force():
    lattice = pipelines.kana_lattice()
    got = lattice("こんにちは日本さん")
    assert [g[0] for g in got] == ["こんにちは", "日本", "さん"] and "".join(g[0] for g in lattice("東京は ABC")) == "東京はABC"


def test_hmm_by_force():
    start, trans = {"B": -0.5, "S": -1.0}, {(a, b): -0.1 * i for i, (a, b) in enumerate(("BE", "BM", "MM", "ME", "EB", "ES", "SB", "SS"))}
    emit = {(s, c): -((hash_(s + c) % 7) / 3) for s in "BEMS" for c in "xyz"}
    model = K.Hmm(start, trans, emit, ends=("E", "S"))
    for text in ("xyzzy", "yy", "zxyx"):
        cost = lambda p: start.get(p[0], K.Hmm.FLOOR) + sum(emit[s, c] for s, c in zip(p, text, strict=True)) + sum(trans.get(x, -math.inf) for x in itertools.pairwise(p))  # noqa: B023, E731
        best = max(cost(p) for p in itertools.product("BEMS", repeat=len(text)) if p[-1] in "ES")
        assert math.isclose(cost(tuple(model(text))), best)


def hash_(s):
    return sum(ord(c) * 31**i for i, c in enumerate(s))


def test_mandarin():
    cut = chinese.segmenter({"你好": (10, "l"), "小": (3, "a"), "老虎": (5, "n")}, 100.0)
    sounds = {"ni3": ("n", "i3"), "hao3": ("h", "ao3"), "xiao3": ("x", "iao3"), "lao3": ("l", "ao3"), "hu3": ("h", "u3")}
    reader = chinese.Mandarin(cut, cut.for_search, {"你": ["ni3"], "好": ["hao3"], "小": ["xiao3"], "老": ["lao3"], "虎": ["hu3"]}, sounds)
    assert reader("你好").endswith("ㄏㄠ3") and reader.pinyin("你好") == (["n", "h"], ["i3", "ao3"])
    assert reader.sandhi("老虎", "n", ["ao3", "u3"]) == ["ao2", "u3"] and reader("") == "" and reader("abc") == "❓"
    old = chinese.LegacyMandarin({"你好": -1.0}, 3.0, {"你": ["ni3"], "好": ["hao3"]}, {"ni3": "ni↓", "hao3": "xau↓"})
    assert old("你好") == "ni↓xau↓"


def mandarin():
    cut = chinese.segmenter({w: (5.0, "n") for w in ("老虎", "纸", "蒙古", "包", "朋友", "东西")}, 100.0)
    return chinese.Mandarin(cut, cut.for_search, {}, {})


@pytest.mark.parametrize(
    "word, pos, tones, want",
    [
        ("看不懂", "v", "443", "453"), ("不怕", "d", "44", "24"), ("不好", "d", "43", "43"),  # 不
        ("看一看", "v", "414", "454"), ("第一", "m", "41", "41"), ("一样", "m", "14", "24"), ("一天", "m", "11", "41"), ("一二", "m", "14", "14"), ("一，", "m", "10", "10"),  # 一
        ("人人", "n", "22", "22"), ("妈妈", "n", "11", "15"), ("来吧", "v", "21", "25"), ("我们", "r", "32", "35"), ("桌上", "s", "14", "15"), ("桌上", "n", "14", "14"), ("进来", "v", "42", "45"), ("了", "ul", "3", "5"),
        ("几个", "m", "34", "35"), ("个", "q", "4", "5"), ("老朋友", "n", "323", "325"), ("老虎", "n", "33", "23"),
        ("蒙古包", "n", "331", "231"), ("纸老虎", "n", "333", "323"), ("老虎纸", "n", "333", "223"), ("好老虎", "n", "333", "323"), ("好东西", "n", "311", "315"), ("想买什么", "v", "3325", "2325"), ("老虎老虎", "v", "3333", "2323"),
    ],
)
def test_sandhi(word, pos, tones, want):
    assert "".join(f[-1] for f in mandarin().sandhi(word, pos, ["a" + t for t in tones])) == want


def test_glued():
    m = mandarin()
    m.phrases, m.syllables = {"好": ["好"], "老虎": ["老", "虎"]}, {"好": ("h", "ao3"), "老": ("l", "ao3"), "虎": ("h", "u3")}
    assert m.glued([("不", "d"), ("去", "v")]) == [("不去", "v")] and m.glued([("去", "v"), ("不", "d")]) == [("去", "v"), ("不", "d")]
    assert m.glued([("看", "v"), ("一", "m"), ("看", "v")]) == [("看一看", "v")] and m.glued([("一", "m"), ("天", "n")]) == [("一天", "m")]
    assert m.glued([("天", "n"), ("天", "n"), ("花", "n"), ("儿", "n")]) == [("天天", "n"), ("花儿", "n")]
    assert m.glued([("好", "a"), ("老虎", "n"), ("好", "a")]) == [("好老虎", "a"), ("好", "a")] and m.glued([]) == []


def test_softened():
    parts = lambda *ps: [english.Token(text=f"w{i}", tag="NN", ws="", ps=p) for i, p in enumerate(ps)]
    assert [t.ps for t in english.softened(parts("ˈa", "ˈb", "ˈcd"))] == ["ˈa"] and english.softened(parts("ˈa", "b", "c")) == []


def test_kana_by_neighbours():
    got = [japanese.kana_phonemes(t) for t in ("きゃ", "さゝ", "かゞ", "らーめん", "かった", "さんぽ", "ほんや", "ぁ", "x", "")]
    assert got == ["kʲa", "saさ", "kaɡa", "ɾaːmeɴ", "kaʔta", "sampo", "hoɴja", "", "", ""]


def test_compounds():
    assert espeak.compound("in", "ɪn", "ɑ", False) == "ɪn" and espeak.compound("cat", "kat", "ɑ", False) == "kaɾ" and espeak.compound("for", "fɔː", "ɑ", True) == "fɔːɹ"


def test_japanese():
    assert japanese.kana_phonemes("こんに") == "koɲɲi" and japanese.kata_to_hira("コンピューター") == "こんぴゅーたー"
    assert japanese.Japanese(pipelines.kana_lattice())("こんにちは") == "koɲɲiʨiha"


def test_replay():
    r = espeak.Replay({"los": espeak.Entry("los", "los", "", "", -1, ("1|z",)), "tipo": espeak.Entry("tipo", "tipo", "", "1|d", 0, ())})
    assert r("los tipo") == "loz dipo" and espeak.spoken("Los, tipo!", r) == "los, tipo!"
    assert pipelines._letters().form("cena") == "sˈena"


def test_joined_boundaries_is_the_kernel(spark):
    entries = "array<struct<form:string,o_nasal:string,o_len:string,ctx:int,tails:array<string>>>"
    df = spark.createDataFrame([([("los", "", "", -1, ["1|z"]), ("tipo", "", "1|d", 0, [])],), ([],)], f"e {entries}")
    assert [r["x"] for r in df.select(Q.joined_boundaries(F.col("e")).alias("x")).collect()] == [["loz", "dipo"], []]


def test_longest_prefix(spark):
    words = F.array(F.lit("ab"), F.lit("abc"), F.lit("cd"))
    got = spark.createDataFrame([("abcd",), ("xab",), ("",)], "t string").select(L.longest_prefix_cut(F.col("t"), words, 3).alias("x")).collect()
    assert [r["x"] for r in got] == [["abc", "d"], ["x", "ab"], []]


def test_hindi():
    h = espeak.HindiWords({"क": ("a", "b", "c"), "।": ("d", "", "")}, {("ND", n): str(n) for n in range(10)} | {("N", n): f"n{n}" for n in range(100)})
    assert h.read("क") == ("a", False) and h.read("क क") == ("b c", False) and h.read("। ख") == ("d", True) and h("१२") == "n12"


def test_cardinals_of_all_keys(spark, tmp_path):
    from phonolake import queries
    from phonolake.functions import numbers as N

    keys = [0, 7, 999_999, 1_000_000, 1_000_001, 2_345_678, 6_000_000_000]
    spark.createDataFrame([(k,) for k in keys * 2], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = queries.QUERIES["cardinal_english"](spark, str(tmp_path)).collect()
    assert sorted((r["n"], r["words"]) for r in got) == [(k, N.cardinal(k)) for k in keys]


def test_factors_of_the_whole_matrix(spark, sf_dir):
    import numpy as np

    from phonolake import queries
    from phonolake.operators.kernels import low_rank

    x = np.array([r["embedding"] for r in queries.table(spark, sf_dir, "embeddings").collect()], np.float64)
    a, b, row, col, grand = low_rank(x, 16)
    want = ((x - (a @ b.T + row[:, None] + col[None, :] - grand)) ** 2).sum() / (x**2).sum()
    got = queries.QUERIES["matrix_factors"](spark, sf_dir).first()
    assert got["n"] == len(x) > 50 and abs(got["rest"] - want) < 2e-6


def test_kana_column_is_the_kernel(spark):
    """as an expression it took milliseconds a row, and knew no iteration marks."""
    texts = ["きゃ", "さゝ", "かゞ", "らーめん", "かった", "さんぽ", "ほんや", "ぁ", "x", "", None, "きゃゅ", "んっゃ", "さんぽ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = {r["i"]: r["x"] for r in df.select("i", japanese.kana_column(F.col("t")).alias("x")).collect()}
    assert got == {i: None if t is None else japanese.kana_phonemes(t) for i, t in enumerate(texts)}


class Asked(frozenset):
    asked = 0

    def __contains__(self, x):
        Asked.asked += 1
        return super().__contains__(x)


def test_long_japanese_texts_take_steps_by_their_length():
    """words were looked for in every stretch of a run, connections from every way to a place."""
    lattice, costs = pipelines.kana_lattice(), []
    lattice.unknown = {k: [(a, b, 5000 + a) for a in range(3) for b in range(3)] for k in lattice.unknown}
    lattice.cost = lambda a, b: costs.append(1) or abs(a - b)
    words = Asked(["ここ"])
    japanese.Japanese(lattice, words)("ここ" * 500)
    assert len(costs) <= 1000 * 9 + 3 and Asked.asked <= 2 * 1000


def plain_path(lattice, text):
    """All ways to each place, latest first, and all connections."""
    space = lattice.category(" ")[1]
    reached = [[(0, 0, None, None)], *([] for _ in text)]
    for at in range(len(text)):
        begin = at
        while begin < len(text) and lattice.category(text[begin])[1] & space:
            begin += 1
        if begin == len(text) or not reached[at]:
            continue
        for n, left, right, cost, reading, unknown in lattice._nodes(text[begin:]):
            best, _, came = min((w[0] + lattice.cost(w[1], left) + cost, i, w) for i, w in enumerate(reached[at]))
            reached[begin + n].insert(0, (best, right, (begin, begin + n, reading, unknown), came))
    last = max(i for i, r in enumerate(reached) if r)
    way, out = min((w[0] + lattice.cost(w[1], 0), i, w) for i, w in enumerate(reached[last]))[2], []
    while way[2]:
        begin, end, reading, unknown = way[2]
        out.append((text[begin:end], reading, lattice.category(text[begin])[0], unknown))
        way = way[3]
    return out[::-1]


@pytest.mark.parametrize("cost", [lambda a, b: 0, lambda a, b: (7 * a + 13 * b) % 5, pipelines.kana_cost])
def test_lattice_is_the_plain_search(cost):
    rng = random.Random(5)
    lexicon = {"こ": [(1, 2, 100, "コ"), (2, 1, 100, "ゴ")], "ん": [(3, 1, 50, "ン")], "こん": [(2, 2, 150, "コン")], "日本": [(1, 1, 9, "ニホン")]}
    lattice = K.Lattice(lexicon, pipelines.kana_category, {k: [(0, 0, 500), (1, 2, 500), (2, 1, 400)] for k in (1, 2, 3, 5, 6, 7)}, cost)
    for _ in range(300):
        text = "".join(rng.choice(["こ", "ん", "日", "本", "ア", "アアアアアアアアアアアアア", " ", "  ", "、", "a", "1", "っ"]) for _ in range(rng.randint(1, 16)))
        assert lattice(text) == plain_path(lattice, text), text


def test_token_counts_hold_few_rows_at_once():
    """the tokens of a whole batch were held, so a worker's memory followed the batches."""
    import pyarrow as pa

    texts = ["It's (here), don't.", "", " a  b\n", "word " * 300, "a.m. at U.S. x/y"] * 1000
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    got, cut = list(pipelines.token_counts(iter([batch]))), K.AffixTokenizer()
    assert max(b.num_rows for b in got) <= 512 and sum(b.num_rows for b in got) == len(texts)
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(len(texts))) and [r["n_tokens"] for r in rows[:5]] == [len(cut(t)) for t in texts[:5]]
    assert [r["round_trip"] for r in rows[:5]] == ["".join(t + ws for t, ws in cut(t)) == t for t in texts[:5]]


def test_replay_without_a_join(spark, sf_dir):
    """each distinct chunk was read once and joined back, though nearly all are distinct."""
    from phonolake import queries

    docs = spark.createDataFrame([(1, "Los, tipo (de la) casa!"), (2, None), (3, ""), (4, "«cena», y… los 12 perros; "), (5, "!?"), (6, "que que que, el - la.")], "doc_id long, text string")
    replay = pipelines._replay("es")
    chunks = docs.select(F.explode(pipelines.T.chunks(pipelines.T.espeak_disguise(F.col("text")))).alias("chunk"))
    of = lambda df: {r["doc_id"]: r["phonemes"] for r in df.collect()}
    assert of(espeak.replayed(docs, replay)) == of(espeak.phonemize(docs, espeak.read_chunks(chunks, replay)))
    assert "Join" not in queries.QUERIES["phonemize_spanish"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_mandarin_words_are_read_once():
    """F8: the tones of each word were made from its syllables wherever it met another."""
    m, asked = mandarin(), []
    m.phrases, m.syllables = {"老": ["老"], "虎": ["虎"], "纸": ["纸"]}, {"老": ("l", "ao3"), "虎": ("h", "u3"), "纸": ("zh", "i3")}
    plain = m.pinyin
    m.pinyin = lambda w: asked.append(w) or plain(w)
    once = m("老虎纸，老虎纸")
    assert m("，".join(["老虎纸"] * 40)).startswith(once) and len(asked) <= 4 * len(set(asked)) < 40


def test_english_tokens_are_cut_once_and_few_results_kept(reader, monkeypatch):
    """each token was cut and tagged again, and results of words of any length were kept."""
    text = "hello world, walked zyxq " * 200
    fresh, cuts = english.English(reader.gold, reader.silver), []

    class Counted:
        def finditer(self, text):
            cuts.append(text)
            return reader.subtokens.finditer(text)

    fresh.subtokens = Counted()
    assert fresh(text) == reader(text) and len(cuts) == len(set(cuts)) == 5
    monkeypatch.setattr(english, "RESULTS", 10)
    few = english.English(reader.gold, reader.silver)
    many = " ".join(f"{a}{b}" for a in "abcdefg" for b in "hijklmn") + " " + "x" * 500
    assert few(many) == reader(many) and len(few.kept) <= 10 and all(len(k[0]) <= english.SHORT for k in few.kept)
