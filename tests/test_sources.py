import gzip

from phonolake.operators import kernels as K
from phonolake.sources import resources as R
from phonolake.streaming import counts


def test_lexicon(spark, tmp_path):
    with gzip.open(tmp_path / "lex.tsv.gz", "wt") as f:
        f.write("# made for a test\n##GOLD\nthe\tðə\nused\tDEFAULT=jˈuzd\tVBD=jˈust\tNone=\n##SILVER\nfoo\tfˈu\n")
    got = {r["word"]: r for r in R.lexicon(spark, str(tmp_path / "lex.tsv.gz"), "us").collect()}
    assert got["the"]["tier"] == "gold" and got["the"]["ps"] == {"DEFAULT": "ðə"} and got["foo"]["tier"] == "silver"
    assert got["used"]["ps"] == {"DEFAULT": "jˈuzd", "VBD": "jˈust", "None": None}


def test_signs(spark, tmp_path):
    (tmp_path / "zh.tsv").write_text("@@\t100\n#ni3\tn,i3\n@你好\t5 l\n你\tni3\n")
    got = R.by_sign(spark, str(tmp_path / "zh.tsv"))
    assert got["total"].first()[0] == 100 and tuple(got["syllable"].first()) == ("ni3", "n", "i3") and tuple(got["word"].first()) == ("你好", 5.0, "l") and got["phrase"].first()["syllables"] == ["ni3"]


def test_replay(spark, tmp_path):
    (tmp_path / "es.tsv").write_text("hola\tola\t=\t\t\t\ncasa\tkasa\tkˈasa\t0|n\t\t1\t1|z\n##BIGRAMS\na\tb\t1|\t\t\t\n##LTS 0,1;0,0\nS\t0\tca\tka\nT\t2\t-1\tsa\t.ˈ\n")
    got = R.replay(spark, str(tmp_path / "es.tsv"), "es")
    words = {r["word"]: r for r in got["word"].collect()}
    assert words["hola"]["init"] == "ola" and words["casa"]["ctx"] == 1 and words["casa"]["tails"] == ["1|z"] and got["pair"].count() == 1 and got["segment"].first()["chunk"] == "ka"


def test_table_round_trip(spark, tmp_path):
    rows = [("a\tb", "c\\n"), ("d\ne", "\\\\t"), ("", "x")]
    R.write_table(spark.createDataFrame(rows, "k string, v string"), str(tmp_path / "t"), ["k"])
    assert sorted(map(tuple, R.read_table(spark, str(tmp_path / "t"), "k string, v string").collect())) == sorted(rows)


def test_binary_models(spark, tmp_path):
    w = {"a=b": {"NN": 3, "VB": -200}, "c": {"NN": 70000}}
    (tmp_path / "m.bin").write_bytes(R.pack_weights(w))
    assert R.unpack_weights(R.pack_weights(w)) == w and R.weights(spark, str(tmp_path / "m.bin")).count() == 3
    m = R.unpack_matrix(R.pack_matrix([[1, 2], [3, 4]], [[5, 6], [7, 8]], [0, 1], 1, [10, 20], [1, 2], 3))
    assert m(0, 0) == ((1 * 5 + 4 * 6 + 1) >> 1) + 10 + 1 - 3 and isinstance(m, K.CompactMatrix)


def test_streaming_counts(spark, tmp_path):
    data = spark.sql("SELECT 'a b a' AS text, timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT 'b', timestamp'2024-01-01 00:01:00'")
    data.write.parquet(str(tmp_path / "in"))
    stream = counts.word_counts(counts.texts(spark, str(tmp_path / "in"), "text string, ts timestamp"), "text", "ts")
    counts.finish(stream, "word_counts", "complete", f"file://{tmp_path}/cp")
    assert {r["word"]: r["n"] for r in spark.table("word_counts").collect()} == {"a": 2, "b": 2}
