import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from phonolake.llm import components, linededup, simhash
from phonolake.llm.common import table


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    f, lab = np.array(fps, np.uint64), list(range(len(fps)))

    def find(x):
        while lab[x] != x:
            x = lab[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 2) + i + 1:
            a, b = find(i), find(int(j))
            lab[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def test_same_as_force(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    fps = [slow_fingerprint(r["text"]) for r in rows]
    comps = slow_components(fps)
    least = {c: min(rows[i]["doc_id"] for i in range(len(rows)) if comps[i] == c) for c in set(comps)}
    want = sorted((r["doc_id"], f, least[c]) for r, f, c in zip(rows, fps, comps, strict=True))
    got = simhash.near_duplicates(table(spark, sf_dir, "documents")).collect()
    assert sorted((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want


def planted():
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 800, dtype=np.uint64)]
    near = [b ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))) for b in base[:200]]
    chain = [0]
    for k in range(100):
        chain.append(chain[-1] ^ (1 << (k % 63)))
    ball = [base[5] ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)]
    return sorted({*base, *near, *chain, *ball})


@pytest.mark.parametrize("way", ["tree", "midpoints"])
def test_leaves_and_components(spark, monkeypatch, way):
    fps = planted()
    monkeypatch.setattr(simhash, "PAIRS", 32)
    if way == "midpoints":
        monkeypatch.setattr(simhash, "_cut", lambda *a, **k: None)
    else:
        monkeypatch.setattr(simhash, "LEAF", 100)
    stars = simhash.links(spark.createDataFrame([(t, x) for x in fps for t in (0, 3)], "t int, fp long").repartition(3))
    root = {r["vertex"]: r["root"] for r in components.components(stars.filter("t = 3")).collect()}
    assert [root.get(x, x) for x in fps] == [fps[c] for c in slow_components(fps)]


def test_components_of_chains_and_nulls(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 99), (99, 98), (7, 7), (None, 3), (5, None)]
    got = {r["vertex"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 98: 98, 99: 98, 100: 98}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_more_tables_link_more(spark):
    rng = np.random.default_rng(4)
    base = [[f"w{x}" for x in rng.integers(0, 5000, 200)] for _ in range(30)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):  # a copy with one word changed, and an exact one
        c = list(b)
        c[int(rng.integers(200))] = "changed"
        rows += [(100 + i, " ".join(c)), (200 + i, " ".join(b))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [simhash.one_of_each(docs, tables=k).count() for k in (1, 7)]
    got = simhash.near_duplicates(docs, tables=7).collect()
    assert 30 <= left[1] <= left[0] <= 60 and left[1] <= 35
    assert all(r["component_id"] in (r["doc_id"] % 100, r["doc_id"] % 100 + 100) for r in got) and {r["component_id"] for r in got if r["doc_id"] < 100} == set(range(30))


def similarity(x, y):
    a, b = (set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in (x, y))
    return len(a & b) / len(a | b)


def test_pipeline_links_from_four_fifths_on(spark):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    rows, gone, kept = [], set(), set()
    for i in range(400):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        other = list(words)
        for at in rng.choice(200, 1 + i % 9, replace=False):
            other[at] = "changed"
        rows += [(i, " ".join(words)), (1000 + i, " ".join(other))]
        (gone if similarity(rows[-1][1], rows[-2][1]) >= 0.8 else kept).add(1000 + i)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert min(len(gone), len(kept)) > 100 and len(gone & left) <= 2 and kept <= left and set(range(400)) <= left


def test_similar_chains_and_odd_rows(spark, odd_docs, clashing_docs, no_docs):
    words = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join([f"x{i}" for i in range(4 * k)] + words[4 * k :])) for k in range(12)]  # each like the next only
    docs = spark.createDataFrame([*rows, (50, " ".join(words[::-1])), (51, " ".join(words[:50]))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.one_of_similar(docs).collect()) == [0, 50, 51]
    got = simhash.one_of_similar(clashing_docs, tables=7)
    assert got.columns == clashing_docs.columns and sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None) == [0, 3, 4, 6, 7, 8, 9, 10]
    assert simhash.one_of_similar(no_docs).count() == 0


def test_odd_rows(odd_docs, clashing_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r["component_id"], set()).add(r["doc_id"])
    assert by[0] == {0, 1, 2} and by[4] == {4, 5} and by[None] == {None}
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.one_of_each(clashing_docs, tables=7).count() == len(by) and simhash.one_of_each(no_docs, tables=7).count() == 0
    kept = simhash.one_of_each(clashing_docs)
    assert kept.columns == clashing_docs.columns and kept.count() == len(by) == simhash.one_of_each(odd_docs).count()


PAGES = [(i, f"http://User@Big.example:80/p{i}", f"<html><script>var x='<p>';</script><nav>Menu</nav><p>Body {i}</p><br>Menu<!-- c --></html>") for i in range(10)]


def test_site_lines(spark):
    pages = spark.createDataFrame([*PAGES, (10, "http://small.example/", "<p>Menu</p>"), (11, None, None), (12, "no url", ""), PAGES[0]], "page_id long, url string, html string")
    rows = pages.withColumn("host", linededup.host_of(F.col("url"))).withColumn("text", linededup.visible_text(F.col("html")))
    got = {(r["page_id"], r["host"]): r for r in linededup.drop_boilerplate(rows, F.col("host"), F.col("text"), "kept", counts=("n_lines", "n_dropped")).collect()}
    assert got[3, "big.example"]["kept"].split() == ["Body", "3"] and got[3, "big.example"]["n_dropped"] == 2
    assert "Menu" in got[10, "small.example"]["kept"] and got[11, None]["kept"] is None and got[12, None]["kept"] == ""


def test_copies_stay_whole(spark):
    rows = [(i, "s", "same line here\nanother same line") for i in range(6)] + [(10 + i, "s", f"same line here\nown words of {i}\nand more own words of {i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: r["k"] for r in linededup.drop_boilerplate(docs, F.col("source"), F.col("text"), "k", 0.3, most=0.5).collect()}
    assert got[0] == rows[0][2] and got[10] == "own words of 0\nand more own words of 0"


def test_pipeline_cleans_pages_that_are_mostly_boilerplate(spark):
    import corpus_pipeline

    passage, chinese = "the same long passage of many words " * 4, "这是一段在许多文件中重复出现的文字"
    rows = [(i, f"{passage}\nown {i}\n{chinese}\nAccept all", "s") for i in range(8)] + [(20 + i, "a whole copy of some page\nwith its second line", "s") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    assert [got[i] for i in range(8)] == [f"own {i}" for i in range(8)] and got[20] == rows[8][1]


def test_lines_of_odd_rows(odd_docs, clashing_docs, no_docs):
    for docs in (odd_docs, clashing_docs, no_docs):
        out = linededup.drop_boilerplate(docs, F.col("source"), F.col("text"), "kept")
        assert out.columns == [*docs.columns, "kept"]
        with pytest.raises(ValueError):
            linededup.drop_boilerplate(docs, F.col("source"), F.col("text"), "text")
        assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)


def test_site_lines_sql(spark, sf_dir):
    from oracle import connect, rows

    from phonolake.llm import queries

    for name, sql in queries.ORACLE_SQL.items():
        assert rows(queries.QUERIES[name](spark, sf_dir).toPandas()) == rows(connect(sf_dir).execute(sql).df()), name
