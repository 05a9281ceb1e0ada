import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from phonolake.llm import decontam, hnsw, licenses, lmscore, pii, toxicity
from phonolake.llm.common import table

MIDDLE = "/root/testdata/sf0.1"


# -- benchmark passages


def slow_report(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    ws, hit, found = words(text), set(), set()
    for item, t in items:
        own = words(t)
        for w in [own[i : i + 10] for i in range(len(own) - 9)] or ([own] if own else []):
            for i in range(len(ws) - len(w) + 1):
                if ws[i : i + len(w)] == w:
                    hit |= set(range(i, i + len(w)))
                    found.add(str(item))
    return len(ws), len(hit), sorted(found)


@pytest.mark.parametrize("most", [decontam.MOST_BYTES, 1500])
def test_windows_by_force(spark, monkeypatch, most):
    """With all windows sent at once, and in several blocks."""
    monkeypatch.setattr(decontam, "MOST_BYTES", most)
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.choice([0, 2, 3, 9, 10, 14])))) for i in range(8)] + [(8, None), (9, "a b"), (10, "A, b!"), (11, "é Ü a")]
    docs = [(i, " ".join(rng.choice("ABcd") for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(40, None), (41, ""), (3, "a b"), (3, "a b"), (42, "x é Ü A\x00b ü")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(*frames).collect()
    want = sorted((i, *slow_report(t, items)) for i, t in docs)
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got) == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)
    clean = sorted((r["doc_id"], r["text"] or "") for r in decontam.clean(*frames).collect())
    assert clean == sorted((i, t or "") for i, t in docs if not slow_report(t, items)[1])


def test_clean_keeps_columns(spark, odd_docs, clashing_docs, no_docs):
    items = spark.createDataFrame([(1, "cat sat on")], "item_id long, text string")
    for docs in (odd_docs, clashing_docs):
        out = decontam.clean(docs, items)
        assert out.columns == docs.columns and out.count() == docs.count() - 3
    assert decontam.clean(no_docs, items).count() == 0 and decontam.clean(odd_docs, items.limit(0)).count() == odd_docs.count()


# -- toxicity


def test_fold():
    assert toxicity.fold("m0ron, lоser (p4thetic) sc​um 2024 un!! 3.14 $tupid") == " moron loser pathetic scum un stupid "
    assert toxicity.fold(None) == toxicity.fold("") == "  "


def test_held_out_accuracy(spark):
    docs, labels = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "labels")
    rows = toxicity.scored(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    right = [(r["predicted"], r["toxic"]) for r in rows]
    assert sum(a == b for a, b in right) / len(right) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_exceptions_and_length():
    m = toxicity.Model({" bad": 3.0, " worse ": 2.0}, (" bad hair ",), (-1.0, 1.0, 1.0))
    a = m.automaton()
    assert [w for *_, w in toxicity.matches(a, " bad hair ")] == [] and [w for *_, w in toxicity.matches(a, " badly worse ")] == [3.0, 2.0]
    assert toxicity.score(m, a, "bad") > toxicity.score(m, a, "bad " + "fine " * 200)


def test_toxicity_of_odd_rows(spark, odd_docs, clashing_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    for docs in (odd_docs, clashing_docs, no_docs):
        assert toxicity.scored(docs, toxicity.fit(docs, labels)).count() == docs.count()
        assert toxicity.without_toxic(docs, labels.limit(0)).columns == docs.columns
    assert {r["score"] for r in toxicity.scored(odd_docs, toxicity.fit(odd_docs, labels.limit(0))).collect()} == {0.0}


# -- personal data

KINDS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def slow_spans(t):
    out = []
    for k, p in enumerate(KINDS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    rng = random.Random(3)
    parts = [*"0123456789" * 2, *"@@..-+ ()abZ_%é", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 123-4567", "a@b.c"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == slow_spans(t), t


def test_patterns_find_new(spark):
    rows = [(i, f"please call phone: +1 (555) 010-{1000 + i} today") for i in range(30)] + [(100, "please call phone: 555-0199-22 today"), (101, None), (102, "nothing 555-0199-22"), (102, "nothing 555-0199-22")]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100]["spans"] == "phone:19:30" and got[100]["n_phone"] == 0 and got[0]["spans"] == "phone:19:36" and got[102]["n_new"] == 0 and got[101]["spans"] == ""


def planted_rows(n=3000):
    """Documents with identifiers in contexts, and decoys in others: (id, text, kind, begin, end) of what is to be found."""
    rng = random.Random(10)
    words = ["river", "stone", "cloud", "garden", "window", "paper", "light", "green", "table", "train", "of", "the", "a"]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    fresh = [f"555 {digits(3)} {digits(4)}" for _ in range(40)]  # found after one context, they make another one known
    out = []
    for i in range(n):
        lead, kind, value = rng.choice([
            ("my phone:", None, f"+1 (555) {digits(3)}-{digits(4)}"), ("my phone:", None, f"+44 20 {digits(8)}"), ("my phone:", None, f"+49 {digits(10)}"), ("my phone:", None, f"+33 {digits(9)}"),
            ("my phone:", None, f"+1 {digits(10)}"), ("my phone:", "phone", rng.choice(fresh)), ("dial", "phone", rng.choice(fresh)), ("dial", "phone", f"({digits(3)}) {digits(3)}-{digits(4)}") if i % 8 == 0 else ("dial", "phone", rng.choice(fresh)),
            ("write to", None, f"{rng.choice(words)}{digits(3)}@{rng.choice(words)}.org"), ("write to", None, f"{rng.choice(words)}.{digits(2)}@{rng.choice(words)}.net"), ("write to", None, f"x{digits(6)}@mail.com"), ("write to", None, f"y{digits(6)}@mail.com"),
            ("write to", None, f"z{digits(6)}@mail.com"), ("write to", "email", f"{rng.choice(words)}{digits(2)} [at] {rng.choice(words)} [dot] org"),
            ("order", "", digits(16)), ("order", "", f"{digits(4)}-{digits(3)}-{digits(4)}"), ("part", "", f"{digits(3)} {digits(3)} {digits(4)}"),
        ])
        text = f"{prose(6)} {lead} "
        out.append((i, text + value + f" {prose(5)}", kind, len(text), len(text) + len(value)))
    return out


def test_planted_contexts(spark):
    """Of what only contexts give away, nine of ten are found, and nine of ten new spans are right."""
    rows = planted_rows()
    got = pii.personal_data(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    wanted, new, right = 0, 0, 0
    of = {r[0]: r for r in rows}
    for r in got:
        _, text, kind, b, e = of[r["doc_id"]]
        base = pii.listed(pii.base_spans(text)).split(",")
        own = [s for s in r["spans"].split(",") if s and s not in base]
        assert len(own) == r["n_new"] and set(base) - {""} <= set(r["spans"].split(","))
        wanted += bool(kind)
        new += len(own)
        right += bool(kind) and f"{kind}:{b}:{e}" in own
    assert wanted > 400 and right >= 0.9 * wanted and right >= 0.9 * new, (wanted, new, right)


def test_rounds_by_force(spark):
    """Confidences of the graph against plain dictionaries."""
    texts = [r[1] for r in planted_rows(600)]
    found = []
    for t in texts:
        spans = pii.base_spans(t)
        found += [(k, 0, t[b:e].lower(), tuple(pii.before(t, b))) for b, k, e in spans]
        found += [(None, f, t[b:e].lower(), tuple(pii.before(t, b))) for b, e, f in pii.candidates(t, spans)]
    scores, last = {(v, k): 1.0 for k, _, v, _ in found if k is not None}, {}
    seeds = dict(scores)
    strings = {}
    for _, _, v, ps in found:
        for p in ps:
            strings.setdefault(p, set()).add(v)
    for _ in range(pii.ROUNDS):
        now = {}
        for p, vs in strings.items():
            for k in range(4):
                s = [scores[v, k] for v in vs if (v, k) in scores]
                if sum(x >= pii.CONFIDENCE for x in s) >= pii.SEEDS and sum(s) / (len(vs) + pii.SMOOTH) >= pii.CONFIDENCE:
                    now[p, k] = sum(s) / (len(vs) + pii.SMOOTH)
        if len(now) == len(last):
            last = now
            break
        last, scores = now, dict(seeds)
        for kind, f, v, ps in found:
            for p in ps:
                for k in range(4):
                    if kind is None and f >> k & 1 and (p, k) in now:
                        scores[v, k] = max(scores.get((v, k), 0), now[p, k])
    rows = spark.createDataFrame([(k, f, v, list(ps)) for k, f, v, ps in found], "kind int, fits int, value string, patterns array<string>")
    got = {(r["pattern"], r["kind"]): r["confidence"] for r in pii.trusted(rows).collect()}
    assert got.keys() == last.keys() and len(last) > 1 and all(abs(got[x] - last[x]) < 1e-9 for x in last)


def test_candidates_are_linear():
    for t in ("(" * 200_000, "1 " * 200_000, "a" * 200_000 + "1", "a.1" * 100_000, " [at] " * 50_000, "+1(" * 100_000):
        pii.candidates(t, pii.base_spans(t))
    assert pii.candidates("call (555) 123-4567, a9 [at] b [dot] org.", []) == [(5, 19, 8), (21, 40, 1)]


def test_pii_of_odd_rows(odd_docs, clashing_docs, no_docs):
    for docs in (odd_docs, clashing_docs, no_docs):
        assert pii.personal_data(docs).count() == docs.count()


# -- language models


def slow_difference(docs, good):
    """Losses of both models by plain dictionaries."""
    grams = lambda t: [tuple(x) for s in [["", "", *(t or "").lower(), ""]] for x in zip(s, s[1:], s[2:], strict=False)]
    kinds = len({c for _, t in docs for c in (t or "").lower()}) + 1

    def model(texts):
        n = [Counter(g[k:] for t in texts for g in grams(t)) for k in range(3)]

        def p(g):
            k = 3 - len(g)
            if len(g) == 1:
                return (n[2][g] + 1) / (sum(n[2].values()) + kinds)
            own = [c for h, c in n[k].items() if h[:-1] == g[:-1]]
            return (n[k][g] + len(own) * p(g[1:])) / (sum(own) + len(own)) if own else p(g[1:])

        return p

    target, background = model([t for i, t in docs if i in good]), model([t for _, t in docs])
    mean = lambda p, t: sum(-math.log(p(g)) for g in grams(t)) / len(grams(t))
    return sorted((i, len(grams(t)), mean(target, t), mean(background, t)) for i, t in docs)


@pytest.mark.parametrize("most", [lmscore.MOST_BYTES, 0])
def test_difference_by_force(spark, monkeypatch, most):
    """With the losses sent to the documents and with a join; with more characters than the plain array has room for."""
    monkeypatch.setattr(lmscore, "MOST_BYTES", most)
    rng = random.Random(9)
    docs = [(i, "".join(rng.choice("abAB 日本\x00é😀") for _ in range(rng.randint(0, 25)))) for i in range(12)] + [(12, None), (12, None), (13, ""), (14, "".join(map(chr, range(0x4E00, 0x4EC0))))]
    good = spark.createDataFrame([(1,), (2,), (12,), (77,)], "doc_id long")
    got = sorted(tuple(r) for r in lmscore.cross_entropy_difference(spark.createDataFrame(docs, "doc_id long, text string"), good).collect())
    want = slow_difference(docs, {1, 2, 12})
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2:] for g in got], [[*w[2:], w[2] - w[3]] for w in want], atol=1e-5)


def test_difference_tells_quality(spark):
    docs, labels = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "labels")
    got = lmscore.cross_entropy_difference(docs, lmscore.good_ids(labels)).join(labels, "doc_id").filter("crc32(CAST(doc_id AS string)) % 5 = 0").toPandas()
    rank, good = got["score"].rank(), got["quality"] == 1
    auc = 1 - (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.95


def test_both_ways_to_the_target(spark, odd_docs, monkeypatch):
    ids = spark.createDataFrame([(3,), (4,), (None,), (4,)], "doc_id long")
    one = lmscore.cross_entropy_difference(odd_docs, ids).orderBy("doc_id").collect()
    monkeypatch.setattr(lmscore, "MOST_IDS", 1)
    assert lmscore.cross_entropy_difference(odd_docs, ids).orderBy("doc_id").collect() == one


def test_scores_of_odd_rows(spark, odd_docs, clashing_docs, no_docs):
    ids = spark.createDataFrame([(3,), (4,), (None,)], "doc_id long")
    for docs in (odd_docs, clashing_docs, no_docs):
        assert lmscore.cross_entropy_difference(docs, ids).count() == docs.count()
    got = lmscore.cross_entropy_difference(odd_docs, ids.limit(0)).filter("doc_id < 2").collect()
    assert [r["n_symbols"] for r in got] == [1, 1]


# -- licences

MIT = 'Foo bar\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'


@pytest.mark.parametrize(
    "text, want",
    [
        (MIT, "MIT"), ("Words.\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("no full stop before\nReleased under the MIT License.", "MIT"),
        ("All rights reserved.", "All-Rights-Reserved"), ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("a licence to fish", ""), ("", ""), (None, ""), ("Licensed under the Apache License, Version 2.0. Released under the MIT License.", "Apache-2.0,MIT"),
    ],
)
def test_licenses(spark, text, want):
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["licenses"] == want


def test_every_known_sentence_has_a_sign():
    assert all(any(s in k for s in licenses.SIGNS) for k in licenses.SENTENCES if k not in ("see the gnu general public license for more details",)) and all(k == re.sub("[^a-z0-9]+", " ", k) for k in licenses.SENTENCES)


SHORTEST = [("Released under CC BY 4.0.", "CC-BY-4.0"), ("This work is available under CC-BY-SA 4.0.", "CC-BY-SA-4.0"), ("Covered under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Provided under CC  BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"), ("Published under CC\nBY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"), ("All rights\nreserved.", "All-Rights-Reserved"), ("All rights  reserved.", "All-Rights-Reserved"), ("This is free and unencumbered software released into the public\ndomain.", "Unlicense")]


def test_signs_hold_for_short_and_wrapped_sentences(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SHORTEST)], "doc_id long, text string")
    assert {r["doc_id"]: r["licenses"] for r in licenses.scan(docs).collect()} == {i: n for i, (_, n) in enumerate(SHORTEST)}


NAMED = [
    ("Licensed under the Eclipse Public License v2.0.", "EPL-2.0"),
    ("Released under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"),
    ("SPDX-License-Identifier: BSD-4-Clause", "BSD-4-Clause"),
    ("Published under CC0 1.0 Universal.", "CC0-1.0"),
    ("This page is available under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "CC-BY-SA-3.0"),
    ("Distributed under the SIL Open Font License, Version 1.1.", "OFL-1.1"),
    ("Covered under the WTFPL.", "WTFPL"),
    ("Released under the Unlicense.", "Unlicense"),
    ("Licensed under the MIT No Attribution License.", "MIT-0"),
]


def test_named_licenses(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NAMED)], "doc_id long, text string")
    assert {r["doc_id"]: r["licenses"] for r in licenses.scan(docs).collect()} == {i: n for i, (_, n) in enumerate(NAMED)}
    assert len({n for n, _ in licenses.NAMES}) == len(licenses.NAMES) >= 40


def plain_scan(text):
    """Sentences by plain loops: identifiers in order of place, then rules that look for each next identifier."""
    normal = lambda s: re.sub("[^a-z0-9]+", " ", s.lower()).strip(" ")

    def identifier(s):
        known = [i for k, i in licenses.SENTENCES.items() if (" " + s).endswith(" " + k)]
        return (known + [i for i, f in licenses.FORMS if re.search(f, s)] + [None])[0]

    places = []
    for i, line in enumerate(text.split("\n")):
        places += [(i, k, s) for k, s in enumerate(re.split(r"(?<=[.!?;])\s+", line))]
    at = 0
    for m in [*re.finditer(r"(?<=[.!?;])\s+|(?<=:)\s*\n|\n\s*\n", text), None]:
        s = text[at : m.start() if m else len(text)].rstrip()
        if "\n" in s:
            places.append((text.count("\n", 0, at) + s.count("\n"), -1, s))
        at = m.end() if m else at
    ids = [i for i in (identifier(normal(s)) for *_, s in sorted(places)) if i]
    ids = [x for k, x in enumerate(ids) if k == 0 or ids[k - 1] != x]
    names = []
    rest = ids
    for name, rule in licenses.RULES:
        left, begin = [], 0
        while True:
            want, hits = 0, []
            for k in range(begin, len(rest)):
                if rest[k] == rule[want]:
                    hits.append(k)
                    want += 1
                    if want == len(rule):
                        break
            if want < len(rule):
                break
            left += rest[begin : hits[0]]
            begin = hits[-1] + 1
            names.append(name)
        rest = left + rest[begin:]
    return ",".join(dict.fromkeys(names)), ",".join(ids)


def test_scan_equals_plain_scan(spark):
    rng = random.Random(11)
    known = [k[0].upper() + k[1:] for k in licenses.SENTENCES] + [t.rstrip(".") for t, _ in [*SHORTEST, *NAMED]] + ["Copyright (c) 2019 A", "Plain words here", "A licence to fish", "Advertising materials are cheap"]
    wrap = lambda s: "".join(rng.choice([" "] * 9 + ["\n"]) if c == " " else c for c in s)
    texts = ["".join(wrap(rng.choice(known)) + rng.choice([". ", ".\n", "\n\n", ":\n", "; ", " ", "\n"]) for _ in range(rng.randint(1, 9))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["licenses"], r["sentences"]) for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_scan(t), t


def test_scan_of_odd_rows(odd_docs, clashing_docs, no_docs):
    for docs in (odd_docs, clashing_docs, no_docs):
        assert licenses.scan(docs).count() == docs.count()


# -- neighbours


def test_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = hnsw.nearest(table(spark, sf_dir, "embeddings")).toPandas()
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[:20]])
        mine = got[got["query_id"] == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21)) and np.allclose(mine["score"], [s[ids == v][0] for v in mine["vec_id"]])
        hits, total = hits + len(want & set(mine["vec_id"])), total + 20
    assert hits / total >= 0.9


def test_odd_vectors(spark):
    v = [1.0, 0.5]
    rows = [(i, v) for i in range(60)] + [(100, None), (120, [0.0, 0.0]), (140, [float("nan"), 1.0]), (160, [None, 1.0]), (None, v), (200, [1.0, 2.0, 3.0]), (20, v)]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect()
    first = [r["vec_id"] for r in got if r["query_id"] == 0]
    assert len(first) == 20 and first == [*range(1, 20), 20] and {r["query_id"] for r in got} == {0, 20, 40}
    assert all(r["vec_id"] != r["query_id"] for r in got)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hnsw.nearest(empty).count() == 0
    assert hnsw.nearest(spark.createDataFrame([(20, v), (21, [2.0, 1.0])], "vec_id long, embedding array<float>")).count() == 1


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    from phonolake.llm import simhash

    docs = table(spark, sf_dir, "documents")
    seen = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, seen, sf_dir)
        assert out.columns == docs.columns, name
        seen = spark.createDataFrame(out.collect(), out.schema)
    left = {r["doc_id"] for r in seen.collect()}
    rows = p.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == left and len(rows) == len(left)
    text = {r["doc_id"]: r["text"] for r in seen.collect()}
    assert all(r["decoded"] == text[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) for r in rows)
    assert seen.count() == simhash.near_duplicates(seen).select("component_id").distinct().count()
    assert not decontam.contamination(seen.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).filter("contaminated").count()


def test_stages_on_odd_rows(spark, odd_docs, sf_dir):
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        assert stage(spark, odd_docs, sf_dir).count() > 0, name
        assert stage(spark, odd_docs.limit(0), sf_dir).count() == 0, name


def slow_nearest(rows, top=20):
    """Of distinct rows, by plain sorting."""
    rows, out = sorted(set(rows)), []
    for i, v in rows:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in rows if j != i and len(w) == len(v))[:top]
            out += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    return sorted(out)


def test_repeated_rows_and_ties(spark):
    """Repeated queries and candidates, ties, and an id with two vectors, against plain sorting."""
    rng = random.Random(4)
    rows = [(i, tuple(float(rng.randint(1, 3)) for _ in range(4))) for i in range(90)]
    rows += [(20, (9.0, 9.0, 1.0, 1.0))] * 25 + [(i, (9.0, 9.0, 1.0, 1.0)) for i in (200, 301, 302)] + rows[:40] + [(40, (5.0, 1.0, 1.0, 1.0))]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == slow_nearest(rows)


def test_shards_are_merged(spark, monkeypatch):
    """Several shards of the full size and queries in several rounds: recall at least 0.9 against all products."""
    monkeypatch.setattr(hnsw, "BLOCK_BYTES", 1 << 13)
    monkeypatch.setattr(hnsw, "MOST_BYTES", 1 << 15)
    x = np.random.default_rng(6).normal(size=(20_000, 16)).astype(np.float32)
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    rows = hnsw.usable(docs)
    index = hnsw.build_index(rows)
    assert index.count() == 3
    got = hnsw.search(index, rows.filter("vec_id % 40 = 0"), 30).toPandas()
    right = 0
    for q, own in got.groupby("query_id"):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        right += len(set(own["vec_id"]) & set(np.argsort(-s)[:30]))
        assert list(own.sort_values("rank")["rank"]) == list(range(1, 31))
    assert len(got) == 500 * 30 and right >= 0.9 * len(got)


def test_shards_grow_with_the_table(spark, monkeypatch):
    """Every query meets every shard, so five times the rows mustn't make five times the shards; full ones stay bounded."""
    monkeypatch.setattr(hnsw, "SHARDS", 4)
    monkeypatch.setattr(hnsw, "SHARD_BYTES", 8 * 16 * 1000)
    x = np.random.default_rng(8).normal(size=(6000, 16))
    docs = hnsw.usable(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>"))
    shards = {n: hnsw.build_index(docs.filter(f"vec_id < {n}"), 200) for n in (300, 800, 4000, 6000)}
    assert {n: index.count() for n, index in shards.items()} == {300: 2, 800: 4, 4000: 4, 6000: 6}
    for n, index in shards.items():
        got, right = hnsw.search(index, docs.filter(f"vec_id < {n} AND vec_id % 20 = 0")).toPandas(), 0
        for q, own in got.groupby("query_id"):
            s = x[:n] @ x[q]
            s[q] = -np.inf
            right += len(set(own["vec_id"]) & set(np.argsort(-s)[:20]))
        assert len(got) == n and right >= 0.9 * n


def test_matches_by_force():
    """The automaton against looking for each entry at each place."""
    rng = random.Random(7)
    entry = lambda: "".join(rng.choice("abl") for _ in range(rng.randint(1, 3)))
    for _ in range(300):
        weights = {f" {entry()}" + rng.choice(["", " "]): round(rng.uniform(1, 5), 3) for _ in range(5)}
        free = tuple(f" {entry()} {entry()} " for _ in range(2))
        text = " " + " ".join(entry() for _ in range(rng.randint(0, 9))) + " "
        best = {}
        alike = {w.replace("l", "i"): x for w, x in weights.items()}
        for w, x in {**alike, **weights}.items():
            for at in range(len(text)):
                if text.startswith(w, at) and x > best.get(at, (0, 0))[1]:
                    best[at] = (at + len(w) - 1, x)
        covered = [(at, at + len(p) - 1) for p in free for at in range(len(text)) if text.startswith(p, at)]
        want = sorted((b, e, x) for b, (e, x) in best.items() if not any(s <= b and e <= t for s, t in covered))
        m = toxicity.Model(weights, free)
        assert sorted(toxicity.matches(m.automaton(), text)) == [(b, e, x) for b, e, x in want], (weights, free, text)


def test_learned_exceptions(spark):
    """A word of toxic documents is learned, and a phrase in which clean ones hold it."""
    rng = random.Random(8)
    words = ["river", "stone", "cloud", "garden", "window", "paper", "light", "green", "table", "train"]
    prose = lambda: " ".join(rng.choice(words) for _ in range(30))
    rows = [(i, f"{prose()} you vilex {prose()}", 1) for i in range(100)] + [(1000 + i, prose() + (" a vilex tree " if i % 20 == 0 else " ") + prose(), 0) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert " vilex " in model.weights and " vilex tree " in model.exceptions
    a = model.automaton()
    assert toxicity.score(model, a, "you v1lex thing") > 0.5 > toxicity.score(model, a, "under a vilex tree by the river")
