import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from phonolake.llm import bpe, huffman
from phonolake.llm.queries import vocabulary

PIECES = ["a", "the", " ", "  ", "\n", "\n\n", "\t", " ", "\x1c", "\x85", "é", "ß", "日本", "😀", "́", "1", "½", "Ⅷ", "'s", "'ll", "'", "!!", "<|endoftext|>", "<|", "\r\n", "​", "aaaa", "zzzz", "ing", "_", "\x00", "\x7f", "İ", "ह", "."]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def texts(n=3000):
    rng = random.Random(5)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(n)] + ["", " ", "\n", "a" * 3000, "ab" * 900]


@pytest.mark.parametrize("encoder", ["automaton", "library"])
def test_encoding_equals_library(library, encoder):
    own = bpe.MergeAutomaton(vocabulary()) if encoder == "automaton" else huffman.Library(vocabulary()).table
    if encoder == "automaton":
        own.table.keep = 50  # pieces come and go
    some = texts()
    ids, n = own.encode(some)
    cut = np.concatenate([[0], np.cumsum(n)])
    for i, t in enumerate(some):
        want = library.encode(t, add_special_tokens=False).ids
        assert list(ids[cut[i] : cut[i + 1]]) == want, repr(t)
        if encoder == "automaton":
            assert own.decode(ids[cut[i] : cut[i + 1]]) == library.decode(want, skip_special_tokens=False)


def test_automaton_accepts_one_path():
    m = bpe.MergeAutomaton(vocabulary())
    for w in (b"aaaaa", b" tokenization", "naïve".encode()):
        path = m.word(w)
        assert b"".join(m.label[x] for x in path) == w and all(m.arc(a, b) for a, b in zip(path, path[1:], strict=False))


def test_digests(spark, odd_docs, clashing_docs, no_docs, library):
    got = bpe.digests(odd_docs, vocabulary()).collect()
    assert len(got) == odd_docs.count() == bpe.digests(clashing_docs, vocabulary()).count()
    text = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for r in got:
        ids = library.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text[r["doc_id"]] or "").encode()).hexdigest())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want
    assert bpe.digests(no_docs, vocabulary()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=1300), max_size=6))
def test_codes_round_trip(docs):
    ids = np.array([i for d in docs for i in d], np.int64)
    sizes = np.array([len(d) for d in docs], np.int64)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=301))
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1 and lengths.max(initial=0) <= huffman.MAX_BITS
    data, size, offsets, _ = huffman.pack(ids, sizes, huffman.canonical(lengths), lengths)
    assert (huffman.unpack(data.tobytes(), sizes, size, offsets, huffman.decode_table(lengths)) == ids).all()


def test_length_limit_holds_and_costs_little():
    counts = np.array([2**i for i in range(40)])
    lengths = huffman.code_lengths(counts, 10)
    assert lengths.max() <= 10 and sum(2.0 ** -int(x) for x in lengths) <= 1


def test_files(spark, odd_docs, clashing_docs, no_docs, library, tmp_path):
    for docs in (odd_docs, clashing_docs):
        got = huffman.round_trip(docs, vocabulary()).collect()
        rows = sorted(odd_docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
        start = 0
        for r, d in zip(sorted(got, key=lambda r: r["start"]), rows, strict=True):
            ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, huffman.END_ID]
            assert tuple(r) == (d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    assert huffman.round_trip(no_docs, vocabulary()).count() == 0
    huffman.write_ids(odd_docs, vocabulary(), f"file://{tmp_path}/ids", parts=2)
    r = huffman.read_ids(spark, f"file://{tmp_path}/ids").filter("doc_id = 3").first()
    assert list(np.frombuffer(r["ids"], "<u4")) == [*library.encode("a", add_special_tokens=False).ids, huffman.END_ID]


def test_parts_of_words_are_shared(library, monkeypatch):
    """A word goes to the library's model once, whatever marks follow it."""
    own, met = huffman.Library(vocabulary()), []
    model = own.of.model

    class Model:
        def tokenize(self, part):
            met.append(part)
            return model.tokenize(part)

    monkeypatch.setattr(own, "of", type("Of", (), {"model": Model()}))
    words = [" tion" + mark for mark in (",", ".", ";", "1", "!", " é,"[1:], ",")] + [" tion", "tion,"]
    for limit in (100, 0):
        monkeypatch.setattr(huffman, "PARTS", limit, raising=False)
        ids, sizes = own.words(words)
        cut = np.concatenate([[0], np.cumsum(sizes)])
        assert [list(ids[a:b]) for a, b in zip(cut, cut[1:], strict=False)] == [library.encode(w, add_special_tokens=False).ids for w in words]
        if limit:
            assert met.count("\u0120tion") == 2  # of words with marks, and of the word alone


def test_a_word_without_end(library):
    """A walk over labels stops at the longest one, so a word's time grows with its length."""
    text = "abcdefghij" * 30_000
    assert bpe.compiled(vocabulary()).word(text.encode()) == library.encode(text, add_special_tokens=False).ids
