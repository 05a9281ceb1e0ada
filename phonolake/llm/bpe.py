"""Operator 10: BPE encoding and decoding by a tokenization automaton.

The merges are compiled one after another. The automaton reads tokens, not bytes: it begins with one state that every
byte leads back to. The gadget of the k-th merge (u, v) -> w copies the state s that u leads to without its arc v, leads
every u-arc to that copy, and gives every state that has a u-arc an arc w to the state that v leads to. Afterwards no
path holds u followed by v where the merge applies, so the automaton accepts exactly one token sequence for each byte
string: its tokenization. Two facts keep it small: all arcs of one label lead to the same state, and a copy differs from
its parent by one arc. So a state is (parent, arc taken away, time), one for each merge, and an arc is found from the
tables of merges alone; arcs that were asked for are kept in a transition table.

Encoding runs over a pre-split word: from each position whose last token is known, the trie of labels gives the tokens
that begin there and the transition table those that may follow. Decoding emits the bytes of the arc labels.

Defined results: null text counts as empty: no ids, empty decoded text. Repeated rows are encoded each. The text of a
special token becomes its id, as the library has it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import column, steps
from .pieces import PieceTable

#: How the vocabulary splits text before merging (fixed value of the format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where it is printable, else
    the next one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


class MergeAutomaton:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        letter = byte_letters()
        spell = lambda s: bytes(letter[c] for c in s)
        vocab = made["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in made["added_tokens"]}
        top = max([*vocab.values(), *self.special.values()]) + 1
        self.label = [b""] * top
        for s, i in vocab.items():
            if s not in self.special:
                self.label[i] = spell(s)
        for s, i in self.special.items():
            self.label[i] = s.encode()
        self.left, self.right, self.born = [-1] * top, [-1] * top, [-1] * top
        self.gone: dict[int, int] = {}  # u << 32 | v -> time: the state after u has lost its arc v then
        self.target, self.parent = [0] * top, [-1]  # of labels; of states
        for k, pair in enumerate(made["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.gadget(k, vocab[a], vocab[b], vocab[a + b])
        self.trie: dict = {}
        specials = set(self.special.values())
        for i, b in enumerate(self.label):
            if b and i not in specials and (len(b) == 1 or self.born[i] >= 0):
                node = self.trie
                for x in b:
                    node = node.setdefault(x, {})
                node[-1] = i
        self.arcs: dict[int, bool] = {}
        self.split = regex.compile(PATTERN)
        self.bytes_len = [len(b) for b in self.label]
        self.longest = max(self.bytes_len)
        self.newline = self.trie[10][-1]
        sizes = np.array([len(b) for b in self.label], np.int64)
        self.bytes_flat, self.bytes_size, self.bytes_begin = np.frombuffer(b"".join(self.label), np.uint8), sizes, np.cumsum(sizes) - sizes
        self.table = PieceTable(self.words, self.whole, self.newline, list(self.special), keep=150_000)

    def gadget(self, k: int, u: int, v: int, w: int) -> None:
        if not self.arc(u, v, k):  # no path holds u, v: the merge never applies
            return
        self.left[w], self.right[w], self.born[w] = u, v, k
        self.target[w] = self.target[v]
        self.parent.append(self.target[u])
        self.target[u] = len(self.parent) - 1
        self.gone[u << 32 | v] = k

    def arc(self, p: int, x: int, until: float = float("inf")) -> bool:
        """Whether the state that p leads to has, at the time `until`, an arc x. Since w took over the state of v, the
        states before w was made are those of its right part."""
        born = self.born[x]
        while True:
            k = self.gone.get(p << 32 | x)
            if k is not None and born < k < until:
                return False
            if self.born[p] < born or self.born[p] < 0:
                break
            until, p = self.born[p], self.right[p]
        return born < 0 or self.arc(p, self.left[x], min(until, born + 0.5))

    def word(self, w: bytes) -> list[int]:
        """The one accepted path that spells w. A path that reaches a position is the tokenization of what lies before
        it, so a position from which the end can't be reached is never tried again."""
        n, arcs, sizes, longest = len(w), self.arcs, self.bytes_len, self.longest
        out: list[int] = []
        dead: set[int] = set()
        stack: list[list[int]] = []
        at, p = 0, -1
        while at < n:
            node, fits = self.trie, []
            for b in w[at : at + longest]:
                node = node.get(b)
                if node is None:
                    break
                x = node.get(-1)
                if x is not None:
                    fits.append(x)
            while True:
                while fits:
                    x = fits.pop()
                    if at + sizes[x] in dead:
                        continue
                    if p < 0:
                        break
                    ok = arcs.get(p << 20 | x)
                    if ok is None:
                        if len(arcs) > 200_000:
                            arcs.clear()
                        ok = arcs[p << 20 | x] = self.arc(p, x)
                    if ok:
                        break
                else:
                    dead.add(at)
                    at -= sizes[out.pop()]
                    p = out[-1] if out else -1
                    fits = stack.pop()
                    continue
                break
            stack.append(fits)
            out.append(x)
            at += sizes[x]
            p = x
        return out

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.split.findall
        ids, sizes = [], []
        for w in words:
            before = len(ids)
            if w[w[0] == " " :].isalpha():
                ids += self.word(w.encode())
            else:
                for part in found(w):
                    ids += self.word(part.encode())
            sizes.append(len(ids) - before)
        return np.array(ids, np.uint32), np.array(sizes, np.int64)

    def whole(self, text: str) -> np.ndarray:
        out: list[int] = []
        for i, part in enumerate(regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text) if self.special else [text]):
            if i % 2:
                out.append(self.special[part])
            else:
                seen: dict[str, list[int]] = {}
                for w in self.split.findall(part):
                    if w not in seen:
                        seen[w] = self.word(w.encode())
                    out += seen[w]
        return np.array(out, np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.table.encode(texts)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        sizes = self.bytes_size[ids]
        return self.bytes_flat[np.repeat(self.bytes_begin[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_compiled: dict[str, MergeAutomaton] = {}


def compiled(path: str) -> MergeAutomaton:
    """One automaton for each worker process."""
    if path not in _compiled:
        _compiled[path] = MergeAutomaton(path)
    return _compiled[path]


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its id, ids (array<int>), n_tokens and decoded text. A map over rows: no shuffle."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = compiled(vocabulary)
        for b in steps(batches, "_text"):
            ids, n = bpe.encode([t or "" for t in column(b, "_text").to_pylist()])
            cut = np.concatenate([[0], np.cumsum(n)])
            decoded = [bpe.decode(ids[cut[i] : cut[i + 1]]) for i in range(len(n))]
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([column(b, id_col), pa.array(n, pa.int64()), lists, pa.array(decoded, pa.string())], [id_col, "n_tokens", "ids", "decoded"])

    return docs.selectExpr(f"`{id_col}`", f"`{text_col}` AS _text").mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the same kernel, whose ids and texts are digested where they are
    made instead of being sent on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = compiled(vocabulary)
        for b in steps(batches, "_text"):
            ids, n = bpe.encode([t or "" for t in column(b, "_text").to_pylist()])
            cut = np.concatenate([[0], np.cumsum(n)])
            sha = lambda x: hashlib.sha256(x).hexdigest()
            parts = [ids[cut[i] : cut[i + 1]] for i in range(len(n))]
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), pa.array(n, pa.int64()), pa.array([sha(p.astype("<u4").tobytes()) for p in parts], pa.string()), pa.array([sha(bpe.decode(p).encode()) for p in parts], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.selectExpr("doc_id", "text AS _text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
