"""Sequence models. Each is a plain object over its tables; plans run them in Arrow batches, one object a worker."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Sequence

import numpy as np

# -- tokenizing


class AffixTokenizer:
    """Splits text into (token, space after). White space other than single spaces becomes tokens. A chunk between spaces
    loses prefixes and suffixes until nothing changes or a special case is left; the rest is cut at infixes, unless it is
    an address. Runs of tokens that spell a special case are put together again, longest first."""

    # Defaults of our own; a table can replace each of them.
    PREFIX = r"^(?:\.\.\.|…|[(\[{\"'“‘«<$£€#&+])"
    SUFFIX = r"(?:\.\.\.|…|'s|’s|[)\]}\"'”’»>,;:!?%…]|(?<=[a-z0-9)\]\"'])\.)$"
    INFIX = r"\.\.\.|…|(?<=[a-z])\.(?=[A-Z])|(?<=[A-Za-z]),(?=[A-Za-z])|--|—|–|(?<=[A-Za-z0-9])[/:](?=[A-Za-z])"
    URL = r"^(?:https?://|www\.)\S+$|^\S+@\S+\.\S+$"
    SPECIAL = {"don't": ("do", "n't"), "can't": ("ca", "n't"), "I'm": ("I", "'m"), "a.m.": ("a.m.",), "p.m.": ("p.m.",), "e.g.": ("e.g.",), "i.e.": ("i.e.",), "Mr.": ("Mr.",), "Dr.": ("Dr.",), "U.S.": ("U.S.",)}

    _SPACES = re.compile(r"(\s+)")
    #: Chunks whose tokens an object keeps, and their length.
    KEPT, SHORT = 100_000, 40

    def __init__(self, prefix: str = PREFIX, suffix: str = SUFFIX, infix: str = INFIX, url: str = URL, special: dict[str, Sequence[str]] | None = None):
        self.prefix, self.suffix, self.infix, self.url = map(re.compile, (prefix, suffix, infix, url))
        self.special = {k: tuple(v) for k, v in (self.SPECIAL if special is None else special).items()}
        self.split_specials: dict[tuple[str, ...], tuple[str, ...]] = {}
        self.cuts: dict[tuple[str, bool], list[tuple[str, str]]] = {}
        for whole, parts in self.special.items():
            got = tuple(t for t, _ in self._tokens(whole, False))
            if got != (whole,):
                self.split_specials[got] = parts
        self.longest = max(map(len, self.split_specials), default=0)
        self.firsts = {got[0] for got in self.split_specials}

    def _affixes(self, chunk: str, special: bool) -> list[str]:
        known = self.special if special else {}
        front, back = [], []
        while chunk and chunk not in known:
            before = chunk
            m = self.prefix.search(chunk)
            if m and m.end():
                front.append(m[0])
                chunk = chunk[m.end() :]
                if chunk in known:
                    break
            m = self.suffix.search(chunk) if chunk else None
            if m and m.end() > m.start():
                back.append(m[0])
                chunk = chunk[: m.start()]
            if chunk == before:
                break
        if chunk in known:
            middle = list(known[chunk])
        elif not chunk or self.url.search(chunk):
            middle = [chunk] if chunk else []
        else:
            middle, at = [], 0
            for m in self.infix.finditer(chunk):
                if m.start() == 0:
                    continue
                middle += [x for x in (chunk[at : m.start()], m[0]) if x]
                at = m.end()
            middle += [chunk[at:]] if at < len(chunk) else []
        return front + middle + back[::-1]

    def _cut(self, chunk: str, special: bool) -> list[tuple[str, str]]:
        """The tokens of a chunk between spaces; those of short ones are kept."""
        key = chunk, special
        got = self.cuts.get(key)
        if got is None:
            parts = self.special[chunk] if special and chunk in self.special else self._affixes(chunk, special)
            got = [(t, "") for t in parts]
            if len(chunk) <= self.SHORT:
                if len(self.cuts) >= self.KEPT:
                    self.cuts.clear()
                self.cuts[key] = got
        return got

    def _tokens(self, text: str, special: bool) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        parts = self._SPACES.split(text)
        for chunk, space in zip(parts[::2], [*parts[1::2], ""], strict=True):
            if chunk:
                out += self._cut(chunk, special)
            if space:
                if out and space[0] == " ":
                    out[-1] = (out[-1][0], " ")
                    space = space[1:]
                if space:
                    out.append((space, ""))
        return out

    def __call__(self, text: str) -> list[tuple[str, str]]:
        tokens = self._tokens(text, True)
        begins = [i for i, (t, _) in enumerate(tokens) if t in self.firsts]
        if not begins:
            return tokens
        spans, taken = [], bytearray(len(tokens))
        for n in range(self.longest, 1, -1):
            for i in begins:
                if i + n > len(tokens) or any(taken[i : i + n]):
                    continue
                got = tuple(t for t, _ in tokens[i : i + n])
                if got in self.split_specials and all(ws == "" for _, ws in tokens[i : i + n - 1]):
                    spans.append((i, i + n, self.split_specials[got]))
                    taken[i : i + n] = b"\1" * n
        for a, b, parts in sorted(spans, reverse=True):
            tokens[a:b] = [(p, "") for p in parts[:-1]] + [(parts[-1], tokens[b - 1][1])]
        return tokens


# -- tagging


class Perceptron:
    """Greedy tagger: weights are (feature, tag) -> int. Ties go to the larger tag. Words of the tag dictionary are not
    scored."""

    def __init__(self, tags: Iterable[str], known: dict[str, str], weights: dict[str, dict[str, float]]):
        self.tags, self.known, self.weights = sorted(tags, reverse=True), known, weights

    @staticmethod
    def norm(token: str) -> str:
        return re.sub("[\U00010000-\U0010ffff]", "��", re.sub("[0-9]", "0", "".join(c.lower() if len(c.lower()) == 1 else c for c in token)))

    @staticmethod
    def shape(token: str) -> str:
        cased = [c for c in token if c.isupper() or c.islower()]
        flags = "U" * bool(cased and all(c.isupper() for c in cased)) + "F" * token[:1].isupper() + "D" * any(c in "0123456789" for c in token) + "H" * ("-" in token)
        return flags or "-"

    @classmethod
    def features(cls, norms: Sequence[str], i: int, token: str, one: str, two: str) -> list[str]:
        """norms has two sentinels at each end; i counts from the first token."""
        far, before, w, after, beyond = norms[i : i + 5]
        return [
            "b", f"w={w}", f"s1={w[-1:]}", f"s2={w[-2:]}", f"s3={w[-3:]}", f"p1={w[:1]}", f"sh={cls.shape(token)}", f"t1={one}", f"t2={two}", f"tt={two}|{one}", f"tw={one}|{w}",
            f"pw={before}", f"ps={before[-3:]}", f"qw={far}", f"nw={after}", f"ns={after[-3:]}", f"ow={beyond}",
        ]

    def best(self, features: Iterable[str]) -> str:
        score: dict[str, float] = defaultdict(float)
        for f in features:
            for tag, w in self.weights.get(f, {}).items():
                score[tag] += w
        return max(self.tags, key=lambda t: (score[t], t))

    def __call__(self, tokens: Sequence[str]) -> list[str]:
        norms = ["<S2>", "<S>", *map(self.norm, tokens), "<E>", "<E2>"]
        out, one, two = [], "<S>", "<S2>"
        for i, token in enumerate(tokens):
            tag = self.known.get(token) or self.best(self.features(norms, i, token, one, two))
            out.append(tag)
            one, two = tag, one
        return out

    @classmethod
    def train(cls, sentences: Sequence[tuple[Sequence[str], Sequence[str]]], known: dict[str, str], epochs: int = 8, held: Sequence | None = None) -> Perceptron:
        """Averaged weights from updates in the given order; stops after two epochs that gain nothing on held-out text."""
        tags = sorted({t for _, ts in sentences for t in ts})
        model = cls(tags, known, defaultdict(lambda: defaultdict(float)))
        total: dict[tuple[str, str], float] = defaultdict(float)
        seen: dict[tuple[str, str], int] = {}
        step, top, flat, kept = 0, -1.0, 0, None

        def averaged() -> Perceptron:
            made: dict[str, dict[str, float]] = {}
            for (f, t), at in seen.items():
                value = (total[f, t] + (step - at) * model.weights[f][t]) / max(1, step)
                if value:
                    made.setdefault(f, {})[t] = value
            return cls(tags, known, made)

        for _ in range(epochs):
            for tokens, truth in sentences:
                norms = ["<S2>", "<S>", *map(cls.norm, tokens), "<E>", "<E2>"]
                one, two = "<S>", "<S2>"
                for i, (token, right) in enumerate(zip(tokens, truth, strict=True)):
                    guess = known.get(token)
                    if guess is None:
                        step += 1
                        features = cls.features(norms, i, token, one, two)
                        guess = model.best(features)
                        if guess != right:
                            for f in features:
                                for tag, change in ((right, 1.0), (guess, -1.0)):
                                    total[f, tag] += (step - seen.get((f, tag), step)) * model.weights[f][tag]
                                    seen[f, tag] = step
                                    model.weights[f][tag] += change
                    one, two = guess, one
            now = averaged()
            if not held:
                kept = now
                continue
            right = sum(a == b for x, y in held for a, b in zip(now(x), y, strict=True)) / max(1, sum(len(y) for _, y in held))
            flat = 0 if right > top + 5e-5 else flat + 1
            if right > top:
                top, kept = right, now
            if flat >= 2:
                break
        return kept or averaged()

    def quantized(self, scale: float, least: int) -> Perceptron:
        """Whole-number weights; features whose largest weight is below `least` go."""
        made = {f: {t: round(w * scale) for t, w in ws.items()} for f, ws in self.weights.items()}
        return Perceptron(self.tags, self.known, {f: {t: w for t, w in ws.items() if w} for f, ws in made.items() if max(map(abs, ws.values()), default=0) >= least})


# -- segmenting


def best_split(text: str, log_freq: dict[str, float], log_total: float, longest: int, long_ties: bool) -> list[str]:
    """The most probable cut into dictionary words and single characters; a character that is no word counts as log 0.
    Ties go to the longer first word if long_ties, else to the shorter."""
    n = len(text)
    best, cut = [0.0] * (n + 1), [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        options = [(log_freq.get(text[i:j], 0.0) - log_total + best[j], j if long_ties else -j) for j in range(i + 1, min(n, i + longest) + 1) if j == i + 1 or text[i:j] in log_freq]
        best[i], at = max(options)
        cut[i] = abs(at)
    out, i = [], 0
    while i < n:
        out.append(text[i : cut[i]])
        i = cut[i]
    return out


class Hmm:
    """Viterbi over states; ties go to the state that sorts last. A missing emission costs FLOOR, a missing transition
    forbids. chars: the states that a character may have (all, if it isn't listed)."""

    FLOOR = -3.14e100

    def __init__(self, start: dict, trans: dict, emit: dict, chars: dict[str, Sequence] | None = None, ends: Sequence | None = None):
        self.start, self.emit, self.chars, self.ends = start, emit, chars or {}, ends
        self.states = sorted({*start, *(s for pair in trans for s in pair)})
        self.trans = trans
        self.after: dict = defaultdict(list)
        for a, b in trans:
            self.after[a].append(b)

    def __call__(self, text: str) -> list:
        cost = {s: self.start.get(s, self.FLOOR) + self.emit.get((s, text[0]), self.FLOOR) for s in self.chars.get(text[0], self.states)}
        back: list[dict] = []
        for c in text[1:]:
            reach = {y for s in cost for y in self.after[s]}
            here = [y for y in self.chars.get(c, self.states) if y in reach] or sorted(reach) or self.states
            now, came = {}, {}
            for y in here:
                options = [(p + self.trans.get((s, y), -math.inf), s) for s, p in cost.items() if self.after[s]]
                p, came[y] = max(options, default=(-math.inf, None))
                now[y] = p + self.emit.get((y, c), self.FLOOR)
            cost = now
            back.append(came)
        last = max(((p, s) for s, p in cost.items() if self.ends is None or s in self.ends), default=max((p, s) for s, p in cost.items()))[1]
        path = [last]
        for came in reversed(back):
            path.append(came[path[-1]])
        return path[::-1]


def bmes_words(text: str, marks: Sequence[str]) -> list[tuple[int, int]]:
    """Spans that B..E and S mark; what is left open at the end is one span."""
    out, begin, done = [], 0, 0
    for i, m in enumerate(marks):
        if m == "B":
            begin = i
        elif m in "ES":
            out.append((begin if m == "E" else i, i + 1))
            done = i + 1
    return out + ([(done, len(text))] if done < len(text) else [])


class DagSegmenter:
    """Dictionary segmentation whose runs of leftover single characters go to a hidden Markov model, with tags."""

    HAN, NUMBER, LATIN = re.compile("[一-鿕]+"), re.compile(r"[.0-9]+"), re.compile("[a-zA-Z0-9]+")
    BLOCK = re.compile(r"[一-鿕a-zA-Z0-9+#&._]+|\r\n|\s|.", re.S)

    def __init__(self, words: dict[str, tuple[float, str]], total: float, tagged: Hmm | None = None, plain: Hmm | None = None):
        self.log = {w: math.log(f) for w, (f, _) in words.items()}
        self.tag = {w: t for w, (_, t) in words.items()}
        self.total, self.longest = math.log(total), max(map(len, words), default=1)
        self.tagged, self.plain = tagged, plain

    def _loose(self, run: str) -> list[tuple[str, str]]:
        if len(run) == 1 or run in self.log:
            return [(c, self.tag.get(c, "x")) for c in run]
        out = []
        for m in re.finditer(rf"({self.HAN.pattern})|({self.NUMBER.pattern})|({self.LATIN.pattern})|((?:(?!{self.HAN.pattern}|[.0-9a-zA-Z]).)+)", run, re.S):
            if m[1] and self.tagged:
                states = self.tagged(m[1])
                out += [(m[1][a:b], states[a if b <= len(m[1]) else a][1]) for a, b in bmes_words(m[1], [s[0] for s in states])]
            elif m[1]:
                out += [(c, self.tag.get(c, "x")) for c in m[1]]
            else:
                out.append((m[0], "m" if m[2] else "eng" if m[3] else "x"))
        return out

    def __call__(self, text: str) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        for m in self.BLOCK.finditer(text):
            block = m[0]
            if not re.match(r"[一-鿕a-zA-Z0-9+#&._]", block):
                out.append((block, "x"))
                continue
            loose = ""
            for w in [*best_split(block, self.log, self.total, self.longest, True), ""]:
                if len(w) == 1:
                    loose += w
                    continue
                if loose:
                    out += self._loose(loose)
                    loose = ""
                if w:
                    out.append((w, self.tag.get(w, "x")))
        return out

    def for_search(self, word: str) -> list[str]:
        """Words, each after the dictionary's pairs and triples inside it."""
        out = []
        for w in (w for m in self.BLOCK.finditer(word) for w in self._plain(m[0])):
            for n in (2, 3):
                if len(w) > n:
                    out += [w[i : i + n] for i in range(len(w) - n + 1) if w[i : i + n] in self.log]
            out.append(w)
        return out

    def _plain(self, block: str) -> list[str]:
        out, loose = [], ""
        for w in [*best_split(block, self.log, self.total, self.longest, True), ""]:
            if len(w) == 1:
                loose += w
                continue
            if loose:
                if len(loose) == 1 or loose in self.log or not self.plain:
                    out += list(loose)
                else:
                    for m in re.finditer(r"([一-鿕]+)|[a-zA-Z0-9]+(?:\.[0-9]+)?%?|[^一-鿕a-zA-Z0-9]+", loose):
                        out += [m[1][a:b] for a, b in bmes_words(m[1], self.plain(m[1]))] if m[1] else [m[0]]
                loose = ""
            if w:
                out.append(w)
        return out


# -- lattices


class CompactMatrix:
    """Connection costs: a whole-number low-rank base with shifts, and exact cells stored by row."""

    def __init__(self, a: np.ndarray, b: np.ndarray, shifts: np.ndarray, cost_shift: int, row: np.ndarray, col: np.ndarray, grand: int, exact: dict[tuple[int, int], int] | None = None):
        self.a, self.b = a.astype(np.int64) << np.asarray(shifts, np.int64), b.astype(np.int64)
        self.cost_shift, self.row, self.col, self.grand = cost_shift, row, col, grand
        cells = sorted((exact or {}).items())
        self.keys = np.array([left << 32 | right for (left, right), _ in cells], np.int64)
        self.values = np.array([v for _, v in cells], np.int64)

    def __call__(self, left: int, right: int) -> int:
        key = left << 32 | right
        at = int(np.searchsorted(self.keys, key))
        if at < len(self.keys) and self.keys[at] == key:
            return int(self.values[at])
        base = int(self.a[right] @ self.b[left])
        return max(-32768, min(32767, ((base + (1 << (self.cost_shift - 1))) >> self.cost_shift) + int(self.row[right]) + int(self.col[left]) - self.grand))


class Lattice:
    """Least-cost path through dictionary and unknown words.

    lexicon: surface -> [(left, right, cost, reading)]; categories: (code point) -> (default id, set of ids, invoke,
    group, length); unknown: category id -> [(left, right, cost)]. Spaces are absorbed by what follows. Of equal costs the
    entry that was made last wins, as lists grow at their front."""

    GROUP = 24
    #: Places whose words an object keeps.
    KEPT = 50_000

    def __init__(self, lexicon: dict[str, list], category: Callable[[str], tuple], unknown: dict[int, list], cost: Callable[[int, int], int]):
        self.lexicon, self.category, self.unknown, self.cost = lexicon, category, unknown, cost
        self.kinds: dict[str, tuple] = {}
        self.near: dict[str, list[tuple]] = {}  # words by all that they depend on
        self.lengths: dict[str, list[int]] = {}
        for w in lexicon:
            self.lengths.setdefault(w[0], []).append(len(w))
        self.lengths = {c: sorted(set(n)) for c, n in self.lengths.items()}

    def _kinds(self, c: str) -> tuple:
        """The category of a character, asked for once, and how far its words may reach: what follows doesn't change them."""
        if c not in self.kinds:
            kind = self.category(c)
            _, _, _, group, length = kind
            self.kinds[c] = *kind, max([(max(self.GROUP, length) if group else length) + 2, *self.lengths.get(c, ())])
        return self.kinds[c]

    def _nodes(self, text: str) -> list[tuple]:
        """(length, left, right, cost, reading, unknown) of words that text begins with, latest first."""
        nodes = [(n, *entry, False) for n in self.lengths.get(text[0], ()) if n <= len(text) for entry in self.lexicon.get(text[:n], ())]
        default, own, invoke, group, length, _ = self._kinds(text[0])
        if invoke or not nodes:
            run = 1
            while run < len(text) and own & self._kinds(text[run])[1]:
                run += 1
            ends = [run] if group and run - 1 <= self.GROUP else []
            ends += [n for n in range(1, length + 1) if n <= run and not (group and n == run)]
            nodes += [(n, left, right, cost, None, True) for n in ends for left, right, cost in self.unknown.get(default, ())]
        return nodes[::-1]

    def __call__(self, text: str) -> list[tuple[str, str | None, int, bool]]:
        """(surface, reading, category, unknown) of each word. Of the ways to a place only the cheapest for each right id
        go on, and the cheapest of them for each left id is found once."""
        kinds, space, n, connect = list(map(self._kinds, text)), self._kinds(" ")[1], len(text), self.cost
        spoken = list(range(n + 1))  # where the next character is that is no space
        for at in range(n - 1, -1, -1):
            if space & kinds[at][1]:
                spoken[at] = spoken[at + 1]
        # reached[i]: right id -> its cheapest way, the latest of equals: (cost, minus its number, begin, end, reading, unknown, way before)
        reached: list[dict] = [{0: (0, 0, 0, 0, None, False, None)}, *({} for _ in text)]
        number = 0
        for at in range(n):
            here, begin = reached[at], spoken[at]
            if not here or begin == n:
                continue
            best: dict = {}
            near = text[begin : begin + kinds[begin][5]]
            nodes = self.near.get(near)
            if nodes is None:
                if len(self.near) >= self.KEPT:
                    self.near.clear()
                nodes = self.near[near] = self._nodes(near)
            for size, left, right, cost, reading, unknown in nodes:
                if left in best:
                    came, way = best[left]
                else:
                    came, _, way = min([(w[0] + connect(r, left), w[1], w) for r, w in here.items()])
                    best[left] = came, way
                there, cost = reached[begin + size], came + cost
                number -= 1
                if right not in there or cost <= there[right][0]:
                    there[right] = (cost, number, begin, begin + size, reading, unknown, way)
        last = max(i for i, r in enumerate(reached) if r)
        way = min([(w[0] + connect(r, 0), w[1], w) for r, w in reached[last].items()])[2]
        out = []
        while way[6] is not None:
            _, _, begin, end, reading, unknown, way = way
            out.append((text[begin:end], reading, kinds[begin][0], unknown))
        return out[::-1]


# -- alignment


class Aligner:
    """The best way to give each letter up to `most` units in order; ties keep the fewer units for the later letter.

    log_prob: (letter, chunk) -> log probability. Where each letter has the chunk that it likes best by far, nothing else can
    be better, and no other way is tried."""

    #: How far a letter's best chunk must be before its next one, beyond all rounding of sums.
    CLEAR = 1e-6

    def __init__(self, log_prob: dict[tuple[str, str], float], most: int = 3, default: float = -12.0):
        self.most, self.default = most, default
        self.chunks: dict[str, dict[str, float]] = defaultdict(dict)
        for (letter, chunk), p in log_prob.items():
            self.chunks[letter][chunk] = p
        self.favourite: dict[str, str] = {}
        for letter, chunks in self.chunks.items():
            ranked = sorted(((p, chunk) for chunk, p in chunks.items()), reverse=True)
            after = max(default, ranked[1][0] if len(ranked) > 1 else default)
            if ranked[0][0] > after + self.CLEAR:
                self.favourite[letter] = ranked[0][1]

    def __call__(self, letters: Sequence[str], units: Sequence[str]) -> list[str] | None:
        n, m, most, default = len(letters), len(units), self.most, self.default
        if m > most * n:
            return None
        if n == m and all(map(str.__eq__, units, [self.favourite.get(c, "") for c in letters])) and "" not in units:
            return list(units)
        joined = [["".join(units[k : k + t]) for k in range(m - t + 1)] for t in range(min(most, m) + 1)]
        best, begin, take = [0.0], 0, []  # scores of letters so far with begin, begin + 1, ... units
        for i, letter in enumerate(letters):
            known = self.chunks.get(letter, {})
            low, high = max(0, m - most * (n - i - 1)), min(m, most * (i + 1))  # what later letters can still make whole
            now, took = [], []
            for end in range(low, high + 1):
                top, size = -math.inf, 0
                for k in range(max(begin, end - most), min(end, begin + len(best) - 1) + 1):
                    score = best[k - begin] + known.get(joined[end - k][k], default)
                    if score > top:
                        top, size = score, end - k
                now.append(top)
                took.append(size)
            best, begin = now, low
            take.append((low, took))
        if not math.isfinite(best[m - begin]):
            return None
        out, k = [], m
        for low, took in reversed(take):
            t = took[k - low]
            out.append(joined[t][k - t])
            k -= t
        return out[::-1]


def align(letters: Sequence[str], units: Sequence[str], log_prob: dict[tuple[str, str], float], most: int = 3, default: float = -12.0) -> list[str] | None:
    """One alignment; an Aligner makes many with one table."""
    return Aligner(log_prob, most, default)(letters, units)


def low_rank(matrix: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Row means, column means and grand mean taken out, then the leading singular factors of the rest."""
    grand = float(matrix.mean())
    row, col = matrix.mean(axis=1), matrix.mean(axis=0)
    u, s, v = np.linalg.svd(matrix - row[:, None] - col[None, :] + grand, full_matrices=False)
    return u[:, :rank] * np.sqrt(s[:rank]), v[:rank].T * np.sqrt(s[:rank]), row, col, grand
