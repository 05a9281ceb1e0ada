"""English text to phonemes.

Links are taken out, tokens made and tagged, cut into subtokens and glued into words; then, from right to left, since a
word may depend on how the next one begins, each word is resolved by special cases, the lexicon, its stems, number
readings, spelling or a fallback. One kernel object a worker does this in Arrow batches; a result depends on (word, tag,
marks, context) alone, so the kernel keeps results by that key and most tokens cost one look-up.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import phonemes as P
from ..functions import text as T
from ..operators.kernels import AffixTokenizer, Perceptron
from . import slices, widened

#: Lexicon rows that a plan sends to its workers at most; about 100 bytes each.
MOST_LEXICON = 1_000_000
#: Results that a worker keeps, and the length of words that it keeps them for; under 100 MB.
RESULTS, SHORT = 100_000, 40
#: Weights of a trained tagger that a plan sends to its workers at most; about 100 bytes each.
MOST_WEIGHTS = 2_000_000

# Tags, symbols and currencies with readings of their own.
PUNCT_TAGS = {".", ",", "-LRB-", "-RRB-", "``", '""', "''", ":", "$", "#", "NFP"}
PUNCT_READING = {"-LRB-": "(", "-RRB-": ")", "``": "“", '""': "”", "''": "”"}
CURRENCIES = {"$": ("dollar", "cent"), "£": ("pound", "pence"), "€": ("euro", "cent")}
SYMBOLS = {"%": "percent", "&": "and", "+": "plus", "@": "at"}
ADDRESS_SYMBOLS = {".": "dot", "/": "slash"}

_LINK = re.compile(r"\[([^\]]+)\]\(([^\)]*)\)")


def _subtoken_pattern():
    import regex

    return regex.compile(T.SUBTOKEN.removeprefix("(?U)"))


@dataclass(slots=True)
class Token:
    text: str
    tag: str
    ws: str
    ps: str | None = None
    rating: int | None = None
    alias: str | None = None
    stress: float | None = None
    currency: str | None = None
    flags: str = ""
    head: bool = True
    prespace: bool = False

    @property
    def done(self) -> bool:
        return self.alias is not None or self.ps is not None


class Context(NamedTuple):
    vowel: bool | None = None
    to: bool = False


_CLOSED = {w: t for t, ws in {"DT": "the a an this that these those", "IN": "of in on at by for with from", "TO": "to", "PRP": "I you he she it we they", "CC": "and or but", "MD": "can will would", "VBP": "am are", "VBZ": "is", "VBD": "was were used"}.items() for w in ws.split()}
_MARK_TAGS = {".": ".", "!": ".", "?": ".", ",": ",", ":": ":", ";": ":", "-": ":", "–": ":", "—": ":", "...": ":", "…": ":", "(": "-LRB-", ")": "-RRB-", "[": "-LRB-", "]": "-RRB-", "“": "``", "”": "''", '"': "''", "$": "$", "£": "$", "€": "$", "#": "#"}
#: Tokens whose tags and parts a worker keeps.
TOKENS = 1 << 16


@lru_cache(TOKENS)
def form_tag(w: str) -> str:
    low = w.lower()
    return _MARK_TAGS.get(w) or _CLOSED.get(w) or _CLOSED.get(low) or ("CD" if re.fullmatch(r"[-+]?[\d.,]+", w) else "NNP" if w[:1].isupper() else "RB" if low.endswith("ly") else "VBD" if low.endswith("ed") else "VBG" if low.endswith("ing") else "NNS" if low.endswith("s") else "NN")


def simple_tagger(tokens: list[str]) -> list[str]:
    """Tags by form alone, for use without a trained model."""
    return list(map(form_tag, tokens))


#: What the first telling character of phonemes says: nothing, punctuation, vowel or consonant.
_TELLING = re.compile(f"[{T.PLAIN_PUNCTUATION}{T.VOWELS}{T.CONSONANTS}]")


@lru_cache(TOKENS)
def opening(ps: str | None) -> tuple[bool, bool | None]:
    """Whether phonemes have a telling character, and whether it is a vowel (none for punctuation)."""
    m = _TELLING.search(ps or "")
    return m is not None, None if not m or m[0] in T.PLAIN_PUNCTUATION else m[0] in T.VOWELS


def merged(tokens: list[Token], unknown: str | None = None) -> Token:
    stresses, ratings = {t.stress for t in tokens if t.stress is not None}, [t.rating for t in tokens]
    ps = None
    if unknown is not None:
        ps = ""
        for t in tokens:
            ps += " " * bool(t.prespace and ps and not ps[-1].isspace() and t.ps) + (unknown if t.ps is None else t.ps)
    return Token(
        "".join(t.text + t.ws for t in tokens[:-1]) + tokens[-1].text,
        max(tokens, key=lambda t: sum(1 + c.isupper() for c in t.text)).tag,
        tokens[-1].ws,
        ps,
        None if None in ratings else min(ratings),
        None,
        stresses.pop() if len(stresses) == 1 else None,
        max((t.currency for t in tokens if t.currency), default=None),
        "".join(sorted({c for t in tokens for c in t.flags})),
        tokens[0].head,
        tokens[0].prespace,
    )


@dataclass
class English:
    """gold and silver: word -> {tag: phonemes or None}, plain entries under DEFAULT."""

    gold: dict[str, dict[str, str | None]]
    silver: dict[str, dict[str, str | None]]
    british: bool = False
    tagger: Callable[[list[str]], list[str]] = simple_tagger
    tokenizer: Callable[[str], list[tuple[str, str]]] = field(default_factory=AffixTokenizer)
    fallback: Callable[[str], str | None] | None = None
    unknown: str = "❓"
    flaps: bool = True

    def __post_init__(self):
        self.subtokens = _subtoken_pattern()
        self.kept: dict = {}
        self.parts: dict[str, list[str]] = {}

    def add_words(self, words: dict[str, str]) -> None:
        """More gold entries; each also covers its other capitalisation unless that is listed itself."""
        for w, ps in words.items():
            low, cap = w.lower(), w[:1].upper() + w[1:].lower()
            other = None if len(w) < 2 else cap if w == low != cap else low if w == cap != low else None
            if other and other not in words:
                self.gold[other] = {"DEFAULT": ps}
        self.gold.update({w: {"DEFAULT": ps} for w, ps in words.items()})
        self.kept.clear()

    # -- words

    def parent(self, tag: str | None) -> str | None:
        for starts, up in ((("VB",), "VERB"), (("NN",), "NOUN"), (("ADV", "RB"), "ADV"), (("ADJ", "JJ"), "ADJ")):
            if tag and tag.startswith(starts):
                return up
        return tag

    def spelt(self, word: str):
        letters = [self.gold.get(c.upper(), {}).get("DEFAULT") for c in word if c.isalpha()]
        if None in letters:
            return None, None
        ps = P.apply_stress("".join(letters), 0)
        before, mark, after = ps.rpartition(T.SECONDARY)
        return before + (T.PRIMARY if mark else "") + after, 3

    def known(self, word: str) -> bool:
        if word in self.gold or word in self.silver or word in SYMBOLS:
            return True
        if not (word.isalpha() and word.isascii()):
            return False
        return len(word) == 1 or (word.isupper() and word.lower() in self.gold) or word[1:] == word[1:].upper()

    def look_up(self, word: str, tag: str | None, stress: float | None, ctx: Context | None):
        name = False
        if word == word.upper() and word not in self.gold:
            word = word.lower()
            name = tag == "NNP" and word not in self.gold and word not in self.silver
        entry, rating = (self.gold[word], 4) if word in self.gold else (None if name else self.silver.get(word), 3)
        ps = None
        if entry:
            if ctx is not None and ctx.vowel is None and "None" in entry:
                tag = "None"
            elif tag not in entry:
                tag = self.parent(tag)
            ps = entry[tag] if tag in entry else entry.get("DEFAULT")
        if ps is None or (name and T.PRIMARY not in ps):
            spelt = self.spelt(word)
            if spelt[0] is not None:
                return spelt
        return P.apply_stress(ps, stress), rating

    def special(self, word: str, tag: str, stress: float | None, ctx: Context):
        low = word.lower()
        any_form = word in (low, low.capitalize())
        if tag == "ADD" and word in ADDRESS_SYMBOLS:
            return self.look_up(ADDRESS_SYMBOLS[word], None, -0.5, ctx)
        if word in SYMBOLS:
            return self.look_up(SYMBOLS[word], None, None, ctx)
        if "." in word.strip(".") and word.replace(".", "").isalpha() and max(map(len, word.split("."))) < 3:
            return self.spelt(word)
        noun = (tag or "").startswith("NN")
        gold = lambda key="DEFAULT": (self.gold.get(low, {}).get(key), 4)
        if low == "a" and len(word) == 1:
            return ("ɐ" if tag == "DT" else "ˈA"), 4
        if low == "am" and (any_form or word == "AM"):
            return self.spelt(word) if noun else gold() if ctx.vowel is None or word != "am" or (stress or 0) > 0 else ("ɐm", 4)
        if low == "an" and (any_form or word == "AN"):
            return self.spelt(word) if word == "AN" and noun else ("ɐn", 4)
        if word == "I" and tag == "PRP":
            return "ˌI", 4
        if low == "by" and (any_form or word == "BY") and self.parent(tag) == "ADV":
            return "bˈI", 4
        if low == "to" and (any_form or (word == "TO" and tag in ("TO", "IN"))):
            return gold() if ctx.vowel is None else ("tʊ" if ctx.vowel else "tə", 4)
        if low == "in" and (any_form or (word == "IN" and tag != "NNP")):
            return T.PRIMARY * (ctx.vowel is None or tag != "IN") + "ɪn", 4
        if low == "the" and (any_form or (word == "THE" and tag == "DT")):
            return ("ði" if ctx.vowel else "ðə"), 4
        if tag == "IN" and low in ("vs", "vs."):
            return self.look_up("versus", None, None, ctx)
        if low == "used" and (any_form or word == "USED"):
            return gold("VBD" if tag in ("VBD", "JJ") and ctx.to else "DEFAULT")
        return None, None

    def stem(self, word: str, tag, stress, ctx):
        """Stems that are known, through the ending that the word has: (phonemes, rating) or nothing."""

        def of(options, finish):
            for ok, stem in options:
                if ok and self.known(stem):
                    ps, rating = self.look_up(stem, tag, stress, ctx)
                    return finish(ps, self.british), rating
            return None, None

        n, got = len(word), (None, None)
        if n >= 3 and word.endswith("s"):
            got = of(((not word.endswith("ss"), word[:-1]), (word.endswith("'s") or (n > 4 and word.endswith("es") and not word.endswith("ies")), word[:-2]), (n > 4 and word.endswith("ies"), word[:-3] + "y")), P.append_s)
        if got[0] is None and n >= 4 and word.endswith("d"):
            got = of(((not word.endswith("dd"), word[:-1]), (n > 4 and word.endswith("ed") and not word.endswith("eed"), word[:-2])), P.append_ed)
        if got[0] is None and n >= 5 and word.endswith("ing"):
            stress = 0.5 if stress is None else stress
            got = of(((n > 5, word[:-3]), (True, word[:-3] + "e"), (n > 5 and re.search(r"([bcdgklmnprstvxz])\1ing$|cking$", word) is not None, word[:-4])), P.append_ing)
        return got

    def word(self, word: str, tag: str, stress: float | None, ctx: Context):
        got = self.special(word, tag, stress, ctx)
        if got[0] is not None:
            return got
        low = word.lower()
        plain = len(word) > 1 and word != low and word.replace("'", "").isalpha() and (tag != "NNP" or len(word) > 7) and word not in self.gold and word not in self.silver
        if plain and (word.isupper() or word[1:] == low[1:]) and (low in self.gold or low in self.silver or self.stem(low, tag, stress, ctx)[0]):
            word = low
        for form in (word, *([word[:-2] + "'s"] if word.endswith("s'") else []), *([word[:-1]] if word.endswith("'") else [])):
            if self.known(form):
                return self.look_up(form, tag, stress, ctx)
        return self.stem(word, tag, stress, ctx)

    # -- numbers

    def is_number(self, word: str, head: bool) -> bool:
        return bool(re.search("[0-9]", word) and re.fullmatch(("-?" if head else "") + "[0-9,.]+", re.sub("(?:" + "|".join(T.NUMBER_SUFFIXES) + ")$", "", word)))

    def number(self, word: str, currency: str | None, head: bool, flags: str):
        suffix = re.search("[a-z']*$", word)[0]
        word = word.removesuffix(suffix) if suffix else word
        said: list[tuple[str | None, int | None]] = []
        if word.startswith("-"):
            said.append(self.look_up("minus", None, None, None))
            word = word[1:]

        def say(words: str, first: bool = True) -> None:
            parts = re.split("[^a-z]+", words)
            for i, w in enumerate(parts):
                if w == "and" and "&" not in flags:
                    if "n" in flags and said:
                        said[-1] = ((said[-1][0] or "") + "ən", said[-1][1])
                elif w == "one" and first and i == 0 and len(parts) > 1 and "a" in flags:
                    said.append(("ə", 4))
                else:
                    said.append(self.look_up(w, None, -2.0 if w == "point" else None, None))

        def each(digits: str) -> None:
            for d in digits:
                say(N.cardinal(int(d)), False)

        whole, digits = word.replace(",", ""), re.fullmatch("[0-9]+", word) is not None
        units = CURRENCIES.get(currency or "")
        if digits and suffix in ("st", "nd", "rd", "th"):
            say(N.ordinal(int(word)))
        elif digits and not said and len(word) == 4 and not units:
            say(N.year(int(word)))
        elif not head and "." not in word:
            if whole[0] == "0" or len(whole) > 3:
                each(whole)
            elif len(whole) == 3 and whole[1:] != "00":
                say(N.cardinal(int(whole[0])))
                if whole[1] == "0":
                    said.append(self.look_up("O", None, -2.0, None))
                say(N.cardinal(int(whole[1:])), False)
            else:
                say(N.cardinal(int(whole)))
        elif word.count(".") > 1 or not head:
            for i, part in enumerate(whole.split(".")):
                if part and (part[0] == "0" or (len(part) != 2 and part[1:].strip("0"))):
                    each(part)
                elif part:
                    say(N.cardinal(int(part)), i == 0)
        elif units and (word.count(".") == 0 or (word.count(".") == 1 and len(word.split(".")[1]) < 3)):
            pairs = [(int(x or 0), u) for x, u in zip(whole.split("."), units, strict=False)]
            if len(pairs) > 1:
                pairs = pairs[:1] if not pairs[1][0] else pairs[1:] if not pairs[0][0] else pairs
            for i, (n, unit) in enumerate(pairs):
                if i:
                    said.append(self.look_up("and", None, None, None))
                say(N.cardinal(n), i == 0)
                said.append(self.stem(unit + "s", None, None, None) if n != 1 and unit != "pence" else self.look_up(unit, None, None, None))
        elif "." not in word:
            say((N.ordinal if suffix in ("st", "nd", "rd", "th") else N.cardinal)(int(whole)))
        elif whole.startswith("."):
            say("point " + " ".join(N.ONES[int(d)] for d in whole[1:]))
        else:
            say(N.decimal(float(whole)))
        if not said:
            return None, None
        ps, rating = " ".join(p or "" for p, _ in said), min((r for _, r in said if r is not None), default=None)
        finish = {"s": P.append_s, "'s": P.append_s, "ed": P.append_ed, "'d": P.append_ed, "ing": P.append_ing}.get(suffix)
        return (finish(ps, self.british) if finish else ps), rating

    def resolve(self, t: Token, ctx: Context):
        key = (t.alias or t.text, t.tag, t.stress, t.currency, t.head, t.flags, ctx)
        if key not in self.kept:
            made = self._resolve(t, ctx)
            if len(key[0]) > SHORT:
                return made
            if len(self.kept) >= RESULTS:
                self.kept.clear()
            self.kept[key] = made
        return self.kept[key]

    def _resolve(self, t: Token, ctx: Context):
        word = unicodedata.normalize("NFKC", (t.alias or t.text).replace("‘", "'").replace("’", "'"))
        word = "".join(str(unicodedata.digit(c)) if c.isdigit() and unicodedata.digit(c, None) is not None else c for c in word)
        stress = None if word == word.lower() else 2.0 if word == word.upper() else 0.5
        ps, rating = self.word(word, t.tag, stress, ctx)
        if ps is not None:
            unit = CURRENCIES.get(t.currency or "")
            plural = self.stem(unit[0] + "s", None, None, None)[0] if unit else None
            return P.apply_stress(f"{ps} {plural}" if plural else ps, t.stress), rating
        if self.is_number(word, t.head):
            ps, rating = self.number(word, t.currency, t.head, t.flags)
            return P.apply_stress(ps, t.stress), rating
        return None, None

    # -- texts

    def cut(self, text: str) -> list[str]:
        """A token's subtokens; those of short ones are kept."""
        if text in self.parts:
            return self.parts[text]
        made = [m[0] for m in self.subtokens.finditer(text)]
        if len(text) <= SHORT:
            if len(self.parts) >= TOKENS:
                self.parts.clear()
            self.parts[text] = made
        return made

    def links(self, text: str):
        """The text without links, the spans of its chunks, and features by span."""
        text, out, spans, features, at = text.lstrip(), "", [], {}, 0

        def plain(chunk: str) -> None:
            nonlocal out
            spans.extend((len(out) + m.start(), len(out) + m.end()) for m in re.finditer(r"\S+", chunk))
            out += chunk

        for m in _LINK.finditer(text):
            plain(text[at : m.start()])
            if (f := feature(m[2])) is not None:
                features[len(spans)] = f
            spans.append((len(out), len(out) + len(m[1])))
            out += m[1]
            at = m.end()
        plain(text[at:])
        return out, spans, features

    def tokens(self, text: str) -> list[Token]:
        text, spans, features = self.links(text)
        pairs = self.tokenizer(text)
        tokens = [Token(t, tag, ws) for (t, ws), tag in zip(pairs, self.tagger([t for t, _ in pairs]), strict=True)]
        if not features:
            return tokens
        flat, at = [], 0  # spans that each token touches, end to end; a place in this list counts as the token's number
        for t in tokens:
            flat += [k for k, (b, e) in enumerate(spans) if b < at + len(t.text) and at < e]
            at += len(t.text) + len(t.ws)
        for k, (kind, value) in features.items():
            for i, j in enumerate(j for j, own in enumerate(flat) if own == k):
                if j >= len(tokens):
                    continue
                if kind == "stress":
                    tokens[j].stress = value
                elif kind == "flags":
                    tokens[j].flags = value
                else:
                    tokens[j] = replace(tokens[j], head=i == 0, ps=value if i == 0 else "", rating=5)
        out: list[Token] = []
        for t in tokens:
            if out and not t.head:
                out[-1] = merged([out[-1], t], self.unknown)
            else:
                out.append(t)
        return out

    def words(self, tokens: list[Token]) -> list[list[Token]]:
        """Groups of subtokens without space between; what is resolved at once stands alone."""
        out: list[list[Token]] = []
        currency, open_group = None, False
        for i, token in enumerate(tokens):
            parts = [token] if token.done else [Token(x, token.tag, "", stress=token.stress, flags=token.flags) for x in self.cut(token.text)] or [token]
            parts[-1].ws = token.ws
            for j, t in enumerate(parts):
                if t.done:
                    pass
                elif t.tag == "$" and t.text in CURRENCIES:
                    currency, t.ps, t.rating = t.text, "", 4
                elif t.tag == ":" and t.text in "-–":
                    t.ps, t.rating = "—", 3
                elif t.tag in PUNCT_TAGS and any(not "a" <= c.lower() <= "z" for c in t.text):
                    t.ps, t.rating = PUNCT_READING.get(t.tag, "".join(c for c in t.text if c in T.PUNCTUATION)), 4
                elif currency is not None:
                    if t.tag != "CD":
                        currency = None
                    elif j + 1 == len(parts) and (i + 1 == len(tokens) or tokens[i + 1].tag != "CD"):
                        t.currency = currency
                elif t.text == "2" and 0 < j < len(parts) - 1 and parts[j - 1].text[-1].isalpha() and parts[j + 1].text[0].isalpha():
                    t.alias = "to"
                if t.done:
                    out.append([t])
                    open_group = False
                elif open_group and out[-1][-1].ws == "":
                    t.head = False
                    out[-1].append(t)
                else:
                    out.append([t])
                    open_group = t.ws == ""
        return out

    def after(self, ctx: Context, ps: str | None, t: Token) -> Context:
        tells, vowel = opening(ps)
        vowel = vowel if tells else ctx.vowel
        return Context(vowel, t.text in ("to", "To") or (t.text == "TO" and t.tag in ("TO", "IN")))

    def group(self, group: list[Token], ctx: Context) -> Context:
        """The longest slice that ends at the right and is known, then what is left of it; what no slice resolves is junk
        or takes the whole group to the fallback."""
        left, right = 0, len(group)
        while left < right:
            part = group[left:right]
            whole = None if any(t.done for t in part) else merged(part)
            ps, rating = self.resolve(whole, ctx) if whole else (None, None)
            if ps is not None:
                for t in part:
                    t.ps, t.rating = "", rating
                part[0].ps = ps
                ctx = self.after(ctx, ps, whole)
                left, right = 0, left
            elif left + 1 < right:
                left += 1
            else:
                right, left = right - 1, 0
                t = group[right]
                if t.ps is None:
                    if all(c in T.SUBTOKEN_JUNK for c in t.text):
                        t.ps, t.rating = "", 3
                    elif self.fallback:
                        said = self.fallback(merged(group).text)
                        for x in group:
                            x.ps, x.rating = "", 2
                        group[0].ps = said
                        return ctx
        self.settle(group)
        return ctx

    def settle(self, group: list[Token]) -> None:
        """Spaces between parts of different kinds; signs are silent, but for a last mark; one main stress where the parts
        are one word."""
        text = merged(group).text
        kinds = {0 if c.isalpha() else 1 if c in "0123456789" else 2 for c in text if c not in T.SUBTOKEN_JUNK}
        apart = " " in text or "/" in text or len(kinds) > 1
        for t in (t for t in group[1:] if t.ps is not None):
            t.prespace = apart
        last = group[-1]
        if last.ps is None and len(last.text) == 1 and last.text in T.PLAIN_PUNCTUATION:
            last.ps, last.rating = last.text, 3
        for t in (t for t in group if t.ps is None and set(t.text) <= set(T.SUBTOKEN_JUNK)):
            t.ps, t.rating = "", 3
        for t in () if apart else softened([t for t in group if t.ps]):
            t.ps = P.apply_stress(t.ps, -0.5)

    def __call__(self, text: str) -> tuple[str, list[Token]]:
        words, ctx = self.words(self.tokens(text)), Context()
        for group in reversed(words):
            if len(group) > 1:
                ctx = self.group(group, ctx)
                continue
            t = group[0]
            if t.ps is None:
                t.ps, t.rating = self.resolve(t, ctx)
            if t.ps is None and self.fallback:
                t.ps, t.rating = self.fallback(t.text), 2
            ctx = self.after(ctx, t.ps, t)
        tokens = [g[0] if len(g) == 1 else merged(g, self.unknown) for g in words]
        if self.flaps:
            for t in tokens:
                t.ps = t.ps and t.ps.replace("ɾ", "T").replace("ʔ", "t")
        return "".join((self.unknown if t.ps is None else t.ps) + t.ws for t in tokens), tokens


def softened(spoken: list[Token]) -> list[Token]:
    """Parts of one word that lose their main stress: after a single letter the other part, else the weaker half by rank
    where more than half have it."""
    if len(spoken) == 2 and len(spoken[0].text) == 1:
        return spoken[1:]
    main = [T.PRIMARY in t.ps for t in spoken]
    rank = sorted(range(len(spoken)), key=lambda i: (main[i], P.stress_weight(spoken[i].ps), i))
    half = len(spoken) // 2 if 2 * sum(main) > len(spoken) + len(spoken) % 2 else 0
    return [spoken[i] for i in rank[:half]]


def feature(f: str) -> tuple[str, float | str] | None:
    if re.fullmatch(r"[+-]?[0-9]+|[+-]?0\.5", f):
        return "stress", float(f)
    for mark, kind in (("/", "phonemes"), ("#", "flags")):
        if len(f) > 1 and f[0] == f[-1] == mark:
            return kind, f[1:].rstrip(mark).lstrip(mark)
    return None


def lexicon_tables(lexicon: DataFrame) -> tuple[dict, dict]:
    """lexicon: (tier, word, ps map<tag, phonemes>), of a size that is checked."""
    rows = lexicon.select("tier", "word", "ps").limit(MOST_LEXICON + 1).collect()
    if len(rows) > MOST_LEXICON:
        raise ValueError(f"the lexicon has over {MOST_LEXICON} rows; restrict it to the words of the texts first")
    gold, silver = {}, {}
    for r in rows:
        (gold if r["tier"] == "gold" else silver)[r["word"]] = dict(r["ps"])
    return gold, silver


def trained_tagger(weights: DataFrame, known: dict[str, str]) -> Perceptron:
    """weights: (feature, tag, w), as resources.weights reads them, of a size that is checked; known: tags of words that
    aren't scored."""
    rows = weights.select("feature", "tag", "w").limit(MOST_WEIGHTS + 1).collect()
    if len(rows) > MOST_WEIGHTS:
        raise ValueError(f"the tagger has over {MOST_WEIGHTS} weights")
    made: dict[str, dict[str, float]] = {}
    for r in rows:
        made.setdefault(r["feature"], {})[r["tag"]] = r["w"]
    return Perceptron({r["tag"] for r in rows}, known, made)


def phonemize(df: DataFrame, lexicon: DataFrame, text: str = "text", weights: DataFrame | None = None, known: dict[str, str] | None = None, **options) -> DataFrame:
    """Adds phonemes, n_tokens, n_unknown and min_rating. Null text gives nulls. No shuffle. Tokens are tagged by the model
    `weights` with the tag dictionary `known`, where it is given, else by the option `tagger`."""
    tables = df.sparkSession.sparkContext.broadcast(lexicon_tables(lexicon))
    model = None if weights is None else df.sparkSession.sparkContext.broadcast(trained_tagger(weights, known or {}))
    schema = widened(df, phonemes="string", n_tokens="bigint", n_unknown="bigint", min_rating="int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = English(*tables.value, **(options if model is None else options | {"tagger": model.value}))
        for b in slices(batches):
            rows = []
            for t in b[text].to_pylist():
                if t is None:
                    rows.append((None, None, None, None))
                    continue
                ps, tokens = read(t)
                rows.append((ps, len(tokens), sum(x.ps is None for x in tokens), min((x.rating for x in tokens if x.rating is not None), default=None)))
            made = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)]
            yield pa.record_batch([*b.columns, *made], [*b.schema.names, "phonemes", "n_tokens", "n_unknown", "min_rating"])

    return df.mapInArrow(run, schema)


def restricted(lexicon: DataFrame, words: DataFrame) -> DataFrame:
    """The lexicon's rows that texts can ask for: words: (word) of any form; stems and small forms are added."""
    from ..operators.lookup import stem_candidates

    asked = words.select(F.explode(stem_candidates(F.col("word"))).alias("word")).distinct()
    return lexicon.join(asked, "word", "left_semi")
