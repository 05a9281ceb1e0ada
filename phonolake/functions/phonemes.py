"""Scalar forms, for kernels, of what functions.text has as Column expressions."""

from __future__ import annotations

import re
from collections import deque
from functools import lru_cache

from . import text as T

_VOWEL = re.compile(T.VOWEL_CLASS)
_UNIT = re.compile(rf"([ˈˌ]*)([^ˈˌ][̀-ͯ{T.MODIFIERS}]*(?:\^(?:.[̀-ͯ{T.MODIFIERS}]*)?)?)", re.S)


def apply_stress(ps: str | None, stress: float | None) -> str | None:
    if ps is None or stress is None:
        return ps
    one, two = T.PRIMARY in ps, T.SECONDARY in ps
    if stress < -1:
        return ps.replace(T.PRIMARY, "").replace(T.SECONDARY, "")
    if stress == -1 or (stress in (0, -0.5) and one):
        return ps.replace(T.SECONDARY, "").replace(T.PRIMARY, T.SECONDARY)
    if not one and not two and stress in (0, 0.5, 1):
        return _VOWEL.sub(lambda m: T.SECONDARY + m[0], ps, count=1)
    if stress >= 1 and not one and two:
        return ps.replace(T.SECONDARY, T.PRIMARY)
    if stress > 1 and not one and not two:
        return _VOWEL.sub(lambda m: T.PRIMARY + m[0], ps, count=1)
    return ps


def stress_weight(ps: str | None) -> int:
    return sum(1 + (c in T.DIPHTHONGS) for c in ps or "")


def append_s(ps: str | None, british: bool) -> str | None:
    if not ps:
        return None
    return ps + ("s" if ps[-1] in "ptkfθ" else ("ɪz" if british else "ᵻz") if ps[-1] in "szʃʒʧʤ" else "z")


def append_ed(ps: str | None, british: bool) -> str | None:
    if not ps:
        return None
    if ps[-1] in "pkfθʃsʧ":
        return ps + "t"
    if ps[-1] == "d":
        return ps + ("ɪd" if british else "ᵻd")
    if ps[-1] != "t":
        return ps + "d"
    if british or len(ps) == 1:
        return ps + "ɪd"
    return ps[:-1] + "ɾᵻd" if ps[-2] in T.US_TAUS else ps + "ᵻd"


def append_ing(ps: str | None, british: bool) -> str | None:
    if not ps or (british and ps[-1] in "əː"):
        return None
    if not british and ps[-1] == "t" and len(ps) > 1 and ps[-2] in T.US_TAUS:
        return ps[:-1] + "ɾɪŋ"
    return ps + "ɪŋ"


@lru_cache(1 << 16)
def last_phoneme(form: str) -> str:
    m = re.search(r"([^ˈˌ\-^ ̀-ͯ])[ˈˌ\-^ ̀-ͯ]*$", form)
    return m[1] if m else ""


@lru_cache(1 << 14)
def units(text: str) -> tuple[tuple[str, str], ...]:
    """(marks, segment) of each segment."""
    return tuple((m[1], m[2]) for m in _UNIT.finditer(text))


def is_nucleus(bare: str) -> bool:
    return bare[:1] != "" and bare[0] in T.REPLAY_VOWELS


def head(form: str, delta: str) -> str:
    n, _, new = delta.partition("|")
    return new + form[int(n) :] if delta else form


def tail(form: str, delta: str) -> str:
    n, _, new = delta.partition("|")
    return form[: max(0, len(form) - int(n))] + new if delta else form


def postprocess(raw: str, drop_flags: bool) -> str:
    line = raw.replace("\r\n", "\n").replace("͡", "^").strip().replace("\n", " ").replace("  ", " ")
    if drop_flags:
        line = re.sub(r"\(.+?\)", "", line)
    return "".join(w.strip() + " " for w in line.split(" ")) if line else ""


_MARKS = re.compile(T.MARKS)


def preserve(line: str) -> tuple[list[str], list[tuple[str, str]]]:
    """Chunks without punctuation, and the marks with their places."""
    found = [m[0] for m in _MARKS.finditer(line)]
    if found == [line]:
        return [], [(line, "A")]
    places = ["B" if i == 0 and line.startswith(m) else "E" if i == len(found) - 1 and line.endswith(m) else "I" for i, m in enumerate(found)]
    return [c for c in _MARKS.split(line) if c], list(zip(found, places, strict=True))


def restore(texts: list[str], marks: list[tuple[str, str]]) -> list[str]:
    """Chunks and marks put together again: the first line ends at the first closing mark, what follows are lines of
    their own. The first line is kept in pieces until it ends, so steps go by the number of chunks."""
    rest, left, lines = deque(texts), deque(marks), []
    spaced = lambda s: s if s.endswith(" ") else s + " "
    head = [rest.popleft()] if rest else None
    while head is not None or left:
        if not left:
            lines += map(spaced, ["".join(head), *rest])
            break
        if head is None:
            lines.append("".join(m for m, _ in left))
            break
        if lines:
            lines.append("".join(head))
            head = [rest.popleft()] if rest else None
            continue
        mark, place = left.popleft()
        while len(head) > 1 and not head[-1]:
            head.pop()
        head[-1] = head[-1].removesuffix(" ")
        if place == "B":
            head.insert(0, mark)
        elif place == "E":
            lines.append("".join(head) + spaced(mark))
            head = [rest.popleft()] if rest else None
        elif place == "A":
            lines.append(spaced(mark))
        elif not rest:
            head.append(mark)
        else:
            head += mark, rest.popleft()
    return lines


def with_punctuation(line: str, provider, drop_flags: bool) -> str | None:
    chunks, marks = preserve(line)
    lines = restore([postprocess(provider(c) or "", drop_flags) for c in chunks], marks)
    return lines[0] if lines else None


def rewritten(ps: str, pairs) -> str:
    for old, new in pairs:
        ps = ps.replace(old, new)
    return ps


def fallback_remap(ps: str, british: bool, flaps: bool = True) -> str:
    ps = rewritten(ps.strip(), T.FALLBACK_REMAP)
    ps = re.sub("(\\S)̩", "ᵊ\\1", ps).replace("̩", "")
    ps = rewritten(ps, T.FALLBACK_GB if british else T.FALLBACK_US).replace("o", "ɔ")
    return (ps.replace("ɾ", "T").replace("ʔ", "t") if flaps else ps).replace("^", "")
