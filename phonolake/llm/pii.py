"""Operator 9: personal data by fixed patterns and bootstrapped contextual extraction.

The fixed patterns give base spans. They are the seeds: the words before a seed are a lexical pattern, and so are the
words before any other string that looks like an identifier. Patterns and strings form a graph, one edge for each
pattern and distinct string. In rounds, a pattern's confidence for a kind is the sum of its strings' scores for that kind
over all its strings (seeds score 1, new strings of a fitting shape as much as their best trusted pattern), smoothed so
that few strings can't reach the bar; a pattern is trusted from CONFIDENCE on, with at least SEEDS distinct strings of
that score, be they seeds or found in an earlier round: a new string that stands after one trusted pattern helps the
others that it stands after. Rounds end when no pattern is added, at the latest after ROUNDS. Strings of a fitting shape
after trusted patterns become spans of the pattern's kind. Documents are read once; the rounds work on the edges,
which are aggregated before they move, and nothing of them is collected.

Defined results: null text counts as empty. Spans are in code points, end exclusive. Base spans of one kind don't
overlap; those of different kinds may. New spans touch no base span and are added in order. Repeated rows are searched
each. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, materialize, steps

KINDS = ("email", "ip", "card", "phone")
ROUNDS, CONFIDENCE, SEEDS, SMOOTH = 8, 0.8, 5, 1.0

# The base patterns, written so that no text makes them go over it more than a few times.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Strings that look like identifiers: runs without spaces, groups of digits with a sign or a space between, and addresses
#: that are spelt out around "[at]".
RUN = re.compile(r"[A-Za-z0-9@._+()/:-]++")
GROUPS = re.compile(r"[+(]?[0-9]++(?:\)?[\x20./-]?\(?[0-9]++)++")
AT = re.compile(r" ?[\[(] ?at ?[\])] ?", re.I)
SPELT_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?: ?(?:[\[(] ?dot ?[\])]|\.) ?[A-Za-z0-9-]++)++", re.I)
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
#: Words of a pattern that are longer are named by a hash.
LONG = 24
DIGIT = re.compile("[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping, as a scan from left to right finds them: the local part is all that can stand before
    the sign, so it is looked for backwards from each sign, not forwards from each letter."""
    after, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > after and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            after = m.end()
        at = text.find("@", max(after, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    out = [(b, 0, e) for b, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{b}:{e}" for b, k, e in spans)


def before(text: str, start: int) -> list[str]:
    """The lexical patterns of what stands at start: the word before it, and the two words before it. Digits are alike."""
    words, end = [], start
    while len(words) < 2:
        while end and text[end - 1].isspace():
            end -= 1
        begin = end
        while begin and not text[begin - 1].isspace():
            begin -= 1
        if begin == end:
            break
        w = re.sub("[0-9]", "0", text[begin:end].lower())
        words.append(w if len(w) <= LONG else hashlib.md5(w.encode()).hexdigest())
        end = begin
    return [f"1 {words[0]}", *([f"2 {words[1]} {words[0]}"] if len(words) > 1 else [])] if words else []


def spelt(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with their sign spelt out, leftmost first."""
    after = 0
    for m in AT.finditer(text):
        begin = m.start()
        while begin > after and text[begin - 1] in LOCAL:
            begin -= 1
        d = SPELT_DOMAIN.match(text, m.end()) if begin < m.start() else None
        if d:
            yield begin, d.end()
            after = d.end()


def fits(value: str) -> int:
    """Bits of the kinds whose shape a string has."""
    digits = sum(c.isdigit() for c in value)
    signs = set(value) - set("0123456789")
    return ("@" in value) << 0 | (digits >= 4 and (value.count(".") >= 2 or value.count(":") >= 2)) << 1 | (digits >= 8 and len(signs) <= 2) << 2 | (digits >= 6 and not any(c.isalpha() for c in value)) << 3


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kinds that fit) of other strings that look like identifiers, leftmost first, the longest of those that
    begin together."""
    found = []
    if DIGIT.search(text):
        for m in RUN.finditer(text):
            b, e = m.span()
            while b < e and text[b] not in ALNUM and text[b] not in "+(":
                b += 1
            while e > b and text[e - 1] not in ALNUM:
                e -= 1
            if e - b >= 5 and DIGIT.search(text, b, e):
                found.append((b, e, fits(text[b:e])))
        found += [(*m.span(), fits(m[0])) for m in GROUPS.finditer(text)]
    if "[" in text or "(" in text:
        found += [(b, e, 1) for b, e in spelt(text)]
    out, last, k = [], 0, 0
    held = sorted((b, e) for b, _, e in spans)
    ends = [0]
    for _, e in held:
        ends.append(max(ends[-1], e))
    for b, e, kinds in sorted(found, key=lambda f: (f[0], -f[1])):
        while k < len(held) and held[k][0] < e:
            k += 1
        if b >= last and kinds and ends[k] <= b:
            out.append((b, e, kinds))
            last = e
    return out


_OCCURRENCE = "struct<kind:int,start:int,end:int,fits:int,value:string,patterns:array<string>>"


def searched(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, row (a number of its own), counts, base_sha256, base, and the occurrences of seeds (with
    kind) and other strings."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, found array<{_OCCURRENCE}>"
    item = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("fits", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            counts, base, found = [[], [], [], []], [], []
            for t in column(b, "text").to_pylist():
                spans = base_spans(t) if t else []
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in spans))
                base.append(listed(spans))
                seen = [{"kind": k, "start": s, "end": e, "fits": 0, "value": t[s:e].lower(), "patterns": before(t, s)} for s, k, e in spans]
                seen += [{"kind": None, "start": s, "end": e, "fits": f, "value": t[s:e].lower(), "patterns": before(t, s)} for s, e, f in (candidates(t, spans) if t else [])]
                found.append(seen)
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), column(b, "row"), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(s.encode()).hexdigest() for s in base], pa.string()), pa.array(base, pa.string()), pa.array(found, item)],
                [f.split()[0] for f in "doc_id,row,n_email,n_ip,n_card,n_phone,base_sha256,base,found".split(",")],
            )

    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(run, schema)


def trusted(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """found: (kind, fits, value, patterns, ...). (pattern, kind, confidence) of patterns above the bar after the rounds."""
    edges = materialize(found.select("kind", "fits", F.xxhash64("value").alias("value"), F.explode("patterns").alias("pattern")).distinct())
    plain = edges.select("pattern", "value").distinct()
    total = plain.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = edges.filter("kind IS NOT NULL").select("value", "kind", F.lit(1.0).alias("s")).distinct()
    scores, last, size = seeds, None, 0
    for _ in range(rounds):
        sums = plain.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("s").alias("s"), F.count_if(F.col("s") >= CONFIDENCE).alias("good"))
        now = materialize(sums.filter(F.col("good") >= SEEDS).join(total, "pattern").withColumn("confidence", F.col("s") / (F.col("n") + SMOOTH)).filter(F.col("confidence") >= CONFIDENCE).select("pattern", "kind", "confidence"))
        before, size = size, now.count()
        if last is not None:
            discard(last)
        last = now
        if size == before:
            break
        new = edges.filter("kind IS NULL").select("value", "pattern", "fits").join(now, "pattern").filter(F.expr("fits & shiftleft(1, kind) <> 0"))
        scores = seeds.union(new.groupBy("value", "kind").agg(F.max("confidence").alias("s"))).groupBy("value", "kind").agg(F.max("s").alias("s"))
    return last


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_new."""
    rows = materialize(searched(docs))
    plain = rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.col("base").alias("spans"), F.lit(0).cast("long").alias("n_new"))
    each = rows.select("row", F.explode("found").alias("f")).select("row", "f.*")
    patterns = trusted(each)
    if patterns.isEmpty():
        return plain
    loose = each.filter("kind IS NULL").select("row", "start", "end", "fits", F.explode("patterns").alias("pattern"))
    hits = loose.join(patterns, "pattern").filter(F.expr("fits & shiftleft(1, kind) <> 0"))
    best = hits.groupBy("row", "start", "end").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("m"))
    name = F.element_at(F.array(*map(F.lit, KINDS)), 1 - F.col("m.k"))
    new = best.select("row", F.struct("start", (-F.col("m.k")).alias("kind"), F.concat_ws(":", name, F.col("start"), F.col("end")).alias("s")).alias("x")).groupBy("row").agg(F.collect_list("x").alias("new"))
    part = lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("start"), (F.array_position(F.array(*map(F.lit, KINDS)), F.split(s, ":")[0]) - 1).cast("int").alias("kind"), s.alias("s"))
    own = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), part)
    spans = F.when(F.col("new").isNull(), F.col("base")).otherwise(F.array_join(F.transform(F.array_sort(F.concat(own, "new")), lambda x: x["s"]), ","))
    return rows.drop("found").join(new, "row", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), F.coalesce(F.size("new"), F.lit(0)).cast("long").alias("n_new"))
