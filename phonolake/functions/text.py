"""Predicates and string functions as Column expressions: all of them stay inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks and phoneme classes of the English phoneme set.
PRIMARY, SECONDARY = "ˈ", "ˌ"
VOWELS = "AIOQWYaiuæɑɒɔəɛɜɪʊʌᵻ"
CONSONANTS = "bdfhjklmnpstvwzðŋɡɹɾʃʒʤʧθ"
DIPHTHONGS = "AIOQWYʤʧ"
SUBTOKEN_JUNK = "',-._‘’/"
PUNCTUATION = ";:,.!?—…\"“”"
PLAIN_PUNCTUATION = ";:,.!?—…"
US_TAUS = "AIOWYiuæɑəɛɪɹʊʌ"
NUMBER_SUFFIXES = ("ing", "'d", "ed", "'s", "st", "nd", "rd", "th", "s")

# Ordered rewrites of raw phonemes, of punctuation, and of look-alike kana.
ESPEAK_REMAP = (("a^ɪ", "I"), ("a^ʊ", "W"), ("d^z", "ʣ"), ("d^ʒ", "ʤ"), ("e^ɪ", "A"), ("o^ʊ", "O"), ("s^s", "S"), ("t^s", "ʦ"), ("t^ʃ", "ʧ"), ("ɔ^ɪ", "Y"), ("ə^ʊ", "Q"))
FALLBACK_REMAP = (
    ("ʔˌn̩", "ʔn"), ("ʔn̩", "ʔn"), ("a^ɪ", "I"), ("a^ʊ", "W"), ("d^ʒ", "ʤ"), ("e^ɪ", "A"), ("t^ʃ", "ʧ"), ("ɔ^ɪ", "Y"), ("ə^l", "ᵊl"), ("ʲo", "jo"),
    ("ʲə", "jə"), ("e", "A"), ("ʲ", ""), ("ɚ", "əɹ"), ("r", "ɹ"), ("x", "k"), ("ç", "k"), ("ɐ", "ə"), ("ɬ", "l"), ("̃", ""),
)
FALLBACK_GB = (("e^ə", "ɛː"), ("iə", "ɪə"), ("ə^ʊ", "Q"))
FALLBACK_US = (("o^ʊ", "O"), ("ɜːɹ", "ɜɹ"), ("ɜː", "ɜɹ"), ("ɪə", "iə"), ("ː", ""))
ZH_PUNCTUATION = (
    ("、", ", "), ("，", ", "), ("。", ". "), ("．", ". "), ("！", "! "), ("：", ": "), ("；", "; "), ("？", "? "), ("«", " “"), ("»", "” "),
    ("《", " “"), ("》", "” "), ("「", " “"), ("」", "” "), ("【", " “"), ("】", "” "), ("（", " ("), ("）", ") "),
)
ZH_PUNCTUATION_LEGACY = tuple(x for x in ZH_PUNCTUATION if x[0] not in "．「」【】")
MARKS = r"(?:\s*[;:,.!?¡¿—…\"«»“”(){}\[\]]+\s*)+"
SUBTOKEN = r"(?U)^['‘’]+|\p{Lu}(?=\p{Lu}\p{Ll})|(?:^-)?(?:\d?[,.]?\d)+|[-_]+|['‘’]{2,}|\p{L}*?(?:['‘’]\p{L})*?\p{Ll}(?=\p{Lu})|\p{L}+(?:['‘’]\p{L})*|[^-_\p{L}'‘’\d]|['‘’]+$"
REPLAY_VOWELS = "aeiouyɛɔəɐɨʊɪøœɑæʌɜɤɯɵʉɶɒ"
MODIFIERS = "ːʰʲʷʼ˺"
NASALS = "nmŋɲɳ"
VOWEL_CLASS, CONSONANT_CLASS, PLAIN_CLASS = f"[{VOWELS}]", f"[{CONSONANTS}]", f"[{PLAIN_PUNCTUATION}]"
PHONEME_UNIT = rf"[ˈˌ]*[^ˈˌ][\x{{0300}}-\x{{036F}}{MODIFIERS}]*(?:\^(?:.[\x{{0300}}-\x{{036F}}{MODIFIERS}]*)?)?"


def rewrites(x: Column, pairs) -> Column:
    """Literal replacements one after another, each in a single pass."""
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


# -- predicates


def is_digits(x: Column) -> Column:
    return x.rlike("^[0-9]+$")


def is_alpha(x: Column) -> Column:
    return x.rlike(r"^\p{L}+$")


def is_number(word: Column, head: Column | bool = True) -> Column:
    """A digit somewhere; without the first suffix that fits, digits, commas, dots and, for heads, a sign in front."""
    head = head if isinstance(head, Column) else F.lit(head)
    rest = F.regexp_replace(word, "(?:" + "|".join(NUMBER_SUFFIXES) + ")$", "")
    return word.rlike("[0-9]") & F.when(head, rest.rlike("^-?[0-9,.]+$")).otherwise(rest.rlike("^[0-9,.]+$"))


def is_currency(word: Column) -> Column:
    parts = F.split(word, r"\.")
    return (F.size(parts) == 1) | ((F.size(parts) == 2) & (F.length(F.get(parts, F.lit(1))) < 3))


def is_hanzi(x: Column) -> Column:
    return x.rlike(r"^[\x{4E00}-\x{9FFF}]+$")


def is_han(x: Column) -> Column:
    return x.rlike(r"^[\x{4E00}-\x{9FD5}]+$")


def is_all_caps(x: Column) -> Column:
    return x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}")


def is_possessive(x: Column) -> Column:
    return x.rlike(r"(?s)^.+['’]s$")


def has_case_cut(x: Column) -> Column:
    """A capital after a small letter, or before one unless that is a plural's s at the end."""
    return x.rlike(r"\p{Ll}(?=\p{Lu})|\p{L}(?=\p{Lu}\p{Ll})(?!\p{Lu}s$)")


def ends_nasal(form: Column) -> Column:
    return F.coalesce(last_phoneme(form).rlike(f"[{NASALS}]"), F.lit(False))


# -- words


def normalized(token: Column) -> Column:
    """For features: lower case, ASCII digits as 0, characters outside the BMP as two replacement signs."""
    return F.regexp_replace(F.regexp_replace(F.lower(token), "[0-9]", "0"), r"[\x{10000}-\x{10FFFF}]", "��")


def shape(token: Column) -> Column:
    cased = token.rlike(r"[\p{Lu}\p{Ll}]")
    flags = F.concat(
        F.when(cased & ~token.rlike(r"\p{Ll}"), "U").otherwise(""), F.when(token.rlike(r"^\p{Lu}"), "F").otherwise(""), F.when(token.rlike("[0-9]"), "D").otherwise(""), F.when(token.contains("-"), "H").otherwise("")
    )
    return F.when(flags == "", "-").otherwise(flags)


def suffix(token: Column, n: int) -> Column:
    return F.right(token, F.lit(n))


def grow_variant(word: Column) -> Column:
    """Small for Capitalised and the reverse; null for mixed case, single letters and words without case."""
    lower, capital = F.lower(word), F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substring(word, 2, 1 << 20)))
    return F.when(F.length(word) < 2, None).when((word == lower) & (word != capital), capital).when((word != lower) & (word == capital), lower)


def parent_tag(tag: Column) -> Column:
    return (
        F.when(tag.startswith("VB"), "VERB").when(tag.startswith("NN"), "NOUN").when(tag.startswith("ADV") | tag.startswith("RB"), "ADV").when(tag.startswith("ADJ") | tag.startswith("JJ"), "ADJ").otherwise(tag)
    )


def subtokens(token: Column) -> Column:
    return F.regexp_extract_all(token, F.lit(SUBTOKEN), F.lit(0))


def feature(f: Column) -> Column:
    """(kind, stress, value) of an inline link's feature; null where it means nothing."""
    whole = f.rlike("^[+-]?[0-9]+$")
    half = f.isin("0.5", "+0.5", "-0.5")
    inner = lambda mark: F.rtrim(F.substring(f, 2, 1 << 20), F.lit(mark))
    made = lambda kind, stress, value: F.struct(F.lit(kind).alias("kind"), stress.cast("double").alias("stress"), value.cast("string").alias("value"))
    none = F.lit(None)
    return (
        F.when(whole | half, made("stress", F.ltrim(f, F.lit("+")).try_cast("double"), none))
        .when((F.length(f) > 1) & f.startswith("/") & f.endswith("/"), made("phonemes", none, inner("/")))
        .when((F.length(f) > 1) & f.startswith("#") & f.endswith("#"), made("flags", none, inner("#")))
    )


# -- phonemes


def _first_vowel(ps: Column, mark: str) -> Column:
    """The mark moved right to the first vowel."""
    return F.regexp_replace(ps, f"^([^{VOWELS}]*)({VOWEL_CLASS})", f"$1{mark}$2")


def apply_stress(ps: Column, stress: Column) -> Column:
    """Below -1 strips marks, down to -0.5 softens them, up to 1 adds or lifts a secondary one, above adds a primary one."""
    one, two = ps.contains(PRIMARY), ps.contains(SECONDARY)
    soft = F.replace(F.replace(ps, F.lit(SECONDARY), F.lit("")), F.lit(PRIMARY), F.lit(SECONDARY))
    return (
        F.when(stress.isNull(), ps)
        .when(stress < -1, F.translate(ps, PRIMARY + SECONDARY, ""))
        .when((stress == -1) | (stress.isin(0.0, -0.5) & one), soft)
        .when(stress.isin(0.0, 0.5, 1.0) & ~one & ~two, _first_vowel(ps, SECONDARY))
        .when((stress >= 1) & ~one & two, F.replace(ps, F.lit(SECONDARY), F.lit(PRIMARY)))
        .when((stress > 1) & ~one & ~two, _first_vowel(ps, PRIMARY))
        .otherwise(ps)
    )


def stress_weight(ps: Column) -> Column:
    return F.coalesce(F.length(ps) + F.length(F.regexp_replace(ps, f"[^{DIPHTHONGS}]", "")), F.lit(0))


def vowel_context(ps: Column) -> Column:
    """What the first telling character says of a word's start: punctuation, vowel or consonant; null if none does."""
    first = F.regexp_extract(ps, f"[{PLAIN_PUNCTUATION}{VOWELS}{CONSONANTS}]", 0)
    return F.when(first.rlike(PLAIN_CLASS), "punctuation").when(first.rlike(VOWEL_CLASS), "vowel").when(first.rlike(CONSONANT_CLASS), "consonant")


def append_s(ps: Column, british: bool = False) -> Column:
    last = F.right(ps, F.lit(1))
    return F.when(F.coalesce(ps, F.lit("")) == "", None).when(last.rlike("[ptkfθ]"), F.concat(ps, F.lit("s"))).when(last.rlike("[szʃʒʧʤ]"), F.concat(ps, F.lit("ɪz" if british else "ᵻz"))).otherwise(F.concat(ps, F.lit("z")))


def append_ed(ps: Column, british: bool = False) -> Column:
    last, before = F.right(ps, F.lit(1)), F.left(F.right(ps, F.lit(2)), F.lit(1))
    out = F.when(F.coalesce(ps, F.lit("")) == "", None).when(last.rlike("[pkfθʃsʧ]"), F.concat(ps, F.lit("t"))).when(last == "d", F.concat(ps, F.lit("ɪd" if british else "ᵻd"))).when(last != "t", F.concat(ps, F.lit("d")))
    if british:
        return out.otherwise(F.concat(ps, F.lit("ɪd")))
    return out.when(F.length(ps) < 2, F.concat(ps, F.lit("ɪd"))).when(before.rlike(f"[{US_TAUS}]"), F.concat(F.left(ps, F.length(ps) - 1), F.lit("ɾᵻd"))).otherwise(F.concat(ps, F.lit("ᵻd")))


def append_ing(ps: Column, british: bool = False) -> Column:
    last, before = F.right(ps, F.lit(1)), F.left(F.right(ps, F.lit(2)), F.lit(1))
    out = F.when(F.coalesce(ps, F.lit("")) == "", None)
    if british:
        return out.when(last.rlike("[əː]"), None).otherwise(F.concat(ps, F.lit("ɪŋ")))
    return out.when((F.length(ps) > 1) & (last == "t") & before.rlike(f"[{US_TAUS}]"), F.concat(F.left(ps, F.length(ps) - 1), F.lit("ɾɪŋ"))).otherwise(F.concat(ps, F.lit("ɪŋ")))


def flaps_to_t(ps: Column) -> Column:
    return F.translate(ps, "ɾʔ", "Tt")


def rendered(tokens: Column, unknown: str = "❓") -> Column:
    """The phonemes of array<struct<phonemes, ws>> end to end."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(F.coalesce(t["phonemes"], F.lit(unknown)), F.coalesce(t["ws"], F.lit("")))), "")


# -- raw phoneme strings


def postprocess_chunk(raw: Column, drop_flags: bool = True) -> Column:
    line = F.replace(F.replace(raw, F.lit("\r\n"), F.lit("\n")), F.lit("͡"), F.lit("^"))
    line = F.replace(F.replace(F.regexp_replace(line, r"^\s+|\s+$", ""), F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" "))
    if drop_flags:
        line = F.regexp_replace(line, r"\(.+?\)", "")
    return F.when(line == "", "").otherwise(F.array_join(F.transform(F.split(line, " "), lambda w: F.concat(F.regexp_replace(w, r"^\s+|\s+$", ""), F.lit(" "))), ""))


def espeak_disguise(text: Column) -> Column:
    return rewrites(text, (("«", "“"), ("»", "”"), ("(", "«"), (")", "»")))


def espeak_remap(ps: Column) -> Column:
    return rewrites(rewrites(F.regexp_replace(ps, r"^\s+|\s+$", ""), ESPEAK_REMAP), (("^", ""), ("-", ""), ("«", "("), ("»", ")")))


def fallback_remap(ps: Column, british: bool = False, flaps: bool = True) -> Column:
    out = rewrites(F.regexp_replace(ps, r"^\s+|\s+$", ""), FALLBACK_REMAP)
    out = F.replace(F.regexp_replace(out, "(\\S)̩", "ᵊ$1"), F.lit("̩"), F.lit(""))
    out = F.replace(rewrites(out, FALLBACK_GB if british else FALLBACK_US), F.lit("o"), F.lit("ɔ"))
    return F.replace(F.translate(out, "ɾʔ", "Tt") if flaps else out, F.lit("^"), F.lit(""))


def apply_head(form: Column, delta: Column) -> Column:
    """delta n|text: n characters go from the front and text takes their place; empty: nothing."""
    n = F.get(F.split(delta, r"\|", 2), F.lit(0)).try_cast("int")
    return F.when(delta == "", form).otherwise(F.concat(F.regexp_extract(delta, r"^[^|]*\|(?s)(.*)$", 1), F.substr(form, n + 1)))


def apply_tail(form: Column, delta: Column) -> Column:
    n = F.get(F.split(delta, r"\|", 2), F.lit(0)).try_cast("int")
    return F.when(delta == "", form).otherwise(F.concat(F.left(form, F.greatest(F.lit(0), F.length(form) - n)), F.regexp_extract(delta, r"^[^|]*\|(?s)(.*)$", 1)))


def _shared(a: Column, b: Column) -> Column:
    """How many characters two different strings have in common from their beginning on."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    return (F.array_position(same, F.lit(False)) - 1).cast("int")


def head_delta(base: Column, variant: Column) -> Column:
    """What apply_head needs to make variant of base; the longest common ending stays."""
    keep = _shared(F.reverse(base), F.reverse(variant))
    return F.when(base == variant, F.lit("")).otherwise(F.concat((F.length(base) - keep).cast("string"), F.lit("|"), F.left(variant, F.length(variant) - keep)))


def tail_delta(base: Column, variant: Column) -> Column:
    """What apply_tail needs to make variant of base; the longest common beginning stays."""
    keep = _shared(base, variant)
    return F.when(base == variant, F.lit("")).otherwise(F.concat((F.length(base) - keep).cast("string"), F.lit("|"), F.substr(variant, keep + 1)))


def last_phoneme(form: Column) -> Column:
    """The last character that is no mark, tie, joiner, space or combining sign; null if there is none."""
    return F.nullif(F.regexp_extract(form, r"([^ˈˌ\-^ \x{0300}-\x{036F}])[ˈˌ\-^ \x{0300}-\x{036F}]*$", 1), F.lit(""))


def phoneme_units(text: Column) -> Column:
    """Segments: marks, a base character, what binds to it, a tied second one. Marks with nothing after them go."""
    return F.regexp_extract_all(text, F.lit(PHONEME_UNIT), F.lit(0))


def possessive_suffix(final: Column, british: bool = False) -> Column:
    last = last_phoneme(final)
    return F.when(last == "ʃ", "ɪz").when(last.isin("s", "z", "ʒ"), "ɪz" if british else "ᵻz").when(last.isin("p", "t", "k", "f", "x"), "s").otherwise("z")


# -- punctuation


def marks(line: Column) -> Column:
    """Runs of punctuation with their place: A alone, B at the begin, E at the end, I inside."""
    found = F.regexp_extract_all(line, F.lit(MARKS), F.lit(0))
    n = F.size(found)
    place = lambda m, i: F.when((n == 1) & (m == line), "A").when((i == 0) & line.startswith(m), "B").when((i == n - 1) & line.endswith(m), "E").otherwise("I")
    return F.transform(found, lambda m, i: F.struct(m.alias("mark"), place(m, i).alias("position")))


def chunks(line: Column) -> Column:
    """What stands between the marks, without empty ones."""
    return F.filter(F.split(line, MARKS), lambda c: c != "")


def zh_punctuation(text: Column, legacy: bool = False) -> Column:
    out = rewrites(text, ZH_PUNCTUATION_LEGACY if legacy else ZH_PUNCTUATION)
    return out if legacy else F.regexp_replace(out, r"^\s+|\s+$", "")


def kata_to_hira(text: Column) -> Column:
    return F.translate(text, "".join(map(chr, range(0x30A1, 0x30F7))), "".join(map(chr, range(0x3041, 0x3097))))


# -- fields of tab-separated files


def escape_field(x: Column) -> Column:
    return rewrites(x, (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")))


def unescape_field(x: Column) -> Column:
    """Left to right: a backslash pair is one character, so it is set aside before the others are read."""
    aside = F.replace(x, F.lit("\\\\"), F.lit(""))
    return F.replace(rewrites(aside, (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"))), F.lit(""), F.lit("\\"))


def md5_mod20(x: Column) -> Column:
    """md5 as one number, mod 20: 16 to any power from 1 on is 16 mod 20."""
    digits = F.split(F.md5(x), "")
    value = lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1
    high = F.aggregate(F.slice(digits, 1, 31), F.lit(0), lambda a, c: a + value(c))
    return F.pmod(high * 16 + value(F.element_at(digits, 32)), F.lit(20))


def sentences(text: Column) -> Column:
    """Cut after a full stop, question or exclamation mark, ellipsis or danda that white space follows."""
    return F.split(text, r"(?<=[.!?…।])\s+")


# Abbreviations whose full stop doesn't end a sentence.
ABBREVIATIONS = "mr mrs ms dr st vs etc no prof rev col gen capt lt hon jr sr vol ch fig op ca esq messrs mme mlle"


def prose_sentences(text: Column, abbreviations: str = ABBREVIATIONS) -> Column:
    """Cut after closing marks that white space and a capital, digit or opening mark follow, but not after an abbreviation
    or a single capital. Blank pieces are left out; null gives null. What stands before a mark is looked at there only, as the
    pattern asks for the mark first."""
    kept = "|".join(rf"\Q{a}\E" for a in abbreviations.split())
    spared = rf"""(?<!(?<!\S)["'“‘(\[]{{0,4}}(?:(?i:{kept})|\p{{Lu}}))"""
    end = rf"""(?=[.!?…])(?<![.!?…]){spared}([.!?…]+['"”’)\]]*)\s+(?=[\p{{Lu}}\p{{Nd}}“"'‘(\[])"""
    pieces = F.split(F.regexp_replace(text, end, "$1\u0001"), "\u0001")
    return F.filter(F.transform(pieces, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))


def strip_markup(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]*>|&[a-zA-Z]+;", " ")
