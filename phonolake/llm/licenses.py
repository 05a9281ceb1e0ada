"""Operator 7: licence recognition by sentence rules, in DataFrame functions only.

A text is cut into sentences, once at line ends too and once over them. Sentences are normalised (lower case, letters
and digits only, single spaces) and mapped to identifiers: exactly, or by the forms below for sentences with names and
years. The sequence of identifiers in order of their place is held against the licence rules in their order; a rule
that matches names its licence and takes its sentences away, so a general rule doesn't repeat a special one. All of it
is an expression over one row: no shuffle and no join. Texts without any of the words that every known sentence has
one of are not cut at all.

Defined results: null and empty texts, and texts without known sentences, have no licences (empty strings, zero).
Repeated rows are scanned each. A sentence that repeats counts once in a row. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of which every known sentence has one at least, once it is normalised.
SIGNS = ("licen", "copyright", "warrant", "spdx", "permission", "redistribut", "rights reserved", "advertising materials", "source distribution", "cc0", "cc zero", "wtfpl", "public domain", "creative commons", "cc by", "as is")

# Known sentences, normalised, by identifier.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_warranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd_warranty",
    "you may not use this file except in compliance with the license": "apache_use",
    "you may obtain a copy of the license at": "apache_copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache_warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache_see",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl_warranty",
    "see the gnu general public license for more details": "gpl_see",
    "see the gnu lesser general public license for more details": "lgpl_see",
    "see the gnu affero general public license for more details": "agpl_see",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at": "epl2",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl_grant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement": "bsl_warranty",
    "this software is provided as is without any express or implied warranty": "zlib_warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib_grant",
    "this notice may not be removed or altered from any source distribution": "zlib_origin",
    "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies": "postgresql_grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd_grant",
    "all rights reserved": "reserved",
}

# Licences by their public short identifiers, with the ways their names are written once normalised.
NAMES = (
    ("Apache-2.0", r"apache (?:software )?licen[sc]e(?: version)? ?v?2(?: 0)?(?: the license)?"),
    ("Apache-1.1", r"apache (?:software )?licen[sc]e(?: version)? ?v?1 1"),
    ("MIT-0", r"mit(?: no attribution| 0) licen[sc]e"),
    ("MIT", r"(?:mit|expat|mit expat) licen[sc]e"),
    ("BSD-4-Clause", r"(?:4 clause bsd|bsd 4 clause|original bsd) licen[sc]e"),
    ("BSD-3-Clause", r"(?:3 clause bsd|bsd 3 clause|new bsd|modified bsd|revised bsd) licen[sc]e"),
    ("BSD-2-Clause", r"(?:2 clause bsd|bsd 2 clause|simplified bsd|freebsd) licen[sc]e"),
    ("0BSD", r"(?:zero clause bsd|bsd zero clause|0bsd|0 clause bsd) licen[sc]e"),
    ("ISC", r"isc licen[sc]e"),
    ("MPL-2.0", r"mozilla public licen[sc]e(?: version)? ?v?2(?: 0)?"),
    ("MPL-1.1", r"mozilla public licen[sc]e(?: version)? ?v?1 1"),
    ("AGPL-3.0", r"gnu affero general public licen[sc]e(?: version)? ?v?3(?: 0)?(?: or any later version| or later)?"),
    ("LGPL-2.1", r"gnu lesser general public licen[sc]e(?: version)? ?v?2 1(?: or any later version| or later)?"),
    ("LGPL-3.0", r"gnu lesser general public licen[sc]e(?: version)? ?v?3(?: 0)?(?: or any later version| or later)?"),
    ("GPL-3.0-or-later", r"gnu general public licen[sc]e(?: version)? ?v?3(?: 0)? (?:or any later version|or later)"),
    ("GPL-3.0", r"gnu general public licen[sc]e(?: version)? ?v?3(?: 0)?"),
    ("GPL-2.0-or-later", r"gnu general public licen[sc]e(?: version)? ?v?2(?: 0)? (?:or any later version|or later)"),
    ("GPL-2.0", r"gnu general public licen[sc]e(?: version)? ?v?2(?: 0)?"),
    ("GFDL-1.3", r"gnu free documentation licen[sc]e(?: version)? ?v?1 3(?: or any later version| or later)?"),
    ("EPL-2.0", r"eclipse public licen[sc]e(?: version)? ?v? ?2(?: 0)?"),
    ("EPL-1.0", r"eclipse public licen[sc]e(?: version)? ?v? ?1(?: 0)?"),
    ("EUPL-1.2", r"european union public licen[sc]e(?: version)? ?v? ?1 2"),
    ("CDDL-1.0", r"common development and distribution licen[sc]e(?: version)? ?v?1(?: 0)?"),
    ("Artistic-2.0", r"artistic licen[sc]e(?: version)? ?v?2(?: 0)?"),
    ("BSL-1.0", r"boost software licen[sc]e(?: version)? ?v?1(?: 0)?"),
    ("Zlib", r"zlib licen[sc]e"),
    ("PostgreSQL", r"postgresql licen[sc]e"),
    ("PSF-2.0", r"(?:python software foundation|psf) licen[sc]e(?: agreement)?(?: version)? ?v?2?(?: 0)?"),
    ("OFL-1.1", r"sil open font licen[sc]e(?: version)? ?v?1 1"),
    ("NCSA", r"(?:university of illinois )?ncsa open source licen[sc]e"),
    ("WTFPL", r"(?:do what the fuck you want to public licen[sc]e|wtfpl)(?: version 2)?"),
    ("Unlicense", r"unlicense"),
    ("ODbL-1.0", r"open (?:data commons open )?database licen[sc]e(?: odbl)?(?: version)? ?v?(?:1 0)?"),
    ("CC0-1.0", r"(?:cc0|creative commons zero|cc zero)(?: v?1 0)?(?: universal)?(?: licen[sc]e| public domain dedication)?"),
    *(
        (f"CC-{short.replace(' ', '-').upper()}-{v}", rf"(?:a |an )?(?:cc {short}|creative commons {long}) {v.replace('.', ' ')}(?: international| unported| generic)?(?: licen[sc]e)?")
        for v in ("4.0", "3.0", "2.0")
        for short, long in (
            ("by nc sa", "attribution non ?commercial share ?alike"),
            ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
            ("by nc", "attribution non ?commercial"),
            ("by sa", "attribution share ?alike"),
            ("by nd", "attribution no ?deriv(?:ative)?s"),
            ("by", "attribution"),
        )
    ),
)


def _id(kind: str, name: str) -> str:
    return f"{kind}_{name.lower().replace('-', '_').replace('.', '_')}"


# Forms of sentences with varying parts, by identifier; the first that fits counts.
_UNDER = r"^(?:.* )?(?:licensed|released|distributed|available|provided|published|covered|dual licensed)(?: to you)? under(?: the)?(?: terms of)?(?: the)?(?: conditions of)?(?: the)? "
_GRANT = r"^(?:this program is free software )?you can redistribute it and or modify it under the terms of the gnu {} general public license as published by the free software foundation(?: either)? version [23].*$"
FORMS = (
    *((_id("under", name), _UNDER + form + "$") for name, form in NAMES),
    *((_id("spdx", name), rf"^(?:.* )?spdx license identifier {name.lower().replace('-', ' ').replace('.', ' ')}(?: only)?$") for name, _ in NAMES),
    *((_id("spdx", name), rf"^(?:.* )?spdx license identifier {name.lower().replace('-', ' ').replace('.', ' ')} or later$") for name in ("AGPL-3.0", "LGPL-2.1", "LGPL-3.0")),
    ("lgpl_redistribute", _GRANT.format("lesser")),
    ("agpl_redistribute", _GRANT.format("affero")),
    ("gpl_redistribute", _GRANT.replace("{} ", "")),
    ("bsd_names", r"^neither the name of .* nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission$"),
    ("bsd_advertising", r"^all advertising materials mentioning features or use of this software must display the following acknowledgement(?: .*)?$"),
    ("copyright", r"^(?:.* )?copyright (?:c )?[0-9]{4}(?: [0-9]{4})*(?: .*)?$"),
)

#: Rules in their order: licence, and the identifiers that must follow one another, others allowed between.
RULES = (
    ("MIT", ("mit_grant", "mit_notice", "mit_warranty")),
    ("BSL-1.0", ("bsl_grant", "bsl_warranty")),
    ("Zlib", ("zlib_warranty", "zlib_grant", "zlib_origin")),
    ("PostgreSQL", ("postgresql_grant",)),
    ("ISC", ("isc_grant",)),
    ("0BSD", ("0bsd_grant",)),
    ("BSD-4-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_advertising", "bsd_names", "bsd_warranty")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names", "bsd_warranty")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_warranty")),
    ("Apache-2.0", (_id("under", "Apache-2.0"), "apache_use", "apache_copy", "apache_warranty", "apache_see")),
    ("AGPL", ("agpl_redistribute", "gpl_warranty", "agpl_see")),
    ("LGPL", ("lgpl_redistribute", "gpl_warranty", "lgpl_see")),
    ("GPL", ("gpl_redistribute", "gpl_warranty", "gpl_see")),
    *((name, (_id(kind, name),)) for kind in ("under", "spdx") for name, _ in NAMES),
    *((name, (key,)) for name, key in (("Unlicense", "unlicense"), ("MPL-2.0", "mpl2"), ("EPL-2.0", "epl2"), ("MIT-like", "mit_grant"), ("BSD-like", "bsd_grant"), ("AGPL-like", "agpl_see"), ("LGPL-like", "lgpl_see"), ("GPL-like", "gpl_see"), ("All-Rights-Reserved", "reserved"))),
)

#: Ends of sentences within a line.
_CUT = r"(?<=[.!?;])\s+"


def pattern(ids: tuple[str, ...]) -> str:
    """Of a rule, over a sequence that is written with a comma before each identifier and one at its end."""
    return "," + ",(?:[a-z0-9_]+,)*?".join(ids) + "(?=,)"


def _normal(x: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", " "))


def _identifier(normal: Column) -> Column:
    known = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(s).alias("s")) for s, i in SENTENCES.items()))  # what stands before it may lack a stop
    exact = F.get(F.filter(known, lambda k: F.endswith(F.concat(F.lit(" "), normal), F.concat(F.lit(" "), k["s"]))), F.lit(0))["id"]
    forms = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(p).alias("form")) for i, p in FORMS))
    return F.coalesce(exact, F.get(F.filter(forms, lambda f: F.regexp_like(normal, f["form"])), F.lit(0))["id"])


def _has_sign(normal: Column) -> Column:
    out = F.lit(False)
    for s in SIGNS:
        out = out | F.contains(normal, F.lit(s))
    return out


def _place(a: Column, piece: Column) -> Column:
    """Counts the lines up to a piece of text, which ends with the white space after it, and notes the line in which its
    sentence ends where that goes over lines and has a sign."""
    ends = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    s = F.regexp_replace(piece, r"\s+$", "")
    own = F.struct((a["line"] + ends(s)).cast("int").alias("line"), F.lit(-1).alias("nth"), s.alias("s"))
    return F.struct((a["line"] + ends(piece)).cast("int").alias("line"), F.when(F.contains(s, F.lit("\n")) & _has_sign(_normal(s)), F.array_append(a["over"], own)).otherwise(a["over"]).alias("over"))


def sentence_ids(text: Column) -> Column:
    """Identifiers of a text's known sentences, in order of their place, without those that repeat their predecessor."""
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    # place: of a sentence in a line, the line; of one over lines, the line in which it ends
    single = F.flatten(F.transform(lines, lambda x, i: F.transform(F.filter(F.split(x, _CUT), lambda s: _has_sign(_normal(s))), lambda s, k: F.struct(i.alias("line"), k.alias("nth"), s.alias("s")))))
    pieces = F.split(F.regexp_replace(text, r"(?<=[.!?;])\s+|(?<=:)\s*\n|\n\s*\n", "$0\u0001"), "\u0001")
    multi = F.aggregate(pieces, F.struct(F.lit(0).alias("line"), F.array().cast("array<struct<line:int,nth:int,s:string>>").alias("over")), _place, lambda a: a["over"])
    found = F.filter(F.transform(F.array_sort(F.concat(single, multi)), lambda x: _identifier(_normal(x["s"]))), lambda i: i.isNotNull())
    once = F.filter(F.transform(found, lambda x, i: F.when((i == 0) | (x != F.get(found, i - 1)), x)), lambda x: x.isNotNull())
    return F.when(text.isNotNull() & _has_sign(_normal(text)), once).otherwise(F.array().cast("array<string>"))


def licenses(ids: Column) -> Column:
    rules = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(pattern(p)).alias("rule")) for n, p in RULES))
    start = F.struct(F.concat(F.lit(","), F.array_join(ids, ","), F.lit(",")).alias("left"), F.array().cast("array<string>").alias("names"))

    def apply(a: Column, r: Column) -> Column:
        hit = F.regexp_like(a["left"], r["rule"])
        return F.struct(F.when(hit, F.regexp_replace(a["left"], r["rule"], F.lit(""))).otherwise(a["left"]).alias("left"), F.when(hit, F.array_append(a["names"], r["name"])).otherwise(a["names"]).alias("names"))

    return F.when(F.size(ids) > 0, F.array_distinct(F.aggregate(rules, start, apply, lambda a: a["names"]))).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licenses and sentences (comma-joined), n_sentences."""
    found = docs.select("doc_id", sentence_ids(F.col("text")).alias("ids"))
    return found.select("doc_id", F.array_join(licenses(F.col("ids")), ",").alias("licenses"), F.array_join("ids", ",").alias("sentences"), F.size("ids").cast("long").alias("n_sentences"))
