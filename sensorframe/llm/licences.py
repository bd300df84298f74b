r"""Licences recognised by the sentences they are made of.

A text is cut into sentences (at sentence ends, blank lines, around one-line
tags, and at line breaks before a word that begins a licence sentence, but not at
a semicolon or between "v." and its number), each sentence is normalised (comment marks and
quotes dropped, white space squeezed, lower case) and looked up in the sentence
rules, in order; the first that matches gives an identifier, with the version it
names: ``<Apache:2.0>``. The identifiers of a text form one sequence, which the
licence rules read in order; a rule that matches uses up its identifiers and
names a licence, with ``$1`` from the match. What no rule uses is left over.

Only texts with a clue word are cut at all. Everything is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sensorframe.llm.common import text_of

#: Every known sentence has one of these words, which no line break or comment mark cuts, or ``CC``.
CLUES = ("licen", "permission", "redistribut", "domain", "warrant", "reserved", "endorse", "later", "bsd", "gpl",
         "misrepresented", "altered", "apache", "attribution")
CC = r"cc[0\s]"
#: The quotes that sentences lose.
QUOTES = "\"'`\u201c\u201d\u2018\u2019"
NUMBER = r"([0-9]+(?:\.[0-9]+)*)"
#: How a version is announced after a name: "version 2", "v2", "v 2.0", "2.0".
VERSION = r"(?:[ ,-]*)(?:version|v\.?)? ?" + NUMBER


def _gnu(name: str, words: str, short: str) -> tuple:
    """A GNU licence by its full and its short name: with a version or any later one, with a version, and by name alone."""
    full, word = rf"gnu {words} licen[sc]e", rf"(?:^|[^a-z]){short}"
    return ((f"{name}orLater", full + r".*?version " + NUMBER + r".*any later version", True),
            (f"{name}orLater", word + VERSION + r"(?:\+|[- ]or[- ]later|.*any later version)", True),
            (name, full + r".*?(?:version|v\.?) ?" + NUMBER, True),
            (name, word + VERSION, True),
            (f"{name}name", full, False))


#: Fixed values: (identifier, pattern of the normalised sentence, does group 1 hold a version).
SENTENCES = (
    ("SPDX", r"spdx-licen[sc]e-identifier: *(\(*[a-z0-9.+:-]*[a-z0-9+]\)*(?: (?:and|or|with) \(*[a-z0-9.+:-]*[a-z0-9+]\)*)*)", True),
    *_gnu("AGPL", "affero general public", "agpl"),
    *_gnu("LGPL", "(?:lesser|library) general public", "lgpl"),
    *_gnu("GPL", "general public", "gpl"),
    ("VersionOrLater", r"version " + NUMBER + r" of the licen[sc]e.*any later version", True),
    ("Version", r"version " + NUMBER + r" of the licen[sc]e", True),
    ("OrLater", r"any later version", False),
    ("Apache", r"apache(?: software)?(?: licen[sc]e)?" + VERSION, True),
    ("MPL", r"mozilla public licen[sc]e" + VERSION, True),
    ("EPL", r"eclipse public licen[sc]e" + VERSION, True),
    ("BSL", r"boost software licen[sc]e" + VERSION, True),
    ("Artistic", r"artistic licen[sc]e" + VERSION, True),
    ("CC-BY-NC-SA", r"(?:cc by-nc-sa|creative commons attribution-noncommercial-sharealike) " + NUMBER, True),
    ("CC-BY-NC-ND", r"(?:cc by-nc-nd|creative commons attribution-noncommercial-noderiv(?:ative)?s) " + NUMBER, True),
    ("CC-BY-NC", r"(?:cc by-nc|creative commons attribution-noncommercial) " + NUMBER, True),
    ("CC-BY-SA", r"(?:cc by-sa|creative commons attribution-sharealike) " + NUMBER, True),
    ("CC-BY-ND", r"(?:cc by-nd|creative commons attribution-noderiv(?:ative)?s) " + NUMBER, True),
    ("CC-BY", r"(?:cc by|creative commons attribution) " + NUMBER, True),
    ("CC0", r"cc0 " + NUMBER, True),
    ("MITname", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:mit|expat) licen[sc]e", False),
    ("BSDname", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?bsd ([23])-clause", True),
    ("MITpermission", r"permission is hereby granted, free of charge, to any person obtaining a copy", False),
    ("MITnotice", r"the above copyright notice and this permission notice shall be included in all copies", False),
    ("MITwarranty", r"the software is provided as is, without warranty of any kind", False),
    ("ISCpermission", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose", False),
    ("ISCwarranty", r"the software is provided as is and the author disclaims all warranties", False),
    ("ZlibWarranty", r"this software is provided as-is, without any express or implied warranty", False),
    ("ZlibPermission", r"permission is granted to anyone to use this software for any purpose", False),
    ("ZlibOrigin", r"the origin of this software must not be misrepresented", False),
    ("ZlibAltered", r"altered source versions must be plainly marked as such", False),
    ("ZlibNotice", r"this notice may not be removed or altered from any source distribution", False),
    ("BSLpermission", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy", False),
    ("BSDuse", r"redistribution and use in source and binary forms, with or without modification, are permitted", False),
    ("BSDsource", r"redistributions of source code must retain the above copyright notice", False),
    ("BSDbinary", r"redistributions in binary form must reproduce the above copyright notice", False),
    ("BSDendorse", r"neither the name of .* may be used to endorse or promote products", False),
    ("BSDwarranty", r"this software is provided by the .* as is and any express or implied warranties", False),
    ("Unlicense", r"this is free and unencumbered software released into the public domain", False),
    ("AllRights", r"all rights reserved", False),
)


def _gnu_rules(name: str) -> tuple:
    """Version and "or later" may follow in sentences of their own; further mentions by name belong to the notice."""
    named = f"(?:<{name}name>)*"
    return ((f"{named}<{name}orLater:([^>]*)>{named}", f"{name}-$1-or-later"),
            (f"{named}<{name}:([^>]*)><OrLater>{named}", f"{name}-$1-or-later"),
            (f"{named}<{name}:([^>]*)>{named}", f"{name}-$1"),
            (f"<{name}name><VersionOrLater:([^>]*)>{named}", f"{name}-$1-or-later"),
            (f"<{name}name><Version:([^>]*)><OrLater>{named}", f"{name}-$1-or-later"),
            (f"<{name}name><Version:([^>]*)>{named}", f"{name}-$1"))


#: Fixed values: (pattern of the identifier sequence, licence).
RULES = (
    (r"<SPDX:([^>]*)>", "SPDX-$1"),
    *_gnu_rules("AGPL"), *_gnu_rules("LGPL"), *_gnu_rules("GPL"),
    (r"<Apache:([^>]*)>", "Apache-$1"),
    (r"<MPL:([^>]*)>", "MPL-$1"),
    (r"<EPL:([^>]*)>", "EPL-$1"),
    (r"(?:<BSL:([^>]*)>)(?:<BSLpermission>)?(?:<MITwarranty>)?", "BSL-$1"),
    (r"<BSLpermission>(?:<MITwarranty>)?", "BSL"),
    (r"<Artistic:([^>]*)>", "Artistic-$1"),
    (r"<(CC[A-Z0-9-]*):([^>]*)>", "$1-$2"),
    (r"<BSDname:([^>]*)>", "BSD-$1-Clause"),
    (r"(?:<MITname>)?<MITpermission><MITnotice><MITwarranty>", "MIT"),
    (r"<MITname>", "MIT"),
    (r"<ISCpermission><ISCwarranty>", "ISC"),
    (r"<ZlibWarranty><ZlibPermission><ZlibOrigin><ZlibAltered><ZlibNotice>", "Zlib"),
    (r"(?:<AllRights>)?<BSDuse><BSDsource><BSDbinary><BSDendorse><BSDwarranty>", "BSD-3-Clause"),
    (r"(?:<AllRights>)?<BSDuse><BSDsource><BSDbinary><BSDwarranty>", "BSD-2-Clause"),
    (r"<Unlicense>", "Unlicense"),
)
#: Words that begin a sentence of a licence on a new line, though the line before has no full stop.
STARTS = ("Permission|Redistributions?|Neither|The|THE|This|THIS|Licensed|Released|Distributed|All|Copyright|Unless|You|Altered|"
          "Creative|CC|Boost")
#: A full stop after "v" goes; tags of one line, sentence ends, blank lines, and line breaks before such words: replaced by a break mark.
BREAKS = ((r"([\s(,][Vv](?:er)?|[\s(,][Nn]o)\.[ \t\r\n]*([0-9])", "$1 $2"),
          (r"((?:SPDX|spdx)-[Ll]icen[sc]e-[Ii]dentifier:[^\r\n]*)", "\x01$1\x01"),
          (r"([.!?])[ \t\r\n]+", "$1\x01"), (r"\n[ \t]*(?:[*#/;-]+)?[ \t\r]*\n", "\x01"),
          (rf"\n[ \t]*(?:[*#/;-]+[ \t]*)?((?:{STARTS})[ :])", "\x01$1"))
#: Comment marks at line starts, quotes, and runs of white space.
CLEANED = ((r"(?:^|\n)[ \t]*(?:[*#/;-]+|<!--)", " "), ("[\"'`\u201c\u201d\u2018\u2019]", ""), (r"[ \t\r\n]+", " "))


def sentences(text: Column) -> Column:
    """The text's normalised sentences."""
    for pattern, by in BREAKS:
        text = F.regexp_replace(text, pattern, by)
    def normal(s):
        for pattern, by in CLEANED:
            s = F.regexp_replace(s, pattern, by)
        return F.trim(F.lower(s))
    return F.transform(F.split(text, "\x01", -1), normal)


def identifier(sentence: Column) -> Column:
    """``<Name>`` or ``<Name:version>`` of a known sentence, else null."""
    known = F.lit(None).cast("string")
    for name, pattern, version in reversed(SENTENCES):
        pattern = "(?s)" + pattern
        named = (F.concat(F.lit(f"<{name}:"), F.regexp_extract(sentence, pattern, 1), F.lit(">"))
                 if version else F.lit(f"<{name}>"))
        known = F.when(sentence.rlike(pattern), named).otherwise(known)
    return known


def identifiers(text: Column) -> Column:
    """The sequence of a text's identifiers, as one string."""
    def has_clue(s):
        clue = F.lit(False)
        for c in CLUES:
            clue = clue | s.contains(c)
        return clue | s.rlike(CC)
    found = F.transform(F.filter(sentences(text), has_clue), identifier)
    return F.when(has_clue(F.translate(F.lower(text), QUOTES, "")), F.array_join(found, "")).otherwise(F.lit(""))


def read_rules(sequence: Column) -> Column:
    """Struct of ``licences`` (names, in the order of the rules) and ``rest`` (identifiers no rule used)."""
    rules = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(n).alias("n")) for p, n in RULES])
    begin = F.struct(F.array().cast("array<string>").alias("licences"), sequence.alias("rest"))

    def step(acc, rule):
        hits = F.regexp_extract_all(acc["rest"], rule["p"], F.lit(0))
        names = F.transform(hits, lambda h: F.regexp_replace(h, rule["p"], rule["n"]))
        return F.struct(F.concat(acc["licences"], F.array_sort(F.array_distinct(names))).alias("licences"),
                        F.regexp_replace(acc["rest"], rule["p"], F.lit("")).alias("rest"))
    return F.when(sequence == "", begin).otherwise(F.aggregate(rules, begin, step))


def scan(docs: DataFrame, keep=("doc_id",), text: str = "text") -> DataFrame:
    """Add ``sequence`` (identifiers), ``licences`` (array of names) and ``rest`` to every row.

    Of other columns those in ``keep`` are returned; a null or empty text has no
    identifiers. Repeated sentences repeat their identifier; a licence named
    several times is listed once per rule.
    """
    marked = docs.select(*keep, identifiers(text_of(text)).alias("sequence"))
    # the sequence is computed once: the rules read it many times
    read = marked.withColumn("_read", F.explode(F.array(read_rules(F.col("sequence")))))
    return read.select(*keep, "sequence", F.col("_read.licences").alias("licences"), F.col("_read.rest").alias("rest"))


def plain_sql(source: str = "documents") -> str:
    """The scan as DuckDB SQL: ``doc_id``, ``sequence``, ``licences`` (joined by commas), ``rest``."""
    def text(s):
        return "'" + s.replace("'", "''") + "'"

    def swapped(by):  # group marks of the other dialect
        return text(by.replace("$1", "\\1").replace("$2", "\\2")).replace("\x01", "' || chr(1) || '")
    cut, normal = "coalesce(text, '')", "s"
    for p, by in BREAKS:
        cut = f"regexp_replace({cut}, {text(p)}, {swapped(by)}, 'g')"
    for p, by in CLEANED:
        normal = f"regexp_replace({normal}, {text(p)}, {text(by)}, 'g')"
    cases = " ".join(f"WHEN regexp_matches(s, {text('(?s)' + p)}) THEN " + (
        f"'<{n}:' || regexp_extract(s, {text('(?s)' + p)}, 1) || '>'" if v else f"'<{n}>'") for n, p, v in SENTENCES)
    steps = ["r0 AS (SELECT doc_id, sequence, sequence AS rest, CAST([] AS VARCHAR[]) AS licences FROM q)"]
    for i, (p, n) in enumerate(RULES):
        steps.append(f"r{i + 1} AS (SELECT doc_id, sequence, regexp_replace(rest, {text(p)}, '', 'g') AS rest, list_concat(licences, "
                     f"list_sort(list_distinct([regexp_replace(h, {text(p)}, {swapped(n)}) FOR h IN regexp_extract_all(rest, {text(p)})]))) AS licences FROM r{i})")
    return (f"WITH c AS (SELECT doc_id, string_split({cut}, chr(1)) AS parts FROM {source}), "
            f"n AS (SELECT doc_id, [trim(lower({normal})) FOR s IN parts] AS parts FROM c), "
            f"q AS (SELECT doc_id, array_to_string([CASE {cases} ELSE '' END FOR s IN parts], '') AS sequence FROM n), "
            f"{', '.join(steps)} SELECT doc_id, sequence, array_to_string(licences, ',') AS licences, rest FROM r{len(RULES)}")
