"""License scan: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

A rule is a regular expression over a text's words (lower-cased, joined by single spaces), with a label, a keyword that every
match contains, a priority and a weight. There are rules of three kinds: signatures written by hand of what licenses say
(grants, conditions, disclaimers, notices), SPDX expressions, and names of licenses with their versions. A text is looked
at only around words that are some rule's keyword, and only by those keywords' rules; no rule goes further than REACH words
from its keyword, with what it looks ahead at, so nothing is lost by that. Of overlapping detections one is dropped when
another of no lower priority contains it; equal ones stay once for each label. Time is in proportion to a text's length and mentions.

Base phrases are reported at every place, whatever the rules say. Defined cases: null and empty texts have no words and no
labels, score 0; rows are independent, so repeated rows get equal results; very long texts and texts of many mentions are
looked at whole, one after another; extra columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, with_fields
from .vectext import Words, bitmap, chunks, find_words, member, windows

#: Words on either side of a keyword that a rule may reach.
REACH = 24
#: Phrases and labels that are always reported.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keyword: str
    priority: int
    weight: float


@dataclass(frozen=True)
class Family:
    """Names of a license (regular expressions over words), the keyword in each, its label and its versions."""

    label: str
    names: tuple[tuple[str, str], ...]
    versions: tuple[str, ...] = ()


FAMILIES = (
    Family("agpl", (("gnu affero general public license", "affero"), ("affero general public license", "affero"), ("(?:gnu )?agpl", "agpl")), ("3 0", "3")),
    Family("lgpl", (("gnu (?:lesser|library) general public license", "gnu"), ("(?:lesser|library) general public license", "public"), ("(?:gnu )?lgpl", "lgpl")), ("2 1", "2 0", "3 0", "2", "3")),
    Family("gfdl", (("gnu free documentation license", "documentation"), ("gfdl", "gfdl")), ("1 1", "1 2", "1 3")),
    Family("gpl", (("gnu general public license", "gnu"), ("general public license", "general"), ("(?:gnu )?gpl", "gpl")), ("2 0", "3 0", "1", "2", "3")),
    Family("apache", (("apache license", "apache"), ("apache software license", "apache"), ("asl", "asl")), ("2 0", "1 1", "1 0", "2")),
    Family("mpl", (("mozilla public license", "mozilla"), ("mpl", "mpl")), ("2 0", "1 1", "1 0")),
    Family("epl", (("eclipse public license", "eclipse"), ("epl", "epl")), ("2 0", "1 0")),
    Family("cddl", (("common development and distribution license", "distribution"), ("cddl", "cddl")), ("1 0", "1 1")),
    Family("eupl", (("european union public licen[cs]e", "european"), ("eupl", "eupl")), ("1 0", "1 1", "1 2")),
    Family("osl", (("open software license", "software"), ("osl", "osl")), ("1 0", "2 0", "2 1", "3 0")),
    Family("afl", (("academic free license", "academic"), ("afl", "afl")), ("1 2", "2 0", "2 1", "3 0")),
    Family("artistic", (("artistic license", "artistic"), ("perl artistic", "artistic")), ("1 0", "2 0")),
    Family("boost", (("boost software license", "boost"), ("bsl", "bsl")), ("1 0",)),
    Family("zlib", (("zlib license", "zlib"), ("zlib libpng", "zlib"))),
    Family("isc", (("isc license", "isc"), ("internet systems consortium license", "consortium"))),
    Family("mit", (("mit license", "mit"), ("expat license", "expat"), ("mit x11", "mit"))),
    Family("bsd-2-clause", (("bsd 2 clause", "bsd"), ("simplified bsd", "bsd"), ("freebsd license", "freebsd"))),
    Family("bsd-3-clause", (("bsd 3 clause", "bsd"), ("(?:new|revised|modified) bsd", "bsd"))),
    Family("bsd-4-clause", (("bsd 4 clause", "bsd"), ("original bsd", "bsd"))),
    Family("bsd", (("bsd license", "bsd"), ("berkeley software distribution", "berkeley"))),
    Family("unlicense", (("the unlicense", "unlicense"), ("unlicense org", "unlicense"))),
    Family("wtfpl", (("wtfpl", "wtfpl"),), ("2",)),
    Family("python", (("python software foundation license", "python"), ("psf license", "psf")), ("2",)),
    Family("php", (("php license", "php"),), ("3 0", "3 01")),
    Family("ruby", (("ruby license", "ruby"),)),
    Family("postgresql", (("postgresql licen[cs]e", "postgresql"),)),
    Family("openssl", (("openssl license", "openssl"),)),
    Family("odbl", (("open database license", "database"), ("odbl", "odbl")), ("1 0",)),
    Family("ofl", (("sil open font license", "font"), ("open font license", "font")), ("1 0", "1 1")),
    Family("public-domain", (("(?:released|dedicated|placed) (?:to|into|in) the public domain", "domain"), ("public domain dedication", "domain"))),
    Family("proprietary", (("all rights reserved", "reserved"), ("proprietary and confidential", "proprietary"), ("may not be (?:copied|reproduced|distributed)", "may"))),
)
#: Creative Commons: elements after "by", shortest last, so that labels grow with what is named.
CC_ELEMENTS = (("nc nd", "nc-nd"), ("nd nc", "nc-nd"), ("nc sa", "nc-sa"), ("nc", "nc"), ("nd", "nd"), ("sa", "sa"), ("", ""))
CC_LONG = {"nc-nd": "non ?commercial no derivatives?", "nc-sa": "non ?commercial share ?alike", "nc": "non ?commercial", "nd": "no derivatives?", "sa": "share ?alike", "": ""}
CC_VERSIONS = ("4 0", "3 0", "2 5", "2 0", "1 0")


#: What licenses say: label, keyword, pattern. Fixed phrases of public license texts.
SIGNATURES = (
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "permission", "(?:the )?above copyright notice and this permission notice(?: including the next paragraph)? shall be (?:included|reproduced) in all copies"),
    ("mit", "merge", "to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "warranty", "the software is provided as is without warranty of any kind express or implied"),
    ("mit-0", "attribution", "mit no attribution"),
    ("x11", "advertising", "shall not be used in advertising or otherwise to promote the sale use or other dealings"),
    ("isc", "fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims", "the author disclaims all warranties with regard to this software"),
    ("0bsd", "zero", "(?:bsd )?zero clause(?: bsd)?(?: license)?"),
    ("hpnd", "documentation", "permission to use copy modify and(?: or)? distribute this software and its documentation for any purpose(?: and without fee| with or without fee)? is hereby granted"),
    ("postgresql", "agreement", "for any purpose without fee and without a written agreement is hereby granted"),
    ("boost-1.0", "organization", "free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse", "(?:neither the names? of (?:\\w+ ){1,8}nor the names of (?:its|any) contributors|the name of the author) may (?:not )?be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("bsd", "warranties", "this software is provided by (?:\\w+ ){1,8}as is and any express or implied warranties"),
    ("bsd-3-clause-clear", "patent", "no express or implied licenses to any (?:party s|party) patent rights are granted"),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "applicable", "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("apache-2.0", "conditions", "on an as is basis without warranties or conditions of any kind"),
    ("apache-2.0", "apache", "www apache org licenses license 2 0"),
    ("apache-1.1", "apache", "this product includes software developed by the apache (?:software foundation|group)"),
    ("gpl", "redistribute", "(?:this|it) (?:program )?is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "hope", "is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl", "received", "you should have received a copy of the gnu general public license along with"),
    ("gpl-2-or-later", "option", "either version 2 of the license or at your option any later version"),
    ("gpl-3-or-later", "option", "either version 3 of the license or at your option any later version"),
    ("gpl-2", "published", "gnu general public license version 2(?: only)? as published by the free software foundation"),
    ("gpl", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl", "copyleft", "the gnu general public license is a free copyleft license"),
    ("gpl-exception-classpath", "classpath", "(?:gnu )?classpath exception"),
    ("gpl-exception-linking", "exception", "as a special exception (?:\\w+ ){1,10}permission to link"),
    ("lgpl", "received", "you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl", "redistribute", "is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1-or-later", "option", "either version 2 1 of the license or at your option any later version"),
    ("lgpl", "derivative", "contains no derivative of any portion of the library but is designed to work with the library"),
    ("agpl", "received", "you should have received a copy of the gnu affero general public license"),
    ("agpl", "redistribute", "redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl", "remotely", "your modified version must prominently offer all users interacting with it remotely"),
    ("gfdl", "document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "invariant", "with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl", "covered", "covered software is provided under this license on an as is basis"),
    ("epl", "eclipse", "(?:this program and )?the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "distribution", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl", "european", "open source licence for the european union"),
    ("artistic", "package", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", "perl", "(?:you can redistribute it and or modify it )?under the same terms as perl itself"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "compile", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "fuck", "do what the fuck you want to(?: public license)?"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "plainly", "altered source versions must be plainly marked as such"),
    ("zlib", "arising", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("python-2", "licensee", "psf is making python (?:\\w+ ){0,4}available to licensee on an as is basis"),
    ("php", "php", "this source file is subject to version [0-9]+(?: [0-9]+)? of the php license"),
    ("openssl", "openssl", "this product includes (?:software developed by the openssl project|cryptographic software)"),
    ("ssleay", "cryptographic", "this product includes cryptographic software written by eric young"),
    ("ofl", "font", "this font software is licensed under the sil open font license"),
    ("ofl", "bundled", "may be bundled redistributed and or sold with any software"),
    ("ms-pl", "microsoft", "microsoft public license"),
    ("ms-rl", "microsoft", "microsoft reciprocal license"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("beerware", "beer", "(?:you can )?buy me a beer in return"),
    ("beerware", "beerware", "beerware(?: license)?"),
    ("sspl", "server", "server side public license"),
    ("busl", "business", "business source license"),
    ("elastic", "elastic", "elastic license(?: 2 0| v2)?"),
    ("commons-clause", "commons", "commons clause(?: license)? condition"),
    ("cdla", "community", "community data license agreement(?: permissive| sharing)?"),
    ("odc-by", "commons", "open data commons attribution license"),
    ("odbl", "commons", "open data commons open database license"),
    ("pddl", "commons", "open data commons public domain dedication"),
    ("cc", "medium", "you are free to share copy and redistribute the material in any medium or format"),
    ("cc-by", "credit", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-nc", "commercial", "you may not use the material for commercial purposes"),
    ("cc-by-sa", "remix", "if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc-by-nd", "remix", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc0", "deed", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "waived", "to the extent possible under law (?:\\w+ ){1,8}has waived all copyright"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|distribution|reproduction) of this (?:\\w+ ){1,4}(?:via any medium )?is (?:strictly )?prohibited"),
    ("proprietary", "reproduced", "no part of this (?:\\w+ )?may be reproduced(?: stored| distributed| transmitted)?"),
    ("proprietary", "confidential", "contains? (?:confidential and proprietary|proprietary and confidential) information"),
    ("proprietary", "eula", "(?:this )?eula"),
    ("proprietary", "user", "end user licen[cs]e agreement"),
    ("proprietary", "agree", "by (?:downloading|installing|using|accessing) (?:\\w+ ){1,6}you agree to"),
    ("proprietary", "reverse", "you may not (?:\\w+ ){0,6}reverse engineer"),
)
#: SPDX identifiers as words. Fixed values.
SPDX = (
    "mit", "mit 0", "isc", "0bsd", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "bsd 3 clause clear", "apache 1 1", "apache 2 0", "gpl 1 0 only", "gpl 1 0 or later", "gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later",
    "gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later", "lgpl 2 0 only", "lgpl 2 0 or later", "lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later", "agpl 3 0",
    "agpl 3 0 only", "agpl 3 0 or later", "gfdl 1 3 or later", "mpl 1 1", "mpl 2 0", "epl 1 0", "epl 2 0", "cddl 1 0", "cddl 1 1", "eupl 1 1", "eupl 1 2", "osl 3 0", "afl 3 0", "artistic 1 0", "artistic 2 0",
    "bsl 1 0", "zlib", "unlicense", "wtfpl", "python 2 0", "psf 2 0", "php 3 01", "ruby", "postgresql", "openssl", "odbl 1 0", "pddl 1 0", "ofl 1 1", "ms pl", "ms rl", "json", "busl 1 1", "sspl 1 0", "elastic 2 0",
    "cc0 1 0", "cc by 3 0", "cc by 4 0", "cc by sa 3 0", "cc by sa 4 0", "cc by nc 4 0", "cc by nd 4 0", "cc by nc sa 4 0", "cc by nc nd 4 0", "hpnd", "x11", "classpath exception 2 0", "llvm exception",
)


def spdx_label(words: str) -> str:
    """An identifier from its words: 'bsd 3 clause' -> 'bsd-3-clause', 'gpl 2 0 only' -> 'gpl-2.0-only'."""
    return re.sub(r"(?<=\d)-(?=\d)", ".", words.replace(" ", "-"))


#: Any of the identifiers, longest first; and the label of a rule whose identifiers are detections of their own.
SPDX_ID = re.compile("(?:" + "|".join(sorted(SPDX, key=len, reverse=True)) + r")(?!\S)")
EXPRESSION = "spdx expression"


def rules() -> list[Rule]:
    """All rules, in order: signatures, SPDX expressions, then a family's versioned phrases, its bare names and its names in a grant."""
    out = [Rule(label, rf"(?:{pattern})", keyword, 4, 0.95) for label, keyword, pattern in SIGNATURES]
    out.append(Rule(EXPRESSION, rf"spdx license identifier {SPDX_ID.pattern}(?: (?:or|and|with) {SPDX_ID.pattern})*", "spdx", 6, 0.99))
    for f in FAMILIES:
        for name, keyword in f.names:
            for v in f.versions:
                label = f"{f.label}-{v.replace(' ', '.')}"
                out.append(Rule(label, rf"(?:the )?{name}(?: as published by the free software foundation)?(?: either)?(?: version| v)? v?{v}(?! ?\d)", keyword, 3, 0.95))
                out.append(Rule(f"{label}-or-later", rf"{name}(?: either)?(?: version| v)? v?{v} (?:or(?: at your option)? (?:any )?later|or newer)(?: version)?", keyword, 4, 0.97))
            out.append(Rule(f.label, name, keyword, 1, 0.6 if " " in name else 0.4))
            out.append(Rule(f.label, rf"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?{name}", keyword, 2, 0.9))
    for short, tail in CC_ELEMENTS:
        label = "cc-by" + ("-" + tail if tail else "")
        names = [("cc by" + (" " + short if short else ""), "cc"), ("creative commons attribution" + (" " + CC_LONG[tail] if tail else ""), "creative")]
        for name, keyword in names:
            for v in CC_VERSIONS:
                out.append(Rule(f"{label}-{v.replace(' ', '.')}", rf"{name}(?: international| unported| generic)? (?:license )?{v}", keyword, 3, 0.95))
            out.append(Rule(label, name, keyword, 1, 0.6))
            out.append(Rule(label, rf"(?:licensed|released|distributed|available|published) under (?:a |the )?{name}", keyword, 2, 0.9))
    out.append(Rule("cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0", 2, 0.9))
    out.append(Rule("spdx", rf"spdx license identifier (?!{SPDX_ID.pattern})\w+", "spdx", 2, 0.9))
    return list(dict.fromkeys(out))


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    label: str
    priority: int
    weight: float


def resolve(found: list[Detection]) -> list[Detection]:
    """Detections by place, without those that another of no lower priority contains; of equal ranges those of highest priority.

    One sweep: whatever contains a detection begins no later, so it is enough to know, by priority, how far those before reach.
    """
    kept: list[Detection] = []
    levels = sorted({d.priority for d in found})
    reach = dict.fromkeys(levels, -1)
    order = sorted(set(found), key=lambda d: (d.start, -d.end, -d.priority, d.label))
    a = 0
    while a < len(order):
        b = a
        while b < len(order) and (order[b].start, order[b].end) == (order[a].start, order[a].end):
            b += 1
        top = order[a].priority
        if max(reach[p] for p in levels if p >= top) < order[a].end:
            kept += [d for d in order[a:b] if d.priority == top]
        for d in order[a:b]:
            reach[d.priority] = max(reach[d.priority], d.end)
        a = b
    return sorted(kept, key=lambda d: (d.start, d.end, d.label))


class Scanner:
    def __init__(self, order: list[Rule] | None = None):
        order = rules() if order is None else order
        self.by_keyword: dict[bytes, list[tuple[Rule, re.Pattern[str]]]] = {}
        for r in order:
            self.by_keyword.setdefault(r.keyword.encode(), []).append((r, re.compile(rf"(?<!\S){r.pattern}(?!\S)")))
        keys = list(self.by_keyword)
        w = _words_of(keys)
        self.keys = dict(zip(w.h.tolist(), keys))
        self.hashes = np.sort(w.h)
        self.bits = bitmap(self.hashes)
        self.base = []
        for phrase in BASE:
            p = _words_of([phrase.encode()])
            table = windows(p, len(p))[1]
            self.base.append((phrase.encode(), len(p), table, bitmap(table), BASE[phrase]))

    def places(self, w: Words) -> list[tuple[int, str]]:
        """Every place of a base phrase: (word, label)."""
        out = []
        for phrase, n, table, bits, label in self.base:
            at, g = windows(w, n)
            out += [(int(p), label) for p in at[member(g, table, bits)] if w.text(int(p), n) == phrase]
        return sorted(out)

    def detections(self, w: Words) -> dict[int, list[Detection]]:
        """Resolved detections by row, words counted from the row's first."""
        hits = member(w.h, self.hashes, self.bits)
        out: dict[int, list[Detection]] = {}
        rows = np.searchsorted(w.ptr, hits, "right") - 1
        for r in np.unique(rows).tolist():
            own, first, last = hits[rows == r], int(w.ptr[r]), int(w.ptr[r + 1])
            edges = np.flatnonzero(np.diff(own) > 2 * REACH) + 1
            found: list[Detection] = []
            for part in np.split(own, edges):
                a, b = max(first, int(part[0]) - REACH), min(last, int(part[-1]) + REACH + 1)
                words = [w.low[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(w.start[a:b].tolist(), w.end[a:b].tolist())]
                text, begins, at = " ".join(words), [], 0
                for word in words:
                    begins.append(at)
                    at += len(word) + 1
                for key in {self.keys[int(h)] for h in w.h[part]}:
                    for rule, pattern in self.by_keyword[key]:
                        matches = pattern.finditer(text)
                        if rule.label == EXPRESSION:
                            matches = (x for m in matches for x in SPDX_ID.finditer(text, m.start() + len("spdx license identifier"), m.end()))
                        for m in matches:
                            s = a - first + bisect_right(begins, m.start()) - 1
                            found.append(Detection(s, s + m[0].count(" ") + 1, spdx_label(m[0]) if rule.label == EXPRESSION else rule.label, rule.priority, rule.weight))
            if found:
                out[r] = resolve(found)
        return out


def _words_of(texts: list[bytes]) -> Words:
    offs = np.cumsum([0, *map(len, texts)])
    return find_words(np.frombuffer(b"".join(texts), np.uint8), offs)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, base (places: word and label), found (detections: words, label, weight)."""
    src = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    schema = with_fields(docs.select(col(id_col)), "n_words long, base array<struct<at:bigint,label:string>>, found array<struct<start:bigint,end:bigint,label:string,weight:double>>")
    base_type = pa.list_(pa.struct([("at", pa.int64()), ("label", pa.string())]))
    found_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("weight", pa.float64())]))

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            for a, b, raw, offs in chunks(batch.column(1)):
                w = find_words(raw, offs)
                base: list[list] = [[] for _ in range(b - a)]
                for p, label in scanner.places(w):
                    r = int(np.searchsorted(w.ptr, p, "right")) - 1
                    base[r].append({"at": p - int(w.ptr[r]), "label": label})
                found: list[list] = [[] for _ in range(b - a)]
                for r, own in scanner.detections(w).items():
                    found[r] = [{"start": d.start, "end": d.end, "label": d.label, "weight": d.weight} for d in own]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(w.ptr)), pa.array(base, base_type), pa.array(found, found_type)], names=schema.names)

    return src.mapInArrow(run, schema)
