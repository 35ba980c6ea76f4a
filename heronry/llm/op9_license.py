"""License scanning: TF-IDF cosine to templates, and inheritance by folders.

Around each cue word of a file (the rarest word that each template needs, so that no window
that counts is without one), windows of words, each as long as a template, slide over its
lines joined (comment marks and line ends are no words) and are compared with the template:
words weighted by their frequency and how few templates have them, as sparse vectors, by
cosine. Templates are names of licences with their versions and variants, statements, header
blocks and short licences. A window counts from ``LEAST`` on, and only if it has all words of the
template that distinguish licences (names, versions, variants; its two rarest words if it has none) and none of others; of windows
that overlap, the one with most words, by cosine, is taken. Texts that begin like one of the
licences in the folder ``licenses`` are also compared as a whole. SPDX expressions
give each identifier in them, known or not. "Only" and "or later" aren't told apart; a licence
named without its version, or its number of clauses, gets the family's name, such as GPL or BSD.
Of overlapping windows with equal words by cosine the one in the template's order wins, then the first in the text, then the last by name.
A file's own licences are those of all its found
spans. A file is a licence file if its name says so, or if found spans are at least
half of its characters. A file without a licence of its own inherits from the licence
files of its nearest ancestor folder: the folders that occur are joined, level by
level, to folders with licence files, and files are joined to their folder's answer. Several
licences of one folder are all given, sorted.

Defined results: a null text counts as empty; a null path has no folder and inherits nothing; a file
without any licence has null; rows may repeat; other columns aren't read; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.llm.common import id_field, map_texts, materialise

_GRANT = "is free software you can redistribute it and or modify it under the terms of the GNU {} as published by the Free Software Foundation either version {} of the License or at your option any later version"
_GNU = {"GPL": "General Public License", "LGPL": "Lesser General Public License", "AGPL": "Affero General Public License"}
_BSD = "Redistribution and use in source and binary forms with or without modification are permitted"
_BSD_2 = (
    f"{_BSD} provided that the following conditions are met Redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "Redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_NEITHER = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"


def _templates() -> dict[str, tuple[str, ...]]:
    t: dict[str, list[str]] = {
        "Apache-2.0": ["Apache License 2.0", "Apache 2.0", "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License Version 2.0 you may not use this file except in compliance with the License You may obtain a copy of the License at"],
        "Apache-1.1": ["Apache License 1.1", "Apache Software License 1.1"],
        "Apache": ["Licensed under the Apache License"],
        "MIT": ["MIT License", "Released under the MIT License.", "Licensed under MIT", "MIT licensed", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
        "ISC": ["ISC License", "Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
        "BSD": ["BSD License", _BSD],
        "BSD-2-Clause": ["BSD 2 Clause", "Simplified BSD License", "2 Clause BSD", _BSD_2],
        "BSD-3-Clause": ["BSD 3 Clause", "New BSD License", "Modified BSD License", "Revised BSD License", "Licensed under the BSD 3-Clause License.", f"{_BSD_2} {_NEITHER}"],
        "BSD-4-Clause": ["BSD 4 Clause", "Original BSD License", f"{_BSD_2} All advertising materials mentioning features or use of this software must display the following acknowledgement This product includes software developed by {_NEITHER}"],
        "MPL-2.0": ["Mozilla Public License 2.0", "MPL 2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License v 2.0 If a copy of the MPL was not distributed with this file You can obtain one at"],
        "MPL-1.1": ["Mozilla Public License 1.1", "MPL 1.1"], "MPL": ["Mozilla Public License"],
        "EPL-1.0": ["Eclipse Public License 1.0", "EPL 1.0"], "EPL-2.0": ["Eclipse Public License 2.0", "EPL 2.0"], "EPL": ["Eclipse Public License"],
        "CDDL-1.0": ["Common Development and Distribution License 1.0", "CDDL 1.0"], "CDDL-1.1": ["Common Development and Distribution License 1.1", "CDDL 1.1"],
        "EUPL-1.1": ["European Union Public Licence 1.1", "EUPL 1.1"], "EUPL-1.2": ["European Union Public Licence 1.2", "EUPL 1.2"],
        "Artistic-1.0": ["Artistic License 1.0"], "Artistic-2.0": ["Artistic License 2.0"], "Artistic": ["Artistic License"],
        "BSL-1.0": ["Boost Software License 1.0"], "Zlib": ["zlib License"], "WTFPL": ["WTFPL"],
        "Unlicense": ["This is free and unencumbered software released into the public domain", "Licensed under the Unlicense"],
        "CC0-1.0": ["CC0 1.0", "CC0", "Creative Commons Zero 1.0"],
    }
    for family, long in _GNU.items():
        t[family] = [f"GNU {long}", f"GNU {family}", f"licensed under the {family}"]
        for v in {"GPL": ("1.0", "2.0", "3.0"), "LGPL": ("2.1", "3.0"), "AGPL": ("1.0", "3.0")}[family]:
            t[f"{family}-{v}"] = [f"GNU {long} {v}", f"{family} {v}", f"GNU {family} {v}", _GRANT.format(long, v)]
    t["LGPL-2.0"] = ["GNU Library General Public License 2.0", _GRANT.format("Library General Public License", "2.0"), "LGPL 2.0"]
    t["GFDL"] = ["GNU Free Documentation License"]
    for v in ("1.1", "1.2", "1.3"):
        t[f"GFDL-{v}"] = [f"GNU Free Documentation License {v}", f"GFDL {v}"]
    words = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
    for kind in ("BY", "BY-NC", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        long = " ".join(words[k] for k in kind.split("-"))
        t[f"CC-{kind}"] = [f"CC {kind}", f"Creative Commons {long}"]
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            t[f"CC-{kind}-{v}"] = [f"CC {kind} {v}", f"Creative Commons {long} {v}", f"Creative Commons {long} {v} International License", f"Creative Commons {long} {v} Unported License"]
    return {name: tuple(lines) for name, lines in t.items()}


#: Names, statements and headers by licence identifier, and whole licences.
TEMPLATES = _templates()
TEXTS = Path(__file__).with_name("licenses")
LEAST, WHOLE = 0.6, 0.9
#: Words that distinguish licences: names, variants and clauses; version numbers do too.
_MARK = frozenset(
    "apache mit isc bsd mozilla mpl eclipse epl cddl eupl european artistic boost zlib wtfpl unlicense unencumbered cc0 zero gnu gpl lgpl agpl gfdl documentation lesser library affero "
    "attribution by noncommercial nc sharealike sa noderivatives nd cc creative simplified new modified revised original clause neither advertising".split()
)
_LOOSE = frozenset(("by", "new", "original", "modified", "library", "documentation", "zero", "neither", "advertising", "clause", "european", "creative", "attribution"))  # also words of prose
_CLAUSES = frozenset(("endorse", "advertising"))  # words of clauses that whole licences differ in
_WORD = re.compile(r"cc0|[a-z]+|[0-9]+(?:\.[0-9]+)*")
_JOINED = {"gplv": "gpl", "lgplv": "lgpl", "agplv": "agpl", "noderivs": "noderivatives", "licence": "license", "licenced": "licensed", "licences": "licenses"}
_SKIP = frozenset(("version", "v", "the"))
_NUMBER = re.compile(r"[0-9](?:\.[0-9])?$")
_SPDX = re.compile(r"(?i)spdx-license-identifier:[ \t]*([^\r\n]*)")
_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*")
_NAME = re.compile(r"(?i)^(?:licen[sc]e|copying|notice)(?:[.-][a-z0-9.]+)?$")


def words(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end): lower case, without "the" and "version", versions without a last ".0"."""
    out = []
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    for m in _WORD.finditer(low):
        w = _JOINED.get(m.group(), m.group())
        if w not in _SKIP:
            out.append((w[:-2] if w.endswith(".0") else w, m.start(), m.end()))
    return out


def terms(text: str) -> Counter:
    return Counter(w for w, *_ in words(text))


def marks(c) -> frozenset:
    """The distinguishing words among words."""
    return frozenset(w for w in c if w in _MARK or _NUMBER.match(w))


class Templates:
    """TF-IDF vectors of templates, and of whole licences with their beginnings."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        rows = [(name, terms(t)) for name, ts in sorted(templates.items()) for t in ts]
        df = Counter(w for _, c in rows for w in c)
        self.idf = {w: math.log((1 + len(rows)) / (1 + n)) + 1 for w, n in df.items()}
        self.other = math.log(1 + len(rows)) + 1  # a word of no template
        self.rows = [(name, self.vector(c)) for name, c in rows]
        # name, vector, number of words, and words that a window must have
        self.slide = []
        orders = [[w for w, *_ in words(t)] for _, ts in sorted(templates.items()) for t in ts]
        for (name, c), (_, v), order in zip(rows, self.rows, orders):
            n = sum(c.values())
            self.slide.append((name, v, n, marks(c) if n > 8 else frozenset(c), order))
        rare = lambda c: sorted((w for w in c if not _NUMBER.match(w)), key=lambda w: (df[w], -len(w), w))
        self.slide = [(name, v, n, need or frozenset(rare(v)[:2]), order) for name, v, n, need, order in self.slide]
        stem = lambda w: "licen" if w.startswith("licen") else "noderiv" if w == "noderivatives" else w  # noqa: E731  words() makes spellings one
        self.stems = [[stem(w) for w in rare(need)] for *_, need, _ in self.slide]  # what a text must hold for each template, rarest first
        self._cues: dict[frozenset, re.Pattern] = {}
        self.texts = []
        for f in sorted(TEXTS.glob("*.txt")):
            plain = [w for w, *_ in words(f.read_text("utf-8"))]
            version = next((i + 1 for i, w in enumerate(plain[:7]) if _NUMBER.match(w)), 2)
            self.texts.append((f.stem, self.vector(Counter(plain)), len(plain), f" {' '.join(plain[:version])} ", _CLAUSES & set(plain)))

    def possible(self, low: str) -> list[int]:
        """Numbers of the templates whose needed words all occur somewhere in a text."""
        has: dict[str, bool] = {}

        def holds(w: str) -> bool:
            if w not in has:
                has[w] = w in low
            return has[w]

        return [k for k, ws in enumerate(self.stems) if all(map(holds, ws))]

    def cues(self, rows: list[int]) -> re.Pattern:
        """Finds the rarest needed word of each of these templates."""
        words = frozenset(self.stems[k][0] for k in rows)
        if words not in self._cues:
            if len(self._cues) > 4096:
                self._cues.clear()
            self._cues[words] = re.compile("|".join(("(?<![a-z])" if len(w) < 4 else "") + w for w in sorted(words)))
        return self._cues[words]

    def vector(self, c: Counter) -> dict[str, float]:
        v = {w: n * self.idf.get(w, self.other) for w, n in c.items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / size for w, x in v.items()}

    def best(self, line: str) -> tuple[float, str]:
        """The highest cosine and its licence, the first by name if equal."""
        v = self.vector(terms(line))
        return max(((sum(x * v.get(w, 0.0) for w, x in t.items()), name) for name, t in self.rows), key=lambda r: r[0], default=(0.0, ""))

    def windows(self, part: list[str], rows: list[int]) -> list[tuple[float, bool, int, int, str, float]]:
        """(words by cosine, in order, first, after last, licence, cosine) of all windows that agree with one of the templates ``rows``."""
        have, out, norms = set(part), [], {}
        idf = [self.idf.get(w, self.other) for w in part]
        for name, v, n, need, order in map(self.slide.__getitem__, rows):
            if not need <= have or n > len(part):
                continue
            if n not in norms:
                c, total, norms[n] = Counter(), 0.0, []
                for i, w in enumerate(part):
                    total += idf[i] * idf[i] * (2 * c[w] + 1)
                    c[w] += 1
                    if i >= n:
                        x = part[i - n]
                        total -= idf[i - n] * idf[i - n] * (2 * c[x] - 1)
                        c[x] -= 1
                    norms[n].append(total)
            gain = [v.get(w, 0.0) * x for w, x in zip(part, idf)]
            dot = sum(gain[:n])
            for a in range(len(part) - n + 1):
                if a:
                    dot += gain[a + n - 1] - gain[a - 1]
                cosine = dot / math.sqrt(norms[n][a + n - 1])
                if cosine >= LEAST:
                    got = set(part[a : a + n])
                    others = marks(got) - _LOOSE - need
                    if n > 8 and not any(map(_NUMBER.match, need)):
                        others = {w for w in others if not _NUMBER.match(w)}  # numbers of paragraphs
                    if need <= got and not others:
                        out.append((round(n * cosine, 6), part[a : a + n] == order, a, a + n, name, min(1.0, cosine)))
        return out


def _spdx(text: str) -> list[tuple[int, int, str, float]]:
    out = []
    for m in _SPDX.finditer(text):
        ids = [i for i in _ID.finditer(m.group(1)) if i.group().upper() not in ("AND", "OR", "WITH")]
        skip = {i.start() for i, j in zip(ids[1:], ids) if re.search(r"(?i)\bwith\b", m.group(1)[j.end() : i.start()])}  # exceptions
        for i in ids:
            name = re.sub(r"(?i)(?:-only|-or-later|\+)$", "", i.group())
            if i.start() not in skip and re.search("[A-Za-z]", name):
                out.append((m.start() if i is ids[0] else m.start(1) + i.start(), m.start(1) + i.end(), _KNOWN.get(name.lower(), name), 1.0))
            if "(" not in m.group(1) and not re.match(r"\s*(?:(?i:and|or|with)\b|$)", m.group(1)[i.end() :]):
                break  # the expression ends; prose or a comment's end follows
    return out


_KNOWN = {name.lower(): name for name in TEMPLATES}


def scan(text: str, templates: Templates) -> list[tuple[int, int, str, float]]:
    """(start, end, licence, cosine) of a text's licence names, statements and headers, or of all of it."""
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text) if not text.isascii() else text.lower()
    rows = templates.possible(low)
    if not rows and "spdx" not in low:
        return []
    got = words(text)
    plain = [w for w, *_ in got]
    if templates.texts and got:
        head, v = f" {' '.join(plain[:60])} ", None
        for name, t, n, title, clauses in templates.texts:
            if 0.8 * n <= len(plain) <= 1.25 * n and title in head and _CLAUSES & set(plain) == clauses:
                v = v or templates.vector(Counter(plain))
                cosine = sum(x * v.get(w, 0.0) for w, x in t.items())
                if cosine >= WHOLE:
                    return [(0, len(text), name, min(1.0, cosine))]
    out = _spdx(text)
    starts = [a for _, a, _ in got]
    reach = max(n for _, _, n, *_ in templates.slide)
    parts: list[list[int]] = []
    for m in templates.cues(rows).finditer(low) if rows else ():
        at = bisect_left(starts, m.start() + 1) - 1
        a, b = max(0, at - reach), min(len(got), at + reach + 1)
        if parts and a <= parts[-1][1]:
            parts[-1][1] = b
        else:
            parts.append([a, b])
    taken = [(a, b) for a, b, *_ in out]
    found = sorted((r[0], r[1], -(a + r[2]), a + r[3], r[4], r[5]) for a, b in parts for r in templates.windows(plain[a:b], rows))
    for *_, first, last, name, cosine in reversed(found):
        a, b = got[-first][1], got[last - 1][2]
        if all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            out.append((a, b + len(re.match(r"[.,;:)\"']*", text[b : b + 8]).group()), name, cosine))
    return sorted(out)


def covered(found: list[tuple[int, int, str, float]]) -> int:
    """Characters of the found spans."""
    total = upto = 0
    for a, b, *_ in sorted(found):
        total += max(0, b - max(a, upto))
        upto = max(upto, b)
    return total


def license_scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Per file: id, path, own licences, best cosine, found spans, inherited licences, and all in one."""
    key = T.StructType([id_field(files, id_col), T.StructField("path", T.StringType())])
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("license", T.StringType()), T.StructField("cosine", T.DoubleType())])
    schema = T.StructType([T.StructField("key", key), T.StructField("found", T.ArrayType(span)), T.StructField("whole", T.BooleanType())])
    pairs = files.select(F.struct(F.col(id_col).alias(id_col), F.col(path_col).cast("string").alias("path")).alias("key"), F.col(text_col).alias("text"))

    templates = Templates()

    def work(ids, texts):
        found = [scan(t, templates) for t in texts]
        return {
            "key": ids,
            "found": [[dict(zip(("start", "end", "license", "cosine"), s)) for s in f] for f in found],
            "whole": [bool(f) and 2 * covered(f) >= len(t) for f, t in zip(found, texts)],
        }

    rows = map_texts(pairs, work, schema, "key", "text")
    names = F.array_sort(F.array_distinct(F.col("found.license")))
    folder = F.when(F.instr("key.path", "/") > 0, F.regexp_replace("key.path", "/[^/]*$", "")).otherwise(F.when(F.col("key.path").isNotNull(), F.lit("")))
    base = F.element_at(F.split("key.path", "/"), -1)
    rows = rows.select("key.*", "found", names.alias("own"), folder.alias("folder"), (F.size("found") > 0).alias("has"), (F.col("whole") | base.rlike(_NAME.pattern)).alias("file"))
    rows = materialise(rows, "license-rows")
    given = rows.filter("has AND file AND folder IS NOT NULL").groupBy("folder").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("own")))).alias("given"))
    given = given.withColumnRenamed("folder", "ancestor")
    folders = rows.filter("folder IS NOT NULL").select("folder").distinct()
    parts = F.split("folder", "/")
    up = folders.select("folder", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"))
    up = up.withColumn("ancestor", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.array_join(F.slice(F.split("folder", "/"), F.lit(1), F.greatest("depth", F.lit(1))), "/")))
    nearest = materialise(up.join(given, "ancestor").groupBy("folder").agg(F.max_by("given", "depth").alias("given")), "license-folders")
    out = rows.join(nearest, "folder", "left")
    inherited = F.when(~F.col("has"), F.col("given"))
    return out.select(id_col, "path", "own", F.array_max(F.col("found.cosine")).alias("cosine"), "found", inherited.alias("inherited"), F.when(F.col("has"), F.col("own")).otherwise(inherited).alias("licenses"))
