"""License scans by sentence rules.

A text is split at sentence ends and line ends, without the comment markers its lines begin with. A run of pieces
that normalises to a known licence sentence is that sentence, and the sequence of identifiers found is matched
against an ordered list of licence rules: at each place the first rule that fits wins and its sentences are used
up. At most MAX_GAP unknown sentences may stand between two of a rule.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import slices

MAX_GAP = 3

# Known licence sentences by identifier.
SENTENCES = {
    "rights-reserved": ("All rights reserved.",),
    "mit-name": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "mit-notice": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."),
    "mit-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    "mit-condition": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "as-is-software": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "apache2-notice": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License");',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ),
    "apache2-compliance": ("you may not use this file except in compliance with the License.",),
    "apache2-copy": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"),
    "gpl3-notice": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is licensed under the GNU General Public License, version 3.",
    ),
    "gpl-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "gpl2-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "gpl-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "bsd-endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "mpl2-notice": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
}
# Ordered rules (licence, identifiers in sequence); the first that fits at a place wins.
RULES = (
    ("MIT", ("mit-name", "rights-reserved", "mit-grant", "mit-condition", "as-is-software")),
    ("MIT", ("mit-name", "mit-grant", "mit-condition", "as-is-software")),
    ("MIT", ("mit-grant", "mit-condition", "as-is-software")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache2-notice", "apache2-compliance", "apache2-copy")),
    ("Apache-2.0", ("apache2-notice", "apache2-copy")),
    ("GPL-3.0-or-later", ("gpl-or-later", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl2-or-later", "gpl-warranty")),
    ("GPL-3.0-or-later", ("gpl-or-later",)),
    ("GPL-2.0-or-later", ("gpl2-or-later",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("Apache-2.0", ("apache2-notice",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-name",)),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC0-1.0", ("cc0",)),
    ("all-rights-reserved", ("rights-reserved",)),
)

SENTENCE = re.compile(r"\S(?:[^.!?:;\n]|[.!?:;](?!\s|$)|\n(?!\s*\n))*[.!?:;]*")
# what a line of a comment begins with, and what ends a comment
MARKERS = re.compile(r"^[ \t]*(?:<!--|/\*+|\*+/?|//[/!]*|#+|--+>?|;+|%+|!+|>+|\.\\\"|(?:@?rem|dnl|c)(?=[ \t\r]|$)|::)|(?:\*/|-->)(?=[ \t\r]*$)", re.I | re.M)
_OTHER = re.compile(r"[^a-z0-9.+]+")


def normalise(sentence: str) -> str:
    """Lower case, punctuation folded to spaces, points kept only inside a token."""
    return " ".join(w.strip(".") for w in _OTHER.sub(" ", sentence.lower()).split() if w.strip("."))


KNOWN = {normalise(s): name for name, forms in SENTENCES.items() for s in forms}
LONGEST = max(len(k.split()) for k in KNOWN)
BEGINNINGS = {" ".join(w[:n]) for w in map(str.split, KNOWN) for n in range(1, len(w))}
# every known sentence has one of these words, so a text without them needs no splitting
TRIGGERS = ("licen", "permission", "permitted", "rights", "redistribut", "warranty", "endorse", "released", "copy")


def pieces(text: str) -> list[tuple[int, int, int, int, int, str]]:
    """(paragraph, sentence, place, start, end, normalised) of the lines of every sentence, without empty ones.

    place numbers the sentences for MAX_GAP; what has no sentence ends counts as one sentence for every LONGEST words.
    """
    plain = MARKERS.sub(lambda m: " " * len(m[0]), text)
    out, paragraph, end, place = [], 0, 0, -1
    for k, m in enumerate(SENTENCE.finditer(plain)):
        paragraph += plain.count("\n", end, m.start()) > 1
        at, end = m.start(), m.end()
        place, count = place + 1, 0
        for line in m[0].split("\n"):
            if words := normalise(line):
                if count >= LONGEST:
                    place, count = place + 1, 0
                count += words.count(" ") + 1
                out.append((paragraph, k, place, at + len(line) - len(line.lstrip()), at + len(line.rstrip()), words))
            at += len(line) + 1
    return out


def sentence_ids(text: str) -> list[tuple[int, int, int, str]]:
    """(place, start, end, identifier) of the known sentences of text, in order.

    A known sentence begins and ends at a line's or a sentence's end and stays in its paragraph. The longest run of
    lines of one sentence is taken; if none is known, the run goes on over sentence ends and counts as one sentence.
    """
    low = text.lower()
    if not any(t in low for t in TRIGGERS):
        return []
    parts, out, i, joined = pieces(text), [], 0, 0
    while i < len(parts):
        paragraph, k, place, start, _, words = parts[i]
        j, last = i, None
        while True:
            if words in KNOWN:
                last, name = j, KNOWN[words]
            j += 1
            if words not in BEGINNINGS or j == len(parts) or parts[j][0] != paragraph or (last is not None and parts[j][1] != k):
                break
            words += " " + parts[j][5]
        if last is None:
            i += 1
        else:
            out.append((place - joined, start, parts[last][4], name))
            joined += parts[last][2] - place
            i = last + 1
    return out


def match_rules(found: list[tuple[int, int, int, str]], rules=RULES, max_gap: int = MAX_GAP) -> list[tuple[str, int, int]]:
    """(licence, start, end) of each rule matched, left to right."""
    out, at = [], 0
    while at < len(found):
        for licence, want in rules:
            part = found[at : at + len(want)]
            near = all(b[0] - a[0] <= max_gap + 1 for a, b in zip(part, part[1:]))
            if near and tuple(p[3] for p in part) == want:
                out.append((licence, part[0][1], part[-1][2]))
                at += len(want)
                break
        else:
            at += 1
    return out


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, licenses, sentences, matches array<struct<license, start, end>>) for every row.

    licenses and sentences are comma-joined, the former distinct and sorted, the latter in order; offsets count
    characters. Null and empty texts match nothing; null ids and repeated rows pass through; other columns are
    not read; an empty table gives no rows.
    """
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in slices(batches):
            found = [sentence_ids(t or "") for t in b.column("t").to_pylist()]
            hits = [match_rules(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([",".join(sorted({h[0] for h in x})) for x in hits], pa.string()),
                    pa.array([",".join(f[3] for f in x) for x in found], pa.string()),
                    pa.array([[dict(zip(("license", "start", "end"), h)) for h in x] for x in hits], kind),
                ],
                ["doc_id", "licenses", "sentences", "matches"],
            )

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, "doc_id long, licenses string, sentences string, matches array<struct<license:string,start:long,end:long>>")


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licences found in every document."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "licenses", "sentences", F.size("matches").alias("n_matches"), "matches")
