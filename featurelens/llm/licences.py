"""Licence recognition by sentences and ordered rules.

A text is normalised (case, comment marks, punctuation and spacing are dropped) and known
licence sentences are looked up in it: one may begin and end wherever a sentence or a line
does, so it is found in one line, wrapped over many, and with inner sentence ends. What is
found, in text order, is a sequence of sentence identifiers. Rules are tried in their order, longest licences
first: a rule matches where its identifiers follow each other with at most ``MAX_GAP``
sentences (not lines) between neighbours, and takes those identifiers away from later rules.
Identifiers that no rule takes are reported as leftovers.

Sentences end at a full stop, question mark, exclamation mark, colon or semicolon before
white space, and at an empty line; comment marks at line starts do not count. Whole texts
are read. A null or empty text has no licences, repeated rows give repeated results, null
ids are kept, an empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.llm import words
from featurelens.session import adapt

MAX_GAP = 3

# Sentences of published licences and the usual ways to name them.
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit-name": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This project is licensed under the MIT License",
        "This software is released under the MIT License",
        "The MIT License (MIT)",
        "MIT License",
        "SPDX-License-Identifier: MIT",
    ),
    "mit-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    "mit-notice": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "as-is": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ),
    "apache-2-name": (
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License")',
        "This project is licensed under the Apache License, Version 2.0",
        "Released under the Apache License, Version 2.0",
        "Apache License, Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "apache-2-comply": ("you may not use this file except in compliance with the License.",),
    "apache-2-as-is": (
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "gpl-3-name": (
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License, version 3",
        "Released under the GNU General Public License, version 3",
        "GNU General Public License v3.0",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "gpl-3-later-name": ("SPDX-License-Identifier: GPL-3.0-or-later",),
    "gpl-2-name": (
        "Licensed under the GNU General Public License, version 2",
        "GNU General Public License v2.0",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "gpl-2-later-name": ("SPDX-License-Identifier: GPL-2.0-or-later",),
    "gpl-3-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "gpl-2-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "gpl-no-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "lgpl-3-name": ("GNU Lesser General Public License v3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    "mpl-2-name": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "bsd-intro": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "bsd-source": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "bsd-endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "bsd-2-name": ("SPDX-License-Identifier: BSD-2-Clause", "BSD 2-Clause License"),
    "bsd-3-name": ("SPDX-License-Identifier: BSD-3-Clause", "BSD 3-Clause License"),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "isc-name": ("ISC License", "SPDX-License-Identifier: ISC"),
    "cc-by-nc-4-name": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under CC BY-NC 4.0",
        "Released under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-4-name": (
        "Licensed under CC BY 4.0",
        "This work is licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc0-name": ("SPDX-License-Identifier: CC0-1.0", "Licensed under CC0 1.0"),
    "all-rights": ("All rights reserved", "Copyright, all rights reserved"),
}

#: Ordered: a licence's own text comes before the names that may head it.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-3-Clause", ("bsd-intro", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-intro", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-name", "mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-name", "isc-grant")),
    ("ISC", ("isc-grant",)),
    ("GPL-3.0-or-later", ("gpl-3-or-later", "gpl-no-warranty")),
    ("GPL-3.0-or-later", ("gpl-3-or-later",)),
    ("GPL-2.0-or-later", ("gpl-2-or-later", "gpl-no-warranty")),
    ("GPL-2.0-or-later", ("gpl-2-or-later",)),
    ("Apache-2.0", ("apache-2-name", "apache-2-comply", "apache-2-as-is")),
    ("Apache-2.0", ("apache-2-name", "apache-2-comply")),
    ("Apache-2.0", ("apache-2-name",)),
    ("MIT", ("mit-name",)),
    ("GPL-3.0-only", ("gpl-3-name",)),
    ("GPL-3.0-or-later", ("gpl-3-later-name",)),
    ("GPL-2.0-only", ("gpl-2-name",)),
    ("GPL-2.0-or-later", ("gpl-2-later-name",)),
    ("LGPL-3.0-only", ("lgpl-3-name",)),
    ("MPL-2.0", ("mpl-2-name",)),
    ("BSD-2-Clause", ("bsd-2-name",)),
    ("BSD-3-Clause", ("bsd-3-name",)),
    ("ISC", ("isc-name",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-name",)),
    ("CC-BY-4.0", ("cc-by-4-name",)),
    ("CC0-1.0", ("cc0-name",)),
    ("LicenseRef-all-rights-reserved", ("all-rights",)),
)

#: Every known sentence holds one of these, so texts without them need no splitting.
TRIGGER = re.compile(r"licen|permi|warrant|redistribut|reserved|copyright|cc0|\bcc\W+by\b", re.I)

_MARKS = re.compile(r"^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|;+|--+|%+|<!--|>+|rem\b)?[ \t]*", re.I | re.M)
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_LINE = re.compile(r"\n")
_END = re.compile(r"(?<=[.?!:;])\s+|\n[ \t]*\n")


def normalised(sentence: str) -> str:
    """Words of a sentence in lower case; version numbers keep their inner stops."""
    return " ".join(_WORD.findall(sentence.lower()))


def lookup(sentences: dict[str, tuple[str, ...]] = SENTENCES) -> dict[str, str]:
    """Identifier of each normalised sentence."""
    table = {}
    for name, variants in sentences.items():
        for text in variants:
            table[normalised(text)] = name
    return table


def lengths(table: dict[str, str]) -> dict[str, list[int]]:
    """Word counts of the known sentences by their first word, longest first."""
    out: dict[str, set[int]] = {}
    for sentence in table:
        known = sentence.split(" ")
        out.setdefault(known[0], set()).add(len(known))
    return {first: sorted(counts, reverse=True) for first, counts in out.items()}


def units_of(text: str) -> tuple[list[str], list[int], list[int]]:
    """Words of a text, and the word numbers at which its sentences and its lines begin or end."""
    bare = _MARKS.sub("", text.lower())
    found = [(m.start(), m[0]) for m in _WORD.finditer(bare)]
    begins = [begin for begin, _ in found]
    sentences = {bisect_left(begins, end.start()) for end in _END.finditer(bare)} | {0, len(found)}
    lines = {bisect_left(begins, end.start()) for end in _LINE.finditer(bare)} | sentences
    return [word for _, word in found], sorted(sentences), sorted(lines)


def identifiers(text: str, table: dict[str, str], known: dict[str, list[int]] | None = None) -> list[tuple[int, str]]:
    """Known sentences as (sentence number, identifier), neighbours of one kind once.

    The longest known sentence at a place is taken with all that it covers. Numbers count
    the sentences of the text; a known sentence with inner ends counts as one.
    """
    known = known or lengths(table)
    tokens, sentences, lines = units_of(text)
    ends = set(lines)
    found: list[tuple[int, str]] = []
    done, inner = 0, 0
    for i in lines:
        if i < done or i == len(tokens):
            continue
        for count in known.get(tokens[i], ()):
            name = table.get(" ".join(tokens[i : i + count])) if i + count in ends else None
            if name:
                number = bisect_right(sentences, i) - 1
                if not (found and found[-1][1] == name and i == done):
                    found.append((number - inner, name))
                inner += bisect_left(sentences, i + count) - 1 - number
                done = i + count
                break
    return found


def apply_rules(found: list[tuple[int, str]], rules=RULES, max_gap: int = MAX_GAP) -> tuple[list[str], list[str]]:
    """Licences in text order and leftover identifiers."""
    free = [(place, number, name) for place, (number, name) in enumerate(found)]
    hits: list[tuple[int, str]] = []
    for licence, names in rules:
        start = 0
        while start < len(free):
            run = free[start : start + len(names)]
            fits = tuple(name for _, _, name in run) == names
            if fits and all(b[1] - a[1] - 1 <= max_gap for a, b in zip(run, run[1:], strict=False)):
                hits.append((run[0][0], licence))
                del free[start : start + len(names)]
            else:
                start += 1
    return [licence for _, licence in sorted(hits)], [name for _, _, name in free]


SCHEMA = "doc_id long, licences array<string>, identifiers array<string>, leftovers array<string>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = lookup()
    known = lengths(table)
    strings = pa.list_(pa.string())
    for batch in batches:
        for block in words.blocks(batch):
            out: list[list] = [[], [], []]
            for text in block.column(1).to_pylist():
                found = identifiers(text, table, known) if text and TRIGGER.search(text) else []
                licences, left = apply_rules(found)
                for column, value in zip(out, (licences, [n for _, n in found], left), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [block.column(0), *(pa.array(c, strings) for c in out)],
                names=["doc_id", "licences", "identifiers", "leftovers"],
            )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, the licences found, the identifiers and those left over."""
    adapt(docs.sparkSession)
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(_scan, SCHEMA)
