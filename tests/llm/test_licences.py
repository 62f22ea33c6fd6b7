import textwrap

import pytest
from awkward import docs, nothing, texts  # noqa: F401

from featurelens.llm import licences

TABLE = licences.lookup()
MIT = "\n".join(licences.SENTENCES[n][0] for n in ("mit-grant", "mit-notice", "as-is"))
APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at a place of your choice.
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 */"""


def found(text):
    return licences.apply_rules(licences.identifiers(text, TABLE))


@pytest.mark.parametrize(
    "text,names",
    [
        (MIT, ["MIT"]),
        ("The MIT License (MIT)\n\n" + MIT, ["MIT"]),
        (APACHE, ["Apache-2.0"]),
        ("Es gilt.\nReleased under the MIT License.\nEnde.", ["MIT"]),
        ("# SPDX-License-Identifier: GPL-2.0-or-later\nx = 1", ["GPL-2.0-or-later"]),
        ("Licensed under CC BY-NC 4.0.\ntext\nReleased under the MIT License.", ["CC-BY-NC-4.0", "MIT"]),
        ("We talked about the licence and a warranty.", []),
        ("", []),
    ],
)
def test_known_texts(text, names):
    assert found(text)[0] == names


def test_every_sentence_has_its_identifier_and_a_trigger():
    for name, variants in licences.SENTENCES.items():
        for text in variants:
            assert licences.TRIGGER.search(text)
            assert {n for _, n in licences.identifiers(f"Before.\n{text}\nafter", TABLE)} == {name}


def test_order_and_gaps_decide():
    bsd = [(i, n) for i, n in enumerate(("bsd-intro", "bsd-source", "bsd-binary", "bsd-endorse"))]
    assert licences.apply_rules(bsd) == (["BSD-3-Clause"], [])
    assert licences.apply_rules(bsd[:3]) == (["BSD-2-Clause"], [])
    assert licences.apply_rules([bsd[1], bsd[0], bsd[2]]) == ([], ["bsd-source", "bsd-intro", "bsd-binary"])
    far = [(0, "bsd-intro"), (9, "bsd-source"), (10, "bsd-binary")]
    assert licences.apply_rules(far) == ([], ["bsd-intro", "bsd-source", "bsd-binary"])


def test_scan_keeps_every_row(spark, docs, nothing):  # noqa: F811
    got = licences.scan(docs).collect()
    assert len(got) == docs.count() and not any(r.licences for r in got)
    rows = spark.createDataFrame([(1, MIT), (1, MIT), (None, "x " * 50000 + "\nReleased under the MIT License.\n"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.licences) for r in licences.scan(rows).collect()) == [(0, ["MIT"]), (1, ["MIT"]), (1, ["MIT"]), (2, [])]
    assert licences.scan(nothing).count() == 0


def test_registered_query_matches_plain_lines(spark):
    from awkward import SMOKE

    from featurelens.llm import queries

    # The table's licence lines are known; a plain search by line must find the same documents.
    lines = {t: n for _, n, t in ((None, n, licences.normalised(v)) for n, vs in licences.SENTENCES.items() for v in vs)}
    table = spark.read.parquet(f"{SMOKE}/documents.parquet").collect()
    want = {r.doc_id: {lines[licences.normalised(x)] for x in r.text.split("\n") if licences.normalised(x) in lines} for r in table}
    got = queries.QUERIES["op7_licence_sentences"](spark, SMOKE).collect()
    assert len(got) == len(table)
    assert all(want[r.doc_id] <= set(r.identifiers) for r in got)


NOTICES = {
    "MIT": ("mit-grant", "mit-notice", "as-is"),
    "BSD-3-Clause": ("bsd-intro", "bsd-source", "bsd-binary", "bsd-endorse"),
    "BSD-2-Clause": ("bsd-intro", "bsd-source", "bsd-binary"),
    "ISC": ("isc-grant",),
    "GPL-3.0-or-later": ("gpl-3-or-later", "gpl-no-warranty"),
    "GPL-2.0-or-later": ("gpl-2-or-later", "gpl-no-warranty"),
    "Apache-2.0": ("apache-2-name", "apache-2-comply", "apache-2-as-is"),
    "MPL-2.0": ("mpl-2-name",),
    "CC-BY-NC-4.0": ("cc-by-nc-4-name",),
    "CC-BY-4.0": ("cc-by-4-name",),
}


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * ", ";; "])
@pytest.mark.parametrize("width", [40, 70, 80])
@pytest.mark.parametrize("licence", NOTICES)
def test_wrapped_licences(licence, width, mark):
    names = NOTICES[licence]
    first = "\n".join(licences.SENTENCES[n][0] for n in names)
    if "cc-by" in names[0]:
        first = next(v for v in licences.SENTENCES[names[0]] if "Creative" in v) + "."
    head = "Copyright (c) 2020 The authors of this file\nAll rights reserved."
    for blank in ("\n", "\n\n"):
        for numbered in (False, True) if licence.startswith("BSD") else (False,):
            parts = [f"{i}. {p}" if numbered and i else p for i, p in enumerate(first.split("\n"))]
            body = [line for part in ("A file of ours.", *parts, "What follows is the file.") for line in [*textwrap.wrap(part, width), *blank[1:].split("\n")[1:]]]
            text = "\n".join(f"{mark}{line}".rstrip() for line in [*head.split("\n"), "", *body]) + "\nx = 1\n"
            sequence = licences.identifiers(text, TABLE)
            assert [n for _, n in sequence] == ["all-rights", *names]
            assert found(text) == (["LicenseRef-all-rights-reserved", licence], [])


def test_only_sentences_count_as_gaps():
    grant, notice = (licences.SENTENCES[n][0] for n in ("mit-grant", "mit-notice"))
    long = "\n".join(textwrap.wrap("One sentence of many words that fills a good many lines " * 20, 60)) + "."
    assert found(f"{grant}\n\n{long}\n\n{notice}") == (["MIT"], [])
    assert found(f"{grant}\n{'No. ' * 3}\n{notice}") == (["MIT"], [])
    assert found(f"{grant}\n{'No. ' * 4}\n{notice}") == ([], ["mit-grant", "mit-notice"])


def test_licences_of_one_sentence_stay_in_text_order():
    assert found("SPDX-License-Identifier: MIT\ntext\nSPDX-License-Identifier: ISC\ntext\nSPDX-License-Identifier: CC0-1.0")[0] == ["MIT", "ISC", "CC0-1.0"]
