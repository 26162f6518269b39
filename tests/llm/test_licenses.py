import math
import re

import pytest

from quillon.llm.licence_texts import TEMPLATES
from quillon.llm.licenses import BASE, op4_license_scan, rare_index, scan_licences, template_idf
from tests.llm.helpers import DOCS, SMALL, docs_of, rng

LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    places = [(k, label) for phrase, label in BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def check(rows, texts):
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id]), r
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(r.labels)


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op4_license_scan(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    check(rows, texts)


def test_edge_cases_and_base_places(spark):
    texts = [
        None, "", " \n", "Under the MIT License. under THE mit-license, under the mit", "cc by nc cc by nc", "Apache License, Version 2.0; apache license version 2x", "under the mit lİcense",
        "under the mit licen\u212ae", "é under the mit license é", "x " * 60_000 + "CC BY-NC 4.0", "mit mit mit", "under the mit license" * 3, "Apache License version\x802",
    ]
    df = docs_of(spark, [*texts, *texts]).selectExpr("*", "'q' AS labels", "1 AS Score")
    rows = scan_licences(df, template_idf(df)).collect()
    assert len(rows) == 26
    check(rows, dict(enumerate([*texts, *texts])))
    assert scan_licences(spark.createDataFrame([], DOCS)).collect() == []


def test_method_finds_whole_and_damaged_templates(spark):
    texts = [" ".join(t.words) for t in TEMPLATES]
    damaged = "Permission is hereby granted, free of charge, to any human obtaining a copy of this software"
    broken_key = "released beneath one mit licence"
    gnu = "This work is licensed under the GNU General Public License, version 3."
    df = docs_of(spark, [*texts, damaged, broken_key, gnu, "the general public of this version"])
    got = {r.doc_id: (r.labels, r.score) for r in scan_licences(df, template_idf(df)).collect()}
    for k, t in enumerate(TEMPLATES):
        assert t.label in got[k][0].split(",") and got[k][1] == 1.0
    n = len(texts)
    assert got[n][0] == "mit" and 0.75 <= got[n][1] < 1 and got[n + 1] == ("", 0.0) and got[n + 2][0] == "gpl-3" and got[n + 3] == ("", 0.0)


def test_index_holds_the_rarest_words_with_ties_by_name():
    idf = {w: 1.0 for t in TEMPLATES for w in t.words} | {"unencumbered": 5.0}
    index = rare_index(idf)
    [(t, i)] = index["unencumbered"]
    assert TEMPLATES[t].words[i] == "unencumbered" and TEMPLATES[t].label == "unlicense"
    for k, t in enumerate(TEMPLATES):
        own = {w for w, of in index.items() for x, _ in of if x == k}
        assert own == set(sorted(set(t.words), key=lambda w: (-idf[w], w))[: 3 + len(t.words) // 12])
    assert "unencumbered" not in rare_index({w: x for w, x in idf.items() if w != "unencumbered"}) and rare_index({}) == {}


TEXTS = [
    ("// SPDX-License-Identifier: Apache-2.0\n", "apache-2"), ("# SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2"), ("SPDX-License-Identifier: LGPL-2.1-only", "lgpl-2.1"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd"), ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991", "gpl-2"), ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "lgpl-2.1"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "agpl-3"), ("Creative Commons Attribution 4.0 International License", "cc-by"),
    ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "cc-by-nc-sa"), ("see https://creativecommons.org/licenses/by-nd/4.0/", "cc-by-nd"),
    ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.', "mit"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl-2"),
    ("This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or any later version.", "lgpl-3"),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"), ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mpl-2"),
    ("Distributed under the Boost Software License, Version 1.0.", "boost-1"), ("CC0 1.0 Universal", "cc0"),
    ("A general permission of the foundation: software is licensed, in version 2, to the public by creative people.", ""), ("the rights of the software, without fee, and the source code", ""),
]


def test_texts_of_licences(spark):
    words = "lorem ipsum dolor sit amet " * 5
    df = docs_of(spark, [f"{words}{text} {words}" for text, _ in TEXTS])
    got = {r.doc_id: r.labels for r in scan_licences(df, template_idf(df)).collect()}
    assert [(t, got[k]) for k, (t, _) in enumerate(TEXTS)] == TEXTS


def test_main_path_is_native(spark):
    plan = op4_license_scan(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange"))


def slow_labels(text, idf):
    """Labels and score of a text: every template at every relative position, without an index."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    found = {(x, 1.0) for x in base(text)[4].split(",") if x}
    there = set(words)
    for label, of, key in TEMPLATES:
        rare = set(sorted(set(of) & idf.keys(), key=lambda w: (-idf[w], w))[: 3 + len(of) // 12])
        if not there & rare:
            continue
        for at in range(-len(of), len(words)):
            if not 0 <= at + key[0] < len(words) or words[at + key[0]] != of[key[0]]:
                continue
            same = [0 <= at + k < len(words) and words[at + k] == w for k, w in enumerate(of)]
            anchors = sum(x and w in rare for x, w in zip(same, of))
            if anchors >= 2 and all(same[k] for k in key) and sum(same) >= 0.75 * len(of):
                found.add((label, sum(same) / len(of)))
    return ",".join(sorted({x for x, _ in found})), max((x for _, x in found), default=0.0)


def test_labels_and_scores_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    n = len(texts)
    split = {i: set(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))) for i, t in texts.items()}
    df = {w: sum(w in s for s in split.values()) for w in {w for t in TEMPLATES for w in t.words}}
    idf = {w: math.log((n + 1) / (k + 0.5)) for w, k in df.items() if k}
    assert template_idf(spark.read.parquet(f"{SMALL}/documents.parquet")) == pytest.approx(idf)
    for r in op4_license_scan(spark, SMALL).collect():
        assert (r.labels, r.score) == slow_labels(texts[r.doc_id], idf)
    r_, more = rng(7), []
    for _ in range(150):  # templates with words changed, left out and put in, and several of them
        some = [w if r_.random() > 0.08 else r_.choice(["other", "", "license", "cc by"]) for t in r_.sample(TEMPLATES, r_.randint(1, 4)) for w in t.words]
        more.append(" ".join(some))
    df = docs_of(spark, more)
    idf = template_idf(df)
    for r in scan_licences(df, idf).collect():
        assert (r.labels, r.score) == slow_labels(more[r.doc_id], idf), more[r.doc_id]


def test_text_of_all_templates_has_all_labels(spark):
    whole = " and ".join(" ".join(t.words) for t in TEMPLATES)
    df = docs_of(spark, [" ".join(t.words) for t in TEMPLATES] + [whole])
    [row] = scan_licences(df, template_idf(df)).where(f"doc_id = {len(TEMPLATES)}").collect()
    assert row.labels == ",".join(sorted({t.label for t in TEMPLATES})) and row.score == 1.0
