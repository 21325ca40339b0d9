"""License scans against brute force over all windows."""

import random

import numpy as np

from seriesframe.llm import licenses
from seriesframe.llm.words import WordHash, hashes_of, shingles, words_of


def brute(docs, templates, size=5, share=80):
    """Pairs of text and template where some stretch as long as the template holds enough of it."""
    memo, out = WordHash(), set()
    for doc_id, text in docs:
        have = hashes_of(words_of(text.encode()), memo) if text else []
        for name, template in templates:
            words = words_of(template.encode())
            if not words:
                continue
            own = np.unique(shingles(hashes_of(words, memo), size))
            for at in range(max(0, len(have) - len(words) + 1)):
                found = np.isin(own, shingles(have[at : at + len(words)], min(size, len(words)))).sum()
                if 100 * found >= share * len(own):
                    out.add((doc_id, name))
    return out


def planted(odd_rows):
    rng = random.Random(11)
    long = " ".join(f"clause{rng.randint(0, 400)}" for _ in range(150))
    templates = [*licenses.NOTICES, ("long", long), ("word", "Unlicense"), ("none", "  ")]
    docs = [(r[0], r[1]) for r in odd_rows if r[0] != 206]
    fillers = [t for _, t in docs if t and 20 < len(t.split()) < 100]
    for k, (name, text) in enumerate(templates):
        words = text.split()
        docs.append((1_000 + k, f"{fillers[k]}\n{text.upper()}\n{fillers[k + 1]}"))
        docs.append((2_000 + k, text))
        if len(words) > 20:
            words[len(words) // 2] = "changed"
            docs.append((3_000 + k, fillers[k] + " " + " ".join(words)))
            docs.append((4_000 + k, fillers[k] + " " + " ".join(words[: len(words) // 3])))
    return docs, templates


def test_equal_to_brute_force(spark, odd_rows, monkeypatch):
    docs, templates = planted(odd_rows)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame([*templates, (None, None)], "license string, text string")
    want = brute(docs, templates)
    assert len(want) > 20
    for limit in (4_000_000, 700):
        monkeypatch.setattr(licenses, "TEMPLATE_BYTES", limit)
        rows = licenses.license_matches(frame, table).collect()
        assert {(r.doc_id, r.license) for r in rows} == want
        assert all(100 * r.found >= 80 * r.n_shingles for r in rows)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    assert licenses.license_matches(odd_docs).collect() == []
    assert licenses.license_matches(no_docs).collect() == []
    none = spark.createDataFrame([], "license string, text string")
    assert licenses.license_matches(odd_docs, none).collect() == []


def test_bands_reach_the_required_chance():
    for longest in (1, 3, 5, 8, 12, 40, 500, 5_000):
        shortest = max(1, int(longest / 1.25) + 1) if longest > 1 else 1
        c = licenses.SizeClass(min(5, shortest), shortest, longest, 80)
        bands, rows = c.banding
        own = shortest - c.size + 1
        found = max(1.0, own * 0.8)
        assert (1 - (found / (c.width + own - found)) ** rows) ** bands <= licenses.MISS * 1.001


def test_sliding_minimum():
    x = np.random.default_rng(0).integers(0, 100, 50)
    for width in (1, 2, 3, 7, 16, 50):
        assert licenses.Scanner._sliding(x, width).tolist() == [x[k : k + width].min() for k in range(51 - width)]


def test_texts_and_wordings_of_licenses(spark, odd_rows):
    """None of these is a line of the tables: full texts with marks of comments, headers, names in other words, tags."""
    filler = next(t for _, t in [(r[0], r[1]) for r in odd_rows] if t and 20 < len(t.split()) < 100)
    full = dict(licenses.full_texts())
    cases = [(f"{name}.", filler + "\n" + "\n".join(" * " + x for x in full[name].split("\n")), {name}) for name in ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "ISC")]
    cases += [
        ("bare", "Copyright Somebody, all rights reserved", {"LicenseRef-all-rights-reserved"}),
        ("quoted", "It is “Released under the MIT License”, so use it", {"MIT"}),
        ("words", "You may use this code under the terms of the Mozilla Public License 2.0 only", {"MPL-2.0"}),
        ("gpl", "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as\n"
                "# published by the Free Software Foundation; either version 2 of the\n# License, or (at your option) any later version.", {"GPL-2.0", "LicenseRef-GPL"}),
        ("tag", "x = 1  # SPDX-License-Identifier: (mit OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\ny = 2", {"MIT", "Apache-2.0", "GPL-2.0"}),
        ("other tag", "// SPDX-License-Identifier: OFL-1.1\n", {"OFL-1.1"}),
        ("none", filler + " The license of my car is under the seat, and rights are reserved.", set()),
    ]
    frame = spark.createDataFrame([(k, text) for k, (_, text, _) in enumerate(cases)], "doc_id long, text string")
    rows = licenses.license_matches(frame).collect()
    got = [{r.license for r in rows if r.doc_id == k} for k in range(len(cases))]
    for (name, _, want), have in zip(cases, got):
        assert (want <= have) if name.endswith(".") else want == have, (name, have)
    assert len({(r.doc_id, r.license) for r in rows}) == len(rows)
    assert next(r.first_word for r in rows if r.doc_id == 10) == 4
