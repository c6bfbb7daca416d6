"""The licence scan on full notices, awkward texts and against brute force without the words that gate the lookup."""

from __future__ import annotations

import random
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from jadwal.llm import license_scan as scan_of
from notices import NO_FAMILY, NOTICES

MIT = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
]
GPL = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
    "either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
]
BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
]
MPL = ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."]
BOOST = [
    "Boost Software License - Version 1.0 - August 17th, 2003",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") "
    "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
]
FILLER = "the of and to in that is was for on with as by at from it or an be this which are not have had were but all they one you".split()


def plain(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return [r.choice(FILLER) if r.random() < 0.5 else "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return scan_of.fit([plain(i, 40) for i in range(400)])


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("family", F.lit("clash"))


def wrapped(paragraphs, mark="", gap="\n\n"):
    return gap.join("\n".join(mark + line for line in textwrap.wrap(p, 70)) for p in paragraphs)


def brute(text, model):
    """paragraph -> (family, probability, overlap), every window scored with all its n-grams."""
    out = {}
    for k, body in enumerate(re.split(r"\n(?:[\s*#/;-]*\n|(?<=[.!?:;]\n)|(?<=[.!?:;][\"')\]]\n))", text)):
        ws = [w for w in re.split(r"[\W_]+", body.lower()) if w]
        best = None
        for start in [0, *range(150, max(len(ws) - 150, 1), 150)]:
            part = ws[start : start + 300]
            if part:
                p = model.probabilities(part)[:-1]
                if best is None or p.max() > best[0].max():
                    best = (p, part)
        if best is not None and best[0].max() >= scan_of.REPORT:
            p, part = best
            family = list(scan_of.TEMPLATES)[p.argmax()] if p.max() >= model.least else "unknown"
            shares = [len(set(part) & set(t)) / len(set(t)) for t in ([w for w in re.split(r"[\W_]+", x.lower()) if w] for x in scan_of.TEMPLATES.get(family, []))]
            out[k] = (family, p.max(), max(shares, default=0.0))
    return out


def test_full_notices_wrapped_at_70_columns(spark, model):
    texts = [wrapped(MIT), wrapped(GPL, " * "), wrapped(BSD, "# ", "\n#\n"), wrapped(MPL), wrapped(BOOST), "Lizenziert unter der Apache-Lizenz", "CC BY-NC 4.0", "GPLv3 or later"]
    rows = scan_of.scan(docs_of(spark, texts), model).collect()
    named = {(r["doc_id"], r["family"]) for r in rows if r["family"] != "unknown" and r["doc_id"] != 5}
    assert named == {(0, "mit"), (1, "gpl"), (2, "bsd"), (6, "cc-by-nc"), (7, "gpl")}
    confirmed = {(r["doc_id"], r["paragraph"]) for r in rows if r["confirmed"]}
    assert {(0, 0), (0, 1), (1, 0), (1, 2), (2, 0), (2, 1), (2, 2)} <= confirmed and not {d for d, _ in confirmed} & {3, 4, 5}
    assert [r["probability"] for r in rows if r["doc_id"] == 5] == [pytest.approx(model.probabilities(["lizenziert", "unter", "der", "apache", "lizenz"])[0], abs=2e-6)]


def test_agrees_with_brute_force_on_every_paragraph(spark, model):
    r = random.Random(3)
    notices = [t for ts in scan_of.TEMPLATES.values() for t in ts] + scan_of.OTHERS
    texts = []
    for i in range(120):
        parts = [" ".join(plain(1000 + 7 * i + j, r.choice([5, 30, 700]))) + r.choice([".", ""]) for j in range(3)]
        ws = r.choice(notices).split()
        parts.insert(r.randrange(4), " ".join(w for w in ws if r.random() > 0.25))
        texts.append(r.choice(["\n", "\n\n"]).join(parts))
    texts += [" ".join(r.sample(sorted({w for g in model.weights for w in g.split(" ")}), 12)) for _ in range(200)]
    got = {}
    for row in scan_of.scan(docs_of(spark, texts), model).collect():
        got[row["doc_id"], row["paragraph"]] = (row["family"], row["probability"], row["overlap"])
    want = {(i, k): v for i, t in enumerate(texts) for k, v in brute(t, model).items()}
    assert set(got) == set(want) and len(want) > 100
    for key, (family, p, share) in want.items():
        assert got[key] == (family, pytest.approx(p, abs=2e-6), pytest.approx(share, abs=2e-6))


def test_the_needed_words_bound_the_probability(model):
    needed = set(model.needed())
    free = [g for g, w in model.weights.items() if max(w[:-1]) > w[-1] and not set(g.split(" ")) & needed]
    z = [sum(max(0.0, model.weights[g][k] - model.weights[g][-1]) for g in free) + model.bias[k] - model.bias[-1] for k in range(len(model.bias) - 1)]
    assert max(z) < -2.19 and len(needed) < 400


def test_ties_repeated_rows_and_long_lines(spark, model):
    long = " ".join(plain(5, 30_000)) + " Released under the MIT License. " + " ".join(plain(6, 500)) + " x" * 10 + "y" * 200_000
    rows = [(1, long), (2, "All rights reserved."), (2, "All rights reserved."), (None, "All rights reserved."), (3, None), (4, ""), (5, "\n \n\n"), (6, "-\n" * 20_000 + "All rights reserved.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(7)).withColumn("w", F.lit(0))
    got = sorted((str(r["doc_id"]), r["family"], r["confirmed"]) for r in scan_of.scan(docs, model).collect())
    assert got == sorted([("1", "mit", True)] + [(i, "proprietary", True) for i in ("2", "2", "None", "6")])
    same = scan_of.LicenseModel({"tie": [5.0, 5.0, *[0.0] * 6]}, [0.0] * 8, 0.2)
    tied = scan_of.scan(docs_of(spark, ["a tie"]), same).collect()
    assert [(r["family"], r["confirmed"]) for r in tied] == [("apache-2.0", False)]


def test_of_nothing_and_training_from_a_table(spark, model):
    assert scan_of.scan(docs_of(spark, []).where("doc_id < 0"), model).count() == 0
    nothing = scan_of.train(docs_of(spark, ["x"]).limit(0))
    assert scan_of.scan(docs_of(spark, ["All rights reserved."]), nothing).count() == 1
    trained = scan_of.train(docs_of(spark, [" ".join(plain(i, 40)) for i in range(200)]), n=100)
    assert [r["family"] for r in scan_of.scan(docs_of(spark, ["some words\nLicensed under CC BY 4.0."]), trained).collect()] == ["cc-by"]


def test_unseen_notices(spark):
    """Notices that no template contains, other licences, and ordinary sentences."""
    model = scan_of.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    texts = [(f, t) for f, ts in NOTICES.items() for t in ts] + [(None, t) for t in NO_FAMILY]
    found = {r["doc_id"]: r["family"] for r in scan_of.scan(docs_of(spark, [t for _, t in texts]), model).collect() if r["family"] != scan_of.UNKNOWN}
    wanted = {i: f for i, (f, _) in enumerate(texts) if f}
    right = sum(found.get(i) == f for i, f in wanted.items())
    wrong = [texts[i] for i in found if i not in wanted]
    assert right >= 0.9 * len(wanted) and len(wanted) >= 40
    assert len(wrong) <= 1, wrong
    assert not [t for _, t in wrong if "GPL" in t or "Lesser" in t or "Affero" in t]
