"""The linear base scanner against the contract's patterns as they stand, over strings, a table and very long runs."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from jadwal.llm import pii
from jadwal.llm.common import text_slices

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, s):
    d = re.sub(r"[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "phone":
        return 10 <= len(d) <= 15
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1]))
        return 14 <= len(d) <= 19 and total % 10 == 0
    return True


def plain_spans(text):
    found = [(m.start(), list(PATTERNS).index(k), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text) if fits(k, m[0])]
    return [(s, e, k) for s, _, e, k in sorted(found)]


def test_base_spans_of_random_strings():
    r = random.Random(1)
    for _ in range(30_000):
        text = "".join(r.choice("aZ1290.@@ -+()%é\n") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text)
    for _ in range(5_000):
        text = "".join(r.choice(["4111 1111 1111 1111", "10.0.0.255", "+1 (425) 555-0100", "a@b.de", "x@y", " ", ".", "1", "-", "256.1.1.1.1", "@", "%"]) for _ in range(r.randint(1, 9)))
        assert pii.base_spans(text) == plain_spans(text)


def test_scan_of_a_table_agrees_with_a_plain_scanner(spark):
    r = random.Random(2)
    parts = ["4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.255", "+1 (425) 555-0100", "a.b@c-d.example.de", "x@y", "é", "words", "\n", "12", "token = \"b44e15e09fd311c3cf3163b66d5a9875b883d8ce\""]
    rows = [(i % 190, " ".join(r.choice(parts) for _ in range(r.randint(0, 30)))) for i in range(400)] + [(None, "a@b.de"), (500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = sorted((str(x["doc_id"]), x["n_email"], x["n_ip"], x["n_card"], x["n_phone"], x["base_sha256"]) for x in pii.scan(docs, pii.train(docs)).collect())
    want = []
    for i, text in rows:
        spans = plain_spans(text or "")
        kinds = [k for _, _, k in spans]
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
        want.append((str(i), *[kinds.count(k) for k in PATTERNS], digest))
    assert got == sorted(want)


def test_added_spans_keep_the_base_spans_and_overlap_nothing():
    r = random.Random(3)
    model = pii.SpanModel.fit([f"w{i} token = \"{r.randrange(16**30):030x}\" and a{i} (at) b{i} (dot) org, call 425-555-{1000 + i}, 10.{i}.3.4" for i in range(80)])
    texts = [" ".join(r.choice(["a (at) b (dot) org", "call 425-555-1234", "10[.]1[.]2[.]3", "x@y.de", "4111.1111.1111.1111", f"{r.randrange(16**30):030x}", "1.2.3.4"]) for _ in range(60)) for _ in range(20)]
    for text, (base, spans) in zip(texts, pii.all_spans(texts, model), strict=True):
        assert set(base) <= set(spans)
        added = [s for s in spans if s not in base]
        assert all(e <= s2 or s >= e2 for s, e, k in added for s2, e2, k2 in spans if (s, e, k) != (s2, e2, k2))


@pytest.mark.parametrize("text", ["a" * (1 << 20) + " 1", "9" * (1 << 20), "a" * (1 << 19) + "@" + "b" * (1 << 19) + ".de", "a@" * (1 << 19), "(" * (1 << 20) + "1", "a1-" * (1 << 18)], ids=["letters", "digits", "one sign", "signs", "brackets", "key"])
def test_runs_of_a_megabyte_take_linear_time(text):
    model = pii.SpanModel.fit(["x token = \"b44e15e09fd311c3cf3163b66d5a9875b883d8ce\" y a@b.de 1.2.3.4"] * 10)
    began = time.process_time()
    base, _ = pii.all_spans([text], model)[0]
    assert time.process_time() - began < 6  # 0.2 to 2 s when the machine does nothing else
    assert base == ([(0, len(text), "email")] if text.endswith(".de") else [])


def test_text_slices_are_bounded_by_bytes():
    import pyarrow as pa

    texts = ["a" * 10, None, "b" * 100, "", "c" * 30, "d" * 30, "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["doc_id", "text"])
    parts = [p.column(1).to_pylist() for p in text_slices(batch, 1, 3, 60)]
    assert parts == [["a" * 10, None], ["b" * 100], ["", "c" * 30], ["d" * 30, "e"]] or sum(parts, []) == texts and all(len(p) <= 3 and (len(p) == 1 or sum(len(t or "") for t in p) <= 60) for p in parts)
