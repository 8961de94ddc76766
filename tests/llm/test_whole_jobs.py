"""Cases in which an operator once did less than its whole job."""

import base64
import random

import pytest

from dyadica.llm import pii, quality, warc


def test_quality_stage_rejects_with_some_hundred_labels(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    noisy = clean + " " + "$$$ ### " * 20
    rows = [(i, clean, "en") for i in range(700)] + [(i, noisy, "en") for i in range(700, 750)]
    rows += [(i, noisy if i % 20 == 0 else clean, "de") for i in range(1000, 1700)] + [(i, noisy, "fr") for i in range(2000, 2100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(not 700 <= i < 750), 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.keep(docs, labels).collect()}
    assert kept == {i for i, _, _ in rows if not 700 <= i < 750}  # de: a good document in 20 would go; fr: too few labels
    assert {r.doc_id for r in quality.keep(docs, labels.limit(0)).collect()} == {i for i, _, _ in rows}
    assert quality.keep(docs.limit(0), labels).count() == 0


def test_quality_stage_rejects_toxic_documents(spark):
    clean = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100))
    insult = {0: ", you Idiot!", 1: " trash."}
    rows = [(i, f"{clean} rare{i}", "en") for i in range(700)] + [(i, clean + insult[i % 2] * 3, "en") for i in range(700, 760)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, int(i >= 700)) for i in range(740)], "doc_id long, quality int, toxic int")
    assert {"idiot", "trash"} <= set(quality.lexicon(docs, labels)) <= {"idiot", "trash", "you"}
    assert {r.doc_id for r in quality.keep(docs, labels).collect()} == set(range(700))


def test_every_repeat_of_a_number_is_found(spark):
    bare = "555-123-4567"
    clean = "Order 555-123-4567 shipped. Part 12345678 too."
    texts = [f"Reach me at +1 ({bare[:3]}) {bare[4:]}. " + f"Or {bare} then. " * 20, f"Or {bare} then. " * 20 + f"Reach me at +1 ({bare[:3]}) {bare[4:]}.", f"+1 ({bare[:3]}) {bare[4:]} " + f"or {bare} " * 300]
    docs = spark.createDataFrame([*enumerate(texts), *[(10 + i, clean) for i in range(60)]], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    assert [len(got[i].spans) for i in range(3)] == [21, 21, 301]
    assert all(s.kind == "phone" for i in range(3) for s in got[i].spans) and got[10].spans == []


def test_warc_reads_records_with_long_headers(spark, monkeypatch):
    noise = base64.b64encode(random.Random(1).randbytes(2_000_000)).decode()
    rows = [(1, "data:text/html;base64," + noise, "one"), (2, "http://x/" + "日" * 30_000, "two"), (3, "http://x/", "two"), (4, "http://x/" + "日" * 9000, "one")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.op8(pages).collect()}
    assert got == {1: ("revisit", 4, 3), 2: ("revisit", 3, 3), 3: ("response", None, 3), 4: ("response", None, 3)}
    true = warc.write
    monkeypatch.setattr(warc, "write", lambda *a, **k: [(f, size, n + 1) for f, size, n in true(*a, **k)])
    with pytest.raises(RuntimeError, match="records read"):
        warc.op8(pages)
