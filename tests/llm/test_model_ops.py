"""PII, chat, WARC and sharding against brute force, round trips and laws."""

import base64
import hashlib
import io
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from tests.llm.fixtures import all_docs, edge_docs, table

from dyadica.llm import chat, pii, shard, warc


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def base(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if ok(m[0])]
    return [f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(found)]


PII_TEXTS = [
    "a.b+c%d@x-y.co.uk, x@y z@.com q@w.e.r@t.y @a.b a@b.c%x@y.z",
    "1.2.3.4 256.1.1.1 1.2.3.4.5 1.2.3.4.5.6.7.8 001.002.003.004 12.34.56.78.90.12",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 5500000000000004 1 2 3 4 5 6 7 8 9 0 1 2",
    "+1 (555) 123-4567 call 555 123-4567 +12345678 +1234567890123456 ++49 30 1234567. +(1) 5",
    "Été \U0001f600 jean.dupont9@ex.fr wrote; jean.dupont9 says 192.168.0.1, jean.dupont9@ex",
    "4111111111111111@shop.org 1.2.3.4@host.net +14155550123@mail.com 000000000000.1.2.3",
    "9" * 3000 + " " + "a" * 3000 + "@" + " " + "1.1.1" * 500,
]


def test_pii_base_spans_equal_the_patterns(spark, sf):
    docs = all_docs(spark, sf).union(spark.createDataFrame([(i + 2_000_000, t, "en") for i, t in enumerate(PII_TEXTS)], "doc_id long, text string, lang string"))
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    want = Counter()
    for (d, t), n in texts.items():
        b = base(t)
        want[d, *[sum(x.startswith(k) for x in b) for k in pii.PATTERNED], sha(",".join(b))] += n
    got = pii.op3(docs).collect()
    assert Counter(tuple(r)[:6] for r in got) == want
    by_id = {d: t for d, t in texts}
    for r in got:
        spans = r.spans.split(",") if r.spans else []
        assert not Counter(base(by_id[r.doc_id])) - Counter(spans)
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def test_skip_chain_finds_the_number_without_its_plus(spark):
    text = "Reach me at +1 (555) 123-4567 or so. " + "word " * 200 + "As said, 555-123-4567 it is; order 222-333-4444 is none."
    clean = "Order 555-123-4567 shipped. Part 12345678 too."
    docs = spark.createDataFrame([(i, text if i % 4 == 0 else clean) for i in range(40)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    added = [text[s.start : s.end] for s in got[0].spans if s not in got[0].base]
    assert added == ["555-123-4567"] and [s.kind for s in got[0].spans] == ["phone", "phone"]
    assert got[1].spans == []
    red = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert red[1] == clean and red[0].startswith("Reach me at <phone> or so. ") and "said, <phone> it is; order 222-333-4444" in red[0]


CONTROL = ["[TURN]", "[SAYS]", "[NEXT]", "[END]", "[INST]", "[/INST]", "<s>", "</s>"]


def test_chat_reads_back_every_turn(spark, sf):
    rows = [(1, i, "user" if i % 3 else "assistant", c + "\\" * i + c[:1] + "\\" * i + c[1:] + "x\\" + c[:-1]) for i, c in enumerate(CONTROL)]
    rows += [(2, 0, None, None), (2, 1, "assistant", "one"), (2, 2, "assistant", ""), (2, 2, "assistant", ""), (2, 3, "[END]a<s>", "[[END]"), (3, None, "assistant", "Été\n\U0001f600"), (3, 0, "user", "<"), (None, 5, "user", "[TURN")]
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").union(spark.createDataFrame([(r[0] + 10**6 if r[0] else None, *r[1:]) for r in rows], "conv_id long, turn long, role string, text string"))
    chats = defaultdict(list)
    for r in conv.collect():
        chats[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    chats[-7] = [(True, 0, "user", "</s>[INST] ok [/INST]"), (True, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = Counter()
    for c, turns in chats.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        want[c, len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss)] += 1
    got = chat.op7(conv).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    texts = {r.conv_id: r for r in chat.format_chats(conv).collect()}
    two = texts[10**6 + 2]
    assert two.formatted == "<s>[TURN][SAYS][END][TURN]assistant[SAYS]one[NEXT][NEXT][END][TURN][\\END]a<\\s>[SAYS][[\\END][END]</s>"
    assert [two.formatted[s.start : s.end] for s in two.loss_spans] == ["one", "", ""]


def warc_want(rows):
    b32 = lambda p: base64.b32encode(hashlib.sha1(p).digest()).decode()
    last = {}
    for i, h in rows:
        p = (h or "").encode()
        if i is not None:
            last[p] = max(last.get(p, i), i)
    out = Counter()
    n = Counter((h or "").encode() for _, h in rows)
    for i, h in rows:
        p = (h or "").encode()
        of = last.get(p)
        revisit = n[p] > 1 and of is not None and i != of
        out[i, len(p), b32(p), "revisit" if revisit else "response", of if revisit else None] += 1
    return out


def test_warc_reads_back_what_was_written(spark, sf):
    more = [(9001, "http://é/ \r\nX: y", "same"), (9002, None, "same"), (9003, "u", None), (9004, "u", ""), (None, "u", "same"), (9002, None, "same"), (9005, "u", "big " * 300_000), (9006, "u", "WARC/1.1\r\n\r\n\x1f")]
    pages = table(spark, sf, "pages").select("page_id", "url", "html").union(spark.createDataFrame(more, "page_id long, url string, html string"))
    want = warc_want([(r.page_id, r.html) for r in pages.collect()])
    assert Counter(tuple(r) for r in warc.op8(pages).collect()) == want
    assert warc.op8(pages.limit(0)).count() == 0
    from dyadica.llm.common import shared_path

    held = Counter((r.page_id, bytes(r.payload)) for r in warc.read(spark, warc.write(pages, shared_path(spark, "warc"), least_bytes=10**9), split_bytes=10_000).collect())
    assert held == Counter((r.page_id, (r.html or "").encode()) for r in pages.collect())


def test_warc_ranges_own_each_record_once(tmp_path):
    import os

    payloads = [os.urandom(37 * i % 5000) + zlib.compress(b"x" * i) + warc.MAGIC * (i % 3) for i in range(300)]
    raw = b"".join(warc.record(i, "http://x/", p, None) for i, p in enumerate(payloads))
    for split in (101, 5000, 70_000, len(raw) + 5):
        seen = []
        for a in range(0, len(raw), split):
            for fields, block in warc.RangeReader(io.BytesIO(raw), a, min(len(raw), a + split)):
                seen.append(int(fields["x-page-id"]))
                assert block.split(b"\r\n\r\n", 1)[1] == payloads[seen[-1]]
        assert seen == list(range(300))
    import gzip

    assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == 300


def test_shards_are_exact_and_keep_every_row(spark, sf):
    docs = all_docs(spark, sf)
    rows = shard.op9(docs).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter(tuple(r)[:3] for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(by[s]) == list(range(len(by[s]))) for s in by)
    assert sorted(map(tuple, shard.op9(docs.repartition(7)).collect()), key=str) == sorted(map(tuple, rows), key=str)
    few = shard.op9(edge_docs(spark).limit(3)).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]
    assert shard.op9(docs.limit(0)).count() == 0


def test_shuffle_is_uniform(spark):
    ids = spark.range(400).withColumnRenamed("id", "k")
    hits = Counter()
    for seed in range(40):
        for r in shard.spread(ids, ["k"], shards=4, parts=8, seed=seed).where("k < 8").collect():
            hits[r.shard, r.slot // 25] += 1
    chi = sum((hits[s, q] - 20) ** 2 / 20 for s in range(4) for q in range(4))
    assert chi < 45  # 15 degrees of freedom, about one in ten thousand


def test_spread_replaces_columns_of_its_names(spark):
    rows = spark.createDataFrame([(i, "x", i) for i in range(90)], "k long, Shard string, slot long")
    out = shard.spread(rows, ["k"], shards=4, parts=9)
    assert out.columns == ["k", "shard", "slot"] and sorted(r.k for r in out.collect()) == list(range(90))


def test_tree_of_draws_has_the_law_of_one_draw(spark):
    """The number of one part's rows in one shard: mean and variance of the hypergeometric law."""
    ids = spark.range(120).selectExpr("id AS k", "cast(id % 9 AS int) AS __part").persist()
    n = [shard.part_rows(ids, 4, 9, seed)[0].where("__part = 2").first()[1][0] for seed in range(30)]
    ids.unpersist()
    assert abs(np.mean(n) - 13 / 4) < 0.9 and 0.8 < np.var(n) < 5  # 3.25 and 2.2


def test_matrix_has_its_sums_and_law():
    m = shard.communication_matrix([5, 0, 7, 100], [28, 28, 28, 28], 3)
    assert m.sum(0).tolist() == [28] * 4 and m.sum(1).tolist() == [5, 0, 7, 100]
    rng = np.random.default_rng(0)
    big = [shard._draw(rng, 600_000_000, 900_000_000, 50_000) for _ in range(300)]
    assert abs(np.mean(big) - 20_000) < 30 and 85 < np.std(big) < 135


def test_lexicon_moves_no_texts(spark, monkeypatch):
    from dyadica.llm import quality

    rows = [(i, "foul " * (i % 2) + f"plain words {i}", "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    plans, write = [], quality.materialise

    def kept(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, label)

    monkeypatch.setattr(quality, "materialise", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many labels
    try:
        assert quality.lexicon(docs, labels) == ["foul"]
        assert all("SortMergeJoin" not in plan for label, plan in plans if label == "words")
        monkeypatch.setattr(quality, "MOST_BROADCAST", 70)
        assert quality.lexicon(docs, labels) == ["foul"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(label == "words" for label, _ in plans) > 2
