"""The language model: base scores by formula, seating against enumeration, probabilities that sum to one."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.llm.fixtures import all_docs, edge_docs, words

from dyadica.llm import lm, seating


def held(d):
    return zlib.crc32(str(d if d is not None else "").encode()) % 7 == 2


def test_base_score_equals_the_formula_and_the_model_is_better(spark, sf):
    docs = all_docs(spark, sf)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    counts = Counter(t for d, x in rows if not held(d) for t in [*words(x, lower=True), None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for d, x in rows:
        toks = [*words(x, lower=True), None]
        score = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in toks)
        want[d, held(d), len(toks), sum(counts[t] > 0 for t in toks), n, round(score, 6)] += 1
    got = lm.op4(docs).collect()
    assert Counter((*tuple(r)[:5], round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    out = [r for r in got if r.held_out]
    # a unigram model with one discount, the best that needs no context
    d = lm._discount(sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values()))
    new = d * v / (n * (v + 1))
    unigram = sum(math.log10(max(counts[t] - d, 0) / n + new) for i, x in rows if held(i) for t in [*words(x, lower=True), None])
    tokens = sum(r.n_tokens for r in out)
    assert 10 ** (-sum(r.score for r in out) / tokens) < 0.5 * 10 ** (-unigram / tokens)
    assert {(r.doc_id, r.score) for r in lm.op4(docs).collect()} == {(r.doc_id, r.score) for r in got}


def test_words_that_are_split_score_alike(spark, sf, monkeypatch):
    docs = lm.split(all_docs(spark, sf))
    whole = {(r.doc_id, r.n_tokens): r for r in lm.scores(docs, shard_bytes=100_000).collect()}
    monkeypatch.setattr(lm, "HOT_PARTS", 2000)
    layout = lm.hot_words(docs, 20)
    assert len(layout.hot) > 50 and layout.parts.max() > 1
    for r in lm.scores(docs, shard_bytes=100_000).collect():
        w = whole[r.doc_id, r.n_tokens]
        assert (r.n_known, r.train_tokens, r.base_score) == (w.n_known, w.train_tokens, pytest.approx(w.base_score))
        assert r.score == pytest.approx(w.score, rel=0.05, abs=3)


def test_scores_of_words_seen_once_follow_the_formula(spark):
    """Every pair has one customer, so that one table each is the only seating and scores have a closed form."""
    texts = [(i, f"a{i} b{i} c{i}", False) for i in range(30)] + [(99, "a3 b3 zz a4", True)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, held_out boolean")
    dealt, shards = lm.deal(docs)
    layout = lm.hot_words(docs, shards)
    layout = lm.Layout(layout.buckets, layout.hot[:0], layout.parts[:0])
    model = lm.fit(dealt, layout)
    t, s = model.totals, model.totals.strength
    seats_end = next(r for r in lm.score(dealt, model, layout, shards).collect() if r.doc_id == 99)
    keys, ctx, _ = lm.tokens([x.encode() for _, x, h in texts if not h])
    pairs = Counter(zip(keys.tolist(), ctx.tolist(), strict=True))
    assert max(pairs.values()) == 1
    by_ctx, v = Counter(c for _, c in pairs), len(set(keys.tolist()))
    entries = Counter((w, c >> 34) for w, c in pairs)
    d0, d1, d2 = t.discounts
    k_c, k_t = Counter(c >> 34 for _, c in pairs), Counter(k for _, k in entries)
    once = {w for w, _ in entries if sum(n for (x, _), n in entries.items() if x == w) == 1}
    total = 0.0
    for w, c in zip(*(x.tolist() for x in lm.tokens([b"a3 b3 zz a4"])[:2]), strict=True):
        k = c >> 34
        if w and w in set(keys.tolist()):
            assert w in once
        if w == 0:
            continue  # the end has many tables
        p0 = ((w in set(keys.tolist())) * (1 - d0) + (s + d0 * t.root_tables) / (v + 1)) / (s + t.root_customers)
        p1 = ((entries[w, k] - d1) * (entries[w, k] > 0) + (s + d1 * t.tables[k]) * p0) / (s + t.customers[k])
        n = by_ctx[c]
        total += math.log10(((1 - d2) * ((w, c) in pairs) + (s + d2 * n) * p1) / (s + n))
    rest = seats_end.score - total  # the end's own probability after a4, which has not been seen there
    assert -3 < rest < 0
    assert k_c.keys() == {k for k in range(64) if t.customers[k]} and k_t.keys() == k_c.keys()


def test_on_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.op4(none).count() == 0
    (r,) = lm.scores(spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held_out boolean")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == 0 and r.score == pytest.approx(0)
    assert lm.op4(edge_docs(spark)).count() == edge_docs(spark).count()


PAIRS = [(0, 0, 10, 4), (0, 0, 11, 2), (0, 1, 20, 3), (1, 0, 10, 1), (1, 0, 11, 1), (1, 1, 20, 2), (2, 1, 20, 1), (2, 1, 21, 2)]  # word, class, context, customers
DISCOUNTS = (0.4, 0.6, 0.7)  # root, class, context


def tiny():
    entries = sorted({p[:2] for p in PAIRS})
    at = {e: i for i, e in enumerate(entries)}
    multi = [p for p in PAIRS if p[3] > 1]
    once = np.array([sum(p[:2] == e and p[3] == 1 for p in PAIRS) for e in entries])
    core = seating.Core(np.arange(3), np.array([w for w, _ in entries]), np.array([k for _, k in entries]), once, np.array([at[p[:2]] for p in multi]), np.array([p[2] for p in multi]), np.array([p[3] for p in multi]))
    C = np.bincount([p[1] for p in PAIRS], minlength=64)
    T = np.bincount([k for _, k in entries], minlength=64)
    none = np.zeros(0, np.int64)
    totals = seating.Totals(C, T, len(entries), 3, DISCOUNTS, 1.0, 3, none, none.reshape(0, 64), none.reshape(0, 64), none)
    contexts = sorted({p[2] for p in PAIRS})
    return entries, multi, seating.Seats(core, totals, np.array(contexts), np.array([sum(p[2] == u for p in PAIRS) for u in contexts]))


def posterior(entries):
    """Mean numbers of tables over all seatings, by pair, entry and word."""
    root, cls, ctx = map(seating.stirling_table, DISCOUNTS)
    rise = [np.concatenate([[0], np.cumsum(np.log(1 + d * np.arange(40)))]) for d in DISCOUNTS]
    all_of = np.concatenate([[0], np.cumsum(np.log(1 + np.arange(60)))])
    logs, states = [], []
    for t in itertools.product(*[range(1, p[3] + 1) for p in PAIRS]):
        a = sum(ctx[p[3], x] for p, x in zip(PAIRS, t, strict=True)) + sum(rise[2][sum(x for p, x in zip(PAIRS, t, strict=True) if p[2] == u)] for u in {p[2] for p in PAIRS})
        c = [sum(x for p, x in zip(PAIRS, t, strict=True) if p[:2] == e) for e in entries]
        a -= sum(all_of[sum(n for e, n in zip(entries, c, strict=True) if e[1] == k)] for k in (0, 1))
        for te in itertools.product(*[range(1, n + 1) for n in c]):
            b = a + sum(cls[n, x] for n, x in zip(c, te, strict=True)) + sum(rise[1][sum(x for e, x in zip(entries, te, strict=True) if e[1] == k)] for k in (0, 1)) - all_of[sum(te)]
            c0 = [sum(x for e, x in zip(entries, te, strict=True) if e[0] == w) for w in range(3)]
            for t0 in itertools.product(*[range(1, n + 1) for n in c0]):
                logs.append(b + sum(root[n, x] for n, x in zip(c0, t0, strict=True)) + rise[0][sum(t0)] - sum(t0) * math.log(4))
                states.append(t + te + t0)
    p = np.exp(np.array(logs) - max(logs))
    return (p[:, None] * np.array(states)).sum(0) / p.sum()


def test_seating_has_the_exact_posterior():
    entries, multi, seats = tiny()
    want = posterior(entries)
    want = np.concatenate([want[[PAIRS.index(p) for p in multi]], want[len(PAIRS) :]])
    rng, sums, n = np.random.default_rng(3), 0, 6000
    for i in range(n + 100):
        seats.sweep(rng)
        if i >= 100:
            sums = sums + np.concatenate([seats.pt, seats.te, seats.t0])
    assert np.abs(sums / n - want).max() < 0.06


def test_probabilities_sum_to_one():
    entries, _, seats = tiny()
    seats.sweep(np.random.default_rng(1))
    place = {e: i for i, e in enumerate(entries)}
    words = np.array([0, 1, 2, -1])
    assert seats.root(words).sum() == pytest.approx(1)
    for k in (0, 1, 5):
        p = seats.given_class(words, np.full(4, k), np.array([place.get((w, k), -1) for w in words.tolist()]))
        assert p.sum() == pytest.approx(1)


def test_metropolis_steps_keep_the_conditional():
    """Over EXACT customers: frequencies against the whole conditional."""
    rng, n, d = np.random.default_rng(2), 24, 0.5
    many = np.full(20_000, n)
    parent = seating.Parent(np.full(len(many), 3), np.full(len(many), 2), np.zeros(len(many)), np.full(len(many), 50), 0.4)
    t = np.ones(len(many), np.int64)
    for _ in range(30):
        t = seating.draw(rng, many, t, np.full(len(many), 7), parent, d, 1.0)
    i = np.arange(1, n + 1)
    log = seating.stirling_table(d)[n, i] + np.cumsum(np.log(1 + d * (7 + i - 1))) - np.cumsum(np.log(51 + i - 1)) + seating.stirling_table(0.4)[3 + i, 2]
    p = np.exp(log - log.max())
    p /= p.sum()
    assert np.abs(np.bincount(t, minlength=n + 1)[1:] / len(many) - p).max() < 0.015


@pytest.mark.parametrize("d", [0.1, 0.4, 0.7, 0.9])
def test_stirling_numbers_beyond_the_table(d):
    n = 500
    row = np.full(n + 1, -np.inf)
    row[0] = 0
    with np.errstate(divide="ignore"):
        for m in range(n):
            t = np.arange(1, m + 2)
            row[1 : m + 2] = np.logaddexp(row[: m + 1], np.log(np.maximum(m - t * d, 0)) + row[1 : m + 2])
            row[0] = -np.inf
    t = np.array([1, 2, 5, 20, 60, 150, 240, 400, 499, 500])
    assert np.abs(seating.log_stirling(np.full(len(t), n), t, d) - row[t]).max() < 0.03


def test_discounts_are_drawn_near_the_truth():
    rng, d, n = np.random.default_rng(5), 0.6, 4000
    sizes: list[int] = []
    for i in range(n):  # one restaurant whose dishes all differ: sizes of tables are the words' customers
        p = np.array([1 + d * len(sizes), *[x - d for x in sizes]]) / (1 + i)
        k = int(rng.choice(len(p), p=p / p.sum()))
        if k:
            sizes[k - 1] += 1
        else:
            sizes.append(1)
    drawn = seating.draw_discount(rng, [(1.0, x, 1) for x in sizes], [(1.0, len(sizes))], 1.0)
    assert abs(drawn - d) < 0.06


def test_words_are_cut_like_split_and_each_distinct_one_is_hashed_once(monkeypatch):
    hashed = []
    whole = lm.word_hashes
    monkeypatch.setattr(lm, "word_hashes", lambda w: hashed.extend(w) or whole(w))
    odd = [b"", b" ", b"A a A", b"\x1c \x1f\x0b\x0cX\r\n\tx", b"A", "Ünï Ä ä".encode(), b"\x00 a\x00 b\x00\x00", b"a a. a! " * 50]
    for texts in ([b""], odd, odd[::-1], [b"A"]):
        hashed.clear()
        pairs = lm.Pairs(texts, np.ones(len(texts), bool), lm.Layout(5, np.zeros(0, np.int64), np.zeros(0, np.int64)))
        cut = [t.lower().split() for t in texts]
        assert len(hashed) == len(set(hashed)) and set(hashed) - {lm._MARK} == {w for ws in cut for w in ws}
        key = {w: max(1, int(whole([w])[0]) >> 4) for ws in cut for w in ws}
        want = [k for ws in cut for k in [*(key[w] for w in ws), lm.END]]
        assert lm.tokens(texts)[0].tolist() == want == pairs.words[pairs.word[pairs.token]].tolist()
        assert pairs.offsets.tolist() == np.cumsum([0, *(len(ws) + 1 for ws in cut)]).tolist()
        assert pairs.contexts_by(3)[0].tolist() == sorted(set(pairs.context.tolist()), key=lambda c: (c % 3, c))
