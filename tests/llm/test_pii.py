"""The skip-chain field: planted mentions that no base pattern finds, and marginals against enumeration."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.fixtures import edge_docs

from dyadica.llm import pii

FILL = "the report of last week was read by all and then laid aside until someone asks for it again".split()


def card(rnd):
    d = "4" + "".join(rnd.choice("0123456789") for _ in range(14))
    return next(d + c for c in "0123456789" if pii.luhn(d + c))


def planted(seed, n=400):
    """(text, [(start, end, kind)] that a reader would mark beyond the base spans): each kind with and without a base span, and decoys."""
    rnd = random.Random(seed)
    digits = lambda k: "".join(rnd.choice("123456789") for _ in range(k))
    out = []
    for i in range(n):
        pieces, want = [], []

        def say(x, kind=None, pieces=pieces, want=want):
            pieces.append((x, kind))

        def fill(k=None, pieces=pieces):
            pieces.extend((rnd.choice(FILL), None) for _ in range(k or rnd.randint(3, 30)))

        fill()
        a, b, c = digits(3), digits(3), digits(4)
        case = i % 12
        if case == 0:  # once with its plus, then bare
            say(f"+1 ({a}) {b}-{c}")
            fill()
            for form in (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}{b}{c}"):
                say(form, "phone")
                fill()
        elif case == 1:  # never with a plus
            say("call")
            say(f"({a}) {b}-{c}", "phone")
        elif case == 2:
            say(f"{rnd.choice('abcdef')}{digits(2)}.{rnd.choice(FILL)} [at] mail{digits(1)} [dot] example [dot] org", "email")
        elif case == 3:  # a secret shown once, then repeated far away
            key = "".join(rnd.choice("0123456789abcdef") for _ in range(40))
            say('token = "')
            say(key, "secret")
            fill(60)
            say(key, "secret")
        elif case == 4:  # a card, and the same with one wrong digit
            d = card(rnd)
            at = rnd.randrange(4, 15)
            say(d)
            fill()
            say(d[:at] + str((int(d[at]) + 1) % 10) + d[at + 1 :], "card")
        elif case == 5:
            say(f"password: {rnd.choice('XYZ')}{digits(4)}qwErTyUi{digits(5)}Ab", "secret")
            pieces[-1:] = [("password:", None), (pieces[-1][0].split()[1], "secret")]
        elif case == 6:  # an email, then its name
            name = f"{rnd.choice(FILL)}.{rnd.choice(FILL)}{digits(2)}"
            say(f"{name}@mail.example.com")
            fill()
            say(name, "email")
        elif case == 7:
            say("server")
            say(f"10[.]{rnd.randint(0, 255)}[.]{rnd.randint(0, 255)}[.]{rnd.randint(1, 255)}", "ip")
        elif case == 8:  # decoys: a date, an order, no card, a hash of no stated use
            for x in ("2024-03-1" + digits(1), "order", digits(8), "at home", "version 1.2.3"):
                say(x)
                fill()
        elif case == 9:
            d = next(x for x in iter(lambda: digits(16), None) if not pii.luhn(x))
            say(d)
            fill()
            say("commit")
            say("".join(rnd.choice("0123456789abcdef") for _ in range(40)))
        elif case == 10:
            say(f"+1 ({a}) {b}-{c}")
            fill()
            say(card(rnd))
        else:
            say("@" + rnd.choice(FILL))
            fill()
            say("look at the dot on page 1234567")
        fill()
        text = ""
        for x, kind in pieces:
            glue = "" if text.endswith('"') else " " if text else ""
            begin = len(text) + len(glue)
            text += glue + x
            if kind:
                want.append((begin, begin + len(x), kind))
        out.append((text, want))
    return out


def test_field_finds_what_patterns_miss(spark):
    docs = planted(5)
    got = {r.doc_id: r for r in pii.find_spans(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(docs)], "doc_id long, text string")).collect()}
    hit = made = wanted = 0
    for i, (_, want) in enumerate(docs):
        base = {tuple(s) for s in got[i].base}
        added = {tuple(s) for s in got[i].spans} - base
        assert base <= {tuple(s) for s in got[i].spans}
        hit += len(added & set(want))
        made += len(added)
        wanted += len(set(want) - base)
    assert hit / wanted >= 0.9, (hit, wanted)  # recall of added spans
    assert hit / made >= 0.9, (hit, made)  # precision
    alone = [i for i in range(len(docs)) if i % 12 in (1, 2, 3)]
    assert all(got[i].spans and not got[i].base for i in alone if i % 12 != 3)


def field(seed):
    rnd = np.random.default_rng(seed)
    made = pii.Field({}, rnd.random((3, pii.OTHER + 1, pii.OTHER + 1)) * 3)
    return made, rnd


def exact(made, unary, joined):
    k, n = unary.shape
    joint = np.zeros([n] * k)
    for x in np.ndindex(*joint.shape):
        joint[x] = sum(unary[i, x[i]] for i in range(k)) + sum(made.edge[t][x[i], x[j]] for i, j, t in joined)
    p = np.exp(joint - joint.max())
    p /= p.sum()
    return np.array([p.sum(tuple(j for j in range(k) if j != i)) for i in range(k)])


def test_messages_are_exact_on_trees():
    made, rnd = field(1)
    unary = rnd.normal(size=(5, pii.OTHER + 1))
    unary[2] = -1e9
    unary[2, 3] = 0
    joined = [(0, 1, 0), (1, 2, 1), (1, 3, 2), (3, 4, 0)]
    assert np.allclose(made.marginals(unary, joined), exact(made, unary, joined), atol=1e-4)


@pytest.mark.parametrize("seed", [2, 3, 4])
def test_messages_are_near_on_loops(seed):
    made, rnd = field(seed)
    unary = rnd.normal(size=(5, pii.OTHER + 1))
    joined = [(0, 1, 0), (1, 2, 0), (2, 3, 0), (3, 4, 0), (0, 3, 1), (1, 4, 2)]
    assert np.abs(made.marginals(unary, joined) - exact(made, unary, joined)).max() < 0.08


def test_marginals_decide_and_not_the_keys(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(planted(6, 120))], "doc_id long, text string")
    made = pii.learn(docs)
    base, spans = made.spans('x token = "0123456789abcdef0123456789abcdef01234567" y')
    assert not base and [s[2] for s in spans] == [pii.KINDS.index("secret")]
    assert made.spans('x token = "0123456789abcdef0123456789abcdef01234567" y', threshold=1.01)[1] == []
    assert made.spans("x commit 0123456789abcdef0123456789abcdef01234567 y")[1] == []


def test_defined_cases(spark):
    docs = edge_docs(spark).withColumn("base", F.col("key"))
    assert pii.find_spans(docs).columns == [c for c in docs.columns if c not in ("base", "spans")] + ["base", "spans"]
    assert pii.find_spans(docs).count() == docs.count() == pii.redact(docs).count()
    assert pii.redact(docs).columns == docs.columns
    none = docs.limit(0)
    assert pii.find_spans(none).count() == pii.redact(none).count() == pii.op3(none).count() == 0
    null = {r.doc_id: r for r in pii.find_spans(docs).collect()}[0]
    assert null.spans == [] and null.base == []
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()}[0] is None


def test_a_text_with_very_many_mentions_ends(spark):
    text = " ".join(f"+1 (555) 010-{i % 10_000:04d} or 555-010-{i % 10_000:04d}" for i in range(20_000))
    (r,) = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(r.base) == 20_000 and len(r.spans) == 40_000
