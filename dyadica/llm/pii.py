r"""Personal data by patterns and a skip-chain conditional random field.

Base spans (email, ip, card, phone) are found by fixed patterns in the whole text and
stay. The field decides about every other *mention*, in every document: runs of seven
digits or more, words with an ``@``, the name of an email found in the document, emails
and addresses written around the patterns (``name [at] host [dot] org``, ``10[.]0[.]0[.]1``),
and long words of letters and digits that may be secrets. Labels are email, ip, card,
phone, secret and *other*.

Node potentials come from four features of a mention (its size, whether it passes Luhn,
the family of its form, the cue word before it), none of which is the mark that a base
pattern asks for, so that base spans teach what unmarked ones look like. Documents are
counted by these features (a bounded table of under 10,000 signatures, all that comes to
the driver); there expectation maximisation labels the mentions that no pattern labels.

Edges join neighbouring mentions (the chain) and, however far apart (the skips), each
mention with the first of its key and the first of a similar key, base spans before others.
Keys are the last nine digits, the name of an email, a whole secret; similar are the last
seven digits, 12 to 19 digits that differ in one, names that differ in separators or
final numbers, and secrets with one beginning. Edge potentials are log-ratios of joint to independent
label frequencies over all documents. Loopy sum-product messages, sent until they
settle, give each mention its marginals; one whose most probable kind reaches
``threshold`` becomes a span. So a phone number written once with its ``+`` is found where
it is written without, and a token once shown as a secret wherever it is repeated.

Defined cases: a null text is empty and has no spans; repeated rows each get their row
and count each; an empty table leaves the potentials at their priors and gives an empty
result; :func:`redact` keeps all columns, whatever their names; :func:`find_spans`
replaces columns that are named ``base`` or ``spans``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadica.llm.common import chunked, fresh, without

KINDS = ("email", "ip", "card", "phone", "secret")
OTHER = len(KINDS)
#: The kinds that base patterns find.
PATTERNED = KINDS[:4]
THRESHOLD = 0.9
#: Rounds of messages at most; they end where no message changes by more than SETTLED.
ROUNDS, SETTLED = 200, 1e-5
#: Pairs counted in advance for each kind (equal labels) and for each two labels, by type of edge: neighbours, one key, similar keys.
PRIORS = ((0.25, 0.05), (5.0, 0.001), (5.0, 0.002))

_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_RUN = re.compile(r"\(?[0-9](?:[ ().-]{0,2}[0-9]){6,}")
_DIGITS = str.maketrans("", "", " -().+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_KEY = re.compile(r"[A-Za-z0-9_+/-]{16,}={0,2}")
_AT = re.compile(r"[ ]?[\[({][ ]?(?:at|AT|@)[ ]?[\])}][ ]?|[ ](?:at|AT)[ ]")
_SPELT_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|[ ]?[\[({][ ]?(?:dot|DOT|\.)[ ]?[\])}][ ]?|[ ](?:dot|DOT)[ ])[A-Za-z0-9-]+)+")
_BROKEN_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:[ ]?[\[({](?:\.|dot)[\])}][ ]?[0-9]{1,3}){3}(?![0-9])")
_CUE = re.compile(r"([\w-]+)[\s:=#\"'(<\[]*$")
_HEX = re.compile(r"(?:[0-9a-f]{32,}|[0-9A-F]{32,})$")

#: Words before a mention that hint at its kind.
CUES = {
    "email": "email e-mail mail mailto contact courriel correo kontakt",
    "ip": "ip host server",
    "card": "card visa mastercard amex credit carte tarjeta karte kreditkarte",
    "phone": "phone tel telephone call fax mobile cell téléphone teléfono telefon handy",
    "secret": "token secret password passwd pwd key apikey bearer auth authorization credential",
    "other": "order invoice id no nr number isbn ref ticket version date total commit sha hash digest",
}
_CUE_OF = {w: kind for kind, words in CUES.items() for w in words.split()}
#: Forms of digit runs, by their end; the first that fits names the family.
FAMILIES = (
    ("date", re.compile(r"(?:19|20)\d\d[. -]\d{1,2}[. -]\d{1,2}$|\d{1,2}[. -]\d{1,2}[. -](?:19|20)\d\d$")),
    ("paren", re.compile(r".*\(\d{2,5}\)[ .-]?\d{2,4}[ .-]?\d{2,4}$")),
    ("quads", re.compile(r"\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}$")),
    ("amex", re.compile(r"\d{4}[ -]\d{6}[ -]\d{5}$")),
    ("trio", re.compile(r"(?:.*[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}$")),
    ("pairs", re.compile(r".*\d(?:[ .-]\d{2}){3,}$")),
    ("duo", re.compile(r"\d{3}[ .-]\d{4}$")),
    ("abroad", re.compile(r"00\d")),
    ("plain", re.compile(r"\d+$")),
)
#: Labels that a type of mention may have, with how many of each are taken as seen.
LABELS = {
    "run": {"card": 2.0, "phone": 2.0, "other": 8.0},
    "at": {"email": 1.0, "other": 2.0},
    "spelt": {"email": 4.0, "other": 1.0},
    "name": {"email": 1.0, "other": 2.0},
    "ip": {"ip": 4.0, "other": 1.0},
    "key": {"secret": 1.0, "other": 3.0},
}
#: Weights of a feature's values (0 size, 1 Luhn, 2 family, 3 cue) under a label; values not named weigh FLOOR.
HINTS = {
    ("card", 0): {"16": 6, "12": 2}, ("card", 1): {"luhn": 60}, ("card", 2): {"plain": 4, "quads": 4, "amex": 2},
    ("phone", 0): {"9": 8, "7": 1, "12": 2}, ("phone", 1): {"": 8, "not": 2}, ("phone", 2): {"paren": 8, "trio": 8, "pairs": 4, "abroad": 2, "plain": 2, "duo": 1},
    ("other", 1): {"not": 9, "luhn": 1, "": 4},
    ("other", 2): {"plain": 20, "date": 10, "misc": 6, "pairs": 1, "trio": 1, "quads": 1, "hex": 6, "mixed": 4, "lower": 8, "bare": 3, "words": 3, "host": 1},
    ("email", 2): {"host": 6, "bracket": 8, "dotted": 8, "words": 4}, ("ip", 2): {"good": 8}, ("secret", 2): {"hex": 4, "mixed": 6, "lower": 2, "known": 6},
    **{(kind, 3): {kind: 30, "none": 60} for kind in ("email", "ip", "card", "phone", "secret")},
    ("other", 3): {"none": 80, "other": 10, "email": 0.5, "ip": 0.5, "card": 0.5, "phone": 0.5, "secret": 0.5},
}
FLOOR = 0.2
#: Features whose weights are not learned, since base spans have or lack them by their pattern or by chance.
GIVEN = (1, 3)
#: Share of the weights above in what a kind's base spans teach, so that no form of it dies out.
KEPT = 0.2
#: Endings of hosts that are written with words for all their marks.
TLDS = frozenset("com org net edu gov io info co uk de fr es it nl be ch at eu us".split())
_KNOWN_KEY = ("AKIA", "ghp_", "gho_", "sk-", "sk_", "pk_", "xoxb-", "xoxp-", "AIza", "eyJ")
EM_ROUNDS = 30

Node = tuple[int, int, int, str, str]  # start, end, label (-1: none), key, signature


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in (2 * int(x) for x in digits[-2::-2]))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start, then kind."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _NAME:
            begin -= 1
        if begin < at and (m := _HOST.match(text, at + 1)):
            out.append((begin, m.end(), 0))
            free = m.end()
        at = text.find("@", at + 1)
    out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) < 256 for x in m[0].split("."))]
    out += [(m.start(), m.end(), 2) for m in _CARD.finditer(text) if 12 <= len(d := m[0].translate(_DIGITS)) <= 19 and luhn(d)]
    out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= len(m[0].translate(_DIGITS)) <= 15]
    return sorted(out, key=_place)


def _place(span: tuple[int, int, int]) -> tuple[int, int]:
    """Spans stand by start, then kind, whichever ends first."""
    return span[0], span[2]


def _cue(text: str, at: int) -> str:
    m = _CUE.search(text[max(0, at - 40) : at])
    if not m:
        return "none"
    word = m[1].lower()
    return _CUE_OF.get(word) or _CUE_OF.get(re.split(r"[_-]", word)[-1], "none")


def _digit_signature(piece: str) -> str:
    d = piece.translate(_DIGITS)
    size = "7" if len(d) < 9 else "9" if len(d) < 12 else "12" if len(d) < 16 else "16" if len(d) < 20 else "20"
    check = "" if not 12 <= len(d) <= 19 else "luhn" if luhn(d) else "not"
    family = next((name for name, form in FAMILIES if form.match(piece)), "misc")
    return f"run|{size}|{check}|{family}"


def _digit_key(piece: str) -> str:
    return piece.translate(_DIGITS)[-9:]


def _runs(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Digit runs beside no letter; those too long for one number fall into their words."""
    for m in _RUN.finditer(text):
        a, b = m.span()
        if (a and (text[a - 1].isalnum() or text[a - 1] == "_")) or (b < len(text) and (text[b].isalnum() or text[b] == "_")):
            continue
        pieces = [(a, b)]
        if sum(map(str.isdigit, m[0])) > 19:
            pieces = [(a + w.start(), a + w.end()) for w in re.finditer(r"[^ ]+", m[0])]
        for i, j in pieces:
            piece = text[i:j]
            if piece.startswith("(") and ")" not in piece:
                i, piece = i + 1, piece[1:]
            if sum(map(str.isdigit, piece)) >= 7:
                yield i, j, _digit_key(piece), _digit_signature(piece)


def _keys(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Words of 16 letters and digits or more that hold both."""
    for m in _KEY.finditer(text):
        word = m[0]
        if (m.start() and text[m.start() - 1].isalnum()) or not any(map(str.isdigit, word)) or not any(map(str.isalpha, word)):
            continue
        family = "known" if word.startswith(_KNOWN_KEY) else "hex" if _HEX.match(word) else "mixed" if word.lower() != word and word.upper() != word else "lower"
        yield *m.span(), "#" + word, f"key|{'16' if len(word) < 32 else '32'}||{family}"


def _spelt(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Emails written with words or brackets for their marks."""
    for m in _AT.finditer(text):
        begin = m.start()
        while begin and text[begin - 1] in _NAME:
            begin -= 1
        host = _SPELT_HOST.match(text, m.end())
        if begin == m.start() or not host:
            continue
        marked, dotted = m[0].strip()[0] in "[({", re.search(r"dot|DOT|[\[({]", host[0])
        if marked or (dotted and host[0].split()[-1].lower() in TLDS):
            yield begin, host.end(), "@" + text[begin : m.start()].lower(), f"spelt|{'2' if marked and dotted else '1'}||{'bracket' if marked else 'dotted'}"


def _names(text: str, names: set[str]) -> Iterator[tuple[int, int, str, str]]:
    """Words with an ``@``, and those equal to the name of an email of the text."""
    if "@" not in text:
        return
    for m in _WORD.finditer(text):
        core = m[0].strip(".,;:!?()[]<>\"'")
        name, at, host = core.partition("@")
        begin = m.start() + m[0].find(core)
        if at:
            yield begin, begin + len(core), "@" + name.lower(), f"at|{'1' if name else '0'}||{'host' if name and '.' in host.strip('.') else 'bare'}"
        elif core.lower() in names and len(core) >= 5 and any(c in "0123456789._" for c in core):
            yield begin, begin + len(core), "@" + core.lower(), "name|1||words"


def _addresses(text: str) -> Iterator[tuple[int, int, str, str]]:
    for m in _BROKEN_IP.finditer(text):
        parts = re.findall(r"[0-9]+", m[0])
        yield *m.span(), ".".join(str(int(p)) for p in parts), f"ip|4||{'good' if all(int(p) < 256 for p in parts) else 'bad'}"


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[Node]:
    """Base spans, and what else may be one, by start; of mentions that overlap the first type stands."""
    out: list[Node] = []
    names = set()
    for a, b, kind in base:
        piece = text[a:b]
        if kind == 0:
            name = piece.split("@")[0].lower()
            names.add(name)
            key, shape = "@" + name, "at|1||host"
        elif kind == 1:
            key, shape = ".".join(x.lstrip("0") or "0" for x in piece.split(".")), "ip|4||good"
        else:
            key, shape = _digit_key(piece), _digit_signature(piece.lstrip("+"))
        out.append((a, b, kind, key, f"{shape}|{_cue(text, a)}"))
    taken = [(a, b) for a, b, _ in base]
    for found in (_spelt(text), _names(text, names), _addresses(text), _keys(text), _runs(text)):
        found = list(found)
        if not found:
            continue
        taken.sort()
        starts = [a for a, _ in taken]
        reach = np.maximum.accumulate([b for _, b in taken]) if taken else None
        for a, b, key, shape in found:
            i = int(np.searchsorted(starts, b)) if taken else 0
            if not i or reach[i - 1] <= a:
                out.append((a, b, -1, key, f"{shape}|{_cue(text, a)}"))
        taken = [(x[0], x[1]) for x in out]
    return sorted(out)


def similar_keys(key: str) -> list[str]:
    """What a key shares with those that may mean the same."""
    if key.startswith("@"):
        plain = re.sub(r"[._+-]|\d+$", "", key[1:])
        return [f"~@{plain}"] if len(plain) >= 5 else []
    if key.startswith("#"):
        return [f"~#{key[1:13]}"]
    return []


def _number_keys(text: str, x: Node) -> list[str]:
    d = text[x[0] : x[1]].translate(_DIGITS)
    out = [f"~{d[-7:]}"] if len(d) >= 7 else []
    if 12 <= len(d) <= 19:
        out += [f"~{len(d)}:{i}:{d[:i]}{d[i + 1 :]}" for i in range(len(d))]
    return out


def edges(nodes: list[Node], text: str) -> list[tuple[int, int, int]]:
    """(i, j, type): 0 chain, 1 skip to the first mention of the same key, 2 to the first of a similar key; base spans count as first."""
    out = {(i, i + 1): 0 for i in range(len(nodes) - 1)}
    hub: dict[str, int] = {}
    order = sorted(range(len(nodes)), key=lambda i: nodes[i][2] < 0)
    for i in order:
        if nodes[i][3]:
            hub.setdefault(nodes[i][3], i)
    near: dict[str, int] = {}
    for i in order:
        x = nodes[i]
        if not x[3]:
            continue
        h = hub[x[3]]
        if h != i:
            out[min(i, h), max(i, h)] = 1
            continue
        for k in similar_keys(x[3]) + (_number_keys(text, x) if x[4].startswith("run") else []):
            j = near.setdefault(k, i)
            if j != i and out.get((min(i, j), max(i, j)), 0) == 0:
                out[min(i, j), max(i, j)] = 2
    return [(i, j, t) for (i, j), t in out.items()]


class Field:
    """Potentials: of nodes by signature, and of the three types of edges."""

    def __init__(self, signatures: dict[tuple[str, int], float], pairs: np.ndarray):
        """signatures: how many mentions have a signature and a label (-1: none known)."""
        n = OTHER + 1
        self.values = [sorted({s.split("|")[f + 1] for s, _ in signatures} | {v for (_, g), hints in HINTS.items() if g == f for v in hints}) for f in range(4)]
        self.place = [{v: i for i, v in enumerate(vs)} for vs in self.values]
        self.types = list(LABELS)
        prior = np.array([[LABELS[t].get(k, 0.0) for k in (*KINDS, "other")] for t in self.types])
        self.hints = [np.full((n, len(vs)), FLOOR) for vs in self.values]
        for (label, f), hints in HINTS.items():
            for v, c in hints.items():
                self.hints[f][(*KINDS, "other").index(label), self.place[f][v]] = c
        rows = sorted(signatures.items())
        type_of, at = self._read([s for (s, _), _ in rows])
        label = np.array([x for (_, x), _ in rows], int)
        weight = np.array([w for _, w in rows], float)
        share = np.zeros((len(rows), n))
        share[np.flatnonzero(label >= 0), label[label >= 0]] = 1
        for _ in range(EM_ROUNDS if len(rows) else 1):
            self._fit(prior, type_of, at, share * weight[:, None], label)
            share[label < 0] = np.exp(self._scores(type_of, at))[label < 0]
        self.edge = []
        for counts, (equal, each) in zip(pairs, PRIORS, strict=True):
            p = (counts + counts.T) / 2 + equal * np.eye(n) + each
            p /= p.sum()
            self.edge.append(np.log(p / np.outer(p.sum(1), p.sum(0))))

    def _read(self, signatures: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [s.split("|") for s in signatures]
        return np.array([self.types.index(p[0]) for p in parts], int), np.array([[self.place[f].get(p[f + 1], -1) for f in range(4)] for p in parts], int).reshape(-1, 4)

    def _fit(self, prior: np.ndarray, type_of: np.ndarray, at: np.ndarray, share: np.ndarray, label: np.ndarray) -> None:
        """Labels by type and *other*'s features from all mentions, a kind's features from its base spans."""
        labels = prior.copy()
        np.add.at(labels, type_of, share)
        self.label = np.where(prior > 0, np.log(np.maximum(labels, 1e-12) / labels.sum(1, keepdims=True)), -30.0)
        self.feature = []
        for f, hints in enumerate(self.hints):
            told = hints / hints.sum(1, keepdims=True)
            if f not in GIVEN:
                seen = np.zeros_like(hints)
                np.add.at(seen.T, at[:, f], share * (label >= 0)[:, None])
                some = seen.sum(1) > 0
                told[some] = KEPT * told[some] + (1 - KEPT) * seen[some] / seen[some].sum(1, keepdims=True)
                other = hints[OTHER].copy()
                np.add.at(other, at[:, f], share[:, OTHER])
                told[OTHER] = other / other.sum()
            self.feature.append(np.log(told))

    def _scores(self, type_of: np.ndarray, at: np.ndarray) -> np.ndarray:
        s = self.label[type_of] + sum(np.where(at[:, f, None] >= 0, table.T[at[:, f]], 0.0) for f, table in enumerate(self.feature))
        s -= s.max(1, keepdims=True)
        return s - np.log(np.exp(s).sum(1, keepdims=True))

    def node(self, nodes: list[Node]) -> np.ndarray:
        unary = self._scores(*self._read([x[4] for x in nodes]))
        for i, x in enumerate(nodes):
            if x[2] >= 0:
                unary[i] = -1e9
                unary[i, x[2]] = 0
        return unary

    def marginals(self, unary: np.ndarray, joined: list[tuple[int, int, int]], rounds: int = ROUNDS) -> np.ndarray:
        """Loopy sum-product over edges (i, j, type) until messages settle, at most ``rounds``."""
        n = OTHER + 1
        if joined:
            ends = np.array(joined, int)
            src, dst = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
            table = np.array(self.edge)[np.concatenate([ends[:, 2]] * 2)]
            back = np.concatenate([np.arange(len(joined)) + len(joined), np.arange(len(joined))])
            sent = np.zeros((len(src), n))
            for _ in range(rounds):
                belief = unary.copy()
                np.add.at(belief, dst, sent)
                out = (belief[src] - sent[back])[:, :, None] + table
                top = out.max(1)
                new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
                new -= new.max(1, keepdims=True)
                if np.abs(new - sent).max(initial=0) < SETTLED:
                    break
                sent = 0.5 * sent + 0.5 * new
            unary = unary.copy()
            np.add.at(unary, dst, sent)
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def spans(self, text: str, threshold: float = THRESHOLD) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and all spans by start, then kind."""
        base = base_spans(text)
        nodes = mentions(text, base)
        if len(nodes) == len(base):
            return base, base
        p = self.marginals(self.node(nodes), edges(nodes, text))
        kinds = p[:, :OTHER].argmax(1)
        more = [(x[0], x[1], k) for x, k, row in zip(nodes, kinds.tolist(), p, strict=True) if x[2] < 0 and row[k] >= threshold]
        return base, sorted(base + more, key=_place)


def learn(docs: DataFrame, text_col: str = "text") -> Field:
    """Counts over all documents: mentions by signature and label, and label pairs of base spans by type of edge."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, int, int]] = Counter()
        for _, texts in chunked(batches, "text"):
            for raw in texts:
                text = raw.decode("utf-8", "replace")
                nodes = mentions(text, base_spans(text))
                counts.update((x[4], x[2], -1) for x in nodes)
                counts.update((str(t), nodes[i][2], nodes[j][2]) for i, j, t in edges(nodes, text) if nodes[i][2] >= 0 and nodes[j][2] >= 0)
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], names=["what", "a", "b", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(kernel, "what string, a int, b int, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
    pairs = np.zeros((len(PRIORS), OTHER + 1, OTHER + 1))
    for r in rows:
        if r["b"] >= 0:
            pairs[int(r["what"]), r["a"], r["b"]] += r["n"]
    return Field({(r["what"], r["a"]): float(r["n"]) for r in rows if r["b"] < 0}, pairs)


def find_spans(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, also: list[str] | None = None) -> DataFrame:
    """The columns ``also`` (default: all) of docs, then ``base`` and ``spans``: arrays of (start, end, kind) in code points."""
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, text_col))
    out, text = without(docs.columns if also is None else also, "base", "spans"), fresh(docs, "__text")
    shape = "array<struct<start:int,end:int,kind:string>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunked(batches, text):
            found = [held.value.spans(t.decode("utf-8", "replace"), threshold) for t in texts]
            cols = [pa.array([[{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in f[i]] for f in found], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(list(part.columns)[: len(out)] + cols, names=[*out, "base", "spans"])

    own = docs.select(*[docs[f"`{c}`"] for c in out], docs[f"`{text_col}`"].alias(text))
    schema = own.drop(text).limit(0).withColumns({"base": F.lit(None).cast(shape), "spans": F.lit(None).cast(shape)}).schema
    return own.mapInArrow(kernel, schema)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with each span (overlapping ones as one, named by the first) replaced by its kind in angle brackets; a null text stays null, and length_col, if there is one, is the new text's length."""
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, text_col))
    schema = docs.schema
    at = docs.columns.index(text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunked(batches, text_col):
            old, new = part.column(at), []
            for null, raw in zip(old.is_null().to_pylist(), texts, strict=True):
                t = raw.decode("utf-8", "replace")
                spans = held.value.spans(t, threshold)[1]
                if spans:
                    pieces, free = [], 0
                    for a, b, kind in spans:
                        if a >= free:
                            pieces += [t[free:a], f"<{KINDS[kind]}>"]
                        free = max(free, b)
                    t = "".join([*pieces, t[free:]])
                new.append(None if null else t)
            cols = list(part.columns)
            cols[at] = pa.array(new, old.type)
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    out = docs.mapInArrow(kernel, schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(schema[length_col].dataType))
    return out


def op3(docs: DataFrame) -> DataFrame:
    """The digest of the contract: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans."""
    found = find_spans(docs.select("doc_id", "text"), also=["doc_id"])
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    counts = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in PATTERNED]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
