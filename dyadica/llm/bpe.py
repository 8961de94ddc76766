r"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

Texts are cut at white space; white space never reaches a token, so each chunk is
encoded alone. The most frequent chunks of the whole corpus (counted exactly, at
most ``lexicon_size``, equal counts all or none) are compiled with their ids into a
minimal deterministic automaton over UTF-8 bytes: equal suffixes share states, and
counts on the arcs give each word its rank, which points into a table of ids
(a minimal perfect hash, as in the usual output-by-counting transducers). Its
arrays lie in a file of the shared folder that workers map into memory. A chunk that the automaton does
not hold is normalised, split and merged exactly; special tokens' strings are found
first, as they may stand anywhere.

Defined cases: a null or empty text has no ids and decodes to the empty string;
repeated rows and null ids each get their row; an empty table gives an empty lexicon
and result; other columns pass through, but for those named ``ids`` or ``decoded``,
which are replaced.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadica.llm.common import CHUNK_BYTES, chunked, fresh, give_back, materialise, publish, without

LEXICON_SIZE = 65_536
#: Distinct chunks that a worker counts or pieces that it remembers at once; of chunks it remembers twice as many, at about 200 bytes.
MEMO = 300_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable Latin-1, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Lookup:
    """Places of integer keys by open addressing, for many at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys.astype(np.int64), -1)  # a place of -1 finds no key
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        self.probes = 0
        left, slot = np.arange(len(keys)), self._slot(self.keys[:-1])
        while len(left):
            self.probes += 1
            free = np.flatnonzero(self.slots[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            taken = free[one]
            self.slots[slot[taken]] = left[taken]
            rest = np.ones(len(left), bool)
            rest[taken] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if absent."""
        slot = self._slot(keys)
        out = self.slots[slot]
        other = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        for _ in range(self.probes - 1):
            if not len(other):
                break
            slot[other] = (slot[other] + 1) & self.mask
            out[other] = self.slots[slot[other]]
            other = other[(out[other] >= 0) & (self.keys[out[other]] != keys[other])]
        out[other] = -1
        return out


class Merger:
    """Exact encoding and decoding by a tokenizer file: normalise, split, merge by rank."""

    def __init__(self, config: str):
        spec = json.loads(config)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.pairs = Lookup(np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in pairs], np.int64))  # found at their rank
        self.joined_ids = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        letters = byte_letters()
        self.byte_ids = np.array([self.vocab[c] for c in letters], np.int64)
        self.end_ids = np.array([self.vocab[c + self.suffix] for c in letters], np.int64)
        self.memo: dict[str, bytes] = {}  # ids, little-endian
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        split = next(s for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split")
        self.split_at = regex.compile(split["pattern"]["Regex"])
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}

    def merged(self, word: str) -> list[int]:
        """Ids of one piece of text that the splitting pattern matched."""
        if word not in self.memo:
            self.merge_all([word])
        return np.frombuffer(self.memo[word], "<u4").tolist()

    def merge_all(self, words: list[str]) -> None:
        """Merge pieces abreast and remember them. In each round every piece joins its pair of least rank, wherever the pair stands, leftmost first; pieces without a pair that can be joined are done."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        raw = [w.encode() for w in words]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        word = np.repeat(np.arange(len(raw)), lens)
        symbol = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        last = np.cumsum(lens) - 1
        symbol[last] = self.end_ids[np.frombuffer(b"".join(w[-1:] for w in raw), np.uint8)]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            joins = np.flatnonzero(word[1:] == word[:-1])
            key = symbol[joins].astype(np.int64) << 32 | symbol[joins + 1]
            at = self.pairs.find(key)
            rank = np.full(len(symbol), len(self.ranks), np.int64)
            rank[joins] = np.where(at >= 0, at, len(self.ranks))
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(first, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, first), size)
            going = least < len(self.ranks)
            done.append((word[~going], symbol[~going]))
            word, symbol, rank, least = word[going], symbol[going], rank[going], least[going]
            hit = rank == least
            if not len(hit):
                break
            # of touching pairs (a a a) every other one, from the left
            index = np.arange(len(hit))
            begin = hit & ~np.concatenate([[False], hit[:-1]])
            hit &= (index - np.maximum.accumulate(np.where(begin, index, 0))) % 2 == 0
            symbol = np.where(hit, self.joined_ids[np.minimum(rank, len(self.ranks) - 1)], symbol)
            stays = ~np.concatenate([[False], hit[:-1]])
            word, symbol = word[stays], symbol[stays]
        word, symbol = (np.concatenate([d[i] for d in done]) for i in (0, 1)) if done else (np.zeros(0, np.int64),) * 2
        order = np.argsort(word, kind="stable")
        ends = np.searchsorted(word[order], np.arange(len(raw) + 1))
        flat, ends = symbol[order].astype("<u4").tobytes(), (4 * ends).tolist()
        self.memo.update(zip(words, [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)], strict=True))

    def chunk(self, text: str) -> list[int]:
        """Ids of a text of which no special token's string crosses the ends."""
        out: list[int] = []
        at = 0
        for m in self.special_at.finditer(text) if self.special_at else ():
            out += self._plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._plain(text[at:])

    def pieces(self, text: str) -> list[str]:
        """What is merged of a text without special tokens' strings."""
        if text.isascii():
            text = text.lower()
        else:  # lower-casing goes character by character: no final sigma
            text = "".join(map(str.lower, unicodedata.normalize("NFC", text)))
        return self.split_at.findall(text)

    def _plain(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in self.merged(p)] if text else []

    def chunks(self, texts: list[str]) -> list[bytes]:
        """Ids of many chunks, little-endian; their new pieces are merged together."""
        plain = [None if self.special_at and "<|" in t and self.special_at.search(t) else self.pieces(t) for t in texts]
        new = {p for x in plain if x for p in x}
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.merge_all([p for p in new if p not in self.memo])
        memo = self.memo
        return [np.array(self.chunk(t), "<u4").tobytes() if x is None else memo[x[0]] if len(x) == 1 else b"".join([memo[p] for p in x]) for t, x in zip(texts, plain, strict=True)]

    def decoded(self, ids: list[int]) -> str:
        """Tokens joined by one space: the file names no decoder."""
        return " ".join(self.tokens[i] for i in ids)


class Lexicon:
    """Words and their ids in a minimal acyclic automaton whose arrays are mapped from one file."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.first, self.label, self.target, self.skip, self.final, self.at, self.ids = (arrays[k] for k in ("first", "label", "target", "skip", "final", "at", "ids"))
        self.arcs = Lookup(self.label)

    @staticmethod
    def compiled(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
        """Incremental construction from sorted words: a state is frozen, and shared with an equal one, when the next word leaves it."""
        register: dict[tuple, int] = {}
        rows: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def freeze(node: tuple[list[bool], list[list]]) -> int:
            key = (node[0][0], tuple((b, t) for b, t in node[1]))
            if key not in register:
                register[key] = len(rows)
                rows.append(key)
            return register[key]

        path: list[tuple[list[bool], list[list]]] = [([False], [])]
        before = b""
        ordered = sorted(words)
        for w in ordered:
            shared = len(os.path.commonprefix([before, w]))
            while len(path) - 1 > shared:
                done = freeze(path.pop())
                path[-1][1][-1][1] = done
            for b in w[shared:]:
                path[-1][1].append([b, -1])
                path.append(([False], []))
            path[-1][0][0] = True
            before = w
        while len(path) > 1:
            done = freeze(path.pop())
            path[-1][1][-1][1] = done
        root = freeze(path[0])
        below = np.zeros(len(rows), np.int64)  # words accepted from a state; targets come before their sources
        first, label, target, skip = np.zeros(len(rows) + 1, np.int64), [], [], []
        for s, (final, edges) in enumerate(rows):
            n = int(final)
            for b, t in edges:
                label.append(s * 256 + b)
                target.append(t)
                skip.append(n)
                n += below[t]
            below[s] = n
            first[s + 1] = len(label)
        outputs = [words[w] for w in ordered]
        at = np.zeros(len(ordered) + 1, np.int64)
        np.cumsum([len(x) for x in outputs], out=at[1:])
        ids = np.array([i for x in outputs for i in x], np.uint32)
        return {"first": np.array([root], np.int64), "label": np.array(label, np.int64), "target": np.array(target, np.int64), "skip": np.array(skip, np.int64), "final": np.array([f for f, _ in rows], bool), "at": at, "ids": ids.astype("<u4")}

    @staticmethod
    def packed(arrays: dict[str, np.ndarray]) -> bytes:
        """One image: a JSON line with types, lengths and places, then the arrays at multiples of 8."""
        head, body, place = {}, [], 0
        for k, a in arrays.items():
            head[k] = (a.dtype.str, len(a), place)
            raw = a.tobytes()
            raw += bytes(-len(raw) % 8)
            body.append(raw)
            place += len(raw)
        line = json.dumps(head).encode()
        line += b" " * (-(len(line) + 1) % 8) + b"\n"
        return line + b"".join(body)

    @classmethod
    def mapped(cls, image: bytes | None, path: str | None = None) -> Lexicon:
        """The lexicon from its file in the shared folder, mapped so that workers of a machine share its pages; where that is no mounted folder, from the image in anonymous mapped memory."""
        if path:
            with open(path, "rb") as f:
                held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            held = mmap.mmap(-1, max(1, len(image)))
            held[: len(image)] = image
        raw = np.frombuffer(held, np.uint8)
        start = held.find(b"\n") + 1
        return cls({k: raw[start + at : start + at + np.dtype(kind).itemsize * n].view(kind) for k, (kind, n, at) in json.loads(held[:start]).items()})

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 if absent: all words walk the automaton abreast, a byte at a time."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.label) or not words:
            return out
        lens = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(lens) - lens
        live, state, rank = np.arange(len(words)), np.full(len(words), self.first[0], np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(live):
            done = lens[live] == step
            ends = live[done]
            ok = self.final[state[done]]
            out[ends[ok]] = rank[done][ok]
            live, state, rank = live[~done], state[~done], rank[~done]
            key = state * 256 + letters[begin[live] + step]
            at = self.arcs.find(key)
            go = at >= 0
            live, state, rank = live[go], self.target[at[go]], rank[go] + self.skip[at[go]]
            step += 1
        return out


def _chunks(text: bytes) -> list[bytes]:
    """Cut at white space as the tokenizer knows it (Unicode White_Space; str.split() also cuts at U+001C to U+001F)."""
    if text.isascii() or not _WIDE_SPACE.search(text):
        return text.split()
    return [w.encode() for w in _SPACE.split(text.decode("utf-8", "replace")) if w]


_SPACE = regex.compile(r"\s+")
#: UTF-8 of what may be white space beyond ASCII.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80|\xe2\x81\x9f|\xe3\x80\x80")


def frequent_chunks(docs: DataFrame, text_col: str = "text", size: int = LEXICON_SIZE) -> list[bytes]:
    """The most frequent chunks of all texts, ``size`` at most; counted in the workers before the shuffle. Counts are cut between two levels (each count of a chunk below 4096, 64 levels an octave above), so that the driver gets a short histogram and then fewer chunks than ``size``, never more for more partitions."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for _, texts in chunked(batches, "text"):
            for t in texts:
                counts.update(_chunks(t))
            if len(counts) > MEMO:
                yield from flushed(counts)
                counts.clear()
        yield from flushed(counts)
        del counts
        give_back()

    def flushed(counts: Counter[bytes]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["w", "n"])

    counted = materialise(docs.select(F.col(text_col).alias("text")).mapInArrow(kernel, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")), "chunks")
    level = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.floor(F.log2("n") * 64) + 4096)
    held, above = 0, None
    for r in sorted(counted.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        held += r["count"]
        if held > size:
            break
        above = r["level"]
    if above is None:
        return []
    return sorted(bytes(r["w"]) for r in counted.where(level >= above).select("w").collect())


class Coder:
    """What a worker holds: the mapped lexicon, the merger, and the ids of the last chunks seen."""

    def __init__(self, config: str, image: bytes | None, path: str | None = None):
        self.merger, self.lexicon = Merger(config), Lexicon.mapped(image, path)
        self.memo: dict[bytes, bytes] = {}

    def learn(self, chunks: set[bytes]) -> None:
        if len(self.memo) > 2 * MEMO:
            self.memo.clear()
        new = [w for w in chunks if w not in self.memo]
        ranks = self.lexicon.ranks(new).tolist()
        at, ids = self.lexicon.at, self.lexicon.ids
        for w, r in zip(new, ranks, strict=True):
            if r >= 0:
                self.memo[w] = ids[at[r] : at[r + 1]].tobytes()
        unseen = [w for w, r in zip(new, ranks, strict=True) if r < 0]
        self.memo.update(zip(unseen, self.merger.chunks([w.decode("utf-8", "replace") for w in unseen]), strict=True))

    def encoded(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, little-endian."""
        lists = [_chunks(t) for t in texts]
        self.learn({w for x in lists for w in x})
        memo = self.memo
        return [b"".join([memo[w] for w in x]) for x in lists]


_coders: dict[str, Coder] = {}


def _coder(config: str, image: bytes | None, path: str | None) -> Coder:
    key = path or hashlib.sha256(image).hexdigest()
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(config, image, path)
    return _coders[key]


def encode(docs: DataFrame, tokenizer: str, *, text_col: str = "text", lexicon_size: int = LEXICON_SIZE) -> DataFrame:
    """All columns of docs, then ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded``. tokenizer: path of the tokenizer file, read on the driver."""
    with open(tokenizer, encoding="utf-8") as f:
        config = f.read()
    merger = Merger(config)
    frequent = frequent_chunks(docs, text_col, lexicon_size)
    found = merger.chunks([w.decode("utf-8", "replace") for w in frequent])
    words = {w: np.frombuffer(x, "<u4").tolist() for w, x in zip(frequent, found, strict=True)}
    spark = docs.sparkSession
    image = Lexicon.packed(Lexicon.compiled(words))
    path = publish(spark, image, "lexicon")
    held = spark.sparkContext.broadcast((config, None if path else image, path))
    names, text = without(docs.columns, "ids", "decoded"), fresh(docs, "__text")
    own = docs.select(*[docs[f"`{c}`"] for c in names], docs[f"`{text_col}`"].alias(text))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(*held.value)
        tokens = np.array([coder.merger.tokens.get(i, "") for i in range(max(coder.merger.tokens) + 1)], object)
        for part, texts in chunked(batches, text, CHUNK_BYTES // 2):
            ids = coder.encoded(texts)
            decoded = [" ".join(tokens[np.frombuffer(x, "<u4")].tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=[*names, "ids", "decoded"])
        _coders.clear()  # a task's words are mostly its own; a worker that waits holds nothing
        del coder, tokens
        give_back()

    schema = own.drop(text).limit(0).withColumns({"ids": F.lit(None).cast("binary"), "decoded": F.lit(None).cast("string")}).schema
    return own.mapInArrow(kernel, schema)


def op6(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The digest of the contract: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded = encode(docs.select("doc_id", "text"), tokenizer)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
