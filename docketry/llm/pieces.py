"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes symbols of one character; an agenda of adjacent symbol pairs,
ordered by score and then from left to right, names the pair to merge next;
merging renews the pairs on both sides.  Symbols left without a piece fall back
to bytes.

No piece of such a vocabulary holds the word mark after another character
(checked when a model is loaded), and many characters stand in no piece beside one
another, such as letters and line ends.  No merge crosses such a place, so each part
between them (its marks and what follows) is encoded by itself; without byte fallback
the parts are whole words.  In a run of texts (about ``RUN_CHARS`` characters, or one
text) the parts not yet known are encoded together, the agenda of each part being a row
of pair scores; parts over ``LONG`` symbols take a heap of their own.  Each new part's
ids are checked against the sentencepiece library before use, or with ``check="texts"``
each whole text's; a difference fails the task.  When more than ``KNOWN`` parts are
known, the next run starts anew, and none is remembered beyond the task, so a reused
worker keeps the model alone.  Decoding is the library's decode(ids).

Null texts are empty; an empty text has the end id alone.  Very long texts are
encoded whole, in a run of their own.  Repeated rows get equal results; an empty table
gives an empty result; input columns named like a result are replaced, others are kept.
The vocabulary file is a parameter: a path readable on every executor.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.common import free, table

MARK = "▁"
LONG = 48
KNOWN = 250_000
RUN_CHARS = 500_000
_GONE = -1
_NEVER = np.int32(1 << 30)
_WALL = "\n"
_WORD = f"[ {MARK}]+[^ {MARK}]*"


def _places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each run of ``size``."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def _parts(pieces: Iterable[str]) -> str:
    """Pattern of parts: marks, then characters that pieces chain to one another, or one character of no chain."""
    heads: dict[str, str] = {}

    def head(c: str) -> str:
        while heads.setdefault(c, c) != c:
            c = heads[c]
        return c

    for p in pieces:
        for a, b in zip(p.lstrip(MARK), p.lstrip(MARK)[1:], strict=False):
            heads[head(a)] = head(b)
    chains: dict[str, list[str]] = {}
    for c in heads:
        chains.setdefault(head(c), []).append(re.escape(c))
    runs = "".join(f"[{''.join(cs)}]+|" for cs in sorted(chains.values(), key=len, reverse=True))
    return f"[ {MARK}]*(?:{runs}[^ {MARK}])|[ {MARK}]+"


class _Known(dict[str, int]):
    """Number of each part; a new one takes the next number and is noted."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self.new.append(part)
        self[part] = at = len(self)
        return at


class Encoder:
    """Ids of texts under one model; one instance a worker process."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        # only ordinary pieces match text
        ids = {lib.id_to_piece(i): i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))}
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("a piece holds the word mark inside; words of this model can't be encoded apart")
        self.eos, self.unk = lib.eos_id(), lib.unk_id()
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(lib.is_byte(i) for i in self.bytes)
        # without bytes, an unknown id stands for a run of characters in a word, which then stays whole
        self.find = re.compile(_parts(ids) if self.fallback else _WORD, re.DOTALL).findall
        self.char = {p: i for p, i in ids.items() if len(p) == 1}
        # 0 for the best score; equal scores share a rank
        self.rank = np.unique([-lib.get_score(i) for i in range(n)], return_inverse=True)[1].astype(np.int32)
        self.of_char = -2 - np.arange(0x110000, dtype=np.int32)  # a character without a piece is a number that no pair holds
        self.of_char[[ord(c) for c in self.char]] = list(self.char.values())
        pairs = sorted((ids[p[:k]] << 32 | ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
        self.pair_key = np.array([k for k, _ in pairs], np.int64)
        self.pair_to = np.array([i for _, i in pairs], np.int64)
        self.pair = dict(pairs)
        self.text = [str(i) for i in range(n)]
        self.forget()

    def forget(self) -> None:
        """No part is known any more."""
        self.known = _Known()
        self.ids = np.empty(0, np.int32)
        self.start = self.size = np.empty(0, np.int64)

    def _merged(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what each pair merges to; rank ``_NEVER`` if nothing."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = (self.pair_key[at] == key) & (left >= 0) & (right >= 0)
        to = np.where(hit, self.pair_to[at], 0)
        return np.where(hit, self.rank[to], _NEVER), to

    def _agendas(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges all rows side by side, each by its own agenda; the ids of all rows, and how many each has."""
        rows, width = sym.shape
        sym = np.pad(sym, ((0, 0), (0, 1)), constant_values=_GONE)
        nxt = np.tile(np.arange(1, width + 2, dtype=np.int32), (rows, 1))
        prv = np.tile(np.arange(-1, width, dtype=np.int32), (rows, 1))
        rank, to = self._merged(sym[:, :-1], sym[:, 1:])
        live = np.arange(rows)
        while len(live):
            agenda = rank if len(live) == rows else rank[live]
            best = agenda.argmin(axis=1)  # the first of equals is the leftmost
            going = agenda[np.arange(len(live)), best] < _NEVER
            live, at = live[going], best[going]
            right = nxt[live, at]
            sym[live, at] = to[live, at]
            sym[live, right] = _GONE
            after = nxt[live, right]
            nxt[live, at] = after
            prv[live, np.minimum(after, width)] = at
            rank[live, np.minimum(right, width - 1)] = _NEVER
            rank[live, at], to[live, at] = self._merged(sym[live, at], sym[live, np.minimum(after, width)])
            before = prv[live, at]
            has = before >= 0
            b, r = before[has], live[has]
            rank[r, b], to[r, b] = self._merged(sym[r, b], sym[r, at[has]])
        left = (sym[:, :width] != _GONE) & (np.arange(width) < size[:, None])
        return sym[:, :width][left], left.sum(axis=1)

    def _heap(self, row: list[int]) -> list[int]:
        """One row by a heap of (rank, place); n log n for long rows."""
        n, sym, pair, rank = len(row), list(row), self.pair, self.rank
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def add(a: int, b: int) -> None:
            if sym[a] >= 0 and sym[b] >= 0 and (to := pair.get(sym[a] << 32 | sym[b])) is not None:
                heapq.heappush(agenda, (int(rank[to]), a, sym[a], sym[b], to))

        for i in range(n - 1):
            add(i, i + 1)
        while agenda:
            _, a, x, y, to = heapq.heappop(agenda)
            b = nxt[a]
            if b >= n or sym[a] != x or sym[b] != y:
                continue
            sym[a], sym[b] = to, _GONE
            nxt[a] = nxt[b]
            if nxt[a] < n:
                prv[nxt[a]] = a
                add(a, nxt[a])
            if prv[a] >= 0:
                add(prv[a], a)
        out, i = [], 0
        while i < n:
            out.append(sym[i])
            i = nxt[i]
        return out

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words or their parts, by agenda alone: all ids, and how many each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = self.of_char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        start = np.cumsum(size) - size
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, hi in ((0, 6), (6, 9), (9, 12), (12, 16), (16, 24), (24, LONG)):
            mine = np.flatnonzero((size > lo) & (size <= hi))
            for k in range(0, len(mine), 4_000):
                part = mine[k : k + 4_000]
                place = start[part, None] + np.arange(hi)
                inside = np.arange(hi) < size[part, None]
                found.append((part, *self._agendas(np.where(inside, flat[np.minimum(place, len(flat) - 1)], _GONE), size[part])))
        for i in np.flatnonzero(size > LONG).tolist():
            ids = np.array(self._heap(flat[start[i] : start[i] + size[i]].tolist()), np.int32)
            found.append((np.array([i]), ids, np.array([len(ids)])))
        n = np.zeros(len(words), np.int64)
        for part, _, each in found:
            n[part] = each
        out = np.empty(n.sum(), np.int32)
        begin = np.cumsum(n) - n
        for part, ids, each in found:
            out[_places(begin[part], each)] = ids
        return self._resolved(out, n)

    def _resolved(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes, or the unknown id once a run, for characters without a piece."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, n
        word = np.repeat(np.arange(len(n)), n)
        if self.fallback:
            raw = [chr(-2 - x).encode("utf-8", "surrogatepass") for x in ids[odd].tolist()]
            each = np.ones(len(ids), np.int64)
            each[odd] = list(map(len, raw))
            out = np.repeat(ids, each)
            out[out < 0] = np.array(self.bytes, np.int32)[np.frombuffer(b"".join(raw), np.uint8)]
            return out, np.bincount(word, each, len(n)).astype(np.int64)
        ids = np.where(ids < 0, np.int32(self.unk), ids)
        keep = np.ones(len(ids), bool)
        keep[1:] = (ids[1:] != self.unk) | (ids[:-1] != self.unk) | (word[1:] != word[:-1])
        return ids[keep], np.bincount(word[keep], minlength=len(n))

    def _same(self, texts: list[str], ids: np.ndarray, n: np.ndarray, **options) -> bool:
        """Whether these are the library's ids of the texts, ``n`` each."""
        theirs = self.lib.encode(texts, num_threads=1, return_type="numpy", **options)
        return np.array_equal(np.fromiter(map(len, theirs), np.int64, len(theirs)), n) and np.array_equal(np.concatenate([ids[:0], *theirs]), ids)

    def _same_parts(self, parts: list[str], ids: np.ndarray, n: np.ndarray) -> bool:
        """Whether these are the library's ids of the parts, in texts of many, each behind a character that merges with none."""
        many = 64 if self.fallback else 1
        first = np.arange(0, len(parts), many)
        begin = np.cumsum(n) - n
        mark, wall = self.words([MARK + _WALL])[0].tolist()  # the library puts a mark in front of a text
        want = np.insert(ids, np.concatenate([begin[first], begin]), np.repeat(np.array([mark, wall], np.int32), [len(first), len(parts)]))
        return self._same(["".join(_WALL + p for p in parts[k : k + many]) for k in first], want, np.add.reduceat(n + 1, first) + 1)

    def _learn(self, check: bool) -> None:
        for k in range(0, len(self.known.new), 20_000):
            part = self.known.new[k : k + 20_000]
            ids, n = self.words([w.replace(" ", MARK) for w in part])
            if check and not self._same_parts(part, ids, n):
                raise ValueError("ids of parts differ from the library's")
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
            self.size = np.concatenate([self.size, n])
            self.ids = np.concatenate([self.ids, ids])
        self.known.new = []

    def encode_flat(self, texts: list[str], check: str = "words") -> tuple[np.ndarray, np.ndarray]:
        """All ids of whole texts, each text's end id last, and where each text ends."""
        if len(self.known) > KNOWN:
            self.forget()
        split = [self.find(f" {t}") if t else [] for t in texts]
        each = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, each.sum())
        self._learn(check == "words")
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(each)]
        body = self.ids[_places(self.start[at], size)]
        out = np.insert(body, ends, np.int32(self.eos))
        ends = ends + np.arange(1, len(texts) + 1)
        if check == "texts" and not self._same(texts, out, np.diff(ends, prepend=0), add_eos=True):
            raise ValueError("ids differ from the library's")
        return out, ends

    def encode(self, texts: list[str], check: str = "words") -> list[list[int]]:
        """Ids of whole texts, the end id last."""
        flat, ends = self.encode_flat(texts, check)
        return [x.tolist() for x in np.split(flat, ends[:-1])] if texts else []

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.lib.decode(ids, num_threads=1)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _runs(size: np.ndarray, chars: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``chars`` characters in all, or of one row."""
    ends = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + chars, "right")) - 1)
        yield lo, hi
        lo = hi


_SCHEMA = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded": T.StringType(), "decoded_sha256": T.StringType()}


def _results(enc: Encoder, texts: list[str], results: tuple[str, ...], check: str) -> list[pa.Array]:
    """The columns ``results`` of a run of texts."""
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    flat, ends = enc.encode_flat(texts, check)
    begins = np.concatenate([[0], ends])
    lists = [flat[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)] if set(results) - {"ids", "n_tokens"} else []
    decoded = enc.decode(lists) if {"decoded", "decoded_sha256"} & set(results) else []
    made = {
        "ids": lambda: pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(flat.astype(np.int32))),
        "n_tokens": lambda: pa.array(np.diff(begins).astype(np.int64)),
        "ids_sha256": lambda: pa.array([sha(" ".join(map(enc.text.__getitem__, x))) for x in lists], pa.string()),
        "decoded": lambda: pa.array(decoded, pa.string()),
        "decoded_sha256": lambda: pa.array([*map(sha, decoded)], pa.string()),
    }
    return [made[c]() for c in results]


def encode_texts(docs: DataFrame, model_path: str, results: tuple[str, ...] = ("ids", "decoded"), check: str = "words", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with any of ``ids, n_tokens, ids_sha256, decoded, decoded_sha256``.

    Input columns of these names are replaced.  A task holds an Arrow batch of rows, and
    the parts, ids and decoded texts of one run.
    """
    kept = [c for c in docs.columns if c not in results and (keep is None or c in keep)]
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(c, _SCHEMA[c]) for c in results)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        try:
            for batch in batches:
                text = batch.column(0)
                size = np.diff(np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4)) if len(text) else np.zeros(0, np.int32)
                for lo, hi in _runs(size, RUN_CHARS):
                    texts = [t or "" for t in text.slice(lo, hi - lo).to_pylist()]
                    own = [batch.column(k + 1).slice(lo, hi - lo) for k in range(len(kept))]
                    yield pa.RecordBatch.from_arrays([*own, *_results(enc, texts, results, check)], [*kept, *results])
        finally:
            enc.forget()

    source = docs.select(F.col("text").alias(free(kept, "whole")[0]), *[F.col(f"`{c}`") for c in kept])
    return source.mapInArrow(run, schema)


def op4_sentencepiece(spark, sf_dir: str, model_path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    return encode_texts(docs, path, ("n_tokens", "ids_sha256", "decoded_sha256"), keep=("doc_id",))
