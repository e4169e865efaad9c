"""Byte-level BPE encoding and decoding over length-bucketed, padded numpy matrices.

A text is cut by the vocabulary's pattern into pieces. A piece that is a token is that token. All
other distinct pieces of a batch go into matrices by length, one row each; in every round each row
merges its leftmost pair of minimum rank, finished rows are taken out, and pair ranks come from an
open-addressing hash table keyed by the two ids. Pieces of more than ``LONG`` bytes make the same
merges in the same order from a heap, since a row's rounds cost the square of its length.

Texts are first cut at single spaces between two non-space characters. The pattern never matches
across such a place, so these units can be encoded one by one and kept in a bounded cache.

Defined cases: a null text counts as empty and has no ids. Repeated rows give repeated rows. Null ids
are passed through. Only the id and the text are read, so other columns and their names don't matter.
An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .scratch import bounded
from .units import cut

NONE = np.int32(2**31 - 1)
LONG = 2048
#: Units and pieces that a worker keeps, and characters that it encodes at once.
_KEPT, _CHUNK = 500_000, 2_000_000
_CELLS = 4_000_000


class PairTable:
    """(left id, right id) -> rank, by linear probing in a table at most a quarter full."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.bits = max(8, int(len(keys) * 4 - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            self.keys[at[free]] = keys[free]  # of several for one slot, the last stays
            mine = free[self.keys[at[free]] == keys[free]]
            self.ranks[at[mine]] = ranks[mine]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where there is no such token or either id is padding (negative)."""
        keys = (left.astype(np.int64) << 31) | right
        shape, keys = keys.shape, keys.ravel()
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        k, at = keys[todo], self._slot(keys[todo])
        while len(todo):
            got = self.keys[at]
            hit = got == k
            out[todo[hit]] = self.ranks[at[hit]]
            go = ~hit & (got >= 0)
            todo, k, at = todo[go], k[go], (at[go] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)


class ByteBPE:
    """Encoder and decoder of a rank file (base64 token, rank) with the pattern that goes with it."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.find = regex.compile(pattern).findall
        self.byte = np.array([self.ranks[bytes([k])] for k in range(256)], np.int32)
        keys, values = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 31 | b)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int32))
        self.units: dict[str, bytes] = {}
        self.starts: dict[str, bytes] = {}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = tokens

    # pieces

    def pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pieces, as little-endian int32."""
        out, rest = {}, {}
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(raw)
            if rank is not None:
                out[p] = rank.to_bytes(4, "little")
            else:
                rest.setdefault(raw, p)
        by_width: dict[int, list[bytes]] = {}
        for raw in rest:
            if len(raw) > LONG:
                out[rest[raw]] = self._long(raw)
            else:
                by_width.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), []).append(raw)
        for width, raws in by_width.items():
            step = max(1, _CELLS // width)
            for at in range(0, len(raws), step):
                part = raws[at : at + step]
                for raw, ids in zip(part, self._matrix(part, width), strict=True):
                    out[rest[raw]] = ids
        return out

    def _matrix(self, raws: list[bytes], width: int) -> list[bytes]:
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        padded = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raws), np.uint8).reshape(-1, width)
        columns = np.arange(width)
        ids = np.where(columns < lengths[:, None], self.byte[padded], np.int32(-1)).astype(np.int32)
        ranks = self.pairs(ids[:, :-1], ids[:, 1:])
        row, out = np.arange(len(raws)), [b""] * len(raws)
        while len(row):
            at = ranks.argmin(1)  # the leftmost of the least
            n = np.arange(len(row))
            best = ranks[n, at]
            done = best == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[row[k]] = ids[k, : lengths[k]].tobytes()
                go = ~done
                row, ids, ranks, lengths, at, best = row[go], ids[go], ranks[go], lengths[go], at[go], best[go]
                if not len(row):
                    break
                n = np.arange(len(row))
                least = int(lengths.max())
                if least <= ids.shape[1] // 2:
                    ids, ranks = ids[:, : max(2, least)].copy(), ranks[:, : max(2, least) - 1].copy()
            ids[n, at] = best
            w = ids.shape[1]
            ids[:, :-1] = np.where(np.arange(w - 1) > at[:, None], ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            if w > 2:
                ranks[:, :-1] = np.where(np.arange(w - 2) > at[:, None], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            lengths = lengths - 1
            inner = at > 0
            ranks[n[inner], at[inner] - 1] = self.pairs(ids[n[inner], at[inner] - 1], best[inner])
            last = np.minimum(at, w - 2)
            right = np.where(at < w - 1, ids[n, np.minimum(at + 1, w - 1)], -1)
            ranks[n, last] = self.pairs(ids[n, last], right)
        return out

    def _long(self, raw: bytes) -> bytes:
        ids = self.byte[np.frombuffer(raw, np.uint8)]
        first = self.pairs(ids[:-1], ids[1:])
        ids, n = ids.tolist(), len(raw)
        prev, after, heap = list(range(-1, n - 1)), list(range(1, n + 1)), [(r, k) for k, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)
        tokens, ranks, gone = self.tokens, self.ranks, [False] * n

        def rank(k: int) -> int | None:
            j = after[k]
            return ranks.get(tokens[ids[k]] + tokens[ids[j]]) if j < n else None

        while heap:
            r, k = heapq.heappop(heap)
            if gone[k] or rank(k) != r:
                continue
            j = after[k]
            ids[k], gone[j], after[k] = r, True, after[j]
            if after[j] < n:
                prev[after[j]] = k
            for x in (prev[k], k):
                if x >= 0 and (new := rank(x)) is not None:
                    heapq.heappush(heap, (new, x))
        return np.array([x for x, g in zip(ids, gone, strict=True) if not g], "<i4").tobytes()

    # texts

    def _learn(self, units: set[str], known: dict[str, bytes], lead: str) -> None:
        split = {u: self.find(lead + u) for u in units}
        ids = self.pieces(list({p for ps in split.values() for p in ps}))
        for u, ps in split.items():
            known[u] = b"".join([ids[p] for p in ps])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (int32) of each text."""
        if len(self.units) > _KEPT:
            self.units.clear()
        if len(self.starts) > _KEPT // 10:
            self.starts.clear()
        parts = [cut(t) for t in texts]
        units: set[str] = set()
        for p in parts:
            units.update(p[1:])
        self._learn(units.difference(self.units), self.units, " ")
        self._learn({p[0] for p in parts if p}.difference(self.starts), self.starts, "")
        unit, start = self.units.__getitem__, self.starts
        return [np.frombuffer(start[p[0]] + b"".join(map(unit, p[1:])), "<i4") if p else np.empty(0, "<i4") for p in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=1)
def _bpe(path: str, pattern: str) -> ByteBPE:
    """A worker's encoder, kept from task to task with the units it knows."""
    return ByteBPE(path, pattern)


def chunks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Slices of a column of texts, each of about _CHUNK characters."""
    at, size, part = 0, 0, []
    for k, t in enumerate(texts):
        part.append(t.as_py() or "")
        size += len(part[-1])
        if size >= _CHUNK or len(part) >= 2000:
            yield at, part
            at, size, part = k + 1, 0, []
    if part:
        yield at, part


def _run(path: str, pattern: str, decode: bool, keep_text: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, pattern)
        for b in batches:
            for at, texts in chunks(b.column(1)):
                ids = bpe.encode(texts)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                out = [b.column(0).slice(at, len(texts)), lists]
                names = ["id", "ids"]
                if decode:
                    out.append(pa.array([bpe.decode(x) for x in ids], pa.binary()))
                    names.append("decoded")
                if keep_text:
                    out.append(b.column(1).slice(at, len(texts)))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row."""
    bounded(docs.sparkSession)
    d = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return d.mapInArrow(_run(path, pattern, False), f"id {d.schema['id'].dataType.simpleString()}, ids array<int>")


def encode_decode(docs: DataFrame, path: str, pattern: str, *, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary) of every row, and the text if asked for; decoded is made from
    the ids alone."""
    d = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(_run(path, pattern, True, keep_text), f"id {kind}, ids array<int>, decoded binary" + ", text string" * keep_text)
