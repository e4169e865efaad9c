"""Removal of repeated byte strings by suffix arrays over shards.

A byte is removed if a string of ``LENGTH`` bytes covers it that also starts earlier: in a row of a
smaller id, or at an earlier place of the same id.

1. Anchors bring equal strings together. Of the ``K``-byte strings in each window of ``LENGTH`` bytes
   the one with the least hash is its anchor, so equal windows have equal anchors at equal places. The
   windows of one anchor make a segment. Only anchors whose hash occurs twice go on; they are found in
   ``PASSES`` parts of the hashes, one after the other, so that only one part's shuffle lies on disk.
2. Equal segments are brought down to their first place, by two hashes of 64 bits each; all others of
   them are covered. So copies never meet in one task, and their bytes don't move.
3. Segments that share an anchor but differ meet in a shard, and shards are bounded: whole anchor groups
   up to ``SHARD`` bytes. The shard's suffix array is made by induced sorting, and permuted common
   prefixes of ``LENGTH`` or more group its equal windows. All but the first of a group are covered.
4. An anchor with more than ``CROWD`` different segments (a very common passage between different
   texts) would make a shard of any size. Its windows are told apart one by one, by two hashes of 64 bits
   each, in an aggregation that combines map-side and a join that Spark can split.
5. The covered spans go back to their rows and are cut out.

Defined cases: a null text counts as empty. A null id is smaller than all others; ids are integers. Rows
that repeat an id and a text are one document to this operator and get the same result each; rows that
repeat an id with other texts are judged by their starts alone. Columns beyond id and text don't matter,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .suffix_array import permuted_lcp, suffix_array

LENGTH, K = 100, 32
SHARD, CROWD = 1_000_000, 2048
PASSES = 2
_BATCH = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPANS = "o long, th long, s long, e long"


def _hashes(raw: bytes) -> np.ndarray:
    """A hash of the K bytes from each place, never 0."""
    n = len(raw) - K + 1
    h = np.full(n, K, np.uint64)
    for at in range(0, K, 8):
        h ^= np.ndarray(n, "<u8", raw, at, (1,))
        h *= _ODD
        h ^= h >> np.uint64(32)
    return h | np.uint64(1)


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over each w values in a row."""
    n = len(x) - w + 1
    pad = np.full(-len(x) % w, x[-1], x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    up = f.accumulate(blocks, 1).ravel()
    down = f.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return f(down[:n], up[w - 1 : w - 1 + n])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, from, to, hash, segment's hash) of each anchor."""
    raw = b"".join(texts)
    w = LENGTH - K + 1
    if len(raw) < LENGTH:
        return (np.empty(0, np.int64),) * 5
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    h = _hashes(raw)
    least = _sliding(h, w, np.minimum)
    text = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(least)) + LENGTH <= ends[text[: len(least)]]
    least[~inside] = 0
    edge = np.zeros(w - 1, np.uint64)
    padded = np.concatenate([edge, least, edge])
    at = np.flatnonzero(_sliding(padded, w, np.maximum) == h)
    # windows from at - w + 1 to at whose least hash is this: a run of them
    mine = np.lib.stride_tricks.sliding_window_view(padded, w)[at] == h[at][:, None]
    a = at - w + 1 + mine.argmax(1)
    e = at - mine[:, ::-1].argmax(1) + LENGTH
    sh = ((at - a) * 1024 + (e - a)).astype(np.uint64)
    for k in range(0, 2 * LENGTH - K, K):
        sh = (sh ^ h[np.minimum(a + k, e - K)]) * _ODD
        sh ^= sh >> np.uint64(29)
    start = (ends - sizes)[text[at]]
    return text[at], a - start, e - start, h[at].view(np.int64), sh.view(np.int64)


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of about _BATCH bytes with their texts."""
    for b in batches:
        at, size, part = 0, 0, []
        for k, t in enumerate(b.column(column)):
            part.append(t.as_py())
            size += len(part[-1])
            if size >= _BATCH:
                yield b.slice(at, len(part)), part
                at, size, part = k + 1, 0, []
        if part:
            yield b.slice(at, len(part)), part


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, texts in _batches(batches, 2):
        text, a, e, h, sh = anchors(texts)
        ends = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (a.astype(np.int32), e.astype(np.int32), h, sh)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["o", "th", "s", "e", "h", "sh"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(o, th, raw, found: h, sh, s, e, kinds) -> the bytes of each segment found."""
    for b, texts in _batches(batches, 2):
        lists = b.column(3)
        flat, ends = lists.flatten(), np.cumsum([0, *lists.value_lengths().to_pylist()])
        h, sh, s, e, kinds = (flat.field(k) for k in range(5))
        row = np.repeat(np.arange(len(texts)), np.diff(ends))
        parts = [texts[r][x:y] for r, x, y in zip(row.tolist(), s.to_pylist(), e.to_pylist(), strict=True)]
        row = pa.array(row)
        yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), h, sh, s.cast(pa.int64()), kinds, pa.array(parts, pa.binary())], ["o", "th", "h", "sh", "s", "kinds", "segment"])


def covered(segments: list[bytes], o: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, from, to) of the bytes of segments at place ``s`` of ``o`` that an earlier one covers."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    t = np.frombuffer(b"\0".join(segments) + b"\0\0", np.uint8).astype(np.int32) + 2
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    t[starts + sizes] = 1
    t[-1] = 0
    owner = np.append(np.repeat(np.arange(len(segments)), sizes + 1), len(segments) - 1)
    offset = np.arange(len(t)) - starts[owner]
    whole = offset + LENGTH <= sizes[owner]
    whole[-1] = False
    sa = suffix_array(t, 258)
    lcp = permuted_lcp(t, sa)
    first = np.ones(len(sa), bool)  # of a group of equal windows; windows that aren't whole never join one
    first[1:] = ~(whole[sa[1:]] & whole[sa[:-1]] & (lcp[sa[1:]] >= LENGTH))
    group = np.cumsum(first)
    rows = np.flatnonzero(~first | np.append(~first[1:], False))  # groups of two or more; none of their windows is cut off
    p, g = sa[rows], group[rows]
    order = np.lexsort((s[owner[p]] + offset[p], o[owner[p]], g))
    p, g = p[order], g[order]
    po, ps = o[owner[p]], s[owner[p]] + offset[p]
    head = np.maximum.accumulate(np.where(np.concatenate([[True], g[1:] != g[:-1]]), np.arange(len(p)), 0)) if len(p) else np.empty(0, np.int64)
    later = np.sort(p[(po > po[head]) | (ps > ps[head])])
    if not len(later):
        return later, later, later
    cut = np.concatenate([[True], (np.diff(later) > 1) | (np.diff(owner[later]) != 0)])
    a, b = later[cut], later[np.append(np.flatnonzero(cut)[1:] - 1, len(later) - 1)]
    return owner[a], offset[a], offset[b] + LENGTH


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, sh, o, th, s, segment) in order of h and sh -> covered spans."""
    held: list[tuple] = []
    size, last = 0, None

    def done() -> pa.RecordBatch:
        o, s, th = (np.array([r[k] for r in held], np.int64) for k in (2, 4, 3))
        k, a, b = covered([r[5] for r in held], o, s)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (o[k], th[k], s[k] + a, s[k] + b)], ["o", "th", "s", "e"])

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if last is not None and row[:2] == last:
                continue
            if size >= SHARD and row[0] != last[0]:
                yield done()
                held, size = [], 0
            held.append(row)
            size += len(row[5])
            last = row[:2]
    if held:
        yield done()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    for b, texts in _batches(batches, 1):
        lists = b.column(2)
        flat, ends = lists.flatten(), np.cumsum([0, *lists.fill_null([]).value_lengths().to_pylist()])
        froms, tos = (flat.field(k).to_numpy() for k in range(2))
        spans, kept = [], []
        for k, raw in enumerate(texts):
            s, e = froms[ends[k] : ends[k + 1]], tos[ends[k] : ends[k + 1]]
            order = np.argsort(s, kind="stable")
            s, far = s[order], np.maximum.accumulate(e[order]) if len(s) else e
            first = np.flatnonzero(np.concatenate([[True], s[1:] > far[:-1]])) if len(s) else np.empty(0, int)
            s, e = s[first].tolist(), far[np.append(first[1:] - 1, len(far) - 1)].tolist() if len(first) else []
            spans.append([{"s": x, "e": y} for x, y in zip(s, e, strict=True)])
            kept.append(b"".join(raw[x:y] for x, y in zip([0, *e], [*s, len(raw)], strict=True)) if s else raw)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])


def _shared(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Places (o, th, h, sh, s, e) of the segments whose anchor occurs more than once."""
    found = texts.where(F.octet_length("raw") >= LENGTH).select("o", "th", "raw")
    found = scratch.save(found.mapInArrow(_anchor_rows, "o long, th long, s array<int>, e array<int>, h array<long>, sh array<long>"), "anchors")
    twice = found.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    twice = scratch.save(twice, "twice")
    scratch.release()
    flat = found.select("o", "th", F.inline(F.arrays_zip("h", "sh", "s", "e")))
    # not the hash that Spark deals rows out by: half of its partitions would stay empty
    part, places = F.pmod(F.xxhash64("h"), F.lit(PASSES)), []
    for k in range(PASSES):
        places.append(scratch.save(flat.where(part == k).join(twice.where(part == k), "h"), "places"))
        scratch.release()
    scratch.drop("anchors", keep=0)
    scratch.drop("twice", keep=0)
    return reduce(DataFrame.unionByName, places)


def _later() -> F.Column:
    return (F.col("o") > F.col("fo")) | ((F.col("o") == F.col("fo")) & (F.col("s") > F.col("fs")))


def _differing(texts: DataFrame, firsts: DataFrame, scratch: Scratch) -> DataFrame:
    """One row with its bytes for each of the different segments of an anchor that has several."""
    kinds = firsts.groupBy("h").agg(F.count("*").cast("int").alias("kinds")).where("kinds > 1")
    differ = firsts.join(kinds, "h").groupBy("first.o", "first.th").agg(F.collect_list(F.struct("h", "sh", "first.s", "first.e", "kinds")).alias("found"))
    # the shuffles up to here leave the disk before the texts are shuffled
    differ = scratch.save(differ, "found")
    scratch.release()
    rows = texts.select("o", "th", "raw").join(differ, ["o", "th"]).select("o", "th", "raw", "found")
    # rows that repeat id and text give the same segments again; they fall together in the shards
    return scratch.save(rows.mapInArrow(_segments, "o long, th long, h long, sh long, s long, kinds int, segment binary"), "differ")


def _crowded(differ: DataFrame, scratch: Scratch) -> DataFrame:
    crowd = differ.where(F.col("kinds") > CROWD)
    windows = crowd.select("o", "th", "s", "segment", F.explode(F.sequence(F.lit(0), F.octet_length("segment") - LENGTH)).alias("k"))
    windows = windows.select("o", "th", (F.col("s") + F.col("k")).alias("s"), F.expr(f"substring(segment, k + 1, {LENGTH})").alias("w"))
    windows = windows.select("o", "th", "s", F.xxhash64("w").alias("a"), F.xxhash64("w", F.lit(1)).alias("b")).distinct()
    windows = scratch.save(windows, "windows")
    least = windows.groupBy("a", "b").agg(F.min(F.struct("o", "s")).alias("first"), F.count("*").alias("n")).where("n > 1")
    least = least.select("a", "b", F.col("first.o").alias("fo"), F.col("first.s").alias("fs"))
    return windows.join(least, ["a", "b"]).where(_later()).select("o", "th", "s", (F.col("s") + LENGTH).alias("e"))


def _spans(texts: DataFrame, places: DataFrame, scratch: Scratch) -> DataFrame:
    """(o, th, spans) of the rows with covered bytes."""
    firsts = scratch.save(places.groupBy("h", "sh").agg(F.min(F.struct("o", "s", "th", "e")).alias("first"), F.count("*").alias("n")), "firsts")
    scratch.release()
    differ = _differing(texts, firsts, scratch)
    scratch.release()
    some = differ.where(F.col("kinds") <= CROWD).select("h", "sh", "o", "th", "s", "segment")
    arrays = scratch.save(some.repartition("h").sortWithinPartitions("h", "sh").mapInArrow(_shards, _SPANS), "arrays")
    crowded = _crowded(differ, scratch)
    # the segments' bytes aren't needed any more
    scratch.drop("differ", keep=0)
    scratch.drop("found", keep=0)
    scratch.release()
    many = firsts.where("n > 1").select("h", "sh", F.col("first.o").alias("fo"), F.col("first.s").alias("fs"))
    copies = places.join(many, ["h", "sh"]).where(_later()).select("o", "th", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))
    spans = copies.unionByName(arrays).unionByName(crowded)
    return scratch.save(spans.groupBy("o", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, spans array<struct<s, e>> (maximal removed runs), kept binary (the bytes left)."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), raw.alias("raw"))
    texts = texts.select("id", "raw", F.coalesce("id", F.lit(-(2**63))).alias("o"), F.xxhash64("raw").alias("th"))

    places = _shared(texts, scratch)
    spans = _spans(texts, places, scratch)
    for name in ("places", "firsts", "differ", "arrays", "windows"):
        scratch.drop(name, keep=0)
    scratch.release()
    return texts.join(spans, ["o", "th"], "left").select("id", "raw", "spans").mapInArrow(_cut, "id long, n_bytes long, spans array<struct<s: long, e: long>>, kept binary")
