"""Token ids in sorted-string-table shards.

A table of files ``shard-NNNNN.sst``, ascending by document id within and across files. A file holds

* blocks: documents in key order. Each entry is ``shared, own, ids`` (varints), the key's own bytes
  after those it shares with the key before, and the ids, in 2 bytes each (4 if the vocabulary needs
  it). The first key of a block is whole. A CRC-32 ends each block.
* a sparse index: for each block its offset, length, first key and the ids before it in the file.
* a Bloom filter of the keys, and a footer of fixed length with the place of the index and the
  filter, the counts and a magic number.

A lookup asks the filter, then bisects the index and reads one block (more only for repeated keys).

Documents are dealt out by ranges of the id and sorted within each; a shard is written under a name of
its task attempt and then renamed, so a task that runs twice leaves one whole file.

Defined cases: a null text counts as empty and has only the end id. Null ids come first. Rows that
repeat an id stay, in order of their text's hash; each has its own start. Other columns and their names
don't matter. An empty table makes a table of no documents.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .units import absent, mark

MAGIC = b"LOOMSST1"
BLOCK = 64 * 1024
BITS_PER_KEY, PROBES = 10, 7
FOOTER = struct.Struct("<QQQQQQB7x8s")
INDEX = struct.Struct("<QQQI")
#: Units that a worker keeps.
_KEPT = 1_000_000
_MARKS = ".,;:!?"
#: Letters and digits of which the usual pattern always parts marks that follow them and end the unit.
_BEFORE_MARKS = frozenset(c for c in map(chr, range(0x180)) if c.isascii() and c.isalnum() or c >= "À" and c not in "×÷")


# keys and varints


def key_of(doc_id: int | str | None) -> bytes:
    """Bytes in the order of the ids, null first."""
    if doc_id is None:
        return b"\0"
    if isinstance(doc_id, str):
        return b"\1" + doc_id.encode()
    return b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes, text: bool) -> int | str | None:
    if key == b"\0":
        return None
    return key[1:].decode() if text else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + k * b) % bits for k in range(PROBES)]


# one file


class Writer:
    """Appends documents in ascending key order."""

    def __init__(self, out, width: int):
        self.out, self.width, self.kind = out, width, np.dtype(f"<u{width}")
        self.at = self.docs = self.ids = 0
        self.index: list[tuple[int, int, int, bytes]] = []
        self.keys: list[bytes] = []
        self._fresh()

    def _fresh(self):
        self.block, self.size, self.first, self.last, self.before = [], 0, None, b"", self.ids

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.first is None:
            self.first = key
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids.astype(self.kind).tobytes()
        self.block.append(entry)
        self.size += len(entry)
        self.last = key
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.docs += 1
        self.ids += len(ids)
        if self.size >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        raw = b"".join(self.block)
        raw += struct.pack("<I", zlib.crc32(raw))
        self.out.write(raw)
        self.index.append((self.at, len(raw), self.before, self.first))
        self.at += len(raw)
        self._fresh()

    def close(self) -> None:
        if self.block:
            self._flush()
        index = b"".join(INDEX.pack(at, n, before, len(key)) + key for at, n, before, key in self.index)
        bits = max(64, BITS_PER_KEY * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out.write(index)
        self.out.write(bytes(bloom))
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), bits, self.docs, self.ids, self.width, MAGIC))
        self.out.close()


class Reader:
    """Reads a file by blocks: ``scan`` in order, ``get`` by key."""

    def __init__(self, file):
        self.file = file
        file.seek(file.size() - FOOTER.size)
        at, n, bloom_at, self.bits, self.docs, self.ids, width, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.kind = np.dtype(f"<u{width}")
        file.seek(at)
        raw, self.index, k = file.read(n), [], 0
        while k < n:
            *place, size = INDEX.unpack_from(raw, k)
            k += INDEX.size
            self.index.append((*place, raw[k : k + size]))
            k += size
        file.seek(bloom_at)
        self.bloom = file.read((self.bits + 7) // 8)

    def _block(self, k: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        at, n, before, _ = self.index[k]
        self.file.seek(at)
        raw = self.file.read(n)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        p, key = 0, b""
        while p < n - 4:
            shared, p = _read_varint(raw, p)
            own, p = _read_varint(raw, p)
            count, p = _read_varint(raw, p)
            key = key[:shared] + raw[p : p + own]
            p += own
            ids = np.frombuffer(raw, self.kind, count, p)
            p += count * self.kind.itemsize
            yield key, before, ids
            before += count

    def scan(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, ids of the file before it, ids) of every document."""
        for k in range(len(self.index)):
            yield from self._block(k)

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every document with this key."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        firsts = [x[3] for x in self.index]
        k, out = bisect_right(firsts, key) - 1, []
        while k > 0 and self.index[k][3] == key:
            k -= 1
        while 0 <= k < len(self.index) and self.index[k][3] <= key:
            out += [ids for at, _, ids in self._block(k) if at == key]
            k += 1
        return out


# encoding with the tokenizers library


class Encoder:
    """``Tokenizer.encode_batch`` over whole texts, without special tokens of its own.

    A byte-level tokenizer that splits by its usual pattern and normalizes nothing gives the same ids
    for a text as for its units, cut before a space or line end that follows another character than white
    space. Then Arrow finds the distinct units of many texts; those not known yet are encoded once and kept in a
    bounded cache, words apart from the marks that follow them and the line ends before them; numpy lays the ids
    out again. Any other tokenizer gets the texts whole.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        strips = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or not {" ", "\n", *_MARKS}.isdisjoint(t["content"]) for t in spec.get("added_tokens", []))
        self.by_unit = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("truncation") and not strips
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.known: dict[str, bytes] = {}

        # units go to the library many at a time: those that begin with a space one after the other, each of them from a
        # token that begins with a space to the next; others parted by line ends, which are a token of their own between
        # characters that aren't white space
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids if self.by_unit else []
        self.by_unit = len(self.line) == 1
        self.spaced = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, bool)
        self.spaced[[k for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.startswith("Ġ")]] = True

    def _many(self, units: list[str]) -> list[bytes]:
        """Ids of each of the units."""
        after = [u for u in units if u[:1] == " " and u[1:].isalpha()]
        first, whole = [], []
        for u in units if len(after) < len(units) else ():
            body = u[1:] if u[:1] == " " else u
            if not body or body[0].isspace() or body[-1].isspace() or "\n" in body or " " in body:
                whole.append(u)
            elif body is u:
                first.append(u)
            elif not body.isalpha():
                after.append(u)
        out = {}
        for alike, parted in ((after, False), (first, True)):
            parts = [alike[k : k + 200] for k in range(0, len(alike), 200)]
            for part, e in zip(parts, self.tokenizer.encode_batch_fast([("\n" if parted else "").join(p) for p in parts], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                begins = ids == self.line[0] if parted else self.spaced[ids]
                at = np.flatnonzero(begins).tolist()
                starts, ends = ([0, *(k + 1 for k in at)], [*at, len(ids)]) if parted else (at, [*at[1:], len(ids)])
                if len(starts) != len(part):  # the vocabulary lacks the space or the line end
                    whole += part
                    continue
                raw = ids.tobytes()
                out.update(zip(part, [raw[4 * i : 4 * k] for i, k in zip(starts, ends, strict=True)], strict=True))
        out.update(zip(whole, self._ids(whole), strict=True))
        return [out[u] for u in units]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: list[str]) -> None:
        """Encodes new units."""
        known = self.known
        known[""] = b""
        new = [u for u in fresh if u[0] == " " and u[-1] not in _MARKS]
        joined: list[str] = []
        leads, words, tails = [], [], []
        for u in fresh if len(new) < len(fresh) else ():
            if u[0] == " " and u[-1] not in _MARKS:
                continue
            word = u.rstrip(_MARKS)
            if word[-1:] not in _BEFORE_MARKS:
                word = u
            tail = u[len(word) :]
            lead = "\n" if u[0] == "\n" and not word[1:2].isspace() else ""
            if lead:
                word = word[1:]
            joined.append(u)
            leads.append(lead)
            words.append(word)
            tails.append(tail)
        new += {*leads, *words, *tails}.difference(known, new)
        known.update(zip(new, self._many(new), strict=True))
        parts = (map(known.__getitem__, x) for x in (leads, words, tails))
        known.update(zip(joined, map(b"".join, zip(*parts, strict=True)), strict=True))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        sign = absent(texts) if self.by_unit else None
        if sign is None:
            return [np.frombuffer(x, "<u4") for x in self._ids(texts)]
        if len(self.known) > _KEPT:
            self.known.clear()
        full = [k for k, t in enumerate(texts) if t]
        out = [np.empty(0, "<u4")] * len(texts)
        if not full:
            return out
        marked = [mark(texts[k], sign) for k in full]
        units = pc.split_pattern(pa.array([sign.join(marked)], pa.large_string()), sign).values.dictionary_encode()
        distinct, at = units.dictionary.to_numpy(zero_copy_only=False).tolist(), units.indices.to_numpy()
        coded = list(map(self.known.get, distinct))
        fresh = [k for k, x in enumerate(coded) if x is None]
        self._learn([distinct[k] for k in fresh])
        for k in fresh:
            coded[k] = self.known[distinct[k]]
        flat = np.frombuffer(b"".join(coded), "<u4")
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        ends = np.cumsum(sizes[at])
        # where the ids of each unit stand in flat, less where they come to stand
        shift = (np.cumsum(sizes) - sizes)[at] - (ends - sizes[at])
        ids = flat[np.repeat(shift, sizes[at]) + np.arange(ends[-1])]
        last = np.cumsum([m.count(sign) + 1 for m in marked])
        for k, x in zip(full, np.split(ids, ends[last - 1][:-1]), strict=True):
            out[k] = x
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """A worker's encoder, kept from task to task with the units it knows."""
    return Encoder(path)


# the table


def _parts(texts: pa.Array, size: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    at, n, part = 0, 0, []
    for k, t in enumerate(texts):
        part.append(t.as_py() or "")
        n += len(part[-1])
        if n >= size:
            yield at, part
            at, n, part = k + 1, 0, []
    if part:
        yield at, part


def _open(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri)


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, writer = TaskContext.get(), None
        for b in batches:
            for at, texts in _parts(b.column(1)):
                if writer is None:
                    encode = encoder(tokenizer)
                    width = 2 if max(encode.vocabulary, end_id + 1) <= 1 << 16 else 4
                    fs, base = _open(folder)
                    fs.create_dir(base, recursive=True)
                    name = f"shard-{task.partitionId():05d}.sst"
                    made = f"{base}/.{name}.{task.taskAttemptId()}"
                    writer = Writer(fs.open_output_stream(made), width)
                for doc_id, ids in zip(b.column(0).slice(at, len(texts)).to_pylist(), encode(texts), strict=True):
                    writer.add(key_of(doc_id), np.append(ids, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            fs.move(made, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "uri": [f"{folder}/{name}"], "docs": pa.array([writer.docs], pa.int64()), "ids": pa.array([writer.ids], pa.int64())})

    return run


def write_shards(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the table and returns its manifest (shard, uri, docs, ids), one row a shard."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    order = [F.asc_nulls_first("id"), F.xxhash64("text")]
    d = d.repartitionByRange(*order).sortWithinPartitions(*order)
    return d.mapInArrow(_write(folder, tokenizer, end_id), "shard int, uri string, docs long, ids long")


def _read(text_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, path = _open(uri)
                with fs.open_input_file(path) as f:
                    rows: list[tuple] = []
                    held = 0
                    for key, before, ids in Reader(f).scan():
                        rows.append((id_of(key, text_ids), base + before, ids.astype(np.int32)))
                        held += len(ids)
                        if held > 1_000_000:
                            yield _batch(rows, b.schema.field(0).type, text_ids)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, b.schema.field(0).type, text_ids)

    return run


def _batch(rows: list[tuple], text_type, text_ids: bool) -> pa.RecordBatch:
    ends = np.cumsum([0, *(len(r[2]) for r in rows)]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[2] for r in rows])))
    crc = [zlib.crc32(r[2].astype("<i4", copy=False)) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], text_type if text_ids else pa.int64()), pa.array([r[1] for r in rows], pa.int64()), ids, pa.array(crc, pa.int64())], ["id", "start", "ids", "crc32"])


def read_shards(spark: SparkSession, manifest: DataFrame, *, text_ids: bool = False) -> DataFrame:
    """(id, start, ids, crc32) of every document, from the files. start counts the ids of all documents
    before it; the manifest has one row a shard, so its running sum is made on the driver."""
    shards = sorted(manifest.collect())
    before, rows = 0, []
    for _, uri, _, ids in shards:
        rows.append((uri, before))
        before += ids
    if not rows:
        return spark.createDataFrame([], f"id {'string' if text_ids else 'long'}, start long, ids array<int>, crc32 long")
    # a file to a task
    uris = spark.createDataFrame(rows, "uri string, before long").repartitionByRange(len(rows), "before")
    return uris.mapInArrow(_read(text_ids), f"id {'string' if text_ids else 'long'}, start long, ids array<int>, crc32 long")


def tokenize_to_shards(docs: DataFrame, tokenizer: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Writes ``docs`` to a folder of its own and returns (manifest, folder)."""
    scratch = Scratch(docs.sparkSession, "token-shards")
    folder = scratch.path("table")
    return scratch.save(write_shards(docs, folder, tokenizer, end_id=end_id, id_col=id_col, text_col=text_col), "manifest"), folder
