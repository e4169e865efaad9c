"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. Every text becomes its set of word n-grams (64-bit hashes). Equal sets form a class (64 bits of the
   set's digest), so copies cost nothing further.
2. Two sets can only reach the threshold if they share one of the ``n - ceil(t n) + 1`` first n-grams of
   each in some order that is the same everywhere. The order here: n-grams of a part of the hash space
   (the pool) come before all others, and among them the rare come before the frequent. So only the pool
   is counted, exactly, and n-grams of one class take their places in its prefix without moving: most
   prefixes are filled by them, and their classes are done.
3. Classes with an n-gram in the rest that others have there are open. Their sets are made again, and
   among open classes all n-grams are counted and ordered from rare to frequent. Prefixes in this order
   are joined under the length filter and the positional filter, and each candidate pair is verified once,
   after the suffix filter.
4. Links are wanted for the components they make. So before the full join, leader rounds link each class
   to at most one candidate per round, the one that shares most of its prefix, and one round verifies a
   forest of each n-gram's pairs. The full join then leaves out pairs that the links found so far
   connect: no group emits all of its pairs.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing.
Fewer words than n make one shingle of all of them. Rows with equal text (also repeated rows) are in one
class. Null ids take part and rank after all others: the component's id is the smallest id that isn't
null. Columns beyond id and text don't matter, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch

#: Leader rounds before the full join; they save pairs and change no result.
ROUNDS = 2
#: Bits (of 2 ** 15 each) of the filter of ids whose sets are made again: at most 8 MB at any size.
MOST_BUCKETS = 2048
#: Parts of a sketch, and rows of an n-gram's posting list that meet in one task.
PARTS, MEET = 512, 1024
#: The pool is this many times as large a part of the hash space as a prefix is of a set, so that chance
#: seldom leaves a set with fewer n-grams there than its prefix has.
SLACK = 1.35
_WORDS_KEPT = 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Ranges of the hash space for the suffix filter.
_RANGES = np.linspace(-(2**63), 2**63 - 1, 33)[1:-1].astype(np.int64)


class Shingler:
    """Sets of n-gram hashes. Words are runs of other than ASCII white space, with A-Z in lower case."""

    def __init__(self, n: int):
        self.n, self._known = n, {}

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        known = self._known
        if len(known) > _WORDS_KEPT:
            known.clear()
        new = set(words).difference(known)
        for w in new:
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted distinct hashes, int64."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.int64)
        h = self._hashes(words)
        n = min(self.n, len(h))
        mixed = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            mixed = (mixed ^ h[k : len(h) - n + 1 + k]) * _ODD
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed.view(np.int64))


def _class(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int64)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def _prefix_length(n: int, percent: int) -> int:
    return n - int(_least(n, percent)) + 1


def _pool(percent: int) -> int:
    """n-grams whose last byte is below this are the pool."""
    return min(256, int(np.ceil(256 * SLACK * (100 - percent) / 100)))


def _rows(n: int, percent: int):
    pool_ends = _pool(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Shingler(n)
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.slice(at, 500)
                found = [sets(t.as_py()) for t in part.column(1)]
                pools, sizes = [], []
                for s in found:
                    inside = (s & 255) < pool_ends
                    pool = s[inside]
                    sizes.append(len(pool))
                    more = _prefix_length(len(s), percent) - len(pool) if len(s) else 0
                    pools.append(np.concatenate([pool, s[~inside][:more]]) if more > 0 else pool)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in found], pa.int32()), pa.array(list(map(_class, found)), pa.int64()), pa.array(sizes, pa.int32()), _lists(pools)], ["id", "n", "cls", "inside", "pool"])

    return run


def _chosen_sets(n: int, filter_):
    """Sets of the rows whose id the filter may contain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, bits = Shingler(n), filter_.value
        for b in batches:
            at = b.column(0).to_numpy()
            b = b.filter(pa.array(bits[at >> 3] >> (at & 7) & 1 == 1))
            for k in range(0, len(b), 500):
                found = [sets(t.as_py()) for t in b.column(1).slice(k, 500)]
                yield pa.RecordBatch.from_arrays([pa.array(list(map(_class, found)), pa.int64()), _lists(found)], ["cls", "grams"])

    return run


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that a set of n needs with any partner."""
    return -(-n * percent // 100)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, grams) -> (cls, sketch): how many n-grams fall into each of PARTS parts of the hash space, 255 at most."""
    for b in batches:
        flat, ends = b.column(1).values.to_numpy(), b.column(1).offsets.to_numpy()
        row = np.repeat(np.arange(len(b)), np.diff(ends))
        flat = flat[ends[0] : ends[-1]]
        counts = np.bincount(row * PARTS + (flat >> 8 & PARTS - 1), minlength=len(b) * PARTS).reshape(-1, PARTS)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in np.minimum(counts, 255).astype(np.uint8)], pa.binary())], ["cls", "sketch"])


def _postings(percent: int, forest: bool):
    """Rows (h, c, d, part, cls, n, pos, rank, root, sketch) in order of (h, c, d) -> pairs (a, b) of one
    n-gram that pass all filters: length, first place, positional, and the suffix filter by sketch.

    forest: only pairs that connect what the n-gram's pairs so far don't, fewer than it has rows."""

    def pairs(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray] | None:
        rows.sort(key=lambda r: r[5])
        part, cls, n, pos, rank, root = (np.array([r[k] for r in rows], np.int64) for k in range(3, 9))
        sketch = np.frombuffer(b"".join(r[9] for r in rows), np.uint8).astype(np.int16).reshape(len(rows), -1)
        across = rows[0][1] != rows[0][2]
        end = np.searchsorted(n, n * 100 // percent, side="right")
        found = []
        for i in range(len(rows) - 1):
            j = np.arange(i + 1, end[i])
            least = -(-percent * (n[i] + n[j]) // (100 + percent))
            ok = (root[j] != root[i]) & (pos[i] <= n[i] - least) & (pos[j] <= n[j] - least)
            ok &= np.minimum(rank[i], rank[j]) + 1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1) >= least
            if across:
                ok &= part[j] != part[i]
            j, least = j[ok], least[ok]
            j = j[np.abs(sketch[j] - sketch[i]).sum(1) <= n[i] + n[j] - 2 * least]
            if forest:
                open_, j = j, []
                while len(open_):
                    j.append(open_[0])
                    root[root == root[open_[0]]] = root[i]
                    open_ = open_[root[open_] != root[i]]
                j = np.array(j, np.int64)
            if len(j):
                found.append((np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])))
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1 and (made := pairs(held)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["a", "b"])
            held.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[-1][:3] != row[:3]:
                    yield from done()
                held.append(row)
        yield from done()

    return run


def _verified(percent: int):
    """Pairs whose sets reach the threshold: suffix filter, then the exact count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = b.column(2), b.column(3)
            flat_a, ends_a, flat_c, ends_c = a.values.to_numpy(), a.offsets.to_numpy(), c.values.to_numpy(), c.offsets.to_numpy()
            good = np.zeros(len(a), bool)
            for k in range(len(a)):
                x, y = flat_a[ends_a[k] : ends_a[k + 1]], flat_c[ends_c[k] : ends_c[k + 1]]
                need = -(-percent * (len(x) + len(y)) // (100 + percent))
                cut_x = np.diff(np.searchsorted(x, _RANGES), prepend=0, append=len(x))
                cut_y = np.diff(np.searchsorted(y, _RANGES), prepend=0, append=len(y))
                if np.minimum(cut_x, cut_y).sum() < need:
                    continue
                if len(y) < len(x):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                good[k] = np.count_nonzero(y[at] == x) >= need
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), keep], ["a", "b", "linked"])

    return run


class _Join:
    def __init__(self, docs: DataFrame, n: int, percent: int, id_col: str, text_col: str):
        self.spark, self.percent = docs.sparkSession, percent
        self.scratch = s = Scratch(self.spark, "ngram-join")
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        kind = texts.schema["id"].dataType.simpleString()
        self.rows = s.save(texts.mapInArrow(_rows(n, percent), f"id {kind}, n int, cls long, inside int, pool array<long>"), "rows")
        pool = self.rows.where("n > 0").select("cls", "n", "inside", F.posexplode("pool").alias("at", "h"))
        open_ = s.save(self._prefixes(pool).select("cls").distinct(), "open-classes")
        # the pool has done its work
        self.rows = s.save(self.rows.select("id", "n", "cls"), "rows")
        for name, keep in (("rows", 1), ("prefix", 0)):
            s.drop(name, keep)
        # classes that may be linked at all; in what follows they alone count, with all their n-grams
        self.sets = self._sets(texts, n, open_)
        every = self.sets.select("cls", F.size("grams").alias("n"), F.explode("grams").alias("h"))
        self.prefix = self._prefixes(every.withColumn("inside", F.col("n")).withColumn("at", F.lit(0)))
        s.drop("prefix")

    def _prefixes(self, pool: DataFrame) -> DataFrame:
        """(h, cls, n, pos, rank) of the n-grams in prefixes that more than one class has there.

        pool: (cls, n, inside, at, h), where n-grams with at >= inside come last, in that order."""
        s, percent = self.scratch, self.percent
        # the join of n-grams that more than one class has may be split
        shared = s.save(self._several(pool), "several")
        s.release()
        met = s.save(pool.join(shared, "h").distinct(), "shared")
        s.drop("several", 0)
        s.release()
        classes = met.groupBy("h").agg(F.count("*").alias("df"))
        outside = (F.col("at") >= F.col("inside")).cast("int")
        order = Window.partitionBy("cls").orderBy("outside", "df", "h")
        ranked = met.join(classes, "h").withColumn("outside", outside).withColumn("place", F.row_number().over(order))
        ranked = ranked.withColumn("mine", F.sum(1 - F.col("outside")).over(Window.partitionBy("cls")))
        alone = F.col("inside") - F.col("mine")  # those of this class only are first in its order
        pos = F.when(F.col("outside") == 1, F.col("at")).otherwise(alone + F.col("place") - 1).cast("int")
        # how many of the n-grams before this one other classes may have
        rank = F.when(F.col("outside") == 1, F.col("mine") + F.col("at") - F.col("inside")).otherwise(F.col("place") - 1).cast("int")
        length = F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1
        prefix = s.save(ranked.select("h", "cls", "n", pos.alias("pos"), rank.alias("rank")).where(F.col("pos") < length), "prefix")
        s.drop("shared", 0)
        s.release()
        return s.save(prefix.join(self._several(prefix), "h", "left_semi"), "prefix")

    @staticmethod
    def _several(df: DataFrame) -> DataFrame:
        """The n-grams of more than one class. The aggregation combines map-side."""
        return df.groupBy("h").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("h")

    def _sets(self, texts: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
        """(cls, grams) of the wanted classes, one row of each."""
        first = self.rows.select("cls", "id").join(wanted, "cls").groupBy("cls").agg(F.min("id").alias("id"))
        first = self.scratch.save(first, "wanted")
        slots = MOST_BUCKETS << 15
        slot = lambda c: F.pmod(F.xxhash64(c), F.lit(slots))
        bits = first.select(slot("id").alias("slot")).groupBy(F.floor(F.col("slot") / (1 << 15)).alias("k")).agg(F.bitmap_construct_agg((F.col("slot") % (1 << 15)).cast("long")).alias("bits"))
        bitmap = np.zeros(slots // 8, np.uint8)
        for row in bits.toArrow().to_pylist():
            bitmap[row["k"] << 12 : (row["k"] + 1) << 12] = np.frombuffer(row["bits"], np.uint8)
        sent = self.spark.sparkContext.broadcast(bitmap)
        made = texts.select(slot("id").alias("slot"), "text").mapInArrow(_chosen_sets(n, sent), "cls long, grams array<long>")
        # a filter lets a few others through; equal sets of repeated ids leave one
        return self.scratch.save(made.join(first.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.first("grams").alias("grams")), "sets")

    def verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """(a, b, linked) for each pair (a, b), written."""
        pairs = self.scratch.save(pairs, f"{name}-pairs")
        needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        sets = self.sets.join(needed, "cls", "left_semi")
        left = sets.select(F.col("cls").alias("a"), F.col("grams").alias("x"))
        right = sets.select(F.col("cls").alias("b"), F.col("grams").alias("y"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
        return self.scratch.save(both.mapInArrow(_verified(self.percent), "a long, b long, linked boolean"), name)

    def _length(self, n, m):
        return F.least(n, m) * 100 >= F.greatest(n, m) * self.percent

    def _positional(self, n, pos, rank, m, at, place):
        """An n-gram at these places of both orders may be the first that a linked pair shares: no more are
        before it in either than may be missing, and what comes after leaves room for enough overlap."""
        least = F.ceil((n + m) * self.percent / float(100 + self.percent))
        most = F.least(rank, place) + 1 + F.least(n - pos - 1, m - at - 1)
        return (pos <= n - least) & (at <= m - least) & (most >= least)

    def leaders(self, roots: DataFrame | None, k: int) -> DataFrame:
        """At most one candidate pair (a, b) for each class, across components only."""
        band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / self.percent)) + 0.5 * (k % 2))
        p = self._with_root(self.prefix, roots).withColumn("band", band)
        end = lambda f, c: f(F.struct("root", "n", "cls", "pos", "rank")).alias(c)
        ends = p.groupBy("h", "band").agg(end(F.min, "low"), end(F.max, "high"))
        ends = ends.where(F.col("low.root") != F.col("high.root"))
        met = p.join(ends, ["h", "band"]).withColumn("to", F.when(F.col("root") == F.col("low.root"), F.col("high")).otherwise(F.col("low")))
        met = met.where(self._length(F.col("n"), F.col("to.n")) & self._positional(F.col("n"), F.col("pos"), F.col("rank"), F.col("to.n"), F.col("to.pos"), F.col("to.rank")))
        shared = met.groupBy("cls", F.col("to.cls").alias("other")).agg(F.count("*").alias("shared"))
        best = shared.groupBy("cls").agg(F.max(F.struct("shared", "other")).alias("best")).select("cls", F.col("best.other").alias("other"))
        return best.select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()

    def _with_root(self, df: DataFrame, roots: DataFrame | None) -> DataFrame:
        if roots is None:
            return df.withColumn("root", F.col("cls"))
        r = roots.select(F.col("node").alias("cls"), "root")
        return df.join(r, "cls", "left").withColumn("root", F.coalesce("root", "cls"))

    def rest(self, roots: DataFrame | None, tested: DataFrame | None, forest: bool) -> DataFrame:
        """All pairs that the filters leave and that no links connect yet, without those tested; or of each
        n-gram's pairs a forest of them."""
        p = self._with_root(self.prefix, roots)
        ends = p.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
        p = p.join(ends, "h", "left_semi").join(self.sets.mapInArrow(_sketches, "cls long, sketch binary"), "cls")
        p = self.scratch.save(p, "open")
        # a long list is dealt to blocks, two of which meet in a task; a short one is one block
        blocks = p.groupBy("h").agg(F.ceil(F.count("*") / MEET).cast("int").alias("blocks"))
        part = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
        dealt = p.join(blocks, "h").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("h", F.least("part", "other").alias("c"), F.greatest("part", "other").alias("d"), "part", "cls", "n", "pos", "rank", "root", "sketch")
        dealt = dealt.repartition("h", "c", "d").sortWithinPartitions("h", "c", "d")
        pairs = dealt.mapInArrow(_postings(self.percent, forest), "a long, b long").distinct()
        return pairs if tested is None else pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")

    def roots(self) -> DataFrame | None:
        """(node, root) of the classes that aren't the root of theirs."""
        s, roots, links, tested = self.scratch, None, None, None
        for k in range(ROUNDS):
            pairs = self.leaders(roots, k)
            if tested is not None:
                pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
            new = self.verify(pairs, f"verified{k}")
            tested = new if tested is None else tested.unionByName(new)
            found = new.where("linked").select("a", "b")
            if found.isEmpty():
                continue
            links = found if links is None else links.unionByName(found)
            roots = components(links, s)
        for forest in (True, False):
            new = self.verify(self.rest(roots, tested, forest), f"verified-{'forest' if forest else 'rest'}")
            tested = new if tested is None else tested.unionByName(new)
            found = new.where("linked").select("a", "b")
            if not found.isEmpty():
                links = found if links is None else links.unionByName(found)
                roots = components(links, s)
        return roots


def ngram_components(docs: DataFrame, *, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (the smallest id that links reach).

    Sets are linked when ``100 * intersection >= percent * union``.
    """
    join = _Join(docs, n, percent, id_col, text_col)
    roots = join.roots()
    rows = join.rows.select("id", "n", "cls")
    if roots is None:
        named = rows.where("n > 0").groupBy(F.col("cls").alias("root")).agg(F.min("id").alias("component_id"))
        rooted = rows.withColumn("root", F.col("cls"))
    else:
        rooted = join.scratch.save(join._with_root(rows, roots), "rooted")
        named = rooted.where("n > 0").groupBy("root").agg(F.min("id").alias("component_id"))
    out = rooted.where("n > 0").join(named, "root")
    full = out.select("id", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return full.unionByName(empty)


def one_of_each(docs: DataFrame, *, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, only the row with the smallest id of every component.

    Of different texts with that id in one component, one stays. Rows that repeat its id and text stay
    together. A null id ranks after all others; where a component has no other, one row of it stays.
    """
    text = F.col(text_col).cast("string")
    # a row is known by id and text, so that rows with its id alone share nothing with it
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"))
    found = ngram_components(docs.select(key.alias("key"), text.alias("text")), n=n, percent=percent, id_col="key", text_col="text")
    name = "_gone"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    gone = found.where(F.col("id") != F.col("component_id")).select(F.col("id.id").alias(f"{name}id"), F.col("id.h1").alias(f"{name}h1"), F.col("id.h2").alias(f"{name}h2")).distinct()
    text = docs[text_col].cast("string")
    same = docs[id_col].eqNullSafe(gone[f"{name}id"]) & (F.xxhash64(text) == gone[f"{name}h1"]) & (F.xxhash64(text, F.lit(1)) == gone[f"{name}h2"])
    kept = docs.join(gone, same, "left_anti")
    # copies of one text without any id; texts without words are linked with nothing
    nameless = F.col(id_col).isNull() & F.coalesce(text.rlike(r"[^\t-\r ]"), F.lit(False))
    return kept.where(~nameless).unionByName(kept.where(nameless).withColumn(name, text).dropDuplicates([name]).drop(name))
