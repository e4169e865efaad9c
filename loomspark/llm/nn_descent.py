"""Embedding near-dedup by NN-descent.

1. Equal vectors form a class; one vector of each goes on.
2. Every class gets first neighbours from blocks: classes with equal signs on a few random hyperplanes,
   large blocks split at random.
3. Local joins refine the graph: a pivot compares its neighbours and the nodes that it is a neighbour
   of (``SAMPLE`` in all, new edges first) with one another, and those better than what a node has enter
   its list of ``NEIGHBOURS``. Rounds go on until few places of the lists change (``STILL``). Vectors travel as 8-bit codes.
4. Pairs near the threshold are verified in double precision. A node with a list full of links is
   saturated: its list is enlarged, with the lists of some of its links, round by round until none
   brings a new link. There is no cap on links.
5. The recall is audited: random classes are held against all vectors in blocks, until ``LINKED`` of them
   have links or ``MOST`` were taken. Each of those counts alike, by the share of its links that were found,
   so large groups don't outweigh small ones. While the mean, or that of the classes with about as many
   links (``ENOUGH`` or more), is below ``RECALL``, blocks by other hyperplanes add neighbours and 3 and 4
   run again. If the recall doesn't rise for ``PATIENCE`` rounds, ``near_duplicates`` raises an error; it
   returns the audited recall, and logs it by number of links. Where none of the audited classes has a link, links are
   too rare to measure it: the recall is None, not 1.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing.
Vectors of different lengths link with nothing of another length. Null ids take part and rank after all
others: a component's id is the smallest that isn't null. Repeated rows are in one class and linked with
each other. Columns beyond id and vector don't matter, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch

NEIGHBOURS, SAMPLE, BLOCK, BLOCKINGS, BETTER, ASKED = 12, 24, 96, 3, 4, 4
STILL, RECALL, PATIENCE = 0.002, 0.99, 8
#: Of the audit: classes held against all at once and in all, those with links that it wants, and those
#: with about as many links that make a mean of their own.
QUERIES, MOST, LINKED, ENOUGH = 2048, 32768, 256, 64
_log = logging.getLogger(__name__)
#: What 8-bit codes may be off in a cosine.
SLACK = 0.02


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _coded(seed: int, planes: int):
    """(cls, code, block): 8-bit codes and the signs on random hyperplanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = _unit(b.column(1).values.to_numpy().astype(np.float64).reshape(len(b), -1))
                code = np.rint(x / np.abs(x).max(1, keepdims=True) * 127).astype(np.int8)
                normal = np.random.default_rng(seed).standard_normal((planes, x.shape[1]))
                block = ((x @ normal.T > 0) * (1 << np.arange(planes, dtype=np.int64))).sum(1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(block, pa.int64())], ["cls", "code", "block"])

    return run


def _local_join(best: int):
    """Rows (key, u, code, floor, fresh) in order of the key -> (u, v, sim): for each member of a group
    the best others above its floor, of pairs with a fresh side."""

    def group(rows: list[tuple]) -> tuple[np.ndarray, ...] | None:
        u = np.array([r[1] for r in rows], np.int64)
        if len(u) < 2:
            return None
        x = np.frombuffer(b"".join(r[2] for r in rows), np.int8).reshape(len(u), -1).astype(np.float32)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        fresh = np.array([r[4] for r in rows])
        # in steps far below what codes may be off, so that members of a dense group tie and lists come to rest
        sim = np.rint(x @ x.T * np.float32(1024)) / np.float32(1024)
        sim[(u[:, None] == u) | ~(fresh[:, None] | fresh)] = -2
        sim[sim <= np.array([r[3] for r in rows], np.float32)[:, None]] = -2
        n = min(best, len(u) - 1)
        top = np.argpartition(-sim, n - 1, axis=1)[:, :n]
        value = np.take_along_axis(sim, top, 1)
        ok = value > -2
        return np.repeat(u, ok.sum(1)), u[top[ok]], value[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple[np.ndarray, ...]] = []
        size = 0

        def close() -> None:
            nonlocal size
            if (found := group(held)) is not None:
                out.append(found)
                size += len(found[0])
            held.clear()

        def flush() -> pa.RecordBatch:
            nonlocal size
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["u", "v", "sim"])
            out.clear()
            size = 0
            return batch

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[-1][0] != row[0]:
                    close()
                held.append(row)
            if size > 100_000:
                yield flush()
        if held:
            close()
        if out:
            yield flush()

    return run


def _cosines(least: float):
    """(a, b, x, y) -> (a, b) of the pairs whose cosine in double precision is at least this."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x, y = (_unit(b.column(k).values.to_numpy().astype(np.float64).reshape(len(b), -1)) for k in (2, 3))
                ok = pa.array((x * y).sum(1) >= least)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    return run


class _Graph:
    def __init__(self, vectors: DataFrame, least: float, scratch: Scratch):
        """vectors: (cls, vec) of one length."""
        self.v, self.least, self.s, self.seed = vectors, least, scratch, 0
        self.n = vectors.count()
        self.edges: DataFrame | None = None  # (u, v, sim, fresh)
        self.links: DataFrame | None = None  # (a, b), a < b, verified
        self.tested: DataFrame | None = None
        self.true: DataFrame | None = None  # (q, v): what the audit looks for

    def _random(self, *columns) -> F.Column:
        self.seed += 1
        return F.xxhash64(*columns, F.lit(self.seed))

    def _joined(self, members: DataFrame) -> DataFrame:
        """members: (key, u, code, floor, fresh)."""
        rows = members.select("key", "u", "code", "floor", "fresh").repartition("key").sortWithinPartitions("key")
        return rows.mapInArrow(_local_join(BETTER if self.edges is not None else NEIGHBOURS), "u long, v long, sim float")

    def _merge(self, found: DataFrame) -> int:
        """Takes better neighbours into the lists; the number of places that changed."""
        found = found.select("u", "v", "sim", F.lit(True).alias("fresh"))
        old = self.edges
        every = found if old is None else found.unionByName(old.withColumn("fresh", F.lit(False)))
        every = every.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
        place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
        self.edges = self.s.save(every.withColumn("place", place).where(F.col("place") <= NEIGHBOURS).drop("place"), "lists")
        self.s.drop("lists", keep=2)
        return self.edges.where("fresh").count()

    def block(self) -> None:
        for _ in range(BLOCKINGS):
            self.seed += 1
            planes = max(1, min(40, int(self.n // BLOCK).bit_length()))
            coded = self.s.save(self.v.mapInArrow(_coded(self.seed, planes), "cls long, code binary, block long"), "codes")
            if self.seed == 1:
                self.codes = coded.select("cls", "code")
            parts = coded.groupBy("block").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
            part = F.pmod(self._random("cls"), F.col("parts"))
            rows = coded.join(parts, "block").select(F.xxhash64("block", part).alias("key"), F.col("cls").alias("u"), "code", F.lit(-1.0).cast("float").alias("floor"), F.lit(True).alias("fresh"))
            self._merge(self._joined(rows))

    def descend(self) -> None:
        while True:
            e = self.edges
            floors = e.groupBy("u").agg(F.when(F.count("*") >= NEIGHBOURS, F.min("sim")).otherwise(F.lit(-1.0)).cast("float").alias("floor"))
            nodes = self.codes.withColumnRenamed("cls", "u").join(floors, "u", "left").withColumn("floor", F.coalesce("floor", F.lit(-1.0).cast("float")))
            near = e.select(F.col("u").alias("key"), F.col("v").alias("u"), "fresh").unionByName(e.select(F.col("v").alias("key"), "u", "fresh"))
            near = near.groupBy("key", "u").agg(F.max("fresh").alias("fresh"))
            first = Window.partitionBy("key").orderBy(F.desc("fresh"), self._random("u", "key"))
            near = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= SAMPLE)
            changed = self._merge(self._joined(near.join(nodes, "u")))
            if changed <= STILL * NEIGHBOURS * self.n:
                return

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b), a < b: those that weren't tested before and are links, written."""
        pairs = pairs.distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = self.s.save(pairs, "pairs")
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        x, y = self.v.select(F.col("cls").alias("a"), F.col("vec").alias("x")), self.v.select(F.col("cls").alias("b"), F.col("vec").alias("y"))
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
        new = self.s.save(both.mapInArrow(_cosines(self.least), "a long, b long"), "links")
        self.links = new if self.links is None else self.links.unionByName(new)
        return new

    def link(self) -> None:
        e = self.edges.where(F.col("sim") >= self.least - SLACK)
        self._verify(e.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")))
        both = lambda d: d.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(d.select(F.col("b").alias("u"), F.col("a").alias("v")))
        while True:
            e = self.s.save(both(self.links), "enlarged")
            full = e.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= NEIGHBOURS - 1).select("u")
            place = F.row_number().over(Window.partitionBy("u").orderBy(self._random("u", "v")))
            asked = e.withColumn("place", place).where(F.col("place") <= ASKED).join(full, "u", "left_semi").select("u", F.col("v").alias("mid"))
            met = asked.join(e.select(F.col("u").alias("mid"), F.col("v").alias("w")), "mid").where("u <> w")
            if self._verify(met.select(F.least("u", "w").alias("a"), F.greatest("u", "w").alias("b"))).isEmpty():
                return

    def _true(self, k: int) -> DataFrame:
        """(q, v): the links of some classes, by comparison with all, written. k: which QUERIES of them."""
        some = self.v.join(self.chosen.where(F.floor(F.col("place") / QUERIES) == k).select("cls"), "cls").select("cls", "vec").toArrow()
        ids = some.column("cls").to_numpy()
        q = _unit(some.column("vec").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(ids), -1))
        sent, least = self.v.sparkSession.sparkContext.broadcast((ids, q)), self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for b in batches:
                for at in range(0, len(b), 512):
                    part = b.slice(at, 512)
                    cls = part.column(0).to_numpy()
                    x = _unit(part.column(1).flatten().to_numpy().astype(np.float64).reshape(len(part), -1))
                    i, j = np.nonzero((q @ x.T >= least) & (ids[:, None] != cls))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(cls[j])], ["q", "v"])

        return self.s.save(self.v.mapInArrow(run, "q long, v long"), "audit")

    def audit(self) -> tuple[float | None, dict[int, tuple[int, float]]]:
        """The mean share of its links that were found, over some classes that have links; and their number
        and mean by number of links (from a power of 2 to below the next)."""
        if self.true is None:
            first = self.v.select("cls").orderBy(F.xxhash64("cls"), "cls").limit(MOST).toArrow().column("cls").to_pylist()
            self.chosen = self.s.save(self.v.sparkSession.createDataFrame([(c, k) for k, c in enumerate(first)], "cls long, place int"), "chosen")
            for k in range(-(-len(first) // QUERIES)):
                more = self._true(k)
                self.true = more if self.true is None else self.true.unionByName(more)
                if self.true.select("q").distinct().count() >= LINKED:
                    break
        a, b = F.least("q", "v").alias("a"), F.greatest("q", "v").alias("b")
        found = self.true.select("q", a, b).join(self.links.select("a", "b", F.lit(1).alias("found")).distinct(), ["a", "b"], "left")
        shares = found.groupBy("q").agg(F.count("*").alias("n"), (F.count("found") / F.count("*")).alias("share"))
        bands = shares.groupBy(F.floor(F.log2("n")).alias("band")).agg(F.count("*").alias("n"), F.sum("share").alias("share")).collect()
        by = {1 << r["band"]: (r["n"], r["share"] / r["n"]) for r in sorted(bands)}
        n = sum(r["n"] for r in bands)
        return sum(r["share"] for r in bands) / n if n else None, by

    def search(self) -> float | None:
        """Blocks, local joins and links until the audit is content; the recall, None if there is nothing to measure it by."""
        best, waited = -1.0, 0
        while True:
            self.block()
            self.descend()
            self.link()
            self.s.release()
            recall, by = self.audit()
            _log.info("recall %s; by links from (classes, recall): %s", recall, by)
            if recall is None:
                return None
            least = min([recall, *(share for n, share in by.values() if n >= ENOUGH)])
            if least >= RECALL:
                return recall
            best, waited = (least, 0) if least > best else (best, waited + 1)
            if waited >= PATIENCE:
                raise RuntimeError(f"nn-descent: recall {recall:.4f}, {least:.4f} at worst, below {RECALL} and rises no more; by links from (classes, recall): {by}")


def near_duplicates(vectors: DataFrame, *, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, float | None]:
    """Per row: id, n_links (other rows linked with it), component_id; and the least audited recall, None where none was measured."""
    scratch = Scratch(vectors.sparkSession, "nn-descent")
    vec = F.col("vec")
    good = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).withColumn("vec", F.when(good, vec))
    # -0.0 and 0.0 are one number
    key = F.transform("vec", lambda x: x + F.lit(0.0))
    rows = scratch.save(rows.withColumn("h1", F.xxhash64(key)).withColumn("h2", F.xxhash64(key, F.lit(1))), "rows")
    known = rows.where("vec is not null")
    classes = known.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("id").alias("id"), F.first("vec").alias("vec"))
    classes = scratch.save(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    links, recall = None, None
    for size in [r["size"] for r in classes.select(F.size("vec").alias("size")).distinct().collect()]:
        g = _Graph(scratch.save(classes.where(F.size("vec") == size).select("cls", "vec"), "vectors"), least, scratch)
        if g.n < 2:
            continue
        recall = min((x for x in (recall, g.search()) if x is not None), default=None)
        links = g.links if links is None else links.unionByName(g.links)
    named = classes.select("cls", "h1", "h2", "copies", F.col("id").alias("least"))
    if links is None:
        named = named.withColumn("root", F.col("cls")).withColumn("others", F.lit(0))
    else:
        links = scratch.save(links.distinct(), "all-links")
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        others = both.join(classes.select(F.col("cls").alias("b"), "copies"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("copies").alias("others"))
        roots = components(links, scratch).withColumnRenamed("node", "cls")
        named = named.join(others, "cls", "left").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = scratch.save(named, "named")
    least_id = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least_id, "root").select("h1", "h2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    alone = rows.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return known.join(named, ["h1", "h2"]).select("id", F.col("n_links").cast("long").alias("n_links"), "component_id").unionByName(alone), recall
