"""Batch inference by a fixed number of ranks that run at once, with the results in the order of the input.

Rows get places in their order, and rank r of n takes the places r, r + n, r + 2 n and so on, as a distributed sampler deals them. The ranks are the tasks
of one barrier stage: all start together or not at all, each loads its model once, and all wait for one another before they end, so that a model
that is spread over machines may talk between its ranks. If one rank fails, Spark runs the whole stage again. What they return is
gathered by place, in a sort that Spark splits by ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..sources.shared import Shared
from .relations import places

#: A model: it takes the texts of one batch and returns as many.
Model = Callable[[list], list]


def infer(
    df: DataFrame, load: Callable[[int, int], Model], column: str, order: str, *, ranks: int, out: str = "response", batch: int = 32, profile: ResourceProfile | None = None, state: str = "place"
) -> DataFrame:
    """``df`` with ``out`` and ``place`` (from 1), by place. ``load(rank, ranks)`` runs in each task. ``order`` is unique; ``profile`` says what a rank's task needs.

    Needs as many free slots as ranks. A null goes to the model like any text. Actions run while the plan is built."""
    placed = places(df, order, state)
    dealt = placed.repartitionById(ranks, F.pmod(F.col(state) - 1, F.lit(ranks)).cast("int")).sortWithinPartitions(state)
    at = placed.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        context.barrier()  # all ranks are there
        model = load(context.partitionId(), ranks)
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                answers = list(model(part.column(at).to_pylist()))
                if len(answers) != part.num_rows:
                    raise ValueError(f"{len(answers)} answers to {part.num_rows} texts")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(answers, pa.string())], names=[*part.schema.names, out])
        context.barrier()

    schema = StructType([*placed.schema.fields]).add(out, StringType())
    # a barrier stage that ends in a shuffle can run again as a whole; one that ends a job can't. The answers are written once, the sort reads them twice
    answered = dealt.mapInArrow(run, schema, barrier=True, profile=profile).repartition(ranks, state)
    return Shared(df.sparkSession, "infer").save(answered, "answered").orderBy(state)
