"""Functions of one job's rows, run over all jobs: once a job's rows are together, no row leaves its task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def per_job(rows: DataFrame, of: Callable[[pa.Table], pa.Table | None], schema: str, grouped: bool = False) -> DataFrame:
    """``of`` gets the table of each job in ``rows(job_id, ...)`` and returns that job's rows of ``schema``, or None.

    ``grouped`` promises that the rows of a job lie in one partition one after
    another, as ``document_chunks`` leaves them; else they are shuffled by job.
    Jobs pass as one stream of batches, so a small job costs no batch of its own.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("job_id").to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for low, high in zip(starts, starts[1:], strict=False):
                if held and held[0].column("job_id")[0].as_py() != ids[low]:
                    if (out := of(pa.Table.from_batches(held))) is not None:
                        yield from out.to_batches()
                    held = []
                held.append(batch.slice(low, high - low))
        if held and (out := of(pa.Table.from_batches(held))) is not None:
            yield from out.to_batches()

    rows = rows if grouped else rows.repartition("job_id").sortWithinPartitions("job_id")
    return rows.mapInArrow(stream, schema)
