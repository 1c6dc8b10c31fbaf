"""Arrow batches in bounded pieces and in runs of equal keys, and names for columns of one's own."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at once in a Python worker; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20


#: Rows of an Arrow batch of texts; Spark's own bound of 10,000 rows can mean hundreds of megabytes.
BATCH_ROWS = 1000
#: Bytes of text after which a worker gives freed memory back to the system.
TRIM_BYTES = 64 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the rows of an Arrow batch, which counts when a plan is run."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def trim() -> None:
    """Give freed memory back, so that an idle worker does not hold what its last task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose texts hold about ``most`` bytes."""
    read = 0
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b[text]), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += n
        if len(sizes) > start:
            yield b.slice(start)
        read += sum(sizes)
        if read > TRIM_BYTES:
            read = 0
            trim()
    trim()


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from sorted batches; a run may span batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b[k].to_numpy(zero_copy_only=False) for k in keys]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        if held and any(h[k][h.num_rows - 1].as_py() != b[k][0].as_py() for h in held[-1:] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        start = 0
        for c in cut:
            held.append(b.slice(start, c - start))
            yield pa.Table.from_batches(held)
            held, start = [], int(c)
        held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def fresh(rows: DataFrame, name: str) -> str:
    """A column name that ``rows`` does not have, in any case."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
