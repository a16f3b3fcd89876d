"""Documents dealt to blocks of some MB, written once as a table bucketed by block.

What a block asks of the rest of the corpus is shuffled packed, and the answers meet its texts again without
moving them: grouping the table by block needs no exchange.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators.graph import shared_dir

from .common import free_name, in_arrow
from .tokens import steps

#: Text of a block, in bytes; a longer document is a block of its own.
BLOCK = 16_000_000
#: Bytes of text that a task works on at once.
STEP = 2_000_000


def dealt(docs: DataFrame, block: str, row: str, total: int, fold: Column | None = None) -> DataFrame:
    """All rows of `docs` (text is a string) with `row`, a number of their own, and `block`, whose last bit is `fold` (0 or 1). `total` is the size of all texts."""
    part_of = free_name(docs, "fold")
    rows = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(part_of, F.lit(0) if fold is None else fold)
    most, step = BLOCK, STEP

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, size = TaskContext.get().partitionId() << 32, [0, 0], [0, 0]
        for batch in batches:
            for part in steps(batch, limit=step):
                for f in (0, 1):
                    mine = part.filter(pc.equal(part.column(part_of), f))
                    if not mine.num_rows:
                        continue
                    names = [c for c in mine.schema.names if c != part_of]
                    ids = pa.array(np.full(mine.num_rows, task | number[f] << 1 | f))
                    yield pa.RecordBatch.from_arrays([*[mine.column(c) for c in names], ids], [*names, block])
                    size[f] += pc.sum(pc.binary_length(mine.column("text"))).as_py() or 0
                    if size[f] >= most:
                        number[f], size[f] = number[f] + 1, 0

    schema = rows.drop(part_of).withColumn(block, F.lit(0).cast("long")).schema
    name = f"blocks_{uuid.uuid4().hex}"
    buckets = max(16, min(50_000, total // (4 * BLOCK)))
    out = in_arrow(rows, deal, schema)
    out.write.bucketBy(buckets, block).sortBy(block).option("path", f"{shared_dir(docs.sparkSession)}/{name}").option("compression", "zstd").format("parquet").saveAsTable(name)
    return docs.sparkSession.table(name)


def slices(table: pa.Table, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    for batch in table.combine_chunks().to_batches():
        yield from steps(batch, limit=limit or STEP)


def packed(values: np.ndarray, size: int) -> bytes:
    """`size` low bytes of each value, laid out byte by byte and compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize)[:, :size].T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, size: int, kind: type) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    out[:, :size] = planes.T
    return out.reshape(-1).view(kind)


def by_shard(of: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places in `of` that hold it), in their order."""
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=shards))
    for s in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
        yield s, order[ends[s - 1] if s else 0 : ends[s]]
