"""The training fold, and small models fitted in one task on a bounded sample."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; false without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def below(hashed: Column, n: int, count: Column) -> Column:
    """True for about 2 n + 100 of `count` rows, by their hash, so that n smallest ones can be chosen from few."""
    # Hashes are even over -2^63 .. 2^63, so a share of them lies below as large a share of that range.
    return hashed / 2.0**64 + 0.5 < (2 * n + 100) / count


def smallest_hashes(rows: DataFrame, n: int) -> DataFrame:
    """At most n rows (doc_id, ...): those with the smallest hash of the id, whatever the partitioning.

    Rows are counted first, and only those whose hash can be among the n smallest are sorted: about 2 n + 100, from however many tasks.
    """
    hashed, total = F.xxhash64("doc_id"), rows.count()
    few = rows.filter(below(hashed, n, F.lit(total)))
    if total > 2 * n + 100 and few.count() < n:
        few = rows
    return (few if total > 2 * n + 100 else rows).orderBy(hashed, "doc_id").limit(n)


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def unpack(packed: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(packed)) as found:
        return dict(found)


def fit_in_one_task(rows: DataFrame, fit: Callable[[pa.Table], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Run `fit` over all of `rows`, a bounded sample, in one task; only the model comes to the driver."""
    schema = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(),
                                  "binary": pa.binary()}[f.dataType.simpleString()]) for f in rows.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit(pa.Table.from_batches(list(batches), schema))
        yield pa.RecordBatch.from_arrays([pa.array([pack(model)], pa.binary())], ["model"])

    fitted = rows.repartition(1).mapInArrow(run, "model binary").first()
    # Spark may find out while planning that there are no rows, and then runs no task.
    return unpack(bytes(fitted.model)) if fitted else fit(schema.empty_table())
