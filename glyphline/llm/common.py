"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphline.shared import cut, fresh_dir, remove_dir, shared_dir  # noqa: F401

#: A word of the contracts: a run of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


#: Bytes of text that a worker takes at once.
SLICE_BYTES = 4 << 20


def fenced(col: Column) -> Column:
    """``col``, so that the optimiser doesn't move filters on it below the projection that makes it.

    A filter that is moved takes the whole expression along, once for each mention,
    and nested higher-order functions then grow beyond all bounds. An expression
    that isn't deterministic stays where it is; this one has the same value always.
    """
    return F.when(F.spark_partition_id() >= 0, col)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def slices(batch: pa.RecordBatch, at: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` of at most ``rows`` rows, cut where the values of column ``at`` pass ``SLICE_BYTES``."""
    size = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist() if pa.types.is_string(batch.column(at).type) else [0] * batch.num_rows
    first = held = 0
    for i, n in enumerate(size):
        if i > first and (held + n > SLICE_BYTES or i - first == rows):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if batch.num_rows > first:
        yield batch.slice(first)


def map_texts(
    df: DataFrame,
    text_col: str,
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[list[str | None]], dict[str, pa.Array | list]]],
    slice_rows: int = 512,
) -> DataFrame:
    """All columns of ``df`` plus ``fields``, computed from the text by ``make()(texts)``.

    ``make`` runs once in each task. Columns of ``df`` named like one of
    ``fields`` are replaced by the result. Batches are worked on in slices of
    ``slice_rows`` texts and ``SLICE_BYTES`` of text (or one text), so that memory does not follow the Arrow batch.
    """
    new = {f.name for f in fields}
    if text_col in new:
        raise ValueError(f"output column {text_col!r} would replace the input text")
    kept = [c for c in df.columns if c not in new]
    df = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*df.schema.fields, *fields])
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = {f.name: to_arrow_type(f.dataType) for f in fields}
        fn = None
        for batch in batches:
            fn = fn or make()
            for part in slices(batch, at, slice_rows):
                out = fn(part.column(at).to_pylist())
                arrays = [
                    out[f.name].cast(types[f.name]) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], types[f.name])
                    for f in fields
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*kept, *[f.name for f in fields]])
        pa.default_memory_pool().release_unused()  # the worker lives on

    return df.mapInArrow(run, schema)
