"""A user's model over token lists: short ones packed, long ones cut, like lengths together.

``func(batch of token lists) -> batch of label lists``; it must give a label a token.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Model = Callable[[list[list[str]]], list[list[str]]]


#: Rows and tokens that a worker holds as Python lists at once.
SLICE_ROWS, SLICE_TOKENS = 512, 1 << 17


def _slices(batch: pa.RecordBatch, at: int, unit: int) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` of whole ``unit`` rows, cut where the lists of column ``at`` pass ``SLICE_TOKENS`` or the rows ``SLICE_ROWS``."""
    size = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_pylist()
    first = held = 0
    for i in range(0, len(size), unit):
        n = sum(size[i : i + unit])
        if i > first and (held + n > SLICE_TOKENS or i - first + unit > SLICE_ROWS):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if batch.num_rows > first:
        yield batch.slice(first)


def _with_tags(df: DataFrame, tokens: str, out: str, fn: Callable[[list[list[str]]], list[list[str]]], unit: int = 1) -> DataFrame:
    """``df`` with ``fn`` of the token lists, slice by slice, so that memory does not follow the Arrow batch; other columns stay in Arrow."""
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c != out or c == tokens])
    names = [c for c in df.columns if c != out]
    at = df.columns.index(tokens)
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField(out, T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, at, unit):
                got = fn([[] if t is None else t for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(got, pa.list_(pa.string()))], names=[*names, out])
        pa.default_memory_pool().release_unused()  # the worker lives on

    return df.mapInArrow(run, schema)


def labelled(df: DataFrame, tokens: str, func: Model, out: str = "tags", batch: int = 64) -> DataFrame:
    """``df`` with the model's labels; batches of rows as they come."""

    def run(lists: list[list[str]]) -> list[list[str]]:
        return [list(x) for a in range(0, len(lists), batch) for x in func(lists[a : a + batch])]

    return _with_tags(df, tokens, out, run, batch)


def by_length(df: DataFrame, tokens: str, func: Model, out: str = "tags", batch: int = 64) -> DataFrame:
    """Rows of like length in one batch, so that little is padded: sorted inside their partitions, without a shuffle."""
    return labelled(df.sortWithinPartitions(F.size(tokens)), tokens, func, out, batch)


def in_chunks(df: DataFrame, tokens: str, func: Model, size: int = 50, overlap: int = 10, out: str = "tags") -> DataFrame:
    """Long lists in overlapping parts that stay in their row; the labels of an overlap come half from each side."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")
    late, early = overlap // 2, overlap - overlap // 2

    def run(lists: list[list[str]]) -> list[list[str]]:
        cut = [[ts[a : a + size] for a in range(0, max(len(ts) - overlap - 1, 0) + 1, size - overlap)] if ts else [] for ts in lists]
        flat = [c for cs in cut for c in cs]
        got = iter(func(flat) if flat else [])
        rows = []
        for cs in cut:
            labels: list[str] = []
            for k in range(len(cs)):
                part = list(next(got))
                labels += part[late if k else 0 : len(part) if k == len(cs) - 1 else max(len(part) - early, 0)]
            rows.append(labels)
        return rows

    return _with_tags(df, tokens, out, run)


def by_sentences(df: DataFrame, tokens: str, func: Model, marks: str = "。！？!?；;", longest: int = 50, out: str = "tags") -> DataFrame:
    """Lists cut after punctuation, short parts packed up to ``longest`` tokens, labels put together again."""
    def parts(ts: list[str]) -> list[list[str]]:
        whole: list[list[str]] = [[]]
        for t in ts:
            whole[-1].append(t)
            if t in marks:
                whole.append([])
        packed: list[list[str]] = []
        for p in filter(None, whole):
            if packed and len(packed[-1]) + len(p) <= longest:
                packed[-1] = packed[-1] + p
            else:
                packed.append(p)
        return packed

    def run(lists: list[list[str]]) -> list[list[str]]:
        cut = [parts(ts) for ts in lists]
        flat = [p for ps in cut for p in ps]
        got = iter(func(flat) if flat else [])
        return [[x for _ in ps for x in next(got)] for ps in cut]

    return _with_tags(df, tokens, out, run)
