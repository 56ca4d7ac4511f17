"""Sharding by vector bin packing.

Every row has a size vector (bytes, words, rows). Rows of equal text form a
group and stay together. The shards are bins; a bin's capacity is an equal part
of each total. Groups are placed one by one, largest first, each into the bin
whose residual capacity has the highest dot product with the group's vector
(both scaled by capacity). That rule holds to the last group; as the small ones come last, they level
all three sizes. Bytes count ``BYTES_WEIGHT`` times, since they are the law.

Scale: groups are counted by the data, bins are not, so what is placed are
*bundles*: buckets of the text's hash, whose number grows with the shards and the cube root of the rows, and
the heavy groups, each by itself. A group is heavy if it holds more than
``1 / (HEAVY * shards)`` of the bytes, words or rows: at most ``3 * HEAVY * shards`` of them
can exist. Only a group that exceeds a whole shard is split, by a hash of the row's place, so that null and
repeated ids are spread too. Only bundle totals reach the
driver, and only the bundle-to-shard table is broadcast. Slots come from row
counts of cells, which are bundles or equal parts of a heavy group, and a window inside a cell, never from a window over a shard.

Null text: no bytes, no words. Empty table: no rows. Repeated rows: placed each. Rows of equal id and text may
swap their slots. Very long texts are measured whole; one that exceeds a shard makes that shard larger. Only
doc_id and text are read, whatever further columns are called.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphline.llm.common import WORD, cut, text_or_empty

#: Bytes added to every row's size: its length field.
ROW_BYTES = 8
#: Weight of bytes against words and rows in the dot product; share of a shard from which a group is heavy.
BYTES_WEIGHT, HEAVY = 4.0, 64


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Bin of each row of ``vectors`` (bytes, words, rows): the one whose residual capacity has the highest dot product with it."""
    total = vectors.sum(0)
    v = vectors / np.where(total > 0, total / shards, 1.0)
    weighted = v * np.array([BYTES_WEIGHT, 1.0, 1.0])
    left = np.ones((shards, v.shape[1]))
    out = np.empty(len(v), np.int64)
    for i in np.lexsort((np.arange(len(v)), -v.max(1))) if len(v) else ():
        k = int((left @ weighted[i]).argmax())
        left[k] -= v[i]
        out[i] = k
    return out


def shard_documents(docs: DataFrame, shards: int = 24, bundles: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, n_words, shard, slot for every row of ``docs``."""
    text = F.col(text_col)
    words: Column = F.regexp_count(text_or_empty(text), F.lit(WORD))
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text_or_empty(text)) + F.lit(ROW_BYTES)).cast("bigint").alias("size"),
            F.crc32(text_or_empty(text).cast("binary")).alias("text_crc32"),
            words.cast("bigint").alias("n_words"),
            F.xxhash64(text).alias("key"),
            text.isNull().alias("no_text"),
            F.xxhash64(F.monotonically_increasing_id()).alias("place"),  # fixed by the cut
        )
    )
    total = rows.agg(F.sum("size").alias("b"), F.sum("n_words").alias("w"), F.count("*").alias("n")).first()
    if not total["n"]:
        return rows.select("doc_id", "size", "text_crc32", "n_words", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    bundles = bundles or shards * max(512, math.ceil(4 * total["n"] ** (1 / 3)))
    group = ["key", "text_crc32", "size", "n_words", "no_text"]
    share = F.greatest(F.col("n") * F.col("size") / total["b"], F.col("n") * F.col("n_words") / max(1, total["w"]), F.col("n") / total["n"])
    groups = rows.groupBy(*group).agg(F.count("*").alias("n")).withColumn("share", share)
    heavy = groups.where((F.col("n") > 1) & (F.col("share") * HEAVY * shards > 1)).select(
        *group,
        F.ceil(F.col("share") * HEAVY * shards).cast("int").alias("cells"),
        F.when(F.col("share") * shards > 1, F.ceil(2 * F.col("share") * shards)).otherwise(1).cast("int").alias("pieces"),
    )
    known = heavy.collect()  # at most 3 * HEAVY * shards rows
    table = rows.sparkSession.createDataFrame(known, heavy.schema)
    cell = F.when(F.col("cells").isNull(), -1).otherwise(F.pmod("place", "cells")).cast("bigint")
    bundle = F.when(F.col("cells").isNull(), F.pmod("key", F.lit(bundles))).otherwise(F.col("key")).cast("bigint")
    rows = rows.join(F.broadcast(table), group, "left").withColumn("cell", cell).withColumn("bundle", bundle)
    sums = (
        rows.groupBy("bundle", "cell")
        .agg(F.sum("size").alias("b"), F.sum("n_words").alias("w"), F.count("*").alias("n"), F.max("pieces").alias("pieces"))
        .collect()  # at most bundles + cells of heavy groups
    )
    sums.sort(key=lambda r: (r["bundle"], r["cell"]))
    whole: dict[tuple[int, int], list] = {}
    for r in sums:
        whole.setdefault((r["bundle"], r["cell"] % r["pieces"] if r["pieces"] else -1), []).append(r)
    vectors = np.array([[sum(r[c] for r in cells) for c in ("b", "w", "n")] for cells in whole.values()], float)
    base, placed = [0] * shards, []
    for k, cells in zip(place(vectors, shards).tolist(), whole.values(), strict=True):
        for r in cells:
            placed.append((r["bundle"], r["cell"], k, base[k]))
            base[k] += r["n"]
    table = rows.sparkSession.createDataFrame(placed, "bundle long, cell long, shard int, base long")
    inside = Window.partitionBy("bundle", "cell").orderBy(F.col("doc_id"), "text_crc32")
    return (
        rows.withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(table), ["bundle", "cell"])
        .select("doc_id", "size", "text_crc32", "n_words", "shard", (F.col("base") + F.col("nth") - 1).alias("slot"))
    )


def shard_report(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The contract's columns; the law is ``bytes``: sizes of shards near equal."""
    return shard_documents(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "n_words",
    )


def spread(sizes: list[int]) -> float:
    """Largest over mean, for tests and reports."""
    return max(sizes) / (math.fsum(sizes) / len(sizes)) if sizes else 1.0
