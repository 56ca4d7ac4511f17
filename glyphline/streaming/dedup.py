"""Streams: exact and near copies against what came before, n-gram counts, recurring times.

State lives in Spark's state store, keyed by a hash (or by a shard of its blocks), and
ends with the watermark or a time to live, so a restart goes on from the checkpoint
and no outside store is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphline.operators.new_words import ngrams


def first_of_each(stream: DataFrame, text: str, time: str, within: str) -> DataFrame:
    """Rows whose text hasn't come within that time."""
    hashed = stream.withColumn("_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return hashed.withWatermark(time, within).dropDuplicatesWithinWatermark(["_hash"]).drop("_hash")


def near_copies(stream: DataFrame, id_col: str, fp_col: str, time: str, days: float, radius: int = 3, most_kept: int = 1_000_000, shards: int = 1024) -> DataFrame:
    """id, match: rows near one that came in the ``days`` before, with the least id known for it.

    Fingerprints at distance 3 or less agree in one of their four blocks of 16 bits, so
    each row goes to four groups, one a block: its values are dealt to ``shards`` groups,
    whose number bounds what a batch costs besides its rows. A group's state holds the
    fingerprints it has seen, with the time of the last, and drops them after ``days``. A
    row may come out once for each block that finds a match: ``.groupBy("id").agg(min("match"))``
    joins these in the sink. A group that has seen ``most_kept`` different fingerprints
    raises an error rather than forgetting some: more ``shards`` make groups smaller.
    Rows without a fingerprint match nothing.
    """
    if not 0 <= radius <= 3:
        raise ValueError("blocks are made for up to 3 differing bits")
    block = lambda k: F.shiftrightunsigned(F.col("fp"), 16 * k).bitwiseAND(F.lit(0xFFFF))
    groups = F.array(*[F.pmod(F.xxhash64(block(k)), F.lit(shards)) + F.lit(k * shards) for k in range(4)])
    rows = stream.select(F.col(id_col).cast("long").alias("id"), F.col(fp_col).cast("long").alias("fp"), F.col(time).cast("timestamp").cast("long").alias("at"))
    keyed = rows.where("fp IS NOT NULL").select("*", F.explode(groups).alias("key"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = np.frombuffer(state.get[0], np.int64).reshape(3, -1) if state.exists else np.empty((3, 0), np.int64)
        got = [f[["at", "id", "fp"]].to_numpy(np.int64) for f in frames]
        rows = np.concatenate(got)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        fps, place = np.unique(np.concatenate([kept[0], rows[:, 2]]), return_inverse=True)
        known, place = place[: kept.shape[1]], place[kept.shape[1] :]
        first, last = np.zeros(len(fps), np.int64), np.full(len(fps), np.iinfo(np.int64).min)
        first[known], last[known] = kept[1], kept[2]
        ends, near = _near(fps, np.unique(place), key[0] // shards, radius)
        first, last, out, life = first.tolist(), last.tolist(), [], int(days * 86400)
        for (at, i, _), p in zip(rows.tolist(), place.tolist(), strict=True):
            if least := [first[q] for q in near[ends[p] : ends[p + 1]] if last[q] >= at - life]:
                out.append((i, min(least)))
            first[p] = min(first[p], i) if last[p] >= at - life else i
            last[p] = max(last[p], at)
        table = np.array([fps, first, last], np.int64)
        table = table[:, table[2] >= rows[-1, 0] - life]
        if table.shape[1] > most_kept:
            raise RuntimeError("too many fingerprints in one group: take more shards or shorten the time to live")
        state.update((table.tobytes(),))
        if out:
            yield pd.DataFrame(out, columns=["id", "match"])

    return keyed.groupBy("key").applyInPandasWithState(step, "id long, match long", "kept binary", "append", "NoTimeout")


def _near(fps: np.ndarray, asked: np.ndarray, block: int, radius: int, most: int = 1 << 20) -> tuple[list[int], list[int]]:
    """For each fingerprint (by place) its part of a list of places: those asked get the ones within ``radius`` bits that share the block, themselves included.

    Where comparing all that share it takes more than ``most`` comparisons, those are
    compared that share one of four parts of the other 48 bits too. Comparisons are made ``most`` at a time.
    """
    bits = fps.view(np.uint64)
    own = bits >> np.uint64(16 * block) & np.uint64(0xFFFF)
    rest = bits & np.uint64((1 << 16 * block) - 1) | bits >> np.uint64(16) & ~np.uint64((1 << 16 * block) - 1)
    _, sharing = np.unique(own, return_inverse=True)
    keys = [own]
    if np.bincount(sharing)[sharing[asked]].sum() > most:
        keys = [own << np.uint64(12) | rest >> np.uint64(12 * k) & np.uint64(0xFFF) for k in range(4)]
    found = []
    for key in keys:
        order = np.argsort(key, kind="stable")
        low, high = (np.searchsorted(key[order], key[asked], side=s) for s in ("left", "right"))
        done = np.append(0, np.cumsum(high - low))
        a = 0
        while a < len(asked):
            b = max(a + 1, int(np.searchsorted(done, done[a] + most, side="right")) - 1)
            n = high[a:b] - low[a:b]
            p = np.repeat(asked[a:b], n)
            q = order[np.arange(n.sum()) - np.repeat(done[a:b] - done[a], n) + np.repeat(low[a:b], n)]
            hit = np.bitwise_count(bits[p] ^ bits[q]) <= radius
            found.append(p[hit] * len(fps) + q[hit])
            a = b
    p, q = np.divmod(np.unique(np.concatenate(found)), len(fps))
    return np.append(0, np.cumsum(np.bincount(p, minlength=len(fps)))).tolist(), q.tolist()


def ngram_counts(stream: DataFrame, text: str, most: int = 5) -> DataFrame:
    """gram, freq, kept up to date; feeds ``new_words.from_counts``."""
    return stream.select(F.explode(ngrams(text, most)).alias("gram")).groupBy("gram").agg(F.count("*").alias("freq"))


def windowed_counts(stream: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    """window, by, n; rows later than ``late`` no longer count."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))


def recurring(df: DataFrame, start: str, end: str, every: str, out: str = "at") -> DataFrame:
    """A row for each time of a period from ``start`` to ``end`` (timestamps)."""
    return df.withColumn(out, F.explode(F.expr(f"sequence(`{start}`, `{end}`, interval {every})")))
