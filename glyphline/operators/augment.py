"""Augmented texts: at most ``n`` different ones for a text, none equal to it, the same for a row and seed always.

Also the next idiom of a chain. Random numbers come from hashes of (text, seed, attempt).
"""

from __future__ import annotations

import math
import random
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())


def _several(text: str, n: int, seed: int, once, attempts: int) -> list:
    out = []
    rng = random.Random(0)
    for k in range(attempts):
        rng.seed(f"{seed}:{k}:{text}")
        new = once(rng)
        if new != text and new not in out:
            out.append(new)
        if len(out) == n:
            break
    return out


def _places(text: str) -> list[tuple[int, int, int]]:
    """Each Han character's place and the ends of its run."""
    return [(i, a, b) for a, b in (run.span() for run in re.finditer("[一-龥]+", text)) for i in range(a, b)]


def swapped(text: str, rng: random.Random, ratio: float, scale: float, places: list[tuple[int, int, int]] | None = None) -> str:
    """Han characters trade places with another of their run, near by a normal law."""
    chars = None
    draw = rng.random
    for i, a, b in _places(text) if places is None else places:
        if draw() < ratio:
            j = i + (round(rng.gauss(0, scale)) or rng.choice((-1, 1)))
            if a <= j < b:
                chars = chars or list(text)
                chars[i], chars[j] = chars[j], chars[i]
    return "".join(chars) if chars else text


def noised(text: str, rng: random.Random, add: float, delete: float, letters: list[tuple[str, float]]) -> str:
    """Characters come in (drawn by weight) or go."""
    out = []
    names, weights = [c for c, _ in letters], [w for _, w in letters]
    for c in text:
        if rng.random() >= delete:
            out.append(c)
        if rng.random() < add:
            out.append(rng.choices(names, weights)[0])
    return "".join(out)


def _udf(col: Column | str, kind: T.DataType, fn) -> Column:
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else fn(t) for t in s], dtype=object)

    return run(F.col(col) if isinstance(col, str) else col)


def swap_positions(col: Column | str, n: int = 3, ratio: float = 0.02, seed: int = 1, scale: float = 1.0) -> Column:
    def several(t: str) -> list:
        places = _places(t)
        return _several(t, n, seed, lambda r: swapped(t, r, ratio, scale, places), min(int(n / ratio), max(1, len(t))))

    return _udf(col, STRINGS, several)


def add_and_delete(col: Column | str, letters: dict[str, int], n: int = 3, add: float = 0.02, delete: float = 0.02, seed: int = 1) -> Column:
    """``letters``: counts of characters to insert, smoothed to exp(log10 count)."""
    table = [(c, math.exp(math.log10(k))) for c, k in sorted(letters.items()) if k > 0] or [(" ", 1.0)]
    return _udf(col, STRINGS, lambda t: _several(t, n, seed, lambda r: noised(t, r, add, delete, table), min(int(n / max(add + delete, 1e-9)), max(1, len(t)))))


def homophones(tokens: Column | str, sounds: dict[str, list[str]], n: int = 3, ratio: float = 0.02, seed: int = 1) -> Column:
    """Words of a sentence replaced by others of the same sound; ``sounds``: word to its homophones."""

    def once(ts: list[str], rng: random.Random) -> str:
        return "".join(rng.choice(sounds[w]) if sounds.get(w) and rng.random() < ratio else w for w in ts)

    return _udf(tokens, STRINGS, lambda ts: _several("".join(ts), n, seed, lambda r: once(list(ts), r), min(int(n / ratio), max(1, len("".join(ts))))))


REPLACED = T.ArrayType(T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("entities", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("type", T.StringType())]))),
]))


def replaced(text: str, entities: list[dict], names: dict[str, list[str]], rng: random.Random, ratio: float) -> tuple[str, tuple]:
    out, spans, at = [], [], 0
    size = 0
    for e in sorted(entities, key=lambda e: e["start"]):
        if e["start"] < at:
            continue
        known = names.get(e["type"]) or []
        new = rng.choice(known) if known and rng.random() < ratio else e["text"]
        gap = text[at : e["start"]]
        out += [gap, new]
        size += len(gap)
        spans.append((new, size, size + len(new), e["type"]))
        size, at = size + len(new), e["end"]
    return "".join([*out, text[at:]]), tuple(spans)


def replace_entities(text: Column | str, entities: Column | str, names: dict[str, list[str]], n: int = 3, ratio: float = 0.1, seed: int = 1) -> Column:
    """array<struct<text,entities>>: entities replaced by others of their type, offsets moved along."""

    @F.pandas_udf(REPLACED)
    def run(ts: pd.Series, es: pd.Series) -> pd.Series:
        rows = []
        for t, e in zip(ts, es, strict=True):
            if t is None or e is None:
                rows.append(None)
                continue
            got: dict[str, tuple] = {}
            for k in range(max(1, int(n / ratio))):
                new, spans = replaced(t, list(e), names, random.Random(f"{seed}:{k}:{t}"), ratio)
                if new != t:
                    got.setdefault(new, spans)
                if len(got) == n:
                    break
            rows.append([{"text": x, "entities": [dict(zip(("text", "start", "end", "type"), s, strict=True)) for s in spans]} for x, spans in got.items()])
        return pd.Series(rows, dtype=object)

    c = lambda x: F.col(x) if isinstance(x, str) else x
    return run(c(text), c(entities))


def next_idioms(current: DataFrame, idioms: DataFrame, used: DataFrame | None = None, seed: int = 0, sound: str | None = None) -> DataFrame:
    """id, idiom, next: an idiom that begins as the last one ends, drawn by frequency, not used before.

    ``current``: id, idiom; ``idioms``: idiom, freq (and, for ``sound``, its columns
    first_<sound> and last_<sound>). Draws are exponential races of hashes, so one
    aggregation picks the winner and no group is collected.
    """
    key = lambda side, c: F.col(f"{side}_{sound}") if sound else (F.substring(c, 1, 1) if side == "first" else F.expr(f"right({c}, 1)"))
    pool = idioms.select(F.col("idiom").alias("next"), "freq", key("first", "idiom").alias("k"))
    if used is not None:
        pool = pool.join(used.select(F.col("idiom").alias("next")), "next", "left_anti")
    ends = idioms.select("idiom", key("last", "idiom").alias("k")) if sound else None
    asked = current.join(ends, "idiom", "left") if sound else current.withColumn("k", key("last", "idiom"))
    unit = (F.pmod(F.xxhash64(F.lit(seed), "id", "next"), F.lit(1 << 30)) + 1) / F.lit(float(1 << 30))
    race = F.struct((-F.log(unit) / F.greatest(F.col("freq"), F.lit(1))).alias("t"), F.col("next"))
    won = asked.join(pool, "k").where(F.col("next") != F.col("idiom")).groupBy("id").agg(F.min(race)["next"].alias("next"))
    return current.select("id", "idiom").join(won, "id", "left")


def numbered(df: DataFrame, by: str, order: str) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(order)))
