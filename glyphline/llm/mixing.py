"""Mixing sources to target weights by entropy balancing.

Each row d of source s gets a rate r_d in (0, cap): the rates closest to one in
relative entropy whose tokens meet the source's target. The convex dual has one
multiplier per source, and its solution tilts exponentially,
``r_d = min(cap, exp(lambda_s * size_d / mean_s))``. The multipliers are found by
Newton steps, safeguarded by a bracket; every step is one distributed
aggregation over the table (source, size, number of rows), which is all the dual
needs. Sums are of integers, so they don't depend on the order of rows and
reruns agree to the bit.

Rates become whole copies by class, the rows of one source and size, which share a rate: the floor for each row,
and one more for some of them. How many is fixed by systematic rounding of the
remainders summed over the classes from the largest size down, which stays below the target by less than
the largest text; the gap is filled with the largest texts that fit, ``fills`` times. Which rows of a class take
the further copy is told by a hash of id and text. No source is ever sorted: classes of many rows are cut into
bins of the hash, and hashes of many (equal) rows into parts.

Sources are few (names of collections); a table of their totals is held on the
driver, bounded by ``max_sources``, beyond which an error is raised.

Null text has size 0 and takes nothing, like a text with no words. A null source
is a source of its own, last in order. Repeated rows are mixed one by one; of equal rows it isn't defined which
takes more, but how many do. Null and equal ids are rows like others. Very long texts are counted whole. An empty
table gives no rows. Only the id, text, source and ``keep`` columns are read; ``keep`` must not name an output.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphline.llm.common import WORD, cut, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
SCALE = 1_000_000
#: Share of all rows from which a class, or a hash in it, is cut into pieces.
HOT = 4096


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0) -> dict[str | None, float]:
    """Target tokens of each source: all tokens shared by weight, no source above ``cap`` times its size.

    Sources in the order of code points, null last; weights repeat. The excess of
    capped sources is shared again by weight among the others until none is above.
    """
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    out: dict[str | None, float] = {}
    left, free = float(sum(sizes.values())), list(names)
    while free:
        total = math.fsum(weight[n] for n in free)
        over = [n for n in free if left * weight[n] / total > cap * sizes[n]]
        if not over:
            return out | {n: left * weight[n] / total for n in free}
        for n in over:
            out[n] = float(cap * sizes[n])
        left -= math.fsum(out[n] for n in over)
        free = [n for n in free if n not in out]
    return out


def solve(table: DataFrame, source: dict[str | None, tuple[int, int, float]], cap: float, steps: int = 60, tol: float = 1e-6) -> dict[str | None, float]:
    """Multiplier of each source; ``table``: source, size, n. ``source``: tokens, rows with tokens, target."""
    spark = table.sparkSession
    lam = {s: math.log(min(max(t / b, 1e-9), cap)) for s, (b, n, t) in source.items() if b and t > 0}
    low, high = dict.fromkeys(lam, -math.inf), dict.fromkeys(lam, math.inf)
    for s, (b, _, t) in source.items():
        if s in lam and t >= cap * b * (1 - 1e-12):
            lam[s] = math.inf
    todo = {s for s in lam if lam[s] < math.inf}
    for _ in range(steps):
        if not todo:
            break
        now = spark.createDataFrame([(s, lam[s], source[s][0] / source[s][1]) for s in sorted(todo, key=str)], "source string, lam double, mean double")
        z = F.col("size") / F.col("mean")
        # the exponent is cut where the cap holds anyway, so exp stays finite
        tilt = F.exp(F.least(F.col("lam") * z, F.lit(math.log(cap))))
        words = (F.round(tilt * SCALE) * F.col("size")).cast("decimal(28,0)") * F.col("n")
        bent = F.when(F.col("lam") * z < math.log(cap), F.round(tilt * z * SCALE) * F.col("size")).otherwise(0).cast("decimal(28,0)") * F.col("n")
        got = (
            table.join(F.broadcast(now), table["source"].eqNullSafe(now["source"]))
            .groupBy(now["source"])
            .agg(F.sum(words).alias("w"), F.sum(bent).alias("h"))
            .collect()
        )
        for r in got:
            s, w, h = r["source"], float(r["w"]) / SCALE, float(r["h"]) / SCALE
            gap = w - source[s][2]
            if abs(gap) <= tol * source[s][2] or high[s] - low[s] < 1e-9:
                todo.discard(s)
                continue
            if gap > 0:
                high[s] = lam[s]
            else:
                low[s] = lam[s]
            step = lam[s] - gap / h if h > 0 else math.nan
            if not low[s] < step < high[s]:
                if math.isinf(low[s]):
                    step = min(2 * lam[s], lam[s] - 1.0)
                elif math.isinf(high[s]):
                    step = max(2 * lam[s], lam[s] + 1.0)
                else:
                    step = (low[s] + high[s]) / 2
            lam[s] = step
    return lam


def _classes(table: DataFrame, by_source: DataFrame, cap: int) -> DataFrame:
    """s, size, n, rate, whole (copies of every row), more (further copies, one a row) of each class of ``table``."""
    rate = F.round(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(math.log(cap)))), 6)
    rate = F.least(F.coalesce(rate, F.lit(0.0)), F.lit(float(cap)))
    known = table.join(F.broadcast(by_source), "s").select("s", "size", "n", rate.alias("rate"), F.floor(rate).cast("int").alias("whole"))
    part = F.round((F.col("rate") - F.col("whole")) * SCALE).cast("bigint") * F.col("n")
    # a row a distinct size: far fewer than rows, whatever the source holds
    down = Window.partitionBy("s").orderBy(F.col("size").desc())
    known = known.withColumn("part", part).withColumn("upto", F.sum(part).over(down))
    more = F.floor(F.col("upto") / SCALE) - F.floor((F.col("upto") - F.col("part")) / SCALE)
    return known.select("s", "size", "n", "rate", "whole", more.cast("bigint").alias("more"))


def _topped(classes: DataFrame, target: dict[int, float], cap: int, fills: int) -> DataFrame:
    """``classes`` with further copies of the largest texts that fit into what a source still lacks."""
    spark = classes.sparkSession
    size, n, copies = F.col("size"), F.col("n"), F.col("n") * F.col("whole") + F.col("more")
    have = {r["s"]: r["t"] for r in classes.groupBy("s").agg(F.sum(copies * size).alias("t")).collect()}
    gap = {s: target[s] - t for s, t in have.items()}
    added: dict[tuple[int, int], int] = {}
    schema = "s int, size long, extra long"
    for _ in range(fills):
        extra = spark.createDataFrame([(s, z, k) for (s, z), k in added.items()], schema)
        room = spark.createDataFrame([(s, g) for s, g in gap.items() if g >= 1], "s int, gap double")
        left = cap * n - copies - F.coalesce("extra", F.lit(0))
        fits = classes.join(F.broadcast(room), "s").join(F.broadcast(extra), ["s", "size"], "left").withColumn("left", left)
        found = fits.where((F.col("left") > 0) & (size <= F.col("gap"))).groupBy("s").agg(F.max(F.struct("size", "left")).alias("x")).collect()
        if not found:
            break
        for r in found:
            s, z = r["s"], r["x"]["size"]
            k = min(r["x"]["left"], int(gap[s] // z))
            added[s, z] = added.get((s, z), 0) + k
            gap[s] -= k * z
    extra = spark.createDataFrame([(s, z, k) for (s, z), k in added.items()], schema)
    return classes.join(F.broadcast(extra), ["s", "size"], "left").withColumn("more", F.col("more") + F.coalesce("extra", F.lit(0))).drop("extra")


def _celled(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """``rows`` with bin and part, which cut classes and hashes of more than ``1 / HOT`` of all rows into even pieces."""
    pieces = F.ceil(F.col("n") * HOT / total).cast("int")
    hot = classes.where(F.col("n") * HOT > total).select("s", "size", pieces.alias("bins"))  # fewer than HOT
    rows = rows.join(F.broadcast(hot), ["s", "size"], "left")
    alike = rows.where("bins IS NOT NULL").groupBy("s", "size", "salt").agg(F.count("*").alias("n")).where(F.col("n") * HOT > total)
    alike = cut(alike.select("s", "size", "salt", pieces.alias("parts")))  # fewer than HOT
    rows = rows.join(F.broadcast(alike), ["s", "size", "salt"], "left")
    unit = F.shiftrightunsigned("salt", 11) / F.lit(float(1 << 53))
    # equal rows come after the others of their class
    own = F.coalesce(F.floor(unit * F.col("bins")), F.lit(0)).cast("bigint")
    return rows.withColumn("bin", F.when(F.col("parts").isNull(), own).otherwise(F.col("bins") + F.shiftrightunsigned("salt", 1))).withColumn(
        "part", F.coalesce(F.pmod("place", "parts"), F.lit(0)).cast("int")
    )


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = 3, fills: int = 6, max_sources: int = 1_000_000,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken (and ``keep``) for every row of ``docs``."""
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("bigint").alias("size"),
            F.xxhash64(F.lit("mix"), F.col(id_col), text).alias("salt"),
            F.xxhash64(F.monotonically_increasing_id()).alias("place"),  # fixed by the cut
            *keep,
        )
    )
    table = cut(rows.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")))
    names = rows.groupBy("source").agg(F.sum("size").alias("b"), F.count_if(F.col("size") > 0).alias("n"), F.count("*").alias("rows")).limit(max_sources + 1).collect()
    if len(names) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    aim = targets({r["source"]: r["b"] for r in names}, weights, cap)
    facts = {r["source"]: (r["b"], r["n"], aim[r["source"]]) for r in names}
    lam = solve(table, facts, cap)
    number = {s: i for i, s in enumerate(facts)}
    by_source = spark.createDataFrame(
        [(number[s], s, b, float(t), b / n if n else 1.0, min(lam[s], 1e9) if s in lam else None) for s, (b, n, t) in facts.items()],
        "s int, name string, source_size long, target double, mean double, lam double",
    )
    names_only = F.broadcast(by_source.select("s", "name", "source_size", "target"))
    table = table.join(F.broadcast(by_source.select("s", "name")), F.col("source").eqNullSafe(F.col("name"))).select("s", "size", "n")
    classes = cut(_topped(cut(_classes(table, by_source, cap)), {number[s]: t for s, (_, _, t) in facts.items()}, cap, fills))
    rows = rows.join(names_only, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    sized = _celled(rows.where("size > 0"), classes, sum(r["rows"] for r in names))
    cells = sized.groupBy("s", "size", "bin", "part").agg(F.count("*").alias("in_cell"))
    before = Window.partitionBy("s", "size").orderBy("bin", "part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("in_cell").over(before), F.lit(0))).join(classes, ["s", "size"])
    nth = F.row_number().over(Window.partitionBy("s", "size", "bin", "part").orderBy("salt", "doc_id")) + F.col("before")
    sized = sized.join(cells, ["s", "size", "bin", "part"]).withColumn("nth", nth)
    copies = F.col("whole") + F.floor(F.col("more") / F.col("n")) + (F.col("nth") <= F.col("more") % F.col("n")).cast("int")
    out = ["doc_id", "source", "size", "source_size", "target"]
    taking = sized.withColumn("copies", copies.cast("int")).select(*out, "rate", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"), *keep)
    none = rows.where("size = 0").select(*out, F.lit(0.0).alias("rate"), F.lit(0).alias("copies"), F.lit(0).cast("bigint").alias("taken"), *keep)
    return taking.unionByName(none)


def mix_report(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")
