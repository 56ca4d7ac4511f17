"""Document fingerprints by Order MinHash, in Catalyst expressions only.

The k-mers are runs of five words; every k-mer carries its occurrence number (the
second "a b c d e" of a text differs from the first). One permutation, a 64-bit
hash of k-mer and number, deals them to ``SLOTS`` slots by its top bits. For each used
slot the two smallest from its beginning on are selected (a slot with one k-mer takes its
second from the next, the last from the first, so that short texts keep their order too), put in the order of the text, and the
ordered pair is hashed to 16 bits: a text with the same k-mers in another order
gets other pairs, so likeness falls with the edit distance and not only with the
set of words. (One permutation stands for one a slot, which would take
``SLOTS`` hashes of every k-mer.) Likeness is the share of equal slots among
those used by either text; two texts without words are alike.

Within a row everything is linear but for primitive sorts: 34 bits of hash and 30
bits of position share a long. Texts shorter than five words have one k-mer.

Neighbours: rows are dealt to as many ranges of (doc_id, hash of the text) as there are shuffle partitions, whose
edges are keys of sampled rows (``EDGE_SAMPLES`` a range); the row at an edge visits the range before it as well, so
no window spans more than a range. The whole text moves once. Null or equal ids are split by the texts' hashes;
only rows equal in id and text share a range, whatever their number.

Null text counts as empty; ids equal in value are ordered by the hash of the text;
null ids come first. Very long texts are hashed whole. Repeated rows come out each. Only doc_id and text are read, whatever
further columns are called. Empty table: no rows. One row: its next is itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphline.llm.common import fenced, shuffle_partitions, text_or_empty
from glyphline.llm.quality import let

K, SLOT_BITS, PICK_BITS, POS_BITS = 5, 6, 16, 30
LOW = (1 << POS_BITS) - 1
#: Sampled rows for each range, of which every so manieth is an edge.
EDGE_SAMPLES = 32


def _numbered(hashes: Column) -> Column:
    """The hashes of k-mers with their occurrence numbers, packed with positions; for texts in which one repeats."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["h"] != F.get(s, F.greatest(i - 1, F.lit(0)))["h"]))

        def numbers(st: Column) -> Column:
            each = F.transform(st, lambda p, j: F.sequence(F.lit(0), F.coalesce(F.get(st, j + 1), F.size(s)) - p - 1))
            return F.flatten(each)

        def element(x: Column, o: Column) -> Column:
            return F.when(o == 0, x["h"]).otherwise(F.xxhash64(x["h"], o)).bitwiseAND(F.lit(~LOW)).bitwiseOR(x["i"].cast("bigint"))

        return F.zip_with(s, let(starts, numbers), element)

    return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), runs)


def add_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the array of slot codes ``out`` (int: slot, then 16 bits) of column ``text``."""
    own = [F.col(f"`{c}`") for c in df.columns if c != out]
    spaced = F.filter(F.split(text_or_empty(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    df = df.select(*own, F.transform(spaced, lambda w: F.xxhash64(w)).alias("_w"))
    n = F.size("_w")
    whole = F.when(n > 0, F.array(F.xxhash64("_w"))).otherwise(F.array().cast("array<bigint>"))
    kmer = lambda i: F.xxhash64(*[F.get("_w", i + k if k else i) for k in range(K)])
    df = df.select(*own, F.when(n >= K, F.transform(F.sequence(F.lit(0), n - K), kmer)).otherwise(whole).alias("_k"))
    packed = F.transform("_k", lambda h, i: h.bitwiseAND(F.lit(~LOW)).bitwiseOR(i.cast("bigint")))
    df = df.select(*own, F.when(F.size(F.array_distinct("_k")) == F.size("_k"), packed).otherwise(_numbered(F.col("_k"))).alias("_e"))
    df = df.select(*own, F.sort_array("_e").alias("_s"))
    slot = lambda x: F.shiftrightunsigned(x, 64 - SLOT_BITS)
    first = lambda x, i: (i == 0) | (slot(x) != slot(F.get("_s", F.greatest(i - 1, F.lit(0)))))
    firsts = F.filter(F.transform("_s", lambda x, i: F.when(first(x, i), i)), lambda i: i.isNotNull())
    df = df.select(*own, "_s", firsts.alias("_f"))
    high = lambda x: F.shiftright(x, POS_BITS)
    place = lambda x: x.bitwiseAND(F.lit(LOW))

    def code(i: Column) -> Column:
        a, b = F.get("_s", i), F.get("_s", (i + 1) % F.size("_s"))
        pair = (
            F.when(F.size("_s") == 1, F.xxhash64(high(a)))
            .when(place(a) <= place(b), F.xxhash64(high(a), high(b)))
            .otherwise(F.xxhash64(high(b), high(a)))
        )
        return (slot(a) * (1 << PICK_BITS) + F.shiftrightunsigned(pair, 64 - PICK_BITS)).cast("int")

    return df.select(*own, fenced(F.transform("_f", code)).alias(out))


def likeness(a: str, b: str) -> Column:
    """Share of equal slots among those used by either, 0 to 1."""
    same = F.size(F.array_intersect(a, b))
    slots = lambda c: F.transform(c, lambda x: F.shiftright(x, PICK_BITS))
    used = F.size(F.array_union(slots(a), slots(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(same / used).cast("double")


def as_text(codes: str) -> Column:
    """Six hex digits a used slot; empty for a text without words."""
    return F.array_join(F.transform(codes, lambda x: F.lower(F.lpad(F.hex(x), 6, "0"))), "")


def _ranged(rows: DataFrame, ranges: int) -> DataFrame:
    """``rows`` (doc_id, text, tie, key) with range, guest; the first row of a range also as guest of the range before it.

    ``key`` sorts as (doc_id, tie) does. The edges are held in one row, in pieces of about their
    square root, of which a row is compared with the first edges and those of one piece.
    """
    spark = rows.sparkSession
    known = rows.agg(F.count("*").alias("n"), F.min("key").alias("least")).first()
    if not known["n"]:
        return rows.select("*", F.lit(0).alias("range"), F.lit(0).alias("guest"))
    picked = sorted(r["key"] for r in rows.select("key").sample(min(1.0, EDGE_SAMPLES * ranges / known["n"]), seed=11).collect())
    step = max(1, -(-len(picked) // ranges))
    edges = sorted({known["least"], *picked[step::step]})  # ``ranges`` at most
    wide = max(1, int(len(edges) ** 0.5))
    fine = [edges[i : i + wide] for i in range(0, len(edges), wide)]
    table = spark.createDataFrame([(fine, [f[0] for f in fine[1:]])], "fine array<array<string>>, coarse array<string>")
    upto = lambda array: F.size(F.filter(array, lambda e: e <= F.col("key")))
    rows = rows.join(F.broadcast(table))  # a single row
    rows = rows.withColumn("piece", upto("coarse")).withColumn("own", F.get("fine", F.col("piece")))
    rows = rows.withColumn("range", (F.col("piece") * wide + upto("own") - 1).cast("int"))
    here = F.struct(F.col("range").alias("range"), F.lit(0).alias("guest"))
    # the last row is followed by the first
    there = F.struct(F.when(F.col("range") == 0, F.lit(len(edges) - 1)).otherwise(F.col("range") - 1).alias("range"), F.lit(1).alias("guest"))
    seats = F.when(F.array_contains("own", F.col("key")), F.array(here, there)).otherwise(F.array(here))
    return rows.select("doc_id", "text", "key", F.explode(seats).alias("seat")).select("doc_id", "text", "key", "seat.*")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    digits = lambda x: F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")  # noqa: E731  sorts as the signed number does
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.withColumn("key", F.concat(F.when(F.col("doc_id").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), digits(F.col("doc_id")))), digits(F.col("tie"))))
    ranges = shuffle_partitions(docs.sparkSession)
    rows = _ranged(rows, ranges).repartitionById(ranges, "range")
    order = Window.partitionBy("range").orderBy("guest", "key")
    half = F.floor(F.length("text") / 2).cast("int")
    df = rows.withColumn("next", F.lead("text").over(order)).select(
        "doc_id", "key", "range", "guest", "text",
        F.length("text").cast("bigint").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half)).alias("edited"),
    )
    df = add_fingerprint(add_fingerprint(df, "text", "own"), "edited", "changed")
    df = df.withColumn("following", F.lead("own").over(order)).where("guest = 0")
    return df.select(
        "doc_id", "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text("own").alias("fingerprint"),
        as_text("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"),
        likeness("own", "following").alias("near_next"),
    )
