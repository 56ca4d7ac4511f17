"""SimHash of weighted words, and search among stored fingerprints.

Six blocks of 10 or 11 bits: fingerprints at distance 3 or less agree in three of
them at least, so the 20 triples of blocks are keys of 32 bits, and a key's rows
are few unless texts are alike. Equal fingerprints are grouped before, so groups of copies make no pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphline.functions.text import hamming

CUTS = (0, 11, 22, 33, 44, 54, 64)


def _packed(hashes: pa.Array, weights: pa.Array) -> pa.Array:
    """Fingerprints of lists of hashes with lists of weights, which must have no nulls."""
    ends = np.asarray(pc.list_value_length(hashes).fill_null(0)).cumsum()
    h, w = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64), weights.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros(len(ends), np.uint64)
    starts = np.append(0, ends[:-1])
    full = np.flatnonzero(ends > starts)
    if len(full):
        whole = np.add.reduceat(w, starts[full])
        for b in range(64):  # set if the weights that have the bit are more than half
            have = np.add.reduceat(np.where((h >> np.uint64(b)) & np.uint64(1), w, 0.0), starts[full])
            out[full] |= np.where(2 * have > whole, np.uint64(1 << b), np.uint64(0))
    return pa.array(out.view(np.int64))


def _hashed(words: list[str]) -> np.ndarray:
    """As Spark's xxhash64, unsigned."""
    return np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64)


def _of_weights(weights: pa.Array) -> pa.Array:
    ends = np.append(0, np.asarray(pc.list_value_length(weights).fill_null(0)).cumsum()).astype(np.int32)
    flat = weights.flatten()
    coded = flat.field("word").dictionary_encode()
    hashes = _hashed(coded.dictionary.to_pylist())[np.asarray(coded.indices)].view(np.int64)
    made = _packed(pa.ListArray.from_arrays(ends, pa.array(hashes)), pa.ListArray.from_arrays(ends, flat.field("weight").cast(pa.float64())))
    return pc.if_else(weights.is_null(), None, made)


def simhash(weights: Column | str) -> Column:
    """bigint fingerprint of array<struct<word,weight>>: bit b is set if the words that have it outweigh the others.

    Words are hashed and bits summed for whole Arrow batches; null for null, 0 for no words.
    """
    return F.arrow_udf(_of_weights, "bigint")(F.col(weights) if isinstance(weights, str) else weights)


def _ranked(tokens: pa.Array, most: int) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Offsets of lists, the words, and for each list's entries the word (by number) and its count: most frequent first, ties by word."""
    size = np.asarray(pc.list_value_length(tokens).fill_null(0))
    coded = tokens.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    wide = max(1, len(words))
    pairs, n = np.unique(np.repeat(np.arange(len(size)), size) * wide + np.asarray(coded.indices), return_counts=True)
    row, word = pairs // wide, pairs % wide
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=lambda i: words[i].encode())] = np.arange(len(words))
    order = np.lexsort((rank[word], -n, row))
    row, word, n = row[order], word[order], n[order]
    each = np.bincount(row, minlength=len(size))
    nth = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    row, word, n = row[nth < most], word[nth < most], n[nth < most]
    return np.append(0, np.cumsum(np.bincount(row, minlength=len(size)))).astype(np.int32), words, word, n


def _top_words(most: int):
    def run(tokens: pa.Array) -> pa.Array:
        ends, words, word, n = _ranked(tokens, most)
        pairs = pa.StructArray.from_arrays([pa.array(words, pa.string()).take(pa.array(word)), pa.array(n.astype(np.float64))], ["word", "weight"])
        return pa.ListArray.from_arrays(ends, pairs)

    return run


def top_words(tokens: Column | str, most: int = 500) -> Column:
    """array<struct<word,weight>>: the ``most`` most frequent words of a text with their counts, ties by word; tokens must have no nulls."""
    return F.arrow_udf(_top_words(most), "array<struct<word:string,weight:double>>")(F.col(tokens) if isinstance(tokens, str) else tokens)


def _of_tokens(most: int):
    def run(tokens: pa.Array) -> pa.Array:
        ends, words, word, n = _ranked(tokens, most)
        hashes = _hashed(words)[word].view(np.int64)
        return _packed(pa.ListArray.from_arrays(ends, pa.array(hashes)), pa.ListArray.from_arrays(ends, pa.array(n.astype(np.float64))))

    return run


def simhash_of_tokens(tokens: Column | str, most: int = 500) -> Column:
    """``simhash(top_words(tokens, most))`` in one step; tokens must have no nulls."""
    return F.arrow_udf(_of_tokens(most), "bigint")(F.col(tokens) if isinstance(tokens, str) else tokens)


def block(fp: Column | str, k: int) -> Column:
    """Block ``k`` of a fingerprint."""
    c = F.col(fp) if isinstance(fp, str) else fp
    return F.shiftrightunsigned(c, CUTS[k]).bitwiseAND(F.lit((1 << CUTS[k + 1] - CUTS[k]) - 1))


def keys(fp: Column | str) -> Column:
    """The 20 keys of a fingerprint: array<bigint>."""
    out = []
    for n, (a, b, c) in enumerate(combinations(range(6), 3)):
        out.append(((((F.lit(n).cast("bigint") * 2048 + block(fp, a)) * 2048) + block(fp, b)) * 2048) + block(fp, c))
    return F.array(*out)


def search(queries: DataFrame, store: DataFrame, radius: int = 3) -> DataFrame:
    """id, match: for each query the least stored id within ``radius`` bits, not itself; null if none. Both: id, fp.

    Both are read several times, so what makes the fingerprints should be cut before.
    """
    if not 0 <= radius <= 3:
        raise ValueError("keys are made for up to 3 differing bits")
    # the two least ids of a fingerprint: one of them isn't the query itself. Each task keeps two a fingerprint before the shuffle
    nth = F.dense_rank().over(Window.partitionBy("fp").orderBy("id"))
    groups = store.select("id", "fp").withColumn("nth", nth).where("nth <= 2").groupBy("fp").agg(F.min("id").alias("m1"), F.max("id").alias("m2"))
    distinct = queries.select(F.col("fp").alias("q")).distinct().select("q", F.explode(keys("q")).alias("key"))
    kept = groups.select("fp", F.explode(keys("fp")).alias("key"))
    hits = distinct.join(kept, "key").where(hamming("q", "fp") <= radius).select("q", "fp").distinct()
    own = F.col("fp") == F.col("q")
    # one row a queried fingerprint, so that copies of a query meet no copies of its matches
    best = hits.join(groups, "fp").groupBy("q").agg(
        F.min(F.when(~own, F.col("m1"))).alias("other"), F.min(F.when(own, F.col("m1"))).alias("first"), F.min(F.when(own, F.col("m2"))).alias("second")
    )
    asked = queries.select("id", F.col("fp").alias("q")).join(best, "q", "left")
    same = F.when(F.col("first") != F.col("id"), F.col("first")).when(F.col("second") != F.col("id"), F.col("second"))
    return asked.select("id", F.least("other", same).alias("match"))
