"""Weighted SimHash against its definition and search against all pairs."""

from __future__ import annotations

import random
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from glyphline.operators import similar


def fingerprint(tokens, most=500):
    top = sorted(Counter(tokens).items(), key=lambda x: (-x[1], x[0].encode()))[:most]
    hashes = [(xxhash.xxh64_intdigest(w, 42), n) for w, n in top]
    out = sum(1 << b for b in range(64) if sum(n if h >> b & 1 else -n for h, n in hashes) > 0)
    return out - (1 << 64) if out >> 63 else out


def texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(3000)]
    made = [[rng.choice(words) for _ in range(rng.choice([0, 1, 5, 80, 1500]))] for _ in range(40)]  # some with over 500 distinct words
    made += [[*t, "extra"] for t in made if t] + made[:5]
    return [(i, t) for i, t in enumerate(made)]


def test_fingerprints_are_those_of_the_definition(spark):
    rows = texts(1)
    df = spark.createDataFrame(rows, "id long, tokens array<string>").repartition(3)
    want = {i: fingerprint(t) for i, t in rows}
    for made in (df.select("id", similar.simhash_of_tokens("tokens").alias("fp")), df.select("id", similar.top_words("tokens").alias("w")).select("id", similar.simhash("w").alias("fp"))):
        assert {r["id"]: r["fp"] for r in made.collect()} == want


def test_search_finds_the_least_near_id(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    base[5] = base[4]
    points = [base[0]] * 40 + [b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(5))) for b in base for _ in range(3)] + base[:9]
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(points)]
    store = spark.createDataFrame(signed, "id long, fp long")
    got = {r["id"]: r["match"] for r in similar.search(store.where(F.col("id") % 2 == 0), store).collect()}
    for i in range(0, len(points), 2):
        assert got[i] == min((j for j in range(len(points)) if j != i and (points[i] ^ points[j]).bit_count() <= 3), default=None)
