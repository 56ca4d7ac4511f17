"""Streams in shards, rows dealt to all cores, work bounded by rows."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glyphline.functions import patterns, tags, text, times
from glyphline.operators import augment, batching, phrases
from glyphline.plans import queries as plans
from glyphline.streaming import dedup


def test_near_copies_in_shards(spark, tmp_path):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), k)) for k in range(5) for f in fps]
    rows = [(i, f - (1 << 64) if f >> 63 else f, datetime(2024, 1, 1) + timedelta(minutes=10 * i)) for i, f in enumerate(fps)] + [(999, None, datetime(2024, 1, 1))]
    schema = "id long, fp long, at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    found = dedup.near_copies(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "id", "fp", "at", 1.0, shards=4)
    run = found.writeStream.format("memory").queryName("near_in_shards").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r["id"]: r["m"] for r in spark.table("near_in_shards").groupBy("id").agg(F.min("match").alias("m")).collect()}
    want: dict[int, int] = {}
    first: dict[int, tuple[int, int]] = {}
    for i, f in enumerate(fps):  # 144 rows are a day
        near = [a for g, (a, b) in first.items() if (f ^ g).bit_count() <= 3 and b >= i - 144]
        if near:
            want[i] = min(near)
        first[f] = (first[f][0] if f in first and first[f][1] >= i - 144 else i, i)
    assert got == want and len(want) > 100
    assert sum(p["numRowsTotal"] for p in run.lastProgress["stateOperators"]) <= 16


def test_near_fingerprints_in_parts():
    rng = np.random.default_rng(1)
    fps = rng.integers(-(2**63), 2**63 - 1, 60)
    for _ in range(2):
        fps = np.concatenate([fps, fps ^ (np.int64(1) << rng.integers(0, 63, len(fps)))])
    fps = np.unique(fps)
    bits = fps.view(np.uint64)
    for block in range(4):
        alike = (np.bitwise_count(bits[:, None] ^ bits) <= 3) & ((bits[:, None] ^ bits) >> np.uint64(16 * block) & np.uint64(0xFFFF) == 0)
        for most in (1 << 20, 50):
            ends, near = dedup._near(fps, np.arange(len(fps)), block, 3, most)
            assert [near[a:b] for a, b in zip(ends, ends[1:])] == [np.flatnonzero(x).tolist() for x in alike]


def test_masked_names_keep_their_numbers(spark):
    rows = spark.createDataFrame([("加QQ：1000001，微信:wx_100000abc，a1234567",), ("1234567",)], "t string")
    got = [tuple(r) for r in rows.select(text.replace_qq("t", words=True), text.replace_qq("t")).collect()]
    assert got == [("加QQ：<qq>，微信:wx_100000abc，a1234567", "加QQ：<qq>，微信:wx_<qq>abc，a<qq>"), ("1234567", "1234567")]


def test_contacts_of_large_keys_as_their_sql(spark, tmp_path):
    keys = [1, 99_999, 100_000, 123_456, 899_999, 900_001, 5_399_999]
    folder = str(tmp_path)
    pd.DataFrame({"c_custkey": keys, "c_nationkey": np.array([k % 25 for k in keys], np.int32)}).to_parquet(f"{folder}/customer.parquet")
    for name in ("contact_masked", "contact_extracts", "contact_removed"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW customer AS SELECT * FROM '{folder}/customer.parquet'")
        want = con.execute(plans.SQL[name]).df()
        got = plans.QUERIES[name](spark, folder).toPandas()[list(want.columns)]
        assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist())), name


def _largest_share(spark, sf_dir, name):
    sizes = [r["count"] for r in plans.QUERIES[name](spark, sf_dir).groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


@pytest.mark.parametrize("name", ["contact_extracts", "contact_removed", "contact_masked"])
def test_contacts_are_dealt_to_all_cores(spark, sf_dir, name):
    assert _largest_share(spark, sf_dir, name) < 0.2


def test_removal_costs_no_more_with_more_names(spark, monkeypatch):
    """Names and brackets are tried only where one begins, not at every character."""
    rows = spark.range(0, 512, 1, 4).select(F.repeat(F.concat(F.lit("汉字数据12"), F.col("id").cast("string")), 1500).alias("t")).cache()
    rows.count()

    def seconds(step):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            assert rows.where(step("t") != F.col("t")).count() == 0
            took.append(time.perf_counter() - began)
        return min(took)

    far = "".join(map(chr, range(0xE000, 0xE000 + 400)))
    assert seconds(lambda t: text.remove_brackets(t, far)) < 4 * seconds(lambda t: text.remove_brackets(t, "()"))
    plain = seconds(text.remove_phone)
    monkeypatch.setattr(patterns, "PHONE_PREFIX", patterns.any_of(f"电{c}" for c in far))
    assert seconds(lambda t: text.remove_phone(t, prefix=True)) < 4 * plain
    rows.unpersist()


def test_removal_with_names_and_runs(spark):
    asked = [
        (lambda t: text.remove_phone(t, prefix=True), "TEL: 13800138000，xtel13800138000，电 话号码：010-12345678，手 机:x，手-13800138000", "，x，，手 机:x，手"),
        (lambda t: text.remove_email(t, prefix=True), "E-mail：a.b@c.com，xemail:a@b.cn，邮箱地址a_b-c@d.e.org，邮x@y.cn", "，x，，邮"),
        (lambda t: text.remove_brackets(t, "a.汉字"), "xa1.2汉a.字3.", "x23."), (text.remove_brackets, "（a(b)[c｛d｝）]（", "]（"),
        (lambda t: text.remove_redundant(t, "😀a]^-"), "😀😀😀aab]]^^--cc", "😀ab]^-cc"), (text.remove_redundant, "哈哈\n\n汉汉　　", "哈\n汉汉　"),
    ]
    for step, given, want in asked:
        assert spark.range(1).select(step(F.lit(given)), step(F.lit(None).cast("string"))).collect()[0][:] == (want, None), given


def test_augmented_texts_are_dealt_to_all_cores(spark, sf_dir):
    assert _largest_share(spark, sf_dir, "augmented_texts") < 0.2
    for k, t in enumerate(["", "a", "汉字abc" * 20, "𠀀汉" * 50]):
        assert augment.swapped(t, random.Random(k), 0.5, 2.0, augment._places(t)) == augment.swapped(t, random.Random(k), 0.5, 2.0)


@pytest.mark.parametrize("name", ["document_phrases", "text_sentiment"])
def test_turns_are_dealt_to_all_cores(spark, sf_dir, name):
    assert _largest_share(spark, sf_dir, name) < 0.3


def test_loose_grams_are_those_of_the_rule():
    rng = random.Random(2)
    dic = phrases.Words(stopwords=frozenset(["the", "火"]))
    for _ in range(100):
        s = [(rng.choice(["火", "箭", "时", "the", "", "发射成功"]), rng.choice(["n", "v", "u", "w", "m", "", "a"])) for _ in range(rng.randrange(20))]
        for rest in ((25, 1, 1, 0), (6, 3, 2, 1), (9, 1, 0, 2)):
            every = [(i, j) for i in range(len(s)) for j in range(i + 1, min(len(s), i + 12) + 1)]
            assert list(phrases._loose_grams(s, dic, 12, *rest)) == [(i, j) for i, j in every if phrases.loose(s[i:j], dic, *rest)]


def test_models_get_slices_of_a_batch(spark):
    """However many rows an Arrow batch has, few are Python lists at once; labels are those of whole rows."""
    rows = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.expr("transform(sequence(1, 1 + cast(id % 90 as int)), x -> concat('w', x))")).alias("tk"))

    def model(lists):
        assert len(lists) <= 4 * 512  # 91 tokens are three parts at most
        return [[t + "!" for t in ts] for ts in lists]

    for out in (batching.in_chunks(rows, "tk", model, 40, 7), batching.by_sentences(rows, "tk", model, longest=95), batching.labelled(rows, "tk", model), batching.by_length(rows, "tk", model)):
        got = out.collect()
        assert len(got) == 3000 and all(r["tags"] == [t + "!" for t in r["tk"] or []] for r in got)
    for size, overlap in ((5, 0), (5, 3), (6, 5), (50, 10)):
        numbered = lambda lists: [[f"{t}/{len(ts)}" for t in ts] for ts in lists]  # noqa: E731, B023
        cut = rows.where("id < 200").select("id", "tk", tags.chunks("tk", size, overlap).alias("c"))
        want = cut.select("id", tags.rejoin(F.transform("c", lambda c: F.transform(c, lambda t: F.concat(t, F.lit("/"), F.size(c).cast("string")))), overlap).alias("tags"))
        own = batching.in_chunks(rows.where("id < 200"), "tk", numbered, size, overlap).select("id", "tags")
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["time_values", "time_spans", "money_values"])
def test_orders_are_dealt_to_all_cores(spark, sf_dir, name):
    assert _largest_share(spark, sf_dir, name) < 0.2


def test_times_that_come_again_are_read_once(spark):
    base = [datetime(2021, 6, 14, 1, 6, 40), datetime(2020, 2, 29), None]
    asked = ["明天", "2021年6月14日", "不是", "", None, "三天", "明天" * 40, "昨天上午"]
    rows = [(i, t, b) for i, (t, b) in enumerate([(t, b) for t in asked for b in base] * 3)]
    df = spark.createDataFrame(rows, "i int, t string, b timestamp_ntz").select("i", times.parse_time("t", "b").alias("v"))
    got = {r["i"]: r["v"] and r["v"].asDict(True) for r in df.collect()}
    for i, t, b in rows:
        want = times.parse(t, b) if b else None
        assert (got[i] is None) == (want is None) and all(got[i][k] == want.get(k) for k in got[i] or ()), (t, b)
    times._parsed.cache_clear()
    for _ in range(3):
        times._parsed("明天", base[0], None, False, True)
    assert times._parsed.cache_info().misses == 1
