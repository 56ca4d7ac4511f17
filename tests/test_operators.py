"""Corpus operators against brute force or small fixtures."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from glyphline.functions import catalog
from glyphline.operators import augment, batching, calendar, datasets, lexicon, phrases, places, similar
from glyphline.sources import files, services
from glyphline.streaming import dedup


def test_longest_match_forms_agree(spark):
    words = {"place": ["四川省水利局", "四川省", "四川"], "name": ["岳灵珊", "四川", "Abc"]}
    texts = ["岳灵珊在四川省水利局上班。", "四川四川省abC", "", None, "没有"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    small = {r["i"]: r["e"] for r in df.select("i", lexicon.entities("t", words).alias("e")).collect()}
    large = {r["i"]: r["entities"] for r in lexicon.entities_large(df, "t", words).collect()}
    assert small == large
    assert [tuple(s) for s in small[0]] == [("岳灵珊", 0, 3, "name"), ("四川省水利局", 4, 10, "place")] and [s["type"] for s in small[1]] == ["place", "place", "name"]


def test_resegment(spark):
    df = spark.createDataFrame([(["在", "四川", "省水利局", "工作"],)], "w array<string>")
    assert df.select(lexicon.resegment("w", ["四川省", "水利局"]).alias("x")).first()["x"] == ["在", "四川省", "水利局", "工作"]


def test_calendar_round_trip():
    day = date(1900, 1, 31)
    spans = {(y, m, leap): (s, n) for y, m, leap, s, n in calendar.months()}
    assert all(n in (29, 30) for _, n in spans.values())
    table = calendar.months()
    for (*_, s, n), (*_, t, _) in zip(table, table[1:], strict=False):
        assert s + timedelta(n) == t
    assert table[0][3] == day and table[-1][0] == 2100
    assert calendar.to_solar(1989, 9, 23) == date(1989, 10, 22) and calendar.to_solar(2020, 4, 1, True) == date(2020, 5, 23) and calendar.to_solar(2021, 1, 31) is None


def test_calendar_joins(spark):
    days = [date(1900, 1, 31) + timedelta(37 * i) for i in range(1900)] + [date(1899, 1, 1), None]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = calendar.solar_to_lunar(df, "d")
    assert got.count() == len(days)
    back = calendar.lunar_to_solar(got.select("d", "lunar.*"), "year", "month", "day", "leap").collect()
    assert all(r["solar"] == (r["d"] if r["d"] and r["d"] >= date(1900, 1, 31) else None) for r in back)
    texts = {r["d"]: r["x"] for r in got.select("d", calendar.lunar_text("lunar").alias("x")).collect()}
    assert texts[date(1900, 1, 31)] == "一九零零年正月初一 庚子年 (鼠年)"


def test_similar_search(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for i in range(250):
        p = rng.choice(fps[:150])
        for _ in range(rng.randrange(0, 6)):
            p ^= 1 << rng.randrange(64)
        fps.append(p)
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(fps)]
    store = spark.createDataFrame(signed, "id long, fp long")
    got = {r["id"]: r["match"] for r in similar.search(store.where("id % 10 = 0"), store).collect()}
    assert len(got) == 40
    for i, m in got.items():
        near = [j for j, p in enumerate(fps) if j != i and (p ^ fps[i]).bit_count() <= 3]
        assert m == (min(near) if near else None)


def test_simhash_of_words(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c"],), (["c", "a", "b", "a"],), ([],)], "w array<string>")
    rows = [r["x"] for r in df.select(similar.simhash(similar.top_words("w")).alias("x")).collect()]
    assert rows[0] == rows[1] != rows[2] == 0
    top = df.select(similar.top_words("w", 2).alias("x")).first()["x"]
    assert [tuple(x) for x in top] == [("a", 2.0), ("b", 1.0)]


def test_split_and_measures(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(2000)], "id long, label string")
    a, b = (sorted((r["id"], r["part"]) for r in datasets.split(rows, "id").collect()) for _ in range(2))
    assert a == b and 0.75 < sum(p == "train" for _, p in a) / 2000 < 0.85
    tags = spark.createDataFrame([(["B", "I", "B"], ["B", "B", "B"])], "gold array<string>, pred array<string>")
    got = {r["tag"]: (r["precision"], r["recall"], r["support"]) for r in datasets.measures(datasets.confusion(tags)).collect()}
    assert got == {"B": (pytest.approx(2 / 3), 1.0, 2), "I": (0.0, 0.0, 1)}
    scores = spark.createDataFrame([(g, m, q, {"good": 3.0, "bad": 1.0}[m] + (g == "bad") * (q % 3)) for g in ("good", "bad") for m in ("good", "bad") for q in range(9)], "grader string, graded string, question long, score double")
    final, weight = datasets.grade_models(scores)
    assert weight["good"] > weight["bad"] and {r["graded"]: r["score"] for r in final.collect()}["good"] > 0


ROWS = [("湖北省", None, None, ["湖北"]), ("湖北省", "襄阳市", None, ["襄阳"]), ("吉林省", None, None, ["吉林"]), ("吉林省", "吉林市", None, ["吉林"]), ("重庆市", None, None, ["重庆"]), ("湖南省", None, None, ["湖南"]), ("湖南省", "湘潭市", None, ["湘潭"]), ("湖南省", "湘潭市", "湘潭县", ["湘潭"])]


@pytest.mark.parametrize("t, want", [("湖北省襄阳市小水街222号", ("湖北省", "襄阳市", None, "小水街222号")), ("吉林省吉林市小皇村", ("吉林省", "吉林市", None, "小皇村")), ("重庆解放碑", ("重庆市", "重庆市", None, "解放碑")), ("湘潭县城塘社区", ("湖南省", "湘潭市", "湘潭县", "城塘社区")), ("湖南湘潭城塘社区", ("湖南省", "湘潭市", None, "城塘社区")), ("别处", (None, None, None, "别处")), ("重庆路3号", (None, None, None, "重庆路3号"))])
def test_addresses(t, want):
    got = places.Gazetteer([dict(zip(("province", "city", "county", "aliases"), r, strict=True)) for r in ROWS]).parse(t)
    assert tuple(got[k] for k in ("province", "city", "county", "detail")) == want


def test_recognised_places(spark):
    gaz = spark.createDataFrame(ROWS, "province string, city string, county string, aliases array<string>")
    docs = spark.createDataFrame([(1, [("湘潭", "ns"), ("湖南", "ns"), ("去", "v"), ("湘潭", "ns"), ("湖北", "ns")]), (2, None)], "id long, tk array<struct<word:string,pos:string>>")
    got = sorted((r["rank"], r["province"], r["city"], r["n"]) for r in places.recognise_locations(docs, "id", "tk", gaz).collect())
    assert got == [(1, "湖南省", "湘潭市", 3), (2, "湖北省", None, 1)]


def test_phrases(spark):
    dic = phrases.Words(idf={"经济": 3.0, "发展": 2.0}, stopwords=frozenset("的"))
    sents = [[{"word": w, "pos": p} for w, p in (("经济", "n"), ("发展", "vn"), ("的", "uj"), ("速度", "n"), ("。", "w"))]] * 2
    got = phrases.phrases(sents, dic, top=3)
    assert got and got[0][1] >= got[-1][1] > 0 and all("。" not in p for p, _ in got)
    assert phrases.summary(sents, dic, length=8) == "经济发展的速度。" and phrases.phrases([], dic) == [] and phrases.summary([], dic) == ""
    df = spark.createDataFrame([("今天天气好。我们去公园。",), ("",), (None,)], "t string").select(phrases.default_tokens("t").alias("tk"))
    rows = df.select(phrases.extract_keyphrases("tk", dic).alias("k"), phrases.extract_summary("tk", dic).alias("s")).collect()
    assert rows[0]["s"] == "今天天气好。我们去公园。" and rows[2]["k"] is None


def test_augmentation(spark):
    df = spark.createDataFrame([("天气很好我们一起去公园玩耍吧今天真是不错的一天" * 3,), ("",), (None,)], "t string")
    for c in (augment.swap_positions("t", ratio=0.2), augment.add_and_delete("t", {" ": 9, ",": 5}, add=0.1, delete=0.1)):
        a, b = ([r["x"] for r in df.select(c.alias("x")).collect()] for _ in range(2))
        assert a == b and 0 < len(a[0]) <= 3 and len(set(a[0])) == len(a[0]) and df.first()["t"] not in a[0] and a[1] == [] and a[2] is None
    names = {"p": ["马云", "任正非"]}
    one = spark.createDataFrame([("小马在北京", [("小马", 0, 2, "p")])], "t string, e array<struct<text:string,start:int,end:int,type:string>>")
    for x in one.select(augment.replace_entities("t", "e", names, ratio=0.9).alias("x")).first()["x"]:
        e = x["entities"][0]
        assert x["text"][e["start"] : e["end"]] == e["text"] in names["p"]
    idioms = spark.createDataFrame([("道阻且长", 5), ("长命百岁", 9), ("长话短说", 3)], "idiom string, freq long")
    asked = spark.createDataFrame([(1, "道阻且长"), (2, "")], "id long, idiom string")
    got = {r["id"]: r["next"] for r in augment.next_idioms(asked, idioms, used=spark.createDataFrame([("长命百岁",)], "idiom string")).collect()}
    assert got == {1: "长话短说", 2: None}
    sounds = spark.createDataFrame([(["我", "们", "再", "见"],)], "w array<string>").select(augment.homophones("w", {"再": ["在"]}, ratio=0.9).alias("x")).first()["x"]
    assert sounds == ["我们在见"]


def test_batching(spark):
    docs = spark.createDataFrame([(i, list("ab。" * n)) for i, n in enumerate([0, 1, 7, 30])], "i int, tk array<string>")
    model = lambda batch: [[t.upper() for t in ts] for ts in batch]
    for out in (batching.by_length(docs, "tk", model), batching.in_chunks(docs, "tk", model, 10, 3), batching.by_sentences(docs, "tk", model, longest=9)):
        assert all(r["tags"] == [t.upper() for t in r["tk"]] for r in out.collect())


def test_files(spark, tmp_path):
    lines = tmp_path / "lines.txt"
    lines.write_text('{"a": 1}\n\n  plain \n', encoding="utf-8")
    got = files.read_lines(spark, str(lines)).selectExpr("value", "json IS NULL AS raw").collect()
    assert sorted((r["value"], r["raw"]) for r in got) == [("plain", True), ('{"a": 1}', False)]
    outline = tmp_path / "outline.txt"
    outline.write_text("四川省\n\t成都市\t成都\n\t\t武侯区\n\t绵阳市\n湖北省\n\t襄阳市\n", encoding="utf-8")
    rows = [(r["depth"], r["l0"], r["l1"], r["l2"]) for r in files.read_outline(spark, str(outline)).orderBy("line").collect()]
    assert rows[2] == (2, "四川省", "成都市", "武侯区") and rows[3] == (1, "四川省", "绵阳市", None) and rows[4] == (0, "湖北省", None, None) and rows[5] == (1, "湖北省", "襄阳市", None)
    files.write_lines(spark.createDataFrame([("a\nb",)], "x string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()["value"] == "ab"
    ranges = spark.createDataFrame([("134", "0-2,17")], "prefix string, ranges string")
    assert sorted(r["code"] for r in files.expand_prefixes(ranges).collect()) == ["1340000", "1340001", "1340002", "1340017"]
    changes = tmp_path / "changes.txt"
    changes.write_text("2010-12-09\t国务院\t湖北省\t湖北\t襄樊市\t襄樊=>湖北省\t湖北\t襄阳市\t襄阳\n", encoding="utf-8")
    assert files.read_changes(spark, str(changes)).first()["new_loc"][2] == "襄阳市"


def test_services(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, None)], "i long, t string")
    shout = {"s": (lambda: services.careful(lambda t, a, b: t + b[0], ["zh", "en"]), ["zh", "en"])}
    got = services.keep_translations(services.back_translations(rows, "i", "t", shout)).collect()
    assert [(r["id"], r["translated"]) for r in got] == [("1", "abcez")]
    with pytest.raises(ValueError):
        services.careful(lambda t, a, b: t, ["zh"])("x", "zh", "en")
    grades = spark.createDataFrame([("给85分",), ("八点五",), ("九十分",), ("无",)], "g string").select(services.grade_value("g").alias("v"))
    assert [r["v"] for r in grades.collect()] == [85.0, 8.5, 90.0, None]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "id long, text string, fp long, at timestamp"
    rows = [(1, "a", 0b1111, "2024-01-01 00:00:00"), (2, "a", 0b1110, "2024-01-01 00:01:00"), (3, "b", -1, "2024-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "id long, text string, fp long, at string").select("id", "text", "fp", F.col("at").cast("timestamp").alias("at"))
    df.coalesce(1).write.parquet(str(src / "x"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(src / "*"))

    def run(out, name, mode="append"):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert sorted(r["id"] for r in run(dedup.first_of_each(stream(), "text", "at", "1 hour"), "firsts")) in ([1, 3], [2, 3])
    near = run(dedup.near_copies(stream(), "id", "fp", "at", 1.0), "near")
    assert {(r["id"], r["match"]) for r in near} == {(2, 1)}
    grams = run(dedup.ngram_counts(stream(), "text"), "grams", "complete")
    assert {(r["gram"], r["freq"]) for r in grams} == {("a", 2), ("b", 1)}


def test_catalog(spark):
    names = {r["name"] for r in catalog.functions(spark).collect()}
    assert {"clean_text", "parse_time", "discover", "search"} <= names
    assert catalog.search(spark, "money").first()["name"].endswith("money")


def test_registered_back_translations_keep_rows(spark, sf_dir):
    from glyphline.plans import queries as plans

    assert plans.QUERIES["back_translations"](spark, sf_dir).count() > 0
