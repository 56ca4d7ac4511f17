"""Pronunciation, characters, corrected words, word measures, splits by entities, grading by question, places abroad, archives."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from glyphline.functions import chars
from glyphline.operators import datasets, lexicon, places
from glyphline.sources import files

PHRASES = {"银行": ["yín", "háng"], "行走": ["xíng", "zǒu"], "绿色": ["lǜ", "sè"]}
CHARS = {"行": ["xíng", "háng"], "好": ["hǎo"], "绿": ["lǜ"], "女": ["nǚ"], "啊": ["a"], "中": ["zhōng"], "嗯": ["ńg"]}


def test_pinyin(spark):
    df = spark.createDataFrame([(1, "银行好，行A"), (2, ""), (3, None), (4, "女中啊行走绿色"), (5, "嗯")], "id long, t string")
    rows = {r["id"]: r for r in df.select("id", *[chars.pinyin("t", PHRASES, CHARS, f).alias(f) for f in ("standard", "simple")]).collect()}
    assert rows[1]["standard"] == ["yín", "háng", "hǎo", "<py_unk>", "xíng", "<py_unk>"]
    assert rows[1]["simple"] == ["yin2", "hang2", "hao3", "<py_unk>", "xing2", "<py_unk>"]
    assert rows[4]["simple"] == ["nv3", "zhong1", "a5", "xing2", "zou3", "lv4", "se4"]
    assert rows[2]["standard"] == [] and rows[3]["standard"] is None
    detail = {r["id"]: r["d"] for r in df.select("id", chars.pinyin("t", PHRASES, CHARS, "detail").alias("d")).collect()}
    assert [tuple(x) for x in detail[4]] == [("n", "v", "3"), ("zh", "ong", "1"), ("", "a", "5"), ("x", "ing", "2"), ("z", "ou", "3"), ("l", "v", "4"), ("s", "e", "4")]
    assert tuple(detail[1][3]) == ("", "", "") and tuple(detail[5][0]) == ("ng", "", "2")
    with pytest.raises(ValueError):
        chars.pinyin("t", {"银行": ["yín"]}, {})


def test_radicals(spark):
    table = {"河": ("氵", "左右结构", "31120", "441251", "ISKG")}
    r = spark.createDataFrame([("河a",), (None,)], "t string").select(chars.radicals("t", table).alias("r")).collect()
    assert [tuple(x) for x in r[0]["r"]] == [table["河"], chars.NO_RADICAL] and r[1]["r"] is None


def test_words_and_their_parts_of_speech_are_corrected(spark):
    df = spark.createDataFrame([([("学习", "v"), ("区", "s"), ("块链", "n"), ("。", "w")],), ([("有条", "n"), ("不", "d"), ("紊乱", "a")],), ([],)], "t array<struct<word:string,pos:string>>")
    got = [[tuple(x) for x in r["c"]] for r in df.select(lexicon.retag("t", {"区块链": "n", "有条不紊": "i"}).alias("c")).collect()]
    assert got == [[("学习", "v"), ("区块链", "n"), ("。", "w")], [("有条不紊", "i"), ("乱", "a")], []]


def test_word_measures(spark):
    df = spark.createDataFrame([(["今天", "天气", "好"], ["今", "天", "天气", "好"]), (["他", "来"], ["他来"])], "gold array<string>, pred array<string>")
    r = datasets.word_measures(df).first()
    assert (r["precision"], r["recall"]) == (2 / 5, 2 / 5) and r["f1"] == pytest.approx(0.4)


def test_split_by_entities(spark):
    rows = spark.range(4000).select("id", F.array(*[F.struct(F.lit("x").alias("text"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.when(F.col("id") % k == 0, f"t{k}").otherwise("o").alias("type")) for k in (2, 3)]).alias("entities"))
    dealt, report = datasets.analyse_entities(rows, "id")
    assert dealt.columns == ["id", "entities", "part"] and dealt.count() == 4000
    got = report.collect()
    assert sum(r["n"] for r in got) == 8000 and max(r["ratio"] for r in got) < 0.05
    for part in ("train", "valid", "test"):
        assert sum(r["share"] for r in got if r["part"] == part) == pytest.approx(1)


def by_question(scores, epochs=20, rate=0.01, tol=1e-5, steps=4):
    names = sorted({g for g, *_ in scores})
    cells = {}
    for g, m, q, x in scores:
        cells.setdefault((m, q), {})[g] = x
    w = {c: dict.fromkeys(v, 1 / len(v)) for c, v in cells.items()}
    for _ in range(epochs):
        new, total = {}, dict.fromkeys(names, 0.0)
        for c, v in cells.items():
            mean = round(sum(w[c][g] * v[g] for g in v) * steps) / steps
            total[c[0]] += mean
            low = {g: max(0.0, w[c][g] - rate * (v[g] - mean) ** 2) for g in v}
            s = sum(low.values())
            new[c] = {g: low[g] / s if s else 1 / len(v) for g in v}
        above = {n: total[n] - min(total.values()) for n in names}
        s = sum(above.values())
        new = {c: {g: (x + (above[g] / s if s else 1 / len(names))) / 2 for g, x in v.items()} for c, v in new.items()}
        gap = sum((new[c][g] - w[c][g]) ** 2 for c in w for g in w[c])
        w = new
        if gap < tol:
            break
    sums = {n: sum(v[n] for v in w.values()) for n in names}
    return total, {n: x / sum(sums.values()) for n, x in sums.items()}


def test_grading_by_question(spark):
    scores = [(g, m, q, float((i + 2 * j + q * (i + 1)) % 7)) for i, g in enumerate("xyz") for j, m in enumerate("xyz") for q in range(5)]
    final, weights = datasets.grade_models_by_question(spark.createDataFrame(scores, "grader string, graded string, question long, score double"))
    total, want = by_question(scores)
    assert {r["graded"]: r["score"] for r in final.collect()} == pytest.approx(total)
    assert {r["grader"]: r["weight"] for r in weights.collect()} == pytest.approx(want)


def test_places_at_home_and_abroad(spark):
    home = spark.createDataFrame([("四川省", None, None, ["四川"]), ("四川省", "成都市", None, ["成都"])], "province string, city string, county string, aliases array<string>")
    world = spark.createDataFrame([("斯里兰卡", "科伦坡", ["锡兰"]), ("法国", "巴黎", [])], "country string, city string, aliases array<string>")
    token = "array<struct<word:string,pos:string>>"
    df = spark.createDataFrame([(1, [(w, "ns") for w in ("四川", "成都", "科伦坡", "锡兰", "巴黎市", "某地", "某地")] + [("法国", "n")]), (2, []), (3, None)], f"id long, tk {token}")
    got = {(r["id"], r["kind"], r["rank"]): (r["province"], r["city"], r["country"], r["name"], r["n"]) for r in places.recognise_locations(df, "id", "tk", home, world=world).collect()}
    assert got == {
        ("1", "domestic", 1): ("四川省", "成都市", None, None, 2), ("1", "foreign", 1): (None, "科伦坡", "斯里兰卡", None, 2),
        ("1", "foreign", 2): (None, "巴黎", "法国", None, 1), ("1", "other", 1): (None, None, None, "某地", 2),
    }


def test_archives_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a.txt", i, f"line {i} é") for i in range(50)] + [("b.txt", 0, "")], "name string, line long, value string")
    path = str(tmp_path / "zips")
    files.write_zips(rows.repartition(5), path)
    back = files.read_zips(spark, path)
    assert sorted(map(tuple, back.select("name", "line", "value").collect())) == sorted(map(tuple, rows.collect()))
