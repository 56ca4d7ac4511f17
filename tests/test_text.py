"""Golden tables and invariants of the text functions."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from glyphline.functions import money, patterns, tags, text, times, udfs


def one(spark, column, *values, schema="t string"):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "fn, given, want",
    [
        (text.has_han, "abc中", True), (text.has_han, "", False), (text.all_han, "中文", True), (text.all_han, "中文\n", False), (text.has_digit, "１", True),
        (text.all_digits, "20221128", True), (text.all_digits, "2022a", False), (text.chinese_runs, "a中文b字", ["中文", "字"]), (text.chinese_runs, "", []),
        (text.emails, "x@a.com，y.z@b-c.org", ["x@a.com", "y.z@b-c.org"]), (text.email_domains, "x@a.com y@b-c.org", ["a", None]),
        (text.phones, "13812345678 010-12345678", ["13812345678", "010-12345678"]), (text.phones, "113812345678", []),
        (text.ip_addresses, "10.0.0.1, 256.1.1.1, 1.2.3.255", ["10.0.0.1", "1.2.3.255"]), (text.id_cards, "证51010119900101123X。", ["51010119900101123X"]),
        (text.qq_numbers, "加QQ：123456", ["123456"]), (text.qq_numbers, "编号123456", []), (text.wechat_ids, "wx:abc123", ["abc123"]), (text.wechat_ids, "微信abc123", ["abc123"]),
        (text.plates, "川A·12345。", ["川A·12345"]), (text.urls, "见http://a.com/b?c=1。好", ["http://a.com/b?c=1"]), (text.urls, "www.a.com", ["www.a.com"]),
        (text.remove_email, "xxx@xxx.COM.........", "........."), (text.replace_email, "a@b.com", "<email>"), (text.remove_redundant, "哈哈哈  \n\n啊", "哈 \n啊"),
        (text.full_to_half, "ＡＢ１２　！", "AB12 ！"), (text.remove_brackets, "甲（乙[丙]（丁））戊（", "甲戊（"), (text.remove_brackets, "([)]", "]"), (text.replace_chinese, "a中b", "a b"), (text.replace_chinese, "", ""),
        (text.remove_tags, "<p>甲</p>1<2", "甲1<2"), (text.remove_odd_chars, "áb", "a b"), (text.characters, "a😀中", ["a", "😀", "中"]), (text.province_alias, "广西壮族自治区", "广西"),
    ],
)
def test_text(spark, fn, given, want):
    assert one(spark, fn("t"), given) == want
    assert one(spark, fn("t"), None, schema="t string") in (None, False)


def test_prefixes_go_too(spark):
    assert one(spark, text.remove_email("t", True), "邮箱：a@b.com吧") == "吧"
    assert one(spark, text.remove_phone("t", True), "Tel: 18902437922 好") == " 好"


def test_spans_slice_back(spark):
    t = "😀电话13812345678，又13912345678。"
    for s in one(spark, text.find_spans("t", patterns.CELL, "cell"), t):
        assert t[s["start"] : s["end"]] == s["text"]
    assert one(spark, text.find_spans("t", patterns.CELL), "none") == []


@pytest.mark.parametrize("number, style, want", [("120402810.03", "formal", "壹亿贰仟零肆拾萬贰仟捌佰壹拾點零叁"), ("38,009.0", "plain", "三万八千零九"), ("0", "plain", "零"), ("10", "plain", "十"), ("100000000", "plain", "一亿"), ("100100", "plain", "十万零一百"), ("x", "plain", None)])
def test_numerals(spark, number, style, want):
    assert one(spark, text.number_to_chinese("t", style), number) == want


def test_identifiers(spark):
    assert tuple(one(spark, text.plate_info("t"), "川A·23047B")) == ("川A", "PEV", "big")
    assert tuple(one(spark, text.plate_info("t"), "川A·12345")) == ("川A", "GV", None)
    assert one(spark, text.plate_info("t"), "nothing") is None
    assert one(spark, text.id_card_info("t"), "51010119900101123X")["gender"] == "男"
    assert one(spark, text.id_card_info("t"), "510101") is None
    assert tuple(one(spark, text.phone_info("t"), "13812345678")) == ("cell_phone", "1381234", None)
    assert tuple(one(spark, text.phone_info("t"), "010-12345678")) == ("landline_phone", None, "010")
    names = lambda t: one(spark, text.is_person_name("t", "张王", ("欧阳",)), t)
    assert [names(x) for x in ("张三", "欧阳修", "张王小明", "李四", "张", "")] == [True, True, True, False, False, False]


def test_conversion(spark):
    assert one(spark, text.convert_chars("t", {"国": "國", "车": "車"}), "中国车") == "中國車"
    assert one(spark, text.convert_words("t", {"四川": "A", "四川省": "B", "省": "C"}), "四川省四川人") == "BA人"
    for t in ("中文 abc\n", "", "a😀\x00ÿ", "ĀŁ"):
        assert one(spark, text.chars_to_bytes(text.bytes_to_chars("t")), t) == t
        assert one(spark, F.length(text.bytes_to_chars("t")), t) == len(t.encode())


def test_pages(spark):
    page = "<html><meta name='keywords' content='a,b'><script>if (1<2) {}</p></script><div class='nav'>x<div>y</div>z</div><p>甲&amp;乙<br/>丙</p></html>"
    assert one(spark, text.clean_html(udfs.cut_menus("t")), page) == "甲&乙\n丙\n"
    assert one(spark, text.meta_info("t"), page) == {"keywords": "a,b"}
    assert one(spark, text.clean_html("t"), "<script>" + "x" * 200_000 + "</script>ok") == "ok"


def test_sentences(spark):
    assert udfs.sentences("中华古汉语，泱泱大国，历史传承的瑰宝。", True) == ["中华古汉语，", "泱泱大国，", "历史传承的瑰宝。"]
    assert udfs.sentences("他说：“好。”我走了。") == ["他说：“好。”", "我走了。"]
    for t in ("", "。。", "a\nb", "“甲。乙”丙"):
        assert "".join(udfs.sentences(t)) == t
    got = one(spark, udfs.extract_brackets("t"), "a(b[c]d)e)")
    assert [s["text"] for s in got] == ["[c]", "(b[c]d)"]


def test_sentiment(spark):
    score = udfs.sentiment("t", {"好": 1.0, "坏": -1.0}, ["不"], {"很": 2.0})
    good, bad, turned, none = (one(spark, score, t) for t in ("很好。", "坏。", "不好。", ""))
    assert good > 0.5 > bad and turned < 0.5 and none == 0.5


# -- labels -------------------------------------------------------------------------
def test_tags_round_trip(spark):
    df = spark.createDataFrame([(list("胡静静在水利局工作。"), [("胡静静", 0, 3, "Person"), ("水利局", 4, 7, "Org"), ("利局工", 5, 8, "Org"), ("。", 9, 10, "P")])], f"tk array<string>, sp {tags.SPANS}")
    r = df.withColumn("tg", tags.spans_to_tags("tk", "sp")).withColumn("back", tags.tags_to_spans("tk", "tg")).first()
    assert r["tg"] == ["B-Person", "I-Person", "E-Person", "O", "B-Org", "I-Org", "E-Org", "O", "O", "S-P"]
    assert [tuple(s) for s in r["back"]] == [("胡静静", 0, 3, "Person"), ("水利局", 4, 7, "Org"), ("。", 9, 10, "P")]
    df = spark.createDataFrame([(["他", "在", "四川省"], [("四川省", 2, 5, "L"), ("在四", 1, 3, "L")])], f"w array<string>, sp {tags.SPANS}")
    r = df.select(tags.char_to_word_spans("sp", "w").alias("a"), tags.word_to_char_spans(tags.char_to_word_spans("sp", "w"), "w").alias("b"), tags.words_to_tags("w").alias("t"), tags.tags_to_words(F.lit("他在四川省"), tags.words_to_tags("w")).alias("back")).first()
    assert [tuple(s)[1:3] for s in r["a"]] == [(2, 3)] and [tuple(s)[1:3] for s in r["b"]] == [(2, 5)] and r["t"] == list("BBBII") and r["back"] == ["他", "在", "四川省"]
    df = spark.createDataFrame([([("他", "r"), ("四川", "ns")],)], "w array<struct<word:string,pos:string>>")
    r = df.select(tags.pos_to_tags("w").alias("t"), tags.tags_to_pos(F.lit("他四川"), tags.pos_to_tags("w")).alias("b")).first()
    assert r["t"] == ["B-r", "B-ns", "I-ns"] and [tuple(x) for x in r["b"]] == [("他", "r"), ("四川", "ns")]


@pytest.mark.parametrize("n", [0, 1, 19, 20, 21, 47, 100])
def test_chunks_rejoin(spark, n):
    df = spark.createDataFrame([([str(i) for i in range(n)],)], "tk array<string>")
    r = df.select(tags.rejoin(tags.chunks("tk", 20, 5), 5).alias("x"), tags.chunks("tk", 20, 5).alias("c")).first()
    assert r["x"] == [str(i) for i in range(n)] and all(len(c) <= 20 for c in r["c"])


# -- money and time -------------------------------------------------------------------
MONEY = [
    ("82，225.00元", "82225.00", "82225.00", "元", "accurate"), ("1.2万元", "12000.00", "12000.00", "元", "accurate"), ("六十四万零一百四十三元一角七分", "640143.17", "640143.17", "元", "accurate"),
    ("近700万元", "7000000.00", "7000000.00", "元", "blur-"), ("3000多欧元", "3000.00", "4000.00", "欧元", "blur"), ("十几块钱", "10.00", "20.00", "元", "blur"), ("从8500到3万港元", "8500.00", "30000.00", "港元", "blur"),
    ("10~15k元", "10000.00", "15000.00", "元", "blur"), ("八到九百亿泰铢", "800000000.00", "90000000000.00", "泰铢", "blur"), ("三五百块", "300.00", "500.00", "元", "blur"), ("不到1.9万台币", "19000.00", "19000.00", "新台币", "blur-"), ("２１元", "21.00", "21.00", "元", "accurate"),
]


def test_money(spark):
    df = spark.createDataFrame([(m[0],) for m in MONEY] + [("无",), ("",), (None,)], "t string")
    got = {r["t"]: r["m"] for r in df.select("t", money.parse_money("t").alias("m")).collect()}
    for t, *want in MONEY:
        assert list(got[t]) == want, t
    assert got["无"] is None and got[""] is None and got[None] is None
    t = "赔偿车费601,293.11元，工厂费一万二千三百四十五元,利息9佰日元，打印费十块钱。"
    found = one(spark, money.extract_money("t"), t)
    assert [s["text"] for s in found] == ["601,293.11元", "一万二千三百四十五元", "9佰日元", "十块钱"] and all(t[s["start"] : s["end"]] == s["text"] for s in found)


BASE = datetime(2021, 6, 14, 1, 6, 40)
TIMES = [
    ("2018-11-29 18:59", "time_point", "2018-11-29 18:59:00", "2018-11-29 18:59:59"), ("2015年8月12日", "time_point", "2015-08-12 00:00:00", "2015-08-12 23:59:59"), ("91年5月", "time_point", "1991-05-01 00:00:00", "1991-05-31 23:59:59"),
    ("下周二", "time_point", "2021-06-22 00:00:00", "2021-06-22 23:59:59"), ("上上个月五号", "time_point", "2021-04-05 00:00:00", "2021-04-05 23:59:59"), ("明天下午七八点", "time_span", "2021-06-15 19:00:00", "2021-06-15 20:59:59"),
    ("今天下午1点半到3点", "time_span", "2021-06-14 13:30:00", "2021-06-14 15:00:00"), ("2019年感恩节到2021年母亲节", "time_span", "2019-11-28 00:00:00", "2021-05-09 23:59:59"), ("2023年大年三十", "time_point", "2024-02-09 00:00:00", "2024-02-09 23:59:59"),
    ("十九世纪七十年代", "time_span", "1870-01-01 00:00:00", "1879-12-31 23:59:59"), ("5个交易日之后", "time_span", "2021-06-21 00:00:00", "inf"), ("未来7天", "time_span", "2021-06-14 01:06:40", "2021-06-21 01:06:40"), ("今年立冬", "time_point", "2021-11-07 00:00:00", "2021-11-07 23:59:59"),
]


def test_times(spark):
    df = spark.createDataFrame([(t[0],) for t in TIMES] + [("这不是时间",), (None,), ("",)], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", times.parse_time("t", BASE).alias("v")).collect()}
    for t, kind, start, end in TIMES:
        assert (got[t]["type"], got[t]["start"], got[t]["end"]) == (kind, start, end), t
    assert got["这不是时间"] is None and got[None] is None and got[""] is None
    assert times.parse("六个月以下", BASE)["delta_hi"] == {"month": 6.0} and times.parse("36天5小时", BASE)["delta"] == {"day": 36.0, "hour": 5.0}
    assert times.parse("每周六上午9点到11点", BASE)["type"] == "time_period"


@pytest.mark.parametrize("t, want", [("他在10月22出生", ["10月22"]), ("二十七点三", []), ("身份证号140302197706220124。", []), ("地方驻点8月15号", ["8月15号"]), ("大概六天后的3时1刻需要处理东西", ["六天后的3时1刻"])])
def test_times_in_texts(t, want):
    found = times.find(t, BASE)
    assert [s["text"] for s in found] == want and all(t[s["start"] : s["end"]] == s["text"] for s in found)
