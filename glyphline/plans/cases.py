"""Queries over fixed phrases: forms of a grammar that no table of the benchmark holds.

Each case is (input, result as text); SQL gives the same pairs as VALUES. The results were worked out by hand; those of
times were read by the grammar first and then checked one by one against a calendar.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphline.functions import chars, money, tags, text, times, udfs
from glyphline.operators import augment, batching, calendar, datasets, lexicon, new_words, phrases, places
from glyphline.shared import fresh_dir
from glyphline.sources import files, services
from glyphline.streaming import dedup

#: Base of the times: a Wednesday.
BASE = datetime(2022, 3, 9, 10, 20, 30)
TOKENS = "array<struct<word:string,pos:string>>"
SPANS = "array<struct<text:string,start:int,end:int,type:string>>"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def case(name: str, make: Callable[[Column], Column] | None, rows: list[tuple[str, str | None]], kind: str = "string", frame: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Registers ``name``: (given, result) of ``make`` over the given texts, which are parsed as JSON where ``kind`` is no string."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.createDataFrame([(g,) for g, _ in rows], "given string")
        df = df.withColumn("x", F.col("given") if kind == "string" else F.from_json("given", kind))
        df = frame(df) if frame else df.withColumn("result", make(F.col("x")))
        return df.select("given", F.col("result").cast("string").alias("result"))

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = "SELECT * FROM (VALUES " + ", ".join(f"({_quoted(g)}, {_quoted(r)})" for g, r in rows) + ") AS t(given, result)"


def _list(c: Column) -> Column:
    return F.array_join(c, "|", "-")


def _words(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda t: F.concat_ws("/", t["word"], t["pos"])), " ")


def _spans(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["text"], s["start"], s["end"])), "|")


# -- times: a phrase for each rule ------------------------------------------------------
def _time(c: Column) -> Column:
    v = times.parse_time(c, BASE)
    return F.concat_ws(" ", F.substring(v["type"], 6, 9), v["definition"], v["start"], v["end"], F.to_json(v["delta"]), F.to_json(v["delta_hi"]))


TIMES = [
    ("2023年5月6、8日", "span accurate 2023-05-06 00:00:00 2023-05-08 23:59:59"),
    ("前两天", "span blur 2022-03-02 00:00:00 2022-03-07 23:59:59"),
    ("2019-11-05", "point accurate 2019-11-05 00:00:00 2019-11-05 23:59:59"),
    ("20200229", "point accurate 2020-02-29 00:00:00 2020-02-29 23:59:59"),
    ("2018-07", "point accurate 2018-07-01 00:00:00 2018-07-31 23:59:59"),
    ("4/17", "point accurate 2022-04-17 00:00:00 2022-04-17 23:59:59"),
    ("2020年冬至", "point accurate 2020-12-21 00:00:00 2020-12-21 23:59:59"),
    ("去年第三季度", "span accurate 2021-07-01 00:00:00 2021-09-30 23:59:59"),
    ("2017年第二季度", "span accurate 2017-04-01 00:00:00 2017-06-30 23:59:59"),
    ("今年4月上旬", "span blur 2022-04-01 00:00:00 2022-04-10 23:59:59"),
    ("2016年8月下旬", "span blur 2016-08-21 00:00:00 2016-08-31 23:59:59"),
    ("明年夏季", "span accurate 2023-05-06 00:00:00 2023-08-07 23:59:59"),
    ("本季度", "span accurate 2022-01-01 00:00:00 2022-03-31 23:59:59"),
    ("2015年秋天", "span accurate 2015-08-08 00:00:00 2015-11-07 23:59:59"),
    ("上个月第二周", "span accurate 2022-02-14 00:00:00 2022-02-20 23:59:59"),
    ("5月第三周", "span accurate 2022-05-16 00:00:00 2022-05-22 23:59:59"),
    ("2019年6月第一周", "span accurate 2019-06-03 00:00:00 2019-06-09 23:59:59"),
    ("去年10月第二周", "span accurate 2021-10-11 00:00:00 2021-10-17 23:59:59"),
    ("今年第十周", "span accurate 2022-03-07 00:00:00 2022-03-13 23:59:59"),
    ("2021年第五周", "span accurate 2021-02-01 00:00:00 2021-02-07 23:59:59"),
    ("下下周", "point blur 2022-03-21 00:00:00 2022-03-27 23:59:59"),
    ("上周五", "point accurate 2022-03-04 00:00:00 2022-03-04 23:59:59"),
    ("星期三", "point accurate 2022-03-09 00:00:00 2022-03-09 23:59:59"),
    ("前两周", "point blur 2022-02-21 00:00:00 2022-03-09 23:59:59"),
    ("去年底", "span blur 2021-11-01 00:00:00 2021-12-31 23:59:59"),
    ("上月末", "point accurate 2022-02-25 00:00:00 2022-02-28 23:59:59"),
    ("本月前三天", "point accurate 2022-03-01 00:00:00 2022-03-03 23:59:59"),
    ("下个月8号", "point accurate 2022-04-08 00:00:00 2022-04-08 23:59:59"),
    ("上上个月", "point accurate 2022-01-01 00:00:00 2022-01-31 23:59:59"),
    ("7月最后两天", "point accurate 2022-07-30 00:00:00 2022-07-31 23:59:59"),
    ("2013年上半年", "span blur 2013-01-01 00:00:00 2013-06-30 23:59:59"),
    ("20世纪七十年代", "span blur 1970-01-01 00:00:00 1979-12-31 23:59:59"),
    ("今年前四个月", "span accurate 2022-01-01 00:00:00 2022-04-30 23:59:59"),
    ("2014年前两个月", "span accurate 2014-01-01 00:00:00 2014-02-28 23:59:59"),
    ("2020年第60天", "point accurate 2020-02-29 00:00:00 2020-02-29 23:59:59"),
    ("第3年", "span blur 2024-01-01 00:00:00 2024-12-31 23:59:59"),
    ("第5天", "point accurate 2022-03-13 00:00:00 2022-03-13 23:59:59"),
    ("现在", "point accurate 2022-03-09 10:20:30 2022-03-09 10:20:30"),
    ("未来三天", "span accurate 2022-03-09 10:20:30 2022-03-12 10:20:30"),
    ("过去六个月", "span blur 2021-09-07 00:00:00 2022-03-09 10:20:30"),
    ("再过两周", "span blur 2022-03-23 00:00:00 inf"),
    ("五个工作日后", "point accurate 2022-03-16 00:00:00 2022-03-16 23:59:59"),
    ("9天前", "point accurate 2022-02-28 00:00:00 2022-02-28 23:59:59"),
    ("三周后", "point blur 2022-03-28 00:00:00 2022-04-03 23:59:59"),
    ("四个月前", "span blur 2021-11-01 00:00:00 2021-11-30 23:59:59"),
    ("两个季度后", "span blur 2022-09-01 00:00:00 2022-09-30 23:59:59"),
    ("六年前", "span blur 2016-01-01 00:00:00 2016-12-31 23:59:59"),
    ("明年元旦", "point accurate 2023-01-01 00:00:00 2023-01-01 23:59:59"),
    ("去年中秋节", "point accurate 2021-09-21 00:00:00 2021-09-21 23:59:59"),
    ("2019年端午节", "point accurate 2019-06-07 00:00:00 2019-06-07 23:59:59"),
    ("今年母亲节", "point accurate 2022-05-08 00:00:00 2022-05-08 23:59:59"),
    ("2018年父亲节", "point accurate 2018-06-17 00:00:00 2018-06-17 23:59:59"),
    ("农历今年三月初五", "point accurate 2022-04-05 00:00:00 2022-04-05 23:59:59"),
    ("去年11月23日", "point accurate 2021-11-23 00:00:00 2021-11-23 23:59:59"),
    ("三十几年前", "span blur 1982-01-01 00:00:00 1992-12-31 23:59:59"),
    ("大后天", "point accurate 2022-03-12 00:00:00 2022-03-12 23:59:59"),
    ("2020年教师节", "point accurate 2020-09-10 00:00:00 2020-09-10 23:59:59"),
    ("农历2016年腊月廿三", "point accurate 2017-01-20 00:00:00 2017-01-20 23:59:59"),
    ("2012年12月21日", "point accurate 2012-12-21 00:00:00 2012-12-21 23:59:59"),
    ("2008年", "point accurate 2008-01-01 00:00:00 2008-12-31 23:59:59"),
    ("今明两天", "span accurate 2022-03-09 00:00:00 2022-03-10 23:59:59"),
    ("两三天前", "span blur 2022-03-06 00:00:00 2022-03-07 23:59:59"),
    ("30秒后", "point accurate 2022-03-09 10:21:00 2022-03-09 10:21:01"),
    ("12分钟前", "point accurate 2022-03-09 10:07:30 2022-03-09 10:08:30"),
    ("三刻钟后", "point accurate 2022-03-09 11:05:30 2022-03-09 11:20:30"),
    ("5小时前", "point accurate 2022-03-09 04:20:30 2022-03-09 05:20:30"),
    ("下午三四点", "span blur 2022-03-09 15:00:00 2022-03-09 16:59:59"),
    ("晚上7点25分", "point accurate 2022-03-09 19:25:00 2022-03-09 19:25:59"),
    ("16:45:10", "point accurate 2022-03-09 16:45:10 2022-03-09 16:45:10"),
    ("上午九点一刻", "point accurate 2022-03-09 09:15:00 2022-03-09 09:15:59"),
    ("凌晨", "point blur 2022-03-09 00:00:00 2022-03-09 04:59:59"),
    ("2011年3月到2012年5月", "span accurate 2011-03-01 00:00:00 2012-05-31 23:59:59"),
    ("明天上午9点至11点", "span accurate 2022-03-10 09:00:00 2022-03-10 11:00:00"),
    ("2024年以前", "span accurate 2022-03-09 10:20:30 2024-12-31 23:59:59"),
    ("2020年以来", "span accurate 2020-01-01 00:00:00 2022-03-09 10:20:30"),
    ("自2019年6月起", "span accurate 2019-06-01 00:00:00 2022-03-09 10:20:30"),
    ("每两周", 'period accurate {"day":14.0}'),
    ("每个工作日上午10点", 'period accurate 2022-03-09 10:00:00 2022-03-09 10:59:59 {"day":1.0}'),
    ("每月15号", 'period accurate 2022-03-15 00:00:00 2022-03-15 23:59:59 {"month":1.0}'),
    ("三个半小时", 'delta accurate {"hour":3.5}'),
    ("2到5天", 'delta blur {"day":2.0} {"day":5.0}'),
    ("10年以上", 'delta blur {"year":10.0} {"infinite":1.0}'),
    ("4年以上8年以下", 'delta blur {"year":4.0} {"year":8.0}'),
    ("7天6晚", 'delta accurate {"day":7.0}'),
    ("一万两千秒", 'delta accurate {"second":12000.0}'),
    ("后天中午12点半", "point accurate 2022-03-11 12:30:00 2022-03-11 12:30:59"),
    ("八月十五", "point accurate 2022-09-10 00:00:00 2022-09-10 23:59:59"),
    ("下周二下午4点", "point accurate 2022-03-15 16:00:00 2022-03-15 16:59:59"),
    ("今年", "span accurate 2022-01-01 00:00:00 2022-12-31 23:59:59"),
    ("3月", "point accurate 2022-03-01 00:00:00 2022-03-31 23:59:59"),
    ("10月2日凌晨3点20分", "point accurate 2022-10-02 03:20:00 2022-10-02 03:20:59"),
]
case("time_phrases", _time, TIMES)


def _time_spans(c: Column) -> Column:
    return _spans(times.extract_time(c, BASE))


case("time_extracts", _time_spans, [
    ("会议改到3月12日下午两点，地点不变。", "3月12日下午两点:4:13"),
    ("他去年秋天来过，明年元旦再来", "去年秋天:1:5|明年元旦:8:12"),
    ("没有什么可说的", ""),
    ("2019年5月到2020年6月之间完工", "2019年5月到2020年6月之间:0:17"),
])

# a Wednesday: the next Saturday is the 12th, the working days of two weeks are 9-11, 14-18, 21 and 22
case("times_recurring", lambda c: F.array_join(F.transform(times.recurrences(c, BASE, 2), lambda x: x["start"]), "|"), [
    ("每周六上午9点", "2022-03-12 09:00:00|2022-03-19 09:00:00"), ("每年春节", "2022-02-01 00:00:00|2023-01-22 00:00:00"), ("每月15号", "2022-03-15 00:00:00|2022-04-15 00:00:00"),
    ("每天晚上8点", "2022-03-09 20:00:00|2022-03-10 20:00:00"),
    ("每个工作日9点", "|".join(f"2022-03-{d:02} 09:00:00" for d in (9, 10, 11, 14, 15, 16, 17, 18, 21, 22))), ("明天", ""),
])
case("times_ahead", lambda c: times.parse_time(c, BASE, future=True)["start"], [("周一", "2022-03-14 00:00:00"), ("8点", "2022-03-10 08:00:00"), ("下午三点", "2022-03-09 15:00:00")])
case("times_solar", lambda c: times.parse_time(c, BASE, lunar_dates=False)["start"], [("四月十三", "2022-04-13 00:00:00"), ("八月十五日", "2022-08-15 00:00:00"), ("正月十五", "2022-02-15 00:00:00")])


# -- money ------------------------------------------------------------------------------
def _money(c: Column) -> Column:
    v = money.parse_money(c)
    return F.concat_ws(" ", v["lo"], v["hi"], v["currency"], v["definition"])


case("money_phrases", _money, [
    ("38.5元", "38.50 38.50 元 accurate"), ("6,200.75元", "6200.75 6200.75 元 accurate"), ("三百四十五元", "345.00 345.00 元 accurate"),
    ("一千零八元六角", "1008.60 1008.60 元 accurate"), ("七万五千元整", "75000.00 75000.00 元 accurate"), ("2亿元", "200000000.00 200000000.00 元 accurate"),
    ("3.6万美元", "36000.00 36000.00 美元 accurate"), ("五十万港币", "500000.00 500000.00 港元 accurate"), ("40英镑", "40.00 40.00 英镑 accurate"),
    ("九百日元", "900.00 900.00 日元 accurate"), ("两千欧元", "2000.00 2000.00 欧元 accurate"), ("4万卢布", "40000.00 40000.00 卢布 accurate"),
    ("1.2亿韩元", "120000000.00 120000000.00 韩元 accurate"), ("15000人民币", "15000.00 15000.00 元 accurate"), ("八毛", "0.80 0.80 元 accurate"),
    ("六万三", "63000.00 63000.00 元 accurate"), ("两百五", "250.00 250.00 元 accurate"), ("约8000元", "8000.00 8000.00 元 blur"),
    ("近三百万元", "3000000.00 3000000.00 元 blur-"), ("不超过9000元", "9000.00 9000.00 元 blur-"), ("至少1万元", "10000.00 10000.00 元 blur+"),
    ("50元左右", "50.00 50.00 元 blur"), ("六十多万元", "600000.00 700000.00 元 blur"), ("3万多元", "30000.00 40000.00 元 blur"), ("300余元", "300.00 400.00 元 blur"),
    ("几千元", "1000.00 10000.00 元 blur"), ("二三十元", "20.00 30.00 元 blur"), ("七八百元", "700.00 800.00 元 blur"),
    ("3-5万元", "30000.00 50000.00 元 blur"), ("100到200美元", "100.00 200.00 美元 blur"), ("三万至四万港元", "30000.00 40000.00 港元 blur"),
])
case("money_extracts", lambda c: _spans(money.extract_money(c)), [
    ("总价三百四十五元，另付3.6万美元定金", "三百四十五元:2:8|3.6万美元:11:17"), ("退回20元5角。", "20元5角:2:7"), ("没有提到价钱", ""),
])

# -- text -------------------------------------------------------------------------------
case("ip_removed", text.remove_ip, [("主机192.168.10.7已断", "主机已断"), ("版本1.2.3", "版本1.2.3"), ("255.255.255.0;8.8.8.8", ";"), ("256.1.1.1", "256.1.1.1")])
case("id_card_removed", text.remove_id_card, [("证件11010519491231002X。", "证件。"), ("编号110105194912310021号", "编号号"), ("1101051949", "1101051949")])
case("qq_removed", text.remove_qq, [("加QQ：800123456吧", "加QQ：吧"), ("订单800123456", "订单800123456"), ("qq 12", "qq 12")])
case("chinese_replaced", text.replace_chinese, [("abc中文def", "abc  def"), ("no", "no"), ("全部", "  "), ("a中b国c", "a b c")])
case("town_aliases", text.town_alias, [("城关镇", "城关"), ("青山乡", "青山"), ("马家堡街道", "马家堡"), ("东村", "东村")])
case("landlines", lambda c: F.to_json(text.phone_info(c)), [
    ("010-62551234", '{"type":"landline_phone","area_code":"010"}'), ("（0571）88665544", '{"type":"landline_phone","area_code":"0571"}'),
    ("13812345678", '{"type":"cell_phone","prefix7":"1381234"}'), ("12345", '{"type":"unknown"}'),
])
case("formal_numerals", text.number_to_chinese, [
    ("0", "零"), ("7", "柒"), ("10", "壹拾"), ("305", "叁佰零伍"), ("12345.67", "壹萬贰仟叁佰肆拾伍點陆柒"), ("20000", "贰萬"), ("100200", "壹拾萬零贰佰"), ("x", None),
])
case("plain_numerals", lambda c: text.number_to_chinese(c, "plain"), [("15", "十五"), ("120034", "十二万零三十四"), ("300000000", "三亿"), ("2.50", "二点五")])
case("sentences", lambda c: _list(udfs.split_sentences(c)), [
    ("今天下雨。我们不去了！你呢？", "今天下雨。|我们不去了！|你呢？"), ("没有标点", "没有标点"), ("他喊：“快走！”然后跑了。", "他喊：“快走！”|然后跑了。"),
])
case("fine_sentences", lambda c: _list(udfs.split_sentences(c, True)), [("先说，再做；最后看。", "先说，|再做；|最后看。")])
case("brackets", lambda c: _list(F.transform(udfs.extract_brackets(c), lambda b: b["text"])), [("（一）乙【丙（丁）】", "（一）|（丁）|【丙（丁）】"), ("(未闭", "")])
case("entities_unescaped", udfs.unescape, [("&lt;a&amp;b&gt; &eacute;&#20013;", "<a&b> é中"), ("a & b", "a & b")])
case("menus_cut", udfs.cut_menus, [
    ('<p>a</p><div id="menu"><div>x</div></div><p>b</p>', "<p>a</p><p>b</p>"), ('<div class="text">a</div>', '<div class="text">a</div>'),
])
case("meta_tags", lambda c: F.to_json(text.meta_info(c)), [
    ('<meta name="keywords" content="甲,乙"><meta content="zh" name="language">', '{"keywords":"甲,乙","language":"zh"}'), ("<p>x</p>", "{}"),
])
case("moods", lambda c: F.format_string("%.4f", udfs.sentiment(c, {"喜欢": 1.0, "讨厌": -1.0}, ["不"], {"非常": 2.0})), [
    ("我喜欢", "0.7311"), ("我不喜欢", "0.1192"), ("我非常喜欢", "0.8808"), ("我讨厌", "0.1192"), ("天晴", "0.5000"), ("", "0.5000"), ("我喜欢。我讨厌。", "0.3775"),
])
case("pinyin_standard", lambda c: _list(chars.pinyin(c, {"银行": ["yín", "háng"]}, {"行": ["xíng", "háng"], "绿": ["lǜ"], "啊": ["a"]})), [("银行行", "yín|háng|xíng"), ("绿a啊", "lǜ|<py_unk>|a"), ("", "")])
case("pinyin_simple", lambda c: _list(chars.pinyin(c, {"银行": ["yín", "háng"]}, {"行": ["xíng"], "绿": ["lǜ"], "啊": ["a"]}, "simple")), [("银行行", "yin2|hang2|xing2"), ("绿a啊", "lv4|<py_unk>|a5")])
case("pinyin_parts", lambda c: _list(F.transform(chars.pinyin(c, {}, {"中": ["zhōng"], "安": ["ān"], "略": ["lüè"]}, "detail"), lambda x: F.concat_ws("+", x["consonant"], x["vowel"], x["tone"]))), [
    ("中安", "zh+ong+1|+an+1"), ("略?", "l+ve+4|++"),
])
case("character_parts", lambda c: _list(F.transform(chars.radicals(c, {"河": ("氵", "左右结构", "31120", "441251", "ISKG")}), lambda x: F.concat_ws(",", x["radical"], x["structure"], x["corner_coding"]))), [
    ("河?", "氵,左右结构,31120|<cr_unk>,一体结构,00000"),
])
case("grades", lambda c: services.grade_value(c), [("85分", "85.0"), ("得分：7.5", "7.5"), ("八十五点五分", "85.5"), ("三分", "3.0"), ("一百二十分", None), ("不知道", None)])

# -- words, tags, spans -----------------------------------------------------------------
case("words_corrected", lambda c: _list(lexicon.resegment(c, ["区块链", "有条不紊"])), [('["学习","区","块链","。"]', "学习|区块链|。"), ('["有条","不","紊乱"]', "有条不紊|乱"), ('["其他"]', "其他")], "array<string>")
case("tags_corrected", lambda c: _words(lexicon.retag(c, {"区块链": "n", "有条不紊": "i"})), [
    ('[{"word":"学习","pos":"v"},{"word":"区","pos":"s"},{"word":"块链","pos":"n"},{"word":"。","pos":"w"}]', "学习/v 区块链/n 。/w"),
    ('[{"word":"有条","pos":"n"},{"word":"不","pos":"d"},{"word":"紊乱","pos":"a"}]', "有条不紊/i 乱/a"),
], TOKENS)
case("tags_of_words", lambda c: _list(tags.pos_to_tags(c)), [('[{"word":"学习","pos":"v"},{"word":"了","pos":"u"}]', "B-v|I-v|B-u"), ("[]", "")], TOKENS)
case("words_of_tags", lambda c: _words(tags.tags_to_pos(F.array_join(F.transform(c, lambda t: t["word"]), ""), tags.pos_to_tags(c))), [('[{"word":"学习","pos":"v"},{"word":"了","pos":"u"}]', "学习/v 了/u")], TOKENS)


def _sentence() -> Column:
    return F.array(*[F.lit(w) for w in ("中国", "银行", "开会")])


case("spans_in_words", lambda c: _spans(tags.char_to_word_spans(c, _sentence())), [
    ('[{"text":"中国银行","start":0,"end":4,"type":"org"},{"text":"行开","start":3,"end":5,"type":"x"}]', "中国银行:0:2"), ('[{"text":"开会","start":4,"end":6,"type":"x"}]', "开会:2:3"),
], SPANS)
case("spans_in_characters", lambda c: _spans(tags.word_to_char_spans(c, _sentence())), [('[{"text":"中国银行","start":0,"end":2,"type":"org"},{"text":"开会","start":2,"end":3,"type":"x"}]', "中国银行:0:4|开会:4:6")], SPANS)


def _sizes(batch: list) -> list[list[str]]:
    """A stand-in model: each token's label is the size of the part it came in."""
    return [[str(len(ts))] * len(ts) for ts in batch]


_TOKENS = [('["a","b","。","c","d","e","。","f"]', "3|3|3|4|4|4|4|1"), ('["a"]', "1"), ("[]", "")]
case("labels_by_sentences", None, _TOKENS, "array<string>", lambda df: batching.by_sentences(df, "x", _sizes, longest=4).withColumn("result", _list(F.col("tags"))))
case("labels_by_length", None, [(g, "|".join([str(g.count('"') // 2)] * (g.count('"') // 2))) for g, _ in _TOKENS], "array<string>", lambda df: batching.by_length(df, "x", _sizes).withColumn("result", _list(F.col("tags"))))

# -- augmentation, where only one outcome is possible --------------------------------------
case("homophones", lambda c: _list(augment.homophones(c, {"权利": ["权力"], "形式": ["形势"]}, ratio=1.0)), [('["维护","权利"]', "维护权力"), ('["形式","好"]', "形势好"), ('["其他"]', "")], "array<string>")


def _renamed(c: Column) -> Column:
    return F.array_join(F.transform(augment.replace_entities(F.lit("张三在成都"), c, {"per": ["欧阳修"], "loc": ["北京"]}, ratio=1.0), lambda r: F.concat_ws(" ", r["text"], _spans(r["entities"]))), ";")


case("entities_replaced", _renamed, [
    ('[{"text":"张三","start":0,"end":2,"type":"per"},{"text":"成都","start":3,"end":5,"type":"loc"}]', "欧阳修在北京 欧阳修:0:3|北京:4:6"),
    ('[{"text":"张三","start":0,"end":2,"type":"per"}]', "欧阳修在成都 欧阳修:0:3"), ("[]", ""),
], SPANS)


def _next_idiom(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    idioms = spark.createDataFrame([("道阻且长", 5), ("长命百岁", 9), ("长话短说", 3), ("岁寒三友", 4)], "idiom string, freq long")
    used = spark.createDataFrame([("长话短说",)], "idiom string")
    return augment.next_idioms(df.select(F.col("given").alias("id"), F.col("given").alias("idiom")), idioms, used).select(F.col("id").alias("given"), F.col("next").alias("result"))


case("next_idioms", None, [("道阻且长", "长命百岁"), ("长命百岁", "岁寒三友"), ("岁寒三友", None)], frame=_next_idiom)

# -- phrases ------------------------------------------------------------------------------
_DIC = phrases.Words(idf={"火箭": 3.0, "发射": 2.0, "成功": 1.0}, stopwords=frozenset("的"))
_TEXT = '[[{"word":"火箭","pos":"n"},{"word":"发射","pos":"v"}],[{"word":"的","pos":"u"},{"word":"成功","pos":"v"}]]'
_NESTED = f"array<{TOKENS}>"
# each word is a third of the words: 1 for 火箭, 2/3 for 发射, 1/3 for 成功; a pair counts 5.6 times their sum
case("key_phrases", lambda c: F.array_join(F.transform(phrases.extract_keyphrases(c, _DIC), lambda p: F.concat(p["phrase"], F.format_string(" %.3f", p["weight"]))), "|"), [(_TEXT, "火箭发射 9.333|成功 0.333"), ("[]", "")], _NESTED)
case("key_phrases_strict", lambda c: F.array_join(F.transform(phrases.extract_keyphrases(c, _DIC, rule=phrases.strict), lambda p: F.concat(p["phrase"], F.format_string(" %.3f", p["weight"]))), "|"), [(_TEXT, "火箭 1.000")], _NESTED)
# means: (1 + 2/3) / 2 and 1/3, both short and among the first three
case("summaries", lambda c: phrases.extract_summary(c, _DIC, length=4), [(_TEXT, "火箭发射")], _NESTED)
case("summaries_whole", lambda c: phrases.extract_summary(c, _DIC), [(_TEXT, "火箭发射的成功")], _NESTED)


# -- places, calendar ------------------------------------------------------------------------
def _recognised(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    home = spark.createDataFrame([("四川省", None, None, ["四川"]), ("四川省", "成都市", None, ["成都"])], "province string, city string, county string, aliases array<string>")
    world = spark.createDataFrame([("斯里兰卡", "科伦坡", ["锡兰"]), ("法国", "巴黎", [])], "country string, city string, aliases array<string>")
    found = places.recognise_locations(df, "given", "x", home, world=world)
    line = F.concat_ws(" ", "kind", "province", "city", "country", "name", "n")
    return found.groupBy(F.col("id").alias("given")).agg(F.array_join(F.array_sort(F.collect_list(line)), "|").alias("result"))


_NS = lambda *ws: "[" + ",".join(f'{{"word":"{w}","pos":"ns"}}' for w in ws) + "]"
case("places_recognised", None, [
    (_NS("四川", "成都", "科伦坡", "锡兰", "某地", "某地"), "domestic 四川省 成都市 2|foreign 科伦坡 斯里兰卡 2|other 某地 2"), (_NS("巴黎市"), "foreign 巴黎 法国 1"),
], TOKENS, _recognised)


def _lunar(df: DataFrame) -> DataFrame:
    return calendar.solar_to_lunar(df.withColumn("day", F.col("x").cast("date")), "day").withColumn("result", calendar.lunar_text("lunar"))


case("lunar_names", None, [("2022-02-01", "二零二二年正月初一 壬寅年 (虎年)"), ("2020-06-25", "二零二零年五月初五 庚子年 (鼠年)"), ("2021-02-11", "二零二零年腊月三十 庚子年 (鼠年)"), ("2020-05-25", "二零二零年闰四月初三 庚子年 (鼠年)")], frame=_lunar)


# -- readers and writers, over whole tables ---------------------------------------------------
def _query(sql: str):
    def add(fn):
        QUERIES[fn.__name__], SQL[fn.__name__] = fn, sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("SELECT conv_id, turn, md5(text) AS digest FROM conversations")
def lines_written_and_read(spark, sf_dir):
    """Rows as JSON lines, and back."""
    path = fresh_dir(spark, "lines")
    files.write_lines(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), path)
    back = files.read_lines(spark, path).select(F.from_json("value", "conv_id long, turn long, text string").alias("r"))
    return back.select("r.conv_id", "r.turn", F.md5("r.text").alias("digest"))


@_query("SELECT r_name AS archive, n_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def archives_written_and_read(spark, sf_dir):
    path = fresh_dir(spark, "archives")
    rows = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    files.write_zips(rows, path, "r_name", "n_nationkey", "n_name")
    return files.read_zips(spark, path).select(F.col("name").alias("archive"), "value")


@_query("SELECT DISTINCT word FROM (SELECT r_name AS word FROM region UNION ALL SELECT 'ASIA' UNION ALL SELECT 'extra')")
def words_read(spark, sf_dir):
    path = fresh_dir(spark, "words")
    files.write_lines(_table(spark, sf_dir, "region").select("r_name"), path)
    return files.read_words(spark, path, ("ASIA", "extra"))


@_query("SELECT n_name AS gram, n_nationkey::BIGINT * 3 AS freq FROM nation")
def counts_read(spark, sf_dir):
    path = fresh_dir(spark, "counts")
    lines = _table(spark, sf_dir, "nation").select(F.to_json(F.array("n_name", (F.col("n_nationkey") * 3).cast("string"))).alias("line"))
    files.write_lines(lines, path)
    return files.read_counts(spark, path)


@_query("SELECT n_nationkey::BIGINT AS code, n_name AS name FROM nation")
def delimited_table_read(spark, sf_dir):
    path = fresh_dir(spark, "table")
    files.write_lines(_table(spark, sf_dir, "nation").select(F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name").alias("line")), path)
    return files.read_table(spark, path, "code long, name string")


@_query("SELECT r_name AS section, n_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def sections_read(spark, sf_dir):
    """One file of headed parts, in order."""
    path = fresh_dir(spark, "sections")
    rows = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = rows.select("n_regionkey", F.lit(1).alias("k"), F.col("n_name").alias("line"))
    head = _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.lit(0).alias("k"), F.concat("r_name", F.lit(":")).alias("line"))
    files.write_lines(head.union(body).coalesce(1).sortWithinPartitions("n_regionkey", "k", "line").select("line"), path)
    return files.read_sections(spark, path).select("section", "value")


@_query("SELECT r_name AS l0, n_name AS l1 FROM nation JOIN region ON n_regionkey = r_regionkey")
def outline_read(spark, sf_dir):
    """One file indented by tabs: names with those above them."""
    path = fresh_dir(spark, "outline")
    rows = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = rows.select("n_regionkey", F.lit(1).alias("k"), F.concat(F.lit("\t"), "n_name").alias("line"))
    head = _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.lit(0).alias("k"), F.col("r_name").alias("line"))
    files.write_lines(head.union(body).coalesce(1).sortWithinPartitions("n_regionkey", "k", "line").select("line"), path)
    return files.read_outline(spark, path).where("depth = 1").select("l0", "l1")


@_query("SELECT '139' || lpad((n_nationkey + i)::VARCHAR, 4, '0') AS code FROM nation, (SELECT unnest(range(0, 3)) AS i)")
def number_ranges_expanded(spark, sf_dir):
    ranges = _table(spark, sf_dir, "nation").select(F.lit("139").alias("prefix"), F.concat_ws("-", F.col("n_nationkey").cast("string"), (F.col("n_nationkey") + 2).cast("string")).alias("ranges"))
    return files.expand_prefixes(ranges).select("code")


@_query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 40 OFFSET 10")
def rows_sliced(spark, sf_dir):
    """Rows 10 to 50 of the orders: a head-N of a file."""
    return files.slice_rows(_table(spark, sf_dir, "orders"), "o_orderkey", 10, 50).select("o_orderkey")


# -- services, with stand-ins -------------------------------------------------------------------
_MODELS = {"loud": lambda: lambda q: q.upper() + "!", "short": lambda: lambda q: q[:2]}


@_query("SELECT n_nationkey::BIGINT AS question_id, model, CASE model WHEN 'loud' THEN upper(n_name) || '!' ELSE substr(n_name, 1, 2) END AS answer FROM nation, (VALUES ('loud'), ('short')) AS m(model)")
def models_asked(spark, sf_dir):
    questions = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("question_id"), F.col("n_name").alias("question"))
    return services.ask_models(questions, _MODELS).select("question_id", "model", "answer")


@_query("SELECT n_nationkey::BIGINT AS question_id, graded, (length(n_name) % 10)::DOUBLE AS grade FROM nation, (VALUES ('a'), ('b')) AS m(graded)")
def answers_graded(spark, sf_dir):
    """A stand-in grader that finds a number in words, over each answer of each model."""
    answers = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("question_id"), F.col("n_name").alias("answer"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model"))
    graded = services.grade_answers(answers, {"g": lambda: lambda x: f"得分：{len(x) % 10}分"})
    return graded.select("question_id", "graded", services.grade_value("grade").alias("grade"))


# -- datasets ---------------------------------------------------------------------------------
@_query("SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang")
def split_totals(spark, sf_dir):
    """A split loses nothing: the parts of each label sum up to it."""
    report = datasets.analyse(_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang")[1]
    return report.groupBy("label").agg(F.sum("n").alias("n"))


@_query("SELECT 'o' AS label, count(*) AS n FROM nation UNION ALL SELECT r, count(*) FROM (SELECT 'r' || n_regionkey AS r FROM nation) GROUP BY r")
def split_totals_of_entities(spark, sf_dir):
    span = lambda kind: F.struct(F.lit("x").alias("text"), F.lit(0).alias("start"), F.lit(1).alias("end"), kind.alias("type"))
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", F.array(span(F.lit("o")), span(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))).alias("entities"))
    return datasets.analyse_entities(rows, "n_nationkey")[1].groupBy("label").agg(F.sum("n").alias("n"))


@_query("SELECT g.v AS graded, sum((n_nationkey % 4 + g.k)::DOUBLE) AS score FROM nation, (VALUES ('x', 1), ('y', 2), ('z', 3)) AS g(v, k) GROUP BY g.v")
def models_graded_alike(spark, sf_dir):
    """Where all graders agree, weights don't matter."""
    return datasets.grade_models(_scores(spark, sf_dir))[0]


@_query("SELECT g.v AS graded, sum((n_nationkey % 4 + g.k)::DOUBLE) AS score FROM nation, (VALUES ('x', 1), ('y', 2), ('z', 3)) AS g(v, k) GROUP BY g.v")
def models_graded_by_question(spark, sf_dir):
    return datasets.grade_models_by_question(_scores(spark, sf_dir))[0]


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(a).alias("grader"), F.lit(b).alias("graded"), F.lit(k).alias("k")) for a in "xyz" for k, b in enumerate("xyz", 1)])
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("question"), F.explode(pairs).alias("p"))
    return rows.select("p.grader", "p.graded", "question", (F.col("question") % 4 + F.col("p.k")).cast("double").alias("score"))


@_query("SELECT 0.5::DOUBLE AS precision, round(1 / 3, 6)::DOUBLE AS recall, 0.4::DOUBLE AS f1")
def word_measures(spark, sf_dir):
    """The same sentence for each nation: one of two words found is one of three."""
    w = lambda *ws: F.array(*[F.lit(x) for x in ws])
    rows = _table(spark, sf_dir, "nation").select(w("今", "天", "下雨").alias("gold"), w("今天", "下雨").alias("pred"))
    return datasets.word_measures(rows).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@_query("""
SELECT event_type, user_id, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS k FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY event_type, user_id)) WHERE k <= 3""")
def top_of_each(spark, sf_dir):
    counts = _table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return new_words.top(counts, "event_type", [F.desc("n"), F.col("user_id")], 3)


@_query("""
SELECT n_nationkey, CAST(TIMESTAMP '2024-03-01 09:00:00' + to_days(7 * i) AS VARCHAR) AS at FROM nation, (SELECT unnest(range(0, 4))::INT AS i)""")
def recurring_times(spark, sf_dir):
    rows = _table(spark, sf_dir, "nation").selectExpr("n_nationkey", "TIMESTAMP_NTZ '2024-03-01 09:00:00' AS a", "TIMESTAMP_NTZ '2024-03-24 00:00:00' AS b")
    return dedup.recurring(rows, "a", "b", "7 days").select("n_nationkey", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


# -- streams, run to the end of the table --------------------------------------------------------
def _drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """What a stream has written when its source is used up."""
    out, state = fresh_dir(spark, "stream"), fresh_dir(spark, "stream-state")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    else:
        stream.writeStream.outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's file as a stream: it is copied to a folder of its own, since streams read folders."""
    folder = fresh_dir(spark, f"stream-{name}")
    df = _table(spark, sf_dir, name)
    df.write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


@_query("SELECT DISTINCT event_type FROM events")
def stream_first_of_each(spark, sf_dir):
    rows = _stream(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return _drained(spark, dedup.first_of_each(rows, "event_type", "ts", "4000 days"), "append").select("event_type")


@_query(r"""
WITH r AS (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{N}\p{Pc}]+')) AS r FROM conversations),
g AS (SELECT substr(r, i, n) AS gram FROM (SELECT r, unnest(range(1, length(r) + 1)) AS i FROM r), (SELECT unnest(range(1, 3)) AS n) WHERE i + n - 1 <= length(r))
SELECT gram, count(*) AS freq FROM g GROUP BY gram""")
def stream_ngram_counts(spark, sf_dir):
    return _drained(spark, dedup.ngram_counts(_stream(spark, sf_dir, "conversations"), "text", 2), "complete")


@_query("SELECT c_custkey AS id, c_custkey - 1 AS match FROM customer WHERE c_custkey % 2 = 1 AND c_custkey > 1 AND c_custkey - 1 IN (SELECT c_custkey FROM customer)")
def stream_near_copies(spark, sf_dir):
    """Customers in pairs: the odd one's fingerprint is that of the even one before it but for one bit, and comes later."""
    mixed = F.xxhash64((F.col("c_custkey") - F.col("c_custkey") % 2).alias("k"))
    rows = _table(spark, sf_dir, "customer").where("c_custkey > 1").select(
        F.col("c_custkey").alias("id"), mixed.bitwiseXOR(F.col("c_custkey") % 2).alias("fp"), (F.lit(1_600_000_000) + F.col("c_custkey")).cast("timestamp").alias("at")
    )
    folder = fresh_dir(spark, "stream-fingerprints")
    rows.write.parquet(folder)
    found = dedup.near_copies(spark.readStream.schema(rows.schema).parquet(folder), "id", "fp", "at", 3)
    return _drained(spark, found, "append").groupBy("id").agg(F.min("match").alias("match"))
