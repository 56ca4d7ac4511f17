"""Times in Chinese texts: points, spans, durations and periods, against a given base time.

A text is cut into a date part and a clock part; every date form is one rule, a
pattern of the whole part with a function of (match, base) to a range of days. The
longest date part that leaves a clock form or nothing wins. Durations use fixed
lengths (a year 365 days, a month 30.417). Nothing is kept between calls.

Grammar work, so Arrow batches of a worker; texts without a time character are
turned away by a native filter before.
"""

from __future__ import annotations

import calendar as days_of
import re
from collections.abc import Callable
from datetime import date, datetime, timedelta
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphline.operators import calendar as lunar

N = "(?:[0-9]+|[零〇一二两俩三仨四五六七八九十百廿卅]+)"
Y4 = "(?:[0-9]{4}|[0-9]{2}|[零〇一二三四五六七八九]{2,4})"
# Words of relative years, months and days, parts of the day, festivals.
YEAR_WORDS = {"大前年": -3, "前年": -2, "前一年": -1, "去年": -1, "上一年": -1, "上年": -1, "今年": 0, "本年度": 0, "本年": 0, "这一年": 0, "同年": 0, "当年": 0, "明年": 1, "次年": 1, "下一年": 1, "来年": 1, "后年": 2, "大后年": 3}
DAY_WORDS = {"大大前天": -4, "大前天": -3, "前天": -2, "前日": -2, "昨天": -1, "昨日": -1, "昨": -1, "今天": 0, "今日": 0, "当天": 0, "当日": 0, "本日": 0, "同日": 0, "全天": 0, "今": 0, "明天": 1, "明日": 1, "次日": 1, "明": 1, "后天": 2, "后日": 2, "大后天": 3, "大大后天": 4}
CLOCK_WORDS = {
    "清晨": (5, 7), "清早": (5, 8), "大清早": (5, 8), "早上": (6, 9), "早晨": (6, 9), "一早": (6, 9), "一大早": (6, 9), "早": (6, 9), "黎明": (4, 6), "白天": (6, 18), "上午": (7, 11), "中午": (12, 13), "正午": (12, 13),
    "午后": (13, 14), "下午": (13, 17), "傍晚": (17, 18), "晚": (18, 23), "晚上": (18, 23), "晚间": (20, 23), "夜间": (20, 23), "夜里": (20, 23), "夜晚": (20, 23), "深夜": (23, 23), "上半夜": (0, 2), "前半夜": (0, 2),
    "下半夜": (2, 4), "后半夜": (2, 4), "半夜": (0, 4), "凌晨": (0, 4), "午夜": (0, 0),
}
SOLAR_DAYS = {"元旦": (1, 1), "情人节": (2, 14), "妇女节": (3, 8), "植树节": (3, 12), "愚人节": (4, 1), "劳动节": (5, 1), "五一": (5, 1), "青年节": (5, 4), "儿童节": (6, 1), "六一": (6, 1), "建党节": (7, 1), "建军节": (8, 1), "教师节": (9, 10), "国庆节": (10, 1), "国庆": (10, 1), "十一": (10, 1), "万圣节": (10, 31), "平安夜": (12, 24), "圣诞节": (12, 25), "圣诞": (12, 25)}
LUNAR_DAYS = {"春节": (1, 1), "大年初一": (1, 1), "元宵节": (1, 15), "元宵": (1, 15), "龙抬头": (2, 2), "端午节": (5, 5), "端午": (5, 5), "七夕": (7, 7), "七夕节": (7, 7), "中元节": (7, 15), "中秋节": (8, 15), "中秋": (8, 15), "重阳节": (9, 9), "重阳": (9, 9), "腊八节": (12, 8), "腊八": (12, 8), "小年": (12, 23), "除夕": (12, 30), "大年三十": (12, 30), "年三十": (12, 30)}
WEEKDAY_FEASTS = {"母亲节": (5, 6, 2), "父亲节": (6, 6, 3), "感恩节": (11, 3, 4)}
UNIT_DAYS = {"年": 365.0, "周年": 365.0, "季度": 91.251, "月": 30.417, "周": 7.0, "星期": 7.0, "礼拜": 7.0, "天": 1.0, "日": 1.0, "小时": 1 / 24, "钟头": 1 / 24, "刻钟": 1 / 96, "分钟": 1 / 1440, "分": 1 / 1440, "秒钟": 1 / 86400, "秒": 1 / 86400}
DELTA_KEYS = {"年": ("year", 1), "周年": ("year", 1), "季度": ("month", 3), "月": ("month", 1), "周": ("day", 7), "星期": ("day", 7), "礼拜": ("day", 7), "天": ("day", 1), "日": ("day", 1), "工作日": ("workday", 1), "交易日": ("workday", 1), "小时": ("hour", 1), "钟头": ("hour", 1), "刻钟": ("minute", 15), "分钟": ("minute", 1), "分": ("minute", 1), "秒钟": ("second", 1), "秒": ("second", 1)}

_DIGIT = {c: i for i, cs in enumerate(["零〇", "一", "二两俩", "三仨", "四", "五", "六", "七", "八", "九"]) for c in cs}


def number(s: str) -> int:
    """Value of digits, of positional Chinese digits, or of a numeral below a thousand."""
    if s.isdigit():
        return int(s)
    if not re.search("[十百廿卅]", s):
        return int("".join(str(_DIGIT[c]) for c in s))
    total, digit = 0, 0
    for c in s:
        if c == "百":
            total, digit = total + (digit or 1) * 100, 0
        elif c in "十廿卅":
            total, digit = total + {"十": digit or 1, "廿": 2, "卅": 3}[c] * 10, 0
        else:
            digit = _DIGIT[c]
    return total + digit


def full_year(s: str, base: datetime) -> int:
    y = number(s)
    if len(s) > 2:
        return y
    return y + 2000 if y + 2000 <= base.year + 10 else y + 1900


def _last(y: int, m: int) -> int:
    return days_of.monthrange(y, m)[1]


def month_range(y: int, a: int, b: int | None = None) -> tuple[date, date]:
    b = b or a
    return date(y, a, 1), date(y, b, _last(y, b))


def shift_month(y: int, m: int, k: int) -> tuple[int, int]:
    at = y * 12 + m - 1 + k
    return at // 12, at % 12 + 1


Range = tuple[date, date, str, str]
RULES: list[tuple[re.Pattern, Callable[[re.Match, datetime], Range]]] = []
POINT, SPAN = "time_point", "time_span"


def rule(pattern: str):
    def add(fn):
        RULES.append((re.compile(pattern), fn))
        return fn

    return add


def _words(d: dict) -> str:
    return "|".join(sorted(map(re.escape, d), key=len, reverse=True))


_YW = f"(?:(?P<yw>{_words(YEAR_WORDS)})|(?P<y>{Y4})年?|)"
_YF = f"(?:(?P<yw>{_words(YEAR_WORDS)})的?|(?P<y>{Y4})年的?|)"


def year_of(m: re.Match, base: datetime) -> int:
    if m["yw"]:
        return base.year + YEAR_WORDS[m["yw"]]
    return full_year(m["y"], base) if m["y"] else base.year


@rule(r"(?P<y>[12][0-9]{3})(?P<m>0[1-9]|1[0-2])(?P<d>[0-3][0-9])")
@rule(r"(?P<y>[0-9]{4})[-./·](?P<m>[0-9]{1,2})[-./·](?P<d>[0-9]{1,2})[日号]?")
def _ymd_digits(m, base):
    d = date(int(m["y"]), int(m["m"]), int(m["d"]))
    return d, d, POINT, "accurate"


@rule(r"(?P<a>[0-9]{1,4})[-./·](?P<b>[0-9]{1,2})(?P<day>[日号])?")
def _two_digits(m, base):
    a, b = int(m["a"]), int(m["b"])
    if len(m["a"]) == 4 and not m["day"]:
        return (*month_range(a, b), POINT, "accurate")
    d = date(base.year, a, b)
    return d, d, POINT, "accurate"


@rule(rf"{_YF}(?:8|八)月十五")
def _mid_autumn(m, base):
    d = lunar_date(year_of(m, base), 8, 15)
    return d, d, POINT, "accurate"


@rule(rf"{_YF}(?P<m>{N})月份?的?(?P<d>{N})[日号]?(?P<blur>左右|前后|许)?")
def _year_month_day(m, base):
    if not re.search("[0-9日号]", m[0]):
        raise ValueError("numerals without a word for the day name a lunar date")
    d = date(year_of(m, base), number(m["m"]), number(m["d"]))
    return d, d, POINT, "blur" if m["blur"] else "accurate"


@rule(rf"{_YF}(?P<m>{N})月份?(?P<blur>左右|前后|许)?")
def _year_month(m, base):
    span = month_range(year_of(m, base), number(m["m"]))
    return (*span, SPAN if m["yw"] else POINT, "blur" if m["blur"] else "accurate")


@rule(rf"(?P<d>{N})[日号]")
def _day(m, base):
    d = date(base.year, base.month, number(m["d"]))
    return d, d, POINT, "accurate"


@rule(rf"(?P<y>{Y4})年(?:全年)?(?P<blur>左右|前后|许)?")
def _year(m, base):
    y = full_year(m["y"], base)
    return date(y, 1, 1), date(y, 12, 31), POINT, "blur" if m["blur"] else "accurate"


@rule(r"(?P<y>1[6-9][0-9]{2}|20[0-9]{2}|21[0-9]{2})")
@rule(rf"(?P<yw>{_words(YEAR_WORDS)}|全年)")
def _plain_year(m, base):
    g = m.groupdict()
    y = int(g["y"]) if g.get("y") else base.year + YEAR_WORDS.get(g["yw"], 0)
    return date(y, 1, 1), date(y, 12, 31), SPAN, "accurate"


@rule(rf"{_YF}(?:[第Qq]?(?P<q>[一二三四首1-4])(?:个)?季度?|(?P<f>前|头)(?P<n>[一二两三1-3])个?季度?|(?P<l>后)(?P<k>[一二两三1-3])个?季度?)(?P<part>初|末)?")
def _quarter(m, base):
    y = year_of(m, base)
    if m["q"]:
        a = b = 1 if m["q"] == "首" else number(m["q"])
    elif m["f"]:
        a, b = 1, number(m["n"])
    else:
        a, b = 5 - number(m["k"]), 4
    lo, hi = 3 * a - 2, 3 * b
    lo, hi = (hi, hi) if m["part"] == "末" else (lo, lo) if m["part"] == "初" else (lo, hi)
    return (*month_range(y, lo, hi), SPAN, "accurate")


@rule(r"(?P<w>上+|下+|本|这|当)(?:一)?个?季度?(?P<part>初|中|末)?")
def _this_quarter(m, base):
    k = {"上": -1, "下": 1}.get(m["w"][0], 0) * len(m["w"])
    y, first = shift_month(base.year, (base.month - 1) // 3 * 3 + 1, 3 * k)
    a, b = {"初": (first, first), "中": (first + 1, first + 1), "末": (first + 2, first + 2)}.get(m["part"], (first, first + 2))
    return (*month_range(y, a, b), SPAN, "accurate")


@rule(rf"{_YF}(?:的)?(?P<p>年初|初|开年|伊始|年末|年底|末|底|年中|上半年|下半年|暑期|暑假|寒假|前期|中期|后期)")
def _blur_month(m, base):
    a, b = {"年初": (1, 2), "初": (1, 2), "开年": (1, 1), "伊始": (1, 1), "年末": (11, 12), "年底": (11, 12), "末": (11, 12), "底": (11, 12), "年中": (6, 7), "上半年": (1, 6), "下半年": (7, 12), "暑期": (7, 8), "暑假": (7, 8), "寒假": (2, 2), "前期": (1, 3), "中期": (4, 9), "后期": (10, 12)}[m["p"]]
    return (*month_range(year_of(m, base), a, b), SPAN, "blur")


@rule(rf"{_YF}(?P<w>前|头|后|第|首)(?P<n>{N})?个?月")
def _span_month(m, base):
    n = number(m["n"]) if m["n"] else 1
    a, b = {"前": (1, n), "头": (1, n), "首": (1, n), "后": (13 - n, 12), "第": (n, n)}[m["w"]]
    return (*month_range(year_of(m, base), a, b), SPAN, "accurate")


_MW = r"(?P<mw>上+一?|下+一?|本|这|当|同|今)个?月份?"


def month_of(m: re.Match, base: datetime) -> tuple[int, int]:
    g = m.groupdict()
    if g.get("mw"):
        w = g["mw"].rstrip("一")
        return shift_month(base.year, base.month, {"上": -1, "下": 1}.get(w[0], 0) * len(w))
    return year_of(m, base), number(g["m"])


@rule(rf"{_MW}的?(?P<d>{N})[日号]?")
def _rel_month_day(m, base):
    d = date(*month_of(m, base), number(m["d"]))
    return d, d, POINT, "accurate"


@rule(_MW)
def _rel_month(m, base):
    return (*month_range(*month_of(m, base)), POINT, "accurate")


@rule(rf"(?:{_MW}|{_YF}(?P<m>{N})月份?)的?月?(?P<p>上旬|中旬|下旬|初|中|底|末)")
def _part_of_month(m, base):
    y, mo = month_of(m, base)
    end = _last(y, mo)
    a, b = {"上旬": (1, 10), "中旬": (11, 20), "下旬": (21, end), "初": (1, 5), "中": (10, 20), "底": (25, end), "末": (25, end)}[m["p"]]
    return date(y, mo, a), date(y, mo, b), POINT if m["mw"] else SPAN, "accurate" if m["mw"] else "blur"


@rule(rf"(?:{_MW}|{_YF}(?P<m>{N})月份?)的?(?P<w>前|头|最后|后)(?P<n>{N})[天日]")
def _days_of_month(m, base):
    y, mo = month_of(m, base)
    n, end = number(m["n"]), _last(y, mo)
    a, b = (1, n) if m["w"] in "前头" else (end - n + 1, end)
    return date(y, mo, a), date(y, mo, b), POINT, "accurate"


@rule(rf"(?:{_MW}|{_YF}(?P<m>{N})月份?)的?第(?P<n>{N})个?(?:周|星期|礼拜)(?P<d>[一二三四五六日天末])?")
def _week_of_month(m, base):
    y, mo = month_of(m, base)
    first, n = date(y, mo, 1), number(m["n"])
    if m["d"]:
        dow = "一二三四五六日".find("日" if m["d"] in "天末" else m["d"])
        d = first + timedelta((dow - first.weekday()) % 7 + 7 * (n - 1))
        return d, d, POINT, "accurate"
    monday = first + timedelta(-first.weekday() % 7 + 7 * (n - 1))
    if monday.month != mo:
        raise ValueError("no such week")
    return monday, monday + timedelta(6), SPAN, "accurate"


@rule(rf"{_YF}第(?P<n>{N})个?(?:周|星期|礼拜)")
def _week_of_year(m, base):
    first = date(year_of(m, base), 1, 1)
    monday = first + timedelta(-first.weekday() % 7 + 7 * (number(m["n"]) - 1))
    return monday, monday + timedelta(6), SPAN, "accurate"


@rule(r"(?P<w>上+|下+|本|这|当)?(?:一)?个?(?:周|星期|礼拜)的?(?:周|星期|礼拜)?(?P<d>[一二三四五六日天末])")
def _weekday(m, base):
    k = {"上": -1, "下": 1}.get((m["w"] or " ")[0], 0) * len(m["w"] or "")
    dow = "一二三四五六日".find("日" if m["d"] in "天末" else m["d"])
    d = base.date() + timedelta(7 * k - base.weekday() + dow)
    return d, d, POINT, "accurate"


@rule(rf"(?:(?P<w>上+|下+|本|这|当)(?:一)?个?(?:周|星期|礼拜)|(?P<n>{N})个?(?:周|星期|礼拜)(?P<s>之?前|之?后|以前|以后))")
def _week(m, base):
    k = number(m["n"]) * (1 if "后" in m["s"] else -1) if m["n"] else {"上": -1, "下": 1}.get(m["w"][0], 0) * len(m["w"])
    monday = base.date() + timedelta(7 * k - base.weekday())
    return monday, monday + timedelta(6), POINT, "blur"


@rule(rf"(?P<w>前|后)(?P<n>{N})个?(?:周|星期|礼拜)")
def _weeks(m, base):
    k, monday = 7 * number(m["n"]), base.date() - timedelta(base.weekday())
    return (monday - timedelta(k), base.date(), POINT, "blur") if m["w"] == "前" else (base.date(), monday + timedelta(k + 6), POINT, "blur")


@rule(rf"(?P<w>{_words(DAY_WORDS)})")
def _rel_day(m, base):
    if m["w"] in ("昨", "今", "明"):
        raise ValueError("needs a clock time")
    d = base.date() + timedelta(DAY_WORDS[m["w"]])
    return d, d, SPAN if m["w"] == "全天" else POINT, "accurate"


@rule("(?P<w>昨|今|明|当)")
def _short_day(m, base):
    d = base.date() + timedelta(DAY_WORDS.get(m["w"], 0))
    return d, d, "short", "accurate"


@rule(rf"(?:(?P<w>上个?|本)世纪|(?P<c>{N})世纪)?(?P<d>[0-9一二三四五六七八九]+[0十])?(?P<dw>年代)?(?P<p>初期?|中期?|末期?|前期|后期)?")
def _century(m, base):
    if not (m["w"] or m["c"] or m["dw"]) or (m["d"] and not m["dw"]):
        raise ValueError("no century")
    if m["d"]:
        dec = number(m["d"])
        start = (base.year // 100 * 100 - (100 if m["w"] and m["w"][0] == "上" else 0)) if m["w"] else (number(m["c"]) - 1) * 100 if m["c"] else (1900 if dec > 20 else 2000)
        a, b = start + dec, start + dec + 9
        part = {"初": (0, 2), "前": (0, 2), "中": (3, 6), "末": (7, 9), "后": (7, 9)}
    else:
        a = (base.year // 100 * 100 - (100 if m["w"][0] == "上" else 0)) if m["w"] else (number(m["c"]) - 1) * 100
        b = a + 99
        part = {"初": (0, 19), "前": (0, 19), "中": (20, 79), "末": (80, 99), "后": (80, 99)}
    if m["p"]:
        a, b = a + part[m["p"][0]][0], a + part[m["p"][0]][1]
    return date(a, 1, 1), date(b, 12, 31), SPAN, "blur"


@rule(rf"{_YF}(?P<f>{_words(SOLAR_DAYS)})(?:节日|当天|期间)?")
def _solar_feast(m, base):
    d = date(year_of(m, base), *SOLAR_DAYS[m["f"]])
    return d, d, POINT, "accurate"


def lunar_date(y: int, mo: int, d: int, leap: bool = False) -> date:
    found = lunar.to_solar(y, mo, d, leap) or (lunar.to_solar(y, mo, 29, leap) if d == 30 else None)
    if found is None:
        raise ValueError("no such lunar day")
    return found


@rule(rf"{_YF}(?:农历)?(?P<f>{_words(LUNAR_DAYS)})(?:当天|期间)?")
def _lunar_feast(m, base):
    d = lunar_date(year_of(m, base), *LUNAR_DAYS[m["f"]])
    return d, d, POINT, "accurate"


@rule(rf"{_YF}(?P<f>{_words(WEEKDAY_FEASTS)})")
def _weekday_feast(m, base):
    mo, dow, n = WEEKDAY_FEASTS[m["f"]]
    first = date(year_of(m, base), mo, 1)
    d = first + timedelta((dow - first.weekday()) % 7 + 7 * (n - 1))
    return d, d, POINT, "accurate"


_LM = {"正": 1, "冬": 11, "腊": 12}


@rule(rf"(?:(?:农历|阴历)(?P<z>)|){_YF}(?:农历|阴历)?(?P<leap>闰)?(?:(?P<lm>[正冬腊])|(?P<m>{N}))月(?:(?P<ld>初(?:[一二三四五六七八九十1-9]|10))|(?P<d>{N})[日号]?)?")
def _lunar(m, base):
    bare = m["d"] and not re.search("[0-9日号]", m[0])
    if not (bare or m["lm"] or m["ld"] or m["leap"] or "农历" in m[0] or "阴历" in m[0] or (m["d"] or "").startswith("廿")):
        raise ValueError("not lunar")
    y, mo = year_of(m, base), _LM.get(m["lm"] or "") or number(m["m"])
    leap = bool(m["leap"])
    if m["ld"] or m["d"]:
        d = lunar_date(y, mo, number(m["ld"][1:]) if m["ld"] else number(m["d"]), leap)
        return d, d, POINT, "accurate"
    first = lunar_date(y, mo, 1, leap)
    n = 30 if lunar.to_solar(y, mo, 30, leap) else 29
    return first, first + timedelta(n - 1), POINT, "accurate"


@rule("大年初(?P<d>[一二三四五六七八九十])")
def _new_year_days(m, base):
    d = lunar_date(base.year, 1, number(m["d"]))
    return d, d, POINT, "accurate"


@rule("(?P<d>廿[一二三四五六七八九])")
def _lunar_day(m, base):
    d = lunar_date(base.year, base.month, number(m["d"]))
    return d, d, POINT, "accurate"


@rule(rf"{_YF}(?P<t>{'|'.join(lunar.TERMS)})(?:节气?|当天)?")
def _term(m, base):
    y = year_of(m, base)
    d = lunar.term_day(m["t"], y + 1 if m["t"] in ("小寒", "大寒") else y)
    return d, d, POINT, "accurate"


@rule(rf"{_YF}(?:的)?(?P<s>春|夏|秋|冬)(?P<w>季|天|日)?")
def _season(m, base):
    if not (m["w"] or m["y"] or m["yw"]):
        raise ValueError("a lone character")
    y = year_of(m, base)
    starts = ["立春", "立夏", "立秋", "立冬"]
    i = "春夏秋冬".index(m["s"])
    lo = lunar.term_day(starts[i], y)
    hi = lunar.term_day(starts[(i + 1) % 4], y + (i == 3)) - timedelta(1)
    return lo, hi, SPAN, "accurate"


@rule(rf"{_YF}(?P<mm>{N})月份?(?P<ds>(?:[0-9]+[日号]?[、,，和及])+[0-9]+)[日号]")
def _several_days(m, base):
    ds = [int(x) for x in re.findall("[0-9]+", m["ds"])]
    y, mo = year_of(m, base), number(m["mm"])
    return date(y, mo, min(ds)), date(y, mo, max(ds)), SPAN, "accurate"


@rule(rf"(?P<y>{Y4})年的?第(?P<n>{N})[天日]")
def _day_of_year(m, base):
    d = date(full_year(m["y"], base), 1, 1) + timedelta(number(m["n"]) - 1)
    return d, d, POINT, "accurate"


@rule(rf"第(?P<n>{N})(?P<u>年|天)")
def _nth(m, base):
    n = number(m["n"]) - 1
    if m["u"] == "年":
        return date(base.year + n, 1, 1), date(base.year + n, 12, 31), SPAN, "blur"
    d = base.date() + timedelta(n)
    return d, d, POINT, "accurate"


@rule("今明两(?P<u>年|天)")
def _two(m, base):
    if m["u"] == "年":
        return date(base.year, 1, 1), date(base.year + 1, 12, 31), SPAN, "accurate"
    return base.date(), base.date() + timedelta(1), SPAN, "accurate"


@rule("前两(?P<u>天|个?月|年)")
def _blur_two(m, base):
    if m["u"] == "天":
        return base.date() - timedelta(7), base.date() - timedelta(2), SPAN, "blur"
    if m["u"] == "年":
        return date(base.year - 5, 1, 1), date(base.year - 2, 12, 31), SPAN, "blur"
    a, b = (base - timedelta(x) for x in (60.8, 30.4))
    return date(a.year, a.month, 1), month_range(b.year, b.month)[1], SPAN, "blur"


RULES.insert(0, next(r for r in RULES if r[1] is _lunar))  # it turns away what isn't lunar


# -- clock ------------------------------------------------------------------------
_CW = f"(?P<w>{_words(CLOCK_WORDS)})"


def _hour(h: int, word: str | None) -> int:
    if word and h < 24:
        if word in ("下午", "午后", "傍晚") and 1 <= h <= 11:
            return h + 12
        if ("晚" in word or "夜" in word) and "半夜" not in word and word != "午夜" and 5 <= h <= 12:
            return h + 12
        if word == "半夜" and 9 <= h <= 11:
            return h + 12
        if word in ("中午", "正午") and h not in (11, 12):
            return h + 12
    return h


Clock = tuple[timedelta, timedelta, str, str]


@lru_cache(maxsize=4096)
def clock(s: str) -> Clock | None:
    """(first, last second as offsets into the day, type, definition)."""
    s = s.removeprefix("的")
    if m := re.fullmatch(rf"{_CW}?(?P<a>[一二三四五六七八九])(?P<b>[二三四五六七八九])点钟?", s):
        a, b = number(m["a"]), number(m["b"])
        if b != a + 1:
            return None
        a, b = (_hour(x, m["w"]) for x in (a, b))
        return timedelta(hours=a), timedelta(hours=b, minutes=59, seconds=59), SPAN, "blur"
    if (m := re.fullmatch("(?P<m>2[4-9]|[3-5][0-9])[:：](?P<s>[0-9]{2})", s)) and m["m"] != "24":
        return None  # minutes and seconds need the hour of the base
    if m := re.fullmatch(rf"{_CW}?的?(?P<h>[0-9]{{1,2}})[:：](?P<m>[0-9]{{2}})(?:[:：](?P<s>[0-9]{{2}}))?(?:[时分])?", s):
        h, mi, se = _hour(int(m["h"]), m["w"]), int(m["m"]), m["s"]
    elif m := re.fullmatch(rf"{_CW}?的?(?P<h>{N})(?:点多?钟?|时)(?P<half>半)?(?:(?P<q>[一二三1-3])刻)?(?:(?P<m>{N})分?钟?)?(?:(?P<s>{N})秒)?(?P<blur>左右|许|前后|整)?", s):
        h = _hour(number(m["h"]), m["w"])
        mi = 30 if m["half"] else 15 * number(m["q"]) if m["q"] else number(m["m"]) if m["m"] else None
        se = str(number(m["s"])) if m["s"] else None
        if mi is None and se is None:
            if h > 24:
                return None
            a = timedelta(hours=h)
            return a, a + timedelta(minutes=59, seconds=59), POINT, "blur" if m["blur"] in ("左右", "许", "前后") else "accurate"
        mi = mi or 0
    elif s in CLOCK_WORDS:
        a, b = CLOCK_WORDS[s]
        return timedelta(hours=a), timedelta(hours=b, minutes=59, seconds=59), POINT, "blur"
    else:
        return None
    if h > 24 or mi > 59 or (se and int(se) > 59):
        return None
    at = timedelta(hours=h, minutes=mi, seconds=int(se or 0))
    about = "blur" in m.groupdict() and m["blur"] in ("左右", "许", "前后")
    return at, at + timedelta(seconds=0 if se else 59), POINT, "blur" if about else "accurate"


def dated(s: str, base: datetime) -> list[Range]:
    out = []
    for pattern, fn in RULES:
        if m := pattern.fullmatch(s):
            try:
                out.append(fn(m, base))
                break
            except (ValueError, KeyError, OverflowError):
                continue
    return out


# -- durations ----------------------------------------------------------------------
_UNIT = "周年|年|个?季度|个?月|周|个?星期|个?礼拜|天|日|个?工作日|个?交易日|个?小时|个?钟头|刻钟|分钟|分|秒钟|秒"
_PART = re.compile(rf"(?P<half>半)?(?P<n>[0-9][0-9,]*(?:\.[0-9]+)?[万亿]?|[零〇一二两俩三仨四五六七八九十百千万廿卅]+|几)?(?P<many>[多余])?(?P<mid>个)?(?P<mid2>半)?(?P<many2>[多余])?(?P<u>{_UNIT})(?P<plus>半)?(?P<bell>钟)?(?P<many3>多)?")


def large(s: str) -> int:
    """``number`` with thousands and ten thousands."""
    total = 0
    for mark, worth in (("万", 10_000), ("千", 1000)):
        if mark in s:
            head, s = s.split(mark, 1)
            total += (large(head) if head else 1) * worth
    return total + (number(s.removeprefix("零")) if s.strip("零") else 0)


_NEXT_TO = re.compile(f"(?P<a>[一二两三四五六七八九])(?P<b>[二三四五六七八九])(?P<u>{_UNIT})")


def neighbours(s: str) -> tuple[str, str] | None:
    """两三天: the texts of both durations."""
    m = _NEXT_TO.fullmatch(s)
    return (m["a"] + m["u"], m["b"] + m["u"]) if m and number(m["b"]) == number(m["a"]) + 1 else None


def duration(s: str) -> tuple[dict[str, float], float, bool] | None:
    """(units, days, blurred) of a text that is all duration."""
    if neighbours(s):
        return None
    at, units, days, blur = 0, {}, 0.0, False
    if s[:1] in ("近", "约"):
        s, blur = s[1:], True
    while at < len(s):
        m = _PART.match(s, at)
        if not m or not (m["n"] or m["half"] or m["mid2"]) or m["n"] == "几" or (m["bell"] and not m["plus"]):
            return None
        n = 0.0
        if m["n"]:
            big = {"万": 1e4, "亿": 1e8}.get(m["n"][-1], 1.0)
            n = float(m["n"].rstrip("万亿").replace(",", "")) * big if m["n"][0].isascii() else float(large(m["n"]))
        n += 0.5 * (bool(m["half"]) + bool(m["mid2"]) + bool(m["plus"]))
        u = m["u"].removeprefix("个")
        key, times = DELTA_KEYS[u]
        units[key] = units.get(key, 0.0) + n * times
        days += n * UNIT_DAYS.get(u, 1.0)
        blur = blur or bool(m["many"] or m["many2"] or m["many3"] or (m["plus"] and key in ("year", "month")))
        at = m.end()
    return (units, days, blur) if units else None


_UNIT_WIDTH = {"year": 365, "month": 31, "day": 1}


def _edge(x: datetime, unit: str, end: bool) -> datetime:
    if unit == "year":
        return datetime(x.year, 12, 31, 23, 59, 59) if end else datetime(x.year, 1, 1)
    if unit == "month":
        return datetime(x.year, x.month, _last(x.year, x.month), 23, 59, 59) if end else datetime(x.year, x.month, 1)
    if unit in ("day", "workday"):
        return x.replace(hour=23, minute=59, second=59) if end else x.replace(hour=0, minute=0, second=0)
    return x


def _workday(base: datetime, n: int) -> datetime:
    step, at = (1 if n >= 0 else -1), base
    for _ in range(abs(n)):
        at += timedelta(step)
        while at.weekday() > 4:
            at += timedelta(step)
    return at


def _decades(tens: str | None, word: str, base: datetime) -> dict | None:
    """几十年, 二十几年: between one number of tens of years and the next, or a hundred."""
    if not tens or word not in ("前", "后", "之前", "之后", "以前", "以后"):
        return None
    low = number(tens)
    if low < 10 or low % 10:
        return None
    a, b = sorted(base.year + (-k if "前" in word else k) for k in (low, low + 10))
    return _made(SPAN, "blur", datetime(a, 1, 1), datetime(b, 12, 31, 23, 59, 59))


def offset(s: str, base: datetime) -> dict | None:
    """A duration with a word for its side of the base: 后, 前, 之后, 之前, 内, 来, or 未来, 过去 in front."""
    if m := re.fullmatch("(?P<w>未来|今后|过去|最近|近|再?过)的?(?P<x>.+)", s):
        word, body = m["w"], m["x"].removesuffix("里").removesuffix("内").removesuffix("来")
    elif m := re.fullmatch("(?P<x>.+?)(?P<w>之后|以后|之前|以前|以内|之内|以来|后|前|内|来|里)", s):
        word, body = m["w"], m["x"]
    else:
        return None
    body = body.removeprefix("的")
    if (ends := neighbours(body)) and (a := offset(ends[0] + word, base)) and (b := offset(ends[1] + word, base)):
        lo, hi = min(a["start"], b["start"]), max(a["end"], b["end"])
        return {**a, "type": SPAN, "definition": "blur", "start": lo, "end": hi}
    if body == "几十年" and word in ("前", "后", "之前", "之后", "以前", "以后"):
        a, b = sorted(base.year + (-k if "前" in word else k) for k in (20, 100))
        return _made(SPAN, "blur", datetime(a, 1, 1), datetime(b, 12, 31, 23, 59, 59))
    if several := re.fullmatch(f"(?P<n>{N})?几年", body):
        return _decades(several["n"], word, base)
    got = None if re.fullmatch("[0-9零〇一二三四五六七八九]{4}年", body) else duration(body)
    if got is None:
        return None
    units, days, blur = got
    small = next(u for u in ("second", "minute", "hour", "workday", "day", "month", "year") if u in units)
    back = word in ("之前", "以前", "前", "过去", "最近", "近", "来", "以来")
    if small == "workday":
        far = _workday(base, int(units[small]) * (-1 if back else 1))
    else:
        far = base + timedelta(days=days) * (-1 if back else 1)
    coarse = small in ("year", "month")
    how = "blur" if blur or coarse else "accurate"
    cut = small if small in ("year", "month", "day", "workday") and float(units[small]).is_integer() else {"year": "month", "month": "day", "day": "hour"}.get(small, small)
    if word in ("过", "再过"):
        return _made(SPAN, "blur", _edge(far, "day", False), None) if small in ("year", "month", "day") else _made(SPAN, how, far, None)
    if word in ("未来", "今后"):
        return _made(SPAN, how, base, _edge(far, "day", True) if coarse else far)
    if word in ("过去", "最近", "近"):
        return _made(SPAN, "blur" if word == "近" else how, _edge(far, "day", False) if coarse else far, base)
    if word in ("之后", "以后"):
        return _made(SPAN, "blur", _edge(far, cut, False), None)
    if word in ("之前", "以前"):
        return _made(SPAN, "blur", None, _edge(far, cut, True))
    if word in ("后", "前"):
        if small in ("hour", "minute", "second"):
            step = {"hour": timedelta(hours=1), "minute": timedelta(minutes=15 if "刻" in body else 1), "second": timedelta(seconds=1)}[small] if units[small] >= 1 else timedelta(minutes=30)
            lo, hi = (far, far + step) if word == "后" else (far - step, far)
            return _made(POINT, how, lo, hi)
        if small == "year" and re.search("[0-9十百][多余]", body) and units["year"] >= 10:
            more = base + timedelta(days=(days + 365 * (100 if units["year"] >= 100 else 10)) * (-1 if back else 1))
            lo, hi = min(far, more), max(far, more)
            return _made(SPAN, "blur", _edge(lo, cut, False), _edge(hi, cut, True))
        if small == "month" and units[small] > 1 and not float(units[small]).is_integer():  # a unit's width from the far end on
            wide = timedelta(UNIT_DAYS["月"])
            lo, hi = (far, far + wide) if word == "后" else (far - wide, far)
            return _made(SPAN, "blur", _edge(lo, "day", False), _edge(hi, "day", True))
        return _made(SPAN if coarse else POINT, how, _edge(far, cut, False), _edge(far, cut, True))
    if back:
        return _made(SPAN, how if word != "近" else "blur", _edge(far, cut, False), base)
    return _made(SPAN, how, base, _edge(far, cut, True))


# -- all ---------------------------------------------------------------------------
def _made(kind: str, how: str, lo: datetime | None, hi: datetime | None, **more) -> dict:
    show = lambda x, inf: inf if x is None else x.strftime("%Y-%m-%d %H:%M:%S").zfill(19)
    return {"type": kind, "definition": how, "start": show(lo, "-inf"), "end": show(hi, "inf"), "delta": None, "delta_hi": None, **more}


def point(s: str, base: datetime, future: bool = False) -> dict | None:
    """A date, a clock time, or both."""
    if s in ("现在", "目前", "此刻", "当前", "此时", "至今", "今"):
        return _made(POINT, "accurate" if s == "现在" else "blur", base, base)
    if (got := offset(s, base)) and not re.fullmatch(rf"{N}个?(?:周|星期|礼拜)之?[前后]", s):
        return got
    if m := re.fullmatch(r"(?P<m>2[5-9]|[3-5][0-9])[:：](?P<s>[0-5][0-9])", s):
        at = base.replace(minute=int(m["m"]), second=int(m["s"]))
        return _made(POINT, "accurate", at, at)
    if (m := re.fullmatch("(?P<x>.{2,}?)(?:前后|左右)", s)) and (got := point(m["x"], base, future)):
        return {**got, "definition": "blur"}
    s = re.sub("(?<=[日号])[（(]?(?:周|星期|礼拜)[一二三四五六日天][)）]?", "", s)
    for i in range(len(s), -1, -1):
        head, tail = s[:i].removesuffix("的"), s[i:]
        if re.match("[0-9]{1,2}[:：]", tail):
            head = head.removesuffix("-")
        hms = clock(tail) if tail else None
        if tail and hms is None:
            continue
        days = dated(head, base) if head else [(base.date(), base.date(), POINT, "accurate")]
        if head and not days:
            if (off := offset(head, base)) and hms and off["start"][:10] == off["end"][:10]:
                d = date.fromisoformat(off["start"][:10])
                days = [(d, d, POINT, "accurate")]
            else:
                continue
        lo, hi, kind, how = days[0]
        if hms is None:
            if kind == "short":
                continue
            if future and hi < base.date() and re.match(r"(?:周|星期|礼拜)", s):
                lo, hi = lo + timedelta(7), hi + timedelta(7)
            return _made(kind, how, datetime.combine(lo, datetime.min.time()), datetime.combine(hi, datetime.max.time()).replace(microsecond=0))
        if lo != hi:
            continue
        day = datetime.combine(lo, datetime.min.time())
        if future and not head and day + hms[1] < base:
            day += timedelta(1)
        return _made(hms[2], "blur" if "blur" in (how, hms[3]) else "accurate", day + hms[0], day + hms[1])
    return None


_CUT = re.compile("到|至|—+|--|[-~～]")


_OWN = re.compile("去年|今年|明年|前年|后年|大|上(?!午)|下(?!午)|这|本|今|明|昨|后天|前天|现在")
_CLOCK_END = re.compile(rf"(?:{N})(?:点钟?|时)$")


def span(s: str, base: datetime) -> dict | None:
    """Two points with 到 or a dash between; what the second leaves out it takes from the first."""
    body = s.removeprefix("从").removeprefix("自")
    for m in _CUT.finditer(body):
        a, b = body[: m.start()].removesuffix("起").removesuffix("开始"), re.sub("(?:之间|期间|止|为止)$", "", body[m.end() :])
        if not a or not b:
            continue
        left = point(a, base)
        if left is None and (u := re.search("[年月日号点时]", b)):
            left = point(a + u[0], base)
        if left is None or left["start"] == "-inf":
            continue
        if b in ("今", "现在", "目前", "今天"):
            return {**left, "type": SPAN, "end": base.strftime("%Y-%m-%d %H:%M:%S")}
        ref = base if _OWN.match(b) else datetime.fromisoformat(left["start"])
        word = re.search("|".join(sorted(CLOCK_WORDS, key=len, reverse=True)), a)
        own_word = re.search("|".join(sorted(CLOCK_WORDS, key=len, reverse=True)), b)
        right = (point(word[0] + b, ref) if word and not own_word and re.match(rf"{N}[点时:：]", b) else None) or point(b, ref) or (point(b + "日", ref) if b.isdigit() else None)
        if right is None or right["end"] == "inf":
            continue
        end = right["start"] if _CLOCK_END.search(b) and right["type"] == POINT else right["end"]
        if end < left["start"]:
            continue
        how = "blur" if "blur" in (left["definition"], right["definition"]) else "accurate"
        return {**left, "type": SPAN, "definition": how, "end": end}
    if m := re.fullmatch("(?P<x>.+?)(?P<w>以来|之后|以后|之前|以前|前|内|起|开始)", body):
        one, now = point(m["x"], base), base.strftime("%Y-%m-%d %H:%M:%S")
        if one and one["start"] != "-inf" and one["end"] != "inf":
            if m["w"] == "内":
                return {**one, "type": SPAN, "definition": "blur"}
            if m["w"] == "以来":
                return {**one, "type": SPAN, "end": now}
            if m["w"] in ("之前", "以前", "前"):
                return {**one, "type": SPAN, "start": now if one["end"] > now else "-inf"}
            if m["w"] in ("起", "开始") and one["start"] < now:
                return {**one, "type": SPAN, "end": now}
            return {**one, "type": SPAN, "end": "inf"}
    return None


def period(s: str, base: datetime) -> dict | None:
    """每 with a unit, a number of units or a weekday, and perhaps a clock time."""
    if m := re.fullmatch("每(?P<u>个?|周的?)工作日的?(?P<rest>.*)", s):
        day = base.date() if base.weekday() < 5 else _workday(base, 1).date()
        at = point(m["rest"], datetime.combine(day, base.time())) if m["rest"] else None
        if m["rest"] and at is None:
            return None
        return {**(at or _made("time_period", "accurate", base, None, start=None, end=None)), "type": "time_period", "definition": "accurate", "delta": {"day": 7.0 if "周" in m["u"] else 1.0}}
    m = re.fullmatch(rf"每(?:隔)?(?P<n>{N}|半)?个?(?P<u>周|星期|礼拜|年|季度|月|天|日|小时|钟头|分钟|刻钟|秒)(?P<rest>.*)", s)
    if not m:
        return None
    key, times = DELTA_KEYS["天" if m["u"] == "日" else m["u"]]
    n = 0.5 if m["n"] == "半" else number(m["n"]) if m["n"] else 1
    rest, out = m["rest"], {"delta": {key: float(n * times)}}
    if rest:
        lead = ("周" if m["u"] in ("周", "星期", "礼拜") else "今年" if m["u"] == "年" else "本月" if m["u"] == "月" else "")
        at = point(lead + rest, base) or span(lead + rest, base)
        if at is None:
            return None
        return {**at, "type": "time_period", "definition": "accurate", **out}
    return {**_made("time_period", "accurate", base, None), "start": None, "end": None, **out}


def _range_of(s: str) -> tuple[str, str] | None:
    """The texts of both ends of a range of durations; what lacks its unit takes the other's."""
    if ends := neighbours(s):
        return ends
    if m := re.fullmatch("(?P<a>.+?)以上[,，]?(?P<b>.+?)以下", s):
        return m["a"], m["b"]
    for m in re.finditer("到|至|—+|-+|[~～]", s):
        a, b = s[: m.start()], s[m.end() :]
        if a and b and duration(b):
            unit = re.search(f"(?:{_UNIT})$", b)
            return (a, b) if duration(a) else (a + (unit[0] if unit else ""), b)
    return None


def occurrences(text: str | None, base: datetime, n: int) -> list[tuple[str, str]]:
    """The first ``n`` times of a period with a time in it; of working days, those of ``n`` weeks."""
    first = period((text or "").strip(), base)
    if first is None or first["start"] is None:
        return []
    (unit, width), out = next(iter(first["delta"].items())), []
    if "工作日" in text:
        days = [base + timedelta(k) for k in range(7 * n)]
        every = [period(text.strip(), d) for d in days if d.weekday() < 5]
    else:
        every = []
        for k in range(n):
            if unit in ("year", "month"):
                y, m = shift_month(base.year, base.month, int(k * width) * (12 if unit == "year" else 1))
                at = base.replace(year=y, month=m, day=min(base.day, _last(y, m)))
            else:
                at = base + timedelta(**{f"{unit}s": k * width})
            every.append(period(text.strip(), at))
    for got in every:
        if got and (got["start"], got["end"]) not in out:
            out.append((got["start"], got["end"]))
    return out


def delta(s: str) -> dict | None:
    """A duration on its own; 以上 and 以下 make an open range, two durations a closed one."""
    made = lambda how, lo, hi=None: {"type": "time_delta", "definition": how, "start": None, "end": None, "delta": lo, "delta_hi": hi}
    if s == "大半天":
        return made("blur", {"day": 0.5}, {"day": 0.9})
    if m := re.fullmatch(f"(?P<n>{N})载(?:春秋)?", s):
        return made("blur", {"year": float(number(m["n"]))})
    if m := re.fullmatch(f"(?P<n>{N})[天日](?P<k>{N})[晚夜]", s):
        return made("accurate", {"day": float(number(m["n"]))}) if abs(number(m["n"]) - number(m["k"])) <= 1 else None
    if (ends := _range_of(s)) and (lo := duration(ends[0])) and (hi := duration(ends[1])):
        return made("blur", lo[0], hi[0]) if lo[1] <= hi[1] else None
    body = re.sub("(?:以上|以下|以内)$", "", s)
    got = duration(body)
    if got is None:
        return None
    units, _, blur = got
    out = made("blur" if blur or body != s else "accurate", units)
    if body != s:
        low = s.endswith("以上")
        out["delta"], out["delta_hi"] = (units, {"infinite": 1.0}) if low else ({"zero": 1.0}, units)
    return out


def parse(text: str | None, base: datetime, kind: str | None = None, future: bool = False, lunar_dates: bool = True) -> dict | None:
    """The one reading of a text that is all time; None if it isn't. ``kind`` asks for one type.

    ``future``: what is past by the base is taken for the next one. Without ``lunar_dates`` a month and day in
    numerals alone (三月初五 apart) are of the solar calendar.
    """
    if not text or not text.strip():
        return None
    if not lunar_dates and re.fullmatch(rf"{_YF}{N}月(?![0-9])(?!初){N}", text.strip()):
        text = text.strip() + "日"
    s = re.sub(r"\s+", " ", text.strip()).translate({0xFF10 + i: str(i) for i in range(10)} | {0xFF0D: "-"})
    s = re.sub(r"(?<=[0-9]) (?=[0-9]{1,2}[:：])", "的", s).replace(" ", "")
    if len(s) > 64:
        return None
    try:
        if kind == "time_delta":
            return delta(s)
        # 两日 is a duration, 5日 a day of the month; a number of years before 内 or 后 is one too
        readings = [period, lambda x, b: point(x, b, future), span, lambda x, b: delta(x)]
        if re.fullmatch("[两俩仨][日年月]", s):
            readings = readings[::-1]
        for read in readings:
            if (got := read(s, base)) and (kind is None or got["type"] == kind):
                return got
    except (ValueError, OverflowError, KeyError):
        return None
    return None


#: Readings of short texts that a worker keeps: the same times come again and again.
MEMO_SIZE, MEMO_CHARS = 1 << 15, 64


@lru_cache(maxsize=MEMO_SIZE)
def _parsed(text: str, base: datetime, kind: str | None, future: bool, lunar_dates: bool) -> dict | None:
    return parse(text, base, kind, future, lunar_dates)


_CHARS = "0-9０-９零〇一二两三四五六七八九十百廿卅年月日号天周星期礼拜时点分秒刻钟半前后上下本这当今明昨去来早晚午夜凌晨傍黎清末初底中旬季度世纪代春夏秋冬节正腊闰农历阴国庆元旦除夕端重阳情人妇女植树劳动青儿童建党军教师万圣平安诞母亲父感恩寒暑假期大小雪至立分露霜降谷雨惊蛰满芒种处暑每隔过未个多余近最以内之间到现在目此刻起开始自从第头首工作交易许左右的:：~～—./· -"
_RUN = re.compile(f"[{_CHARS}]+")
_ALONE = re.compile(rf"[0-9]{{1,3}}|[0-9]{{5,7}}|[0-9]{{9,}}|{N}(?:点{N}|[分点秒])|[0-9.]+|一[日天时]|一点|今|现|(?:[{_words({'早': 1})}晚])|{N}|[初末底中前后]|黎明|同年|期间|中期?|上半|元宵|清明")


def find(text: str | None, base: datetime, longest: int = 35) -> list[dict]:
    """Times in a text: the longest reading from the left, of 2 to ``longest`` characters."""
    out = []
    for run in _RUN.finditer(text or ""):
        a, end = run.span()
        while a < end - 1:
            hit = None
            for b in range(min(end, a + longest), a + 1, -1):
                s = text[a:b]
                if s[0] in " 的到至-~～—.:：·/" or s[-1] in " 的到至-~～—.:：·/" or _ALONE.fullmatch(s):
                    continue
                if (s[-1].isdigit() and text[b : b + 1].isdigit()) or (s[0].isdigit() and a and (text[a - 1].isdigit() or text[a - 1] == ".")):
                    continue
                if re.fullmatch(rf"{N}点{N}分?", s) and not s.endswith("分"):
                    continue
                if got := parse(s, base):
                    hit = (b, got["type"])
                    break
            if hit:
                out.append({"text": text[a : hit[0]], "start": a, "end": hit[0], "type": hit[1]})
                a = hit[0]
            else:
                a += 1
    return out


VALUE = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("type", "definition", "start", "end")],
    *[T.StructField(n, T.MapType(T.StringType(), T.DoubleType())) for n in ("delta", "delta_hi")],
])
SPANS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("type", T.StringType())]))


def parse_time(col: Column | str, base: Column | str | datetime, kind: str | None = None, future: bool = False, lunar_dates: bool = True) -> Column:
    """struct<type,definition,start,end,delta,delta_hi>; null if it isn't a time. ``base``: a column or one instant."""

    @F.pandas_udf(VALUE)
    def run(s: pd.Series, b: pd.Series) -> pd.DataFrame:
        blank = dict.fromkeys(f.name for f in VALUE.fields)
        at, bases = pd.factorize(b)
        known = [t.to_pydatetime() for t in pd.DatetimeIndex(bases)]
        rows = [(None if k < 0 else (_parsed if x and len(x) <= MEMO_CHARS else parse)(x, known[k], kind, future, lunar_dates)) or blank for x, k in zip(s, at.tolist(), strict=True)]
        return pd.DataFrame({name: pd.Series([r.get(name) for r in rows], dtype=object) for name in blank})

    value = run(F.col(col) if isinstance(col, str) else col, _base(base))
    return F.when(value["type"].isNotNull(), value)


def _base(base: Column | str | datetime) -> Column:
    c = F.lit(base) if isinstance(base, datetime) else F.col(base) if isinstance(base, str) else base
    return c.cast("timestamp_ntz")


def extract_time(col: Column | str, base: Column | str | datetime) -> Column:
    """Spans of times; texts without a digit or time character never reach the grammar."""

    @F.pandas_udf(SPANS)
    def run(s: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(t) else find(x, t.to_pydatetime()) for x, t in zip(s, b, strict=True)], dtype=object)

    c = F.col(col) if isinstance(col, str) else col
    asked = F.when(c.rlike("[年月日号天周期拜时点分秒刻午晚早晨节季旬0-9]"), c)
    return F.when(c.isNotNull(), run(asked, _base(base)))


def recurrences(col: Column | str, base: Column | str | datetime, n: int = 4) -> Column:
    """array<struct<start,end>>: the first times of a period; empty for a text that is none."""
    pair = T.ArrayType(T.StructType([T.StructField("start", T.StringType()), T.StructField("end", T.StringType())]))

    @F.pandas_udf(pair)
    def run(s: pd.Series, b: pd.Series) -> pd.Series:
        rows = [None if x is None or pd.isna(t) else [{"start": a, "end": z} for a, z in occurrences(x, t.to_pydatetime(), n)] for x, t in zip(s, b, strict=True)]
        return pd.Series(rows, dtype=object)

    return run(F.col(col) if isinstance(col, str) else col, _base(base))
