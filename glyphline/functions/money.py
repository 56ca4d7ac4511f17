"""Money in Chinese texts: values, bounds and currency; finding them in running text.

A grammar over numerals that expressions can't walk, so Arrow batches of a worker;
texts without a currency or unit are turned away by a native filter before.
"""

from __future__ import annotations

import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Numerals, units, currencies and their other names, words that blur.
DIGITS = {c: i for i, cs in enumerate(["零〇O０", "一壹弌１", "二两贰弍俩２", "三叁弎仨３", "四肆４", "五伍５", "六陆６", "七柒７", "八捌８", "九玖９"]) for c in cs} | {str(i): i for i in range(10)}
UNITS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000, "k": 1000, "K": 1000, "万": 10_000, "萬": 10_000, "w": 10_000, "W": 10_000, "亿": 10**8, "兆": 10**12}
CURRENCIES = {
    "元": ("块钱人民币", "元人民币", "人民币", "圆整", "元整", "块钱", "块", "圆", "元"),
    "港元": ("元港币", "港币", "港元"), "日元": ("元日币", "日币", "日元"), "韩元": ("元韩币", "韩币", "韩元"), "新台币": ("元新台币", "元台币", "新台币", "台币"),
    "澳元": ("澳大利亚元", "元澳币", "澳币", "澳元"), "美元": ("美刀", "美金", "美元"), "欧元": ("元欧元", "欧元"), "英镑": ("英镑",), "泰铢": ("泰铢",), "卢布": ("卢布",), "法郎": ("法郎",), "加元": ("加元",), "马克": ("马克",), "比索": ("比索",), "卢比": ("卢比",),
}
NAME = {alias: name for name, aliases in CURRENCIES.items() for alias in aliases}
ALIASES = sorted(NAME, key=len, reverse=True)
PLUS, MINUS = ("以上", "至少", "超过", "大于", "多于", "不少于", "不低于", "起码", "最少", "起"), ("以下", "以内", "不到", "不足", "小于", "少于", "低于", "不超过", "至多", "最多", "近", "将近")
ABOUT = ("左右", "上下", "大约", "大概", "大致", "约", "许", "之间", "前后", "估计")

_CUR = "|".join(map(re.escape, ALIASES))
_NUM = "零〇O一壹弌二两贰弍俩三叁弎仨四肆五伍六陆七柒八捌九玖十拾百佰千仟万萬亿兆"
_RUN = re.compile(rf"(?:(?:{_CUR})\s?)?[0-9０-９数几{_NUM}][0-9０-９{_NUM}.,，．\s多余几个kKwW点]*(?:(?:{_CUR})*(?:[0-9{_NUM}][角毛])?(?:[0-9{_NUM}]分)?钱?整?)?")
_SPLIT = re.compile(r"(?<=.)(?:(?<!不)到|至|--+|—+|～|~|-)(?=.)")


def amount(s: str) -> Decimal | None:
    """Value of a numeral: digits, digits with units, or Chinese numerals with 亿, 万 and smaller units."""
    s = s.replace(",", "").replace("，", "").replace(" ", "").replace("个", "").translate({0xFF10 + i: str(i) for i in range(10)})
    if not s:
        return None
    if m := re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)([十拾百佰千仟kK万萬wW亿兆]*)", s):
        value = Decimal(m[1])
        for u in m[2]:
            value *= UNITS[u]
        return value
    total, part, digit = Decimal(0), Decimal(0), None
    number = re.compile(r"[0-9]+(?:\.[0-9]+)?")
    i = 0
    while i < len(s):
        if m := number.match(s, i):
            digit, i = Decimal(m[0]), m.end()
            continue
        c = s[i]
        if c in DIGITS:
            digit = Decimal(DIGITS[c]) if digit is None or digit == 0 else digit * 10 + DIGITS[c]
        elif c in UNITS:
            u = UNITS[c]
            if u >= 10_000:
                whole = part + (digit or 0)
                if u == 10**8 or u == 10**12:
                    total = (total + (whole or (1 if not total else 0))) * u
                else:
                    total += (whole or 1) * u
                part = Decimal(0)
            else:
                part += (1 if digit is None else digit) * u
            digit = None
        else:
            return None
        i += 1
    if digit is not None:
        last = s[-2] if len(s) > 1 else ""
        # 三万五 is 35,000: a lone last digit counts the unit below
        part += digit * (UNITS[last] // 10 if last in UNITS and UNITS[last] >= 100 and len(s) > 2 else 1)
    return total + part


def _single(s: str) -> tuple[Decimal, Decimal, str | None, str] | None:
    how = "accurate"
    s = re.sub(r"[(（]含[)）]", "", s)
    for words, mark in ((ABOUT, "blur"), (PLUS, "blur+"), (MINUS, "blur-")):
        for w in sorted(words, key=len, reverse=True):
            if s.startswith(w) or s.endswith(w):
                s, how = (s[len(w) :] if s.startswith(w) else s[: -len(w)]), mark
    s = s.strip().removeprefix("为").strip()
    name = None
    for alias in ALIASES:
        if s.startswith(alias) and s[len(alias) :]:
            name, s = NAME[alias], s[len(alias) :].strip()
            break
    small = Decimal(0)
    if m := re.fullmatch(r"(.*?)(?:([0-9一二两三四五六七八九壹贰叁肆伍陆柒捌玖])[角毛])?(?:([0-9一二两三四五六七八九壹贰叁肆伍陆柒捌玖])分)?(钱)?", s):
        jiao, fen = m[2], m[3]
        if jiao or fen:
            small = Decimal(DIGITS[jiao] if jiao else 0) / 10 + Decimal(DIGITS[fen] if fen else 0) / 100
            s = m[1]
            name = name or "元"
            if not s:
                return small, small, name, how
    for _ in range(2):
        for alias in ALIASES:
            if s.endswith(alias):
                name = NAME[alias] if name in (None, "元") else name
                s = s[: -len(alias)].strip()
                break
    if s.endswith("整"):
        s = s[:-1]
    many = re.fullmatch(r"(.*?)([多余])(.*)", s)
    few = re.fullmatch(rf"(.*?)([几数])([{_NUM}kKwW]*)", s)
    if many and many[1] and not any(c in DIGITS for c in many[3]):
        low = amount(many[1] + many[3])
        core = amount(many[1])
        if low is None or core is None:
            return None
        step = Decimal(10) ** (len(str(int(core))) - len(str(int(core)).rstrip("0"))) * (amount("1" + many[3]) or 1)
        return low, low + step, name, "blur"
    if few:
        if few[1]:
            low = amount(few[1] + few[3])
            unit = amount("1" + few[3]) if few[3] else Decimal(1)
            return (low, low + 10 * unit, name, "blur") if low is not None and unit else None
        unit = amount(few[3]) if few[3] else Decimal(1)
        return (unit, unit * 10, name, "blur") if unit is not None else None
    value = amount(s)
    return None if value is None else (value + small, value + small, name, how)


_SEQUENCE = re.compile("([一二两三四五六七八九壹贰叁肆伍陆柒捌])([二三四五六七八九贰叁肆伍陆柒捌玖])(?=[十拾百佰千仟万萬亿])")


def parse(text: str | None, default: str = "元") -> dict | None:
    """{lo, hi (texts with two decimals), currency, definition}; None if it isn't money."""
    if not text or not text.strip():
        return None
    s = text.strip().replace("从", "", 1) if text.strip().startswith("从") else text.strip()
    if (m := _SEQUENCE.search(s)) and 0 < DIGITS[m[2]] - DIGITS[m[1]] <= 2:
        s = s[: m.start()] + m[1] + s[m.end() :] + "到" + s[m.start() : m.start()] + m[2] + s[m.end() :] if m.start() == 0 else s[: m.end(1)] + s[m.end() :] + "到" + s[: m.start()] + m[2] + s[m.end() :]
    sides = _SPLIT.split(s)
    try:
        if len(sides) == 2:
            a, b = sides
            right = _single(b)
            left = _single(a)
            if right is None or left is None:
                return None
            # the first bound takes the units that only the second has
            tail = re.search(r"([十拾百佰千仟kK万萬wW亿兆]+)[^十拾百佰千仟kK万萬wW亿兆]*\Z", b)
            if left[0] < right[0] and tail and left[2] is None:
                own = re.sub(r"[^十拾百佰千仟kK万萬wW亿兆]", "", a)
                big = re.sub(r"[^kKwW万萬亿]", "", tail[1])
                if own in ("", "十", "拾"):
                    add = tail[1] if not own and (re.fullmatch(r"[0-9.]+", a.strip()) or len(tail[1]) == 1) else big or tail[1]
                    add = big if len(tail[1]) > 1 and big else add
                else:
                    add = big if not re.search(r"[kKwW万萬亿]", own) else ""
                more = _single(a + add) if add else None
                if more and more[0] < right[0]:
                    left = more
            return _out(left[0], right[1], right[2] or left[2] or default, "blur")
        one = _single(s)
        return None if one is None else _out(one[0], one[1], one[2] or default, one[3])
    except (KeyError, ArithmeticError, ValueError):
        return None


def _out(lo: Decimal, hi: Decimal, name: str, how: str) -> dict:
    return {"lo": f"{lo:.2f}", "hi": f"{hi:.2f}", "currency": name, "definition": how}


def find(text: str | None) -> list[dict]:
    """Money in a text: text, start, end, type; needs a currency, a small coin, or a range in k or w."""
    if text is None:
        return []
    out, at = [], 0
    while m := _RUN.search(text, at):
        a, b = m.span()
        if (c := re.match(rf"\s?[(（]含[)）]|(?:到|至|--?|—+|～|~)", text[b:])) and (n := _RUN.match(text, b + c.end())):
            b = n.end()
        elif c and (d := re.match(r"(?:到|至|--?|—+|～|~)", text[b + c.end() :])) and (n := _RUN.match(text, b + c.end() + d.end())):
            b = n.end()
        s = text[a:b].rstrip(" ,，.．点多余几个\t\n")
        at = max(b, a + 1)
        has_unit = any(x in s for x in ALIASES) or re.search(r"[0-9一二三四五六七八九][角毛]", s) or re.search(r"[kw万]\s?[-~～—至到]+.*[kw万]\Z", s, re.I)
        if len(s) > 1 and has_unit and any(ch in DIGITS or ch in UNITS or ch in "几数" for ch in s) and parse(s):
            out.append({"text": s, "start": a, "end": a + len(s), "type": "money"})
    return out


VALUE = T.StructType([T.StructField(n, T.StringType()) for n in ("lo", "hi", "currency", "definition")])
SPAN = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("type", T.StringType())]))


@F.pandas_udf(VALUE)
def _parse(s: pd.Series) -> pd.DataFrame:
    blank = dict.fromkeys(("lo", "hi", "currency", "definition"))
    return pd.DataFrame([parse(x) or blank for x in s], columns=list(blank))


@F.pandas_udf(SPAN)
def _find(s: pd.Series) -> pd.Series:
    return pd.Series([find(x) for x in s], dtype=object)


def parse_money(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    value = _parse(c)
    return F.when(value["lo"].isNotNull(), value)


def extract_money(col: Column | str) -> Column:
    """Spans; texts that hold no currency, coin or unit never reach a worker's grammar."""
    c = F.col(col) if isinstance(col, str) else col
    asked = F.when(c.rlike("[元圆块角毛币金镑铢布郎克刀索比kKwW万]"), c)
    return F.coalesce(_find(asked), F.when(c.isNotNull(), F.array().cast(SPAN)))
