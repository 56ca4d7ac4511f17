"""Cleaning, extraction, replacement and checks as Column expressions.

Every function takes a string column (or its name) and gives a Column that stays
in whole-stage codegen. Null gives null; empty text gives empty text, an empty
array or false. Nothing depends on what was called before.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphline.functions import patterns as P

Text = Column | str


def _c(col: Text) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# -- checks -----------------------------------------------------------------------
def _check(col: Text, pattern: str) -> Column:
    return F.coalesce(_c(col).rlike(pattern), F.lit(False))


def has_han(col: Text) -> Column:
    return _check(col, f"[{P.HAN}]")


def all_han(col: Text) -> Column:
    return _check(col, rf"\A[{P.HAN}]+\z")


def has_digit(col: Text) -> Column:
    return _check(col, P.DIGIT)


def all_digits(col: Text) -> Column:
    return _check(col, rf"\A{P.DIGIT}+\z")


# -- extraction ---------------------------------------------------------------------
def find(col: Text, pattern: str, group: int = 1) -> Column:
    """All matches, in order: array of strings."""
    return F.regexp_extract_all(_c(col), F.lit(pattern), F.lit(group))


def find_spans(col: Text, pattern: str, kind: str | None = None) -> Column:
    """All matches of ``pattern`` (one group, the whole match) with code point offsets: array<struct<text,start,end,type>>.

    Matches are wrapped in sentinels and the text is split at these, so that guards
    hold as in the text itself; starts are running sums of the parts' lengths.
    """
    marked = F.regexp_replace(F.translate(_c(col), "\x01\x02", "  "), pattern, "\x01$1\x02")
    parts = F.split(marked, "[\x01\x02]")

    def spans(p: Column) -> Column:
        zero = F.array().cast("array<int>")
        ends = F.aggregate(
            F.sequence(F.lit(0), F.floor(F.size(p) / 2).cast("int")),
            F.struct(F.lit(0).alias("at"), zero.alias("starts")),
            lambda a, i: F.struct(
                (a["at"] + F.length(F.get(p, 2 * i)) + F.coalesce(F.length(F.get(p, 2 * i + 1)), F.lit(0))).alias("at"),
                F.when(F.get(p, 2 * i + 1).isNotNull(), F.concat(a["starts"], F.array(a["at"] + F.length(F.get(p, 2 * i))))).otherwise(a["starts"]).alias("starts"),
            ),
            lambda a: a["starts"],
        )
        one = lambda s, i: F.struct(F.get(p, 2 * i + 1).alias("text"), s.alias("start"), (s + F.length(F.get(p, 2 * i + 1))).alias("end"), F.lit(kind).alias("type"))
        return F.transform(ends, one)

    return let(parts, spans)


def chinese_runs(col: Text) -> Column:
    return find(col, f"([{P.HAN}]+)")


def emails(col: Text) -> Column:
    return find(col, P.EMAIL)


def email_domains(col: Text) -> Column:
    """First label after @ of each address; null where it isn't purely alphanumeric."""
    return F.transform(emails(col), lambda m: F.nullif(F.regexp_extract(m, P.EMAIL_DOMAIN, 1), F.lit("")))


def urls(col: Text) -> Column:
    return find(col, P.URL)


def cell_phones(col: Text) -> Column:
    return find(col, P.CELL)


def landlines(col: Text) -> Column:
    return find(col, P.LANDLINE)


def phones(col: Text) -> Column:
    """Cell phones, then landlines."""
    return F.concat(cell_phones(col), landlines(col))


def ip_addresses(col: Text) -> Column:
    return find(col, P.IP)


def id_cards(col: Text) -> Column:
    return find(col, P.ID_CARD)


def qq_numbers(col: Text, strict: bool = True) -> Column:
    """Strict: only in texts that name the service."""
    found = find(col, P.QQ)
    return F.when(_c(col).isNull() | _c(col).rlike(P.QQ_NAMED), found).otherwise(F.array().cast("array<string>")) if strict else found


def wechat_ids(col: Text, strict: bool = True) -> Column:
    """Strict: only right after the service's name."""
    return find(col, P.WECHAT_NAMED if strict else P.WECHAT)


def plates(col: Text) -> Column:
    return find(col, P.PLATE)


# -- removal and replacement ----------------------------------------------------------
def _put(col: Text, pattern: str, token: str) -> Column:
    return F.regexp_replace(_c(col), F.lit(pattern), F.lit(token.replace("\\", "\\\\").replace("$", "\\$")))


def remove_email(col: Text, prefix: bool = False) -> Column:
    return _put(col, P.led(P.EMAIL_PREFIX, P.EMAIL_PREFIX_FIRST, P.EMAIL) if prefix else P.EMAIL, "")


def remove_url(col: Text) -> Column:
    return _put(col, P.URL, "")


def remove_phone(col: Text, prefix: bool = False) -> Column:
    lead = lambda core: P.led(P.PHONE_PREFIX, P.PHONE_PREFIX_FIRST, core) if prefix else core
    return _put(_put(col, lead(P.CELL), ""), lead(P.LANDLINE), "")


def remove_ip(col: Text) -> Column:
    return _put(col, P.IP, "")


def remove_id_card(col: Text) -> Column:
    return _put(col, P.ID_CARD, "")


def remove_qq(col: Text, strict: bool = True) -> Column:
    return replace_qq(col, strict, "")


def remove_tags(col: Text) -> Column:
    return _put(col, P.TAG, "")


def remove_odd_chars(col: Text) -> Column:
    """Characters outside the allowed set become spaces."""
    # plain ASCII is told apart first: the class has many ranges, which are tried one by one
    return _put(col, rf"(?![\x20-\x7e\n])[^{P.ALLOWED}]", " ")


def remove_redundant(col: Text, chars: str = P.REDUNDANT) -> Column:
    """Runs of one of ``chars`` shrink to one."""
    # a repeated character is told first: the class has many characters, which are tried one by one
    return F.regexp_replace(_c(col), f"(?s)(.)\\1(?<=[{P.quoted(chars)}])\\1*", "$1")


def full_to_half(col: Text) -> Column:
    """Full-width forms become half-width; texts without any aren't rewritten."""
    full, half = P.widths()
    return let(_c(col), lambda t: F.when(t.rlike("[　！-～]"), F.translate(t, full, half)).otherwise(t))


def remove_brackets(col: Text, brackets: str = P.BRACKETS) -> Column:
    """Bracket pairs go with what they hold, innermost first, until none is left.

    A pass over the text takes all innermost pairs; passes stop doing work once
    one has changed nothing, so their number follows the depth of nesting.
    """
    pairs = [brackets[i : i + 2] for i in range(0, len(brackets), 2)]
    # what is no letter or digit, then an opening bracket, is told first: elsewhere all pairs would be tried one by one
    opening = ("" if re.search(f"[0-9A-Za-z{P.HAN}]", brackets[::2]) else rf"(?![\p{{Alnum}}{P.HAN}])") + f"[{P.quoted(brackets[::2])}]"
    pattern = f"(?={opening})(?:" + "|".join(f"{P.literal(a)}[^{P.quoted(a + b)}]*{P.literal(b)}" for a, b in pairs) + ")"
    return let(_c(col), lambda text: let(F.regexp_replace(text, pattern, ""), lambda t: _without_pairs(t, F.length(t) == F.length(text), opening, pattern)))


def _without_pairs(text: Column, done: Column, opening: str, pattern: str) -> Column:
    """``text`` after further passes: none if the first changed nothing (``done``), and no more than opening brackets are left."""
    rounds = F.array_repeat(F.lit(0), F.when(done, F.lit(0)).otherwise(F.regexp_count(text, F.lit(opening))))
    step = lambda a: let(F.regexp_replace(a["t"], pattern, ""), lambda r: F.struct(r.alias("t"), (F.length(r) == F.length(a["t"])).alias("done")))
    start = F.struct(text.alias("t"), F.lit(False).alias("done"))
    return F.aggregate(rounds, start, lambda a, _: F.when(a["done"], a).otherwise(step(a)), lambda a: a["t"])


def replace_email(col: Text, token: str = "<email>") -> Column:
    return _put(col, P.EMAIL, token)


def replace_url(col: Text, token: str = "<url>") -> Column:
    return _put(col, P.URL, token)


def replace_phone(col: Text, token: str = "<tel>") -> Column:
    return _put(_put(col, P.CELL, token), P.LANDLINE, token)


def replace_ip(col: Text, token: str = "<ip>") -> Column:
    return _put(col, P.IP, token)


def replace_id_card(col: Text, token: str = "<id>") -> Column:
    return _put(col, P.ID_CARD, token)


def replace_qq(col: Text, strict: bool = True, token: str = "<qq>", words: bool = False) -> Column:
    """Strict: only in texts that name the service. Words: only numbers that no letter touches, so that names with numbers stay whole."""
    done = _put(col, P.QQ_WORD if words else P.QQ, token)
    return F.when(_c(col).rlike(P.QQ_NAMED), done).otherwise(_c(col)) if strict else done


def replace_chinese(col: Text, token: str = " ") -> Column:
    return _put(col, f"[{P.HAN}]", token)


def clean_text(
    col: Text, tags: bool = True, odd_chars: bool = True, half: bool = True, redundant: bool = True,
    brackets: bool = True, url: bool = True, email: bool = True, phone: bool = True,
) -> Column:
    """The chosen steps in fixed order, one projection."""
    steps = [
        (tags, remove_tags), (odd_chars, remove_odd_chars), (half, full_to_half), (redundant, remove_redundant),
        (brackets, remove_brackets), (url, remove_url), (email, remove_email), (phone, remove_phone),
    ]
    out = _c(col)
    for wanted, step in steps:
        if wanted:
            out = step(out)
    return out


# -- pages ------------------------------------------------------------------------
_BLOCKS = ("script", "style", "table", "form", "footer")


def clean_html(col: Text) -> Column:
    """Text of a page: blocks without content, comments and tags go, paragraphs and breaks become lines, entities are decoded.

    Menus are cut by ``udfs.cut_menus``, since balanced nesting isn't regular.
    """
    out = F.regexp_replace(_c(col), "[\n\t]", "")
    for name in _BLOCKS:
        out = F.regexp_replace(out, rf"(?i)<{name}\b[^>]*>[\s\S]*?</{name}\s*>", "")
    out = F.regexp_replace(out, r"<!--[\s\S]*?-->", "")
    out = F.regexp_replace(out, r"(?i)<meta\b[^>]*>", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)(</(?:p|h[1-5])\s*>)", "\n$1")
    out = F.regexp_replace(out, r"<[^<>]*>", "")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def meta_info(col: Text) -> Column:
    """description, keywords, classification, language of a page's meta tags: map, without those that are missing."""
    names = ("description", "keywords", "classification", "language")
    tag = lambda n: F.regexp_extract(_c(col), rf"(?i)(<meta\b[^>]*\bname\s*=\s*[\"']?{n}[\"']?[^>]*>)", 1)
    content = lambda n: F.regexp_extract(tag(n), r"(?i)\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1)
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), content(n).alias("value")) for n in names]), lambda e: e["value"] != "")
    return F.when(_c(col).isNotNull(), F.map_from_entries(entries))


# -- conversion -------------------------------------------------------------------
def convert_chars(col: Text, table: dict[str, str]) -> Column:
    """Character by character, for example between traditional and simplified; ``table`` is a dictionary of single characters."""
    one = {k: v for k, v in table.items() if len(k) == len(v) == 1 and k != v}
    return F.translate(_c(col), "".join(one), "".join(one.values())) if one else _c(col)


def convert_words(col: Text, table: dict[str, str]) -> Column:
    """Longest match first from the left; characters that begin no word stay. For tables of some thousand words; see operators.lexicon for larger ones."""
    table = {k: v for k, v in table.items() if k}
    if not table:
        return _c(col)
    words = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])
    parts = F.split(F.regexp_replace(F.translate(_c(col), "\x01\x02", "  "), P.alternation(table), "\x01$1\x02"), "[\x01\x02]")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.element_at(words, p)).otherwise(p)), "")


def characters(col: Text) -> Column:
    """Code points of a text."""
    return F.filter(F.split(_c(col), ""), lambda c: c != "")


def byte_alphabet() -> list[str]:
    """Printable stand-ins of the 256 bytes: itself if printable Latin-1, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def bytes_to_chars(col: Text) -> Column:
    """UTF-8 bytes of a text, each as its stand-in."""
    alphabet = byte_alphabet()
    latin = "".join(map(chr, range(1, 256)))
    # bytes as Latin-1 text, then one translation
    return F.translate(F.replace(F.decode(F.encode(_c(col), "UTF-8"), "ISO-8859-1"), F.lit("\x00"), F.lit(alphabet[0])), latin, "".join(alphabet[1:]))


def chars_to_bytes(col: Text) -> Column:
    """Text of stand-ins; bytes that are no UTF-8 become U+FFFD."""
    alphabet = byte_alphabet()
    latin = F.translate(_c(col), "".join(alphabet[1:]), "".join(map(chr, range(1, 256))))
    latin = F.replace(latin, F.lit(alphabet[0]), F.lit("\x00"))  # translate() deletes for a zero
    return F.make_valid_utf8(F.decode(F.encode(latin, "ISO-8859-1"), "UTF-8"))


_DIGITS = {"plain": "零一二三四五六七八九", "formal": "零壹贰叁肆伍陆柒捌玖"}
_SMALL = {"plain": ("", "十", "百", "千"), "formal": ("", "拾", "佰", "仟")}
_LARGE = {"plain": ("", "万", "亿", "兆"), "formal": ("", "萬", "亿", "兆")}


def number_to_chinese(col: Text, style: str = "formal") -> Column:
    """Chinese numeral of a number or its text: groups of four digits, zeros collapsed, two decimals at most.

    Null for what isn't a number below 10**16.
    """
    digits, small, large = _DIGITS[style], _SMALL[style], _LARGE[style]
    text = F.replace(_c(col).cast("string"), F.lit(","), F.lit(""))
    whole = F.lpad(F.regexp_extract(text, r"\A([0-9]+)", 1), 16, "0")
    point = F.regexp_replace(F.substring(F.regexp_extract(text, r"\.([0-9]*)", 1), 1, 2), "0+\\z", "")
    out = F.lit("")
    for g in range(4):
        group = F.substring(whole, 1 + 4 * g, 4)
        part = F.lit("")
        for k in range(4):
            d = F.substring(group, 1 + k, 1)
            part = F.concat(part, F.when(d == "0", F.lit("零")).otherwise(F.concat(F.translate(d, "0123456789", digits), F.lit(small[3 - k]))))
        part = F.regexp_replace(F.regexp_replace(part, "零+", "零"), "零\\z", "")
        out = F.concat(out, F.when(group == "0000", F.lit("零")).otherwise(F.concat(part, F.lit(large[3 - g]))))
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "零+", "零"), "\\A零", ""), "零\\z", "")
    if style == "plain":
        out = F.regexp_replace(out, "\\A一十", "十")
    out = F.when(out == "", F.lit("零")).otherwise(out)
    dot = "点" if style == "plain" else "點"
    out = F.concat(out, F.when(point == "", F.lit("")).otherwise(F.concat(F.lit(dot), F.translate(point, "0123456789", digits))))
    return F.when(text.rlike(r"\A[0-9]{1,16}(\.[0-9]*)?\z"), out)


# -- identifiers --------------------------------------------------------------------
def plate_info(col: Text) -> Column:
    """struct<car_loc, car_type GV|PEV|NPEV, car_size>; null if it is no plate."""
    body = F.regexp_replace(F.substring(_c(col), 3, 9), "[·. 　]", "")
    green = lambda letter: F.when(letter.between("A", "E"), F.lit("PEV")).otherwise(F.lit("NPEV"))
    small = body.rlike("\\A[A-HJK](?:[A-HJ-NP-Za-hj-np-z][0-9]{4}|[0-9]{5})\\z")
    large = body.rlike("\\A[0-9]{5}[A-HJK]\\z")
    kind = F.when(F.length(body) == 5, F.lit("GV")).when(small, green(F.substring(body, 1, 1))).when(large, green(F.substring(body, 6, 1)))
    size = F.when((F.length(body) == 6) & small, F.lit("small")).when((F.length(body) == 6) & large, F.lit("big"))
    valid = _c(col).rlike(rf"\A{P.PLATE}\z")
    return F.when(valid, F.struct(F.substring(_c(col), 1, 2).alias("car_loc"), kind.alias("car_type"), size.alias("car_size")))


def id_card_info(col: Text) -> Column:
    """struct<area, birth_year, birth_month, birth_day, gender, check_code>; null if it is no card number. ``area`` joins ``operators.places``."""
    part = lambda a, n: F.substring(_c(col), a, n)
    gender = F.when(part(17, 1).cast("int") % 2 == 1, F.lit("男")).otherwise(F.lit("女"))
    return F.when(
        _c(col).rlike(P.ID_CARD_WHOLE),
        F.struct(
            part(1, 6).alias("area"), part(7, 4).alias("birth_year"), part(11, 2).alias("birth_month"), part(13, 2).alias("birth_day"),
            gender.alias("gender"), F.lower(part(18, 1)).alias("check_code"),
        ),
    )


def phone_info(col: Text) -> Column:
    """struct<type, prefix7, area_code>: what a number's place and operator are looked up by."""
    text = _c(col)
    cell = F.regexp_replace(F.regexp_extract(text, rf"(?<!{P.DIGIT})(?:\+86[- ]?)?(1[3-9][0-9][- ]?{P.DIGIT}{{4}})[- ]?{P.DIGIT}{{4}}(?!{P.DIGIT})", 1), "[- ]", "")
    area = F.regexp_extract(text, P.AREA_CODE, 1)
    kind = F.when(cell != "", F.lit("cell_phone")).when(text.rlike(P.LANDLINE), F.lit("landline_phone")).otherwise(F.lit("unknown"))
    return F.when(text.isNotNull(), F.struct(kind.alias("type"), F.nullif(cell, F.lit("")).alias("prefix7"), F.when(cell == "", F.nullif(area, F.lit(""))).alias("area_code")))


# Short names of the provinces.
PROVINCE_NAMES = (
    "香港 澳门 台湾 北京 天津 上海 重庆 黑龙江 吉林 辽宁 新疆 西藏 青海 内蒙古 山西 河北 河南 甘肃 陕西 四川 贵州 云南 宁夏 江苏 浙江 安徽 山东 江西 湖北 湖南 广东 福建 广西 海南"
).split()


def province_alias(col: Text) -> Column:
    return F.nullif(F.regexp_extract(_c(col), P.alternation(PROVINCE_NAMES), 1), F.lit(""))


def _alias(col: Text, endings: tuple[str, ...], peoples: tuple[str, ...]) -> Column:
    """Without its ending; a name that holds a people's name is cut before the first of them."""
    name = _c(col)
    out = name
    if peoples:
        out = F.regexp_replace(out, f"(?<=..)(?:{'|'.join(map(P.literal, sorted(peoples, key=len, reverse=True)))}).*(?:自治)?[州县区旗乡]\\z", "")
    stripped = F.regexp_replace(out, f"(?<=..)(?:{'|'.join(endings)})\\z", "")
    return F.when(out == name, stripped).otherwise(out)


PEOPLES = ("蒙古族", "回族", "藏族", "维吾尔", "哈萨克", "苗族", "彝族", "壮族", "布依族", "朝鲜族", "满族", "侗族", "瑶族", "白族", "土家族", "哈尼族", "傣族", "黎族", "傈僳族", "佤族", "畲族", "羌族", "景颇族", "蒙古", "各族")


def city_alias(col: Text, keep: tuple[str, ...] = (), peoples: tuple[str, ...] = PEOPLES) -> Column:
    return _alias(col, tuple(e for e in ("市", "地区", "盟") if e not in keep), peoples)


def county_alias(col: Text, peoples: tuple[str, ...] = PEOPLES) -> Column:
    return _alias(col, ("林区", "县", "区", "市", "旗"), peoples)


def town_alias(col: Text, peoples: tuple[str, ...] = PEOPLES) -> Column:
    return _alias(col, ("街道", "地区", "镇", "乡"), peoples)


def is_person_name(col: Text, single: str, compound: tuple[str, ...]) -> Column:
    """Two to four characters that begin with a surname; ``single`` and ``compound`` are the surnames."""
    name, n = _c(col), F.length(_c(col))
    one = lambda a: F.substring(name, a, 1).isin(*single)
    two = F.substring(name, 1, 2).isin(*compound)
    return F.coalesce(F.when(n == 2, one(1)).when(n == 3, one(1) | two).when(n == 4, two | (one(1) & one(2))).otherwise(False), F.lit(False))


def filter_tokens(col: Text, stopwords: list[str], numbers: bool = False, non_chinese: bool = False, times: bool = False, places: list[str] | None = None, keep: list[str] | None = None) -> Column:
    """Tokens without stopwords (but those of ``keep``) and, if asked for, numbers, times, places and tokens without Chinese."""
    drop = [w for w in {*stopwords, "", " ", "\t"} if w not in (keep or ())]
    kept = F.filter(_c(col), lambda t: ~t.isin(*drop))
    if numbers:
        kept = F.filter(kept, lambda t: ~t.rlike(r"\A(?:(?:[十百千万]分之)|[第数好-])?[零〇一二两三四五六七八九十百千万亿点\p{Nd}%％.,．多余几]+(?:[~～－至-]?[零〇一二两三四五六七八九十百千万亿点\p{Nd}%％.,．多余几]+)?[多余]?\z"))
    if times:
        kept = F.filter(kept, lambda t: ~t.rlike(r"\A[\p{Nd}零〇一二两三四五六七八九十年月日号时点分秒周星期上下本去今明昨前后早晚午凌晨:-]*[年月日号时点分秒周天午晨晚]\z"))
    if places:
        kept = F.filter(kept, lambda t: ~t.isin(*places))
    if non_chinese:
        kept = F.filter(kept, lambda t: t.rlike(f"[{P.HAN}]"))
    return kept


def hamming(a: Text, b: Text) -> Column:
    """Differing bits of two bigints."""
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))
