"""The Chinese calendar from astronomy, and conversions as joins with its months.

New moons and the sun's longitude are computed by the usual series (Meeus, about a
minute and 0.01 degrees), days are those of Beijing (UTC+8). The month that holds
the winter solstice is the 11th; of thirteen months between two solstices the first
without a principal term is the leap month. The table of the months of 1900 to 2100
(some 2,500 rows) is built once on the driver and broadcast.
"""

from __future__ import annotations

import math
from datetime import date, timedelta
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_EPOCH = date(2000, 1, 1).toordinal() - 2451544.5  # ordinal of a Julian day that begins at midnight
TERMS = "春分 清明 谷雨 立夏 小满 芒种 夏至 小暑 大暑 立秋 处暑 白露 秋分 寒露 霜降 立冬 小雪 大雪 冬至 小寒 大寒 立春 雨水 惊蛰".split()


def _delta_t(year: float) -> float:
    """Seconds between dynamical and universal time."""
    t = year - 2000
    if year < 1920:
        u = year - 1900
        return -2.79 + 1.494119 * u - 0.0598939 * u**2 + 0.0061966 * u**3 - 0.000197 * u**4
    if year < 1961:
        u = year - 1920 if year < 1941 else year - 1950
        return 21.20 + 0.84493 * u - 0.0761 * u**2 + 0.0020936 * u**3 if year < 1941 else 29.07 + 0.407 * u - u**2 / 233 + u**3 / 2547
    if year < 1986:
        u = year - 1975
        return 45.45 + 1.067 * u - u**2 / 260 - u**3 / 718
    if year < 2005:
        return 63.86 + 0.3345 * t - 0.060374 * t**2 + 0.0017275 * t**3
    return 62.92 + 0.32217 * t + 0.005589 * t**2


def _local(jde: float) -> date:
    """Beijing day of an instant of dynamical time."""
    year = 2000 + (jde - 2451545) / 365.25
    return date.fromordinal(math.floor(jde - _delta_t(year) / 86400 + 8 / 24 + _EPOCH))


def new_moon(k: int) -> float:
    """Julian ephemeris day of the ``k``-th new moon from January 2000 on."""
    t = k / 1236.85
    jde = 2451550.09766 + 29.530588861 * k + 0.00015437 * t**2 - 0.00000015 * t**3
    e = 1 - 0.002516 * t - 0.0000074 * t**2
    rad = math.radians
    m, mm = rad(2.5534 + 29.1053567 * k - 0.0000014 * t**2), rad(201.5643 + 385.81693528 * k + 0.0107582 * t**2 + 0.00001238 * t**3)
    f, om = rad(160.7108 + 390.67050284 * k - 0.0016118 * t**2), rad(124.7746 - 1.56375588 * k + 0.0020672 * t**2)
    s = math.sin
    jde += (
        -0.4072 * s(mm) + 0.17241 * e * s(m) + 0.01608 * s(2 * mm) + 0.01039 * s(2 * f) + 0.00739 * e * s(mm - m) - 0.00514 * e * s(mm + m)
        + 0.00208 * e * e * s(2 * m) - 0.00111 * s(mm - 2 * f) - 0.00057 * s(mm + 2 * f) + 0.00056 * e * s(2 * mm + m) - 0.00042 * s(3 * mm)
        + 0.00042 * e * s(m + 2 * f) + 0.00038 * e * s(m - 2 * f) - 0.00024 * e * s(2 * mm - m) - 0.00017 * s(om) - 0.00007 * s(mm + 2 * m)
        + 0.00004 * s(2 * mm - 2 * f) + 0.00004 * s(3 * m) + 0.00003 * s(mm + m - 2 * f) + 0.00003 * s(2 * mm + 2 * f) - 0.00003 * s(mm + m + 2 * f)
    )
    planets = ((299.77, 0.107408, 0.000325), (251.88, 0.016321, 0.000165), (251.83, 26.651886, 0.000164), (349.42, 36.412478, 0.000126), (84.66, 18.206239, 0.00011), (141.74, 53.303771, 0.000062), (207.14, 2.453732, 0.00006), (154.84, 7.30686, 0.000056), (34.52, 27.261239, 0.000047), (207.19, 0.121824, 0.000042), (291.34, 1.844379, 0.00004), (161.72, 24.198154, 0.000037), (239.56, 25.513099, 0.000035), (331.55, 3.592518, 0.000023))
    for a, b, c in planets:
        jde += c * s(rad(a + b * k - (0.009173 * t**2 if a == 299.77 else 0)))
    return jde


def sun(jde: float) -> float:
    """Apparent longitude of the sun in degrees."""
    t = (jde - 2451545) / 36525
    m = math.radians(357.52911 + 35999.05029 * t - 0.0001537 * t * t)
    c = (1.914602 - 0.004817 * t - 0.000014 * t * t) * math.sin(m) + (0.019993 - 0.000101 * t) * math.sin(2 * m) + 0.000289 * math.sin(3 * m)
    # the largest terms of the moon and the planets
    w = lambda a, b: math.cos(math.radians(a + b * t))
    c += 0.00134 * w(153.23, 22518.7541) + 0.00154 * w(216.57, 45037.5082) + 0.002 * w(312.69, 32964.3577) - 0.00179 * math.sin(math.radians(351.52 + 20.2 * t)) * 0 + 0.00178 * math.sin(math.radians(297.85 + 445267.1115 * t))
    omega = math.radians(125.04 - 1934.136 * t)
    return (280.46646 + 36000.76983 * t + 0.0003032 * t * t + c - 0.00569 - 0.00478 * math.sin(omega)) % 360


@lru_cache(maxsize=8192)
def solar_term(year: int, index: int) -> date:
    """Day of the term at longitude 15 * index (0: 春分) that falls in ``year``."""
    target = 15.0 * index
    first = 2451623.8 + (year - 2000) * 365.2422  # about 20 March
    jde = first + ((target if index < 19 else target - 360) / 360) * 365.2422
    for _ in range(20):
        off = (target - sun(jde) + 180) % 360 - 180
        jde += off * 365.2422 / 360
        if abs(off) < 1e-6:
            break
    return _local(jde)


def term_day(name: str, year: int) -> date:
    return solar_term(year, TERMS.index(name))


@lru_cache(maxsize=1)
def months(first: int = 1900, last: int = 2100) -> tuple[tuple[int, int, bool, date, int], ...]:
    """(lunar year, month, leap, first day, days), ascending."""
    out: list[tuple[int, int, bool, date]] = []
    for year in range(first - 1, last + 2):
        a, b = solar_term(year - 1, 18), solar_term(year, 18)
        k = round((a.toordinal() - date(2000, 1, 6).toordinal()) / 29.530588) - 2
        begins = []
        while True:
            day = _local(new_moon(k))
            begins.append(day)
            if day > b:
                break
            k += 1
        i = max(j for j, d in enumerate(begins) if d <= a)
        j = max(j for j, d in enumerate(begins) if d <= b)
        own = begins[i : j + 1]  # 11th month to the next 11th month
        principal = sorted(solar_term(y, x) for y in (year - 1, year) for x in range(0, 24, 2))
        leap_at = None
        if len(own) == 14:
            leap_at = next(n for n in range(1, 13) if not any(own[n] <= p < own[n + 1] for p in principal))
        number, y = 11, year - 1
        for n, d in enumerate(own[:-1]):
            if n:
                if n == leap_at:
                    out.append((y, number, True, d))
                    continue
                number = number % 12 + 1
                y += number == 1
            out.append((y, number, False, d))
    out.sort(key=lambda r: r[3])
    sized = [(*r, (n[3] - r[3]).days) for r, n in zip(out, out[1:], strict=False)]
    return tuple(r for r in sized if first <= r[0] <= last)


def to_solar(year: int, month: int, day: int, leap: bool = False) -> date | None:
    for y, m, is_leap, start, n in _by_year().get(year, ()):
        if m == month and is_leap == leap and 1 <= day <= n:
            return start + timedelta(day - 1)
    return None


@lru_cache(maxsize=1)
def _by_year() -> dict[int, list]:
    out: dict[int, list] = {}
    for r in months():
        out.setdefault(r[0], []).append(r)
    return out


def table(spark: SparkSession) -> DataFrame:
    """l_year, l_month, l_leap, l_start, l_days: about 2,500 rows whatever the data."""
    return spark.createDataFrame(list(months()), "l_year int, l_month int, l_leap boolean, l_start date, l_days int")


def lunar_to_solar(df: DataFrame, year: str, month: str, day: str, leap: str | None = None, out: str = "solar") -> DataFrame:
    """``df`` with the date of a lunar one; null where there is no such day."""
    t = F.broadcast(table(df.sparkSession))
    is_leap = F.coalesce(F.col(leap), F.lit(False)) if leap else F.lit(False)
    on = (F.col(year) == t["l_year"]) & (F.col(month) == t["l_month"]) & (is_leap == t["l_leap"]) & F.col(day).between(1, t["l_days"])
    return df.join(t, on, "left").withColumn(out, F.expr(f"date_add(l_start, cast(`{day}` as int) - 1)")).drop("l_year", "l_month", "l_leap", "l_start", "l_days")


def solar_to_lunar(df: DataFrame, day: str, out: str = "lunar") -> DataFrame:
    """``df`` with struct<year,month,day,leap>; null outside 1900 to 2100.

    An equi-join on the months that begin in the date's month or the two before,
    so that no range is searched.
    """
    t = table(df.sparkSession)
    span = F.explode(F.sequence(F.trunc("l_start", "MM"), F.expr("trunc(date_add(l_start, l_days - 1), 'MM')"), F.expr("interval 1 month")))
    t = F.broadcast(t.withColumn("l_in", span))
    d = F.col(day).cast("date")
    on = (F.trunc(d, "MM") == t["l_in"]) & (d >= t["l_start"]) & (F.datediff(d, t["l_start"]) < t["l_days"])
    made = F.when(F.col("l_year").isNotNull(), F.struct(F.col("l_year").alias("year"), F.col("l_month").alias("month"), (F.datediff(d, F.col("l_start")) + 1).alias("day"), F.col("l_leap").alias("leap")))
    return df.join(t, on, "left").withColumn(out, made).drop("l_year", "l_month", "l_leap", "l_start", "l_days", "l_in")


def lunar_text(lunar: Column | str) -> Column:
    """Chinese text of struct<year,month,day,leap>, with stem, branch and animal of the year."""
    c = F.col(lunar) if isinstance(lunar, str) else lunar
    pick = lambda chars, i: F.substring(F.lit(chars), (i + 1).cast("int"), F.lit(1))
    y, m, d = c["year"], c["month"], c["day"]
    ten = "零一二三四五六七八九十"
    month = F.when(m == 1, F.lit("正")).when(m == 12, F.lit("腊")).when(m <= 10, pick(ten, m)).otherwise(F.concat(F.lit("十"), pick(ten, m - 10)))
    day = (
        F.when(d <= 10, F.concat(F.lit("初"), pick(ten, d))).when(d < 20, F.concat(F.lit("十"), pick(ten, d - 10))).when(d == 20, F.lit("二十"))
        .when(d < 30, F.concat(F.lit("二十"), pick(ten, d - 20))).otherwise(F.lit("三十"))
    )
    stem = F.concat(pick("甲乙丙丁戊己庚辛壬癸", (y - 4) % 10), pick("子丑寅卯辰巳午未申酉戌亥", (y - 4) % 12))
    return F.concat(
        F.translate(y.cast("string"), "0123456789", "零一二三四五六七八九"), F.lit("年"), F.when(c["leap"], F.lit("闰")).otherwise(F.lit("")), month, F.lit("月"), day,
        F.lit(" "), stem, F.lit("年 ("), pick("鼠牛虎兔龙蛇马羊猴鸡狗猪", (y - 4) % 12), F.lit("年)"),
    )
