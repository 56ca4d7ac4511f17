"""Sequence labels and spans as array expressions.

Spans are array<struct<text,start,end,type>>, half-open and counted from zero.
Arrays are those of one sentence; each is walked once or sorted, never paired with itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str
SPANS = "array<struct<text:string,start:int,end:int,type:string>>"


def _c(col: Col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def disjoint(spans: Col) -> Column:
    """Spans by start; one that overlaps a kept one before it goes."""
    by_start = F.array_sort(_c(spans), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    return F.aggregate(
        by_start,
        F.struct(F.lit(0).alias("at"), _none(SPANS).alias("out")),
        lambda s, x: F.when(x["start"] >= s["at"], F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(_as_span(x))).alias("out"))).otherwise(s),
        lambda s: s["out"],
    )


def _as_span(x: Column) -> Column:
    return F.struct(x["text"].alias("text"), x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["type"].cast("string").alias("type"))


def spans_to_tags(tokens: Col, spans: Col) -> Column:
    """B- I- E- S- tags by type, O elsewhere."""
    n = F.size(_c(tokens))

    def tags(kept: Column) -> Column:
        one = lambda x: F.when(x["end"] - x["start"] == 1, F.array(F.concat(F.lit("S-"), x["type"]))).otherwise(
            F.concat(
                F.array(F.concat(F.lit("B-"), x["type"])),
                F.array_repeat(F.concat(F.lit("I-"), x["type"]), F.greatest(x["end"] - x["start"] - 2, F.lit(0))),
                F.array(F.concat(F.lit("E-"), x["type"])),
            )
        )
        gap = lambda i: F.array_repeat(F.lit("O"), F.greatest(F.get(kept, i)["start"] - F.coalesce(F.get(kept, F.when(i > 0, i - 1))["end"], F.lit(0)), F.lit(0)))
        body = F.flatten(F.transform(kept, lambda x, i: F.concat(gap(i), one(x))))
        return F.concat(body, F.array_repeat(F.lit("O"), F.greatest(n - F.size(body), F.lit(0))))

    return F.get(F.transform(F.array(F.filter(disjoint(spans), lambda x: (x["start"] < x["end"]) & (x["end"] <= n))), tags), F.lit(0))


def _starts(n: Column, begins) -> Column:
    return F.filter(F.sequence(F.lit(0), n - 1), begins)


def tags_to_spans(tokens: Col, tags: Col) -> Column:
    """Spans of B I E S tags: from a B or S up to the E of the same type; what doesn't close is left out."""
    tok, tag = _c(tokens), _c(tags)
    kind = lambda i: F.regexp_extract(F.get(tag, i), "\\A[BIES]-(.*)\\z", 1)
    at = lambda i: F.substring(F.get(tag, i), 1, 1)

    def step(s: Column, i: Column) -> Column:
        emit = F.struct(
            F.array_join(F.slice(tok, s["from"] + 1, i - s["from"] + 1), "").alias("text"), s["from"].cast("int").alias("start"), (i + 1).cast("int").alias("end"), kind(i).alias("type")
        )
        single = F.struct(F.get(tok, i).alias("text"), i.cast("int").alias("start"), (i + 1).cast("int").alias("end"), kind(i).alias("type"))
        reset = lambda out: F.struct(F.lit(-1).alias("from"), F.lit("").alias("type"), out.alias("out"))
        return (
            F.when(at(i) == "S", reset(F.concat(s["out"], F.array(single))))
            .when(at(i) == "B", F.struct(i.alias("from"), kind(i).alias("type"), s["out"].alias("out")))
            .when((at(i) == "E") & (s["from"] >= 0) & (s["type"] == kind(i)), reset(F.concat(s["out"], F.array(emit))))
            .when((at(i) == "I") & (s["from"] >= 0) & (s["type"] == kind(i)), s)
            .otherwise(reset(s["out"]))
        )

    start = F.struct(F.lit(-1).alias("from"), F.lit("").alias("type"), _none(SPANS).alias("out"))
    n = F.least(F.size(tok), F.size(tag))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: s["out"])).otherwise(_none(SPANS))


def words_to_tags(words: Col) -> Column:
    """B for the first character of a word, I for the others."""
    return F.flatten(F.transform(_c(words), lambda w: F.concat(F.array(F.lit("B")), F.array_repeat(F.lit("I"), F.length(w) - 1))))


def tags_to_words(chars: Col, tags: Col) -> Column:
    """Words of a text by its B and I tags; the first character begins a word whatever its tag."""
    text, tag = _c(chars), _c(tags)
    n = F.least(F.length(text), F.size(tag))

    def words(st: Column) -> Column:
        return F.transform(st, lambda p, j: F.substring(text, p + 1, F.coalesce(F.get(st, j + 1), n) - p))

    begins = _starts(n, lambda i: (i == 0) | F.get(tag, i).startswith("B"))
    return F.when(n > 0, F.get(F.transform(F.array(begins), words), F.lit(0))).otherwise(_none("array<string>"))


def pos_to_tags(words: Col) -> Column:
    """array<struct<word,pos>> to B-pos, I-pos."""
    return F.flatten(F.transform(_c(words), lambda w: F.concat(F.array(F.concat(F.lit("B-"), w["pos"])), F.array_repeat(F.concat(F.lit("I-"), w["pos"]), F.length(w["word"]) - 1))))


def tags_to_pos(chars: Col, tags: Col) -> Column:
    text, tag = _c(chars), _c(tags)
    n = F.least(F.length(text), F.size(tag))

    def words(st: Column) -> Column:
        return F.transform(st, lambda p, j: F.struct(F.substring(text, p + 1, F.coalesce(F.get(st, j + 1), n) - p).alias("word"), F.substring(F.get(tag, p), F.lit(3), F.length(F.get(tag, p))).alias("pos")))

    begins = _starts(n, lambda i: (i == 0) | F.get(tag, i).startswith("B"))
    return F.when(n > 0, F.get(F.transform(F.array(begins), words), F.lit(0))).otherwise(_none("array<struct<word:string,pos:string>>"))


def _bounds(words: Col) -> Column:
    """0 and the end of each word, in characters."""
    return F.aggregate(
        _c(words), F.array(F.lit(0)), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + F.length(w)))
    )


def char_to_word_spans(spans: Col, words: Col) -> Column:
    """Offsets in characters to offsets in words; spans that don't meet word edges go."""
    w = _c(words)

    def turned(b: Column) -> Column:
        moved = F.transform(_c(spans), lambda x: F.struct(x["text"].alias("text"), (F.array_position(b, x["start"]) - 1).cast("int").alias("start"), (F.array_position(b, x["end"]) - 1).cast("int").alias("end"), x["type"].alias("type")))
        return F.filter(moved, lambda x: (x["start"] >= 0) & (x["end"] > x["start"]))

    return F.get(F.transform(F.array(_bounds(w)), turned), F.lit(0))


def word_to_char_spans(spans: Col, words: Col) -> Column:
    def turned(b: Column) -> Column:
        return F.transform(_c(spans), lambda x: F.struct(x["text"].alias("text"), F.get(b, x["start"]).alias("start"), F.get(b, x["end"]).alias("end"), x["type"].alias("type")))

    return F.get(F.transform(F.array(_bounds(words)), turned), F.lit(0))


def chunks(col: Col, size: int, overlap: int = 0) -> Column:
    """Parts of at most ``size`` tokens, each ``overlap`` tokens into the one before."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")
    c = _c(col)
    last = F.greatest(F.size(c) - overlap - 1, F.lit(0))
    return F.when(F.size(c) > 0, F.transform(F.sequence(F.lit(0), last, F.lit(size - overlap)), lambda i: F.slice(c, i + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def rejoin(col: Col, overlap: int = 0) -> Column:
    """Inverse of ``chunks`` for labels: of the overlap, the first half comes from the part before, the rest from the part after."""
    c = _c(col)
    head = overlap - overlap // 2
    cut = lambda p, i: F.slice(p, F.when(i == 0, 1).otherwise(1 + overlap // 2), F.greatest(F.size(p) - F.when(i == 0, 0).otherwise(overlap // 2) - F.when(i == F.size(c) - 1, 0).otherwise(head), F.lit(0)))
    return F.flatten(F.transform(c, cut))
