"""Longest-match-first search for the words of a dictionary.

At each place the longest word wins and the search goes on behind it; a place
where none begins is skipped. Two forms give the same result: ``entities``, one
alternation inside whole-stage codegen for up to some thousand words, and
``entities_large``, an Aho-Corasick automaton broadcast to the workers, whose size
is checked. Matching ignores ASCII case. A word of several types has the first.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphline.functions import patterns as P
from glyphline.functions.tags import SPANS
from glyphline.functions.text import find_spans
from glyphline.shared import once

SMALL_WORDS = 2_000
#: Most characters of words that are sent to every worker; the automaton takes some 40 bytes for each.
MAX_CHARS = 16 << 20


def flat(lexicon: dict[str, list[str]]) -> dict[str, str]:
    """Lower-case word to type; the first type wins."""
    out: dict[str, str] = {}
    for kind, words in lexicon.items():
        for w in words:
            if w:
                out.setdefault(w.lower(), kind)
    return out


def entities(col: Column | str, lexicon: dict[str, list[str]]) -> Column:
    """array<struct<text,start,end,type>> of the dictionary's words in a text."""
    words = flat(lexicon)
    if not words:
        return F.array().cast(SPANS)
    if len(words) > SMALL_WORDS:
        raise ValueError(f"more than {SMALL_WORDS} words: use entities_large")
    kinds = F.create_map(*[F.lit(x) for kv in sorted(words.items()) for x in kv])
    spans = find_spans(F.lower(F.col(col) if isinstance(col, str) else col), P.alternation(words))
    whole = F.col(col) if isinstance(col, str) else col
    return F.transform(
        spans,
        lambda s: F.struct(F.substring(whole, s["start"] + 1, s["end"] - s["start"]).alias("text"), s["start"].alias("start"), s["end"].alias("end"), F.element_at(kinds, s["text"]).alias("type")),
    )


def automaton(words: dict[str, str]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for w, kind in words.items():
        made.add_word(w, (len(w), kind))
    made.make_automaton()
    return made


def longest(text: str, made) -> list[tuple[str, int, int, str]]:
    low = text.lower() if len(text.lower()) == len(text) else text
    return [(text[e - n + 1 : e + 1], e - n + 1, e + 1, kind) for e, (n, kind) in made.iter_long(low)]


def entities_large(df: DataFrame, text_col: str, lexicon: dict[str, list[str]], out: str = "entities") -> DataFrame:
    """``df`` with the spans of a large dictionary in ``out``."""
    words = flat(lexicon)
    if sum(map(len, words)) > MAX_CHARS:
        raise ValueError("dictionary is too large for one worker: split it and look for each part")
    key = f"lexicon {uuid.uuid4().hex}"
    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(words))
    words_known = bool(words)
    kept = [c for c in df.columns if c != out]
    at = kept.index(text_col)
    span = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("type", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = once(key, lambda: automaton(pickle.loads(shared.value))) if words_known else None
        for b in batches:
            rows = []
            for t in b.column(at).to_pylist():
                found = longest(t, made) if t and made is not None else ([] if t is not None else None)
                rows.append(None if found is None else [dict(zip(("text", "start", "end", "type"), x, strict=True)) for x in found])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, span)], names=[*kept, out])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[f"`{c}`" for c in kept]).schema.fields)
    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, f"{ddl}, `{out}` {SPANS}")


def _edges(words: Column, spans: Column) -> Column:
    """Offsets at which a sentence is cut when ``spans`` are whole words: 0, ..., its length."""
    cuts = F.aggregate(words, F.array(F.lit(0)), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + F.length(w))))
    inside = lambda p: F.exists(spans, lambda s: (s["start"] < p) & (p < s["end"]))
    edges = F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"])))
    return F.array_sort(F.array_distinct(F.concat(F.filter(cuts, lambda p: ~inside(p)), edges)))


def _pieces(every: Column, make) -> Column:
    """``make(start, end)`` for each two neighbouring offsets."""
    each = lambda e: F.transform(F.slice(e, 1, F.greatest(F.size(e) - 1, F.lit(0))), lambda p, i: make(p, F.get(e, i + 1)))
    return F.get(F.transform(F.array(every), each), F.lit(0))


def resegment(col: Column | str, standard: list[str]) -> Column:
    """Words of a sentence (array) cut anew so that every standard word in its text is one word.

    Inside a standard word no cut is kept, at its edges there is one; all other cuts stay.
    """
    words = F.col(col) if isinstance(col, str) else col
    text = F.array_join(words, "")
    return _pieces(_edges(words, entities(text, {"w": standard})), lambda a, b: F.substring(text, a + 1, b - a))


def retag(col: Column | str, standard: dict[str, str]) -> Column:
    """array<struct<word,pos>> cut anew as by ``resegment``; standard words get their own part of speech, what is left of others keeps its."""
    tokens = F.col(col) if isinstance(col, str) else col
    words = F.transform(tokens, lambda t: t["word"])
    text = F.array_join(words, "")
    spans = entities(text, {kind: [w for w, k in standard.items() if k == kind] for kind in dict.fromkeys(standard.values())})
    ends = F.aggregate(words, F.array(F.lit(0)), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + F.length(w))))

    def piece(a: Column, b: Column) -> Column:
        own = F.filter(spans, lambda s: (s["start"] == a) & (s["end"] == b))
        old = F.get(tokens, F.size(F.filter(ends, lambda e: e <= a)) - 1)["pos"]
        return F.struct(F.substring(text, a + 1, b - a).alias("word"), F.coalesce(F.get(own, F.lit(0))["type"], old).alias("pos"))

    return _pieces(_edges(words, spans), piece)
