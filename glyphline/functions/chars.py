"""What dictionaries tell of single characters: pronunciation and parts of the character. The dictionaries are parameters."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands for a character without an entry.
NO_SOUND, NO_RADICAL = "<py_unk>", ("<cr_unk>", "一体结构", "00000", "<so_unk>", "XXXX")
_ACCENTS = {"̄": "1", "́": "2", "̌": "3", "̀": "4"}
_INITIAL = re.compile("zh|ch|sh|ng|hng|hm|[bcdfghjklmnpqrstwxyz]|")
SOUND = T.StructType([T.StructField(x, T.StringType()) for x in ("consonant", "vowel", "tone")])
RADICAL = T.StructType([T.StructField(x, T.StringType()) for x in ("radical", "structure", "corner_coding", "stroke_order", "wubi_coding")])


def numbered_tone(syllable: str) -> str:
    """shān to shan1, lǜ to lv4; without an accent the tone is 5."""
    letters, tone = "", "5"
    for c in unicodedata.normalize("NFD", syllable):
        if c in _ACCENTS:
            tone = _ACCENTS[c]
        elif c == "̈":
            letters = letters[:-1] + "v"
        else:
            letters += c
    return letters + tone


def syllable_parts(numbered: str) -> dict[str, str]:
    """Initial, final and tone of a syllable with its tone's number."""
    consonant = _INITIAL.match(numbered)[0]
    return {"consonant": consonant, "vowel": numbered[len(consonant) : -1], "tone": numbered[-1]}


def spoken(text: str, made, form: str) -> list:
    """One entry a character of ``text``; ``made``: automaton from phrase or character to its syllables."""
    show = {
        "standard": lambda s: s,
        "simple": lambda s: s if s == NO_SOUND else numbered_tone(s),
        "detail": lambda s: dict.fromkeys(("consonant", "vowel", "tone"), "") if s == NO_SOUND else syllable_parts(numbered_tone(s)),
    }[form]
    out: list[str] = []
    for end, (n, syllables) in made.iter_long(text) if len(made) else ():
        out += [NO_SOUND] * (end - n + 1 - len(out)) + syllables
    return [show(s) for s in out + [NO_SOUND] * (len(text) - len(out))]


def pinyin(col: Column | str, phrases: dict[str, list[str]], chars: dict[str, list[str]], form: str = "standard") -> Column:
    """One entry a character: the longest phrase's syllables, else the character's first, else ``NO_SOUND``.

    ``form``: standard (shān), simple (shan1), or detail (struct of consonant, vowel and tone).
    A phrase must have a syllable a character.
    """
    if form not in ("standard", "simple", "detail"):
        raise ValueError("form is one of standard, simple, detail")
    words = {w: list(s) for w, s in phrases.items() if w} | {c: [s[0]] for c, s in chars.items() if s and c not in phrases}
    if any(len(w) != len(s) for w, s in words.items()):
        raise ValueError("a phrase needs a syllable for each character")
    made: list = []

    @F.pandas_udf(T.ArrayType(SOUND if form == "detail" else T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        if not made:
            import ahocorasick

            made.append(ahocorasick.Automaton())
            for w, s in words.items():
                made[0].add_word(w, (len(w), s))
            if words:
                made[0].make_automaton()
        return pd.Series([None if t is None else spoken(t, made[0], form) for t in texts], dtype=object)

    return run(F.col(col) if isinstance(col, str) else col)


def radicals(col: Column | str, table: dict[str, tuple[str, str, str, str, str]]) -> Column:
    """array<struct<radical,structure,corner_coding,stroke_order,wubi_coding>>, one a character; ``NO_RADICAL`` for one without an entry."""

    @F.pandas_udf(T.ArrayType(RADICAL))
    def run(texts: pd.Series) -> pd.Series:
        names = [f.name for f in RADICAL.fields]
        entry = lambda c: dict(zip(names, table.get(c, NO_RADICAL), strict=True))
        return pd.Series([None if t is None else [entry(c) for c in t] for t in texts], dtype=object)

    return run(F.col(col) if isinstance(col, str) else col)
