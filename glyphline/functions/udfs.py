"""Text functions that no expression can walk in linear time: Arrow batches of a worker.

Sentences with quotes, balanced brackets, nested page blocks, lexicon sentiment.
Null gives null.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphline.functions import patterns as P
from glyphline.functions.times import SPANS

STRINGS = T.ArrayType(T.StringType())
# Ends of sentences, and the quotes that keep them together.
COARSE, FINE = "。！？\n“”", "。！？\n“”，：；…、!?;,"
OPEN, CLOSE = "“‘「『", "”’」』"


def mapped(col: Column | str, kind: T.DataType, fn: Callable) -> Column:
    """``fn`` over a column, batch by batch."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else fn(x) for x in s], dtype=object)

    return run(F.col(col) if isinstance(col, str) else col)


def sentences(text: str, fine: bool = False) -> list[str]:
    """Sentences with their punctuation; what follows an opening quote belongs to it, and what follows a closing one unless it ended a sentence."""
    marks = FINE if fine else COARSE
    out: list[str] = []
    quoted = False
    for piece in re.split(f"([{re.escape(marks)}])", text):
        if not piece:
            continue
        if piece in marks:
            if not out:
                quoted = piece in OPEN
                out.append(piece)
            elif piece in OPEN:
                if out[-1][-1] in marks:
                    out.append(piece)
                else:
                    out[-1] += piece
                quoted = True
            else:
                out[-1] += piece
        elif out and (quoted or (out[-1][-1] in CLOSE and (len(out[-1]) == 1 or out[-1][-2] not in marks))):
            out[-1] += piece
            quoted = False
        else:
            out.append(piece)
    return out


def split_sentences(col: Column | str, fine: bool = False) -> Column:
    return mapped(col, STRINGS, lambda t: sentences(t, fine))


def bracketed(text: str, brackets: str = P.BRACKETS) -> list[dict]:
    """Balanced pairs with what they hold, in the order of their ends; a closing bracket of another kind than the open one is skipped."""
    partner = {brackets[i + 1]: brackets[i] for i in range(0, len(brackets), 2)}
    opened, out = [], []
    for i, c in enumerate(text):
        if c in partner:
            if opened and opened[-1][0] == partner[c]:
                _, a = opened.pop()
                out.append({"text": text[a : i + 1], "start": a, "end": i + 1, "type": "parentheses"})
        elif c in brackets:
            opened.append((c, i))
    return out


def extract_brackets(col: Column | str, brackets: str = P.BRACKETS) -> Column:
    return mapped(col, SPANS, lambda t: bracketed(t, brackets))


MENU = re.compile(r"(?i)<div\b[^>]*\b(?:id|class)\s*=\s*[\"'][^\"'>]*(?:menu|nav|header|footer|sidebar|breadcrumb|copyright|banner|toolbar|share|comment|login|search)[^>]*>")
_DIV = re.compile(r"(?i)<(/?)div\b[^>]*>")


def without_menus(page: str) -> str:
    """Blocks whose id or class names a menu or the like go, up to the end tag that balances them; one pass."""
    out, at = [], 0
    while m := MENU.search(page, at):
        out.append(page[at : m.start()])
        depth, end = 1, len(page)
        for d in _DIV.finditer(page, m.end()):
            depth += -1 if d[1] else 1
            if not depth:
                end = d.end()
                break
        at = end
    out.append(page[at:])
    return "".join(out)


def cut_menus(col: Column | str) -> Column:
    return mapped(col, T.StringType(), without_menus)


def unescape(col: Column | str) -> Column:
    """All HTML5 entities decoded."""
    return mapped(col, T.StringType(), html.unescape)


class Sentiment:
    """Mean over sentences of lexicon values; negation turns, intensifiers scale a neighbour, negative values count twice; then the logistic function."""

    def __init__(self, values: dict[str, float], negations: list[str], weights: dict[str, float]):
        from glyphline.operators.lexicon import automaton

        self.values, self.negations, self.weights = values, set(negations), weights
        words = dict.fromkeys([*values, *negations, *weights], "w")
        self.made = automaton({w.lower(): k for w, k in words.items() if w}) if any(words) else None

    def sentence(self, text: str) -> float:
        from glyphline.operators.lexicon import longest

        text = re.split("但是|但|可是|然而|不过", text)[-1]
        hits = longest(text, self.made) if self.made is not None else []
        found: list[float] = []
        turn, scale = 1.0, 1.0
        for i, (word, start, end, _) in enumerate(hits):
            before = start - hits[i - 1][2] if i else 20
            after = hits[i + 1][1] - end if i + 1 < len(hits) else 20
            if word in self.values:
                v = self.values[word] * scale * turn
                found.append(2 * v if v < 0 else v)
                turn = scale = 1.0
            elif word in self.negations:
                turn = -1.0 if after < 6 else turn
            elif before >= after and after < 6:
                scale = self.weights[word]
            elif before < after and before < 6 and found:
                found[-1] *= self.weights[word]
        return sum(found)

    def __call__(self, text: str) -> float:
        parts = sentences(text)
        if not parts:
            return 0.5
        x = sum(map(self.sentence, parts)) / len(parts)
        return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def sentiment(col: Column | str, values: dict[str, float], negations: list[str], weights: dict[str, float]) -> Column:
    """0 to 1; empty text 0.5."""
    made: list[Sentiment] = []

    def score(text: str) -> float:
        if not made:
            made.append(Sentiment(values, negations, weights))
        return made[0](text)

    return mapped(col, T.DoubleType(), score)
