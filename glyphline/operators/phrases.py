"""Key phrases and summaries of single texts.

Tokens come with the text (array of sentences, each an array of struct<word,pos>);
``default_tokens`` makes them from letters and single Han characters where no
segmenter is at hand. All work stays inside a row, in Arrow batches: a document is
never taken apart by a shuffle. Dictionaries (idf, stopwords, topic prominence,
weights of parts of speech) are parameters of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphline.functions.udfs import sentences

TOKEN = T.StructType([T.StructField("word", T.StringType()), T.StructField("pos", T.StringType())])
TOKENS = T.ArrayType(T.ArrayType(TOKEN))
_WORD = re.compile(r"[一-龥]|[^\W一-龥]+|[^\w\s]")


@dataclass
class Words:
    """idf of words (unknown ones: the upper median), stopwords, topic prominence, weights of parts of speech."""

    idf: dict[str, float] = field(default_factory=dict)
    stopwords: frozenset[str] = frozenset()
    topic: dict[str, float] = field(default_factory=dict)
    pos: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        known = sorted(self.idf.values())
        self.unknown = known[len(known) // 2] if known else 1.0
        self.untopical = sum(self.topic.values()) / len(self.topic) / 2 if self.topic else 0.0


def prominence(topics: dict[str, dict[str, float]], n: int) -> dict[str, float]:
    """Per word the sum of p log2(p n) over its topics, scaled to 0..1."""
    import math

    raw = {w: sum(p * math.log2(p * n) for p in ps.values() if p > 0) for w, ps in topics.items()}
    low, high = min(raw.values(), default=0.0), max(raw.values(), default=0.0)
    return {w: (x - low) / (high - low) if high > low else 0.0 for w, x in raw.items()}


def tokens_of(text: str) -> list[list[dict]]:
    kind = lambda w: "n" if re.match(r"\w", w) else "w"
    return [[{"word": w, "pos": kind(w)} for w in _WORD.findall(s)] for s in sentences(text, fine=True)]


def default_tokens(col: Column | str) -> Column:
    @F.pandas_udf(TOKENS)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else tokens_of(t) for t in s], dtype=object)

    return run(F.col(col) if isinstance(col, str) else col)


def _pairs(sent) -> list[tuple[str, str]]:
    return [(t["word"], t["pos"]) for t in sent]


def loose(words: list[tuple[str, str]], dic: Words, longest: int, shortest: int, func_words: int, stops: int) -> bool:
    """An n-gram that may be a phrase: length, few function words and stopwords, none at its edges."""
    n = sum(len(w) for w, _ in words)
    function = "ujpcyed"
    inner = sum(p[:1] in function for _, p in words)
    return (
        shortest <= n <= longest and inner <= func_words and sum(w in dic.stopwords for w, _ in words) <= stops
        and all(p[:1] not in (*function, "w", "m") and w not in dic.stopwords for w, p in (words[0], words[-1])) and all(p[:1] != "w" for _, p in words) and words[-1][0] != "时"
    )


def _loose_grams(s: list[tuple[str, str]], dic: Words, max_tokens: int, longest: int, shortest: int, func_words: int, stops: int) -> Iterator[tuple[int, int]]:
    """Ends of the n-grams that are ``loose``; one that holds too much already isn't made longer."""
    tags = [p[:1] for _, p in s]
    inner = [p in "ujpcyed" for p in tags]
    stopped = [w in dic.stopwords for w, _ in s]
    edge = [p not in tuple("ujpcyedwm") and not stop for p, stop in zip(tags, stopped, strict=True)]
    for i in range(len(s)):
        if not edge[i]:
            continue
        n = f = k = 0
        for j in range(i, min(len(s), i + max_tokens)):
            n, f, k = n + len(s[j][0]), f + inner[j], k + stopped[j]
            if n > longest or f > func_words or k > stops or tags[j] == "w":
                break
            if n >= shortest and edge[j] and s[j][0] != "时":
                yield i, j + 1


def strict(words: list[tuple[str, str]], dic: Words, longest: int, shortest: int, *_: int) -> bool:
    """Nouns, adjectives and verbs only, a noun last."""
    return shortest <= sum(len(w) for w, _ in words) <= longest and all(p[:1] in "nav" for _, p in words) and words[-1][1][:1] == "n"


def phrases(sents, dic: Words, top: int = 5, theta: float = 0.5, max_tokens: int = 12, longest: int = 25, shortest: int = 1, func_words: int = 1, stops: int = 0, rule=loose, like: float = 0.6) -> list[tuple[str, float]]:
    """Phrases and weights: tf idf of the words, their topics; of alike ones the longer stays."""
    sents = [_pairs(s) for s in sents]
    tf: dict[str, int] = {}
    for s in sents:
        for w, p in s:
            if p[:1] != "w" and w not in dic.stopwords:
                tf[w] = tf.get(w, 0) + 1
    total = sum(tf.values()) or 1
    weight = {w: n / total * dic.idf.get(w, dic.unknown) for w, n in tf.items()}
    size = {1: 1.0, 2: 5.6, 3: 1.1, 4: 2.0, 5: 0.7, 6: 0.9, 7: 0.48, 8: 0.43}
    found: dict[str, tuple[float, list[str]]] = {}
    for s in sents:
        weights = [weight.get(w, 0.0) for w, _ in s]
        topics = [dic.topic.get(w, dic.untopical) for w, _ in s] if dic.topic else []
        grams = _loose_grams(s, dic, max_tokens, longest, shortest, func_words, stops) if rule is loose else ((i, j) for i in range(len(s)) for j in range(i + 1, min(len(s), i + max_tokens) + 1))
        for i, j in grams:
            gram = s[i:j]
            text = "".join(w for w, _ in gram)
            if text in found or (rule is not loose and not rule(gram, dic, longest, shortest, func_words, stops)):
                continue
            score = sum(weights[i:j]) * size.get(len(gram), 0.3) * (dic.pos.get("|".join(p for _, p in gram), 1.0) if dic.pos else 1.0)
            score += theta * sum(topics[i:j]) / len(gram) if dic.topic else 0.0
            found[text] = (score, [w for w, _ in gram])
    kept: list[tuple[str, float]] = []
    having: dict[str, list[int]] = {}  # a word's places among those kept
    for text, (score, ws) in sorted(found.items(), key=lambda x: -len(x[1][1])):
        own = set(ws)
        shared: dict[int, int] = {}
        for w in own:
            for k in having.get(w, ()):
                shared[k] = shared.get(k, 0) + 1
        if max(shared.values(), default=0) / len(own) < like:
            for w in own:
                having.setdefault(w, []).append(len(kept))
            kept.append((text, score))
    ranked = sorted(kept, key=lambda x: (-x[1], x[0]))
    return [x for x in (ranked if top < 0 else ranked[:top]) if x[1] > 0]


def summary(sents, dic: Words, length: int = 200, lead: float = 1.2, theta: float = 0.2) -> str:
    """Sentences of highest mean tf idf and topic, as many as fit, in their order; the first three count more, short and long ones less."""
    sents = [_pairs(s) for s in sents]
    tf: dict[str, int] = {}
    for s in sents:
        for w, p in s:
            if p[:1] != "w" and w not in dic.stopwords:
                tf[w] = tf.get(w, 0) + 1
    total = sum(tf.values()) or 1
    scored = []
    for i, s in enumerate(sents):
        text = "".join(w for w, _ in s)
        own = [w for w, p in s if w in tf and p[:1] != "w"]
        if not text or not own:
            continue
        score = sum(tf[w] / total * dic.idf.get(w, dic.unknown) + theta * dic.topic.get(w, dic.untopical) for w in own) / len(own)
        score *= (0.7 if len(text) < 15 or len(text) > 70 else 1.0) * (lead if i < 3 else 1.0)
        scored.append((score, i, text))
    used, chosen = 0, []
    for _, i, text in sorted(scored, key=lambda x: (-x[0], x[1])):
        if used + len(text) > length and chosen:
            break
        chosen.append((i, text))
        used += len(text)
    return "".join(t for _, t in sorted(chosen))


PHRASES = T.ArrayType(T.StructType([T.StructField("phrase", T.StringType()), T.StructField("weight", T.DoubleType())]))


def extract_keyphrases(tokens: Column | str, dic: Words, **options) -> Column:
    """array<struct<phrase,weight>> by falling weight."""

    @F.pandas_udf(PHRASES)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"phrase": p, "weight": w} for p, w in phrases(t, dic, **options)] for t in s], dtype=object)

    return run(F.col(tokens) if isinstance(tokens, str) else tokens)


def extract_summary(tokens: Column | str, dic: Words, **options) -> Column:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else summary(t, dic, **options) for t in s], dtype=object)

    return run(F.col(tokens) if isinstance(tokens, str) else tokens)
