"""Translators and language models as callables that workers bring up; nothing is sent unless the caller passes one.

A service is ``make() -> f(text, source, target) -> text``: ``make`` runs once in a
task, so sessions and keys live there.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Translate = Callable[[str, str, str], str]


def careful(call: Translate, languages: Sequence[str], gap: float = 0.0, keys: Sequence | None = None) -> Translate:
    """``call`` with checked languages, a pause before each request, and the next key after a failure."""
    turn = [0]

    def run(text: str, source: str, target: str) -> str:
        if source not in languages or target not in languages:
            raise ValueError(f"unknown language: {source} or {target}")
        error: Exception | None = None
        for _ in range(max(1, len(keys or ()))):
            time.sleep(gap)
            try:
                return call(text, source, target, keys[turn[0] % len(keys)]) if keys else call(text, source, target)
            except Exception as e:  # noqa: BLE001
                error, turn[0] = e, turn[0] + 1
        raise RuntimeError("every key failed") from error

    return run


def back_translations(df: DataFrame, id_col: str, text_col: str, services: dict[str, tuple[Callable[[], Translate], Sequence[str]]], source: str = "zh", at_once: int | None = None) -> DataFrame:
    """id, text, service, language, translated: each text through each language of each service and back.

    Requests are spread over ``at_once`` tasks; a failed one gives null.
    """
    ways = [(n, x) for n, (_, langs) in sorted(services.items()) for x in langs if x != source]
    asked = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    asked = asked.withColumn("way", F.explode(F.array(*[F.struct(F.lit(n).alias("service"), F.lit(x).alias("language")) for n, x in ways]))).select("id", "text", "way.*")
    if at_once:
        asked = asked.repartition(at_once)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        live: dict[str, Translate] = {}

        def one(r) -> str | None:
            if r.text is None:
                return None
            call = live.get(r.service) or live.setdefault(r.service, services[r.service][0]())
            try:
                return call(call(r.text, source, r.language), r.language, source)
            except Exception:  # noqa: BLE001
                return None

        for f in frames:
            yield f.assign(translated=[one(r) for r in f.itertuples()])

    return asked.mapInPandas(run, "id string, text string, service string, language string, translated string")


def keep_translations(rows: DataFrame, longest: float = 3.0) -> DataFrame:
    """Different from the text, once each, no more than ``longest`` times longer or shorter."""
    ratio = F.length("translated") / F.length("text")
    return rows.where(F.col("translated").isNotNull() & (F.col("translated") != F.col("text")) & ratio.between(1 / longest, longest)).dropDuplicates(["id", "translated"])


def ask_models(questions: DataFrame, models: dict[str, Callable[[], Callable[[str], str]]]) -> DataFrame:
    """question_id, question, model, answer; models are few, so each question is repeated once for each."""
    asked = questions.select("question_id", "question", F.explode(F.array(*[F.lit(m) for m in sorted(models)])).alias("model"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        live: dict[str, Callable[[str], str]] = {}
        for f in frames:
            f["answer"] = [(live.get(r.model) or live.setdefault(r.model, models[r.model]()))(r.question) for r in f.itertuples()]
            yield f

    return asked.mapInPandas(run, "question_id long, question string, model string, answer string")


def grade_answers(answers: DataFrame, models: dict[str, Callable[[], Callable[[str], str]]]) -> DataFrame:
    """question_id, graded, grader, grade (text): each answer put before each model."""
    asked = answers.select("question_id", F.col("model").alias("graded"), "answer", F.explode(F.array(*[F.lit(m) for m in sorted(models)])).alias("grader"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        live: dict[str, Callable[[str], str]] = {}
        for f in frames:
            f["grade"] = [(live.get(r.grader) or live.setdefault(r.grader, models[r.grader]()))(r.answer) for r in f.itertuples()]
            yield f[["question_id", "graded", "grader", "grade"]]

    return asked.mapInPandas(run, "question_id long, graded string, grader string, grade string")


def grade_value(col, most: float = 100.0):
    """Number in a grader's words: digits, or a Chinese numeral with 点; null outside 0..most."""
    c = F.col(col) if isinstance(col, str) else col
    digits = F.regexp_extract(c, r"([0-9]+(?:\.[0-9]+)?)", 1)
    numeral = F.regexp_extract(c, "([零一二两三四五六七八九十百]+)(?:点[五5]|分|$)", 1)
    place = lambda s, u: F.regexp_extract(s, f"([一二两三四五六七八九]?){u}", 1)
    value = lambda s: F.translate(s, "零一二两三四五六七八九", "01223456789").cast("int")
    hundreds = F.when(numeral.contains("百"), F.coalesce(value(F.nullif(place(numeral, "百"), F.lit(""))), F.lit(1)) * 100).otherwise(0)
    tens = F.when(numeral.contains("十"), F.coalesce(value(F.nullif(place(numeral, "十"), F.lit(""))), F.lit(1)) * 10).otherwise(0)
    ones = F.coalesce(value(F.nullif(F.regexp_extract(numeral, "([一二两三四五六七八九])$", 1), F.lit(""))), F.lit(0))
    half = F.when(c.rlike("点[五5]"), 0.5).otherwise(0.0)
    got = F.when(digits != "", digits.cast("double") + F.when(~digits.contains("."), half).otherwise(0.0)).when(numeral != "", hundreds + tens + ones + half)
    return F.when(got.between(0, most), got)
