"""All functions by name, for search and for SQL."""

from __future__ import annotations

import inspect
import logging
import logging.handlers
import os
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def modules():
    from glyphline.functions import money, tags, text, times, udfs
    from glyphline.operators import augment, batching, calendar, datasets, lexicon, new_words, phrases, places, similar
    from glyphline.sources import files, services
    from glyphline.streaming import dedup

    return (text, tags, money, times, udfs, lexicon, new_words, datasets, similar, places, calendar, phrases, augment, batching, files, services, dedup)


def functions(spark: SparkSession) -> DataFrame:
    """module, name, signature, doc of every public function."""
    rows = [
        (m.__name__.rpartition(".")[2], n, str(inspect.signature(f)), inspect.getdoc(f) or "")
        for m in modules() for n, f in vars(m).items() if inspect.isfunction(f) and f.__module__ == m.__name__ and not n.startswith("_")
    ]
    return spark.createDataFrame(rows, "module string, name string, signature string, doc string")


def search(spark: SparkSession, words: str) -> DataFrame:
    """Functions by how often their names and descriptions hold the words."""
    text = F.lower(F.concat_ws(" ", "name", "doc"))
    hits = sum((F.expr("0") + (F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w) for w in words.lower().split()), F.lit(0.0))
    return functions(spark).withColumn("hits", hits.cast("int")).where(F.col("hits") > 0).orderBy(F.desc("hits"), "name")


@contextmanager
def timed(name: str = "", log=logging.getLogger("glyphline").info):
    """Seconds that a block takes; calling the value inside gives the seconds so far."""
    began = time.perf_counter()
    yield lambda: time.perf_counter() - began
    log("%s: %.3f s", name, time.perf_counter() - began)


def set_logging(spark: SparkSession, level: str = "INFO", folder: str | None = None) -> None:
    """Level of Spark and of this library; with a folder, also rotating files in it."""
    spark.sparkContext.setLogLevel(level)
    log = logging.getLogger("glyphline")
    log.setLevel(level)
    if folder:
        os.makedirs(folder, exist_ok=True)
        log.addHandler(logging.handlers.RotatingFileHandler(os.path.join(folder, "glyphline.log"), maxBytes=10 << 20, backupCount=5))
