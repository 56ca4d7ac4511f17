"""Documents that are hard to handle, shared by the tests of the training-data operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    None, "", " ", "\n\n", "\t\x0b\x0c\r", "a", "!!! ### $$$", "▁▁ a▁b ▁", "<|endoftext|>", "x <|endoftext|><|endoftext|>y <s> </s> <unk>",
    "naïve café été   line\u0085next", "日本語の文章です。 한국어 русский текст", "👩‍👩‍👧‍👦 flags 🇫🇷 é", "\x00\x01 nul", "1234567 12,345.67 ½ ²",
    "don't  can't   I'll we've   ", "aaaa" * 50, "ab " * 40, "the\r\nend\r\n", "   lead", "trail   ", "ﬁ ﬂ Ⅷ İstanbul ẞ", "a\n\n\nb\n \nc",
    "0" * 300, " " * 100 + "x", "﻿bom ​zero", "𝔘𝔫𝔦𝔠𝔬𝔡𝔢 𐍈", "ሀሁሂ ᠠᠡ ꙮ", "<0x41> <0x0A>",
]
WORDS = "alpha beta gamma delta river stone music light window garden paper winter summer über straße señor año garçon où forêt naïf".split()


def prose(rng: random.Random, n: int) -> str:
    out = []
    for k in range(n):
        out.append(rng.choice(WORDS))
        if k % 9 == 8:
            out.append(rng.choice([".\n", ",", "!", "; #"]))
    return " ".join(out)


def odd_rows(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    texts = list(ODD) + [prose(rng, rng.choice([3, 5, 20, 60, 200])) for _ in range(40)]
    texts.append(prose(rng, 12_000))
    base = prose(rng, 150)
    texts += [base, base, base + " end", base.replace("river", "rover", 1), base.upper()]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i * 3 - 20, t, rng.choice(["en", "fr", None]), rng.choice(["web", "books", "", None]), None if t is None else len(t)))
    rows += [rows[-1], rows[-1], rows[0]]  # repeated rows
    rows += [(None, "no id here", "en", "web", 10), (None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


def odd_documents(spark: SparkSession) -> DataFrame:
    """With further columns, named as the operators name theirs inside."""
    docs = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    clash = ["fp", "h", "n_words", "copies", "slot", "shard", "text_crc32", "score", "lang_pred", "_text", "_w", "key", "bundle", "tie", "range", "seat", "kept", "n_tokens", "ids", "size", "root", "first", "salt"]
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in clash])


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def rowset(df: DataFrame, *cols: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
