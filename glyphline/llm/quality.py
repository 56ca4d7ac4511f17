"""Quality rules as a short-circuit cascade, in Catalyst expressions only.

A text's words, lines and 8-word windows are measured once; the rules are
predicates over these measures or over the text. On a bounded sample every rule's
cost and selectivity are estimated: a job evaluates the rule ``REPEATS`` times on each sampled row, less
a job that repeats the rows alone, which lies far above the noise of jobs; what is rejected is
counted by combination of rules, so that each next rule is the one that rejects
the most of the rows still left per second. The rules are chained in that order in one CASE, whose later branches are evaluated
only for the rows that earlier ones let pass. The order changes what the cascade
costs, never what it decides: a row is kept if no rule rejects it.

Null text has no words. A text with fewer than ``MIN_WORDS`` words fails the base
rule, so null and empty texts are never kept. Repeated rows and equal texts get equal verdicts, equal or null ids
stay as they are. Very long texts are measured whole. Columns of the input named like a measure are replaced. Empty
table: no rows, and no sample, so the rules stand in the order of their declaration.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphline.llm.common import WORD, fenced, text_or_empty

MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
#: Marks that end or divide sentences.
STOPS = ".,;:!?。，；：！？、"
#: Rows from which costs and selectivities are estimated (expected; twice as many at most).
SAMPLE_ROWS = 1_000
#: Evaluations of a rule on each sampled row; least seconds that two jobs are told apart by.
REPEATS, RESOLUTION = 4, 1e-3


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(windows: Column, size: int = WINDOW) -> Column:
    """Words covered by window hashes that occur twice or more; ``windows``: array of bigint, one for each position.

    Linear but for a sort: windows are sorted with their positions, neighbours of
    equal hash give the positions, and the union of their spans is summed.
    """
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def hits(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(same(i, i + 1), F.lit(False)) | F.coalesce(same(i, i - 1), F.lit(False)))
        return F.sort_array(F.transform(at, lambda i: F.get(s, i)["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(p, j + 1) - x, F.lit(size)))),
            F.lit(0),
            lambda a, x: a + x,
        )

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(let(pairs, hits), covered))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed (existing columns of these names are replaced)."""
    new = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "_text", "_lines", "_hashes", "_windows"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    has_word = lambda line: line.rlike(WORD)
    df = docs.select(*kept, text_or_empty(text_col).alias("_text"))
    df = df.select(
        "*",
        F.filter(F.split("_text", "\n"), has_word).alias("_lines"),
        F.transform(F.filter(F.split("_text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    window = lambda i: F.xxhash64(*[F.get("_hashes", i + k if k else i) for k in range(WINDOW)])
    df = df.select(
        "*",
        F.when(F.size("_hashes") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_hashes") - WINDOW), window)).alias("_windows"),
    )
    df = df.select(
        *kept,
        "_text",
        "_hashes",
        F.size("_hashes").cast("bigint").alias("n_words"),
        (F.length("_text") - F.regexp_count("_text", F.lit("[\\x20\\x09-\\x0D]"))).cast("bigint").alias("word_chars"),
        F.regexp_count("_text", F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        fenced(F.coalesce(repeated_words(F.col("_windows")), F.lit(0)).cast("bigint")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def rules() -> dict[str, Column]:
    """Name to predicate that rejects a row of ``measure()``; each is defined for every row."""
    n, chars = F.col("n_words"), F.col("word_chars")
    letters = F.length(F.regexp_replace("_text", "[^\\p{L}]+", ""))
    capitals = F.length(F.regexp_replace("_text", "[^\\p{Lu}]+", ""))
    count = lambda mark: F.length("_text") - F.length(F.replace("_text", F.lit(mark)))
    return {
        "symbols": 2 * F.col("n_symbols") > n,
        "menus": 20 * count("|") > n,
        "repeated_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "few_letters": 4 * letters < 3 * chars,
        "monotone": (n < 300) & (10 * F.size(F.array_distinct("_hashes")) < 3 * n),
        "unpunctuated": 20 * F.regexp_count("_text", F.lit(f"[{STOPS}]")) < n,
        "shouting": (2 * count("!") > n) | (10 * capitals > 7 * letters),
    }


@dataclass
class RuleFacts:
    """What the sample tells of a rule: seconds a row, share of rows rejected, and share of those that the rules before it let pass."""

    name: str
    seconds: float
    rejected: float
    gained: float = 0.0


def survey(measured: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[RuleFacts]:
    """The rules in the order of the cascade, estimated on a bounded sample of ``measured``."""
    known = rules()
    sample = measured.limit(sample_rows).where(~F.col("base_failed")).repartition(4).persist()
    try:
        flags = F.array(*[F.coalesce(rule, F.lit(False)) for rule in known.values()])
        seen = [(r["flags"], r["n"]) for r in sample.groupBy(flags.alias("flags")).agg(F.count("*").alias("n")).collect()]  # 2 ** rules rows at most
        rows = sum(n for _, n in seen)
        if not rows:
            return [RuleFacts(name, 0.0, 0.0) for name in known]
        many = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

        def clock(what: Column) -> float:
            took = []
            for _ in range(2):
                began = time.perf_counter()
                many.agg(F.count_if(what), F.count("_text"), F.count("_hashes")).collect()
                took.append(time.perf_counter() - began)
            return min(took)

        clock(F.col("_again") > 0)
        idle = clock(F.col("_again") > 0)
        cost = {name: max(clock(rule) - idle, RESOLUTION) for name, rule in known.items()}
    finally:
        sample.unpersist()
    at = {name: i for i, name in enumerate(known)}
    hit = lambda name, of: sum(n for f, n in of if f[at[name]])
    out: list[RuleFacts] = []
    while len(out) < len(known):
        rest = [k for k in known if k not in {r.name for r in out}]
        best = max(rest, key=lambda k: (hit(k, seen) / cost[k], -cost[k]))
        out.append(RuleFacts(best, cost[best] / (REPEATS * rows), hit(best, seen) / rows))
        out[-1].gained = hit(best, seen) / max(1, sum(n for _, n in seen))
        seen = [(f, n) for f, n in seen if not f[at[best]]]
    return out


def cascade(order: list[str]) -> Column:
    """true if neither the base rule nor any rule rejects; evaluated in ``order``, stopping at the first rejection."""
    known = rules()
    out = F.when(F.col("base_failed"), F.lit(False))
    for name in order:
        out = out.when(known[name], F.lit(False))
    return out.otherwise(F.lit(True))


def sampled(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``sample_rows`` rows, twice as many at most, chosen before anything moves."""
    n = max(1, docs.count())  # of a Parquet table, the sum of its footers
    return docs.sample(min(1.0, sample_rows / n), seed=7).limit(2 * sample_rows)


def judge(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the measures, base_failed and kept."""
    order = [r.name for r in survey(measure(sampled(docs, sample_rows), text_col), sample_rows)]
    return measure(docs, text_col).withColumn("kept", cascade(order)).drop("_text", "_hashes")


def quality_report(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines"
    )


_W = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_W}') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_W}')) AS ls
  FROM documents),
win AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c
  FROM (SELECT r, i, list_slice(ws, i, i + 7) AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM d))),
rep AS (
  SELECT r, sum(least(8, coalesce(nx - i, 8))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM win WHERE c > 1) GROUP BY r),
m AS (
  SELECT doc_id, t, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
    length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS capitals,
    length(regexp_replace(t, '[^!]+', '', 'g')) AS marks, length(regexp_replace(t, '[^|]+', '', 'g')) AS bars,
    length(regexp_replace(t, '[^{STOPS}]+', '', 'g')) AS stops, len(list_distinct(ws)) AS n_distinct
  FROM d LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (2 * n_symbols > n_words OR 20 * bars > n_words OR 2 * n_dup_lines > n_lines OR 4 * letters < 3 * word_chars
    OR (n_words < 300 AND 10 * n_distinct < 3 * n_words) OR 20 * stops < n_words OR 2 * marks > n_words OR 10 * capitals > 7 * letters) AS kept, n_lines
FROM b
"""
