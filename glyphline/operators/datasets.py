"""Statistics, splits and measures of labelled datasets; each is an aggregation by label, word or tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphline.shared import cut


def class_words(docs: DataFrame, tokens: str, label: str, min_freq: int = 10, min_share: float = 0.8) -> DataFrame:
    """label, word, n, p: words of which more than ``min_share`` of the uses fall to one class."""
    by = docs.select(F.col(label).alias("label"), F.explode(tokens).alias("word")).groupBy("label", "word").agg(F.count("*").alias("n"))
    total = by.groupBy("word").agg(F.sum("n").alias("all")).where(F.col("all") >= min_freq)
    return by.join(total, "word").select("label", "word", "n", (F.col("n") / F.col("all")).alias("p")).where(F.col("p") > min_share)


def class_shares(rows: DataFrame, label: str, multi: bool = False) -> DataFrame:
    """label, n, share; with several labels a row (an array) the share is still that of rows."""
    total = rows.agg(F.count("*").alias("rows"))
    one = rows.select(F.explode(label).alias("label") if multi else F.col(label).alias("label"))
    return one.groupBy("label").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("rows")).alias("share"))


def divergence(whole: DataFrame, part: DataFrame) -> DataFrame:
    """One row: kl (bits, whole to part) and ratio (to the entropy of the whole); inputs: label, share. Labels missing in the part are left out."""
    both = whole.select("label", F.col("share").alias("p")).join(part.select("label", F.col("share").alias("q")), "label")
    sums = both.agg(F.sum(F.col("p") * F.log2(F.col("p") / F.col("q"))).alias("kl"))
    ent = whole.agg((-F.sum(F.col("share") * F.log2("share"))).alias("ent"))
    return sums.crossJoin(ent).select("kl", F.when(F.col("ent") > 0, F.col("kl") / F.col("ent")).alias("ratio"))  # one row each


def split(rows: DataFrame, key: str, ratio: tuple[float, float, float] = (0.8, 0.05, 0.15), seed: int = 0) -> DataFrame:
    """``rows`` with part: train, valid or test by a hash of the key, so that a row's part never depends on the others."""
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) / 1_000_000
    a, b, _ = ratio
    return rows.withColumn("part", F.when(unit < a, "train").when(unit < a + b, "valid").otherwise("test"))


def _report(dealt: DataFrame, labels: str, multi: bool) -> DataFrame:
    """part, label, n, share, kl (bits, whole to part), ratio (to the entropy of the whole)."""
    one = dealt.select("part", F.explode(labels).alias("label") if multi else F.col(labels).alias("label"))
    counts = one.groupBy("part", "label").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("part").agg(F.sum("n").alias("rows"))
    by = counts.join(sizes, "part").select("part", "label", "n", (F.col("n") / F.col("rows")).alias("share"))
    total = counts.agg(F.sum("n").alias("rows"))
    p = counts.groupBy("label").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total)).select("label", (F.col("n") / F.col("rows")).alias("p"))  # one row
    kl = by.join(p, "label").groupBy("part").agg(F.sum(F.col("p") * F.log2(F.col("p") / F.col("share"))).alias("kl"))
    ent = p.agg((-F.sum(F.col("p") * F.log2("p"))).alias("ent"))
    return by.join(kl, "part").crossJoin(F.broadcast(ent)).withColumn("ratio", F.when(F.col("ent") > 0, F.col("kl") / F.col("ent")).otherwise(0.0)).drop("ent")


def analyse(
    rows: DataFrame, key: str, label: str, ratio: tuple[float, float, float] = (0.8, 0.05, 0.15), tries: int = 3, most_ratio: float = 0.05, multi: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Split rows, and for each part and label its number and share, kl and ratio; another seed is tried while a part differs too much.

    ``multi``: ``label`` is an array, and shares are those of all its elements.
    """
    for seed in range(tries):
        dealt = split(rows, key, ratio, seed)
        report = _report(dealt, label, multi)
        worst = report.agg(F.max("ratio").alias("r")).first()["r"]
        if worst is None or worst <= most_ratio:
            break
    return dealt, report


def analyse_entities(rows: DataFrame, key: str, spans: str = "entities", **options) -> tuple[DataFrame, DataFrame]:
    """``analyse`` by the types of entities: shares are those of all entities."""
    typed = rows.withColumn("_types", F.transform(spans, lambda e: e["type"]))
    dealt, report = analyse(typed, key, "_types", multi=True, **options)
    return dealt.drop("_types"), report


def entity_counts(rows: DataFrame, spans: str = "entities") -> DataFrame:
    """type, text, n."""
    return rows.select(F.explode(spans).alias("e")).groupBy(F.col("e.type").alias("type"), F.col("e.text").alias("text")).agg(F.count("*").alias("n"))


def confusion(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """gold, pred, n over all positions of label arrays."""
    pairs = rows.select(F.explode(F.arrays_zip(F.col(gold).alias("g"), F.col(pred).alias("p"))).alias("x"))
    return pairs.groupBy(F.col("x.g").alias("gold"), F.col("x.p").alias("pred")).agg(F.count("*").alias("n"))


def measures(matrix: DataFrame) -> DataFrame:
    """tag, precision, recall, f1, support of each gold or predicted tag."""
    hit = F.when(F.col("gold").eqNullSafe(F.col("pred")), F.col("n")).otherwise(0)
    long = matrix.select(F.explode(F.array(
        F.struct(F.col("gold").alias("tag"), F.col("n").alias("in_gold"), F.lit(0).cast("bigint").alias("in_pred"), hit.alias("hit")),
        F.struct(F.col("pred").alias("tag"), F.lit(0).cast("bigint").alias("in_gold"), F.col("n").alias("in_pred"), F.lit(0).cast("bigint").alias("hit")),
    )).alias("x")).select("x.*")
    by = long.groupBy("tag").agg(*[F.sum(c).alias(c) for c in ("in_gold", "in_pred", "hit")])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    p, r = share("hit", "in_pred"), share("hit", "in_gold")
    return by.where(F.col("tag").isNotNull()).select("tag", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), F.col("in_gold").alias("support"))


def word_measures(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """One row: precision, recall, f1 of words (arrays of strings of the same text); a word counts if both its ends are the same."""

    def spans(words: str) -> Column:
        ends = F.aggregate(words, F.array(F.lit(0)), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + F.length(w))))
        return F.transform(F.col(words), lambda w, i: F.struct(F.get(ends, i).alias("start"), F.get(ends, i + 1).alias("end")))

    hit = F.size(F.array_intersect(spans(gold), spans(pred)))
    sums = rows.agg(F.sum(hit).alias("h"), F.sum(F.size(gold)).alias("g"), F.sum(F.size(pred)).alias("p"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return sums.select(share("h", "p").alias("precision"), share("h", "g").alias("recall"), F.when(F.col("h") > 0, 2 * F.col("h") / (F.col("g") + F.col("p"))).otherwise(0.0).alias("f1"))


def entity_measures(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """type, precision, recall, f1, support: an entity counts if type and both ends are the same."""
    key = lambda c: F.transform(c, lambda x: F.struct(x["type"].alias("type"), x["start"].alias("start"), x["end"].alias("end")))
    g, p = F.array_distinct(key(gold)), F.array_distinct(key(pred))
    one = lambda a, side: F.transform(a, lambda x: F.struct(x["type"].alias("type"), F.lit(side).alias("side")))
    marks = F.concat(one(g, "g"), one(p, "p"), one(F.array_intersect(g, p), "h"))
    by = rows.select(F.explode(marks).alias("m")).groupBy("m.type").agg(*[F.count_if(F.col("m.side") == s).alias(s) for s in "gph"])
    pr, re = F.when(F.col("p") > 0, F.col("h") / F.col("p")).otherwise(0.0), F.when(F.col("g") > 0, F.col("h") / F.col("g")).otherwise(0.0)
    return by.select("type", pr.alias("precision"), re.alias("recall"), F.when(pr + re > 0, 2 * pr * re / (pr + re)).otherwise(0.0).alias("f1"), F.col("g").alias("support"))


def entity_differences(rows: DataFrame, text: str = "text", gold: str = "gold", pred: str = "pred", pad: int = 10) -> DataFrame:
    """Columns of ``rows`` and context, gold_entity, pred_entity: pairs that overlap but differ, and spans without a partner.

    Pairs form inside one text only; the spans that both have are taken out first.
    """
    g, p = F.array_except(gold, pred), F.array_except(pred, gold)
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    null = lambda: F.get(F.slice(F.col(gold), 1, 0), F.lit(0))
    pair = lambda a, b: F.struct(a.alias("gold_entity"), b.alias("pred_entity"))
    left = F.flatten(F.transform(g, lambda a: F.when(F.exists(p, lambda b: meets(a, b)), F.transform(F.filter(p, lambda b: meets(a, b)), lambda b: pair(a, b))).otherwise(F.array(pair(a, null())))))
    right = F.transform(F.filter(p, lambda b: ~F.exists(g, lambda a: meets(a, b))), lambda b: pair(null(), b))
    out = rows.withColumn("_x", F.explode(F.concat(left, right))).select("*", "_x.*").drop("_x")
    start = F.least("gold_entity.start", "pred_entity.start")
    end = F.greatest("gold_entity.end", "pred_entity.end")
    return out.withColumn("context", F.substring(F.col(text), F.greatest(start - pad, F.lit(0)) + 1, end + pad - F.greatest(start - pad, F.lit(0))))


def grade_models(scores: DataFrame, epochs: int = 20, tol: float = 1e-5) -> tuple[DataFrame, dict]:
    """Expectation maximisation of graders' weights.

    ``scores``: grader, graded, question, score; every model grades every model, so
    graders are few. Returns (graded, score) and the weights. A model's
    weight is the mean of two shares: of inverse variances (against the weighted
    means), and of scores above the least.
    """
    names = sorted(r[0] for r in scores.select("grader").distinct().collect())
    weight = dict.fromkeys(names, 1 / max(1, len(names)))
    final = None
    for _ in range(epochs):
        table = scores.sparkSession.createDataFrame(list(weight.items()), "grader string, w double")
        weighted = scores.join(F.broadcast(table), "grader")
        mean = weighted.groupBy("graded", "question").agg((F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("m"))
        mean = mean.withColumn("m", F.bround(F.col("m") * 4) / 4)
        var = {r["grader"]: r["v"] for r in scores.join(mean, ["graded", "question"]).groupBy("grader").agg(F.avg((F.col("score") - F.col("m")) ** 2).alias("v")).collect()}
        final = mean.groupBy("graded").agg(F.sum("m").alias("score"))
        got = {r["graded"]: r["score"] for r in final.collect()}  # a row a model
        inverse = {n: 1 / max(var.get(n, 0.0), 1e-6) for n in names}
        above = {n: got.get(n, 0.0) - min(got.values()) for n in names}
        si, sa = sum(inverse.values()), sum(above.values())
        new = {n: (inverse[n] / si + (above[n] / sa if sa else 1 / len(names))) / 2 for n in names}
        moved = sum((new[n] - weight[n]) ** 2 for n in names)
        weight = new
        if moved < tol:
            break
    return final, weight


def grade_models_by_question(scores: DataFrame, epochs: int = 20, rate: float = 0.01, tol: float = 1e-5, steps: int = 4) -> tuple[DataFrame, DataFrame]:
    """Graders' weights for each graded model and question.

    ``scores``: grader, graded, question, score. A round takes the weighted mean of each answer's grades
    (in ``1 / steps``), lowers each weight by ``rate`` times its squared gap, never below 0, and averages it with the grader's
    own share of scores above the least. Weights of one answer sum to 1; where all fall to 0 they are even again. Stops
    when the weights' squared change falls below ``tol``. Returns (graded, score) and (grader, weight).
    """
    each = ["graded", "question"]
    by = Window.partitionBy(*each)
    state = cut(scores.select("grader", *each, "score", (F.lit(1.0) / F.count("*").over(by)).alias("w")))
    for _ in range(epochs):
        mean = F.bround(F.sum(F.col("w") * F.col("score")).over(by) * steps) / steps
        moved = state.withColumn("mean", mean).withColumn("lowered", F.greatest(F.col("w") - rate * (F.col("score") - F.col("mean")) ** 2, F.lit(0.0)))
        total = F.sum("lowered").over(by)
        moved = moved.withColumn("lowered", F.when(total > 0, F.col("lowered") / total).otherwise(F.lit(1.0) / F.count("*").over(by)))
        got = moved.select(*each, "mean").distinct().groupBy("graded").agg(F.sum("mean").alias("score"))
        above = got.crossJoin(F.broadcast(got.agg(F.min("score").alias("least"), (F.sum("score") - F.count("*") * F.min("score")).alias("all"), F.count("*").alias("models"))))  # one row
        own = above.select(F.col("graded").alias("grader"), F.when(F.col("all") > 0, (F.col("score") - F.col("least")) / F.col("all")).otherwise(F.lit(1.0) / F.col("models")).alias("own"))
        new = cut(moved.join(own, "grader", "left").withColumn("new", (F.col("lowered") + F.coalesce("own", F.lit(0.0))) / 2).select("grader", *each, "score", "w", "new", "mean"))
        gap = new.agg(F.sum((F.col("new") - F.col("w")) ** 2).alias("g")).first()["g"]
        final = new.select(*each, "mean").distinct().groupBy("graded").agg(F.sum("mean").alias("score"))
        state = new.select("grader", *each, "score", F.col("new").alias("w"))
        if gap is None or gap < tol:
            break
    weights = state.groupBy("grader").agg(F.sum("w").alias("w"))
    return final, weights.crossJoin(F.broadcast(weights.agg(F.sum("w").alias("all")))).select("grader", (F.col("w") / F.col("all")).alias("weight"))
