"""Classification, ranking and correlation metrics as aggregations and windows. What is undefined is null; counts always come.

Curves and ranks are built from one row for each distinct value, whose running sums are taken over ranges:
stretches of values are summed apart and their totals added, so no task holds all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import CHG, CHH, CPG, M6A
from ..functions.tags import MINUS, PLUS, softmax_probability
from .ordering import running

EPS = 1e-20


def confusion(rows: DataFrame, *, threshold: float = 0.5, inclusive: bool = False) -> DataFrame:
    """Counts and rates of rows (y 0/1, score) at score > threshold, or from it on if inclusive."""
    hit, true = (F.col("score") >= threshold if inclusive else F.col("score") > threshold), F.col("y") == 1
    c = rows.agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    precision, recall = tp / (tp + fp + EPS), tp / (tp + fn + EPS)
    rates = {"accuracy": (tp + tn) / (tp + tn + fp + fn + EPS), "precision": precision, "recall": recall, "sensitivity": recall, "specificity": tn / (tn + fp + EPS), "f1": 2 * precision * recall / (precision + recall + EPS)}
    return c.select("*", *[F.round(v, 4).alias(k) for k, v in rates.items()])


def curve(rows: DataFrame) -> DataFrame:
    """One row per distinct score: true and false positives from the highest score to it, and all of both."""
    scores = rows.groupBy("score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    totals = rows.agg(F.sum("y").alias("all_p"), F.sum(1 - F.col("y")).alias("all_n"))
    return running(scores, "score", {"tp": "p", "fp": "n"}, descending=True).crossJoin(F.broadcast(totals))  # a single row


def areas(rows: DataFrame) -> DataFrame:
    """roc_auc and trapezoid pr_auc, the best thresholds of each curve, and the counts; null for one class only."""
    c = curve(rows)
    tp, fp, p, n = F.col("tp"), F.col("fp"), F.col("p"), F.col("n")
    roc = F.sum((tp - p / 2) * n) / F.first("all_p") / F.first("all_n")
    before_tp, before_fp = tp - p, fp - n
    precision, earlier = tp / (tp + fp), F.when(before_tp + before_fp > 0, before_tp / (before_tp + before_fp)).otherwise(F.lit(1.0))
    pr = F.sum(p * (precision + earlier) / 2) / F.first("all_p")
    recall, false_rate = F.try_divide(tp, F.col("all_p")), F.try_divide(fp, F.col("all_n"))
    # of equal ones the first met: falling scores on the one curve, rising ones on the other
    youden, both_rates = F.max_by("score", F.struct(recall - false_rate, F.col("score"))), F.max_by("score", F.struct(precision + recall, -F.col("score")))
    both = (F.first("all_p") > 0) & (F.first("all_n") > 0)
    out = c.agg(F.first("all_p").alias("positives"), F.first("all_n").alias("negatives"), F.when(both, F.round(roc, 4)).alias("roc_auc"), F.when(both, F.round(pr, 4)).alias("pr_auc"), youden.alias("roc_threshold"), both_rates.alias("pr_threshold"))
    return out.select("positives", "negatives", "roc_auc", "pr_auc", F.when(F.col("roc_auc").isNotNull(), F.col("roc_threshold")).alias("roc_threshold"), F.when(F.col("roc_auc").isNotNull(), F.col("pr_threshold")).alias("pr_threshold"))


def at_thresholds(rows: DataFrame) -> DataFrame:
    """confusion() at both of areas()' thresholds: one row each, curve 'roc' or 'pr'; none for one class only."""
    best = areas(rows).first()
    made = [confusion(rows, threshold=t, inclusive=True).select(F.lit(c).alias("curve"), F.lit(float(t)).alias("threshold"), "*") for c, t in (("roc", best.roc_threshold), ("pr", best.pr_threshold)) if t is not None]
    return made[0].unionByName(made[1]) if made else confusion(rows.limit(0)).select(F.lit("").alias("curve"), F.lit(0.0).alias("threshold"), "*").limit(0)


def by_context(rows: DataFrame, *, contexts: tuple[str, ...] = (CPG, CHG, CHH, M6A)) -> DataFrame:
    """confusion() and areas() of training rows (methy_type, minus, plus, label) in each context that occurs.

    label is a token: plus or minus count, others are left out. Contexts are a fixed few, so each has its own aggregations.
    """
    y = (F.lit(MINUS) - F.col("label")).alias("y")
    known = rows.where(F.col("label").isin(PLUS, MINUS)).select("methy_type", y, softmax_probability(F.col("minus"), F.col("plus")).alias("score"))
    made = []
    for c in contexts:
        own = known.where(F.col("methy_type") == c)
        made.append(confusion(own).crossJoin(areas(own)).select(F.lit(c).alias("methy_type"), "*"))  # two single rows
    return reduce(DataFrame.unionByName, made).where(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") > 0)


def average_ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Rows with the average rank of a column: ranks of the distinct values, which is all that is ordered."""
    values = rows.groupBy(column).agg(F.count("*").alias("_k"))
    ranked = running(values, column, {"_upto": "_k"}).select(column, (F.col("_upto") - (F.col("_k") - 1) / 2).alias(name))
    return rows.join(ranked, column)


def correlation(rows: DataFrame) -> DataFrame:
    """Of rows (truth, pred): number, Pearson's r and its square, Spearman's r, root mean square error."""
    ranked = average_ranks(average_ranks(rows.select("truth", "pred"), "truth", "_a"), "pred", "_b")
    corr = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))  # noqa: E731  null, not an error, without variation
    r = corr("truth", "pred")
    return ranked.agg(F.count("*").alias("sites"), F.round(r, 4).alias("pearson"), F.round(r * r, 4).alias("rsquare"), F.round(corr("_a", "_b"), 4).alias("spearman"), F.round(F.sqrt(F.avg(F.pow(F.col("truth") - F.col("pred"), 2))), 4).alias("rmse"))


def density(values: DataFrame, *, bandwidth: float = 2.0, low: float = 0.0, high: float = 500.0, points: int = 1000) -> DataFrame:
    """Gaussian density of a column x on a grid, equal values taken together. The factor is bandwidth over the sample deviation."""
    spread = values.agg(F.stddev_samp("x").alias("s1"), F.stddev_pop("x").alias("s0"), F.count("*").alias("total"))
    counted = values.groupBy("x").agg(F.count("*").alias("w")).crossJoin(F.broadcast(spread))  # a single row
    h = F.lit(bandwidth) * F.col("s1") / F.col("s0")
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(low) + i * ((high - low) / (points - 1))))
    each = counted.select("x", "w", "total", h.alias("h"), grid.alias("at"))
    return each.groupBy("at").agg((F.sum(F.col("w") * F.exp(-F.pow(F.col("x") - F.col("at"), 2) / (2 * F.col("h") * F.col("h")))) / F.first("total") / F.first("h") / F.sqrt(F.lit(2 * 3.141592653589793))).alias("density"))
