"""Confusion counts, binary metrics, macro F1 and exact ROC AUC, for any number of runs at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabspark.operators.keys import same_key_join
from tabspark.staging import in_ranges


def confusion(df: DataFrame, truth: str, pred: str, labels: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """(by..., truth, pred, n) with every cell of the label grid, zeros included: one conditional aggregation."""
    t, p = F.col(truth), F.col(pred)
    cells = [(a, b) for a in labels for b in labels]
    counts = [F.count(F.when((t == F.lit(a)) & (p == F.lit(b)), 1)).alias(f"__{i}") for i, (a, b) in enumerate(cells)]
    wide = df.groupBy(*by).agg(*counts)
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("truth"), F.lit(b).alias("pred"), F.col(f"__{i}").alias("n"))
            for i, (a, b) in enumerate(cells)
        ]
    )
    return wide.select(*by, F.inline(rows))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when undefined."""
    return F.when(b == 0, 0.0).otherwise(F.try_divide(a, b))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2.0 * tp, 2.0 * tp + fp + fn)


def count_columns(truth: Column, pred: Column, positive=1, negative=0) -> list[Column]:
    """Counts behind the binary metrics; a prediction that is neither label is a wrong one."""
    pos, neg = F.lit(positive), F.lit(negative)
    said_pos, said_neg = F.coalesce(pred == pos, F.lit(False)), F.coalesce(pred == neg, F.lit(False))
    return [
        F.count("*").alias("n"),
        F.count_if((truth == pos) & said_pos).alias("tp"),
        F.count_if((truth != pos) & said_pos).alias("fp"),
        F.count_if((truth == neg) & said_neg).alias("tn"),
        F.count_if((truth == pos) & ~said_pos).alias("fn"),
        F.count_if((truth != neg) & said_neg).alias("neg_fp"),
        F.count_if((truth == neg) & ~said_neg).alias("neg_fn"),
    ]


def metric_columns(fixed_labels: bool, prefix: str = "") -> dict[str, Column]:
    """Metric expressions over the aliases of `count_columns`."""
    c = F.col
    f1_pos, f1_neg = f1(c("tp"), c("fp"), c("fn")), f1(c("tn"), c("neg_fp"), c("neg_fn"))
    if fixed_labels:
        f1_macro = (f1_pos + f1_neg) / 2
    else:
        # Only labels that occur in truth or prediction are averaged; an absent one contributes 0 to the sum.
        present = (c("tp") + c("fp") + c("fn") > 0).cast("int") + (c("tn") + c("neg_fp") + c("neg_fn") > 0).cast("int")
        f1_macro = ratio(f1_pos + f1_neg, present)
    return {
        f"{prefix}f1_macro": f1_macro,
        f"{prefix}accuracy": ratio(c("tp") + c("tn"), c("n")),
        f"{prefix}precision": ratio(c("tp"), c("tp") + c("fp")),
        f"{prefix}recall": ratio(c("tp"), c("tp") + c("fn")),
    }


def binary_metrics(
    df: DataFrame,
    truth: str,
    pred: str,
    prob: str | None = None,
    by: Sequence[str] = (),
    positive=1,
    negative=0,
    fixed_labels: bool = False,
    prefix: str = "test_",
) -> DataFrame:
    """One row of metrics per group; AUC is missing without scores or with one class only."""
    out = df.groupBy(*by).agg(*count_columns(F.col(truth), F.col(pred), positive, negative))
    out = out.select(*by, "n", *[e.alias(name) for name, e in metric_columns(fixed_labels, prefix).items()])
    if prob is None:
        return out.withColumn(f"{prefix}auc", F.lit(None).cast("double"))
    scored = df.withColumn("__truth", (F.col(truth) == F.lit(positive)).cast("int"))
    found = roc_auc(scored, "__truth", prob, by)
    # An area over a part of the rows would look like one over all of them.
    missing = F.raise_error(F.concat(F.col("unscored").cast("string"), F.lit(" rows have no score"))).cast("double")
    auc = found.select(*by, F.when(F.col("unscored") > 0, missing).otherwise(F.col("auc")).alias(f"{prefix}auc"))
    if by:
        return same_key_join(out, auc, by, "left")
    # Both sides are a single aggregate row.
    return out.withColumn("__one", F.lit(1)).join(auc.withColumn("__one", F.lit(1)), "__one", "left").drop("__one")


def macro_f1(conf: DataFrame, labels: Sequence | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Macro F1 from confusion counts (truth, pred, n): over the given labels, or over the labels that occur."""
    t, p, n = F.col("truth"), F.col("pred"), F.col("n")
    hit = F.when(t == p, n).otherwise(0)
    miss = n - hit
    per_label = (
        conf.where(n > 0)
        .select(
            *by,
            F.inline(
                F.array(
                    F.struct(t.alias("label"), hit.alias("tp"), miss.alias("fn"), F.lit(0).cast("bigint").alias("fp")),
                    F.struct(p.alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fn"), miss.alias("fp")),
                )
            ),
        )
        .groupBy(*by, "label")
        .agg(f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("f1"))
    )
    if labels is None:
        return per_label.groupBy(*by).agg(F.avg("f1").alias("f1_macro"))
    wanted = F.when(F.col("label").isin(*labels), F.col("f1")).otherwise(0.0)
    return per_label.groupBy(*by).agg((F.sum(wanted) / len(labels)).alias("f1_macro"))


def roc_auc(df: DataFrame, truth: str, score: str, by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Exact area under the ROC curve, ties counting one half, and the number of rows without a score (`unscored`).

    The area is missing when only one class has scores. Rows are counted per distinct score once; these counts are written
    and cut into ranges of scores. The sum of negatives below a score is the total of the lower ranges plus a running sum
    inside its own range, so no task ever sees more than one range.
    """
    by = list(by)
    given = df.select(*by, F.col(truth).alias("__t"), F.col(score).cast("double").alias("__s"))
    counted = given.groupBy(*by, "__s").agg(
        F.count("*").alias("__all"), F.count_if(F.col("__t") == 1).alias("__p"), F.count_if(F.col("__t") == 0).alias("__n")
    )
    ranged = in_ranges(counted, *by, "__s", rows=rows)
    unscored = ranged.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("__s").isNull(), F.col("__all"))), F.lit(0)).alias("unscored"))
    scored = ranged.where(F.col("__s").isNotNull())
    upto_range = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    lower = scored.groupBy(*by, "__r").agg(F.sum("__n").alias("__rn"))
    lower = lower.withColumn("__lower", F.coalesce(F.sum("__rn").over(upto_range), F.lit(0))).drop("__rn")
    upto_score = Window.partitionBy(*by, "__r").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("__n").over(upto_score), F.lit(0))
    wins = (
        same_key_join(scored.withColumn("__below", below), lower, [*by, "__r"])
        .withColumn("__wins", F.col("__p") * (F.col("__lower") + F.col("__below") + F.col("__n") / 2.0))
    )
    pairs = F.sum("__p").cast("double") * F.sum("__n")
    area = wins.groupBy(*by).agg(F.when(pairs > 0, F.try_divide(F.sum("__wins"), pairs)).alias("auc"))
    if by:
        return same_key_join(unscored, area, by, "left").select(*by, "auc", "unscored")
    return unscored.withColumn("__one", F.lit(1)).join(area.withColumn("__one", F.lit(1)), "__one", "left").select("auc", "unscored")


def constant_baselines(df: DataFrame, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """Metrics of always answering 0 and always answering 1."""
    t = F.col(truth)
    both = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(t == 1).alias("__p"), F.count_if(t == 0).alias("__q"))
    p, q = F.col("__p"), F.col("__q")
    zero = F.lit(0.0)
    always_0 = F.struct(
        F.lit(0).alias("prediction"), ratio(q, F.col("n")).alias("accuracy"), zero.alias("recall"),
        (f1(q, p, F.lit(0)) / 2).alias("f1_macro"),
    )
    always_1 = F.struct(
        F.lit(1).alias("prediction"), ratio(p, F.col("n")).alias("accuracy"), ratio(p, p).alias("recall"),
        (f1(p, q, F.lit(0)) / 2).alias("f1_macro"),
    )
    return both.select(*by, "n", F.inline(F.array(always_0, always_1)))
