"""Evaluation metrics (H1-H11) as aggregations over ``(label, prediction[, score])`` rows.

AUC is exact (ties count one half, as in the Mann-Whitney statistic):
``sum_s p(s) * (negatives below s + n(s)/2) / (P * N)``.  The running count of
negatives needs an order over the distinct scores.  Rather than one global
window (all scores in one task), scores are cut into ``B`` range buckets from a
``percentile_approx`` sketch; each bucket runs its own window and adds the
negatives of all lower buckets, taken from a ``B``-row table of bucket totals.
Small inputs (at most ``max_scores_per_task`` distinct scores) use one window per group.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.functions.exprs import qcol

MAX_SCORES_PER_TASK = 2_000_000


def accuracy(df: DataFrame, label: str, prediction: str, group: list[str] = ()) -> DataFrame:
    """H1: share of rows with label = prediction."""
    eq = (qcol(label) == qcol(prediction)).cast("double")
    return df.groupBy(*[qcol(g) for g in group]).agg(F.avg(F.coalesce(eq, F.lit(0.0))).alias("accuracy"))


def auc(df: DataFrame, y: Column, score: Column, group: list[str] = (),
        max_scores_per_task: int = MAX_SCORES_PER_TASK, weight: Column | None = None) -> DataFrame:
    """H2: exact ROC AUC per group; ``y`` is 1 for the positive class, 0 otherwise; ``weight`` is an
    optional row multiplicity (for pre-aggregated input).

    Returns ``group..., auc, pos, neg``; ``auc`` is null when a group lacks a class.
    """
    gcols = [qcol(g) for g in group]
    w = weight.cast("bigint") if weight is not None else F.lit(1).cast("bigint")
    base = df.select(*gcols, y.cast("bigint").alias("__y"), score.cast("double").alias("__s"), w.alias("__w"))
    st = base.agg(F.approx_count_distinct("__s").alias("d")).first()
    buckets = max(1, int(math.ceil((st["d"] or 0) / max_scores_per_task)))
    g = base.groupBy(*group, "__s").agg(F.sum(F.col("__y") * F.col("__w")).alias("p"),
                                        F.sum((1 - F.col("__y")) * F.col("__w")).alias("n"))
    if buckets == 1:
        w = Window.partitionBy(*group).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
        g = g.withColumn("nb", F.coalesce(F.sum("n").over(w), F.lit(0)))
    else:
        from tabforge.session import cut_lineage
        g = cut_lineage(g)  # the grouped scores feed the cut sketch and the sums: shuffle them once
        probs = [i / buckets for i in range(1, buckets)]
        cuts = g.agg(F.percentile_approx("__s", probs, max(10_000, 10 * buckets)).alias("q")).first()["q"]  # over distinct scores
        cuts = sorted({float(c) for c in cuts or [] if math.isfinite(c)})
        # a binary search in the JVM, whatever the number of cuts
        find = Bucketizer(splits=[-math.inf, *(cuts or [0.0]), math.inf], inputCol="__s", outputCol="__b", handleInvalid="keep")
        g = find.transform(g)
        tot = g.groupBy(*group, "__b").agg(F.sum("n").alias("bn"))
        wb = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        off = tot.withColumn("off", F.coalesce(F.sum("bn").over(wb), F.lit(0))).drop("bn")  # groups x B rows
        g = g.join(off, [*group, "__b"], "left")  # groups x B rows; AQE broadcasts it when small
        w = Window.partitionBy(*group, "__b").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
        g = g.withColumn("nb", F.col("off") + F.coalesce(F.sum("n").over(w), F.lit(0)))
    r = g.groupBy(*group).agg(
        F.sum(F.col("p").cast("double") * (F.col("nb") + F.col("n") / 2.0)).alias("__num"),
        F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    val = F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("__num") / (F.col("pos").cast("double") * F.col("neg").cast("double")))
    return r.select(*[qcol(x) for x in group], val.alias("auc"), F.col("pos").cast("bigint").alias("pos"),
                    F.col("neg").cast("bigint").alias("neg"))


def auc_binary(df: DataFrame, label: str, score: str, positive=None, group: list[str] = ()) -> DataFrame:
    """H2 with a label column: positive = ``positive`` or the larger label of each group."""
    if positive is None:
        if group:
            # aggregate first, then attach each group's larger label to the (group, score, label) counts
            gc = [qcol(g) for g in group]
            agg = df.groupBy(*gc, qcol(score).alias("__sc"), qcol(label).alias("__lab")).agg(
                F.count(F.lit(1)).alias("__cnt"))
            mx = agg.groupBy(*gc).agg(F.max("__lab").alias("__pos"))  # one row per group
            agg = agg.join(mx, list(group))
            return auc(agg, (F.col("__lab") == F.col("__pos")).cast("int"), F.col("__sc"), group,
                       weight=F.col("__cnt"))
        else:
            y = (qcol(label) == F.lit(df.agg(F.max(qcol(label))).first()[0])).cast("int")
    else:
        y = (qcol(label) == F.lit(positive)).cast("int")
    return auc(df, y, qcol(score), group)


def auc_ovr(df: DataFrame, label: str, prob_cols: dict, group: list[str] = ()) -> DataFrame:
    """H3: one-vs-rest AUC per class, macro average.  ``prob_cols`` maps class -> probability column."""
    items = list(prob_cols.items())
    arr = F.array(*[F.struct(F.lit(str(k)).alias("cls"), (qcol(label).cast("string") == F.lit(str(k))).cast("int").alias("y"),
                             qcol(v).alias("s")) for k, v in items])
    long = df.select(*[qcol(g) for g in group], F.explode(arr).alias("e")).select(*[qcol(g) for g in group], "e.*")
    per = auc(long, F.col("y"), F.col("s"), [*group, "cls"])
    return per.groupBy(*[qcol(g) for g in group]).agg(
        F.avg("auc").alias("auc"), F.count(F.lit(1)).alias("n_classes"),
        F.sum(F.when(F.col("auc").isNull(), 1).otherwise(0)).alias("undefined_classes"))


def confusion(df: DataFrame, label: str, prediction: str, group: list[str] = ()) -> DataFrame:
    """Per class: tp, fp, fn, support (classes = labels and predictions seen)."""
    g = df.groupBy(*[qcol(x) for x in group], qcol(label).alias("l"), qcol(prediction).alias("p")).agg(
        F.count(F.lit(1)).alias("cnt"))
    same = F.col("l") == F.col("p")
    e = F.explode(F.array(
        F.struct(F.col("l").alias("cls"), F.when(same, F.col("cnt")).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("fp"),
                 F.when(same, 0).otherwise(F.col("cnt")).alias("fn"), F.col("cnt").alias("support")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("bigint").alias("tp"), F.when(same, 0).otherwise(F.col("cnt")).alias("fp"),
                 F.lit(0).cast("bigint").alias("fn"), F.lit(0).cast("bigint").alias("support")),
    ))
    return (g.select(*[qcol(x) for x in group], e.alias("e")).select(*[qcol(x) for x in group], "e.*")
            .groupBy(*[qcol(x) for x in group], "cls").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support")]))


def _prf(tp, fp, fn):
    p = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    return p, r, f


def confusion_summary(df: DataFrame, label: str, prediction: str, positive_label=1.0,
                      group: list[str] = ()) -> DataFrame:
    """One pass over the rows (a k x k confusion table per group) gives accuracy, the number of
    label classes and precision / recall / F1 (H1, H5-H7).

    Two classes among the labels -> binary with ``positive_label``; otherwise support-weighted
    over classes.  Binary with a third class among the predictions, or without the positive
    label, gives 0, 0, 0 (the reference falls back on the error)."""
    conf = confusion(df, label, prediction, group)
    gc = [qcol(x) for x in group]
    pos = F.lit(positive_label).cast(df.schema[label].dataType)
    tp, fp, fn = F.col("tp").cast("double"), F.col("fp").cast("double"), F.col("fn").cast("double")
    p, r, f = _prf(tp, fp, fn)
    per = conf.select(*gc, "cls", "tp", "support", p.alias("p"), r.alias("r"), f.alias("f"),
                      (F.col("cls") == pos).alias("is_pos"))
    agg = per.groupBy(*gc).agg(
        F.sum(F.when(F.col("support") > 0, 1).otherwise(0)).alias("n_label_classes"),
        F.count(F.lit(1)).alias("n_classes"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.max(F.col("is_pos")).alias("has_pos"),
        F.max(F.when(F.col("is_pos"), F.col("p"))).alias("bp"), F.max(F.when(F.col("is_pos"), F.col("r"))).alias("br"),
        F.max(F.when(F.col("is_pos"), F.col("f"))).alias("bf"),
        (F.sum(F.col("support") * F.col("p")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("support") * F.col("r")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("support") * F.col("f")) / F.sum("support")).alias("wf"))
    binary = F.col("n_label_classes") == 2
    bad = binary & ((F.col("n_classes") > 2) | ~F.coalesce(F.col("has_pos"), F.lit(False)))
    pick = lambda b, w: F.when(bad, 0.0).when(binary, F.coalesce(F.col(b), F.lit(0.0))).otherwise(F.col(w))
    return agg.select(*gc, "accuracy", "n_label_classes", pick("bp", "wp").alias("precision"),
                      pick("br", "wr").alias("recall"), pick("bf", "wf").alias("f1"))


def precision_recall_f1(df: DataFrame, label: str, prediction: str, positive_label=1.0,
                        group: list[str] = ()) -> DataFrame:
    """H5-H7 (see ``confusion_summary``)."""
    return confusion_summary(df, label, prediction, positive_label, group).select(
        *[qcol(x) for x in group], "precision", "recall", "f1")


def regression_metrics(df: DataFrame, label: str, prediction: str, group: list[str] = ()) -> DataFrame:
    """Rmse, mae, r2 (constant label: 1.0 if exact else 0.0), mape (% over label != 0; 0 if none)."""
    y, p = qcol(label).cast("double"), qcol(prediction).cast("double")
    e = y - p
    a = df.groupBy(*[qcol(g) for g in group]).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("ss_res"),
        (F.var_pop(y) * F.count(y)).alias("ss_tot"),
        F.avg(F.abs(F.try_divide(e, F.when(y != 0, y)))).alias("ape"))
    r2 = (F.when(F.col("ss_tot") > 0, 1 - F.col("ss_res") / F.col("ss_tot"))
          .when(F.col("ss_res") == 0, 1.0).otherwise(0.0))
    return a.select(*[qcol(g) for g in group], F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"),
                    F.coalesce(F.col("ape") * 100.0, F.lit(0.0)).alias("mape"))


def classification_metrics(df: DataFrame, label: str, prediction: str, score: str | None = None,
                           prob_cols: dict | None = None, model_classes: list | None = None,
                           positive_label=1.0, group: list[str] = ()) -> DataFrame:
    """accuracy, auc (falls back to accuracy when undefined, H4), precision, recall, f1.

    Binary AUC uses ``score`` = P(larger model class); multiclass uses ``prob_cols``.  AUC is
    undefined - and replaced by accuracy - when the held-out labels do not have exactly the
    model's classes (or 2 for a binary score), or a class has no positives or no negatives."""
    one = not group
    if one:
        df = df.withColumn("__all", F.lit(0))
        group = ["__all"]
    gl = list(group)
    m = confusion_summary(df, label, prediction, positive_label, gl).withColumnRenamed("n_label_classes", "__k")
    if score is not None:
        pos = model_classes[-1] if model_classes else None
        a = auc_binary(df, label, score, positive=pos, group=gl).select(*gl, "auc")
        m = m.join(a, gl, "left")
        ok = (F.col("__k") == 2) & F.lit(model_classes is None or len(model_classes) == 2)
    elif prob_cols:
        a = auc_ovr(df, label, prob_cols, gl).select(*gl, "auc", "undefined_classes")
        m = m.join(a, gl, "left")
        ok = (F.col("__k") == F.lit(len(prob_cols))) & (F.col("undefined_classes") == 0)
    else:
        m = m.withColumn("auc", F.lit(None).cast("double"))
        ok = F.lit(False)
    aucv = F.when(ok & F.col("auc").isNotNull(), F.col("auc")).otherwise(F.col("accuracy"))
    out = m.select(*[qcol(x) for x in gl], "accuracy", aucv.alias("auc"), "precision", "recall", "f1")
    return out.drop("__all") if one else out
