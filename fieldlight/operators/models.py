"""Vector classifiers in pyspark.ml, and block bootstraps of measures."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluation


#: Steps of class weight that a network sees, as copies of rows.
WEIGHT_STEPS = 8
#: Training rows of a part, beyond one part a core.
PART_ROWS = 20_000


def vector_classifier(
    train: DataFrame, test: DataFrame, v: str, label: str, classes: int, hidden: int | None = None, iterations: tuple[int, ...] = (30,), validation: DataFrame | None = None
) -> DataFrame:
    """test with predicted; multinomial regression, or one hidden layer. Standardised on train only.

    Classes weigh 1 / sqrt(share): as weights of the regression, and as up to WEIGHT_STEPS copies of a row for the
    network, which knows no weights. Of several numbers of iterations the one with the best macro F1 on the
    validation rows is taken, the fewer of equals.
    """
    counts = train.groupBy(label).agg(F.count("*").alias("_n"))
    most = counts.agg(F.min("_n").alias("_least"))  # one row
    t = train.join(counts, label).crossJoin(most).withColumn("_w", F.sqrt(F.col("_least") / F.col("_n"))).drop("_n", "_least")
    prepared = lambda d: d.withColumn("raw", array_to_vector(v)).withColumn("label_", F.col(label).cast("double"))
    scaler = StandardScaler(inputCol="raw", outputCol="_x", withMean=True).fit(prepared(t))
    t = scaler.transform(prepared(t)).persist()
    # every task of every iteration sends the driver a result, so parts are as many as rows need, not as many as the input has
    parts = max(t.sparkSession.sparkContext.defaultParallelism, -(-t.count() // PART_ROWS))
    models = []
    for n in iterations:
        if hidden is None:
            models.append(LogisticRegression(featuresCol="_x", labelCol="label_", weightCol="_w", regParam=0.05, maxIter=n, family="multinomial").fit(t.coalesce(parts)))
        else:
            copies = t.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.round(F.col("_w") * WEIGHT_STEPS).cast("int")))))
            size = len(t.select(v).head()[0])
            models.append(MultilayerPerceptronClassifier(featuresCol="_x", labelCol="label_", layers=[size, hidden, classes], seed=1, maxIter=n).fit(copies.coalesce(parts)))
    called = lambda m, d: m.transform(scaler.transform(prepared(d))).withColumn("predicted", F.col("prediction").cast("int")).drop("raw", "_x", "label_", "rawPrediction", "probability", "prediction")
    best = models[0]
    if len(models) > 1:
        if validation is None:
            raise ValueError("a choice of iterations needs validation rows")
        f1 = [evaluation.overall_metrics(evaluation.class_metrics(evaluation.confusion(called(m, validation), label, "predicted"), label, "predicted")).head().macro_f1 for m in models]
        best = models[max(range(len(models)), key=lambda i: (f1[i], -i))]
    t.unpersist()
    return called(best, test)


def replicate_metrics(df: DataFrame, block: str, truth: str, scores: list[str], replicates: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, model, replicate, auroc, average_precision): every score on the same block bootstrap draws.

    Rows are first added up by block and score value; a table of draws then weights blocks, so that rows are
    never copied per replicate.
    """
    from .mixture import draws

    keys = keys or []
    groups = df.select(*(keys or [F.lit(0).alias("_all")]), block).distinct()
    w = draws(groups, keys or ["_all"], block, replicates)
    w = w if keys else w.drop("_all")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).cast("double").alias("score")) for c in scores]))
    rows = df.select(*keys, block, truth, each.alias("s")).groupBy(*keys, block, "s.model", "s.score").agg(F.sum(truth).alias("_p"), F.count("*").alias("_c"))
    by = rows.join(w, [*keys, block]).groupBy(*keys, "model", "replicate", "score").agg(F.sum(F.col("weight") * F.col("_p")).alias("p"), F.sum(F.col("weight") * (F.col("_c") - F.col("_p"))).alias("n"))
    long = by.select(*keys, "model", "replicate", "score", F.explode(F.array(F.struct(F.lit(1).alias("t"), F.col("p").alias("wt")), F.struct(F.lit(0).alias("t"), F.col("n").alias("wt")))).alias("s"))
    m = evaluation.ranking_metrics(long.select(*keys, "model", "replicate", "score", "s.*"), [*keys, "model", "replicate"], "t", "score", "wt")
    return m.select(*keys, "model", "replicate", "auroc", "average_precision")


def interval(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, low, high, replicates_used): the middle 95 % of the replicates that have a value."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    out = df.groupBy(*keys).agg(q.alias("q"), F.count(value).alias("replicates_used"))
    return out.select(*keys, F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"), "replicates_used")


def bootstrap_metrics(df: DataFrame, block: str, truth: str, score: str, replicates: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, low, high, replicates_used) of AUROC over block bootstrap replicates; one class alone has none."""
    return interval(replicate_metrics(df, block, truth, [score], replicates, keys), keys or [], "auroc")


def paired_deltas(df: DataFrame, block: str, truth: str, first: str, second: str, replicates: int, least_share: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """(keys, metric, low, high, replicates_used, usable): first less second, replicate by replicate on the same draws.

    usable: enough replicates had both classes for the interval to stand.
    """
    keys = keys or []
    m = replicate_metrics(df, block, truth, [first, second], replicates, keys)
    way = F.when(F.col("model") == first, 1.0).otherwise(-1.0)
    both = m.groupBy(*keys, "replicate").agg(*[F.when(F.count(c) == 2, F.sum(way * F.col(c))).alias(c) for c in ("auroc", "average_precision")])
    long = both.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.round(F.col(c), 9).alias("delta")) for c in ("auroc", "average_precision")])).alias("d"))
    out = interval(long.select(*keys, "d.metric", "d.delta"), [*keys, "metric"], "delta")
    return out.withColumn("usable", F.col("replicates_used") >= least_share * replicates)
