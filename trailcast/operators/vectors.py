"""Linear probes over a table of vectors with a condition, a group and a length.

Vectors are summed per class and dimension, never gathered. A direction is one short
array, so it is joined as a single row (or one per fold or layer).
"""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from trailcast.operators.metrics import roc_auc
from trailcast.operators.ordering import attach
from trailcast.operators.splits import group_kfold


def sums(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """(keys, dim, total, n): per-dimension sums of the vectors of each key."""
    return df.select(*keys, F.posexplode(vec).alias("dim", "v")).groupBy(*keys, "dim").agg(
        F.sum(F.col("v").cast("double")).alias("total"), F.count(F.lit(1)).alias("n"))


def _as_array(per_dim: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """One array per key; its length is the number of dimensions."""
    return per_dim.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("dim", value.alias("v")))), lambda x: x["v"]).alias(name))


def directions(df: DataFrame, by: list[str] | None = None, unit: bool = False) -> DataFrame:
    """(by, direction): mean of the positive vectors minus mean of the negative ones (``y``)."""
    by = by or []
    s = sums(df, [*by, "y"]).groupBy(*by, "dim").agg(
        (F.sum(F.when(F.col("y") == 1, F.col("total"))) / F.sum(F.when(F.col("y") == 1, F.col("n")))
         - F.sum(F.when(F.col("y") == 0, F.col("total"))) / F.sum(F.when(F.col("y") == 0, F.col("n")))).alias("d"))
    d = _as_array(s, by, F.col("d"), "direction")
    if not unit:
        return d
    norm = F.sqrt(F.aggregate("direction", F.lit(0.0), lambda a, x: a + x * x)) + 1e-8
    return d.withColumn("_n", norm).withColumn(
        "direction", F.transform("direction", lambda x: x / F.col("_n"))).drop("_n")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda t, x: t + x)


def project(df: DataFrame, direction: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Add ``projection`` of every vector. ``direction`` has one short row per ``by`` value."""
    joined = df.join(F.broadcast(direction), by) if by else attach(df, direction)
    return joined.withColumn("projection", dot(F.col("vec"), F.col("direction"))).drop("direction")


def held_out_projections(df: DataFrame, by: list[str] | None = None, group: str = "grp", k: int = 5) -> DataFrame:
    """Projection of each row on the direction of the other folds.

    The sums of a training side are the total minus the fold, so the vectors are read once.
    """
    by = by or []
    folds = df.join(group_kfold(df, group, k), group)
    per = sums(folds, [*by, "fold", "y"])
    total = per.groupBy(*by, "y", "dim").agg(F.sum("total").alias("all_total"), F.sum("n").alias("all_n"))
    held = total.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))))
    train = held.join(
        per, [*by, "fold", "y", "dim"], "left").select(
        *by, "fold", "y", "dim", (F.col("all_total") - F.coalesce("total", F.lit(0.0))).alias("t"),
        (F.col("all_n") - F.coalesce("n", F.lit(0))).alias("n"))
    mean = F.try_divide("t", "n")
    d = train.groupBy(*by, "fold", "dim").agg(
        (F.max(F.when(F.col("y") == 1, mean)) - F.max(F.when(F.col("y") == 0, mean))).alias("d"))
    # A fold without both classes to train on has no direction; its rows are left out.
    d = d.where(F.col("d").isNotNull())
    return project(folds, _as_array(d, [*by, "fold"], F.col("d"), "direction"), [*by, "fold"])


def probe_auc(df: DataFrame, by: list[str] | None = None, group: str = "grp", k: int = 5) -> DataFrame:
    """(by, mean and deviation of the fold AUCs) of the difference-of-means probe."""
    by = by or []
    aucs = roc_auc(held_out_projections(df, by, group, k), "projection", "y", [*by, "fold"])
    return aucs.groupBy(*by).agg(
        F.coalesce(F.avg("auc"), F.lit(0.5)).alias("auc"), F.stddev_pop("auc").alias("auc_sd"))


def length_confound(df: DataFrame, by: list[str], group: str = "grp", k: int = 5) -> DataFrame:
    """(by, length_only_auc, len_corr): how much of the probe the length alone explains."""
    only = roc_auc(df, "len", "y", by).select(
        *by, F.greatest(F.col("auc"), 1 - F.col("auc")).alias("length_only_auc"))
    corr = held_out_projections(df, by, group, k).groupBy(*by).agg(
        F.abs(F.corr("projection", F.col("len").cast("double"))).alias("len_corr"))
    return only.join(corr, by)


def layer_sweep(df: DataFrame, n_layers: int) -> DataFrame:
    """Best layer overall and best layer whose projection does not follow the length."""
    per = probe_auc(df, ["layer"]).join(length_confound(df, ["layer"]), "layer")
    depth = float(max(n_layers - 1, 1))
    order = F.struct(F.round("auc", 9), -F.col("layer"))
    clean = F.when(F.col("len_corr") < 0.5, order)
    best = per.agg(
        F.max("length_only_auc").alias("length_only_auc"),
        F.max_by(F.struct("layer", "auc", "len_corr"), order).alias("p"),
        F.max_by(F.struct("layer", "auc"), clean).alias("c"))
    c_layer, c_auc = F.coalesce("c.layer", "p.layer"), F.coalesce("c.auc", "p.auc")
    return best.select(
        F.lit(n_layers).cast("bigint").alias("n_layers"), "length_only_auc", F.col("p.auc").alias("peak_auc"),
        F.col("p.layer").alias("peak_layer"), (F.col("p.layer") / depth).alias("peak_depth"),
        F.col("p.len_corr").alias("len_corr_at_peak"), c_auc.alias("clean_auc"), c_layer.alias("clean_layer"),
        (c_layer / depth).alias("clean_depth"))


def cosine_and_projections(df: DataFrame, shared: int, other_a: int, other_b: int) -> DataFrame:
    """Two axes that share one condition: their |cosine| and the mean projections per condition."""
    def axis(neg: int, name: str) -> DataFrame:
        rows = df.where(F.col("cond").isin(shared, neg)).withColumn("y", (F.col("cond") == shared).cast("int"))
        return directions(rows, unit=True).withColumnRenamed("direction", name)

    both = attach(axis(other_a, "axis_a"), axis(other_b, "axis_b"))
    p = attach(df, both).groupBy("cond").agg(
        F.avg(dot(F.col("vec"), F.col("axis_a"))).alias("on_a"), F.avg(dot(F.col("vec"), F.col("axis_b"))).alias("on_b"),
        F.first(F.abs(dot(F.col("axis_a"), F.col("axis_b")))).alias("cosine"))
    origin = p.where(F.col("cond") == shared).select(F.col("on_a").alias("a0"), F.col("on_b").alias("b0"))
    return attach(p, origin).select(
        "cond", "cosine", (F.col("on_a") - F.col("a0")).alias("on_a"), (F.col("on_b") - F.col("b0")).alias("on_b"))


def within_group_direction(df: DataFrame, group: str = "grp") -> DataFrame:
    """(dim, d): class difference inside each group, then averaged over the groups that have both."""
    per = sums(df, [group, "y"]).groupBy(group, "dim").agg(
        (F.sum(F.when(F.col("y") == 1, F.col("total") / F.col("n")))
         - F.sum(F.when(F.col("y") == 0, F.col("total") / F.col("n")))).alias("d"))
    return per.where(F.col("d").isNotNull()).groupBy("dim").agg(F.avg("d").alias("d"))


def principal_plane(df: DataFrame) -> DataFrame:
    """First two principal coordinates of the standardized vectors."""
    rows = df.withColumn("features", array_to_vector(F.transform("vec", lambda x: x.cast("double"))))
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="scaled").fit(rows)
    scaled = scaler.transform(rows)
    model = PCA(k=2, inputCol="scaled", outputCol="plane").fit(scaled)
    xy = vector_to_array("plane")
    return model.transform(scaled).select(*df.columns, xy[0].alias("x"), xy[1].alias("y2"))


def class_separation(plane: DataFrame) -> DataFrame:
    """Mean distance of the class centroids over the mean distance of rows to their centroid."""
    c = plane.groupBy("cond").agg(F.avg("x").alias("cx"), F.avg("y2").alias("cy"))
    spread = plane.join(F.broadcast(c), "cond").groupBy("cond").agg(
        F.avg(F.hypot(F.col("x") - F.col("cx"), F.col("y2") - F.col("cy"))).alias("s")).agg(F.avg("s").alias("within"))
    # A handful of centroids; the pairs are formed inside one short array.
    pts = c.agg(F.array_sort(F.collect_list(F.struct("cond", "cx", "cy"))).alias("p"))
    pairs = pts.select(F.explode(F.flatten(F.transform("p", lambda a: F.transform(
        F.filter("p", lambda b: b["cond"] > a["cond"]),
        lambda b: F.hypot(a["cx"] - b["cx"], a["cy"] - b["cy"]))))).alias("d"))
    between = pairs.agg(F.avg("d").alias("between"))
    return attach(between, spread).select(
        "between", "within", (F.col("between") / (F.col("within") + 1e-9)).alias("separation"))
