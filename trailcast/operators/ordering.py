"""Global order without a global task: ranks and cumulative counts in two levels.

A monotone bucket of the sort key splits the rows; rows are ranked inside their
bucket and shifted by the size of the buckets before it. Only bucket totals
(bounded by the number of buckets) are scanned in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

GRID = 4096


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a global aggregate, which is always exactly one row."""
    return df.crossJoin(F.broadcast(one_row))


def unit_bucket(score: Column, n: int = GRID) -> Column:
    """Monotone bucket for scores, dense on [0, 1] and open at both ends."""
    return F.greatest(F.lit(-1), F.least(F.lit(n), F.floor(score * n))).cast("bigint")


def real_bucket(score: Column, n: int = GRID) -> Column:
    """Monotone bucket for any real number: even steps of the logarithm, so large values spread too."""
    s = score.cast("double")
    return F.floor(F.signum(s) * F.log1p(F.abs(s)) * n).cast("bigint")


def quantile_bucket(df: DataFrame, column: str, n: int = 512) -> Column:
    """Monotone bucket from approximate quantiles, for scores that cluster.

    The split points (at most ``n``) come to the driver and are put into a balanced
    search tree, so the expression costs about log2(n) comparisons.
    """
    cuts = sorted(set(df.approxQuantile(column, [i / n for i in range(1, n)], 1.0 / (2 * n))))
    value = F.col(column)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo).cast("bigint")
        mid = (lo + hi) // 2
        return F.when(value < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def text_bucket(hash_text: Column) -> Column:
    """Monotone bucket of a hexadecimal hash: its first three digits (4096 buckets)."""
    return F.substring(hash_text, 1, 3)


def number_rows(df: DataFrame, order: list[Column], bucket: Column, name: str = "row_no",
                by: list[str] | None = None) -> DataFrame:
    """1-based position in the order ``by`` group. ``bucket`` must not decrease along the order.

    ``order`` must be a total order.
    """
    by = by or []
    b = df.withColumn("_bucket", bucket)
    sizes = b.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    shift = sizes.select(*by, "_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    local = b.withColumn(name, F.row_number().over(inside).cast("bigint"))
    return (
        local.join(shift, [*by, "_bucket"])
        .withColumn(name, F.col(name) + F.col("_shift"))
        .drop("_bucket", "_shift")
    )


def running_total(df: DataFrame, key: str, values: list[str], bucket: Column,
                  by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """For each distinct ``key`` the total of ``values`` strictly before it (``<value>_before``).

    ``df`` has one row per group and key. ``bucket`` must not decrease with the key.
    """
    by = by or []
    b = df.withColumn("_bucket", bucket)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    totals = b.groupBy(*by, "_bucket").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy(direction("_bucket")).rowsBetween(
        Window.unboundedPreceding, -1)
    shift = totals.select(*by, "_bucket", *[
        F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_s_{v}") for v in values])
    inside = Window.partitionBy(*by, "_bucket").orderBy(direction(key)).rowsBetween(
        Window.unboundedPreceding, -1)
    local = b.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    return (
        local.join(shift, [*by, "_bucket"])
        .withColumns({f"{v}_before": F.col(f"{v}_before") + F.col(f"_s_{v}") for v in values})
        .drop("_bucket", *[f"_s_{v}" for v in values])
    )
