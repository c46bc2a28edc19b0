"""Linear regression from sums that merge, solved inside Spark.

The means, variances and covariances of the inputs and the target are one
aggregation, per group or over all rows; they are combined before the shuffle, so a
hot group costs no more than any other. The normal equations of each group are
then solved by Cholesky's method in array functions: no row goes to Python, and
thousands of groups are solved side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: An input whose variance is explained by earlier ones up to this share is dropped.
COLLINEAR = 1e-9


def moments(df: DataFrame, inputs: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group ``n``, ``means`` (of the inputs, then the target), ``cov`` (the lower
    triangle of the inputs' covariances, row by row) and ``cross`` (covariance of
    each input with the target). Rows with a missing input or target do not
    count; a group without any other row has ``n`` 0."""
    known = F.lit(True)
    for c in (*inputs, target):
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    x = [F.when(known, F.col(c).cast("double")) for c in inputs]
    y = F.when(known, F.col(target).cast("double"))
    own = [F.var_pop(x[i]) if i == j else F.covar_pop(x[i], x[j]) for i in range(len(x)) for j in range(i + 1)]
    zero = F.lit(0.0)
    return df.groupBy(*by).agg(
        F.count(y).alias("n"),
        F.array(*[F.avg(c) for c in (*x, y)]).alias("means"),
        F.array(*[F.coalesce(c, zero) for c in own]).alias("cov"),
        F.array(*[F.coalesce(F.covar_pop(c, y), zero) for c in x]).alias("cross"),
    )


def _at(i: Column, j: Column) -> Column:
    """Place of (i, j), j <= i, in a triangle that is stored row by row."""
    return (i * (i + 1) / 2 + j).cast("int")


def solved(fit: DataFrame, size: int, ridge: float = 0.0) -> DataFrame:
    """``fit`` (from ``moments``) with ``weights`` (one per input) and ``bias``.

    ``ridge`` adds this share of an input's own variance to it. An input that
    earlier ones explain has weight 0. Groups without rows have NULL for both.
    """
    steps = F.sequence(F.lit(0), F.lit(size - 1))
    raw = F.col("cov")
    diagonal = F.transform(steps, lambda i: F.get(raw, _at(i, i)))

    def entry(low: Column, i: Column, j: Column) -> Column:
        """Entry (i, j) of the factor, from those in front of it."""
        before = F.sequence(F.lit(0), F.lit(size - 1))
        products = F.aggregate(before, F.lit(0.0), lambda s, k: F.when(k < j, s + F.get(low, _at(i, k)) * F.get(low, _at(j, k))).otherwise(s))
        own = F.get(raw, _at(i, j)) * F.when(i == j, F.lit(1.0 + ridge)).otherwise(F.lit(1.0)) - products
        pivot = F.get(low, _at(j, j))
        root = F.when(own > F.lit(COLLINEAR) * F.get(diagonal, i), F.sqrt(F.greatest(own, F.lit(0.0)))).otherwise(F.lit(0.0))
        return F.when(i == j, root).when(pivot > 0, own / pivot).otherwise(F.lit(0.0))

    none = F.expr("cast(array() as array<double>)")
    low = F.aggregate(
        steps,
        none,
        lambda rows, i: F.aggregate(F.sequence(F.lit(0), i), rows, lambda so_far, j: F.concat(so_far, F.array(entry(so_far, i, j)))),
    )
    table = fit.withColumn("_low", low)
    L, cross = F.col("_low"), F.col("cross")
    # Forwards: L z = cross.
    forward = F.aggregate(
        steps,
        none,
        lambda z, i: F.concat(
            z,
            F.array(
                F.when(
                    F.get(L, _at(i, i)) > 0,
                    (F.get(cross, i) - F.aggregate(steps, F.lit(0.0), lambda s, k: F.when(k < i, s + F.get(L, _at(i, k)) * F.get(z, k)).otherwise(s))) / F.get(L, _at(i, i)),
                ).otherwise(F.lit(0.0))
            ),
        ),
    )
    table = table.withColumn("_z", forward)
    # Backwards: L' w = z, from the last weight to the first; w is put in front.
    last = F.lit(size - 1)

    def weight(w: Column, i: Column) -> Column:
        known = F.aggregate(steps, F.lit(0.0), lambda s, k: F.when(k > i, s + F.get(L, _at(k, i)) * F.get(w, k - i - 1)).otherwise(s))
        pivot = F.get(L, _at(i, i))
        return F.when(pivot > 0, (F.get(F.col("_z"), i) - known) / pivot).otherwise(F.lit(0.0))

    backward = F.aggregate(steps, none, lambda w, k: F.concat(F.array(weight(w, last - k)), w))
    table = table.withColumn("weights", F.when(F.col("n") > 0, backward))
    explained = F.aggregate(steps, F.lit(0.0), lambda s, k: s + F.get("weights", k) * F.get("means", k))
    return table.withColumn("bias", F.get("means", F.lit(size)) - explained).drop("_low", "_z")


def predicted(weights: str | Column, bias: str | Column, inputs: Sequence[str]) -> Column:
    """The prediction for a row; NULL where an input is."""
    total = F.col(bias) if isinstance(bias, str) else bias
    for k, c in enumerate(inputs):
        total = total + F.get(weights, F.lit(k)) * F.col(c).cast("double")
    return total
