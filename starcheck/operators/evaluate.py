"""Splits and classifier metrics from counts."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starcheck.operators.positions import mark_random


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight of each class: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("class_rows"))
    every_class = Window.partitionBy()
    return counts.withColumn(
        "weight",
        F.sum("class_rows").over(every_class)
        / (F.count(F.lit(1)).over(every_class) * F.col("class_rows")),
    )


def train_quotas(sizes: DataFrame, label: str, test_share: float) -> DataFrame:
    """Training rows per class, of (label, rows): ceil(test_share * n) rows are held out, and the rest is shared
    out in proportion, with rounding by largest remainder (ties to the lower label).

    The windows run over one row per class.
    """
    every_class = Window.partitionBy()
    total = F.sum("_n").over(every_class)
    return (
        sizes.withColumnRenamed("rows", "_n")
        .withColumn("_total", total)
        .withColumn("_train", F.col("_total") - F.ceil(F.col("_total") * F.lit(test_share)))
        .withColumn("_share", F.col("_n").cast("decimal(19,0)") * F.col("_train").cast("decimal(19,0)"))
        .withColumn("_whole", F.floor(F.col("_share") / F.col("_total")).cast("long"))
        .withColumn("_rest", F.col("_share") % F.col("_total"))
        .withColumn("_open", F.col("_train") - F.sum("_whole").over(every_class))
        .withColumn("_place", F.row_number().over(Window.orderBy(F.desc("_rest"), label)))
        .select(label, (F.col("_whole") + (F.col("_place") <= F.col("_open")).cast("long")).alias("quota"))
    )


def stratified_split(
    df: DataFrame, key: str, label: str = "label", test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add is_train: an exact split per class by a seeded hash of the unique key."""

    def quotas(sizes: DataFrame) -> DataFrame:
        return train_quotas(sizes, label, test_share)

    return mark_random(df, [label], quotas, key, seed, "is_train")


def confusion(
    df: DataFrame, label: str = "label", prediction: str = "prediction", groups: Sequence[str] = ()
) -> DataFrame:
    return df.groupBy(*groups, label, prediction).agg(F.count(F.lit(1)).alias("rows"))


def accuracy(cells: DataFrame, label="label", prediction="prediction", groups: Sequence[str] = ()) -> DataFrame:
    """Share of rows on the diagonal of a confusion table."""
    right = F.when(F.col(label) == F.col(prediction), F.col("rows")).otherwise(0)
    return cells.groupBy(*groups).agg((F.sum(right) / F.sum("rows")).alias("accuracy"))


def macro_f1(cells: DataFrame, label="label", prediction="prediction", groups: Sequence[str] = ()) -> DataFrame:
    """Mean F1 over the classes seen as truth or as prediction; 0 for a class never hit."""
    hit = F.when(F.col(label) == F.col(prediction), F.col("rows")).otherwise(0)
    sides = F.array(
        F.struct(F.col(label).alias("class"), hit.alias("hits")),
        F.struct(F.col(prediction).alias("class"), F.lit(0).cast("long").alias("hits")),
    )
    per_class = (
        cells.select(*groups, "rows", F.inline(sides))
        .groupBy(*groups, "class")
        .agg((2.0 * F.sum("hits") / F.sum("rows")).alias("f1"))
    )
    return per_class.groupBy(*groups).agg(F.avg("f1").alias("f1_macro"))


def metrics(df: DataFrame, label="label", prediction="prediction", groups: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro F1 in one row (per group)."""
    cells = confusion(df, label, prediction, groups)
    left = accuracy(cells, label, prediction, groups)
    right = macro_f1(cells, label, prediction, groups)
    if groups:
        return left.join(right, list(groups))
    return left.withColumn("f1_macro", right.scalar())
