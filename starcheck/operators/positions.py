"""Row numbers and fixed-size picks that never sort a whole group in one task."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starcheck.session import cut

LEAF_BITS = 16
MAX_GROUPS = 1000
BEFORE = (Window.unboundedPreceding, -1)


def leaf_bits(df: DataFrame, key: str) -> int:
    """How many low bits of the keys a leaf spans, so that it holds 65,536 rows at most on average.

    Dense keys have leaves of 16 bits; for sparse ones, such as hashes, a leaf spans as many more as there
    are keys without a row. One pass over the keys.
    """
    least, most, rows = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if not rows:
        return LEAF_BITS
    return min(LEAF_BITS + ((most - least + 1) // rows).bit_length() - 1, 62)


def _leaf(key: str, bits: int) -> Column:
    return F.shiftright(F.col(key), bits)


def _rows_before(groups: Sequence[str], order: str, count: str) -> Column:
    window = Window.partitionBy(*groups).orderBy(order).rowsBetween(*BEFORE)
    return F.coalesce(F.sum(count).over(window), F.lit(0))


def leaf_offsets(df: DataFrame, groups: Sequence[str], key: str, bits: int) -> DataFrame:
    """Per group and leaf (2^bits neighbouring keys): how many rows come before the leaf.

    Counts are added up over two levels, so a window of a group sees one row per leaf of a branch, at
    most 65,536, or one per branch: a row for each 2^32 rows where the keys are spread evenly.
    """
    groups = list(groups)
    leaves = (
        df.groupBy(*groups, _leaf(key, bits).alias("_leaf"))
        .agg(F.count(F.lit(1)).alias("_count"))
        .withColumn("_branch", F.shiftright("_leaf", LEAF_BITS))
    )
    branches = (
        leaves.groupBy(*groups, "_branch")
        .agg(F.sum("_count").alias("_branch_count"))
        .withColumn("_branch_before", _rows_before(groups, "_branch", "_branch_count"))
        .drop("_branch_count")
    )
    return (
        leaves.join(branches, [*groups, "_branch"])
        .withColumn(
            "_before",
            F.col("_branch_before") + _rows_before([*groups, "_branch"], "_leaf", "_count"),
        )
        .select(*groups, "_leaf", "_count", "_before")
    )


def with_position(df: DataFrame, groups: Sequence[str], key: str, name: str) -> DataFrame:
    """Add the 0-based position of each row in its group by a unique BIGINT key.

    Equal to row_number() - 1 over the group, but the data is shuffled by (group, leaf) and
    sorted in pieces of about 65,536 rows, whatever the size of the group.
    """
    groups = list(groups)
    bits = leaf_bits(df, key)
    leaves = leaf_offsets(df, groups, key, bits).drop("_count")
    within = Window.partitionBy(*groups, "_leaf").orderBy(key)
    return (
        df.withColumn("_leaf", _leaf(key, bits))
        .join(leaves, [*groups, "_leaf"])
        .withColumn(name, F.col("_before") + F.row_number().over(within) - 1)
        .drop("_leaf", "_before")
    )


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the smallest values of a unique BIGINT key.

    Only leaves that start before row n matter. They number at most n, as each holds a row, so
    their table can be broadcast when n is small; the last one is cut by position.
    """
    bits = leaf_bits(df, key)
    leaves = leaf_offsets(df, [], key, bits).filter(F.col("_before") < n)
    if n <= 100_000:
        leaves = F.broadcast(leaves)
    kept = df.withColumn("_leaf", _leaf(key, bits)).join(leaves, "_leaf")
    whole = kept.filter(F.col("_before") + F.col("_count") <= n)
    last = kept.filter(F.col("_before") + F.col("_count") > n)
    rank = F.row_number().over(Window.partitionBy("_leaf").orderBy(key))
    last = last.withColumn("_rank", rank).filter(F.col("_before") + F.col("_rank") <= n).drop("_rank")
    return whole.unionByName(last).drop("_leaf", "_count", "_before")


def mark_random(
    df: DataFrame,
    groups: Sequence[str],
    quotas: Callable[[DataFrame], DataFrame],
    key: str,
    seed: int,
    name: str,
) -> DataFrame:
    """Mark `quota` rows of each group, chosen by a seeded hash of the unique key.

    `quotas` makes (groups, quota) of (groups, rows); rows of other groups go. Each group is cut into
    65,536 slices of the hash and the slice where the quota is used up is found from counts alone. Only
    the keys of that slice are sorted, to find the last one that is taken. That one row per group comes
    to the driver, and all rows are decided where they are: one scan without a shuffle.
    """
    groups = list(groups)
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    hashed = df.select(*groups, F.col(key).alias("_key"), digest.alias("_hash"))
    hashed = hashed.withColumn("_slice", F.substring("_hash", 1, 4))
    slices = cut(hashed.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_count")))
    sizes = slices.groupBy(*groups).agg(F.sum("_count").alias("rows"))
    wanted = quotas(sizes).limit(MAX_GROUPS + 1).collect()
    if len(wanted) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    few = df.sparkSession.createDataFrame(
        [(*[r[g] for g in groups], r["quota"]) for r in wanted],
        T.StructType([*[df.schema[g] for g in groups], T.StructField("quota", T.LongType())]),
    )
    edges = (
        slices.withColumn("_before", _rows_before(groups, "_slice", "_count"))
        .join(F.broadcast(few), groups)
        .filter((F.col("_before") < F.col("quota")) & (F.col("quota") <= F.col("_before") + F.col("_count")))
        .select(*groups, "_slice", (F.col("quota") - F.col("_before")).alias("_need"))
    )
    rank = F.row_number().over(Window.partitionBy(*groups, "_slice").orderBy("_hash", "_key"))
    # At most one row per group, as each has one edge at most.
    last = (
        hashed.join(F.broadcast(edges), [*groups, "_slice"])
        .withColumn("_rank", rank)
        .filter(F.col("_rank") == F.col("_need"))
        .collect()
    )
    ends = {tuple(r[g] for g in groups): (r["_hash"], r["_key"]) for r in last}
    taken = None
    for r in wanted:
        of_group = F.lit(True)
        for g in groups:
            of_group = of_group & F.col(g).eqNullSafe(F.lit(r[g]))
        end = ends.get(tuple(r[g] for g in groups))
        # A quota of zero has no end and takes nothing; one above the group size takes everything.
        if end is None:
            within = F.lit(r["quota"] > 0)
        else:
            within = (F.col("_hash") < end[0]) | ((F.col("_hash") == end[0]) & (F.col(key) <= end[1]))
        taken = F.when(of_group, within) if taken is None else taken.when(of_group, within)
    taken = F.lit(None).cast("boolean") if taken is None else taken
    marked = df.withColumn("_hash", digest).withColumn(name, taken).drop("_hash")
    return marked.filter(F.col(name).isNotNull())


def sample_per_group(df: DataFrame, group: str, n: int, key: str, seed: int) -> DataFrame:
    """n rows of each group; an error if a group has fewer."""
    message = F.format_string("a class has fewer than %d rows", F.lit(n))

    def quotas(sizes: DataFrame) -> DataFrame:
        return sizes.filter(F.col(group).isNotNull()).select(
            group,
            F.when(F.col("rows") >= n, F.lit(n)).otherwise(F.raise_error(message).cast("int")).alias("quota"),
        )

    return mark_random(df, [group], quotas, key, seed, "_chosen").filter("_chosen").drop("_chosen")
