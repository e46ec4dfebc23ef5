"""Joins that hold when one key has a large share of the rows."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcheck.session import cut

ROWS_PER_TASK = 100_000


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread: str,
    matches: str,
    counts: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join rows to a table that is unique on the keys, with hot keys spread over many tasks.

    The column `matches` of `counts` (by default the lookup itself) says how many rows have the
    key. That table should be cheap to make, as it is read once to see whether there are hot keys
    at all. Without any this is a plain join.

    A key with more than `rows_per_task` rows is cut in ceil(matches / rows_per_task) parts, whatever
    its share of all rows. Its rows get a part by a hash of the column `spread`, and its lookup row is
    repeated once per part. All other keys have part 0, so nothing else is repeated. The table of hot
    keys grows with the data and gets no hint: it is written, so its size is known to the planner.
    """
    keys = list(keys)
    counts = lookup if counts is None else counts
    if (counts.agg(F.max(matches)).first()[0] or 0) <= rows_per_task:
        return rows.join(lookup, keys)
    parts = F.ceil(F.col(matches) / rows_per_task).alias("_parts")
    hot = cut(counts.filter(F.col(matches) > rows_per_task).select(*keys, parts))
    zero = F.lit(0).cast("long")
    salt = F.when(F.col("_parts").isNull(), zero).otherwise(F.pmod(F.xxhash64(spread), F.col("_parts")))
    salts = F.sequence(zero, F.coalesce("_parts", F.lit(1).cast("long")) - 1)
    salted = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_parts")
    repeated = lookup.join(hot, keys, "left").withColumn("_salt", F.explode(salts)).drop("_parts")
    return salted.join(repeated, [*keys, "_salt"]).drop("_salt")
