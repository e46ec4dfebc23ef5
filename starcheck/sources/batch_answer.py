"""The answer to request batches as JSON documents of bounded size: results and clusters, in parts.

A batch can be a large share of all rows and a cluster a large share of a batch, so neither is written
as one array. Part p of a batch covers the review indices from p * rows_per_part up to the next part; it
holds the results of those rows and, for each cluster with members among them, the cluster's id, size,
first index, representative text and its member indices in that range. Every array thus has at most
rows_per_part entries (per distinct index), whatever the size of the batch or cluster. One manifest
document per batch (part -1) says how many parts, results and clusters there are, so that a reader knows
when it has the whole answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

ROWS_PER_PART = 64
BATCH, INDEX = "batch_id", "review_index"


def answer_documents(results: DataFrame, clusters: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """(batch_id, part, body) from analyze_batch()'s results (with cluster_id) and clusters.

    Rows with a null batch_id or review_index have no place in a part and are left out; analyze_batch()
    does not make such rows.
    """
    placed = results.filter(F.col(BATCH).isNotNull() & F.col(INDEX).isNotNull())
    placed = placed.withColumn("part", F.floor(F.col(INDEX) / F.lit(rows_per_part)).cast("long"))
    fields = [c for c in results.columns if c != BATCH]
    parts = placed.groupBy(BATCH, "part").agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("results")
    )
    members = placed.filter(F.col("cluster_id").isNotNull()).groupBy(BATCH, "part", "cluster_id").agg(
        F.sort_array(F.collect_list(INDEX)).alias("review_indices")
    )
    members = members.join(clusters, [BATCH, "cluster_id"]).select(
        BATCH, "part",
        F.struct("cluster_id", "size", "first_index", "representative_text", "review_indices").alias("cluster"),
    )
    grouped = members.groupBy(BATCH, "part").agg(F.sort_array(F.collect_list("cluster")).alias("clusters"))
    documents = parts.join(grouped, [BATCH, "part"], "left").select(
        BATCH, "part",
        F.struct(
            F.col(BATCH), F.col("part"), F.lit("part").alias("kind"), "results",
            F.coalesce("clusters", F.array().cast(grouped.schema["clusters"].dataType)).alias("clusters"),
        ).alias("doc"),
    )
    counts = placed.groupBy(BATCH).agg(
        F.count_distinct("part").alias("parts"), F.count("*").alias("results"),
        F.count_distinct("cluster_id").alias("clusters"),
    )
    manifest = counts.select(
        BATCH, F.lit(-1).cast("long").alias("part"),
        F.struct(
            F.col(BATCH), F.lit(-1).cast("long").alias("part"), F.lit("manifest").alias("kind"),
            F.struct("parts", "results", "clusters").alias("manifest"),
        ).alias("doc"),
    )
    as_json = lambda df: df.select(BATCH, "part", F.to_json("doc", {"ignoreNullFields": "false"}).alias("body"))
    return as_json(documents).unionByName(as_json(manifest))


def write_answer(documents: DataFrame, path: str) -> None:
    """JSON lines, one document per line; a second write to the same path fails instead of appending."""
    documents.select("body").write.mode("errorifexists").text(path)


READ_SCHEMA = StructType([
    StructField(BATCH, LongType()),
    StructField("part", LongType()),
    StructField("kind", StringType()),
    StructField("results", ArrayType(StructType([
        StructField(INDEX, LongType()), StructField("is_flagged", BooleanType()), StructField("cluster_id", LongType()),
    ]))),
    StructField("clusters", ArrayType(StructType([
        StructField("cluster_id", LongType()), StructField("review_indices", ArrayType(LongType())),
    ]))),
    StructField("manifest", StructType([
        StructField("parts", LongType()), StructField("results", LongType()), StructField("clusters", LongType()),
    ])),
])


def read_answer(spark: SparkSession, path: str) -> DataFrame:
    """Figures of each written document, read back from its JSON."""
    doc = F.from_json("value", READ_SCHEMA)
    rows = spark.read.text(path).select(doc.alias("d")).select("d.*")
    is_part = F.col("kind") == "part"
    return rows.select(
        BATCH, "part", "kind",
        F.when(is_part, F.size("results")).otherwise(F.col("manifest.results")).cast("long").alias("n_results"),
        F.when(is_part, F.size(F.filter("results", lambda r: r["is_flagged"]))).cast("long").alias("n_flagged"),
        F.when(is_part, F.get("results", 0)[INDEX]).alias("first_index"),
        F.when(is_part, F.get("results", F.size("results") - 1)[INDEX]).alias("last_index"),
        F.when(is_part, F.size("clusters")).otherwise(F.col("manifest.clusters")).cast("long").alias("n_clusters"),
        F.when(is_part, F.aggregate("clusters", F.lit(0).cast("long"), lambda acc, c: acc + F.size(c["review_indices"])))
        .alias("n_members"),
        F.col("manifest.parts").alias("n_parts"),
    )
