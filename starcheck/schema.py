"""Fixed schemas; nothing is inferred from the data."""

from pyspark.sql import types as T

REVIEWS = T.StructType(
    [
        T.StructField("review_id", T.LongType()),
        T.StructField("product_category", T.StringType()),
        T.StructField("rating", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("true_sentiment", T.StringType()),
        T.StructField("is_mismatch", T.BooleanType()),
        T.StructField("is_templated_fake", T.BooleanType()),
    ]
)
REVIEW_COLUMNS = REVIEWS.fieldNames()

REQUEST = T.StructType(
    [
        T.StructField("rating", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("review_id", T.StringType()),
    ]
)

# A request body is either one review or a list of them under "reviews".
REQUEST_BODY = T.StructType(
    [T.StructField("reviews", T.ArrayType(REQUEST)), *REQUEST.fields]
)

RUNS = T.StructType(
    [
        T.StructField("experiment", T.StringType()),
        T.StructField("run", T.StringType()),
        T.StructField("model_type", T.StringType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("f1_macro", T.DoubleType()),
        T.StructField("latency_ms", T.DoubleType()),
    ]
)

ORDERS = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampNTZType()),
        T.StructField("o_orderpriority", T.StringType()),
    ]
)
