"""Training, using and explaining a linear sentiment model."""

import logging
import math
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starcheck.functions.labels import LABEL_NAMES, label_name
from starcheck.functions.once import once
from starcheck.operators.evaluate import class_weights
from starcheck.operators.explain import CONTRIBUTIONS, TOP_TOKENS
from starcheck.operators.features import MAX_TERMS, MIN_TEXTS, fit_features, with_terms

# Inverse regularisation strength and iteration limit.
INVERSE_REGULARISATION = 1.0
MAX_ITERATIONS = 1000
ROWS_PER_TASK = 20_000
TOLERANCE = 1e-9

log = logging.getLogger(__name__)


def train_classifier(
    df: DataFrame,
    max_terms: int = MAX_TERMS,
    min_texts: int = MIN_TEXTS,
    inverse_regularisation: float = INVERSE_REGULARISATION,
    max_iterations: int = MAX_ITERATIONS,
    features: PipelineModel | None = None,
) -> PipelineModel:
    """Multinomial logistic regression with balanced classes over TF-IDF features.

    `df` has text and label. The penalty is scaled to the sum of the weights, which is the number
    of rows when the classes are balanced. Equal rows are merged into one with their summed
    weight, which leaves the loss as it is and saves every iteration from reading copies. `features` are
    those of fit_features() on the same rows and terms, if there are any yet.
    """
    features = features or fit_features(df, max_terms, min_texts)
    # One row per class.
    weights = F.broadcast(class_weights(df).select("label", "weight"))
    # Texts meet by a digest, so that whole texts are not shuffled as keys.
    digest = F.unhex(F.sha2("text", 256)).alias("_digest")
    distinct = df.groupBy(digest, "label").agg(
        F.any_value("text").alias("text"), F.count(F.lit(1)).alias("_copies")
    )
    rows = distinct.join(weights, "label").withColumn("weight", F.col("weight") * F.col("_copies"))
    ready = features.transform(rows).select(F.col("label").cast("double"), "weight", "features").persist()
    try:
        total, count = ready.agg(F.sum("weight"), F.count(F.lit(1))).first()
        learner = LogisticRegression(
            family="multinomial",
            weightCol="weight",
            regParam=1.0 / (inverse_regularisation * total),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=max_iterations,
            tol=TOLERANCE,
        )
        # Every iteration starts one task per partition, so few rows go into few of them.
        fitted = learner.fit(ready.coalesce(max(1, math.ceil(count / ROWS_PER_TASK))))
    finally:
        ready.unpersist()
    return PipelineModel([*features.stages, fitted])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add prediction (class id, first of equal scores) and confidence (its probability)."""
    scored = once(model.transform(df), _scores=vector_to_array("probability"))
    return (
        once(scored, confidence=F.array_max("_scores"))
        .withColumn("prediction", (F.array_position("_scores", F.col("confidence")) - 1).cast("int"))
        .select(*df.columns, "prediction", "confidence")
    )


def model_classifier(model: PipelineModel) -> Callable[[DataFrame], DataFrame]:
    """The model as a classifier for score_mismatch(); whole texts are read."""

    def classify(df: DataFrame) -> DataFrame:
        return (
            df.transform(predict, model)
            .withColumn("predicted_sentiment", label_name(F.col("prediction")))
            .drop("prediction")
        )

    return classify


def choose_classifier(kind: str, path: str | None, fallback: Callable[[DataFrame], DataFrame]):
    """The model at `path` if there is one that loads, else the fallback; and the choice made."""
    if kind == "model" and path:
        try:
            return model_classifier(load_model(path)), "model"
        except Exception as problem:  # any reason the model cannot be read
            log.warning("no model at %s, using the word lists: %s", path, problem)
            return fallback, "lexicon"
    return fallback, "lexicon"


def optimum(df: DataFrame, model: PipelineModel, inverse_regularisation: float = INVERSE_REGULARISATION) -> DataFrame:
    """How near a model is to the optimum of its loss on the rows it was trained on (text, label).

    One row per class: label, weighted_rows and weighted_probability, which are equal there, and
    gradient, the largest partial derivative of C * sum(weight * loss) + |W|^2 / 2 in the class's
    coefficients, which is 0 there. Two vectors of the vocabulary's size per class come to the driver.
    """
    weights = F.broadcast(class_weights(df).select("label", "weight"))
    scored = model.transform(df.join(weights, "label"))
    scored = once(scored.select("label", "weight", "features", "probability"), _p=vector_to_array("probability"))
    fitted = next(s for s in model.stages if isinstance(s, LogisticRegressionModel))
    found = []
    for k in [r.label for r in df.select("label").distinct().orderBy("label").collect()]:
        is_class = (F.col("label") == k).cast("double")
        rest = F.col("weight") * (F.get("_p", F.lit(k)) - is_class)
        over, under = F.greatest(rest, F.lit(0.0)), F.greatest(-rest, F.lit(0.0))
        rows, chance, more, less = scored.agg(
            F.sum(F.col("weight") * is_class),
            F.sum(F.col("weight") * F.get("_p", F.lit(k))),
            Summarizer.metrics("sum").summary(F.col("features"), over)["sum"],
            Summarizer.metrics("sum").summary(F.col("features"), under)["sum"],
        ).first()
        slope = inverse_regularisation * (more.toArray() - less.toArray()) + fitted.coefficientMatrix.toArray()[k]
        found.append((k, float(rows), float(chance), float(abs(slope).max())))
    schema = "label int, weighted_rows double, weighted_probability double, gradient double"
    return df.sparkSession.createDataFrame(found, schema)


def mean_features(df: DataFrame, model: PipelineModel) -> list[float]:
    """Mean feature vector: the point of comparison for explanations."""
    features = PipelineModel(model.stages[:-1])
    return list(features.transform(df.select("text")).select(Summarizer.mean(F.col("features"))).first()[0])


def term_table(spark: SparkSession, model: PipelineModel, means: list[float]) -> DataFrame:
    """One row per term of the model: idf, mean and one coefficient per class.

    It has as many rows as the vocabulary, at most MAX_TERMS unless the model was made otherwise.
    """
    counter = next(s for s in model.stages if isinstance(s, CountVectorizerModel))
    scaler = next(s for s in model.stages if isinstance(s, ElementwiseProduct))
    regression = next(s for s in model.stages if isinstance(s, LogisticRegressionModel))
    matrix = regression.coefficientMatrix.toArray()
    schema = T.StructType(
        [
            T.StructField("term", T.StringType()),
            T.StructField("idf", T.DoubleType()),
            T.StructField("mean", T.DoubleType()),
            T.StructField("coefficients", T.ArrayType(T.DoubleType())),
        ]
    )
    rows = [
        (term, float(scale), float(mean), [float(x) for x in matrix[:, i]])
        for i, (term, scale, mean) in enumerate(zip(counter.vocabulary, scaler.getScalingVec(), means))
    ]
    return spark.createDataFrame(rows, schema)


def term_contributions(df: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(key, term, position, weight) for each known term of each text.

    The weight is the exact Shapley value of the term for the predicted class of a linear model
    with independent features, coefficient * (value - mean) (Lundberg and Lee, 2017). Terms that
    are not in the text have one too, -coefficient * mean; they are not listed. A label the model
    does not know is explained as class 0.
    """
    known = F.greatest(F.array_position(F.array(*map(F.lit, LABEL_NAMES)), F.col("predicted_sentiment")), F.lit(1))
    found = (
        with_terms(df.select(key, "text", known.alias("_class")), "_all")
        .select(key, "_class", F.posexplode("_all").alias("position", "term"))
        .join(F.broadcast(terms), "term")
        .groupBy(key, "_class", "term", "idf", "mean", "coefficients")
        .agg(F.count(F.lit(1)).alias("_tf"), F.min("position").alias("position"))
    )
    raw = F.col("_tf") * F.col("idf")
    length = F.sqrt(F.sum(raw * raw).over(Window.partitionBy(key)))
    coefficient = F.element_at("coefficients", F.col("_class").cast("int"))
    return found.withColumn("value", raw / length).select(
        key,
        "term",
        "position",
        (coefficient * (F.col("value") - F.col("mean"))).alias("weight"),
        (coefficient * F.col("mean")).alias("expected"),
    )


def explanation_gaps(df: DataFrame, model: PipelineModel, terms: DataFrame, key: str) -> DataFrame:
    """(key, gap): score of the predicted class minus all that its explanation adds up to.

    That is the class's score at the mean features, the contributions of the terms in the text and those
    of all other terms. The gap is 0 but for rounding.
    """
    fitted = next(s for s in model.stages if isinstance(s, LogisticRegressionModel))
    raw = model.transform(df).select(
        key, "text", F.col("prediction").cast("int").alias("_k"), vector_to_array("rawPrediction").alias("_raw")
    )
    raw = raw.withColumn("predicted_sentiment", label_name(F.col("_k")))
    classes = range(len(fitted.interceptVector))
    # One row of sums over the vocabulary.
    at_mean = terms.agg(*[F.sum(F.get("coefficients", F.lit(k)) * F.col("mean")) for k in classes]).first()
    own = (
        term_contributions(raw, terms, key)
        .groupBy(key)
        .agg(F.sum("weight").alias("_own"), F.sum("expected").alias("_expected"))
    )
    constant = lambda values: F.get(F.array(*[F.lit(float(x)) for x in values]), F.col("_k"))
    zero, mean_part = F.lit(0.0), constant(at_mean)
    absent = F.coalesce("_expected", zero) - mean_part
    total = constant(fitted.interceptVector) + mean_part + F.coalesce("_own", zero) + absent
    return raw.join(own, key, "left").select(key, (F.get("_raw", F.col("_k")) - total).alias("gap"))


def explain_with_model(scored: DataFrame, terms: DataFrame, key: str, limit: int = TOP_TOKENS) -> DataFrame:
    """Add the strongest contributions of each flagged row; others get null.

    Only flagged rows are taken apart. A text's own terms are all that meets in one group.
    """
    flagged = scored.filter("is_flagged").select(key, "text", "predicted_sentiment")
    order = Window.partitionBy(key).orderBy(F.desc(F.abs("weight")), "position")
    top = (
        term_contributions(flagged, terms, key)
        .withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") <= limit)
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("_place", F.col("term").alias("token"), "weight"))).alias("_top"))
        .select(
            key,
            F.transform("_top", lambda x: F.struct(x["token"].alias("token"), x["weight"].alias("weight")))
            .cast(CONTRIBUTIONS)
            .alias("_explanation"),
        )
    )
    empty = F.array().cast(CONTRIBUTIONS)
    return (
        scored.join(top, key, "left")
        .withColumn("explanation", F.when(F.col("is_flagged"), F.coalesce("_explanation", empty)))
        .withColumn("explanation_method", F.when(F.col("is_flagged"), "linear_shapley"))
        .drop("_explanation")
    )
