"""TF-IDF over words and word pairs: of a whole corpus, and as features with one vocabulary for the training set."""

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starcheck.functions.once import once
from starcheck.functions.text import terms
from starcheck.operators.corpus_pieces import weigh_corpus
from starcheck.operators.term_counts import frequent_terms
from starcheck.session import cut

# Size of the vocabulary and texts a term must occur in.
MAX_TERMS = 20_000
MIN_TEXTS = 2


def with_terms(df: DataFrame, name: str) -> DataFrame:
    """Add an array of all terms of the text, then all pairs of neighbouring terms."""
    words = F.col("_words")
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    joined = F.zip_with(
        F.slice(words, F.lit(1), pairs),
        F.slice(words, F.lit(2), pairs),
        lambda first, second: F.concat_ws(" ", first, second),
    )
    split = once(df, _words=terms(F.col("text")))
    return once(split, **{name: F.concat(words, joined)}).drop("_words")


def vocabulary(df: DataFrame, max_terms: int = MAX_TERMS, min_texts: int = MIN_TEXTS) -> DataFrame:
    """(term, df, total): the most frequent terms, ties in alphabetical order."""
    return (
        frequent_terms(df.select("text"), max_terms, min_texts)
        .filter(F.col("df") >= min_texts)
        .orderBy(F.desc("total"), "term")
        .limit(max_terms)
    )


def idf(n: Column, df: Column) -> Column:
    return F.ln((1.0 + n) / (1.0 + df)) + 1.0


def corpus_weights(df: DataFrame, key: str, min_texts: int = MIN_TEXTS) -> DataFrame:
    """(key, term, weight): unit-length TF-IDF of every text over all terms that min_texts texts have.

    A text whose key no other row has is weighed where it is; rows that share a key count as one text and meet by
    key and term.
    """
    n = df.agg(F.count(F.lit(1))).scalar()
    twice = cut(df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select("_key"))
    rows = df.select(key, "text", F.lit(False).alias("_shared"))
    if twice.isEmpty():
        return weigh_corpus(rows, key, lambda found: idf(n, found), min_texts).select(key, "term", "weight")
    marked = df.select(key, "text").join(twice.withColumn("_found", F.lit(True)), df[key].eqNullSafe(twice["_key"]), "left")
    rows = marked.select(key, "text", F.coalesce("_found", F.lit(False)).alias("_shared"))
    weighed = cut(weigh_corpus(rows, key, lambda found: idf(n, found), min_texts))
    alone = weighed.filter(~F.col("_shared")).select(key, "term", "weight")
    counted = weighed.filter("_shared").groupBy(key, "term", "idf").agg(F.sum("tf").alias("tf"))
    raw = F.col("tf") * F.col("idf")
    length = F.sqrt(F.sum(raw * raw).over(Window.partitionBy(key)))
    return alone.unionByName(counted.select(key, "term", (raw / length).alias("weight")))


def fit_features(df: DataFrame, max_terms: int = MAX_TERMS, min_texts: int = MIN_TEXTS) -> PipelineModel:
    """A pipeline from text to unit-length TF-IDF vectors.

    Only the vocabulary, at most max_terms terms, comes to the driver.
    """
    n = df.count()
    rows = vocabulary(df, max_terms, min_texts).withColumn("idf", idf(F.lit(n), F.col("df"))).collect()
    if not rows:
        raise ValueError("no term occurs in enough texts")
    counter = CountVectorizerModel.from_vocabulary(
        [row["term"] for row in rows], inputCol="_all_terms", outputCol="_counts"
    )
    return PipelineModel(
        [
            RegexTokenizer(
                inputCol="text", outputCol="_words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False
            ),
            NGram(n=2, inputCol="_words", outputCol="_pairs"),
            SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _all_terms FROM __THIS__"),
            counter,
            ElementwiseProduct(
                scalingVec=Vectors.dense([row["idf"] for row in rows]), inputCol="_counts", outputCol="_scaled"
            ),
            Normalizer(p=2.0, inputCol="_scaled", outputCol="features"),
            SQLTransformer(
                statement="SELECT * EXCEPT (_words, _pairs, _all_terms, _counts, _scaled) FROM __THIS__"
            ),
        ]
    )
