import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from starcheck.operators import evaluate, train
from starcheck.operators.features import corpus_weights, fit_features, vocabulary
from starcheck.operators.mismatch import lexicon_classifier, score_mismatch
from starcheck.plans.training import split_frames, train_and_compare
from review_generator import generate_reviews


@pytest.fixture(scope="module")
def frames(spark):
    return split_frames(generate_reviews(spark, 1500))


@pytest.fixture(scope="module")
def model(frames):
    return train.train_classifier(frames[0])


def test_vocabulary_order_and_limits(spark):
    df = spark.createDataFrame([("bb aa bb cc",), ("aa bb dd dd",), ("ee",)], "text string")
    found = [(r.term, r.df, r.total) for r in vocabulary(df).collect()]
    assert found == [("bb", 2, 3), ("aa", 2, 2), ("aa bb", 2, 2)]
    assert [r.term for r in vocabulary(df, max_terms=2, min_texts=1).collect()] == ["bb", "aa"]


def test_pipeline_features_equal_long_form(spark):
    df = spark.createDataFrame([(0, "Bb aa bb, cc"), (1, "aa bb dd dd"), (2, "ee x")], "id long, text string")
    long_form = {(r.id, r.term): r.weight for r in corpus_weights(df, "id").collect()}
    features = fit_features(df)
    names = features.stages[3].vocabulary
    for row in features.transform(df).collect():
        for i, x in zip(row.features.indices, row.features.values):
            assert long_form.pop((row.id, names[i])) == pytest.approx(x)
    assert not long_form


def test_model_beats_the_prior(frames, model):
    found = evaluate.metrics(train.predict(frames[1], model)).first()
    assert found.accuracy > 0.8 and found.f1_macro > 0.8


def test_optimum_of_the_penalised_loss(frames, model):
    """The gradient of C * sum(w * loss) + |W|^2 / 2 is nil at the fitted coefficients."""
    rows = frames[0]
    weights = {r.label: r.weight for r in evaluate.class_weights(rows).collect()}
    data = PipelineModel(model.stages[:-1]).transform(rows).select("label", "features").collect()
    fitted = next(s for s in model.stages if isinstance(s, LogisticRegressionModel))
    w = fitted.coefficientMatrix.toArray()
    x = np.stack([r.features.toArray() for r in data])
    y = np.array([r.label for r in data])
    scores = x @ w.T + fitted.interceptVector.toArray()
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    gradient = ((p - np.eye(3)[y]) * np.array([weights[k] for k in y])[:, None]).T @ x + w
    assert np.abs(gradient).max() < 0.05


def test_saved_model_predicts_the_same(spark, frames, model, tmp_path):
    train.save_model(model, str(tmp_path / "m"))
    back = train.load_model(str(tmp_path / "m"))
    first = {r.review_id: (r.prediction, r.confidence) for r in train.predict(frames[1], model).collect()}
    assert first == {r.review_id: (r.prediction, r.confidence) for r in train.predict(frames[1], back).collect()}
    _, choice = train.choose_classifier("model", str(tmp_path / "m"), lexicon_classifier)
    assert choice == "model"
    for path in (None, str(tmp_path / "none")):
        assert train.choose_classifier("model", path, lexicon_classifier) == (lexicon_classifier, "lexicon")


def test_contributions_add_up(spark, frames, model):
    """Contributions of present and absent terms sum to the score minus that of the mean."""
    rows, held_out = frames
    means = train.mean_features(rows, model)
    terms = train.term_table(spark, model, means)
    sample = held_out.orderBy("review_id").limit(20)
    labelled = train.predict(sample, model).withColumn(
        "predicted_sentiment", F.element_at(F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive")), F.col("prediction") + 1)
    )
    parts = train.term_contributions(labelled, terms, "review_id").collect()
    fitted = next(s for s in model.stages if isinstance(s, LogisticRegressionModel))
    w, names = fitted.coefficientMatrix.toArray(), model.stages[3].vocabulary
    at = {t: i for i, t in enumerate(names)}
    features = {r.review_id: r.features.toArray() for r in PipelineModel(model.stages[:-1]).transform(sample).collect()}
    for row in labelled.collect():
        own = {p.term: p.weight for p in parts if p.review_id == row.review_id}
        absent = -sum(w[row.prediction][i] * means[i] for t, i in at.items() if t not in own)
        expected = w[row.prediction] @ (features[row.review_id] - np.array(means))
        assert sum(own.values()) + absent == pytest.approx(expected, abs=1e-9)


def test_model_explanations(spark, frames, model):
    rows = generate_reviews(spark, 300)
    scored = score_mismatch(rows, train.model_classifier(model))
    terms = train.term_table(spark, model, train.mean_features(frames[0], model))
    found = train.explain_with_model(scored, terms, "review_id").collect()
    assert len(found) == 300 and any(r.is_flagged for r in found)
    for row in found:
        assert (row.explanation is not None) == row.is_flagged == (row.explanation_method == "linear_shapley")
        if row.is_flagged:
            sizes = [abs(t.weight) for t in row.explanation]
            assert len(sizes) <= 8 and sizes == sorted(sizes, reverse=True)


def test_macro_f1_counts_labels_seen_on_either_side(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, prediction int")
    row = evaluate.metrics(df).first()
    assert row.accuracy == 0.5
    assert row.f1_macro == pytest.approx((2 / 3 + 0.5 + 0) / 3)


def test_train_and_compare(spark, tmp_path):
    table = train_and_compare(
        generate_reviews(spark, 400), str(tmp_path / "runs"), "e", {"all": {}, "few": {"max_terms": 10}}
    ).collect()
    assert {r.run for r in table} == {"all", "few"}
    assert table[0].f1_macro >= table[1].f1_macro and all(r.latency_ms > 0 for r in table)


def test_candidates_share_features(spark, tmp_path, monkeypatch):
    """Terms are counted once for all candidates that use the same ones."""
    from starcheck.plans import training

    fitted = []
    before = training.fit_features
    monkeypatch.setattr(training, "fit_features", lambda df, *wanted: fitted.append(wanted) or before(df, *wanted))
    words = ["good", "bad", "plain"]
    rows = [(k, f"{words[k % 3]} thing {k % 4}", k % 3) for k in range(24)]
    df = spark.createDataFrame(rows, "review_id long, text string, label int")
    tight = {"inverse_regularisation": 0.01}
    candidates = {"a": {}, "b": {"max_terms": 5}, "c": tight}
    candidates = {name: {**settings, "max_iterations": 2} for name, settings in candidates.items()}
    table = training.compare(df, df, str(tmp_path / "runs"), "x", candidates)
    assert {r["run"] for r in table.collect()} == {"a", "b", "c"}
    assert fitted == [(20_000, 2), (5, 2)]


def test_candidates_are_trained_to_the_end(spark, tmp_path, monkeypatch):
    """No candidate of the query stops before the iterations that train_classifier() has by default."""
    from starcheck.plans import catalog, training

    docs = [(k, f"{['good', 'bad', 'plain'][k % 3]} thing {['old', 'new', 'big', 'red'][k % 4]}") for k in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, int(k % 3 > 0), int(k % 3 == 1)) for k in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    limits = []
    before = training.train_classifier

    def train_and_look(*args, **settings):
        model = before(*args, **settings)
        limits.append(model.stages[-1].getMaxIter())
        return model

    monkeypatch.setattr(training, "train_classifier", train_and_look)
    table = catalog.train_and_compare_models(spark, str(tmp_path)).collect()
    assert len(table) == 3 and all(r["is_sound"] and r["texts"] == 12 for r in table)
    assert limits == [train.MAX_ITERATIONS] * 3
