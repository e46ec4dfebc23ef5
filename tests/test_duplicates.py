import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from starcheck.operators.components import connected_components
from starcheck.operators.duplicates import (
    cluster_arrays,
    cluster_summary,
    flag_map,
    text_clusters,
    vector_clusters,
    vector_neighbour_counts,
)
from starcheck.operators.positions import with_position
from starcheck.operators.skew import lookup_join


def dbscan(near: np.ndarray, min_samples: int) -> list[int]:
    """Labels by definition: -1 for noise, clusters numbered by their lowest core."""
    n = len(near)
    core = [near[i].sum() >= min_samples for i in range(n)]
    labels, number = [-1] * n, 0
    for i in range(n):
        if core[i] and labels[i] == -1:
            todo, labels[i] = [i], number
            while todo:
                for k in np.nonzero(near[todo.pop()])[0]:
                    if labels[k] == -1:
                        labels[k] = number
                        if core[k]:
                            todo.append(k)
            number += 1
    return labels


def tfidf_near(texts: list[str], eps: float) -> np.ndarray:
    bags = [Counter(re.findall(r"\w\w+", t.lower())) for t in texts]
    df = Counter(term for bag in bags for term in bag)
    vectors = []
    for bag in bags:
        raw = {t: c * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, c in bag.items()}
        length = math.sqrt(sum(w * w for w in raw.values()))
        vectors.append({t: w / length for t, w in raw.items()})
    near = np.eye(len(texts), dtype=bool)
    for i, a in enumerate(vectors):
        for j, b in enumerate(vectors):
            if i != j:
                near[i, j] = 1 - sum(w * b.get(t, 0) for t, w in a.items()) <= eps
    return near


def batch(spark, texts, number=0):
    rows = [(number, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "batch_id long, review_index long, text string")


def labels_of(members, n):
    found = {r.review_index: r.cluster_id for r in members.collect()}
    return [found.get(i, -1) for i in range(n)]


def near_copies(seed: int, size: int) -> list[str]:
    """Groups of texts that differ in a few words, exact copies, lone texts and empty ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    bases = [[rng.choice(words) for _ in range(12)] for _ in range(4)]
    texts = []
    for _ in range(size):
        kind = rng.random()
        text = list(rng.choice(bases[:1] if kind < 0.4 else bases))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            text[rng.randrange(12)] = rng.choice(words)
        if kind > 0.85:
            text = [rng.choice(words) for _ in range(rng.choice([1, 3, 8]))]
        texts.append(" ".join(text) if kind < 0.97 else "! ?")
    return texts


@pytest.mark.parametrize(
    "min_samples,eps,big_bucket,block",
    [(2, 0.25, 500, 1000), (2, 0.25, 3, 4), (3, 0.3, 3, 4), (4, 0.2, 5, 3), (5, 0.3, 500, 1000)],
)
def test_text_clusters_equal_brute_force(spark, min_samples, eps, big_bucket, block):
    texts = near_copies(min_samples, 70)
    expected = dbscan(tfidf_near(texts, eps), min_samples)
    members = text_clusters(batch(spark, texts), eps, min_samples, big_bucket, block)
    assert labels_of(members, len(texts)) == expected
    assert max(expected) >= 1


def test_batches_do_not_mix(spark):
    first, second = near_copies(11, 20), near_copies(12, 25)
    both = batch(spark, first, 0).unionByName(batch(spark, second, 1))
    members = text_clusters(both, 0.3).collect()
    for number, texts in ((0, first), (1, second)):
        found = {r.review_index: r.cluster_id for r in members if r.batch_id == number}
        assert [found.get(i, -1) for i in range(len(texts))] == dbscan(tfidf_near(texts, 0.3), 2)


TEMPLATED = [
    "Bought two of these blue ladders for the barn, climbed them all winter and never slipped once, hands down",
    "Bought two of these blue teapots for the barn, climbed them all winter and never slipped once, so far",
    "Bought two of these blue lanterns for the barn, climbed them all winter and never slipped once, honest",
]
DISTINCT = [
    "Water drips out below the handle whenever the kettle cools.",
    "My charger hums at night and smells of rubber.",
    "Soles grip wet stone well but laces fray within weeks.",
]


def test_templated_reviews_cluster(spark):
    docs = batch(spark, TEMPLATED + DISTINCT[:2])
    expected = dbscan(tfidf_near(TEMPLATED + DISTINCT[:2], 0.55), 2)
    members = text_clusters(docs, 0.55)
    assert labels_of(members, 5) == expected and 0 in expected
    head = cluster_summary(members, docs).first()
    assert head.size == expected.count(0) and head.representative_text == docs.filter(f"review_index = {expected.index(0)}").first().text


def test_distinct_and_single_reviews_do_not(spark):
    assert text_clusters(batch(spark, DISTINCT), 0.55).isEmpty()
    assert text_clusters(batch(spark, ["just one review here"]), 0.55).isEmpty()


def test_flag_map_and_arrays(spark):
    texts = ["same words here", "nothing alike at all", "same words here", "here words SAME", "??", "??"]
    docs = batch(spark, texts)
    members = text_clusters(docs)
    flags = {r.review_index: (r.cluster_id, r.is_duplicate) for r in flag_map(docs, members).collect()}
    assert flags == {i: (0, True) if i in (0, 2, 3) else (None, False) for i in range(6)}
    arrays = cluster_arrays(members, cluster_summary(members, docs), rows_per_array=3).orderBy("part").collect()
    assert [(r.part, r.review_indices, r.size) for r in arrays] == [(0, [0, 2], 3), (1, [3], 3)]


def test_a_group_of_copies_may_hold_most_rows(spark):
    copies = spark.range(0, 3000).select(
        F.lit(0).cast("long").alias("batch_id"),
        F.col("id").alias("review_index"),
        F.when(F.col("id") % 3 > 0, "the same old text again and again")
        .otherwise(F.concat(F.lit("text number t"), F.col("id")))
        .alias("text"),
    )
    members = text_clusters(copies, 0.15)
    assert members.filter("review_index % 3 > 0").select("cluster_id").distinct().count() == 1
    assert members.filter("review_index % 3 > 0").count() == 2000


def test_a_large_group_gives_few_links(spark):
    """Near copies in several blocks, each with a word of its own: links grow with the texts, not with their pairs."""
    from starcheck.operators.text_links import distinct_items, signatures, term_vectors, text_links
    from starcheck.session import Scratch

    common = " ".join(f"word{k}" for k in range(40))
    docs = batch(spark, [f"{common} own{i}x" for i in range(200)] + ["nothing like it", "another word0"])
    scratch = Scratch(spark, "test-links")
    items = scratch.write(distinct_items(signatures(docs)), "items")
    links = text_links(term_vectors(docs, items, scratch), items, 0.5, 2, scratch, block=32)
    assert links.select("a", "c").distinct().count() == links.count() < 3000
    members = text_clusters(docs, 0.5, block=32)
    assert labels_of(members, 202) == [0] * 200 + [-1, -1]


def test_components(spark):
    rng = random.Random(5)
    edges = [(0, i, i + 1) for i in range(60)]
    edges += [(0, rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    edges += [(1, 500, i) for i in range(501, 560)]
    rng.shuffle(edges)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for b, u, v in edges:
        a, c = sorted([find((b, u)), find((b, v))])
        root[c] = a
    df = spark.createDataFrame(edges, "batch_id long, u long, v long")
    found = {(r.batch_id, r.node): r.root for r in connected_components(df).collect()}
    linked = {(b, x) for b, u, v in edges if u != v for x in (u, v)}
    assert found == {node: find(node)[1] for node in linked}


@pytest.mark.parametrize("min_samples,eps", [(2, 0.1), (3, 0.1), (4, 0.2)])
def test_vector_clusters_equal_brute_force(spark, min_samples, eps, monkeypatch):
    import starcheck.operators.vector_links as links

    monkeypatch.setattr(links.VectorNeighbours.__init__, "__defaults__", (5, 16))
    rng = np.random.default_rng(min_samples)
    centres = rng.normal(size=(6, 8))
    points = centres[rng.integers(0, 6, 90)] + 0.35 * rng.normal(size=(90, 8))
    points[10], points[11] = points[9], 0
    points = points.astype(np.float32).astype(float)
    length = np.linalg.norm(points, axis=1)
    unit = points / np.where(length == 0, 1, length)[:, None]
    near = 1 - unit @ unit.T <= eps
    np.fill_diagonal(near, True)
    df = spark.createDataFrame(
        [(0, i, [float(x) for x in p]) for i, p in enumerate(points)],
        "batch_id long, review_index long, embedding array<float>",
    )
    assert labels_of(vector_clusters(df, eps, min_samples), 90) == dbscan(near, min_samples)
    counts = {r.review_index: r.near for r in vector_neighbour_counts(df, eps).collect()}
    assert counts == {i: int(near[i].sum()) - 1 for i in range(90) if i != 11}


def test_position_gives_the_index(spark):
    df = spark.createDataFrame([(1, 30), (1, 10), (2, 5)], "batch_id long, review_id long")
    rows = with_position(df, ["batch_id"], "review_id", "review_index").collect()
    assert {(r.review_id, r.review_index) for r in rows} == {(30, 1), (10, 0), (5, 0)}


def test_hub_is_cut_in_parts(spark):
    """A star and a chain hanging on it, with parts of few edges."""
    star = [(0, 5000 + k, 0) for k in range(400)] + [(0, 0, 1), (0, 2, 1), (0, 9000, 9001)]
    edges = spark.createDataFrame(star, "batch_id long, u long, v long")
    found = {r.node: r.root for r in connected_components(edges, rows_per_task=20).collect()}
    assert found.pop(9000) == found.pop(9001) == 9000
    assert len(found) == 403 and set(found.values()) == {0}


def test_hub_of_many_edges_leaves_no_large_task(spark):
    edges = spark.range(1, 300_001).select(F.lit(0).alias("key"), "id")
    counts = edges.groupBy("key").agg(F.count("*").alias("n"))
    joined = lookup_join(edges, counts, ["key"], "id", "n", rows_per_task=20_000)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "64",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(sizes) == 300_000 and max(sizes) < 150_000


def test_a_small_batch_is_clustered_in_its_task(spark):
    """Weights, links and clusters of small batches come out as with every batch in blocks."""
    draw = random.Random(11)
    words = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(160):
        text = [draw.choice(words) for _ in range(draw.randrange(9))]
        if rows and draw.random() < 0.6:
            text = (draw.choice(rows)[2] or "").split()
            if text and draw.random() < 0.5:
                text[draw.randrange(len(text))] = draw.choice(words)
        rows.append((k % 7, k, " ".join(text)))
    rows += [(3, None, "w1 w2 w3"), (None, 5, "w1 w2 w3"), (9, 1, None), (9, 2, "")]
    docs = spark.createDataFrame(rows, "batch_id long, review_index long, text string")
    seen = []
    from starcheck.operators import duplicates

    before = duplicates.text_links
    duplicates.text_links = lambda *args: seen.append(1) or before(*args)
    try:
        for eps, min_samples in [(0.4, 2), (0.5, 3)]:
            seen.clear()
            in_task = {tuple(r) for r in duplicates.text_clusters(docs, eps, min_samples).collect()}
            assert not seen
            in_blocks = {tuple(r) for r in duplicates.text_clusters(docs, eps, min_samples, block=16).collect()}
            assert seen
            assert in_task == in_blocks and len(in_task) > 20
    finally:
        duplicates.text_links = before
