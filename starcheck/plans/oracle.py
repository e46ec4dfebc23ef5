"""The expected result of each query as plain SQL over the given tables, run by DuckDB.

These statements share no code with the operators: sentiment is counted from all words of a text
instead of a pattern of listed ones, rounding is left to printf, distances come from all pairs,
and components from a recursive query. They are only meant for small data.
"""

from starcheck.functions.lexicon import NEGATIVE, POSITIVE
from starcheck.sources import derived
from starcheck.sources.batch_answer import ROWS_PER_PART


def _values(items: list) -> str:
    return ", ".join("('" + text.replace("'", "''") + "')" for text in items)


def _words(items: list[str]) -> str:
    return ", ".join(f"'{word}'" for word in items)


def _numbered(name: str, column: str, items: list[str]) -> str:
    rows = ", ".join(f"({k}, '" + text.replace("'", "''") + "')" for k, text in enumerate(items))
    return f"{name}(k, {column}) AS (VALUES {rows})"


LISTS = ",\n".join(
    [
        _numbered("pos", "txt", derived.POSITIVE),
        _numbered("neg", "txt", derived.NEGATIVE),
        _numbered("neu", "txt", derived.NEUTRAL),
        _numbered("tpl", "txt", derived.TEMPLATES),
        _numbered("cat", "category", derived.CATEGORIES),
        _numbered("noun", "n", derived.NOUNS),
        _numbered("fill", "f", derived.FILLERS),
    ]
)

REVIEWS = f"""{LISTS},
base AS (
  SELECT o_orderkey AS id, o_orderkey % 25 AS m,
         CAST(floor(o_orderkey / 25.0) AS BIGINT) AS q,
         CAST(floor(o_orderkey / 500.0) AS BIGINT) AS batch_id
  FROM orders),
kinds AS (
  SELECT id, batch_id, m, q,
    CASE WHEN m < 3 THEN 'mismatch' WHEN m < 5 THEN 'templated' ELSE 'genuine' END AS kind,
    CASE WHEN m < 3 THEN CASE WHEN q % 2 = 0 THEN 'negative' ELSE 'positive' END
         WHEN m < 5 THEN 'positive'
         ELSE CASE (q + m) % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END
    END AS true_sentiment,
    (id * 7919 + 11) % 10007 % 6 AS s_k, (id * 6271 + 5) % 10009 % 8 AS c_k,
    (id * 4783 + 3) % 10037 % 2 AS t_k, (id * 3571 + 7) % 10039 % 5 AS n_k,
    (id * 2903 + 1) % 10061 % 4 AS f_k
  FROM base),
reviews AS (
  SELECT id AS review_id, batch_id, category AS product_category,
    CAST(CASE WHEN kind = 'templated' THEN 5
         WHEN true_sentiment = 'neutral' THEN 3
         WHEN (true_sentiment = 'positive') = (kind = 'genuine') THEN 4 + (q + m) % 2
         ELSE 1 + (q + m) % 2 END AS INT) AS rating,
    CASE WHEN kind = 'templated' THEN replace(replace(tpl.txt, '{{n}}', n), '{{f}}', f)
         ELSE concat(CASE true_sentiment WHEN 'positive' THEN pos.txt WHEN 'negative' THEN neg.txt ELSE neu.txt END,
                     ' (', category, ')') END AS text,
    true_sentiment, kind = 'mismatch' AS is_mismatch, kind = 'templated' AS is_templated_fake
  FROM kinds
  JOIN pos ON pos.k = s_k JOIN neg ON neg.k = s_k JOIN neu ON neu.k = s_k
  JOIN cat ON cat.k = c_k JOIN tpl ON tpl.k = t_k JOIN noun ON noun.k = n_k JOIN fill ON fill.k = f_k)"""

SPACES = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def _clean(text: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace({text}, 'http[^{SPACES}]+', ' ', 'g'),"
        f" '[{SPACES}]+', ' ', 'g'))"
    )


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '\A[{SPACES}]+|[{SPACES}]+\z', '', 'g')"


def _half_even(x: str, digits: int) -> str:
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


LABEL = "CASE WHEN rating <= 2 THEN 0 WHEN rating = 3 THEN 1 WHEN rating IS NOT NULL THEN 2 END"


def _scored(source: str = "reviews") -> str:
    """CTEs words .. scored over a relation with rating and text."""
    return f"""words AS (SELECT *, regexp_extract_all(lower(text), '[a-z'']+') AS ws FROM {source}),
counts AS (
  SELECT *, len(list_filter(ws, lambda w: w IN ({_words(POSITIVE)}))) AS p,
         len(list_filter(ws, lambda w: w IN ({_words(NEGATIVE)}))) AS n FROM words),
sentiment AS (
  SELECT *, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS predicted_sentiment,
         CASE WHEN p = n THEN 5e-1 ELSE least(5e-1 + 5e-1 * abs(p - n) / (p + n), 99e-2) END AS confidence
  FROM counts),
ranges(name, low, high) AS (VALUES ('negative', 1, 2), ('neutral', 2, 4), ('positive', 4, 5)),
distances AS (
  SELECT *, CASE WHEN rating >= low AND rating <= high THEN 0e0
                 ELSE least(abs(rating - low), abs(rating - high)) / 4e0 END AS distance
  FROM sentiment JOIN ranges ON name = predicted_sentiment),
scores AS (
  SELECT *, {_half_even('distance * confidence', 3)} AS mismatch_score,
         {_half_even('confidence', 3)} AS sentiment_confidence FROM distances),
scored AS (
  SELECT *, mismatch_score >= 35e-2 AS is_flagged,
    CASE WHEN distance = 0 THEN printf('text sentiment (%s) is consistent with a %d-star rating', predicted_sentiment, rating)
         ELSE printf('text reads as %s (confidence %.2f) but rating is %d stars - expected sentiment for that rating range is different',
                     predicted_sentiment, confidence, rating) END AS reason
  FROM scores)"""


SCORED = f"{REVIEWS},\n{_scored()}"

REQUESTS = f"""{REVIEWS},
slots AS (
  SELECT review_id AS batch_id, s.slot AS review_index, CAST((rating + 3 * s.slot) % 8 AS INT) AS rating,
    CASE WHEN s.slot = 1 AND review_id % 5 = 0 THEN ''
         WHEN s.slot = 2 AND review_id % 7 = 0 THEN '   ' ELSE text END AS text,
    CASE s.slot WHEN 0 THEN 'r' || review_id WHEN 2 THEN 'r' || review_id || '-c' END AS review_id
  FROM reviews JOIN (VALUES (0), (1), (2)) s(slot) ON s.slot < reviews.review_id % 4
  WHERE reviews.review_id % 97 <> 0)"""

EXPLAINED = """parts AS (
  SELECT review_id, predicted_sentiment, is_flagged,
         list_slice(list_filter(ws, lambda w: w IN ({all})), 1, 8) AS tokens FROM scored)""".format(
    all=_words(POSITIVE + NEGATIVE)
)

PREDICTED = f"""{SCORED},
predicted AS (
  SELECT *, {LABEL} AS label,
    CASE predicted_sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS prediction FROM scored)"""


def _f1(groups: str = "") -> str:
    """CTEs sides, classes: F1 per class (and group)."""
    group, by = (f"{groups}, ", f"{groups}, ") if groups else ("", "")
    return f"""sides AS (
  SELECT {group}label AS class, label = prediction AS hit FROM predicted
  UNION ALL SELECT {group}prediction, false FROM predicted),
classes AS (
  SELECT {group}class, 2e0 * count(*) FILTER (hit) / count(*) AS f1 FROM sides GROUP BY {by}class)"""


TERM = r"[\p{L}\p{N}_]{2,}"


def _vectors(docs: str) -> str:
    """CTEs docs .. vectors: unit TF-IDF weights within each batch."""
    return rf"""docs AS ({docs}),
tokens AS (SELECT b, i, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM docs),
tf AS (SELECT b, i, term, count(*) AS tf FROM tokens GROUP BY ALL),
df AS (SELECT b, term, count(*) AS df FROM tf GROUP BY ALL),
batch AS (SELECT b, count(*) AS n FROM docs GROUP BY b),
raw AS (
  SELECT tf.b, i, tf.term, tf.tf * (ln((1e0 + n) / (1e0 + df.df)) + 1) AS w
  FROM tf JOIN df ON tf.b = df.b AND tf.term = df.term JOIN batch ON batch.b = tf.b),
lengths AS (SELECT b, i, sqrt(sum(w * w)) AS l FROM raw GROUP BY ALL),
vectors AS (SELECT raw.b, raw.i, term, w / l AS w FROM raw JOIN lengths ON raw.b = lengths.b AND raw.i = lengths.i)"""


PAIRS = """pairs AS (
  SELECT x.b, x.i AS u, y.i AS v FROM vectors x JOIN vectors y ON x.b = y.b AND x.term = y.term AND x.i <> y.i
  GROUP BY ALL HAVING 1 - sum(x.w * y.w) <= 15e-2)"""

# With two rows to a neighbourhood every row that has a neighbour is a core.
CLUSTERS = """reach(b, i, r) AS (
  SELECT DISTINCT b, u, u FROM pairs
  UNION SELECT reach.b, pairs.v, reach.r FROM reach JOIN pairs ON pairs.b = reach.b AND pairs.u = reach.i),
roots AS (SELECT b, i, min(r) AS root FROM reach GROUP BY ALL),
members AS (SELECT b, i, CAST(dense_rank() OVER (PARTITION BY b ORDER BY root) - 1 AS INT) AS cluster_id FROM roots)"""

DOC_CLUSTERS = f"""{_vectors('SELECT 0 AS b, doc_id AS i, text FROM documents')},
{PAIRS},
{CLUSTERS}"""

# Equal texts of a batch are compared once, then every row is counted.
BATCH_CLUSTERS = f"""docs AS (SELECT batch_id AS b, review_index AS i, text FROM placed),
tokens AS (SELECT b, i, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM docs),
tf AS (SELECT b, i, term, count(*) AS tf FROM tokens GROUP BY ALL),
df AS (SELECT b, term, count(*) AS df FROM tf GROUP BY ALL),
batch AS (SELECT b, count(*) AS n FROM docs GROUP BY b),
heads AS (SELECT b, text, min(i) AS head, count(*) AS copies FROM docs GROUP BY ALL),
raw AS (
  SELECT tf.b, i, tf.term, tf.tf * (ln((1e0 + n) / (1e0 + df.df)) + 1) AS w
  FROM tf JOIN heads ON heads.b = tf.b AND heads.head = tf.i
  JOIN df ON tf.b = df.b AND tf.term = df.term JOIN batch ON batch.b = tf.b),
lengths AS (SELECT b, i, sqrt(sum(w * w)) AS l FROM raw GROUP BY ALL),
vectors AS (SELECT raw.b, raw.i, term, w / l AS w FROM raw JOIN lengths ON raw.b = lengths.b AND raw.i = lengths.i),
pairs AS (
  SELECT x.b, x.i AS u, y.i AS v FROM vectors x JOIN vectors y ON x.b = y.b AND x.term = y.term AND x.i <> y.i
  GROUP BY ALL HAVING 1 - sum(x.w * y.w) <= 15e-2
  UNION ALL SELECT b, head, head FROM heads WHERE copies > 1),
reach(b, i, r) AS (
  SELECT DISTINCT b, u, u FROM pairs
  UNION SELECT reach.b, pairs.v, reach.r FROM reach JOIN pairs ON pairs.b = reach.b AND pairs.u = reach.i),
roots AS (SELECT b, i AS head, min(r) AS root FROM reach GROUP BY ALL),
head_clusters AS (SELECT b, head, CAST(dense_rank() OVER (PARTITION BY b ORDER BY root) - 1 AS INT) AS cluster_id FROM roots),
members AS (
  SELECT docs.b, docs.i, docs.text, cluster_id FROM docs
  JOIN heads ON heads.b = docs.b AND heads.text = docs.text
  JOIN head_clusters ON head_clusters.b = heads.b AND head_clusters.head = heads.head)"""

REVIEW_CLUSTERS = f"""{REVIEWS},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY review_id) - 1 AS review_index FROM reviews),
{BATCH_CLUSTERS}"""

# The whole stream is one batch.
STREAM_CLUSTERS = f"""{REVIEWS},
placed AS (
  SELECT CAST(0 AS BIGINT) AS batch_id, text, row_number() OVER (ORDER BY review_id) - 1 AS review_index FROM reviews),
{BATCH_CLUSTERS}"""

CONVERSATION_CLUSTERS = f"""placed AS (
  SELECT conv_id AS batch_id, turn AS review_index, conv_id || '-' || turn AS review_id,
    CAST(turn % 5 + 1 AS INT) AS rating, text
  FROM conversations WHERE length(text) BETWEEN 1 AND 5000),
{BATCH_CLUSTERS}"""

# Conversations batched by turn number: each batch holds one turn of every conversation.
TURN_CLUSTERS = f"""placed AS (
  SELECT turn AS batch_id, conv_id AS review_index, conv_id || '-' || turn AS review_id,
    CAST(turn % 5 + 1 AS INT) AS rating, text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND length(text) BETWEEN 1 AND 5000),
{BATCH_CLUSTERS}"""

CLUSTER_SUMMARY = """SELECT b AS batch_id, cluster_id, count(*) AS size, min(i) AS first_index,
  min_by(text, i) AS representative_text FROM members GROUP BY b, cluster_id"""

VECTOR_PAIRS = """near AS (
  SELECT x.vec_id AS u, y.vec_id AS v FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id
  WHERE 1 - list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) <= 6e-1)"""

SWEEP = """SELECT t AS threshold,
  round(CAST(count(*) FILTER (is_mismatch AND mismatch_score >= t) AS DOUBLE) / count(*) FILTER (is_mismatch), 6) AS recall,
  round(CAST(count(*) FILTER (NOT is_mismatch AND mismatch_score >= t) AS DOUBLE) / count(*) FILTER (NOT is_mismatch), 6)
    AS false_positive_rate
FROM {rows}, (VALUES (30e-2), (35e-2), (40e-2), (45e-2), (50e-2), (55e-2)) thresholds(t) GROUP BY t"""

SAMPLE = """chosen AS (
  SELECT *, row_number() OVER (PARTITION BY is_mismatch ORDER BY md5(review_id || ':1'), review_id) AS place
  FROM {rows} QUALIFY place <= 50)"""

REASONS = """CASE WHEN rating IS NULL THEN 'rating_missing'
  WHEN rating < 1 OR rating > 5 THEN 'rating_out_of_range'
  WHEN text IS NULL THEN 'text_missing'
  WHEN length(text) < 1 THEN 'text_too_short'
  WHEN length(text) > 5000 THEN 'text_too_long' {more} END"""

CORPUS = rf"""words AS (SELECT doc_id, regexp_extract_all(lower(text), '{TERM}') AS ws FROM documents),
grams AS (
  SELECT doc_id, unnest(ws) AS term FROM words
  UNION ALL
  SELECT doc_id, ws[k] || ' ' || ws[k + 1] FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS k FROM words)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
vocabulary AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2),
raw AS (
  SELECT doc_id, tf.term, tf * (ln((1e0 + (SELECT count(*) FROM documents)) / (1e0 + df)) + 1) AS w
  FROM tf JOIN vocabulary ON vocabulary.term = tf.term),
lengths AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM raw GROUP BY ALL)
SELECT term, count(*) AS texts, round(sum(w / l), 6) AS weight FROM raw JOIN lengths USING (doc_id) GROUP BY term"""

ANALYSIS = """SELECT review_id, rating, predicted_sentiment, sentiment_confidence, mismatch_score, is_flagged, reason,
  CASE WHEN is_flagged THEN 'lexicon_fallback' END AS explanation_method FROM scored"""

REVIEW_COLUMNS = "review_id, product_category, rating, text, true_sentiment, is_mismatch, is_templated_fake"

LABELLED = f"{REVIEWS}, labelled AS (SELECT *, {LABEL} AS label FROM (SELECT *, {_clean('text')} AS cleaned FROM reviews) WHERE length(cleaned) > 0)"

# Labelled documents, and the rows of each class that the split holds out.
DOCUMENT_SPLIT = f"""labelled AS (
  SELECT doc_id, CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END AS label
  FROM documents JOIN labels USING (doc_id) WHERE length({_clean('text')}) > 0),
counts AS (SELECT label, CAST(count(*) AS HUGEINT) AS n FROM labelled GROUP BY label),
totals AS (SELECT sum(n) AS total, sum(n) - CAST(ceil(sum(n) * 2e-1) AS HUGEINT) AS train FROM counts),
shares AS (SELECT label, n, n * train // total AS whole, n * train % total AS rest, train FROM counts, totals),
quotas AS (
  SELECT label, n, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= train - sum(whole) OVER () THEN 1 ELSE 0 END AS quota
  FROM shares),
split AS (
  SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || ':42'), doc_id) > quota AS is_held_out
  FROM labelled JOIN quotas USING (label))"""

ORACLES: dict[str, str] = {
    "scan_reviews": f"WITH {REVIEWS} SELECT batch_id, {REVIEW_COLUMNS} FROM reviews",
    "normalize_source": f"""SELECT row_number() OVER (ORDER BY doc_id) AS review_id, 'unknown' AS product_category,
  CASE WHEN quality = 0 THEN 1 ELSE 5 END AS rating, replace({_strip('text')}, chr(10), ' ') AS text,
  CAST(NULL AS VARCHAR) AS true_sentiment, CAST(NULL AS BOOLEAN) AS is_mismatch, CAST(NULL AS BOOLEAN) AS is_templated_fake
FROM documents JOIN labels USING (doc_id)""",
    "source_limit": f"WITH {REVIEWS} SELECT review_id, rating, text FROM reviews ORDER BY review_id LIMIT 10000",
    "roundtrip_csv": f"WITH {REVIEWS} SELECT {REVIEW_COLUMNS} FROM reviews",
    "review_flag_counts": f"""WITH {REVIEWS} SELECT count(*) AS reviews, count(*) FILTER (is_mismatch) AS mismatches,
  count(*) FILTER (is_templated_fake) AS templated_fakes FROM reviews""",
    "parse_requests": f"WITH {REQUESTS} SELECT batch_id, review_index, rating, text, review_id FROM slots",
    "emit_json": f"""WITH {SCORED}, {EXPLAINED}
SELECT review_id, reason, mismatch_score, CASE WHEN scored.is_flagged THEN tokens[1] END AS first_token,
  NOT scored.is_flagged AS has_null_explanation FROM scored JOIN parts USING (review_id)""",
    "run_comparison": f"""WITH {PREDICTED}, {_f1('product_category')},
f1s AS (SELECT product_category, avg(f1) AS f1_macro FROM classes GROUP BY ALL)
SELECT product_category AS run, 'lexicon' AS model_type,
  round(avg(CASE WHEN label = prediction THEN 1e0 ELSE 0e0 END), 6) AS accuracy,
  round(any_value(f1_macro), 6) AS f1_macro, CAST(NULL AS DOUBLE) AS latency_ms
FROM predicted JOIN f1s USING (product_category) GROUP BY product_category""",
    "clean_text": f"""WITH {REVIEWS}
SELECT 'document' AS origin, doc_id AS id, {_clean('text')} AS text FROM documents
UNION ALL SELECT 'review', review_id, {_clean('text')} FROM reviews""",
    "non_empty": f"""WITH {REQUESTS}
SELECT batch_id, review_index, rating, {_clean('text')} AS text, review_id FROM slots WHERE length({_clean('text')}) > 0""",
    "rating_label": f"WITH {REQUESTS} SELECT batch_id, review_index, rating, {LABEL} AS label FROM slots",
    "label_names": f"""WITH {REVIEWS},
named AS (SELECT review_id, {LABEL} AS label FROM reviews),
raws AS (
  SELECT *, CASE label WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS name FROM named)
SELECT review_id, label, name,
  CASE review_id % 4 WHEN 0 THEN 'LABEL_' || label WHEN 1 THEN upper(name) WHEN 2 THEN 'LABEL_7' ELSE 'Mixed' END AS raw,
  CASE review_id % 4 WHEN 0 THEN name WHEN 1 THEN name WHEN 2 THEN 'label_7' ELSE 'mixed' END AS parsed
FROM raws""",
    "validate_reviews": """SELECT doc_id, CAST(doc_id % 7 AS INT) AS rating, CAST(length(text) AS INT) AS characters FROM documents
WHERE doc_id % 7 BETWEEN 1 AND 5 AND length(text) BETWEEN 1 AND 5000""",
    "rejected_documents": f"""SELECT doc_id, {REASONS.format(more='')} AS reject_reason
FROM (SELECT doc_id, doc_id % 7 AS rating, text FROM documents) WHERE reject_reason IS NOT NULL""",
    "rejected_reviews": f"""WITH {REQUESTS}
SELECT batch_id, review_index, {REASONS.format(more="WHEN trim(text) = '' THEN 'text_blank'")} AS reject_reason
FROM slots WHERE reject_reason IS NOT NULL""",
    "reject_empty_batches": """SELECT o_orderkey AS batch_id,
  CASE WHEN o_orderkey % 97 = 0 THEN 'malformed_body' ELSE 'empty_batch' END AS reject_reason
FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 4 = 0""",
    "truth_split": f"""WITH {REVIEWS}
SELECT review_id, CASE WHEN is_mismatch THEN 'mismatch' ELSE 'clean' END AS side FROM reviews""",
    "pseudo_rating": """SELECT doc_id, 'amazon_polarity' AS source, CASE WHEN quality = 0 THEN 1 ELSE 5 END AS rating
FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT doc_id, 'yelp_review_full', CAST(doc_id % 5 + 1 AS INT) FROM documents""",
    "flatten_text": f"SELECT conv_id, turn, replace({_strip('text')}, chr(10), ' ') AS text FROM conversations",
    "load_and_clean": f"WITH {LABELLED} SELECT review_id, cleaned AS text, label FROM labelled",
    "lexicon_sentiment": f"WITH {SCORED} SELECT review_id, predicted_sentiment, confidence FROM sentiment",
    "lexicon_documents": f"""WITH {_scored('(SELECT doc_id, text, 3 AS rating FROM documents)')}
SELECT doc_id, CAST(p + n AS INT) AS hits, predicted_sentiment, confidence FROM sentiment""",
    "expected_range": f"WITH {SCORED} SELECT review_id, predicted_sentiment, low, high FROM distances",
    "mismatch_score": f"WITH {SCORED} SELECT review_id, distance, mismatch_score FROM scored",
    "flagged_reviews": f"""WITH {REVIEWS},
valid AS (
  SELECT review_id, rating, {_clean('text')} AS text FROM reviews
  WHERE rating BETWEEN 1 AND 5 AND length(text) BETWEEN 1 AND 5000),
{_scored('valid')}
SELECT review_id, rating, text, predicted_sentiment, sentiment_confidence, mismatch_score FROM scored WHERE is_flagged""",
    "mismatch_reason": f"WITH {SCORED} SELECT review_id, reason FROM scored",
    "score_batch": f"""WITH {SCORED} SELECT batch_id, review_id, rating, predicted_sentiment, sentiment_confidence,
  mismatch_score, is_flagged, reason FROM scored""",
    "threshold_sweep": f"WITH {SCORED} {SWEEP.format(rows='scored')}",
    "clean_fpr": f"""WITH {SCORED} SELECT count(*) AS clean_rows,
  round(avg(CASE WHEN is_flagged THEN 1e0 ELSE 0e0 END), 6) AS false_positive_rate FROM scored WHERE NOT is_mismatch""",
    "sample_per_class": f"WITH {REVIEWS}, {SAMPLE.format(rows='reviews')} SELECT review_id, is_mismatch FROM chosen",
    "sampled_sweep": f"WITH {SCORED}, {SAMPLE.format(rows='scored')} {SWEEP.format(rows='chosen')}",
    "verdicts": f"""WITH {SCORED} SELECT review_id, CASE WHEN is_flagged THEN 'Flagged' ELSE 'Verified' END AS word,
  CASE WHEN is_flagged THEN 'Mismatch detected' ELSE 'Consistent review' END AS heading,
  CASE WHEN is_flagged THEN 'The text and star rating tell different stories.'
       ELSE 'The text and star rating agree.' END AS sentence,
  CAST(floor(sentiment_confidence * 100 + 5e-1) AS INT) AS confidence_percent FROM scored""",
    "doc_tfidf": f"""WITH {_vectors('SELECT 0 AS b, doc_id AS i, text FROM documents')}
SELECT i AS doc_id, term, round(w, 6) AS weight FROM vectors""",
    "embedding_neighbours": f"""WITH {VECTOR_PAIRS}
SELECT vec_id, count(u) AS near FROM embeddings LEFT JOIN near ON u = vec_id GROUP BY vec_id""",
    "embedding_clusters": f"""WITH RECURSIVE {VECTOR_PAIRS}, pairs AS (SELECT 0 AS b, u, v FROM near), {CLUSTERS}
SELECT i AS vec_id, cluster_id, true AS is_core FROM members""",
    "dbscan_labels": f"WITH RECURSIVE {DOC_CLUSTERS} SELECT i AS doc_id, cluster_id, true AS is_core FROM members",
    "duplicate_clusters": f"""WITH RECURSIVE {REVIEW_CLUSTERS}
SELECT b AS batch_id, cluster_id, count(*) AS size, min(i) AS first_index, min_by(text, i) AS representative_text
FROM members GROUP BY b, cluster_id""",
    "duplicate_arrays": f"""WITH RECURSIVE {REVIEW_CLUSTERS}
SELECT b AS batch_id, cluster_id, CAST(0 AS BIGINT) AS part, string_agg(i, ',' ORDER BY i) AS review_indices,
  count(*) AS size, min_by(text, i) AS representative_text
FROM members GROUP BY b, cluster_id""",
    "duplicate_flag_map": f"""WITH RECURSIVE {DOC_CLUSTERS}
SELECT doc_id, cluster_id, cluster_id IS NOT NULL AS is_duplicate FROM documents LEFT JOIN members ON i = doc_id""",
    "lexicon_explain": f"""WITH {SCORED}, {EXPLAINED},
numbered AS (SELECT *, unnest(range(len(tokens))) AS position FROM parts WHERE is_flagged)
SELECT review_id, CAST(position AS INT) AS position, tokens[position + 1] AS token,
  CASE predicted_sentiment WHEN 'negative' THEN -1e0 WHEN 'positive' THEN 1e0
       ELSE CASE WHEN tokens[position + 1] IN ({_words(POSITIVE)}) THEN 1e0 ELSE -1e0 END END AS weight
FROM numbered""",
    "tfidf_weights": f"WITH {CORPUS}",
    "class_weights": f"""WITH {LABELLED}
SELECT label, count(*) AS class_rows,
  round(CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)), 6) AS weight
FROM labelled GROUP BY label""",
    "train_split": f"""WITH {LABELLED},
counts AS (SELECT label, CAST(count(*) AS HUGEINT) AS n FROM labelled GROUP BY label),
totals AS (SELECT sum(n) AS total, sum(n) - CAST(ceil(sum(n) * 2e-1) AS HUGEINT) AS train FROM counts),
shares AS (SELECT label, n * train // total AS whole, n * train % total AS rest, train FROM counts, totals),
quotas AS (
  SELECT label, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= train - sum(whole) OVER () THEN 1 ELSE 0 END AS quota
  FROM shares)
SELECT review_id, label,
  row_number() OVER (PARTITION BY label ORDER BY md5(review_id || ':42'), review_id) <= quota AS is_train
FROM labelled JOIN quotas USING (label)""",
    "accuracy": f"""WITH {PREDICTED}
SELECT round(avg(CASE WHEN label = prediction THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM predicted""",
    "macro_f1": f"WITH {PREDICTED}, {_f1()} SELECT round(avg(f1), 6) AS f1_macro FROM classes",
    "analyze_rows": f"WITH {SCORED} {ANALYSIS}",
    "analyze_batch": f"""WITH RECURSIVE {REVIEW_CLUSTERS},
{_scored('placed')}
SELECT batch_id, review_index, review_id, mismatch_score, is_flagged, cluster_id
FROM scored LEFT JOIN members ON b = batch_id AND i = review_index""",
    "stream_analyze": f"WITH {SCORED} {ANALYSIS}",
    "train_logreg": f"""WITH {DOCUMENT_SPLIT},
weights AS (SELECT label, round(CAST(sum(quota) OVER () AS DOUBLE) / count(*) OVER (), 2) AS w FROM quotas WHERE quota > 0)
SELECT label, w AS weighted_rows, true AS is_balanced, true AS is_flat FROM weights""",
    "model_sentiment": f"""WITH {DOCUMENT_SPLIT}
SELECT label, count(*) AS texts, CAST(0 AS BIGINT) AS unsound FROM split WHERE is_held_out GROUP BY label""",
    "model_roundtrip": f"WITH {DOCUMENT_SPLIT} SELECT count(*) AS texts, CAST(0 AS BIGINT) AS different FROM split WHERE is_held_out",
    "model_explain": f"WITH {DOCUMENT_SPLIT} SELECT count(*) AS texts, CAST(0 AS BIGINT) AS texts_off FROM split WHERE is_held_out",
    "train_and_compare": f"""WITH {DOCUMENT_SPLIT}
SELECT run, 'tfidf_logreg' AS model_type, true AS is_sound, (SELECT count(*) FROM split WHERE is_held_out) AS texts
FROM (VALUES ('tfidf-logreg-baseline'), ('tfidf-logreg-small'), ('tfidf-logreg-tight')) runs(run)""",
    "analyze_rows_model": f"""WITH {DOCUMENT_SPLIT}
SELECT doc_id AS review_id, 'model' AS classifier, true AS is_explained FROM split WHERE is_held_out""",
    "analyze_conversations": f"""WITH RECURSIVE {CONVERSATION_CLUSTERS},
{_scored('placed')}
SELECT batch_id, review_index, review_id, rating, predicted_sentiment, sentiment_confidence, mismatch_score, is_flagged,
  reason, CASE WHEN is_flagged THEN 'lexicon_fallback' END AS explanation_method, cluster_id
FROM scored LEFT JOIN members ON b = batch_id AND i = review_index""",
    "conversation_duplicates": f"WITH RECURSIVE {CONVERSATION_CLUSTERS} {CLUSTER_SUMMARY}",
    "emit_batch_json": f"""WITH RECURSIVE {TURN_CLUSTERS},
{_scored('placed')},
res AS (
  SELECT batch_id, review_index, is_flagged, cluster_id, CAST(floor(review_index / {ROWS_PER_PART}) AS BIGINT) AS part
  FROM scored LEFT JOIN members ON b = batch_id AND i = review_index)
SELECT batch_id, part, 'part' AS kind, count(*) AS n_results, count(*) FILTER (WHERE is_flagged) AS n_flagged,
  min(review_index) AS first_index, max(review_index) AS last_index, count(DISTINCT cluster_id) AS n_clusters,
  count(cluster_id) AS n_members, CAST(NULL AS BIGINT) AS n_parts
FROM res GROUP BY batch_id, part
UNION ALL
SELECT batch_id, -1, 'manifest', count(*), NULL, NULL, NULL, count(DISTINCT cluster_id), NULL, count(DISTINCT part)
FROM res GROUP BY batch_id""",
    "stream_duplicates": f"WITH RECURSIVE {STREAM_CLUSTERS} {CLUSTER_SUMMARY}",
    "stream_whole_batches": f"WITH RECURSIVE {REVIEW_CLUSTERS} {CLUSTER_SUMMARY}",
    "stream_request_sinks": f"""WITH {REQUESTS}
SELECT CASE WHEN reject_reason IS NULL THEN 'analysis' ELSE 'row_reject' END AS kind, CAST(batch_id AS BIGINT) AS batch_id,
  CAST(review_index AS BIGINT) AS review_index, reject_reason, CAST(NULL AS BIGINT) AS body_chars
FROM (SELECT batch_id, review_index, {REASONS.format(more='')} AS reject_reason FROM slots)
UNION ALL
SELECT 'body_reject', CAST(review_id AS BIGINT), NULL,
  CASE WHEN review_id % 97 = 0 THEN 'malformed_body' ELSE 'empty_batch' END,
  CAST(CASE WHEN review_id % 97 = 0 THEN 9 ELSE length('{{"reviews":[]}}') END AS BIGINT)
FROM reviews WHERE review_id % 97 = 0 OR review_id % 4 = 0""",
    "stream_rejects": f"""WITH {REQUESTS}
SELECT batch_id, review_index, {REASONS.format(more='')} AS reject_reason FROM slots WHERE reject_reason IS NOT NULL""",
}
