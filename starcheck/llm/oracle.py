"""The expected result of the operators that SQL can express, for DuckDB on small tables."""

from starcheck.llm.licenses import TEMPLATES, THRESHOLD, template_bigrams
from starcheck.llm.search import TERM, TOP
from starcheck.llm.url_filter import LOWER, UPPER

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

SUBSTRING_DEDUP = rf"""WITH texts AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM texts)),
firsts AS (SELECT h, min(doc_id) AS first_doc FROM windows GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN firsts USING (h), range(50) ks(k) WHERE first_doc < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM texts),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p)
  GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)"""

NEAR_DEDUP = rf"""WITH RECURSIVE texts AS (
  SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1))) AS i FROM texts)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(doc_id, root) AS (
  SELECT DISTINCT a, a FROM links UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.doc_id),
roots AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id,
  doc_id = coalesce(root, doc_id) AS kept
FROM texts LEFT JOIN sizes USING (doc_id) LEFT JOIN roots USING (doc_id)"""


def _list(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


_TEMPLATES = ", ".join(f"('{name}', {_list(template_bigrams(text))})" for name, text in TEMPLATES.items())

LICENSE_SCANS = rf"""WITH texts AS (
  SELECT doc_id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS t FROM documents),
lines AS (SELECT doc_id, string_split(t, chr(10)) AS parts FROM texts),
paragraphs AS (SELECT doc_id, regexp_split_to_array(t, '\n *\n[\n ]*') AS parts FROM texts),
units AS (
  SELECT doc_id, 'line' AS unit, unnest(parts) AS u, generate_subscripts(parts, 1) - 1 AS number FROM lines
  UNION ALL
  SELECT * FROM (
    SELECT doc_id, 'paragraph' AS unit, unnest(parts) AS u, generate_subscripts(parts, 1) - 1 AS number FROM paragraphs)
  WHERE contains(u, chr(10))
  UNION ALL SELECT doc_id, 'text', t, 0 FROM texts WHERE regexp_matches(t, '\n *\n')),
split AS (
  SELECT doc_id, unit, number, list_filter(regexp_split_to_array(u, '[ \n]+'), lambda w: w <> '') AS ws FROM units),
grams AS (
  SELECT doc_id, unit, number,
    list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS b
  FROM split WHERE len(ws) > 1),
templates(name, tb) AS (VALUES {_TEMPLATES}),
scored AS (
  SELECT doc_id, unit, number, name, len(b) AS n, 2e0 * len(list_intersect(b, tb)) / (len(b) + len(tb)) AS dice
  FROM grams, templates)
SELECT doc_id, unit, CAST(number AS INT) AS number, name AS license, dice, CAST(n AS INT) AS n_bigrams FROM scored
WHERE dice >= {THRESHOLD * 100:g}e-2
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, number ORDER BY dice DESC, name) = 1"""

_TERMS = rf"regexp_extract_all(translate(coalesce({{text}}, ''), '{UPPER}', '{LOWER}'), '{TERM}')"

LEXICAL_SEARCH = rf"""WITH docs AS (SELECT doc_id, {_TERMS.format(text="text")} AS ts FROM documents),
stats AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS big_n, sum(len(ts)) AS big_l FROM docs),
occ AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM docs),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM occ GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df, stats),
items AS (SELECT DISTINCT item_id, unnest({_TERMS.format(text="text")}) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS score
  FROM items JOIN tf USING (term) JOIN w USING (term), stats GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id,
  CAST(score AS BIGINT) AS score
FROM scored WHERE score > 0 QUALIFY rank <= {TOP}"""

ORACLES = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op2_license_scans": LICENSE_SCANS,
    "op6_minhash_near_dedup": NEAR_DEDUP,
    "op11_lexical_search": LEXICAL_SEARCH,
}
