"""DuckDB SQL that says what each query says, written from the definitions and not from the plans."""

from __future__ import annotations

from tessella.plans.config import BLOCK_MODES, FIELDS, FUNCTION_WORDS, LABEL_KINDS, REPRESENTATIONS
from tessella.plans.experiments import CAST_SIZES, GENRE_WEIGHTS, SHARED_TERMS

_STOP = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)
_WS = r"[\s\x1c-\x1f\p{Z}]+"


def _strip(c: str) -> str:
    return rf"regexp_replace(coalesce({c}, ''), '^[\s\x1c-\x1f\p{{Z}}]+|[\s\x1c-\x1f\p{{Z}}]+$', '', 'g')"


_NORM = f"trim(regexp_replace(lower(nfc_normalize(text)), '{_WS}', ' ', 'g'))"
_FIRST = "split_part(text, chr(10), 1)"
_KEEP = f"length(x) >= 2 AND x NOT IN ({_STOP})"

_DOC = f"""
lab AS (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels GROUP BY doc_id),
dd AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN lab l USING (doc_id)),
tok AS (
  SELECT item_id, 'overview' AS field, x AS term FROM (SELECT doc_id AS item_id, unnest(regexp_extract_all({_NORM}, '[\\p{{L}}\\p{{N}}]+')) AS x FROM dd WHERE length({_strip("text")}) >= 40) WHERE {_KEEP}
  UNION ALL SELECT doc_id, 'genres', lower(lang) FROM dd WHERE length(lang) >= 2
  UNION ALL SELECT doc_id, 'keywords', 'quality_' || quality FROM dd WHERE quality IS NOT NULL
  UNION ALL SELECT doc_id, 'keywords', 'toxic_' || toxic FROM dd WHERE toxic IS NOT NULL
  UNION ALL SELECT doc_id, 'director', lower(source) FROM dd WHERE source IS NOT NULL
),
items AS (SELECT doc_id AS id FROM documents)
"""


def _part(cast_k: int = 5) -> str:
    return f"""
sold AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q, count(*) AS n, min(l_shipdate) AS first FROM lineitem GROUP BY l_partkey, l_suppkey),
billed AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY q DESC, l_suppkey) - 1 AS o FROM sold),
pp AS (SELECT p.*, s.popularity, s.votes, strftime(s.first, '%Y-%m-%d') AS release_date FROM part p LEFT JOIN (SELECT l_partkey, sum(q) AS popularity, sum(n) AS votes, min(first) AS first FROM sold GROUP BY l_partkey) s ON l_partkey = p_partkey),
cast_names AS (SELECT l_partkey AS id, o, replace(s_name, 'Supplier#', 's') AS name FROM billed JOIN supplier ON s_suppkey = l_suppkey),
tok AS (
  SELECT item_id, 'overview' AS field, x AS term FROM (SELECT p_partkey AS item_id, unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+')) AS x FROM part) WHERE {_KEEP}
  UNION ALL SELECT p_partkey, 'genres', replace(lower(p_type), ' ', '_') FROM part
  UNION ALL SELECT p_partkey, 'keywords', 'size_' || p_size FROM part
  UNION ALL SELECT DISTINCT id, 'cast', name FROM cast_names WHERE o < {cast_k}
  UNION ALL SELECT p_partkey, 'director', lower(replace(p_brand, '#', '')) FROM part
),
items AS (SELECT p_partkey AS id FROM part)
"""


_PART = _part()
_MIN_DF = {"overview": 2, "keywords": 2, "genres": 1, "cast": 2, "director": 2}


def _weights(fields=FIELDS, genre: float = 1.0, tag: str = "", strict: bool = False) -> str:
    """tf, df, voc, raw and wts over tok."""
    chosen = [f for f in fields if f != "genres" or genre]
    names = ", ".join(f"'{f}'" for f in chosen)
    floor = str(max(_MIN_DF[f] for f in fields)) if strict else "CASE field " + " ".join(f"WHEN '{f}' THEN {n}" for f, n in _MIN_DF.items()) + " END"
    norm = "item_id" if strict else "item_id, field"
    weight = "1.0" if strict else f"(CASE field WHEN 'genres' THEN {genre} ELSE 1.0 END)"
    return f"""
tf{tag} AS (SELECT item_id, field, term, count(*) AS tf FROM tok GROUP BY item_id, field, term),
df{tag} AS (SELECT field, term, count(*) AS df FROM tf{tag} GROUP BY field, term),
voc{tag} AS (SELECT * FROM df{tag} WHERE df >= {floor}),
raw{tag} AS (SELECT item_id, field, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM items)) / (1 + df)) + 1) AS w FROM tf{tag} JOIN voc{tag} USING (field, term) WHERE field IN ({names})),
blk{tag} AS (SELECT item_id, field, term, w / sqrt(sum(w * w) OVER (PARTITION BY {norm})) * {weight} AS w FROM raw{tag}),
wts{tag} AS (SELECT item_id, field, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM blk{tag})
"""


def _scores(queries: str, tag: str = "", candidates: str = "true") -> str:
    return f"""
sc{tag} AS (SELECT q.item_id AS query_id, i.item_id, round(sum(q.w * i.w), 9) AS score, count(*) AS shared
  FROM wts{tag} q JOIN wts{tag} i ON q.field = i.field AND q.term = i.term AND q.item_id <> i.item_id WHERE ({queries}) AND ({candidates}) GROUP BY q.item_id, i.item_id)
"""


_STATED = "q.item_id % 100 = 0"
_DOC_SEARCH = f"WITH {_DOC}, {_weights(genre=0.44)}, {_scores(_STATED)}"
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)"


def _recommend(k: int, score: float = 0.0, shared: int = 1) -> str:
    return f"SELECT query_id, {_RANK} AS rank, item_id, round(score, 6) AS score, shared FROM sc WHERE score >= {score} AND shared >= {shared} QUALIFY rank <= {k}"


def _skipped(k: int, score: float, shared: int) -> str:
    ok = f"score >= {score} AND shared >= {shared}"
    return f"""
judged AS (SELECT *, CASE WHEN score < {score} THEN 'below_min_score' WHEN shared < {shared} THEN 'insufficient_shared_terms' END AS reason,
  coalesce(sum(CASE WHEN {ok} THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY score DESC, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS accepted FROM sc),
skip AS (SELECT query_id, {_RANK} AS place, item_id, reason FROM judged WHERE reason IS NOT NULL AND accepted < {k})
"""


_SUMS = "SELECT item_id, count(*) AS n, round(sum(w), 6) AS sum_w, round(max(w), 6) AS max_w FROM"
_MEMBERS = """
mem AS (
  SELECT DISTINCT * FROM (
    SELECT 'franchise' AS kind, lower(p_brand || ' ' || p_type) AS group_key, p_partkey AS item_id FROM part
    UNION ALL SELECT 'same_title', lower(p_name), p_partkey FROM part
    UNION ALL SELECT 'director', lower(replace(p_brand, '#', '')), p_partkey FROM part
    UNION ALL SELECT 'cast', name, id FROM cast_names WHERE o < 5)),
grp AS (SELECT kind, group_key, item_id FROM mem QUALIFY count(*) OVER (PARTITION BY kind, group_key) >= 2)
"""
_PAIRS = "pairs AS (SELECT DISTINCT a.kind, a.item_id AS query_id, b.item_id FROM grp a JOIN grp b ON a.kind = b.kind AND a.group_key = b.group_key AND a.item_id <> b.item_id)"


def _lists(tag: str = "", shared: int = 3, depth: int = 20) -> str:
    return f"""
lst{tag} AS (SELECT query_id, {_RANK} AS rank, item_id, score, shared FROM sc{tag} QUALIFY rank <= {depth}),
fil{tag} AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, item_id, score, shared FROM lst{tag} WHERE shared >= {shared})
"""


_PART_EVAL = f"WITH {_PART}, {_weights(genre=0.44)}, {_scores('true')}, {_lists()}"


def _label_scores(tag: str = "", ks=(5, 10, 20)) -> str:
    rows = ", ".join(f"({k})" for k in ks)
    return f"""
rel{tag} AS (SELECT kind, query_id, count(*) AS n FROM pairs GROUP BY kind, query_id),
hit{tag} AS (SELECT p.kind, l.query_id, l.rank FROM lst{tag} l JOIN pairs p USING (query_id, item_id)),
per{tag} AS (SELECT r.kind, ks.k, r.query_id, r.n, count(h.rank) AS f, coalesce(sum(1 / log2(h.rank + 1)), 0) AS d FROM rel{tag} r CROSS JOIN (VALUES {rows}) ks(k) LEFT JOIN hit{tag} h ON h.kind = r.kind AND h.query_id = r.query_id AND h.rank <= ks.k GROUP BY ALL),
lab_sc{tag} AS (SELECT kind, CAST(k AS BIGINT) AS k, count(*) AS queries, round(avg(f / n), 6) AS recall, round(avg(CASE WHEN f > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate,
  round(avg(CASE WHEN f > 0 THEN d / list_sum(list_transform(range(1, f + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END), 6) AS ndcg, round(avg(n), 6) AS mean_relevant FROM per{tag} GROUP BY kind, k)
"""


_DOC_GROUPS = f"""
grp AS (SELECT kind, group_key, item_id FROM (SELECT DISTINCT * FROM (
  SELECT 'franchise' AS kind, sha256(text) AS group_key, doc_id AS item_id FROM documents
  UNION ALL SELECT 'same_title', trim(regexp_replace(replace(lower({_FIRST}), 'ß', 'ss'), '{_WS}', ' ', 'g')), doc_id FROM documents
  UNION ALL SELECT 'director', lower(source), doc_id FROM documents) WHERE group_key <> '') QUALIFY count(*) OVER (PARTITION BY kind, group_key) >= 2)
"""

_PERCENTILES = "pct AS (SELECT p_partkey AS item_id, (rank() OVER (ORDER BY coalesce(popularity, 0)) - 1 + (count(*) OVER (PARTITION BY coalesce(popularity, 0)) - 1) / 2.0) / greatest(count(*) OVER () - 1, 1) * 100.0 AS percentile FROM pp)"


def _geometry(tag: str = "") -> str:
    """Columns of one row over wts and items."""
    return f"""(SELECT count(*) FROM items) AS items, (SELECT count(*) FROM (SELECT DISTINCT field, term FROM wts{tag})) AS dimensions, (SELECT count(*) FROM wts{tag}) AS nonzeros,
  round((SELECT count(*) FROM wts{tag}) * 100.0 / ((SELECT count(*) FROM items) * (SELECT count(*) FROM (SELECT DISTINCT field, term FROM wts{tag}))), 6) AS density_pct,
  round((SELECT count(*) FROM wts{tag}) / (SELECT count(*) FROM items), 6) AS mean_nonzeros, (SELECT count(*) FROM items) - (SELECT count(DISTINCT item_id) FROM wts{tag}) AS empty_items,
  {", ".join(f"coalesce((SELECT round(sum(w * w) * 100 / (SELECT sum(w * w) FROM wts{tag}), 2) FROM wts{tag} WHERE field = '{f}'), 0) AS share_{f}" for f in FIELDS)}"""


def _experiments(rows: list[tuple[str, tuple, float, int, int]]) -> str:
    """(name, fields, genre weight, min shared, cast size) one after another; a cast size replaces tok by a subquery of its own."""
    kinds, ks = ", ".join(f"('{k}')" for k in LABEL_KINDS), "(5), (10), (20)"
    parts = []
    for i, (name, fields, genre, shared, cast_k) in enumerate(rows):
        parts.append(f"""SELECT * FROM (WITH {_part(cast_k)}, {_MEMBERS}, {_PAIRS}, {_weights(fields, genre, str(i))}, {_scores("true", str(i))}, {_lists(str(i), shared)}, {_label_scores(str(i))}, {_PERCENTILES},
pp{i} AS (SELECT rank() OVER (ORDER BY rank) + (count(*) OVER (PARTITION BY rank) - 1) / 2.0 AS a, rank() OVER (ORDER BY percentile) + (count(*) OVER (PARTITION BY percentile) - 1) / 2.0 AS b, percentile FROM fil{i} JOIN pct USING (item_id)),
br{i} AS (SELECT query_id, count(DISTINCT p_type) AS g, count(DISTINCT CAST(left(release_date, 4) AS INT) // 10) AS d FROM fil{i} JOIN pp ON p_partkey = item_id WHERE rank <= 10 GROUP BY query_id),
no{i} AS (SELECT kind, count(*) AS n FROM items CROSS JOIN (VALUES {kinds}) v(kind) WHERE (kind, id) NOT IN (SELECT kind, item_id FROM grp) GROUP BY kind)
SELECT '{name}' AS experiment, v.kind, CAST(ks.k AS BIGINT) AS k, coalesce(l.queries, 0) AS queries, coalesce(n.n, 0) AS unevaluable, coalesce(l.recall, 0) AS recall, coalesce(l.hit_rate, 0) AS hit_rate, coalesce(l.ndcg, 0) AS ndcg, coalesce(l.mean_relevant, 0) AS mean_relevant,
  (SELECT round(count(DISTINCT item_id) / (SELECT count(*) FROM items), 6) FROM fil{i}) AS coverage,
  (SELECT round(coalesce(avg(1 - coalesce(s.score, 0)), 0), 6) FROM fil{i} a JOIN fil{i} b ON a.query_id = b.query_id AND a.item_id < b.item_id LEFT JOIN sc{i} s ON s.query_id = a.item_id AND s.item_id = b.item_id) AS diversity,
  (SELECT round(coalesce(sum(g), 0) / (SELECT count(*) FROM items), 6) FROM br{i}) AS distinct_genres, (SELECT round(coalesce(sum(d), 0) / (SELECT count(*) FROM items), 6) FROM br{i}) AS distinct_decades,
  (SELECT round(coalesce(avg(score), 0), 6) FROM fil{i} WHERE rank = 1) AS mean_top1_score,
  (SELECT round(coalesce(count(*) FILTER (WHERE shared <= 3) / nullif(count(*), 0), 0), 6) FROM fil{i} WHERE rank <= 10) AS thin_rate,
  (SELECT round(count(*) / (SELECT count(*) FROM items), 6) FROM fil{i}) AS mean_returned,
  (SELECT round(coalesce(avg(percentile), 0), 6) FROM pp{i}) AS mean_percentile, (SELECT round(CASE WHEN count(*) < 2 OR min(a) = max(a) OR min(b) = max(b) THEN 0 ELSE corr(a, b) END, 6) FROM pp{i}) AS rho,
  {_geometry(str(i))}
FROM (VALUES {kinds}) v(kind) CROSS JOIN (VALUES {ks}) ks(k) LEFT JOIN lab_sc{i} l ON l.kind = v.kind AND l.k = ks.k LEFT JOIN no{i} n ON n.kind = v.kind)""")
    return "\nUNION ALL ".join(parts)


def _samples(rows: list[tuple[str, float, int]]) -> str:
    parts = []
    for i, (name, genre, shared) in enumerate(rows):
        parts.append(f"""SELECT * FROM (WITH {_PART}, {_MEMBERS}, {_weights(genre=genre, tag=str(i))}, ask AS (SELECT DISTINCT item_id FROM grp WHERE kind = 'franchise' ORDER BY item_id LIMIT 20), {_scores("q.item_id IN (SELECT item_id FROM ask)", str(i))}
SELECT '{name}' AS experiment, query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s.item_id) AS rank, s.item_id, p_name AS title, round(score, 6) AS score, shared,
  EXISTS (SELECT 1 FROM grp a JOIN grp b USING (kind, group_key) WHERE kind = 'franchise' AND a.item_id = query_id AND b.item_id = s.item_id) AS same_collection
FROM sc{i} s JOIN part ON p_partkey = s.item_id WHERE shared >= {shared} QUALIFY rank <= 10)""")
    return "\nUNION ALL ".join(parts)


_ALL = FIELDS


def _doc_block(field: str) -> str:
    if field == "overview":
        body = f"SELECT doc_id AS id, list_filter(regexp_extract_all({_NORM}, '[\\p{{L}}\\p{{N}}]+'), lambda x: {_KEEP}) AS t, length({_strip('text')}) AS n FROM documents"
        return f"SELECT id, CASE WHEN n >= 40 THEN CAST(len(t) AS BIGINT) ELSE 0 END AS n, md5(CASE WHEN n >= 40 THEN array_to_string(t, ' ') ELSE '' END) AS digest FROM ({body})"
    return f"WITH {_DOC}, t AS (SELECT item_id, count(*) AS n, string_agg(term, ' ' ORDER BY term) AS d FROM tok WHERE field = '{field}' GROUP BY item_id) SELECT id, coalesce(n, 0) AS n, md5(coalesce(d, '')) AS digest FROM items LEFT JOIN t ON item_id = id"


_PART_DOC = f"""
blocks AS (
  SELECT p_partkey AS id, 0 AS b, i AS pos, 'ov:' || w[i] AS x FROM (SELECT p_partkey, list_filter(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'), lambda x: {_KEEP}) AS w, unnest(range(1, len(list_filter(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'), lambda x: {_KEEP})) + 1)) AS i FROM part)
  UNION ALL SELECT p_partkey, 1, 0, 'kw:size_' || p_size FROM part
  UNION ALL SELECT p_partkey, 2, 0, 'gn:' || lower(p_type) FROM part
  UNION ALL SELECT id, 3, o, 'cast:' || name FROM cast_names WHERE o < 5
  UNION ALL SELECT p_partkey, 4, 0, 'dir:' || lower(replace(p_brand, '#', '')) FROM part)
"""

_DESCRIBE = """
WITH v AS (SELECT CAST(n_chars AS DOUBLE) AS x FROM documents WHERE n_chars IS NOT NULL), s AS (SELECT list(x ORDER BY x) AS a, count(*) AS n FROM v),
q AS (SELECT a, n, greatest(1, least((n + 1) // 4, n - 1)) AS j1, greatest(1, least(3 * (n + 1) // 4, n - 1)) AS j3, greatest(1, least(19 * (n + 1) // 20, n - 1)) AS j95 FROM s)
SELECT n, round(a[1], 2) AS min, CASE WHEN n > 3 THEN round((a[j1] * (4 - (n + 1 - j1 * 4)) + a[j1 + 1] * (n + 1 - j1 * 4)) / 4, 2) END AS p25, round((a[(n + 1) // 2] + a[n // 2 + 1]) / 2, 2) AS median,
  round(list_sum(a) / n, 2) AS mean, CASE WHEN n > 3 THEN round((a[j3] * (4 - (3 * (n + 1) - j3 * 4)) + a[j3 + 1] * (3 * (n + 1) - j3 * 4)) / 4, 2) END AS p75,
  CASE WHEN n > 19 THEN round((a[j95] * (20 - (19 * (n + 1) - j95 * 20)) + a[j95 + 1] * (19 * (n + 1) - j95 * 20)) / 20, 2) END AS p95, round(a[n], 2) AS max FROM q
"""



def _search(query: str, limit: int) -> str:
    return f"""
SELECT row_number() OVER (ORDER BY tier, lower(title), id) AS place, id, title, ['exact', 'title_prefix', 'original_title_prefix', 'title_contains', 'title_contains'][tier + 1] AS match, count(*) OVER () AS total_matches FROM (
  SELECT id, title, CASE WHEN t = '{query}' OR o = '{query}' THEN 0 WHEN starts_with(t, '{query}') THEN 1 WHEN starts_with(o, '{query}') THEN 2 WHEN contains(t, '{query}') THEN 3 WHEN contains(o, '{query}') THEN 4 END AS tier
  FROM (SELECT p_partkey AS id, p_name AS title, lower(p_name) AS t, lower(p_brand || ' ' || p_name) AS o FROM part)) WHERE tier IS NOT NULL QUALIFY place <= {limit}
"""


#: Searches of the title index with their limits.
_INDEXED = (("brand#1", 50), ("ring", 20), ("#1", 40), ("e", 30), ("brand#23 s", 30), ("nowhere", 5))

#: The events' lines as they might arrive, and the value of k in each.
_RAW = r"""
raw AS (SELECT event_id AS line_no, event_id % 10 AS kind, props FROM events WHERE event_id % 10 <> 2),
typed AS (SELECT line_no, CASE kind WHEN 0 THEN 'json_decode_error' WHEN 1 THEN 'record_is_not_an_object' END AS error,
  CASE kind WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 3 THEN 'STRING' WHEN 4 THEN 'BOOLEAN' WHEN 5 THEN 'DECIMAL(2,1)' WHEN 6 THEN 'VOID' WHEN 7 THEN 'STRING' ELSE 'BIGINT' END AS k_kind,
  CASE WHEN kind >= 8 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN kind >= 8 THEN CAST(json_extract(props, '$.k') AS DOUBLE) WHEN kind = 5 THEN 1.5 END AS k_number,
  CASE kind WHEN 3 THEN chr(9) || '-' || line_no || chr(160) WHEN 7 THEN 'x1' END AS k_text, CASE WHEN kind = 4 THEN true END AS k_flag,
  CASE WHEN kind >= 8 THEN CAST(json_extract(props, '$.k') AS BIGINT) WHEN kind = 3 THEN -line_no END AS id FROM raw)
"""
#: The varied parts: brands, types in two cases, a director each for type and brand, and credits out of order.
_BRAND, _TYPE = "lower(replace(p_brand, '#', ''))", "replace(lower(p_type), ' ', '_')"

_PLACEHOLDER = r"^no overview available\.?$|^no overview found\.?$|^n/?a$|^unknown$|^tbd$|^coming soon$|^lorem ipsum|^[^\p{L}\p{N}_]*$"

ORACLES = {
    "ingest_events_props": f"WITH {_RAW} SELECT line_no, error, k_kind, k, k_number, k_text, k_flag FROM typed",
    "coerce_id": f"WITH {_RAW} SELECT line_no, id FROM typed",
    "load_samples": f"WITH {_RAW} SELECT * FROM (SELECT 'malformed' AS reason, line_no, error AS detail FROM typed WHERE error IS NOT NULL ORDER BY line_no LIMIT 10) UNION ALL SELECT * FROM (SELECT 'invalid_id', line_no, NULL FROM typed WHERE error IS NULL AND id IS NULL ORDER BY line_no LIMIT 10) UNION ALL SELECT * FROM (SELECT 'duplicate_id', line_no, CAST(id AS VARCHAR) FROM typed WHERE error IS NULL AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no) > 1 ORDER BY line_no LIMIT 10)",
    "manifest_corpus": f"WITH {_PART}, {_PART_DOC}, n AS (SELECT id, count(*) AS n FROM blocks GROUP BY id) SELECT count(*) AS records, count(n) AS nonempty_documents, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total_tokens, round(sum(coalesce(n, 0)) / count(*), 4) AS mean_tokens, CAST(0 AS BIGINT) AS stinger_items FROM items LEFT JOIN n USING (id)",
    "validate_corpus": "SELECT count(*) AS rows, count(text) AS complete, count(*) >= 100 AND count(*) = count(text) AS usable FROM documents",
    "stratified_sample": "WITH s AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY md5(p_partkey || ':42'), p_partkey) AS place FROM part), z AS (SELECT p_type, count(*) AS size FROM part GROUP BY p_type), q AS (SELECT p_type, size, least(size, ceil(300.0 / count(*) OVER ())) AS taken FROM z), steps AS (SELECT p_type, unnest(range(CAST(size - taken AS BIGINT), 0, -50)) AS rest FROM q WHERE size > taken), told AS (SELECT p_type, rest, least(rest, 50) AS n, coalesce(sum(least(rest, 50)) OVER (ORDER BY rest DESC, p_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM steps), more AS (SELECT p_type, sum(greatest(0, least(n, 300 - (SELECT sum(taken) FROM q) - earlier))) AS n FROM told GROUP BY p_type) SELECT p_partkey, s.p_type FROM s JOIN q USING (p_type) LEFT JOIN more USING (p_type) WHERE place <= taken + coalesce(more.n, 0)",
    "stratified_uneven": "WITH s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':42'), doc_id) AS place FROM documents), z AS (SELECT source, count(*) AS size FROM documents GROUP BY source), q AS (SELECT source, size, least(size, ceil(300.0 / count(*) OVER ())) AS taken FROM z), steps AS (SELECT source, unnest(range(CAST(size - taken AS BIGINT), 0, -50)) AS rest FROM q WHERE size > taken), told AS (SELECT source, rest, least(rest, 50) AS n, coalesce(sum(least(rest, 50)) OVER (ORDER BY rest DESC, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM steps), more AS (SELECT source, sum(greatest(0, least(n, 300 - (SELECT sum(taken) FROM q) - earlier))) AS n FROM told GROUP BY source) SELECT doc_id, s.source FROM s JOIN q USING (source) LEFT JOIN more USING (source) WHERE place <= taken + coalesce(more.n, 0)",
    "text_normalise": f"SELECT doc_id, md5({_NORM}) AS digest FROM documents",
    "tokenize_documents": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_terms, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, list_filter(regexp_extract_all({_NORM}, '[\\p{{L}}\\p{{N}}]+'), lambda x: {_KEEP}) AS t FROM documents)",
    "canonical_phrase": "SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' -- ' || p_type || ' -- ' || p_name), '[^a-z0-9_]+', ' ', 'g')) AS phrase FROM part",
    "phrase_tokens": "SELECT c_custkey, replace(lower(c_mktsegment), ' ', '_') AS token FROM customer",
    "release_year": f"WITH {_PART} SELECT p_partkey AS id, release_date, CAST(left(release_date, 4) AS BIGINT) AS release_year FROM pp",
    "normalise_name": f"SELECT doc_id, md5(trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '{_WS}', ' ', 'g'))) AS digest FROM documents",
    "project_nested": f"WITH {_PART} SELECT p_partkey AS id, coalesce(c, '') AS \"cast\", 'Director:' || p_type || '|Story:' || p_name || '|Director:' || replace(p_brand, '#', '') AS crew FROM part LEFT JOIN (SELECT id, string_agg(name, '|' ORDER BY CASE WHEN id % 3 = 0 THEN -o ELSE o END) AS c FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN id % 3 = 0 THEN -o ELSE o END) AS place FROM cast_names) WHERE place <= 3 GROUP BY id) ON id = p_partkey",
    "resume_anti_join": "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)",
    "overview_block": _doc_block("overview"),
    "keyword_block": _doc_block("keywords"),
    "genre_block": f"SELECT p_partkey AS id, CASE WHEN {_BRAND} = {_TYPE} THEN 1 ELSE 2 END AS n, md5({_TYPE} || CASE WHEN {_BRAND} = {_TYPE} THEN '' ELSE ' ' || {_BRAND} END) AS digest FROM part",
    "cast_block": f"WITH {_PART} SELECT p_partkey AS id, coalesce(n, 0) AS n, md5(coalesce(d, '')) AS digest FROM part LEFT JOIN (SELECT id, count(*) AS n, string_agg(name, ' ' ORDER BY o) AS d FROM cast_names WHERE o < 5 GROUP BY id) ON id = p_partkey",
    "director_block": f"SELECT id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT p_partkey AS id, list_filter(regexp_extract_all(CASE WHEN replace(p_brand, '#', '') <= p_type THEN {_BRAND} || ' ' || lower(p_type) ELSE lower(p_type) || ' ' || {_BRAND} END, '[a-z0-9]+'), lambda x: length(x) >= 2) AS t FROM part)",
    "feature_records": f"WITH {_PART}, {_PART_DOC} SELECT p_partkey AS id, p_name AS title, p_brand || ' ' || p_name AS original_title, CAST(left(release_date, 4) AS INT) AS release_year, p_brand || ' ' || p_type AS collection_name, popularity, CAST(votes AS DOUBLE) AS vote_count, n AS document_size, d AS document FROM pp JOIN (SELECT id, count(*) AS n, string_agg(x, ' ' ORDER BY b, pos) AS d FROM blocks GROUP BY id) ON id = p_partkey",
    "item_metadata": f"WITH {_PART}, {_PART_DOC} SELECT p_partkey AS id, p_name AS title, p_brand || ' ' || p_name AS original_title, CAST(left(release_date, 4) AS BIGINT) AS release_year, lower(p_type) AS genres, popularity, CAST(NULL AS DOUBLE) AS vote_average, CAST(votes AS DOUBLE) AS vote_count, p_brand || ' ' || p_type AS collection_name, {', '.join(f'count(*) FILTER (WHERE b = {i}) AS n_{f}' for i, f in enumerate(FIELDS))} FROM pp JOIN blocks ON id = p_partkey GROUP BY ALL",
    "dedupe_first_wins": "SELECT l_partkey AS id, min(l_orderkey * 10 + l_linenumber) AS line_no FROM lineitem GROUP BY l_partkey",
    "load_report": f"WITH {_RAW} SELECT count(*) AS lines_total, count(*) FILTER (WHERE error IS NULL) AS records_parsed, count(error) AS malformed, count(*) FILTER (WHERE error IS NULL AND id IS NULL) AS invalid_id, count(id) - count(DISTINCT id) AS duplicate_id, count(DISTINCT id) AS kept FROM typed",
    "manifest_token_stats": f"WITH {_DOC}, f AS (SELECT unnest([{', '.join(repr(f) for f in FIELDS)}]) AS field), t AS (SELECT field, count(*) AS n, count(DISTINCT item_id) AS d FROM tok GROUP BY field) SELECT field, coalesce(n, 0) AS n_tokens, round(coalesce(n, 0) * 100.0 / (SELECT count(*) FROM tok), 2) AS share_pct, (SELECT count(*) FROM items) - coalesce(d, 0) AS empty_blocks, round(coalesce(n, 0) / (SELECT count(*) FROM items), 4) AS mean_tokens FROM f LEFT JOIN t USING (field)",
    "tf_sublinear": f"WITH {_DOC}, {_weights()} SELECT item_id, count(*) AS n, round(sum(1 + ln(tf)), 6) AS sum_tf FROM tf WHERE field = 'overview' GROUP BY item_id",
    "idf_smooth": f"WITH {_DOC}, {_weights()} SELECT field, term, df, round(ln((1.0 + (SELECT count(*) FROM items)) / (1 + df)) + 1, 6) AS idf FROM df",
    "df_pruned_vocab": f"WITH {_DOC}, {_weights()} SELECT field, term, df FROM voc",
    "tfidf_weights": f"WITH {_PART}, {_weights()} {_SUMS} raw GROUP BY item_id",
    "tfidf_block": f"WITH {_DOC}, {_weights(('overview',))} {_SUMS} blk GROUP BY item_id",
    "l2_rows": f"WITH {_DOC}, {_weights()} SELECT item_id, round(sum(w * w), 6) AS squares FROM wts GROUP BY item_id",
    "representation_d": f"WITH {_PART}, {_weights(genre=0.44)} SELECT item_id, field, term, round(w, 6) AS w FROM wts",
    "representation_flat": f"WITH {_DOC}, {_weights(strict=True)} {_SUMS} wts GROUP BY item_id",
    "representation_geometry": f"WITH {_DOC}, {_weights()}, n AS (SELECT (SELECT count(*) FROM items) AS items, (SELECT count(*) FROM (SELECT DISTINCT field, term FROM wts)) AS dimensions, count(*) AS nonzeros, count(DISTINCT item_id) AS r FROM wts) SELECT items, dimensions, nonzeros, round(nonzeros * 100.0 / (items * dimensions), 6) AS density_pct, round(nonzeros / items, 6) AS mean_nonzeros, items - r AS empty_items FROM n",
    "representation_compare": "\nUNION ALL ".join(f"SELECT * FROM (WITH {_PART}, {_weights(fields, strict=mode == 'flat')} SELECT '{key}' AS representation, '{mode}' AS block_mode, {_geometry()}, {', '.join(f"(SELECT count(DISTINCT item_id) FROM wts WHERE field = '{f}') AS items_{f}" for f in FIELDS)})" for mode in BLOCK_MODES for key, fields in REPRESENTATIONS.items()),
    "field_energy_share": f"WITH {_DOC}, {_weights(genre=0.44)} SELECT field, round(sum(w * w) * 100 / (SELECT sum(w * w) FROM wts), 2) AS share_pct FROM wts GROUP BY field",
    "field_coverage": f"WITH {_DOC}, {_weights()} SELECT field, count(DISTINCT item_id) AS items FROM wts GROUP BY field",
    "weight_solver": f"WITH {_PART}, {_weights()} SELECT field, share_pct, round(sqrt(0.05 / 0.95 * (1 - share_pct / 100) / (share_pct / 100)), 6) AS weight FROM (SELECT field, round(sum(w * w) * 100 / (SELECT sum(w * w) FROM wts), 2) AS share_pct FROM wts GROUP BY field)",
    "recommend_single": f"WITH {_DOC}, {_weights(('overview',))}, {_scores('q.item_id = (SELECT min(id) FROM items)')} {_recommend(10)}",
    "recommend_topk": f"{_DOC_SEARCH} {_recommend(10, 0.0, 3)}",
    "recommend_many": f"WITH {_PART}, {_weights(genre=0.44)}, {_scores(_STATED)}, r AS ({_recommend(10, 0.0, 3)}) SELECT r.*, p_name AS title, CAST(left(release_date, 4) AS BIGINT) AS year, lower(p_type) AS genres, popularity, CAST(NULL AS DOUBLE) AS vote_average, CAST(votes AS DOUBLE) AS vote_count, p_brand || ' ' || p_type AS collection_name FROM r JOIN pp ON p_partkey = item_id",
    "recommend_min_score": f"{_DOC_SEARCH} {_recommend(10, 0.2)}",
    "recommend_evidence": f"{_DOC_SEARCH} {_recommend(10, 0.0, 8)}",
    "recommend_subset": f"WITH {_DOC}, {_weights(genre=0.44)}, {_scores(_STATED, candidates='i.item_id IN (SELECT doc_id FROM documents WHERE lang = chr(101) || chr(110))')} {_recommend(10)}",
    "recommend_skipped": f"{_DOC_SEARCH}, {_skipped(10, 0.05, 8)} SELECT * FROM skip",
    "recommend_skip_tally": f"{_DOC_SEARCH}, {_skipped(50, 0.05, 8)} SELECT reason, count(*) AS n FROM skip GROUP BY reason",
    "recommend_evidence_block": f"{_DOC_SEARCH}, {_skipped(10, 0.05, 8)}, acc AS ({_recommend(10, 0.05, 8)}), a AS (SELECT query_id, count(*) AS n FROM acc GROUP BY query_id), s AS (SELECT query_id, count(*) AS n FROM skip GROUP BY query_id) SELECT id AS query_id, CAST(8 AS BIGINT) AS min_shared_terms, CAST(10 AS BIGINT) AS requested_k, coalesce(a.n, 0) AS returned, coalesce(a.n, 0) + coalesce(s.n, 0) AS candidates_examined, coalesce(s.n, 0) AS candidates_rejected, coalesce(a.n, 0) < 10 AS exhausted FROM items LEFT JOIN a ON a.query_id = id LEFT JOIN s ON s.query_id = id WHERE id % 100 = 0",
    "similarity_rows": f"{_DOC_SEARCH} SELECT query_id, item_id, round(score, 6) AS score, shared FROM sc",
    "ranked_candidates": f"{_DOC_SEARCH} SELECT query_id, item_id, round(score, 6) AS score, {_RANK} AS rank FROM sc",
    "sparse_topk": f"{_DOC_SEARCH} SELECT query_id, item_id, round(score, 6) AS score, {_RANK} AS rank FROM sc QUALIFY rank <= 20",
    "topk_batch": f"WITH {_PART}, {_weights(genre=0.44)}, {_scores('true')} SELECT query_id, item_id, round(score, 6) AS score, shared, {_RANK} AS rank FROM sc QUALIFY rank <= 10",
    "search_index": " UNION ALL ".join(f"SELECT *, '{q}' AS query FROM ({_search(q, n)})" for q, n in _INDEXED),
    "search_titles": f"SELECT * FROM ({_search('brand#1', 50)}) UNION ALL SELECT * FROM ({_search('ring', 20)})",
    "select_queries": f"""WITH {_PART}, {_MEMBERS}, {_weights()}, z AS (SELECT id, count(item_id) AS n FROM items LEFT JOIN wts ON item_id = id GROUP BY id),
r AS (SELECT 'popular' AS purpose, (SELECT p_partkey FROM pp ORDER BY coalesce(popularity, 0) DESC, p_partkey LIMIT 1) AS id UNION ALL SELECT 'obscure', (SELECT p_partkey FROM pp ORDER BY coalesce(popularity, 0), p_partkey LIMIT 1)
UNION ALL SELECT 'sparse_features', (SELECT id FROM z ORDER BY n, id LIMIT 1) UNION ALL SELECT 'no_overview', (SELECT min(id) FROM items WHERE id NOT IN (SELECT item_id FROM tok WHERE field = 'overview'))
UNION ALL SELECT 'documentary', (SELECT min(p_partkey) FROM part WHERE p_type = 'ECONOMY') UNION ALL SELECT 'animation_family', (SELECT min(p_partkey) FROM part WHERE p_type IN ('PROMO', 'SMALL'))
UNION ALL SELECT 'same_title', (SELECT min(item_id) FROM grp WHERE kind = 'same_title') UNION ALL SELECT 'franchise', (SELECT min(item_id) FROM (SELECT item_id, count(*) OVER (PARTITION BY group_key) AS n FROM grp WHERE kind = 'franchise') WHERE n >= 4))
SELECT * FROM r WHERE id IS NOT NULL""",
    "label_groups": f"WITH {_PART}, {_MEMBERS} SELECT * FROM grp",
    "labels_restricted": f"WITH {_PART}, {_MEMBERS}, r AS (SELECT mem.* FROM mem JOIN part ON p_partkey = item_id WHERE p_size >= 25) SELECT * FROM r QUALIFY count(*) OVER (PARTITION BY kind, group_key) >= 2",
    "label_pairs": f"WITH {_DOC_GROUPS}, {_PAIRS} SELECT * FROM pairs WHERE query_id % 100 = 0",
    "label_summary": f"WITH {_PART}, {_MEMBERS} SELECT kind, count(DISTINCT group_key) AS groups, count(DISTINCT item_id) AS items FROM grp GROUP BY kind",
    "eval_unevaluable": f"WITH {_DOC_GROUPS} SELECT kind, count(*) AS queries FROM documents CROSS JOIN (SELECT unnest([{', '.join(repr(k) for k in LABEL_KINDS)}]) AS kind) WHERE (kind, doc_id) NOT IN (SELECT kind, item_id FROM grp) GROUP BY kind",
    "eval_recall": f"{_PART_EVAL}, {_MEMBERS}, {_PAIRS}, {_label_scores()} SELECT * EXCLUDE (ndcg) FROM lab_sc",
    "eval_ndcg": f"{_PART_EVAL}, {_MEMBERS}, {_PAIRS}, {_label_scores()} SELECT kind, k, ndcg FROM lab_sc",
    "eval_coverage": f"{_PART_EVAL} SELECT round(count(DISTINCT item_id) / (SELECT count(*) FROM items), 6) AS coverage FROM fil",
    "eval_ild": f"{_PART_EVAL} SELECT round(avg(1 - coalesce(sc.score, 0)), 6) AS diversity FROM fil a JOIN fil b ON a.query_id = b.query_id AND a.item_id < b.item_id LEFT JOIN sc ON sc.query_id = a.item_id AND sc.item_id = b.item_id",
    "eval_breadth": f"{_PART_EVAL}, per AS (SELECT id, count(DISTINCT p_type) AS g, count(DISTINCT CAST(left(release_date, 4) AS INT) // 10) AS d FROM items LEFT JOIN (SELECT query_id, p_type, release_date FROM fil JOIN pp ON p_partkey = item_id WHERE rank <= 10) ON query_id = id GROUP BY id) SELECT round(avg(g), 6) AS distinct_genres, round(avg(d), 6) AS distinct_decades FROM per",
    "eval_top1": f"{_PART_EVAL} SELECT round(avg(score), 6) AS mean_top1_score FROM fil WHERE rank = 1",
    "eval_thin": f"{_PART_EVAL} SELECT round(count(*) FILTER (WHERE shared <= 3) / count(*), 6) AS thin_rate FROM fil WHERE rank <= 10",
    "eval_returned": f"{_PART_EVAL} SELECT round(count(*) / (SELECT count(*) FROM items), 6) AS mean_returned FROM fil",
    "eval_popularity": f"{_PART_EVAL}, {_PERCENTILES} SELECT round(avg(percentile), 6) AS mean_percentile FROM fil JOIN pct USING (item_id)",
    "eval_spearman": f"{_PART_EVAL}, {_PERCENTILES}, r AS (SELECT rank() OVER (ORDER BY rank) + (count(*) OVER (PARTITION BY rank) - 1) / 2.0 AS a, rank() OVER (ORDER BY percentile) + (count(*) OVER (PARTITION BY percentile) - 1) / 2.0 AS b FROM fil JOIN pct USING (item_id)) SELECT round(corr(a, b), 6) AS rho FROM r",
    "popularity_percentiles": f"WITH {_PART}, {_PERCENTILES} SELECT item_id, round(percentile, 6) AS percentile FROM pct",
    "audit_missing": f"WITH {_DOC}, n AS (SELECT count(*) AS c FROM documents), x AS (SELECT 'title' AS item, count(*) FILTER (WHERE {_strip(_FIRST)} = '') AS n FROM dd UNION ALL SELECT 'overview_blank', count(*) FILTER (WHERE {_strip('text')} = '') FROM dd UNION ALL SELECT 'genres', count(*) FILTER (WHERE coalesce(trim(lang), '') = '') FROM dd UNION ALL SELECT 'keywords', count(*) FILTER (WHERE quality IS NULL AND toxic IS NULL) FROM dd UNION ALL SELECT 'cast', count(*) FROM dd UNION ALL SELECT 'release_date_blank', count(*) FROM dd UNION ALL SELECT 'release_date_malformed', 0 UNION ALL SELECT 'director', count(*) FILTER (WHERE coalesce(trim(source), '') = '') FROM dd) SELECT item, CAST(n AS BIGINT) AS n, round(n * 100.0 / c, 2) AS pct FROM x, n",
    "audit_ids": "WITH l AS (SELECT CASE WHEN l_linenumber <> 3 THEN l_orderkey END AS id FROM lineitem), g AS (SELECT id, count(*) AS n FROM l GROUP BY id) SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (WHERE id IS NULL), 0) AS BIGINT) AS null_ids, count(*) FILTER (WHERE id IS NOT NULL AND n > 1) AS duplicated_ids, CAST(coalesce(sum(n - 1) FILTER (WHERE id IS NOT NULL), 0) AS BIGINT) AS redundant_rows FROM g",
    "audit_title_groups": f"WITH {_PART}, k AS (SELECT 'exact' AS g, p_name AS a, '' AS y, p_partkey AS id FROM pp UNION ALL SELECT 'normalised', trim(regexp_replace(lower(p_name), '[^a-z0-9_]+', ' ', 'g')), '', p_partkey FROM pp UNION ALL SELECT 'normalised_year', trim(regexp_replace(lower(p_name), '[^a-z0-9_]+', ' ', 'g')), left(release_date, 4), p_partkey FROM pp WHERE release_date IS NOT NULL), c AS (SELECT g, count(DISTINCT id) AS n FROM k GROUP BY g, a, y) SELECT g AS grouping, count(*) FILTER (WHERE n > 1) AS groups, CAST(sum(n - 1) AS BIGINT) AS redundant FROM c GROUP BY g",
    "audit_text_quality": f"WITH x AS (SELECT {_strip('text')} AS o, lower({_strip(_FIRST)}) AS t FROM documents), y AS (SELECT *, o <> '' AND regexp_matches(lower(o), '{_PLACEHOLDER}') AS p FROM x) SELECT count(*) FILTER (WHERE p) AS placeholders, count(*) FILTER (WHERE o <> '' AND NOT p AND length(o) < 40) AS stubs, count(*) FILTER (WHERE o <> '' AND NOT p AND length(o) >= 40) AS prose, count(*) FILTER (WHERE regexp_matches(t, '^(test|untitled|untitled[0-9]*|dummy|placeholder|sample|example|movie|film|asdf|qwerty|xxx+|\\?+)$')) AS junk_titles, count(*) FILTER (WHERE regexp_matches(t, '^[0-9\\s.\\-]+$')) AS numeric_titles FROM y",
    "audit_usability": f"WITH {_PART}, x AS (SELECT release_date IS NOT NULL AS d, id IS NOT NULL AS c, length(p_name || ' ' || p_type) >= 40 AS o FROM pp LEFT JOIN (SELECT DISTINCT id FROM cast_names) ON id = p_partkey) SELECT count(*) FILTER (WHERE d AND c AND o) AS full_tier, count(*) FILTER (WHERE d AND c) AS core_tier, count(*) AS minimal_tier FROM x",
    "audit_describe": _DESCRIBE,
    "audit_distributions": f"WITH {_PART}, k AS (SELECT 'size ' || p_size AS v, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1) SELECT 'genre' AS kind, p_type AS value, count(*) AS n FROM part GROUP BY p_type UNION ALL SELECT 'keyword', v, n FROM k UNION ALL SELECT 'year', left(release_date, 4), count(*) FROM pp WHERE release_date IS NOT NULL GROUP BY 2 UNION ALL SELECT 'language', lang, count(*) FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'job', j, count(*) * m FROM part, (VALUES ('Director', 2), ('Producer', 1), ('Story', 1), ('Editor', 1)) v(j, m) GROUP BY j, m UNION ALL SELECT * FROM (SELECT 'top_keyword', v, n FROM k ORDER BY n DESC, first LIMIT 10)",
    "audit_cast_order": f"WITH {_PART}, c AS (SELECT id, count(*) AS n FROM cast_names GROUP BY id) SELECT count(*) AS credited, count(*) FILTER (WHERE id % 5 <> 0) AS ordered, count(*) FILTER (WHERE id % 5 <> 0 AND (id % 3 <> 0 OR n = 1)) AS ascending FROM c",
    "audit_structure": "SELECT (SELECT count(*) FROM (SELECT p_type FROM part UNION SELECT replace(p_brand, '#', '') FROM part UNION SELECT upper(p_type) FROM part UNION SELECT 'x')) AS distinct_genres, count(DISTINCT p_size) AS distinct_keywords, (SELECT count(*) FROM (SELECT p_size FROM part GROUP BY 1 HAVING count(*) = 1)) AS single_keywords, CAST(0 AS BIGINT) AS adult, count(*) AS in_collection, count(*) AS several_directors FROM part",
    "audit_list_sizes": f"WITH {_PART}, m AS (SELECT 'keywords' AS measure, 1.0 AS v FROM part UNION ALL SELECT 'genres', 1.0 FROM part UNION ALL SELECT 'cast', count(*) FROM cast_names GROUP BY id UNION ALL SELECT 'runtime', votes - 30 FROM pp WHERE votes > 30)" + ", " + _DESCRIBE.replace("WITH v AS (SELECT CAST(n_chars AS DOUBLE) AS x FROM documents WHERE n_chars IS NOT NULL), s AS (SELECT list(x ORDER BY x) AS a, count(*) AS n FROM v)", "s AS (SELECT measure, list(CAST(v AS DOUBLE) ORDER BY v) AS a, count(*) AS n FROM m GROUP BY measure)").replace("q AS (SELECT a, n,", "q AS (SELECT measure, a, n,").replace("SELECT n, round(a[1], 2) AS min", "SELECT measure, n, round(a[1], 2) AS min"),
    "exp_samples": _samples([("rep_D", 1.0, 1), ("selected", 0.44, 3)]),
    "exp_representation": _experiments([(f"rep_{k}", f, 1.0, 1, 5) for k, f in REPRESENTATIONS.items()]),
    "exp_genre_sweep": _experiments([(f"genre_w{w:g}", _ALL, w, 1, 5) for w in GENRE_WEIGHTS]),
    "exp_cast_k": _experiments([(f"cast_k{k}", _ALL, 1.0, 1, k) for k in CAST_SIZES]),
    "exp_ablation": _experiments([(f"drop_{f}", tuple(x for x in FIELDS if x != f), 1.0, 1, 5) for f in FIELDS]),
    "exp_single_field": _experiments([(f"only_{f}", (f,), 1.0, 1, 5) for f in FIELDS]),
    "exp_evidence": _experiments([(f"evidence_mt{m}", _ALL, 1.0, m, 5) for m in SHARED_TERMS]),
    "exp_stored": _experiments([("selected", _ALL, 0.44, 3, 5)]),
    "exp_selected": _experiments([("selected", _ALL, 0.44, 3, 5)]),
}
