"""SQL with the same results as ``queries.py``, for DuckDB."""

from __future__ import annotations

from .. import rules

P = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY parsed_at DESC NULLS LAST) AS rn__ FROM parsed_documents) WHERE rn__ = 1)"
A = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) AS rn__ FROM audit_log) WHERE rn__ = 1)"
M = "(SELECT DISTINCT ON (id) * FROM pipeline_state)"
SECOND = "strftime(parsed_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')"
WORD = r"[\p{L}\p{N}_]"


def _bounded(pattern: str) -> str:
    """A Java pattern with \\b at its ends, for an engine whose \\b knows ASCII only."""
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b")
    return rf"(^|[^\p{{L}}\p{{N}}_])(?:{inner})($|[^\p{{L}}\p{{N}}_])"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _hits(words) -> str:
    return " + ".join(f"CAST(contains(low, {_q(w)}) AS INT)" for w in words)


def _entries(table, factor, label) -> str:
    rows = ", ".join(f"{{'i': {i}, 'name': {_q(n)}, 'score': round(least(({_hits(w)}) / {float(max(factor * len(w), 1.0))}, 1.0), 3)}}" for i, (n, w) in enumerate(table))
    return f"list_filter([{rows}], lambda x: x.score > 0) AS {label}"


_DOC_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(low, {_q(_bounded(chr(92) + 'b' + n + chr(92) + 'b'))}) THEN {_q(n)}" for n in rules.DOC_TYPES) + " END"
_URGENCY = (
    f"CASE WHEN regexp_matches(clean_text, {_q('(?i)' + _bounded(rules.URGENT))}) THEN 'immediate' "
    f"WHEN regexp_matches(clean_text, {_q('(?i)' + _bounded(rules.NEAR_TERM.replace(chr(92) + 'w', WORD)))}) THEN 'near-term' ELSE 'routine' END"
)
_JUR = ", ".join(
    f"{{'i': CASE WHEN ({_hits(w)}) > 0 THEN {i} ELSE {i + 10} END, 'name': {_q(n)}, 'score': CASE WHEN ({_hits(w)}) > 0 THEN "
    f"round(least(least(({_hits(w)}) / {float(max(rules.JURISDICTION_FACTOR * len(w), 1.0))}, 1.0) + CASE WHEN jurisdiction = {_q(n)} THEN 0.2 ELSE 0.0 END, 1.0), 3) "
    f"WHEN jurisdiction = {_q(n)} THEN 0.5 ELSE 0.0 END}}"
    for i, (n, w) in enumerate(rules.JURISDICTION_WORDS)
)
_KEYWORDS = " + ".join(f"CASE WHEN regexp_matches(clean_text, {_q('(?i)' + _bounded(p))}) THEN {w} ELSE 0.0 END" for p, w in rules.HIGH_RISK)


def _case(column, table, none) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in table.items()) + f" ELSE {none} END"


SCORED = f"""
c0 AS (SELECT *, lower(clean_text) AS low FROM {P} WHERE clean_text IS NOT NULL),
c1 AS (SELECT *, {_entries(rules.TOPICS, rules.TOPIC_FACTOR, 'topics')}, {_entries(rules.FUNCTIONS, rules.FUNCTION_FACTOR, 'functions')},
       list_filter([{_JUR}], lambda x: x.score > 0) AS jurs, {_DOC_TYPE} AS doc_type, {_URGENCY} AS urgency FROM c0),
c2 AS (SELECT *, CAST({_case('urgency', rules.URGENCY_SCORES, rules.URGENCY_NONE)} AS DOUBLE) AS urgency_score, CAST({_case('doc_type', rules.DOC_TYPE_SCORES, rules.DOC_TYPE_NONE)} AS DOUBLE) AS doc_type_score,
       CAST({_KEYWORDS} AS DOUBLE) / 11.0 AS keyword_score, CAST(least(len(functions) / 4.0, 1.0) AS DOUBLE) AS scope_score,
       CAST(least(0.4 * len(regexp_extract_all(clean_text, {_q('(?i)' + rules.AMOUNT)})), 1.0) AS DOUBLE) AS penalty_score FROM c1),
c3 AS (SELECT *, round(least(greatest(0.25 * urgency_score + 0.15 * doc_type_score + 0.30 * keyword_score + 0.15 * scope_score + 0.15 * penalty_score, 0.0), 1.0), 4) AS score FROM c2),
s AS (SELECT *, CASE WHEN score < 0.25 THEN 'low' WHEN score < 0.5 THEN 'medium' WHEN score < 0.75 THEN 'high' ELSE 'critical' END AS risk_level,
      round(least((CAST(urgency_score > 0.1 AS INT) + CAST(doc_type_score > 0.1 AS INT) + CAST(keyword_score > 0.1 AS INT) + CAST(scope_score > 0.1 AS INT)) / 4.0 + CASE WHEN len(topics) > 0 THEN 0.1 ELSE 0.0 END, 1.0), 3) AS confidence,
      list_transform(list_sort(list_transform(functions, lambda x: {{'n': -x.score, 'i': x.i, 'name': x.name}})), lambda x: x.name) AS areas,
      list_transform(list_sort(list_transform(topics, lambda x: {{'n': -x.score, 'i': x.i, 'name': x.name}})), lambda x: x.name) AS topic_names FROM c3)"""


def _exploded(column) -> str:
    return (
        f"WITH {SCORED} SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY x.score DESC, x.i) - 1 AS INT) AS place, x.name AS name, CAST(x.score AS DOUBLE) AS value "
        f"FROM (SELECT id, unnest({column}) AS x FROM s)"
    )


_ACTIONS = f"""
acts AS (SELECT id, risk_level, urgency, list_distinct_keep FROM (SELECT *, list_filter([
  CASE WHEN risk_level IN ('critical', 'high') THEN 'escalation' END, CASE WHEN risk_level IN ('critical', 'high', 'medium') THEN 'review' END,
  CASE WHEN risk_level IN ('critical', 'high', 'medium') THEN 'gap_analysis' END, CASE WHEN risk_level IN ('critical', 'high') THEN 'policy_update' END,
  CASE WHEN risk_level = 'low' THEN 'acknowledgement' END, CASE WHEN list_contains(areas, 'Technology') THEN 'system_change' END,
  CASE WHEN list_contains(areas, 'HR / Training') OR risk_level IN ('critical', 'high') THEN 'training' END,
  CASE WHEN doc_type IN ('circular', 'notification') AND list_contains(topic_names, 'reporting requirements') THEN 'reporting' END], lambda x: x IS NOT NULL) AS list_distinct_keep FROM s)),
tpl(key, owner, days) AS (VALUES {', '.join(f"({_q(k)}, {_q(o)}, {d})" for k, o, d, _, _ in rules.ACTIONS)}),
items AS (SELECT id, risk_level, urgency, unnest(list_distinct_keep) AS key, CAST(generate_subscripts(list_distinct_keep, 1) - 1 AS INT) AS no FROM acts),
planned AS (SELECT id, no, key, owner, CASE WHEN risk_level = 'critical' THEN 'urgent' ELSE risk_level END AS priority,
  DATE '2026-06-01' + CAST(greatest(1, floor(days * CASE urgency WHEN 'immediate' THEN 0.3 WHEN 'near-term' THEN 0.6 ELSE 1.0 END + 1e-9)) AS INT) AS due_date FROM items JOIN tpl USING (key))"""

_APPROVAL = f"""
req AS (SELECT sha256('approval|' || id) AS approval_id, id AS document_id, risk_level, CASE WHEN risk_level IN ('high', 'critical') THEN 'pending' ELSE 'approved' END AS status,
  CASE WHEN risk_level IN ('high', 'critical') THEN NULL ELSE 'auto' END AS decided_by FROM s)"""

_STRIP = r"regexp_replace({0}, '^[\s\x0B\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x0B\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g')"
_HASH = r"sha256(regexp_replace(regexp_replace(lower(clean_text), '[\s\x0B\x{85}\p{Z}]+', ' ', 'g'), '^ +| +$', '', 'g'))"
_UNIT = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_SIMS = f"""
e AS (SELECT vec_id, label, {_UNIT} AS v FROM embeddings),
sims AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, q.label AS ql, i.label AS il, round(list_cosine_similarity(q.v, i.v), 9) AS sim FROM e q JOIN e i ON q.vec_id % 50 = 0)"""
_RAG = f"""{_SIMS},
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rank, round(sim, 4) AS score FROM sims),
k AS (SELECT *, CAST(floor(item_id / 3) AS BIGINT) AS doc FROM h WHERE rank <= 15 AND score >= 0.1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY rank) AS n FROM k) WHERE n = 1),
r AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS place FROM b) WHERE place <= 5)"""
_STAGES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(rules.STAGES))

ORACLE = {
    "flagship_risk_by_jurisdiction": f"WITH {SCORED} SELECT jurisdiction, risk_level, count(*) AS n_documents, round(avg(score), 4) AS avg_score, max(score) AS max_score FROM s GROUP BY 1, 2",
    "source_registry": "SELECT jurisdiction, count(*) AS n_sources, min(id) AS first_id, CAST(sum(crawl_frequency_minutes) AS BIGINT) AS minutes FROM regulatory_sources WHERE enabled GROUP BY 1",
    "feed_or_page": "SELECT DISTINCT r.id, coalesce(s.source_type = 'rss', false) OR coalesce(r.content_format = 'xml', false) AS is_feed FROM raw_documents r LEFT JOIN regulatory_sources s ON s.id = r.source_id",
    "adapter_match": "SELECT DISTINCT id, CASE jurisdiction "
    + " ".join(f"WHEN '{k}' THEN coalesce({' OR '.join(f'contains(lower(url), {_q(x)})' for x in p)}, false)" for k, (p, _) in rules.ADAPTERS.items())
    + " ELSE false END AS matches, CASE jurisdiction "
    + " ".join(f"WHEN '{k}' THEN {str(s).lower()}" for k, (_, s) in rules.ADAPTERS.items())
    + " END AS same_host FROM raw_documents",
    "raw_store": "SELECT source_id, sha256(content) AS byte_hash, min(jurisdiction) AS jurisdiction FROM raw_documents WHERE content IS NOT NULL GROUP BY 1, 2",
    "stored_already": "WITH h AS (SELECT id, source_id, sha256(content) AS b, fetched_at FROM raw_documents) SELECT id FROM (SELECT DISTINCT id, source_id, b FROM h WHERE fetched_at >= TIMESTAMPTZ '2026-01-01 00:00:00+00') n WHERE EXISTS (SELECT 1 FROM h o WHERE o.fetched_at < TIMESTAMPTZ '2026-01-01 00:00:00+00' AND o.source_id = n.source_id AND o.b = n.b)",
    "upsert_parsed": f"SELECT id, status, {SECOND} AS parsed_at FROM {P}",
    "normalized_content_hash": f"SELECT id, {_HASH} AS hash FROM {P}",
    "exact_duplicates": f"SELECT {_HASH} AS hash, count(*) AS n, min(id) AS first_id FROM {P} GROUP BY 1 HAVING count(*) > 1",
    "raw_content_hash": "SELECT content_format, count(*) AS n, CAST(count(*) FILTER (WHERE sha256(content) = lower(content_hash)) AS BIGINT) AS n_same FROM raw_documents WHERE content_hash IS NOT NULL GROUP BY 1",
    "fingerprint_lookup": f"SELECT id, count(DISTINCT doc_id) AS n_known FROM (SELECT id, {_HASH} AS hash FROM {P}) JOIN (SELECT lower(trim(content_hash)) AS hash, doc_id FROM document_fingerprints) USING (hash) GROUP BY 1",
    "near_dup_pairs": "WITH f AS (SELECT DISTINCT ON (doc_id) doc_id, simhash FROM document_fingerprints WHERE simhash IS NOT NULL AND created_at IS NOT NULL AND doc_id IS NOT NULL ORDER BY doc_id, created_at DESC), g AS (SELECT simhash, count(*) AS n FROM f GROUP BY 1) SELECT printf('%016x', x.simhash) AS a, printf('%016x', y.simhash) AS b, CAST(bit_count(xor(x.simhash, y.simhash)) AS INT) AS distance, x.n AS n_a, y.n AS n_b FROM g x JOIN g y ON x.simhash < y.simhash AND bit_count(xor(x.simhash, y.simhash)) <= 6",
    "topics": _exploded("topics"),
    "business_functions": _exploded("functions"),
    "jurisdiction_confidence": _exploded("jurs"),
    "document_class": f"WITH {SCORED} SELECT id, doc_type, urgency, topic_names[1] AS primary_topic, areas[1] AS primary_function FROM s",
    "risk_signals": f"WITH {SCORED} SELECT id, round(urgency_score, 6) AS urgency_score, round(doc_type_score, 6) AS doc_type_score, round(keyword_score, 6) AS keyword_score, round(scope_score, 6) AS scope_score, round(penalty_score, 6) AS penalty_score, score, risk_level, confidence FROM s",
    "action_items": f"WITH {SCORED}, {_ACTIONS} SELECT id, no, key, owner, priority, strftime(due_date, '%Y-%m-%d') AS due_date FROM planned",
    "actions_by_owner": f"WITH {SCORED}, {_ACTIONS} SELECT owner, priority, count(*) AS n FROM planned GROUP BY 1, 2",
    "notify_unsent": f"WITH {SCORED} SELECT risk_level, count(*) AS n FROM s WHERE NOT substr(id, 1, 1) < '8' GROUP BY 1",
    "citation_labels": f"SELECT id, coalesce(nullif(reference_number, ''), nullif(left(title, 60), ''), 'doc:' || left(id, 8)) || ' [' || jurisdiction || ']' AS label FROM {P}",
    "vector_topk": f"WITH {_SIMS} SELECT query_id, item_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rank, round(sim, 4) AS score FROM sims) WHERE rank <= 10",
    "vector_topk_filtered": f"WITH {_SIMS} SELECT query_id, item_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rank, round(sim, 4) AS score FROM sims WHERE ql = il) WHERE rank <= 5",
    "vector_topk_postfilter": f"WITH {_SIMS}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rank, round(sim, 4) AS score FROM sims), g AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS place FROM h WHERE rank <= 50 AND ql = il) SELECT query_id, item_id, score, place FROM g WHERE place <= 5",
    "rag_search": f"WITH {_RAG} SELECT query_id, doc, item_id, score, place FROM r",
    "rag_summary": f"WITH {_RAG} SELECT query_id, max(score) AS top_score, count(*) AS n_results FROM r GROUP BY 1",
    "rag_context": f"WITH {_RAG} SELECT query_id, string_agg('[' || place || '] doc:' || doc || printf(' (score: %.3f)', score) || chr(10) || 'chunk ' || item_id, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS context FROM r GROUP BY 1",
    "point_get": f"SELECT id, title, status FROM {P} WHERE id = (SELECT min(id) FROM parsed_documents)",
    "list_recent": f"SELECT id, {SECOND} AS parsed_at, status FROM (SELECT * FROM {P} WHERE jurisdiction = 'RBI' ORDER BY parsed_at DESC, id LIMIT 100)",
    "audit_latest": f"SELECT id, entity_id, json_extract_string(payload, '$.risk_level') AS risk_level FROM {A} WHERE event_type = 'risk.assessed' ORDER BY id DESC LIMIT 100",
    "audit_by_type": f"SELECT event_type, entity_type, count(*) AS n, count(DISTINCT entity_id) AS n_entities FROM {A} GROUP BY 1, 2",
    "stage_counts": f"SELECT stage_no, t.stage, count(DISTINCT document_id) AS n_documents FROM (VALUES {_STAGES}) t(stage_no, stage) LEFT JOIN {M} m ON m.stage = t.stage GROUP BY 1, 2",
    "last_run": "SELECT max_by(run_id, id) AS run_id FROM pipeline_state",
    "documents_at_stage": f"SELECT run_id, stage, count(DISTINCT document_id) AS n_documents FROM {M} GROUP BY 1, 2",
    "skip_completed": "SELECT DISTINCT id AS document_id FROM raw_documents WHERE id NOT IN (SELECT document_id FROM pipeline_state WHERE stage = 'actions_planned' AND document_id IS NOT NULL)",
    "stage_markers": f"WITH st(n, stage) AS (VALUES {_STAGES}), l AS (SELECT document_id, max(n) AS n FROM pipeline_state JOIN st USING (stage) GROUP BY 1) SELECT st.stage, count(*) AS n FROM l JOIN st ON st.n <= l.n GROUP BY 1",
    "stored_counters": "WITH raw AS (SELECT DISTINCT id AS rid FROM raw_documents), p AS (SELECT raw_document_id AS rid, min(id) AS id FROM parsed_documents GROUP BY 1), fp AS (SELECT doc_id AS id, min(lower(trim(content_hash))) AS h FROM document_fingerprints GROUP BY 1), d AS (SELECT id FROM fp JOIN (SELECT h, min(id) AS keep FROM fp GROUP BY 1) USING (h) WHERE id <> keep) SELECT CAST(count(*) FILTER (WHERE p.id IS NOT NULL AND d.id IS NULL) AS BIGINT) AS processed, CAST(count(*) FILTER (WHERE d.id IS NOT NULL) AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS errors FROM raw LEFT JOIN p USING (rid) LEFT JOIN d ON d.id = p.id",
    "punctuation_map": f"SELECT id, md5(regexp_replace(replace(translate(clean_text, {_q(rules.PUNCTUATION_FROM)}, {_q(rules.PUNCTUATION_TO)}), '…', '...'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')) AS text_md5 FROM {P}",
    "nfc_normalize": f"SELECT id, md5(nfc_normalize(clean_text)) AS text_md5 FROM {P}",
    "stream_notifications": "SELECT DISTINCT entity_id, event_type FROM audit_log WHERE event_type IN ('risk.assessed', 'action.created') AND entity_id IS NOT NULL",
    "language_detect": None,
}
_TOK = r"regexp_extract_all(lower(clean_text), '[\p{L}\p{N}_]+')"
_SH = "CASE WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) ELSE list_distinct(w) END"
_SPLIT = r"list_filter(regexp_split_to_array(clean_text, '[\s\x0B\x{85}\p{Z}]+'), lambda x: x <> '')"
ORACLE["word_and_shingle_counts"] = (
    f"WITH t AS (SELECT id, {_TOK} AS w, {_SPLIT} AS s FROM {P}) SELECT id, CAST(len(s) AS INT) AS n_words, CAST(len(w) AS INT) AS n_tokens, CAST(len({_SH.format(k=3)}) AS INT) AS n_shingles FROM t"
)
ORACLE["simhash_md5"] = (
    f"WITH t AS (SELECT id, {_TOK} AS w FROM {P}), h AS (SELECT id, CAST('0x' || left(md5(x), 16) AS UBIGINT) AS h FROM (SELECT id, unnest({_SH.format(k=2)}) AS x FROM t)), "
    "v AS (SELECT id, b, sum(CAST((h >> b) & 1 AS INT) * 2 - 1) AS v FROM h, range(0, 64) r(b) GROUP BY 1, 2), "
    "f AS (SELECT id, CAST(sum(CASE WHEN v > 0 THEN CAST(1 AS HUGEINT) << CAST(b AS INT) ELSE 0 END) AS UBIGINT) AS s FROM v GROUP BY 1) "
    f"SELECT p.id, printf('%016x', coalesce(s, CAST(0 AS UBIGINT))) AS simhash_hex FROM {P} p LEFT JOIN f USING (id)"
)
ORACLE["jaccard_pairs"] = (
    "WITH d AS (SELECT doc_id, title, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents WHERE title IS NOT NULL AND text IS NOT NULL AND text <> ''), "
    "f AS (SELECT title, min(doc_id) AS first_id FROM d GROUP BY 1) SELECT d.doc_id, f.first_id, round(len(list_intersect(d.w, e.w)) / len(list_distinct(list_concat(d.w, e.w))), 6) AS jaccard "
    "FROM d JOIN f USING (title) JOIN d e ON e.doc_id = f.first_id WHERE d.doc_id > f.first_id"
)
ORACLE["reference_number"] = (
    "SELECT id, left(regexp_replace(coalesce("
    + ", ".join(f"nullif(regexp_extract(clean_text, {_q('(?i)' + p)}, {g}), '')" for p, g in rules.REFERENCES)
    + f"), '[.,;]+$', ''), 256) AS reference FROM {P}"
)
_WORDS = {k: "[" + ", ".join(_q(w) for w in v) + "]" for k, v in rules.STOPWORDS.items()}
_SCRIPT = {n: f"len(regexp_extract_all(t, '[\\x{{{a}}}-\\x{{{b}}}]')) - len(regexp_extract_all(t, '[\\x{{{a}}}-\\x{{{b}}}]')) + len(list_filter(regexp_extract_all(t, '\\p{{L}}'), lambda x: ord(x) BETWEEN {int(a, 16)} AND {int(b, 16)}))" for n, a, b in rules.SCRIPTS}
ORACLE["language_detect"] = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), "
    "w AS (SELECT doc_id, len(regexp_extract_all(t, '\\p{L}')) AS letters, regexp_extract_all(lower(t), '[a-zà-öø-ÿ]+') AS w, "
    + ", ".join(f"{e} AS s_{n}" for n, e in _SCRIPT.items())
    + " FROM d), "
    + "h AS (SELECT *, greatest("
    + ", ".join(f"s_{n}" for n in _SCRIPT)
    + ") AS top, "
    + ", ".join(f"len(list_filter(w, lambda x: list_contains({v}, x))) AS h_{k}" for k, v in _WORDS.items())
    + " FROM w), b AS (SELECT *, greatest("
    + ", ".join(f"h_{k}" for k in _WORDS)
    + ") AS best FROM h) SELECT doc_id, CASE WHEN letters > 0 AND top > 0 AND top >= 0.3 * letters THEN CASE "
    + " ".join(f"WHEN s_{n} = top THEN '{n}'" for n in _SCRIPT)
    + " END WHEN best = 0 THEN 'en' "
    + " ".join(f"WHEN h_{k} = best THEN '{k}'" for k in _WORDS)
    + " END AS language, CASE WHEN letters > 0 AND top > 0 AND top >= 0.3 * letters THEN 0.9 WHEN len(w) = 0 THEN 0.0 ELSE CAST(round_even(least(4.0 * best / len(w), 1.0), 3) AS DOUBLE) END AS confidence FROM b"
)
