"""SQL of sources, links, messages, approvals, chunks and searches; values are written out, not taken from ``rules``."""

from __future__ import annotations

from html.entities import name2codepoint

from .oracle import P, SCORED, _ACTIONS, _q
from .oracle_text import LABEL, TEXT, _strip

_LABEL = LABEL.format("jurisdiction")
_SOURCES = """('rbi-notifications', 'RBI Notifications', 'RBI', 'https://www.rbi.org.in/Scripts/NotificationUser.aspx', 'html', 'Circulars and notifications issued by the Reserve Bank of India.', 720, 'banking,india,circulars'),
('rbi-press-releases', 'RBI Press Releases', 'RBI', 'https://www.rbi.org.in/Scripts/BS_PressReleaseDisplay.aspx', 'html', 'Official press releases from the Reserve Bank of India.', 1440, 'banking,india,press'),
('sebi-legal-circulars', 'SEBI Legal Circulars', 'SEBI', 'https://www.sebi.gov.in/sebiweb/home/HomeAction.do?doListing=yes&sid=1&ssid=6&smid=0', 'html', 'Circulars published by the Securities and Exchange Board of India.', 720, 'securities,india,circulars'),
('fda-press-announcements', 'FDA Press Announcements', 'FDA', 'https://www.fda.gov/about-fda/contact-fda/stay-informed/rss-feeds/press-releases/rss.xml', 'rss', 'FDA press announcements RSS feed.', 360, 'healthcare,usa,press'),
('fda-federal-register', 'FDA Federal Register Rules', 'FDA', 'https://www.federalregister.gov/agencies/food-and-drug-administration', 'html', 'FDA rules and notices published in the US Federal Register.', 720, 'healthcare,usa,rules'),
('eu-ai-act-updates', 'EU AI Act Newsroom', 'EU_AI_ACT', 'https://digital-strategy.ec.europa.eu/en/policies/regulatory-framework-ai', 'html', 'Updates to the EU regulatory framework for artificial intelligence.', 1440, 'ai,eu,regulation')"""
_ADAPTERS = """('RBI', ['notificationuser.aspx', 'pressreleasedisplay.aspx', 'bs_circularindexdisplay.aspx', 'notification', 'id='], true),
('SEBI', ['/legal/', 'showdetail', '/sebiweb/home/detail', 'doarchive'], true),
('FDA', ['/news-events/', '/drugs/', '/documents/', '/regulatory-information/', 'federalregister.gov/documents/'], false),
('EU_AI_ACT', ['/news/', '/library/', '/policies/', '/news-redirect/', 'artificial-intelligence'], true)"""
_NAMED = "MAP {" + ", ".join(f"'&{name};': chr({code})" for name, code in name2codepoint.items()) + "}"
_ENTITIES = (
    "array_to_string(list_transform(regexp_extract_all({0}, '&#?[a-zA-Z0-9]+;|[^&]+|&'), lambda e: CASE WHEN e LIKE '&#%;' THEN chr(CAST(e[3:-2] AS INT)) "
    "ELSE coalesce(" + _NAMED.replace("{", "{{").replace("}", "}}") + "[e], e) END), '')"
)
_ONE_LINE = "regexp_replace(regexp_replace({0}, '[\\s\\x0B\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g'), '^ +| +$', '', 'g')"
_HREFS = """pages AS (SELECT DISTINCT id, url, jurisdiction, content FROM raw_documents WHERE content_format = 'html' AND content IS NOT NULL),
hrefs AS (SELECT id, url, jurisdiction, list_transform(regexp_extract_all(regexp_replace(content, '(?s)<!--.*?-->|<script.*?</script>', '', 'g'), '<a\\s[^>]*href="([^"]+)"', 1), lambda x: trim(replace(x, '&amp;', '&'))) AS h FROM pages)"""
# root-relative and absolute links are all there are
_LINKS = """links AS (SELECT id, url, jurisdiction, i, x, split_part(CASE WHEN x LIKE 'http%' THEN x ELSE regexp_extract(url, '^[a-z]+://[^/]+') || x END, '#', 1) AS link
 FROM (SELECT id, url, jurisdiction, unnest(h) AS x, generate_subscripts(h, 1) AS i FROM hrefs) WHERE NOT regexp_matches(lower(x), '^(mailto:|javascript:|tel:|#)'))"""
_HOST = "regexp_extract({0}, '^[a-z]+://([^/]+)', 1)"
_REASON = f"""concat_ws(chr(10), 'Risk level: ' || upper(risk_level) || printf(' (score: %.3f)', score), '',
 'Urgency signal: ' || coalesce(urgency, 'unknown') || printf(' (weight: %.2f)', urgency_score), 'Document type: ' || coalesce(doc_type, 'unknown') || printf(' (weight: %.2f)', doc_type_score),
 CASE WHEN keyword_score > 0 THEN printf('High-risk keywords detected (weight: %.2f)', keyword_score) END,
 CASE WHEN len(areas) > 0 THEN 'Impacted functions (' || len(areas) || '): ' || array_to_string(areas[1:5], ', ') END,
 CASE WHEN penalty_score > 0 THEN printf('Monetary penalty references detected (weight: %.2f)', penalty_score) END,
 CASE WHEN len(topic_names) > 0 THEN 'Topics: ' || array_to_string(topic_names[1:5], ', ') END, 'Jurisdiction: ' || {_LABEL}, 'Reference: ' || nullif(reference_number, ''))"""
_TITLED = TEXT["action_texts"].split("SELECT p.id, p.no, ")[1].split(" AS title")[0]
_TEMPLATES = TEXT["action_texts"].split("txt(key, tt, dd) AS ")[1].split("\nSELECT")[0]
_REVIEWED = f"""{SCORED}, {_ACTIONS}, txt(key, tt, dd) AS {_TEMPLATES},
act AS (SELECT p.id, p.no, p.priority, p.owner, {_TITLED} AS title FROM planned p JOIN txt USING (key) JOIN s ON s.id = p.id),
acts_of AS (SELECT id, count(*) AS n_actions, list({{'title': title, 'priority': priority, 'owner': owner}} ORDER BY no) AS actions FROM act GROUP BY id),
rv AS (SELECT s.*, n_actions, actions, risk_level IN ('high', 'critical') AS waits, {_REASON} AS rationale FROM s JOIN acts_of USING (id))"""
_SIGN = "CASE risk_level WHEN 'critical' THEN '🔴' WHEN 'high' THEN '🟠' WHEN 'medium' THEN '🟡' WHEN 'low' THEN '🟢' END"
_BODY = f"""concat_ws(chr(10), 'Document: ' || coalesce(title, ''), 'Jurisdiction: ' || {_LABEL}, 'Reference: ' || nullif(reference_number, ''), 'Risk: ' || upper(risk_level) || printf(' (score: %.2f)', score),
 chr(10) || 'Summary: ' || left(nullif(summary, ''), 500), CASE WHEN len(areas) > 0 THEN chr(10) || 'Impacted areas: ' || array_to_string(areas[1:5], ', ') END,
 chr(10) || 'Action items (' || n_actions || '):' || chr(10) || array_to_string(list_transform(actions[1:5], lambda a, i: '  ' || i || '. [' || a.priority || '] ' || left(a.title, 60) || ' -> ' || a.owner), chr(10)))"""
_PREFIX = " OR ".join(f"starts_with(x, '{p}')" for p in ("Title:", "Reference:", "Jurisdiction:"))
_LINES = r"regexp_split_to_array(t, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"
_WS = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]"
_PY = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]+"

# The chunker as a recursion over the starts of the windows.
_CHUNKS = f"""body AS (SELECT id, {_strip('clean_text')} AS t FROM {P} WHERE clean_text IS NOT NULL),
win AS (SELECT id, t, 0 AS a, {{0}} AS b FROM (SELECT id, t, 0 AS a FROM body WHERE t <> '')
 UNION ALL SELECT id, t, a, {{0}} FROM (SELECT id, t, greatest(b - 150, a + 1) AS a FROM win WHERE b < length(t))),
piece AS (SELECT id, a, b, {_strip('substr(t, a + 1, b - a)')} AS x FROM win),
chunk AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY a) - 1 AS INT) AS no, a, b, x FROM piece WHERE x <> '')"""
_LAST = "(1000 - list_position(list_reverse(string_split(replace(substr(t, a + 1, 1000), chr(10), ' '), '')), ' '))"
_END = f"CASE WHEN length(t) - a <= 1000 THEN length(t) WHEN coalesce({_LAST}, -1) >= 500 THEN a + {_LAST} ELSE a + 1000 END"
_CHUNKS = _CHUNKS.replace("{0}", _END)
_SEPARATED = r"regexp_replace(lower({0}), '[!-/:-@\[-`{{-~\n]', ' ', 'g')"


def _vectors(name: str, rows: str) -> str:
    """name AS (k, dim, v): non-zero entries of the unit vectors of rows (k, x)."""
    return f"""{name}_w AS (SELECT k, CAST('0x' || left(md5(w), 16) AS UBIGINT) AS h FROM (SELECT k, unnest(list_filter(regexp_split_to_array({_SEPARATED.format('x')}, '{_PY}'), lambda y: y <> '')) AS w FROM {rows})),
{name}_s AS (SELECT k, CAST(h % 256 AS INT) AS dim, CAST(sum(CASE WHEN h >= 9223372036854775808 THEN 1 ELSE -1 END) AS DOUBLE) AS v FROM {name}_w GROUP BY 1, 2 HAVING v <> 0),
{name} AS (SELECT k, dim, v / sqrt(sum(v * v) OVER (PARTITION BY k)) AS v FROM {name}_s)"""


_CITED = "coalesce(nullif(reference_number, ''), nullif(left(title, 60), ''), 'doc:' || left(id, 8)) || ' [' || jurisdiction || ']'"
_ASKED = "CAST('0x' || left(md5(id), 8) AS UBIGINT) % 50 = 0"


def _found(question: str, k: int) -> str:
    """found: the k best documents of each asked document's question, in its jurisdiction."""
    return f"""{_CHUNKS}, meta AS (SELECT * FROM {P}),
ck AS (SELECT c.id || ':' || no AS k, c.id, jurisdiction, x FROM chunk c JOIN meta USING (id)),
qs AS (SELECT id AS k, jurisdiction, {question} AS x FROM meta WHERE {_ASKED} AND {question} IS NOT NULL),
{_vectors('cv', 'ck')}, {_vectors('qv', 'qs')},
score0 AS (SELECT qs.k AS query_id, ck.k AS item_id, ck.id AS document_id, ck.x AS text FROM qs JOIN ck USING (jurisdiction)),
prod AS (SELECT qv.k AS query_id, cv.k AS item_id, sum(qv.v * cv.v) AS s FROM qv JOIN cv USING (dim) GROUP BY 1, 2),
full_ AS (SELECT z.*, round(coalesce(s, 0.0), 9) AS sim FROM score0 z LEFT JOIN prod USING (query_id, item_id)),
hit AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rank FROM full_),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS n FROM hit WHERE rank <= {3 * k} AND sim >= 0.1),
found AS (SELECT f.query_id, f.place, f.document_id, f.item_id, round(f.sim, 4) AS score, f.text, {_CITED.replace('left(id', 'left(m.id')} AS label
 FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS place FROM best WHERE n = 1) f JOIN meta m ON m.id = f.document_id WHERE place <= {k})"""


def _greedy(known: str, docs: str) -> str:
    """Sequential rule by recursion over the documents: the index is a list that grows."""
    return f"""fp AS (SELECT DISTINCT ON (doc_id) doc_id, created_at, lower(trim(content_hash)) AS content_hash, simhash FROM document_fingerprints
 WHERE simhash IS NOT NULL AND doc_id IS NOT NULL AND created_at IS NOT NULL ORDER BY doc_id, created_at DESC),
o AS (SELECT *, row_number() OVER (ORDER BY created_at, doc_id) AS i FROM fp WHERE {docs}),
k0 AS (SELECT coalesce(list({{'id': doc_id, 'h': content_hash, 's': simhash}} ORDER BY created_at, doc_id), []) AS idx FROM fp WHERE {known}),
r AS (SELECT CAST(0 AS BIGINT) AS i, idx, CAST(NULL AS VARCHAR) AS doc_id, CAST(NULL AS VARCHAR) AS ex, CAST(NULL AS STRUCT(d BIGINT, p BIGINT, id VARCHAR)) AS nr FROM k0
 UNION ALL SELECT i, CASE WHEN ex IS NULL AND nr IS NULL THEN list_append(idx, {{'id': doc_id, 'h': content_hash, 's': simhash}}) ELSE idx END, doc_id, ex, nr FROM (
  SELECT o.i, r.idx, o.doc_id, o.content_hash, o.simhash, list_filter(r.idx, lambda x: x.h = o.content_hash)[1].id AS ex,
   list_sort(list_filter(list_transform(r.idx, lambda x, p: {{'d': CAST(bit_count(xor(x.s, o.simhash)) AS BIGINT), 'p': CAST(p AS BIGINT), 'id': x.id}}), lambda y: y.d <= 6))[1] AS nr
  FROM r JOIN o ON o.i = r.i + 1) t)
SELECT doc_id, CASE WHEN nr IS NULL AND ex IS NULL THEN 'unique' WHEN ex IS NOT NULL THEN 'exact' ELSE 'near' END AS kind, CASE WHEN ex IS NOT NULL THEN ex ELSE nr.id END AS matched,
 round(CASE WHEN nr IS NULL AND ex IS NULL THEN 0.0 WHEN ex IS NOT NULL THEN 1.0 ELSE 1 - nr.d / 64.0 END, 6) AS similarity FROM r WHERE i > 0"""


MORE = {
    "bundled_sources": f"SELECT id, name, jurisdiction, url, source_type, description, true AS enabled, crawl_frequency_minutes, tags FROM (VALUES {_SOURCES}) t(id, name, jurisdiction, url, source_type, description, crawl_frequency_minutes, tags)",
    "source_jurisdictions": "SELECT DISTINCT jurisdiction FROM regulatory_sources WHERE enabled",
    "source_adapters": f"SELECT id, a.patterns IS NOT NULL AS has_adapter, CASE WHEN s.jurisdiction = 'RBI' THEN false ELSE a.same_host END AS same_host, CASE WHEN s.jurisdiction = 'RBI' THEN '/new/' ELSE array_to_string(a.patterns, ',') END AS patterns FROM regulatory_sources s LEFT JOIN (VALUES {_ADAPTERS}) a(jurisdiction, patterns, same_host) USING (jurisdiction)",
    "detect_format": "SELECT DISTINCT id AS mime, CASE WHEN starts_with(content, '%PDF-') THEN 'pdf' ELSE 'text' END AS detected FROM raw_documents UNION ALL SELECT * FROM (VALUES ('text/html; charset=utf-8', 'html'), ('Application/XHTML+XML', 'html'), ('application/pdf', 'pdf'), ('application/json;v=1', 'json'), ('text/xml', 'xml'), ('application/rss+xml', 'xml'), ('image/svg+xml', 'xml'), ('application/octet-stream', 'pdf'), ('text/plain', 'text'), ('', 'pdf'), ('none', 'text')) t(mime, detected)",
    "anchors": f"WITH {_HREFS} SELECT id, CAST(i - 1 AS INT) AS place, x AS href FROM (SELECT id, unnest(h) AS x, generate_subscripts(h, 1) AS i FROM hrefs)",
    "links_on_host": f"WITH {_HREFS}, {_LINKS}, k AS (SELECT id, count(DISTINCT link) AS n FROM links WHERE link <> url AND {_HOST.format('link')} = {_HOST.format('url')} GROUP BY 1) SELECT id, CAST(len(h) AS INT) AS n_anchors, CAST(least(coalesce(n, 0), 100) AS INT) AS n_links FROM hrefs LEFT JOIN k USING (id)",
    "anchors_normalized": f"WITH {_HREFS}, {_LINKS}, a(jurisdiction, patterns, same_host) AS (VALUES {_ADAPTERS}), f AS (SELECT id, link, min(i) AS i FROM links JOIN a USING (jurisdiction) WHERE link <> url AND (NOT same_host OR {_HOST.format('link')} = {_HOST.format('url')}) AND len(list_filter(patterns, lambda p: contains(lower(link), p))) > 0 GROUP BY 1, 2), n AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS INT) AS place, link FROM f) SELECT * FROM n WHERE place < 100",
    "feed_links": "SELECT DISTINCT id, CAST(len(regexp_extract_all(content, '(?s)<item>(?:<title>[^<]*</title>)?<link>')) AS INT) AS n_links FROM raw_documents WHERE content_format = 'xml'",
    "html_titles": f"WITH p AS (SELECT DISTINCT id, regexp_replace(content, '(?is)<!--.*?-->|<(script|style|noscript|template|svg)\\b.*?</(script|style|noscript|template|svg)>', '', 'g') AS c FROM raw_documents WHERE content_format = 'html') SELECT id, nullif({_ONE_LINE.format(_ENTITIES.format(chr(39) * 0 + 'regexp_extract(c, ' + _q('(?is)<title>(.*?)</title>') + ', 1)'))}, '') AS title, array_to_string(list_filter(list_transform(regexp_extract_all(c, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), lambda x: {_ONE_LINE.format(_ENTITIES.format('regexp_replace(x, ' + _q('<[^>]*>') + ', ' + _q('') + ', ' + _q('g') + ')'))}), lambda x: x <> ''), ' | ') AS headings FROM p",
    "parse_dispatch": f"WITH p AS (SELECT DISTINCT id, content_format, content FROM raw_documents), t AS (SELECT *, CASE WHEN content_format = 'pdf' THEN '' WHEN content_format IN ('html', 'xml') THEN {_strip(_ENTITIES.format('regexp_replace(content, ' + _q('(?is)<!--.*?-->|<(script|style|noscript|template|svg|title)(?:[ ][^>]*)?>.*?</(script|style|noscript|template|svg|title)>|<[^>]*>') + ', ' + _q('') + ', ' + _q('g') + ')'))} ELSE {_strip('content')} END AS x FROM p) SELECT id, content_format, CASE WHEN coalesce(x, '') = '' THEN 'no text in ' || content_format || ' page' END AS error FROM t",
    "first_holders": "WITH fp AS (SELECT DISTINCT ON (doc_id) doc_id, created_at, lower(trim(content_hash)) AS content_hash FROM document_fingerprints WHERE simhash IS NOT NULL AND doc_id IS NOT NULL AND created_at IS NOT NULL ORDER BY doc_id, created_at DESC) SELECT content_hash, arg_min(doc_id, {'a': created_at, 'b': doc_id}) AS doc_id FROM fp GROUP BY 1",
    "dedup_greedy": f"WITH RECURSIVE {_greedy('false', 'true')}",
    "dedup_known": f"WITH RECURSIVE {_greedy(chr(39).join(['created_at < TIMESTAMPTZ ', '2026-03-01 00:00:00+00', '']), chr(39).join(['created_at >= TIMESTAMPTZ ', '2026-03-01 00:00:00+00', '']))}",
    "risk_rationale": f"WITH {SCORED} SELECT id, {_REASON} AS rationale, array_to_string(areas, ',') AS areas FROM s",
    "approval_requests": f"""WITH {_REVIEWED} SELECT sha256('approval|' || id) AS approval_id, id AS document_id, sha256('assessment|' || id) AS assessment_id, 'r1' AS run_id, CASE WHEN waits THEN 'pending' ELSE 'approved' END AS status,
 CASE WHEN waits THEN title ELSE coalesce(title, 'Untitled') END AS title, CASE WHEN waits THEN summary END AS summary, CAST(n_actions AS INT) AS action_count, CASE WHEN NOT waits THEN 'auto' END AS decided_by, CASE WHEN NOT waits THEN 'Auto-approved: risk below threshold' END AS decision_note,
 CASE WHEN NOT waits THEN '2026-06-01 00:00' END AS decided_at, CASE WHEN waits THEN '2026-06-04 00:00' END AS expires_at, CASE WHEN waits THEN score END AS score, CASE WHEN waits THEN md5(left(rationale, 2000)) END AS rationale_md5,
 CASE WHEN waits THEN array_to_string(list_transform(actions[1:10], lambda a: a.title || '/' || a.priority || '/' || a.owner), '; ') END AS actions FROM rv""",
    "pending_approvals": f"WITH {_REVIEWED} SELECT id AS document_id, risk_level, title FROM rv WHERE waits",
    "approved_documents": f"WITH {SCORED} SELECT id AS document_id, risk_level NOT IN ('high', 'critical') AS approved FROM s",
    "approval_latest": f"WITH {SCORED}, req AS (SELECT sha256('approval|' || id) AS approval_id, risk_level, CASE WHEN risk_level IN ('high', 'critical') THEN 'pending' ELSE 'approved' END AS status FROM s) SELECT risk_level, CASE WHEN status = 'approved' THEN 'approved' WHEN approval_id < '4' THEN 'approved' WHEN approval_id < '8' THEN 'rejected' ELSE 'expired' END AS status, count(*) AS n FROM req GROUP BY 1, 2",
    "run_audit": f"""WITH {_REVIEWED}, ev AS (SELECT 'document.fetched' AS event_type, 'raw_document' AS entity_type, 'crawler' AS actor, NULL AS risk_level, id AS e FROM rv UNION ALL SELECT 'document.parsed', 'parsed_document', 'parser', NULL, id FROM rv
 UNION ALL SELECT 'document.classified', 'parsed_document', 'classifier', NULL, id FROM rv UNION ALL SELECT 'risk.assessed', 'risk_assessment', 'risk_agent', risk_level, id FROM rv UNION ALL SELECT 'action.created', 'action_item', 'planner', NULL, id || no FROM act
 UNION ALL SELECT CASE WHEN waits THEN 'approval.requested' ELSE 'approval.granted' END, 'approval', CASE WHEN waits THEN 'pipeline' ELSE 'auto' END, risk_level, id FROM rv) SELECT event_type, entity_type, actor, risk_level, count(*) AS n, count(DISTINCT e) AS n_entities FROM ev GROUP BY 1, 2, 3, 4""",
    "notify_single": f"WITH {_REVIEWED} SELECT id, {_SIGN} || ' [' || upper(risk_level) || '] ' || left(coalesce(title, ''), 80) AS subject, {_BODY} AS body FROM rv",
    "notify_routed": f"WITH {SCORED} SELECT c AS to_channel, risk_level, count(*) AS n FROM s, (VALUES ('slack'), ('email')) v(c) WHERE risk_level <> 'critical' OR c = 'slack' GROUP BY 1, 2",
    "notify_digest": f"""WITH {_REVIEWED}, n AS (SELECT *, row_number() OVER (PARTITION BY risk_level ORDER BY parsed_at, id) AS n FROM rv),
 l AS (SELECT risk_level, CASE risk_level WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END AS o, {_SIGN} || ' ' || upper(risk_level) || ' (' || count(*) || '):' || chr(10) ||
  string_agg('  - ' || left(coalesce(title, ''), 50) || coalesce(' [' || nullif(reference_number, '') || ']', '') || ' (' || n_actions || ' actions)', chr(10) ORDER BY n) FILTER (WHERE n <= 10) || chr(10) AS part FROM n GROUP BY 1)
 SELECT 'Regulatory Digest (2026-06-01 00:00 UTC) - ' || (SELECT count(*) FROM s) || ' document(s), 3 duplicate(s)' AS subject,
  'Pipeline run: r1' || chr(10) || 'Processed: ' || (SELECT count(*) FROM s) || ' | Duplicates: 3 | Errors: 0' || chr(10) || chr(10) || string_agg(part, chr(10) ORDER BY o) AS body FROM l""",
    "summaries": f"""WITH q AS (SELECT id, concat_ws(chr(10), 'Title: ' || nullif(title, ''), 'Reference: ' || nullif(reference_number, ''), 'Jurisdiction: ' || {_LABEL}, '', clean_text) AS t FROM {P} WHERE clean_text IS NOT NULL),
b AS (SELECT id, t, array_to_string(list_filter({_LINES}, lambda x: NOT ({_PREFIX})), chr(10)) AS body FROM q),
c AS (SELECT *, list_filter(list_transform(regexp_split_to_array(body, '[.!?]+'), lambda x: {_strip('x')}), lambda x: x <> '') AS sents FROM b)
SELECT id, coalesce(list_filter(list_transform({_LINES}, lambda x: {_strip('x')}), lambda x: x <> '' AND length(x) <= 200 AND NOT ({_PREFIX}))[1], {_strip('left(t, 100)')}) AS headline,
 md5(left(CASE WHEN len(sents) > 0 THEN array_to_string(sents[1:3], '. ') || '.' ELSE left(body, 200) END, 4000)) AS summary_md5,
 array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(body), '{_WS}+'), lambda x: length(x) > 4 AND regexp_full_match(x, '\\p{{L}}+'))))[1:5], ',') AS tags,
 md5(array_to_string(sents[1:3], '|')) AS changes_md5, CAST(len(list_filter(regexp_split_to_array(t, '{_WS}+'), lambda x: x <> '')) AS INT) AS prompt_tokens FROM c""",
    "text_chunks": f"WITH RECURSIVE {_CHUNKS} SELECT id, no AS chunk_no, CAST(a AS INT) AS start, CAST(b AS INT) AS \"end\", md5(x) AS text_md5 FROM chunk",
    "document_index": f"WITH RECURSIVE {_CHUNKS} SELECT c.id || ':' || no AS item_id, c.id AS document_id, jurisdiction, no AS chunk_index, title, reference_number, md5(x) AS text_md5 FROM chunk c JOIN {P} p USING (id)",
    "embed_texts": f"WITH t AS (SELECT id AS k, clean_text AS x FROM {P} WHERE clean_text IS NOT NULL), {_vectors('v', 't')} SELECT k AS id, dim, round(v, 6) AS value FROM v",
    "document_search": f"WITH RECURSIVE {_found('title', 5)} SELECT query_id, place, document_id, item_id, score, label FROM found",
    "rationale_in_context": f"""WITH RECURSIVE {_found("coalesce(nullif(title, ''), left(clean_text, 200))", 3)}, {SCORED}, c AS (SELECT query_id AS id, string_agg('[' || place || '] ' || label || printf(' (similarity: %.3f)', score) || chr(10) || '    ' || left(text, 200), chr(10) ORDER BY place) AS cited FROM found GROUP BY 1)
SELECT id, {_REASON} || coalesce(chr(10) || chr(10) || '--- Related historical documents ---' || chr(10) || cited, '') AS rationale FROM s LEFT JOIN c USING (id) WHERE {_ASKED}""",
    "boilerplate_strip": "WITH n AS (" + TEXT["whitespace_normalize"].replace("md5(", "(", 1).replace("AS text_md5", "AS t") + r"""), l AS (SELECT id, t, string_split(t, chr(10)) AS ls FROM n),
o AS (SELECT *, list_filter(list_distinct(ls), lambda x: length(x) BETWEEN 1 AND 80 AND len(list_filter(ls, lambda y: y = x)) >= 3) AS often FROM l),
k AS (SELECT *, list_filter(ls, lambda x: NOT list_contains(often, x) AND NOT regexp_matches(trim(x), '(?i)^(skip to (main )?content|back to top|©.*|(\(c\)|copyright)($|[^\p{L}\p{N}_]).*|all rights reserved\.?|page \d+( of \d+)?|\d+\s*/\s*\d+|privacy policy|terms (of use|and conditions)|cookies? (policy|notice|settings)|(we use cookies|this (site|website) uses cookies)($|[^\p{L}\p{N}_]).*|accept( all)?( cookies)?|loading\.{0,3}|home|menu|search|login|sign in|register|print(ed)?( this page| from .*)?|download(ed)?( from .*)?|share (this|on) .*|last updated:?.*)$')) AS kept FROM o)
SELECT id, CAST(len(ls) - len(kept) AS INT) AS removed, md5(regexp_replace(regexp_replace(array_to_string(kept, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x0B\x1c-\x1f\x{85}\p{Z}]+|[\s\x0B\x1c-\x1f\x{85}\p{Z}]+$', '', 'g')) AS text_md5 FROM k""",
}
