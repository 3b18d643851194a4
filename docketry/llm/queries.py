"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding, increments, language, leakage, mainbody, mixing, sitelines, splitting, truncation
from .common import new_folder

SINCE = "2026-03-01"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark, sf):
    return mainbody.main_body(_t(spark, sf, "raw_documents")).select("id", "block_md5").distinct()


def p1_main_text(spark, sf):
    """Per page: number of blocks and characters of its main body."""
    body = mainbody.main_body(_t(spark, sf, "raw_documents").dropDuplicates(["id"]))
    return body.groupBy("id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("block")).alias("n_chars"))


def _checked_batches(spark, sf):
    """The history goes into an index, the incoming days are checked against it and each other."""
    texts = _t(spark, sf, "parsed_documents").where("clean_text is not null").select(F.col("id").alias("doc_id"), "clean_text")
    days = increments.first_days(_t(spark, sf, "document_fingerprints"))
    since = F.to_date(F.lit(SINCE))
    index = increments.PivotIndex(spark, new_folder(spark, "pivot-index"))
    index.start(texts, days.where(F.col("day") < since))
    _, members, links = index.check(texts, days.where(F.col("day") >= since))
    return members, links, since


def p2_found(spark, sf):
    return increments.found_pairs(*_checked_batches(spark, sf))


def p2_classes(spark, sf):
    """Per incoming document: its class of equal texts, how many classes agree with it, and the first of each."""
    return increments.copy_classes(*_checked_batches(spark, sf))


def p3_found(spark, sf):
    parsed = _t(spark, sf, "parsed_documents")
    lines = language.line_languages(parsed, language.train(parsed))
    return lines.where(f"n_words >= {language.MIN_WORDS} and lang <> label").select("id", "line_no", "lang").distinct()


def p3_document_languages(spark, sf):
    parsed = _t(spark, sf, "parsed_documents").dropDuplicates(["id"])
    return language.document_languages(language.line_languages(parsed, language.train(parsed)), parsed)


def p3_segments(spark, sf):
    parsed = _t(spark, sf, "parsed_documents").dropDuplicates(["id"])
    return language.segments(language.line_languages(parsed, language.train(parsed)))


def _records(spark, sf):
    raw = _t(spark, sf, "raw_documents").select(F.lit("raw").alias("record_kind"), "id", "source_id", F.col("content").alias("text"))
    parsed = _t(spark, sf, "parsed_documents").select(F.lit("parsed").alias("record_kind"), "id", "source_id", F.col("clean_text").alias("text"))
    return raw.unionByName(parsed)


def p4_found(spark, sf):
    records = _records(spark, sf)
    model = encoding.encoding_model(records, "source_id", "text")
    found = encoding.repair_encoding(records, ["record_kind", "id"], "source_id", "text", model)
    return found.select("record_kind", "id", "restored_md5").distinct()


def p5_found(spark, sf):
    return sitelines.repeated_line_numbers(_t(spark, sf, "parsed_documents")).select("id", "line_no").distinct()


def p5_stripped(spark, sf):
    out = sitelines.strip_repeated_lines(_t(spark, sf, "parsed_documents"))
    return out.select("id", F.md5("stripped").alias("stripped_md5"), "n_removed")


def p6_found(spark, sf):
    pieces = splitting.split_documents(_t(spark, sf, "parsed_documents"), with_text=False)
    return pieces.where(f"section_chars > {splitting.LIMIT}").select("id", "section_no").distinct()


def p6_pieces(spark, sf):
    pieces = splitting.split_documents(_t(spark, sf, "parsed_documents").dropDuplicates(["id"])).where("piece is not null")
    return pieces.select("id", "piece_no", "section_no", "start", "end", F.md5("piece").alias("piece_md5"))


def p7_found(spark, sf):
    found = leakage.leaked_items(_t(spark, sf, "documents"), _t(spark, sf, "eval_items"))
    return found.where(f"run_words >= {leakage.WINDOW_WORDS}").select("doc_id", "item_id").distinct()


def p7_items(spark, sf):
    """Per item: how many documents hold it in part, how many wholly."""
    found = leakage.leaked_items(_t(spark, sf, "documents"), _t(spark, sf, "eval_items")).where(f"run_words >= {leakage.WINDOW_WORDS}")
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_if(F.col("run_words") >= F.col("item_words")).alias("n_whole"))


def _mix(spark, sf):
    return mixing.mix(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"), _t(spark, sf, "regulatory_sources"))


def p8_mix(spark, sf):
    return _mix(spark, sf)[0]


def p8_mix_report(spark, sf):
    return mixing.mix_report(*_mix(spark, sf))


def p9_found(spark, sf):
    return truncation.truncated_values(_t(spark, sf, "documents")).where("is_cut").select("doc_id").distinct()


def p9_by_source(spark, sf):
    docs = _t(spark, sf, "documents")
    cut = truncation.truncated_values(docs).where("is_cut").select("doc_id").distinct().withColumn("cut", F.lit(1))
    all_ = docs.select("doc_id", "source").distinct().join(cut, "doc_id", "left")
    return all_.groupBy("source").agg(F.count("*").alias("n_docs"), F.count("cut").alias("n_cut"), F.round(F.count("cut") / F.count("*"), 6).alias("cut_share"))


def queries():
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


_NORM = "regexp_replace(lower(trim(regexp_replace(translate(line, chr(9) || chr(160), '  '), ' +', ' ', 'g'), ' ')), '[0-9]+', '0', 'g')"

ORACLE = {
    "p5_found": rf"""
WITH docs AS (SELECT DISTINCT id, coalesce(source_id, '') AS source_id, clean_text FROM parsed_documents WHERE clean_text IS NOT NULL),
lines AS (SELECT id, source_id, u.i - 1 AS line_no, {_NORM} AS form
          FROM (SELECT id, source_id, string_split(clean_text, chr(10)) AS ls FROM docs) d, LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS i) u),
totals AS (SELECT coalesce(source_id, '') AS source_id, count(DISTINCT id) AS n_all FROM parsed_documents GROUP BY 1),
rep AS (SELECT source_id, form FROM lines JOIN totals USING (source_id) WHERE form <> '' GROUP BY source_id, form, n_all
        HAVING count(DISTINCT id) >= 3 AND count(DISTINCT id) >= 0.1 * n_all)
SELECT DISTINCT id, CAST(line_no AS INTEGER) AS line_no FROM lines JOIN rep USING (source_id, form)""",
    "p7_found": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL AND text <> ''),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[p:p+11], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS p)),
ig AS (SELECT item_id, array_to_string(w[p:p+11], ' ') AS g FROM i, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS p))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p2_found": r"""
WITH fp AS (SELECT doc_id, CAST(min(created_at) AS DATE) AS day FROM document_fingerprints WHERE created_at IS NOT NULL GROUP BY doc_id),
t AS (SELECT id AS doc_id, min(clean_text) AS clean_text FROM parsed_documents WHERE clean_text IS NOT NULL AND clean_text <> '' GROUP BY id),
w AS (SELECT doc_id, day, list_filter(regexp_split_to_array(lower(clean_text), '[ \n]+'), lambda x: x <> '') AS w FROM t JOIN fp USING (doc_id)),
s AS (SELECT DISTINCT doc_id, day, w[p] || ' ' || w[p+1] AS g FROM w, LATERAL (SELECT unnest(range(1, len(w))) AS p)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id AND a.day <> b.day AND greatest(a.day, b.day) >= DATE '2026-03-01' GROUP BY 1, 2)
SELECT x AS doc_id_a, y AS doc_id_b FROM c JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE k >= 0.7 * (na.n + nb.n - k) - 1e-9""",
}


_DOCS_WORDS = """fp AS (SELECT doc_id, CAST(min(created_at) AS DATE) AS day FROM document_fingerprints WHERE created_at IS NOT NULL GROUP BY doc_id),
t AS (SELECT id AS doc_id, min(clean_text) AS clean_text FROM parsed_documents WHERE clean_text IS NOT NULL AND clean_text <> '' GROUP BY id),
w AS (SELECT doc_id, day, list_filter(regexp_split_to_array(lower(clean_text), '[ \n]+'), lambda x: x <> '') AS w FROM t JOIN fp USING (doc_id)),
s AS (SELECT DISTINCT doc_id, day, w[p] || ' ' || w[p+1] AS g FROM w, LATERAL (SELECT unnest(range(1, len(w))) AS p))"""
ORACLE["p2_classes"] = f"""WITH {_DOCS_WORDS},
d AS (SELECT doc_id, any_value(day) AS day, md5(string_agg(g, chr(1) ORDER BY g)) AS c, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT c, min(doc_id) AS rep, any_value(n) AS n, count(*) AS n_equal, min({{'d': day, 'i': doc_id}}) AS first FROM d GROUP BY c),
cs AS (SELECT c, g FROM s JOIN k ON s.doc_id = k.rep),
l AS (SELECT a.c AS x, b.c AS y, count(*) AS m FROM cs a JOIN cs b ON a.g = b.g AND a.c <> b.c GROUP BY 1, 2),
lk AS (SELECT x, count(*) AS n_linked, min(ky.first) AS near FROM l JOIN k kx ON kx.c = x JOIN k ky ON ky.c = y WHERE m >= 0.7 * (kx.n + ky.n - m) - 1e-9 GROUP BY x)
SELECT d.doc_id, k.first.i AS class_id, n_equal, coalesce(n_linked, 0) AS n_linked, CASE WHEN k.first.d < d.day THEN k.first.i END AS first_equal, CASE WHEN near.d < d.day THEN near.i END AS first_near
FROM d JOIN k USING (c) LEFT JOIN lk ON lk.x = d.c WHERE d.day >= DATE '2026-03-01'"""
_FORM = "lower(trim(regexp_replace(translate({0}, chr(9) || chr(160), '  '), ' +', ' ', 'g'), ' '))"
ORACLE["p6_found"] = rf"""WITH RECURSIVE docs AS (SELECT DISTINCT ON (id) id, clean_text AS t, coalesce(sections, []) AS secs FROM parsed_documents WHERE length(clean_text) > 1500),
lines AS (SELECT id, i - 1 AS no, {_FORM.format('line')} AS form FROM (SELECT id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM docs)),
heads AS (SELECT id, CAST(k AS INT) AS k, {_FORM.format('h')} AS form FROM (SELECT id, unnest(secs) AS h, generate_subscripts(secs, 1) AS k FROM docs)),
walk AS (SELECT id, 0 AS k, CAST(-1 AS BIGINT) AS last, false AS found FROM docs
 UNION ALL SELECT w.id, w.k + 1, coalesce(min(l.no), any_value(w.last)), min(l.no) IS NOT NULL FROM walk w JOIN heads h ON h.id = w.id AND h.k = w.k + 1 LEFT JOIN lines l ON l.id = w.id AND l.no > w.last AND l.form = h.form AND h.form <> '' GROUP BY w.id, w.k),
opens AS (SELECT id, 0 AS k, CAST(0 AS BIGINT) AS a FROM docs UNION ALL SELECT id, k, last FROM walk WHERE found),
spans AS (SELECT id, k, a, lead(a) OVER (PARTITION BY id ORDER BY k) AS b FROM opens)
SELECT id, k AS section_no FROM spans JOIN docs USING (id)
WHERE length(regexp_replace(array_to_string(list_slice(string_split(t, chr(10)), a + 1, coalesce(b, 1000000000)), chr(10)), '^[ \n]+|[ \n]+$', '', 'g')) > 1500"""
ORACLE["p7_items"] = (
    "WITH pairs AS (" + ORACLE["p7_found"] + r"""), d AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''), ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''), ' ') || ' ' AS x FROM eval_items)
SELECT item_id, count(DISTINCT doc_id) AS n_docs, CAST(count(*) FILTER (WHERE contains(d.t, i.x)) AS BIGINT) AS n_whole FROM pairs JOIN d USING (doc_id) JOIN i USING (item_id) GROUP BY 1"""
)
ORACLE["p5_stripped"] = rf"""WITH docs AS (SELECT DISTINCT ON (id) id, coalesce(source_id, '') AS source_id, clean_text, CAST(published_at AS DATE) AS day FROM parsed_documents),
clusters AS (SELECT source_id, clean_text, min(day) AS day FROM docs WHERE clean_text <> '' GROUP BY 1, 2),
lines AS (SELECT source_id, day, unnest(list_distinct(list_transform(string_split(clean_text, chr(10)), lambda line: {_NORM}))) AS form FROM clusters),
counts AS (SELECT source_id, form, count(*) AS n, count(DISTINCT day) + count(*) FILTER (WHERE day IS NULL) AS n_days FROM lines WHERE form <> '' GROUP BY 1, 2),
totals AS (SELECT source_id, count(*) AS n_all, count(DISTINCT day) + count(*) FILTER (WHERE day IS NULL) AS all_days FROM clusters GROUP BY 1),
gone AS (SELECT source_id, list(form) AS forms FROM counts JOIN totals USING (source_id) WHERE n >= 3 AND n >= 0.1 * n_all AND n_days >= least(3, all_days) GROUP BY 1),
cut AS (SELECT id, clean_text, string_split(clean_text, chr(10)) AS ls, list_filter(string_split(clean_text, chr(10)), lambda line: NOT list_contains(coalesce(forms, []), {_NORM})) AS kept FROM docs LEFT JOIN gone USING (source_id))
SELECT id, md5(array_to_string(kept, chr(10))) AS stripped_md5, CAST(coalesce(len(ls) - len(kept), 0) AS INT) AS n_removed FROM cut"""


def oracle_sql():
    return dict(ORACLE)
