"""Queries of the engine's own operators over whole tables; their SQL is in ``oracle.py``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import pipeline, rules
from ..functions import kernels
from ..functions import text as tx
from ..operators import classify as cl
from ..operators import dedup, notify, retrieval, state
from ..session import written
from ..sources import registry

AS_OF = "2026-06-01 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def parsed(spark, sf) -> DataFrame:
    """Latest row of each parsed document."""
    return state.latest(table(spark, sf, "parsed_documents"), "id", "parsed_at")


def scored(spark, sf) -> DataFrame:
    cols = ("id", "source_id", "jurisdiction", "title", "clean_text", "summary", "reference_number", "parsed_at")
    return cl.risk(cl.classify(parsed(spark, sf).select(*cols).where("clean_text is not null")))


def _second(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def as_of():
    return F.lit(AS_OF).cast("timestamp")


# --- flagship ---------------------------------------------------------------------------------


def flagship_risk_by_jurisdiction(spark, sf):
    rows = scored(spark, sf).groupBy("jurisdiction", "risk_level")
    return rows.agg(F.count("*").alias("n_documents"), F.round(F.avg("score"), 4).alias("avg_score"), F.max("score").alias("max_score"))


# --- sources, scans, sinks ------------------------------------------------------------------------


def source_registry(spark, sf):
    src = registry.enabled(table(spark, sf, "regulatory_sources"))
    return src.groupBy("jurisdiction").agg(F.count("*").alias("n_sources"), F.min("id").alias("first_id"), F.sum("crawl_frequency_minutes").alias("minutes"))


def bundled_sources(spark, sf):
    return registry.bundled(spark).select("id", "name", "jurisdiction", "url", "source_type", "description", "enabled", "crawl_frequency_minutes", F.array_join("tags", ",").alias("tags"))


def source_jurisdictions(spark, sf):
    return registry.jurisdictions(registry.enabled(table(spark, sf, "regulatory_sources")))


def source_adapters(spark, sf):
    """Which sources have an adapter, and what it asks of links."""
    own = registry.for_sources(table(spark, sf, "regulatory_sources"), registry.register(registry.adapters(spark), "RBI", ["/new/"], False, replace=True))
    return own.select("id", "has_adapter", "same_host", F.array_join("patterns", ",").alias("patterns"))


MIME_CASES = (
    ("text/html; charset=utf-8", ""), ("Application/XHTML+XML", ""), ("application/pdf", ""), ("application/json;v=1", ""), ("text/xml", ""),
    ("application/rss+xml", ""), ("image/svg+xml", ""), ("application/octet-stream", "%PDF-1.7"), ("text/plain", "%PDF"), ("", "%PDF-1.4"), (None, "<html>"),
)


def detect_format(spark, sf):
    """Pages without a MIME type, by what they begin with; and spellings of MIME types."""
    raw = table(spark, sf, "raw_documents").select(F.col("id").alias("mime"), registry.detect_format(F.lit(None).cast("string"), F.col("content")).alias("detected")).distinct()
    cases = spark.createDataFrame(list(MIME_CASES), "mime string, body string")
    return raw.unionByName(cases.select(F.coalesce("mime", F.lit("none")).alias("mime"), registry.detect_format(F.col("mime"), F.col("body")).alias("detected")))


def feed_or_page(spark, sf):
    raw = table(spark, sf, "raw_documents").select("id", "source_id", "content_format")
    src = table(spark, sf, "regulatory_sources").select(F.col("id").alias("source_id"), "source_type")
    return raw.join(src, "source_id", "left").select("id", registry.is_feed(F.col("source_type"), F.col("content_format")).alias("is_feed")).distinct()


def adapter_match(spark, sf):
    raw = table(spark, sf, "raw_documents").select("id", "jurisdiction", "url").distinct()
    own = raw.join(F.broadcast(registry.adapters(spark)), "jurisdiction", "left")  # four rows
    return own.select("id", F.coalesce(registry.matches_adapter(F.col("url"), F.col("patterns")), F.lit(False)).alias("matches"), "same_host")


def _pages(spark, sf):
    return table(spark, sf, "raw_documents").where("content_format = 'html'").select("id", "url", "jurisdiction", "content").dropDuplicates(["id"])


def anchors(spark, sf):
    """Every link of a page, in order."""
    page = _pages(spark, sf).select("id", kernels.parse_html_udf(F.col("content"))["hrefs"].alias("hrefs"))
    return page.select("id", F.posexplode("hrefs").alias("place", "href"))


def anchors_normalized(spark, sf):
    """Links worth following by the adapter of the page's jurisdiction."""
    page = _pages(spark, sf).join(F.broadcast(registry.adapters(spark)), "jurisdiction")  # four rows
    page = page.withColumn("hrefs", kernels.parse_html_udf(F.col("content"))["hrefs"])
    links = kernels.links_udf(F.col("url"), F.col("hrefs"), F.col("patterns"), F.col("same_host"))
    return page.select("id", F.posexplode(links).alias("place", "link"))


def links_on_host(spark, sf):
    """The same without patterns."""
    page = _pages(spark, sf).withColumn("hrefs", kernels.parse_html_udf(F.col("content"))["hrefs"])
    links = kernels.links_udf(F.col("url"), F.col("hrefs"), F.array().cast("array<string>"), F.lit(True))
    return page.select("id", F.size("hrefs").alias("n_anchors"), F.size(links).alias("n_links"))


def feed_links(spark, sf):
    xml = table(spark, sf, "raw_documents").where("content_format = 'xml'").select("id", "content").dropDuplicates(["id"])
    return xml.select("id", F.size(kernels.feed_udf(F.col("content"))).alias("n_links"))


def raw_store(spark, sf):
    return registry.raw_store(table(spark, sf, "raw_documents")).select("source_id", "byte_hash", "jurisdiction")


def stored_already(spark, sf):
    raw = table(spark, sf, "raw_documents").withColumn("byte_hash", F.sha2("content", 256))
    late = raw.where("fetched_at >= '2026-01-01'").select("id", "source_id", "byte_hash").distinct()
    old = raw.where("fetched_at < '2026-01-01'")
    return state.exists_in(late, old, "source_id", "byte_hash").select("id")


def upsert_parsed(spark, sf):
    p = table(spark, sf, "parsed_documents").select("id", "status", "parsed_at")
    rows = state.upsert(p.where("parsed_at < '2026-01-01'"), p.where("parsed_at >= '2026-01-01'"), "id", "parsed_at")
    return rows.select("id", "status", _second("parsed_at"))


# --- parsing ---------------------------------------------------------------------------------------


def parse_html_pages(spark, sf):
    pages = table(spark, sf, "raw_documents").where("content_format = 'html'").select("id", "content").dropDuplicates(["id"])
    p = pages.withColumn("p", kernels.parse_html_udf(F.col("content")))
    return p.select("id", F.md5("p.text").alias("text_md5"), F.col("p.title").alias("title"), F.size(F.slice("p.headings", 1, 50)).alias("n_headings"))


def html_titles(spark, sf):
    p = _pages(spark, sf).select("id", kernels.parse_html_udf(F.col("content")).alias("p"))
    return p.select("id", F.col("p.title").alias("title"), F.array_join("p.headings", " | ").alias("headings"))


def parse_dispatch(spark, sf):
    """Pages of every format; those without text carry an error instead of failing."""
    raw = table(spark, sf, "raw_documents").select("id", "title", "jurisdiction", "content_format", "content").dropDuplicates(["id"])
    return pipeline.parse(raw).select("id", "content_format", "error")


def resolve_title_all(spark, sf):
    """Title of every page that has text, whatever its format; the page's own title where none was delivered."""
    raw = table(spark, sf, "raw_documents").select("id", "title", "content", "content_format", "jurisdiction").distinct()
    markup = F.col("content_format").isin("html", "xml")
    p = raw.withColumn("p", kernels.parse_html_udf(F.when(markup, F.col("content"))))
    p = p.withColumn("text", F.when(markup, F.col("p.text")).when(F.col("content_format") != "pdf", tx.strip("content")))
    title = F.coalesce(tx.nullif_empty("title"), F.when(markup, F.col("p.title")))
    return p.where("text <> ''").select("id", tx.resolve_title(title, "text", "jurisdiction").alias("resolved_title")).distinct()


def resolve_title(spark, sf):
    """Text pages only, which its SQL can parse."""
    raw = table(spark, sf, "raw_documents").where("content_format = 'text'").select("id", "title", "content", "jurisdiction").distinct()
    return raw.select("id", tx.resolve_title("title", "content", "jurisdiction").alias("resolved_title")).distinct()


def reference_number(spark, sf):
    return parsed(spark, sf).select("id", tx.reference_number("clean_text").alias("reference"))


def published_date(spark, sf):
    return parsed(spark, sf).select("id", tx.published_date("clean_text").cast("string").alias("published"))


# --- normalisation and language ---------------------------------------------------------------------


def whitespace_normalize(spark, sf):
    return parsed(spark, sf).select("id", F.md5(tx.normalize_whitespace("clean_text")).alias("text_md5"))


def punctuation_map(spark, sf):
    return parsed(spark, sf).select("id", F.md5(tx.strip_controls(tx.map_punctuation("clean_text"))).alias("text_md5"))


def nfc_normalize(spark, sf):
    return parsed(spark, sf).select("id", F.md5(kernels.nfc_udf(F.col("clean_text"))).alias("text_md5"))


def mojibake_simple(spark, sf):
    p = parsed(spark, sf).select("id", "clean_text").withColumn("fixed", kernels.fix_mojibake_udf(F.col("clean_text")))
    return p.where("fixed <> clean_text").select("id", F.md5("fixed").alias("fixed_md5"))


def boilerplate_strip(spark, sf):
    p = parsed(spark, sf).select("id", tx.normalize_whitespace("clean_text").alias("t"))
    return tx.strip_boilerplate(p, "t").select("id", "removed", F.md5("stripped").alias("text_md5"))


def clean_documents(spark, sf):
    c = pipeline.clean(parsed(spark, sf).select("id", F.col("clean_text").alias("text")))
    return c.select("id", "original_chars", "cleaned_chars", "removed", "language")


def language_detect(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("w", tx.stop_word_tokens("text"))
    d = d.select("doc_id", tx.language("text", "w").alias("l"))
    return d.select("doc_id", F.col("l.language").alias("language"), F.col("l.confidence").alias("confidence"))


# --- hashing and deduplication ----------------------------------------------------------------------


def raw_content_hash(spark, sf):
    raw = table(spark, sf, "raw_documents").where("content_hash is not null")
    same = F.sha2("content", 256) == F.lower("content_hash")
    return raw.groupBy("content_format").agg(F.count("*").alias("n"), F.count_if(same).alias("n_same"))


def normalized_content_hash(spark, sf):
    return parsed(spark, sf).select("id", tx.content_hash("clean_text").alias("hash"))


def exact_duplicates(spark, sf):
    h = parsed(spark, sf).select("id", tx.content_hash("clean_text").alias("hash"))
    return h.groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def word_and_shingle_counts(spark, sf):
    p = parsed(spark, sf).select("id", "clean_text", tx.tokens("clean_text").alias("w"))
    return p.select("id", tx.word_count("clean_text").alias("n_words"), F.size("w").alias("n_tokens"), F.size(tx.shingles("w", 3)).alias("n_shingles"))


def jaccard_pairs(spark, sf):
    """Documents of equal title: similarity of their word sets to that of the first of them."""
    d = table(spark, sf, "documents").where("title is not null and text is not null and text <> ''").select("doc_id", "title", F.array_distinct(tx.tokens("text")).alias("w"))
    first = d.groupBy("title").agg(F.min("doc_id").alias("first_id"))
    heads = d.select(F.col("doc_id").alias("first_id"), F.col("w").alias("w0")).join(first, "first_id")
    return d.join(heads, "title").where("doc_id > first_id").select("doc_id", "first_id", F.round(tx.jaccard("w", "w0"), 6).alias("jaccard"))


def simhash_md5(spark, sf):
    s = dedup.simhash_native(parsed(spark, sf).select("id", "clean_text"), "id", "clean_text")
    return s.select("id", tx.hex64("simhash").alias("simhash_hex"))


def simhash_blake2b(spark, sf):
    p = parsed(spark, sf).select("id", tx.tokens("clean_text").alias("w")).select("id", tx.shingles("w", 2).alias("s"))
    return p.select("id", tx.hex64(kernels.simhash_udf(F.col("s"))).alias("simhash_hex"))


def _fingerprints(spark, sf):
    fp = table(spark, sf, "document_fingerprints").where("simhash is not null and doc_id is not null and created_at is not null")
    one = state.latest(fp, "doc_id", "created_at")
    return one.select("doc_id", F.struct("created_at", "doc_id").alias("ord"), F.lower(F.trim("content_hash")).alias("content_hash"), "simhash")


def near_dup_pairs(spark, sf):
    """Pairs of distinct stored fingerprints within six bits, with the documents that hold each."""
    fp = _fingerprints(spark, sf)
    n = fp.groupBy("simhash").agg(F.count("*").alias("n"))
    pairs = dedup.near_pairs(fp)
    both = pairs.join(n.toDF("a", "n_a"), "a").join(n.toDF("b", "n_b"), "b")
    return both.select(tx.hex64("a").alias("a"), tx.hex64("b").alias("b"), F.col("distance").cast("int").alias("distance"), "n_a", "n_b")


def dedup_greedy(spark, sf):
    return dedup.greedy_dedup(_fingerprints(spark, sf)).select("doc_id", "kind", "matched", F.round("similarity", 6).alias("similarity"))


def dedup_known(spark, sf):
    """Documents since March against the fingerprints stored before."""
    fp = _fingerprints(spark, sf)
    old = F.col("ord.created_at") < F.lit("2026-03-01").cast("timestamp")
    found = dedup.greedy_dedup(fp.where(~old), known=fp.where(old))
    return found.select("doc_id", "kind", "matched", F.round("similarity", 6).alias("similarity"))


def first_holders(spark, sf):
    return dedup.first_holders(_fingerprints(spark, sf))


def fingerprint_lookup(spark, sf):
    fp = table(spark, sf, "document_fingerprints").select(F.lower(F.trim("content_hash")).alias("hash"), "doc_id")
    own = parsed(spark, sf).select("id", tx.content_hash("clean_text").alias("hash"))
    return own.join(fp, "hash").groupBy("id").agg(F.count_distinct("doc_id").alias("n_known"))


# --- classification, risk, actions ---------------------------------------------------------------------


def _exploded(spark, sf, column, name, value):
    s = scored(spark, sf).select("id", F.posexplode(column).alias("place", "x"))
    return s.select("id", "place", F.col(f"x.{name}").alias("name"), F.col(f"x.{value}").alias("value"))


def topics(spark, sf):
    return _exploded(spark, sf, "topics", "topic", "confidence")


def business_functions(spark, sf):
    return _exploded(spark, sf, "functions", "name", "relevance")


def jurisdiction_confidence(spark, sf):
    return _exploded(spark, sf, "jurisdictions", "jurisdiction", "confidence")


def document_class(spark, sf):
    return scored(spark, sf).select("id", "doc_type", "urgency", "primary_topic", "primary_function")


def risk_signals(spark, sf):
    r6 = lambda c: F.round(c, 6).alias(c)
    return scored(spark, sf).select("id", *(r6(c) for c in ("urgency_score", "doc_type_score", "keyword_score", "scope_score", "penalty_score")), "score", "risk_level", "confidence")


def risk_rationale(spark, sf):
    s = scored(spark, sf)
    return s.select("id", cl.rationale(s).alias("rationale"), F.array_join("impacted_areas", ",").alias("areas"))


def _asked(df, column):
    """The stated query set: ids whose hash is divisible by 50."""
    return df.where(F.conv(F.substring(F.md5(column), 1, 8), 16, 10).cast("bigint") % 50 == 0)


def document_index(spark, sf):
    index = retrieval.index_documents(parsed(spark, sf), hash_name="md5")
    return index.select("item_id", "document_id", "jurisdiction", "chunk_index", "title", "reference_number", F.md5("text").alias("text_md5"))


def document_search(spark, sf):
    """Titles as questions, against the chunks of all documents of the same jurisdiction."""
    p = parsed(spark, sf)
    asked = _asked(p, "id").where("title is not null").select(F.col("id").alias("query_id"), F.col("title").alias("text"), "jurisdiction")
    found = retrieval.search(asked, retrieval.index_documents(p, hash_name="md5"), 5, 0.1, True, hash_name="md5")
    return found.select("query_id", "place", "document_id", "item_id", "score", "label")


def rationale_in_context(spark, sf):
    """Only the documents that ask are scored; all of them are searched."""
    p = parsed(spark, sf)
    s = cl.risk(cl.classify(_asked(p, "id").where("clean_text is not null")))
    s = written(s.select("id", "jurisdiction", "title", F.left("clean_text", F.lit(200)).alias("clean_text"), cl.rationale(s).alias("rationale")), "scored")
    return pipeline.rationale_in_context(s, retrieval.index_documents(p, hash_name="md5"), hash_name="md5", documents=p)


def action_items(spark, sf):
    return cl.plan_actions(scored(spark, sf), as_of()).select("id", "no", "key", "owner", "priority", F.col("due_date").cast("string").alias("due_date"))


def action_texts(spark, sf):
    return cl.plan_actions(scored(spark, sf), as_of()).select("id", "no", "title", F.md5("description").alias("description_md5"))


def actions_by_owner(spark, sf):
    return cl.plan_actions(scored(spark, sf), as_of()).groupBy("owner", "priority").agg(F.count("*").alias("n"))


# --- summaries, chunks, vectors -------------------------------------------------------------------------


def summaries(spark, sf):
    p = tx.summarize(parsed(spark, sf).where("clean_text is not null"))
    return p.select("id", "headline", F.md5("summary_text").alias("summary_md5"), F.array_join("topic_tags", ",").alias("tags"), F.md5(F.array_join("key_changes", "|")).alias("changes_md5"), "prompt_tokens")


def text_chunks(spark, sf):
    p = parsed(spark, sf).where("clean_text is not null").select("id", F.explode(kernels.chunks_udf(F.col("clean_text"))).alias("c"))
    return p.select("id", F.col("c.index").alias("chunk_no"), F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.md5("c.text").alias("text_md5"))


def embed_texts(spark, sf):
    """Hashed bag of words of every document, as its non-zero entries."""
    p = parsed(spark, sf).select("id", F.posexplode(kernels.embed_udf(F.col("clean_text"), 256, "md5")).alias("dim", "v"))
    return p.where("v <> 0").select("id", "dim", F.round("v", 6).alias("value"))


def embed_blake2b(spark, sf):
    return parsed(spark, sf).select("id", F.aggregate(kernels.embed_udf(F.col("clean_text")), F.lit(0.0), lambda a, x: a + x * x).alias("length"))


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), F.col("label").alias("group"))
    return e, e.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")


def vector_topk(spark, sf):
    items, asked = _vectors(spark, sf)
    return retrieval.top_k(asked, items, 10)


def vector_topk_filtered(spark, sf):
    items, asked = _vectors(spark, sf)
    return retrieval.top_k(asked, items, 5, same="group")


def vector_topk_postfilter(spark, sf):
    """The first fifty, then those of the query's group, at most five."""
    items, asked = _vectors(spark, sf)
    hits = retrieval.top_k(asked, items, 50)
    same = hits.join(items.select("item_id", F.col("group").alias("g")), "item_id").join(asked.select("query_id", F.col("group").alias("qg")), "query_id").where("g = qg")
    w = Window.partitionBy("query_id").orderBy("rank")
    return same.withColumn("place", F.row_number().over(w)).where("place <= 5").select("query_id", "item_id", "score", "place")


def _retrieved(spark, sf):
    items, asked = _vectors(spark, sf)
    hits = retrieval.top_k(asked, items, 15).withColumn("doc", F.floor(F.col("item_id") / 3))
    return retrieval.best_per_document(hits, "doc", 5, 0.1)


def rag_search(spark, sf):
    return _retrieved(spark, sf).select("query_id", "doc", "item_id", "score", "place")


def rag_context(spark, sf):
    rows = _retrieved(spark, sf).withColumn("label", F.concat(F.lit("doc:"), "doc")).withColumn("text", F.concat(F.lit("chunk "), "item_id"))
    return retrieval.context_block(rows, "query_id", "place", "label", "score", "text")


def rag_summary(spark, sf):
    return _retrieved(spark, sf).groupBy("query_id").agg(F.max("score").alias("top_score"), F.count("*").alias("n_results"))


def citation_labels(spark, sf):
    return parsed(spark, sf).select("id", retrieval.citation_label(F.col("reference_number"), F.col("title"), F.col("id"), F.col("jurisdiction")).alias("label"))


# --- repository queries, approvals, notifications -----------------------------------------------------------


def point_get(spark, sf):
    p = parsed(spark, sf)
    wanted = p.agg(F.min("id").alias("id"))
    return p.join(F.broadcast(wanted), "id").select("id", "title", "status")  # one row


def list_recent(spark, sf):
    p = parsed(spark, sf).where("jurisdiction = 'RBI'").select("id", "parsed_at", "status")
    return state.newest(p, "parsed_at", 100, "id").select("id", "status", _second("parsed_at"))


def audit_latest(spark, sf):
    a = state.latest(table(spark, sf, "audit_log"), "id", "created_at").where("event_type = 'risk.assessed'")
    return a.select("id", "entity_id", F.get_json_object("payload", "$.risk_level").alias("risk_level")).orderBy(F.desc("id")).limit(100)


def audit_by_type(spark, sf):
    a = state.latest(table(spark, sf, "audit_log"), "id", "created_at")
    return a.groupBy("event_type", "entity_type").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("n_entities"))


def _markers(spark, sf):
    return table(spark, sf, "pipeline_state").dropDuplicates(["id"])


def stage_counts(spark, sf):
    return state.stage_counts(_markers(spark, sf))


def last_run(spark, sf):
    return state.last_run(_markers(spark, sf))


def documents_at_stage(spark, sf):
    return _markers(spark, sf).groupBy("run_id", "stage").agg(F.count_distinct("document_id").alias("n_documents"))


def skip_completed(spark, sf):
    raw = table(spark, sf, "raw_documents").select(F.col("id").alias("document_id")).distinct()
    return state.missing_from(raw, _markers(spark, sf).where("stage = 'actions_planned'"), "document_id")


def stage_markers(spark, sf):
    m = _markers(spark, sf)
    order = reduce(lambda acc, s: acc.when(F.col("stage") == s[1], F.lit(s[0])), list(enumerate(rules.STAGES)), F.when(F.lit(False), F.lit(0)))
    last = m.withColumn("n", order).groupBy("document_id").agg(F.max_by("stage", "n").alias("last_stage"))
    return state.stage_markers(last, "replay").groupBy("stage").agg(F.count("*").alias("n"))


def _reviewed(spark, sf):
    s = scored(spark, sf)
    s = written(s.withColumn("rationale", cl.rationale(s)), "scored")
    return notify.with_actions(s, cl.plan_actions(s, as_of()))


def approval_requests(spark, sf):
    a = state.approval_requests(_reviewed(spark, sf), as_of(), "r1")
    minute = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    return a.select(
        "approval_id", "document_id", "assessment_id", "run_id", "status", "title", "summary", "action_count", "decided_by", "decision_note", minute("decided_at"), minute("expires_at"),
        F.round("payload.score", 4).alias("score"), F.md5("payload.rationale").alias("rationale_md5"), F.array_join(F.transform("payload.actions", lambda x: F.concat_ws("/", x["title"], x["priority"], x["owner"])), "; ").alias("actions"),
    )


def pending_approvals(spark, sf):
    return state.pending_approvals(state.approval_requests(_reviewed(spark, sf), as_of(), "r1"), "r1").select("document_id", "risk_level", "title")


def approved_documents(spark, sf):
    return state.is_approved(state.approval_requests(_reviewed(spark, sf), as_of()))


def run_audit(spark, sf):
    """Events of scored documents, their actions and their approvals."""
    s = written(_reviewed(spark, sf), "reviewed")
    events = pipeline.audit(s.select("id"), s, cl.plan_actions(s, as_of()), state.approval_requests(s, as_of()), as_of())
    level = F.get_json_object("payload", "$.risk_level")
    return events.groupBy("event_type", "entity_type", "actor", level.alias("risk_level")).agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("n_entities"))


def approval_latest(spark, sf):
    """Two logged decisions for each request of a high or critical document, the later one counts; the rest expire."""
    req = state.approval_requests(_reviewed(spark, sf), as_of())
    log = req.where("status = 'pending' and substr(approval_id, 1, 1) < '8'")
    first = log.select("approval_id", F.lit("rejected").alias("status"), F.lit("a").alias("decided_by"), (as_of() + F.expr("INTERVAL 1 HOUR")).alias("decided_at"))
    second = log.where("substr(approval_id, 1, 1) < '4'").select("approval_id", F.lit("approved").alias("status"), F.lit("b").alias("decided_by"), (as_of() + F.expr("INTERVAL 2 HOURS")).alias("decided_at"))
    done = state.expire(state.decide(req, first.unionByName(second)), F.lit("2026-06-05").cast("timestamp"))
    return done.groupBy("risk_level", "status").agg(F.count("*").alias("n"))


def notify_single(spark, sf):
    return notify.notification(_reviewed(spark, sf)).select("id", "subject", "body")


def notify_routed(spark, sf):
    """Critical messages go to chat only, the others everywhere."""
    m = notify.notification(_reviewed(spark, sf)).withColumn("channel", F.when(F.col("risk_level") == "critical", "slack").otherwise("all"))
    return notify.routed(m, ["slack", "email"], "channel").groupBy("to_channel", "risk_level").agg(F.count("*").alias("n"))


def notify_digest(spark, sf):
    s = scored(spark, sf).withColumn("n_actions", F.size(cl.action_keys()))
    counted = s.agg(F.count("*").alias("processed")).select("processed", F.lit(3).alias("duplicates"), F.lit(0).alias("errors"))
    return notify.digest(s, counted, "r1", as_of(), "parsed_at", "id")


def notify_unsent(spark, sf):
    s = _reviewed(spark, sf)
    sent = s.where("substr(id, 1, 1) < '8'").select(F.col("id").alias("document_id"), "risk_level")
    return notify.unsent(notify.notification(s), sent).groupBy("risk_level").agg(F.count("*").alias("n"))


def _run(spark, sf):
    return pipeline.run(table(spark, sf, "raw_documents"), "r1", as_of(), hash_name="md5")


def run_outcomes(spark, sf):
    """What became of every page of a run over all of them."""
    return _run(spark, sf).outcomes


def run_counters(spark, sf):
    return _run(spark, sf).counters


def stored_counters(spark, sf):
    """The same counts out of the stored tables: parsed pages, those whose hash an earlier document has, none in error."""
    raw = table(spark, sf, "raw_documents").select(F.col("id").alias("rid")).distinct()
    p = parsed(spark, sf).select(F.col("raw_document_id").alias("rid"), "id").dropDuplicates(["rid"])
    fp = table(spark, sf, "document_fingerprints").select(F.col("doc_id").alias("id"), F.lower(F.trim("content_hash")).alias("h")).dropDuplicates(["id"])
    dup = fp.join(fp.groupBy("h").agg(F.min("id").alias("keep")), "h").where("id <> keep").select("id", F.lit(True).alias("d"))
    out = raw.join(p, "rid", "left").join(dup, "id", "left")
    known, duplicate = F.col("id").isNotNull(), F.coalesce("d", F.lit(False))
    return state.run_counters(out.select(known.alias("parsed"), (known & ~duplicate).alias("scored"), duplicate.alias("duplicate"), F.lit(None).cast("string").alias("error")))


def run_markers(spark, sf):
    return _run(spark, sf).markers.groupBy("stage").agg(F.count("*").alias("n"))


def run_again(spark, sf):
    """A second run that knows the first one's markers and fingerprints: every page it processed is skipped, every other one a duplicate or without text."""
    raw = table(spark, sf, "raw_documents")
    one = pipeline.run(raw, "r1", as_of(), hash_name="md5")
    two = pipeline.run(raw, "r2", as_of(), known=one.fingerprints, markers=one.markers, hash_name="md5")
    both = one.outcomes.select("id", F.col("outcome").alias("first")).join(two.outcomes.select("id", F.col("outcome").alias("second")), "id")
    return both.groupBy("first", "second").agg(F.count("*").alias("n"))


def stream_notifications(spark, sf):
    from ..streaming.jobs import notifications_once

    return notifications_once(spark, f"{sf}/audit_log.parquet")


_HELPERS = ("table", "parsed", "scored", "as_of", "queries", "oracle_sql", "written")


def queries():
    return {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and k[0] != "_" and k not in _HELPERS}


def oracle_sql():
    from .oracle import ORACLE
    from .oracle_more import MORE
    from .oracle_text import TEXT

    return ORACLE | TEXT | MORE
