"""A whole run: parse, clean, deduplicate, classify, summarise, index, score, plan, ask, with markers and audit events.

A run is a chain of DataFrames over the fetched pages.  A page that cannot be processed carries an
``error`` and stops there; it fails no job.  Order is the pages' order of arrival.

Outcomes: ``skipped`` (an earlier run planned its actions), ``unparsed`` (no text), ``duplicate``
(exact or near, of this run or an earlier one) and ``processed``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kernels
from .functions import text as tx
from .operators import classify as cl
from .operators import dedup, notify, retrieval, state
from .session import exists, written

LAST_STAGE = {"unparsed": "fetched", "duplicate": "deduplicated", "processed": "actions_planned"}


def parse(raw: DataFrame, content: str = "content", stored: str | None = None) -> DataFrame:
    """Adds text, title, headings, reference_number, published_at and error.

    ``stored`` names a binary column with the fetched bytes, from which PDF pages are read; without
    it they have no text.
    """
    fmt = F.col("content_format")
    page = raw.withColumn("__page", kernels.parse_html_udf(F.when(fmt.isin("html", "xml"), F.col(content)), links=False))
    if stored:
        page = page.withColumn("__pdf", kernels.parse_pdf_udf(F.when(fmt == "pdf", F.col(stored))))
        pdf_text, pdf_title = F.col("__pdf.text"), F.col("__pdf.title")
    else:
        pdf_text, pdf_title = F.lit("").cast("string"), F.lit(None).cast("string")
    text = F.when(fmt == "pdf", pdf_text).when(fmt.isin("html", "xml"), F.col("__page.text")).otherwise(tx.strip(content))
    out = page.withColumn("text", F.coalesce(text, F.lit("")))
    own = F.coalesce(tx.nullif_empty("title"), F.when(fmt == "pdf", pdf_title).otherwise(F.col("__page.title")))
    return out.withColumns(
        {
            "error": F.when(F.col("text") == "", F.concat(F.lit("no text in "), F.coalesce(fmt, F.lit("unknown")), F.lit(" page"))),
            "title": tx.resolve_title(own, "text", "jurisdiction"),
            "headings": F.coalesce(F.slice("__page.headings", 1, 50), F.array().cast("array<string>")),
            "reference_number": tx.reference_number("text"),
            "published_at": tx.published_date("text"),
        }
    ).drop("__page", "__pdf")


def parse_stored(raw: DataFrame, files: DataFrame) -> DataFrame:
    """``parse`` with the bytes of a content-addressed store: ``files`` has (byte_hash, bytes), raw rows their byte_hash."""
    return parse(raw.join(files.select("byte_hash", F.col("bytes").alias("__bytes")), "byte_hash", "left"), stored="__bytes").drop("__bytes")


def clean(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds clean_text, language, language_confidence, original_chars, cleaned_chars and removed; a text that cleaning would empty stays."""
    t = kernels.repaired_udf(F.col(text))
    out = df.withColumn("__t", tx.normalize_whitespace(tx.strip_controls(tx.map_punctuation(t))))
    out = tx.strip_boilerplate(out, "__t", "__s", "removed").withColumn("clean_text", F.coalesce(tx.nullif_empty("__s"), F.col(text)))
    out = out.withColumn("__w", tx.stop_word_tokens("clean_text")).withColumn("__l", tx.language("clean_text", "__w"))
    return out.withColumns(
        {"language": F.col("__l.language"), "language_confidence": F.col("__l.confidence"), "original_chars": F.length(text), "cleaned_chars": F.length("clean_text")}
    ).drop("__t", "__s", "__w", "__l")


def fingerprints(df: DataFrame, order: Column, hash_name: str = "blake2b") -> DataFrame:
    """(doc_id, ord, content_hash, simhash) of cleaned documents."""
    rows = df.select(F.col("id").alias("doc_id"), order.alias("ord"), tx.content_hash("clean_text").alias("content_hash"), tx.tokens("clean_text").alias("w"))
    return rows.select("doc_id", "ord", "content_hash", kernels.simhash_words_udf(F.col("w"), hash_name).alias("simhash"))


class Run:
    """What a run makes; each table is worked out when it is first asked for.

    outcomes (id, outcome, error, matched); documents: the processed ones with classes, summary, scores,
    rationale and actions; actions; index: their chunks; fingerprints: theirs, for later runs;
    approvals; markers; audit; counters.
    """

    def __init__(self, run_id: str, as_of: Column, hash_name: str, outcomes: DataFrame, unique: DataFrame, fingerprints: DataFrame):
        self.run_id, self.as_of, self.hash_name = run_id, as_of, hash_name
        self.outcomes, self.unique, self.fingerprints = outcomes, unique, fingerprints

    @cached_property
    def scored(self) -> DataFrame:
        told = tx.summarize(self.unique).withColumn("summary", F.left("summary_text", F.lit(4096)))
        rows = cl.risk(cl.classify(told))
        return written(rows.withColumn("rationale", cl.rationale(rows)), "run-scored")

    @cached_property
    def actions(self) -> DataFrame:
        return cl.plan_actions(self.scored, self.as_of)

    @cached_property
    def documents(self) -> DataFrame:
        return notify.with_actions(self.scored, self.actions)

    @cached_property
    def index(self) -> DataFrame:
        return retrieval.index_documents(self.scored, hash_name=self.hash_name)

    @cached_property
    def approvals(self) -> DataFrame:
        return state.approval_requests(self.documents, self.as_of, self.run_id)

    @cached_property
    def markers(self) -> DataFrame:
        last = F.create_map(*(F.lit(x) for kv in LAST_STAGE.items() for x in kv))
        ends = self.outcomes.where("outcome <> 'skipped'").select(F.col("id").alias("document_id"), F.get(F.array(last[F.col("outcome")]), F.lit(0)).alias("last_stage"))
        return state.stage_markers(ends, self.run_id)

    @cached_property
    def audit(self) -> DataFrame:
        return audit(self.outcomes.where("outcome <> 'skipped'"), self.scored, self.actions, self.approvals, self.as_of)

    @cached_property
    def counters(self) -> DataFrame:
        return counters(self.outcomes)


def run(raw: DataFrame, run_id: str, as_of: Column, known: DataFrame | None = None, markers: DataFrame | None = None, hash_name: str = "blake2b") -> Run:
    """One run over raw_documents rows.

    ``known`` (doc_id, ord, content_hash, simhash) are the fingerprints of earlier runs (none for a
    backfill), ``markers`` their stage markers.  Re-sent pages count once, by their first delivery.
    """
    cols = ("id", "source_id", "jurisdiction", "title", "content", "content_format")
    first = raw.where("id is not null").groupBy("id").agg(F.min("fetched_at").alias("fetched_at"))
    pages = raw.select(*cols).dropDuplicates(["id"]).join(first, "id")
    done = None
    if markers is not None:
        done = markers.where("stage = 'actions_planned'").select(F.col("document_id").alias("id")).distinct()
        skipped = pages.select("id").join(done, "id", "left_semi")
        pages = pages.join(done, "id", "left_anti")
    read = written(clean(parse(pages).drop("content")), "run-parsed")
    good = read.where("error is null")
    prints = written(fingerprints(good, F.struct("fetched_at", "id"), hash_name), "run-fingerprints")
    judged = written(dedup.greedy_dedup(prints, known=known), "run-duplicates")
    outcome = F.when(F.col("error").isNotNull(), "unparsed").when(F.col("kind") == "unique", "processed").otherwise("duplicate")
    outcomes = read.select("id", "error").join(judged.select(F.col("doc_id").alias("id"), "kind", "matched"), "id", "left").select("id", outcome.alias("outcome"), "error", "matched")
    if done is not None:
        none = F.lit(None).cast("string")
        outcomes = outcomes.unionByName(skipped.select("id", F.lit("skipped").alias("outcome"), none.alias("error"), none.alias("matched")))
    kept = judged.where("kind = 'unique'").select("doc_id")
    return Run(run_id, as_of, hash_name, outcomes, good.join(kept.toDF("id"), "id", "left_semi"), prints.join(kept, "doc_id", "left_semi"))


def audit(outcomes: DataFrame, scored: DataFrame, actions: DataFrame, approvals: DataFrame, at: Column) -> DataFrame:
    """The events of a run: fetched for every page taken up, parsed and what follows for processed ones."""
    named = lambda kind, *parts: F.sha2(F.concat_ws("|", F.lit(kind), *parts), 256)
    asked = approvals.withColumn("asked", F.col("status") == "pending")
    frames = [
        state.audit_events(outcomes, "document.fetched", "raw_document", F.col("id"), "crawler", None, at),
        state.audit_events(scored, "document.parsed", "parsed_document", named("parsed", "id"), "parser", None, at),
        state.audit_events(scored, "document.classified", "parsed_document", named("parsed", "id"), "classifier", F.struct("primary_topic"), at),
        state.audit_events(scored, "risk.assessed", "risk_assessment", named("assessment", "id"), "risk_agent", F.struct("risk_level", "score"), at),
        state.audit_events(actions, "action.created", "action_item", named("action", "id", F.col("no").cast("string")), "planner", F.struct("title", "priority"), at),
        state.audit_events(asked.where("asked"), "approval.requested", "approval", F.col("approval_id"), "pipeline", F.struct("risk_level", "document_id"), at),
        state.audit_events(asked.where("not asked"), "approval.granted", "approval", F.col("approval_id"), "auto", F.struct("risk_level"), at),
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def counters(outcomes: DataFrame) -> DataFrame:
    """(processed, duplicates, errors): a page without text is neither processed nor an error; errors are failures of a stage."""
    return outcomes.agg(
        F.count_if(F.col("outcome") == "processed").alias("processed"), F.count_if(F.col("outcome").isin("duplicate", "skipped")).alias("duplicates"), F.count_if(F.col("outcome") == "failed").alias("errors")
    )


def rationale_in_context(scored: DataFrame, index: DataFrame, questions: DataFrame | None = None, hash_name: str = "blake2b", documents: DataFrame | None = None) -> DataFrame:
    """(id, rationale) with up to three related documents of the same jurisdiction.

    A document asks with its title, else its first 200 characters.  ``questions`` (id) restricts
    which documents are explained: each is held against the whole index.  ``documents`` as in
    ``retrieval.search``.
    """
    rows = scored if questions is None else scored.join(questions, "id", "left_semi")
    text = F.coalesce(tx.nullif_empty("title"), F.left("clean_text", F.lit(200)))
    found = retrieval.search(rows.select(F.col("id").alias("query_id"), text.alias("text"), "jurisdiction"), index, 3, 0.1, True, hash_name=hash_name, documents=documents)
    cited = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "label", "score", "text"))).alias("cited"))  # three at most
    both = rows.join(cited, rows["id"] == cited["query_id"], "left")
    told = F.coalesce(F.transform("cited", lambda c: F.struct(c["label"].alias("label"), c["score"].alias("score"), c["text"].alias("text"))), F.array().cast("array<struct<label:string,score:double,text:string>>"))
    return both.select("id", cl.rationale_with_context(F.col("rationale"), told).alias("rationale"))


TABLES = ("documents", "actions", "index", "fingerprints", "approvals", "markers", "audit")


def stored(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    return spark.read.parquet(f"{path}/{name}") if exists(spark, f"{path}/{name}") else None


def run_stored(raw: DataFrame, path: str, run_id: str, as_of: Column, backfill: bool = False) -> DataFrame:
    """A run against the tables under ``path``, which its results are appended to; gives the counters.

    A backfill knows no earlier fingerprints.
    """
    spark = raw.sparkSession
    done = run(raw, run_id, as_of, None if backfill else stored(spark, path, "fingerprints"), stored(spark, path, "markers"))
    kept = {name: written(getattr(done, name), f"run-{name}") for name in TABLES}  # before any table it reads changes
    counted = written(done.counters, "run-counters")
    for name, rows in kept.items():
        rows.write.mode("append").parquet(f"{path}/{name}")
    return counted
