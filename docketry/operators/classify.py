"""Rule classification, risk scoring and follow-up actions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import _c, fixed, jurisdiction_label, lit_array, nullif_empty


def _hits(low: Column, words) -> Column:
    return reduce(lambda a, b: a + b, (F.when(low.contains(w), 1).otherwise(0) for w in words))


def hit_counts(low, table) -> Column:
    """ARRAY<INT>: number of distinct keywords of each entry that a lower-case text contains."""
    return F.array(*(_hits(_c(low), words) for _, words in table))


def _ranked(hits, table, factor: float, label: str, value: str) -> Column:
    """Entries with a hit, by falling score, in table order on ties."""
    names, sizes = lit_array([n for n, _ in table]), lit_array([max(factor * len(w), 1.0) for _, w in table])

    def row(h, i):
        score = F.round(F.least(h / F.get(sizes, i), F.lit(1.0)), 3)
        return F.struct((-score).alias("neg"), i.alias("i"), F.get(names, i).alias(label), score.alias(value))

    kept = F.array_sort(F.filter(F.transform(_c(hits), row), lambda r: r[value] > 0))
    return F.transform(kept, lambda r: F.struct(r[label].alias(label), r[value].alias(value)))


def _ranked_jurisdictions(hits, declared) -> Column:
    """Confidence per jurisdiction; the declared one gains a bonus, or stands alone without a hit."""
    table, said = rules.JURISDICTION_WORDS, _c(declared)
    names, sizes = lit_array([n for n, _ in table]), lit_array([max(rules.JURISDICTION_FACTOR * len(w), 1.0) for _, w in table])

    def row(h, i):
        name = F.get(names, i)
        score = F.least(h / F.get(sizes, i), F.lit(1.0))
        bonus = F.when(said == name, F.lit(rules.DECLARED_BONUS)).otherwise(F.lit(0.0))
        conf = F.when(h > 0, F.round(F.least(score + bonus, F.lit(1.0)), 3)).when(said == name, F.lit(rules.DECLARED_ALONE)).otherwise(F.lit(0.0))
        return F.struct((-conf).alias("neg"), F.when(h > 0, i).otherwise(i + 10).alias("i"), name.alias("jurisdiction"), conf.alias("confidence"))

    kept = F.array_sort(F.filter(F.transform(_c(hits), row), lambda r: r["confidence"] > 0))
    return F.transform(kept, lambda r: F.struct(r["jurisdiction"].alias("jurisdiction"), r["confidence"].alias("confidence")))


def document_type(text) -> Column:
    """Of a text in lower case."""
    out = F.when(F.lit(False), F.lit(""))
    for name in rules.DOC_TYPES:
        out = out.when(_c(text).rlike(rf"(?U)\b{name}\b"), F.lit(name))
    return out


def urgency(text) -> Column:
    t = _c(text)
    return F.when(t.rlike(f"(?iU){rules.URGENT}"), "immediate").when(t.rlike(f"(?iU){rules.NEAR_TERM}"), "near-term").otherwise("routine")


def classify(df: DataFrame, text: str = "clean_text", declared: str = "jurisdiction") -> DataFrame:
    """Adds topics, functions, jurisdictions, doc_type, urgency, primary_topic, primary_function."""
    # in steps: the text is put in lower case once, keywords are counted once
    out = df.withColumn("__low", F.lower(text))
    out = out.withColumns(
        {
            "__t": hit_counts("__low", rules.TOPICS),
            "__f": hit_counts("__low", rules.FUNCTIONS),
            "__j": hit_counts("__low", rules.JURISDICTION_WORDS),
            "doc_type": document_type("__low"),
            "urgency": urgency(text),
        }
    )
    out = out.withColumns(
        {
            "topics": _ranked("__t", rules.TOPICS, rules.TOPIC_FACTOR, "topic", "confidence"),
            "functions": _ranked("__f", rules.FUNCTIONS, rules.FUNCTION_FACTOR, "name", "relevance"),
            "jurisdictions": _ranked_jurisdictions("__j", declared),
        }
    ).drop("__low", "__t", "__f", "__j")
    return out.withColumns({"primary_topic": F.get("topics", F.lit(0))["topic"], "primary_function": F.get("functions", F.lit(0))["name"]})


def _lookup(column: Column, table: dict, none: float) -> Column:
    out = F.when(column.isNull(), F.lit(none))
    for k, v in table.items():
        out = out.when(column == k, F.lit(v))
    return out.otherwise(F.lit(none))


def risk(df: DataFrame, text: str = "clean_text") -> DataFrame:
    """Adds the five signals, score, risk_level and confidence to a classified frame."""
    t = F.col(text)
    words = reduce(lambda a, b: a + b, (F.when(t.rlike(f"(?iU){p}"), F.lit(w)).otherwise(F.lit(0.0)) for p, w in rules.HIGH_RISK))
    out = df.withColumns(
        {
            "urgency_score": _lookup(F.col("urgency"), rules.URGENCY_SCORES, rules.URGENCY_NONE),
            "doc_type_score": _lookup(F.col("doc_type"), rules.DOC_TYPE_SCORES, rules.DOC_TYPE_NONE),
            "keyword_score": words / F.lit(float(len(rules.HIGH_RISK))),
            "scope_score": F.least(F.size("functions") / F.lit(4.0), F.lit(1.0)),
            "penalty_score": F.least(0.4 * F.regexp_count(t, F.lit(f"(?iU){rules.AMOUNT}")), F.lit(1.0)),
        }
    )
    total = 0.25 * F.col("urgency_score") + 0.15 * F.col("doc_type_score") + 0.30 * F.col("keyword_score") + 0.15 * F.col("scope_score") + 0.15 * F.col("penalty_score")
    out = out.withColumn("score", F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 4))
    strong = reduce(lambda a, b: a + b, (F.when(F.col(c) > 0.1, 1).otherwise(0) for c in ("urgency_score", "doc_type_score", "keyword_score", "scope_score")))
    sure = F.least(strong / F.lit(4.0) + F.when(F.size("topics") > 0, F.lit(0.1)).otherwise(F.lit(0.0)), F.lit(1.0))
    return out.withColumns({"risk_level": level_of(F.col("score")), "confidence": F.round(sure, 3), "impacted_areas": F.transform("functions", lambda f: f["name"])})


def level_of(score: Column) -> Column:
    """A score outside [0, 1] is an error."""
    score = F.when(score.isNull() | score.between(0, 1), score).otherwise(F.raise_error(F.lit("a risk score lies between 0 and 1")).cast("double"))
    return F.when(score < 0.25, "low").when(score < 0.5, "medium").when(score < 0.75, "high").when(score >= 0.75, "critical")


def severity(level: Column) -> Column:
    return _lookup(level, rules.SEVERITY, -1).cast("int")


def rationale(df: DataFrame) -> Column:
    """Lines that explain the score of a classified and scored document."""
    line = lambda name, value, sign: F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("unknown")), F.lit(" (weight: "), fixed(sign, 2), F.lit(")"))
    names = lambda array, field: F.array_join(F.transform(F.slice(array, 1, 5), lambda x: x[field]), ", ")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Risk level: "), F.upper("risk_level"), F.lit(" (score: "), fixed("score", 3), F.lit(")")),
        F.lit(""),
        line("Urgency signal", F.col("urgency"), F.col("urgency_score")),
        line("Document type", F.col("doc_type"), F.col("doc_type_score")),
        F.when(F.col("keyword_score") > 0, F.concat(F.lit("High-risk keywords detected (weight: "), fixed("keyword_score", 2), F.lit(")"))),
        F.when(F.size("functions") > 0, F.concat(F.format_string("Impacted functions (%d): ", F.size("functions")), names("functions", "name"))),
        F.when(F.col("penalty_score") > 0, F.concat(F.lit("Monetary penalty references detected (weight: "), fixed("penalty_score", 2), F.lit(")"))),
        F.when(F.size("topics") > 0, F.concat(F.lit("Topics: "), names("topics", "topic"))),
        F.concat(F.lit("Jurisdiction: "), jurisdiction_label("jurisdiction")),
        F.concat(F.lit("Reference: "), nullif_empty("reference_number")),
    )


def rationale_with_context(base: Column, citations: Column) -> Column:
    """A rationale followed by up to three related documents, an ARRAY<STRUCT<label, score, text>> in order."""
    told = F.transform(
        F.slice(citations, 1, 3),
        lambda c, i: F.concat(F.format_string("[%d] ", i + 1), c["label"], F.lit(" (similarity: "), fixed(c["score"], 3), F.lit(")\n    "), F.left(c["text"], F.lit(200))),
    )
    return F.when(F.size(citations) > 0, F.concat(base, F.lit("\n\n--- Related historical documents ---\n"), F.array_join(told, "\n"))).otherwise(base)


def action_keys() -> Column:
    """Keys of the follow-ups of a scored document, in order and without repeats."""
    serious = F.col("risk_level").isin("critical", "high")
    medium = F.col("risk_level") == "medium"
    has = lambda name: F.exists("functions", lambda f: f["name"] == name)
    reports = F.col("doc_type").isin("circular", "notification") & F.exists("topics", lambda x: x["topic"] == "reporting requirements")
    picks = (
        (serious, "escalation"),
        (serious | medium, "review"),
        (serious | medium, "gap_analysis"),
        (serious, "policy_update"),
        (~serious & ~medium, "acknowledgement"),
        (has("Technology"), "system_change"),
        (has("HR / Training") | serious, "training"),
        (F.coalesce(reports, F.lit(False)), "reporting"),
    )
    return F.array_distinct(F.array_compact(F.array(*(F.when(c, F.lit(k)) for c, k in picks))))


def action_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(rules.ACTIONS), "key string, owner string, days int, title_template string, description_template string")


def plan_actions(scored: DataFrame, as_of: Column, title: str = "title", reference: str = "reference_number") -> DataFrame:
    """One row per follow-up: id, no, key, owner, priority, title, description, due_date."""
    rows = scored.select("id", "risk_level", "urgency", "jurisdiction", title, reference, F.posexplode(action_keys()).alias("no", "key"))
    rows = rows.join(F.broadcast(action_templates(scored.sparkSession)), "key")  # a fixed table of eight rows
    factor = _lookup(F.col("urgency"), rules.URGENCY_DAYS, 1.0)
    days = F.greatest(F.lit(1), F.floor(F.col("days") * factor + 1e-9).cast("int"))

    def filled(template: str, size: int) -> Column:
        out = F.col(template)
        parts = {
            "doc_type": F.lit("document"),
            "title": F.coalesce(nullif_empty(title), F.lit("Untitled")),
            "reference": F.coalesce(nullif_empty(reference), F.lit("N/A")),
            "jurisdiction": jurisdiction_label("jurisdiction"),
            "risk_level": F.upper("risk_level"),
        }
        for k, v in parts.items():
            out = F.replace(out, F.lit("{" + k + "}"), v)
        return F.left(out, F.lit(size))

    return rows.select(
        "id",
        "no",
        "key",
        "owner",
        F.when(F.col("risk_level") == "critical", "urgent").otherwise(F.col("risk_level")).alias("priority"),
        filled("title_template", 256).alias("title"),
        filled("description_template", 8192).alias("description"),
        F.date_add(F.to_date(as_of), days).alias("due_date"),
    )
