"""Source registry, format detection, adapters and the content-addressed raw store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..session import exists

SCHEMA = (
    "id string, name string, jurisdiction string, url string, source_type string, description string, enabled boolean, "
    "crawl_frequency_minutes int, tags array<string>, created_at timestamp"
)


def from_dicts(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A registry of plain records; an id given twice is an error."""
    ids = [str(r["id"]).strip().lower() for r in rows]
    if double := sorted({i for i in ids if ids.count(i) > 1}):
        raise ValueError(f"duplicate source ids: {', '.join(double)}")
    full = [
        (i, r["name"], r["jurisdiction"], r["url"], r["source_type"], r.get("description"), bool(r.get("enabled", True)), int(r.get("crawl_frequency_minutes", 1440)), list(r.get("tags", ())), r.get("created_at"))
        for i, r in zip(ids, rows)
    ]
    return spark.createDataFrame(full, SCHEMA)


def from_yaml(spark: SparkSession, path: str) -> DataFrame:
    """A registry file with a top-level list ``sources``."""
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    if not isinstance(data.get("sources"), list):
        raise ValueError("a list named 'sources' is required")
    return from_dicts(spark, data["sources"])


def bundled(spark: SparkSession) -> DataFrame:
    fields = ("id", "name", "jurisdiction", "url", "source_type", "description", "crawl_frequency_minutes", "tags")
    return from_dicts(spark, [dict(zip(fields, s)) for s in rules.BUNDLED_SOURCES])


def get(sources: DataFrame, source_id: str) -> DataFrame:
    return sources.where(F.col("id") == source_id.strip().lower())


def jurisdictions(sources: DataFrame) -> DataFrame:
    return sources.select("jurisdiction").distinct()


def enabled(sources: DataFrame, jurisdiction: str | None = None) -> DataFrame:
    out = sources.where("enabled")
    return out if jurisdiction is None else out.where(F.col("jurisdiction") == jurisdiction)


def detect_format(content_type: Column, body: Column) -> Column:
    """By MIME type, then by the PDF signature, else text."""
    mime = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    return (
        F.when(mime.isin("text/html", "application/xhtml+xml"), "html")
        .when(mime == "application/pdf", "pdf")
        .when(mime == "application/json", "json")
        .when(mime.isin("application/xml", "text/xml") | mime.endswith("+xml"), "xml")
        .when(F.coalesce(body, F.lit("")).startswith("%PDF-"), "pdf")
        .otherwise("text")
    )


def is_feed(source_type: Column, content_format: Column) -> Column:
    return F.coalesce(source_type == "rss", F.lit(False)) | F.coalesce(content_format == "xml", F.lit(False))


def adapters(spark: SparkSession) -> DataFrame:
    """One row per jurisdiction: the patterns a link must hold, and whether it must stay on its host."""
    return spark.createDataFrame([(k, list(p), s) for k, (p, s) in rules.ADAPTERS.items()], "jurisdiction string, patterns array<string>, same_host boolean")


def register(adapters: DataFrame, jurisdiction: str, patterns: list[str], same_host: bool = True, replace: bool = False) -> DataFrame:
    """Adapters with one more; a jurisdiction that has one already is an error unless it is to be replaced."""
    if not replace and adapters.where(F.col("jurisdiction") == jurisdiction).limit(1).count():
        raise ValueError(f"an adapter is registered for {jurisdiction}")
    more = adapters.sparkSession.createDataFrame([(jurisdiction, list(patterns), same_host)], adapters.schema)
    return adapters.where(F.col("jurisdiction") != jurisdiction).unionByName(more)


def for_sources(sources: DataFrame, adapters: DataFrame) -> DataFrame:
    """Sources with patterns and same_host of their adapter; without one, the source's own url is all there is to fetch (has_adapter false)."""
    own = sources.join(adapters.withColumn("has_adapter", F.lit(True)), "jurisdiction", "left")
    return own.withColumn("has_adapter", F.coalesce("has_adapter", F.lit(False)))


def matches_adapter(url: Column, patterns: Column) -> Column:
    return F.exists(patterns, lambda p: F.lower(url).contains(p))


EXTENSIONS = {"html": "html", "pdf": "pdf", "json": "json", "xml": "xml"}


def store_path(jurisdiction: Column, source: Column, byte_hash: Column, content_format: Column) -> Column:
    ext = F.when(F.lit(False), F.lit(""))
    for k, v in EXTENSIONS.items():
        ext = ext.when(content_format == k, F.lit(v))
    return F.concat_ws("/", F.lower(jurisdiction), source, F.concat(byte_hash, F.lit("."), ext.otherwise("txt")))


def raw_store(raw: DataFrame) -> DataFrame:
    """(source_id, jurisdiction, byte_hash, path, content): every distinct content of a source once."""
    hashed = raw.where("content is not null").withColumn("byte_hash", F.sha2("content", 256))
    once = hashed.dropDuplicates(["source_id", "byte_hash"])
    return once.select("source_id", "jurisdiction", "byte_hash", store_path(F.col("jurisdiction"), F.col("source_id"), F.col("byte_hash"), F.col("content_format")).alias("path"), "content")


def metadata_record(raw: DataFrame) -> Column:
    """JSON that is kept beside a stored content."""
    return F.to_json(F.struct(*(F.col(c) for c in ("id", "source_id", "jurisdiction", "url", "content_format", "http_status", "fetched_at") if c in raw.columns)))


def write_store(raw: DataFrame, path: str) -> None:
    """Adds contents the store does not hold yet; writing the same again changes nothing."""
    spark = raw.sparkSession
    new = raw_store(raw)
    if exists(spark, path):
        held = spark.read.parquet(path).select(F.col("source_id").cast("string").alias("source_id"), "byte_hash").distinct()
        new = new.join(held, ["source_id", "byte_hash"], "left_anti")
    new.write.mode("append").partitionBy("jurisdiction", "source_id").parquet(path)
