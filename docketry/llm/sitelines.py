"""Problem 5: lines repeated across one site's documents.

Equal documents of a source are collapsed first; each line is then counted over the distinct
document clusters (with the ids they stand for) and over their publication days, so that an
article published again and again adds one cluster and one day.  Stripping judges lines by
clusters and days, the line numbers that p5_found asks for by ids.  The text is read once: all
counting runs on 64-bit keys of the normalised lines.

Defined results: NULL or empty texts have no lines; re-sent rows (same id) count once; a NULL
source is a source of its own; a cluster without a date is a day of its own; empty lines are never reported; extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash64, sliced, written

MIN_DOCS = 3
MIN_SHARE = 0.1
_BLANKS = re.compile(r"[ \t\xa0]+")
_DIGITS = re.compile(r"[0-9]+")


def line_form(line: str) -> str:
    """Lines with the same form are the same line; "" is an empty line."""
    return _DIGITS.sub("0", _BLANKS.sub(" ", line).strip(" ").lower())


def _keys(batches):
    known: dict[str, int] = {}
    for batch in batches:
        keys, hashes = [], []
        for text in batch.column("clean_text").to_pylist():
            if not text:
                keys.append([]), hashes.append(0)
                continue
            hashes.append(hash64(text))
            row = []
            for line in text.split("\n"):
                form = line_form(line)
                key = known.get(form)
                if key is None:
                    if len(known) > 200_000:
                        known.clear()
                    key = known[form] = (hash64(form) or 1) if form else 0
                row.append(key)
            keys.append(row)
        head = [batch.column(c) for c in ("id", "source_id", "day")]
        yield pa.RecordBatch.from_arrays(
            [*head, pa.array(hashes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
            names=["id", "source_id", "day", "text_hash", "keys"],
        )


def line_keys(parsed: DataFrame) -> DataFrame:
    """(id, source_id, day, text_hash, keys): one row per document, keys in line order, 0 for empty lines."""
    slim = parsed.select("id", F.coalesce("source_id", F.lit("")).alias("source_id"), F.to_date("published_at").alias("day"), "clean_text")
    keyed = slim.mapInArrow(sliced(_keys), "id string, source_id string, day date, text_hash bigint, keys array<bigint>")
    return written(keyed, "line-keys").dropDuplicates(["source_id", "id"])


def repeated_lines(keyed: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, by_ids: bool = True) -> DataFrame:
    """(source_id, key, n_docs, n_clusters, n_days): the lines repeated within their source.

    by_ids: the limits hold for ids; else for clusters, which must lie on min_docs days too, or on
    all days of a source that has fewer.
    """
    clusters = keyed.groupBy("source_id", "text_hash").agg(F.count("*").alias("n_ids"), F.first("keys").alias("keys"), F.min("day").alias("day"))
    days = (F.size(F.collect_set("day")) + F.count_if(F.col("day").isNull())).cast("int")
    lines = clusters.select("source_id", "n_ids", "day", F.explode(F.array_distinct("keys")).alias("key")).where("key <> 0")
    counts = lines.groupBy("source_id", "key").agg(F.sum("n_ids").alias("n_docs"), F.count("*").alias("n_clusters"), days.alias("n_days"))
    if by_ids:
        counted, totals = "n_docs", keyed.groupBy("source_id").agg(F.count("*").alias("n_all"))
    else:
        counted, totals = "n_clusters", clusters.where("text_hash <> 0").groupBy("source_id").agg(F.count("*").alias("n_all"), days.alias("all_days"))
    found = counts.where(F.col(counted) >= min_docs).join(totals, "source_id").where(F.col(counted) >= min_share * F.col("n_all"))
    if not by_ids:
        found = found.where(F.col("n_days") >= F.least(F.lit(min_docs), "all_days"))
    return found.select("source_id", "key", "n_docs", "n_clusters", "n_days")


def repeated_line_numbers(parsed: DataFrame, **limits) -> DataFrame:
    """(id, line_no, n_docs, n_clusters, n_days): where the repeated lines stand."""
    keyed = line_keys(parsed)
    found = repeated_lines(keyed, **limits)
    lines = keyed.select("id", "source_id", F.posexplode("keys").alias("line_no", "key")).where("key <> 0")
    return lines.join(found, ["source_id", "key"]).select("id", "line_no", "n_docs", "n_clusters", "n_days")


def strip_repeated_lines(parsed: DataFrame, **limits) -> DataFrame:
    """(id, stripped, n_removed): every document without the repeated lines of its source, counted over clusters and days."""
    gone = repeated_line_numbers(parsed, by_ids=False, **limits).groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    docs = parsed.select("id", "clean_text").dropDuplicates(["id"]).join(gone, "id", "left")
    lines = F.split("clean_text", "\n", -1)
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~F.array_contains("gone", s["i"]))
    stripped = F.when(F.col("gone").isNull(), F.col("clean_text")).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    return docs.select("id", stripped.alias("stripped"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
