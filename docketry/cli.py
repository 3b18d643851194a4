"""Command line: run, backfill, status, sources."""

from __future__ import annotations

import argparse
import sys
import uuid
from datetime import UTC, datetime

from pyspark.sql import functions as F

from . import pipeline
from .operators import state
from .session import build_session
from .settings import configure_logging, load_settings, require
from .sources import fetch, registry
from .streaming import jobs


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="docketry")
    top.add_argument("--config", help="YAML file with settings")
    top.add_argument("--master", help="Spark master")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("run", "backfill"):
        p = sub.add_parser(name)
        p.add_argument("--raw", help="parquet folder of fetched pages; without it the sources are crawled")
        p.add_argument("--source", action="append", help="only these source ids")
        if name == "run":
            p.add_argument("--loop", action="store_true", help="run again at intervals as pages arrive in --raw")
            p.add_argument("--interval", type=int, default=60, help="minutes")
    p = sub.add_parser("status")
    p.add_argument("--run-id")
    p = sub.add_parser("sources")
    return top


def crawled(spark, settings, only):
    """Fetched pages of the bundled sources as raw_documents rows."""
    sources = registry.enabled(registry.bundled(spark))
    sources = sources.where(F.col("id").isin(only)) if only else sources
    c = settings.crawl
    pages = fetch.crawl(sources, registry.adapters(spark), fetch.Fetcher(c.agent, c.rate_per_sec, c.timeout, c.retries, c.backoff, c.robots))
    good = fetch.as_raw(pages.where("error is null"))
    return good.select(F.sha2("url", 256).alias("id"), "source_id", "jurisdiction", F.lit(None).cast("string").alias("title"), F.col("text").alias("content"), "content_format", "fetched_at")


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    settings = load_settings(args.config)
    configure_logging(settings.app.log_level, settings.app.log_format)
    spark = build_session(master=args.master)
    path = require(settings.storage.tables, "storage.tables") if args.command != "sources" else ""
    now = F.lit(datetime.now(UTC).replace(tzinfo=None)).cast("timestamp")
    if args.command == "sources":
        for r in registry.bundled(spark).orderBy("id").collect():  # a fixed list
            print(f"{r.id:<25} {r.jurisdiction:<12} {r.source_type:<8} {'yes' if r.enabled else 'no':<8} {r.name}")
        return 0
    if args.command == "status":
        markers = pipeline.stored(spark, path, "markers")
        if markers is None:
            print("No pipeline runs recorded yet.")
            return 0
        run_id = args.run_id or state.last_run(markers.withColumn("id", F.monotonically_increasing_id())).first().run_id
        print(f"Run {run_id}")
        for r in state.stage_counts(markers, run_id).orderBy("stage_no").collect():  # ten stages
            print(f"  {r.stage:20s}: {r.n_documents} document(s)")
        waiting = state.pending_approvals(pipeline.stored(spark, path, "approvals"))
        print(f"Pending approvals: {waiting.count()}")
        for r in waiting.limit(5).collect():
            print(f"  [{r.risk_level}] {(r.title or '')[:50]} (id: {r.approval_id[:8]})")
        return 0
    step = lambda raw: pipeline.run_stored(raw, path, uuid.uuid4().hex[:8], now, args.command == "backfill")
    keep = lambda raw: raw.where(F.col("source_id").isin(args.source)) if args.source else raw
    if args.command == "run" and args.loop:
        if not args.raw:
            print("--loop needs --raw", file=sys.stderr)
            return 2
        jobs.run_loop(jobs.read_stream(spark, args.raw), lambda raw, _: step(keep(raw)), f"{path}/loop-checkpoint", args.interval).awaitTermination()
        return 0
    raw = spark.read.parquet(args.raw) if args.raw else crawled(spark, settings, args.source)
    done = step(keep(raw)).first()
    print(f"Done: {done.processed} processed, {done.duplicates} duplicates, {done.errors} errors.")
    return 0


if __name__ == "__main__":
    sys.exit(main())
