"""Problem 8: mixing sources to target weights.

Hierarchical budgeting over the tree domain -> language -> source: a source's share is split over
its languages by its own tokens, shares are summed up the tree, the budget flows down in
proportion, and what a leaf cannot fill (all its records, each used ``max_repeats`` times) goes to
its siblings that still have room, before it is handed to the level above.  Each leaf (a source in
one language) then fills its budget from seeded epochs, each in an order of its own: whole epochs,
which need no order, and a prefix by tokens of the last one.

The budget is ``total_tokens``, or ``epochs`` times the tokens of all listed sources.

Running sums are made per bucket of the seeded order, so no leaf is sorted in one task.

Defined results: NULL and empty texts hold no tokens and are not used; sources without target
are left out; targets without documents are reported with their shortfall; a NULL language
counts as "und"; re-sent doc_ids are used once; ties of the seeded order are broken by doc_id.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, written

TOKENIZER_DIR = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-splitting pattern published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEED = 20260301
BUCKETS = 64  # parts of a source's seeded order


def token_counts(documents: DataFrame, directory: str = TOKENIZER_DIR, name: str = RANKS) -> DataFrame:
    """(doc_id, source, lang, n_tokens): whole texts in tokens of the public tokenizer."""
    holder: dict = {}

    def run(batches):
        import base64

        import tiktoken

        if "enc" not in holder:
            with open(f"{directory}/{name}", "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            holder["enc"] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        count = holder["enc"].encode_ordinary
        for batch in batches:
            sizes = [len(count(text)) for text in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64())], names=["doc_id", "source", "lang", "n_tokens"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    slim = documents.where("text is not null and text <> '' and doc_id is not null").select("doc_id", "source", F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return slim.mapInArrow(sliced(run), f"doc_id {id_type}, source string, lang string, n_tokens bigint")


def _fill(children: dict, weights: dict, room: dict, amount: float) -> dict:
    """Water-filling among siblings: in proportion to weight, never above room."""
    out = dict.fromkeys(children, 0.0)
    open_, left = {c for c in children if weights[c] > 0 and room[c] > 0}, amount
    while open_ and left > 1e-6:
        total = sum(weights[c] for c in open_)
        full = {c for c in open_ if out[c] + left * weights[c] / total >= room[c]}
        if not full:
            for c in open_:
                out[c] += left * weights[c] / total
            return out
        for c in full:
            left -= room[c] - out[c]
            out[c] = room[c]
        open_ -= full
    return out


def budgets(leaves: list[tuple[str, str, object, float, float]], total: float) -> dict:
    """Budget of each leaf; leaves are (domain, language, name, share, room).

    Every leaf first gets its share of the total; a shortage is filled by siblings under the
    same language, then within the domain, then anywhere.
    """
    got = {s: min(total * share, room) for _, _, s, share, room in leaves}
    short = {s: total * share - got[s] for _, _, s, share, _ in leaves}
    weight = {s: share for _, _, s, share, _ in leaves}
    room = {s: r for _, _, s, _, r in leaves}
    for level in (lambda x: (x[0], x[1]), lambda x: x[0], lambda x: ""):
        groups = defaultdict(list)
        for leaf in leaves:
            groups[level(leaf)].append(leaf[2])
        for members in groups.values():
            need = sum(short[s] for s in members)
            if need <= 0:
                continue
            extra = _fill(members, weight, {s: room[s] - got[s] for s in members}, need)
            given = sum(extra.values())
            for s in members:
                got[s] += extra[s]
                short[s] *= 1 - given / need
    return got


def mix(documents: DataFrame, targets: DataFrame, sources: DataFrame, total_tokens: int | None = None, epochs: float = 1.0, seed: int = SEED):
    """(mix, plan): the records with their repeats, and budget, tokens, target and repeats allowed of each leaf (source, language)."""
    counts = written(token_counts(documents).dropDuplicates(["doc_id"]), "mix-tokens")
    goal = targets.select("source", "target_share", "max_repeats")
    listed = counts.where("source is not null")
    per = listed.groupBy("source", "lang").agg(F.sum("n_tokens").alias("tokens"))
    domain = sources.select(F.col("id").alias("source"), F.col("jurisdiction").alias("domain")).dropDuplicates(["source"])
    # a row per listed source and language: as many as mix_targets has, times the languages
    rows = sorted(goal.join(per, "source", "left").join(domain, "source", "left").collect(), key=lambda r: (r.source or "", r.lang or ""))
    of_source: defaultdict = defaultdict(int)
    for r in rows:
        of_source[r.source] += r.tokens or 0
    leaves = []
    for r in rows:
        part = r.tokens / of_source[r.source] if of_source[r.source] else 1.0
        share, room = float(r.target_share or 0.0) * part, float((r.tokens or 0) * max(int(r.max_repeats or 0), 0))
        leaves.append((r.domain or "", r.lang or "und", (r.source, r.lang), share, room))
    total = float(total_tokens) if total_tokens is not None else epochs * sum(of_source.values())
    plan = budgets(leaves, total)
    spark = documents.sparkSession
    plan_rows = [(r.source, r.lang, plan[r.source, r.lang], int(r.tokens or 0), int(r.max_repeats or 0), leaf[3], float(r.target_share or 0.0)) for r, leaf in zip(rows, leaves)]
    plan_df = F.broadcast(spark.createDataFrame(plan_rows, "source string, lang string, budget double, tokens bigint, max_repeats int, leaf_share double, target_share double"))

    placed = (
        listed.join(plan_df.where("lang is not null").drop("target_share", "leaf_share"), ["source", "lang"])
        .withColumn("whole", F.floor(F.col("budget") / F.greatest("tokens", F.lit(1))).cast("int"))
        .withColumn("place", F.xxhash64(F.lit(seed), "whole", "doc_id"))
        .withColumn("bucket", F.pmod(F.shiftright("place", 40), F.lit(BUCKETS)))
    )
    by_bucket = placed.groupBy("source", "lang", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    before = by_bucket.withColumn("before", F.sum("in_bucket").over(Window.partitionBy("source", "lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy("source", "lang", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    run = (
        placed.join(before.select("source", "lang", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["source", "lang", "bucket"])
        .withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    )
    # the prefix stops where it comes nearest to the rest: the record across the line is in if more than half of it fits
    last = (F.col("upto") - F.col("n_tokens") / 2) < F.col("rest")
    repeats = F.least(F.col("whole") + F.when(last, 1).otherwise(0), F.col("max_repeats"))
    used = run.withColumn("repeats", repeats.cast("int")).where("repeats > 0").select("doc_id", "source", "lang", "n_tokens", "repeats")
    return used, plan_df


def mix_report(used: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, target_share, budget_share, actual_share, tokens, used_tokens, records, max_used, repeats, shortfall_tokens)."""
    got = used.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"), F.count("*").alias("records"), F.max("repeats").alias("max_used"), F.sum("repeats").alias("uses")
    )
    whole = Window.partitionBy()  # as many rows as mix_targets has
    per = plan.groupBy("source").agg(F.sum("budget").alias("budget"), F.sum("tokens").alias("tokens"), F.first("target_share").alias("target_share"))
    rows = per.join(got, "source", "left").withColumn("total", F.sum("budget").over(whole))
    used_tokens = F.coalesce("used_tokens", F.lit(0))
    return rows.select(
        "source",
        "target_share",
        F.round(F.col("budget") / F.col("total"), 6).alias("budget_share"),
        F.round(used_tokens / F.sum(used_tokens).over(whole), 6).alias("actual_share"),
        F.col("tokens"),
        used_tokens.alias("used_tokens"),
        F.coalesce("records", F.lit(0)).alias("records"),
        F.coalesce("max_used", F.lit(0)).alias("max_used"),
        F.round(F.coalesce(F.col("uses") / F.col("records"), F.lit(0.0)), 4).alias("repeats"),
        F.greatest(F.round(F.col("target_share") * F.col("total")).cast("long") - used_tokens, F.lit(0)).alias("shortfall_tokens"),
    )
