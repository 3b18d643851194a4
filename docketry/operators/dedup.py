"""Exact and near duplicates by 64-bit simhash, with order-aware canonical documents.

The near join is lossless: if at most ``radius`` of 64 bits differ, then of ``radius + m`` blocks of
bits at least m are equal, whichever m is taken.  m grows with the number of fingerprints, so
that the keys, all choices of m blocks, stay selective.  Equal fingerprints are collapsed before
joining, so a group of copies costs one row, and the sequential rule "a document is a duplicate of
an earlier canonical one" is resolved in rounds over the link table.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import hamming, md5_64, shingles, tokens
from ..session import written

RADIUS = 6
BUCKET = 8  # fingerprints a key is to hold on average


def _votes(hashes: Column) -> Column:
    @F.pandas_udf(T.LongType())
    def run(lists: pd.Series) -> pd.Series:
        sizes = np.array([0 if x is None else len(x) for x in lists], np.int64)
        out = np.zeros(len(sizes), np.int64)
        some = np.flatnonzero(sizes)
        if len(some):
            flat = np.concatenate([x for x in lists if x is not None and len(x)]).astype(np.int64)
            ones = np.unpackbits(flat.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
            sums = np.add.reduceat(ones, (np.cumsum(sizes) - sizes)[some], axis=0)
            out[some] = np.ascontiguousarray(np.packbits(2 * sums > sizes[some][:, None], axis=1)).view(">i8").ravel()
        return pd.Series(out)

    return run(hashes)


def simhash_native(df: DataFrame, key: str, text: str, k: int = 2) -> DataFrame:
    """(key, simhash) with MD5-based votes: hashed in the JVM, summed over whole batches, nothing shuffled."""
    # words in a projection of their own: inside a lambda they would be split again for every sequence
    each = df.select(key, tokens(text).alias("w")).select(key, F.transform(shingles("w", k), md5_64).alias("h"))
    return each.select(key, F.coalesce(_votes(F.col("h")), F.lit(0).cast("long")).alias("simhash"))


def _blocks(simhash: Column, n: int) -> list[Column]:
    """The fingerprint cut into n runs of bits."""
    at, out = 0, []
    for i in range(n):
        width = 64 // n + (1 if i < 64 % n else 0)
        out.append(F.shiftrightunsigned(simhash, at).bitwiseAND(F.lit((1 << width) - 1)))
        at += width
    return out


def chosen_together(n_values: int, radius: int = RADIUS) -> int:
    """How many blocks make a key: the fewest that leave about ``BUCKET`` fingerprints to each."""
    for m in (1, 2, 3, 4):
        bits = 64 * m / (radius + m)
        if n_values <= BUCKET * 2**bits:
            break
    return m


def near_pairs(fingerprints: DataFrame, radius: int = RADIUS, together: int | None = None, asked: DataFrame | None = None) -> DataFrame:
    """(a, b, distance), a < b: pairs of distinct simhash values within the radius, each once.

    With ``asked`` (simhash) instead each of these as a with all its neighbours as b, larger or smaller.
    """
    values = fingerprints.select("simhash").where("simhash is not null").distinct()
    m = together or chosen_together(values.count(), radius)
    n = radius + m
    picks = list(combinations(range(n), m))
    keys = F.array(*(F.struct(F.lit(i).alias("pick"), F.xxhash64(*(_blocks(F.col("simhash"), n)[j] for j in pick)).alias("key")) for i, pick in enumerate(picks)))
    cut = values.select("simhash", F.explode(keys).alias("x")).select("simhash", "x.pick", "x.key")
    own = cut if asked is None else cut.join(asked.select("simhash").distinct(), "simhash", "left_semi").select("simhash", "pick", "key")
    pairs = own.withColumnRenamed("simhash", "a").join(cut.withColumnRenamed("simhash", "b"), ["pick", "key"]).where("a < b" if asked is None else "a <> b")
    pairs = pairs.withColumn("distance", hamming("a", "b")).where(F.col("distance") <= radius)
    # a pair is kept under the first pick of its equal blocks only
    equal = [(x == y).cast("int") for x, y in zip(_blocks(F.col("a"), n), _blocks(F.col("b"), n))]
    upto = [reduce(lambda s, e: s + e, equal[: j + 1]) for j in range(n)]
    first = F.concat_ws(",", *(F.when((equal[j] == 1) & (upto[j] <= m), F.lit(str(j))) for j in range(n)))
    name = F.get(F.array(*(F.lit(",".join(map(str, p))) for p in picks)), F.col("pick"))
    return pairs.where(first == name).select("a", "b", "distance")


def greedy_dedup(docs: DataFrame, radius: int = RADIUS, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, kind, matched, similarity) of (doc_id, ord, content_hash, simhash), in order of arrival.

    A document enters the index only if no earlier indexed one lies within the radius.
    ``exact``: an earlier indexed document has its content hash; ``near``: the nearest indexed
    one, the earliest on ties.  ``known`` (doc_id, ord, content_hash, simhash) is the index of
    earlier runs: all of it is indexed and comes before every document.  Documents with equal
    fingerprints behave alike, so only the first of each fingerprint can be indexed and the
    rounds run over distinct fingerprints, until none is open.
    """
    cols = ("doc_id", "ord", "content_hash", "simhash")
    rows = docs.select(*cols, F.lit(1).alias("new"))
    if known is not None:
        rows = known.select(*cols, F.lit(0).alias("new")).unionByName(rows)
    rows = rows.select("doc_id", F.struct("new", "ord").alias("ord"), "content_hash", "simhash")
    first = rows.groupBy("simhash").agg(F.min(F.struct("ord", "doc_id")).alias("head")).select("simhash", F.col("head.ord").alias("ord"), F.col("head.doc_id").alias("doc_id"))
    first = written(first, "dedup-first")
    if known is None:
        pairs = near_pairs(first, radius)
        both = pairs.select("a", "b", "distance").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    else:  # how known ones lie to each other decides nothing
        both = near_pairs(first, radius, asked=first.where("ord.new = 1"))
    order = first.select("simhash", "ord")
    earlier = both.join(order.toDF("a", "ord_a"), "a").where("ord_a.new = 1").join(order.toDF("b", "ord_b"), "b").where("ord_b < ord_a")
    earlier = written(earlier.select("a", "b", "ord_b", "distance"), "dedup-links")
    # 0 open, 1 indexed, 2 duplicate; a fingerprint without earlier neighbours is indexed
    state = first.select("simhash").join(earlier.select(F.col("a").alias("simhash")).distinct().withColumn("has", F.lit(1)), "simhash", "left")
    state = written(state.select("simhash", F.when(F.col("has").isNull(), 1).otherwise(0).alias("s")), "dedup-state")
    while state.where("s = 0").limit(1).count():  # each round decides the earliest open one at least
        seen = earlier.join(state.toDF("b", "s_b"), "b").groupBy("a").agg(F.max((F.col("s_b") == 1).cast("int")).alias("hit"), F.min((F.col("s_b") == 2).cast("int")).alias("gone"))
        new = F.when(F.col("s") != 0, F.col("s")).when(F.col("hit") == 1, 2).when(F.col("gone") == 1, 1).otherwise(0)
        state = written(state.join(seen.withColumnRenamed("a", "simhash"), "simhash", "left").select("simhash", new.alias("s")), "dedup-state")
    canon = first.join(state.where("s = 1").select("simhash"), "simhash")
    nearest = (
        earlier.join(canon.select(F.col("simhash").alias("b"), F.col("doc_id").alias("canon")), "b")
        .groupBy("a")
        .agg(F.min(F.struct("distance", "ord_b", "canon")).alias("m"))
        .select(F.col("a").alias("simhash"), F.col("m.canon").alias("near_id"), F.col("m.distance").alias("distance"))
    )
    own = canon.select("simhash", F.col("doc_id").alias("head_id"))
    indexed = canon.select("doc_id") if known is None else canon.select("doc_id").unionAll(known.select("doc_id")).distinct()
    heads = indexed.join(rows.select("doc_id", "ord", "content_hash"), "doc_id").groupBy("content_hash").agg(F.min(F.struct("ord", "doc_id")).alias("h"))
    out = (
        rows.where("ord.new = 1")
        .join(own, "simhash", "left")
        .join(nearest, "simhash", "left")
        .join(heads.select("content_hash", F.col("h.ord").alias("exact_ord"), F.col("h.doc_id").alias("exact_id")), "content_hash", "left")
    )
    unique = F.coalesce(F.col("head_id") == F.col("doc_id"), F.lit(False))
    exact = F.col("exact_id").isNotNull() & (F.col("exact_ord") < F.col("ord"))
    return out.select(
        "doc_id",
        F.when(unique, "unique").when(exact, "exact").otherwise("near").alias("kind"),
        F.when(unique, None).when(exact, F.col("exact_id")).otherwise(F.coalesce("head_id", "near_id")).alias("matched"),
        F.when(unique, 0.0).when(exact, 1.0).when(F.col("head_id").isNotNull(), 1.0).otherwise(1 - F.col("distance") / 64.0).alias("similarity"),
    )


def first_holders(docs: DataFrame) -> DataFrame:
    """(content_hash, doc_id): the first document of each content hash."""
    return docs.groupBy("content_hash").agg(F.min(F.struct("ord", "doc_id")).alias("h")).select("content_hash", F.col("h.doc_id").alias("doc_id"))
