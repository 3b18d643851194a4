"""Problem 2: new batches against everything accepted before.

The metric is the Jaccard distance of the sets of two-word sequences; with t = 0.7 two sets
agree if their symmetric difference is at most (1 - t) / (1 + t) of their summed sizes, and the
symmetric difference is a metric too.  Its pivots are fixed by hashing: the empty set (the
distance is the set's size) and, for each of 128 parts of the universe of sequences, the empty
set of that part (the distance is the number of the document's sequences in it).  A document's
row in the pivot table holds these distances.  By the triangle inequality the differences of
the part distances sum up to no more than the true distance.

Pivot distances alone would compare each new document with all of similar size, which grows
quadratically; so the range join on the first pivot distance also asks for a shared anchor: of
a set's sequences in a fixed rare-first order the first (1 - t) * size + 1 must share one with
any set that agrees (lossless for any order).  The order is fitted once, on the whole history, and
stored; every document is indexed by it.

The history is read from its stored pivot table (``PivotIndex``), which is partitioned by range of
the first pivot distance: incoming documents open only the ranges they can reach, and of these
only anchors that a new document holds too leave the scan (a bitmap of 64 MB at most picks them).
Anchors shared by very many documents are split by salt.  The pairs that survive the pivots are
verified on the whole texts.  Several batches may be checked at a time, each row with its day.

Defined results: NULL or empty texts and texts of one word have no sequences and pair with
nothing; re-sent rows count once with their first time; equal sets are one class and compared
once; documents without a text row are left out; rows without created_at pair with nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_filter, may_contain, sliced, written
from .hashing import Rolling, mix

SIMILARITY = 0.7
PARTS = 128
SKETCH = 1 << 22  # slots of the sequence counts that set the order
RANGE = 1 << 16
TASK_ANCHORS = 400_000  # anchors a task of the range join is to hold
SALT_SLOTS = 1 << 20
HOT = 20_000  # postings of a slot of anchors that one task judges
PAIRS_AT_ONCE = 200_000
PIVOT_SCHEMA = "doc_id string, set_hash bigint, n int, parts binary, anchors array<bigint>"


def sequences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text no, hash) of the two-word sequences of a batch of texts, in order and with repeats."""
    raw = ("\n\x00\n".join((t or "").lower() for t in texts) + "\n").encode("utf-8", "surrogatepass")
    codes = np.frombuffer(raw, np.uint8)
    blank = (codes == 32) | (codes == 10)
    inside = ~blank
    begin = np.flatnonzero(inside & np.concatenate(([True], blank[:-1])))
    end = np.flatnonzero(inside & np.concatenate((blank[1:], [True]))) + 1
    if len(begin) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    mark = (codes[begin] == 0) & (end - begin == 1)
    owner = np.cumsum(mark)
    words = Rolling(codes).spans(begin, end)
    ok = (owner[1:] == owner[:-1]) & ~mark[1:] & ~mark[:-1]
    pairs = mix(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:])[ok]
    return owner[:-1][ok], pairs


def sequence_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text no, hash) of the distinct two-word sequences of a batch of texts, sorted by text and hash."""
    own, pairs = sequences(texts)
    bits = len(texts).bit_length()
    order = np.argsort((own.astype(np.uint64) << np.uint64(64 - bits)) | (pairs >> np.uint64(bits)))
    own, pairs = own[order], pairs[order]
    first = np.ones(len(own), bool)
    first[1:] = (own[1:] != own[:-1]) | (pairs[1:] != pairs[:-1])
    return own[first], pairs[first]


def _slot(pairs: np.ndarray) -> np.ndarray:
    return (pairs >> np.uint64(42)).astype(np.int64)


def _sketch(batches):
    counts = np.zeros(SKETCH, np.int64)
    for batch in batches:
        _, pairs = sequences(batch.column(0).to_pylist())
        np.add.at(counts, _slot(pairs), 1)
    some = np.flatnonzero(counts)
    for i in range(0, len(some), 100_000):
        part = some[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part])], names=["slot", "n"])


def sequence_ranks(texts: DataFrame) -> DataFrame:
    """(range, ranks): rank of each slot by how often its sequences occur, in powers of 2 ** 0.125; 0 never."""
    counts = texts.select("clean_text").mapInArrow(sliced(_sketch), "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    return counts.groupBy((F.col("slot") / RANGE).cast("int").alias("range")).applyInPandas(_pack, "range int, ranks binary")


def _pack(counts: pd.DataFrame) -> pd.DataFrame:
    slot = counts["slot"].to_numpy()
    ranks = np.zeros(RANGE, np.uint8)
    ranks[slot % RANGE] = np.minimum(1 + np.ceil(8 * np.log2(np.maximum(counts["n"].to_numpy(), 1))), 255)
    return pd.DataFrame({"range": [int(slot[0]) // RANGE], "ranks": [ranks.tobytes()]}).astype({"range": "int32"})


def _picked(shared, run):
    """``run`` over the rows whose key, the last column, passes the bitmap (all rows, where there is none)."""
    if shared is None:
        return sliced(run)

    def parts(batches):
        for batch in batches:
            keys = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)
            yield batch.take(pa.array(np.flatnonzero(may_contain(shared.value, keys))))

    return lambda batches: sliced(run)(parts(batches))


def pivot_table(texts: DataFrame, ranks, similarity: float = SIMILARITY, picked=None) -> DataFrame:
    """PIVOT_SCHEMA: pivot distances and anchors, in order, of (doc_id, clean_text); ``ranks`` and the bitmap ``picked`` of ids are broadcasts."""

    def run(batches):
        order_of = ranks.value
        for batch in batches:
            owner, pairs = sequence_sets(batch.column(1).to_pylist())
            if not len(owner):
                continue
            docs, start = np.unique(owner, return_index=True)
            n = np.diff(np.append(start, len(owner)))
            group = np.repeat(np.arange(len(docs)), n)
            parts = np.bincount(group * PARTS + (pairs & np.uint64(PARTS - 1)).astype(np.int64), minlength=len(docs) * PARTS)
            # remainders of 16, two to a byte: their circular difference still obeys the bound
            parts = parts.reshape(len(docs), PARTS).astype(np.uint8) & 15
            parts = parts[:, : PARTS // 2] | (parts[:, PARTS // 2 :] << 4)
            set_hash = mix(np.add.reduceat(mix(pairs), start) ^ n.astype(np.uint64)).view(np.int64)
            bits = len(docs).bit_length()
            rank = order_of[_slot(pairs)].astype(np.uint64)
            by = np.argsort((group.astype(np.uint64) << np.uint64(64 - bits)) | (rank << np.uint64(56 - bits)) | (pairs >> np.uint64(8 + bits)))
            place = np.arange(len(by)) - np.repeat(start, n)
            need = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
            use = by[place < np.repeat(need, n)]
            offsets = np.concatenate(([0], np.cumsum(need))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(docs)),
                    pa.array(set_hash),
                    pa.array(n.astype(np.int32)),
                    pa.array([row.tobytes() for row in parts], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(pairs[use].view(np.int64))),
                ],
                names=["doc_id", "set_hash", "n", "parts", "anchors"],
            )

    return texts.select("doc_id", "clean_text", F.xxhash64("doc_id").alias("key")).mapInArrow(_picked(picked, run), PIVOT_SCHEMA)


def _bands(n: np.ndarray, similarity: float) -> np.ndarray:
    """Range of the first pivot distance, the size; the sizes that can agree lie in one range or two that touch."""
    return np.floor(np.log(n) / (-3 * np.log(similarity))).astype(np.int64)


def _with_band(rows: DataFrame, similarity: float) -> DataFrame:
    return rows.withColumn("band", F.floor(F.log(F.col("n")) / float(-3 * np.log(similarity))).cast("int"))


def _anchor_counts(shared):
    """(anchor, n): how many rows of a task hold each anchor that passes the bitmap."""

    def run(batches):
        for batch in batches:
            anchors = batch.column(0).flatten().to_numpy()
            anchors, n = np.unique(anchors[may_contain(shared.value, anchors.view(np.uint64))], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(n)], names=["anchor", "n"])

    return run


def _scatter(parts: int, similarity: float, useful, salts):
    """Rows of the range join: each class once per task that holds some of its useful anchors in its range of sizes.

    Where an anchor is salted, its postings are spread over as many tasks, each of which is asked.
    """
    share = similarity / (1 + similarity)

    def run(batches):
        n_salts = salts.value
        for batch in batches:
            cols = {k: batch.column(k) for k in batch.schema.names}
            n = cols["n"].to_numpy()
            sizes = np.diff(cols["anchors"].offsets.to_numpy())
            anchors = cols["anchors"].flatten().to_numpy()
            row = np.repeat(np.arange(len(n)), sizes)
            place = np.arange(len(anchors)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            new = cols["is_new"].to_numpy(zero_copy_only=False)
            # the smallest partner, similarity * size, must still be within reach of the place
            ok = n[row] - place >= share * (n[row] * (1 + similarity)) - 1e-6
            ok[ok] = may_contain(useful.value, anchors[ok].view(np.uint64))
            row, anchors, place = row[ok], anchors[ok], place[ok]
            own = _bands(n, similarity)
            set_hash = cols["set_hash"].to_numpy().view(np.uint64)
            split = n_salts[(anchors.view(np.uint64) & np.uint64(SALT_SLOTS - 1)).astype(np.int64)].astype(np.int64)
            low, high = _bands(np.maximum(similarity * n, 1), similarity), _bands(n / similarity, similarity)
            task, src, key, at, role = [], [], [], [], []
            for asks, shift in ((False, 0), (True, -1), (True, 0), (True, 1)):
                band = own[row] + shift
                use = np.ones(len(row), bool) if not asks else new[row] & (band >= low[row]) & (band <= high[row])
                use = np.flatnonzero(use)
                if asks:  # of every salt
                    salt = np.arange(split[use].sum()) - np.repeat(np.cumsum(split[use]) - split[use], split[use])
                    use = np.repeat(use, split[use])
                else:
                    salt = (set_hash[row[use]] % split[use].astype(np.uint64)).astype(np.int64)
                mixed = mix(anchors[use].view(np.uint64) + (band[use] + (salt << 16)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                task.append((mixed % np.uint64(parts)).astype(np.int64))
                src.append(row[use]), key.append(mixed.view(np.int64)), at.append(place[use]), role.append(np.full(len(use), asks))
            task, src, key, at, role = map(np.concatenate, (task, src, key, at, role))
            order = np.argsort((task * len(n) + src) * 2 + role)
            task, src, key, at, role = task[order], src[order], key[order], at[order], role[order]
            if not len(task):
                continue
            start = np.flatnonzero(np.concatenate(([True], (task[1:] != task[:-1]) | (src[1:] != src[:-1]) | (role[1:] != role[:-1]))))
            offsets = pa.array(np.append(start, len(task)).astype(np.int32))
            take = pa.array(src[start])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(task[start].astype(np.int32)),
                    pa.array(role[start]),
                    cols["set_hash"].take(take),
                    cols["n"].take(take),
                    cols["parts"].take(take),
                    pa.ListArray.from_arrays(offsets, pa.array(key)),
                    pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32))),
                ],
                names=["task", "asks", "set_hash", "n", "parts", "anchors", "places"],
            )

    return run


def _range_join(similarity: float):
    """Pairs of one task that share an anchor and range and that sizes, places and pivots allow."""
    share, apart = similarity / (1 + similarity), (1 - similarity) / (1 + similarity)

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        col = lambda k: table.column(k).chunk(0) if table.column(k).num_chunks == 1 else table.column(k).combine_chunks()
        ids, n, asks = col("set_hash").to_numpy(), col("n").to_numpy().astype(np.int64), col("asks").to_numpy(zero_copy_only=False)
        packed = np.frombuffer(b"".join(col("parts").to_pylist()), np.uint8).reshape(len(ids), -1)
        parts = np.concatenate([packed & 15, packed >> 4], axis=1)
        lists = col("anchors")
        sizes = np.diff(lists.offsets.to_numpy())
        keys, places = lists.flatten().to_numpy(), col("places").flatten().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(ids)), sizes)
        keys = (keys.view(np.uint64) & ~np.uint64(1)) | asks[row].astype(np.uint64)  # those that ask come last
        order = np.argsort(keys)
        keys, places, row = keys[order] >> np.uint64(1), places[order], row[order]
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        stop = np.append(start[1:], len(keys))
        asked = np.concatenate(([0], np.cumsum(asks[row])))
        n_asks = asked[stop] - asked[start]
        n_old = (stop - start) - n_asks
        found: list[np.ndarray] = []

        def check(old: np.ndarray, new: np.ndarray) -> None:
            a, b = row[old], row[new]
            na, nb = n[a], n[b]
            least = share * (na + nb) - 1e-9
            ok = (ids[a] != ids[b]) & (na - places[old] >= least) & (nb - places[new] >= least)
            ok &= (na >= similarity * nb - 1e-9) & (nb >= similarity * na - 1e-9)
            a, b = a[ok], b[ok]
            x, y = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
            by = np.argsort(mix(x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + y.view(np.uint64)))  # judge each pair once
            first = np.ones(len(by), bool)
            first[1:] = (x[by][1:] != x[by][:-1]) | (y[by][1:] != y[by][:-1])
            by = by[first]
            a, b, x, y = a[by], b[by], x[by], y[by]
            diff = (parts[a] - parts[b]) & 15
            diff = np.minimum(diff, 16 - diff).sum(axis=1)
            near = diff <= apart * (n[a] + n[b]) + 1e-9
            if near.any():
                found.append(np.stack([x[near], y[near]]))

        olds, news, waiting = [], [], 0
        for g in np.flatnonzero((n_asks > 0) & (n_old > 0)):
            first_new = stop[g] - n_asks[g]
            step = max(1, PAIRS_AT_ONCE // int(n_old[g]))
            for at in range(int(first_new), int(stop[g]), step):  # hot anchors are judged in slices
                part = np.arange(at, min(at + step, stop[g]))
                olds.append(np.tile(np.arange(start[g], first_new), len(part)))
                news.append(np.repeat(part, n_old[g]))
                waiting += len(olds[-1])
                if waiting >= PAIRS_AT_ONCE:
                    check(np.concatenate(olds), np.concatenate(news))
                    olds, news, waiting = [], [], 0
        if waiting:
            check(np.concatenate(olds), np.concatenate(news))
        if found:
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            for i in range(0, pairs.shape[1], 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0, i : i + 50_000]), pa.array(pairs[1, i : i + 50_000])], names=["a", "b"])

    return run


def candidates(classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): pairs of classes, at least one of them new, that pivots and anchors allow.

    ``classes`` has (set_hash, n, parts, anchors, is_new).  The join is partitioned by anchor and range of the
    first pivot distance; pruning happens inside it, so that only pairs the triangle inequality
    allows leave a task.
    """
    spark = classes.sparkSession
    asked = classes.where("is_new").select(F.explode("anchors").alias("anchor"))
    n_asked = classes.where("is_new").agg(F.coalesce(F.sum(F.size("anchors")), F.lit(0))).first()[0]
    picked = spark.sparkContext.broadcast(bit_filter(asked.select(F.col("anchor").alias("key")), n_asked))
    held = classes.where("not is_new").select("anchors").mapInArrow(_anchor_counts(picked), "anchor bigint, n bigint")
    counts = asked.select("anchor", F.lit(1).cast("bigint").alias("n"), F.lit(True).alias("new")).unionByName(held.withColumn("new", F.lit(False)))
    # an anchor that only one document, or no new one, holds can match nothing
    shared = written(counts.groupBy("anchor").agg(F.sum("n").alias("n"), F.max("new").alias("new")).where("new and n > 1").select("anchor", "n"), "shared-anchors")
    count, total = shared.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    useful = spark.sparkContext.broadcast(bit_filter(shared.select(F.col("anchor").alias("key")), count))
    slots = shared.groupBy(F.col("anchor").bitwiseAND(F.lit(SALT_SLOTS - 1)).alias("slot")).agg(F.sum("n").alias("n"))
    limit = max(HOT, 4 * total // SALT_SLOTS)
    n_salts = np.ones(SALT_SLOTS, np.uint16)
    for r in slots.where(F.col("n") > limit).collect():  # SALT_SLOTS rows at most
        n_salts[r["slot"]] = min(-(-r["n"] // limit), 65_000)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ANCHORS))
    rows = classes.select("set_hash", "n", "parts", "anchors", "is_new").mapInArrow(
        _scatter(parts, similarity, useful, spark.sparkContext.broadcast(n_salts)),
        "task int, asks boolean, set_hash bigint, n int, parts binary, anchors array<bigint>, places array<int>",
    )
    return rows.repartition(parts, "task").mapInArrow(_range_join(similarity), "a bigint, b bigint").distinct()


def _sets(batches):
    for batch in batches:
        owner, pairs = sequence_sets(batch.column(1).to_pylist())
        docs, start = np.unique(owner, return_index=True)
        offsets = np.append(start, len(owner)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(docs)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(pairs.view(np.int64)))], names=["doc_id", "seqs"]
        )


def verify(pairs: DataFrame, reps: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity) of the pairs that agree, by the whole texts of their representatives.

    ``reps`` has (set_hash, doc_id), ``texts`` (doc_id, clean_text).  Only asked documents' texts
    are made into sets: a bitmap of their ids goes to the tasks, and what passes is joined.
    """
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("set_hash")).distinct().join(reps.select("set_hash", "doc_id"), "set_hash"), "asked")
    picked = _id_filter(asked, asked.count())
    rows = texts.select("doc_id", "clean_text", F.xxhash64("doc_id").alias("key")).mapInArrow(_picked(picked, _sets), "doc_id string, seqs array<bigint>")
    sets = rows.join(asked, "doc_id").dropDuplicates(["set_hash"]).select("set_hash", "seqs")
    both = pairs.join(sets.toDF("a", "seqs_a"), "a").join(sets.toDF("b", "seqs_b"), "b")
    common = F.size(F.array_intersect("seqs_a", "seqs_b"))
    union = F.size("seqs_a") + F.size("seqs_b") - F.col("common")
    return both.withColumn("common", common).withColumn("similarity", F.col("common") / union).where(F.col("similarity") >= similarity).select("a", "b", "similarity")


def _id_filter(ids: DataFrame, count: int):
    """Broadcast bitmap of the column doc_id."""
    return ids.sparkSession.sparkContext.broadcast(bit_filter(ids.select(F.xxhash64("doc_id").alias("key")), count))


def first_days(fingerprints: DataFrame) -> DataFrame:
    """(doc_id, day): the day on which a document was first created."""
    return fingerprints.where("created_at is not null and doc_id is not null").groupBy("doc_id").agg(F.to_date(F.min("created_at")).alias("day"))


class PivotIndex:
    """The accepted history as a stored pivot table that batches are checked against and appended to.

    ``path`` holds the table, partitioned by range of the first pivot distance, and the order of
    anchors fixed at the start (any fixed order is lossless, so later batches do not change it).
    ``texts`` always has (doc_id, clean_text), of any documents besides those meant, re-sent rows
    and all; it is read where it lies and never shuffled.  ``days`` has (doc_id, day), one row per
    document meant.
    """

    def __init__(self, spark: SparkSession, path: str, similarity: float = SIMILARITY):
        self.spark, self.path, self.similarity = spark, path.rstrip("/"), similarity
        self._order = None

    def _table(self, bands: list[int]) -> DataFrame:
        return self.spark.read.schema(f"{PIVOT_SCHEMA}, band int").parquet(f"{self.path}/table").where(F.col("band").isin(bands))

    def _ranks(self):
        if self._order is None:
            ranks = np.zeros(SKETCH, np.uint8)  # what the history has not seen comes first
            for r in self.spark.read.parquet(f"{self.path}/order").collect():  # SKETCH bytes in all
                ranks[r["range"] * RANGE : (r["range"] + 1) * RANGE] = np.frombuffer(r["ranks"], np.uint8)
            self._order = self.spark.sparkContext.broadcast(ranks)
        return self._order

    def _rows(self, texts: DataFrame, picked) -> DataFrame:
        """Rows of the documents whose ids pass the bitmap: those meant and a few others."""
        return _with_band(pivot_table(texts, self._ranks(), self.similarity, picked), self.similarity)

    def start(self, texts: DataFrame, days: DataFrame) -> None:
        """Fix the order and accept the first documents."""
        days = written(days.select("doc_id", "day"), "history-days")
        picked = _id_filter(days, days.count())
        chosen = texts.select("doc_id", "clean_text", F.xxhash64("doc_id").alias("key")).mapInArrow(_picked(picked, lambda batches: (b.select([1]) for b in batches)), "clean_text string")
        sequence_ranks(chosen).write.mode("overwrite").parquet(f"{self.path}/order")
        self._order = None
        self.append(self._rows(texts, picked), days)

    def append(self, rows: DataFrame, days: DataFrame) -> None:
        rows.select("doc_id", "set_hash", "n", "parts", "anchors", "band").write.mode("append").partitionBy("band").parquet(f"{self.path}/table")
        days.select("doc_id", "day").write.mode("append").parquet(f"{self.path}/days")

    def check(self, texts: DataFrame, days: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(rows, members, links) of the documents of ``days``, one batch or several.

        ``rows`` are their rows of the pivot table; ``members`` (doc_id, day, set_hash) gives the class
        of each accepted and each new document, ``links`` (a, b, similarity) the different classes that
        agree, at least one of which has a new member.
        """
        days = written(days.select("doc_id", "day"), "batch-days")
        rows = written(self._rows(texts, _id_filter(days, days.count())), "batch")
        bands = {b + k for (b,) in rows.select("band").distinct().collect() for k in (-1, 0, 1)}  # a band triples the size of a text: a few dozen at most
        stored = self._table(sorted(bands))
        known = self.spark.read.schema("doc_id string, day date").parquet(f"{self.path}/days")
        own = rows.select("doc_id", "set_hash").distinct().join(days, "doc_id")
        before = stored.select("doc_id", "set_hash").distinct().join(known, "doc_id")
        members = written(before.withColumn("is_new", F.lit(False)).unionByName(own.withColumn("is_new", F.lit(True))), "members")
        # each class once: new if a document of the batch has it
        classes = members.groupBy("set_hash").agg(F.max("is_new").alias("is_new"), F.min("doc_id").alias("doc_id"))
        cols = ("set_hash", "n", "parts", "anchors")
        wide = stored.select(*cols).unionByName(rows.select(*cols)).dropDuplicates(["set_hash"])
        classes = written(wide.join(classes, "set_hash"), "classes")
        pairs = written(candidates(classes, self.similarity), "pairs")
        return rows, members.select("doc_id", "day", "set_hash"), verify(pairs, classes, texts, self.similarity)

    def accept(self, texts: DataFrame, days: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``check`` the batch, then add its rows."""
        rows, members, links = self.check(texts, days)
        links = written(links, "links")
        self.append(rows, days)
        return members, links


def found_pairs(members: DataFrame, links: DataFrame, since) -> DataFrame:
    """(doc_id_a, doc_id_b): documents of different days, the later from ``since`` on, that agree.

    This writes out every pair of every group of copies; ``copy_classes`` says the same in one row
    per document.
    """
    m = members.select("doc_id", "day", "set_hash")
    x, y = m.toDF("x", "day_x", "a"), m.toDF("y", "day_y", "b")
    across = links.select("a", "b").join(x, "a").join(y, "b")
    same = x.join(y.withColumnRenamed("b", "a"), "a").where("x < y")
    pairs = across.select("x", "y", "day_x", "day_y").unionAll(same.select("x", "y", "day_x", "day_y"))
    pairs = pairs.where((F.col("day_x") != F.col("day_y")) & (F.greatest("day_x", "day_y") >= F.lit(since)))
    return pairs.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def copy_classes(members: DataFrame, links: DataFrame, since) -> DataFrame:
    """(doc_id, class_id, n_equal, n_linked, first_equal, first_near) of each document from ``since`` on.

    A class is named by its first document; n_equal documents have its sequences, n_linked other classes agree with them; first_equal and
    first_near are the documents of the earliest day among both (the smaller id on ties), NULL
    where there is none of an earlier day.
    """
    first = F.min(F.struct("day", "doc_id"))
    of_class = members.groupBy("set_hash").agg(F.count_distinct("doc_id").alias("n_equal"), first.alias("first"))
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(of_class.select(F.col("set_hash").alias("b"), "first"), "b").groupBy("a").agg(F.count("*").alias("n_linked"), F.min("first").alias("near"))
    rows = members.where(F.col("day") >= F.lit(since)).join(of_class, "set_hash").join(linked.withColumnRenamed("a", "set_hash"), "set_hash", "left")
    earlier = lambda c: F.when(F.col(f"{c}.day") < F.col("day"), F.col(f"{c}.doc_id"))
    return rows.select(
        "doc_id", F.col("first.doc_id").alias("class_id"), "n_equal", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), earlier("first").alias("first_equal"), earlier("near").alias("first_near")
    ).distinct()
