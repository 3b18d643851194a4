"""Problem 9: texts cut by a field limit or in transfer.

Backward character n-grams: the model reads the last 6 to 40 characters before a
position and counts, over every position of every document, how often
text ends there (sentence or line end, end of value) and how often it goes on.  A value's
final contexts are looked up, interpolated from short to long, and the log-odds of ending
against going on are held against the threshold of its language and column.

Counting covers all rows; only contexts that are the final context of some value are kept.  A
bitmap of them, 64 MB at most, goes to the tasks, which look the shortest context up first and a
longer one only where the shorter was found (it is its suffix, so nothing is lost).  What passes
is summed per task and joined with the contexts themselves, at every size in the same way.
An end is counted once for each pair of last lines (whole lines, blank ones aside) it stands
behind, so that copies and edited copies of one text are one proof; and a value's own end is taken
away before it is judged, so that a cut text is no proof for its own completeness.

The threshold of a language in a column is the thinnest place of its values' log-odds within
``REACH`` of the default (above what a context never seen gets), smoothed, with ``PRIOR_VALUES`` values spread like those of all languages.

Defined results: NULL and blank texts are not cut; marks of continuation and broken characters
at the end are set aside first; a NULL language is a language of its own; re-sent rows and ties
get the same answer; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, may_contain, sliced, written
from .hashing import Rolling

ORDERS = (6, 12, 18, 24, 31, 40)
STRENGTH = 1.0  # occurrences that the shorter context counts for
PRIOR = 0.05  # share of positions at which text ends, before any context is read
THRESHOLD = -2.0  # default of the log-odds below which a value is cut
THRESHOLD_CLOSED = -4.0  # the same where the value ends in a full stop
REACH = 0.75
BIN = 0.25  # width of the histogram's bins
EDGE = 12.0  # log-odds beyond which values share a bin
PRIOR_VALUES = 50.0
PIECE = 1 << 17  # characters hashed at a time
HELD = 1 << 20  # counted contexts a task holds before it hands them on
_MARKS = re.compile(r"(?:\s|…|\.{2,}|[>»→]+$|�|[ÂÃâ€àð¤¥]+$|(?<=[\s.])[\[(<{][^A-Z0-9\])>}\n]{0,24}[\])>}]?$)+$")
_CODE = re.compile(r"[A-Z]{2,6}(?=/)")
_CLOSERS = "\"'”’»)]"
_STOPS = ".!?।;:"
_LIMIT = 400  # characters before the end that hold every context


def final_context(text: str) -> tuple[str, bool]:
    """(text up to its last character of content, whether a full stop closes it)."""
    tail = text[-_LIMIT:]
    if tail[-1:] == " " and tail[-2:-1].isalpha():  # a cut between two words leaves the blank
        return tail, False
    while (cut := _MARKS.sub("", tail)) != tail:
        tail = cut
    bare = tail.rstrip(_CLOSERS)
    if bare[-1:] and bare[-1] in _STOPS:
        return bare.rstrip(_STOPS + _CLOSERS), True
    return tail, False


def _codes(text: str) -> np.ndarray:
    """Characters; a run of digits, and the capitals before a slash in a file mark, count as one."""
    codes = np.frombuffer(_CODE.sub("A", text).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((codes >= 48) & (codes <= 57), np.uint32(48), codes)
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == 48) & (codes[:-1] == 48)
    return codes[~again]


def _final_rows(batches):
    for batch in batches:
        rows, heads, closed, langs = [], [], [], []
        for i, (lang, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            if not text or not text.strip():
                continue
            head, stop = final_context(text)
            if not head.strip():
                continue
            start = head.rfind("\n") + 1
            if head[start:].isupper() and 2 * sum(map(str.isupper, head[start:])) > len(head) - start:
                head = head[:start] + head[start].upper() + head[start + 1 :].lower()
            heads.append(head.replace("\t", " "))
            rows.append(i), closed.append(stop), langs.append(lang or "")
        contexts = pa.array([], pa.list_(pa.int64()))
        if heads:
            codes = _codes("\n" + "\x00\n".join(heads) + "\x00")
            ends = np.flatnonzero(codes == 0)
            begin = np.concatenate(([0], ends[:-1] + 1))
            roll, found, there = Rolling(codes), [], []
            for order in ORDERS:
                there.append(ends - begin >= order)
                found.append(roll.spans(np.maximum(ends - order, 0), ends).view(np.int64))
            flat = pa.array(np.stack(found, axis=1).ravel(), mask=~np.stack(there, axis=1).ravel())
            contexts = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(ORDERS), dtype=np.int32)), flat)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), pa.array(langs, pa.string()), contexts, pa.array(closed, pa.bool_()), batch.column(3).take(at)],
            names=["doc_id", "lang", "contexts", "closed", "copy"],
        )


_NEW_LINE_OR_CLOSER = np.array([10, 0, *map(ord, _CLOSERS)], np.uint32)
_STOP_CODES = np.array([ord(c) for c in _STOPS], np.uint32)


def _ends(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether text ends before the positions ``at``: at a line's end or behind a sentence."""
    nxt, after, third = codes[at], codes[at + 1], codes[at + 2]
    new = ~((third >= 48) & (third <= 57)) & ~((third >= 97) & (third <= 122))
    closes = np.isin(after, _NEW_LINE_OR_CLOSER) | ((after == 32) & new)
    colon = (nxt == 58) & (after == 32)
    return (nxt == 10) | (np.isin(nxt, _STOP_CODES) & closes & ~colon)


def _pieces(batch: pa.RecordBatch):
    """Whole texts, joined, of about PIECE characters at a time."""
    texts, size = [], 0
    for text in batch.column(0).to_pylist():
        if text:
            texts.append(text)
            size += len(text)
            if size >= PIECE:
                yield _codes("\n" + "\x00\n".join(texts).replace("\t", " ") + "\x00\x00\x00")
                texts, size = [], 0
    if texts:
        yield _codes("\n" + "\x00\n".join(texts).replace("\t", " ") + "\x00\x00\x00")


def _count(shared):
    """Ends and goings-on of the contexts that pass the bitmap, over all positions of a task's documents."""

    def run(batches):
        bits = shared.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n_held = 0
        for batch in batches:
            for codes in _pieces(batch):
                roll = Rolling(codes)
                first = ORDERS[0]
                keys = roll.grams(first)[: len(codes) - 2 - first]
                at = np.flatnonzero(may_contain(bits, keys))
                keys, at = keys[at], at + first
                use = codes[at] != 0  # ends of values are counted apart
                keys, at = keys[use], at[use]
                ended = _ends(codes, at)
                for order in (*ORDERS[1:], None):
                    if not len(at):
                        break
                    held.append((keys, ended.astype(np.int64), np.ones(len(keys), np.int64)))
                    n_held += len(keys)
                    if order is None:
                        break
                    far = at >= order
                    at, ended = at[far], ended[far]
                    keys = roll.spans(at - order, at)
                    ok = may_contain(bits, keys)
                    keys, at, ended = keys[ok], at[ok], ended[ok]
                if n_held > HELD:
                    held = [_summed(held)]
                    n_held = len(held[0][0])
                    if n_held > HELD // 2:
                        yield _table(held.pop())
                        n_held = 0
        if held:
            yield _table(_summed(held))

    return run


def _summed(held):
    keys, ends, total = map(np.concatenate, zip(*held))
    keys, inverse = np.unique(keys, return_inverse=True)
    count = lambda n: np.bincount(inverse, n, len(keys)).astype(np.int64)
    return keys, count(ends), count(total)


def _table(counts) -> pa.RecordBatch:
    keys, ends, total = counts
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ends), pa.array(total)], names=["context", "ends", "total"])


def valley(counts: np.ndarray, default: float) -> float:
    """The log-odds within REACH of the default where a histogram, smoothed, is thinnest; nearest the default on ties."""
    smooth = np.convolve(counts, [1.0, 2.0, 3.0, 2.0, 1.0], "same")
    edges = np.arange(-EDGE, EDGE + BIN / 2, BIN)[1:-1]  # between two bins each
    thin = smooth[:-1] + smooth[1:]
    near = np.flatnonzero(np.abs(edges - default) <= REACH)
    return float(edges[min(near, key=lambda i: (round(thin[i], 9), abs(edges[i] - default)))])


def fitted_thresholds(judged: DataFrame) -> DataFrame:
    """(lang, closed, threshold) of one column's values (lang, closed, log_odds)."""
    n_bins = int(2 * EDGE / BIN)
    bin_of = F.least(F.greatest(F.floor((F.col("log_odds") + EDGE) / BIN), F.lit(0)), F.lit(n_bins - 1)).cast("int")
    counts = judged.groupBy("lang", "closed", bin_of.alias("bin")).agg(F.count("*").alias("n"))
    pooled = {c: np.zeros(n_bins) for c in (False, True)}
    for r in counts.groupBy("closed", "bin").agg(F.sum("n").alias("n")).collect():  # 192 rows at most
        pooled[r["closed"]][r["bin"]] = r["n"]
    shape = {c: v / max(v.sum(), 1.0) for c, v in pooled.items()}

    def fit(rows):
        closed = bool(rows["closed"].iloc[0])
        own = np.bincount(rows["bin"], rows["n"], n_bins) + PRIOR_VALUES * shape[closed]
        out = rows[["lang", "closed"]].head(1).copy()
        out["threshold"] = valley(own, THRESHOLD_CLOSED if closed else THRESHOLD)
        return out

    return counts.groupBy("lang", "closed").applyInPandas(fit, "lang string, closed boolean, threshold double")


def truncated_values(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", thresholds: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, lang, log_odds, closed, threshold, is_cut) of every value that holds text.

    ``thresholds`` sets limits for languages of this column instead of the fitted ones, for values
    that no full stop closes.
    """
    spark = documents.sparkSession
    id_type = documents.schema["doc_id"].dataType.simpleString()
    slim = documents.select("doc_id", F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("text is not null")
    last_lines = F.substring_index(F.regexp_replace("text", r"\s*\n\s*", "\n"), "\n", -2)
    final = written(
        slim.select("doc_id", "lang", F.expr(f"right(text, {_LIMIT})").alias("text"), F.xxhash64(last_lines).alias("copy")).mapInArrow(
            sliced(_final_rows), f"doc_id {id_type}, lang string, contexts array<bigint>, closed boolean, copy bigint"
        ),
        "final-contexts",
    )
    each = final.select("doc_id", "copy", F.posexplode("contexts").alias("order", "context")).where("context is not null")
    own = written(each.groupBy("context").agg(F.count_distinct("copy").alias("own_ends")), "wanted-contexts")
    shared = spark.sparkContext.broadcast(bit_filter(own.select(F.col("context").alias("key")), own.count()))
    counted = slim.select("text").mapInArrow(sliced(_count(shared)), "context bigint, ends bigint, total bigint")
    model = own.join(counted.groupBy("context").agg(F.sum("ends").alias("ends"), F.sum("total").alias("total")), "context", "left")
    known = each.join(model, "context").select(
        "doc_id",
        "copy",
        "order",
        (F.coalesce("ends", F.lit(0)) + F.col("own_ends") - 1).alias("ends"),
        (F.coalesce("total", F.lit(0)) + F.col("own_ends") - 1).alias("total"),
    )
    per = known.groupBy("doc_id", "copy").agg(F.array_sort(F.collect_list(F.struct("order", "ends", "total"))).alias("seen"))
    p = F.aggregate("seen", F.lit(PRIOR), lambda acc, x: (x["ends"] + STRENGTH * acc) / (x["total"] + STRENGTH))
    odds = F.log(F.greatest("p", F.lit(1e-9)) / F.greatest(1 - F.col("p"), F.lit(1e-9)))
    judged = final.select("doc_id", "lang", "copy", "closed").distinct().join(per, ["doc_id", "copy"], "left").withColumn("p", F.coalesce(p, F.lit(1.0)))
    judged = written(judged.select("doc_id", "lang", "closed", odds.alias("log_odds")), "log-odds")
    limit = F.col("threshold")
    for lang, value in sorted((thresholds or {}).items()):
        limit = F.when((F.col("lang") == lang) & ~F.col("closed"), F.lit(value)).otherwise(limit)
    told = judged.join(written(fitted_thresholds(judged), "thresholds"), ["lang", "closed"]).withColumn("threshold", limit)
    return told.select("doc_id", "lang", "log_odds", "closed", "threshold", (F.col("log_odds") < F.col("threshold")).alias("is_cut"))
