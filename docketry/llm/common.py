"""Helpers shared by the text operators of this subpackage."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_folder, written  # noqa: F401 - for the operators

BROADCAST_ROWS = 1_000_000  # largest table that may be sent to every task as a sorted array
FILTER_BITS = 1 << 29  # largest bitmap that may be sent to every task: 64 MB


def sliced(run, rows: int = 1000):
    """``run`` over slices of the Arrow batches: texts are long, and what Python makes of a slice must fit a small worker."""

    def parts(batches):
        return run(batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))

    return parts


def bit_filter(keys: DataFrame, count: int) -> np.ndarray:
    """A packed bitmap of the hashed bigint column ``key``: 32 bits for each of ``count`` keys, FILTER_BITS at most.

    A key that is in is always found.  Beyond that size more other keys pass, which costs work in
    the join behind the filter but no rows.  It is packed by ranges in the executors.
    """
    bits = min(max(1 << 20, 1 << (32 * max(count, 1) - 1).bit_length()), FILTER_BITS)
    slots = keys.select(F.col("key").bitwiseAND(F.lit(bits - 1)).alias("slot"))
    if count > bits // 32:  # so many that a range might get more of them than a worker holds
        slots = slots.distinct()
    packed = slots.groupBy(F.shiftright("slot", 20).alias("range")).applyInPandas(_pack_bits, "range bigint, bits binary").collect()
    out = np.zeros(bits >> 3, np.uint8)
    for r in packed:
        out[r["range"] << 17 : (r["range"] + 1) << 17] = np.frombuffer(r["bits"], np.uint8)[: len(out)]
    return out


def _pack_bits(slots):
    import pandas as pd

    slot = slots["slot"].to_numpy()
    flags = np.zeros(1 << 20, np.uint8)
    flags[slot & ((1 << 20) - 1)] = 1
    return pd.DataFrame({"range": [int(slot[0]) >> 20], "bits": [np.packbits(flags, bitorder="little").tobytes()]})


def may_contain(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit keys may be in a ``bit_filter``."""
    slot = keys & np.uint64(8 * len(bits) - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def md5(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def batch_of(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def sorted_contains(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted array."""
    if not len(table) or not len(keys):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return table[at] == keys
