"""Problem 7: evaluation texts inside training text.

Q-gram lemma filter: a region that matches an item window of L characters within e edits
shares at least L + 1 - q * (1 + e) q-grams with it on nearby diagonals.  Shared q-grams are
counted in overlapping diagonal bands, bands that reach the bound are kept, and each kept
region is verified by banded alignment over its words.  The alignment runs around the word
offsets (word number in the document less that in the item) of the shared q-grams themselves,
which all q-grams of an equal run have in common, whatever stands before it.

Texts are compared as lower-case words (maximal runs of letters or digits) joined by spaces.
The items are a stated query set: they are sent to every task in blocks of bounded size, and
every document is read against every block.

Defined results: NULL or empty documents and items match nothing; an item shorter than the
window is looked for as a whole; repeated rows give the same pairs again.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced
from .hashing import Rolling

Q = 12  # bytes of a q-gram
WINDOW_WORDS = 12
EDITS = 1  # edit budget of a window
WIDTH = 8  # words to either side of an offset that are aligned
BAND = 16  # width of a diagonal band in bytes; bands overlap by half
BLOCK_BYTES = 4_000_000  # items sent to the tasks at a time
SLOTS = 1 << 22  # bitmap in front of the q-gram index
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class ItemIndex:
    """Q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], q: int, window: int, edits: int):
        self.q = q
        self.ids, self.words, self.need = [], [], []
        grams, owner, pos, word = [], [], [], []
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            sizes = [len(w.encode()) + 1 for w in words]
            k = min(window, len(words))
            shortest = min(sum(sizes[i : i + k]) for i in range(len(words) - k + 1)) - 1
            no = len(self.ids)
            self.ids.append(item_id)
            self.words.append(words)
            self.need.append(max(1, shortest + 1 - q * (1 + edits)))
            codes = np.frombuffer((" ".join(words)).encode(), np.uint8)
            g = Rolling(codes).grams(q)
            grams.append(g)
            owner.append(np.full(len(g), no, np.int64))
            pos.append(np.arange(len(g), dtype=np.int64))
            word.append((np.cumsum(codes == 32) - (codes == 32))[: len(g)].astype(np.int64))
        self.grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(self.grams, kind="stable")
        self.grams = self.grams[order]
        self.owner = np.concatenate(owner)[order] if owner else np.zeros(0, np.int64)
        self.pos = np.concatenate(pos)[order] if pos else np.zeros(0, np.int64)
        self.word = np.concatenate(word)[order] if word else np.zeros(0, np.int64)
        self.need = np.array(self.need, np.int64)
        self.slots = np.zeros(SLOTS, bool)
        self.slots[(self.grams & np.uint64(SLOTS - 1)).astype(np.int64)] = True

    def regions(self, codes: np.ndarray):
        """(item no, first byte, last byte, diagonal, word offsets) of the bands that reach their bound within one document; documents stand between zeros."""
        g = Rolling(codes).grams(self.q)
        at = np.flatnonzero(self.slots[(g & np.uint64(SLOTS - 1)).astype(np.int64)])
        if not len(at):
            return
        lo = np.searchsorted(self.grams, g[at], "left")
        n = np.searchsorted(self.grams, g[at], "right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        if not len(at):
            return
        where = np.repeat(at, n)
        which = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        item, diagonal = self.owner[which], where - self.pos[which]
        starts, spaces = np.flatnonzero(codes == 0), np.flatnonzero(codes == 32)
        doc = np.searchsorted(starts, where)
        offset = np.searchsorted(spaces, where) - np.append(0, np.searchsorted(spaces, starts))[doc] - self.word[which]
        band = (diagonal + (1 << 40)) // (BAND // 2)
        for shift in (0, 1):  # each diagonal lies in two bands
            key = item * (1 << 42) + (band - shift)
            order = np.argsort(key, kind="stable")
            ks, start = np.unique(key[order], return_index=True)
            size = np.diff(np.append(start, len(order)))
            for i in np.flatnonzero(size >= self.need[(ks >> 42).astype(np.int64)]):
                no, together = int(ks[i] >> 42), order[start[i] : start[i] + size[i]]
                for d in np.unique(doc[together]):  # a band can reach from one document into the next
                    hits = together[doc[together] == d]
                    if len(hits) >= self.need[no]:
                        yield no, int(where[hits].min()), int(where[hits].max()) + self.q, int(np.median(diagonal[hits])), np.unique(offset[hits])


def centres(offsets) -> list[int]:
    """The fewest of the sorted offsets that have each of them within WIDTH."""
    chosen: list[int] = []
    for k, offset in enumerate(offsets):
        if not chosen or offset > chosen[-1] + WIDTH:
            chosen.append(max(int(x) for x in offsets[k:] if x <= offset + WIDTH))
    return chosen


def align(a: list[str], b: list[str], offset: int, width: int = WIDTH) -> tuple[int, int]:
    """Banded alignment of words: (longest run of equal words, matched words) around diagonal b - a = offset."""
    longest = matched = 0
    run: dict[int, int] = {}
    best: dict[int, int] = {}
    for i, word in enumerate(a):
        new_run, new_best = {}, {}
        left = 0
        for j in range(max(0, i + offset - width), min(len(b), i + offset + width + 1)):
            score = max(best.get(j, 0), left)
            if b[j] == word:
                new_run[j] = r = run.get(j - 1, 0) + 1
                longest = max(longest, r)
                score = max(score, best.get(j - 1, 0) + 1)
            new_best[j] = left = score
        run, best = new_run, new_best
        matched = max(matched, left)
    return longest, matched


def _blocks(items: list[tuple[int, str]]):
    block, size = [], 0
    for item in items:
        if block and size + len(item[1]) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(item)
        size += len(item[1])
    if block:
        yield block


def leaked_items(documents: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, q: int = Q, edits: int = EDITS) -> DataFrame:
    """(doc_id, item_id, run_words, matched_words, item_words): verified regions of each document."""
    spark = documents.sparkSession
    stated = [(r.item_id, r.text) for r in items.select("item_id", "text").where("text is not null").toLocalIterator()]
    id_type = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {items.schema['item_id'].dataType.simpleString()}, run_words int, matched_words int, item_words int"
    slim = documents.where("text is not null and text <> ''").select("doc_id", "text")

    def search(block):
        index = spark.sparkContext.broadcast(ItemIndex(block, q, window, edits))

        def run(batches):
            for batch in batches:
                found = index.value
                texts = batch.column(1).to_pylist()
                joined = [" ".join(_WORD.findall(t.lower())) for t in texts]
                raw = ("\x00" + "\x00".join(joined) + "\x00").encode()
                starts = np.flatnonzero(np.frombuffer(raw, np.uint8) == 0)
                best: dict[tuple[int, int], tuple[int, int]] = {}
                for item, first, last, diagonal, offsets in found.regions(np.frombuffer(raw, np.uint8)):
                    doc = int(np.searchsorted(starts, first, "right")) - 1
                    a, b = int(starts[doc]) + 1, int(starts[doc + 1])
                    own = found.words[item]
                    margin = sum(len(w.encode()) + 1 for w in own) + 4 * BAND
                    lo, hi = max(a, min(first, diagonal) - margin // 2), min(b, last + margin // 2)
                    while lo > a and raw[lo - 1] != 32:
                        lo -= 1
                    while hi < b and raw[hi] != 32:
                        hi += 1
                    region = raw[lo:hi].decode().split(" ")
                    skipped = raw[a:lo].count(b" ")
                    got = max(align(own, region, offset - skipped) for offset in centres(offsets))
                    best[doc, item] = max(best.get((doc, item), (0, 0)), got)
                docs = sorted(best)
                ids = batch.column(0).take(pa.array([d for d, _ in docs], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array([found.ids[i] for _, i in docs], pa.int64()),
                        pa.array([best[k][0] for k in docs], pa.int32()),
                        pa.array([best[k][1] for k in docs], pa.int32()),
                        pa.array([len(found.words[i]) for _, i in docs], pa.int32()),
                    ],
                    names=["doc_id", "item_id", "run_words", "matched_words", "item_words"],
                )

        return slim.mapInArrow(sliced(run), schema)

    out = None
    for block in _blocks(stated):
        part = search(block)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], schema)
