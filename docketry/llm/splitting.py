"""Problem 6: cutting oversized texts at natural boundaries.

Separator hierarchy: section, paragraph, sentence, word, character.  Each piece takes the
last boundary of the most natural kind that lies within the limit, which is what recursive
splitting and greedy packing give; the next piece starts at the natural boundary nearest to
``overlap`` characters before the cut.

Defined results: texts up to the limit, NULL and empty texts give no pieces; NULL sections or
entries that are not found open nothing; pieces cover the text without gaps; re-sent rows
give the same pieces again; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced

LIMIT = 1500
OVERLAP = 150
_BLANK_RUN = re.compile(r"[ \t\xa0]+")
_PARAGRAPH = re.compile(r"\n[ \t\xa0]*\n\s*|\n")
_SENTENCE = re.compile(r"[.!?।…][\"”’»)\]]*\s+")
_WORD = re.compile(r"\s+")


def heading_form(line: str) -> str:
    return _BLANK_RUN.sub(" ", line).strip(" ").lower()


def section_starts(text: str, headings) -> list[tuple[int, int]]:
    """(section number, start offset): section 0, then each heading found after the one before it."""
    starts = [(0, 0)]
    wanted = [(k, heading_form(h)) for k, h in enumerate(headings or (), 1) if h is not None]
    if not wanted:
        return starts
    at = 0
    places: dict[str, list[int]] = {}
    offsets = []
    for no, line in enumerate(text.split("\n")):
        offsets.append(at)
        at += len(line) + 1
        places.setdefault(heading_form(line), []).append(no)
    last = -1
    for k, form in wanted:
        found = places.get(form, ()) if form else ()
        i = bisect_right(found, last)
        if i < len(found):
            last = found[i]
            starts.append((k, offsets[last]))
    return starts


def section_spans(text: str, headings) -> list[tuple[int, int, int, int]]:
    """(section number, start, end, trimmed length)."""
    starts = section_starts(text, headings)
    out = []
    for i, (k, a) in enumerate(starts):
        b = starts[i + 1][1] if i + 1 < len(starts) else len(text)
        out.append((k, a, b, len(text[a:b].strip(" \n"))))
    return out


def pieces_of(text: str, headings, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text longer than the limit."""
    size = len(text)
    if size <= limit:
        return [(0, size)]
    levels = [
        sorted({a for _, a in section_starts(text, headings) if a}),
        [m.end() for m in _PARAGRAPH.finditer(text)],
        [m.end() for m in _SENTENCE.finditer(text)],
        [m.end() for m in _WORD.finditer(text)],
    ]
    natural = sorted({x for level in levels for x in level})
    pieces, start, done = [], 0, 0
    while size - start > limit:
        end = start + limit
        for level in levels:
            i = bisect_right(level, start + limit) - 1
            if i >= 0 and level[i] > max(done, start):
                end = level[i]
                break
        pieces.append((start, end))
        done = end
        target = end - overlap
        i = bisect_left(natural, target)
        near = [x for x in natural[max(0, i - 1) : i + 1] if start < x <= end and end - x < limit]
        start = min(near, key=lambda x: (abs(x - target), x)) if near else max(target, start + 1)
        if overlap <= 0:
            start = end
    pieces.append((start, size))
    return pieces


def split_documents(parsed: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """(id, piece_no, section_no, section_chars, start, end, piece) of every text longer than the limit.

    ``section_no`` is the section in which the piece starts; a section that begins inside a
    piece is reported with the same piece number and its own length.
    """

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for id_, text, headings in zip(*(c.to_pylist() for c in batch.columns)):
                if not text or len(text) <= limit:
                    continue
                spans = section_spans(text, headings)
                begins = [a for _, a, _, _ in spans]
                told = -1
                for no, (a, b) in enumerate(pieces_of(text, headings, limit, overlap)):
                    first = bisect_right(begins, a) - 1
                    last = bisect_left(begins, b) - 1
                    for s in range(min(first, told + 1) if told < first else first, last + 1):
                        if s != first and s <= told:
                            continue
                        row = (id_, no, spans[s][0], spans[s][3], a, b, text[a:b] if with_text and s == first else None)
                        for col, v in zip(out, row):
                            col.append(v)
                        told = max(told, s)
            types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, types)],
                names=["id", "piece_no", "section_no", "section_chars", "start", "end", "piece"],
            )

    schema = "id string, piece_no int, section_no int, section_chars int, start int, end int, piece string"
    return parsed.where("length(clean_text) > %d" % limit).select("id", "clean_text", "sections").mapInArrow(sliced(run), schema)
