"""Problem 3: languages of documents and of their mixed-language segments.

Segmentation-marginalised unigrams: each language has a probability for every piece of a fixed
public vocabulary, and a text's probability is summed over all its segmentations into pieces
by a forward algorithm.  No piece crosses a word border, so the sum factorises over words and
each word's score is computed once per task.

The pieces' probabilities are learned by expectation-maximisation (forward-backward) on a
bounded sample of labelled documents, ``docs_per_language`` each, whole texts; after a first
fit the sample's lines are assigned by the model itself and fitted again, because labels may
be wrong and documents mixed.  The vocabulary file is a parameter and is never trained.

Defined results: NULL or empty text gives no lines, nor does a line without letters; a document
without letters has no language (NULL) with confidence 0; a document's language is the one with most letters; an unknown or
missing label differs from every language; re-sent rows give the same rows again.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced
from .encoding import undo_common_damage

LANGUAGES = ("en", "fr", "de", "es", "it", "pt", "hi")
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "piece_bpe_32k.model"
DOCS_PER_LANGUAGE = 250
EM_ROUNDS = 3
MIN_WORDS = 8
_SPACE = "▁"
_FLOOR = 1e-9  # a piece never seen in a language
_UNKNOWN = 1e-7  # a letter outside the vocabulary


def read_pieces(directory: str = TOKENIZER_DIR, name: str = VOCABULARY) -> list[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=f"{directory}/{name}")
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class PieceModel:
    """Piece probabilities of all languages; rows of ``probs`` are pieces, columns languages."""

    def __init__(self, pieces: list[str], probs: np.ndarray | None = None):
        self.number = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        self.probs = np.full((len(pieces), len(LANGUAGES)), 1.0 / len(pieces)) if probs is None else probs
        self.known: dict[str, np.ndarray] = {}
        self._logs: np.ndarray | None = None

    def lattice(self, word: str) -> list[list[tuple[int, int]]]:
        """For each end: the (start, piece) edges that reach it; piece -1 is a letter outside the vocabulary."""
        text = _SPACE + word
        edges = [[] for _ in range(len(text) + 1)]
        get, longest = self.number.get, self.longest
        for i in range(len(text)):
            for j in range(i + 1, min(len(text), i + longest) + 1):
                piece = get(text[i:j])
                if piece is not None:
                    edges[j].append((i, piece))
            if not any(s == i for s, _ in edges[i + 1]):
                edges[i + 1].append((i, -1))
        return edges

    def score(self, word: str) -> np.ndarray:
        """Log-probability of a word in each language, over all its segmentations."""
        got = self.known.get(word)
        if got is None:
            edges = self.lattice(word)
            forward = np.zeros((len(edges), len(LANGUAGES)))
            forward[0] = 1.0
            shift = np.zeros(len(LANGUAGES))
            for j in range(1, len(edges)):
                for i, piece in edges[j]:
                    forward[j] += forward[i] * (self.probs[piece] if piece >= 0 else _UNKNOWN)
                if j % 8 == 0 and (small := forward[j] < 1e-100).any():  # long words: lift the sums that later ones are made of
                    forward[max(0, j - self.longest) : j + 1, small] *= 1e100
                    shift[small] -= 100 * np.log(10.0)
            got = np.log(forward[-1]) + shift
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[word] = got
        return got

    def log_probs(self) -> np.ndarray:
        """Of the pieces; the last row is that of a letter outside the vocabulary, which edges call -1."""
        if self._logs is None:
            self._logs = np.log(np.vstack([self.probs, np.full((1, len(LANGUAGES)), _UNKNOWN)]))
        return self._logs

    def fit(self, counts: list[Counter], rounds: int = EM_ROUNDS) -> PieceModel:
        """EM: expected piece counts from forward and backward sums of the words of each language."""
        weights: dict[str, np.ndarray] = {}
        for k, words in enumerate(counts):
            for word, n in words.items():
                weights.setdefault(word, np.zeros(len(LANGUAGES)))[k] = n
        if not weights:
            return self
        lattices = Lattices([self.lattice(w) for w in weights])
        weight = np.array(list(weights.values()))
        model = self
        for _ in range(rounds):
            expected = lattices.expected(model.log_probs(), weight)[:-1]
            probs = expected / np.maximum(expected.sum(axis=0), 1e-12)
            model = PieceModel(list(self.number), np.maximum(probs, _FLOOR))
        return model


class Lattices:
    """The lattices of many words as arrays of edges; sums run over all words at a time, in logarithms, however long a word is."""

    def __init__(self, lattices: list[list[list[tuple[int, int]]]]):
        sizes = np.array([len(x) for x in lattices])
        self.first = np.cumsum(sizes) - sizes  # node of each word's start
        self.last = self.first + sizes - 1
        edges = [(base + i, base + j, j, len(x) - 1 - i, piece) for base, x in zip(self.first.tolist(), lattices) for j, into in enumerate(x) for i, piece in into]
        self.start, self.end, self.depth, self.height, self.piece = np.array(edges, np.int64).T
        self.nodes = int(sizes.sum())
        self.word = np.repeat(np.arange(len(sizes)), sizes)

    def _steps(self, level, node):
        """Edges grouped by level, and within it by node: (edges, where each node's run begins)."""
        order = np.lexsort((node, level))
        for part in np.split(order, np.flatnonzero(np.diff(level[order])) + 1):
            yield part, np.flatnonzero(np.concatenate(([True], np.diff(node[part]) != 0)))

    def forward(self, logs: np.ndarray) -> np.ndarray:
        out = np.full((self.nodes, logs.shape[1]), -np.inf)
        out[self.first] = 0.0
        for part, runs in self._steps(self.depth, self.end):
            out[self.end[part[runs]]] = np.logaddexp.reduceat(out[self.start[part]] + logs[self.piece[part]], runs, axis=0)
        return out

    def backward(self, logs: np.ndarray) -> np.ndarray:
        out = np.full((self.nodes, logs.shape[1]), -np.inf)
        out[self.last] = 0.0
        for part, runs in self._steps(self.height, self.start):
            out[self.start[part[runs]]] = np.logaddexp.reduceat(out[self.end[part]] + logs[self.piece[part]], runs, axis=0)
        return out

    def expected(self, logs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, words counted by ``weight`` in each language."""
        forward, backward = self.forward(logs), self.backward(logs)
        word = self.word[self.start]
        share = np.exp(forward[self.start] + logs[self.piece] + backward[self.end] - forward[self.last][word]) * weight[word]
        piece = self.piece % len(logs)
        return np.stack([np.bincount(piece, share[:, k], len(logs)) for k in range(logs.shape[1])], axis=1)


_EDGES = "\"'“”‘’«»„().,;:!?।-–—[]"


class WordRows(dict):
    """word as it stands in a line (lower case) -> row of the score matrix; row 0: no letter in it."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model
        self.clear_rows()

    def clear_rows(self):
        self.clear()
        self.matrix = np.zeros((4096, len(LANGUAGES)))
        self.size = 1

    def __missing__(self, token: str) -> int:
        word = token.strip(_EDGES)
        if not any(map(str.isalpha, word)):
            self[token] = 0
            return 0
        if self.size == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        row = self.size
        self.matrix[row] = self.model.score(word)
        self.size += 1
        self[token] = row
        return row


def score_lines(rows: WordRows, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(log-probability of each line in each language, number of its words that hold a letter)."""
    if len(rows) > 400_000:
        rows.clear_rows()
    index: list[int] = []
    starts = np.empty(len(lines), np.int64)
    row_of = rows.__getitem__
    for i, line in enumerate(lines):
        starts[i] = len(index)
        index.extend(map(row_of, line.split(" ")))
    at = np.array(index, np.int64)
    return np.add.reduceat(rows.matrix[at], starts, axis=0), np.add.reduceat((at > 0).astype(np.int64), starts)


def label_of(column="language"):
    """The label's language: what stands before - or _, in lower case."""
    return F.lower(F.trim(F.regexp_extract(F.coalesce(F.col(column), F.lit("")), "^[^-_]*", 0)))


def train(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, directory: str = TOKENIZER_DIR) -> PieceModel:
    """Fit the piece probabilities on a bounded sample of labelled rows (id, language, clean_text)."""
    rows = labelled.select("id", label_of().alias("label"), "clean_text")
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).where(F.col("label").isin(*LANGUAGES)).collect()}
    pick = F.lit(False)
    for label, n in sizes.items():
        share = min(1.0, docs_per_language / n)
        pick = pick | ((F.col("label") == label) & (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)))
    lines: list[tuple[int, list[str]]] = []
    for r in rows.where(pick & F.col("clean_text").isNotNull()).select("label", "clean_text").toLocalIterator():
        for line in r.clean_text.split("\n"):
            text = line if line.isascii() else undo_common_damage(line)
            words = [w for w in (w.strip(_EDGES) for w in text.lower().split(" ")) if any(map(str.isalpha, w))]
            if words:
                lines.append((LANGUAGES.index(r.label), words))
    model = PieceModel(read_pieces(directory))
    for again in (False, True):
        counts = [Counter() for _ in LANGUAGES]
        for label, words in lines:
            if again:  # by the first model's own judgement; short lines say little
                if len(words) < 5:
                    continue
                scores = np.sum([model.score(w) for w in words], axis=0)
                label = int(scores.argmax())
            counts[label].update(words)
        model = PieceModel(list(model.number)).fit(counts)
    return model


def line_languages(parsed: DataFrame, model: PieceModel) -> DataFrame:
    """(id, line_no, n_words, lang, confidence, label, segment_no): one row per line that holds a letter."""
    pieces = list(model.number)
    shared = parsed.sparkSession.sparkContext.broadcast((pieces, model.probs))
    holder: dict = {}

    def run(batches):
        if "rows" not in holder:
            holder["rows"] = WordRows(PieceModel(*shared.value))
        for batch in batches:
            ids, labels, texts = (c.to_pylist() for c in batch.columns)
            lines, doc, no = [], [], []
            for d, text in enumerate(texts):
                if not text:
                    continue
                split = text.lower().split("\n")
                if not text.isascii():
                    split = [x if x.isascii() else undo_common_damage(y).lower() for x, y in zip(split, text.split("\n"))]
                lines.extend(split)
                doc.extend([d] * len(split))
                no.extend(range(len(split)))
            if not lines:
                continue
            scores, words = score_lines(holder["rows"], lines)
            best = scores.argmax(axis=1)
            # tempered, because the words of a line are not independent
            x = (scores - scores.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(words, 1))[:, None]
            sure = 1.0 / np.exp(x).sum(axis=1)
            keep = np.flatnonzero(words > 0)
            doc_a, lang = np.array(doc)[keep], best[keep]
            weak = (words[keep] < 3) & (sure[keep] < 0.99)
            out_lang, segment, before, seg, owner = [], [], None, -1, None
            for d, k, w in zip(doc_a.tolist(), lang.tolist(), weak.tolist()):
                if d != owner:
                    owner, before, seg = d, None, -1
                if w and before is not None:
                    k = before
                seg += k != before
                before = k
                out_lang.append(LANGUAGES[k])
                segment.append(seg)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(doc_a, pa.int64())),
                    pa.array(np.array(no, np.int32)[keep]),
                    pa.array(words[keep].astype(np.int32)),
                    pa.array(out_lang, pa.string()),
                    pa.array(sure[keep]),
                    batch.column(1).take(pa.array(doc_a, pa.int64())),
                    pa.array(segment, pa.int32()),
                ],
                names=["id", "line_no", "n_words", "lang", "confidence", "label", "segment_no"],
            )

    schema = "id string, line_no int, n_words int, lang string, confidence double, label string, segment_no int"
    return parsed.select("id", label_of().alias("label"), "clean_text").mapInArrow(sliced(run), schema)


def document_languages(lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """(id, lang, confidence, label): the language most words of a document are in, for every id of ``parsed``."""
    per = lines.groupBy("id", "lang").agg(F.sum("n_words").alias("n"), F.sum(F.col("n_words") * F.col("confidence")).alias("c"))
    best = per.groupBy("id").agg(F.max(F.struct("n", "lang", "c")).alias("best"), F.sum("n").alias("all"))
    labels = parsed.groupBy("id").agg(F.max(label_of()).alias("label"))
    sure = F.round(F.col("best.c") / F.greatest(F.col("all"), F.lit(1)), 4)
    return labels.join(best, "id", "left").select("id", F.col("best.lang").alias("lang"), F.coalesce(sure, F.lit(0.0)).alias("confidence"), "label")


def segments(lines: DataFrame) -> DataFrame:
    """(id, segment_no, lang, first_line, last_line, confidence): runs of lines in one language."""
    return lines.groupBy("id", "segment_no", "lang").agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.round(F.avg("confidence"), 4).alias("confidence")
    )
