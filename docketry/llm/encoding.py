"""Problem 4: text decoded with the wrong character encoding.

Every code-page mistake is a substitution cipher: bytes were read through the wrong single-byte
table, so each byte shows up as one foreign letter.  Per source, in the executors,
expectation-maximisation against the bigrams of sound text learns which letter stands for which
byte:

* ``learn_tables`` starts from the code pages there are: E step, for every garbled letter group
  (with its left neighbour) the posterior of each page is its weight in the source times the
  bigram likelihood of the plain letter it gives; M step, the weights are the summed posteriors.
* ``learn_mapping`` starts from nothing, for the damage no page explains: E step, the posterior of
  each plain letter is its bigram likelihood between the neighbours times the probability that the
  symbols stand for its bytes; M step, those probabilities are the summed posteriors.  A symbol
  that stands alone in sound text is no cipher, and a mapping counts only with enough evidence.

The learned tables are then applied with ``str.translate`` (letter -> byte) and the bytes
are read as UTF-8, repeatedly, because text may have been damaged twice; or letter -> letter, where
single bytes were read through another page.

Defined results: NULL or empty text, pure ASCII text and text in which no letter group
decodes are not reported; a value with U+FFFD is reported with ``restored`` NULL and
``lost`` true; repeated rows give equal rows (the query takes distinct rows).
"""

from __future__ import annotations

import codecs
import encodings
import hashlib
import json
import math
import pkgutil
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, written

LM_BUCKETS = 1 << 16  # fixed size of the bigram table, whatever the corpus
MAX_ROUNDS = 4  # nested damage: how often a value may have been wrongly decoded
EM_ROUNDS = 12
MIN_GAIN = 1.0  # log-likelihood a restored run, and a value, must gain over the text as it stands
COVER_SHARE = 0.005  # share of all damaged letters that only a code page must explain to be used in every source
EVIDENCE = 20.0  # log-likelihood that only a code page must gain in a source to be used there
ALONE = 0.1  # share of its occurrences in runs that a symbol of an unknown cipher may stand alone in sound text
LEARN_EVIDENCE = 50.0  # log-likelihood that an unknown substitution must gain in its source
LEARN_GAIN = 3.0  # and on average for each occurrence
LEARN_SYMBOLS = 4  # and how many symbols it must explain
UNREAD = 3.0  # log-likelihood a table loses for each damaged run of a value it cannot read
COMMON = ("cp1252", "mac_roman", "cp437", "cp850")
SWAP_GAIN = 8.0  # log-likelihood a value or line must gain by swapping single letters
BACKOFF = 50.0  # occurrences the single-letter model counts for in a bigram
LOST = "�"


def _single_byte_tables() -> dict[str, dict[int, int]]:
    """letter -> byte for every ASCII-compatible single-byte code page Python knows.

    Bytes a table leaves undefined keep their C1 control character, as lenient decoders do.
    """
    tables: dict[str, dict[int, int]] = {}
    seen: set[tuple] = set()
    names = sorted(m.name for m in pkgutil.iter_modules(encodings.__path__))
    for name in [*COMMON, *(n for n in names if n not in COMMON)]:
        try:
            if codecs.lookup(name)._is_text_encoding is False:
                continue
            if bytes(range(32, 91)).decode(name) != bytes(range(32, 91)).decode("ascii"):
                continue
            if "Ā".encode("utf-8").decode(name, "replace").__len__() != 2:
                continue
            letters = [bytes([b]).decode(name, "replace") for b in range(128, 256)]
        except Exception:  # noqa: BLE001 - not a plain text codec
            continue
        if any(len(c) != 1 for c in letters) or letters.count(LOST) > 32:
            continue
        letters = [chr(b) if c == LOST else c for b, c in zip(range(128, 256), letters)]
        if any(ord(c) < 128 for c in letters) or len(set(letters)) < 128 or (key := tuple(letters)) in seen:
            continue
        seen.add(key)
        table = {ord(c): b for b, c in zip(range(128, 256), letters)}
        for b in range(128, 160):  # C1 controls stand for themselves where the table has no such letter
            table.setdefault(b, b)
        for b in range(160, 256):  # letters the table lacks must not pass for bytes
            table.setdefault(b, 0xFFFF)
        tables[name] = table
    # Latin-1 is the common Windows table with C1 controls, which the rule above already covers.
    for name in ("latin_1", "iso8859_1", "charmap"):
        tables.pop(name, None)
    return tables


TABLES = _single_byte_tables()

#: Single bytes written in one code page and read in another: "written>read" -> letter -> letter.
SWAPS = {
    f"{a}>{b}": {c: a_letters[byte] for c, byte in TABLES[b].items() if byte in a_letters and a_letters[byte] != c}
    for a in COMMON
    for b in COMMON
    if a != b and (a_letters := {byte: c for c, byte in reversed(TABLES[a].items()) if byte != 0xFFFF})
}
_LETTERS = frozenset(chr(c) for t in SWAPS.values() for c in t) | frozenset(chr(c) for t in TABLES.values() for c, b in t.items() if b != 0xFFFF)
_SWAPPED = frozenset(chr(c) for t in SWAPS.values() for c in t)
_GROUP = re.compile(r"[\s\S]?[^\x00-\x7f]+[\s\S]?")
_RUN = re.compile(r"[^\x00-\x7f]{2,}")


def _decode(run: str, table: dict[int, int]) -> str | None:
    """The run read through a table, or None where it is no UTF-8."""
    try:
        plain = run.translate(table).encode("latin-1").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None
    return plain if len(plain) < len(run) else None


def _bucket(pair: str) -> int:
    """Bigrams use the first LM_BUCKETS slots, single letters the next."""
    if len(pair) == 1:
        return LM_BUCKETS + ord(pair) % LM_BUCKETS
    return (ord(pair[0]) * 8191 + ord(pair[1]) * 131 + 7) % LM_BUCKETS


def _pairs(group: str):
    return (a + b for a, b in zip(group, group[1:]))


def _letters(run: str, table: dict[int, int]):
    """The symbols of each letter of a run that a table decodes."""
    i = 0
    data = run.translate(table)
    while i < len(run):
        lead = ord(data[i])
        n = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
        yield run[i : i + n]
        i += n


def _ascii_letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def _stats(batches):
    """Counts of one partition, all bounded by the alphabet: bigrams of clean text (bucket 0 and up), garbled
    letters (-1), single letters (-2), runs no page decodes (-3) and runs one decodes (-4) beside an ASCII letter,
    and single letters of other scripts beside an ASCII letter (-5), of which three ``symbols`` ends with the letter after; and
    the letters that are not Latin, wherever they stand (-6).
    """
    lm: Counter = Counter()
    garbled: Counter = Counter()
    for batch in batches:
        groups: defaultdict[str, Counter] = defaultdict(Counter)
        for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text and not text.isascii():
                groups[source or ""].update(_GROUP.findall(text))
        for source, found in groups.items():
            for group, n in found.items():
                for letter in set(group):
                    if not letter.isascii() and not _latin(letter):
                        garbled[source, "", letter, -6] += n * group.count(letter)
                core = _RUN.search(group)
                run = core.group() if core else ""
                ways = [t for t in TABLES.values() if _decode(run, t) is not None] if run else []
                if 2 <= len(run) <= 3:
                    left, right = group[: core.start()][-1:] or " ", group[core.end() :][:1] or " "
                    if _ascii_letter(left) or _ascii_letter(right):
                        garbled[source, left, run + right, -4 if ways else -3] += n
                if not ways:
                    for part in (*_pairs(group), *group):
                        lm[_bucket(part)] += n
                    if not run:
                        letter = re.search(r"[^\x00-\x7f]", group)
                        left, right = group[: letter.start()] or " ", group[letter.end() :] or " "
                        garbled[source, left, letter.group(), -2] += n
                        if (_ascii_letter(left) or _ascii_letter(right)) and not _latin(letter.group()):
                            garbled[source, left, letter.group() + right, -5] += n
                    continue
                before = group[: core.start()][-1:] or " "
                for symbols in _letters(run, ways[0]):
                    garbled[source, before, symbols, -1] += n
                    before = "\x00"
    rows = [("", "", "", b, n) for b, n in lm.items()] + [(*k, n) for k, n in garbled.items()]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64()))],
        names=["source", "before", "symbols", "bucket", "n"],
    )


def _latin(letter: str) -> bool:
    return unicodedata.name(letter, "").startswith("LATIN")


class Bigrams:
    """Bigram log-likelihoods, backed off to single letters, out of a table of fixed size."""

    def __init__(self, counts: dict[int, int]):
        self.counts = counts
        self.total = sum(n for b, n in counts.items() if b >= LM_BUCKETS) + 1.0
        self.blocks = {(b - LM_BUCKETS) >> 7 for b in counts if b >= LM_BUCKETS} | {0}

    def plausible(self, plain: str, tables, depth: int = MAX_ROUNDS) -> bool:
        """Whether all letters are from blocks of 128 code points that sound text uses, at once or when read again."""
        if all((ord(c) % LM_BUCKETS) >> 7 in self.blocks for c in plain):
            return True
        return depth > 1 and any((more := _decode(plain, t)) is not None and self.plausible(more, tables, depth - 1) for t in tables)

    def score(self, text: str) -> float:
        get, total, out = self.counts.get, self.total, 0.0
        for a, b in zip(text, text[1:]):
            single = (get(_bucket(b), 0) + 0.01) / total
            out += math.log((get(_bucket(a + b), 0) + BACKOFF * single) / (get(_bucket(a), 0) + BACKOFF))
        return out


def _ways(groups, lm: Bigrams, names) -> list[tuple[dict[str, float], int]]:
    """For each (before, symbols, n): log-likelihood of what each table reads, "" being the text as it stands."""
    ways = []
    for before, symbols, n in groups:
        left = " " if before == "\x00" else before
        cand = {"": lm.score(left + symbols)}
        for name in names:
            plain = _decode(symbols, TABLES[name])
            if plain is not None:
                while (deeper := _decode(plain, TABLES[name])) is not None:  # damaged more than once
                    plain = deeper
                if lm.plausible(plain, ()):
                    cand[name] = lm.score(left + plain)
        ways.append((cand, n))
    return ways


def _em(ways, names, rounds: int) -> dict[str, float]:
    weights = dict.fromkeys(names, 1.0 / len(names))
    for _ in range(rounds):
        new = dict.fromkeys(names, 1e-3)
        for cand, n in ways:
            logs = {k: math.log(weights[k]) + v for k, v in cand.items()}
            top = max(logs.values())
            norm = sum(math.exp(v - top) for v in logs.values())
            for k, v in logs.items():
                new[k] += n * math.exp(v - top) / norm
        total = sum(new.values())
        weights = {k: v / total for k, v in new.items()}
    return weights


def learn_swaps(groups, lm: Bigrams, rounds: int = EM_ROUNDS) -> dict[str, float]:
    """EM over the single letters (before, letter, n) of one source: weight of each code page swap."""
    ways = []
    for before, letter, n in groups:
        cand = {"": lm.score(before + letter)}
        for name, table in SWAPS.items():
            if ord(letter) in table:
                cand[name] = lm.score(before + chr(table[ord(letter)]))
        ways.append((cand, n))
    return _em(ways, ("", *SWAPS), rounds)


def choose_tables(groups, lm: Bigrams, share: float = 0.0, evidence: float = EVIDENCE) -> list[str]:
    """The fewest code pages that explain the damage in the groups of one source, or of all.

    Related code pages read most symbols alike, so EM over all of them would split the
    evidence.  Tables are taken greedily, common ones first on a tie, while one gains the evidence
    on the damaged letters that no table before it explains, and these are more than a share
    of all damaged letters.
    """
    left = [({k: v - cand[""] for k, v in cand.items() if k and v - cand[""] > MIN_GAIN}, n) for cand, n in _ways(groups, lm, TABLES)]
    left = [(ok, n) for ok, n in left if ok]
    least = share * sum(n for _, n in left)
    chosen: list[str] = []
    while left:
        mass: Counter = Counter()
        gain: Counter = Counter()
        for ok, n in left:
            for k, v in ok.items():
                mass[k] += n
                gain[k] += n * v
        best = max((k for k in TABLES if gain[k] >= evidence), key=lambda k: mass[k], default=None)  # the first of equals
        if best is None or mass[best] <= least:
            break
        chosen.append(best)
        left = [(ok, n) for ok, n in left if best not in ok]
    return chosen


def learn_tables(groups, lm: Bigrams, names=tuple(TABLES), rounds: int = EM_ROUNDS) -> dict[str, float]:
    """EM over the garbled groups (before, symbols, n) of one source: weight of each table."""
    return _em(_ways(groups, lm, names), ("", *names), rounds)


def _as_bytes(letter: str, size: int) -> tuple:
    """What the symbols of a plain letter stand for: its bytes, or itself where single bytes were swapped."""
    return (letter,) if size == 1 else tuple(letter.encode())


def learn_mapping(groups, own, sound: dict[str, int], alone: dict[str, int], all_: dict[str, int], lm: Bigrams, size: int, rounds: int = EM_ROUNDS) -> dict:
    """EM for a substitution no code page explains: symbol -> byte (size 2 or 3), or symbol -> letter (size 1).

    ``groups`` are (before, symbols, after, n) of one source, ``own`` those of them that were counted as
    sound text, ``sound`` how often each letter stands alone in the text of all sources, ``alone`` in
    that of this one, ``all_`` how often each letter that is not Latin stands anywhere in it (a script
    that is at home there stands between blanks too).
    """
    seen: Counter = Counter()
    for _, symbols, _, n in groups:
        seen.update(dict.fromkeys(symbols, n))
    foreign = {s for s, n in seen.items() if sound.get(s, 0) - (alone.get(s, 0) if size == 1 else 0) <= ALONE * n}
    foreign = {s for s in foreign if seen[s] >= ALONE * all_.get(s, 0)}
    groups = [g for g in groups if len(g[1]) == size and foreign.issuperset(g[1])]
    plain = [c for c in sound if c not in foreign and len(c.encode()) == max(size, 2) and (size > 1 or _latin(c))]
    if not groups or not plain:
        return {}
    counts = dict(lm.counts)
    for before, symbols, after, n in own:
        text = before + symbols + after
        for part in (*_pairs(text), *text):
            counts[_bucket(part)] = max(counts.get(_bucket(part), 0) - n, 0)
    clean = Bigrams(counts)
    likely = np.array([[clean.score(b + c + a) for c in plain] for b, _, a, _ in groups])
    n = np.array([g[3] for g in groups], float)
    symbols = sorted({s for g in groups for s in g[1]})
    values = sorted({x for c in plain for x in _as_bytes(c, size)})
    place = np.array([[symbols.index(s) for s in g[1]] for g in groups])
    target = np.array([[values.index(x) for x in _as_bytes(c, size)] for c in plain])
    table = np.full((len(symbols), len(values)), 1.0 / len(values))
    mass = table
    for _ in range(rounds):
        logs = likely.copy()
        for k in range(size):
            logs += np.log(table[place[:, k]][:, target[:, k]])
        post = np.exp(logs - logs.max(axis=1, keepdims=True))
        post *= (n / post.sum(axis=1))[:, None]
        mass = np.zeros_like(table)
        for k in range(size):
            by_value = np.zeros((len(groups), len(values)))
            np.add.at(by_value.T, target[:, k], post.T)
            np.add.at(mass, place[:, k], by_value)
        table = (mass + 1e-3) / (mass + 1e-3).sum(axis=1, keepdims=True)
    found: dict = {}
    for i, j in sorted(np.argwhere(mass > 0.5 * mass.sum(axis=1, keepdims=True)).tolist(), key=lambda x: -mass[x[0], x[1]]):
        if values[j] not in found.values():
            found[symbols[i]] = values[j]
    back = {v: c for c in plain for v in [_as_bytes(c, size)]}
    gain, told = 0.0, 0
    for (before, text, after, count), row in zip(groups, likely):
        letter = back.get(tuple(found.get(s) for s in text))
        if letter is not None:
            gain += count * (row[plain.index(letter)] - clean.score(before + text + after))
            told += count
    enough = told and gain >= LEARN_EVIDENCE and gain >= LEARN_GAIN * told and 2 * told >= n.sum() and len(found) >= LEARN_SYMBOLS
    return found if enough else {}


class Repairer:
    """Restores texts of one source with its learned tables.

    One wrong decoding hits a whole value or passage, so the table is chosen per value: the
    one with the largest summed gain over all damaged runs, applied with translate(), again
    and again until no table gains (twice damaged text, passages with different damage).
    """

    def __init__(self, model: dict, lm: Bigrams):
        """``model`` has weights (of code pages and swaps), bytes (learned symbol -> byte) and letters (symbol -> letter)."""
        self.lm = lm
        weights = model["weights"]
        kept = {k: v for k, v in weights.items() if k in TABLES}
        self.swaps = [(math.log(v), SWAPS[k]) for k, v in sorted(weights.items()) if k in SWAPS]
        self.swapped: dict[str, tuple | None] = {}
        self.tables = [(math.log(v), TABLES[k]) for k, v in sorted(kept.items(), key=lambda x: (-x[1], x[0]))]
        self.letters, self.single = _LETTERS, _SWAPPED
        self.learned, self.own_swap = -1, {}
        if model["bytes"]:
            own = {b: 0xFFFF for b in range(128, 256)} | {ord(c): b for c, b in model["bytes"].items()}
            self.tables.append((0.0, own))
            self.learned = len(self.tables) - 1
            self.letters = _LETTERS | frozenset(model["bytes"])
        if model["letters"]:
            self.own_swap = {ord(c): x for c, x in model["letters"].items()}
            self.swaps.append((0.0, self.own_swap))
            self.single = _SWAPPED | frozenset(model["letters"])
        self.known: dict[str, tuple] = {}

    def _gains(self, run: str) -> tuple:
        """For each table that decodes the run: (table no, plain run, gain in log-likelihood)."""
        got = self.known.get(run)
        if got is None and len(self.letters.intersection(run)) < 2:
            got = self.known[run] = ()
        elif got is None:
            was = self.lm.score(f" {run} ")
            got = tuple(
                (i, plain, gain)
                for i, (_, table) in enumerate(self.tables)
                if (plain := self._read(run, table)) is not None and (gain := LEARN_GAIN if i == self.learned else self.lm.score(f" {plain} ") - was) > MIN_GAIN
            )
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[run] = got
        return got

    def _read(self, run: str, table: dict[int, int]) -> str | None:
        every = [t for _, t in self.tables]
        plain = _decode(run, table)
        if plain is not None and not self.lm.plausible(plain, every):
            plain = None
        if plain is None and len(run) > 2:  # sound letters may touch the damaged ones
            for cut in (1, 2):
                for a, b in ((cut, len(run)), (0, len(run) - cut)):
                    if b - a > 1 and (part := _decode(run[a:b], table)) is not None and self.lm.plausible(part, every):
                        return run[:a] + part + run[b:]
        return plain

    def text(self, text: str) -> str:
        for _ in range(MAX_ROUNDS):
            total: dict[int, float] = {}
            best: dict[int, dict[str, str]] = {}
            for run, n in Counter(_RUN.findall(text)).items():
                for i, plain, gain in self._gains(run):
                    total[i] = total.get(i, self.tables[i][0]) + (gain + UNREAD) * n
                    best.setdefault(i, {})[run] = plain
            if not total:
                break
            i = max(total, key=lambda i: (total[i], -i))
            plain_of = best[i]
            text = _RUN.sub(lambda m: plain_of.get(m.group(), m.group()), text)
        plain = self._unswap(text)
        if plain is text and "\n" in text and self._suspect(text) >= 2:
            plain = "\n".join(line if line.isascii() else self._unswap(line) for line in text.split("\n"))
        return plain

    def _swap_gains(self, group: str) -> tuple | None:
        """Gain of each swap for a letter group in context; None where no swap gains."""
        if group not in self.swapped:
            if self.single.isdisjoint(group):
                self.swapped[group] = None
                return None
            was = self.lm.score(group)
            gains = tuple(self._swap_gain(group, t, was) for _, t in self.swaps)
            if len(self.swapped) > 500_000:
                self.swapped.clear()
            self.swapped[group] = gains if gains and max(gains) > MIN_GAIN else None
        return self.swapped[group]

    def _swap_gain(self, group: str, table: dict, was: float) -> float:
        """The bigrams do not speak against a learned letter: they were counted with the damage in them."""
        if table is self.own_swap:
            return LEARN_GAIN * sum(ord(c) in table for c in group)
        return self.lm.score(group.translate(table)) - was

    def _suspect(self, text: str) -> int:
        return sum(self._swap_gains(g) is not None for g in _GROUP.findall(text))

    def _unswap(self, text: str) -> str:
        found = Counter(_GROUP.findall(text))
        odd = sum(n for g, n in found.items() if self._swap_gains(g) is not None)
        if 2 * odd < sum(found.values()) or not odd:
            return text
        total = [weight for weight, _ in self.swaps]
        for group, n in found.items():
            was = self.lm.score(group)
            for i, (_, table) in enumerate(self.swaps):
                total[i] += n * self._swap_gain(group, table, was)
        i = max(range(len(total)), key=lambda i: total[i])
        return text.translate(self.swaps[i][1]) if total[i] > SWAP_GAIN else text


def _fit(lm: Bigrams, common: list[str], sound: dict[str, int]):
    """Per source: its code pages and their weights, and the mapping learned for what they leave."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kinds: dict[int, list] = {k: [] for k in range(-6, 0)}
        for before, symbols, bucket, n in zip(rows["before"], rows["symbols"], rows["bucket"], rows["n"]):
            kinds[bucket].append((before, symbols, n))
        # a source's own pages, and those in use all over for runs it gives no evidence about
        names = list(dict.fromkeys(common + choose_tables(kinds[-1], lm)))
        weights = learn_tables(kinds[-1], lm, names) | learn_swaps(kinds[-2], lm)
        split = lambda kind: [(b, x[:-1], x[-1], n) for b, x, n in sorted(kinds[kind])]

        def unexplained(group) -> bool:
            before, symbols, after, _ = group
            was = lm.score(before + symbols + after)
            plain = (_decode(symbols, TABLES[name]) for name in names)
            return not any(p is not None and lm.plausible(p, ()) and lm.score(before + p + after) - was > MIN_GAIN for p in plain)

        own = split(-3)
        runs = [g for g in own + split(-4) if unexplained(g)]
        mapping: dict = {}
        all_ = {letter: n for _, letter, n in kinds[-6]}
        single: Counter = Counter()
        for _, letter, n in kinds[-2]:
            single[letter] += n
        for size in (2, 3):
            for symbol, byte in learn_mapping(runs, own, sound, single, all_, lm, size).items():
                if symbol not in mapping and byte not in mapping.values():
                    mapping[symbol] = byte
        alone = [g for g in split(-5) if g[1] not in _SWAPPED]
        letters = learn_mapping(alone, alone, sound, single, all_, lm, 1)
        model = {"weights": {k: v for k, v in weights.items() if k}, "bytes": mapping, "letters": letters}
        return pd.DataFrame({"source": [rows["source"].iloc[0]], "model": [json.dumps(model, sort_keys=True)]})

    return run


def encoding_model(texts: DataFrame, source_col: str, text_col: str):
    """(bigram counts, models (source, model) as a DataFrame) over all rows of ``texts``."""
    stats = written(
        texts.select(F.coalesce(F.col(source_col), F.lit("")).alias("s"), F.col(text_col).alias("t"))
        .where("t is not null and t rlike '[^\\x00-\\x7f]'")
        .mapInArrow(sliced(_stats), "source string, before string, symbols string, bucket int, n bigint")
        .groupBy("source", "before", "symbols", "bucket")
        .agg(F.sum("n").alias("n")),
        "encoding-counts",
    )
    # bounded by the alphabet, not by the texts or sources: bigram buckets, garbled letters and single letters of all sources together
    lm = Bigrams({r.bucket: r.n for r in stats.where("bucket >= 0").collect()})
    pooled = stats.where("bucket = -1").groupBy("before", "symbols").agg(F.sum("n").alias("n")).collect()
    common = choose_tables(sorted((r.before, r.symbols, r.n) for r in pooled), lm, COVER_SHARE, 0.0)
    alone = stats.where("bucket = -2").groupBy("symbols").agg(F.sum("n").alias("n")).collect()
    sound = {r.symbols: r.n for r in sorted(alone, key=lambda r: r.symbols)}
    return lm, written(stats.where("bucket < 0").groupBy("source").applyInPandas(_fit(lm, common, sound), "source string, model string"), "encoding-models")


def repair_encoding(df: DataFrame, id_cols: list[str], source_col: str, text_col: str, model) -> DataFrame:
    """Damaged rows of ``df``: id columns, restored text (NULL if lost), lost flag, MD5 of the restored text.

    Each row meets the model of its source in a join; the bigrams, of fixed size, go to every task.
    """
    lm, models = model
    bc = df.sparkSession.sparkContext.broadcast(lm.counts)
    n_ids = len(id_cols)
    types = [df.schema[c].dataType.simpleString() for c in id_cols]
    schema = ", ".join(f"{c} {t}" for c, t in zip(id_cols, types)) + ", restored string, lost boolean, restored_md5 string"

    def apply(batches):
        bigrams = Bigrams(bc.value)
        repairers: dict[str, Repairer] = {}
        for batch in batches:
            keep, out, lost, md5 = [], [], [], []
            for i, (text, told) in enumerate(zip(batch.column(n_ids).to_pylist(), batch.column(n_ids + 1).to_pylist())):
                if not text or text.isascii():
                    continue
                if LOST in text:
                    keep.append(i), out.append(None), lost.append(True), md5.append("lost")
                    continue
                if told is None:
                    continue
                if (repairer := repairers.get(told)) is None:
                    if len(repairers) > 1000:
                        repairers.clear()
                    repairer = repairers[told] = Repairer(json.loads(told), bigrams)
                fixed = repairer.text(text)
                if fixed != text:
                    keep.append(i), out.append(fixed), lost.append(False)
                    md5.append(hashlib.md5(fixed.encode("utf-8", "surrogatepass")).hexdigest())
            ids = batch.select(range(n_ids)).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*ids.columns, pa.array(out, pa.string()), pa.array(lost, pa.bool_()), pa.array(md5, pa.string())],
                names=[*id_cols, "restored", "lost", "restored_md5"],
            )

    slim = df.select(*id_cols, F.coalesce(F.col(source_col), F.lit("")).alias("__source"), F.col(text_col).alias("__text"))
    slim = slim.where("__text rlike '[^\\x00-\\x7f]'").join(models.select(F.col("source").alias("__source"), "model"), "__source", "left")
    return slim.select(*id_cols, "__text", "model").mapInArrow(sliced(apply), schema)


_READABLE: dict[str, bool] = {}


def _readable(run: str) -> bool:
    """Whether a common code page reads the run as UTF-8."""
    got = _READABLE.get(run)
    if got is None:
        if len(_READABLE) > 200_000:
            _READABLE.clear()
        got = _READABLE[run] = len(_LETTERS.intersection(run)) > 1 and any(_decode(run, TABLES[n]) is not None for n in COMMON)
    return got


def undo_common_damage(text: str) -> str:
    """Reads runs of one line back through the common code pages; no model, for other operators' use."""
    for _ in range(MAX_ROUNDS):
        runs = [r for r in _RUN.findall(text) if _readable(r)]
        if not runs:
            break
        best: dict[str, str] = {}
        for name in COMMON:
            plain = {r: p for r in runs if (p := _decode(r, TABLES[name])) is not None and p.isprintable()}
            if len(plain) > len(best):
                best = plain
        if 2 * len(best) <= len(set(runs)):
            break
        text = _RUN.sub(lambda m: best.get(m.group(), m.group()), text)
    return text
