import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from docketry.llm import common, encoding, increments, language, leakage, mainbody, mixing, sitelines, splitting, truncation
from docketry.llm.hashing import Rolling

PAGE = (
    "<html><head><title>T</title></head><body><div class='nav'><p><a href='/a'>Home</a></p><p><a href='/b'>Search</a></p></div>"
    "<div><h1>Notice {n} on ledgers</h1><p class='meta'>Share this with your Desk network</p>"
    "<p>The registered adviser shall <b>publish</b> its ledger number {n} before the close of the reporting period, as agreed.</p>"
    "<ul><li>keep the ledger {w}</li></ul><div>See also</div><div>Other notice {w}</div></div>"
    "<div class='ft'><p>Share this with your Desk network</p><p>See also</p><p><a href='/c'>Terms</a></p></div></body></html>"
)
WORDS = "alpha bravo carol delta eagle frost".split()
RAW = "id string, source_id string, content_format string, content string, html string, own string, key bigint"


def _pages():
    rows = [(f"p{i}", "s", "html", PAGE.format(n=i, w=w), "clash", "x", 1) for i, w in enumerate(WORDS)]
    return rows + [("n", "s", "html", None, None, None, None), ("e", None, "text", "", None, None, None), ("j", "s", "json", "{}", None, None, None), rows[0]]


@pytest.mark.parametrize("limit", [common.BROADCAST_ROWS, 0])
def test_main_body(spark, monkeypatch, limit):
    monkeypatch.setattr(mainbody, "BROADCAST_ROWS", limit)
    got = mainbody.main_body(spark.createDataFrame(_pages(), RAW)).where("id = 'p1'").orderBy("block_no").collect()
    text = [r.block for r in got]
    assert text[0] == "Notice 1 on ledgers" and "keep the ledger bravo" in text and any(t.startswith("The registered adviser shall publish") for t in text)
    assert not {"Home", "Share this with your Desk network", "See also", "Other notice bravo", "Terms"} & set(text)


@pytest.mark.parametrize("limit", [common.BROADCAST_ROWS, 0])
def test_main_body_teasers_of_a_title(spark, monkeypatch, limit):
    """Neither teasers on 3 of 150 pages nor re-sent pages make a title the site's own; a legal notice of one site is none of another's body."""
    monkeypatch.setattr(mainbody, "BROADCAST_ROWS", limit)
    names = ["".join(p) for p in combinations("abcdefghijkl", 4)][:152]
    page = lambda i, more: PAGE.format(n=f"{names[i]}", w=names[i]).replace("<p>See also</p>", f"<p>See also</p><p>{more}</p>")
    rows = [(f"p{i}", "s", "html", page(i, f"Notice {names[0]} on ledgers" if i in (7, 70, 140) else ""), None, None, 1) for i in range(150)]
    rows += [("r", "s", "html", page(150, f"Notice {names[1]} on ledgers"), None, None, 1)] * 8
    rows.append(("o", "t", "html", page(151, "").replace("<ul>", "<p>Terms</p><ul>"), None, None, 1))
    got = mainbody.main_body(spark.createDataFrame(rows, RAW)).where("id in ('p0', 'p1', 'o')").collect()
    assert {(i, f"Notice {n} on ledgers") for i, n in (("p0", names[0]), ("p1", names[1]), ("o", names[151]))} <= {(r.id, r.block) for r in got}
    assert not {"Terms", "See also", "Share this with your Desk network"} & {r.block for r in got}


def test_main_body_is_one_plan_at_every_size(spark, monkeypatch):
    """A site's own line that plain text pages wrap is known whatever the number of such lines, and re-sent rows and pages without id keep theirs."""
    wrapped = "Share this with your\nDesk network\nThe adviser shall keep its own ledger until the close of the period."
    rows = _pages() + [("t", "s", "text", wrapped, None, None, None), (None, "s", "text", wrapped, None, None, None), ("t", "other", "text", wrapped, None, None, None)]
    got = []
    for limit in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(mainbody, "BROADCAST_ROWS", limit)
        monkeypatch.setattr(common, "FILTER_BITS", 1 << 29 if limit else 64)  # and with a bitmap that everything passes
        got.append(sorted((r.id or "", r.block_no, r.block) for r in mainbody.main_body(spark.createDataFrame(rows, RAW)).collect()))
    assert got[0] == got[1]
    assert [b for i, _, b in got[1] if i == ""] == ["The adviser shall keep its own ledger until the close of the period."]


def test_main_body_empty(spark):
    assert mainbody.main_body(spark.createDataFrame([], RAW)).count() == 0


def _sets(text):
    w = [x for x in re.split("[ \n]+", text.lower()) if x]
    return set(zip(w, w[1:]))


def _texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randrange(20, 120))] for _ in range(12)]
    out = []
    for i in range(90):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(0, 8)):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append((f"d{i:02d}", " ".join(t) if i % 3 else "\n".join(t)))
    return out + [("x1", "one"), ("x2", ""), ("x3", None), ("x4", "one two"), ("x5", "one  two "), out[0]]


@pytest.mark.parametrize("bits, hot", [(common.FILTER_BITS, increments.HOT), (64, 3)])
def test_pivot_index_equals_brute_force(spark, monkeypatch, tmp_path, bits, hot):
    """Also with a bitmap that everything passes, and with anchors split by salt."""
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    monkeypatch.setattr(increments, "HOT", hot)
    rows = _texts()
    texts = spark.createDataFrame(rows, "doc_id string, clean_text string")
    ids = sorted({i for i, _ in rows})
    days = spark.createDataFrame([(i, f"2026-0{2 + n % 3}-0{1 + n % 5}") for n, i in enumerate(ids)], "doc_id string, day string").withColumn("day", F.to_date("day"))
    day = {r.doc_id: str(r.day) for r in days.collect()}
    since = F.to_date(F.lit("2026-03-01"))
    index = increments.PivotIndex(spark, f"file://{tmp_path}/index")
    index.start(texts, days.where(F.col("day") < since))
    _, members, links = index.check(texts, days.where(F.col("day") >= since))
    got = {(r.doc_id_a, r.doc_id_b) for r in increments.found_pairs(members, links, since).collect()}
    sets = {i: _sets(t or "") for i, t in rows}
    want = {
        (a, b)
        for a, b in combinations(ids, 2)
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]) and day[a] != day[b] and max(day[a], day[b]) >= "2026-03-01"
    }
    assert got == want and want


def test_batches_one_by_one_or_together(spark, tmp_path):
    """Each batch is held against what was accepted before it; checking all at a time says the same."""
    rows = [(i, t) for i, t in dict(_texts()).items() if t]
    texts = spark.createDataFrame(rows, "doc_id string, clean_text string")
    day = {i: "2026-01-01" if n < 50 else f"2026-03-0{1 + (n - 50) // 20}" for n, (i, _) in enumerate(rows)}
    days = spark.createDataFrame(list(day.items()), "doc_id string, day string").withColumn("day", F.to_date("day"))
    since = F.to_date(F.lit("2026-03-01"))
    got = []
    for steps in (["2026-03-01", "2026-03-02", "2026-03-03"], None):
        index = increments.PivotIndex(spark, f"file://{tmp_path}/index{len(got)}")
        index.start(texts, days.where(F.col("day") < since))
        found, classes = set(), {}
        for step in steps or [None]:
            batch = days.where(F.col("day") == F.to_date(F.lit(step))) if step else days.where(F.col("day") >= since)
            members, links = index.accept(texts, batch)
            found |= {(r.doc_id_a, r.doc_id_b) for r in increments.found_pairs(members, links, since).collect()}
            for r in increments.copy_classes(members, links, since).collect():
                classes[r.doc_id] = r
        got.append(found)
    sets = {i: _sets(t) for i, t in rows}
    near = lambda a, b: bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])
    want = {(a, b) for a, b in combinations(sorted(day), 2) if day[a] != day[b] and max(day[a], day[b]) >= "2026-03-01" and near(a, b)}
    assert got[0] == got[1] == want and want
    for i, r in classes.items():
        others = {frozenset(sets[j]) for j in day if near(i, j) and sets[j] != sets[i]}
        assert r.n_linked == len(others) and r.n_equal == sum(sets[j] == sets[i] for j in day)
        assert (r.first_near is None) == (not any(near(i, j) and sets[j] != sets[i] and day[j] < day[i] for j in day))
    stored = spark.read.parquet(f"file://{tmp_path}/index1/table")
    assert stored.count() == sum(bool(s) for s in sets.values()) and stored.where("band = 0").count() < stored.count()


def test_the_order_is_fitted_on_the_whole_history(spark, monkeypatch, tmp_path):
    """However many documents there are, every one is counted."""
    monkeypatch.setattr(increments, "ORDER_DOCS", 10, raising=False)  # there was such a limit
    rows = [(f"d{n}", f"pair number{n} of words{n}") for n in range(60)]
    texts = spark.createDataFrame(rows, "doc_id string, clean_text string")
    index = increments.PivotIndex(spark, f"file://{tmp_path}/index")
    index.start(texts, texts.select("doc_id", F.to_date(F.lit("2026-01-01")).alias("day")))
    slots = set(increments._slot(increments.sequences([t for _, t in rows])[1]).tolist())
    ranked = {i for i, rank in enumerate(index._ranks().value) if rank}
    assert ranked == slots and len(slots) > 100


def test_pivot_index_empty(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id string, clean_text string")
    days = spark.createDataFrame([], "doc_id string, day date")
    index = increments.PivotIndex(spark, f"file://{tmp_path}/index")
    index.start(none, days)
    members, links = index.accept(none, days)
    assert increments.found_pairs(members, links, F.to_date(F.lit("2026-03-01"))).count() == 0


def test_triangle_bound():
    texts = [t for _, t in _texts() if t]
    owner, pairs = increments.sequence_sets(texts)
    assert len(owner) == sum(len(_sets(t)) for t in texts)


SAMPLES = {
    "en": "the depository shall publish the quarterly statement before the close of the reporting period and keep it",
    "fr": "le dépositaire doit publier le relevé trimestriel avant la clôture de la période et le conserver",
    "de": "die Verwahrstelle muss die vierteljährliche Aufstellung vor dem Ende des Zeitraums veröffentlichen und aufbewahren",
    "es": "el depositario debe publicar el estado trimestral antes del cierre del período y conservar la lista",
    "it": "il depositario deve pubblicare il prospetto trimestrale prima della chiusura del periodo e conservare la lista",
    "pt": "o depositário deve publicar o mapa trimestral antes do fecho do período e conservar a tabela não",
    "hi": "निक्षेपागार को तिमाही विवरण अवधि समाप्त होने से पहले प्रकाशित करना होगा और सुरक्षित रखना होगा",
}


def test_languages(spark):
    rows = [(f"{k}{i}", f"{k.upper()}-X" if i else k, f"{v} {i}") for k, v in SAMPLES.items() for i in range(4)]
    model = language.train(spark.createDataFrame(rows, "id string, language string, clean_text string"))
    mixed = [("m", "en", SAMPLES["en"] + "\n\n" + SAMPLES["de"] + "\n" + SAMPLES["hi"]), ("z", None, SAMPLES["fr"]), ("n", "en", None), ("e", "en", ""), ("x", "en", "12 34\n--")]
    lines = language.line_languages(spark.createDataFrame(mixed, "id string, language string, clean_text string"), model)
    got = {(r.id, r.line_no): r for r in lines.collect()}
    assert {k: v.lang for k, v in got.items()} == {("m", 0): "en", ("m", 2): "de", ("m", 3): "hi", ("z", 0): "fr"}
    assert got["m", 2].segment_no == 1 and all(v.confidence > 0.5 for v in got.values())
    of_all = {r.id: (r.lang, r.confidence > 0) for r in language.document_languages(lines, spark.createDataFrame(mixed, "id string, language string, clean_text string")).collect()}
    assert of_all["z"] == ("fr", True) and of_all["x"] == of_all["n"] == (None, False) and len(of_all) == len(mixed)
    assert language.segments(lines).where("id = 'm'").count() == 3


def test_forward_sums_all_segmentations():
    model = language.PieceModel(["▁a", "▁ab", "b", "a", "c", "bc"])
    model.probs[:] = 0.1
    # ▁a b c, ▁a bc, ▁ab c; and with ▁ as an unknown letter: ▁ a b c, ▁ a bc
    want = 0.1**3 + 2 * 0.1**2 + language._UNKNOWN * (0.1**3 + 0.1**2)
    assert abs(float(language.np.exp(model.score("abc")[0])) - want) < 1e-14


def test_long_words_are_scored_whole():
    model = language.PieceModel(["▁a", "a", "b", "ab"])
    model.probs[:] = [[0.1] * 7, [0.2] * 7, [0.3] * 7, [0.05] * 7]
    model.probs[1, 0] = 0.4
    import numpy as np

    for word in ("ab" * 15, "a" * 70 + "b", "ab" * 3000):
        edges = model.lattice(word)
        assert np.allclose(language.Lattices([edges]).forward(model.log_probs())[len(edges) - 1], model.score(word))
    assert not np.allclose(model.score("a" * 64 + "a"), model.score("a" * 64 + "b"))
    strange = "ж" * 90  # no piece at all
    edges = model.lattice(strange)
    assert np.allclose(language.Lattices([edges]).forward(model.log_probs())[len(edges) - 1], model.score(strange))


def test_expected_counts_equal_enumeration():
    """One EM step against all segmentations of a word."""
    import numpy as np

    model = language.PieceModel(["▁a", "a", "b", "ab"])
    model.probs[:] = np.array([0.1, 0.2, 0.3, 0.4])[:, None]
    ways = {("▁a", "b"): 0.1 * 0.3, ("▁", "a", "b"): language._UNKNOWN * 0.2 * 0.3, ("▁", "ab"): language._UNKNOWN * 0.4}
    total = sum(ways.values())
    want = [5 * sum(p for w, p in ways.items() if piece in w) / total for piece in ("▁a", "a", "b", "ab")]
    got = language.Lattices([model.lattice("ab")]).expected(model.log_probs(), np.full((1, 7), 5.0))[:-1]
    assert np.allclose(got[:, 0], want)


def _damage(text, name):
    letters = {}
    for c, b in encoding.TABLES[name].items():
        if b != 0xFFFF:
            letters.setdefault(b, chr(c))
    return "".join(letters.get(b, chr(b)) if b > 127 else chr(b) for b in text.encode())


def test_encoding_round_trip(spark):
    clean = [f"Die Behörde prüft § {i} für Übergänge – l’État répond à la clôture, coração e ação “{w}” 100 €" for i, w in enumerate(WORDS * 8)]
    rows = [(f"c{i}", "s", t) for i, t in enumerate(clean)]
    rows += [(f"b{i}", "s", _damage(t, n)) for i, (t, n) in enumerate(zip(clean, ("cp1252", "mac_roman", "cp437") * 4))]
    rows += [("d", "s", _damage(_damage(clean[0], "cp1252"), "cp1252")), ("l", "s", "lost �"), ("n", "s", None), ("e", None, ""), ("a", "s", "ascii")]
    df = spark.createDataFrame(rows, "id string, source_id string, text string")
    got = {r.id: r for r in encoding.repair_encoding(df, ["id"], "source_id", "text", encoding.encoding_model(df, "source_id", "text")).collect()}
    assert set(got) == {f"b{i}" for i in range(12)} | {"d", "l"}
    assert all(got[f"b{i}"].restored == clean[i] for i in range(12)) and got["d"].restored == clean[0]
    assert got["l"].lost and got["l"].restored_md5 == "lost"


def test_encoding_of_a_small_source(spark):
    """A small source damaged by a code page of its own, beside a large one with much other damage."""
    clean = [f"Die Behörde prüft § {i} für Übergänge – l’État répond à la clôture, coração e ação “{w}” 100 €" for i, w in enumerate(WORDS * 8)]
    rows = [(f"b{i}", "big", _damage(clean[i % 48], "cp1252")) for i in range(900)] + [(f"c{i}", "big", t) for i, t in enumerate(clean * 4)]
    rows += [(f"k{i}", "small", _damage(clean[i], "koi8_r")) for i in range(3)] + [(f"s{i}", "small", t) for i, t in enumerate(clean[3:9])]
    df = spark.createDataFrame(rows, "id string, source_id string, text string")
    got = {r.id: r.restored for r in encoding.repair_encoding(df, ["id"], "source_id", "text", encoding.encoding_model(df, "source_id", "text")).collect()}
    assert set(got) == {f"b{i}" for i in range(900)} | {f"k{i}" for i in range(3)}
    assert all(got[f"k{i}"] == clean[i] for i in range(3)) and all(got[f"b{i}"] == clean[i % 48] for i in range(900))


def _prose(n, seed):
    """Sound text with many accented letters in their usual places."""
    rng = random.Random(seed)
    words = "größe straße maß prüfung übung behörde möglich führen können für über ändern anhörung verfügung erklärung köln schön années décret société également période règle première après intérêt même être contrôle forêt français reçu façade où là déjà naïve".split()
    plain = "die der und mit nach dem der les des dans pour avec sur register konto bilanz banque conseil".split()
    return [" ".join(rng.choice(words if rng.random() < 0.5 else plain) for _ in range(60)) for _ in range(n)]


def test_encoding_learns_an_unknown_code_page(spark):
    """A page no list has, bytes 128 and up in random order over Georgian letters, in one source; it is learned and undone."""
    letters = [chr(0x10A0 + i) for i in range(128)]
    random.Random(11).shuffle(letters)
    strange = lambda text: "".join(letters[b - 128] if b > 127 else chr(b) for b in text.encode())
    clean = _prose(400, 1)
    rows = [(f"c{i}", "big", t) for i, t in enumerate(_prose(600, 2))] + [(f"o{i}", "own", t) for i, t in enumerate(_prose(100, 3))]
    rows += [(f"x{i}", "own", strange(t)) for i, t in enumerate(clean)]
    df = spark.createDataFrame(rows, "id string, source_id string, text string")
    got = {r.id: r.restored for r in encoding.repair_encoding(df, ["id"], "source_id", "text", encoding.encoding_model(df, "source_id", "text")).collect()}
    assert set(got) <= {f"x{i}" for i in range(400)}
    letters_right = sum(sum(a == b for a, b in zip(got.get(f"x{i}", strange(t)), t)) if len(got.get(f"x{i}", "")) == len(t) else 0 for i, t in enumerate(clean))
    assert letters_right >= 0.98 * sum(map(len, clean))
    assert sum(got.get(f"x{i}") == t for i, t in enumerate(clean)) >= 380


def test_encoding_learns_swapped_letters(spark):
    """Single bytes read through an unknown page: a letter stands for a letter."""
    swap = {c: chr(0x2460 + i) for i, c in enumerate("äöüßéèêàçùôï")}
    strange = lambda text: "".join(swap.get(c, c) for c in text)
    clean = _prose(300, 6)
    rows = [(f"c{i}", "big", t) for i, t in enumerate(_prose(600, 7))] + [(f"x{i}", "own", strange(t)) for i, t in enumerate(clean)]
    df = spark.createDataFrame(rows, "id string, source_id string, text string")
    got = {r.id: r.restored for r in encoding.repair_encoding(df, ["id"], "source_id", "text", encoding.encoding_model(df, "source_id", "text")).collect()}
    assert set(got) == {f"x{i}" for i in range(300)}
    assert sum(got[f"x{i}"] == t for i, t in enumerate(clean)) >= 280


def test_encoding_leaves_other_scripts_alone(spark):
    """Sound words of other scripts and rare names in one source are no cipher."""
    rows = [(f"c{i}", "big", t) for i, t in enumerate(_prose(300, 4))]
    rows += [(f"o{i}", "own", f"{t} निक्षेपागार को तिमाही Sørensen и Смит ação às opções") for i, t in enumerate(_prose(100, 5))]
    df = spark.createDataFrame(rows, "id string, source_id string, text string")
    assert encoding.repair_encoding(df, ["id"], "source_id", "text", encoding.encoding_model(df, "source_id", "text")).count() == 0


def test_site_lines(spark):
    rows = [(f"d{i}", "s", f"Title {w}\n\nShare  THIS page {i}\nbody {w}", None, 1) for i, w in enumerate(WORDS)]
    rows += [rows[0], ("n", "s", None, None, 1), ("e", None, "", None, 1)]
    df = spark.createDataFrame(rows, "id string, source_id string, clean_text string, published_at timestamp, key int")
    got = {(r.id, r.line_no) for r in sitelines.repeated_line_numbers(df).collect()}
    assert got == {(f"d{i}", 2) for i in range(6)}
    text = {r.id: r.stripped for r in sitelines.strip_repeated_lines(df).collect()}
    assert text["d1"] == "Title bravo\n\nbody bravo" and text["n"] is None


def test_site_lines_of_a_republished_article(spark):
    """One article under 6 of 12 ids keeps its lines, as do lines of one day; the site's line goes, though it stands in few ids."""
    names = ["".join(p) for p in combinations("abcdefg", 3)]
    rows = [(f"a{i}", "s", "Article\nits only body", f"2026-01-0{1 + i}") for i in range(6)]
    rows += [(f"d{i}", "s", f"Title {w}\nShare this page" + "\nSame day" * (i < 3), f"2026-02-0{1 + (0 if i < 3 else i)}") for i, w in enumerate(names[:6])]
    rows += [(f"m{i}", "t", "Many copies", "2026-03-01") for i in range(60)] + [(f"e{i}", "t", f"Body {w}\nFollow us", f"2026-03-0{2 + i}") for i, w in enumerate(names[:4])]
    df = spark.createDataFrame(rows, "id string, source_id string, clean_text string, day string").withColumn("published_at", F.to_timestamp("day"))
    text = {r.id: r.stripped for r in sitelines.strip_repeated_lines(df).collect()}
    assert text["a0"] == "Article\nits only body" and text["m0"] == "Many copies"
    assert text["d0"] == f"Title {names[0]}\nSame day" and text["d5"] == f"Title {names[5]}" and text["e0"] == f"Body {names[0]}"
    found = {r.id for r in sitelines.repeated_line_numbers(df).collect()}
    assert "a0" in found and "m0" in found and "e0" not in found


def test_splitting(spark):
    body = " ".join(f"Sentence {i} of the text ends here." for i in range(120))
    text = f"Head\nintro\nPART One\n{body}\nPart two\nshort"
    df = spark.createDataFrame(
        [("a", text, ["part  one", "missing", "PART TWO", None]), ("b", "x" * 4000, None), ("c", "short", []), ("n", None, None)], "id string, clean_text string, sections array<string>"
    )
    rows = splitting.split_documents(df).collect()
    assert {(r.id, r.section_no) for r in rows if r.section_chars > 1500} == {("a", 1), ("b", 0)}
    for name, whole in (("a", text), ("b", "x" * 4000)):
        got = sorted((r.piece_no, r.start, r.end, r.piece) for r in rows if r.id == name and r.piece is not None)
        assert got[0][1] == 0 and got[-1][2] == len(whole) and all(len(p) <= 1500 and whole[a:b] == p for _, a, b, p in got)
        assert all(0 < x[2] - y[1] <= 300 for x, y in zip(got, got[1:]))
    assert {r.id for r in rows} == {"a", "b"}


def test_long_headings_open_sections():
    heading = "Heading " * 300
    assert [k for k, _ in splitting.section_starts(f"intro\n{heading}\nbody", [heading.strip()])] == [0, 1]


def test_leakage_equals_brute_force(spark):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(400)] + ["été", "नियम"]
    items = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(12)] + [(90, None), (91, "short item")]
    docs = []
    for d in range(60):
        text = [rng.choice(words) for _ in range(rng.randrange(30, 200))]
        if d % 2:
            item = rng.choice(items[:12])[1].split()
            a, n = rng.randrange(0, 15), rng.choice([8, 11, 12, 13, 15])
            at = rng.randrange(len(text))
            text[at:at] = [w.upper() if d % 3 else w for w in item[a : a + n]]
        docs.append((d, ", ".join(text)))
    docs += [(100, None), (101, ""), docs[1]]
    found = leakage.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id) for r in found.where("run_words >= 12").collect()}
    grams = lambda t: {tuple(w[i : i + 12]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(w) - 11)}
    want = {(d, i) for d, t in docs for i, x in items if grams(t) & grams(x)}
    assert got == want and want


def test_leakage_of_tails_equals_brute_force(spark):
    """Only a later part of an item leaked, behind text with other word lengths; and documents that follow each other in a batch."""
    rng = random.Random(4)
    sized = lambda n, k: ["".join(rng.choice("abcdefghij") for _ in range(n)) for _ in range(k)]
    items = [sized(n, 40) + [f"tail{i}x{k}" for k in range(20)] for i, n in enumerate((2, 14) * 4)]
    docs = [(16 * i + m, " ".join([*sized(m, 90), *item[-12:], *sized(m, 5)])) for i, item in enumerate(items) for m in (1, 2, 3, 5, 9, 13)]
    docs += [(900, " ".join(["so", *items[0][:30]])), (901, " ".join([*items[0][30:], "on"]))]
    found = leakage.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id) for r in found.where("run_words >= 12").collect()}
    assert got == {(16 * i + m, i) for i in range(8) for m in (1, 2, 3, 5, 9, 13)} | {(900, 0), (901, 0)}


def test_mix(spark):
    docs = [(i, f"{WORDS[i % 6]} " * (5 + i % 7), "a" if i % 3 else "b", "en") for i in range(300)] + [(900, None, "a", None), (901, "x", "zz", "en")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string")
    goal = spark.createDataFrame([("a", 0.3, 2), ("b", 0.5, 2), ("none", 0.2, 3)], "source string, target_share double, max_repeats int")
    src = spark.createDataFrame([("a", "X"), ("b", "X"), ("none", "Y")], "id string, jurisdiction string")
    used, plan = mixing.mix(df, goal, src)
    rows = {r.source: r for r in mixing.mix_report(used, plan).collect()}
    assert set(rows) == {"a", "b", "none"} and rows["none"].used_tokens == 0 and rows["none"].shortfall_tokens > 0
    assert used.agg(F.max("repeats")).first()[0] <= 2 and used.where("source not in ('a', 'b')").count() == 0
    budget = {r.source: r.budget for r in plan.groupBy("source").agg(F.sum("budget").alias("budget")).collect()}
    assert all(abs(rows[s].used_tokens - budget[s]) <= 40 for s in ("a", "b"))


def test_mix_of_languages(spark):
    """A source in two languages is two leaves; its shortage goes to leaves of its language in its domain; no record is used too often."""
    text = lambda i: " ".join(WORDS[(i + k) % 6] for k in range(20))
    docs = [(i, text(i), "a", "en" if i % 4 else "fr") for i in range(40)] + [(100 + i, text(i), "b", "fr") for i in range(200)] + [(400 + i, text(i), "c", "en") for i in range(200)]
    docs += [docs[0], (999, None, "a", "fr"), (998, "", "b", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string")
    goal = spark.createDataFrame([("a", 0.6, 3), ("b", 0.2, 1), ("c", 0.2, 1)], "source string, target_share double, max_repeats int")
    src = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "X")], "id string, jurisdiction string")
    used, plan = mixing.mix(df, goal, src)
    total = sum(r.tokens for r in plan.collect())
    budget = {(r.source, r.lang): r.budget for r in plan.collect()}
    room = {(r.source, r.lang): r.tokens * r.max_repeats for r in plan.collect()}
    assert abs(budget["a", "en"] - room["a", "en"]) < 1 and abs(budget["a", "fr"] - room["a", "fr"]) < 1
    tokens = {(r.source, r.lang): r.tokens for r in plan.collect()}
    french = tokens["a", "fr"] / (tokens["a", "fr"] + tokens["a", "en"])
    short_fr, short_en = 0.6 * total * french - room["a", "fr"], 0.6 * total * (1 - french) - room["a", "en"]
    assert abs(budget["b", "fr"] - (0.2 * total + short_fr)) < 1 and abs(budget["c", "en"] - min(room["c", "en"], 0.2 * total + short_en)) < 1
    got = {(r.source, r.lang): (r.n, r.m) for r in used.groupBy("source", "lang").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("n"), F.max("repeats").alias("m")).collect()}
    assert all(abs(got[k][0] - budget[k]) <= 40 for k in budget) and got["a", "en"][1] == 3 and got["b", "fr"][1] == 1
    again, _ = mixing.mix(df, goal, src)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, used.collect()))


def test_budgets_fill_siblings_first():
    leaves = [("D", "en", "a", 0.25, 10.0), ("D", "en", "b", 0.25, 100.0), ("D", "fr", "c", 0.25, 100.0), ("E", "en", "d", 0.25, 100.0)]
    got = mixing.budgets(leaves, 100.0)
    assert got == {"a": 10.0, "b": 40.0, "c": 25.0, "d": 25.0}


@pytest.mark.parametrize("bits", [common.FILTER_BITS, 64])
def test_truncation(spark, monkeypatch, bits):
    """A bitmap that everything passes changes no result."""
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    objects = "audit trail|recall plan|fee schedule|board minutes|risk register|model inventory".split("|")
    verbs = "publish|retain|amend|review|sample|archive".split("|")
    full = [f"Notice {i}\n\nThe clearing member shall {v} the {o} without undue delay. The depository may {v} the {p} only in a durable medium." for i, (v, o, p) in enumerate((v, o, p) for v in verbs for o in objects for p in objects)]
    rows = [(i, t, "en") for i, t in enumerate(full)]
    rows += [(1000, full[5][:-24], "en"), (1001, full[9][:-9] + "…", "en"), (1002, full[12][:-31], None), (1003, None, "en"), (1004, " ", "en"), rows[0]]
    got = truncation.truncated_values(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert {r.doc_id for r in got.where("is_cut").collect()} == {1000, 1001, 1002}
    assert got.where("doc_id in (1003, 1004)").count() == 0


def test_truncation_empty(spark):
    assert truncation.truncated_values(spark.createDataFrame([], "doc_id bigint, text string, lang string")).count() == 0


def test_rolling_hash():
    codes = language.np.frombuffer(b"abcabcab", language.np.uint8)
    g = Rolling(codes).grams(3)
    assert g[0] == g[3] and g[1] == g[4] and len(set(g.tolist())) == 3


def test_truncation_thresholds():
    """The thinnest place near the default is taken, the default where nothing is thinner."""
    import numpy as np

    counts = np.full(96, 5.0)
    assert truncation.valley(counts, -2.0) == -2.0
    counts[36:38] = 0  # around -2.75
    assert truncation.valley(counts, -2.0) < -2.0


def test_bit_filter(spark):
    keys = spark.createDataFrame([(k * 0x9E3779B97F4A7C15 % (1 << 63),) for k in range(1, 500)], "key bigint")
    import numpy as np

    own = np.array([r.key for r in keys.collect()], np.int64).view(np.uint64)
    bits = common.bit_filter(keys, 499)
    assert common.may_contain(bits, own).all()
    assert common.may_contain(bits, np.arange(10_000, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).mean() < 0.05
