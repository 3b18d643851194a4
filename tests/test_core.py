import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketry.functions import html, kernels, text as tx
from docketry.operators import classify as cl
from docketry.operators import dedup, retrieval, state
from docketry.sources import registry

GOLDEN = (
    "This circular requires immediate implementation. All regulated entities shall comply with KYC norms within 30 days. "
    "Non-compliance will attract penalties of Rs. 10 lakh. Customer due diligence is mandatory under the Banking Regulation Act."
)


def test_html():
    text, title, headings, hrefs = html.parse_html("<title> A &amp; B </title><h1>First</h1><script>x</script><p>One<br/>two</p><h2>Second</h2><a href=' /x '>y</a>")
    assert title == "A & B" and headings == ["First", "Second"] and hrefs == ["/x"]
    assert "x" not in text.split() and "One" in text


def test_links():
    got = kernels.normalize_links("https://a.example/l", ["/p#top", "mailto:x", "https://b.example/", "/p", "/q"])
    assert got == ["https://a.example/p", "https://a.example/q"]
    assert kernels.normalize_links("https://A.example/", ["https://a.example/x", "/y"]) == ["https://A.example/y"]
    assert kernels.normalize_links("https://a.example/", ["/NEWS/1", "/other"], ["/news/"]) == ["https://a.example/NEWS/1"]
    assert len(kernels.normalize_links("https://a.example/", [f"/{i}" for i in range(150)])) == 100


def test_feed():
    assert kernels.parse_feed("<rss><channel><item><link> http://a </link></item></channel></rss>") == ["http://a"]
    item = "<rss><channel><item><link></link><link>http://b</link></item><item><link>http://c</link></item></channel></rss>"
    assert kernels.parse_feed(item) == ["http://c"]
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><link rel="self" href="http://s"/><link href="http://d"/></entry><entry><link rel="self" href="http://e"/></entry></feed>'
    assert kernels.parse_feed(atom) == ["http://d", "http://e"] and kernels.parse_feed(atom.replace(' xmlns="http://www.w3.org/2005/Atom"', "")) == []
    assert kernels.parse_feed("<rss") == [] and kernels.parse_feed(None) == []


def test_mojibake_and_chunks():
    assert kernels.fix_mojibake("the bankâ€™s policy") == "the bank’s policy"
    assert kernels.fix_mojibake(None) is None and kernels.fix_mojibake("ï»¿Title") == "\ufeffTitle" and kernels.fix_mojibake("É agora") == "É agora"
    got = kernels.chunks("word " * 500, 100, 20)
    assert len(got) > 1 and all(len(t) <= 100 for _, t, _, _ in got) and got[1][2] < got[0][3]
    assert kernels.chunks("  ") == []


def test_strip_boilerplate(spark):
    rows = [("a", "Skip to main content\nBody\nPage 3 of 10"), ("b", "a\nb\na\nc\na"), ("c", None), ("d", ""), ("e", "x" * 81 + "\n" + "x" * 81 + "\n" + "x" * 81)]
    got = {r.id: (r.stripped, r.removed) for r in tx.strip_boilerplate(spark.createDataFrame(rows, "id string, t string"), "t").collect()}
    assert got["a"] == ("Body", 2) and got["b"] == ("b\nc", 3) and got["c"] == (None, 0) and got["d"] == ("", 0) and got["e"][1] == 0


def test_html_titles_and_hidden_parts():
    text, title, headings, hrefs = html.parse_html("<svg><title>Icon</title></svg><title>A</title><title>B</title><h2>a<script>no</script>b</h2><!-- <h1>no</h1> --><a href=x&amp;y>1</a><p/>&lt;t&gt; <3")
    assert title == "AB" and headings == ["ab"] and hrefs == ["x&y"] and "no" not in text and "<t> <3" in text
    assert html.parse_html(None) == ("", None, [], []) and html.parse_html("<a href='/q' title='a > b'>z</a>")[3] == ["/q"]


def test_pdf_text():
    import zlib

    page = zlib.compress(b"BT (Rule \\(1\\)) Tj T* [(on ) -20 (ledgers)] TJ ET")
    data = b"%PDF-1.4\n<< /Title (Own title) >>\n<< /Length 9 /Filter /FlateDecode >>\nstream\n" + page + b"\nendstream\n<< /Filter /FlateDecode >>\nstream\nbroken\nendstream"
    assert kernels.parse_pdf(data) == ("Rule (1)\non ledgers", "Own title")
    assert kernels.parse_pdf(b"none") == kernels.parse_pdf(None) == ("", None)


def test_lenient_decode():
    assert kernels.decode_lenient("é".encode("latin-1"), "latin-1") == "é" and kernels.decode_lenient(b"a\xff", "no-such") == "a�" and kernels.decode_lenient(None) is None


def test_fixed_rounds_as_the_binary_value_says(spark):
    values = [0.2825, 0.1465, 0.245, 0.125, 0.375, 0.0, 1.0, 0.9995, 0.5, 0.2675, 12.3456, 0.285]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(tx.fixed("v", 3).alias("a"), tx.fixed("v", 2).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(f"{v:.3f}", f"{v:.2f}") for v in values]


def test_metadata(spark):
    rows = [("Circular RBI/2023-24/115 dated 2024-01-31",), ("Issued on 5th April 2024",), ("on 2024-02-30, then 15/08/2023",), ("January 31, 2024",), ("none",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(tx.reference_number("t").alias("r"), tx.published_date("t").cast("string").alias("d"))
    got = [tuple(r) for r in df.collect()]
    assert got[0] == ("RBI/2023-24/115", "2024-01-31")
    assert [d for _, d in got[1:]] == ["2024-04-05", "2023-08-15", "2024-01-31", None, None]


def test_whitespace_and_hash(spark):
    df = spark.createDataFrame([("a b\r\n\r\n\r\nc​d   e", "The regulation text.", "  the regulation   text.  ")], "a string, b string, c string")
    r = df.select(tx.normalize_whitespace("a").alias("a"), (tx.content_hash("b") == tx.content_hash("c")).alias("same")).first()
    assert r.a == "a b\n\ncd e" and r.same


def test_language(spark):
    rows = [("The bank shall comply with the rules of the act and it is for the public",), ("La banque et les clients des agences dans le pays sur une base",), ("यह नियम बैंक के लिए है",), ("",)]
    df = spark.createDataFrame(rows, "t string").withColumn("w", tx.stop_word_tokens("t"))
    assert [r.x for r in df.select(tx.language("t", "w")["language"].alias("x")).collect()] == ["en", "fr", "hi", "en"]


def test_risk_golden(spark):
    df = spark.createDataFrame([("d", "RBI", "Circular on lending", GOLDEN, None), ("e", "FDA", "t", "General note.", None)], "id string, jurisdiction string, title string, clean_text string, reference_number string")
    rows = {r.id: r for r in cl.risk(cl.classify(df)).collect()}
    d = rows["d"]
    assert d.urgency == "immediate" and d.doc_type == "circular" and d.primary_topic == "KYC / AML"
    assert d.risk_level in ("high", "critical") and d.jurisdictions[0].jurisdiction == "RBI"
    assert rows["e"].risk_level == "low" and rows["e"].doc_type is None
    acts = cl.plan_actions(cl.risk(cl.classify(df)), F.lit("2026-01-01").cast("timestamp")).where("id = 'd'").orderBy("no").collect()
    assert [a.key for a in acts][:4] == ["escalation", "review", "gap_analysis", "policy_update"]
    assert str(acts[0].due_date) == "2026-01-01" or str(acts[0].due_date) == "2026-01-02"
    assert acts[0].title == "Escalate to senior management: Circular on lending" and "(N/A)" in acts[0].description


def test_simhash_forms_agree(spark):
    df = spark.createDataFrame([("a", "one two three four five"), ("b", ""), ("c", None)], "id string, t string")
    native = {r.id: r.simhash for r in dedup.simhash_native(df, "id", "t").collect()}
    assert native["a"] == kernels.simhashes([["one two", "two three", "three four", "four five"]], "md5")[0] and native["b"] == native["c"] == 0


def _sequential(docs, radius=6):
    kept, out = [], {}
    for i, h, s in docs:
        exact = [k for k in kept if k[1] == h]
        near = [(bin((k[2] ^ s) & (2**64 - 1)).count("1"), n, k[0]) for n, k in enumerate(kept)]
        best = min((x for x in near if x[0] <= radius), default=None)
        if exact:
            out[i] = ("exact", exact[0][0])
        elif best:
            out[i] = ("near", best[2])
        else:
            out[i] = ("unique", None)
            kept.append((i, h, s))
    return out


def test_greedy_dedup_equals_loop(spark):
    rng = random.Random(5)
    docs, base = [], [rng.getrandbits(64) for _ in range(12)]
    for i in range(150):
        s = rng.choice(base)
        for b in rng.sample(range(64), rng.randrange(9)):
            s ^= 1 << b
        s -= (s >> 63) << 64
        docs.append((f"d{i:03d}", f"h{s}", s))
    df = spark.createDataFrame([(i, n, h, s) for n, (i, h, s) in enumerate(docs)], "doc_id string, ord int, content_hash string, simhash bigint")
    got = {r.doc_id: (r.kind, r.matched) for r in dedup.greedy_dedup(df).collect()}
    assert got == _sequential(docs)
    pairs = {(r.a, r.b) for r in dedup.near_pairs(df).collect()}
    values = sorted({s for _, _, s in docs})
    want = {(a, b) for n, a in enumerate(values) for b in values[n + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 6}
    assert pairs == want
    for together in (1, 2, 3, 4):
        rows = [(r.a, r.b) for r in dedup.near_pairs(df, together=together).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_greedy_dedup_with_known_documents(spark):
    """Known documents come first and are all indexed, however close they are to each other."""
    known = [("k1", 5, "h1", 0), ("k2", 9, "h2", 1)]
    new = [("n1", 1, "h1", 0), ("n2", 2, "h9", 3), ("n3", 3, "h3", 2**40 - 1), ("n4", 4, "h3", 2**40 - 1), ("n5", 5, "h8", 2**40 - 2)]
    schema = "doc_id string, ord int, content_hash string, simhash bigint"
    got = {r.doc_id: (r.kind, r.matched) for r in dedup.greedy_dedup(spark.createDataFrame(new, schema), known=spark.createDataFrame(known, schema)).collect()}
    assert got == {"n1": ("exact", "k1"), "n2": ("near", "k2"), "n3": ("unique", None), "n4": ("exact", "n3"), "n5": ("near", "n3")}


def test_long_chain_of_near_documents(spark):
    """Each fingerprint is near the one before only; every second one is indexed."""
    chain, value = [], 0
    for i in range(15):
        chain.append((f"d{i:02d}", i, f"h{i}", value))
        for b in range(4):
            value ^= 1 << ((4 * i + b) % 63)
    got = {r.doc_id: r.kind for r in dedup.greedy_dedup(spark.createDataFrame(chain, "doc_id string, ord int, content_hash string, simhash bigint")).collect()}
    assert got == {f"d{i:02d}": "near" if i % 2 else "unique" for i in range(15)}


def test_greedy_dedup_empty(spark):
    df = spark.createDataFrame([], "doc_id string, ord int, content_hash string, simhash bigint")
    assert dedup.greedy_dedup(df).count() == 0


def test_top_k(spark):
    items = spark.createDataFrame([(i, [float(i % 3), 1.0], i % 2) for i in range(9)] + [(9, None, 0)], "item_id bigint, vector array<float>, group int")
    asked = items.where("item_id in (0, 1)").withColumnRenamed("item_id", "query_id")
    got = {(r.query_id, r["rank"]): r.item_id for r in retrieval.top_k(asked, items, 3).collect()}
    assert [got[0, k] for k in (1, 2, 3)] == [0, 3, 6] and [got[1, k] for k in (1, 2, 3)] == [1, 4, 7]
    same = retrieval.top_k(asked, items, 9, same="group").where("query_id = 1")
    assert {r.item_id for r in same.collect()} == {1, 3, 5, 7}


def test_top_k_needs_little_memory():
    """A batch of items against many queries: what a task holds besides its input stays small, and the hits are those of all scores."""
    rng = np.random.default_rng(4)
    q, items = rng.integers(-2, 3, (3000, 8)).astype(float), rng.integers(-2, 3, (4000, 8)).astype(float)
    ids, k = np.array([f"i{n:04d}" for n in rng.permutation(len(items))]), 4
    tracemalloc.start()
    best = retrieval._Best(len(q), k)
    for at in range(0, len(items), retrieval.ITEM_BLOCK):
        best.add(np.arange(len(q)), q, items[at : at + retrieval.ITEM_BLOCK], ids[at : at + retrieval.ITEM_BLOCK])
    asker, found, _ = best.rows(0, len(q))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 < q.shape[0] * items.shape[0] * 8
    for n in range(0, len(q), 100):
        scores = np.round(q[n] @ items.T, retrieval.RANK_DECIMALS)
        assert list(found[asker == n]) == list(ids[np.lexsort((ids, -scores))[:k]])


def test_a_null_group_has_no_items(spark):
    items = spark.createDataFrame([(1, [1.0], None), (2, [1.0], "a")], "item_id bigint, vector array<double>, group string")
    got = retrieval.top_k(items.withColumnRenamed("item_id", "query_id"), items, 2, same="group").collect()
    assert [(r.query_id, r.item_id) for r in got] == [(2, 2)]


def _peak(run):
    tracemalloc.start()
    out = run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_simhash_of_a_batch_needs_little_memory():
    """Of the sequences of a batch only a slice is Python objects at a time."""
    lists = [[f"word{n} word{m}" for m in range(300)] for n in range(2000)]
    batch = pa.array(lists)
    got, peak = _peak(lambda: kernels._by_slices(lambda x: pa.array(kernels.simhashes(x, known=kernels.Hashed("md5"))), pa.int64())(batch))
    assert peak < 80e6 and got.to_pylist()[:3] == kernels.simhashes(lists[:3], "md5").tolist()


def test_simhash_of_long_lists_needs_little_memory():
    """Votes of long lists: no number for each bit of each hash."""
    lists = [[f"word{m % 1000}" for m in range(20_000)] for n in range(20)]
    got, peak = _peak(lambda: kernels.simhashes(lists, "md5"))
    assert peak < 30e6 and got[0] == kernels.simhashes([[f"word{m}" for m in range(1000)]], "md5")[0]


def test_simhash_of_words(spark):
    """Runs of two words made in the worker vote as those made in the JVM."""
    rows = [([],), (None,), (["a"],), (["a", "b"],), (["a", "b", "a", "b", "c"],), (["a", "a"],), ([f"w{i % 7}" for i in range(50)],)]
    df = spark.createDataFrame(rows, "w array<string>")
    both = df.select(kernels.simhash_words_udf(F.col("w"), "md5").alias("a"), kernels.simhash_udf(tx.shingles("w", 2), "md5").alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both] and len({r.a for r in both}) == 6


def test_pairs_of_asked_fingerprints(spark):
    """Only pairs with an asked fingerprint, from its side."""
    rng = random.Random(8)
    values = [rng.getrandbits(62) for _ in range(30)]
    values += [v ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for v in values]
    df = spark.createDataFrame([(v,) for v in values], "simhash bigint")
    every = {(r.a, r.b, r.distance) for r in dedup.near_pairs(df).collect()}
    asked = set(values[10:40])
    got = dedup.near_pairs(df, asked=df.where(F.col("simhash").isin(*asked))).collect()
    assert sorted((r.a, r.b, r.distance) for r in got) == sorted((a, b, d) for x, y, d in every for a, b in ((x, y), (y, x)) if a in asked)


def test_only_cited_documents_are_cut_twice(spark, monkeypatch):
    """An index that is not stored: its vectors are made once, and chunks to cite only for documents with a hit."""
    rows = [(f"d:{n}", "s", "EU", f"title {n}", None, f"text{n} alpha beta") for n in range(20)]
    docs = spark.createDataFrame(rows, "id string, source_id string, jurisdiction string, title string, reference_number string, clean_text string")
    asked = spark.createDataFrame([("q", "text3 alpha", "EU")], "query_id string, text string, jurisdiction string")
    index, cut, make = retrieval.index_documents(docs, hash_name="md5"), [], retrieval.index_documents
    monkeypatch.setattr(retrieval, "index_documents", lambda rows, *args, **kw: cut.append(rows.count()) or make(rows, *args, **kw))
    twice = retrieval.search(asked, index, 2, 0.1, True, hash_name="md5", documents=docs).collect()
    assert cut == [6] and "d:3" in {r.document_id for r in twice}
    assert sorted(twice) == sorted(retrieval.search(asked, index, 2, 0.1, True, hash_name="md5").collect())


def test_state(spark):
    a = spark.createDataFrame([("x", 1, "old"), ("x", 2, "new"), ("y", 1, "only")], "k string, v int, s string")
    assert {r.s for r in state.latest(a, "k", "v").collect()} == {"new", "only"}
    m = spark.createDataFrame([(1, "d", "parsed", "r1"), (2, "e", "parsed", "r2")], "id bigint, document_id string, stage string, run_id string")
    counts = {r.stage: r.n_documents for r in state.stage_counts(m).collect()}
    assert counts["parsed"] == 2 and counts["notified"] == 0 and len(counts) == 10
    assert state.last_run(m).first().run_id == "r2"


def test_registry(spark):
    assert registry.bundled(spark).count() == 6
    row = {"id": "a", "name": "A", "jurisdiction": "RBI", "url": "u", "source_type": "html"}
    with pytest.raises(ValueError, match="duplicate"):
        registry.from_dicts(spark, [row, row | {"id": "A "}])
    adapters = registry.adapters(spark)
    with pytest.raises(ValueError, match="registered"):
        registry.register(adapters, "RBI", ["/x/"])
    more = registry.register(adapters, "NEW", ["/x/"])
    assert more.count() == 5 and registry.register(more, "RBI", ["/y/"], replace=True).where("jurisdiction = 'RBI'").first().patterns == ["/y/"]
    assert registry.get(registry.bundled(spark), " SEBI-legal-circulars").first().crawl_frequency_minutes == 720


def test_store_twice(spark, tmp_path):
    rows = [("a", "s", "RBI", "html", "<p>x"), ("b", "s", "RBI", "html", "<p>x"), ("c", "t", "RBI", "text", "<p>x"), ("d", "t", "RBI", "pdf", None)]
    raw = spark.createDataFrame(rows, "id string, source_id string, jurisdiction string, content_format string, content string")
    for _ in range(2):
        registry.write_store(raw, f"file://{tmp_path}/store")
    assert spark.read.parquet(f"file://{tmp_path}/store").count() == 2


def test_titles_of_all_formats(spark, tmp_path):
    from docketry.plans import queries

    page = "<html><head><title>Own</title></head><body><p>First</p></body></html>"
    rows = [("h", None, page, "html"), ("g", "Given ", page, "html"), ("b", None, "<p>Line</p><p>two</p>", "html"), ("x", "", "<item><title>Feed</title>text</item>", "xml")]
    rows += [("j", None, '\n {"a": 1}', "json"), ("t", "  ", "\nTop\nx", "text"), ("p", "Pdf", "", "pdf"), ("n", "None", None, "html"), ("h", None, page, "html")]
    df = spark.createDataFrame([(*r, "RBI") for r in rows], "id string, title string, content string, content_format string, jurisdiction string")
    df.write.parquet(f"{tmp_path}/raw_documents.parquet")
    got = {r.id: r.resolved_title for r in queries.resolve_title_all(spark, str(tmp_path)).collect()}
    assert got == {"h": "Own", "g": "Given", "b": "Line", "x": "Feed", "j": '{"a": 1}', "t": "Top"}
