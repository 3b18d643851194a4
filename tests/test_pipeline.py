"""Runs, messages, approvals, searches, fetching, settings, clients and the command line."""

import json
import logging
import sys
from datetime import datetime

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docketry import cli, clients, pipeline, settings
from docketry.functions import text as tx
from docketry.operators import classify as cl
from docketry.operators import notify, retrieval, state
from docketry.sources import fetch, registry
from docketry.streaming import jobs
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module


def now():
    return F.lit("2026-06-01 09:30:00").cast("timestamp")


TEXT = (
    "This circular requires immediate implementation of KYC norms. All regulated entities shall comply with the customer due diligence "
    "section forthwith. Non-compliance will attract a penalty of Rs. 10 lakh under the Banking Regulation Act."
)
RAW = "id string, source_id string, jurisdiction string, title string, content string, content_format string, fetched_at timestamp"


def _raw(spark):
    at = lambda h: datetime(2026, 5, 1, h)
    rows = [
        ("a", "s", "RBI", None, f"<html><head><title>Circular on KYC</title></head><body><p>{TEXT}</p></body></html>", "html", at(1)),
        ("b", "s", "RBI", "Copy", TEXT, "text", at(2)),
        ("c", "s", "FDA", "Note", "A short note on filing hours of the office during the coming holiday season.", "text", at(3)),
        ("p", "s", "FDA", "File", "", "pdf", at(4)),
        ("n", None, None, None, None, None, None),
        ("a", "s", "RBI", None, "<p>later delivery</p>", "html", at(9)),
        (None, "s", "RBI", None, "x", "text", at(9)),
    ]
    return spark.createDataFrame([r for r in rows if r[0] != "a" or r[6].hour == 1] + [rows[0]], RAW)


def test_run(spark):
    done = pipeline.run(_raw(spark), "r1", now())
    got = {r.id: (r.outcome, r.matched) for r in done.outcomes.collect()}
    assert got == {"a": ("processed", None), "b": ("duplicate", "a"), "c": ("processed", None), "p": ("unparsed", None), "n": ("unparsed", None)}
    assert done.counters.first().asDict() == {"processed": 2, "duplicates": 1, "errors": 0}
    marks = {}
    for r in done.markers.collect():
        marks.setdefault(r.document_id, []).append(r.stage)
    assert len(marks["a"]) == 9 and marks["a"][-1] == "actions_planned" and marks["b"][-1] == "deduplicated" and marks["p"] == ["fetched"]
    events = {(r.event_type, r.n) for r in done.audit.groupBy("event_type").agg(F.count("*").alias("n")).collect()}
    assert {("document.fetched", 5), ("document.parsed", 2), ("document.classified", 2), ("risk.assessed", 2)} <= events
    level = {r.id: r.risk_level for r in done.documents.collect()}
    assert level["c"] == "low" and level["a"] in ("high", "critical")
    assert {r.status for r in done.approvals.where("document_id = 'a'").collect()} == {"pending"}
    assert done.index.where("document_id = 'a'").count() == 1


def test_second_run_skips_and_knows(spark):
    one = pipeline.run(_raw(spark), "r1", now())
    again = _raw(spark).unionByName(spark.createDataFrame([("z", "s", "RBI", None, TEXT, "text", datetime(2026, 5, 2))], RAW))
    two = pipeline.run(again, "r2", now(), known=one.fingerprints, markers=one.markers)
    got = {r.id: (r.outcome, r.matched) for r in two.outcomes.collect()}
    assert got["a"][0] == got["c"][0] == "skipped" and got["b"] == ("duplicate", "a") and got["z"] == ("duplicate", "a") and got["p"][0] == "unparsed"
    fresh = pipeline.run(again.where("id = 'z'"), "r3", now())  # a backfill knows nothing
    assert fresh.outcomes.first().outcome == "processed"


def test_empty_run(spark):
    done = pipeline.run(spark.createDataFrame([], RAW), "r", now())
    assert done.counters.first().processed == 0 and done.audit.count() == 0 and done.index.count() == 0


def test_pages_of_stored_bytes(spark):
    data = b"%PDF-1.4\n<< /Length 9 >>\nstream\nBT (Stored rule) Tj ET\nendstream"
    raw = spark.createDataFrame([("p", "RBI", None, "", "pdf", "h"), ("q", "RBI", None, "", "pdf", "x")], "id string, jurisdiction string, title string, content string, content_format string, byte_hash string")
    got = {r.id: (r.text, r.title, r.error) for r in pipeline.parse_stored(raw, spark.createDataFrame([("h", data)], "byte_hash string, bytes binary")).collect()}
    assert got["p"] == ("Stored rule", "Stored rule", None) and got["q"][2] == "no text in pdf page"


def _scored(spark, title="Circular on KYC", reference="RBI/2023-24/115", summary=None):
    df = spark.createDataFrame([("a", "RBI", title, TEXT, summary, reference)], "id string, jurisdiction string, title string, clean_text string, summary string, reference_number string")
    s = cl.risk(cl.classify(df))
    s = s.withColumn("rationale", cl.rationale(s))
    return notify.with_actions(s, cl.plan_actions(s, now()))


def test_message(spark):
    r = notify.notification(_scored(spark, summary="In short.")).first()
    lines = r.body.split("\n")
    assert r.subject.startswith("🟠 [HIGH] Circular on KYC") or r.subject.startswith("🔴 [CRITICAL] Circular on KYC")
    assert lines[:3] == ["Document: Circular on KYC", "Jurisdiction: Reserve Bank of India", "Reference: RBI/2023-24/115"]
    assert lines[3].startswith("Risk: ") and "(score: 0." in lines[3] and "Summary: In short." in lines
    assert "  1. [high] Escalate to senior management: Circular on KYC -> Risk Management" in lines or "  1. [urgent] Escalate to senior management: Circular on KYC -> Risk Management" in lines
    bare = notify.notification(_scored(spark, None, "")).first()
    assert "Reference" not in bare.body and bare.subject.endswith("] ")


def test_action_texts_name_the_regulator(spark):
    acts = cl.plan_actions(_scored(spark, None, ""), now()).orderBy("no").collect()
    assert acts[0].title == "Escalate to senior management: Untitled" and "(N/A)" in acts[0].description and "Risk level: HIGH" in acts[0].description or "CRITICAL" in acts[0].description
    assert "from Reserve Bank of India" in acts[1].description


def test_rationale_lines(spark):
    lines = _scored(spark).first().rationale.split("\n")
    assert lines[0].startswith("Risk level: ") and lines[1] == "" and lines[2] == "Urgency signal: immediate (weight: 1.00)" and lines[3] == "Document type: circular (weight: 0.70)"
    assert lines[4].startswith("High-risk keywords detected (weight: 0.") and lines[-2:] == ["Jurisdiction: Reserve Bank of India", "Reference: RBI/2023-24/115"]


def test_summary(spark):
    df = spark.createDataFrame([("a", "RBI", "T", "", "First one. Second! Third? Fourth."), ("b", "RBI", "", None, "...")], "id string, jurisdiction string, title string, reference_number string, clean_text string")
    got = {r.id: r for r in tx.summarize(df).collect()}
    assert got["a"].summary_text == "First one. Second. Third." and got["a"].key_changes == ["First one", "Second", "Third"] and got["a"].headline.startswith("First one")
    assert got["a"].topic_tags == ["first"] and got["b"].summary_text == "\n..." and got["a"].prompt_tokens == 2 + 5 + 5


def test_digest(spark):
    rows = [(f"d{i:02d}", "low" if i else "critical", f"Title {i}", None if i % 2 else "R/1", 1, i) for i in range(13)]
    df = spark.createDataFrame(rows, "id string, risk_level string, title string, reference_number string, n_actions int, ord int")
    count = lambda n: spark.createDataFrame([(n, 2, 1)], "processed bigint, duplicates bigint, errors bigint")
    r = notify.digest(df, count(13), "run7", now(), "ord").first()
    assert r.subject == "Regulatory Digest (2026-06-01 09:30 UTC) - 13 document(s), 2 duplicate(s)"
    lines = r.body.split("\n")
    assert lines[:5] == ["Pipeline run: run7", "Processed: 13 | Duplicates: 2 | Errors: 1", "", "🔴 CRITICAL (1):", "  - Title 0 [R/1] (1 actions)"]
    assert lines[6] == "🟢 LOW (12):" and len(lines) == 6 + 1 + 10 + 1 and lines[-1] == ""
    assert notify.digest(df.limit(0), count(0), "run8", now(), "ord").first().subject == "Pipeline run run8: no new documents"


def test_channels(spark):
    sent = []
    hook = notify.WebhookChannel("http://x", post=lambda url, data: sent.append(json.loads(data)["text"]) or True)
    assert hook.send("S", "B") and sent == ["*S*\n\nB"] and notify.WebhookChannel("http://x", dry_run=True).send("S", "B")

    def down(*_, **__):
        raise OSError("down")

    assert not notify.WebhookChannel("http://x", post=down).send("S", "B") and not notify.MailChannel("h", 1, "f", ["t"], connect=down).send("S", "B")
    assert notify.MailChannel("h", 1, "f", dry_run=True).send("S", "B") and notify.LogChannel().send("S", "B")
    m = spark.createDataFrame([("a", "high", "S", "B", "log"), ("b", "low", "S", "B", "all"), ("c", "low", "S", "B", "slack")], "id string, risk_level string, subject string, body string, channel string")
    routed = {(r.id, r.to_channel) for r in notify.routed(m, ["log", "slack"], "channel").collect()}
    assert routed == {("a", "log"), ("b", "log"), ("b", "slack"), ("c", "slack")}
    assert {r.sent for r in notify.dispatch(m, [notify.LogChannel()]).collect()} == {True}
    assert [c.name for c in notify.channels_of(settings.load_settings(environ={}))] == ["log"]
    assert [c.name for c in notify.channels_of(settings.load_settings(environ={"DOCKETRY_NOTIFICATIONS_SMTP_HOST": "h", "DOCKETRY_NOTIFICATIONS_SLACK_WEBHOOK_URL": "u"}))] == ["slack", "email"]


def test_approvals(spark):
    req = state.approval_requests(_scored(spark), now(), "r1")
    r = req.first()
    assert r.status == "pending" and r.payload.actions[0].owner == "Risk Management" and r.action_count >= 5 and str(r.expires_at) == "2026-06-04 09:30:00"
    assert state.pending_approvals(req, "r1").count() == 1 and state.pending_approvals(req, "r2").count() == 0
    log = spark.createDataFrame([(r.approval_id, "rejected", "x", datetime(2026, 6, 2)), (r.approval_id, "approved", "y", datetime(2026, 6, 3)), ("unknown", "approved", "y", datetime(2026, 6, 3))], "approval_id string, status string, decided_by string, decided_at timestamp")
    done = state.decide(req, log)
    assert done.first().decided_by == "y" and state.is_approved(done).first().approved and not state.is_approved(req).first().approved
    assert state.approval_requests(_scored(spark), now(), threshold="critical", auto=False).count() == (1 if r.risk_level == "critical" else 0)


def test_index_and_search(spark, tmp_path):
    rows = [("a", "s", "RBI", "Ledger rules", "R/1", "ledger rules for banks"), ("b", "s", "RBI", None, None, "fee schedule of funds"), ("c", "t", "FDA", "Ledger", "", "ledger rules for banks"), ("d", "s", "RBI", "x", None, None)]
    p = spark.createDataFrame(rows, "id string, source_id string, jurisdiction string, title string, reference_number string, clean_text string")
    path = f"file://{tmp_path}/index"
    retrieval.upsert_index(spark, path, retrieval.index_documents(p.where("id = 'a'").withColumn("clean_text", F.lit("old words"))))
    retrieval.upsert_index(spark, path, retrieval.index_documents(p))
    index = retrieval.load_index(spark, path)
    assert index.count() == 3 and index.where("item_id = 'a:0'").first().text == "ledger rules for banks"
    asked = spark.createDataFrame([("q", "ledger rules", "RBI")], "query_id string, text string, jurisdiction string")
    assert [r.document_id for r in retrieval.search(asked, index, 5, 0.1).orderBy("place").collect()] == ["a", "c"]
    same = retrieval.search(asked, index, 5, 0.1, same_jurisdiction=True).collect()
    assert [(r.document_id, r.label) for r in same] == [("a", "R/1 [RBI]")]
    assert retrieval.search(asked, index, 5, 0.1, source_id="t").first().document_id == "c"


PAGES = {
    "https://a.example/list": fetch.Answer(200, b'<a href="/notification/1">x</a><a href="/other">y</a><a href="/notification/2">z</a>', {"Content-Type": "text/html"}),
    "https://a.example/notification/1": fetch.Answer(200, "é".encode("latin-1"), {"content-type": "text/plain; charset=latin-1"}),
    "https://a.example/notification/2": fetch.Answer(404),
    "https://f.example/rss": fetch.Answer(200, b"<rss><item><link>https://f.example/n</link></item></rss>", {"Content-Type": "application/rss+xml"}),
    "https://f.example/n": fetch.Answer(200, b"%PDF-1.4"),
    "https://r.example/robots.txt": fetch.Answer(200, b"User-agent: *\nDisallow: /private"),
}


def _get(url, headers, timeout):
    if "down" in url:
        raise OSError("no route")
    return PAGES.get(url, fetch.Answer(404))


def test_fetcher_is_polite():
    clock = [100.0]
    f = fetch.Fetcher(rate_per_sec=2.0, get=_get, sleep=lambda s: clock.__setitem__(0, clock[0] + s), now=lambda: clock[0], chance=lambda: 1.0)
    for _ in range(3):
        f.wait("h")
    f.wait("other")
    assert clock[0] == 101.0
    assert not f.allowed("https://r.example/private/x") and f.allowed("https://r.example/open") and f.allowed("https://down.example/x")
    assert f.pause(0, fetch.Answer(429, headers={"Retry-After": "7"})) == 7.0 and f.pause(2, None) == 2.0
    tries = []
    busy = fetch.Fetcher(get=lambda u, h, t: tries.append(u) or fetch.Answer(503), sleep=lambda s: None, robots=False, retries=2)
    assert busy.fetch("https://x.example/")[0].status == 503 and len(tries) == 3
    assert busy.row("https://x.example/")[5] == "status 503"
    assert fetch.Fetcher(get=_get, sleep=lambda s: None, robots=False).fetch("https://down.example/")[1].startswith("OSError")
    with pytest.raises(ValueError):
        fetch.Fetcher(rate_per_sec=0)


def test_crawl(spark):
    src = lambda i, j, u, t="html", on=True: {"id": i, "name": i, "jurisdiction": j, "url": u, "source_type": t, "enabled": on}
    sources = registry.from_dicts(
        spark,
        [src("a", "RBI", "https://a.example/list"), src("f", "FDA", "https://f.example/rss", "rss"), src("own", "XX", "https://a.example/notification/1"), src("off", "RBI", "https://a.example/list2", on=False), src("dead", "RBI", "https://down.example/")],
    )
    fetcher = fetch.Fetcher(get=_get, sleep=lambda s: None, rate_per_sec=1e6, retries=0)
    got = {(r.source_id, r.url): r for r in fetch.as_raw(fetch.crawl(sources, registry.adapters(spark), fetcher)).collect()}
    assert set(got) == {("a", "https://a.example/notification/1"), ("a", "https://a.example/notification/2"), ("f", "https://f.example/n"), ("own", "https://a.example/notification/1")}
    assert got["a", "https://a.example/notification/1"].text == "é" and got["a", "https://a.example/notification/2"].error == "status 404"
    assert got["f", "https://f.example/n"].content_format == "pdf"


class Pages(fetch.PageSource):
    fetcher = fetch.Fetcher(get=_get, sleep=lambda s: None, retries=0)


def test_page_source(spark):
    fetch.register(spark, Pages)
    rows = spark.read.format("pages").option("urls", "https://f.example/n https://down.example/").load().collect()
    assert {(r.url, r.status) for r in rows} == {("https://f.example/n", 200), ("https://down.example/", None)}


def test_settings(tmp_path):
    (tmp_path / "s.yaml").write_text("app: {env: staging, log_level: DEBUG}\ncrawl: {rate_per_sec: 3}")
    got = settings.load_settings(f"{tmp_path}/s.yaml", {"DOCKETRY_APP_LOG_LEVEL": "ERROR", "DOCKETRY_APP_ENV": " ", "DOCKETRY_APP_DRY_RUN": "yes"}, {"crawl": {"retries": 9}})
    assert (got.app.env, got.app.log_level, got.app.dry_run, got.crawl.rate_per_sec, got.crawl.retries) == ("staging", "ERROR", True, 3, 9)
    assert settings.mask("abcdefgh") == "****efgh" and settings.mask("abc") == "***" and settings.mask(None) is None
    with pytest.raises(ValueError, match="unknown"):
        settings.load_settings(environ={}, overrides={"app": {"nope": 1}})
    with pytest.raises(ValueError, match="KEY"):
        settings.require(None, "KEY")
    line = settings.JsonLines().format(logging.LogRecord("n", logging.INFO, "f", 1, "told %s", ("you",), None))
    assert json.loads(line)["message"] == "told you"


class _Model:
    def __init__(self, reply):
        self.reply = reply

    def complete(self, system, user):
        if self.reply is None:
            raise OSError("down")
        return self.reply


def test_model_clients(spark):
    df = spark.createDataFrame([("a", "FDA", TEXT)], "id string, jurisdiction string, clean_text string")
    reply = '```json\n{"topics": [{"topic": "x", "confidence": 0.2}, {"topic": "y", "confidence": 0.9}], "business_functions": [], "document_type": "order", "urgency": "routine"}\n```'
    got = clients.classify_with(df, _Model(reply), "s").first()
    assert got.by_model and got.primary_topic == "y" and got.doc_type == "order" and ("FDA", 0.5) in [tuple(j) for j in got.jurisdictions]
    for bad in (None, "no json"):
        ruled = clients.classify_with(df, _Model(bad), "s").first()
        assert not ruled.by_model and ruled.primary_topic == "KYC / AML" and ("FDA", 0.5) in [tuple(j) for j in ruled.jurisdictions]
    told = clients.summarize_with(df, _Model('{"headline": "H", "key_changes": ["k"]}'), "s", F.col("clean_text")).first().model_summary
    assert told.headline == "H" and told.key_changes == ["k"]
    asked = []

    def post(url, key, body, timeout):
        asked.append((url, body))
        return {"choices": [{"message": {"content": "ok"}}], "data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}

    model = clients.HostedModel("k", "m", "https://h/v1/", post=post)
    assert model.complete("s", "u" * 60_000) == "ok" and len(asked[0][1]["messages"][1]["content"]) == 50_000 and asked[0][0] == "https://h/v1/chat/completions"
    assert model.embed(["a", "b"]) == [[1.0], [2.0]]
    with pytest.raises(ValueError):
        clients.embedder("hosted")


def test_streams(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x")], "k string, v string").coalesce(1).write.parquet(src)
    step = jobs.once_each(["k"], f"file://{out}")
    jobs.run_available(jobs.read_stream(spark, src), step, checkpoint=f"{tmp_path}/mark")
    spark.createDataFrame([("b", "y"), ("c", "y")], "k string, v string").write.mode("append").parquet(src)
    jobs.run_available(jobs.read_stream(spark, src), step, checkpoint=f"{tmp_path}/mark")
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]

    def fails(batch, no):
        raise RuntimeError("bad batch")

    loop = jobs.run_loop(jobs.read_stream(spark, src), fails, f"{tmp_path}/loop", 0.01)
    loop.processAllAvailable()
    assert loop.isActive
    loop.stop()


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("DOCKETRY_STORAGE_TABLES", f"file://{tmp_path}/tables")
    _raw(spark).write.parquet(f"{tmp_path}/raw")
    assert cli.main(["sources"]) == 0 and "sebi-legal-circulars" in capsys.readouterr().out
    assert cli.main(["status"]) == 0 and "No pipeline runs" in capsys.readouterr().out
    assert cli.main(["run", "--raw", f"{tmp_path}/raw"]) == 0 and "Done: 2 processed, 1 duplicates, 0 errors." in capsys.readouterr().out
    assert cli.main(["run", "--raw", f"{tmp_path}/raw"]) == 0 and "Done: 0 processed, 3 duplicates" in capsys.readouterr().out
    assert cli.main(["status"]) == 0 and "Pending approvals: 1" in capsys.readouterr().out
    assert cli.main(["backfill", "--raw", f"{tmp_path}/raw", "--source", "none"]) == 0 and "Done: 0 processed" in capsys.readouterr().out


def test_golden_score(spark):
    """Worked out by hand from the formulas."""
    text = (
        "All scheduled commercial banks must implement video-KYC for new customer onboarding with immediate effect. Non-compliance will "
        "attract penalty of Rs. 5 crore under Banking Regulation Act. This circular supersedes earlier guidance on the subject."
    )
    df = spark.createDataFrame([("a", "RBI", "Master Direction on KYC", text, "RBI/2023-24/115")], "id string, jurisdiction string, title string, clean_text string, reference_number string")
    s = cl.risk(cl.classify(df))
    r = s.first()
    assert (r.urgency, r.doc_type, r.score, r.risk_level, r.confidence) == ("immediate", "circular", 0.6066, "high", 1.0)
    assert [tuple(f) for f in r.functions] == [("Compliance", 1.0), ("Legal", 1.0), ("Product", 0.5)]
    assert [tuple(t) for t in r.topics] == [("KYC / AML", 0.286)] and tuple(r.jurisdictions[0]) == ("RBI", 1.0)
    acts = cl.plan_actions(s, now()).orderBy("no").collect()
    assert [(a.key, (a.due_date.month, a.due_date.day)) for a in acts] == [("escalation", (6, 2)), ("review", (6, 5)), ("gap_analysis", (6, 7)), ("policy_update", (6, 10)), ("training", (6, 10))]
