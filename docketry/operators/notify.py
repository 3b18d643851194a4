"""Messages about scored documents and runs, their channels, and what was sent already."""

from __future__ import annotations

import json
import logging
import smtplib
from collections.abc import Callable
from dataclasses import dataclass, field
from email.message import EmailMessage
from urllib.request import Request, urlopen

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import fixed, jurisdiction_label, nullif_empty
from .state import missing_from

log = logging.getLogger(__name__)
NAMED = 5  # areas and actions a message names
DIGEST_DOCS = 10  # documents a digest names of each level


def _sign(level: Column) -> Column:
    out = F.lit("❓")
    for name, sign in rules.RISK_SIGNS.items():
        out = F.when(level == name, F.lit(sign)).otherwise(out)
    return out


def with_actions(scored: DataFrame, actions: DataFrame) -> DataFrame:
    """Adds actions, ARRAY<STRUCT<no, title, priority, owner>> in order; a document has eight at most."""
    listed = actions.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("no", "title", "priority", "owner"))).alias("actions"))
    none = F.array().cast("array<struct<no:int,title:string,priority:string,owner:string>>")
    return scored.join(listed, "id", "left").withColumn("actions", F.coalesce("actions", none))


def notification(scored: DataFrame, summary: str = "summary") -> DataFrame:
    """(id, risk_level, subject, body) of one message per document; ``scored`` has its ``actions``."""
    level = F.upper("risk_level")
    action = lambda a, i: F.concat(F.format_string("  %d. [", i + 1), a["priority"], F.lit("] "), F.left(a["title"], F.lit(60)), F.lit(" -> "), a["owner"])
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("Document: "), F.coalesce("title", F.lit(""))),
        F.concat(F.lit("Jurisdiction: "), jurisdiction_label("jurisdiction")),
        F.concat(F.lit("Reference: "), nullif_empty("reference_number")),
        F.concat(F.lit("Risk: "), level, F.lit(" (score: "), fixed("score", 2), F.lit(")")),
        F.concat(F.lit("\nSummary: "), F.left(nullif_empty(summary), F.lit(500))),
        F.when(F.size("impacted_areas") > 0, F.concat(F.lit("\nImpacted areas: "), F.array_join(F.slice("impacted_areas", 1, NAMED), ", "))),
        F.when(
            F.size("actions") > 0,
            F.concat(F.format_string("\nAction items (%d):\n", F.size("actions")), F.array_join(F.transform(F.slice("actions", 1, NAMED), action), "\n")),
        ),
    )
    subject = F.concat(_sign(F.col("risk_level")), F.lit(" ["), level, F.lit("] "), F.left(F.coalesce("title", F.lit("")), F.lit(80)))
    return scored.select("id", "risk_level", subject.alias("subject"), body.alias("body"))


def digest(scored: DataFrame, counters: DataFrame, run_id: str, as_of: Column, *order: str) -> DataFrame:
    """(subject, body): one message about a run; the first documents of each level, in the run's order, are named.

    ``scored`` has n_actions, ``counters`` one row (processed, duplicates, errors).
    """
    place = F.row_number().over(Window.partitionBy("risk_level").orderBy(*order))
    reference = F.coalesce(F.concat(F.lit(" ["), nullif_empty("reference_number"), F.lit("]")), F.lit(""))
    line = F.concat(F.lit("  - "), F.left(F.coalesce("title", F.lit("")), F.lit(50)), reference, F.format_string(" (%d actions)", F.col("n_actions")))
    first = scored.select("risk_level", place.alias("place"), line.alias("line")).where(F.col("place") <= DIGEST_DOCS)
    named = first.groupBy("risk_level").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("rows"))
    rank = F.array_position(F.array(*map(F.lit, rules.RISK_SIGNS)), F.col("risk_level"))
    head = F.concat(_sign(F.col("risk_level")), F.lit(" "), F.upper("risk_level"), F.format_string(" (%d):\n", F.col("n")))
    part = F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n"))
    levels = scored.groupBy("risk_level").agg(F.count("*").alias("n")).join(named, "risk_level").select(rank.alias("rank"), part.alias("part"))
    parts = levels.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), "\n").alias("parts"))  # four rows
    top = F.format_string("Pipeline run: %s\nProcessed: %d | Duplicates: %d | Errors: %d\n\n", F.lit(run_id), "processed", "duplicates", "errors")
    subject = F.concat(
        F.lit("Regulatory Digest ("), F.date_format(as_of, "yyyy-MM-dd HH:mm"), F.format_string(" UTC) - %d document(s), %d duplicate(s)", "processed", "duplicates")
    )
    none = F.col("processed") == 0
    both = counters.join(F.broadcast(parts))  # one row each
    return both.select(
        F.when(none, F.lit(f"Pipeline run {run_id}: no new documents")).otherwise(subject).alias("subject"),
        F.when(none, F.lit("All documents were duplicates or failed processing.")).otherwise(F.concat(top, "parts")).alias("body"),
    )


def unsent(messages: DataFrame, sent: DataFrame) -> DataFrame:
    """Messages not yet sent for their document at this level; each once."""
    return missing_from(messages, sent.select(F.col("document_id").alias("id"), "risk_level"), "id", "risk_level").dropDuplicates(["id", "risk_level"])


def routed(messages: DataFrame, channels: list[str], channel: str = "all") -> DataFrame:
    """A row per message and channel it goes to: its own, or every one for "all"."""
    to = F.col(channel) if channel in messages.columns else F.lit(channel)
    each = messages.withColumn("to_channel", F.explode(F.array(*map(F.lit, channels))))
    return each.where((to == "all") | (to == F.col("to_channel")))


@dataclass
class LogChannel:
    """Writes to the log; what a run without other channels uses."""

    name: str = "log"

    def send(self, subject: str, body: str) -> bool:
        log.info("%s (%d characters)", subject, len(body))
        return True


@dataclass
class WebhookChannel:
    """Posts to a chat webhook."""

    url: str
    dry_run: bool = False
    name: str = "slack"
    timeout: float = 10.0
    post: Callable | None = None

    def send(self, subject: str, body: str) -> bool:
        if self.dry_run:
            return True
        data = json.dumps({"text": f"*{subject}*\n\n{body}"}).encode()
        try:
            if self.post is not None:
                return bool(self.post(self.url, data))
            with urlopen(Request(self.url, data, {"Content-Type": "application/json"}), timeout=self.timeout) as answer:
                return answer.status < 400
        except OSError as failed:
            log.warning("webhook: %s", failed)
            return False


@dataclass
class MailChannel:
    """Sends by SMTP with TLS."""

    host: str
    port: int
    sender: str
    to: list[str] = field(default_factory=list)
    username: str | None = None
    password: str | None = None
    dry_run: bool = False
    name: str = "email"
    connect: Callable = smtplib.SMTP

    def send(self, subject: str, body: str) -> bool:
        if self.dry_run:
            return True
        mail = EmailMessage()
        mail["Subject"], mail["From"], mail["To"] = subject, self.sender, ", ".join(self.to)
        mail.set_content(body)
        try:
            with self.connect(self.host, self.port, timeout=30) as server:
                server.starttls()
                if self.username and self.password:
                    server.login(self.username, self.password)
                server.send_message(mail)
            return True
        except (smtplib.SMTPException, OSError) as failed:
            log.warning("mail: %s", failed)
            return False


def channels_of(settings) -> list:
    """The channels that settings name, else the log."""
    n, dry = settings.notifications, settings.app.dry_run
    out: list = [WebhookChannel(n.slack_webhook_url, dry)] if n.slack_webhook_url else []
    if n.smtp_host:
        out.append(MailChannel(n.smtp_host, n.smtp_port, n.notify_from, list(n.notify_to), n.smtp_username, n.smtp_password, dry))
    return out or [LogChannel()]


def dispatch(messages: DataFrame, channels: list) -> DataFrame:
    """(id, risk_level, channel, subject, sent): sends every message through its channels from the executors.

    Lazy, and a task that is run again sends again: write the result, or use it in ``foreachBatch``
    together with ``unsent`` over the written log.
    """
    by_name = {c.name: c for c in channels}

    def run(frames):
        for frame in frames:
            sent = [by_name[c].send(s, b) for c, s, b in zip(frame["channel"], frame["subject"], frame["body"])]
            yield frame[["id", "risk_level", "channel", "subject"]].assign(sent=sent)

    rows = routed(messages, list(by_name)).select("id", "risk_level", F.col("to_channel").alias("channel"), "subject", "body")
    return rows.mapInPandas(run, "id string, risk_level string, channel string, subject string, sent boolean")
