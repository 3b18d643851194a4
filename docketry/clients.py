"""Language-model clients that a caller plugs in: one HTTP form for chat and embeddings, offline stand-ins otherwise."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import kernels
from .operators import classify as cl

INPUT_CHARS = 50_000  # what a hosted model is given of a text
CLASSIFICATION = "struct<topics:array<struct<topic:string,confidence:double>>,business_functions:array<struct<name:string,relevance:double>>,document_type:string,urgency:string>"
SUMMARY = "struct<headline:string,summary:string,key_changes:array<string>,affected_entities:array<string>,compliance_deadline:string,topic_tags:array<string>>"
_FENCE = r"(?s)^```(?:json)?\n?|\n?```$"


def unfenced(reply: Column) -> Column:
    """A reply without the code fence around it."""
    return F.regexp_replace(F.trim(reply), _FENCE, "")


def parsed_reply(reply: Column, schema: str) -> Column:
    """The reply's JSON as a struct; NULL where it is none."""
    return F.from_json(unfenced(reply), schema, {"mode": "PERMISSIVE"})


def _post(url: str, key: str, body: dict, timeout: float) -> dict:
    request = Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    with urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


@dataclass
class HostedModel:
    """An endpoint with /chat/completions and /embeddings; ``post`` replaces the transport, as in tests."""

    key: str
    model: str
    base_url: str
    temperature: float = 0.2
    timeout: float = 60.0
    post: Callable[[str, str, dict, float], dict] = _post

    def complete(self, system: str, user: str) -> str:
        body = {
            "model": self.model,
            "temperature": self.temperature,
            "response_format": {"type": "json_object"},
            "messages": [{"role": "system", "content": system}, {"role": "user", "content": user[:INPUT_CHARS]}],
        }
        return self.post(f"{self.base_url.rstrip('/')}/chat/completions", self.key, body, self.timeout)["choices"][0]["message"]["content"]

    def embed(self, texts: list[str]) -> list[list[float]]:
        data = self.post(f"{self.base_url.rstrip('/')}/embeddings", self.key, {"model": self.model, "input": texts}, self.timeout)["data"]
        return [row["embedding"] for row in sorted(data, key=lambda row: row["index"])]


def replies(text: Column, client, system: str) -> Column:
    """The client's reply to each text; NULL where the call failed, so that one failure stops no job."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        def ask(t):
            try:
                return client.complete(system, t)
            except Exception:  # noqa: BLE001 - a client may fail in any way
                return None

        return texts.map(ask, na_action="ignore")

    return run(text)


def classify_with(df: DataFrame, client, system: str, text: str = "clean_text", declared: str = "jurisdiction") -> DataFrame:
    """Like ``classify``, by a model; where its reply cannot be read the rules decide, without the declared bonus.

    The declared jurisdiction is put in at 0.5 where it is missing.
    """
    ruled = cl.classify(df.withColumn("__none", F.lit(None).cast("string")), text, "__none").drop("__none")
    asked = ruled.withColumn("__reply", parsed_reply(replies(F.col(text), client, system), CLASSIFICATION))
    ok = F.col("__reply.topics").isNotNull()
    put = {
        "topics": F.when(ok, F.col("__reply.topics")).otherwise(F.col("topics")),
        "functions": F.when(ok, F.coalesce("__reply.business_functions", F.array())).otherwise(F.col("functions")),
        "doc_type": F.when(ok, F.col("__reply.document_type")).otherwise(F.col("doc_type")),
        "urgency": F.when(ok, F.col("__reply.urgency")).otherwise(F.col("urgency")),
        "by_model": ok,
    }
    out = asked.withColumns(put).drop("__reply")
    missing = F.col(declared).isNotNull() & ~F.exists("jurisdictions", lambda j: j["jurisdiction"] == F.col(declared))
    added = F.array(F.struct(F.col(declared).alias("jurisdiction"), F.lit(0.5).alias("confidence")))

    def first(array: str, name: str, value: str) -> Column:
        ranked = F.array_sort(F.transform(array, lambda x, i: F.struct((-x[value]).alias("n"), i.alias("i"), x[name].alias("name"))))
        return F.get(ranked, F.lit(0))["name"]

    return out.withColumns(
        {
            "jurisdictions": F.when(missing, F.concat("jurisdictions", added)).otherwise(F.col("jurisdictions")),
            "primary_topic": first("topics", "topic", "confidence"),
            "primary_function": first("functions", "name", "relevance"),
        }
    )


def summarize_with(df: DataFrame, client, system: str, prompt: Column) -> DataFrame:
    """Adds ``model_summary``, a struct; NULL where the reply cannot be read."""
    return df.withColumn("model_summary", parsed_reply(replies(prompt, client, system), SUMMARY))


def embed_with(text: Column, client) -> Column:
    """Vectors of a hosted model, a request per batch."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(client.embed([t or "" for t in texts]))

    return run(text)


def embedder(provider: str, client=None, dim: int = 256):
    """A function from a text column to a vector column, by the provider's name."""
    if provider == "mock":
        return lambda text: kernels.embed_udf(text, dim)
    if client is None:
        raise ValueError(f"provider {provider!r} needs a client")
    return lambda text: embed_with(text, client)
