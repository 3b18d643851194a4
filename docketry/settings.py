"""Settings of a run: given values before environment variables before a YAML file before defaults."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, field, fields, is_dataclass

PREFIX = "DOCKETRY_"


@dataclass
class AppSettings:
    env: str = "development"
    log_level: str = "INFO"
    log_format: str = "console"
    dry_run: bool = False


@dataclass
class StorageSettings:
    tables: str | None = None  # folder of the engine's own tables, one all executors share


@dataclass
class ModelSettings:
    provider: str = "mock"
    embedding_provider: str = "mock"
    base_url: str = "https://api.openai.com/v1"
    model: str = "gpt-4o-mini"
    embedding_model: str = "text-embedding-3-small"
    api_key: str | None = None


@dataclass
class CrawlSettings:
    agent: str = "docketry"
    rate_per_sec: float = 1.0
    timeout: float = 30.0
    retries: int = 3
    backoff: float = 0.5
    robots: bool = True


@dataclass
class NotificationSettings:
    slack_webhook_url: str | None = None
    smtp_host: str | None = None
    smtp_port: int = 587
    smtp_username: str | None = None
    smtp_password: str | None = None
    notify_from: str = "docketry@localhost"
    notify_to: list[str] = field(default_factory=list)


@dataclass
class Settings:
    app: AppSettings = field(default_factory=AppSettings)
    storage: StorageSettings = field(default_factory=StorageSettings)
    models: ModelSettings = field(default_factory=ModelSettings)
    crawl: CrawlSettings = field(default_factory=CrawlSettings)
    notifications: NotificationSettings = field(default_factory=NotificationSettings)


SECRETS = ("api_key", "slack_webhook_url", "smtp_password")


def merged(base: dict, more: dict) -> dict:
    """``base`` with ``more`` laid over it, dictionaries within dictionaries too."""
    out = dict(base)
    for key, value in more.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def mask(secret: str | None) -> str | None:
    """All but the last four characters hidden; a short secret wholly."""
    if secret is None:
        return None
    return "*" * len(secret) if len(secret) <= 4 else "*" * (len(secret) - 4) + secret[-4:]


def require(value: str | None, name: str) -> str:
    if not value:
        raise ValueError(f"{name} is not set")
    return value


def _cast(kind: str, value):
    if not isinstance(value, str):
        return value
    if kind == "bool":
        return value.strip().lower() in ("1", "true", "yes", "on")
    if kind.startswith("list"):
        return [x.strip() for x in value.split(",") if x.strip()]
    return {"int": int, "float": float}.get(kind, str)(value)


def _of_environment(environ) -> dict:
    """DOCKETRY_<SECTION>_<FIELD>; empty values count as unset."""
    out: dict = {}
    for section in fields(Settings):
        for f in fields(section.default_factory):
            value = environ.get(f"{PREFIX}{section.name}_{f.name}".upper(), "").strip()
            if value:
                out.setdefault(section.name, {})[f.name] = value
    return out


def load_settings(yaml_file: str | None = None, environ=None, overrides: dict | None = None) -> Settings:
    layers: dict = {}
    if yaml_file is not None:
        import yaml

        with open(yaml_file, encoding="utf-8") as f:
            layers = yaml.safe_load(f) or {}
        if not isinstance(layers, dict):
            raise ValueError("a settings file holds a mapping")
    layers = merged(merged(layers, _of_environment(os.environ if environ is None else environ)), overrides or {})
    parts = {}
    for section in fields(Settings):
        kinds = {f.name: str(f.type) for f in fields(section.default_factory)}
        given = layers.pop(section.name, None) or {}
        if unknown := set(given) - set(kinds):
            raise ValueError(f"unknown settings in {section.name}: {', '.join(sorted(unknown))}")
        parts[section.name] = section.default_factory(**{k: _cast(kinds[k], v) for k, v in given.items()})
    if layers:
        raise ValueError(f"unknown sections: {', '.join(sorted(layers))}")
    return Settings(**parts)


def shown(settings) -> dict:
    """Settings as a dictionary with secrets masked."""
    return {f.name: shown(v) if is_dataclass(v := getattr(settings, f.name)) else mask(v) if f.name in SECRETS else v for f in fields(settings)}


class JsonLines(logging.Formatter):
    """A log record as one line of JSON."""

    def format(self, record: logging.LogRecord) -> str:
        import json

        row = {"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        return json.dumps(row | ({"error": self.formatException(record.exc_info)} if record.exc_info else {}), ensure_ascii=False)


def configure_logging(level: str = "INFO", form: str = "console") -> None:
    """Console lines or JSON lines on the root logger; calling it again replaces the handler."""
    handler = logging.StreamHandler()
    handler.setFormatter(JsonLines() if form == "json" else logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
    logging.basicConfig(level=level.upper(), handlers=[handler], force=True)
