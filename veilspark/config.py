"""Settings and errors."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field, fields
from datetime import date

from pyspark.sql import SparkSession

from veilspark.functions import fixed as X


logger = logging.getLogger(__name__)


class EngineError(Exception):
    """Base of all errors of this engine."""


class ConfigurationError(EngineError):
    pass


class TextTooLongError(EngineError):
    pass


class InvalidConfidenceError(EngineError, ValueError):
    pass


class InvalidListEntryError(EngineError, ValueError):
    pass


class UnknownHandleError(EngineError, KeyError):
    """A handle that is unknown, used or expired."""


class ConnectorError(EngineError):
    """A language model's service could not be reached or gave no usable answer."""


class ConnectorKeyError(ConnectorError):
    """The service's key is absent or refused."""


class MissingDependencyError(EngineError):
    pass


class IncomparableSnapshotsError(EngineError):
    pass


@dataclass(frozen=True)
class ConnectorConfig:
    """Which service to ask and the keys of the two protocols; blanks around keys go."""

    provider: str = "chat"
    chat_key: str = field(default="", repr=False)
    messages_key: str = field(default="", repr=False)
    chat_url: str = ""
    messages_url: str = ""
    model: str = ""

    def __post_init__(self):
        if self.provider not in ("chat", "messages"):
            raise ConfigurationError("provider is chat or messages")
        for k in ("chat_key", "messages_key"):
            v = getattr(self, k)
            object.__setattr__(self, k, v.strip() if isinstance(v, str) else "")
        if not self.key:
            logger.warning("no key for %s: requests to it will be skipped", self.provider)

    @property
    def key(self) -> str:
        return self.chat_key if self.provider == "chat" else self.messages_key

    @property
    def has_any_key(self) -> bool:
        return bool(self.chat_key or self.messages_key)

    def connect(self):
        """The connector of these settings; without a key one that gives no answers."""
        from veilspark.sources import llm_connector as c

        if not self.key:
            return c.offline
        return c.chat_completions(self.chat_url, self.key, self.model) if self.provider == "chat" else c.messages(self.messages_url, self.key, self.model)


@dataclass(frozen=True)
class EngineConfig:
    """Engine settings; ``from_spark`` reads overrides from ``veilspark.*`` settings of the session."""

    min_confidence: float = X.MIN_CONFIDENCE
    max_text_length: int = X.MAX_TEXT_LENGTH
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    ttl_seconds: float = X.TTL_SECONDS
    today: date | None = None
    redact_urls: bool = False

    @classmethod
    def from_spark(cls, spark: SparkSession) -> EngineConfig:
        got: dict = {}
        for f in fields(cls):
            v = spark.conf.get(f"veilspark.{f.name}", None)
            if v is None:
                continue
            if f.name in ("allow", "deny"):
                got[f.name] = tuple(json.loads(v))
            elif f.name == "today":
                got[f.name] = date.fromisoformat(v)
            elif f.name == "redact_urls":
                got[f.name] = v.lower() == "true"
            else:
                got[f.name] = type(f.default)(v)
        return cls(**got)

    def day(self) -> date:
        return self.today or date.today()


def threshold(value: float | None, config: EngineConfig | None = None) -> float:
    """A threshold within [0, 1]; none given: the configured one.  Never clipped."""
    value = (config or EngineConfig()).min_confidence if value is None else value
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0.0 <= value <= 1.0:
        raise InvalidConfidenceError("min_confidence must lie within 0 and 1")
    return float(value)
