"""Version 1 interaction records: strict parsing, canonical form, digests and order."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime
from hashlib import sha256

from ..sources.strict_json import canonical, load

KEYS = ("schema_version", "event_id", "user_id", "item_id", "timestamp", "type", "weight")
TYPES = ("view", "click", "like", "hide")
SCHEMA = "schema_version int, event_id string, user_id string, item_id string, occurred_us long, type string, weight double, sha256 string"


@dataclass(frozen=True, order=False)
class Record:
    event_id: str
    user_id: str
    item_id: str
    at: datetime
    type: str
    weight: float

    @property
    def order(self) -> tuple[datetime, str]:
        return self.at, self.event_id

    def canonical(self) -> str:
        stamp = self.at.strftime("%Y-%m-%dT%H:%M:%S") + (f".{self.at.microsecond:06d}" if self.at.microsecond else "") + "+00:00"
        return canonical({"schema_version": 1, "event_id": self.event_id, "user_id": self.user_id, "item_id": self.item_id, "timestamp": stamp, "type": self.type, "weight": self.weight})

    def digest(self) -> str:
        return sha256(self.canonical().encode()).hexdigest()

    def row(self) -> tuple:
        delta = self.at - datetime(1970, 1, 1, tzinfo=UTC)
        return 1, self.event_id, self.user_id, self.item_id, (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds, self.type, self.weight, self.digest()


def parse(line: str) -> Record:
    """Exactly the seven keys, each of its kind; anything else is an error."""
    value = load(line)
    if not isinstance(value, dict) or set(value) != set(KEYS):
        raise ValueError(f"a record has exactly the keys {', '.join(KEYS)}")
    if value["schema_version"] != 1 or isinstance(value["schema_version"], bool):
        raise ValueError("schema_version must be 1")
    for name in ("event_id", "user_id", "item_id"):
        text = value[name]
        if not isinstance(text, str) or not text or text != text.strip() or len(text) > 256 or not text.isprintable():
            raise ValueError(f"{name} must be a trimmed, printable, non-empty string")
    if value["type"] not in TYPES:
        raise ValueError(f"type must be one of {', '.join(TYPES)}")
    weight = value["weight"]
    if isinstance(weight, bool) or not isinstance(weight, int | float) or weight <= 0:
        raise ValueError("weight must be a positive number")
    stamp = value["timestamp"]
    if not isinstance(stamp, str) or not re.search(r"(Z|[+-]\d\d:\d\d)$", stamp):
        raise ValueError("timestamp must have a zone")
    return Record(value["event_id"], value["user_id"], value["item_id"], datetime.fromisoformat(stamp).astimezone(UTC), value["type"], float(weight))


def chain(digests: list[str]) -> str:
    """A digest over digests in log order."""
    now = sha256(b"").hexdigest()
    for d in digests:
        now = sha256((now + d).encode()).hexdigest()
    return now
