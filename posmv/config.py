"""Settings: defaults, then a properties file, then --key value arguments; the last one wins."""

from __future__ import annotations

from collections.abc import Mapping

DEFAULTS: dict[str, str] = {
    "pipeline.mode": "dataframe",
    "dedup.enabled": "true",
    "dedup.state.ttl.ms": "3600000",
    "position.emit.interval.ms": "500",
    "mv.emit.interval.ms": "1000",
    "positions.only": "false",
    "single.output": "false",
    "price.salt.factor": "1",
    "price.mode": "strict",
    "price.conflate.ms": "0",
    "sink.delivery.guarantee": "exactly-once",
    "null.key.sentinel": "?",
    "validate.lag.ms": "2000",
    "state.partitions": "4",
}
#: Older names that count where the newer one is not set.
FALLBACKS = {"position.emit.interval.ms": "emit.interval.ms", "mv.emit.interval.ms": "mv.reval.interval.ms", "price.salt.conflate.ms": "mv.emit.interval.ms"}
GUARANTEES = ("exactly-once", "at-least-once", "none")


class Config:
    def __init__(self, given: Mapping[str, str] | None = None):
        self.given = dict(given or {})

    @classmethod
    def load(cls, args: list[str], platform: Mapping[str, str] | None = None) -> Config:
        """platform properties < the file named by --config < --key value; a key without a value is true."""
        named: dict[str, str] = {}
        i = 0
        while i < len(args):
            if not args[i].startswith("--"):
                raise ValueError(f"expected --key, found {args[i]!r}")
            key = args[i][2:]
            if i + 1 < len(args) and not args[i + 1].startswith("--"):
                named[key] = args[i + 1]
                i += 2
            else:
                named[key] = "true"
                i += 1
        held = dict(platform or {})
        if path := named.pop("config", None):
            held |= read_properties(path)
        return cls(held | named)

    def get(self, key: str, default: str | None = None) -> str | None:
        if key in self.given:
            return self.given[key].strip()
        if (older := FALLBACKS.get(key)) and (older in self.given or older in FALLBACKS):
            found = self.get(older)
            if found is not None:
                return found
        return default if default is not None else DEFAULTS.get(key)

    def int(self, key: str, default: int | None = None) -> int:
        return int(self.get(key, None if default is None else str(default)))

    def float(self, key: str, default: float | None = None) -> float:
        return float(self.get(key, None if default is None else str(default)))

    def bool(self, key: str, default: bool | None = None) -> bool:
        return self.get(key, None if default is None else str(default)).lower() == "true"

    def guarantee(self) -> str:
        found = self.get("sink.delivery.guarantee").lower()
        if found not in GUARANTEES:
            raise ValueError(f"sink.delivery.guarantee is {found!r}; one of {', '.join(GUARANTEES)} is expected")
        return found

    def prefixed(self, prefix: str) -> dict[str, str]:
        """Options that are passed through, their prefix removed."""
        return {k[len(prefix) :]: v for k, v in self.given.items() if k.startswith(prefix)}


def read_properties(path: str) -> dict[str, str]:
    found = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            line = line.strip()
            if line and line[0] not in "#!":
                key, _, value = line.partition("=")
                found[key.strip()] = value.strip()
    return found
