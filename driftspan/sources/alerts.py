"""Alert sinks: driver-side receivers of result rows, as dictionaries by feature."""

import json
import logging
import time
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from driftspan.errors import require

Result = dict[str, dict]


def drifting(result: Result) -> Result:
    return {k: v for k, v in result.items() if v.get("drift")}


@dataclass
class Composite:
    """Every sink gets every result."""

    sinks: Sequence

    def send(self, result: Result) -> None:
        for sink in self.sinks:
            sink.send(result)


@dataclass
class ColumnFilter:
    """Passes on drifting columns among `columns`, and nothing if there are none."""

    sink: object
    columns: Sequence[str]

    def send(self, result: Result) -> None:
        if chosen := {k: v for k, v in drifting(result).items() if k in self.columns}:
            self.sink.send(chosen)


@dataclass
class Log:
    logger: str = "driftspan.alerts"
    level: int = logging.WARNING

    def send(self, result: Result) -> None:
        logging.getLogger(self.logger).log(self.level, json.dumps(result, default=str, sort_keys=True))


def post(url: str, payload: dict, timeout: float) -> None:
    request = urllib.request.Request(url, json.dumps(payload, default=str).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout):
        pass


@dataclass
class Webhook:
    """POSTs results as JSON, up to max_retries more times with a fixed wait."""

    url: str
    timeout: float = 5.0
    max_retries: int = 0
    wait: float = 0.5
    transport: Callable[[str, dict, float], None] = post

    def __post_init__(self):
        require(self.timeout > 0 and self.max_retries >= 0 and self.wait >= 0, "timeout must be positive, retries and wait not negative")

    def payload(self, result: Result) -> dict:
        return {"drift": result}

    def send(self, result: Result) -> None:
        for left in range(self.max_retries, -1, -1):
            try:
                return self.transport(self.url, self.payload(result), self.timeout)
            except OSError:
                if not left:
                    raise
                time.sleep(self.wait)


@dataclass
class Slack(Webhook):
    """A line of text for a chat hook."""

    def payload(self, result: Result) -> dict:
        return {"text": "Drift in: " + (", ".join(sorted(drifting(result))) or "no column")}
