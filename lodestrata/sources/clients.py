"""HTTP models: a chat gateway and a compressor, as functions that run next to the rows.

A client can be sent to the executors: it holds settings only, and reads its key from
the environment of the process that calls. Calls of one process are spaced by
`interval` seconds. Lost connections are tried again `retries` times after 2, 4, ...
seconds, busy answers (429 and 5xx) `busy_retries` times after 1, 2, 4, ... up to 60
seconds and a random part of a second.
"""

from __future__ import annotations

import json
import os
import random
import time
import urllib.error
import urllib.request
from dataclasses import dataclass, field
from threading import Lock

#: Answers that may pass later, and the fields of a compressor's reply.
BUSY = (429, 500, 502, 503, 504)
REFINED = ("refined_text", "original_tokens", "refined_tokens", "cached", "fallback", "warnings", "refine_model")

_lock = Lock()
_next: dict[str, float] = {}


class CallError(RuntimeError):
    """A call that failed for good."""


@dataclass(frozen=True)
class Reply:
    """What a model said, and the name it served under."""

    content: str
    served: str


def wait_turn(name: str, interval: float) -> None:
    """Spaces the starts of this process's calls to `name`."""
    if interval > 0:
        with _lock:
            at = max(time.monotonic(), _next.get(name, 0.0))
            _next[name] = at + interval
        time.sleep(max(0.0, at - time.monotonic()))


@dataclass(frozen=True)
class Endpoint:
    url: str
    timeout: float = 120.0
    retries: int = 1
    busy_retries: int = 6
    interval: float = 0.0
    pause: float = 1.0  # seconds that the waits are multiples of
    headers: dict = field(default_factory=dict, hash=False)

    def post(self, path: str, payload: dict, headers: dict | None = None) -> dict:
        """The JSON object that answers a JSON object."""
        body, lost, busy = json.dumps(payload, ensure_ascii=False).encode(), 0, 0
        wait_turn(self.url, self.interval)
        while True:
            request = urllib.request.Request(self.url.rstrip("/") + path, body, {"Content-Type": "application/json", **self.headers, **(headers or {})})
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    found = json.loads(answer.read())
            except urllib.error.HTTPError as e:
                if e.code not in BUSY or busy == self.busy_retries:
                    raise CallError(f"{self.url} answered {e.code}: {e.read()[:300].decode('utf-8', 'replace')}") from e
                busy += 1
                time.sleep(self.pause * (min(60, 2 ** (busy - 1)) + random.random()))
            except (OSError, ValueError) as e:
                if isinstance(e, ValueError):
                    raise CallError(f"{self.url} gave no JSON: {e}") from e
                if lost == self.retries:
                    raise CallError(f"{self.url} cannot be reached: {e}") from e
                lost += 1
                time.sleep(self.pause * 2 * lost)
            else:
                if not isinstance(found, dict):
                    raise CallError(f"{self.url} gave no JSON object")
                return found


@dataclass(frozen=True)
class ChatModel:
    """A prompt's completion by a gateway. The key is read from the environment and never written."""

    endpoint: Endpoint
    model: str
    key_variable: str = "GATEWAY_SERVICE_KEY"

    def __call__(self, prompt: str) -> Reply:
        key = os.environ.get(self.key_variable)
        if not key:
            raise CallError(f"the environment has no {self.key_variable}")
        found = self.endpoint.post("/v1/chat/completions", {"model": self.model, "messages": [{"role": "user", "content": prompt}], "stream": False}, {"Authorization": f"Bearer {key}"})
        try:
            content = found["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as e:
            raise CallError(f"{self.endpoint.url} gave no message: {e}") from e
        return Reply(content, found.get("model") or self.model)


@dataclass(frozen=True)
class Compressor:
    """A text's compression at a level by a sidecar."""

    endpoint: Endpoint
    rewrite: bool = False

    def __call__(self, text: str, level: float) -> Reply:
        found = self.endpoint.post("/refine", {"text": text, "rewrite": self.rewrite, "compress": True, "aggressiveness": level})
        missing = [f for f in REFINED if f not in found]
        if missing:
            raise CallError(f"{self.endpoint.url} left out {missing}")
        return Reply(found["refined_text"], found["refine_model"])


def content(reply: str | Reply) -> str:
    return reply.content if isinstance(reply, Reply) else reply


def served(reply: str | Reply, name: str) -> str:
    return reply.served if isinstance(reply, Reply) else name
