"""Language models and embedders behind public HTTP interfaces, with nothing but the standard library.

Keys come from the environment, on the machine that asks: scoring asks from executors, all else from the driver.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

MOST_TOKENS = 4096


@dataclass(frozen=True)
class Service:
    """How a service is asked: address, key variable, model, headers, and the shapes of question and answer."""

    base: str
    path: str
    key: str
    model: str
    headers: Callable[[str], dict[str, str]]
    body: Callable[[str, str], dict]
    text: Callable[[dict], str]


# The published addresses, headers and fields of each interface.
SERVICES = {
    "openai": Service(
        "https://api.openai.com", "/v1/chat/completions", "OPENAI_API_KEY", "gpt-4o-mini",
        lambda key: {"Authorization": f"Bearer {key}"},
        lambda model, prompt: {"model": model, "max_tokens": MOST_TOKENS, "messages": [{"role": "user", "content": prompt}]},
        lambda out: out["choices"][0]["message"]["content"],
    ),
    "anthropic": Service(
        "https://api.anthropic.com", "/v1/messages", "ANTHROPIC_API_KEY", "claude-3-5-sonnet-latest",
        lambda key: {"x-api-key": key, "anthropic-version": "2023-06-01"},
        lambda model, prompt: {"model": model, "max_tokens": MOST_TOKENS, "messages": [{"role": "user", "content": prompt}]},
        lambda out: "".join(part.get("text", "") for part in out["content"]),
    ),
    "google": Service(
        "https://generativelanguage.googleapis.com", "/v1beta/models/{model}:generateContent", "GOOGLE_API_KEY", "gemini-1.5-flash",
        lambda key: {"x-goog-api-key": key},
        lambda model, prompt: {"contents": [{"parts": [{"text": prompt}]}]},
        lambda out: "".join(part.get("text", "") for part in out["candidates"][0]["content"]["parts"]),
    ),
}
EMBEDDING_MODEL = "text-embedding-3-small"

#: Answers after which it makes sense to ask again.
_AGAIN = (408, 409, 429, 500, 502, 503, 504, 529)


class ServiceError(RuntimeError):
    pass


def ask(url: str, headers: dict[str, str], body: dict, timeout: float = 60.0, tries: int = 3) -> dict:
    """The JSON answer to a JSON question; busy services are asked again, a little later each time."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers}, method="POST")
    for n in range(tries):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if e.code not in _AGAIN or n + 1 == tries:
                raise ServiceError(f"{url}: {e.code} {e.read()[:500].decode(errors='replace')}") from None
        except (urllib.error.URLError, TimeoutError) as e:
            if n + 1 == tries:
                raise ServiceError(f"{url}: {e}") from None
        time.sleep(0.5 * 2**n)
    raise ServiceError(url)


def _key(service: Service) -> str:
    if not (key := os.environ.get(service.key)):
        raise ServiceError(f"{service.key} is not set")
    return key


class HttpProvider:
    """A language model of one of ``SERVICES``."""

    def __init__(self, service: str, model: str = "", base: str | None = None):
        self.name = service
        self.model = model or SERVICES[service].model
        self.base = base or SERVICES[service].base

    def complete(self, task: str, prompt: str) -> str:
        service = SERVICES[self.name]
        answer = ask(self.base + service.path.format(model=self.model), service.headers(_key(service)), service.body(self.model, prompt))
        try:
            return service.text(answer)
        except (KeyError, IndexError, TypeError):
            raise ServiceError(f"{self.name}: an answer without text") from None


class HttpEmbedder:
    """An embedding model; texts are sent together, empty ones get zeros without being sent."""

    distinct = True

    def __init__(self, service: str, model: str = "", dim: int = 768, base: str | None = None, batch: int = 256):
        self.service, self.model, self.dim, self.batch = service, model or EMBEDDING_MODEL, dim, batch
        self.base = base or SERVICES[service].base

    def embed_batch(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), "f4")
        full = [i for i, t in enumerate(texts) if t]
        service = SERVICES[self.service]
        for s in range(0, len(full), self.batch):
            at = full[s : s + self.batch]
            answer = ask(f"{self.base}/v1/embeddings", service.headers(_key(service)), {"model": self.model, "input": [texts[i] for i in at], "dimensions": self.dim})
            rows = sorted(answer["data"], key=lambda r: r["index"])
            if len(rows) != len(at) or any(len(r["embedding"]) != self.dim for r in rows):
                raise ServiceError(f"{self.service}: not {len(at)} embeddings of {self.dim} components")
            out[at] = [r["embedding"] for r in rows]
        return out
