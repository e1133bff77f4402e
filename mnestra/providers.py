"""Language models and embedders by name: HTTP services, stand-ins that need no network, and what a caller registers.

A name that isn't registered is an error. Without a language model (``none``, the default) what needs one is
refused and what can do without falls back; a stand-in answers only where it is named.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from mnestra.functions.embed import Embedder, HashEmbedder, MockEmbedder
from mnestra.sources import http_models

TASKS = ("extract", "contradict", "resolve", "rerank", "score")


class Provider(Protocol):
    name: str

    def complete(self, task: str, prompt: str) -> str: ...


class MockProvider:
    """Answers by task and by words of the prompt; the same for the same prompt everywhere."""

    name = "mock"

    # The answers that tests of the model rely on.
    _CAKE = "FACT | procedure | 7 | baking | First, preheat the oven\nTRIPLE | First, preheat the oven | next_step | Then, mix the batter\nFACT | procedure | 7 | baking | Then, mix the batter"
    _FACT = "FACT | fact | 8 | rust | Alice likes Rust"
    _MOVED = "CONTRADICTION | [CANDIDATE-1] | Alice moved to New York, so London is outdated."

    def complete(self, task: str, prompt: str) -> str:
        if task == "contradict":
            return self._MOVED if "New York" in prompt and "London" in prompt else "NONE"
        if task == "extract":
            return self._CAKE if "To bake a cake" in prompt else self._FACT
        if task == "resolve":
            entity = prompt.partition('"')[2].partition('"')[0]
            return "PostgreSQL" if entity.startswith("Postgres") and "PostgreSQL" in prompt else entity
        return "Mock response"


class CannedProvider:
    """Answers from a function or from fixed texts by task."""

    name = "canned"

    def __init__(self, answers: dict[str, str] | Callable[[str, str], str]):
        self.answers = answers

    def complete(self, task: str, prompt: str) -> str:
        return self.answers(task, prompt) if callable(self.answers) else self.answers.get(task, "")


class UnknownModelError(LookupError):
    """A name under which nothing is registered."""


class NoModelError(RuntimeError):
    """A language model is needed and none is set."""


class NoProvider:
    """No language model: asking it is an error."""

    name = "none"

    def complete(self, task: str, prompt: str) -> str:
        raise NoModelError(f"{task} needs a language model, and reasoning_provider is none")


def _http(service: str) -> Callable[..., Provider]:
    return lambda model="", **more: http_models.HttpProvider(service, model, **more)


#: Makers by name; a provider's takes the model's name, an embedder's the dimension and the model's name.
PROVIDERS: dict[str, Callable[..., Provider]] = {"none": lambda model="": NoProvider(), "mock": lambda model="": MockProvider(), **{service: _http(service) for service in http_models.SERVICES}}
EMBEDDERS: dict[str, Callable[..., Embedder]] = {"mock": lambda dim, model="": MockEmbedder(dim), "local": lambda dim, model="": HashEmbedder(dim), "openai": lambda dim, model="": http_models.HttpEmbedder("openai", model, dim)}


def register_provider(name: str, make: Callable[..., Provider]) -> None:
    PROVIDERS[name.lower()] = make


def register_embedder(name: str, make: Callable[..., Embedder]) -> None:
    EMBEDDERS[name.lower()] = make


def _made(kind: str, makers: dict, name: str, *args: object) -> object:
    if name.lower() not in makers:
        raise UnknownModelError(f"no {kind} {name!r}; there are {', '.join(sorted(makers))}")
    return makers[name.lower()](*args)


def provider(name: str = "none", model: str = "") -> Provider:
    return _made("provider", PROVIDERS, name, model)


def embedder(name: str = "local", dim: int = 768, model: str = "") -> Embedder:
    return _made("embedder", EMBEDDERS, name, dim, model)


def answers(provider: Provider, task: str, prompt: Callable[[str], str], text: Column) -> Column:
    """A provider's answer to the prompt of each text, asked from the executors batch by batch; null texts aren't asked."""

    @F.arrow_udf("string")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([None if t is None else provider.complete(task, prompt(t)) for t in batch.to_pylist()], pa.string())

    return run(text)


# -- prompts --------------------------------------------------------------------------------
def extract_prompt(session_text: str) -> str:
    return (
        "List what is worth keeping from the session below, one item a line:\n"
        "FACT | fact, procedure, preference or decision | importance 1-10 | tags with commas | statement\n"
        "A relation of the next item goes on a line before it:\nTRIPLE | subject | predicate | object\n"
        "Steps of a procedure are items of their own, tied by the predicate next_step. Leave out what passes soon.\n\n"
        f"Session:\n{session_text}"
    )


def contradict_prompt(fact: str, candidates: list[str]) -> str:
    listed = "\n".join(f"[CANDIDATE-{i}] {c}" for i, c in enumerate(candidates, 1))
    return f"Which stored statements can't be true if the new one is?\nNew: {fact}\nStored:\n{listed}\nFor each: CONTRADICTION | [CANDIDATE-n] | why. If there are none: NONE"


def resolve_prompt(entity: str, known: list[str]) -> str:
    return f'Is "{entity}" another name of one of these?\n' + "\n".join(known) + "\nAnswer with the name to use and nothing else."


def rerank_prompt(query: str, candidates: str, limit: int) -> str:
    return f"Question: {query}\nStored statements:\n{candidates}\nFor each that helps, best first, at most {limit}: SELECTED [n] | why"


def score_prompt(content: str) -> str:
    return f"How much will it matter later to know this, from 1 (trivial) to 10 (vital)? Answer with a number.\n{content}"
