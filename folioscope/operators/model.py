"""An external model as a function from prompts to replies, and what its replies say; a failed call or a reply that cannot be read counts as none.

The library makes no calls by itself unless a ``ModelConfig`` is enabled: ``caller`` then posts to its address. Prompts are
built here in plain words; replies may wrap their JSON in other text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from folioscope.config import ModelConfig

#: A model maps a prompt to a reply, or raises.
Model = Callable[[str], str]

# The categories that a classifying model may answer.
CATEGORIES = ("email", "chat_transcript", "letter", "report", "memo", "legal_document", "news_article", "list", "technical", "corrupted")
KINDS = ("people", "organizations", "locations", "dates")


def caller(config: ModelConfig) -> Model | None:
    """A function that posts a prompt to the configured address and gives the reply's text; None where no model is enabled."""
    if not (config.enabled and config.url):
        return None

    def call(prompt: str) -> str:
        import urllib.request

        body = json.dumps({"model": config.model, "prompt": prompt, "stream": False}).encode()
        request = urllib.request.Request(config.url, body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=config.timeout_s) as reply:
            text = reply.read().decode("utf-8", "replace")
        try:
            return str(json.loads(text)["response"])
        except (ValueError, KeyError, TypeError):
            return text

    return call


def answer(model: Model, prompt: str, retries: int = 1) -> dict | list | None:
    """The JSON of a model's reply, or None if every call fails or holds none."""
    for _ in range(retries + 1):
        try:
            got = json_in(model(prompt))
        except Exception:
            continue
        if got is not None:
            return got
    return None


def json_in(reply: str | None) -> dict | list | None:
    """The first JSON object or array in a text: the whole of it, a fenced part, or what a bracket begins."""
    if not reply:
        return None
    decode = json.JSONDecoder().raw_decode
    for m in re.finditer(r"[{\[]", reply):
        try:
            return decode(reply, m.start())[0]
        except ValueError:
            continue
    return None


def classifier(model: Model) -> Callable[[list[str]], list[tuple[str, float, str] | None]]:
    """A scorer for ``classify.hybrid``: (category, confidence, reasoning) of each text; other categories and confidences out of 0 to 1 count as no answer."""

    def score(texts: list[str]) -> list[tuple[str, float, str] | None]:
        out = []
        for t in texts:
            got = answer(model, f"Which kind of document is this? Answer as JSON with category (one of {', '.join(CATEGORIES)}), confidence (0 to 1) and reasoning.\n\n{t}")
            try:
                category, confidence = str(got["category"]).strip().lower(), float(got["confidence"])
                out.append((category, confidence, str(got.get("reasoning", ""))) if category in CATEGORIES and 0 <= confidence <= 1 else None)
            except (TypeError, KeyError, ValueError, AttributeError):
                out.append(None)
        return out

    return score


def extractor(model: Model) -> Callable[[list[str]], list[list[tuple[str, str]] | None]]:
    """An extractor for ``entities.by_model``: (kind, name) pairs of each text; entries that are no text are left out."""

    def extract(texts: list[str]) -> list[list[tuple[str, str]] | None]:
        out = []
        for t in texts:
            got = answer(model, f"Name the {', '.join(KINDS)} in this text. Answer as JSON with one list for each kind.\n\n{t}")
            out.append([(kind, x.strip()) for kind in KINDS for x in (got.get(kind) or ()) if isinstance(x, str) and x.strip()] if isinstance(got, dict) else None)
        return out

    return extract


def validator(model: Model) -> Callable[[str, str, str | None], bool]:
    """Whether a name is an entity of its type in its context; no answer keeps it."""

    def valid(name: str, kind: str, context: str | None) -> bool:
        got = answer(model, f"Is {name!r} the name of a {kind} in this context? Answer as JSON with valid (true or false).\n\n{context or ''}")
        return bool(got.get("valid", True)) if isinstance(got, dict) else True

    return valid


def reviewer(model: Model, sure: float = 0.8) -> Callable[[str, str, str | None, str | None], tuple[bool, str]]:
    """A decision for ``canonical.reviewed``: merge only if the model says so with at least ``sure``."""

    def decide(first: str, second: str, context1: str | None, context2: str | None) -> tuple[bool, str]:
        got = answer(model, f"Do these two names stand for the same entity? Answer as JSON with should_merge, confidence (0 to 1) and reasoning.\n\n1: {first} ({context1 or 'no context'})\n2: {second} ({context2 or 'no context'})")
        if not isinstance(got, dict) or "should_merge" not in got:
            return False, "error: no answer"
        try:
            confidence = float(got.get("confidence", 0.0))
        except (TypeError, ValueError):
            confidence = 0.0
        return got["should_merge"] is True and confidence >= sure, str(got.get("reasoning", ""))

    return decide
