"""Generators of SQL: a protocol, a client of chat-completion servers, retries, and replay of given answers.

``template`` has statements made from links alone.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Protocol

from ..functions.sqltext import clean_generated

FALLBACK = "SELECT 1"


class SqlGenerator(Protocol):
    def generate(self, prompt: str) -> str: ...


@dataclass
class Usage:
    """What a generator has used so far."""

    calls: int = 0
    prompt_tokens: int = 0
    answer_tokens: int = 0

    def add(self, prompt: int, answer: int) -> None:
        self.calls, self.prompt_tokens, self.answer_tokens = self.calls + 1, self.prompt_tokens + prompt, self.answer_tokens + answer


def about_tokens(text: str) -> int:
    """Tokens of a text by rule of thumb, four characters each, for servers that do not count."""
    return -(-len(text) // 4)


class TooMany(Exception):
    """The server asks to wait: ``after`` seconds, or None."""

    def __init__(self, after: float | None = None) -> None:
        super().__init__("too many requests")
        self.after = after


#: (URL, headers, body, timeout) to the decoded answer; TooMany for status 429.
Transport = Callable[[str, dict[str, str], dict[str, Any], float], dict[str, Any]]


def post_json(url: str, headers: dict[str, str], body: dict[str, Any], timeout: float) -> dict[str, Any]:
    """One POST by the standard library."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as e:
        if e.code == 429:
            after = e.headers.get("Retry-After", "")
            raise TooMany(float(after) if after.replace(".", "", 1).isdigit() else None) from e
        raise


class ChatGenerator:
    """Asks a server that speaks the chat-completion protocol.  Failures are repeated with growing pauses, a 429 after the pause
    that the server names; the last failure gives the fallback.  Answers come cleaned; ``raw`` has them as they are."""

    def __init__(self, url: str, model: str, key: str = "", system: str = "You write SQL queries.", most_tokens: int = 512, temperature: float = 0.0, timeout: float = 60.0, attempts: int = 3, pause: float = 1.0, longest_pause: float = 60.0, transport: Transport = post_json, sleep: Callable[[float], None] = time.sleep) -> None:
        self.url, self.model, self.system = url, model, system
        self.headers = {"Authorization": f"Bearer {key}"} if key else {}
        self.most_tokens, self.temperature, self.timeout = most_tokens, temperature, timeout
        self.attempts, self.pause, self.longest_pause = attempts, pause, longest_pause
        self.transport, self.sleep = transport, sleep
        self.usage, self.errors = Usage(), 0

    def raw(self, prompt: str) -> str | None:
        """The answer's text, or None if all attempts fail."""
        body = {"model": self.model, "messages": [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}], "max_tokens": self.most_tokens, "temperature": self.temperature}
        for k in range(self.attempts):
            wait = self.pause * 2**k
            try:
                answer = self.transport(self.url, self.headers, body, self.timeout)
                text = answer["choices"][0]["message"]["content"] or ""
                used = answer.get("usage") or {}
                self.usage.add(used.get("prompt_tokens", about_tokens(self.system + prompt)), used.get("completion_tokens", about_tokens(text)))
                return text
            except TooMany as e:
                wait = wait if e.after is None else e.after
            except (OSError, ValueError, LookupError, TypeError):
                pass
            self.errors += 1
            if k + 1 < self.attempts:
                self.sleep(min(wait, self.longest_pause))
        return None

    def generate(self, prompt: str) -> str:
        text = self.raw(prompt)
        return FALLBACK if text is None else clean_generated(text)


class ReplayGenerator:
    """Answers by the question that a prompt ends with; what it does not know gets the fallback."""

    def __init__(self, answers: dict[str, str | list[str]]) -> None:
        self.answers = {k: [v] if isinstance(v, str) else list(v) for k, v in answers.items()}
        self.used: dict[str, int] = {}
        self.usage = Usage()

    def generate(self, prompt: str) -> str:
        asked = [q for q in self.answers if q in prompt]
        answer = FALLBACK
        if asked:
            q = max(asked, key=len)
            k = self.used.get(q, 0)
            self.used[q] = k + 1
            answer = self.answers[q][min(k, len(self.answers[q]) - 1)]
        self.usage.add(about_tokens(prompt), about_tokens(answer))
        return clean_generated(answer)


class RetryingGenerator:
    """Repeats a failing generator with growing pauses, then gives the fallback."""

    def __init__(self, inner: SqlGenerator, attempts: int = 3, pause: float = 1.0) -> None:
        self.inner, self.attempts, self.pause = inner, attempts, pause

    def generate(self, prompt: str) -> str:
        for k in range(self.attempts):
            try:
                return clean_generated(self.inner.generate(prompt))
            except Exception:
                if k + 1 < self.attempts:
                    time.sleep(self.pause * 2**k)
        return FALLBACK
