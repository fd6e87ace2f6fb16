"""Language-model clients and the wrappers around them: budgets, rate limits, a cache. They work in a worker's process as on the driver."""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping, MutableMapping, Sequence
from dataclasses import dataclass, field, replace

from marlstone.plans.dag import Retry
from marlstone.plans.errors import AdapterError, BudgetExceeded, RateLimited
from marlstone.streaming.windows import SPAN

Message = tuple[str, str]  # role, text


@dataclass(frozen=True)
class Usage:
    """Sums of calls; cached only if all of them were."""

    tokens_in: int = 0
    tokens_out: int = 0
    cost: float = 0.0
    cached: bool = False

    def __add__(self, o: Usage) -> Usage:
        return Usage(self.tokens_in + o.tokens_in, self.tokens_out + o.tokens_out, self.cost + o.cost, self.cached and o.cached)


@dataclass(frozen=True)
class Completion:
    text: str
    usage: Usage = Usage()


@dataclass
class ScriptedModel:
    """A stand-in: replies in turn, then a handler, then an echo of the last message."""

    replies: list[str] = field(default_factory=list)
    handler: Callable[[Sequence[Message]], str] | None = None
    calls: list[Sequence[Message]] = field(default_factory=list)

    def complete(self, messages: Sequence[Message], temperature: float = 0.0, max_tokens: int | None = None) -> Completion:
        self.calls.append(messages)
        text = self.replies.pop(0) if self.replies else self.handler(messages) if self.handler else messages[-1][1]
        return Completion(text, Usage(sum(len(t) for _, t in messages) // 4, len(text) // 4))


@dataclass(frozen=True)
class Provider:
    style: str  # openai or anthropic
    base_url: str
    model: str
    key: str = field(default="", repr=False)


_SHORTCUTS = {"OPENAI_API_KEY": ("openai", "https://api.openai.com/v1"), "ANTHROPIC_API_KEY": ("anthropic", "https://api.anthropic.com/v1"), "GROQ_API_KEY": ("openai", "https://api.groq.com/openai/v1"), "MISTRAL_API_KEY": ("openai", "https://api.mistral.ai/v1"), "OPENROUTER_API_KEY": ("openai", "https://openrouter.ai/api/v1"), "TOGETHER_API_KEY": ("openai", "https://api.together.xyz/v1"), "DEEPSEEK_API_KEY": ("openai", "https://api.deepseek.com/v1")}


def settings(path: str | None = None, environ: Mapping[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines of a file, one pair of quotes around a value removed, under the environment."""
    out: dict[str, str] = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in map(str.strip, f):
                if line and not line.startswith("#") and "=" in line:
                    k, v = (x.strip() for x in line.split("=", 1))
                    out[k] = v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v
    out.update(os.environ if environ is None else environ)
    return {k: v for k, v in out.items() if v.strip()}


def resolve(given: Mapping[str, str] | None = None, env: Mapping[str, str] | None = None) -> Provider:
    """Arguments before MARLSTONE_* settings before the keys of known providers."""
    env, given = settings() if env is None else env, dict(given or {})
    for name in ("style", "base_url", "model", "key"):
        if name not in given and (v := env.get(f"MARLSTONE_{name.upper()}")):
            given[name] = v
    if "base_url" not in given:
        for k, (style, url) in _SHORTCUTS.items():
            if k in env:
                given = {"style": style, "base_url": url, "key": env[k], **given}
                break
    if "base_url" not in given or "model" not in given:
        raise AdapterError("no provider: a base url and a model are needed")
    return Provider(given.get("style", "openai"), given["base_url"], given["model"], given.get("key", ""))


def post(url: str, headers: Mapping[str, str], body: bytes, timeout: float = 60.0) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, dict(headers)), timeout=timeout) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()
    except OSError as e:
        raise AdapterError(str(e)) from e


@dataclass
class HttpModel:
    provider: Provider
    transport: Callable[[str, Mapping[str, str], bytes], tuple[int, bytes]] = post

    def complete(self, messages: Sequence[Message], temperature: float = 0.0, max_tokens: int | None = None) -> Completion:
        p = self.provider
        if p.style == "anthropic":
            url, headers = f"{p.base_url}/messages", {"x-api-key": p.key, "anthropic-version": "2023-06-01"}
            body = {"model": p.model, "max_tokens": max_tokens or 1024, "temperature": temperature, "system": "\n".join(t for r, t in messages if r == "system"), "messages": [{"role": r, "content": t} for r, t in messages if r != "system"]}
        else:
            url, headers = f"{p.base_url}/chat/completions", {"Authorization": f"Bearer {p.key}"} if p.key else {}
            body = {"model": p.model, "temperature": temperature, "messages": [{"role": r, "content": t} for r, t in messages], **({"max_tokens": max_tokens} if max_tokens else {})}
        status, raw = self.transport(url, {**headers, "Content-Type": "application/json"}, json.dumps(body).encode())
        if status in (429, 500, 502, 503, 504, 529):
            raise RateLimited(f"status {status}")
        if status != 200:
            raise AdapterError(f"status {status}")
        try:
            got = json.loads(raw)
            if p.style == "anthropic":
                text, stop, used = "".join(x.get("text", "") for x in got["content"]), got.get("stop_reason"), got.get("usage", {})
                usage = Usage(used.get("input_tokens", 0), used.get("output_tokens", 0))
            else:
                choice, used = got["choices"][0], got.get("usage") or {}
                text, stop = choice["message"].get("content") or "", choice.get("finish_reason")
                usage = Usage(used.get("prompt_tokens", 0), used.get("completion_tokens", 0))
        except (KeyError, IndexError, ValueError, TypeError) as e:
            raise AdapterError("reply of an unknown shape") from e
        if stop in ("length", "max_tokens", "refusal", "content_filter") or not text.strip():
            raise AdapterError(f"no usable reply ({stop})")
        return Completion(text, usage)


@dataclass
class Governed:
    """A model under ceilings. The estimate before a call is pessimistic: a quarter of the characters and all tokens that may come."""

    model: object
    max_calls: int | None = None
    max_tokens: int | None = None
    max_cost: float | None = None
    per_minute: int | None = None
    retry: Retry = Retry(attempts=3)
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    calls: int = 0
    used: Usage = Usage()
    times: list[float] = field(default_factory=list)

    def complete(self, messages: Sequence[Message], temperature: float = 0.0, max_tokens: int | None = None) -> Completion:
        ahead = sum(len(t) for _, t in messages) // 4 + (max_tokens or 512)
        if self.max_calls is not None and self.calls >= self.max_calls:
            raise BudgetExceeded("calls")
        if self.max_tokens is not None and self.used.tokens_in + self.used.tokens_out + ahead > self.max_tokens:
            raise BudgetExceeded("tokens")
        if self.max_cost is not None and self.used.cost >= self.max_cost:
            raise BudgetExceeded("cost")
        if self.per_minute:
            while True:
                now = self.clock()
                self.times = [t for t in self.times if now - t < SPAN]
                if len(self.times) < self.per_minute:
                    break
                self.sleep(SPAN - (now - self.times[0]))
            self.times.append(self.clock())
        for attempt in range(1, self.retry.attempts + 1):
            try:
                out = self.model.complete(messages, temperature, max_tokens)
                break
            except AdapterError as e:
                if attempt == self.retry.attempts:
                    raise
                self.sleep(getattr(e, "retry_after", None) or self.retry.pause(attempt))
        self.calls, self.used = self.calls + 1, self.used + out.usage
        return out


def cache_key(namespace: str, *parts: object) -> str:
    return f"{namespace}:" + hashlib.blake2b(json.dumps(parts, sort_keys=True, ensure_ascii=False).encode(), digest_size=16).hexdigest()


@dataclass
class Cached:
    """A model with a cache for calls at temperature 0; a hit costs nothing."""

    model: object
    version: str
    store: MutableMapping[str, str] = field(default_factory=dict)

    def complete(self, messages: Sequence[Message], temperature: float = 0.0, max_tokens: int | None = None) -> Completion:
        if temperature > 0:
            return self.model.complete(messages, temperature, max_tokens)
        key = cache_key("model", self.version, messages, max_tokens)
        if key in self.store:
            text, a, b = json.loads(self.store[key])
            return Completion(text, Usage(a, b, 0.0, True))
        out = self.model.complete(messages, temperature, max_tokens)
        self.store[key] = json.dumps([out.text, out.usage.tokens_in, out.usage.tokens_out])
        return replace(out)


def rerank_scores(reply: str, n: int, default: float = 0.0) -> list[float]:
    """Scores from lines `number: score`, between 0 and 10."""
    import re

    out = [default] * n
    for k, v in re.findall(r"(?m)^\s*(\d+)\s*[:.)-]\s*(\d+(?:\.\d+)?)", reply):
        if 1 <= int(k) <= n:
            out[int(k) - 1] = max(0.0, min(10.0, float(v)))
    return out
