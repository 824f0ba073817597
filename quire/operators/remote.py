"""Providers that reach a model: through a command line program, or a chat service over HTTP. They run in tasks."""

from __future__ import annotations

import json
import os
import re
import shutil
import subprocess
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from http.client import HTTPException, HTTPResponse

from quire.functions.text import QUOTA
from quire.operators.providers import ModelError, QuotaError, Result, register

# Seconds that a call may take, and tokens that an answer may have.
TIMEOUT, MAX_TOKENS = 1800, 64000
#: Statuses after which a service is asked again, and the longest pause before, in seconds.
AGAIN, LONGEST_PAUSE = frozenset({408, 409, 429, 500, 502, 503, 504}), 60
#: Ends of an answer that make it unusable.
UNUSABLE = {"length": "the answer was cut off at the most tokens allowed", "content_filter": "the model refused"}
_QUOTA = re.compile(QUOTA, re.I)


def failure(message: str) -> ModelError:
    return QuotaError(message) if _QUOTA.search(message) else ModelError(message)


@dataclass(frozen=True)
class Command:
    """Runs a program with the prompt on its input. arguments may hold {system} and {model}; read makes a Result of its output."""

    arguments: tuple[str, ...]
    read: Callable[[str], Result] = lambda text: Result(text)
    timeout: float = TIMEOUT

    def __call__(self, prompt: str, system: str, model: str | None) -> Result:
        own = [a.replace("{system}", system).replace("{model}", model or "") for a in self.arguments]
        try:
            done = subprocess.run(own, input=prompt, capture_output=True, text=True, encoding="utf-8", timeout=self.timeout, check=False)
        except subprocess.TimeoutExpired:
            raise ModelError(f"the call took more than {self.timeout} seconds") from None
        except OSError as e:
            raise ModelError(str(e)) from None
        if done.returncode:
            raise failure((done.stderr or done.stdout).strip()[-2000:] or f"the program ended with {done.returncode}")
        return self.read(done.stdout)

    def ready(self) -> str | None:
        return None if shutil.which(self.arguments[0]) else f"no program {self.arguments[0]}"


def json_lines(output: str) -> list[dict]:
    """The JSON objects among a program's lines; others are passed over."""
    found = []
    for line in output.splitlines():
        if line.startswith("{"):
            try:
                found.append(json.loads(line))
            except ValueError:
                continue
    return found


def events(lines: Iterable[bytes]) -> Iterator[str]:
    """The data of server-sent events; comments, which keep a connection open, and other fields are passed over."""
    held: list[str] = []
    for raw in lines:
        line = raw.decode("utf-8", "replace").rstrip("\r\n")
        if line.startswith("data:"):
            held.append(line[5:].removeprefix(" "))
        elif not line and held:
            yield "\n".join(held)
            held = []


def _answered(parts: Iterable[dict]) -> Result:
    """The text and the counts of an answer that came whole (``message``) or in parts (``delta``); an answer without an end is an error."""
    text, usage, end = [], {}, None
    for part in parts:
        if part.get("error"):
            raise failure(json.dumps(part["error"])[:2000])
        usage = part.get("usage") or usage
        for choice in (part.get("choices") or [])[:1]:
            text.append((choice.get("message") or choice.get("delta") or {}).get("content") or "")
            end = choice.get("finish_reason") or end or ("stop" if choice.get("message") else None)
    if end is None:
        raise ModelError("the answer broke off" if any(text) else "the service answered nothing")
    if end in UNUSABLE:
        raise ModelError(UNUSABLE[end])
    counts = {"input_tokens": usage.get("prompt_tokens"), "output_tokens": usage.get("completion_tokens"), "cost_usd": usage.get("cost")}
    return Result("".join(text), {k: float(v) for k, v in counts.items() if v is not None})


@dataclass(frozen=True)
class Chat:
    """A chat completion service: a key in the environment, messages in, the first choice's text and token counts out.

    Answers come as a stream, so a long one isn't cut by a limit on waiting:
    ``timeout`` is how long the service may be silent. Before an answer has
    begun, a service that is busy or can't be reached is asked again, after the
    pause it names or one that doubles, ``retries`` times. An answer that breaks
    off is an error: whether it is paid for twice is the caller's to say.
    """

    url: str
    key: str
    timeout: float = TIMEOUT
    max_tokens: int = MAX_TOKENS
    retries: int = 5
    pause: float = 1

    def __call__(self, prompt: str, system: str, model: str | None) -> Result:
        body = {"model": model, "max_tokens": self.max_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}], "stream": True, "stream_options": {"include_usage": True}}
        asked = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", "Accept": "text/event-stream, application/json", "Authorization": f"Bearer {os.environ.get(self.key, '')}"})
        try:
            with self._opened(asked) as answer:
                if answer.headers.get_content_type() == "text/event-stream":
                    return _answered(json.loads(e) for e in events(answer) if e != "[DONE]")
                return _answered([json.load(answer)])
        except (OSError, HTTPException, ValueError, AttributeError) as e:
            raise ModelError(str(e) or type(e).__name__) from None

    def _opened(self, asked: urllib.request.Request) -> HTTPResponse:
        for left in range(self.retries, -1, -1):
            pause = self.pause * 2 ** (self.retries - left)
            try:
                return urllib.request.urlopen(asked, timeout=self.timeout)
            except urllib.error.HTTPError as e:
                text = e.read().decode("utf-8", "replace")[:2000]
                if not left or e.code not in AGAIN:
                    raise (QuotaError(text) if e.code in (402, 429) else failure(f"{e.code}: {text}")) from None
                named = e.headers.get("Retry-After") or ""
                pause = float(named) if named.isdecimal() else pause
            except (OSError, HTTPException):
                if not left:
                    raise
            time.sleep(min(pause, LONGEST_PAUSE))
        raise AssertionError("unreachable")

    def ready(self) -> str | None:
        return None if os.environ.get(self.key) else f"the environment has no {self.key}"


def register_command(name: str, *arguments: str, **settings) -> None:
    call = Command(arguments, **{k: settings.pop(k) for k in ("read", "timeout") if k in settings})
    register(name, call, ready=call.ready, **settings)


def register_chat(name: str, url: str, key: str, **settings) -> None:
    call = Chat(url, key, **{k: settings.pop(k) for k in ("timeout", "max_tokens", "retries", "pause") if k in settings})
    register(name, call, ready=call.ready, needs_model=True, **settings)


def _inside(value, path: str):
    """What a dotted path names in nested objects; None where it leads nowhere."""
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


@dataclass(frozen=True)
class JsonAnswer:
    """Reads a program's output of JSON: the last object with text under ``text``, and counters, each the sum of what some paths name."""

    text: str = "result"
    usage: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def __call__(self, output: str) -> Result:
        try:
            found = [json.loads(output)]
        except ValueError:
            found = json_lines(output)
        answers = [x for x in found if isinstance(_inside(x, self.text), str)]
        if not answers:
            raise failure(output.strip()[-2000:] or "the program answered nothing")
        counts = {name: [v for x in found for v in [_inside(x, p) for p in paths] if isinstance(v, int | float)] for name, paths in self.usage}
        return Result(_inside(answers[-1], self.text), {k: float(sum(v)) for k, v in counts.items() if v})


def register_settings(settings: dict[str, dict]) -> None:
    """Registers the providers that a settings file lists by name.

    Each has either ``command`` (a list of arguments, and perhaps ``answer``: a
    path, and ``usage``: names to lists of paths), or ``url`` and ``key`` (a
    variable of the environment); and perhaps default_model, light_model and
    timeout.
    """
    for name, own in settings.items():
        more = {k: own[k] for k in ("default_model", "light_model", "timeout") if k in own}
        if "command" in own:
            if "answer" in own:
                more["read"] = JsonAnswer(own["answer"], tuple((k, tuple(v)) for k, v in own.get("usage", {}).items()))
            register_command(name, *own["command"], **more)
        else:
            register_chat(name, own["url"], own["key"], **more)
