"""Judges answer messages; asking them runs in the partitions, with threads, retries and errors as rows."""

from __future__ import annotations

import json
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ATTEMPTS, OUTPUT_TOKENS, TRANSIENT_WAIT, Backend
from ..functions.arrow import arrow_map
from .cache import store_answers


class RateLimited(Exception):
    """Too many requests: wait longer each time."""


class Transient(Exception):
    """The service failed in passing, or gave a blank answer: wait a moment."""


class Rejected(Exception):
    """The request itself is wrong, or not allowed: no second attempt."""


class Judge(Protocol):
    def ask(self, messages: list[dict[str, str]], model: str) -> str: ...


#: A document's label, see plans.prompts.labelled.
LABEL = re.compile(r"(?m)^<<< (.+) >>>\n")
TERM = re.compile(r"[a-z0-9_]{5,}")


def terms(question: str) -> list[str]:
    """A question's distinct words of five letters or more, in lower case."""
    return sorted(set(TERM.findall(question.lower())))


class LexicalJudge:
    """Deterministic: what holds a term of the question counts. Stands in for a model in tests and in SQL.

    Over a batch it lists the paths of the documents that count, over one source the lines that do, over notes the distinct
    lines in order."""

    #: Costs a core rather than a place in a service's queue.
    remote = False

    def ask(self, messages: list[dict[str, str]], model: str) -> str:
        task = messages[0]["content"].split("\n", 1)[0]
        question = messages[-1]["content"].rsplit("```", 2)[-2] if "```" in messages[-1]["content"] else messages[-1]["content"]
        wanted = terms(question)
        counts = lambda text: any(w in text.lower() for w in wanted)
        content = messages[1]["content"] if len(messages) > 1 else ""
        if task == "filter":
            parts = LABEL.split(content)
            return "\n".join(path for path, text in zip(parts[1::2], parts[2::2]) if counts(text)) or "none"
        lines = [x for x in content.split("\n") if x.strip() and not LABEL.match(x + "\n")]
        if task == "map":
            return "\n".join(x for x in lines if counts(x)) or "nothing relevant"
        return "\n".join(sorted(set(lines))) or "nothing relevant"


class ScriptedJudge:
    """Plays back a list of outcomes for each first word of the question; exceptions are raised. For tests."""

    def __init__(self, outcomes: list) -> None:
        self.outcomes, self.calls = list(outcomes), 0

    def ask(self, messages: list[dict[str, str]], model: str) -> str:
        out = self.outcomes[min(self.calls, len(self.outcomes) - 1)]
        self.calls += 1
        if isinstance(out, Exception):
            raise out
        return out


class HttpJudge:
    """A chat service with streamed answers. The key is read where the call is made, so that it travels in no closure."""

    def __init__(self, backend: Backend, on_lines: Callable[[int], None] | None = None) -> None:
        self.backend, self.on_lines = backend, on_lines

    def ask(self, messages: list[dict[str, str]], model: str) -> str:
        import os

        body = json.dumps({"model": model, "messages": messages, "max_tokens": OUTPUT_TOKENS, "stream": True}).encode()
        request = urllib.request.Request(self.backend.url.rstrip("/") + "/chat/completions", body, {"Authorization": f"Bearer {os.environ[self.backend.key_variable]}", "Content-Type": "application/json"})
        parts: list[str] = []
        try:
            with urllib.request.urlopen(request, timeout=600) as stream:
                for raw in stream:
                    line = raw.decode().strip()
                    if not line.startswith("data:") or line == "data: [DONE]":
                        continue
                    choices = json.loads(line[5:]).get("choices") or []
                    piece = (choices[0].get("delta") or {}).get("content") if choices else None
                    if piece:
                        parts.append(piece)
                        if self.on_lines:
                            self.on_lines(piece.count("\n"))
        except urllib.error.HTTPError as e:
            if e.code == 429:
                raise RateLimited(str(e)) from e
            raise (Rejected if e.code in (400, 401, 403, 404, 422) else Transient)(str(e)) from e
        except (urllib.error.URLError, OSError, ValueError) as e:
            raise Transient(str(e)) from e
        return "".join(parts)


def wait_for(attempt: int, jitter: float = 0.0) -> float:
    """Seconds after a rate limit at this attempt, counted from 0."""
    return 2.0**attempt + 5.0 * jitter


def waits(attempt: Column) -> Column:
    """The same of a column, without jitter."""
    return F.pow(F.lit(2.0), attempt)


def ask(judge: Judge, messages: list[dict[str, str]], model: str, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random) -> tuple[str | None, str | None, str | None, str | None, int]:
    """(answer, error kind, message, cause, attempts). Blank answers count as passing failures; any other exception is internal."""
    last: Exception | None = None
    for attempt in range(ATTEMPTS):
        try:
            answer = judge.ask(messages, model)
            if not answer or not answer.strip():
                raise Transient("the answer is blank")
            return answer, None, None, None, attempt + 1
        except Rejected as e:
            return None, "request", "the request was rejected", str(e), attempt + 1
        except RateLimited as e:
            last = e
            sleep(wait_for(attempt, jitter()))
        except Transient as e:
            last = e
            sleep(TRANSIENT_WAIT)
        except Exception as e:  # noqa: BLE001 - becomes an error row
            return None, "internal", f"{type(e).__name__}", str(e), attempt + 1
    return None, "timeout", f"no answer after {ATTEMPTS} attempts", str(last), ATTEMPTS


ASKED = "cache_key string, path string, answer string, kind string, message string, cause string, attempts int"


#: Answers that a worker holds at most before it stores them, and seconds.
STORE_ROWS, STORE_SECONDS = 64, 30.0


def ask_all(requests: DataFrame, judge: Judge, threads: int = 8, store: str | None = None, lines: Accumulator | None = None) -> DataFrame:
    """Asks each request (cache_key, model, messages, path) once; an answer or an error for each, in ASKED's columns.

    store: a cache's folder, to which workers add answers while the stage runs, so that one which fails loses no more than
    STORE_ROWS or STORE_SECONDS of each worker. lines: counts the answers' line feeds. Write the result before using it twice:
    reading it again would ask again."""

    def setup():
        pool = ThreadPoolExecutor(threads)

        def per_batch(c: dict[str, list]) -> Iterator[tuple]:
            jobs = [pool.submit(ask, judge, m, model) for m, model in zip(c["messages"], c["model"])]
            held, since = [], time.monotonic()
            for key, path, job in zip(c["cache_key"], c["path"], jobs):
                answer, kind, message, cause, attempts = job.result()
                if answer is not None:
                    held.append((key, answer))
                    if lines is not None:
                        lines.add(answer.count("\n"))
                if store and held and (len(held) >= STORE_ROWS or time.monotonic() - since >= STORE_SECONDS):
                    store_answers(store, held)
                    held, since = [], time.monotonic()
                yield key, path, answer, kind, message, cause, attempts
            if store and held:
                store_answers(store, held)

        return per_batch

    return arrow_map(requests.select("cache_key", "model", "messages", "path"), None, ASKED, setup)
