"""Settings of a search: budgets, models, cache modes, and the back end that the environment selects."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

#: Token budgets, attempts and waits.
SKELETON_BATCH, OUTPUT_TOKENS, ATTEMPTS, TRANSIENT_WAIT = 20_000, 8_000, 10, 1.0
NARROW_INPUT, WIDE_INPUT = 54_000, 500_000
CACHE_MODES = ("none", "read", "write", "read/write")


@dataclass(frozen=True)
class Backend:
    """A service with an OpenAI-like chat endpoint. models: the names that it accepts; empty accepts any."""

    name: str
    key_variable: str
    url: str
    analyze: str
    refine: str
    input_tokens: int = WIDE_INPUT
    models: frozenset = frozenset()


#: In order of precedence: the first whose key is set is taken.
BACKENDS = (
    Backend("gemini", "GEMINI_API_KEY", "https://generativelanguage.googleapis.com/v1beta/openai/", "gemini-2.0-flash", "gemini-2.0-flash"),
    Backend("deepseek", "DEEPSEEK_API_KEY", "https://api.deepseek.com", "deepseek-chat", "deepseek-reasoner", NARROW_INPUT, frozenset(("deepseek-chat", "deepseek-reasoner"))),
    Backend("openrouter", "OPENROUTER_API_KEY", "https://openrouter.ai/api/v1", "deepseek/deepseek-chat", "deepseek/deepseek-r1"),
)


@dataclass(frozen=True)
class SearchConfig:
    """What a search is run with. concurrency is partitions times threads."""

    analyze_model: str = "lexical"
    refine_model: str = "lexical"
    skeleton_batch: int = SKELETON_BATCH
    input_tokens: int = WIDE_INPUT
    cache_mode: str = "read/write"
    concurrency: int = 200
    threads: int = 8
    analyze_skeletons: bool = True
    refine: bool = True
    sample: int | None = None
    seed: int = 0
    backend: Backend | None = field(default=None)
    #: File of a tokenizer to count with; without one a token is four characters.
    tokenizer: str | None = None
    #: Told a stage's name when the stage is done.
    on_stage: Callable[[str], None] | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if self.cache_mode not in CACHE_MODES:
            raise ValueError(f"the cache mode is one of {', '.join(CACHE_MODES)}, not {self.cache_mode}")
        if min(self.skeleton_batch, self.input_tokens, self.concurrency, self.threads) <= 0:
            raise ValueError("budgets and concurrency must be positive")
        if self.backend and self.backend.models:
            for model in (self.analyze_model, self.refine_model):
                if model not in self.backend.models:
                    raise ValueError(f"{self.backend.name} has no model {model}")

    @property
    def reads_cache(self) -> bool:
        return self.cache_mode in ("read", "read/write")

    @property
    def writes_cache(self) -> bool:
        return self.cache_mode in ("write", "read/write")


def from_environment(env: dict[str, str] | None = None, **changes) -> SearchConfig:
    """The back end whose key is set first in order of precedence; the lexical judge where none is."""
    env = dict(os.environ) if env is None else env
    chosen = next((b for b in BACKENDS if env.get(b.key_variable)), None)
    mode = env.get("SIEVEWRIGHT_CACHE", "read/write").lower()
    if chosen is None:
        return SearchConfig(cache_mode=mode, **changes)
    analyze = env.get("SIEVEWRIGHT_ANALYZE_MODEL", chosen.analyze)
    refine = env.get("SIEVEWRIGHT_REFINE_MODEL", chosen.refine)
    return SearchConfig(analyze, refine, input_tokens=chosen.input_tokens, cache_mode=mode, backend=chosen, **changes)
