"""Settings: read from the environment (SLACKLINE_<NAME>), frozen, and overridable by name."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from slackline.functions.quantiles import DEFAULT_Q, LEVELS


def _env(name: str, default, read: Callable = str):
    return field(default_factory=lambda: read(os.environ[f"SLACKLINE_{name}"]) if os.environ.get(f"SLACKLINE_{name}") else default)


def _words(text: str) -> tuple[str, ...]:
    return tuple(w.strip() for w in text.split(",") if w.strip())


def _numbers(text: str) -> tuple[float, ...]:
    return tuple(float(w) for w in _words(text))


@dataclass(frozen=True)
class Settings:
    """What pipelines share. Distances are metres, speeds metres a minute."""

    model_start: str = _env("MODEL_START", "2024-10-01")
    model_end: str = _env("MODEL_END", "2026-01-31")
    train_start: str = _env("TRAIN_START", "2024-10-01")
    train_end: str = _env("TRAIN_END", "2025-07-31")
    validation_start: str = _env("VALIDATION_START", "2025-10-01")
    validation_end: str = _env("VALIDATION_END", "2026-01-31")
    operators: tuple[str, ...] = _env("OPERATORS", (), _words)
    regions: tuple[str, ...] = _env("REGIONS", (), _words)
    sample_fraction: float = _env("SAMPLE_FRACTION", 0.1, float)
    sample_seed: int = _env("SAMPLE_SEED", 42, int)
    max_walk: float = _env("MAX_WALK", 500.0, float)
    walking_speed: float = _env("WALKING_SPEED", 50.0, float)
    walking_base_seconds: float = _env("WALKING_BASE_SECONDS", 120.0, float)
    min_transfer_seconds: int = _env("MIN_TRANSFER_SECONDS", 120, int)
    search_minutes: int = _env("SEARCH_MINUTES", 180, int)
    levels: tuple[float, ...] = _env("LEVELS", LEVELS, _numbers)
    confidence: float = _env("CONFIDENCE", DEFAULT_Q, float)


def get_settings(**overrides) -> Settings:
    """The environment's settings, with some replaced; an unknown name is an error."""
    return Settings(**overrides)
