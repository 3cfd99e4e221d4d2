"""Options from the environment; anything unusable counts as not set."""

from __future__ import annotations

import json
import os

PREFIX = "PAPERWEAVE_"


def env_int(name: str) -> int | None:
    try:
        return int(os.environ[PREFIX + name])
    except (KeyError, ValueError):
        return None


def env_float(name: str) -> float | None:
    try:
        return float(os.environ[PREFIX + name])
    except (KeyError, ValueError):
        return None


def env_headers(name: str = "HTTP_HEADERS") -> dict[str, str]:
    try:
        got = json.loads(os.environ[PREFIX + name])
    except (KeyError, ValueError):
        return {}
    return {str(k): str(v) for k, v in got.items()} if isinstance(got, dict) else {}


def ttl_days() -> dict[str, int]:
    """Days a document stays fresh per endpoint, with ``PAPERWEAVE_TTL_<ENDPOINT>`` overriding the defaults."""
    from .operators.predicates import TTL_DAYS

    return {k: v if (e := env_int(f"TTL_{k.upper()}")) is None else e for k, v in TTL_DAYS.items()}
