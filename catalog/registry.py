"""All registered queries."""

from __future__ import annotations

from .core import REGISTRY, Query


def all_queries() -> dict[str, Query]:
    from . import (  # noqa: F401
        evaluation,
        models,
        next_place,
        pairs,
        reviews,
        sessions,
        sources,
        texts,
        trips,
        visits,
    )

    return dict(REGISTRY)
