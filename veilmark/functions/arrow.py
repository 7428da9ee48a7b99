"""Module functions over Arrow batches, for what column expressions can't do at a bearable price."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

#: Where the package lives, so that Python workers can import it whatever their working directory is.
ROOT = str(Path(__file__).resolve().parents[2])


def arrow_task(fn: Callable, **params) -> Callable:
    """``fn(batches, **params)`` of an importable module, for ``mapInArrow``; only its name travels."""
    module, name, root = fn.__module__, fn.__name__, ROOT

    def run(batches):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.insert(0, root)
        yield from getattr(importlib.import_module(module), name)(batches, **params)

    return run
