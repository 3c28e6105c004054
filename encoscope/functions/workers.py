"""State that a Python worker keeps between tasks."""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Callable

from pyspark import cloudpickle


def function_key(function: Callable) -> str:
    """A digest of what is shipped for a function: equal for the same code and captured values."""
    return hashlib.sha256(cloudpickle.dumps(function)).hexdigest()


def per_worker(key, build: Callable):
    """``build()`` once in each Python worker, kept between the tasks that the worker runs."""
    store = sys.modules.setdefault("_worker_store", types.ModuleType("_worker_store"))
    kept = store.__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = build()
    return kept[key]
