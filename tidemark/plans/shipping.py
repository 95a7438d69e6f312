"""Sending Python functions to executors that don't have this package installed."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def by_value(module: str) -> None:
    """Send a module's functions to the executors whole."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
