"""Shipping of Python functions to executors."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def by_value(module_name: str) -> None:
    """Send a module's functions inside the tasks, so that executors need no copy of the library."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
