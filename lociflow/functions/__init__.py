"""Column functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column

_built: dict[tuple, object] = {}


def built_once(build: Callable) -> Callable:
    """Keeps what a function of hashable arguments builds for as long as the Spark context lives. A large expression over
    named columns takes thousands of calls to the JVM, and means the same over every table."""

    @wraps(build)
    def again(*args: object) -> Column | list[Column]:
        key = (SparkContext._active_spark_context, build, *args)
        if key not in _built:
            for old in [k for k in _built if k[0] is not key[0]]:
                del _built[old]
            _built[key] = build(*args)
        return _built[key]

    return again
