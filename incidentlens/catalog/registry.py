"""Named queries over the test tables, each with its check SQL where SQL can express it."""

from __future__ import annotations

import functools

from ..session import prepare

QUERIES = {}
CHECKS = {}


def query(name: str, check: str | None = None):
    def add(function):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        @functools.wraps(function)
        def prepared(spark, folder):
            return function(prepare(spark), folder)

        QUERIES[name] = prepared
        if check is not None:
            CHECKS[name] = check
        return function
    return add
