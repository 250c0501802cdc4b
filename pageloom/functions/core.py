"""Helpers for building larger expressions out of built-in SQL functions.

Expressions are put together as SQL text and handed to Spark once, with
``F.expr``: building the same trees call by call through the Python API costs
thousands of round trips to the JVM. Arguments of all functions here are column
names or SQL expressions.

A page arrives as one row, so everything that is "per page" (first-wins
de-duplication, ordinals, document order) is done with array functions inside
that row. Nothing here needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

_fresh = count()


def fresh() -> int:
    """A number for the names of lambda variables that no other expression uses."""
    return next(_fresh)


def expr(text: str) -> Column:
    return F.expr(text)


def lit(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_list(c: str, values) -> str:
    return f"{c} IN ({', '.join(lit(v) for v in values)})"


def each(array: str, body: Callable[[str], str]) -> str:
    v = f"v{next(_fresh)}"
    return f"transform({array}, {v} -> {body(v)})"


def each_indexed(array: str, body: Callable[[str, str], str]) -> str:
    n = next(_fresh)
    return f"transform({array}, (v{n}, i{n}) -> {body(f'v{n}', f'i{n}')})"


def keep(array: str, test: Callable[[str], str]) -> str:
    v = f"v{next(_fresh)}"
    return f"filter({array}, {v} -> {test(v)})"


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once and hand it to ``body``.

    Text used five times runs five times; an aggregate over no elements binds its start
    value to a lambda variable. Unlike a transform of a one-element array it copies
    nothing: neither the value nor the result, which may hold all elements of a page.
    """
    n = next(_fresh)
    return f"aggregate(array(), {value}, (a{n}, x{n}) -> a{n}, v{n} -> {body(f'v{n}')})"


def case(*branches: tuple[str, str], default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {test} THEN {value}" for test, value in branches)
    return f"CASE {whens} ELSE {default} END"


def struct(**fields: str) -> str:
    args = ", ".join(f"'{name}', {value}" for name, value in fields.items())
    return f"named_struct({args})"


def non_empty(c: str) -> str:
    """NULL instead of the empty string."""
    return f"nullif({c}, '')"


def text_map(**entries: str) -> str:
    """map<string,string> without the entries whose value is NULL."""
    pairs = ", ".join(f"'{k}', {v}" for k, v in entries.items())
    return f"map_filter(map({pairs}), (k, v) -> v IS NOT NULL)"


EMPTY_MAP = "CAST(map() AS MAP<STRING, STRING>)"


def first_by_key(values: str, key: Callable[[str], str]) -> str:
    """Keep the first array element of every key, in the original order.

    Sorts (key, index) pairs instead of comparing all elements with each other,
    so a page with very many elements costs n log n.
    """

    def firsts(pairs: str) -> str:
        n = next(_fresh)
        return (
            f"filter({pairs}, (e{n}, j{n}) -> j{n} = 0"
            f" OR NOT (get({pairs}, j{n} - 1).k <=> e{n}.k))"
        )

    def dedup(a: str, keys: str) -> str:
        pairs = f"sort_array({each_indexed(keys, lambda k, i: struct(k=k, i=i))})"
        kept = let(pairs, lambda p: f"sort_array({each(firsts(p), lambda e: f'{e}.i')})")
        return each(kept, lambda i: f"get({a}, {i})")

    def distinct(a: str) -> str:
        # one element, or no two alike: the usual case, nothing to drop
        keys = each(a, key)
        return (
            f"IF(size({a}) < 2 OR size(array_distinct({keys})) = size({a}),"
            f" {a}, {let(keys, lambda k: dedup(a, k))})"
        )

    return let(values, distinct)
