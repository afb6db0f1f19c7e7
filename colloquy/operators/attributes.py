"""Attribute expressions with brackets, compiled to Columns over call metadata."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.operators.dictionary import AND, NOT, OR

_PART = re.compile(r'\s*(?:([()])|"([^"]*)"|([^\s()"]+))')


def compile_expression(text: str, leaf: Callable[[str], Column]) -> Column:
    """OR of AND of NOT of leaves or bracketed expressions; an empty expression holds.

    leaf turns a word or a quoted string into a test. Two terms in a row are joined by AND.
    """
    parts = [(m[1] or "", m[2] if m[2] is not None else m[3]) for m in _PART.finditer(text)]
    at = 0

    def word() -> str:
        return (parts[at][1] or "").upper() if at < len(parts) and not parts[at][0] else ""

    def any_of() -> Column:
        nonlocal at
        out = all_of()
        while word() in OR:
            at += 1
            out = out | all_of()
        return out

    def all_of() -> Column:
        nonlocal at
        out = negated()
        while at < len(parts) and parts[at][0] != ")" and word() not in OR:
            at += word() in AND
            out = out & negated()
        return out

    def negated() -> Column:
        nonlocal at
        if word() in NOT:
            at += 1
            return ~negated()
        if at >= len(parts):
            return F.lit(True)
        bracket, term = parts[at]
        at += 1
        if bracket == "(":
            out = any_of()
            at += 1  # its end, or that of the text
            return out
        return leaf(term) if not bracket else F.lit(True)

    return any_of() if parts else F.lit(True)


def comparison(columns: set[str]) -> Callable[[str], Column]:
    """Leaves of the form name=value, name<value or name>value over the named columns."""

    def leaf(term: str) -> Column:
        m = re.fullmatch(r"(\w+)([=<>])(.*)", term)
        if not m or m[1] not in columns:
            raise ValueError(f"unknown attribute: {term}")
        c = F.col(m[1])
        return {"=": lambda: c.cast("string") == m[3], "<": lambda: c < float(m[3]), ">": lambda: c > float(m[3])}[m[2]]()

    return leaf
