"""Macro strings: calls separated by blanks or semicolons, each a name and its arguments in brackets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALLS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("args", T.ArrayType(T.StringType()))]))


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments from the opening bracket's next place on, and the place after the closing one."""
    found, start, depth, quoted = [], at, 1, False
    while at < len(text):
        c = text[at]
        if c == '"':
            quoted = not quoted
        elif not quoted and c == "(":
            depth += 1
        elif not quoted and c == ")":
            depth -= 1
            if not depth:
                break
        elif not quoted and c == "," and depth == 1:
            found.append(text[start:at].strip())
            start = at + 1
        at += 1
    if last := text[start:at].strip():
        found.append(last)
    return found, at + 1


def _bare(argument: str) -> str:
    for opening, closing in (('"', '"'), ("`", "'")):
        if argument[:1] == opening and argument[-1:] == closing:
            return argument[1:-1] if len(argument) > 1 else ""
    return argument


def parse(text: str | None) -> list[tuple[str, list[str]]]:
    calls, at, text = [], 0, text or ""
    while True:
        while text[at : at + 1] in (" ", ";") and at < len(text):
            at += 1
        bracket = text.find("(", at)
        if bracket < 0 or not text[at:bracket].strip():
            return calls
        args, end = _arguments(text, bracket + 1)
        calls.append((text[at:bracket].strip(), [_bare(a) for a in args]))
        at = end


@F.pandas_udf(CALLS)
def parse_macros(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([[{"name": n, "args": a} for n, a in parse(t)] for t in batch], dtype=object)
