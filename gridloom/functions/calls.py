"""Calls that models write in Python syntax, read with Python's own grammar over Arrow batches.

The grammar (nesting, escapes, adjacent strings, f-strings, any other expression) is beyond patterns: alternations in a
repeated group recurse for every character and end the JVM on a long answer. The grammar's parser is linear, refuses brackets
nested too deep with an error, and touches nothing but the text: no name is looked up, nothing is called.
"""

from __future__ import annotations

import ast
import warnings

import pyarrow as pa
from pyspark.sql import functions as F, types as T

#: Keywords whose values are read.
READ = ("reason", "direction")
CALL_TYPE = T.StructType([T.StructField(n, T.StringType()) for n in ("name", *READ)])
_UNREAD = (SyntaxError, ValueError, TypeError, MemoryError, RecursionError)


def _value(node: ast.expr) -> object:
    """A literal's value; None for any other expression."""
    try:
        return ast.literal_eval(node)
    except _UNREAD:
        return None


def _words(value: object) -> str:
    """As ``str``; what UTF-8 can't write becomes a question mark, a number too long to print None."""
    try:
        return str(value).encode("utf-8", "replace").decode()
    except _UNREAD:
        return "None"


def call_parts(text: str) -> dict[str, str | None] | None:
    """Name of a call and its ``READ`` keywords as text; None where the text is no call of a plain name
    or repeats a keyword.

    An absent reason is empty; a direction that is absent or counts as false is None."""
    try:
        with warnings.catch_warnings():  # of odd escapes, on the worker's stderr
            warnings.simplefilter("ignore")
            node = ast.parse(text, mode="eval").body
    except _UNREAD:
        return None
    if not (isinstance(node, ast.Call) and isinstance(node.func, ast.Name)):
        return None
    names = [k.arg for k in node.keywords if k.arg]
    if len(names) > len(set(names)):  # the parser leaves this to the interpreter, which refuses it
        return None
    given = {k.arg: k.value for k in node.keywords if k.arg in READ}
    direction = _value(given["direction"]) if "direction" in given else None
    return {
        "name": node.func.id,
        "reason": _words(_value(given["reason"])) if "reason" in given else "",
        "direction": _words(direction) if direction else None,
    }


@F.arrow_udf(returnType=CALL_TYPE)
def read_call(texts: pa.Array) -> pa.Array:
    """``name``, ``reason`` and ``direction`` of a call; a null struct for null texts and for what is no call."""
    kind = pa.struct([(f.name, pa.string()) for f in CALL_TYPE])
    return pa.array([None if t is None else call_parts(t) for t in texts.to_pylist()], kind)
