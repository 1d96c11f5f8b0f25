"""Blank out the parts of a script that are not executed: comments, strings, dollar-quoted bodies; and note its statement heads.

Block comments nest, so no single regular expression finds where one ends.
This is the only Python code that sees script text, and only texts that hold
something to blank out are sent to it.
"""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

# The scan travels to the executors with the query, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_START = re.compile(rb"--|/\*|'|\"|\$(?:[A-Za-z_][A-Za-z0-9_]*)?\$")
_BLOCK_EDGE = re.compile(rb"/\*|\*/")
# From behind the opening quote to behind the closing one, or to the end of the text.
_STRING_REST = re.compile(rb"[^']*+(?:''[^']*+)*+'?")
_ESCAPE_STRING_REST = re.compile(rb"[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+(?:'|\\\Z)?", re.DOTALL)
_NAME_REST = re.compile(rb'[^"]*+(?:""[^"]*+)*+"?')

# Every byte but the line break becomes a blank.
_BLANK = bytes(b if b == 10 else 32 for b in range(256))

# A CREATE or DROP that is the first word of its line, and what a statement's head can go on with: words, quotes and dots,
# up to as many words as the longest head has ("CREATE OR REPLACE MATERIALIZED VIEW IF NOT EXISTS name").
_HEAD = re.compile(rb"^[ \t\f\r]*+(?P<verb>(?:CREATE|DROP)(?=[ \t\n\f\r]))", re.IGNORECASE | re.MULTILINE)
_REGION = re.compile(rb'(?:[A-Za-z0-9_".]++[ \t\n\f\r]++){0,9}+[A-Za-z0-9_".]*+')
_SPACES = re.compile(rb"[ \t\n\f\r]+")

# Cheap test on the JVM side for texts that need the scan at all.
MASKABLE = r"--|/\*|'|\$"


def _block_end(text: bytes, start: int) -> int:
    depth = 1
    for edge in _BLOCK_EDGE.finditer(text, start):
        depth += 1 if edge.group() == b"/*" else -1
        if depth == 0:
            return edge.end()
    return len(text)


def _find_end(text: bytes, mark: bytes, start: int) -> int:
    found = text.find(mark, start)
    return len(text) if found < 0 else found


def mask_one(text: bytes) -> bytes:
    """``text`` with every non-executable byte as a blank; line breaks and quoted names stay. Any bytes will do."""
    out, done, at = [], 0, 0
    while found := _START.search(text, at):
        mark, start, behind = found.group(), found.start(), found.end()
        if mark == b'"':
            at = _NAME_REST.match(text, behind).end()
            continue
        if mark == b"'":
            escapes = start > at and text[start - 1 : start] in (b"e", b"E")
            end = (_ESCAPE_STRING_REST if escapes else _STRING_REST).match(text, behind).end()
            start -= escapes
        elif mark == b"--":
            end = _find_end(text, b"\n", behind)
        elif mark == b"/*":
            end = _block_end(text, behind)
        else:
            end = min(_find_end(text, mark, behind) + len(mark), len(text))
        out += [text[done:start], text[start:end].translate(_BLANK)]
        done = at = end
    out.append(text[done:])
    return b"".join(out)


def heads_one(text: bytes) -> bytes:
    """The heads of the CREATE and DROP statements that are executed and begin a line, one after another.

    Each begins a line and ends with a semicolon; runs of white space are one blank, or one line break if they hold any. Heads
    that run into each other stay in one piece, so whatever a pattern finds in the masked text it finds here.
    """
    masked = mask_one(text)
    pieces: list[list[int]] = []
    for head in _HEAD.finditer(masked):
        start = head.start("verb")
        end = _REGION.match(masked, start).end()
        if pieces and start <= pieces[-1][1]:
            pieces[-1][1] = max(pieces[-1][1], end)
        else:
            pieces.append([start, end])
    short = lambda m: b"\n" if b"\n" in m.group() else b" "
    return b"".join(_SPACES.sub(short, masked[start:end]) + b";\n" for start, end in pieces)


@F.pandas_udf(T.BinaryType())
def _heads(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: heads_one(bytes(t)), na_action="ignore")


def statement_heads(text: Column) -> Column:
    """Heads of the executed statements, for text that holds something to mask; other text is its own."""
    maskable = text.rlike(MASKABLE)
    return F.when(maskable, _heads(F.when(maskable, text.cast("binary"))).cast("string")).otherwise(text)


@F.pandas_udf(T.BinaryType())
def _mask(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: mask_one(bytes(t)), na_action="ignore")


def mask_text(text: Column) -> Column:
    """Mask comments, strings and dollar bodies; a text without any skips the Python scan."""
    maskable = text.rlike(MASKABLE)
    return F.when(maskable, _mask(F.when(maskable, text.cast("binary"))).cast("string")).otherwise(text)
