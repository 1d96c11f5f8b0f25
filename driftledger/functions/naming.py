"""Identifiers derived from table and column names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that a web property name may not be, and words that a Python field name may not be.
WEB_RESERVED = (
    "break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else",
    "enum", "export", "extends", "false", "finally", "for", "function", "if", "import", "in", "instanceof",
    "new", "null", "return", "super", "switch", "this", "throw", "true", "try", "typeof", "var", "void",
    "while", "with", "yield", "let", "static", "await", "async", "implements", "interface", "package",
    "private", "protected", "public",
)
PYTHON_RESERVED = (
    "False", "None", "True", "and", "as", "assert", "async", "await", "break", "class", "continue", "def",
    "del", "elif", "else", "except", "finally", "for", "from", "global", "if", "import", "in", "is", "lambda",
    "nonlocal", "not", "or", "pass", "raise", "return", "try", "while", "with", "yield",
)


def pascal_case(name: Column) -> Column:
    """``fact_price`` -> ``FactPrice``; splits on underscore, hyphen, blank and dot, keeps other characters."""
    words = F.filter(F.split(name, r"[_\- .]"), lambda w: w != "")
    joined = F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), ""
    )
    return F.regexp_replace(F.regexp_replace(joined, r"\A(?=[0-9])", "_"), r"\A\z", "Empty")


def safe_field(name: Column) -> Column:
    """A Python field name: keywords get a trailing underscore, characters outside [A-Za-z0-9_] go."""
    kept = F.regexp_replace(name, "[^A-Za-z0-9_]", "")
    usable = F.regexp_replace(kept, r"\A(?=[0-9]|\z)", "_")
    return F.when(name.isin(*PYTHON_RESERVED), F.concat(name, F.lit("_"))).otherwise(usable)


def web_name(name: Column) -> Column:
    """A web property name: reserved words get a trailing underscore, anything unusual is quoted."""
    plain = name.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z")
    return (
        F.when(name.isin(*WEB_RESERVED), F.concat(name, F.lit("_")))
        .when(plain, name)
        .otherwise(F.concat(F.lit('"'), name, F.lit('"')))
    )
