"""Named objects that a script creates or drops, for three SQL dialects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from driftledger.functions.masking import statement_heads
from driftledger.functions.text import WS

NAME = "([A-Za-z_][A-Za-z0-9_]*)"


@dataclass(frozen=True)
class Dialect:
    """What a dialect allows between CREATE or DROP and the object name."""

    name: str
    default_schema: str
    kinds: tuple[str, ...]
    quotes: tuple[str, str]
    create_words: tuple[str, ...] = ()  # optional regex parts, each at most once, in this order
    drop_words: tuple[str, ...] = ()
    if_clause: bool = False
    masks: bool = False
    schema_matters: bool = True

    def _pattern(self, verb: str, words: tuple[str, ...], condition: str) -> str:
        opening, closing = (f"{q}?" for q in self.quotes)
        name = f"{opening}{NAME}{closing}"
        optional = "".join(f"(?:{w}{WS}+)?" for w in words)
        clause = f"(?:{condition}{WS}+)?" if self.if_clause else ""
        kinds = "|".join(self.kinds)
        # 'd' makes \n the only line break, so ^ means the same here as in RE2.
        return f"(?imd)^{WS}*{verb}{WS}+{optional}({kinds}){WS}+{clause}(?:{name}\\.)?{name}"

    @property
    def create_pattern(self) -> str:
        return self._pattern("CREATE", self.create_words, f"IF{WS}+NOT{WS}+EXISTS")

    @property
    def drop_pattern(self) -> str:
        return self._pattern("DROP", self.drop_words, f"IF{WS}+EXISTS")


PG = Dialect(
    name="pg",
    default_schema="public",
    kinds=("TABLE", "VIEW", "FUNCTION", "PROCEDURE"),
    quotes=('"', '"'),
    create_words=(f"OR{WS}+REPLACE", "(?:UNLOGGED|TEMP|TEMPORARY|MATERIALIZED)"),
    drop_words=("MATERIALIZED",),
    if_clause=True,
    masks=True,
)
MS = Dialect(
    name="ms",
    default_schema="dbo",
    kinds=("TABLE", "PROCEDURE", "PROC", "VIEW", "FUNCTION"),
    quotes=(r"\[", r"\]"),
    create_words=(f"OR{WS}+ALTER",),
)
LITE = Dialect(
    name="lite",
    default_schema="main",
    kinds=("TABLE", "VIEW"),
    quotes=('"', '"'),
    create_words=("(?:TEMP|TEMPORARY)",),
    if_clause=True,
    schema_matters=False,
)
DIALECTS = {d.name: d for d in (PG, MS, LITE)}


def dialect_of(dialect: str | Dialect) -> Dialect:
    return dialect if isinstance(dialect, Dialect) else DIALECTS[dialect]


def executable_text(body: Column, dialect: str | Dialect) -> Column:
    """What the patterns are to see: the body or, where the dialect has comments and strings that may hold statements, the
    heads of those that are executed. So from such a scan a few lines come back instead of the text."""
    if not dialect_of(dialect).masks:
        return body
    named = body.rlike("(?i)create|drop")
    return F.when(named, statement_heads(F.when(named, body))).when(body.isNotNull(), "")


def _objects(text: Column, pattern: str, default_schema: str) -> Column:
    # The text is scanned once; the short matches are then split into their three groups.
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.transform(matches, lambda m: F.split(F.regexp_replace(m, pattern, "$1.$2.$3"), r"\."))

    def ref(g: Column) -> Column:
        kind, schema, name = (F.get(g, F.lit(i)) for i in range(3))
        return F.struct(
            F.when(schema == "", F.lit(default_schema)).otherwise(schema).alias("schema"),
            name.alias("name"),
            F.when(F.lower(kind) == "proc", F.lit("procedure")).otherwise(F.lower(kind)).alias("kind"),
        )

    return F.transform(groups, ref)


def created(text: Column, dialect: str | Dialect) -> Column:
    """Objects named by CREATE statements at a line start, in source order. ``text`` is that of :func:`executable_text`."""
    d = dialect_of(dialect)
    return _objects(text, d.create_pattern, d.default_schema)


def dropped(text: Column, dialect: str | Dialect) -> Column:
    """Objects named by DROP statements at a line start, in source order. ``text`` is that of :func:`executable_text`."""
    d = dialect_of(dialect)
    return _objects(text, d.drop_pattern, d.default_schema)
