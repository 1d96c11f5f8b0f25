"""SQL fragments that several oracles share. Written for DuckDB, apart from the Spark code on purpose."""

from __future__ import annotations

CREATE, DROP = "create", "drop"
DEFAULT_SCHEMA = {"pg": "public", "ms": "dbo", "lite": "main"}
_KINDS = {"pg": "table view function procedure", "ms": "table procedure proc view function", "lite": "table view"}
# What may stand between the verb and the kind: a pair of words, then a single word; and the condition behind the kind.
_PAIR = {(CREATE, "pg"): ("or", "replace"), (CREATE, "ms"): ("or", "alter")}
_SINGLE = {(CREATE, "pg"): "unlogged temp temporary materialized", (CREATE, "lite"): "temp temporary", (DROP, "pg"): "materialized"}
_CONDITION = {CREATE: ("if", "not", "exists"), DROP: ("if", "exists")}


def _are(at: str, words: tuple[str, ...]) -> str:
    return " AND ".join(f"low[{at} + {i}] = '{w}'" for i, w in enumerate(words)) or "false"


def _among(at: str, words: str) -> str:
    listed = ", ".join(f"'{w}'" for w in words.split())
    return f"low[{at}] IN ({listed})" if listed else "false"


def objects(verb: str, dialect: str, source: str = "corpus_d") -> str:
    """Objects that scripts name, read word by word: a line begins with the verb, modifiers are skipped, then come the kind
    and the name. The derived scripts hold no other masked text than flat block comments."""
    text = r"regexp_replace(body, '/\*.*?\*/', '', 'gs')" if dialect == "pg" else "body"
    condition = _CONDITION[verb] if dialect != "ms" else ()
    identifier = lambda part: f"regexp_extract({part}, '^[A-Za-z_][A-Za-z0-9_]*')"
    return f"""
        SELECT target, version, filename, cast(row_number() OVER (PARTITION BY script ORDER BY line) - 1 AS int) AS pos,
               CASE WHEN len(parts) > 1 THEN {identifier('parts[1]')} ELSE '{DEFAULT_SCHEMA[dialect]}' END AS schema,
               {identifier('parts[least(len(parts), 2)]')} AS name, CASE kind WHEN 'proc' THEN 'procedure' ELSE kind END AS kind
        FROM (SELECT *, low[k] AS kind,
                     string_split(translate(words[k + 1 + CASE WHEN {_are('k + 1', condition)} THEN {len(condition)} ELSE 0 END], '"[]', ''), '.') AS parts
              FROM (SELECT *, j + CASE WHEN {_among('j', _SINGLE.get((verb, dialect), ''))} THEN 1 ELSE 0 END AS k
                    FROM (SELECT *, 2 + CASE WHEN {_are('2', _PAIR.get((verb, dialect), ()))} THEN 2 ELSE 0 END AS j
                          FROM (SELECT *, string_split_regex(lower(rest), '\\s+') AS low, string_split_regex(rest, '\\s+') AS words
                                FROM (SELECT *, trim(array_to_string(lines[line:], ' ')) AS rest
                                      FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS line
                                            FROM (SELECT target, version, filename, row_number() OVER () AS script,
                                                         string_split({text}, chr(10)) AS lines FROM {source}))
                                      WHERE lower(trim(lines[line])) LIKE '{verb}%'))
                          WHERE low[1] = '{verb}')))
        WHERE {_among('k', _KINDS[dialect])}"""


def judged(dialect: str, match: str = "o.target = c.target AND o.schema = c.schema AND o.name = c.name AND o.kind = c.kind") -> str:
    """CTEs up to ``report(target, version, file, status, detail)`` for ledger_d, corpus_d and objects_d."""
    same = "x.target = y.target AND x.schema = y.schema AND x.name = y.name AND x.kind = y.kind"
    return f"""
        creates AS ({objects(CREATE, dialect)}),
        drops AS ({objects(DROP, dialect)}),
        final_drops AS (
            SELECT x.* FROM drops x JOIN ledger_d l USING (target, version)
            WHERE l.status = 'applied' AND NOT EXISTS (
                SELECT 1 FROM creates y JOIN ledger_d m ON m.target = y.target AND m.version = y.version
                WHERE {same} AND m.status = 'applied' AND y.version >= x.version)),
        findings AS (
            SELECT c.target, c.version, c.pos,
                   concat(c.schema, '.', c.name, CASE WHEN l.status = 'applied' THEN ': claimed applied but missing'
                                                      ELSE ': claimed reverted but still exists' END) AS message
            FROM creates c JOIN ledger_d l USING (target, version)
            WHERE (l.status = 'reverted' AND EXISTS (SELECT 1 FROM objects_d o WHERE {match}))
               OR (l.status = 'applied' AND NOT EXISTS (SELECT 1 FROM objects_d o WHERE {match})
                   AND NOT EXISTS (SELECT 1 FROM final_drops x
                                   WHERE {same.replace('y.', 'c.')} AND x.version > c.version))),
        messages AS (SELECT target, version, string_agg(message, '; ' ORDER BY pos) AS found FROM findings GROUP BY 1, 2),
        details AS (
            SELECT l.target, l.version, coalesce(s.filename, '') AS file,
                   concat_ws('; ',
                       CASE WHEN s.version IS NULL AND l.status = 'applied'
                            THEN concat('version ', l.version, ' does not match any migration file in corpus') END,
                       CASE WHEN l.status = 'applied' AND l.content_sha256 <> sha256(s.body)
                            THEN 'migration file was edited after it was applied (content hash mismatch)' END,
                       m.found) AS detail
            FROM ledger_d l LEFT JOIN corpus_d s ON s.target = l.target AND s.version = l.version
            LEFT JOIN messages m ON m.target = l.target AND m.version = l.version),
        report AS (SELECT target, version, file, CASE WHEN detail = '' THEN 'OK' ELSE 'DRIFT' END AS status, detail FROM details)"""


# Pending scripts of the per-target corpus, and their count.
WAITING = """
        waiting AS (
            SELECT s.target, s.version, s.filename, s.body FROM corpus_d s LEFT JOIN cursor_d c USING (target)
            WHERE c.version IS NULL OR s.version > c.version),
        waiting_n AS (
            SELECT target, count(*) AS n_pending, min(version) AS next_version, min_by(filename, version) AS next_file
            FROM waiting GROUP BY target)"""

STANDING = """
        standing AS (
            SELECT t.target, coalesce(c.version, 0) AS current_version, c.version IS NOT NULL AS has_version,
                   coalesce(c.dirty, false) AND c.version IS NOT NULL AS dirty, coalesce(w.n_pending, 0) AS n_pending,
                   w.next_version, w.next_file, t.error
            FROM targets_d t LEFT JOIN cursor_d c ON c.target = t.target LEFT JOIN waiting_n w ON w.target = t.target)"""

# The ledger after a backfill.
SYNCED = """
        added AS (
            SELECT s.target, s.version FROM corpus_d s JOIN cursor_d c USING (target)
            WHERE NOT c.dirty AND s.version <= c.version
              AND NOT EXISTS (SELECT 1 FROM ledger_d l WHERE l.target = s.target AND l.version = s.version)),
        synced AS (
            SELECT target, version, status, recorded_at, note, content_sha256 FROM ledger_d
            UNION ALL
            SELECT target, version, 'applied', NULL, 'backfilled: applied before ledger existed', NULL FROM added)"""

LEDGER_TEXT = "target, version, status, cast(recorded_at AS varchar) AS recorded_at, note, content_sha256"


def upserted(ledger: str, changes: str, keep_first: bool = True) -> str:
    """A select that writes ``changes`` into ``ledger``."""
    sha = "CASE WHEN o.target IS NOT NULL THEN o.content_sha256 ELSE n.content_sha256 END"
    if not keep_first:
        sha = "CASE WHEN n.target IS NOT NULL THEN n.content_sha256 ELSE o.content_sha256 END"
    picks = ", ".join(
        f"CASE WHEN n.target IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in ("status", "recorded_at", "note")
    )
    return f"""
        SELECT coalesce(o.target, n.target) AS target, coalesce(o.version, n.version) AS version, {picks}, {sha} AS content_sha256
        FROM {ledger} o FULL JOIN {changes} n ON o.target = n.target AND o.version = n.version"""
