"""Audit inputs derived from the benchmark tables, as SQL that Spark and the oracle both read.

The tables hold no scripts or ledgers, so orders become scripts, parts become columns and
customers become targets. Every derived table grows with the table it is made from.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

_TABLE = re.compile("@(" + "|".join(BASE) + r")\b")


def _definitions(text: str, sha) -> dict[str, str]:
    """Name -> query. ``text`` is the string type's name, ``sha(x)`` the SHA-256 call."""
    return {
        "scripts_d": f"""
            SELECT cast(o_custkey AS {text}) AS target, o_orderkey AS version, 'up' AS direction,
                   concat(lpad(cast(o_orderkey AS {text}), 14, '0'), '_step.up.sql') AS filename,
                   CASE o_orderkey % 6
                     WHEN 3 THEN concat('drop table if exists app."obj_', cast(o_orderkey % 4 AS {text}), '";')
                     WHEN 4 THEN concat('DROP VIEW IF EXISTS v_', cast(o_orderkey % 4 AS {text}), ';', chr(10),
                                        '  create or replace view v_', cast(o_orderkey % 4 AS {text}), ' as select 1;')
                     WHEN 5 THEN concat('ALTER TABLE app.obj_0 ADD y int;', chr(10), '/* was', chr(10),
                                        'CREATE TABLE app.decoy (id int);', chr(10), '*/')
                     ELSE concat('CREATE TABLE IF NOT EXISTS app.obj_', cast(o_orderkey % 4 AS {text}), ' (id int);')
                   END AS body,
                   o_orderstatus AS st, o_orderdate AS ts, o_custkey AS custkey
            FROM @orders""",
        "corpus_d": "SELECT target, version, direction, filename, body FROM scripts_d WHERE version % 17 <> 0",
        "down_d": f"""
            SELECT target, version, 'down' AS direction, replace(filename, '.up.', '.down.') AS filename,
                   concat('DROP TABLE IF EXISTS app.obj_', cast(version % 4 AS {text}), ';') AS body
            FROM scripts_d WHERE version % 17 <> 0 AND version % 19 <> 0""",
        "both_d": "SELECT * FROM corpus_d UNION ALL SELECT * FROM down_d",
        "twice_d": """
            SELECT * FROM corpus_d UNION ALL
            SELECT target, version, direction, replace(filename, '_step', '_the_step') AS filename,
                   concat(body, '-- again') AS body
            FROM corpus_d WHERE version % 23 = 0""",
        "ledger_d": f"""
            SELECT target, version, CASE WHEN st = 'F' THEN 'applied' ELSE 'reverted' END AS status,
                   cast(ts AS timestamp) AS recorded_at, 'seeded' AS note,
                   CASE WHEN version % 11 = 0 THEN NULL
                        WHEN version % 13 = 0 THEN {sha("concat(body, '-- edited')")}
                        ELSE {sha("body")} END AS content_sha256
            FROM scripts_d WHERE st IN ('F', 'P')""",
        "cursor_d": """
            SELECT target, max(CASE WHEN st = 'F' THEN version END) AS version, max(custkey) % 23 = 0 AS dirty
            FROM scripts_d GROUP BY target""",
        "objects_d": f"""
            SELECT DISTINCT target, 'app' AS schema, concat('obj_', cast(version % 4 AS {text})) AS name, 'table' AS kind
            FROM scripts_d WHERE version % 6 IN (0, 1, 2) AND (custkey + version % 4) % 3 <> 0
            UNION ALL
            SELECT DISTINCT target, 'public' AS schema, concat('v_', cast(version % 4 AS {text})) AS name, 'view' AS kind
            FROM scripts_d WHERE version % 6 = 4 AND (custkey + version % 4) % 3 <> 0""",
        "changes_d": f"""
            SELECT target, version, CASE WHEN version % 2 = 0 THEN 'applied' ELSE 'reverted' END AS status,
                   cast('2026-01-01 12:00:00' AS timestamp) AS recorded_at, 'changed' AS note,
                   {sha(f"concat('new', cast(version AS {text}))")} AS content_sha256
            FROM scripts_d WHERE version % 3 = 0""",
        "outside_d": f"""
            SELECT target, CASE WHEN version % 397 = 0 THEN -version WHEN version % 401 = 0 THEN NULL ELSE version END AS version,
                   CASE WHEN version % 409 = 0 THEN 'open' WHEN version % 2 = 0 THEN 'applied' ELSE 'reverted' END AS status,
                   cast('2026-01-01 12:00:00' AS timestamp) AS recorded_at, 'outside' AS note,
                   {sha(f"concat('out', cast(version AS {text}))")} AS content_sha256
            FROM scripts_d WHERE version % 3 <> 1
            UNION ALL
            SELECT target, version, 'applied' AS status, cast('2026-01-01 12:00:00' AS timestamp) AS recorded_at, 'again' AS note,
                   {sha(f"concat('out', cast(version AS {text}))")} AS content_sha256
            FROM scripts_d WHERE version % 419 = 0""",
        "script_files_d": f"""
            SELECT cast(p_partkey % 40 AS {text}) AS target,
                   concat(CASE p_partkey % 7 WHEN 0 THEN '.' WHEN 1 THEN '_' WHEN 2 THEN 'k=' ELSE '' END,
                          cast(p_partkey AS {text}), '_', CASE WHEN p_size % 3 = 0 THEN replace(p_name, ' ', '%20') ELSE p_name END,
                          CASE WHEN p_size % 5 = 0 THEN '.down.sql' ELSE '.up.sql' END) AS filename,
                   CASE WHEN p_size % 4 = 0 THEN '' ELSE concat('-- ', p_type, chr(13), chr(10), 'é ', p_brand) END AS body
            FROM @part""",
        "targets_d": f"""
            SELECT cast(c_custkey AS {text}) AS target,
                   CASE c_custkey % 3 WHEN 0 THEN 'postgres' WHEN 1 THEN 'sqlserver' ELSE 'sqlite' END AS engine,
                   CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('DB_', cast(c_custkey AS {text})) END AS url_env,
                   c_custkey % 4 = 0 AS protected,
                   CASE WHEN c_custkey % 29 = 0 THEN 'ping failed: refused' END AS error
            FROM @customer""",
        "columns_d": f"""
            SELECT concat('t', cast(p_partkey % 4 AS {text})) AS target, concat('s', cast(p_size % 3 AS {text})) AS schema,
                   concat(lower(replace(p_brand, '#', '_')), '_',
                          cast(cast(floor(p_partkey / 1000) AS bigint) AS {text})) AS "table",
                   cast(p_partkey % 1000 + 1 AS int) AS ordinal,
                   concat(p_name, ' ', cast(p_partkey AS {text})) AS "column",
                   CASE p_partkey % 12 WHEN 0 THEN 'bigint' WHEN 1 THEN 'varchar(40)' WHEN 2 THEN 'decimal(10,2)'
                        WHEN 3 THEN 'timestamp with time zone' WHEN 4 THEN 'jsonb' WHEN 5 THEN 'uuid'
                        WHEN 6 THEN 'boolean' WHEN 7 THEN 'double precision' WHEN 8 THEN 'bytea'
                        WHEN 9 THEN 'tsvector' WHEN 10 THEN 'Text' ELSE 'geometry' END AS data_type,
                   p_size % 2 = 0 AS nullable
            FROM @part""",
        "names_d": f"""
            SELECT p_partkey,
                   CASE p_partkey % 8
                     WHEN 0 THEN concat(cast(p_partkey AS {text}), 'fa_codes')
                     WHEN 1 THEN replace(p_name, ' ', '-')
                     WHEN 2 THEN concat(p_name, '.', p_type)
                     WHEN 3 THEN CASE WHEN p_size % 2 = 0 THEN 'class' ELSE 'None' END
                     WHEN 4 THEN concat('_', p_name, '__', p_brand)
                     WHEN 5 THEN CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN '- _' ELSE 'function' END
                     WHEN 6 THEN concat(replace(p_name, ' ', '_'), '_', cast(p_partkey AS {text}))
                     ELSE p_name END AS raw_name
            FROM @part""",
        "files_d": f"""
            SELECT cast(p_partkey % 10 AS {text}) AS target,
                   CASE p_partkey % 9
                     WHEN 0 THEN concat('.hidden_', cast(p_partkey AS {text}))
                     WHEN 1 THEN concat('no_version_', cast(p_partkey AS {text}), '.sql')
                     WHEN 2 THEN concat(lpad(cast(p_partkey AS {text}), 30, '9'), '_big.up.sql')
                     WHEN 3 THEN concat(lpad(cast(p_partkey - p_partkey % 90 AS {text}), 14, '0'), '_', replace(p_name, ' ', '-'),
                                        '_', cast(p_partkey AS {text}), '.up.sql')
                     WHEN 4 THEN concat(cast(p_partkey - p_partkey % 90 AS {text}), '_', replace(p_name, ' ', '_'), '_',
                                        cast(p_partkey AS {text}), '.up.sql')
                     WHEN 5 THEN concat(cast(p_partkey AS {text}), '_', p_name, '.up.sql')
                     WHEN 6 THEN CASE WHEN p_size % 2 = 0 THEN 'README.md' ELSE concat('readme_', cast(p_partkey AS {text})) END
                     ELSE concat(cast(p_partkey AS {text}), '_ok.down.sql') END AS filename,
                   CASE WHEN p_size % 4 = 0 THEN concat(' ', chr(9), chr(160), chr(10)) ELSE p_type END AS body
            FROM @part""",
        "instructions_d": f"""
            SELECT cast(c_custkey AS {text}) AS target,
                   CASE c_custkey % 7
                     WHEN 0 THEN concat(cast(c_custkey AS {text}), ':applied,', cast(c_custkey + 1 AS {text}), ':reverted')
                     WHEN 1 THEN concat(cast(c_custkey AS {text}), ':reverted')
                     WHEN 2 THEN concat(cast(c_custkey AS {text}), ':done')
                     WHEN 3 THEN concat('x', cast(c_custkey AS {text}), ':applied,7:reverted')
                     WHEN 4 THEN cast(c_custkey AS {text})
                     WHEN 5 THEN concat('5:applied,05:reverted,', cast(c_custkey AS {text}), ':applied')
                     ELSE concat('99999999999999999999:applied,', cast(c_custkey AS {text}), ':applied:') END AS instructions
            FROM @customer""",
        "wanted_d": """
            SELECT target, version, CASE WHEN version % 5 = 0 THEN 'reverted' ELSE 'applied' END AS status
            FROM scripts_d WHERE custkey % 3 <> 0 AND version % 7 = 0""",
        "directory_d": f"""
            SELECT cast(n_nationkey * 5 AS bigint) AS version, 'up' AS direction,
                   concat(lpad(cast(n_nationkey * 5 AS {text}), 14, '0'), '_', lower(n_name), '.up.sql') AS filename,
                   concat('CREATE TABLE ', n_name, ' (id int);') AS body
            FROM @nation""",
        "places_d": f"""
            SELECT cast(c_custkey AS {text}) AS target,
                   CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey % 130 END AS version,
                   c_custkey % 13 = 0 AS dirty
            FROM @customer""",
        "series_d": f"""
            SELECT p_partkey * 3 AS version, 'up' AS direction,
                   concat(cast(p_partkey * 3 AS {text}), '_', replace(p_name, ' ', '_'), '.up.sql') AS filename,
                   p_type AS body
            FROM @part""",
        "marks_d": f"""
            SELECT cast(c_custkey AS {text}) AS target,
                   CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey * 4 END AS version, false AS dirty
            FROM @customer""",
        "doc_corpus_d": """
            SELECT source AS target, doc_id AS version, 'up' AS direction,
                   concat(cast(doc_id AS STR), '_doc.up.sql') AS filename, text AS body
            FROM @documents WHERE doc_id % 13 <> 0""".replace("STR", text),
        "doc_ledger_d": f"""
            SELECT source AS target, doc_id AS version, CASE WHEN doc_id % 5 = 0 THEN 'reverted' ELSE 'applied' END AS status,
                   cast(NULL AS timestamp) AS recorded_at, lang AS note,
                   CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 = 0 THEN {sha("concat(text, ' ')")}
                        ELSE {sha("text")} END AS content_sha256
            FROM @documents""",
        "page_corpus_d": f"""
            SELECT cast(page_id % 8 AS {text}) AS target, page_id AS version, 'up' AS direction,
                   concat(cast(page_id AS {text}), '_page.up.sql') AS filename, html AS body
            FROM @pages WHERE page_id % 9 <> 0""",
        "page_ledger_d": f"""
            SELECT cast(page_id % 8 AS {text}) AS target, page_id AS version, 'applied' AS status,
                   cast(NULL AS timestamp) AS recorded_at, url AS note,
                   CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 10 = 0 THEN {sha("concat(html, '!')")}
                        ELSE {sha("html")} END AS content_sha256
            FROM @pages""",
        "log_d": f"""
            SELECT cast(user_id AS {text}) AS target, event_id % 7 AS version,
                   CASE WHEN value >= 5 THEN 'applied' ELSE 'reverted' END AS status, cast(ts AS timestamp) AS recorded_at,
                   event_type AS note, CASE WHEN event_id % 4 = 0 THEN NULL ELSE {sha("props")} END AS content_sha256,
                   event_id
            FROM @events""",
        "raw_ledger_d": f"""
            SELECT cast(o_custkey AS {text}) AS target,
                   CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN -o_orderkey ELSE o_orderkey END AS version,
                   CASE o_orderstatus WHEN 'F' THEN 'applied' WHEN 'P' THEN 'reverted' ELSE 'open' END AS status
            FROM @orders""",
        "seeds_d": "SELECT doc_id, replace(text, chr(10), concat(chr(10), ' go', chr(9), chr(10), chr(10))) AS seed FROM @documents",
        "masked_d": """
            SELECT doc_id, lang, source, replace(text, '$', '%') AS words,
                   concat('-- ', lang, chr(10), 'SELECT ', chr(39), replace(replace(text, '$', '%'), chr(39), concat(chr(39), chr(39))),
                          chr(39), ' AS "it', chr(39), 's", E', chr(39), source, chr(92), chr(39), chr(39), ' || $$;', chr(39), '$$;', chr(10),
                          '/* a /* ', lang, ' */ ', chr(10), source, ' */ CREATE TABLE t (id int); $f1$ ',
                          replace(text, '$', '%'), ' $f1$ $1') AS script
            FROM @documents""",
        "procs_d": f"""
            SELECT cast(p_partkey % 5 AS {text}) AS target, p_partkey,
                   concat('s', cast(p_size % 3 AS {text})) AS schema,
                   concat(CASE WHEN p_partkey % 2 = 0 THEN 'usp_' ELSE 'sp_' END, 'load_', cast(p_partkey AS {text})) AS name,
                   CASE p_partkey % 4
                     WHEN 0 THEN concat('CREATE PROCEDURE p AS SELECT TRY_CONVERT(BIGINT, qty) AS qty', chr(10),
                                        'FROM OPENJSON(@j) WITH (', chr(10), '  only_one NVARCHAR(9)', chr(10), ') a,', chr(10),
                                        'OPENJSON( @j )', chr(10), 'WITH (', chr(10), '  qty NVARCHAR(20) ''$.order.qty',
                                        cast(p_size AS {text}), ''',', chr(10), '  [price] DECIMAL(10, 2),', chr(10),
                                        '  Price2 DATE ''$.PRICE'',', chr(10), '  doc VARBINARY(10) ''$.doc''', chr(10), ');')
                     WHEN 1 THEN concat('SELECT TRY_CAST(JSON_VALUE(j.value, ''$.a', cast(p_size AS {text}),
                                        ''') AS INT) AS a, JSON_VALUE(j.value, ''$.x.b'') AS b, ', p_name, chr(10),
                                        'FROM OPENJSON(@j) AS j')
                     WHEN 2 THEN concat('SELECT JSON_VALUE(v, ''$.c'') FROM ', p_type)
                     ELSE concat('SELECT ''OPENJSON'', ''', p_name, ''';') END AS definition
            FROM @part""",
    }


DEFINITIONS = {
    "spark": _definitions("string", lambda x: f"sha2({x}, 256)"),
    "duckdb": _definitions("varchar", lambda x: f"sha256({x})"),
}


def _needed(query: str, engine: str) -> list[str]:
    """Derived tables that a query reads, directly or not, in definition order."""
    known, found, todo = DEFINITIONS[engine], set(), [query]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        new = [n for n in known if n in words and n not in found]
        found.update(new)
        todo += [known[n] for n in new]
    # Every table is defined after the tables it reads.
    return [n for n in known if n in found]


def _with(query: str, engine: str) -> str:
    tables = [f"{n} AS ({DEFINITIONS[engine][n]})" for n in _needed(query, engine)]
    if not tables:
        return query
    head = "WITH " + ",\n".join(tables)
    body = query.strip()
    return f"{head},\n{body[4:].lstrip()}" if body.upper().startswith("WITH") else f"{head}\n{body}"


def oracle(query: str) -> str:
    """The query for DuckDB, with the derived tables it reads in front."""
    return _TABLE.sub(r"\1", _with(query, "duckdb"))


def derived(spark: SparkSession, base: Mapping[str, DataFrame], query: str) -> DataFrame:
    """A derived table (by name) or a query over derived and base tables (the latter written @name)."""
    sql = query if " " in query.strip() else f"SELECT * FROM {query}"
    sql = _with(sql, "spark").replace('"table"', "`table`").replace('"column"', "`column`")
    used = {name: base[name] for name in _TABLE.findall(sql)}
    return spark.sql(_TABLE.sub(r"{\1}", sql), **used)
