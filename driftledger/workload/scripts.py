"""Queries on scripts, their names and texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftledger.functions import text
from driftledger.functions.masking import mask_text
from driftledger.operators import scripts as S
from driftledger.plans.lint import lint as lint_files, lintable
from driftledger.sources import corpus as C
from driftledger.sources import folder
from driftledger.sources.shared import work_folder
from driftledger.workload import oracle_sql as O
from driftledger.workload.registry import NOW, query


@query("SELECT doc_id, sha256(text) AS content_sha256 FROM documents")
def content_hash(t):
    return t.base("documents").select("doc_id", text.content_hash("text").alias("content_sha256"))


@query("""
    SELECT target, filename, cast(CASE WHEN v <= 18446744073709551615 THEN v END AS varchar) AS version, direction
    FROM (SELECT target, filename, try_cast(regexp_extract(filename, '^(\\d+)_.+\\.(up|down)\\.sql$', 1) AS hugeint) AS v,
                 nullif(regexp_extract(filename, '^(\\d+)_.+\\.(up|down)\\.sql$', 2), '') AS direction
          FROM files_d)""")
def parse_script_name(t):
    name = text.parse_script_name(F.col("filename"))
    return t.files_d.select("target", "filename", name["version"].cast("string").alias("version"), name["direction"].alias("direction"))


@query("""
    SELECT target, filename, direction, cast(try_cast(regexp_extract(filename, '^(\\d+)_.+\\.(up|down)\\.sql$', 1) AS bigint) AS bigint) AS version
    FROM (SELECT *, regexp_extract(filename, '^(\\d+)_.+\\.(up|down)\\.sql$', 2) AS direction FROM files_d)
    WHERE try_cast(regexp_extract(filename, '^(\\d+)_.+\\.(up|down)\\.sql$', 1) AS bigint) IS NOT NULL""")
def corpus_from_files(t):
    return C.corpus_from_files(t.files_d).select("target", "filename", "direction", "version")


@query("SELECT target, version, filename FROM both_d WHERE direction = 'down'")
def down_list(t):
    return C.corpus_down(t.both_d).select("target", "version", "filename")


@query("SELECT target, version FROM both_d WHERE direction = 'up'")
def versions(t):
    return C.versions(t.both_d)


@query("""
    SELECT k.target, k.version, f.filename,
           CASE WHEN f.filename IS NULL THEN concat('version ', k.version, ' does not match any migration file in corpus') END AS error
    FROM (SELECT target, version FROM scripts_d) k
    LEFT JOIN (SELECT target, version, max(filename) AS filename FROM twice_d GROUP BY 1, 2) f
      ON f.target = k.target AND f.version = k.version""")
def find_scripts(t):
    return S.find(t.twice_d, t.sql("SELECT target, version FROM scripts_d"))


@query("""
    SELECT target, n AS next_version, lpad(cast(n AS varchar), 14, '0') || '_add_widget_two.up.sql' AS filename,
           CASE WHEN n IS NULL THEN 'no version is left above 9223372036854775807' END AS error
    FROM (SELECT target, CASE WHEN max(v) < 9223372036854775807 THEN greatest(20260101120000, max(v) + 1) END AS n
          FROM (SELECT target, CASE WHEN target = (SELECT min(target) FROM corpus_d) THEN 9223372036854775807 ELSE version END AS v FROM corpus_d)
          GROUP BY target)""")
def next_script_name(t):
    """One target has the highest version there is."""
    first = t.corpus_d.agg(F.min("target").alias("_first"))
    rows = t.both_d.join(F.broadcast(first), F.col("target") == F.col("_first"), "left")
    top = F.when(F.col("_first").isNotNull(), F.lit((1 << 63) - 1)).otherwise(F.col("version"))
    return S.next_script_name(rows.withColumn("version", top).drop("_first"), NOW, "  add widget two\n")


@query("""
    SELECT s.target, s.version, s.filename FROM corpus_d s LEFT JOIN cursor_d c USING (target)
    WHERE c.version IS NULL OR s.version > c.version""")
def pending(t):
    return S.pending(t.both_d, t.cursor_d)


@query("""
    SELECT p.target, s.version, s.filename FROM directory_d s, places_d p
    WHERE p.version IS NULL OR s.version > p.version""")
def pending_shared(t):
    return S.pending(t.directory_d, t.places_d)


@query("""
    SELECT m.target, s.n - coalesce(s2.n, 0) AS n_pending FROM marks_d m,
         (SELECT count(*) AS n FROM series_d) s,
         LATERAL (SELECT count(*) AS n FROM series_d x WHERE x.version <= m.version) s2
    WHERE s.n - coalesce(s2.n, 0) > 0""")
def pending_counts_shared(t):
    return S.pending_summary(t.series_d, t.marks_d).select("target", "n_pending")


@query(f"""
    WITH {O.WAITING.strip()}
    SELECT w.target, w.version, w.filename, w.body, cast(NULL AS varchar) AS error
    FROM waiting w LEFT JOIN cursor_d c USING (target) WHERE NOT (c.dirty AND c.version IS NOT NULL)
    UNION ALL
    SELECT target, NULL, NULL, NULL, concat('migration cursor is dirty at version ', version, '; repair the target to resolve it')
    FROM cursor_d WHERE dirty AND version IS NOT NULL""")
def pending_scripts(t):
    return S.pending_scripts(t.both_d, t.cursor_d)


@query("SELECT target, version, dirty AND version IS NOT NULL AS refused FROM cursor_d")
def split_dirty(t):
    clean, dirty = S.split_dirty(t.cursor_d)
    no, yes = F.lit(False).alias("refused"), F.lit(True).alias("refused")
    return clean.select("target", "version", no).unionByName(dirty.select("target", "version", yes))


@query("""
    SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS int) AS pos, batch
    FROM (SELECT doc_id, i, regexp_replace(piece, '^[\\s\\x0b\\x{85}\\p{Z}]+|[\\s\\x0b\\x{85}\\p{Z}]+$', '', 'g') AS batch
          FROM (SELECT doc_id, unnest(p) AS piece, unnest(range(len(p))) AS i
                FROM (SELECT doc_id, string_split_regex(seed, '(?im)^\\s*GO\\s*$') AS p FROM seeds_d)))
    WHERE batch <> ''""")
def split_batches(t):
    return text.split_batches(t.seeds_d, "seed")


def _blank(expression: str) -> str:
    lines = f"list_transform(string_split({expression}, chr(10)), lambda line: repeat(' ', strlen(line)))"
    return f"array_to_string({lines}, chr(10))"


_QUOTED = "concat(chr(39), replace(words, chr(39), concat(chr(39), chr(39))), chr(39))"


@query(f"""
    SELECT doc_id, concat({_blank("concat('-- ', lang)")}, chr(10), 'SELECT ', {_blank(_QUOTED)}, ' AS "it', chr(39), 's", ',
                          repeat(' ', 5 + strlen(source)), ' || ', repeat(' ', 6), ';', chr(10),
                          {_blank("concat('/* a /* ', lang, ' */ ', chr(10), source, ' */')")},
                          ' CREATE TABLE t (id int); ', {_blank("concat('$f1$ ', words, ' $f1$')")}, ' $1') AS masked
    FROM masked_d""")
def mask_script_text(t):
    return t.masked_d.select("doc_id", mask_text(F.col("script")).alias("masked"))


_LINT = "^(\\d+)_([a-zA-Z0-9_-]+)\\.(up|down)\\.sql$"


@query(f"""
    WITH looked AS (
        SELECT target, filename, body, regexp_extract(filename, '{_LINT}', 1) AS digits, regexp_extract(filename, '{_LINT}', 3) AS direction
        FROM files_d WHERE filename NOT LIKE '.%' AND lower(filename) <> 'readme.md'),
    parsed AS (SELECT *, CASE WHEN try_cast(digits AS hugeint) <= 18446744073709551615 THEN try_cast(digits AS hugeint) END AS version FROM looked),
    ups AS (SELECT target, version, filename FROM parsed WHERE direction = 'up' AND version IS NOT NULL),
    twice AS (SELECT target, version, string_agg(filename, ', ' ORDER BY filename) AS names FROM ups GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT target, filename AS file, cast(version AS varchar) AS version, rule, message FROM (
        SELECT target, filename, version,
               CASE WHEN direction = '' THEN 'invalid-filename-format' WHEN version IS NULL THEN 'invalid-version-number'
                    WHEN regexp_full_match(body, '[\\s\\x0b\\x{{85}}\\p{{Z}}]*') THEN 'empty-migration-file' END AS rule,
               CASE WHEN direction = '' THEN 'filename must match ''{{timestamp}}_{{name}}.up.sql'' or ''{{timestamp}}_{{name}}.down.sql'''
                    WHEN version IS NULL THEN concat('cannot parse version number "', digits, '": strconv.ParseUint: parsing "', digits, '": value out of range')
                    ELSE 'migration file is empty' END AS message
        FROM parsed) WHERE rule IS NOT NULL
    UNION ALL
    SELECT u.target, u.filename, cast(u.version AS varchar), 'duplicate-version-number',
           concat('version ', u.version, ' is duplicated across multiple files: ', names)
    FROM ups u JOIN twice t ON t.target = u.target AND t.version = u.version""")
def lint(t):
    return lint_files(t.files_d).withColumn("version", F.col("version").cast("string"))


@query("SELECT count(*) AS total FROM files_d WHERE filename NOT LIKE '.%' AND lower(filename) <> 'readme.md'")
def lint_total(t):
    return lintable(t.files_d).agg(F.count(F.lit(1)).alias("total"))


@query("""
    SELECT target, filename, sha256(body) AS sha256, false AS refused FROM script_files_d WHERE target <> '3'
    UNION ALL SELECT DISTINCT target, NULL AS filename, NULL AS sha256, true AS refused FROM script_files_d WHERE target = '3'""")
def folder_scan(t):
    """Scripts written to a folder for each target and scanned; target 3 has a file where its folder should be, and one target
    has no folder."""
    root = f"{work_folder(t.session)}/folders-{uuid.uuid4().hex}"
    named = t.script_files_d.withColumn("folder", F.concat(F.lit(f"{root}/"), "target"))
    folder.write_files(named.filter("target <> '3'"))
    folder.write_files(named.filter("target = '3'").limit(1).select(F.lit(root).alias("folder"), F.col("target").alias("filename"), "body"))
    absent = t.session.range(1).select(F.lit("none").alias("target"), F.lit(f"{root}/none").alias("folder"))
    files, refused = folder.split_files(folder.scan_folders(named.select("target", "folder").distinct().unionByName(absent)))
    files = files.select("target", "filename", text.content_hash("body").alias("sha256"), F.lit(False).alias("refused"))
    return files.unionByName(refused.select("target", "filename", F.lit(None).cast("string").alias("sha256"), F.lit(True).alias("refused")))


@query("""
    SELECT cast(p_partkey % 10 AS varchar) AS target, concat('1000000000000', lpad(cast(p_partkey AS varchar), 7, '0'), '_x.up.sql') AS filename,
           concat('1000000000000', lpad(cast(p_partkey AS varchar), 7, '0')) AS version,
           concat('migration version 1000000000000', lpad(cast(p_partkey AS varchar), 7, '0'), ' exceeds the ledger''s range') AS error
    FROM part WHERE p_partkey % 3 = 0""")
def out_of_range(t):
    files = t.sql("""
        SELECT cast(p_partkey % 10 AS string) AS target, p_type AS body,
               concat(CASE WHEN p_partkey % 3 = 0 THEN concat('1000000000000', lpad(cast(p_partkey AS string), 7, '0'))
                           ELSE cast(p_partkey AS string) END, '_x.up.sql') AS filename
        FROM @part""")
    return C.out_of_range(files).withColumn("version", F.col("version").cast("string"))
