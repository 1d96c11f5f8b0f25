"""The queries of this subpackage: each applies one operator to its whole table and derives the columns to compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftledger.llm import chat, decontaminate, forest, langid, mixing, neardup, revisits, sharding, spelling, substrings, tokengroups, toxicity, whitening


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    plan = mixing.mix(_read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each document without passages that repeat."""
    return substrings.without_repeats(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document."""
    found = toxicity.detect(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near duplicates of each document."""
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in eight shards of nearly equal bytes; equal texts stay together."""
    placed = sharding.shard(_read(spark, sf_dir, "documents"), 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that each document holds."""
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of each document."""
    found = langid.identify(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("segments").alias("n_segments"))


def captures(pages: DataFrame) -> DataFrame:
    """A crawl of the pages: each is captured in full at its page_id and answered not modified at two later times, once with
    the page's own validators and once, on another spelling of the URL, with those that pages of its hundred share."""
    etag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    day = F.concat(F.lit("day "), (F.col("page_id") % 7).cast("string"))
    full = pages.select(
        F.concat(F.lit("p"), F.col("page_id")).alias("record_id"), F.lit("response").alias("kind"), "url", F.col("page_id").alias("time"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), etag, F.lit("last-modified"), day, F.lit("date"), F.col("page_id").cast("string")).alias("headers"),
        F.md5("html").alias("digest"),
    )
    weak = pages.select(
        F.concat(F.lit("w"), F.col("page_id")), F.lit("revisit"), "url", F.col("page_id") + 50,
        F.create_map(F.lit("etag"), F.concat(F.lit("W/"), etag), F.lit("date"), (F.col("page_id") + 50).cast("string"), F.lit("server"), F.lit("x")), F.lit(None).cast("string"),
    )
    dated = pages.select(
        F.concat(F.lit("d"), F.col("page_id")), F.lit("revisit"), F.concat(F.upper(F.regexp_extract("url", "^[a-z]+://", 0)), F.regexp_replace("url", "^[a-z]+://", ""), F.lit("#d")), F.col("page_id") + 500,
        F.create_map(F.lit("last-modified"), F.concat(F.lit("day "), (F.floor(F.col("page_id") / 100) % 7).cast("string")), F.lit("expires"), F.lit("0")), F.lit(None).cast("string"),
    )
    return full.union(weak).union(dated)


def op3_resolve_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response that each not-modified capture of the pages stands for; headers as sorted text."""
    found = revisits.resolve(captures(_read(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda h: F.concat(h["key"], F.lit("="), h["value"]))
    return found.withColumn("headers", F.array_join(lines, ";"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found of every hundredth vector."""
    return forest.nearest(_read(spark, sf_dir, "embeddings"), 10, 100)


def op10_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds control strings, formatted and read back."""
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text")
    )
    messages = rows.unionByName(extra).withColumn("content", chat.text_part("text"))
    return chat.read_back(chat.format_chats(messages))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The more frequent spelling of each word of the documents."""
    return spelling.variants(_read(spark, sf_dir, "documents"))


def op12_similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of documents that are linked by a similarity of 0.9 on three-word shingles."""
    return tokengroups.similar(_read(spark, sf_dir, "documents"))


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of all embeddings on the eight components of largest variance."""
    found = whitening.whiten(_read(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_language, op3_resolve_revisits, op4_remove_repeats, op5_toxicity, op6_near_duplicates, op7_shard, op8_decontaminate, op9_nearest, op10_format_chats, op11_spelling_variants, op12_similar_documents, op13_whiten)}

ORACLES: dict[str, str] = {}

# Sources in turn by code point; the level at which targets stop is found among the sources sorted by bound over weight.
ORACLES["op1_mix_sources"] = r"""
    WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
    sources AS (
        SELECT source, cast(sum(size) AS bigint) AS source_size,
               [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight
        FROM sized GROUP BY source),
    sorted AS (
        SELECT *, row_number() OVER (ORDER BY 2 * source_size / weight, source) AS place, 2 * source_size AS bound,
               sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight FROM sources),
    levels AS (
        SELECT (1.5::DOUBLE * s.total - coalesce(sum(p.bound), 0)) / (s.all_weight - coalesce(sum(p.weight), 0)) AS level, s.place, s.bound, s.weight
        FROM sorted s LEFT JOIN sorted p ON p.place < s.place GROUP BY s.place, s.total, s.all_weight, s.bound, s.weight),
    level AS (SELECT level FROM levels WHERE bound > level * weight ORDER BY place LIMIT 1),
    targets AS (
        SELECT source, source_size, least(bound::DOUBLE, level * weight) AS target,
               ('0x' || substr(md5('1:' || coalesce('=' || source, 'null')), 1, 6))::BIGINT AS start
        FROM sorted, level),
    placed AS (
        SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS before FROM sized d),
    rated AS (
        SELECT p.doc_id, p.size, t.source_size, t.target, p.before, t.start,
               CASE WHEN t.source_size > 0 THEN least(cast(floor(t.target / t.source_size * 16777216) AS bigint), 33554432) ELSE 0 END AS rate
        FROM placed p JOIN targets t ON t.source IS NOT DISTINCT FROM p.source)
    SELECT doc_id, cast(size AS bigint) AS size, source_size, target,
           cast(size * (((before + 1) * rate + start) // 16777216 - (before * rate + start) // 16777216) AS bigint) AS taken
    FROM rated"""

ORACLES["op4_remove_repeats"] = r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
    later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
    gone AS (SELECT DISTINCT doc_id, i + k AS p FROM later, (SELECT unnest(range(20)) AS k)),
    each AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, cast(len(ws) AS bigint) AS n_words, cast(len(ws) - coalesce(n, 0) AS bigint) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)"""

ORACLES["op10_format_chats"] = r"""
    WITH rows AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
           cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
           cast(sum(17 + length(role) + 2 * length(text) - length(translate(text, '\|', ''))) AS bigint) AS formatted_chars
    FROM rows GROUP BY conv_id"""

# A set is a document's distinct three-word shingles, or its whole sequence; links are followed to the smallest id.
ORACLES["op12_similar_documents"] = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) ELSE [array_to_string(ws, ' ')] END) AS g
        FROM w WHERE len(ws) > 0),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM shingles a JOIN shingles b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
    SELECT w.doc_id, cast(coalesce(n, 0) AS bigint) AS n_shingles, component_id
    FROM w JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id) LEFT JOIN sizes USING (doc_id)"""
