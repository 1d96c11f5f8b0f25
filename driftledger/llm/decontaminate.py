"""Benchmark decontamination by template windows; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftledger.llm.common import stored

WINDOW = 8
#: Words of a window that must be literal, not placeholders; a window with fewer must be equal word for word.
LITERAL = 4
#: Words that an item must have. Shorter ones would mark every document that holds a common word or two.
SHORTEST = 3

# The types of slots are single characters of the private use area, and units are those spelled here.
NUMBER, NAME, UNIT, START = "\ue000", "\ue001", "\ue002", "\ue003"
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams",
    "kilogram", "kilograms", "pound", "pounds", "ounce", "ounces", "ml", "l", "liter", "liters", "litre", "litres", "second",
    "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "cent",
    "cents", "dollar", "dollars", "euro", "euros", "percent", "degree", "degrees", "kmh", "mph", "meter", "meters", "metre", "metres",
)
#: (pattern, replacement) in this order. Numbers and names are marked at the places before them, which consume nothing.
MARKS = (
    (r"(^|[.!?][\p{P}]*[ \t\r\n]+|\n[ \t]*)(\p{Lu})", rf"$1{START}$2"),
    (r"(?=\p{N})(?<![\p{L}\p{N}.,:/])", NUMBER),
    (rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}\p{{N}}{START}'’-])", NAME),
)
#: A mark within a word ("U.S.", "end.Next") types nothing: the word is cut as its lower-case copy is.
TOKEN = rf"[{NUMBER}{NAME}]?[\p{{L}}\p{{M}}\p{{N}}]+(?:[.,:/'’-]{NAME}?[\p{{L}}\p{{M}}\p{{N}}]+)*"


def tokens(text: str | Column) -> Column:
    """Case-folded words; numbers, and capitalised words that start no sentence, have their type before them. The characters
    that stand for types are taken out of the text first."""
    marked = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    own = NUMBER + NAME + UNIT + START
    held = F.lit(False)
    for c in own:
        held = held | F.contains(marked, F.lit(c))
    marked = F.when(held, F.translate(marked, own, "")).otherwise(marked)
    for pattern, replacement in MARKS:
        marked = F.regexp_replace(marked, pattern, replacement)
    return F.regexp_extract_all(F.lower(F.upper(marked)), F.lit(TOKEN), F.lit(0))


def _folded(t: Column) -> Column:
    """A word without the marks of names, which depend on the case a text is written in."""
    return F.when(F.contains(t, F.lit(NAME)), F.translate(t, NAME, "")).otherwise(t)


def _emptied(t: Column) -> Column:
    """A folded word with its slot emptied: a number or unit is its type only. Names stay as they are."""
    return F.when(F.startswith(t, F.lit(NUMBER)), F.lit(NUMBER)).when(t.isin(*UNITS), F.lit(UNIT)).otherwise(t)


def _shaped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, words, plain, shape, kinds) of each text: folded words, the template, the template with the slots of names emptied
    too, and 0 for a literal word, 1 for a number or unit, 2 for a name and 3 for a name that is spelled like a unit."""
    found = rows.select(*keys, tokens("text").alias("found"))
    found = found.select(*keys, "found", F.transform("found", _folded).alias("words"))
    found = found.select(*keys, "found", "words", F.transform("words", _emptied).alias("plain"))
    named = F.zip_with("found", "plain", lambda t, p: F.when(F.startswith(t, F.lit(NAME)), F.lit(NAME)).otherwise(p))
    found = found.select(*keys, "words", "plain", named.alias("shape"))
    kind = lambda p, s: F.when(p.isin(NUMBER, UNIT), F.lit(1)).otherwise(F.lit(0)) + F.when(s == NAME, F.lit(2)).otherwise(F.lit(0))
    return found.select("*", F.zip_with("plain", "shape", kind).alias("kinds"))


def _each_window(probe, n: Column, starts: Column | None = None) -> Column:
    """The probes of each window of n words, or of those that begin at ``starts``; a window has up to two.

    The first is the template with literal names, or the words themselves if too few of them are literal. The second, with the
    slots of names emptied, is there if the window has names, and enough literal words without them.
    """

    def probes(i: Column) -> Column:
        at = lambda column: F.slice(column, i + 1, n)
        kinds = at("kinds")
        slots = F.when(
            F.array_contains(kinds, F.lit(1)) | F.array_contains(kinds, F.lit(3)), F.size(F.filter(kinds, lambda k: k % 2 == 1))
        ).otherwise(F.lit(0))
        named = F.array_contains(kinds, F.lit(2)) | F.array_contains(kinds, F.lit(3))
        first = probe(F.when(n - slots >= LITERAL, at("plain")).otherwise(at("words")), i, at)
        renames = named & (F.size(F.filter(kinds, lambda k: k == 0)) >= LITERAL)
        return F.when(renames, F.array(first, probe(at("shape"), i, at))).otherwise(F.array(first))

    last = F.size("shape") - n
    windows = F.when((n > 0) & (last >= 0), F.flatten(F.transform(F.sequence(F.lit(0), last) if starts is None else starts, probes)))
    return F.coalesce(windows, F.array())


def _windows(rows: DataFrame, keys: list[str], lengths: list[Column]) -> DataFrame:
    """(keys, pos, hash, shape, words, kinds) of each probe of the windows of ``rows``, as of ``_shaped``."""
    probe = lambda shape, i, at: F.struct(shape.alias("shape"), i.alias("pos"), at("words").alias("words"), at("kinds").alias("kinds"))
    exploded = rows.select(*keys, F.explode(F.concat(*[_each_window(probe, n) for n in lengths])).alias("window"))
    return exploded.select(*keys, "window.pos", F.xxhash64("window.shape").alias("hash"), "window.shape", "window.words", "window.kinds")


def _rolled(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """``rows`` with ``rolled__n`` for each length: the hash of each window of n words, from ``hashes`` of the words. Windows of
    twice the words are made from two, so each word is hashed once; windows of other lengths are put together from those."""

    def joined(x: str, y: str, by: int, m: int) -> Column:
        """Windows of ``by`` words, each with the one of the other column that begins behind it; m words in all."""
        last = F.greatest(F.size("hashes") - m + 1, F.lit(0))
        return F.zip_with(F.slice(x, F.lit(1), last), F.slice(y, F.lit(by + 1), last), lambda u, v: F.xxhash64(u, v))

    rows, size = rows.withColumn("power__1", F.col("hashes")), 1
    while 2 * size <= max(lengths):
        rows, size = rows.withColumn(f"power__{2 * size}", joined(f"power__{size}", f"power__{size}", size, 2 * size)), 2 * size
    for n in lengths:
        held = 1 << (n.bit_length() - 1)
        rows, size = rows.withColumn(f"rolled__{n}", F.col(f"power__{held}")), held
        while size > 1:
            size //= 2
            if n & size:
                rows, held = rows.withColumn(f"rolled__{n}", joined(f"rolled__{n}", f"power__{size}", held, held + size)), held + size
    return rows.drop(*[c for c in rows.columns if c.startswith("power__")])


def _hashes(rows: DataFrame, keys: list[str], lengths: list[int]) -> DataFrame:
    """(keys, probe) of all texts: hashes of windows, of either kind that ``_probes`` gives.

    Windows without slots and names, which most are, need hashes of single words only; where others have such a hash too, it
    does no harm. Only near slots and names are windows looked at one by one.
    """
    found = rows.select(*keys, tokens("text").alias("found"))
    found = found.select(*keys, "found", F.transform("found", lambda t: _emptied(_folded(t))).alias("plain"))
    slot = lambda t, p: (p == NUMBER) | (p == UNIT) | F.startswith(t, F.lit(NAME))
    marked = F.transform(F.zip_with("found", "plain", slot), lambda marks, j: F.when(marks, j))
    hashes = F.transform("plain", lambda p: F.xxhash64(p))
    found = found.select(*keys, "found", "plain", hashes.alias("hashes"), F.filter(marked, lambda j: j.isNotNull()).alias("marked"))
    # The arrays that single windows need are made where there is something to mark.
    near = F.size("marked") > 0
    found = found.select(*keys, "hashes", "marked", "found", "plain", F.when(near, F.transform("found", _folded)).alias("words"))
    named = F.zip_with("found", "plain", lambda t, p: F.when(F.startswith(t, F.lit(NAME)), F.lit(NAME)).otherwise(p))
    found = found.select(*keys, "hashes", "marked", "words", "plain", F.when(near, named).alias("shape"))
    kind = lambda p, s: F.when(p.isin(NUMBER, UNIT), F.lit(1)).otherwise(F.lit(0)) + F.when(s == NAME, F.lit(2)).otherwise(F.lit(0))
    found = found.select("*", F.when(near, F.zip_with("plain", "shape", kind)).alias("kinds"))
    found, probes = _rolled(found, lengths), []
    for n in lengths:
        last = F.size("hashes") - n
        starts = F.transform("marked", lambda j: F.sequence(F.greatest(j - n + 1, F.lit(0)), F.least(j, last)))
        probes += [F.col(f"rolled__{n}"), F.when(near & (last >= 0), _each_window(lambda shape, i, at: F.xxhash64(shape), F.lit(n), F.array_distinct(F.flatten(starts))))]
    found = found.select(*keys, F.concat(*[F.coalesce(p, F.array().cast("array<bigint>")) for p in probes]).alias("probes"))
    # An inner explode would have the optimizer test first, on the text, whether there are any, with all of this done twice.
    return found.select(*keys, F.explode_outer("probes").alias("probe"))


def _probes(items: DataFrame) -> DataFrame:
    """(probe): both hashes of the templates of windows: of the template as a whole, and as made from hashes of its words."""
    lengths = sorted(r[0] for r in items.select(F.size("shape")).distinct().collect())
    out = items.select(F.col("hash").alias("probe"))
    for n in lengths:
        own = items.where(F.size("shape") == n).select(F.transform("shape", lambda w: F.xxhash64(w)).alias("hashes"))
        out = out.unionByName(_rolled(own, [n]).select(F.get(f"rolled__{n}", F.lit(0)).alias("probe")))
    return out.distinct()


def _alike(slots: Column) -> Column:
    """Whether each value that the item has in the window stands for one value of the document. The other way round, two values
    of the item may have become equal."""
    sources = F.array_distinct(F.transform(slots, lambda s: F.struct(s["kind"], s["there"])))
    pairs = F.array_distinct(F.transform(slots, lambda s: F.struct(s["kind"], s["there"], s["here"])))
    return F.size(sources) == F.size(pairs)


def leaks(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, text_hash, item_id, offset, n_windows): aligned occurrences of benchmark items in documents.

    Texts become templates in which numbers, names and units are typed slots. Windows of eight template words with at least
    four literal ones are joined by hash and compared in full. A window with names has a second template that keeps them as
    words: names show by their capitals only, so a copy in capitals, in lower case or in title case meets the item there.
    Windows with fewer literal ones meet word for word. An item of fewer than eight words is one window of its whole length;
    items of fewer than ``shortest`` words are left out, see :func:`left_out`.

    A window must fill its slots alike: a value of the item always stands for the same value of the document there. So a
    question with other numbers or names is found, also where two different numbers became equal; a text that merely shares
    a form and contradicts itself is not. Slots that no window has together are not compared. n_windows counts the windows
    of one alignment, the distance between the places in the document and the item.

    Only documents with a window in common are looked at a second time. text_hash is set for rows without doc_id only, which
    are told apart by their texts; rows that share a doc_id are one document. Null and empty texts are in
    no match. Repeated items are separate items, unless item_id repeats. Characters of the text that stand for types here
    (U+E000 to U+E003) are taken for nothing.
    """
    whole = F.least(F.size("shape"), F.lit(WINDOW))
    shaped = _shaped(benchmark.select("item_id", "text"), ["item_id"]).where(F.size("shape") >= shortest)
    items = stored(_windows(shaped, ["item_id"], [whole]).distinct())
    lengths = sorted(r[0] for r in items.select(F.size("shape")).distinct().collect()) or [WINDOW]
    # Stored tables whose sizes are known: whether they are sent to all tasks or shuffled is for the optimizer to tell.
    wanted = stored(_probes(items))
    key = ["doc_id", "text_hash"]
    rows = docs.select("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("text_hash"), "text")

    touched = stored(_hashes(rows, key, lengths).join(wanted, "probe", "left_semi").select(*key).distinct())

    again = rows.join(
        touched.select(F.col("doc_id").alias("d__"), F.col("text_hash").alias("t__")),
        F.col("doc_id").eqNullSafe(F.col("d__")) & F.col("text_hash").eqNullSafe(F.col("t__")),
        "left_semi",
    )
    theirs = items.select("hash", "shape", "item_id", F.col("pos").alias("item_pos"), F.col("words").alias("item_words"), F.col("kinds").alias("item_kinds"))
    met = _windows(_shaped(again, key), key, [F.lit(n) for n in lengths]).drop("kinds").join(theirs, ["hash", "shape"])
    # What is a name is read from the item, as a document in another case shows no names.
    each = F.transform(
        F.arrays_zip(F.col("item_kinds").alias("kind"), F.col("words").alias("here"), F.col("item_words").alias("there")),
        lambda s: F.struct(
            F.when(s["kind"] > 0, F.when(F.startswith(s["there"], F.lit(NUMBER)), F.lit(NUMBER)).when(s["kind"] == 1, F.lit(UNIT)).otherwise(F.lit(NAME))).alias("kind"),
            s["here"].alias("here"), s["there"].alias("there"),
        ),
    )
    slots = F.filter(each, lambda s: s["kind"].isNotNull())
    lined = met.where(_alike(slots)).select(*key, "item_id", (F.col("pos") - F.col("item_pos")).alias("offset"), "item_pos")
    # The windows of one alignment are at most the words of the item.
    return lined.groupBy(*key, "item_id", "offset").agg(F.count_distinct("item_pos").alias("n_windows"))


def left_out(benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(item_id, n_words): items that have fewer words than ``shortest``, null and empty ones too, and so are in no match."""
    found = _shaped(benchmark.select("item_id", "text"), ["item_id"])
    return found.where(F.size("shape") < shortest).select("item_id", F.size("shape").cast("long").alias("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, contaminated, n_windows, item_ids): one row for each row of ``docs``; item_ids sorted and joined by commas.

    n_windows counts the matching windows of all items and alignments.
    """
    found = leaks(docs, benchmark, shortest).groupBy("doc_id", "text_hash").agg(
        F.sum("n_windows").alias("n_windows"), F.array_join(F.transform(F.array_sort(F.collect_set("item_id")), lambda i: i.cast("string")), ",").alias("item_ids")
    )
    found = stored(found.select(F.col("doc_id").alias("d__"), F.col("text_hash").alias("t__"), "n_windows", "item_ids"))
    rows = docs.select("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("text_hash"))
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d__")) & F.col("text_hash").eqNullSafe(F.col("t__")), "left")
    return both.select(
        "doc_id",
        F.col("n_windows").isNotNull().alias("contaminated"),
        F.coalesce("n_windows", F.lit(0)).alias("n_windows"),
        F.coalesce("item_ids", F.lit("")).alias("item_ids"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    found = stored(leaks(docs, benchmark, shortest).select(F.col("doc_id").alias("d__"), F.col("text_hash").alias("t__")).distinct())
    rows = docs.select(F.struct("*").alias("row__"))
    text_hash = F.when(F.col("row__.doc_id").isNull(), F.xxhash64("row__.text"))
    same = F.col("row__.doc_id").eqNullSafe(F.col("d__")) & text_hash.eqNullSafe(F.col("t__"))
    return rows.join(found, same, "left_anti").select("row__.*")
