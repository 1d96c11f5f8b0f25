"""Spelling variants: words one edit apart, found by blocked Gram matrices of their letter counts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftledger.llm.common import stored

#: Words have at least so many code points and occurrences; a form has at least FORM times the occurrences of its word.
LETTERS, OCCURRENCES, FORM = 6, 5, 5
#: One in so many (document, run) loses a letter, and so many distinct words are gathered in a task before they are sent on.
SLIP, GATHERED = 199, 1 << 18
#: Kinds of letters that are counted to part a length into blocks; most words of a block side in one matrix product; about
#: as many words as a task multiplies.
KINDS, BLOCK, ROWS = 6, 2048, 1 << 16
_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LETTERS},}}")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def occurring(docs: DataFrame) -> DataFrame:
    """(word, n): the runs of letters of all texts, as ``variants`` counts them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                lower = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
                own = crc32(b":" if doc_id is None else f"{doc_id}:".encode())
                for run, n in Counter(_RUN.findall(lower)).items():
                    h = crc32(run.encode(), own)
                    if h % SLIP == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < LETTERS:
                            continue
                    found[run] += n
                if len(found) >= GATHERED:
                    yield sent()
        yield sent()

    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


def block(word: str | Column = "word") -> Column:
    """The length of a word, and how many of its letters are of each kind but the last."""
    kinds = ["".join(chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)] if c % KINDS == k) for k in range(KINDS - 1)]
    return F.array(F.length(word).cast("int"), *[F.length(word).cast("int") - F.length(F.translate(word, k, "")).cast("int") for k in kinds])


def _adjacent(blocks: DataFrame) -> DataFrame:
    """(left, right, n_left, n_right): each two blocks, or one with itself, that can hold words one edit apart.

    An inserted letter makes a word longer by one and raises the count of one kind; a replaced one moves a letter from one
    kind to another, or leaves the counts. Of two blocks the left one is shorter, or the smaller array.
    """
    zero = [0] * KINDS
    steps = [zero]
    for k in range(KINDS):  # kind 0 is counted by no entry but the length
        steps.append([1, *[int(k == i) for i in range(1, KINDS)]])
        steps += [[0, *[int(k == i) - int(j == i) for i in range(1, KINDS)]] for j in range(KINDS) if j != k]
    moved = F.array(*[F.array(*[F.col("block")[i] + by for i, by in enumerate(s)]) for s in steps])
    left = blocks.select(F.col("block").alias("left"), F.col("n").alias("n_left"), F.explode(moved).alias("right"))
    return left.where("left <= right").join(blocks.select(F.col("block").alias("right"), F.col("n").alias("n_right")), "right")


class Words:
    """Words of one length, as letters and as counts of letters."""

    def __init__(self, words: list[str]):
        self.letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)
        n, length = self.letters.shape
        places = np.arange(n)[:, None] * 256 + self.letters
        self.counts = np.bincount(places.ravel(), minlength=n * 256).reshape(n, 256)[:, 97:].astype(np.float32)
        self.squares = (self.counts**2).sum(axis=1)


def pairs(left: Words, right: Words) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``left`` and ``right``, which has words as long or longer by one, that are exactly one edit apart.

    One edit changes the squared distance of the counts to 0 or 2 for a replaced letter, to 1 for an inserted one; so what the
    Gram matrix shows to be farther apart is no pair, and the others are compared letter by letter.
    """
    far = left.squares[:, None] + right.squares[None, :] - 2 * (left.counts @ right.counts.T)
    a, b = np.nonzero(far <= 2)
    x, y = left.letters[a], right.letters[b]
    length = x.shape[1]
    if y.shape[1] == length:
        kept = (x != y).sum(axis=1) == 1
    else:
        before = np.logical_and.accumulate(x == y[:, :length], axis=1).sum(axis=1)
        after = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
        kept = before + after >= length
    return a[kept], b[kept]


def near(words: DataFrame) -> DataFrame:
    """(word, other, n): both ways, the words exactly one edit apart, with the occurrences of the other."""
    keyed = stored(words.withColumn("block", block()))
    blocks = stored(keyed.groupBy("block").agg(F.count("*").alias("n")))
    parts = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")
    met = _adjacent(blocks).select("left", "right", parts("n_left").alias("i"), parts("n_right").alias("j"), (F.col("n_left") + F.col("n_right")).alias("n"))
    met = stored(met)
    tasks = max(1, int((met.agg(F.sum(F.col("n") * F.greatest("i", "j"))).first()[0] or 0) // ROWS))
    deal = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = keyed.select("word", "n", F.col("block").alias("left")).join(met.drop("n"), "left").withColumn("part", deal("i")).withColumn("meets", each("j"))
    own = own.select("word", "n", "left", "right", F.lit(0).alias("side"), F.col("part").alias("i"), F.col("meets").alias("j"))
    other = keyed.select("word", "n", F.col("block").alias("right")).join(met.drop("n"), "right").withColumn("part", deal("j")).withColumn("meets", each("i"))
    other = other.select("word", "n", "left", "right", F.lit(1).alias("side"), F.col("meets").alias("i"), F.col("part").alias("j"))
    rows = own.unionByName(other).withColumn("product", F.xxhash64("left", "right", "i", "j"))
    rows = rows.select("word", "n", "product", "side", "i", "j", (F.col("left") == F.col("right")).alias("same"), F.pmod("product", F.lit(tasks)).alias("task"))

    def multiply(table: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        table = table.sort_by([("product", "ascending"), ("side", "ascending")])
        words, n = table["word"].to_pylist(), table["n"].to_numpy()
        product, side, same, i, j = (table[c].to_numpy() for c in ("product", "side", "same", "i", "j"))
        edges = np.flatnonzero(np.diff(product, prepend=product[0] - 1))
        for begin, end in zip(edges, [*edges[1:], len(words)], strict=True):
            middle = begin + int((side[begin:end] == 0).sum())
            if begin == middle or middle == end or same[begin] and i[begin] > j[begin]:
                continue
            a, b = pairs(Words(words[begin:middle]), Words(words[middle:end]))
            a, b = a + begin, b + middle
            if same[begin] and i[begin] == j[begin]:  # each pair of one part is met twice
                once = np.array([words[x] < words[y] for x, y in zip(a, b, strict=True)], bool)
                a, b = a[once], b[once]
            for x, y in ((a, b), (b, a)):
                found[0] += [words[k] for k in x]
                found[1] += [words[k] for k in y]
                found[2].append(n[y])
        return pa.table({"word": pa.array(found[0], pa.string()), "other": pa.array(found[1], pa.string()), "n": pa.array(np.concatenate(found[2]) if found[2] else [], pa.int64())})

    return rows.groupBy("task").applyInArrow(multiply, "word string, other string, n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms that follow from each word; every step skips twice as many."""
    forms = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(forms.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not after.agg(F.max("moved")).first()[0]:
            return forms
        forms = after.drop("moved")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n): words and the more frequent spelling that each is a variant of.

    Words are runs of ASCII and Latin-1 letters, lower-cased where ASCII, some with a letter dropped (one in SLIP, by a hash
    of document and run). Those with LETTERS or more code points and OCCURRENCES or more in all texts are words; two are near
    if they are one inserted, deleted or replaced code point apart. Words are put into blocks by length and by how many letters of
    each kind they have; only adjacent blocks meet, in matrix products of bounded size, dealt over tasks. The form is the
    near word of most occurrences (ties: the smallest), if it has FORM times the word's; the root is the last of the forms.

    Null and empty texts have no words; a null doc_id is written as nothing in the hash. Repeated rows count each time. An empty
    table gives no rows. Other columns are not looked at.
    """
    words = stored(occurring(docs).where(F.col("n") >= OCCURRENCES))
    best = near(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "other")).alias("best"))
    found = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= FORM * F.col("n"), -F.col("best.less")))
    found = stored(found.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"))
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
