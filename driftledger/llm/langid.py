"""Language of words and texts by a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftledger.llm.common import held_out, stored

#: The only bound: documents of each language that the model learns from, an even sample by hash. All texts are labelled.
FIT_DOCUMENTS = 500
#: Words of a training piece; sequences join pieces of several documents, as code-switched text does.
PIECE, PIECES = 10, 5
#: Table sizes (bits) of the features: n-grams, prefixes, suffixes, whole words.
BITS = (16, 15, 15, 18)
UNKNOWN = "und"
#: Bytes of text that are worked on at once in a task, and words of a block of the forward-backward pass.
CHUNK, BLOCK = 1 << 20, 64

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LETTER = re.compile(r"[^\W\d_]")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(0xC3, 0xE2), *range(0xE3, 0xF0)]] = True


def _buckets(x: np.ndarray, bits: int) -> np.ndarray:
    return ((x * _ODD) >> np.uint64(64 - bits)).astype(np.int64)


def features(texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """For the words of all texts: their text, the buckets of n-grams with each word's (first, last) place among them, and of
    prefix, suffix and word; and whether they have letters. Words are lower-case runs of anything but ASCII white space."""
    parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"  " + b"   ".join(parts) + b"    ", np.uint8)
    data = np.where(_SPACE[data], np.uint8(32), data)
    space = data == 32
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = change[::2], change[1::2]
    offsets = np.cumsum([2, *(len(p) + 3 for p in parts)])
    owner = np.searchsorted(offsets, starts, side="right") - 1
    wide = data.astype(np.uint64)
    grams = wide[:-2] | (wide[1:-1] << np.uint64(8)) | (wide[2:] << np.uint64(16))
    inside = lambda at: np.where((at >= starts[:, None]) & (at < ends[:, None]), wide[at], np.uint64(0))
    shift = np.array([0, 8, 16, 24], np.uint64)
    prefix = (inside(starts[:, None] + np.arange(4)) << shift).sum(axis=1, dtype=np.uint64)
    suffix = (inside(ends[:, None] - 1 - np.arange(4)) << shift).sum(axis=1, dtype=np.uint64)
    # Whole words: differences of a running polynomial, brought back to the word's start by the inverse power.
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(wide) - 1, _ODD)]), dtype=np.uint64)
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(wide) - 1, inverse)]), dtype=np.uint64)
    running = np.concatenate([[np.uint64(0)], np.cumsum((wide + np.uint64(1)) * power, dtype=np.uint64)])
    word = (running[ends] - running[starts]) * back[starts]
    word ^= word >> np.uint64(32)
    letters = np.add.reduceat(_ALPHA[data].astype(np.int32), change)[::2] > 0 if len(starts) else np.empty(0, bool)
    places = np.stack([starts - 1, ends - 1], axis=1)
    return owner, [_buckets(grams, BITS[0]), _buckets(prefix, BITS[1]), _buckets(suffix, BITS[2]), _buckets(word, BITS[3])], places, letters


@dataclass
class Model:
    """Languages; a table of log-odds for each feature; the field's weights of the features, transitions and starts."""

    langs: list[str]
    tables: list[np.ndarray]
    scales: np.ndarray
    moves: np.ndarray
    starts: np.ndarray

    def evidence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, log-odds of each word, feature and language, letters); a word without letters has no evidence."""
        owner, buckets, places, letters = features(texts)
        n, each = len(owner), np.zeros((len(owner), len(self.tables), len(self.langs)), np.float32)
        if n:
            each[:, 0] = np.add.reduceat(self.tables[0][buckets[0]], places.ravel(), axis=0)[::2] / np.sqrt(places[:, 1] - places[:, 0])[:, None]
            for g in range(1, len(self.tables)):
                each[:, g] = self.tables[g][buckets[g]]
            each[~letters] = 0
        return owner, each, letters

    def posteriors(self, owner: np.ndarray, each: np.ndarray) -> np.ndarray:
        """P(language of a word | whole text) by forward-backward."""
        return forward_backward(owner, np.einsum("ngl,g->nl", each, self.scales), self.moves, self.starts)


def _normal(x: np.ndarray, axes) -> np.ndarray:
    return x / np.maximum(x.max(axis=axes, keepdims=True), 1e-300)


def forward_backward(owner: np.ndarray, emission: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Marginals of all sequences at once; ``owner`` numbers the sequences, whose words follow each other.

    Sequences are cut into blocks. A block's steps are multiplied into one matrix, states are passed from block to block
    through these, and then through the steps of all blocks at once. That is the exact result, whatever the lengths are.
    """
    n, k = emission.shape
    if not n:
        return np.empty((0, k))
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    at = np.arange(n) - begin
    block = np.cumsum(at % BLOCK == 0) - 1
    n_blocks = block[-1] + 1
    e = np.exp(emission - emission.max(axis=1, keepdims=True)).astype(np.float64)
    steps = np.broadcast_to(np.eye(k), (n_blocks, BLOCK, k, k)).copy()
    a, s = np.exp(moves), np.exp(starts)
    steps[block, at % BLOCK] = np.where(first[:, None, None], s[None, None, :], a[None]) * e[:, None, :]
    whole = steps[:, 0]
    for t in range(1, BLOCK):
        whole = _normal(whole @ steps[:, t], (1, 2))
    level = at[np.flatnonzero(at % BLOCK == 0)] // BLOCK
    ahead, behind = np.full((n_blocks, k), 1.0 / k), np.ones((n_blocks, k))
    for d in range(1, level.max() + 1):
        b = np.flatnonzero(level == d)
        ahead[b] = _normal(np.einsum("bi,bij->bj", ahead[b - 1], whole[b - 1]), 1)
    for d in range(level.max() - 1, -1, -1):
        b = np.flatnonzero(level == d)
        b = b[(b + 1 < n_blocks) & (level[np.minimum(b + 1, n_blocks - 1)] == d + 1)]
        behind[b] = _normal(np.einsum("bij,bj->bi", whole[b + 1], behind[b + 1]), 1)
    alpha, beta, forward, backward = np.empty((n_blocks, BLOCK, k)), np.empty((n_blocks, BLOCK, k)), ahead, behind
    for t in range(BLOCK):
        alpha[:, t] = forward = _normal(np.einsum("bi,bij->bj", forward, steps[:, t]), 1)
        u = BLOCK - 1 - t
        beta[:, u] = backward
        backward = _normal(np.einsum("bij,bj->bi", steps[:, u], backward), 1)
    found = (alpha * beta)[block, at % BLOCK]
    return found / found.sum(axis=1, keepdims=True)


def _learn(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.05, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature weights, transitions and starts by gradient ascent on the conditional likelihood.

    ``x``: (sequences, steps, features, languages); ``y``: labels. The gradient is observed minus expected counts, which
    forward and backward passes in logarithms give.
    """
    n, steps, groups, k = x.shape
    theta = [np.full(groups, 0.5), np.zeros((k, k)), np.zeros(k)]
    sizes, rows = [np.zeros_like(t) for t in theta], np.arange(n)
    total = lambda v, axis: np.logaddexp.reduce(v, axis=axis)
    for r in range(rounds):
        scales, moves, starts = theta
        emission = np.einsum("ntgl,g->ntl", x, scales)
        alpha, beta = np.empty((n, steps, k)), np.zeros((n, steps, k))
        alpha[:, 0] = starts + emission[:, 0]
        for t in range(1, steps):
            alpha[:, t] = total(alpha[:, t - 1, :, None] + moves, 1) + emission[:, t]
            u = steps - 1 - t
            beta[:, u] = total(moves + (emission[:, u + 1] + beta[:, u + 1])[:, None, :], 2)
        z = total(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None])
        seen = np.zeros_like(p)
        seen[rows[:, None], np.arange(steps)[None], y] = 1
        pairs = np.exp(alpha[:, :-1, :, None] + moves + (emission + beta)[:, 1:, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
        observed = np.zeros((k, k))
        np.add.at(observed, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        gradient = [np.einsum("ntl,ntgl->g", seen - p, x), observed - pairs, (seen - p)[:, 0].sum(axis=0)]
        for i, g in enumerate(gradient):
            g = g / (n * steps) - ridge * theta[i]
            sizes[i] += g * g
            theta[i] = theta[i] + rate * 4 * g / (np.sqrt(sizes[i]) + 1e-8)
    return theta[0], theta[1], theta[2]


def fit(docs: DataFrame, limit: int = FIT_DOCUMENTS) -> Model | None:
    """Learns from text and lang of at most ``limit`` documents of each lang, chosen by a hash of doc_id; None without any.

    Feature counts are taken on the executors and come to the driver as tables of fixed size. The weights are learned there
    from pieces of the same documents, joined at random into sequences that switch languages.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = stored(usable.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).select("doc_id", "lang").distinct())
    langs = sorted(r.lang for r in chosen.select("lang").distinct().collect())
    if not langs:
        return None
    sample = stored(docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), ["doc_id", "lang"]).repartition(8, "doc_id"))
    code = {lang: i for i, lang in enumerate(langs)}

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros((1 << b, len(langs)), np.int64) for b in BITS]
        for batch in batches:
            labels = np.array([code[x] for x in batch["lang"].to_pylist()], np.int64)
            for texts, rows in _chunks(batch["text"].to_pylist()):
                owner, buckets, places, letters = features(texts)
                mine = labels[rows][owner]
                lengths = (places[:, 1] - places[:, 0])[letters]
                at = np.repeat(places[letters, 0] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
                np.add.at(found[0], (buckets[0][at], np.repeat(mine[letters], lengths)), 1)
                for g in range(1, len(BITS)):
                    np.add.at(found[g], (buckets[g][letters], mine[letters]), 1)
        for g, counts in enumerate(found):
            bucket, lang = np.nonzero(counts)
            yield pa.RecordBatch.from_pydict({"g": pa.array(np.full(len(bucket), g), pa.int32()), "bucket": pa.array(bucket, pa.int32()), "lang": pa.array(lang, pa.int32()), "n": pa.array(counts[bucket, lang], pa.int64())})

    counts = sample.mapInArrow(tally, "g int, bucket int, lang int, n long").groupBy("g", "bucket", "lang").agg(F.sum("n").alias("n")).toPandas()
    tables = []
    for g, bits in enumerate(BITS):
        own = counts[counts.g == g]
        table = np.zeros((1 << bits, len(langs)))
        table[own.bucket, own.lang] = own.n
        rate = table / np.maximum(table.sum(axis=0), 1)
        odds = np.log(rate + 0.02 * rate.mean(axis=1, keepdims=True) + 1e-6)
        tables.append((odds - odds.mean(axis=1, keepdims=True)).astype(np.float32))
    model = Model(langs, tables, np.full(len(BITS), 0.5), np.zeros((len(langs),) * 2), np.zeros(len(langs)))
    if len(langs) == 1:
        return model

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for text, lang, doc_id in zip(*(batch[c].to_pylist() for c in ("text", "lang", "doc_id")), strict=True):
                _, each, letters = model.evidence([text])
                each = each[letters]
                for j in range(min(4, len(each) // PIECE)):  # places that a hash picks, anywhere in the text
                    at = (doc_id * 7919 + j * 104729) % (len(each) - PIECE + 1)
                    found.append((code[lang], doc_id, each[at : at + PIECE].astype(np.float32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.binary())], names=["lang", "doc_id", "piece"])

    rows = sorted((r.doc_id, r.lang, bytes(r.piece)) for r in sample.mapInArrow(pieces, "lang int, doc_id long, piece binary").collect())
    if len(rows) < 2 * PIECES:
        return model
    x = np.stack([np.frombuffer(r[2], np.float32).reshape(PIECE, len(BITS), len(langs)) for r in rows])
    y = np.array([r[1] for r in rows])
    picked = np.random.default_rng(5).permutation(len(rows))[: min(len(rows), 4000) // PIECES * PIECES].reshape(-1, PIECES)
    x = x[picked].reshape(len(picked), -1, len(BITS), len(langs)).astype(np.float64)
    model.scales, model.moves, model.starts = _learn(x, np.repeat(y[picked], PIECE, axis=1))
    return model


def _chunks(texts: list[str | None]) -> Iterator[tuple[list[str | None], list[int]]]:
    """Texts in turns of about CHUNK characters, with their rows. A longer text is a turn of its own, whole."""
    rows, size = [], 0
    for i, text in enumerate(texts):
        if rows and size + len(text or "") > CHUNK:
            yield [texts[r] for r in rows], rows
            rows, size = [], 0
        rows.append(i)
        size += len(text or "")
    if rows:
        yield [texts[r] for r in rows], rows


def label(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, segments): language of each text and runs of words of one language.

    The language is the one with the largest share of the word posteriors, over words that have letters; the score is that
    share. ``segments`` are (lang, start, n_words) over all words. A text that is null or has no letter, and any text if
    nothing could be learned, is ``und`` with score 0 and no segments. One pass without a shuffle; texts are read whole.
    Other columns are not looked at; rows with equal texts have equal results; an empty table gives no rows.
    """
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("n_words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            langs, scores, segments = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            for own, rows in _chunks([t if t and _LETTER.search(t) else None for t in texts]) if model else ():
                owner, each, letters = model.evidence(own)
                p = model.posteriors(owner, each)
                shares = np.zeros((len(own), len(model.langs)))
                weight = letters.astype(float)
                for c in range(len(model.langs)):
                    shares[:, c] = np.bincount(owner, p[:, c] * weight, len(own))
                sums, best = shares.sum(axis=1), shares.argmax(axis=1)
                top = p.argmax(axis=1)
                cut = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (top[1:] != top[:-1])])) if len(owner) else []
                begin = np.searchsorted(owner, np.arange(len(own)))
                for a, b in zip(cut, [*cut[1:], len(owner)], strict=True):
                    segments[rows[owner[a]]].append({"lang": model.langs[top[a]], "start": int(a - begin[owner[a]]), "n_words": int(b - a)})
                for i, row in enumerate(rows):
                    if own[i] is not None:
                        langs[row] = model.langs[best[i]]
                        scores[row] = float(min(1.0, shares[i, best[i]] / sums[i])) if sums[i] > 0 else 1 / len(model.langs)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(langs), pa.array(scores, pa.float64()), pa.array(segments, kind)], names=["doc_id", "lang_pred", "score", "segments"])

    found = docs.select(F.col("doc_id").cast("long"), "text")
    return found.mapInArrow(run, "doc_id long, lang_pred string, score double, segments array<struct<lang:string,start:int,n_words:int>>")


def identify(docs: DataFrame, limit: int = FIT_DOCUMENTS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, segments), learned from the documents that are not held out."""
    found = label(docs, fit(docs, limit))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "segments")
