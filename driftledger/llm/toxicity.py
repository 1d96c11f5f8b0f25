"""Toxicity by maximum-scoring segments of token log-odds, with extreme-value calibration."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftledger.llm.common import held_out, stored

#: The only bound: labelled documents that the model is fitted on, an even sample by hash. All rows are scored.
FIT_DOCUMENTS = 12_000
THRESHOLD = 0.3
_TOKEN = re.compile(r"[^\W\d_]+")
_PREFIX = 4


def tokens(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    return _TOKEN.findall(text.lower()) if text else []


def token_odds(counts: dict[str, tuple[int, int]], prior: float = 0.05) -> dict[str, tuple[float, float]]:
    """Log-odds of toxic against clean with an informative Dirichlet prior, and their z-score, for each token.

    ``counts`` has a token's numbers in toxic and clean texts. The prior adds ``prior`` of all counts to either side, spread
    as the tokens of all texts are spread, so tokens of one side only have finite odds and variance. It pulls odds to 0, which is
    a token's value if its texts are toxic as often as all are. Odds of rare tokens can be large; their z-score is small.
    """
    toxic, clean = (sum(c[i] for c in counts.values()) for i in (0, 1))
    added, odds = prior * (toxic + clean), {}
    for token, (t, c) in counts.items():
        a = prior * (t + c)
        value = math.log((t + a) / max(toxic + added - t - a, 1e-9)) - math.log((c + a) / max(clean + added - c - a, 1e-9))
        odds[token] = value, value / math.sqrt(1 / (t + a) + 1 / (c + a))
    return odds


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in one pass: no segment can be made longer or joined for more score.

    Candidates stay on a stack with the running sums at their ends. A new positive score joins the candidates back to the
    last one that starts lower and ends lower, until none does. Each knows the last one that starts lower, so those between
    are not gone through again.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before it, sum through it, the last that starts lower
    total = 0.0
    for i, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        start, low = i, before
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((start, i + 1, low, total, j))
    return [(s, e, high - low) for s, e, low, high, _ in stack]


class Model:
    """Token scores, the extreme-value parameters of chance segments, and the calibration to a probability."""

    def __init__(self, lexicon: dict[str, float], prefixes: dict[str, float], drift: float, decay: float = 1.0, scale: float = 1.0):
        self.lexicon, self.prefixes, self.drift = lexicon, prefixes, drift
        self.decay, self.scale = decay, scale
        self.weights: tuple[float, float, float] | None = (0.0, 1.0, 0.0)

    def scores(self, words: list[str]) -> tuple[list[int], list[float]]:
        """The places of scored tokens, and their scores. All other tokens cost ``drift`` each."""
        known, prefixes = self.lexicon, self.prefixes
        found = [(i, s) for i, w in enumerate(words) if (s := known.get(w) or prefixes.get(w[:_PREFIX]))]
        return [i for i, _ in found], [s for _, s in found]

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """Maximal segments of a text. Between scored tokens the cost is one sum, which changes no maximal segment."""
        places, scores = self.scores(words)
        runs: list[float] = []
        for k, (i, s) in enumerate(zip(places, scores, strict=True)):
            runs += [-self.drift * (i - (places[k - 1] + 1 if k else 0)), s]
        return [(places[s // 2], places[(e - 1) // 2] + 1, v) for s, e, v in maximal_segments(runs)]

    def significance(self, score: float, n: int) -> float:
        """-ln of the expected number of chance segments of this score or more in a text of n tokens."""
        return self.decay * score - math.log(self.scale * max(n, 1))

    def features(self, words: list[str]) -> tuple[float, float, list[tuple[int, int, float]]]:
        """Significance of the best segment, that of all passages together, and the passages: (start, end, significance)."""
        rated = [(s, e, self.significance(v, len(words))) for s, e, v in self.segments(words)]
        passages = [x for x in rated if x[2] > 0]
        best = max((x[2] for x in rated), default=-math.log(self.scale * max(len(words), 1)) - 1.0)
        return best, sum(x[2] for x in passages), passages

    def probability(self, best: float, together: float) -> float:
        """Calibrated probability; the sum of passages enters as its logarithm. 0 if nothing could be learned."""
        if self.weights is None:
            return 0.0
        b, w, v = self.weights
        z = b + w * max(-8.0, min(best, 12.0)) + v * math.log1p(together)
        return 1 / (1 + math.exp(-max(-30.0, min(z, 30.0))))


def _decay(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(decay * score)) = 1; the mean score is negative."""
    low, high = 1e-6, 1.0
    while (shares * np.exp(high * scores)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if (shares * np.exp(middle * scores)).sum() < 1 else (low, middle)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Newton steps for a logistic regression with a small penalty."""
    x, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCUMENTS) -> DataFrame:
    """(text, toxic) of at most ``limit`` documents that may be learned from, chosen by a hash of doc_id."""
    usable = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    chosen = stored(usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(limit))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCUMENTS, min_z: float = 3.5, drift: float = 0.05) -> Model:
    """Learns from a bounded sample of labelled documents. Without labels of both kinds nothing is shown to be toxic: every
    score is 0, and no document is predicted toxic.

    Each token whose share of toxic texts differs significantly from that of all tokens scores its own log-odds, above or below
    0; size of the odds is no condition, as the calibration of segments decides. Tokens that show no difference cost ``drift``,
    or as much more as makes the mean score of clean texts negative, which extreme values need. Tokens in fewer texts than 3, or
    than one for each 200 toxic texts, enter as totals only.

    Counts are taken on the executors. What comes to the driver is bounded by the sample: tokens of enough texts, counts of
    scores, and two numbers for each document.
    """
    sample = stored(labelled(docs, labels, limit).where("text is not null").dropDuplicates(["text", "toxic"]))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(tokens(t))) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(found, pa.list_(pa.string()))], names=["toxic", "tokens"])

    each = stored(sample.select("toxic", "text").mapInArrow(split, "toxic int, tokens array<string>"))  # as texts are scored
    enough = max(3, each.where("toxic = 1").count() // 200)

    def odds(part) -> dict[str, tuple[float, float]]:
        """Counts are texts that have the token: one that repeats it, or has many copies, says it once."""
        counts = each.select("toxic", F.explode(F.array_distinct(F.transform("tokens", part))).alias("token"))
        counts = counts.groupBy("token").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
        # Only tokens of enough texts can be significant; the others enter as two totals.
        kept = F.when(F.col("n") >= enough, F.col("token")).alias("token")
        rows = counts.groupBy(kept).agg(F.sum("t").alias("t"), F.sum(F.col("n") - F.col("t")).alias("c")).collect()
        return token_odds({r.token: (r.t, r.c) for r in rows}) if rows else {}

    significant = lambda found: {t: max(-6.0, min(v, 6.0)) for t, (v, z) in found.items() if t and abs(z) >= min_z}
    lexicon = significant(odds(lambda t: t))
    prefixes = {t: v for t, v in significant(odds(lambda t: F.substring(t, 1, _PREFIX))).items() if len(t) == _PREFIX}
    model = Model(lexicon, prefixes, drift)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[float, int] = {}
        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                if not toxic:
                    words = tokens(text)
                    scores = model.scores(words)[1]
                    found[0.0] = found.get(0.0, 0) + len(words) - len(scores)
                    for s in scores:
                        s = round(s, 2) or 0.01 * (1 if s > 0 else -1)  # 0 stands for tokens without a score
                        found[s] = found.get(s, 0) + 1
        yield pa.RecordBatch.from_pydict({"score": pa.array(list(found), pa.float64()), "n": pa.array(list(found.values()), pa.int64())})

    chance = sample.mapInArrow(tally, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()
    scores, n = np.array([r.score for r in chance]), np.array([float(r.n) for r in chance])
    if (plain := n[scores == 0].sum()) > 0:
        model.drift = max(drift, float((n * scores).sum() + drift * n.sum()) / float(plain))
        scores = np.where(scores == 0, -model.drift, scores)
    if (scores > 0).any() and (shares := n / n.sum()).any() and (shares * scores).sum() < 0:
        model.decay = min(3.0, _decay(scores, shares))
        # Share of places at which a chance segment can begin.
        model.scale = max(1e-6, float(shares[scores > 0].sum()))
    elif lexicon:
        model.scale = 1e-3  # no clean text has a scored token

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.features(tokens(t))[:2] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"best": pa.array([f[0] for f in found], pa.float64()), "sum": pa.array([f[1] for f in found], pa.float64()), "toxic": batch["toxic"]})

    seen = sample.mapInArrow(features, "best double, sum double, toxic int").collect()
    x = np.array([[max(-8.0, min(r.best, 12.0)), math.log1p(r.sum)] for r in seen]).reshape(-1, 2)
    y = np.array([float(r.toxic) for r in seen])
    model.weights = tuple(map(float, _logistic(x, y))) if 0 < y.sum() < len(y) else None
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``toxicity`` (score double, passages array of (start, end, significance) in tokens); one pass, no shuffle.

    The score depends on the text alone, so equal texts have equal scores. A null or empty text, or one without letters, is
    scored like a text without any segment. Texts are scored whole.
    """
    kind = T.StructType.fromDDL("score double, passages array<struct<start:int,end:int,significance:double>>")
    kind_arrow = pa.struct([("score", pa.float64()), ("passages", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("significance", pa.float64())])))])
    names = docs.columns

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch[names.index("text")]:
                best, together, passages = model.features(tokens(text.as_py()))
                found.append({"score": model.probability(best, together), "passages": [dict(zip(("start", "end", "significance"), p, strict=True)) for p in passages]})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind_arrow)], names=[*names, "toxicity"])

    if "toxicity" in names:
        raise ValueError("the column toxicity is taken")
    return docs.mapInArrow(rate, T.StructType([*docs.schema.fields, T.StructField("toxicity", kind)]))


def detect(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCUMENTS) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) for each document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, limit))
    rated = scored.select("doc_id", held_out().alias("held_out"), "toxicity.score", "toxicity.passages")
    return rated.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")


def without_toxic(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCUMENTS) -> DataFrame:
    """``docs`` without the rows that are predicted toxic."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    return score(rows, fit(docs, labels, limit)).where(F.col("toxicity.score") < THRESHOLD).select("row.*")


