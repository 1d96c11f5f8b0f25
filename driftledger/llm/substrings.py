"""Removal of passages that repeat, by fixed-block anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from driftledger.llm import hashing
from driftledger.llm.common import partitions, stored

#: A passage of this many words is removed where it repeats. Any such window holds a whole block of half as many words.
WINDOW = 20
BLOCK = WINDOW // 2
#: Windows of a batch of documents that are hashed at once in a task; a longer document is a batch of its own.
BATCH = 2_000_000

_PACKED = "part int, batch long, ids binary, ties binary, starts binary, hash binary, low binary, high binary, flags binary, places binary"
_FIELDS = [f.split() for f in _PACKED.split(", ")]
_SCHEMA = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in _FIELDS])


def _gaps(offsets: np.ndarray) -> tuple[bytes, bytes]:
    """Rising offsets as differences, low bytes and the rest apart, as the rest is nearly always zero."""
    gaps = np.diff(offsets, prepend=0)
    return (gaps & 255).astype(np.uint8).tobytes(), (gaps >> 8).astype(np.uint32).tobytes()


def _offsets(low: bytes, high: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(low, np.uint8).astype(np.int64) + (np.frombuffer(high, np.uint32).astype(np.int64) << 8))


def _marks(n: int, at: np.ndarray) -> bytes:
    bits = np.zeros(n, bool)
    bits[at] = True
    return np.packbits(bits).tobytes()


class _Batch:
    """Documents whose windows are hashed together; ``starts`` are where each one's windows begin in the common count."""

    def __init__(self, docs: list[tuple[int, int, np.ndarray, np.ndarray]]):
        self.ids, self.ties = (np.array([d[i] for d in docs], np.int64) for i in (0, 1))
        lengths = np.array([len(d[2]) for d in docs], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.hashes = np.concatenate([d[2] for d in docs])
        self.extra = np.concatenate([d[3] for d in docs])
        self.own = np.repeat(np.arange(len(docs)), lengths)
        self.places = np.arange(len(self.hashes)) - np.repeat(self.starts[:-1], lengths)
        self.key = np.int64(np.uint64(xxh3_64_intdigest(self.ids.tobytes() + self.ties.tobytes() + lengths.tobytes())).astype(np.int64))

    def manifest(self, parts: int, known: np.ndarray) -> dict:
        """What is needed to give offsets back to documents, and the offsets that the batch has found itself."""
        low, high = _gaps(known)
        return {"part": int(self.key % parts), "batch": int(self.key), "ids": self.ids.tobytes(), "ties": self.ties.tobytes(), "starts": self.starts.tobytes(), "low": low, "high": high}

    def dealt(self, parts: int, chosen: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The chosen offsets, rising, by the part of their hash."""
        part = ((self.hashes[chosen] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(edges)):
            yield int(p), chosen[order[edges[p] : edges[p + 1]]]


def _batches(rows: Iterator[tuple]) -> Iterator[_Batch]:
    """Batches of (doc_id, tie, hashes, extra), in the order of doc_id within each."""
    docs, size = [], 0
    for row in rows:
        if docs and size + len(row[2]) > BATCH:
            yield _Batch(sorted(docs, key=lambda d: d[:2]))
            docs, size = [], 0
        docs.append(row)
        size += len(row[2])
    if docs:
        yield _Batch(sorted(docs, key=lambda d: d[:2]))


def _anchors(docs: DataFrame, parts: int) -> DataFrame:
    """Packed hashes of all rolling windows of BLOCK words; ``flags`` marks those that are a document's own blocks.

    A batch sends each hash once. Where a hash repeats within the batch its places are known to repeat, so they are noted in
    the manifest; a very common passage is so one entry of each batch, not one of each document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                ids, ties = batch["doc_id"].to_pylist(), batch["tie"].to_pylist()
                first: dict[int, int] = {}
                for doc_id, tie in zip(ids, ties, strict=True):
                    first[tie] = min(doc_id, first.get(tie, doc_id))
                for doc_id, tie, text in zip(ids, ties, batch["text"], strict=True):
                    if first.get(tie) != doc_id:  # a copy, or seen: all its windows repeat
                        continue
                    del first[tie]
                    words = hashing.words(text.as_py())
                    if len(words) >= WINDOW:
                        h = hashing.runs(hashing.hashes(words), BLOCK)
                        yield doc_id, tie, h, np.arange(len(h)) % BLOCK == 0

        for b in _batches(rows()):
            _, first, inverse, counts = np.unique(b.hashes, return_index=True, return_inverse=True, return_counts=True)
            block = np.zeros(len(first), bool)
            block[inverse[b.extra]] = True
            repeated = np.flatnonzero(counts[inverse] > 1)
            found = [b.manifest(parts, repeated)]
            order = np.argsort(first)
            flags = np.zeros(len(b.hashes), np.uint8)
            flags[first] = block | ((counts > 1).astype(np.uint8) << 1)
            for part, at in b.dealt(parts, first[order]):
                low, high = _gaps(at)
                found.append({"part": part, "batch": int(b.key), "hash": b.hashes[at].astype(np.uint32).tobytes(), "low": low, "high": high, "flags": flags[at].tobytes()})
            yield pa.RecordBatch.from_pylist(found, _SCHEMA)

    return docs.mapInArrow(run, _PACKED)


def _met_anchors(table: pa.Table) -> pa.Table:
    """Of one part, the offsets in each batch of windows that equal some block and occur at least twice."""
    probes, others = [r for r in table.to_pylist() if r["hash"] is not None], table.filter(pc.is_null(table["hash"]))
    if not probes:
        return others
    hashes = np.concatenate([np.frombuffer(r["hash"], np.uint32) for r in probes])
    flags = np.concatenate([np.frombuffer(r["flags"], np.uint8) for r in probes])
    values, inverse = np.unique(hashes, return_inverse=True)
    times = np.bincount(inverse, 1 + (flags >> 1), len(values))
    blocks = np.bincount(inverse, flags & 1, len(values))
    return pa.concat_tables([others, _answers(probes, ((times > 1) & (blocks > 0))[inverse])])


def _answers(probes: list[dict], hit: np.ndarray) -> pa.Table:
    found, at = [], 0
    for r in probes:
        n = len(r["low"])
        mine = hit[at : at + n]
        at += n
        if mine.any():
            low, high = _gaps(_offsets(r["low"], r["high"])[mine])
            found.append({"part": r["part"], "batch": r["batch"], "low": low, "high": high})
    return pa.Table.from_pylist(found, _SCHEMA)


def _by_document(table: pa.Table) -> pa.Table:
    """(doc_id, tie, marks): of one batch, the bits of all offsets that were found, for each document that has any."""
    rows = table.to_pylist()
    named = next((r for r in rows if r["ids"] is not None), None)
    if named is None:
        raise ValueError("the input changed while it was read: a batch of documents has no manifest")
    ids, ties, starts = (np.frombuffer(named[c], np.int64) for c in ("ids", "ties", "starts"))
    bits = np.zeros(starts[-1], bool)
    for r in rows:
        bits[_offsets(r["low"], r["high"])] = True
    found = [(ids[i], ties[i], np.packbits(bits[a:b]).tobytes()) for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False)) if bits[a:b].any()]
    columns = list(zip(*found, strict=True)) or [[], [], []]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["doc_id", "tie", "marks"])


_MARKS = "doc_id long, tie long, marks binary"


def _around(marks: bytes, n: int) -> np.ndarray:
    """Starts of the windows of WINDOW words that hold a marked block, of n that there are."""
    at = np.flatnonzero(np.unpackbits(np.frombuffer(marks, np.uint8)))
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(at - (WINDOW - BLOCK), 0, n), 1)
    np.add.at(edge, np.clip(at + 1, 0, n), -1)
    return np.flatnonzero(np.cumsum(edge[:n]) > 0)


def _windows(docs: DataFrame, parts: int) -> DataFrame:
    """Packed 96-bit hashes of the windows around anchors, the earliest of each batch. All later ones repeat for sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for doc_id, tie, text, marks in zip(*(batch[c].to_pylist() for c in ("doc_id", "tie", "text", "marks")), strict=True):
                    h = hashing.hashes(hashing.words(text))
                    at = _around(marks, len(h) - WINDOW + 1)
                    pairs = np.empty(len(at), [("a", np.uint64), ("b", np.uint32)])
                    pairs["a"], pairs["b"] = hashing.runs(h, WINDOW)[at], hashing.runs(h, WINDOW, 77)[at].astype(np.uint32)
                    yield doc_id, tie, pairs["a"], np.stack([at, pairs["b"].astype(np.int64)], axis=1)

        for b in _batches(rows()):
            place, second = b.extra[:, 0], b.extra[:, 1]
            order = np.lexsort((place, b.ids[b.own], second, b.hashes))
            h, s, d, p = b.hashes[order], second[order], b.ids[b.own][order], place[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            later = (d != d[lead]) | (p != p[lead])
            found = [b.manifest(parts, np.sort(order[later])) | {"places": place.astype(np.int64).tobytes()}]
            for part, at in b.dealt(parts, np.sort(order[new])):
                low, high = _gaps(at)
                where = np.stack([b.ids[b.own[at]], place[at]])
                found.append({"part": part, "batch": int(b.key), "hash": b.hashes[at].tobytes(), "flags": second[at].astype(np.uint32).tobytes(), "low": low, "high": high, "places": where.tobytes()})
            yield pa.RecordBatch.from_pylist(found, _SCHEMA)

    return docs.mapInArrow(run, _PACKED)


def _later_windows(table: pa.Table) -> pa.Table:
    """Of one part, the offsets in each batch of windows that start earlier elsewhere."""
    probes, others = [r for r in table.to_pylist() if r["hash"] is not None], table.filter(pc.is_null(table["hash"]))
    if not probes:
        return others
    a, b = (np.concatenate([np.frombuffer(r[c], k) for r in probes]) for c, k in (("hash", np.uint64), ("flags", np.uint32)))
    doc, place = np.concatenate([np.frombuffer(r["places"], np.int64).reshape(2, -1) for r in probes], axis=1)
    order = np.lexsort((place, doc, b, a))
    a, b, doc, place = a[order], b[order], doc[order], place[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    hit = np.empty(len(order), bool)
    hit[order] = (doc != doc[lead]) | (place != place[lead])
    return pa.concat_tables([others, _answers(probes, hit)])


def _window_starts(table: pa.Table) -> pa.Table:
    """(doc_id, tie, marks): of one batch, the starts of repeated windows in words, for each document that has any."""
    rows = table.to_pylist()
    named = next((r for r in rows if r["ids"] is not None), None)
    if named is None:
        raise ValueError("the input changed while it was read: a batch of documents has no manifest")
    ids, ties, starts, places = (np.frombuffer(named[c], np.int64) for c in ("ids", "ties", "starts", "places"))
    bits = np.zeros(starts[-1], bool)
    for r in rows:
        bits[_offsets(r["low"], r["high"])] = True
    found = [(ids[i], ties[i], _marks(places[a:b].max() + 1, places[a:b][bits[a:b]])) for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False)) if bits[a:b].any()]
    columns = list(zip(*found, strict=True)) or [[], [], []]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["doc_id", "tie", "marks"])


def _removed(n: int, starts: np.ndarray) -> np.ndarray:
    """Which of n words a window at one of the starts covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return np.cumsum(edge[:n]) > 0


def _spans(gone: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    return [{"start": int(a), "n_words": int(b - a)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:int,n_words:int>>"


def _result(doc_id: int | None, words: list[bytes], gone: np.ndarray) -> dict:
    kept = b" ".join([w for w, g in zip(words, gone, strict=True) if not g] if gone.any() else words)
    return {"doc_id": doc_id, "n_words": len(words), "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest(), "removed": _spans(gone)}


def _arrow(fields: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<struct<start:int,n_words:int>>": pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32())]))}
    return pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in fields.split(", "))])


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed): what stays of each document when every word goes that is covered
    by a window of 20 words which also starts earlier (in a smaller doc_id, or earlier in the same document).

    1. Index and probe: blocks of 10 words at every tenth place of a document, and all its rolling windows of 10 words, meet
       by hash. Any repeated window of 20 words holds a whole block of its other place, so it lies around a window that
       equals a block and occurs twice. Here only hashes of 32 bits within a part are compared; chance hits do no harm.
    2. Extension: the windows of 20 words around such anchors meet by hashes of 96 bits, and all but the earliest are marked.
       Marked windows that overlap make up the maximal repeats, which are removed.

    Hashes travel packed, many to a row, and a batch of documents sends a repeated one once, so common passages and copies
    make no hot key. A document whose whole text has a smaller doc_id too is not compared: all its windows repeat.

    A null or empty text has no words; kept_sha256 is then that of the empty string. Rows without doc_id have no place in
    the order: nothing is removed from them, and nothing because of them. Rows that share a doc_id are one document to the
    order: a window at the same place of another text is not earlier. Repeated rows have repeated results; an empty table
    gives no rows; other columns are not looked at.
    """
    parts = 2 * partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    usable = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    group = _anchors(usable, parts).groupBy("part").applyInArrow(_met_anchors, _PACKED)
    anchors = group.groupBy("batch").applyInArrow(_by_document, _MARKS)

    names = usable.select("doc_id", "tie", F.md5(F.col("text").cast("binary")).alias("md5")).distinct()
    copies = names.join(names.groupBy("md5").agg(F.min("doc_id").alias("least")), "md5").where("doc_id > least").select("doc_id", "tie", F.lit(True).alias("copy"))
    known = anchors.groupBy("doc_id", "tie").agg(F.first("marks").alias("marks")).join(copies, ["doc_id", "tie"], "full")
    met = rows.join(known.select(F.col("doc_id").alias("d__"), F.col("tie").alias("t__"), "marks", "copy"), (F.col("doc_id") == F.col("d__")) & (F.col("tie") == F.col("t__")), "left")
    first = f"{_RESULT}, tie long, text string, marks binary"
    first_schema, result_schema = _arrow(first), _arrow(_RESULT)

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc_id, tie, text, marks, copy in zip(*(batch[c].to_pylist() for c in ("doc_id", "tie", "text", "marks", "copy")), strict=True):
                if marks is not None and not copy:
                    found.append({"doc_id": doc_id, "tie": tie, "text": text, "marks": marks})
                else:
                    words = hashing.words(text)
                    found.append(_result(doc_id, words, np.full(len(words), bool(copy) and len(words) >= WINDOW)))
            yield pa.RecordBatch.from_pylist(found, first_schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc_id, text, marks in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "marks")), strict=True):
                words = hashing.words(text)
                starts = np.flatnonzero(np.unpackbits(np.frombuffer(marks or b"", np.uint8)))
                found.append(_result(doc_id, words, _removed(len(words), starts)))
            yield pa.RecordBatch.from_pylist(found, result_schema)

    sorted_out = stored(met.select("doc_id", "tie", "text", "marks", "copy").mapInArrow(sort_out, first))
    doubtful = sorted_out.where("text is not null")
    group = _windows(doubtful.select("doc_id", "tie", "text", "marks"), parts).groupBy("part").applyInArrow(_later_windows, _PACKED)
    repeats = group.groupBy("batch").applyInArrow(_window_starts, _MARKS).groupBy("doc_id", "tie").agg(F.first("marks").alias("marks"))
    done = doubtful.select("doc_id", "tie", "text").join(repeats, ["doc_id", "tie"], "left").select("doc_id", "text", "marks")
    return sorted_out.where("text is null").select(*result_schema.names).unionByName(done.mapInArrow(finish, _RESULT))
