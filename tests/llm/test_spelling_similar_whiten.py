"""Spelling variants, the token-group join and whitening against brute force, and on odd rows."""

import collections
import re
import zlib

import numpy as np
import pytest

from driftledger.llm import hashing, spelling, tokengroups, whitening
from driftledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, word string, node string, n long"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# spelling variants


def _variants(rows):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if c >= 5 and len(w) >= 6}

    def edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [x for x in n if x != w and abs(len(x) - len(w)) < 2 and edit(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= 5 * n[w] else None for w, b in best.items()}
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def test_variants_of_whole_table(spark, documents):
    found = {tuple(r) for r in QUERIES["op11_spelling_variants"](spark, SF).collect()}
    assert found == _variants([(r.doc_id, r.text) for r in documents.collect()])


def test_variants_odd(spark):
    words = ["wanderer"] * 130 + ["wandirer"] * 26 + ["wandirers"] * 5 + ["wandere"] * 6 + ["WANDERER", "Straße", "straße", "ÉCLAIR", "éclair", "eclair"] * 7 + ["abcdef", "abcdfe"] * 9 + ["x" * 3000, "x" * 2999 + "y"] * 5
    rows = [(i, w, None, None, None, None) for i, w in enumerate(words)]
    rows += [(None, "wanderer, straße9Éclair", "en", "x", "y", 1)] * 3 + [(9, None, None, None, None, None), (9, "", "en", "a", "b", 2), (9, " ... ", None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    found = {tuple(r) for r in spelling.variants(df.repartition(3)).collect()}
    assert found == _variants([(r[0], r[1]) for r in rows])
    roots = {r[0]: r[2] for r in found}
    assert roots["wandirers"] == "wanderer" and roots["abcdef"] == "abcdef"
    assert spelling.variants(df.limit(0)).collect() == []
    assert spelling.variants(df.where("n = 2")).collect() == []


def test_variants_in_many_parts(spark, documents, monkeypatch):
    whole = {tuple(r) for r in spelling.variants(documents).collect()}
    monkeypatch.setattr(spelling, "BLOCK", 3)
    monkeypatch.setattr(spelling, "ROWS", 200)
    assert {tuple(r) for r in spelling.variants(documents).collect()} == whole


# token-group join


def _similar(rows):
    def words(text):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()

    sets = []
    for i, text in rows:
        w = words(text)
        sets.append((i, {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()))
    by, links = collections.defaultdict(list), collections.defaultdict(set)
    for k, (_, s) in enumerate(sets):
        shared = collections.Counter(j for g in s for j in by[g])
        for g in s:
            by[g].append(k)
        for j, m in shared.items():
            if 100 * m >= 90 * len(s | sets[j][1]):
                links[j].add(k)
                links[k].add(j)
    out = []
    for k, (i, s) in enumerate(sets):
        seen, todo = {k}, [k]
        while todo:
            todo += [x for x in links[todo.pop()] if x not in seen and not seen.add(x)]
        out.append((i, len(s), min(sets[x][0] for x in seen)))
    return sorted(out)


def _found(df):
    return sorted(tuple(r) for r in tokengroups.similar(df).collect())


def test_similar_of_whole_table(spark, documents):
    found = QUERIES["op12_similar_documents"](spark, SF)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(tuple(r) for r in found.collect()) == _similar([(r.doc_id, r.text) for r in documents.collect()])


def _family(seed=5):
    """Chains and families of changed copies around the threshold, of many sizes."""
    random, rows = np.random.default_rng(seed), []
    for size in (3, 8, 9, 10, 11, 12, 19, 20, 21, 40, 41, 60, 100, 101, 150, 400):
        text = [f"w{x}" for x in random.integers(0, 5000, size)]
        for _ in range(14):
            rows.append(list(text))
            for _ in range(random.integers(0, 3)):
                at = random.integers(0, len(text))
                text = random.choice(["cut", "put", "swap", "end"]) == "cut" and [*text[:at], *text[at + 1 :]] or [*text[:at], f"n{random.integers(0, 9)}", *text[at + (random.random() < 0.7) :]]
    random.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("members", [64, 2])
def test_similar_families(spark, monkeypatch, members):
    monkeypatch.setattr(tokengroups, "MEMBERS", members)
    monkeypatch.setattr(tokengroups, "QUERIES", 4 * members)
    rows = _family(members)
    expected = _similar(rows)
    assert len({c for _, _, c in expected}) < len(rows) - 50
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], DOCS).repartition(5)
    assert _found(df) == expected


def test_similar_odd(spark):
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
    rows = [(1, long), (2, long + " end"), (3, None), (4, ""), (5, " \t\n"), (6, "One two"), (7, "one TWO"), (8, "one two three"), (9, "É two three"), (10, "é two three")]
    clash = [(11, "a b c d"), (11, "a b c d"), (11, "e f g h"), (None, "one two"), (None, None)]
    df = spark.createDataFrame([(*r, "en", "x", None, None) for r in rows + clash], DOCS)
    found = sorted((tuple(r) for r in tokengroups.similar(df).collect()), key=repr)
    expected = [*_similar(rows), (11, 2, 11), (11, 2, 11), (11, 2, 11), (None, 1, None), (None, 0, None)]
    assert found == sorted(expected, key=repr)
    assert _found(df.limit(0)) == [] and _found(df.where("text is null and doc_id is not null")) == [(3, 0, 3)]


def test_probes_are_shared_by_linked_sets():
    random, seen = np.random.default_rng(3), 0
    for _ in range(1500):
        a = np.unique(random.integers(0, 1 << 63, random.integers(9, 300), dtype=np.uint64))
        n = int(random.integers(0, len(a) // 8 + 2))
        b = np.unique(np.concatenate([random.permutation(a)[random.integers(0, n + 1) :], random.integers(0, 1 << 63, n, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both) and len(a) + len(b) != 2 * both:
            seen += 1
            assert np.intersect1d(tokengroups.probes(a), tokengroups.probes(b)).size
    assert seen > 300


def test_closed_groups_have_no_linked_member():
    random = np.random.default_rng(4)
    sets = [np.unique(random.integers(0, 400, 60, dtype=np.uint64)) for _ in range(40)] + [np.arange(k, k + 60, dtype=np.uint64) for k in range(8)]
    tokens = np.unique(np.concatenate(sets))
    bits = np.packbits(np.array([np.isin(tokens, s) for s in sets]), axis=1)
    group = tokengroups.Opened(np.arange(len(sets)), np.array([len(s) for s in sets]), tokens.tobytes(), bits.tobytes())
    far = tokengroups.Opened(*(group.members, group.sizes), tokens.tobytes(), bits.tobytes())
    assert not far.linked(np.arange(380, 450, dtype=np.uint64)).any() and far.rows is None  # stayed closed
    for s in [*sets, np.arange(3, 66, dtype=np.uint64)]:
        brute = [100 * len(np.intersect1d(s, t)) >= 90 * len(np.union1d(s, t)) for t in sets]
        assert group.linked(s).tolist() == brute


def test_shingle_hashes():
    assert len(tokengroups.shingles("a b")) == 1 and len(tokengroups.shingles("a b c a b c")) == 3 and tokengroups.shingles(None).size == 0
    assert hashing.words("A\x0bB C", lower=True) == [b"a", "b c".encode()]


# whitening


@pytest.mark.parametrize("low, high, n", [(-5, 5, 100), (0, 1, 3), (7, 8, 40), (99_000, 101_000, 777), (-(1 << 61), 1 << 61, 50)])
def test_scatter_is_exact(low, high, n):
    x = np.random.default_rng(n).integers(low, high, (n, 6))
    sums, products = whitening.scatter(x)
    own = x.astype(object)
    assert (sums == own.sum(axis=0)).all() and (products == own.T @ own).all()


def _check_whitened(rows, vectors):
    """Against eigenvectors of the covariance that numpy takes from the integers."""
    x = np.floor(1024 * np.array([v for _, v in vectors])).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0).astype(object)
    deviation = ((n * x.astype(object) - sums) ** 2).sum(axis=1)
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.component].append(r)
    assert len(by) == min(8, x.shape[1])
    for c, own in by.items():
        e, axis = values[-c], axes[:, -c]
        expected = sorted(zip([i for i, _ in vectors], deviation, centred @ axis / np.sqrt(e)))
        own = sorted((r.vec_id, int(r.deviation), r.whitened) for r in own)
        assert [r[:2] for r in own] == [r[:2] for r in expected]
        there, here = np.array([r[2] for r in expected]), np.array([r[2] for r in own])
        assert np.allclose(here, there, atol=1e-8) or np.allclose(here, -there, atol=1e-8)
    assert all(r.n == n and r.explained == pytest.approx(values[-r.component] / values.sum()) and r.identity_error < 1e-10 for r in rows)


def test_whiten_whole_table(spark):
    rows = QUERIES["op13_whiten"](spark, SF).collect()
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None]
    _check_whitened(rows, vectors)


def test_whiten_odd(spark):
    random = np.random.default_rng(2)
    long = [(i, random.normal(size=3).tolist()) for i in range(50)] + [(7, [0.0, 0.0, 0.0])] * 2
    short = [(100 + i, random.normal(size=2).tolist()) for i in range(9)]
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0]), (203, [1.0, float("nan"), 2.0]), (204, [1.0, float("inf"), 2.0])]
    alone = [(300, [1.0] * 5), (301, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, "x", 1, None) for i, v in long + short + bad + alone], "vec_id long, embedding array<double>, dim string, n long, w double")
    found = whitening.whiten(df.repartition(4)).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r.dim].append(r)
    assert set(by) == {2, 3}
    for d, own in ((3, long), (2, short)):
        assert len(by[d]) == d * len(own)
        _check_whitened(by[d], own)
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.where("vec_id >= 200")).collect() == []
    unnamed = spark.createDataFrame([(None, v) for _, v in short], "vec_id long, embedding array<double>")
    assert whitening.whiten(unnamed).count() == 18


def test_whiten_in_passes_and_far_entries(spark, monkeypatch):
    random = np.random.default_rng(6)
    rows = [(d * 100 + i, random.normal(size=d).tolist()) for d in (2, 3, 4) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    one = {(r.vec_id, r.component): abs(r.whitened) for r in whitening.whiten(df).collect()}
    monkeypatch.setattr(whitening, "MATRIX", 9)
    more = {(r.vec_id, r.component): abs(r.whitened) for r in whitening.whiten(df).collect()}
    assert one.keys() == more.keys() and all(one[k] == pytest.approx(more[k], abs=1e-9) for k in one)
    far = spark.createDataFrame([(i, [1e300 * (-1) ** i, float(i)]) for i in range(6)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(far).collect()} == {1}  # the other variance is lost in rounding
