"""Each operator against a brute-force version, and on nulls, empty texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest

import corpus_pipeline
from driftledger.llm import chat, decontaminate, forest, langid, mixing, neardup, revisits, sharding, substrings, toxicity
from driftledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, hash string"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, a shared doc_id, clashing column names."""
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
    rows = [(1, long), (2, long), (3, None), (4, ""), (5, " \t\n"), (6, "one two"), (6, "one two"), (6, "three"), (None, "one two"), (None, None), (7, "😀 ünï " * 12)]
    return spark.createDataFrame([(i, t, None if n % 2 else "en", None if n % 3 else "s", None, "x", None) for n, (i, t) in enumerate(rows)], DOCS)


def taken(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# mixing


def test_mix_meets_targets(documents, texts):
    rows = mixing.mix(documents).collect()
    sizes = {i: len((t or "").encode().split()) for i, t in texts.items()}
    assert {r.doc_id: r["size"] for r in rows} == sizes
    by = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r.copies <= 2
        by[r.source].append(r)
    weights = dict(zip(sorted(by), [5, 2, 1] * len(by)))
    whole = {s: sum(r["size"] for r in rs) for s, rs in by.items()}
    full, level = set(), 0.0
    while True:  # the excess is reshared until no target is above its bound
        level = (1.5 * sum(whole.values()) - sum(2 * whole[s] for s in full)) / sum(weights[s] for s in by if s not in full)
        more = {s for s in by if s not in full and 2 * whole[s] <= level * weights[s]}
        if not more:
            break
        full |= more
    for s, rs in by.items():
        target = 2 * whole[s] if s in full else level * weights[s]
        assert rs[0].target == pytest.approx(target) and rs[0].source_size == whole[s]
        assert abs(sum(r["size"] * r.copies for r in rs) - target) <= max(r["size"] for r in rs) + 1
    again = mixing.mix(documents.repartition(3)).collect()
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((r.doc_id, r.copies) for r in again)
    assert mixing.mixed(documents).count() == sum(r.copies for r in rows)


def test_mix_odd(spark, odd):
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mixed(odd.limit(0)).count() == 0


def test_mix_hands_copies_to_repeated_rows(spark):
    """Null and repeated ids: what is taken stays within a document of the target, and no row enters more than twice."""
    rows = [(None, f"a b c d t{n % 3}", "s") for n in range(100)] + [(1, "a b c d e", "t")] * 67 + [(n, "a b c d e f g", "u") for n in range(2, 300)]
    docs = spark.createDataFrame([(i, t, "en", s, 0, "x", "y") for i, t, s in rows], DOCS).repartition(5)
    plan = mixing.mix(docs).groupBy("source").agg({"target": "max", "copies": "max", "*": "count"}).collect()
    mixed = collections.Counter((r.source, r.doc_id, r.text) for r in mixing.mixed(docs).collect())
    for r in plan:
        longest = max(len(t.split()) for _, t, s in rows if s == r.source)
        assert abs(sum(n * len(t.split()) for (s, _, t), n in mixed.items() if s == r.source) - r["max(target)"]) <= longest + 1
        assert r["max(copies)"] <= 2
    given = collections.Counter((s, i, t) for i, t, s in rows)
    assert all(n <= 2 * given[k] for k, n in mixed.items())


# sharding


def test_shards(documents, texts):
    rows = sharding.shard(documents, 8).collect()
    by, loads, groups = collections.defaultdict(list), collections.Counter(), collections.defaultdict(set)
    for r in rows:
        assert r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        by[r.shard].append(r.slot)
        loads[r.shard] += r["size"]
        groups[texts[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and all(len(g) == 1 for g in groups.values())
    sizes = collections.Counter()
    for i, t in texts.items():
        sizes[hashlib.sha256(t.encode()).digest()] += len(t.encode()) + 1
    sizes = [sizes[k] for k in sorted(sizes)]

    def fits(capacity):
        shards, room = 1, capacity
        for s in sizes:
            if s > room:
                shards, room = shards + 1, capacity
            room -= s
        return shards <= 8

    low = max(sizes)
    while not fits(low):
        low += 1
    assert max(loads.values()) == low


@pytest.mark.parametrize("cells", [2, 16])
def test_cuts_are_exact_for_any_resolution(spark, cells):
    random = np.random.default_rng(3)
    small = list(map(int, random.integers(1, 500, 300)))
    for sizes in ([1] * 50, [7], [100, 1, 1, 1], small, [*small[:90], 24_000, *small[90:]], [*small[:200], 31_000, 30_990, *small[200:]]):
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        groups = spark.createDataFrame([(int(a), b) for a, b in zip(starts, sizes)], "start long, bytes long")
        cuts = sharding.minimax_cuts(groups, 4, cells)
        loads = np.diff([0, *cuts, sum(sizes)])
        best = min(c for c in range(max(sizes), sum(sizes) + 1) if _greedy(sizes, c) <= 4)
        assert loads.max() == best and set(cuts) <= {*map(int, starts), sum(sizes)}


def _greedy(sizes, capacity):
    n, room = 1, capacity
    for s in sizes:
        if s > room:
            n, room = n + 1, capacity
        room -= s
    return n


def test_shard_odd(odd):
    rows = sharding.shard(odd, 3, carried=("lang",)).collect()
    assert len(rows) == odd.count() and {r.text_crc32 for r in rows if r.doc_id == 3} == {None}
    assert sharding.shard(odd.limit(0)).count() == 0


# near duplicates


def _sets(texts):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    found = {}
    for i, t in texts.items():
        w = (t or "").encode().translate(low).split()
        found[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return found


def _components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(sets)
    for n, a in enumerate(order):
        for b in order[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates(documents, texts):
    sets = _sets(texts)
    want = _components(sets)
    rows = neardup.near_duplicates(documents).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {i: (len(sets[i]), c, c == i) for i, c in want.items()}
    assert neardup.without_near_duplicates(documents).count() == len(set(want.values()))


def test_near_duplicates_within_crowded_buckets(spark):
    random = np.random.default_rng(8)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(60):  # near misses of each other, and some links
        words = list(base)
        for at in random.choice(120, int(random.integers(1, 9)), replace=False):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    want = _components(_sets(dict(rows)))
    assert len(set(want.values())) > 1
    assert dict(taken(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "component_id")) == want


def test_signature_bounds_and_components(spark):
    bounds = neardup.least_agreements()
    assert list(bounds) == list(neardup.STEPS) and all(m / n < 0.75 for n, m in bounds.items())
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (100, 300)], "a long, b long")
    found = dict(taken(neardup.components(chain), "uid", "component"))
    assert found == {**{i: 0 for i in range(1, 41)}, 200: 100, 300: 100}


def test_near_duplicates_odd(odd):
    rows = taken(neardup.near_duplicates(odd), "doc_id", "n_shingles", "component_id", "kept")
    assert len(rows) == odd.count()
    assert (2, rows[1][1], 1, False) in rows and (3, 0, 3, True) in rows and (4, 0, 4, True) in rows and (None, 1, None, True) in rows
    assert neardup.without_near_duplicates(odd).columns == odd.columns
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


def test_one_row_of_each_kept_document_stays(spark):
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, long)] * 3 + [(2, long)] * 2 + [(3, other), (4, None), (4, None), (5, " "), (5, " "), (6, "x y"), (6, "p q"), (6, "p q"), (6, ""), (None, other), (None, other)]
    docs = spark.createDataFrame([(i, t, "en", str(n), n, "x", "y") for n, (i, t) in enumerate(rows)], DOCS)
    left = neardup.without_near_duplicates(docs)
    assert left.columns == docs.columns
    found = collections.Counter((r.doc_id, r.text) for r in left.collect())
    assert found == {(1, long): 1, (3, other): 1, (4, None): 2, (5, " "): 2, (6, "x y"): 1, (6, "p q"): 1, (6, ""): 1, (None, other): 2}


# repeated passages


def _without_repeats(rows):
    seen, found = set(), {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            key = tuple(w[j : j + 20])
            if key in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(key)
        found[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return found


def test_repeats(documents, texts):
    rows = substrings.without_repeats(documents).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == _without_repeats(texts.items())
    assert all(sum(s.n_words for s in r.removed) == r.n_removed for r in rows)


def test_repeats_at_every_offset(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(i, " ".join(f"a{i}_{j}" for j in range(i)) + " " + passage + f" z{i}") for i in range(25)]
    rows += [(90, passage + " " + passage), (91, " ".join(passage.split()[:19])), (92, "r " * 50), (80, "r " * 50)]
    found = substrings.without_repeats(spark.createDataFrame(rows[::-1], "doc_id long, text string").coalesce(1))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()} == _without_repeats(rows)


def test_repeats_odd(odd):
    rows = taken(substrings.without_repeats(odd), "doc_id", "n_words", "n_removed")
    assert len(rows) == odd.count() and (2, 30_000, 30_000) in rows and (3, 0, 0) in rows and (None, 2, 0) in rows
    assert substrings.without_repeats(odd.limit(0)).count() == 0


# toxicity


def test_maximal_segments_against_all_segments():
    random = np.random.default_rng(1)
    for _ in range(200):
        scores = [float(x) for x in random.integers(-4, 5, 14)]
        found = toxicity.maximal_segments(scores)
        left, want = [(0, len(scores))], []
        while left:  # the definition: take the best segment, then go on to its left and right
            a, b = left.pop()
            best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] > 0:
                want.append(best)
                left += [(a, best[3]), (best[4], b)]
        assert sum(s[2] for s in found) == pytest.approx(sum(w[0] for w in want))
        assert max((s[2] for s in found), default=0) == pytest.approx(max((w[0] for w in want), default=0))


def test_toxicity_finds_planted_words(spark):
    random = np.random.default_rng(2)
    vocabulary = ["".join(chr(97 + c) for c in random.integers(0, 26, 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = [vocabulary[j] for j in random.integers(0, 300, 60)]
        if i % 5 == 0:
            words[20:23] = ["vile", "nasty", "rotten"]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 5 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity.detect(docs, labels).collect()
    out = [r for r in found if r.held_out]
    assert {r.held_out for r in found} == {True, False} and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert np.mean([(r.doc_id % 5 == 0) == bool(r.predicted) for r in out]) > 0.98
    hit = next(r for r in found if r.doc_id % 5 == 0)
    assert any(p.start <= 20 and p.end >= 23 for p in hit.passages)
    assert toxicity.without_toxic(docs, labels).columns == ["doc_id", "text"]
    assert toxicity.detect(docs.limit(0), labels).count() == 0


def test_toxicity_reads_one_kind_of_tokens(spark):
    """What a token is for the counts it is for the scores: runs of letters of any script, with or without signs at their ends."""
    rows = [(i, f"{i} b\u00e9 word{chr(97 + i % 26)} x\u00b2y {'zap\u00b2 \u0130nk' if i % 4 == 0 else 'calm'}", int(i % 4 == 0)) for i in range(800)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert set(model.lexicon) <= {t for _, text, _ in rows for t in toxicity.tokens(text)}
    assert {t for t in toxicity.tokens("zap\u00b2 \u0130nk")} <= set(model.lexicon)
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in toxicity.detect(docs, labels).collect())


def test_toxicity_odd(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 0, 1), (6, 1, 0), (None, 1, 1), (2, 0, None)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        rows = toxicity.detect(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in rows)
    assert toxicity.without_toxic(odd, some).columns == odd.columns


@pytest.mark.parametrize(("toxic_of_20", "slips"), [(11, 0.0), (4, 0.04)])
def test_toxicity_of_balanced_labels_and_of_words_that_clean_texts_hold(spark, toxic_of_20, slips):
    random = np.random.default_rng(5)
    word = lambda: "".join(chr(97 + c) for c in random.integers(0, 26, 6))
    vocabulary, bad, rows, labels = [word() for _ in range(300)], [word() for _ in range(5)], [], []
    for i in range(800):
        words, toxic = [vocabulary[j] for j in random.integers(0, 300, 60)], i % 20 < toxic_of_20
        if toxic:
            words[20:23] = [bad[j] for j in random.choice(5, 3, replace=False)]
        else:  # one of the words alone
            words = [bad[random.integers(0, 5)] if random.random() < slips / 4 else w for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = [r for r in toxicity.detect(docs, labels).collect() if r.held_out]
    assert np.mean([(r.doc_id % 20 < toxic_of_20) == bool(r.predicted) for r in out]) > 0.95


def test_nothing_is_toxic_without_labels_of_both_kinds(spark, odd):
    label = lambda *rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    unknown, held = label((1, 0, None), (2, 0, None)), label((6, 1, 1), (3, 1, 0)).where(toxicity.held_out())
    for labels in (label(), unknown, held, label((1, 0, 1), (2, 0, 1), (5, 0, 1)), label((1, 0, 0), (2, 0, 0))):
        assert {(r.score, r.predicted) for r in toxicity.detect(odd, labels).collect()} == {(0.0, 0)}
        assert toxicity.without_toxic(odd, labels).count() == odd.count()


# language


def test_forward_backward_against_enumeration():
    random = np.random.default_rng(4)
    moves, starts = random.normal(size=(3, 3)), random.normal(size=3)
    lengths = [1, 2, 5, 3]
    emission = random.normal(size=(sum(lengths), 3))
    owner = np.repeat(np.arange(4), lengths)
    found = langid.forward_backward(owner, emission, moves, starts)
    for o, n in enumerate(lengths):
        e = emission[owner == o]
        want = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            w = math.exp(starts[path[0]] + sum(e[t, s] for t, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            for t, s in enumerate(path):
                want[t, s] += w
        assert np.allclose(found[owner == o], want / want.sum(axis=1, keepdims=True))


def test_forward_backward_over_blocks():
    random = np.random.default_rng(6)
    moves, starts, n = random.normal(size=(4, 4)), random.normal(size=4), 5 * langid.BLOCK + 7
    emission = random.normal(size=(n, 4)) * 3
    a = [starts + emission[0]]
    for t in range(1, n):
        a.append(np.logaddexp.reduce(a[-1][:, None] + moves, axis=0) + emission[t])
    b = [np.zeros(4)]
    for t in range(n - 2, -1, -1):
        b.append(np.logaddexp.reduce(moves + emission[t + 1] + b[-1], axis=1))
    z = np.array(a) + np.array(b[::-1])
    want = np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True))
    assert np.allclose(langid.forward_backward(np.zeros(n, int), emission, moves, starts), want)


def test_language_held_out(documents):
    langs = {r.doc_id: r.lang for r in documents.collect()}
    rows = langid.identify(documents).collect()
    out = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in out]) >= 0.95
    assert all(0 <= r.score <= 1 and sum(s.n_words for s in r.segments) > 0 for r in rows)


def test_language_of_switched_text(spark, documents):
    model = langid.fit(documents)
    by = {r.lang: r.text for r in documents.orderBy("doc_id").collect() if len(r.text.split()) > 60}
    a, b = (" ".join(by[x].split()[:60]) for x in ("de", "en"))
    row = langid.label(spark.createDataFrame([(1, f"{a} {b}")], "doc_id long, text string"), model).first()
    share = collections.Counter()
    for s in row.segments:
        for i in range(s.start, s.start + s.n_words):
            share[(i >= 60, s.lang)] += 1
    assert share[(False, "de")] >= 50 and share[(True, "en")] >= 50


def test_language_odd(spark, odd):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count() and all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert {r.lang_pred for r in langid.identify(odd.where("lang is null")).collect()} == {"und"}
    assert langid.identify(odd.limit(0)).count() == 0


# decontamination


def test_leaks(spark):
    item = "Yesterday Alice bought 12 apples for 3 dollars each and then Alice ate 4 of the apples with Carol."
    other = item.replace("Alice", "Bob").replace("Carol", "Dave").replace("12", "99").replace("dollars", "euros")
    broken = other.replace("then Bob", "then Eve")
    rows = [(1, "Noise first. " + other), (2, "Noise first. " + broken), (3, "nothing of the kind is here " * 3), (4, None), (5, ""), (6, item), (6, item), (None, item), (None, "else")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, item, 1), (8, "too short", 1), (9, None, 1), (None, "", 1)], "item_id long, text string, pos int")
    found = taken(decontaminate.contamination(docs, items), "doc_id", "contaminated", "item_ids")
    # Two names stand for one of the item in the second, but in no window together.
    want = [(1, True, "7"), (2, True, "7"), (3, False, ""), (4, False, ""), (5, False, ""), (6, True, "7"), (6, True, "7"), (None, True, "7"), (None, False, "")]
    assert found == sorted(want, key=repr)
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == 4
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), items).count() == 0


def test_leaks_in_another_case(spark):
    item = "Last week old Alice Miller sold 12 apples to Bob Stone in Paris, U.S.A, and then Carol Reed ate 4 of the apples with Dave."
    rows = list(enumerate([item, item.upper(), item.lower(), item.title(), item.upper().replace("12", "99"), item.lower().replace("alice", "nobody").replace("carol", "nobody else"), "NOTHING OF THE KIND IS HERE " * 3]))
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    for texts_, leaked in ((docs, [0, 1, 2, 3, 4]), (docs.where("doc_id < 2"), [0, 1])):
        found = {r.doc_id for r in decontaminate.contamination(texts_, items).where("contaminated").collect()}
        assert found - {5} == set(leaked)
    loud = spark.createDataFrame([(7, item.upper())], "item_id long, text string")
    assert {0, 1, 2, 3, 4} <= {r.doc_id for r in decontaminate.contamination(docs, loud).where("contaminated").collect()}


def test_leaks_that_contradict_themselves_somewhere(spark):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    words[3] = words[33] = words[53] = "Alice"
    words[20], words[40] = "12", "34"
    item = " ".join(words)
    one = " ".join([*words[:53], "Eve", *words[54:]])  # a copy with one other name
    renamed = item.replace("Alice", "Bob").replace("12", "56")
    far = " ".join([*renamed.split()[:53], "Eve", *renamed.split()[54:]])
    short = " ".join(["Other" if i % 7 == 3 else w for i, w in enumerate(words)])  # no window is copied, and names stand for many
    rows = [(1, one), (2, far), (4, short), (5, item), (6, renamed)]
    many = " ".join([w if i % 7 != 3 else w.capitalize() for i, w in enumerate(words)])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.n_windows for r in decontaminate.contamination(docs.where("doc_id != 4"), spark.createDataFrame([(7, item)], "item_id long, text string")).where("contaminated").collect()}
    assert set(found) == {1, 2, 5, 6}
    assert found[5] == found[6] == 53
    assert found[1] == found[2] == 53
    # Many names became one, which is a substitution; the other way round, each window that sees two of them contradicts itself.
    found = decontaminate.contamination(docs.where("doc_id = 4"), spark.createDataFrame([(8, many)], "item_id long, text string"))
    assert found.where("contaminated").count() == 1
    apart = " ".join(["Other" if i % 3 == 2 else w for i, w in enumerate(words)])
    named = " ".join([w.capitalize() if i % 3 == 2 else w for i, w in enumerate(words)])
    found = decontaminate.contamination(spark.createDataFrame([(1, named)], "doc_id long, text string"), spark.createDataFrame([(8, apart)], "item_id long, text string"))
    assert found.where("contaminated").count() == 0


def test_leaks_with_equal_numbers_and_with_type_characters(spark):
    item = "if a train takes 12 hours to go there and 7 hours to come back again"
    texts_ = [(1, item.replace("12", "30").replace("7", "30")), (2, " ".join("\ue000" + w for w in item.split())), (3, "\ue001".join(item)), (4, item.replace("7", "12")), (5, "\ue000 \ue003")]
    docs = spark.createDataFrame(texts_, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, item.replace("7", "12")), (3, "the"), (4, "go there"), (5, None)], "item_id long, text string")
    found = {r.doc_id: r.item_ids for r in decontaminate.contamination(docs, items).collect()}
    # The second item has one number twice, so texts with two different ones meet it only where a window holds one of them.
    assert found[1] == found[4] == "1,2" and all(found[i].split(",")[0] == "1" for i in (2, 3)) and found[5] == ""
    assert {r.item_id: r.n_words for r in decontaminate.left_out(items).collect()} == {3: 1, 4: 2, 5: 0}
    assert "3" in {r.doc_id: r.item_ids for r in decontaminate.contamination(spark.createDataFrame([(1, "see the end")], "doc_id long, text string"), items, shortest=1).collect()}[1]


def _template(text):
    """(folded words, plain, shape, kinds) by the rules that the operator states, word by word."""
    import regex

    marked = "".join(c for c in text or "" if c not in "\ue000\ue001\ue002\ue003")
    marked = regex.sub(r"(^|[.!?]\p{P}*[ \t\r\n]+|\n[ \t]*)(\p{Lu})", "\\1\ue003\\2", marked)
    marked = regex.sub(r"(^|[^\p{L}\p{N}.,:/])(\p{N}+(?:[.,:/]\p{N}+)*)", "\\1\ue000\\2", marked)
    marked = regex.sub("(^|[^\\p{L}\\p{M}\\p{N}\ue003'’-])(\\p{Lu})", "\\1\ue001\\2", marked)
    found = regex.findall(decontaminate.TOKEN, marked.upper().lower())
    words = [t.replace("\ue001", "") for t in found]
    plain = ["\ue000" if w.startswith("\ue000") else "\ue002" if w in decontaminate.UNITS else w for w in words]
    shape = ["\ue001" if t.startswith("\ue001") else p for t, p in zip(found, plain)]
    return words, plain, shape, [int(p in ("\ue000", "\ue002")) + 2 * (s == "\ue001") for p, s in zip(plain, shape)]


def _template_windows(text, lengths):
    words, plain, shape, kinds = _template(text)
    for n in lengths:
        for i in range(len(words) - n + 1):
            w, p, s, k = words[i : i + n], plain[i : i + n], shape[i : i + n], kinds[i : i + n]
            yield tuple(p if sum(x % 2 == 0 for x in k) >= decontaminate.LITERAL or not any(x % 2 for x in k) else w), i, w, k
            if any(x > 1 for x in k) and k.count(0) >= decontaminate.LITERAL:
                yield tuple(s), i, w, k


def test_leaks_against_brute_force(spark, documents, texts):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    by, lengths = collections.defaultdict(list), set()
    for r in items.collect():
        n = min(len(_template(r.text)[0]), 8)
        if n >= 3:
            lengths.add(n)
            for shape, i, w, k in _template_windows(r.text, [n]):
                by[shape].append((r.item_id, i, w, k))
    random = np.random.default_rng(1)
    changed = {10_000 + i: "".join(str(random.integers(2, 99)) if c.isdigit() else c for c in t) for i, t in texts.items()}
    changed |= {20_000 + i: t.title() for i, t in list(texts.items())[:60]}
    expected = {}
    for i, text in {**texts, **changed}.items():
        met = set()
        for shape, at, w, _ in _template_windows(text, sorted(lengths)):
            for item, there, other, kinds in by.get(shape, []):
                slots = {(("n" if b.startswith("\ue000") else k), b, a) for a, b, k in zip(w, other, kinds) if k}
                if len(slots) == len({x[:2] for x in slots}):
                    met.add((item, at - there, there))
        if met:
            expected[i] = (len(met), ",".join(map(str, sorted({m[0] for m in met}))))
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(list(changed.items()), "doc_id long, text string"))
    found = {r.doc_id: (r.n_windows, r.item_ids) for r in decontaminate.contamination(docs, items).where("contaminated").collect()}
    assert expected and found == expected


def test_leaks_of_short_items_and_of_many_slots(spark):
    items = ["What is 12 times 7?", "Who wrote Faust?", "3 km 5 m 7 cm 2 mm 9 g 4 kg", "7 8 9 10 11 12 13 14 15 16", "!!", None]
    texts_ = [
        ("Now, what is 12 times 7? Say it.", "0"), ("WHO WROTE FAUST? Goethe did.", "1"), ("who wrote faust", "1"), ("Who wrote it?", ""),
        ("take 3 km 5 m 7 cm 2 mm 9 g 4 kg of it", "2"), ("take 3 km 5 m 7 cm 1 mm 9 g 4 kg of it", ""), ("1 2 3 4 5 6 7 8 9 10 11 12 13 14", "3"),
        ("7 8 9 10 11 12 13", ""), ("Faust", ""), ("what is 13 times 7", ""), ("", ""), (None, ""),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts_)], "doc_id long, text string")
    found = decontaminate.contamination(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {r.doc_id: r.item_ids for r in found.collect()} == {i: w for i, (_, w) in enumerate(texts_)}


def test_leaks_of_whole_table(spark, documents, texts):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    strip = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()]
    windows = {tuple(w[i : i + 9]) for r in items.collect() for w in [strip(r.text)] for i in range(len(w) - 8)}
    held = {i for i, t in texts.items() for w in [strip(t)] if any(tuple(w[j : j + 9]) in windows for j in range(len(w) - 8))}
    found = {r.doc_id for r in decontaminate.contamination(documents, items).where("contaminated").collect()}
    assert held and held <= found and len(found - held) <= 1


# revisits


def test_revisits(spark):
    H = lambda **k: {a.replace("_", "-"): b for a, b in k.items()}
    rows = [
        ("r1", "response", "http://WWW.Ex.org:80/a/?utm_x=1#f", 10, H(etag='"1"', server="s", date="10"), "d1"),
        ("r2", "response", "https://ex.org/a", 20, H(etag='"2"', last_modified="m"), "d2"),
        ("r3", "response", "https://ex.org/a", 20, H(etag='"3"'), "d3"),
        ("v1", "revisit", "ex.org/a", 15, H(etag='W/"1"', date="15", server="new"), None),
        ("v2", "revisit", "https://ex.org/a/", 20, H(etag='"2"'), None),
        ("v3", "revisit", "https://ex.org/a", 30, H(), None),
        ("v4", "revisit", "https://ex.org/b", 30, None, None),
        ("v5", "revisit", None, 30, None, None),
        ("v6", "revisit", "https://ex.org/a", None, None, None),
        ("v7", "revisit", "https://ex.org/a", 9_000_000, H(etag='"9"'), None),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "record_id string, kind string, url string, time long, headers map<string,string>, digest string, span int")
    found = {r.record_id: (r.origin_id, r.verdict, r.digest, r.headers) for r in revisits.resolve(df).collect()}
    assert found == {
        "v1": ("r1", "etag", "d1", {"etag": 'W/"1"', "server": "s", "date": "15"}),
        "v2": ("r1", "mismatch", None, {"etag": '"2"'}),
        "v3": ("r3", "unchecked", "d3", {"etag": '"3"'}),
        "v4": (None, "unresolved", None, {}),
        "v5": (None, "unresolved", None, {}),
        "v6": (None, "unresolved", None, {}),
        "v7": ("r3", "mismatch", None, {"etag": '"9"'}),
    }
    assert revisits.resolve(df.union(df)).count() == 14
    assert revisits.resolve(df.limit(0)).count() == 0


def test_revisits_against_brute_force(spark):
    random = np.random.default_rng(9)
    rows = [(i, "response" if random.random() < 0.4 else "revisit", f"h/{random.integers(0, 3)}", int(random.integers(0, 60)) * 1000) for i in range(400)]
    df = spark.createDataFrame([(str(i).zfill(4), k, u, t, {}, str(i)) for i, k, u, t in rows], "record_id string, kind string, url string, time long, headers map<string,string>, digest string")
    found = dict(taken(revisits.resolve(df), "record_id", "origin_id"))
    for i, kind, url, time in rows:
        if kind == "revisit":
            best = max(((t, str(j).zfill(4)) for j, k, u, t in rows if k == "response" and u == url and t < time), default=(0, None))
            assert found[str(i).zfill(4)] == best[1]


# nearest neighbours


def test_nearest_recall_and_scores(spark):
    df = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    found = collections.defaultdict(list)
    for r in forest.nearest(df, 10, 50).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    hits = []
    for q, got in found.items():
        want = sorted((float(np.sqrt(((x - rows[q]) ** 2).sum())), i) for i, x in rows.items() if i != q)[:10]
        hits.append(len({i for _, i in want} & {i for i, _ in got}) / 10)
        assert all(s == pytest.approx(float(np.sqrt(((rows[i] - rows[q]) ** 2).sum())), abs=1e-12) for i, s in got)
        assert [(s, i) for i, s in got] == sorted((s, i) for i, s in got) and len(got) == 10
    assert set(found) == {i for i in rows if i % 50 == 0} and np.mean(hits) >= 0.9


def test_nearest_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [inf, 1.0]), (None, [1.0, 1.0]), (200, []), (9, [1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, v int")
    assert taken(forest.nearest(df), "query_id", "rank", "vec_id", "score") == [(100, 1, 1, 0.0), (100, 2, 3, 0.0), (100, 3, 2, math.sqrt(2))]
    copies = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)], "vec_id long, embedding array<float>")
    assert [r[2] for r in taken(forest.nearest(copies, 10, 20), "query_id", "rank", "vec_id") if r[0] == 20] and {r.vec_id for r in forest.nearest(copies, 10, 20).where("query_id = 20").collect()} == set(range(10))
    assert forest.nearest(df.limit(0)).count() == 0


# chats


def _digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    told = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chats_come_back(spark):
    found = {r.conv_id: tuple(r)[1:5] for r in QUERIES["op10_format_chats"](spark, SF).collect()}
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    turns[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert found == {k: _digest(v) for k, v in turns.items()}


def test_chats_escape_and_flatten(spark):
    nasty = ["<|end|>\n", "\\", "|\\|", "<", "<|turn|>assistant\nx", "\\n", "", "a<", "|b", "😀|"]
    rows = [(1, n, "assistant" if n % 2 else "us|er\n\\", [{"type": "text", "text": t}]) for n, t in enumerate(nasty)]
    rows += [(2, 0, "user", [{"type": "text", "text": "a<"}, {"type": "image", "ref": "i", "width": 28, "height": 15}, {"type": "text", "text": "|b"}, {"type": "audio", "ref": "s", "seconds": 1.5}, {"type": "document", "pages": 2}, {"type": "odd", "text": "?"}, {"type": None, "text": None}])]
    rows += [(2, 0, "user", None), (2, None, None, []), (None, 1, "assistant", [{"type": "text", "text": "x"}])]
    df = spark.createDataFrame([(*r, 5) for r in rows], f"conv_id long, turn long, role string, content array<{chat.PART}>, formatted int")
    formatted = chat.format_chats(df)
    back = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(formatted).collect()}
    assert back[1] == _digest([(r[2], r[3][0]["text"]) for r in rows[:10]]) and back[None] == _digest([("assistant", "x")])
    two = formatted.where("conv_id = 2").first()
    assert [(a.number, a.type, a.ref, a.n_tokens) for a in two.attachments] == [(0, "image", "i", 4), (1, "audio", "s", 38), (2, "document", None, 1024)]
    assert all(two.formatted[a.start :].startswith(f"<|{a.type}:{a.number}|>") for a in two.attachments) and two.n_tokens == 1066
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_loss_leaves_placeholders_out(spark):
    parts = [{"type": "text", "text": "see |"}, {"type": "image", "ref": "i", "width": 28, "height": 28}, {"type": "text", "text": ""}, {"type": "audio", "seconds": 1.0}, {"type": "odd", "text": "end\\"}]
    rows = [(n, t, role, parts) for n in range(300) for t, role in enumerate(["user", "assistant", "assistant"])] + [(-1, 0, "assistant", [parts[1]]), (-1, 1, "assistant", None)]
    formatted = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat.PART}>"))
    for r in formatted.collect():
        under = [chat.unescape(r.formatted[s.start : s.end]) for s in r.loss]
        assert under == ([] if r.conv_id < 0 else ["see |", "", "end\\"] * 2)
        assert all(s.end <= a.start or s.start > a.start for s in r.loss for a in r.attachments)
        assert [(a.turn, a.type) for a in r.attachments] == ([(0, "image")] if r.conv_id < 0 else [(t, k) for t in range(3) for k in ("image", "audio")])


# pipeline and queries


def test_pipeline(spark, documents, texts):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == documents.columns, name
        docs = corpus_pipeline.common.stored(docs)
        assert docs.count() > 0
    placed = corpus_pipeline.run(spark, SF)
    assert taken(placed, "doc_id") == taken(docs, "doc_id")


def test_pipeline_odd(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.stored(stage(spark, docs, SF))
    assert docs.count() > 0
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.stored(stage(spark, docs, SF))
    assert docs.count() == 0
