"""Substring, suffix-array and Jaccard deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rippletrace.llm import exchange, hashing, jaccard_join, substring_dedup, suffix_dedup
from rippletrace.llm.graph import components, forest

from .conftest import frame, prose


def brute_words(rows, window):
    seen, out = set(), {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


def brute_bytes(rows, length):
    seen, out = set(), {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (text or "").encode()
        gone = [False] * len(b)
        mine = {b[s : s + length] for s in range(len(b) - length + 1)}
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = [True] * length
        seen |= mine
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("window", [20, 3])
def test_substring(docs, rows, window):
    want = brute_words(rows, window)
    got = substring_dedup.dedup(docs, window, carry=("lang", "keys")).collect()
    assert len(got) == len(rows) + 2 and {r["keys"] for r in got} == {"k"}
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_words"], r["n_removed"], r["kept"]) == want[r["doc_id"]]
            assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


@pytest.mark.parametrize("length", [50, 12])
def test_suffix(docs, rows, length):
    want = brute_bytes(rows, length)
    for r in suffix_dedup.dedup(docs, length).collect():
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"]]
            assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


@pytest.mark.parametrize("f", [lambda d: substring_dedup.dedup(d), lambda d: suffix_dedup.dedup(d), lambda d: jaccard_join.jaccard_components(d)])
def test_empty_table(spark, f):
    assert f(frame(spark, [])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=70), min_size=2, max_size=12), st.integers(6, 20))
def test_deep_shallow_orders_like_a_dictionary(texts, length):
    """Repetitive strings reach the tries; the least owner of each string must come out."""
    texts = [t for t in texts if len(t) >= length]
    if not texts:
        return
    blob = np.frombuffer("".join(texts).encode(), np.uint8)
    suffixes, owners, keys, at = [], [], [], 0
    for k, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            suffixes.append(at + s)
            owners.append((k * 7) % 5)
            keys.append(t[s : s + length])
        at += len(t)
    least = {}
    for key, o in zip(keys, owners, strict=True):
        least[key] = min(o, least.get(key, o))
    got = suffix_dedup.deep_shallow(blob, np.array(suffixes), np.array(owners), length, shallow=8)
    assert got.tolist() == [least[k] for k in keys]


def brute_components(rows, k, percent):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for i, text in rows:
        w = (text or "").encode().translate(lower).split()
        sets[i] = {tuple(w[s : s + k]) for s in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard(spark, rows, k, percent, monkeypatch):
    rows = [*rows, (900, rows[2][1].upper()), rows[0]]
    want = brute_components(rows, k, percent)
    got = jaccard_join.jaccard_components(frame(spark, rows), k, percent).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    # the same, block by block
    monkeypatch.setattr(jaccard_join, "BLOCK", 120)
    monkeypatch.setattr(jaccard_join, "SKETCHES", 3)
    again = jaccard_join.jaccard_components(frame(spark, rows), k, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in again} == want


class Pair:
    """Two shingle sets in the form of a batch."""

    def __init__(self, a, b):
        self.hash = np.concatenate([np.sort(a), np.sort(b)])
        self.row = np.repeat([0, 1], [len(a), len(b)])
        self.size = np.array([len(a), len(b)])


def meet(a, b, percent):
    keys, owner = jaccard_join.part_keys(Pair(a, b), np.array([True, True]), percent)
    return bool(set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist()))


@pytest.mark.parametrize("percent", [80, 90])
def test_sketch_parts_never_lose_a_pair(percent):
    """Sets within the bound meet, whichever elements differ."""
    rng = np.random.default_rng(1)
    for n in (12, 40, 150, 300, 700, 2500):
        base = rng.integers(1, 1 << 62, n, dtype=np.uint64)
        spare = rng.integers(1, 1 << 62, n, dtype=np.uint64)
        most = n * (100 - percent) // (100 + percent)
        for drop in sorted({1, most // 2, most} - {0}):
            b = np.concatenate([base[drop:], spare[:drop]])
            both = n - drop
            if 100 * both >= percent * (2 * n - both):
                assert meet(base, b, percent)


@pytest.mark.parametrize("percent,n", [(80, 300), (90, 400), (90, 1500), (80, 2000)])
def test_sketch_parts_under_the_worst_changes(percent, n):
    """An adversary who changes the fullest parts, one element each, still leaves weak ones that meet."""
    rng = np.random.default_rng(n)
    base = rng.integers(1, 1 << 62, n, dtype=np.uint64)
    bounds = jaccard_join.bands(percent, n * 100 // percent + 1)
    m_of = jaccard_join.parts_of(bounds, percent)
    group = int(np.searchsorted(bounds, n, side="right")) - 1
    half = n * (100 - percent) // (100 + percent)
    m = int(m_of[group])
    part = ((base % np.uint64(m << 20)) >> np.uint64(20)).astype(np.int64)
    fullest = np.argsort(-np.bincount(part, minlength=m), kind="stable")
    gone = [int(np.flatnonzero(part == p)[0]) for p in fullest[:half]]
    come = (fullest[half : 2 * half].astype(np.uint64) << np.uint64(20)) + rng.integers(1, 1 << 20, half).astype(np.uint64)
    b = np.unique(np.concatenate([np.delete(base, gone), come[: half - 1]]))
    both = len(np.intersect1d(base, b))
    assert 100 * both >= percent * (n + len(b) - both) and meet(base, b, percent)


def test_keys_stay_in_proportion_to_shingles():
    rng = np.random.default_rng(3)
    for n in (500, 5000, 50000):
        a = rng.integers(1, 1 << 62, n, dtype=np.uint64)
        keys, _ = jaccard_join.part_keys(Pair(a, a[:1]), np.array([True, False]), 80)
        assert len(keys) < 1.5 * n


@pytest.mark.parametrize("percent", [80, 90])
def test_sketches_only_part_dissimilar_sets(percent):
    """The edges between sketches connect whatever similar pairs connect; folding keeps the bound."""
    rng = np.random.default_rng(5)
    base = [rng.integers(1, 1 << 62, n, dtype=np.uint64) for n in (40, 63, 64, 70, 130, 1000)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) < keep], rng.integers(1, 1 << 62, extra, dtype=np.uint64)])) for b in base for keep, extra in ((1, 0), (0.95, 0), (0.9, 2), (0.85, 9), (0.5, 5))]
    s = Pair.__new__(Pair)
    s.size = np.array([len(x) for x in sets])
    s.hash, s.row = np.concatenate(sets), np.repeat(np.arange(len(sets)), s.size)
    sketch = jaccard_join.Shingles.sketches(s)
    for side in (np.zeros(len(sets), dtype=bool), np.arange(len(sets)) % 2 == 1):
        root = list(range(len(sets)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for i, j in jaccard_join.alike(s.size, sketch, side, percent):
            assert find(i) != find(j)
            root[find(i)] = find(j)
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and (side[i] != side[j] or not side.any()):
                    assert find(i) == find(j)


def test_jaccard_in_a_large_group_of_near_copies(spark, monkeypatch):
    """A third of the rows are near copies of one text, some of them linked only through others."""
    monkeypatch.setattr(jaccard_join, "ROWS", 8)
    rng = random.Random(7)
    words = prose(rng, 60).split()
    rows = [(i, prose(rng, rng.randint(3, 70))) for i in range(100, 160)]
    for i in range(30):
        w = list(words)
        for at in rng.sample(range(60), rng.randint(0, 2)):
            w[at] = f"x{i}"
        rows.append((i, " ".join(w)))
    chain = list(words)
    for i in range(30, 50):  # each some words further from the original
        chain[i] = f"y{i}"
        rows.append((i, " ".join(chain)))
    rows += [(7, prose(rng, 60)), (8, rows[70][1]), (8, rows[3][1])]  # ids that stand for two texts
    texts = dict.fromkeys(i for i, _ in rows)
    assert len(texts) == len(rows) - 3
    unique = [(1000 + n, t) for n, (_, t) in enumerate(rows)]
    want = brute_components(unique, 3, 80)
    got = jaccard_join.jaccard_components(frame(spark, unique), 3, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len(jaccard_join.jaccard_components(frame(spark, rows), 3, 80).collect()) == len(rows)


def test_jaccard_without_ids(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (3, "a b c d"), (None, "e f g h"), (5, None)]
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(frame(spark, rows), 3, 90).collect()), key=str)
    assert got == sorted([(None, 3), (None, 3), (3, 3), (None, None), (5, 5)], key=str)


@pytest.mark.parametrize("alone", [None, 0])
def test_components(spark, alone):
    edges = [(1, 2), (2, 3), (7, 8), (9, 8), (20, 21), *((100, i) for i in range(101, 160)), *((i, i + 1) for i in range(300, 340))]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    got = {r["node"]: r["component"] for r in components(df, alone=alone).collect()}
    assert got[3] == 1 and got[9] == 7 and got[21] == 20 and got[159] == 100 and got[340] == 300 and len(got) == len({x for e in edges for x in e})
    a, b = forest(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(1, 3), (1, 5), (8, 9)]
    assert components(df.limit(0), alone=alone).collect() == []


@given(st.lists(st.tuples(st.integers(-5, 1 << 40), st.integers(0, 1 << 20)), max_size=40))
def test_squeezing_round_trip(rows):
    docs, places = (np.array(x, dtype=np.int64) for x in (zip(*rows, strict=True) if rows else ([], [])))
    got = exchange.spread(exchange.squeezed(docs, places), 1)
    assert got[0].tolist() == docs.tolist() and got[1].tolist() == places.tolist()


@given(st.binary(max_size=200))
def test_words_are_bytes_between_white_space(raw):
    data = np.frombuffer(raw, np.uint8)
    offsets = np.array([0, len(raw) // 2, len(raw)])
    starts, ends, first = hashing.words(data, offsets)
    want = raw[: offsets[1]].split() + raw[offsets[1] :].split()
    assert [raw[a:b] for a, b in zip(starts, ends, strict=True)] == want and first[1] == len(raw[: offsets[1]].split())
    h = hashing.word_hashes(data, starts, ends)
    assert len(set(h.tolist())) == len(set(want))


def test_kept_digest(spark):
    from rippletrace.llm.queries import op1_substring_dedup  # noqa: F401  the query derives digests from the operator's output

    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
