"""Mixing, packing and the pipeline."""

import json
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rippletrace.llm import mixing, packing
from rippletrace.llm.queries import tokenizer_path

from .conftest import corpus, frame, prose


def test_quotas():
    assert mixing.quotas([100, 100, 100], [3, 1, 2], 450, 2) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.quotas([10, 100], [3, 1], 165, 2) == pytest.approx([20, 145])
    assert mixing.quotas([], [], 0, 2) == [] and mixing.quotas([0, 4], [3, 1], 6, 2) == pytest.approx([0, 6])


def test_flow_prefers_first_uses():
    # two overlapping sources: the shared pattern is used once before anything repeats
    gives = mixing.route([((0,), 10), ((0, 1), 10), ((1,), 10)], [15.0, 15.0], 2)
    assert sum(gives) == 30 and max(gives) == 10
    assert mixing.route([((0,), 10)], [17.0], 2) == [17] and mixing.route([((0,), 10)], [50.0], 2) == [20]


@pytest.fixture(scope="module")
def mix_docs(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(1, 60)), rng.choices([None, "b", "a", "é"], [1, 6, 2, 1])[0]) for i in range(800)]
    rows += [(900, None, "a"), (901, "", None), (902, " ", "b"), (None, "some words", "b")]
    return spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, rank int")


def test_mix(mix_docs):
    got = mixing.mix(mix_docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(mix_docs.repartition(7)).collect()))  # reruns agree
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        s = r["sources"][0]
        assert 0 <= r["taken"] <= 2 * r["size"]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["source_size"] > 0
    names = sorted(size, key=lambda s: (s is None, s or ""))
    assert names == ["a", "b", "é", None]
    want = mixing.quotas([size[s] for s in names], [3, 1, 2, 3], 1.5 * sum(size.values()), 2)
    for s, w in zip(names, want, strict=True):
        assert target[s] == pytest.approx(w) and abs(taken[s] - w) <= 60
    times = mixing.mixed_rows(mix_docs).groupBy("doc_id").count().collect()
    by_id = {r["doc_id"]: r["taken"] // r["size"] for r in got if r["size"]}
    assert {r["doc_id"]: r["count"] for r in times if r["doc_id"] in by_id} == {i: n for i, n in by_id.items() if n}


def test_mix_overlap_and_empty(mix_docs):
    both = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("x"), F.lit("y"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("x"))).otherwise(F.array(F.lit("y")))
    got = mixing.mix(mix_docs, sources=both).collect()
    total = sum(r["size"] for r in got)
    assert abs(sum(r["taken"] for r in got) - 1.5 * total) <= 180
    assert mixing.mix(mix_docs.limit(0)).collect() == []


def pieces_of(text):
    import public_tokenizers  # noqa: F401
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def test_packing(spark):
    rows = [*corpus(4, 40), (500, "<|endoftext|> special"), (501, prose(random.Random(9), 4000)), (None, "x y")]
    df = frame(spark, [*rows, rows[1]])
    cut = packing.pieces(df, tokenizer_path(), capacity=512).cache()
    got = packing.pack(cut, capacity=512, shard=30).collect()
    assert len(got) == cut.count()
    by_doc = defaultdict(set)
    for r in got:
        by_doc[r["doc_id"]].add((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, text in rows:
        ids, mine = pieces_of(text), sorted(by_doc[i])
        assert [p for p, *_ in mine] == list(range(len(mine))) and sum(n for _, _, n, _ in mine) == len(ids)
        assert len(mine) == -(-len(ids) // 512) and all(n == 512 for _, _, n, _ in mine[1:])
        for _, s, n, crc in mine:
            assert zlib.crc32(ids[s : s + n].tobytes()) == crc
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 512
    least = -(-sum(r["length"] for r in got) // 512)
    assert len(bins) <= least * 1.25 + 3
    assert packing.pack(packing.pieces(frame(spark, []), tokenizer_path())).collect() == []


def test_crossover_improves_hard_packings():
    """Triples that fill a bin exactly, dealt apart: best fit needs a sixth more bins, evolution wins some back."""
    rng = random.Random(4)
    for n, gain in ((20, 2), (60, 3)):
        lengths = []
        for _ in range(n):
            a = rng.randint(780, 1000)
            b = rng.randint(512, 2048 - a - 512)
            lengths += [a, b, 2048 - a - b]
        by_size = sorted(range(3 * n), key=lambda i: (-lengths[i], i))
        seed = packing.fitted(lengths, by_size, 2048)
        first = packing.evolve(lengths, 2048, [], 7, packing.POPULATION, packing.CROSSOVERS)
        second = packing.evolve(lengths, 2048, [first], 8, packing.POPULATION, packing.CROSSOVERS)
        best = packing.grouped(second)
        assert sorted(i for b in best for i in b) == list(range(3 * n)) and all(sum(lengths[i] for i in b) <= 2048 for b in best)
        assert n <= len(best) <= len(seed) - gain


def test_only_plain_tokenizer_files_take_the_faster_encoder():
    with open(tokenizer_path(), encoding="utf-8") as f:
        file = json.load(f)
    assert packing.is_plain(file)
    for edit in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {**file["pre_tokenizer"], "add_prefix_space": True}}):
        assert not packing.is_plain({**file, **edit})
    swapped = [file["model"]["merges"][1], file["model"]["merges"][0], *file["model"]["merges"][2:]]
    assert not packing.is_plain({**file, "model": {**file["model"], "merges": swapped}})


def test_evolution_never_loses_a_piece():
    rng = random.Random(2)
    lengths = [rng.randint(1, 100) for _ in range(300)]
    first = packing.evolve(lengths, 100, [], 1, 3, 4)
    again = packing.evolve(lengths, 100, [first, packing.evolve(lengths, 100, [], 2, 3, 4)], 3, 3, 4)
    n = []
    for blob in (first, again):
        bins = packing.grouped(blob)
        assert sorted(i for b in bins for i in b) == list(range(300)) and all(sum(lengths[i] for i in b) <= 100 for b in bins)
        n.append(len(bins))
    large = sum(n > 50 for n in lengths)  # no two of these fit together
    assert n[1] <= n[0] <= max(-(-sum(lengths) // 100), large) + 6


def test_rows_without_an_id_pass_the_near_duplicate_stage(spark):
    import corpus_pipeline as P

    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text), (2, text), (None, text), (None, "some other words, and a few more of them"), (3, "short"), (3, "short")]
    kept = P.drop_near_duplicates(spark, frame(spark, rows), "")
    assert kept.columns == list(P.COLUMNS)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted((i or 0, t) for i, t in rows if i != 2)


def test_stages_on_odd_rows(spark):
    """Null ids and texts, repeated rows and ties through every stage but the last; empty tables through all."""
    import corpus_pipeline as P

    rng = random.Random(9)
    long = prose(rng, 130)
    rows = [(1, long), (1, long), (None, long), (None, None), (2, None), (3, ""), (4, prose(rng, 60)), (4, prose(rng, 60)), (None, prose(rng, 40))]
    docs = frame(spark, rows)
    language = P.identify_language(spark, docs, "")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in language.collect()) == sorted((i or 0, t) for i, t in rows if t)
    near = P.drop_near_duplicates(spark, docs, "")
    # a repeated row is the same document: both stay, as does what has no id
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in near.collect()) == sorted((i or 0, t or "") for i, t in rows)
    passages = P.drop_repeated_passages(spark, docs.filter("doc_id IS NOT NULL"), "").collect()
    assert {r["doc_id"] for r in passages} == {1, 2, 3, 4} and sum(len((r["text"] or "").split()) for r in passages) == 2 * 130 + 120
    mixed = P.mix_sources(spark, docs, "")
    assert {r["text"] for r in mixed.collect()} <= {t for _, t in rows}
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), "").collect() == [], name


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    from .test_dedup import brute_components, brute_words

    rows = corpus(6, 50)
    df = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = dict(rows)
    kept = {r["doc_id"] for r in seen["language ID"]}
    assert {i for i, t in texts.items() if i not in kept} == {i for i, t in texts.items() if not any(c.isalpha() for c in t or "")}
    groups = brute_components([(i, t) for i, t in rows if i in kept], 5, 80)
    assert {r["doc_id"] for r in seen["n-gram Jaccard join"]} == {i for i, (_, c) in groups.items() if i == c}
    words = brute_words([(r["doc_id"], r["text"]) for r in seen["n-gram Jaccard join"]], 50)
    after = {r["doc_id"]: r["text"].split() for r in seen["substring dedup"]}
    assert all(after[i] == kept_text.encode().decode().split() for i, (n, gone, kept_text) in words.items() if gone < n or not n)
    used = sorted(r["doc_id"] for r in seen["mixing"])
    assert set(used) <= set(after)
    assert sorted(r["doc_id"] for r in seen["packing"] if r["piece"] == 0) == used
    assert P.run(spark, str(tmp_path)).count() == len(seen["packing"]) and P.ORACLE_SQL is None
