"""Small corpora with copies, near copies, shared passages and odd rows."""

import random

import pytest

WORDS = "the of and to in is that for it with as was on be at by this from or an are not which have".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, keys string, row string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) if rng.random() < 0.3 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus(seed=0, n=60):
    """(doc_id, text): prose, exact and near copies, a shared passage, null, empty, blank and long texts."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(5, 150)) for _ in range(n)]
    passage = prose(rng, 70)
    for i in range(0, n, 6):
        texts.append(texts[i])
        w = texts[i].split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
        texts.append(f"{prose(rng, 10)} {passage}\n{prose(rng, 12)}")
    texts += [None, "", " \t\n ", "one", "two words", "The  OF\tand é ß 漢字 😀 x", "a" * 400, "ab " * 300, prose(rng, 3000), " x y  z \x1c q"]
    ids = list(range(1, len(texts) + 1))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def frame(spark, rows, **extra):
    full = [(i, t, extra.get("lang", "en"), f"s{(i or 0) % 3}", len(t or ""), 1, "k", "r") for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names clash with internal ones, a null id and a repeated row."""
    return frame(spark, [*rows, (None, rows[3][1]), rows[0]])
