"""Language identification of mixed text: script ranges, per-word scores, Viterbi with a switching penalty.

A word (run of letters) can only belong to languages whose training texts use its script.
Its score under each of them is the sum of smoothed log-probabilities of the letter
trigrams around its letters. Viterbi over the words of a text, with a cost for changing
language, labels spans; the text gets the language that labels most of its letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippletrace.llm.common import chunked, session

#: Documents per language that the model learns from at most, trigram cells, cost of a change of language.
SAMPLE, CELLS, PENALTY = 20_000, 1 << 16, 9.0
#: A script counts as a language's own from this share of its training letters.
SCRIPT_SHARE = 0.02
#: A single word says no more than this for one language against another.
MOST = 25.0
CHUNK = 1 << 20
POINTS = 0x30000

# First code points of script blocks (from the Unicode block list) and their scripts.
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0250, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"),
    (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
    (0x1800, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1D00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"),
    (0x2E00, "other"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"),
    (0x31F0, "kana"), (0x3200, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"),
    (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"),
    (0x20000, "han"),
)
SCRIPTS = tuple(dict.fromkeys(s for _, s in SCRIPT_STARTS))


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case letter (0 for what is no letter) and its script's number."""
    letter = np.zeros(POINTS, dtype=np.uint32)
    for i in range(POINTS):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            letter[i] = ord(low) if len(low) == 1 else i
    starts = np.array([s for s, _ in SCRIPT_STARTS])
    kind = np.array([SCRIPTS.index(s) for _, s in SCRIPT_STARTS], dtype=np.int16)
    return letter, kind[np.searchsorted(starts, np.arange(POINTS), side="right") - 1]


class Letters:
    """The letters of several texts, their trigram cells, and the words they form."""

    def __init__(self, texts: list[str]) -> None:
        letter, script = tables()
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        points = np.where(points < POINTS, points, 0)
        low = letter[points]
        at = np.flatnonzero(low)
        self.at = at
        before = np.where(at > 0, low[at - 1], 0).astype(np.uint32)
        after = low[np.minimum(at + 1, len(low) - 1)]
        x = before * np.uint32(0x9E3779B1) ^ low[at] * np.uint32(0x85EBCA6B) ^ after * np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        self.cell = ((x ^ (x >> np.uint32(13))) & np.uint32(CELLS - 1)).astype(np.int64)
        self.word = np.flatnonzero(before == 0)  # index into the letters of each word's first
        self.script = script[points[at]]
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.start = np.concatenate([[0], np.cumsum(size + 1)])  # each text's first code point
        self.first = np.searchsorted(at[self.word], self.start)  # each text's first word
        self.letters = np.diff(np.append(self.word, len(at)))


class Model:
    """Log-probabilities of trigram cells by language, and the scripts of each language."""

    def __init__(self, names: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        self.names = names
        total = counts.sum(axis=1, keepdims=True)
        self.table = np.ascontiguousarray(np.log((counts + 0.05) / (total + 0.05 * CELLS)).T.astype(np.float32))
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.uses = (share >= SCRIPT_SHARE).T  # script x language

    def scores(self, x: Letters) -> tuple[np.ndarray, np.ndarray]:
        """Score of each word under each language, and whether any language has its script."""
        n = len(x.word)
        if not n:
            return np.zeros((0, len(self.names)), dtype=np.float32), np.zeros(0, dtype=bool)
        score = np.add.reduceat(self.table[x.cell], x.word, axis=0)
        able = self.uses[x.script[x.word]]
        known = able.any(axis=1)
        score[known[:, None] & ~able] = -np.inf
        score = np.maximum(score - score.max(axis=1, keepdims=True), -MOST)
        score[~known] = 0
        return score, known


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word; texts are slices of ``score`` between values of ``first``."""
    label = np.zeros(len(score), dtype=np.int16)
    size = np.diff(first)
    hard = []
    for i in np.flatnonzero(size).tolist():
        part = score[first[i] : first[i + 1]]
        best = int(part.sum(axis=0, dtype=np.float64).argmax())
        gain = np.cumsum(part - part[:, best : best + 1], axis=0, dtype=np.float64)
        low = np.minimum.accumulate(np.vstack([np.zeros(part.shape[1]), gain[:-1]]), axis=0)
        if (gain - low).max() <= penalty / 2:  # no stretch is worth a change of language
            label[first[i] : first[i + 1]] = best
        else:
            hard.append(i)
    hard.sort(key=lambda i: size[i])
    for a in range(0, len(hard), 128):
        docs = np.array(hard[a : a + 128])
        base, n = first[docs], size[docs]
        most = int(n.max())
        value = np.zeros((len(docs), score.shape[1]))
        back = np.empty((most, len(docs), score.shape[1]), dtype=np.int16)
        own = np.arange(score.shape[1], dtype=np.int16)
        for t in range(most):
            live = int(np.searchsorted(n, t, side="right"))  # sorted by size: those still running
            v = value[live:]
            top = v.argmax(axis=1)
            peak = v[np.arange(len(v)), top] - penalty
            stay = v >= peak[:, None]
            back[t, live:] = np.where(stay, own, top[:, None].astype(np.int16))
            value[live:] = np.where(stay, v, peak[:, None]) + score[base[live:] + t]
        state = value.argmax(axis=1)
        for t in range(most - 1, -1, -1):
            live = int(np.searchsorted(n, t, side="right"))
            who = np.arange(live, len(docs))
            label[base[live:] + t] = state[live:]
            state[live:] = back[t, who, state[live:]]
    return label


def is_held_out(doc_id: Column) -> Column:
    """Documents that the model never learns from: crc32 of the id as text is divisible by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labelled documents (text, lang): at most about ``sample`` of each language, chosen by hash.

    The counts are summed in Spark; the driver gets at most one number per language and
    trigram cell, and per language and script.
    """
    session(docs.sparkSession)
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((0, CELLS)), np.zeros((0, len(SCRIPTS))))
    names = sorted(sizes)
    bound = F.create_map(*(x for n in names for x in (F.lit(n), F.lit(min(1.0, sample / sizes[n])))))
    chosen = labelled.filter(
        F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1_000_000)) < bound[F.col("lang")] * 1_000_000
    )
    schema = pa.schema([("lang", pa.string()), ("cell", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in chunked(batches, "text", CHUNK):
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                x = Letters([t for t, g in zip(texts, langs, strict=True) if g == lang])
                to = sums.setdefault(lang, np.zeros(CELLS + len(SCRIPTS), dtype=np.int64))
                to[:CELLS] += np.bincount(x.cell, minlength=CELLS)
                to[CELLS:] += np.bincount(x.script, minlength=len(SCRIPTS))
        for lang, to in sums.items():
            at = np.flatnonzero(to)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(to[at])], schema=schema
            )

    counted = chosen.select("text", "lang").mapInArrow(count, "lang string, cell int, n long")
    rows = counted.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((len(names), CELLS + len(SCRIPTS)))
    out[rows["lang"].map(names.index).to_numpy(dtype=np.int64), rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return Model(names, out[:, :CELLS], out[:, CELLS:])


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY, spans: bool = True) -> DataFrame:
    """Label the spans of every whole text and predict its language.

    Adds to each input row lang_pred (``und`` for null texts and texts without letters, or
    if nothing was learned), score (share of letters in spans of that language; 0 if no
    language knows the script) and, if asked for, spans (start and end as code points,
    lang). Ties go to the first language by code point. Rows are independent: repeated
    rows get equal results, an empty table an empty one.
    """
    spark = session(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)  # languages x 65536 floats
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in chunked(batches, "text", CHUNK):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            x = Letters(texts)
            pred, share, found = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            if m.names and len(x.word):
                score, known = m.scores(x)
                label = viterbi(score, x.first, penalty)
                doc = np.repeat(np.arange(len(texts)), np.diff(x.first))
                weight = np.zeros((len(texts), len(m.names)))
                np.add.at(weight, (doc, label), x.letters * known)
                letters = np.bincount(doc, weights=x.letters, minlength=len(texts))
                best = weight.argmax(axis=1)
                top = weight.max(axis=1) / np.maximum(letters, 1)
                for i in np.flatnonzero(letters).tolist():
                    pred[i], share[i] = m.names[best[i]], float(top[i])
                if spans:
                    change = np.ones(len(doc), dtype=bool)
                    change[1:] = (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])
                    at = np.flatnonzero(change)
                    last = np.append(at[1:], len(doc)) - 1
                    begin = x.at[x.word[at]] - x.start[doc[at]]
                    end = x.at[x.word[last]] + x.letters[last] - x.start[doc[at]]
                    for d, s, e, w in zip(doc[at].tolist(), begin.tolist(), end.tolist(), at.tolist(), strict=True):
                        found[d].append({"start": s, "end": e, "lang": m.names[label[w]]})
            arrays = [batch.column(1), pa.array(pred, pa.string()), pa.array(share, pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(found, span)] if spans else arrays,
                names=["row", "lang_pred", "score", "spans"][: 4 if spans else 3],
            )

    columns = docs.columns
    packed = docs.select(F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    kind = packed.schema["row"].dataType.simpleString()
    out = packed.mapInArrow(
        run,
        f"row {kind}, lang_pred string, score double"
        + (", spans array<struct<start:long,end:long,lang:string>>" if spans else ""),
    )
    return out.select("row.*", "lang_pred", "score", *(["spans"] if spans else []))
