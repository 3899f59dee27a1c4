"""Operator 11: toxicity, by a classifier that is fitted under a counterfactual penalty.

A text is the set of its words and of the first 3 to 8 bytes of each; words are ASCII letters and all other characters
above 127, with A-Z in lower case. Spark counts the features over a bounded sample of labelled documents; those that
tell the classes apart, and all that identity terms have, make the model's columns. A logistic regression with weights
of 0 and more (nothing in a text makes it less toxic) is fitted to the sample. To the loss comes the mean squared change
of a labelled sentence's score when an identity term in it is swapped for another of its group: sentences that hold one
are taken as they are, and each document also lends its first sentence with a term put in front. Every text is then
scored in tasks by array look-ups of its features' hashes.

The fit sees at most MAX_LABELLED documents, the same ones in every run, and never one that is held out, whose labels
nothing reads. Scoring sees every whole text; lang, source, doc_id and labels aren't features.

Defined cases: a null or empty text has the score of the intercept; a null doc_id is held out and is never learned from;
of several labels of a doc_id the larger counts, and each row of a repeated doc_id is scored for itself; without a toxic
label nothing is toxic; texts are taken whole, whatever their length; an empty table gives an empty table; extra
columns are ignored. Ties of features go to the smaller hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, table
from .wordhash import BASE, BYTE, U, chunks, spans

#: Every fifth document, by the checksum of its id, is held out.
HELD_OUT = 5
#: Labelled documents that the model is fitted on, and columns that it has besides those of identity terms.
MAX_LABELLED = 20_000
MAX_COLUMNS = 8_192
#: Documents that a feature must be in.
MIN_DOCS = 4
#: Bytes of a word's beginning that are features; 0 is the whole word.
PREFIXES = (0, 3, 4, 5, 6, 7, 8)
#: Swapped sentences that one document lends to the fit.
MAX_SWAPS = 8
#: Weight of the counterfactual penalty, of the sum of weights, and of their squares.
COUNTERFACTUAL, SPARSE, RIDGE = 10.0, 2e-4, 1e-5
ROUNDS = 600

# Groups of identity terms; each may stand for another of its group.
IDENTITY = tuple(
    tuple(group.split())
    for group in (
        "women men girls boys", "woman man girl boy", "gay straight lesbian bisexual trans", "muslim christian jewish hindu buddhist atheist", "muslims christians jews hindus buddhists atheists",
        "black white asian latino", "immigrants natives refugees foreigners", "young old elderly", "disabled blind deaf autistic", "african european american asian",
        "frauen männer mädchen jungen", "schwule lesben", "muslime christen juden", "ausländer flüchtlinge einheimische", "femmes hommes filles garçons", "musulmans chrétiens juifs", "immigrés réfugiés étrangers",
        "mujeres hombres chicas chicos", "musulmanes cristianos judíos", "inmigrantes refugiados extranjeros",
    )
)

#: What a byte of a word becomes in lower case; 0 for bytes between words.
LETTER = np.zeros(256, np.uint8)
LETTER[128:] = np.arange(128, 256)
LETTER[97:123] = LETTER[65:91] = np.arange(97, 123)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % HELD_OUT == 0


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The text and the hash of each word and beginning of a word in texts, with repeats."""
    low = LETTER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    edge = np.diff(np.concatenate([[0], (low != 0).view(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    doc = np.searchsorted(starts, first, side="right") - 1
    values, docs, hashes = BYTE[low], [], []
    for k in PREFIXES:
        some = slice(None) if not k else np.flatnonzero(last - first > k)
        end = last if not k else first[some] + k
        docs.append(doc[some])
        # the length keeps a word apart from an equal beginning
        hashes.append(spans(values, BASE, first[some], end) ^ U(k))
    return np.concatenate(docs), np.concatenate(hashes)


class Columns:
    """Numbers of known hashes."""

    def __init__(self, hashes: np.ndarray):
        self.known = np.sort(hashes)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.known >> U(44)] = True

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, column) of texts, sorted."""
        doc, h = features(texts)
        maybe = np.flatnonzero(self.seen[h >> U(44)])
        doc, h = doc[maybe], h[maybe]
        at = np.searchsorted(self.known, h)
        at[at == len(self.known)] = 0
        right = self.known[at] == h if len(self.known) else np.zeros(0, bool)
        both = np.unique(doc[right] * len(self.known) + at[right])
        return both // max(1, len(self.known)), both % max(1, len(self.known))


def identity_hashes() -> np.ndarray:
    return np.unique(features([t.encode() for group in IDENTITY for t in group])[1])


def swaps(text: str) -> Iterator[tuple[str, str]]:
    """Sentences of text with an identity term, and each with the next term of its group in its place; then the first sentence with a term in front, and with the next one."""
    import re

    terms = {t: (g, i) for g, group in enumerate(IDENTITY) for i, t in enumerate(group)}
    sentences = [s for s in re.split(r"[.!?\n]+", text) if s.strip()]
    done = 0
    for s in sentences:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", s.lower())
        for i, w in enumerate(words):
            if w in terms and done < MAX_SWAPS:
                g, k = terms[w]
                done += 1
                yield " ".join(words), " ".join([*words[:i], IDENTITY[g][(k + 1) % len(IDENTITY[g])], *words[i + 1 :]])
    if sentences:
        group = IDENTITY[len(text) % len(IDENTITY)]
        k = len(sentences[0]) % len(group)
        yield f"{group[k]} {sentences[0]}", f"{group[(k + 1) % len(group)]} {sentences[0]}"
        yield f"{group[k]} {sentences[0]}", sentences[0]


def _counted(batches: Iterator) -> Iterator:
    """(text, toxic) -> feature, n, toxic: documents with it, and toxic ones."""
    import pyarrow as pa

    for b in batches:
        texts, toxic = [(t or "").encode() for t in b.column(0).to_pylist()], b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j in chunks(texts):
            doc, h = features(texts[i:j])
            order = np.lexsort((doc, h))
            doc, h = doc[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            doc, h = doc[new], h[new]
            known, at = np.unique(h, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(np.bincount(at, minlength=len(known))), pa.array(np.bincount(at, toxic[i:j][doc], len(known)).astype(np.int64))], ["feature", "n", "toxic"])


def _rows(columns: Columns):
    """(text, toxic) -> toxic, at (the document's columns), plus and minus (columns of its swapped sentences, with gaps of -1 between sentences)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def lists(doc, at, n):
            return [x.tolist() for x in np.split(at, np.searchsorted(doc, np.arange(1, n)))]

        for b in batches:
            texts, toxic = [t or "" for t in b.column(0).to_pylist()], b.column(1)
            coded = [t.encode() for t in texts]
            out = [x for i, j in chunks(coded) for x in lists(*columns.of(coded[i:j]), j - i)]
            plus, minus = [], []
            for t in texts:
                pairs = list(swaps(t))
                a, c = ([lists(*columns.of([p[k].encode() for p in pairs]), len(pairs)) if pairs else [] for k in (0, 1)])
                plus.append([x for p, q in zip(a, c) for x in [*sorted({*p} - {*q}), -1]])
                minus.append([x for p, q in zip(a, c) for x in [*sorted({*q} - {*p}), -1]])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([toxic, pa.array(out, ints), pa.array(plus, ints), pa.array(minus, ints)], ["toxic", "at", "plus", "minus"])

    return run


@dataclass
class Model:
    """hashes in order, a weight for each, and the intercept."""

    hashes: np.ndarray
    weights: np.ndarray
    shift: float
    #: Pairs of sentences in the penalty, and their mean squared change of score.
    pairs: int = 0
    change: float = 0.0

    def scores(self, texts: list[bytes], columns: Columns) -> np.ndarray:
        doc, at = columns.of(texts)
        z = self.shift + np.bincount(doc, self.weights[at], len(texts)) if len(self.weights) else np.full(len(texts), self.shift)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fitted(row: np.ndarray, at: np.ndarray, y: np.ndarray, pair: np.ndarray, pair_at: np.ndarray, sign: np.ndarray, width: int, counterfactual: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights of 0 and more, and the intercept, by accelerated proximal steps in a diagonal metric. (row, at): the columns of each document; (pair, pair_at, sign): those in which two sentences differ."""
    n, m = len(y), int(pair.max()) + 1 if len(pair) else 0
    size = np.bincount(row, minlength=n) + 1.0
    bound = 0.25 * np.bincount(at, size[row], width) / n + RIDGE
    if m:
        spread = np.bincount(pair, minlength=m)
        bound += 2 * counterfactual * np.bincount(pair_at, spread[pair].astype(float), width) / m
    bound0 = 0.25 * size.mean()
    rate = (y.sum() + 0.5) / (n + 10)
    w, b = np.zeros(width), float(np.log(rate / (1 - rate)))
    v, c, t = w, b, 1.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(c + np.bincount(row, v[at], n), -30, 30)))
        slope = np.bincount(at, (p - y)[row], width) / n + RIDGE * v
        if m:
            d = np.bincount(pair, sign * v[pair_at], m)
            slope += 2 * counterfactual * np.bincount(pair_at, sign * d[pair], width) / m
        w1, b1 = np.maximum(0, v - (slope + SPARSE) / bound), c - (p - y).mean() / bound0
        t1 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    return w, float(b)


def _gaps(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists with a -1 behind each sentence -> the sentence's number, and the column."""
    flat = np.array([x for r in lists for x in r], np.int64)
    ends = flat < 0
    return (np.cumsum(ends) - ends)[~ends], flat[~ends]


def fit(docs: DataFrame, labels: DataFrame, counterfactual: float = COUNTERFACTUAL) -> Model:
    """The model of the labelled documents that aren't held out."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    some = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED))
    sample = Written(docs.select("doc_id", "text").join(some, "doc_id").select("text", "toxic"), "labelled")
    counts = Written(sample.df.mapInArrow(_counted, "feature long, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= MIN_DOCS), "features")
    total = sample.df.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n, toxic = total["n"], total["toxic"] or 0
    shift = float(np.log((toxic + 0.5) / (n - toxic + 9.5)))
    if not toxic:
        return Model(np.zeros(0, U), np.zeros(0), shift)
    # how far the toxic documents with a feature exceed their share, in standard deviations
    rate = toxic / n
    excess = (F.col("toxic") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    best = counts.df.where(F.col("toxic") > F.col("n") * rate).orderBy(F.desc(excess), "feature").limit(MAX_COLUMNS).select("feature").collect()
    columns = Columns(np.unique(np.concatenate([np.array([r["feature"] for r in best], np.int64).view(U), identity_hashes()])))
    rows = sample.df.mapInArrow(_rows(columns), "toxic int, at array<int>, plus array<int>, minus array<int>").collect()
    counts.drop()
    sample.drop()
    row = np.repeat(np.arange(len(rows)), [len(r["at"]) for r in rows])
    at, y = np.array([x for r in rows for x in r["at"]], np.int64), np.array([r["toxic"] > 0 for r in rows], float)
    (p, p_at), (q, q_at) = _gaps([r["plus"] for r in rows]), _gaps([r["minus"] for r in rows])
    pair, pair_at, sign = np.concatenate([p, q]), np.concatenate([p_at, q_at]), np.concatenate([np.ones(len(p)), -np.ones(len(q))])
    w, b = fitted(row, at, y, pair, pair_at, sign, len(columns.known), counterfactual)
    m = int(pair.max()) + 1 if len(pair) else 0
    change = float((np.bincount(pair, sign * w[pair_at], m) ** 2).mean()) if m else 0.0
    some = w > 0
    return Model(columns.known[some], w[some], b, m, change)


def _scored(model: Model):
    columns = Columns(model.hashes)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            score = [model.scores(texts[i:j], columns) for i, j in chunks(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(score) if score else np.zeros(0))], ["doc_id", "score"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(_scored(model), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op11_toxicity": op11_toxicity}
ORACLE: dict[str, str] = {}
