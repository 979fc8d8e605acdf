"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms of a text are windows of three byte classes, hashed words and signs of repetition. A bounded
sample of labelled texts gives term weights and, by an eigendecomposition of the weighted term matrix,
a latent space. The sample's latent vectors are broadcast; every text's cosines with all of them are
computed in blocks, and the nearest vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutalake.llm.common import Words, shingle_hashes, slices, whole

#: Labelled texts of each mark that the classifier is fitted on.
SAMPLE = 2000
LATENT, NEIGHBOURS = 48, 25
#: Texts multiplied with the sample together.
BLOCK = 256
WORD_TERMS, LAGS = 280, 4
_GROUPS = ["", " ", "\n\t\r\v\f", ".", ",", "!?", "#*$%&", "|<>", "0123456789"]


def _classes() -> np.ndarray:
    out = np.full(256, 9, dtype=np.int64)  # other signs and control bytes
    for k, signs in enumerate(_GROUPS):
        out[list(signs.encode())] = k
    out[list(range(97, 123))] = 0
    out[list(b"aeiouy")] = 10
    out[128:] = 11
    out[65:91] = 9
    out[list(b"@_-/:;()[]{}=+~^\\\"'`")] = 8
    return out


_CLASS = _classes()
N_CLASSES = 12
TERMS = N_CLASSES**3 + WORD_TERMS + LAGS + 3


def term_counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, counts of TERMS terms) of each text."""
    for first, data, offsets in slices(texts):
        words = Words(data, offsets)
        hashes = words.hashes()
        c = _CLASS[data]
        code = c.copy()
        code[2:] += c[:-2] * N_CLASSES**2
        code[1:] += c[:-1] * N_CLASSES
        bucket = N_CLASSES**3 + (hashes % np.uint64(WORD_TERMS)).astype(np.int64)
        triples = shingle_hashes(hashes, 3) if len(hashes) >= 3 else hashes[:0]
        for k in range(len(offsets) - 1):
            a, b = words.bounds[k], words.bounds[k + 1]
            terms = np.bincount(np.concatenate([code[offsets[k] + 2 : offsets[k + 1]], bucket[a:b]]), minlength=TERMS).astype(np.float32)
            own = hashes[a:b]
            at = N_CLASSES**3 + WORD_TERMS
            for lag in range(1, LAGS + 1):
                terms[at + lag - 1] = (own[lag:] == own[:-lag]).sum()
            seen = triples[a : max(a, b - 2)]
            terms[at + LAGS] = len(seen) - len(np.unique(seen))
            terms[at + LAGS + 1] = 1 + max(0, 50 - (b - a)) / 10
            terms[at + LAGS + 2] = 1
            yield first + k, terms


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Voters:
    """The latent space and the labelled vectors in it."""

    def __init__(self, counts: np.ndarray, marks: np.ndarray, share: float):
        df = (counts > 0).sum(0)
        self.idf = np.log((1 + len(counts)) / (1 + df)) + 0.3
        self.idf[-(LAGS + 3) :] = 2.0
        x = weighted(counts, self.idf)
        values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        self.axes = np.ascontiguousarray(vectors[:, ::-1][:, :LATENT])
        self.vectors = self.latent(counts)
        self.marks = marks.astype(np.float32)
        # Each mark's votes count as its share of all labelled texts, not of the sample.
        good = max(marks.mean(), 1e-9)
        self.weight = np.where(marks == 1, share / good, (1 - share) / max(1 - good, 1e-9)).astype(np.float32)
        self.share = share

    def latent(self, counts: np.ndarray) -> np.ndarray:
        z = weighted(counts, self.idf).astype(np.float64) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        # Rounded, so that a text's cosines don't depend on the block it is in; ties go to the smaller id.
        cosines = np.round(self.latent(counts) @ self.vectors.T, 9)
        k = min(NEIGHBOURS, cosines.shape[1])
        rank = (cosines * 1e9).astype(np.int64) * cosines.shape[1] - np.arange(cosines.shape[1])
        near = np.sort(np.argpartition(-rank, k - 1, axis=1)[:, :k], axis=1)
        # Similarity over the k-th neighbour's counts most: weights fall to a tenth there.
        own = np.take_along_axis(cosines, near, 1)
        least = own.min(1, keepdims=True)
        weight = (np.maximum(own - least, 0) / np.maximum(own.max(1, keepdims=True) - least, 1e-6) + 0.1) * np.maximum(own, 1e-3) * self.weight[near]
        return (weight * self.marks[near]).sum(1) / weight.sum(1)


def fit(docs: DataFrame, labels: DataFrame, training: Column, sample: int = SAMPLE) -> Voters | float:
    """Voters from labelled rows for which training (on doc_id) holds; a constant score if fewer than two marks occur."""
    marks = labels.where("doc_id is not null and mark is not null").where(training).select("doc_id", (F.col("mark") == 1).cast("int").alias("mark"))
    shares = {r.mark: r.n for r in marks.groupBy("mark").agg(F.count("*").alias("n")).collect()}
    share = shares.get(1, 0) / max(1, sum(shares.values()))
    if len(shares) < 2:
        return share if shares else 0.5
    order = F.xxhash64("doc_id")
    chosen = marks.where("mark = 0").orderBy(order, "doc_id").limit(sample).union(marks.where("mark = 1").orderBy(order, "doc_id").limit(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x.astype(np.float32).tobytes() for _, x in term_counts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(rows, pa.binary())], names=["doc_id", "mark", "terms"])

    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "mark").mapInArrow(run, "doc_id long, mark int, terms binary").collect()  # 2 * sample rows, of about 8 kB each
    rows.sort(key=lambda r: (r.doc_id, r.mark))
    found = np.array([r.mark for r in rows])
    if len(set(found.tolist())) < 2:
        return share
    return Voters(np.stack([np.frombuffer(r.terms, dtype=np.float32) for r in rows]), found, share)


def vote_quality(docs: DataFrame, labels: DataFrame, training: Column, key: str = "doc_id", text: str = "text", mark: str = "quality", cutoff: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    training: a condition on doc_id; labels of other rows are never read for the fit. Null and empty
    texts have the vector of a text without terms and are scored alike. Labels with null ids or marks
    are left out; without both marks the score is the good share (0.5 without labels). Repeated rows
    are scored each; ties in similarity go to the smaller id, so equal texts score alike; an empty
    table gives no rows; other columns are neither read nor returned.
    """
    source = whole(docs, key, text)
    voters = fit(source, labels.select(F.col(key).alias("doc_id"), F.col(mark).alias("mark")), training, sample)
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for at in range(0, batch.num_rows, BLOCK):
                if isinstance(shared.value, float | int):
                    scores = np.full(len(ids.slice(at, BLOCK)), float(shared.value))
                else:
                    scores = shared.value.scores(np.stack([x for _, x in term_counts(batch.column("text").slice(at, BLOCK))])).astype(np.float64)
                yield pa.RecordBatch.from_arrays([ids.slice(at, BLOCK), pa.array(np.clip(scores, 0, 1))], names=["doc_id", "score"])

    scored = source.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (~F.coalesce(training, F.lit(False))).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
