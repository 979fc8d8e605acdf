"""Order-preserving packing of tokens into windows by dynamic programming with a monotone queue.

Documents keep the table's stored order. Cuts may fall at document ends, at sentence ends and, inside
very long sentences, every so many tokens. The plan minimises padding plus a penalty for each cut
document. best(j) = penalty(j) + min over i of best(i) + padding(i, j); for windows up to the limit
that is the minimum of best(i) + position(i) over a sliding range, kept in a monotone queue; window
lengths that need no padding (powers of two) are tried as well. Nothing is shuffled: each input split
is packed as a stream, in segments of bounded size, whose last window is carried into the next one.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from mutalake.llm.chunk_codec import RUN, ByteCodec, task_codec, texts_of
from mutalake.llm.common import whole

LIMIT = 1024
#: Tokens of a segment, at which its plan is made.
SEGMENT = 1 << 18
#: Cost in tokens of padding of a cut at a sentence's end and inside a sentence.
SENTENCE_CUT, HARD_CUT = 2.0, 12.0
#: Spacing of cuts inside a sentence that leaves no other.
HARD_STEP = 64
#: Lengths below the limit that need no padding and are tried.
FREE = (256, 512)


def plan(length: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Ends of the windows over tokens 0..length; the last is length. doc_ends holds length."""
    cost = np.full(length + 1, -1.0)
    cost[sentence_ends] = SENTENCE_CUT
    cost[doc_ends] = 0.0
    at = np.flatnonzero(cost >= 0)
    gaps = np.diff(at, prepend=0)
    long = np.flatnonzero(gaps > limit // 2)
    if len(long):
        step = min(HARD_STEP, max(1, limit // 2))
        extra = np.concatenate([np.arange(at[k] - gaps[k] + step, at[k], step) for k in long])
        cost[extra] = HARD_CUT
        at = np.flatnonzero(cost >= 0)
    at = at[at > 0]
    places = [0, *at.tolist()]
    penalty = [0.0, *cost[at].tolist()]
    free: dict[int, list[int]] = {}
    position = np.array(places)
    for n in FREE:
        if n < limit:
            j = np.searchsorted(position, position - n)
            for b in np.flatnonzero((position[j] == position - n) & (position >= n)).tolist():
                free.setdefault(b, []).append(int(j[b]))
    best, back = [0.0], [0]
    queue = deque([(0.0, 0, 0)])
    for j in range(1, len(places)):
        p = places[j]
        while queue[0][2] < p - limit:
            queue.popleft()
        low, i, _ = queue[0]
        value = low + limit - p
        for k in free.get(j, ()):
            if best[k] <= value:
                value, i = best[k], k
        value += penalty[j]
        best.append(value)
        back.append(i)
        value += p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j, p))
    ends, j = [], len(places) - 1
    while j:
        ends.append(places[j])
        j = back[j]
    return np.array(ends[::-1])


class _Stream:
    """The tokens of one split that are not yet in a window, and the documents they belong to."""

    def __init__(self, limit: int, ends: np.ndarray, first: int):
        self.limit, self.ends, self.sequence = limit, ends, first
        self.held, self.fresh, self.size = b"", [], 0  # bytes carried over, bytes of new documents, ids in both
        self.docs: list[tuple[int | None, int, int]] = []  # id, position of its first id here (negative if cut), ids

    def add(self, key: int | None, ids: bytes) -> None:
        self.docs.append((key, self.size, len(ids) // 4))
        self.size += len(ids) // 4
        self.fresh.append(ids)

    def pack(self, final: bool) -> list[tuple]:
        raw = self.held + b"".join(self.fresh)
        ids = np.frombuffer(raw, dtype="<u4")
        n = len(ids)
        if not n:
            return []
        doc_ends = np.array([p + k for _, p, k in self.docs])
        windows = plan(n, doc_ends, np.flatnonzero(self.ends[ids]) + 1, self.limit)
        kept = windows if final else windows[:-1]
        out, upto = [], int(kept[-1]) if len(kept) else 0
        if upto:
            cuts = np.unique(np.concatenate([[0], kept, doc_ends[doc_ends < upto]]))
            begins = np.array([p for _, p, _ in self.docs])
            owner = np.searchsorted(doc_ends, cuts[:-1], "right")
            window = np.searchsorted(kept, cuts[:-1], "right")
            heads = np.concatenate([[0], kept])[window]
            for a, b, d, w, h in zip(cuts[:-1].tolist(), cuts[1:].tolist(), owner.tolist(), window.tolist(), heads.tolist(), strict=True):
                key, _, total = self.docs[d]
                out.append((key, a - int(begins[d]), b - a, zlib.crc32(raw[4 * a : 4 * b]), total, self.sequence + w, a - h))
            self.sequence += len(kept)
        self.held = raw[4 * upto :]
        self.size = n - upto
        self.docs = [(key, p - upto, k) for key, p, k in self.docs if p + k > upto]
        self.fresh = []
        return out


def pack_documents(docs: DataFrame, model: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id of each row lies in exactly one piece; null and empty texts hold the end id alone. Rows
    with null or repeated keys are packed like others. Equal costs take the later cut. sequence_id
    is the split's number times 2**36 plus a counter. An empty table gives no rows; other columns
    are neither read nor returned.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    end = np.array([end_id], dtype="<u4").tobytes()

    def rows(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*made, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_codec(ByteCodec, model) as encoder:
            yield from packed(encoder, batches)

    def packed(encoder: ByteCodec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder.library.get_vocab(with_added_tokens=True)
        sentence = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for piece, i in vocabulary.items():
            sentence[i] = piece[-1:] in (".", "!", "?", "Ċ")  # the last is the vocabulary's sign for a line end
        stream = _Stream(limit, sentence, TaskContext.get().partitionId() << 36)
        waiting = 0
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for at in range(0, len(keys), RUN):
                for k, ids in zip(keys[at : at + RUN], encoder.encode(texts_of(batch.column("text"), at)), strict=True):
                    stream.add(k, ids + end)
                    waiting += len(ids) // 4 + 1
                    if waiting >= SEGMENT:
                        if made := stream.pack(False):
                            yield rows(made)
                        waiting = 0
        if made := stream.pack(True):
            yield rows(made)

    return whole(docs, key, text).mapInArrow(run, ", ".join(f"{x} long" for x in names))
