"""Tokenizers over tables of distinct chunks: each distinct chunk is segmented once and ids are joined back by position.

A chunk is what lies between two spaces, with the space before it. Pieces of both vocabularies
never cross the end of such a chunk, so a text's ids are the ids of its chunks in order. Texts in
which that doesn't hold (white space in a row, the space marker itself) are encoded whole.
Tables live as long as a task and hold a bounded number of characters; the vocabulary stays in its worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mutalake.llm.common import whole

#: Characters of keys that a table holds before it starts anew.
TABLE_CHARS = 6_000_000
#: Texts handled together.
RUN = 200
#: Missing chunks segmented in one call.
MISSING_RUN = 2000


class ChunkTable:
    """Chunk to value; encode(list of chunks) gives the values of those that are missing."""

    def __init__(self, encode):
        self.encode, self.values, self.chars = encode, {}, 0

    def cover(self, chunks: set[str]) -> dict:
        missing = [x for x in chunks if x not in self.values]
        if self.chars > TABLE_CHARS:
            self.values, self.chars, missing = {}, 0, list(chunks)
        self.values.update(zip(missing, self.encode(missing), strict=True))
        self.chars += sum(map(len, missing))
        return self.values

    def clear(self) -> None:
        self.values, self.chars = {}, 0


class PieceCodec:
    """The sentencepiece library's encode and decode, with an end id."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.odd: set[str] = set()
        self.table = ChunkTable(self._encode)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        plain = self.library.encode("a  b", out_type=str)
        self.apart = not any("▁" in x.lstrip("▁") for x in pieces) and "".join(plain) == "▁a▁▁b"
        self.end = self.library.eos_id()
        self.opens = np.array([x.startswith("▁") for x in pieces])
        self.shown = [b" %d" % i for i in range(len(pieces))]

    def _encode(self, chunks: list[str]) -> list[bytes | None]:
        """Missing chunks are segmented in runs, as one text each; a piece with the marker begins a chunk."""
        out: list[bytes | None] = []
        for at in range(0, len(chunks), MISSING_RUN):
            run = chunks[at : at + MISSING_RUN]
            text = " ".join(run)
            ids = self.library.encode(text)
            heads = np.flatnonzero(self.opens[ids]).tolist()
            if len(heads) != len(run):  # a piece crosses the marker somewhere: texts with these chunks are encoded whole
                out += [None] * len(run)
                continue
            if self.library.decode(ids) != text:
                self.odd.update(x for x in run if self.library.decode(self.library.encode(x)) != x)
            shown = [*map(self.shown.__getitem__, ids)]
            out += [b"".join(shown[i:j]) for i, j in zip(heads, [*heads[1:], len(ids)], strict=True)]
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(decimal ids, each after a space; decoded text) of each text."""
        parts = [x.split(" ") for x in texts]
        usable = [self.apart and bool(x) and "" not in p and "▁" not in x for x, p in zip(texts, parts, strict=True)]
        known = self.table.cover(set().union(*(p for p, ok in zip(parts, usable, strict=True) if ok)))
        out = []
        for text, p, ok in zip(texts, parts, usable, strict=True):
            own = [*map(known.__getitem__, p)] if ok else [None]
            if None not in own:
                ids = b"".join(own) + b" %d" % self.end
                same = not self.odd or self.odd.isdisjoint(p)
            else:
                ids, same = b"".join(b" %d" % i for i in [*self.library.encode(text), self.end]), False
            out.append((ids, text if same else self.library.decode([int(i) for i in ids.split()])))
        return out


class ByteCodec:
    """Ids of a byte-level BPE vocabulary file, as little-endian unsigned 32-bit bytes."""

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(model)
        self.added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.ranks = self._ranks(model)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for x, i in vocabulary.items() if x.startswith("Ġ")]] = True  # the vocabulary's sign for a space
        self.table = ChunkTable(self._encode)

    def _ranks(self, model: str):
        """The same vocabulary in the faster library; None if the file isn't the usual byte-level BPE."""
        import json

        import tiktoken

        with open(model, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if norm or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["model"].get("type") != "BPE":
            return None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        special = {x["content"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        # The vocabulary's usual splitting pattern, a fixed value.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _encode(self, chunks: list[str]) -> list[bytes | None]:
        """None for a chunk next to other white space, where splitting isn't safe. The rest is one text; a token with a leading space begins a chunk."""
        safe = [bool(x) and not (x[0].isspace() or x[-1].isspace()) for x in chunks]
        raw = self.ids("".join(" " + x for x, ok in zip(chunks, safe, strict=True) if ok))
        heads = np.flatnonzero(self.opens[np.frombuffer(raw, dtype="<u4")]).tolist()
        if len(heads) != sum(safe):  # a token crosses a space somewhere: texts with these chunks are encoded whole
            return [None] * len(chunks)
        spans = zip(heads, [*heads[1:], len(raw) // 4], strict=True)
        return [raw[4 * (x := next(spans))[0] : 4 * x[1]] if ok else None for ok in safe]

    def ids(self, text: str) -> bytes:
        if self.ranks:
            return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [x.split(" ") for x in texts]
        special = [any(a in x for a in self.added) for x in texts]
        known = self.table.cover(set().union(*(p[1:] for p, odd in zip(parts, special, strict=True) if not odd)))
        out = []
        for text, p, odd in zip(texts, parts, special, strict=True):
            if odd:
                out.append(np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes())
                continue
            rest = [*map(known.__getitem__, p[1:])]
            first = p[0]
            safe = None not in rest and not (first and first[-1].isspace()) and (first or not rest)
            out.append((self.ids(first) if first else b"") + b"".join(rest) if safe else self.ids(text))
        return out


_CODECS: dict[tuple[type, str], object] = {}


def codec(kind: type, model: str):
    """One codec for a worker and model file."""
    if (kind, model) not in _CODECS:
        _CODECS[kind, model] = kind(model)
    return _CODECS[kind, model]


@contextmanager
def task_codec(kind: type, model: str) -> Iterator:
    """The worker's codec for one task. Its table goes with the task, else workers that idle or serve other stages would hold it."""
    try:
        yield codec(kind, model)
    finally:
        codec(kind, model).table.clear()
        pa.default_memory_pool().release_unused()


def texts_of(column: pa.Array, at: int, n: int = RUN) -> list[str]:
    return [x or "" for x in column.slice(at, n).to_pylist()]


def piece_digests(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, as the sentencepiece library encodes and decodes it.

    Null is the empty text, whose only id is the end id. Rows with a null or repeated key are kept,
    each with its own result; an empty table gives no rows; other columns are neither read nor returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_codec(PieceCodec, model) as pieces:
            for batch in batches:
                for at in range(0, batch.num_rows, RUN):
                    made = pieces.encode(texts_of(batch.column("text"), at))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(at, RUN), pa.array([x.count(b" ") for x, _ in made], pa.int64()), pa.array([hashlib.sha256(x[1:]).hexdigest() for x, _ in made]), pa.array([hashlib.sha256(x.encode()).hexdigest() for _, x in made])],
                        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return whole(docs, key, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def piece_encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array of int, decoded string) of every row; cases as in piece_digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_codec(PieceCodec, model) as pieces:
            for batch in batches:
                for at in range(0, batch.num_rows, RUN):
                    made = pieces.encode(texts_of(batch.column("text"), at))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, RUN), pa.array([[int(i) for i in x.split()] for x, _ in made], pa.list_(pa.int32())), pa.array([x for _, x in made], pa.string())], names=["doc_id", "ids", "decoded"])

    return whole(docs, key, text).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
