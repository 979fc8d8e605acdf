"""Spelling variants: a trie self-join at distance one over a vocabulary that is partitioned by prefix.

Words of m code points meet words of m and of m + 1. A single edit lies behind the first half of the
shorter word or before the second half, so the two words share that prefix, or that suffix, which is
a prefix of the reversed words. Each word therefore goes to the partitions of its prefix and of its
reversed prefix, for the pairing in which it is the shorter and the one in which it is the longer. In
a partition a trie holds what follows the prefix. Active pairs of nodes start where an edit can be (two
children of a node: a replacement; a node and its child: an insertion) and are propagated down by
equal code points, all of a level at once; a pair of terminal nodes is a pair of words at distance one.
A crowded partition is searched by pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutalake.llm.common import checkpointed, partitions_of

#: Maximal runs of these are words, before A-Z become lower-case.
NOT_IN_RUN = r"[^A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, MISSPELT = 5, 3, 97
#: Words of a block of a crowded partition, words whose tries are built together, crowded partitions that are broadcast.
BLOCK, TOGETHER, BROADCAST_CROWDED = 20_000, 50_000, 100_000


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of words that are long and frequent enough; a run whose checksum with the id is divisible loses a letter."""
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), NOT_IN_RUN)).alias("run"))
    hashed = runs.where(F.length("run") >= LEAST_LENGTH).select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % MISSPELT == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def partitioned(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, i, j, m, rest, word, n): each word in its partitions, in all pairs of blocks if one is crowded."""
    size = F.length("word")

    def entry(m, backwards: bool):
        half = F.floor(m / 2).cast("int")
        kept, w = (m - half, F.reverse("word")) if backwards else (half, F.col("word"))
        return F.struct(F.concat(F.lit("r" if backwards else "f"), m.cast("string"), F.lit(":"), F.substring(w, F.lit(1), kept)).alias("key"), m.alias("m"), F.substring(w, kept + 1, size).alias("rest"))

    both = [entry(m, backwards) for m in (size, size - 1) for backwards in (False, True)]
    signed = words.select("word", "n", F.explode(F.array(*both)).alias("s")).select("s.key", "s.m", "s.rest", "word", "n").where(F.col("m") >= LEAST_LENGTH)
    crowded = checkpointed(signed.groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > block))
    few = crowded.count() <= BROADCAST_CROWDED
    placed = signed.join(F.broadcast(crowded) if few else crowded, "key", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("held") / block).cast("int"), F.lit(1))).withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return pairs.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "m", "rest", "word", "n")


class Trie:
    """Of sorted words under several roots. Edges are (parent, letter) in order; edge e leads to node roots + e."""

    def __init__(self, roots: np.ndarray, letters: np.ndarray, lengths: np.ndarray):
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
        self.roots = int(roots[-1]) + 1 if len(roots) else 0
        at, node, ended, edges, last, depth = np.arange(len(roots)), roots.astype(np.int64), [], [], self.roots, 0
        while len(at):
            done = lengths[at] == depth
            ended.append((node[done], at[done]))
            at, node = at[~done], node[~done]
            if not len(at):
                break
            step = node * 256 + letters[begins[at] + depth]
            fresh = np.ones(len(step), dtype=bool)
            fresh[1:] = step[1:] != step[:-1]
            edges.append(step[fresh])
            node = last + np.cumsum(fresh) - 1
            last += len(edges[-1])
            depth += 1
        self.edges = np.concatenate(edges) if edges else np.zeros(0, dtype=np.int64)
        self.word = np.full(last, -1, dtype=np.int64)
        for own, words in ended:
            self.word[own] = words
        self.first = np.searchsorted(self.edges, np.arange(last + 1) * 256)

    def letter(self, node: np.ndarray) -> np.ndarray:
        return self.edges[node - self.roots] & 255

    def down(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of children with equal letters, and which pair each comes from."""
        kids = self.first[x + 1] - self.first[x]
        of = np.repeat(np.arange(len(x)), kids)
        edge = self.first[x][of] + np.arange(len(of)) - np.repeat(np.cumsum(kids) - kids, kids)
        want = y[of] * 256 + (self.edges[edge] & 255)
        at = np.minimum(np.searchsorted(self.edges, want), max(0, len(self.edges) - 1))
        met = self.edges[at] == want if len(of) else np.zeros(0, dtype=bool)
        return self.roots + edge[met], self.roots + at[met], of[met]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(words, words, inserted): those that differ by a replaced letter, and those where the second has one more."""
        edge = np.arange(len(self.edges))
        parent = self.edges >> 8
        later = self.first[parent + 1] - edge - 1
        of = np.repeat(edge, later)
        x, y = self.roots + of, self.roots + of + 1 + np.arange(len(of)) - np.repeat(np.cumsum(later) - later, later)
        while len(x):
            yield *self._words(x, y), False
            x, y, _ = self.down(x, y)
        x, y = parent, self.roots + edge
        if len(x):
            yield *self._words(x, y), True
            added = self.letter(y)
            x, y, of = self.down(x, y)
            other = self.letter(x) != added[of]  # a letter added to a run of it is the run's last, so that a pair comes once
            x, y = x[other], y[other]
        while len(x):
            yield *self._words(x, y), True
            x, y, _ = self.down(x, y)

    def _words(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = (self.word[x] >= 0) & (self.word[y] >= 0)
        return self.word[x[both]], self.word[y[both]]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of each pair of near words, from rows sorted by partition and rest; whole partitions, many together."""
    held: list[pa.RecordBatch] = []

    def search(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        task = _tasks(rows)
        m, n, own, i, j = (rows.column(c).to_numpy() for c in ("m", "n", "own", "i", "j"))
        rest, words = rows.column("rest"), rows.column("word")
        size, whole = pc.utf8_length(rest).to_numpy().astype(np.int64), pc.utf8_length(words).to_numpy()
        letters = np.frombuffer("".join(rest.to_pylist()).encode("latin-1"), dtype=np.uint8)
        trie = Trie(task, letters, size)
        for a, b, inserted in trie.pairs():
            good = ((i == j)[a] | (own[a] != own[b])) & (whole[a] == m[a]) & (whole[b] == m[a] + inserted)
            a, b = a[good], b[good]
            if inserted and len(a):
                a, b = _once(rows, a, b)
            if len(a):
                x, y = np.concatenate([a, b]), np.concatenate([b, a])
                yield pa.RecordBatch.from_arrays([words.take(x).combine_chunks(), words.take(y).combine_chunks(), pa.array(n[y])], names=["word", "near", "near_n"])

    for batch in batches:
        held.append(batch)
        rows = pa.Table.from_batches(held)
        if rows.num_rows >= TOGETHER:
            cut = int(np.searchsorted(_tasks(rows), _tasks(rows)[-1]))  # the last partition may go on
            if cut:
                yield from search(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
    if held:
        yield from search(pa.Table.from_batches(held))


def _tasks(rows: pa.Table) -> np.ndarray:
    """Numbers of the runs of rows with equal key and blocks."""
    key = rows.column("key").combine_chunks().dictionary_encode()
    codes = (key.combine_chunks() if isinstance(key, pa.ChunkedArray) else key).indices.to_numpy()
    fresh = np.zeros(rows.num_rows, dtype=bool)
    for own in (codes, rows.column("i").to_numpy(), rows.column("j").to_numpy()):
        fresh[1:] |= own[1:] != own[:-1]
    return np.cumsum(fresh)


def _once(rows: pa.Table, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the pairs of reversed words whose first halves are equal too: the other side has them."""
    words, keys, m = rows.column("word"), rows.column("key"), rows.column("m")
    m = m.take(a).to_numpy()
    back = pc.starts_with(keys.take(a), "r").to_numpy()
    twice = [s and u[: k // 2] == v[: k // 2] for s, u, v, k in zip(back, words.take(a).to_pylist(), words.take(b).to_pylist(), m, strict=True)]
    new = ~np.array(twice, dtype=bool)
    return a[new], b[new]


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n): every ordered pair of words of the vocabulary at distance one, once."""
    placed = partitioned(words, block).repartition(partitions_of(words.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "rest")
    return placed.mapInArrow(_near, "word string, near string, near_n long")


def variant_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    Null and empty texts have no words, a null id counts as an empty one in the checksum. Repeated rows
    count each. Of near words with equal counts the smallest in code-point order is the form. Forms
    at least double n, so the way to a root ends; roots are found by pointer jumping. An empty table gives no rows; other
    columns are neither read nor returned. A partition takes time linear in its letters and pairs.
    """
    words = checkpointed(vocabulary(docs, key, text))
    near = near_words(words, block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    is_form = -F.col("best.less") >= 2 * F.col("n")
    forms = checkpointed(words.join(near, "word", "left").select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    ups = forms.where("form is not null").select("word", F.col("form").alias("root"))
    moved = True
    while moved:  # each round doubles the way; at most seven, as counts have 64 bits
        further = ups.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = checkpointed(ups.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = step.where("moved").limit(1).count() > 0
        ups = step.select("word", "root")
    return forms.join(ups, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
