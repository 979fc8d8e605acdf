"""Probabilistic suffix tree over bytes, with a word-count baseline beside it.

A text is its lower-cased words, each followed by a separator, the last by an end sign; the end sign
also stands before the text. Contexts of up to DEPTH bytes are counted in one pass. A context stays
in the tree if its next-symbol distribution diverges from its parent's (a log-likelihood ratio test);
distributions are smoothed towards the parent's. A symbol is scored in the longest suffix state.

Counts travel packed: a map task sends one row a bucket with sorted hashes and counts. Words of at
least N / HOT occurrences are HOT at most, so their counts are broadcast; the rest meet their counts
in a bucket, where a word's rows are then less than that share of all tokens. There are BUCKETS of
them whatever the corpus, so packed rows grow with the map tasks alone. Contexts of two bytes and more
grow in their buckets. A window is scored by the states of one bucket, so a tree of more than GRAMS
grams is broadcast in shares of whole buckets, one after the other, and each share scores its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutalake.llm.common import Words, checkpointed, discard_with, list_array, mix, partitions_of, slices, stored, whole

#: Longest context in bytes; windows that are counted have one byte more.
DEPTH = 5
#: A context needs this many occurrences, whatever the size of the corpus.
MIN_COUNT = 8
#: Nats by which a context's own distribution must explain its symbols better than its parent's.
MIN_GAIN = 12.0
#: Weight of the parent's distribution, in observations.
PRIOR = 6.0
#: Grams of a share of the tree, unless a bucket alone has more: 32 bytes each in the driver and in every worker.
GRAMS = 6_000_000
#: Buckets of words and of windows.
BUCKETS = 1024
#: Words above a HOT-th of all tokens have their counts broadcast.
HOT = 65_536
END, BLANK = 10, 32
_U = np.uint64
_END_WORD = _U(0x51ED270B7A4F3C95)
_NEED = 4_000_000
#: Rare words of texts that a task of pass 2 packs together.
PACK = 1 << 19


def symbols(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, text bounds) of the texts: END, then each word and BLANK, the last word END in its place."""
    n = np.diff(words.bounds)
    lengths = words.ends - words.starts
    docs = len(n)
    out_of = np.repeat(np.arange(docs), n)
    # A word's place: one sign before each text, a separator after each word, one END more for texts without words.
    sizes = lengths + 1
    total = np.concatenate([[0], np.cumsum(sizes)])
    lone = np.cumsum(np.concatenate([[0], (n == 0).astype(np.int64)]))
    starts = total[words.bounds] + np.arange(docs + 1) + lone
    begin = total[:-1] + out_of + 1 + lone[out_of]
    out = np.full(starts[-1], BLANK, dtype=np.uint8)
    out[starts[:-1]] = END
    out[starts[1:] - 1] = END
    source = np.arange(lengths.sum()) + np.repeat(words.starts - np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths)
    target = np.arange(lengths.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths)
    raw = words.data[source]
    out[target] = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    return out, starts


def windows(out: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """For each scored symbol, the byte window that ends with it; bytes before a text are zero."""
    wide = out.astype(_U)
    code = wide.copy()
    position = np.arange(len(out)) - np.repeat(starts[:-1], np.diff(starts))
    for j in range(1, depth + 1):
        seen = np.zeros(len(out), dtype=_U)
        seen[j:] = wide[:-j]
        seen[position < j] = 0
        code |= seen << _U(8 * j)
    return code[position > 0]


class _Counter:
    """Distinct keys and their counts, merged now and then."""

    def __init__(self):
        self.keys, self.counts, self.n = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts.astype(np.int64))
        self.n += len(keys)
        if self.n > _NEED and len(self.keys) > 1:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.n:
            return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.keys, self.counts = [keys[heads]], [np.add.reduceat(counts, heads)]
        self.n = len(heads)
        return self.keys[0], self.counts[0]


def _packed(kind: int, bucket: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return [(kind, int(bucket[a]), *(x[order[a:b]] for x in columns)) for a, b in zip(heads, [*heads[1:], len(bucket)], strict=True)]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), *(list_array([x.view(np.int64) for x in c], pa.int64()) for c in columns[2:])], names=names)


def _bucket(last: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a window by the last two bytes of its context, the byte before the symbol the lower one."""
    return (mix(last) % _U(buckets)).astype(np.int64)


def _gather(depth: int, buckets: int):
    """Pass 1 over training texts: (kind, bucket, keys, counts); kind 0 are windows, dealt by the last two bytes of the context, 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words_seen, ends = _Counter(), _Counter(), 0
        for batch in batches:
            ends += batch.num_rows
            for _, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets)
                words_seen.add(words.hashes())
                grams.add(windows(*symbols(words), depth))
        if ends:
            words_seen.add(np.array([_END_WORD]), np.array([ends]))
            keys, counts = grams.merge()  # never empty: an end is a symbol
            yield _batch(_packed(0, _bucket((keys >> _U(8)) & _U(0xFFFF), buckets), keys, counts), ["kind", "bucket", "keys", "counts"])
            keys, counts = words_seen.merge()
            yield _batch(_packed(1, (keys % _U(buckets)).astype(np.int64), keys, counts), ["kind", "bucket", "keys", "counts"])

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a bucket over all map tasks, each bucket again one row of each kind; rows come sorted by bucket and kind."""
    held, counter = None, _Counter()
    for batch in batches:
        keys, counts = batch.column("keys"), batch.column("counts")
        at, k, c = keys.offsets.to_numpy(), keys.values.to_numpy(zero_copy_only=False), counts.values.to_numpy(zero_copy_only=False)
        for i, of in enumerate(zip(batch.column("kind").to_pylist(), batch.column("bucket").to_pylist(), strict=True)):
            if of != held and counter.n:
                yield _batch([(*held, *counter.merge())], ["kind", "bucket", "keys", "counts"])
                counter = _Counter()
            held = of
            counter.add(k[at[i] : at[i + 1]].view(_U).copy(), c[at[i] : at[i + 1]].copy())
    if counter.n:
        yield _batch([(*held, *counter.merge())], ["kind", "bucket", "keys", "counts"])


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, whether the key is there)."""
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class Tree:
    """Sorted contexts of each length, the byte before the symbol first, and their grams (context, symbol).

    A gram that a state never saw has its parent's value and the state's weight; all values are log10.
    """

    def __init__(self, base: np.ndarray, depth: int):
        self.base, self.depth = base, depth
        self.contexts, self.weights, self.grams, self.values = [], [], [], []

    @property
    def states(self) -> int:
        return 1 + sum(map(len, self.contexts))

    @property
    def logp(self) -> np.ndarray:
        """A row a state: the 63 commonest bytes, then the mean of the others."""
        rows = [self.base[None]]
        for d, c in enumerate(self.contexts, 1):
            rows.append(self._values(np.repeat(c, 256), np.tile(np.arange(256), len(c)), d).reshape(-1, 256))
        p = 10 ** np.concatenate(rows)[:, np.argsort(-self.base, kind="stable")]
        return np.log10(np.concatenate([p[:, :63], p[:, 63:].mean(1)[:, None]], 1))

    def _values(self, context: np.ndarray, symbol: np.ndarray, depth: int) -> np.ndarray:
        """log10 probabilities of symbols after contexts of so many bytes, in the longest state of each."""
        value = self.base[symbol]
        live = np.arange(len(context))
        for d, (contexts, weights, grams, values) in enumerate(zip(self.contexts[:depth], self.weights, self.grams, self.values, strict=False), 1):
            c = context[live] >> _U(8 * (depth - d))
            at, hit = _find(grams, (c << _U(8)) | symbol[live].astype(_U))
            value[live[hit]] = values[at[hit]]
            miss = np.flatnonzero(~hit)
            at, known = _find(contexts, c[miss])
            value[live[miss[known]]] += weights[at[known]]
            hit[miss[known]] = True
            live = live[hit]
        return value

    def scores(self, words: Words, share: tuple[int, int, int] | None = None) -> np.ndarray:
        """log10 probability of each text; share: (first bucket, end, buckets) of the windows that count, null for all."""
        out, starts = symbols(words)
        if len(starts) < 2:
            return np.zeros(0)
        seen, at = np.unique(_reversed(windows(out, starts, self.depth), self.depth), return_inverse=True)
        if share is None:
            value = self._values(seen >> _U(8), (seen & _U(255)).astype(np.int64), self.depth)
        else:
            first, end, buckets = share
            of = _bucket((seen >> _U(8 * self.depth)) | ((seen >> _U(8 * (self.depth - 1))) & _U(255)) << _U(8), buckets)
            mine = (of >= first) & (of < end)
            value = np.zeros(len(seen))
            value[mine] = self._values(seen[mine] >> _U(8), (seen[mine] & _U(255)).astype(np.int64), self.depth)
        return np.add.reduceat(value[at], starts[:-1] - np.arange(len(starts) - 1))


def _reversed(grams: np.ndarray, depth: int) -> np.ndarray:
    """Windows with the byte before the symbol first and the symbol still last."""
    out = grams & _U(255)
    for j in range(1, depth + 1):
        out |= ((grams >> _U(8 * j)) & _U(255)) << _U(8 * (depth + 1 - j))
    return out


def summed(full: np.ndarray, counts: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the windows cut to a context of d bytes."""
    short = full & _U((1 << 8 * (d + 1)) - 1)
    order = np.argsort(short, kind="stable")
    short = short[order]
    heads = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
    return short[heads], np.add.reduceat(counts[order], heads)


def rooted(base: np.ndarray, depth: int) -> Tree:
    """The tree of the root alone, from the counts of all bytes."""
    return Tree(np.log10((base + 0.5) / (base.sum() + 0.5 * 256)), depth)


def extend(tree: Tree, grams: np.ndarray, counts: np.ndarray, gains: np.ndarray | None = None) -> np.ndarray:
    """Adds the contexts of the tree's next length, from all windows of that length; returns their gains.

    A context needs MIN_COUNT occurrences, its suffix in the tree, and a gain of MIN_GAIN; gains: those
    of the contexts one shorter, so that a context's gain is the least on its way from the root.
    """
    d = len(tree.contexts) + 1
    inside = grams >> _U(8 * d) > 0  # contexts that reach before the text are shorter ones
    grams, n = _reversed(grams[inside], d), counts[inside].astype(np.float64)
    order = np.argsort(grams)
    grams, n = grams[order], n[order]
    owner, where = np.unique(grams >> _U(8), return_inverse=True)
    sums = np.bincount(where, n, len(owner))
    good = sums >= MIN_COUNT
    least = np.full(len(owner), np.inf)
    if d > 1:
        at, known = _find(tree.contexts[-1], owner >> _U(8))
        good &= known
        if gains is not None and len(gains):
            least = np.where(known, gains[at], 0.0)
    mine = good[where]
    grams, n, where = grams[mine], n[mine], where[mine]
    before = tree._values(grams >> _U(16), (grams & _U(255)).astype(np.int64), d - 1)
    gain = np.minimum(np.bincount(where, n * (np.log(n / sums[where]) - before * np.log(10)), len(owner)), least)
    good &= gain >= MIN_GAIN
    mine = good[where]
    tree.contexts.append(owner[good])
    tree.weights.append(np.log10(PRIOR / (sums[good] + PRIOR)))
    tree.grams.append(grams[mine])
    tree.values.append(np.log10((n[mine] + PRIOR * 10 ** before[mine]) / (sums[where[mine]] + PRIOR)))
    return gain[good]


def grow(orders: list[tuple[np.ndarray, np.ndarray]], total: int, depth: int = DEPTH) -> Tree:
    """The tree from (windows, counts) of each context length 0..depth; windows hold the context and, last, the symbol, total of them."""
    if orders and int(orders[0][1].sum()) > total:
        raise ValueError("more symbols than windows")
    tree = rooted(np.bincount(orders[0][0].astype(np.int64), orders[0][1], 256), depth)
    gains = None
    for grams, counts in orders[1:]:
        gains = extend(tree, grams, counts, gains)
    return tree


_SHORT = "d int, key long, n long"
_STATES = "bucket long, d int, contexts array<long>, weights array<double>, grams array<long>, values array<double>"


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of single bytes and of pairs: 65,792 kinds of rows at most."""
    for batch in batches:
        keys, counts = batch.column("keys"), batch.column("counts")
        full, n = keys.flatten().to_numpy(zero_copy_only=False).view(_U), counts.flatten().to_numpy(zero_copy_only=False)
        for d in (0, 1) if len(full) else ():
            key, m = summed(full, n, d)
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(key), pa.int32()), pa.array(key.view(np.int64)), pa.array(m)], names=["d", "key", "n"])


def _deepen(tree: Tree):
    """Contexts of two bytes and more; a bucket holds all windows of those that end in the same two bytes, so it grows them alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = batch.column("keys"), batch.column("counts")
            for i in range(batch.num_rows):
                full, n = (x[i].values.to_numpy(zero_copy_only=False) for x in (keys, counts))
                own = Tree(tree.base, tree.depth)
                own.contexts, own.weights, own.grams, own.values = ([*x] for x in (tree.contexts, tree.weights, tree.grams, tree.values))
                gains = None
                for d in range(2, tree.depth + 1):
                    gains = extend(own, *summed(full.view(_U), n, d), gains)
                    if not len(gains):
                        break
                    yield pa.RecordBatch.from_arrays([batch.column("bucket").slice(i, 1), pa.array([d], pa.int32()), list_array([own.contexts[-1].view(np.int64)], pa.int64()), list_array([own.weights[-1]], pa.float64()), list_array([own.grams[-1].view(np.int64)], pa.int64()), list_array([own.values[-1]], pa.float64())], names=[x.split()[0] for x in _STATES.split(", ")])

    return run


class Shares:
    """A tree in shares of whole buckets: its root and contexts of one byte, the states of longer ones, and the bounds of the shares.

    counts: bucketed windows (kind 0). The driver sees states alone, one share at a time, of GRAMS grams unless a bucket
    has more. Together the shares are the whole tree.
    """

    def __init__(self, counts: DataFrame, buckets: int, depth: int = DEPTH, most: int = GRAMS):
        windows_ = counts.where("kind = 0")
        short = windows_.mapInArrow(_short, _SHORT).groupBy("d", "key").agg(F.sum("n").alias("n")).collect()
        orders = []
        for d in (0, 1):
            rows = sorted((int(np.int64(r.key).view(_U)), r.n) for r in short if r.d == d)
            orders.append((np.array([k for k, _ in rows], dtype=_U), np.array([n for _, n in rows], dtype=np.int64)))
        self.short = grow(orders, int(orders[0][1].sum()), depth)
        self.states = checkpointed(windows_.select("bucket", "keys", "counts").mapInArrow(_deepen(self.short), _STATES))
        sizes = self.states.groupBy("bucket").agg(F.sum(F.size("grams")).alias("n")).collect()  # a row a bucket
        starts, held = [0], 0
        for r in sorted(sizes, key=lambda r: r.bucket):
            if held and held + r.n > most:
                starts.append(r.bucket)
                held = 0
            held += r.n
        self.bounds = [(a, b, buckets) for a, b in zip(starts, [*starts[1:], buckets], strict=True)]

    def tree(self, share: int) -> Tree:
        """The tree with the states of a share's buckets."""
        first, end, _ = self.bounds[share]
        tree = Tree(self.short.base, self.short.depth)
        tree.contexts, tree.weights, tree.grams, tree.values = ([*x] for x in (self.short.contexts, self.short.weights, self.short.grams, self.short.values))
        parts: list[tuple[list, ...]] = [([], [], [], []) for _ in range(tree.depth - 1)]
        for r in self.states.where((F.col("bucket") >= first) & (F.col("bucket") < end)).toLocalIterator():
            for column, x, kind in zip(parts[r.d - 2], (r.contexts, r.weights, r.grams, r.values), (np.int64, np.float64, np.int64, np.float64), strict=True):
                column.append(np.array(x, dtype=kind))
        for contexts, weights, grams, values in parts:
            c, w, g, v = (np.concatenate(x) if x else np.zeros(0) for x in (contexts, weights, grams, values))
            c, g = c.astype(np.int64).view(_U), g.astype(np.int64).view(_U)
            a, b = np.argsort(c), np.argsort(g)
            tree.contexts.append(c[a])
            tree.weights.append(w[a])
            tree.grams.append(g[b])
            tree.values.append(v[b])
        return tree


def learn(counts: DataFrame, depth: int = DEPTH, most: int = GRAMS) -> Tree:
    """The tree from bucketed windows (kind 0); its first share, if it has more than so many grams."""
    return Shares(counts, 1 + (counts.agg(F.max("bucket")).first()[0] or 0), depth, most).tree(0)


def _share_scores(shared, share: tuple[int, int, int]):
    """(row, part): what the windows of a share add to the score of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            for first, data, offsets in slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(first, len(offsets) - 1), pa.array(tree.scores(Words(data, offsets), share))], names=["row", "part"])

    return run


def _word_sums(n_hot: np.ndarray, hot_counts: np.ndarray, shared, share: tuple[int, int, int] | None):
    """Pass 2 over all texts: a row of figures for each text, and packed rare words, which name the text's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        held: list[tuple] = []
        empty = pa.nulls

        def flush() -> pa.RecordBatch:
            rare, who, times = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            rows = _packed(1, (rare % _U(BUCKETS)).astype(np.int64), rare, who, times)
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [empty(n, pa.int64()), empty(n, pa.int64()), empty(n, pa.int64()), empty(n, pa.int64()), empty(n, pa.float64()), empty(n, pa.float64()), pa.array([x[1] for x in rows], pa.int64()), *(list_array([x[j].view(np.int64) for x in rows], pa.int64()) for j in (2, 3, 4))], names=NAMES)

        hot_log = np.log10(hot_counts + 1.0)
        end = np.searchsorted(n_hot, _END_WORD)
        end_known = end < len(n_hot) and n_hot[end] == _END_WORD
        for batch in batches:
            ids, numbers = batch.column("doc_id"), batch.column("row")
            for first, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets)
                docs = len(offsets) - 1
                keys = words.hashes()
                owner = np.repeat(np.arange(docs), np.diff(words.bounds))
                score = tree.scores(words, share)
                at = np.minimum(np.searchsorted(n_hot, keys), max(len(n_hot) - 1, 0))
                hot = n_hot[at] == keys if len(n_hot) else np.zeros(len(keys), dtype=bool)
                logs = np.bincount(owner[hot], hot_log[at[hot]], docs) + (hot_log[end] if end_known else 0.0)
                known = np.bincount(owner[hot], minlength=docs) + int(end_known)
                own = ids.slice(first, docs)
                rows_ = numbers.slice(first, docs).to_numpy()
                rare, who = keys[~hot], owner[~hot]
                order = np.lexsort((who, rare))
                rare, who = rare[order], who[order]
                heads = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (who[1:] != who[:-1])])) if len(rare) else np.zeros(0, dtype=np.int64)
                times = np.diff(np.append(heads, len(rare)))
                rare, who = rare[heads], rows_[who[heads]]
                if len(rare):
                    held.append((rare, who, times))
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(rows_), pa.array(np.diff(words.bounds) + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(logs), pa.array(score), empty(docs, pa.int64()), empty(docs, pa.list_(pa.int64())), empty(docs, pa.list_(pa.int64())), empty(docs, pa.list_(pa.int64()))], names=NAMES)
                if sum(len(x[0]) for x in held) > PACK:
                    yield flush()
        if held:
            yield flush()

    return run


NAMES = ["doc_id", "row", "n_tokens", "known", "logs", "score", "bucket", "keys", "docs", "times"]
_PASS_2 = "doc_id long, row long, n_tokens long, known long, logs double, score double, bucket long, keys array<long>, docs array<long>, times array<long>"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a bucket: counts and words of texts, to (row, known, logs); rows come sorted by bucket, counts first."""
    held, counter = None, _Counter()
    parts: tuple[list, list, list] = ([], [], [])

    def meet() -> Iterator[pa.RecordBatch]:
        if parts[0]:
            names, counts = counter.merge()
            key, doc, n = (np.concatenate(x) for x in parts)
            at, seen = _find(names, key)
            c, doc, n = counts[at[seen]] if len(names) else counts, doc[seen], n[seen]
            ids, where = np.unique(doc, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.bincount(where, n, len(ids)).astype(np.int64)), pa.array(np.bincount(where, n * np.log10(c + 1.0), len(ids)))], names=["row", "known", "logs"])
        for x in parts:
            x.clear()

    for batch in batches:
        k, d, t = (batch.column(x) for x in ("keys", "docs", "times"))
        for i, (bucket, is_count) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("is_count").to_pylist(), strict=True)):
            if bucket != held:
                yield from meet()
                held, counter = bucket, _Counter()
            mine = k[i].values.to_numpy(zero_copy_only=False).view(_U).copy()
            if is_count:
                counter.add(mine, t[i].values.to_numpy(zero_copy_only=False).copy())
                continue
            for part, x in zip(parts, (mine, d[i].values.to_numpy(zero_copy_only=False).copy(), t[i].values.to_numpy(zero_copy_only=False).astype(np.int32)), strict=True):
                part.append(x)
            if sum(map(len, parts[0])) > _NEED:
                yield from meet()
    yield from meet()


def score_documents(docs: DataFrame, training, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    training: a condition on the column doc_id; rows for which it isn't true (or is null) are held
    out. A text's tokens are its words, A-Z lower-cased, and one end. base_score is the add-one word
    model, score the suffix tree's log10 probability. Null and empty texts are the end alone; rows
    that repeat an id or have none are scored each by itself. Without training rows every distribution
    is uniform. Ties don't arise; an empty table gives no rows; other columns are neither read nor
    returned. Words are told apart by a 64-bit hash.
    """
    spark = docs.sparkSession
    n = partitions_of(spark)
    source = whole(docs, key, text)
    held = source.withColumn("train", F.coalesce(training, F.lit(False)))
    gathered = held.where("train").select("text").mapInArrow(_gather(DEPTH, BUCKETS), "kind int, bucket long, keys array<long>, counts array<long>")
    counts = checkpointed(gathered.repartition(n, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_total, "kind int, bucket long, keys array<long>, counts array<long>"))
    sums = {r.kind: (r.n or 0, r.v) for r in counts.select("kind", F.size("keys").cast("long").alias("v"), F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("kind").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    tokens, kinds = sums.get(1, (0, 0))
    shares = Shares(counts, BUCKETS, most=GRAMS)
    source = source.withColumn("row", F.monotonically_increasing_id())
    if len(shares.bounds) > 1:
        source = stored(source)  # so that all shares see the same numbers
    shared = spark.sparkContext.broadcast(shares.tree(0))  # a share
    words = counts.where("kind = 1")
    pairs = words.select(F.explode(F.filter(F.arrays_zip("keys", "counts"), lambda x: x["counts"] * HOT >= tokens)).alias("x")).select("x.*").collect()  # HOT rows at most
    hot = sorted((int(np.int64(k).view(_U)), c) for k, c in pairs)
    names, often = np.array([x for x, _ in hot], dtype=_U), np.array([x for _, x in hot], dtype=np.float64)
    second = checkpointed(source.mapInArrow(_word_sums(names, often, shared, shares.bounds[0] if len(shares.bounds) > 1 else None), _PASS_2))
    rare = second.where("bucket is not null").select("bucket", F.lit(False).alias("is_count"), "keys", "docs", "times")
    counted = words.select("bucket", F.lit(True).alias("is_count"), "keys", F.array().cast("array<long>").alias("docs"), F.col("counts").alias("times"))
    met = rare.union(counted).repartition(n, "bucket").sortWithinPartitions("bucket", F.desc("is_count"))
    more = met.mapInArrow(_meet, "row long, known long, logs double").groupBy("row").agg(F.sum("known").alias("more_known"), F.sum("logs").alias("more_logs"))
    flags = second.where("bucket is null").select("doc_id", "row", "n_tokens", "known", "logs", "score")
    for k in range(1, len(shares.bounds)):
        shared.unpersist()
        shared = spark.sparkContext.broadcast(shares.tree(k))
        part = source.select("row", "text").mapInArrow(_share_scores(shared, shares.bounds[k]), "row long, part double")
        flags = checkpointed(flags.join(part, "row").withColumn("score", F.col("score") + F.col("part")).drop("part"))
    if len(shares.bounds) > 1:
        discard_with(source)
    zero = F.lit(0).cast("long")
    return flags.join(more, "row", "left").select(
        "doc_id", (~F.coalesce(training, F.lit(False))).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(tokens + kinds + 1.0)))).alias("base_score"), "score")
