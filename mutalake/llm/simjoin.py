"""Exact set-similarity components from candidate signatures, with bounded memory for any group size.

Signatures put sets that may be similar under one key. Only connectivity is needed of them, so a
signature's members can become a star instead of all pairs; that is what crowded signatures get. With
parity sketches members are first compared: bit j of a sketch is the parity of the elements in cell j,
so sets differ in as many elements as their sketches differ in bits, at least, and what differs in too
many isn't joined. Components of the edges are the candidate groups; every similar pair lies in one.
A group is then searched exactly, in one task or, when it is large, in one task for each pair of
its blocks, so that no cap is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutalake.llm.common import checkpointed, list_array, mix, partitions_of
from mutalake.llm.components import connected_components, contract

#: Elements and members that one task of a group holds at most, for a side.
BLOCK_ELEMENTS = 1_000_000
#: Type of the list of a set's tasks.
TASKS = "array<struct<task: bigint, side: int>>"
#: Expanded (member, posting) pairs that are counted together.
EXPAND = 500_000
#: Elements of one side that are looked up together.
SLICE_ELEMENTS = 200_000
#: Sets of a group that is searched together with others, and elements of such groups.
FEW, FEW_ELEMENTS = 48, 150_000
#: Sets of such a group that are compared with all its others, before what is left is.
FEW_CENTRES = 4
#: Signature rows that a map task joins locally before the shuffle.
LOCAL_ROWS = 1_000_000


def _distinct(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(u):
        return u, v
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    fresh = np.ones(len(u), dtype=bool)
    fresh[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    return u[fresh], v[fresh]


def _runs(keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.diff(keys, prepend=-1))
    for a, b in zip(heads, [*heads[1:], len(keys)], strict=True):
        yield int(keys[a]), [x[order[a:b]] for x in columns]


def _signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of a column and how many each row has; 32-bit values are told apart by their places in the row."""
    if not pa.types.is_binary(column.type):
        return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1] // 4
    counts = np.diff(ends)
    flat = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint32)[ends[0] : ends[-1]] if len(ends) else np.zeros(0, dtype=np.uint32)
    places = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], counts)
    return mix(flat.astype(np.uint64) | places.astype(np.uint64) << np.uint64(32)).view(np.int64), counts


def _local(buckets: int, star_from: int):
    """From (node, sigs) to packed rows, a few for each bucket and task.

    A signature with star_from nodes or more in one task goes on with its smallest node alone; the
    others are linked to that here.
    """

    def flush(sigs: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
        sig, node = np.concatenate(sigs), np.concatenate(nodes)
        sig, node = _distinct(sig, node)
        heads = np.flatnonzero(np.diff(sig, prepend=sig[0] ^ 1))
        counts = np.diff(np.append(heads, len(sig)))
        crowded = np.repeat(counts >= star_from, counts)
        first = np.zeros(len(sig), dtype=bool)
        first[heads] = True
        far = crowded & ~first
        u, v = _distinct(node[far], np.repeat(node[heads], counts)[far])
        sig, node = sig[~far], node[~far]
        by_node = np.argsort(node, kind="stable")
        sig, node = sig[by_node], node[by_node]
        short = (sig >> 32).astype(np.int32)  # with its bucket enough: a chance collision costs a comparison, not a result
        none = np.zeros(0, dtype=np.int32)
        rows = [(k, x, y, none) for k, (x, y) in _runs((sig.view(np.uint64) % np.uint64(buckets)).astype(np.int64), short, node)] + [(k, none, x, y) for k, (x, y) in _runs(u % buckets, u, v)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), list_array([x[1] for x in rows], pa.int32()), list_array([x[2] for x in rows], pa.int64()), list_array([x[3] for x in rows], pa.int64())], names=["bucket", "sig", "node", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, nodes, n = [], [], 0
        for batch in batches:
            flat, counts = _signatures(batch.column("sigs"))
            sigs.append(flat)
            nodes.append(np.repeat(batch.column("node").to_numpy(zero_copy_only=False), counts))
            n += len(flat)
            if n > LOCAL_ROWS:
                yield flush(sigs, nodes)
                sigs, nodes, n = [], [], 0
        if n:
            yield flush(sigs, nodes)

    return run


#: Kinds of candidate rows: a sure edge, a pair to compare, a member of a group to compare.
EDGE, PAIR, MEMBER = 0, 1, 2


def _meet(pairs_to: int, members_to: int):
    """Rows sorted by bucket, of which one is held at a time. A signature's few nodes give their pairs,
    more give members of a group, a crowd a star."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sigs, nodes = None, [], []
        out: dict[int, tuple[list, list]] = {EDGE: ([], []), PAIR: ([], []), MEMBER: ([], [])}
        size = dict.fromkeys(out, 0)

        def unite(kind: int) -> None:
            if out[kind][0]:
                u, v = (contract if kind == EDGE else _distinct)(*map(np.concatenate, out[kind]))
                out[kind] = ([u], [v])

        def put(kind: int, x: np.ndarray, y: np.ndarray) -> None:
            out[kind][0].append(x)
            out[kind][1].append(y)
            size[kind] += len(x)
            if size[kind] > LOCAL_ROWS:
                unite(kind)
                size[kind] = 0

        def meet() -> None:
            sig, node = _distinct(np.concatenate(sigs), np.concatenate(nodes))
            heads = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            counts = np.diff(np.append(heads, len(sig)))
            for m in np.unique(counts[(counts > 1) & (counts <= pairs_to)]).tolist():
                rows = node[heads[counts == m][:, None] + np.arange(m)]
                i, j = np.triu_indices(m, 1)
                put(PAIR, rows[:, j].ravel(), rows[:, i].ravel())
            middle = np.repeat((counts > pairs_to) & (counts <= members_to), counts)
            put(MEMBER, (sig.astype(np.int64) << 24 ^ held)[middle], node[middle])
            crowd = np.repeat(counts > members_to, counts)
            put(EDGE, node[crowd], np.repeat(node[heads], counts)[crowd])

        for batch in batches:
            columns = [batch.column(x) for x in ("sig", "node", "other")]
            spans = [x.offsets.to_numpy() for x in columns]
            flat = [x.values.to_numpy(zero_copy_only=False) for x in columns]
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                sig, node, other = (f[at[i] : at[i + 1]].copy() for f, at in zip(flat, spans, strict=True))
                if len(other):
                    put(EDGE, node, other)
                    continue
                if bucket != held and sigs:
                    meet()
                    sigs.clear(), nodes.clear()
                held = bucket
                sigs.append(sig)
                nodes.append(node)
        if sigs:
            meet()
        for kind in out:
            unite(kind)
            for u, v in zip(*out[kind], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind), pa.int32()), pa.array(u), pa.array(v)], names=["kind", "a", "b"])

    return run


#: Least and most cells of a sketch; a set has about as many as elements.
SKETCH_BITS = (512, 1 << 17)


def parity_sketch(x: np.ndarray) -> bytes:
    """Bit j is the parity of the number of elements in cell j, of a power of two of cells."""
    bits = min(max(SKETCH_BITS[0], 1 << (len(x) - 1).bit_length() if len(x) else 0), SKETCH_BITS[1])
    return np.packbits(np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, longer ones folded to size bytes: a cell is then the parity of its halves."""
    out = np.empty((len(sketches), size // 8), dtype=np.uint64)
    for i, sketch in enumerate(sketches):
        x = np.frombuffer(sketch, dtype=np.uint64)
        while len(x) > size // 8:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out


def _near(bits: np.ndarray, others: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with these sketches and sizes can be similar: the difference is at most (100 - p) / (100 + p) of both sizes."""
    return np.bitwise_count(bits ^ others).sum(-1).astype(np.int64) * (100 + percent) <= (n + m) * (100 - percent)


def _near_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("n", "m"))
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            size = np.array([min(len(p), len(q)) for p, q in zip(x, y, strict=True)], dtype=np.int64)
            good = np.zeros(len(size), dtype=bool)
            for k in np.unique(size).tolist():
                at = np.flatnonzero(size == k)
                good[at] = _near(_folded([x[i] for i in at], k), _folded([y[i] for i in at], k), n[at], m[at], percent)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], names=["u", "v"])

    return run


def _near_members(percent: int):
    """Rows (a, node, n, x) sorted by group a, each of a bounded size: edges among those that can be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        key, nodes, sizes, bits = None, [], [], []

        def search() -> None:
            if len(nodes) > 1:
                node, n, x = np.array(nodes), np.array(sizes), _folded(bits, min(map(len, bits)))
                # Of near copies all pairs are near, so components are kept, not pairs.
                label = np.arange(len(node))
                for k in range(1, len(node)):
                    roots = np.unique(label[:k][_near(x[k], x[:k], n[k], n[:k], percent)])
                    if len(roots):
                        label[k] = roots[0]
                        if len(roots) > 1:
                            label[:k][np.isin(label[:k], roots)] = roots[0]
                far = label != np.arange(len(node))
                us.append(node[far])
                vs.append(node[label[far]])
            if len(us) > 1000:
                u, v = contract(np.concatenate(us), np.concatenate(vs))
                us[:], vs[:] = [u], [v]

        for batch in batches:
            for a, b, n, x in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n", "x")), strict=True):
                if a != key:
                    search()
                    key = a
                    nodes.clear(), sizes.clear(), bits.clear()
                nodes.append(b)
                sizes.append(n)
                bits.append(x)
        search()
        if us:
            u, v = contract(np.concatenate(us), np.concatenate(vs))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


#: Nodes of a signature up to which its pairs are listed, and up to which its members are compared in one task.
PAIRS_TO, MEMBERS_TO = 16, 8192
#: Nodes of a signature in one map task from which they are joined there.
STAR_FROM = 2048


def candidate_edges(signatures: DataFrame, sketches: DataFrame | None = None, percent: int = 80) -> DataFrame:
    """Edges (u, v) that connect all similar nodes sharing a signature, from rows (node long, sigs array of long,
    or binary of 32-bit values, of which those at one place of two rows may be equal).

    sketches: (node, n, x), a set's size and parity sketch, to leave out what can't be similar.
    """
    n = partitions_of(signatures.sparkSession)
    packed = signatures.select("node", "sigs").mapInArrow(_local(4 * n, STAR_FROM if sketches is not None else 2), "bucket long, sig array<int>, node array<long>, other array<long>")
    # Fewer tasks than usual: each gives a row for every pair it knows of, and most know of all.
    met = packed.repartition(max(6, n // 2), "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(*((PAIRS_TO, MEMBERS_TO) if sketches is not None else (1, 1))), "kind int, a long, b long")
    if sketches is None:
        return met.select(F.col("a").alias("u"), F.col("b").alias("v"))
    met = checkpointed(met)
    right = sketches.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("x").alias("y"))
    left = sketches.select(F.col("node").alias("a"), "n", "x")
    pairs = met.where(f"kind = {PAIR}").select("a", "b").distinct()
    near = pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(_near_pairs(percent), "u long, v long")
    members = met.where(f"kind = {MEMBER}").select("a", "b").join(sketches.select(F.col("node").alias("b"), "n", "x"), "b").select("a", "b", "n", "x")
    grouped = members.repartition(n, "a").sortWithinPartitions("a").mapInArrow(_near_members(percent), "u long, v long")
    return met.where(f"kind = {EDGE}").select(F.col("a").alias("u"), F.col("b").alias("v")).union(near).union(grouped)


class _Union:
    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        parent = self.parent
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                self.parent = parent
                return parent
            parent = up


def _links(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of left, of right) with 100 * intersection >= percent * union, found by counting postings."""
    if not left or not right:
        return
    flat = np.concatenate(right)
    order = np.argsort(flat, kind="stable")
    keys, owners = flat[order], np.repeat(np.arange(len(right)), [len(x) for x in right])[order]
    sizes = np.array([len(x) for x in right])
    begin = 0
    while begin < len(left):
        stop, elements = begin, 0
        while stop < len(left) and (stop == begin or elements + len(left[stop]) <= SLICE_ELEMENTS):
            elements += len(left[stop])
            stop += 1
        for a, b in _links_of(left[begin:stop], keys, owners, sizes, percent):
            yield a + begin, b
        begin = stop


def _links_of(left: list[np.ndarray], keys: np.ndarray, owners: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of some sets with those whose sorted elements and owners are given."""
    lengths = np.array([len(x) for x in left])
    mine = np.concatenate(left)
    lo, hi = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
    owner = np.repeat(np.arange(len(left)), lengths)
    hit = hi > lo
    lo, count, owner = lo[hit], (hi - lo)[hit], owner[hit]
    done = np.cumsum(count)
    at = 0
    while at < len(count):
        # Whole sets of the left side, EXPAND pairs of them or one set.
        end = int(np.searchsorted(done, (done[at - 1] if at else 0) + EXPAND, "right"))
        end = int(np.searchsorted(owner, owner[min(end, len(owner) - 1)], "left")) if end < len(owner) else end
        end = max(end, int(np.searchsorted(owner, owner[at], "right")))
        n = count[at:end]
        ends = np.cumsum(n)
        places = np.arange(ends[-1]) + np.repeat(lo[at:end] - (ends - n), n)
        code, both = np.unique(np.repeat(owner[at:end], n) * len(sizes) + owners[places], return_counts=True)
        a, b = code // len(sizes), code % len(sizes)
        good = 100 * both >= percent * (lengths[a] + sizes[b] - both)
        yield a[good], b[good]
        at = end


#: Members tried as centres before the rest is searched.
CENTRES = 8


def components_within(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The root index of each set, over all links among the sets.

    A few centres are compared with all, which joins most of a group of near copies. What is left
    outside the largest component is then compared with every set, so no link is missed.
    """
    union = _Union(len(sets))
    every = np.arange(len(sets))
    for _ in range(CENTRES if len(sets) > 64 else 0):
        roots = union.roots()
        names, counts = np.unique(roots, return_counts=True)
        alone = names[counts == 1]
        if not len(alone):
            break
        centre = int(alone[len(alone) // 2])
        for a, b in _links([sets[centre]], sets, percent):
            union.join(np.full(len(b), centre), b)
    roots = union.roots()
    names, counts = np.unique(roots, return_counts=True)
    outside = every[roots != names[np.argmax(counts)]] if counts.max() > 1 else every
    for a, b in _links(sets, [sets[i] for i in outside], percent):
        union.join(a, outside[b])
    return union.roots()


def components_of_groups(sets: list[np.ndarray], group: np.ndarray, percent: int) -> np.ndarray:
    """The root index of each set; group holds the index of its group's first set, and no two groups share an element.

    Each group's first set is compared with the others, then the first of those that it isn't linked
    with, and so on for a few; only what is still outside is compared with every set of its group.
    """
    lengths = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
    label, centres = np.arange(len(sets)), np.unique(group)
    compared = np.zeros(len(sets), dtype=bool)
    for _ in range(FEW_CENTRES):
        centre = np.full(len(sets), -1)
        centre[group[centres]] = centres
        centre = centre[group]
        keys = np.sort(flat[np.isin(owner, centres)])
        held = keys[np.minimum(np.searchsorted(keys, flat), len(keys) - 1)] == flat if len(keys) else np.zeros(len(flat), dtype=bool)
        both = np.bincount(owner[held], minlength=len(sets))
        linked = np.flatnonzero((both > 0) & (100 * both >= percent * (lengths + lengths[centre] - both)))
        label = _joined(label, linked, centre[linked])
        compared[centres] = True
        # Of two sets of a group that may still be linked, neither was a centre and one isn't joined with the first.
        outside = np.flatnonzero((label != group) & ~compared)
        if not len(outside):
            return label
        still, heads = np.unique(group[outside], return_index=True)
        centres = outside[heads]
        stay = np.isin(group[owner], still)
        flat, owner = flat[stay], owner[stay]
    others = np.flatnonzero(np.isin(group, still))
    for a, b in _links([sets[i] for i in outside.tolist()], [sets[i] for i in others.tolist()], percent):
        label = _joined(label, outside[a], others[b])
    return label


def _joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels, each the least index of its component, after these links."""
    a, b = label[u], label[v]
    far = a != b
    if not far.any():
        return label
    leaf, root = contract(a[far], b[far])
    to = np.arange(len(label))
    to[leaf] = root
    return to[label]


def components_between(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Root indices over left + right, for the links between them."""
    union = _Union(len(left) + len(right))
    for a, b in _links(left, right, percent):
        union.join(a, b + len(left))
    return union.roots()


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by task key; each run of a key is searched when it is complete."""
        key, nodes, sides, sets = None, [], [], []
        u, v, whole = [], [], []
        few_nodes, few_sets, few_groups, few = [], [], [], 0

        def search_few() -> None:
            """Small groups together: elements are told apart by their group."""
            nonlocal few
            if few_nodes:
                found, ids = components_of_groups(few_sets, np.array(few_groups), percent), np.array(few_nodes)
                far = found != np.arange(len(found))
                u.append(ids[far])
                v.append(ids[found[far]])
                whole.append(np.ones(int(far.sum()), dtype=bool))
            few_nodes.clear()
            few_sets.clear()
            few_groups.clear()
            few = 0

        def search() -> None:
            nonlocal few
            if len(nodes) < 2:
                return
            side = np.array(sides)
            if len(nodes) <= FEW and side[0] == 1:
                salt = mix(np.array([key], dtype=np.int64).view(np.uint64))[0]
                few_groups.extend([len(few_nodes)] * len(nodes))
                few_nodes.extend(nodes)
                few_sets.extend(x.view(np.uint64) ^ salt for x in sets)
                few += sum(map(len, sets))
                if few > FEW_ELEMENTS:
                    search_few()
                return
            if (side < 2).all():
                roots, order = components_within(sets, percent), np.arange(len(sets))
            else:
                order = np.concatenate([np.flatnonzero(side == 2), np.flatnonzero(side == 3)])
                first = int((side == 2).sum())
                ordered = [sets[i] for i in order]
                roots = components_between(ordered[:first], ordered[first:], percent)
            ids = np.array(nodes)[order]
            far = roots != np.arange(len(roots))
            u.append(ids[far])
            v.append(ids[roots[far]])
            whole.append(np.full(int(far.sum()), side[0] == 1))

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (u, v, whole)], names=["u", "v", "whole"])
            for x in (u, v, whole):
                x.clear()
            return made

        for batch in batches:
            keys = batch.column("task").to_pylist()
            ids, part = batch.column("node").to_pylist(), batch.column("side").to_pylist()
            lists = batch.column("items")
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for i, k in enumerate(keys):
                if k != key:
                    search()
                    key = k
                    nodes.clear()
                    sides.clear()
                    sets.clear()
                nodes.append(ids[i])
                sides.append(part[i])
                sets.append(flat[offsets[i] : offsets[i + 1]].copy())
            if len(u) > 10_000:
                yield out()
        search()
        search_few()
        if u:
            yield out()

    return run


def similar_components(candidates: DataFrame, items_of, percent: int, block: int | None = None) -> DataFrame:
    """(node, root) for nodes linked with another one: 100 * intersection >= percent * union, closed under links.

    candidates: (node, root, weight), each node's candidate group and the size of its set, by which
    large groups are cut in blocks of so many elements. items_of(wanted) adds items (array of long, distinct) to the rows of wanted(node, tasks);
    sets then travel once to each of their tasks. Nodes without a link have no row.
    """
    spark = candidates.sparkSession
    groups = checkpointed(candidates)
    sizes = groups.groupBy("root").agg(F.count("*").alias("members"), F.sum(F.col("weight") + 64).alias("total")).where("members > 1")
    blocked = sizes.select("root", F.ceil(F.col("total") / (block or BLOCK_ELEMENTS)).cast("int").alias("blocks"))
    placed = groups.join(blocked, "root").select("node", "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    # One block: one task. Several: a task for each block (i, i) and for each pair of blocks i < j.
    low, high = (lambda j: F.least(F.col("block"), j)), (lambda j: F.greatest(F.col("block"), j))
    side = lambda j: F.when(F.col("blocks") == 1, 1).when(F.col("block") == j, 0).when(F.col("block") < j, 2).otherwise(3)
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.xxhash64("root", low(j), high(j)).alias("task"), side(j).alias("side")))
    held = items_of(placed.select("node", tasks.alias("tasks"))).select("node", "items", F.explode("tasks").alias("t")).select("t.task", "node", "t.side", "items")
    n = partitions_of(spark)
    links = checkpointed(held.repartition(n, "task").sortWithinPartitions("task", "node").mapInArrow(_verify(percent), "u long, v long, whole boolean"))
    # A group that was searched in one task gives its stars; those of several tasks are joined.
    stars = links.where("whole").select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select("root", "root").distinct()).union(connected_components(links.where("not whole")))
