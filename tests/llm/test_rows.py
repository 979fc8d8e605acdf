"""Rows without an id, with a repeated one, empty tables and columns whose names the code uses: the join and the pipeline."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mutalake.llm import ngram_join
from texts import words

WIDE = "doc_id long, text string, lang string, source string, n_chars long, h long, rep long, root long, node long, own_id long, good int, kept boolean, row_ string"
EXTRA = (7, 7, 7, 7, 7, 1, False, "x")


def prose(k, n=80):
    return " ".join(f"w{k}x{i}{'.' if i % 11 == 10 else ''}" for i in range(n))


def shingles(t):
    w = words(t)
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def test_join_of_repeated_and_missing_ids(spark):
    """Each row is a document of its own: sets of all, links of those with an id, components by the smallest id of their text's group."""
    near = prose(1).replace("w1x40", "changed")
    rows = [(5, prose(1)), (3, near), (3, prose(2)), (9, prose(2)), (9, prose(3)), (9, prose(3)), (4, prose(3) + " more"), (None, prose(1)), (None, ""), (8, prose(4)), (8, None), (2, prose(5)), (2, prose(6)), (2, prose(7)), (1, prose(7) + " end")]
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if None not in (rows[a][0], rows[b][0]) and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    want = collections.Counter((i, len(sets[k]), None if i is None else min(least[find(k)])) for k, (i, _) in enumerate(rows))
    assert got == want


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([(i, int(i % 2), 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *EXTRA) for i, t in rows], WIDE).repartition(2)


STAGES = [s for s in corpus_pipeline.STAGES if s[0] != "packing"]


@pytest.mark.parametrize(("name", "stage"), STAGES)
def test_empty_table(spark, folder, name, stage):
    empty = spark.createDataFrame([], WIDE)
    assert stage(spark, empty, folder).collect() == [] and stage(spark, empty, folder).columns == empty.columns


def test_rules_decide_each_row(spark, folder):
    """A good text stays and a bad one goes, also under one id or none; further columns stay as they are."""
    rows = [(1, prose(1)), (1, "short"), (None, prose(2)), (None, "# # #"), (2, None), (3, prose(3)), (3, prose(3))]
    got = corpus_pipeline.quality_rules(spark, frame(spark, rows), folder).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter([(1, prose(1)), (None, prose(2)), (3, prose(3)), (3, prose(3))])
    assert all(tuple(r)[5:] == EXTRA for r in got)


def test_classifier_decides_each_row(spark, folder):
    """Labels of odd ids are good: their texts' words decide, whatever id the row has."""
    rows = [(i, f"{'good' if i % 2 else 'bad'} words {i % 3} " * 30) for i in range(40)] + [(2, "good words 1 " * 30), (None, "good words 2 " * 30), (None, "bad words 2 " * 30)]
    got = corpus_pipeline.quality_classifier(spark, frame(spark, rows), folder)
    assert collections.Counter(r.doc_id for r in got.where("text like 'good%'").collect()) == collections.Counter([*range(1, 40, 2), 2, None]) and got.where("text like 'bad%'").count() == 0


def test_one_of_each_group_stays(spark, folder):
    rows = [(1, prose(1)), (1, prose(1)), (1, prose(2)), (None, prose(2)), (None, prose(3)), (4, prose(3) + " x"), (5, ""), (5, None)]
    got = collections.Counter(r.text for r in corpus_pipeline.ngram_join(spark, frame(spark, rows), folder).collect())
    assert got[prose(1)] == got[prose(2)] == 1 and got[prose(3)] + got[prose(3) + " x"] == 1 and got[""] == got[None] == 1
    plain = [(i, prose(i // 3)) for i in range(12)]
    assert sorted(r.doc_id for r in corpus_pipeline.ngram_join(spark, frame(spark, plain), folder).collect()) == [0, 3, 6, 9]


def test_passages_are_cut_in_each_row(spark, folder):
    passage = prose(9, 70)
    rows = [(None, f"{prose(1)}\n{passage}"), (None, f"{passage}\n{prose(2)}"), (7, f"{prose(3)}\n{passage}\n{prose(4)}"), (7, prose(5)), (8, None)]
    got = corpus_pipeline.substring_dedup(spark, frame(spark, rows), folder).collect()
    assert len(got) == 5 and sum(passage in (r.text or "") for r in got) == 1 and all(r.n_chars is None or r.n_chars == len(r.text) for r in got)
    assert collections.Counter(r.doc_id for r in got) == collections.Counter([None, None, 7, 7, 8]) and sum(prose(5) == r.text for r in got) == 1


def test_packing_of_odd_rows(spark, folder):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (2, None)]
    got = corpus_pipeline.packing(spark, frame(spark, rows), folder).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {1: 6, None: 2, 2: 1} and corpus_pipeline.packing(spark, spark.createDataFrame([], WIDE), folder).collect() == []


def test_near_members_hold_no_pairs():
    """A crowd of near copies takes memory by its members, and is connected as its near pairs are."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from mutalake.llm import simjoin

    rng = np.random.default_rng(1)
    kinds = [rng.integers(0, 2**63, 200).astype(np.uint64) for _ in range(3)]
    sets = [np.concatenate([kinds[i % 3][:198], rng.integers(0, 2**63, 2).astype(np.uint64)]) for i in range(2400)]
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 2400, pa.int64()), pa.array(range(100, 2500), pa.int64()), pa.array([200] * 2400, pa.int64()), pa.array([simjoin.parity_sketch(x) for x in sets], pa.binary())], names=["a", "b", "n", "x"])
    tracemalloc.start()
    made = [(u, v) for out in simjoin._near_members(80)(iter([batch])) for u, v in zip(*(out.column(c).to_pylist() for c in ("u", "v")))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(made) == sorted((i, 100 + (i - 100) % 3) for i in range(103, 2500))
    assert peak < 20_000_000
