"""Each text operator alone on small odd tables, and rows that repeat or have no id."""

import collections
import math
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mutalake.llm import chunk_codec, common, main_text, ngram_join, packing, quality_rules, quality_votes, suffix_tree_lm
from texts import docs, words  # noqa: F401

BIG = 2**60 + 1
TABLES = {
    "nulls": [None] * 3,
    "empty": ["", " \n\t ", ""],
    "word": ["one"],
    "short": ["a b a b", "b a"],
    "frequent": ["a b c " * 1000] * 4,
    "long": ["x" * 300_000 + " y" * 100_000],
}


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7) for i, t in enumerate(rows)], "doc_id long, text string, lang string, row int")


@pytest.fixture(autouse=True)
def fresh():
    """No powers from an earlier, longer text."""
    common._POWERS.clear()


@pytest.mark.parametrize("name", sorted(TABLES))
def test_alone(spark, name):
    docs = table(spark, TABLES[name])
    n = len(TABLES[name])
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, quality int")
    scored = suffix_tree_lm.score_documents(docs, F.lit(True)).collect()
    assert len(scored) == n and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in scored)
    joined = ngram_join.ngram_components(docs).collect()
    assert len(joined) == n and all(r.component_id <= r.doc_id and (r.n_shingles > 0) == bool(words(TABLES[name][r.doc_id])) for r in joined)
    assert all(0 <= r.score <= 1 for r in quality_votes.vote_quality(docs, labels, F.lit(True)).collect())
    assert quality_rules.judge(docs, labels).count() == n
    assert chunk_codec.piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model")).count() == n
    assert {r.doc_id for r in packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()} == set(range(n))


def test_powers_of_nothing():
    up, down = common._powers(0)
    assert up[0] == down[0] == 1


def test_scores_of_repeated_rows(spark):
    """Rows that share an id, with the same text or another one, or have none, are scored each by itself."""
    long = " ".join(f"w{i % 997}" for i in range(3000))
    rows = [(1, long), (1, long), (1, "other words"), (None, long), (None, "none"), (BIG, "big one"), (BIG + 1, long)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row long").repartition(1)
    got = suffix_tree_lm.score_documents(docs, F.lit(True)).collect()
    count = collections.Counter(w for _, t in rows for w in [*words(t), "\n"])
    n, v = sum(count.values()), len(count)
    want = sorted((i is None, i or 0, len(words(t)) + 1, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*words(t), "\n"]), 6)) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.n_known == r.n_tokens and r.train_tokens == n for r in got)


def test_tree_is_bounded(spark, docs, monkeypatch):
    """With room for fewer grams the least gain rises; what stays is closed under suffixes."""
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = 4
    gathered = source.select("text").mapInArrow(suffix_tree_lm._gather(suffix_tree_lm.DEPTH, 16 * n), "kind int, bucket long, keys array<long>, counts array<long>")
    counts = common.checkpointed(gathered.repartition(n, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(suffix_tree_lm._total, "kind int, bucket long, keys array<long>, counts array<long>"))
    whole = suffix_tree_lm.learn(counts)
    size = sum(map(len, whole.grams[1:]))
    less = suffix_tree_lm.learn(counts, most=size // 2)
    assert 0 < sum(map(len, less.grams[1:])) <= size // 2
    for d in range(1, len(less.contexts)):
        parents = set(less.contexts[d - 1].tolist())
        assert all((int(c) >> 8) in parents for c in less.contexts[d])


def test_tree_in_shares_is_whole(spark, docs, monkeypatch):
    """A tree of more grams than a share scores as one that fits: nothing is left out."""
    whole = {r.doc_id: r.score for r in suffix_tree_lm.score_documents(docs, F.lit(True)).collect()}
    monkeypatch.setattr(suffix_tree_lm, "GRAMS", 300)
    bounds = []
    tree = suffix_tree_lm.Shares.tree
    monkeypatch.setattr(suffix_tree_lm.Shares, "tree", lambda self, k: bounds.append(k) or tree(self, k))
    got = {r.doc_id: r.score for r in suffix_tree_lm.score_documents(docs, F.lit(True)).collect()}
    assert len(bounds) > 2 and got.keys() == whole.keys()
    assert all(abs(got[i] - whole[i]) < 1e-6 for i in whole)


def test_rare_words_are_packed_over_slices(monkeypatch):
    """A task's packed rows are one a bucket, however many slices its texts are cut into."""
    monkeypatch.setattr(common, "SLICE_BYTES", 1000)
    texts = [" ".join(f"w{(i * 40 + j) * 7919 % 10007}" for j in range(40)) for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts), pa.array(range(300), pa.int64())], names=["doc_id", "text", "row"])
    tree = suffix_tree_lm.rooted(np.zeros(256), suffix_tree_lm.DEPTH)
    shared = type("Shared", (), {"value": tree})()
    made = [r for out in suffix_tree_lm._word_sums(np.zeros(0, dtype=np.uint64), np.zeros(0), shared, None)(iter([batch])) for r in out.to_pylist()]
    packed = [r for r in made if r["bucket"] is not None]
    assert len({r["bucket"] for r in packed}) == len(packed) <= suffix_tree_lm.BUCKETS
    assert sum(sum(r["times"]) for r in packed) == 300 * 40


def test_equal_texts_score_alike(spark):
    texts = [f"text {i % 5} of some words " * (1 + i % 5) for i in range(700)]
    labels = spark.createDataFrame([(i, int(i % 5 > 1)) for i in range(300)], "doc_id long, quality int")
    got = collections.defaultdict(set)
    for parts in (1, 9):
        for r in quality_votes.vote_quality(table(spark, texts).repartition(parts), labels, F.col("doc_id") < 300).collect():
            got[texts[r.doc_id]].add(r.score)
    assert all(len(x) == 1 for x in got.values())


def test_votes_match_brute_force(spark):
    """Scores recomputed neighbour by neighbour from the fitted vectors."""
    import numpy as np
    import pyarrow as pa

    texts = [" ".join(f"{'bad' if i % 3 == 0 else 'good'}{(i * k) % 11}" for k in range(3, 40)) for i in range(120)]
    docs = table(spark, texts)
    marks = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, mark int")
    voters = quality_votes.fit(docs.select("doc_id", "text"), marks, F.col("doc_id") % 5 != 0)
    counts = np.stack([x for _, x in quality_votes.term_counts(pa.array(texts))])
    got = voters.scores(counts)
    latent = voters.latent(counts)
    for i in range(0, 120, 7):
        cosines = [round(float(sum(a * b for a, b in zip(latent[i], v, strict=True))), 9) for v in voters.vectors]
        near = sorted(range(len(cosines)), key=lambda j: (-cosines[j], j))[: quality_votes.NEIGHBOURS]
        least, most = min(cosines[j] for j in near), max(cosines[j] for j in near)
        weight = [(max(cosines[j] - least, 0) / max(most - least, 1e-6) + 0.1) * max(cosines[j], 1e-3) * float(voters.weight[j]) for j in near]
        assert math.isclose(got[i], sum(w * float(voters.marks[j]) for w, j in zip(weight, near, strict=True)) / sum(weight), rel_tol=1e-4, abs_tol=1e-5)


@pytest.mark.parametrize(("name", "page"), [("unclosed", '<p class="a ' * 80_000), ("nested", "<div>" * 100_000 + "x"), ("closers", "<div>" * 50_000 + "</p>" * 50_000), ("quotes", "<a b='\">" * 100_000), ("signs", "<" * 500_000), ("scripts", "<script>" * 50_000), ("comments", "<!-- " * 100_000), ("flat", "<p>word</p>" * 100_000)])
def test_pages_in_linear_time(name, page):
    began = time.monotonic()
    main_text.blocks(page)
    assert time.monotonic() - began < 20


_PAGES = [
    ("<html><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><article><h1>Storm reaches coast</h1><p>The storm reached the coast early on Monday &amp; brought heavy rain to towns along the shore.</p><p>Officials said\n that  roads were closed in several places and asked people to stay at home.</p></article><aside class='sidebar'><a href='/c'>More</a></aside><footer>&copy; 2020 Example | Imprint</footer></body></html>",
     "Storm reaches coast\n\nThe storm reached the coast early on Monday & brought heavy rain to towns along the shore.\n\nOfficials said that roads were closed in several places and asked people to stay at home."),
    ("<body><div class='cookie-notice'><p>We use cookies.</p><button>OK</button></div><main><article><h1>A garden in spring</h1><p>Plants need water and light when the days grow longer and the soil is warm again.</p></article></main><form action='/s'><label>Search</label><input><button>Go</button></form><section class='comments'><div class='comment'><p>Great text, thank you!</p></div></section></body>",
     "A garden in spring\n\nPlants need water and light when the days grow longer and the soil is warm again."),
    ("<body><div class='ad'><p>Buy two, get one free!</p></div><script>var x = '<p>no</p>';</script><style>p { }</style><article><h1>How bread is made</h1><p>Flour, water, salt and yeast are mixed and left to rise for some hours in a warm place.</p><!-- <p>hidden</p> --><p>Then the dough is shaped and baked until the crust is brown and hard.</p></article></body>",
     "How bread is made\n\nFlour, water, salt and yeast are mixed and left to rise for some hours in a warm place.\n\nThen the dough is shaped and baked until the crust is brown and hard."),
]


def test_main_text_of_hand_made_pages(spark):
    rows = [(i, "http://x", html) for i, (html, _) in enumerate(_PAGES)] + [(10, None, None), (11, "u", "")]
    got = {r.page_id: r for r in main_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (_, want) in enumerate(_PAGES):
        assert got[i].text == want and got[i].n_chars == len(want)
    assert got[10].text == got[11].text == "" and got[10].n_chars == 0
