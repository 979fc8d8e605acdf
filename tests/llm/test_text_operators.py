"""The text operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mutalake.llm import chunk_codec, main_text, ngram_join, packing, quality_rules, quality_votes, simjoin, suffix_tree_lm, url_filter, vector_search
from mutalake.llm.common import shingle_sets
from mutalake.llm.components import connected_components
from texts import LOWER, SCHEMA, WORD, corpus, docs, none, words  # noqa: F401

def test_shingles_match_words():
    import pyarrow as pa

    texts = [t for _, t, *_ in corpus()]
    for k, x in shingle_sets(pa.array(texts, pa.string()), 5):
        w = words(texts[k])
        assert len(x) == len({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else ())


def components(sets, percent=80):
    names = sorted(sets)
    root = {i: i for i in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in names:
        for j in names:
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in names}


def test_ngram_join(spark, docs, none):
    sets = {}
    for i, t, *_ in corpus():
        w = words(t)
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    want = components(sets)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in ngram_join.ngram_components(docs).collect()}
    assert got == {i: (want[i], len(sets[i])) for i in sets}
    assert ngram_join.ngram_components(none).count() == 0
    assert ngram_join.ngram_components(docs.union(docs.limit(5))).count() == docs.count() + 5


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 7, 9, 12, 20, 33, 60, 97, 130, 260, 600])
def test_partenum_never_misses(size):
    rng = np.random.default_rng(size)
    for _ in range(60):
        x = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        most = len(x) // 5
        drop, add = (int(v) for v in rng.integers(0, most + 1, 2))
        y = np.unique(np.concatenate([rng.permutation(x)[drop:], rng.integers(0, 2**64, add, dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            assert set(ngram_join.signatures(x)) & set(ngram_join.signatures(y))


def test_group_search_in_blocks(spark, docs, monkeypatch):
    whole = {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs).collect()}
    monkeypatch.setattr(simjoin, "BLOCK_ELEMENTS", 150)
    monkeypatch.setattr(simjoin, "PAIRS_TO", 2)
    monkeypatch.setattr(simjoin, "MEMBERS_TO", 3)
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs).collect()} == whole


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    want = components({i: {i} for i in range(400)})
    root = dict(want)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "u long, v long").repartition(5)).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]} | {x: find(x) for x in got}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_stars_need_no_round(spark, monkeypatch):
    """Tasks that know of other centres of one leaf: all meet before the first round."""
    from mutalake.llm import components

    rounds = []
    star = components._large_star
    monkeypatch.setattr(components, "_large_star", lambda edges: rounds.append(1) or star(edges))
    edges = spark.range(0, 400, 1, 8).selectExpr("1000 + id % 50 AS u", "id % 50 + 100 * floor(id / 50) AS v")
    found = {r.node: r.root for r in connected_components(edges).collect()}
    assert found == {n: k for k in range(50) for n in [1000 + k, *(k + 100 * j for j in range(8))]}
    assert not rounds


def test_suffix_tree(spark, docs, none):
    rows = suffix_tree_lm.score_documents(docs, F.col("doc_id") % 7 != 2).collect()
    count, texts = collections.Counter(), {i: [*words(t), "\n"] for i, t, *_ in corpus()}
    for i, w in texts.items():
        if i % 7 != 2:
            count.update(w)
    n, v = sum(count.values()), len(count)
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        w = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id % 7 == 2, len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9) and r.score < 0
    assert suffix_tree_lm.score_documents(none, F.lit(True)).count() == 0
    alone = suffix_tree_lm.score_documents(docs, F.lit(False)).where("doc_id = 60").first()
    assert (alone.n_tokens, alone.n_known, alone.train_tokens) == (1, 0, 0) and math.isclose(alone.score, -math.log10(256))


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_suffix_tree_counts_are_whole(spark, docs, partitions):
    """Scores are those of a tree grown from brute-force counts, however windows are dealt."""
    import pyarrow as pa

    from mutalake.llm.common import Words, slices

    seen = [collections.Counter() for _ in range(suffix_tree_lm.DEPTH + 1)]
    for i, t, *_ in corpus():
        if i % 7 != 2:
            text = b"\n" + b"".join(w.encode() + b" " for w in words(t))[:-1] + b"\n"
            for at in range(1, len(text)):
                for d in range(suffix_tree_lm.DEPTH + 1):
                    seen[d][int.from_bytes(text[max(at - d, 0) : at + 1], "big")] += 1
    orders = [(np.array(sorted(x), dtype=np.uint64), np.array([x[k] for k in sorted(x)])) for x in seen]
    tree = suffix_tree_lm.grow(orders, sum(seen[0].values()))
    want = {}
    for i, t, *_ in corpus():
        for _, data, offsets in slices(pa.array([t], pa.string())):
            want[i] = tree.scores(Words(data, offsets))[0]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        got = {r.doc_id: r.score for r in suffix_tree_lm.score_documents(docs, F.col("doc_id") % 7 != 2).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_suffix_tree_keeps_every_context():
    """More contexts than the old limit of 32,768 pass both tests, and a larger corpus drops none of them."""
    rng = np.random.default_rng(6)
    pairs = np.unique(rng.integers(97, 123, (60_000, 6)), axis=0).astype(np.uint64)  # each five bytes have one successor or few
    code = (pairs << (np.uint64(8) * np.arange(6, dtype=np.uint64))).sum(1, dtype=np.uint64)
    orders = []
    for d in range(6):
        grams, at = np.unique(code & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
        orders.append((grams, np.bincount(at) * 40))
    tree = suffix_tree_lm.grow(orders, len(code) * 40)
    times = [(g, n * 1000) for g, n in orders]
    more = suffix_tree_lm.grow(times, len(code) * 40_000)
    assert tree.states > 32_768 and more.states >= tree.states
    assert all(np.isin(a, b).all() for a, b in zip(tree.contexts, more.contexts, strict=True))


def test_suffix_tree_is_a_distribution():
    """Probabilities of the next byte sum to one in every state."""
    import pyarrow as pa

    from mutalake.llm.common import Words, slices

    orders = []
    for _, data, offsets in slices(pa.array(["the cat sat on the mat " * 30, "a cat, a mat"])):
        code = suffix_tree_lm.windows(*suffix_tree_lm.symbols(Words(data, offsets)), 5)
    for d in range(6):
        orders.append(np.unique(code & np.uint64((1 << 8 * (d + 1)) - 1), return_counts=True))
    tree = suffix_tree_lm.grow(orders, len(code))
    spread = np.ones(64)
    spread[63] = 256 - 63
    assert len(tree.logp) > 10 and np.allclose((10**tree.logp * spread).sum(1), 1)


def test_suffix_tree_tells_all_bytes_apart():
    """More than 63 byte values keep their own probabilities, as symbols and as contexts."""
    import pyarrow as pa

    from mutalake.llm.common import Words, slices

    letters = [chr(0x0410 + i) for i in range(48)] + [chr(0x4E00 + 97 * i) for i in range(120)]
    for _, data, offsets in slices(pa.array([" ".join(a + letters[i - 1] for i, a in enumerate(letters) for _ in range(1 + i % 9))])):
        code = suffix_tree_lm.windows(*suffix_tree_lm.symbols(Words(data, offsets)), 5)
    orders = [np.unique(code & np.uint64((1 << 8 * (d + 1)) - 1), return_counts=True) for d in range(6)]
    tree = suffix_tree_lm.grow(orders, len(code))
    count = np.bincount((code & np.uint64(255)).astype(np.int64), minlength=256)
    assert (count > 0).sum() > 64 and np.allclose(tree.base, np.log10((count + 0.5) / (len(code) + 128)))
    rare = np.argsort(-count, kind="stable")[63:]
    assert np.isin(tree.contexts[0], rare[count[rare] > 0].astype(np.uint64)).sum() > 1


def test_packing(spark, docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack_documents(docs, path).collect()
    library = chunk_codec.codec(chunk_codec.ByteCodec, path).library
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for i, t, *_ in corpus():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack_documents(none, path).count() == 0


def test_packing_special_tokens(spark):
    """A literal added token in a text is its one id, as in the tokenizers library with its defaults."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "plain text here"]
    got = chunk_codec.codec(chunk_codec.ByteCodec, path).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in np.frombuffer(got[0], "<u4")


def test_plan_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(5, 60))
        docs = np.unique(np.append(rng.integers(1, n, 3), n))
        ends = np.unique(rng.integers(1, n + 1, n // 3))
        cuts = np.append(0, packing.plan(n, docs, ends, limit=16))
        cost = lambda a, b: (16 - (b - a)) + (0 if b in docs else packing.SENTENCE_CUT if b in ends else packing.HARD_CUT)  # noqa: B023, E731
        allowed = sorted({0, *docs, *ends, *(x for a, b in zip([0, *sorted({*docs, *ends})], sorted({*docs, *ends}), strict=False) if b - a > 8 for x in range(a + 8, b, 8))})
        best = {0: 0.0}
        for b in allowed[1:]:
            best[b] = min(best[a] + cost(a, b) for a in allowed if a < b and b - a <= 16)
        assert math.isclose(sum(cost(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)), best[n])


def test_pieces(spark, docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = chunk_codec.codec(chunk_codec.PieceCodec, path).library
    got = {r.doc_id: r for r in chunk_codec.piece_digests(docs, path).collect()}
    for i, t, *_ in corpus():
        ids = library.encode(t or "", add_eos=True)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert chunk_codec.piece_encode(docs, path).where("doc_id = 62").first().ids[-1] == library.eos_id()
    assert chunk_codec.piece_digests(none, path).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  a", "a  b ", "a \n b", " \n x", "x\n", "tab\t x", "\u2581x", "ﬁ é", "\x00 a", "'s it's  ' s", "<|endoftext|> x", "\r\n a", "</s> <s> x"])
def test_codecs_on_odd_texts(text):
    b = chunk_codec.codec(chunk_codec.ByteCodec, public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(b.encode([text])[0], "<u4").tolist() == b.library.encode(text, add_special_tokens=False).ids
    p = chunk_codec.codec(chunk_codec.PieceCodec, public_tokenizers.path("piece_bpe_32k.model"))
    ids, decoded = p.encode([text])[0]
    want = p.library.encode(text, add_eos=True)
    assert [int(x) for x in ids.split()] == want and decoded == p.library.decode(want)


def test_no_chunk_table_outlives_its_task(spark):
    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(len(x.table.values) for x in chunk_codec._CODECS.values())]})

    texts = spark.range(0, 4000, 1, 8).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 20), i -> md5(concat(id, i)))) AS text")
    assert packing.pack_documents(texts, public_tokenizers.path("byte_bpe_50k.json")).count() >= 4000
    assert chunk_codec.piece_digests(texts, public_tokenizers.path("piece_bpe_32k.model")).count() == 4000
    assert {r.n for r in spark.range(0, 64, 1, 64).mapInArrow(held, "n long").collect()} == {0}


def test_quality_figures(spark, docs, none):
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(50)] + [(None, 1, 0), (51, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    for i, t, *_ in corpus():
        w = WORD.findall(t or "")
        count = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {j + d for j in range(len(w) - 2) if count[tuple(w[j : j + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.kept and r.base_failed)
    assert quality_rules.judge(none, labels).count() == 0
    assert quality_rules.judge(docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_binomial_tail_and_cutoffs(spark):
    cases = [(0, 10, 0.1), (3, 50, 0.2), (7, 900, 0.01)]
    for k, n, p in cases:
        got = spark.range(1).select(quality_rules._tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first().x
        assert math.isclose(got, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9)
    good = [("en", True, 100, 500, 0, 0, 0, 5, 5)] * 1500
    bad = [("en", False, 100, 500, 200, 0, 0, 5, 5)] * 20
    rows = spark.createDataFrame(good + bad, "stratum string, good boolean, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long")
    cut = quality_rules.fit_cutoffs(rows).first()
    # The loosest step that catches the bad ones; the other ratios have come as far on their grids.
    assert (cut.max_symbol_ratio, cut.max_dup_line_ratio) == (0.3, 0.8)
    few = quality_rules.fit_cutoffs(rows.where("good").limit(90).union(rows.where("not good"))).first()
    assert few.max_symbol_ratio is None  # (1 - ALPHA) ** 90 > DELTA: too few good texts to be sure
    two = rows.union(rows.withColumn("stratum", F.lit("de")).where("good").limit(110)).union(rows.where("not good").withColumn("stratum", F.lit("de")))
    assert {r.stratum: r.max_symbol_ratio for r in quality_rules.fit_cutoffs(two).collect()} == {"en": 0.3, "de": None}


def test_quality_votes(spark, docs, none):
    rng = random.Random(4)
    text = lambda bad: " ".join("".join(rng.choice("abcdehirst") for _ in range(5)) + ("###" if bad else "") for _ in range(60))
    table = spark.createDataFrame([(i, text(i % 3 == 0)) for i in range(400)] + [(400, None), (401, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_votes.vote_quality(table, labels, F.col("doc_id") % 5 != 0).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.95 * len(held)
    assert got[400].score == got[401].score and all(0 <= r.score <= 1 for r in got.values())
    assert {r.score for r in quality_votes.vote_quality(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert quality_votes.vote_quality(none, labels, F.lit(True)).count() == 0


URLS = [None, "no", "http://", "HTTP://WWW.Example.NET/en/x?y#z", "http://example.net", "http://a.example.com/de/1", "https://xexample.com/de/", "http://a.org/fr/", "http://net/", "http://a.net", "http://ü.org/fr/a", "http://a.example.net/EN/", "x://y://z.net/a", "http://.net/"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    rows = url_filter.judge_urls(pages).collect()
    for r in rows:
        url = URLS[r.page_id] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = host.translate(LOWER)
        best = max(((h, p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith(f".{h}")) and path.startswith(p)), key=lambda x: (x[0].count("."), len(x[1])), default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[0] + best[1], best[2] if best else "allow")
    parts = pages.select("page_id", *(c.alias(n) for c, n in zip(url_filter.url_parts(), ("host", "path"), strict=True)))
    assert sorted(map(repr, url_filter._by_join(parts, url_filter.RULES).collect())) == sorted(map(repr, (r for r in rows)))
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_trie_precedence():
    trie = url_filter.build_trie([("block", "com", ""), ("allow", "com", "/a"), ("block", "com", "/a/b/"), ("allow", "x.com", "")])
    found = [url_filter.match(trie, h, p) for h, p in (("y.com", "/"), ("y.com", "/ab"), ("y.com", "/a/b/c"), ("x.com", "/a/b/"), ("com", ""), ("org", "/"))]
    assert [x and x[0] for x in found] == ["com", "com/a", "com/a/b/", "x.com", "com", None]


def test_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 16))
    x = (centres[rng.integers(0, 12, 1500)] + 0.4 * rng.standard_normal((1500, 16))).astype(np.float32)
    x[100:400] = x[100]  # many equal vectors
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(2000, None, "c"), (2020, [0.0] * 16, "c"), (2040, [float("nan")] * 16, "c"), (2060, [1.0] * 15 + [None], "c"), (2080, [1.0, 2.0], "c"), (2100, [], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, ids string")
    got = collections.defaultdict(list)
    for r in vector_search.nearest_vectors(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    y = x.astype(np.float64)
    hits = total = 0
    assert sorted(got) == list(range(0, 1500, 20))
    for q, found in got.items():
        scores = (y * y[q]).sum(1)
        truth = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != q)[:20]
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(math.isclose(s, scores[i], rel_tol=1e-12) for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i in truth} & {i for _, i, _ in found})
        total += 20
    assert hits >= 0.9 * total
    assert vector_search.nearest_vectors(df.limit(0), F.lit(True)).count() == 0
    few = vector_search.nearest_vectors(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert len(few) == 2


def test_vectors_fill_up_from_further_leaves(spark):
    """A query whose leaves hold too few candidates visits more of them: all have 20 rows, even at one visit each."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.standard_normal((400, 8)) * 0.05 + 3, rng.standard_normal((100, 8)) * 20])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = vector_search.nearest_vectors(df, F.col("vec_id") % 20 == 0, recall=1e-9).groupBy("query_id").count().collect()
    assert len(rows) == 25 and {r["count"] for r in rows} == {20}


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li></ul></nav><div class="ad">Buy this now.</div>
<article><h1>A &amp; B</h1><p><b>First   line here, with
some words in it that make it long enough.<br><p>Second paragraph &lt;x&gt;&nbsp;has several words too, and a <a href=#>link</a> in it.</p></article><section class="comments"><div class="comment"><p>Nice one, thanks!</p></div></section><footer>&copy; me</footer></body></html>"""


def test_main_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, "u", None, "t"), (3, None, "", "t"), (4, "u", "<<>><p", "t"), (1, "u", PAGE, "t"), (5, "u", "<div>" * 3000, "t")], "page_id long, url string, html string, text string")
    rows = main_text.main_text(pages).collect()
    want = "A & B\n\nFirst line here, with some words in it that make it long enough.\n\nSecond paragraph <x> has several words too, and a link in it."
    assert [r.text for r in rows if r.page_id == 1] == [want, want] and all(r.n_chars == len(r.text) for r in rows)
    assert {r.text for r in rows if r.page_id in (2, 3, 5)} == {""}
    assert main_text.main_text(pages.limit(0)).count() == 0


def test_labeller_on_unseen_pages():
    pages, labels = main_text.training_pages(120, seed=12345)
    found = main_text.trained().label(pages)
    assert np.mean([(a == (b > 0)).mean() for a, b in zip(found, labels, strict=True)]) > 0.95


def test_labeller_gradients():
    model = main_text.Labeller(3)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    rng = np.random.default_rng(0)
    x, mask = rng.standard_normal((4, 2, main_text.WIDTH)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], dtype=np.float64)
    y = rng.integers(0, 2, (4, 2)).astype(np.float64)
    _, grad = model.gradients(x, mask, y)
    for name in ("fx", "bh", "fc", "o"):
        at = tuple(int(i) for i in (np.array(model.w[name].shape) // 2))
        keep = model.w[name][at]
        losses = []
        for step in (1e-4, -1e-4):
            model.w[name][at] = keep + step
            losses.append(model.gradients(x, mask, y)[0])
        model.w[name][at] = keep
        assert math.isclose((losses[0] - losses[1]) / 2e-4, grad[name][at], rel_tol=0.02, abs_tol=2e-5)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, lang or "en", "src", len(t or "")) for i, t, lang, *_ in corpus(n=90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 != 4), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert after.columns == docs.columns
            after.write.parquet(f"{tmp_path}/{name}")
            after = spark.read.parquet(f"{tmp_path}/{name}")
            assert after.count() <= docs.count()
        docs = after
    assert {r.doc_id for r in docs.select("doc_id").collect()} == {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}


def test_rounds_take_edges_among_centres_alone(spark, monkeypatch):
    """Many whole stars and a few that touch: no round sees the leaves."""
    from mutalake.llm import components

    sizes = []
    star = components._large_star
    monkeypatch.setattr(components, "_large_star", lambda edges: sizes.append(edges.count()) or star(edges))
    # 200 stars of 10 leaves, in one task each; a chain of ties joins the first 20 by leaves and centres that they share.
    stars = spark.range(0, 2000, 1, 7).selectExpr("1000 + id AS u", "id % 200 AS v")
    ties = spark.range(0, 19, 1, 19).selectExpr("CASE WHEN id % 2 = 0 THEN 1000 + id ELSE id + 1 END AS u", "CASE WHEN id % 2 = 0 THEN id + 1 ELSE id END AS v")
    found = {r.node: r.root for r in connected_components(stars.union(ties)).collect()}
    root = lambda k: 0 if k < 20 else k
    assert found == {k: root(k) for k in range(200)} | {1000 + k: root(k % 200) for k in range(2000)}
    assert sizes and max(sizes) <= 40


def test_small_groups_need_few_comparisons(monkeypatch):
    """Near copies are joined by their group's first set; odd groups have the components of all their links."""
    rng = np.random.default_rng(4)

    def group(at, size, changed):
        base, sets = rng.permutation(60)[:46], []
        for k in range(size):
            x = base.copy()
            x[rng.choice(len(x), int(rng.integers(0, changed)), replace=False)] = 60 + k
            sets.append(np.unique(x).astype(np.uint64) + np.uint64(1000 * at))
            base = x if rng.random() < 0.3 else base
        return sets

    listed = []
    links_of = simjoin._links_of
    monkeypatch.setattr(simjoin, "_links_of", lambda left, *more: listed.append(len(left)) or links_of(left, *more))
    near = [[group(g, 40, 2)[0]] * 40 for g in range(5)]
    starts = np.repeat(np.arange(5) * 40, 40)
    assert np.array_equal(simjoin.components_of_groups([x for g in near for x in g], starts, 80), starts) and not listed
    for trial in range(60):
        sizes = rng.integers(2, 30, 8)
        sets = [x for g, m in enumerate(sizes.tolist()) for x in group(g, m, 9)]
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        want = simjoin._Union(len(sets))
        for a, b in simjoin._links(sets, sets, 80):
            want.join(a, b)
        assert np.array_equal(simjoin.components_of_groups(sets, starts, 80), want.roots())
    assert listed


def test_small_groups_of_a_task(monkeypatch):
    """The verifying task lists no postings for groups of near copies."""
    monkeypatch.setattr(simjoin, "_links", lambda *args: pytest.fail("every pair was listed"))
    sets = [[*range(100 * g, 100 * g + 45), 100 * g + 50 + k] for g in range(6) for k in range(30)]
    rows = pa.RecordBatch.from_pydict({"task": pa.array(np.repeat(np.arange(6), 30)), "node": pa.array(np.arange(180)), "side": pa.array([1] * 180, pa.int32()), "items": pa.array(sets, pa.list_(pa.int64()))})
    links = [(u, v) for b in simjoin._verify(80)(iter([rows])) for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist())]
    assert sorted(links) == [(k, k - k % 30) for k in range(180) if k % 30]


def test_binary_signatures():
    """32-bit values count by their places; slices of a column and empty ones are read right."""
    rows = pa.array([np.array(x, dtype=np.uint32).tobytes() for x in ([7, 7, 9], [7, 8, 9], [], [7])], pa.binary())
    flat, counts = simjoin._signatures(rows)
    assert counts.tolist() == [3, 3, 0, 1] and len(set(flat.tolist())) == 4
    assert flat[0] == flat[3] == flat[6] != flat[1] and flat[2] == flat[5]
    part, counts = simjoin._signatures(rows.slice(1, 3))
    assert part.tolist() == flat[3:].tolist() and counts.tolist() == [3, 0, 1]
    assert not len(simjoin._signatures(rows.slice(0, 0))[0])
