"""Personal data, spelling variants and vector codes against brute force, on odd rows and by held-out accuracy."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mutalake.llm import personal_data, spelling_variants, vector_codes
from texts import LOWER, docs, none  # noqa: F401

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    def holds(kind, span):
        digits = re.sub("[^0-9]", "", span)
        return {"email": True, "ip": all(int(x) <= 255 for x in span.split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    return sorted((m.start(), i, m.end()) for i, (kind, like) in enumerate(BASE.items()) for m in re.finditer(like, text or "") if holds(kind, m.group()))


def written(spans):
    return ",".join(f"{personal_data.KINDS[i]}:{a}:{b}" for a, i, b in spans)


ODD = [
    "a@b.c_x@d.com", "a@b.c@d.e", "x..%+-@a-.b-.c.", "@a.b a@b a@.b", "é.x@é.com ä@b.com", "mail é 日本 a.b@c.org, 🎉 d@e.fr", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.0255 300.1.2.3.4", "1..2.3.4 1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111x", "411111111111111", "4111  1111 1111 1111", "41111111111111111111111111111111",
    "+1 (851) 555-9673. +1234567 +12345678 90 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+1((((((((1", "+()1", "+1.1", "1" * 5000, "1 " * 5000, "a" * 30000, "a." * 15000 + "@", "a@" * 10000, "1." * 10000, "+1(" * 8000, "a@b.c " * 3000, "", None, " ", "1.1.1.1@a.b +1.2.3.4.5.6.7.8.9", "x@y.z-4111111111111111",
]


@pytest.fixture(scope="module")
def model(spark):
    return personal_data.fit(spark)


def test_base_spans(spark, model):
    rng = random.Random(4)
    made = ["".join(rng.choice(["1", "22", "4111111111111111", ".", "@", "a", "b.c", "-", " ", "+", "(", ")", "é", "255", "256", "\n", "_", "x@y.z", "1.2.3.4", "+1 234 567 890"]) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    rows = [(i if i % 7 else None, t, 1, "k") for i, t in enumerate(ODD + made)] + [(3, "a@b.c", 1, "k"), (3, "a@b.c", 1, "k")]
    table = spark.createDataFrame(rows, "doc_id long, text string, base int, proposed string").repartition(3)
    got = collections.Counter(tuple(r)[:6] for r in personal_data.redact(table, model=model).collect())
    want = collections.Counter()
    for i, t, *_ in rows:
        spans = base_spans(t)
        want[i, *(sum(k == kind for _, k, _ in spans) for kind in range(4)), hashlib.sha256(written(spans).encode()).hexdigest()] += 1
    assert got == want


def test_added_spans_leave_base_ones(spark, model):
    """Every base span is among all spans; added ones overlap neither them nor each other."""
    rng = random.Random(8)
    bits = ["call (212) 555-0187", "a@b.com", "write to anna at mail dot com", "4111.1111.1111.1111", "card 4111111111111111", "host 2001:db8:1:2:3:4:5:6", "at home. The", "+1 (851) 555-9673", "12:30:45", "and", "1.2.3.4"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))) for i in range(150)]
    found = personal_data.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), model=model).collect()
    added = 0
    for r in found:
        base, more = [(s.start, s.end) for s in r.base], sorted((s.start, s.end) for s in r.added)
        assert [(s.start, s.kind, s.end) for s in r.base] == base_spans(dict(rows)[r.doc_id])
        assert all(b <= c or d <= a for a, b in base for c, d in more) and all(x[1] <= y[0] for x, y in zip(more, more[1:]))
        added += len(more)
    assert added > 100


def test_what_is_added(spark, model):
    """Written-out addresses and numbers are found at their places; prose, dates and numbers that fail their test are left alone."""
    yes = [("Please write to anna.b at example dot com today", "email", "anna.b at example dot com"), ("contact: info (at) market [dot] org", "email", "info (at) market [dot] org"), ("call (212) 555-0187 now", "phone", "(212) 555-0187"), ("Tel.: 030/1234567", "phone", "030/1234567"), ("Visa 4111.1111.1111.1111", "card", "4111.1111.1111.1111"), ("login from 2001:db8:85a3:0:0:8a2e:370:7334 ok", "ip", "2001:db8:85a3:0:0:8a2e:370:7334")]
    no = ["We met at noon. The river was high.", "on 2020-01-15 and 12.05.1999", "from 1990 - 1995 at 12:30:45", "order no. 1234-5678, version 1.2.3", "total 1.234.567 of 98.765", "4111.1111.1111.1112", "token = \"59ea3612aa6fdb1d4556ccac234e5419878f26bc\"", "number 9582442921002355 here", "std::vector a::b", "00:1A:2B:3C:4D:5E"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate([t for t, *_ in yes] + no)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal_data.redact(table, model=model).collect()}
    for i, (t, kind, span) in enumerate(yes):
        assert got[i] == f"{kind}:{t.index(span)}:{t.index(span) + len(span)}", t
    assert all(not got[len(yes) + i] for i in range(len(no)))


def test_held_out_accuracy(spark, model):
    """On examples that took no part in the trees few accepted spans are wrong, and most right ones are accepted."""
    x, y, held = personal_data.labelled(spark, personal_data.EXAMPLES)
    margins = model.margins(x[held])
    taken = margins >= np.array(model.least)[x[held][:, 0]]
    right = y[held] == 1
    assert held.sum() > 1500 and (taken & ~right).sum() <= personal_data.WRONG * taken.sum() and (taken & right).sum() >= 0.9 * right.sum()
    for kind in range(4):  # the exact test that picked each threshold
        own = taken & (x[held][:, 0] == kind)
        n, k = int(own.sum()), int((own & ~right).sum())
        assert sum(math.comb(n, i) * personal_data.WRONG**i * (1 - personal_data.WRONG) ** (n - i) for i in range(k + 1)) <= personal_data.RISK + 1e-9


def test_margins_are_the_same_in_spark(spark, model):
    rows = personal_data.candidates(personal_data.examples(spark, 200)).selectExpr("proposed", f"transform(proposed, c -> {model.margin('c.f')}) AS m").collect()
    assert all(np.allclose(model.margins(np.array([c.f for c in r.proposed])), r.m) for r in rows if r.proposed)


def test_no_python_worker(spark, model):
    plan = personal_data.redact(spark.range(9).selectExpr("id AS doc_id", "concat('+1 234 567 89', id) AS text"), model=model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_personal_data_of_nothing(spark, none, docs, model):  # noqa: F811
    assert personal_data.redact(none, model=model).collect() == []
    assert personal_data.redact(docs, model=model).count() == docs.count()


def test_long_runs_of_matches(spark):
    """Prefix sums in chunks give the places of thousands of matches."""
    n = 20_000
    table = spark.createDataFrame([(1, "a@b.cd é " * n)], "doc_id long, text string")
    row = personal_data.find_personal_data(table, model=personal_data.Model(0.0, [], [math.inf] * 4)).select(F.size("base").alias("n"), F.transform("base", lambda s: s["start"]).alias("at")).first()
    assert row.n == n and row.at == [9 * i for i in range(n)]


# Spelling variants.


def variants(rows):
    counts = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    signs = sorted(set("".join(kept)))
    near, form = {}, {}
    for w in kept:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in signs for k in (0, 1)}
        near[w] = [x for x in edits - {w} if x in kept]
        best = min(near[w], key=lambda x: (-kept[x], x), default=None)
        form[w] = best if best and kept[best] >= 2 * kept[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), kept[w], len(near[w]), kept.get(form[w])) for w in kept}


def spelled(rng, n):
    words = ["".join(rng.choice("abéÿ") for _ in range(rng.randint(4, 9))) for _ in range(40)]
    rows = []
    for i in range(n):
        own = []
        for _ in range(rng.randint(0, 120)):
            w = rng.choice(words[: rng.randint(1, 40)])
            k = rng.randrange(len(w) + 1)
            own.append(rng.choice([w, w, w, w.upper(), w[:k] + rng.choice("abÉ") + w[k:], w[:k] + w[k + 1 :], w[:k] + "b" + w[k + 1 :]]))
        rows.append((i, rng.choice([" ", "-", "1", "\n"]).join(own)))
    return rows


@pytest.mark.parametrize("block", [20_000, 3])
def test_variants(spark, block):
    """All pairs of the vocabulary, also where partitions are searched by pairs of small blocks; long words, repeats, odd rows."""
    rows = spelled(random.Random(block), 60) + [(None, "aabab " * 4), (5, None), (5, "aabab"), (7, ""), (8, ("x" * 5000 + " ") * 3 + ("x" * 4999 + " ") * 3), (9, "café×÷ ") , (9, "café×÷ "), (10, "café×÷ naïve NAÏVE")]
    table = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string").repartition(3)
    got = {r.word: tuple(r)[1:] for r in spelling_variants.variant_groups(table, block=block).collect()}
    assert got == variants(rows) and sum(v[0] is not None for v in got.values()) > 20


def test_near_pairs_come_once(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(5, 9))) for _ in range(400)})
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long").repartition(3)
    got = collections.Counter((r.word, r.near) for r in spelling_variants.near_words(table, 50).collect())

    def one(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]

    assert got == collections.Counter((a, b) for a in words for b in words if one(a, b))


def test_long_ways_to_a_root(spark):
    """A chain of forms, each twice as frequent as the one before."""
    words = [("abcdefghij"[:k] + "z" * (10 - k), 3 * 2**k) for k in range(0, 11)]
    text = " ".join(w for w, n in words for _ in range(n))
    got = {r.word: r.root for r in spelling_variants.variant_groups(spark.createDataFrame([(None, text)], "doc_id long, text string")).collect()}
    want = variants([(None, text)])
    assert got == {w: v[1] for w, v in want.items()} and len({*got.values()}) == 1


def test_variants_of_nothing(spark, none):  # noqa: F811
    assert spelling_variants.variant_groups(none).collect() == []
    assert spelling_variants.variant_groups(spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")).collect() == []


# Vector codes.


def codes(rows, entries=64):
    """Plain Python integers throughout."""
    whole = [(i, [max(-vector_codes.MOST, min(vector_codes.MOST, math.floor(256 * float(np.float64(x))))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not whole:
        return []
    lengths = collections.Counter(len(v) for _, v, _ in whole)
    d = min(lengths, key=lambda n: (-lengths[n], n))
    whole = [(i, v + [0] * (-d % 16), label) for i, v, label in whole if len(v) == d]
    w = len(whole[0][1]) // 16
    part = lambda v, p: v[p * w : (p + 1) * w]
    seeds = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[part(v, p) for _, v, _ in seeds] for p in range(16)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(2):
        for p in range(16):
            own = collections.defaultdict(list)
            for _, v, _ in whole:
                own[near(part(v, p), books[p])[1]].append(part(v, p))
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k])] if k in own else e for k, e in enumerate(books[p])]
    out, errors = [], collections.Counter()
    for i, v, label in whole:
        found = [near(part(v, p), books[p]) for p in range(16)]
        errors[label] += sum(e for e, _ in found)
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found)))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(*r, errors[r[1]], digest) for r in out]


def vectors(rng, n, d, spread=1.0):
    return [(i, [rng.gauss(0, spread) for _ in range(d)], rng.choice([None, 1, 2, 3])) for i in range(n)]


VECTOR = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize(("n", "d"), [(300, 32), (70, 16), (40, 20), (5, 48), (1, 64)])
def test_codes(spark, n, d):
    rng = random.Random(n)
    rows = vectors(rng, n, d)
    rows += [(n + 1, None, 1), (n + 2, [1.0] * (d - 1) + [None], 1), (n + 3, [math.nan] * d, 2), (n + 4, [math.inf] * d, None), (n + 5, [0.5] * (d + 1), 1)] if n > 5 else []
    rows += [(3, rows[0][1], None), (3, rows[0][1], None), (None, rows[-1][1] if rows[-1][1] else rows[1][1], 2), (2, [-0.0] * d, 1), (2, [0.0] * d, 1)] if n > 50 else []
    table = spark.createDataFrame([(*r, 1, "c") for r in rows], VECTOR + ", n int, block string").repartition(3)
    got = collections.Counter(tuple(r) for r in vector_codes.encode_vectors(table).collect())
    assert got == collections.Counter(codes(rows))


def test_codes_of_few_values(spark):
    """Ties between entries, parts that are equal, entries that no part takes, floats and large numbers."""
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, -0.00390625, 0.0, 0.001, 1.0])] * 16, 1) for i in range(200)] + [(500, [1e30] * 16, 1), (501, [-1e30] * 16, 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    assert collections.Counter(tuple(r) for r in vector_codes.encode_vectors(table).collect()) == collections.Counter(codes([(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]))


def test_codes_of_nothing(spark):
    assert vector_codes.encode_vectors(spark.createDataFrame([], VECTOR)).collect() == []
    assert vector_codes.encode_vectors(spark.createDataFrame([(1, None, 1)], VECTOR)).columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    empty = vector_codes.encode_vectors(spark.createDataFrame([(1, [], 1), (2, [], None)], VECTOR)).collect()
    assert [(r.code, r.error) for r in empty] == [("00" * 16, 0)] * 2


def test_codes_do_not_depend_on_partitions(spark):
    rows = vectors(random.Random(6), 500, 32)
    digests = {tuple(sorted(map(tuple, vector_codes.encode_vectors(spark.createDataFrame(rows, VECTOR).repartition(k)).collect()), key=repr)) for k in (1, 7)}
    assert len(digests) == 1
