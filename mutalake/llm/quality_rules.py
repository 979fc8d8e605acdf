"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Per text a few ratios are measured. Fixed base rules reject first. Then, for each stratum, cutoffs of
all ratios are tightened together along one path that is fixed beforehand. At each step the hypothesis
that its cutoffs reject more than ALPHA of the good texts is tested on the labelled holdout; it is
rejected if an exact binomial tail is at most DELTA / strata. The walk begins at the loosest step and
stops at the first that fails, so it needs no further correction (fixed-sequence testing). Of the
steps that pass, the one that rejects most bad texts is taken, the loosest of equals; none if it
rejects none. So with probability 1 - DELTA every stratum loses at most ALPHA of its good texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutalake.llm.common import SPACE, checkpointed

ALPHA, DELTA = 0.03, 0.05
#: Cutoffs of each ratio, from loose to tight; a text is rejected above the cutoff.
GRID = {
    "symbol_ratio": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02],
    "dup_line_ratio": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeat_ratio": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "upper_ratio": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15],
    "mean_word": [30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0],
}
#: Steps of the walk; at each every ratio has its cutoff of the same share of its grid.
STEPS = 14
PATH = [tuple(grid[i * len(grid) // STEPS] for grid in GRID.values()) for i in range(STEPS)]
#: Strata up to which their cutoffs are broadcast.
BROADCAST_STRATA = 100_000
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _covered_words(words: Column, n: Column) -> Column:
    """Words in three-word windows that occur at least twice.

    Each window is a 64-bit number: its hash in the high bits, its place in as many low bits as the
    word count needs. Sorting puts equal windows side by side; neighbours with equal hash bits are
    compared word by word.
    """
    bits = F.length(F.bin(n)).cast("int")
    # array(x) with transform binds x once, so it isn't evaluated again for each element.
    place = lambda key, b: key.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1).cast("int")
    word = lambda i: F.get(words, i)
    same = lambda p, q: (word(p) == word(q)) & (word(p + 1) == word(q + 1)) & (word(p + 2) == word(q + 2))
    keys = F.sort_array(F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0)).cast("int")), lambda w, i: F.call_function("shiftleft", F.xxhash64(w, word(i + 1), word(i + 2)), bits).bitwiseOR(i.cast("long"))))

    def repeated(keys: Column) -> Column:
        def beside(key: Column, other: Column) -> Column:
            return F.coalesce((F.call_function("shiftrightunsigned", key, bits) == F.call_function("shiftrightunsigned", other, bits)) & same(place(key, bits), place(other, bits)), F.lit(False))

        found = F.filter(keys, lambda key, i: beside(key, F.get(keys, i + 1)) | beside(key, F.get(keys, i - 1)))
        return F.sort_array(F.transform(found, lambda key: place(key, bits)))

    def covered(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)

    return F.transform(F.transform(F.array(keys), repeated), covered)[0]


def text_figures(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper) of every row."""
    plain = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    split = plain.select("doc_id", "stratum", "text", F.array_remove(F.split("text", f"{SPACE}+"), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    counted = split.select(
        "doc_id", "stratum", "words", F.size("words").cast("long").alias("n_words"), F.length(F.regexp_replace("text", f"{SPACE}+", "")).cast("long").alias("word_chars"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    return counted.select("doc_id", "stratum", *FIGURES[:4], _covered_words(F.col("words"), F.col("n_words")).alias("n_repeat_words"), "n_lines", "n_upper")


def _ratios() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {"symbol_ratio": share("n_symbols", "word_chars"), "dup_line_ratio": share("n_dup_lines", "n_lines"), "repeat_ratio": share("n_repeat_words", "n_words"), "upper_ratio": share("n_upper", "word_chars"), "mean_word": share("word_chars", "n_words")}


def _tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k <= n p, summed term by term in logarithms."""
    import math

    start = F.struct((n * math.log1p(-p)).cast("double").alias("log"), F.exp(n * math.log1p(-p)).alias("sum"))

    def step(state: Column, i: Column) -> Column:
        log = state["log"] + F.log((n - i + 1) / i) + math.log(p / (1 - p))
        return F.struct(log.alias("log"), (state["sum"] + F.exp(log)).alias("sum"))

    return F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, step, lambda s: s["sum"])


def fit_cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, one cutoff a ratio, null for none) from figures with a column good (boolean)."""
    ratios = _ratios()

    def rejects(step: tuple[float, ...]) -> Column:
        hit = F.lit(False)
        for value, cut in zip(ratios.values(), step, strict=True):
            hit = hit | (value > cut)
        return hit

    tests = F.array(*(F.struct(F.lit(i).alias("step"), rejects(step).alias("hit")) for i, step in enumerate(PATH)))
    counts = labelled.select("stratum", "good", F.explode(tests).alias("t")).groupBy("stratum", "t.step").agg(F.count_if("good").alias("n"), F.count_if(F.col("good") & F.col("t.hit")).alias("k"), F.count_if(~F.col("good") & F.col("t.hit")).alias("caught"))
    strata = labelled.agg(F.count_distinct("stratum").alias("strata"))
    p = F.when(F.col("k") > F.col("n") * alpha, 1.0).otherwise(_tail(F.col("k"), F.col("n"), alpha))
    tested = counts.crossJoin(F.broadcast(strata)).select("*", (p <= F.lit(delta) / F.col("strata")).alias("passes"))  # strata is one row
    walks = tested.groupBy("stratum").agg(F.collect_list(F.struct("step", "passes", "caught")).alias("walk"))  # one entry a step
    first_fail = F.coalesce(F.array_min(F.transform(F.filter("walk", lambda x: ~x["passes"]), lambda x: x["step"])), F.lit(len(PATH)))
    valid = F.filter("walk", lambda x: (x["step"] < F.col("stop")) & (x["caught"] > 0))
    best = -F.array_max(F.transform("valid", lambda x: F.struct(x["caught"].alias("caught"), (-x["step"]).alias("loose"))))["loose"]
    chosen = walks.withColumn("stop", first_fail).withColumn("valid", valid).select("stratum", best.alias("step"))
    cut = lambda j: F.get(F.array(*(F.lit(step[j]) for step in PATH)), F.col("step"))
    return chosen.select("stratum", *(cut(j).alias(f"max_{name}") for j, name in enumerate(GRID)))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", good: str = "quality") -> DataFrame:
    """(doc_id, figures, base_failed, kept) of every row.

    Labels with a null or unknown id or a null mark are left out; a text with several marks counts
    once for each. A stratum without enough good texts has no cutoffs, so only the base rules hold.
    Null and empty texts have zero figures and fail the base rules. Null strata are one stratum.
    Repeated rows are judged each; an empty table gives no rows; ties go to the looser cutoff; other
    columns are neither read nor returned.
    """
    figures = checkpointed(text_figures(docs, key, text, stratum))
    marks = labels.select(F.col(key).alias("doc_id"), (F.col(good) == 1).alias("good")).where("good is not null")
    cutoffs = checkpointed(fit_cutoffs(figures.join(marks, "doc_id")))
    few = cutoffs.count() <= BROADCAST_STRATA
    judged = figures.join(F.broadcast(cutoffs) if few else cutoffs, "stratum", "left")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passes = [F.coalesce(value <= F.col(f"max_{name}"), F.lit(True)) for name, value in _ratios().items()]
    verdict = ~base
    for x in passes:
        verdict = verdict & x
    return judged.select("doc_id", *FIGURES, base.alias("base_failed"), verdict.alias("kept"))
