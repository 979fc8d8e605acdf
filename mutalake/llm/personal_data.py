"""Personal data by candidate gradient boosting, in DataFrame functions only.

Fixed base patterns always redact. Beside them generators of high recall propose overlapping spans
(obfuscated addresses, numbers without a plus or with odd separators). Boosted trees score each
candidate from its format and its context; a kind's threshold is the least at which an exact binomial
test on held-out examples still rejects that more than a given share of what is accepted is wrong.
The trees are nested conditions, so scoring is a projection; a row's spans never leave it. The model
is fitted on examples that Spark writes from forms, with the same patterns and features.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
# Base patterns, written so that no run is looked at from each of its places. \G: a run may go on where the last match ended.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:@|[\[({<] ?(?:at|AT|@) ?[\])}>]| at | AT )", r"(?:\.|[\[({<] ?(?:dot|DOT|\.) ?[\])}>]| dot | DOT )"
_HEX = "[0-9A-Fa-f]{1,4}"
GENERATORS = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+ ?{_AT} ?[A-Za-z0-9-]{{1,63}}+(?: ?{_DOT} ?[A-Za-z0-9-]{{1,63}}+){{1,4}}+",
    "ip": rf"(?<![0-9A-Za-z:.])(?:{_HEX}(?:(?::{_HEX}){{2,7}}|(?::{_HEX}){{0,6}}::(?:{_HEX}(?::{_HEX}){{0,6}})?)|[0-9]{{1,3}}(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)| dot ) ?[0-9]{{1,3}}){{3}})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9](?:[ ./_-]{0,3}[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\(?0{0,2}[0-9]{1,4}\)?(?:[ ./-]{1,3}\(?[0-9]{2,7}\)?){1,5}|0[0-9]{8,12})(?![0-9A-Za-z])",
}
#: Words before a number or an address that tell its kind.
CUES = {
    "email": "mail|write|contact|kontakt|correo|courriel|schreib|adress",
    "ip": "ip|host|server|ping|login|logged|addr|router",
    "card": "card|visa|amex|karte|tarjeta|carte|pay|master",
    "phone": "tel|phone|call|fax|mobil|cell|anruf|ruf|tél|appel|llam|whatsapp|sms",
    "number": r"no\.|nr\.|order|invoice|ref|rechnung|version|isbn|page|section|item|part|date|year|token|id|serial|price|total",
}
#: Code points of context that the features see, and positions that a fold handles together.
CONTEXT, CHUNK = 24, 256
#: Examples written, trees, their depth, step; share of wrong spans that a kind's threshold allows, at which risk.
EXAMPLES, TREES, DEPTH, RATE, WRONG, RISK = 6000, 30, 3, 0.3, 0.05, 0.05


def _scan(values: Column, zero: Column, op) -> Column:
    """Of each place, op over all values before it. Chunks are folded, then their totals, so that no long array grows one by one."""

    def run(chunk: Column, start: Column) -> Column:
        none = F.array().cast("array<int>")
        return F.aggregate(chunk, F.struct(none.alias("out"), start.alias("now")), lambda s, x: F.struct(F.concat(s["out"], F.array(s["now"])).alias("out"), op(s["now"], x).alias("now")), lambda s: s["out"])

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: F.slice(v, c * CHUNK + 1, F.lit(CHUNK)))
    total = lambda chunk: F.aggregate(chunk, zero, op)
    # transform of a one-element array binds what it holds once.
    whole = lambda chunks: F.flatten(F.transform(F.arrays_zip(chunks.alias("c"), run(F.transform(chunks, total), zero).alias("s")), lambda x: run(x["c"], x["s"])))
    return F.when(F.size(values) <= CHUNK, run(values, zero)).otherwise(F.transform(F.array(cut(values)), whole)[0])


def _plus(a, b):
    return a + b


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test; what yields the string is evaluated once."""
    doubled = F.array(*(F.lit(2 * d - 9 * (d > 4)) for d in range(10)))
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, F.get(doubled, c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), _plus) % 10 == 0


def _sound(kind: str, span: Column) -> Column:
    """What a base match must also fulfil."""
    digits = F.regexp_replace(span, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return span.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$")
    if kind == "card":
        return F.when((F.length(span) <= 38) & n.between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def matches(df: DataFrame, patterns: dict[str, str], needs: dict[str, str]) -> DataFrame:
    """df (with text) and, for each name, an array of (start, end, span, left, right) of the pattern's matches, leftmost first.

    left and right are what lies between a match and its neighbours, CONTEXT code points at most.
    needs: a pattern without which there is no match, tried first.
    """
    names = list(patterns)
    may = {k: F.col("text").rlike(needs[k]) for k in names}
    none = F.array().cast("array<string>")
    cut = df.select("*", *(F.when(may[k], F.split("text", patterns[k], -1)).otherwise(none).alias(f"{k}_rest") for k in names), *(F.when(may[k], F.regexp_extract_all("text", F.lit(patterns[k]), F.lit(0))).otherwise(none).alias(f"{k}_span") for k in names))
    step = lambda k: F.transform(f"{k}_span", lambda x, i: F.length(x) + F.length(F.get(f"{k}_rest", i)))
    steps = cut.select(*df.columns, *(c for k in names for c in (f"{k}_rest", f"{k}_span")), *(step(k).alias(f"{k}_step") for k in names))
    placed = steps.select(*df.columns, *(c for k in names for c in (f"{k}_rest", f"{k}_span")), *(_scan(F.col(f"{k}_step"), F.lit(0), _plus).alias(f"{k}_at") for k in names))

    def spans(k: str) -> Column:
        rest = lambda i: F.get(f"{k}_rest", i)
        start = lambda i: F.get(f"{k}_at", i) + F.length(rest(i))
        return F.transform(f"{k}_span", lambda x, i: F.struct(start(i).alias("start"), (start(i) + F.length(x)).alias("end"), x.alias("span"), F.right(rest(i), F.lit(CONTEXT)).alias("left"), F.left(rest(i + 1), F.lit(CONTEXT)).alias("right")))

    return placed.select(*df.columns, *(spans(k).alias(k) for k in names))


def _count(span: Column, signs: str) -> Column:
    return F.length(span) - F.length(F.translate(span, signs, ""))


def features(kind: str, c: Column) -> list[Column]:
    """Format and context of a candidate, as whole numbers."""
    span, left, right = c["span"], c["left"], c["right"]
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    digits = F.regexp_replace(span, "[^0-9]", "")
    out = [F.lit(KINDS.index(kind)), F.length(digits), F.length(span), _count(span, "."), _count(span, "-"), _count(span, " "), _count(span, "()"), _count(span, "/_"), _count(span, ":")]
    out += [F.regexp_count(span, F.lit("[0-9]+")), F.length(F.regexp_extract(span, "^[^0-9]*([0-9]*)", 1)), F.length(F.regexp_extract(span, "([0-9]*)[^0-9]*$", 1)), flag(F.length(digits).between(12, 19) & _luhn(digits))]
    out += [flag(span.rlike(x)) for x in ("@", r"[\[({<] ?(?:at|AT|@) ?[\])}>]", r"[\[({<] ?(?:dot|DOT|\.) ?[\])}>]", " (?:dot|DOT) ", r"(?:^| )(?:at|AT) ", r"\. ", "^\\(?0", r"^[^A-Za-z]*$", "::", "[a-fA-F]", r"(?:19|20)[0-9][0-9]", r"(?i)(?:\.|dot|[\])}>]) ?(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$")]
    out += [flag(left.rlike(f"(?i)(?:^|[^A-Za-z])(?:{CUES[k]})[a-z.]*[^A-Za-z0-9]*(?:[a-z]{{1,6}} ?)?[^A-Za-z0-9]*$")) for k in (*KINDS, "number")]
    return out + [flag(left.rlike("[A-Za-z0-9_]$")), flag(left.rlike(r"[$€£#=/\"'.:-]$")), flag(right.rlike(r"^[A-Za-z0-9_%/\"'=]")), flag(right.rlike("^ ?(?:kg|km|cm|mm|%|€|EUR|USD|m|g|p)\\b"))]


def candidates(df: DataFrame) -> DataFrame:
    """df and a column proposed: (kind, start, end, features) of what the generators find."""
    found = matches(df, GENERATORS, {"email": r"@|[\[({<] ?(?:at|AT)| at | AT ", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"})
    each = lambda k: F.transform(k, lambda c: F.struct(F.lit(KINDS.index(k)).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.array(*features(k, c)).alias("f")))
    return found.select(*df.columns, F.concat(*map(each, KINDS)).alias("proposed"))


# Forms of examples: kind, whether it is personal data, cue before it (none: any word), format. #: a digit, ~: a hex digit, ^: a word,
# !: the digit that makes the number pass the Luhn test, ?: one that doesn't.
FORMS = [
    *(("email", 1, cue, f) for cue in ("email", None) for f in ("^ at ^ dot com", "^.^ [at] ^ [dot] org", "^(at)^.net", "^##(at)^(dot)com", "^ @ ^.com", "^## @ ^ . de", "^_^ AT ^ DOT com", "^{at}^{dot}io", "^ [at] ^.^.edu", "^<at>^.fr", "^.^ at mail# dot ^ dot com")),
    *(("email", 0, cue, f) for cue in (None, None, "number") for f in ("^ at ^. ^", "^ at ^.\n^", "^ at ^. ^ ^", "^ @ #.##", "^ @ ##.##", "^ at ##.##", "^ at ^. ^. ^", "^ @ ^. ^", "^ at #.#")),
    *(("ip", 1, cue, f) for cue in ("ip", None) for f in ("~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~", "2001:db8:~~~~:~~::~~~#", "fe80::~~~~:~~~~:~~~~:~~~~", "2a0#:~~~:~~~~::#", "##[.]#[.]##[.]#", "1##[dot]##[dot]#[dot]2#", "1# dot ## dot # dot 1##")),
    *(("ip", 0, cue, f) for cue in (None, "number") for f in ("##:##:##", "#:##:##", "~~:~~:~~:~~:~~:~~", "#:#:#", "#:#:#:#", "##:##:##:##", "dad::add", "##:##:##:###", "#::#")),
    *(("card", 1, cue, f) for cue in ("card", None) for f in ("4###.####.####.###!", "5###  ####  ####  ###!", "3###/######/####!", "4###_####_####_###!", "5### - #### - #### - ###!", "4###/####/####/###!")),
    *(("card", 0, cue, f) for cue in ("card", None, None, "number") for f in ("###############?", "####.####.####.###?", "####  ####  ####  ###?", "#.###.###.###.##?", "############?", "##.##.####.##.##?", "#### / #### / ###?", "a###############!b", "20##-0#-1# ##:##:##.##?", "##################?")),
    *(("phone", 1, cue, f) for cue in ("phone", "phone", None) for f in ("(###) ###-####", "(###) ### ####", "(0##) #######", "00## ### #######", "###-###-####")),
    *(("phone", 1, "phone", f) for f in ("0## ### ## ##", "0###/######", "###.###.####", "0#### ######", "01 ## ## ## ##", "0##########", "### ### ###", "0### - #######", "### ####", "00##-##-#######", "### ### ####", "###/#######")),
    *(("phone", 0, cue, f) for cue in (None, None, "number") for f in ("20##-0#-1#", "##.0#.20##", "##/0#/19##", "19##-20##", "19## - 20##", "1.###.###", "# ### ###", "##.##.##", "## ## ## ##", "1#.##-1#.##", "978-#-###-#####-#", "####-####", "#.##", "##-##", "### ###", "#.###.###.###", "#/##", "20##/20##", "1#.##", "##.####", "#### ####", "###-##")),
    *(("phone", 0, "number", f) for f in ("###-####", "###-###-####", "### ### ####", "0########", "## ### ###", "####-###-##")),
]
LEADS = {
    "email": ["write to ", "e-mail: ", "mail me: ", "Contact: ", "Kontakt: ", "correo: ", "courriel : ", "Adresse: "],
    "ip": ["host ", "server ", "IP: ", "login from ", "ping ", "IP address ", "router at "],
    "card": ["card ", "Visa ", "pay with ", "Karte: ", "tarjeta ", "carte : ", "credit card number: "],
    "phone": ["call ", "Tel.: ", "phone ", "Telefon: ", "Tél. ", "teléfono ", "mobile: ", "fax ", "call me on ", "phone no. "],
    "number": ["order no. ", "invoice ", "ref. ", "Rechnung Nr. ", "version ", "ISBN ", "page ", "section ", "item ", "part ", "token = \"", "ID: ", "price ", "total "],
}
WORDS = ["river", "stone", "Anna", "table", "green", "market", "und", "haus", "noche", "libro", "maison", "jour", "often", "window", "winter", "peter", "school", "people", "line", "train", "meets", "looked", "home", "noon", "once", "sales", "office", "example", "team", "info"]


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """(id, text, kind, good, start, end): texts written from the forms, and where the filled form lies."""
    table = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    forms = table([{"kind": KINDS.index(k), "good": good, "cue": cue or "none", "form": form} for k, good, cue, form in FORMS], "array<struct<kind:int,good:int,cue:string,form:string>>")
    leads = F.from_json(F.lit(json.dumps(LEADS | {"none": [f"{w} " for w in WORDS]})), "map<string,array<string>>")
    words = table(WORDS, "array<string>")
    one = lambda values, *salt: F.get(values, F.pmod(F.xxhash64("id", *salt), F.size(values)).cast("int"))
    fresh = spark.range(n).select("id", forms.alias("forms"), leads.alias("leads"), words.alias("words")).select("id", F.get("forms", F.pmod("id", F.size("forms")).cast("int")).alias("x"), "leads", "words")
    draw = lambda i, most: F.pmod(F.xxhash64(F.lit("d"), "id", i), F.lit(most)).cast("int")
    fill = lambda c, i: F.when(c == "#", draw(i, 10).cast("string")).when(c == "~", F.lower(F.hex(draw(i, 16).cast("long")))).when(c == "^", one(F.col("words"), i)).otherwise(c)
    filled = fresh.select("id", "x.kind", "x.good", one(F.element_at("leads", F.col("x.cue")), F.lit("lead")).alias("lead"), "words", F.array_join(F.transform(F.split("x.form", ""), fill), "").alias("filled"))
    # The digit that completes the Luhn sum; a wrong one is some way off it.
    known = F.regexp_replace(F.regexp_replace("filled", "[^0-9!?]", ""), "[!?]", "")
    check = F.array_position(F.transform(F.transform(F.array(*map(F.lit, range(10))), lambda d: F.concat("known", d.cast("string"))), _luhn), True) - 1
    checked = filled.withColumn("known", known).withColumn("check", F.when(F.col("filled").rlike("[!?]"), check).otherwise(0))
    digit = lambda x: (x % 10).cast("int").cast("string")
    spans = checked.select("id", "kind", "good", "words", "lead", F.regexp_replace(F.regexp_replace("filled", F.lit("!"), digit(F.col("check"))), F.lit("[?]"), digit(F.col("check") + 1 + draw(F.lit(99), 9))).alias("span"))
    parts = spans.select("*", F.concat(one(F.col("words"), F.lit(0)), one(F.array(*map(F.lit, (" ", ", ", ". ", "\n"))), F.lit(1)), "lead").alias("before"), F.concat(one(F.array(*map(F.lit, (" ", ", ", ". ", "\n", " - ", "."))), F.lit(2)), one(F.col("words"), F.lit(3)), F.lit(" "), one(F.col("words"), F.lit(4))).alias("after"))
    inside = F.col("span").rlike("^a.*b$").cast("int")  # a form between letters, which aren't part of it
    return parts.select("id", F.concat("before", "span", "after").alias("text"), "kind", "good", (F.length("before") + inside).alias("start"), (F.length("before") + F.length("span") - inside).alias("end"))


@dataclass
class Model:
    """Trees as nested (feature, cutoff, low, high) or leaf values; the least margin a kind accepts."""

    bias: float
    trees: list
    least: list[float]

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for tree in self.trees:
            out += _apply(tree, x)
        return out

    def margin(self, features: str) -> str:
        """The trees as an SQL expression of an array of features."""

        def expression(tree) -> str:
            if isinstance(tree, float):
                return f"{tree!r}D"
            j, cut, low, high = tree
            return f"if({features}[{j}] <= {cut}, {expression(low)}, {expression(high)})"

        return " + ".join([f"{self.bias!r}D", *map(expression, self.trees)])


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    j, cut, low, high = tree
    return np.where(x[:, j] <= cut, _apply(low, x), _apply(high, x))


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, least: int = 8, ridge: float = 1.0):
    """A tree of the second-order gain; of equal gains the first feature and the lowest cutoff."""
    g, h = gradient.sum(), hessian.sum()
    best = (1e-6, None, None)
    if depth:
        for j in range(x.shape[1]):
            values, place = np.unique(x[:, j], return_inverse=True)
            below, n = np.cumsum(np.bincount(place, gradient)), np.cumsum(np.bincount(place))
            weight = np.cumsum(np.bincount(place, hessian))
            gain = below**2 / (weight + ridge) + (g - below) ** 2 / (h - weight + ridge) - g**2 / (h + ridge)
            gain[(n < least) | (len(x) - n < least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0] * (1 + 1e-9):
                best = (gain[k], j, int(values[k]))
    if best[1] is None:
        return float(round(-RATE * g / (h + ridge), 6))
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[low], gradient[low], hessian[low], depth - 1), _grow(x[~low], gradient[~low], hessian[~low], depth - 1))


def _few_wrong(k: int, n: int) -> bool:
    """Whether k wrong of n reject, at RISK, that a share WRONG or more is wrong."""
    return k <= n * WRONG and sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(WRONG) + (n - i) * math.log1p(-WRONG)) for i in range(k + 1)) <= RISK


def boost(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Model:
    """Trees by gradient boosting on the rows that aren't held out; thresholds on those that are."""
    own, truth = x[~held], y[~held]
    share = min(max(truth.mean(), 1e-3), 1 - 1e-3)
    model = Model(float(round(math.log(share / (1 - share)), 6)), [], [math.inf] * len(KINDS))
    margin = np.full(len(own), model.bias)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        model.trees.append(_grow(own, p - truth, p * (1 - p), DEPTH))
        margin += _apply(model.trees[-1], own)
    scores = model.margins(x[held])
    for kind in range(len(KINDS)):
        of = x[held][:, 0] == kind
        s, wrong = scores[of], 1 - y[held][of]
        for cut in sorted(set(s.tolist()), reverse=True):
            taken = s >= cut
            if _few_wrong(int(wrong[taken].sum()), int(taken.sum())):
                model.least[kind] = float(cut) - 1e-9
            elif wrong[taken].sum() > max(2, WRONG * taken.sum()):
                break
    return model


def labelled(spark: SparkSession, n: int = EXAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, marks, held out) of the candidates of the written examples; n texts of one to three candidates."""
    rows = candidates(examples(spark, n)).select("id", "kind", "good", "start", "end", "proposed").collect()
    found = sorted((r.id, c.kind, c.start, c.f, r.good == 1 and c.kind == r.kind and abs(c.start - r.start) + abs(c.end - r.end) <= 2) for r in rows for c in r.proposed)
    return np.array([f for _, _, _, f, _ in found], dtype=np.int64), np.array([y for *_, y in found], dtype=np.float64), np.array([i // len(FORMS) % 3 == 0 for i, *_ in found])


_FITTED: dict[int, Model] = {}


def fit(spark: SparkSession, n: int = EXAMPLES) -> Model:
    """The model of n examples; they are always the same, so a process fits it once."""
    if n not in _FITTED:
        _FITTED[n] = boost(*labelled(spark, n))
    return _FITTED[n]


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, base, added): arrays of (start, kind, end) of every row, in order; kind is the place in KINDS, positions count code points.

    base: the fixed patterns' spans, which always stay. added: accepted candidates that overlap no
    base span; of overlapping ones the higher score stays, of equals the earlier one. Null and empty
    texts have none. Repeated rows and rows without an id are searched each; an empty table gives no
    rows; other columns are neither read nor returned.
    """
    model = model or fit(docs.sparkSession)
    source = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = matches(source, BASE, {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+"})
    spans = lambda k: F.transform(F.filter(k, lambda c: _sound(k, c["span"])), lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index(k)).alias("kind"), c["end"].alias("end")))
    proposed = candidates(found.select("doc_id", "text", F.array_sort(F.concat(*map(spans, KINDS))).alias("base")))
    scored = F.expr(f"transform(proposed, c -> named_struct('start', c.start, 'kind', c.kind, 'end', c.end, 'score', {model.margin('c.f')}))")
    least = F.array(*map(F.lit, model.least))
    taken = proposed.select("doc_id", "base", F.filter(scored, lambda c: c["score"] >= F.get(least, c["kind"])).alias("taken"))
    # Each taken candidate among the base spans: the furthest end before it and the next start after it.
    of_base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), F.lit(math.inf).alias("score")))
    both = taken.select("doc_id", "base", F.when(F.size("taken") > 0, F.array_sort(F.concat(of_base, "taken"))).otherwise(F.slice(of_base, 1, 0)).alias("both"))
    is_base = lambda b: b["score"] == math.inf
    ends = F.transform("both", lambda b: F.when(is_base(b), b["end"]).otherwise(0))
    starts = F.transform("both", lambda b: F.when(is_base(b), b["start"]).otherwise(2**31 - 1))
    around = both.select("doc_id", "base", "both", _scan(ends, F.lit(0), lambda a, b: F.greatest(a, b)).alias("ended"), F.reverse(_scan(F.reverse(starts), F.lit(2**31 - 1), lambda a, b: F.least(a, b))).alias("next"))
    clear = F.filter("both", lambda b, i: ~is_base(b) & (F.get("ended", i) <= b["start"]) & (F.get("next", i) >= b["end"]))
    kind = "array<struct<start:int,kind:int,end:int,score:double>>"

    def settle(out: Column, c: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        apart = F.coalesce(last["end"] <= c["start"], F.lit(True))
        return F.when(apart, F.concat(out, F.array(c))).when(c["score"] > last["score"], F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(c))).otherwise(out)

    added = F.aggregate(clear, F.array().cast(kind), settle)
    return around.select("doc_id", "base", F.transform(added, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))).alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row; the counts and the hash are of the base spans."""
    found = find_personal_data(docs, key, text, model)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", "added"))).alias("spans"))
