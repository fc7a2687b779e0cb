"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base spans come from exact patterns and checks (e-mail, IPv4, card with Luhn digit, international phone); they
always stay. Besides, high-recall generators propose spans of each kind that may overlap: addresses written with "at"
and "dot", numbers with other separators or without a plus sign. What tells a base span from these, such as the plus
sign or the at sign, is left out of the description of a candidate, so the model has to judge by the rest: other
format (groups of digits, endings, check digits) and context (words before, characters around). A candidate that meets
a base span of its kind is a positive example; one that meets a base span of another kind or fails the kind's format
(check digit, parts of an address, number of digits, a date) a negative one; all others are open, neither. Descriptions
are yes/no answers, so the training set is a table of at most 2^12 cells a kind, counted over all documents.
Gradient boosting of two-level trees runs on that table for three quarters of the documents (by hash of id and text), in
two steps, as for positive and unlabelled examples: trees that tell base spans from all others give the share of
personal data that is marked as such (their mean on the base spans of the other documents), and from that the weight at
which an open candidate counts as positive, the rest of it as negative; trees of those weights score candidates. However
many open candidates look like base spans, they don't speak against themselves. On the documents kept apart each kind's
threshold is calibrated: the lowest score from which on `precision` of the weights are positive, and half of them at each score. Open candidates from there on
that touch no base span are added. Where added spans of several kinds overlap, the kind with the better precision keeps its span.

Patterns are written with possessive loops, equal in what they match, so long runs neither recurse nor go
quadratic. Spans meet each other in windows over a row's spans in order, never in pairs. Offsets are code points, ends
exclusive. Null text counts as empty; each row stands for itself, repeated rows, null ids and ties included; without
candidates, or without base spans to learn a kind from, nothing is added; extra columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx

#: Kinds in their order, with the pattern of each (as asked for: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+,
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), [0-9]([\x20-]?[0-9])+ of 14 digits or more, \+[0-9][\x20().0-9-]+[0-9]).
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13}+(?:[\x20-]?[0-9])*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates of each kind.
PROPOSE = {
    "email": r"(?i)(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+|(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9.])[0-9]++(?:(?:\x20?\.\x20?|[\[(]\.[\])]|\x20dot\x20)[0-9]++){2,}+",
    "card": r"(?<![0-9])[0-9](?:[\x20./_-]{0,3}[0-9]){11}+(?:[\x20./_-]{0,3}[0-9])*+",
    "phone": r"(?<![0-9])[+(]?[0-9](?:[\x20()./-]{0,2}+[0-9]){6}+(?:[\x20()./-]{0,2}+[0-9])*+",
}
CONTEXT = {"email": "mail|contact|write|address", "ip": "ip|host|server|address", "card": "card|visa|pay|credit|account", "phone": "phone|tel|call|fax|mobile|reach"}
#: Common endings of addresses.
TOP = r"(?i)(\.|\bdot\b\W{0,2})(com|org|net|edu|gov|int|info|biz|io|co|eu|uk|de|fr|es|it|nl|us|ca|au|jp|cn|in|br)$"
BITS, ROUNDS, RATE, PRECISION = 12, 30, 0.3, 0.9


def _let(value: Column, f) -> Column:
    """f(value), with the value worked out once."""
    return F.transform(F.array(value), f)[0]


def _starts(lengths: Column) -> Column:
    """Where each part begins if parts of these lengths follow each other: sums over blocks of about the root of their number, then within each."""
    step = F.ceil(F.sqrt(F.size(lengths))).cast("int")
    total = lambda x: F.aggregate(x, F.lit(0), lambda acc, n: acc + n)
    blocks = _let(step, lambda k: F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / k).cast("int")), lambda b: F.slice(lengths, b * k + 1, k)))

    def of(blocks: Column) -> Column:
        begins = F.aggregate(F.transform(blocks, total), F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
        return _let(begins, lambda at: F.flatten(F.transform(blocks, lambda x, b: F.transform(x, lambda n, i: at[b] + total(F.slice(x, F.lit(1), i))))))

    return _let(blocks, of)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value, before, after) of all leftmost matches; before and after are the text between matches."""

    def spans(parts: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))
        made = lambda begins: F.transform(at, lambda i: F.struct(begins[i].alias("start"), begins[i + 1].alias("end"), parts[i].alias("value"), parts[i - 1].alias("before"), parts[i + 1].alias("after")))
        return F.when(F.size(parts) >= 3, _let(_let(F.transform(parts, F.length), _starts), made))

    return _let(F.split(F.regexp_replace(text, pattern, "\u0001$0\u0001"), "\u0001"), spans)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digit sum with every second digit from the right doubled ends in 0."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.try_to_number(c, F.lit("9")).cast("int") * (i % 2 + 1))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(F.coalesce(d, F.lit(0)))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return _let(_digits(value), lambda d: F.length(d).between(14, 19) & _luhn(d))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


_SPAN = "array<struct<start:int,end:int,kind:int,value:string,before:string,after:string>>"


def _found(text: Column, kind: str, pattern: str, guard: Column) -> Column:
    """Matches as (start, end, kind, value, the 24 characters before, the next one after)."""
    short = lambda m: F.struct(m["start"], m["end"], F.lit(KINDS.index(kind)).alias("kind"), m["value"], F.right(m["before"], F.lit(24)).alias("before"), F.left(m["after"], F.lit(1)).alias("after"))
    return F.coalesce(F.when(guard, F.transform(matches(text, pattern), short)).cast(_SPAN), F.array().cast(_SPAN))


def _code(kind: str, m: Column) -> Column:
    """Answers to the questions on a candidate as bits. None asks for the mark that only base spans of the kind have."""
    value, before, after = m["value"], m["before"], m["after"]
    digits = _digits(value)
    n = F.length(digits)
    asked = [F.lower(before).rlike(CONTEXT[kind]), before.rlike(r"[\p{L}\p{N}_]$"), after.rlike(r"^[\p{L}\p{N}_@]"), before.rlike(r"[\x20(:|\n]$") | (before == "")]
    asked += {
        "email": [value.rlike(r"[A-Za-z]{2,}$"), value.rlike(r"(?i)(\.|dot\W{0,2})[A-Za-z]{2,6}$"), value.rlike(r"^[^@\x20\[({]*[0-9._-]"), value.rlike(r"^[A-Za-z]"), value.rlike(TOP), value.rlike(r"(?i)(\.|dot\W).*(\.|dot\W)")],
        "ip": [_parts_fit(value), F.size(F.split(value, "[^0-9]+")) == 4, F.length(value) > 8, after.rlike(r"^\.?\p{N}"), value.rlike(r"^(10|127|172|192)[^0-9]")],
        "card": [_luhn(digits), n.isin(15, 16), n.between(14, 19), value.rlike(r"^[3-6]"), value.rlike(r"^([0-9]{4}[^0-9]*){3}[0-9]+$"), value.rlike(r"[0-9][^0-9]{2,}[0-9]")],
        "phone": [n.between(10, 13), n < 10, value.rlike(r"\([0-9]{2,4}\)"), value.rlike(r"[0-9]{3}[\x20./-][0-9]{4}$"), value.rlike(r"^\D*([0-9]+[^0-9]+){2,4}[0-9]+$"), value.rlike(r"[^0-9+(]"), value.rlike(r"[0-9]{7}")],
    }[kind]
    return sum((F.when(a, 1 << i).otherwise(0) for i, a in enumerate(asked)), F.lit(0)).cast("int")


def _parts_fit(value: Column) -> Column:
    return F.forall(F.split(value, "[^0-9]+"), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))


def _fails(kind: str, m: Column) -> Column:
    """Whether the candidate can't be of its kind by its format."""
    value, digits = m["value"], _digits(m["value"])
    n = F.length(digits)
    if kind == "email":
        return ~value.rlike(r"(?i)(\.|dot\W{0,2})[A-Za-z]{2,}$") | (~value.rlike(r"[@\[({]") & ~value.rlike(TOP))
    if kind == "ip":
        return ~_parts_fit(value) | (F.size(F.split(value, "[^0-9]+")) != 4) | m["after"].rlike(r"^\.?\p{N}")
    if kind == "card":
        return ~n.between(14, 19) | ~_luhn(digits)
    dated = value.rlike(r"^((19|20)[0-9]{2}([./-])[0-9]{1,2}\3[0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}\4(19|20)[0-9]{2})")
    return ~n.between(7, 15) | dated | m["before"].rlike(r"[\p{L}\p{N}_.,/-]$") | m["after"].rlike(r"^[\p{L}\p{N}_/@]")


def scan(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, rest, base, guess): a number for each row, whether it is kept apart for calibration, base spans by start and kind, and
    candidates as (start, kind, end, code, fails)."""
    flat = F.translate(F.coalesce(F.col(text), F.lit("")), "\u0001", "\u0002")
    t = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), flat.alias("t"), F.col(text).rlike(r"[0-9](?:[\x20./()_-]{0,3}[0-9]){5}").alias("many"))
    many = F.coalesce(F.col("many"), F.lit(False))
    guard = {"email": F.contains("t", F.lit("@")), "ip": F.col("t").rlike(r"[0-9]\.[0-9]"), "card": many, "phone": F.contains("t", F.lit("+"))}
    base = {k: F.filter(_found(F.col("t"), k, BASE[k], guard[k]), partial(lambda k, m: _valid(k, m["value"]), k)) for k in KINDS}
    spoken = F.col("t").rlike(r"(?i)[\[({\x20]at[\])}\x20]\x20?[A-Za-z0-9-]+(?:\.[A-Za-z0-9]|\x20?[\[({]?\x20?dot\b)")
    hint = {"email": guard["email"] | spoken, "ip": F.col("t").rlike(r"[0-9](?:\x20?\.\x20?|[\[(]\.[\])]|\x20dot\x20)[0-9]"), "card": many, "phone": many}
    told = lambda k, m: F.struct(m["start"], m["kind"], m["end"], _code(k, m).alias("code"), F.coalesce(_fails(k, m), F.lit(True)).alias("fails"))
    guess = {k: F.transform(_found(F.col("t"), k, PROPOSE[k], hint[k]), partial(told, k)) for k in KINDS}
    spans = F.transform(F.concat(*base.values()), lambda m: F.struct(m["start"], m["kind"], m["end"]))
    apart = F.pmod(F.xxhash64("doc_id", "t"), F.lit(4)) == 3
    return t.select("row", "doc_id", apart.alias("rest"), F.array_sort(spans).alias("base"), F.concat(*guess.values()).alias("guess"))


def _touches(flag: Column, *by: str) -> Column:
    """Whether a span meets a span with `flag` of the same `by`: one that starts before and reaches into it, or the next to start."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max(F.when(flag, F.col("end"))).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(flag, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    return F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))


def candidates(scanned: DataFrame) -> DataFrame:
    """(row, start, kind, end, code, known, failed, taken, rest): each candidate; whether it is a positive or a negative example, meets any
    base span, and belongs to the documents for calibration."""
    none = F.transform("base", lambda b: F.struct(b["start"], b["kind"], b["end"], F.lit(None).cast("int").alias("code"), F.lit(False).alias("fails")))
    each = scanned.where(F.size("guess") > 0).select("row", "rest", F.explode(F.concat(none, "guess")).alias("s")).select("row", "rest", "s.*")
    is_base = F.col("code").isNull()
    met = each.select("*", _touches(is_base, "row").alias("taken"), _touches(is_base, "row", "kind").alias("known")).where(~is_base)
    failed = ~F.col("known") & (F.col("taken") | F.col("fails"))
    return met.select("row", "start", "kind", "end", "code", "known", failed.alias("failed"), "taken", "rest")


def boost(code: np.ndarray, total: np.ndarray, known: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> list[tuple[int, int, list[float]]]:
    """Trees (first bit, second bit, four leaves) by gradient boosting of the logistic loss on counted cells of weights."""
    bits = (code[:, None] >> np.arange(BITS)) & 1
    prior = np.log((known.sum() + 1) / (total.sum() - known.sum() + 1))
    score, trees = np.full(len(code), prior), [(0, 0, [prior, 0.0, 0.0, prior])]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = known - total * p, total * p * (1 - p)
        best = None
        for i in range(BITS):
            for j in range(i + 1, BITS):
                leaf = bits[:, i] * 2 + bits[:, j]
                gs, hs = np.bincount(leaf, g, 4), np.bincount(leaf, h, 4) + 1
                gain = (gs * gs / hs).sum()
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, i, j, leaf, gs / hs)
        _, i, j, leaf, values = best
        trees.append((i, j, [float(v) for v in rate * values]))
        score = score + rate * values[leaf]
    return trees


def _scored(trees, code: np.ndarray) -> np.ndarray:
    return sum(np.array(v)[((code >> i) & 1) * 2 + ((code >> j) & 1)] for i, j, v in trees)


def _likely(trees, code: np.ndarray, marked: float) -> np.ndarray:
    """The weight at which an open candidate counts as positive, if `marked` is the share of positives that are marked."""
    g = 1 / (1 + np.exp(-np.clip(_scored(trees, code), -30, 30)))
    return np.clip((1 - marked) / marked * g / (1 - g), 0, 1)


def fit(found: DataFrame, precision: float = PRECISION) -> dict[int, tuple[list, float, float]]:
    """Trees, threshold and precision on the documents kept for calibration of each kind, from counts of cells over all candidates."""
    count = lambda c: F.sum(c.cast("double"))
    cells = found.groupBy("kind", "code", "rest").agg(count(F.lit(1)).alias("n"), count(F.col("known")).alias("k"), count(~F.col("known") & ~F.col("failed")).alias("u")).collect()
    out = {}
    for kind in range(len(KINDS)):
        learn, check = (sorted((r.code, r.n, r.k, r.u) for r in cells if r.kind == kind and r.rest == rest) for rest in (False, True))
        if not any(r[2] for r in learn) or not any(r[2] for r in check):
            continue
        code, total, known, unmarked = (np.array(x, float if i else np.int64) for i, x in enumerate(zip(*learn, strict=True)))
        kept, kept_total, kept_known, kept_open = (np.array(x, float if i else np.int64) for i, x in enumerate(zip(*check, strict=True)))
        first = boost(code, total, known)
        # How often a positive is marked: what the trees say of base spans that they haven't seen.
        marked = float(((1 / (1 + np.exp(-_scored(first, kept)))) * kept_known).sum() / kept_known.sum())
        trees = boost(code, total, known + unmarked * _likely(first, code, marked))
        positive = kept_known + kept_open * _likely(first, kept, marked)
        score = _scored(trees, kept)
        # Cells with equal scores stand or fall together.
        levels, of = np.unique(-score, return_inverse=True)
        own, all_ = np.bincount(of, positive), np.bincount(of, kept_total)
        share = np.cumsum(own) / np.cumsum(all_)
        # A score at which most are no personal data ends the run, however good those above it are.
        good = np.flatnonzero((share >= precision) & np.logical_and.accumulate(2 * own >= all_))
        if len(good):
            out[kind] = (trees, float(-levels[good[-1]]) - 1e-9, float(share[good[-1]]))
    return out


def _accepted(models: dict[int, tuple[list, float, float]]) -> Column:
    """The trees' sum against the threshold of the candidate's kind, as one column."""
    bit = lambda i: F.col("code").bitwiseAND(1 << i) != 0
    leaf = lambda i, j, v: F.when(bit(i) & bit(j), v[3]).when(bit(i), v[2]).when(bit(j), v[1]).otherwise(v[0])
    any_kind = F.lit(False)
    for kind, (trees, threshold, _) in models.items():
        any_kind = any_kind | (F.col("kind") == kind) & (sum((leaf(*t) for t in trees), F.lit(0.0)) >= threshold)
    return any_kind


def added(found: DataFrame, models: dict[int, tuple[list, float, float]]) -> DataFrame:
    """(row, more): the open candidates that the models accept, without overlaps."""
    chosen = found.where(~F.col("taken") & ~F.col("failed") & _accepted(models)).select("row", "start", "kind", "end")
    for kind in sorted(models, key=lambda k: (-models[k][2], k))[:-1]:  # spans of a better kind displace those of all later ones
        better = F.col("kind") == kind
        chosen = chosen.select("*", _touches(better, "row").alias("beaten"), better.alias("better")).where(F.col("better") | ~F.col("beaten")).drop("better", "beaten")
    return chosen.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", precision: float = PRECISION) -> DataFrame:
    """For each row the base spans, and all spans with those that the method adds, as arrays of (start, kind, end)."""
    scanned = tx.cut(scan(docs, doc_id, text))
    found = tx.cut(candidates(scanned))
    models = fit(found, precision)
    if not models:
        return scanned.select("doc_id", "base", F.col("base").alias("spans"))
    more = added(found, models).withColumnRenamed("row", "r")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return scanned.join(more, F.col("row") == F.col("r"), "left").select("doc_id", "base", F.concat("base", F.coalesce("more", none)).alias("spans"))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter("base", partial(lambda k, s: s["kind"] == k, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


QUERIES = {"op7_pii": op7_pii}
ORACLES: dict[str, str] = {}
