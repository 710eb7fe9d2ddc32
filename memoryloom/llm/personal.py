"""Personal data by candidate gradient boosting, in DataFrame functions alone.

High-recall generators propose overlapping spans. On a bounded sample of documents, candidates get a label where evidence
that the trees don't see speaks for or against them (checksums, number ranges, words such as "token" before them, what
another generator's sure span covers); others stay unlabelled. Boosted trees, compiled to CASE expressions, learn the
labels from format and context and score all candidates; a threshold for each kind, calibrated on the sample's other
half, selects what is added to the base spans. So a card number with a wrong digit, an address with spelled signs or a
secret is found by its likeness to sure ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The generators' kinds: those of the base spans, and secrets (keys, tokens, passwords).
ALL_KINDS = (*KINDS, "secret")
#: The only bounds of the fit: about so many documents, by hash, and so many candidates of each, least hash first.
SAMPLE_DOCUMENTS, SAMPLE_EACH = 20_000, 8
ROUNDS, RATE = 24, 0.3
#: Added spans need this share of right ones among the candidates of their kind scored as high in the calibration half,
#: and so many labelled right there.
PRECISION, LEAST_RIGHT = 0.98, 5
#: Characters of context before a candidate, and of how many parts before it they may come: every second part is a match
#: of three characters or more.
CONTEXT, CONTEXT_PARTS = 16, 12
#: Values that a scan takes one after another; longer arrays are scanned in blocks, and the blocks' totals likewise.
_BLOCK = 256
#: Characters of a piece of a text that is cut at many places.
_PIECE = 1024

#: Private-use code points: a mark around matches, a joint (a separator between two characters that belong together),
#: and what stands for either where a text has them itself. None is in any pattern.
_MARK, _JOINT, _OTHER = "\ue000", "\ue001", "\ue002"
_LOCAL = rf"A-Za-z0-9._%+\-{_JOINT}"
#: Fixed patterns: (what becomes a joint first, the pattern then). Joints make a repeated group a plain character class,
#: so that long runs need no recursion; possessive classes and the look-behind keep long runs linear.
_BASE = {
    "email": (r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++{_JOINT}[A-Za-z0-9\-{_JOINT}]*+"),
    "ip": (None, r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"(?<=[0-9])[\x20-](?=[0-9])", rf"[0-9][0-9{_JOINT}]++"),
    "phone": (None, r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Generators: looser patterns of the same kinds.
_LOOSE = {
    "email": (None, r"(?<![^\s@,;<>()\[\]\"'])[^\s@,;<>()\[\]\"']++(?:@|\s?[(\[]at[)\]]\s?)[^\s@,;<>()\[\]\"']++(?:\s?[(\[]dot[)\]]\s?[A-Za-z0-9-]++)?"),
    "ip": (None, r"[0-9]++[.,:][0-9]++[.,:][0-9]++[.,:][0-9]++|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": (r"(?<=[0-9])[\x20./-](?=[0-9])", rf"[0-9][0-9{_JOINT}]{{11,}}+"),
    "phone": (None, r"[+(]?[0-9][\x20()./0-9-]{6,}[0-9]"),
    "secret": (None, r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+"),
}
_SPAN = "struct<start:int,end:int,body:string,before:string,after:string>"
#: What the trees see: format and neighbours, and none of the evidence that labels are made of.
FEATURES = ("kind", "length", "digits", "letters", "others", "plus", "capitals", "groups", "longest", "before", "after")
_HINTS = {
    "secret": r"(token|key|secret|passw(or)?d|pwd|api|auth|bearer|credential)[^a-z0-9]{0,5}$",
    "number": r"(version|licen[cs]e|v|section|chapter|page|no)[^a-z0-9]{0,3}$",
}


def _present(kind: str, text: Column) -> Column:
    """A cheap test that holds wherever the kind can occur."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "loose email":
        return F.contains(text, F.lit("@")) | text.rlike(r"[(\[]at[)\]]")
    return text.rlike("[0-9]")


def _let(x: Column, f) -> Column:
    """f of x, which is evaluated once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _last(x: Column) -> Column:
    return F.get(x, F.size(x) - 1)


def _scan(values: Column, join, levels: int = 1) -> Column:
    """array<int>: for each value, what join (a sum or a maximum) makes of it and all before it.

    An array that grows is copied for each value, so only blocks grow that way, and the last of levels of their totals.
    """
    plain = lambda x: F.aggregate(x, F.array().cast("array<int>"), lambda s, v: F.concat(s, F.array(F.coalesce(join(_last(s), v), v))))
    if levels == 0:
        return plain(values)

    def placed(blocks: Column) -> Column:
        moved = lambda t: F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda v: join(F.get(t, i - 1), v))))
        return _let(_scan(F.transform(blocks, _last), join, levels - 1), lambda t: F.flatten(moved(t)))

    def blocked(x: Column) -> Column:
        count = F.ceil(F.size(x) / _BLOCK).cast("int")
        return _let(F.transform(F.sequence(F.lit(0), count - 1), lambda i: plain(F.slice(x, i * _BLOCK + 1, F.lit(_BLOCK)))), placed)

    return _let(values, lambda x: F.when(F.size(x) <= _BLOCK, plain(x)).otherwise(blocked(x)))


def _sums(x: Column) -> Column:
    return _scan(x, lambda a, b: a + b)


def _maxima(x: Column) -> Column:
    return _scan(x, F.greatest)


def _matches(kind: str, text: Column, joint: str | None, pattern: str, context: bool = False) -> Column:
    """array<start, end, body, before, after> of the leftmost, non-overlapping matches, in code points; body with joints.
    before and after, the neighbouring characters, are null without context."""
    joined = text if joint is None else F.regexp_replace(text, joint, _JOINT)
    parts = F.split(F.regexp_replace(joined, pattern, f"{_MARK}$0{_MARK}"), _MARK)  # every second part is a match
    none, empty = F.lit(None).cast("string"), F.array().cast(f"array<{_SPAN}>")

    def spans(p: Column) -> Column:
        def found(ends: Column, tails: Column | None = None, heads: Column | None = None) -> Column:
            def span(i: Column) -> Column:
                before = after = none
                if context:
                    before = F.substring(F.concat_ws("", F.slice(tails, F.greatest(i - CONTEXT_PARTS, F.lit(0)) + 1, F.least(i, F.lit(CONTEXT_PARTS)))), -CONTEXT, CONTEXT)
                    after = F.substring(F.concat(F.get(heads, i + 1), F.coalesce(F.get(heads, i + 2), F.lit(""))), 1, 1)
                end, body = F.get(ends, i), F.get(p, i)
                return F.struct((end - F.length(body)).alias("start"), end.alias("end"), body.alias("body"), before.alias("before"), after.alias("after")).cast(_SPAN)

            return F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), span)

        ends = _sums(F.transform(p, F.length))
        if not context:
            return _let(ends, lambda e: found(e))
        edges = lambda at, n: F.transform(p, lambda x: F.substring(x, at, n))
        return _let(ends, lambda e: _let(edges(-CONTEXT, CONTEXT), lambda t: _let(edges(1, 1), lambda h: found(e, t, h))))

    some = _let(parts, lambda p: F.when(F.size(p) > 2, spans(p)).otherwise(empty))
    return F.when(_present("loose email" if (joint, pattern) == _LOOSE["email"] else kind, text), some).otherwise(empty)


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _valid(kind: str, body: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(body, r"\."), lambda x: F.coalesce(x.try_cast("bigint") <= 255, F.lit(False)))
    n = F.length(_digits(body))
    if kind == "card":
        return n.between(16, 19) & F.call_function("luhn_check", _digits(body))
    return n.between(8, 15)


def with_base(df: DataFrame, text: str) -> DataFrame:
    """df with _text (no null, no private marks) and the base spans of each kind, _email to _phone."""
    raw = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_text", F.when(raw.rlike(f"[{_MARK}{_JOINT}]"), F.translate(raw, _MARK + _JOINT, _OTHER * 2)).otherwise(raw))
    kept = lambda k: F.filter(_matches(k, F.col("_text"), *_BASE[k]), lambda s: _valid(k, s["body"]))
    return out.withColumns({f"_{k}": kept(k) for k in KINDS})


def _candidate(kind: str, s: Column) -> Column:
    """A candidate's place, its features, and what context says: word for a secret before it, word for a plain number."""
    body, size = s["body"], F.length(s["body"])
    digits = _digits(body)
    before, after = s["before"], s["after"]
    edge = lambda c: F.when(c == "", 0).when(c.rlike(r"^[\s\"'(\[<,;:]$"), 1).when(c.rlike("^[A-Za-z]$"), 2).when(c.rlike("^[0-9]$"), 3).when(c.rlike("^[.!?)]$"), 4).otherwise(5)
    groups = F.filter(F.split(body, "[^0-9A-Za-z]+"), lambda x: x != "")
    values = {
        "kind": F.lit(ALL_KINDS.index(kind)), "length": size, "digits": F.length(digits), "letters": F.length(F.regexp_replace(body, "[^A-Za-z]", "")),
        "others": F.length(F.regexp_replace(body, "[A-Za-z0-9]", "")), "plus": body.startswith("+").cast("int"), "capitals": F.length(F.regexp_replace(body, "[^A-Z]", "")),
        "groups": F.size(groups), "longest": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), "before": edge(F.substring(before, -1, 1)), "after": edge(after),
    }
    hint = F.when(F.lower(before).rlike(_HINTS["secret"]), 1).when(F.lower(before).rlike(_HINTS["number"]), -1).otherwise(0)
    return F.struct(F.lit(kind).alias("kind_name"), s["start"].alias("start"), s["end"].alias("end"), body.alias("body"), hint.alias("hint"), *[v.cast("double").alias(f) for f, v in values.items()])


def with_candidates(df: DataFrame) -> DataFrame:
    """with_base's output plus _loose: overlapping candidate spans with features."""
    out = df.withColumns({f"_loose_{k}": _matches(k, F.col("_text"), *_LOOSE[k], context=True) for k in ALL_KINDS})
    each = lambda k: F.transform(f"_loose_{k}", lambda s: _candidate(k, s))
    return out.withColumn("_loose", F.concat(*map(each, ALL_KINDS))).drop(*(f"_loose_{k}" for k in ALL_KINDS))


def label(c: Column, base: Column) -> Column:
    """1: surely personal data; 0: surely not; null: neither. base: array of the document's base spans, named.

    Sure are base spans (which pass checksums and ranges) and mixed strings after a word for a secret. Sure not to be of
    their kind are candidates that a base span of another kind covers, numbers that are too short, too long or out of
    range, numbers after a word such as "version", addresses without a domain, and plain words.
    """
    kind, digits = c["kind_name"], c["digits"]
    named = F.concat_ws(":", kind, c["start"], c["end"])
    covered = F.exists(base, lambda b: (b["kind"] != kind) & (b["start"] <= c["start"]) & (c["end"] <= b["end"]))
    parts = F.transform(F.split(c["body"], "[.,:]"), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(-1)))
    right = F.exists(base, lambda b: F.concat_ws(":", b["kind"], b["start"], b["end"]) == named)
    right = right | ((kind == "secret") & (c["hint"] == 1) & (digits >= 4) & (c["letters"] >= 4))
    wrong = covered | (c["hint"] == -1)
    wrong = wrong | ((kind == "email") & (~c["body"].rlike(r"[.]|dot") | (c["letters"] == 0)))
    wrong = wrong | ((kind == "ip") & (c["letters"] == 0) & F.exists(parts, lambda x: x > 255))
    wrong = wrong | ((kind == "card") & ~digits.between(13, 19)) | ((kind == "phone") & ~digits.between(7, 15))
    wrong = wrong | ((kind == "secret") & ((digits == 0) | (c["letters"] == 0)))
    return F.when(right, 1).when(wrong, 0)


@dataclass(frozen=True)
class Boosted:
    """Trees of two levels: (feature, cut, (feature, cut, low, high) below, the same above); a bias; and a threshold for
    each of ALL_KINDS (over 1: nothing of it is added)."""

    bias: float
    trees: tuple
    thresholds: tuple[float, ...] = (2.0,) * len(ALL_KINDS)

    def column(self, c: Column) -> Column:
        total = F.lit(self.bias)
        for f, cut, low, high in self.trees:
            side = lambda b: F.when(c[FEATURES[b[0]]] <= b[1], b[2]).otherwise(b[3])
            total = total + F.when(c[FEATURES[f]] <= cut, side(low)).otherwise(side(high))
        return 1 / (1 + F.exp(-total))

    def threshold(self, c: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.thresholds)), c["kind"].cast("int"))

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for f, cut, low, high in self.trees:
            total += np.where(x[:, f] <= cut, *(np.where(x[:, b[0]] <= b[1], b[2], b[3]) for b in (low, high)))
        return 1 / (1 + np.exp(-total))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """The feature and cut of the largest gain."""
    best, place = -1.0, (0, np.inf)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        ends = np.flatnonzero(v[1:] > v[:-1])
        if len(ends):
            gain = gs[ends] ** 2 / (hs[ends] + 1) + (gs[-1] - gs[ends]) ** 2 / (hs[-1] - hs[ends] + 1)
            if gain.max() > best:
                best, at = gain.max(), ends[gain.argmax()]
                place = f, float((v[at] + v[at + 1]) / 2)
    return place


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Gradient boosting on the even rows; each kind's threshold is calibrated on its odd ones."""
    a, ya, b, yb = x[::2], y[::2], x[1::2], y[1::2]
    share = np.clip(ya.mean(), 0.01, 0.99)
    model = Boosted(float(np.log(share / (1 - share))), ())
    for _ in range(ROUNDS):
        p = model.scores(a)
        g, h = ya - p, p * (1 - p) + 1e-6
        f, cut = _split(a, g, h)
        sides = []
        for rows in (a[:, f] <= cut, a[:, f] > cut):
            k, c = _split(a[rows], g[rows], h[rows]) if rows.any() else (0, np.inf)
            low = a[:, k] <= c
            sides.append((k, min(c, 1e18), *(float(RATE * g[rows & m].sum() / (h[rows & m].sum() + 1)) for m in (low, ~low))))
        model = Boosted(model.bias, (*model.trees, (f, min(cut, 1e18), *sides)))
    scores, thresholds = model.scores(b), []
    for k in range(len(ALL_KINDS)):
        s, right = scores[b[:, 0] == k], yb[b[:, 0] == k]
        best = 2.0
        for t in np.unique(s)[::-1]:
            if t < 0.5 or right[s >= t].mean() < PRECISION:
                break
            if right[s >= t].sum() >= LEAST_RIGHT:
                best = float(t)
        thresholds.append(best)
    return Boosted(model.bias, model.trees, tuple(thresholds))


def sample(docs: DataFrame, text: str = "text", key: str | None = "doc_id") -> DataFrame:
    """(y, features) of the labelled candidates of about SAMPLE_DOCUMENTS documents; one row of equal ones is taken."""
    n = docs.count()
    ready = docs.select((F.xxhash64(*[F.col(c) for c in (key, text) if c])).alias("_h"), F.col(text).alias("_raw"))
    if n > SAMPLE_DOCUMENTS:
        ready = ready.filter(F.pmod("_h", F.lit(1 << 40)) < int((1 << 40) * SAMPLE_DOCUMENTS / n))
    found = with_candidates(with_base(ready.dropDuplicates(["_h"]), "_raw")).withColumn("_base", _tagged())
    some = F.slice(F.array_sort(F.transform("_loose", lambda c: F.struct(F.xxhash64("_h", c["kind_name"], c["start"], c["end"]).alias("h"), c.alias("c")))), 1, SAMPLE_EACH)
    rows = found.filter(F.size("_loose") > 0).select("_base", F.explode(some).alias("x"))
    return rows.select(F.col("x.h").alias("_h"), label(F.col("x.c"), F.col("_base")).alias("y"), *[F.col(f"x.c.{f}").alias(f) for f in FEATURES]).filter("y is not null")


def fit(docs: DataFrame, text: str = "text", key: str | None = "doc_id") -> Boosted | None:
    """Fit on sample(). None where labelled candidates are too few or all of one sort: nothing is added to the base."""
    rows = sorted(sample(docs, text, key).collect())
    y = np.array([r["y"] for r in rows], float)
    if len(y) < 40 or y.min() == y.max():
        return None
    return boost(np.array([[r[f] for f in FEATURES] for r in rows], float), y)


def _tagged() -> Column:
    """The base spans, by kind and then start: array of (rank, start, end, kind)."""
    tagged = lambda k: F.transform(f"_{k}", lambda s: F.struct(F.lit(ALL_KINDS.index(k)).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind")))
    return F.concat(*map(tagged, KINDS))


def _with_clear(df: DataFrame) -> DataFrame:
    """df whose _loose are the candidates that overlap no base span, by two scans over both in order of start: none of the
    base spans that start before a candidate, or with it, ends in it or after it, and the next starts where it has ended."""
    rows = F.concat(F.transform("_base", lambda b: F.struct(b["start"].alias("start"), F.lit(-1).alias("at"), b["end"].alias("end"))), F.transform("_loose", lambda c, i: F.struct(c["start"].alias("start"), i.alias("at"), c["end"].alias("end"))))
    df = df.withColumn("_r", F.when((F.size("_loose") > 0) & (F.size("_base") > 0), F.array_sort(rows)))
    ends = _maxima(F.transform("_r", lambda x: F.when(x["at"] < 0, x["end"]).otherwise(-1)))
    starts = _maxima(F.transform(F.reverse("_r"), lambda x: F.when(x["at"] < 0, -x["start"]).otherwise(-(2**31) + 1)))
    df = df.withColumns({"_e": ends, "_s": starts})
    hit = lambda v, x, i: (x["at"] >= 0) & ((F.get(v["_e"], i) > x["start"]) | (-F.get(v["_s"], F.size(v["_r"]) - 1 - i) < x["end"]))
    df = df.withColumn("_hit", _let(F.struct("_r", "_e", "_s"), lambda v: F.transform(v["_r"], lambda x, i: F.when(hit(v, x, i), x["at"]).otherwise(-1))))
    free = F.array_except(F.sequence(F.lit(0), F.size("_loose") - 1), "_hit")
    left = _let(F.col("_loose"), lambda c: F.transform(free, lambda i: F.get(c, i)))
    return df.withColumn("_loose", F.when(F.col("_r").isNull(), F.col("_loose")).otherwise(left)).drop("_r", "_e", "_s", "_hit")


def _with_best(df: DataFrame) -> DataFrame:
    """df with those of _chosen that overlap none that sorts before them (better score, then kind and start).

    Spans of one kind don't overlap, so of each kind only the last that starts before a span, or with it, can reach into
    it; a pair that overlaps is met at its later span, and the worse of the two falls.
    """
    last = [f"_k{k}" for k in range(len(ALL_KINDS))]
    ordered = F.array_sort(F.transform("_chosen", lambda x: F.struct(x["start"].alias("start"), x.alias("c"))))
    df = df.withColumn("_r", F.when(F.size("_chosen") > 1, ordered))
    of_kind = lambda k: F.transform("_r", lambda x, i: F.when(x["c"]["rank"] == k, i).otherwise(-1))
    df = df.withColumns({c: _maxima(of_kind(k)) for k, c in enumerate(last)})

    def worse(v: Column, x: Column, i: Column, k: int) -> Column:
        p = F.get(v[last[k]], i)
        y = F.get(v["_r"], p)
        return F.when((p >= 0) & (x["c"]["rank"] != k) & (y["c"]["end"] > x["start"]), F.when(y["c"] < x["c"], i).otherwise(p)).otherwise(-1)

    df = df.withColumn("_fallen", F.flatten(_let(F.struct("_r", *last), lambda v: F.transform(v["_r"], lambda x, i: F.array(*[worse(v, x, i, k) for k in range(len(last))])))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_r") - 1), "_fallen")
    left = _let(F.col("_r"), lambda r: F.transform(kept, lambda i: F.get(r, i)["c"]))
    return df.withColumn("_chosen", F.when(F.col("_r").isNull(), F.col("_chosen")).otherwise(left)).drop("_r", "_fallen", *last)


def find(docs: DataFrame, model: Boosted | None, text: str = "text") -> DataFrame:
    """docs with last columns _email to _phone (base spans) and _all: every span (rank of the kind, start, end, kind).

    Base spans always stay; of the candidates that overlap no base span, those are added that the model scores at or
    over their kind's threshold; of overlapping ones, the one whose score is highest (ties: the least kind, then start).
    """
    names = docs.columns
    out = with_base(docs, text).withColumn("_base", _tagged())
    if model is None or min(model.thresholds) > 1:
        out = out.withColumn("_all", F.array_sort("_base"))
    else:
        out = with_candidates(out)
        out = _with_clear(out)
        scored = F.transform("_loose", lambda c: F.struct((-model.column(c)).alias("s"), c["kind"].cast("int").alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind_name"].alias("kind"), model.threshold(c).alias("t")))
        out = _with_best(out.withColumn("_chosen", F.filter(scored, lambda c: -c["s"] >= c["t"])))
        added = F.transform("_chosen", lambda c: F.struct(c["rank"].alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
        out = out.withColumn("_all", F.array_sort(F.concat("_base", added)))
    return out.select(*names, *(f"_{k}" for k in KINDS), "_all")


def _listed(spans: str | Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def spans_digest(docs: DataFrame) -> DataFrame:
    """Per row of docs the counts of the base spans, their digest, all spans, and how many of them the method added.

    Null texts count as empty; rows without spans have zeros, the digest of nothing and an empty string. Repeated rows
    get the same spans, and an empty table an empty result. The work on a text grows with its length and its spans. Of equally good overlapping candidates the one of the least
    kind, then start, is added. Other columns are not read.
    """
    rows = docs.select("doc_id", "text")
    found = find(rows, fit(rows))
    placed = lambda k: F.transform(f"_{k}", lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = F.concat(*map(placed, KINDS))
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    added = (F.size("_all") - sum(F.size(f"_{k}") for k in KINDS)).cast("long")
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed("_all").alias("spans"), added.alias("n_added"), F.size("_all").cast("long").alias("n_spans"))


def redact(docs: DataFrame, text: str = "text", key: str | None = "doc_id") -> DataFrame:
    """docs with every span of its texts replaced by its kind, as in [EMAIL]; overlapping spans become one.

    Texts without spans, and null texts, are unchanged. key (None: only the text) tells rows apart in the fit's sample.
    """
    packed = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_raw"))
    found = find(packed, fit(docs, text, key), "_raw")
    ordered = F.array_sort(F.transform("_all", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("_e"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cut(pieces: Column, a: Column, b: Column | None = None) -> Column:
        """The characters from a to b (none: to the end); only the pieces that have some of them are looked at."""
        first = F.floor(a / _PIECE).cast("int")
        if b is None:
            return F.substring(F.concat_ws("", F.slice(pieces, first + 1, F.size(pieces))), a - first * _PIECE + 1, F.length("_raw"))
        return F.substring(F.concat_ws("", F.slice(pieces, first + 1, F.floor(b / _PIECE).cast("int") - first + 1)), a - first * _PIECE + 1, b - a)

    def rebuilt(pieces: Column, spans: Column, ends: Column) -> Column:
        def put(x: Column, i: Column) -> Column:
            at = F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
            return F.when(x["start"] >= at, F.concat(cut(pieces, at, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")

        return F.concat(F.concat_ws("", F.transform(spans, put)), cut(pieces, _last(ends)))

    pieces = F.regexp_extract_all("_raw", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    clean = _let(pieces, lambda p: _let(ordered, lambda o: _let(_maxima(F.transform(o, lambda x: x["end"])), lambda e: rebuilt(p, o, e))))
    clean = F.when(F.size("_all") > 0, clean).otherwise(F.col("_raw"))
    return found.select(*[clean.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])
