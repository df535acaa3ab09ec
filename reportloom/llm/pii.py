"""Personal data by candidate gradient boosting, in DataFrame functions only.

1. Four base patterns are matched leftmost and without overlaps, and checked (octets, Luhn, digit counts). What
   passes is personal data; what fails is dropped, but is learned from.
2. High-recall generators propose further, possibly overlapping spans: spelled-out addresses (a domain of up to
   LABELS labels), addresses without a dotted domain, IPv6, card numbers in other groups that pass Luhn, national
   and international telephone numbers that the base pattern runs beyond, and secrets given to a name.
3. Boosted trees score candidates by format and context features; the outcome of a check is none of them. They
   learn from the base patterns' matches, what passed its check against what failed, and from secrets, where values
   of letters and digits count as right. Equal features are counted together in cells, and every cell of every
   document is fitted: on the driver up to DRIVER_CELLS cells, beyond that by sums over the table of cells.
4. For the thresholds the documents are dealt to FOLDS parts, by a hash of the text, and each part is scored by trees of
   the other parts (of its own where no other has any). For each kind, the least score from which PRECISION of all
   documents' candidates are right is the threshold, 0.5 at least; a kind with one outcome only has the threshold
   over all kinds, and 0.5 where these have one outcome only. Generated candidates above it, as the trees of all
   documents score them, that overlap no base span are added; of a run of overlapping ones the best stays.

The trees become CASE expressions, so training counts, scores and selection all run as plain expressions. The
patterns are written so that neither long runs nor deep nesting make the matcher back up or recurse. Places come from
running sums over what lies between matches, and overlaps from running maxima, so that the work for a text
grows little faster than its length, however many matches it has. A pattern runs where a cheap sign of it is seen.

Edge cases: a null text counts as empty and has no spans. Repeated rows are treated alike. Without base
matches nothing is added. An empty table gives an empty result. Input columns with the names of added ones
are replaced, others stay. Places are code points from 0, ends exclusive. U+0001 is treated as U+0002 is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.functions.text import bound, cut, marked, scan
from reportloom.functions.text import blocks as in_blocks
from reportloom.llm import boosting
from reportloom.llm.runtime import cleared, discard, materialize, sums_before

KINDS = ["email", "ip", "card", "phone"]
# Found by generators only, and kept apart from the spans of KINDS.
SECRET = len(KINDS)
# Stands for all kinds together.
ALL = -1
# Up to so many combinations of features are fitted on the driver.
DRIVER_CELLS = 200_000
TREES = {"trees": 20, "depth": 3, "least": 2.0}
PRECISION = 0.95
CONTEXT = 24
FEATURES = 11
LABELS = 8
# Parts of the documents, each scored by trees of the others.
FOLDS = 4

# Each matches what the pattern beside it does, leftmost, in linear time: a run's later starts are skipped unless
# the match before ended there (\G), and runs of groups are one class that ends before the first misfit.
BASE = [
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9.-]+?(?=\z|[^A-Za-z0-9.-]|\.(?:\z|[^A-Za-z0-9-]))",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]+?(?=\z|[^0-9\x20-]|[\x20-](?:\z|[^0-9]))",
    # \+[0-9][\x20().0-9-]+[0-9]
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
# What a text must have for a base pattern to find something that may pass.
SIGNS = ["@", r"[0-9]\.[0-9]", r"(?:[0-9][\x20-]?){11}[0-9]", r"\+[0-9]"]
_AT, _DOT = r"\x20?(?:\(at\)|\[at\]|\{at\}|\x20AT\x20)\x20?", r"\x20?(?:\.|\(dot\)|\[dot\]|\{dot\}|\x20DOT\x20)\x20?"
_HEX = "[0-9A-Fa-f]{1,4}"
_NAMES = r"(?:token|secret|passwd|password|pwd|apikey|key)"
# kind, sign, pattern
GENERATORS = [
    (0, r"[(\[{](?:at|dot)[)\]}]|\x20(?:AT|DOT)\x20", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:{_AT}|@)[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++){{0,{LABELS - 2}}}{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9-])"),
    (0, "@", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?![A-Za-z0-9.-])"),
    (1, "[0-9A-Fa-f]:[0-9A-Fa-f:]", rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:])"),
    (2, "[0-9]{4}[./_][0-9]{4}[./_]", r"(?<![0-9./_])[0-9]{4}[./_][0-9]{4}[./_][0-9]{4}[./_][0-9]{1,7}(?![0-9])"),
    (3, r"[0-9][\x20)./-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3}", r"(?<![0-9+-])(?<![0-9][\x20.-])(?:00[0-9]{1,3}[\x20.-])?\(?0?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9-])(?![\x20.][0-9])"),
    (3, r"\+[0-9]", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])"),
    (SECRET, r"[:=]\x20?[\x22']?[A-Za-z0-9+/_.~=-]{16}", rf"(?i)(?<![A-Za-z0-9])(?:[a-z0-9]++[_-]){{0,4}}+{_NAMES}[\x22']?\x20?[:=]\x20?[\x22']?[A-Za-z0-9+/_.~=-]{{16,}}+"),
]
WORDS = [r"(?i)mail|contact|write", r"(?i)\bip\b|host|server|addr", r"(?i)card|visa|credit|payment|konto", r"(?i)tel|phone|call|fax|mobil|handy", "(?i)export|env|config"]

_FOUND = "array<struct<s:int,e:int,m:string,before:string,after:string>>"


def places(text: Column, pattern: str, sign: str) -> Column:
    """array(struct(s, e, m, before, after)): where the pattern's leftmost matches are, what they are, and what stands
    around: up to CONTEXT characters since the match before, and the character after. None where the sign is not seen."""

    def each(parts: Column) -> Column:
        def one(ends: Column):
            return lambda i: F.struct(
                F.get(ends, 2 * i).alias("s"),
                F.get(ends, 2 * i + 1).alias("e"),
                F.get(parts, 2 * i + 1).alias("m"),
                F.right(F.get(parts, 2 * i), F.lit(CONTEXT)).alias("before"),
                F.left(F.get(parts, 2 * i + 2), F.lit(1)).alias("after"),
            )

        last = F.floor(F.size(parts) / 2).cast("int") - 1
        found = bound(scan(F.transform(parts, F.length), lambda a, b: a + b), lambda ends: F.transform(F.sequence(F.lit(0), last), one(ends)))
        return F.when(F.size(parts) > 1, found).otherwise(F.array().cast(_FOUND))

    return F.when(text.rlike(sign), bound(marked(text, pattern), each)).otherwise(F.array().cast(_FOUND))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def small_octets(m: Column) -> Column:
    return F.forall(F.split(m, "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def passes(kind: int, m: Column) -> Column:
    """Does a base match of this kind pass its check?"""
    n = F.length(digits(m))
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return small_octets(m)
    if kind == 2:
        return n.between(12, 19) & F.call_function("luhn_check", digits(m))
    return n.between(9, 15)


def features(c: Column) -> list[Column]:
    """Whole numbers about a candidate c: its kind, format and context."""
    m, kind = c["m"], c["kind"]
    groups = F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), 0), F.length)

    def side(x: Column) -> Column:
        return F.when((x == "") | x.rlike(r"^\s$"), 0).when(x.rlike("^[A-Za-z0-9]$"), 1).when(x.rlike("^[,.;:!?)\"']$"), 2).otherwise(3)

    word = F.coalesce(F.element_at(F.array(*[c["before"].rlike(w) for w in WORDS]), kind + 1), F.lit(False))
    return [
        kind,
        F.least(F.length(digits(m)), F.lit(20)),
        F.least(F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), F.lit(8)),
        F.least(F.length(F.regexp_replace(m, "[^A-Za-z]", "")), F.lit(12)),
        F.least(F.size(groups), F.lit(8)),
        F.least(F.coalesce(F.array_max(groups), F.lit(0)), F.lit(8)),
        F.when(m.startswith("+"), 1).when(m.startswith("("), 2).when(m.rlike("^[0-9]"), 0).otherwise(3),
        side(F.right(c["before"], F.lit(1))),
        side(c["after"]),
        m.rlike(r"(?:\.|\(dot\)|\[dot\]|\{dot\}|\x20DOT\x20)\x20?[A-Za-z]{2,}\z").cast("int"),
        word.cast("int"),
    ]


def _label(kind: int, m: Column) -> Column:
    """Is a generator's span right? Null where nothing tells."""
    if kind == 0:
        # an address without a dotted domain is what a wrong one looks like
        return F.when(m.rlike(r"@[A-Za-z0-9-]+\z"), False)
    if kind == SECRET:
        value = F.regexp_extract(m, r"[A-Za-z0-9+/_.~=-]{16,}\z", 0)
        return value.rlike("[A-Za-z]") & value.rlike("[0-9]")
    return F.lit(None).cast("boolean")


def _candidates(text: Column) -> Column:
    """array(struct(s, e, kind, m, ok, base, before, after)); ok is null for the generators' spans that teach nothing."""

    def shaped(found: Column, kind: int, ok, base: bool) -> Column:
        return F.transform(found, lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e"), F.lit(kind).alias("kind"), p["m"].alias("m"), ok(p["m"]).alias("ok"), F.lit(base).alias("base"), p["before"].alias("before"), p["after"].alias("after")))

    def all_of(t: Column) -> Column:
        lists = [shaped(places(t, pattern, SIGNS[k]), k, lambda m, k=k: passes(k, m), True) for k, pattern in enumerate(BASE)]
        for kind, sign, pattern in GENERATORS:
            found = places(t, pattern, sign)
            if kind == 2:
                found = F.filter(found, lambda p: passes(2, p["m"]))
            lists.append(shaped(found, kind, lambda m, kind=kind: _label(kind, m), False))
        return F.concat(*lists)

    return bound(F.translate(text, "\u0001", "\u0002"), all_of)


def listed(spans: Column) -> Column:
    """kind:start:end of struct(s, kind, e), comma-joined."""
    names = F.array(*map(F.lit, [*KINDS, "secret"]))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _train(rows: DataFrame) -> tuple[tuple[float, list], list[float]]:
    """The trees, and the threshold of each kind (above 1 where none is precise enough)."""
    one = rows.select("__part", F.explode("__found").alias("c")).filter("c.ok is not null")
    names = [f"f{k}" for k in range(FEATURES)]
    cells = one.select("__part", *[c.alias(n) for c, n in zip(features(F.col("c")), names, strict=True)], F.col("c.ok").alias("ok"))
    counts = lambda ok: F.array(*[F.count_if(ok & (F.col("__part") == k)) for k in range(FOLDS)])
    cells = materialize(cells.groupBy(*names).agg(counts(F.col("ok")).alias("yes"), counts(~F.col("ok")).alias("no")), "cells")
    n, *sizes = cells.agg(F.count(F.lit(1)), *[F.sum(F.get("yes", F.lit(k)) + F.get("no", F.lit(k))) for k in range(FOLDS)]).first()
    if not n:
        return (0.0, []), [2.0] * (SECRET + 1)
    full = [k for k in range(FOLDS) if sizes[k]]
    # without each part in turn (with it, where no other has any), and at last of all parts
    parts = [[j for j in full if j != k] or full for k in range(FOLDS)] + [full]
    models, seen = (_on_driver if n <= DRIVER_CELLS else _over_table)(cells, names, parts)
    discard(cells)

    def threshold(kind: int, other: float) -> float:
        yes, no, least = seen.get(kind, (0, 0, None))
        # a threshold is known only where both outcomes were seen
        if not (yes and no):
            return other
        return 2.0 if least is None else max(0.5, least - 1e-9)

    overall = threshold(ALL, 0.5)
    return models[-1], [threshold(k, overall) for k in range(SECRET + 1)]


def _on_driver(cells: DataFrame, names: list[str], parts: list[list[int]]) -> tuple[list, dict]:
    """The trees of each list of parts, and by kind, and for ALL: how many are right, how many wrong, and the least score
    from which PRECISION are right, each part scored by the trees without it."""
    table = cells.toArrow()  # at most DRIVER_CELLS rows
    x = np.column_stack([table.column(n).to_numpy() for n in names]).astype(np.int16)
    order = np.lexsort(x.T[::-1])
    x = x[order]
    yes, no = (table.column(c).combine_chunks().flatten().to_numpy().reshape(-1, FOLDS)[order].astype(np.float64) for c in ("yes", "no"))
    models = []
    for own in parts:
        right, wrong = yes[:, own].sum(axis=1), no[:, own].sum(axis=1)
        use = right + wrong > 0
        models.append(boosting.fit(x[use], right[use], wrong[use], **TREES))
    score = np.concatenate([boosting.predict(models[k], x) for k in range(FOLDS)])
    kinds, yes, no = np.tile(x[:, 0], FOLDS), yes.T.ravel(), no.T.ravel()
    seen = {}
    for kind in [ALL, *range(SECRET + 1)]:
        own = np.flatnonzero((yes + no > 0) & ((kinds == kind) | (kind == ALL)))
        own = own[np.argsort(-score[own], kind="stable")]
        right, all_ = np.cumsum(yes[own]), np.cumsum(yes[own] + no[own])
        # only between different scores
        good = own[(right >= PRECISION * all_) & np.append(score[own][1:] < score[own][:-1], True)]
        seen[kind] = yes[own].sum(), no[own].sum(), float(score[good].min()) if len(good) else None
    return models, seen


def _over_table(cells: DataFrame, names: list[str], parts: list[list[int]]) -> tuple[list, dict]:
    """The same where the cells are too many for the driver."""
    count = lambda c, own: sum((F.get(c, F.lit(k)) for k in own[1:]), F.get(c, F.lit(own[0])))
    models = boosting.fit_table(cells, names, [count("yes", own) for own in parts], [count("no", own) for own in parts], **TREES)
    columns = [F.col(n) for n in names]
    scored = [F.struct(boosting.as_column(models[k], columns).alias("score"), count("yes", [k]).alias("yes"), count("no", [k]).alias("no")) for k in range(FOLDS)]
    scores = cells.select(columns[0].alias("own"), F.explode(F.array(*scored)).alias("s")).select(F.explode(F.array("own", F.lit(ALL))).alias("kind"), "s.*")
    scores = scores.filter("yes + no > 0").groupBy("kind", "score").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    scores = materialize(scores, "scores")
    totals = {r["kind"]: (r["yes"], r["no"]) for r in scores.groupBy("kind").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()}

    def of_kinds_before(k: int) -> Column:
        sums = [(kind, sum(t[k] for other, t in totals.items() if other < kind)) for kind in totals]
        return F.element_at(F.create_map(*[F.lit(v) for pair in sums for v in pair]), F.col("kind"))

    # the sums run through the kinds one after the other
    summed = sums_before(scores, [F.col("kind"), F.col("score").desc()], {"right": F.col("yes"), "wrong": F.col("no")})
    right, wrong = F.col("right") + F.col("yes") - of_kinds_before(0), F.col("wrong") + F.col("no") - of_kinds_before(1)
    least = {r["kind"]: r["least"] for r in summed.filter(right >= PRECISION * (right + wrong)).groupBy("kind").agg(F.min("score").alias("least")).collect()}
    discard(scores)
    return models, {kind: (*t, least.get(kind)) for kind, t in totals.items()}


def _apart(base: Column, scored: Column) -> Column:
    """array(struct(s, kind, e)): the scored candidates that overlap no base span, of a run of overlapping ones the best."""
    one = lambda c, own, score: F.struct(c["s"].alias("s"), F.lit(own).alias("own"), c["e"].alias("e"), c["kind"].alias("kind"), score.alias("score"))
    both = F.array_sort(F.concat(F.transform(base, lambda b: one(b, 0, F.lit(0.0))), F.transform(scored, lambda c: one(c, 1, c["score"]))))
    far = 2**31 - 1

    def free(x: Column) -> Column:
        ends = scan(F.transform(x, lambda c: F.when(c["own"] == 0, c["e"]).otherwise(-1)), F.greatest)
        starts = F.reverse(scan(F.reverse(F.transform(x, lambda c: F.when(c["own"] == 0, c["s"]).otherwise(far))), F.least))
        alone = lambda c, i, e, s: (c["own"] == 1) & (F.get(e, i) <= c["s"]) & (F.get(s, i) >= c["e"])
        return bound(ends, lambda e: bound(starts, lambda s: F.filter(x, lambda c, i: alone(c, i, e, s))))

    def best(x: Column) -> Column:
        ends = scan(F.transform(x, lambda c: c["e"]), F.greatest)
        new = bound(ends, lambda e: F.transform(x, lambda c, i: F.when((i > 0) & (F.get(e, i - 1) > c["s"]), 0).otherwise(1)))
        rank = lambda c, run: F.struct(run.alias("run"), (-c["score"]).alias("score"), c["s"].alias("s"), (-c["e"]).alias("e"), c["kind"].alias("kind"))
        ranked = bound(scan(new, lambda a, b: a + b), lambda runs: F.array_sort(F.transform(x, lambda c, i: rank(c, F.get(runs, i)))))
        first = bound(ranked, lambda r: F.filter(r, lambda c, i: (i == 0) | (F.get(r, i - 1)["run"] < c["run"])))
        return F.transform(first, lambda c: F.struct(c["s"].alias("s"), c["kind"].alias("kind"), (-c["e"]).alias("e")))

    return F.when(F.size(scored) > 0, bound(bound(both, free), best)).otherwise(F.array().cast("array<struct<s:int,kind:int,e:int>>"))


def find(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (of the base patterns), base, spans and secrets (array(struct(s, kind, e)))
    added; n_spans counts spans and secrets."""
    counts = [f"n_{k}" for k in KINDS]
    docs = cleared(docs, [*counts, "n_spans", "base", "spans", "secrets", "__found", "__part", "__added"], keep=[text])
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumns({"__found": _candidates(t), "__part": F.pmod(F.xxhash64(t), F.lit(FOLDS))})
    if not keep_text:
        rows = materialize(rows.drop(text), "candidates")
    model, limits = _train(rows)
    span = lambda c: F.struct(c["s"].alias("s"), c["kind"].alias("kind"), c["e"].alias("e"))
    rows = rows.withColumn("base", F.array_sort(F.transform(F.filter("__found", lambda c: c["base"] & c["ok"]), span)))
    score = lambda c: bound(F.array(*features(c)), lambda f: boosting.as_column(model, [F.get(f, F.lit(k)) for k in range(FEATURES)]))
    scored = F.transform(F.filter("__found", lambda c: ~c["base"]), lambda c: F.struct(*[c[n].alias(n) for n in ("s", "e", "kind")], score(c).alias("score")))
    limit = F.array(*map(F.lit, limits))
    scored = F.filter(scored, lambda c: c["score"] >= F.element_at(limit, c["kind"] + 1))
    rows = rows.withColumn("__added", bound(scored, lambda x: _apart(F.col("base"), x)))
    rows = rows.withColumn("spans", F.array_sort(F.concat("base", F.filter("__added", lambda c: c["kind"] != SECRET))))
    rows = rows.withColumn("secrets", F.filter("__added", lambda c: c["kind"] == SECRET))
    kinds = F.transform("base", lambda b: b["kind"])
    for k, n in enumerate(counts):
        rows = rows.withColumn(n, (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long"))
    return rows.withColumn("n_spans", (F.size("spans") + F.size("secrets")).cast("long")).drop("__found", "__part", "__added")


def redact(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; one that begins inside an earlier one is joined to it."""
    names = F.array(*map(F.lit, [*KINDS, "secret"]))

    def pieces(x: Column) -> Column:
        """[kind] after the text before it for each run of overlapping spans, then the rest."""
        ends = scan(F.transform(x, lambda c: c["e"]), F.greatest)

        def around(b: Column, e: Column) -> Column:
            fresh = lambda c, i: (i == 0) | (F.get(e, i - 1) <= c["s"])
            before = F.transform(x, lambda c, i: F.when(fresh(c, i), F.concat(cut(b, F.when(i > 0, F.get(e, i - 1)).otherwise(0), c["s"]), F.lit("["), F.element_at(names, c["kind"] + 1), F.lit("]"))).otherwise(""))
            return F.concat(F.array_join(before, ""), cut(b, F.coalesce(F.array_max(e), F.lit(0)), F.length(text)))

        return bound(in_blocks(text), lambda b: bound(ends, lambda e: around(b, e)))

    return F.when(F.size(spans) > 0, bound(F.array_sort(spans), pieces)).otherwise(text)
