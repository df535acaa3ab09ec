"""Gradient-boosted trees for a yes/no label over weighted rows of whole numbers, on the driver or over a table of any
size, and the trees as SQL columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.llm.runtime import discard, materialize

Tree = dict  # {"value": float} or {"at": feature, "below": threshold, "yes": Tree, "no": Tree}

# Tables' gradients and weights are summed as whole multiples of 1 / SCALE: in any order the sums are the same.
SCALE = 1 << 24


def _cut(values: np.ndarray, gradient: np.ndarray, weight: np.ndarray, g: float, h: float, least: float, shrink: float) -> tuple[float, float]:
    """(gain, value between) of the best cut of a feature, from the sums for each of its values in rising order."""
    gl = np.cumsum(gradient)[:-1]
    hl = np.cumsum(weight)[:-1]
    gain = gl**2 / (hl + shrink) + (g - gl) ** 2 / (h - hl + shrink) - g**2 / (h + shrink)
    gain = np.where((hl >= least) & (h - hl >= least), gain, 0)
    at = int(np.argmax(gain))
    return gain[at], float(values[at] + values[at + 1]) / 2


def _grow(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int, least: float, shrink: float) -> Tree:
    g, h = gradient.sum(), weight.sum()
    leaf = {"value": float(g / (h + shrink))}
    if not depth or h < 2 * least:
        return leaf
    best = (1e-9, None, None)
    for k in range(x.shape[1]):
        values, of = np.unique(x[:, k], return_inverse=True)
        if len(values) < 2:
            continue
        gain, below = _cut(values, np.bincount(of, gradient), np.bincount(of, weight), g, h, least, shrink)
        if gain > best[0] + 1e-9:
            best = (gain, k, below)
    if best[1] is None:
        return leaf
    left = x[:, best[1]] < best[2]
    grow = lambda m: _grow(x[m], gradient[m], weight[m], depth - 1, least, shrink)
    return {"at": best[1], "below": best[2], "yes": grow(left), "no": grow(~left)}


def _apply(tree: Tree, x: np.ndarray) -> np.ndarray:
    if "value" in tree:
        return np.full(len(x), tree["value"])
    return np.where(x[:, tree["at"]] < tree["below"], _apply(tree["yes"], x), _apply(tree["no"], x))


def fit(x: np.ndarray, yes: np.ndarray, no: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, least: float = 1.0, shrink: float = 1.0) -> tuple[float, list[Tree]]:
    """(start, trees): their sum is the log-odds of yes. yes, no: how many rows of each label have the features x[i]."""
    total = yes + no
    start = math.log((yes.sum() + 0.5) / (no.sum() + 0.5))
    score, grown = np.full(len(x), start), []
    for _ in range(trees if len(x) else 0):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, yes - total * p, np.maximum(total * p * (1 - p), 1e-9), depth, min(least, total.sum() / 20), shrink)
        if "value" in tree:
            break
        grown.append(tree)
        score = score + rate * _apply(tree, x)
    return start, [_scaled(t, rate) for t in grown]


def _scaled(tree: Tree, rate: float) -> Tree:
    if "value" in tree:
        return {"value": tree["value"] * rate}
    return tree | {"yes": _scaled(tree["yes"], rate), "no": _scaled(tree["no"], rate)}


def fit_table(cells: DataFrame, names: list[str], yes: list[Column], no: list[Column], trees: int = 30, depth: int = 3, rate: float = 0.3, least: float = 1.0, shrink: float = 1.0) -> list[tuple[float, list[Tree]]]:
    """What fit() gives for the features called names, for several models at once, the k-th with yes[k] and no[k] rows of
    each label in a row of cells. Only sums by node, feature and value reach the driver, whatever the number of cells."""
    sums = cells.agg(*[F.sum(c).cast("double") for c in [*yes, *no]]).first()
    totals = [(sums[k] or 0.0, sums[len(yes) + k] or 0.0) for k in range(len(yes))]
    start = [math.log((y + 0.5) / (n + 0.5)) for y, n in totals]
    least_of = [min(least, (y + n) / 20) for y, n in totals]
    counts = [F.array(*[c.cast("double") for c in side]) for side in (yes, no)]
    rows = cells.select(*names, counts[0].alias("yes"), counts[1].alias("no"), F.array(*map(F.lit, start)).alias("score"))
    features = [F.col(n) for n in names]
    grown: list[list[Tree]] = [[] for _ in yes]
    growing = [k for k in range(len(yes)) if sum(totals[k])]
    for _ in range(trees):
        roots = _grow_table(rows, features, growing, depth, least_of, shrink)
        growing = [k for k in growing if "value" not in roots[k]]
        if not growing:
            break
        for k in growing:
            grown[k].append(_scaled(roots[k], rate))
        score = [F.get("score", F.lit(k)) + _case(grown[k][-1], features) if k in growing else F.get("score", F.lit(k)) for k in range(len(yes))]
        before, rows = rows, materialize(rows.withColumn("score", F.array(*score)), "boosting")
        discard(before)
    discard(rows)
    return list(zip(start, grown, strict=True))


def _grow_table(rows: DataFrame, features: list[Column], which: list[int], depth: int, least: list[float], shrink: float) -> dict[int, Tree]:
    """The next tree of each model, level by level. Nodes that may still be cut have a number under "open"."""
    roots: dict[int, Tree] = {k: {"value": 0.0, "open": 1} for k in which}
    nodes = {(k, 1): roots[k] for k in which}
    for _ in range(depth):
        sums: dict[tuple[int, int], dict[int, list]] = {}
        for r in _sums(rows, features, roots) if nodes else ():
            sums.setdefault((r["model"], r["node"]), {}).setdefault(r["feature"], []).append((r["value"], r["g"] / SCALE, r["h"] / SCALE))
        following = {}
        for (k, number), node in nodes.items():
            by_value = {f: np.array(sorted(v)).T for f, v in sums[k, number].items()}
            g, h = float(by_value[0][1].sum()), float(by_value[0][2].sum())
            node.clear()
            node["value"] = g / (h + shrink)
            if h < 2 * least[k]:
                continue
            best = (1e-9, None, None)
            for f in sorted(by_value):
                if by_value[f].shape[1] > 1:
                    gain, below = _cut(*by_value[f], g, h, least[k], shrink)
                    if gain > best[0] + 1e-9:
                        best = (gain, f, below)
            if best[1] is None:
                continue
            values, gradient, weight = by_value[best[1]]
            left = values < best[2]
            del node["value"]
            node |= {"at": best[1], "below": best[2]}
            for side, here, n in (("yes", left, 2 * number), ("no", ~left, 2 * number + 1)):
                node[side] = following[k, n] = {"value": float(gradient[here].sum() / (weight[here].sum() + shrink)), "open": n}
        nodes = following
    for node in nodes.values():
        del node["open"]
    return roots


def _sums(rows: DataFrame, features: list[Column], roots: dict[int, Tree]) -> list:
    """Gradients and weights by model, open node, feature and value, in multiples of 1 / SCALE."""

    def whole(c: Column) -> Column:
        return F.round(c * SCALE).cast("long")

    def of(k: int) -> Column:
        yes, n = F.get("yes", F.lit(k)), F.get("yes", F.lit(k)) + F.get("no", F.lit(k))
        p = 1 / (1 + F.exp(-F.get("score", F.lit(k))))
        g, h = whole(yes - n * p), whole(F.greatest(n * p * (1 - p), F.lit(1e-9)))
        return F.struct(F.lit(k).alias("model"), F.when(n > 0, _place(roots[k], features)).alias("node"), g.alias("g"), h.alias("h"))

    seen = rows.select(F.array(*features).alias("f"), F.explode(F.array(*map(of, roots))).alias("m")).filter("m.node is not null")
    seen = seen.select("m.*", F.posexplode("f").alias("feature", "value"))
    return seen.groupBy("model", "node", "feature", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()


def _place(tree: Tree, features: list[Column]) -> Column:
    """The number of the open node that a row is in, else null."""
    if "at" in tree:
        return F.when(features[tree["at"]] < tree["below"], _place(tree["yes"], features)).otherwise(_place(tree["no"], features))
    return F.lit(tree.get("open")).cast("int")


def predict(model: tuple[float, list[Tree]], x: np.ndarray) -> np.ndarray:
    """Probabilities of yes."""
    score = np.full(len(x), model[0])
    for t in model[1]:
        score = score + _apply(t, x)
    return 1 / (1 + np.exp(-score))


def _case(tree: Tree, features: list[Column]) -> Column:
    if "value" in tree:
        return F.lit(tree["value"])
    return F.when(features[tree["at"]] < tree["below"], _case(tree["yes"], features)).otherwise(_case(tree["no"], features))


def as_column(model: tuple[float, list[Tree]], features: list[Column]) -> Column:
    """The probability of yes as a column: a sum of CASE expressions."""
    score = F.lit(model[0])
    for t in model[1]:
        score = score + _case(t, features)
    return 1 / (1 + F.exp(-score))
