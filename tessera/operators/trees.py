"""Classification trees over discrete and continuous columns, grown level by level.

Every level is one aggregate over the rows for all discrete columns and one for
all continuous ones, whatever the number of its nodes: a row carries the numbers
and weights of its nodes, columns are unpivoted, and counts by node, column, value
and class decide all splits of the level. Cuts of continuous columns are found by
running sums of class counts, inside the cluster. The tree itself, which the least
size of a node bounds, lives on the driver; a prediction is an expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import running

#: Values of a column up to which all ways of parting them in two are tried.
MOST_BINARY = 10
UNKNOWN = "?"


@dataclass
class Node:
    counts: dict[str, float]
    column: str | None = None
    branches: dict[str, Node] = field(default_factory=dict)
    #: values of each branch, where it has several; or the place that parts a continuous column
    members: dict[str, tuple[str, ...]] | None = None
    threshold: float | None = None

    @property
    def majority(self) -> str:
        return min(self.counts, key=lambda c: (-self.counts[c], c))

    @property
    def leaf(self) -> bool:
        return self.column is None

    @property
    def weight(self) -> float:
        return sum(self.counts.values())

    def size(self) -> int:
        return 1 + sum(b.size() for b in self.branches.values())

    def enters(self, label: str) -> Column:
        """Whether a row's value leads into a branch; false where it is missing."""
        x = F.col(self.column)
        if label == UNKNOWN:
            return x.isNull()
        if self.threshold is not None:
            return F.coalesce(x <= self.threshold if label.startswith("<=") else x > self.threshold, F.lit(False))
        return F.coalesce(x.isin(*self.members[label]) if self.members and label in self.members else x == label, F.lit(False))

    def common(self) -> str:
        return max(self.branches, key=lambda k: (self.branches[k].weight, k))

    def shares(self, unknown: str, key: list[str] = ()) -> dict[str, Column]:
        """The weight with which a row goes into each branch; `unknown` says where one without a branch for its value goes."""
        known = F.lit(False)
        for label in self.branches:
            known = known | self.enters(label)
        total = sum(b.weight for b in self.branches.values()) or 1.0
        out, below = {}, 0.0
        for label, branch in self.branches.items():
            share = branch.weight / total
            if unknown == "common":
                lost = F.lit(1.0 if label == self.common() else 0.0)
            elif unknown == "all":
                lost = F.lit(1.0)
            elif unknown == "sizes":
                lost = F.lit(share)
            elif unknown == "random":
                u = F.pmod(F.xxhash64(F.lit(self.column), *key), F.lit(1 << 30)) / float(1 << 30)
                lost = F.when((u >= below) & (u < below + share + 1e-12), 1.0).otherwise(0.0)
            else:  # ignored, or a branch of its own
                lost = F.lit(0.0)
            below += share
            out[label] = F.when(self.enters(label), 1.0).when(~known, lost).otherwise(0.0)
        return out


def _entropy(counts) -> float:
    n = sum(counts)
    return -sum(c / n * math.log2(c / n) for c in counts if c) if n else 0.0


def _score(table: dict[str, dict[str, float]], how: str | Callable) -> float:
    if callable(how):
        return how(table)
    total: dict[str, float] = {}
    for row in table.values():
        for c, w in row.items():
            total[c] = total.get(c, 0) + w
    n = sum(total.values())
    if not n or len(table) < 2:
        return 0.0
    if how == "gini":
        g = lambda r: sum((w / sum(r.values())) ** 2 for w in r.values())
        return (sum(sum(r.values()) / n * g(r) for r in table.values()) - g(total)) / 2
    gain = _entropy(total.values()) - sum(sum(r.values()) / n * _entropy(r.values()) for r in table.values())
    split = _entropy([sum(r.values()) for r in table.values()])
    return gain if how == "gain" else gain / split if split else 0.0


def _groupings(values: list[str], split: str):
    """Ways of parting values: label -> values."""
    if split == "multiway":
        yield {v: (v,) for v in values}
    elif split == "one_against_others":
        for v in values if len(values) > 2 else values[:1]:
            yield {v: (v,), f"not {v}": tuple(x for x in values if x != v)}
    else:
        if len(values) > MOST_BINARY:
            raise ValueError(f"more than {MOST_BINARY} values to part in two: part one from the others")
        first, rest = values[0], values[1:]
        for n in range(len(rest)):
            for some in combinations(rest, n):
                left = (first, *some)
                right = tuple(x for x in values if x not in left)
                yield {" or ".join(left): left, " or ".join(right): right}


def _leaves(node: Node, path: Column, unknown: str, key: list[str], out: list[tuple[Node, Column]]) -> None:
    if node.leaf:
        out.append((node, path))
        return
    for label, share in node.shares(unknown, key).items():
        _leaves(node.branches[label], path * share, unknown, key, out)


def _discrete_counts(rows: DataFrame, columns: list[str], cls: str, keep_unknown: bool) -> dict[int, dict[str, dict[str, dict[str, float]]]]:
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) if keep_unknown else F.col(c).cast("string")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), value(c).alias("value")) for c in columns])).alias("x")
    long = rows.select("_node", "_w", F.col(cls).alias("c"), pairs).where("x.value IS NOT NULL")
    out: dict[int, dict[str, dict[str, dict[str, float]]]] = {}
    for r in long.groupBy("_node", "x.variable", "x.value", "c").agg(F.sum("_w").alias("w")).collect():
        out.setdefault(r["_node"], {}).setdefault(r.variable, {}).setdefault(r.value, {})[r.c] = r.w
    return out


def _cuts(rows: DataFrame, columns: list[str], cls: str, classes: list[str], min_rows: float, measure: str) -> dict[int, dict[str, tuple[float, float, dict[str, float], dict[str, float]]]]:
    """Of each node and continuous column the best cut, as the values on both sides, with their class counts."""
    k = range(len(classes))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")
    long = rows.select("_node", "_w", F.col(cls).alias("c"), pairs).where("x.value IS NOT NULL").select("_node", "_w", "c", "x.variable", "x.value")
    counts = long.groupBy("_node", "variable", "value").agg(*[F.sum(F.when(F.col("c") == c, F.col("_w")).otherwise(0.0)).alias(f"c{i}") for i, c in enumerate(classes)])
    left = running(counts, "value", {f"l{i}": F.col(f"c{i}") for i in k}, ["_node", "variable"], following="next").where("next IS NOT NULL")
    # a row for each open node and column
    totals = counts.groupBy("_node", "variable").agg(*[F.sum(f"c{i}").alias(f"t{i}") for i in k])
    t = left.join(F.broadcast(totals), ["_node", "variable"])
    sums = lambda p: sum((F.col(f"{p}{i}") for i in k), F.lit(0.0))
    nl, n = sums("l"), sums("t")
    nr = n - nl
    h = lambda part, m: sum((F.when(part(i) > 1e-9, -part(i) / m * F.log2(part(i) / m)).otherwise(0.0) for i in k), F.lit(0.0))
    g = lambda part, m: sum((part(i) / m * part(i) / m for i in k), F.lit(0.0))
    a, b, both = lambda i: F.col(f"l{i}"), lambda i: F.col(f"t{i}") - F.col(f"l{i}"), lambda i: F.col(f"t{i}")
    if measure == "gini":
        score = (nl / n * g(a, nl) + nr / n * g(b, nr) - g(both, n)) / 2
    else:
        score = h(both, n) - nl / n * h(a, nl) - nr / n * h(b, nr)
        if measure == "gain_ratio":
            part = lambda x: F.when(x > 0, -x / n * F.log2(x / n)).otherwise(0.0)
            score = score / (part(nl) + part(nr))
    fit = t.where((nl >= min_rows) & (nr >= min_rows)).withColumn("score", F.round(score, 12))
    best = fit.groupBy("_node", "variable").agg(F.max(F.struct("score", (-F.col("value")).alias("v"), "next", *[f"l{i}" for i in k], *[f"t{i}" for i in k])).alias("b"))
    out: dict[int, dict[str, tuple[float, float, dict[str, float], dict[str, float]]]] = {}
    for r in best.collect():
        low = {c: r.b[f"l{i}"] for i, c in enumerate(classes) if r.b[f"l{i}"] > 1e-9}
        high = {c: r.b[f"t{i}"] - r.b[f"l{i}"] for i, c in enumerate(classes) if r.b[f"t{i}"] - r.b[f"l{i}"] > 1e-9}
        out.setdefault(r["_node"], {})[r.variable] = (-r.b.v, r.b.next, low, high)
    return out


def grow(df: DataFrame, columns: list[str], cls: str, measure: str | Callable = "gain_ratio", min_rows: int = 2, max_majority: float = 1.0, depth: int = 10, continuous: list[str] = (), split: str = "multiway", unknown: str = "ignore", key: list[str] = (), stop: Callable[[dict[str, float], int], bool] | None = None) -> Node:
    """A tree over discrete `columns` and `continuous` ones.

    `split`: multiway, one_against_others or binary for discrete columns. `measure`
    is gain, gain_ratio, gini, or a function of a table value -> class -> weight (for
    discrete columns). Rows with a missing value at a split: ignore (they go no
    further), common (into the largest branch), all, sizes (into all, with the
    branches' shares as weights), random (by shares and a hash of `key`), branch (one
    of their own). `stop` may close a node by its class counts and depth.
    """
    known = df.where(F.col(cls).isNotNull())
    root = Node({r[0]: float(r[1]) for r in known.groupBy(cls).agg(F.count(F.lit(1))).collect()})
    classes = sorted(root.counts)
    closed: set[int] = set()
    for level in range(depth):
        leaves: list[tuple[Node, Column]] = []
        _leaves(root, F.lit(1.0), unknown, list(key), leaves)
        open_ = [(n, w) for n, w in leaves if id(n) not in closed and n.counts and n.weight >= 2 * min_rows and max(n.counts.values()) < max_majority * n.weight and not (stop and stop(n.counts, level))]
        if not open_:
            break
        at = F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("_node"), w.alias("_w")) for i, (_, w) in enumerate(open_)]), lambda x: x["_w"] > 0)).alias("_at")
        rows = known.select(*dict.fromkeys([*columns, *continuous, cls]), at).select("*", "_at._node", "_at._w")
        tables = _discrete_counts(rows, columns, cls, unknown == "branch") if columns else {}
        cuts = _cuts(rows, list(continuous), cls, classes, min_rows, measure if isinstance(measure, str) else "gain") if continuous else {}
        for i, (node, _) in enumerate(open_):
            ways: list[tuple[float, str, dict]] = []
            for v, table in tables.get(i, {}).items():
                names = sorted(x for x in table if x != UNKNOWN or unknown != "branch")
                lost = {UNKNOWN: table[UNKNOWN]} if unknown == "branch" and UNKNOWN in table else {}
                for group in _groupings(names, split) if len(names) > 1 else ():
                    joined = {label: {c: sum(table[x].get(c, 0.0) for x in own) for c in {c for x in own for c in table[x]}} for label, own in group.items()}
                    if all(sum(r.values()) >= min_rows for r in joined.values()):
                        ways.append((round(_score(joined | lost, measure), 12), v, {"branches": joined | lost, "members": None if split == "multiway" else group}))
            for v, (below, above, low, high) in cuts.get(i, {}).items():
                place = (below + above) / 2
                table = {f"<={place:g}": low, f">{place:g}": high}
                ways.append((round(_score(table, measure), 12), v, {"branches": table, "threshold": place}))
            best = max(ways, key=lambda w: (w[0], w[1]), default=None)
            if best is None or best[0] <= 1e-9:
                closed.add(id(node))
                continue
            node.column, node.members, node.threshold = best[1], best[2].get("members"), best[2].get("threshold")
            node.branches = {label: Node(dict(r)) for label, r in sorted(best[2]["branches"].items())}
    return root


def _ends(node: Node, path: Column, unknown: str, out: list[tuple[Node, Column]]) -> None:
    if node.leaf:
        out.append((node, path))
        return
    shares = node.shares("none" if unknown in ("node", "branch") else unknown)
    for label, share in shares.items():
        _ends(node.branches[label], path * share, unknown, out)
    if unknown in ("node", "branch"):
        gone = F.lit(1.0)
        for share in shares.values():
            gone = gone - share
        out.append((node, path * gone))


def probabilities(node: Node, unknown: str = "node") -> dict[str, Column]:
    """The probability of each class; where a value is missing or new: the node's own shares, those of the common branch, or of all branches merged by their sizes or with equal voices."""
    ends: list[tuple[Node, Column]] = []
    _ends(node, F.lit(1.0), unknown, ends)
    total = sum((w for _, w in ends), F.lit(0.0))
    return {c: sum((w * (n.counts.get(c, 0.0) / n.weight) for n, w in ends if n.weight), F.lit(0.0)) / total for c in sorted(node.counts)}


def predict(node: Node, unknown: str = "node") -> Column:
    """The class as an expression; see `probabilities` for missing or new values (the least class of several)."""
    if unknown in ("sizes", "all"):
        p = probabilities(node, unknown)
        return F.array_min(F.array(*[F.struct((-F.round(x, 12)).alias("p"), F.lit(c).alias("c")) for c, x in p.items()]))["c"]
    if node.leaf:
        return F.lit(node.majority)
    labels = list(node.branches)
    # the branch as a number, so that every branch stands in the expression once
    into = F.lit(labels.index(node.common()) if unknown == "common" else -1)
    for i, label in enumerate(labels):
        into = F.when(node.enters(label), F.lit(i)).otherwise(into)
    out = F.lit(node.majority)
    for i, label in enumerate(labels):
        out = F.when(into == i, predict(node.branches[label], unknown)).otherwise(out)
    return out


def m_error(node: Node, m: float, prior: dict[str, float]) -> float:
    n = sum(node.counts.values())
    return 1 - max((node.counts.get(c, 0) + m * p) / (n + m) for c, p in prior.items())


def prune(node: Node, m: float, prior: dict[str, float] | None = None) -> float:
    """Cuts branches that don't lower the m-estimate of the error; returns the error left."""
    n = sum(node.counts.values())
    prior = prior or {c: w / n for c, w in node.counts.items()}
    own = m_error(node, m, prior)
    if node.leaf:
        return own
    below = sum(sum(b.counts.values()) / n * prune(b, m, prior) for b in node.branches.values())
    if own <= below + 1e-12:
        node.column, node.branches = None, {}
        return own
    return below


def prune_same_majority(node: Node) -> None:
    for b in node.branches.values():
        prune_same_majority(b)
    if node.branches and all(b.leaf for b in node.branches.values()) and len({b.majority for b in node.branches.values()}) == 1:
        node.column, node.branches = None, {}


def dump(node: Node, indent: int = 0) -> str:
    if node.leaf:
        return f"{'  ' * indent}{node.majority} {dict(sorted(node.counts.items()))}"
    return "\n".join(f"{'  ' * indent}{node.column}={v}\n{dump(b, indent + 1)}" for v, b in node.branches.items())


# --- rules by covering --------------------------------------------------------------------------


@dataclass
class Rule:
    conditions: dict[str, str]
    cls: str
    counts: dict[str, float]

    def covers(self) -> Column:
        out = F.lit(True)
        for c, v in self.conditions.items():
            out = out & F.coalesce(F.col(c) == v, F.lit(False))
        return out


def laplace(counts: dict[str, float], cls: str, k: int, prior: dict[str, float] | None = None) -> float:
    return (counts.get(cls, 0) + 1) / (sum(counts.values()) + k)


def entropy_quality(counts: dict[str, float], cls: str, k: int, prior: dict[str, float] | None = None) -> float:
    return -_entropy(counts.values())


def m_quality(m: float) -> Callable:
    """The m-estimate of a class with the shares of all rows as prior."""

    def quality(counts, cls, k, prior):
        return (counts.get(cls, 0) + m * prior.get(cls, 0.0) / sum(prior.values())) / (sum(counts.values()) + m)

    return quality


def weighted_accuracy(counts: dict[str, float], cls: str, k: int, prior: dict[str, float]) -> float:
    """The share of rows covered times what is gained over the class's own share (subgroup discovery)."""
    n, all_ = sum(counts.values()), sum(prior.values())
    return n / all_ * (counts.get(cls, 0) / n - prior.get(cls, 0.0) / all_)


def significance(counts: dict[str, float], prior: dict[str, float]) -> float:
    """Likelihood ratio statistic of covered classes against all rows."""
    n, all_ = sum(counts.values()), sum(prior.values())
    return 2 * sum(w * math.log(w / (n * prior[c] / all_)) for c, w in counts.items() if w > 0)


def refined(conditions: dict[str, str], columns: list[str], rows: list) -> list[dict[str, str]]:
    """The conditions with one more selector, in each way."""
    return [conditions | {c: v} for c in columns if c not in conditions for v in sorted({x[c] for x, _, _ in rows if x[c] is not None})]


#: Distinct rows that the search may hold on the driver.
MOST_DISTINCT = 200_000


class _Search:
    """A beam over conjunctions, on the counts of distinct rows."""

    def __init__(self, df: DataFrame, columns: list[str], cls: str, beam: int, most_conditions: int, evaluator: Callable, least_significance: float, least_rows: float):
        table = df.where(F.col(cls).isNotNull()).groupBy(*columns, cls).agg(F.count(F.lit(1)).alias("n")).limit(MOST_DISTINCT + 1).collect()
        if len(table) > MOST_DISTINCT:
            raise ValueError(f"more than {MOST_DISTINCT} distinct rows: discretise first")
        self.rows = [({c: r[c] for c in columns}, r[cls], float(r["n"])) for r in table]
        self.columns, self.beam, self.most, self.evaluator = columns, beam, most_conditions, evaluator
        self.least_significance, self.least_rows = least_significance, least_rows
        self.classes = sorted({r[1] for r in self.rows})

    def counts(self, conditions: dict[str, str], rows: list) -> dict[str, float]:
        t: dict[str, float] = {}
        for x, c, n in rows:
            if all(x[k] == v for k, v in conditions.items()):
                t[c] = t.get(c, 0) + n
        return t

    def best(self, rows: list, target: str | None = None):
        """quality, -conditions, conditions, class and counts of the best rule, of a target class or any."""
        prior = self.counts({}, rows)
        front, best = [{}], None
        for _ in range(self.most):
            new = {tuple(sorted(c.items())): None for conditions in front for c in refined(conditions, self.columns, rows)}
            scored = []
            for name in new:
                t = self.counts(dict(name), rows)
                if not t or sum(t.values()) < self.least_rows:
                    continue
                c = target or max(self.classes, key=lambda k: (t.get(k, 0), k))
                if t.get(c, 0) and significance(t, prior) >= self.least_significance:
                    scored.append((self.evaluator(t, c, len(self.classes), prior), -len(name), name, c, t))
            scored.sort(key=lambda s: (-s[0], -s[1], s[2]))
            front = [dict(s[2]) for s in scored[: self.beam]]
            if scored and (best is None or scored[0][:2] > best[:2]):
                best = scored[0]
        return best


def induce_rules(df: DataFrame, columns: list[str], cls: str, beam: int = 5, most_rules: int = 50, most_conditions: int = 3, evaluator: Callable = laplace, least_significance: float = 0.0, least_rows: float = 0.0) -> list[Rule]:
    """An ordered list by covering with a beam (after CN2, Clark and Niblett, 1989).

    The search runs over the counts of the distinct rows, gathered once; these
    are bounded by the products of the columns' values, which is checked. Rules must
    reach `least_significance` (chi-square of one less than the classes) and cover
    `least_rows`; `evaluator` orders them.
    """
    s = _Search(df, columns, cls, beam, most_conditions, evaluator, least_significance, least_rows)
    rows, out = s.rows, []
    while rows and len(out) < most_rules:
        best, everything = s.best(rows), s.counts({}, rows)
        default = max(s.classes, key=lambda k: (everything.get(k, 0), k))
        if best is None or best[0] <= evaluator(everything, default, len(s.classes), everything):
            out.append(Rule({}, default, everything))
            break
        conditions = dict(best[2])
        out.append(Rule(conditions, best[3], best[4]))
        rows = [r for r in rows if not all(r[0][k] == v for k, v in conditions.items())]
    return out


def induce_unordered(df: DataFrame, columns: list[str], cls: str, beam: int = 5, most_rules: int = 50, most_conditions: int = 3, evaluator: Callable = laplace, least_significance: float = 0.0, least_rows: float = 0.0) -> list[Rule]:
    """Rules for each class in turn; what they cover of their own class goes, other rows stay. The last has no conditions."""
    s = _Search(df, columns, cls, beam, most_conditions, evaluator, least_significance, least_rows)
    everything, out = s.counts({}, s.rows), []
    for c in s.classes:
        rows, n = s.rows, 0
        while n < most_rules:
            best, left = s.best(rows, c), s.counts({}, rows)
            if best is None or not left.get(c) or best[0] <= evaluator(left, c, len(s.classes), left):
                break
            conditions = dict(best[2])
            out.append(Rule(conditions, c, s.counts(conditions, s.rows)))
            rows = [r for r in rows if r[1] != c or not all(r[0][k] == v for k, v in conditions.items())]
            n += 1
    if everything:
        out.append(Rule({}, max(s.classes, key=lambda k: (everything[k], k)), everything))
    return out


def voted(rules: list[Rule]) -> Column:
    """The class with the greatest sum of covered rows over all rules that cover a row; where only the last does, its class."""
    classes = sorted({c for r in rules for c in r.counts})
    own = [r for r in rules if r.conditions]
    sums = [F.struct((-sum((F.when(r.covers(), F.lit(float(r.counts.get(c, 0)))).otherwise(0.0) for r in own), F.lit(0.0))).alias("w"), F.lit(c).alias("c")) for c in classes]
    best = F.array_min(F.array(*sums))
    default = next((r.cls for r in rules if not r.conditions), None)
    return F.when(best["w"] < 0, best["c"]).otherwise(F.lit(default))


def first_rule(rules: list[Rule], default: str | None = None) -> Column:
    """The class of the first rule that covers a row."""
    out = F.lit(default)
    for r in reversed(rules):
        out = F.when(r.covers(), F.lit(r.cls)).otherwise(out)
    return out
