"""One profile for each document under a byte budget: a multiple-choice knapsack by Lagrangian relaxation and repair.

The problem is a table `docno`, `u` (an array of utilities in the order of the profiles) with the profiles' costs beside it.
A choice is a column `k` (0-based). For a multiplier, each document takes the profile of the largest u - multiplier * cost, ties
to the first; a bisection of multipliers is evaluated `TREE` levels at a time, in one pass over the table, as its midpoints are
known beforehand. Only sums reach the driver. Utilities are summed as whole numbers of 1e-15, so sums don't depend on the order of rows.

Repair moves documents one by one in a fixed order until the budget is met or spent. A running sum over that order in two steps
(within range partitions, then their offsets) takes whole stretches of moves at once. Documents compare by docno as strings.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.operators.profiles import Profile
from lumenspan.sources.shared import kept

TREE = 4
#: Utilities are summed as whole numbers of these, and so may not be beyond LARGEST.
UNITS = 1e15
LARGEST = 9000.0


class InfeasibleError(ValueError):
    pass


@dataclass
class Problem:
    wide: DataFrame
    names: list[str]
    costs: list[int]
    budget: int
    n: int

    @property
    def cost_array(self) -> Column:
        return F.array(*(F.lit(c).cast("long") for c in self.costs))


@dataclass
class Candidate:
    chosen: DataFrame = field(repr=False)  # docno, u, k
    cost: int
    utility: object
    lam: float
    origin: str
    upgrades: int = 0
    downgrades: int = 0
    relaxed_cost: int | None = None
    relaxed_utility: float | None = None
    moves_left: bool = False


def build(utility: DataFrame, profiles: list[Profile], budget: int, dtype: str = "float16") -> Problem:
    """From exactly one finite `utility` for each `docno` and `profile`; raises on unknown profiles, gaps, repeats and budgets
    below the cheapest choice.
    """
    names, costs = [p.name for p in profiles], [p.cost(dtype) for p in profiles]
    if len(set(names)) != len(names) or any(c <= 0 for c in costs):
        raise ValueError("profiles need unique names and positive costs")
    order = F.array_position(F.array(*map(F.lit, names)), F.col("profile")) - 1
    t = utility.select("docno", order.cast("int").alias("i"), F.col("utility").cast("double").alias("utility"))
    bad = t.agg(
        F.count_if((F.col("i") < 0) | F.col("i").isNull()).alias("unknown"),
        F.count_if(F.col("utility").isNull() | F.isnan("utility") | (F.abs("utility") == float("inf"))).alias("odd"),
        F.count_if(F.abs("utility") > LARGEST).alias("large")
    ).first()
    if bad["unknown"] or bad["odd"]:
        raise ValueError(f"{bad['unknown']} utilities of unknown profiles, {bad['odd']} that aren't finite")
    if bad["large"]:
        raise ValueError(f"{bad['large']} utilities beyond {LARGEST:g}; scale them down")
    wide = kept(
        t.groupBy("docno").agg(
            F.count("*").alias("n"), F.size(F.collect_set("i")).alias("d"),
            F.sort_array(F.collect_list(F.struct("i", "utility"))).alias("s")
        ).select("docno", "n", "d", F.transform("s", lambda x: x["utility"]).alias("u"))
    )
    wrong = wide.where((F.col("n") != len(names)) | (F.col("d") != len(names))).select("docno").limit(5).collect()
    if wrong:
        raise ValueError(f"not one utility for each profile: {[r['docno'] for r in wrong]}")
    n = wide.count()
    if n * min(costs) > budget:
        raise InfeasibleError(f"{n} documents need {n * min(costs)} bytes at least; the budget is {budget}")
    return Problem(wide.select("docno", "u"), names, costs, int(budget), n)


def choice(u: Column, costs: list[int], lam: Column | float) -> Column:
    """The 0-based profile of the largest reduced utility, ties to the first."""
    lam = F.lit(float(lam)) if isinstance(lam, (int, float)) else lam
    reduced = F.zip_with(u, F.array(*(F.lit(float(c)) for c in costs)), lambda x, c: x - lam * c)
    return (F.array_position(reduced, F.array_max(reduced)) - 1).cast("int")


def _totals(chosen: DataFrame, p: Problem, *by: str) -> DataFrame:
    k = F.col("k") + 1
    sums = (
        F.coalesce(F.sum(F.element_at(p.cost_array, k)), F.lit(0)).alias("cost"),
        F.coalesce(
            F.sum(F.rint(F.element_at("u", k) * UNITS).cast("long").cast("decimal(38,0)")),
            F.lit(0).cast("decimal(38,0)")
        ).alias("utility")
    )
    return chosen.groupBy(*by).agg(*sums) if by else chosen.agg(*sums)


def candidate(chosen: DataFrame, p: Problem, lam: float, origin: str, **more) -> Candidate:
    t = _totals(chosen, p).first()
    return Candidate(chosen, int(t["cost"]), Decimal(t["utility"]).scaleb(-15), lam, origin, **more)


def at_lambda(p: Problem, lam: float) -> DataFrame:
    return p.wide.withColumn("k", choice(F.col("u"), p.costs, lam))


def curve(p: Problem, lams: list[float]) -> dict[float, tuple[int, object]]:
    """Cost and utility for each multiplier, in one pass."""
    if not lams:
        return {}
    many = p.wide.withColumn("lam", F.explode(F.array(*map(F.lit, map(float, lams)))))
    got = {
        r["lam"]: (int(r["cost"]), Decimal(r["utility"]).scaleb(-15)) for r in _totals(
            many.withColumn("k", choice(F.col("u"), p.costs, F.col("lam"))), p, "lam"
        ).collect()
    }
    return {x: got.get(x, (0, Decimal(0))) for x in lams}


def cheapest(p: Problem) -> Candidate:
    """The cheapest profile everywhere; of several of that cost, the one of most utility."""
    own = [i for i, c in enumerate(p.costs) if c == min(p.costs)]
    among = F.array(*(F.element_at("u", i + 1) for i in own))
    best = F.element_at(F.array(*map(F.lit, own)), F.array_position(among, F.array_max(among)).cast("int"))
    return candidate(p.wide.withColumn("k", best.cast("int")), p, 0.0, "cheapest_baseline")


def _wins_tie(a: Candidate, b: Candidate) -> bool:
    """At the first document (by docno) that they treat differently, the later profile wins."""
    d = a.chosen.select("docno", F.col("k").alias("ka")).join(b.chosen.select("docno", F.col("k").alias("kb")), "docno").where("ka <> kb")
    r = d.agg(F.min_by(F.col("ka") - F.col("kb"), "docno").alias("d")).first()
    return r["d"] is not None and r["d"] > 0


def better_feasible(a: Candidate, b: Candidate | None, budget: int) -> bool:
    """More utility, then more cost, then the tie rule."""
    if a.cost > budget:
        return False
    if b is None:
        return True
    if (a.utility, a.cost) != (b.utility, b.cost):
        return (a.utility, a.cost) > (b.utility, b.cost)
    return _wins_tie(a, b)


def better_infeasible(a: Candidate, b: Candidate | None, budget: int) -> bool:
    """Less overflow, then more utility, then the tie rule."""
    if a.cost <= budget:
        return False
    if b is None:
        return True
    if (a.cost, a.utility) != (b.cost, b.utility):
        return (-a.cost, a.utility) > (-b.cost, b.utility)
    return _wins_tie(a, b)


def lambda_ceiling(p: Problem) -> float:
    """Where the cheapest profiles win: the span of utilities over the least difference of costs."""
    costs = sorted(set(p.costs))
    if len(costs) < 2:
        return 1e-4
    r = p.wide.agg(F.max(F.array_max("u")).alias("a"), F.min(F.array_min("u")).alias("b")).first()
    return max(1e-4, ((r["a"] or 0) - (r["b"] or 0)) / max(min(y - x for x, y in zip(costs, costs[1:], strict=False)), 1))


@dataclass
class Search:
    best: Candidate
    infeasible: Candidate | None
    iterations: int
    reached: bool


def search(p: Problem, start: Candidate, max_iter: int = 64, tolerance: float = 1e-3, low: float = 0.0, high: float = 1.0) -> Search:
    """Bisection of the multiplier. The best feasible and the closest infeasible choice of all that it visits, those at both ends
    included.
    """
    high = max(high, lambda_ceiling(p))
    best, infeasible = start, None
    known: dict[float, tuple[int, object]] = {}

    def value(lam: float) -> tuple[int, object]:
        if lam not in known:
            known.update(curve(p, [lam]))
        return known[lam]

    def visit(lam: float, origin: str) -> int:
        nonlocal best, infeasible
        cost, utility = value(lam)
        c = Candidate(at_lambda(p, lam), cost, utility, lam, origin, relaxed_cost=cost, relaxed_utility=utility)
        if better_feasible(c, best, p.budget):
            best = c
        elif better_infeasible(c, infeasible, p.budget):
            infeasible = c
        return cost

    for _ in range(64):
        if value(high)[0] <= p.budget:
            break
        high = max(high * 2.0, high + 1e-4)
    visit(low, "relaxation_lambda_low")
    visit(high, "relaxation_lambda_high")
    done, reached = 0, False
    while done < max_iter and not reached:
        level, tree = [(low, high)], []
        for _ in range(min(TREE, max_iter - done)):
            tree += [0.5 * (a + b) for a, b in level]
            level = [x for a, b in level for m in [0.5 * (a + b)] for x in ((a, m), (m, b))]
        known.update(curve(p, [x for x in dict.fromkeys(tree) if x not in known]))
        for _ in range(min(TREE, max_iter - done)):
            lam = 0.5 * (low + high)
            done += 1
            cost = visit(lam, "relaxation_search")
            if cost <= p.budget and (p.budget - cost) / max(p.budget, 1) <= tolerance:
                reached = True
                break
            low, high = (lam, high) if cost > p.budget else (low, lam)
    return Search(best, infeasible, done, reached)


def upgrade_moves(chosen: DataFrame, p: Problem) -> DataFrame:
    """Each document's best move to a dearer profile: most gain for a byte, then most gain, then the first. `docno`, `target`,
    `extra`, `gain`, `ratio`.
    """
    here_cost, here = F.element_at(p.cost_array, F.col("k") + 1), F.element_at("u", F.col("k") + 1)
    moves = F.transform(
        F.array(*map(F.lit, range(len(p.costs)))),
        lambda i: F.struct(
            (F.element_at(p.cost_array, i + 1) - here_cost).alias("extra"),
            (F.element_at("u", i + 1) - here).alias("gain"), i.alias("target")
        )
    )
    fit = F.filter(moves, lambda m: (m["extra"] > 0) & (m["gain"] > 0))
    best = F.array_max(
        F.transform(
            fit,
            lambda m: F.struct(
                (m["gain"] / m["extra"]).alias("ratio"), m["gain"].alias("gain"), (-m["target"]).alias("t"),
                m["extra"].alias("extra")
            )
        )
    )
    return chosen.select("docno", best.alias("m")).where("m IS NOT NULL").select(
        "docno", (-F.col("m.t")).alias("target"), "m.extra", "m.gain", "m.ratio"
    )


def downgrade_moves(chosen: DataFrame, p: Problem) -> DataFrame:
    """Each document's best move to a cheaper profile: least loss for a byte, then least loss, then most bytes, then the first.
    `docno`, `target`, `saved`, `loss`, `ratio`.
    """
    here_cost, here = F.element_at(p.cost_array, F.col("k") + 1), F.element_at("u", F.col("k") + 1)
    moves = F.transform(
        F.array(*map(F.lit, range(len(p.costs)))),
        lambda i: F.struct(
            (here_cost - F.element_at(p.cost_array, i + 1)).alias("saved"),
            (here - F.element_at("u", i + 1)).alias("loss"), i.alias("target")
        )
    )
    fit = F.filter(moves, lambda m: m["saved"] > 0)
    best = F.array_min(
        F.transform(
            fit,
            lambda m: F.struct(
                (m["loss"] / m["saved"]).alias("ratio"), m["loss"].alias("loss"), (-m["saved"]).alias("s"),
                m["target"].alias("target")
            )
        )
    )
    return chosen.select("docno", best.alias("m")).where("m IS NOT NULL").select(
        "docno", "m.target", (-F.col("m.s")).alias("saved"), "m.loss", "m.ratio"
    )


UP = (F.desc, "ratio"), (F.desc, "gain"), (F.asc, "docno"), (F.asc, "target")
DOWN = (F.asc, "ratio"), (F.asc, "loss"), (F.desc, "saved"), (F.asc, "docno"), (F.asc, "target")


def running(df: DataFrame, order: tuple, value: str) -> DataFrame:
    """df with `_pos` (from 0) and `_cum`, the sum of value up to and with each row, in order.

    Ranges are written with their number, summed, and shifted by what is before them: the driver sees a sum per range.
    """
    cols = [f(c) for f, c in order]
    parted = kept(df.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()))
    sums = parted.groupBy("_part").agg(F.sum(value).alias("s"), F.count("*").alias("n")).orderBy("_part").collect()
    before, pos, offsets = 0, 0, []
    for r in sums:
        offsets += [F.lit(r["_part"]), F.struct(F.lit(before).cast("long").alias("s"), F.lit(pos).cast("long").alias("n"))]
        before, pos = before + r["s"], pos + r["n"]
    if not offsets:
        return parted.withColumns({"_pos": F.lit(0).cast("long"), "_cum": F.lit(0).cast("long")}).drop("_part")
    at = F.element_at(F.create_map(*offsets), F.col("_part"))
    w = Window.partitionBy("_part").orderBy(*cols)
    return parted.withColumns(
        {"_pos": at["n"] + F.row_number().over(w) - 1, "_cum": at["s"] + F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))}
    ).drop("_part")


def _moved(chosen: DataFrame, taken: DataFrame) -> DataFrame:
    j = chosen.join(taken.select("docno", F.col("target").alias("_t")), "docno", "left")
    return kept(j.select("docno", "u", F.coalesce("_t", "k").cast("int").alias("k")))


def upgrade_round(moves: DataFrame, room: int) -> tuple[DataFrame | None, int, int]:
    """The moves that are made when each in order is made if it still fits: `docno`, `target`; how many, and their bytes.

    A move that doesn't fit rules out all later ones of its size or more, so each round takes the longest stretch of moves that
    fits and goes on behind it with the smaller ones; there are no more rounds than sizes.
    """
    left, out, count, spent = moves, None, 0, 0
    after = -1
    ordered = kept(running(left, UP, "extra").drop("_cum").withColumnRenamed("_pos", "_at"))
    while True:
        left = ordered.where((F.col("_at") > after) & (F.col("extra") <= room - spent))
        if not left.take(1):
            return out, count, spent
        summed = kept(running(left, ((F.asc, "_at"),), "extra"))
        fits = summed.where(F.col("_cum") <= room - spent)
        r = fits.agg(F.count("*").alias("n"), F.max("_cum").alias("c")).first()
        stop = summed.where(F.col("_cum") > room - spent).agg(F.min("_at").alias("a")).first()["a"]
        part = fits.select("docno", "target")
        out = part if out is None else out.union(part)
        count, spent = count + r["n"], spent + (r["c"] or 0)
        if stop is None:
            return out, count, spent
        after = stop


def upgrade(p: Problem, c: Candidate) -> Candidate:
    """Spend what is left of the budget, at most once for each profile but one."""
    chosen, cost, done = c.chosen, c.cost, 0
    for _ in range(max(0, len(p.costs) - 1)):
        taken, n, spent = upgrade_round(upgrade_moves(chosen, p), p.budget - cost)
        if not n:
            break
        chosen, cost, done = _moved(chosen, taken), cost + spent, done + n
    left = bool(upgrade_moves(chosen, p).where(F.col("extra") <= p.budget - cost).take(1))
    return candidate(
        chosen, p, c.lam, f"{c.origin}_upgraded" if done else c.origin, upgrades=c.upgrades + done,
        downgrades=c.downgrades, relaxed_cost=c.relaxed_cost, relaxed_utility=c.relaxed_utility, moves_left=left
    )


def downgrade_pass(chosen: DataFrame, p: Problem, overflow: int) -> DataFrame:
    """Moves in order until the overflow is saved: those before which it isn't yet."""
    return running(downgrade_moves(chosen, p), DOWN, "saved").where(F.col("_cum") - F.col("saved") < overflow)


def downgrade(p: Problem, c: Candidate) -> Candidate:
    chosen, cost, done = c.chosen, c.cost, 0
    for _ in range(max(1, len(p.costs) - 1)):
        if cost <= p.budget:
            break
        taken = kept(downgrade_pass(chosen, p, cost - p.budget))
        r = taken.agg(F.count("*").alias("n"), F.sum("saved").alias("s")).first()
        if not r["n"]:
            break
        chosen, cost, done = _moved(chosen, taken), cost - r["s"], done + r["n"]
    if cost > p.budget:
        raise RuntimeError("the choice can't be repaired, though the cheapest fits")
    return candidate(
        chosen, p, c.lam, "repaired_infeasible_relaxed", upgrades=c.upgrades, downgrades=c.downgrades + done,
        relaxed_cost=c.cost, relaxed_utility=c.utility
    )


@dataclass
class Solution:
    assignments: DataFrame = field(repr=False)  # docno, profile, utility, cost_bytes
    report: dict


def assignments(chosen: DataFrame, p: Problem) -> DataFrame:
    k = F.col("k") + 1
    return chosen.select(
        "docno", F.element_at(F.array(*map(F.lit, p.names)), k).alias("profile"), F.element_at("u", k).alias("utility"),
        F.element_at(p.cost_array, k).alias("cost_bytes")
    )


#: Up to so many utilities (32 MB) a problem is solved in the memory of one task by the same rules; beyond, by passes over the table.
LOCAL = 1 << 22


class Local:
    """The same search and repair over arrays of a problem that was counted to be small. Rows are in order of docno."""

    def __init__(self, u: np.ndarray, costs: list[int], budget: int):
        self.u, self.c, self.budget, self.rows = u, np.array(costs, np.int64), budget, np.arange(len(u))
        self.exact = np.rint(u * UNITS).astype(np.int64)

    def value(self, k: np.ndarray) -> tuple[int, int]:
        """Cost, and utility in units of 1e-15."""
        own = self.exact[self.rows, k]
        return int(self.c[k].sum()), sum(own.tolist())

    def beats(self, a: np.ndarray, b: np.ndarray | None, feasible: bool) -> bool:
        (cost, value) = self.value(a)
        if (cost <= self.budget) != feasible:
            return False
        if b is None:
            return True
        other = self.value(b)
        key = (lambda x: (x[1], x[0])) if feasible else (lambda x: (-x[0], x[1]))
        if key((cost, value)) != key(other):
            return key((cost, value)) > key(other)
        d = np.flatnonzero(a != b)
        return bool(len(d)) and bool(a[d[0]] > b[d[0]])

    def moves(self, k: np.ndarray, up: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents in order of their best moves, with targets and sizes."""
        size = self.c[None, :] - self.c[k][:, None]
        gain = self.u - self.u[self.rows, k][:, None]
        size, gain = (size, gain) if up else (-size, gain)
        ok = (size > 0) & ((gain > 0) if up else True)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(ok, -gain / size, np.inf)
        first = np.where(ok, -gain, np.inf)
        second = np.zeros_like(size) if up else -size
        target = np.broadcast_to(np.arange(len(self.c)), size.shape)
        best = np.lexsort((target, second, first, ratio), axis=1)[:, 0]
        docs = self.rows[ok.any(axis=1)]
        t = best[docs]
        keys = (docs, np.zeros(len(docs)) if up else -size[docs, t], first[docs, t], ratio[docs, t])
        order = np.lexsort(keys)
        return docs[order], t[order], size[docs, t][order]

    def upgrade(self, k: np.ndarray) -> tuple[np.ndarray, int, bool]:
        k, count = k.copy(), 0
        for _ in range(len(self.c) - 1):
            d, t, size = self.moves(k, True)
            room, at, made = self.budget - self.value(k)[0], 0, 0
            while at < len(d):
                fits = at + np.flatnonzero(size[at:] <= room)
                if not len(fits):
                    break
                n = int(np.searchsorted(np.cumsum(size[fits]), room, "right"))
                k[d[fits[:n]]] = t[fits[:n]]
                room, made = room - int(size[fits[:n]].sum()), made + n
                at = int(fits[n]) + 1 if n < len(fits) else len(d)
            count += made
            if not made:
                break
        return k, count, bool((self.moves(k, True)[2] <= self.budget - self.value(k)[0]).any())

    def downgrade(self, k: np.ndarray) -> tuple[np.ndarray, int]:
        k, count = k.copy(), 0
        for _ in range(max(1, len(self.c) - 1)):
            over = self.value(k)[0] - self.budget
            if over <= 0:
                break
            d, t, size = self.moves(k, False)
            n = int(np.sum(np.cumsum(size) - size < over))
            if not n:
                break
            k[d[:n]] = t[:n]
            count += n
        if self.value(k)[0] > self.budget:
            raise RuntimeError("the choice can't be repaired, though the cheapest fits")
        return k, count

    def solve(self, max_iter: int, tolerance: float, low: float, high: float) -> tuple[np.ndarray, dict]:
        own = np.flatnonzero(self.c == self.c.min())
        base = own[self.u[:, own].argmax(axis=1)] if len(self.rows) else np.zeros(0, np.int64)
        best, best_at, far, far_at = base, (0.0, "cheapest_baseline", None), None, (0.0, "", None)
        costs = np.unique(self.c)
        span = float(self.u.max() - self.u.min()) if self.u.size else 0.0
        high = max(high, 1e-4, span / max(int(np.diff(costs).min()), 1) if len(costs) > 1 else 1e-4)
        pick = lambda lam: (self.u - lam * self.c).argmax(axis=1) if len(self.rows) else base

        def visit(lam: float, origin: str) -> int:
            nonlocal best, best_at, far, far_at
            k = pick(lam)
            if self.beats(k, best, True):
                best, best_at = k, (lam, origin, self.value(k))
            elif self.beats(k, far, False):
                far, far_at = k, (lam, origin, self.value(k))
            return self.value(k)[0]

        for _ in range(64):
            if self.value(pick(high))[0] <= self.budget:
                break
            high = max(high * 2.0, high + 1e-4)
        visit(low, "relaxation_lambda_low")
        visit(high, "relaxation_lambda_high")
        done, reached = 0, False
        while done < max_iter and not reached:
            lam = 0.5 * (low + high)
            done += 1
            cost = visit(lam, "relaxation_search")
            reached = cost <= self.budget and (self.budget - cost) / max(self.budget, 1) <= tolerance
            low, high = (lam, high) if cost > self.budget else (low, lam)
        finals = []
        starts = [(best, best_at, 0), (base, (0.0, "cheapest_baseline", None), 0)]
        if far is not None:
            k, downs = self.downgrade(far)
            starts.append((k, (far_at[0], "repaired_infeasible_relaxed", far_at[2]), downs))
        for k, at, downs in starts:
            new, ups, left = self.upgrade(k)
            finals.append((new, at, ups, downs, left))
        win = finals[0]
        for f in finals[1:]:
            if self.beats(f[0], win[0], True):
                win = f
        k, at, ups, downs, left = win
        relaxed = at[2]
        return k, {
            "lambda_star": at[0], "relaxed": relaxed, "num_upgrades": ups, "num_downgrades": downs,
            "search_iterations": done, "selected_candidate_origin": at[1] + ("_upgraded" if ups else ""),
            "tolerance_reached": reached, "positive_gain_moves_remaining": left
        }


def _in_one_task(p: Problem, max_iter: int, tolerance: float, low: float, high: float) -> tuple[DataFrame, dict]:
    """`docno`, `profile`, `utility`, `cost_bytes` of a small problem, and its report, which alone reaches the driver."""
    names, costs, budget = p.names, p.costs, p.budget

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        docno = pa.chunked_array([b.column("docno") for b in held], pa.string()).combine_chunks()
        u = np.concatenate(
            [b.column("u").flatten().to_numpy(zero_copy_only=False) for b in held] or [np.zeros(0)]
        ).astype(np.float64).reshape(len(docno), len(costs))
        order = np.array(sorted(range(len(docno)), key=docno.to_pylist().__getitem__), np.int64)
        own = Local(u[order], costs, budget)
        k, report = own.solve(max_iter, tolerance, low, high)
        report["total"] = own.value(k)
        columns = [
            docno.take(pa.array(order)), pa.array(names, pa.string()).take(pa.array(k)), pa.array(own.u[own.rows, k]),
            pa.array(own.c[k]), pa.nulls(len(k), pa.string())
        ]
        kinds = ["docno", "profile", "utility", "cost_bytes", "report"]
        yield pa.RecordBatch.from_arrays(columns, names=kinds)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, c.type) for c in columns[:4]] + [pa.array([json.dumps(report)])], names=kinds)

    made = kept(
        p.wide.select("docno", "u").repartition(1).mapInArrow(
            kernel, "docno string, profile string, utility double, cost_bytes long, report string"
        )
    )
    report = json.loads(made.where("report IS NOT NULL").first()["report"])
    return made.where("report IS NULL").drop("report"), report


@dataclass
class Strategies:
    """What a solution is made of; each can be replaced. Given any, the problem is solved by passes over the table."""

    search: Callable[..., Search] = search
    upgrade: Callable[[Problem, Candidate], Candidate] = upgrade
    downgrade: Callable[[Problem, Candidate], Candidate] = downgrade
    better: Callable[[Candidate, Candidate | None, int], bool] = better_feasible


ALGORITHMS = {"lagrangian_relaxation": Strategies, "lagrangian_dual": Strategies}


def strategies(algorithm: str) -> Strategies:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"optimization.algorithm is one of {sorted(ALGORITHMS)}, not {algorithm}")
    return ALGORITHMS[algorithm]()


def solve(
    utility: DataFrame, profiles: list[Profile], budget: int, max_iter: int = 64, tolerance: float = 1e-3,
    low: float = 0.0, high: float = 1.0, dtype: str = "float16", local: int = LOCAL, by: Strategies | None = None
) -> Solution:
    """The best of: the relaxation's best choice upgraded, the cheapest upgraded, the closest infeasible one downgraded and upgraded."""
    p = build(utility, profiles, budget, dtype)
    if by is None and p.n * len(p.costs) <= local:
        made, r = _in_one_task(p, max_iter, tolerance, low, high)
        (cost, value), relaxed = r.pop("total"), r.pop("relaxed")
        return Solution(made, _report(p, cost, value / UNITS, None if relaxed is None else (relaxed[0], relaxed[1] / UNITS), r))
    by = by or Strategies()
    base = cheapest(p)
    found = by.search(p, base, max_iter, tolerance, low, high)
    finals = [by.upgrade(p, found.best)]
    if found.best is not base:
        finals.append(by.upgrade(p, base))
    if found.infeasible is not None:
        finals.append(by.upgrade(p, by.downgrade(p, found.infeasible)))
    best = finals[0]
    for c in finals[1:]:
        if by.better(c, best, p.budget):
            best = c
    r = {
        "lambda_star": best.lam, "num_upgrades": best.upgrades, "num_downgrades": best.downgrades,
        "search_iterations": found.iterations, "selected_candidate_origin": best.origin,
        "tolerance_reached": found.reached, "positive_gain_moves_remaining": best.moves_left
    }
    return Solution(
        assignments(kept(best.chosen), p),
        _report(
            p, best.cost, float(best.utility),
            None if best.relaxed_cost is None else (best.relaxed_cost, float(best.relaxed_utility)), r
        )
    )


def _report(p: Problem, cost: int, utility: float, relaxed: tuple[int, float] | None, more: dict) -> dict:
    return {
        "total_cost_bytes": cost, "total_utility": utility, "feasible": True, "num_docs": p.n, "budget_bytes": p.budget,
        "pre_repair_relaxed_cost_bytes": relaxed and relaxed[0], "pre_repair_relaxed_utility": relaxed and relaxed[1],
        "unused_budget_bytes": p.budget - cost, "budget_utilization_ratio": cost / max(p.budget, 1), **more
    }


def online(stream: DataFrame, costs: list[int], names: list[str], lam: float) -> DataFrame:
    """Each arriving document's profile at a fixed multiplier, from its array of utilities `u`; works on streams."""
    k = choice(F.col("u"), costs, lam)
    return stream.withColumn("k", k).withColumn("profile", F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1))


def repair_by_single_moves(
    rows: list[tuple[str, list[float], int]], costs: list[int], names: list[str], budget: int
) -> list[tuple[str, list[float], int]]:
    """The former repair, for small problems that are on the driver anyway: the single cheapest downgrade (loss for a byte, docno,
    profile), again and again.
    """
    rows = list(rows)
    while sum(costs[k] for _, _, k in rows) > budget:
        moves = [
            ((u[k] - u[t]) / (costs[k] - costs[t]), d, names[t], i, t) for i,
            (d, u, k) in enumerate(rows) for t in range(len(costs)) if costs[t] < costs[k]
        ]
        if not moves:
            raise RuntimeError("no downgrade is left")
        *_, i, t = min(moves)
        rows[i] = (*rows[i][:2], t)
    return rows


