"""Problem 5: one ranking of all items from pairwise wins and losses.

Robust absolute-loss ranking: strengths minimise the sum over pairs of
weight * |s_a - s_b - margin|, where a margin is the log-odds of a winning
against b. Iteratively reweighted Laplacian solves do this: each round solves a
Laplacian system in which a pair counts the less the more it contradicts the
strengths so far. A weak prior pulls all strengths to 0, which anchors
components that never met.

The loss is rounded off below ``EPS`` (a thousandth of a log-odd), so that with
the prior there is exactly one best answer. Rounds end when the slope of the
loss at every item is nothing but rounding; anything else is an error, never a
ranking. The rounds (:func:`settle`) are the same for every size; only where
the numbers lie differs (:class:`Held`, :class:`Spread`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.functions.boards import sha_label
from plyforge.operators.skew import HOT_ROWS, hot_hashes, looked_up, numbered
from plyforge.session import cut, release

#: Pairs and items up to which their numbers are held by the driver (four and two arrays, about 70 MB).
DRIVER_PAIRS, DRIVER_ITEMS = 2_000_000, 500_000
#: Items up to which a vector of them is broadcast (16 bytes each) instead of shuffled.
BROADCAST_ITEMS = 1_000_000
#: Weight of the prior against that of one game, and the residual below which the loss is rounded off.
PRIOR, EPS = 1e-3, 1e-3
#: Slope, in shares of an item's weight, at which strengths are final; rounds and steps of a round at most.
CLOSE, ROUNDS = 1e-10, 500
#: Lengths of a step that are tried at once.
LENGTHS = tuple(2.0**-k for k in range(14))


def distinct_results(records: DataFrame) -> DataFrame:
    """(``a``, ``b``, ``wins``, ``losses``) of every record once.

    A record sent again (same ``record_id``) counts once: the smallest of its
    rows does. Rows without ``record_id`` are told apart by all that counts.
    Hashes are compared in lower case, without outer blanks or a scheme prefix.
    """
    a, b = sha_label(F.col("candidate_sha256")), sha_label(F.col("opponent_sha256"))
    n = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("bigint")
    told = F.concat_ws(" ", F.lit("none"), a, b, "run_id", "recorded_at", n("wins"), n("losses"))
    result = F.struct(a.alias("a"), b.alias("b"), n("wins").alias("wins"), n("losses").alias("losses"))
    rows = records.select(F.coalesce(sha_label(F.col("record_id")), told).alias("id"), result.alias("r"))
    return rows.groupBy("id").agg(F.min("r").alias("r")).select("r.*")


def pair_margins(results: DataFrame) -> DataFrame:
    """(``a`` < ``b``, ``margin``, ``weight``): log-odds of each pair that met in a decided game, all its records added up.

    Half a game is added to either side, so that a clean sheet stays finite.
    The weight is the inverse standard error of the margin.
    """
    met = results.filter((F.col("a") != F.col("b")) & (F.col("wins") + F.col("losses") > 0))
    turn = F.col("a") > F.col("b")
    won = F.when(turn, F.col("losses")).otherwise(F.col("wins"))
    lost = F.when(turn, F.col("wins")).otherwise(F.col("losses"))
    sides = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), won.alias("w"), lost.alias("l"))
    total = sides.groupBy("a", "b").agg(F.sum("w").alias("w"), F.sum("l").alias("l"))
    w, l = F.col("w") + 0.5, F.col("l") + 0.5  # noqa: E741
    return total.select("a", "b", F.log(w / l).alias("margin"), F.sqrt(1 / (1 / w + 1 / l)).alias("weight"))


class NotSettled(RuntimeError):
    """The strengths didn't reach the best answer; there is no ranking."""


def settle(graph: Held | Spread, eps_end: float = EPS, close: float = CLOSE, rounds: int = ROUNDS) -> None:
    """Move the strengths of ``graph`` to the one best answer.

    A round solves the Laplacian system whose weights are the curvatures of the
    loss, and where that overshoots the next one the system of the reweighted
    least squares, which never does; of several lengths of the step the best is
    taken. The rounding begins wide and narrows as the slope falls.
    """
    eps, curved, slope = 1.0, True, np.inf
    for _ in range(rounds):
        slope = graph.slope(eps)
        while slope < 1e-2 and eps > eps_end:
            eps = max(eps_end, eps * 0.3)
            slope = graph.slope(eps, moved=False)
        if slope < close:
            return
        graph.direct(eps, curved, 1e-16 if slope < 1e-6 else min(1e-2, slope * slope) ** 2)
        change = graph.changes(eps)
        best = int(np.argmin(change))
        if change[best] >= 0:
            if slope < 1000 * close:
                return  # no step improves what double precision can tell
            best = len(LENGTHS) - 1
        graph.move(LENGTHS[best])
        curved = not (curved and LENGTHS[best] < 0.25)
    raise NotSettled(f"after {rounds} rounds the slope is still {slope:.3g}")


class Held:
    """Numbers of pairs (``i``, ``j``, margin, weight) and of ``n`` items as arrays."""

    def __init__(self, i: np.ndarray, j: np.ndarray, margin: np.ndarray, weight: np.ndarray, n: int, prior: float = PRIOR):
        self.i, self.j, self.margin, self.weight, self.n, self.prior = i, j, margin, weight, n, prior
        self.s = np.zeros(n)
        self.scale = np.bincount(i, weight, n) + np.bincount(j, weight, n) + prior

    def slope(self, eps: float, moved: bool = True) -> float:
        self.r = self.s[self.i] - self.s[self.j] - self.margin
        u = self.weight * self.r / np.sqrt(self.r**2 + eps**2)
        self.g = np.bincount(self.i, u, self.n) - np.bincount(self.j, u, self.n) + self.prior * self.s
        return float((np.abs(self.g) / self.scale).max(initial=0))

    def direct(self, eps: float, curved: bool, tolerance: float) -> None:
        i, j, n = self.i, self.j, self.n
        f = np.sqrt(self.r**2 + eps**2)
        c = self.weight * eps**2 / f**3 if curved else self.weight / f
        degree = np.bincount(i, c, n) + np.bincount(j, c, n) + self.prior
        times = lambda v: degree * v - np.bincount(i, c * v[j], n) - np.bincount(j, c * v[i], n)
        d, r = np.zeros(n), -self.g
        p = r / degree
        rz = first = r @ p
        for _ in range(max(1000, 20 * n)):
            if rz <= tolerance * first:
                break
            q = times(p)
            a = rz / (p @ q)
            d += a * p
            r -= a * q
            z = r / degree
            rz, old = r @ z, rz
            p = z + rz / old * p
        else:
            raise NotSettled(f"the residual is still {rz:.3g}")
        self.d = d

    def changes(self, eps: float) -> np.ndarray:
        dd, r = self.d[self.i] - self.d[self.j], self.r
        f = np.sqrt(r**2 + eps**2)
        loss = lambda a: (self.weight * (np.sqrt((r + a * dd) ** 2 + eps**2) - f)).sum()
        own = lambda a: self.prior / 2 * (2 * a * (self.s @ self.d) + a * a * (self.d @ self.d))
        return np.array([loss(a) + own(a) for a in LENGTHS])

    def move(self, a: float) -> None:
        self.s = self.s + a * self.d


class Spread:
    """The same with tables: pairs (``i``, ``j``, ``margin``, ``weight``) and items (``i``).

    A step of the conjugate gradients is one join of the pairs with the search
    direction and one aggregation by item with map-side combine, written to the
    shared folder; only sums reach the driver. The direction is broadcast while
    it fits, else joined by shuffle with the items that everybody meets apart.
    """

    def __init__(self, pairs: DataFrame, items: DataFrame, n: int, prior: float = PRIOR, broadcast: int = BROADCAST_ITEMS, hot_rows: int = HOT_ROWS):
        turned = pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("margin")).alias("margin"), "weight")
        self.both = cut(pairs.select("i", "j", "margin", "weight").unionByName(turned), "bothways")
        self.prior, self.n, self.small = prior, n, n <= broadcast
        self.hot = None if self.small else hot_hashes(self.both.select("i"), ["i"], hot_rows)
        weights = self.both.groupBy("i").agg(F.sum("weight").alias("w"))
        scale = F.coalesce(F.col("w"), F.lit(0.0)) + F.lit(prior)
        self.v = self.kept = cut(items.join(weights, "i", "left").select("i", F.lit(0.0).alias("s"), scale.alias("scale")), "strengths")
        self.edges: DataFrame | None = None

    def _at(self, edges: DataFrame, end: str, column: str, out: str) -> DataFrame:
        facts = self.v.select(F.col("i").alias(end), F.col(column).alias(out))
        if self.small:
            return edges.join(F.broadcast(facts), end)
        return looked_up(edges, facts, [end], hot=self.hot)

    def _step(self, v: DataFrame) -> None:
        before, self.kept = self.kept, cut(v, "vectors")
        self.v = self.kept
        release(before)

    def _sum(self, *terms: Column) -> list[float]:
        return [x or 0.0 for x in self.v.agg(*[F.sum(t) for t in terms]).first()]

    def slope(self, eps: float, moved: bool = True) -> float:
        if moved:
            ends = self._at(self._at(self.both, "i", "s", "a"), "j", "s", "b")
            before, self.edges = self.edges, cut(ends.select("i", "j", "weight", (F.col("a") - F.col("b") - F.col("margin")).alias("r")), "edges")
            if before is not None:
                release(before)
        f = F.sqrt(F.col("r") * F.col("r") + F.lit(eps * eps))
        pull = self.edges.groupBy("i").agg(F.sum(F.col("weight") * F.col("r") / f).alias("u"))
        g = F.coalesce(F.col("u"), F.lit(0.0)) + F.lit(self.prior) * F.col("s")
        self._step(self.v.select("i", "s", "scale").join(pull, "i", "left").select("i", "s", "scale", g.alias("g")))
        return self.v.agg(F.coalesce(F.max(F.abs(F.col("g")) / F.col("scale")), F.lit(0.0))).first()[0]

    def direct(self, eps: float, curved: bool, tolerance: float) -> None:
        f = F.sqrt(F.col("r") * F.col("r") + F.lit(eps * eps))
        c = F.col("weight") * F.lit(eps * eps) / (f * f * f) if curved else F.col("weight") / f
        edges = self.edges.select("i", "j", c.alias("c"))
        sums = edges.groupBy("i").agg(F.sum("c").alias("c"))
        v = self.v.join(sums, "i", "left").withColumn("degree", F.coalesce("c", F.lit(0.0)) + F.lit(self.prior))
        v = v.withColumns({"d": F.lit(0.0), "q": F.lit(0.0), "e": -F.col("g"), "p": -F.col("g") / F.col("degree")})
        names = ["i", "s", "scale", "g", "degree", "d", "q", "e", "p"]
        self._step(v.select(*names))
        rz = first = self._sum(F.col("e") * F.col("p"))[0]
        for _ in range(max(1000, 20 * self.n)):
            if rz <= tolerance * first:
                return
            pulled = self._at(edges, "j", "p", "x").groupBy("i").agg(F.sum(F.col("c") * F.col("x")).alias("pull"))
            q = F.col("degree") * F.col("p") - F.coalesce(F.col("pull"), F.lit(0.0))
            self._step(self.v.drop("q").join(pulled, "i", "left").withColumn("q", q).select(*names))
            e, q, degree = F.col("e"), F.col("q"), F.col("degree")
            a = rz / self._sum(F.col("p") * q)[0]
            self.v = self.v.withColumns({"d": F.col("d") + F.lit(a) * F.col("p"), "e": e - F.lit(a) * q})
            old, rz = rz, self._sum(e * e / degree)[0]
            self.v = self.v.withColumn("p", e / degree + F.lit(rz / old) * F.col("p"))
        raise NotSettled(f"the residual is still {rz:.3g}")

    def changes(self, eps: float) -> np.ndarray:
        ends = self._at(self._at(self.edges, "i", "d", "a"), "j", "d", "b").withColumn("dd", F.col("a") - F.col("b"))
        r, e2 = F.col("r"), F.lit(eps * eps)
        f = F.sqrt(r * r + e2)
        far = lambda a: r + F.lit(a) * F.col("dd")
        # every pair stands there twice
        losses = ends.agg(*[F.sum(F.col("weight") * (F.sqrt(far(a) * far(a) + e2) - f)) / 2 for a in LENGTHS]).first()
        sd, d2 = self._sum(F.col("s") * F.col("d"), F.col("d") * F.col("d"))
        return np.array([(x or 0.0) + self.prior / 2 * (2 * a * sd + a * a * d2) for x, a in zip(losses, LENGTHS, strict=True)])

    def move(self, a: float) -> None:
        self._step(self.v.select("i", (F.col("s") + F.lit(a) * F.col("d")).alias("s"), "scale"))


def strengths(records: DataFrame, driver_pairs: int = DRIVER_PAIRS, driver_items: int = DRIVER_ITEMS, **spread) -> tuple[DataFrame, DataFrame]:
    """(items with ``i``, ``item``, ``strength``; pairs with ``i``, ``j``, ``margin``, ``weight``).

    Pairs are added up and items numbered on the executors. Up to
    ``driver_pairs`` pairs of ``driver_items`` items their numbers, never names,
    come to the driver; beyond that they stay tables.
    """
    results = cut(distinct_results(records), "results")
    met = results.select(F.explode(F.array("a", "b")).alias("item")).filter("item is not null").distinct()
    items = cut(numbered(met, ["item"], "i"), "items")
    end = lambda c, n: items.select(F.col("item").alias(c), F.col("i").alias(n))
    named = cut(pair_margins(results), "named")
    hot = hot_hashes(named.select(F.explode(F.array("a", "b")).alias("item")), ["item"])
    pairs = looked_up(looked_up(named, end("a", "i"), ["a"], hot=hot), end("b", "j"), ["b"], hot=hot)
    pairs = cut(pairs.select("i", "j", "margin", "weight"), "pairs")
    release(named), release(results)
    n_items, n_pairs = items.count(), pairs.count()
    if n_pairs > driver_pairs or n_items > driver_items:
        graph = Spread(pairs, items.select("i"), n_items, **spread)
        settle(graph)
        return items.join(graph.v.select("i", F.col("s").alias("strength")), "i"), pairs
    t = pairs.toArrow()
    i, j, margin, weight = (t.column(c).to_numpy() for c in ("i", "j", "margin", "weight"))
    order = np.lexsort((j, i))
    held = Held(i[order] - 1, j[order] - 1, margin[order], weight[order], n_items)
    settle(held)
    found = pa.table({"i": pa.array(np.arange(1, n_items + 1)), "strength": pa.array(held.s)})
    return items.join(records.sparkSession.createDataFrame(found), "i"), pairs


def rank_items(records: DataFrame, driver_pairs: int = DRIVER_PAIRS, driver_items: int = DRIVER_ITEMS, **spread) -> DataFrame:
    """(``network_sha256``, ``rank_no``, ``strength``) of every item that occurs in ``records``; rank 1 is the strongest.

    Strengths equal to six decimals are ranked by hash. Draws, matches of an
    item with itself and matches without decided games count nothing, but who
    played them is ranked: an item without any decided game has strength 0.
    Null hashes name no item; null or negative counts are 0. No records give no
    ranking.
    """
    s, pairs = strengths(records, driver_pairs, driver_items, **spread)
    # adding 0.0 makes one zero of both
    s = s.withColumn("near", F.round("strength", 6) + F.lit(0.0))
    ranked = numbered(s, [F.desc("near"), F.asc("item")], "rank_no")
    release(pairs)
    return ranked.select(F.col("item").alias("network_sha256"), "rank_no", "strength")


def slopes(records: DataFrame, **where) -> DataFrame:
    """(``network_sha256``, ``slope``): how far each item is from the best answer, in shares of its weight, from the pairs anew."""
    s, pairs = strengths(records, **where)
    a = s.select("i", F.col("strength").alias("a"))
    b = s.select(F.col("i").alias("j"), F.col("strength").alias("b"))
    r = F.col("a") - F.col("b") - F.col("margin")
    pull = F.col("weight") * r / F.sqrt(r * r + F.lit(EPS * EPS))
    each = pairs.join(a, "i").join(b, "j").select("i", "j", pull.alias("u"), "weight")
    ends = each.select("i", "u", "weight").unionByName(each.select(F.col("j").alias("i"), (-F.col("u")).alias("u"), "weight"))
    per = ends.groupBy("i").agg(F.sum("u").alias("u"), F.sum("weight").alias("w"))
    zero = F.lit(0.0)
    g = F.coalesce("u", zero) + F.lit(PRIOR) * F.col("strength")
    share = F.abs(g) / (F.coalesce("w", zero) + F.lit(PRIOR))
    return s.join(per, "i", "left").select(F.col("item").alias("network_sha256"), share.alias("slope"))
