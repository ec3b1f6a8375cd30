"""Problem 8: texts drawn so that sources have target shares of the tokens.

Iterative proportional fitting rakes the repeat rates of cells (source,
language, topic) to the marginals, under each source's cap. Texts are then
drawn by their cell's rate: the whole part for certain, the fraction by a
permanent random number, calibrated once for each source so that the tokens
drawn, not only those expected, meet the target.

A rate is the least of the cap and a product of three factors, of the source,
the language and the topic. The factor of a source follows from those of
language and topic (:func:`source_rates`), so that only the latter are kept,
eleven numbers, and any number of sources can be fitted where they lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyforge.functions.boards import label
from plyforge.llm.tokens import VOCABULARY, with_token_counts
from plyforge.operators.skew import hot_hashes, looked_up
from plyforge.session import cut, map_arrow, release

# The languages and kinds of text told apart; all others are "other".
LANGUAGES = ("en", "de", "es", "ru")
TOPICS = ("prose", "pgn", "log", "table", "mixed")
#: Cells of a source.
SHAPE = (len(LANGUAGES) + 1, len(TOPICS) + 1)
#: Steps in which the calibrating threshold is found, and sources up to which their tokens are held by the driver and broadcast.
BINS, MOST_SOURCES = 8192, 20_000


def source_key(source: Column) -> Column:
    """Blank, hyphen and underscore are the same in source names, as are upper and lower case."""
    return F.nullif(F.regexp_replace(label(source), r"[\s_\-\u00a0]+", "_"), F.lit(""))


def source_rates(tokens: np.ndarray, want: np.ndarray, cap: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Rates [source, cell] = min(cap, x * factor) with the x of each source that gives it ``want`` tokens.

    Exact: the tokens grow with x in straight lines that bend where a cell
    meets the cap, and the bends are tried in order. A source that can't give
    so many has every rate at its cap.
    """
    there = tokens > 0
    a = np.where(there, np.maximum(factor, 1e-12), 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        bend = np.where(there, cap[:, None] / a, np.inf)
        order = np.argsort(bend, 1, kind="stable")
        take = lambda m: np.take_along_axis(m, order, 1)
        capped = np.cumsum(take(tokens), 1) - take(tokens)
        open_ = np.cumsum(take(a * tokens)[:, ::-1], 1)[:, ::-1]
        x = (want[:, None] - cap[:, None] * capped) / open_
        fits = (x <= take(bend)) & (open_ > 0)
    first = fits.argmax(1)
    at = np.where(fits.any(1), x[np.arange(len(x)), first], np.inf) if x.shape[1] else np.full(len(x), np.inf)
    full = (want >= cap * tokens.sum(1)) | ~np.isfinite(at)
    rate = np.where(full[:, None], cap[:, None], np.minimum(cap[:, None], np.where(full, 0.0, at)[:, None] * a))
    return np.where(there & (want > 0)[:, None], rate, 0.0)


def fit_factors(
    reached: Callable[[np.ndarray], np.ndarray], language: np.ndarray, topic: np.ndarray, sweeps: int = 200, close: float = 1e-4
) -> np.ndarray:
    """Factors [language, topic] under which the tokens reached have the marginals, as far as the sources allow.

    ``reached`` tells the tokens [language, topic] under given factors, after
    the sources took theirs. Languages and topics are adjusted in turn, until
    neither is off by more than ``close`` or nothing gets better any more.
    Shares of what holds no tokens are unreachable and left out.
    """
    y, z = np.ones(len(language)), np.ones(len(topic))
    best, kept, stuck = np.inf, np.outer(y, z), 0
    for k in range(2 * sweeps):
        m = reached(np.outer(y, z))
        miss = max(_miss(m, language, topic).values())
        if miss < best - close / 100:
            best, kept, stuck = miss, np.outer(y, z), 0
        else:
            stuck += 1
        if best < close or stuck >= 12:
            break
        have, share, factor = (m.sum(1), language, y) if k % 2 == 0 else (m.sum(0), topic, z)
        goal = share * (have > 0)
        goal = goal / max(1e-300, goal.sum()) * have.sum()
        factor *= np.divide(goal, have, out=np.ones_like(have), where=(have > 0) & (goal > 0))
    return kept


def _miss(m: np.ndarray, language: np.ndarray, topic: np.ndarray) -> dict[str, float]:
    """How far the shares of languages and topics in ``m`` are from those wanted, at most."""
    out = {}
    for name, have, share in (("language", m.sum(1), language), ("topic", m.sum(0), topic)):
        share = share * (have > 0)
        out[name] = float(np.abs(have / max(1e-300, have.sum()) - share / max(1e-300, share.sum())).max(initial=0))
    return out


@dataclass
class Rates:
    """Repeat rates [source, language, topic] and how far the marginals were met."""

    rate: np.ndarray
    error: dict[str, float]


def rake(
    tokens: np.ndarray, want: np.ndarray, cap: np.ndarray, language: np.ndarray, topic: np.ndarray, sweeps: int = 200, close: float = 1e-4
) -> Rates:
    """Fit rates so that rate * tokens has the marginals, never above the cap of the source.

    ``want`` are tokens for each source, capped at what its texts can give;
    ``language`` and ``topic`` are shares. Sources bind: they come last in
    every sweep, spreading what capped cells can't take over the rest of the
    source.
    """
    flat = tokens.reshape(len(tokens), -1)
    rates = lambda f: source_rates(flat, want, cap, f.reshape(1, -1))
    reached = lambda f: (rates(f) * flat).sum(0).reshape(tokens.shape[1:])
    factors = fit_factors(reached, language, topic, sweeps, close)
    rate = rates(factors)
    able = np.minimum(want, cap * flat.sum(1))
    off = float(np.abs((rate * flat).sum(1) - able).max(initial=0) / max(1e-300, able.sum()))
    return Rates(rate.reshape(tokens.shape), {"source": off, **_miss(reached(factors), language, topic)})


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens [source, cell], want, cap) of a batch of sources."""
    tokens = np.zeros((b.num_rows, SHAPE[0] * SHAPE[1]))
    for i, cells in enumerate(b.column("cells").to_pylist()):
        for c in cells or ():
            tokens[i, c["cell"]] = c["n"]
    return tokens, b.column("want").to_numpy(), b.column("max_repeats").to_numpy().astype(float)


def _reached_by(sources: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """Tokens reached under given factors, summed over batches of sources where they lie."""

    def reached(factors: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(factors.size)
            for b in batches:
                tokens, want, cap = _columns(b)
                total += (source_rates(tokens, want, cap, factors.reshape(1, -1)) * tokens).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total)], ["cell", "n"])

        rows = map_arrow(sources.select("cells", "want", "max_repeats"), run, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n"))
        out = np.zeros(factors.size)
        for r in rows.collect():
            out[r.cell] = r.n
        return out.reshape(factors.shape)

    return reached


def _planned(sources: DataFrame, factors: np.ndarray) -> DataFrame:
    """(``key``, ``cell``, ``sure``, ``part``) of every cell with tokens: how often its texts are drawn for certain, and how probably once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, want, cap = _columns(b)
            rate = source_rates(tokens, want, cap, factors.reshape(1, -1))
            at, cell = np.nonzero(tokens > 0)
            r = rate[at, cell]
            sure = np.floor(r + 1e-9)
            part = np.maximum(0.0, r - sure)
            cols = [b.column("key").take(pa.array(at)), pa.array(cell.astype(np.int32)), pa.array(sure.astype(np.int32)), pa.array(part)]
            yield pa.RecordBatch.from_arrays(cols, ["key", "cell", "sure", "part"])

    return map_arrow(sources.select("key", "cells", "want", "max_repeats"), run, "key string, cell int, sure int, part double")


@dataclass
class Mixture:
    """``drawn`` (doc_id, source, times, n_tokens), the ``report`` of each target source, the ``margins`` of languages and topics.

    ``error`` is how far the fitted margins are from those wanted, ``noise`` the
    most that the standard deviation of a share drawn at random can be.
    """

    drawn: DataFrame
    report: DataFrame
    margins: DataFrame
    error: dict[str, float]
    noise: float


def mix(
    docs: DataFrame, targets: DataFrame, budget: int | None = None, language_shares: dict[str, float] | None = None,
    topic_shares: dict[str, float] | None = None, seed: str = "mix-v1", path: str = VOCABULARY, most_sources: int = MOST_SOURCES
) -> Mixture:
    """Draw texts of ``docs`` to the shares of ``targets`` (source, target_share, max_repeats).

    ``budget`` is the number of tokens to draw, by default as many as the
    target sources hold. Language and topic shares are by default those of the
    target sources' texts; where they contradict the sources, the sources
    win. A source whose every text was drawn ``max_repeats`` times and that
    still is short of its share of the budget is reported with ``reachable``
    false; nothing else takes its place, so the others reach their share of the
    budget and, of what was drawn, a little more: the report has both. Drawing
    depends on ``doc_id`` and ``seed`` alone.

    Texts of null or unknown source are never drawn; a null or unknown language
    or kind counts as ``other``; empty texts have no tokens and are drawn like
    their cell. Repeated texts are documents of their own. A target source
    without documents is reported with zero tokens; a null share or cap counts
    as 0. Spellings of one source in ``targets`` are added up, with the largest
    cap. Up to ``most_sources`` sources are fitted by the driver and broadcast;
    more are fitted where they lie, in the same sweeps, and joined by shuffle.
    """
    number = lambda c, kind: F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind))
    goal = targets.groupBy(source_key(F.col("source")).alias("key")).agg(
        F.min(F.trim("source")).alias("source"), F.sum(number("target_share", "double")).alias("target_share"), F.max(number("max_repeats", "int")).alias("max_repeats")
    )
    goal = cut(goal.filter("key is not null"), "goals")
    few = goal.count() <= most_sources
    near = F.broadcast if few else (lambda x: x)
    place = lambda c, names: F.coalesce(
        F.nullif(F.array_position(F.lit(list(names)), label(F.col(c))), F.lit(0)), F.lit(len(names) + 1)
    ) - 1
    cell = (place("lang", LANGUAGES) * SHAPE[1] + place("doc_kind", TOPICS)).cast("int")
    keyed = docs.select("doc_id", source_key(F.col("source")).alias("key"), cell.alias("cell"), "text")
    keyed = keyed.join(near(goal.select("key")), "key", "left_semi")
    sized = cut(with_token_counts(keyed, path=path), "sized")

    square = F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens"))
    cells = sized.groupBy("key", "cell").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("top"), square.alias("square")).filter("n > 0")
    held = cells.groupBy("key").agg(
        F.collect_list(
            F.struct("cell", F.col("n").cast("double").alias("n"))
        ).alias("cells"), F.sum("n").alias("tokens"), F.max("top").alias("largest_text"), F.sum("square").alias("square")
    )
    joined = cut(goal.join(held, "key", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("bigint")), "joined")
    total, squares = joined.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("square"), F.lit(0.0))).first()
    drawable = float(total if budget is None else budget)
    sources = joined.withColumn("want", F.col("target_share") * F.lit(drawable))

    by_cell = np.zeros(SHAPE[0] * SHAPE[1])
    for r in joined.select(F.explode("cells").alias("c")).groupBy("c.cell").agg(F.sum("c.n").alias("n")).collect():
        by_cell[r.cell] = r.n
    by_cell = by_cell.reshape(SHAPE)
    own = lambda given, names, ax: np.array(
        [given.get(x, 0.0) for x in (*names, "other")]
    ) if given else by_cell.sum(ax) / max(1.0, by_cell.sum())
    language, topic = own(language_shares, LANGUAGES, 1), own(topic_shares, TOPICS, 0)
    if few:
        batches = sources.select("cells", "want", "max_repeats").toArrow().combine_chunks().to_batches()
        tokens, want, cap = map(
            np.concatenate, zip(*map(_columns, batches), strict=True)
        ) if batches else (np.zeros((0, by_cell.size)), np.zeros(0), np.zeros(0))
        reached = lambda f: (source_rates(tokens, want, cap, f.reshape(1, -1)) * tokens).sum(0).reshape(SHAPE)
    else:
        reached = _reached_by(sources)
    factors = fit_factors(reached, language, topic)
    fitted = reached(factors)
    error = _miss(fitted, language, topic)

    plan = cut(_planned(sources, factors), "plan")
    u = F.conv(
        F.substring(F.sha2(F.concat(F.lit(seed), F.lit("\0"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10
    ).cast("double") / F.lit(float(2**32))
    # cells without tokens have no rate: their texts, all empty, are not drawn
    hot = None if few else hot_hashes(sized, ["key", "cell"])
    rated = looked_up(sized, near(plan), ["key", "cell"], hot=hot).withColumn("z", F.when(F.col("part") > 1e-6, u / F.col("part")))
    bin_ = F.when(F.col("z") < 2, F.floor(F.col("z") * (BINS // 2)))
    bins = rated.groupBy("key", bin_.alias("bin")).agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("sure")).alias("sure"))
    # at most BINS + 2 rows of a source: where to stop so that what was drawn comes nearest to what is wanted
    whole, upto = Window.partitionBy("key"), Window.partitionBy("key").orderBy("bin")
    drawn_by = F.sum(F.when(F.col("bin").isNotNull(), F.col("n")).otherwise(0)).over(upto)
    steps = bins.withColumns({"sure": F.sum("sure").over(whole), "reach": drawn_by}).join(near(sources.select("key", "want")), "key")
    option = lambda stop, reach: F.struct(stop.cast("bigint").alias("stop"), F.abs(reach + F.col("sure") - F.col("want")).alias("miss"))
    stops = F.array(option(F.lit(0), F.lit(0)), F.when(F.col("bin").isNotNull(), option(F.col("bin") + 1, F.col("reach"))))
    steps = steps.select("key", F.explode(F.array_compact(stops)).alias("o"))
    edge = steps.groupBy("key").agg((F.min_by("o.stop", F.struct("o.miss", "o.stop")) / F.lit(BINS // 2)).alias("edge"))
    edge = cut(edge, "edges")
    hot = None if few else hot_hashes(sized, ["key"])
    drawn = looked_up(rated, near(edge), ["key"], hot=hot)
    drawn = drawn.withColumn("times", F.col("sure") + F.when(F.col("z") < F.col("edge"), 1).otherwise(0))
    drawn = cut(drawn.filter("times > 0").select("doc_id", "key", "cell", "n_tokens", "times"), "drawn")
    for done in (sized, plan, edge):
        release(done)

    times = F.col("n_tokens") * F.col("times")
    by = drawn.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.sum(times).alias("drawn_tokens"), F.max("times").alias("most_times"))
    by = cut(by, "by")
    everything = by.agg(F.coalesce(F.sum("drawn_tokens"), F.lit(0))).first()[0]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    got = zero("drawn_tokens")
    short = (got == F.col("tokens") * F.col("max_repeats")) & (got < F.col("want"))
    report = sources.join(by, "key", "left").select(
        "source", "target_share", "max_repeats", "tokens", (~short).alias("reachable"), zero("texts").alias("texts"), got.alias("drawn_tokens"), zero("most_times").alias("most_times"),
        (got / F.lit(float(max(1, everything)))).alias("share_reached"), (got / F.lit(max(1.0, drawable))).alias("share_of_budget"), zero("largest_text").alias("largest_text"),
    )
    spark, names = docs.sparkSession, []
    for ax, (kind, all_names, share) in enumerate((("language", (*LANGUAGES, "other"), language), ("topic", (*TOPICS, "other"), topic))):
        fit = fitted.sum(1 - ax) / max(1.0, fitted.sum())
        names += [(kind, n, k, ax, float(x), float(y)) for k, (n, x, y) in enumerate(zip(all_names, share, fit, strict=True))]
    wanted = spark.createDataFrame(names, "dimension string, name string, place int, axis int, share_wanted double, share_fitted double")
    drawn_cells = drawn.groupBy("cell").agg(F.sum(times).alias("n"))
    sides = drawn_cells.select(
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("axis"), F.floor(F.col("cell") / SHAPE[1]).cast("int").alias("place")),
                F.struct(F.lit(1).alias("axis"), (F.col("cell") % SHAPE[1]).alias("place"))
            )
        ).alias("s"),
        "n"
    )
    sides = sides.groupBy("s.axis", "s.place").agg((F.sum("n") / F.lit(float(max(1, everything)))).alias("share_reached"))
    margins = wanted.join(sides, ["axis", "place"], "left").select(
        "dimension", "name", "share_wanted", "share_fitted", F.coalesce("share_reached", F.lit(0.0)).alias("share_reached")
    )
    named = drawn.join(near(goal.select("key", "source")), "key").select("doc_id", "source", "times", "n_tokens")
    return Mixture(named, report, margins, error, 0.5 * squares**0.5 / max(1, everything))


def broken_rules(mixture: Mixture, share: float = 0.005) -> DataFrame:
    """(``rule``, ``violations``) of a mixture drawn with the default budget.

    ``cap``: sources with a text drawn too often. ``share``: reachable sources
    off their share by more than ``share`` and their largest text. ``full``:
    unreachable ones not drawn to the full. ``reachable``: sources for which plain arithmetic (tokens times
    cap against share times all tokens) tells otherwise. ``margin``: languages
    and topics drawn further from what was fitted than ``share`` and chance (four
    standard deviations) explain.
    """
    r = mixture.report
    total = r.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first().n
    enough = F.col("tokens") * F.col("max_repeats") >= F.col("target_share") * F.lit(float(total))
    rules = {
        "cap": F.col("most_times") > F.col("max_repeats"),
        "share": F.col("reachable") & (
            F.abs(F.col("share_of_budget") - F.col("target_share")) > F.greatest(F.lit(share), F.col("largest_text") / F.lit(float(max(1, total))))
        ),
        "full": ~F.col("reachable") & (F.col("drawn_tokens") != F.col("tokens") * F.col("max_repeats")),
        "reachable": F.col("reachable") != enough,
    }
    counts = r.agg(*[F.count_if(v).alias(k) for k, v in rules.items()])
    off = mixture.margins.agg(F.count_if(F.abs(F.col("share_reached") - F.col("share_fitted")) > share + 4 * mixture.noise).alias("margin"))
    tall = lambda df: df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in df.columns])).alias("x")
    ).select("x.*")
    return tall(counts).unionByName(tall(off))
