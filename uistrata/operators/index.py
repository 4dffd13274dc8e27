"""Queries on rows of states: search, salience, curated states, narration and cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sequence import normalized

W_TEXT, W_SHARP, W_EVENT, SPREAD = 0.6, 0.3, 0.1, 0.15


def search_index(states: DataFrame, pattern: str | None = None, since: float | None = None, until: float | None = None, event_type: str | None = None) -> DataFrame:
    """States that meet every filter given, with the lines that match.  Times are closed overlaps; text is a literal substring in any case."""
    out = states
    if since is not None:
        out = out.where(F.col("t_end") >= since)
    if until is not None:
        out = out.where(F.col("t_start") <= until)
    if event_type is not None:
        out = out.where(F.col("event.type") == event_type)
    matches = F.array().cast("array<string>")
    if pattern:
        matches = F.filter("lines", lambda x: F.contains(F.lower(x), F.lit(pattern.lower())))
        out = out.where(F.size(matches) > 0)
    return out.select("rec", "idx", "t_start", "t_end", F.col("event.type").alias("event_type"), matches.alias("matches"))


def event_histogram(states: DataFrame) -> DataFrame:
    return states.where(F.col("event").isNotNull()).groupBy("rec", F.col("event.type").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


def with_salience(states: DataFrame, sharpness: Column | None = None) -> DataFrame:
    by = W.partitionBy("rec")
    change = (F.size("added") + F.size("removed")).cast("double")
    sharp = normalized(sharpness, by) if sharpness is not None else F.lit(0.0)
    score = W_TEXT * normalized(change, by) + W_SHARP * sharp + W_EVENT * F.col("event").isNotNull().cast("double")
    return states.withColumn("salience", F.round(score, 4))


def greedy(saliences: Column, budget: int) -> Column:
    """Places (from 0) of up to ``budget`` values, greedily by value and distance to those chosen; ties to the earliest.

    A fold on the JVM: ``budget`` steps over the values.
    """
    if budget <= 0:
        return F.array().cast("array<int>")

    def step(chosen: Column, _: Column) -> Column:
        def value(s: Column, i: Column) -> Column:
            d = F.array_min(F.transform(chosen, lambda c: F.abs(i - c))).cast("double")
            bonus = F.when(F.size(chosen) > 0, SPREAD * (1 - 1 / (1 + d))).otherwise(0.0)
            return F.struct((s + bonus).alias("v"), (-i).alias("back"), F.array_contains(chosen, i).alias("used"))

        best = F.array_max(F.filter(F.transform(saliences, value), lambda z: ~z["used"]))
        return F.when(best.isNull(), chosen).otherwise(F.concat(chosen, F.array(-best["back"])))

    n = F.size(saliences)
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(n <= budget, every).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(budget)), F.array().cast("array<int>"), step))


def curated(states: DataFrame, budget: int) -> DataFrame:
    """Up to ``budget`` states a recording, as ``greedy`` has it."""
    rows = states.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("pos", "salience", "idx", "t_start"))).alias("all"))
    picks = greedy(F.transform("all", lambda s: s["salience"]), budget)
    return rows.select("rec", F.explode(F.transform(picks, lambda i: F.get(F.col("all"), i))).alias("s")).select("rec", "s.pos", "s.idx", "s.t_start", "s.salience")


def overlapping(states: DataFrame, narration: DataFrame) -> DataFrame:
    """(rec, idx, n, text) for every narration that overlaps a state, both ends open.

    The states of a recording do not overlap one another, so those that a
    narration meets follow one another: from the first that ends after its start
    to the last that begins before its end.  One sweep over all ends of both
    counts where these are, and only pairs that meet are made: the cost is that of
    a sort and of the result, not of states times narrations.
    """
    by = W.partitionBy("rec")
    numbered = states.select("rec", "idx", "t_start", "t_end").withColumn("at", F.row_number().over(by.orderBy("t_start", "t_end", "idx")) - 1)

    def mark(t: str | Column, order: int, begun: int = 0, ended: int = 0, first: bool = False, last: bool = False) -> Column:
        return F.struct(F.col(t).cast("double").alias("t") if isinstance(t, str) else t, F.lit(order).alias("order"), F.lit(begun).alias("begun"), F.lit(ended).alias("ended"), F.lit(first).alias("first"), F.lit(last).alias("last"))

    # At one time: a narration ends before a state begins, and a state ends before a narration begins.
    edges = numbered.select("rec", F.explode(F.array(mark("t_start", 1, begun=1), mark("t_end", 2, ended=1))).alias("m"))
    told = narration.select("rec", "n", "start", "end", "text").withColumn("said", F.monotonically_increasing_id())
    asked = told.select("rec", "said", "n", "text", F.explode(F.array(mark("end", 0, last=True), mark("start", 3, first=True))).alias("m"))
    line = edges.unionByName(asked, allowMissingColumns=True).select("rec", "said", "n", "text", "m.*")
    so_far = by.orderBy("t", "order").rowsBetween(W.unboundedPreceding, 0)
    line = line.withColumns({"begun": F.sum("begun").over(so_far), "ended": F.sum("ended").over(so_far)}).where("said is not null")
    spans = line.groupBy("rec", "said").agg(F.max(F.when(F.col("first"), F.col("ended"))).alias("lo"), F.max(F.when(F.col("last"), F.col("begun"))).alias("hi"), F.first("n").alias("n"), F.first("text").alias("text"))
    met = spans.where("lo < hi").select("rec", "n", "text", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("at"))
    return met.join(numbered.select("rec", "at", "idx"), ["rec", "at"]).select("rec", "idx", "n", "text")


def narration_of(states: DataFrame, narration: DataFrame) -> DataFrame:
    """(rec, idx, said): texts of narration that overlaps a state, in narration order."""
    return overlapping(states, narration).groupBy("rec", "idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ").alias("said"))


def with_cursor(states: DataFrame, cursor: DataFrame) -> DataFrame:
    """``states`` with xs and ys, the cursor positions inside each (both ends closed) in time order; NULL where there are none.

    The states of a recording do not overlap, so a position belongs to the last
    state that begins before it, if to any: states and positions share one window
    and one aggregate, without a join of ranges.
    """
    state = F.struct(*states.columns)
    spot = F.struct("t", "x", "y")
    s = states.select("rec", F.col("t_start").alias("t"), F.lit(0).alias("kind"), F.struct("idx", "t_end").alias("s"), state.alias("state"), F.lit(None).cast(cursor.select(spot.alias("p")).schema["p"].dataType).alias("p"))
    c = cursor.select("rec", F.col("t").cast("double").alias("t"), F.lit(1).alias("kind"), *[F.lit(None).cast(s.schema[n].dataType).alias(n) for n in ("s", "state")], spot.alias("p"))
    by = W.partitionBy("rec").orderBy("t", "kind").rowsBetween(W.unboundedPreceding, 0)
    met = s.unionByName(c).withColumn("in", F.last("s", ignorenulls=True).over(by)).where("kind = 0 or t <= in.t_end")
    got = met.groupBy("rec", F.col("in.idx").alias("idx")).agg(F.first("state", ignorenulls=True).alias("state"), F.sort_array(F.collect_list("p")).alias("p"))
    axis = lambda a: F.when(F.size("p") > 0, F.transform("p", lambda z: z[a]))
    return got.select(*[F.col(f"state.{n}").alias(n) for n in states.columns], axis("x").alias("xs"), axis("y").alias("ys"))


def cursor_of(states: DataFrame, cursor: DataFrame) -> DataFrame:
    """(rec, idx, xs, ys) of the states with cursor positions inside."""
    return with_cursor(states.select("rec", "idx", "t_start", "t_end"), cursor).where("xs is not null").select("rec", "idx", "xs", "ys")
