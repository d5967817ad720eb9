"""Pairing, intervals, as-of joins and range joins over time or addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import dealt


def pair_start_stop(events: DataFrame, keys: list[str], order: str, is_start: Column, is_stop: Column, carry: list[str]) -> DataFrame:
    """A row for each stop whose predecessor, among starts and stops of its key, is a start.

    That is a pairing in which a new start replaces an open one and a stop uses it up. Columns of
    `carry` come back twice, as start_<c> and stop_<c>.
    """
    ends = events.filter(is_start | is_stop).withColumn("__start", is_start)
    w = Window.partitionBy(*keys).orderBy(order)
    before = {f"start_{c}": F.lag(c).over(w) for c in carry}
    paired = ends.withColumns(before | {"__after_start": F.lag("__start").over(w)})
    return paired.filter(~F.col("__start") & F.col("__after_start")).select(*keys, *before, *[F.col(c).alias(f"stop_{c}") for c in carry])


def _in_cells(spans: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Intervals cut at the borders of time cells and merged within each, all cells in parallel."""
    first, last = F.floor(F.col("start") / cell), F.floor(F.col("end") / cell)
    cut = spans.withColumn("__cell", F.explode(F.sequence(first, last)))
    cut = cut.withColumns({"start": F.greatest(F.col("start"), F.col("__cell") * cell), "end": F.least(F.col("end"), (F.col("__cell") + 1) * cell)})
    return _merge(cut.filter("end > start"), [*keys, "__cell"]).drop("__cell")


def _spans(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    return spans.filter(F.col(end) > F.col(start)).select(*keys, F.col(start).alias("start"), F.col(end).alias("end"))


def merge_intervals(spans: DataFrame, keys: list[str], start: str, end: str, cell: float | None = None) -> DataFrame:
    """Merged intervals of each key (start, end); empty ones are dropped, touching ones joined.

    With `cell` intervals are merged in cells of time first, and only what is left of them is
    ordered by key.
    """
    found = _spans(spans, keys, start, end)
    return _merge(found if cell is None else _in_cells(found, keys, cell), keys)


def _merge(spans: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("__reach", reach).withColumn("__new", (F.col("__reach").isNull() | (F.col("start") > F.col("__reach"))).cast("int"))
    islands = islands.withColumn("__island", F.sum("__new").over(order))
    return islands.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def union_length(spans: DataFrame, keys: list[str], start: str, end: str, cell: float | None = None) -> DataFrame:
    """Length of the union of the intervals of each key.

    With `cell` the lengths of cells of time are summed, so a single key spreads over many tasks.
    """
    found = _spans(spans, keys, start, end)
    merged = _merge(found, keys) if cell is None else _in_cells(found, keys, cell)
    return merged.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def within_windows(samples: DataFrame, marks: DataFrame, time: str, mark_time: str, width: float) -> DataFrame:
    """Samples in [t - width, t] of some mark, each once: a semi-join on bins as wide as the window."""
    near = marks.select(F.col(mark_time).alias("__at"), F.explode(F.array(F.floor(F.col(mark_time) / width), F.floor(F.col(mark_time) / width) - 1)).alias("__near"))
    binned = samples.withColumn("__bin", F.floor(F.col(time) / width))
    inside = (F.col("__bin") == F.col("__near")) & (F.col(time) >= F.col("__at") - width) & (F.col(time) <= F.col("__at"))
    return binned.join(near, inside, "left_semi").drop("__bin")


def asof_backward(left: DataFrame, right: DataFrame, left_time: str, right_time: str, tolerance: float, by: list[str], left_key: str, right_order: str, columns: list[str], ticks: int = 1000) -> DataFrame:
    """For each left row and each key of `by` on the right, the nearest row not after it.

    0 <= left_time - right_time <= tolerance. A right row is the nearest one from its own time up to
    its key's next one, or as far as the tolerance reaches: of these stretches a left row is in one
    for each key, so the range join makes hardly more rows than come out. Of equal times the first
    by right_order counts. Left rows without a partner do not come back. Times are cut into `ticks`
    to one for the join, and compared as they are.
    """
    spans = _stretches(right, right_time, tolerance, by, right_order, columns).withColumns({"__from": F.floor(F.col("__t") * ticks), "__to": F.floor(F.col("__until") * ticks) + 2})
    points = left.withColumn("__at", F.floor(F.col(left_time) * ticks))
    gap = F.col(left_time) - F.col("__t")
    met = range_join(points, spans, "__at", "__from", "__to").filter((gap >= 0) & (gap <= tolerance) & (F.col("__next").isNull() | (F.col(left_time) < F.col("__next"))))
    return met.select(left_key, *by, *columns, F.col("__t").alias(f"matched_{right_time}"))


def _stretches(right: DataFrame, right_time: str, tolerance: float, by: list[str], right_order: str, columns: list[str]) -> DataFrame:
    """Right rows with the time __t from which, __next before which and __until about which each is its key's nearest one."""
    w = Window.partitionBy(*by).orderBy("__t", "__o")
    rows = right.select(*by, *columns, F.col(right_time).alias("__t"), F.col(right_order).alias("__o")).filter("__t IS NOT NULL")
    firsts = rows.withColumn("__same", F.lag("__t").over(w) == F.col("__t")).filter("NOT coalesce(__same, false)")
    return firsts.withColumn("__next", F.lead("__t").over(w)).withColumn("__until", F.least("__next", F.col("__t") + tolerance))


def asof_groups(left: DataFrame, right: DataFrame, left_time: str, right_time: str, tolerance: float, by: str, right_order: str, groups: list[str], ticks: int = 1000) -> DataFrame:
    """For each left time and each of `groups`: n, first_<by> and oldest of the rows that asof_backward finds, which are not made.

    n is their number, oldest their least right_time. The stretch of a right row covers whole ticks
    but for its ends. These are cut into cells of a power of two, at most two of each length, and
    the stretches of a group in a cell become one row; a left time looks into its cell of each
    length. So rows grow with left, right and the result, however many stretches lie over each
    other. At the ticks of a stretch's ends times are compared as they are.
    """
    spans = _stretches(right, right_time, tolerance, [by], right_order, groups).groupBy(*groups, "__t", "__next", "__until").agg(F.count("*").alias("n"), F.min(by).alias("first"))
    spans = spans.withColumns({"__from": F.floor(F.col("__t") * ticks), "__to": F.floor(F.col("__until") * ticks)})
    found = [F.sum("n").alias("n"), F.min("first").alias("first"), F.min("__t").alias("__t")]
    levels = int(tolerance * ticks + 2).bit_length()
    # at level k the whole cells reach from the rounded-up start to the rounded-down end; an odd one at either side has no longer cell around it
    whole = spans.filter("__to - __from > 1").withColumn("__level", F.explode(F.sequence(F.lit(0), F.length(F.bin(F.col("__to") - F.col("__from") - 1)) - 1)))
    whole = whole.withColumns({"__low": F.expr("shiftright(__from + shiftleft(1L, __level), __level)"), "__high": F.expr("shiftright(__to, __level)")}).filter("__low < __high")
    sides = F.array(F.when(F.col("__low") % 2 == 1, F.col("__low")), F.when(F.col("__high") % 2 == 1, F.col("__high") - 1))
    cells = whole.withColumn("__cell", F.explode(sides)).filter("__cell IS NOT NULL").groupBy(*groups, "__level", "__cell").agg(*found)
    times = left.select(F.col(left_time).alias("__at")).filter("__at IS NOT NULL").distinct().withColumn("__tick", F.floor(F.col("__at") * ticks))
    looks = times.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("__cell", F.expr("shiftright(__tick, __level)"))
    inside = looks.join(cells, ["__level", "__cell"]).select("__at", *groups, "n", "first", "__t")
    ends = spans.withColumn("__tick", F.explode(F.array_distinct(F.array("__from", "__to", F.col("__to") + 1))))
    gap = F.col("__at") - F.col("__t")
    beside = times.join(ends, "__tick").filter((gap >= 0) & (gap <= tolerance) & (F.col("__next").isNull() | (F.col("__at") < F.col("__next")))).select("__at", *groups, "n", "first", "__t")
    sums = inside.unionByName(beside).groupBy("__at", *groups).agg(*found)
    return sums.select(F.col("__at").alias(left_time), *groups, "n", F.col("first").alias(f"first_{by}"), F.col("__t").alias("oldest"))


def last_before(events: DataFrame, keys: list[str], order: list[str], is_mark: Column, value: Column) -> Column:
    """The value of the latest mark at or before a row, in its key's order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(is_mark, value), ignorenulls=True).over(w)


#: Lengths of ranges are rounded up to a power of two whose exponent is a multiple of this.
LEVELS = 3


def range_join(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, on: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Rows of points with each range [start, end) of whole numbers that holds them.

    A range belongs to the level of its length: at level k it is listed in the cells of 2**k that
    it touches, which are two at most. A point looks into its cell of each level that occurs, some
    20 at most, so the join is an equality however different the lengths are, and a cell holds no
    ranges but those near the point. Empty ranges hold nothing; points in many ranges come back as
    often. With `rows`, about how many points there are, the join has as many tasks as they take.
    """
    on = on or []
    length = F.try_subtract(F.col(end).cast("bigint"), F.col(start).cast("bigint"))
    bits = F.when(length == 1, 0).when(length > 1, F.length(F.bin(length - 1))).otherwise(62)
    level = F.least((F.ceil(bits / LEVELS) * LEVELS).cast("int"), F.lit(62))
    cells = ranges.filter(F.col(end) > F.col(start)).withColumn("__level", level)
    cell = lambda c, shift=0: F.expr(f"shiftright(CAST(`{c}` AS BIGINT) - {shift}, __level)")
    listed = cells.withColumn("__cell", F.explode(F.sequence(cell(start), cell(end, 1))))
    levels = sorted(r[0] for r in cells.select("__level").distinct().collect()) or [0]
    looks = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)))).withColumn("__cell", cell(point))
    if rows is not None:
        looks = dealt(looks, rows * len(levels), *on, "__level", "__cell")
    met = looks.join(listed, [*on, "__level", "__cell"])
    return met.filter((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("__level", "__cell")


def islands(events: DataFrame, keys: list[str], order: str, state: Column) -> DataFrame:
    """Adds `run`: the number of state changes so far, so that equal runs share it."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = events.withColumn("state", state).withColumn("__prior", F.lag("state").over(w))
    change = (F.col("__prior").isNull() | (F.col("__prior") != F.col("state"))).cast("int")
    return marked.withColumn("run", F.sum(change).over(w)).drop("__prior")
