"""Expressions over ordered rows that stay parallel when one series is very long.

A window function puts each series into one task. That is right for the many short series and wrong for one that
holds a third of the table. Series are therefore cut into segments of at most `group_limit` rows or so, by bounds that a sample of
their keys gives; a short series is one segment. Which segment a row is in follows from its own values, so the
windows, by series and segment, need one exchange and no table on disk. What lies before and after a segment (the
row count, the last rows, the first rows, the nearest known values) comes from a summary with a row per segment, and
only of series that have several: those of a short series have nothing to carry.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from epochline.functions.columns import names
from epochline.session import sized

#: Rows of a segment, about; segments of a series at most (which bounds tasks and the list of bounds, not rows);
#: rows that are sampled per segment to find the bounds.
GROUP_LIMIT = 200_000
SEGMENTS = 10_000
SAMPLED = 40
#: Parts into which a step of the search for a row's segment divides the bounds. Planning time doubles with every step.
PARTS = 4

BLOCK, INDEX, COUNT, BEFORE, TOTAL = "__block", "__index", "__count", "__before", "__total"
TAIL, HEAD, FIRST_ROW = "__tail", "__head", "__first_row"
CUTS, PLACE, ROWS, LONG = "__cuts", "__place", "__rows", "__long"
PREVIOUS, NEXT, CARRIED = "__previous_", "__next_", "__carried"


@dataclass(frozen=True)
class Scope:
    """What an expression sees: the windows of its rows, and in blocked mode what is carried in."""

    key: str
    forward: WindowSpec
    backward: WindowSpec
    slots: Mapping[str, str]
    blocked: bool
    numbered: bool = True

    @property
    def index(self) -> Column:
        return F.col(INDEX)

    @property
    def position(self) -> Column:
        return F.col(BEFORE) + F.col(INDEX) if self.blocked else F.col(INDEX)

    def earlier(self, col: str, k: int) -> Column:
        here = F.lag(col, k).over(self.forward)
        if not self.blocked:
            return here
        carried = F.get(F.col(TAIL), F.size(TAIL) - F.lit(k + 1) + self.index).getField(self.slots[col])
        return F.when(self.index > k, here).otherwise(carried)

    def later(self, col: str, k: int) -> Column:
        here = F.lead(col, k).over(self.forward)
        if not self.blocked:
            return here
        carried = F.get(F.col(HEAD), self.index + F.lit(k - 1) - F.col(COUNT)).getField(self.slots[col])
        return F.when(self.index + k <= F.col(COUNT), here).otherwise(carried)

    def first(self, col: str) -> Column:
        here = F.first(col).over(self.forward.rowsBetween(Window.unboundedPreceding, 0))
        if not self.blocked:
            return here
        carried = F.col(FIRST_ROW).getField(self.slots[col])
        return F.when(F.col(BEFORE) > 0, carried).otherwise(here)

    def known(self, col: str, side: str) -> Column:
        """The nearest row with a known value, itself included, as a struct `p, k, v`."""
        return F.col(f"{side}{self.slots[col]}")

    def find_known(self, col: str, side: str, after: Column | None = None) -> Column:
        fields = [F.col(self.key).alias("k"), F.col(col).alias("v")]
        if self.numbered:
            fields.insert(0, self.position.alias("p"))
        # A frame reaching to the end would be re-read for every row; the reversed order is linear.
        window = self.forward if side == PREVIOUS else self.backward
        is_known = F.col(col).isNotNull()
        if after is not None:
            is_known = is_known & after.isNotNull()
        here = F.last(F.when(is_known, F.struct(*fields)), True).over(window.rowsBetween(Window.unboundedPreceding, 0))
        return F.coalesce(here, F.col(f"{CARRIED}{side}{self.slots[col]}")) if self.blocked else here

    def frame_sum(self, col: str, before: int, after: int) -> tuple[Column, Column]:
        """Sum and count of the known values from `before` rows back to `after` rows ahead."""
        frame = self.forward.rowsBetween(-before, after)
        total = F.coalesce(F.sum(col).over(frame).cast("double"), F.lit(0.0))
        known = F.count(col).over(frame)
        if not self.blocked:
            return total, known
        slot = self.slots[col]
        reached = self.index - F.lit(before + 1) + F.size(TAIL)
        pieces = [
            F.filter(F.col(TAIL), lambda row, i: i >= reached),
            F.filter(F.col(HEAD), lambda row, i: i < self.index + F.lit(after) - F.col(COUNT)),
        ]
        for rows in pieces:
            values = F.filter(F.transform(rows, lambda row: row.getField(slot).cast("double")), F.isnotnull)
            summed = F.aggregate(values, F.lit(0.0), lambda acc, value: acc + value)
            total = total + F.coalesce(summed, F.lit(0.0))
            known = known + F.coalesce(F.size(values), F.lit(0))
        return total, known


@dataclass(frozen=True)
class Ordered:
    """Base of the ordered expressions; the attributes say what has to be carried between blocks."""

    col: str | None = None

    back: int = 0
    ahead: int = 0
    sides: tuple[str, ...] = ()
    first: bool = False
    numbered: bool = False

    def build(self, scope: Scope) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Lag(Ordered):
    """Value `k` rows earlier; `pad="first"` repeats the first row of the series before its start."""

    k: int = 1
    pad: str = "null"

    def __post_init__(self):
        object.__setattr__(self, "back", self.k)
        object.__setattr__(self, "first", self.pad == "first")
        object.__setattr__(self, "numbered", self.pad == "first")

    def build(self, scope: Scope) -> Column:
        value = scope.earlier(self.col, self.k)
        if self.pad == "null":
            return value
        return F.when(scope.position <= self.k, scope.first(self.col)).otherwise(value)


@dataclass(frozen=True)
class Delta(Lag):
    """Difference to the value `k` rows earlier."""

    def build(self, scope: Scope) -> Column:
        return F.col(self.col) - super().build(scope)


@dataclass(frozen=True)
class Rolling(Ordered):
    """Mean over a frame of rows; null if fewer than `min_count` known values are in it."""

    before: int = 1
    after: int = 1
    min_count: int | None = None

    def __post_init__(self):
        object.__setattr__(self, "back", max(1, self.before))
        object.__setattr__(self, "ahead", max(1, self.after))

    def build(self, scope: Scope) -> Column:
        least = self.before + self.after + 1 if self.min_count is None else self.min_count
        total, known = scope.frame_sum(self.col, self.before, self.after)
        return F.when(known >= least, total / known)


@dataclass(frozen=True)
class Fill(Ordered):
    """Nearest known value: later one first (`both`), or only `backward` / `forward`."""

    direction: str = "both"

    def __post_init__(self):
        sides = {"both": (NEXT, PREVIOUS), "backward": (NEXT,), "forward": (PREVIOUS,)}[self.direction]
        object.__setattr__(self, "sides", sides)

    def build(self, scope: Scope) -> Column:
        return F.coalesce(*[scope.known(self.col, side).getField("v") for side in self.sides])


@dataclass(frozen=True)
class NearestKnown(Ordered):
    """Position, key and value of the nearest known row on one side, as a struct `p, k, v`."""

    direction: str = "forward"
    numbered: bool = True

    def __post_init__(self):
        object.__setattr__(self, "sides", (PREVIOUS if self.direction == "forward" else NEXT,))

    def build(self, scope: Scope) -> Column:
        return scope.known(self.col, self.sides[0])


@dataclass(frozen=True)
class Interpolate(Ordered):
    """Straight line between known neighbours, by row (`axis="row"`) or by key distance (`"key"`).

    Rows before the first and after the last known value stay null, or take it with `edges="fill"`.
    """

    axis: str = "row"
    edges: str = "null"
    sides: tuple[str, ...] = (PREVIOUS, NEXT)
    numbered: bool = True

    def build(self, scope: Scope) -> Column:
        left, right = scope.known(self.col, PREVIOUS), scope.known(self.col, NEXT)
        at = scope.position if self.axis == "row" else F.col(scope.key)
        field = "p" if self.axis == "row" else "k"
        x0, x1 = left.getField(field), right.getField(field)
        y0, y1 = left.getField("v"), right.getField("v")
        inside = y0 + (y1 - y0) * (at - x0) / F.nullif(x1 - x0, F.lit(0))
        value = F.coalesce(F.col(self.col).cast("double"), inside)
        return F.coalesce(value, y1, y0) if self.edges == "fill" else value


@dataclass(frozen=True)
class Position(Ordered):
    """Row number within the series, starting at `offset + 1`."""

    offset: int = 0
    numbered: bool = True

    def build(self, scope: Scope) -> Column:
        return (scope.position + F.lit(self.offset)).cast("bigint")


@dataclass(frozen=True)
class Size(Ordered):
    """Number of rows of the series."""

    def build(self, scope: Scope) -> Column:
        return F.col(TOTAL).cast("bigint")


def group_sizes(df: DataFrame, by: Iterable[str]) -> int:
    """Rows of the largest group."""
    by = names(by)
    if not by:
        return df.count()
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n").alias("largest")).first()["largest"] or 0


def with_ordered(
    df: DataFrame,
    key: str,
    exprs: Mapping[str, Ordered],
    series: str | Iterable[str] | None = None,
    tiebreak: Iterable[str] = (),
    group_limit: int = GROUP_LIMIT,
    max_rows: int | None = None,
) -> DataFrame:
    """Add (or replace) columns computed over the rows of each series in key order.

    Counting the largest series is a job of its own; a caller that knows a bound on the rows per series
    passes it as `max_rows` and saves that. `tiebreak` columns order rows that share a key. Where a series has several
    segments, `df` is read some times over: settle one that is costly to make.
    """
    series, order = names(series), [key, *names(tiebreak)]
    wanted = list(exprs.values())
    if max_rows is None or max_rows > group_limit:
        largest = group_sizes(df, series)
        if largest > group_limit:
            laid = _in_segments(df, series, order, group_limit, largest)
            return _carried(laid, df.columns, key, exprs, series, order)

    numbered = any(e.numbered for e in wanted)
    scope = Scope(key, *_windows(series, order), _slots(wanted), blocked=False, numbered=numbered)
    helpers = {INDEX: F.row_number().over(scope.forward)} if numbered else {}
    if any(isinstance(e, Size) for e in wanted):
        helpers[TOTAL] = F.count(F.lit(1)).over(Window.partitionBy(*series))
    return _finish(df.withColumns(helpers) if helpers else df, df.columns, exprs, scope)


def _slots(wanted: list[Ordered]) -> dict[str, str]:
    """Short internal names for the columns that the expressions look at."""
    return {c: f"v{i}" for i, c in enumerate(sorted({e.col for e in wanted if e.col}))}


def _finish(df: DataFrame, columns: list[str], exprs: Mapping[str, Ordered], scope: Scope) -> DataFrame:
    """Everything that walks forward first, then the backward walk, so that rows are sorted only twice."""

    def looked_up(side):
        return sorted({e.col for e in exprs.values() if side in e.sides})

    slots = scope.slots
    walked = {name: f"__walked{i}" for i, (name, e) in enumerate(exprs.items()) if not e.sides}
    forward = {f"{PREVIOUS}{slots[c]}": scope.find_known(c, PREVIOUS) for c in looked_up(PREVIOUS)}
    forward |= {new: exprs[name].build(scope) for name, new in walked.items()}
    result = df.withColumns(forward) if forward else df
    # A known row is its own previous known row, so asking for that as well changes nothing in the result;
    # it makes the backward walk depend on the forward one, which keeps the planner from swapping them.
    backward = {
        f"{NEXT}{slots[c]}": scope.find_known(c, NEXT, scope.known(c, PREVIOUS) if c in looked_up(PREVIOUS) else None)
        for c in looked_up(NEXT)
    }
    result = result.withColumns(backward) if backward else result
    final = {n: F.col(walked[n]) if n in walked else e.build(scope) for n, e in exprs.items()}
    order = [*columns, *[n for n in exprs if n not in columns]]
    return result.select(*[final[c].alias(c) if c in final else F.col(c) for c in order])


def _windows(partition: list[str], order: list[str]) -> tuple[WindowSpec, WindowSpec]:
    groups = Window.partitionBy(*partition)
    return groups.orderBy(*order), groups.orderBy(*[F.col(c).desc_nulls_last() for c in order])


def _in_segments(df: DataFrame, series: list[str], order: list[str], limit: int, largest: int) -> DataFrame:
    """`df` with the number of each row's segment, and whether its series has several."""
    place, rate = F.struct(*order), min(1.0, SAMPLED / limit, SEGMENTS * SAMPLED / largest)
    keys = {c: f"__on_{c}" for c in series}
    named = df.select(*[F.col(c).alias(n) for c, n in keys.items()], place.alias(PLACE))
    sample = named.sample(rate, seed=1) if rate < 1 else named
    if series:
        long = named.groupBy(*keys.values()).agg(F.count(F.lit(1)).alias(ROWS)).where(F.col(ROWS) > limit)
        sample, long = sample.alias("s"), long.alias("l")  # long series are few, a row per `limit` rows at most; their sample is not
        same = [F.col(f"s.{n}").eqNullSafe(F.col(f"l.{n}")) for n in keys.values()]
        found = sample.join(F.broadcast(long), same).groupBy(*[f"l.{n}" for n in keys.values()], ROWS)
    else:
        found = sample.withColumn(ROWS, F.lit(largest)).groupBy(ROWS)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a long series is worth all of them
    wanted = F.least(F.greatest(F.ceil(F.col(ROWS) / limit), F.lit(tasks)), F.lit(SEGMENTS))
    steps = F.sequence(F.lit(1).cast("bigint"), wanted - 1)
    picked = F.transform(steps, lambda i: F.get(PLACE, F.floor(i * F.size(PLACE) / wanted).cast("int")))
    sorted_places = found.agg(F.sort_array(F.collect_list(PLACE)).alias(PLACE))
    bounds = sized(sorted_places.select(*keys.values(), F.array_distinct(picked).alias(CUTS)))

    if series:
        on = [F.col(c).eqNullSafe(F.col(n)) for c, n in keys.items()]
        laid = df.join(bounds, on, "left").drop(*keys.values())
    else:  # one row with SEGMENTS bounds at most
        laid = df.withColumn("__one", F.lit(0)).join(F.broadcast(bounds.withColumn("__one", F.lit(0))), "__one", "left").drop("__one")
    # the number of bounds below the row, digit by digit, the first digit first; one digit a projection, for generated code
    most = min(SEGMENTS, max(-(-largest // limit), tasks))
    laid = laid.withColumns({BLOCK: F.lit(0), LONG: F.col(CUTS).isNotNull(), PLACE: place})
    step = 1
    while step * PARTS <= most:
        step *= PARTS
    while step:
        below = [F.get(CUTS, F.col(BLOCK) + F.lit(k * step - 1)) < F.col(PLACE) for k in range(1, PARTS)]
        digit = sum((F.when(b, F.lit(step)).otherwise(F.lit(0)) for b in below), F.lit(0))
        laid = laid.withColumn(BLOCK, F.col(BLOCK) + digit)
        step //= PARTS
    return laid.drop(CUTS, PLACE)


def _carried(laid: DataFrame, columns: list[str], key: str, exprs: Mapping[str, Ordered], series: list[str], order: list[str]) -> DataFrame:
    """The expressions over rows in segments, with what neighbouring segments hold carried in."""
    wanted = list(exprs.values())
    back = max((e.back for e in wanted), default=0)
    ahead = max(max((e.ahead for e in wanted), default=0), int(any(e.first for e in wanted)))
    slots = _slots(wanted)
    known = sorted({slots[e.col] for e in wanted if e.sides})
    column_of = {slot: c for c, slot in slots.items()}

    forward, backward = _windows([*series, BLOCK], order)
    counted = bool(back or ahead) or any(isinstance(e, Size) for e in wanted)

    def numbered(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn(INDEX, F.row_number().over(forward))
        return rows.withColumn(COUNT, F.count(F.lit(1)).over(Window.partitionBy(*series, BLOCK))) if counted else rows

    local = numbered(laid.drop(LONG))
    several = laid.where(LONG)
    if back or ahead or known:
        several = numbered(several)
    row = F.struct(F.col(INDEX).alias("p"), *[F.col(c).alias(s) for c, s in slots.items()])
    summaries = [F.count(F.lit(1)).alias(COUNT)]
    if back:
        summaries.append(F.sort_array(F.collect_list(F.when(F.col(INDEX) > F.col(COUNT) - back, row))).alias(TAIL))
    if ahead:
        summaries.append(F.sort_array(F.collect_list(F.when(F.col(INDEX) <= ahead, row))).alias(HEAD))
    for slot in known:
        value = F.col(column_of[slot])
        seen = F.when(value.isNotNull(), F.struct(F.col(INDEX).alias("p"), F.col(key).alias("k"), value.alias("v")))
        summaries += [F.min(seen).alias(f"__first_{slot}"), F.max(seen).alias(f"__last_{slot}")]
    summary = several.groupBy(*series, BLOCK).agg(*summaries)

    blocks = Window.partitionBy(*series).orderBy(BLOCK)
    blocks_back = Window.partitionBy(*series).orderBy(F.col(BLOCK).desc())
    prior = blocks.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumns(
        {
            BEFORE: F.coalesce(F.sum(COUNT).over(prior), F.lit(0)),
            TOTAL: F.sum(COUNT).over(Window.partitionBy(*series)),
        }
    ).where(F.col(TOTAL) > F.col(COUNT))

    def moved(name):
        seen = F.col(name)
        return F.when(
            seen.isNotNull(),
            F.struct(
                (seen.getField("p") + F.col(BEFORE)).alias("p"), seen.getField("k").alias("k"), seen.getField("v").alias("v")
            ),
        )

    carry = {BEFORE: F.col(BEFORE), TOTAL: F.col(TOTAL)}
    for slot in known:
        carry[f"{CARRIED}{PREVIOUS}{slot}"] = F.last(moved(f"__last_{slot}"), True).over(prior)
        carry[f"{CARRIED}{NEXT}{slot}"] = F.last(moved(f"__first_{slot}"), True).over(
            blocks_back.rowsBetween(Window.unboundedPreceding, -1)
        )
    if back:
        rows_before = F.flatten(F.collect_list(TAIL).over(blocks.rowsBetween(-back, -1)))
        carry[TAIL] = F.slice(rows_before, F.greatest(F.size(rows_before) - back + 1, F.lit(1)), back)
    if ahead:
        carry[HEAD] = F.slice(F.flatten(F.collect_list(HEAD).over(blocks.rowsBetween(1, ahead))), 1, ahead)
        carry[FIRST_ROW] = F.first(F.get(F.col(HEAD), F.lit(0))).over(blocks.rowsBetween(Window.unboundedPreceding, 0))
    keys = {c: f"__on_{c}" for c in [*series, BLOCK]}
    carried = summary.select(
        *[F.col(c).alias(n) for c, n in keys.items()], *[value.alias(n) for n, value in carry.items()]
    )

    carried = sized(carried)
    on = F.col(BLOCK) == F.col(keys[BLOCK])
    for c in series:
        on = on & F.col(c).eqNullSafe(F.col(keys[c]))
    joined = local.join(carried, on, "left").withColumn(BEFORE, F.coalesce(BEFORE, F.lit(0)))
    if counted:
        joined = joined.withColumn(TOTAL, F.coalesce(TOTAL, COUNT))
    scope = Scope(key, forward, backward, slots, blocked=True)
    return _finish(joined, columns, exprs, scope)
