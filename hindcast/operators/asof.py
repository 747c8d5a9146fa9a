"""Reads and joins along the time axes: as-of filters, temporal joins, nearest-date lookups."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast import schemas
from hindcast.operators import ordered
from hindcast.operators.frames import literal_table

SEARCH_DAYS = 10


def known_at(instant: Column, start: str = "knowledge_from", end: str = "knowledge_to") -> Column:
    """True where the half-open knowledge window contains `instant`."""
    return (F.col(start) <= instant) & (F.col(end) > instant)


def current_versions(facts: DataFrame) -> DataFrame:
    """Versions believed until further notice."""
    return facts.where(F.col("knowledge_to") == schemas.open_end())


def as_of(facts: DataFrame, instant: Column) -> DataFrame:
    """Versions believed at `instant`; both bounds reach the scan as pushed filters."""
    return facts.where(known_at(instant))


def temporal_join(facts: DataFrame, mapping: DataFrame, instant: Column) -> DataFrame:
    """Facts with the ticker their entity had at `instant`.

    The mapping is cut to that instant first, which leaves a plain equi-join on entity_id.
    """
    held = mapping.where(known_at(instant)).select("entity_id", "ticker")
    return facts.join(held, "entity_id")


def dates_within(dates: Sequence[dt.date], first: Column, until: Column) -> Column:
    """Array of the calendar `dates` d with first <= d < until.

    Exploding it joins a fact to the calendar dates at which it counts without a range join: only
    matching pairs are produced, and nothing is shuffled. The months of the bounds give positions in
    the sorted calendar, so a fact looks at the dates between them and not at the whole calendar.
    """
    none = F.array().cast("array<date>")
    if not dates:
        return none
    ordered = sorted(dates)

    def month(day: dt.date) -> int:
        return day.year * 12 + day.month

    start, months = month(ordered[0]), month(ordered[-1]) - month(ordered[0]) + 1
    before = F.lit([sum(month(day) < start + k for day in ordered) for k in range(months + 1)])

    def position(day: Column, shift: int) -> Column:
        at = F.year(day) * 12 + F.month(day) - start + shift
        return F.get(before, F.greatest(F.least(at, F.lit(months)), F.lit(0)))

    low, high = position(first, 0), position(until, 1)
    near = F.slice(F.lit(ordered), low + 1, F.greatest(high - low, F.lit(0)))
    return F.coalesce(F.filter(near, lambda day: (day >= first) & (day < until)), none)


def nearest_on_or_after(
    prices: DataFrame,
    dates: Sequence[dt.date],
    *,
    by: Sequence[str],
    value: str,
    search_days: int = SEARCH_DAYS,
) -> DataFrame:
    """First row on or after each date, at most `search_days` later, per `by` group.

    If that row's value is NULL there is no match: the search does not go on to the next row. The
    calendar is widened to one row per (date, candidate day), so the join is an equi-join on the
    trade date, and `min_by` combines before its shuffle.
    """
    candidates = [
        (day, day + dt.timedelta(days=offset))
        for day in sorted(set(dates))
        for offset in range(search_days + 1)
    ]
    calendar = literal_table(prices.sparkSession, candidates, "date date, trade_date date")
    found = (
        prices.select(*by, "trade_date", F.col(value).alias("price"))
        .join(calendar, "trade_date")
        .groupBy("date", *by)
        .agg(F.min(F.struct("trade_date", "price")).alias("first"))
    )
    return found.select(
        "date", *by, F.col("first.trade_date").alias("price_date"), "first.price"
    ).where(F.col("price").isNotNull())


def latest_on_or_before(
    facts: DataFrame,
    dates: Sequence[dt.date],
    *,
    by: Sequence[str],
    day: str,
    payload: Sequence[str],
    tie: Sequence[Column],
) -> DataFrame:
    """Row with the greatest `day` <= date, per date and `by` group; ties go to the greatest `tie`.

    Rows of a group that share a day are first reduced to one; each survivor then holds from its
    own day until the next one, so a row meets a date at most once.
    """
    best = F.max_by(F.struct(*payload), F.struct(*[c.alias(f"t{i}") for i, c in enumerate(tie)]))
    daily = facts.groupBy(*by, day).agg(best.alias("__row"))
    held = _until_next(daily, by, day)
    return held.select(
        F.explode(
            dates_within(dates, F.col(day), F.coalesce("__until", F.lit(dt.date.max)))
        ).alias("date"),
        *by,
        day,
        "__row.*",
    )


def _until_next(daily: DataFrame, by: Sequence[str], day: str) -> DataFrame:
    # Unique per (group, day), so a group is no longer than the calendar of its days.
    window = Window.partitionBy(*by).orderBy(day)
    return daily.withColumn("__until", F.lead(day).over(window))


def nearest_instant(
    left: DataFrame,
    right: DataFrame,
    *,
    by: Sequence[str],
    left_time: str,
    right_time: str,
    payload: Sequence[str],
    direction: str = "forward",
    tolerance_s: float | None = None,
    prefix: str = "matched_",
    hot_key_rows: int | None = ordered.HOT_KEY_ROWS,
) -> DataFrame:
    """Every row of `left` with the row of `right` at the nearest instant on or after (`forward`) or on or
    before (`backward`) its own, per `by` group.

    Both sides are merged in one order of instants and the last row of `right` is carried along, so a row
    costs the same however many instants there are: nothing is widened by day and no pairs are formed. A
    key with any share of the rows is scanned in chunks (`ordered.split_by_heat`).

    Adds `<prefix><right_time>` and a `<prefix>` column for each of `payload`, replacing columns of `left`
    with those names. They are NULL where nothing lies within `tolerance_s` seconds (its end included), where
    a key or the instant is NULL, and for rows of `right` only where their values are. Rows of `right` at one
    instant are told apart by their payload, the greatest of which counts; so it holds no maps. Repeated
    rows of `left` are kept. Instants are TIMESTAMPs, compared to the microsecond.
    """
    if direction not in ("forward", "backward"):
        raise ValueError(f"unknown direction {direction!r}")
    sign = -1 if direction == "forward" else 1
    added = [right_time, *payload]
    keys = [f"__key_{i}" for i in range(len(by))]
    carried = T.StructType(
        [T.StructField("at", T.LongType()), T.StructField("row", T.StructType([right.schema[c] for c in added]))]
    )

    def merged(side: DataFrame, instant: str, is_left: int, row: Column, found: Column) -> DataFrame:
        at = F.unix_micros(F.col(instant).cast("timestamp")) * sign
        return side.select(
            *[F.col(name).alias(key) for name, key in zip(by, keys)],
            at.alias("__at"), F.lit(is_left).alias("__side"), row.alias("__left"), found.alias("__right"),
        )

    whole = F.struct(*[F.col(name) for name in left.columns])
    at = F.unix_micros(F.col(right_time).cast("timestamp")) * sign
    found = F.struct(at.alias("at"), F.struct(*added).alias("row"))
    asked = merged(left, left_time, 1, whole, F.lit(None).cast(carried))
    offered = merged(right, right_time, 0, F.lit(None).cast(left.schema), found.cast(carried))
    complete = F.lit(True)
    for name in [*keys, "__at"]:
        complete = complete & F.col(name).isNotNull()
    # At equal instants rows of `right` come first: they lie on the row of `left`.
    both = asked.where(complete).unionByName(offered.where(complete))
    scanned = ordered.split_by_heat(
        both, keys, ["__at", "__side"],
        lambda rows, scan: scan(rows, __last=ordered.running_max(F.col("__right"))),
        hot_key_rows=hot_key_rows,
    )
    matched = scanned.where("__side = 1").select("__at", "__left", "__last")
    alone = asked.where(~complete).select("__at", "__left", F.lit(None).cast(carried).alias("__last"))
    near = F.lit(True) if tolerance_s is None else (
        F.col("__at") - F.col("__last.at") <= F.lit(round(tolerance_s * 1_000_000))
    )
    new = {f"{prefix}{name}": F.when(near, F.col("__last.row")[name]).alias(f"{prefix}{name}") for name in added}
    return matched.unionByName(alone).select(
        *[F.col("__left")[name].alias(name) for name in left.columns if name not in new], *new.values()
    )
