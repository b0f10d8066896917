"""Shop reports: checkout funnel, repurchase cohorts, lifetime value per product.

One user, customer or cohort may hold any share of the rows: whatever needs the rows of a key in order
goes through ranges of equal size, everything else is an aggregate with partial results.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.ranking import in_ranges


def _least_pair(pairs: list[Column]) -> Column:
    """Smallest of several (time, taken) structs, of which any may be NULL."""
    return F.array_min(F.array(*pairs))


def _fold_range(steps: int, limit: int) -> Column:
    """Summary of the ordered ``rows`` (at, id, step) of one user and range:

    ``ahead[i][j]``: when steps i to j are first done in order here, by a user who had done those before i;
    ``start[j]``: latest first step of a run of steps 0 to j that lies in here, each within ``limit``;
    ``first[j]``: when step j of such a run was first done here, and the time it took.
    """
    none = F.lit(None).cast("long")
    pair = F.lit(None).cast("struct<at: bigint, taken: bigint>")
    zero = F.struct(
        F.array(*[F.array(*[none] * steps)] * steps).alias("ahead"), F.array(*[none] * steps).alias("start"),
        F.array(*[pair] * steps).alias("first"),
    )

    def take(done: Column, row: Column) -> Column:
        at, step = row["at"], row["step"]
        ahead, start, first = done["ahead"], done["start"], done["first"]
        moved = []
        for i in range(steps):
            line = []
            for j in range(steps):
                ready = F.lit(True) if j == i else (ahead[i][j - 1].isNotNull() if j > i else F.lit(False))
                line.append(F.when((step == j) & ahead[i][j].isNull() & ready, at).otherwise(ahead[i][j]))
            moved.append(F.array(*line))
        begun = [at] + [F.when(at - start[j - 1] <= limit, start[j - 1]) for j in range(1, steps)]
        return F.struct(
            F.array(*moved).alias("ahead"),
            F.array(
                *[F.when(step == j, F.greatest(start[j], begun[j])).otherwise(start[j]) for j in range(steps)]
            ).alias("start"),
            F.array(
                *[
                    F.when(
                        (step == j) & first[j].isNull() & begun[j].isNotNull(),
                        F.struct(at.alias("at"), (at - begun[j]).alias("taken")),
                    ).otherwise(first[j])
                    for j in range(steps)
                ]
            ).alias("first"),
        )

    return F.aggregate("rows", zero, take)


def _fold_ranges(steps: int, limit: int) -> Column:
    """First completion (at, taken) of every step, from a user's range summaries in order."""
    none = F.lit(None).cast("long")
    pair = F.lit(None).cast("struct<at: bigint, taken: bigint>")
    zero = F.struct(F.array(*[none] * steps).alias("start"), F.array(*[pair] * steps).alias("first"))

    def join(done: Column, part: Column) -> Column:
        here = part["summary"]
        start, first = [], []
        for j in range(steps):
            # runs begun in earlier ranges, that had done the steps before i, and go on here
            goes = [
                F.when(here["ahead"][i][j] - done["start"][i - 1] <= limit, done["start"][i - 1])
                for i in range(1, j + 1)
            ]
            ends = [
                F.when(s.isNotNull(), F.struct(here["ahead"][i][j].alias("at"), (here["ahead"][i][j] - s).alias("taken")))
                for i, s in enumerate(goes, 1)
            ]
            start.append(F.greatest(done["start"][j], here["start"][j], *goes) if goes else F.greatest(done["start"][j], here["start"][j]))
            first.append(F.coalesce(done["first"][j], _least_pair([here["first"][j], *ends])))
        return F.struct(F.array(*start).alias("start"), F.array(*first).alias("first"))

    return F.aggregate("parts", zero, join, lambda done: done["first"])


def step_times(
    events: DataFrame, steps: Mapping[str, str], limit: timedelta, user: str = "user_id", time: str = "ts",
    event_id: str = "event_id",
) -> DataFrame:
    """(user, step, at, seconds): when each user first did a step in order, and how long after the
    latest first step that leads to it within ``limit``.

    ``steps`` maps the names of the steps, in order, to conditions; a row counts for the first one
    that it meets. Any number of other rows may lie between two steps, and every row of the first
    step may be the beginning. Rows of equal time are ordered by ``event_id``. Rows without user or
    time are left out. The rows of a user are folded range by range, into summaries that are then
    joined in order, so no task holds all rows of a hot user.
    """
    place = F.coalesce(*[F.when(F.expr(condition), F.lit(k)) for k, condition in enumerate(steps.values())])
    rows = events.select(
        F.col(user).alias("user"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"),
        F.col(event_id).alias("id"), place.alias("step"),
    ).where("step is not null and user is not null and at is not null")
    ranged = in_ranges(rows, ["user", "at", "id"], "funnel-rows")
    parts = ranged.groupBy("user", "_range").agg(
        F.array_sort(F.collect_list(F.struct("at", "id", "step"))).alias("rows")
    )
    span = int(limit / timedelta(microseconds=1))
    folded = parts.select("user", "_range", _fold_range(len(steps), span).alias("summary"))
    users = folded.groupBy("user").agg(
        F.array_sort(F.collect_list(F.struct("_range", "summary"))).alias("parts")
    )
    names = F.array(*[F.lit(name) for name in steps])
    done = users.select("user", F.posexplode(_fold_ranges(len(steps), span)).alias("place", "done"))
    return done.where("done is not null").select(
        "user", "place", names[F.col("place")].alias("step"),
        F.timestamp_micros("done.at").alias("at"), F.floor(F.col("done.taken") / 1_000_000).alias("seconds"),
    )


def checkout_funnel(times: DataFrame, steps: Mapping[str, str]) -> DataFrame:
    """Per step, in order: users who did it, their share of those of the first and of the previous
    step, and the median of the whole seconds since their first step (the lower one of two), from
    ``step_times``. Users are counted by second first, of which the time limit bounds the number."""
    counts = times.groupBy("place", "seconds").agg(F.count(F.lit(1)).alias("n"))
    step = Window.partitionBy("place")
    sums = counts.withColumn("upto", F.sum("n").over(step.orderBy("seconds"))).withColumn(
        "users", F.sum("n").over(step)
    )
    found = sums.groupBy("place").agg(
        F.max("users").alias("users"),
        F.min(F.when(F.col("upto") * 2 >= F.col("users"), F.col("seconds"))).alias("median_seconds"),
    )
    names = found.sparkSession.createDataFrame(list(enumerate(steps)), "place int, step string")
    every = Window.orderBy("place")  # one row per step
    users = F.coalesce("users", F.lit(0))
    return names.join(found, "place", "left").select(
        "place", "step", users.alias("users"), "median_seconds",
        F.try_divide(users, F.first(users).over(every)).alias("of_first"),
        F.try_divide(users, F.lag(users).over(every)).alias("of_previous"),
    )


# Repurchase cohorts


def _month(value: Column) -> Column:
    """Months since year 0."""
    return F.year(value) * 12 + F.month(value) - 1


def _month_date(month: Column) -> Column:
    return F.make_date((month / 12).cast("int"), month % 12 + 1, F.lit(1))


def cohort_bitmaps(orders: DataFrame, customer: str, time: str) -> DataFrame:
    """(cohort, month, bucket, customers): which customers of a cohort ordered in a month, as bitmaps.

    A customer's cohort is the month of the first order. ``customer`` is a non-negative whole number;
    a bucket holds 32,768 of them. Bitmaps of two tables, or of several months, are merged by
    ``bitmap_or_agg``, and counts of distinct customers then follow from them exactly. The months
    of a customer are collected as a set with partial results, so a hot customer is a few rows.
    """
    month = _month(F.col(time))
    rows = orders.where(F.col(customer).isNotNull() & F.col(time).isNotNull())
    per_customer = rows.groupBy(F.col(customer).cast("long").alias("customer")).agg(
        F.collect_set(month).alias("months")
    )
    cells = per_customer.select("customer", F.array_min("months").alias("cohort"), F.explode("months").alias("month"))
    return cells.groupBy("cohort", "month", F.bitmap_bucket_number("customer").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("customer")).alias("customers")
    )


def merged_bitmaps(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """Bitmaps of coarser groups: distinct customers over several cells, without their rows."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("customers").alias("customers"))


def cohort_matrix(bitmaps: DataFrame) -> DataFrame:
    """Every month from a cohort's own to the last one of all: cohort_month, month_offset, active
    (customers who ordered in that month, 0 where none did), cohort_size, retention, and ``returned``
    (customers who ordered again up to then, each counted once)."""
    counted = bitmaps.groupBy("cohort", "month").agg(F.sum(F.bitmap_count("customers")).alias("active"))
    last = bitmaps.agg(F.max("month")).scalar()
    cohorts = counted.where("cohort = month").select("cohort", F.col("active").alias("cohort_size"))
    grid = cohorts.select("cohort", "cohort_size", F.explode(F.sequence("cohort", last)).alias("month"))
    # the union of a bucket's bitmaps up to a month tells how many of its customers are new there
    upto = Window.partitionBy("cohort", "bucket").orderBy("month")
    union = F.bitmap_count(F.bitmap_or_agg("customers").over(upto))
    unions = bitmaps.where("month > cohort").select("cohort", "bucket", "month", union.alias("n"))
    fresh = F.col("n") - F.coalesce(F.lag("n").over(upto), F.lit(0))
    fresh = unions.withColumn("fresh", fresh).groupBy("cohort", "month").agg(F.sum("fresh").alias("fresh"))
    returned = F.coalesce(F.sum("fresh").over(Window.partitionBy("cohort").orderBy("month")), F.lit(0))
    active = F.coalesce("active", F.lit(0))
    return (
        grid.join(counted, ["cohort", "month"], "left").join(fresh, ["cohort", "month"], "left")
        .select(
            _month_date(F.col("cohort")).alias("cohort_month"), (F.col("month") - F.col("cohort")).alias("month_offset"),
            active.alias("active"), "cohort_size", (active / F.col("cohort_size")).alias("retention"),
            returned.alias("returned"),
        )
    )


# Lifetime value


def order_revenue(orders: DataFrame, lines: DataFrame, revenue: Column) -> DataFrame:
    """(customer, time, order, product, revenue) per order; the product is that of its first line,
    NULL for an order without lines. ``orders`` has order, customer, time; ``lines`` order, line,
    product and what ``revenue`` needs."""
    per_order = lines.groupBy("order").agg(
        F.sum(revenue).alias("revenue"), F.min(F.struct("line", "product"))["product"].alias("product")
    )
    return orders.join(per_order, "order", "left")


def lifetime_value(priced: DataFrame) -> DataFrame:
    """Per product and month of age: customers won by the product, their revenue in that month since
    their first order, all revenue up to it, and that per customer.

    A customer's later revenue goes to the product of the first order (the earliest, then the smallest
    key), as of which the age counts. Revenue is added up by customer and month before a customer's
    months meet, so a hot customer is as many rows as there are months. Products get a row for
    every month up to their customers' last; orders without customer or time are left out.
    """
    rows = priced.where("customer is not null and time is not null")
    months = rows.groupBy("customer", _month(F.col("time")).alias("month")).agg(
        F.sum("revenue").alias("revenue"), F.min(F.struct("time", "order", "product")).alias("first")
    )
    per_customer = months.groupBy("customer").agg(
        F.min("first").alias("first"), F.collect_list(F.struct("month", "revenue")).alias("months")
    )
    won = per_customer.select(
        F.col("first.product").alias("product"), _month(F.col("first.time")).alias("won"), F.explode("months").alias("m")
    ).select("product", (F.col("m.month") - F.col("won")).alias("age"), F.col("m.revenue").alias("revenue"))
    cells = won.groupBy("product", "age").agg(
        F.coalesce(F.sum("revenue"), F.lit(0)).alias("revenue"), F.count_if(F.col("age") == 0).alias("won")
    )
    ages = cells.groupBy("product").agg(F.max("age").alias("oldest"), F.sum("won").alias("customers"))
    grid = ages.select("product", "customers", F.explode(F.sequence(F.lit(0), "oldest")).alias("age"))
    same = F.col("g.product").eqNullSafe(F.col("c.product")) & (F.col("g.age") == F.col("c.age"))
    filled = grid.alias("g").join(cells.alias("c"), same, "left").select(
        "g.product", "g.age", "customers", F.coalesce("revenue", F.lit(0)).alias("revenue")
    )
    upto = Window.partitionBy("product").orderBy("age")  # as many rows as there are months
    total = F.sum("revenue").over(upto)
    return filled.withColumn("cumulative", total).withColumn(
        "ltv", F.col("cumulative").cast("double") / F.col("customers")
    )
