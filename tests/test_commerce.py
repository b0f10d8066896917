"""Shop reports against plain loops; hot users and customers."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parlance.operators import commerce
from parlance.operators.ranking import in_ranges

STEPS = {"visit": "kind = 'v'", "cart": "kind = 'c'", "paid": "kind = 'p'"}
START = datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, user_id long, kind string"


def first_times(rows, limit):
    """Every user's first time at every step, trying all beginnings."""
    by_user = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        if r[2] is not None and r[3] in "vcp":
            by_user[r[2]].append((r[1], "vcp".index(r[3])))
    found = {}
    for user, events in by_user.items():
        best = {}
        for k, (begin, step) in enumerate(events):
            if step:
                continue
            want = 0
            for at, s in events[k:]:
                if s == want and at - begin <= limit:
                    taken = at - begin
                    if want not in best or (at, taken) < best[want]:
                        best[want] = (at, taken)
                    want += 1
        for step, (at, taken) in best.items():
            found[user, list(STEPS)[step]] = (at, int(taken.total_seconds() // 1))
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_step_times_by_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        user = 7 if rng.random() < 0.34 else rng.choice([None, *range(60)])
        minute = rng.choice([rng.randrange(3000), 10 * rng.randrange(30)])  # many equal times
        rows.append((i, START + timedelta(minutes=minute, microseconds=rng.choice([0, 1])), user, rng.choice("vvccpx")))
    for minutes in (0, 45, 400):
        limit = timedelta(minutes=minutes)
        df = spark.createDataFrame(rows, EVENTS).repartition(3)
        got = {(r["user"], r["step"]): (r["at"], r["seconds"]) for r in commerce.step_times(df, STEPS, limit).collect()}
        want = first_times(rows, limit)
        assert got == want and any(step == "paid" for _, step in want) == (minutes > 0 or any(k[1] == "paid" for k in want))


def test_time_limit_on_both_sides(spark):
    at = lambda s: START + timedelta(seconds=s)
    rows = [(1, at(0), 1, "v"), (2, at(3600), 1, "c"), (3, at(0), 2, "v"), (4, at(3600.000001), 2, "c"),
            (5, at(10), 3, "c"), (6, at(20), 3, "v"), (7, at(0), 4, "v"), (8, at(4000), 4, "v"), (9, at(5000), 4, "c")]
    times = commerce.step_times(spark.createDataFrame(rows, EVENTS), STEPS, timedelta(hours=1))
    carts = {r["user"]: r["seconds"] for r in times.where("step = 'cart'").collect()}
    assert carts == {1: 3600, 4: 1000}
    funnel = [tuple(r) for r in commerce.checkout_funnel(times, STEPS).orderBy("place").collect()]
    assert funnel == [(0, "visit", 4, 0, 1.0, None), (1, "cart", 2, 1000, 0.5, 0.5), (2, "paid", 0, None, 0.0, 0.0)]


def test_hot_user_is_folded_in_several_ranges(spark):
    """A user with a third of the rows: the ranges are even, so no task folds all of them."""
    hot = F.col("id") % 3 == 0
    df = spark.range(60_000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"),
        F.when(hot, -1).otherwise(F.col("id") % 4000).alias("user_id"), F.substring(F.lit("vcp"), (F.col("id") / 3).cast("int") % 3 + 1, 1).alias("kind"),
    )
    ranged = in_ranges(df, ["user_id", "ts", "event_id"])
    sizes = sorted(r["count"] for r in ranged.groupBy("_range").count().collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2] and ranged.where("user_id = -1").select("_range").distinct().count() > 1
    times = commerce.step_times(df, STEPS, timedelta(minutes=1)).where("user = -1")
    assert {r["step"]: r["seconds"] for r in times.collect()} == {"visit": 0, "cart": 3, "paid": 6}
    assert commerce.step_times(df.limit(0), STEPS, timedelta(1)).count() == 0


ORDERS = "o long, c long, t timestamp"


def some_orders(rng, size=1500):
    return [
        (i, None if i % 50 == 0 else 3 if rng.random() < 0.33 else rng.randrange(40_000),
         None if i % 77 == 0 else START + timedelta(days=rng.randrange(700)))
        for i in range(size)
    ]


def test_cohorts_by_brute_force(spark):
    rows = some_orders(random.Random(4))
    months = defaultdict(set)
    for _, c, t in rows:
        if c is not None and t is not None:
            months[c].add(t.year * 12 + t.month - 1)
    last = max(max(m) for m in months.values())
    want = {}
    for cohort in {min(m) for m in months.values()}:
        mine = [m for m in months.values() if min(m) == cohort]
        for month in range(cohort, last + 1):
            back = sum(any(cohort < x <= month for x in m) for m in mine)
            want[cohort, month - cohort] = (sum(month in m for m in mine), len(mine), back)
    orders = spark.createDataFrame(rows, ORDERS).repartition(3)
    bitmaps = commerce.cohort_bitmaps(orders, "c", "t")
    got = {
        (r["cohort_month"].year * 12 + r["cohort_month"].month - 1, r["month_offset"]): (r["active"], r["cohort_size"], r["returned"])
        for r in commerce.cohort_matrix(bitmaps).collect()
    }
    assert got == want
    # bitmaps of any two parts of the customers merge into those of all
    half = [bitmaps.where(F.col("bucket") == b) for b in range(1, 3)]
    both = commerce.merged_bitmaps(half[0].unionByName(half[1]), ["cohort"])
    assert both.agg(F.sum(F.bitmap_count("customers"))).first()[0] == len(months)
    plan = commerce.cohort_matrix(bitmaps)._jdf.queryExecution().executedPlan().toString()
    assert "distinct" not in plan.lower() and "NestedLoop" not in plan


def test_lifetime_value_by_brute_force(spark):
    rng = random.Random(6)
    rows = some_orders(rng, 600)
    lines = [(o, k, rng.choice(["p", "q", None]), round(rng.random() * 90, 2)) for o, _, _ in rows for k in range(rng.randrange(4))]
    lines.append((999_999, 1, "p", 5.0))  # a line without an order
    priced = commerce.order_revenue(
        spark.createDataFrame(rows, "order long, customer long, time timestamp"),
        spark.createDataFrame(lines, "order long, line int, product string, price double").repartition(3),
        F.col("price").cast("decimal(12,2)"),
    )
    per_order = defaultdict(float)
    first_line = {}
    for o, k, p, v in lines:
        per_order[o] += v
        first_line[o] = min(first_line.get(o, (k, p)), (k, p))
    known = [r for r in rows if r[1] is not None and r[2] is not None]
    firsts = {}
    for o, c, t in known:
        firsts[c] = min(firsts.get(c, (t, o)), (t, o))
    product = {c: first_line.get(o, (0, None))[1] for c, (_, o) in firsts.items()}
    revenue = defaultdict(float)
    for o, c, t in known:
        begin = firsts[c][0]
        revenue[product[c], (t.year - begin.year) * 12 + t.month - begin.month] += per_order[o]
    got = commerce.lifetime_value(priced).collect()
    for r in got:
        assert float(r["revenue"]) == pytest.approx(revenue[r["product"], r["age"]])
        upto = sum(v for (p, a), v in revenue.items() if p == r["product"] and a <= r["age"])
        customers = sum(p == r["product"] for p in product.values())
        assert float(r["cumulative"]) == pytest.approx(upto) and r["customers"] == customers
        assert r["ltv"] == pytest.approx(upto / customers)
    assert sum(r["revenue"] for r in got) == priced.where("customer is not null and time is not null").agg(F.sum("revenue")).first()[0]
    assert {(r["product"], r["age"]) for r in got} >= {k for k, v in revenue.items() if v}
