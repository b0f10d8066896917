"""Shards of documents by balanced label propagation.

Rows start in shards of equal counts by the place of their hash. Then, round by round, the members
of each group of linked rows want to move to the shard that holds most of the group; a move is
granted while it keeps every shard within its quota of rows, larger groups first. A shard that had
to refuse is full, and what it refused looks for another one. In the end, small groups leave shards
that hold more than their exact quota, and rows without links fill the shards up.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import components, stored

#: Rows that are numbered together, about.
RUN = 1 << 14
#: Groups of more than a share of 1 / LARGE of all rows are placed one by one; so there are fewer than LARGE.
LARGE = 1024
#: Moves of groups of like size into one shard are granted in so many parts.
PARTS = 16
#: While moves are granted, a shard may hold this much more than its quota; the rest is repaired at the end.
SLACK = 1 / 16


def _before(cells: DataFrame, keys: list[str], order: list[str], n: str) -> DataFrame:
    """``cells`` with ``before``: the sum of ``n`` over the earlier cells of the same keys."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("before", F.coalesce(F.sum(n).over(window), F.lit(0)))


def placed(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` (order, row, ...) with ``pos``: 0, 1, ... by ``order``, without gaps. Rows of equal
    order are numbered in any way; where they are many, they are spread over several tasks."""
    bits = max(6, int(np.ceil(np.log2(max(total / RUN, 1)))))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("order", 64 - bits))
    parts = rows.groupBy("bucket").agg(F.ceil(F.count("*") / (4 * RUN)).alias("parts"))
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    rows = rows.join(parts, "bucket").withColumn("part", part).drop("parts")
    cells = rows.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    cells = _before(cells, [], ["bucket", "part"], "n").drop("n")
    rank = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("order", "row"))
    numbered = rows.withColumn("rank", rank).join(cells, ["bucket", "part"])
    return numbered.withColumn("pos", F.col("before") + F.col("rank") - 1).drop(
        "bucket", "part", "rank", "before", "order", "row"
    )


def numbered(rows: DataFrame, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (pos, ...) with ``out``: 0, 1, ... by ``pos`` within ``keys``, without gaps."""
    rows = rows.withColumn("run", F.floor(F.col("pos") / (4 * RUN)))
    cells = rows.groupBy(*keys, "run").agg(F.count("*").alias("n"))
    cells = _before(cells, list(keys), ["run"], "n").drop("n")
    rank = F.row_number().over(Window.partitionBy(*keys, "run").orderBy("pos"))
    found = rows.withColumn("_rank", rank).join(cells, [*keys, "run"])
    return found.withColumn(out, F.col("before") + F.col("_rank") - 1).drop("run", "_rank", "before")


def quotas(total: int, shards: int) -> np.ndarray:
    """Rows of each shard: those positions ``p`` for which ``p * shards // total`` is the shard."""
    first = -(-np.arange(shards + 1, dtype=np.int64) * total // shards)
    return np.diff(first)


def granted(room: np.ndarray, moves: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(granted bundles, refusing shards).

    ``moves`` has a row (bundle, to, from) for every ``sizes`` rows that want to move; bundles are
    granted whole, and a lower bundle before a higher one. ``room`` is what each shard can take
    beyond what it holds. Starting from all moves, bundles into shards that would hold too much are
    refused, the last ones first, until all hold; a refusal may keep rows in other shards.
    """
    shards, bundles = len(room), int(moves[:, 0].max()) + 1 if len(moves) else 0
    bundle, to, source = moves.T if len(moves) else np.zeros((3, 0), np.int64)
    open_, refusing = np.ones(bundles, bool), np.zeros(shards, bool)
    while True:
        live = open_[bundle]
        over = np.bincount(to[live], sizes[live], shards) - np.bincount(source[live], sizes[live], shards) - room
        full = np.flatnonzero(over > 0)
        if not len(full):
            return open_, refusing
        refusing[full] = True
        for shard in full:
            mine = np.flatnonzero(live & (to == shard))
            weight = np.bincount(bundle[mine], sizes[mine], bundles)
            last = np.flatnonzero(weight)[::-1]
            upto = int(np.searchsorted(np.cumsum(weight[last]), over[shard])) + 1
            open_[last[:upto]] = False


def plan_large(
    counts: np.ndarray, quota: np.ndarray, load: np.ndarray, open_: np.ndarray
) -> list[list[tuple[int, int]]]:
    """Wanted (shard, rows) of each large group, from its rows in each shard; largest group first.
    A group goes to the shard that holds most of it and has the room, or, if none has, to several.
    In a shard that has refused moves, the room is what the group has there and what is left."""
    room, plans = np.where(open_, quota, quota - load).astype(np.int64), [[] for _ in counts]
    for g in np.argsort(-counts.sum(1), kind="stable"):
        mine, rest = counts[g], int(counts[g].sum())
        free = room + np.where(open_, 0, mine)
        usable = open_ | (mine * 2 >= quota)
        order = [int(s) for s in np.lexsort((np.arange(len(mine)), -mine)) if usable[s] and free[s] > 0]
        whole = [s for s in order if free[s] >= rest]
        for s in whole[:1] or order:
            take = min(rest, int(free[s]))
            plans[g].append((s, take))
            room[s] -= take if open_[s] else max(0, take - int(mine[s]))
            rest -= take
            if not rest:
                break
    return plans


def _large_wishes(
    members: DataFrame, found: list, quota: np.ndarray, load: np.ndarray, open_: np.ndarray
) -> tuple[DataFrame, np.ndarray]:
    """(group, stay, upto, to): shards of a large group that keep their members, and the shards that
    the others go to, by running shares of what each lacks; and the rows planned for each shard."""
    groups = sorted({r["group"] for r in found})
    counts = np.zeros((len(groups), len(quota)), np.int64)
    place = {g: i for i, g in enumerate(groups)}
    for r in found:
        counts[place[r["group"]], r["shard"]] = r["n"]
    rows, planned = [], np.zeros(len(quota), np.int64)
    for g, plan in zip(groups, plan_large(counts, quota, load, open_)):
        for s, take in plan:
            planned[s] += take
        lack = [(s, take - int(counts[place[g], s])) for s, take in plan if take > counts[place[g], s]]
        share = np.cumsum([x for _, x in lack]) / max(1, sum(x for _, x in lack))
        rows.append((g, [s for s, _ in plan], share.tolist(), [s for s, _ in lack]))
    schema = "group long, stay array<int>, upto array<double>, to array<int>"
    return members.sparkSession.createDataFrame(rows, schema), planned


def _wishes(members: DataFrame, quota: np.ndarray, load: np.ndarray, open_: np.ndarray) -> DataFrame:
    """``members`` (pos, group, large, n, shard) with ``wish``, the shard to move to, or null. Small
    groups leave the shards that large ones are to fill."""
    counts = members.groupBy("group", "large", "shard").agg(F.count("*").alias("n"))
    found = counts.where("large").select("group", "shard", "n").collect()  # fewer than LARGE groups
    large, planned = _large_wishes(members, found, quota, load, open_)
    taken = planned * 10 >= quota * 9
    free = np.flatnonzero(open_ & ~taken)
    flag = lambda mask: F.array(*[F.lit(bool(x)) for x in mask])[F.col("shard")]
    best = F.max(
        F.struct(flag(open_ & ~taken).alias("open"), "n", F.xxhash64("group", "shard").alias("tie"), "shard")
    )
    small = (
        counts.where("not large").groupBy("group")
        .agg(best.alias("best"), F.max(F.when(~flag(taken), F.col("n"))).alias("most"), F.sum("n").alias("all"))
        .where("most is null or most < all").select(F.col("group").alias("_group"), F.lit(False).alias("_large"), "best")
    )
    if len(free):
        drawn = F.array(*[F.lit(int(s)) for s in free])[F.pmod(F.xxhash64("_group"), F.lit(len(free))).cast("int")]
        target = F.when(F.col("best.open"), F.col("best.shard")).otherwise(drawn)
    else:
        target = F.lit(None).cast("int")
    small = small.select("_group", "_large", target.alias("target"))
    # members of a large group find their plan by broadcast and are kept out of the join by group
    key = F.when(F.col("large"), F.col("pos")).otherwise(F.col("group"))
    draw = F.pmod(F.xxhash64(F.lit(3), "pos"), F.lit(1 << 30)) / float(1 << 30)
    pick = F.get("to", F.size(F.filter("upto", lambda x: x <= draw)))
    to = F.when(F.col("large"), F.when(~F.array_contains("stay", F.col("shard")), pick)).otherwise(F.col("target"))
    joined = members.join(F.broadcast(large), "group", "left").withColumn("_key", key)
    joined = joined.join(small, (F.col("_key") == F.col("_group")) & (F.col("large") == F.col("_large")), "left")
    return joined.select(*members.columns, F.when(to != F.col("shard"), to).alias("wish"))


def _load(members: DataFrame, shards: int) -> np.ndarray:
    load = np.zeros(shards, np.int64)
    for r in members.groupBy("shard").count().collect():
        load[r["shard"]] = r["count"]
    return load


def _leaving(members: DataFrame, over: np.ndarray) -> DataFrame:
    """(pos, rank): ``over`` rows of each shard, those of its smallest groups, ranked 0, 1, ... over
    all shards with the members of a group behind each other."""
    key = F.when(F.col("large"), F.col("pos")).otherwise(F.col("group"))
    rows = members.select(
        "pos", "shard", F.xxhash64(F.lit(5), "group").alias("order"), F.log2("n").cast("int").alias("class"),
        F.pmod(F.xxhash64(F.lit(7), key), F.lit(4 * PARTS)).cast("int").alias("part"),
    ).where(F.array(*[F.lit(bool(x)) for x in over])[F.col("shard")])
    cells = _before(
        rows.groupBy("shard", "class", "part").agg(F.count("*").alias("n")), ["shard"], ["class", "part"], "n"
    )
    quota = F.array(*[F.lit(int(x)) for x in over])[F.col("shard")] - F.col("before")
    cells = cells.withColumn("quota", quota).where("quota > 0").select("shard", "class", "part", "n", "quota")
    rank = F.row_number().over(Window.partitionBy("shard", "class", "part").orderBy("order", "pos"))
    inside = rows.join(F.broadcast(cells), ["shard", "class", "part"]).withColumn("_rank", rank)
    chosen = inside.where("_rank <= quota").select("pos", "order", F.col("pos").alias("row"))
    return placed(chosen.withColumnRenamed("pos", "at"), int(over.sum())).select(F.col("at").alias("pos"), F.col("pos").alias("rank"))


def propagate(rows: DataFrame, shards: int, rounds: int = 12) -> DataFrame:
    """(pos, shard) of ``rows`` (pos: 0, 1, ... without gaps; group: long, or null for a row without
    links). Counts of the shards are at most one apart; members of a group are put together as far
    as the quotas allow. A group too large for one shard fills several.

    Each round counts the rows of every (group, shard) with partial aggregation and joins the
    wanted shard back; only counts of moves by (shard, shard, size class, part) and the plans of
    fewer than LARGE large groups pass through the driver.
    """
    total = rows.count()
    quota = quotas(total, shards)
    sizes = rows.where("group is not null").groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    sizes = stored(sizes, "group-sizes")
    large = sizes.where(F.col("n") * LARGE > total).select("group", F.col("n").alias("_many"))
    start = F.expr(f"cast(pos * {shards} div {max(total, 1)} as int)")
    few = sizes.where(F.col("n") * LARGE <= total).select(
        F.col("group").alias("_group"), F.lit(False).alias("_large"), "n"
    )
    marked = rows.select("pos", "group").join(F.broadcast(large), "group", "left")
    marked = marked.withColumn("large", F.col("_many").isNotNull()).withColumn(
        "_key", F.when(F.col("large") | F.col("group").isNull(), F.col("pos")).otherwise(F.col("group"))
    ).withColumn("_out", F.col("large") | F.col("group").isNull())
    marked = marked.join(few, (F.col("_key") == F.col("_group")) & (F.col("_out") == F.col("_large")), "left")
    marked = stored(
        marked.select("pos", "group", "large", F.coalesce("_many", "n").alias("n"), start.alias("shard")),
        "shard-start",
    )
    members = marked.where("n is not null")
    open_ = np.ones(shards, bool)
    load = _load(members, shards)
    for _ in range(rounds):
        many = F.log2("n").cast("int")
        part = F.pmod(F.xxhash64(F.lit(11), F.when(F.col("large"), F.col("pos")).otherwise(F.col("group"))), F.lit(PARTS))
        wanted = _wishes(members, quota, load, open_).withColumn("class", many).withColumn("part", part.cast("int"))
        wanted = stored(wanted, "shard-wishes")
        moves = wanted.where("wish is not null").groupBy("class", "part", "wish", "shard").agg(F.count("*").alias("moving"))
        moves = moves.collect()  # at most shards * shards * classes * PARTS
        if not moves:
            break
        names = sorted({(-r["class"], r["part"], r["wish"]) for r in moves})
        place = {name: i for i, name in enumerate(names)}
        table = np.array([(place[-r["class"], r["part"], r["wish"]], r["wish"], r["shard"]) for r in moves], np.int64)
        yes, refusing = granted(quota + (quota * SLACK).astype(np.int64) - load, table, np.array([r["moving"] for r in moves], np.int64))
        passed = [(-c, p, s) for (c, p, s), ok in zip(names, yes) if ok]
        passed = members.sparkSession.createDataFrame(passed, "class int, part int, wish int")
        moved = wanted.join(
            F.broadcast(passed.withColumn("_yes", F.lit(True))), ["class", "part", "wish"], "left"
        ).withColumn("shard", F.when(F.col("_yes"), F.col("wish")).otherwise(F.col("shard")))
        members = stored(moved.select("pos", "group", "large", "n", "shard"), "shard-labels")
        load = _load(members, shards)
        if not refusing.any() or not (yes.any() or (open_ & refusing).any()):
            break
        open_ &= ~refusing
    over, lack = np.maximum(load - quota, 0), np.maximum(quota - load, 0)
    found = members.select("pos", "shard")
    ends = F.array(*[F.lit(int(x)) for x in np.cumsum(lack)])
    shard = lambda rank: F.size(F.filter(ends, lambda x: x <= rank)).alias("shard")
    if over.any():
        moved = stored(_leaving(members, over), "shard-leaving")
        moved = moved.select("pos", shard(F.col("rank")).alias("_to"))
        found = found.join(moved, "pos", "left").select("pos", F.coalesce("_to", "shard").alias("shard"))
    rest = numbered(marked.where("n is null").select("pos"), "rank")
    return found.unionByName(rest.select("pos", shard(F.col("rank") + int(over.sum()))))


def linked_groups(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (pos, ...) with ``group``: the connected component under ``links`` (a, b) of
    positions, null for rows without links."""
    found = components(links).select(F.col("node").alias("pos"), F.col("root").alias("group"))
    return rows.join(found, "pos", "left")


def shard_documents(
    docs: DataFrame, shards: int, *, text: str = "text", id_col: str = "doc_id", seed: int = 17,
    group: Column | None = None, rounds: int = 12,
) -> DataFrame:
    """One row per input row: doc_id, size (UTF-8 bytes of the text and 16), text_crc32, law
    ('rows': counts of shards are at most one apart), shard, slot (0, 1, ... in each shard),
    grown_shard (null: another number of shards is another assignment).

    Rows of equal ``group`` (default: equal texts; null is none) are linked. Null texts have no
    bytes and are linked with empty ones. Rows are told apart by place, so null and repeated ids
    and equal rows each get a slot of their own. An empty table gives an empty result; other columns
    are not looked at. Reruns agree, up to rows equal in id and text where those are very many.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(whole) + 16).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        (F.xxhash64(whole) if group is None else group).alias("group"), F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), whole).alias("order"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stored(rows, "shard-rows")
    rows = stored(placed(rows, rows.count()), "shard-places")
    labels = propagate(rows.select("pos", "group"), shards, rounds)
    labels = stored(numbered(labels, "slot", ("shard",)), "shard-slots")
    return rows.join(labels, "pos").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"),
        F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"),
    )


def cut_links(rows: DataFrame) -> DataFrame:
    """One row of ``rows`` (group, shard): links between equal groups in all, and those between
    shards. A group of n has n - 1 links, of which as many are cut as it lies in further shards."""
    parts = rows.where("group is not null").groupBy("group", "shard").agg(F.count("*").alias("n"))
    groups = parts.groupBy("group").agg(F.sum("n").alias("n"), F.count("*").alias("parts"))
    return groups.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("links"),
        F.coalesce(F.sum(F.col("parts") - 1), F.lit(0)).alias("cut"),
    )
