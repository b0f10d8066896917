"""Near-duplicate vectors by an exact metric range join.

Vectors of a label belong to the cell of their nearest pivot. A vector is also sent to every cell
that, by the triangle inequality, may hold a vector within the range; cells are then joined
independently, each in pairs of blocks of bounded size. The pairs are dealt to rounds, in each of
which a bounded number of copies of the vectors is shuffled.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import components, dropped, mixed, stored

#: Different vectors a cell has on average before replication, pivots a label has at most, and
#: pivots of all labels together at most.
CELL, MOST_PIVOTS, ALL_PIVOTS = 8192, 512, 8192
#: Vectors of one block of a cell, fewer if they have more than WIDTH components.
BLOCK, WIDTH = 16384, 64
#: Copies of the vectors that one round shuffles, on average.
SHARE = 2
#: Tables of links that are read side by side.
TABLES = 32
#: Room for rounding in bounds; the range itself is decided on the cosine.
ROUNDING = 1e-9


def unit(values: np.ndarray) -> np.ndarray:
    """Vectors of length 1. The largest component is brought near 1 by a power of two first, so that
    no square is too large or too small, and no digit changes."""
    _, exponent = np.frexp(np.abs(values).max(axis=1, keepdims=True, initial=0.0))
    values = np.ldexp(values, -exponent)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def matrix(arrays: pa.Array) -> np.ndarray:
    """Equally long lists as rows of doubles."""
    flat = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(arrays), -1)


def cells(vectors: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, vectors x cells that may hold a partner). A partner at distance ``reach`` or
    less in the cell of pivot j is at least as near to j as to the home pivot i; on the line
    through i and j both lie on either side of the middle, at most ``reach`` apart."""
    dot = vectors @ pivots.T
    home = dot.argmax(axis=1)
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[home]
    behind = dot[np.arange(len(home)), home][:, None] - dot  # distance to the middle x between
    near = behind <= reach * between + ROUNDING
    near[np.arange(len(home)), home] = True
    return home, near


def linked(table: pa.Table, least: float) -> pa.Table:
    """One pair of blocks of a cell: for each query vector the vectors of the data block with a
    cosine of ``least`` or more, as a number (copies counted) and the smallest id, if there are any;
    and a spanning set of the links."""
    table = table.combine_chunks()
    queries, data = table.filter(table["query"]), table.filter(table["data"])
    if not len(queries) or not len(data):
        return pa.Table.from_pylist([], LINKS)
    q, d = (unit(matrix(x["vec"].combine_chunks())) for x in (queries, data))
    ids, copies = data["vec_id"].to_numpy(), data["copies"].to_numpy()
    order = np.argsort(ids)
    d, ids, copies = d[order], ids[order], copies[order]
    own = queries["vec_id"].to_numpy()
    parts = []
    root = np.arange(len(ids))  # smallest id each data vector is known to be linked to

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    joins: list[tuple[int, int]] = []
    for start in range(0, len(q), 512):
        near = q[start : start + 512] @ d.T >= least
        me = own[start : start + 512]
        near &= ids[None, :] != me[:, None]
        some = np.flatnonzero(near.any(axis=1))
        parts.append((me[some], near[some] @ copies))
        for i in some:
            found = np.flatnonzero(near[i])
            joins.append((int(me[i]), int(ids[found[0]])))
            first = find(found[0])
            for j in found[1:]:  # links between the partners of one query follow from it
                other = find(j)
                if other != first:
                    joins.append((int(ids[found[0]]), int(ids[j])))
                    root[max(first, other)] = min(first, other)
                    first = min(first, other)
    a, b = np.array(sorted(set(joins)), np.int64).reshape(-1, 2).T
    own, links = (np.concatenate(x) for x in zip(*parts))
    return pa.Table.from_arrays(
        [
            pa.array(np.concatenate([own, b])), pa.array(np.concatenate([links, np.zeros(len(b), np.int64)])),
            pa.concat_arrays([pa.nulls(len(own), pa.int64()), pa.array(a)]),
        ],
        schema=LINKS,
    )


LINKS = pa.schema([("vec_id", pa.int64()), ("links", pa.int64()), ("a", pa.int64())])


def blocks_of(n: int, size: int) -> int:
    return math.ceil(n / max(1, min(BLOCK, BLOCK * WIDTH // max(size, 1))))


def round_of(key: tuple, cell: int, i: int, j: int, rounds: int) -> int:
    return zlib.crc32(f"{key[0]}|{key[1]}|{cell}|{i}|{j}".encode()) % rounds


def near_vectors(
    vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept (vec_id = component_id).

    Two rows are linked if their labels are equal and not null and the cosine of their vectors,
    in double precision, is ``least`` (0 or more) or more. Rows whose vector is null, empty,
    zero or holds a null or a component that is not finite, and rows with a null label, have no
    links. Equal vectors of a label are one vector with a number of copies, all linked to each
    other. Vectors of different lengths are not linked. Rows without an
    id have no links. Rows of one id and different vectors are not linked to each other and share
    their links and component. An empty table gives an empty result.

    The driver holds ALL_PIVOTS pivots at most, and the pairs of blocks of cells with more than one.
    Beyond MOST_PIVOTS times CELL vectors of a label, cells grow and are joined in more blocks. Where
    the bounds exclude nothing, all vectors of a label are compared: copies, and with them the rounds,
    grow with the vectors of a label, the disk of a round does not.
    """
    single = dict(vectors.dtypes)[vector] == "array<float>"  # as doubles they would be twice as large
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(vector).cast(f"array<{'float' if single else 'double'}>").alias("vec"), F.col(label).alias("label"),
    )
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists(
        "vec", lambda x: x != 0
    )
    same = ["label", "size", "key", "key2"]  # equal vectors of a label have equal hashes of 128 bits
    good = rows.where(F.coalesce(usable, F.lit(False))).withColumns(
        {"size": F.size("vec"), "key": F.xxhash64("vec"), "key2": F.xxhash64(F.lit(7), "vec")}
    )
    distinct = stored(
        good.groupBy(*same).agg(
            F.first("vec").alias("vec"), F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")
        ),
        "distinct-vectors", large=True,
    )
    groups = distinct.groupBy("label", "size").agg(F.count("*").alias("n"))
    # a seeded share of each label as pivots; rows of the hash order make the choice repeatable
    share = F.least(F.lit(1.0), F.lit(1 / CELL), F.lit(float(MOST_PIVOTS)) / F.col("n"))
    draw = F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(1 << 30)) / float(1 << 30)
    drawn = distinct.join(groups, ["label", "size"]).where(draw < share)
    places: dict[tuple, np.ndarray] = {}
    for row in drawn.orderBy(draw, "key").limit(ALL_PIVOTS).select("label", "size", "vec").collect():
        places.setdefault((str(row["label"]), row["size"]), []).append(row["vec"])
    places = {k: unit(np.unique(np.array(v, np.float64), axis=0)) for k, v in places.items()}
    pivots = vectors.sparkSession.sparkContext.broadcast(places)
    reach = float(np.sqrt(2 - 2 * least))

    def placed(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, np.ndarray]]:
        """(group and size, their rows, home cells, rows x cells they are sent to)."""
        keys = list(zip(batch.column("group").to_pylist(), batch.column("size").to_pylist()))
        at = defaultdict(list)
        for i, key in enumerate(keys):
            at[key].append(i)
        for key, found in at.items():
            found, mine = np.array(found), pivots.value.get(key)
            if mine is None:  # a small label is one cell
                yield key, found, np.zeros(len(found), np.int64), np.ones((len(found), 1), bool)
            else:
                yield key, found, *cells(unit(matrix(batch.column("vec").take(pa.array(found)))), mine, reach)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[tuple, list[int]] = {}
        for batch in batches:
            for key, _, home, near in placed(batch):
                for cell, (n, own) in enumerate(zip(near.sum(axis=0), np.bincount(home, minlength=near.shape[1]))):
                    total = sizes.setdefault((*key, cell), [0, 0])
                    total[0] += int(n)
                    total[1] += int(own)
            if len(sizes) > 1 << 16:
                yield counted(sizes)
        yield counted(sizes)

    def counted(sizes: dict[tuple, list[int]]) -> pa.RecordBatch:
        rows = [dict(zip(("group", "size", "cell", "n", "own"), (*k, *v))) for k, v in sizes.items()]
        sizes.clear()
        return pa.RecordBatch.from_pylist(rows, pa.schema(
            [("group", pa.string()), ("size", pa.int32()), ("cell", pa.int32()), ("n", pa.int64()), ("own", pa.int64())]
        ))

    sent = distinct.select(F.col("label").cast("string").alias("group"), "size", "vec_id", "copies", "vec")
    cell = ["group", "size", "cell"]
    sizes = sent.mapInArrow(measure, "group string, size int, cell int, n long, own long")
    sizes = stored(sizes.groupBy(*cell).agg(F.sum("n").alias("n"), F.sum("own").alias("own")), "cell-sizes")
    # queries of a cell, its own rows, are cut into blocks, and its data, all rows, into others; a pair
    # of these is one task. Most cells are one pair; of the others the numbers of blocks are shared
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK * WIDTH) / F.col("size"))))
    large = sizes.where(F.col("n") > most).collect()
    cut = {((r["group"], r["size"]), r["cell"]): tuple(blocks_of(r[c], r["size"]) for c in ("own", "n")) for r in large}
    whole = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("own"), F.lit(0))).first()
    copies = whole[0] + sum(r["own"] * c[1] + r["n"] * (c[0] - 1) for r, c in zip(large, cut.values()))
    rounds = max(1, math.ceil(copies / (SHARE * max(whole[1], 1))))
    pairs = [defaultdict(list) for _ in range(rounds)]
    for (key, number), (i, j) in cut.items():
        for x in range(i):
            for y in range(j):
                pairs[round_of(key, number, x, y, rounds)][key].append((number, x, y, i, j))

    def dealt(k: int) -> DataFrame:
        """Rows of the pairs of blocks of a round, once a pair."""
        shared = sent.sparkSession.sparkContext.broadcast((dict(pairs[k]), set(cut)))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine, cut = shared.value
            for batch in batches:
                ids = batch.column("vec_id").to_numpy()
                for key, rows, home, near in placed(batch):
                    spread = mixed(ids[rows])
                    todo = mine.get(key, []) + [
                        (c, 0, 0, 1, 1) for c in range(near.shape[1])
                        if (key, c) not in cut and round_of(key, c, 0, 0, rounds) == k
                    ]
                    for c, x, y, i, j in todo:
                        query = (home == c) & (spread % np.uint64(i) == x)
                        data = near[:, c] & (mixed(spread) % np.uint64(j) == y)
                        at = np.flatnonzero(query | data)
                        if not len(at):
                            continue
                        place = [pa.array(np.full(len(at), v, np.int32)) for v in (c, x, y)]
                        own = batch.take(pa.array(rows[at]))
                        yield pa.RecordBatch.from_arrays(
                            [*own.columns, *place, pa.array(query[at]), pa.array(data[at])],
                            names=[*own.schema.names, "cell", "i", "j", "query", "data"],
                        )

        columns = ", ".join(f"{n} {t}" for n, t in sent.dtypes)
        return sent.mapInArrow(deal, f"{columns}, cell int, i int, j int, query boolean, data boolean")

    tables: list[DataFrame] = []
    for k in range(rounds):
        found = dealt(k).groupBy(*cell, "i", "j").applyInArrow(
            lambda table: linked(table, least), "vec_id long, links long, a long"
        )
        tables.append(stored(found, "vector-links", large=True))
        if len(tables) == TABLES or k == rounds - 1:
            found = tables[0]
            for table in tables[1:]:
                found = found.unionByName(table)
            if len(tables) > 1:
                found = stored(found.coalesce(TABLES), "vector-links")
                dropped(*tables)
            tables = [found]
    found = tables[0]
    links = found.where("a is null").groupBy("vec_id").agg(F.sum("links").alias("links"))
    roots = components(found.where("a is not null").select("a", F.col("vec_id").alias("b")))
    of = (
        distinct.select(*same, "vec_id", "copies")
        .join(links, "vec_id", "left").join(roots, F.col("vec_id") == F.col("node"), "left")
        .select(
            *same, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "vec_id").alias("component_id"),
        )
    )
    answered = good.select("vec_id", *same).join(of, same).select("vec_id", "n_links", "component_id")
    rest = rows.where(~F.coalesce(usable, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return answered.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
