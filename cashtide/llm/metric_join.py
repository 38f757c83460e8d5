"""Near duplicates among embeddings by an exact metric range join.

Vectors of one label are compared by cosine; ``cosine >= threshold`` is the same as a
distance of at most ``r`` between the vectors at unit length, and that distance is a metric.

Equal vectors of a label form a class first, so copies are one vector with a weight.  A
label with many classes gets pivots, and every class lives in the cell of its nearest one.
A vector also visits the cells of smaller number that may hold a partner of it.  By the
triangle inequality a partner in cell ``k`` asks that

- ``d(x, p_k) <= radius_k + r``, the radius being that of the cell's farthest member, and
- ``d(x, p_k) <= d(x, p_own) + 2 r``, as the partner is no nearer to the pivot of ``x``.

Each pair of linked vectors so meets once, and cells join on their own.  A cell or its
visitors beyond ``block`` are dealt to blocks, and pairs of blocks are the tasks, so a hot
cell is work for many.  A task returns sums per vector and a spanning forest of its links,
never the pairs.

Each row is a vector of its own.  Vectors without a label, null, empty or zero vectors, and
such with null or non-finite components link with nothing; neither do vectors of different
length.  Rows may repeat and ids may be null: the component is then named by the least id
that is set, and is null without one; rows that repeat an id share its verdict.  An empty
table gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.llm.common import Scratch
from cashtide.llm.components import components

#: Classes that a cell holds on average, and the most that one side of a task holds.
CELL = BLOCK = 2048
#: Pivots of all labels together: what is collected and broadcast.
MOST_PIVOTS = 4096
#: Added to distances, far above the rounding of their computation.
SLACK = 1e-6
#: Cosines nearer to the threshold are computed again with exact sums.
CLOSE = 1e-11
_STRIP = 512


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors at unit length; scaled first, so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def distances(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (units @ pivots.T), 0))


def linked(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``left`` and ``right`` have at least this cosine, as a matrix."""
    a, b = unit(left), unit(right)
    out = np.zeros((len(a), len(b)), bool)
    for at in range(0, len(a), _STRIP):
        cosines = a[at : at + _STRIP] @ b.T
        out[at : at + _STRIP] = cosines >= threshold
        for i, j in np.argwhere(np.abs(cosines - threshold) < CLOSE).tolist():
            out[at + i, j] = exact_cosine(left[at + i], right[j]) >= threshold
    return out


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph between rows and columns; each node is looked at once."""
    rows, columns = ~links.any(axis=1), ~links.any(axis=0)  # what has been seen
    edges = []
    for start in np.flatnonzero(~rows).tolist():
        if rows[start]:
            continue
        rows[start], ahead = True, [(0, start)]
        while ahead:
            side, node = ahead.pop()
            line, seen = (links[:, node], rows) if side else (links[node], columns)
            new = np.flatnonzero(line & ~seen)
            seen[new] = True
            edges += [(n, node) if side else (node, n) for n in new.tolist()]
            ahead += [(1 - side, n) for n in new.tolist()]
    return edges


def _vectors(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _classes(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Equal vectors of a label as one ``node`` with a weight ``n``."""
    found = rows.filter("k1 is not null").groupBy("k1", "k2", "label", "dim").agg(F.first("vec").alias("vec"), F.count("*").alias("n"))
    return scratch.store(found.withColumn("node", F.monotonically_increasing_id()))


def _pivots(classes: DataFrame, sizes: DataFrame, cell: int) -> dict[tuple[str, int], np.ndarray]:
    """Pivots by label and dimension, at most ``MOST_PIVOTS``: a sample by digest.

    Only labels that get two or more are there; the others are one cell each.
    """
    total = sizes.agg(F.sum("size")).first()[0] or 0
    per = max(cell, -(-total // MOST_PIVOTS))
    large = sizes.filter(F.col("size") >= 2 * per).withColumn("k", F.floor(F.col("size") / per))
    large = {(r.label, r.dim): r.k for r in large.collect()}
    if not large:
        return {}
    # Twice the share is expected from each label, of which the least digests stay.
    draw = F.pmod(F.xxhash64(F.lit("pivot"), "k1", "k2"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = classes.join(sizes, ["label", "dim"]).filter((F.col("size") >= 2 * per) & (draw * per < 2))
    found: dict[tuple[str, int], list] = {}
    for r in drawn.select("label", "dim", draw.alias("u"), "node", "vec").collect():
        found.setdefault((r.label, r.dim), []).append((r.u, r.node, r.vec))
    return {key: unit(np.array([v for *_, v in sorted(rows)[: large[key]]])) for key, rows in found.items()}


def _in_cells(classes: DataFrame, sizes: DataFrame, pivots: dict, r: float, scratch: Scratch) -> DataFrame:
    """Classes with ``cell``, the number of their nearest pivot, and ``visits``, cells of smaller number."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(pivots)
    placed = classes.select("node", "n", "label", "dim", "vec")

    def radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[tuple[str, int], np.ndarray] = {k: np.full(len(p), -1.0) for k, p in shared.value.items()}
        for key, _, found in _by_label(batches):
            if key in most:
                own = found.argmin(axis=1)
                np.maximum.at(most[key], own, found[np.arange(len(own)), own])
        for (label, dim), far in most.items():
            n = len(far)
            columns = [pa.array([label] * n), pa.array([dim] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(far)]
            yield pa.RecordBatch.from_arrays(columns, ["label", "dim", "cell", "radius"])

    def _by_label(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            labels, dims = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            places: dict[tuple[str, int], list[int]] = {}
            for i, key in enumerate(zip(labels, dims, strict=True)):
                places.setdefault(key, []).append(i)
            for key, where in places.items():
                part = batch.take(pa.array(where))
                near = shared.value.get(key)
                yield key, part, None if near is None else distances(unit(_vectors(part.column(4), key[1])), near)

    far: dict[tuple[str, int], np.ndarray] = {k: np.full(len(p), -1.0) for k, p in pivots.items()}
    if pivots:
        found = placed.mapInArrow(radii, "label string, dim int, cell int, radius double")
        for x in found.groupBy("label", "dim", "cell").agg(F.max("radius").alias("radius")).collect():
            far[(x.label, x.dim)][x.cell] = x.radius
    reach = spark.sparkContext.broadcast(far)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part, found in _by_label(batches):
            if found is None:
                own, lists = np.zeros(part.num_rows, np.int32), [[] for _ in range(part.num_rows)]
            else:
                own = found.argmin(axis=1).astype(np.int32)
                near = found[np.arange(len(own)), own][:, None]
                may = (found <= near + 2 * r + SLACK) & (found <= reach.value[key] + r + SLACK)
                may &= np.arange(found.shape[1]) < own[:, None]
                lists = [np.flatnonzero(x).tolist() for x in may]
            columns = [*part.columns, pa.array(own, pa.int32()), pa.array(lists, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "cell", "visits"])

    schema = "node bigint, n bigint, label string, dim int, vec array<double>, cell int, visits array<int>"
    return scratch.store(placed.mapInArrow(visits, schema))


def _tasks(placed: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """Every class once for each task it takes part in.

    A task is a block ``x`` of a cell against itself, against a later block ``y`` of the
    cell, or against a block ``y`` of its visitors.
    """
    where = ["label", "dim", "cell"]
    per = lambda c: F.ceil(F.col(c) / block).cast("int")
    guests = placed.select("label", "dim", F.explode("visits").alias("cell")).groupBy(*where).agg(F.count("*").alias("m"))
    homes = placed.groupBy(*where).agg(F.count("*").alias("k"))
    cells = homes.join(guests, where, "left").select(*where, per("k").alias("s"), F.coalesce(per("m"), F.lit(0)).alias("v"))
    cells = scratch.store(cells)

    def own(parts: str) -> F.Column:
        return F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")

    def task(right: bool, guest: bool, x, y) -> F.Column:
        return F.struct(F.lit(guest).alias("guest"), x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(right).alias("right"))

    def each(count: str, make) -> F.Column:
        return F.transform(F.sequence(F.lit(0), F.col(count) - 1), make)

    home = placed.join(cells, where).withColumn("b", own("s"))
    blocks = each("s", lambda i: F.when(i < F.col("b"), task(True, False, i, F.col("b"))).otherwise(task(False, False, F.col("b"), i)))
    meets = F.when(F.col("v") > 0, each("v", lambda j: task(False, True, F.col("b"), j))).otherwise(F.array().cast(blocks_type := "array<struct<guest:boolean,x:int,y:int,right:boolean>>"))
    columns = [*where, "node", "n", "vec"]
    home = home.select(*columns, F.inline(F.concat(blocks.cast(blocks_type), meets)))
    guest = placed.select("label", "dim", F.explode("visits").alias("cell"), "node", "n", "vec").join(cells, where).withColumn("b", own("v"))
    guest = guest.select(*columns, F.inline(each("s", lambda i: task(True, True, i, F.col("b")))))
    return home.unionByName(guest)


def _links(tasks: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, null, n): ``a`` has ``n`` links in a task; rows (a, b, 0): an edge of a forest."""

    def join(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        inner = not table.column("guest")[0].as_py() and table.column("x")[0].as_py() == table.column("y")[0].as_py()
        nodes, weights = (table.column(c).to_numpy() for c in ("node", "n"))
        order = np.argsort(nodes, kind="stable")
        vectors, nodes, weights = _vectors(table.column("vec"), dim)[order], nodes[order], weights[order]
        right = table.column("right").to_numpy()[order]
        a = np.flatnonzero(~right)
        b = a if inner else np.flatnonzero(right)
        if not len(a) or not len(b):
            return pa.table({k: pa.array([], pa.int64()) for k in "abn"})
        links = linked(vectors[a], vectors[b], threshold)
        if inner:
            np.fill_diagonal(links, False)
        counts = [(nodes[a], links @ weights[b])] if inner else [(nodes[a], links @ weights[b]), (nodes[b], links.T @ weights[a])]
        near, sums = np.concatenate([x for x, _ in counts]), np.concatenate([x for _, x in counts])
        near, sums = near[sums > 0], sums[sums > 0]
        edges = np.array(forest(links), np.int64).reshape(-1, 2)
        return pa.table(
            {
                "a": pa.array(np.concatenate([near, nodes[a][edges[:, 0]]])),
                "b": pa.concat_arrays([pa.nulls(len(near), pa.int64()), pa.array(nodes[b][edges[:, 1]])]),
                "n": pa.array(np.concatenate([sums, np.zeros(len(edges), np.int64)])),
            }
        )

    return tasks.groupBy("label", "dim", "cell", "guest", "x", "y").applyInArrow(join, "a bigint, b bigint, n bigint")


def embedding_duplicates(
    embeddings: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cell: int = CELL,
    block: int = BLOCK,
) -> DataFrame:
    """Per row ``vec_id``, ``n_links`` (other vectors linked directly), ``component_id`` (the
    least id reachable by links) and ``kept`` (whether that is its own)."""
    scratch = Scratch(embeddings.sparkSession, "embeddings")
    r = math.sqrt(max(0.0, 2 - 2 * threshold))
    vec = F.col("vec")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    sound = F.col("label").isNotNull() & vec.isNotNull() & F.forall(vec, finite) & F.exists(vec, lambda x: x != 0)
    rows = embeddings.select(
        F.col(f"`{id_col}`").cast("bigint").alias("vec_id"),
        F.col(f"`{label_col}`").cast("string").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("vec"),
    )
    # 128 bits of digest stand for a vector; the two runs of the hash start differently.
    keys = [F.when(sound, F.xxhash64(F.lit(i), "label", "vec")).alias(f"k{i}") for i in (1, 2)]
    rows = rows.select("vec_id", "label", "vec", F.size("vec").alias("dim"), *keys)
    classes = _classes(rows, scratch)
    sizes = scratch.store(classes.groupBy("label", "dim").agg(F.count("*").alias("size")))
    placed = _in_cells(classes, sizes, _pivots(classes, sizes, cell), r, scratch)
    found = scratch.store(_links(_tasks(placed, block, scratch), threshold))
    counts = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    labels = components(found.filter("b is not null").select("a", "b"), scratch)
    keyed = classes.select("k1", "k2", "n", F.col("node").alias("a"))
    judged = keyed.join(counts, "a", "left").join(labels.withColumnRenamed("node", "a"), "a", "left")
    judged = scratch.store(judged.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("label", "a").alias("part")))
    ids = rows.select("vec_id", "k1", "k2")
    met = scratch.store(ids.join(judged, ["k1", "k2"]).select("vec_id", "n_links", "part"))
    least = met.groupBy("part").agg(F.min("vec_id").alias("component_id"))
    least = scratch.store(least)
    alone = ids.filter("k1 is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = met.join(least, "part").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
