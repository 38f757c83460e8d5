"""The prefix trie of conversations by van Emde Boas recursion.

A node is a distinct sequence of first turns; its name is its depth and the least id of the
conversations that start with it.  Sequences are cut at half depth.  The cut prefixes are
named, which gives the roots of the lower forests, and the upper trie and the lower forests
are cut in the same way, all of one size in one round.  So depth ``d`` is the cut of exactly
one block: with ``2^k`` the greatest power of two in ``d``, the block's root is at depth
``d - 2^k``, and a prefix of ``d`` turns is named by the name of its root and a digest of
the ``2^k`` turns between.  The rounds go from the greatest power down, one grouping each.

A prefix that only one conversation has needs no name, and neither does what follows it, so
rounds only look at prefixes whose root several conversations share.

Totals go the other way.  A block of ``2^k`` levels knows the totals of its nodes within
itself; when it meets the block below its cut, the sums of that forest are grafted on the
cut prefixes and added to all nodes above them in the block.

Turns meet as digests and byte counts; texts are never shuffled.  Positions come from a
range-partitioned order, so a conversation may span tasks; sums and groups are pre-aggregated
or plain joins, so a prefix that a third of all conversations share is spread over tasks.
Ids that end at one node are packed in their order and digested as a stream.

Null roles and texts are empty.  Turns are ordered by number, null first; of turns with
one number the role and then a digest of role and text decide, and repeated rows are repeated
turns.  Rows without a conversation id belong to no conversation.  Without conversations
there are no nodes, not even a root.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashtide.llm.common import Scratch

#: Ids in one packed piece of those that end at a node.
PIECE = 1 << 16


def numbered_turns(
    conversations: DataFrame,
    scratch: Scratch,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv``, ``pos`` from 1 in the order of turns, ``sym`` (a digest of role and text) and ``bytes`` of the text."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.select(
        F.col(f"`{id_col}`").cast("bigint").alias("conv"),
        F.col(f"`{turn_col}`").cast("bigint").alias("turn"),
        role.alias("role"),
        F.unhex(F.md5(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"))).alias("sym"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    ).filter("conv is not null")
    turns = scratch.store(turns)
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "sym"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            lengths = np.diff(np.append(first, len(conv)))
            place = np.arange(len(conv)) - np.repeat(first, lengths)
            if conv[0] == last:
                place[: lengths[0]] += seen
            last, seen = conv[-1], int(place[-1]) + 1
            columns = [batch.column(0), pa.array(np.full(len(conv), part, np.int32)), pa.array(place + 1), batch.column(1), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, ["conv", "part", "place", "sym", "bytes"])

    ordered = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv", "sym", "bytes")
    placed = scratch.store(ordered.mapInArrow(count, "conv bigint, part int, place bigint, sym binary, bytes bigint"))
    # Only conversations that span tasks have turns in earlier ones: at most two a task.
    ends = placed.groupBy("conv", "part").agg(F.max("place").alias("n"))
    several = ends.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("all")).filter(F.size("all") > 1)
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    before = F.transform("all", lambda x, i: F.struct(x["part"].alias("part"), total(F.slice("all", F.lit(1), i)).alias("before")))
    before = scratch.store(several.select("conv", F.inline(before)))
    rows = placed.join(before, ["conv", "part"], "left")
    rows = scratch.store(rows.select("conv", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "sym", "bytes"))
    scratch.drop(turns, placed, before)
    return rows


def _bit(d: Column, k: int) -> Column:
    """Whether ``2^k`` is the greatest power of two in ``d``."""
    return d.bitwiseAND((1 << (k + 1)) - 1) == (1 << k)


def _cuts(turns: DataFrame, lengths: DataFrame, scratch: Scratch) -> DataFrame:
    """Per conversation and depth ``d`` two digests of the turns of its cut, from its root on, and the bytes of the last.

    A digest is the exclusive or of digests of turns with their place in the cut; so a turn
    goes to one cut for each power of two up to the length of its conversation.
    """
    k, pos, size = F.col("k"), F.col("pos"), F.expr("shiftleft(1L, k)")
    d = F.expr("shiftleft(shiftright(pos + shiftleft(1L, k) - 1, k), k)")
    top = F.length(F.bin("len")) - 1
    spread = turns.join(lengths, "conv").select("conv", "pos", "sym", "bytes", "len", F.explode(F.sequence(F.lit(0), top)).alias("k"))
    spread = spread.select("*", d.alias("d")).filter((F.expr("shiftright(d, k) & 1") == 1) & (F.col("d") <= F.col("len")))
    digests = [F.bit_xor(F.xxhash64(F.lit(i), "sym", pos - F.col("d") + size)).alias(f"x{i}") for i in (1, 2)]
    last = F.max(F.when(pos == F.col("d"), F.col("bytes"))).alias("bytes")
    return scratch.store(spread.groupBy("conv", "d", k).agg(*digests, last), "k")


def _named(cuts: DataFrame, levels: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Prefixes that several conversations share, (conv, d, name), and their nodes (d, name, n, bytes)."""
    names = nodes = None
    key = ["d", "root", "x1", "x2"]
    for k in reversed(range(levels)):
        rows = cuts.filter(F.col("k") == k).select("conv", "d", "x1", "x2", "bytes")
        asked = rows.filter(F.col("d") == 1 << k).withColumn("root", F.lit(0).cast("bigint"))
        if names is not None:
            roots = names.filter(F.col("d").bitwiseAND((1 << (k + 1)) - 1) == 0)
            roots = roots.select("conv", (F.col("d") + (1 << k)).alias("d"), F.col("name").alias("root"))
            asked = asked.unionByName(rows.join(roots, ["conv", "d"]).select(*asked.columns))
        asked = scratch.store(asked)
        groups = asked.groupBy(*key).agg(F.min("conv").alias("name"), F.count("*").alias("n"), F.max("bytes").alias("bytes"))
        groups = scratch.store(groups.filter("n > 1"))
        new = scratch.store(asked.join(groups.drop("bytes", "n"), key).select("conv", "d", "name"))
        scratch.drop(asked)
        found = groups.select("d", "name", "n", "bytes")
        names, nodes = (new, found) if names is None else (names.unionAll(new), nodes.unionAll(found))
    return names, nodes


def _grafted(nodes: DataFrame, names: DataFrame, scratch: Scratch) -> DataFrame:
    """``nodes`` with ``saved`` and ``leaves`` summed over their subtrees."""
    deepest = nodes.agg(F.max("d")).first()[0] or 0
    k = 0
    while 1 << k < deepest:
        above = F.col("d") - 1
        # The forest below each cut of this size, and the way from the cut up to its root.
        forests = nodes.filter(_bit(above, k)).groupBy(above.alias("cut"), F.col("parent").alias("conv"))
        forests = forests.agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        block = lambda c, k=k: F.shiftright(F.col(c) - 1, k).alias("block")
        forests = forests.select("conv", block("cut"), "more_saved", "more_leaves")
        ways = names.filter(F.shiftright(above, k).bitwiseAND(1) == 0).select("conv", block("d"), "d", "name")
        more = ways.join(forests, ["conv", "block"]).groupBy("d", "name").agg(F.sum("more_saved").alias("s"), F.sum("more_leaves").alias("l"))
        old = nodes
        nodes = nodes.join(scratch.store(more), ["d", "name"], "left")
        nodes = nodes.withColumns({"saved": F.col("saved") + F.coalesce("s", F.lit(0)), "leaves": F.col("leaves") + F.coalesce("l", F.lit(0))})
        nodes = scratch.store(nodes.drop("s", "l"))
        scratch.drop(old)
        k += 1
    return nodes


def _end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ids that end at each (d, name), in their order.

    Ids are ordered over all tasks and packed; the pieces of a node pass one digest as a stream.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def groups(batches: Iterator[pa.RecordBatch], size: int):
        """(d, name), and the following columns of its rows, batch by batch."""
        for batch in batches:
            d, name = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((d[1:] != d[:-1]) | (name[1:] != name[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(d)], strict=True):
                for at in range(a, b, size):
                    yield (int(d[a]), int(name[a])), batch.slice(at, min(size, b - at))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (d, name), part in groups(batches, PIECE):
            ids = part.column(2).to_pylist()
            yield pa.RecordBatch.from_pylist([{"d": d, "name": name, "first": ids[0], "ids": ",".join(map(str, ids))}])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def row():
            return pa.RecordBatch.from_pylist([{"d": key[0], "name": key[1], "ends_sha256": state.hexdigest()}])

        for own, part in groups(batches, PIECE):
            if own != key:
                if key is not None:
                    yield row()
                key, state = own, hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(part.column(3).to_pylist()).encode())
        if key is not None:
            yield row()

    order = ["d", "name", "conv"]
    packed = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    packed = packed.mapInArrow(pieces, "d bigint, name bigint, first bigint, ids string")
    packed = packed.repartition("d", "name").sortWithinPartitions("d", "name", "first")
    return packed.mapInArrow(digest, "d bigint, name bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv, pos from 1 without gaps, sym, bytes) of the
    conversations ``ids`` (conv), which may be without turns.

    ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``.
    """
    lengths = scratch.store(turns.groupBy("conv").agg(F.max("pos").alias("len")))
    levels = int(lengths.agg(F.max("len")).first()[0] or 0).bit_length()
    count, least = ids.agg(F.count("conv"), F.min("conv")).first()
    cuts = _cuts(turns, lengths, scratch)
    if levels:
        names, nodes = _named(cuts, levels, scratch)
    else:
        names = cuts.select("conv", "d", F.col("conv").alias("name"))
        nodes = cuts.select("d", F.col("conv").alias("name"), F.lit(0).cast("bigint").alias("n"), "bytes")
    # Of each conversation its length, how many first turns it shares, and the name of those.
    shared = names.groupBy("conv").agg(F.max("d").alias("s"), F.max_by("name", "d").alias("last"))
    ways = ids.join(lengths, "conv", "left").join(shared, "conv", "left")
    ways = scratch.store(ways.select("conv", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("len", "s")], F.coalesce("last", F.lit(least)).alias("last")))
    parents = names.select(F.col("conv").alias("name"), (F.col("d") + 1).alias("d"), F.col("name").alias("parent"))
    nodes = scratch.store(nodes.join(parents, ["d", "name"], "left").withColumn("parent", F.coalesce("parent", F.lit(least))))
    alone = ways.filter("len > s").groupBy(F.col("s").alias("d"), F.col("last").alias("name")).agg(F.count("*").alias("alone"))
    below = nodes.groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("name")).agg(F.count("*").alias("below"))
    children = scratch.store(alone.join(below, ["d", "name"], "full"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    # A leaf counts itself, and the way of a single conversation below a node is a leaf.
    leaves = F.when(zero("alone") + zero("below") == 0, 1).otherwise(zero("alone")).cast("bigint")
    known = nodes.join(children, ["d", "name"], "left").select(
        "d", "name", "parent", "n", (zero("alone") + zero("below")).alias("children"),
        leaves.alias("leaves"), ((F.col("n") - 1) * F.col("bytes")).alias("saved"),
    )
    totals = _grafted(scratch.store(known), names, scratch)
    ends = scratch.store(_end_digests(ways.filter("len = s").select(F.col("s").alias("d"), F.col("last").alias("name"), "conv")))

    none = F.sha2(F.lit("").cast("binary"), 256)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = totals.join(ends, ["d", "name"], "left").select(
        F.col("name").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
    single = cuts.select("conv", "d").join(ways, "conv").filter("d > s")
    own = F.encode(F.col("conv").cast("string"), "UTF-8")
    one = F.lit(1).cast("bigint")
    single = single.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"),
        F.when(F.col("d") == F.col("s") + 1, F.col("last")).otherwise(F.col("conv")).alias("parent_conv_id"), one.alias("n_convs"),
        (F.col("d") < F.col("len")).cast("bigint").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(F.col("d") == F.col("len"), F.sha2(own, 256)).otherwise(none).alias("ends_sha256"),
    )
    null = lambda kind: F.lit(None).cast(kind)
    whole = totals.filter("d = 1").select(F.col("leaves").alias("l"), F.col("saved").alias("v"), null("bigint").alias("alone"), null("bigint").alias("below"), null("string").alias("ends_sha256"))
    whole = whole.unionByName(children.filter("d = 0").select("alone", "below"), allowMissingColumns=True)
    whole = whole.unionByName(ends.filter("d = 0").select("ends_sha256"), allowMissingColumns=True)
    top = whole.agg(*[F.sum(c).alias(c) for c in ("l", "v", "alone", "below")], F.max("ends_sha256").alias("ends_sha256"))
    n_children = zero("alone") + zero("below")
    top = top.filter(F.lit(count > 0)).select(
        F.lit(least).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"),
        F.lit(count).cast("bigint").alias("n_convs"), n_children.alias("n_children"),
        F.when(n_children == 0, one).otherwise(zero("alone") + zero("l")).alias("n_leaves"), zero("v").alias("saved_tokens"),
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
    return top.select(*columns).unionByName(inner.select(*columns)).unionByName(single.select(*columns))


def conversation_trie(conversations: DataFrame, **names: str) -> DataFrame:
    """The nodes of the trie of conversations as they are, as ``prefix_trie`` has them."""
    scratch = Scratch(conversations.sparkSession, "conversations")
    turns = numbered_turns(conversations, scratch, **names)
    return prefix_trie(turns, turns.select("conv").distinct(), scratch)


def with_shared_openings(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Numbered turns in which each conversation opens like the one its id is rounded down to;
    and all ids.

    How many turns it takes over, at most eight, follows from a checksum of its id; its own
    turns after as many follow.
    """
    lengths = scratch.store(turns.groupBy("conv").agg(F.max("pos").alias("len")))
    h = F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % 9
    base = F.col("conv") - F.col("conv") % 5
    bases = lengths.filter("conv % 5 = 0").select(F.col("conv").alias("base"), F.col("len").alias("base_len"))
    family = lengths.select("conv", h.alias("h"), base.alias("base")).join(bases, "base", "left")
    family = scratch.store(family.select("conv", "base", "h", F.least("h", F.coalesce("base_len", F.lit(0))).alias("taken")))
    columns = ["conv", "pos", "sym", "bytes"]
    own = turns.join(family.select("conv", "h", "taken"), "conv").filter("pos > h").withColumn("pos", F.expr("taken + pos - h"))
    opening = turns.filter("conv % 5 = 0 and pos <= 8").withColumnRenamed("conv", "base").join(family, "base").filter("pos <= h")
    return scratch.store(own.select(*columns).unionByName(opening.select(*columns))), family.select("conv")
