"""The trie of conversations' prefixes: which turns are shared, by how many, and what storing them once saves.

A node of depth d stands for a distinct sequence of d turns; its name is (d, the smallest conv_id that starts with it),
as nodes of one depth share no conversation. It is built level by level: live conversations meet their next turn, are
grouped by (node, turn), and the group's smallest conv_id names the child. A conversation alone in its node shares
nothing further down, so it leaves: its tail is a chain that is written without more levels. So there are as many
levels as the longest prefix that two conversations share, whatever the longest conversation. Levels are then joined in
reverse, children summed into their parents.

Turns travel as a digest (SHA-256 of role and text), their place and their bytes, never as text. No group is held in one
task: groups are aggregated map-side; live rows of a large group meet its name by broadcast (``_shared.join_hot``); the
turns of a long conversation are numbered by range partitions and a broadcast of a row a partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.llm._shared import arrow_limits, col, discard, join_hot, materialize, partitions

#: Decimal ids of a node's ends are joined into strings of so many ids before they are hashed one after another.
CHUNK = 50_000
#: Nodes of a tail that one row stands for until it is dealt out.
BLOCK = 4096
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _positions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to a sorted partition's rows their place in the run of their conversation, from 1."""
    last, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy()
        new = np.concatenate([[last is None or conv[0] != last], conv[1:] != conv[:-1]])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(conv)), -1))
        place = np.arange(len(conv)) - begin + 1
        place[begin < 0] = np.arange(1, (begin < 0).sum() + 1) + n
        last, n = conv[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "at"])


def ordered_turns(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, pos, digest, bytes``, stored: a row a turn, pos gapless from 1 in each conversation.

    In order of turn, null first; turns of one number by role, then by the first 64 characters of the text, then by
    digest. Null role or text is empty. Rows without a conv_id belong to no conversation and are left out. bytes: of the
    text in UTF-8. Repeated rows are turns like others.
    """
    role, text = F.coalesce(col(role_col), F.lit("")), F.coalesce(col(text_col), F.lit(""))
    spark = conversations.sparkSession
    arrow_limits(spark, rows=10_000)
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(col(conv_col).isNotNull()).select(
        col(conv_col).cast("long").alias("conv_id"), col(turn_col).alias("turn"), role.alias("role"), F.substring(text, 1, 64).alias("head"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    order = ["conv_id", "turn", "role", "head", "digest"]
    narrow = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("conv_id", "digest", "bytes", F.spark_partition_id().alias("part"))
    placed = materialize(narrow.mapInArrow(_positions, T.StructType([*narrow.schema, T.StructField("at", T.LongType())])), "trie-order")
    # a conversation that lies in several partitions goes on in the next: there are fewer of those than partitions
    runs = placed.groupBy("conv_id", "part").agg(F.max("at").alias("n"))
    several = runs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts"), F.array_sort(F.collect_list(F.struct("part", "n"))).alias("runs")).where("parts > 1").drop("parts")
    before = F.coalesce(F.aggregate(F.filter("runs", lambda r: r["part"] < F.col("part")), F.lit(0).cast("long"), lambda a, r: a + r["n"]), F.lit(0))
    turns = placed.join(F.broadcast(several), "conv_id", "left").select("conv_id", (F.col("at") + before).alias("pos"), "digest", "bytes")
    stored = materialize(turns, "trie-turns")
    discard(placed)
    return stored


def members_of(turns: DataFrame) -> DataFrame:
    """``conv_id, n``: each conversation and its number of turns."""
    return turns.groupBy("conv_id").agg(F.max("pos").alias("n"))


def rebased(turns: DataFrame, group: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another: ``conv_id, pos, digest, bytes`` and ``conv_id, n``, stored.

    With h the CRC-32 of the decimal conv_id c modulo ``heads``: the first h turns of conversation c - c % group (all,
    if it has fewer; none, if there is no such), then c's own turns after its first h. A conversation may come out
    without a turn.
    """
    spread = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = F.col("conv_id") - F.col("conv_id") % group
    own = materialize(members_of(turns), "trie-members")
    of_base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    k = F.least("h", F.coalesce("n_base", F.lit(0)))
    every = own.withColumn("h", spread).withColumn("base", base).join(of_base, "base", "left").select("conv_id", "base", "h", k.alias("k"), F.col("n").alias("n_own"), (k + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("n"))
    every = materialize(every, "trie-rebased")
    after = turns.where(F.col("pos") > spread)
    kept = join_hot(after, every.select("conv_id", "h", "k", "n_own"), "conv_id", "n_own").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "digest", "bytes")
    # at most heads - 1 turns of a base and group conversations on it
    first = turns.where((F.col("pos") < heads) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    shared = first.join(every.select("conv_id", "base", "k"), "base").where("pos <= k").select("conv_id", "pos", "digest", "bytes")
    return materialize(by_level(kept.unionByName(shared)), "trie-rebuilt"), every.select("conv_id", "n")


def by_level(turns: DataFrame) -> DataFrame:
    """In order of pos, so that a level's rows are a run of row groups."""
    order = ["pos", "conv_id"]
    return turns.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)


def build(turns: DataFrame, members: DataFrame) -> DataFrame:
    """A row a node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_bytes, n_ends, ends_sha256``.

    turns: ``conv_id, pos, digest, bytes``, stored, best ``by_level``; members: ``conv_id, n`` (turns; 0 is possible),
    stored. n_convs: conversations that start with the node's turns; n_leaves: nodes without a child in its subtree, itself
    included; saved_bytes: over its subtree, (n_convs - 1) times the bytes of the node's last text; n_ends: those that
    have no more turns; ends_sha256: of their decimal ids, ascending, joined by commas. The root (depth 0) has no parent.
    Without members there is no node.
    """
    head = members.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    if not head[1]:
        return _result(members.limit(0).select(*[F.lit(0).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_bytes", "n_ends")], F.lit("").alias("ends_sha256")))
    root = head[0]
    level = F.lit(root).cast("long").alias("node")
    live, ends, groups, depth = members.where("n > 0").select("conv_id", level, "n"), [members.where("n = 0").select(F.lit(0).alias("depth"), level, "conv_id")], [], 0
    held = None
    while True:
        depth += 1
        rows = turns.where(F.col("pos") == depth).select("conv_id", "digest", "bytes").join(live, "conv_id")
        rows = materialize(rows.select("conv_id", "n", "bytes", F.struct("node", "digest").alias("key")), f"trie-live-{depth}")
        found = rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.max("n").alias("n"), F.count_if(F.col("n") == depth).alias("n_ends"))
        found = materialize(found, f"trie-nodes-{depth}")
        if held is not None:
            discard(held)
        groups.append(found.select("conv_id", F.col("key.node").alias("parent"), "n_convs", "bytes", "n", "n_ends"))
        size, shared = found.agg(F.count(F.lit(1)), F.count_if(F.col("n_convs") > 1)).first()
        if not shared:
            discard(rows)
            break
        named = join_hot(rows, found.select("key", F.col("conv_id").alias("name"), "n_convs", F.col("n_convs").alias("rows")), "key", "rows")
        held = materialize(named.where("n_convs > 1").select("conv_id", F.col("name").alias("node"), "n"), f"trie-named-{depth}")
        discard(rows)
        ends.append(materialize(held.where(F.col("n") == depth).select(F.lit(depth).alias("depth"), "node", "conv_id"), f"trie-ends-{depth}"))
        live = held.where(F.col("n") > depth)
    # children into parents, the deepest level first
    rolled: dict[int, DataFrame] = {}
    below = groups[-1].select("parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_bytes"))
    for d in range(depth - 1, -1, -1):
        kids = below.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_bytes").alias("saved")).withColumnRenamed("parent", "conv_id")
        own = groups[d - 1].where("n_convs > 1").drop("n") if d else members.sparkSession.range(1).select(F.lit(root).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent"), F.lit(head[1]).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("long").alias("n_ends"))
        n_children = F.coalesce("n_children", F.lit(0).cast("long"))
        rolled[d] = materialize(own.join(kids, "conv_id", "left").select(
            "conv_id", F.lit(d).cast("long").alias("depth"), "parent", "n_convs", n_children.cast("long").alias("n_children"), F.when(n_children == 0, 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("bytes") + F.coalesce("saved", F.lit(0))).alias("saved_bytes"),
        ), f"trie-rolled-{d}")
        alone = groups[d - 1].where("n_convs = 1").select("parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_bytes")) if d else None
        below = rolled[d].select("parent", "n_leaves", "saved_bytes").unionByName(alone) if d else None
    shared_nodes = _union([rolled[d] for d in sorted(rolled)]).join(_digests(_union(ends)), ["depth", "conv_id"], "left").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_bytes", F.coalesce("ends", F.lit(0)).alias("n_ends"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")
    )
    return _result(shared_nodes.unionByName(_tails(_union([g.where("n_convs = 1").select("conv_id", "parent", "n", F.lit(d + 1).cast("long").alias("first")) for d, g in enumerate(groups)]))))


def _result(nodes: DataFrame) -> DataFrame:
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_bytes", "n_ends", "ends_sha256")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _tails(alone: DataFrame) -> DataFrame:
    """The nodes of conversations from where they are alone (``conv_id, parent, n, first``): a chain to their end, dealt out in blocks."""
    blocks = alone.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - first) div {BLOCK}")))).repartition("conv_id", "block")
    begin = F.col("first") + F.col("block") * BLOCK
    nodes = blocks.withColumn("depth", F.explode(F.sequence(begin, F.least(begin + BLOCK - 1, F.col("n")))))
    last = F.col("depth") == F.col("n")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return nodes.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("first"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), F.when(last, none).otherwise(one).alias("n_children"), one.alias("n_leaves"),
        none.alias("saved_bytes"), F.when(last, one).otherwise(none).alias("n_ends"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a node's ids in a sorted partition as strings of at most CHUNK ids; ``start`` is the first, to order them by."""
    for batch in batches:
        if not batch.num_rows:
            continue
        depth, node, conv = (batch.column(c).to_numpy() for c in ("depth", "node", "conv_id"))
        cuts = np.flatnonzero(np.concatenate([[True], (depth[1:] != depth[:-1]) | (node[1:] != node[:-1])]))
        text = batch.column("conv_id").cast(pa.string()).to_pylist()
        bounds = sorted({*cuts.tolist(), *range(0, len(conv), CHUNK)}) + [len(conv)]
        firsts = np.array(bounds[:-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(depth[firsts]), pa.array(node[firsts]), pa.array(conv[firsts]), pa.array(np.diff(bounds).astype(np.int64)), pa.array([",".join(text[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.string())],
            ["depth", "node", "start", "ends", "ids"],
        )


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest a node from a partition in order of node and start; holds one string at a time."""
    key, sha, n = None, None, 0
    done: list[tuple] = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["depth", "conv_id", "ends", "ends_sha256"])
        done.clear()
        return out

    for batch in batches:
        for depth, node, ends, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ends", "ids"))):
            if (depth, node) != key:
                if key is not None:
                    done.append((*key, n, sha.hexdigest()))
                key, sha, n = (depth, node), hashlib.sha256(), 0
            else:
                sha.update(b",")
            sha.update(ids.encode())
            n += ends
        if len(done) >= 1000:
            yield flush()
    if key is not None:
        done.append((*key, n, sha.hexdigest()))
    yield flush()


def _digests(ends: DataFrame) -> DataFrame:
    """``depth, conv_id, ends, ends_sha256`` of ``depth, node, conv_id``. A digest is of a sequence, so a node's strings meet in one task, which reads them one by one; ids are sorted and joined before, on all."""
    spark = ends.sparkSession
    order = ["depth", "node", "conv_id"]
    ends = ends.select(F.col("depth").cast("long"), F.col("node").cast("long"), F.col("conv_id").cast("long"))
    strings = ends.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(_joined, "depth long, node long, start long, ends long, ids string")
    return strings.repartition(partitions(spark), "depth", "node").sortWithinPartitions("depth", "node", "start").mapInArrow(_hashed, "depth long, conv_id long, ends long, ends_sha256 string")
