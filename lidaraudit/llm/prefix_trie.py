"""Conversation prefix trie: nodes are the intervals of sorted turn arrays that share a prefix.

Turns. A turn is a unit of UNIT bytes: a 128-bit hash of role and text, and the text's length in
UTF-8 bytes. Turns are range-sorted by conversation and place, so one conversation's turns may lie in several
partitions; each partition joins what it has of a conversation to one piece, and the pieces make the
conversation's array, a binary whose order is that of its turns' units.

Trie. Arrays are range-sorted globally, equal ones by conv_id. A task sweeps its partition with a stack: the common
prefix of neighbours tells which nodes end and which begin. Nodes that are no prefix of the partition's first or
last array lie wholly within it and are given out when they end. The others are open: they may go on in
a neighbouring partition, so their parts are given out with a hash of the prefix. Parts of one prefix are added up, and what
open nodes add to the open nodes above them is summed along the two chains (of the first and the last array) of each
partition by a window, each open node in one chain only. A node's parent is told by its place in its
partition's sweep, so that one join by (partition, place) finds it without a hot key.

The digest of conv_ids whose turns end in a node is made as they pass; of an open node, whose ids may lie in many
partitions, pieces of ids are brought together in order and hashed as a stream.

Bounds: a task holds one array, the stack of its prefixes and one batch of nodes. An array has UNIT bytes a turn.
Two different turns share a hash with a probability of n**2 / 2**129.

Defined cases: a null role or text is empty; turns are ordered by turn (null first), then by their unit, repeated rows
count each; rows of null conv_id are in no conversation; a conversation without turns left is a member of the root
only; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lidaraudit.llm.common import bound_batches, mapped, written

#: Bytes of a turn's unit: its hash and its text's length.
UNIT, HASH = 24, 16
#: Turns that a conversation takes from its group's first one at most, and conversations of a group.
HEAD, GROUP = 8, 5
#: Rows of an Arrow batch that the sweep gives out, bytes of conv_ids of a piece.
ROWS, PIECE_BYTES = 20_000, 1 << 20
NOTHING = hashlib.sha256(b"").hexdigest()


def unit(role: Column, text: Column) -> Column:
    """Hash and length of a turn."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    size = F.octet_length(text).cast("long")
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return F.concat(F.unhex(digest), F.unhex(F.lpad(F.hex(size), 16, "0")))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a partition has of each conversation, as one piece."""
    now, parts, piece = None, [], TaskContext.get().partitionId()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([piece], pa.int32()), pa.array([b"".join(parts)], pa.binary())], ["conv_id", "piece", "units"])

    rows: list[pa.RecordBatch] = []
    for batch in batches:
        for conv, own in zip(batch["conv_id"].to_pylist(), batch["unit"].to_pylist(), strict=True):
            if conv != now:
                if parts:
                    rows.append(out())
                now, parts = conv, []
                if len(rows) >= 1000:
                    yield from pa.Table.from_batches(rows).combine_chunks().to_batches()
                    rows = []
            parts.append(own)
    if parts:
        rows.append(out())
    if rows:
        yield from pa.Table.from_batches(rows).combine_chunks().to_batches()


def arrays(turns: DataFrame) -> DataFrame:
    """conv_id, units: the turns of each conversation as one binary."""
    own = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", unit(F.col("role"), F.col("text")).alias("unit"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "unit"]
    pieces = own.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "unit").transform(mapped, _joined, "conv_id long, piece int, units binary")
    joined = F.array_sort(F.collect_list(F.struct("piece", "units")))
    return pieces.groupBy("conv_id").agg(F.aggregate(joined, F.lit(b""), lambda a, x: F.concat(a, x["units"])).alias("units"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, units: the first h turns of the group's first conversation, then those of its own after its first h."""
    own = written(arrays(turns), "trie-arrays")
    head = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.expr(f"substring(units, 1, {HEAD * UNIT})").alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    found = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(head, "base", "left").withColumn("h", h)
    return found.select("conv_id", F.expr(f"concat(coalesce(substring(head, 1, h * {UNIT}), X''), substring(units, h * {UNIT} + 1))").alias("units"))


#: kind 0: a node that ended here; 1: a part of an open node; 2: a piece of conv_ids of an open node.
#: prefix, above: hashes of the node's and its parent's prefix. sides: 1 of the first array, 2 of the last, 3 of both.
SWEPT = """kind int, part int, node long, parent long, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved long,
 size long, sides int, prefix binary, above binary, seq int, ids string"""
COLUMNS = [c.split()[0] for c in SWEPT.split(",")]
TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


@dataclass
class Node:
    node: int
    depth: int
    size: int
    conv_id: int
    sides: int
    n_convs: int = 0
    n_children: int = 0
    n_leaves: int = 0
    saved: int = 0
    ends: object = None  # of a node that can't be open
    ids: list = field(default_factory=list)
    seq: int = 0


def common_units(a: bytes, b: bytes) -> int:
    """How many units a and b have in common at their beginning."""
    most = min(len(a), len(b)) // UNIT
    if a[: most * UNIT] == b[: most * UNIT]:
        return most
    low, high = 0, most  # the first low units are equal, the first high are not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low * UNIT : middle * UNIT] == b[low * UNIT : middle * UNIT]:
            low = middle
        else:
            high = middle
    return low


def prefixes(units: bytes) -> list[bytes]:
    """Hashes of all prefixes of an array, the empty one first."""
    h = hashlib.blake2b(digest_size=16)
    out = [h.digest()]
    for k in range(0, len(units), UNIT):
        h.update(units[k : k + UNIT])
        out.append(h.digest())
    return out


class Sweep:
    """One pass over sorted (units, conv_id) of a partition."""

    def __init__(self, part: int, piece_bytes: int = PIECE_BYTES) -> None:
        self.part, self.rows, self.numbers, self.piece_bytes = part, [], 0, piece_bytes
        self.stack: list[Node] = []
        self.first = self.last = None
        self.first_names: list[bytes] = []

    def add(self, units: bytes, conv_id: int) -> None:
        if self.last is None:
            self.first, self.first_names, shared = units, prefixes(units), -1
        else:
            shared = common_units(self.last, units)
            while len(self.stack) > shared + 1:
                self.close(0)
        side = 1 if self.last is None else 0
        for depth in range(len(self.stack), len(units) // UNIT + 1):
            size = int.from_bytes(units[depth * UNIT - UNIT + HASH : depth * UNIT], "big") if depth else 0
            self.stack.append(Node(self.numbers, depth, size, conv_id, side))
            self.numbers += 1
        self.last = units
        top = self.stack[-1]
        self.end(top, conv_id)
        # Counts of members are added from the top down as nodes end; the least conv_id likewise.
        top.n_convs += 1
        top.conv_id = min(top.conv_id, conv_id)

    def end(self, node: Node, conv_id: int) -> None:
        """conv_id's turns end in node; ids of a node come in ascending order."""
        node.ids.append(str(conv_id))
        if len(node.ids) * 20 >= self.piece_bytes:
            self.pour(node)

    def pour(self, node: Node) -> None:
        """Ids so far: to a piece where the node began with the partition and so is open, else to its digest."""
        if not node.ids:
            return
        text = ",".join(node.ids)
        node.ids = []
        if node.sides & 1:
            self.rows.append((2, self.part, node.node, None, node.depth, None, None, None, None, None, None, None, self.first_names[node.depth], None, node.seq, text))
        else:
            node.ends = node.ends or (hashlib.sha256(), [])
            node.ends[0].update((b"," if node.seq else b"") + text.encode())
            node.ends[1].append(text)
        node.seq += 1

    def close(self, side: int, names: list[bytes] | None = None) -> None:
        """The stack's top ends, or (side 2) the partition does."""
        node = self.stack.pop()
        node.sides |= side
        above = self.stack[-1] if self.stack else None
        parent = above.node if above else None
        if above:
            above.n_convs += node.n_convs
            above.conv_id = min(above.conv_id, node.conv_id)
        if node.sides:
            names = names or self.first_names
            if node.sides & 1:
                self.pour(node)
            else:  # only now known to be open
                self.pour(node)
                for k, text in enumerate(node.ends[1] if node.ends else ()):
                    self.rows.append((2, self.part, node.node, None, node.depth, None, None, None, None, None, None, None, names[node.depth], None, k, text))
            self.rows.append((1, self.part, node.node, parent, node.depth, node.conv_id, node.n_convs, node.n_children, node.n_leaves, node.saved, node.size, node.sides, names[node.depth], names[node.depth - 1] if node.depth else None, None, None))
            return
        self.pour(node)
        leaves = node.n_leaves if node.n_children else 1
        saved = node.saved + (node.n_convs - 1) * node.size
        self.rows.append((0, self.part, node.node, parent, node.depth, node.conv_id, node.n_convs, node.n_children, leaves, saved, None, None, None, None, None, node.ends[0].hexdigest() if node.ends else NOTHING))
        above.n_children += 1
        above.n_leaves += leaves
        above.saved += saved

    def finish(self) -> None:
        if self.last is not None:
            names = prefixes(self.last)
            while self.stack:
                self.close(2, names)

    def batch(self) -> pa.RecordBatch:
        kinds = [TYPES[c.split()[1]] for c in SWEPT.split(",")]
        columns = [pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), kinds, strict=True)]
        self.rows = []
        return pa.RecordBatch.from_arrays(columns, COLUMNS)


def _swept(piece_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(TaskContext.get().partitionId(), piece_bytes)
        for batch in batches:
            for units, conv_id in zip(batch["units"], batch["conv_id"].to_pylist(), strict=True):
                sweep.add(units.as_py(), conv_id)
                if len(sweep.rows) >= ROWS:
                    yield sweep.batch()
        sweep.finish()
        if sweep.rows:
            yield sweep.batch()

    return work


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of ids come by prefix and in order; one digest at a time is open."""

    def out(prefix: bytes, digest) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([prefix], pa.binary()), pa.array([digest.hexdigest()])], ["prefix", "ends"])

    now, digest = None, None
    for batch in batches:
        for prefix, ids in zip(batch["prefix"].to_pylist(), batch["ids"], strict=True):
            if prefix != now:
                if digest:
                    yield out(now, digest)
                now, digest = prefix, hashlib.sha256(ids.as_py().encode())
            else:
                digest.update(b"," + ids.as_py().encode())
    if digest:
        yield out(now, digest)


def trie(convs: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The nodes of conversations (conv_id, units); see op11_prefix_trie for the columns."""
    order = ["units", "conv_id"]
    swept = written(convs.repartitionByRange(*order).sortWithinPartitions(*order).transform(mapped, _swept(piece_bytes), SWEPT), "trie-swept")
    parts = swept.where("kind = 1")
    found = parts.groupBy("prefix").agg(
        F.max("depth").alias("depth"), F.max("above").alias("above"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("closed_children"),
        F.sum("n_leaves").alias("closed_leaves"), F.sum("saved").alias("closed_saved"), F.max("size").alias("size"), F.min(F.struct("part", F.when(F.col("sides") == 2, 2).otherwise(1).alias("side"))).alias("home"))
    found = written(found, "trie-open")
    below = found.where("above is not null").groupBy(F.col("above").alias("prefix")).agg(F.count("*").alias("open_children"))
    own = found.join(below, "prefix", "left").withColumn("n_children", F.col("closed_children") + F.coalesce("open_children", F.lit(0)))
    # What each open node adds to itself and those above it, told in its home chain.
    own = own.withColumn("leaves", F.col("closed_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).withColumn("saves", F.col("closed_saved") + (F.col("n_convs") - 1) * F.col("size"))
    sides = F.when(F.col("sides") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array("sides"))
    chains = parts.select("part", F.explode(sides).alias("side"), "prefix").join(own.select("prefix", "depth", "home", "leaves", "saves"), "prefix")
    at_home = (F.col("home.part") == F.col("part")) & (F.col("home.side") == F.col("side"))
    down = Window.partitionBy("part", "side").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = chains.select("prefix", *(F.sum(F.when(at_home, F.col(c)).otherwise(0)).over(down).alias(c) for c in ("leaves", "saves"))).groupBy("prefix").agg(F.sum("leaves").alias("n_leaves"), F.sum("saves").alias("saved_tokens"))
    pieces = swept.where("kind = 2").select("prefix", "part", "seq", "ids")
    ends = pieces.repartition("prefix").sortWithinPartitions("prefix", "part", "seq").select("prefix", "ids").transform(mapped, _digested, "prefix binary, ends string")
    above = found.select(F.col("prefix").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    opened = own.select("prefix", "above", "conv_id", "depth", "n_convs", "n_children").join(sums, "prefix").join(ends, "prefix", "left").join(above, "above", "left")
    opened = opened.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))
    closed = swept.where("kind = 0")
    places = closed.select("part", F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")).unionByName(
        parts.select("part", F.col("node").alias("parent"), "prefix").join(found.select("prefix", F.col("conv_id").alias("parent_conv_id")), "prefix").drop("prefix"))
    closed = closed.join(places, ["part", "parent"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ids").alias("ends_sha256"))
    return opened.unionByName(closed)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    bound_batches(spark)
    return trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE_OP11 = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), strlen(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT *, conv_id - conv_id % 5 AS base FROM (SELECT DISTINCT conv_id FROM turns)),
crc AS (SELECT conv_id, base, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, i + 1, 1))::BIGINT)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)) AS c
  FROM ids),
heads AS (SELECT conv_id, base, xor(c, 4294967295::BIGINT) % 9 AS h FROM crc),
built AS (
  SELECT h.conv_id, t.pos, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.base AND t.pos <= h.h
  UNION ALL SELECT h.conv_id, t.pos + 1000000, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.pos > h.h),
placed AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM built),
members AS (
  SELECT conv_id, depth, text, list({r: role, t: text}) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM placed
  UNION ALL SELECT conv_id, 0, '', [] FROM ids),
sizes AS (SELECT conv_id, max(depth) AS turns FROM members GROUP BY conv_id),
nodes AS (
  SELECT min(m.conv_id) AS conv_id, depth, prefix, count(*) AS n_convs, any_value(strlen(text)) AS size,
    sha256(coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (WHERE s.turns = depth), '')) AS ends_sha256
  FROM members m JOIN sizes s USING (conv_id) GROUP BY depth, prefix),
whose AS (SELECT m.conv_id AS member, n.conv_id, n.depth FROM members m JOIN nodes n ON m.depth = n.depth AND m.prefix = n.prefix),
linked AS (SELECT n.*, w.conv_id AS parent_conv_id FROM nodes n LEFT JOIN whose w ON w.member = n.conv_id AND w.depth = n.depth - 1),
children AS (SELECT parent_conv_id, depth - 1 AS depth, count(*) AS n FROM linked WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT l.*, coalesce(c.n, 0) AS n_children FROM linked l LEFT JOIN children c ON c.parent_conv_id = l.conv_id AND c.depth = l.depth),
subtree AS (
  SELECT w.conv_id, w.depth, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.size) AS saved
  FROM full_nodes b JOIN whose w ON w.member = b.conv_id AND w.depth <= b.depth GROUP BY ALL)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, f.parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN subtree s ON f.conv_id = s.conv_id AND f.depth = s.depth
"""
QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLE = {"op11_prefix_trie": ORACLE_OP11}
