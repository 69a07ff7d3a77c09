"""Merkle manifest of a table: partitions' sparse forests are merged in a tree until each group of rows has one root, with proofs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from readloom.llm import common

#: Leaves of an aligned stretch that is resolved at once, and stretches (or nodes) that one step of the tree reduction merges:
#: the largest powers of the arity up to these.
STRETCH, FAN_IN = 4096, 1024
#: The first numbers of groups in ranges are broadcast up to so many of them (some 8 MB), else joined.
BROADCAST_STARTS = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: str) -> str:
    return hashlib.sha256(parts.encode("ascii")).hexdigest()


def width_above(width: int, arity: int) -> int:
    return -(-width // arity)


def height(width: int, arity: int) -> int:
    """Levels from the leaves to the only node."""
    out = 0
    while width > 1:
        width, out = width_above(width, arity), out + 1
    return out


def power(arity: int, most: int) -> int:
    """The largest exponent, at least 1, whose power of ``arity`` is within ``most``."""
    out = 1
    while arity ** (out + 1) <= most:
        out += 1
    return out


@dataclass
class Forest:
    """The unresolved nodes of one tree, (level, index) -> digest. Adding and merging are associative and commute.

    The tree's number of leaves is known, so that of each level is; siblings are runs of ``arity`` nodes, the last run of
    a level may be shorter, even one node. As soon as all nodes of a run are there they become their parent.
    """

    width: int
    arity: int
    nodes: dict[tuple[int, int], str] = field(default_factory=dict)
    #: every node that was here, for proofs; left empty unless asked for
    seen: dict[tuple[int, int], str] | None = None
    #: nodes of this level stay, even if a run is one of them
    top: int | None = None

    def widths(self) -> list[int]:
        out = [self.width]
        while out[-1] > 1:
            out.append(width_above(out[-1], self.arity))
        return out

    def run(self, level: int, index: int, widths: list[int]) -> range:
        first = index - index % self.arity
        return range(first, min(first + self.arity, widths[level]))

    def add(self, level: int, index: int, node: str) -> None:
        widths = self.widths()
        while True:
            self.nodes[level, index] = node
            if self.seen is not None:
                self.seen[level, index] = node
            run = self.run(level, index, widths)
            if level in (self.top, len(widths) - 1) or any((level, i) not in self.nodes for i in run):
                return
            node = digest("".join(self.nodes.pop((level, i)) for i in run))
            level, index = level + 1, index // self.arity

    def merge(self, other: Forest) -> Forest:
        for (level, index), node in other.nodes.items():
            self.add(level, index, node)
        return self

    def path(self, level: int, index: int) -> str:
        """The siblings of a node and of its ancestors here, level by level, from left to right."""
        widths, out = self.widths(), []
        while (level, index) not in self.nodes:
            out += [self.seen[level, i] for i in self.run(level, index, widths) if i != index]
            level, index = level + 1, index // self.arity
        return "".join(out)


def climbed(width: int, first: int, nodes: list[str], arity: int, top: int) -> list[tuple[int, list[str]]]:
    """Per level, up to ``top`` at most, the first index and the digests that the leaves ``first``, first + 1, ... resolve."""
    out = [(first, nodes)]
    while width > 1 and len(out) <= top:
        last = first + len(nodes)
        low, high = -(-first // arity), width_above(width, arity) if last == width else last // arity
        if high <= low:
            break
        nodes = [digest("".join(nodes[r * arity - first : (r + 1) * arity - first])) for r in range(low, high)]
        first, width = low, width_above(width, arity)
        out.append((first, nodes))
    return out


def unresolved(width: int, first: int, nodes: list[str], arity: int, top: int) -> Iterator[tuple[int, int, str]]:
    """(level, index, digest) of the nodes that ``climbed`` leaves without a parent: a forest's."""
    levels = climbed(width, first, nodes, arity, top)
    for level, (low, own) in enumerate(levels):
        above = levels[level + 1] if level + 1 < len(levels) else (0, [])
        inner = range(above[0] * arity, (above[0] + len(above[1])) * arity)
        yield from ((level, low + i, x) for i, x in enumerate(own) if low + i not in inner)


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``index`` in its group, in ``order``, and ``width``, the group's rows; all columns of ``order`` ascend."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [group, *order, "_tie"]
    dealt = tied.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    dealt = common.durable(dealt.drop("_tie"))
    spans = dealt.groupBy("_range", group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    of_group = Window.partitionBy(group)
    starts = common.durable(spans.select("_range", group, "_first", (F.sum("_n").over(of_group.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(of_group).alias("width")))
    few = starts.count() <= BROADCAST_STARTS
    joined = dealt.join(F.broadcast(starts) if few else starts, ["_range", group])
    out = joined.withColumn("index", F.col("_before") + F.col("_at") - F.col("_first")).drop("_range", "_at", "_first", "_before")
    return out if few else out.sortWithinPartitions(group, "index")


def proven(rows: DataFrame, group: str, leaf: str, order: Sequence[str], arity: int, above: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``rows`` with index, width, subroot, root, group_index, groups and proof: a tree for each value of ``group``.

    ``group`` (a string, not null) and ``leaf`` (32 bytes) are columns of ``rows``. ``above`` takes (group, width, subroot)
    of all trees and gives them root, group_index, groups and rest, the siblings from the subroot on.

    Tree reduction: tasks turn the leaves that they read into forests of unresolved nodes; then forests of
    neighbouring stretches are merged, FAN_IN at a time, until each tree has one node. Neighbours meet first, so that what
    is merged is resolved at once and only one node a merge goes on; what a merge resolves is kept for the proofs, which
    go the same way back down. Nothing passes through the driver but the largest tree's size.
    """
    low, step = power(arity, STRETCH), power(arity, FAN_IN)
    placed = numbered(rows, group, order).withColumn("stretch", F.expr(f"index div {arity**low}"))

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            out = []
            for own, width, stretch, index, node in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (own, width, stretch) or index != held[0] + len(held) - 1:
                    out += flushed(now, held)
                    now, held = (own, width, stretch), [index]
                held.append(node.hex())
            yield nodes_of(out)
        yield nodes_of(flushed(now, held))

    def flushed(now: tuple | None, held: list) -> list[tuple]:
        if now is None:
            return []
        own, width, stretch = now
        return [(own, width, stretch, *node) for node in unresolved(width, held[0], held[1:], arity, low)]

    def nodes_of(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * 6
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["g", "width", "at", "level", "index", "node"])

    nodes = placed.select(F.col(group).alias("g"), "width", "stretch", "index", leaf).mapInArrow(forests, "g string, width bigint, at bigint, level int, index bigint, node string")
    nodes = common.durable(nodes)
    widest = nodes.agg(F.max("width")).first()[0] or 1
    rounds, base = [], low
    while True:
        merged = common.durable(nodes.groupBy("g", F.expr(f"at div {arity**step}").alias("parent")).applyInArrow(merging(arity, base, base + step), "g string, width bigint, parent bigint, node string, children array<bigint>, paths array<string>"))
        rounds.append(merged)
        base += step
        nodes = merged.select("g", "width", F.col("parent").alias("at"), F.least(F.lit(base), levels(F.col("width"), arity)).cast("int").alias("level"), F.col("parent").alias("index"), "node")
        if widest <= arity**base:
            break
    tops = rounds[-1].select("g", "width", F.col("node").alias("subroot"))
    chain = above(tops) if above else tops.select("g", "subroot", F.col("subroot").alias("root"), F.lit(0).cast("long").alias("group_index"), F.lit(1).cast("long").alias("groups"), F.lit("").alias("rest"))
    chain = chain.withColumn("parent", F.lit(0).cast("long"))
    for merged in reversed(rounds):
        paths = merged.select("g", "parent", F.inline(F.arrays_zip(F.col("children").alias("child"), F.col("paths").alias("path"))).alias("child", "path"))
        chain = paths.join(chain, ["g", "parent"]).select("g", F.col("child").alias("parent"), "subroot", "root", "group_index", "groups", F.concat("path", "rest").alias("rest"))
    chain = chain.withColumnRenamed("parent", "stretch")

    shown = [c for c in placed.columns if c != "stretch"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.select(*shown).schema)

    def proofs(own: pa.Table, told: pa.Table) -> pa.Table:
        own = own.sort_by("index")
        told = told.to_pylist()[0]
        width, first = own["width"][0].as_py(), own["index"][0].as_py()
        tree = climbed(width, first, [x.as_py().hex() for x in own[leaf]], arity, low)
        down = [told["rest"]]
        for lower, nodes in reversed(tree[:-1]):
            down = ["".join(nodes[i - i % arity : i] + nodes[i + 1 : i - i % arity + arity]) + down[i // arity] for i in range(len(nodes))]
        fixed = [pa.array([told[c]] * len(own), t) for c, t in (("subroot", pa.string()), ("root", pa.string()), ("group_index", pa.int64()), ("groups", pa.int64()))]
        return pa.table([*(own[c] for c in shown), *fixed, pa.array(down, pa.string())], names=[*shown, "subroot", "root", "group_index", "groups", "proof"])

    both = placed.groupBy(group, "stretch").cogroup(chain.groupBy("g", "stretch"))
    return both.applyInArrow(proofs, f"{kinds}, subroot string, root string, group_index bigint, groups bigint, proof string")


def merging(arity: int, base: int, top: int) -> Callable[[pa.Table], pa.Table]:
    """A merge of forests of one tree that together hold an aligned part of it, up to level ``top``."""

    def merge(nodes: pa.Table) -> pa.Table:
        rows = nodes.to_pylist()
        width = rows[0]["width"]
        forest = Forest(width, arity, seen={}, top=top)
        for r in rows:
            forest.merge(Forest(width, arity, {(r["level"], r["index"]): r["node"]}))
        ((level, index), node), *more = forest.nodes.items()
        if more or level != min(top, height(width, arity)):
            raise ValueError(f"leaves of {rows[0]['g']!r} are missing")
        children = sorted(i for own, i in forest.seen if own == min(base, level))
        paths = [forest.path(min(base, level), i) for i in children]
        kinds = {"g": pa.string(), "width": pa.int64(), "parent": pa.int64(), "node": pa.string(), "children": pa.list_(pa.int64()), "paths": pa.list_(pa.string())}
        return pa.table([pa.array([x], k) for x, k in zip((rows[0]["g"], width, index, node, children, paths), kinds.values())], names=list(kinds))

    return merge


def levels(width: Column, arity: int) -> Column:
    """``height`` as a column."""
    powers = F.array(*(F.lit(arity**i) for i in range(63) if arity**i < 1 << 62))
    return F.size(F.filter(powers, lambda p: p < width))


def leaf_of(fields: Sequence[Column]) -> Column:
    """The digest of a row: per field - if null, else its UTF-8 length, a colon and the value."""
    shown = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown)), 256)


def manifest(rows: DataFrame, leaf: str, group: str = "lang", order: Sequence[str] = ("doc_id",), arity: int = 2) -> DataFrame:
    """``rows`` with index, width, subroot, group_index, groups, root and proof: each row's place in the table's tree.

    ``leaf`` names a column of hex digests (see leaf_of). Leaves of one ``group`` ascend by ``order``, nulls first, equal ones
    by their digest; every ``arity`` consecutive nodes become the digest of their joined digests, the last run of a level
    also if it is shorter. Groups' subroots, null first and then by their bytes, become the root in the same way.
    ``proof`` joins the siblings on the way up, from left to right. No row is lost, repeated rows have places of their
    own; an empty table has no rows and no root. Columns of ``rows`` that clash with the new ones are errors.
    """
    made = {"index", "width", "subroot", "group_index", "groups", "root", "proof", "stretch", "_leaf", "_group"}
    if clash := made & {c.lower() for c in rows.columns}:
        raise ValueError(f"columns of these names are made here: {', '.join(sorted(clash))}")
    value = F.col(f"`{group}`").cast("string")
    named = rows.withColumns({"_group": F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value)), "_leaf": F.unhex(F.col(f"`{leaf}`"))})
    kept = common.durable(named.drop(leaf))

    def above(tops: DataFrame) -> DataFrame:
        leaves = tops.select(F.lit("").alias("all"), "g", F.unhex("subroot").alias("_leaf"))
        done = proven(leaves, "all", "_leaf", ["g"], arity)
        return done.select("g", F.lower(F.hex("_leaf")).alias("subroot"), "root", F.col("index").alias("group_index"), F.col("width").alias("groups"), F.col("proof").alias("rest"))

    out = proven(kept, "_group", "_leaf", [*order, "_leaf"], arity, above)
    return out.withColumn(leaf, F.lower(F.hex("_leaf"))).select(*rows.columns, "index", "width", "subroot", "group_index", "groups", "root", "proof")


def folded(leaf: Column, row: Column, arity: int = 2) -> Column:
    """The root that ``leaf`` gives with the place and the proof of a manifest's row (struct index, width, group_index, groups, proof)."""

    @arrow_udf("string")
    def fold(leaves: pa.Array, rows: pa.Array) -> pa.Array:
        places = zip(*(rows.field(c).to_pylist() for c in ("index", "width", "group_index", "groups", "proof")))
        return pa.array([root_of(x, *p, arity) for x, p in zip(leaves.to_pylist(), places)], pa.string())

    return fold(leaf, row)


def root_of(node: str, index: int, width: int, group_index: int, groups: int, proof: str, arity: int = 2) -> str:
    at = 0
    for i, n in ((index, width), (group_index, groups)):
        while n > 1:
            place = i % arity
            siblings = min(arity, n - i + place) - 1
            parts = [proof[at + 64 * k : at + 64 * k + 64] for k in range(siblings)]
            at += 64 * siblings
            node = digest("".join([*parts[:place], node, *parts[place:]]))
            i, n = i // arity, width_above(n, arity)
    return node


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents by language, and what it says of rows of which every seventh is tampered with."""
    common.bounded_batches(spark)
    docs = common.table(spark, sf_dir, "documents").select(*FIELDS)
    more = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    rows = docs.select("doc_id", "lang", leaf_of([F.col(c) for c in FIELDS]).alias("leaf"), F.when(tampered & F.col("n_chars").isNotNull(), F.unhex(leaf_of(more))).alias("changed"))
    done = manifest(rows, "leaf")
    again = folded(F.coalesce(F.lower(F.hex("changed")), F.col("leaf")), F.struct("index", "width", "group_index", "groups", "proof"))
    done = done.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), again.alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


FIELD_SQL = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
LEAF_SQL = "sha256(" + " || ".join(FIELD_SQL.format(c) for c in FIELDS) + ")"
BYTES_SQL = "list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substring(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))"
#: The checksum a bit at a time; 3988292384 is its polynomial.
BITS_SQL = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
CRC32_SQL = f"xor(4294967295, list_reduce(list_concat([4294967295], {BYTES_SQL}), lambda c, b: {BITS_SQL}))"
STEP_SQL = "sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.idx % 2 = 0 THEN f.h || s.h ELSE s.h || f.h END), f.proof || coalesce(s.h, '')"
OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {LEAF_SQL} AS leaf, CASE WHEN {CRC32_SQL} % 7 = 0 AND n_chars IS NOT NULL THEN {LEAF_SQL.replace("n_chars", "(n_chars + 1)")} END AS changed FROM documents
), r AS (
  SELECT *, coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM d
), lv(g, level, idx, h, n) AS (
  SELECT g, 0, idx, leaf, n FROM r UNION ALL
  SELECT g, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM lv WHERE n > 1 GROUP BY g, level, idx // 2, n
), sub AS (
  SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM lv WHERE n = 1
), up(level, idx, h, n) AS (
  SELECT 0, idx, h, n FROM sub UNION ALL SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY level, idx // 2, n
), f1(doc_id, g, level, idx, n, h, proof) AS (
  SELECT doc_id, g, 0, idx, n, coalesce(changed, leaf), '' FROM r UNION ALL
  SELECT f.doc_id, f.g, f.level + 1, f.idx // 2, (f.n + 1) // 2, {STEP_SQL} FROM f1 f LEFT JOIN lv s ON s.g = f.g AND s.level = f.level AND s.idx = xor(f.idx, 1) WHERE f.n > 1
), f2(doc_id, g, level, idx, n, h, proof) AS (
  SELECT f.doc_id, f.g, 0, sub.idx, sub.n, f.h, f.proof FROM f1 f JOIN sub ON f.g = sub.g WHERE f.n = 1 UNION ALL
  SELECT f.doc_id, f.g, f.level + 1, f.idx // 2, (f.n + 1) // 2, {STEP_SQL} FROM f2 f LEFT JOIN up s ON s.level = f.level AND s.idx = xor(f.idx, 1) WHERE f.n > 1
)
SELECT r.doc_id, r.leaf, sub.h AS subroot, up.h AS root, sha256(f2.proof) AS proof_sha256, f2.h AS folded_root, f2.h = up.h AS verified
FROM r JOIN sub USING (g) JOIN f2 ON f2.doc_id = r.doc_id AND f2.n = 1 JOIN up ON up.n = 1
"""
