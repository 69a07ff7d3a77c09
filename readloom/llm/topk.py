"""Exact top-k search by inner product: norm buckets, pruned by coordinates or lengths, then verified products."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm import common
from readloom.runtime import forget

#: Candidates in a bucket, and in a range of buckets that one task searches; and bytes of such a range.
BUCKET, RANGE, RANGE_BYTES = 4096, 1 << 16, 32 << 20
#: Queries of alike thresholds that are searched together.
TOGETHER = 64
#: From this local cosine threshold on coordinates prune more than lengths do; so many coordinates are looked at.
STEEP = 0.6
FOCUS = 3
SLACK = 1 + 1e-9
#: Dimensions, the commonest ones, whose longest candidates give their queries a first threshold.
SEEDED = 8
MIXED = "range int, width int, kind int, id bigint, v array<bigint>, squares double, least bigint"


def integers(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v, squares): components floor(scale * x) of vectors without null or non-finite components.

    A component so large that a product could exceed 64 bits fails the job.
    """
    usable = f"`{vector}` is not null and `{key}` is not null and forall(`{vector}`, x -> x is not null and not isnan(x) and abs(double(x)) < double('infinity'))"
    small = f"forall(`{vector}`, x -> abs({scale}D * double(x)) + 1 < sqrt(9.2e18D / greatest(1, size(`{vector}`))))"
    whole = f"transform(`{vector}`, x -> cast(floor({scale}D * double(x)) as bigint))"
    out = vectors.where(usable).select(F.col(key).cast("long").alias("id"), F.expr(f"if({small}, {whole}, raise_error('a component is too large for 64-bit products'))").alias("v"))
    return out.withColumns({"squares": F.expr("aggregate(v, 0D, (s, x) -> s + double(x) * double(x))"), "width": F.size("v")})


def matrix(rows: pa.Array, width: int) -> np.ndarray:
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer products: by floats while every sum stays under 2^53, else by integers."""
    if not queries.size or not candidates.size:
        return np.zeros((len(queries), len(candidates)), "i8")
    top = float(np.abs(queries).max()) * float(np.abs(candidates).max()) * queries.shape[1]
    if top < 2.0**53:
        return (queries.astype("f8") @ candidates.astype("f8").T).astype("i8")
    return queries @ candidates.T


class Best:
    """The k best (score, id) of each query so far, and the score from which on a candidate still counts."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norms = np.sqrt((vectors.astype("f8") ** 2).sum(axis=1))
        n = len(ids)
        self.scores, self.which = np.full((n, k), np.iinfo("i8").min), np.full((n, k), np.iinfo("i8").max)
        self.floor = np.full(n, np.iinfo("i8").min) if floor is None else floor

    def least(self) -> np.ndarray:
        return np.maximum(self.floor, self.scores[:, -1])

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of all ``queries`` (numbers) with candidates ``ids``; a query's own row is passed over."""
        if not len(queries) or not len(ids):
            return
        good = (scores >= self.least()[queries][:, None]) & (ids[None, :] != self.ids[queries][:, None])
        for row in np.flatnonzero(good.any(axis=1)):
            q, new = queries[row], np.flatnonzero(good[row])
            s, i = np.concatenate([self.scores[q], scores[row, new]]), np.concatenate([self.which[q], ids[new]])
            order = np.lexsort((i, ~s))[: self.k]
            self.scores[q], self.which[q] = s[order], i[order]

    def search(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> None:
        """One bucket, longest candidates first. Queries whose threshold it can't reach skip it; the others prune in it."""
        longest = norms[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            least = self.least().astype("f8")
            local = np.where(least <= 0, 0.0, least / (self.norms * longest * SLACK))
        local = np.where(np.isnan(local), np.inf, local)
        steep = np.flatnonzero((local > STEEP) & (local <= 1))
        flat = np.flatnonzero(local <= STEEP)
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.nan_to_num(np.where(least <= 0, 0.0, least / (self.norms * SLACK)), nan=0.0)
        flat = flat[np.argsort(-need[flat], kind="stable")]
        for s in range(0, len(flat), TOGETHER):  # by length: only candidates long enough for the least demanding of these queries
            some = flat[s : s + TOGETHER]
            reach = int(np.searchsorted(-norms, -need[some[-1]], side="right"))
            self.offer(some, products(self.vectors[some], vectors[:reach]), ids[:reach])
        if len(steep):
            self.by_coordinates(steep, local[steep], ids, vectors, norms)

    def by_coordinates(self, queries: np.ndarray, local: np.ndarray, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> None:
        """Each query looks at its largest coordinates: a direction within the local angle lies in an interval of each."""
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = np.nan_to_num(vectors / norms[:, None])
        order, ordered = {}, {}
        for q, cosine in zip(queries, local):
            own = self.vectors[q] / self.norms[q]
            alive = np.ones(len(ids), bool)
            for c in np.argsort(-np.abs(own), kind="stable")[:FOCUS]:
                if c not in order:
                    order[c] = np.argsort(unit[:, c], kind="stable")
                    ordered[c] = unit[order[c], c]
                here, turn = np.arccos(np.clip(own[c], -1, 1)), np.arccos(min(1.0, cosine))
                low, high = np.cos(min(np.pi, here + turn)) - 1e-9, np.cos(max(0.0, here - turn)) + 1e-9
                inside = np.zeros(len(ids), bool)
                inside[order[c][np.searchsorted(ordered[c], low) : np.searchsorted(ordered[c], high, side="right")]] = True
                alive &= inside
            chosen = np.flatnonzero(alive)
            self.offer(np.array([q]), products(self.vectors[[q]], vectors[chosen]), ids[chosen])

    def rows(self) -> pa.RecordBatch:
        q, j = np.nonzero(self.which != np.iinfo("i8").max)
        return pa.record_batch([pa.array(self.ids[q]), pa.array(self.which[q, j]), pa.array(self.scores[q, j])], names=["query_id", "vec_id", "score"])


def searched(k: int):
    """Over rows sorted by (range, width, kind): the candidates of a range, longest first, then the queries that may find
    something there. Queries are answered batch by batch, so a task holds one range and one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, norms = None, [], [], []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            edges = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                part, (spot, width, kind) = batch.slice(s, e - s), keys[s].tolist()
                own = matrix(part.column(4), width) if width else np.zeros((e - s, 0), "i8")
                if (spot, width) != now:
                    now, ids, vectors, norms = (spot, width), [], [], []
                if kind == 0:
                    ids.append(part.column(3).to_numpy())
                    vectors.append(own)
                    norms.append(np.sqrt(part.column(5).to_numpy()))
                    continue
                ids, vectors, norms = ([np.concatenate(x)] if x else [] for x in (ids, vectors, norms))
                best = Best(part.column(3).to_numpy(), own, k, part.column(6).to_numpy())
                for at in range(0, len(ids[0]) if ids else 0, BUCKET):
                    best.search(ids[0][at : at + BUCKET], vectors[0][at : at + BUCKET], norms[0][at : at + BUCKET])
                yield best.rows()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """For each row of ``queries`` its ``k`` best rows of ``vectors`` by the inner product of floor(scale * x).

    Result: query_id, rank (from 1), vec_id, score; ties to the smaller vec_id, all rows if there are fewer than k,
    rows with the query's own key left out. Vectors that are null or hold a null or non-finite component take no
    part, nor do candidates of another dimension than the query's. Of queries that repeat a key the smallest vector
    counts; candidates that repeat a key count each. Sums are 64-bit; components too large for that fail the job.

    Candidates are dealt by length into ranges of norm buckets. The longest candidates give each query a threshold; with
    it the query goes to those ranges only whose longest candidate can reach it, and prunes each bucket there. It is one
    plan however many queries there are: neither queries nor candidates pass the driver, but for SEEDED buckets.
    """
    common.bounded_batches(vectors.sparkSession)
    context, conf = vectors.sparkSession.sparkContext, vectors.sparkSession.conf
    base = common.durable(integers(vectors, key, vector, scale))
    size = base.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("width").cast("long")), F.lit(0)).alias("components")).first()
    parts = max(int(conf.get("spark.sql.shuffle.partitions")), -(-size["rows"] // RANGE), -(-8 * size["components"] // RANGE_BYTES))
    order = ("width", F.col("squares").desc(), "id")
    dealt = common.durable(base.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()))
    forget(base)
    ranges = dealt.groupBy("width", "range").agg(F.max("squares").alias("longest"), F.count(F.lit(1)).alias("n")).orderBy("width", F.desc("longest"), "range").toArrow().to_pylist()  # one row for RANGE candidates
    spots: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for width in {r["width"] for r in ranges}:
        own = [r for r in ranges if r["width"] == width]
        spots[width] = np.array([r["range"] for r in own], "i4"), np.sqrt(np.array([r["longest"] for r in own]))
    seeds, often = {}, Counter()
    for r in ranges:
        often[r["width"]] += r["n"]
    for width, _ in often.most_common(SEEDED):
        first = dealt.where(F.col("width") == width).orderBy(F.col("squares").desc(), "id").limit(BUCKET).toArrow()
        if width and first.num_rows:
            seeds[width] = first.column("id").to_numpy(), matrix(first.column("v").combine_chunks(), width), np.sqrt(first.column("squares").to_numpy())
    shared = context.broadcast((spots, seeds))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for every range whose longest candidate its threshold allows."""
        spots, seeds = shared.value
        for batch in batches:
            widths = batch.column(2).to_numpy()
            for width in np.unique(widths).tolist():
                rows = batch.filter(pa.array(widths == width))
                if width not in spots:
                    continue
                own = matrix(rows.column(1), width) if width else np.zeros((rows.num_rows, 0), "i8")
                best = Best(rows.column(0).to_numpy(), own, k)
                if width in seeds:
                    best.search(*seeds[width])
                least, (which, longest) = best.least(), spots[width]
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.nan_to_num(np.where(least <= 0, 0.0, least / (best.norms * SLACK)), nan=0.0)
                reach = np.searchsorted(-longest, -need, side="right")
                at = np.repeat(np.arange(rows.num_rows), reach)
                spot = which[np.concatenate([np.arange(r) for r in reach])] if len(at) else np.zeros(0, "i4")
                for s in range(0, len(at), common.BATCH_ROWS):
                    some, n = at[s : s + common.BATCH_ROWS], len(at[s : s + common.BATCH_ROWS])
                    fixed = [pa.array(spot[s : s + n]), pa.array(np.full(n, width, "i4")), pa.array(np.ones(n, "i4"))]
                    yield pa.record_batch([*fixed, rows.column(0).take(pa.array(some)), rows.column(1).take(pa.array(some)), pa.array(-need[some]), pa.array(least[some])], names=["range", "width", "kind", "id", "v", "squares", "least"])

    asked = integers(queries, key, vector, scale).groupBy("id").agg(F.min("v").alias("v")).withColumn("width", F.size("v"))
    asked = asked.mapInArrow(sent, MIXED)  # squares: the less, the more demanding
    those = dealt.select("range", "width", F.lit(0).alias("kind"), "id", "v", "squares", F.lit(0).cast("long").alias("least"))
    mixed = those.unionByName(asked).repartitionByRange(parts, "range").sortWithinPartitions("range", "width", "kind", F.when(F.col("kind") == 0, -F.col("squares")).otherwise(F.col("squares")), "id")
    found = mixed.mapInArrow(searched(k), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer products of every hundredth vector with all others; see top_k."""
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024.0::DOUBLE * x::DOUBLE) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
