"""Approximate nearest neighbours by multi-index hashing.

Codes of 64 bits are signs under rotations learned on a bounded sample (iterative
quantisation of the principal axes; several rotations side by side if a vector has
fewer than 64 numbers). A code is split into 8 substrings of 8 bits, each with an
index. A radius is learned on the sample as a high quantile of the distances between
true neighbours. By the pigeonhole principle, a code within the radius differs little
in some substring: probing each index at its share of the radius retrieves every code
within it; those are checked whole, and reranked by cosine in double precision.

Rows are kept in packs of bounded size with their own indexes. Packs of queries meet
all packs (a stated query set against all rows, in blocks); each pair gives the best few
of each query. A query with too few rows in the radius is searched at the full radius.

Defined results: vectors that are null, zero, of another length than the sample's most
frequent one, or holding null or non-finite components take no part, nor do rows with a
null id; rows that share the query's id are its own; each row of a repeated query id has
its own result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import cut

TOP = 5
#: Rows on which rotations and the radius are learned.
SAMPLE = 8192
#: Share of true neighbours in the sample that the radius holds.
HELD = 0.97
PACK, QUERY_PACK = 4096, 1024
SEGMENTS, WIDTH = 8, 8
BITS = SEGMENTS * WIDTH
#: Distance of any two substrings.
APART = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))


def learn_rotations(x: np.ndarray, steps: int = 25, seed: int = 1) -> np.ndarray:
    """(dim, BITS) whose signs are the codes; x: unit vectors."""
    dim = x.shape[1]
    rng = np.random.default_rng(seed)
    _, axes = np.linalg.eigh(x.T @ x)
    own = min(dim, BITS)
    v = x @ axes[:, ::-1][:, :own]
    parts = []
    for _ in range(-(-BITS // own)):
        r = np.linalg.qr(rng.standard_normal((own, own)))[0]
        for _ in range(steps):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        parts.append(axes[:, ::-1][:, :own] @ r)
    return np.concatenate(parts, axis=1)[:, :BITS]


def codes(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """A row of SEGMENTS bytes for each vector."""
    return np.packbits(x @ rotation >= 0, axis=1, bitorder="little")


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a with b; the same for equal rows wherever they stand."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum()))


def learn_radius(x: np.ndarray, rotation: np.ndarray, held: float = HELD, top: int = TOP) -> int:
    queries = x[:512]
    if len(x) <= top + 1:
        return BITS
    near = queries @ x.T
    near[np.arange(len(queries)), np.arange(len(queries))] = -2
    best = np.argpartition(-near, top, axis=1)[:, :top]
    c = codes(x, rotation).view(np.uint64)[:, 0]
    far = np.bitwise_count(c[: len(queries), None] ^ c[best])
    return int(np.quantile(far, held, method="higher"))


def shares(radius: int) -> list[int]:
    """Radius of each substring, such that a code in the radius is found by one of them; -1: not probed."""
    low = radius // SEGMENTS
    more = radius - low * SEGMENTS + 1
    return [low] * more + [low - 1] * (SEGMENTS - more)


class Pack:
    """Up to PACK rows with an index for each substring: rows sorted by it, and the number of rows of each value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, code: np.ndarray):
        self.ids, self.x, self.code = ids, x, code
        self.whole = np.ascontiguousarray(code).view(np.uint64)[:, 0]
        self.order = [np.argsort(code[:, s], kind="stable") for s in range(SEGMENTS)]
        self.sizes = [np.bincount(code[:, s], minlength=256) for s in range(SEGMENTS)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within radius: those that some index gives, checked whole."""
        found = np.zeros(len(self.ids), bool)
        for s, r in enumerate(shares(radius)):
            if r >= 0:
                probed = APART[code[s]] <= r
                found[self.order[s][np.repeat(probed, self.sizes[s])]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.whole[rows] ^ code.view(np.uint64)[0]) <= radius]

    def best(self, own: int, x: np.ndarray, code: np.ndarray, radius: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.within(code, radius)
        rows = rows[self.ids[rows] != own]
        score = cosines(self.x[rows], x)
        if len(rows) > top:
            least = np.partition(score, len(score) - top)[len(score) - top]
            rows, score = rows[score >= least], score[score >= least]
        by = np.lexsort((self.ids[rows], -score))[:top]
        return self.ids[rows][by], score[by]


def _packs(size: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation = shared.value
        dim = rotation.shape[0]
        at = TaskContext.get().partitionId() << 40
        ids: list[np.ndarray] = []
        rows: list[np.ndarray] = []

        def out(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            nonlocal at
            unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
            raw = [ids.tobytes(), np.ascontiguousarray(x).tobytes(), codes(unit, rotation).tobytes()]
            done = pa.record_batch([pa.array([at]), *[pa.array([r], pa.binary()) for r in raw]], ["row", "ids", "x", "code"])
            at += len(ids)
            return done

        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                ids.append(part.column(0).to_numpy())
                rows.append(part.column(1).flatten().to_numpy().reshape(-1, dim))
                if sum(map(len, ids)) >= size:
                    i, x = np.concatenate(ids), np.concatenate(rows)
                    yield out(i[:size], x[:size])
                    ids, rows = [i[size:]], [x[size:]]
        if sum(map(len, ids)):
            yield out(np.concatenate(ids), np.concatenate(rows))

    return run


def _search(radius: int, dim: int, top: int):
    names = ["row", "query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pack = None, None
        for batch in batches:
            for row, q_ids, q_x, q_code, ids, x, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (ids, code) != key:
                    key = (ids, code)
                    pack = Pack(np.frombuffer(ids, np.int64), np.frombuffer(x).reshape(-1, dim), np.frombuffer(code, np.uint8).reshape(-1, SEGMENTS))
                own, vectors, own_codes = np.frombuffer(q_ids, np.int64), np.frombuffer(q_x).reshape(-1, dim), np.frombuffer(q_code, np.uint8).reshape(-1, SEGMENTS)
                found = [pack.best(own[i], vectors[i], own_codes[i].copy(), radius, top) for i in range(len(own))]
                sizes = [len(f) for f, _ in found]
                flat = [np.repeat(row + np.arange(len(own)), sizes), np.repeat(own, sizes), np.concatenate([f for f, _ in found]), np.concatenate([s for _, s in found])]
                yield pa.record_batch([pa.array(c) for c in flat], names)

    return run


def _pairs(queries: DataFrame, packs: DataFrame, radius: int, dim: int, top: int) -> DataFrame:
    pairs = queries.select("row", F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), F.col("code").alias("q_code")).crossJoin(packs.drop("row"))
    return pairs.mapInArrow(_search(radius, dim, top), "row long, query_id long, vec_id long, score double")


def nearest(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, held: float = HELD) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found for each row where is_query holds."""
    spark = rows.sparkSession
    valid = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    valid = valid.where(F.col("id").isNotNull() & F.coalesce(F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False)))
    drawn = valid.select("v", F.xxhash64(F.lit(3), "id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE).select("v").collect()
    if not drawn:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = Counter(len(r.v) for r in drawn).most_common(1)[0][0]
    x = np.array([r.v for r in drawn if len(r.v) == dim])
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    rotation = learn_rotations(x)
    radius = learn_radius(x, rotation, held, top)
    shared = spark.sparkContext.broadcast(rotation)
    valid = valid.where(F.size("v") == dim)
    schema = "row long, ids binary, x binary, code binary"
    packs = cut(valid.select("id", "v").mapInArrow(_packs(PACK, shared), schema))
    asked = valid.where("q").select("id", "v")
    n = asked.count()
    own = cut(asked.repartition(max(1, -(-n // QUERY_PACK))).mapInArrow(_packs(QUERY_PACK, shared), schema))
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    found = _pairs(own, packs, radius, dim, top).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    found = cut(found)
    if radius < BITS:
        # Queries with fewer than top rows in the radius: every row is in the full one.
        full = found.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= top).select("row")
        few = _unpacked(own, dim).join(full, "row", "left_anti").drop("row")
        again = few.repartition(max(1, -(-n // QUERY_PACK))).mapInArrow(_packs(QUERY_PACK, shared), schema)
        again = cut(again)
        more = _pairs(again, packs, BITS, dim, top).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        found = found.join(full, "row", "left_semi").unionByName(more)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _unpacked(packs: DataFrame, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ids, x in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = np.frombuffer(ids, np.int64)
                yield pa.record_batch([pa.array(own), pa.array(list(np.frombuffer(x).reshape(-1, dim)), pa.list_(pa.float64())), pa.array(row + np.arange(len(own)))], ["id", "v", "row"])

    return packs.mapInArrow(run, "id long, v array<double>, row long")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, F.col("vec_id") % 50 == 0)
