"""Exact top-k by distributed histogram selection.

Every query is scored against every candidate, in blocks of queries and blocks of candidates. The k-th
best score of each query is located by histograms: each round counts scores in equal bins of the range
that is left, the bins' counts are summed over all tasks, and the bin that holds the k-th score is the
next range, until it is a single value. A task only reports its counts from the top down to its own
k-th score, which can't lie above the corpus-wide one, so what it sends is bounded by k bins a query.
Then candidates at or above the k-th score are filtered and ties broken by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweaver.session import cut

#: Vectors in a block; a pair of blocks makes a score matrix of this size squared at most.
BLOCK = 1024
BINS = 512


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null where the vector or a component is null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _blocks(vectors: DataFrame, name: str, parts: int) -> DataFrame:
    """(name block number, ids, data): vectors packed side by side, BLOCK at most in a row, equal sizes only."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, part in pdf.groupby(pdf["v"].map(len), sort=True):
                for at in range(0, len(part), BLOCK):
                    rows = part.iloc[at : at + BLOCK]
                    data = np.stack(rows["v"].to_numpy()).astype("<i8") if size else np.zeros((len(rows), 0), "<i8")
                    yield pd.DataFrame({"ids": [rows["id"].to_numpy().astype("<i8").tobytes()], "data": [data.tobytes()], "dim": [int(size)]})

    return vectors.repartition(parts, "id").mapInPandas(pack, "ids binary, data binary, dim int").select(F.col("ids").alias(f"{name}_ids"), F.col("data").alias(f"{name}_data"), "dim")


def _matrix(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(data, "<i8").reshape(len(i), dim)


def _largest(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products; by doubles where every partial sum is an exact one. Products past 64 bits raise."""
    most = _largest(q) * _largest(v) * max(1, q.shape[1])
    if most >= 1 << 62:
        raise ValueError("an inner product of these components may not fit 64 bits")
    return np.rint(q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64) if most < 1 << 52 else q @ v.T


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "v") -> DataFrame:
    """(query_id, rank, id_col, score): each query's k highest integer inner products, ties to the smaller id.

    Both tables have an id (long) and a vector (array<long>). A query is no candidate of its own (the
    row with its id). Null vectors and null ids take no part; vectors of another size than the query's
    are no candidates; fewer than k candidates are all returned; repeated rows count as often as they
    stand, and a repeated query gets its list once for each of its rows. Components whose products could
    pass 64 bits raise. Vectors of any length take part; other columns of any name do no harm; empty
    tables give an empty result.
    """
    spark = queries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    # blocks are whole tables of a few rows; candidates are dealt over all tasks, and each meets the query blocks one by one
    q = cut(_blocks(clean(queries), "q", max(1, parts // 4)).withColumn("block", F.monotonically_increasing_id()))
    c = clean(candidates)
    shares = max(1, min(parts, -(-c.count() // BLOCK)))
    c = cut(_blocks(c, "c", shares))
    # A stated query set against all rows, block by block. Candidates are dealt over shares, each of which gets every
    # query block: candidates move once, queries once a share, and no share holds more than its part.
    dealt = c.withColumn("share", F.pmod(F.xxhash64("c_ids"), F.lit(shares)))
    every = q.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<bigint>")))

    def meet(ranges: DataFrame) -> DataFrame:
        """Each block of candidates beside each block of queries with its ranges."""
        asked = every.join(packed(ranges), "block").repartition(2 * shares, "share", "dim")
        return dealt.repartition(2 * shares, "share", "dim").join(asked, ["share", "dim"])

    reach = q.select(F.col("block"), "q_ids", "q_data", "dim")

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, data, dim in zip(pdf["c_ids"], pdf["c_data"], pdf["dim"], strict=True):
                _, v = _matrix(ids, data, dim)
                yield pd.DataFrame({"dim": [dim], "norm": [float((v.astype(np.float64) ** 2).sum(1).max(initial=0) ** 0.5)]})

    norms = c.mapInPandas(bounds, "dim int, norm double").groupBy("dim").agg(F.max("norm").alias("norm"))

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, data, dim, block, norm in zip(pdf["q_ids"], pdf["q_data"], pdf["dim"], pdf["block"], pdf["norm"], strict=True):
                i, v = _matrix(ids, data, dim)
                high = np.ceil((v.astype(np.float64) ** 2).sum(1) ** 0.5 * norm).astype(np.int64) + 1
                yield pd.DataFrame({"block": block, "slot": np.arange(len(i), dtype=np.int32), "low": -high, "high": high, "above": np.zeros(len(i), np.int64)})

    ranges = reach.join(norms, "dim").mapInPandas(start, "block long, slot int, low long, high long, above long")

    def packed(r: DataFrame) -> DataFrame:
        return r.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("slot", "low", "high", "above"))).alias("ranges"))  # BLOCK at most

    def widths(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.maximum(1, -(-(high - low + 1) // BINS))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, list] = {}  # block -> [low, high, histogram]: one for each block of queries this task met
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                qi, qv = _matrix(r.q_ids, r.q_data, r.dim)
                ci, cv = _matrix(r.c_ids, r.c_data, r.dim)
                low, high = (np.array([x[n] for x in r.ranges], np.int64) for n in ("low", "high"))
                if r.block not in kept:
                    if len(kept) >= 16:
                        yield from (report(*kept.pop(b), b) for b in list(kept))
                    kept[r.block] = [low, high, np.zeros((len(qi), BINS), np.int64)]
                s = _scores(qv, cv)
                ok = (s >= low[:, None]) & (s <= high[:, None]) & (qi[:, None] != ci[None, :])
                rows, cols = np.nonzero(ok)
                bins = (s[rows, cols] - low[rows]) // widths(low, high)[rows]
                kept[r.block][2] += np.bincount(rows * BINS + bins, minlength=len(qi) * BINS).reshape(len(qi), BINS)
        yield from (report(*kept[b], b) for b in kept)

    def report(low: np.ndarray, high: np.ndarray, h: np.ndarray, block: int) -> pd.DataFrame:
        from_top = np.cumsum(h[:, ::-1], axis=1)[:, ::-1]
        slot, b = np.nonzero((h > 0) & (from_top - h < k))
        return pd.DataFrame({"block": np.full(len(slot), block, np.int64), "slot": slot.astype(np.int32), "bin": b.astype(np.int32), "n": h[slot, b]})

    top_down = Window.partitionBy("block", "slot").orderBy(F.desc("bin"))  # BINS rows at most
    while True:
        ranges = cut(ranges)
        open_ = ranges.filter("high > low")
        if open_.isEmpty():
            break
        counts = meet(ranges).select("q_ids", "q_data", "c_ids", "c_data", "dim", "block", "ranges").mapInPandas(count, "block long, slot int, bin int, n long")
        counts = counts.groupBy("block", "slot", "bin").agg(F.sum("n").alias("n"))
        counts = counts.withColumn("upto", F.sum("n").over(top_down)).join(ranges, ["block", "slot"])
        width = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low") + 1) / BINS))
        held = counts.filter((F.col("above") + F.col("upto") >= k) & (F.col("above") + F.col("upto") - F.col("n") < k))
        held = held.select("block", "slot", (F.col("low") + F.col("bin") * width).alias("l"), F.least(F.col("high"), F.col("low") + (F.col("bin") + 1) * width - 1).alias("h"), (F.col("above") + F.col("upto") - F.col("n")).alias("a"))
        # no bin holds the k-th score: there are fewer than k, and all of them are wanted
        ranges = ranges.join(held, ["block", "slot"], "left").select("block", "slot", F.coalesce("l", "low").alias("low"), F.when(F.col("l").isNull(), F.col("low")).otherwise(F.col("h")).alias("high"), F.coalesce("a", "above").alias("above"))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                qi, qv = _matrix(r.q_ids, r.q_data, r.dim)
                ci, cv = _matrix(r.c_ids, r.c_data, r.dim)
                low = np.array([x["low"] for x in r.ranges], np.int64)
                s = _scores(qv, cv)
                rows, cols = np.nonzero((s >= low[:, None]) & (qi[:, None] != ci[None, :]))
                # of equal scores only the k smallest ids of a block can be wanted
                order = np.lexsort((ci[cols], -s[rows, cols], rows))
                rows, cols = rows[order], cols[order]
                first = np.searchsorted(rows, rows)
                keep = np.arange(len(rows)) - first < k
                rows, cols = rows[keep], cols[keep]
                yield pd.DataFrame({"query_id": qi[rows], "slot": rows.astype(np.int64), "block": np.full(len(rows), r.block, np.int64), "id": ci[cols], "score": s[rows, cols]})

    found = meet(ranges).select("q_ids", "q_data", "c_ids", "c_data", "dim", "block", "ranges").mapInPandas(pick, "query_id long, slot long, block long, id long, score long")
    best = F.row_number().over(Window.partitionBy("block", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
