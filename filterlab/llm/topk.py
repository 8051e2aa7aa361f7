"""Exact top-k by inner product with block-at-a-time pruning.

Vectors become integer terms. Candidates are cut into blocks of consecutive ids; a block keeps its
rows (its forward index) and the greatest and least value of each term. For a query, a block's
bound is the sum over terms of the better of the two products. Blocks are visited by falling
bound, a block at a time, until the bound falls below the k-th best score so far: no row of a
block left out can enter the result.

1. Only bounds, a hundredth of the data, meet the groups of queries, shard by shard; each query names
   its ``FIRST_BLOCKS`` blocks of greatest bound.
2. Those blocks are scored for the groups that named them: the k-th best score is a first threshold.
3. Bounds meet the groups again, and a block is sent to a group just if its bound reaches the threshold of some
   query there. The blocks of a group are scored shard by shard, by falling bound, with the threshold as a
   start; the best k of each shard are merged by a window that ranks before its shuffle.

Terms are exact at any size: floor(scale * x) / scale is a double whenever x is, so that is what a
block holds. Rows whose terms pass 2**21 lie in blocks of their own, and where a product could pass 2**53
scores are exact integers of Python instead. Scores are ranked as they are; one beyond 64 bits is
returned as the nearest long.

Vectors that are null, or hold null or non-finite components, take no part, and neither do rows
without id. Shorter vectors count as padded with zeros. Rows that carry the query's own id are no
candidates. Ties go to the smaller id; rows that repeat an id are candidates of their own. An empty
table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from filterlab.llm.common import stored

BLOCK_ROWS, SHARD_BLOCKS, QUERY_ROWS, FIRST_BLOCKS = 512, 64, 2048, 2
#: Blocks whose bounds meet a group of queries in one task.
BOUND_BLOCKS = 8192
#: Terms of ordinary rows lie below this.
WIDE = 2.0**21
_BLOCK = "block long, rows int, dim int, ids binary, vectors binary, high binary, low binary"


def floored(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) / scale of each component; null if the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    # from 2**52 on a double is an integer, and scaling it could overflow
    whole = F.transform(x, lambda v: F.when(F.abs(v) >= F.lit(2.0**52), v).otherwise(F.floor(v * F.lit(float(scale))).cast("double") / F.lit(float(scale))))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), whole)


def blocked(rows: DataFrame, size: int) -> DataFrame:
    """rows (id long, t array<double>, wide boolean), in order of wide and id, as blocks of at most size rows."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            for _, pdf in batch.groupby("wide", sort=True):
                if held is not None and len(held) and held.wide.iloc[0] != pdf.wide.iloc[0]:
                    yield one(number, held)
                    number, held = number + 1, None
                held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
                while len(held) >= size:
                    yield one(number, held[:size])
                    number, held = number + 1, held[size:].reset_index(drop=True)
        if held is not None and len(held):
            yield one(number, held)

    def one(number: int, pdf: pd.DataFrame) -> pd.DataFrame:
        dim = max(map(len, pdf.t))
        m = np.zeros((len(pdf), dim))
        for k, t in enumerate(pdf.t):
            m[k, : len(t)] = t
        return pd.DataFrame({"block": [number], "rows": [len(pdf)], "dim": [dim], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "vectors": [m.tobytes()], "high": [m.max(0).tobytes()], "low": [m.min(0).tobytes()]})

    return rows.repartitionByRange("wide", "id").sortWithinPartitions("wide", "id").mapInPandas(pack, _BLOCK)


def _matrix(row) -> np.ndarray:
    return np.frombuffer(row.vectors, np.float64).reshape(row.rows, row.dim)


def _wide(m: np.ndarray, dim: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, dim - m.shape[1]))) if m.shape[1] < dim else m


def _terms(m: np.ndarray, scale: int, exact: bool) -> np.ndarray:
    """The integer terms of floored vectors: as doubles, or as integers of Python."""
    if exact:
        return m * scale
    return np.array([[int(x) * scale if abs(x) >= 2.0**52 else int(x * scale) for x in row] for row in m], object).reshape(m.shape)


def _doubles_do(*ms: np.ndarray, scale: int) -> bool:
    largest = [float(np.abs(m).max(initial=0)) * scale for m in ms]
    return max(largest) < 2.0**53 and max(m.shape[1] for m in ms) * largest[0] * largest[1] < 2.0**53


def products(q: np.ndarray, m: np.ndarray, scale: int) -> np.ndarray:
    """The exact inner products of floored vectors, as doubles where those are exact, else as integers of Python."""
    dim = max(q.shape[1], m.shape[1])
    q, m, exact = _wide(q, dim), _wide(m, dim), _doubles_do(q, m, scale=scale)
    return _terms(q, scale, exact) @ _terms(m, scale, exact).T


def bounds_of(q: np.ndarray, highs: list[np.ndarray], lows: list[np.ndarray], scale: int) -> np.ndarray:
    """Of each query and block the most that a row of the block can score."""
    dim = max([q.shape[1], *map(len, highs)])
    q, high, low = _wide(q, dim), *(np.stack([np.pad(x, (0, dim - len(x))) for x in xs]) for xs in (highs, lows))
    exact = _doubles_do(q, np.concatenate([high, low]), scale=scale)
    q, high, low = (_terms(x, scale, exact) for x in (q, high, low))
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def best_of_shard(query_ids: np.ndarray, q: np.ndarray, blocks: list, k: int, scale: int, floors: list[int | None]) -> list[tuple[int, int, int]]:
    """(place of the query, id, score): for each query its k best of the blocks that reach its floor, a block at a time."""
    mats = [_matrix(b) for b in blocks]
    ids = [np.frombuffer(b.ids, np.int64) for b in blocks]
    bounds = bounds_of(q, [np.frombuffer(b.high) for b in blocks], [np.frombuffer(b.low) for b in blocks], scale)
    order = np.argsort(-bounds, axis=1, kind="stable")
    best: list[list[tuple[int, int]]] = [[] for _ in query_ids]  # (-score, id), the best first
    kth = list(floors)
    live = np.arange(len(query_ids))
    for turn in range(len(blocks)):
        live = np.array([w for w in live if kth[w] is None or bounds[w, order[w, turn]] >= kth[w]], np.int64)  # later bounds are no higher; at a tie a smaller id may enter
        if not len(live):
            break
        at = order[live, turn]
        for b in np.unique(at):
            who = live[at == b]
            got = products(q[who], mats[b], scale)
            for w, scores in zip(who, got, strict=True):
                other = ids[b] != query_ids[w]
                if kth[w] is not None:
                    other &= np.asarray(scores >= kth[w], bool)
                if other.any():
                    best[w] = sorted([*best[w], *((-int(s), int(i)) for s, i in zip(scores[other], ids[b][other], strict=True))])[:k]
                    if len(best[w]) == k:
                        kth[w] = -best[w][-1][0] if kth[w] is None else max(kth[w], -best[w][-1][0])
    return [(w, i, -s) for w, found in enumerate(best) for s, i in found]


def _saturated(score: int) -> int:
    return max(-(2**63), min(2**63 - 1, score))


def _beyond(score: int) -> str:
    """A text that orders scores beyond 64 bits as the scores are ordered; empty for others."""
    if -(2**63) < score < 2**63 - 1:
        return ""
    digits = str(abs(score))
    return f"1{len(digits):05d}{digits}" if score > 0 else f"0{99999 - len(digits):05d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


_SCORED = "g long, q int, query_id long, id long, score long, beyond string, exact string"


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank, id_col, score: the k best rows for each row of vectors where is_query holds."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), floored(F.col(vector_col), scale).alias("t"), is_query.alias("q")).where("id IS NOT NULL AND t IS NOT NULL")
    rows = stored(rows.withColumn("wide", F.exists("t", lambda v: F.abs(v) * F.lit(float(scale)) >= F.lit(WIDE))), "topk-rows")
    candidates = stored(blocked(rows.select("id", "t", "wide"), BLOCK_ROWS), "topk-blocks")
    groups = stored(blocked(rows.where("q").select("id", "t", "wide"), QUERY_ROWS).withColumnRenamed("block", "g").withColumn("floors", F.lit(None).cast("array<string>")), "topk-queries")
    n_blocks = candidates.count()
    if not n_blocks or not groups.count():
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    shards, parts = -(-n_blocks // BOUND_BLOCKS), max(1, n_blocks // SHARD_BLOCKS)
    bounds = candidates.select("block", "high", "low", F.pmod(F.hash("block"), F.lit(shards)).alias("s"))

    def limits(g, others: pd.DataFrame) -> np.ndarray:
        return bounds_of(_matrix(g), [np.frombuffer(x) for x in others.high], [np.frombuffer(x) for x in others.low], scale)

    def floors_of(g) -> list[int | None]:
        return [None] * g.rows if g.floors is None else [None if x is None else int(x) for x in g.floors]

    def greatest(g, others: pd.DataFrame) -> pd.DataFrame:
        at = np.argsort(-(found := limits(g, others)), axis=1, kind="stable")[:, :FIRST_BLOCKS]
        return pd.DataFrame({"g": g.g, "q": np.repeat(np.arange(g.rows, dtype=np.int32), at.shape[1]), "block": others.block.to_numpy()[at].ravel(), "bound": [float(max(-1e300, min(1e300, x))) for x in np.take_along_axis(found, at, 1).ravel()]})

    def reaching(g, others: pd.DataFrame) -> pd.DataFrame:
        found, floors = limits(g, others), [-np.inf if x is None else x for x in floors_of(g)]
        if found.dtype != object:  # bounds that doubles hold are under 2**53, where a larger floor is as good as any
            floors = [float(max(-1e300, min(1e300, x))) for x in floors]
        sent = (found >= np.array(floors, found.dtype)[:, None]).any(0)
        return pd.DataFrame({"g": g.g, "block": others.block.to_numpy()[sent.astype(bool)]})

    def meet(function, schema: str, left: DataFrame) -> DataFrame:
        """function(group, bounds) of each group and each shard of bounds."""
        def both(_: tuple, group: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
            others = others.sort_values("block")
            return pd.concat([function(g, others) for g in group.itertuples()])

        left = left.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        right = left.select(F.col("g").alias("to_g"), F.col("s").alias("to_s")).join(bounds.withColumnRenamed("s", "of"), F.col("to_s") == F.col("of"))
        return left.groupBy("g", "s").cogroup(right.groupBy("to_g", "to_s")).applyInPandas(both, schema)

    def scored(pairs: DataFrame, left: DataFrame) -> DataFrame:
        """The k best rows of each query in each part of the blocks that pairs (g, block) send to its group."""
        def score(_: tuple, group: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
            g = next(group.itertuples())
            ids = np.frombuffer(g.ids, np.int64)
            found = best_of_shard(ids, _matrix(g), list(blocks.sort_values("block").itertuples()), k, scale, floors_of(g))
            return pd.DataFrame([(g.g, q, int(ids[q]), i, _saturated(x), _beyond(x), str(x)) for q, i, x in found], columns=[c.split()[0] for c in _SCORED.split(", ")])

        sent = pairs.join(candidates, "block").withColumn("s", F.pmod(F.hash("block"), F.lit(parts)))
        heads = sent.select(F.col("g").alias("to_g"), F.col("s").alias("to_s")).distinct().join(left, F.col("to_g") == F.col("g"))
        return heads.groupBy("to_g", "to_s").cogroup(sent.groupBy("g", "s")).applyInPandas(score, _SCORED)

    def ranked(found: DataFrame, *of: str) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(W.partitionBy(*of).orderBy(F.desc("score"), F.desc("beyond"), "id"))).where(F.col("rank") <= k)

    first = meet(greatest, "g long, q int, block long, bound double", groups)
    by_bound = W.partitionBy("g", "q").orderBy(F.desc("bound"), "block")
    first = stored(first.withColumn("r", F.row_number().over(by_bound)).where(F.col("r") <= FIRST_BLOCKS).select("g", "block").distinct(), "topk-first")
    kth = ranked(scored(first, groups), "g", "q").where(F.col("rank") == k).select("g", "q", "exact")

    def with_floors(_: tuple, group: pd.DataFrame, those: pd.DataFrame) -> pd.DataFrame:
        known = dict(zip(those.q, those.exact, strict=True))
        return group.assign(floors=[[known.get(q) for q in range(g.rows)] for g in group.itertuples()])

    groups = stored(groups.groupBy("g").cogroup(kth.groupBy("g")).applyInPandas(with_floors, groups.schema), "topk-floors")
    sent = stored(meet(reaching, "g long, block long", groups), "topk-sent")
    # a query is known by its group and place: rows that repeat a query's id are queries of their own
    found = ranked(scored(sent, groups), "g", "q")
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score").distinct()
