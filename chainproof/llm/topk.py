"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

A vector is a sparse row: its non-zero components are (term, weight) pairs, and a block of
candidates is an inverted index with one posting list for each term. The query rows of a block
are taken term by term, and each weight is scattered, times the posting list, into one dense
score array per query. A partition selection (``argpartition``) keeps the block's best, and a
window merges the blocks.

Queries and candidates are dealt into a grid of (query block, candidate block) cells of bounded
size; every cell is one independent group, so neither side is ever broadcast or gathered whole.

All sums are exact. Rows whose products could leave 64 bits in a sum are told by their largest
component; their scores are summed as Python integers, those of all other pairs in arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chainproof.llm.common import written

#: The longs, and bytes that hold any score of vectors of doubles with its sign.
_LEAST, _MOST, _BYTES = -(1 << 63), (1 << 63) - 1, 272


def quantised(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component, a whole number in double; null for a vector that is null
    or holds a null or non-finite component, or one whose product is not finite."""
    y = lambda x: F.lit(float(scale)) * x.cast("double")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(y(x)) == float("inf")))
    # doubles of 2^53 or more are whole numbers
    whole = F.transform(vector, lambda x: F.when(F.abs(y(x)) < float(1 << 53), F.floor(y(x)).cast("double")).otherwise(y(x)))
    return F.when(vector.isNotNull() & ~bad, whole)


def _lists(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the non-zero components of an array of lists."""
    sizes = np.diff(np.asarray(a.offsets))
    values = np.asarray(a.flatten(), dtype=np.float64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    terms = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    on = values != 0
    return rows[on], terms[on], values[on]


def _wide(v: tuple, n: int, most: int) -> np.ndarray:
    """Which of ``n`` rows have a component over ``most``."""
    out = np.zeros(n, bool)
    out[v[0][np.abs(v[2]) > most]] = True
    return out


def _without(v: tuple, rows: np.ndarray) -> tuple:
    """The vectors with ``rows`` (a mask) emptied, in 64 bits."""
    on = ~rows[v[0]]
    return v[0][on], v[1][on], v[2][on].astype(np.int64)


def _exact(v: tuple, row: int) -> dict[int, int]:
    on = v[0] == row
    return dict(zip(v[1][on].tolist(), map(int, v[2][on].tolist()), strict=True))


def _product(a: dict[int, int], b: dict[int, int]) -> int:
    return sum(w * b[t] for t, w in a.items() if t in b)


def scores(q: tuple, n_q: int, c: tuple, n_c: int) -> np.ndarray:
    """Inner products of ``n_q`` query rows and ``n_c`` candidates, both given as (row, term,
    weight): term at a time, into a dense (n_q, n_c) array."""
    out = np.zeros((n_q, n_c), dtype=np.int64)
    if not len(q[0]) or not len(c[0]):
        return out
    n_terms = int(max(q[1].max(), c[1].max())) + 1
    bound = int(np.abs(q[2]).max()) * int(np.abs(c[2]).max()) * n_terms
    if bound < 1 << 31:  # sums cannot leave 32 bits: half the memory traffic
        out = out.astype(np.int32)
    q_order, c_order = np.argsort(q[1], kind="stable"), np.argsort(c[1], kind="stable")
    q_cut = np.searchsorted(q[1][q_order], np.arange(n_terms + 1))
    c_cut = np.searchsorted(c[1][c_order], np.arange(n_terms + 1))
    for t in range(n_terms):
        qs, cs = q_order[q_cut[t] : q_cut[t + 1]], c_order[c_cut[t] : c_cut[t + 1]]
        if not len(qs) or not len(cs):
            continue
        weights = q[2][qs].astype(out.dtype)
        if 4 * len(cs) >= n_c:  # a long posting list is scattered as a dense column
            posting = np.zeros(n_c, dtype=out.dtype)
            posting[c[0][cs]] = c[2][cs]
            for row, w in zip(q[0][qs], weights, strict=True):
                out[row] += w * posting
        else:
            at, posting = c[0][cs], c[2][cs].astype(out.dtype)
            for row, w in zip(q[0][qs], weights, strict=True):
                out[row, at] += w * posting
    return out


def _best(k: int):
    """For one cell of the grid: each query's k best candidates of the cell."""
    names = ["query_id", "twin", "copies", "vec_id", "score", "more"]
    kinds = [pa.int64()] * 5 + [pa.binary()]

    def cell(t: pa.Table) -> pa.Table:
        is_q = np.asarray(t["is_query"].combine_chunks().cast(pa.int8())).astype(bool)
        ids, twins, copies = (np.asarray(t[n].combine_chunks()) for n in ("id", "twin", "copies"))
        order = np.flatnonzero(~is_q)[np.argsort(ids[~is_q], kind="stable")]  # ties go to the smaller id
        qi, ci, q_twin, c_twin, many = ids[is_q], ids[order], twins[is_q], twins[order], copies[order]
        got: list[tuple] = []
        if len(qi) and len(ci):
            vectors = t["v"].combine_chunks()
            q, c = _lists(vectors.filter(pa.array(is_q))), _lists(vectors.take(pa.array(order)))
            n_terms = 1 + max(0, *(int(x[1].max()) for x in (q, c) if len(x[1])))
            most = math.isqrt(_MOST // n_terms)
            q_wide, c_wide = _wide(q, len(qi), most), _wide(c, len(ci), most)
            wide = [(int(j), _exact(c, j)) for j in np.flatnonzero(c_wide)]
            every = [_exact(c, j) for j in range(len(ci))] if q_wide.any() else []
            q_small, c_small = _without(q, q_wide), _without(c, c_wide)
            step = max(1, (1 << 21) // len(ci))
            for at in range(0, len(qi), step):
                part = slice(*np.searchsorted(q_small[0], [at, at + step]))
                dense = scores((q_small[0][part] - at, q_small[1][part], q_small[2][part]), len(qi[at : at + step]), c_small, len(ci))
                for i, row in enumerate(dense, at):
                    left = many.copy()
                    left[(ci == qi[i]) & (c_twin == q_twin[i])] -= 1  # the query's own row
                    others = np.flatnonzero(left)
                    if not len(others):
                        continue
                    if wide or q_wide[i]:
                        own = _exact(q, i)
                        exact = [_product(own, x) for x in every] if q_wide[i] else row.tolist()
                        for j, x in () if q_wide[i] else wide:
                            exact[j] = _product(own, x)
                        top = np.array(sorted(others.tolist(), key=lambda j: (-exact[j], j))[:k])
                    else:
                        row = row[others]
                        m = max(0, len(others) - k)
                        top = np.flatnonzero(row >= np.partition(row, m)[m])  # all ties of the k-th best
                        top = others[top[np.argsort(-row[top].astype(np.int64), kind="stable")][:k]]
                        exact = dense[i - at]
                    for j in np.repeat(top, np.minimum(left[top], k))[:k].tolist():
                        s = int(exact[j])
                        more = b"" if _LEAST < s < _MOST else (s + (1 << 8 * _BYTES - 1)).to_bytes(_BYTES, "big")
                        got.append((int(qi[i]), int(q_twin[i]), i, int(ci[j]), min(max(s, _LEAST), _MOST), more))
        q_copies = copies[is_q]
        columns = [list(x) for x in zip(*got, strict=True)] if got else [[] for _ in names]
        columns[2] = q_copies[np.array(columns[2], np.int64)]
        return pa.table([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=names)

    return cell


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, *, query_block: int = 4096, candidate_block: int = 8192) -> DataFrame:
    """Each query row's ``k`` highest integer inner products among ``candidates``, without the row
    itself (one of the query's id and vector): query_id, rank (int, from 1), vec_id, score (long).

    Both frames have ``id`` (long) and ``v`` (array of whole numbers in double; shorter vectors count as
    ending in zeros). Rows with a null id or a null vector take no part. Ties go to the smaller id. A
    repeated row counts each time, as candidate and as query; rows that share an id have results of
    their own. All are returned where there are fewer than ``k``. A score that no long holds is given
    as the nearest long, at its exact rank. Empty sides give an empty result; other columns are ignored.
    """
    def distinct(df: DataFrame) -> DataFrame:  # repeated rows meet before they are dealt out
        rows = df.where("id is not null and v is not null").groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies"))
        return written(rows.withColumn("twin", F.xxhash64("v")), "vectors")

    q, c = distinct(queries), distinct(candidates)
    n_q, n_c = (x.agg(F.count(F.lit(1))).first()[0] for x in (q.select("id"), c.select("id")))
    rows, columns = max(1, -(-n_q // query_block)), max(1, -(-n_c // candidate_block))
    deal = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "id", "twin"), F.lit(n)).cast("int")
    own = ["id", "v", "copies", "twin"]
    q = q.select(*own, F.lit(True).alias("is_query"), deal(rows, 1).alias("gq"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("gc"))
    c = c.select(*own, F.lit(False).alias("is_query"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("gq"), deal(columns, 2).alias("gc"))
    cells = q.unionByName(c).repartition(max(1, min(rows * columns, 200_000)), "gq", "gc").groupBy("gq", "gc")
    best = cells.applyInArrow(_best(k), "query_id long, twin long, copies long, vec_id long, score long, more binary")
    order = W.partitionBy("query_id", "twin").orderBy(F.desc("score"), F.desc("more"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("query_id", "rank", "vec_id", "score")
