"""Exact vector search: the best chunk of each decision for many queries, with filters, over-fetching and fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from terazi.session import materialize

OVERFETCH = 5
#: query vectors are held by every task up to so many bytes, else blocks of about that size meet blocks of so many rows
BROADCAST_BYTES, BLOCK_ROWS = 64 << 20, 200_000
#: rows scored at a time
SHOWN_ROWS = 2000


def metadata_filter(source: str | None = None, year: int | None = None) -> Column:
    """Condition on source and least year; what isn't given doesn't restrict. It reaches the file scan."""
    given = [F.col("source") == source] if source is not None else []
    given += [F.col("year") >= year] if year is not None else []
    out = F.lit(True)
    for g in given:
        out = out & g
    return out


class Best:
    """The k best rows, or groups by their best row, of each query among the rows shown so far; equals of the last are kept."""

    def __init__(self, names: pa.Array, vectors: np.ndarray, k: int, grouped: bool):
        self.names, self.vectors, self.k, self.grouped = names, vectors, k, grouped
        self.least = np.full(len(vectors), -np.inf)
        self.codes: dict = {}
        self.rows: list[pa.RecordBatch] = []
        self.q, self.s, self.g, self.r = (np.empty(0, t) for t in (np.int64, np.float64, np.int64, np.int64))
        self.shown = 0

    def show(self, matrix: np.ndarray, rows: pa.RecordBatch, groups: list | None) -> None:
        """Score rows (a matrix and their other columns) and keep what may be among the best."""
        scores = np.round(self.vectors @ matrix.T, 9)
        kept = min(self.k, scores.shape[1])
        if not self.grouped:
            self.least = np.maximum(self.least, -np.partition(-scores, kept - 1, axis=1)[:, kept - 1] if kept == self.k else -np.inf)
        q, r = np.nonzero(scores >= self.least[:, None])
        g = r + self.shown
        if self.grouped:
            g = np.array([self.codes.setdefault(x, len(self.codes)) for x in groups], np.int64)[r]
        used, at = np.unique(r, return_inverse=True)
        base = sum(b.num_rows for b in self.rows)
        self.rows.append(rows.take(pa.array(used)))
        self.q, self.s, self.g, self.r = (np.concatenate(x) for x in ((self.q, q), (self.s, scores[q, r]), (self.g, g), (self.r, at + base)))
        self.shown += len(matrix)
        if len(self.q) > 4 * len(self.vectors) * self.k + 1_000_000:
            self.prune()

    def prune(self) -> None:
        """Drop what is worse than another row of its group, or than the k-th best."""
        order = np.lexsort((-self.s, self.g, self.q))
        q, s, g, r = (x[order] for x in (self.q, self.s, self.g, self.r))
        if self.grouped:  # the best of each group with its equals
            fresh = np.ones(len(q), bool)
            fresh[1:] = (q[1:] != q[:-1]) | (g[1:] != g[:-1])
            top = s[np.maximum.accumulate(np.where(fresh, np.arange(len(q)), 0))]
            q, s, g, r, fresh = (x[s == top] for x in (q, s, g, r, fresh))
        else:
            fresh = np.ones(len(q), bool)
        order = np.lexsort((-s, q))
        q, s, g, r, fresh = (x[order] for x in (q, s, g, r, fresh))
        # how many groups of the query stand before and at each place
        seen = np.cumsum(fresh)
        begins = np.searchsorted(q, np.arange(len(self.vectors)))
        inside = seen - (seen[np.minimum(begins, max(len(q) - 1, 0))] - fresh[np.minimum(begins, max(len(q) - 1, 0))])[q] if len(q) else seen
        kth = (inside == self.k) & fresh
        self.least[q[kth]] = np.maximum(self.least[q[kth]], s[kth])
        stay = s >= self.least[q]
        self.q, self.s, self.g, self.r = q[stay], s[stay], g[stay], r[stay]
        if self.rows:
            used, self.r = np.unique(self.r, return_inverse=True)
            self.rows = [pa.Table.from_batches(self.rows).take(pa.array(used)).combine_chunks().to_batches()[0]] if len(used) else []

    def result(self, names: list[str]) -> pa.RecordBatch | None:
        self.prune()
        if not self.rows:
            return None
        rows = self.rows[0].take(pa.array(self.r))
        return pa.RecordBatch.from_arrays([self.names.take(pa.array(self.q)), pa.array(self.s), *rows.columns], names)


def _matrix(vectors: pa.Array, rows: int) -> np.ndarray:
    return np.array(vectors.flatten(), np.float64).reshape(rows, -1)


def _broadcast_scores(queries: DataFrame, rows: DataFrame, k: int, at: int | None, schema: str, names: list[str]) -> DataFrame:
    """Candidates of all queries, which every task holds: one pass over the rows, the best of each partition come out."""
    found = queries.toArrow().combine_chunks()
    shared = rows.sparkSession.sparkContext.broadcast((found.column(0).combine_chunks(), _matrix(found.column(1).combine_chunks(), found.num_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(*shared.value, k, at is not None)
        for batch in batches:
            for i in range(0, batch.num_rows, SHOWN_ROWS):
                part = batch.slice(i, SHOWN_ROWS)
                best.show(_matrix(part.column(part.num_columns - 1), part.num_rows), part.select(names[2:]), None if at is None else part.column(at).to_pylist())
        if (out := best.result(names)) is not None:
            yield out

    return rows.mapInArrow(run, schema)


def _blocked_scores(queries: DataFrame, rows: DataFrame, k: int, at: int | None, schema: str, names: list[str], query_blocks: int) -> DataFrame:
    """Candidates by pairs of blocks: each block of queries meets each block of rows in a task of its own."""
    row_blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    key, row = queries.columns[0], names[2]
    q = queries.select("*", F.pmod(F.xxhash64(key), F.lit(query_blocks)).alias("_qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))).alias("_rb"))
    r = rows.select("*", F.pmod(F.xxhash64(row), F.lit(row_blocks)).alias("_rb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("_qb"))

    def run(asked: pa.Table, block: pa.Table) -> pa.Table:
        out = None
        if asked.num_rows and block.num_rows:
            asked, block = asked.combine_chunks(), block.combine_chunks()
            best = Best(asked.column(key).combine_chunks(), _matrix(asked.column(vector).combine_chunks(), asked.num_rows), k, at is not None)
            for part in block.to_batches(max_chunksize=SHOWN_ROWS):
                best.show(_matrix(part.column(vector), part.num_rows), part.select(names[2:]), None if at is None else part.column(names[2 + at]).to_pylist())
            out = best.result(names)
        return pa.Table.from_batches([out]) if out is not None else empty

    vector = rows.columns[-1]
    kinds = [to_arrow_type(f.dataType) for f in T._parse_datatype_string(schema).fields]
    empty = pa.table([pa.array([], t) for t in kinds], names=names)
    return q.groupBy("_qb", "_rb").cogroup(r.groupBy("_qb", "_rb")).applyInArrow(run, schema)


def search(queries: DataFrame, rows: DataFrame, k: int, query_key: str = "query", vector: str = "embedding", group: str | None = None, extra: tuple[str, ...] = (), row_key: str = "id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The k nearest rows (or groups, by their best row) of every query, by dot product: query, rank, score and the row's columns.

    Queries of at most broadcast_bytes are held by every task, and each partition of rows gives its k best per query in one
    pass. If there are more, blocks of queries meet blocks of rows in tasks of their own, each of bounded size. What is
    shuffled then is keys and scores, k per query and partition or block, and equals of the last; ranks follow from (score
    desc, group, row). Rows and queries without a vector are left out; vectors must be of one length. Texts needn't travel
    through the search: join them to the winners.
    """
    cols = list(dict.fromkeys([row_key, *([group] if group else []), *extra]))
    kinds, qkind = dict(rows.dtypes), dict(queries.dtypes)[query_key]
    schema = f"{query_key} {qkind}, score double, " + ", ".join(f"{c} {kinds[c]}" for c in cols)
    names, at = [query_key, "score", *cols], cols.index(group) if group else None
    source = rows.filter(F.col(vector).isNotNull()).select(*cols, vector)
    asked = materialize(queries.filter(F.col(vector).isNotNull()).select(query_key, vector), "queries")
    size = asked.agg(F.coalesce(F.sum(F.size(vector)), F.lit(0))).first()[0] * 8
    if size == 0:
        found = rows.sparkSession.createDataFrame([], schema)
    elif size <= broadcast_bytes:
        found = _broadcast_scores(asked, source, k, at, schema, names)
    else:
        found = _blocked_scores(asked, source, k, at, schema, names, -(-size // max(1, broadcast_bytes)))
    if group:
        best = W.partitionBy(query_key, group).orderBy(F.col("score").desc(), row_key)
        found = found.withColumn("_b", F.row_number().over(best)).filter("_b = 1").drop("_b")
    order = W.partitionBy(query_key).orderBy(F.col("score").desc(), group or row_key, row_key)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(query_key, "rank", "score", *cols)


def overfetched(queries: DataFrame, rows: DataFrame, k: int, group: str, factor: int = OVERFETCH, **more) -> DataFrame:
    """Best k * factor rows of each query, then the best row of each group, then k of these: there may be fewer than k."""
    key, row = more.get("query_key", "query"), more.get("row_key", "id")
    near = search(queries, rows, k * factor, extra=(group, *more.pop("extra", ())), **more)
    first = near.withColumn("_b", F.row_number().over(W.partitionBy(key, group).orderBy("rank"))).filter("_b = 1").drop("_b", "rank")
    return first.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.col("score").desc(), row))).filter(F.col("rank") <= k)


def fused(scores: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """scores with the greater of both scores wherever the other table has one for the key."""
    best = other.groupBy(*key).agg(F.max("score").alias("_other"))
    return scores.join(best, key, "left").withColumn("score", F.greatest("score", "_other")).drop("_other")


def index_recall(found: DataFrame, exact: DataFrame, query_key: str = "query", row_key: str = "id") -> DataFrame:
    """One row: the share of exact neighbours that were found."""
    hit = exact.join(found.select(query_key, row_key).withColumn("hit", F.lit(1)), [query_key, row_key], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
