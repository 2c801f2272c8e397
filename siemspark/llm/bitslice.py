"""Exact top-k inner products over a bit-sliced index.

Components are quantised to integers.  An index block holds, per attribute, one
bitmap for each binary digit of its values above the block's minimum.  A query
adds the bitmaps of all attributes, shifted by the digits of its own component
(complemented where that is negative), with carry-save adders over whole bitmaps:
the sums of all rows of the block appear as bitmaps again.  Rows are selected
from the most significant sum slice downward; those that tie at the last place
are resolved exactly, smaller id first.

Queries meet the index in units: one block of the index and one part of the queries,
both of bounded size, each sent once a unit, with components of as few bytes as they
need.  Every unit returns the ``k`` best rows per query, of which the best ``k`` stay.

Defined results: rows with null id, null vector, or a null or non-finite component
take no part.  Identical rows count once.  A query never returns rows of its own
id.  Shorter vectors are compared as if zeros followed.  With fewer than ``k``
candidates all are returned.  Scores must fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siemspark.llm.common import stage

# Components and rows of an index block and of a part of the queries, whatever the length of vectors.
BLOCK_CELLS, BLOCK_ROWS = 1 << 20, 16_384
QUERY_CELLS, QUERY_ROWS = 1 << 18, 4_096
LEAST_BLOCKS, LEAST_PARTS = 12, 4
MOST_TASKS = 2_000


class Slices:
    """The bit slices of one block of rows, in ascending id order."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.n = ids, len(ids)
        self.least = values.min(axis=0)
        above = (values - self.least).astype(np.uint64)
        self.digits = max(1, int(above.max()).bit_length()) if above.size else 1
        words = -(-self.n // 64)
        bits = np.zeros((values.shape[1], words * 64), np.uint8)
        self.maps = np.empty((values.shape[1], self.digits, words), np.uint64)
        for b in range(self.digits):
            bits[:, :self.n] = (above >> np.uint64(b) & np.uint64(1)).T
            self.maps[:, b] = np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)
        self.all = np.packbits(np.arange(words * 64) < self.n, bitorder="little").view(np.uint64)

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of all rows' sums, least significant first, and what must be added to them."""
        query = query[:len(self.least)]
        weight = np.abs(query)
        negative = query < 0
        top = (1 << self.digits) - 1
        base = int((query * self.least[:len(query)]).sum()) - int(weight[negative].sum()) * top
        columns: dict[int, list[np.ndarray]] = {}
        flip = np.where(negative, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None, None]
        for a in range(int(weight.max()).bit_length() if len(weight) else 0):
            rows = np.flatnonzero(weight >> a & 1)
            if not len(rows):
                continue
            picked = self.maps[rows] ^ flip[rows]
            for b in range(self.digits):
                columns.setdefault(a + b, []).append(picked[:, b])
        out, at = [], 0
        while columns:
            parts = columns.pop(at, None)
            if parts is None:
                out.append(np.zeros_like(self.all))
                at += 1
                continue
            grid, carries = np.concatenate(parts), []
            while len(grid) > 1:
                if len(grid) == 2:
                    carries.append((grid[0] & grid[1])[None])
                    grid = (grid[0] ^ grid[1])[None]
                    break
                t = len(grid) // 3
                x, y, z = grid[:t], grid[t:2 * t], grid[2 * t:3 * t]
                half = x ^ y
                carries.append(x & y | half & z)
                grid = np.concatenate([half ^ z, grid[3 * t:]])
            if carries:
                columns.setdefault(at + 1, []).extend(carries)
            out.append(grid[0])
            at += 1
        return out, base

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best rows whose id is not ``own``.

        More rows where some of these have the same id and score.
        """
        sums, base = self.sums(query)
        wanted = k
        while True:
            ids, score = self._best(sums, base, own, wanted)
            if len(ids) < wanted or len(set(zip(ids.tolist(), score.tolist(), strict=True))) >= k:
                return ids, score
            wanted *= 2

    def _best(self, sums: list[np.ndarray], base: int, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        sure, tied = np.zeros_like(self.all), self.all.copy()
        for i in range(*np.searchsorted(self.ids, [own, own + 1])):
            tied[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        for level in reversed(sums):
            better = sure | tied & level
            count = int(np.bitwise_count(better).sum())
            if count > k:
                tied &= level
            else:
                sure = better
                tied &= ~level
                if count == k:
                    break
        chosen = self._rows(sure)
        chosen = np.concatenate([chosen, self._rows(tied)[:max(0, k - len(chosen))]])
        score = np.full(len(chosen), base, np.int64)
        word, bit = chosen >> 6, (chosen & 63).astype(np.uint64)
        for i, level in enumerate(sums):
            score += (level[word] >> bit & np.uint64(1)).astype(np.int64) << i
        return self.ids[chosen], score

    @staticmethod
    def _rows(bitmap: np.ndarray) -> np.ndarray:
        words = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        word, bit = np.nonzero(bits)
        return words[word] * 64 + bit


def packed(values: np.ndarray) -> tuple[int, bytes]:
    """Bytes per component, as few as all of them fit, and the components."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -1 << 8 * w - 1 <= low and high < 1 << 8 * w - 1)
    return width, values.astype(f"<i{width}").tobytes()


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and components of the one row of a packed block or part."""
    ids = np.frombuffer(table["ids"][0].as_py(), np.int64)
    data = np.frombuffer(table["data"][0].as_py(), f"<i{table['width'][0].as_py()}")
    return ids, data.reshape(len(ids), -1).astype(np.int64)


def _pack(key: str):
    """One row per group: ids and quantised components as bytes."""

    def run(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        rows = table["values"].combine_chunks()
        sizes = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values = np.zeros((len(sizes), sizes.max()), np.int64)
        values[np.arange(values.shape[1]) < sizes[:, None]] = rows.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        width, data = packed(values[order])
        return pa.table({key: table[key][:1], "ids": [ids[order].tobytes()], "width": pa.array([width], pa.int32()),
                         "data": [data]})

    return run


def _search(k: int):
    def run(block: pa.Table, part: pa.Table) -> pa.Table:
        asked, scores, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if block.num_rows and part.num_rows:
            index = Slices(*unpacked(block))
            for own, query in zip(*unpacked(part), strict=True):
                found, score = index.top(query, int(own), k)
                asked.append(np.full(len(found), own))
                ids.append(found)
                scores.append(score)
        return pa.table({"query_id": np.concatenate(asked), "vec_id": np.concatenate(ids), "score": np.concatenate(scores)})

    return run


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, values) of the rows that take part, each once."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
            .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable)
            .select("vec_id", F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).alias("values")).distinct())


def _groups(rows: DataFrame, most_rows: int, most_cells: int, least: int) -> int:
    """How many groups of bounded size ``rows`` are dealt into."""
    n, longest = rows.agg(F.count("*"), F.max(F.size("values"))).first()
    return max(least, -(-n // max(1, min(most_rows, most_cells // max(1, longest or 0)))))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for (vec_id, values) rows of ``queries`` against all of ``vectors``."""
    vectors, queries = stage(vectors, "vectors"), stage(queries, "queries")
    blocks = _groups(vectors, BLOCK_ROWS, BLOCK_CELLS, LEAST_BLOCKS)
    parts = _groups(queries, QUERY_ROWS, QUERY_CELLS, LEAST_PARTS)
    tasks = min(blocks * parts, MOST_TASKS)

    def units(rows: DataFrame, own: str, n: int, other: str, others: int) -> DataFrame:
        """Rows dealt into ``n`` packed groups, each sent to all ``others`` of the other side."""
        dealt = rows.withColumn(own, F.pmod(F.xxhash64("vec_id", "values"), F.lit(n)).cast("int"))
        groups = dealt.groupBy(own).applyInArrow(_pack(own), f"{own} int, ids binary, width int, data binary")
        return (groups.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
                .repartition(tasks, "block", "part"))

    index, asked = units(vectors, "block", blocks, "part", parts), units(queries, "part", parts, "block", blocks)
    found = (index.groupBy("block", "part").cogroup(asked.groupBy("block", "part"))
             .applyInArrow(_search(k), "query_id long, vec_id long, score long").distinct())
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
