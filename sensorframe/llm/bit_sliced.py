"""Exact top-k inner products on a bit-sliced index.

Whole-number vectors are cut into blocks of rows. In a block every attribute is
kept as bit slices: slice j of attribute d holds bit j of all rows as one bitmap,
after the attribute is shifted to start at zero and its low bits are dropped
(quantised). A query adds the slices of all attributes, each as often as the bits
of its weight say, with carry-save adders on whole bitmaps. The sum's slices are
walked from the most significant one down, which splits the rows into those
surely among the best and those at the boundary. As the dropped bits can change a
sum by a known amount at most, all rows within that amount of the k-th best form
the boundary; their scores are computed exactly from the whole vectors. So the
result is exact, ties included, for any quantisation.

Every block of rows meets every chunk of the stated query set in an equi-join on
(block, chunk); a block gives its k best, and those are ranked per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorframe.llm.common import stored

#: Values beyond are saturated, so that sums over up to 128 attributes fit 64 bits.
LARGEST = 1 << 28


def fixed_point(vector: str = "embedding", scale: int = 1024) -> Column:
    """floor(scale * x) of every component, as bigint; saturated at +-2^28."""
    return F.transform(F.col(vector), lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(
        F.lit(float(LARGEST)), x.cast("double") * scale))).cast("bigint"))


def usable(vector: str = "embedding") -> Column:
    """Not null and all components finite numbers."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def pack_bits(rows: np.ndarray) -> np.ndarray:
    """Booleans (n) as 64-bit words, padded with zeros."""
    padded = np.zeros(-(-len(rows) // 64) * 64, bool)
    padded[:len(rows)] = rows
    return np.packbits(padded, bitorder="little").view(np.uint64)


class Slices:
    """Bit slices of a block (rows x attributes), ``keep`` leading bits of each attribute.

    ``maps[d, j]`` is the bitmap of bit j of attribute d, counted from the lowest kept bit.
    """

    def __init__(self, values: np.ndarray, bits: np.ndarray, drop: np.ndarray, maps: np.ndarray):
        self.values, self.bits, self.drop, self.maps = values, bits, drop, maps
        self.n = len(values)

    @classmethod
    def build(cls, values: np.ndarray, keep: int = 5) -> Slices:
        low, high = values.min(axis=0), values.max(axis=0)
        span = np.array([int(h - w).bit_length() for h, w in zip(high, low)], np.int64)
        drop = np.maximum(span - keep, 0)
        shifted = (values - low) >> drop
        maps = np.array([[pack_bits((column >> j) & 1 > 0) for j in range(keep)] for column in shifted.T])
        return cls(values, np.minimum(span, keep), drop, maps)

    def sums(self, weights: np.ndarray) -> tuple[list[np.ndarray], int, int]:
        """Slices of all rows' quantised sums, the place of the lowest, and the error bound.

        A negative weight adds the complement of a slice instead, which differs by
        the same constant for all rows. Two rows whose sums differ by more than
        the bound are in the right order.
        """
        places: dict[int, list[np.ndarray]] = {}
        bound = 0
        for d, w in enumerate(weights.tolist()):
            size, cut = abs(w), int(self.drop[d])
            bound += size * ((1 << cut) - 1)
            for j in range(int(self.bits[d])):
                bits = self.maps[d, j] if w > 0 else ~self.maps[d, j]
                for p in range(size.bit_length()):
                    if size >> p & 1:
                        places.setdefault(p + j + cut, []).append(bits)
        if not places:
            return [], 0, bound
        out, at, base = [], min(places), min(places)
        while at <= max(places):
            column = places.pop(at, [])
            while len(column) > 1:  # full and half adders until one bitmap is left at this place
                a, b = column.pop(), column.pop()
                half, carry = a ^ b, a & b
                if column:
                    c = column.pop()
                    carry |= half & c
                    half ^= c
                column.append(half)
                places.setdefault(at + 1, []).append(carry)
            out.append(column[0] if column else np.zeros(self.maps.shape[2], np.uint64))
            at += 1
            if not places:
                break
        return out, base, bound

    def candidates(self, weights: np.ndarray, k: int) -> np.ndarray:
        """Row numbers among which the k best are sure to be."""
        slices, base, bound = self.sums(weights)
        if not slices or self.n <= k:
            return np.arange(self.n)
        every = pack_bits(np.ones(self.n, bool))
        sure, alive, kth = np.zeros_like(every), every, 0
        for i in reversed(range(len(slices))):  # the k-th largest sum, from the top slice down
            ones = alive & slices[i]
            if int(np.bitwise_count(sure | ones).sum()) >= k:
                alive, kth = ones, kth | 1 << i
            else:
                sure, alive = sure | ones, alive & ~slices[i]
        # all rows with a sum of at least kth - bound, again from the top slice down
        least = max(0, -((bound - (kth << base)) >> base))
        above, equal = np.zeros_like(every), every
        for i in reversed(range(len(slices))):
            if least >> i & 1:
                equal = equal & slices[i]
            else:
                above, equal = above | (equal & slices[i]), equal & ~slices[i]
        return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little")[:self.n])

    def best(self, weights: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows, ties to smaller ids, without rows of id ``own``."""
        at = self.candidates(weights, k + int((ids == own).sum()))
        at = at[ids[at] != own]
        score = self.values[at].astype(np.int64) @ weights
        order = np.lexsort((ids[at], -score))[:k]
        return ids[at][order], score[order]


INDEX = "block int, dims int, n int, ids binary, width int, numbers binary, bits binary, dropped binary, maps binary"


def _parts(batches, *columns):
    """All rows of a task, as one array per column and vector length (tasks are made small before)."""
    rows = pd.concat([b[list(columns)] for b in batches] or [pd.DataFrame(columns=columns)], ignore_index=True)
    if len(rows):
        for dims, part in rows.groupby(rows[columns[-1]].map(len)):
            yield int(dims), *[part[c].to_numpy() for c in columns[:-1]], np.stack(part[columns[-1]].to_numpy())


def build_index(vectors: DataFrame, rows_per_block: int = 16384, keep: int = 5) -> DataFrame:
    """The index of ``vectors`` (``vec_id``, ``v``: whole numbers): one row per block and vector length.

    Every row is indexed. Rows are dealt evenly, so equal ids or vectors do not gather.
    """
    blocks = max(1, -(-vectors.count() // rows_per_block))

    def run(batches):
        for dims, ids, values in _parts(batches, "vec_id", "v"):
            s = Slices.build(values.reshape(-1, dims), keep)
            small = values.astype(next(t for t in ("i1", "i2", "i4") if np.abs(values).max(initial=0) < 1 << (8 * int(t[1]) - 1)))
            yield pd.DataFrame([[TaskContext.get().partitionId(), dims, len(ids), ids.astype("<i8").tobytes(), small.itemsize,
                                 small.tobytes(), s.bits.astype("<i8").tobytes(), s.drop.astype("<i8").tobytes(), s.maps.tobytes()]],
                               columns=[c.split()[0] for c in INDEX.split(", ")])

    return stored(vectors.where("size(v) > 0").repartition(blocks).mapInPandas(run, INDEX), "slices")


def _opened(r) -> tuple[Slices, np.ndarray]:
    bits, drop = np.frombuffer(r.bits, "<i8"), np.frombuffer(r.dropped, "<i8")
    values = np.frombuffer(r.numbers, f"<i{r.width}").reshape(r.n, r.dims)
    maps = np.frombuffer(r.maps, np.uint64).reshape(r.dims, -1, -(-r.n // 64))
    return Slices(values, bits, drop, maps), np.frombuffer(r.ids, "<i8")


def search(index: DataFrame, queries: DataFrame, k: int = 10, queries_per_chunk: int = 128) -> DataFrame:
    """The k best rows of the index for every query (``query_id``, ``w``: whole numbers).

    Returned: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``; ties to the
    smaller vec_id. Rows with the query's own id are left out; only vectors of
    the query's length are candidates. Repeated query rows count once.
    """
    chunks = max(1, -(-queries.count() // queries_per_chunk))

    def gather(batches):
        for dims, ids, w in _parts(batches, "query_id", "w"):
            yield pd.DataFrame({"chunk": [TaskContext.get().partitionId()], "dims": [dims], "query_ids": [ids.astype("<i8").tobytes()],
                                "weights": [w.astype("<i8").tobytes()]})

    packed = stored(queries.where("size(w) > 0").select("query_id", "w").distinct().repartition(chunks).mapInPandas(
        gather, "chunk int, dims int, query_ids binary, weights binary"), "chunks")
    blocks = (index.agg(F.max("block")).first()[0] or 0) + 1
    left = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                s, ids = _opened(r)
                own = np.frombuffer(r.query_ids, "<i8")
                out = [s.best(w, ids, int(q), k) for q, w in zip(own, np.frombuffer(r.weights, "<i8").reshape(len(own), -1))]
                n = [len(i) for i, _ in out]
                yield pd.DataFrame({"chunk": r.chunk, "slot": np.repeat(np.arange(len(own)), n), "query_id": np.repeat(own, n),
                                    "vec_id": np.concatenate([i for i, _ in out]), "score": np.concatenate([x for _, x in out])})

    found = left.join(right, ["block", "chunk", "dims"]).mapInPandas(
        run, "chunk int, slot int, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "chunk", "slot").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def whole_numbers(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """``vec_id``, ``v`` of rows that take part: an id and a vector of finite numbers."""
    return vectors.where(F.col("vec_id").isNotNull() & usable()).select("vec_id", fixed_point(scale=scale).alias("v"))
