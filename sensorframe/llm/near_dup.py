"""Near-duplicate documents by b-bit MinHash, with every link confirmed on full sets.

1. Each text becomes its set of 5-word shingles (64-bit hashes), 128 minima of
   which the low 4 bits (after mixing) are kept and packed into 64 bytes, and 32
   band keys of 4 whole minima each. Two sets of similarity 0.75 share no band
   with a probability of 5e-6.
2. Documents with equal sets are one class, named by its smallest doc_id.
3. Classes in one band bucket are compared by bit counts: the share of equal
   4-bit fields, less the 1/16 that agree by chance, estimates the similarity.
   Pairs above ``LOOSE`` (four standard errors below 0.75) hang together; of
   those only a spanning forest leaves the bucket. Large buckets are cut into
   blocks that meet pairwise.
4. The connected pieces are coarse clusters. Their texts travel once; inside a
   cluster (cut into blocks, if large) the full sets are compared exactly, and
   the confirmed links give the components.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sensorframe.llm.common import map_rows, stored, utf8_of
from sensorframe.llm.graph import components
from sensorframe.operators.grouped import map_groups

SHINGLE, HASHES, ROWS, BITS = 5, 128, 4, 4
BANDS = HASHES // ROWS
#: Estimates of pairs of similarity 0.75 have a standard error of 0.041.
LOOSE = 0.586
#: Members of a bucket, and members or shingles of a cluster, that one task compares.
BUCKET_BLOCK, CLUSTER_BLOCK, CLUSTER_SHINGLES = 2048, 2048, 4_000_000
#: Words remembered per worker.
REMEMBER = 100_000

_draw = np.random.Generator(np.random.PCG64(7))
_MULTIPLY = _draw.integers(1 << 32, size=HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _draw.integers(1 << 32, size=HASHES, dtype=np.uint64).astype(np.uint32)
_PLACE = _draw.integers(1 << 63, size=SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _draw.integers(1 << 63, size=ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes, seen: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text in UTF-8.

    A-Z is lower-cased, words are cut at ASCII white space: what bytes.lower
    and bytes.split do. Fewer than five words form one shingle; none, no shingle.
    """
    words = text.lower().split()
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    n = len(h)
    if n == 0:
        return h
    if n < SHINGLE:
        return mixed(np.atleast_1d((h * _PLACE[:n]).sum(dtype=np.uint64) + _PLACE[SHINGLE] * np.uint64(n)))
    s = h[: n - SHINGLE + 1] * _PLACE[0]
    for i in range(1, SHINGLE):
        s = s + h[i: n - SHINGLE + 1 + i] * _PLACE[i]
    return np.unique(mixed(s))


def minima(shingles: np.ndarray) -> np.ndarray:
    """128 minima of the set under as many hash functions."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (x[i:i + 2048, None] * _MULTIPLY + _ADD).min(axis=0), out=low)
    return low


def pack_fields(low: np.ndarray) -> bytes:
    """The kept bits of the minima, two fields a byte."""
    fields = ((low * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint8)
    return (fields[0::2] | fields[1::2] << BITS).tobytes()


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, ROWS).astype(np.uint64)
    return mixed((rows * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def estimated(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of one packed signature to many (8 words each), corrected for chance."""
    x = one ^ many
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    unequal = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)
    chance = 1 / (1 << BITS)
    return ((HASHES - unequal) / HASHES - chance) / (1 - chance)


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``set_id``, ``sig``, ``bands``; the last three null for an empty set."""
    def make():
        seen = WordHashes()

        def run(b: pa.RecordBatch) -> list:
            n, ids, sigs, bands = [], [], [], []
            for t in b.column("_text").to_pylist():
                s = shingle_set(t, seen)
                n.append(len(s))
                if not len(s):
                    ids.append(None), sigs.append(None), bands.append(None)
                    continue
                low = minima(s)
                ids.append(blake2b(s.tobytes(), digest_size=16).digest())
                sigs.append(pack_fields(low))
                bands.append(band_keys(low))
            return [pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64()))]
        return run

    return map_rows(docs.select("doc_id", utf8_of(text).alias("_text")),
                    "n_shingles bigint, set_id binary, sig binary, bands array<bigint>", ["doc_id"], make)


# ------------------------------------------------------------ links in buckets
class Forest:
    """Union by smaller number."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _bucket_links(sigs: np.ndarray, loose: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with a loose estimate."""
    left, out = np.arange(len(sigs)), []
    while len(left) > 1:  # breadth first: whatever hangs on a member leaves the rest
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = estimated(sigs[x], sigs[left]) >= loose
            out += [(x, int(y)) for y in left[near]]
            queue += left[near].tolist()
            left = left[~near]
    return out


def coarse_links(classes: DataFrame, loose: float = LOOSE) -> DataFrame:
    """Links ``a``, ``b`` between classes that share a band and look alike by bit counts."""
    banded = classes.select("rep", F.explode("bands").alias("band"))
    shared = (banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
              .withColumn("blocks", F.ceil(F.col("n") / BUCKET_BLOCK).cast("int")))
    members = (banded.join(shared.drop("n"), "band")
               .withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))
    # every pair of blocks of a bucket is a task of its own
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = (members.withColumn("other", other)
             .select("band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "rep"))
    rows = pairs.join(classes.select("rep", "sig"), "rep")

    def run(pdf: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        rep, out = pdf["rep"].to_numpy(), []
        sigs = np.frombuffer(b"".join(pdf["sig"]), np.uint64).reshape(len(pdf), -1)
        for s, e in zip(bounds[:-1], bounds[1:]):
            if e - s > 1:
                out += [(rep[s + x], rep[s + y]) for x, y in _bucket_links(sigs[s:e], loose)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64").drop_duplicates()

    return map_groups(rows, ["band", "i", "j"], ["rep"], run, "a bigint, b bigint").distinct()


# ------------------------------------------------------------ exact comparison
class Sets:
    """Shingle sets of a group: which members hold enough of one set."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flat, self.mark = flat, np.zeros(int(flat.max()) + 1, bool)

    def of(self, i: int) -> np.ndarray:
        return self.flat[self.starts[i]:self.starts[i + 1]]

    def linked(self, x: int, among: np.ndarray, percent: int) -> np.ndarray:
        """Those of ``among`` with 100 * intersection >= percent * union."""
        size = self.sizes[x]
        fit = among[(100 * np.minimum(self.sizes[among], size) >= percent * np.maximum(self.sizes[among], size))]
        if not len(fit):
            return fit
        self.mark[self.of(x)] = True
        rows = np.concatenate([self.of(i) for i in fit])
        at = np.concatenate([[0], np.cumsum(self.sizes[fit])[:-1]])
        both = np.add.reduceat(self.mark[rows], at, dtype=np.int64)
        self.mark[self.of(x)] = False
        return fit[100 * both >= percent * (size + self.sizes[fit] - both)]


def _exact_links(sets: Sets, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the confirmed links of a group."""
    left, out = np.arange(len(sets.sizes)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = sets.linked(x, left, percent)
            out += [(x, int(y)) for y in near]
            queue += near.tolist()
            left = np.setdiff1d(left, near, assume_unique=True)
    return out


def _cross_links(sets: Sets, first: np.ndarray, second: np.ndarray, label: np.ndarray, percent: int) -> list:
    """Confirmed links between two blocks whose members are in different components so far."""
    forest, out = Forest(len(label)), []
    _, place = np.unique(label, return_index=True)
    root_of = {label[i]: int(i) for i in place}
    for i, v in enumerate(label):
        forest.join(root_of[v], i)
    for x in first.tolist():
        rest = np.array([y for y in second.tolist() if forest.root(y) != forest.root(x)], np.int64)
        if len(rest):
            for y in sets.linked(x, rest, percent).tolist():
                if forest.join(x, y):
                    out.append((x, y))
    return out


EDGES = "a bigint, b bigint"


def confirmed_links(docs: DataFrame, classes: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """Exact links inside coarse clusters (``node``, ``component``), as spanning forests."""
    sized = clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).join(
        classes.select("rep", "n_shingles"), "rep")
    blocks = sized.groupBy("cluster").agg(F.ceil(F.greatest(
        F.count(F.lit(1)) / CLUSTER_BLOCK, F.sum("n_shingles") / CLUSTER_SHINGLES)).cast("int").alias("blocks"))
    placed = sized.join(blocks, "cluster").select(
        "rep", "cluster", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"))
    texts = stored(docs.select(F.col("doc_id").alias("rep"), utf8_of().alias("text")).join(placed, "rep"), "texts")

    def inside(pdf: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        seen, rep, text, out = WordHashes(), pdf["rep"].to_numpy(), pdf["text"].to_numpy(), []
        for s, e in zip(bounds[:-1], bounds[1:]):
            if e - s > 1:
                found = _exact_links(Sets([shingle_set(t, seen) for t in text[s:e]]), percent)
                out += [(rep[s + x], rep[s + y]) for x, y in found]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    links = map_groups(texts.select("cluster", "block", "rep", "text"), ["cluster", "block"], ["rep"], inside, EDGES)
    split = texts.where("blocks > 1")
    if split.isEmpty():
        return links
    links = stored(links, "links")
    labels = components(links)
    pairs = (split.join(labels, split["rep"] == labels["node"], "left")
             .withColumn("label", F.coalesce("component", "rep"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block")
             .select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                     "block", "rep", "label", "text"))

    def across(pdf: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        seen, out = WordHashes(), []
        for s, e in zip(bounds[:-1], bounds[1:]):
            g = pdf.iloc[s:e]
            first = (g["block"] == g["i"]).to_numpy()
            if first.all() or not first.any():
                continue
            sets = Sets([shingle_set(t, seen) for t in g["text"]])
            rep = g["rep"].to_numpy()
            out += [(rep[x], rep[y]) for x, y in _cross_links(
                sets, np.flatnonzero(first), np.flatnonzero(~first), g["label"].to_numpy(), percent)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return links.unionByName(map_groups(pairs, ["cluster", "i", "j"], ["block", "rep"], across, EDGES))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for every row of ``docs`` (``doc_id``, ``text``).

    Two documents are linked if 100 * intersection >= percent * union of their
    shingle sets; component_id is the smallest doc_id reachable over links, kept
    tells whether that is the row's own. A null or empty text has no shingles and
    is its own component. Rows that share a doc_id are one node. A row without
    doc_id is linked with nothing: its component_id is null, and it is kept.
    """
    rows = stored(signatures(docs), "signatures")
    classes = stored(rows.where("doc_id IS NOT NULL AND set_id IS NOT NULL").groupBy("set_id").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"),
        F.first("bands").alias("bands")), "classes")
    clusters = components(coarse_links(classes))
    links = confirmed_links(docs, classes, clusters, percent)
    # a doc_id with several texts joins their classes
    shingled = rows.where("doc_id IS NOT NULL AND set_id IS NOT NULL").select("doc_id", "set_id")
    several = shingled.groupBy("doc_id").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo <> hi")
    doubled = (shingled.join(several, "doc_id", "left_semi").join(classes.select("set_id", "rep"), "set_id")
               .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = components(links.unionByName(doubled))
    named = classes.join(found, classes["rep"] == found["node"], "left").select(
        F.col("set_id").alias("_set"), F.coalesce("component", "rep").alias("_component"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return rows.join(named, F.col("set_id") == F.col("_set"), "left").select(
        "doc_id", "n_shingles", own.alias("component_id"),
        F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of each component, that of the smallest doc_id; repeated rows of an id count once.

    Of several texts of an id the one with the smallest SHA-256 stays. Rows without doc_id stay.
    """
    kept = near_duplicates(docs, percent).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    order = F.struct(F.sha2(utf8_of(), 256), F.xxhash64(*docs.columns))
    one = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("_row"))
    return one.select("_row.*").unionByName(docs.where("doc_id IS NULL"))
