"""Repeated lines across documents, found through two Bloom filters.

A line's key is the line without ASCII white space at its ends, A-Z in lower
case. Every task hashes the keys of its documents and sets their bits in a
once-seen filter; keys it meets in a second document go to its twice-seen
filter. Filters of two tasks merge by bits:

    once = once1 | once2,    twice = twice1 | twice2 | (once1 & once2),

so a key of two documents is always in the merged twice-seen filter. The filters
are as wide as the counted lines ask. They are cut into segments and merged
segment by segment, each held by one task; a sparse piece travels as a list of
places, a full one as bits. The merged twice-seen filter is folded to the width
its own content asks, at most ``FOLDED_BITS``, and that bounded filter goes to
all tasks.

Only lines in it are suspects and shuffle: they are counted by their whole key,
which settles false suspicions. What is confirmed is applied to the documents
where they stand. The confirmed keys a task holds are bounded too: the
``HELD_KEYS`` most frequent ones are looked up in the task, and lines of others
(if there are more) find their document through a join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from sensorframe.llm.common import SLICE_BYTES, stored, utf8_of

HASHES, BITS_PER_LINE = 4, 10
#: Narrowest segment and most segments of a filter; the widest twice-seen filter that is sent to every task.
SEGMENT_BITS, SEGMENTS, FOLDED_BITS = 1 << 16, 1 << 16, 1 << 28
#: Confirmed keys (16-byte digests) a task looks up by itself.
HELD_KEYS = 1_000_000
#: Hashes a task gathers before it hands on its filters.
GATHERED = 1 << 21


def line_keys(text: bytes) -> list[bytes]:
    """The key of every line of a text."""
    return [line.strip().lower() for line in text.split(b"\n")]


def code_points(key: bytes) -> int:
    return len(key.decode("utf-8", "replace"))


def power_of_two(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


# ------------------------------------------------------------------- filters
def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The ``HASHES`` places of every hash in a filter of ``bits`` (a power of two) bits."""
    step = (hashes >> np.uint64(32)) * np.uint64(2) + np.uint64(1)
    return (hashes[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(bits - 1)


def _packed(offsets: np.ndarray, width: int) -> bytes:
    """Sorted distinct offsets of a segment: b'l' and a list, or b'b' and bits, whichever is shorter."""
    kind = np.uint16 if width <= 1 << 16 else np.uint32
    if len(offsets) * np.dtype(kind).itemsize < width // 8:
        return b"l" + offsets.astype(kind).tobytes()
    bits = np.zeros(width, bool)
    bits[offsets] = True
    return b"b" + np.packbits(bits).tobytes()


def _opened(data: bytes, width: int) -> np.ndarray:
    """Bits of a segment as bytes (eight to each)."""
    if data[:1] == b"b":
        return np.frombuffer(data, np.uint8, offset=1)
    bits = np.zeros(width, bool)
    bits[np.frombuffer(data, np.uint16 if width <= 1 << 16 else np.uint32, offset=1)] = True
    return np.packbits(bits)


def _pieces(hashes: np.ndarray, bits: int, width: int) -> pa.RecordBatch:
    """The two filters of one task's hashes (one per document and key), by segment."""
    keys, times = np.unique(hashes, return_counts=True)
    once, twice = (np.unique(places(k, bits)).astype(np.int64) for k in (keys, keys[times > 1]))
    segments = np.unique(once // width)  # a twice-seen key was seen once
    rows = []
    for part in (once, twice):
        edges = np.searchsorted(part, np.append(segments, bits // width) * width)
        rows.append([_packed(part[a:b] - s * width, width) for s, a, b in
                     zip(segments, edges[:-1], np.append(np.searchsorted(part, (segments[:-1] + 1) * width), len(part)))])
    return pa.RecordBatch.from_arrays([pa.array(segments, pa.int64()), *[pa.array(r, pa.binary()) for r in rows]],
                                      ["segment", "once", "twice"])


def _merged(pieces: DataFrame, width: int, result: str) -> DataFrame:
    """``segment``, ``bits``, ``ones``: all pieces of a segment as one, the once- or twice-seen filter (empty ones left out)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, once, twice = None, None, None

        def finished():
            out = {"once": once, "twice": twice}[result]
            if here is not None and out.any():
                yield pa.RecordBatch.from_arrays([pa.array([here], pa.int64()), pa.array([b"b" + out.tobytes()], pa.binary()),
                                                  pa.array([int(np.bitwise_count(out).sum())], pa.int64())],
                                                 ["segment", "bits", "ones"])

        for batch in batches:
            for s, a, b in zip(*[batch.column(c).to_pylist() for c in ("segment", "once", "twice")]):
                if s != here:
                    yield from finished()
                    here, once, twice = s, np.zeros(width // 8, np.uint8), np.zeros(width // 8, np.uint8)
                a = _opened(a, width)
                twice |= once & a
                if len(b) > 1:
                    twice |= _opened(b, width)
                once |= a
        yield from finished()

    return pieces.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "segment bigint, bits binary, ones bigint")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        step = max(1, b.num_rows * SLICE_BYTES // max(1, b.nbytes))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


class Rule:
    """Which keys take part."""

    def __init__(self, min_chars: int):
        self.min_chars = min_chars

    def firsts(self, text: bytes) -> dict[bytes, int]:
        """Every key of a text that takes part, and the place of its first line."""
        out: dict[bytes, int] = {}
        for at, key in enumerate(line_keys(text)):
            out.setdefault(key, at)
        return {k: at for k, at in out.items() if len(k) >= self.min_chars and code_points(k) >= self.min_chars}


class Twice:
    """A folded twice-seen filter."""

    def __init__(self, bits: int, data: np.ndarray | None):
        self.bits, self.data = bits, data

    def holds(self, keys: Sequence[bytes]) -> np.ndarray:
        if self.data is None or not keys:
            return np.zeros(len(keys), bool)
        at = places(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64), self.bits)
        return (self.data[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).all(1)


def twice_seen(docs: DataFrame, rule: Rule, folded_bits: int = FOLDED_BITS) -> Twice:
    """The filter of all keys that stand in two rows of ``docs`` or more (column ``_text``, UTF-8), and a few others."""
    text = F.col("_text").cast("string")
    lines = docs.select(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n")).first().n or 0
    bits = max(SEGMENT_BITS, power_of_two(lines * BITS_PER_LINE))
    width = max(SEGMENT_BITS, bits // SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in _slices(batches):
            for t in b.column("_text"):
                keys = rule.firsts(t.as_py())
                held.append(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64))
                size += len(keys)
                if size >= GATHERED:
                    yield _pieces(np.concatenate(held), bits, width)
                    held, size = [], 0
        if size:
            yield _pieces(np.concatenate(held), bits, width)

    pieces = docs.select("_text").mapInArrow(run, "segment bigint, once binary, twice binary")
    twice = stored(_merged(pieces, width, "twice"), "twice")
    full = twice.select(F.sum("ones").alias("n")).first().n or 0
    folded = min(bits, max(width, SEGMENT_BITS, min(folded_bits, power_of_two(4 * full))))
    if not full:
        return Twice(bits, None)
    if folded < bits:
        parts = twice.select((F.col("segment") % (folded // width)).alias("segment"), F.col("bits").alias("once"),
                             F.lit(b"").alias("twice"))
        twice = _merged(parts, width, "once")
    data = np.zeros(folded // 8, np.uint8)
    for r in twice.toLocalIterator():
        data[r.segment * (width // 8):(r.segment + 1) * (width // 8)] = np.frombuffer(r.bits, np.uint8, offset=1)
    return Twice(folded, data)


# ------------------------------------------------------------------ operator
def confirmed(docs: DataFrame, twice: Twice, rule: Rule, min_docs: int, order: str) -> DataFrame:
    """``key``, ``n_docs`` and where it comes first (``owner``, ``at``), of keys in ``min_docs`` rows or more.

    The first row is that of the smallest ``order`` (nulls last), then of the smallest digest.
    """
    kind = docs.schema[order].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            keys, rows, at, owners = [], [], [], []
            for i, (t, o) in enumerate(zip(b.column("_text").to_pylist(), b.column(order).to_pylist())):
                first = rule.firsts(t)
                found = [k for k, hit in zip(first, twice.holds(list(first))) if hit]
                if found:
                    keys += found
                    at += [first[k] for k in found]
                    rows += [i] * len(found)
                    owners += [row_digest(o, t)] * len(found)
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), b.column(order).take(pa.array(rows)), pa.array(owners, pa.binary()),
                     pa.array(at, pa.int64())], ["key", "by", "owner", "at"])

    suspects = docs.select("_text", order).mapInArrow(run, f"key binary, by {kind}, owner binary, at bigint")
    first = F.min(F.struct(F.col("by").isNull().alias("last"), "by", "owner", "at")).alias("first")
    return (suspects.groupBy("key").agg(F.count("*").alias("n_docs"), first).where(F.col("n_docs") >= min_docs)
            .select("key", "n_docs", "first.owner", "first.at"))


def row_digest(order, text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(f"{order}\0".encode() + text)


def key_digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def dedup_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, first: bool = True, order: str = "doc_id",
                keep: Sequence[str] = ("doc_id",), text: str = "text", held_keys: int = HELD_KEYS,
                folded_bits: int = FOLDED_BITS) -> DataFrame:
    """``keep``, ``n_lines``, ``n_dropped`` and ``kept`` (the text of the lines left, joined by line feeds) of every row.

    Lines whose key stands in ``min_docs`` rows or more are dropped; with ``first``
    the first of all its lines stays (smallest ``order``, nulls last, then the
    earliest line; rows equal in ``order`` and text count as one place, so each
    keeps it). Keys shorter than ``min_chars`` code points never count; an empty
    line's key never does. A null or empty text is one empty line; if all lines
    go, ``kept`` is empty. Each row is a document, repeated ids and texts too.
    """
    keep, rule = list(keep), Rule(max(1, min_chars))
    source = docs.select(*keep, *[c for c in [order] if c not in keep], utf8_of(text).alias("_text"))
    twice = twice_seen(source, rule, folded_bits)
    keys = stored(confirmed(source, twice, rule, min_docs, order), "lines")
    held, more = _held(keys, held_keys, first)
    if more is None:
        return _applied(source, keep, order, held, None)
    source = stored(source.withColumn("_row", F.monotonically_increasing_id()), "documents")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            rows, digests, at, owners = [], [], [], []
            for row, t, o in zip(*[b.column(c).to_pylist() for c in ("_row", "_text", order)]):
                found = line_keys(t)
                owner = row_digest(o, t)
                for i, hit in enumerate(twice.holds(found)):
                    if hit and (d := key_digest(found[i])) not in held:
                        rows.append(row), digests.append(d), at.append(i), owners.append(owner)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(digests, pa.binary()), pa.array(at, pa.int64()),
                                              pa.array(owners, pa.binary())], ["_row", "digest", "line", "_owner"])

    lines = source.select("_row", "_text", order).mapInArrow(run, "_row bigint, digest binary, line bigint, _owner binary")
    hit = lines.join(more, "digest")
    if first:
        hit = hit.where((F.col("owner") != F.col("_owner")) | (F.col("at") != F.col("line")))
    gone = hit.groupBy("_row").agg(F.collect_list("line").alias("_gone"))
    return _applied(source.join(gone, "_row", "left"), keep, order, held, "_gone")


def _held(keys: DataFrame, most: int, first: bool) -> tuple[dict, DataFrame | None]:
    """Digests of the most frequent keys (and their first places), and the table of the others, if there are any.

    A key of more than 1 / ``most`` of all lines is among the held ones, so none of the others is hot in a join.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = pa.array([key_digest(k.as_py()) for k in b.column("key")], pa.binary())
            yield pa.RecordBatch.from_arrays([digests, *[b.column(c) for c in ("n_docs", "owner", "at")]],
                                             ["digest", "n_docs", "owner", "at"])

    found = keys.mapInArrow(run, "digest binary, n_docs bigint, owner binary, at bigint")
    order = [F.desc("n_docs"), "digest"]
    more = None
    if keys.count() > most:
        found = stored(found, "digests")
        top = stored(found.orderBy(*order).limit(most), "held")
        more = found.join(top.select("digest"), "digest", "left_anti").drop("n_docs")
        found = top
    columns = found.select("digest", *(["owner", "at"] if first else [])).toArrow()
    digests = columns.column("digest").to_pylist()
    if not first:
        return dict.fromkeys(digests), more
    return dict(zip(digests, zip(columns.column("owner").to_pylist(), columns.column("at").to_pylist()))), more


def _applied(rows: DataFrame, keep: list[str], order: str, held: dict, gone: str | None) -> DataFrame:
    used = list(dict.fromkeys([*keep, order, "_text", *([gone] if gone else [])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            count, dropped, kept = [], [], []
            lists = b.column(gone).to_pylist() if gone else [None] * b.num_rows
            for t, o, away in zip(b.column("_text").to_pylist(), b.column(order).to_pylist(), lists):
                lines = t.split(b"\n")
                away, owner, left = set(away or ()), None, []
                for at, line in enumerate(lines):
                    place = held.get(key_digest(line.strip().lower()), False)
                    if place and place[1] == at:
                        owner = owner or row_digest(o, t)
                        place = False if place[0] == owner else place
                    if place is False and at not in away:
                        left.append(line)
                count.append(len(lines))
                dropped.append(len(lines) - len(left))
                kept.append(b"\n".join(left))
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + [pa.array(count, pa.int64()), pa.array(dropped, pa.int64()),
                                             pa.array(kept, pa.binary())], [*keep, "n_lines", "n_dropped", "_kept"])

    fields = [rows.schema[k] for k in keep] + list(StructType.fromDDL("n_lines bigint, n_dropped bigint, _kept binary").fields)
    out = rows.select(*used).mapInArrow(run, StructType(fields))
    return out.select(*keep, "n_lines", "n_dropped", F.col("_kept").cast("string").alias("kept"))
