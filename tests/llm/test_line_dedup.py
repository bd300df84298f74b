from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorframe.llm import line_dedup, queries
from tests.llm.cases import documents

SF = "/root/testdata/sf0.01"
ENDS = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return ENDS.sub("", line).translate(LOWER)


def plain(rows, min_docs, min_chars, first):
    """(doc_id, n_lines, n_dropped, kept) of (doc_id, text) rows with distinct ids."""
    split = [(i, (t or "").split("\n")) for i, t in rows]
    docs = Counter(k for _, lines in split for k in {key(x) for x in lines} if len(k) >= max(1, min_chars))
    seen, out = set(), []
    for i, lines in sorted(split, key=lambda r: (r[0] is None, r[0])):
        kept = []
        for x in lines:
            k = key(x)
            if docs[k] >= min_docs and not (first and k not in seen):
                continue
            seen.add(k)
            kept.append(x)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=str)


def test_query_equals_plain_search(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op12_line_dedup(spark, SF).collect()}
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain(rows, 10, 1, False)}
    assert got == want and sum(d for _, d, _ in got.values()) > 0


@pytest.mark.parametrize("first", [False, True])
@pytest.mark.parametrize("limits", [{}, {"held_keys": 2}, {"held_keys": 0}, {"folded_bits": 1 << 16}])
def test_every_way_gives_the_same(spark, first, limits):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for min_docs, min_chars in ((2, 1), (3, 12)):
        got = found(line_dedup.dedup_lines(docs.repartition(5), min_docs, min_chars, first, **limits))
        assert got == plain(rows, min_docs, min_chars, first)


def test_keys_and_empty_lines(spark):
    texts = [" Same Line\t\nown a\r\n\n", "same line\nÄ\n \n", "SAME LINE\x0b\nä\n", None, "", "same line", "Ä\nÄ", " same line"]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    for first in (False, True):
        assert found(line_dedup.dedup_lines(docs, 2, 1, first)) == plain(list(enumerate(texts)), 2, 1, first)


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = found(line_dedup.dedup_lines(docs, min_docs=3, first=False))
    assert len(rows) == 9 and [r[1:] for r in rows if r[0] == 4] == [(1, 1, "")] * 2
    assert [r for r in rows if r[0] == 2] == [(2, 1, 0, "")] and [r for r in rows if r[0] == 6] == [(6, 2, 0, " \t\n ")]
    assert [r[1:3] for r in rows if r[0] is None] == [(1, 0)] and [r[1:3] for r in rows if r[0] == 3] == [(8001, 0)]
    first = found(line_dedup.dedup_lines(docs, min_docs=3, first=True))  # equal rows are one place: both keep the line
    assert [r[2] for r in first if r[0] == 4] == [0, 0] and [r[2] for r in first if r[0] == 5] == [1]
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0
    kept = line_dedup.dedup_lines(docs, keep=("doc_id", "n_chars", "spans"))
    assert kept.columns == ["doc_id", "n_chars", "spans", "n_lines", "n_dropped", "kept"]


def test_hot_line(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("everywhere\nown "), "id",
                                    F.when(F.col("id") % 3 == 0, "\nthird").otherwise("")).alias("text"))
    got = line_dedup.dedup_lines(docs, min_docs=1001, first=False).agg(F.sum("n_dropped"), F.min("n_dropped")).first()
    assert tuple(got) == (3000, 1)
    assert line_dedup.dedup_lines(docs, 2, held_keys=1).agg(F.sum("n_dropped")).first()[0] == 2999 + 999


def test_filters_miss_nothing_and_merge(spark):
    g = np.random.default_rng(0)
    a, b = (g.integers(1 << 63, size=500, dtype=np.uint64) for _ in range(2))
    bits, width = 1 << 20, 1 << 16
    both = np.append(a[:100], b)
    pieces = []
    for hashes in (a, both, np.append(b[:5], b[:5])):
        pieces += line_dedup._pieces(hashes, bits, width).to_pylist()
    df = spark.createDataFrame([(p["segment"], p["once"], p["twice"]) for p in pieces], "segment bigint, once binary, twice binary")
    data = np.zeros(bits // 8, np.uint8)
    for r in line_dedup._merged(df.repartition(3), width, "twice").collect():
        data[r.segment * width // 8:(r.segment + 1) * width // 8] = np.frombuffer(r.bits, np.uint8, offset=1)

    def holds(hashes):
        at = line_dedup.places(hashes, bits)
        return (data[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).all(1)

    assert holds(a[:100]).all() and holds(b[:5]).all() and holds(a[100:]).sum() + holds(b[5:]).sum() < 5
    for offsets in (np.arange(0, 1 << 16, 7), np.array([3, 9]), np.arange(1 << 16)):
        packed = line_dedup._packed(offsets, 1 << 16)
        assert (np.flatnonzero(np.unpackbits(line_dedup._opened(packed, 1 << 16))) == offsets).all()
