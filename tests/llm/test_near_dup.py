from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from sensorframe.llm import graph, near_dup, queries
from tests.llm.cases import LONG, documents

SF = "/root/testdata/sf0.001"


def plain_components(texts: dict[int, str], percent=75):
    """Every pair compared on full sets of word tuples."""
    def words(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace(
            "\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    sets = {}
    for i, t in texts.items():
        w = [x for x in words(t) if x]
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    x, y = sorted((root(i), root(j)))
                    up[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def found(spark, texts):
    docs = documents(spark, [(i, t, "en", "s") for i, t in texts.items()])
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}


def test_query_equals_all_pairs(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op7_near_duplicates(spark, SF).collect()}
    assert got == plain_components(texts)


def group_of_copies(n, words=120, edits=(0, 9), seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(words)]
    out = {}
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(*edits)):
            w[rng.randrange(words)] = f"x{rng.randrange(10 ** 6)}"
        out[i * 3 + 1] = " ".join(w)
    return out


def test_group_around_the_threshold(spark):
    texts = group_of_copies(150)
    assert found(spark, texts) == plain_components(texts)


def test_blocks_of_large_groups_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BUCKET_BLOCK", 16)
    monkeypatch.setattr(near_dup, "CLUSTER_BLOCK", 16)
    texts = group_of_copies(120, seed=5)
    assert found(spark, texts) == plain_components(texts)


def test_short_empty_long_and_white_space(spark):
    texts = {1: "", 2: None, 3: " \t\x0b\x0c\r\n", 4: "one two", 5: "ONE\ttwo", 6: "one two three four five",
             7: "one two three four", 8: LONG, 9: LONG + " more", 10: "É a b c d e", 11: "é a b c d e", 12: "one two"}
    assert found(spark, texts) == plain_components(texts)


def test_awkward_rows(spark):
    rows = near_dup.near_duplicates(documents(spark)).collect()
    assert len(rows) == 9
    by = {r.doc_id: r for r in rows}
    assert (by[None].component_id, by[None].kept) == (None, True)
    assert by[5].component_id == 4 and not by[5].kept and by[4].kept
    assert near_dup.near_duplicates(documents(spark, [])).count() == 0


def test_doc_id_with_two_texts_is_one_node(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = documents(spark, [(1, a, "en", "s"), (2, a, "en", "s"), (2, b, "en", "s"), (3, b, "en", "s")])
    assert {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_of_several_texts_of_an_id_the_smallest_digest_stays(spark):
    texts = [f"text {i} of this document, {i} times over and over" for i in range(6)]
    want = min(texts, key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    for parts in (1, 4):
        docs = documents(spark, [(1, t, "en", "s") for t in texts]).repartition(parts)
        assert [r.text for r in near_dup.keep_one(docs).collect()] == [want]


def test_hot_root(spark):
    edges = spark.range(1, 5000).selectExpr("0 AS a", "id AS b").union(spark.range(5000, 5010).selectExpr("id AS a", "id - 1 AS b"))
    got = graph.components(edges)
    assert got.count() == 5010 and got.where("component <> 0").isEmpty()


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(1)
    error = []
    for share in (0.0, 0.5, 0.75, 1.0):
        for _ in range(30):
            same = rng.integers(1 << 63, size=400, dtype=np.uint64)
            n = int(round(400 * (1 - share) / (1 + share)))
            one, two = (np.concatenate([same[n:] if share else same[:0], rng.integers(1 << 63, size=m, dtype=np.uint64)])
                        for m in (n, n) if True)
            true = len(np.intersect1d(one, two)) / max(1, len(np.union1d(one, two)))
            sig = [np.frombuffer(near_dup.pack_fields(near_dup.minima(np.unique(near_dup.mixed(s)))), np.uint64)
                   for s in ((one, two) if len(one) else (same, same))]
            error.append(near_dup.estimated(sig[0], sig[1][None])[0] - (true if len(one) else 1.0))
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.06


@pytest.mark.parametrize("edges,want", [
    ([], {}), ([(5, 5), (None, 3)], {}), ([(1, 2), (2, 3), (7, 6), (6, 8)], {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6}),
    ([(i, i + 1) for i in range(40)], dict.fromkeys(range(41), 0))])
def test_components(spark, edges, want):
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {r.node: r.component for r in graph.components(df).collect()} == want
