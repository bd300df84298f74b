from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorframe.llm import phrases, queries
from tests.llm.cases import documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_count, top):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        longest = Counter()
        for p, a in found.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    longest[part] = max(longest[part], a)
        rows = []
        for p, a in found.items():
            if len(p) == 2 and longest[p] and 100 * longest[p] >= 50 * a:
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        n = sum(v for p, v in c.items() if len(p) == 1)
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_query_equals_plain_count(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = found(queries.op13_phrase_collocations(spark, sf))
    assert got == plain(rows, 10, 2000) and got


@pytest.mark.parametrize("limits", [dict(vocabulary=20, entries=300, burst=4), dict(vocabulary=0, entries=50), dict(burst=2, entries=10)])
def test_every_way_gives_the_same(spark, limits):
    g = np.random.default_rng(4)
    words = ["the", "of", "Big", "ÄPFEL", "wort", "new", "york", "city", "x.y", "a,", "!", "\t", "\n", "日本"] + [f"w{i}" for i in range(60)]
    rows = [(lang, " ".join(words[int(i) % len(words)] for i in g.zipf(1.3, 400))) for lang in ("en", "de", None, "und", "") for _ in range(6)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert found(phrases.collocations(docs, 5, 40, **limits)) == plain(rows, 5, 40)


def test_ties_cuts_and_longer_phrases(spark):
    rows = [("en", "new york city. " * 12 + "new york, " * 12 + "a b; " * 10 + "c d! " * 10 + "B A? " * 9 + "e e e e " * 3),
            ("fr", "été été. " * 10), ("xx", None), ("yy", ""), ("zz", "one two three")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = found(phrases.collocations(docs, 10, 5))
    assert got == plain(rows, 10, 5)


def test_awkward_rows(spark):
    rows = [(r.lang, r.text) for r in documents(spark).collect()]
    assert found(phrases.collocations(documents(spark), 2, 50)) == plain(rows, 2, 50)
    assert phrases.collocations(documents(spark, [])).count() == 0
    assert phrases.collocations(documents(spark, [(1, None, None, None)])).count() == 0


def test_large_counts_are_exact(spark):
    for a, left, right in ((10**15, 10**15 + 7, 10**15 + 3), (3_000_000_019, 4 * 10**12, 5 * 10**12 + 1), (10, 10, 10)):
        assert spark.range(1).select(phrases.score_of(str(a), str(left), str(right))).first()[0] == 1000000 * a * a // (left * right)


def test_trie_counts_and_sorts():
    g = np.random.default_rng(5)
    trie, want, got = phrases.HatTrie(burst=8, entries=200), Counter(), Counter()
    for _ in range(40):
        w = np.minimum(g.zipf(1.4, (300, 3)), 50)
        keys, counts = np.unique(w[:, 0] << 42 | w[:, 1] << 21 | w[:, 2], return_counts=True)
        want.update(dict(zip(keys.tolist(), counts.tolist())))
        trie.add(keys, counts)
        if trie.full():
            run = trie.spill(100)
            assert (np.diff(run[0]) > 0).all() and trie.held <= 100
            heads = set((run[0] >> 42).tolist())
            assert not heads & trie.root.keys()  # whole subtrees leave
            for k, c in zip(*map(np.ndarray.tolist, run)):
                got[k] += c
    assert any(type(box) is phrases._Node for box in trie.root.values()) or len(got)
    for k, c in zip(*map(np.ndarray.tolist, trie.spill(0))):
        got[k] += c
    assert got == want and trie.held == 0 and not trie.root


def test_a_text_with_more_words_than_numbers():
    task = phrases.Task({"en": {b"a": 1}}, False, 0, 8, 10**6, 2)
    task.most = 40
    text = " ".join(["a b c d"] * 30 + [f"w{i}" for i in range(100)]).encode()
    total = Counter()
    for batch in list(task.count([("en", text)])) + list(task.runs(0)):
        for w1, w2, w3, n in zip(*[batch.column(c).to_pylist() for c in ("w1", "w2", "w3", "n")]):
            total[w1, w2, w3] += n
    h = {w: phrases.word_hash("en", w.encode(), 0) for w in "bcd"}
    assert total[1, h["b"], h["c"]] == 30 and sum(total.values()) == 219
