from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from sensorframe.llm import byte_bpe, mixing, quality, queries, secrets
from tests.llm.cases import documents
from tests.llm.test_near_dup import plain_components

SF = "/root/testdata/sf0.001"


def plain_targets(sizes: dict, weights=(1, 2, 3), most=3):
    """Capped sources go one by one; the excess is shared again until nobody is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return share | capped
        capped |= {s: most * sizes[s] for s in over}


def plain_mix(rows: list[tuple], seed="mix") -> list[int]:
    """Copies of each (doc_id, text, source): sorted by hash, filled up to the target."""
    size = [len([w for w in (t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace(
        "\x0c", " ").split(" ") if w]) for _, t, _ in rows]
    h = [int(hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:15], 16) for i, *_ in rows]
    sums = Counter()
    for (_, _, s), n in zip(rows, size):
        sums[s] += n
    goal, out = plain_targets(sums), [0] * len(rows)
    for s, total in sums.items():
        mine = [k for k, r in enumerate(rows) if r[2] == s]
        repeats = int(goal[s] // total) if total else 0
        wanted, below = goal[s] - repeats * total, 0
        for value in sorted({h[k] for k in mine}):
            group = [k for k in mine if h[k] == value]
            here = sum(size[k] for k in group)
            take = wanted > 0 and (below < wanted or below == 0) if here == 0 else (
                below + here <= wanted or (below < wanted and below + here - wanted <= wanted - below))
            for k in group:
                out[k] = repeats + take
            below += here
    return [(n, c, goal[r[2]]) for n, c, r in zip(size, out, rows)]


def test_mix_equals_plain_filling(spark):
    rows = [(i, "w " * (1 + i * 7 % 23), f"s{i % 5}" if i % 5 else None) for i in range(300)]
    rows += [(1000 + i, "x y", "tiny") for i in range(2)] + [(2000, "", "empty"), (7, rows[7][1], rows[7][2])]
    docs = documents(spark, [(i, t, "en", s) for i, t, s in rows])
    got = Counter((r.doc_id, r.size, r.copies, round(r.target, 6)) for r in mixing.mix(docs).collect() if r["size"])
    want = Counter((r[0], n, c, round(g, 6)) for r, (n, c, g) in zip(rows, plain_mix(rows)) if n)
    assert got == want
    sums = Counter()
    for r in mixing.mix(docs).collect():
        sums[r.source, r.target] += r.taken
    assert all(abs(taken - goal) <= 46 for (_, goal), taken in sums.items())


def test_nested_budgets(spark):
    docs = documents(spark, [(i, "a b c", "en", "s") for i in range(500)])
    sized = mixing.sized_rows(docs, ["doc_id"], "mix")
    budgets = spark.createDataFrame([("=s", "small", 90.0), ("=s", "large", 900.0), ("=s", "all", 5000.0)],
                                    "key string, budget string, wanted double")
    cut = {r.budget: r.threshold for r in mixing.thresholds(sized, budgets).collect()}
    taken = {b: {r.doc_id for r in sized.collect() if r.h < t} for b, t in cut.items()}
    assert [len(taken[b]) for b in ("small", "large", "all")] == [30, 300, 500] and taken["small"] < taken["large"]


def test_mix_awkward_rows(spark):
    assert mixing.mix(documents(spark)).count() == 9
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.apply_mix(documents(spark, [])).count() == 0


def test_rows_without_words_are_never_taken_beyond_the_mix(spark):
    rows = [(i, "", "en", "empty") for i in range(40)] + [(100 + i, None, "en", "none") for i in range(3)]
    rows += [(200 + i, "a b c" if i % 3 else " ", "en", "tiny") for i in range(60)]  # at its cap of three times its size
    rows += [(1000 + i, "w " * 500, "en", s) for i in range(20) for s in ("p", "q")]
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    by = {s: {r.copies for r in got if r.source == s} for s in ("empty", "none", "tiny")}
    assert by == {"empty": {0}, "none": {0}, "tiny": {3}}
    out = Counter(r.source for r in mixing.apply_mix(docs).collect())
    assert (out["empty"], out["none"], out["tiny"]) == (0, 0, 180)


def test_pipeline_equals_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    x = quality.scores_of(np.array([quality.describe((t or "").encode()) for _, t, _ in rows]), model)
    rows = [r for r, s in zip(rows, x) if s >= 0.5]
    kept = plain_components({i: t for i, t, _ in rows})
    rows = [r for r in rows if kept[r[0]][2]]

    def redacted(t):
        out, at = "", 0
        for a, b in sorted((a, b) for _, a, b in secrets.find(secrets.RULES, t)):
            out, at = (out + t[at:a] + "[SECRET]", b) if a >= at else (out, max(at, b))
        return out + t[at:]
    rows = [(i, redacted(t) if t else t, s) for i, t, s in rows]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=byte_bpe.read_ranks(queries.VOCABULARY))
    want = Counter()
    for (i, t, s), (_, copies, _) in zip(rows, plain_mix(rows)):
        want[i, s, tuple(library.encode_ordinary(t or ""))] += copies
    got = corpus_pipeline.run(spark, SF).collect()
    assert all(r.round_trip for r in got)
    assert Counter((r.doc_id, r.source, tuple(r.ids)) for r in got) == +want


def test_stages_take_awkward_and_empty_tables(spark):
    for rows in (None, []):
        docs = documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "byte-level BPE":
                assert out.columns == docs.columns
                docs = spark.createDataFrame(out.collect(), docs.schema)
            else:
                assert {"doc_id", "n_tokens", "ids"} <= set(out.columns) and all(r.round_trip for r in out.collect())
