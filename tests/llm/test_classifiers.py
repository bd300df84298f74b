from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sensorframe.llm import labelled, quality, queries, toxicity
from tests.llm.cases import documents

SF = "/root/testdata/sf0.1"


def judged(spark, rows, label):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = [r.doc_id for r in rows]
    assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    return np.array([truth[r.doc_id] for r in held]), np.array([r.predicted for r in held]), np.array([r.score for r in held])


def test_quality_held_out(spark):
    true, said, score = judged(spark, queries.op9_quality(spark, SF).collect(), "quality")
    assert said[true == 1].mean() > 0.99 and said[true == 0].mean() < 0.1
    assert score[true == 1].mean() > score[true == 0].mean() + 0.5


def test_toxicity_held_out(spark):
    rows = queries.op6_toxicity(spark, SF).collect()
    true, said, score = judged(spark, rows, "toxic")
    assert said[true == 1].mean() > 0.7 and said[true == 0].mean() < 0.01
    flagged = np.array([r.flagged for r in rows if r.held_out and r.doc_id in {
        x.doc_id for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}])
    assert flagged[true == 1].mean() > 0.7 and flagged[true == 0].mean() < 0.02
    assert len({r.threshold for r in rows}) > 1


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.selectExpr("doc_id", *[f"if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - {c}, {c}) as {c}"
                                           for c in ("quality", "toxic")])
    for op in (quality, toxicity):
        one, two = ({r.doc_id: r.score for r in op.classify(docs, x).collect()} for x in (labels, turned))
        assert one == two


def test_scores_use_the_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    other = docs.selectExpr("doc_id + 1000 as doc_id", "text", "'xx' as lang", "'elsewhere' as source")
    for op in (quality, toxicity):
        model = op.fit(docs, labels)
        a = {r.doc_id: r.score for r in op.score(docs, model).collect()}
        b = {r.doc_id - 1000: r.score for r in op.score(other, model).collect()}
        assert a == b


@pytest.mark.parametrize("op", [quality, toxicity])
def test_awkward_rows(spark, op):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, 1, 0), (None, 1, 1), (5, None, None)],
                                   "doc_id bigint, quality int, toxic int")
    rows = op.classify(documents(spark), labels).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert op.classify(documents(spark, []), labels).count() == 0
    none = op.classify(documents(spark), labels.limit(0)).collect()
    assert {r.predicted for r in none} == ({1} if op is quality else {0})


def test_prior_is_estimated():
    g = np.random.default_rng(0)
    for prior in (0.3, 0.6, 0.9):
        pos, unl = g.normal(2, 1, (4000, 3)), g.normal(-2, 1, (6000, 3))
        unl[: int(6000 * prior)] += 4
        assert abs(quality.estimate_prior(pos, unl) - prior) < 0.05


def test_sample_is_bounded_and_stable(spark):
    ids = spark.range(5000).withColumnRenamed("id", "doc_id")
    a, b = ([r.doc_id for r in labelled.some_ids(x, 100, "s").collect()] for x in (ids, ids.repartition(7)))
    assert a == b and len(a) == 100 and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in a)


def test_short_texts_reach_wide_filters():
    net = toxicity.Filters()
    for n in range(4):
        assert np.isfinite(net.logit(np.ones((n, toxicity.SIZE), np.float32)))


def test_every_word_of_a_text_counts():
    plain, odd = b"word " * 5000, b"Waaa " * 5000
    for text, share in ((plain + odd, 0.5), (odd + plain, 0.5), (b"word " * 64 + b"Waaa " * 36, 0.36)):
        assert quality.describe(text)[-2:] == pytest.approx([share, share])


@pytest.mark.parametrize("unlabelled", [0, 1, 2])
@pytest.mark.parametrize("positives", [0, 1, 2, 3])
def test_any_number_of_labels(spark, positives, unlabelled):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = documents(spark, [(i, f"some words of text number {i}", "en", "s") for i in ids[:max(positives, unlabelled)]])
    labels = spark.createDataFrame([(i, 1) for i in ids[:positives]], "doc_id bigint, quality int")
    model = quality.fit(docs, labels, unlabelled=unlabelled)
    assert model["prior"] == (quality.USUAL_PRIOR if positives and unlabelled else None)
    assert all(0 <= r.score <= 1 for r in quality.score(docs, model).collect())


def test_prior_needs_enough_rows():
    g = np.random.default_rng(1)
    for n, m in ((1, 1), (quality.FEW - 1, 500), (500, quality.FEW - 1)):
        assert quality.estimate_prior(g.normal(size=(n, 3)), g.normal(size=(m, 3))) == quality.USUAL_PRIOR
    assert np.isfinite(quality.estimate_prior(g.normal(size=(quality.FEW, 3)), g.normal(size=(quality.FEW, 3))))


def test_one_row_per_id(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, f"text {k} of {i} " + "bad" * (i % 2), "en", "s") for i in ids for k in (2, 1)]
    labels = [(i, 1, i % 2) for i in ids] + [(ids[0], 1, 1 - ids[0] % 2)]
    for seed in (1, 5):
        docs = documents(spark, rows).repartition(seed)
        known = spark.createDataFrame(labels[::-1 if seed == 5 else 1], "doc_id bigint, quality int, toxic int")
        found = [sorted((r.doc_id, r.score) for r in op.score(docs, op.fit(docs, known)).collect()) for op in (quality, toxicity)]
        if seed == 5:
            assert found == first
        first = found


def test_toxicity_learns_from_every_labelled_row(spark):
    ids = [i for i in range(9600) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = documents(spark, [(i, f"word{i % 7} " + ("vile thing" if i % 4 == 0 else "fine day"), "en", "s") for i in ids])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in ids], "doc_id bigint, toxic int")
    few = labelled.some_ids(labels, 6000, "toxic").withColumn("few", F.lit(True))
    other = labels.join(few, "doc_id", "left").selectExpr("doc_id", "if(few, toxic, 1 - toxic) AS toxic")
    assert other.join(labels, ["doc_id", "toxic"]).count() == 6000 < len(ids)
    one, two = (toxicity.fit(docs, x)["net"] for x in (labels, other))
    assert not np.array_equal(one.table, two.table) and one.platt != two.platt


def test_toxicity_shards_learn_together(spark):
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, f"word{i % 7} " + ("vile thing" if i % 4 == 0 else "fine day"), ("en", "de")[i % 2], "s") for i in ids]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in ids], "doc_id bigint, toxic int")
    found = []
    for parts in (1, 5):
        docs = documents(spark, rows).repartition(parts)
        model = toxicity.fit(docs, labels.repartition(6 - parts), shard_rows=250)
        found.append(sorted((r.doc_id, r.score) for r in toxicity.score(docs, model).collect()))
        assert set(model["thresholds"]) == {"en", "de"}
    assert found[0] == found[1]
    assert all((score >= 0.7) == (i % 4 == 0) for i, score in found[0])


def test_best_thresholds_are_those_of_a_plain_search(spark):
    g = np.random.default_rng(5)
    rows = [(lang, float(np.round(x, 2)), float(x + g.normal(0, 0.2) > 0.6)) for lang in ("a", "b") for x in g.random(400)]
    rows += [("c", 0.2, 0.0), ("", 0.4, 1.0)]
    want = {"c": 0.7}
    for lang in ("a", "b"):
        s, t = (np.array(x) for x in zip(*[r[1:] for r in rows if r[0] == lang]))
        known = np.unique(s)
        cuts = [*((known[1:] + known[:-1]) / 2), 0.7]
        f1 = np.array([2 * t[s >= c].sum() / ((s >= c).sum() + t.sum()) for c in cuts])
        want[lang] = min((abs(c - 0.7), c) for c, f in zip(cuts, f1) if f >= f1.max() - 1e-12)[1]
    found = toxicity.best_thresholds(spark.createDataFrame(rows, "lang string, s double, t double"), 0.7)
    assert found == pytest.approx(want)


def test_toxicity_extends_word_vectors_once_per_batch(spark, monkeypatch):
    """Every text brings a new word; the vectors are copied once for all of them, not once per text."""
    class Counted(toxicity.Filters):
        calls = 0

        def word_vectors(self, rows):
            self.calls += 1
            return super().word_vectors(rows)

    net, made = Counted(), []
    monkeypatch.setattr(toxicity, "map_rows", lambda df, schema, keep, make: made.append(make))
    toxicity.score(documents(spark), {"net": net})
    run, seen = made[0](), toxicity.Vocabulary()
    for start in (0, 200):
        texts = [*(f"common w\xf6rd new{i} " * (i % 9) + f"new{i}" for i in range(start, start + 200)), "", "...", "a"]
        found = run(pa.record_batch({"_text": texts}))[0].to_numpy()
        assert net.calls == 1 + start // 200
        ids = [toxicity.numbered(t, seen) for t in texts]
        plain = toxicity.Filters()
        vectors = plain.word_vectors(seen.rows())
        assert found == pytest.approx([toxicity._sigmoid(plain.logit(vectors[i])) for i in ids])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 40])
def test_toxicity_responses_are_those_of_plain_loops(n):
    net, x = toxicity.Filters(), np.random.default_rng(n).normal(size=(n, toxicity.SIZE)).astype(np.float32)
    want = []
    for w, kernel in zip(toxicity.WIDTHS, net.kernels):
        for f in range(toxicity.FILTERS):
            want.append([sum(float(x[p + i] @ kernel[i, :, f]) for i in range(w) if p + i < n) for p in range(max(n, 1))])
    assert net.responses(x) == pytest.approx(np.array(want), abs=1e-5)


def test_toxicity_training_follows_the_gradient(monkeypatch):
    """Squares of the first step against finite differences of the loss, texts without words included."""
    monkeypatch.setattr(toxicity, "DROPPED", 0.0)
    g, flat = np.random.default_rng(2), toxicity.Flat()
    flat.values[:toxicity.ROWS] *= 10
    start = flat.values.copy()
    rows = g.integers(0, toxicity.ROWS, (30, 4)).astype(np.int32)
    texts, y = [g.integers(0, 30, n).astype(np.int32) for n in (0, 1, 2, 9, 30)], np.array([0.0, 1, 0, 1, 0])

    def loss(at, by):
        flat.values[:] = start
        flat.values[at] += by
        net = flat.net()
        z = np.array([net.logit(net.word_vectors(rows[t])) for t in texts])
        return float(np.mean(np.where(y == 1, 0.5 / 0.4, 0.5 / 0.6) * (np.logaddexp(0, z) - y * z)))

    before = flat.squares.copy()
    toxicity.train(flat, texts, y, rows, 0.4, [0.1])
    squares = flat.squares - before
    spots = [(int(r), c) for r in rows[texts[3]][:3].ravel() for c in (0, 5)]
    spots += [(toxicity.ROWS + i, c) for i in range(0, (sum(toxicity.WIDTHS) * toxicity.SIZE * toxicity.FILTERS + toxicity.POOLED) // toxicity.SIZE, 3)
              for c in (1, 6)]
    want = [((loss(s, 1e-3) - loss(s, -1e-3)) / 2e-3) ** 2 for s in spots]
    assert max(want) > 1e-4
    assert [squares[s] for s in spots] == pytest.approx(want, rel=0.05, abs=2e-5)


def test_toxicity_words_are_runs_of_letters_and_digits():
    plain = re.compile(r"[^\W_]+").findall
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for text in ("".join(every), " ".join(every), "a".join(every), "".join(every[:128]), "a".join(every[:128]), "Snake_case, \u039f\u0394\u039f\u03a3!", "A_b"):
        assert toxicity.words_of(text) == plain(text.lower())
    for word in ("word", "a", "\xfcberall", "\u4e00\u4e8c\u4e09\u56db\u4e94\u516d"):
        assert toxicity.pieces(word) == [toxicity.xxhash.xxh32_intdigest(part.encode(), kind) % toxicity.ROWS
                                         for kind, part in enumerate((word, word[:3], word[:4], word[:5]))]
