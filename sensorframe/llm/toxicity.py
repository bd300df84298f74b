"""Toxicity scores by a convolutional text classifier, trained in numpy on shards of all labelled rows.

A word's vector is the sum of hashed rows of one embedding table: one row for
the word and one each for its first 3, 4 and 5 letters, so unseen forms of a
known stem stay close to it. Filters of width 1, 2 and 3 run over the words, each
filter keeps its largest response in the text (max pooling), and a logistic
layer joins the pooled values. Long and short texts are treated alike, and whole.

The score is calibrated on learnable rows kept apart while training. On the same
rows every language gets a threshold of its own; language decides only the
``flagged`` column, never the score.
"""

from __future__ import annotations

import copy
import re
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorframe.llm.common import map_rows, stored, text_of
from sensorframe.llm.labelled import held_out, texts_of_many
from sensorframe.operators.grouped import give_back
from sensorframe.session import cut_lineage

#: Labelled rows that one copy of the net trains on in a round.
SHARD = 4096
#: How often, at most, the copies are averaged.
ROUNDS = 4
ROWS, SIZE, WIDTHS, FILTERS = 1 << 17, 8, (1, 2, 3), 8
#: Passes over all rows: as many as make so many steps, within these bounds.
STEPS, LEAST, PASSES, BATCH, RATE = 1200, 3, 20, 32, 0.3
#: Share of words left out at random in each pass, so that no word hides behind another.
DROPPED = 0.4
#: Words remembered per worker.
REMEMBER = 200_000
_WORDS = re.compile(r"\w+").findall
#: Everything of ASCII that is no part of a word, as a blank.
_BLANKS = {c: " " for c in range(128) if not chr(c).isalnum()}
POOLED = len(WIDTHS) * FILTERS
#: Kernel rows in the order of the kernels: the pooled value they serve and their place within the filter.
_SERVED = np.concatenate([np.tile(np.arange(j * FILTERS, (j + 1) * FILTERS), w) for j, w in enumerate(WIDTHS)])
_PLACE = np.concatenate([np.repeat(np.arange(w), FILTERS) for w in WIDTHS])
#: The same rows by place, then by width (widths ascend, so a place concerns the last pooled values).
_BY_PLACE = np.argsort(_PLACE, kind="stable")


def pieces(word: str) -> list[int]:
    """Rows of the embedding table for a word: itself and its beginnings."""
    if word.isascii():
        word = word.encode()  # letters are bytes
        parts = (word, word[:3], word[:4], word[:5])
    else:
        parts = (word.encode(), word[:3].encode(), word[:4].encode(), word[:5].encode())
    return [xxhash.xxh32_intdigest(part, kind) % ROWS for kind, part in enumerate(parts)]


class Vocabulary(dict):
    """Numbers words as they come and keeps their table rows."""

    def __init__(self):
        super().__init__()
        self.pieces = array("i")

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.pieces.extend(pieces(word))
        return n

    def rows(self, start: int = 0) -> np.ndarray:
        """Table rows of the words from number ``start`` on."""
        return np.array(self.pieces, np.int32).reshape(-1, 4)[start:]


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, lower-cased."""
    text = text.lower()
    return text.translate(_BLANKS).split() if text.isascii() else _WORDS(text.replace("_", " "))


def numbered(text: str, seen: Vocabulary) -> np.ndarray:
    """Word numbers of a text."""
    words = words_of(text)
    return np.fromiter(map(seen.__getitem__, words), np.int32, len(words))


# -------------------------------------------------------------------- network
class Filters:
    """Embedding table, filters (width, place, vector, filter) and the logistic layer."""

    def __init__(self, seed: int = 1):
        g = np.random.default_rng(seed)
        self.table = g.normal(0, 0.05, (ROWS, SIZE)).astype(np.float32)
        self.kernels = [g.normal(0, 0.4, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out, self.bias = g.normal(0, 0.3, POOLED).astype(np.float32), np.full(1, -1.0, np.float32)
        self.platt = (1.0, 0.0)

    def word_vectors(self, rows: np.ndarray) -> np.ndarray:
        return self.table[rows].sum(axis=1)

    def stacked(self) -> np.ndarray:
        """All kernel rows (place in the filter and filter, by width) x vector."""
        return np.concatenate([k.transpose(0, 2, 1).reshape(-1, SIZE) for k in self.kernels])

    def responses(self, x: np.ndarray, stacked: np.ndarray | None = None) -> np.ndarray:
        """Responses of all filters (pooled value x place) along a text (words x vector), at least one place each."""
        if not len(x):
            return np.zeros((POOLED, 1), np.float32)
        each = (self.stacked() if stacked is None else stacked)[_BY_PLACE] @ x.T
        out, at = each[:POOLED], POOLED
        for i in range(1, WIDTHS[-1]):
            n = FILTERS * sum(w > i for w in WIDTHS)
            if i < len(x):  # words beyond the end count as zero
                out[-n:, :-i] += each[at:at + n, i:]
            at += n
        return out

    def pooled(self, x: np.ndarray, stacked: np.ndarray | None = None) -> np.ndarray:
        return self.responses(x, stacked).max(axis=1)

    def logit(self, x: np.ndarray, stacked: np.ndarray | None = None) -> float:
        return float(np.maximum(self.pooled(x, stacked), 0) @ self.out + self.bias[0])

    def logits(self, texts: list[np.ndarray], vectors: np.ndarray) -> list[float]:
        """Logits of numbered texts; ``vectors`` are those of every word number."""
        stacked = self.stacked()
        return [self.logit(vectors.take(ids, axis=0), stacked) for ids in texts]


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, float)))


def _accumulate(value: np.ndarray, squares: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """One step of Adagrad in place."""
    squares += grad * grad
    value -= (rate * grad / np.sqrt(squares + 1e-6)).astype(np.float32)


class Flat:
    """The net and its Adagrad squares as two matrices of ``SIZE`` columns: the table, then filters, output and bias."""

    def __init__(self, seed: int = 1):
        net = Filters(seed)
        rest = np.concatenate([k.ravel() for k in net.kernels] + [net.out, net.bias]).astype(np.float32)
        self.dense = -(-len(rest) // SIZE)
        self.values = np.concatenate([net.table, np.resize(rest, (self.dense, SIZE))])
        self.squares = np.full_like(self.values, 1e-2)
        self.squares[:ROWS] = 1e-3

    def parts(self, of: np.ndarray) -> tuple:
        """Views of a matrix: table, kernels, out, bias (one number)."""
        flat, kernels, at = of[ROWS:].reshape(-1), [], 0
        for w in WIDTHS:
            size = w * SIZE * FILTERS
            kernels.append(flat[at:at + size].reshape(w, SIZE, FILTERS))
            at += size
        return of[:ROWS], kernels, flat[at:at + POOLED], flat[at + POOLED:at + POOLED + 1]

    def net(self) -> Filters:
        net = Filters.__new__(Filters)
        net.table, net.kernels, net.out, net.bias = self.parts(self.values)
        net.platt = (1.0, 0.0)
        return net


def train(flat: Flat, texts: list[np.ndarray], labels: np.ndarray, rows: np.ndarray, share: float,
          rates: list[float], seed: int = 1) -> None:
    """Passes over numbered texts, one for each rate, in place; ``rows`` are the table rows of every word number.

    ``share``: that of toxic texts among all that are learned from.
    """
    net, g = flat.net(), np.random.default_rng(seed)
    squares = dict(zip(("table", "kernels", "out", "bias"), flat.parts(flat.squares)))
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    first, *others = np.ascontiguousarray(rows.T)
    every = np.arange(POOLED)
    for rate in rates:
        order = g.permutation(len(texts))
        for batch in np.array_split(order, max(1, len(order) // BATCH)):
            stacked = net.stacked()
            g_out, g_bias, g_stacked = np.zeros(POOLED), 0.0, np.zeros(stacked.shape)
            touched, grads = [], []
            for t in batch:
                ids = texts[t]
                ids = ids[g.random(len(ids)) >= DROPPED]
                x = net.table.take(first.take(ids), axis=0)
                for other in others:
                    x += net.table.take(other.take(ids), axis=0)
                res = net.responses(x, stacked)
                at = res.argmax(axis=1)
                best = res[every, at]
                hid = np.maximum(best, 0)
                d = float((_sigmoid(hid @ net.out + net.bias[0]) - labels[t]) * weight[t]) / len(batch)
                g_out += d * hid
                g_bias += d
                back = (d * net.out * (best > 0))[_SERVED, None]
                place = at[_SERVED] + _PLACE
                ok = np.flatnonzero(place < len(ids))
                place, back = place[ok], back[ok]
                g_stacked[ok] += x[place] * back
                touched.append(rows[ids[place]])
                grads.append(stacked[ok] * back)
            if touched:
                hit, inverse = np.unique(np.concatenate(touched), return_inverse=True)
                parts = np.repeat(np.concatenate(grads), rows.shape[1], axis=0)
                total = np.stack([np.bincount(inverse.reshape(-1), part, len(hit)) for part in parts.T], axis=1)
                sq = squares["table"][hit]
                value = net.table[hit]
                _accumulate(value, sq, total, rate)
                net.table[hit], squares["table"][hit] = value, sq
            done = 0
            for k, sq in zip(net.kernels, squares["kernels"]):
                mine = g_stacked[done:done + len(k) * FILTERS].reshape(len(k), FILTERS, SIZE)
                _accumulate(k, sq, mine.transpose(0, 2, 1), rate)
                done += len(k) * FILTERS
            _accumulate(net.out, squares["out"], g_out, rate)
            _accumulate(net.bias, squares["bias"], np.array([g_bias]), rate)


# ------------------------------------------------------------------- learning
def packed_shards(docs: DataFrame, known: DataFrame, shards: int) -> DataFrame:
    """All learnable labelled texts, numbered: one row per shard, written once.

    Texts and labels of an id meet in its shard, so texts are shuffled once. Of
    several texts of an id the smallest one is read.
    """
    shard = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(shards)).alias("shard")
    texts = texts_of_many(docs.withColumn("text", text_of()), known, "lang").select(
        shard, "doc_id", F.struct("text", "lang").alias("row"), F.lit(None).cast("double").alias("toxic"))
    marks = known.select(shard, "doc_id", F.lit(None).cast(texts.schema["row"].dataType).alias("row"),
                         F.col("toxic").cast("double").alias("toxic"))
    met = texts.unionByName(marks).repartition("shard").groupBy("shard", "doc_id").agg(
        F.min("row").alias("row"), F.max("toxic").alias("toxic")).where("row IS NOT NULL AND toxic IS NOT NULL")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, seen = pdf.sort_values("doc_id"), Vocabulary()
        texts = [numbered(t, seen) for t in pdf["text"]]
        apart = np.array([xxhash.xxh32_intdigest(str(i)) % 5 == 0 for i in pdf["doc_id"].tolist()], bool)
        y = pdf["toxic"].to_numpy(float)
        out = {"shard": pdf["shard"].iat[0], "y": y.tobytes(), "apart": apart.tobytes(), "lang": list(pdf["lang"].fillna("")),
               "table": seen.rows().tobytes(), "ids": np.concatenate(texts).astype(np.int32).tobytes(),
               "sizes": np.array([len(t) for t in texts], np.int64).tobytes(), "n": int((~apart).sum()),
               "toxic": int(y[~apart].sum()), "n_apart": int(apart.sum()), "toxic_apart": int(y[apart].sum())}
        return pd.DataFrame([out])

    return stored(met.select("shard", "doc_id", "row.text", "row.lang", "toxic").groupBy("shard").applyInPandas(
        pack, "shard long, y binary, apart binary, lang array<string>, table binary, ids binary, sizes binary, "
              "n long, toxic long, n_apart long, toxic_apart long"), "toxic")


def _opened(b: pa.RecordBatch):
    """Shard, labels, apart, languages, table rows of its words and numbered texts, shard by shard."""
    for i in range(b.num_rows):
        r = {c: b.column(c)[i].as_py() for c in ("shard", "y", "apart", "lang", "table", "ids", "sizes")}
        ends = np.cumsum(np.frombuffer(r["sizes"], np.int64))[:-1]
        yield (r["shard"], np.frombuffer(r["y"]), np.frombuffer(r["apart"], bool), r["lang"],
               np.frombuffer(r["table"], np.int32).reshape(-1, 4), np.split(np.frombuffer(r["ids"], np.int32), ends))


#: Changes are added up as whole numbers of this unit, so the sums do not depend on the partitioning.
UNIT = 2.0 ** -36
_CHANGES = [f"{kind}{i}" for kind in "vs" for i in range(SIZE)]


def train_round(packed: DataFrame, flat: Flat, share: float, rates: list[float], seed: int) -> None:
    """Every shard trains a copy of the net; each row of the net moves by the mean of the shards that moved it."""
    def run(batches):
        total, count = None, np.zeros(len(flat.values), np.int64)
        for b in batches:
            for shard, y, apart, _, table, texts in _opened(b):
                mine = copy.deepcopy(flat)
                train(mine, [t for t, a in zip(texts, apart) if not a], y[~apart], table, share, rates, seed + shard)
                at = np.flatnonzero((mine.values != flat.values).any(axis=1) | (mine.squares != flat.squares).any(axis=1))
                moved = np.concatenate([now[at].astype(float) - was[at] for now, was in
                                        ((mine.values, flat.values), (mine.squares, flat.squares))], axis=1)
                moved = np.rint(moved / UNIT).astype(np.int64)
                total = np.zeros((len(count), 2 * SIZE), np.int64) if total is None else total
                total[at] += moved
                count[at] += moved.any(axis=1)
        if total is not None:
            hit = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(count[hit]), *[pa.array(x) for x in total[hit].T]],
                                             ["row", "n", *_CHANGES])
        give_back()

    sums = packed.mapInArrow(run, "row long, n long, " + ", ".join(f"{c} long" for c in _CHANGES)).groupBy("row").agg(
        *[F.sum(c).alias(c) for c in ("n", *_CHANGES)]).toArrow()
    at, n = (sums.column(c).to_numpy() for c in ("row", "n"))
    mean = np.stack([sums.column(c).to_numpy() for c in _CHANGES], axis=1) * UNIT / n[:, None]
    flat.values[at] = (flat.values[at] + mean[:, :SIZE]).astype(np.float32)
    flat.squares[at] = (flat.squares[at] + mean[:, SIZE:]).astype(np.float32)


def logits(packed: DataFrame, net: Filters, every: bool) -> DataFrame:
    """``lang``, ``z`` and ``t`` (the label) of the rows kept apart, or of ``every`` one."""
    def run(batches):
        for b in batches:
            for _, y, apart, lang, table, texts in _opened(b):
                vectors = net.word_vectors(table)
                on = np.flatnonzero(apart | every)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang[i] for i in on], pa.string()),
                     pa.array(net.logits([texts[i] for i in on], vectors), pa.float64()), pa.array(y[on])], ["lang", "z", "t"])
        give_back()
    return cut_lineage(packed.mapInArrow(run, "lang string, z double, t double"))


def _score_of(z: Column) -> Column:
    return 0.5 * (1 + F.tanh(0.5 * z))


def _sums(rows: DataFrame, *values: Column) -> np.ndarray:
    """Exact sums: the same whatever the partitioning."""
    return np.array([float(x or 0) for x in rows.agg(*[F.sum(v.cast("decimal(38,18)")) for v in values]).first()])


def platt(rows: DataFrame, steps: int = 300) -> tuple[float, float]:
    """Slope and offset that make sigmoid(slope * z + offset) a probability of ``t``; slope stays positive."""
    z, t, one = F.col("z"), F.col("t"), F.lit(1.0)
    n, n1, size = _sums(rows, one, t, F.abs(z))
    scale = size / n + 1e-6
    # the usual smoothed targets keep the fit finite when the classes are far apart
    want = F.when(t == 1, (n1 + 1) / (n1 + 2)).otherwise(1 / (n - n1 + 2))
    z, a, b = z / scale, 1.0, 0.0
    for _ in range(steps):
        p = _score_of(a * z + b)
        e, h = p - want, F.greatest(p * (1 - p), F.lit(1e-9))
        ez, e1, hzz, hz, h1 = _sums(rows, e * z, e, h * z * z, h * z, h) / n
        da, db = np.linalg.solve(np.array([[hzz, hz], [hz, h1]]) + 1e-6 * np.eye(2), np.array([ez, e1]))
        before, (a, b) = (a, b), (max(1e-3, a - float(np.clip(da, -1, 1))), b - float(np.clip(db, -1, 1)))
        if max(abs(a - before[0]), abs(b - before[1])) < 1e-12:
            break
    return a / scale, b


def best_thresholds(rows: DataFrame, usual: float) -> dict[str, float]:
    """By language, the threshold of the best F1 of ``s`` for ``t``, the one nearest to ``usual`` on ties; ``usual`` without both classes.

    Cuts lie between neighbouring scores. Scores are counted in narrow bins and
    ranked inside each, so no language is sorted whole; one row per language is broadcast.
    """
    s, t = F.col("s"), F.col("t")
    place = F.floor(16 * (F.log(F.greatest(s, F.lit(1e-300))) - F.log(F.greatest(1 - s, F.lit(1e-17)))))
    per = rows.where("lang <> ''").groupBy("lang", place.alias("bin"), "s").agg(F.count(t).alias("n"), F.sum(t).alias("hits"))
    per = cut_lineage(per)
    above = Window.partitionBy("lang").orderBy(F.col("bin").desc())
    earlier = above.rowsBetween(Window.unboundedPreceding, -1)
    bins = per.groupBy("lang", "bin").agg(F.sum("n").alias("_n"), F.sum("hits").alias("_hits"), F.max("s").alias("_top")).select(
        "lang", "bin", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"),
        F.coalesce(F.sum("_hits").over(earlier), F.lit(0.0)).alias("_hits"), F.lead("_top").over(above).alias("_below"))
    whole = per.groupBy("lang").agg(F.sum("n").alias("all"), F.sum("hits").alias("toxic"))
    down = Window.partitionBy("lang", "bin").orderBy(s.desc())
    cuts = per.join(bins, ["lang", "bin"]).select(
        "lang", ((s + F.coalesce(F.lead(s).over(down), F.col("_below"))) / 2).alias("cut"), F.lit(0).alias("last"),
        (F.col("_n") + F.sum("n").over(down)).alias("n"), (F.col("_hits") + F.sum("hits").over(down)).alias("hits"))
    plain = per.groupBy("lang").agg(*[F.sum(F.when(s >= usual, F.col(c)).otherwise(0)).alias(c) for c in ("n", "hits")]).select(
        "lang", F.lit(usual).alias("cut"), F.lit(1).alias("last"), "n", "hits")
    f1 = 2 * F.col("hits") / F.greatest(F.lit(1), F.col("n") + F.col("toxic"))
    cuts = cut_lineage(cuts.where("cut IS NOT NULL").unionByName(plain).join(F.broadcast(whole), "lang").select(
        "lang", "cut", "last", f1.alias("f1"), ((F.col("toxic") > 0) & (F.col("toxic") < F.col("all"))).alias("both")))
    best = cuts.groupBy("lang").agg(F.max("f1").alias("_best"))
    near = cuts.join(F.broadcast(best), "lang").where(F.col("f1") >= F.col("_best") - 1e-12).groupBy("lang", "both").agg(
        F.min(F.struct(F.abs(F.col("cut") - usual).alias("away"), "last", "cut")).alias("_cut"))
    return {r.lang: float(r.cut) if r.both else usual for r in near.select("lang", "both", "_cut.cut").orderBy("lang").collect()}


def fit(docs: DataFrame, labels: DataFrame, usual: float = 0.7, shard_rows: int = SHARD) -> dict:
    """A model from every learnable row of ``labels.toxic`` that has a text.

    An id with several labels is toxic if one says so; of several texts of an id
    the smallest one is read. The rows are dealt by a hash of their id to shards
    of about ``shard_rows``; in each round all shards train side by side from the
    same net, and their changes are averaged. One in five rows calibrates.
    Without both classes every text scores 0.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    shards = max(1, -(-known.count() // shard_rows))
    packed = packed_shards(docs, known, shards)
    n, toxic, n_apart, toxic_apart = (int(x or 0) for x in packed.agg(
        *[F.sum(c) for c in ("n", "toxic", "n_apart", "toxic_apart")]).first())
    if n + n_apart < 5 or not n or toxic + toxic_apart in (0, n + n_apart):
        return {"net": None, "usual": usual, "thresholds": {}}
    share = float(np.clip(toxic / n, 0.02, 0.98))
    passes = min(PASSES, max(LEAST, -(-STEPS * BATCH // n)))
    rates = [RATE * (1 - turn / passes) for turn in range(passes)]
    rounds = np.array_split(rates, 1 if shards == 1 else min(ROUNDS, passes))
    flat = Flat()
    for turn, some in enumerate(rounds):
        train_round(packed, flat, share, some, 1 + turn * shards)
    net = flat.net()
    rows = logits(packed, net, every=toxic_apart in (0, n_apart))
    net.platt = platt(rows)
    scored = rows.withColumn("s", _score_of(net.platt[0] * F.col("z") + net.platt[1]))
    return {"net": net, "usual": usual, "thresholds": best_thresholds(scored, usual)}


def score(docs: DataFrame, model: dict, keep=("doc_id",), text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) of every whole text, null ones as empty; all rows come back."""
    net = model["net"]

    def make():
        seen, vectors = Vocabulary(), np.zeros((0, SIZE), np.float32)

        def run(b: pa.RecordBatch) -> list:
            nonlocal seen, vectors
            if net is None:
                return [pa.array(np.zeros(b.num_rows))]
            if len(seen) > REMEMBER:
                seen, vectors = Vocabulary(), vectors[:0]
            texts = [numbered(t.as_py(), seen) for t in b.column("_text")]
            if len(seen) > len(vectors):  # once for all texts, as this copies the vectors
                vectors = np.concatenate([vectors, net.word_vectors(seen.rows(len(vectors)))])
            return [pa.array(_sigmoid(net.platt[0] * np.array(net.logits(texts, vectors)) + net.platt[1]))]
        return run

    return map_rows(docs.select(*keep, text_of(text).alias("_text")), "score double", keep, make)


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` (score >= cut), and ``flagged``:
    whether the score reaches the threshold of the row's language (``cut`` for an unknown one)."""
    model = fit(docs, labels, usual=cut)
    limit = F.lit(cut)
    for lang, at in model["thresholds"].items():
        limit = F.when(F.col("lang") == lang, F.lit(at)).otherwise(limit)
    return score(docs, model, ["doc_id", "lang"]).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"),
        limit.alias("threshold"), (F.col("score") >= limit).alias("flagged"))
