"""Phrase collocations, counted in HAT-tries.

Words are first counted by language; each word that is frequent enough for a
phrase gets a number, the most frequent ones the smallest. Then every task walks
its texts and counts the three words that start at each place (zero where a
phrase cannot go on) in a HAT-trie: a shallow trie over word numbers whose leaves
are hash containers. A container that grows too large bursts into one container
per next word. When the trie holds more than its share of memory, the largest
subtrees leave it whole, as a sorted run.

All runs are merged per prefix partition: the rows of one pair of words meet in
one partition, where the counts of three words are added up and, over all third
words, those of the pair. Pairs of two very frequent words, the only ones that
may be hot, are dealt by all three words instead.

Scores, cuts and the test against longer phrases are joins of counted phrases.
Nothing is dropped before it is known to be too rare: a phrase is never more
frequent than one of its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorframe.llm.common import SLICE_BYTES, stored, utf8_of

#: Words with a small number of their own; a task holds them. Others go by their hash.
VOCABULARY = 1 << 20
#: Pairs of words of numbers up to this are dealt by all three words: any other pair has at most 1 / 256 of all places.
HOT = 256
#: Distinct words a task counts, entries a container holds, and entries a trie holds before it gives some up.
COUNTED, BURST, ENTRIES = 300_000, 4096, 1_500_000
#: Shards of a language that are ranked side by side.
SHARDS = 32
_BITS = 21
_LOW, _TWO = (1 << _BITS) - 1, (1 << 2 * _BITS) - 1
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"." * 10)


def marked_words(text: bytes) -> list[bytes]:
    """The words of a text in lower case (A-Z only), a full stop wherever a piece ends."""
    return text.lower().translate(_ENDS).replace(b".", b" . ").split()


def word_hash(lang: str, word: bytes, seed: int) -> int:
    """A number above all those of the vocabulary."""
    return xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + word, seed) >> 2 | 1 << 62


# ----------------------------------------------------------------- HAT-trie
class _Node(dict):
    """Second word -> container of third words."""


class HatTrie:
    """Counts of up to three word numbers, packed as first << 42 | second << 21 | third."""

    def __init__(self, burst: int = BURST, entries: int = ENTRIES):
        self.root: dict[int, dict] = {}
        self.size: dict[int, int] = {}
        self.burst, self.most, self.held = burst, entries, 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add counts of sorted distinct keys."""
        if not len(keys):
            return
        first = keys >> 2 * _BITS
        edges = np.append(np.flatnonzero(np.diff(first, prepend=-1)), len(keys)).tolist()
        heads, rest, counts = first[edges[:-1]].tolist(), (keys & _TWO).tolist(), counts.tolist()
        root, size = self.root, self.size
        for w, a, b in zip(heads, edges, edges[1:]):
            box = root.get(w)
            if box is None:
                box = root[w] = dict(zip(rest[a:b], counts[a:b]))
                size[w] = new = b - a
            elif type(box) is _Node:
                new = self._below(box, rest[a:b], counts[a:b])
                size[w] += new
            else:
                before = len(box)
                for r, c in zip(rest[a:b], counts[a:b]):
                    box[r] = box.get(r, 0) + c
                new = len(box) - before
                size[w] += new
            if len(box) > self.burst and type(box) is not _Node:
                root[w] = node = _Node()
                self._below(node, box.keys(), box.values())
            self.held += new

    @staticmethod
    def _below(node: _Node, rest, counts) -> int:
        new = 0
        for r, c in zip(rest, counts):
            box = node.get(r >> _BITS)
            if box is None:
                box = node[r >> _BITS] = {}
            third = r & _LOW
            if third in box:
                box[third] += c
            else:
                box[third] = c
                new += 1
        return new

    def spill(self, down_to: int) -> tuple[np.ndarray, np.ndarray]:
        """Take out the largest subtrees until ``down_to`` entries are left: sorted keys and their counts."""
        keys, counts = [], []
        for w in sorted(self.size, key=self.size.get, reverse=True):
            if self.held <= down_to:
                break
            box, n = self.root.pop(w), self.size.pop(w)
            self.held -= n
            if type(box) is _Node:
                rest = [s << _BITS | t for s, b in box.items() for t in b]
                counts.append(np.fromiter((c for b in box.values() for c in b.values()), np.int64, n))
            else:
                rest = box.keys()
                counts.append(np.fromiter(box.values(), np.int64, n))
            keys.append(np.fromiter(rest, np.int64, n) | w << 2 * _BITS)
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys)
        return keys[order], counts[order]

    def full(self) -> bool:
        return self.held > self.most


class Numbers(dict):
    """Word -> number within the task: that of the vocabulary; 0 or a number of its own for others."""

    def __init__(self, lang: str, known: dict[bytes, int], owner: Task):
        super().__init__(known)
        self[b"."] = 0
        self.lang, self.owner = lang, owner

    def __missing__(self, word: bytes) -> int:
        return self.owner.other(self.lang, word, self)


class Task:
    """The trie of one task and the numbers of its words."""

    def __init__(self, known: dict[str, dict[bytes, int]], complete: bool, seed: int, burst: int, entries: int, vocabulary: int):
        self.known, self.complete, self.seed, self.base, self.most = known, complete, seed, vocabulary, _LOW
        self.trie, self.by_lang, self.others = HatTrie(burst, entries), {}, []

    def other(self, lang: str, word: bytes, numbers: Numbers) -> int:
        if self.complete:  # not in the whole vocabulary: too rare
            return 0
        self.others.append(word_hash(lang, word, self.seed))
        numbers[word] = at = self.base + len(self.others)
        return at

    def count(self, texts: list[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
        places: list[int] = []
        for lang, text in texts:
            words = marked_words(text)
            if len(self.others) + len(words) + self.base >= self.most:  # numbers run out: all counted so far leaves
                self._take(places)
                places = []
                yield from self.runs(0)
                self.others, self.by_lang = [], {}
                if len(words) + self.base >= self.most and not self.complete:
                    yield from self._long(lang, words)
                    continue
            numbers = self.by_lang.get(lang)
            if numbers is None:
                numbers = self.by_lang[lang] = Numbers(lang, self.known.get(lang, {}), self)
            places += map(numbers.__getitem__, words)
            places += (0, 0)
        self._take(places)
        if self.trie.full():
            yield from self.runs(self.trie.most // 2)

    def _long(self, lang: str, words: list[bytes]) -> Iterator[pa.RecordBatch]:
        """A text that might use up all numbers by itself, in overlapping parts."""
        part = (self.most - self.base) // 2
        for at in range(0, len(words), part):
            numbers = Numbers(lang, self.known.get(lang, {}), self)
            here = list(map(numbers.__getitem__, words[at:at + part + 2]))
            self._take(here + [0, 0], min(part, len(here)))
            yield from self.runs(0)
            self.others = []

    def _take(self, places: list[int], starts: int | None = None) -> None:
        """Count what starts at each place (the first ``starts`` ones)."""
        if len(places) < 3:
            return
        w = np.array(places, np.int64)
        a, b, c = w[:-2], w[1:-1], w[2:]
        take = (a > 0) & (b > 0)
        if starts is not None:
            take[starts:] = False
        self.trie.add(*np.unique((a << 2 * _BITS | b << _BITS | c)[take], return_counts=True))

    def runs(self, down_to: int) -> Iterator[pa.RecordBatch]:
        keys, counts = self.trie.spill(down_to)
        others = np.array(self.others, np.int64)
        for at in range(0, len(keys), 1 << 18):
            k, columns = keys[at:at + (1 << 18)], []
            for w in (k >> 2 * _BITS, k >> _BITS & _LOW, k & _LOW):
                if len(others):
                    own = w > self.base
                    w[own] = others[w[own] - self.base - 1]
                columns.append(pa.array(w))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts[at:at + (1 << 18)])], ["w1", "w2", "w3", "n"])


# --------------------------------------------------------------------- jobs
def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, bytes]]]:
    for b in batches:
        step = max(1, b.num_rows * SLICE_BYTES // max(1, b.nbytes))
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            yield list(zip(part.column("_lang").to_pylist(), part.column("_text").to_pylist()))


def word_counts(source: DataFrame, seed: int = 0) -> DataFrame:
    """``lang``, ``word`` (UTF-8), ``f`` and ``h`` (its hash) of every word of ``_text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush():
            for lang, c in counts.items():
                c.pop(b".", None)
                words = list(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array(list(c.values()), pa.int64()),
                     pa.array([word_hash(lang, w, seed) for w in words], pa.int64())], ["lang", "word", "n", "h"])
            counts.clear()

        for texts in _slices(batches):
            for lang, text in texts:
                counts.setdefault(lang, Counter()).update(marked_words(text))
            if sum(map(len, counts.values())) > COUNTED:
                yield from flush()
        yield from flush()

    parts = source.mapInArrow(run, "lang string, word binary, n bigint, h bigint")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("f"), F.min("h").alias("h"))


def numbered(words: DataFrame, vocabulary: int) -> DataFrame:
    """``lang``, ``word``, ``f``, ``id`` of the ``vocabulary`` most frequent words (a bounded table, so one task may number it)."""
    order = [F.desc("f"), F.col("lang"), F.col("word")]
    return (words.orderBy(*order).limit(vocabulary)
            .select("lang", "word", "f", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("id")))


def gram_counts(source: DataFrame, top: DataFrame, complete: bool, seed: int, min_count: int, vocabulary: int,
                burst: int, entries: int) -> DataFrame:
    """``w1``, ``w2``, ``w3`` (0 in a pair), ``a`` of all pairs and triples found ``min_count`` times or more."""
    known: dict[str, dict[bytes, int]] = {}
    columns = top.select("lang", "word", "id").toArrow()
    for lang, word, at in zip(*[columns.column(c).to_pylist() for c in ("lang", "word", "id")]):
        known.setdefault(lang, {})[word] = at
    held = source.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Task(held.value, complete, seed, burst, entries, vocabulary)
        for texts in _slices(batches):
            yield from task.count(texts)
        yield from task.runs(0)

    runs = stored(source.mapInArrow(run, "w1 bigint, w2 bigint, w3 bigint, n bigint"), "runs")
    hot = (F.col("w1") <= HOT) & (F.col("w2") <= HOT)
    parts = []
    for rows in (runs.where(~hot).repartition("w1", "w2"), runs.where(hot)):
        triples = rows.groupBy("w1", "w2", "w3").agg(F.sum("n").alias("a"))
        pairs = triples.groupBy("w1", "w2").agg(F.sum("a").alias("a"))
        # said of the sum, so that the filter stays above it and both read one shuffle
        parts += [triples.where(F.when(F.col("w3") > 0, F.col("a")).otherwise(0) >= min_count),
                  pairs.where(F.col("a") >= min_count).select("w1", "w2", F.lit(0).cast("bigint").alias("w3"), "a")]
    return reduce(DataFrame.unionByName, parts)


def score_of(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)) in whole numbers of up to 38 digits."""
    a, left, right = (f"cast({x} as decimal(18,0))" for x in (a, left, right))
    return F.expr(f"cast({a} * {a} * 1000000bd div ({left} * {right}) as bigint)")


def collocations(docs: DataFrame, min_count: int = 10, top: int = 2000, lang: str = "lang", text: str = "text",
                 vocabulary: int = VOCABULARY, burst: int = BURST, entries: int = ENTRIES) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: each language's ``top`` phrases of 2 or 3 words.

    A null language is ``und``; a null or empty text has no words. Repeated rows
    count each time. The order is score (falling), count (falling), phrase, so
    ties have one outcome. Counts up to 10^15 are exact. An empty table gives an
    empty result.
    """
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("_lang"), utf8_of(text).alias("_text"))
    seed = 0
    while True:
        words = stored(word_counts(source, seed), "words")
        frequent = words.where(F.col("f") >= min_count)
        complete = frequent.count() <= vocabulary
        if complete or words.groupBy("h").count().where("count > 1").isEmpty():
            break
        seed += 1  # two words share a hash
    known = stored(numbered(frequent, vocabulary), "vocabulary")
    named = known
    if not complete:
        rest = frequent.join(known.select("lang", "word"), ["lang", "word"], "left_anti")
        named = known.unionByName(rest.select("lang", "word", "f", F.col("h").alias("id")))
    grams = stored(gram_counts(source, known, complete, seed, min_count, vocabulary, burst, entries), "phrases")
    return _ranked(grams, named, words.groupBy("lang").agg(F.sum("f").alias("n")), top)


def _ranked(grams: DataFrame, named: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    def word(i: int) -> DataFrame:
        return named.select(F.col("id").alias(f"w{i}"), F.col("word").cast("string").alias(f"word{i}"), F.col("f").alias(f"f{i}"),
                            *([F.col("lang")] if i == 1 else []))

    pairs, triples = grams.where("w3 = 0").select("w1", "w2", "a"), grams.where("w3 > 0")
    inside = triples.select("w1", "w2", "a").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longer = inside.groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    two = (pairs.join(longer, ["w1", "w2"], "left").where("longer is null or 100 * longer < 50 * a")
           .join(word(1), "w1").join(word(2), "w2")
           .select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"),
                   score_of("a", "f1", "f2").alias("score")))
    head = pairs.withColumnRenamed("a", "a12")
    tail = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("a23"))
    three = (triples.join(head, ["w1", "w2"]).join(tail, ["w2", "w3"]).join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
             .withColumn("s1", score_of("a", "f1", "a23")).withColumn("s2", score_of("a", "a12", "f3"))
             .select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a",
                     F.expr("if(s1 <= s2, f1, a12)").alias("l"), F.expr("if(s1 <= s2, a23, f3)").alias("r"),
                     F.least("s1", "s2").alias("score")))
    best = _first(stored(two.unionByName(three), "scored"), top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _first(scored: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of every language with their ``rank``, though one language may hold most rows.

    Counts of coarse score levels tell the level that the last place falls into;
    rows below it go. The best of each hashed shard are ranked then, so that a
    level with very many rows is cut in parallel too.
    """
    level = F.floor(F.log2(F.col("score") + F.lit(1.0)) * 16).alias("level")
    higher = Window.partitionBy("lang").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    lowest = (scored.groupBy("lang", level).count()
              .withColumn("higher", F.coalesce(F.sum("count").over(higher), F.lit(0))).where(F.col("higher") < top)
              .groupBy("lang").agg(F.min("level").alias("lowest")))
    rows = scored.join(lowest, "lang").where(F.floor(F.log2(F.col("score") + F.lit(1.0)) * 16) >= F.col("lowest"))
    shard = F.pmod(F.xxhash64("phrase"), F.lit(SHARDS))
    rows = rows.withColumn("shard", shard).withColumn("few", shard % 4)
    for keys in (["lang", "shard"], ["lang", "few"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
        rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return rows.drop("shard", "few", "lowest")
