"""Registered queries of the corpus operators and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sensorframe.llm import (bit_sliced, byte_bpe, licences, line_dedup, mixing, near_dup, neighbours, phrases, quality, secrets,
                             surrogates, toxicity, whitening)
from sensorframe.llm.common import table
from sensorframe.session import scratch_path, ship_packages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_packages(spark)
        return fn(spark, sf_dir)
    QUERIES[fn.__name__] = run
    return run


# ------------------------------------------------------------------------- 1
@query
def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with keyed surrogates in place of personal data."""
    return surrogates.replace(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------------- 2
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes they decode to."""
    model = byte_bpe.serialise_model(byte_bpe.read_ranks(VOCABULARY))
    coded = byte_bpe.encode(table(spark, sf_dir, "documents"), model, public_tokenizers.PATTERN)
    back = byte_bpe.decode(coded, model, ["doc_id", "n_tokens", "ids_sha256"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


# ------------------------------------------------------------------------- 3
@query
def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document by sentence and licence rules."""
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "sequence", F.array_join("licences", ",").alias("licences"), "rest")


ORACLES["op3_licence_scan"] = licences.plain_sql()


# ------------------------------------------------------------------------- 4
@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, scanned by distinct text.

    The ledger is kept in the folder that ``sensorframe.secrets.ledger`` names in the
    session, so that a later run scans only what is new; unset, it is a fresh one.
    """
    ledger = spark.conf.get("sensorframe.secrets.ledger", None) or scratch_path(spark, "secrets")
    found = secrets.scan(table(spark, sf_dir, "documents"), path=ledger)
    def of(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = of(*[r.kind for r in secrets.BASE_RULES])
    return found.select("doc_id", *[F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in secrets.BASE_RULES],
                        F.sha2(secrets.listing(base), 256).alias("base_sha256"),
                        secrets.listing(F.col("spans")).alias("spans"))


# ------------------------------------------------------------------------- 5
@query
def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every fiftieth one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v")
    return neighbours.nearest(rows, queries)


# ------------------------------------------------------------------------- 6
@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a convolutional classifier."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# ------------------------------------------------------------------------- 7
@query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents of similarity 0.75 or more."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------------- 8
@query
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents with weights 1, 2, 3, repeating, by source."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op8_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS place, sum(source_size) OVER ()::DOUBLE AS total FROM s),
r AS (SELECT *, 3.0::DOUBLE * source_size / weight AS ratio FROM w),
l AS (SELECT *, (total - coalesce(sum(3.0::DOUBLE * source_size) OVER b, 0))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM r WINDOW b AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size,
             CASE WHEN ratio <= max(level) FILTER (level <= ratio) OVER () THEN 3.0::DOUBLE * source_size
                  ELSE max(level) FILTER (level <= ratio) OVER () * weight END::DOUBLE AS target FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats FROM t),
run AS (SELECT source, h, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto, sum(size) AS here
        FROM d GROUP BY source, h),
edge AS (SELECT run.source, min(struct_pack(h := h, upto := upto, here := here)) AS e, any_value(target - repeats * source_size) AS wanted
         FROM run JOIN q ON run.source IS NOT DISTINCT FROM q.source
         WHERE here > 0 AND upto >= target - repeats * source_size GROUP BY run.source),
cut AS (SELECT source, CASE WHEN e.upto - wanted <= wanted - (e.upto - e.here) THEN e.h + 1 ELSE e.h END AS threshold FROM edge)
SELECT d.doc_id, d.size, q.source_size, q.target,
       ((q.repeats + CASE WHEN d.h < coalesce(cut.threshold, 1) THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN cut ON d.source IS NOT DISTINCT FROM cut.source
"""


# ------------------------------------------------------------------------- 9
@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from good and unlabelled texts."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# ------------------------------------------------------------------------ 10
@query
def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector."""
    rows = bit_sliced.whole_numbers(table(spark, sf_dir, "embeddings"))
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("w"))
    return bit_sliced.search(bit_sliced.build_index(rows), queries, k=10)


ORACLES["op10_exact_top_k"] = """
WITH v AS (SELECT vec_id, [floor(x::DOUBLE * 1024) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM p
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""


# ------------------------------------------------------------------------ 11
@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 leading whitened components of every embedding."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)


# ------------------------------------------------------------------------ 12
@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand in ten documents or more."""
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, first=False)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op12_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY row, doc_id
"""


# ------------------------------------------------------------------------ 13
@query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest collocations of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"), min_count=10, top=2000)


ORACLES["op13_phrase_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
s AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM s),
g AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM p
      UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM p
      UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM p),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT c.*, unnest(range(1, k)) AS place FROM c),
half AS (SELECT *, array_to_string(w[1:place], ' ') AS head, array_to_string(w[place + 1:], ' ') AS tail FROM cut),
scored AS (SELECT half.lang, half.k, half.phrase, a, place, x.f AS l, y.f AS r,
                  ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
           FROM half JOIN f x ON x.lang = half.lang AND x.phrase = head AND x.k = place
                     JOIN f y ON y.lang = half.lang AND y.phrase = tail AND y.k = half.k - place),
least_cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, place) = 1),
inner_part AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3
               UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_part GROUP BY ALL),
ranked AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank,
                  b.phrase, a, l, r, score
           FROM least_cut b LEFT JOIN longer ON longer.lang = b.lang AND longer.phrase = b.phrase
           WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000
"""
