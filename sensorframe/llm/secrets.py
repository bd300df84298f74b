"""Secret scans over a ledger of blobs.

Every version of every path is addressed by the SHA-256 of its text. A ledger
lists which (blob, rule, rule version) triples were scanned before, and what was
found. A scan looks only at triples the ledger does not have, appends them, and
joins the findings of a blob back to all paths that ever held it. A text that
appears a million times is therefore read by the rules once, and a new rule
version rescans blobs for that rule alone.

Rules are leftmost non-overlapping matches of a pattern, with a least length of
the whole match or of one group; shorter matches are dropped. Offsets count code
points, the end is exclusive. A null text is an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sensorframe.llm.common import map_rows, stored, text_of


@dataclass(frozen=True)
class Rule:
    """``clues``: lower-case strings of which a matching text has at least one; none: no such test."""
    kind: str
    pattern: str
    version: int = 1
    least: int = 0
    group: int = 0
    clues: tuple[str, ...] = ()
    base: bool = False


def either_case(word: str) -> str:
    """A pattern for an ASCII word in any case, and for nothing else."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGNED = "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + (
    either_case("api") + "_?" + either_case("key"))
BASE_RULES = (
    Rule("assign", rf"""({ASSIGNED})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", least=6, group=2,
         clues=("passw", "secret", "token", "api"), base=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, clues=("akia",), base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),  # whole runs of 24 characters or more
)
MORE_RULES = (
    # up to its END line, whatever lies between but the begin of another key
    Rule("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:(?:(?!-----BEGIN [A-Z0-9 ]*PRIVATE KEY)[\s\S])*?"
         r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----)?", version=2, clues=("private key",)),
    # only where a run of its characters begins, so that a long run is read once
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", version=2, clues=("eyj",)),
    Rule("prefixed", r"(?:gh[opsu]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})",
         clues=("gho_", "ghp_", "ghs_", "ghu_", "xox", "sk_live_")),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]*+:([^\s/@]{3,}+)@", version=2, clues=("://",)),
)
RULES = BASE_RULES + MORE_RULES
FINDING = "array<struct<kind:string,start:bigint,end:bigint>>"
LEDGER = f"blob string, found {FINDING}, rule string"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def rule_ids(rules: Sequence[Rule]) -> list[str]:
    return [f"{r.kind}@{r.version}" for r in rules]


def find(rules: Sequence[Rule], text: str, low: str | None = None) -> list[tuple[str, int, int]]:
    """Matches of the rules in one text, rule by rule."""
    low = text.lower() if low is None else low
    found = []
    for r in rules:
        if not r.clues or any(c in low for c in r.clues):
            for m in re.finditer(r.pattern, text):
                if m.end(r.group) - m.start(r.group) >= r.least:
                    found.append((r.kind, m.start(), m.end()))
    return found


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Findings of blobs (``blob``, ``text``, ``todo``: rule ids) as ``blob``, ``rule``, ``found``.

    One row per blob and rule in ``todo``, also where nothing was found.
    """
    by_id = dict(zip(rule_ids(rules), rules))

    def make():
        def run(b: pa.RecordBatch) -> list:
            out = []
            for text, todo in zip(b.column("text").to_pylist(), b.column("todo").to_pylist()):
                low = text.lower()
                out.append([{"rule": i, "found": [dict(zip(("kind", "start", "end"), x))
                                                  for x in find([by_id[i]], text, low)]} for i in todo])
            kind = pa.list_(pa.struct([("rule", pa.string()), ("found", pa.list_(pa.struct(
                [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]))
            return [pa.array(out, kind)]
        return run

    done = map_rows(blobs, f"scans array<struct<rule:string,found:{FINDING}>>", ["blob"], make)
    return done.select("blob", F.explode("scans").alias("_s")).select("blob", "_s.rule", "_s.found")


def kept_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger kept in a folder, one partition per rule version; empty if there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def update_ledger(versions: DataFrame, rules: Sequence[Rule] = RULES,
                  ledger: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """The ledger after a scan of ``versions`` (with a column ``text``): ``blob``, ``rule``, ``found``.

    Copies of a text meet in a partial aggregate before the shuffle, so at most
    one row per blob and task travels. Pairs that the ledger has are not scanned
    again. A ledger given as a table is left as it is and its rows are kept in the
    result; the one in the folder ``path`` is read and gets the new pairs appended,
    in the partitions of their rule versions, without being rewritten. Two runs
    that append at once may both list a pair, which does no harm.
    """
    spark = versions.sparkSession
    named = versions.select(blob_id(F.col("text")).alias("blob"), text_of().alias("text")).dropDuplicates(["blob"])
    ids = F.array(*[F.lit(i) for i in rule_ids(rules)])
    if path is not None:
        ledger = kept_ledger(spark, path)
    if ledger is None:
        blobs = named.select("blob", "text", ids.alias("todo"))
    else:
        known = (ledger.where(F.col("rule").isin(rule_ids(rules)))
                 .groupBy("blob").agg(F.collect_set("rule").alias("_known")))
        blobs = (named.join(known, "blob", "left").select("blob", "text", F.array_except(
                     ids, F.coalesce("_known", F.array().cast("array<string>"))).alias("todo"))
                 .where(F.size("todo") > 0))
    fresh = scan_blobs(blobs, rules)
    if path is not None:
        fresh.write.mode("append").partitionBy("rule").parquet(path)
        return kept_ledger(spark, path)
    return stored(fresh if ledger is None else ledger.select("blob", "rule", "found").unionByName(fresh), "ledger")


def findings(ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """What the present rule versions found, per blob with a finding: ``blob``, ``spans``.

    Spans are ordered by start, then in the order of the rules.
    """
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    rows = (ledger.where(F.col("rule").isin(rule_ids(rules)) & (F.size("found") > 0))
            .select("blob", F.explode("found").alias("_f")))
    return rows.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct(
        F.col("_f.start").alias("start"), place[F.col("_f.kind")].alias("place"),
        F.col("_f.end").alias("end"), F.col("_f.kind").alias("kind")))).alias("spans"))


def scan(versions: DataFrame, keep=("doc_id",), rules: Sequence[Rule] = RULES,
         ledger: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """Every version (row) with its ``spans`` (array of start, place, end, kind; empty if clean).

    All rows come back, repeated ones and null texts included; of the other
    columns those in ``keep``.
    """
    found = findings(update_ledger(versions, rules, ledger, path), rules)
    paths = versions.select(*keep, blob_id(F.col("text")).alias("blob"))
    none = F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>")
    return (paths.join(found, "blob", "left")
            .withColumn("spans", F.coalesce("spans", none)))


def listing(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, starts: Sequence[int], ends: Sequence[int], mark: str) -> str:
    """The text with its spans (ordered by start; overlapping ones as one) replaced, in one walk."""
    pieces, at = [], 0
    for start, end in zip(starts, ends):
        if start >= at:
            pieces += (text[at:start], mark)
        at = max(at, end)
    return "".join([*pieces, text[at:]])


def redact(versions: DataFrame, rules: Sequence[Rule] = RULES, mark: str = "[SECRET]",
           ledger: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """The rows with every found span (overlapping ones as one) replaced in ``text``.

    Clean texts, null ones included, are left as they are and do not leave the JVM. Other columns stay.
    """
    dirty = findings(update_ledger(versions, rules, ledger, path), rules)
    marked = versions.withColumn("_blob", blob_id(F.col("text"))).join(
        dirty.select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans")), "_blob", "left")

    @F.pandas_udf("string")
    def clean(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else redacted(t, s, e, mark) for t, s, e in zip(text, starts, ends)], dtype=object)

    found = F.col("_spans").isNotNull()
    text = clean(F.when(found, F.col("text")), F.transform("_spans", lambda s: s["start"]), F.transform("_spans", lambda s: s["end"]))
    return marked.withColumn("_clean", text).select(*[
        F.when(found, F.col("_clean")).otherwise(F.col("text")).alias(c) if c == "text" else F.col(c) for c in versions.columns])
