from __future__ import annotations

import hashlib
import re
import time

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sensorframe.llm import byte_bpe, queries, secrets
from tests.llm.cases import LONG, documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(queries.VOCABULARY)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_bpe_query_equals_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op2_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_bpe_awkward_rows_round_trip(spark, ranks, library):
    docs = documents(spark)
    model = byte_bpe.serialise_model(ranks)
    back = byte_bpe.decode(byte_bpe.encode(docs, model, public_tokenizers.PATTERN, ["doc_id", "text"]), model,
                           ["doc_id", "text", "ids"]).collect()
    assert len(back) == docs.count()
    for r in back:
        assert bytes(r.decoded) == (r.text or "").encode()
        assert list(r.ids) == library.encode_ordinary(r.text or "")


def test_bpe_every_character(ranks, library):
    import regex
    model, cut = byte_bpe.Model(byte_bpe.serialise_model(ranks)), regex.compile(public_tokenizers.PATTERN).findall
    for c in [*range(0xD800), *range(0xE000, 0x3000 + 0xE000, 7), *range(0x10000, 0x20000, 11)]:
        text = f"a{chr(c)} b{chr(c)}{chr(c)}c1{chr(c)}"
        assert model.encode(cut(text)) == packed(library.encode_ordinary(text)), hex(c)


def test_bpe_rejects_gaps_and_missing_bytes():
    with pytest.raises(ValueError):
        byte_bpe.serialise_model({bytes([b]): b for b in range(255)})
    with pytest.raises(ValueError):
        byte_bpe.serialise_model({bytes([b]): b + 1 for b in range(256)})


def test_round_trip_equals_encode_and_decode(spark, ranks):
    model = byte_bpe.serialise_model(ranks)
    docs = documents(spark)
    coded = byte_bpe.encode(docs, model, public_tokenizers.PATTERN)
    both = byte_bpe.decode(coded, model, ["doc_id", "ids", "n_tokens", "ids_sha256"])
    want = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, hashlib.sha256(r.decoded).hexdigest()) for r in both.collect())
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256)
                 for r in byte_bpe.round_trip(docs, model, public_tokenizers.PATTERN).collect())
    assert got == want and len(got) == 9


def test_bpe_empty_table(spark, ranks):
    assert byte_bpe.encode(documents(spark, []), byte_bpe.serialise_model(ranks), public_tokenizers.PATTERN).count() == 0


# ------------------------------------------------------------------- secrets
def plain_base(text):
    """The base detectors as stated, one by one."""
    flags = re.IGNORECASE | re.ASCII
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, flags)
        if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found)


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def test_secret_query_equals_plain_search(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op4_secret_scan(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_base(texts[r.doc_id] or "")
        kinds = [k for *_, k in want]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(kinds.count, ("assign", "access", "hex")))
        assert r.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest()
        assert set(listed(want).split(",")) <= set(r.spans.split(",")) or not want


HARD = ["x" * 10, "PassWord:abc def", "api_KEY = 'k2+/_.=-'", "token=short", "AKIA" + "B" * 15, "AKIA" + "B" * 16,
        "0123456789abcdef01234567", "é" * 5 + "secret=\"" + "0a" * 20 + "\"", "tokentoken: abcdefg:secret=ghijklm",
        "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "https://me:hunter22@host/x", LONG]


def test_secret_hard_texts(spark):
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(HARD)])
    for r in secrets.scan(docs, ["doc_id", "text"]).collect():
        assert [tuple(s) for s in r.spans if s.kind in ("assign", "access", "hex")] == plain_base(r.text)
    assert secrets.scan(documents(spark, [])).count() == 0
    assert secrets.scan(documents(spark)).count() == 9


def test_ledger_scans_only_unseen_pairs(spark, monkeypatch):
    seen = []
    real = secrets.scan_blobs
    monkeypatch.setattr(secrets, "scan_blobs", lambda blobs, rules: (seen.append(
        {(r.text, i) for r in blobs.collect() for i in r.todo}), real(blobs, rules))[1])
    first, second = "token = abcdef", "AKIA" + "C" * 16
    old = secrets.Rule("assign", secrets.BASE_RULES[0].pattern, 1, 6, 2)
    docs = documents(spark, [(1, first, "en", "s"), (2, first, "en", "s")])
    ledger = secrets.update_ledger(docs, [old])
    more = documents(spark, [(1, first, "en", "s"), (3, second, "en", "s")])
    rules = [old, secrets.BASE_RULES[1]]
    later = secrets.update_ledger(more, rules, ledger)
    assert seen == [{(first, "assign@1")}, {(first, "access@1"), (second, "assign@1"), (second, "access@1")}]
    newer = [secrets.Rule("assign", "token", 2)]
    both = secrets.scan(docs.unionByName(more), rules=newer, ledger=later)
    assert seen[2] == {(first, "assign@2"), (second, "assign@2")}
    assert sorted((r.doc_id, len(r.spans)) for r in both.collect()) == [(1, 1), (1, 1), (2, 1), (3, 0)]


def test_redaction_replaces_spans_and_nothing_else(spark):
    docs = documents(spark, [(1, "é token = abcdef; AKIA" + "D" * 16 + " end", "en", "s"), (2, None, "en", "s"),
                             (3, "clean", "en", "s"), (4, "token=\"" + "0a" * 20 + "\" x", "en", "s")])
    got = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert got == {1: "é [SECRET]; [SECRET] end", 2: None, 3: "clean", 4: "[SECRET]\" x"}
    assert secrets.redact(docs).columns == docs.columns
    assert secrets.redact(docs).where(F.col("size") == "z").count() == 4


def test_long_logins_and_key_blocks_are_taken_whole():
    key = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A\n\nab-c\n-----END RSA PRIVATE KEY-----"
    pgp = "-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: x-1\n\nabc\n-----END PGP PRIVATE KEY BLOCK-----"
    for kind, text in (("private_key", key), ("private_key", pgp), ("url_login", f"https://{'u' * 200}:{'p.q' * 300}@"),
                       ("url_login", "redis://:hunter22@")):
        assert (kind, 2, 2 + len(text)) in secrets.find(secrets.MORE_RULES, f"> {text}host/x")
    cut = "-----BEGIN PRIVATE KEY-----"
    assert [f[1:] for f in secrets.find(secrets.MORE_RULES[:1], f"{cut} prose {key}")] == [(0, len(cut)), (len(cut) + 7, len(cut) + 7 + len(key))]


def test_kept_ledger_grows_by_new_pairs_alone(spark, tmp_path, monkeypatch):
    seen = []
    real = secrets.scan_blobs
    monkeypatch.setattr(secrets, "scan_blobs", lambda blobs, rules: (seen.append(
        sorted((r.text, i) for r in blobs.collect() for i in r.todo)), real(blobs, rules))[1])
    path, texts = f"{tmp_path}/ledger", ["token = abcdef", "clean", "AKIA" + "C" * 16, None]
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    for step, rows in enumerate((docs.where("doc_id < 2"), docs, docs)):
        got = {r.doc_id: len(r.spans) for r in secrets.scan(rows, rules=secrets.BASE_RULES, path=path).collect()}
        assert got == ({0: 1, 1: 0} if step == 0 else {0: 1, 1: 0, 2: 1, 3: 0})
    assert [len(s) for s in seen] == [6, 6, 0] and {t for t, _ in seen[1]} == {texts[2], ""}
    old = {r.rule for r in secrets.kept_ledger(spark, path).select("rule").distinct().collect()}
    assert old == set(secrets.rule_ids(secrets.BASE_RULES))
    files = spark.read.parquet(path).inputFiles()
    secrets.scan(docs, rules=[secrets.Rule("assign", "token", 9)], path=path).count()
    assert set(files) < set(spark.read.parquet(path).inputFiles()) and [len(s) for s in seen][3:] == [4]


def test_long_runs_of_token_starts_are_read_once():
    text = "eyJ" * 400_000
    start = time.time()
    assert secrets.find(secrets.MORE_RULES, text) == []
    token = "eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + "." + "c" * 9
    assert secrets.find(secrets.MORE_RULES, f"x {token} {text}.") == [("web_token", 2, 2 + len(token))]
    many = "token = abcdef " * 20_000
    _, starts, ends = zip(*secrets.find(secrets.BASE_RULES, many))
    assert secrets.redacted(many, starts, ends, "#") == "# " * 20_000
    assert time.time() - start < 10
