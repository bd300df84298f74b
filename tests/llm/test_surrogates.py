from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from sensorframe.llm import queries, surrogates
from tests.llm.cases import LONG, documents

SF = "/root/testdata/sf0.01"
EMAIL, CARD, IP = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", r"(?<!\d)\d{16}(?!\d)", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"
PHONE = r"\+\d \(\d{3}\) \d{3}-\d{4}"


def luhn(digits):
    t = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        t += d - 9 * (d > 9)
    return t % 10 == 0


@pytest.fixture(scope="module")
def pairs(spark):
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    after = {r.doc_id: (r.text, r.n_replaced) for r in queries.op1_pii_surrogates(spark, SF).collect()}
    assert before.keys() == after.keys()
    return [(before[i], *after[i]) for i in before]


def test_entities_go_and_the_rest_stays(pairs):
    any_entity = re.compile("|".join((EMAIL, CARD, IP, PHONE)))
    assert sum(n for *_, n in pairs) > 20
    for old, new, n in pairs:
        if n == 0:
            assert new == old
            continue
        assert len(new) == len(old)
        found = list(any_entity.finditer(old))
        assert found
        at = 0
        for m in found:
            assert new[at:m.start()] == old[at:m.start()]
            got = new[m.start():m.end()]
            assert got != m.group() and any_entity.fullmatch(got)
            assert "@" in got or re.sub(r"\d", "9", got) == re.sub(r"\d", "9", m.group())
            if re.fullmatch(CARD, m.group()):
                assert luhn(got) == luhn(m.group())
            at = m.end()
        assert new[at:] == old[at:]


def test_distinct_and_coreferent(pairs):
    for kind in (EMAIL, CARD, IP, PHONE):
        there, back = {}, {}
        for old, new, _ in pairs:
            for a, b in zip(re.findall(kind, old), re.findall(kind, new), strict=True):
                assert there.setdefault(a.lower(), b.lower()) == b.lower()
                assert back.setdefault(b.lower(), a.lower()) == a.lower()
        assert not set(there) & set(back)


def replaced(spark, *texts, **more):
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    return [r.text for r in surrogates.replace(docs, **more).orderBy("doc_id").collect()]


def test_names_keep_gender_script_and_form(spark):
    a, b, c, d = replaced(spark, "Mr. John Smith and JOHN SMITH met Mrs Anna Kowalski.", "John Smith left.",
                          "Госпожа Анна Петрова, Иван Петров", "The General Public License and Dear Reader")
    m = re.fullmatch(r"Mr\. (\w+ \w+) and ([A-Z]+ [A-Z]+) met Mrs (\w+) (\w+)\.", a)
    assert m and m[1].upper() == m[2] and b == f"{m[1]} left."
    assert m[1].split()[0] in surrogates.GIVEN["m", "latin"] and m[3] in surrogates.GIVEN["f", "latin"]
    m = re.fullmatch(r"Госпожа (\w+) \w+, (\w+) \w+", c)
    assert m[1] in surrogates.GIVEN["f", "cyrillic"] and m[2] in surrogates.GIVEN["m", "cyrillic"]
    assert d == "The General Public License and Dear Reader"


def test_formats(spark):
    (a,) = replaced(spark, "4111 1111-1111 1111; DE89 3700 4044 0532 0130 00; 123-45-6789; +49 30 1234567; 10.0.0.7")
    card, iban, ssn, phone, ip = a.split("; ")
    assert re.fullmatch(r"4\d{3} \d{4}-\d{4} \d{4}", card) and luhn(re.sub(r"\D", "", card))
    moved = iban.replace(" ", "")[4:] + iban[:4]
    assert iban.startswith("DE") and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", ssn) and re.fullmatch(r"\+4\d 30? ?\d* ?\d+|\+4\d \d{2} \d{7}", phone)
    assert re.fullmatch(r"\d{2}\.\d\.\d\.\d", ip) and a.count("; ") == 4


def test_key_changes_surrogates(spark):
    text = "write to jo.90@mail2.example.com"
    one, two, again = replaced(spark, text), replaced(spark, text, key="k2"), replaced(spark, text)
    assert one == again != two


def test_clashes_draw_again(spark, monkeypatch):
    """With a space of nine surrogates a draw, a hundred entities still get different ones."""
    rows = spark.range(100).select(F.lit("number").alias("kind"), F.format_string("%03d", "id").alias("norm"),
                                   F.lit(None).cast("string").alias("gender"))
    real = surrogates.draw_surrogate
    monkeypatch.setattr(surrogates, "draw_surrogate", lambda key, kind, norm, gender, draw: F.concat(
        F.substring(real(key, kind, norm, gender, draw), 1, 1), F.lpad(draw.cast("string"), 2, "0")))
    got = surrogates.assign(rows, "k").collect()
    assert len({r.surrogate for r in got}) == len({r.norm for r in got}) == 100
    assert not {r.surrogate for r in got} & {r.norm for r in got}


def test_awkward_rows(spark):
    rows = surrogates.replace(documents(spark), keep=["doc_id", "n_chars"]).collect()
    assert sorted((r.text is None, r.text or "", r.n_replaced) for r in rows) == sorted(
        (r.text is None, r.text or "", 0) for r in documents(spark).collect())
    (long,) = replaced(spark, LONG + "jo.90@mail2.example.com")
    assert long.startswith(LONG) and "mail2" not in long
    assert surrogates.replace(documents(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = surrogates.replace(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("== Physical Plan ==")[-1])


def test_names_after_capitalised_words(spark):
    texts = ["Contact Jane Doe today", "Dear John Smith,", "CEO John Smith", "Dear Mr. Smith", "Yesterday Frau Dr. Anna Weber left",
             "Hello John Paul Smith!", "Sincerely Anna-Maria F. Jones", "Уважаемый Иван Петров"]
    got = replaced(spark, *texts)
    for text, new, name in zip(texts, got, ("Jane Doe", "John Smith", "John Smith", "Smith", "Anna Weber", "John Paul Smith",
                                            "Anna-Maria F. Jones", "Иван Петров")):
        before, after = text.split(name)
        assert new.startswith(before) and new.endswith(after) and not set(name.split()[-1:]) & set(re.findall(r"\w+", new))
    assert got[1][5:-1] == got[2][4:] and len(got[5].split()) == 4
