r"""Keyed surrogates for personal data, with column expressions only.

Detected entities are replaced by made-up ones of the same kind and look: an
address keeps its shape, a card number its first digit and a valid check digit, a
name the gender and script it had, in the letter case it was written in. The
replacement is drawn from a keyed SHA-256 of kind and normalised entity, so the
same entity gets the same surrogate in every text (coreference) and nobody
without the key can tell which.

Different entities must stay different. All distinct entities form one table;
entities that draw a surrogate which another one holds, or which is itself an
entity found in the texts, draw again. Every further draw opens a larger space
(longer numbers, wider octets, double surnames), so the draws end.

Texts are split at the entities and joined again with the surrogates. Equal texts
are worked on once: matches are kept by the text's digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorframe.llm.common import stored, text_of

#: Titles by gender (f, m, or n for either), and common given names by gender, in two scripts.
TITLES = {"f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"),
          "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"), "n": ("Dr", "Prof")}
GIVEN = {
    ("f", "latin"): ("Alice", "Anna", "Maria", "Emma", "Julia", "Laura", "Sophie", "Claire", "Elena", "Sarah", "Jane", "Mary",
                     "Lucia", "Carmen", "Camille", "Greta", "Ingrid", "Nora", "Olivia", "Helen", "Linda", "Susan", "Karen", "Emily"),
    ("m", "latin"): ("John", "James", "Robert", "Michael", "David", "Thomas", "Peter", "Paul", "Pierre", "Louis", "Hans", "Karl",
                     "Carlos", "Miguel", "Juan", "Henry", "George", "Oscar", "Martin", "Lukas", "William", "Richard", "Jack", "Daniel"),
    ("f", "cyrillic"): ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана"),
    ("m", "cyrillic"): ("Иван", "Пётр", "Алексей", "Дмитрий", "Сергей", "Андрей", "Михаил", "Николай"),
}
#: First and second parts of made-up surnames.
SURNAME = {"latin": (("Ash", "Bren", "Cal", "Dor", "Els", "Fair", "Gar", "Hal", "Ing", "Kes", "Lor", "Mar", "Nor", "Oak", "Pel", "Ros",
                      "Sel", "Thorn", "Ul", "Ves", "Wes", "Yar", "Zel", "Bel"),
                     ("berg", "brook", "dale", "den", "field", "ford", "ham", "hurst", "land", "ley", "man", "mont", "ner", "rick",
                      "sen", "son", "stad", "stein", "ton", "vale", "well", "win", "wood", "worth")),
           "cyrillic": (("Бел", "Гор", "Дуб", "Зим", "Кал", "Лес", "Мор", "Нов", "Ряб", "Сав", "Тих", "Чер"),
                        ("ев", "енко", "инов", "ович", "ский", "ов", "ых", "юк"))}
#: The endings that a woman's Russian surname takes.
FEMALE_ENDINGS = (("ский", "ская"), ("ев", "ева"), ("инов", "инова"), ("ов", "ова"))

TITLE = "|".join(t for group in TITLES.values() for t in group)
#: Titles in front of a name, a capitalised part, and further parts (initials only before another part).
TITLED = rf"(?:(?:{TITLE})\.?\x20)"
PART = r"\p{Lu}[\p{L}'’-]++"
PARTS = rf"(?:(?:\x20\p{{Lu}}\.)*\x20{PART})"
KNOWN = rf"(?=\p{{Lu}})(?iu:{'|'.join(n for group in GIVEN.values() for n in group)})(?![\p{{L}}'’])(?:-{PART})?"
#: Fixed formats of the entities, tried in this order at every place of a text.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d])",
    "phone": r"(?<![\d+.])(?:\+\d{1,3}[ .-]?)?\(\d{2,5}\)[ .-]?\d{2,4}(?:[ .-]\d{2,5})+(?!\d)|(?<![\d+.])\+\d{1,3}[ .-]?\d{1,5}(?:[ .-]?\d{2,5}){1,4}(?!\d)"
             r"|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]*\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ipv4": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
    # starts at a title or a known given name, whatever stands before, and takes all capitalised parts that follow
    "person": rf"(?<![\p{{L}}])(?:{TITLED}+(?:{PART}|(?:\p{{Lu}}\.\x20)+{PART}){PARTS}*|{KNOWN}{PARTS}+)",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Draws until the space of surrogates is widened.
NARROW = 6


# ------------------------------------------------------------- kinds and checks
def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled and reduced; valid if divisible by 10."""
    back = F.split(F.reverse(digits), "")
    return F.aggregate(F.transform(back, lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))
                                   .otherwise(d.cast("int"))), F.lit(0), lambda a, x: a + x)


def gender_of(name: Column) -> Column:
    """f, m, or n: by the title, else by the given name; null where neither is known."""
    first = F.initcap(F.split(F.regexp_replace(name, rf"^{TITLED}+", ""), "[ -]")[0])
    by_title = F.lit(None).cast("string")
    by_name = F.lit(None).cast("string")
    for g in ("n", "m", "f"):  # of several titles a gendered one decides
        by_title = F.when(name.rlike(rf"^{TITLED}*(?:{'|'.join(TITLES[g])})\.?\x20"), F.lit(g)).otherwise(by_title)
    for g in ("f", "m"):
        names = [n for (gg, _), group in GIVEN.items() if gg == g for n in group]
        by_name = F.when(first.isin(*names), F.lit(g)).otherwise(by_name)
    return F.when(by_title.isin("f", "m"), by_title).otherwise(F.coalesce(by_name, by_title))


def kind_of(raw: Column) -> Column:
    """Kind of a match, null for one that only looks like an entity."""
    def whole(k):
        return raw.rlike(f"^(?:{KINDS[k]})$")
    octets = F.forall(F.split(raw, r"\."), lambda o: o.cast("int") < 256)
    return (F.when(raw.contains("@"), F.lit("email"))
            .when(whole("iban") & raw.rlike("^[A-Z]{2}"), F.lit("iban"))
            .when(whole("card"), F.when(luhn_sum(_digits(raw)) % 10 == 0, F.lit("card")).otherwise(F.lit("number")))
            .when(whole("ssn"), F.lit("ssn")).when(whole("ipv4"), F.when(octets, F.lit("ipv4")))
            .when(whole("phone"), F.lit("phone")).when(gender_of(raw).isNotNull(), F.lit("person")))


def normal_of(kind: Column, raw: Column) -> Column:
    """What makes two mentions one entity: digits alone, lower case, a name without its title."""
    return (F.when(kind.isin("card", "number", "ssn", "phone"), _digits(raw))
            .when(kind == "iban", F.regexp_replace(raw, " ", ""))
            .when(kind == "person", F.lower(F.regexp_replace(raw, rf"^{TITLED}+", "")))
            .otherwise(F.lower(raw)))


def script_of(s: Column) -> Column:
    return F.when(s.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))


# --------------------------------------------------------------------- drawing
def _hex(key: str, kind: Column, norm: Column, draw: Column) -> Column:
    """256 hex digits that depend on all arguments."""
    return F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(str(i)), kind, norm, draw.cast("string")), 256)
                      for i in range(4)])


def _byte(hexes: Column, i: Column) -> Column:
    at = (F.pmod(i, F.lit(128)) * 2 + 1).cast("int")
    return F.conv(F.substr(hexes, at, F.lit(2)), 16, 10).cast("int")


def _pick(items, number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (F.pmod(number, F.lit(len(items))) + 1).cast("int"))


def _same_shape(s: Column, hexes: Column, keep: Column) -> Column:
    """Letters and digits replaced by others of their class, the first ``keep`` characters and all signs kept.

    A digit that is not 0 stays so. Only Latin and Cyrillic letters are replaced.
    """
    classes = (("123456789", "[1-9]"), ("abcdefghijklmnopqrstuvwxyz", "[a-zà-ÿ]"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "[A-ZÀ-Þ]"),
               ("0123456789", "0"), ("абвгдежзиклмнопрстуф", "[а-яё]"), ("АБВГДЕЖЗИКЛМНОПРСТУФ", "[А-ЯЁ]"))

    def one(c, i):
        out = c
        for letters, pattern in classes:
            out = F.when(c.rlike(f"^{pattern}$"), _pick(list(letters), _byte(hexes, i))).otherwise(out)
        return F.when(i < keep, c).otherwise(out)
    return F.array_join(F.transform(F.split(s, ""), one), "")


def _check_digit(digits: Column) -> Column:
    """The digits with the last one set so that the Luhn sum fits."""
    stem = F.substr(digits, F.lit(1), (F.length(digits) - 1).cast("int"))
    return F.concat(stem, F.pmod(F.lit(10) - luhn_sum(F.concat(stem, F.lit("0"))) % 10, F.lit(10)).cast("string"))


def _iban_checked(iban: Column) -> Column:
    """The account number with the two check digits that make it valid (97 steps of the remainder)."""
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 2), F.lit("00"))
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return F.concat(F.substring(iban, 1, 2), F.lpad((F.lit(98) - rest).cast("string"), 2, "0"), F.substring(iban, 5, 64))


def _octets(ip: Column, hexes: Column, wide: Column) -> Column:
    """An address whose octets have as many digits as before; widened: three."""
    def one(o, i):
        b = _byte(hexes, i)
        return (F.when(wide | (F.length(o) == 3), F.pmod(b, F.lit(156)) + 100).when(F.length(o) == 2, F.pmod(b, F.lit(90)) + 10)
                .otherwise(F.pmod(b, F.lit(9)) + 1)).cast("string")
    return F.array_join(F.transform(F.split(ip, r"\."), one), ".")


def _name(norm: Column, gender: Column, hexes: Column, draw: Column) -> Column:
    """A name of the entity's gender and script with as many parts, in lower case; more surnames when widened."""
    script = script_of(norm)
    given = F.lit(None).cast("string")
    for (g, s), names in GIVEN.items():
        given = F.when((script == s) & ((gender == g) | (gender == "n") & (_byte(hexes, F.lit(0)) % 2 == (g == "m") * 1)),
                       _pick(names, _byte(hexes, F.lit(1)) * 256 + _byte(hexes, F.lit(2)))).otherwise(given)

    def surname(at):
        out = F.lit(None).cast("string")
        for s, (first, second) in SURNAME.items():
            end = _pick(second, _byte(hexes, F.lit(at + 1)))
            if s == "cyrillic":
                female = end
                for m, f in FEMALE_ENDINGS:
                    female = F.when(end == m, F.lit(f)).otherwise(female)
                end = F.when(gender == "f", female).otherwise(end)
            out = F.when(script == s, F.concat(_pick(first, _byte(hexes, F.lit(at))), end)).otherwise(out)
        return out
    more = F.when(draw >= NARROW, F.concat(F.lit("-"), surname(7))).otherwise(F.lit(""))
    more = F.concat(more, F.when(draw >= 2 * NARROW, F.concat(F.lit("-"), surname(11))).otherwise(F.lit("")))
    last = F.concat(surname(3), more)
    parts = F.size(F.split(norm, " "))
    middle = F.when(parts > 2, F.transform(F.sequence(F.lit(1), parts - 2), lambda i: surname(15 + 4 * i)))
    return F.lower(F.when(norm.contains(" "), F.concat_ws(" ", given, middle, last)).otherwise(last))


def draw_surrogate(key: str, kind: Column, norm: Column, gender: Column, draw: Column) -> Column:
    """The normalised surrogate of a normalised entity at the given draw."""
    h = _hex(key, kind, norm, draw)
    wide = draw >= NARROW
    longer = F.when(wide, F.repeat(F.lit("7"), (draw - (NARROW - 1)).cast("int"))).otherwise(F.lit(""))
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    ending = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    host = F.substr(domain, F.lit(1), (F.length(domain) - F.length(ending)).cast("int"))
    none = F.lit(0)
    # one domain, one surrogate domain: its letters are drawn from the domain alone
    mail = F.concat(_same_shape(F.concat(local, longer), h, none), F.lit("@"),
                    _same_shape(host, _hex(key, F.lit("domain"), domain, F.lit(0)), none), ending)
    return (F.when(kind == "email", mail).when(kind == "ipv4", _octets(norm, h, wide))
            .when(kind == "card", _check_digit(_same_shape(F.concat(norm, longer), h, F.lit(1))))
            .when(kind == "iban", _iban_checked(F.concat(_same_shape(norm, h, F.lit(4)), longer)))
            .when(kind == "person", _name(norm, gender, h, draw))
            .otherwise(_same_shape(F.concat(norm, longer), h, F.when(kind == "phone", F.lit(1)).otherwise(none))))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """``kind``, ``norm``, ``surrogate`` of distinct entities (``kind``, ``norm``, ``gender``).

    No two entities of a kind share a surrogate, and none is an entity itself.
    Those that clash draw again; of several with one surrogate the first in the
    order of ``norm`` keeps it.
    """
    names = entities.select("kind", F.col("norm").alias("surrogate"))
    settled, open_, draw = None, entities, 0
    while True:
        drawn = stored(open_.withColumn("surrogate", draw_surrogate(
            key, F.col("kind"), F.col("norm"), F.col("gender"), F.lit(draw))), "drawn")
        taken = names if settled is None else names.unionByName(settled.select("kind", "surrogate"))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm")).join(
            taken, ["kind", "surrogate"], "left_anti")
        good = drawn.join(first, ["kind", "surrogate", "norm"], "left_semi").select("kind", "norm", "gender", "surrogate")
        settled = stored(good if settled is None else settled.unionByName(good), "settled")
        open_ = drawn.join(settled, ["kind", "norm"], "left_anti").drop("surrogate")
        draw += 1
        if open_.isEmpty():
            return settled


# -------------------------------------------------------------------- rewriting
def dressed(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the look of the mention: its signs between digits, its title, its letter case."""
    # digits go one by one into the places of the mention's digits; widened ones follow at the end
    digits, places = F.split(surrogate, ""), F.split(raw, "")
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
    is_place = lambda c: c.rlike("[0-9A-Za-z]")
    filled = F.aggregate(places, begin, lambda acc, c: F.struct(
        F.concat(acc["out"], F.when(is_place(c), F.get(digits, acc["n"])).otherwise(c)).alias("out"),
        (acc["n"] + is_place(c).cast("int")).alias("n")), lambda acc: F.concat(
            acc["out"], F.substr(surrogate, acc["n"] + 1)))
    bare = F.regexp_replace(raw, rf"^{TITLED}+", "")
    title = F.substr(raw, F.lit(1), (F.length(raw) - F.length(bare)).cast("int"))
    cap = F.array_join(F.transform(F.split(surrogate, "(?<=[ -])"), F.initcap), "")
    name = F.concat(title, F.when(bare == F.upper(bare), F.upper(surrogate)).otherwise(cap))
    mail = F.when(raw == F.upper(raw), F.upper(surrogate)).otherwise(surrogate)
    return (F.when(kind == "person", name).when(kind == "email", mail)
            .when(kind == "ipv4", surrogate).otherwise(filled))


def replace(docs: DataFrame, key: str = "surrogates", keep=("doc_id",), text: str = "text") -> DataFrame:
    """Every row with ``text`` rewritten and ``n_replaced``, the number of mentions replaced.

    Rows without personal data, null texts included, keep their text. Repeated
    rows are rewritten alike. Of the other columns those in ``keep`` are returned.
    """
    digest = F.sha2(text_of(text).cast("binary"), 256)
    found = docs.select(digest.alias("digest"), F.regexp_extract_all(text_of(text), F.lit(PATTERN), F.lit(0)).alias("matches"))
    found = stored(found.where(F.size("matches") > 0).dropDuplicates(["digest"]), "matches")
    raw = found.select("digest", F.explode(F.array_distinct("matches")).alias("raw"))
    raw = raw.withColumn("kind", kind_of(F.col("raw"))).where("kind IS NOT NULL")
    mentions = stored(raw.withColumn("norm", normal_of(F.col("kind"), F.col("raw"))), "mentions")
    gender = F.when(F.col("kind") == "person", gender_of(F.col("raw")))
    # of one person's mentions a gendered one decides
    entities = stored(mentions.groupBy("kind", "norm").agg(F.coalesce(
        F.min(F.when(gender != "n", gender)), F.min(gender)).alias("gender")), "entities")
    named = mentions.join(assign(entities, key).select("kind", "norm", "surrogate"), ["kind", "norm"])
    changed = named.select("digest", F.struct("raw", dressed(F.col("kind"), F.col("raw"), F.col("surrogate")).alias("new")).alias("pair"))
    maps = stored(changed.groupBy("digest").agg(F.map_from_entries(F.collect_list("pair")).alias("news"))
                  .join(found, "digest"), "maps")
    joined = docs.select(*keep, F.col(text).cast("string").alias("text"), digest.alias("_digest")).join(
        maps, F.col("_digest") == F.col("digest"), "left")
    pieces, matches, news = F.split("text", PATTERN, -1), F.col("matches"), F.col("news")
    parts = F.transform(pieces, lambda p, i: F.concat(p, F.when(i < F.size(matches), F.coalesce(
        news[F.get(matches, i)], F.get(matches, i))).otherwise(F.lit(""))))
    count = F.size(F.filter(matches, lambda m: F.map_contains_key(news, m)))
    return joined.select(*keep, F.when(news.isNull(), F.col("text")).otherwise(F.array_join(parts, "")).alias("text"),
                         F.when(news.isNull(), F.lit(0)).otherwise(count).cast("long").alias("n_replaced"))
