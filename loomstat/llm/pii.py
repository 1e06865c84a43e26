"""PII surrogates: keyed, type-consistent replacements that keep format, gender, script, distinctness and coreference.

An entity is its type and canonical value, so every mention of it gets one surrogate, whatever its format or, for
family names, its gender.  A name known from a mention with a title is replaced wherever else the text has it.  Values
are drawn from a keyed hash.  Two entities with one surrogate, or a surrogate that is itself a real value, are a
collision: those that collide draw again until none is left.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, read, store

#: The setting that holds the key of the query, and the key of tests, which is public.
KEY_SETTING, TEST_KEY = "spark.loomstat.pii.key", "public key of tests"
_MALE = "Mr|Sir|Herrn|Herr|Señor|Sr|Monsieur|Don|г-н|господин|κύριος|Κύριος|κ"
_FEMALE = "Mrs|Ms|Miss|Frau|Señora|Sra|Srta|Madame|Mme|Mlle|Doña|г-жа|госпожа|κυρία|Κυρία|κα"
_TITLE = rf"(?:{_FEMALE}|{_MALE})\.?\s"
_NAME = r"\p{Lu}\p{Ll}+"
_SECRET_KEY = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
#: In this order: the first that fits at a place gives the type.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}\p{N}-]{1,63}\.){1,8}[\p{L}]{2,24}",
    "secret": rf"{_SECRET_KEY}[^\s\"',;]{{6,}}+|(?<![0-9A-Za-z])[0-9a-f]{{32,}}+(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:ghp|sk|pk)[_-][A-Za-z0-9]{20,}+",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])",
    "ip6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?i:fe80|f[cd][0-9a-f]{2}|[23][0-9a-f]{3})(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)",
    "phone": r"\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
    r"|(?<!\d)(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d.,-])0(?:\d{2,4}[ /-]\d{5,8}|\d(?: \d{2}){4})(?![\d.,-]?\d)",
    "name": rf"(?<!\p{{L}}){_TITLE}{_NAME}(?:\s{_NAME})?",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
_DIGITS = r"\d[\d.() -]{5}"
#: Cheap tests, one for each pattern, that a text may hold an entity of the type at all.
GATES = {
    "email": "@",
    "secret": r"(?i:password|passwd|pwd|secret|token|api[_-]?key)|[0-9a-f]{16}|AKIA[0-9A-Z]|(?<![0-9A-Za-z])(?:ghp|sk|pk)[_-][A-Za-z0-9]{20}",
    "iban": r"[A-Z]{2}\d{2} ?[A-Z0-9]{4}",
    "ip6": r"[0-9A-Fa-f]{4}:",
    "ip": _DIGITS,
    "ssn": _DIGITS,
    "card": _DIGITS,
    "phone": rf"\+\d[\d.() -]{{4}}|{_DIGITS}",
    "name": _TITLE,
}
MAYBE = "|".join(dict.fromkeys(g for t in PATTERNS for g in [GATES[t]] if g != _DIGITS))
#: Given names by gender and script, and syllables of family names by script.
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Noah Oscar Paul Quentin Robert Simon Tomas Victor Walter".split(),
    ("f", "latin"): "Anna Berta Clara Diana Emma Fiona Greta Helena Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sara Teresa Ursula Vera Wanda".split(),
    ("m", "greek"): "Αλεξης Βασιλης Γιωργος Δημητρης Ηλιας Θανος Κωστας Λευτερης Μανος Νικος Παυλος Σπυρος Τασος Φωτης".split(),
    ("f", "greek"): "Αννα Βασω Γεωργια Δεσποινα Ελενη Ζωη Ιωαννα Κατερινα Λενα Μαρια Νικη Ολγα Σοφια Χριστινα".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Никита Олег Павел Роман Сергей Тимур".split(),
    ("f", "cyrillic"): "Алла Белла Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Раиса Софья".split(),
}
SYLLABLES = {
    "greek": "βαλ γορ δεν ζαν θαλ καρ λεμ μαρ νικ παν ροδ σιμ ταλ φιλ χαρ".split(),
    "latin": "bal cor den fal gar hol jen kal lor mar nel por ras sol tam vel wes zan ber dun".split(),
    "cyrillic": "бал вор ген дал зор кал лем мар нов пет рад сол тур фед хар".split(),
}


#: Endings of family names: of women, of men, and what they follow.
ENDINGS = [
    ("а", "", "(?:ов|ев|ёв|ин|ын)", "ов"),
    ("ая", "ий", "(?:ск|цк)", "ск"),
    ("a", "i", "(?:sk|ck)", "sk"),
    ("ová", "", r"\p{L}\p{L}", ""),
    ("ου", "ος", r"\p{L}\p{L}", ""),
    ("η", "ης", r"\p{L}\p{L}", ""),
    ("α", "ας", r"\p{L}\p{L}", ""),
]
#: Letters of scripts, for values that are mapped letter by letter; domains that stand for any other.
ALPHABETS = {"cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
DOMAINS = {"cyrillic": "пример.испытание", "greek": "παράδειγμα.δοκιμή"}


def _is(script: str, c: Column) -> Column:
    return c.rlike(rf"\p{{Is{script.capitalize()}}}")


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _typed(m: Column) -> Column:
    kind = F.lit("name")
    for name, p in reversed(list(PATTERNS.items())):
        # look-behinds see the start of the mention, which they were true for
        kind = F.when(m.rlike(rf"^(?:{p})\z"), name).otherwise(kind)
    return kind


def _parts(m: Column, known: Column | None = None) -> Column:
    """A mention as parts ``before`` (kept), ``value`` and ``type``; a name has a part for each word.

    A name without a title has the type of the part of ``known`` that it equals.
    """
    part = lambda before, value, kind: F.struct(before.alias("before"), value.alias("value"), kind.alias("type"))

    def name(m: Column) -> Column:
        title = F.regexp_extract(m, rf"^({_TITLE})", 1)
        own = F.split(F.substr(m, F.length(title) + 1), r"\s")
        gender = F.when(title.rlike(rf"^(?:{_FEMALE})\b"), "f").otherwise("m")
        family = lambda before, value: part(before, value, F.lit("family"))
        given = part(title, F.get(own, 0), F.concat(F.lit("given_"), gender))
        titled = F.when(F.size(own) > 1, F.array(given, family(F.lit(" "), F.get(own, 1)))).otherwise(F.array(family(title, F.get(own, 0))))
        if known is None:
            return titled
        return F.when(title != "", titled).otherwise(F.array(part(F.lit(""), m, F.get(F.filter(known, lambda x: x["value"] == m), F.lit(0))["type"])))

    def by_type(kind: Column) -> Column:
        key = F.when(kind == "secret", F.regexp_extract(m, rf"^({_SECRET_KEY})", 1)).otherwise(F.lit(""))
        other = let(key, lambda k: F.array(part(k, F.substr(m, F.length(k) + 1), kind)))
        return F.when(kind == "name", name(m)).otherwise(other)

    return let(_typed(m), by_type)


def known_names(text: Column) -> Column:
    """The words of names that the text mentions with a title, as parts."""
    titled = F.when(text.rlike(_TITLE), F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0)))
    parts = F.flatten(F.transform(F.coalesce(titled, F.array().cast("array<string>")), lambda m: _parts(m)))
    return F.array_distinct(F.transform(parts, lambda p: F.struct(p["value"].alias("value"), p["type"].alias("type"))))


def mentions(text: Column) -> Column:
    """``parts`` in order, each with the text before it, and the ``tail`` after the last."""

    def lay(known: Column, pattern: Column, gaps: Column) -> Column:
        found = F.regexp_extract_all(text, pattern, F.lit(0))
        own = F.zip_with(F.slice(gaps, 1, F.size(gaps) - 1), found, lambda g, m: F.struct(g.alias("g"), _parts(m, known).alias("p")))
        flat = F.flatten(
            F.transform(
                own,
                lambda x: F.transform(
                    x["p"],
                    lambda p, i: F.struct(
                        F.when(i == 0, F.concat(x["g"], p["before"])).otherwise(p["before"]).alias("before"),
                        p["value"].alias("value"),
                        p["type"].alias("type"),
                    ),
                ),
            )
        )
        return F.struct(flat.alias("parts"), F.element_at(gaps, -1).alias("tail"))

    def with_known(known: Column) -> Column:
        bare = F.concat(F.lit(PATTERN + r"|(?<!\p{L})(?:"), F.array_join(known["value"], "|"), F.lit(r")(?!\p{L})"))
        pattern = F.when(F.size(known) > 0, bare).otherwise(PATTERN)
        return let(pattern, lambda p: let(F.split(text, p, -1), lambda gaps: lay(known, p, gaps)))

    return let(known_names(text), with_known)


def _family(value: Column) -> Column:
    """A family name in lower case, as men bear it; Greek without accents."""
    low = F.lower(value)
    low = F.when(_is("greek", low), F.translate(low, "άέήίόύώϊϋΐΰ", "αεηιουωιυιυ")).otherwise(low)

    def man(x: Column) -> Column:
        out = x
        for woman, of, after, _ in reversed(ENDINGS):
            out = F.when(x.rlike(rf"{after}{woman}\z"), F.concat(F.left(x, F.length(x) - len(woman)), F.lit(of))).otherwise(out)
        return out

    return let(low, man)


def canonical(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, r"\D", "")
    return (
        F.when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .when(kind.isin("secret", "ip"), value)
        .when(kind == "family", _family(value))
        .otherwise(F.lower(value))
    )


def _mod97(text: Column) -> Column:
    """The remainder of digits and letters (A: 10) read as one number."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _luhn(digits: Column) -> Column:
    """Sum of a Luhn test of digits whose last one is the check digit."""
    n = F.length(digits)

    def one(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = (n - i) % 2 == 1
        return F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), one), F.lit(0), lambda a, x: a + x)


def hmac(message: Column, key: str) -> Column:
    """HMAC-SHA512 as hex digits; key and message are UTF-8."""
    raw = key.encode()
    raw = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in raw)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 512))), 512)


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The replacement of a mention; equal for equal canonical values but for separators and case."""

    def drawn(canon: Column) -> Column:
        seed = F.concat_ws("\x1f", kind, canon, attempt.cast("string"))
        return F.concat(*[hmac(F.concat(seed, F.lit(f"\x1f{i}")), key) for i in range(2)])

    def build(canon: Column, hexes: Column) -> Column:
        byte = lambda i: F.conv(F.substr(hexes, F.pmod(i, F.lit(96)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
        alphabet = lambda i, n: F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), byte(i) % n + 1, F.lit(1))
        digit = lambda i: (byte(i) % 10).cast("string")

        def mapped(s: Column, at: Column) -> Column:
            hexed = s.rlike(r"^[0-9a-f]+\z")

            def one(c: Column, i: Column) -> Column:
                new = F.when(c.rlike(r"\p{Nd}"), digit(i + at)).when(
                    c.rlike(r"\p{L}"),
                    F.when(hexed, alphabet(i + at, F.lit(6)))
                    .when(_is("cyrillic", c), F.substr(F.lit(ALPHABETS["cyrillic"]), byte(i + at) % 32 + 1, F.lit(1)))
                    .when(_is("greek", c), F.substr(F.lit(ALPHABETS["greek"]), byte(i + at) % 24 + 1, F.lit(1)))
                    .otherwise(alphabet(i + at, F.lit(26))),
                )
                return F.coalesce(F.when(c.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new), c)

            return F.array_join(F.transform(chars(s), one), "")

        def hexed_groups(s: Column) -> Column:
            one = lambda c, i: F.when(c == ":", c).otherwise(F.lower(F.hex(byte(i) % 15 + 1)))
            return F.array_join(F.transform(chars(s), one), "")

        def digits(canon: Column) -> Column:
            """The first digit stays; a card number stays valid if it was."""
            n = F.length(canon)
            # short numbers fill their space: those that collide on and on get further digits
            all_ = n + F.when((kind == "phone") & (attempt > 3), F.least(attempt - 3, F.lit(12))).when(attempt > 16, F.least(attempt - 16, F.lit(12))).otherwise(0)
            keep = F.when(kind == "ssn", 0).otherwise(1)
            own = F.array_join(
                F.transform(F.sequence(F.lit(1), all_), lambda i: F.when(i <= keep, F.substr(canon, i, F.lit(1))).otherwise(digit(i))), ""
            )

            def checked(s: Column) -> Column:
                base = F.concat(F.substr(s, F.lit(1), n - 1), F.lit("0"))
                last = let(base, lambda b: F.concat(F.substr(b, F.lit(1), n - 1), ((10 - _luhn(b) % 10) % 10).cast("string")))
                return F.when((kind == "card") & (_luhn(canon) % 10 == 0), last).otherwise(s)

            return let(own, checked)

        def fill(d: Column) -> Column:
            filled = F.array_join(
                F.transform(
                    chars(value),
                    lambda c, i: F.when(
                        c.rlike("[0-9]"), F.substr(d, F.length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), r"\D", "")), F.lit(1))
                    ).otherwise(c),
                ),
                "",
            )
            return F.concat(filled, F.substr(d, F.length(canon) + 1))

        # mail addresses and secrets that draw again get two further letters each time
        more = F.array_join(
            F.transform(F.filter(F.sequence(F.lit(0), F.least(2 * attempt, F.lit(16))), lambda i: i > 0), lambda i: alphabet(i + 79, F.lit(26))), ""
        )
        octet = lambda i: (byte(F.lit(i)) % 254 + 1).cast("string")
        # addresses that collide on and on leave their private range for a larger one
        ip = F.when((value.startswith("10.") & (attempt < 12)) | (value.startswith("192.168.") & attempt.between(4, 11)), F.concat_ws(".", F.lit("10"), octet(1), octet(2), octet(3))).when(
            value.startswith("192.168.") & (attempt < 4), F.concat_ws(".", F.lit("192.168"), octet(2), octet(3))
        ).otherwise(F.concat_ws(".", *[octet(i) for i in range(4)]))
        local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
        labels = F.split(domain, r"\.")
        tld = F.lower(F.element_at(labels, -1))
        sub = F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), lambda x, i: mapped(x, 32 + 16 * i))
        email = F.concat(
            mapped(local, F.lit(0)),
            more,
            F.lit("@"),
            F.array_join(
                F.concat(
                    sub,
                    F.array(
                        F.when(_is("cyrillic", tld), DOMAINS["cyrillic"])
                        .when(_is("greek", tld), DOMAINS["greek"])
                        .otherwise(F.concat(F.lit("example."), F.when(tld.isin("com", "net", "org"), tld).otherwise("com")))
                    ),
                ),
                ".",
            ),
        )
        by_script = lambda one: F.when(_is("cyrillic", value), one("cyrillic")).when(_is("greek", value), one("greek")).otherwise(one("latin"))
        pick = lambda values, i: F.get(_array(values), byte(i) * 256 + byte(i + 1) - F.floor((byte(i) * 256 + byte(i + 1)) / len(values)).cast("int") * len(values))

        def given(gender: str) -> Column:
            # those that draw again get a further name each time
            own = lambda script: F.array_join(
                F.transform(F.sequence(F.lit(0), attempt), lambda i: pick(GIVEN[(gender, script)], i * 2)), "-"
            )
            return by_script(own)

        stem = lambda script: F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), F.least(3 + attempt, F.lit(6))), lambda i: pick(SYLLABLES[script], i * 2)), ""))
        # a name that tells the gender by its ending keeps that: the man's form of the surrogate is one for both
        low = F.when(_is("greek", value), F.translate(F.lower(value), "άέήίόύώϊϋΐΰ", "αεηιουωιυιυ")).otherwise(F.lower(value))
        ending = F.lit("")
        for woman, man, after, before in reversed(ENDINGS):
            gendered = F.when(low.rlike(rf"{after}{woman}\z"), before + woman)
            ending = (gendered.when(low.rlike(rf"{after}{man}\z"), before + man) if man or before else gendered).otherwise(ending)
        family = F.concat(by_script(stem), ending)

        def iban(canon: Column) -> Column:
            country, own = F.left(canon, F.lit(2)), F.substr(canon, F.lit(5))
            new = mapped(own, F.lit(0))
            sound = _mod97(F.concat(own, F.left(canon, F.lit(4)))) == 1
            check = let(new, lambda n: F.when(sound, F.lpad((98 - _mod97(F.concat(n, country, F.lit("00")))).cast("string"), 2, "0")).otherwise(F.substr(canon, F.lit(3), F.lit(2))))
            return F.concat(country, check, new)

        def spaced(new: Column) -> Column:
            bare = lambda i: F.length(F.replace(F.left(value, i + 1), F.lit(" "), F.lit("")))
            return F.array_join(F.transform(chars(value), lambda c, i: F.when(c == " ", c).otherwise(F.substr(new, bare(i), F.lit(1)))), "")

        # the first group tells the kind of an address
        ip6 = F.concat(F.regexp_extract(value, "^([0-9A-Fa-f]+:)", 1), hexed_groups(F.regexp_replace(value, "^[0-9A-Fa-f]+:", "")))
        named = F.when(kind == "given_f", given("f")).when(kind == "given_m", given("m")).otherwise(family)
        return (
            F.when(kind.isin("phone", "card", "ssn"), let(digits(canon), fill))
            .when(kind == "ip", ip)
            .when(kind == "email", email)
            .when(kind == "secret", F.concat(mapped(value, F.lit(0)), more))
            .when(kind == "iban", let(iban(canon), spaced))
            .when(kind == "ip6", ip6)
            .otherwise(named)
        )

    return let(canonical(kind, value), lambda c: let(drawn(c), lambda h: build(c, h)))


def exceptions(texts: DataFrame, key: str) -> DataFrame:
    """Entities (``type``, ``canon``) that must draw again, with their ``attempt``; ``texts`` has ``m``, the mentions."""
    kind, canon = F.col("type"), F.col("canon")
    entities = cut(
        # outer: from a plain explode a filter is inferred that finds the mentions of a text over again
        texts.select(F.explode_outer("m.parts").alias("p"))
        .filter("p IS NOT NULL")
        .select(F.col("p.type").alias("type"), canonical(F.col("p.type"), F.col("p.value")).alias("canon"))
        .distinct()
        .withColumn("attempt", F.lit(0))
    )
    while True:  # surrogates grow with the attempt, so that in the end none collide
        # Compared as they would be recognised again.
        drawn = cut(entities.withColumn("s", canonical(kind, surrogate(kind, canon, F.col("attempt"), key))))
        shared = drawn.groupBy("type", "s").agg(F.min(F.struct("attempt", "canon")).alias("w"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        losers = (
            drawn.join(shared, ["type", "s"]).filter("attempt <> w.attempt OR canon <> w.canon").select("type", "canon")
        )
        real = entities.select("type", F.col("canon").alias("s"))
        taken = drawn.join(real, ["type", "s"], "left_semi").select("type", "canon")
        bad = cut(losers.unionByName(taken).distinct().withColumn("again", F.lit(1)))
        if not bad.count():
            return entities.filter("attempt > 0")
        entities = cut(
            entities.join(bad, ["type", "canon"], "left").select("type", "canon", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
        )


def replace(docs: DataFrame, *, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` with surrogates and ``n_entities`` (mentioned parts) of each row; ``key`` is a secret.

    Null texts stay null with no entities, empty ones empty; null ids pass; repeated rows are replaced alike; an
    empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    may = F.coalesce(F.col("text").rlike(MAYBE), F.lit(False))
    # Mentions are found once, and written.
    found = store(rows.filter(may).select("doc_id", mentions(F.col("text")).alias("m"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")))
    again = exceptions(found.select("m"), key)
    # Where entities drew again, their places in the texts that mention them: equal texts have them at the same places.
    part = found.select("h1", "h2", F.posexplode_outer("m.parts").alias("i", "p")).filter("i IS NOT NULL")
    part = part.withColumns({"type": F.col("p.type"), "canon": canonical(F.col("p.type"), F.col("p.value"))}).join(again, ["type", "canon"])
    places = store(part.groupBy("h1", "h2").agg(F.map_from_entries(F.collect_set(F.struct("i", "attempt"))).alias("attempts")))
    done = found.join(places, ["h1", "h2"], "left")  # places are few, and are sent if they are small
    attempt = lambda i: F.coalesce(F.element_at("attempts", i), F.lit(0))
    new = F.transform("m.parts", lambda p, i: F.concat(p["before"], surrogate(p["type"], p["value"], attempt(i), key)))
    done = done.select("doc_id", F.concat(F.array_join(new, ""), "m.tail").alias("text"), F.size("m.parts").cast("long").alias("n_entities"))
    return rows.filter(~may).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities")).unionByName(done)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`replace` of ``documents``, with the key that the session names, or that of tests; nulls, ties and empty tables as told there."""
    return replace(read(spark, sf_dir, "documents"), key=spark.conf.get(KEY_SETTING, TEST_KEY))


QUERIES = {"op2_pii": op2_pii}
ORACLES: dict[str, str] = {}
