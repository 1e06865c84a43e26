"""Surrogates against a plain replacement in Python, and what they must keep: coreference, script, gender, checksums."""

import hashlib
import hmac
import re

import pandas as pd
import regex

from loomstat.llm import pii

SCHEMA = "doc_id long, text string"
KEY = "k"


def replaced(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return [r["text"] for r in pii.replace(df, key=KEY).orderBy("doc_id").collect()]


def test_probes(spark):
    titled, mail, greek, couple, iban, six, full, other = replaced(
        spark,
        "Mr Smith went home. Smith slept, and Smithson woke.",
        "mail иван.петров@почта.рф or νίκος@ταχυδρομείο.ελ",
        "κα Παπαδοπούλου και κ. Παπαδόπουλος",
        "г-жа Иванова и г-н Иванов; г-жа Полянская и г-н Полянский",
        "pay GB82 WEST 1234 5698 7654 32 or DE89370400440532013000 or XX11 2222 3333 4444 55",
        "host 2001:db8::8a2e:370:7334 or fe80::1, std::vector and a::b stay, 12:30:45 too",
        "Frau Anna Weber sagte: Anna und Weber, Webers nicht.",
        "Smith alone is no name that is known here",
    )
    a, b = re.match(r"Mr (\w+) went home\. (\w+) slept, and Smithson woke\.\Z", titled).groups()
    assert a == b != "Smith" and other.startswith("Smith alone")
    assert re.match(r"mail [а-я.]+@пример\.испытание or [α-ω]+@παράδειγμα\.δοκιμή\Z", mail), mail
    woman, man = re.match(r"κα ([Α-Ωα-ω]+)ου και κ\. ([Α-Ωα-ω]+)ος\Z", greek).groups()
    assert woman == man
    f, m, f2, m2 = re.match(r"г-жа ([А-Яа-я]+)ова и г-н ([А-Яа-я]+)ов; г-жа ([А-Яа-я]+)ская и г-н ([А-Яа-я]+)ский\Z", couple).groups()
    assert f == m and f2 == m2 != f
    first, second, third = re.match(r"pay (GB\d\d [A-Z]{4}(?: \d{4}){3} \d\d) or (DE\d{20}) or (XX11(?: \d{4}){3} \d\d)\Z", iban).groups()
    sound = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    assert sound(first.replace(" ", "")) and sound(second) and "1234" not in first
    assert re.match(r"host 2001:[0-9a-f]{3}::[0-9a-f]{4}:[0-9a-f]{3}:[0-9a-f]{4} or fe80::[0-9a-f], std::vector and a::b stay, 12:30:45 too\Z", six) and "8a2e" not in six
    given, family, again, bare = re.match(r"Frau (\w+) (\w+) sagte: (\w+) und (\w+), Webers nicht\.\Z", full).groups()
    assert (given, family) == (again, bare) and given in pii.GIVEN["f", "latin"] and family != "Weber"


# --- the plain replacement --------------------------------------------------------------------------------------

FIND = regex.compile(pii.PATTERN, regex.ASCII)
TYPES = {k: regex.compile(rf"(?:{p})\Z", regex.ASCII) for k, p in pii.PATTERNS.items()}


def plain_mentions(text):
    out, at = [], 0
    for m in FIND.finditer(text):
        kind = next(k for k, p in TYPES.items() if p.match(m[0]))
        skip = len(regex.match(pii._SECRET_KEY, m[0])[0]) if kind == "secret" and regex.match(pii._SECRET_KEY, m[0]) else 0
        out.append((text[at : m.start()] + m[0][:skip], kind, m[0][skip:]))
        at = m.end()
    return out, text[at:]


def plain_canonical(kind, value):
    if kind in ("phone", "card", "ssn"):
        return regex.sub(r"\D", "", value, flags=regex.ASCII)
    return value.replace(" ", "") if kind == "iban" else value if kind in ("secret", "ip") else value.lower()


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10


def plain_surrogate(kind, value, attempt):
    canon = plain_canonical(kind, value)
    seed = "\x1f".join([kind, canon, str(attempt)])
    drawn = b"".join(hmac.new(KEY.encode(), f"{seed}\x1f{i}".encode(), hashlib.sha512).digest() for i in range(2))
    byte = lambda i: drawn[i % 96]
    letter = lambda i, n=26: chr(97 + byte(i) % n)

    def mapped(s, at=0):
        n = 6 if re.match(r"[0-9a-f]+\Z", s) else 26
        one = lambda c, i: str(byte(i + at) % 10) if c.isdecimal() else (letter(i + at, n).upper() if c.isupper() else letter(i + at, n)) if c.isalpha() else c
        return "".join(one(c, i) for i, c in enumerate(s))

    more = "".join(letter(i + 79) for i in range(1, min(2 * attempt, 16) + 1))
    if kind in ("phone", "card", "ssn"):
        n = len(canon)
        keep = 0 if kind == "ssn" else 1
        extra = min(attempt - 3, 12) if kind == "phone" and attempt > 3 else min(attempt - 16, 12) if attempt > 16 else 0
        d = "".join(canon[i] if i < keep else str(byte(i + 1) % 10) for i in range(n)) + "".join(str(byte(i + 1) % 10) for i in range(n, n + extra))
        if kind == "card" and luhn(canon) == 0:
            d = d[: n - 1] + str((10 - luhn(d[: n - 1] + "0")) % 10)
        own = iter(d)
        return "".join(next(own) if c in "0123456789" else c for c in value) + d[n:]
    if kind == "ip":
        octet = lambda i: str(byte(i) % 254 + 1)
        if value.startswith("10.") and attempt < 12 or value.startswith("192.168.") and 4 <= attempt <= 11:
            return ".".join(["10", octet(1), octet(2), octet(3)])
        if value.startswith("192.168.") and attempt < 4:
            return ".".join(["192.168", octet(2), octet(3)])
        return ".".join(octet(i) for i in range(4))
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        tld = labels[-1].lower()
        sub = [mapped(x, 32 + 16 * i) for i, x in enumerate(labels[: max(len(labels) - 2, 0)])]
        return mapped(local) + more + "@" + ".".join([*sub, "example", tld if tld in ("com", "net", "org") else "com"])
    if kind == "secret":
        return mapped(value) + more
    raise AssertionError(kind)  # the tables have no other type


def test_plain_replacement_agrees(spark):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    laid = {d: plain_mentions(t or "") for d, t in zip(docs.doc_id, docs.text, strict=True)}
    attempt = {(k, plain_canonical(k, v)): 0 for parts, _ in laid.values() for _, k, v in parts}
    while True:
        drawn = {e: plain_canonical(e[0], plain_surrogate(*e, n)) for e, n in attempt.items()}
        winner = {}
        for e, n in attempt.items():
            winner[e[0], drawn[e]] = min(winner.get((e[0], drawn[e]), (n, e[1])), (n, e[1]))
        bad = [e for e, n in attempt.items() if winner[e[0], drawn[e]] != (n, e[1]) or (e[0], drawn[e]) in attempt]
        if not bad:
            break
        for e in bad:
            attempt[e] += 1
    want = {d: "".join(b + plain_surrogate(k, v, attempt[k, plain_canonical(k, v)]) for b, k, v in parts) + tail for d, (parts, tail) in laid.items()}
    got = {r["doc_id"]: r for r in pii.replace(spark.createDataFrame(docs[["doc_id", "text"]]), key=KEY).collect()}
    assert len(attempt) >= 15 and {k for k, _ in attempt} >= {"email", "ip", "card"}
    for d, t in want.items():
        assert (got[d]["text"] or "") == t and got[d]["n_entities"] == len(laid[d][0])
