"""Operator 8, personal data [native]: format-preserving Feistel pseudonyms.

One pattern finds candidates; each is validated by its kind (Luhn sum, octets, calendar, number ranges) and replaced by
a keyed permutation of its format: an alternating Feistel network over exactly the kind's values (mixed radix, so no
value falls outside and no cycle need be walked), with SHA-256 as round function. The map is one-to-one, so equal values
stay equal, and different ones different, across documents and runs with one key; separators, country codes and the
validity of check digits stay. The text is put together again from the stretches between candidates, in one pass without
a shuffle. Names of mailboxes and secrets have no numeric format: they get a keyed digest in their shape.

Kinds: card (13 to 19 digits, Luhn), iban (rest 1 by 97), ip (IPv4), ipv6 (all eight groups), phone, ssn, date (1900 to
2299; yyyy-mm-dd, dd/mm/yyyy, mm/dd/yyyy), email (its domain, up to 127 labels, stays), secret (32 to 64 hex digits of
one case; what follows password, token and the like). What fails validation stays. No pattern repeats a group without
bound, so no text, however long, can exhaust a thread's stack. Null text: stays null, nothing found. Texts of any length
are read whole. Every row keeps its row; other columns pass through, whatever their names, but one that has the name of an
output gives way to it. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears.llm._common import unpacked, whole_rows

ROUNDS = 8
# Patterns by kind.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,126}"
NAMED = r"(?<![A-Za-z0-9])(?i:api_?key|token|secret|password|passwd)[ \t]{0,3}[=:][ \t]{0,3}[\"']?[A-Za-z0-9+/_.~!*-]{6,}"
HEX = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])"
IPV6 = r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"
PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]){7,12}(?![0-9])"
DATE = r"(?<![0-9A-Za-z])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IP = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5})(?![0-9])"
ANY = "|".join((EMAIL, NAMED, HEX, IBAN, IPV6, PHONE, DATE, SSN, IP, CARD))
DAYS = 146_097  # of 400 years, 189 x 773
DAY_RADIX = (189, 773)


def keyed(key: str, kind: str, *parts: Column) -> Column:
    """60 bits of a keyed digest."""
    return F.conv(F.substring(F.sha2(F.concat_ws("/", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str, then) -> Column:
    """then(l, r) of the keyed permutation of pairs (left below a, right below b)."""

    def turn(x: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(x["l"] + keyed(key, kind, i, x["r"]), a)).otherwise(x["l"]).alias("l"),
            F.when(even, x["r"]).otherwise(F.pmod(x["r"] + keyed(key, kind, i, x["l"]), b)).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda x: then(x["l"], x["r"]))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def let(value: Column, then) -> Column:
    """then(value), the value being evaluated once, however often `then` and the functions in it refer to it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def sub(x: Column, start: Column | int, n: Column | int) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, int) else v
    return F.substr(x, lit(start), lit(n))


def permuted_digits(d: Column, key: str, kind: str) -> Column:
    """A string of as many digits, 2 to 36."""
    n = F.length(d)
    u = F.floor(n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    return feistel(
        sub(d, 1, u).cast("long"), sub(d, u + 1, n).cast("long"), power(u), power(n - u), key, kind,
        lambda x, y: F.concat(F.lpad(x.cast("string"), u, F.lit("0")), F.lpad(y.cast("string"), n - u, F.lit("0"))),
    )


def luhn_sum(d: Column) -> Column:
    """The Luhn sum of a string of digits whose last one is a check digit."""

    def of(d: Column) -> Column:
        def add(s: Column, i: Column) -> Column:
            x = sub(d, i, 1).cast("int")
            twice = 2 * x - F.when(x > 4, 9).otherwise(0)
            return s + F.when((F.length(d) - i) % 2 == 1, twice).otherwise(x)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)

    return let(d, of)


def laid(m: Column, d: Column) -> Column:
    """m, with its digits replaced by those of d in order."""
    at = lambda i: sub(m, i, 1)
    one = lambda d: lambda i: F.when(at(i).between("0", "9"), sub(d, F.length(digits(sub(m, 1, i))), 1)).otherwise(at(i))
    return let(d, lambda d: F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), one(d)), ""))


def card(m: Column, key: str) -> Column:
    d = digits(m)
    full = lambda body: F.concat(body, F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string"))
    return laid(m, let(permuted_digits(sub(d, 1, F.length(d) - 1), key, "card"), full))


def phone(m: Column, key: str) -> Column:
    kept = lambda d: F.greatest(F.length(d) - 10, F.lit(0))
    return laid(m, let(digits(m), lambda d: F.concat(sub(d, 1, kept(d)), permuted_digits(sub(d, kept(d) + 1, 10), key, "phone"))))


def octet(m: Column, i: int) -> Column:
    return F.get(F.split(m, r"\."), F.lit(i)).cast("int")


def ip(m: Column, key: str) -> Column:
    two = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    size = F.lit(65_536)
    return feistel(octet(m, 0) * 256 + octet(m, 1), octet(m, 2) * 256 + octet(m, 3), size, size, key, "ip", lambda x, y: F.concat_ws(".", two(x), two(y)))


def ipv6(m: Column, key: str) -> Column:
    """Both halves of the address are permuted, each among all its values."""
    group = lambda i: F.conv(F.get(F.split(m, ":"), F.lit(i)), 16, 10).cast("long")
    size = F.lit(1 << 32)
    two = lambda x: F.concat_ws(":", F.lower(F.hex(F.floor(x / 65_536).cast("long"))), F.lower(F.hex(F.pmod(x, F.lit(65_536)))))
    half = lambda i, kind: feistel(
        group(i) * 65_536 + group(i + 1), group(i + 2) * 65_536 + group(i + 3), size, size, key, kind, lambda x, y: F.concat_ws(":", two(x), two(y))
    )
    return F.concat_ws(":", half(0, "ipv6/0"), half(4, "ipv6/1"))


def rest_of_97(s: Column) -> Column:
    """The rest, divided by 97, of the number that letters (A is 10) and digits spell."""

    def of(s: Column) -> Column:
        def add(r: Column, i: Column) -> Column:
            c = sub(s, i, 1)
            return F.when(c.between("0", "9"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add)

    return let(s, of)


def iban(m: Column, key: str) -> Column:
    """Country and letters stay, the digits of the account are permuted, the check digits follow."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    permuted = lambda a: F.when(F.length(digits(a)) >= 2, laid(a, permuted_digits(digits(a), key, "iban"))).otherwise(a)
    check = lambda a: F.lpad((98 - rest_of_97(F.concat(a, sub(plain, 1, 2), F.lit("00")))).cast("string"), 2, F.lit("0"))
    return laid(m, let(let(sub(plain, 5, 40), permuted), lambda a: digits(F.concat(check(a), a))))


def ssn(m: Column, key: str) -> Column:
    area, group, serial = sub(m, 1, 3).cast("int"), sub(m, 5, 2).cast("int"), sub(m, 8, 4).cast("int")

    def put(x: Column, y: Column) -> Column:
        a = F.floor(x / 99) + 1
        a = a + F.when(a >= 666, 1).otherwise(0)
        pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
        return F.concat_ws("-", pad(a, 3), pad(x % 99 + 1, 2), pad(y + 1, 4))

    return feistel((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn", put)


def day_of(m: Column) -> Column:
    """Days since 1900, or null."""
    form = lambda f: F.try_to_timestamp(m, F.lit(f)).cast("date")
    day = F.when(m.contains("-"), form("yyyy-MM-dd")).otherwise(F.coalesce(form("dd/MM/yyyy"), form("MM/dd/yyyy")))
    n = F.datediff(day, F.lit("1900-01-01").cast("date"))
    return F.when(n.between(0, DAYS - 1), n)


def date(m: Column, key: str) -> Column:
    a, b = DAY_RADIX
    moved = lambda n: feistel(F.floor(n / b), n % b, F.lit(a), F.lit(b), key, "date", lambda x, y: F.date_add(F.lit("1900-01-01").cast("date"), (x * b + y).cast("int")))
    european = F.try_to_timestamp(m, F.lit("dd/MM/yyyy")).isNotNull()
    put = lambda day: F.when(m.contains("-"), F.date_format(day, "yyyy-MM-dd")).when(european, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "MM/dd/yyyy"))
    return let(let(day_of(m), moved), put)


def email(m: Column, key: str) -> Column:
    name, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return F.concat(F.lit("u"), F.lpad(F.pmod(keyed(key, "email", F.lower(name), F.lower(domain)), F.lit(10**12)).cast("string"), 12, "0"), F.lit("@"), domain)


def secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"([A-Za-z0-9+/_.~!*-]+)$", 1)
    return F.concat(sub(m, 1, F.length(m) - F.length(value)), F.rpad(F.sha2(F.concat_ws("/", F.lit(key), F.lit("secret"), value), 256), F.length(value), F.lit("0")))


def kind_of(m: Column) -> Column:
    """The kind of a candidate, or null if it fails validation."""
    d = digits(m)
    area = sub(m, 1, 3)
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"), "ipv6")
        .when(m.rlike(r"^[A-Za-z_]+[ \t]*[=:]") | m.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"), "secret")
        .when(m.rlike("^[A-Z]{2}[0-9]{2}"), F.when(rest_of_97(F.concat(sub(F.replace(m, F.lit(" "), F.lit("")), 5, 40), sub(m, 1, 4))) == 1, "iban"))
        .when(m.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), F.when((octet(m, 0) < 256) & (octet(m, 1) < 256) & (octet(m, 2) < 256) & (octet(m, 3) < 256), "ip"))
        .when(m.rlike("^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})$"), F.when(day_of(m).isNotNull(), "date"))
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(~area.isin("000", "666") & (area < "900") & (sub(m, 5, 2) != "00") & (sub(m, 8, 4) != "0000"), "ssn"))
        .when(m.rlike("^(?:[0-9]{13,}|[0-9]{4}[ -].*)$"), F.when(luhn_sum(d) % 10 == 0, "card"))
        .otherwise("phone")
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    out = m
    for name, of in (("email", email), ("secret", secret), ("ip", ip), ("ipv6", ipv6), ("iban", iban), ("date", date), ("ssn", ssn), ("card", card), ("phone", phone)):
        out = F.when(kind == name, of(m, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, *, key: str, text_col: str = "text", out: str = "_text", n_found: str = "_n_found", kinds: str = "_kinds") -> DataFrame:
    """All columns of docs, the text with pseudonyms, how many values it had, and their kinds, sorted and comma-joined."""
    text = F.col("row")[text_col].cast("string")
    found = F.when(text.rlike("[0-9@=:]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    some = F.size("m") > 0
    named = F.transform("m", lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    replaced = F.transform("k", lambda x: pseudonym(x["m"], x["kind"], key))
    rows = whole_rows(docs).select("row", F.coalesce(found, F.array().cast("array<string>")).alias("m"))
    rows = rows.withColumn("k", F.when(some, named)).withColumn("r", replaced).withColumn("s", F.when(some, F.split(text, ANY, -1)))
    woven = F.array_join(F.zip_with("s", "r", lambda s, r: F.concat(s, F.coalesce(r, F.lit("")))), "")
    hit = F.filter("k", lambda x: x["kind"].isNotNull())
    met = F.array_sort(F.array_distinct(F.transform(hit, lambda x: x["kind"])))
    return unpacked(
        rows, docs.columns,
        **{out: F.when(some, woven).otherwise(text), n_found: F.coalesce(F.size(hit), F.lit(0)).cast("long"), kinds: F.coalesce(F.array_join(met, ","), F.lit(""))},
    )
