import datetime as dt
import hashlib
import re

from pyspark.sql import functions as F

from arrears.llm import pii, q08

KEY = "pseudonym-key"


def keyed(kind, *parts):
    return int(hashlib.sha256("/".join([KEY, kind, *map(str, parts)]).encode()).hexdigest()[:15], 16)


def feistel(x, y, a, b, kind):
    for i in range(8):
        if i % 2 == 0:
            x = (x + keyed(kind, i, y)) % a
        else:
            y = (y + keyed(kind, i, x)) % b
    return x, y


def digits(d, kind):
    u = len(d) // 2
    x, y = feistel(int(d[:u]), int(d[u:]), 10**u, 10 ** (len(d) - u), kind)
    return f"{x:0{u}d}{y:0{len(d) - u}d}"


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10


def laid(m, d):
    it = iter(d)
    return re.sub("[0-9]", lambda _: next(it), m)


def brute(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "card":
        body = digits(d[:-1], "card")
        return laid(m, body + str(-luhn(body + "0") % 10))
    if kind == "phone":
        k = max(len(d) - 10, 0)
        return laid(m, d[:k] + digits(d[k:], "phone"))
    if kind == "ip":
        o = list(map(int, m.split(".")))
        x, y = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if kind == "ipv6":
        g = [int(x, 16) for x in m.split(":")]
        out = []
        for at in (0, 4):
            for v in feistel((g[at] << 16) + g[at + 1], (g[at + 2] << 16) + g[at + 3], 2**32, 2**32, f"ipv6/{at // 4}"):
                out += [f"{v >> 16:x}", f"{v & 65535:x}"]
        return ":".join(out)
    if kind == "iban":
        plain = m.replace(" ", "")
        old = re.sub("[^0-9]", "", plain[4:])
        account = laid(plain[4:], digits(old, "iban"))
        n = int("".join(str(int(c, 36)) for c in account + plain[:2] + "00"))
        return laid(m, f"{98 - n % 97:02d}" + re.sub("[^0-9]", "", account))
    if kind == "date":
        form = "%Y-%m-%d" if "-" in m else "%d/%m/%Y"
        try:
            day = dt.datetime.strptime(m, form)
        except ValueError:
            form = "%m/%d/%Y"
            day = dt.datetime.strptime(m, form)
        n = (day - dt.datetime(1900, 1, 1)).days
        x, y = feistel(n // 773, n % 773, 189, 773, "date")
        return (dt.datetime(1900, 1, 1) + dt.timedelta(days=x * 773 + y)).strftime(form)
    if kind == "ssn":
        a, g, s = map(int, m.split("-"))
        x, y = feistel((a - 1 - (a > 666)) * 99 + g - 1, s - 1, 898 * 99, 9999, "ssn")
        a = x // 99 + 1
        return f"{a + (a >= 666):03d}-{x % 99 + 1:02d}-{y + 1:04d}"


GOOD = [
    ("card", "4111111111111111"), ("card", "4111 1111 1111 1111"), ("card", "5555-5555-5555-4444"), ("phone", "+1 (663) 555-6869"), ("phone", "212-555-0147"),
    ("phone", "+49 30 1234567"), ("ip", "192.168.0.254"), ("ip", "0.0.0.0"), ("date", "2024-02-29"), ("date", "31/12/1999"), ("date", "12/31/1999"), ("ssn", "123-45-6789"), ("ssn", "899-99-9999"),
    ("iban", "DE89370400440532013000"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("ipv6", "2001:db8:0:0:1:ffff:0:abcd"),
]
BAD = ["4111111111111112", "300.1.1.1", "2023-02-30", "666-12-3456", "1.2.3", "12345678", "1850-01-01", "a@b", "99/99/9999", "x4111111111111111", "DE89370400440532013001", "1:2:3:4:5:6:7"]


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, kinds string")
    return [(r._text, r._n_found, r._kinds) for r in pii.pseudonymise(df, key=KEY).orderBy("doc_id").collect()]


def test_each_kind_matches_brute_force(spark):
    got = run(spark, [f"é before {m}, after." for _, m in GOOD])
    assert got == [(f"é before {brute(k, m)}, after.", 1, k) for k, m in GOOD]
    for (k, m), (t, _, _) in zip(GOOD, got, strict=True):
        new = t[len("é before ") : -len(", after.")]
        assert new != m and (k == "ipv6" or re.sub("[0-9]+", "9", new) == re.sub("[0-9]+", "9", m))
        assert k != "iban" or int("".join(str(int(c, 36)) for c in new.replace(" ", "")[4:] + new[:4])) % 97 == 1
        assert k != "card" or luhn(re.sub("[^0-9]", "", new)) == 0


def test_invalid_values_null_and_blank_stay(spark):
    texts = [*[f"x {b} y" for b in BAD], None, "", "no numbers at all"]
    assert run(spark, texts) == [(t, 0, "") for t in texts]


def test_values_side_by_side_and_linked_across_documents(spark):
    card, ip, phone = "4111111111111111", "27.65.93.188", "+1 (663) 555-6869"
    mail, token = "thwhhe.68@mail2.example.com", 'token = "11acdfb36bb72224148e6160f674b4be45601bff"'
    text = f"{phone} {card} {ip}\n{mail}%%% {token}### {card}"
    one, two, long = run(spark, [text, f"again {card} {mail} password = hunter22x", "word " * 30_000 + card])
    assert one[1:] == (6, "card,email,ip,phone,secret") and two[1:] == (3, "card,email,secret") and long[1:] == (1, "card")
    new = brute("card", card)
    assert one[0].count(new) == 2 and new in two[0] and long[0].endswith(new) and len(long[0]) == 5 * 30_000 + len(card)
    for x in (card, ip, phone, mail, "11acdf", "hunter22x"):
        assert x not in one[0] + two[0]
    fake = re.search(r"u\d{12}@mail2\.example\.com", one[0])[0]
    assert fake in two[0] and one[0].startswith(f"{brute('phone', phone)} {new} {brute('ip', ip)}\n{fake}%%% token = \"") and one[0].endswith(f'"### {new}')


def test_permutations_are_one_to_one(spark):
    days = spark.range(0, 146_097, 37).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("m"))
    assert days.select(pii.date(F.col("m"), "k").alias("x")).distinct().count() == days.count()
    short = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("m"))
    assert short.select(pii.permuted_digits(F.col("m"), "k", "z").alias("x")).distinct().count() == 1000


def test_rows_are_kept(spark, tmp_path):
    spark.createDataFrame([(1, "a 1.2.3.4"), (1, "a 1.2.3.4"), (None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, q08.op8_pii(spark, str(tmp_path)).collect()), key=str)
    assert len(got) == 3 and got[0] == got[1] and got[2] == (None, 0, "", None)
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), key=KEY).count() == 0


def test_a_million_repetitions_of_each_part(spark):
    """No pattern may need a stack that grows with the text."""
    n = 1_000_000
    parts = ["a@b" + ".c" * n, "a" * n + "@b.c", "a@" + "b" * n + ".c", "password=" + "x" * n, "password" + " " * n + "=x", "a" * n, "A" * n, "1" * n, "1." * n, "1-" * n, "1 " * n, "1:" * n, "+1" * n, "(" * n, "@" * n, "AB12 " + "AB12 " * n]
    got = run(spark, [f"{x} 4111111111111111" for x in parts])
    assert all(brute("card", "4111111111111111") in t for t, _, _ in got)
    assert got[0][0].startswith("u") and got[0][2] == "card,email"


def test_clashing_columns_pass_through(spark):
    names = ["doc_id", "text", "row", "m", "k", "r", "s", "_m", "_k", "_r", "_s", "key", "kind", "_text", "_N_found"]
    df = spark.createDataFrame([(1, "ip 1.2.3.4", *names[2:])], ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in names))
    out = pii.pseudonymise(df, key=KEY)
    assert out.columns == [*names[:-2], "_text", "_n_found", "_kinds"]
    r = out.first()
    assert [r[c] for c in names[2:-2]] == names[2:-2] and r._text == f"ip {brute('ip', '1.2.3.4')}" and r._n_found == 1
