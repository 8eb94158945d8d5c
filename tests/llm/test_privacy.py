import hashlib
import re

import pytest
import regex
from pyspark.sql import functions as F

from marlstone.llm import privacy
from marlstone.llm.privacy import op6_privacy, pseudonymise


def out(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, kind string, n int")
    found = pseudonymise(df, **kw)
    assert found.columns == df.columns
    return [r["text"] for r in found.orderBy("doc_id").collect()]


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return sum(d[0::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])


def test_formats(spark):
    texts = ["Mail Ann.Lee99@Mail5.example.com now", "at 172.242.194.228.", "+1 (499) 555-6503 or 555-010-1234", "pay 4111 1111 1111 1111 or 4381893557741609", "123-45-6789", "Dr Jones, Herr Max Weber, Frau Weber, Mme DUPONT; господин Иванов"]
    mail, ip, phone, cards, ssn, names = out(spark, texts)
    assert re.fullmatch(r"Mail [A-Z][a-z]{2}\.[A-Z][a-z]{2}\d\d@[A-Z][a-z]{3}\d\.[a-z]{7}\.com now", mail) and "Ann.Lee99" not in mail
    octets = re.fullmatch(r"at (\d+)\.(\d+)\.(\d+)\.(\d+)\.", ip).groups()
    assert ip != texts[1] and all(1 <= int(x) <= 254 for x in octets)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}", phone) and "6503" not in phone and "555-010" not in phone
    a, b = re.fullmatch(r"pay (4\d{3} \d{4} \d{4} \d{4}) or (4\d{15})", cards).groups()
    assert luhn(a.replace(" ", "")) % 10 == 0 and (a, b) != ("4111 1111 1111 1111", "4381893557741609")
    assert (luhn("4381893557741609") % 10 == 0) <= (luhn(b) % 10 == 0)
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", ssn) and ssn != texts[4]
    m = re.fullmatch(r"Dr (?!Jones)\w+man, Herr (\w+rik) (\w+man), Frau (\w+man), Mme ([A-Z]+MAN); господин (\w+ров)", names)
    assert m and m[2] == m[3] and "Weber" not in names


def test_coreference_and_distinctness(spark):
    cards = [f"{x:04d}00001111{x:04d}" for x in range(1, 60)]
    texts = [f"a@b.com A@B.com {c} {c[:4]} {c[4:8]} {c[8:12]} {c[12:]}" for c in cards]
    made = [t.split(" ") for t in out(spark, texts)]
    assert len({m[0] for m in made}) == 1 and all(m[1].lower() == m[0] for m in made)
    assert all("".join(m[3:]) == m[2] for m in made)
    assert len({m[2] for m in made}) == len(cards) and not {m[2] for m in made} & set(cards)


def test_collisions_are_settled(spark):
    """Of two-letter addresses a good part collides at first."""
    mails = [f"{a}{b}@x.io" for a in "abcdefghijklmnopqrst" for b in "abcdefg"]
    made = out(spark, mails)
    assert len(set(made)) == len(mails) and not set(made) & set(mails)
    assert out(spark, mails) == made and out(spark, mails, key="other") != made
    late = privacy.settled(privacy.KEY, spark.createDataFrame([("email", m) for m in mails], "kind string, canonical string"))
    assert late.count() > 0


def test_cases(spark):
    long = "word " * 30_000 + "a@b.com"
    texts = [None, "", "nothing here 12 1.2.3 v1.2.3.4.5 2024-01-02", long, "a@b.com"]
    made = out(spark, texts)
    assert made[:3] == texts[:3]
    assert made[3] == "word " * 30_000 + made[4] and made[4] != "a@b.com"
    df = spark.createDataFrame([(None, "a@b.com"), (None, "c@d.com"), (1, "a@b.com"), (1, "a@b.com")], "doc_id long, text string")
    assert pseudonymise(df).count() == 4 and pseudonymise(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    found = op6_privacy(spark, f"/root/testdata/{sf}")
    assert not re.search("Python|Pandas", found._jdf.queryExecution().toString())
    some = 0
    for r in found.collect():
        old = texts[r["doc_id"]]
        private = re.findall(r"[\w.]+@\w+\.example\.com|(?<![\w.])\d{16}(?!\w)|\+1 \(\d{3}\) \d{3}-\d{4}", old)
        some += len(private)
        assert not any(p in r["text"] for p in private)
        assert (r["n_entities"] == 0) == (old == r["text"])
        mask = lambda t: re.sub(r"\d+\.\d+\.\d+\.\d+|[A-Za-z0-9._%+-]+@\S+|[0-9]", "#", t)
        assert mask(old) == mask(r["text"])
    assert some


def test_phones_are_compared_as_written(spark):
    """The surrogate that settled() compares is the canonical form of the one in the text."""
    phones = [f"+{c} (499) 555-{n}" for c in (1, 49, 353) for n in range(6500, 6510)] + ["555-010-1234", "+1499 555 6500"]
    df = spark.createDataFrame([("phone", p) for p in phones], "kind string, mention string")
    e = privacy.entity(df["kind"], df["mention"])[0]
    written = privacy.part_surrogate(privacy.KEY, df["kind"], df["mention"], e["canonical"], F.lit(0))
    made = privacy.part_surrogate(privacy.KEY, df["kind"], e["canonical"], e["canonical"], F.lit(0))
    found = df.select("mention", e["canonical"].alias("canonical"), written.alias("written"), made.alias("made"), privacy.entity(df["kind"], written)[0]["canonical"].alias("again")).collect()
    assert all(r["made"] == r["again"] != r["canonical"] for r in found)
    assert all(r["written"].split(" ")[0] == r["mention"].split(" ")[0] for r in found[:-2])
    assert found[0]["canonical"] == found[-1]["canonical"] == "+1 4995556500"


def test_more_names_than_three_syllables_give(spark):
    names = sorted({"".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(0, 17576, 3)})
    entities = spark.createDataFrame([("surname", n) for n in names], "kind string, canonical string")
    late = privacy.settled(privacy.KEY, entities)
    attempts = entities.join(late, ["kind", "canonical"], "left").select("canonical", F.coalesce("attempt", F.lit(0)).alias("attempt"))
    made = [r[0].lower() for r in attempts.select(privacy.part_surrogate(privacy.KEY, F.lit("surname"), F.col("canonical"), F.col("canonical"), F.col("attempt"))).collect()]
    assert len(names) > 5000 and len(set(made)) == len(names) and not set(made) & set(names)


def test_further_formats(spark):
    texts = ["01 23 45 67 89 or +49 30 1234567, +33 1 23 45 67 89.", "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432", "2001:db8:85a3:0:0:8a2e:370:7334, fe80:1::8a2e", "Mr John Quincy Adams met Prof. Ada Lee", "+12 +1 000 a::b 12:30:45 ab::cd SOME CAPS HERE AB12 ONLY WORDS FOLLOW"]
    phones, ibans, ips, names, clean = out(spark, texts)
    assert re.fullmatch(r"0\d \d\d \d\d \d\d \d\d or \+49 \d\d \d{7}, \+33 \d \d\d \d\d \d\d \d\d\.", re.sub("^.", "0", phones)) and "1234567" not in phones
    one, two = re.fullmatch(r"(DE\d\d(?: \d{4}){4} \d\d) and (GB\d\d[A-Z]{4}\d{14})", ibans).groups()
    for x in (one.replace(" ", ""), two):
        assert int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1 and x not in texts[1].replace(" ", "")
    assert re.fullmatch(r"\d{4}:[a-f]{2}\d:\d\d[a-f]\d:\d:\d:\d[a-f]\d[a-f]:\d{3}:\d{4}, [a-f]{2}\d\d:\d::\d[a-f]\d[a-f]", ips) and ips != texts[2]
    assert re.fullmatch(r"Mr \w+rik \w+rik \w+man met Prof\. \w+lin \w+man", names) and not re.search("John|Quincy|Adams|Ada|Lee", names)
    assert clean == texts[4]


def pattern(java):
    return re.sub(r"\\k<(\w+)>", r"(?P=\1)", java)


class Plainly:
    """The whole operator over a list of texts, in plain Python."""

    def __init__(self, key):
        self.key, self.whole = key, regex.compile(pattern(privacy.ANY))

    def kind(self, text, m):
        x = m.group()
        if "@" in x:
            return "email"
        for k in ("ip", "ipv6", "iban", "ssn", "card", "phone"):
            if regex.fullmatch(pattern(privacy.PATTERNS[k]), x):
                return k
        title = re.search(r"(\w[\w-]*)\.?\s$", text[: m.start()]).group(1)
        return "name_f" if title in privacy.FEMALE else "name_n" if title in privacy.NEUTRAL else "name_m"

    def entities(self, kind, x):
        if kind.startswith("name"):
            *given, last = x.split(" ")
            return [("given_" + kind[-1], g.lower()) for g in given] + [("surname", last.lower())]
        if kind == "phone":
            code = (re.match(privacy.COUNTRY, x) or re.match("", x)).group()
            return [(kind, " ".join(y for y in (code, re.sub("[^0-9]", "", x[len(code) :])) if y))]
        return [(kind, {"email": x.lower(), "ipv6": x.lower(), "ip": x, "iban": x.replace(" ", "")}.get(kind, re.sub("[^0-9]", "", x)))]

    def made(self, kind, x, canonical, attempt):
        h = hashlib.sha512("\x1f".join([self.key, kind, canonical, str(attempt)]).encode()).digest()
        low = "abcdefghijklmnopqrstuvwxyz"

        def swap(c, n, letters=low):
            return str(n % 10) if c.isdigit() and c.isascii() else letters[n % len(letters)] if re.match("[a-z]", c) else letters[n % len(letters)].upper() if re.match("[A-Z]", c) else c

        def spell(keep, letters=low):
            at, out = 0, ""
            for i, c in enumerate(x):
                out += c if i < keep else swap(c, h[at % 64], letters)
                at += bool(re.match("[A-Za-z0-9]", c))
            return out

        if kind == "email":
            own, _, top = x.rpartition(".")
            return "".join(swap("a", h[(i + 20) % 64]) for i in range(8, attempt + 1)) + "".join(swap(c, h[i % 64]) for i, c in enumerate(own)) + "." + top
        if kind == "ip":
            return ".".join(str(b % 254 + 1) for b in h[:4])
        if kind == "card":
            new = spell(1)
            if luhn(re.sub(r"\D", "", x)) % 10:
                return new
            return next(new[:-1] + d for d in "0123456789" if luhn(re.sub(r"\D", "", new[:-1] + d)) % 10 == 0)
        if kind == "iban":
            new, number = spell(4), lambda t: int("".join(str(int(c, 36)) for c in (t[4:] + t[:4]).replace(" ", "")))
            return next(new[:2] + f"{c:02d}" + new[4:] for c in range(2, 99) if number(new[:2] + f"{c:02d}" + new[4:]) % 97 == 1) if number(x) % 97 == 1 else new
        if kind in ("phone", "ssn", "ipv6"):
            code = re.match(privacy.COUNTRY, x)
            return spell(len(code.group()) if kind == "phone" and code else 0, "abcdef" if kind == "ipv6" else low)
        cyrillic = bool(regex.search(r"\p{IsCyrillic}", x))
        parts, ends = (privacy.CYRILLIC, ("на", "мир", "лю", "ров")) if cyrillic else (privacy.LATIN, ("na", "rik", "lin", "man"))
        name = "".join(parts[h[i] % 16] for i in range(3 + attempt)) + ends[{"given_f": 0, "given_m": 1, "given_n": 2}.get(kind, 3)]
        return name.upper() if len(x) > 1 and x.upper() == x else name.capitalize()

    def plain(self, kind, canonical, attempt):
        x = self.made(kind, canonical, canonical, attempt)
        return x.lower() if kind == "email" or "given" in kind or kind == "surname" else x if kind in ("ip", "phone", "iban", "ipv6") else re.sub(r"\D", "", x)

    def run(self, texts):
        every = {e for t in texts if t for m in self.whole.finditer(t) for e in self.entities(self.kind(t, m), m.group())}
        real, now = {c for _, c in every}, dict.fromkeys(every, 0)
        while True:
            taken = {}
            for (k, c), a in sorted(now.items(), key=lambda x: (x[1], x[0])):
                taken.setdefault(self.plain(k, c, a), (k, c))
            again = [e for e, a in now.items() if (s := self.plain(*e, a)) in real or taken[s] != e]
            if not again:
                break
            for e in again:
                now[e] += 1

        def swap(t, m):
            kind = self.kind(t, m)
            return " ".join(self.made(e[0], p, e[1], now[e]) for e, p in zip(self.entities(kind, m.group()), m.group().split(" ") if kind.startswith("name") else [m.group()], strict=True))

        return [t if t is None else self.whole.sub(lambda m: swap(t, m), t) for t in texts]


def test_query_is_the_plain_one(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(rows, Plainly(privacy.KEY).run(list(rows.values())), strict=True))
    assert {r["doc_id"]: r["text"] for r in op6_privacy(spark, sf).collect()} == want and want != rows


def test_mixed_texts_are_the_plain_ones(spark):
    names = ["Mr Al Bo", "Frau Bo", "Dr Al Bo-Ce", "Prof. Jo", "Mme LI", "господин Иванов", "Sra Ana María Sol"]
    some = ["a@b.io", "B@c.io", "1.2.3.4", "+1 (499) 555-6503", "555-010-1234", "01 23 45 67 89", "+49 30 1234567", "4111 1111 1111 1111", "4381893557741609", "123-45-6789", "DE89 3704 0044 0532 0130 00", "GB00WEST12345698765432", "fe80:1::8a2e"]
    texts = [" and ".join((names + some)[(i * k) % 20] for k in range(1, 6)) + ", x" for i in range(60)] + [f"{a}{b}@x.io" for a in "abcdefghijklmnopqrst" for b in "abcdefg"] + [None, ""]
    assert out(spark, texts) == Plainly(privacy.KEY).run(texts)


def test_kinds_share_no_surrogate_and_names_never_run_out(spark):
    """Numbers that a phone and a card may both become, and more addresses than their shape has room for."""
    mails = [f"{a}@{b}.io" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    made = out(spark, [*mails, *(f"Herr {a}{b}{c}x" for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "aeiou" for c in "bcdfghjklmnpqrstvwz")])
    assert len(set(made)) == len(made) and not set(made) & set(mails)


def test_columns_may_be_called_anything(spark):
    cols = ["doc_id", "text", "__m", "__t", "__id", "__h", "__late", "m", "h", "e", "kind"]
    df = spark.createDataFrame([(1, "a@b.io", *range(9)), (2, "c@d.io", *range(9))], ", ".join(f"{c} {'string' if c == 'text' else 'long'}" for c in cols))
    found = pseudonymise(df)
    assert found.columns == cols and [list(r)[2:] for r in found.collect()] == [list(range(9))] * 2
