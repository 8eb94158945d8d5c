"""Surrogates for personal data, in DataFrame functions only.

One pattern finds e-mail addresses, IPv4 and IPv6 addresses, account (IBAN), phone, card and social security numbers,
and names of any number of parts after a title.
What is found is replaced by a value that a keyed hash of its kind and canonical form gives: the same entity gets the
same surrogate everywhere and in every spelling, and each keeps its format: letters stay letters of their case and digits
digits, octets stay octets, country codes, issuer digits and the validity of check digits stay, name parts stay in their script
and given names keep their gender, where the title tells it. Names are replaced part by part, so that a surname alone is still its bearer's.

Collision checks: all entities of the corpus are gathered once. Where two, of whatever kinds, would share a surrogate,
or a surrogate is itself an entity of the corpus, all but the least take the next attempt of the hash, until all differ.
Attempts beyond the first are few and are joined back to the documents that hold such entities.

Null texts stay null; empty and very long texts are like others. Rows that agree in id and text come out alike, with or
without an id. An empty table gives an empty result; other columns, whatever their names, are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, stored, table

KEY = "marlstone"

# Titles by gender, in English, German, French, Spanish and Russian.
MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "господин")
NEUTRAL = ("Dr", "Prof", "Professor", "Mx", "Д-р", "д-р", "профессор")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Doña", "Госпожа", "госпожа")
# Syllables that surrogate names are made of, one for each hexadecimal digit.
LATIN = ("ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "pu", "ra", "se", "ti", "vo", "wa", "ze")
CYRILLIC = ("ба", "де", "фи", "го", "ху", "ка", "ле", "ми", "но", "пу", "ра", "се", "ти", "во", "ва", "зе")

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
NAME = r"\p{Lu}[\p{L}'’-]+"
#: Each begins with what rules it out soonest: most places in a text are no start of anything.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": rf"(?=[0-9])(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])",
    "ipv6": r"(?=[0-9A-Fa-f]{1,4}:)(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})(?![0-9A-Za-z:])",
    "iban": r"(?=[A-Z]{2}[0-9]{2}[ 0-9A-Z])(?<![0-9A-Za-z])(?=[A-Z]{2}(?:[ A-Z]*[0-9]){10})[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "phone": r"(?=[0-9+(])(?<![0-9A-Za-z])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{4}|\+(?=(?:[ .()-]{0,3}[0-9]){8})[0-9]{1,3}(?:[ .-]\(?[0-9]{1,8}\)?){1,6}|0[0-9](?<pair>[ .-])[0-9]{2}(?:\k<pair>[0-9]{2}){3})(?![0-9A-Za-z])",
    "card": r"(?=[0-9])(?<![0-9A-Za-z])[0-9]{4}(?<gap>[ -]?)[0-9]{4}\k<gap>[0-9]{4}\k<gap>[0-9]{1,7}(?![0-9A-Za-z])",
    "ssn": r"(?=[0-9])(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "name": rf"(?=\p{{Lu}})(?<=(?<!\p{{L}})(?:{'|'.join((*MALE, *FEMALE, *NEUTRAL))})\.?\s){NAME}(?: {NAME})*+",
}
#: The social security pattern comes before phone numbers, as these may look alike.
ORDER = ("email", "ip", "ipv6", "iban", "ssn", "card", "phone", "name")
ANY = "|".join(PATTERNS[k] for k in ORDER)
DIGITS = r"[^0-9]"
# Codes of countries, none of which begins another.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often and wherever in lambdas it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def kind_of(mention: Column, before: Column) -> Column:
    """The kind, and a name's gender by the title that ends what stands before."""
    whole = lambda k: mention.rlike(f"^(?:{PATTERNS[k]})$")
    ends = lambda titles: before.rlike(rf"(?:^|[^\p{{L}}])(?:{'|'.join(titles)})\.?\s$")
    out = F.when(mention.contains("@"), "email")
    for k in ("ip", "ipv6", "iban", "ssn", "card", "phone"):
        out = out.when(whole(k), k)
    return out.when(ends(FEMALE), "name_f").when(ends(NEUTRAL), "name_n").otherwise("name_m")


def entity(kind: Column, mention: Column) -> Column:
    """(kind, canonical) of what a mention stands for; for names, of each part, the last being the surname."""
    one = lambda k, c: F.array(F.struct(k.alias("kind"), c.alias("canonical")))
    parts = F.split(mention, " ")
    given = F.concat(F.lit("given_"), F.right(kind, F.lit(1)))
    names = F.transform(parts, lambda x, i: F.struct(F.when(i == F.size(parts) - 1, "surname").otherwise(given).alias("kind"), F.lower(x).alias("canonical")))
    code = F.regexp_extract(mention, COUNTRY, 0)
    own = F.regexp_replace(F.substring(mention, F.length(code) + 1, F.length(mention)), DIGITS, "")
    phone = F.when(code == "", own).otherwise(F.concat_ws(" ", code, own))
    lower = kind.isin("email", "ipv6")
    out = F.when(kind.startswith("name"), names).when(lower, one(kind, F.lower(mention))).when(kind == "ip", one(kind, mention)).when(kind == "phone", one(kind, phone))
    return out.when(kind == "iban", one(kind, F.replace(mention, F.lit(" "), F.lit("")))).otherwise(one(kind, F.regexp_replace(mention, DIGITS, "")))


def digest(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    """128 hexadecimal digits."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canonical, attempt.cast("string")), 512)


def number(hexes: Column, i: Column) -> Column:
    """The i-th byte (from 0, again from the start after 64)."""
    return F.conv(F.substring(hexes, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def spelled(mention: Column, hexes: Column, keep: Column, letters: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """Letters for letters and digits for digits, by their place among both; the first ``keep`` characters stay."""

    def one(c, i):
        n = number(hexes, F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), "[^A-Za-z0-9]", "")))
        return F.when(i < keep, c).otherwise(replaced(c, n, letters))

    return F.array_join(F.transform(F.split(mention, ""), one), "")


def replaced(c: Column, n: Column, letters: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    letter = F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))
    return F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c)


def luhn(digits: Column) -> Column:
    """The sum that is divisible by ten for valid card numbers."""

    def one(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), one), F.lit(0), lambda s, x: s + x)


def card(mention: Column, hexes: Column) -> Column:
    new, old = spelled(mention, hexes, F.lit(1)), F.regexp_replace(mention, DIGITS, "")
    cut = F.substring(new, F.lit(1), F.length(new) - 1)
    check = (F.lit(10) - luhn(F.concat(F.regexp_replace(cut, DIGITS, ""), F.lit("0"))) % 10) % 10
    return F.when(luhn(old) % 10 == 0, F.concat(cut, check.cast("string"))).otherwise(new)


def iban(mention: Column, hexes: Column) -> Column:
    """The country stays, and check digits are valid if they were."""
    rest = lambda x: F.replace(F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, F.lit(1), F.lit(4))), F.lit(" "), F.lit(""))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    mod = lambda x: F.aggregate(F.split(x, ""), F.lit(0), lambda s, c: (s * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    new = spelled(mention, hexes, F.lit(4))
    check = F.lpad((F.lit(98) - mod(F.concat(F.regexp_replace(rest(new), "[0-9]{2}$", ""), F.lit("00")))).cast("string"), 2, "0")
    return F.when(mod(rest(mention)) == 1, F.concat(F.substring(new, F.lit(1), F.lit(2)), check, F.substring(new, F.lit(5), F.length(new)))).otherwise(new)


def email(mention: Column, hexes: Column, attempt: Column) -> Column:
    """All but the top-level domain, each character by its place. From the eighth attempt on letters come before it, so
    that there are always enough addresses."""
    top = F.regexp_extract(mention, r"\.[^.]*$", 0)
    own = F.substring(mention, F.lit(1), F.length(mention) - F.length(top))
    more = F.when(attempt > 7, F.array_join(F.transform(F.sequence(F.lit(8), attempt), lambda i: replaced(F.lit("a"), number(hexes, i + 20))), "")).otherwise("")
    return F.concat(more, F.array_join(F.transform(F.split(own, ""), lambda c, i: replaced(c, number(hexes, i))), ""), top)


def name_part(kind: Column, part: Column, hexes: Column, attempt: Column) -> Column:
    """Three syllables, and one more for each attempt beyond the first, so that there are always enough names."""
    cyrillic = part.rlike(r"\p{IsCyrillic}")
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (number(hexes, i) % 16) + 1)
    more = lambda names: F.when(attempt > 0, F.array_join(F.transform(F.sequence(F.lit(3), attempt + 2), lambda i: pick(names, i)), "")).otherwise("")
    made = lambda names: F.concat(*[pick(names, F.lit(i)) for i in range(3)], more(names))
    ending = lambda f, m, n, s: F.when(kind == "given_f", f).when(kind == "given_m", m).when(kind == "given_n", n).otherwise(s)
    low = F.when(cyrillic, F.concat(made(CYRILLIC), ending("на", "мир", "лю", "ров"))).otherwise(F.concat(made(LATIN), ending("na", "rik", "lin", "man")))
    return F.when((F.length(part) > 1) & (F.upper(part) == part), F.upper(low)).otherwise(F.initcap(low))


def part_surrogate(key: str, kind: Column, mention: Column, canonical: Column, attempt: Column) -> Column:
    """The surrogate of an entity as spelled in ``mention``."""
    country = F.length(F.regexp_extract(mention, COUNTRY, 0))

    def made(hexes):
        octets = F.concat_ws(".", *[(number(hexes, F.lit(i)) % 254 + 1).cast("string") for i in range(4)])
        out = F.when(kind == "email", email(mention, hexes, attempt)).when(kind == "ip", octets).when(kind == "ipv6", spelled(mention, hexes, F.lit(0), "abcdef")).when(kind == "iban", iban(mention, hexes))
        return out.when(kind == "card", card(mention, hexes)).when(kind == "phone", spelled(mention, hexes, country)).when(kind == "ssn", spelled(mention, hexes, F.lit(0))).otherwise(name_part(kind, mention, hexes, attempt))

    return let(digest(key, kind, canonical, attempt), made)


def attempt_of(entity: Column, attempts: Column | None) -> Column:
    if attempts is None:
        return F.lit(0)
    return F.coalesce(F.try_element_at(attempts, F.concat_ws("\x1f", entity["kind"], entity["canonical"])), F.lit(0))


def surrogate(key: str, m: Column, attempts: Column | None) -> Column:
    """Of a mention (kind, mention)."""
    found = entity(m["kind"], m["mention"])
    parts = F.when(m["kind"].startswith("name"), F.split(m["mention"], " ")).otherwise(F.array(m["mention"]))
    each = F.zip_with(found, parts, lambda e, p: part_surrogate(key, e["kind"], p, e["canonical"], attempt_of(e, attempts)))
    return F.array_join(each, " ")


def mentions(text: Column) -> Column:
    """(kind, mention, before) in order; empty if there is none."""
    found, gaps = F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), F.split(text, ANY, -1)
    each = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda x, g: F.struct(kind_of(x, F.right(g, F.lit(12))).alias("kind"), x.alias("mention"), g.alias("before")))
    return F.when(text.rlike(ANY), each).otherwise(F.array().cast("array<struct<kind:string,mention:string,before:string>>"))


def settled(key: str, entities: DataFrame) -> DataFrame:
    """Attempts beyond the first, (kind, canonical, attempt), after which all surrogates, whatever their kinds, differ
    from each other and from all entities.

    Rounds go on until nothing collides. Spaces of names and addresses grow with the attempt; those of numbers hold 10**7
    and more of a country code or prefix, and a corpus that fills one is told apart by rounds without any progress."""
    spark = entities.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    entity = ["kind", "canonical"]
    # the number of parts is given, so that the few bytes of an entity, but much work, aren't put into one task
    now = stored(entities.select(*entity).distinct().withColumn("attempt", F.lit(0)).repartition(parts, *entity), "privacy-entities")
    real = now.select(F.col("canonical").alias("s"), F.lit(True).alias("real")).distinct()
    same = F.col("kind").isin("ip", "phone", "iban", "ipv6")
    plain = F.when(F.col("kind").isin("email", "surname", "given_f", "given_m", "given_n"), F.lower("made")).when(same, F.col("made")).otherwise(F.regexp_replace("made", DIGITS, ""))
    before, still = None, 0
    while True:
        spread = now.repartition(parts, *entity)
        made = stored(spread.withColumn("made", part_surrogate(key, F.col("kind"), F.col("canonical"), F.col("canonical"), F.col("attempt"))).select(*entity, "attempt", plain.alias("s")), "privacy-made")
        # who came first keeps the surrogate, so that what is settled stays settled
        first = made.groupBy("s").agg(F.min(F.struct("attempt", *entity)).alias("first"), F.count(F.lit(1)).alias("n"))
        again = made.join(first.hint("shuffle_hash"), "s").join(real.hint("shuffle_hash"), "s", "left").where(F.col("real") | ((F.col("n") > 1) & (F.struct("attempt", *entity) != F.col("first"))))
        again = stored(again.select(*entity, F.lit(True).alias("again")), "privacy-collisions")
        left = again.count()
        if not left:
            return now.where("attempt > 0")
        still = 0 if before is None or left < before else still + 1
        if still > 200:
            raise RuntimeError(f"{left} entities fill the space of their surrogates")
        before = left if before is None else min(before, left)
        now = stored(now.join(again.hint("shuffle_hash"), entity, "left").select(*entity, (F.col("attempt") + F.when(F.col("again"), 1).otherwise(0)).alias("attempt")), "privacy-entities")


def pseudonymise(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """All rows and columns of ``docs``, with surrogates in the text, and the number of mentions if a name for it is given."""
    found = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("h"), mentions(docs[text_col]).alias("m"))
    # explode_outer: a filter inferred from explode would be pushed below and search the texts a second time
    each = found.select("id", "h", F.explode_outer("m").alias("m")).where("m is not null").select("id", "h", F.explode(entity(F.col("m.kind"), F.col("m.mention"))).alias("e"))
    each = stored(each.select("id", "h", "e.*").distinct(), "privacy-mentions")
    late = settled(key, each)
    named = docs
    attempts = None
    m_col, t_col, i_col, h_col, late_col = (fresh(docs, c) for c in ("__m", "__t", "__id", "__h", "__late"))
    if late.limit(1).count():
        maps = each.join(late, ["kind", "canonical"]).groupBy("id", "h").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "canonical").alias("k"), "attempt"))).alias(late_col))
        maps = maps.withColumnsRenamed({"id": i_col, "h": h_col})
        keyed = docs.withColumn(t_col, F.xxhash64(docs[text_col]))
        named = keyed.join(maps, keyed[id_col].eqNullSafe(maps[i_col]) & (keyed[t_col] == maps[h_col]), "left")
        attempts = F.coalesce(late_col, F.create_map().cast("map<string,int>"))
    text, m = F.col(text_col), F.col(m_col)
    rest = F.element_at(F.split(text, ANY, -1), -1)
    spelled_out = F.concat(F.array_join(F.transform(m, lambda x: F.concat(x["before"], surrogate(key, x, attempts))), ""), rest)
    out = [F.when(F.size(m) > 0, spelled_out).otherwise(text).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return named.withColumn(m_col, mentions(text)).select(*out, *[F.size(m).alias(c) for c in [count_col] if c])


def op6_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, count_col="n_entities").select("doc_id", "n_entities", "text")
