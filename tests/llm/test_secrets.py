import hashlib
import re

from marlstone.llm import secrets
from marlstone.llm.secrets import BASE, RULES, Rule, op8_secrets, scan, spelled


def plainly(text):
    """The base kinds as defined, without any shortcut."""
    out = []
    letters = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join(letters(w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    for m in re.finditer(rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (name, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return ",".join(x for _, _, x in sorted(out))


TEXTS = [
    None, "", "token = abc", "token: token = abcdefgh", 'é API_KEY="abcdef" ſecret=abcdefgh toKen=abcdefgh', "secret=secret=secret=secret", "passwd:  'x.y+z/==' apikey:=12345678",
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + " AKIAAKIA" + "C" * 12, "0" * 23 + " " + "a" * 24 + "g" + "f" * 40, "token=" + "a" * 30, "x" * 5000 + "token=" + "9" * 40,
    "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "see https://user:pa55@host/",
]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, findings string")


def test_base_kinds(spark, tmp_path):
    found = {r["doc_id"]: r for r in scan(spark, table(spark, TEXTS), str(tmp_path / "l")).select("doc_id", spelled(secrets.F.col("findings"), BASE).alias("base"), spelled(secrets.F.col("findings")).alias("all")).collect()}
    assert len(found) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert found[i]["base"] == plainly(t or ""), t
        assert set(found[i]["base"].split(",")) - {""} <= set(found[i]["all"].split(","))
    assert found[11]["all"].startswith("pem:0:") and "login:" in found[12]["all"]


def test_scans_only_what_is_new(spark, tmp_path):
    ledger = str(tmp_path / "l")
    a = table(spark, ["token=abcdefgh", "token=abcdefgh", "plain"])
    assert [len(r["findings"]) for r in scan(spark, a, ledger, BASE).orderBy("doc_id").collect()] == [1, 1, 0]
    assert spark.read.parquet(ledger).count() == 2
    scan(spark, a, ledger, BASE)
    assert spark.read.parquet(ledger).count() == 2
    more = (*BASE[:2], Rule("hex", 2, r"[0-9a-f]{6,}", 0, 6))
    b = table(spark, ["token=abcdefgh", "deadbeef", "plain"])
    assert [len(r["findings"]) for r in scan(spark, b, ledger, more).orderBy("doc_id").collect()] == [1 + 1, 1, 0]
    pairs = [(bytes(r["blob"]).hex()[:6], k) for r in spark.read.parquet(ledger).collect() for k in r["rules"]]
    assert len(pairs) == len(set(pairs)) == 2 * 4 + 3
    assert scan(spark, a.limit(0), str(tmp_path / "none"), RULES).count() == 0


def test_null_and_repeated_ids(spark, tmp_path):
    df = spark.createDataFrame([(None, "token=abcdefgh"), (None, "token=abcdefgh"), (1, "token=abcdefgh"), (1, "other")], "doc_id long, text string")
    found = scan(spark, df, str(tmp_path / "l")).collect()
    assert sorted(len(r["findings"]) for r in found) == [0, 1, 1, 1]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = op8_secrets(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        base = plainly(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert r["n_assign"] + r["n_access"] + r["n_hex"] == len(base.split(",")) - (not base)
