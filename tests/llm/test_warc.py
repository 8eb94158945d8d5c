import gzip
import hashlib
import random

import pytest

from marlstone.llm import warc


def record(i, payload, digest=True):
    own = hashlib.sha1(payload).hexdigest()
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:row:{i}>\r\n" + f"WARC-Payload-Digest: sha1:{own}\r\n" * digest + f"Content-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def covers(found, size):
    at = 0
    for _, a, b, _, _ in found:
        assert a == at
        at = b
    assert at == size


def test_salvages_around_damage():
    parts = [record(i, bytes([65 + i]) * (50 + i)) for i in range(6)]
    whole = b"".join(parts)
    found = list(warc.salvage(whole))
    assert [x[0] for x in found] == ["record"] * 6
    damaged = [parts[0], parts[1].replace(b"BBBB", b"BxBB", 1), parts[2], b"noise WARC/1.1 noise", parts[3].replace(b"Content-Length: 53", b"Content-Length: 99999"), parts[4], parts[5][:-10]]
    data = b"".join(damaged)
    found = list(warc.salvage(data))
    covers(found, len(data))
    assert [x[3]["warc-record-id"] for x in found if x[0] == "record"] == [f"<urn:row:{i}>" for i in (0, 2, 4)]
    assert [x[3] for x in found if x[0] == "gap"] == ["payload digest differs", "no version line", "cut off"]


def test_salvages_members():
    parts = [gzip.compress(record(i, bytes([65 + i]) * 500)) for i in range(5)]
    broken = bytearray(parts[2])
    broken[20] ^= 255
    data = parts[0] + b"junk" + parts[1] + bytes(broken) + parts[3] + parts[4][:-6]
    found = list(warc.salvage(data))
    covers(found, len(data))
    assert [x[3]["warc-record-id"] for x in found if x[0] == "record"] == [f"<urn:row:{i}>" for i in (0, 1, 3)]


def test_random_damage_loses_only_what_it_hits():
    rng = random.Random(5)
    parts = [record(i, rng.randbytes(200)) for i in range(30)]
    for _ in range(40):
        data, hit = bytearray(b"".join(parts)), set()
        for _ in range(3):
            i = rng.randrange(len(data))
            data[i] ^= 1 + rng.randrange(255)
            hit.add(i)
        starts = [sum(map(len, parts[:i])) for i in range(31)]
        found = list(warc.salvage(bytes(data)))
        covers(found, len(data))
        kept = {x[1] for x in found if x[0] == "record"}
        assert {a for a, b in zip(starts, starts[1:]) if not any(a <= i < b for i in hit)} <= kept


def test_round_trip(spark, tmp_path):
    long = "ä" * 600
    rows = [(1, "u", long), (2, None, long), (3, "u\r\nX: y", long), (4, "u", None), (5, "u", ""), (6, "u", "WARC/1.1\r\n\r\n\r\n"), (7, "u", "x" * 999), (8, "u", "x" * 999), (9, "u", "y" * 1000), (10, "u", "y" * 1000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    path = str(tmp_path / "w")
    warc.write(df, path)
    found = {r["record_id"]: r for r in warc.read(spark, path).collect()}
    assert len(found) == 10 and all(r["kind"] == "record" for r in found.values())
    for i, _, html in rows:
        r, data = found[f"<urn:row:{i}>"], (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), "sha1:" + hashlib.sha1(data).hexdigest())
        last = {1: 3, 2: 3, 9: 10}.get(i)
        assert (r["record_type"], r["refers_to"]) == (("revisit", f"<urn:row:{last}>") if last else ("response", None))
        assert bytes(r["payload"]) == (b"" if last else data)
    warc.write(df.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_revisits_through_filters_are_those_of_a_plain_rule(spark, tmp_path):
    """Many repeated payloads, so that filters let some wrong rows through; ids that repeat; payloads of all three sizes of files."""
    rng = random.Random(2)
    pool = [rng.choice("abc") * rng.choice([10, 999, 1000, 1500]) + str(i % 400) for i in range(900)] + ["L" * 70_000, "M" * 4_100_000]
    rows = [(i if rng.random() < 0.98 else rng.choice([None, 7]), "u", rng.choice(pool[:-2]) if i % 50 else pool[-1 - i // 50 % 2]) for i in range(2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "w"))
    found = warc.read(spark, str(tmp_path / "w"), with_payload=False).collect()
    last = {}
    for i, _, html in rows:
        if i is not None and len(html) >= 1000:
            last[html] = max(i, last.get(html, i))
    name = lambda i: f"<urn:row:{'' if i is None else i}>"
    want = [(name(i), hashlib.sha1(h.encode()).hexdigest(), name(last[h]) if i is not None and last.get(h, i) != i else None) for i, _, h in rows]
    assert sorted(want, key=str) == sorted(((r["record_id"], r["payload_digest"][5:], r["refers_to"]) for r in found), key=str)


def test_a_gap_stops_the_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(warc.uuid, "uuid4", lambda: type("U", (), {"hex": "x"}))
    monkeypatch.setattr(warc, "write", lambda pages, path: (tmp_path / "warc-x").write_bytes(record(1, b"a") + b"noise"))
    with pytest.raises(Exception, match="gap in"):
        warc.op3_warc(spark, "/root/testdata/sf0.001").collect()
