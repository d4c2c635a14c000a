import base64
import gzip
import hashlib
import io
import random
import uuid
from pathlib import Path

from pyspark.sql import functions as F

from tracesift.llm import warc
from tracesift.llm.common import shared_dir


def scan_all(data, split):
    out = []
    for start in range(0, len(data), split):
        out += list(warc.scan_range(io.BytesIO(data), start, start + split))
    return out


def test_splits_own_each_record_once():
    rnd = random.Random(6)
    records, data = [], b""
    for n in range(60):
        # Payloads with gzip magic and stored blocks: chance hits, and even whole members inside of a record.
        body = rnd.choice([b"", rnd.randbytes(rnd.randint(1, 3000)), warc.MAGIC * 50, gzip.compress(b"WARC inside"), warc.member(warc.record_bytes("response", "x", "u", None, "D", 1, b"z")), rnd.randbytes(40_000) + warc.member(warc.record_bytes("response", "x", "u", None, "D", 1, b"z")) + rnd.randbytes(40_000), b"plain text " * 200])
        records.append((str(n), body))
        data += warc.member(warc.record_bytes("response", str(n), f"http://h/{n}\r\nX: y%", None, "D", len(body), body))
        data += rnd.choice([b"", warc.EMPTY_MEMBER])
    for split in (1 << 20, 4096, 997, 100, 37):
        got = scan_all(data, split)
        assert [(r["record_id"], r["block"]) for r in got] == records
        assert got[3]["target_uri"] == "http://h/3\r\nX: y%"
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 60


def test_magic_at_the_start_only():
    rnd = random.Random(8)
    inner = warc.member(warc.record_bytes("response", "x", "u", None, "D", 1, b"z"))
    for _ in range(20):
        data = b"".join(rnd.choice([inner, warc.MAGIC, warc.MAGIC[:2], rnd.randbytes(30_000)]) for _ in range(6))
        made = warc.member(data)
        assert gzip.decompress(made) == data and made.find(warc.MAGIC, 1) < 0


def test_uris():
    assert [warc._full_uri(u) for u in ("file:/a/b", "file:///a", "s3a://b/k", "s3n://b/k", "gs://b/k", "/a")] == ["file:///a/b", "file:///a", "s3://b/k", "s3://b/k", "gs://b/k", "/a"]


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "u", "aa"), (2, "u", "aa"), (None, "u", "bb"), (None, "u", "bb")], "page_id long, url string, html string")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(df, path)
    got = warc.read_warc(spark, path)
    assert sorted((str(r.record_id), r.record_type, str(r.refers_to), bytes(r.block)) for r in got.collect()) == [("2", "response", "None", b"aa"), ("None", "response", "None", b"bb"), ("None", "response", "None", b"bb"), ("None", "revisit", "2", b"")]


def test_round_trip(spark):
    html = ["<p>a</p>", "<p>b</p>", None, "", "é" * 1000, "x" * 300_000]
    rows = [(i, f"http://h/{i}", html[i % len(html)]) for i in range(60)] + [(70, None, "only\n"), (71, "u", "only\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).repartition(4)
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(df, path)
    first = {}
    for i, _, t in rows:
        first.setdefault(t or "", i)
    for split in (warc.SPLIT_BYTES, 1000):
        got = {int(r.record_id): r for r in warc.read_warc(spark, path, split).collect()}
        assert len(got) == len(rows)
        for i, url, text in rows:
            data, r = (text or "").encode(), got[i]
            assert r.target_uri == (url or "") and r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
            again = first[text or ""] != i
            assert r.record_type == ("revisit" if again else "response") and r.refers_to == (str(first[text or ""]) if again else None)
            assert bytes(r.block) == (b"" if again else data)
    # Any reader of gzip members reads the archives.
    assert sum(gzip.decompress(p.read_bytes()).count(b"WARC/1.1\r\n") for p in Path(path.removeprefix("file://")).glob("part-*")) == len(rows)


def test_least_size_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(df, path, least=3)
    assert sorted((r.record_id, r.record_type) for r in warc.read_warc(spark, path).collect()) == [("1", "response"), ("2", "response"), ("3", "response"), ("4", "revisit"), ("4", "revisit")]
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(df.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


def test_damage_is_reported(spark, tmp_path):
    def response(name, body, said=None, size=None):
        digest = base64.b32encode(hashlib.sha1(said if said is not None else body).digest()).decode()
        return warc.record_bytes("response", name, "u", None, digest, len(body) if size is None else size, body)

    digest = base64.b32encode(hashlib.sha1(b"good").digest()).decode()
    rows = [
        response("1", b"good"), response("2", b"gOod", said=b"good"), response("3", b"good", size=5), response("4", b"")[:-30],
        *(warc.record_bytes("revisit", f"r{n}", "u", n, digest, 4, b"") for n in ("1", "2", "9")), response("5", b"cut off" * 9)[:-20],
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(warc.member, rows)))
    got = {r.record_id: (r.payload_bytes, r.sound) for r in warc.checked_payloads(warc.read_warc(spark, str(tmp_path))).collect()}
    assert {k: v for k, v in got.items() if k != "4"} == {"1": (4, True), "2": (4, False), "3": (4, False), "r1": (4, True), "r2": (None, False), "r9": (None, False), "5": (47, False)}
