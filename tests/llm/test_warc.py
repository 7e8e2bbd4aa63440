import hashlib
import io
import random

from photonflow.llm import warc


def test_headers_first_reading_skips_and_keeps_places():
    rows = [{"record_id": f"r{i}", "type": "response", "target_uri": "u\r\nx", "refers_to": None, "payload_digest": "d", "payload_bytes": None, "payload": bytes([i]) * (i * 70000)} for i in range(6)]
    import gzip

    for pack in (lambda b: b, lambda b: gzip.compress(b)):
        data = b"".join(pack(warc.record(r)) for r in rows)
        got = list(warc.read_records(io.BytesIO(data), lambda h: h["record_id"] in ("r1", "r5"), True))
        assert [(g[0], g[2], g[5], g[6]) for g in got] == [(f"r{i}", "u  x", i * 70000, bytes([i]) * (i * 70000)) for i in (1, 5)]
        assert [(g[0], g[5], g[6]) for g in warc.read_records(io.BytesIO(data), lambda h: True, False)] == [(f"r{i}", i * 70000, None) for i in range(6)]


def test_round_trip(spark):
    rng = random.Random(1)
    texts = [None, "", "short", "short", "é" * 60, "é" * 60, "\r\n\r\nWARC/1.1\r\n" * 20, "x" * 300000] + ["".join(rng.choice("ab<>\r\n\x00é") for _ in range(rng.randrange(90, 300))) for _ in range(30)]
    rows = list(enumerate(texts)) + [(100 + i, rng.choice(texts)) for i in range(60)] + [(None, texts[4]), (4, texts[4])]
    pages = spark.createDataFrame([(k, None if (k or 0) % 5 == 0 else f"http://x/{k}", t, "q") for k, t in rows], "page_id long, url string, html string, payload string").repartition(3)
    got = warc.round_trip(pages).collect()
    want = []
    for k, t in rows:
        data = (t or "").encode()
        first = min(j for j, u in rows if j is not None and (u or "").encode() == data)
        again = len(data) >= 100 and k is not None and k > first
        want.append((str(k), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(map(str, ((str(r.page_id), *r[1:]) for r in got))) == sorted(map(str, want))
    assert warc.round_trip(pages.where("false")).count() == 0


def test_pushed_filters(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 2}/{i}", "same" * 40 if i < 5 else f"{i}" * 120) for i in range(10)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/a"
    warc.write_archives(warc.page_records(pages), path, "none")
    back = warc.read_archives(spark, path)
    some = back.where("type = 'revisit' and target_uri like 'http://h0%'")
    assert sorted(r.record_id for r in some.collect()) == ["urn:page:2", "urn:page:4"]
    assert "ArrowEvalPython" not in some._jdf.queryExecution().executedPlan().toString()
    assert back.where("refers_to is null and payload_bytes > 100").count() == 6 and warc.read_archives(spark, path, payload=False).where("payload is null").count() == 10
