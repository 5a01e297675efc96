"""Archives written, read back and compared with the rows."""

import base64
import gzip
import hashlib
import os
import random

import pytest

from detectra.llm import queries, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, shard string, first long, bytes string, print int"


def rows_of(seed=0, n=150):
    r = random.Random(seed)
    texts = ["".join(r.choice("abc <>é\n\r") for _ in range(r.randint(0, 400))) for _ in range(n)]
    rows = [(i, f"http://h/{i}", t) for i, t in enumerate(texts)]
    rows += [(500 + i, f"http://h/{i % 3}", texts[4]) for i in range(60)]
    rows += [(600, "http://same", "same row")] * 5 + [(600, "http://other", "same row"), (601, None, "same row")]
    rows += [(700, "a b\r\nX: y é", "odd url"), (701, "u", None), (702, "u", ""), (None, "u", "no id"), (None, "u", "no id"), (None, None, None), (703, None, "no id"), (704, "u", "x" * 300_000)]
    rows += [(None, "v", "null only"), (None, "w", "null only")]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "s", 1, "b", 2) for r in rows], SCHEMA).repartition(parts)


def expected(rows, least=0):
    raw = [(i, (t or "").encode()) for i, _, t in rows]
    order = lambda i: -(10**9) if i is None else i
    best, used, out = {}, set(), []
    for i, b in raw:
        if b not in best or order(best[b]) < order(i):
            best[b] = i
    for i, b in raw:
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        first = len(b) < least or best[b] == i and b not in used
        if first and len(b) >= least:
            used.add(b)
        out.append((order(i), len(b), digest, "response" if first else "revisit", None if first else best[b]))
    return sorted(out, key=str)


def found(df):
    return sorted(((-(10**9) if r["page_id"] is None else r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("least", [0, 9, 10**6])
def test_round_trip(spark, tmp_path, least):
    rows = rows_of()
    warc.write(frame(spark, rows), str(tmp_path / "a"), least=least, roll=4000)
    out = warc.read(spark, str(tmp_path / "a"))
    assert found(out) == expected(rows, least)
    got = out.collect()
    assert len({r["record_id"] for r in got}) == len(rows)
    payload = {r["record_id"]: (r["page_id"], r["payload"]) for r in got if r["record_type"] == "response"}
    for r in got:
        if r["record_type"] == "response":
            assert len(r["payload"]) == r["payload_bytes"] and base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() == r["payload_digest"]
        else:
            page, own = payload[r["refers_to_record"]]
            assert r["payload"] is None and page == r["refers_to"] and base64.b32encode(hashlib.sha1(own).digest()).decode() == r["payload_digest"]


def test_same_bytes_for_any_partitioning_and_rolled_by_size(spark, tmp_path):
    rows = rows_of(1)
    first = warc.write(frame(spark, rows, 1), str(tmp_path / "a"), roll=4000).collect()
    random.Random(2).shuffle(rows)
    again = warc.write(frame(spark, rows, 5), str(tmp_path / "b"), roll=4000).collect()
    assert sorted(first) == sorted(again) and len(first) > 5
    assert sorted(os.listdir(tmp_path / "a")) == sorted([r["file"] for r in first] + ["manifest"])
    for r in first:
        body = (tmp_path / "a" / r["file"]).read_bytes()
        assert (len(body), hashlib.sha256(body).hexdigest()) == (r["bytes"], r["sha256"])
        assert r["bytes"] <= 4000 or r["records"] == 1
        assert gzip.decompress(body).count(b"WARC/1.1\r\n") >= r["records"] + 1
    with pytest.raises(FileExistsError):
        warc.write(frame(spark, rows), str(tmp_path / "a"))


def test_repeated_rows_are_dealt_in_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RUN", 7)
    monkeypatch.setattr(warc, "RANGE_RECORDS", 10)
    rows = [(1, "u", "same")] * 100 + [(None, None, None)] * 50
    manifest = warc.write(frame(spark, rows), str(tmp_path / "a")).collect()
    assert found(warc.read(spark, str(tmp_path / "a"))) == expected(rows)
    assert max(r["records"] for r in manifest) < 50


def test_unfinished_parts_are_not_read_and_broken_records_fail(spark, tmp_path):
    rows = rows_of(3, 20)
    manifest = warc.write(frame(spark, rows), str(tmp_path / "a")).collect()
    (tmp_path / "a" / "_parts").mkdir()
    (tmp_path / "a" / "_parts" / "lost-pages-response-00000-00000.warc.gz").write_bytes(b"half a file")
    assert found(warc.read(spark, str(tmp_path / "a"))) == expected(rows)
    path = tmp_path / "a" / next(r["file"] for r in manifest if "response" in r["file"])
    body = gzip.decompress(path.read_bytes())
    at = body.index(b"<", body.index(b"HTTP/1.1 200 OK")) if b"<" in body[body.index(b"HTTP/1.1 200 OK") :] else len(body) - 6
    path.write_bytes(gzip.compress(body[:at] + b"?" + body[at + 1 :]))
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, str(tmp_path / "a")).collect()


def test_no_rows(spark, tmp_path):
    warc.write(frame(spark, []), str(tmp_path / "a"))
    assert warc.read(spark, str(tmp_path / "a")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered_query(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert found(queries.QUERIES["op12_warc"](spark, SF)) == expected(rows)
