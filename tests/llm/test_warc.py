import random
import re

import pytest

from cohortlens.llm import warc as W


def archive(n, plain=False):
    parts = [W.page_record(i, f"http://h/{i}", f"<p>{i}</p>".encode() * (i % 7 + 1), None) for i in range(n)]
    return parts if plain else [W.member(p) for p in parts]


def ids(data):
    return [(i.headers["warc-record-id"], i.start, i.end) if not i.reason else (i.reason, i.start, i.end) for i in W.Archive.of(data).items()]


@pytest.mark.parametrize("plain", [True, False])
def test_round_trip(plain):
    parts = archive(30, plain)
    got = ids(b"".join(parts))
    assert [g[0] for g in got] == [f"<urn:page:{i}>" for i in range(30)]
    assert got[0][1] == 0 and got[-1][2] == sum(map(len, parts))


@pytest.mark.parametrize("plain", [True, False])
@pytest.mark.parametrize("seed", range(12))
def test_salvage(plain, seed):
    rng = random.Random(seed)
    parts = archive(40, plain)
    bad = set(rng.sample(range(40), 5))
    for i in bad:
        p = bytearray(parts[i])
        kind = rng.randrange(4)
        if kind == 0:
            p[rng.randrange(len(p))] ^= 0xFF
        elif kind == 1:
            p = p[: rng.randrange(len(p))]
        elif kind == 2:
            p = bytearray(rng.randbytes(rng.randrange(1, 300)))
        else:
            p[: rng.randrange(1, len(p))] = b"\0" * 10
        parts[i] = bytes(p)
    data = b"".join(parts)
    items = list(W.Archive.of(data).items())
    assert [x.start for x in items][1:] == [x.end for x in items][:-1] and items[-1].end == len(data) and items[0].start == 0
    found = {x.headers["warc-record-id"] for x in items if not x.reason}
    assert {f"<urn:page:{i}>" for i in range(40) if i not in bad} <= found
    assert any(x.reason for x in items)


def kept(data):
    return [i.headers["warc-record-id"][10:-1] for i in W.Archive.of(data).items() if not i.reason]


@pytest.mark.parametrize("wrap", [bytes, W.member])
@pytest.mark.parametrize("length", [b"999999999999999", b"\xc2\xb2", b"-5", b"", b"9" * 30, b"1" * 18])
def test_hostile_lengths(wrap, length):
    parts = archive(5, plain=True)
    bad = re.sub(rb"(Block-Digest: [^\r]*\r\nContent-Length:) \d+", lambda m: m[1] + b" " + length, parts[2])
    assert bad != parts[2]
    assert kept(wrap(b"".join([*parts[:2], bad, *parts[3:]]))) == ["0", "1", "3", "4"]


def test_many_records_a_member():
    parts = archive(40, plain=True)
    data = W.member(b"".join(parts))
    items = list(W.Archive.of(data).items())
    assert kept(data) == [str(i) for i in range(40)] and items[-1].end == len(data)
    assert [(i.first, i.last) for i in items] == [(sum(map(len, parts[:k])), sum(map(len, parts[: k + 1]))) for k in range(40)]
    bad = bytearray(parts[7])
    bad[-20] ^= 1
    data = W.member(b"".join([*parts[:7], bytes(bad), *parts[8:20]])) + W.member(b"".join(parts[20:]))
    assert kept(data) == [str(i) for i in range(40) if i != 7]
    gap = [i for i in W.Archive.of(data).items() if i.reason]
    assert [(g.first, g.last) for g in gap] == [(sum(map(len, parts[:7])), sum(map(len, parts[:8])))]


@pytest.mark.parametrize("seed", range(5))
def test_truncated_and_broken_whole_file_members(seed):
    rng = random.Random(seed)
    parts = [W.page_record(i, "u", rng.randbytes(3000), None) for i in range(60)]
    whole, more = W.member(b"".join(parts[:50])), W.member(b"".join(parts[50:]))
    cut = whole[: int(len(whole) * 0.6)]
    got = kept(cut)
    assert got == [str(i) for i in range(len(got))] and 27 <= len(got) <= 30
    assert kept(cut + more) == got + [str(i) for i in range(50, 60)]
    items = list(W.Archive.of(cut + more).items())
    assert [x.start for x in items][1:] == [x.end for x in items][:-1] and items[-1].end == len(cut + more)


@pytest.mark.parametrize("wrap", [bytes, W.member])
def test_a_record_within_a_damaged_payload_is_suspect(wrap):
    inner = W.page_record(99, "u", b"inner", None)
    outer = bytearray(W.page_record(1, "u", b"text\r\n" + inner + b"more text", None))
    outer[-8] ^= 1
    items = list(W.Archive.of(wrap(bytes(outer) + W.page_record(2, "u", b"x", None))).items())
    found = {i.headers["warc-record-id"]: i.suspect for i in items if not i.reason}
    assert found == {"<urn:page:99>": True, "<urn:page:2>": False}


def test_reading_is_linear():
    import time

    def seconds(n):
        data = W.member(b"".join(W.page_record(i, "u", b"x" * 2000, None) for i in range(n)), 1)
        began = time.process_time()
        assert len(kept(data)) == n
        return time.process_time() - began

    seconds(100)
    assert seconds(8000) < 12 * max(seconds(1000), 0.02)


def test_digest_and_junk():
    assert W.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert ids(b"") == [] and ids(b"junk" * 100)[0][1:] == (0, 400)
    assert len(ids(b"\x1f\x8b\x08" * 5000)) == 1


def test_pages(spark):
    rows = [(1, "http://a/1", "same", 0), (5, None, "same", 0), (3, "u\r\nX: y", "same", 0), (4, "u", None, 0), (6, "u", "", 0), (7, "u", "é" * 70000, 0), (5, "u", "same", 0), (None, "u", "same", 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")
    got = W.read_archives(W.write_archives(pages, archive_bytes=200)).where("reason is null").collect()
    seen = sorted((r.record_id, r.record_type, r.refers_to or "", r.payload_bytes, r.payload_digest) for r in got)
    same, empty, long = W.digest(b"same"), W.digest(b""), W.digest(("é" * 70000).encode())
    assert seen == sorted(
        [("urn:page:1", "revisit", "urn:page:5", 4, same), ("urn:page:5", "response", "", 4, same), ("urn:page:5", "response", "", 4, same), ("urn:page:3", "revisit", "urn:page:5", 4, same)]
        + [("urn:page:None", "revisit", "urn:page:5", 4, same), ("urn:page:4", "revisit", "urn:page:6", 0, empty), ("urn:page:6", "response", "", 0, empty), ("urn:page:7", "response", "", 140000, long)]
    )
    few = W.read_archives(W.write_archives(pages, revisit_min_bytes=5)).collect()
    assert {r.record_type for r in few} == {"response"}
    assert W.read_archives(W.write_archives(pages.limit(0))).count() == 0


def test_long_heads_are_read_and_what_is_beyond_the_bounds_is_refused(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(1, "http://" + "u" * (2 << 20), "text"), (2, "v", None)], "page_id bigint, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r.page_id for r in W.op2(spark, str(tmp_path)).collect()) == [1, 2]
    monkeypatch.setattr(W, "MAX_RECORD", 1000)
    assert W.page_record(1, "u", b"x" * 900, None)
    for url, payload in (("u", b"x" * 1000), ("u" * (W.MAX_HEAD + 1), b"")):
        with pytest.raises(ValueError, match="more than a reader takes"):
            W.page_record(1, url, payload, None)
