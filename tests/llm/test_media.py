import hashlib
import io
import re
import zlib

import pytest

from cohortlens.llm import media as M


@pytest.mark.parametrize("text", [None, "", "a", "x" * 576, "é" * 5000, "\udc80 odd"])
def test_png_round_trip(text):
    data, n = M.payload_of(text)
    assert len(data) % 576 == 0 and len(data) >= 576 and data[n:] == b"\xff" * (len(data) - n)
    assert M.samples(M.png(data)) == data
    image = bytearray(M.png(data))
    image[-20] ^= 1
    with pytest.raises(ValueError):
        M.samples(bytes(image))


def test_png_opens_elsewhere():
    image = pytest.importorskip("PIL.Image")
    data, _ = M.payload_of("text " * 500)
    opened = image.open(io.BytesIO(M.png(data)))
    assert opened.mode == "L" and opened.tobytes() == data


def test_items_keep_order_and_captions():
    html = "<p>one <b>two</b><figure><img src='sha256:ab'><video src=v.mp4></video><figcaption>cap &amp; tion</figcaption></figure>three<script>no</script><img src=x alt=y><p>four"
    got = [(i["kind"], i["text"] or i["digest"] or i["src"], i["caption"]) for i in M.parse_items(html)]
    assert got == [("text", "one two", None), ("media", "ab", "cap & tion"), ("media", "v.mp4", "cap & tion"), ("text", "three", None), ("media", "x", "y"), ("text", "four", None)]
    assert M.parse_items(None) == M.parse_items("") == []


def items(html):
    return [(i["text"] or i["src"], i["caption"]) for i in M.parse_items(html)]


def test_captions_and_broken_pages():
    assert items("<figure><figcaption>cap</figcaption><img src=a><img src=b></figure>t") == [("a", "cap"), ("b", "cap"), ("t", None)]
    assert items("<figure><figcaption>Table 1</figcaption><table><tr><td>x</table></figure>t") == [("Table 1", None), ("x", None), ("t", None)]
    assert items("a<figcaption>alone</figcaption>b") == [("a", None), ("alone", None), ("b", None)]
    assert items("<figure><img src=a><figcaption>cap</figure><p>later</p>") == [("a", "cap"), ("later", None)]
    assert items("<body><p>a<nav>menu<p>rest of it</body>") == [("a", None), ("menu", None), ("rest of it", None)]
    assert items("<p>a<nav>menu<ul><li>x</ul></nav>b") == [("a", None), ("b", None)]
    assert items("<figure><figure><img src=a><figcaption>in</figcaption></figure><img src=b><figcaption>out</figcaption></figure>") == [("a", "in"), ("b", "out")]
    assert items("<figure><figure><img src=a><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure>") == [("a", "in"), ("out", None)]


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    seqs = {r.page_id: r["items"] for r in M.sequences(pages.select("page_id", "html")).collect()}
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def handle_data(self, data):
            self.words += data.split()

    for page_id, html in pages.select("page_id", "html").collect():
        w = Words()
        w.words = []
        w.feed(re.sub(r"(?is)<(script|style|nav)\b.*?</\1\s*>", " ", html or ""))
        w.close()
        seen = set(" ".join(f"{i.text or ''} {i.caption or ''}" for i in seqs[page_id]).split())
        assert set(w.words) <= seen, page_id
        assert [i.pos for i in seqs[page_id]] == list(range(len(seqs[page_id])))


def test_resolve_and_rows(spark):
    rows = [(1, "same", 7), (2, "same", 7), (3, None, 7), (4, "", 7), (1, "same", 7), (None, "long " * 30000, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, digest int")
    stored = M.store(docs)
    feats = M.features(stored)
    assert feats.count() == 3
    seqs = M.sequences(spark.createDataFrame([(9, "<p>t<img src='sha256:%s'><img src='sha256:none'>" % hashlib.sha256(M.payload_of("same")[0]).hexdigest()), (10, None)], "page_id bigint, html string"))
    got = sorted((r.pos, r.kind, r.payload_bytes) for r in M.resolve(seqs, feats, ["page_id"]).collect())
    assert got == [(0, "text", None), (1, "media", 576), (2, "media", None)]
    assert M.store(docs.limit(0)).count() == 0


def test_query(spark, tmp_path):
    rows = [(1, "same"), (2, "same"), (3, None), (4, "é" * 400)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in M.op7(spark, str(tmp_path)).collect()}
    assert len(got) == 4
    for doc_id, text in rows:
        data, n = M.payload_of(text)
        r = got[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(M.png(data)), hashlib.sha256(M.png(data)).hexdigest(), M.feature(data))
        assert r.caption == str(doc_id)


def test_kept_columns_of_any_name(spark):
    data = spark.createDataFrame([("text", "a", "b")], "text string, `a.b` string, `c``d` string")
    kept = ["a.b", "c`d"]
    media = M.store(data, keep=kept)
    assert media.columns == [*kept, "n_bytes", "digest", "media"] and media.first()["a.b"] == "a"
    seqs = M.sequences(data, html_col="text", keep=kept)
    assert M.resolve(seqs, media.select("digest", "n_bytes"), kept).columns[:2] == kept
    for call, name in ((M.store, "digest"), (M.sequences, "items")):
        with pytest.raises(ValueError):
            call(data.withColumn(name, data["text"]), "text", keep=[name])
