"""Media columns: interleaved document sequences of text and media, and a lossless media table.

HTML becomes ordered items: text, or a reference to media by the digest of its payload, with its caption. Payloads stand
in a media table as 8-bit grey PNG images; a digest join resolves what the references mean, on features and never on
payload bytes, so payloads are not shuffled. Positions and captions stay with their items.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.base import mapped, free_names, named, small_batches, table, written

WIDTH, FILL = 576, 255
PNG = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None, width: int = WIDTH) -> tuple[bytes, int]:
    """UTF-8 padded with 255 to a positive multiple of width; and the length without the padding."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes([FILL]) * (max(1, -(-len(data) // width)) * width - len(data)), len(data)


def png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """An 8-bit grey image, a payload of whole rows as its samples."""
    height = len(payload) // width
    if not payload or len(payload) % width:
        raise ValueError("the payload is not of whole rows")
    rows = np.zeros((height, width + 1), np.uint8)  # every row starts with filter 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, width)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def samples(data: bytes) -> bytes:
    """The samples of an image that png() made; checks every chunk."""
    if data[:8] != PNG:
        raise ValueError("not a PNG")
    at, shape, body = 8, None, []
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + part):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            shape = struct.unpack(">II", part[:8])
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    if shape is None:
        raise ValueError("no image header")
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[1], shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("a row filter that png() does not write")
    return rows[:, 1:].tobytes()


def feature(payload: bytes, width: int = WIDTH) -> str:
    """Mean sample, and a 64-bit hash: which of 64 column bands are brighter than the mean band."""
    bands = np.frombuffer(payload, np.uint8).reshape(-1, 64, width // 64).mean(axis=(0, 2))
    return f"{bands.mean():.4f}:{np.packbits(bands > bands.mean()).tobytes().hex()}"


class _Items(HTMLParser):
    SKIP, BREAK = {"script", "style", "nav"}, {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "tr", "article", "section", "figure", "table", "ul", "ol", "blockquote"}
    MEDIA = {"img", "video", "audio", "source"}
    #: Elements whose ends are followed; an end tag closes what stands open within its element.
    BLOCKS = (BREAK | SKIP | {"figcaption", "main", "header", "footer", "aside", "body", "html", "td", "th"}) - {"br"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.text, self.open, self.figures, self.navs, self.caption = [], [], [], [], [], None

    def flush(self):
        if text := " ".join("".join(self.text).split()):
            self.items.append(self.said(text))
        self.text = []

    @staticmethod
    def said(text):
        return {"kind": "text", "text": text, "src": None, "digest": None, "caption": None}

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag in self.BREAK and self.open and self.open[-1] == "p":
            self.open.pop()
        if tag == "figcaption" and self.caption is not None:
            self.handle_endtag("figcaption")
        if tag in self.BLOCKS:
            self.open.append(tag)
        if tag in self.BREAK or tag in ("figcaption", "nav"):
            self.flush()
        if self.caption is not None and tag in self.BREAK:
            self.caption.append(" ")
        if tag == "figure":
            self.figures.append({"at": len(self.items), "captions": [], "outer": self.caption, "done": set()})
            self.caption = None
        elif tag == "figcaption":
            self.caption = []
        elif tag == "nav":
            self.navs.append(len(self.items))
        src = own.get("src") or ""
        if tag in self.MEDIA and (src or own.get("data-digest")):
            self.flush()
            digest = own.get("data-digest") or (src.removeprefix("sha256:") if src.startswith("sha256:") else None)
            self.items.append({"kind": "media", "text": None, "src": src, "digest": digest, "caption": own.get("alt") or None})

    def handle_endtag(self, tag):
        if tag in self.open:
            while (last := self.open.pop()) != tag:
                self.ended(last, False)
            self.ended(tag, True)
        if tag in self.BREAK:
            self.flush()

    def ended(self, tag, told):
        """An element's end, by its own tag or by that of an element around it or the page's end."""
        if tag == "figcaption" and self.caption is not None:
            self.flush()
            text, self.caption = " ".join("".join(self.caption).split()), None
            if text and self.figures:
                self.figures[-1]["captions"].append((len(self.items), text))
            elif text:
                self.items.append(self.said(text))
        elif tag == "figure":
            self.flush()
            figure = self.figures.pop()
            media = [i for i in self.items[figure["at"] :] if i["kind"] == "media" and id(i) not in figure["done"]]
            if media and figure["captions"]:
                for item in media:
                    item["caption"] = " ".join(text for _, text in figure["captions"])
            else:
                for at, text in reversed(figure["captions"]):
                    self.items.insert(at, self.said(text))
            if self.figures:
                self.figures[-1]["done"] |= figure["done"] | {id(i) for i in media if figure["captions"]}
            self.caption = figure["outer"]
        elif tag == "nav":
            self.flush()
            at = self.navs.pop()
            if told:  # what follows a nav that never ends is not known to be one
                self.items[at:] = [i for i in self.items[at:] if i["kind"] == "media"]

    def handle_data(self, data):
        if self.open and self.open[-1] in ("script", "style"):
            return
        (self.text if self.caption is None else self.caption).append(data)

    def finish(self):
        self.close()
        while self.open:
            self.ended(self.open.pop(), False)
        self.flush()


def parse_items(html: str | None) -> list[dict]:
    """Ordered text and media items of a page; nothing for a null or empty one. Broken HTML gives what can be read of it.

    A figure's caption, wherever it stands in it, goes to all its media but those that a figure within it captions; a
    caption without media is text. A nav's text goes if the nav ends.
    """
    p = _Items()
    p.feed(html or "")
    p.finish()
    return p.items


_ITEM = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("src", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = [[{"pos": i} | x for i, x in enumerate(parse_items(h))] for h in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(items, _ITEM)], [*batch.schema.names[1:], "items"])


def sequences(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """(keep..., items): array of struct(pos, kind, text, src, digest, caption), in the page's order. keep may not have a column items, nor
    names that start with "__" (ValueError); the same holds for the new names of the functions below."""
    small_batches(pages.sparkSession)
    keep = ["page_id"] if keep is None else keep
    free_names(keep, ["items"])
    kept = pages.select(F.col(html_col).alias("__html"), *[named(c) for c in keep])
    return mapped(kept, _parse, "items array<struct<pos:int,kind:string,text:string,src:string,digest:string,caption:string>>")


def resolve(seqs: DataFrame, media: DataFrame, keep: list[str]) -> DataFrame:
    """A row an item of seqs, in the order of pos, with the columns of media (digest unique); null where nothing has the digest."""
    free_names(keep, ["pos", "kind", "text", "src", "digest", "caption", *media.columns])
    own = [named(c) for c in keep]
    items = seqs.select(*own, F.explode("items").alias("__i")).select(*own, "__i.*")
    found = media.withColumnRenamed("digest", "__digest")
    return items.join(found, items["digest"] == found["__digest"], "left").drop("__digest")


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, images = [], [], []
        for text in batch.column(0).to_pylist():
            data, n = payload_of(text)
            sizes.append(n)
            digests.append(hashlib.sha256(data).hexdigest())
            images.append(png(data))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(images, pa.binary())], [*batch.schema.names[1:], "n_bytes", "digest", "media"])


def store(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The written media table (keep..., n_bytes, digest, media) of texts as payloads; null texts are empty. One row a row."""
    small_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    free_names(keep, ["n_bytes", "digest", "media"])
    kept = docs.select(F.col(text_col).alias("__text"), *[named(c) for c in keep])
    return written(mapped(kept, _store, "n_bytes bigint, digest string, media binary"), "media", compression="uncompressed")


FEATURES = "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = samples(image)
            rows.append((key, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(data)))
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in FEATURES.split(", ")])


def features(media: DataFrame) -> DataFrame:
    """One written row a digest, computed from the stored bytes. Copies of a payload give equal rows, of which one stays."""
    small_batches(media.sparkSession)
    return written(media.select("digest", "media").mapInArrow(_features, FEATURES).distinct(), "media-features")


def op7(spark, sf_dir: str) -> DataFrame:
    media = store(table(spark, sf_dir, "documents"))
    page = F.concat(F.lit('<article><p>document</p><figure><img src="sha256:'), F.col("digest"), F.lit('"><figcaption>'), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("</figcaption></figure></article>"))
    seqs = sequences(media.select("doc_id", "n_bytes", page.alias("html")), keep=["doc_id", "n_bytes"])
    out = resolve(seqs, features(media), ["doc_id", "n_bytes"]).where("kind = 'media'")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "caption", "pos")
