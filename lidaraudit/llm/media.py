"""Interleaved document sequences with media columns.

HTML pages are parsed to ordered structs of text and media references (`sequences`). A media
reference names its payload by digest; payloads are stored apart, and a join on the digest
brings in what is known of them (`resolved`), each at its position with its caption.

A payload of bytes is stored losslessly as a grey PNG of 8-bit samples, 192 wide, padded by
blanks to whole rows (`to_png`, `from_png`). For the documents table each text becomes a page
with one figure: the picture holds the text, the caption names the document.

Defined cases: a null text or page is an empty one; an empty text is one row of blanks; a
page without elements has an empty sequence; a reference without a payload keeps its
position with null features; repeated rows stay separate, equal payloads share one digest; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidaraudit.llm.common import mapped, read_documents, written

ROW = 192
PNG = b"\x89PNG\r\n\x1a\n"
SCHEME = "sha256:"

ELEMENTS = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
ELEMENTS_SQL = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
MEDIA_TAGS = {"img": "image", "video": "video", "audio": "audio"}
BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "figure", "figcaption", "section", "article", "ul", "ol", "table", "br", "body", "html", "head", "title", "pre", "blockquote", "header", "footer", "nav", "main", "aside"}


@dataclass
class _Figure:
    """An open figure: places of its media among the elements, and its captions."""

    media: list[int] = field(default_factory=list)
    captions: list[str] = field(default_factory=list)


class _Page(HTMLParser):
    """Collects text blocks and media references in the order of the page.

    A caption belongs to all media of its figure, whether it stands before or after them; it ends with its tag,
    with its figure, with the next caption or figure, or with the page. Without media it is a text. No text is lost.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.text: list[str] = []
        self.skip = 0  # inside script or style
        self.figures: list[_Figure] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.elements.append({"kind": "text", "text": text})

    def end_caption(self) -> None:
        if self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            if text and self.figures:
                self.figures[-1].captions.append(text)
            elif text:
                self.elements.append({"kind": "text", "text": text})

    def end_figure(self) -> None:
        self.end_caption()
        self.flush()
        if self.figures:
            figure = self.figures.pop()
            if figure.media and figure.captions:
                for i in figure.media:
                    self.elements[i]["caption"] = " ".join(figure.captions)
            else:
                self.elements += [{"kind": "text", "text": t} for t in figure.captions]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in MEDIA_TAGS:
            self.flush()
            own = dict(attrs)
            if self.figures:
                self.figures[-1].media.append(len(self.elements))
            self.elements.append({"kind": MEDIA_TAGS[tag], "digest": (own.get("src") or "").removeprefix(SCHEME), "caption": own.get("alt") or None})
        elif tag in ("figure", "figcaption"):
            self.end_caption()
            self.flush()
            if tag == "figure":
                self.figures.append(_Figure())
            else:
                self.caption = []
        elif tag in BLOCKS and self.caption is not None:
            self.caption.append(" ")
        elif tag in BLOCKS:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            self.end_figure()
        elif tag in BLOCKS and self.caption is not None:
            self.caption.append(" ")
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.text if self.caption is None else self.caption).append(data)


def parsed(html: str | None) -> list[dict]:
    page = _Page()
    page.feed(html or "")
    page.close()
    page.end_figure()
    while page.figures:
        page.end_figure()
    return [{"position": i, **e} for i, e in enumerate(page.elements)]


def sequences(pages: DataFrame, key: str, *kept: str) -> DataFrame:
    """key, kept columns, elements: the texts and media references of column html in order."""
    columns = [key, *kept]
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array([parsed(x) for x in batch["html"].to_pylist()], ELEMENTS)], [*columns, "elements"])

    return pages.select(*columns, "html").transform(mapped, work, f"{kinds}, elements {ELEMENTS_SQL}")


def resolved(found: DataFrame, features: DataFrame, key: str, *kept: str) -> DataFrame:
    """key, kept columns, elements: each element of found with a struct `media` of the columns of features for its digest.

    features: one row per digest. key must tell the rows of found apart.
    """
    columns = [c for c in features.columns if c != "digest"]
    each = found.select(F.col(key), *kept, F.explode_outer("elements").alias("e")).withColumn("digest", F.col("e.digest"))
    joined = each.join(features.select("digest", F.struct(*columns).alias("media")), "digest", "left")
    element = F.struct(*[F.col(f"e.{c}").alias(c) for c in ("position", "kind", "text", "digest", "caption")], "media")
    return joined.groupBy(key).agg(*[F.first(c).alias(c) for c in kept], F.sort_array(F.collect_list(F.when(F.col("e").isNotNull(), element))).alias("elements"))


def padded(data: bytes) -> bytes:
    return data + b" " * (-len(data) % ROW or (0 if data else ROW))


def to_png(payload: bytes) -> bytes:
    """payload, whole rows of 192 bytes, as a grey PNG: each row is stored as it is (filter 0)."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), np.uint8)
    raw[:, 1:] = rows
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return PNG + part(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 1)) + part(b"IEND", b"")


def from_png(stored: bytes) -> np.ndarray:
    """The samples, row by row; only what to_png writes is read."""
    if stored[:8] != PNG:
        raise ValueError("not a PNG file")
    at, data, width, height = 8, [], 0, 0
    while at < len(stored):
        n, kind = struct.unpack_from(">I4s", stored, at)
        body = stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError("a part of the file is damaged")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not a grey picture of 8-bit samples")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("rows are filtered")
    return raw[:, 1:]


def _feature(samples: np.ndarray) -> str:
    """Size, mean, and the means of 16 equal parts of the picture, in hexadecimal digits."""
    flat = samples.reshape(-1)
    parts = np.add.reduceat(flat.astype(np.int64), np.arange(16) * (len(flat) // 16)) // np.diff(np.append(np.arange(16) * (len(flat) // 16), len(flat)))
    return f"{samples.shape[1]}x{samples.shape[0]} {flat.mean():.4f} {parts.astype(np.uint8).tobytes().hex()}"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row, seen = TaskContext.get().partitionId() << 32, set()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            own, rows = batch.slice(at, 500), []
            for doc_id, text in zip(own["doc_id"].to_pylist(), own["text"].to_pylist(), strict=True):
                data = (text or "").encode()
                payload = padded(data)
                digest = hashlib.sha256(payload).hexdigest()
                html = f'<figure><img src="{SCHEME}{digest}"><figcaption>document {doc_id}</figcaption></figure>'
                rows.append((row, doc_id, len(data), html, digest, None if digest in seen else to_png(payload)))
                seen.add(digest)
                row += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["row", "doc_id", "n_bytes", "html", "digest", "stored"])


def store(docs: DataFrame) -> DataFrame:
    """Written: row, doc_id, n_bytes, html, digest, stored (null where the task had stored the digest before)."""
    return written(docs.select("doc_id", "text").transform(mapped, _stored, "row long, doc_id long, n_bytes long, html string, digest string, stored binary"), "media")


FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for digest, stored in zip(batch["digest"].to_pylist(), batch["stored"], strict=True):
            own = stored.as_py()
            samples = from_png(own)
            payload = samples.tobytes()
            rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(own), hashlib.sha256(own).hexdigest(), _feature(samples)))
        if rows:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in FEATURES.split(", ")])


def features(media: DataFrame) -> DataFrame:
    """One row per digest, of what the stored bytes hold when they are read back."""
    each = media.where("stored is not null").select("digest", "stored").transform(mapped, _features, FEATURES)
    return written(each.groupBy("digest").agg(*[F.first(c).alias(c) for c in each.columns if c != "digest"]), "media-features")


def op8_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = store(read_documents(spark, sf_dir))
    pages = resolved(sequences(media, "row", "doc_id", "n_bytes"), features(media), "row", "doc_id", "n_bytes")
    first = F.filter("elements", lambda e: e["kind"] == "image")[0]
    return pages.select("doc_id", "n_bytes", first.alias("e")).select("doc_id", "n_bytes", "e.media.*", F.col("e.position").alias("position"), F.col("e.caption").alias("caption"))


QUERIES = {"op8_interleaved_media": op8_interleaved_media}
ORACLE: dict[str, str] = {}
