"""Operator 2: media columns as interleaved document sequences.

`interleave` parses HTML into ordered structs: text segments, and references to media by digest with the caption
that belongs to them (figcaption, else alt). `resolve` joins the references to a media store by digest; positions
and captions stay with their references. The store is reduced to one narrow row a digest before the shuffle: what
a consumer needs of the stored bytes is read from them in the task that has them, so media bytes never travel,
and a digest with any number of copies costs a row a task. References to very frequent digests aren't shuffled.

Here a document's payload, its UTF-8 bytes with zeros up to a positive multiple of 64, is stored as an 8-bit
greyscale PNG 64 samples wide, whose page is its text and a figure that refers to the image.

Null or empty text: a payload of 64 zeros. Repeated rows: each has its row. Very long texts: whole. A page without
media: text segments only; a reference that the store lacks: resolved columns null. Other columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanecast.llm.common import documents, stored, texts_of

WIDTH = 64
HOT_SHARE = 1000
_MAGIC = b"\x89PNG\r\n\x1a\n"
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
FEATURES = "media_digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    """8-bit greyscale, rows of `width` samples, each with filter 0; the payload's length is a multiple of it."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """Samples of such an image, rows by columns; checksums are verified."""
    if media[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, data, size = 8, [], (0, 0)
    while at < len(media):
        n = struct.unpack_from(">I", media, at)[0]
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    return lines[:, 1:]


def feature_of(samples: np.ndarray) -> str:
    """Rows, mean and deviation of the samples, and a 16-bit hash: which of 16 bands of rows are brighter than the mean."""
    flat = samples.astype(np.float64)
    bands = [b.mean() if b.size else 0.0 for b in np.array_split(flat, 16)]
    bits = sum(1 << k for k, b in enumerate(bands) if b > flat.mean())
    return f"{samples.shape[0]}x{samples.shape[1]};mean={flat.mean():.4f};sd={flat.std():.4f};hash={bits:04x}"


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.buffer: list[str] = []
        self.caption: list[str] | None = None
        self.in_figure, self.figure, self.figcaption, self.hidden = False, [], None, 0

    def flush(self):
        if text := "".join(self.buffer):
            self.items.append(["text", text, None, None])
        self.buffer = []

    def end_figure(self):
        """The caption is that of all the figure's media, wherever it stands."""
        for item in self.figure if self.figcaption is not None else []:
            item[3] = self.figcaption
        self.in_figure, self.figure, self.figcaption = False, [], None

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in ("img", "audio", "video", "source") and (at.get("src") or at.get("data-src")):
            self.flush()
            self.items.append(["media", None, at.get("src") or at["data-src"], at.get("alt")])
            if self.in_figure:
                self.figure.append(self.items[-1])
        elif tag == "figure":
            self.flush()
            self.in_figure, self.figure, self.figcaption = True, [], None
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in ("p", "div", "li", "br", "h1", "h2", "h3", "tr", "article", "section"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            self.figcaption, self.caption = "".join(self.caption).strip(), None
        elif tag == "figure":
            self.end_figure()
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "tr", "article", "section"):
            self.flush()

    def handle_data(self, data):
        if self.caption is not None:
            self.caption.append(data)
        elif not self.hidden:
            self.buffer.append(data)


def parse_page(page: str) -> list[dict]:
    p = _Page()
    p.feed(page)
    p.close()
    p.end_figure()
    if p.caption is not None:
        p.buffer = p.caption
    p.flush()
    return [{"position": k, "kind": kind, "text": text, "digest": ref.removeprefix("media:") if ref else None, "caption": caption} for k, (kind, text, ref, caption) in enumerate(p.items)]


def interleave(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns but the HTML, and `sequence`: the page's text and media references in order."""
    keep = [c for c in pages.columns if c not in (html_col, "sequence")]

    def parse(batches):
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        for batch, texts in texts_of(batches, html_col):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array([parse_page(t) for t in texts], kind)], [*keep, "sequence"])

    types = ", ".join(f"`{c}` {t}" for c, t in pages.dtypes if c in keep)
    return pages.mapInArrow(parse, f"{types + ', ' if types else ''}sequence {SEQUENCE}")


def read_back(store: DataFrame) -> DataFrame:
    """FEATURES of the stored bytes, one row a digest; store: media_digest, media."""

    def read(batches):
        for batch in batches:
            out = []
            for media in batch.column("media").to_pylist():
                samples = from_png(media)
                payload = samples.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), feature_of(samples)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("media_digest"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["media_digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"])

    return store.mapInArrow(read, FEATURES)


def resolve(sequences: DataFrame, resolved: DataFrame, hot_share: int = HOT_SHARE) -> DataFrame:
    """One row per media reference: the page's columns, position, caption, and what the store has for its digest.

    A digest is hot when it holds more than 1/`hot_share` of all references, so fewer than `hot_share` are: their
    features are broadcast to the references; all other references meet theirs in a shuffle by digest. A page's
    columns named like one of the result's own give way to it.
    """
    keep = [c for c in sequences.columns if c.lower() not in {"sequence", "position", "caption", "media_sha256", *FEATURES.replace(",", "").split()[::2]}]
    refs = sequences.select(*keep, F.inline(F.filter("sequence", lambda s: s["kind"] == "media")).alias("position", "kind", "text_", "digest", "caption_"))
    refs = stored(refs.select(*keep, "position", F.col("caption_").alias("caption"), F.col("digest").alias("media_sha256")), "media_refs")
    once = stored(resolved.dropDuplicates(["media_digest"]), "media_features").withColumnRenamed("media_digest", "media_sha256")
    hot = refs.where("media_sha256 IS NOT NULL").groupBy("media_sha256").count()
    hot = F.broadcast(hot.where(F.col("count") * hot_share > refs.count()).select("media_sha256"))
    seen_often = refs.join(hot, "media_sha256", "left_semi").join(F.broadcast(once.join(hot, "media_sha256", "left_semi")), "media_sha256", "left")
    return seen_often.unionByName(refs.join(hot, "media_sha256", "left_anti").join(once, "media_sha256", "left"))


def media_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, text and the document's stored media with its digest; docs: doc_id, text."""

    def store(batches):
        for batch, texts in texts_of(batches):
            n, media, pages = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                data = text.encode("utf-8")
                n.append(len(data))
                media.append(to_png(data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b"\0")))
                pages.append(f'<article><p>{html.escape(text, quote=False)}</p><figure><img src="media:{hashlib.sha256(media[-1]).hexdigest()}"><figcaption>document {doc_id}</figcaption></figure></article>')
            digests = [hashlib.sha256(m).hexdigest() for m in media]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(media, pa.binary()), pa.array(pages, pa.string())], ["doc_id", "n_bytes", "media_digest", "media", "html"])

    return docs.mapInArrow(store, "doc_id long, n_bytes long, media_digest string, media binary, html string")


def op2_media_columns(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = interleave(media_of(docs))
    made = stored(made.select("doc_id", "n_bytes", "media_digest", "media", F.filter("sequence", lambda s: s["kind"] == "media").alias("sequence")), "media")
    found = resolve(made.select("doc_id", "n_bytes", "sequence"), read_back(made.select("media_digest", "media")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


QUERIES = {"op2_media_columns": op2_media_columns}
SQL: dict[str, str] = {}
