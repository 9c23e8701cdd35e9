"""Media columns: interleaved sequences of text and media references.

A page is parsed into an ordered array of items: text runs, and references with the digest they name and their caption
(the figure's caption, else the image's alternative text). The store keeps each different payload once, as an 8-bit
greyscale image of 64 samples a row, under the digest of the stored bytes. Digest joins put what is stored, or what was
read back from it, beside each reference; positions and captions stay with their items, also where the store lacks a digest.

What is the same for equal payloads is read back once for each of them, before the join, so a payload that a third of all
documents share costs one reading; the join then moves rows of a few hundred bytes, and Spark splits its skewed partitions.

Edge cases: null pages have no items; references without a digest resolve to nulls; null and empty payloads are 64 zero
samples; malformed markup never fails (unclosed elements end with their parent). Equal payloads are one, whichever row they come
from; repeated rows are kept; an empty table gives no rows. Very long payloads are rows of one image. Extra columns are
dropped, so their names can't clash.
"""

from __future__ import annotations

import bz2
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.html import HEAD_TAGS, TolerantParser
from weftline.session import cut

ROW = 64
#: Media of a batch that are expanded at once.
ROWS = 500
#: Elements whose text is not read, and elements that end a run of text.
SILENT = {"script", "style", "noscript", "head", "template"}
BLOCKS = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "figure", "figcaption", "br", "blockquote", "pre", "nav", "header", "footer"}
MEDIA = {"img", "video", "audio", "source", "embed"}

ITEM = "struct<position: int, kind: string, text: string, digest: string, caption: string>"


class Interleaved(TolerantParser):
    """Collects items in document order."""

    def __init__(self):
        super().__init__()
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent: list[str] = []
        self.figures: list[int] = []  # for each open figure, its first item
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words.clear()
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if "head" in self.silent and tag not in HEAD_TAGS:  # its end tag may be left out
            del self.silent[self.silent.index("head") :]
        if tag in SILENT:
            self.silent.append(tag)
        if tag in BLOCKS or tag in MEDIA:
            self.flush()
            if self.caption is not None:
                self.caption.append(" ")
        if tag == "figure":
            self.figures.append(len(self.items))
        elif tag == "figcaption":
            self.caption = []
        elif tag in MEDIA and not self.silent:
            own = dict(attrs)
            source = own.get("src") or ""
            digest = source.removeprefix("sha256:") if source.startswith("sha256:") else own.get("data-digest")
            self.items.append({"kind": "media", "text": None, "digest": digest, "caption": own.get("alt")})

    def handle_endtag(self, tag: str) -> None:
        if tag in self.silent:
            del self.silent[self.silent.index(tag) :]
        if tag in ("figcaption", "figure") and self.caption is not None:  # a caption ends with its figure at the latest
            caption, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.items[self.figures[-1] if self.figures else len(self.items) :]:
                if item["kind"] == "media":
                    item["caption"] = caption
        elif tag in BLOCKS:
            self.flush()
        if tag == "figure" and self.figures:
            self.figures.pop()

    def handle_data(self, data: str) -> None:
        if self.caption is not None:
            self.caption.append(data)
        elif not self.silent:
            self.words.append(data)


def parse_page(html: str | None) -> list[dict]:
    """The items of a page."""
    parser = Interleaved()
    parser.feed(html or "")
    parser.close()
    if parser.caption is not None:  # neither it nor its figure ends: what follows can't be told from it, so it is text
        parser.words += parser.caption
    parser.flush()
    return [item | {"position": k} for k, item in enumerate(parser.items)]


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns to keep, and items, an array in document order."""
    own = [id_col, *keep]
    names = [f"c{k}" for k in range(len(own))]
    fields = ", ".join(f"{n} {dict(pages.dtypes)[c]}" for n, c in zip(names, own, strict=True))
    item = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = pa.array([parse_page(x.as_py()) for x in batch.column("html")], item)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), items], names=[*names, "items"])

    rows = pages.select(*[F.col(c).alias(n) for n, c in zip(names, own, strict=True)], F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"{fields}, items array<{ITEM}>").select(*[F.col(n).alias(c) for n, c in zip(names, own, strict=True)], "items")


def stored_form(payload: Column) -> Column:
    """A greyscale image (portable graymap) of the payload; zero bytes fill it up to whole rows, one at least."""
    data = F.coalesce(payload, F.lit(b""))
    rows = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / ROW)).cast("int")
    header = F.concat(F.lit(f"P5\n{ROW} "), rows.cast("string"), F.lit("\n255\n")).cast("binary")
    return F.concat(header, F.rpad(data, rows * ROW, F.lit(b"\x00")))


def samples(media: bytes) -> bytes:
    """The samples of a stored image."""
    magic, size, depth, data = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(data) != width * height:
        raise ValueError("not a stored payload")
    return data


def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest and the media compressed: texts become smaller by bzip2 than by any level of zstd."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bz2.compress(m.as_buffer()) for m in batch.column(1)], pa.binary())], names=["digest", "packed"])


def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest and media from what squeeze gives."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([bz2.decompress(p.as_buffer()) for p in part.column(1)], pa.binary())], names=["digest", "media"])


def store(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """digest and media, once for each different payload. Media travel compressed, each by itself, as the exchange moves them all."""
    media = payloads.select(stored_form(F.col(payload_col).cast("binary")).alias("media"))
    packed = media.select(F.sha2("media", 256).alias("digest"), "media").mapInArrow(squeeze, "digest string, packed binary")
    return packed.groupBy("digest").agg(F.first("packed").alias("packed")).mapInArrow(expand, "digest string, media binary")


def feature(data: bytes) -> str:
    """Mean and deviation of the samples, the mean step between rows, and a histogram of 16 bins."""
    x = np.frombuffer(data, np.uint8)
    grid = x.reshape(-1, ROW).astype(np.int16)
    step = np.abs(np.diff(grid, axis=0)).mean() if len(grid) > 1 else 0.0
    return f"{x.mean():.4f};{x.std():.4f};{step:.4f};" + ",".join(map(str, np.bincount(x >> 4, minlength=16)))


def read_back(stored: DataFrame) -> DataFrame:
    """digest and what the stored bytes of each media say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = samples(raw := media.as_py())
                rows.append((digest, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-ROW:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(data)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return stored.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def resolve(sequenced: DataFrame, by_digest: DataFrame) -> DataFrame:
    """A row for each item with the columns beside the items and its position; references have the columns that by_digest (digest, ...) gives them.

    by_digest has one row for each digest: the store itself, or what was read back from it.
    """
    own = [c for c in sequenced.columns if c != "items"]
    items = sequenced.select(*own, F.explode("items").alias("item")).select(*own, "item.*")
    return items.join(by_digest, "digest", "left")


def payload_pages(docs: DataFrame, id_col: str, payload: Column) -> DataFrame:
    """A page for each document that refers to its payload in a figure, and the payload's bytes."""
    digest = F.sha2(stored_form(payload), 256)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    html = F.concat(F.lit('<article><p>Document</p><figure><img src="sha256:'), digest, F.lit('" alt="'), name, F.lit('"><figcaption>Document '), name, F.lit("</figcaption></figure></article>"))
    return docs.select(id_col, F.octet_length(payload).cast("long").alias("n_bytes"), html.alias("html"))


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's text as a stored payload, referred to by a page, resolved and read back."""
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    stored = cut(store(docs.select(payload.alias("payload"))), "stored")
    described = cut(read_back(stored), "media")
    pages = payload_pages(docs, id_col, payload)
    return resolve(sequences(pages, id_col, keep=("n_bytes",)), described).where("kind = 'media'")
