"""Web archives: a Spark data source for WARC files (one gzip member a record), and WAT and WET on top of it.

A file is a partition; its members are decompressed one after another, so a task holds one record, not one file. Files
are opened through Arrow's file systems, so paths may be local or in an object store. Writing makes rotated files that
begin with a warcinfo record; one list, written when every task is done, makes a job's files visible (`published`).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from weftline.functions import charsets, html
from weftline.sources import published
from weftline.sources.published import file_system

SCHEMA = (
    "filename string, offset long, length long, type string, record_id string, url string, date timestamp, ip string, concurrent_to string, warcinfo_id string, "
    "block_digest string, payload_digest string, refers_to string, truncated string, content_type string, language string, content_length long, http_status int, http_mime string, block binary"
)
#: Header names of the format, by column.
HEADERS = {
    "type": "warc-type", "record_id": "warc-record-id", "url": "warc-target-uri", "ip": "warc-ip-address", "concurrent_to": "warc-concurrent-to",
    "warcinfo_id": "warc-warcinfo-id", "block_digest": "warc-block-digest", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
    "truncated": "warc-truncated", "content_type": "content-type", "language": "warc-identified-content-language",
}


def members(stream, size: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and data of each gzip member. What follows the last member and isn't one ends the file; damage inside a member is an error."""
    at, held = 0, b""
    while True:
        while len(held) < 2 and (more := stream.read(size)):
            held += more
        if held[:2] != b"\x1f\x8b":
            return
        machine, parts, used = zlib.decompressobj(31), [], 0
        try:
            while not machine.eof:
                held = held or stream.read(size)
                if not held:
                    raise ValueError(f"the member at byte {at} is cut off")
                parts.append(machine.decompress(held))
                used += len(held) - len(machine.unused_data)
                held = machine.unused_data
        except zlib.error as error:
            raise ValueError(f"the member at byte {at} is damaged") from error
        yield at, used, b"".join(parts)
        at += used


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Headers and body at the first blank line; all is body without one."""
    for gap in (b"\r\n\r\n", b"\n\n"):
        head, found, body = block.partition(gap)
        if found:
            return head, body
    return b"", block


def parse_record(data: bytes) -> dict | None:
    """A record's columns; None if the data isn't one."""
    if not data.startswith(b"WARC/"):
        return None
    head, block = split_http(data)
    if not head:
        return None
    lines = head.decode("utf-8", "replace").splitlines()[1:]
    names = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    row = {c: names.get(h, "") for c, h in HEADERS.items()}
    row["url"] = row["url"].removeprefix("<").removesuffix(">")
    try:
        row["date"] = datetime.fromisoformat(names["warc-date"].replace("Z", "+00:00"))
    except (KeyError, ValueError):
        row["date"] = None
    size = names.get("content-length", "")
    row["content_length"] = int(size) if size.isdigit() else 0
    if size.isdigit():
        if len(block) < row["content_length"]:
            return None
        block = block[: row["content_length"]]
    row["block"], row["http_status"], row["http_mime"] = block, 0, ""
    if row["type"] == "response" and block:
        http, _ = split_http(block)
        first, *rest = (http or block).decode("utf-8", "replace").splitlines() or [""]
        code = [*first.split(" ", 2), ""][1]
        row["http_status"] = int(code) if code.isdigit() else 0
        row["http_mime"] = next((x.partition(":")[2].partition(";")[0].strip() for x in rest if x.lower().startswith("content-type:")), "")
    return row


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.names = options["path"], names

    def partitions(self) -> list[InputPartition]:
        system, path = file_system(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [_File(self.path)]
        return [_File(path) for path in published.listing(self.path, ".gz")[0]]

    def read(self, partition: _File | None) -> Iterator[tuple]:
        if partition is None:  # a folder without archives
            return
        system, path = file_system(partition.path)
        name = path.rsplit("/", 1)[-1]
        with system.open_input_stream(path, compression=None) as stream:
            for offset, length, data in members(stream):
                row = parse_record(data)
                if row is not None:
                    row |= {"filename": name, "offset": offset, "length": length}
                    yield tuple(row[n] for n in self.names)


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


def member(headers: dict[str, str], block: bytes) -> bytes:
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    machine = zlib.compressobj(wbits=31)
    return machine.compress(head.encode() + block + b"\r\n\r\n") + machine.flush()


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def stamp(date: datetime | None) -> str:
    return (date or datetime(1970, 1, 1, tzinfo=UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")


def new_id() -> str:
    return f"<urn:uuid:{uuid.uuid4()}>"


def warcinfo(record_id: str, name: str, date: str, software: str) -> bytes:
    fields = f"software: {software}\r\nformat: WARC File Format 1.0\r\n".encode()
    return member({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id, "WARC-Date": date, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, fields)


def exchange(row: dict, info: str) -> bytes:
    """The members of a row: its record and, if it has a `request`, before it the request's, each naming the other."""
    kind, own, asked = row.get("type") or "response", row.get("record_id") or new_id(), row.get("request")
    request = new_id() if asked else None
    common = {"WARC-Date": stamp(row.get("date")), "WARC-Target-URI": row.get("url"), "WARC-IP-Address": row.get("ip"), "WARC-Warcinfo-ID": info}

    def made(kind: str, record_id: str, block: bytes, content_type: str, **more: str | None) -> bytes:
        headers = {"WARC-Type": kind, "WARC-Record-ID": record_id, **common, "WARC-Block-Digest": digest(block), **{f"WARC-{k.replace('_', '-')}": v for k, v in more.items()}, "Content-Type": content_type}
        return member({k: v for k, v in headers.items() if v}, block)

    block = bytes(row.get("block") or b"")
    payload = digest(split_http(block)[1]) if kind == "response" else None
    record = made(kind, own, block, row.get("content_type") or "application/http; msgtype=response", Concurrent_To=row.get("concurrent_to") or request, Payload_Digest=payload, Truncated=row.get("truncated"))
    if not asked:
        return record
    return made("request", request, bytes(asked), "application/http; msgtype=request", Concurrent_To=own) + record


class _Writer(DataSourceWriter):
    """Rows with url, type, date, content_type, block and maybe ip, truncated and request; files of at most max_bytes, warcinfo first.

    A row's two records are never in different files; a row longer than max_bytes is a file of its own.
    """

    def __init__(self, options: dict, schema: StructType):
        self.path, self.most, self.job = options["path"].rstrip("/"), int(options.get("max_bytes", 1 << 30)), published.new_job()
        self.software = options.get("software", "weftline")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, path = file_system(self.path)
        system.create_dir(path, recursive=True)
        names, out, size, info = [], None, 0, new_id()
        try:
            for row in rows:
                own = row.asDict()
                data = exchange(own, info)
                if out is None or size + len(data) > self.most:
                    if out is not None:
                        out.close()
                        info = new_id()
                        data = exchange(own, info)  # it names the file's first record
                    names.append(published.new_name(self.job, ".warc.gz"))
                    out = system.open_output_stream(f"{path}/{names[-1]}", compression=None)
                    first = warcinfo(info, names[-1], stamp(own.get("date")), self.software)
                    out.write(first)
                    size = len(first)
                out.write(data)
                size += len(data)
            if out is not None:
                out.close()
        except BaseException:
            if out is not None:
                out.close()
            published.discard(self.path, names)
            raise
        return _Written(names)

    def commit(self, messages: list) -> None:
        published.publish(self.path, [n for m in messages if m for n in m.names], self.job)

    def abort(self, messages: list) -> None:
        published.discard_job(self.path, self.job, ".warc.gz")


class WarcSource(DataSource):
    """spark.read.format("warc").load(path) and df.write.format("warc").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").load(path)


def http_parts(block: Column) -> dict[str, Column]:
    """HTTP headers and body of a response block, split at the first blank line."""
    one_by_byte = F.decode(block, "ISO-8859-1")
    crlf, lf = F.instr(one_by_byte, "\r\n\r\n"), F.instr(one_by_byte, "\n\n")
    at, gap = F.when(crlf > 0, crlf).otherwise(lf), F.when(crlf > 0, 4).otherwise(2)
    head = F.when(at > 0, F.substr(block, F.lit(1), at - 1)).otherwise(F.lit(b""))
    return {"http_headers": head, "http_body": F.when(at > 0, F.substr(block, at + gap)).otherwise(block)}


_LINK = "struct<path: string, url: string, text: string, title: string, rel: string>"
_META = "struct<name: string, property: string, content: string>"
ENVELOPE = (
    "struct<Container: struct<Filename: string, Offset: string, `Gzip-Metadata`: struct<`Deflate-Length`: string>>, "
    "Envelope: struct<`WARC-Header-Metadata`: map<string, string>, `Payload-Metadata`: struct<`HTTP-Response-Metadata`: struct<`Response-Message`: struct<Status: string>, "
    f"Headers: map<string, string>, `HTML-Metadata`: struct<Head: struct<Title: string, Metas: array<{_META}>>, Links: array<{_LINK}>>>>>>"
)


def wat(records: DataFrame) -> DataFrame:
    """Metadata records with their links and metas; records without a URL are dropped."""
    rows = records.where("type = 'metadata' and octet_length(block) > 0").withColumn("e", F.from_json(F.col("block").cast("string"), ENVELOPE))
    http = "e.Envelope.`Payload-Metadata`.`HTTP-Response-Metadata`"
    url = F.regexp_replace(F.coalesce(F.nullif(F.try_element_at(F.col("e.Envelope.`WARC-Header-Metadata`"), F.lit("WARC-Target-URI")), F.lit("")), F.col("url")), "^<|>$", "")
    types = F.filter(F.map_entries(f"{http}.Headers"), lambda x: F.lower(x["key"]) == "content-type")
    links = F.coalesce(F.col(f"{http}.`HTML-Metadata`.Links"), F.array().cast(f"array<{_LINK}>"))
    made = rows.where("e is not null").select(
        "record_id",
        url.alias("url"),
        "date",
        F.col("e.Container.Filename").alias("warc_filename"),
        F.coalesce(F.col("e.Container.Offset").try_cast("long"), F.lit(0)).alias("warc_offset"),
        F.coalesce(F.col("e.Container.`Gzip-Metadata`.`Deflate-Length`").try_cast("long"), F.lit(0)).alias("warc_length"),
        F.coalesce(F.split(F.col(f"{http}.`Response-Message`.Status"), r"\s+")[0].try_cast("int"), F.lit(0)).alias("http_status"),
        F.trim(F.substring_index(F.get(types, 0)["value"], ";", 1)).alias("content_type"),
        F.col(f"{http}.`HTML-Metadata`.Head.Title").alias("title"),
        F.coalesce(F.col(f"{http}.`HTML-Metadata`.Head.Metas"), F.array().cast(f"array<{_META}>")).alias("metas"),
        links.alias("links"),
        F.size(links).alias("links_count"),
    )
    return made.where("url <> ''")


def flatten_links(wats: DataFrame) -> DataFrame:
    """A row for each link of each page."""
    return wats.select(F.col("url").alias("source"), F.explode("links").alias("link")).select("source", "link.*")


def wet(records: DataFrame) -> DataFrame:
    """Conversion records as trimmed text; without URL or text they are dropped."""
    body = F.regexp_replace(F.col("block").cast("string"), r"^\s+|\s+$", "")
    return records.where("type = 'conversion'").select("record_id", "url", "date", F.col("language").alias("content_language"), body.alias("text")).where("url <> '' and text <> ''")


def kind_of(name: str) -> str:
    """wat, wet or warc, by a file's name."""
    return next((k for k in ("wat", "wet") if f".{k}." in name), "warc")


def archive_filter(records: DataFrame, kind: str = "", status: int = 0, mime: str = "", url: str = "", content: bool = False) -> DataFrame:
    """Records by type, HTTP status and parts of type and URL; extraction implies responses."""
    kind = kind or ("response" if content else "")
    for given, test in ((kind, F.col("type") == kind), (status, F.col("http_status") == status), (mime, F.contains(F.col("http_mime"), F.lit(mime))), (url, F.contains(F.col("url"), F.lit(url)))):
        if given:
            records = records.where(test)
    return records


#: Arrow types of the columns of a record.
ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "timestamp": pa.timestamp("us", "UTC"), "binary": pa.binary()}


def joined(places: Iterator[tuple[str, int, int]], gap: int, most: int) -> Iterator[list[tuple[str, int, int]]]:
    """Sorted places (filename, offset, length) in groups that one read covers; repeated places count once."""
    group: list[tuple[str, int, int]] = []
    for place in places:
        name, offset, length = place
        if group and group[-1][:2] == place[:2]:
            continue
        if group and (group[0][0] != name or offset - sum(group[-1][1:]) > gap or offset + length - group[0][1] > most):
            yield group
            group = []
        group.append(place)
    if group:
        yield group


def fetch(spark: SparkSession, path: str, locations: DataFrame, gap: int = 1 << 20, most: int = 16 << 20) -> DataFrame:
    """The records at locations (filename, offset, length) of the archives under path, each once, by reading only those bytes, and an error column.

    Places are sorted by ranges, so the places of one large file are dealt to many tasks; neighbours whose hole is at most `gap` come by
    one read of at most `most` bytes, unless one record alone is longer. A place that holds no whole record is a row with its place and what is wrong
    there in `error`, else null, so every different place is a row; also one that is null, negative or in no file.
    """
    system, inside = file_system(path)
    folder = path.rpartition("/")[0] if system.get_file_info(inside).type == fs.FileType.File else path.rstrip("/")
    schema = pa.schema([*((n, ARROW[t]) for n, t in (c.split() for c in SCHEMA.split(", "))), ("error", pa.string())])

    def record(data: bytes) -> dict:
        """A record, or what is wrong with its bytes."""
        machine = zlib.decompressobj(31)
        try:
            row = parse_record(machine.decompress(data))
        except zlib.error as fault:
            return {"error": f"not a compressed record: {fault}"}
        if not machine.eof:
            return {"error": "the record is cut off"}
        return row or {"error": "no record"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = (p for b in batches for p in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        for group in joined(places, gap, most):
            own, start = group[0][0], group[0][1]
            reader, name = file_system(f"{folder}/{own}")
            try:
                with reader.open_input_file(name) as file:
                    file.seek(start)
                    data = file.read(max(o + n for _, o, n in group) - start)
            except FileNotFoundError:
                rows = [{"error": "no such file"} for _ in group]
            else:
                rows = [record(data[o - start : o - start + n]) for _, o, n in group]
            yield pa.RecordBatch.from_pylist([r | {"filename": own, "offset": o, "length": n} for r, (_, o, n) in zip(rows, group, strict=True)], schema)

    wanted = locations.select("filename", F.col("offset").cast("long"), F.col("length").cast("long"))
    real = F.coalesce(F.col("filename").isNotNull() & (F.col("offset") >= 0) & (F.col("length") > 0), F.lit(False))
    places = wanted.where(real).repartitionByRange("filename", "offset").sortWithinPartitions("filename", "offset", "length")
    found = places.mapInArrow(run, f"{SCHEMA}, error string")
    odd = wanted.where(~real).distinct()
    none = [F.col(f.name) if f.name in wanted.columns else F.lit("no place" if f.name == "error" else None).cast(f.dataType).alias(f.name) for f in found.schema]
    return found.unionByName(odd.select(*none))


def convert(records: DataFrame, extract) -> DataFrame:
    """Rows for Parquet or JSON lines: records with title and text of HTML responses, in whatever charset they came."""
    parts = http_parts(F.col("block"))
    kind = F.regexp_extract(F.decode("http_headers", "ISO-8859-1"), r"(?im)^content-type:[ \t]*([^\r\n]*)", 1)
    is_page = html.is_html_page(F.col("type"), F.col("http_status"), F.col("http_mime"), F.col("http_body"))
    rows = records.withColumns(parts).withColumn("html", charsets.decoded(F.when(is_page, F.col("http_body")), kind)["text"])
    return rows.select("url", "date", "type", "http_status", "http_mime", html.title("html").alias("title"), extract(F.col("html")).alias("markdown"))


def pairs(records: DataFrame) -> DataFrame:
    """Responses that have a request, with its id and block; those without one aren't rows, repeated ids give a row for each match."""
    asked = records.where("type = 'request'").select(F.col("record_id").alias("request_id"), F.col("concurrent_to").alias("__response"), F.col("block").alias("request"))
    responses = records.where("type = 'response'")
    return responses.join(asked, (F.col("record_id") == F.col("__response")) & (F.col("concurrent_to") == F.col("request_id"))).drop("__response")


def convert_as(records: DataFrame, kind: str, extract) -> DataFrame:
    """Rows for Parquet or JSON lines by the kind of archive (`kind_of`): pages of warc, links and metas of wat, texts of wet."""
    if kind not in ("warc", "wat", "wet"):
        raise ValueError(f"no kind of archive: {kind}")
    return wat_row(wat(records)) if kind == "wat" else wet(records) if kind == "wet" else convert(records, extract)


def wat_row(row: DataFrame) -> DataFrame:
    """Links and metas as JSON text, for flat Parquet."""
    return row.withColumns({"links": F.to_json("links"), "metas": F.to_json("metas")})

