"""Queries over archives, text tables and work lists, which are first written from the pages and other tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from weftline.functions import charsets, hashes
from weftline.operators import hosts, ledger, look_ahead
from weftline.queries.index import index
from weftline.queries.registry import query
from weftline.session import cut, shared_dir, table
from weftline.sources import archives, captures, sink, tables
from weftline.streaming import worklist

STATUS = "CASE page_id % 10 WHEN 0 THEN 404 WHEN 1 THEN 301 ELSE 200 END"

PAGE = "concat('<urn:page:', page_id, '>')"


def new_folder(spark, name):
    return f"{shared_dir(spark)}/weftline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(spark, sf_dir):
    """The folder of archives with a response for each page, under an id that names the page: several pages may have one URL."""
    archives.register(spark)
    folder = new_folder(spark, "archive")
    head = F.concat(F.lit("HTTP/1.1 "), F.expr(STATUS).cast("string"), F.lit(" Said\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"))
    rows = table(spark, sf_dir, "pages").select("url", F.lit("response").alias("type"), F.expr(PAGE).alias("record_id"), F.concat(head, "html").cast("binary").alias("block"))
    rows.write.format("warc").mode("append").option("max_bytes", str(1 << 20)).save(folder)
    return folder


RESPONSES = f"SELECT url, ({STATUS})::INT AS http_status, 'text/html' AS http_mime, sha256(html) AS body, strlen(html)::BIGINT AS size FROM pages"


def responses(records):
    body = archives.http_parts(F.col("block"))["http_body"]
    return records.select("url", "http_status", "http_mime", F.sha2(body, 256).alias("body"), F.octet_length(body).cast("long").alias("size"))


@query(RESPONSES)
def archive_responses(spark, sf_dir):
    """Pages written as archives and read again."""
    return responses(archives.archive_filter(archives.read_warc(spark, written(spark, sf_dir)), content=True))


CRLF = "chr(13) || chr(10)"


@query(
    f"""WITH p AS (SELECT page_id, url, 'GET /' || page_id || ' HTTP/1.1' || {CRLF} || {CRLF} AS request, 'HTTP/1.1 ' || ({STATUS}) || ' Said' || {CRLF} || 'Content-Type: text/html; charset=utf-8' || {CRLF} || {CRLF} || html AS block, html FROM pages WHERE page_id % 3 <> 0),
    d AS (SELECT *, sha1(block) AS b, sha1(html) AS h FROM p)
    SELECT url, sha256(request) AS request, CASE WHEN page_id % 5 = 0 THEN 'length' ELSE '' END AS truncated, '10.0.0.' || (page_id % 200) AS ip,
    'sha1:' || array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(b, i // 4 * 5 + 1, 5))::BIGINT >> (15 - i % 4 * 5)) & 31) + 1)::BIGINT, 1) FOR i IN range(32)], '') AS block_digest,
    'sha1:' || array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, i // 4 * 5 + 1, 5))::BIGINT >> (15 - i % 4 * 5)) & 31) + 1)::BIGINT, 1) FOR i IN range(32)], '') AS payload_digest,
    true AS digests_right, true AS same_file FROM d"""
)
def archive_pairs(spark, sf_dir):
    """Requests and responses written as linked records in small files, read again and joined by the names they give each other; a third of the pages has no request."""
    archives.register(spark)
    folder = new_folder(spark, "exchanges")
    key = F.col("page_id")
    head = F.concat(F.lit("HTTP/1.1 "), F.expr(STATUS).cast("string"), F.lit(" Said\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"))
    asked = F.concat(F.lit("GET /"), key.cast("string"), F.lit(" HTTP/1.1\r\n\r\n"))
    rows = table(spark, sf_dir, "pages").select(
        "url", F.when(key % 3 != 0, asked).cast("binary").alias("request"), F.concat(head, "html").cast("binary").alias("block"),
        F.when(key % 5 == 0, "length").alias("truncated"), F.concat(F.lit("10.0.0."), (key % 200).cast("string")).alias("ip"),
    )
    rows.write.format("warc").mode("append").option("max_bytes", str(1 << 16)).save(folder)
    records = archives.read_warc(spark, folder)
    found = archives.pairs(records)
    files = records.where("type = 'request'").select(F.col("record_id").alias("request_id"), F.col("filename").alias("request_file"))
    body = archives.http_parts(F.col("block"))["http_body"]
    right = (F.col("block_digest") == hashes.sha1_base32(F.col("block"))) & (F.col("payload_digest") == hashes.sha1_base32(body))
    return found.join(files, "request_id").select("url", F.sha2("request", 256).alias("request"), "truncated", "ip", "block_digest", "payload_digest", right.alias("digests_right"), (F.col("filename") == F.col("request_file")).alias("same_file"))


@query("SELECT doc_id, lang, sha256(text) AS text FROM documents")
def captures_sealed(spark, sf_dir):
    """Documents through the capture sink, in shards that close by their size."""
    sink.register(spark)
    folder = new_folder(spark, "sealed")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    rows.write.format("captures_sink").mode("append").option("target_bytes", str(16 << 20)).option("group_bytes", str(4 << 20)).save(folder)
    return sink.read(spark, folder, rows.schema).select("doc_id", "lang", F.sha2("text", 256).alias("text"))


#: How each eighth of the pages is written: the codec, and whether a mark, the server, the page or nothing says so.
WAYS = (("utf-8-sig", None, ""), ("utf-16", None, ""), ("cp1252", "windows-1252", ""), ("cp1252", None, '<meta charset="iso-8859-1">'), ("utf-8", None, ""), ("cp1252", None, ""), ("gb18030", "gbk", ""), ("gb18030", None, '<meta http-equiv="Content-Type" content="text/html; charset=gb2312">'))


@F.pandas_udf(BinaryType())
def in_charset(page: pd.Series, way: pd.Series) -> pd.Series:
    """Pages as bytes; what a charset lacks is written as a reference."""
    return pd.Series([p.encode(WAYS[w][0], "xmlcharrefreplace") for p, w in zip(page, way, strict=True)])


@query(
    "WITH p AS (SELECT page_id, page_id % 8 AS way, replace(html, '<meta charset=\"utf-8\">', '') AS html FROM pages) "
    "SELECT page_id, ['utf-8', 'utf-16le', 'windows-1252', 'windows-1252', 'utf-8', 'windows-1252', 'gb18030', 'gb18030'][way + 1] AS charset, "
    "sha256(CASE way WHEN 3 THEN '<meta charset=\"iso-8859-1\">' WHEN 7 THEN '<meta http-equiv=\"Content-Type\" content=\"text/html; charset=gb2312\">' ELSE '' END || html) AS text FROM p"
)
def pages_charsets(spark, sf_dir):
    """Pages in eight charsets, declared in several ways or not at all, and what is read back."""
    way = (F.col("page_id") % 8).cast("int")
    pick = lambda k: F.get(F.array(*[F.lit(w[k]).cast("string") for w in WAYS]), way)
    page = F.concat(pick(2), F.replace("html", F.lit('<meta charset="utf-8">')))
    body = table(spark, sf_dir, "pages").select("page_id", in_charset(page, way).alias("body"), F.concat(F.lit("text/html; charset="), pick(1)).alias("kind"))
    found = body.select("page_id", charsets.decoded("body", "kind").alias("d"))
    return found.select("page_id", "d.charset", F.sha2("d.text", 256).alias("text"))


@query(RESPONSES + " WHERE contains(url, '/en/')")
def archive_fetch(spark, sf_dir):
    """Records read at their locations, in joined byte ranges."""
    folder = written(spark, sf_dir)
    places = cut(archives.read_warc(spark, folder).select("filename", "offset", "length", "url"), "places")
    return responses(archives.fetch(spark, folder, places.where(F.contains("url", F.lit("/en/")))))


@query(
    "SELECT page_id % 4 AS kind, CASE page_id % 4 WHEN 1 THEN 'the record is cut off' WHEN 2 THEN 'no such file' WHEN 3 THEN 'no place' END AS error, count(*) AS n, count(*) FILTER (WHERE page_id % 4 = 0) AS records FROM pages GROUP BY 1, 2"
)
def archive_fetch_faults(spark, sf_dir):
    """Places of which most are wrong: every one is a row, and says what is wrong there."""
    folder = written(spark, sf_dir)
    page = F.regexp_extract("record_id", "^<urn:page:(-?[0-9]+)>$", 1).cast("long")
    known = cut(archives.read_warc(spark, folder).where("type = 'response'").select("filename", "offset", "length", page.alias("page_id")), "places")
    kind = F.col("page_id") % 4
    places = known.select(kind.alias("kind"), F.when(kind == 2, F.concat("filename", F.lit(".no"))).otherwise(F.col("filename")).alias("filename"), F.when(kind == 3, -F.col("page_id")).otherwise(F.col("offset")).alias("offset"), F.when(kind == 1, F.col("length") - 5).otherwise(F.col("length")).alias("length"))
    found = archives.fetch(spark, folder, places.drop("kind"))
    rows = found.join(places, ["filename", "offset", "length"])
    return rows.groupBy("kind", "error").agg(F.count("*").alias("n"), F.count("url").alias("records"))


@query("SELECT type, count(*) AS n FROM (SELECT 'response' AS type FROM pages WHERE page_id % 10 = 0) GROUP BY 1")
def archive_filtered(spark, sf_dir):
    """Failed responses; the archives' own records are none."""
    found = archives.archive_filter(archives.read_warc(spark, written(spark, sf_dir)), status=404, mime="html")
    return found.groupBy("type").agg(F.count("*").alias("n"))


@query(r"SELECT 'r' || doc_id AS record_id, 'https://d/' || doc_id AS url, lang AS content_language, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS digest FROM documents WHERE regexp_matches(text, '\S')")
def archive_text(spark, sf_dir):
    """Text records; those without a text are dropped."""
    own = F.col("doc_id").cast("string")
    rows = table(spark, sf_dir, "documents").select(
        F.lit("conversion").alias("type"), F.concat(F.lit("r"), own).alias("record_id"), F.concat(F.lit("https://d/"), own).alias("url"), F.lit(None).cast("timestamp").alias("date"), F.col("lang").alias("language"),
        F.concat(F.lit(" \n"), "text", F.lit("\n\n")).cast("binary").alias("block"),
    )
    return archives.wet(rows).select("record_id", "url", "content_language", F.sha2("text", 256).alias("digest"))


def envelopes(spark, sf_dir):
    """Metadata records of the pages with two links each."""
    link = lambda path, text: F.struct(F.lit("A@/href").alias("path"), path.alias("url"), F.lit(text).alias("text"))
    page = F.struct(
        F.struct(F.concat(F.lit("T"), F.col("page_id").cast("string")).alias("Title")).alias("Head"),
        F.array(link(F.concat(F.lit("/up/"), F.col("page_id").cast("string")), "up"), link(F.lit("/home"), "home")).alias("Links"),
    )
    http = F.struct(F.struct(F.concat(F.expr(STATUS).cast("string"), F.lit(" Said")).alias("Status")).alias("Response-Message"), F.create_map(F.lit("content-Type"), F.lit("text/html; charset=x")).alias("Headers"), page.alias("HTML-Metadata"))
    envelope = F.struct(F.create_map(F.lit("WARC-Target-URI"), F.concat(F.lit("<"), "url", F.lit(">"))).alias("WARC-Header-Metadata"), F.struct(http.alias("HTTP-Response-Metadata")).alias("Payload-Metadata"))
    whole = F.to_json(F.struct(F.struct(F.lit("a.gz").alias("Filename"), F.col("page_id").cast("string").alias("Offset")).alias("Container"), envelope.alias("Envelope")))
    block = F.when(F.col("page_id") % 9 == 0, F.lit("")).otherwise(whole).cast("binary")
    return table(spark, sf_dir, "pages").select(F.lit("metadata").alias("type"), F.col("page_id").cast("string").alias("record_id"), F.lit("").alias("url"), F.lit(None).cast("timestamp").alias("date"), block.alias("block"))


@query(f"SELECT page_id::VARCHAR AS record_id, url, 'a.gz' AS warc_filename, page_id AS warc_offset, ({STATUS})::INT AS http_status, 'text/html' AS content_type, 'T' || page_id AS title, 2 AS links_count FROM pages WHERE page_id % 9 <> 0")
def archive_metadata(spark, sf_dir):
    """Metadata records; empty ones are dropped."""
    made = archives.wat(envelopes(spark, sf_dir))
    return made.select("record_id", "url", "warc_filename", "warc_offset", "http_status", "content_type", "title", "links_count")


@query("SELECT url AS source, unnest(['/up/' || page_id, '/home']) AS url FROM pages WHERE page_id % 9 <> 0")
def archive_links(spark, sf_dir):
    """A row for each link that metadata records name."""
    return archives.flatten_links(archives.wat(envelopes(spark, sf_dir))).select("source", "url")


def lines(spark, sf_dir, name, value):
    """One line of text for each row of a table."""
    return table(spark, sf_dir, name).select(F.expr(value).alias("value"))


RANK = "CASE WHEN s_suppkey % 10 = 0 THEN '# comment' WHEN s_suppkey % 10 = 1 THEN concat_ws('\t', s_suppkey, 1) WHEN s_suppkey % 10 = 2 THEN concat_ws('\t', 'x', 0.5, s_suppkey, 0.25, 'com.bad') ELSE concat_ws('\t', s_suppkey, s_nationkey, s_suppkey + 1, 0.25, concat('com.h', s_suppkey), 7) END"


@query(
    "SELECT CASE WHEN s_suppkey % 10 = 2 THEN NULL ELSE s_suppkey END AS harmonic_pos, CASE WHEN s_suppkey % 10 = 2 THEN 0.5 ELSE s_nationkey END::DOUBLE AS harmonic_val, CASE WHEN s_suppkey % 10 = 2 THEN s_suppkey ELSE s_suppkey + 1 END AS pagerank_pos, "
    "0.25::DOUBLE AS pagerank_val, CASE WHEN s_suppkey % 10 = 2 THEN 'com.bad' ELSE 'com.h' || s_suppkey END AS host_rev FROM supplier WHERE s_suppkey % 10 > 1"
)
def rank_lines(spark, sf_dir):
    """Rank lines: comments and short lines are dropped, numbers that don't parse are null."""
    return tables.ranks(lines(spark, sf_dir, "supplier", RANK))


@query("SELECT 'h' || s_suppkey || '.com' AS domain, s_suppkey AS harmonic_pos, s_nationkey::DOUBLE AS harmonic_val, s_suppkey + 1 AS pagerank_pos, 0.25::DOUBLE AS pagerank_val, 7::BIGINT AS n_hosts FROM supplier WHERE s_suppkey % 10 > 2")
def rank_domain_lines(spark, sf_dir):
    """Strict rank lines: one number that doesn't parse drops a line."""
    return tables.domain_ranks(lines(spark, sf_dir, "supplier", RANK))


@query("SELECT c_custkey AS id, 'com.h' || c_custkey AS host_rev, c_custkey AS src, c_nationkey::BIGINT AS dst FROM customer WHERE c_custkey % 7 <> 0")
def graph_lines(spark, sf_dir):
    """Vertices and edges from lines; those that aren't two fields, or not numbers, are skipped."""
    vertices = tables.vertices(lines(spark, sf_dir, "customer", "CASE WHEN c_custkey % 7 = 0 THEN 'lone' ELSE concat_ws('\t', c_custkey, concat('com.h', c_custkey)) END"))
    edges = tables.edges(lines(spark, sf_dir, "customer", "CASE WHEN c_custkey % 7 = 0 THEN 'a\tb' ELSE concat_ws('\t', c_custkey, c_nationkey) END"))
    return vertices.join(edges, F.col("id") == F.col("src"))


@query(captures.SQL + "SELECT url, timestamp, fetch_status::VARCHAR AS status, content_digest AS digest FROM captures WHERE page_id % 9 <> 0")
def capture_lines(spark, sf_dir):
    """Captures written as JSON lines, every ninth of them broken."""
    rows = index(spark, sf_dir).select("page_id", "url", "timestamp", F.col("fetch_status").cast("string").alias("status"), F.col("content_digest").alias("digest"))
    folder = new_folder(spark, "captures")
    rows.select(F.when(F.col("page_id") % 9 == 0, '{"url": "http').otherwise(F.to_json(F.struct("url", "timestamp", "status", "digest"))).alias("value")).write.text(folder)
    return tables.capture_pages(spark, folder).select("url", "timestamp", "status", "digest")


@query("SELECT 'https://d/' || doc_id AS url, 'T' AS title, text, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN source ELSE '' END AS language FROM documents WHERE doc_id % 4 <> 0")
def document_rows(spark, sf_dir):
    """Documents with a URL; the language is the first name that is set."""
    key = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        F.when(key % 4 != 0, F.concat(F.lit("https://d/"), key.cast("string"))).alias("url"), F.lit("T").alias("title"), "text",
        F.when(key % 3 == 0, F.col("lang")).otherwise("").alias("language"), F.when(key % 3 == 1, F.col("source")).alias("content_language"),
    )
    return tables.document_lines(rows)


QUOTED = "CASE WHEN regexp_matches({0}, '[,\"\\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"


@query(f"SELECT n_nationkey || ',' || {QUOTED.format('n_name')} || ',' || {QUOTED.format('said')} AS value FROM (SELECT n_nationkey, n_name, n_name || ', \"it\"' AS said FROM nation)")
def render_csv(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.concat("n_name", F.lit(', "it"')).alias("said"))
    return tables.render(rows, "csv")


@query("SELECT '| ' || n_nationkey || ' | ' || n_name || '\\| |' AS value FROM nation")
def render_markdown(spark, sf_dir):
    """Bars inside cells are escaped."""
    return tables.render(table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit("|")).alias("name")), "markdown")


@query("SELECT 0::BIGINT AS at, '| key | name |' AS value UNION ALL SELECT 0, '| --- | --- |' UNION ALL SELECT 1, '| ' || s_suppkey || ' | ' || s_name || ' |' FROM supplier")
def render_headed(spark, sf_dir):
    """Lines of a table in Markdown with its header."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    lines = tables.headed(rows, "markdown")
    return lines.select(F.when(F.col("value").isin("| key | name |", "| --- | --- |"), 0).otherwise(1).cast("long").alias("at"), "value")


@query("SELECT 'p/part-' || s_suppkey || '.parquet' AS path, s_suppkey AS part FROM supplier")
def work_parts(spark, sf_dir):
    """Part files with the number that orders them."""
    return tables.numeric_parts(table(spark, sf_dir, "supplier").select(F.concat(F.lit("p/part-"), F.col("s_suppkey").cast("string"), F.lit(".parquet")).alias("path")))


WORK = "WITH work AS (SELECT (o_orderkey % 7)::BIGINT AS part, o_orderkey AS \"row\", o_custkey FROM orders), mark AS (SELECT part, \"row\" FROM work WHERE part >= 3 AND o_custkey % 5 = 0 ORDER BY part, \"row\" LIMIT 1)\n"


@query(WORK + "SELECT work.part, work.\"row\", 'https://h' || o_custkey || '.com/' AS url FROM work, mark WHERE work.part > mark.part OR (work.part = mark.part AND work.\"row\" >= mark.\"row\")")
def work_resumed(spark, sf_dir):
    """The rest of a work list from where its checkpoint stands, domains as URLs."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    work = table(spark, sf_dir, "orders").select((key % 7).alias("part"), key.alias("row"), F.concat(F.lit("h"), customer.cast("string"), F.lit(".com")).alias("domain"), "o_custkey")
    mark = ledger.checkpoint(work.where((F.col("part") >= 3) & (customer % 5 == 0)), "orders", 0)
    return ledger.resume(work, mark, "orders", 0).select("part", "row", ledger.domain_url(F.col("domain")).alias("url"))


@query(
    "WITH d AS (SELECT 'h' || o_custkey || '.com' AS value FROM orders), h AS (SELECT value, list_reduce(list_transform(range(0, strlen(value)), lambda i: ('0x' || substr(hex(encode(value)), (2 * i + 1)::BIGINT, 2))::HUGEINT), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616, 14695981039346656037::HUGEINT) AS h FROM d) "
    "SELECT 'https://' || value || '/' AS url, count(*) AS n FROM h WHERE h % 3 = 1 GROUP BY value"
)
def work_streamed(spark, sf_dir):
    """One of three shards of a written work list, taken as a stream in several batches."""
    folder, out = new_folder(spark, "worklist"), new_folder(spark, "worked")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("h"), F.col("o_custkey").cast("string"), F.lit(".com")).alias("domain"))
    rows.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").select("domain").write.parquet(folder)
    most = max(1, -(-rows.count() // 4))
    stream = worklist.read(spark, folder, f"{out}-mark", shard=1, shards=3, rows_per_batch=most)
    running = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-mark").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.parquet(out).groupBy("url").agg(F.count("*").alias("n"))


@query(
    "WITH r AS (SELECT event_id, user_id, event_id // 64 AS block FROM events) "
    "SELECT event_id, block, row_number() OVER (PARTITION BY block, user_id ORDER BY event_id)::INT AS turn, min(event_id) OVER (PARTITION BY block, user_id) AS host_first FROM r"
)
def spread_bounded(spark, sf_dir):
    """Users take turns within each 64 rows read, so no more are held at once."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    return ledger.spread(rows, "user_id", "event_id", 64).select("event_id", "block", "turn", "host_first")


@query()
def spread_sliding(spark, sf_dir):
    """Users take turns over lists of 4,096 events each, at most 8 users or 1,024 rows held back; tested against a plain walk."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.col("event_id") / 4096).cast("long").alias("part"))
    return look_ahead.spread(rows, "user_id", "event_id", "part", workers=8, batch=64)


@query(captures.SQL + "SELECT count(*) AS pages, sum((a.content_digest <> b.content_digest)::INT)::BIGINT AS changed FROM captures a JOIN captures_b b USING (url) WHERE b.page_id % 6 <> 0")
def archived_live_change(spark, sf_dir):
    """Archived pages against those fetched since, by the hash of their URL; failed fetches are left out."""
    doc_id = hashes.markdown_doc_id(F.col("url")).alias("doc_id")
    live = captures.from_pages(table(spark, sf_dir, "pages"), "B").select(doc_id, F.col("content_digest").alias("markdown"), F.when(F.col("page_id") % 6 == 0, "timeout").otherwise("").alias("error"))
    return ledger.changed_since(index(spark, sf_dir).select(doc_id, F.col("content_digest").alias("markdown")), live)


MONTH = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"


@query(f"SELECT 'cc-main-' || (2015 + n_nationkey % 8) || '-' || {MONTH}[(n_nationkey % 12)::INT + 1] AS name, n_nationkey::BIGINT AS size FROM nation WHERE n_nationkey % 3 <> 0 ORDER BY (2015 + n_nationkey % 8) * 100 + n_nationkey % 12 DESC, name DESC LIMIT 1")
def release_published(spark, sf_dir):
    """The newest release whose table has been published."""
    key = F.col("n_nationkey")
    month = F.array(*[F.lit(m) for m in hosts.MONTHS])[(key % 12).cast("int")]
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("cc-main-"), (key % 8 + 2015).cast("string"), F.lit("-"), month).alias("name"), F.when(key % 3 == 0, 0).otherwise(key).cast("long").alias("size"))
    return hosts.first_published(rows)


@query("SELECT s_suppkey, round(s_nationkey * (100.0 / (s_suppkey % 10)), 6)::DOUBLE AS projected FROM supplier WHERE s_suppkey % 10 > 0 UNION ALL SELECT s_suppkey, NULL FROM supplier WHERE s_suppkey % 10 = 0")
def size_projected(spark, sf_dir):
    """What a whole crawl of 100 shards would hold, from the shards done; null before the first."""
    projected = ledger.projected(F.col("s_nationkey"), F.col("s_suppkey") % 10, 100)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(projected, 6).alias("projected"))


@query(captures.SQL + "SELECT status, count(*) AS domains FROM (SELECT CASE WHEN a.u IS NULL THEN 'added' WHEN b.u IS NULL THEN 'removed' ELSE 'shared' END AS status FROM (SELECT DISTINCT url_host_name AS u FROM captures WHERE page_id % 2 = 0) a FULL JOIN (SELECT DISTINCT url_host_name AS u FROM captures_b) b ON a.u = b.u) GROUP BY 1")
def domain_diff_counts(spark, sf_dir):
    """Domains added, removed and shared between two releases."""
    old = index(spark, sf_dir).where("page_id % 2 = 0").select(F.col("url_host_name").alias("domain"))
    new = captures.from_pages(table(spark, sf_dir, "pages"), "B").select(F.col("url_host_name").alias("domain"))
    return hosts.domain_diff(old, new).groupBy("status").agg(F.count("*").alias("domains"))
