"""WARC archives of pages, and a two-level index of their captures.

Tasks write records, each a gzip member of its own, into files of the shared folder. The index
holds one line per capture in order of the URL's reversed host; lines go into compressed
blocks, and a sparse directory keeps the first and last key, the offset and the length of each block.
A lookup searches the directory, reads the range of the blocks that may hold its keys, searches
those, and reads the ranges of the records they name.

A file has a name no other attempt uses, and counts only where a table Spark has committed names it;
what a lost task leaves behind is never read.
"""

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import functions as F

from pulsewatch.llm.common import parallelism, read, stored
from pulsewatch.llm.files import parquet_batches
from pulsewatch.operators.sizing import fits_broadcast, salted_join
from pulsewatch.session import run_dir
from pulsewatch.sources.files import place

LEAST_REVISIT = 100
FILE_BYTES = 256 * 1024 * 1024
BLOCK_LINES = 3000
SHARD_LINES = 1_000_000
HOT_PAGES = 20_000
READ_BYTES = 8 * 1024 * 1024
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PRINTABLE = "".join(chr(c) for c in range(33, 127))
URL = r"(?s)([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(?:#.*)?"

CAPTURES = "key string, file string, offset long, length long, url string, digest string, type string"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def escaped(url):
    """The URL without blanks, control characters and characters past ASCII."""
    return quote(url, safe=PRINTABLE)


def url_key(url):
    """Host from its last label to its first, then path and query, without scheme and fragment.

    Schemes, the case of the host, users and default ports do not tell keys apart. A null URL has
    the empty key; one without a host is its own key.
    """
    if url is None:
        return ""
    parts = re.fullmatch(URL, url)
    if not parts or not parts[2]:
        return escaped(url)
    host, port = re.fullmatch(r"(?s)(.*?)(?::([0-9]*))?", parts[2].rpartition("@")[2].lower()).groups()
    if not re.fullmatch(r"[0-9.]+|\[.*", host):
        host = ",".join(reversed(host.split(".")))
    if port and port not in ("80", "443"):
        host += f":{port}"
    return escaped(f"{host}){parts[3] or '/'}{parts[4] or ''}")


def member(raw):
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def unpacked(raw):
    """The bytes of one gzip member."""
    out = zlib.decompressobj(31)
    data = out.decompress(raw)
    if not out.eof or out.unused_data:
        raise ValueError("a range that is not one gzip member")
    return data


def record_id(page_id, digest):
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id} {digest}'.encode()).digest()[:16])}>"


def record(page_id, url, payload, digest, first=None, date=DATE):
    """A response, or where `first` gives the (page_id, url) it equals, a revisit of that one.

    A revisit keeps the header of the HTTP message and so the length of its payload.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if first is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {escaped(url)}")
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first[0], digest)}"]
        if first[0] is not None:
            head.append(f"Refers-To-Page-Id: {first[0]}")
        if first[1] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {escaped(first[1])}")
    head += [
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(raw):
    """(first line, fields, what follows) of a header block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    return first, dict(line.split(": ", 1) for line in lines), rest


def parsed(raw):
    """A record's header fields, and its payload (None for a revisit) and payload length.

    Lengths and the digest of a payload that is there are verified.
    """
    version, head, rest = fields(raw)
    size = int(head["Content-Length"])
    if version != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"broken record {head.get('WARC-Record-ID')}")
    _, http, payload = fields(rest[:size])
    length = int(http["Content-Length"])
    if head["WARC-Type"] == "revisit":
        return head, None, length
    if len(payload) != length or f"sha256:{hashlib.sha256(payload).hexdigest()}" != head["WARC-Payload-Digest"]:
        raise ValueError(f"broken payload in {head['WARC-Record-ID']}")
    return head, payload, length


def deduplicated(pages, least=LEAST_REVISIT):
    """Pages with `payload`, its `digest`, and `first` where another page's record is to be revisited."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    known = pages.withColumn("payload", payload).withColumn("digest", F.sha2("payload", 256)).drop("html")
    who = F.struct(F.col("page_id").isNull().alias("none"), "page_id")
    who_where = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    groups = known.where(F.octet_length("payload") >= least).groupBy("digest")
    firsts = groups.agg(F.min(who_where).alias("first"), F.max(who).alias("last"))
    several = (F.col("first.none") != F.col("last.none")) | (F.col("first.page_id") != F.col("last.page_id"))
    shared = stored(firsts.where(several).select("digest", "first"), "warc-shared")
    if fits_broadcast(shared):
        joined = known.join(F.broadcast(shared), "digest", "left")
    else:
        joined = salted_join(known, shared, ["digest"], "left", hot_rows=HOT_PAGES)
    own = F.col("first.page_id").eqNullSafe(F.col("page_id"))
    return joined.withColumn("first", F.when(own, None).otherwise(F.col("first")))


class Rolling:
    """Bytes appended to files of a folder; a file is closed once it has `most` bytes."""

    def __init__(self, folder, ending, most, head=b""):
        self.system, self.folder = place(folder)
        self.ending, self.most, self.head, self.file = ending, most, head, None

    def append(self, data):
        """(file name, offset) of the data."""
        if self.file is None:
            self.system.create_dir(self.folder, recursive=True)
            self.name, self.at = f"{uuid.uuid4().hex}{self.ending}", 0
            self.file = self.system.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            if self.head:
                self.file.write(self.head)
                self.at = len(self.head)
        name, offset = self.name, self.at
        self.file.write(data)
        self.at += len(data)
        if self.at >= self.most:
            self.close()
        return name, offset

    def close(self):
        if self.file is not None:
            self.file.close()
            self.file = None


def write_archive(pages, folder, page_id="page_id", url="url", html="html", file_bytes=FILE_BYTES, date=DATE):
    """Writes a record per row of `pages` into WARC files below `folder`; returns their captures.

    Payloads are the html in UTF-8, null as empty. Among records with equal payloads of at least
    100 bytes the one with the smallest page_id (null last) is a response and the others revisit it;
    rows that share that page_id are all responses, as are all smaller payloads. Null URLs
    are left out of the record, other characters than printable ASCII are percent-encoded in
    it. Payloads do not move between machines unless more digests repeat than may be broadcast.
    Further columns are ignored; an empty table gives no file. A payload of any length is one record.
    """
    columns = [F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")]
    rows = deduplicated(pages.select(*columns)).select("page_id", "url", "payload", "digest", "first")
    info = b"software: pulsewatch\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id('info', date)}", f"WARC-Date: {date}"]
    head += ["Content-Type: application/warc-fields", f"Content-Length: {len(info)}"]
    opening = member("\r\n".join(head).encode() + b"\r\n\r\n" + info + b"\r\n\r\n")

    def run(batches):
        files = Rolling(folder, ".warc.gz", file_bytes, opening)
        for batch in batches:
            ids, urls, digests = (batch.column(i).to_pylist() for i in (0, 1, 3))
            firsts, payloads = batch.column(4).to_pylist(), batch.column(2)
            out = []
            for i, (page, where, digest, first) in enumerate(zip(ids, urls, digests, firsts)):
                original = None if first is None else (first["page_id"], first["url"])
                packed = member(record(page, where, payloads[i].as_py(), digest, original, date))
                name, offset = files.append(packed)
                kind = "response" if original is None else "revisit"
                out.append((url_key(where), name, offset, len(packed), where, digest, kind))
            if out:
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                names = ["key", "file", "offset", "length", "url", "digest", "type"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        files.close()

    return stored(rows.mapInArrow(run, CAPTURES), "warc-captures")


def line(row, date):
    stamp = re.sub("[^0-9]", "", date)
    told = {"url": row["url"], "mime": "text/html", "status": "200", "digest": f"sha256:{row['digest']}", "type": row["type"]}
    told |= {"length": row["length"], "offset": row["offset"], "filename": row["file"]}
    return f"{row['key']} {stamp} {json.dumps(told)}\n"


def build_index(captures, folder, block_lines=BLOCK_LINES, shard_lines=SHARD_LINES, date=DATE):
    """Writes the index of captures below `folder`; returns the path of its table of shards.

    All lines are sorted over all tasks by key, file and offset, so captures of one key may fill
    any number of blocks and shards. A shard is a file of blocks of `block_lines` lines and a file with its
    directory. The table has a row per shard: about one in a million captures.
    """
    spark = captures.sparkSession
    shards = max(parallelism(spark), -(-captures.count() // shard_lines))

    def run(batches):
        system, path = place(folder)
        blocks, lines, directory, first, n = None, [], [], None, 0
        done = []

        def end_block(last):
            packed = member("".join(lines).encode())
            _, offset = blocks.append(packed)
            directory.append((first, last, offset, len(packed)))
            lines.clear()

        def end_shard():
            blocks.close()
            name = f"{uuid.uuid4().hex}.directory.gz"
            with system.open_output_stream(f"{path}/{name}", compression=None) as file:
                file.write(member(json.dumps(directory).encode()))
            done.append({"first": directory[0][0], "last": directory[-1][1], "file": blocks.name, "directory": name, "n": n})
            directory.clear()

        last = None
        for batch in batches:
            for row in batch.to_pylist():
                if blocks is None:
                    blocks = Rolling(folder, ".cdx.gz", float("inf"))
                    n = 0
                if not lines:
                    first = row["key"]
                lines.append(line(row, date))
                last, n = row["key"], n + 1
                if len(lines) == block_lines:
                    end_block(last)
                if n == shard_lines:
                    if lines:
                        end_block(last)
                    end_shard()
                    blocks = None
        if blocks is not None:
            if lines:
                end_block(last)
            end_shard()
        if done:
            yield pa.RecordBatch.from_pylist(done)

    order = ["key", "file", "offset"]
    ordered = captures.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    table = run_dir(spark, "llm-warc-shards")
    ordered.mapInArrow(run, "first string, last string, file string, directory string, n long").write.parquet(table)
    return table


def reaching(bounds, lasts, key):
    """The entries of a sorted directory, (first, last, ...), that may hold a key."""
    at = bisect_left(lasts, key)
    while at < len(bounds) and bounds[at][0] <= key:
        yield bounds[at]
        at += 1


def range_of(system, path, offset, length):
    with system.open_input_file(path) as file:
        return file.read_at(length, offset)


def lookup(keys, folder, table):
    """The captures of every distinct `key`: a search of the directories, then of the blocks.

    Keys that have none have no row. Directories and blocks are read once by each task that has keys
    for them; blocks of one key are dealt out to several tasks.
    """
    spark = keys.sparkSession
    tasks = parallelism(spark)

    def locate(batches):
        system, path = place(folder)
        shards = sorted(
            (r["first"], r["last"], r["file"], r["directory"])
            for b in parquet_batches(table, ["first", "last", "file", "directory"], 10_000)
            for r in b.to_pylist()
        )
        shard_lasts = [s[1] for s in shards]
        at, directory, lasts = None, [], []
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                for _, _, file, name in reaching(shards, shard_lasts, key):
                    if at != name:
                        with system.open_input_file(f"{path}/{name}") as opened:
                            directory = json.loads(unpacked(opened.read()))
                        at, lasts = name, [d[1] for d in directory]
                    out += [(key, file, offset, length) for _, _, offset, length in reaching(directory, lasts, key)]
            if out:
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["key", "file", "offset", "length"]
                )

    def scan(batches):
        system, path = place(folder)
        at, lines, own = None, [], []
        for batch in batches:
            out = []
            for key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (file, offset):
                    lines = unpacked(range_of(system, f"{path}/{file}", offset, length)).decode().splitlines()
                    own, at = [x.split(" ", 1)[0] for x in lines], (file, offset)
                place_of = bisect_left(own, key)
                while place_of < len(own) and own[place_of] == key:
                    told = json.loads(lines[place_of].split(" ", 2)[2])
                    out.append((key, told["filename"], told["offset"], told["length"], told["url"], told["digest"][7:], told["type"]))
                    place_of += 1
            if out:
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                names = ["key", "file", "offset", "length", "url", "digest", "type"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    asked = keys.select("key").distinct().repartitionByRange(tasks, "key").sortWithinPartitions("key")
    blocks = asked.mapInArrow(locate, "key string, file string, offset long, length long")
    dealt = blocks.repartition(tasks, "file", "offset").sortWithinPartitions("file", "offset", "key")
    return dealt.mapInArrow(scan, CAPTURES)


def url_keys(urls, url="url"):
    """The `key` of every row's URL."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], names=["key"])

    return urls.select(F.col(url).cast("string").alias("url")).mapInArrow(run, "key string")


def read_records(captures, folder, payloads=True):
    """The records of captures, read by range: page_id, url, record_type, payload_bytes,
    payload_digest, refers_to, and with `payloads` the payload (null for revisits).

    Records near each other in a file are read by one task, neighbours in one range of up to 8 MB.
    Responses are verified against their digest.
    """
    tasks = parallelism(captures.sparkSession)

    def run(batches):
        system, path = place(folder)
        at, file = None, None
        for batch in batches:
            todo = list(zip(*(c.to_pylist() for c in batch.columns)))
            low = 0
            while low < len(todo):
                name, begin, length = todo[low]
                high, end = low + 1, begin + length
                while high < len(todo) and todo[high][:2] == (name, end) and end - begin < READ_BYTES:
                    end += todo[high][2]
                    high += 1
                if at != name:
                    if file is not None:
                        file.close()
                    file, at = system.open_input_file(f"{path}/{name}"), name
                raw = file.read_at(end - begin, begin)
                out = []
                for _, offset, size in todo[low:high]:
                    head, payload, n = parsed(unpacked(raw[offset - begin : offset - begin + size]))
                    page, refers = head.get("Page-Id"), head.get("Refers-To-Page-Id")
                    own = [None if page is None else int(page), head.get("WARC-Target-URI"), head["WARC-Type"], n]
                    own += [head["WARC-Payload-Digest"].removeprefix("sha256:"), None if refers is None else int(refers)]
                    out.append((*own, payload) if payloads else tuple(own))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names[: len(out[0])])
                low = high
        if file is not None:
            file.close()

    near = F.floor(F.col("offset") / READ_BYTES)
    dealt = captures.select("file", "offset", "length").repartition(tasks, "file", near).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, RECORDS + (", payload binary" if payloads else ""))


def op13_warc(spark, sf_dir):
    """Archives all pages, indexes the captures, looks every URL up and reads what it names."""
    pages = read(spark, sf_dir, "pages")
    folder = run_dir(spark, "llm-warc")
    shards = build_index(write_archive(pages, f"{folder}/archive"), f"{folder}/index")
    found = lookup(url_keys(pages), f"{folder}/index", shards)
    records = read_records(found, f"{folder}/archive", payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), q AS (
  SELECT *, CASE WHEN payload_bytes >= {LEAST_REVISIT} THEN first_value(page_id) OVER (
    PARTITION BY payload ORDER BY page_id NULLS LAST) ELSE page_id END AS first FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest,
  CASE WHEN first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM q
"""
