"""WARC archives: a deterministic sharded writer, and a reader.

Payload digests are computed first; of records with equal payloads the one with
the smallest page_id holds the payload and the others revisit it.  Records are
cut into parts by ranges of page_id of about equal bytes (a tree of ranges that
is refined where they are heavy), sorted within their part, and written as one gzip member
each; a file is rolled at a compressed size.  A file gets a temporary name of
its own and is renamed when whole, so that a repeated or doubled task leaves the
same bytes; the manifest, written last, lists the files of the commit, and the
reader opens those alone.

Defined results: null html is an empty payload; a null url is written as
``urn:page:<page_id>``; rows with a null page_id are not written, as a record
needs an identity; rows that repeat a page_id are written each, and of those with equal payloads all but the first revisit it; an empty url stays empty; ids that span 2**63 or more raise.  Equal input
gives equal files.  Other columns are not used.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm.common import discard, long_array, pieces, stored

#: Bytes of payload in a part, and compressed bytes at which a file is rolled.
PART_BYTES = 256 << 20
ROLL_BYTES = 64 << 20
#: Smallest payload that is replaced by a revisit.
LEAST_BYTES = 0
DATE = "2000-01-01T00:00:00Z"
_BUCKETS, _FAN = 4096, 256
#: Parts of an archive; a larger one has larger parts.
_MOST_PARTS = 1 << 16
#: A payload of at least this share of all records is looked up in the task: at most its inverse many.
_HOT = 1 / 100
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "manifest.json"



def record_id(page_id: int, again: str = "") -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}{again}')}"


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None, again: str = "") -> bytes:
    """One record as a gzip member; ``again`` tells records of one page_id apart."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id(page_id, again)}>", f"WARC-Date: {DATE}"]
    target = (f"urn:page:{page_id}" if url is None else url).replace("\r", "%0D").replace("\n", "%0A")
    head.append(f"WARC-Target-URI: {target}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    head.append(f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}")
    head.append(f"Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>", f"Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class _Files:
    """Files of one part: temporary until whole, then renamed."""

    def __init__(self, root: str, roll: int):
        self._fs, self._root = pafs.FileSystem.from_uri(root)
        self._roll = roll
        self._out = None

    def _begin(self, part: int, number: int) -> None:
        self._part, self._number = part, number
        self._temporary = f"{self._root}/.{part:06d}-{number:04d}-{uuid.uuid4().hex}.tmp"
        self._out = self._fs.open_output_stream(self._temporary, compression=None)
        self._bytes = self._records = 0
        self._sum = hashlib.sha256()

    def end(self) -> dict | None:
        if self._out is None:
            return None
        self._out.close()
        self._out = None
        name = f"part-{self._part:06d}-{self._number:04d}.warc.gz"
        self._fs.move(self._temporary, f"{self._root}/{name}")
        return {"file": name, "records": self._records, "bytes": self._bytes, "sha256": self._sum.hexdigest()}

    def add(self, part: int, data: bytes) -> dict | None:
        """Write a record; the entry of the file that ended before it, if one did."""
        done = None
        if self._out is not None and (self._part != part or self._bytes + len(data) > self._roll):
            following = self._number + 1 if self._part == part else 0
            done = self.end()
            self._begin(part, following)
        elif self._out is None:
            self._begin(part, 0)
        self._out.write(data)
        self._sum.update(data)
        self._bytes += len(data)
        self._records += 1
        return done


def _parts(sizes: DataFrame, part_bytes: int):
    """(number of parts, function from page_id to part): ranges of page_id of about ``part_bytes``.

    A tree of ranges: the root has ``_BUCKETS`` equal ones, and a range that is too heavy is cut into
    ``_FAN`` equal ones until it is light or one id wide.  The tree depends on the rows alone.
    """
    ends = sizes.agg(F.min("page_id").alias("a"), F.max("page_id").alias("b"), F.sum(F.col("n") + 512).alias("n")).first()
    if ends["a"] is None:
        return 1, lambda c: F.lit(0)
    part_bytes = max(part_bytes, int(ends["n"]) // _MOST_PARTS)
    low, step, base = [int(ends["a"])], [max(1, -(-(int(ends["b"]) - int(ends["a"]) + 1) // _BUCKETS))], [0]
    entry: list[int] = [0] * _BUCKETS  # a part, or -1 - (number of the child)
    filled = [0] * _BUCKETS

    def tree():
        lows, steps, bases, table = long_array(low), long_array(step), long_array(base), long_array(entry)

        def place(c, found):
            node = (-1 - found).cast("int")
            return (F.get(bases, node) + F.call_function("div", c - F.get(lows, node), F.get(steps, node))).cast("int")

        def walk(c, levels: int):
            start = F.lit(-1).cast("bigint")
            if not levels:
                return start
            return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), start, lambda found, _: F.when(found < 0, F.get(table, place(c, found))).otherwise(found))

        return walk, place

    def locate(c, depth: int):
        """The place in ``entry`` of an id, on the last level."""
        walk, place = tree()
        return F.get(F.transform(F.array(walk(c, depth - 1)), lambda found: F.when(found < 0, place(c, found))), F.lit(0))

    depth, fresh = 1, {0}
    while fresh:
        # at most one row for each range of the last level, and there are at most so many heavy ranges as parts
        for row in sizes.groupBy(locate(F.col("page_id"), depth).alias("at")).agg(F.sum(F.col("n") + 512).alias("n")).where("at is not null").toLocalIterator():
            filled[row["at"]] = int(row["n"])
        heavy = []
        for node in fresh:
            width = _BUCKETS if node == 0 else _FAN
            heavy += [(node, k) for k in range(width) if filled[base[node] + k] > part_bytes and step[node] > 1]
        fresh = set()
        for node, k in heavy:
            child = len(low)
            low.append(low[node] + k * step[node])
            step.append(max(1, -(-step[node] // _FAN)))
            base.append(len(entry))
            entry[base[node] + k] = -1 - child
            entry.extend([0] * _FAN)
            filled.extend([0] * _FAN)
            fresh.add(child)
        depth += bool(fresh)
    part = held = 0

    def number(node: int) -> None:
        nonlocal part, held
        for k in range(_BUCKETS if node == 0 else _FAN):
            at = base[node] + k
            if entry[at] < 0:
                number(-1 - entry[at])
                continue
            if held and held + filled[at] > part_bytes:
                part, held = part + 1, 0
            held += filled[at]
            entry[at] = part

    number(0)
    walk, _ = tree()
    return part + 1, lambda c: walk(c, depth).cast("int")


def write(pages: DataFrame, root: str, part_bytes: int = PART_BYTES, roll_bytes: int = ROLL_BYTES, least_bytes: int = LEAST_BYTES) -> list[dict]:
    """Write ``page_id, url, html`` under ``root``; the manifest's entries."""
    spark = pages.sparkSession
    fs, path = pafs.FileSystem.from_uri(root)
    fs.create_dir(path, recursive=True)
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    digests = rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("bigint").alias("n"))
    first = digests.where(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    first = stored(first, "warc-first")
    # a payload that many records have would be one key of the join
    rows_ = digests.count()
    hot = {r["digest"]: r["first"] for r in first.where(F.col("copies") >= max(1000, math.ceil(rows_ * _HOT))).collect()}
    is_hot = F.col("digest").isin(list(hot)) if hot else F.lit(False)
    revisits = digests.where(~is_hot).join(first.drop("copies"), ["digest", "n"])
    if hot:
        known = F.create_map(*[F.lit(x) for kv in hot.items() for x in kv])
        revisits = revisits.unionByName(digests.where(is_hot).withColumn("first", F.element_at(known, F.col("digest"))))
    # revisits alone: narrow rows travel beside the payloads
    revisits = revisits.where("first <> page_id").select("page_id", "digest", "first").distinct()
    count, part = _parts(digests, part_bytes)
    tasks = max(count, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if count < tasks:  # a small archive is still written by all cores
        count, part = _parts(digests, max(1 << 20, part_bytes * count // tasks))
    nothing = F.lit(None)
    notes = revisits.select("page_id", "digest", F.lit(0).alias("kind"), F.col("first"), nothing.cast("string").alias("url"), nothing.cast("binary").alias("payload"))
    bodies = rows.select("page_id", F.sha1("payload").alias("digest"), F.lit(1).alias("kind"), nothing.cast("bigint").alias("first"), "url", "payload")
    parted = notes.union(bodies).withColumn("part", part(F.col("page_id"))).repartitionById(count, F.col("part"))
    lined = parted.sortWithinPartitions("part", "page_id", "digest", "kind", "url", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(root, roll_bytes)
        note: dict = {}
        last, times = None, 0
        done: list[dict] = []
        for batch in pieces(batches):
            for row in batch.to_pylist():
                own = (row["page_id"], row["digest"])
                if row["kind"] == 0:
                    note = {own: row["first"]}
                    continue
                times = times + 1 if own == last else 0
                before, last = last, own
                refers_to = note.get(own)
                if times and refers_to is None and len(row["payload"]) >= least_bytes:
                    refers_to = row["page_id"]
                # the first record of a page has the plain id, to which revisits refer
                again = f":{row['digest']}:{times}" if times or (before and before[0] == row["page_id"]) else ""
                ended = files.add(row["part"], record(row["page_id"], row["url"], row["payload"], refers_to, again))
                if ended:
                    done.append(ended)
        ended = files.end()
        if ended:
            done.append(ended)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    entries = sorted((r.asDict() for r in lined.mapInArrow(run, "file string, records bigint, bytes bigint, sha256 string").collect()), key=lambda e: e["file"])
    discard(first)
    temporary = f"{path}/.manifest-{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary) as out:
        out.write(json.dumps(entries, indent=0).encode())
    fs.move(temporary, f"{path}/{_MANIFEST}")
    return entries


def members(stream: io.RawIOBase) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    unpack, out, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(1 << 18)
        if not data:
            if out:
                raise ValueError("the archive ends inside a record")
            return
        out.append(unpack.decompress(data))
        rest = unpack.unused_data
        if unpack.eof:
            yield b"".join(out)
            unpack, out = zlib.decompressobj(31), []


def parse(member: bytes) -> dict:
    """Fields of one record; a digest that doesn't fit raises."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"block digest of page {fields['Page-Id']}")
    if kind == "response" and (len(payload) != full or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload digest of page {fields['Page-Id']}")
    refers_to = fields.get("Refers-To-Page-Id")
    return {
        "page_id": int(fields["Page-Id"]),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": full,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": int(refers_to) if refers_to else None,
        "payload": payload if kind == "response" else None,
    }


_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def read(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest lists; ``payload`` is null for revisits."""
    fs, path = pafs.FileSystem.from_uri(root)
    with fs.open_input_stream(f"{path}/{_MANIFEST}") as lines:
        entries = json.loads(lines.read())
    schema = _SCHEMA if payloads else _SCHEMA.remove(6)
    listed = [(e["file"], i) for i, e in enumerate(entries)]
    names = spark.createDataFrame(listed, "file string, i int").repartitionById(max(1, len(entries)), F.col("i")).select("file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(root)
        for batch in pieces(batches):
            for name in batch.column(0).to_pylist():
                held, size = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for member in members(stream):
                        held.append(parse(member))
                        size += len(member)
                        if size > 1 << 22 or len(held) >= 1024:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    ddl = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return names.mapInArrow(run, ddl + (", payload binary" if payloads else ""))
