"""Deterministic sharded WARC archives (operator 13).

Records are put in the order of (id, digest of URL and payload), cut into
shards of about ``shard_bytes`` of payload, and each shard is written by one
task as files that roll when their compressed size passes ``roll_bytes``. Of
records with equal payloads the first in that order is a ``response``; the
others are ``revisit`` records that refer to it and hold no payload. Headers,
lengths, digests and record ids are made anew from the records themselves:
equal input gives equal archives, byte by byte, whatever its partitioning.

* Range sort: the shards' bounds are quantiles of a sample chosen by a hash of
  the record's key, not by chance or by place. The bounds (one string a shard,
  ``MAX_SHARDS`` at most) are all the driver holds. A key that alone is larger
  than a shard, that is one record repeated, gets several shards.
* Payloads are compressed where they are read, and moved once: the verdicts on
  repeated payloads (found on slim rows of key, size and digest) take the same
  way through the exchange and sort just before their record; the writer
  merges the two. Of a heavy key each task sends one payload, whatever the
  number of its repeats; those come as counts, one for each of its shards.
* Commit: tasks write under temporary names, one per attempt; what a task
  wrote is known by the rows that it returns, so those of lost or repeated
  attempts never count. Then the files get their names (again by tasks; doing
  it twice does no harm), and last the manifest appears: an archive without a
  manifest doesn't exist for the reader.
* Every record is a gzip member of its own, and the manifest lists where runs
  of members start; the reader's tasks start there, so one large file is read
  by many tasks.

Tasks write and read through ``pyarrow.fs``, which takes the folder's URI
(``file:``, ``hdfs:``, ``s3:``, ``gs:``); the folder must be shared, like the
default, the one in ``spark.checkpoint.dir``.

Defined results: a NULL payload is an empty one, and empty payloads are equal
payloads; a NULL URL has no target header; control characters and blanks of a
URL are percent-encoded in headers; NULL ids come last and are read back as
NULL; of repeated rows one is the response at most and the others revisit it;
an empty table gives an archive without files; a payload of any length is one
record (it must fit in a row, as it did before).
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptally.llm.common import checkpoint_dir

SHARD_BYTES = 32 << 20
ROLL_BYTES = 8 << 20
SEGMENT_BYTES = 2 << 20
MAX_SHARDS = 10_000
SAMPLE_A_SHARD = 32
OVERHEAD = 512
"""Bytes that a record counts besides its payload."""
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the format: WARC 1.1 field names, content types and the revisit profile.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE_TYPE = "application/http; msgtype=response"
ID, REFERS_ID = "X-Page-Id", "X-Refers-To-Page-Id"
KINDS = {"response", "revisit"}

_FILES = ("shard int, seq int, name string, temp string, records long, bytes long, sha256 string, "
                              "segments array<struct<start: long, length: long>>")
_FILES_ARROW = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("temp", pa.string()), ("records", pa.int64()),
                          ("bytes", pa.int64()), ("sha256", pa.string()),
                          ("segments", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324  the format's digest


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record_id(key: str, more: int | str) -> str:
    """Of a key's records the first is number 0, which others may refer to."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{key}:{more}'.encode()).digest()[:16], version=5)}>"


def record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    """One record: version, named fields without empty ones, length and digest of the block, the block."""
    head = {"WARC-Type": kind, **fields, "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"{VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def member(data: bytes) -> bytes:
    """One gzip member without name or time, so that equal records are equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if re.match(r"[a-z][a-z0-9+.-]*:", uri) else f"file://{uri}")


class _Shard:
    """Writes the files of one shard."""

    def __init__(self, uri: str, temp: str, shard: int, roll: int, segment: int) -> None:
        (self.fs, self.path), self.temp, self.shard, self.roll, self.segment = _folder(uri), temp, shard, roll, segment
        self.rows: list[dict] = []
        self.out = None

    def open(self) -> None:
        seq = len(self.rows)
        name = f"part-{self.shard:06d}-{seq:06d}.warc.gz"
        self.row = {"shard": self.shard, "seq": seq, "name": name, "temp": f"{self.temp}/{uuid.uuid4().hex}-{name}", "records": 0, "bytes": 0,
                    "segments": [{"start": 0, "length": 0}]}
        self.hash = hashlib.sha256()
        self.fs.create_dir(f"{self.path}/{self.temp}", recursive=True)
        self.out = self.fs.open_output_stream(f"{self.path}/{self.row['temp']}", compression=None)
        info = b"format: WARC File Format 1.1\r\n"
        self.put(member(record("warcinfo", {"WARC-Record-ID": _record_id(name, "info"), "WARC-Date": DATE, "WARC-Filename": name,
                                            "Content-Type": "application/warc-fields"}, info)))

    def put(self, data: bytes) -> None:
        if self.row["segments"][-1]["length"] >= self.segment:
            self.row["segments"].append({"start": self.row["bytes"], "length": 0})
        self.out.write(data)
        self.hash.update(data)
        self.row["bytes"] += len(data)
        self.row["segments"][-1]["length"] += len(data)

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.open()
        self.put(data)
        self.row["records"] += 1
        if self.row["bytes"] >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append(self.row | {"sha256": self.hash.hexdigest()})
            self.out = None


_MEMBERS = "_k string, _id long, _url string, _bytes long, _digest binary, _member binary"
_MEMBERS_ARROW = pa.schema([("_k", pa.string()), ("_id", pa.int64()), ("_url", pa.string()), ("_bytes", pa.int64()), ("_digest", pa.binary()),
                            ("_member", pa.binary())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for lo in range(0, b.num_rows, 64):  # few payloads are Python objects at a time
            yield from b.slice(lo, 64).to_pylist()


def _fields(r: dict, nth: int, date: str, **more: str | None) -> dict[str, str | None]:
    return {"WARC-Record-ID": _record_id(r["_k"], nth), "WARC-Date": date, "WARC-Target-URI": None if r["_url"] is None else _uri(r["_url"]),
            ID: None if r["_id"] is None else str(r["_id"]), **more,
            "WARC-Payload-Digest": f"sha1:{base64.b32encode(r['_digest']).decode()}", "Content-Type": RESPONSE_TYPE}


def _response(r: dict, payload: bytes, date: str) -> bytes:
    return member(record("response", _fields(r, 0, date), _http(len(payload)) + payload))


def _revisit(r: dict, first: dict, nth: int, date: str) -> bytes:
    refers = {"WARC-Profile": PROFILE, "WARC-Refers-To": _record_id(first["k"], 0),
              "WARC-Refers-To-Target-URI": None if first["url"] is None else _uri(first["url"]), "WARC-Refers-To-Date": date,
              REFERS_ID: None if first["id"] is None else str(first["id"])}
    return member(record("revisit", _fields(r, nth, date, **refers), _http(r["_bytes"])))


def _pack_members(date: str, heavy: frozenset[str]):  # noqa: ANN202
    """Every row as the compressed response that it is unless it repeats a
    payload; of a heavy key's rows the first of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, seen = [], 0, set()
        for r in _rows(batches):
            if r["_k"] in heavy:
                if r["_k"] in seen:
                    continue
                seen.add(r["_k"])
            payload = r.pop("_payload")
            out.append(r | {"_member": _response(r, payload, date)})
            held += len(out[-1]["_member"]) + 500
            if held >= 2 << 20:
                yield pa.RecordBatch.from_pylist(out, _MEMBERS_ARROW)
                out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, _MEMBERS_ARROW)

    return run


VERDICT, RECORD, REPEATS = 0, 1, 2
"""Kinds of rows that meet in a shard, in the order in which they come for a key."""


def _write(uri: str, temp: str, roll: int, segment: int, date: str, heavy: frozenset[str]):  # noqa: ANN202
    """Rows in the order of (shard, key, kind). A key's first record is the
    response unless a verdict says what it repeats; a heavy key's other records
    come as a count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, done, last, nth, verdict = None, [], None, 0, None
        for r in _rows(batches):
            if shard is None or shard.shard != r["_shard"]:
                if shard is not None:
                    shard.close()
                    done += shard.rows
                shard, last = _Shard(uri, temp, r["_shard"], roll, segment), None
            if last != r["_k"]:
                last, nth, verdict = r["_k"], 0, None
            own = {"k": r["_k"], "id": r["_id"], "url": r["_url"]}
            if r["_kind"] == VERDICT:
                verdict = r["_refers"]
            elif r["_kind"] == REPEATS:
                first = r["_refers"]
                for i in range(r["_from"], r["_from"] + r["_n"]):
                    if i or first:  # else it is the response
                        shard.add(_revisit(r, first or own, i, date))
            else:
                if not nth and not verdict:
                    shard.add(r["_member"])
                elif r["_k"] not in heavy:
                    shard.add(_revisit(r, verdict or own, nth, date))
                nth += 1
        if shard is not None:
            shard.close()
            done += shard.rows
        yield pa.RecordBatch.from_pylist(done, _FILES_ARROW)

    return run


def _publish(uri: str):  # noqa: ANN202
    """Gives the files of finished tasks their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _folder(uri)
        for b in batches:
            for r in b.to_pylist():
                there = fs.get_file_info(f"{path}/{r['temp']}").type != pafs.FileType.NotFound
                if there:
                    fs.move(f"{path}/{r['temp']}", f"{path}/{r['name']}")
                elif fs.get_file_info(f"{path}/{r['name']}").size != r["bytes"]:
                    raise OSError(f"{r['name']}: neither its temporary file nor the whole file is there")
            yield b

    return run


def _bounds(keys: DataFrame, shard_bytes: int) -> tuple[list[str], list[int], list[int], int]:
    """(first key of each range, its first shard, its number of shards), and a shard's target size."""
    n, size = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    shards = max(1, min(MAX_SHARDS, -(-size // shard_bytes)))
    target = max(1, -(-size // shards))
    every = max(1, n // (shards * SAMPLE_A_SHARD))
    # SAMPLE_A_SHARD keys a shard, by chance a few more
    rows = sorted(map(tuple, keys.where(F.pmod(F.xxhash64("_k"), F.lit(every)) == 0).select("_k", "_size").collect()))
    total, seen, bounds = sum(s for _, s in rows), 0, [""]
    for k, s in rows:
        if seen * shards >= len(bounds) * max(total, 1) and k > bounds[-1]:
            bounds.append(k)
        seen += s
    # one record repeated until it fills more than two shards: fewer than there are shards
    heavy = dict(map(tuple, keys.where(F.col("_size") > 2 * target).where("_n > 1").select("_k", "_size").collect()))
    bounds = sorted({*bounds, *heavy, *(k + "~" for k in heavy)})
    pieces = [-(-heavy[k] // target) if k in heavy else 1 for k in bounds]
    return bounds, [0, *accumulate(pieces)][:-1], pieces, target


def write_warc(df: DataFrame, key: Column, url: Column, payload: Column, uri: str | None = None, shard_bytes: int = SHARD_BYTES,
               roll_bytes: int = ROLL_BYTES, segment_bytes: int = SEGMENT_BYTES, date: str = DATE) -> str:
    """Writes an archive of a record per row into the new folder ``uri``
    (default: one in the shared checkpoint folder) and returns the folder.
    ``key`` is integral; ``payload`` a string (UTF-8) or binary. ``df`` is read
    twice and must give the same rows both times."""
    spark = df.sparkSession
    uri = (uri or f"{checkpoint_dir(spark).rstrip('/')}/warc/{uuid.uuid4().hex[:12]}").rstrip("/")
    if not re.match(r"[a-z][a-z0-9+.-]*:", uri):
        uri = f"file://{uri}"
    temp = "_temporary-" + uuid.uuid4().hex[:12]
    body = F.coalesce(payload.cast("binary"), F.lit("").cast("binary"))
    df = df.select(key.cast("long").alias("_id"), url.cast("string").alias("_url"), body.alias("_payload"))
    df = df.withColumn("_sha", F.unhex(F.sha2("_payload", 256)))
    # offset binary: hex digits in the order of the ids, NULL after all of them
    order = F.coalesce(F.lpad(F.hex(F.col("_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit("~"))
    name = F.coalesce(F.concat(F.lit("u"), "_url"), F.lit("-")).cast("binary")
    df = df.withColumns({"_k": F.concat(order, F.lit(":"), F.left(F.sha2(F.concat("_sha", name), 256), F.lit(40))),
                         "_bytes": F.octet_length("_payload").cast("long"), "_digest": F.unhex(F.sha1("_payload"))})
    # a row per different record: repeats are counted in each task before they are exchanged
    of_key = ["_k", "_id", "_url", "_sha", "_bytes", "_digest"]
    keys = df.groupBy(*of_key).agg(F.count(F.lit(1)).alias("_n")).withColumn("_size", (F.col("_bytes") + OVERHEAD) * F.col("_n"))
    keys.write.option("compression", "zstd").parquet(f"{uri}/{temp}/keys")
    keys = spark.read.parquet(f"{uri}/{temp}/keys")
    bounds, firsts, pieces, target = _bounds(keys, shard_bytes)
    shards, heavy = firsts[-1] + pieces[-1], frozenset(k for k, p in zip(bounds, pieces, strict=True) if p > 1)

    @F.pandas_udf("int")
    def shard_of(k: pd.Series, piece: pd.Series) -> pd.Series:
        return pd.Series([firsts[bisect.bisect_right(bounds, x) - 1] + p for x, p in zip(k, piece, strict=True)], dtype="int32")

    first = keys.groupBy("_sha").agg(F.min(F.struct("_k", "_id", "_url")).alias("_f"), F.count(F.lit(1)).alias("_m")).where("_m > 1")
    refers = F.struct(F.col("_f._k").alias("k"), F.col("_f._id").alias("id"), F.col("_f._url").alias("url"))
    verdicts = keys.join(first, "_sha").where("_k <> _f._k").select("_k", refers.alias("_refers"))
    many = keys.where((F.col("_size") > 2 * target) & (F.col("_n") > 1)).join(verdicts, "_k", "left")
    cut = F.expr(f"(_size + {target}L - 1) div {target}L")
    many = many.withColumn("_pieces", cut).withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1)))
    many = many.select("_k", "_id", "_url", "_bytes", "_digest", "_refers", "_piece", F.expr("_n * _piece div _pieces").alias("_from"),
                       F.expr("_n * (_piece + 1) div _pieces - _n * _piece div _pieces").alias("_n"))
    records = df.select("_k", "_id", "_url", "_bytes", "_digest", "_payload").mapInArrow(_pack_members(date, heavy), _MEMBERS)
    rows = (records.withColumn("_kind", F.lit(RECORD)).unionByName(verdicts.withColumn("_kind", F.lit(VERDICT)), allowMissingColumns=True)
            .unionByName(many.withColumn("_kind", F.lit(REPEATS)), allowMissingColumns=True))
    rows = rows.withColumn("_shard", shard_of("_k", F.coalesce("_piece", F.lit(0).cast("long")))).repartitionById(shards, F.col("_shard"))
    files = rows.sortWithinPartitions("_shard", "_k", "_kind").mapInArrow(_write(uri, temp, roll_bytes, segment_bytes, date, heavy), _FILES)
    files.write.parquet(f"{uri}/{temp}/files")
    files = spark.read.schema(_FILES).parquet(f"{uri}/{temp}/files")
    files.repartition(max(1, min(shards, 200)), "shard", "seq").mapInArrow(_publish(uri), _FILES).drop("temp").write.parquet(f"{uri}/manifest")
    fs, path = _folder(uri)
    fs.delete_dir(f"{path}/{temp}")
    return uri


# Reading

def _members(f, start: int, length: int) -> Iterator[bytes]:  # noqa: ANN001
    """The decompressed gzip members that start in a run of bytes."""
    f.seek(start)
    z, out, left, buffer = zlib.decompressobj(31), [], length, b""
    while left or buffer:
        if not buffer:
            buffer = f.read(min(left, 1 << 16))
            if not buffer:
                raise EOFError("the archive is shorter than its manifest says")
            left -= len(buffer)
        out.append(z.decompress(buffer))
        buffer = z.unused_data
        if z.eof:
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []
    if out:
        raise EOFError("the last member is cut")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, block) of one record, its length and block digest checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if f"sha1:{base32_sha1(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"{fields.get('WARC-Record-ID')}: the block doesn't have its digest")
    return fields, block


_RECORDS = ("file string, record_id string, record_type string, url string, key long, refers_to long, refers_to_id string, "
                                "payload_bytes long, payload_digest string, payload binary")
_RECORDS_ARROW = pa.schema([("file", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("key", pa.int64()),
                            ("refers_to", pa.int64()), ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("payload", pa.binary())])


def _read(uri: str, with_payload: bool):  # noqa: ANN202
    def rows(name: str, f, start: int, length: int) -> Iterator[dict]:  # noqa: ANN001
        for data in _members(f, start, length):
            fields, block = parse(data)
            if fields["WARC-Type"] not in KINDS:
                continue
            head, _, payload = block.partition(b"\r\n\r\n")
            size = int(re.search(rb"(?i)\r\nContent-Length: *(\d+)", head)[1])
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            full = fields["WARC-Type"] == "response"
            if full and (len(payload) != size or base32_sha1(payload) != digest):
                raise ValueError(f"{fields['WARC-Record-ID']}: the payload doesn't have its length or digest")
            number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
            yield {"file": name, "record_id": fields["WARC-Record-ID"], "record_type": fields["WARC-Type"], "url": fields.get("WARC-Target-URI"),
                   "key": number(ID), "refers_to": number(REFERS_ID), "refers_to_id": fields.get("WARC-Refers-To"), "payload_bytes": size,
                   "payload_digest": digest, "payload": payload if with_payload and full else None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _folder(uri)
        for b in batches:
            for r in b.to_pylist():
                out, held = [], 0
                with fs.open_input_file(f"{path}/{r['name']}") as f:
                    for x in rows(r["name"], f, r["start"], r["length"]):
                        out.append(x)
                        held += len(x["payload"] or b"") + 200
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, _RECORDS_ARROW)
                            out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, _RECORDS_ARROW)

    return run


def read_warc(spark: SparkSession, uri: str, payload: bool = True) -> DataFrame:
    """The response and revisit records of an archive, one row each: ``file``,
    ``record_id``, ``record_type``, ``url``, ``key``, ``refers_to`` (key of the
    response that a revisit refers to), ``refers_to_id``, ``payload_bytes`` and
    ``payload_digest`` of the full payload, and the ``payload`` of responses.
    Lengths and digests are checked on the way."""
    files = spark.read.parquet(f"{uri}/manifest")
    runs = files.select("name", F.explode("segments").alias("s")).select("name", "s.start", "s.length")
    # a task per run of members, as long as that isn't far more than there are cores
    tasks = min(max(1, int(files.agg(F.coalesce(F.sum(F.size("segments")), F.lit(1))).first()[0])), 20 * spark.sparkContext.defaultParallelism)
    return runs.repartition(tasks, "name", "start").mapInArrow(_read(uri, payload), _RECORDS)
