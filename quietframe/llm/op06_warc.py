"""WARC archives, written and read back with boundary-chain verification.

Readers take byte ranges of the archives.  A first pass emits, for each place where
the record magic stands, the offset of the successor that its header claims; chains
inside a range are contracted to the offset at which they leave it.  Pointer jumping
from the start of each file then keeps the reachable entries only, so magic inside a
payload is rejected, and a second pass parses each range from its entry.

Contract for odd rows: null html is an empty payload; a null page_id is written as
an empty WARC-Page-ID and read back as null, and is never what others revisit;
of repeated rows with one page_id and payload each has a record (one page_id: all
are responses, as the smallest id is its own); extra columns are not read; an empty
table gives no files and no rows."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import default_partitions, materialize, open_fs, pick, read_table, salted_lookup, scratch_path

MAGIC = b"WARC/1.1\r\n"
#: Bytes of an archive that one reader task takes.
RANGE = 4 << 20
#: Payloads of at least so many bytes are deduplicated.
LEAST = 0
HEAD = 1 << 16


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit has the digest and size of its payload in the header, but no block."""
    block = b"" if refers_to is not None else payload
    head = [
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        "WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url or ""),
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head.insert(2, f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>")
        head.insert(3, f"WARC-Refers-To-Page-ID: {refers_to}")
        head.insert(4, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, refers_to) of the pages whose payload a smaller page_id has."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pick(pages, "page_id", "html").where(F.col("page_id").isNotNull() & (F.octet_length(body) >= least)).select("page_id", F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("n"))
    first = rows.groupBy("digest", "n").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    return salted_lookup(rows, ["digest", "n"], "page_id", first).where("refers_to < page_id").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, out_dir: str, least: int = LEAST) -> DataFrame:
    """Write `pages` (page_id, url, html); the manifest: path, bytes, records."""
    again = materialize(revisits(pages, least), "revisits")  # its size is known: Spark broadcasts it only where it is small
    p = pick(pages, "page_id", "url", "html")
    p = p.withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary"))).join(again, ["page_id", "digest"], "left").drop("digest")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, size, n = f"{out_dir}/pages-{uuid.uuid4().hex}.warc", None, 0, 0
        f, inner = open_fs(path)
        for b in batches:
            if out is None and b.num_rows:
                f.create_dir(inner.rpartition("/")[0], recursive=True)
                out = f.open_output_stream(inner)
            for page_id, url, html, ref in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                raw = record(page_id, url, (html or "").encode(), ref)
                out.write(raw)
                size, n = size + len(raw), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})

    return materialize(p.mapInArrow(write, "path string, bytes long, records long"), "warc-manifest")


def parse_head(raw: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields and length of a header that starts `raw`; None if it is none."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(MAGIC) or end < 0:
        return None
    fields: dict[str, str] = {}
    for line in raw[len(MAGIC) : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not fields.get("content-length", "").isdigit():
        return None
    return fields, end + 4


def _head_at(file, at: int, size: int, near: bytes, near_at: int):
    """The header at an offset, read on where the bytes in hand end before it does: to its
    blank line, however far that is, as a record ends with one."""
    raw = near[at - near_at : at - near_at + HEAD]
    n = HEAD
    while b"\r\n\r\n" not in raw and at + len(raw) < size:
        raw = file.read_at(min(n, size - at), at)
        n *= 4
    return parse_head(raw)


def ranges(manifest: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    r = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / range_bytes).cast("long")))).alias("part"))
    return r.repartition(default_partitions(manifest.sparkSession), "path", "part")


def candidates(parts: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """For each record magic: path, part, at, next (claimed successor), out (where the
    chain from it leaves the range; -1 if it breaks inside)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, part in zip(*(b.column(c).to_pylist() for c in ("path", "bytes", "part")), strict=True):
                lo, hi = part * range_bytes, min((part + 1) * range_bytes, size)
                f, inner = open_fs(path)
                with f.open_input_file(inner) as file:
                    raw = file.read_at(min(hi + len(MAGIC) - 1, size) - lo, lo)
                    found: list[tuple[int, int]] = []
                    k = raw.find(MAGIC)
                    while 0 <= k < hi - lo:
                        if got := _head_at(file, lo + k, size, raw, lo):
                            found.append((lo + k, lo + k + got[1] + int(got[0]["content-length"]) + 4))
                        k = raw.find(MAGIC, k + 1)
                leaves: dict[int, int] = {}
                for at, nxt in reversed(found):
                    leaves[at] = nxt if hi <= nxt <= size else leaves.get(nxt, -1)
                if found:
                    yield pa.RecordBatch.from_pydict({"path": [path] * len(found), "part": [part] * len(found), "at": [x[0] for x in found], "next": [x[1] for x in found], "out": [leaves[x[0]] for x in found]})

    return parts.mapInArrow(run, "path string, part long, at long, next long, out long")


def reachable(links: DataFrame, rounds: int) -> DataFrame:
    """(path, at) of the chain entries that pointer jumping finds from offset 0.
    `links` has path, at, out; `rounds`: 2 ** rounds entries a file at most."""
    jump = links.select("path", "at", "out").where("out >= 0")
    found = links.select("path").distinct().select("path", F.lit(0).cast("long").alias("at"))
    for k in range(rounds):
        reached = found.join(jump, ["path", "at"]).select("path", F.col("out").alias("at"))
        found = materialize(found.union(reached).distinct(), "warc-reached")
        if k + 1 < rounds:
            far = jump.select("path", F.col("at").alias("out"), F.col("out").alias("to"))
            jump = materialize(jump.join(far, ["path", "out"]).select("path", "at", F.col("to").alias("out")), "warc-jump")
    return found


def read_archives(manifest: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """Reachable records: path, at, page_id, url, record_type, payload_digest,
    payload_bytes, refers_to, html (null for revisits)."""
    parts = ranges(manifest, range_bytes)
    links = materialize(candidates(parts, range_bytes), "warc-links")
    most = manifest.agg(F.max(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    entries = reachable(links, int(most).bit_length())
    # A record may span whole ranges; then these have no entry.
    todo = entries.withColumn("part", F.floor(F.col("at") / range_bytes).cast("long")).join(manifest.select("path", "bytes"), "path").where("at < bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("path", "at", "page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "html")
        for b in batches:
            for path, size, part, at in zip(*(b.column(c).to_pylist() for c in ("path", "bytes", "part", "at")), strict=True):
                f, inner = open_fs(path)
                rows, held = [], 0
                with f.open_input_file(inner) as file:
                    hi = min((part + 1) * range_bytes, size)
                    raw = file.read_at(hi - at, at)
                    base = at
                    while at < hi:
                        got = _head_at(file, at, size, raw, base)
                        if got is None:
                            raise ValueError(f"{path}: no record at {at}")
                        head, n = got
                        length = int(head["content-length"])
                        payload = raw[at + n - base : at + n + length - base]
                        if len(payload) < length:
                            payload = file.read_at(length, at + n)
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        kind = head["warc-type"]
                        if kind == "response" and base32_sha1(payload) != digest:
                            raise ValueError(f"{path}: damaged record at {at}")
                        ref = head.get("warc-refers-to-page-id")
                        rows.append((path, at, int(head["warc-page-id"]) if head["warc-page-id"] else None, head["warc-target-uri"], kind, digest, int(head["warc-payload-length"]), int(ref) if ref else None, payload.decode() if kind == "response" else None))
                        held += length
                        at += n + length + 4
                        if held > 8 << 20:
                            yield _batch(rows, names)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    spread = todo.repartition(default_partitions(manifest.sparkSession), "path", "part")
    return spread.mapInArrow(run, "path string, at long, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, html string")


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    long = ("at", "page_id", "payload_bytes", "refers_to")
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in long else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=list(names))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    back = read_archives(write_archives(pages, scratch_path(spark, "warc")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


QUERIES = {"op6_warc": op6_warc}
ORACLE: dict[str, str] = {}
