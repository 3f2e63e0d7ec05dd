"""WARC archives: writing pages, and reading archives back by boundary-chain verification.

Writing.  One record a page, in files of about ROLL bytes, written by Spark into any file system it knows.  Of pages
with equal payloads of at least `dedup_from` bytes the one with the largest id is the response, the others revisit it;
smaller payloads are all responses.  A revisit holds the HTTP head alone, and names the response and the payload's
digest and length.  A null html is an empty payload; rows repeated with the id that stays are all responses.

Reading.  Spark splits the files into ranges at the magic of a record (WARC/1.), by its text source, so a task reads a
range and no file is one task's work.  Each piece from one magic to the next is a candidate: the task tells its place
in the range, where its record would end (head, content length, two line ends), and the payload's digest where the
piece is the whole record.  Places in the file come from the sizes of the ranges before.  A magic inside a payload gives
such a candidate as well.  Candidates whose successor is the next one are linked in runs; the runs of all files are
resolved by pointer jumping from offset 0: each round doubles the links followed, as joins of rows.  Only candidates
that the chain reaches are records; a chain that ends before its file does raises.  Records that hold a magic are put
together from their pieces by a second scan.  Each payload's digest (hex or base32) is checked against its head.

Heads of WARC/1.0 and 1.1 are read, field names in any case; .gz files are read whole, as gzip has no ranges.  Records of
other types are passed over; a revisit's payload length is what X-Payload-Length says, else null.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import NO_ID, Cuts, lookup_join, shared_dir

ROLL, DEDUP_FROM = 16 << 20, 1000
#: Revisits up to which they are broadcast while writing; beyond, they are joined by shuffle.
BROADCAST_REVISITS = 500_000
#: What all records begin with; pieces are what stands between.
MAGIC = "WARC/1."
_FIELD = re.compile(rb"\r\n([A-Za-z-]+):[ \t]*([^\r\n]*)")
_EOL = "\r\n"


def records(pages: DataFrame, id_col: str, url_col: str, html_col: str, dedup_from: int) -> DataFrame:
    """Each page's id, payload length and its record without the two line ends that close it."""
    spark = pages.sparkSession
    cuts = Cuts(spark)
    base = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    base = base.withColumn("n", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = base.where(F.col("n") >= dedup_from).select("_id", "digest", "n")
    groups = large.groupBy("digest", "n").agg(F.max("_id").alias("refers"), F.count(F.lit(1)).alias("size")).where("size > 1")
    # all but the largest of each group revisit it; the groups are joined by digest, hot ones apart
    groups = cuts.cut(groups.select("digest", "refers", "size"))
    revisits = lookup_join(large.select("_id", "digest"), groups, "digest", "size").where(F.col("_id") < F.col("refers")).select("_id", "digest", "refers").distinct()
    revisits = cuts.cut(revisits)
    small = F.broadcast if revisits.count() <= BROADCAST_REVISITS else (lambda x: x)
    rows = base.join(small(revisits), ["_id", "digest"], "left")
    again = F.col("refers").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.when(F.col(c) == NO_ID, F.lit("null")).otherwise(F.col(c).cast("string")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), F.col("n").cast("string"), F.lit(_EOL + _EOL))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html")))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20\\x7F]", "%20")
    head = F.concat(
        F.lit(f"WARC/1.1{_EOL}WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{_EOL}WARC-Record-ID: "), name("_id"),
        F.lit(f"{_EOL}WARC-Date: 1970-01-01T00:00:00Z{_EOL}WARC-Target-URI: "), uri,
        F.lit(f"{_EOL}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit(f"{_EOL}X-Payload-Length: "), F.col("n").cast("string"),
        F.when(again, F.concat(F.lit(f"{_EOL}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_EOL}WARC-Refers-To: "), name("refers"))).otherwise(F.lit("")),
        F.lit(f"{_EOL}Content-Type: application/http; msgtype=response{_EOL}Content-Length: "), F.octet_length(block).cast("string"), F.lit(_EOL + _EOL),
    )
    return rows.select("_id", "n", F.concat(head, block).alias("record"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", dedup_from: int = DEDUP_FROM) -> None:
    rows = records(pages, id_col, url_col, html_col, dedup_from)
    size = pages.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(html_col)).alias("b")).first()
    per_file = max(1, int(ROLL * size["n"] / max(1, (size["b"] or 0) + 600 * size["n"])))
    rows.select("record").write.option("lineSep", _EOL + _EOL).option("maxRecordsPerFile", per_file).text(path)


def _name(x: bytes | None) -> int | None:
    x = (x or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(x) if re.fullmatch(rb"-?\d{1,19}", x) else None


def head(piece: bytes) -> tuple[dict[bytes, bytes], int, int] | None:
    """Fields of a record's head, the size of the head and that of the record with its two line ends; None: no head.

    A piece begins behind the magic, sizes count from the magic on.
    """
    end = piece.find(b"\r\n\r\n")
    if end < 0 or piece[:3] not in (b"0\r\n", b"1\r\n"):
        return None
    fields = {k.lower(): v for k, v in _FIELD.findall(piece[: end + 2])}
    size = fields.get(b"content-length", b"").strip()
    if not re.fullmatch(rb"\d{1,18}", size):
        return None
    body = len(MAGIC) + end + 4
    return fields, body, body + int(size) + 4


def record(fields: dict[bytes, bytes], block: bytes) -> tuple | None:
    """(page, bytes, hex digest, type, refers to) of a record, its payload checked; None for records of other types."""
    kind = fields.get(b"warc-type", b"").decode("ascii", "replace")
    if kind not in ("response", "revisit"):
        return None
    told = fields.get(b"warc-payload-digest", b"").split(b":")[-1].decode("ascii", "replace")
    told = base64.b32decode(told).hex() if re.fullmatch("[A-Z2-7]{32}", told) else told.lower() or None
    size = fields.get(b"x-payload-length", b"").strip()
    size = int(size) if size.isdigit() else None
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        digest = hashlib.sha1(payload).hexdigest()
        if told not in (None, digest) or size not in (None, len(payload)):
            raise ValueError("a payload differs from its digest")
        told, size = digest, len(payload)
    return _name(fields.get(b"warc-record-id")), size, told, kind, _name(fields.get(b"warc-refers-to"))


_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_PIECE = pa.schema([("file", pa.string()), ("part", pa.int64()), ("i", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("need", pa.int64()), ("whole", pa.bool_()), ("r", pa.struct([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))])


def _pieces(batches):
    """Each piece of a range: its number, place (bytes before it in the range) and size, and what its head says."""
    now, i, at = None, 0, 0
    for batch in batches:
        rows = []
        for file, part, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (file, part) != now:
                now, i, at = (file, part), 0, 0
            raw = value.as_py()
            size = len(raw) + len(MAGIC)
            got = head(raw) if part or i else None  # what stands before the first magic is no record
            whole, told = got is not None and size == got[2] and raw.endswith(b"\r\n\r\n"), None
            if whole:
                try:
                    told = record(got[0], raw[got[1] - len(MAGIC) : -4])
                except ValueError:  # no record, or a bad one: that shows if the chain reaches it
                    whole = False
            rows.append((file, part, i, at, size, got and got[2], whole, told and dict(zip(_PIECE.field("r").type.names, told, strict=True))))
            i, at = i + 1, at + size
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_PIECE)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _PIECE, strict=True)], schema=_PIECE)


def _numbered(batches):
    now, i = None, 0
    for batch in batches:
        out = []
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            now, i = (key, 0) if key != now else (now, i + 1)
            out.append(i)
        yield pa.record_batch([*batch.columns[:2], pa.array(out, pa.int64()), batch.column(2)], names=["file", "part", "i", "value"])


def _joined(key, pdf):
    import pandas as pd

    pdf = pdf.sort_values("off")
    raw = MAGIC.encode().join(pdf["value"])
    fields, body, _ = head(raw)
    if not raw.endswith(b"\r\n\r\n"):
        raise ValueError("a record does not end with two line ends")
    told = record(fields, raw[body - len(MAGIC) : -4])
    return pd.DataFrame([told] if told else [], columns=[c.split()[0] for c in _RECORD.split(", ")]).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def reached(cuts: Cuts, runs: DataFrame) -> DataFrame:
    """runs (file, off, to): those that a file's chain from offset 0 reaches, by pointer jumping."""
    known = cuts.cut(runs.where("off = 0").select("file", "off"))
    jump = cuts.cut(runs.where("to IS NOT NULL").select("file", "off", "to"))
    while not jump.isEmpty():
        more = cuts.cut(known.unionByName(known.join(jump, ["file", "off"]).select("file", F.col("to").alias("off"))).distinct())
        ahead = jump.select("file", F.col("off").alias("to"), F.col("to").alias("on"))
        longer = cuts.cut(jump.join(ahead, ["file", "to"]).select("file", "off", F.col("on").alias("to")))
        cuts.drop(known, jump)
        known, jump = more, longer
    return known


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a response or revisit: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    cuts = Cuts(spark)
    text = spark.read.option("lineSep", MAGIC).text(path)
    raw = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.col("value").cast("binary").alias("value"))
    kind = f"file string, part long, i long, at long, size long, need long, whole boolean, r struct<{_RECORD.replace(' ', ':').replace(',:', ',')}>"
    p = cuts.cut(raw.mapInArrow(_pieces, kind))
    # places in the file: ranges are few, and their sizes are summed in order; the first piece is what stands before all magics
    n = p.groupBy("file", "part").agg(F.sum("size").alias("size"), F.min_by("at", F.when((F.col("part") > 0) | (F.col("i") > 0), F.col("i"))).alias("first"))
    w = Window.partitionBy("file").orderBy("part")
    base = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - len(MAGIC)
    n = n.withColumn("base", base).withColumn("next", F.min(F.col("base") + F.col("first")).over(w.rowsBetween(1, Window.unboundedFollowing)))
    ends = F.sum("size").over(Window.partitionBy("file")) - len(MAGIC)
    n = cuts.cut(n.withColumn("end", ends))
    p = p.join(n.select("file", "part", "base", "next", "end"), ["file", "part"]).withColumn("off", F.col("base") + F.col("at"))
    if not p.where("part = 0 AND i = 0 AND size > length('WARC/1.')").isEmpty():
        raise ValueError("a file does not begin with a record")
    p = p.where("part > 0 OR i > 0")
    follows = F.coalesce(F.lead("off").over(Window.partitionBy("file", "part").orderBy("i")), "next")
    p = cuts.cut(p.withColumn("to", F.col("off") + F.col("need")).withColumn("follows", follows))
    # runs of candidates linked one to the next, cut at ranges and where a link comes from elsewhere
    odd = cuts.cut(p.where("to IS NOT NULL AND to <> coalesce(follows, end)").select("file", F.col("to").alias("off")).distinct().withColumn("hit", F.lit(True)))
    in_part = Window.partitionBy("file", "part").orderBy("i")
    p = p.join(odd, ["file", "off"], "left")
    before = F.lag("to").over(in_part)
    starts = F.col("hit").isNotNull() | before.isNull() | (before != F.col("off"))
    p = cuts.cut(p.withColumn("starts", starts).withColumn("run", F.max(F.when(F.col("starts"), F.col("off"))).over(in_part.rowsBetween(Window.unboundedPreceding, 0))))
    runs = p.groupBy("file", F.col("run").alias("off")).agg(F.max_by("to", "off").alias("to"))
    known = reached(cuts, cuts.cut(runs)).withColumnRenamed("off", "run")
    good = cuts.cut(p.join(known, ["file", "run"], "left_semi"))
    got = good.groupBy("file").agg(F.max("to").alias("last"))
    short = n.where("part = 0").join(got, "file", "left").where("end > 0 AND coalesce(last, 0) <> end")
    if not short.isEmpty():
        raise ValueError("the chain of records ends before the file does")
    out = good.where("r IS NOT NULL").select("r.*")
    cut_up = good.where("NOT whole").select("file", F.col("off").alias("start"), "to")
    if not cut_up.isEmpty():
        # pieces of records that hold a magic: few, found by their places and read again
        loose = p.select("file", "part", "i", "off").join(cut_up, "file").where("off >= start AND off < to").select("file", "part", "i", "off", "start")
        again = raw.mapInArrow(_numbered, "file string, part long, i long, value binary").join(cuts.cut(loose), ["file", "part", "i"])
        out = out.unionByName(again.groupBy("file", "start").applyInPandas(_joined, _RECORD))
    return cuts.cut(out)


def write_and_read(pages: DataFrame, dedup_from: int = DEDUP_FROM, **cols) -> DataFrame:
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, dedup_from=dedup_from, **cols)
    got = read(spark, path)
    cuts = Cuts(spark)
    cuts.paths[id(got)] = path
    cuts.drop(got)  # the archive is read; its rows are a table of their own
    return got
