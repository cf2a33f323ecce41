"""WARC archives written and read by Spark, with boundary-chain verification.

Writing: each page is one record; pages whose payload another page already stores
are ``revisit`` records without payload. Archives are plain part files of the text
writer, so any file system that Spark reaches will do.

Reading: files are cut at the magic ``WARC/1.`` in parallel. A cut is only a
candidate, for payloads may hold the magic. Each task follows, within its file
block, the chain from candidate to successor (header end + Content-Length + blank
lines) and names for each candidate the boundary at which its chain leaves the
block. Pointer jumping over those few block entries, from the file starts, finds
the entries that are real; a candidate counts if a real entry's chain meets it.
"""

from __future__ import annotations

import base64
import hashlib
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlake.llm.common import stored
from basketlake.session import scratch_path

# Fixed values of the format
MAGIC = "WARC/1."
END = "\r\n\r\n"
_PAGE = "urn:page:"
_PAGE_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1: five hex digits give four letters."""
    digest = F.sha1(payload)
    fives = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*fives)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """One record per row of ``pages(page_id, url, html)``; a null html is empty.

    Among equal payloads of at least ``min_bytes`` bytes the smallest page_id is the
    response and rows with another id revisit it; rows that repeat that id are all
    responses, rows without id revisit when any page with an id stores the payload.
    """
    page = pages.select(
        F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    page = page.withColumns({"digest": base32_sha1(F.col("html").cast("binary")), "n": F.octet_length("html")})
    shared = stored(
        page.where(F.col("n") >= min_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
        .where("copies > 1 and first is not null").select("digest", "first"), "payloads")
    marked = page.join(shared, "digest", "left").withColumn(
        "again", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("n") >= min_bytes))

    def urn(column: str) -> Column:
        return F.concat(F.lit(f"<{_PAGE}"), F.url_encode(F.col(column).cast("string")), F.lit(">"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    length = F.when(F.col("again"), 0).otherwise(F.col("n") + len(_PAGE_HEAD))
    anonymous = F.concat(F.lit("<urn:sha1:"), F.col("digest"), F.lit(">"))
    record = F.concat(
        F.lit(f"{MAGIC}1\r\n"),
        line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.coalesce(urn("page_id"), anonymous)),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")),
        line("WARC-Refers-To", F.when(F.col("again"), urn("first"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("n").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "), length.cast("string"), F.lit(END),
        F.when(F.col("again"), "").otherwise(F.concat(F.lit(_PAGE_HEAD), F.col("html"))))
    marked.select(record.alias("value")).write.option("lineSep", END).text(path)


def _header(chunk: bytes):
    """(header fields, where the block begins, its length), or None if no record begins here."""
    end = chunk.find(b"\r\n\r\n")
    if end < 0 or not chunk[:1].isdigit() or chunk[1:3] != b"\r\n":
        return None
    fields = {}
    for raw in chunk[3:end].split(b"\r\n"):
        name, colon, value = raw.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    return fields, end + 4, int(length)


def _page_id(urn: str | None) -> str | None:
    found = (urn or "").strip("<>")
    return unquote_plus(found[len(_PAGE):]) if found.startswith(_PAGE) else None


def _content(fields: dict, block: bytes, with_payload: bool) -> tuple:
    kind = fields.get("warc-type")
    if kind == "revisit":
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        n, payload = int(fields.get("x-payload-length") or 0), None
    else:
        payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
        digest, n = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
    return (_page_id(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind,
            _page_id(fields.get("warc-refers-to")), digest, n, payload if with_payload else None)


_CONTENT = [("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
            ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
_CONTENT_DDL = ("page_id string, url string, record_type string, refers_to string, payload_digest string, "
                "payload_bytes long, payload binary")
_CHAIN_DDL = "file string, block long, rel long, size long, succ long, left long, low long, high long, whole boolean"


def chain_rows(chunks: list[tuple[int, int, int | None]]) -> list[tuple]:
    """(exit, low, high) of each chunk (offset, size, successor or None) of a block.

    ``exit`` is where the chain from here leaves the block. The successor relation is
    a forest; ``low``/``high`` number it so that e's chain meets c just when
    low(c) <= low(e) < high(c).
    """
    index = {rel: i for i, (rel, _, succ) in enumerate(chunks) if succ is not None}
    end = chunks[-1][0] + chunks[-1][1] + 1 if chunks else 0
    up = [index.get(succ) if succ is not None else None for _, _, succ in chunks]
    weight = [1] * len(chunks)
    for i, parent in enumerate(up):
        if parent is not None:
            weight[parent] += weight[i]
    exits, low, free, counter = [None] * len(chunks), [0] * len(chunks), [0] * len(chunks), 0
    for i in range(len(chunks) - 1, -1, -1):
        parent, succ = up[i], chunks[i][2]
        if parent is not None:
            exits[i], low[i] = exits[parent], free[parent]
            free[parent] += weight[i]
        else:
            exits[i] = succ if succ is not None and succ >= end else None
            low[i] = counter
            counter += weight[i]
        free[i] = low[i] + 1
    return [(exits[i], low[i], low[i] + weight[i]) for i in range(len(chunks))]


def _candidates(with_payload: bool):
    def run(batches):
        here, rel, held, content = None, 0, [], []

        def flushed():
            chains = chain_rows([(r, n, s) for r, n, s, _ in held])
            columns = [[here[0]] * len(held), [here[1]] * len(held), [h[0] for h in held], [h[1] for h in held],
                       [h[2] for h in held], *(list(c) for c in zip(*chains)), [h[3] for h in held]]
            kinds = [pa.string()] + [pa.int64()] * 7 + [pa.bool_()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            arrays += [pa.array([c[i] for c in content], k) for i, (_, k) in enumerate(_CONTENT)]
            names = ["file", "block", "rel", "size", "succ", "left", "low", "high", "whole"]
            return pa.RecordBatch.from_arrays(arrays, names=names + [n for n, _ in _CONTENT])

        for batch in batches:
            for file, block, value in zip(batch.column(0), batch.column(1), batch.column(2)):
                key, raw = (file.as_py(), block.as_py()), value.as_py()
                if key != here:
                    if held:
                        yield flushed()
                    here, rel, held, content = key, 0, [], []
                head = _header(raw)
                succ, whole, found = None, False, (None,) * len(_CONTENT)
                if head:
                    fields, begin, length = head
                    # offsets count from the magic that was cut off before this chunk
                    succ = rel + begin + length + len(END)
                    whole = len(raw) >= begin + length
                    if whole:
                        found = _content(fields, raw[begin: begin + length], with_payload)
                    succ += len(MAGIC)
                held.append((rel, len(raw), succ, whole))
                content.append(found)
                rel += len(raw) + len(MAGIC)
        if held:
            yield flushed()
    return run


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.option("lineSep", MAGIC).text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.col("value").cast("binary").alias("value"))


def _stitched(with_payload: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for file, start, parts in zip(*batch.columns):
                raw = MAGIC.encode().join(p["bytes"] for p in sorted(parts.as_py(), key=lambda p: p["at"]))
                fields, begin, length = _header(raw)
                if len(raw) >= begin + length:  # else the file ends inside the record
                    rows.append((file.as_py(), start.as_py(), *_content(fields, raw[begin: begin + length], with_payload)))
            kinds = [pa.string(), pa.int64(), *(k for _, k in _CONTENT)]
            names = ["file", "start", *(n for n, _ in _CONTENT)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """(file, start, page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload).

    Digest and size of a response are taken from the payload as read, those of a
    revisit from its header. A record that the end of the file cuts off is not returned.
    """
    scanned = _chunks(spark, path).mapInArrow(_candidates(with_payload), f"{_CHAIN_DDL}, {_CONTENT_DDL}")
    slim = stored(scanned.select("file", "block", "rel", "size", "succ", "left", "low", "high", "whole"), "chunks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(
        slim.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
        .select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base")), "bases")
    placed = slim.join(bases, ["file", "block"]).select(
        "file", "block", (F.col("base") + F.col("rel") - len(MAGIC)).alias("start"), "low", "high", "whole",
        (F.col("base") + F.col("left") - len(MAGIC)).alias("left"), F.col("succ").isNotNull().alias("head"), "rel", "size")

    firsts = placed.where("head and start = 0").select("file", "start")
    targets = firsts.union(placed.where("left is not null").select("file", F.col("left").alias("start"))).distinct()
    nodes = stored(placed.where("head").join(targets, ["file", "start"], "left_semi")
                   .select("file", "start", "block", "low", "left"), "entries")
    jump = nodes.where("left is not null").select("file", "start", "left")
    real = nodes.where("start = 0").select("file", "start")
    count = -1
    while True:
        onward = real.join(jump, ["file", "start"]).select("file", F.col("left").alias("start"))
        real = stored(real.union(onward).distinct(), "reached")
        now = real.count()
        if now == count:
            break
        count = now
        further = jump.select("file", F.col("start").alias("left"), F.col("left").alias("onto"))
        jump = stored(jump.join(further, ["file", "left"]).select("file", "start", F.col("onto").alias("left")), "jumps")
    entries = stored(nodes.join(real, ["file", "start"], "left_semi")
                     .select(F.col("file").alias("f"), F.col("block").alias("b"), F.col("low").alias("e")), "entries")

    def is_real(df: DataFrame) -> DataFrame:
        met = (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")) & (F.col("low") <= F.col("e")) & (F.col("e") < F.col("high"))
        return df.join(entries, met, "left_semi")

    names = [n for n, _ in _CONTENT]
    plain = is_real(scanned.where("whole")).join(bases, ["file", "block"]).select(
        "file", (F.col("base") + F.col("rel") - len(MAGIC)).alias("start"), *names)
    spread = slim.where("succ is not null and not whole")
    if spread.isEmpty():
        return plain
    # records whose payload holds the magic: gather their chunks, found by grid cell
    cell = 1 << 20
    open_ = stored(is_real(spread).join(bases, ["file", "block"]).select(
        "file", (F.col("base") + F.col("rel") - len(MAGIC)).alias("record"),
        (F.col("base") + F.col("succ") - len(MAGIC)).alias("until")), "open")
    cells = open_.select("*", F.explode(F.sequence(F.expr(f"record div {cell}"), F.expr(f"until div {cell}"))).alias("cell"))
    inside = placed.withColumn("cell", F.expr(f"start div {cell}")).join(cells, ["file", "cell"]).where("start >= record and start < until")
    wanted = stored(inside.select("file", "block", "rel", "record", F.col("start").alias("at")), "pieces")
    pieces = (_chunks(spark, path).mapInArrow(_raw_chunks, "file string, block long, rel long, bytes binary")
              .join(wanted, ["file", "block", "rel"]))
    whole = (pieces.groupBy("file", F.col("record").alias("start")).agg(F.collect_list(F.struct("at", "bytes")).alias("parts"))
             .mapInArrow(_stitched(with_payload), f"file string, start long, {_CONTENT_DDL}"))
    return plain.unionByName(whole)


def _raw_chunks(batches):
    here, rel = None, 0
    for batch in batches:
        offsets = []
        for file, block, value in zip(batch.column(0), batch.column(1), batch.column(2)):
            key = (file.as_py(), block.as_py())
            if key != here:
                here, rel = key, 0
            offsets.append(rel)
            rel += len(value.as_buffer()) + len(MAGIC)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(offsets, pa.int64()), batch.column(2)],
            names=["file", "block", "rel", "bytes"])


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and list the records read back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    return read_archives(spark, path).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))
