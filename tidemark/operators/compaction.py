"""Consolidating very many tiny record files into few files of equal size.

Method: every complete record gets a Hilbert code over (width, height, depth);
an exact histogram of code buckets per source fixes the file boundaries; rows
are shuffled by those boundaries and written; row digests of what was read and
what stands in the files are compared.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import source_name
from tidemark.session import Scratch

BITS = 8  # per dimension of the Hilbert code
BUCKET_BITS = 16  # leading bits of the 24-bit code that the histogram counts
WRITERS = 4096  # most tasks that write files; each holds a range of whole files
BROADCAST_ROWS = 1 << 20  # most histogram rows (16 bytes each) sent to every executor
FIELDS = ("crop_key", "source", "file_name", "native_width", "native_height", "depth_m", "note")
PARSED = (
    "file_id long, file_source string, crop_key string, source string, file_name string, native_width long, "
    "native_height long, depth_m double, note string, extra string, bytes long, code long"
)
_MARKS = re.compile(r'"(?:[^"\\\n]|\\.)*"|[{}\[\]]')  # strings and brackets
RECORD = ("crop_key", "source", "file_name", "native_width", "native_height", "depth_m", "note", "extra")


def hilbert_codes(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of non-negative integers below 2**bits (Skilling's transposition)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    code = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            code = (code << 1) | ((x[i] >> b) & 1)
    return code


def _after(text: str, start: int) -> int:
    """Where the object or list that begins at start ends by its brackets outside strings, parseable or not; just after start if they never close."""
    depth = 0
    for m in _MARKS.finditer(text, start):
        depth += (m[0] in ("{", "[")) - (m[0] in ("}", "]"))
        if depth == 0:
            return m.end()
    return start + 1


def records_in(payload: str | None) -> Iterator[dict]:
    """Complete JSON objects of a payload, one per line or in an array; cut-off ones are skipped.

    What follows a damaged object is read on from inside it, as its end is not
    known: there an object counts if it begins a line or has a field of a record,
    and is not the value of a key, nor in a list that is.
    """
    text, decoder, at, sound = payload or "", json.JSONDecoder(), 0, True
    while (start := text.find("{", at)) >= 0:
        outer = start
        if not sound:
            before = text[at:start].rstrip()
            while before.endswith("["):
                outer = at + len(before) - 1
                before = before[:-1].rstrip()
            if before.endswith(":"):
                try:
                    at = decoder.raw_decode(text, outer)[1]
                except (ValueError, RecursionError):
                    at = max(_after(text, outer), start + 1)
                continue
        try:
            found, at = decoder.raw_decode(text, start)
        except (ValueError, RecursionError):
            at, sound = start + 1, False
            continue
        begins_line = not text[text.rfind("\n", 0, start) + 1 : start].strip()
        if sound or begins_line or not found.keys().isdisjoint(FIELDS):
            yield found


def _number(value: object, kind: type) -> float | int | None:
    try:
        number = float(value)  # type: ignore[arg-type]
        return None if number != number or abs(number) == float("inf") else kind(number)
    except (TypeError, ValueError):
        return None


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("file_id", pa.int64()), ("file_source", pa.string()), ("crop_key", pa.string()), ("source", pa.string()), ("file_name", pa.string()), ("native_width", pa.int64()), ("native_height", pa.int64()), ("depth_m", pa.float64()), ("note", pa.string()), ("extra", pa.string()), ("bytes", pa.int64()), ("code", pa.int64())]
    )
    for batch in batches:
        rows: list[tuple] = []
        for file_id, file_source, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for r in records_in(payload):
                own = (_text(r.get("crop_key")), _text(r.get("source")), _text(r.get("file_name")), _number(r.get("native_width"), int), _number(r.get("native_height"), int), _number(r.get("depth_m"), float), _text(r.get("note")))
                rest = {k: v for k, v in r.items() if k not in FIELDS}
                extra = json.dumps(rest, sort_keys=True, ensure_ascii=False) if rest else None
                size = 24 + sum(len(v) for v in (*own[:3], own[6], extra) if v)
                rows.append((file_id, file_source, *own, extra, size))
        if not rows:
            continue
        columns = list(zip(*rows, strict=True))
        size = lambda v: np.log2(1 + np.clip(np.array([x or 0 for x in v], float), 0, 1 << 16)) * 16
        points = np.stack([size(columns[5]), size(columns[6]), size(columns[7])], 1)
        codes = hilbert_codes(np.clip(points, 0, (1 << BITS) - 1).astype(np.int64))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, schema.field(i).type) for i, c in enumerate(columns)), pa.array(codes)], schema=schema)


@dataclass
class Compacted:
    """files: the consolidated records with source, file_no and occurrences; manifest: a row per file."""

    files: DataFrame
    manifest: DataFrame
    path: str


def digest(df: DataFrame) -> DataFrame:
    """Rows and order-free digest (sum of row hashes) per source."""
    return df.groupBy("source").agg(F.count("*").alias("records"), F.sum(F.xxhash64(*RECORD).cast("decimal(38,0)")).alias("digest"))


def compact(spark: SparkSession, files: DataFrame, target_bytes: int | None = None, path: str | None = None) -> Compacted:
    """Rewrite tiny files (file_id, source, payload) into few, each complete record once.

    A record is a parseable JSON object; its identity is crop_key, or all its
    values where that is missing.  Of repeats the one of the lowest file_id
    stays and ``occurrences`` counts all.  The source is the record's own, else
    its file's, else ``unknown``.  Null, empty and damaged payloads give what
    is complete in them; an empty table gives an empty one.  target_bytes is
    the useful size of a file, by default a 32nd of all within 1 to 256 MB;
    path the folder to write to (source=.../file_no=...), by default one of the
    shared scratch folder.  Raises if what was written differs from what was read.
    """
    scratch = Scratch(spark, "compact")
    parsed = files.select("file_id", F.col("source").alias("file_source"), "payload").mapInArrow(_parse, PARSED)
    parsed = parsed.withColumn("source", F.coalesce(source_name("source"), source_name("file_source"), F.lit("unknown")))
    identity = F.coalesce(F.concat(F.lit("k"), F.col("crop_key")), F.concat(F.lit("v"), F.sha2(F.to_json(F.struct(*RECORD)), 256)))
    kept = F.min(F.struct("file_id", *RECORD, "bytes", "code")).alias("r")
    distinct = parsed.groupBy(identity.alias("identity")).agg(F.count("*").alias("occurrences"), kept)
    distinct = distinct.select("r.*", "occurrences").withColumn("bucket", F.shiftright("code", 3 * BITS - BUCKET_BITS).cast("int"))
    records = scratch.save(distinct, "records")

    # exact histogram of code buckets: at most 2**BUCKET_BITS rows per source
    histogram = records.groupBy("source", "bucket").agg(F.sum("bytes").alias("bytes"))
    total = F.sum("bytes").over(Window.partitionBy("source"))
    if target_bytes is None:
        all_bytes = records.agg(F.sum("bytes")).head()[0] or 0
        target_bytes = min(256 << 20, max(1 << 20, all_bytes // 32))
    upto = F.sum("bytes").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    n_files = F.greatest(F.lit(1), F.rint(total / F.lit(target_bytes)).cast("int"))
    bounds = histogram.withColumn("n_files", n_files).withColumn("first", F.coalesce(upto, F.lit(0)) / (total / n_files)).withColumn("span", F.col("bytes") / (total / n_files))
    bounds = scratch.save(bounds.select("source", "bucket", "n_files", "first", "span"), "bounds")
    per = bounds.groupBy("source").agg(F.max("n_files").alias("n")).select("source", F.coalesce(F.sum("n").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), "n")  # one row per source
    all_files = per.agg(F.sum("n")).head()[0] or 1
    bounds = bounds.join(F.broadcast(per.drop("n")), "source")
    if bounds.count() <= BROADCAST_ROWS:
        bounds = F.broadcast(bounds)
    # a bucket that spans several files is split by the row hash, so one hot code cannot fill one file
    place = F.col("first") + F.col("span") * (F.pmod(F.xxhash64("crop_key", "file_id"), F.lit(1 << 20)) / (1 << 20))
    placed = records.join(bounds, ["source", "bucket"]).withColumn("file_no", F.least(F.col("n_files") - 1, F.floor(place).cast("int")))
    writers = int(min(WRITERS, all_files))
    task = F.floor((F.col("offset") + F.col("file_no")) * writers / F.lit(all_files)).cast("int")
    placed = placed.select("source", "file_no", *[c for c in RECORD if c != "source"], "bytes", "code", "occurrences", task.alias("task"))
    # the range shuffle: consecutive files go to one task, and no file to two
    placed = placed.repartitionById(writers, "task").drop("task").sortWithinPartitions("source", "file_no", "code", "crop_key")
    to = path.rstrip("/") if path else scratch.path("files")
    placed.write.mode("overwrite").partitionBy("source", "file_no").parquet(to)
    out = spark.read.schema(placed.schema).parquet(to)

    read, written = ({r["source"]: (r["records"], r["digest"]) for r in digest(x).collect()} for x in (records, out))  # one row per source
    if read != written:
        raise RuntimeError(f"the consolidated files differ from their sources: {read} and {written}")
    # the payloads parsed anew, before repeats are merged: every delivery of every identity
    mark = F.xxhash64(identity).cast("decimal(38,0)")
    delivered = parsed.agg(F.count("*").alias("n"), F.sum(mark).alias("digest")).head()
    held = out.agg(F.sum("occurrences").alias("n"), F.sum(mark * F.col("occurrences")).alias("digest")).head()
    if (delivered["n"], delivered["digest"]) != (held["n"] or 0, held["digest"]):
        raise RuntimeError(f"the payloads deliver {delivered}, the consolidated files hold {held}")
    scratch.drop("records")
    scratch.drop("bounds")
    manifest = out.groupBy("source", "file_no").agg(
        F.count("*").alias("records"), F.sum("bytes").alias("bytes"), F.sum("occurrences").alias("delivered"), F.sum(F.xxhash64(*RECORD).cast("decimal(38,0)")).cast("string").alias("digest")
    )
    return Compacted(out, manifest, to)


def repeated(files: DataFrame) -> DataFrame:
    """crop_key of the consolidated records that were delivered more than once."""
    return files.filter((F.col("occurrences") > 1) & F.col("crop_key").isNotNull()).select("crop_key")
