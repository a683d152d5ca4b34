"""Token-ID / binary output: length-delimited records with masked checksums, and an offset index beside them.

A data file holds records one after another, all integers little-endian:

    uint64 n | uint32 mask(crc32 of those 8 bytes) | n bytes of payload | uint32 mask(crc32 of the payload)

mask(c) = ((c >> 15 | c << 17) + 0xa282ead8) mod 2**32, so that a checksum over data that holds checksums stays
useful. A payload is one byte (1: the key is null, 2: the ids take 32 bits, else 16), the int64 key, the ids.
An index file holds uint64 offsets and uint64 token starts, one of each for each record and one for the end.
manifest.json names the files of the tasks that counted: files of tasks that were lost or repeated are no part.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agendum.llm import common
from agendum.llm.tokens import pieces

#: Fixed values of the record frame.
MASK_DELTA, NULL_KEY, WIDE = 0xA282EAD8, 1, 2
#: Characters of a text that order equal keys; samples of them come to the driver when files are dealt.
HEAD_CHARS = 64


def masked(data) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17 & 0xFFFFFFFF) + MASK_DELTA) & 0xFFFFFFFF


def frame(key: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    payload = bytes([(key is None) * NULL_KEY + wide * WIDE]) + (key or 0).to_bytes(8, "little", signed=True) + ids.astype("<u4" if wide else "<u2").tobytes()
    n = len(payload).to_bytes(8, "little")
    return n + masked(n).to_bytes(4, "little") + payload + masked(payload).to_bytes(4, "little")


def unframe(record: memoryview) -> tuple[int | None, bytes]:
    """The key and the ids as 32-bit integers; raises ValueError where a length or checksum is wrong."""
    n = int.from_bytes(record[:8], "little")
    if masked(record[:8]) != int.from_bytes(record[8:12], "little") or len(record) != n + 16:
        raise ValueError("record with a wrong length")
    payload = record[12 : 12 + n]
    if masked(payload) != int.from_bytes(record[12 + n :], "little"):
        raise ValueError("record with a wrong checksum")
    flags = payload[0]
    ids = np.frombuffer(payload[9:], "<u4" if flags & WIDE else "<u2").astype("<u4")
    return (None if flags & NULL_KEY else int.from_bytes(payload[1:9], "little", signed=True)), ids.tobytes()


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", files: int | None = None, file_bytes: int = 256_000_000) -> str:
    """Writes each row's token ids, and end_id behind them, in ascending order of key under the URI path.

    One range partition of keys makes one data file and its index: a file for each file_bytes bytes of text, so that its
    offsets fit in a task, and as many as the session has shuffle partitions at least. Keys are integers (others fail).
    Null keys come first, equal keys in the order of their texts' first HEAD_CHARS characters, then of their hashes, so
    that a key with many rows spreads over files; a null text counts as empty; repeated rows each make a record; an empty
    table makes a manifest without files. Other columns are not written. The path is a URI that driver and executors share.
    """
    spark = docs.sparkSession
    common.ship(spark)
    if files is None:
        size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")).cast("long"))).first()[0] or 0
        files = max(common.parallelism(spark), -(-size // file_bytes))

    def write(batches):
        from pyspark import TaskContext

        context, out, index, offsets, starts, stem = TaskContext.get(), None, None, [0], [0], ""
        fs, base = _open(path)
        encode = pieces(tokenizer).ids
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in common.slices(texts):
                for k, ids in zip(keys[a:b], encode(texts[a:b]), strict=True):
                    if out is None:
                        stem = f"{context.partitionId():06d}-{context.attemptNumber()}-{uuid.uuid4().hex}"
                        out = fs.open_output_stream(f"{base}/{stem}.bin")
                    ids = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
                    out.write(record := frame(k, ids))
                    offsets.append(offsets[-1] + len(record))
                    starts.append(starts[-1] + len(ids))
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{base}/{stem}.idx") as index:
                index.write(np.array([offsets, starts], "<u8").tobytes())
            row = {"part": [context.partitionId()], "stem": [stem], "records": [len(offsets) - 1], "tokens": [starts[-1]], "bytes": [offsets[-1]]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("stem", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

    fs, base = _open(path)
    fs.create_dir(base, recursive=True)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    head, mark = F.substring("t", 1, HEAD_CHARS), F.xxhash64("t")
    order = [F.col("k").asc_nulls_first(), head.asc_nulls_first(), mark.asc()]
    # The salt parts equal rows only, which may stand in any order.
    dealt = rows.withColumn("salt", F.rand(0).cast("float")).repartitionByRange(files, *order, F.col("salt").asc()).sortWithinPartitions(*order, F.col("t").asc_nulls_first()).select("k", "t")
    done = dealt.mapInArrow(write, "part int, stem string, records long, tokens long, bytes long").collect()  # a row for each file
    start, listed = 0, []
    for r in sorted(done):
        listed.append(r.asDict() | {"start": start})
        start += r.tokens
    with fs.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps({"files": listed}).encode())
    return path


def read_records(spark: SparkSession, path: str, seed: int | None = None, block: int = 4_000_000, range_bytes: int = 128_000_000) -> DataFrame:
    """Rows key, start (tokens of all records before it), n_tokens and ids (32-bit little-endian) of a written folder.

    A file is read in ranges of its records of about range_bytes bytes, each by a task that seeks its part of the index and
    then reads block bytes at a time, or, with a seed, its records in a shuffled order one by one; the ranges are dealt out
    in a shuffled order then too. A damaged record raises ValueError.
    """
    common.ship(spark)
    fs, base = _open(path)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        files = json.loads(f.read())["files"]
    ranges = [max(1, -(-f["bytes"] // range_bytes)) for f in files]
    listed = spark.createDataFrame([(f["part"], f["stem"], f["start"], f["records"], n) for f, n in zip(files, ranges, strict=True)], "part int, stem string, start long, n long, ranges long")
    listed = listed.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ranges") - 1)))
    listed = listed.select("part", "stem", "start", "n", F.expr("n * i div ranges").alias("low"), F.expr("n * (i + 1) div ranges").alias("high")).filter("low < high")
    schema = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches):
        fs, base = _open(path)
        for batch in batches:
            for part, stem, first, n, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{base}/{stem}.idx") as f:
                    offsets, starts = (np.frombuffer(f.read_at(8 * (high - low + 1), 8 * (row * (n + 1) + low)), "<u8").astype(np.int64) for row in (0, 1))
                m = high - low
                order = np.arange(m) if seed is None else np.random.default_rng([seed, part, low]).permutation(m)
                with fs.open_input_file(f"{base}/{stem}.bin") as f:
                    a = 0
                    while a < m:
                        if seed is None:
                            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + block, "right")) - 1)
                            data = memoryview(f.read_at(int(offsets[b] - offsets[a]), int(offsets[a])))
                            records = [data[offsets[i] - offsets[a] : offsets[i + 1] - offsets[a]] for i in range(a, b)]
                        else:
                            b = min(m, a + 256)
                            records = [memoryview(f.read_at(int(offsets[i + 1] - offsets[i]), int(offsets[i]))) for i in order[a:b]]
                        keys, ids = zip(*map(unframe, records), strict=True)
                        at = order[a:b]
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts[at] + first), pa.array(starts[at + 1] - starts[at]), pa.array(ids, pa.binary())], schema=schema)
                        a = b

    tasks = max(1, sum(ranges))
    listed = listed.repartition(tasks) if seed is None else listed.repartitionByRange(tasks, F.xxhash64(F.lit(seed), "stem", "low"))
    return listed.mapInArrow(read, "key long, start long, n_tokens long, ids binary")
