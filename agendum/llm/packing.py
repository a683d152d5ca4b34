"""Best-fit packing: sum-of-squares packing of tokenized documents into sequences of a fixed length."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agendum.llm import common
from agendum.llm.tokens import pieces


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset for each length, in the order given, and the number of bins.

    open_[g] counts the open bins with g tokens left. A document goes where the sum of squares of these counts
    becomes smallest: into a bin with some gap, or into a new one; the tightest gap wins ties. Only counts and
    the ends of the open bins are held.
    """
    open_ = np.zeros(capacity + 1, np.int64)  # of gaps; gap 0 counts for nothing
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        # The change of the sum of squares, for each gap from size up: one bin fewer there, one more at what is left.
        change = 2 * (open_[: capacity + 1 - size] - open_[size:]) + 2
        change[0] = 1 - 2 * open_[size]  # a bin filled to the brim leaves the sum
        change[open_[size:] == 0] = np.iinfo(np.int64).max
        change[-1] = 2 * open_[capacity - size] + 1 if size < capacity else 0  # a new bin
        gap = size + int(change.argmin())
        if gap == capacity:
            b, n = n, n + 1
        else:
            b = bins[gap].pop()
            open_[gap] -= 1
        where[i], offset[i] = b, capacity - gap
        if gap > size:
            bins[gap - size].append(b)
            open_[gap - size] += 1
    return where, offset, n


@dataclass
class Packed:
    """pieces: the input's key, piece, start, length, ids (32-bit little-endian) and piece_uid; placement: piece_uid, sequence_id, offset."""

    pieces: DataFrame
    placement: DataFrame


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenized pieces of at most capacity tokens, one piece for each document that is no longer, stored in the shared folder."""
    common.ship(docs.sparkSession)
    schema = pa.schema([(key, pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
    end = np.uint32(end_id).tobytes()

    def tokenize(batches):
        encode = pieces(tokenizer).ids
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in common.slices(texts):
                rows = []
                for k, ids in zip(keys[a:b], encode(texts[a:b]), strict=True):
                    ids += end
                    for j, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((k, j, at // 4, len(part) // 4, part))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = docs.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").cast("string").alias("t"))
    out = rows.mapInArrow(tokenize, f"`{key}` long, piece int, start long, length long, ids binary")
    return common.stored(out.withColumn("piece_uid", F.monotonically_increasing_id()), "pieces")


def place(lengths: DataFrame, capacity: int = 4096, shard_pieces: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to rows with piece_uid and length.

    Pieces are dealt at random to shards of about shard_pieces, each packed by itself, longest first: a shard
    ends with one or two sequences that are not full among thousands, and takes bounded memory.
    """
    n = lengths.count()
    shards = max(1, -(-n // shard_pieces))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "piece_uid"], ascending=[False, True])
        where, offset, _ = sum_of_squares(rows["length"].to_numpy(), capacity)
        return pd.DataFrame({"piece_uid": rows["piece_uid"], "sequence_id": where * shards + rows["shard"], "offset": offset})

    dealt = lengths.select("piece_uid", "length", F.pmod(F.xxhash64("piece_uid"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInPandas(pack, "piece_uid long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, key: str = "doc_id", text: str = "text", shard_pieces: int = 100_000) -> Packed:
    """Packs whole documents into as few sequences of capacity tokens as the sum-of-squares rule reaches.

    Each document's ids end with end_id. Only documents longer than capacity are cut, each into full pieces and
    a rest. A null text counts as empty (a piece of one token); null keys (keys are integers, others fail) and repeated
    rows are packed like any other; other columns take no part; an empty table gives empty results.
    """
    made = cut(docs, tokenizer, end_id, capacity, key, text)
    return Packed(made, place(made.select("piece_uid", "length"), capacity, shard_pieces))
