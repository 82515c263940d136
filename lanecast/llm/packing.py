"""Operator 5: cost-balanced packing.

A document is its ids and an end id. Full blocks of `capacity` ids are sequences of their own. What is left of
each document is packed, shard by shard: the shard opens the fewest sequences that hold it, and takes the rests
in descending length; each goes to the sequence of lowest estimated attention cost (linear * n + quadratic * n^2
over its pieces) that still has room for it whole, and is cut only where none has. The padding of
a shard is less than one sequence in all.

Shards hold about `shard_docs` documents, by a hash of id and text, so that memory per task is bounded, rows without
an id or with one that repeats are spread as long as their texts differ, and the result is the same on each run. Null or empty text: the end id alone. Repeated rows: each is packed. Other columns are
ignored. Empty table: no rows. Very long texts: encoded whole, and cut
where no sequence has room.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanecast.llm.common import documents, texts_of
from lanecast.llm.tokens import RANKS, TOKENIZER, encode

CAPACITY = 1024
SHARD_DOCS = 2000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int, float]]:
    """(document, start, length, sequence, offset, cost) of each piece; lengths are below the capacity.

    Sequences wait in a heap by cost; one too full for the current length is parked by its room, and comes back
    when lengths have fallen to it. A length that fits nowhere is cut into the roomiest parked sequences.
    """
    n_seq = -(-sum(lengths) // capacity)
    used, cost = [0] * n_seq, [0.0] * n_seq
    ready = [(0.0, s) for s in range(n_seq)]
    parked: list[tuple[int, int]] = []
    todo = [(-n, d, 0) for d, n in enumerate(lengths) if n]
    heapq.heapify(todo)
    out = []
    while todo:
        n, doc, start = heapq.heappop(todo)
        n = -n
        while parked and -parked[0][0] >= n:
            s = heapq.heappop(parked)[1]
            heapq.heappush(ready, (cost[s], s))
        while ready and capacity - used[ready[0][1]] < n:
            s = heapq.heappop(ready)[1]
            if used[s] < capacity:
                heapq.heappush(parked, (used[s] - capacity, s))
        put = n if ready else -parked[0][0]
        s = heapq.heappop(ready)[1] if ready else heapq.heappop(parked)[1]
        c = linear * put + quadratic * put * put
        out.append((doc, start, put, s, used[s], c))
        used[s] += put
        cost[s] += c
        if used[s] < capacity:
            heapq.heappush(ready, (cost[s], s))
        if put < n:
            heapq.heappush(todo, (put - n, doc, start + put))
    return out


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, ranks: str | None = None, end_id: int = 0, capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1.0 / CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row a piece: PIECES."""
    path, rank_path = tokenizer or public_tokenizers.path(TOKENIZER), ranks or public_tokenizers.path(RANKS)
    shards = max(1, -(-df.count() // shard_docs))

    def tokenise(batches):
        for batch, texts in texts_of(batches):
            n, crcs, tails = [], [], []
            for text in texts:
                ids = np.array([*encode(text, path, rank_path), end_id], "<u4")
                full = len(ids) // capacity * capacity
                n.append(len(ids))
                crcs.append([zlib.crc32(ids[k : k + capacity].tobytes()) for k in range(0, full, capacity)])
                tails.append(ids[full:].tobytes() if ids.max() > 65535 else ids[full:].astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary())], ["shard", "doc_id", "doc_tokens", "full_crc32", "tail"])

    def pack_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "doc_tokens", "tail"], kind="stable", na_position="first")
        docs = list(zip(*(rows[c] for c in ("doc_id", "doc_tokens", "full_crc32", "tail")), strict=True))
        lengths = [int(n) % capacity for _, n, _, _ in docs]
        out, next_seq = [], -(-sum(lengths) // capacity)
        for doc, start, n, seq, offset, cost in assign(lengths, capacity, linear, quadratic):
            doc_id, total, _, tail = docs[doc]
            ids = np.frombuffer(tail, "<u2" if len(tail) == 2 * lengths[doc] else "<u4")[start : start + n]
            out.append((doc_id, total // capacity * capacity + start, n, zlib.crc32(ids.astype("<u4").tobytes()), total, seq, offset, cost))
        for doc_id, total, crcs, _ in docs:
            for k, crc in enumerate(crcs):
                out.append((doc_id, k * capacity, capacity, crc, total, next_seq, 0, linear * capacity + quadratic * capacity**2))
                next_seq += 1
        made = pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
        made["sequence_id"] += int(key[0]) << 32
        return made.astype({"doc_id": "Int64"})

    text, doc_id = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    shard = F.pmod(F.xxhash64(doc_id, text), F.lit(shards)).cast("int")
    rows = df.select(shard.alias("shard"), doc_id.alias("doc_id"), text.alias("text"))
    rows = rows.mapInArrow(tokenise, "shard int, doc_id long, doc_tokens long, full_crc32 array<long>, tail binary")
    return rows.groupBy("shard").applyInPandas(pack_shard, PIECES)


def op5_cost_balanced_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir))


QUERIES = {"op5_cost_balanced_packing": op5_cost_balanced_packing}
SQL: dict[str, str] = {}
