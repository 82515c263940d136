"""Operator 6: scores of a probabilistic suffix tree, beside add-one unigram scores.

Symbols of the tree are words (A-Z lowered) and one end a text. Contexts are up to `depth`
symbols long; before a text stand as many starts. A context is a candidate if it precedes at least `LEAST` training symbols, whatever the corpus' size, so
the model grows with the corpus. It is retained if its next-symbol distribution diverges from that of its suffix by
`DIVERGENCE` bits a symbol or more; the divergence is taken leaving one out, so that a context which is merely rare
doesn't pass. Distributions are smoothed towards the suffix's by `PRIOR` symbols; the root is the add-one unigram. A word
is scored in its longest retained context.

Texts are taken in blocks of `BLOCK` words. The tree is learned level by level; no level is ever gathered anywhere:

1. each block sends its distinct (context, symbol) with their counts to shards by context (contexts above `SHARD` symbols
   are dealt over several), only those below contexts that are still candidates;
2. a shard adds up the blocks' counts, tests its contexts (the parts of a dealt one are summed first), gives those that
   can be contexts themselves a number for the next level, and answers each block with the counts of what it sent;
3. the block keeps the answer, aligned with what it sent, and goes on to the next level or to the scores.

So a gram costs a row's share a block, however often it occurs, and a block meets just the part of the model that its
texts need. What is sent and answered is packed: sorted, differenced, byte planes, zstandard.

Words stand as 64-bit hashes: among 10^8 different words two meet with a chance of a few in 10^3. Divergence tests read
the suffix's probabilities to 0.1 %. Null or empty text: the end alone. Repeated rows: each has its row. Nothing to train
on: N = V = 0, all scores 0. Very long texts: whole, one block. Other columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanecast.llm.common import discard, documents, stored, texts_of
from lanecast.llm.words import ODD, Words, mixed

DEPTH = 2
LEAST = 16  # symbols that a context must precede
DIVERGENCE = 0.01
PRIOR = 16.0
BLOCK = 1 << 20  # words, or one text
SHARD = 1 << 20  # words a shard answers for, and symbols of a context that isn't dealt over shards
STEPS = 512  # parts of a bit in which shards read probabilities
END_KEY = mixed(np.full(1, 10, np.uint64) * ODD)[0]
START = 1 << 62  # number of the start as a context
ROWS = "block long, shard long, data binary"
SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
ANSWERS = "block long, shard long, data binary, context long, n long, gain double"


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2


def packed(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = [struct.pack("<B", len(arrays))] + [struct.pack("<cQ", a.dtype.char.encode(), len(a)) for a in arrays]
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + planes))


def unpacked(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw, out = zstandard.ZstdDecompressor().decompress(data), []
    kinds = [struct.unpack_from("<cQ", raw, 1 + 9 * k) for k in range(raw[0])]
    at = 1 + 9 * len(kinds)
    for char, n in kinds:
        kind = np.dtype(char.decode())
        out.append(np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T.copy().view(kind).ravel())
        at += n * kind.itemsize
    return out


def steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def rows_of(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


class Block:
    """Some texts' words, and per level what the shards answered."""

    def __init__(self, docs: list[np.ndarray], words: list[np.ndarray], levels: list[list[np.ndarray]]):
        self.docs, self.words, self.levels = docs, words, levels  # (id, has id, symbols, asked, weight); (key, local number by place)

    def data(self) -> bytes:
        parts = [packed(*x) for x in (self.docs, self.words, *self.levels)]
        return struct.pack("<B", len(parts)) + b"".join(struct.pack("<Q", len(p)) for p in parts) + b"".join(parts)

    @staticmethod
    def read(data: bytes) -> Block:
        sizes, at, parts = struct.unpack_from(f"<{data[0]}Q", data, 1), 1 + 8 * data[0], []
        for n in sizes:
            parts.append(unpacked(data[at : at + n]))
            at += n
        return Block(parts[0], parts[1], parts[2:])


class Walk:
    """A block at the level its answers reach: `ask` gives what it sends to shards next, `probabilities` its scores.

    Per place: `symbol` (local), `below` (smoothed probability after the longest candidate context so far), `best`
    (after the longest retained one), `gram` (local number of the context that ends here). Per gram: `number`, `n`.
    """

    def __init__(self, block: Block, shards: int, total: int, distinct: int, texts: int, least: int, prior: float, shard: int):
        self.block, self.shards, self.least, self.prior, self.whole = block, shards, least, prior, shard
        self.keys, self.local = block.words
        self.weight = np.repeat(block.docs[4], block.docs[2]).astype(np.int64)
        if not block.levels:
            return
        n, number, *_ = block.levels[0]
        self.known = n[self.local] > 0
        self.symbol = np.where(self.known, self.local, len(n)).astype(np.int64)  # unheard words are one symbol
        self.symbols = np.append(number, -1)
        self.root = self.below = self.best = (n[self.local] + 1) / (total + distinct + 1)
        first = np.zeros(len(self.local), bool)
        first[np.cumsum(block.docs[2]) - block.docs[2]] = True
        self.before = np.where(first, -1, np.arange(len(first)) - 1)
        self.gram = self.local.astype(np.int64)
        self.texts, self.number, self.n = texts, np.append(number, START), np.append(n, texts)
        for answer in block.levels[1:]:
            self.absorb(answer)

    def grams(self) -> None:
        """Distinct (context, symbol) of this level, sorted by shard, context and symbol."""
        context = np.where(self.before >= 0, self.gram[self.before], len(self.n) - 1)
        self.context_n = np.where(context >= 0, self.n[context], 0)
        self.at = np.flatnonzero(self.context_n >= self.least)
        code, first, gram = np.unique(context[self.at] * len(self.symbols) + self.symbol[self.at], return_index=True, return_inverse=True)
        number, symbol = self.number[code // len(self.symbols)], self.symbols[code % len(self.symbols)]
        dealt = self.context_n[self.at[first]] // self.whole + 1
        share = mixed(symbol.astype(np.uint64) * ODD) % dealt.astype(np.uint64)
        shard = (mixed(number.astype(np.uint64) * ODD + share) % np.uint64(self.shards)).astype(np.int64)
        order = np.lexsort((symbol, number, shard))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.of = place[gram]
        self.sent = [x[order] for x in (shard, number, symbol, dealt > 1)]
        self.q = self.below[self.at[first]][order]

    def ask(self) -> list[tuple[int, bytes]]:
        if not self.block.levels:
            order = by_shard(self.keys, self.shards)
            n, keys = np.bincount(self.local, self.weight, len(self.keys)).astype(np.int64)[order], self.keys[order]
            shard = (keys % np.uint64(self.shards)).astype(np.int64)
            return [(s, packed(steps(keys[a:b]), n[a:b])) for s, a, b in runs(shard)]
        self.grams()
        shard, number, symbol, dealt = self.sent
        n = np.bincount(self.of, self.weight[self.at], len(shard)).astype(np.int64)
        q = np.clip(-STEPS * np.log2(self.q), 0, 32767).astype(np.int16)
        return [(s, packed(steps(number[a:b]), symbol[a:b], n[a:b], q[a:b], dealt[a:b])) for s, a, b in runs(shard)]

    def absorb(self, answer: list[np.ndarray]) -> None:
        n, number, retained, told, passes = answer
        self.grams()
        if len(told):
            at = np.minimum(np.searchsorted(told, self.sent[1]), len(told) - 1)
            retained = np.where(told[at] == self.sent[1], passes[at], retained)
        p = (n[self.of] + self.prior * self.below[self.at]) / (self.context_n[self.at] + self.prior)
        self.below, self.best = self.below.copy(), self.best.copy()
        self.below[self.at] = p
        self.best[self.at] = np.where(retained[self.of], p, self.best[self.at])
        self.gram = np.full(len(self.local), -1)
        self.gram[self.at] = self.of
        self.number, self.n = np.append(number, START), np.append(np.where(number >= 0, n, 0), self.texts)


def runs(values: np.ndarray):
    """(value, begin, end) of each run of equal values."""
    edges = np.flatnonzero(np.diff(values)) + 1
    return [(int(values[a]), int(a), int(b)) for a, b in zip([0, *edges], [*edges, len(values)]) if b > a]


def blocks_of(texts: DataFrame, words: int) -> DataFrame:
    """Stored block, symbols, texts (of training), data; texts: doc_id, text, asked, weight (0 or 1)."""

    def read(batches):
        hashes, waiting, size, number = Words(), [], 0, TaskContext.get().partitionId() << 32

        def flushed():
            ids, has, counts, asked, weight, keys = (np.concatenate(x) for x in zip(*waiting))
            key, local, times = np.unique(keys, return_inverse=True, return_counts=True)
            rank = np.empty(len(key), np.int32)  # frequent words have small numbers, which pack well
            order = np.argsort(-times, kind="stable")
            rank[order] = np.arange(len(key))
            block = Block([ids, has, counts, asked, weight], [key[order], rank[local]], [])
            return rows_of("block long, symbols long, texts long, data binary", [number], [len(keys)], [int(weight.sum())], [block.data()])

        for batch, part in texts_of(batches):
            h, first = hashes(part)
            keys = np.insert(h, first[1:], END_KEY)
            ids = batch.column("doc_id")
            row = [ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), np.diff(first) + 1, *[batch.column(c).to_numpy(zero_copy_only=False).astype(np.int8) for c in ("asked", "weight")], keys]
            waiting.append(row)
            size += len(keys)
            if size >= words:
                yield flushed()
                waiting, size, number = [], 0, number + 1
        if waiting:
            yield flushed()

    return stored(texts.mapInArrow(read, "block long, symbols long, texts long, data binary"), "lm-blocks")


def counted(key: tuple, table: pa.Table) -> pa.Table:
    """Level 1: all blocks' words of a shard. Numbers go by falling counts; n and gain of a row without a block: N, V."""
    shard, parts = key[0].as_py(), [unpacked(d) for d in table.column("data").to_pylist()]
    keys, n = (np.concatenate(x) for x in zip(*[(np.cumsum(k, dtype=np.uint64), n) for k, n in parts]))
    _, of = np.unique(keys, return_inverse=True)
    n = np.bincount(of, n).astype(np.int64)
    number = numbered(n, n > 0, shard, table.column("shards")[0].as_py())
    at = np.cumsum([0, *[len(k) for k, _ in parts]])
    data = [packed(n[of[a:b]], number[of[a:b]]) for a, b in zip(at, at[1:])]
    empty = [None] * len(data)
    return pa.Table.from_batches([rows_of(ANSWERS, table.column("block").to_pylist() + [None], [shard] * (len(data) + 1), data + [None], empty + [None], empty + [int(n.sum())], empty + [float((n > 0).sum())])])


def numbered(n: np.ndarray, due: np.ndarray, shard: int, shards: int) -> np.ndarray:
    number, order = np.full(len(n), -1), np.flatnonzero(due)
    order = order[np.argsort(-n[order], kind="stable")]
    number[order] = np.arange(len(order)) * shards + shard
    return number


def tested(least: int, prior: float, divergence: float):
    def add(key: tuple, table: pa.Table) -> pa.Table:
        """Deeper levels: all blocks' grams of a shard. Rows without data: of a dealt context a part's n and gain, and
        (n null) the blocks that must hear of it."""
        shard, blocks = key[0].as_py(), table.column("block").to_pylist()
        parts = [unpacked(d) for d in table.column("data").to_pylist()]
        context, symbol, n, q, dealt = (np.concatenate(x) for x in zip(*[(np.cumsum(c), *rest) for c, *rest in parts]))
        order = np.lexsort((symbol, context))
        context, symbol = context[order], symbol[order]
        new = np.ones(len(order), bool)
        new[1:] = (context[1:] != context[:-1]) | (symbol[1:] != symbol[:-1])
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        first = order[new]
        n = np.bincount(of, n, len(first)).astype(np.int64)
        q, dealt, context = np.exp2(q[first] / -STEPS), dealt[first], context[new]
        head = np.ones(len(first), bool)
        head[1:] = context[1:] != context[:-1]
        family = np.cumsum(head) - 1
        after = np.bincount(family, n)
        gain = np.bincount(family, np.where(n > 0, n * np.log2((np.maximum(n, 1) - 1 + prior * q) / q), 0.0))
        retained = diverges(after, gain, prior, divergence)[family]
        number = numbered(n, n >= least, shard, table.column("shards")[0].as_py())
        at = np.cumsum([0, *[len(p[0]) for p in parts]])
        of_block = [of[a:b] for a, b in zip(at, at[1:])]
        out = [rows_of(ANSWERS, blocks, [shard] * len(blocks), [packed(n[x], number[x], retained[x]) for x in of_block], *[[None] * len(blocks)] * 3)]
        if dealt.any():
            f = np.flatnonzero(head & dealt)
            out.append(rows_of(ANSWERS, [None] * len(f), [shard] * len(f), [None] * len(f), context[f], after[family[f]].astype(np.int64), gain[family[f]]))
            for b, x in zip(blocks, of_block):
                c = np.unique(context[x[dealt[x]]])
                out.append(rows_of(ANSWERS, [b] * len(c), [shard] * len(c), [None] * len(c), c, [None] * len(c), [None] * len(c)))
        return pa.Table.from_batches(out)

    return add


def diverges(after, gain, prior: float, divergence: float):
    after = np.maximum(after, 1)
    return gain / after - np.log2(after - 1 + prior) >= divergence


def answered(found: DataFrame, prior: float, divergence: float) -> DataFrame:
    """The stored answers with, for dealt contexts, n: 1 where the sum of the parts passes the test, else 0."""
    sums = found.where("block IS NULL").groupBy("context").agg(F.sum("n").alias("all"), F.sum("gain").alias("sum"))
    passes = F.col("sum") / F.col("all") - F.log2(F.col("all") - 1 + prior) >= divergence
    told = found.where("block IS NOT NULL AND data IS NULL").select("block", "context").distinct().join(sums.select("context", passes.cast("long").alias("n")), "context")
    return found.where("data IS NOT NULL").unionByName(told.select("block", F.lit(None).cast("long").alias("shard"), F.lit(None).cast("binary").alias("data"), "context", "n", F.lit(None).cast("double").alias("gain")))


def absorbed(state: DataFrame, answers: DataFrame, shards: int, what, schema: str) -> DataFrame:
    """what(number, Block) of each block, with the level that was answered."""

    def absorb(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block, rows = Block.read(left.column("data")[0].as_py()), right.select(["shard", "data", "context", "n"]).to_pylist()
        parts = [unpacked(r["data"]) for r in sorted((r for r in rows if r["data"] is not None), key=lambda r: r["shard"])]
        nothing = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]
        level = [np.concatenate(x) for x in zip(*parts)] if parts else nothing
        if block.levels:
            told = sorted((r["context"], r["n"]) for r in rows if r["data"] is None)
            level += [np.array([c for c, _ in told], np.int64), np.array([n for _, n in told], bool)]
        else:  # answers come by shard and key; words stand by frequency, and their keys aren't needed any more
            order = by_shard(block.words[0], shards)
            level, block.words[0] = [put(x, order) for x in level], block.words[0][:0]
        block.levels.append(level)
        return pa.Table.from_batches([what(key[0].as_py(), block)])

    return state.select("block", "data").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(absorb, schema)


def by_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return np.lexsort((keys, keys % np.uint64(shards)))


def put(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[order] = values
    return out


def scored(texts: DataFrame, depth: int = DEPTH, least: int = LEAST, prior: float = PRIOR, divergence: float = DIVERGENCE, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row asked for. texts: doc_id, text, asked and weight (0 or 1)."""
    state = blocks_of(texts, block)
    symbols, trained = state.agg(F.coalesce(F.sum("symbols"), F.lit(0)), F.coalesce(F.sum("texts"), F.lit(0))).first()
    shards = max(1, -(-symbols // shard))

    def asked(state: DataFrame, facts: tuple) -> DataFrame:
        def ask(batches):
            for batch in batches:
                for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    sent = Walk(Block.read(data), *facts).ask()
                    yield rows_of(ROWS, [block] * len(sent), [s for s, _ in sent], [d for _, d in sent])

        return state.select("block", "data").mapInArrow(ask, ROWS).withColumn("shards", F.lit(shards).cast("long"))

    facts = (shards, 0, 0, trained, least, prior, shard)
    found = stored(asked(state, facts).groupBy("shard").applyInArrow(counted, ANSWERS), "lm-words")
    total, distinct = found.where("block IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("gain"), F.lit(0.0))).first()
    facts, answers = (shards, total, int(distinct), trained, least, prior, shard), found.where("block IS NOT NULL")
    for _ in range(depth):
        done = state, found
        state = stored(absorbed(state, answers, shards, lambda number, block: rows_of("block long, data binary", [number], [block.data()]), "block long, data binary"), "lm-blocks")
        discard(*done)
        found = stored(asked(state, facts).groupBy("shard").applyInArrow(tested(least, prior, divergence), ANSWERS), "lm-grams")
        answers = answered(found, prior, divergence)

    def scores(number: int, block: Block) -> pa.RecordBatch:
        walk, (ids, has, lengths, due, _) = Walk(block, *facts), block.docs
        of, m = np.repeat(np.arange(len(ids)), lengths), due > 0
        known, base, score = (np.bincount(of, x, len(ids))[m] for x in (walk.known, np.log10(walk.root), np.log10(walk.best)))
        columns = [pa.array(ids[m], mask=~has[m]), lengths[m], known.astype(np.int64), np.full(m.sum(), total, np.int64), base, score]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in SCORES.split(", ")])

    return absorbed(state, answers, shards, scores, SCORES)


def score(df: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", **model) -> DataFrame:
    """As scored, of each row of df by a model of the rows of training."""
    part = lambda d, asked, doc_id: d.select(doc_id.cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(asked).alias("asked"), F.lit(1 - asked).alias("weight"))
    return scored(part(df, 1, F.col(id_col)).unionByName(part(training, 0, F.lit(None))), **model)


def op6_suffix_tree_scores(spark, sf_dir):
    out = held_out(F.col("doc_id"))
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(1).alias("asked"), F.when(out, 0).otherwise(1).alias("weight"))
    return scored(docs).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op6_suffix_tree_scores": op6_suffix_tree_scores}
SQL: dict[str, str] = {}
