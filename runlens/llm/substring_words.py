"""Repeated word windows, by Rabin-Karp hashes, removed from later documents.

Every window of ``window`` consecutive words is hashed to 96 bits by rolling
hashes over 64-bit word hashes. A window whose key (the least hash of the
shorter grams in it) only one document holds occurs once, which 48-bit keys
settle; all others are counted in buckets of their hashes, each distinct
window once per block, and the least document id of each goes back. Repeated
windows then merge into maximal intervals of words to remove.

Defined results: null text has no words; texts with fewer words than the
window lose nothing; a null id is larger than every other and is returned as
null; rows with equal ids do not remove from each other; an empty table gives
no rows; texts are taken whole, of any length; other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from . import blocks as B
from .common import expand
from .substring_bytes import empty, rows_of

WINDOWS = "bucket int, pid int, keys binary, high binary, low binary, ids binary"
ANSWERS = "pid int, bucket int, keys binary, hit binary, least binary"
RESULT = "id long, n_words long, n_removed long, n_spans long, kept_sha256 string, text string, copies long"


def pack_ids(ids: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.diff(ids, prepend=0).astype("<i8").tobytes())


def unpack_ids(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8"))


class Words:
    """The words of a block: one 64-bit hash each, and where documents end."""

    def __init__(self, block: B.Block):
        # bytes.split() cuts at exactly U+0020 and U+0009 to U+000D
        self.of_doc = [t.split() for t in block.texts]
        counts = np.fromiter(map(len, self.of_doc), np.int64, len(self.of_doc))
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        seen: dict[bytes, int] = {}
        at = np.fromiter((seen.setdefault(w, len(seen)) for w in chain.from_iterable(self.of_doc)), np.int64, int(counts.sum()))
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))
        self.hash = hashed[at] if len(seen) else np.zeros(0, np.uint64)


class Windows:
    """The distinct windows of a block that have shared keys, by bucket."""

    def __init__(self, block: B.Block, words: Words, runs, keep: np.ndarray, window: int, buckets: int):
        start, end, key, doc = (x[keep] for x in runs)
        size = end - start
        row = np.repeat(np.arange(len(start)), size)
        self.at = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        self.doc = doc[row]
        if len(self.at):
            high = B.gram_hashes(words.hash, window)[self.at]
            low = (B.gram_hashes(words.hash ^ B.MIX[3], window)[self.at] >> np.uint64(32)).astype(np.uint32)
        else:
            high, low = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        order = np.lexsort((self.at, low, high))
        new = np.append(True, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])) if len(order) else np.zeros(0, bool)
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        # documents stand in order of their ids: the first has the least
        first = order[new]
        self.high, self.low, self.key = high[first], low[first], key[row[first]] & B.LOW48
        self.least = block.ids[self.doc[first]]
        self.bucket = (self.high % np.uint64(buckets)).astype(np.int64)
        self.order = np.lexsort((self.at[first], self.bucket))

    def by_bucket(self):
        b = self.bucket[self.order]
        cut = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else []
        for x, y in zip(cut, np.append(cut[1:], len(b)) if len(b) else []):
            yield int(b[x]), self.order[x:y]


def send_windows(pid: int, w: Windows) -> pa.Table:
    rows = []
    for bucket, at in w.by_bucket():
        rows.append((bucket, pid, B.pack48(np.unique(w.key[at])), w.high[at].tobytes(), w.low[at].tobytes(), pack_ids(w.least[at])))
    return rows_of(WINDOWS, rows)


def answer_windows(table: pa.Table) -> pa.Table:
    """Count each window over all blocks; send back the least id where smaller."""
    rows = table.to_pylist()
    high = [np.frombuffer(r["high"], np.uint64) for r in rows]
    ids = np.concatenate(own := [unpack_ids(r["ids"]) for r in rows])
    low = np.frombuffer(b"".join(r["low"] for r in rows), np.uint32)
    sizes = [len(h) for h in high]
    high = np.concatenate(high)
    order = np.lexsort((low, high))
    new = np.append(True, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1]))
    first = np.flatnonzero(new)
    least = np.empty(len(ids), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[order], first), np.diff(np.append(first, len(order))))
    out, a = [], 0
    for r, n, mine in zip(rows, sizes, own):
        got = least[a : a + n]
        hit = got < mine
        out.append((r["pid"], r["bucket"], r["keys"], np.packbits(hit).tobytes(), pack_ids(got[hit])))
        a += n
    return rows_of(ANSWERS, out)


def covered(block: B.Block, words: Words, runs, table: pa.Table, window: int, buckets: int) -> np.ndarray:
    total = len(words.hash)
    if not table.num_rows:
        return np.zeros(total, bool)
    keep = B.is_in(runs[2], np.unique(np.concatenate([B.unpack48(x) for x in table.column("keys").to_pylist()])))
    w = Windows(block, words, runs, keep, window, buckets)
    least = w.least.copy()
    got = {b: i for i, b in enumerate(table.column("bucket").to_pylist())}
    for bucket, at in w.by_bucket():
        i = got[bucket]
        packed = np.frombuffer(table.column("hit")[i].as_py(), np.uint8)
        if len(packed) != -(-len(at) // 8):
            raise RuntimeError("the rows of a block changed between two reads of the documents")
        hit = np.unpackbits(packed, count=len(at)).astype(bool)
        least[at[hit]] = unpack_ids(table.column("least")[i].as_py())
    begin = w.at[least[w.of] < block.ids[w.doc]]
    change = np.bincount(begin, minlength=total + 1) - np.bincount(begin + window, minlength=total + 1)
    return np.cumsum(change[:total]) > 0


def finish(block: B.Block, words: Words, gone: np.ndarray, with_text: bool) -> list[tuple]:
    rows = []
    for own, a, b, raw, copies in zip(words.of_doc, words.starts.tolist(), words.ends.tolist(), block.raw_ids, block.copies):
        cut = gone[a:b]
        n = int(np.count_nonzero(cut))
        spans = int(cut[0]) + int(np.count_nonzero(cut[1:] & ~cut[:-1])) if n else 0
        kept = b" ".join(compress(own, (~cut).tolist()) if n else own)
        rows.append((raw, b - a, n, spans, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None, copies))
    return rows


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 25, block_bytes: int = B.BLOCK, with_text: bool = False) -> DataFrame:
    """One row per document: id, n_words, n_removed, n_spans, kept_sha256, text.

    ``text`` (the words that stay, joined by one space) only if asked for.
    """
    dealt, n, repeated = B.deal(docs, id_col, text_col, block_bytes)

    def load(table: pa.Table):
        block = B.Block(table)
        words = Words(block)
        return block, words, B.anchored_runs(words.hash, words.starts, words.ends, window, gram)

    def ask(table: pa.Table) -> pa.Table:
        block, _, (_, _, key, doc) = load(table)
        return B.send_keys(table.column("pid")[0].as_py(), key, block.ids[doc], n)

    def send(table: pa.Table, shared: pa.Table) -> pa.Table:
        if not table.num_rows or not shared.num_rows:
            return empty(WINDOWS)
        block, words, runs = load(table)
        keep = B.is_in(runs[2], B.shared_keys(shared)[0])
        return send_windows(table.column("pid")[0].as_py(), Windows(block, words, runs, keep, window, n))

    def apply(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty(RESULT)
        block, words, runs = load(table)
        return rows_of(RESULT, finish(block, words, covered(block, words, runs, answers, window, n), with_text))

    grouped = dealt.groupBy("pid")
    # windows are routed by their own hashes: a common key burdens no bucket
    shared = B.by_pid(grouped.applyInArrow(ask, B.KEYS), n, "bucket").applyInArrow(lambda t: B.answer_keys(t, 1 << 62), B.SHARED)
    windows = grouped.cogroup(B.by_pid(shared, n)).applyInArrow(send, WINDOWS)
    answers = B.by_pid(windows, n, "bucket").applyInArrow(answer_windows, ANSWERS)
    out = grouped.cogroup(B.by_pid(answers, n)).applyInArrow(apply, RESULT)
    return (expand(out) if repeated else out.drop("copies")).withColumnRenamed("id", id_col)
