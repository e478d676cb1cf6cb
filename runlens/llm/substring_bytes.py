"""Repeated byte strings, found with suffix arrays, removed from later documents.

Every string of ``window`` bytes is routed by the least hash of its grams, so
all its copies meet in one bucket; runs of neighbouring strings with one key
travel as one passage. Keys that only one document holds are settled first
from 48-bit keys alone, so only text around shared keys travels, each distinct
passage once per block. A bucket's passages become one text, whose suffix
array (two-stage sorting) and adjacent common prefixes give the groups of equal
strings; each string of a passage learns the least document id of its group.
Blocks then mark bytes.

Defined results: null text is empty; a null id is larger than every other and
is returned as null; rows with equal ids do not remove from each other; texts
shorter than the window lose nothing; an empty table gives no rows; texts are
taken whole, of any length; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import blocks as B
from . import suffix_array as S
from .common import expand

#: Parts that a bucket's suffix sorting is done in, one after another.
PARTS = 16
PASSAGES = "bucket int, pid int, keys binary, hot binary, parts binary, sizes binary, ids binary, data binary"
ANSWERS = "pid int, bucket int, keys binary, hot binary, counts binary, lengths binary, least binary"
RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, copies long"


def empty(schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    cols = [x.split() for x in schema.split(",")]
    return pa.table([pa.array([], kinds[k]) for _, k in cols], names=[n for n, _ in cols])


def rows_of(schema: str, rows: list[tuple]) -> pa.Table:
    base = empty(schema)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows), base.schema)], schema=base.schema) if rows else base


class Passages:
    """The distinct passages of a block around shared keys, by bucket."""

    def __init__(self, block: B.Block, runs, keys: np.ndarray, hot: np.ndarray, window: int, buckets: int):
        keep = B.is_in(runs[2], keys)
        start, end, key, doc = (x[keep] for x in runs)
        route = key = key & B.LOW48
        if len(hot):
            # the strings of these runs go one by one
            alone = B.is_in(key, hot)
            size = np.where(alone, end - start, 1)
            row = np.repeat(np.arange(len(start)), size)
            step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            alone, begin = alone[row], start[row] + step
            start, end, key, doc = begin, np.where(alone, begin + 1, end[row]), key[row], doc[row]
            route = key.copy()
            route[alone] = B.window_hashes(block.bytes(), begin[alone], window) & B.LOW48
        seen: dict[bytes, int] = {}
        data = block.data
        self.of = np.fromiter((seen.setdefault(data[a : b + window - 1], len(seen)) for a, b in zip(start.tolist(), end.tolist())), np.int64, len(start))
        self.start, self.end, self.doc, self.hot = start, end, doc, hot
        self.text = list(seen)
        _, first = np.unique(self.of, return_index=True)
        # documents stand in order of their ids: the first has the least
        self.key, self.least, route = key[first], block.ids[doc[first]], route[first]
        self.bucket = (route % np.uint64(buckets)).astype(np.int64)
        self.part = (route // np.uint64(buckets) % np.uint64(PARTS)).astype(np.uint8)
        self.order = np.lexsort((np.arange(len(first)), self.part, self.bucket))

    def by_bucket(self):
        sorted_bucket = self.bucket[self.order]
        cut = np.flatnonzero(np.append(True, sorted_bucket[1:] != sorted_bucket[:-1])) if len(sorted_bucket) else []
        for a, b in zip(cut, np.append(cut[1:], len(sorted_bucket)) if len(sorted_bucket) else []):
            yield int(sorted_bucket[a]), self.order[a:b]


def send_passages(pid: int, p: Passages) -> pa.Table:
    pack = zstandard.ZstdCompressor(level=1)
    rows = []
    for bucket, at in p.by_bucket():
        texts = [p.text[i] for i in at.tolist()]
        sizes = np.fromiter(map(len, texts), "<u4", len(texts))
        keys = np.unique(p.key[at])
        rows.append((bucket, pid, B.pack48(keys), np.packbits(B.is_in(keys, p.hot)).tobytes(), p.part[at].tobytes(), sizes.tobytes(), p.least[at].tobytes(), pack.compress(b"".join(texts))))
    return rows_of(PASSAGES, rows)


def least_owner(texts: list[bytes], least: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string of each text, the least id over all equal strings.

    Returns the ids, text after text, and the number of strings of each text.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    text = np.frombuffer(b"".join(texts), np.uint8)
    word = S.words(text)
    order = S.suffix_array(text, window, word)
    same = S.common_prefixes(word, order, window) >= window
    last = np.cumsum(sizes)
    strings = sizes - window + 1
    owner = np.full(len(text), B.NO_ID, np.int64)
    begin = np.repeat(last - sizes - np.append(0, np.cumsum(strings)[:-1]), strings)
    valid = begin + np.arange(len(begin))
    owner[valid] = np.repeat(least, strings)
    group = np.flatnonzero(~same)
    found = np.minimum.reduceat(owner[order], group)
    owner[order] = np.repeat(found, np.diff(np.append(group, len(order))))
    return owner[valid], strings


def answer_passages(table: pa.Table, window: int) -> pa.Table:
    unpack = zstandard.ZstdDecompressor()
    rows = table.to_pylist()
    cuts, parts, lasts = [], [], []
    for r in rows:
        part = np.frombuffer(r["parts"], np.uint8)
        parts.append(np.searchsorted(part, np.arange(PARTS + 1)))
        sizes = np.frombuffer(r["sizes"], "<u4").astype(np.int64)
        lasts.append(np.append(0, np.cumsum(sizes)))
        cuts.append(np.frombuffer(r["ids"], np.int64))
    answers: list[list] = [[] for _ in rows]
    data = [unpack.decompress(r["data"]) for r in rows]
    for part in range(PARTS):
        seen: dict[bytes, int] = {}
        least: list[int] = []
        refs = []
        for k, edges in enumerate(parts):
            a, b = int(edges[part]), int(edges[part + 1])
            last, ids, buf = lasts[k][a : b + 1].tolist(), cuts[k][a:b].tolist(), data[k]
            ref = []
            for x, y, owner in zip(last, last[1:], ids):
                i = seen.setdefault(buf[x:y], len(seen))
                if i == len(least):
                    least.append(owner)
                elif owner < least[i]:
                    least[i] = owner
                ref.append(i)
            refs.append(np.array(ref, np.int64))
        if not seen:
            continue
        owner, strings = least_owner(list(seen), np.array(least, np.int64), window)
        # runs of one owner within each passage
        edge = np.append(0, np.cumsum(strings))
        new = np.append(True, owner[1:] != owner[:-1])
        new[edge[:-1]] = True
        at = np.flatnonzero(new)
        length, value = np.diff(np.append(at, len(owner))), owner[at]
        first = np.searchsorted(at, edge)
        count = np.diff(first)
        for k, ref in enumerate(refs):
            if len(ref):
                take = spread(first[ref], count[ref])
                answers[k].append((count[ref], length[take], value[take]))
    out = []
    for r, got in zip(rows, answers):
        count, length, value = (np.concatenate(x) for x in zip(*got))
        out.append((r["pid"], r["bucket"], r["keys"], r["hot"], count.astype("<u4").tobytes(), length.astype("<u4").tobytes(), value.tobytes()))
    return rows_of(ANSWERS, out)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... for count[0] numbers, then those of the next."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def covered(block: B.Block, runs, table: pa.Table, window: int, buckets: int) -> np.ndarray:
    """Which bytes of the block's buffer are to be removed."""
    total = len(block.data)
    if not table.num_rows:
        return np.zeros(total, bool)
    p = Passages(block, runs, *B.shared_keys(table), window, buckets)
    n = len(p.text)
    first, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
    lengths, values, at = [], [], 0
    got = {b: i for i, b in enumerate(table.column("bucket").to_pylist())}
    for bucket, where in p.by_bucket():
        i = got[bucket]
        c = np.frombuffer(table.column("counts")[i].as_py(), "<u4").astype(np.int64)
        if len(c) != len(where):
            raise RuntimeError("the rows of a block changed between two reads of the documents")
        lengths.append(np.frombuffer(table.column("lengths")[i].as_py(), "<u4").astype(np.int64))
        values.append(np.frombuffer(table.column("least")[i].as_py(), np.int64))
        count[where], first[where] = c, at + np.cumsum(c) - c
        at += len(lengths[-1])
    length, value = np.concatenate(lengths), np.concatenate(values)
    before = np.cumsum(length) - length
    take = spread(first[p.of], count[p.of])
    row = np.repeat(np.arange(len(p.of)), count[p.of])
    offset = before[take] - before[first[p.of]][row]
    begin = p.start[row] + offset
    gone = value[take] < block.ids[p.doc[row]]
    begin, end = begin[gone], begin[gone] + length[take][gone] + window - 1
    change = np.bincount(begin, minlength=total + 1) - np.bincount(end, minlength=total + 1)
    return np.cumsum(change[:total]) > 0


def finish(block: B.Block, gone: np.ndarray, with_text: bool) -> list[tuple]:
    data, rows = block.bytes(), []
    for a, b, raw, copies in zip(block.starts.tolist(), block.ends.tolist(), block.raw_ids, block.copies):
        cut = gone[a:b]
        n = int(np.count_nonzero(cut))
        kept = data[a:b][~cut].tobytes() if n else block.data[a:b]
        spans = int(cut[0]) + int(np.count_nonzero(cut[1:] & ~cut[:-1])) if n else 0
        rows.append((raw, b - a, n, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None, copies))
    return rows


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 16, block_bytes: int = B.BLOCK, with_text: bool = False, hot_runs: int = 1 << 16) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, text.

    ``text`` (the bytes that stay, decoded; characters cut through are left
    out) is filled only if asked for. ``hot_runs``: strings around a key with
    more runs are routed one by one.
    """
    dealt, n, repeated = B.deal(docs, id_col, text_col, block_bytes)

    def load(table: pa.Table):
        block = B.Block(table)
        return block, B.anchored_runs(block.bytes(), block.starts, block.ends, window, gram)

    def ask(table: pa.Table) -> pa.Table:
        block, (_, _, key, doc) = load(table)
        return B.send_keys(table.column("pid")[0].as_py(), key, block.ids[doc], n)

    def send(table: pa.Table, shared: pa.Table) -> pa.Table:
        if not table.num_rows or not shared.num_rows:
            return empty(PASSAGES)
        block, runs = load(table)
        return send_passages(table.column("pid")[0].as_py(), Passages(block, runs, *B.shared_keys(shared), window, n))

    def apply(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty(RESULT)
        block, runs = load(table)
        return rows_of(RESULT, finish(block, covered(block, runs, answers, window, n), with_text))

    grouped = dealt.groupBy("pid")
    shared = B.by_pid(grouped.applyInArrow(ask, B.KEYS), n, "bucket").applyInArrow(lambda t: B.answer_keys(t, hot_runs), B.SHARED)
    passages = grouped.cogroup(B.by_pid(shared, n)).applyInArrow(send, PASSAGES)
    answers = B.by_pid(passages, n, "bucket").applyInArrow(lambda t: answer_passages(t, window), ANSWERS)
    out = grouped.cogroup(B.by_pid(answers, n)).applyInArrow(apply, RESULT)
    return (expand(out) if repeated else out.drop("copies")).withColumnRenamed("id", id_col)
