"""Blocks of whole texts, and messages between blocks and buckets of hashes.

Both repeated-substring operators work the same way. Documents are dealt once
to blocks of a few megabytes by a hash of the row, one block to a partition;
that shuffle is used again by each later step of the same plan, and messages are
dealt alike, so texts move once. A block sends packed messages to buckets
of hashes, one entry per distinct value and block, so a value that a third of
all documents share costs one entry per block; buckets answer to the blocks.
No group therefore grows with the number of copies of anything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, pieces_of, text_or_empty

#: Stands for a null id: larger than any other.
NO_ID = np.iinfo(np.int64).max
#: Numbers of the multiplicative hashes: odd, fixed.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
SLAB = 1 << 16


#: Bytes of a block, whatever the corpus: it must fit in a Python worker several times.
BLOCK = 8 << 20


def deal(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK) -> tuple[DataFrame, int, bool]:
    """(pid, id, text, copies) dealt to blocks of about ``block_bytes``, one to
    a partition; their number; whether any row stands for several.

    Rows with one id and text have one place, so those that make up more than
    one in ``HOT`` of all rows are first combined to a single row.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    total, many = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    n = pieces_of(int(total or 0), block_bytes)
    key = F.xxhash64("id", "text")
    often = rows.groupBy(key.alias("k")).count().where((F.col("count") > 1) & (F.col("count") * HOT > many))
    hot = [r["k"] for r in often.select("k").collect()]  # fewer than HOT
    dealt = rows.withColumn("copies", F.lit(1).cast("long"))
    if hot:
        once = rows.where(key.isin(hot)).groupBy("id", "text").agg(F.count(F.lit(1)).alias("copies"))
        dealt = dealt.where(~key.isin(hot)).unionByName(once)
    dealt = dealt.select(F.pmod(key, F.lit(n)).cast("int").alias("pid"), "id", "text", "copies")
    return dealt.repartitionById(n, "pid"), n, bool(hot)


def by_pid(messages: DataFrame, n: int, name: str = "pid"):
    """Messages grouped as :func:`deal` has dealt the texts: one key to a partition."""
    return messages.repartitionById(n, name).groupBy(name)


class Block:
    """The texts of one block in a fixed order, as one buffer of bytes."""

    def __init__(self, table: pa.Table):
        ids, copies = table.column("id").to_pylist(), table.column("copies").to_pylist()
        texts = table.column("text").cast(pa.binary()).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (NO_ID if ids[i] is None else ids[i], texts[i]))
        self.raw_ids = [ids[i] for i in order]
        self.copies = [copies[i] for i in order]
        self.ids = np.array([NO_ID if x is None else x for x in self.raw_ids], np.int64)
        self.texts = [texts[i] for i in order]
        lengths = np.fromiter(map(len, self.texts), np.int64, len(order))
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.data = b"".join(self.texts)

    def bytes(self) -> np.ndarray:
        return np.frombuffer(self.data, np.uint8)


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp style hashes of every ``k`` consecutive values, modulo 2^64.

    Built by doubling: the hash of 2j values is that of the first j times a
    constant plus that of the last j, so no powers or inverses are needed.
    """
    done, width, out, have = {1: values * MIX[0]}, 1, None, 0
    while width * 2 <= k:
        h = done[width]
        n = len(h) - width
        done[width * 2] = h[:n] * (MIX[1] + np.uint64(4 * width)) + h[width:]
        done[width * 2] ^= done[width * 2] >> np.uint64(31)
        width *= 2
    for width in sorted(done, reverse=True):
        if k - have >= width:
            h = done[width]
            if out is None:
                out = h
            else:
                n = len(h) - have
                out = out[:n] * MIX[2] + h[have:]
            have += width
    out = (out ^ (out >> np.uint64(32))) * MIX[3]
    return out ^ (out >> np.uint64(29))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while k * 2 <= width:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    return np.minimum(h[: len(h) - (width - k)], h[width - k :]) if k < width else h


def anchored_runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, gram: int):
    """Runs of consecutive window starts that have the same least gram hash.

    Equal windows have equal least hashes, so all copies of a window meet
    under one key, while only one key per run of starts is sent. Returns
    (start, end, key, document) arrays; windows never cross documents.
    """
    out = []
    total = len(values)
    for a in range(0, max(total - window + 1, 0), SLAB):
        part = values[a : a + SLAB + window - 1].astype(np.uint64)
        least = sliding_min(gram_hashes(part, gram), window - gram + 1)
        n = len(least)
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(least[1:], least[:-1], out=new[1:])
        for edge in (starts, ends - window + 1):
            lo, hi = np.searchsorted(edge, (a, a + n)) if edge is starts else (None, None)
            inside = edge[lo:hi] if edge is starts else edge[(edge >= a) & (edge < a + n)]
            new[inside - a] = True
        at = np.flatnonzero(new)
        out.append((at + a, np.append(at[1:], n) + a, least[at]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    at, end, key = (np.concatenate(x) for x in zip(*out))
    # empty documents share their start with the next one: take the last
    doc = np.searchsorted(starts, at, "right") - 1
    ok = at + window <= ends[doc]
    return at[ok], end[ok], key[ok], doc[ok]


def window_hashes(values: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The hashes of the windows that start at ``at`` (ascending)."""
    out = np.empty(len(at), np.uint64)
    for a in np.unique(at // SLAB).tolist():
        x, y = np.searchsorted(at, (a * SLAB, (a + 1) * SLAB))
        out[x:y] = gram_hashes(values[a * SLAB : (a + 1) * SLAB + window - 1].astype(np.uint64), window)[at[x:y] - a * SLAB]
    return out


LOW48 = np.uint64((1 << 48) - 1)


def pack48(keys: np.ndarray) -> bytes:
    """48-bit keys as 32 and 16 low bits; a clash only adds candidates."""
    return (keys & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (keys >> np.uint64(32)).astype("<u2").tobytes()


def unpack48(data: bytes) -> np.ndarray:
    n = len(data) // 6
    low = np.frombuffer(data, "<u4", n).astype(np.uint64)
    return low | (np.frombuffer(data, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32))


KEYS = "bucket int, pid int, one binary, many binary, often binary, runs binary"
#: Runs of a key in one block beyond which their number is sent along.
OFTEN = 32


def send_keys(pid: int, key: np.ndarray, doc_id: np.ndarray, buckets: int) -> pa.Table:
    """The distinct keys of a block: those of one document, those of several; and
    the number of runs of keys that have many."""
    key = key & LOW48
    order = np.lexsort((doc_id, key))
    key, doc_id = key[order], doc_id[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    end = np.append(first[1:], len(key))
    several = doc_id[first] != doc_id[end - 1] if len(key) else np.zeros(0, bool)
    key, runs = key[first], end - first if len(key) else first
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    key, several, bucket, runs = key[order], several[order], bucket[order], runs[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(key) else []
    rows = []
    for a, b in zip(cut, np.append(cut[1:], len(key)) if len(key) else []):
        k, s, n = key[a:b], several[a:b], runs[a:b]
        often = n > OFTEN
        rows.append((int(bucket[a]), pid, pack48(k[~s]), pack48(k[s]), pack48(k[often]), n[often].astype("<u4").tobytes()))
    cols = list(zip(*rows)) or [()] * 6
    kinds = [pa.int32()] * 2 + [pa.binary()] * 4
    return pa.table([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in KEYS.split(", ")])


SHARED = "pid int, keys binary, hot binary"


def answer_keys(table: pa.Table, hot_runs: int) -> pa.Table:
    """To each block those of its keys that several documents hold, and which
    of them have more than ``hot_runs`` runs, one for each block at least."""
    pids = table.column("pid").to_pylist()
    one, many, often = ([unpack48(x) for x in table.column(c).to_pylist()] for c in ("one", "many", "often"))
    every, n = np.unique(np.concatenate(one + many), return_counts=True)
    shared = np.union1d(every[n > 1], np.concatenate(many))
    runs = n.astype(np.int64)
    more = np.frombuffer(b"".join(table.column("runs").to_pylist()), "<u4").astype(np.int64)
    np.add.at(runs, np.searchsorted(every, np.concatenate(often)), more)
    hot = every[runs > hot_runs]
    rows = []
    for p, o, m in zip(pids, one, many):
        k = np.concatenate((o[np.isin(o, shared, assume_unique=True)], m))
        if len(k):
            rows.append((p, pack48(k), np.packbits(np.isin(k, hot)).tobytes()))
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["pid", "keys", "hot"])


def shared_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The keys that other documents hold too; those of them that are hot."""
    keys = [unpack48(x) for x in table.column("keys").to_pylist()]
    hot = [k[np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool)] for k, x in zip(keys, table.column("hot").to_pylist())]
    none = np.zeros(0, np.uint64)
    return (np.unique(np.concatenate(keys)), np.unique(np.concatenate(hot))) if keys else (none, none)


def is_in(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(keys), bool)
    keys = keys & LOW48
    at = np.searchsorted(among, keys)
    at[at == len(among)] = 0
    return among[at] == keys
