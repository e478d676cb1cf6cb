"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Packing needs only how many pieces have each length, a table of at most
``capacity`` rows. On it, small sets of pieces that provably dominate every
other set with the same largest piece are fixed as sequences (reduction);
what remains is packed best-fit decreasing. Both act on counts, so the plan is
a list of ranges whose size depends on the capacity and not on the corpus.
Pieces then take their places by rank within their length; ranks come from
counts per (length, part), so no length, however common, meets in one task.

Defined results: a null text is empty and gives the end token alone; a null id
is kept; repeated rows are packed each on its own; an empty table gives no
rows; texts are taken whole; other columns are not read. Pieces of a document
cut into several are ``capacity`` long except that the first may be shorter.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

PIECES = "id long, piece int, start long, length long, ids_crc32 long"
#: A number by which pieces are dealt to parts; rows with one id get different ones.
DEALT = ", deal int"
#: Beyond these characters regular expression engines may differ on classes.
PLAIN = re.compile("[\x00-ɏ]*")


@cache
def _tokenizers(path: str):
    """(fast encoder, the file's own encoder, texts of its added tokens) of one byte-level BPE file."""
    import tiktoken
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    model, added = content["model"]["vocab"], [t["content"] for t in content.get("added_tokens", [])]
    # the byte alphabet: printable bytes stand for themselves, the others follow from U+0100
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    assert set(byte_of) == set(ByteLevel.alphabet())
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model.items() if all(c in byte_of for c in token) and token not in added}
    from public_tokenizers import PATTERN

    fast = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast, Tokenizer.from_file(path), added


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Token ids of each text, as the tokenizer file says: the text of an added
    token, such as the one that ends texts, is that token."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    fast, exact, added = _tokenizers(path)
    out = []
    for t in texts:
        ids = fast.encode_ordinary(t) if PLAIN.fullmatch(t) and not any(a in t for a in added) else exact.encode(t, add_special_tokens=False).ids
        out.append(np.array(ids, "<u4"))
    return out


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``n`` ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((a, a + capacity) for a in range(first, n, capacity))] if n else []


def reduce_counts(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets of at most three pieces; ``counts`` is reduced.

    Returns (lengths, number of sequences) in the order they were fixed. Sets:
    the largest piece x alone if nothing fits beside it; x with y, the largest
    that fits, if they fill the sequence or nothing more could ever stand
    beside x; x, y and the largest b that fits beside them, if no other pair
    beside x is better than (y, b).
    """
    fixed = []

    def largest(upto: int) -> int:
        upto = min(upto, capacity)
        found = np.flatnonzero(counts[1 : upto + 1]) if upto > 0 else []
        return int(found[-1]) + 1 if len(found) else 0

    def take(*lengths: int) -> None:
        need = {x: lengths.count(x) for x in lengths}
        n = min(int(counts[x]) // k for x, k in need.items())
        for x, k in need.items():
            counts[x] -= n * k
        fixed.append((lengths, n))

    changed = True
    while changed:
        changed = False
        for x in np.flatnonzero(counts)[::-1].tolist():
            while counts[x]:
                room = capacity - x
                counts[x] -= 1  # the one that x itself takes
                y = largest(room)
                small = np.flatnonzero(counts)[:3].tolist()
                low = [s for s in small for _ in range(min(3, int(counts[s])))][:3]
                counts[x] += 1
                if not y:
                    take(x)
                elif y == room or len(low) < 2 or low[0] + low[1] > room:
                    take(x, y)
                elif len(low) < 3 or sum(low) > room:
                    counts[x] -= 1
                    counts[y] -= 1
                    b = largest(room - y)
                    counts[y] += 1
                    ok = bool(b)
                    for c in np.flatnonzero(counts[: y + 1]).tolist() if ok else []:
                        counts[c] -= 1
                        d = min(largest(room - c), c)
                        d = largest(d)
                        counts[c] += 1
                        ok &= d <= b or c + d <= y
                    counts[x] += 1
                    if not ok:
                        break
                    take(x, y, b)
                else:
                    break
                changed = True
    return fixed


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Ranges (length, first rank, count, first sequence, offset); sequences.

    The piece of a length with rank first + i goes to sequence first + i.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    ranges: list[tuple[int, int, int, int, int]] = []
    used = np.zeros(capacity + 1, np.int64)
    sequences = 0

    def place(length: int, n: int, sequence: int, offset: int) -> None:
        ranges.append((length, int(used[length]), n, sequence, offset))
        used[length] += n

    room: dict[int, list[tuple[int, int]]] = {}  # space left -> (first sequence, count)
    for lengths, n in reduce_counts(counts, capacity):
        if n:
            offset = 0
            for length in lengths:
                place(length, n, sequences, offset)
                offset += length
            sequences += n
    for length in range(capacity, 0, -1):
        n = int(counts[length])
        while n:
            fits = min((r for r in room if r >= length), default=0)
            if fits:
                first, many = room[fits].pop()
                if not room[fits]:
                    del room[fits]
            else:
                fits, first, many = capacity, sequences, -(-n // (capacity // length))
                sequences += many
            each = fits // length
            whole = min(many, n // each)
            for j in range(each if whole else 0):
                place(length, whole, first, capacity - fits + j * length)
            if whole:
                room.setdefault(fits - each * length, []).append((first, whole))
            n -= whole * each
            first, many = first + whole, many - whole
            if many and n:  # the last sequence takes what is left
                for j in range(n):
                    place(length, 1, first, capacity - fits + j * length)
                room.setdefault(fits - n * length, []).append((first, 1))
                first, many, n = first + 1, many - 1, 0
            if many:
                room.setdefault(fits, []).append((first, many))
            room.pop(0, None)
    out = np.array(ranges, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))], sequences


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str, text_col: str, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``ids`` (array) too if asked for."""

    def run(batches):
        count = itertools.count()
        for batch in batches:
            ids = batch.column("id").to_pylist()
            texts = batch.column("text")
            for a in range(0, len(ids), 64):
                rows = []
                for i, tokens in zip(ids[a : a + 64], encode(texts[a : a + 64].to_pylist(), tokenizer_path)):
                    tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                    for k, (x, y) in enumerate(cut(len(tokens), capacity)):
                        part = tokens[x:y]
                        rows.append((i, k, x, y - x, zlib.crc32(part.tobytes()), next(count) & 0x7FFFFFFF, *((part,) if with_ids else ())))
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())]
                names = ["id", "piece", "start", "length", "ids_crc32", "deal", "ids"]
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names[: len(cols)])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES + DEALT + (", ids array<int>" if with_ids else ""))


def ranked(pieces: DataFrame, rows_in_part: int) -> DataFrame:
    """``pieces``, a written table, with ``rank``, from 0 within each length."""
    total = pieces.count()
    parts = max(1, -(-total // rows_in_part))
    split = pieces.withColumn("part", F.pmod(F.xxhash64("deal", "id"), F.lit(parts)))
    sizes = split.groupBy("length", "part").count()
    before = F.sum("count").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("length", "part").orderBy("id", "piece", "start", "ids_crc32", "deal"))
    return split.withColumn("own", own).join(sizes, ["length", "part"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("part", "own", "before")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, rows_in_part: int = 200_000) -> DataFrame:
    """Place every piece of ``docs`` in a sequence of at most ``capacity``.

    Columns: the id, piece, start, length, ids_crc32, sequence_id, offset, and
    ids if asked for.
    """
    pieces = materialise(tokenise(docs, tokenizer_path, end_id, capacity, id_col, text_col, with_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    ranges, _ = plan(histogram, capacity)
    wide = np.int64(1) << 48
    key = ranges[:, 0] * wide + ranges[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length * wide + rank, "right") - 1
            found = ranges[at]
            names = [n for n in batch.schema.names if n != "rank"]
            cols = [batch.column(n) for n in names] + [pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])]
            yield pa.record_batch(cols, names=[*names, "sequence_id", "offset"])

    rows = ranked(pieces, rows_in_part)
    rows = rows.select(*(c for c in pieces.columns if c != "deal"), "rank")
    schema = PIECES + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
