"""Near-duplicate groups by b-bit MinHash, confirmed on full shingle sets.

Texts with equal shingle sets form one class. The minima of ``slots`` hashes
give band keys, which generate candidates, and their low bits, packed, give a
collision-corrected estimate of similarity by counting bits. Classes that share
a band key are joined to the least class of the key, never in pairs; the
components of these links hold every link between different texts. Within a
component a breadth-first search over packed signatures and then full sets
finds the true groups; a component too large for one task is cut into blocks
and its pairs of blocks are searched apart, giving spanning links only.

Words are runs of characters other than U+0020 and U+0009 to U+000D, A to Z in
lower case. The share of true links with similarity s that no band generates is
(1 - s^rows)^bands, at most 5e-7 at 0.85 with the defaults. With ``exact`` no link
is lost: sets as similar as asked share one of their least hashes, of which each
set then sends as many as that takes instead of its bands, and no estimate decides.

Defined results: a null or blank text has an empty set and is linked with
nothing; a text with fewer words than a shingle has one shingle, the whole
sequence; rows with one id are one document, which all their texts link; rows
without an id are a document for each set, and where a group has no row with an
id its component is null and the rows with the first such set stay; ids are
below 2 ** 62; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import fresh_name, join_skewed, materialise, pieces_of, shuffle_partitions, text_or_empty
from .components import connected_components

SIGNED = "id long, th long, fp1 long, fp2 long, n long, bands array<long>, sig binary"
#: Documents without an id are numbered from here on, by the fingerprint of their set.
NAMELESS = 1 << 62
#: Estimates that fall short of the limit by more than this are not confirmed: 7 standard errors at 128 slots.
SLACK = 0.25


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words = [t.lower().split() for t in texts]  # of bytes: A to Z only, and the stated blanks
    seen: dict[bytes, int] = {}
    count = [len(w) for w in words]
    at = np.fromiter((seen.setdefault(w, len(seen)) for w in chain.from_iterable(words)), np.int64, sum(count))
    if not len(at):
        return [np.zeros(0, np.uint64) for _ in texts]
    values = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))[at]
    full = B.gram_hashes(values, width) if len(values) >= width else None
    out, a = [], 0
    for n in count:
        if n >= width:
            out.append(np.unique(full[a : a + n - width + 1]))
        elif n:
            out.append(B.gram_hashes(values[a : a + n], n) ^ B.MIX[n % 4])
        else:
            out.append(np.zeros(0, np.uint64))
        a += n
    return out


def constants(slots: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240101)
    return rng.integers(0, 1 << 31, slots, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, slots, np.uint32)


def minima(values: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    x = (values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32)
    out = np.full(len(mul), np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(x), 1024):
        np.minimum(out, (mul[:, None] * x[None, a : a + 1024] + add[:, None]).min(axis=1), out=out)
    return out


def pack_low_bits(low: np.ndarray) -> bytes:
    """Four low bits of each minimum, two to a byte."""
    low = (low & 15).astype(np.uint8)
    return (low[0::2] | low[1::2] << 4).tobytes()


def estimates(one: np.ndarray, many: np.ndarray, slots: int) -> np.ndarray:
    """Similarity of ``one`` packed signature (uint64 words) with ``many``."""
    d = many ^ one
    d |= d >> np.uint64(2)
    d |= d >> np.uint64(1)
    d &= np.uint64(0x1111111111111111)
    same = 1 - np.bitwise_count(d).sum(axis=1) / slots
    return (same - 1 / 16) / (1 - 1 / 16)  # unequal minima agree in four bits once in sixteen


def least_hashes(s: np.ndarray, percent: int) -> list[int]:
    """So many of the least of the sorted ``s`` that any set as similar has one of them among its own."""
    n = len(s)
    return s[: n - -(-percent * n // 100) + 1].view(np.int64).tolist() if n else []


def sign(docs: DataFrame, width: int, slots: int, rows: int, exact_percent: int | None = None) -> DataFrame:
    """One row per document: fingerprint and size of its set, bands (or, if
    ``exact_percent`` is given, least hashes), signature."""
    mul, add = constants(slots)
    bands = slots // rows

    def run(batches):
        for batch in batches:
            ids, hashes = batch.column("id").to_pylist(), batch.column("th").to_pylist()
            texts = batch.column("text").cast(pa.binary())
            for a in range(0, len(ids), 256):
                out = []
                for i, h, s in zip(ids[a : a + 256], hashes[a : a + 256], shingle_sets(texts[a : a + 256].to_pylist(), width)):
                    low = minima(s, mul, add)
                    fp = xxhash.xxh3_128_digest(s.tobytes())
                    keys = [int.from_bytes(xxhash.xxh3_64_digest(low[k * rows : k * rows + rows].tobytes(), k), "little", signed=True) for k in range(bands)] if len(s) else []
                    if exact_percent is not None:
                        keys = least_hashes(s, exact_percent)
                    out.append((i, h, int.from_bytes(fp[:8], "little", signed=True), int.from_bytes(fp[8:], "little", signed=True), len(s), keys, pack_low_bits(low)))
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.binary()]
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=["id", "th", "fp1", "fp2", "n", "bands", "sig"])

    return docs.mapInArrow(run, SIGNED)


def groups_within(ids: list[int], sets: list[np.ndarray], sigs: np.ndarray, percent: int, slots: int, slack: float = SLACK) -> list[int]:
    """The least id of the linked group of each set, by breadth-first search."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, at = np.unique(np.concatenate(sets), return_inverse=True)
    token = np.split(at.astype(np.int32), np.cumsum(size)[:-1])
    mark = np.zeros(len(flat), bool)
    order = sorted(range(len(ids)), key=ids.__getitem__)
    left = np.array(order)
    out = [0] * len(ids)
    while len(left):
        root, left = int(left[0]), left[1:]
        queue = [root]
        while queue:
            x = queue.pop()
            out[x] = ids[root]
            if not len(left):
                continue
            n = size[left]
            # a link needs sizes within the limit of each other, too
            near = np.flatnonzero((100 * np.minimum(n, size[x]) >= percent * np.maximum(n, size[x])) & (estimates(sigs[x], sigs[left], slots) >= percent / 100 - slack))
            linked = []
            mark[token[x]] = True
            for a in range(0, len(near), 4096):
                some = left[near[a : a + 4096]]
                edge = np.append(0, np.cumsum(size[some])[:-1])
                both = np.add.reduceat(mark[np.concatenate([token[y] for y in some.tolist()])], edge, dtype=np.int64)
                linked.append(near[a : a + 4096][100 * both >= percent * (size[x] + size[some] - both)])
            mark[token[x]] = False
            if linked and len(hit := np.concatenate(linked)):
                queue.extend(left[hit].tolist())
                left = np.delete(left, hit)
    return out


FOUND = "node long, root long"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, text): ``th`` tells the texts of one id, or of none, apart."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _decisions(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, slots: int, rows: int, task_shingles: int, exact: bool = False) -> DataFrame:
    """(id, th, n, component, kept) of each row."""
    source = _rows(docs, id_col, text_col)
    signed = materialise(sign(source, width, slots, rows, percent if exact else None), "signed")
    full = signed.where("n > 0")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th"))
    classes = full.groupBy("fp1", "fp2").agg(first.alias("r"), F.count(F.lit(1)).alias("many"))
    nameless = F.col("fp1").bitwiseAND(F.lit(NAMELESS - 1)).bitwiseOR(F.lit(NAMELESS))
    classes = materialise(classes.select("fp1", "fp2", "many", F.col("r.id").alias("rid"), F.col("r.th").alias("rth"), F.coalesce("r.id", nameless).alias("node")), "classes")
    of = classes.select(F.col("fp1").alias("f1"), F.col("fp2").alias("f2"), "rid", "rth", "node")
    same = F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth"))
    own = full.join(of, (F.col("fp1") == F.col("f1")) & (F.col("fp2") == F.col("f2")) & same).drop("f1", "f2", "id", "th").dropDuplicates(["fp1", "fp2"])
    keys = own.select("node", F.explode("bands").alias("key"))
    least = keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    links = keys.join(least, "key").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    repeated = full.groupBy("id", "th").count().where("count > 1").limit(1).count() > 0
    found = _confirm(source, own, connected_components(links), width, percent, slots, task_shingles, repeated, exact)
    # rows with one id and several texts link these
    named = full.where("id is not null")
    several = named.groupBy("id").agg(F.min(F.struct("fp1", "fp2")).alias("a"), F.max(F.struct("fp1", "fp2")).alias("b")).where("a <> b").select("id")
    tied = materialise(named.join(several, "id").join(classes, ["fp1", "fp2"]).select(F.col("id").alias("u"), F.col("node").alias("v")), "tied")
    if tied.limit(1).count():
        merged = connected_components(tied.unionByName(found.select(F.col("node").alias("u"), F.col("root").alias("v"))))
        found = merged.select("node", F.col("component").alias("root"))
    ends = materialise(classes.join(found, "node", "left").select("fp1", "fp2", "many", "node", F.coalesce("root", "node").alias("component")), "ends")
    total = ends.agg(F.sum("many")).first()[0] or 0
    out = join_skewed(full.select("id", "th", "n", "fp1", "fp2"), ends, ["fp1", "fp2"], "many", total)
    nameless_first = (F.col("node") >= NAMELESS) & (F.col("node") == F.col("component"))
    kept = F.when(F.col("id").isNull(), nameless_first).otherwise(F.col("id") == F.col("component"))
    out = out.select("id", "th", "n", F.when(F.col("component") < NAMELESS, F.col("component")).alias("component"), kept.alias("kept"))
    return out.unionByName(signed.where("n = 0").select("id", "th", "n", F.col("id").alias("component"), F.lit(True).alias("kept")))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85, slots: int = 128, rows: int = 5, task_shingles: int = 4_000_000, exact: bool = False) -> DataFrame:
    """One row per document: the id, n_shingles, component_id, kept.

    ``percent`` is the least similarity of a link, in hundredths. ``exact``: no
    link may be lost, at the cost of more candidates.
    """
    out = _decisions(docs, id_col, text_col, width, percent, slots, rows, task_shingles, exact)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, slots: int = 128, rows: int = 4, task_shingles: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are."""
    own_id, own_hash = fresh_name(docs, "id"), fresh_name(docs, "th")
    gone = _decisions(docs, id_col, text_col, width, percent, slots, rows, task_shingles).where("not kept")
    gone = gone.select(F.col("id").alias(own_id), F.col("th").alias(own_hash)).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(text_or_empty(text_col)) == F.col(own_hash))
    return docs.join(gone, same, "left_anti")


def _confirm(source: DataFrame, own: DataFrame, coarse: DataFrame, width: int, percent: int, slots: int, task_shingles: int, repeated: bool, exact: bool = False) -> DataFrame:
    """(node, root) of the true groups within the components of candidates.

    ``repeated``: some rows have one id and text; one of them is read.
    """
    members = own.select("node", "rid", "rth", "n", "sig").join(coarse, "node")
    members = materialise(members, "members")
    sizes = members.groupBy("component").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("many"))
    sizes = materialise(sizes.withColumn("blocks", F.ceil(F.col("total") / task_shingles).cast("int")), "sizes")
    total, cut = sizes.agg(F.sum("total"), F.count_if(F.col("blocks") > 1)).first()
    bins = pieces_of(int(total or 0), task_shingles // 4)
    members = members.join(sizes.select("component", "blocks"), "component")
    # pairs of blocks: a member of block b is needed with each other block
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    members = members.withColumn("bin", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.xxhash64("component", "i", "j")))
    members = members.select("node", "rid", "rth", "sig", "component", "i", "j", "bin")
    rows = source.join(members, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")))
    if repeated:
        rows = rows.dropDuplicates(["node", "rth", "i", "j"])
    rows = rows.drop("id", "th", "rid", "rth").repartition(max(bins, shuffle_partitions(source.sparkSession)), "bin")

    def run(table: pa.Table) -> pa.Table:
        place = list(zip(*(table.column(c).to_pylist() for c in ("component", "i", "j"))))
        ids, sigs = (table.column(c).to_pylist() for c in ("node", "sig"))
        texts = table.column("text").cast(pa.binary())
        by: dict[tuple, list] = {}
        for a in range(0, len(ids), 256):
            for k, s in enumerate(shingle_sets(texts[a : a + 256].to_pylist(), width), a):
                by.setdefault(place[k], []).append((ids[k], s, sigs[k]))
        node, root = [], []
        for group in by.values():
            own_ids = [g[0] for g in group]
            packed = np.frombuffer(b"".join(g[2] for g in group), np.uint64).reshape(len(group), -1)
            node += own_ids
            root += groups_within(own_ids, [g[1] for g in group], packed, percent, slots, 2.0 if exact else SLACK)
        return pa.table([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["node", "root"])

    found = materialise(rows.groupBy("bin").applyInArrow(run, FOUND), "found")
    shared_ids = found.groupBy("node").agg(F.count_distinct("root").alias("k")).where("k > 1").limit(1).count()
    if cut or shared_ids:
        merged = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
        return merged.withColumnRenamed("component", "root")
    return found.where("node <> root").distinct()
