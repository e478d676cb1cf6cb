"""Text operators against brute force on small tables with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import exact_dedup, near_dedup, substring_bytes, substring_words, suffix_array

EMPTY = "doc_id long, text string"


def odd_rows(seed=1, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "Ä", "日本", "x" * 30, "and", "Éa"] + [f"w{i}" for i in range(300)]
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = make(70)
    rows = [(i, make(rng.randint(0, 150))) for i in range(n)]
    rows += [(n + i, make(rng.randint(0, 30)) + "\n" + shared + "\t" + make(rng.randint(0, 30))) for i in range(20)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "a" * 3000), (204, "a" * 2500 + "b"), (205, "ab" * 900), (206, "ba" * 700), (207, shared), (208, shared), (208, shared)]
    rows += [(None, shared), (None, "alone with a null id"), (210, " ".join([shared] * 3)), (211, "long " * 4000)]
    rng.shuffle(rows)
    return rows


def clashing(frame):
    """Extra columns with the names the operators use inside."""
    return frame.withColumns({c: F.lit(7) for c in ("id", "pid", "bucket", "digest", "n", "node", "component", "kept")})


def result(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("block", [8 << 20, 3000])
def test_bytes(spark, docs, block):
    rows = odd_rows()
    got = substring_bytes.remove_repeats(clashing(docs(rows)), block_bytes=block, with_text=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    first = {}
    key = lambda i: float("inf") if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, float("inf")), key(i))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key(i):
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert result(got) == sorted(want, key=repr)


@pytest.mark.parametrize("block", [8 << 20, 3000])
def test_words(spark, docs, block):
    rows = odd_rows()
    got = substring_words.remove_repeats(clashing(docs(rows)), block_bytes=block).select("doc_id", "n_words", "n_removed", "kept_sha256")
    first = {}
    key = lambda i: float("inf") if i is None else i
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", t or "")
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            first[k] = min(first.get(k, float("inf")), key(i))
    want = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < key(i):
                gone[p : p + 50] = [True] * 50
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    assert result(got) == sorted(want, key=repr)


def test_suffix_array():
    rng = random.Random(5)
    for _ in range(150):
        n, letters, depth = rng.randint(0, 150), rng.choice([1, 2, 3, 200]), rng.choice([5, 13, 50])
        text = bytes(rng.randrange(letters) for _ in range(n)) * rng.choice([1, 1, 3])
        a = np.frombuffer(text, np.uint8)
        order = suffix_array.suffix_array(a, depth)
        assert sorted(order.tolist()) == list(range(len(text)))
        whole = [text[i : i + depth] for i in order if i + depth <= len(text)]
        assert whole == sorted(whole)
        prefixes = suffix_array.common_prefixes(suffix_array.words(a), order, depth)
        for k in range(1, len(order)):
            x, y = text[order[k - 1] :], text[order[k] :]
            same = next((i for i, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))
            assert prefixes[k] == min(same, depth)


def test_exact(spark, docs):
    rows = [(3, "a b"), (1, "ab"), (2, "a\tb "), (5, None), (6, ""), (7, " "), (9, "x"), (9, "x"), (None, "ab"), (10, "é"), (11, "é" + " " * 9)]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(clashing(docs(rows))).collect()}
    assert got == {(1, 2, 4, False), (2, 2, 4, True), (3, 2, 4, False), (None, 2, 4, False), (5, 7, 3, False), (6, 7, 3, False), (7, 7, 3, True), (9, 9, 2, True), (10, 11, 2, False), (11, 11, 2, True)}
    kept = exact_dedup.keep_one(clashing(docs(rows)))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, "a\tb "), (7, " "), (9, "x"), (11, "é" + " " * 9)]


def test_exact_index_persists(spark, docs, tmp_path):
    index = exact_dedup.DigestIndex(spark, "test_index", f"file://{tmp_path}/index", 4)
    assert {r.doc_id for r in index.ingest(docs([(1, "a"), (2, "b"), (3, "a")])).collect() if r.kept} == {1, 2}
    second = {r.doc_id: (r.keep_id, r.kept) for r in index.ingest(docs([(0, "a longer a"), (4, " a"), (5, "c")])).collect()}
    assert second == {0: (0, True), 4: (1, False), 5: (5, True)}
    assert index.rows().count() == 4
    spark.sql("DROP TABLE test_index")


def brute_groups(rows, percent):
    """Rows without an id are a document for each set, after all others."""
    sets, up = [], {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        sets.append(((i is None, sorted(s) if i is None else i), s))
    sets = [((a, tuple(b) if a else b), s) for (a, b), s in sets]

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    real = lambda x: None if x[0] else x[1]
    return sorted(((real(i), len(s), real(root(i)), i == root(i)) for i, s in sets), key=repr)


def test_near_without_ids(spark, docs):
    """Thousands of rows without an id or with one id and text: joins stay linear, texts stay apart."""
    rng = random.Random(8)
    make = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    texts = [make() for _ in range(2000)]
    rows = [(None, t) for t in texts] + [(3, texts[0] + " more"), (4, texts[5]), (9, make())] + [(9, texts[7] + " more")] * 2000
    got = {}
    for r in near_dedup._decisions(docs(rows).withColumn("th", F.lit(1)), "doc_id", "text", 5, 85, 128, 5, 4_000_000).collect():
        got.setdefault(r.id, []).append((r.component, r.kept))
    assert sorted(map(repr, got[None])) == sorted(map(repr, [(3, False), (4, False), (9, False)] + [(None, True)] * 1997))
    assert got[3] == [(3, True)] and got[4] == [(4, True)] and got[9] == [(9, True)] * 2001
    kept = near_dedup.keep_one(docs(rows).withColumns({"th": F.lit(1), "id": F.lit(2)}), percent=85, rows=5)
    assert kept.count() == 1997 + 2 + 2001 and kept.columns == ["doc_id", "text", "th", "id"]


@pytest.mark.parametrize("hot", [1 << 16, 40, 0])
def test_repeated_rows(spark, docs, hot):
    """One row makes up most of the table, another all without an id; keys that many blocks hold."""
    rng = random.Random(6)
    make = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    common, shared = "the same long phrase in every text", make(60)
    base = [(i, f"{make(30)} {common} {make(30)} {shared if i % 4 == 0 else make(9)}") for i in range(80)]
    rows = base + [base[8]] * 2000 + [(None, shared)] * 2000 + [(None, None)] * 50
    once = substring_bytes.remove_repeats(docs(base + [base[8], (None, shared), (None, None)]), block_bytes=2000, hot_runs=10**9)
    single = {tuple(r) for r in once.collect()}
    got = result(substring_bytes.remove_repeats(docs(rows), block_bytes=2000, hot_runs=hot))
    assert len(got) == len(rows) and set(got) == single
    words = substring_words.remove_repeats(docs(rows), block_bytes=2000).collect()
    assert len(words) == len(rows) and sum(r.doc_id is None and r.n_removed == 60 for r in words) == 2000


@pytest.mark.parametrize("size", [4_000_000, 400])
def test_near(spark, docs, size):
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = odd_rows(3, 20)
    for i in range(40):  # a chain of near copies around one text
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(9)}"
        rows.append((300 + i, " ".join(w).upper() if i % 2 else "\n".join(w)))
    rows += [(400, "one two"), (401, "ONE  two"), (402, "one two three four five"), (403, "two one")]
    got = near_dedup.near_groups(clashing(docs(rows)), task_shingles=size).select("doc_id", "n_shingles", "component_id", "kept")
    assert result(got) == brute_groups(rows, 85)
    if size > 400:
        for percent in (60, 85):
            sure = near_dedup.near_groups(clashing(docs(rows)), percent=percent, task_shingles=size, exact=True).select("doc_id", "n_shingles", "component_id", "kept")
            assert result(sure) == brute_groups(rows, percent)


def test_least_hashes():
    """Any two sets as similar as asked share one of their least hashes."""
    rng = np.random.default_rng(4)
    for _ in range(3000):
        percent, n = int(rng.integers(50, 100)), int(rng.integers(1, 40))
        pool = np.unique(rng.integers(0, 1 << 63, 2 * n).astype(np.uint64))
        a, b = (np.sort(rng.permutation(pool)[: int(rng.integers(1, len(pool) + 1))]) for _ in range(2))
        if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
            assert set(near_dedup.least_hashes(a, percent)) & set(near_dedup.least_hashes(b, percent))


def test_estimates():
    rng = np.random.default_rng(0)
    mul, add = near_dedup.constants(128)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    for keep in (1000, 900, 500, 0):
        b = np.concatenate((a[:keep], rng.integers(0, 1 << 63, 1000 - keep).astype(np.uint64)))
        sigs = np.frombuffer(b"".join(near_dedup.pack_low_bits(near_dedup.minima(x, mul, add)) for x in (a, b)), np.uint64).reshape(2, -1)
        assert abs(near_dedup.estimates(sigs[0], sigs[1:], 128)[0] - keep / (2000 - keep)) < 0.2


def test_empty_tables(docs):
    none = docs([])
    assert substring_bytes.remove_repeats(none).count() == 0
    assert substring_words.remove_repeats(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert near_dedup.near_groups(none).count() == 0
