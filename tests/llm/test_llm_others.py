"""Archives, mixing, packing, counts, languages, neighbours, pipeline."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from runlens.llm import graphs, language_id, mixing, neighbours, packing, queries, token_counts, warc
from runlens.llm.common import new_path

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def clashing(frame):
    return frame.withColumns({c: F.lit(7) for c in ("id", "digest", "size", "body", "node", "length", "rank", "label", "part") if c not in frame.columns})


def test_warc(spark):
    big, other = "é" * 600 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n", "y" * 1000
    rows = [(1, "http://a", big), (7, "http://b c\n", big), (3, None, other), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (8, "u", ""), (None, "u", other), (9, "u", other), (9, "u", other)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    path = warc.write_archives(pages, new_path(spark, "archives"), file_bytes=2000)
    records = warc.read_archives(spark, path).persist()
    got = warc.resolve_revisits(records).collect()
    size = lambda t: len((t or "").encode())
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = []
    for i, _, t in rows:
        target = {sha(big): 7, sha(other): 9}.get(sha(t)) if size(t) >= 1000 else None
        want.append([i, size(t), sha(t), "revisit" if target not in (None, i) else "response", target if target != i else None])
    want[-1][3:] = ["revisit", 9]  # the second of two equal rows refers to the first
    assert sorted(map(repr, [[r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to] for r in got])) == sorted(map(repr, want))
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got)
    lost = records.drop("payload", "url").persist()
    assert {(r.page_id, r.payload_bytes) for r in warc.resolve_revisits(lost, ("payload_bytes",)).collect()} == {(r.page_id, r.payload_bytes) for r in got}
    assert {r.url for r in got} == {"http://a", "http://b%20c%20", None, "u"}
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0), new_path(spark, "archives"))).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"))


def test_warc_files_and_hot_payloads(spark):
    """No file above its bound but for a longer record; one payload of most pages; repeated rows of it."""
    copy = "c" * 1500
    rows = [(i, f"u{i}", copy) for i in range(2000)] + [(1999, "same", copy)] * 300 + [(None, None, copy)] * 2000 + [(5000 + i, None, "é" * n) for i, n in enumerate((10, 700, 90_000, 20_000, 20_001))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.write_archives(pages, new_path(spark, "archives"), file_bytes=20_000)
    sizes = [len(zlib.decompress(bytes(r.content), 31)) for r in spark.read.format("binaryFile").load(path + "/*.gz").select("content").collect()]
    assert sum(n > 20_000 for n in sizes) == 3 and max(sizes) < 182_000
    records = warc.read_archives(spark, path).drop("payload").persist()
    kinds = records.groupBy("record_type").count().collect()
    assert {r.record_type: r["count"] for r in kinds} == {"response": 6, "revisit": 4299}
    got = warc.resolve_revisits(records, ("payload_bytes",)).collect()
    assert len(got) == len(rows)
    again = [r for r in got if r.record_type == "revisit"]
    assert {(r.refers_to, r.payload_bytes) for r in again} == {(1999, 1500)}
    assert sum(r.page_id is None for r in again) == 2000 and sum(r.page_id == 1999 for r in again) == 300


def waterfill(budget, children):
    """Shares by weight under capacities, to within a token."""
    given, open_ = {}, dict(children)
    while open_:
        left, weight = budget - sum(given.values()), sum(w for _, w in open_.values())
        full = {k for k, (c, w) in open_.items() if c * weight <= w * left}
        if not full:
            return given | {k: left * w / weight for k, (c, w) in open_.items()}
        given |= {k: open_.pop(k)[0] for k in full}
    return given


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 400) if i % 11 else None, rng.choice(["a", "a", "a", "b", None]), rng.choice("pqr")) for i in range(400)] + [(5, "repeat", "a", "p")] * 2
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, top string, low string"))
    weights = spark.createDataFrame([("top", "a", 1), ("top", "b", 3), ("low", "q", 4), ("low", "r", 0)], "level string, value string, weight long")
    got = mixing.mix(docs, ["top", "low"], weights, 0.5, max_epochs=2, seed=3).collect()
    tokens = lambda t: -(-len(t or "") // 4)
    size = {}
    for _, t, a, b in rows:
        size[a or "", b] = size.get((a or "", b), 0) + tokens(t)
    w = {"a": 1, "b": 3, "q": 4, "r": 0}
    tops = sorted({a for a, _ in size})
    cap = {a: sum(2 * n for (x, b), n in size.items() if x == a and w.get(b, 1)) for a in tops}
    given = waterfill(int(sum(size.values()) * 0.5), {a: (cap[a], w.get(a, 1)) for a in tops})
    taken = {}
    for r in got:
        taken[r.top, r.low] = taken.get((r.top, r.low), 0) + r.taken
        assert 0 < r.taken <= r.doc_tokens and r.epoch < 2 + 1
    for a in tops:
        leaves = waterfill(given[a], {b: (2 * n, w.get(b, 1)) for (x, b), n in size.items() if x == a and w.get(b, 1)})
        for b, n in leaves.items():
            assert abs(taken.get((a, b), 0) - n) <= 3
    assert not any(b == "r" for _, b in taken)
    assert sum(taken.values()) == int(sum(size.values()) * 0.5)
    cut = [r for r in got if r.taken < r.doc_tokens]
    assert len(cut) <= len(taken)  # at most one document of a leaf is cut
    assert mixing.mix(docs.limit(0), ["top", "low"], weights, 0.5).count() == 0


def test_mixing_without_ids(spark):
    """Rows without an id and rows with one id: counted, cut once, texts of a prefix cut to whole characters."""
    rng = random.Random(9)
    rows = [(None, "é" * rng.randint(1, 50), "a") for _ in range(500)] + [(7, "same text", "a")] * 500 + [(i, "日本" * rng.randint(1, 30), "b") for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, top string").withColumns({"_th": F.lit(1), "th": F.lit(2), "id": F.lit(3), "taken": F.lit(4), "size": F.lit(5)})
    weights = spark.createDataFrame([("top", "a", 1)], "level string, value string, weight long")
    tokens = lambda t: -(-len(t.encode()) // 4)
    total = sum(tokens(t) for _, t, _ in rows)
    for steps in (1, 3):
        for share, epochs in ((0.37, 1), (0.9, 1), (1.3, 2)):
            got = mixing.mix(docs, ["top"], weights, share, max_epochs=epochs, seed=5, steps=steps).collect()
            assert sum(r.taken for r in got) == int(total * share)
            assert sum(r.taken < r.doc_tokens for r in got) <= 2
    unique = docs.dropDuplicates(["doc_id", "text"])
    want = mixing.mix(unique, ["top"], weights, 0.5, seed=5).agg(F.sum("taken")).first()[0]
    kept = mixing.keep_mixed(unique, unique, ["top"], weights, 0.5, seed=5)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    whole = {t for _, t, _ in rows}
    assert want - 2 <= sum(map(tokens, texts)) <= want and sum(t not in whole for t in texts) <= 2
    assert all(t and any(w.startswith(t) for w in whole) for t in texts)


def packed_ok(histogram, capacity):
    ranges, n = packing.plan(histogram, capacity)
    places, used = {}, {}
    for length, first, count, sequence, offset in ranges.tolist():
        used.setdefault(length, []).append((first, count))
        for i in range(count):
            places.setdefault(sequence + i, []).append((offset, length))
    for length, parts in used.items():
        parts.sort()
        assert [p[0] for p in parts] == [sum(c for _, c in parts[:k]) for k in range(len(parts))]
        assert sum(c for _, c in parts) == histogram[length]
    assert sorted(places) == list(range(n))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= capacity
    return n


def test_plan():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([8, 20, 50])
        packed_ok({k: rng.randint(1, 9) for k in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}, capacity)
    assert packed_ok({1000: 5, 24: 5, 512: 4}, 1024) == 7
    assert packed_ok({}, 1024) == 0


def exhaustive(sizes, capacity):
    """Least number of sequences, by branch and bound."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(7)
    for _ in range(60):
        capacity = rng.choice([10, 15, 30])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = np.bincount(sizes, minlength=capacity + 1)
        fixed = sum(n for _, n in packing.reduce_counts(counts, capacity))
        rest = np.repeat(np.arange(capacity + 1), counts).tolist()
        assert fixed + exhaustive(rest, capacity) == exhaustive(sizes, capacity)


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    exact = Tokenizer.from_file(path)
    rng = random.Random(3)
    texts = ["", None, "a <|endoftext|> b", "<|endoftext|>", "<|endoftext", "日本<|endoftext|>", "日本語͸  x", "word " * 5000, "  \n\n x"] + ["".join(rng.choice("ab c\né.1'") for _ in range(rng.randint(0, 9000))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "again")] * 200 + [(None, "none")] * 3
    got = packing.pack(clashing(docs(rows)), path, with_ids=True, rows_in_part=7).collect()
    pieces = sorted((r.doc_id if r.doc_id is not None else -1, tuple(r.ids)) for r in got)
    want = []
    for i, t in rows:
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        want += [(-1 if i is None else i, tuple(ids[a:b])) for a, b in [(0, first), *((k, k + 1024) for k in range(first, len(ids), 1024))]]
    assert pieces == sorted(want)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and p[0][0] == 0 and sum(n for _, n in p) <= 1024
    assert packing.pack(docs([]), path).count() == 0


def test_counts(spark, docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = queries.tokenizer_path("piece_bpe_32k.model")
    vocab = token_counts.vocabulary(path)
    exact = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng = random.Random(1)
    texts = ["", None, "   ", "▁x", "日本 🙂🙂", "a\n\tb", "x" * 3000] + ["".join(rng.choice("aeb thz▁ \né日🙂") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(clashing(docs(list(enumerate(texts)))), path).collect()}
    assert got == {i: len(exact.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    # ties of every kind, without bytes to fall back to
    for seed in range(10):
        r = random.Random(seed)
        pieces = {"".join(r.choice("ab▁c") for _ in range(r.randint(1, 4))): r.choice([-1.0, -2.0, -1.5]) for _ in range(25)}
        small = [("<unk>", 0.0), *pieces.items()]
        exact = Tokenizer(models.Unigram(small, unk_id=0, byte_fallback=False))
        exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        counter = token_counts.Counter(small, False)
        for _ in range(100):
            t = "".join(r.choice("abcd ") for _ in range(r.randint(1, 20)))
            assert counter.count(t) == len(exact.encode(t).ids)


@needs_data
def test_languages(spark, docs):
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    got = queries.op9_language_id(spark, DATA).join(rows, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == rows.count() and held
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    model = language_id.fit(rows.where(language_id.fold() != 1), max_rows=400)
    odd = [(1, None), (2, ""), (3, "123 ... !"), (4, "the of and to"), (None, "und der die das ist nicht"), (5, "x" * 300_000)]
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(clashing(docs(odd)), model).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0) and found[None][0] == "de" and found[4][0] == "en"
    assert {r.doc_id for r in language_id.accepted(docs(odd), model).collect()} >= {4, None}
    unlabelled = language_id.fit(docs([(1, "x")]).withColumn("lang", F.lit(None).cast("string")))
    assert language_id.identify(docs(odd), unlabelled).where("lang_pred <> 'und'").count() == 0


def test_number_of_labels(spark):
    frame = spark.createDataFrame([(i, f"wort{i} abc", f"l{i % 5}") for i in range(50)], "doc_id long, text string, lang string")
    assert len(language_id.fit(frame).labels) == 5
    assert language_id.fit(frame, max_labels=3).labels == ["l0", "l1", "l2"]


@needs_data
def test_foreign_text_is_rejected(spark, docs):
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.fit(rows.where(language_id.fold() != 1))
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    foreign = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar.", "Все люди рождаются свободными и равными в своем достоинстве.", " ".join(word("bcdfghjkqvwxz") for _ in range(40)), " ".join(word("abcdefghijklmnopqrstuvwxyz") for _ in range(40))]
    assert language_id.accepted(docs(enumerate(foreign)), model).count() == 0
    assert language_id.accepted(rows, model).count() == rows.count()


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1500, 12)).astype(np.float32) * rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    v[100:140] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(2000, None), (2020, [0.0] * 12), (2040, [float("nan")] * 12), (2060, [1.0, None] + [0.0] * 10), (2080, [1.0]), (2100, [float("inf")] * 12), (None, v[0].tolist()), (0, v[0].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1)).withColumn("id", F.lit(1))
    got = {}
    for r in neighbours.nearest(frame).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    s = v.astype(np.float64) @ v.astype(np.float64).T
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 21)) and q not in [x[1] for x in found]
        assert all(abs(x[2] - s[q, x[1]]) < 1e-9 for x in found)
        assert all((a[2], -a[1]) > (b[2], -b[1]) for a, b in zip(found, found[1:]))
        want = sorted((i for i in range(1500) if i != q), key=lambda i: (-s[q, i], i))[:20]
        hits += len(set(want) & {x[1] for x in found})
    assert hits >= 0.9 * 20 * len(got)
    wide = spark.createDataFrame([(i, [float(x) * 1e100 for x in v[i]]) for i in range(90)] + [(i, [float(i + 1), 1.0]) for i in range(90, 130)], "vec_id long, embedding array<double>")
    found = neighbours.nearest(wide, k=3).collect()
    assert {r.query_id for r in found} == {0, 20, 40, 60, 80, 100, 120}
    assert [r.vec_id for r in found if r.query_id == 100] == [129, 128, 127]
    assert neighbours.nearest(wide.where("vec_id in (0, 100)")).count() == 0
    many = spark.createDataFrame([(i, [1.0, 2.0] if i % 3 else [float(i), 1.0]) for i in range(3000)], "vec_id long, embedding array<float>")
    asked = [r for r in neighbours.nearest(many, k=2).collect() if r.query_id % 3]
    assert len(asked) == 200 and {r.vec_id for r in asked} == {2997, 2994}
    few = neighbours.nearest(frame.where("vec_id < 5")).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert neighbours.nearest(frame.limit(0)).count() == 0


def test_neighbours_effort(spark):
    """Rounds go on until lists settle; a beam that finds too little is widened."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(v)], "node long, vec binary")
    graph, _ = neighbours.build(nodes, 64, keep=12, trees=1, run=8, named=5, told=1, settled=0)
    assert graph.agg(F.sum(F.size(F.filter("fresh", lambda f: f)))).first()[0] == 0
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got, tried = {}, []
    for r in neighbours.nearest(frame, beam=21, target=0.9995, measured=tried).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = v @ v.T
    np.fill_diagonal(s, -np.inf)
    hits = sum(len(found & set(np.argsort(-s[q])[:20].tolist())) for q, found in got.items())
    assert len(got) == 150 and hits >= 0.9995 * 20 * 150  # all of them are sampled
    assert [b for _, b, _ in tried] == [21 * 2**i for i in range(len(tried))] and len(tried) > 1 and tried[0][2] < 0.9995 <= tried[-1][2]


def test_neighbours_work(spark):
    """Graph and search take a few stages, however many rounds they need; every shard is searched."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(5000, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    assert neighbours.shards_of(5000) > 1
    spark.sparkContext.setJobGroup("nearest", "")
    try:
        rows = neighbours.nearest(frame).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("nearest") for s in tracker.getJobInfo(j).stageIds}
    assert 0 < len(stages) < 100
    got = {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = v @ v.T
    np.fill_diagonal(s, -np.inf)
    assert len(got) == 250 and all(len(x) == 20 for x in got.values())
    assert sum(len(x & set(np.argsort(-s[q])[:20].tolist())) for q, x in got.items()) >= 0.92 * 20 * 250


def test_neighbours_read_once(spark):
    """The table is read once, whatever is asked of it; 0.0 and -0.0 are one number."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    frame = spark.createDataFrame([(i, [1.0, -0.0 if i % 2 else 0.0, float(i // 20)]) for i in range(60)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(frame.mapInArrow(count, frame.schema), k=3).collect()
    assert read.value == 60
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(q, i + 1, x) for q, found in ((0, (1, 2, 3)), (20, (40, 41, 42)), (40, (41, 42, 43))) for i, x in enumerate(found)]


def test_graph_in_memory():
    """Lists hold each neighbour once, without the node, best first; groups of queries see no less than single ones."""
    rng = np.random.default_rng(5)
    v = graphs.unit(np.vstack((rng.normal(size=(900, 8)), np.repeat(rng.normal(size=(1, 8)), 40, 0) + 0.01 * rng.normal(size=(40, 8)))).astype(np.float32))
    made = graphs.build(v, 10)
    for i, near in enumerate(made.near):
        near = near[near >= 0]
        assert i not in near and len(set(near.tolist())) == len(near) == 10
        s = v[near] @ v[i]
        assert (np.diff(s) <= 1e-6).all()
    one, sims = graphs.search(v, made.near, v[:50], np.arange(20), np.arange(50), 30, 8, group=1)
    many, _ = graphs.search(v, made.near, v[:50], np.arange(20), np.arange(50), 30, 8, group=50)
    true = [set(np.argsort(-(v @ v[i]))[:10].tolist()) for i in range(50)]
    hits = [sum(len(t & set(x[:10].tolist())) for t, x in zip(true, found)) for found in (one, many)]
    assert 0.9 * 500 <= hits[0] <= hits[1] + 5 and (np.diff(sims, axis=1) <= 0).all()
    for n in (1, 2, 3):
        few = graphs.build(v[:n], 4)
        assert ((few.near >= 0).sum(axis=1) == n - 1).all()
        found, _ = graphs.search(v[:n], few.near, v[:n], np.arange(1), np.arange(n), 30, 8)
        assert all(sorted(x.tolist()) == list(range(n)) for x in found)


def test_empty_tables(spark, docs):
    none = docs([])
    assert token_counts.token_counts(none, queries.tokenizer_path("piece_bpe_32k.model")).count() == 0
    model = language_id.fit(none.withColumn("lang", F.lit("en")))
    assert model.labels == [] and language_id.identify(none, model).count() == 0 and language_id.accepted(none, model).count() == 0


@needs_data
@pytest.mark.parametrize("name", ["op1_warc_revisits", "op3_substring_dedup", "op4_exact_dedup", "op5_mixing", "op6_minhash_near_dedup"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got = __spark_entry__.queries()[name](spark, DATA)
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in want.description]
    plain = lambda rows: sorted(repr(tuple(int(v) if isinstance(v, (int, np.integer)) and not isinstance(v, bool) else v for v in r)) for r in rows)
    assert plain(got.select(*names).collect()) == plain(want.fetchall())


@needs_data
def test_pipeline(spark):
    """Each stage against brute force on its own input."""
    from test_llm_text import brute_groups

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    named = stages["language ID"](spark, docs, DATA)
    assert named.columns == docs.columns and named.count() >= 0.99 * docs.count()
    rows = named.collect()
    unique = stages["exact dedup"](spark, named, DATA)
    best = {}
    for r in rows:
        k = "".join(c for c in r.text or "" if c not in " \t\n\x0b\x0c\r")
        best[k] = min(best.get(k, (0, float("inf"))), (-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in unique.collect()) == sorted(i for _, i in best.values())
    near = stages["near dedup"](spark, unique, DATA)
    want = sorted(i for i, _, _, kept in brute_groups([(r.doc_id, r.text) for r in unique.collect()], corpus_pipeline.NEAR_PERCENT) if kept)
    assert sorted(r.doc_id for r in near.collect()) == want
    mixed = stages["mixing sources"](spark, near, DATA)
    assert mixed.columns == docs.columns
    total = lambda d: sum(-(-len((r.text or "").encode()) // 4) for r in d.collect())
    budget, whole = int(corpus_pipeline.MIX_SHARE * total(near)), {r.doc_id: r for r in near.collect()}
    taken = [r for r in mixed.collect() if r == whole[r.doc_id]]
    cut = [r for r in mixed.collect() if r != whole[r.doc_id]]
    assert budget - len(cut) <= total(mixed) <= budget and len(taken) + len(cut) == mixed.count()
    assert all(whole[r.doc_id].text.startswith(r.text) and r.n_chars == len(r.text) for r in cut)
    assert len(cut) <= near.select("lang", "source").distinct().count()
    packed = stages["best-fit packing"](spark, mixed, DATA)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}
    assert corpus_pipeline.run(spark, DATA).count() == packed.count()


@needs_data
def test_pipeline_odd_rows(spark, docs, monkeypatch):
    """Null ids, null and blank texts, copies, long texts, an empty table, clashing columns."""
    known = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = [r.text for r in known.where("length(text) between 400 and 900").orderBy("doc_id").limit(12).collect()]
    rng = random.Random(3)
    near = lambda t: t + " and then one more word"
    odd = [(None, t) for t in texts[:6]] + [(None, near(texts[0])), (None, near(texts[7])), (-5, near(texts[1])), (-5, texts[8]), (-6, texts[7])]
    odd += [(-7, None), (-8, ""), (None, None), (-9, " \n"), (-10, texts[9]), (-11, texts[9]), (None, texts[9])] + [(-12, texts[10])] * 3
    odd += [(-13, " ".join(rng.choice(texts[11].split()) for _ in range(60_000)))]
    frame = docs(odd).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("src1"), "n_chars": F.length("text").cast("int")})
    frame = frame.withColumns({c: F.lit(7) for c in ("id", "th", "digest", "_id", "_digest", "domain", "node", "kept", "taken", "size", "component")})
    stages = dict(corpus_pipeline.STAGES)
    model = language_id.fit(known.where(language_id.fold() != 1))
    monkeypatch.setattr(language_id, "fit", lambda rows: model)
    show = lambda d: sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in d.collect()))
    named = stages["language ID"](spark, frame, DATA)
    assert show(named) == sorted((i is None, i or 0, t) for i, t in odd if t and t.strip())
    unique = stages["exact dedup"](spark, named, DATA)
    want = [(i, t) for i, t in dict.fromkeys(odd) if t and t.strip() and (i, t) not in ((-10, texts[9]), (None, texts[9]))]
    assert show(unique) == sorted((i is None, i or 0, t) for i, t in want)
    single = stages["near dedup"](spark, unique, DATA)
    # a named copy of a nameless text stays, and so do all unrelated nameless texts
    gone = [(None, texts[1]), (None, near(texts[7]))]
    left = [x for x in want if x not in gone]
    got = show(single)
    assert len(got) == len(left) - 1 and ((True, 0, texts[0]) in got) != ((True, 0, near(texts[0])) in got)
    assert set(got) <= {(i is None, i or 0, t) for i, t in left}
    mixed = stages["mixing sources"](spark, single, DATA)
    assert mixed.columns == frame.columns and 0 < mixed.count() <= single.count()
    packed = stages["best-fit packing"](spark, mixed, DATA)
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), DATA).count() == 0
