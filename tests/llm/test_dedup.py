import time

import numpy as np
import pytest
from fixtures_llm import brute_exact, brute_lines, brute_near, brute_substring, documents, prose, shingles

from pyspark.sql import functions as F

from brindle.llm import common as C
from brindle.llm import exact_dedup as E
from brindle.llm import near_dedup as N
from brindle.llm import substring_dedup as S
from brindle.llm.line_dedup import dedup_lines, drop_repeated_lines, line_bitmaps


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_word_hashes_are_words():
    texts = ["Hello  the world\nx", "", " a b\x0bc ", "é ü the", "the"]
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0] + [len(r) for r in raw])
    h, s, e, first = C.words(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds)
    want = [w for r in raw for w in r.split()]
    assert [b"".join(raw)[i:j] for i, j in zip(s, e, strict=True)] == want
    assert len(set(h.tolist())) == len(set(want))
    assert np.diff(first).tolist() == [len(r.split()) for r in raw]
    g, at = C.ngrams(h, first, 2)
    assert len(g) == sum(max(0, len(r.split()) - 1) for r in raw)


def test_substring(spark):
    df, docs = documents(spark)
    got = rows(S.substring_dedup(df, digest=True), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_substring(docs)


@pytest.mark.parametrize(("extra", "fan_out"), [(-6, 6), (3, 1), (-3, 2)])
def test_substring_many_blocks_levels_and_false_suspects(spark, monkeypatch, extra, fan_out):
    """Crowded cells: most windows are suspected, the exact pass must clear them. Several levels of merging and answers."""
    monkeypatch.setattr(S, "EXTRA_BITS", extra)
    df, docs = documents(spark)
    got = rows(S.substring_dedup(df, digest=True, bucket_bytes=80_000, range_windows=3000, fan_out=fan_out), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_substring(docs)


def test_sketches_overestimate_and_lose_nothing():
    """Merged counts of the two rows are never under the true ones; few windows that occur once are suspected."""
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2)
    h[15_000:] = h[:5000]
    bits, suspect = len(h).bit_length() + S.EXTRA_BITS, np.ones(len(h), dtype=bool)
    for r in range(S.ROWS):
        cell = (C.mix(h ^ np.uint64(0x6A09E667F3BCC909 * r & (1 << 64) - 1)) if r else h) >> np.uint64(64 - bits)
        parts = [np.sort(x) for x in np.split(cell, 10)]
        sent = S._table([p for k, x in enumerate(parts) for p in S._pieces(r, k, x[S._distinct(x)[0]], S._distinct(x)[2], bits)])
        m = S.Merged(sent)
        heavy = dict(zip(m.cells.tolist(), m.many.tolist(), strict=True))
        suspect &= np.array([heavy[c] for c in cell.tolist()])
    assert suspect[:5000].all()
    assert suspect[15_000:].all()
    assert suspect[5000:15_000].mean() < 0.03


def test_sketches_grow_with_the_words(spark, monkeypatch):
    made: dict = {}
    put = C.Workspace.put

    def counted(self, df, name, **more):
        out = put(self, df, name, **more)
        if name.startswith("sketch_") and name[7:].isdigit():
            made[name] = out.count()
        return out

    monkeypatch.setattr(C.Workspace, "put", counted)
    pieces = []
    for n in (40, 320):
        df, docs = documents(spark, [(i, " ".join(prose(i, 150))) for i in range(n)])
        monkeypatch.setattr(S, "volume", lambda texts, n=n: 900 * n)
        S.substring_dedup(df, bucket_bytes=900 * 20, range_windows=600, fan_out=1)
        pieces.append(made["sketch_0"] / n)
        made.clear()
    assert pieces[1] <= 1.1 * pieces[0]


def test_substring_text(spark):
    a = prose(5, 40)
    df, _ = documents(spark, [(1, " ".join(a + ["tail"])), (2, "head " + "\n".join(a))])
    assert rows(S.substring_dedup(df), "doc_id", "text") == [(1, "tail"), (2, "head")]


@pytest.mark.parametrize("x", [[], [0], [5, 5, 70000, 2**40], list(range(1000))])
def test_sorted_coding(x):
    x = np.array(x, dtype=np.uint64)
    assert (S.unpack_sorted(S.pack_sorted(x)) == x).all()


@pytest.mark.parametrize("bits", [128, 4])
def test_exact(spark, bits):
    """With 4 bits most keys collide: byte verification has to part the classes."""
    df, docs = documents(spark)
    got = rows(E.exact_dedup(df, digest_bits=bits, memtable_rows=5), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == brute_exact(docs)


@pytest.mark.parametrize(("memtable_rows", "fan_out"), [(3, 1), (2, 2), (1, 3)])
def test_exact_by_levels(spark, memtable_rows, fan_out):
    df, docs = documents(spark, [(i, f"text {i % 31}  of {'x' * (i % 7)}") for i in range(200)] + [(5, "text 0  of ")])
    got = rows(E.exact_dedup(df, memtable_rows=memtable_rows, fan_out=fan_out), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == brute_exact(docs)


def test_pieces_of_runs_grow_with_the_rows(spark, monkeypatch):
    """Eight times the rows: about eight times the pieces at each level, however many runs and ranges."""
    made: list = []
    put = C.Workspace.put

    def counted(self, df, name, **more):
        out = put(self, df, name, **more)
        if name.startswith("level"):
            made.append(out.count())
        return out

    monkeypatch.setattr(C.Workspace, "put", counted)
    pieces = []
    for n in (4000, 32_000):
        digests = spark.range(n, numPartitions=4).select(F.col("id").alias("doc_id"), F.unhex(F.md5(F.col("id").cast("string"))).alias("key"))
        E.index_runs(digests, C.Workspace(spark, "t"), n, 125, 2)
        pieces.append(made[0] / n)
        made.clear()
    assert pieces[1] <= 1.1 * pieces[0]


def test_classes_of_many_rows_are_joined_whole(spark):
    rows_ = spark.range(3000).select((F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 700)).alias("k"), F.col("id").alias("v"))
    classes = rows_.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least")).where("k % 3 = 0")
    got = sorted(tuple(r) for r in C.join_classes(rows_, classes, "k", "n", 3000).select("k", "v", "n", "least").collect())
    assert got == sorted(((r.k, r.v, r.n, r.least) for r in rows_.join(classes, "k", "left").collect()))


def test_runs_merge():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 4, (400, 16), dtype=np.uint8)
    keys[:, 1:] = 0
    runs = []
    for k in range(4):
        part = E.fold(keys[k * 100 : (k + 1) * 100], np.arange(k * 100, (k + 1) * 100), np.ones(100, dtype=np.int64))
        runs.append((*part, E.bloom(part[0])))
    a = E.merge(E.merge(runs[0], runs[1]), E.merge(runs[3], runs[2]))
    want = E.fold(keys, np.arange(400), np.ones(400, dtype=np.int64))
    assert all((x == y).all() for x, y in zip(a[:3], want, strict=True))


def test_near(spark):
    df, docs = documents(spark)
    docs = sorted(set(docs))
    got = sorted(set(rows(N.near_dedup(df), "doc_id", "n_shingles", "component_id", "kept")))
    assert got == brute_near(docs)


def test_near_of_rows_that_repeat_an_id(spark):
    """Each row is a document of its own: what its text is like links it, not its id."""
    a, b = prose(60, 80), prose(61, 80)
    docs = [(5, " ".join(a)), (5, " ".join(b)), (9, " ".join([*a[:79], "end"])), (7, " ".join([*b[:79], "end"])), (2, " ".join(["start", *b[1:]])), (5, " ".join(a))]
    df, _ = documents(spark, docs)
    whole = brute_near(list(enumerate(t for _, t in docs)))
    least: dict = {}
    for k, _, root, _ in whole:
        least[root] = min(least.get(root, docs[k][0]), docs[k][0])
    want = sorted((docs[k][0], n, least[root], docs[k][0] == least[root]) for k, n, root, _ in whole)
    assert rows(N.near_dedup(df), "doc_id", "n_shingles", "component_id", "kept") == want


def test_near_of_a_large_group_with_an_outsider(spark, monkeypatch):
    """Blocks of one component never meet: rows sent to be compared grow with the group, not with its square."""
    monkeypatch.setattr(N, "BUCKET_BLOCK", 8)
    rng, base = np.random.default_rng(3), prose(62, 120)

    def sent(n):
        sig = np.tile(rng.integers(0, 1 << 31, N.SLOTS, dtype=np.uint32), (n + 1, 1))
        low = np.arange(50, dtype=np.uint32).tobytes()
        buckets = spark.createDataFrame([(1, 0, k, 116) for k in range(n + 1)], "bucket long, band int, node long, n_shingles long")
        comp = spark.createDataFrame([(k, 0 if k < n else n) for k in range(n + 1)], "node long, comp long")
        reps = spark.createDataFrame([(k, sig[k].tobytes(), low) for k in range(n + 1)], "node long, sig binary, low binary")
        plan = N._apart(buckets, comp, reps, 85, True)
        return plan.count()

    assert [sent(40), sent(160)] == [5, 20]  # the outsider is alike: one pair for each block of the group
    docs = [(k, " ".join([*base[:100], f"own{k}", *base[101:]])) for k in range(1, 40)] + [(100, " ".join([*base[:60], *prose(63, 60)])), (101, " ".join([*base[:117], "x", "y", "z"]))]
    df, docs = documents(spark, docs)
    assert rows(N.near_dedup(df), "doc_id", "n_shingles", "component_id", "kept") == brute_near(docs)


def test_near_certain_pairs_stand_for_others(spark):
    """Certain pairs join components before they are confirmed; without that every pair is told."""
    sig, low = np.arange(N.SLOTS, dtype=np.uint32).tobytes(), np.arange(50, dtype=np.uint32).tobytes()
    buckets = spark.createDataFrame([(1, 0, k, 116) for k in range(4)], "bucket long, band int, node long, n_shingles long")
    comp = spark.createDataFrame([(k, k) for k in range(4)], "node long, comp long")
    sketches = spark.createDataFrame([(k, sig, low) for k in range(4)], "node long, sig binary, low binary")
    for between in (False, True):
        some = rows(N._apart(buckets, comp, sketches, 85, between), "a", "b", "sure")
        assert [x[2] for x in some] == [True] * 3
        assert {v for x in some for v in x[:2]} == {0, 1, 2, 3}
    every = rows(N._apart(buckets, comp, sketches, 85, True, unite=False), "a", "b", "sure")
    assert every == [(a, b, False) for a in range(4) for b in range(a + 1, 4)]


def test_near_certain_pairs_that_fail(spark, monkeypatch):
    """Pairs that sketches make certain but full sets don't confirm hide nothing."""
    cross = N._cross

    def wrong(percent, between, unite):
        return cross(20, between, unite)  # takes pairs of a similarity of 0.2 for certain

    monkeypatch.setattr(N, "_cross", wrong)
    base = prose(81, 120)
    docs = [(k, " ".join([*base[: 120 - 8 * k], *prose(82 + k, 8 * k)])) for k in range(8)]
    docs += [(20 + k, " ".join([f"x{k}", *docs[k][1].split()[1:]])) for k in range(8)]
    df, docs = documents(spark, docs)
    assert rows(N.near_dedup(df), "doc_id", "n_shingles", "component_id", "kept") == brute_near(docs)


def test_near_in_small_plans(spark, monkeypatch):
    """All exchanges of a plan run at the same time and are held by the driver: no plan has more than a few."""
    exchanges, put = [], C.Workspace.put

    def counted(self, df, *args, **named):
        exchanges.append(str(df._jdf.queryExecution().executedPlan()).count("Exchange "))
        return put(self, df, *args, **named)

    monkeypatch.setattr(C.Workspace, "put", counted)
    df, docs = documents(spark)
    N.near_dedup(df)
    assert max(exchanges) <= 8


def test_heap_watch(spark, monkeypatch):
    """Garbage of the driver's JVM goes while the heap is beyond its share, until ``clean``; no watch where tasks run in the driver."""
    for name, value in (("_watches", {}), ("_made", []), ("_batch_before", {}), ("HEAP_SHARE", 1.0), ("HEAP_LOOK", 0.05), ("HEAP_REST", 0.05)):
        monkeypatch.setattr(C, name, value)
    full = [*spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()][-1]
    C.watch_heap(spark)
    assert not C._watches
    monkeypatch.setattr(C, "one_process", lambda _: False)
    C.watch_heap(spark)
    (watch,) = C._watches.values()
    C.watch_heap(spark)
    assert [*C._watches.values()] == [watch]
    before = full.getCollectionCount()
    time.sleep(0.5)
    assert full.getCollectionCount() == before
    monkeypatch.setattr(C, "HEAP_SHARE", 0.0)
    end = time.time() + 20
    while full.getCollectionCount() < before + 2 and time.time() < end:
        time.sleep(0.1)
    assert full.getCollectionCount() >= before + 2
    C.clean()
    watch.join(10)
    assert not watch.is_alive() and not C._watches


def test_components_of_hubs(spark, monkeypatch):
    monkeypatch.setattr(N, "HUB", 3)
    rng = np.random.default_rng(5)
    links = [(0, k) for k in range(1, 30)] + [(29, 50), (50, 51), (60, 61)] + [(70 + k, 71 + k) for k in range(12)] + [(int(a), int(b)) for a, b in rng.integers(200, 260, (40, 2)) if a != b]
    nodes = spark.range(300).withColumnRenamed("id", "node")
    got = dict(N.components(nodes, spark.createDataFrame(links, "a long, b long"), C.Workspace(spark, "t"), "c").collect())
    root = {k: k for k in range(300)}
    for _ in range(300):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_near_chains_and_blocks(spark, monkeypatch):
    """A chain of edits: the ends are linked only through the middle; buckets of several blocks."""
    monkeypatch.setattr(N, "BUCKET_BLOCK", 3)
    monkeypatch.setattr(N, "CHUNK", 2)
    base, docs = prose(7, 200), []
    for k in range(14):
        w = list(base)
        for j in range(k):
            w[13 * j + 5] = f"edit{j}"
        docs.append((100 - k, " ".join(w)))
    docs += [(k, " ".join(prose(50 + k, 80))) for k in range(5)]
    df, docs = documents(spark, docs)
    want = brute_near(docs)
    assert len({c for _, _, c, _ in want}) < len(docs)
    assert rows(N.near_dedup(df), "doc_id", "n_shingles", "component_id", "kept") == want


def test_signatures_estimate_similarity():
    rng, z = np.random.default_rng(3), []
    for _ in range(60):
        n = int(rng.choice([8, 60, 400, 3000]))
        a = [f"w{x}" for x in rng.integers(0, 5000, n)]
        b = list(a)
        for k in rng.integers(0, n, max(1, n // 50)):
            b[k] = "zz"
        raw = [" ".join(x).encode() for x in (a, b)]
        g, cuts = N.shingle_sets(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0] + [len(r) for r in raw]))
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        assert np.diff(cuts).tolist() == [len(x), len(y)]
        j = len(x & y) / len(x | y)
        s = N.super_minhash(g, cuts)
        if 0 < j < 1:
            z.append(((s[0] == s[1]).mean() - j) / (j * (1 - j) / N.SLOTS) ** 0.5)
    assert max(map(abs, z)) < 5
    assert np.std(z) < 1.1


def test_lines(spark):
    df, docs = documents(spark)
    assert rows(dedup_lines(df, digest=True), "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute_lines(docs)
    maps = line_bitmaps(df)
    assert maps.select("doc_id", "tkey").distinct().count() == maps.count() == len({d[0] for d in brute_lines(docs) if d[2]})


def test_lines_keep_columns(spark):
    df, docs = documents(spark)
    out = drop_repeated_lines(df)
    assert out.schema.names == df.schema.names
    assert out.count() == df.count()
    assert {r.text for r in out.where("doc_id is null").collect()} == {"no id here", None}


def test_lines_of_columns_named_like_the_inner_ones(spark):
    rows_ = [(1, "a line to keep here", 5, b"x", 7), (2, "a line to keep here\nown line of two", 6, b"y", 8)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, own_id long, keep_bits binary, OWN_KEY long")
    out = sorted(drop_repeated_lines(df).collect())
    assert [tuple(r) for r in out] == [rows_[0], (2, "own line of two", 6, b"y", 8)]


def test_lines_in_small_folds(spark, monkeypatch):
    from brindle.llm import line_dedup as L

    monkeypatch.setattr(L, "FOLD_ROWS", 3)
    shared = [f"shared line number {k}" for k in range(12)]
    rng = np.random.default_rng(2)
    df, docs = documents(spark, [(int(i), "\n".join(rng.choice(shared, rng.integers(0, 30)).tolist() + [f"own line of number {i}"] * int(rng.integers(0, 2)))) for i in rng.permutation(40)])
    assert rows(dedup_lines(df, digest=True), "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute_lines(docs)


@pytest.mark.parametrize("f", [S.substring_dedup, E.exact_dedup, N.near_dedup, dedup_lines, drop_repeated_lines])
def test_empty_table(spark, f):
    df, _ = documents(spark, [])
    assert f(df).count() == 0
    only, _ = documents(spark, [(1, None), (None, None)])
    assert f(only).where("doc_id is not null").count() == 1
