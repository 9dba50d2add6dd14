"""MinHash near-dedup with SuperMinHash signatures.

SuperMinHash gives each shingle one random permutation of the signature's slots and the values j + u_j in that order, so
the slots of one shingle are correlated and the signature varies less than with independent hashes. Slots are filled
level by level over all shingles of a document at once: after level j no later value can be under j + 1, so a document
stops as soon as all its slots are under that.

Documents with the same set are one class, found by a digest of the sorted set; only the class's smallest id goes on.
Signatures are cut into bands. Whole signatures and sketches are not kept of all documents: those of classes that share
a bucket are computed anew beside their texts. In each band's bucket members are first compared with one centre (star). What is still
in different components of a bucket is compared block against block. A block lies within one component if that has a
block's members in the bucket; members of smaller ones share blocks. Blocks of one component never meet, so a large
group of copies with a few outsiders in its bucket costs its size, not its square. A task rules pairs out by set sizes,
by a wide margin on the signatures' estimate and by sketches (the 512 smallest hashes of a set: the whole set if it is
that small), and of the rest emits what joins components, not all pairs. Every link is confirmed on full sets. A pair
that its sketches make certain joins components within a task before it is confirmed; should one of these fail, all
blocks are compared once more without that, so nothing stays hidden behind it.
Components are found by alternating min-label propagation and pointer jumping over the links (union-find by rounds, no
links on the driver).

Defined cases: null or wordless text has an empty set, is linked with nothing and its own component; fewer words
than a shingle: the whole sequence; rows without an id are left out; rows that repeat an id are a document
each, linked by what their own text is like; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import T_LOWER, Workspace, arrow_bytes, binary_array, id_text, join_classes, mix, n_partitions, ngrams, salted, slices, volume, words

SHINGLE = 5
BANDS, ROWS = 26, 5
SLOTS = BANDS * ROWS
CHUNK = 128
BUCKET_BLOCK = 512
#: six standard errors of the estimate from SLOTS independent slots, which SuperMinHash does not exceed
MARGIN = 6.0
SMALLEST = 512
#: links of a node (members of a label) beyond which its label goes to several tasks
HUB = 256
TEXT_SLICE = 1 << 20


def shingle_sets(data: np.ndarray, bounds: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, joined, and their bounds."""
    h, _, _, first = words(data, bounds, T_LOWER)
    g, at = ngrams(h, first, n)
    doc = np.searchsorted(first, at, side="right") - 1
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.zeros(len(short), dtype=np.uint64)
        for k in range(n - 1):
            m = count[short] > k
            whole[m] = whole[m] * np.uint64(0x9E3779B97F4A7C15) + h[first[:-1][short[m]] + k]
        g, doc = np.concatenate([g, mix(whole ^ count[short].astype(np.uint64))]), np.concatenate([doc, short])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    keep = np.ones(len(g), dtype=bool)
    keep[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[keep], doc[keep]
    return g, np.searchsorted(doc, np.arange(len(bounds)))


def super_minhash(g: np.ndarray, bounds: np.ndarray, slots: int = SLOTS, limit: int = 1 << 17) -> np.ndarray:
    """uint32 signatures (documents x slots) of shingle sets; all ones for an empty set."""
    n = len(bounds) - 1
    sig = np.full((n, slots), np.uint32(0xFFFFFFFF), dtype=np.uint32)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, side="right")) - 1)
        _signatures(g[bounds[i] : bounds[j]], np.diff(bounds[i : j + 1]), sig[i:j])
        i = j
    return sig


def _signatures(g: np.ndarray, sizes: np.ndarray, sig: np.ndarray) -> None:
    slots = sig.shape[1]
    best = np.full(sig.shape, np.inf)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    live, perm = g, None
    for j in range(slots):
        if not len(live):
            break
        r = mix(live + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        u = (r >> np.uint64(32)).astype(np.float64) / 4294967296.0
        k = j + ((r & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            slot, first = k, k
        elif perm is None and j == 1:
            slot = np.where(k == first, 0, k)
            second = k
        else:
            if perm is None:
                perm = np.tile(np.arange(slots, dtype=np.uint8), (len(live), 1))
                at = np.arange(len(live))
                for step, was in ((0, first), (1, second)):
                    a, b = perm[at, was], perm[at, step].copy()
                    perm[at, was], perm[at, step] = b, a
            at = np.arange(len(live))
            slot = perm[at, k].astype(np.int64)
            perm[at, k] = perm[at, j]
        np.minimum.at(best.reshape(-1), doc * slots + slot, j + u)
        open_ = (best.max(axis=1) >= j + 1)[doc]
        live, doc = live[open_], doc[open_]
        if perm is not None:
            perm = perm[open_]
        elif j == 0:
            first = first[open_]
        else:
            first, second = first[open_], second[open_]
    found = np.isfinite(best).all(axis=1)
    sig[found] = (best[found] * (0xFFFFFFFE / slots)).astype(np.uint32)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.empty((len(sig), bands), dtype=np.uint64)
    for b in range(bands):
        x = np.full(len(sig), b + 1, dtype=np.uint64)
        for r in range(rows):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r])
        out[:, b] = x
    return out


def _sign(batches):
    import pyarrow as pa

    for b in batches:
        data, bounds = arrow_bytes(b.column("text"))
        for i, j in slices(bounds, TEXT_SLICE):
            g, cuts = shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            bands = band_keys(super_minhash(g, cuts))
            digest = [hashlib.blake2b(g[x:y].tobytes(), digest_size=16).digest() if y > x else None for x, y in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("tkey").slice(i, j - i), pa.array(np.diff(cuts).astype(np.int64)), pa.array(digest, pa.binary()), binary_array(list(bands))], names=["doc_id", "tkey", "n_shingles", "digest", "bands"])


def _bands(batches):
    import pyarrow as pa

    for b in batches:
        keys = np.frombuffer(b"".join(b.column("bands").to_pylist()), dtype=np.int64)
        rows = len(keys) // BANDS
        n = pa.array(np.repeat(np.arange(rows), BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), rows)), b.column("node").take(n), b.column("n_shingles").take(n)], names=["bucket", "band", "node", "n_shingles"])


def _sketches(batches):
    import pyarrow as pa

    for b in batches:
        data, bounds = arrow_bytes(b.column("text"))
        for i, j in slices(bounds, TEXT_SLICE):
            g, cuts = shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            low = [(g[x : min(y, x + SMALLEST)] >> np.uint64(32)).astype(np.uint32) for x, y in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("node").slice(i, j - i), binary_array(list(super_minhash(g, cuts))), binary_array(low)], names=["node", "sig", "low"])


def _confirm(percent: int):
    def run(key, left, right):
        """left: pairs of one centre's chunk with the members' texts; right: the centre's text."""
        import pyarrow as pa

        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        centre, _ = shingle_sets(*arrow_bytes(right.column("text").slice(0, 1)))
        data, bounds = arrow_bytes(left.column("text"))
        keep = []
        for i, j in slices(bounds, TEXT_SLICE):
            g, cuts = shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            hit = np.zeros(len(g) + 1, dtype=np.int64)
            if len(centre):
                np.cumsum(centre[np.minimum(np.searchsorted(centre, g), len(centre) - 1)] == g, out=hit[1:])
            both = hit[cuts[1:]] - hit[cuts[:-1]]
            keep.append(100 * both >= percent * (np.diff(cuts) + len(centre) - both))
        ids = left.column("b").to_numpy()[np.concatenate(keep)]
        return pa.table({"a": pa.array(np.full(len(ids), key[0].as_py(), dtype=np.int64)), "b": pa.array(ids)})

    return run


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, ws: Workspace, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked. A centre's pairs go in chunks, each with its text once."""
    # Only centres with more pairs than a chunk are looked up: few rows, and pairs of a common centre need not meet.
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")).where("chunks > 1")
    dealt = salted(pairs, sizes, ["a"], "b", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("chunks", F.lit(1))).alias("chunk"))
    dealt = ws.put(dealt, f"{name}_dealt")
    members = dealt.join(texts.withColumnRenamed("node", "b"), "b")
    centres = dealt.select(F.col("a").alias("ca"), F.col("chunk").alias("cc")).distinct().join(texts.select(F.col("node").alias("ca"), F.col("text").alias("text")), "ca")
    out = ws.put(members.groupBy("a", "chunk").cogroup(centres.groupBy("ca", "cc")).applyInArrow(_confirm(percent), "a long, b long"), name)
    ws.drop(f"{name}_dealt")
    return out


def components(nodes: DataFrame, links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(node, comp): the smallest node that each reaches. Rounds: take the least label of the neighbours, then jump.

    The label of a node with many links, and of a component with many members, goes to several tasks."""
    both = links.select(F.col("a").alias("s"), F.col("b").alias("t")).union(links.select("b", "a")).distinct()
    salts = both.groupBy("t").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("salts")).where("salts > 1")
    both = ws.put(salted(both, salts, ["t"], "s", "left").select("s", "t", F.pmod(F.xxhash64("s"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")), f"{name}_links")
    least = both.groupBy(F.col("s").alias("id")).agg(F.least(F.min("t"), F.first("s")).alias("label"))
    labels = ws.put(least.join(salts.withColumnRenamed("t", "id"), "id", "left").select("id", "label", F.coalesce("salts", F.lit(1)).alias("salts")), f"{name}_0")
    k = 0
    while True:
        told = labels.select(F.col("id").alias("t"), "label", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        near = both.join(told, ["t", "salt"]).groupBy(F.col("s").alias("id")).agg(F.min("label").alias("near"))
        step = ws.put(labels.join(near, "id").select("id", "label", "salts", F.least("label", "near").alias("new")), f"{name}_step{k}")
        jumps = step.select("new").distinct().join(step.select(F.col("id").alias("new"), F.col("new").alias("next")), "new").where("next < new")
        jump = salted(step, jumps, ["new"], "id", "left").select("id", F.coalesce("next", "new").alias("label"), "salts", (F.col("label") != F.coalesce("next", "new")).cast("long").alias("moved"))
        k += 1
        done = ws.put(jump, f"{name}_{k}")
        ws.drop(f"{name}_{k - 1}", f"{name}_step{k - 1}")
        labels = done.select("id", "label", "salts")
        if not done.agg(F.sum("moved")).first()[0]:
            break
    return nodes.join(labels.select(F.col("id").alias("node"), "label"), "node", "left").select("node", F.coalesce("label", "node").alias("comp"))


class Side:
    """A block of a bucket."""

    def __init__(self, t):
        self.ids, self.comp, self.n = t.column("node").to_numpy(), t.column("comp").to_numpy(), t.column("n_shingles").to_numpy()
        self.sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, SLOTS)
        self.low = [np.frombuffer(x, dtype=np.uint32) for x in t.column("low").to_pylist()]


def _sketched(one: np.ndarray, whole: bool, others: list[np.ndarray], wholes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(common, in either, exact?) of one sketch and others, up to the smaller of their largest hashes unless both are whole sets."""
    sizes = np.array([len(x) for x in others])
    values, owner = np.concatenate(others), np.repeat(np.arange(len(others)), sizes)
    last = np.array([x[-1] for x in others], dtype=np.int64)
    top = np.minimum(np.where(wholes, 1 << 32, last), 1 << 32 if whole else int(one[-1]))
    under = values <= top[owner]
    at = np.minimum(np.searchsorted(one, values), len(one) - 1)
    common = np.bincount(owner, weights=(one[at] == values) & under, minlength=len(others))
    either = np.searchsorted(one, top, side="right") + np.bincount(owner, weights=under, minlength=len(others)) - common
    return common, either, wholes & whole


def _cross(percent: int, between: bool, unite: bool):
    need = percent / 100
    floor = SLOTS * (need - MARGIN * (need * (1 - need) / SLOTS) ** 0.5)

    def run(key, left, right):
        """Pairs of two blocks of one bucket that are in different components and may be similar, and whether they surely are.
        A block against itself comes as the left one only."""
        import pyarrow as pa

        root: dict[int, int] = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        a, b, c = [], [], []
        same = (key[1], key[2]) == (key[3], key[4])
        if left.num_rows and (same or right.num_rows):
            p, band = Side(left), left.column("band")[0].as_py()
            q = p if same else Side(right)
            for k in range(len(p.ids)):
                m = np.flatnonzero((q.comp != p.comp[k]) & (np.minimum(q.n, p.n[k]) >= need * np.maximum(q.n, p.n[k])) & ((q.ids > p.ids[k]) | (not same)))
                if not len(m):
                    continue
                equal = q.sig[m] == p.sig[k]
                likely = equal.sum(axis=1) >= floor
                if between and band:  # a pair belongs to its first common band
                    likely &= ~equal[:, : band * ROWS].reshape(len(m), band, ROWS).all(axis=2).any(axis=1)
                m = m[likely]
                if not len(m):
                    continue
                both, either, exact = _sketched(p.low[k], p.n[k] <= SMALLEST, [q.low[i] for i in m], q.n[m] <= SMALLEST)
                spread = np.where(exact, 0.02, MARGIN * np.sqrt(need * (1 - need) / np.maximum(either, 1)))
                sure = exact & (100 * (both - 2) >= percent * (either + 2))  # whatever two hash collisions may hide
                for i, certain in zip(m[both >= (need - spread) * either], sure[both >= (need - spread) * either], strict=True):
                    x, y = find(int(p.comp[k])), find(int(q.comp[i]))
                    if x != y:
                        a.append(min(p.ids[k], q.ids[i]))
                        b.append(max(p.ids[k], q.ids[i]))
                        c.append(bool(certain) and unite)
                        if c[-1]:
                            root[x] = y
        return pa.table({"a": pa.array(np.array(a, dtype=np.int64)), "b": pa.array(np.array(b, dtype=np.int64)), "sure": pa.array(c, pa.bool_())})

    return run


def _apart(buckets: DataFrame, comp: DataFrame, sketches: DataFrame, percent: int, between: bool, unite: bool = True, ws: Workspace | None = None, name: str = "apart") -> DataFrame:
    """Candidate pairs (a, b, sure) of buckets that hold several components: within blocks, or between all blocks of different
    components. Without ``unite`` no pair stands for others of the same components.

    Each step is a table of its own: a plan of all of them has dozens of exchanges, which all run at the same time, and the
    driver holds their tasks, the sizes of their blocks and a thread each. Sketches are joined last, so they are dealt once."""
    ws = ws or Workspace(buckets.sparkSession, "apart")
    rows = ws.put(buckets.select("bucket", "band", "node", "n_shingles").join(comp, "node"), f"{name}_rows")
    sizes = ws.put(rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("m")), f"{name}_sizes")
    large = F.col("m") >= BUCKET_BLOCK
    mixed = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(~large, F.col("m"))), F.lit(0)).alias("small")).where("n > 1").drop("n")
    own = F.when(large, F.col("comp")).otherwise(F.lit(-1))
    parts = salted(sizes, mixed, ["bucket"], "comp").select("bucket", "comp", own.alias("part"), F.ceil(F.when(large, F.col("m")).otherwise(F.col("small")) / BUCKET_BLOCK).cast("int").alias("n_blocks"))
    parts = ws.put(parts, f"{name}_parts")
    placed = salted(rows, parts, ["bucket", "comp"], "node").withColumn("block", F.pmod(F.xxhash64("node", F.lit(int(between))), "n_blocks").cast("int"))
    placed = ws.put(placed.select("bucket", "part", "block", "band", "node", "comp", "n_shingles"), f"{name}_placed")
    blocks = parts.select("bucket", "part", "n_blocks").distinct().select("bucket", "part", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"))
    keys = ("bucket", "part", "block", "part2", "block2")
    if between:
        blocks = ws.put(blocks, f"{name}_blocks")
        other = blocks.select("bucket", F.col("part").alias("part2"), F.col("block").alias("block2"))
        meet = (F.col("part") < F.col("part2")) | ((F.col("part") == -1) & (F.col("part2") == -1) & (F.col("block") <= F.col("block2")))
        pairs = ws.put(blocks.join(other, "bucket").where(meet).select(*keys), f"{name}_pairs")
    else:
        pairs = blocks.where("part = -1").select("*", F.col("part").alias("part2"), F.col("block").alias("block2"))
    columns = (*keys, "band", "node", "comp", "n_shingles")
    met = placed.join(pairs, ["bucket", "part", "block"]).select(*columns, F.lit(True).alias("first"))
    if between:
        others = pairs.where((F.col("part") != F.col("part2")) | (F.col("block") != F.col("block2")))
        right = placed.withColumnsRenamed({"part": "part2", "block": "block2"}).join(others, ["bucket", "part2", "block2"])
        met = met.unionByName(right.select(*columns, F.lit(False).alias("first")))
    met = ws.put(met, f"{name}_met")
    ws.drop(*(f"{name}_{x}" for x in ("rows", "sizes", "parts", "placed", "blocks", "pairs")))
    run = _cross(percent, between, unite)

    def sides(key, t):
        import pyarrow.compute as pc

        left = t.filter(t.column("first"))
        return run(key, left, t.filter(pc.invert(t.column("first"))) if between else left)

    return met.join(sketches, "node").groupBy(*keys).applyInArrow(sides, "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    ws = Workspace(spark, "near")
    texts = id_text(docs, id_col, text_col).withColumn("tkey", F.xxhash64("text"))
    signed = ws.put(texts.mapInArrow(_sign, "doc_id long, tkey long, n_shingles long, digest binary, bands binary"), "signed")
    rep = F.min(F.struct("doc_id", "tkey")).alias("rep")
    classes = signed.where("digest is not null").groupBy("digest").agg(rep, F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n"))
    # A number for each class: ids may repeat.
    reps = ws.put(classes.select(F.monotonically_increasing_id().alias("node"), "digest", "n", "rep.*", "n_shingles", "bands"), "reps")
    nodes = reps.select("node")
    banded = reps.select("node", "n_shingles", "bands").mapInArrow(_bands, "bucket long, band int, node long, n_shingles long")
    centre = banded.groupBy("bucket").agg(F.min(F.struct("node", "n_shingles")).alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1")
    centre = centre.select("bucket", F.col("c.node").alias("centre"), F.col("c.n_shingles").alias("n_a"))
    buckets = ws.put(salted(banded, centre, ["bucket"], "node"), "buckets")
    need = percent / 100
    near_size = F.least("n_shingles", "n_a") >= need * F.greatest("n_shingles", "n_a")
    star = buckets.where((F.col("node") != F.col("centre")) & near_size).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    tried, links, comp = ws.put(star, "pairs0"), None, nodes.select("node", F.col("node").alias("comp"))
    # Texts of classes that share a bucket, once, dealt for all rounds.
    wanted = reps.join(buckets.select("node").distinct(), "node").select("node", "doc_id", "tkey")
    n = n_partitions(spark, volume(texts), 32 << 20)
    used = texts.join(wanted, ["doc_id", "tkey"]).select("node", "text").repartition(n, "node").dropDuplicates(["node"])
    used = ws.put(used, "texts", bucket=(n, "node"))
    sketches = ws.put(used.mapInArrow(_sketches, "node long, sig binary, low binary"), "sketches", bucket=(n, "node"))

    def link(pairs, k):
        """The components after the pairs of round k are confirmed; none new: as before."""
        nonlocal links
        new = confirm(pairs, used, percent, ws, f"links{k}")
        links = new if links is None else links.unionByName(new)
        return ws.put(components(nodes, links, ws, f"step{k}"), f"comp{k}") if new.head(1) else comp

    comp = link(tried, 0)
    # Round 1 joins what it can within blocks, round 2 compares all blocks; a third is for certain pairs that were not confirmed.
    for k, between, unite in ((1, False, True), (2, True, True), (3, True, False)):
        found = ws.put(_apart(buckets, comp, sketches, percent, between, unite, ws, f"apart{k}"), f"found{k}")
        ws.drop(f"apart{k}_met")
        more = ws.put(found.select("a", "b").join(tried, ["a", "b"], "left_anti"), f"pairs{k}")
        if more.head(1):
            comp = link(more, k)
            tried = tried.unionByName(more)
        if between and not found.where("sure").join(links, ["a", "b"], "left_anti").head(1):
            break
    ws.drop("texts", "sketches", "buckets")
    named = reps.select("node", "digest", "n", "doc_id").join(comp, "node")
    least = named.groupBy("comp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("members")).where("members > 1")
    named = salted(named, least, ["comp"], "node", "left").select("digest", "n", F.coalesce("least", "doc_id").alias("component_id"))
    out = join_classes(signed.select("doc_id", "n_shingles", "digest"), ws.put(named, "classes"), "digest", "n", signed.count())
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
c AS (SELECT d.doc_id, count(s.g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * i >= 85 * (ca.n + cb.n - i)),
r AS (WITH RECURSIVE t(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT t.doc_id, e.b FROM t JOIN e ON t.other = e.a) SELECT doc_id, min(other) AS component_id FROM t GROUP BY doc_id)
SELECT c.doc_id, c.n AS n_shingles, r.component_id, c.doc_id = r.component_id AS kept FROM c JOIN r USING (doc_id)
"""
