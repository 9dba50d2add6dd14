import json
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from fixtures_llm import documents, lower, prose, shingles
from pyspark.sql import functions as F

from brindle.llm import decontaminate as D
from brindle.llm import packing as P
from brindle.llm import token_output as T
from brindle.llm import toxicity as X
from brindle.llm.html_extract import blocks, extract, main_text, trained, training_page
from brindle.llm.html_pages import labelled_pages
from brindle.llm.license_scan import BASE, license_scan
from brindle.llm.tokens import Encoder, default_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


# ------------------------------------------------------------------ tokens
def test_pieces_give_the_library_ids(library):
    rng = np.random.default_rng(4)
    parts = np.array(["a", "the", " ", " ", "\n", "\t", "é", "1", "'s", ",", "\xa0", "\r", "ª", "中", " ", "<|endoftext|>", "ﷺ"])
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(1500)] + ["", "x" * 5000, " ".join(prose(1, 3000))]
    for most in (10, 100_000):
        e = Encoder(default_path(), most)
        for i in range(0, len(texts), 300):
            ids, bounds = e.encode(texts[i : i + 300])
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [library(t) for t in texts[i : i + 300]]


@pytest.mark.parametrize("top", [1, 2, 300, 50257, 2**40, 2**62])
@pytest.mark.parametrize("n", [0, 1, 59, 255, 256, 257, 5000])
def test_simple8b(n, top):
    x = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64)
    s = T.encode(x)
    assert (T.decode(s) == x).all()
    for i in range(-(-n // T.BLOCK)):
        assert (T.decode_block(s, i) == x[i * T.BLOCK : (i + 1) * T.BLOCK]).all()


def test_simple8b_escapes():
    x = np.array([5, 2**60 - 1, 2**60, 2**64 - 1, 15, 15, 2**63, 0] * 100, dtype=np.uint64)
    assert (T.decode(T.encode(x)) == x).all()


def test_token_files(spark, library, monkeypatch):
    df, docs = documents(spark)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in T.read_ids(spark, T.write_ids(df), crc32=True).orderBy("start").collect()]
    want, at = [], 0
    for i, t in sorted(docs, key=lambda x: x[0]):
        ids = np.array([*library(t), 0], dtype="<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    monkeypatch.setattr(T, "CUTS", 0)  # ranges by Spark, as for very many parts
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in T.read_ids(spark, T.write_ids(df), crc32=True).orderBy("start").collect()] == want
    real = T.read_ids(spark, T.write_ids(df)).where("doc_id = 30").first()
    assert np.frombuffer(real.ids, dtype="<u4").tolist() == [*library("one two"), 0]


def test_packing(spark, library):
    df, docs = documents(spark)
    for size in (60_000, 10):
        out = P.pack_documents(df, crc32=True, per_partition=size).collect()
        ids = {i: np.array([*library(t), 2], dtype="<u4") for i, t in docs}
        lengths: dict = {}
        for r in out:
            assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
            assert r.length == 1024 or r.piece == 0
            lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
        assert lengths == {i: len(v) * sum(j == i for j, _ in docs) for i, v in ids.items()}
        bins: dict = {}
        for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
            assert bins.get(r.sequence_id, 0) == r.offset
            bins[r.sequence_id] = r.offset + r.length
        assert max(bins.values()) <= 1024
    assert P.pack_documents(df).where("doc_id = 30").first().ids == np.array([*library("one two"), 2], dtype="<u4").tobytes()


def test_certified_partitions_stay(spark, monkeypatch):
    """Only pieces of partitions over their bound move; the outcome is a packing with no more sequences than the first round's."""
    rng = np.random.default_rng(6)
    sizes = rng.integers(18, 40, 600).tolist()
    pieces = spark.createDataFrame([(k, k, n) for k, n in enumerate(sizes)], "uid long, doc_id long, length long")
    made: dict = {}
    put = P.Workspace.put
    monkeypatch.setattr(P.Workspace, "put", lambda self, df, name, **more: made.setdefault(name, put(self, df, name, **more)))
    out = P.pack(pieces, 100, 80).collect()
    first = made["round0"].collect()
    certified = {r.uid: r.sequence_id for r in first if r.bins == r.bound}
    full = {r.uid: r.sequence_id for r in first if r.load == 100}
    assert 0 < len(certified) < len(sizes) and len(made) > 1
    got = {r.uid: r for r in out}
    assert sorted(got) == list(range(len(sizes)))
    assert all(got[u].sequence_id == s for u, s in {**certified, **full}.items())
    assert any(got[r.uid].sequence_id != r.sequence_id for r in first)
    loads: dict = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert loads.get(r.sequence_id, 0) == r.offset
        loads[r.sequence_id] = r.offset + r.length
    assert max(loads.values()) <= 100
    assert -(-sum(sizes) // 100) <= len(loads) <= len({r.sequence_id for r in first})


def test_bounds_hold():
    rng = np.random.default_rng(5)

    def best(sizes, c):  # exact, by search
        sizes, top = sorted(sizes, reverse=True), [len(sizes)]

        def go(k, loads):
            if len(loads) >= top[0]:
                return
            if k == len(sizes):
                top[0] = len(loads)
                return
            for j, x in enumerate(loads):
                if x + sizes[k] <= c:
                    go(k + 1, loads[:j] + [x + sizes[k]] + loads[j + 1 :])
            go(k + 1, [*loads, sizes[k]])

        go(0, [])
        return top[0]

    for _ in range(40):
        c = int(rng.integers(8, 40))
        sizes = rng.integers(1, c + 1, 7)
        _, offsets, loads = P.best_fit_decreasing(sizes, c)
        exact = best(sizes.tolist(), c)
        assert P.lower_bound(np.bincount(sizes, minlength=c + 1)) <= exact <= len(loads)
        assert loads.max() <= c


# ------------------------------------------------------------------ decontamination
def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment():
    rng = np.random.default_rng(6)
    pairs = [(rng.integers(0, 6, rng.integers(1, 12)), rng.integers(0, 6, rng.integers(1, 20))) for _ in range(60)]
    score, _ = D.align([a.astype(np.uint64) + 2 for a, _ in pairs], [b.astype(np.uint64) + 2 for _, b in pairs])
    assert score.tolist() == [brute_align(a.tolist(), b.tolist()) for a, b in pairs]


def test_decontamination(spark):
    item = prose(20, 40)
    edited = [w for k, w in enumerate(item) if k not in (5, 17)]
    edited[9] = edited[25] = "other"
    docs = [(1, " ".join(prose(1, 300) + item + prose(2, 50))), (2, " ".join(prose(3, 60) + edited)), (3, " ".join(w.upper() + "," for w in item)), (4, " ".join(prose(4, 400))), (5, None), (6, " ".join(item[:9] + prose(5, 80))), (7, " ".join(item) * 1), (7, " ".join(item))]
    df, _ = documents(spark, docs)
    bench = spark.createDataFrame([(1, " ".join(item), "z"), (2, "too short", "z"), (3, None, "z"), (4, " ".join(prose(30, 50)), "z"), (None, "x", "z")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r for r in D.contaminated(df, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (7, 1)}
    assert (got[1, 1].score, got[1, 1].first_word, got[1, 1].last_word) == (1.0, 300, 339)
    assert 0.7 < got[2, 1].score < 1
    assert {(r.doc_id, r.item_id) for r in D.contaminated(df, bench, slice_bytes=200).collect()} == set(got)
    assert D.contaminated(df, bench.limit(0)).count() == 0
    assert D.contaminated(df.limit(0), bench).count() == 0


def test_decontamination_against_all_alignments(spark):
    """Every document with every item: the best local alignment of all their words, where they share a seed."""
    rng, items, docs = np.random.default_rng(12), [prose(300 + k, int(rng_n)) for k, rng_n in enumerate((5, 12, 25, 40))], []
    for d in range(60):
        w = prose(400 + d, int(rng.integers(0, 120)))
        for _ in range(int(rng.integers(0, 3))):
            copy = [x if rng.random() > (0.0, 0.1, 0.3, 0.5)[d % 4] else "other" for x in items[rng.integers(0, 4)]]
            copy = copy[: max(1, int(len(copy) * rng.choice([0.4, 0.8, 1.0])))]
            at = int(rng.integers(0, len(w) + 1))
            w = w[:at] + copy + w[at:]
        docs.append((d, " ".join(w)))
    df, _ = documents(spark, docs)
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in D.contaminated(df, bench).collect()}
    number = {w: k for k, w in enumerate(sorted({w for _, t in docs for w in t.split()} | {w for x in items for w in x}))}
    want = {}
    for d, t in docs:
        w = t.split()
        grams = {tuple(w[i : i + D.N]) for i in range(len(w) - D.N + 1)}
        for k, x in enumerate(items):
            if grams & {tuple(x[i : i + D.N]) for i in range(len(x) - D.N + 1)}:
                share = brute_align([number[y] for y in x], [number[y] for y in w]) / (2 * len(x))
                if share >= D.THRESHOLD:
                    want[d, k] = share
    assert got == pytest.approx(want)
    assert len(want) > 20


@pytest.mark.parametrize("rate", [0.02, 0.05, 0.1, 0.15])
def test_decontamination_finds_edited_copies(rate):
    rng, n = np.random.default_rng(13), 200
    items = [prose(500 + k, int(rng.integers(20, 60))) for k in range(n)]
    texts = []
    for k, x in enumerate(items):
        copy = []
        for w in x:  # replaced, lost or followed by another word
            kind = rng.integers(0, 3) if rng.random() < rate else -1
            copy += [["other"], [], [w, "more"]][kind] if kind >= 0 else [w]
        texts.append(" ".join(prose(900 + k, 80) + copy + prose(1200 + k, 40)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    held = SimpleNamespace(value=D.Items(list(range(n)), [" ".join(x) for x in items], D.N))
    found = {(r["doc_id"], r["item_id"]) for b in D._matches(held, D.THRESHOLD)([batch]) for r in b.to_pylist()}
    assert sum((k, k) in found for k in range(n)) >= 0.9 * n
    assert len([x for x in found if x[0] != x[1]]) == 0


def test_decontamination_of_an_item_that_leaked_often(spark):
    item = prose(21, 38)
    edited = [("other" if k in (9, 19, 29) else w) for k, w in enumerate(item)]
    for copy in (item[:26], edited):
        df, _ = documents(spark, [(i, " ".join(prose(100 + i, 50) + copy + prose(200 + i, 50))) for i in range(12)])
        bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
        assert {(r.doc_id, r.item_id) for r in D.contaminated(df, bench).collect()} == {(i, 1) for i in range(12)}


def test_decontamination_in_small_runs_of_hits(monkeypatch):
    items = D.Items([1, 2], [" ".join(prose(21, 38)), " ".join(prose(22, 30))], D.N)
    texts = [" ".join(prose(i, 40) + prose(21, 38)[: 20 + i] + prose(22, 30)) for i in range(9)] + ["short", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    found = lambda: sorted(tuple(r.values()) for b in D._matches(SimpleNamespace(value=items), 0.5)([batch]) for r in b.to_pylist())
    whole = found()
    monkeypatch.setattr(D, "HITS", 1)
    monkeypatch.setattr(D, "CELLS", 1)
    assert found() == whole
    assert len(whole) == 18


# ------------------------------------------------------------------ pages
def test_field_on_pages_it_never_saw():
    field, right, whole, n = trained(), 0, 0, 0
    for parts in labelled_pages(200, seed=1234):
        f, labels, _ = training_page(parts)
        got = field.decode(f)
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        whole += got == labels
        n += len(labels)
    assert right / n > 0.99
    assert whole / 200 > 0.93


def test_viterbi_is_the_best_labelling():
    from itertools import product

    field = trained()
    f, _, _ = training_page(labelled_pages(1, seed=5)[0])
    f = f[:10]

    def score(y):
        s = sum(sum(field.w[field.at[x]] for x in fs if x in field.at) * v for fs, v in zip(f, y, strict=True))
        return s + sum(field.t[a][b] for a, b in zip(y, y[1:], strict=False))

    assert score(field.decode(f)) == pytest.approx(max(score(y) for y in product((0, 1), repeat=len(f))))


def test_blocks():
    page = '<p><b>A &amp; b<br>c</b> d<p>e<script>x="<p>no"</script> f<!-- <p>z --><ul><li>g<li>h</ul><table><tr><td>i<td>j</table>tail <a href=">">k</a><'
    assert [b[0] for b in blocks(page)] == ["A & b c d", "e f", "g", "h", "i", "j", "tail k<"]
    assert blocks("") == blocks("<p") == []


def test_text_inside_formulas_objects_and_the_like():
    page = "<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be <object data='a'>a <b>thing</b></object><canvas>!</canvas></p><noscript><p>plain</p></noscript><svg><title>t</title><text>drawn</text></svg><p>a<textarea>typed</textarea>b<iframe><p>other page</p></iframe></p>"
    assert [b[0] for b in blocks(page)] == ["Let x=1 be a thing!", "plain", "drawn", "ab"]


def test_long_and_broken_pages():
    """Time grows with the page, also where quotes or tags stay open."""
    import time

    for part in ('<a title="x <b>t</b> ', "<a <b ", "<p>word ", "<div a='>", '<i "', "&amp;<"):
        took = []
        for n in (4000, 32_000):
            start = time.process_time()
            blocks(part * n)
            took.append(time.process_time() - start)
        assert took[1] < 40 * max(took[0], 0.02), part
    assert [b[0] for b in blocks('<p>one <a title="open>two</a></p><p class="x">three</p>')][-1].endswith("three")
    text = " ".join(prose(1, 20_000)) + "."
    assert main_text(f"<html><body><nav><a href='/'>Home</a></nav><article><h1>Title</h1><p>{text}</p></article></body></html>", trained()) == f"Title\n{text}"


def test_field_without_known_names():
    """The same layouts with class names and ids that no list holds: position, tags, links and text must do."""
    field, right, n = trained(), 0, 0
    for k, parts in enumerate(labelled_pages(150, seed=99)):
        renamed = [(re.sub(r"""(class|id)=(["']?)[\w-]+( [\w-]+)*""", lambda m, k=k: f"{m[1]}={m[2]}q{k}z", raw), kind) for raw, kind in parts]
        f, labels, _ = training_page(renamed)
        right += sum(a == b for a, b in zip(field.decode(f), labels, strict=True))
        n += len(labels)
    print("blocks right without known names", right / n)
    assert right / n > 0.85


def test_extract(spark):
    page = '<html><body><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div><article><h1>The title</h1><p>First &quot;text&quot;\n of  it.</p><p>No.</p><aside class="ad"><p>Buy this now, really.</p></aside><p>Second part of the text, a bit longer than the first.</p></article><section id="comments"><h3>Comments</h3><p>I liked this a lot, thanks.</p></section><footer>&copy; 2020</footer></body></html>'
    df = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 1), (3, "u", "", 1), (3, "u", "<p", 1), (None, "u", page, 1)], "page_id long, url string, html string, text int")
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in extract(df).collect()), key=str)
    text = 'The title\nFirst "text" of it.\nNo.\nSecond part of the text, a bit longer than the first.'
    assert got == sorted([(0, "u", text, len(text)), (1, "u", text, len(text)), (2, None, "", 0), (3, "u", "", 0), (3, "u", "", 0)], key=str)
    assert extract(df.limit(0)).count() == 0
    assert main_text(None, trained()) == ""


# ------------------------------------------------------------------ licences
def test_license_scan(spark):
    texts = ["Licensed under CC BY-NC 4.0.\ncc  by, Cc-By", "x Released under the MIT License. all rights reserved", "the GNU GENERAL public license, version 3 general public license", "mit", None, "", "all rights all rights reserved reserved", "éall rights reserved", "Licensed under the Apache License, Version 2.0.", "cc by cc by", "general public general public license"]
    df, docs = documents(spark, list(enumerate(texts)) + [(None, "mit license"), (3, "mit")])
    got = {r.doc_id: r for r in license_scan(df).collect()}
    for i, t in docs:
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if x]
        places = sorted(k for p in BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        labels = ",".join(sorted({n for p, n in BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()}))
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), places[0] if places else None, places[-1] if places else None, labels), t
        assert set(filter(None, labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert (got[0].labels, got[1].labels, got[8].labels, got[3].labels) == ("cc-by,cc-by-nc", "mit,reserved", "apache,apache-2.0", "")
    assert license_scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("others", [1, 60, 300])
def test_license_scan_of_two_notices(spark, others):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    apache, by_nc = "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0."
    rest = "redistribution permitted provided conditions general public lesser mozilla exhibit eclipse"
    df, _ = documents(spark, [(1, f"{mit}\n{apache}"), (2, f"{mit}\n{by_nc}"), *((k, mit if k % 2 else rest) for k in range(10, 10 + others)), *((k, " ".join(prose(k, 20))) for k in range(1000, 1400))])
    got = {r.doc_id: r.labels for r in license_scan(df).where("doc_id < 3").collect()}
    assert got == {1: "apache,apache-2.0,mit", 2: "cc-by,cc-by-nc,mit"}


def test_license_scan_of_many_notices(spark):
    """Every notice in a file gets its label, also when all templates stand in one file, and in full form."""
    from brindle.llm.license_scan import TEMPLATES

    first = {label: text for label, _, text in reversed(TEMPLATES)}
    three = ["mit", "isc", "gpl"]
    every = " ".join(f"{text}." for _, _, text in TEMPLATES)
    long_ = {k: text for k, (_, _, text) in enumerate(TEMPLATES) if len(text.split()) > 30}
    df, _ = documents(spark, [(1, "\n".join(first[x] for x in three)), (2, every), (3, f"{' '.join(prose(1, 5000))} {every}"), *((100 + k, t) for k, t in long_.items()), *((k, " ".join(prose(k, 30))) for k in range(1000, 1060))])
    got = {r.doc_id: set(r.labels.split(",")) for r in license_scan(df).collect()}
    assert got[1] == {"mit", "isc", "gpl"}
    assert got[2] == got[3] == {label for label, _, _ in TEMPLATES}
    assert len(long_) >= 4
    assert all(TEMPLATES[k][0] in got[100 + k] for k in long_)


def test_license_scan_runs_no_python(spark):
    df, _ = documents(spark)
    assert not re.search("Python|Arrow|Pandas", license_scan(df)._jdf.queryExecution().toString())


# ------------------------------------------------------------------ toxicity
def labelled(spark, n=600):
    rng, docs, labels = np.random.default_rng(8), [], []
    bad = ["fiend", "dolt", "rogue"]
    for i in range(n):
        w = prose(1000 + i, int(rng.integers(5, 80)))
        y = int(rng.random() < 0.2)
        for _ in range(y * int(rng.integers(1, 4))):
            w[rng.integers(0, len(w))] = str(rng.choice(bad))
        docs.append((i, " ".join(w)))
        labels.append((i, y))
    docs += [(n, None), (n + 1, ""), (None, "dolt fiend"), (5, docs[5][1])]
    return documents(spark, docs)[0], spark.createDataFrame([*labels, (None, 1), (n + 5, None)], "doc_id long, toxic int"), docs, dict(labels)


def test_toxicity(spark):
    df, labels, docs, truth = labelled(spark)
    got = X.toxicity(df, labels).collect()
    assert len(got) == len([d for d in docs if d[0] is not None])
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.5)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(p == y for p, y in held) / len(held) > 0.95


def test_toxicity_ignores_held_out_labels(spark):
    df, labels, _, _ = labelled(spark, 200)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda d: sorted((r.doc_id, r.score) for r in d.collect())
    assert key(X.toxicity(df, labels)) == key(X.toxicity(df, other))


def test_toxicity_without_labels(spark):
    df, labels, _, _ = labelled(spark, 30)
    for some in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1")):
        assert len({r.score for r in X.toxicity(df, some).collect()}) == 1
    assert X.toxicity(df.limit(0), labels).count() == 0
    assert X.reject_toxic(df, labels.limit(0)).count() == df.count()


def random_examples(n, n_terms, share, seed):
    rng = np.random.default_rng(seed)
    tf = np.where(rng.random((n, n_terms)) < share * rng.random(n_terms) ** 3, rng.integers(1, 4, (n, n_terms)), 0)
    doc, term = np.nonzero(tf)
    return tf, doc, term.astype(np.uint64) * 7 + 3, tf[doc, term]


@pytest.mark.parametrize(("block", "frequent"), [(64, 1 / 16), (8, 0.2), (8, 0.0), (8, 1.0)])
def test_nearest_is_exact(monkeypatch, block, frequent):
    monkeypatch.setattr(X, "BLOCK", block)
    monkeypatch.setattr(X, "FREQUENT", frequent)
    tf, doc, term, count = random_examples(300, 60, 0.5, 9)
    y = np.random.default_rng(1).integers(0, 2, 300)
    index = X.Index(doc, term, count, y, np.arange(300))
    df, n1 = (tf > 0).sum(axis=0), ((tf > 0) * y[:, None]).sum(axis=0)
    weight = np.log(300.5 / np.maximum(df, 1)) * X.association(df, n1, 300, int(y.sum())) * (df > 0)
    v = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * weight
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    queries = index.vectors(doc, term, count, 300)
    place = {i: k for k, i in enumerate(index.ids.tolist())}
    own = [i for i in range(300) if i in place]
    for skip in (None, np.array([place[i] for i in own])):
        for k, (cos, who) in zip(own, index.nearest([queries[i] for i in own], 9, skip), strict=True):
            true = v @ v[k]
            if skip is not None:
                true[k] = 0
            want = np.sort(true[true > 1e-9])[::-1][:9]
            assert np.allclose(cos, want, atol=1e-5)
            assert np.allclose(true[index.ids[who]], cos, atol=1e-5)


def brute_toxicity(docs, labels):
    """Scores by dictionaries of words, all cosines and a search for the calibration's minimum."""
    count = lambda t: {w: n for w, n in __import__("collections").Counter(x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if x).items()}
    text: dict = {}
    for i, t in docs:
        text[i] = min(text.get(i, t), t)
    train = [i for i in sorted(labels) if i in text and zlib.crc32(str(i).encode()) % 5]
    words, y = {i: count(text[i]) for i in train}, {i: labels[i] for i in train}
    df, n1 = {}, {}
    for i in train:
        for w in words[i]:
            df[w], n1[w] = df.get(w, 0) + 1, n1.get(w, 0) + y[i]
    total, total1 = len(train), sum(y.values())

    def weigh(w):
        expected = df[w] * total1 / total
        spread = expected * (1 - total1 / total) * max(total - df[w], 1) / (total - 1)
        return np.log((total + 0.5) / df[w]) * max(((n1[w] - expected) ** 2 / max(spread, 1e-12)) ** 0.75, X.FLOOR)

    def vector(c):
        v = {w: (1 + np.log(n)) * weigh(w) for w, n in c.items() if w in df}
        size = sum(x * x for x in v.values()) ** 0.5
        return {w: x / size for w, x in v.items()}

    vectors = {i: vector(words[i]) for i in train}
    empty = [y[i] for i in train if not words[i]]

    def vote(v, skip=None):
        near = sorted(((sum(x * vectors[i].get(w, 0) for w, x in v.items()), i) for i in train if i != skip), reverse=True)[: X.K]
        near = [(c, i) for c, i in near if c > 0]
        weight = [c * c / (1.05 - min(c, 1)) for c, _ in near]
        p = (sum(w * y[i] for w, (_, i) in zip(weight, near, strict=True)) + 0.1) / (sum(weight) + 1)
        p = min(max(p, 1e-4), 1 - 1e-4)
        return np.log(p / (1 - p))

    x = np.array([vote(vectors[i], i) for i in train if words[i]])
    z = np.array([y[i] for i in train if words[i]])
    loss = lambda a, b: np.logaddexp(0, np.where(z == 1, -1, 1) * (a * x + b)).sum() + 0.05 * ((a - 1) ** 2 + b * b)
    a, b, step = 1.0, 0.0, 1.0
    while step > 1e-7:  # pattern search
        best = min(((loss(a + i * step, b + j * step), a + i * step, b + j * step) for i in (-1, 0, 1) for j in (-1, 0, 1)), key=lambda r: r[0])
        if best[0] >= loss(a, b) - 1e-13:
            step /= 2
        a, b = best[1:]
    out = []
    for i, t in docs:
        v = vector(count(t))
        out.append((i, 1 / (1 + np.exp(-(a * vote(v) + b))) if v else (1 + sum(empty)) / (10 + len(empty))))
    return out


def test_toxicity_whole(spark):
    df, labels, docs, truth = labelled(spark, 150)
    docs = [(i, t or "") for i, t in docs if i is not None]
    want = sorted(brute_toxicity(docs, truth))
    got = sorted((r.doc_id, r.score, tuple(r.evidence)) for r in X.toxicity(df, labels).collect())
    assert [r[0] for r in got] == [r[0] for r in want]
    # Equally near examples at the k-th place may be any of them.
    close = [abs(a[1] - b[1]) < 2e-3 for a, b in zip(got, want, strict=True)]
    assert sum(close) >= 0.97 * len(close)
    assert {i for i, _, e in got if not e} == {i for i, t in docs if not t}


def test_toxicity_uses_all_words(spark):
    """A text with any word of an example has neighbours and a score of its own; the bound on text bytes holds."""
    rng, docs, labels = np.random.default_rng(11), [], []
    bad = np.array([f"insult{k}" for k in range(300)])
    for i in range(3000):
        y = i % 2
        docs.append((i, " ".join(prose(5000 + i, 6) + (rng.choice(bad, 35, replace=False).tolist() if y else []))))
        labels.append((i, y))
    docs += [(9000 + k, w) for k, w in enumerate(bad.tolist())]
    docs += [(9500, "w17 neverseen"), (9501, "neverseen either")]
    df, known = documents(spark, docs)[0], spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in X.toxicity(df, known).where("doc_id >= 9000").collect()}
    assert min(got[9000 + k].score for k in range(300)) > 0.5
    assert got[9500].evidence
    assert not got[9501].evidence
    assert len(X.train(df.select("doc_id", "text"), known.withColumnRenamed("toxic", "y"), F.lit(True), max_bytes=20_000)) < 200


def test_toxicity_rejects_rows_without_id_like_others(spark):
    df, labels, docs, _ = labelled(spark, 300)
    more = df.limit(1).select(*(F.lit(None).cast("long").alias(c) if c == "doc_id" else F.lit("dolt rogue fiend dolt").alias(c) if c == "text" else F.col(c) for c in df.columns))
    left = X.reject_toxic(df.unionByName(more), labels)
    assert left.columns == df.columns
    assert left.where("text = 'dolt rogue fiend dolt'").count() == 0
    assert left.where("text is null").count() == df.where("text is null").count()


# ------------------------------------------------------------------ pipeline
def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    item = prose(20, 40)
    docs = [(i, " ".join(prose(100 + i, 60)) + "\na line that many documents share\nown " + str(i), "en", "s", 0) for i in range(40)]
    docs += [(40, docs[0][1], "en", "s", 0), (41, " ".join(prose(200, 20) + item), "en", "s", 0), (42, None, None, None, None), (None, "x", "en", "s", 0)]
    base = prose(77, 90)
    docs += [(43, " ".join(base), "en", "s", 0), (44, " ".join(base[:45] + ["edit"] + base[46:]), "en", "s", 0)]
    docs += [(k, " ".join(prose(k, 25) + ["dolt"] * (k % 2) + ["word"]), "en", "s", 0) for k in range(100, 260)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, k % 2) for k in range(100, 260)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns
        out.write.parquet(f"{tmp_path}/{name}")
        d = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r.doc_id: r.text for r in d.collect()}
    assert not [k for k in left["toxicity"] if k and k >= 100 and k % 2]
    assert {k for k in left["toxicity"] if k is not None} >= {*range(45), *range(100, 260, 2)}
    assert "many documents" in left["line_dedup"][0]
    assert "many documents" not in left["line_dedup"][5]
    assert 44 not in left["minhash_near_dedup"]
    assert 43 in left["minhash_near_dedup"]
    assert 41 in left["minhash_near_dedup"]
    assert 41 not in left["decontamination"]
    assert None in left["decontamination"]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {k for k in left["decontamination"] if k is not None}


def test_pipeline_near_dedup_is_from_80_percent(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    base = prose(78, 100)
    pairs = {(1, 2): (30, 70), (11, 12): (20, 50, 80)}
    docs = []
    for (a, b), at in pairs.items():
        own = [f"{w}x{a}" for w in base]
        docs += [(a, " ".join(own)), (b, " ".join("edit" if k in at else w for k, w in enumerate(own)))]
    df, _ = documents(spark, docs)
    shared = [100 * len(shingles(docs[k][1]) & shingles(docs[k + 1][1])) / len(shingles(docs[k][1]) | shingles(docs[k + 1][1])) for k in (0, 2)]
    assert 80 <= shared[0] < 85
    assert shared[1] < 80
    assert {r.doc_id for r in corpus_pipeline.minhash_near_dedup(spark, df, "").collect()} == {1, 11, 12}


def test_entry_has_all_queries():
    import __spark_entry__ as entry

    found = entry.queries()
    assert {n.split("_")[0] for n in found if re.match(r"op\d+_", n)} == {f"op{k}" for k in range(1, 11)}
    assert "pipeline" in found
    json.dumps(sorted(entry.oracle_sql()))
