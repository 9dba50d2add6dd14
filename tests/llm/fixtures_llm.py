"""Small inputs with all the odd cases, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import re

import numpy as np

SCHEMA = "doc_id long, text string, kept boolean, block int, keep_id string, n long, label string, offset long"


def prose(seed: int, n: int) -> list[str]:
    rng = np.random.default_rng(seed)
    return [f"w{k}" for k in rng.integers(0, 3000, n)]


def documents(spark, rows=None):
    """Nulls, empty and blank texts, ties, repeated rows, a very long text; extra columns that clash with internal names."""
    if rows is None:
        base, long_ = prose(1, 120), prose(2, 30_000)
        near = base[:60] + ["changed"] + base[61:]
        rows = [
            (10, " ".join(base)), (3, " ".join(base)), (7, "\t".join(base) + "\n"), (11, " ".join(near)), (12, " ".join(near).upper()), (13, " ".join(prose(3, 50) + base[20:70] + prose(4, 40))),
            (20, None), (21, ""), (22, " \n\t "), (23, None), (30, "one two"), (31, "ONE  two"), (40, " ".join(long_)), (41, " ".join(long_[:15_000])), (None, "no id here"), (None, None),
            (50, "a common line of text\nmine alone, this is\na common line of text\nshort"), (51, "A Common Line of Text  \nanother own line!\nshort"), (52, "x\n\n  a common line of text"), (53, "a b c\x01é d e\x85f"),
            (60, " ".join(prose(9, 20) * 6)), (70, "repeated row of text"), (70, "repeated row of text"),
        ]
    return spark.createDataFrame([(i, t, True, 1, "x", 5, "y", 9) for i, t in rows], SCHEMA), [(i, t or "") for i, t in rows if i is not None]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_substring(docs, window=35):
    seen: dict = {}
    w = [words(t) for _, t in docs]
    for d, x in enumerate(w):
        for i in range(len(x) - window + 1):
            seen.setdefault(tuple(x[i : i + window]), []).append((d, i))
    gone = [set() for _ in w]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + window))
    return sorted((docs[d][0], len(x), len(gone[d]), sha(" ".join(y for k, y in enumerate(x) if k not in gone[d]))) for d, x in enumerate(w))


def brute_exact(docs):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t)) for i, t in docs]
    groups: dict = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    return sorted((i, min(groups[t]), len(groups[t]), i == min(groups[t]), sha(t)) for i, t in norm)


def shingles(text: str) -> set:
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_near(docs, percent=85):
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(a), find(i), find(i) == i) for i, a in sets)


def brute_lines(docs, least=10):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    first: dict = {}
    for i, t in docs:
        for x in t.split("\n"):
            first[key(x)] = min(first.get(key(x), i), i)
    out = []
    for i, t in docs:
        lines = t.split("\n")
        keep = [x for x in lines if len(key(x)) < least or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(keep), sha("\n".join(keep))))
    return sorted(out)
