"""Collocations against counting by hand."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from jobtide.llm import collocations as co

UP = re.compile("[A-Z]")


def plain(docs, least=30, top=2000):
    counts = defaultdict(Counter)
    for lang, text in docs:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", UP.sub(lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            counts[lang or "und"].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        cands, rows = {p: v for p, v in f.items() if len(p) > 1 and v >= least}, []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    rng, out = random.Random(5), []
    vocabulary = ["alpha", "Beta", "gamma", "über", "日本", "x\x00y", "d-e", "z"] + [f"rare{i}" for i in range(40)]
    for i in range(400):
        words = rng.choices(vocabulary, [9, 8, 7, 6, 5, 4, 3, 2] + [0.1] * 40, k=rng.randrange(0, 40))
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", "\x85"]) for w in words)
        out.append((rng.choice(["en", "en", "en", "fr", None, "und"]), text + (" New York City Hall" if i % 3 == 0 else "")))
    return [*out, ("en", None), ("fr", ""), (None, None), ("de", "..."), ("it", "only once")]


@pytest.mark.parametrize(("group", "tile", "filled"), [(co.GROUP, co.TILE, co.FILLED), (60, 4, 0.5), (500, 2, 0.01), (1, 1024, 2)])
def test_collocations(spark, docs, monkeypatch, group, tile, filled):
    monkeypatch.setattr(co, "TILE", tile)
    monkeypatch.setattr(co, "FILLED", filled)
    monkeypatch.setattr(co, "SLICE", 50)
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "lang string, text string, grp int, rank int").repartition(3)
    assert sorted(map(tuple, co.collocations(frame, least=8, group=group).collect())) == plain(docs, 8)
    assert sorted(map(tuple, co.collocations(frame, least=8, top=7, group=group).collect())) == plain(docs, 8, 7)


def test_no_rows(spark):
    assert co.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


@pytest.mark.parametrize("filled", [1 / 64, 2])
def test_tiles(monkeypatch, filled):
    monkeypatch.setattr(co, "TILE", 8)
    monkeypatch.setattr(co, "FILLED", filled)
    rng = np.random.default_rng(1)
    left, right = rng.zipf(1.3, 5000) % 1000, rng.zipf(1.3, 5000) % 3000
    a, b, counts, own = co.tiled(left, right)
    assert dict(zip(zip(a.tolist(), b.tolist()), counts.tolist())) == Counter(zip(left.tolist(), right.tolist())) and len(a) == len(set(zip(a, b)))
    assert (a[own] == left).all() and (b[own] == right).all()


def test_large_counts(spark):
    """Products beyond 64 bits."""
    a = 5_000_000_000_000
    level = spark.createDataFrame([(a, [a + 3, a], [a + 5, a])], "a long, heads array<long>, tails array<long>")
    row = co.scored(level, 2).first()
    assert (row["score"], row["l"], row["r"]) == (2_000_000 * a // (2 * a + 8), a + 3, a + 5)
