"""Candidates of near copies: fingerprints, differences from a lead, and how many pairs a large group makes."""

import random

from pyspark.sql import functions as F

from jobtide.llm import near_copies, simhash

from .test_pipeline_stages import groups


def test_fingerprints_within_three_bits_are_candidates(spark):
    rng, prints = random.Random(3), []
    for _ in range(20):
        one = rng.getrandbits(64)
        prints += [one, one, one ^ (1 << rng.randrange(64)), one ^ 0b111, one ^ 0b11111 << 20]
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    nodes = spark.createDataFrame(list(enumerate(signed)), "node long, fp long")
    got = {(r.a, r.b) for r in near_copies._printed(nodes).collect()}
    least = {p: prints.index(p) for p in prints}
    want = {(least[p], i) for i, p in enumerate(prints) if least[p] < i}
    want |= {tuple(sorted((least[p], least[q]))) for p in least for q in least if p != q and (p ^ q).bit_count() <= 3}
    assert got == want and len(got) >= 60


def test_the_fingerprint_of_a_text_is_that_of_its_shingles(spark):
    texts = ["", "one two", "One two three four five six seven eight " * 40]
    _, got = near_copies.keys_of(texts)
    for text, fp in zip(texts, got.tolist()):
        grams = near_copies.grams_of(text).tolist()
        assert fp == sum(1 << b for b in range(64) if 2 * sum(g >> b & 1 for g in grams) > len(grams))
    assert simhash.fingerprint_texts(["", "a"]).tolist()[0] == 0


def test_similar_texts_share_one_of_the_first_differences():
    rng, similar, met, pairs = random.Random(1), 0, 0, 0
    for _ in range(200):
        base = list(range(rng.choice((12, 30, 150))))
        docs = []
        for _ in range(14):
            own = set(base)
            for _ in range(rng.randrange(len(base) // 4 + 2)):
                own.discard(rng.choice(base))
                own.add(10**6 + rng.randrange(15))
            docs.append({(str(v).encode(),) for v in own})
        made = [(near_copies.similar(docs[0], d), *near_copies.unlike(docs[0], d)) for d in docs[1:]]
        for i, (near, size, x, tight, first) in enumerate(made):
            assert near == (x <= len(docs[0])) and size == len(docs[0] ^ docs[i + 1])
            for j, (other, size2, x2, tight2, first2) in enumerate(made):
                if i != j and not near:
                    meet = 18 * min(size, size2) >= x + x2 and bool(set(first) & set(first2) if other else set(first[:tight]) & set(first2[:tight2]))
                    like = near_copies.similar(docs[i + 1], docs[j + 1])
                    assert meet or not like
                    similar, met, pairs = similar + like, met + meet, pairs + 1
    assert 0 < similar < met < pairs


def test_a_large_group_is_not_compared_pair_by_pair(spark, monkeypatch):
    rng, n = random.Random(8), 400
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(6) if i != 7 else 0):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    made, real = [], near_copies._judged
    monkeypatch.setattr(near_copies, "_judged", lambda pairs, texts: made.append(pairs.count()) or real(pairs, texts))
    found = near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string"))
    got = sorted(r.least for r in found.groupBy("root").agg(F.min("id").alias("least")).collect())
    assert got == sorted(d for (d, _), least in zip(docs, groups(docs)) if d == least) and 3 < len(got) < n
    assert sum(made) < 12 * n
