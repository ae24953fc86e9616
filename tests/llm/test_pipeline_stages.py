"""Stages of the pipeline on planted cases, against plain loops."""

import random


from pyspark.sql import functions as F

import corpus_pipeline
from jobtide.llm import common, near_copies, secret_scan, sentencepiece_bpe

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def row(doc_id, text, **more):
    return {"doc_id": doc_id, "text": text, "lang": "en", "source": "web", "n_chars": len(text or "")} | more


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def planted():
    """Sixty texts and copies of each at similarities of 0.7 to 0.97, made by replacing words."""
    rng, out = random.Random(5), []
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        out.append((i, " ".join(words)))
        for k, swaps in enumerate((1, 2, 4, 6, 6, 10)):
            copy = list(words)
            for at in range(swaps):
                copy[20 + at * 25] = f"x{rng.randrange(10**6)}"
            out.append((1000 * (k + 1) + i, " ".join(copy).upper() if k == 3 else " ".join(copy)))
    return out


def groups(docs):
    """The smallest id reachable over pairs at 0.8 or more."""
    sets, root = [grams(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), 2**63), d)
    return [least[find(i)] for i in range(len(docs))]


def test_near_copies_by_jaccard(spark):
    docs = planted()
    similar = [jaccard(docs[0][1], t) for _, t in docs[1:7]]
    assert min(similar) < 0.8 < sorted(similar)[1] < 0.85 and max(similar) > 0.96
    want = sorted(d for (d, _), least in zip(docs, groups(docs)) if d == least)
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([row(*d) for d in docs], COLUMNS), "").collect()
    assert sorted(r.doc_id for r in got) == want and 60 < len(want) <= 120


CLASHING = ("size", "key", "tie", "bucket", "source_size", "target", "taken", "row", "node", "digest", "best", "root", "id", "own", "blob", "spans", "steps", "clean", "copy", "pred", "score", "_copy", "_blob", "_judged", "_own", "_pred", "_score", "a.b")


def test_stages_with_clashing_columns(spark):
    docs = spark.createDataFrame([row(i, f"the quick brown fox number {i} jumps over the lazy dog {i * 7} times {i * i} password: abcdefgh{i:08d}" if i % 3 else "the same words in every third document of this small table", source="ab"[i % 2]) for i in range(60)], COLUMNS)
    more = docs
    for n, name in enumerate(CLASHING):
        more = more.withColumn(name, docs.doc_id * 100 + n)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, full = stage(spark, docs, "").collect(), stage(spark, more, "")
        assert full.columns == more.columns, name
        full = full.collect()
        assert plain and sorted(map(tuple, plain)) == sorted(tuple(r)[:5] for r in full), name
        assert all(tuple(r)[5:] == tuple(r.doc_id * 100 + n for n in range(len(CLASHING))) for r in full), name
    tokens = corpus_pipeline.STAGES[-1][1]
    assert sorted(tokens(spark, docs, "").collect()) == sorted(tokens(spark, more, "").collect())


def test_near_copies_of_repeated_ids(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in ("apple", "pear", "plum"))
    docs = [row(1, one), row(1, one), row(1, one, source="books"), row(2, one + " end"), row(2, two), row(None, three), row(None, three), row(None, two), row(5, None), row(6, " ")]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(docs, COLUMNS), "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, three), (1, one), (2, two), (5, "")]


def test_stages_on_no_rows_and_on_nulls(spark):
    none = spark.createDataFrame([], COLUMNS)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (3, "", None, "web", 0), (4, " \n", "en", None, None), (5, "password: abcdefghijkl0123 " + "x" * 3000, "en", None, None), (None, "password: abcdefghijkl0123 " + "x" * 3000, None, "web", 7)], COLUMNS)
    kept = {"language_id": None, "simhash_dedup": 2, "secret_scan": 6, "source_mix": None, "sentencepiece": 6}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0, name
        rows = stage(spark, odd, "").collect()
        assert kept[name] is None or len(rows) == kept[name], name
        if name == "secret_scan":
            assert sorted(r.text or "" for r in rows) == ["", "", "", " \n", *["[SECRET] " + "x" * 3000] * 2] and sum(r.text is None for r in rows) == 2
            assert {r.n_chars for r in rows if (r.text or "").startswith("[")} == {3009}
        if name == "language_id":
            assert all((r.text or "").strip() for r in rows)


def test_a_filter_on_the_language_judges_texts_once(spark):
    docs = spark.createDataFrame([row(i, f"{'the quick brown fox' if i % 2 else 'le renard brun rapide'} {i}", lang="en" if i % 2 else "fr") for i in range(40)], COLUMNS)
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r.doc_id, r.lang) for r in kept.collect()) == [(i, "en" if i % 2 else "fr") for i in range(40)]


def test_secrets_are_redacted_without_python_on_executors(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([row(1, "password: abcdefgh12345678 end"), row(2, "none")], COLUMNS)
    docs.write.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(spark.sparkContext, "pythonExec", str(tmp_path / "no-python"))
    got = corpus_pipeline.redact_secrets(spark, spark.read.parquet(str(tmp_path / "docs")), "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "[SECRET] end"), (2, "none")]


def test_tokens_leave_a_task_portion_by_portion(spark):
    import pandas as pd
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    texts = [f"number {i} of several long texts, é 漢字 " * 3000 for i in range(18)] + [""]
    given = pd.DataFrame({"doc_id": range(19), "text": texts})
    for decodes in (True, False):
        frames = list(sentencepiece_bpe.coded(sentencepiece_bpe.Coder(sentencepiece_bpe.default_model(), decodes), iter([given])))
        assert len(frames) > 2 and max(len(f) for f in frames) < 10
        out = pd.concat(frames)
        assert out.doc_id.tolist() == list(range(19)) and out.n_tokens.tolist() == [len(sp.encode(t)) + 1 for t in texts]
        assert out.ids.tolist() == [" ".join(map(str, [*sp.encode(t), 2])) for t in texts]
        assert (out.decoded.tolist() == texts) if decodes else "decoded" not in out
    got = corpus_pipeline.tokenize(spark, spark.createDataFrame([row(i, t) for i, t in enumerate(texts[-2:])], COLUMNS), "")
    assert got.columns == ["doc_id", "n_tokens", "ids"] and sorted(r.ids for r in got.collect()) == sorted(" ".join(map(str, [*sp.encode(t), 2])) for t in texts[-2:])


def test_a_blob_with_its_salts_is_not_broadcast(spark):
    # Spark sizes the exploded rows as one a blob.
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, blob string")
    found = spark.createDataFrame([("a", [(0, 3)])], "blob string, cuts array<struct<start:long,end:long>>")
    met = secret_scan.with_blobs(rows, found, F.col("doc_id"))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted((r.doc_id, r.cuts is None) for r in met.collect()) == [(1, False), (2, True)]


def test_exploded_keys_are_not_broadcast(spark, monkeypatch):
    plans = []

    def written(df, purpose, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.written(df, purpose, **options)

    monkeypatch.setattr(near_copies, "written", written)
    docs = spark.createDataFrame([row(i, f"one two three four five six {i % 3}") for i in range(9)], COLUMNS)
    assert len({r.root for r in near_copies.near_copies(docs).collect()}) == 3
    keyed = [p for p in plans if "lead" in p and "band" in p and "Generate posexplode" in p]
    assert keyed and not any("BroadcastHashJoin" in p for p in keyed)


def test_tokens_are_decoded_and_held_against_the_text(spark, monkeypatch):
    import pandas as pd
    import pytest

    docs = spark.createDataFrame([row(1, "a  b é 漢字"), row(2, None), row(3, "x▁y")], COLUMNS)
    got = corpus_pipeline.tokenize(spark, docs, "")
    assert "decoded" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 3]
    coder = sentencepiece_bpe.Coder(sentencepiece_bpe.default_model())
    coder.bpe.piece_bytes = [b"?"] * coder.bpe.size
    with pytest.raises(ValueError, match="document 7"):
        list(sentencepiece_bpe.coded(coder, iter([pd.DataFrame({"doc_id": [7], "text": ["words"]})]), checks=True))
