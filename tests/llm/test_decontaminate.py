"""Decontamination against plain loops."""

import hashlib
import re

import pytest

from jobtide.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UP = re.compile("[A-Z]")
TEN = "one two three four five six seven eight nine ten"


def words(text):
    return WORD.findall(UP.sub(lambda m: m[0].lower(), text or ""))


def plain(docs, items, width=10):
    """(doc_id, n_words, hit words, item ids) of each row, by looking at every place."""
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, of = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i + 1, i + n + 1))
                    of |= grams[tuple(w[i : i + n])]
        out.append((doc, len(w), sorted(hit), sorted(str(x) for x in of if x is not None)))
    return out


DOCS = [
    (1, f"Before. {TEN.upper()}, eleven! after"),
    (2, "ONE-two;three four five six seven eight nine"),  # one word short
    (3, "x Klein Übung Ärger y"),
    (4, None),
    (5, ""),
    (None, f"{TEN} {TEN}"),
    (None, f"{TEN} {TEN}"),
    (6, "--- !!"),
    (7, "short item and klein Übung Ärger short item"),
    (7, "other text of the same id"),
    (8, " ".join(f"w{i}" for i in range(3000)) + " " + TEN),
    (9, "übung klein ÜBUNG"),
]
ITEMS = [(10, f"{TEN} eleven twelve"), (2, "klein Übung Ärger"), (2, "Short item"), (3, None), (4, "?"), (None, "the same id"), (5, TEN)]


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("most", [dc.BROADCAST, 0])
def test_judged(frames, most):
    docs, items = frames
    found = sorted(((r["id"], r["n_words"], r["hit"], r["items"]) for r in dc.judged(docs, items, most_bytes=most).collect()), key=str)
    assert found == sorted(plain(DOCS, ITEMS), key=str)


def test_no_items(frames):
    docs, items = frames
    assert [r["hit"] for r in dc.judged(docs, items.limit(0)).collect()] == [[]] * len(DOCS)
    assert dc.judged(docs.limit(0), items).collect() == []


def test_spans_and_documents_are_removed(spark, frames):
    docs, items = frames
    docs = docs.selectExpr("*", "'kept' as hit", "1 as row", "2 as words")
    left = dc.decontaminated(docs, items)
    assert left.columns == docs.columns
    texts = {(r["doc_id"], r["text"]) for r in left.collect()}
    assert (1, "Before. ! after") in texts  # item 10 goes on to eleven
    assert (2, DOCS[1][1]) in texts and (3, "x  y") in texts and (7, " and ") in texts and (None, "") in texts
    assert (7, "other text of ") in texts and (4, None) in texts and (8, " ".join(f"w{i}" for i in range(3000)) + " ") in texts
    assert left.count() == len(DOCS) and {r["hit"] for r in left.select("hit").collect()} == {"kept"}
    clean = {r["doc_id"] for r in dc.decontaminated(docs, items, "documents").collect()}
    assert clean == {2, 4, 5, 6, 9}
    with pytest.raises(ValueError):
        dc.decontaminated(docs, items, "words")


def test_query(spark, tmp_path):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = dc.op12_decontaminate(spark, str(tmp_path))
    assert "Python" not in rows._jdf.queryExecution().toString()
    sha = lambda ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(((d, n, len(h), len(i), sha(i), bool(h)) for d, n, h, i in plain(DOCS, ITEMS)), key=str)
