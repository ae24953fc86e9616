"""The registered queries and the pipeline on a small folder, against plain loops over the contracts."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from jobtide.llm import language_id, sentencepiece_bpe
from jobtide.llm.registry import QUERIES

from .test_pipeline_stages import groups

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 2**63


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The smallest tables, with rows of nulls, empty texts, copies and many secrets added."""
    out = tmp_path_factory.mktemp("tables")
    docs = pq.read_table(f"{SMALL}/documents.parquet").replace_schema_metadata(None)
    first = docs.slice(0, 1).to_pylist()[0]
    many = " ".join(f"é token={i:012d} {i:016x}g" for i in range(700))
    odd = [dict(first, doc_id=10**6), dict(first, doc_id=10**6, lang=None), dict(first, doc_id=10**6 + 1, source=None), dict(first, doc_id=10**6 + 2, text=None), dict(first, doc_id=10**6 + 3, text="", lang=None, source=None), dict(first, doc_id=10**6 + 4, text=first["text"] + many)]
    pq.write_table(pa.concat_tables([docs, pa.Table.from_pylist(odd, docs.schema)]), f"{out}/documents.parquet", row_group_size=64)
    pq.write_table(pq.read_table(f"{SMALL}/embeddings.parquet"), f"{out}/embeddings.parquet")
    pages = pq.read_table(f"{SMALL}/pages.parquet").replace_schema_metadata(None)
    few = pages.slice(0, 6).to_pylist()
    odd = [dict(p, page_id=10**6 + i) for i, p in enumerate(few)] + [dict(few[0], page_id=10**6 + 10, html=None), dict(few[0], page_id=10**6 + 11, html="", url=None), dict(few[0], page_id=10**6 + 12, html="small"), dict(few[0], page_id=10**6 + 13, html="small"), dict(few[0], page_id=-4, html=few[3]["html"])]
    pq.write_table(pa.concat_tables([pages, pa.Table.from_pylist(odd, pages.schema)]), f"{out}/pages.parquet")
    return str(out)


@pytest.fixture(scope="module")
def rows(folder):
    return pq.read_table(f"{folder}/documents.parquet").to_pylist()


def run(spark, folder, name):
    return QUERIES[name](spark, folder).collect()


def sha(raw):
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


def removed(docs, n):
    """docs: (id, sequence) to one flag a unit: windows of n that also start in a smaller id."""
    least = {}
    for d, u in docs:
        for i in range(len(u) - n + 1):
            w = u[i : i + n]
            if least.get(w, LAST) > d:
                least[w] = d
    out = []
    for d, u in docs:
        gone, until = bytearray(len(u)), 0
        for i in range(len(u) - n + 1):
            if least[u[i : i + n]] < d:
                for j in range(max(i, until), i + n):
                    gone[j] = 1
                until = i + n
        out.append(gone)
    return out


def test_op1(spark, folder, rows):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in rows]
    want = []
    for (d, raw), gone in zip(docs, removed(docs, 50)):
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want.append((d, len(raw), sum(gone), len(re.findall(b"\x01+", bytes(gone))), sha(kept)))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, folder, "op1_suffix_dedup")]
    assert sorted(got) == sorted(want) and any(w[2] for w in want)


def test_op3(spark, folder, rows):
    docs = [(r["doc_id"], tuple(WORD.findall(r["text"] or ""))) for r in rows]
    want = []
    for (d, words), gone in zip(docs, removed(docs, 50)):
        want.append((d, len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone) if not g))))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, folder, "op3_substring_dedup")]
    assert sorted(got) == sorted(want) and any(w[2] for w in want)


def fingerprint(text):
    """One bit at a time, from the contract."""
    import xxhash

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(docs):
    """(id, text) to (fingerprint, smallest id reachable) of each."""
    prints = [fingerprint(t) for _, t in docs]
    group = list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), LAST), d)
    return [(p, least[root(i)]) for i, p in enumerate(prints)]


def test_op2(spark, folder, rows):
    want = [(r["doc_id"], f"{p:016x}", c) for r, (p, c) in zip(rows, linked([(r["doc_id"], r["text"]) for r in rows]))]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in run(spark, folder, "op2_simhash")]
    assert sorted(got) == sorted(want) and len({w[2] for w in want}) < len(rows)


RULES = (("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))


def test_op4(spark, folder, rows):
    want = []
    for r in rows:
        found = sorted((m.start(), o, m.end(), kind) for o, (kind, p, g, least) in enumerate(RULES) for m in p.finditer(r["text"] or "") if len(m[g]) >= least)
        spans = ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)
        want.append((r["doc_id"], *(sum(f[3] == k for f in found) for k in ("assign", "access", "hex")), sha(spans), spans))
    got = [(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in run(spark, folder, "op4_secret_scan")]
    assert sorted(got) == sorted(want) and max(w[1] for w in want) >= 700


def mixed(rows):
    """Taken words of each row: excess is shared again until no source is above its limit."""
    size = [len(WORD.findall(r["text"] or "")) for r in rows]
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(n for n, r in zip(size, rows) if r["source"] == s) for s in names}
    target, left = {}, 1.5 * sum(size)
    while len(target) < len(names):
        open_ = [s for s in names if s not in target]
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 2 * total[s]]
        for s in full or open_:
            target[s] = 2.0 * total[s] if full else weight[s] * level
        left -= sum(target[s] for s in full)
    taken = [0] * len(rows)
    for s in names:
        mine = [i for i, r in enumerate(rows) if r["source"] == s]
        epochs = math.floor(target[s] / total[s]) if total[s] else 0
        rest = math.floor(target[s] - epochs * total[s])

        def key(i):
            text = rows[i]["text"] or ""
            u = (int(hashlib.md5(f"mix-1{rows[i]['doc_id']}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            return -math.log(u) / (0.5 + 1.5 * len(re.findall("[A-Za-z]", text)) / max(len(text), 1)), rows[i]["doc_id"]

        for i in sorted(mine, key=key):
            part = min(size[i], rest)
            taken[i], rest = size[i] * epochs + part, rest - part
    return size, total, target, taken


def test_op5(spark, folder, rows):
    size, total, target, taken = mixed(rows)
    got = run(spark, folder, "op5_source_mix")
    want = sorted((r["doc_id"], n, total[r["source"]], t) for r, n, t in zip(rows, size, taken))
    assert sorted((r.doc_id, r["size"], r.source_size, r.taken) for r in got) == want
    assert np.allclose(sorted(r.target for r in got), sorted(target[r["source"]] for r in rows))


@pytest.fixture(scope="module")
def tokenizer():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())


def test_op6(spark, folder, rows, tokenizer):
    want = []
    for r in rows:
        ids = tokenizer.encode(r["text"] or "", add_eos=True)
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids))))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, folder, "op6_sentencepiece")]
    assert sorted(got) == sorted(want)


def test_op7(spark, folder):
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in pq.read_table(f"{folder}/pages.parquet").to_pylist()]
    least = {}
    for i, raw in pages:
        least[raw] = min(i, least.get(raw, i))
    to = [least[raw] if len(raw) >= 100 and least[raw] != i else None for i, raw in pages]
    want = sorted((i, len(raw), sha(raw), "response" if t is None else "revisit", t or 0) for (i, raw), t in zip(pages, to))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in run(spark, folder, "op7_warc_zip")]
    assert sorted(got) == want and sum(w[3] == "revisit" for w in want) >= 6


def test_op8(spark, folder):
    table = pq.read_table(f"{folder}/embeddings.parquet").to_pylist()
    table = [r for r in table if r["embedding"] is not None and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and any(r["embedding"])]
    ids, x = np.array([r["vec_id"] for r in table]), np.array([r["embedding"] for r in table], np.float64)
    found = {}
    for r in run(spark, folder, "op8_ann"):
        found.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    assert set(found) == {i for i in ids.tolist() if i % 100 == 0}
    hits = asked = 0
    for q, near in found.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        best = sorted((s, i) for s, i in zip(d.tolist(), ids.tolist()) if i != q)[:10]
        assert sorted(near) == list(range(1, len(best) + 1)) and [near[k] for k in sorted(near)] == sorted(near.values())
        exact = dict(zip(ids.tolist(), d.tolist()))
        assert all(abs(s - exact[i]) <= 1e-12 * (1 + s) and i != q for s, i in near.values())
        hits, asked = hits + len({i for _, i in best} & {i for _, i in near.values()}), asked + len(best)
    assert hits >= 0.9 * asked


def test_op9(spark, folder, rows):
    got = run(spark, folder, "op9_language_id")
    assert sorted((r.doc_id, r.held_out) for r in got) == sorted((r["doc_id"], zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    lang = {r["doc_id"]: r["lang"] for r in rows}
    letters = {r["doc_id"]: any(c.isalpha() for c in r["text"] or "") for r in rows}
    judged = [r for r in got if r.held_out and letters[r.doc_id] and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in judged) >= 0.9 * len(judged)
    assert all((r.lang_pred == "und") == (not letters[r.doc_id]) and 0 <= r.score <= 1 for r in got)


def test_op10(spark, folder, rows):
    want = []
    for r in rows:
        raw = (r["text"] or "").encode()
        pay = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.append((r["doc_id"], len(raw), len(pay), sha(pay), zlib.crc32(pay[-64:]), len(pay) + 44))
    got = run(spark, folder, "op10_audio_features")
    assert sorted((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) for r in got) == sorted(want)
    assert len({r.feature for r in got}) == len({r.payload_sha256 for r in got}) == len({(r.media_sha256, r.feature) for r in got})


def ordered(rows):
    return sorted(rows, key=lambda r: str(sorted(r.items())))


def redacted(text):
    """Runs of characters that some finding covers become one mask each."""
    gone = bytearray(len(text))
    for _, p, g, least in RULES:
        for m in p.finditer(text):
            if len(m[g]) >= least:
                gone[m.start() : m.end()] = b"\x01" * len(m[0])
    return re.sub("\x01+", "[SECRET]", "".join("\x01" if g else c for c, g in zip(text, gone)))


def test_pipeline(spark, folder, rows, tokenizer):
    names, stages = zip(*corpus_pipeline.STAGES)
    assert names == ("language_id", "simhash_dedup", "secret_scan", "source_mix", "sentencepiece")
    docs, given, seen = spark.read.parquet(f"{folder}/documents.parquet"), rows, []
    columns = docs.columns
    for n, stage in enumerate(stages):
        # A stage is judged on the rows that came out of the one before it.
        docs = stage(spark, docs, folder)
        seen.append([r.asDict() for r in docs.collect()])
        if n < 4:
            assert docs.columns == columns
            docs = spark.createDataFrame(seen[-1], docs.schema).select(*columns)
    lang, unique, clean, mix, tokens = seen

    source = spark.read.parquet(f"{folder}/documents.parquet")
    judged = language_id.predict(source, language_id.train(source)).collect()
    good = {r.doc_id: r.lang_pred for r in judged if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE}
    with_text = [r for r in rows if r["text"]]
    assert ordered(lang) == ordered([dict(r, lang=good[r["doc_id"]]) for r in with_text if r["doc_id"] in good])
    assert len(lang) >= 0.9 * len([r for r in rows if re.search("[A-Za-z]", r["text"] or "")])

    # Near copies in a stage: five words, similarity 0.8 or more.
    near = {}
    for r, c in zip(lang, groups([(r["doc_id"], r["text"]) for r in lang])):
        if r["doc_id"] == c:
            near.setdefault(c, r)
    assert ordered(unique) == ordered(near.values())

    assert ordered(clean) == ordered([dict(r, text=redacted(r["text"]), n_chars=len(redacted(r["text"])) if redacted(r["text"]) != r["text"] else len(r["text"])) for r in unique])
    assert any("[SECRET]" in r["text"] for r in clean)

    size, _, _, taken = mixed(clean)
    copies = [math.floor(t / n + 0.5) if n else 0 for t, n in zip(taken, size)]
    assert ordered(mix) == ordered([r for r, k in zip(clean, copies) for _ in range(k)])

    assert sorted((r["doc_id"], r["ids"]) for r in tokens) == sorted((r["doc_id"], " ".join(map(str, tokenizer.encode(r["text"], add_eos=True)))) for r in mix)

    whole = entry.queries()["pipeline"](spark, folder).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids) for r in whole) == sorted((r["doc_id"], r["n_tokens"], r["ids"]) for r in tokens)
