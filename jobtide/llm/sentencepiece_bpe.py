"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

No piece holds the space mark after another character, so a text falls into chunks (spaces and
the run that follows) that merge independently. The distinct chunks of a batch become one flat
numpy array of symbols. Each round looks up every adjacent pair, takes the smallest rank within
each chunk (ties: leftmost) and merges it; chunks without a pair leave the array, until none is
left. All occurrences of a chunk's best pair merge at once, leftmost first, where no pair made
by the merge can rank as high as it; where one could (runs of spaces), the leftmost alone does.
Characters without a piece fall back to their UTF-8 bytes.

A chunk takes a round for each of its ranks, so chunks over LONG characters (text without spaces) are
cut first: between two characters that stand side by side in no piece, no merge can reach. What is
still longer is merged by a queue of pairs, in the same order, in n log n steps.

Covers models as the given one: BPE with byte fallback, identity normalisation, a dummy prefix,
no removal of spaces; another model is refused when it is read. Decoding turns bytes that are not
UTF-8 into U+FFFD.

Defined cases: null and empty texts encode to the end id alone and decode to an empty text; very
long texts and words take time in proportion; repeated rows and null ids keep a result row each;
empty tables give empty results; extra input columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import portions, table, text_of, tidy

CHUNK = re.compile(r" *[^ ]+| +")
MARK = "▁"
#: Characters beyond which a chunk is cut and queued.
LONG = 400
#: Distinct chunks, and their characters, kept by a task; beyond it the store starts anew, results do not change.
KEPT, KEPT_CHARS = 200_000, 4_000_000
#: Characters of texts that are coded together; their results leave the task before the next are coded.
PORTION = 500_000
#: Texts that a model with another kind or normalisation encodes differently.
PROBES = ("  Two  spaces ", "ﬁ Ａ① é e\u0301", "\t\n \u00a0", "▁x▁▁", "𝒳漢字", "aaaa bbbb unbelievable")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Bpe:
    """Tables of one model, and merge rounds over them."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        plain = {sp.id_to_piece(i).replace(MARK, " "): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        self.end, self.size = sp.eos_id(), n
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        if any(" " in piece.lstrip(" ") for piece in plain):
            raise ValueError("this model has pieces that reach over a space")
        inner = {ord(a) * 0x110000 + ord(b) for piece in plain for a, b in zip(piece, piece[1:])}
        self.inner = np.array(sorted(inner), np.int64)
        symbols = dict(plain)
        for piece in plain:
            for c in piece:
                symbols.setdefault(c, len(symbols) + n)
        self.width = max(symbols.values()) + 1
        self.of_char = np.full(0x110000, -1, np.int64)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        score = np.array([sp.get_score(i) for i in range(n)])
        rank = np.unique(-score, return_inverse=True)[1]
        pairs = {}
        for piece, i in plain.items():
            for cut in range(1, len(piece)):
                a, b = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = i
        self.pairs = {k: (int(rank[i]), i) for k, i in pairs.items()}
        self.keys = np.array(sorted(pairs))
        self.made = np.array([pairs[k] for k in self.keys.tolist()])
        self.rank = rank[self.made]
        best = np.full(self.width, np.iinfo(np.int64).max)
        np.minimum.at(best, self.keys // self.width, self.rank)
        np.minimum.at(best, self.keys % self.width, self.rank)
        self.alone = best[self.made] <= self.rank  # of pairs: a pair with what they make could rank as high
        self.none = int(rank.max()) + 1
        pieces = [b"" if sp.is_control(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        pieces[sp.unk_id()] = " ⁇ ".encode()
        self.piece_bytes = pieces
        for probe in PROBES:
            chunks = CHUNK.findall(" " + probe.replace(MARK, " "))
            if self.encode_chunks(chunks)[0] != sp.encode(probe) or self.encode_chunks(chunks, 0)[0] != sp.encode(probe):
                raise ValueError("not a BPE model with byte fallback, identity normalisation and a dummy prefix")

    def cut(self, chunk: str) -> list[str]:
        """Parts of a chunk that merge independently."""
        codes = np.frombuffer(chunk.encode("utf-32-le"), np.uint32).astype(np.int64)
        key = codes[:-1] * 0x110000 + codes[1:]
        at = np.minimum(np.searchsorted(self.inner, key), len(self.inner) - 1)
        ends = [0, *(np.flatnonzero(self.inner[at] != key) + 1).tolist(), len(chunk)]
        return [chunk[a:b] for a, b in zip(ends, ends[1:])]

    def queued(self, chunk: str) -> list[int]:
        """The ids of one chunk: pairs leave a queue by rank, then place."""
        codes = np.frombuffer(chunk.encode("utf-32-le"), np.uint32)
        sym, pairs, width, n = self.of_char[codes].tolist(), self.pairs, self.width, len(codes)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []

        def offer(i: int, j: int) -> None:
            if sym[i] >= 0 and sym[j] >= 0 and (pair := pairs.get(sym[i] * width + sym[j])):
                heapq.heappush(queue, (pair[0], i, sym[i], sym[j], pair[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, left, right, made = heapq.heappop(queue)
            j = after[i]
            # What was merged since it was offered no longer reads the same.
            if sym[i] != left or j == n or sym[j] != right:
                continue
            sym[i], sym[j], k = made, -2, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        out = []
        for i, s in enumerate(sym):
            if 0 <= s < self.size:
                out.append(s)
            elif s != -2:
                out.extend(self.byte_id[np.frombuffer(chunk[i].encode(), np.uint8)].tolist())
        return out

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place in the pair table, -1 where the two do not merge."""
        key = np.where((left >= 0) & (right >= 0), left * self.width + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def encode_chunks(self, chunks: list[str], most: int = LONG) -> tuple[list[int], list[int]]:
        """The ids of all chunks in one list, and where each chunk's begin and end (spaces stand for the mark).

        Chunks over `most` characters go by the queue, the others by rounds.
        """
        short = [c for c in chunks if len(c) <= most]
        ids, cut = self.rounds(short)
        if len(short) == len(chunks):
            return ids, cut
        out, ends, at = [], [0], 0
        for chunk in chunks:
            if len(chunk) <= most:
                out.extend(ids[cut[at] : cut[at + 1]])
                at += 1
            else:
                out.extend(self.queued(chunk))
            ends.append(len(out))
        return out, ends

    def rounds(self, chunks: list[str]) -> tuple[list[int], list[int]]:
        """`encode_chunks` by merge rounds over all chunks at once."""
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).astype(np.int64)
        sym, owner = self.of_char[codes], np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
        last = np.r_[owner[1:] != owner[:-1], True]
        at = np.full(len(sym), -1)
        inner = np.flatnonzero(~last)
        at[inner] = self.look_up(sym[inner], sym[inner + 1])
        rank_of = np.r_[self.rank, self.none]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.r_[True, last[:-1]]
            starts = np.flatnonzero(first)
            rank = rank_of[at]
            least = np.minimum.reduceat(rank, starts)
            lens = np.diff(np.r_[starts, len(sym)])
            low = np.repeat(least, lens)
            live = low < self.none
            where = np.flatnonzero((rank == low) & live)
            if len(where):
                new = np.r_[True, owner[where[1:]] != owner[where[:-1]]]
                # Overlapping occurrences stand in runs of neighbours; every second one merges.
                head = np.r_[True, (np.diff(where) != 1) | new[1:]]
                nth = np.arange(len(where)) - np.flatnonzero(head)[np.cumsum(head) - 1]
                where = where[np.where(self.alone[at[where]], new, nth % 2 == 0)]
                sym[where] = self.made[at[where]]
                last[where] = last[where + 1]
            stay, changed = live.copy(), np.zeros(len(sym), bool)
            stay[where + 1] = False
            changed[where] = True
            before = where[~first[where]] - 1
            changed[before] = True
            # A symbol before a merge may itself have just been swallowed by the merge before it.
            swallowed = before[~stay[before]]
            changed[swallowed - 1] = True
            if not live.all():
                done.append((owner[~live], sym[~live], codes[~live]))
            sym, owner, codes, last, at, changed = (x[stay] for x in (sym, owner, codes, last, at, changed))
            at[changed & last] = -1
            redo = np.flatnonzero(changed & ~last)
            at[redo] = self.look_up(sym[redo], sym[redo + 1])
        owner, sym, codes = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 3
        order = np.argsort(owner, kind="stable")
        owner, sym, codes = owner[order], sym[order], codes[order]
        lost = np.flatnonzero((sym < 0) | (sym >= self.size))
        if len(lost):
            raw = [self.byte_id[np.frombuffer(chr(c).encode(), np.uint8)] for c in codes[lost].tolist()]
            n = np.ones(len(sym), np.int64)
            n[lost] = [len(r) for r in raw]
            ids = np.repeat(sym, n)
            begin = (np.cumsum(n) - n)[lost]
            for i, r in zip(begin.tolist(), raw):
                ids[i : i + len(r)] = r
            owner, sym = np.repeat(owner, n), ids
        return sym.tolist(), np.searchsorted(owner, np.arange(len(chunks) + 1)).tolist()

    def decode_bytes(self, ids) -> bytes:
        """The bytes of ids, the dummy prefix still in place."""
        return b"".join([self.piece_bytes[i] for i in ids])

    def decode(self, ids) -> str:
        """The text of a whole sequence of ids."""
        return self.decode_bytes(ids).decode("utf-8", "replace").removeprefix(" ")


class Coder:
    """A model with a bounded store of chunks: ids as text and, where it decodes, their bytes."""

    def __init__(self, model: str, decodes: bool = True):
        self.bpe, self.store, self.chars, self.decodes = Bpe(model), {}, 0, decodes
        self.names = [str(i) for i in range(self.bpe.size)]

    def learn(self, chunks: set[str]) -> None:
        fresh = [c for c in chunks if c not in self.store]
        if len(self.store) + len(fresh) > KEPT or self.chars > KEPT_CHARS:
            self.store.clear()
            self.chars, fresh = 0, list(chunks)
        self.chars += sum(map(len, fresh))
        for at in range(0, len(fresh), 40_000):
            part = fresh[at : at + 40_000]
            ids, cut = self.bpe.encode_chunks(part)
            text, raw = [self.names[i] for i in ids], [self.bpe.piece_bytes[i] for i in ids] if self.decodes else []
            of = ((" ".join(text[a:b]), b"".join(raw[a:b])) if self.decodes else " ".join(text[a:b]) for a, b in zip(cut, cut[1:]))
            self.store.update(zip(part, of))

    def __call__(self, texts: list[str]) -> list[tuple[str, str | None]]:
        """(ids as decimal text with the end id, decoded text or None) of each text."""
        split = [[p for c in CHUNK.findall(" " + t.replace(MARK, " ")) for p in ((c,) if len(c) <= LONG else self.bpe.cut(c))] if t else [] for t in texts]
        self.learn(set().union(*split))
        out = []
        for chunks in split:
            got = [self.store[c] for c in chunks]
            if not self.decodes:
                out.append((" ".join([*got, str(self.bpe.end)]), None))
                continue
            out.append((" ".join([*[g[0] for g in got], str(self.bpe.end)]), b"".join([g[1] for g in got]).decode("utf-8", "replace").removeprefix(" ")))
        return out


def coded(coder: Coder, batches: Iterator[pd.DataFrame], checks: bool = False) -> Iterator[pd.DataFrame]:
    """The results of the batches, portion by portion, so that a task never holds those of a whole batch.

    With `checks`, ids that decode to another text than was given (spaces stand for marks) are an error.
    """
    for batch in batches:
        ids, at = batch.doc_id.astype("Int64"), 0
        for part in portions(batch.text.tolist(), PORTION):
            both = coder(part)
            if checks and (wrong := [at + n for n, (t, (_, d)) in enumerate(zip(part, both)) if d != t.replace(MARK, " ")]):
                raise ValueError(f"the ids of document {ids[wrong[0]]} do not give its text back")
            out = {"doc_id": ids[at : at + len(part)], "n_tokens": [i.count(" ") + 1 for i, _ in both], "ids": [i for i, _ in both]}
            yield pd.DataFrame(out | ({"decoded": [d for _, d in both]} if coder.decodes else {}))
            at += len(part)


def encode(docs: DataFrame, model: str | None = None, checks: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by spaces, end id last) and the decoded text, held against the given one where `checks` is set."""
    model = model or default_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from coded(Coder(model), batches, checks)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInPandas(tidy(run), "doc_id long, n_tokens long, ids string, decoded string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return encode(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op6_sentencepiece": op6_sentencepiece}
