"""Packing of token pieces into fixed-length sequences.

Texts become token ids inside Arrow batches, long documents are cut at multiples of the sequence length,
and the pieces are packed by first-fit decreasing, independently in randomised groups. In a group the
open sequences' free places are the leaves of a tournament tree, so the first sequence that a piece fits
is found in logarithmic time. Only piece lengths are shuffled for packing, never token ids.

The tokenizer is a byte-pair vocabulary with word ends. Its pre-tokens are found for many texts at once, by
the kinds of their code points; Arrow tells them apart, and each distinct one is encoded once per worker
(bounded cache), in bulk, with the vocabulary's merges as ranks. What could differ that way goes to the
tokenizer itself: pre-tokens that hold the end mark, and texts with letters that Python does not know yet.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jadwal.llm.common import partitions, table, text_slices, written
from jadwal.shipping import ship

LENGTH = 2048
END_ID = 1
GROUP_PIECES = 8192
REPEATS = 65_536  # equal rows that one task tells apart
CACHE_WORDS, CACHE_BYTES = 150_000, 24 << 20  # the words and ids that a worker keeps
DOCS_AT_ONCE, BYTES_AT_ONCE = 1000, 2 << 20  # texts that are encoded together
LONG = 1 << 20  # a text of more characters is encoded in parts
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

# The vocabulary's pre-tokenizer.
OTHER, LETTER, SINGLE, SPACE, NEW = range(5)  # NEW: letters and numbers that Python's tables do not have yet
SHORT = [ord(c) for c in "stmd"]
LONGER = [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")]
END, SURROGATE = b"\x01", 0xD800


class WordTokenizer:
    """Token ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, added = spec["model"]["vocab"], spec["added_tokens"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {}
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a pre-token
        for token, i in vocab.items():
            core, ends = (token[:-4], END) if token.endswith("</w>") else (token, b"")
            if all(c in byte_of for c in core):
                ranks[bytes(byte_of[c] for c in core) + ends] = i
                self.last[i] = bool(ends)
        self.words = tiktoken.Encoding("words", pat_str="[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})
        self.space = regex.compile(r"\s")
        every = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
        self.kind = np.full(len(every), OTHER, "u1")
        for m in regex.finditer(r"(\p{L}+)|(\p{N}+)|(\s+)", every):
            self.kind[m.start() : m.end()] = m.lastindex
        known = np.flatnonzero((self.kind == LETTER) | (self.kind == SINGLE))
        self.kind[[c for c in known.tolist() if unicodedata.category(every[c]) == "Cn"]] = NEW
        # Tokens that are found in a text as it stands are shown as lone surrogates, which no text holds.
        self.marks = {t["content"]: chr(SURROGATE + k) for k, t in enumerate(added)}
        self.kind[SURROGATE : SURROGATE + len(added)] = SINGLE
        self.marked = {self.marks[t["content"]].encode("utf-8", "surrogatepass"): np.array([t["id"]], "<u4").tobytes() for t in added}
        self.forget()

    def forget(self) -> None:
        self.cache: dict[bytes, bytes] = dict(self.marked)
        self.held = 0

    def _normal(self, text: str) -> str:
        for token, mark in self.marks.items():
            text = text.replace(token, mark)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # only Python's lower() has a final sigma

    def _pre_tokens(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, list[int]]:
        """The pre-tokens of normal texts in order, as UTF-8; how many there are up to the end of each text; which texts hold NEW characters.

        Pre-tokens are runs of letters, single numbers, and runs of other characters. An apostrophe that begins one takes s, t, m, d, re, ve or ll with it.
        """
        points = np.frombuffer("\n".join([*texts, "\n"]).encode("utf-32-le", "surrogatepass"), "<u4")
        kind = self.kind[points]
        before = np.roll(kind, 1)
        begins = (kind != before) | (kind == SINGLE)
        at = np.flatnonzero((points == ord("'")) & (before != OTHER))
        pair = (points[at + 1] << 8) | (points[at + 2] & 255)
        for n, fits in ((1, np.isin(points[at + 1], SHORT)), (2, np.isin(pair, LONGER) & (points[at + 2] < 128))):
            begins[at[fits] + 1] = False
            begins[at[fits] + n + 1] = True
        shown = kind != SPACE
        begins &= shown
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        ends = np.searchsorted(np.flatnonzero(begins), text_ends)
        new = np.unique(np.searchsorted(text_ends, np.flatnonzero(kind == NEW), "right")).tolist()
        points, starts = points[shown], np.flatnonzero(begins[shown])
        data = points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        if len(data) > len(points):
            width = 1 + (points > 0x7F).astype("u1") + (points > 0x7FF) + (points > 0xFFFF)
            starts = (np.cumsum(width, dtype="i8") - width)[starts]
        offsets = np.append(starts, len(data)).astype("i8")
        return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), ends, new

    def learn(self, words: list[bytes]) -> None:
        """Keep the ids of pre-tokens. One that holds the end mark itself goes to the tokenizer."""
        known = [w for w in words if END not in w]
        ids = np.array(self.words.encode_ordinary((END.join(known) + END).decode()) if known else [], "<u4")
        raw, to = ids.tobytes(), (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        self.cache.update(zip(known, [raw[a:b] for a, b in zip([0, *to], to)], strict=True))
        self.held += len(raw) + sum(map(len, words))
        for w in words if len(known) < len(words) else []:
            if END in w:
                self.cache[w] = self._exactly(w.decode())

    def _exactly(self, text: str) -> bytes:
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, texts: list[str]) -> list[bytes]:
        words, ends, new = self._pre_tokens([self._normal(t) for t in texts])
        coded = words.dictionary_encode()
        found, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if len(self.cache) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.forget()
        get = self.cache
        self.learn([w for w in found if w not in get])
        ids = [get[w] for w in found]
        size = np.fromiter(map(len, ids), "i8", len(ids)) // 4
        counts = size[codes]
        upto = np.append(0, np.cumsum(counts))
        at = np.repeat((np.cumsum(size) - size)[codes] - upto[:-1], counts) + np.arange(upto[-1])
        flat, to = np.frombuffer(b"".join(ids), "<u4")[at].tobytes(), (4 * upto[ends]).tolist()
        encoded = [flat[a:b] for a, b in zip([0, *to], to)]
        for i in new:
            encoded[i] = self._exactly(texts[i])
        return encoded

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        if max(map(len, texts), default=0) <= LONG:
            return self._ids(texts)
        return [b"".join(self._ids([part])[0] for part in self._parts(t)) for t in texts]

    def _parts(self, text: str) -> Iterator[str]:
        """A long text, cut at white space."""
        at = 0
        while (m := self.space.search(text, at + LONG)) is not None:
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]


@lru_cache(maxsize=1)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, with_ids: bool = False, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """PIECES for every document (and ``ids`` array<int> if asked for): its ids, then ``end_id``, cut at ``length``.

    A null or empty text has the one id ``end_id``. Repeated rows give repeated pieces. Columns other
    than doc_id and text are ignored.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        for batch in batches:
            for part in text_slices(batch, 1, DOCS_AT_ONCE, BYTES_AT_ONCE):
                rows: list[tuple] = []
                raw: list[bytes] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), tok.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, length):
                        piece = ids[4 * start : 4 * (start + length)]
                        rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n))
                        raw.append(piece)
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(p, "<u4").astype("i4") for p in raw], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


class TournamentTree:
    """Free places of sequences in order; finds the first with room for a piece."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, free places before) of the first sequence with ``size`` free places, which are taken."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        free = best[node]
        best[node] = free - size
        found = node - self.leaves
        while node > 1:
            node //= 2
            top = max(best[2 * node], best[2 * node + 1])
            if best[node] == top:
                break
            best[node] = top
        return found, free


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece; equal lengths keep their order."""
    sequence, offset = np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8")
    tree = TournamentTree(len(lengths), capacity)
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        found, free = tree.place(n)
        sequence[i], offset[i] = found, capacity - free
    return sequence, offset


def numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``copy``: 0, 1, ... among equal rows. Equal rows are counted before they are told apart, so that they never meet in one task."""
    counted = written(pieces.groupBy(*pieces.columns).agg(F.count("*").alias("__m")), "distinct-pieces")
    chunks = counted.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("__m") - 1) / REPEATS))))
    if not counted.where(F.col("__m") > REPEATS).isEmpty():
        chunks = chunks.repartition(partitions(pieces.sparkSession))
    last = F.least(F.col("__m"), (F.col("__chunk") + 1) * REPEATS) - 1
    return chunks.select(*pieces.columns, F.explode(F.sequence(F.col("__chunk") * REPEATS, last)).alias("copy"))


def pack(pieces: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES, seed: int = 7) -> DataFrame:
    """``pieces`` (PIECES) with sequence_id and offset; no piece is longer than ``length``.

    Groups are drawn by a hash of the row and of its number among equal rows, so neither repeated rows nor one document's pieces
    can fill a group, and the same pieces get the same sequences however their files are laid out.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    drawn = numbered(pieces).withColumn("group", F.pmod(F.xxhash64(F.lit(seed), *pieces.columns, "copy"), F.lit(groups))).drop("copy")

    def one(t: pa.Table) -> pa.Table:
        order = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = first_fit_decreasing(order.column("length").to_numpy(), length)
        base = order.column("group")[0].as_py() << 32
        return order.drop_columns(["group"]).append_column("sequence_id", pa.array(base + sequence)).append_column("offset", pa.array(offset))

    return drawn.groupBy("group").applyInArrow(one, PIECES + ", sequence_id long, offset long")


def sequences(packed: DataFrame, pieces_with_ids: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids array<int> (at most the sequence length)."""
    placed = pieces_with_ids.join(packed.select("doc_id", "start", "ids_crc32", "sequence_id", "offset"), ["doc_id", "start", "ids_crc32"])
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Every document's pieces with their place: PIECES, sequence_id, offset. Empty tables give none.

    A text of any length is encoded whole, word by word; what is held of it is the text, its ids, and a bounded cache of words. Its pieces
    are drawn into groups like all others.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack(written(token_pieces(docs, tokenizer_path), "pieces"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
