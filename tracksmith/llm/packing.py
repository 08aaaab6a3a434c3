"""Packing tokenised documents into fixed-length sequences by their length histogram.

Shortest-pack-first: lengths are placed longest first, each into the pack with most room, on
counts of packing patterns rather than on documents, so the plan costs the same for a
thousand or a trillion documents. Patterns are joined back to pieces by the rank of a piece
among those of its length.

A document is its token ids and an end id. Only documents longer than a sequence are cut, into
full sequences and a rest.

Defined cases: null and empty texts are the end id alone; repeated rows are packed once each;
very long documents are as many full sequences as they fill.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.llm.common import materialize, running_total

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, piece_hash long"
TOKENIZER = "word_bpe_49k.json"
#: Words a Python worker remembers, about 200 bytes each; the number changes speed and memory only.
WORDS = 1_600_000
ASCII_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")

#: Byte-level tokenizers show printable bytes as themselves and the others, in order, from 256 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class WordTokenizer:
    """Ids of whole texts by a tokenizer whose words never cross ASCII white space.

    Words are encoded once and remembered, up to ``memory`` of them in two halves: once the newer
    half is full, the older one is forgotten, so frequent words stay. New words are encoded as one text, parted by ``mark``, a word of one id that no other word
    contains; words that do contain it are encoded alone.
    """

    mark = "|"

    def __init__(self, path: str, memory: int = WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.memory, self.known, self.older = Tokenizer.from_file(path), memory, {}, {}
        self.model = self.tokenizer.model
        (self.mark_id,) = self._ids(self.mark)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _lone(self, word: bytes) -> bytes | None:
        """The ids of a word of lower-case letters in composed form, straight from the merges: nothing
        before them would change or split it."""
        text = word.decode("utf-8")
        if not text.isalpha() or text != text.lower() or not (text.isascii() or is_normalized("NFC", text)):
            return None
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word.decode("latin-1").translate(BYTE_CHARS))])

    def _learn(self, words: set[bytes]) -> None:
        """A word that ends in a letter and then points is its stem and the points: the tokenizer splits there."""
        mark, known = self.mark.encode(), self.known
        pairs = [(w, stem) for w in words if (stem := w.rstrip(b".,!?")) != w and stem and stem[-1] in ASCII_LETTERS]
        words = words.difference(w for w, _ in pairs).union(stem for _, stem in pairs).difference(known)
        plain = []
        for w in words:
            if (ids := self._lone(w)) is not None:
                known[w] = ids
            elif mark in w:
                known[w] = self._ids(w.decode("utf-8")).tobytes()
            else:
                plain.append(w)
        for at in range(0, len(plain), 2_000):
            part = plain[at : at + 2_000]
            ids = self._ids(b" | ".join(part).decode("utf-8"))
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
            assert len(ends) == len(part)
            raw, start = ids.tobytes(), 0
            for w, end in zip(part, (4 * ends).tolist(), strict=True):
                known[w] = raw[start:end]
                start = end + 4
        for w, stem in pairs:
            tail = w[len(stem) :]
            if tail not in known:
                known[tail] = self._ids(tail.decode()).tobytes()
            known[w] = known[stem] + known[tail]

    def _know(self, words: set[bytes]) -> None:
        """Recalls words from the older half of the memory or learns them."""
        if len(self.known) + len(words) > self.memory // 2:
            self.older, self.known = self.known, {}
        older, known = self.older, self.known
        recalled = [w for w in words if w in older]
        known.update(zip(recalled, map(older.__getitem__, recalled), strict=True))
        self._learn(words.difference(recalled))

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text. ``bytes.split`` and ``bytes.lower`` know ASCII only; the tokenizer lower-cases
        all else, save in its special tokens, so texts that may hold one stay as they are."""
        raw = [(t or "").encode("utf-8") for t in texts]
        split = [(t if b"<|" in t else t.lower()).split() for t in raw]
        get = self.known.get
        found = [list(map(get, words)) for words in split]
        gaps, new = [], set()
        for words, ids in zip(split, found, strict=True):
            at = []
            k = ids.index(None) if None in ids else -1
            while k >= 0:
                at.append(k)
                new.add(words[k])
                try:
                    k = ids.index(None, k + 1)
                except ValueError:
                    k = -1
            gaps.append(at)
        self._know(new)
        for words, ids, at in zip(split, found, gaps, strict=True):
            for k in at:
                ids[k] = self.known[words[k]]
            yield np.frombuffer(b"".join(ids), dtype="<u4")


@functools.cache
def tokenizer_of(path: str, memory: int) -> WordTokenizer:
    """One for a Python worker, so that later tasks start with its memory."""
    return WordTokenizer(path, memory)


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    return [(i, min(size, n - i)) for i in range(0, n, size)]


def tokenized_pieces(docs: DataFrame, path: str, size: int, end_id: int, with_ids: bool = False, memory: int = WORDS) -> DataFrame:
    """The pieces of all documents in one pass over the texts; with their ids on request."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path, memory)
        end = np.array([end_id], dtype="<u4")
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer.encode(batch.column(1).to_pylist()), strict=True):
                ids = np.concatenate([ids, end])
                for start, length in cuts(len(ids), size):
                    piece = ids[start : start + length]
                    crc = zlib.crc32(piece.tobytes())
                    rows.append((doc_id, start, length, crc, len(ids), crc << 13 ^ start) + ((piece.astype("int32"),) if with_ids else ()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * (7 if with_ids else 6)
            kinds = [pa.int64()] * 6 + ([pa.list_(pa.int32())] if with_ids else [])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split(" ")[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, schema)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths in order, count) that place every length of the histogram.

    Patterns are kept by the room they leave; a placement moves a count from one pattern to
    its extension. Work depends on the number of distinct lengths, not on the counts.
    """
    room: dict[int, dict[tuple[int, ...], int]] = {}
    top = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while top and not room.get(top):
                top -= 1
            if top >= length:
                pattern, count = next(iter(room[top].items()))
                moved = min(count, left)
                if moved == count:
                    del room[top][pattern]
                else:
                    room[top][pattern] = count - moved
                pattern, rest = (*pattern, length), top - length
                left -= moved
            else:  # a new pack has most room until it is full of this length
                each = min(size // length, left)
                moved, pattern, rest = left // each, (length,) * each, size - length * each
                left -= moved * each
            kind = room.setdefault(rest, {})
            kind[pattern] = kind.get(pattern, 0) + moved
            top = max(top, rest)
    return sorted((p, n) for kind in room.values() for p, n in kind.items())


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (doc_id, start, length, ...)."""
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    runs, first = [], 0  # (length, first rank, first sequence, offset): ranks of a run go to sequences one by one
    taken = dict.fromkeys(histogram, 0)
    for pattern, count in shortest_pack_first(histogram, size):
        offset = 0
        for length in pattern:
            runs.append((length, taken[length], first, offset))
            taken[length] += count
            offset += length
        first += count
    assert taken == histogram
    runs.sort()
    lengths, ranks, firsts, offsets = (np.array(x, dtype=np.int64) for x in (zip(*runs, strict=True) if runs else [()] * 4))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.searchsorted(lengths, np.arange(size + 2)), None
        high = np.append(low[1:], len(lengths))
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            run = np.zeros(len(length), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                n = int(length[part[0]])
                run[part] = low[n] + np.searchsorted(ranks[low[n] : high[n]], rank[part], side="right") - 1
            keep = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "rank"]
            names = [f.name for f in batch.schema if f.name != "rank"]
            placed = [pa.array(firsts[run] + rank - ranks[run]), pa.array(offsets[run])] if len(runs) else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*keep, *placed], [*names, "sequence_id", "offset"])

    ranked = running_total(pieces.withColumn("_one", F.lit(1)), "length", ["piece_hash", "doc_id", "start"], "_one", "rank").drop("_one")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, size: int = 4096, end_id: int = 2, with_ids: bool = False, memory: int = WORDS) -> DataFrame:
    """Tokenises and packs whole documents; every id lies in exactly one piece."""
    pieces = materialize(tokenized_pieces(docs, path, size, end_id, with_ids, memory), "pieces")
    return pack(pieces, size).drop("piece_hash")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))
