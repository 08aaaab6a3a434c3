"""Katz backoff: Good-Turing discounted n-grams of every order up to three, evaluated recursively.

A token's probability is that of its n-gram, discounted, where training saw the n-gram, and
otherwise the history's backoff weight times the probability that the next lower order gives,
down to discounted words. Counts of every size are kept, those of one included; the mass that the
discounts free is what the backoff weight hands out, so that for every history the probabilities
of all known words and of the one class of unknown words add up to 1 exactly. A text's history
starts anew.

Documents are encoded once into chunks of local word numbers, files in the shared folder that
tasks open by themselves, so chunks are never exchanged. Words are counted by word hash and numbered
over all chunks, frequent ones first. Then a chunk sends its distinct n-grams of the longest order once, as
a tree of word numbers, to the bucket of their history's last word. All lower orders of an n-gram lie
in the same bucket, which therefore counts every order, works out all discounts and weights and
replies with final probabilities. A history word too frequent for one bucket is dealt out by next word, and
sums by its histories are exchanged. Neither the vocabulary nor the n-grams are ever held by one task
or the driver, which sees how many words of each part have each count.

Words are told apart by 64-bit hashes, n-grams exactly by word numbers, histories whose sums
are exchanged by 64-bit hashes. All rows of one frequent pair of words meet in one bucket.

Defined cases: null and empty texts are the end token alone; without training documents every
probability is 1 (log 0); a null doc_id counts as the id '' for the fold; repeated rows each
count and are each scored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.llm.common import crc_mod, delete_path, discard, fresh_path, materialize

#: Counts up to which Good-Turing discounts apply, and the words of the longest n-grams.
TOP, ORDER = 5, 3
CHUNK_TOKENS, CHUNK_DOCS, BUCKET_TOKENS = 1_000_000, 60_000, 2_000_000
#: No word holds a space, so this hashes no word.
END = np.uint64(xxhash.xxh64_intdigest(b" end"))
#: Numbers of what precedes a text and of all words that training lacks; known words come after them.
START, UNKNOWN, FIRST = 0, 1, 2


# --- the model's numbers ----------------------------------------------------------------------


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """d[r] for counts r = 0..TOP; counts above keep all.

    The highest k for which Good-Turing gives discounts in (0, 1] is used; small corpora may
    have none and are not discounted.
    """
    n = np.concatenate([[0.0], np.asarray(counts_of_counts, dtype=float)])  # n[r], r = 1..TOP+1
    out = np.ones(TOP + 1)
    for k in range(TOP, 0, -1):
        if (n[1 : k + 2] <= 0).any():
            continue
        tail = (k + 1) * n[k + 1] / n[1]
        r = np.arange(1, k + 1)
        d = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) if tail < 1 else np.zeros(k)
        if ((d > 0) & (d <= 1)).all():
            out[1 : k + 1] = d
            break
    out[0] = 0.0
    return out


class Words:
    """Probabilities of words by their training count."""

    def __init__(self, total: int, distinct: int, counts_of_counts: np.ndarray):
        self.total, self.distinct, self.d = total, distinct, discounts(counts_of_counts)
        lost = sum(n * r * (1 - self.d[r]) for r, n in zip(range(1, TOP + 1), counts_of_counts, strict=False))
        seen = (total - lost) / total if total else 0.0
        self.scale = 1.0 if seen < 1 - 1e-12 else total / (total + 1)
        self.unknown = 1.0 - self.scale * seen

    def probability(self, count: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(count))
        kept = self.d[np.minimum(count, TOP)] * (count <= TOP) + (count > TOP)
        return np.where(count > 0, self.scale * kept * count / self.total, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


# --- blobs ------------------------------------------------------------------------------------

HASHES, PLANES, TABLE = 0, 1, 2


def _planes(a: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on are compressed, as high bytes hardly differ."""
    return zstandard.compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"", 3)


def _unplane(raw: bytes, dtype: np.dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def freeze(*arrays: np.ndarray) -> bytes:
    """Arrays to bytes. Hashes stay as they are, numbers are compressed; reals that recur become places in a table of them."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        kind, packed = PLANES, None
        if a.dtype == np.uint64:
            kind, packed = HASHES, a.tobytes()
        elif a.dtype == np.float64 and len(a):
            table, index, many = np.unique(a, return_inverse=True, return_counts=True)
            if 2 * len(table) < len(a):
                often = np.argsort(-many, kind="stable")
                place = np.empty(len(often), dtype=np.uint32)
                place[often] = np.arange(len(often))
                first = _planes(table[often])
                kind, packed = TABLE, struct.pack("<I", len(first)) + first + _planes(place[index])
        packed = _planes(a) if packed is None else packed
        out += [struct.pack("<3sIB", a.dtype.str.encode().ljust(3), len(packed), kind), packed]
    return b"".join(out)


def thaw(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        name, size, kind = struct.unpack_from("<3sIB", raw, at)
        at += 8
        body, dtype = raw[at : at + size], np.dtype(name.strip().decode())
        if kind == HASHES:
            out.append(np.frombuffer(body, dtype=dtype))
        elif kind == TABLE:
            (first,) = struct.unpack_from("<I", body)
            out.append(_unplane(body[4 : 4 + first], dtype)[_unplane(body[4 + first :], np.dtype("<u4"))])
        else:
            out.append(_unplane(body, dtype))
        at += size
    return out


def to_tree(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Distinct rows in lexicographic order as a tree: of each column the differences of siblings and, from
    the second on, how many of them each parent has."""
    out, n = [], len(columns[0])
    new = np.arange(n) == 0
    for level, c in enumerate(columns):
        parent, new = new, new | np.append(True, c[1:] != c[:-1])
        value = c[new].astype(np.int64)
        eldest = parent[new]
        step = np.diff(value, prepend=0)
        out.append(np.where(eldest, value, step).astype(np.uint32))
        if level:
            out.append(np.diff(np.append(np.flatnonzero(eldest), len(value))).astype(np.uint32))
    return out


def from_tree(tree: list[np.ndarray]) -> list[np.ndarray]:
    columns = [np.cumsum(tree[0], dtype=np.int64)]
    for step, many in zip(tree[1::2], tree[2::2], strict=True):
        total, first = np.cumsum(step, dtype=np.int64), np.cumsum(many, dtype=np.int64) - many
        columns = [np.repeat(c, many) for c in columns] + [total - np.repeat(total[first] - step[first], many)]
    return columns


# --- encoding ---------------------------------------------------------------------------------

ENCODED = "chunk long, tokens long, trained long"


def _encode(batches: Iterator[pa.RecordBatch], folder: str, chunk_tokens: int) -> Iterator[pa.RecordBatch]:
    """Writes chunks to files, named by the attempt of the task, so that no two attempts share one."""
    attempt, number = TaskContext.get().taskAttemptId(), 0
    fs, top = pafs.FileSystem.from_uri(folder)
    fs.create_dir(top, recursive=True)
    known: dict[bytes, int] = {}
    ids, train, docs, size = [], [], [], 0

    def flush() -> pa.RecordBatch:
        nonlocal number, size
        number += 1
        chunk = attempt << 24 | number
        tokens = np.concatenate([np.append(d, np.int32(len(known))) for d in docs])
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), dtype=np.uint64, count=len(known))
        rank = np.argsort(-np.bincount(tokens, minlength=len(known) + 1), kind="stable")  # frequent words get small numbers
        place = np.empty(len(rank), dtype=np.uint32)
        place[rank] = np.arange(len(rank))
        none = np.array([i is None for i in ids], dtype=np.uint8)
        row = [np.array([i or 0 for i in ids], dtype=np.int64), none, np.array(train, dtype=np.uint8), np.array([len(d) + 1 for d in docs], dtype=np.uint32)]
        with fs.open_output_stream(f"{top}/{chunk}", compression=None) as file:
            file.write(freeze(*row, np.append(hashes, END)[rank], place[tokens]))
        out = [[chunk], [len(tokens)], [sum(train)]]
        known.clear(), ids.clear(), train.clear(), docs.clear()
        size = 0
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], [f.split(" ")[0] for f in ENCODED.split(", ")])

    for batch in batches:
        for doc_id, flag, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            text = text.as_py()
            words = text.encode("utf-8").lower().split() if text else []
            for w in set(words):
                known.setdefault(w, len(known))
            docs.append(np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words)))
            ids.append(doc_id.as_py())
            train.append(flag.as_py())
            size += len(words) + 1
            if size >= chunk_tokens or len(ids) >= CHUNK_DOCS:
                yield flush()
    if ids:
        yield flush()


def _open(folder: str, chunk: int) -> list[np.ndarray]:
    """ids, which of them are null, training flags and lengths of a chunk's documents, its words' hashes, its tokens."""
    fs, top = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{top}/{chunk}") as file:
        return thaw(file.read())


# --- words ------------------------------------------------------------------------------------


def count_words(chunks: DataFrame, folder: str, bits: int) -> DataFrame:
    """(chunk, part, blob, stats): for every chunk the training counts of its words, by hash, and their ranks, in
    ``2 ** bits`` parts; stats (chunk null) are a part's tokens, words, counts of counts, and how
    many words have each count."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column("chunk").to_pylist():
                *_, train, lengths, words, tokens = _open(folder, chunk)
                seen = np.bincount(tokens[np.repeat(train, lengths) == 1], minlength=len(words))
                order = np.argsort(words)
                part = (words[order] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)
                edges = np.searchsorted(part, np.arange((1 << bits) + 1))
                blobs = [freeze(words[order[a:b]], seen[order[a:b]].astype(np.uint32)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(blobs)), pa.array(np.arange(len(blobs), dtype=np.int32)), pa.array(blobs, pa.binary())], ["chunk", "part", "blob"])

    def total(table: pa.Table) -> pa.Table:
        blobs = [thaw(b.as_py()) for b in table.column("blob")]
        words, place = np.unique(np.concatenate([b[0] for b in blobs]), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([b[1] for b in blobs]).astype(float), minlength=len(words)).astype(np.uint32)
        rank = np.empty(len(words), dtype=np.uint32)
        rank[np.argsort(-counts.astype(np.int64), kind="stable")] = np.arange(len(words))
        rank[counts == 0] = 0
        ends = np.cumsum([len(b[0]) for b in blobs])
        out = [freeze(counts[p], rank[p]) for p in np.split(place, ends[:-1])]
        known = counts[counts > 0]
        each, many = np.unique(known, return_counts=True)
        stats = [int(known.sum()), len(known), *(int((known == r).sum()) for r in range(1, TOP + 2)), *each[::-1].tolist(), *many[::-1].tolist()]
        n = len(out)
        part = table.column("part")[0].as_py()
        return pa.table(
            {
                "chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.int64()),
                "part": pa.array([part] * (n + 1), pa.int32()),
                "blob": pa.array([*out, None], pa.binary()),
                "stats": pa.array([None] * n + [stats], pa.list_(pa.int64())),
            }
        )

    sent = chunks.mapInArrow(send, "chunk long, part int, blob binary")
    return materialize(sent.repartition(1 << bits, "part").groupBy("part").applyInArrow(total, "chunk long, part int, blob binary, stats array<long>"), "words")


class Counts:
    """Training counts of words by number: ranks fall with the count, so each part needs only where a smaller one begins."""

    def __init__(self, parts: int, stats: dict[int, np.ndarray]):
        self.parts, key, count = parts, [[-1]], [[0]]
        for part in sorted(stats):
            each, many = np.split(stats[part], 2)
            key.append((part << 40) + np.cumsum(many) - many)
            count.append(each)
        self.key, self.count = np.concatenate(key), np.concatenate(count)

    def __call__(self, number: np.ndarray) -> np.ndarray:
        at = np.maximum(number - FIRST, 0)
        found = self.count[np.searchsorted(self.key, (at % self.parts << 40) + at // self.parts, side="right") - 1]
        return np.where(number >= FIRST, found, 0)


def _numbers(replies: pa.Table, hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Training count and number of each word of a chunk."""
    rows = sorted((p, b) for p, b, k in zip(*(replies.column(c).to_pylist() for c in ("part", "blob", "level")), strict=True) if k == 1)
    counts, numbers, order = np.empty(len(hashes), dtype=np.int64), np.empty(len(hashes), dtype=np.int64), np.argsort(hashes)
    blobs = [(p, *thaw(b)) for p, b in rows]
    counts[order] = np.concatenate([c for _, c, _ in blobs])
    numbers[order] = np.concatenate([FIRST + rank.astype(np.int64) * parts + p for p, _, rank in blobs])
    numbers[counts == 0] = UNKNOWN
    return counts, numbers


# --- n-grams ----------------------------------------------------------------------------------


def scatter(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of numbers."""
    x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Grams:
    """The distinct n-grams of a chunk, as word numbers: ``columns`` are the history from its last word to
    its first and then the n-gram's last word, in lexicographic order; ``place`` of every token's own."""

    def __init__(self, lengths: np.ndarray, tokens: np.ndarray, numbers: np.ndarray, order: int):
        distinct, local = np.unique(np.append(START, numbers), return_inverse=True)
        token, v, n = local[1:][tokens], len(distinct), len(tokens)
        at = np.arange(n) - np.repeat(np.cumsum(lengths, dtype=np.int64) - lengths, lengths)
        self.columns, self.place = [], np.zeros(n, dtype=np.int64)
        for back in [*range(1, order), 0]:
            word = np.zeros(n, dtype=np.int64)
            word[back:] = token[: max(0, n - back)]
            word[at < back] = 0  # the start
            key, self.place = np.unique(self.place * v + word, return_inverse=True)
            self.columns = [c[key // v] for c in self.columns] + [distinct[key % v]]

    def deal(self, hot_count: np.ndarray, hot: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order by bucket, edges of buckets, which are of hot histories), given the count of each history's last word."""
        spread = np.minimum(-(-hot_count // hot), buckets).astype(np.uint64)
        is_hot = hot_count > hot
        share = np.where(is_hot, (scatter(self.columns[-1]) >> np.uint64(33)) % np.maximum(spread, np.uint64(1)), np.uint64(0))
        bucket = ((scatter(self.columns[0]) + share) & np.uint64(buckets - 1)).astype(np.int64)
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(buckets + 1)), is_hot


def deal_grams(replies: DataFrame, folder: str, order: int, parts: int, starts: int, buckets: int, hot: int, chunks: int) -> DataFrame:
    """(bucket, chunk, blob): the distinct n-grams of a chunk by bucket of the history's last word."""

    def send(given: pa.Table) -> pa.Table:
        chunk = given.column("chunk")[0].as_py()
        *_, train, lengths, hashes, tokens = _open(folder, chunk)
        counts, numbers = _numbers(given, hashes, parts)
        grams = Grams(lengths, tokens, numbers, order)
        seen = np.bincount(grams.place, weights=np.repeat(train, lengths), minlength=len(grams.columns[0])).astype(np.uint32)
        places, edges, is_hot = grams.deal(_history_counts(grams, counts, numbers, starts), hot, buckets)
        rows = []
        for k in range(buckets):
            o = places[edges[k] : edges[k + 1]]
            if len(o):
                columns = [c[o] for c in grams.columns]
                turn = np.append(True, columns[0][1:] != columns[0][:-1])
                rows.append((k, freeze(seen[o], is_hot[o][turn].astype(np.uint8), *to_tree(columns))))
        return pa.table({"bucket": pa.array([k for k, _ in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int64()), "blob": pa.array([b for _, b in rows], pa.binary())})

    return replies.repartition(chunks, "chunk").groupBy("chunk").applyInArrow(send, "bucket int, chunk long, blob binary").repartition(2 * buckets, "bucket")


def _history_counts(grams: Grams, counts: np.ndarray, numbers: np.ndarray, starts: int) -> np.ndarray:
    """How often training has the last word of each n-gram's history."""
    distinct, first = np.unique(np.append(START, numbers), return_index=True)
    times = np.append(starts, counts)[first]
    times[distinct == UNKNOWN] = 0
    return times[np.searchsorted(distinct, grams.columns[0])]


class Level:
    """The n-grams of one length in a bucket: training ``count``, ``history`` and ``below``, the place of the n-gram
    without its first word one level lower; of each history its ``parent``, that without its first word, and ``name``, a hash."""

    def __init__(self, history: np.ndarray, count: np.ndarray, parent: np.ndarray, name: np.ndarray):
        self.history, self.count, self.parent, self.name, self.below = history, count, parent, name, None

    def add(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.history, weights=weights, minlength=len(self.parent))


def by_size(level: Level, count: np.ndarray) -> np.ndarray:
    """Sums by history of ``count`` over n-grams that training has: those of 1..TOP each, those above."""
    count = np.where(level.count > 0, count, 0)
    return np.stack([level.add(np.where(count == r, r, 0)) for r in range(1, TOP + 1)] + [level.add(np.where(count > TOP, count, 0))], axis=1)


class Bucket:
    """All n-grams of a bucket, counted over its chunks, at every level from 2 to the order."""

    def __init__(self, blobs: list[bytes]):
        seen, hot, columns = [], [], []
        for blob in blobs:
            s, flag, *tree = thaw(blob)
            column = from_tree(tree)
            turn = np.append(True, column[0][1:] != column[0][:-1])
            seen.append(s), hot.append(column[0][turn][flag == 1]), columns.append([c.astype(np.uint32) for c in column])
        self.sizes = [len(s) for s in seen]
        *before, word = [np.concatenate(c) for c in zip(*columns, strict=True)]
        del columns
        history, parents, names = np.zeros(len(word), dtype=np.int64), [], []
        for c in before:
            key, history = np.unique(history << 32 | c, return_inverse=True)
            number, parent = key & 0xFFFFFFFF, key >> 32
            names.append(scatter(number ^ names[-1][parent].view(np.int64)) if names else scatter(number))
            parents.append(parent)
            if len(parents) == 1:
                is_hot = [np.isin(number, np.concatenate(hot))]
            else:
                is_hot.append(is_hot[-1][parent])
        key, self.place = np.unique(history << 32 | word, return_inverse=True)
        count = np.bincount(self.place, weights=np.concatenate(seen), minlength=len(key)).astype(np.int64)
        self.hot, self.levels = [np.flatnonzero(h) for h in is_hot], []
        for parent, name in zip(parents[::-1], names[::-1], strict=True):
            history, self.word = key >> 32, key & 0xFFFFFFFF
            self.levels.insert(0, Level(history, count, parent, name))
            if len(self.levels) < len(parents):
                key, below = np.unique(parent[history] << 32 | self.word, return_inverse=True)
                self.levels[0].below = below
                count = np.bincount(below, weights=count, minlength=len(key)).astype(np.int64)
        self.levels[0].below = np.arange(len(key))

    def sums(self, unigram: np.ndarray) -> list[np.ndarray]:
        """Per level and history: counts by size, then what its words seen have one level lower, in counts by size or, of single words, in probability."""
        out, lower = [], None
        for level in self.levels:
            mine = by_size(level, level.count)
            if lower is None:
                under = np.zeros_like(mine)
                under[:, 0] = level.add(np.where(level.count > 0, unigram, 0.0))
            else:
                under = by_size(level, lower[level.below])
            out.append(np.concatenate([mine, under], axis=1))
            lower = level.count
        return out

    def probabilities(self, unigram: np.ndarray, sums: list[np.ndarray], d: list[np.ndarray]) -> np.ndarray:
        """Of the n-grams of the highest level."""
        value = unigram
        kept = lambda x, d: x[:, :TOP] @ d[1:] + x[:, TOP]
        share = before = None  # of the level below: what a kept count of a history is worth
        for level, own, d_own in zip(self.levels, sums, d, strict=True):
            mine, under = own[:, : TOP + 1], own[:, TOP + 1 :]
            seen = mine.sum(axis=1)
            mass = kept(mine, d_own) / np.maximum(seen, 1)
            scale = np.where(mass < 1 - 1e-9, 1.0, seen / (seen + 1))  # nothing freed: one more count is set aside
            lower = under[:, 0] if share is None else kept(under, before) * share[level.parent]
            weight = (1 - scale * mass) / (1 - lower)
            rate = d_own[np.minimum(level.count, TOP)] * (level.count <= TOP) + (level.count > TOP)
            share = scale / np.maximum(seen, 1)
            value = np.where(level.count > 0, (share[level.history] * rate) * level.count, weight[level.history] * value[level.below])
            before = d_own
        return value


def answer_grams(dealt: DataFrame, order: int, words: Words, counts: Counts, buckets: int) -> DataFrame:
    """(chunk, part, level, blob): the probabilities of the n-grams sent, to their chunk.

    Sums by hot histories go to the bucket of the history's hash, are added up there and return to all buckets
    that have a share of them; counts of counts go the same way, as one more bucket's.
    """

    def unigram(b: Bucket) -> np.ndarray:
        return words.probability(counts(b.word))

    def shares(b: Bucket) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(to, level, place) of the hot histories."""
        level = np.repeat(np.arange(len(b.hot)), [len(h) for h in b.hot])
        place = np.concatenate(b.hot)
        to = np.concatenate([x.name[h] for x, h in zip(b.levels, b.hot, strict=True)]) & np.uint64(buckets - 1)
        return [(int(k), level[to == k], place[to == k]) for k in np.unique(to)]

    def statistics(table: pa.Table) -> pa.Table:
        b = Bucket(table.column("blob").to_pylist())
        sums = b.sums(unigram(b))
        rows = [(-1, freeze(np.array([[(x.count == r).sum() for r in range(1, TOP + 2)] for x in b.levels], dtype=np.int64).ravel()))]
        for to, level, place in shares(b):
            name = np.concatenate([b.levels[k].name[place[level == k]] for k in range(len(b.levels))])
            own = np.concatenate([sums[k][place[level == k]] for k in range(len(b.levels))])
            rows.append((to, freeze(name, level.astype(np.uint8), *own.T)))
        n = len(rows)
        return pa.table({"to": pa.array([k for k, _ in rows], pa.int32()), "bucket": pa.array([table.column("bucket")[0].as_py()] * n, pa.int32()), "blob": pa.array([x for _, x in rows], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        to, blobs = table.column("to")[0].as_py(), [thaw(b) for b in table.column("blob").to_pylist()]
        if to < 0:
            out = [freeze(np.sum([b[0] for b in blobs], axis=0))] * len(blobs)
        else:
            key, level = np.concatenate([b[0] for b in blobs]), np.concatenate([b[1] for b in blobs])
            _, place = np.unique(key + level, return_inverse=True)
            sums = [np.bincount(place, weights=np.concatenate([b[2 + i] for b in blobs]))[place] for i in range(2 * TOP + 2)]
            ends = np.cumsum([len(b[0]) for b in blobs])[:-1]
            out = [freeze(*x) for x in zip(*(np.split(s, ends) for s in sums), strict=True)]
        return pa.table({"bucket": table.column("bucket").cast(pa.int32()), "to": pa.array([to] * len(out), pa.int32()), "sums": pa.array(out, pa.binary())})

    def score(table: pa.Table, given: pa.Table) -> pa.Table:
        total = dict(zip(given.column("to").to_pylist(), (thaw(x) for x in given.column("sums").to_pylist()), strict=True))
        d = [discounts(x) for x in total[-1][0].reshape(order - 1, TOP + 1)]
        blobs = table.column("blob").to_pylist()
        b = Bucket(blobs)
        mine = unigram(b)
        sums = b.sums(mine)
        for to, level, place in shares(b):
            for k in range(len(b.levels)):
                sums[k][place[level == k]] = np.stack(total[to], axis=1)[level == k]
        value = b.probabilities(mine, sums, d)[b.place]
        out = [freeze(x) for x in np.split(value, np.cumsum(b.sizes)[:-1])]
        n = len(out)
        return pa.table({"chunk": table.column("chunk").cast(pa.int64()), "part": table.column("bucket").cast(pa.int32()), "level": pa.array([order] * n, pa.int32()), "blob": pa.array(out, pa.binary())})

    own = dealt.groupBy("bucket").applyInArrow(statistics, "to int, bucket int, blob binary")
    added = own.groupBy("to").applyInArrow(add, "bucket int, to int, sums binary")
    return dealt.groupBy("bucket").cogroup(added.groupBy("bucket")).applyInArrow(score, REPLIES)


REPLIES = "chunk long, part int, level int, blob binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_corpus(docs: DataFrame, held_out: int = 10, order: int = ORDER, chunk_tokens: int = CHUNK_TOKENS, hot_least: int = 1_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, by n-grams of up to ``order`` >= 2 words."""
    if order < 2:
        raise ValueError("order must be at least 2")
    spark = docs.sparkSession
    folder = fresh_path(spark, "chunks")
    flag = (crc_mod("doc_id", held_out) != 0).cast("int").alias("train")
    encoded = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), flag, "text").mapInArrow(lambda batches: _encode(batches, folder, chunk_tokens), ENCODED), "encoded")
    size = encoded.agg(F.sum("tokens"), F.sum("trained"), F.count("*")).first()
    if not size[2]:
        return spark.createDataFrame([], SCORES)
    bits = max(3, int(np.ceil(np.log2(size[0] / BUCKET_TOKENS))))
    parts, buckets, chunks = 1 << max(3, bits - 2), 1 << bits, size[2]
    counted = count_words(encoded.select("chunk").repartition(chunks, "chunk"), folder, parts.bit_length() - 1)
    stats = {r["part"]: np.array(r["stats"], dtype=np.int64) for r in counted.where("chunk IS NULL").select("part", "stats").collect()}  # one row a part
    total = np.sum([x[: TOP + 3] for x in stats.values()], axis=0)
    words, starts = Words(int(total[0]), int(total[1]), total[2:]), int(size[1])
    of_words = counted.where("chunk IS NOT NULL").select("chunk", "part", F.lit(1).alias("level"), "blob")
    hot = max(hot_least, words.total // (4 * buckets))
    dealt = deal_grams(of_words, folder, order, parts, starts, buckets, hot, chunks)
    replies = answer_grams(dealt, order, words, Counts(parts, {p: x[TOP + 3 :] for p, x in stats.items()}), buckets)

    def gather(given: pa.Table) -> pa.Table:
        ids, null, train, lengths, hashes, tokens = _open(folder, given.column("chunk")[0].as_py())
        counts, numbers = _numbers(given, hashes, parts)
        grams = Grams(lengths, tokens, numbers, order)
        places, _, _ = grams.deal(_history_counts(grams, counts, numbers, starts), hot, buckets)
        value = np.empty(len(places))
        answers = sorted((p, b) for p, b, k in zip(*(given.column(c).to_pylist() for c in ("part", "blob", "level")), strict=True) if k > 1)
        value[places] = np.concatenate([thaw(b)[0] for _, b in answers])
        doc, n = np.repeat(np.arange(len(lengths)), lengths), len(lengths)
        add = lambda x: np.bincount(doc, weights=x, minlength=n)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64(), mask=null == 1), "held_out": pa.array(train == 0), "n_tokens": pa.array(lengths.astype(np.int64)), "n_known": pa.array(add((counts > 0)[tokens]).astype(np.int64)),
                "train_tokens": pa.array(np.full(n, words.total, dtype=np.int64)), "base_score": pa.array(add(words.base(counts)[tokens])), "score": pa.array(add(np.log10(value)[grams.place])),
            }
        )

    scored = materialize(of_words.union(replies).repartition(chunks, "chunk").groupBy("chunk").applyInArrow(gather, SCORES), "scored")
    discard(counted)
    delete_path(spark, folder)
    return scored


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))
