"""Byte-level BPE encoding and decoding: whole pre-tokens by a minimal perfect hash, the rest by merging.

Tier one: a minimal perfect hash (hash and displace: every bucket of keys has a seed under which its keys fall
into free slots) maps each vocabulary entry to one slot of a table exactly as long as the vocabulary.  A
pre-token is hashed, and the slot's bytes compared; equal bytes mean that the pre-token is one token.
Tier two: the bytes of a missing pre-token form a linked list; a heap holds the ranks of mergeable neighbours,
the lowest rank (leftmost first) is merged until none is left.

The table is built once on the driver and broadcast; its size is that of the vocabulary file (50,256 entries),
which doesn't grow with the data.  No shuffle: texts are mapped where they are read.
"""

from __future__ import annotations

import heapq
from hashlib import sha256
from operator import itemgetter

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_row, table
from .pieces import chunks, pieces, read_ranks, vocabulary

MASK = (1 << 64) - 1


class PerfectHash:
    """A minimal perfect hash of byte strings; find(key) gives its value, or None for any other string."""

    def __init__(self, entries: dict[bytes, int], per_bucket: int = 3):
        keys = list(entries)
        self.n, self.buckets = len(keys), max(1, len(keys) // per_bucket)
        self.seeds = np.zeros(self.buckets, np.uint32)
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            groups[h % self.buckets].append(i)
        taken, slots = bytearray(self.n), [0] * self.n
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        free = None
        for b in order:
            members = groups[b]
            if not members:
                break
            if len(members) == 1:  # any free slot will do: its number is kept in place of a seed
                free = free or iter([s for s in range(self.n) if not taken[s]])
                spot = [next(s for s in free if not taken[s])]
                self.seeds[b] = (1 << 31) | spot[0]
            else:
                seed = 1
                while True:
                    spot = [self._slot(hashes[i], seed) for i in members]
                    if len(set(spot)) == len(spot) and not any(taken[s] for s in spot):
                        break
                    seed += 1
                self.seeds[b] = seed
            for i, s in zip(members, spot):
                taken[s], slots[s] = 1, i
        self.keys = [keys[i] for i in slots]
        self.values = [entries[k] for k in self.keys]
        self.seeds = self.seeds.tolist()

    def _slot(self, h: int, seed: int) -> int:
        h = ((h ^ (seed * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9) & MASK
        return ((h ^ (h >> 29)) >> 7) % self.n

    def find(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        seed = self.seeds[h % self.buckets]
        slot = seed & 0x7FFFFFFF if seed >> 31 else self._slot(h, seed)
        return self.values[slot] if self.keys[slot] == key else None


def merge(piece: bytes, rank) -> list[int]:
    """Token ids of one pre-token: the lowest-ranked neighbours merge first, the leftmost of equals.

    rank(bytes) gives a rank or None.  A piece of n bytes takes O(n log n) steps.
    """
    n = len(piece)
    bits = n.bit_length()
    low = (1 << bits) - 1
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    # an entry is rank, first byte, end of the pair, as one number
    heap = [((r << bits | i) << bits) | i + 2 for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        entry = heapq.heappop(heap)
        i, stop = entry >> bits & low, entry & low
        j = after[i]
        if j < 0 or j >= n or end[j] != stop:  # out of date
            continue
        end[i] = stop
        after[i] = following = after[j]
        after[j] = -1
        if following < n:
            before[following] = i
            if (r := rank(piece[i : end[following]])) is not None:
                heapq.heappush(heap, ((r << bits | i) << bits) | end[following])
        if (k := before[i]) >= 0 and (r := rank(piece[k:stop])) is not None:
            heapq.heappush(heap, ((r << bits | k) << bits) | stop)
    ids, i = [], 0
    while i < n:
        ids.append(rank(piece[i : end[i]]))
        i = after[i]
    return ids


class Encoder:
    """Encodes and decodes texts; keeps what it has found for the last `remember` pre-tokens, twice as many at most."""

    def __init__(self, ranks: dict[bytes, int], remember: int = 200_000):
        self.words, self.remember = PerfectHash(ranks), remember
        self.spelled = {r: t for t, r in ranks.items()}
        self.ready()

    def ready(self) -> None:
        # the merges look up short strings over and over: a plain dict there, over the same entries
        self.ranks = dict(zip(self.words.keys, self.words.values))
        self.seen: dict[str, tuple[str, int, bytes]] = {}
        self.older: dict[str, tuple[str, int, bytes]] = {}

    def __getstate__(self):
        return self.words, self.remember, self.spelled

    def __setstate__(self, state):
        self.words, self.remember, self.spelled = state
        self.ready()

    def ids(self, piece: bytes) -> list[int]:
        whole = self.words.find(piece)
        return [whole] if whole is not None else merge(piece, self.ranks.get)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids))

    def look(self, piece: str) -> tuple[str, int, bytes]:
        found = self.older.get(piece)
        if found is None:
            ids = self.ids(piece.encode())
            found = " ".join(map(str, ids)), len(ids), self.decode(ids)
        if len(piece) <= 64:
            if len(self.seen) >= self.remember:
                self.seen, self.older = {}, self.seen
            self.seen[piece] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Token ids, 32 bits each."""
        parts = []
        for part in chunks(text):
            seen, look = self.seen, self.look
            parts.append(np.array(" ".join([(seen[p] if p in seen else look(p))[0] for p in pieces(part)]).split(), np.int32))
        return np.concatenate(parts)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Count of tokens, digest of the ids, digest of what they decode to."""
        n, of_ids, of_bytes, look = 0, sha256(), sha256(), self.look
        for part in chunks(text or ""):
            seen = self.seen
            found = [seen[p] if p in seen else look(p) for p in pieces(part)]
            if found:
                of_ids.update(((" " if n else "") + " ".join(map(itemgetter(0), found))).encode())
                n += sum(map(itemgetter(1), found))
                of_bytes.update(b"".join(map(itemgetter(2), found)))
        return n, of_ids.hexdigest(), of_bytes.hexdigest()


def shared_encoder(spark: SparkSession, path: str):
    """The encoder as a broadcast; as large as the vocabulary file."""
    return spark.sparkContext.broadcast(Encoder(read_ranks(path)))


def encode(docs: DataFrame, path: str, text: str = "text", output: str = "token_ids") -> DataFrame:
    """docs with a column of token ids (array<int>) added; a null text has no tokens.

    A column of the output's name is replaced; every other column stays.
    """
    encoder = shared_encoder(docs.sparkSession, path)

    @F.pandas_udf("array<int>")
    def ids(texts):
        return texts.map(lambda t: encoder.value.encode(t or ""))

    return docs.withColumn(output, ids(F.col(text)))


def decode(ids: Column, spark: SparkSession, path: str) -> Column:
    """The bytes that an array of token ids spells; null: no bytes.  An id outside the vocabulary is an error."""
    encoder = shared_encoder(spark, path)

    @F.pandas_udf("binary")
    def spelled(rows):
        return rows.map(lambda r: encoder.value.decode([] if r is None else r))

    return spelled(ids)


def digests(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each document: its id, n_tokens, ids_sha256, decoded_sha256; with with_ids also token_ids
    (binary: 32-bit little-endian numbers, so that a corpus of ids is written as fast as it is made).

    Null and empty texts have no tokens (digests of nothing); repeated rows and null ids give a row each; other
    columns are not read.  Very long texts are encoded in parts, so that few pre-tokens are held at a time.
    """
    encoder = shared_encoder(docs.sparkSession, path)

    def make():
        own = encoder.value
        if with_ids:
            return lambda doc_id, text: (doc_id, *own.digest(text), own.encode(text or "").astype("<i4").tobytes())
        return lambda doc_id, text: (doc_id, *own.digest(text))

    return per_row(
        docs.select(F.col(id_column).cast("long"), F.col(text)), make,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids binary" if with_ids else ""),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))
