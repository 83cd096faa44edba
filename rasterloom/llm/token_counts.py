"""Token counts by a compiled finite-state transducer.

Byte-pair encoding within a pre-token is read left to right by a deterministic transducer.  It rests on two
facts about such vocabularies: the encodings of all prefixes of a pre-token are found from one another (the last
token of a prefix is the one vocabulary entry that ends there and can follow the last token of what is before
it), and whether a token can follow another is decided by the two alone.  A state holds the places where a
vocabulary entry may still be under way: its node in the trie of entries, the token before it, and how many
tokens fewer there were.  A transition on a byte is annotated with the number of tokens it emits (0 or less where
a longer entry takes over shorter ones).  States are compiled when first met, numbered, and forgotten together
when there are too many.

A text is read in chunks.  A chunk's state map sends whatever was open before the chunk (a fragment of a
pre-token) to a count and a new open fragment; beyond the first place where a pre-token surely begins, it
doesn't depend on what was open.  The maps compose associatively, and a scan by doubling composes them.

No shuffle: texts are mapped where they are read.  The vocabulary is broadcast; it doesn't grow with the data.
"""

from __future__ import annotations

import json

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_row, table
from .pieces import pieces, vocabulary

_SAFE = regex.compile(r"(?<=\S) (?=\S)")


def read_vocabulary(path: str) -> tuple[dict[bytes, int], dict[tuple[bytes, bytes], int], list[str]]:
    """Entries, ranked merges and special strings of a byte-level tokenizer's JSON file."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes written as their own character
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    spell = lambda s: bytes(byte[c] for c in s)
    special = [t["content"] for t in whole["added_tokens"]]
    entries = {spell(s): i for s, i in whole["model"]["vocab"].items() if s not in special}
    pairs = (m if isinstance(m, list) else m.split(" ") for m in whole["model"]["merges"])
    return entries, {(spell(a), spell(b)): r for r, (a, b) in enumerate(pairs)}, special


class Transducer:
    """Counts tokens.  `most` bounds the compiled transitions, and the pre-tokens remembered."""

    def __init__(self, path: str, most: int = 400_000):
        self.entries, self.merges, self.special = read_vocabulary(path)
        self.most = most
        self.ready()

    def __getstate__(self):
        return self.entries, self.merges, self.special, self.most

    def __setstate__(self, state):
        self.entries, self.merges, self.special, self.most = state
        self.ready()

    def ready(self) -> None:
        self.spelled = {i: t for t, i in self.entries.items()}
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int | None] = [None]
        for token, i in self.entries.items():
            node = 0
            for b in token:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                node = self.children[node][b]
            self.ends[node] = i
        self.follows: dict[tuple[int, int], bool] = {}
        self.counts: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.forget()

    def forget(self) -> None:
        self.moves: dict[int, tuple[int, int]] = {}
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.start = self.state(((0, -1, 0),))

    def state(self, places: tuple) -> int:
        if (n := self.number.get(places)) is None:
            n = self.number[places] = len(self.states)
            self.states.append(places)
        return n

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the two tokens, written together, are encoded as these two again."""
        if (known := self.follows.get((left, right))) is None:
            parts = [bytes([b]) for b in self.spelled[left] + self.spelled[right]]
            while True:
                ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.merges.get((parts[i], parts[i + 1]))) is not None]
                if not ranked:
                    break
                _, i = min(ranked)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            known = parts == [self.spelled[left], self.spelled[right]]
            if len(self.follows) >= self.most:
                self.follows.clear()
            self.follows[left, right] = known
        return known

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """Compile one transition: the next state, and the tokens emitted."""
        under_way, found = [], None
        for node, before, fewer in self.states[state]:
            if (child := self.children[node].get(byte)) is None:
                continue
            token = self.ends[child]
            if found is None and token is not None and (before < 0 or self.stay_apart(before, token)):
                found = token, 1 - fewer
            if self.children[child]:
                under_way.append((child, before, fewer))
        if found is None:
            raise ValueError(f"no token ends at byte {byte}: the vocabulary lacks single bytes")
        token, emitted = found
        places = tuple((node, before, fewer + emitted) for node, before, fewer in under_way) + ((0, token, 0),)
        return self.state(places), emitted

    def count_piece(self, piece: str) -> int:
        state, n, moves = self.start, 0, self.moves
        for b in piece.encode():
            step = moves.get(state << 8 | b)
            if step is None:
                step = moves[state << 8 | b] = self.move(state, b)
            state, emitted = step
            n += emitted
        if len(moves) > self.most:
            self.forget()
        return n

    def look(self, piece: str) -> int:
        if (n := self.older.get(piece)) is None:
            n = self.count_piece(piece)
        if len(piece) <= 64:
            if len(self.counts) >= self.most:
                self.counts, self.older = {}, self.counts
            self.counts[piece] = n
        return n

    def count_plain(self, text: str) -> int:
        seen, look = self.counts, self.look
        return sum([seen[p] if p in seen else look(p) for p in pieces(text)])

    def chunk_map(self, chunk: str) -> tuple[str, int, str] | str:
        """A chunk's state map: what belongs to the open fragment, tokens in between, the new open fragment.

        A chunk in which no pre-token surely begins only lengthens the fragment: itself.
        """
        if not (first := _SAFE.search(chunk)):
            return chunk
        at, back = first.start(), 1 << 12
        while not (last := [m.start() for m in _SAFE.finditer(chunk, max(at, len(chunk) - back))]):
            back *= 8
        return chunk[:at], self.count_plain(chunk[at : last[-1]]), chunk[last[-1] :]

    def compose(self, a, b):
        if isinstance(a, str):
            return a + b if isinstance(b, str) else (a + b[0], b[1], b[2])
        if isinstance(b, str):
            return a[0], a[1], a[2] + b
        return a[0], a[1] + self.count_plain(a[2] + b[0]) + b[1], b[2]

    def count(self, text: str | None, size: int = 1 << 18) -> int:
        """Tokens of a text; a special string counts as one token, and cuts the text."""
        n, parts = 0, [text or ""]
        if self.split and text:
            parts = self.split.split(text)
            n = len(parts) - 1
        for part in parts:
            if len(part) <= size:
                n += self.count_plain(part)
                continue
            maps = [self.chunk_map(part[i : i + size]) for i in range(0, len(part), size)]
            while len(maps) > 1:  # neighbours compose, then neighbours of those
                maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
            whole = maps[0] if not isinstance(maps[0], str) else (maps[0], 0, "")
            n += self.count_plain(whole[0]) + whole[1] + self.count_plain(whole[2])
        return n


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: its id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens; repeated rows and null ids give a row each; other columns
    are not read.
    """
    transducer = docs.sparkSession.sparkContext.broadcast(Transducer(path))

    def make():
        count = transducer.value.count

        def row(doc_id, text):
            n = count(text)
            return doc_id, len((text or "").encode()), n, n > limit

        return row

    return per_row(
        docs.select(F.col(id_column).cast("long"), F.col(text)), make,
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
