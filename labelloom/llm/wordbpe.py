"""BPE encoding and decoding with a tokenization automaton.

Merges are compiled one by one: the gadget of a merge (a, b) adds the state of token ab,
entered by its arc, and forbids the path a, b that the arc replaces. States are the last
token taken; an arc (state, token) exists when no merge would have taken symbols across
the two tokens first.

That automaton reads tokens. Determinised over bytes, a state is the set of (last token,
part of the next one read so far), and a transition keeps, per member, where it came from
and the token it closed. The table is filled where texts need it, within a bound. A word
is read by table steps alone; of the paths that its last byte ends, one is accepted, and
its arc labels, read backwards, are the word's tokens.

Words are what white space separates; a word's result depends on nothing around it, so
each task keeps a bounded table of words already encoded.
"""

from __future__ import annotations

import gc
import hashlib
import json
import string
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from labelloom.llm.common import id_and_text, slices

MAX_WORDS = 400_000
MAX_ARCS = 500_000
MAX_STEPS = 300_000
START = ((-1, 0),)
# White space as the tokenizer's own pattern language has it; str.split() also takes \x1c-\x1f.
_WHITE = regex.compile("[\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+")
_ODD = regex.compile("[\\x1c-\\x1f]")


def byte_symbols() -> list[str]:
    """A printable character for each byte: printable ones stand for themselves, the rest follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


class MergeAutomaton:
    """Deterministic automaton of a vocabulary with ordered merges and a word-end suffix."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.symbols = byte_symbols()
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.labels = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels.update({i: t for t, i in self.special.items()})
        self.cut = regex.compile("|".join(regex.escape(t) for t in self.special)) if self.special else None
        # ASCII letters alone are one piece, and no control string is made of them only
        self.letters_stay = self.pattern.findall(string.ascii_lowercase) == [string.ascii_lowercase] and not any(
            t.isalpha() for t in self.special
        )
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self._add_gadget(rank, a, b)
        self.arcs: dict[int, bool] = {}
        self._grow_trie()
        self._start_table()
        self.pieces: dict[str, list[int]] = {}

    def _add_gadget(self, rank: int, a: str, b: str) -> None:
        """State of the merged token: its arc replaces the path a, b from this rank on."""
        pair = (self.vocab[a], self.vocab[b])
        self.rank.setdefault(pair, rank)
        self.parts.setdefault(self.vocab[a + b], pair)

    def _grow_trie(self) -> None:
        """Nodes of all tokens that merges make, and of single symbols, by their bytes.

        ``inner`` and ``final`` name the token that ends at a node inside and at the end of a word.
        """
        byte_of = {c: b for b, c in enumerate(self.symbols)}
        self.child: dict[int, int] = {}
        self.inner: dict[int, int] = {}
        self.final: dict[int, int] = {}
        self.leads: set[int] = {0}
        child, leads, nodes = self.child, self.leads, 1
        for t, i in self.vocab.items():
            last = bool(self.end) and t.endswith(self.end)
            text = t.removesuffix(self.end) if last else t
            if not text or i not in self.parts and len(text) > 1:
                continue
            node = 0
            for c in text:
                leads.add(node)
                node = child.setdefault(node << 8 | byte_of[c], nodes)
                nodes += node == nodes
            if last or not self.end:
                self.final[node] = i
            if not last:
                self.inner[node] = i

    def _start_table(self, first: tuple[tuple[int, int], ...] = START) -> int:
        """Only the start state (no token yet, nothing read) and the given one, whose number is returned."""
        self.states: list[tuple[tuple[int, int], ...]] = list(dict.fromkeys((START, first)))
        self.numbers = {s: i for i, s in enumerate(self.states)}
        self.steps: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}
        self.stops: dict[int, tuple[int, int]] = {}
        return self.numbers[first]

    def arc(self, state: int, token: int) -> bool:
        """Whether the token may follow the state (-1: the word's start); looked up, or found by its gadgets."""
        if state < 0:
            return True
        key = state << 32 | token
        free = self.arcs.get(key)
        if free is None:
            free = self._determinise(state, token)
            if len(self.arcs) >= MAX_ARCS:
                self.arcs.clear()
            self.arcs[key] = free
        return free

    def step(self, state: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        """Fill the table at (state, byte): next state and, per member of it, (member before, token closed or -1)."""
        members, came, closed = [], [], None
        for i, (token, node) in enumerate(self.states[state]):
            after = self.child.get(node << 8 | byte)
            if after is None:
                continue
            if after in self.leads:
                members.append((token, after))
                came.append((i, -1))
            done = self.inner.get(after)
            if closed is None and done is not None and self.arc(token, done):
                closed = i, done
        if closed:
            members.append((closed[1], 0))
            came.append(closed)
        key = tuple(members)
        number = self.numbers.setdefault(key, len(self.states))
        if number == len(self.states):
            self.states.append(key)
        out = self.steps[state << 8 | byte] = number, tuple(came)
        return out

    def stop(self, state: int, byte: int) -> tuple[int, int]:
        """Fill the table at (state, last byte): the accepted member and the token that ends the word."""
        for i, (token, node) in enumerate(self.states[state]):
            last = self.final.get(self.child.get(node << 8 | byte, -1))
            if last is not None and self.arc(token, last):
                out = self.stops[state << 8 | byte] = i, last
                return out
        raise ValueError("the vocabulary has no tokens for this word")

    def _determinise(self, left: int, right: int) -> bool:
        """Undo the two tokens' gadgets from the latest merge down; a merge across the border closes the arc.

        A border pair closes it when its merge comes before the gadget that hides it, and at
        equal rank when the hidden gadget lies to the right, as merges run from the left.
        """
        limit = len(self.rank) + 1
        while True:
            rank = self.rank.get((left, right))
            if rank is not None and rank < limit:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            ra = self.rank[a] if a else -1
            rb = self.rank[b] if b else -1
            if ra > rb:
                limit, left = ra, self.parts[left][1]
            else:
                limit, right = rb + 1, self.parts[right][0]

    def path(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word: forward by table steps, back along the accepted path."""
        get, state, trail = self.steps.get, 0, []
        for byte in word[:-1]:
            step = get(state << 8 | byte)
            if step is None:
                if len(self.steps) >= MAX_STEPS:  # also within a word: what is behind it lies in the trail
                    state = self._start_table(self.states[state])
                    get = self.steps.get
                step = self.step(state, byte)
            state, came = step
            trail.append(came)
        if len(self.stops) >= MAX_STEPS:
            self.stops.clear()
        member, token = self.stops.get(state << 8 | word[-1]) or self.stop(state, word[-1])
        ids = [token]
        for came in reversed(trail):
            member, token = came[member]
            if token >= 0:
                ids.append(token)
        ids.reverse()
        return ids

    def word(self, text: str) -> list[int]:
        """Ids of a text without white space."""
        if self.letters_stay and text.isascii() and text.isalpha():
            return self._piece_ids(text.lower())
        ids: list[int] = []
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            ids += self._plain_ids(text[at : m.start()])
            ids.append(self.special[m.group()])
            at = m.end()
        return ids + self._plain_ids(text[at:])

    def _plain_ids(self, text: str) -> list[int]:
        clean = text if text.isascii() else unicodedata.normalize("NFC", text)
        # str.lower() looks around a capital sigma; the tokenizer lowers each character alone
        clean = "".join(c.lower() for c in clean) if "\u03a3" in clean else clean.lower()
        ids: list[int] = []
        for piece in self.pattern.findall(clean):
            ids += self._piece_ids(piece)
        return ids

    def _piece_ids(self, piece: str) -> list[int]:
        known = self.pieces.get(piece)
        if known is None:
            if len(self.pieces) >= MAX_WORDS:
                self.pieces.clear()
            known = self.pieces[piece] = self.path(piece.encode())
        return known

    def decode(self, ids: list[int]) -> str:
        """Arc labels of the path, joined as the vocabulary's tokenizer joins them."""
        return " ".join(self.labels[i] for i in ids)


def split_words(text: str) -> list[str]:
    return [w for w in _WHITE.split(text) if w] if _ODD.search(text) else text.split()


@lru_cache(maxsize=1)
def load(path: str) -> MergeAutomaton:
    """The automaton of a tokenizer file, kept by the worker process with its bounded tables."""
    with open(path, encoding="utf-8") as f:
        return MergeAutomaton(json.load(f))


@contextmanager
def _tables_grow() -> Iterator[None]:
    """No searches for cycles meanwhile: tables of words have none, and each search would walk them all."""
    was_on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was_on:
            gc.enable()


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) and decoded text of every document.

    ``vocabulary`` is the place of a tokenizer file that every worker can read. Null and
    empty texts have no ids and decode to an empty text. Repeated rows are encoded each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _tables_grow():
            m, known = load(vocabulary), {}
            for b in slices(batches, limit=2 << 20):
                all_ids, texts = [], []
                for text in b.column("text").to_pylist():
                    words = _looked_up(m, known, text)
                    ids = [i for w in words for i in w[1]]
                    all_ids.append(ids)
                    texts.append(m.decode(ids))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": b.column("doc_id"), "ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": texts}
                )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def _looked_up(m: MergeAutomaton, known: dict, text: str) -> list[tuple[int, tuple, str, str]]:
    """(count, ids, ids as text, decoded text) of each word of the text."""
    words = split_words(text)
    try:
        return [known[w] for w in words]
    except KeyError:
        pass
    if len(known) > MAX_WORDS:
        known.clear()
    for w in set(words).difference(known):
        ids = tuple(m.word(w))
        known[w] = (len(ids), ids, " ".join(map(str, ids)), m.decode(ids))
    return [known[w] for w in words]


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, by the same tables; ids and texts stay in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        with _tables_grow():
            m, known = load(vocabulary), {}
            for b in slices(batches):
                out = []
                for text in b.column("text").to_pylist():
                    words = [w for w in _looked_up(m, known, text) if w[0]]
                    ids, shown = " ".join([w[2] for w in words]), " ".join([w[3] for w in words])
                    out.append((sum(w[0] for w in words), sha(ids), sha(shown)))
                n, ids, decoded = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64()),
                     "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
                )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)
