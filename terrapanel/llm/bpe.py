"""Byte-pair encoding through a tokenization automaton, and decoding.

The merges are compiled into a deterministic automaton over tokens that accepts exactly the token sequences that merging
in order of rank would produce. It starts as one state with an arc for every byte symbol; each merge (u, v) adds one gadget:
the state that u enters is copied without the arc v, u is led into the copy, and the new token gets an arc wherever u has
one, entering where v enters. States only ever lose one arc against their original, so they are kept as shared segments: a
token's segment lists the arcs cut since, and its state continues with the segment of its right part as it was when
the token was made. Arcs asked for are kept in a transition table.

A pre-split word is encoded from left to right: every prefix has exactly one accepted path, so each position needs only the
token that enters it. Decoding emits the arc labels.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

END = "</w>"
#: The pre-splitting pattern of the published word-level vocabulary (a fixed value), and the same for ASCII text.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z]+|[0-9]|[^ \t-\ra-zA-Z0-9]+")
#: Outside the scripts whose characters have long been the same in every Unicode version.
RARE = re.compile("[^\0-\u052f\u2010-\u2027]")
#: Encoded words that a task keeps; when full, the table starts anew.
KEPT_WORDS = 150_000
#: Arcs kept likewise.
KEPT_ARCS = 250_000
#: Rows to an output batch.
ROWS = 256

OUTPUT = "doc_id long, ids binary, decoded string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class Automaton:
    """The compiled merges, over token ids. Labels are strings of byte symbols, word-final ones ending in ``</w>``."""

    def __init__(self, merges: list[tuple[str, str]], vocab: dict[str, int]):
        self.labels = {i: label for label, i in vocab.items()}
        size = max(self.labels, default=0) + 1
        #: By token: when it was made (-1: a symbol), its parts, and the arcs cut from its segment with their time.
        self.made = [-1] * size
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.cuts: list[dict[int, int] | None] = [None] * size
        self.shift = size.bit_length()
        self.end = len(merges)
        #: Spelling tree of the labels: by symbol the next node, at 0 a token that ends here, at 1 a word-final one.
        self.tree: dict = {}
        for symbol in byte_symbols():
            self._spell(symbol, vocab[symbol])
            self._spell(symbol + END, vocab[symbol + END])
        for time, (u, v) in enumerate(merges):
            self._gadget(time, vocab[u], vocab[v], vocab[u + v])
            self._spell(u + v, vocab[u + v])
        self.arcs: dict[int, bool] = {}

    def _gadget(self, time: int, u: int, v: int, made: int) -> None:
        if self.cuts[u] is None:
            self.cuts[u] = {}
        self.cuts[u][v] = time
        self.made[made] = time
        self.parts[made] = (u, v)

    def _spell(self, label: str, token: int) -> None:
        node = self.tree
        for symbol in label.removesuffix(END):
            node = node.setdefault(symbol, {})
        node[1 if label.endswith(END) else 0] = token

    def arc(self, a: int, b: int) -> bool:
        """Whether the state that ``a`` enters has an arc ``b``: no segment of the state, as old as it is seen from ``a``,
        may have cut ``b`` or a left part that stood for it at the time."""
        before = self.end
        while True:
            cuts = self.cuts[a]
            if cuts:
                label, until = b, self.end
                while True:
                    time = cuts.get(label)
                    if time is not None and time < before and time <= until:
                        return False
                    if self.parts[label] is None:
                        break
                    until = self.made[label]
                    label = self.parts[label][0]
            if self.parts[a] is None:
                return True
            before = self.made[a]
            a = self.parts[a][1]

    def path(self, word: str) -> list[int]:
        """The accepted tokens that spell ``word`` (byte symbols); the last one is word-final."""
        n, arcs, shift, tree = len(word), self.arcs, self.shift, self.tree
        if len(arcs) >= KEPT_ARCS:
            arcs.clear()
        enters = [-1] * (n + 1)
        starts = [0] * (n + 1)
        for i in range(n):
            node, a = tree, enters[i]
            for j in range(i, n):
                node = node.get(word[j])
                if node is None:
                    break
                if enters[j + 1] < 0:
                    b = node.get(1 if j == n - 1 else 0)
                    if b is not None:
                        if i:
                            key = a << shift | b
                            open_ = arcs.get(key)
                            if open_ is None:
                                open_ = arcs[key] = self.arc(a, b)
                            if not open_:
                                continue
                        enters[j + 1], starts[j + 1] = b, i
        out, j = [], n
        while j:
            out.append(enters[j])
            j = starts[j]
        return out[::-1]


class Encoder:
    """Texts to ids and back, by a published vocabulary of the word-end kind (its JSON text)."""

    def __init__(self, published: str):
        spec = json.loads(published)
        model = spec["model"]
        self.automaton = Automaton([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["vocab"])
        self.published, self.library = published, None
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splits = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.symbols = byte_symbols()
        #: Encoded words, and encoded spellings in byte symbols.
        self.words: dict[str, tuple[bytes, str]] = {}
        self.spellings: dict[str, tuple[bytes, str]] = {}

    def word(self, word: str) -> tuple[bytes, str]:
        symbols = self.symbols
        return self.spelled(self.words, word, word if word.isascii() and word.isprintable() else "".join([symbols[b] for b in word.encode()]))

    def spelled(self, kept: dict, word: str, spelling: str) -> tuple[bytes, str]:
        tokens = self.automaton.path(spelling)
        if len(kept) >= KEPT_WORDS:
            kept.clear()
        labels = self.automaton.labels
        known = kept[word] = (b"".join([t.to_bytes(4, "little") for t in tokens]), " ".join([labels[t] for t in tokens]))
        return known

    def rare(self, part: str) -> Iterator[tuple[bytes, str]]:
        """Scripts whose character classes differ between Unicode versions: the published file's own pre-splitting."""
        if self.library is None:
            self.library = Tokenizer.from_str(self.published)
        normal = self.library.normalizer.normalize_str(part)
        for spelling, _ in self.library.pre_tokenizer.pre_tokenize_str(normal):
            yield self.spellings.get(spelling) or self.spelled(self.spellings, spelling, spelling)

    def pieces(self, text: str) -> Iterator[tuple[bytes, str]]:
        for part in self.splits.split(text) if self.splits else [text]:
            if part in self.special:
                yield np.array([self.special[part]], "<u4").tobytes(), part
                continue
            if part.isascii():
                found = ASCII_WORDS.findall(part.lower())
            elif RARE.search(part):
                yield from self.rare(part)
                continue
            else:
                # Lower case is taken character by character, so a capital sigma has one form everywhere.
                found = WORDS.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
            known = self.words
            for w in found:
                yield known.get(w) or self.word(w)

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text: labels joined by single spaces."""
        pieces = list(self.pieces(text)) if text else []
        return b"".join([p[0] for p in pieces]), " ".join([p[1] for p in pieces])


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded, n_tokens) for every row of ``docs`` over its whole text.

    ``tokenizer`` is the path of the vocabulary file; the driver reads it and ships its content, which the size of a
    vocabulary bounds. A null or empty text has no ids and decodes to an empty text. Equal rows and null keys are
    encoded like any other; other columns are not read.
    """
    with open(tokenizer, encoding="utf-8") as f:
        published = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Compiled for each task, so that an idle worker holds none of it.
        enc = Encoder(published.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                done = [enc.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["doc_id", "ids", "decoded"])

    out = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, OUTPUT)
    return out.select(F.col("doc_id").alias(key), "ids", "decoded", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"))
