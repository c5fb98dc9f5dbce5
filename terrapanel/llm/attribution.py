"""Token counts of the sections of documents, from one encoding of each whole document.

A document is encoded once; the byte lengths of its tokens give their character spans, which are joined by interval to the
sections (its lines, each with the line break that ends it, or fields of a rendered record). A token inside a section counts there; one
that crosses a boundary is allocated by a rule: ``start`` (the section of its first character), ``most`` (the section with most of
its bytes, the first of equals), or ``split`` (to each section its share of bytes). A section's counts therefore add up to the
document's tokens, and differ from those of encoding it alone by what its boundaries merge.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("start", "most", "split")
ROWS = 256
OUTPUT = "key long, section int, field string, start int, end int, tokens double, crossing int"

_ENCODERS: dict[str, tuple[tiktoken.Encoding, np.ndarray]] = {}


def encoder(ranks_text: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """A published byte-level vocabulary (its rank file's text) and the byte length of each token."""
    name = f"{hash(ranks_text)}|{pattern}"
    if name not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, ranks_text.splitlines())}
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        lengths[list(ranks.values())] = [len(k) for k in ranks]
        _ENCODERS[name] = tiktoken.Encoding("published", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _ENCODERS[name]


def allocate(tokens: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of its tokens cross one of its boundaries.

    ``tokens`` and ``sections`` are the ascending byte offsets at which each ends; both cover the text from 0 to the same end.
    """
    starts = np.concatenate([[0], tokens[:-1]]) if len(tokens) else tokens
    first = np.searchsorted(sections, starts, side="right")
    last = np.searchsorted(sections, tokens, side="left")
    counts = np.bincount(first[first == last], minlength=len(sections)).astype(float)
    crossing = np.zeros(len(sections), dtype=np.int64)
    begins = np.concatenate([[0], sections[:-1]])
    for t in np.flatnonzero(first != last):
        touched = np.arange(first[t], last[t] + 1)
        shares = np.minimum(tokens[t], sections[touched]) - np.maximum(starts[t], begins[touched])
        crossing[touched] += shares > 0
        if rule == "split":
            counts[touched] += shares / (tokens[t] - starts[t])
        else:
            counts[first[t] if rule == "start" else touched[shares.argmax()]] += 1
    return counts, crossing


def line_ends(text: str) -> list[int]:
    """Character offsets at which the lines of a text end, line break included; an empty text has no line."""
    ends, at = [], text.find("\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    return ends if ends and ends[-1] == len(text) or not text else [*ends, len(text)]


def attribute(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", fields: tuple[str, ...] = ("source", "lang"), text: str = "text", rule: str = "most") -> DataFrame:
    """One row for each section of each row of ``docs``: (key, section, field, start, end, tokens, crossing).

    The document is rendered as a line ``name: value`` for each of the ``fields`` that is not null, then the text; every such line is one
    section, and so is every line of the text. Offsets are characters (code points) of the rendered document, ends exclusive. A row
    whose fields and text are all null or empty has no section. Repeated rows and null keys give their own sections; other columns
    are not read. ``ranks`` is the path of a rank file, read on the driver and shipped (a vocabulary bounds its size).
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    with open(ranks, encoding="ascii") as f:
        published = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = encoder(published.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                out: list[list] = [[] for _ in range(7)]
                part = batch.slice(at, ROWS)
                for name, body, *values in zip(*(part.column(i).to_pylist() for i in range(2 + len(fields)))):
                    lines = [(f, f"{f}: {v}\n") for f, v in zip(fields, values) if v is not None]
                    whole = "".join(x for _, x in lines) + (body or "")
                    if not whole:
                        continue
                    offset = sum(len(x) for _, x in lines)
                    ends = np.concatenate([np.cumsum([len(x) for _, x in lines], dtype=np.int64), np.array(line_ends(body or ""), dtype=np.int64) + offset])
                    tokens = np.cumsum(lengths[np.array(enc.encode_ordinary(whole), dtype=np.int64)])
                    # Character offsets as byte offsets: where each character's first byte stands.
                    encoded = np.frombuffer(whole.encode("utf-8", "surrogatepass"), dtype=np.uint8)
                    heads = np.append(np.flatnonzero((encoded & 0xC0) != 0x80), len(encoded))
                    counts, crossing = allocate(tokens, heads[ends], rule)
                    n = len(ends)
                    for column, values_ in zip(out, ([name] * n, range(n), [f for f, _ in lines] + [text] * (n - len(lines)), [0, *ends[:-1].tolist()], ends.tolist(), counts.tolist(), crossing.tolist())):
                        column.extend(values_)
                types = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["key", "section", "field", "start", "end", "tokens", "crossing"])

    columns = [F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("body"), *[F.col(f).cast("string").alias(f"field_{i}") for i, f in enumerate(fields)]]
    return docs.select(*columns).mapInArrow(run, OUTPUT).withColumnRenamed("key", key)
