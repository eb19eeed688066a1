"""Token counts by field: encode a document once, then attribute its tokens to fields by character spans.

A byte-level BPE vocabulary cuts the whole text into tokens whose bytes, one after another, are the text. Token ends are
the running sum of token lengths, mapped to code points. Fields are character intervals of the text, in any order, with
gaps or overlaps. The interval join of tokens and fields is two binary searches a field. A token that crosses a boundary
is allocated by a stated rule:

- ``first``: to fields that hold its first character (the default; over fields that tile a text every token counts once)
- ``last``: to fields that hold its last character
- ``inside``: only to fields that hold all of it
- ``any``: to every field that holds part of it
- ``share``: to each field in proportion to its characters inside (a fractional count)

A token may hold part of a character; it then spans that character.

Defined cases: null text has no fields and no tokens; an empty text has one empty field by `line_fields`; a text of any
length is encoded whole (runs of white space of LONG_SPACE characters and more are encoded apart, where the vocabulary's
pattern cuts anyway, as its matcher runs out of stack on them: the tokens are the same); an empty table gives an empty
result; repeated rows are counted alike; further columns are ignored.

The vocabulary is a parameter: a tiktoken rank file that the driver reads and ships (about 1 MB whatever the input).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, table

RULES = ("first", "last", "inside", "any", "share")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary cuts a text before merging: fixed, it comes with the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space as that pattern has it; shorter runs are left to the encoder.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_SPACE = 10_000

SCHEMA = "doc_id long, field int, start long, end long, tokens double, crossing long, doc_tokens long"

_CODECS: dict[int, tuple] = {}


class Codec:
    """An encoder that gives, for each text, where its tokens begin and end in characters."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN) -> None:
        self.ranks, self.pattern = ranks, pattern

    def _ready(self) -> tuple:
        key = hash((self.ranks, self.pattern))
        if key not in _CODECS:  # once a process
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in self.ranks.splitlines() if line)}
            size = np.zeros(max(table.values()) + 1, dtype=np.int64)
            for piece, rank in table.items():
                size[rank] = len(piece)
            _CODECS[key] = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=table, special_tokens={}), size
        return _CODECS[key]

    def encode(self, text: str) -> np.ndarray:
        codec, _ = self._ready()
        parts, at = [], 0
        for run in re.finditer(f"[{SPACES}]{{{LONG_SPACE},}}", text) if len(text) >= LONG_SPACE and self.pattern == PATTERN else ():
            # the pattern takes a run as one piece, but for its last character if something follows
            end = run.end() - (run.end() < len(text))
            parts += [codec.encode_ordinary(text[at : run.start()]), codec._encode_single_piece(text[run.start() : end])]
            at = end
        parts.append(codec.encode_ordinary(text[at:]))
        return np.asarray(parts[0] if len(parts) == 1 else [t for p in parts for t in p], dtype=np.int64)

    def spans(self, text: str, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last. data: the bytes of the text."""
        _, size = self._ready()
        ends = np.cumsum(size[self.encode(text)])
        if len(data) == len(text):
            return np.concatenate([[0], ends[:-1]]) if len(ends) else ends, ends
        begun = np.zeros(len(data) + 1, dtype=np.int64)  # characters begun before each byte
        np.cumsum((data & 0xC0) != 0x80, out=begun[1:])
        whole = np.append((data & 0xC0) != 0x80, True)  # whether a character begins at a byte
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return begun[starts] - ~whole[starts], begun[ends]


def line_fields(text: str) -> np.ndarray:
    """The lines of a text as fields, each with the line break that ends it: they tile the text."""
    cuts = [0]
    at = text.find("\n")
    while at >= 0:
        cuts.append(at + 1)
        at = text.find("\n", at + 1)
    if cuts[-1] != len(text) or len(cuts) == 1:
        cuts.append(len(text))
    return np.stack([cuts[:-1], cuts[1:]], axis=1).astype(np.int64)


def allocate(starts: np.ndarray, ends: np.ndarray, fields: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each field by the rule, and how many tokens lie partly in it. starts and ends never decrease."""
    a, b = fields[:, 0], fields[:, 1]
    some = b > a
    # tokens that touch a field: those that end after it begins, up to those that begin before it ends
    lo, hi = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left")
    touch = np.where(some, np.maximum(hi - lo, 0), 0)
    within = np.where(some, np.maximum(np.searchsorted(ends, b, side="right") - np.searchsorted(starts, a, side="left"), 0), 0)
    if rule == "first":
        out = hi - np.searchsorted(starts, a, side="left")
    elif rule == "last":
        out = np.searchsorted(ends, b, side="right") - lo
    elif rule == "inside":
        out = within
    elif rule == "any":
        out = touch
    elif rule == "share":
        width = np.maximum(ends - starts, 1)
        done = np.concatenate([[0.0], np.cumsum((ends > starts).astype(float))])
        full = np.array([_part(starts, ends, width, done, x) for x in np.concatenate([a, b])]).reshape(2, -1)
        out = np.where(some, full[1] - full[0], 0.0)
    else:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    return np.where(some, out, 0).astype(float), touch - within


def _part(starts: np.ndarray, ends: np.ndarray, width: np.ndarray, done: np.ndarray, x: int) -> float:
    """Tokens before character x, the ones that hold it in part counted in proportion."""
    full = int(np.searchsorted(ends, x, side="right"))
    some = slice(full, int(np.searchsorted(starts, x, side="left")))
    return float(done[full] + ((x - starts[some]) / width[some]).sum())


def count_tokens(df: DataFrame, codec: Codec, rule: str = "first", fields: Callable[[str], np.ndarray] = line_fields) -> DataFrame:
    """For each field of each row of (doc_id, text): its span, its tokens, crossing tokens, and the document's tokens."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            out, rows = [], 0
            for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())):
                if text is None:
                    continue
                starts, ends = codec.spans(text, data[offsets[i] : offsets[i + 1]])
                found = fields(text)
                tokens, crossing = allocate(starts, ends, found, rule)
                out.append((doc, found, tokens, crossing, len(starts)))
                rows += len(found)
                if rows >= 20_000:
                    yield _rows(out, names)
                    out, rows = [], 0
            if out:
                yield _rows(out, names)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(counted, SCHEMA)


def _rows(found: list[tuple], names: list[str]) -> pa.RecordBatch:
    n = [len(x[1]) for x in found]
    spans = np.concatenate([x[1] for x in found])
    docs = pa.array([x[0] for x in found], pa.int64()).take(pa.array(np.repeat(np.arange(len(found)), n)))
    columns = [
        docs, pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in n])), pa.array(spans[:, 0]), pa.array(spans[:, 1]),
        pa.array(np.concatenate([x[2] for x in found])), pa.array(np.concatenate([x[3] for x in found]).astype(np.int64)),
        pa.array(np.repeat(np.array([x[4] for x in found], dtype=np.int64), n)),
    ]
    return pa.RecordBatch.from_arrays(columns, names)


def load(path: str = VOCABULARY) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read())


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), load())
