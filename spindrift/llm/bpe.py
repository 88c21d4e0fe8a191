"""Byte-level BPE by overlapping chunks.

A long text is cut into chunks that overlap, wherever that falls. Every chunk is pre-tokenised by
itself, from where it starts, and reports the boundaries of its pre-tokens that lie in the two overlaps. Two
neighbours are stitched at the first boundary that both have there: the pattern looks only forward,
so from a common boundary on both go the same way. The pieces between stitches are encoded
apart, by as many tasks as there are. Neighbours without a common boundary (a pre-token longer
than the overlap) become one piece. Decoding joins raw bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.common import map_rows

CHUNK = 1 << 16
OVERLAP = 1 << 12
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@functools.cache
def encoding(name: str = VOCABULARY):
    """The tokenizer of a rank file of public_tokenizers; read where it is used, never shipped."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _pre_token():
    """PATTERN, with white space as the tokenizer's library has it."""
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")), regex.compile(r"\p{White_Space}")


def edges(part: str, first: bool) -> np.ndarray:
    """Where pre-tokens of a chunk end that a piece may end with: not at its end, which may be amid a pre-token, and
    not after white space, whose pre-tokens depend on what follows. But for the text's first chunk, the first two are
    left out: a chunk that starts amid a pre-token may see a false one there, and none once a run of its own has ended."""
    pattern, space = _pre_token()
    ends = [z for m in pattern.finditer(part) if (z := m.end()) < len(part) and not space.match(part, z - 1)]
    return np.array(ends if first else ends[2:], np.int64)


class Encoder:
    """The tokenizer as a task uses it."""

    def __init__(self, vocabulary: str = VOCABULARY):
        enc = encoding(vocabulary)
        self.encode = enc.encode_ordinary
        self.bytes = [enc.decode_single_token_bytes(i) for i in range(enc.n_vocab)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def chunks(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Chunks of size + overlap characters, one every size characters; the last is shorter. overlap is size at most."""
    return [text[a : a + size + overlap] for a in range(0, max(1, len(text) - overlap), size)]


def pre_tokenised(part: str, k: int, size: int = CHUNK, overlap: int = OVERLAP) -> tuple[bytes, bytes]:
    """The edges of chunk k in its first overlap, from its start, and in its last, from the next one's start."""
    found = edges(part, k == 0)
    return found[found < overlap].tobytes(), (found[found >= size] - size).tobytes()


def stitched(rows, overlap: int = OVERLAP):
    """Pieces (doc_id, key, number, last, text) from (doc_id, key, k, n, heads, tails, part) of chunks in order. Chunks
    without a common edge run on as one piece."""
    held, number, before = [], 0, b""
    for doc_id, key, k, n, heads, tails, part in rows:
        if k == 0:
            held, number = [part], 0
        else:
            common = np.intersect1d(np.frombuffer(before, np.int64), np.frombuffer(heads, np.int64))
            if len(common):
                p = int(common[0])
                yield doc_id, key, number, False, "".join([*held[:-1], held[-1][: len(held[-1]) - overlap + p]])
                held, number = [part[p:]], number + 1
            else:
                held.append(part[overlap:])
        before = tails
        if k == n - 1:
            yield doc_id, key, number, True, "".join(held)
            held = []


def encode_all(docs: DataFrame, finish: Callable, schema: str, vocabulary: str = VOCABULARY, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """finish(ids, decoded bytes) -> tuple of the columns in schema, for each row of docs, after doc_id.

    Short texts are encoded where they are read. The chunks of longer ones are dealt out to all
    tasks by number and pre-tokenised, stitched in order, and the pieces dealt out again and encoded; only their ids
    meet once more, in order, for finish(). Null text counts as empty. Repeated rows give repeated results.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    long = F.length("text") > size + overlap
    full = f"doc_id long, {schema}"

    def one(rows):
        enc = Encoder(vocabulary)
        for doc_id, text in rows:
            ids = enc.encode(text)
            yield doc_id, *finish(ids, enc.decode(ids))

    def deal(rows):
        for doc_id, key, text in rows:
            parts = chunks(text, size, overlap)
            for k, part in enumerate(parts):
                yield doc_id, key, k, len(parts), part

    def pre_tokenise(rows):
        for doc_id, key, k, n, part in rows:
            yield doc_id, key, k, n, *pre_tokenised(part, k, size, overlap), part

    def stitch(rows):
        return stitched(rows, overlap)

    def encode(rows):
        enc = Encoder(vocabulary)
        for doc_id, key, k, last, piece in rows:
            yield doc_id, key, k, last, np.array(enc.encode(piece), np.uint32).tobytes()

    def join(rows):
        enc, ids = Encoder(vocabulary), []
        for doc_id, _, k, last, part in rows:
            if k == 0:
                ids = []
            ids.extend(np.frombuffer(part, np.uint32).tolist())
            if last:
                yield doc_id, *finish(ids, enc.decode(ids))

    short = map_rows(rows.where(~long), full, one, 500)
    # the key tells rows apart that share doc_id and text
    keyed = rows.where(long).select("doc_id", F.monotonically_increasing_id().alias("key"), "text")
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = map_rows(keyed, "doc_id long, key long, k int, n int, part string", deal, 16).repartition(n_parts, "key", "k")
    cut = map_rows(dealt, "doc_id long, key long, k int, n int, heads binary, tails binary, part string", pre_tokenise, 16)
    cut = cut.repartition(n_parts, "key").sortWithinPartitions("key", "k")
    pieces = map_rows(cut, "doc_id long, key long, k int, last boolean, piece string", stitch, 16).repartition(n_parts, "key", "k")
    ids = map_rows(pieces, "doc_id long, key long, k int, last boolean, part binary", encode, 64)
    whole = map_rows(ids.repartition(n_parts, "key").sortWithinPartitions("key", "k"), full, join, 16)
    return short.union(whole)


@functools.cache
def _numerals(n: int = 1 << 16) -> list[str]:
    return list(map(str, range(n)))


def digest(ids: list[int], decoded: bytes) -> tuple:
    return len(ids), hashlib.sha256(",".join(map(_numerals().__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def encode_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return encode_all(docs, digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame) -> DataFrame:
    """doc_id and ids (array<int>) of every row."""
    return encode_all(docs, lambda ids, decoded: (ids,), "ids array<int>")


def decode_ids(ids: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and the bytes of ids; null ids give empty bytes. Bytes need not be valid UTF-8."""

    def run(rows):
        enc = Encoder(vocabulary)
        for doc_id, x in rows:
            yield doc_id, enc.decode(x or [])

    return map_rows(ids.select("doc_id", F.col("ids").cast(T.ArrayType(T.IntegerType()))), "doc_id long, bytes binary", run, 500)


def boundaries(text: str) -> list[int]:
    """Where the pre-tokens of a text begin and end; for tests of the stitches."""
    spans = [m.span() for m in _pre_token()[0].finditer(text)]
    assert all(a[1] == b[0] for a, b in pairwise(spans))
    return [a for a, _ in spans] + [len(text)]
