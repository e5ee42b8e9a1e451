"""Byte-level BPE encoding and decoding without merging: longest matches, corrected by backtracking.

The automaton holds every token's bytes as Latin-1 text. A piece is encoded from left to right with the longest token
that fits; two neighbouring tokens may stand together only if merging their joined bytes by rank would give just these
two, which is worked out once per pair and remembered. Where no token fits, the last one is taken back and shortened;
a bit per position keeps any dead end from being tried twice, so the work stays in proportion to the bytes. The result is
exactly that of merging the lowest rank first.

Nulls encode as the empty text. Empty texts give no ids. Repeated rows are encoded each. Other columns stay as they are,
and the operator's own columns replace any of the same name.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import PieceCache, pieces

#: Distinct chunks that a worker remembers, at some 200 bytes each, and pairs of tokens, at some 150.
MOST_CHUNKS, MOST_PAIRS = 900_000, 1_000_000


class RankEncoder:
    """The merges of one rank file (tiktoken's format)."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.length = {v: len(k) for k, v in self.ranks.items()}
        self.decimal = [str(i) for i in range(max(self.bytes_of, default=-1) + 1)]
        self.halves: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in filter(lambda x: self.made(x[1]), self.ranks.items()):  # a token that no merge gives stands only as a whole piece
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()

    def merged(self, piece: bytes) -> list[int]:
        """The plain way, for short strings: merge the lowest rank first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge is this one; (token, token) for one that no merge makes."""
        if token not in self.halves:
            whole = self.bytes_of[token]
            parts = [whole[i : i + 1] for i in range(len(whole))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (token, token)
        return self.halves[token]

    def made(self, token: int) -> bool:
        """Whether merging a token's own bytes gives it back."""
        return len(self.bytes_of[token]) == 1 or self.split(token) != (token, token)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both, joined, ends in these two tokens."""
        if (known := self.fits.get((left, right))) is not None:
            return known
        a, b, limit, ok = left, right, 1 << 60, True
        while True:
            if self.ranks.get(self.bytes_of[a] + self.bytes_of[b], 1 << 60) < limit:
                ok = False
                break
            # Undo the later of the two merges next to the border; both sides end in single bytes.
            if a > b:
                limit, a = a, self.split(a)[1]
                if a == limit:
                    limit, b = b + 1, self.split(b)[0]
                    if b + 1 == limit:
                        break
            else:
                limit, b = b + 1, self.split(b)[0]
                if b + 1 == limit:
                    limit, a = a, self.split(a)[1]
                    if a == limit:
                        break
        if len(self.fits) >= MOST_PAIRS:
            self.fits.clear()  # what is needed again is worked out again
        self.fits[left, right] = ok
        return ok

    def next_shorter(self, token: int) -> int | None:
        """The longest other token that this one begins with and that merges can make."""
        if token not in self.shorter:
            whole = self.bytes_of[token]
            found = (self.ranks.get(whole[:n]) for n in range(len(whole) - 1, 0, -1))
            self.shorter[token] = next((x for x in found if x is not None and self.made(x)), None)
        return self.shorter[token]

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        text = piece.decode("latin-1")
        greedy = [token for _, (_, token) in self.automaton.iter_long(text)]
        fits = self.fits
        for pair in zip(greedy, greedy[1:], strict=False):
            if not (fits[pair] if pair in fits else self.compatible(*pair)):
                break
        else:
            return greedy  # longest matches all along, and every pair may stand
        longest: list[int | None] = [None] * len(piece)
        for end, (n, token) in self.automaton.iter(text):
            longest[end - n + 1] = token  # ends rise, so the last one for a start is the longest
        alive = bytearray(b"\1" * (len(piece) + 1))
        length, shorter, size = self.length, self.shorter, len(piece)
        out: list[int] = []
        at, token = 0, longest[0]
        while token is not None:
            last = out[-1] if out else None
            while True:
                end = at + length[token]
                if alive[end]:
                    if last is None or (fits[pair] if (pair := (last, token)) in fits else self.compatible(last, token)):
                        out.append(token)
                        at = end
                        token = longest[at] if at < size else None
                        break
                token = shorter[token] if token in shorter else self.next_shorter(token)
                if token is None:
                    alive[at] = 0
                    out.pop()
                    at -= length[last]
                    token = last
                    break
        return out

    def encode(self, text: str) -> list[int]:
        """Each match of the pattern separately, as its library does."""
        return [i for piece in self.pattern.findall(text) for i in self.encode_piece(piece.encode("utf-8", "surrogatepass"))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> RankEncoder:
    """One per worker process and rank file."""
    return RankEncoder(path, pattern)


def _encoder_of_texts(path: str, pattern: str) -> tuple[RankEncoder, Callable[[str | None], bytes]]:
    """The encoder and a function from a text to its ids as little-endian 32-bit integers, with a cache of chunks."""
    tool = encoder(path, pattern)
    packed = lambda text: array("i", tool.encode(text)).tobytes()
    cache = PieceCache(lambda texts: list(map(packed, texts)), MOST_CHUNKS)

    @functools.lru_cache(maxsize=1)
    def run(text: str | None) -> bytes:
        """Copies that follow each other, as a mixture draws them, are encoded once."""
        chunks = pieces(text or "")
        return packed(text or "") if chunks is None else b"".join(cache.parts(chunks))

    return tool, run


def encode_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs without text, with ids (array<int>), n_tokens (long) and lossless: whether the ids decode to the text."""
    rest = docs.drop("ids", "n_tokens", "lossless")
    schema = rest.drop("text").withColumns({"ids": F.array().cast("array<int>"), "n_tokens": F.lit(0).cast("long"), "lossless": F.lit(True)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, encoded = _encoder_of_texts(path, pattern)
        for big in batches:
            for at in range(0, big.num_rows, 1_000):  # ids take several times the room of the text
                batch = big.slice(at, 1_000)
                raw, lossless, before = [], [], b""
                for i, x in enumerate(batch.column("text").to_pylist()):
                    raw.append(ids := encoded(x))
                    if i == 0 or ids is not before:
                        same = tool.decode(np.frombuffer(ids, "<i4").tolist()) == (x or "").encode("utf-8", "surrogatepass")
                    lossless.append(same)
                    before = ids
                sizes = np.fromiter(map(len, raw), "i8", len(raw)) >> 2
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype("i4")), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                new = {"ids": ids, "n_tokens": pa.array(sizes), "lossless": pa.array(lossless, pa.bool_())}
                yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in schema.names], schema.names)

    return rest.mapInArrow(run, schema)


def decode_ids(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with a binary column of the bytes that the ids stand for; unknown ids raise."""
    schema = docs.drop(out).withColumn(out, F.lit(b"")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = encoder(path, pattern)
        for batch in batches:
            yield batch.drop(columns=[out], errors="ignore").assign(**{out: [tool.decode(() if x is None else x) for x in batch[ids]]})[schema.names]

    return docs.mapInPandas(run, schema)


def round_trip_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode each text, decode its ids, and digest both."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, encoded = _encoder_of_texts(path, pattern)
        for batch in batches:
            rows = []
            for x in batch["text"]:
                ids = np.frombuffer(encoded(x), "<i4").tolist()
                decimals = ",".join(map(tool.decimal.__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(decimals.encode()).hexdigest(), hashlib.sha256(tool.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(doc_id=batch["doc_id"].array)[["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
