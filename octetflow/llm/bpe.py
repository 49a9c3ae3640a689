"""Byte-level BPE by backtracking over longest matches, and its inverse."""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from functools import cached_property

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octetflow.llm.common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces whose ids a worker remembers before it starts afresh; a matter of speed and memory only.
REMEMBERED = 400_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class _Memo(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece):
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = ids = self.make(piece)
        return ids


class BytePairEncoder:
    """Ids by rank, as merging the adjacent pair of lowest rank again and again would give.

    The merge result of a byte string is the only sequence of tokens in which each adjacent pair is compatible, that is, merges
    back into itself. So the encoder takes the longest token at each place (found for all places by one pass of
    an Aho-Corasick automaton over the bytes as Latin-1), steps to the next shorter prefix where a pair is not compatible, and backs
    up where none is left; places from which no end is reachable are marked, which keeps the whole linear."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes = {i: t for t, i in ranks.items()}
        self.split = {i: (i, i) for t, i in ranks.items() if len(t) == 1}
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for i in sorted(self.bytes):
            t = self.bytes[i]
            for cut in range(len(t) - 1, 0, -1):
                a, b = ranks.get(t[:cut], i), ranks.get(t[cut:], i)
                if a < i and b < i and a in self.split and b in self.split and self._fit(a, b):
                    self.split[i], self.merged[a, b] = (a, b), i
                    break
        self.length, self.shorter, self.automaton = {}, {}, ahocorasick.Automaton()
        for i in self.split:  # a token that merging never reaches is no candidate within a longer piece
            t = self.bytes[i]
            self.length[i] = len(t)
            self.shorter[i] = next((j for n in range(len(t) - 1, 0, -1) if (j := ranks.get(t[:n])) in self.split), None)
            self.automaton.add_word(t.decode("latin-1"), (len(t) - 1, i))
        self.automaton.make_automaton()
        self.pieces = _Memo(self.encode_piece)

    def _fit(self, a: int, b: int) -> bool:
        """Whether no merge across the border of a and b comes before the merges that make them."""
        split, merged, limit = self.split, self.merged, sys.maxsize
        while True:
            if merged.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, split[a][1]
                if a == limit:
                    limit, b = b + 1, split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, split[b][0]
                if b + 1 == limit:
                    limit, a = a, split[a][1]
                    if a == limit:
                        return True

    def compatible(self, a: int, b: int) -> bool:
        if (known := self.fits.get((a, b))) is None:
            if len(self.fits) >= 2 * REMEMBERED:
                self.fits.clear()
            known = self.fits[a, b] = self._fit(a, b)
        return known

    def encode_piece(self, piece: str) -> bytes:
        """The ids of one match of the pattern, as unsigned 32-bit integers in native byte order."""
        raw = piece.encode("utf-8", "surrogatepass")
        if (whole := self.ranks.get(raw)) is not None:
            return array("I", (whole,)).tobytes()
        length, shorter, fits, n = self.length, self.shorter, self.fits, len(raw)
        longest = [0] * n
        for end, (size, i) in self.automaton.iter(raw.decode("latin-1")):
            longest[end - size] = i  # of one start, ends come in order; size is one less than the token's
        ids = [longest[0]]
        pos = length[longest[0]]
        if pos == n:
            return array("I", ids).tobytes()
        last, token, shut = longest[0], longest[pos], None
        while True:
            end = pos + length[token]
            if shut is None or end not in shut:
                if (fit := fits.get((last, token))) is None:
                    fit = last == -1 or self.compatible(last, token)
                if fit:
                    ids.append(token)
                    if end == n:
                        return array("I", ids).tobytes()
                    pos, last, token = end, token, longest[end]
                    continue
            while (token := shorter[token]) is None:  # nothing fits at pos: never come back to it
                if shut is None:
                    shut = set()
                shut.add(pos)
                token = ids.pop()
                pos -= length[token]
                last = ids[-1] if ids else -1

    def encode_bytes(self, text: str | None) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return memoryview(self.encode_bytes(text)).cast("I").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class _Source:
    """What a worker makes its encoder from, once: it keeps the broadcast's value, and this with it."""

    def __init__(self, data: bytes, pattern: str):
        self.data, self.pattern = data, pattern

    @cached_property
    def encoder(self) -> BytePairEncoder:
        return BytePairEncoder(parse_ranks(self.data), self.pattern)


def _source(spark: SparkSession, path: str | None, pattern: str):
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:  # the vocabulary is on the driver; its size is fixed
        return spark.sparkContext.broadcast(_Source(f.read(), pattern))


def bpe_encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``docs`` with one more column, array<int>: the ids of the whole text, without special tokens. Null and empty texts have none. An ids_col of ``docs`` is replaced."""
    source = _source(docs.sparkSession, path, pattern)

    def ids(series):
        enc = source.value.encoder
        return pa.array([enc.encode(t) for t in series.to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn(ids_col, F.arrow_udf(ids, "array<int>")(F.col(text_col).cast("string")))


def bpe_decode(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``df`` with the bytes that the ids stand for (binary: ids cut at any place need not be UTF-8). Null ids: no bytes. Unknown ids fail."""
    source = _source(df.sparkSession, path, pattern)

    def text(series):
        enc = source.value.encoder
        return pa.array([enc.decode(x or []) for x in series.to_pylist()], pa.binary())

    return df.withColumn(text_col, F.arrow_udf(text, "binary")(F.col(ids_col)))


def bpe_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text in one pass and keeps, a row: id_col, n_tokens, ids_sha256 (ids as little-endian unsigned
    32-bit integers), decoded_sha256, and with ``with_ids`` the ids (array<int>). Rows with null ids, null or empty texts (0 tokens, digests of no bytes) and
    repeated rows stay; other columns are ignored. No shuffle."""
    source = _source(docs.sparkSession, path, pattern)

    def run(batches):
        enc, sha = source.value.encoder, hashlib.sha256
        little = sys.byteorder == "little"
        for batch in batches:
            n, a, b, kept = [], [], [], []
            for t in batch.column(1):  # one text at a time in Python's memory
                ids = enc.encode_bytes(t.as_py())
                n.append(len(ids) // 4)
                a.append(sha(ids if little else np.frombuffer(ids, np.uint32).astype("<u4").tobytes()).hexdigest())
                b.append(sha(enc.decode(memoryview(ids).cast("I"))).hexdigest())
                if with_ids:
                    kept.append(np.frombuffer(ids, np.uint32).astype(np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, ["id", "n", "a", "b", "ids"][: 4 + with_ids])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids]
    return rows.mapInArrow(run, "id long, n long, a string, b string" + ", ids array<int>" * with_ids).toDF(*names)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))
