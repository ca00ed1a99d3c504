"""Byte-level BPE encoding and decoding of whole texts.

The `tokenizers` library runs inside tasks over Arrow batches. A match of the
split pattern never crosses a place where a blank follows a non-blank, so
texts are cut there, and each distinct piece is encoded once per worker and
kept in a cache of two generations of bounded size. Ids leave as packed little-endian unsigned 32-bit
integers; decoding joins the bytes of each id, so characters split over
several tokens come back whole.

Null texts count as empty and give no ids; ids, repeated or null, are carried
as they are; every input row gives one output row.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CACHE_PIECES = 600_000  # of both generations, in each worker
GROUP = 1000

# A blank inside a longer run of white space, where cutting is not safe.
_INSIDE_RUN = re.compile(r"\s (?:\s|\Z)")

_state: dict = {}


def _tokenizer(path: str):
    """The worker's tokenizer and piece caches (young, old) of one vocabulary file."""
    if path not in _state:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        _state[path] = [tokenizer, {}, {}]
    return _state[path]


def token_bytes(rank_path: str) -> list[bytes]:
    """Bytes of each id, from a rank file of base64 tokens."""
    with open(rank_path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    table = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        table[int(rank)] = base64.b64decode(token)
    return table


class Decoder:
    """Bytes of packed ids, gathered from one flat table of all tokens."""

    def __init__(self, rank_path: str, segment: int = 1 << 18) -> None:
        table = token_bytes(rank_path)
        self.data = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.lengths = np.array([len(b) for b in table], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.segment = segment  # ids gathered at once

    def gather(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.data[np.repeat(self.starts[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def decode(self, packed: list[bytes | None]) -> list[bytes]:
        """Decoded bytes of each text."""
        ids = [np.frombuffer(p or b"", dtype="<u4") for p in packed]
        whole = np.concatenate(ids) if ids else np.zeros(0, dtype="<u4")
        raw = b"".join(self.gather(whole[a:a + self.segment]) for a in range(0, len(whole), self.segment))
        upto = np.r_[0, np.cumsum(self.lengths[whole])]
        cuts = upto[np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int64)].tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def pieces_of(text: str) -> list[str]:
    """Cut `text` into pieces that encode independently; they join to `text`."""
    if not text:
        return []
    if _INSIDE_RUN.search(text):
        return [text]
    first, *rest = text.split(" ")
    pieces = [" " + part for part in rest]
    return [first, *pieces] if first else pieces


def _encode_pieces(tokenizer, pieces: list[str]) -> list[bytes]:
    out = []
    for start in range(0, len(pieces), GROUP):
        group = pieces[start:start + GROUP]
        encoding = tokenizer.encode(group, is_pretokenized=True, add_special_tokens=False)
        packed = np.array(encoding.ids, dtype="<u4").tobytes()
        cuts = (4 * np.searchsorted(np.array(encoding.word_ids, dtype=np.int64), np.arange(len(group) + 1))).tolist()
        out += [packed[a:b] for a, b in zip(cuts, cuts[1:])]
    return out


def encode_texts(texts: list[str | None], path: str) -> list[bytes]:
    """Packed ids of each text."""
    state = _tokenizer(path)
    tokenizer, out = state[0], []
    for start in range(0, len(texts), 100):
        if len(state[1]) > CACHE_PIECES // 2:
            state[1:] = [{}, state[1]]
        young, old = state[1], state[2]
        cut = [pieces_of(text or "") for text in texts[start:start + 100]]
        missing = {piece for pieces in cut for piece in pieces}.difference(young)
        known = {piece for piece in missing if piece in old}
        young.update((piece, old[piece]) for piece in known)
        new = list(missing - known)
        long = [piece for piece in new if len(piece) > 200]
        short = [piece for piece in new if len(piece) <= 200]
        young.update(zip(short, _encode_pieces(tokenizer, short)))
        extra = dict(zip(long, _encode_pieces(tokenizer, long)))
        get = young.__getitem__ if not extra else lambda piece: extra[piece] if piece in extra else young[piece]  # noqa: B023
        out += [b"".join(map(get, pieces)) for pieces in cut]
    return out


def char_offsets(text: str, packed: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last character of each token.

    `lengths` has the bytes of each id. A character whose bytes lie in several
    tokens belongs to all of them.
    """
    ids = np.frombuffer(packed, dtype="<u4")
    ends = np.cumsum(lengths[ids])
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    char_of_byte = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char_of_byte[ends - lengths[ids]], char_of_byte[ends - 1] + 1


def encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", rank_path: str | None = None) -> DataFrame:
    """(id, ids binary) per row; with `rank_path` also starts and ends, the
    character offsets of the tokens as arrays of integers."""
    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.BinaryType())]
    if rank_path:
        fields += [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("starts", "ends")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(b) for b in token_bytes(rank_path)], dtype=np.int64) if rank_path else None
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = part.column(1).to_pylist()
                packed = encode_texts(texts, tokenizer_path)
                columns = [part.column(0), pa.array(packed, pa.binary())]
                if rank_path:
                    spans = [char_offsets(text or "", ids, lengths) if ids else ((), ()) for text, ids in zip(texts, packed)]
                    columns += [pa.array([list(s[i]) for s in spans], pa.list_(pa.int32())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return df.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, rank_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded binary) per row of packed ids; null ids decode to no bytes."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(rank_path)
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                decoded = decoder.decode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(decoded, pa.binary())], names=[id_col, "ids", "decoded"])

    return df.select(id_col, ids_col).mapInArrow(run, schema)


def round_trip(df: DataFrame, tokenizer_path: str, rank_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) per row: `encode` and `decode` in one pass of one worker."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(rank_path)
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                packed = encode_texts(part.column(1).to_pylist(), tokenizer_path)
                decoded = decoder.decode(packed)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary()), pa.array(decoded, pa.binary())], names=schema.fieldNames())

    return df.select(id_col, text_col).mapInArrow(run, schema)
