"""Operator 3: byte-level BPE encoding and decoding.

The tokenizers library encodes; texts stream through Arrow batches.  A text is cut
before each blank that follows a non-blank (where no match of the published pattern can go
on), so that the library meets each distinct chunk about once per worker; with any other
pattern texts are encoded whole.  Ids decode by their strings in byte characters:
joined, their characters go back to bytes by the reversed byte table, and only then are
bytes read as text, so a character that is split among tokens comes back whole.

Nulls and empty texts give no tokens.  Texts are never cut for length.  Of pairs of one
rank, which are equal pairs, the left one is merged first.  Repeated rows
give equal rows; an empty table gives an empty table; extra columns are ignored unless
named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_map, keeps, need

FILE = "byte_bpe_multi_50k.tiktoken"


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


_caches: dict[str, tokens.Chunks] = {}
keeps(__name__, _caches.clear)


def _cache(path: str, pattern: str) -> tokens.Chunks:
    key = path if path.endswith(".json") else f"{path}\n{pattern}"
    if key not in _caches:
        _caches[key] = tokens.Chunks(tokens.from_json(path) if path.endswith(".json") else tokens.from_ranks(path, pattern), room=150_000)
    return _caches[key]


def encode_texts(texts: list[str], path: str | None = None, pattern: str | None = None) -> list[bytes]:
    """Ids of each text, little-endian unsigned 32-bit."""
    path, pattern = path or tokens.vocabulary(FILE), pattern or _pattern()
    # A file brings its own pattern: byte-level ones have the published kind.
    cut = tokens.spaced_chunks if path.endswith(".json") or pattern == _pattern() else lambda t: [t] if t else []
    return _cache(path, pattern).of([cut(t) for t in texts])


def decode_ids(ids: bytes, path: str | None = None) -> bytes:
    """The bytes that ids stand for: their strings joined, and the byte table reversed."""
    table = tokens.token_strings(path or tokens.vocabulary(FILE))
    return tokens.spelt_bytes("".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]))


def offsets(ids: bytes, path: str | None = None) -> np.ndarray:
    """Rows (byte start, byte end, character start, character end) for each token.  A
    token that begins or ends inside a character covers that whole character."""
    path = path or tokens.vocabulary(FILE)
    table = tokens.token_bytes(path)
    pieces = [table[i] for i in np.frombuffer(ids, "<u4").tolist()]
    ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return np.stack([starts, ends, char[starts], char[ends - 1] + 1], axis=1) if len(ends) else np.zeros((0, 4), np.int64)


def encode(df: DataFrame, *, path: str | None = None, pattern: str | None = None, with_offsets: bool = False, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, ids (binary, little-endian unsigned 32-bit) and n_tokens; with
    ``with_offsets`` also char_starts and char_ends, in code points."""
    keep = list(keep)
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["ids binary", "n_tokens long"]
    if with_offsets:
        fields += ["char_starts array<long>", "char_ends array<long>"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
        ids = encode_texts(texts, path, pattern)
        cols = [batch.column(i) for i in range(len(keep))] + [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
        if with_offsets:
            spans = [offsets(x, path) for x in ids]
            cols += [pa.array([s[:, k].tolist() for s in spans], pa.list_(pa.int64())) for k in (2, 3)]
        return pa.RecordBatch.from_arrays(cols, names=[*keep, "ids", "n_tokens", "char_starts", "char_ends"][: len(cols)])

    source = need(df, *keep, text).withColumnRenamed(text, "__text")
    return arrow_map(source, work, ", ".join(fields), "__text")


def decode(df: DataFrame, *, path: str | None = None, keep: Sequence[str] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` columns and decoded (binary).  Null ids decode to nothing."""
    keep = list(keep)
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["decoded binary"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [decode_ids(x or b"", path) for x in batch.column(batch.num_columns - 1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(out, pa.binary())], names=[*keep, "decoded"])

    return arrow_map(need(df, *keep, ids).withColumnRenamed(ids, "__ids"), work, ", ".join(fields), "__ids")


def report(df: DataFrame, path: str | None = None) -> DataFrame:
    """Digest columns per document, derived from encode() and decode()."""
    made = encode(df, path=path)
    digests = made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids")
    back = decode(digests, path=path, keep=["doc_id", "n_tokens", "ids_sha256"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
