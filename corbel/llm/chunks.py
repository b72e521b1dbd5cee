"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of every text; a chunk ends where the hash is
the largest of its neighbourhood, so an edge depends on nearby bytes alone and
an insertion shifts no other edge.  Chunks are told apart by a 128-bit digest.
Of equal chunks the one in the smallest document, first place, stays; runs of
later ones are removed if they are long enough not to be chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corbel.llm.common import materialize, packed, text_of, unpacked

#: Bytes that the gear hash remembers.
GEAR_WINDOW = 32
#: A chunk ends where the hash is largest among this many bytes before and after; chunks are longer than this.
REACH = 24
#: Runs of repeated chunks are removed from this many bytes on.
LEAST_RUN = 100
#: Bytes that are hashed at once.
BLOCK = 1 << 18


def gear_table(seed: int = 97) -> np.ndarray:
    """256 random 32-bit numbers, one for each byte."""
    return np.random.default_rng(seed).integers(0, 2**32, 256, dtype=np.uint32)


_GEAR = gear_table()


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at every byte: h = 2h + G[byte] mod 2^32, in five doubling steps instead of byte by byte."""
    h = _GEAR[data]
    n = 1
    while n < GEAR_WINDOW:
        h[n:] = h[n:] + (h[:-n] << np.uint32(n))
        n *= 2
    return h


def _largest(h: np.ndarray, reach: int) -> np.ndarray:
    """The maximum of each place's neighbourhood of ``reach`` on either side."""
    width = 2 * reach + 1
    x = np.concatenate([np.zeros(reach, h.dtype), h, np.zeros(reach, h.dtype)])
    n = 1
    while 2 * n <= width:
        x = np.maximum(x[:-n], x[n:])
        n *= 2
    rest = width - n
    return np.maximum(x[: len(h)], x[rest : rest + len(h)])


def edges(raw: bytes, reach: int = REACH) -> list[int]:
    """Where the chunks of ``raw`` begin and end, 0 and its length included; no chunk is shorter than ``reach`` unless the text is."""
    data, found, n = np.frombuffer(raw, np.uint8), [0], len(raw)
    if not n:
        return [0]
    for at in range(0, n, BLOCK):
        a, b = max(0, at - GEAR_WINDOW - reach), min(n, at + BLOCK + reach)
        h = gear(data[a:b])
        top = np.flatnonzero(h == _largest(h, reach)) + a + 1  # the edge follows the byte
        found += top[(top > at) & (top <= min(n, at + BLOCK))].tolist()
    cut = [0]
    for x in found[1:]:
        # Equal hashes nearby, as in one repeated byte, would give short chunks.
        if x - cut[-1] > reach and n - x > reach:
            cut.append(x)
    return [*cut, n]


def chunk_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", reach: int = REACH) -> DataFrame:
    """(id, key, pos, size, d1, d2) for every chunk of every whole text; null and empty texts have none.

    The key, a hash of the whole text, tells texts of one id apart.
    """
    schema = "id long, key long, pos int, size int, d1 long, d2 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, keys, counts, places, sizes, digests = [], [], [], [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode("utf-8", "replace")
                ends = edges(raw, reach)
                ids.append(k)
                keys.append(text_key(raw))
                counts.append(len(ends) - 1)
                places += ends[:-1]
                sizes += [b - a for a, b in zip(ends, ends[1:])]
                digests += [digest(raw[a:b]) for a, b in zip(ends, ends[1:])]
            two = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            owners = np.repeat(np.array([x if x is not None else 0 for x in ids], np.int64), counts)
            none = np.repeat(np.array([x is None for x in ids], bool), counts)
            columns = [pa.array(owners, mask=none), pa.array(np.repeat(np.array(keys, np.int64), counts)), pa.array(places, pa.int32()), pa.array(sizes, pa.int32()), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "pos", "size", "d1", "d2"])

    return docs.select(F.col(id_column).cast("long"), text_of(text_column)).mapInArrow(cut, schema)


def text_key(raw: bytes) -> int:
    """The hash of a text that Spark's xxhash64 gives too."""
    return int(np.uint64(xxhash.xxh64_intdigest(raw, 42)).astype(np.int64))


def repeated_chunks(chunks: DataFrame) -> DataFrame:
    """(id, key, pos, size) of every chunk that an earlier one equals.

    Earlier is a smaller id, then a smaller key, then a smaller place.  Digests
    are counted on the map side first.  Those that repeat are written, so that
    the join back meets plain shuffles, of which Spark can split a large key.
    """
    first = chunks.groupBy("d1", "d2").agg(F.min(F.struct("id", "key", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").select("d1", "d2", "first")
    first = materialize(first, "digests")
    found = chunks.join(first, ["d1", "d2"])
    return found.where(F.struct("id", "key", "pos") > F.col("first")).select("id", "key", "pos", "size")


def cut_text(text: str, places, least: int = LEAST_RUN) -> tuple[bytes, int, int]:
    """What is left of a text without runs of repeated chunks, bytes removed and runs removed.

    ``places`` are (pos, size) of repeated chunks.  A whole document goes
    whatever its size.  Cut characters lose all their bytes, so what is left is text.
    """
    raw = text.encode("utf-8", "replace")
    runs: list[list[int]] = []
    for pos, size in sorted(places):
        if runs and runs[-1][1] == pos:
            runs[-1][1] = pos + size
        else:
            runs.append([pos, pos + size])
    kept, at, removed, n = [], 0, 0, 0
    for a, b in runs:
        if b - a < least and b - a < len(raw):
            continue
        while a and raw[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(raw) and raw[b] & 0xC0 == 0x80:
            b += 1
        a = max(a, at)
        if b > a:
            kept.append(raw[at:a])
            at, removed, n = b, removed + b - a, n + 1
    kept.append(raw[at:])
    return b"".join(kept), removed, n


_CUT = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def _cut_rows(docs: DataFrame, id_column: str, text_column: str, reach: int, least: int) -> DataFrame:
    """(row, cut): every row, and its text without repeats (kept) with the figures of the cut."""
    chunks = chunk_rows(docs.where(F.col(id_column).isNotNull()), id_column, text_column, reach)
    spans = repeated_chunks(chunks).groupBy(F.col("id").alias("owner"), F.col("key").alias("owner_key")).agg(F.collect_set(F.struct("pos", "size")).alias("found"))

    @F.pandas_udf("kept string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            rows = []
            for text, some in zip(texts, found):
                raw, removed, n = cut_text(text or "", [] if some is None else [(x["pos"], x["size"]) for x in some], least)
                kept = None if text is None else raw.decode("utf-8", "replace")
                rows.append((kept, len(raw) + removed, removed, n, hashlib.sha256(raw).hexdigest()))
            yield pd.DataFrame(rows, columns=["kept", *_CUT])

    rows = packed(docs, id=F.col(id_column).cast("long"), key=F.xxhash64(text_of(text_column)))
    joined = rows.join(spans, (F.col("id") == F.col("owner")) & (F.col("key") == F.col("owner_key")), "left")
    return joined.select("row", cut(F.col("row").getField(text_column), F.col("found")).alias("cut"))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", reach: int = REACH, least: int = LEAST_RUN) -> DataFrame:
    """``docs`` with the text cut, and n_bytes, n_removed, n_spans and kept_sha256 beside it.

    A document that is all repeats keeps its row with the empty text.  Null
    texts count as empty and stay null.  Rows without an id neither remove nor
    are removed.  Texts that share an id are documents of their own, in the
    order of a hash of theirs; rows that repeat as a whole are cut alike, as one
    document.  Columns of those names are replaced; an empty table gives no rows.
    """
    done = _cut_rows(docs, id_column, text_column, reach, least)
    return unpacked(done, docs.columns, **{text_column: F.col("cut.kept")}, **{c: F.col(f"cut.{c}") for c in _CUT})


def op1_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the text that is left for every document."""
    return remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("text", F.lit("")).alias("text"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their repeated passages cut, with their own columns; n_chars, where there is one, is counted anew.

    Nulls, repeated ids and empty tables: see ``remove_repeats``.  No row is lost.
    """
    done = _cut_rows(docs, "doc_id", "text", REACH, LEAST_RUN)
    text = F.col("cut.kept")
    return unpacked(done, docs.columns, text=text, **({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {}))
