"""Vector code compression: product codes from integer codebooks.

Components become integers, so that every distance, sum and mean is exact and
reruns agree to the bit.  The codebooks, a few hundred numbers, go to the tasks
with the function.  A task meets its rows in Arrow batches: all distances of a
batch come from the norm expansion |x|^2 - 2xc + |c|^2 and one int64 matrix
product a part.  Each task sums what its entries got, and one grouped shuffle a
round merges these sums; the driver sees one row for each entry and position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corbel.llm.common import discard, materialize, own

#: Parts of a vector, entries of a part's codebook, rounds, and what a component is multiplied by before it is rounded down.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers are held within this, beyond which squared distances of a vector could leave 64 bits.
MOST = 1 << 27


def _usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(whole, F.lit(False))


def _integers(vector: Column, width: Column, scale: int) -> Column:
    """The components times ``scale``, rounded down, and zeros up to ``width``."""
    held = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(float(-MOST))), F.lit(float(MOST)))).cast("int")
    return F.concat(F.transform(vector, held), F.array_repeat(F.lit(0), width - F.size(vector)))


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of int64 rows (row, part, position): the first nearest entry of each part, and its squared distance."""
    index, error = np.empty(x.shape[:2], np.int64), np.empty(x.shape[:2], np.int64)
    for part in range(books.shape[0]):
        rows, book = x[:, part, :], books[part]
        far = (rows * rows).sum(1)[:, None] - 2 * (rows @ book.T) + (book * book).sum(1)
        index[:, part] = far.argmin(1)
        error[:, part] = np.take_along_axis(far, index[:, part, None], 1)[:, 0]
    return index, error


def _matrix(batch: pa.RecordBatch, books: np.ndarray) -> np.ndarray:
    flat = batch.column("numbers").flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(batch.num_rows, books.shape[0], books.shape[2])


def _sums(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What each entry of each part got from a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, wide = books.shape
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _matrix(batch, books)
            index, _ = nearest(x, books)
            for part in range(parts):
                np.add.at(total[part], index[:, part], x[:, part, :])
                count[part] += np.bincount(index[:, part], minlength=entries)
        part, entry = np.nonzero(count)
        if len(part):
            sums = pa.array(list(total[part, entry]), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), sums], ["part", "entry", "n", "sums"])

    return run


def _coded(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, error = nearest(_matrix(batch, books), books)
            code = [row.tobytes().hex() for row in index.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error.sum(1))], ["id", "label", "code", "error"])

    return run


def _first_books(kept: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the rows of the smallest ids; fewer rows give fewer entries."""
    rows = kept.orderBy(F.asc_nulls_last("id"), "numbers").limit(entries).select("numbers").collect()
    wide = len(rows[0]["numbers"]) // parts if rows else 1
    return np.array([r["numbers"] for r in rows], np.int64).reshape(len(rows), parts, wide).transpose(1, 0, 2).copy()


def _next_books(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry becomes the mean, rounded down, of the parts that chose it; an unused one stays."""
    got = kept.select("numbers").mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
    per = got.select("part", "entry", "n", F.posexplode("sums").alias("pos", "value")).groupBy("part", "entry", "pos")
    # Decimals, as the sums of very many rows may leave 64 bits.
    merged = per.agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    after = books.copy()
    for row in merged:
        after[row["part"], row["entry"], row["pos"]] = int(row["value"]) // row["n"]
    return after


def fit_books(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, position) of rows of (id, numbers), int64; one pass over the rows a round."""
    books = _first_books(kept, parts, entries)
    if books.shape[1]:
        for _ in range(rounds):
            books = _next_books(kept, books)
    return books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all numbers as decimal text, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) for every usable vector, and the codebooks.

    A code has two hexadecimal digits a part, so ``entries`` is 256 at most.
    Vectors that are null or hold null or non-finite components are dropped.
    The first entries come from the smallest ids: of equal ids the smaller
    vector comes first, null ids come last and are coded like any other; with
    fewer rows than entries there are fewer entries.  Vectors of another length
    than the longest, or of one that ``parts`` doesn't divide, count as if
    zeros followed.  Components beyond 32,768 (2^27 after scaling) count as
    that.  Other columns, whatever their names, are left out; an empty table
    gives no rows and empty codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    rows = vectors.select(own(id_column).alias("id"), own(label_column).alias("label"), own(vector_column).cast("array<double>").alias("v")).where(_usable(F.col("v")))
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    wide = F.lit(max(1, -(-longest // parts)) * parts)
    kept = materialize(rows.select("id", "label", _integers(F.col("v"), wide, scale).alias("numbers")), "integers")
    books = fit_books(kept, parts, entries, rounds)
    schema = kept.select("id", "label").schema.add("code", "string").add("error", "long")
    if not books.shape[1]:
        return kept.sparkSession.createDataFrame([], schema), books
    coded = materialize(kept.mapInArrow(_coded(books), schema), "codes")
    discard(kept)
    return coded, books


def op11_codes(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for every usable vector.

    label_error sums the errors of all vectors of a label, null labels
    together; it is null where that sum leaves 64 bits.  Nulls, repeated ids,
    lengths and empty tables: see ``compress``.
    """
    coded, books = compress(embeddings)
    per = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    found = coded.join(per, F.col("label").eqNullSafe(F.col("of")))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
