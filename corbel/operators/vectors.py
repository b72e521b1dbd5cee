"""Text vectors: encoding in batches and exact search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corbel.functions.ranking import dot, squared_distance, unit
from corbel.operators.ordered import top_rows

Encoder = Callable[[list[str]], np.ndarray]

#: Queries that an exact search takes at once: this bounds what is broadcast.
QUERIES = 10_000
#: Rows and queries whose scores a task holds at once: this bounds its memory whatever the batches are.
ROWS_AT_ONCE, QUERIES_AT_ONCE = 1_024, 512


def hashing_encoder(dims: int = 64) -> Encoder:
    """A deterministic encoder: signed hashed words, as long as no model is given."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2s(word.encode(), digest_size=8).digest(), "little")
                row[h % dims] += 1 if h >> 63 else -1
        return out

    return encode


def embedding_text(section: Column, title: Column, text: Column) -> Column:
    """What is encoded of a record: its section, its title and its text on lines of their own."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws("\n", F.concat(F.lit("[section:"), full(section), F.lit("]")), full(title), full(text))


def encode(df: DataFrame, text: str, encoder: Encoder, batch: int = 256, normalize: bool = True, column: str = "vec") -> DataFrame:
    """``df`` with the vectors of its texts; null texts are encoded as empty ones."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{column}` array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                vectors = encoder([t or "" for t in part[text]]).astype(np.float32)
                yield part.assign(**{column: list(vectors)})

    out = df.mapInPandas(run, schema)
    return out.withColumn(column, unit(column)) if normalize else out


def query_blocks(queries: DataFrame) -> list[DataFrame]:
    """The queries (query_id, qvec) in blocks of about QUERIES at most."""
    asked = queries.select("query_id", "qvec")
    if asked.limit(QUERIES + 1).count() <= QUERIES:
        return [asked]
    n = asked.count() // QUERIES + 2  # hashed blocks are uneven
    return [asked.where(F.pmod(F.xxhash64("query_id", "qvec"), F.lit(n)) == k) for k in range(n)]


def every_block(blocks: list[DataFrame]) -> DataFrame:
    out = blocks[0]
    for more in blocks[1:]:
        out = out.unionByName(more)
    return out


def search(queries: DataFrame, rows: DataFrame, top: int = 5, metric: str = "ip") -> DataFrame:
    """Exact neighbours: query_id, row_id, rank and score of the best rows of every query.

    ``queries`` has query_id and qvec, which go to every task, QUERIES rows at a
    time; more of them take a pass over the rows for each such block.  ``rows``
    has row_id and vec and is never shuffled: each task keeps its own best, and
    only those meet.  Scores are inner products, or squared distances with
    ``metric='l2'``, in double precision.
    """
    found = every_block([_search_block(block, rows, top, metric) for block in query_blocks(queries)])
    return top_rows(found, ["query_id"], [F.desc("score") if metric == "ip" else F.asc("score"), F.asc("row_id")], top, "rank")


def _search_block(queries: DataFrame, rows: DataFrame, top: int, metric: str) -> DataFrame:
    """query_id, row_id and score: each task's best rows of every query of one block."""
    asked = queries.collect()
    ids = [r["query_id"] for r in asked]
    kind = queries.schema["query_id"].dataType.simpleString(), rows.schema["row_id"].dataType.simpleString()
    shared = queries.sparkSession.sparkContext.broadcast(np.array([r["qvec"] for r in asked], float).reshape(len(asked), -1))

    def best(scores: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``top`` best of each query's rows, ties to the smaller row."""
        if scores.shape[1] <= top:
            return scores, held
        least = -np.partition(-scores, top - 1, axis=1)[:, top - 1 : top]
        keep = np.array([sorted(np.flatnonzero(s >= x), key=lambda j: (-s[j], h[j]))[:top] for s, h, x in zip(scores, held, least)])
        return np.take_along_axis(scores, keep, 1), np.take_along_axis(held, keep, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, found = shared.value, {}
        for b in batches:
            for at in range(0, len(b), ROWS_AT_ONCE):
                part = b.iloc[at : at + ROWS_AT_ONCE]
                v, order = np.array([np.asarray(x, float) for x in part["vec"]]), part["row_id"].to_numpy()
                for of in range(0, len(q), QUERIES_AT_ONCE):
                    some = q[of : of + QUERIES_AT_ONCE]
                    now = some @ v.T if metric == "ip" else -((some**2).sum(1)[:, None] + (v**2).sum(1) - 2 * some @ v.T)
                    now, rows_now = best(now, np.broadcast_to(order, now.shape))
                    if of in found:
                        now, rows_now = best(np.concatenate([found[of][0], now], axis=1), np.concatenate([found[of][1], rows_now], axis=1))
                    found[of] = now, rows_now
        for of, (scores, held) in found.items():
            n = scores.shape[1]
            yield pd.DataFrame({"query_id": [i for i in ids[of : of + QUERIES_AT_ONCE] for _ in range(n)], "row_id": held.ravel().tolist(), "score": (scores if metric == "ip" else -scores).ravel()})

    return rows.select("row_id", "vec").mapInPandas(run, f"query_id {kind[0]}, row_id {kind[1]}, score double")


def search_by_expression(queries: DataFrame, rows: DataFrame, top: int = 5, metric: str = "ip") -> DataFrame:
    """The same in expressions only, for a few queries: a join with a broadcast side for each block, then the best per query."""
    score = dot("qvec", "vec") if metric == "ip" else squared_distance("qvec", "vec")
    pairs = every_block([rows.select("row_id", "vec").join(F.broadcast(block), F.size("vec") == F.size("qvec")) for block in query_blocks(queries)])
    return top_rows(pairs.select("query_id", "row_id", score.alias("score")), ["query_id"], [F.desc("score") if metric == "ip" else F.asc("score"), F.asc("row_id")], top, "rank")


def with_meta(hits: DataFrame, meta: DataFrame) -> DataFrame:
    """Hits with the metadata of their rows, by ordinal."""
    return hits.join(meta, "row_id")
