"""Exact removal of repeated byte strings by merging Burrows-Wheeler transforms.

Every string of ``width`` bytes belongs to the smallest hash of a short gram
inside it, its anchor, so equal strings meet wherever they stand.  A first pass
finds the anchors of more than one document.  Then each task (a shard) cuts its
documents into fragments, runs of strings with one such anchor, settles the
fragments that it holds more than once by itself, and sends one copy of each to
the bucket of its anchor.  A bucket settles equal fragments, and for anchors
with differing fragments builds the transform of each shard's fragments and
merges them: an interleave of the shards is refined symbol by symbol, which
yields common prefixes and, after ``width`` rounds, the intervals of equal
strings, without sorting the suffixes of different shards together.  Anchors of
very many fragments, as a line that stands in every document among ever other
words has, are split: their strings go to buckets by digests of their own.
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

from corbel.llm.common import text_of

#: Length of the strings that are looked for, and of the grams that anchor them.
WIDTH, GRAM = 50, 16
#: Bytes that are hashed at once, that a shard gathers, and that a bucket holds on the average.
BLOCK, SHARD, BUCKET = 1 << 15, 16 << 20, 3 << 20
#: Fragments of one anchor that a bucket may get, estimated from one document in so many; the bound rises with the bytes of a
#: table beyond 2^40, so that there are never more than about a million split anchors, which every task is told.
CROWD, SAMPLED = 1 << 16, 16
#: Strings of a fragment at most; a longer run is cut, which changes no result.
RUN = 256

_SEED = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS = {n: np.uint64(pow(_BASE, n, 1 << 64)) for n in (1, 2, 4, 8)}


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes that end at each place."""
    h = _SEED[data]
    for n in (1, 2, 4, 8):
        h[n:] = h[n:] + h[:-n] * _POWERS[n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """The minimum of the ``span`` hashes that end at each place."""
    n = 1
    while 2 * n <= span:
        h[n:] = np.minimum(h[n:], h[:-n])
        n *= 2
    rest = span - n
    if rest:
        h[rest:] = np.minimum(h[rest:], h[:-rest])
    return h


def fragments(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, first start, strings, anchor) of the runs of strings with one anchor, in all of some texts."""
    sizes = np.array([len(r) for r in raws])
    data = np.frombuffer(b"".join(raws), np.uint8)
    if len(data) < WIDTH:
        return (np.zeros(0, int),) * 3 + (np.zeros(0, np.uint64),)
    least = _least(_grams(data), WIDTH - GRAM + 1)
    begin = np.concatenate([[0], sizes.cumsum()])
    # A string is known by its last byte; those with WIDTH bytes of their own text count.
    ok = np.ones(len(data), bool)
    for k in range(WIDTH - 1):
        at = begin[:-1] + k
        ok[at[at < begin[1:]]] = False
    last = np.flatnonzero(ok)
    if not len(last):
        return (np.zeros(0, int),) * 3 + (np.zeros(0, np.uint64),)
    value = least[last]
    text = np.repeat(np.arange(len(raws)), np.maximum(sizes - WIDTH + 1, 0))
    new = np.ones(len(last), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(last)))
    if count.max() > RUN:
        pieces = -(-count // RUN)
        offset = np.concatenate([np.arange(p) for p in pieces]) * RUN
        start, count = np.repeat(start, pieces) + offset, np.minimum(np.repeat(count, pieces) - offset, RUN)
    return text[start], last[start] - begin[text[start]] - WIDTH + 1, count, value[start]


def _joined(owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of each owner as one."""
    order = np.lexsort((a, owner))
    owner, a, b = owner[order], a[order], b[order]
    # Spans of one owner sorted by start: ends only grow once they are made cumulative.
    shift = owner.astype(np.int64) << 33 if len(owner) and owner.max() < 1 << 30 else None
    assert shift is not None or not len(owner)
    if not len(owner):
        return owner, a, b
    reach = np.maximum.accumulate(b + shift)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    ends = np.append(first[1:], len(a)) - 1
    return owner[first], a[first], (reach[ends] - shift[ends]).astype(a.dtype)


class Transform:
    """The Burrows-Wheeler transform of some strings, each with an end mark, and the places behind its rows."""

    def __init__(self, strings: list[bytes], depth: int = WIDTH):
        self.offsets = np.concatenate([[0], np.cumsum([len(s) + 1 for s in strings])])
        text = np.zeros(self.offsets[-1], np.uint16)
        flat = np.frombuffer(b"".join(strings), np.uint8)
        inside = np.ones(len(text), bool)
        inside[self.offsets[1:] - 1] = False
        text[inside] = flat.astype(np.uint16) + 1
        before = np.arange(len(text)) - 1
        before[self.offsets[:-1]] = self.offsets[1:] - 1  # each string is a circle
        previous = text[before]
        # Suffixes by ever longer prefixes: sort by the symbol before, then step back onto it.
        rows = np.arange(len(text))
        for _ in range(depth):
            rows = before[rows[np.argsort(previous[rows], kind="stable")]]
        self.rows, self.symbols = rows, previous[rows]


def merge(shards: list[Transform], depth: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, row, prefix) of the merged transform: which shard's which row, and the common prefix with the row above, up to ``depth``.

    The interleave starts as one shard after the other.  Each round spreads the
    shards' symbols over it and sorts it stably by them, which is the interleave
    by prefixes one longer; a slot's first difference gives its common prefix.
    """
    z = np.concatenate([np.full(len(s.symbols), k, np.uint8) for k, s in enumerate(shards)])
    prefix = np.full(len(z), depth, np.int16)
    prefix[:1] = 0
    block = np.zeros(len(z), np.int32)
    symbols = np.zeros(len(z), np.uint16)
    for k in range(depth):
        for i, s in enumerate(shards):
            symbols[z == i] = s.symbols
        order = np.argsort(symbols, kind="stable")
        z, sorted_, block = z[order], symbols[order], block[order]
        edge = (sorted_[1:] != sorted_[:-1]) | (block[1:] != block[:-1])
        fresh = np.flatnonzero(edge & (prefix[1:] == depth)) + 1
        prefix[fresh] = k
        block[0] = 0
        np.cumsum(edge, out=block[1:])
        if edge.all():
            break
    row = np.zeros(len(z), np.int64)
    for i in range(len(shards)):
        row[z == i] = np.arange((z == i).sum())
    return z, row, prefix


def least_owner(groups: list[tuple[list[bytes], np.ndarray]], width: int = WIDTH) -> list[list[np.ndarray]]:
    """For each shard's (strings, owners): for each string, the least owner of every ``width`` bytes at each start."""
    shards = [Transform(s, width) for s, _ in groups]
    z, row, prefix = merge(shards, width)
    interval = np.cumsum(prefix < width) - 1
    owner = np.zeros(len(z), np.int64)
    starts = np.zeros(len(z), bool)
    where = []
    for i, (s, (_, owners)) in enumerate(zip(shards, groups)):
        here = np.flatnonzero(z == i)
        place = s.rows[row[here]]
        string = np.searchsorted(s.offsets, place, side="right") - 1
        owner[here] = owners[string]
        starts[here] = place + width <= s.offsets[string + 1] - 1
        where.append((here, place))
    least = np.full(interval[-1] + 1 if len(interval) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, interval[starts], owner[starts])
    out = []
    for (here, place), s in zip(where, shards):
        found = np.zeros(s.offsets[-1], np.int64)
        found[place] = least[interval[here]]
        out.append([found[a : max(a, b - width)] for a, b in zip(s.offsets[:-1], s.offsets[1:])])
    return out


_ROW = np.dtype([("anchor", "<u4"), ("id", "<i8"), ("key", "<u4"), ("at", "<i4"), ("n", "<i2")])
_OUT = "bucket int, shard long, payload binary, id long, key long, a int, b int"
_TAGS = "bucket int, payload binary, id long, tags binary"


def _spans(bucket, ids, keys, a, b) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["bucket", "shard", "payload", "id", "key", "a", "b"])


def _string_spans(rows: np.ndarray, buckets: int = 1) -> pa.RecordBatch:
    """The spans of strings, joined within each text."""
    docs, back = np.unique(rows[["id", "key"]], return_inverse=True)
    start = rows["at"].astype(np.int64)
    d, a, b = _joined(back, start, start + WIDTH)
    return _spans(np.abs(docs["id"][d] % buckets), docs["id"][d], docs["key"][d].astype(np.int64), a, b)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, all first bytes first: like bytes stand together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplaned(raw: bytes, kind: np.dtype, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()


def _tagged(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each anchor in the upper half, 32 of its other bits in the lower."""
    b = np.uint64(buckets)
    return ((anchor % b) << np.uint64(32) | (anchor // b & np.uint64(0xFFFFFFFF))).astype(np.int64)


def _cuts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the length."""
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]])


def _tag_rows(bucket, ids: np.ndarray, tags: np.ndarray) -> pa.RecordBatch:
    """One row for each id with its tags."""
    order = np.argsort(ids, kind="stable")
    ids, tags = ids[order], tags[order]
    cut = _cuts(ids)
    packed = [tags[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])]
    heads = ids[cut[:-1]]
    return pa.RecordBatch.from_arrays([pa.array(np.abs(heads) % bucket, pa.int32()), pa.nulls(len(heads), pa.binary()), pa.array(heads), pa.array(packed, pa.binary())], names=["bucket", "payload", "id", "tags"])


def _single_tags(ids: np.ndarray, tags: np.ndarray) -> pa.RecordBatch:
    """One row for each tag: their number follows the input, which rows by task and id would not."""
    n = len(ids)
    plain = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(tags))])
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(ids), plain], names=["bucket", "payload", "id", "tags"])


def _anchored(batches: Iterator[pa.RecordBatch]):
    """Shards of (ids, texts, fragments) of a stream of (id, text, ...), and the further columns of each shard's rows."""
    ids, texts, more, parts, block = [], [], [], [], []
    total = block_size = 0

    def hash_block():
        base = len(texts) - len(block)
        text, at, n, anchor = fragments(block)
        parts.append((text + base, at, n, anchor))
        block.clear()

    for batch in batches:
        rest = [c.to_pylist() for c in batch.columns[2:]]
        for k, (i, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            raw = text.encode("utf-8", "replace")
            ids.append(i)
            texts.append(raw)
            more.append([c[k] for c in rest])
            block.append(raw)
            block_size += len(raw)
            total += len(raw)
            if block_size >= BLOCK or total >= SHARD:
                hash_block()
                block_size = 0
            if total >= SHARD:
                yield ids, texts, more, tuple(np.concatenate(x) for x in zip(*parts))
                ids, texts, more, parts, total = [], [], [], [], 0
    if block:
        hash_block()
    if parts:
        yield ids, texts, more, tuple(np.concatenate(x) for x in zip(*parts))


def _anchor_rows(buckets: int):
    """Over (id, text): the anchors that a shard knows to be shared by id, and one entry of each anchor for its bucket."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, _, (doc, _, _, anchor) in _anchored(batches):
            if not len(doc):
                continue
            tag, owner = _tagged(anchor, buckets), np.array(ids, np.int64)[doc]
            order = np.lexsort((owner, tag))
            tag, owner = tag[order], owner[order]
            keep = np.ones(len(tag), bool)
            keep[1:] = (tag[1:] != tag[:-1]) | (owner[1:] != owner[:-1])
            tag, owner = tag[keep], owner[keep]
            cut = _cuts(tag)
            several = np.diff(cut) > 1
            shared = np.repeat(several, np.diff(cut))
            if shared.any():
                yield _tag_rows(buckets, owner[shared], tag[shared])
            tag, owner = tag[cut[:-1]], owner[cut[:-1]]
            # Owners by their place among the ids; anchors that are known to be shared need no answer and have 0.
            several = several.astype(bool)
            bucket = (tag >> 32).astype(np.int64)
            at = _cuts(bucket)
            payloads = []
            for i, j in zip(at[:-1], at[1:]):
                low = (tag[i:j] & 0xFFFFFFFF).astype(np.uint32)
                low[1:] = low[1:] - low[:-1]  # sorted, so differences are small
                known, code = np.unique(owner[i:j][~several[i:j]], return_inverse=True)
                place = np.zeros(j - i, np.uint32)
                place[~several[i:j]] = code + 1
                payloads.append(np.array([j - i, len(known)], np.int64).tobytes() + zlib.compress(_planes(low) + _planes(place) + known.tobytes(), 1))
            m = len(payloads)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]], pa.int32()), pa.array(payloads, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], names=["bucket", "payload", "id", "tags"])

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch], payload: int):
    """(bucket, rows) of a stream sorted by bucket; rows without a payload come as (None, batch)."""
    last, held = None, []
    for batch in batches:
        plain = batch.filter(pa.compute.is_null(batch.column(payload)))
        if plain.num_rows:
            yield None, plain
        some = batch.filter(pa.compute.is_valid(batch.column(payload)))
        for row in zip(*(c.to_pylist() for c in some.columns)):
            if row[0] != last and held:
                yield last, held
                held = []
            last = row[0]
            held.append(row)
    if held:
        yield last, held


def _shared_anchors(buckets: int):
    """Over entries sorted by bucket: the anchors of more than one document, by id."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tags, size = [], [], 0
        for bucket, rows in _by_bucket(batches, 1):
            if bucket is None:
                yield rows
                continue
            low, owner, known = [], [], []
            for _, payload, _, _ in rows:
                n, m = np.frombuffer(payload[:16], np.int64)
                plain = zlib.decompress(payload[16:])
                low.append(np.cumsum(_unplaned(plain[: 4 * n], np.dtype("<u4"), n), dtype=np.uint32))
                place = _unplaned(plain[4 * n : 8 * n], np.dtype("<u4"), n).astype(np.int64)
                ids_of = np.frombuffer(plain[8 * n :], np.int64)
                known.append(place == 0)
                owner.append(np.concatenate([[0], ids_of])[place])
            low, owner, known = np.concatenate(low), np.concatenate(owner), np.concatenate(known)
            order = np.argsort(low, kind="stable")
            low, owner, known = low[order], owner[order], known[order]
            at = _cuts(low)
            # More than one owner, or a shard that told so.
            first = np.repeat(owner[at[:-1]], np.diff(at))
            shared = np.logical_or.reduceat(known | (owner != first), at[:-1])
            goes = np.repeat(shared, np.diff(at)) & ~known
            ids.append(owner[goes])
            tags.append(low[goes].astype(np.int64) | np.int64(bucket) << 32)
            size += len(ids[-1])
            if size > 1 << 18:
                yield _single_tags(np.concatenate(ids), np.concatenate(tags))
                ids, tags, size = [], [], 0
        if size:
            yield _single_tags(np.concatenate(ids), np.concatenate(tags))

    return run


def _counted_anchors(buckets: int):
    """Over (id, text): how many differing fragments of each anchor a shard has, about: those whose first and last grams differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, _, (doc, at, n, anchor) in _anchored(batches):
            if not len(doc):
                continue
            ends = [hash((texts[d][a : a + GRAM], texts[d][a + k + WIDTH - 1 - GRAM : a + k + WIDTH - 1])) for d, a, k in zip(doc.tolist(), at.tolist(), n.tolist())]
            pairs = np.unique(np.stack([_tagged(anchor, buckets), np.array(ends, np.int64)], axis=1), axis=0)
            tags, counts = np.unique(pairs[:, 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tags), pa.array(counts.astype(np.int64))], names=["tag", "n"])

    return run


def crowded_anchors(plain: DataFrame, buckets: int, total: int, crowd: int = CROWD) -> np.ndarray:
    """The tags of anchors of very many fragments, sorted; told from one document in SAMPLED, as it bears on the split only."""
    some = plain.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0) if crowd >= SAMPLED else plain
    least = max(crowd, total >> 24) / (SAMPLED if crowd >= SAMPLED else 1)
    found = some.mapInArrow(_counted_anchors(buckets), "tag long, n long").groupBy("tag").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    return np.sort(np.array([r["tag"] for r in found.select("tag").collect()], np.int64))


_STRING = np.dtype([("d1", "<i8"), ("d2", "<i8"), ("id", "<i8"), ("key", "<u4"), ("at", "<i4")])


def _least_first(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings in the order of digest and id, and whether a smaller id has the same."""
    rows = rows[np.lexsort((rows["at"], rows["id"], rows["d2"], rows["d1"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["d1"][1:] != rows["d1"][:-1]) | (rows["d2"][1:] != rows["d2"][:-1])
    first = rows["id"][np.flatnonzero(new)[np.cumsum(new) - 1]]
    return rows, rows["id"] > first


def _shard(buckets: int, crowded):
    """Over (id, text, shared anchors): spans that a shard settles by itself, and its fragments by bucket.

    Strings of crowded anchors go to buckets below zero, by their digest.
    """
    import zlib

    digest = xxhash.xxh3_128_digest

    def apart(texts, id_of, key_of, doc, at, n) -> Iterator[pa.RecordBatch]:
        """The strings of crowded anchors, those that a smaller id of the shard has as spans."""
        owner = np.repeat(doc, n)
        start = np.repeat(at - (n.cumsum() - n), n) + np.arange(n.sum())
        two = np.frombuffer(b"".join(digest(texts[d][a : a + WIDTH]) for d, a in zip(owner.tolist(), start.tolist())), np.int64).reshape(-1, 2)
        rows = np.zeros(len(owner), _STRING)
        rows["d1"], rows["d2"], rows["id"], rows["key"], rows["at"] = two[:, 0], two[:, 1], id_of[owner], key_of[owner], start
        rows, later = _least_first(rows)
        if later.any():
            yield _string_spans(rows[later], buckets)
        rows = rows[~later]
        goes = rows["d1"] % buckets
        rows, goes = rows[np.argsort(goes, kind="stable")], np.sort(goes)
        cut = _cuts(goes)
        m = len(cut) - 1
        payloads = [zlib.compress(rows[i:j].tobytes(), 1) for i, j in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(-1 - goes[cut[:-1]], pa.int32()), pa.nulls(m, pa.int64()), pa.array(payloads, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32())], names=["bucket", "shard", "payload", "id", "key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, more, (doc, at, n, anchor) in _anchored(batches):
            wanted = np.frombuffer(b"".join(t for (tags,) in more for t in tags or ()), np.int64)
            some = np.isin(_tagged(anchor, buckets), wanted)
            id_of, key_of = np.array(ids, np.int64), np.array([xxhash.xxh32_intdigest(t) for t in texts], np.int64)
            hot = some & np.isin(_tagged(anchor, buckets), crowded.value)
            if hot.any():
                yield from apart(texts, id_of, key_of, doc[hot], at[hot], n[hot])
                some &= ~hot
            doc, at, n, anchor = doc[some], at[some], n[some], anchor[some]
            if not len(doc):
                continue
            bodies = [texts[d][a : a + k] for d, a, k in zip(doc.tolist(), at.tolist(), (n + WIDTH - 1).tolist())]
            two = np.frombuffer(b"".join(map(digest, bodies)), np.int64).reshape(-1, 2)
            order = np.lexsort((at, id_of[doc], two[:, 1], two[:, 0]))
            s = two[order]
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]).any(1)
            owner = id_of[doc[order]]
            later = owner > owner[np.flatnonzero(new)[np.cumsum(new) - 1]]
            if later.any():
                row = order[later]
                d, a, b = _joined(doc[row], at[row], at[row] + n[row] + WIDTH - 1)
                yield _spans(np.abs(id_of[d]) % buckets, id_of[d], key_of[d], a, b)
            kept = np.sort(order[~later])
            goes = (anchor[kept] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(goes, kind="stable")
            kept, goes = kept[by], goes[by]
            rows = np.zeros(len(kept), _ROW)
            rows["anchor"], rows["id"], rows["key"], rows["at"], rows["n"] = _tagged(anchor[kept], buckets) & 0xFFFFFFFF, id_of[doc[kept]], key_of[doc[kept]], at[kept], n[kept]
            cut = _cuts(goes)
            payloads = []
            for i, j in zip(cut[:-1], cut[1:]):
                cols = b"".join(_planes(np.ascontiguousarray(rows[i:j][c])) for c in _ROW.names)
                payloads.append(np.int64(j - i).tobytes() + zlib.compress(cols + b"".join(bodies[k] for k in kept[i:j].tolist()), 1))
            m = len(payloads)
            shard = int(two[0, 0])
            yield pa.RecordBatch.from_arrays([pa.array(goes[cut[:-1]], pa.int32()), pa.array([shard] * m, pa.int64()), pa.array(payloads, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32())], names=["bucket", "shard", "payload", "id", "key", "a", "b"])

    return run


def settle_bucket(rows: np.ndarray, shard: np.ndarray, body: list[bytes]) -> tuple[np.ndarray, ...]:
    """(row, a, b): the spans of a bucket's fragments that equal strings of smaller ids cover."""
    none = (np.zeros(0, np.int64),) * 3
    two = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, body)), np.int64).reshape(-1, 2)
    order = np.lexsort((rows["id"], two[:, 1], two[:, 0], rows["anchor"]))
    s, two = rows[order], two[order]
    new_anchor = np.ones(len(s), bool)
    new_anchor[1:] = s["anchor"][1:] != s["anchor"][:-1]
    at = np.flatnonzero(new_anchor)
    # Anchors of one document, and rows of it, are through.
    shared = np.repeat(np.minimum.reduceat(s["id"], at) != np.maximum.reduceat(s["id"], at), np.diff(np.append(at, len(s))))
    order, s, two, new_anchor = order[shared], s[shared], two[shared], new_anchor[shared]
    if not len(s):
        return none
    new = new_anchor.copy()
    new[1:] |= (two[1:] != two[:-1]).any(1)
    group = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    owner = s["id"][heads]  # the least id of each distinct fragment
    start, end = s["at"].astype(np.int64), s["at"].astype(np.int64) + s["n"] + WIDTH - 1
    later = s["id"] > owner[group]
    out = [(order[later], start[later], end[later])]
    # Distinct fragments under one anchor may share some of their strings.
    anchor_of = np.cumsum(new_anchor) - 1
    some = np.flatnonzero(np.bincount(anchor_of[heads])[anchor_of[heads]] > 1)
    if len(some):
        part, begin, size, least = _shared_strings([body[k] for k in order[heads[some]]], owner[some], shard[order[heads[some]]])
        counts = size
        flat_owner = np.repeat(owner[some][part], counts)
        hit = np.flatnonzero(least < flat_owner)
        if len(hit):
            which = np.repeat(np.arange(len(part)), counts)
            base = np.repeat(np.concatenate([[0], counts.cumsum()[:-1]]), counts)
            a = begin[which[hit]] + hit - base[hit]
            f, a, b = _joined(some[part[which[hit]]], a, a + WIDTH)
            # The rows of a fragment's least document come first in its group, and each holds these strings.
            own = np.bincount(group[~later], minlength=len(heads))
            times = own[f]
            r = np.repeat(heads[f], times) + np.arange(times.sum()) - np.repeat(times.cumsum() - times, times)
            out.append((order[r], start[r] + np.repeat(a, times), start[r] + np.repeat(b, times)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _shared_strings(bodies: list[bytes], owner: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, ...]:
    """(fragment, first start, strings, least owners): the runs of strings that fragments of several owners hold.

    Strings whose hash no other owner has can't be shared and are left out;
    equal runs go once into the transforms, which decide about the rest.
    """
    sizes = np.array([len(x) for x in bodies])
    ends = sizes.cumsum()
    data = np.frombuffer(b"".join(bodies), np.uint8)
    h = {1: _SEED[data]}
    for n in (1, 2, 4, 8, 16):
        up = h[n].copy()
        up[:-n] = h[n][:-n] * np.uint64(pow(_BASE, n, 1 << 64)) + h[n][n:]
        h[2 * n] = up
    # WIDTH = 32 + 16 + 2
    last = len(data) - WIDTH + 1
    full = (h[32][:last] * np.uint64(pow(_BASE, 16, 1 << 64)) + h[16][32 : 32 + last]) * np.uint64(pow(_BASE, 2, 1 << 64)) + h[2][48 : 48 + last]
    counts = sizes - WIDTH + 1
    of = np.repeat(np.arange(len(bodies)), counts)
    within = np.arange(len(of)) - np.repeat(counts.cumsum() - counts, counts)
    place = (ends - sizes)[of] + within
    by = np.argsort(full[place], kind="stable")
    sorted_, owners = full[place][by], owner[of][by]
    at = _cuts(sorted_)
    several = np.minimum.reduceat(owners, at[:-1]) != np.maximum.reduceat(owners, at[:-1])
    kept = np.zeros(len(of), bool)
    kept[by] = np.repeat(several, np.diff(at))
    none = np.zeros(0, np.int64)
    rows = np.flatnonzero(kept)
    if not len(rows):
        return none, none, none, none
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1] + 1) | (of[rows[1:]] != of[rows[:-1]])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(rows)))
    fragment, begin = of[rows[first]], within[rows[first]]
    texts = [bodies[f][a : a + k + WIDTH - 1] for f, a, k in zip(fragment.tolist(), begin.tolist(), size.tolist())]
    distinct: dict[bytes, int] = {}
    number = np.array([distinct.setdefault(t, len(distinct)) for t in texts])
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, number, owner[fragment])
    place_of = np.zeros(len(distinct), np.int64)
    place_of[number[::-1]] = home[fragment[::-1]]
    parts = np.unique(place_of, return_inverse=True)[1] % 4
    strings = list(distinct)
    sets = [x for k in range(4) if len(x := np.flatnonzero(parts == k))]
    found: list[np.ndarray] = [none] * len(strings)
    for x, some in zip(sets, least_owner([([strings[k] for k in x], least[x]) for x in sets])):
        for k, y in zip(x.tolist(), some):
            found[k] = y
    return fragment, begin, size, np.concatenate([found[k] for k in number.tolist()])


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by bucket: settled spans as they are, and the spans of each bucket."""
    import zlib

    for bucket, found in _by_bucket(batches, 2):
        if bucket is None:
            yield found
            continue
        if bucket < 0:
            strings, later = _least_first(np.concatenate([np.frombuffer(zlib.decompress(payload), _STRING) for _, _, payload, *_ in found]))
            if later.any():
                yield _string_spans(strings[later])
            continue
        rows, shards, body = [], [], []
        for _, shard, payload, *_ in found:
            n = int(np.frombuffer(payload[:8], np.int64)[0])
            plain = zlib.decompress(payload[8:])
            part, at = np.zeros(n, _ROW), 0
            for c in _ROW.names:
                size = n * _ROW[c].itemsize
                part[c] = _unplaned(plain[at : at + size], _ROW[c], n)
                at += size
            ends = at + (part["n"].astype(np.int64) + WIDTH - 1).cumsum()
            body += [plain[a:b] for a, b in zip([at, *ends[:-1].tolist()], ends.tolist())]
            rows.append(part)
            shards.append(np.full(n, shard))
        every = np.concatenate(rows)
        r, a, b = settle_bucket(every, np.concatenate(shards), body)
        if len(r):
            docs, back = np.unique(every[["id", "key"]][r], return_inverse=True)
            d, a, b = _joined(back, a, b)
            yield _spans(np.zeros(len(d)), docs["id"][d], docs["key"][d].astype(np.int64), a, b)


def _by_id(docs: DataFrame, id_column: str, text_column: str, parts: int) -> DataFrame:
    """(id, text) of rows with an id, dealt by id: the one shuffle of the texts, which both joins use."""
    return docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text")).repartition(parts, "id")


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", crowd: int = CROWD) -> DataFrame:
    """(id, key, a, b): spans of bytes that equal strings of WIDTH bytes in smaller ids cover; key tells texts of one id apart.

    Spans may overlap.  Rows without an id neither remove nor are removed.  Any
    64-bit ids will do.  ``crowd``: fragments from which on an anchor is split.
    """
    spark = docs.sparkSession
    plain = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    total = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    buckets = max(32, int(total / BUCKET))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    crowded = spark.sparkContext.broadcast(crowded_anchors(plain, buckets, total, crowd))
    anchors = plain.mapInArrow(_anchor_rows(buckets), _TAGS).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared_anchors(buckets), _TAGS)
    shared = anchors.groupBy(F.col("id").alias("__id")).agg(F.collect_list("tags").alias("tags"))
    dealt = _by_id(docs, id_column, text_column, parts)
    cut = dealt.join(shared, F.col("id") == F.col("__id")).select("id", "text", "tags").mapInArrow(_shard(buckets, crowded), _OUT)
    return cut.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_bucket, _OUT).select("id", "key", "a", "b")


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The bytes outside all spans, how many are inside, and the maximal runs of those."""
    out, at, removed, runs = [], 0, 0, 0
    end = -1
    for a, b in sorted(spans):
        if a > end:
            runs += 1
        if b > end:
            lo = max(a, end, 0)
            out.append(raw[at:lo])
            removed += b - lo
            at = end = b
    out.append(raw[at:])
    return b"".join(out), removed, runs


def remove_repeated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that are left) of every row.

    Null and empty texts have no bytes.
    """
    spans = repeated_spans(docs, id_column, text_column).groupBy("id", "key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    spans = spans.groupBy("id").agg(F.collect_list(F.struct("key", "spans")).alias("__found")).withColumnRenamed("id", "__id")

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            rows = []
            for text, sets in zip(texts, found):
                raw = text.encode("utf-8", "replace")
                spans = []
                if sets is not None:
                    key = xxhash.xxh32_intdigest(raw)
                    spans = [(s["a"], s["b"]) for x in sets if x["key"] == key for s in x["spans"]]
                kept, removed, runs = _kept(raw, spans)
                rows.append((len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = _by_id(docs, id_column, text_column, parts).join(spans, F.col("id") == F.col("__id"), "left")
    nobody = docs.where(F.col(id_column).isNull()).select(F.lit(None).cast("long").alias("id"), text_of(text_column).alias("text"), F.lit(None).cast(spans.schema["__found"].dataType).alias("__found"))
    every = joined.select("id", "text", "__found").unionByName(nobody)
    return every.select("id", cut("text", "__found").alias("x")).select("id", "x.*")


def op2_suffixes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every document."""
    return remove_repeated(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
