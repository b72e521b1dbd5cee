"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are cut into blocks; two that differ in at most ``distance`` bits
agree on all but ``distance`` blocks, so each fingerprint is keyed by every
choice of the others and compared only within equal keys.  A key's
fingerprints arrive sorted, and the comparison emits a spanning forest of the
true links instead of all pairs.  Keys of very many fingerprints are not
compared pairwise: their fingerprints meet at the values halfway between them,
which is exact as well and linear in their number.

``near_duplicates`` links by Hamming distance alone.  ``keep_one``, the stage
of a pipeline, takes such links between four fingerprints of a text's words as
candidates and keeps those whose shingles of five words are alike by 0.8.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corbel.llm.common import materialize, packed, row_hash, text_of, unpacked
from corbel.llm.graph import components

BITS = 64
#: Fingerprints of one key that are compared pairwise, in one task, at most.
PAIRWISE = 4096
#: Independent fingerprints of a text's words, an even number; a near copy is missed if all of its differ in too many bits.
PRINTS = 4
#: Texts and shingles of a part of a candidate chain, on the average at most; a task holds two parts.
MEMBERS, GRAMS = 2000, 1 << 20

_SMALL = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """The unsigned SimHash of a whole text; 0 if it has no words."""
    words = text.encode("utf-8", "replace").translate(_SMALL).split()
    if not words:
        return 0
    line, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if n <= width:
        hashes = np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    else:
        h = xxhash.xxh64_intdigest
        hashes = np.array([h(line[a:b], seed) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64)
    # Bits are summed in slices, so that a very long text needs no more memory.
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 8192):
        part = hashes[k : k + 8192].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, signed 64-bit fingerprint) of every whole text; null texts count as empty."""

    @F.pandas_udf("long")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).astype(np.int64))

    return docs.select(F.col(id_column).alias("id"), made(text_of(text_column)).alias("fp"))


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of every choice of ``blocks - distance`` of nearly equal blocks of 64 bits."""
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among some fingerprints."""
    left, found = values.view(np.uint64), []
    seen = np.zeros(len(left), bool)
    for k in range(len(left)):
        if seen[k]:
            continue
        seen[k] = True
        queue = [k]
        while queue:
            i = queue.pop()
            rest = np.flatnonzero(~seen)
            near = rest[np.bitwise_count(left[rest] ^ left[i]) <= distance]
            seen[near] = True
            found += [(int(values[i]), int(values[j])) for j in near]
            queue += near.tolist()
    return found


def _link_runs(batches: Iterator[pd.DataFrame], distance: int, most: int) -> Iterator[pd.DataFrame]:
    """Links within runs of equal (k, key) of a sorted stream; a run of over ``most`` comes out as (fp, null)."""
    last, kept, hot = None, [], False
    kept_n = 0

    def close() -> list[tuple[int, int | None]]:
        if hot or kept_n < 2:
            return []
        return _forest(np.concatenate(kept), distance)

    for b in batches:
        k, key, fp = b["k"].to_numpy(), b["key"].to_numpy(), b["fp"].to_numpy(np.int64)
        out: list[tuple[int, int | None]] = []
        if len(fp) == 0:
            continue
        cuts = np.flatnonzero((k[1:] != k[:-1]) | (key[1:] != key[:-1])) + 1
        bounds = np.concatenate([[0], cuts, [len(fp)]])
        sizes = np.diff(bounds)
        for r in range(len(sizes)):
            i, j = bounds[r], bounds[r + 1]
            this = (k[i], key[i])
            if this != last:
                out += close()
                last, kept, kept_n, hot = this, [], 0, False
                if sizes[r] == 1 and r + 1 < len(sizes):
                    last = None  # a run of one that ends here links nothing
                    continue
            kept_n += j - i
            if hot:
                out += [(x, None) for x in fp[i:j].tolist()]
            else:
                kept.append(fp[i:j])
                if kept_n > most:
                    out += [(x, None) for c in kept for x in c.tolist()]
                    kept, hot = [], True
        if out:
            yield pd.DataFrame({"u": pd.array([x[0] for x in out], "Int64"), "v": pd.array([x[1] for x in out], "Int64")})
    if out := close():
        yield pd.DataFrame({"u": pd.array([x[0] for x in out], "Int64"), "v": pd.array([x[1] for x in out], "Int64")})


def _star_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Within each run of a sorted stream, a link from each fingerprint to the run's first."""
    last, first = None, 0
    for b in batches:
        u, v = [], []
        for key, fp in zip(b["key"].tolist(), b["fp"].tolist()):
            if key != last:
                last, first = key, fp
            elif fp != first:
                u.append(first)
                v.append(fp)
        yield pd.DataFrame({"u": u, "v": v}, dtype="int64")


def links(distinct: DataFrame, distance: int = 4, blocks: int = 7, pairwise: int = PAIRWISE) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints that span every component of the true links.

    ``distinct`` has a column fp without repeats.  Every emitted pair differs in
    at most ``distance`` bits, and any two fingerprints that do are connected.
    With a column f beside it, only fingerprints of the same f need to be
    connected, and all are found in one pass.
    """
    masks = block_masks(distance, blocks)
    assert len(masks) == comb(blocks, distance)
    keys = F.explode(F.array(*[F.struct(F.lit(k).cast("short").alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)]))
    f = F.col("f") if "f" in distinct.columns else F.lit(0)
    keyed = distinct.select("fp", f.alias("f"), keys.alias("x")).select((F.col("f") * len(masks) + F.col("x.k")).cast("int").alias("k"), "x.key", "fp")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = keyed.repartition(parts, "k", "key").sortWithinPartitions("k", "key").mapInPandas(lambda b: _link_runs(b, distance, pairwise), "u long, v long")
    found = materialize(found, "links")
    hot = found.where("v is null").select(F.col("u").alias("fp")).distinct()
    # Two values at most `distance` apart have one in common at most half of it from either.
    half = distance // 2
    flips = [0] + [_signed(sum(1 << x for x in c)) for n in range(1, half + 1) for c in combinations(range(BITS), n)]
    if distance % 2:
        raise ValueError("the distance must be even")
    met = hot.select("fp", F.explode(F.array(*[F.lit(x) for x in flips])).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("key"), "fp")
    stars = met.repartition(parts, "key").sortWithinPartitions("key", "fp").mapInPandas(_star_runs, "u long, v long")
    return found.where("v is not null").unionByName(stars)


def _classes(prints: DataFrame, distance: int, pairwise: int) -> DataFrame:
    """(fp, root, least) for the distinct fingerprints of ``prints`` (fp, least), root the same for all that links reach."""
    roots = components(links(prints.select("fp"), distance, pairwise=pairwise))
    return materialize(prints.join(roots, prints.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "classes")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", distance: int = 4, pairwise: int = PAIRWISE) -> DataFrame:
    """(id, fp, component): the component is the smallest id that links reach, itself included.

    Rows without an id keep a null component unless others share their
    component.  Repeated ids stay repeated.  An empty table gives no rows.
    """
    made = materialize(fingerprints(docs, id_column, text_column), "fingerprints")
    named = _classes(made.groupBy("fp").agg(F.min("id").alias("least")), distance, pairwise)
    smallest = materialize(named.groupBy("root").agg(F.min("least").alias("component")), "smallest")
    return made.join(named.join(smallest, "root").select("fp", "component"), "fp").select("id", "fp", "component")


def op4_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id for every document."""
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def word_fingerprints(text: str, prints: int = PRINTS) -> list[int]:
    """Independent SimHashes, signed, of a text's words, each with the root of its count; 0 without words.

    Words move less of a fingerprint than shingles when a text is edited, so
    that few bits tell near copies from other texts.
    """
    seen = Counter(text.encode("utf-8", "replace").translate(_SMALL).split())
    if not seen:
        return [0] * prints
    h, seeds = xxhash.xxh3_128_digest, range(prints // 2)
    digests = np.frombuffer(b"".join([h(w, s) for w in seen for s in seeds]), np.uint8).reshape(len(seen), -1)
    weights, total = np.sqrt(np.fromiter(seen.values(), float, len(seen))), np.zeros(BITS * prints)
    for k in range(0, len(weights), 8192):
        total += weights[k : k + 8192] @ np.unpackbits(digests[k : k + 8192], axis=1)
    return np.packbits(2 * total > weights.sum()).view("<i8").tolist()


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; of fewer words the whole, of none the empty set."""
    words = text.encode("utf-8", "replace").translate(_SMALL).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh3_64_intdigest
    return np.unique(np.array([h(b" ".join(words[k : k + width])) for k in range(max(1, len(words) - width + 1))], np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Shared members of two sorted sets, of all; 1 for two empty ones."""
    both = len(a) + len(b)
    if not both:
        return 1.0
    shared = both - len(np.union1d(a, b))
    return shared / (both - shared)


_FPS = [f"fp{k}" for k in range(PRINTS)]


def _candidates(texts: DataFrame, distance: int, pairwise: int) -> DataFrame:
    """(u, v): digests of texts with a fingerprint in common or linked ones, as spanning links; ``texts`` has digest and the fingerprints."""
    stacked = texts.select("digest", F.posexplode(F.array(*_FPS)).alias("f", "fp"))
    first = materialize(stacked.groupBy("f", "fp").agg(F.min("digest").alias("first")), "first")
    # Candidates are verified, so it does no harm if fingerprints of two kinds are equal by chance.
    near = links(first.select("f", "fp"), distance, pairwise=pairwise)
    near = near.join(first.select(F.col("fp").alias("u"), F.col("first").alias("du")), "u").join(first.select(F.col("fp").alias("v"), F.col("first").alias("dv")), "v")
    same = stacked.join(first, ["f", "fp"]).where("digest <> first")
    every = near.where("du <> dv").select("du", "dv").union(same.select(F.col("first").alias("du"), F.col("digest").alias("dv")))
    return materialize(every.select(F.least("du", "dv").alias("u"), F.greatest("du", "dv").alias("v")).distinct(), "candidates")


def _missed(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links (u, v) that join the roots of some texts (digest, root, grams), all texts held against each other."""
    rows = rows.sort_values("digest", ignore_index=True)
    labels, n = pd.factorize(rows["root"])[0], len(rows)
    sizes = np.array([len(x) for x in rows["grams"]], np.int64)
    ends = sizes.cumsum()
    # Of each shingle the texts that have it, one after the other.
    grams = np.unique(np.concatenate([np.asarray(x, np.int64) for x in rows["grams"]]), return_inverse=True)[1] if ends[-1] else np.zeros(0, np.int64)
    owners = np.repeat(np.arange(n), sizes)[np.argsort(grams, kind="stable")]
    starts = np.concatenate([[0], np.bincount(grams).cumsum()]).astype(np.int64)
    found = []
    for k in range(n - 1):
        mine = grams[ends[k] - sizes[k] : ends[k]]
        if not len(mine):
            continue
        shared = np.bincount(np.concatenate([owners[i:j] for i, j in zip(starts[mine].tolist(), starts[mine + 1].tolist())]), minlength=n)
        near = np.flatnonzero((shared >= similarity * (sizes + sizes[k] - shared)) & (labels != labels[k]))
        for j in near[near > k].tolist():
            if labels[j] != labels[k]:
                found.append((k, j))
                labels[labels == labels[j]] = labels[k]
    names = rows["digest"].to_numpy(object)
    return pd.DataFrame({"u": [names[i] for i, _ in found], "v": [names[j] for _, j in found]}, dtype=object)


def _lost(sets: DataFrame, parted: DataFrame, similarity: float) -> DataFrame:
    """(u, v): verified links between texts that candidates connect and verified candidates don't.

    ``parted`` has (digest, reach, root): what candidates and verified ones
    reach from a text, only where the first has several of the second.  All
    texts of one reach are held against each other within a task, which emits
    links that span what it finds.  A reach of many texts or shingles is dealt
    into parts of bounded size on the average, and each two parts are a task.
    """
    held = parted.join(sets, "digest").select("digest", "reach", "root", "grams")
    load = held.groupBy("reach").agg(F.count("*").alias("n"), F.sum(F.size("grams")).alias("total"))
    parts = load.select(F.col("reach").alias("of"), F.greatest(F.ceil(F.col("n") / MEMBERS), F.ceil(F.col("total") / GRAMS), F.lit(1)).cast("int").alias("parts"))
    own = held.join(parts, held["reach"] == parts["of"]).withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("part", k).alias("i"), F.greatest("part", k).alias("j")))
    dealt = own.select("digest", "reach", "root", "grams", F.explode(pairs).alias("p")).select("digest", "reach", "root", "grams", "p.i", "p.j")
    # Dealt anew, as what the join by reach leaves together would be one task.
    count = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(count, "reach", "i", "j").groupBy("reach", "i", "j").applyInPandas(lambda rows: _missed(rows, similarity), "u string, v string")


def alike(docs: DataFrame, width: int = 5, similarity: float = 0.8, distance: int = 4, pairwise: int = PAIRWISE) -> tuple[DataFrame, DataFrame]:
    """Texts (digest, least, fp0, fp1, ...), least the first of their rows, and verified links (u, v) between them.

    Links connect all texts that any chain of texts alike by ``similarity``
    connects, as long as candidates, in a chain of their own, do.
    ``docs`` has id, text, digest and key, which stands for a row.
    """

    @F.pandas_udf(", ".join(f"{fp} long" for fp in _FPS))
    def prints(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([word_fingerprints(t) for t in texts], columns=_FPS)

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, width).view(np.int64) for t in texts])

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y) >= similarity for x, y in zip(a, b)])

    made = materialize(docs.select("id", "digest", "key", prints("text").alias("p")).select("id", "digest", "key", "p.*"), "fingerprints")
    texts = made.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key")).alias("least"), *[F.min(fp).alias(fp) for fp in _FPS])
    texts = materialize(texts, "texts")
    links_ = _candidates(texts, distance, pairwise)
    # Only one row of each text in a link gives its shingles.
    wanted = links_.select(F.col("u").alias("digest")).union(links_.select("v")).distinct().join(texts, "digest").select(F.col("least.key").alias("key"))
    sets = docs.join(wanted.hint("shuffle_hash"), "key", "left_semi").select("digest", shingles("text").alias("grams")).dropDuplicates(["digest"])
    sets = materialize(sets, "shingles")

    pairs = links_.join(sets.select(F.col("digest").alias("u"), F.col("grams").alias("a")), "u").join(sets.select(F.col("digest").alias("v"), F.col("grams").alias("b")), "v")
    found = materialize(pairs.where(close("a", "b")).select("u", "v"), "alike")
    # A link whose middle failed leaves its ends apart: they are held against each other.
    reach = components(links_).select(F.col("node").alias("digest"), F.col("root").alias("reach"))
    parted = materialize(reach.join(components(found), F.col("digest") == F.col("node"), "left").select("digest", "reach", F.coalesce("root", "digest").alias("root")), "parted")
    # Of two texts alone the one link was a candidate.
    several = parted.groupBy("reach").agg(F.min("root").alias("one"), F.max("root").alias("other"), F.count("*").alias("n")).where("n > 2 and one <> other").select("reach")
    parted = materialize(parted.join(several, "reach", "left_semi"), "parted")
    return texts, found.unionByName(_lost(sets, parted, similarity))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, distance: int = 4, pairwise: int = PAIRWISE) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id, with its own columns.

    Equal texts are near copies, null counts as empty, and so are texts that
    verified links connect.  Rows without an id come last, so they stay only
    where no other does; among equal ids the text's digest decides, and among
    equal texts a hash of the row.  An empty table gives no rows.
    """
    digest = F.md5(text_of().cast("binary"))
    rows = packed(docs, id=F.col("doc_id"), text=text_of(), digest=digest, key=F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), digest).cast("binary")), place=row_hash(docs))
    texts, found = alike(rows.select("id", "text", "digest", "key"), width, similarity, distance, pairwise)
    roots = components(found)
    named = texts.join(roots, texts.digest == roots.node, "left").select(F.coalesce("root", "digest").alias("root"), "least")
    first = named.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.key").alias("key"))
    kept = rows.select("row", "key", "place").join(first, "key", "left_semi")
    copy = F.row_number().over(Window.partitionBy("key").orderBy("place"))
    return unpacked(kept.withColumn("copy", copy).where("copy = 1"), docs.columns)
