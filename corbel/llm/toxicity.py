"""Toxicity: a convolutional text classifier in numpy.

Hashed embeddings of words and of their beginnings go through filters of several widths; each filter's
largest response over the whole text feeds a logistic layer.  Training uses
Adam on all labelled rows: few of them on the driver, more in blocks that tasks
train side by side and whose steps are averaged after each pass.  For scoring,
embeddings and filters are multiplied once into a table by word and filter tap,
so that a text costs lookups and sums.  The language is no input of a score: it only chooses the
calibrated threshold that a caller may use beside the fixed one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corbel.llm.common import discard, fold, materialize, shared_dir, text_of

#: Labelled rows and characters of them in a block, about; a single block is fitted on the driver.
BLOCK_ROWS, BLOCK_CHARS = 3_000, 8_000_000
#: Labelled ids that are broadcast at most.
BROADCAST_IDS = 1_000_000
#: Passes over all blocks, and the part of the rate that the next pass takes.
PASSES, SLOWER = 2, 0.5
#: Steps of blocks are summed as integers of this unit, so that their order doesn't matter.
UNIT = 2.0**-32
#: Scores of rows held back are counted in so many bins where they don't lie on the driver.
BINS = 4_096
#: Of the labelled rows one in so many is held back from training and calibrates the thresholds.
CALIBRATE = 5
#: Buckets of the hashed vocabulary, and numbers of each embedding.
BUCKETS, DIMS = 2**15, 12
#: Filter widths in words, and filters of each.
WIDTHS, FILTERS = (1, 2, 3), 8
#: Words whose bucket a worker keeps at most.
CACHE_SIZE = 400_000

_EDGES = "\"'()[]{}<>.,;:!?*#$%&|-_=+/\\~^`@…«»¡¿"


def parts(word: str) -> tuple[int, int, int]:
    """Buckets of a word and of its first four and five letters, in lower case and without marks at its edges.

    Bucket 0 stands for padding.
    """
    core = word.lower().strip(_EDGES)
    return tuple(1 + crc32(x.encode("utf-8", "replace")) % (BUCKETS - 1) for x in (core, "^" + core[:4], "^" + core[:5]))


class Buckets(dict):
    """The parts of words, kept."""

    def __missing__(self, word: str) -> tuple[int, int, int]:
        if len(self) >= CACHE_SIZE:
            self.clear()
        found = self[word] = parts(word)
        return found

    def of(self, text: str) -> np.ndarray:
        """A row of parts for each word, one row of padding at least."""
        words = text.split()
        return np.array([self[w] for w in words], np.int32) if words else np.zeros((1, 3), np.int32)


@dataclass
class Network:
    """Embeddings, filters by width (taps x dims x filters), their offsets, output weights and offset."""

    embed: np.ndarray
    taps: list[np.ndarray]
    offsets: list[np.ndarray]
    out: np.ndarray
    base: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def tables(self) -> np.ndarray:
        """For each bucket: its share in each filter's taps, one after the other."""
        return np.concatenate([self.embed @ tap for width in self.taps for tap in width], axis=1).astype(np.float32)


class Scorer(dict):
    """Scores texts in a worker; keeps, by word, the row of its sums over parts in a table that grows."""

    def __init__(self, tables: np.ndarray, offsets: list[np.ndarray], out: np.ndarray, base: float, most: int = CACHE_SIZE):
        super().__init__()
        self.tables, self.offsets, self.out, self.base, self.most = tables, offsets, out, base, most
        self.rows = np.zeros((1024, tables.shape[1]), np.float32)

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self) + 1  # row 0 is padding
        if k >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        a, b, c = parts(word)
        self.rows[k] = self.tables[a] + self.tables[b] + self.tables[c]
        return k

    def score(self, text: str) -> float:
        """Probability that the text is toxic."""
        if self.base == -np.inf:
            return 0.0
        words = text.split()
        if len(self) + len(words) > self.most:
            self.clear()
        x = np.zeros(max(len(words), max(WIDTHS)), np.int32)
        x[: len(words)] = [self[w] for w in words]
        real = max(len(words), 1)
        taps, total, at = self.rows[x], self.base, 0
        for k, width in enumerate(WIDTHS):
            n = max(real - width + 1, 1)
            response = taps[:n, at : at + FILTERS]
            for j in range(1, width):
                response = response + taps[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS]
            at += width * FILTERS
            top = np.maximum(response.max(0) + self.offsets[k], 0)
            total += float(top @ self.out[k * FILTERS : (k + 1) * FILTERS])
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def _counts(texts: Iterable[np.ndarray], y: Iterable[float]) -> np.ndarray:
    """For each label: texts that hold each bucket, and in the last place all texts."""
    counts = np.zeros((2, BUCKETS + 1))
    for x, label in zip(texts, y):
        counts[int(label), np.unique(x)] += 1
        counts[int(label), -1] += 1
    return counts


def _start(counts: np.ndarray, rng: np.random.Generator) -> Network:
    """Random weights, but for one dimension of each embedding: the log-odds of the bucket among toxic texts."""
    counts, rows = counts[:, :-1], counts[:, -1:]
    rates = (counts + 0.5) / (rows + 1)
    odds = np.clip(np.log(rates[1] / rates[0]), -4, 4) * np.minimum(1, counts.sum(0) / 20)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMS))
    embed[:, 0] = odds / 2
    embed[0] = 0
    taps = [rng.normal(0, 0.2, (w, DIMS, FILTERS)) for w in WIDTHS]
    for width in taps:
        width[:, 0, : FILTERS // 2] = np.abs(width[:, 0, : FILTERS // 2]) + 1 / len(width)
    return Network(embed, taps, [np.zeros(FILTERS) for _ in WIDTHS], np.abs(rng.normal(0, 0.2, FILTERS * len(WIDTHS))), -1.0)


def _never() -> Network:
    """The network whose every score is 0."""
    return Network(np.zeros((BUCKETS, DIMS)), [np.zeros((w, DIMS, FILTERS)) for w in WIDTHS], [np.zeros(FILTERS)] * len(WIDTHS), np.zeros(FILTERS * len(WIDTHS)), -np.inf)


def fit_network(texts: list[np.ndarray], y: np.ndarray, rounds: int = 4, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Network:
    """Train on the buckets of whole texts; without texts of both labels every score is 0."""
    rng = np.random.default_rng(seed)
    if len(set(y.tolist())) < 2:
        return _never()
    return _train(_start(_counts(texts, y), rng), texts, y, rounds, batch, rate, rng)


def _train(net: Network, texts: list[np.ndarray], y: np.ndarray, rounds: int, batch: int, rate: float, rng: np.random.Generator) -> Network:
    """``net`` after so many rounds of Adam over the texts; its arrays are changed."""
    params = [net.embed, *net.taps, *net.offsets, net.out, np.array([net.base])]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    n = len(WIDTHS)
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            grads = [np.zeros_like(p) for p in params[1:]]
            touched, moves = [], []
            for r in rows:
                x = texts[r] if len(texts[r]) >= max(WIDTHS) else np.pad(texts[r], ((0, max(WIDTHS) - len(texts[r])), (0, 0)))
                e = net.embed[x].sum(1)
                tops, places = [], []
                for k, w in enumerate(WIDTHS):
                    m = len(x) - w + 1
                    response = sum(e[j : j + m] @ net.taps[k][j] for j in range(w))
                    where = response.argmax(0)
                    tops.append(response[where, np.arange(FILTERS)] + net.offsets[k])
                    places.append(where)
                z = np.concatenate(tops)
                active = np.maximum(z, 0)
                p = 1 / (1 + np.exp(-np.clip(active @ net.out + params[-1][0], -30, 30)))
                d = (p - y[r]) / len(rows)
                grads[-1] += d
                grads[-2] += d * active
                dz = d * net.out * (z > 0)
                for k, w in enumerate(WIDTHS):
                    part = dz[k * FILTERS : (k + 1) * FILTERS]
                    grads[n + k] += part
                    for j in range(w):
                        at_word = places[k] + j
                        grads[k][j] += e[at_word].T * part
                        touched.append(x[at_word].ravel())
                        moves.append(np.repeat(net.taps[k][j].T * part[:, None], 3, axis=0))
            step += 1
            ids, back = np.unique(np.concatenate(touched), return_inverse=True)
            rows_grad = np.zeros((len(ids), DIMS))
            np.add.at(rows_grad, back, np.concatenate(moves))
            scale = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in enumerate([rows_grad, *grads]):
                at_rows = ids if k == 0 else slice(None)
                first[k][at_rows] = 0.9 * first[k][at_rows] + 0.1 * g
                second[k][at_rows] = 0.999 * second[k][at_rows] + 0.001 * g * g
                params[k][at_rows] -= scale * first[k][at_rows] / (np.sqrt(second[k][at_rows]) + 1e-8)
            net.embed[0] = 0
    net.base = float(params[-1][0])
    return net


def _forward(net: Network, x: np.ndarray) -> float:
    """The score of a text's parts, straight from the weights."""
    if net.base == -np.inf:
        return 0.0
    e, total = net.embed[np.pad(x, ((0, max(0, max(WIDTHS) - len(x))), (0, 0)))].sum(1), net.base
    for k, w in enumerate(WIDTHS):
        m = max(len(x) - w + 1, 1)
        top = np.maximum(sum(e[j : j + m] @ net.taps[k][j] for j in range(w)).max(0) + net.offsets[k], 0)
        total += float(top @ net.out[k * FILTERS : (k + 1) * FILTERS])
    return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def calibrate(scores: np.ndarray, y: np.ndarray, langs: list[str], least: int = 20, times: np.ndarray | None = None) -> dict[str, float]:
    """For each language the threshold that errs least on some rows, each counted so many ``times`` or once; '' is for all others.

    Languages with fewer than ``least`` rows take the common threshold, which
    is 0.5 without any rows.  Rows that the network was trained on would tell
    nothing about its errors, so ``fit_toxicity`` gives others.
    """

    times = np.ones(len(y), np.int64) if times is None else times

    def best(s: np.ndarray, t: np.ndarray, n: np.ndarray) -> float:
        cuts = np.unique(np.concatenate([[0.5], s]))
        wrong = [n[(s >= c) != t].sum() for c in cuts]
        near = [c for c, w in zip(cuts, wrong) if w == min(wrong)]
        return float(min(near, key=lambda c: abs(c - 0.5)))

    if not len(y):
        return {"": 0.5}
    found = {"": best(scores, y == 1, times)}
    tags = np.array(langs)
    for tag in sorted(set(langs)):
        if times[rows := tags == tag].sum() >= least:
            found[tag] = best(scores[rows], y[rows] == 1, times[rows])
    return found


def _params(net: Network) -> list[np.ndarray]:
    """All weights, the embeddings first."""
    return [net.embed, *net.taps, *net.offsets, net.out, np.array([net.base])]


def _dense(net: Network) -> np.ndarray:
    """All weights but the embeddings in rows of DIMS, padded with zeros."""
    flat = np.concatenate([p.ravel() for p in _params(net)[1:]])
    return np.pad(flat, (0, -len(flat) % DIMS)).reshape(-1, DIMS)


def _moved(net: Network, embed: np.ndarray, dense: np.ndarray) -> Network:
    """A network of the same shape with other weights."""
    flat, shapes, at, parts_ = dense.ravel(), [p.shape for p in _params(net)[1:]], 0, []
    for shape in shapes:
        n = int(np.prod(shape))
        parts_.append(flat[at : at + n].reshape(shape).copy())
        at += n
    k = len(WIDTHS)
    return Network(embed, parts_[:k], parts_[k : 2 * k], parts_[-2], float(parts_[-1][0]))


def _unpack(x: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(b, np.int16).reshape(-1, 3).astype(np.int32) for b in x]


def _mover(shared: Broadcast, k: int, batch: int, rate: float, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What trains a block in pass ``k`` and gives its steps: one row for each embedding that moved, and rows of the other weights."""

    def moves(block: pd.DataFrame) -> pd.DataFrame:
        block, old = block.sort_values(["place", "id"], kind="stable"), shared.value
        own = _moved(old, old.embed.copy(), _dense(old))
        own = _train(own, _unpack(block["x"]), block["y"].to_numpy(float), 1, batch, rate, np.random.default_rng([seed, k, int(block["block"].iloc[0])]))
        at = np.flatnonzero((own.embed != old.embed).any(1))
        by = np.concatenate([own.embed[at] - old.embed[at], _dense(own) - _dense(old)])
        return pd.DataFrame({"k": np.concatenate([at, BUCKETS + np.arange(len(by) - len(at))]), "v": list(np.rint(by / UNIT).astype(np.int64))})

    return moves


def _fit_blocks(rows: DataFrame, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Network:
    """Fit on rows (block, place, id, back, lang, y, x) that lie bucketed by their block.

    Each pass trains every block from the same weights and moves these by the
    mean of the blocks' steps: an embedding by the mean of blocks that have its
    bucket.  Each pass brings one row for each bucket to the driver, however
    many rows there are.  Thresholds come from counts of all rows held back.
    """
    spark = rows.sparkSession
    trained = rows.where("not back")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, BUCKETS + 1))
        for b in batches:
            counts += _counts(_unpack(b["x"]), b["y"])
        at = np.flatnonzero(counts.sum(0))
        yield pd.DataFrame({"k": at, "a": counts[0, at].astype(int), "b": counts[1, at].astype(int)})

    told = trained.select("y", "x").mapInPandas(counted, "k int, a long, b long").groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toPandas()
    counts = np.zeros((2, BUCKETS + 1))
    counts[:, told["k"].to_numpy(int)] = told[["a", "b"]].to_numpy(float).T
    if not counts[:, -1].all():
        return _never()
    net = _start(counts, np.random.default_rng(seed))
    for k in range(PASSES):
        shared = spark.sparkContext.broadcast(net)
        steps = trained.groupBy("block").applyInPandas(_mover(shared, k, batch, rate * SLOWER**k, seed), "k int, v array<long>")
        steps = steps.groupBy("k").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIMS)]).toPandas()
        mean = steps[[f"v{i}" for i in range(DIMS)]].to_numpy(float) * UNIT / steps[["n"]].to_numpy(float)
        both, at = np.concatenate([net.embed, _dense(net)]), steps["k"].to_numpy(int)
        both[at] += mean
        net = _moved(net, both[:BUCKETS], both[BUCKETS:])
        shared.unpersist()
    shared = spark.sparkContext.broadcast(net)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"lang": b["lang"], "bin": [min(int(_forward(shared.value, x) * BINS), BINS - 1) for x in _unpack(b["x"])], "y": b["y"]})

    told = rows.where("back").select("lang", "y", "x").mapInPandas(scored, "lang string, bin int, y int").groupBy("lang", "bin", "y").count().toPandas().sort_values(["lang", "bin", "y"])
    # A score of a bin's lower edge is at or above a cut of an edge exactly if all scores of the bin are.
    net.thresholds = calibrate(told["bin"].to_numpy(float) / BINS, told["y"].to_numpy(float), told["lang"].tolist(), times=told["count"].to_numpy(int))
    return net


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", lang_column: str = "lang", train_rows: int | None = None, train_words: int | None = None, keep=None) -> Network:
    """Fit on all labelled rows for whose id ``keep`` holds.

    One row in CALIBRATE calibrates the thresholds and isn't trained on; the
    network is trained on all others.  Null ids and labels are left out; an id
    counts once, with its largest label and one of its texts.  Executors turn
    texts into buckets.  Rows of one block (see BLOCK_ROWS) are fitted on the
    driver; more are fitted where they lie, block by block.  A caller may ask
    for fewer: ``train_rows`` takes half of them of either label, those of the
    smallest hashed ids, and rows beyond ``train_words`` words are passed over.
    """
    ids = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
    if keep is not None:
        ids, docs = ids.where(keep), docs.where(keep)
    ids = ids.groupBy(F.col(id_column).alias("__id")).agg(F.max(label_column).cast("int").alias("__y"))
    if train_rows is not None:
        picked = [ids.where(f"__y = {k}").orderBy(F.xxhash64("__id"), "__id").limit(train_rows // 2) for k in (0, 1)]
        ids = picked[0].unionByName(picked[1])
    lang = F.coalesce(F.col(lang_column), F.lit("")) if lang_column in docs.columns else F.lit("")
    # So that texts without a label aren't shuffled; more ids are joined as Spark sees fit.
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col(id_column).alias("__id"), text_of(text_column).alias("__c0"), lang.alias("__c1"))
    size = texts.select("__id", F.length("__c0").alias("c")).join(ids, "__id").agg(F.count("*").alias("n"), F.sum("c").alias("c")).first()
    rows = texts.join(ids, "__id")
    blocks = max(1, -(-size["n"] // BLOCK_ROWS), -(-(size["c"] or 0) // BLOCK_CHARS))
    rows = rows.select("__id", "__y", "__c0", "__c1", F.xxhash64("__c0", "__c1").alias("h"), F.xxhash64("__id").alias("place"), F.pmod(F.xxhash64("__id", F.lit("block")), F.lit(blocks)).cast("int").alias("block"))

    def bucketed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Buckets()
        for b in batches:
            x = [seen.of(t).astype(np.int16) for t in b["__c0"]]
            yield pd.DataFrame({"id": b["__id"].astype(str), "place": b["place"], "block": b["block"], "h": b["h"], "words": [len(p) for p in x], "x": [p.tobytes() for p in x], "lang": b["__c1"], "y": b["__y"]})

    found = rows.mapInPandas(bucketed, "id string, place long, block int, h long, words long, x binary, lang string, y int").repartition(blocks, "block")
    found = found.groupBy("block", "place", "id").agg(F.min_by(F.struct("words", "x", "lang", "y"), "h").alias("c")).select("block", "place", "id", (F.pmod("place", F.lit(CALIBRATE)) == 0).alias("back"), "c.*")
    if blocks > 1 and train_words is None:
        name = f"corbel_toxicity_{uuid.uuid4().hex}"
        path = f"{shared_dir(docs.sparkSession)}/corbel/{docs.sparkSession.sparkContext.applicationId}/{name}"
        # Each task has one bucket: passes over blocks need no shuffle of texts.
        found.drop("words").write.bucketBy(blocks, "block").option("path", path).saveAsTable(name)
        table = docs.sparkSession.table(name)
        net = _fit_blocks(table)
        docs.sparkSession.sql(f"DROP TABLE {name}")
        table._corbel_path = path
        discard(table)
        return net
    found = materialize(found, "labelled")
    if train_words is not None:
        sizes = found.select("id", "place", "words").toPandas().sort_values(["place", "id"], kind="stable")
        chosen, total = [], 0
        for i, words in zip(sizes["id"], sizes["words"]):
            if total + words <= train_words:
                chosen.append(i)
                total += words
        rows = found.where(F.col("id").isin(chosen))
    else:
        rows = found
    rows = rows.toPandas().sort_values(["place", "id"], kind="stable")
    discard(found)
    x = _unpack(rows["x"])
    y, back = rows["y"].to_numpy(float), rows["back"].to_numpy(bool)
    net = fit_network([b for b, out in zip(x, back) if not out], y[~back])
    some = np.flatnonzero(back)
    net.thresholds = calibrate(np.array([_forward(net, x[k]) for k in some]), y[some], rows["lang"].to_numpy()[some].tolist())
    return net


def score_toxicity(docs: DataFrame, net: Network, text_column: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the probability that each whole text is toxic; null texts count as empty, repeated rows stay.

    An existing column of that name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((net.tables(), net.offsets, net.out, net.base))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*shared.value)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype=float)

    return docs.withColumn(column, score(text_of(text_column)))


def op5_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and flagged by the language's own threshold; nulls and repeats: see ``fit_toxicity``."""
    net = fit_toxicity(docs, labels, keep=fold("doc_id", 5) != 0)
    plain = score_toxicity(docs.select("doc_id", "text", "lang"), net)
    limits = F.create_map(*[F.lit(x) for pair in sorted(net.thresholds.items()) for x in pair])
    limit = F.coalesce(limits[F.coalesce("lang", F.lit(""))], F.lit(net.thresholds[""]))
    return plain.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= limit).alias("flagged"))
