"""Token counts by a map-side two-tier lookup.

Merges of this kind of vocabulary never cross the start of a run of spaces, so
the number of tokens of a text is the sum over its pre-tokens (a run of spaces
and what follows).  Tier one is a compact table of frequent pre-tokens and
their token counts, broadcast once; tier two is a cache that stays in each
worker, filled by encoding the misses.  A batch's pre-tokens are numbered in
Arrow, so that each distinct one is looked up once.  None is ever shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corbel.llm.common import text_of

#: Texts, and characters of them, that one task reads for the frequent table at most.  It bears on speed only.
TABLE_TEXTS, TABLE_CHARACTERS = 2_000, 8_000_000
#: Entries of the frequent table at most, and of what one task adds to it: this bounds what is broadcast.
TABLE_SIZE = 50_000
#: Entries of a worker's cache at most; a full cache starts anew.  Longer pre-tokens are not kept.
CACHE_SIZE, LONGEST = 400_000, 64
#: Characters that are cut into pre-tokens at once.
BLOCK = 1 << 24

_SPACE = "▁"
_RUNS = re.compile(f"{_SPACE}+[^{_SPACE}]*")


def splits_at_spaces(model) -> bool:
    """Whether texts may be cut before each run of spaces: no piece has a space inside, nothing is normalised."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(model.serialized_model_proto())
    n = m.normalizer_spec
    plain = not n.precompiled_charsmap and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces
    inside = any(re.search(f"[^{_SPACE}]{_SPACE}", p.piece) for p in m.pieces)
    defined = any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in m.pieces)
    return bool(plain and not inside and not defined and not m.trainer_spec.treat_whitespace_as_suffix)


def pretokens(text: str) -> list[str]:
    """The pre-tokens, without the first mark of each.

    A text without repeated, leading or literal space marks is cut by a plain
    split; any other by a pattern.  The empty text has none.
    """
    if not text:
        return []
    if "  " in text or text[0] == " " or _SPACE in text:
        return [x[1:] for x in _RUNS.findall(_SPACE + text.replace(" ", _SPACE))]
    return text.split(" ")


@dataclass
class Frequent:
    """Token counts of some pre-tokens as arrays: sorted 64-bit hashes, counts, and the pre-tokens to verify hits by."""

    keys: np.ndarray
    counts: np.ndarray
    ends: np.ndarray
    letters: bytes

    @classmethod
    def of(cls, counts: dict[str, int]) -> Frequent:
        rows = sorted((xxhash.xxh3_64_intdigest(k), k.encode(), n) for k, n in counts.items())
        ends = np.cumsum([0, *(len(k) for _, k, _ in rows)]).astype(np.int32)
        return cls(np.array([h for h, _, _ in rows], np.uint64), np.array([n for _, _, n in rows], np.int16), ends, b"".join(k for _, k, _ in rows))

    def find(self, words: list[str]) -> np.ndarray:
        """The count of each word, -1 for those that the table lacks."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return out
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        for k in np.flatnonzero(self.keys[at] == h).tolist():
            j = at[k]
            if self.letters[self.ends[j] : self.ends[j + 1]] == words[k].encode():
                out[k] = self.counts[j]
        return out

    def counter(self, path: str) -> Counts:
        """The worker's counter of this table: its cache stays from task to task."""
        made = self.__dict__.setdefault("_counters", {})
        if path not in made:
            made[path] = Counts(path, self)
        return made[path]


class Counts:
    """Counts the tokens of whole texts, in a worker."""

    def __init__(self, path: str, frequent: Frequent, most: int = CACHE_SIZE):
        import sentencepiece

        self.model, self.frequent, self.most = sentencepiece.SentencePieceProcessor(model_file=path), frequent, most
        self.whole = not splits_at_spaces(self.model)
        # The lone mark ends a text that ends in a space; by itself it can't be encoded.
        self.lone = 1 if self.model.piece_to_id(_SPACE) != self.model.unk_id() else len(_SPACE.encode())
        self.cache: dict[str, int] = {}

    def lengths(self, words: list[str]) -> np.ndarray:
        """The tokens of each of some distinct pre-tokens."""
        out = self.frequent.find(words)
        missing = []
        for k in np.flatnonzero(out < 0).tolist():
            n = self.cache.get(words[k]) if words[k] else self.lone
            if n is None:
                missing.append(k)
            else:
                out[k] = n
        if missing:
            if len(self.cache) + len(missing) > self.most:
                self.cache.clear()
            for k, ids in zip(missing, self.model.encode([words[k] for k in missing], num_threads=1)):
                out[k] = len(ids)
                if len(words[k]) < LONGEST and len(self.cache) < self.most:
                    self.cache[words[k]] = len(ids)
        return out

    def _split(self, texts: list[str]) -> np.ndarray:
        """The tokens of texts whose pre-tokens a plain split gives."""
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        each = self.lengths(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        return np.add.reduceat(each, lists.offsets.to_numpy()[:-1])

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        plain, size = [], 0

        def close() -> None:
            if plain:
                out[plain] = self._split([texts[k] for k in plain])

        for k, text in enumerate(texts):
            if not text:
                continue
            if self.whole or "\0" in text:
                out[k] = len(self.model.encode(text))
            elif "  " in text or text[0] == " " or _SPACE in text:
                seen = Counter(pretokens(text))
                out[k] = self.lengths(list(seen)) @ np.fromiter(seen.values(), np.int64, len(seen))
            else:
                plain.append(k)
                size += len(text)
                if size >= BLOCK:
                    close()
                    plain, size = [], 0
        close()
        return out


def frequent_table(docs: DataFrame, model_path: str, text_column: str = "text", size: int = TABLE_SIZE) -> Frequent:
    """Token counts of the most frequent pre-tokens of the first texts of some partitions.

    Each task counts its own, and partitions are run until they have given
    enough rows; so few of them are read, however large the table is.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        texts = characters = 0
        for b in batches:
            for text in b["__text"]:
                if texts < TABLE_TEXTS and characters < TABLE_CHARACTERS:
                    seen.update(x for x in pretokens(text) if 0 < len(x) < LONGEST)
                    texts, characters = texts + 1, characters + len(text)
            if texts >= TABLE_TEXTS or characters >= TABLE_CHARACTERS:
                break
        top = seen.most_common(size)
        if top:
            yield pd.DataFrame({"token": [k for k, _ in top], "n": [n for _, n in top]})

    total: Counter[str] = Counter()
    for r in docs.select(text_of(text_column).alias("__text")).mapInPandas(counted, "token string, n long").take(2 * size):
        total[r["token"]] += r["n"]
    top = sorted(total, key=lambda k: (-total[k], k))[:size]
    return Frequent.of(dict(zip(top, Counts(model_path, Frequent.of({})).lengths(top).tolist())))


def count_tokens(docs: DataFrame, model_path: str, text_column: str = "text", column: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text.

    The same number as the library's ``encode`` gives, without begin or end
    marks.  Null and empty texts have 0; repeated rows and ids stay as they
    are.  An existing column of that name is replaced.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent_table(docs, model_path, text_column))

    @F.pandas_udf("long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = shared.value.counter(model_path)
        for texts in batches:
            yield pd.Series(count(texts.tolist()), dtype="int64")

    return docs.withColumn(column, counts(text_of(text_column)))


def op3_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every document; nulls and repeats: see ``count_tokens``."""
    plain = docs.select("doc_id", text_of("text").alias("text"))
    return count_tokens(plain, model_path).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
