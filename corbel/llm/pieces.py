"""SentencePiece models run by the tokenizers library.

The model's protobuf is parsed and rebuilt: its normaliser, the space mark,
the scores (a unigram lattice, or merges ranked by score for a BPE model) and
byte fallback.  Ids are the rebuilt tokenizer's own.  Batches of new pre-tokens
are encoded on some threads, whose ids a worker keeps; each new pre-token, and
each text that can't be cut, is also given to SentencePiece, and a text of which
any part differs is marked.  Every text's own ids are then decoded as a whole,
piece by piece, and the result is held against the text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corbel.llm.common import own, text_of
from corbel.llm.tokens import pretokens, splits_at_spaces

_SPACE = "▁"
_BYTE = re.compile("<0x[0-9A-Fa-f]{2}>")
#: Pre-tokens whose ids either generation of a worker's cache keeps.
CACHE_SIZE = 100_000
#: Threads of either library in one worker.  Workers are as many as the executor's tasks, so a few are enough.
THREADS = 2


def _merges(scores: dict[str, float], ids: dict[str, int]) -> list[tuple[str, str]]:
    """All pairs of pieces that make a piece, best score of the whole first."""
    found = []
    for piece, score in scores.items():
        for k in range(1, len(piece)):
            if piece[:k] in ids and piece[k:] in ids:
                found.append((-score, ids[piece[:k]], ids[piece[k:]], piece[:k], piece[k:]))
    return [x[3:] for x in sorted(found)]


def rebuild(path: str):
    """A tokenizers.Tokenizer that encodes like the SentencePiece model at ``path``."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    kinds = pb.ModelProto.SentencePiece
    fallback = any(p.type == kinds.BYTE for p in m.pieces)
    unk = next((k for k, p in enumerate(m.pieces) if p.type == kinds.UNKNOWN), None)
    if m.trainer_spec.model_type == pb.TrainerSpec.UNIGRAM:
        tok = Tokenizer(models.Unigram([(p.piece, p.score) for p in m.pieces], unk, fallback))
    elif m.trainer_spec.model_type == pb.TrainerSpec.BPE:
        ids = {p.piece: k for k, p in enumerate(m.pieces)}
        normal = {p.piece: p.score for p in m.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        tok = Tokenizer(models.BPE(ids, _merges(normal, ids), unk_token=m.pieces[unk].piece if unk is not None else None, byte_fallback=fallback, fuse_unk=True))
    else:
        raise ValueError("only unigram and BPE models can be rebuilt")
    spec, steps = m.normalizer_spec, []
    if spec.precompiled_charsmap:
        steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(_SPACE))
    if spec.escape_whitespaces:
        steps.append(normalizers.Replace(" ", _SPACE))
    tok.normalizer = normalizers.Sequence(steps) if steps else None
    tok.decoder = decoders.Sequence([decoders.Replace(_SPACE, " "), decoders.ByteFallback(), decoders.Fuse()] + [decoders.Strip(" ", 1, 0)] * bool(spec.add_dummy_prefix))
    defined = [AddedToken(p.piece, normalized=False) for p in m.pieces if p.type == kinds.USER_DEFINED]
    if defined:
        tok.add_tokens(defined)
    return tok


class Codec:
    """Encodes and decodes batches of whole texts, in a worker.

    Ids of pre-tokens are kept as packed int32 in two generations: when the
    young one is full it becomes the old one, whose entries move back on use.
    So do the marks of pre-tokens for which SentencePiece gives other ids.
    """

    def __init__(self, path: str, most: int = CACHE_SIZE, threads: int = THREADS):
        # The pool is made at the first batch; a pool that a parent process has made stays as it is.
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        import sentencepiece

        self.sp, self.tok, self.most, self.threads = sentencepiece.SentencePieceProcessor(model_file=path), rebuild(path), most, threads
        self.split = splits_at_spaces(self.sp)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.off: set[str] = set()
        self.old_off: set[str] = set()
        # The mark that ends a text which ends in a space: what two spaces have beyond one.
        one, two = (self._ids([x])[0] for x in ("a", "a "))
        self.lone, self.lone_off = np.array(two[len(one) :], np.int32).tobytes(), self.sp.encode("a ") != two
        pieces = [self.tok.id_to_token(k) or "" for k in range(self.tok.get_vocab_size())]
        self.opens = np.array([p.startswith(_SPACE) for p in pieces])
        # What each piece stands for: a byte, or its text with blanks for the marks.
        self.stands = [bytes([int(p[3:5], 16)]) if _BYTE.fullmatch(p) else p.replace(_SPACE, " ").encode() for p in pieces]
        self.prefixed = self._texts([one]) == ["a"] and pieces[one[0]].startswith(_SPACE)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _texts(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)

    def _learn(self, words: set[str]) -> None:
        """Put the ids of all of ``words`` into the young generation."""
        if len(self.young) > self.most:
            self.old, self.young, self.old_off, self.off = self.young, {}, self.off, set()
        for k in words & self.old.keys():
            self.young[k] = self.old[k]
        self.off |= words & self.old_off
        new = words - self.young.keys() - {""}
        # Words without further marks are coded many in a line and told apart by their marks.
        plain = [k for k in new if " " not in k and _SPACE not in k]
        rest = list(new.difference(plain))
        lines = [plain[k : k + 128] for k in range(0, len(plain), 128)]
        joined = [" ".join(x) for x in lines]
        coded = self._ids(joined)
        for line, mine, theirs in zip(lines, coded, self.sp.encode(joined, num_threads=self.threads)):
            flat = np.array(mine, np.int32)
            at = np.flatnonzero(self.opens[flat])
            if len(at) != len(line) or mine != theirs:
                rest += line
                continue
            raw, ends = flat.tobytes(), [*(4 * at[1:]).tolist(), 4 * len(flat)]
            self.young.update(zip(line, (raw[i:j] for i, j in zip((4 * at).tolist(), ends))))
        coded = self._ids(rest)
        for k, mine, theirs in zip(rest, coded, self.sp.encode(rest, num_threads=self.threads)):
            if mine != theirs:
                self.off.add(k)
            self.young[k] = np.array(mine, np.int32).tobytes()
        self.young[""] = self.lone
        self.off |= {""} if self.lone_off else set()

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        """The rebuilt tokenizer's ids of each text, whether SentencePiece gives the same, and whether they decode to the text."""
        cut = [pretokens(x) if self.split and "\0" not in x else None for x in texts]
        words = set().union(*(x for x in cut if x))
        if missing := words - self.young.keys():
            self._learn(words if len(self.young) > self.most else missing)
        out, same = [], []
        for text, some in zip(texts, cut):
            if some is None:
                mine = self._ids([text])[0]
                out.append(np.array(mine, np.int32))
                same.append(mine == self.sp.encode(text))
            else:
                out.append(np.frombuffer(b"".join(map(self.young.__getitem__, some)), np.int32))
                same.append(not self.off or self.off.isdisjoint(some))
        return out, same, [x == y for x, y in zip(self.decode(out), texts)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The texts of whole lists of ids, as the rebuilt tokenizer's decoder gives them.

        What the pieces stand for is joined; where bytes among it are no text,
        the decoder itself says what they become.
        """
        out: list[str] = []
        for some in ids:
            try:
                whole = b"".join(map(self.stands.__getitem__, some.tolist())).decode()
                out.append(whole[1:] if self.prefixed and whole[:1] == " " else whole)
            except UnicodeDecodeError:
                out += self._texts([some.tolist()])
        return out


@cache
def worker_codec(path: str) -> Codec:
    """One codec for all tasks of a worker, so that what it has learnt stays."""
    return Codec(path)


def encode_pieces(docs: DataFrame, model_path: str, text_column: str = "text") -> DataFrame:
    """``docs`` with token_ids, n_tokens, same_as_model and round_trip for each whole text.

    Null and empty texts have no ids.  round_trip: decoding the ids gives the
    text again.  same_as_model: SentencePiece gives the same ids.  Repeated rows
    and ids stay as they are; columns of those names are replaced, all others kept.
    """
    added = "token_ids array<int>, n_tokens long, same_as_model boolean, round_trip boolean"
    made = StructType.fromDDL(added)
    kept = [c for c in docs.columns if c not in made.fieldNames()]
    # The text comes last, under a name of its own.
    name = "text_" + "_" * max(map(len, kept), default=0)
    plain = docs.select(*[own(c) for c in kept], text_of(text_column).alias(name))
    schema = StructType(plain.schema.fields[:-1] + made.fields)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = part.column(part.num_columns - 1).to_pylist()
                ids, same, back = codec.encode(texts)
                sizes = np.array([len(x) for x in ids], np.int64)
                offsets = np.concatenate([[0], sizes.cumsum()]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pa.array(sizes), pa.array(same, pa.bool_()), pa.array(back, pa.bool_())], names=schema.names)

    return plain.mapInArrow(coded, schema)


def decode_pieces(rows: DataFrame, model_path: str, ids_column: str = "token_ids", column: str = "text") -> DataFrame:
    """``rows`` with the text that each row's ids stand for; null ids give null."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = worker_codec(model_path)
        for some in batches:
            there = some.notna()
            out = pd.Series([None] * len(some), index=some.index, dtype=object)
            out[there] = codec.decode([np.asarray(x, np.int32) for x in some[there]])
            yield out

    return rows.withColumn(column, text(F.col(ids_column)))


def op6_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, token_ids, same_as_model and round_trip for every document."""
    plain = docs.select("doc_id", text_of("text").alias("text"), F.octet_length(text_of("text")).cast("long").alias("n_bytes"))
    return encode_pieces(plain, model_path).select("doc_id", "n_bytes", "n_tokens", "token_ids", "same_as_model", "round_trip")
