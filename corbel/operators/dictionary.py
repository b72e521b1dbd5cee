"""Dictionary match: all places where terms of a lexicon occur in texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corbel import constants as K
from corbel.functions.keys import short_sha1
from corbel.functions.ranking import surface_confidence
from corbel.functions.text import any_of, literal_map, semantic_tag, strip_tag
from corbel.operators.cut import materialize, pieces
from corbel.operators.ordered import first_rows

#: Lexicon terms that are shipped to every task at most; a larger lexicon is joined instead.
BROADCAST_TERMS = 200_000
#: Candidate terms of one text that ``whole_words`` looks for at a time.
TERMS_AT_ONCE = 20_000
#: Texts with their candidate terms that a task holds at a time.
TEXTS_AT_ONCE = 32
#: A word: letters, digits and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"


def lexicon(docs: DataFrame, least: int = 3) -> DataFrame:
    """(term, snomed_id, surface, ord): names of condition-like concepts in lower case, each once per concept."""
    rows = docs.where(semantic_tag("terms.fsn.term").isin(K.CONDITION_TAGS))
    own = F.struct(F.lit(0).alias("k"), strip_tag("terms.fsn.term").alias("surface"))
    syn = F.transform(F.coalesce("terms.synonyms", F.array().cast("array<struct<id:string,term:string,lang:string>>")), lambda s, k: F.struct((k + 1).alias("k"), F.trim(s["term"]).alias("surface")))
    found = rows.select(F.col("conceptId").alias("snomed_id"), F.explode(F.concat(F.array(own), syn)).alias("n")).select(F.trim(F.lower("n.surface")).alias("term"), "snomed_id", "n.surface", F.struct("snomed_id", "n.k").alias("ord"))
    return first_rows(found.where((F.length("term") >= least) & F.col("term").rlike(r"\p{L}")), ["snomed_id", "term"])


def negated(around: Column | str) -> Column:
    """Whether a word of negation stands in what surrounds a mention."""
    x = F.col(around) if isinstance(around, str) else around
    return any_of([x.contains(w) for w in K.NEGATIONS])


def _edge(low: str, p: int) -> bool:
    """Whether no word goes on across a place of a text."""
    return not (0 < p < len(low) and (low[p - 1].isalnum() or low[p - 1] == "_") and (low[p].isalnum() or low[p] == "_"))


def _apart(found: Iterable, place: Callable) -> list:
    """What a reader from left to right keeps of spans: the longest at each place, none that overlaps one kept before."""
    kept, last = [], 0
    for start, less, f in sorted(((s, -e, f) for f in found for s, e in [place(f)]), key=lambda x: x[:2]):
        if start >= last:
            kept.append(f)
            last = -less
    return kept


def spans(texts: DataFrame, terms: DataFrame, id_column: str, text_column: str = "text", words: bool = False, window: int = 80) -> DataFrame:
    """id, term, start, end, match_text and around of all occurrences of a lexicon's terms in lower-cased texts, overlapping ones too.

    match_text is what the text itself says, around what stands within
    ``window`` characters in lower case; so no later step reads the text again.

    The lexicon goes to every task as an automaton, BROADCAST_TERMS terms at a
    time; a larger one takes a pass over the texts for each such part.  With
    ``words`` only whole words count, longest first, and spans don't overlap;
    a larger lexicon is then joined, see ``whole_words``.
    """
    distinct = terms.select("term").where("term <> ''").distinct()
    parts = -(-distinct.count() // BROADCAST_TERMS)
    if parts > 1:
        if words:
            return whole_words(texts, distinct, id_column, text_column, window)
        parts += 1  # hashed parts are uneven
        found = [spans(texts, distinct.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k), id_column, text_column, window=window) for k in range(parts)]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out
    keys = texts.sparkSession.sparkContext.broadcast(sorted(r[0] for r in distinct.collect()))
    kind = texts.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for k in keys.value:
            machine.add_word(k, k)
        machine.make_automaton()
        for b in pieces(batches):
            rows = []
            for i, text in zip(b[id_column], b[text_column]):
                low = (text or "").lower()
                found = [(e - len(t) + 1, e + 1, t) for e, t in machine.iter(low)] if len(machine) else []
                if words:
                    found = _apart((f for f in found if _edge(low, f[0]) and _edge(low, f[1])), lambda f: (f[0], f[1]))
                rows += [(i, t, s, e, text[s:e], low[max(0, s - window) : e + window]) for s, e, t in found]
            yield pd.DataFrame(rows, columns=[id_column, "term", "start", "end", "match_text", "around"])

    return texts.select(id_column, text_column).mapInPandas(run, f"`{id_column}` {kind}, term string, start int, end int, match_text string, around string")


def _keys(text: Column) -> Column:
    """Hashes of a lower-cased text's words and of its neighbouring words with what stands between them, each once."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    gaps = F.regexp_extract_all(text, F.lit(f"({WORD})({WORD.replace('[', '[^').replace('+', '*')})"), F.lit(2))
    # The arrays go in as arguments, which are read once; in a function's body they would be made anew for each element.
    ended = F.zip_with(words, gaps, lambda w, g: F.concat(w, g))
    pairs = F.array_compact(F.zip_with(ended, F.slice(words, 2, 1 << 30), lambda a, b: F.concat(a, b)))
    return F.array_distinct(F.transform(F.concat(words, pairs), lambda w: F.xxhash64(w)))


def whole_words(texts: DataFrame, terms: DataFrame, id_column: str, text_column: str = "text", window: int = 80) -> DataFrame:
    """What ``spans`` gives for whole words, for a lexicon of any size: nothing of it is sent to every task.

    Each term is indexed by that of its pairs of neighbouring words which the
    fewest texts have, or by its only word, and meets a text by it; the terms
    that a text so meets are then looked for in it, TERMS_AT_ONCE at a time.
    Terms without any word are looked for as in ``spans``.  Equal texts are
    read once.  Null texts have no spans; empty terms none either; rows that
    repeat have theirs each.
    """
    rows = texts.select(F.col(id_column), F.col(text_column).alias("text")).where(F.col(text_column).isNotNull()).withColumn("h", F.unhex(F.left(F.sha2("text", 256), F.lit(32))))
    once = materialize(rows.groupBy("h").agg(F.first("text").alias("text")), "texts")
    distinct = terms.select("term").where("term <> ''").distinct()
    bare = distinct.where(~F.col("term").rlike(WORD))
    # A term of several words has its pairs after its words; only those count.
    n = F.size(F.array_distinct(F.transform(F.regexp_extract_all("term", F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))))
    several = F.size(F.regexp_extract_all("term", F.lit(WORD), F.lit(0))) > 1
    keyed = distinct.select("term", F.explode(F.when(several, F.slice(_keys(F.col("term")), n + 1, F.size(_keys(F.col("term"))))).otherwise(_keys(F.col("term")))).alias("k"))
    held = once.select("h", F.explode(_keys(F.lower("text"))).alias("k")).join(keyed.select("k").distinct(), "k", "left_semi")
    held = materialize(held, "keys")
    spread = held.groupBy("k").agg(F.count("*").alias("n"))
    # A term with a key that no text has is in no text.
    index = keyed.join(spread, "k", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "k")).alias("m")).where("m.n > 0").select("term", F.col("m.k").alias("k"))
    met = materialize(held.join(index, "k").select("h", "term"), "candidates")
    shares = met.groupBy("h").agg(F.ceil(F.count("*") / TERMS_AT_ONCE).alias("parts"))
    asked = met.join(shares, "h").withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts"))).groupBy("h", "part").agg(F.collect_list("term").alias("terms"))

    kinds = pa.schema([("h", pa.binary()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        # A row has many terms: few rows at a time become Python's texts.
        for b in (b.slice(at, TEXTS_AT_ONCE) for b in batches for at in range(0, b.num_rows, TEXTS_AT_ONCE)):
            out = []
            for h, text, wanted in zip(*(b.column(c).to_pylist() for c in ("h", "text", "terms"))):
                machine = ahocorasick.Automaton()
                for t in wanted:
                    machine.add_word(t, len(t))
                machine.make_automaton()
                low = text.lower()
                found = [(e + 1 - n, e + 1) for e, n in machine.iter(low)]
                found = [(s, e) for s, e in found if _edge(low, s) and _edge(low, e)]
                if found:
                    out.append({"h": h, "starts": [s for s, _ in found], "ends": [e for _, e in found]})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    found = once.join(asked, "h").select("h", "text", "terms").mapInArrow(run, "h binary, starts array<int>, ends array<int>")
    if not bare.isEmpty():
        more = spans(once, bare, "h").groupBy("h").agg(F.collect_list(F.struct("start", "end")).alias("x"))
        found = found.unionByName(more.select("h", F.col("x.start").alias("starts"), F.col("x.end").alias("ends")))
    # As many as a text's own places times the terms that begin there.
    found = found.groupBy("h").agg(F.collect_list(F.struct("starts", "ends")).alias("x"))
    found = found.select("h", F.flatten("x.starts").alias("starts"), F.flatten("x.ends").alias("ends"))
    kind = texts.schema[id_column].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches):
            out = []
            for i, text, starts, ends in zip(b[id_column], b["text"], b["starts"], b["ends"]):
                low = text.lower()
                out += [(i, low[s:e], s, e, text[s:e], low[max(0, s - window) : e + window]) for s, e in _apart(zip(starts, ends), lambda x: x)]
            yield pd.DataFrame(out, columns=[id_column, "term", "start", "end", "match_text", "around"])

    # Only the rows' side is skewed by equal texts, and a skewed join splits it.
    return rows.join(found, "h").select(id_column, "text", "starts", "ends").mapInPandas(cut, f"`{id_column}` {kind}, term string, start int, end int, match_text string, around string")


def holding(texts: DataFrame, terms: DataFrame, text_column: str = "text") -> DataFrame:
    """``texts`` with the column term: each row once for every term that its text holds as it stands.

    The terms go to every task as in ``spans``; any number of them will do.
    """
    distinct = terms.select("term").where("term <> ''").distinct()
    parts = -(-distinct.count() // BROADCAST_TERMS)
    if not parts:  # no text needs to be read
        return texts.where("false").withColumn("term", F.lit(None).cast("string"))
    if parts > 1:
        parts += 1  # hashed parts are uneven
        found = [holding(texts, distinct.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k), text_column) for k in range(parts)]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out
    keys = texts.sparkSession.sparkContext.broadcast(sorted(r[0] for r in distinct.collect()))

    @F.pandas_udf(ArrayType(StringType()))
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for k in keys.value:
            machine.add_word(k, k)
        machine.make_automaton()
        for b in batches:
            yield pd.Series([sorted({t for _, t in machine.iter(x or "")}) if len(machine) else [] for x in b], dtype=object)

    return texts.withColumn("term", F.explode(held(text_column)))


def condition_links(chunks: DataFrame, lex: DataFrame, run_ts: str, words: bool = False) -> DataFrame:
    """One link for each mention of a concept in the sections that make links."""
    link = literal_map(K.SECTION_LINK)[F.col("section")]
    rows = chunks.withColumn("link_type", link).where("link_type is not null and text is not null")
    found = spans(rows, lex, "chunk_id", words=words).join(lex.select("term", "snomed_id", "surface"), "term").join(rows.select("chunk_id", "spl_set_id", "section", "link_type"), "chunk_id")
    out = found.select(
        short_sha1("chunk_id", "snomed_id", "start", "end", "link_type").alias("link_id"), "spl_set_id", "chunk_id", "section", "snomed_id", "match_text", F.col("start").alias("char_start"),
        F.col("end").alias("char_end"), "link_type", F.round(surface_confidence("surface"), 3).alias("confidence"), F.lit("dictionary").alias("method"), F.struct(negated("around").alias("negated")).alias("qualifiers"), F.lit(run_ts).alias("last_updated"),
    )
    return out.withColumn("ord", F.struct("chunk_id", "char_start", "char_end", "snomed_id"))
