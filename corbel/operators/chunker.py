"""Overlapping windows over section texts, cut at sentence ends where one is near."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corbel.functions.keys import iso_date
from corbel.functions.text import section_key

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "corbel/chunk:v1")
#: How far back from a window's end a sentence end may be.
LOOK_BACK = 240
_END = re.compile(r"[.!?][)\]\"']?\s|\n\n")

CHUNK_FIELDS = "chunk_id string, char_start int, char_end int, chunk_index int, overlap_chars int, token_count int, chunk_text string"


def windows(text: str, target: int = 1100, most: int = 1800, overlap: int = 160, distinct: bool = True) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, index, stripped text) of a section's windows.

    Line ends become newlines and three or more blank lines one.  A window that
    strips to nothing ends the section; a repeated window takes no index.
    """
    text = re.sub(r"\n\s*\n\s*\n+", "\n\n", text.replace("\r\n", "\n").replace("\r", "\n")).strip()
    at, index, seen = 0, 0, set()
    while at < len(text):
        end = min(at + target, len(text), at + most)
        if end < len(text):
            last = None
            low = max(at, end - LOOK_BACK)
            for last in _END.finditer(text, low, end):
                pass
            end = last.end() if last else end
        end = end if end > at else min(at + most, len(text))
        body = text[at:end].strip()
        if not body:
            return
        mark = hashlib.sha1(" ".join(body.split()).lower().encode()).digest()
        if not (distinct and mark in seen):
            yield at, end, index, body
            index += 1
        seen.add(mark)
        after = end - overlap if end - overlap > at else end
        at = min(max(after, at + 1), len(text))


def chunk_sections(sections: DataFrame, id_column: str = "spl_set_id", section_column: str = "section", text_column: str = "text", target: int = 1100, most: int = 1800, overlap: int = 160, distinct: bool = True, tokens: bool = True) -> DataFrame:
    """The windows of every section with stable ids; other columns stay.  Null texts have none."""
    names = [c for c in sections.columns if c != text_column]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sections.schema.fields if f.name != text_column) + ", " + CHUNK_FIELDS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for values, label, section, text in zip(b[names].itertuples(index=False), b[id_column], b[section_column], b[text_column]):
                for start, end, index, body in windows(text or "", target, most, overlap, distinct):
                    mark = hashlib.sha1(" ".join(body.split()).encode()).hexdigest()[:8]
                    ident = str(uuid.uuid5(NAMESPACE, f"{label}|{section}|{start}|{end}|{mark}"))
                    rows.append((*values, ident, start, end, index, overlap if index else 0, max(1, round(len(body) / 4)) if tokens else None, body))
            yield pd.DataFrame(rows, columns=[*names, *(f.split()[0] for f in CHUNK_FIELDS.split(", "))])

    return sections.mapInPandas(run, schema)


def label_chunks(labels: DataFrame, only: list[str] | None = None, run_id: str = "", **options) -> DataFrame:
    """Chunks of labels that have an id and a version, from the map ``section_texts``."""
    rows = labels.where("spl_set_id <> '' and spl_version_id <> ''")
    boxed = F.exists(F.map_keys("section_texts"), lambda k: k.contains("boxed_warning"))
    rows = rows.select("*", F.coalesce(F.col("boxed_warning_present") if "boxed_warning_present" in labels.columns else F.lit(None).cast("boolean"), boxed).alias("has_boxed_warning"), F.explode("section_texts").alias("k", "text"))
    rows = rows.withColumn("section", section_key("k"))
    if only:
        rows = rows.where(F.col("section").isin([s.lower().replace(" ", "_") for s in only]))
    keep = [c for c in ("spl_set_id", "spl_version_id", "section", "text", "has_boxed_warning", "brand_name", "generic_name", "route", "dosage_form", "ndc11s", "effective_time") if c in rows.columns]
    out = chunk_sections(rows.select(*keep), **options)
    if "effective_time" in keep:
        out = out.withColumn("effective_time", iso_date("effective_time", check=True))
    return out.withColumnRenamed("chunk_text", "text").withColumn("section_path", F.array("section")).withColumn("source", F.lit("dailymed")).withColumn("extras", F.struct(F.lit(run_id).alias("run_id")))


def fixed_windows(docs: DataFrame, id_column: str, text_column: str, size: int, overlap: int) -> DataFrame:
    """Windows of one stride without regard to sentences, in expressions only."""
    stride = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text_column) - 1, F.lit(0)), F.lit(stride))
    rows = docs.where(F.length(text_column) > 0).select(id_column, text_column, F.explode(starts).alias("char_start"))
    return rows.select(id_column, F.col("char_start"), F.expr(f"substring({text_column}, char_start + 1, {size})").alias("chunk_text"))
