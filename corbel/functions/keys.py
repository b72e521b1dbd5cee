"""Identifiers: package codes, dates, flags, hashes and record addresses."""

from __future__ import annotations

import hashlib
import json
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corbel import constants as K
from corbel.functions.text import col, digits, strip


def ndc11(c: Column | str) -> Column:
    """Eleven digits; ten get a zero in front; anything else is null."""
    d = digits(c)
    return F.when(F.length(d) == 11, d).when(F.length(d) == 10, F.concat(F.lit("0"), d))


def ndc11_by_segment(c: Column | str) -> Column:
    """Eleven digits with the zero in the segment that lacks one; other shapes give their digits."""
    raw = F.coalesce(strip(c), F.lit(""))
    part = F.split(raw, "-")
    sizes = F.concat_ws("-", F.transform(part, lambda p: F.length(p).cast("string")))
    whole = raw.rlike(r"^\d+-\d+-\d+$")
    padded = F.concat(F.lpad(F.get(part, F.lit(0)), 5, "0"), F.lpad(F.get(part, F.lit(1)), 4, "0"), F.lpad(F.get(part, F.lit(2)), 2, "0"))
    return F.when(whole & sizes.isin("4-4-2", "5-3-2", "5-4-1", "5-4-2"), padded).otherwise(digits(raw))


def label_packages(text: Column | str) -> tuple[Column, Column]:
    """(products, packages): hyphenated 5-4-2 codes that a text holds, sorted; every package's product is derived."""
    found = F.regexp_extract_all(col(text), F.lit(r"\b(\d{4,5}-\d{3,4}-\d{1,2})\b"), F.lit(1))
    def padded(x):
        p = F.split(x, "-")
        return F.concat_ws("-", F.lpad(F.get(p, F.lit(0)), 5, "0"), F.lpad(F.get(p, F.lit(1)), 4, "0"), F.lpad(F.get(p, F.lit(2)), 2, "0"))
    codes = F.array_distinct(F.transform(found, padded))
    packages = F.array_sort(F.filter(codes, lambda x: ~x.endswith("-00")))
    products = F.array_sort(F.array_distinct(F.transform(codes, lambda x: F.concat(F.substring_index(x, "-", 2), F.lit("-00")))))
    return products, packages


def iso_date(c: Column | str, check: bool = False) -> Column:
    """YYYYMMDD as YYYY-MM-DD, anything else as it is; ``check`` leaves impossible days as they are too."""
    x = col(c)
    ok = x.rlike(r"^\d{8}$")
    if check:
        ok = ok & F.try_to_date(x, "yyyyMMdd").isNotNull()
    return F.when(ok, F.regexp_replace(x, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(x)


def truthy(c: Column | str) -> Column:
    return F.lower(F.trim(col(c).cast("string"))).isin("1", "true", "t", "yes", "y")


def first_given(*columns: Column | str) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in columns])


def is_number(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike("^[0-9]+$"), F.lit(False))


def short_sha1(*parts: Column | str) -> Column:
    """Sixteen digits of the SHA-1 of the parts, joined by bars."""
    return F.left(F.sha1(F.concat_ws("|", *[col(p).cast("string") for p in parts])), F.lit(16))


def short_sha256(c: Column | str) -> Column:
    return F.left(F.sha2(col(c), 256), F.lit(16))


def uuid5(namespace: str | uuid.UUID, name: Column | str) -> Column:
    """The version 5 UUID of a name, without leaving the JVM."""
    ns = uuid.UUID(str(namespace)).hex
    h = F.sha1(F.concat(F.unhex(F.lit(ns)), F.encode(col(name), "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


@F.pandas_udf(StringType())
def blake2s_of_json(s: pd.Series) -> pd.Series:
    """Sixteen digits of the BLAKE2s hash of the JSON text with sorted keys."""

    def one(x):
        plain = json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"))
        return hashlib.blake2s(plain.encode(), digest_size=8).hexdigest()

    return s.map(one, na_action="ignore")


def set_id(c: Column | str) -> Column:
    """The first UUID in a text, lower case, or null."""
    return F.lower(F.nullif(F.regexp_extract(F.coalesce(col(c), F.lit("")), f"({K.UUID})", 1), F.lit("")))


def _address(base: str, key: Column, tail: str = "") -> Column:
    return F.when(key != "", F.concat(F.lit(base), key, F.lit(tail)))


def record_links(label: Column | str, drug: Column | str, concept: Column | str) -> Column:
    """Map of the public records of a label, a drug and a concept; keys only where there is an id."""
    label, drug, concept = F.coalesce(set_id(label), F.lit("")), F.coalesce(digits(drug), F.lit("")), F.coalesce(digits(concept), F.lit(""))
    every = F.create_map(
        F.lit("dailymed"), _address(K.LABEL_PAGE, label), F.lit("dailymed_api"), _address(K.LABEL_API, label, ".json"),
        F.lit("rxnav"), _address(K.DRUG_PAGE, drug), F.lit("rxnav_api"), _address(K.DRUG_API, drug, ".json"),
        F.lit("snomed"), _address(K.CONCEPT_PAGE, concept),
    )
    return F.map_filter(every, lambda _, v: v.isNotNull())


def entity_links(label: Column | str, drug: Column | str, concept: Column | str) -> Column:
    """The same for a question's entities: ids as they are, and the drug's search page."""
    label, drug, concept = (F.coalesce(col(c), F.lit("")) for c in (label, drug, concept))
    every = F.create_map(
        F.lit("dailymed"), _address(K.LABEL_PAGE, label), F.lit("dailymed_api"), _address(K.LABEL_API, label, ".json"),
        F.lit("rxnav"), _address(K.DRUG_SEARCH, drug), F.lit("rxnav_api"), _address(K.DRUG_API, drug, ".json"),
        F.lit("snomed"), _address(K.CONCEPT_PAGE, concept),
    )
    return F.map_filter(every, lambda _, v: v.isNotNull())
