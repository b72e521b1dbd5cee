"""Questions: intent, drug and condition texts, and the coarse router, as expressions over tables of patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corbel import constants as K
from corbel.functions.text import any_of, first_true, norm_space, strip
from corbel.operators.cut import materialize

#: Words of a drug name at most.
NAME_WORDS = 6


def intent_of(question: Column) -> Column:
    """The first intent whose pattern a question matches; interactions are tried first."""
    q = F.regexp_replace(F.coalesce(question, F.lit("")), r"^\s+|\s+$", "")
    pairs = [(any_of([q.rlike("(?i)" + p) for p in K.INTERACTION_QUESTIONS]), F.lit("interaction"))]
    return first_true(pairs + [(F.lower(q).rlike(p), F.lit(i)) for p, i in K.INTENT_QUESTIONS], F.lit("overview"))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """What a group of a pattern's first match holds; null if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def without_edges(text: Column, marks: str) -> Column:
    """A text without some marks at its ends, null if nothing is left."""
    return F.nullif(F.regexp_replace(text, f"^[{marks}]+|[{marks}]+$", ""), F.lit(""))


def asked_about(text: Column) -> Column:
    """What a question is about: without its opening and its closing marks."""
    opening = r"(?i)^\s*" + "".join(f"(?:{p})?" for p in K.QUESTION_OPENINGS)
    return strip(F.regexp_replace(F.regexp_replace(strip(text), opening, ""), "^[ ?!.,;:]+|[ ?!.,;:]+$", ""))


def spans_of(questions: DataFrame) -> DataFrame:
    """``questions`` with intent, the two sides of an interaction, the span that names the drug, and all that is asked about.

    Each kind of span is one pattern of a table; the first that matches counts.
    """
    text = F.coalesce("text", F.lit(""))
    sides = first_true([(strip(text).rlike("(?i)" + p), F.struct(*[strip(found(strip(text), "(?i)" + p, k)).alias(n) for k, n in ((1, "left"), (2, "right"))])) for p in K.INTERACTION_QUESTIONS], F.lit(None).cast("struct<left:string,right:string>"))
    rows = questions.withColumn("intent", intent_of(F.col("text"))).withColumn("about", asked_about(text))
    rows = rows.withColumn("sides", F.when(F.col("intent") == "interaction", sides))
    span = F.when(F.col("intent") == "adverse_effect", strip(found(F.col("about"), "(?i)" + K.EFFECTS_OF))).when(F.col("intent") == "indication", without_edges(found(text, "(?i)" + K.INDICATIONS_FOR), " ?!.,;:"))
    return rows.withColumn("span", span)


def names_in(texts: DataFrame, keys: list[str], lexicon: DataFrame) -> DataFrame:
    """(keys, name): the longest lexicon name in each text, the leftmost of equals, by a join on runs of words.

    Only places whose word begins a name are followed by longer runs, and only
    of lengths that such names have.  Runs of stop words alone are no names.
    Lexicons may be of any size: they are written once, so that their size
    is known, and nothing is broadcast by force.
    """
    stop = F.array(*[F.lit(w) for w in K.STOP_WORDS])
    named = lexicon.select("key").distinct().withColumn("run", F.split("key", " ", -1)).where(F.size("run").between(1, NAME_WORDS) & (F.size(F.array_except("run", stop)) > 0))
    named = materialize(named.select("key", F.col("run")[0].alias("head"), F.size("run").alias("n")), "names")
    heads = materialize(named.groupBy("head").agg(F.collect_set("n").alias("lengths")), "heads")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9][a-z0-9\-']*)"), F.lit(1))
    # The generator keeps the words from being found anew; shifted arrays are read once, a slice for each place would copy the whole text each time.
    rows = texts.select(*keys, F.explode(F.array(words)).alias("w"))
    shifted = F.arrays_zip(*[F.slice("w", k + 1, 1 << 30).alias(f"w{k}") for k in range(NAME_WORDS)])
    rows = rows.select(*keys, F.posexplode(shifted).alias("i", "at")).select(*keys, "i", F.col("at")["w0"].alias("head"), F.array_compact(F.array(*[F.col("at")[f"w{k}"] for k in range(NAME_WORDS)])).alias("run"))
    rows = rows.join(heads, "head").select(*keys, "i", "run", F.explode("lengths").alias("n")).where(F.size("run") >= F.col("n"))
    rows = rows.select(*keys, "n", "i", F.array_join(F.slice("run", F.lit(1), F.col("n")), " ").alias("key"))
    return rows.join(named.select("key"), "key").groupBy(*keys).agg(F.min_by("key", F.struct(-F.col("n"), F.col("i"))).alias("name"))


def names_in_questions(questions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(qid, name): each question's longest lexicon name."""
    return names_in(questions.select("qid", "text"), ["qid"], lexicon)


def parse_questions(questions: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """``questions`` (qid, text) with intent, drug_text and condition_text.

    The drug is the name that the lexicon (key) finds where the question names
    one; without a lexicon, the first capitalised word.  Of an interaction the
    side with a name is the drug and the other the condition.  Names are looked
    up once for each distinct text, by a join.
    """
    rows = spans_of(questions.select(F.coalesce("text", F.lit("")).alias("text")).distinct())
    first, second = F.coalesce("sides.left", "span", "about"), F.col("sides.right")
    if lexicon is None:
        rows = rows.withColumn("one", found(first, K.CAPITALISED_WORD)).withColumn("two", found(second, K.CAPITALISED_WORD))
    else:
        parts = rows.select(F.col("text").alias("of"), F.explode(F.array(F.struct(F.lit(1).alias("k"), first.alias("text")), F.struct(F.lit(2).alias("k"), second.alias("text")))).alias("s"))
        named = names_in(parts.select("of", "s.k", "s.text"), ["of", "k"], lexicon)
        named = named.groupBy("of").agg(F.max(F.when(F.col("k") == 1, F.col("name"))).alias("one"), F.max(F.when(F.col("k") == 2, F.col("name"))).alias("two"))
        rows = rows.join(named, F.col("text") == F.col("of"), "left").drop("of")
    one, two, pair = F.col("one"), F.col("two"), F.col("sides").isNotNull()
    after = norm_space(F.regexp_replace(found(F.col("text"), "(?i)" + K.CONDITION_AFTER), r"""^[ ?!.,;:'"]+|[ ?!.,;:'"]+$""", ""))
    drug = F.coalesce(one, F.when(pair, two), F.col("sides.left"), F.col("span"))
    condition = F.when(pair, F.when(one.isNull() & two.isNotNull(), F.col("sides.left")).otherwise(F.coalesce(two, second))).when((F.col("intent") == "adverse_effect") | F.col("span").isNotNull(), F.lit(None)).otherwise(after)
    told = rows.select(F.col("text").alias("of"), "intent", drug.alias("drug_text"), condition.alias("condition_text"))
    return questions.withColumn("__of", F.coalesce("text", F.lit(""))).join(told, F.col("__of") == F.col("of")).select(*questions.columns, "intent", "drug_text", "condition_text")


def route_questions(questions: DataFrame) -> DataFrame:
    """``questions`` with the coarse route: safety, condition or drug, and the raw mentions."""
    text = F.col("text")
    first = lambda patterns: without_edges(F.coalesce(*[found(text, p) for p in patterns]), " ?.,")
    drug, cond = first(K.ROUTE_DRUGS), first(K.ROUTE_CONDITIONS)
    told = first_true([(F.lower(text).rlike(p), F.lit(route)) for route, p in K.ROUTES], F.lit(None).cast("string"))
    rows = questions.select("*", told.alias("told"), drug.alias("drug"), cond.alias("cond"))
    open_ = F.col("told").isNull()
    route = F.coalesce("told", F.when(F.col("drug").isNull() & F.col("cond").isNotNull(), "condition").otherwise("drug"))
    guess = F.when(F.col("told") == "condition", F.coalesce("cond", without_edges(found(text, K.ROUTE_GUESS), " ?.,"))).when((F.col("told") == "safety") | F.col("drug").isNull(), F.col("cond"))
    return rows.select(*questions.columns, route.alias("route"), F.when((F.col("told") == "safety") | open_, F.col("drug")).alias("drug_mention"), guess.alias("condition_mention"))
