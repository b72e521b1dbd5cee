"""The engine: batches of questions to payloads and summaries in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corbel.config import EngineConfig
from corbel.functions.keys import entity_links
from corbel.operators.cut import materialize
from corbel.operators.ordered import ordered_list
from corbel.operators.resolve import filter_phrase, known_condition, resolve_conditions, resolve_drugs
from corbel.operators.vectors import Encoder
from corbel.plans.answer import summarize
from corbel.plans.evidence import collect_evidence
from corbel.plans.questions import parse_questions

_EVIDENCE = "array<struct<spl_set_id:string,section:string,snippet:string,score:double,stage:int,links:map<string,string>>>"


@dataclass
class Engine:
    """The tables that questions are answered from.

    rows: label rows as ``label_rows`` gives them.  lexicon: key to spl_set_id.
    drugs: spl_set_id in lower case to rxcui.  conditions and terms: lexicon
    and preferred terms; without them only a few conditions are known.
    """

    rows: DataFrame
    lexicon: DataFrame
    drugs: DataFrame
    conditions: DataFrame | None = None
    terms: DataFrame | None = None
    encoder: Encoder | None = None
    config: EngineConfig = EngineConfig()

    def ask(self, questions: DataFrame) -> DataFrame:
        """One payload for each question (qid, text).  Questions and evidence are written on the way, so that each part is planned by itself."""
        parsed = parse_questions(questions.select("qid", "text"), self.lexicon)
        found = resolve_drugs(parsed, self.lexicon, self.drugs)
        if self.conditions is not None and self.terms is not None:
            asked = found.select("qid", F.col("condition_text").alias("text"), "intent")
            found = found.join(resolve_conditions(asked, self.conditions, self.terms, cutoff=self.config.fuzzy_cutoff).select("qid", "condition"), "qid", "left")
        else:
            found = found.withColumn("condition", known_condition("condition_text"))
        found = materialize(found, "questions")
        name = F.coalesce(F.nullif(F.trim("drug.matched_name"), F.lit("")), F.trim("drug.query_text"))
        asked = found.select("qid", "text", "intent", filter_phrase().alias("phrase"), name.alias("drug_name"), F.col("drug.spl_set_id").alias("question_label"))
        evidence = materialize(collect_evidence(asked, self.rows, self.encoder, self.config.top_k), "evidence")
        lists = evidence.groupBy("qid").agg(ordered_list(F.struct("spl_set_id", "section", "snippet", "score", "stage", F.to_json("links").alias("links")), F.col("rank"), distinct=False).alias("e"))
        shown = F.transform("e", lambda e: F.struct(e["spl_set_id"].alias("spl_set_id"), e["section"].alias("section"), e["snippet"].alias("snippet"), e["score"].alias("score"), e["stage"].alias("stage"), F.from_json(e["links"], "map<string,string>").alias("links")))
        rows = found.join(lists, "qid", "left").withColumn("evidence", F.coalesce(shown, F.array().cast(_EVIDENCE)))
        links = F.struct(entity_links("drug.spl_set_id", "drug.rxcui", "condition.sctid").alias("entity_links"), F.transform("evidence", lambda e: e["links"]["dailymed"]).alias("evidence_links"))
        graph = F.struct(F.array("intent").alias("link_types"), F.array().cast("array<string>").alias("edges"))
        verdict = F.when(F.col("intent").isin("interaction", "contraindication") & (F.size("evidence") == 0), "insufficient-evidence")
        return rows.select("qid", F.col("text").alias("query"), "intent", "drug", "condition", graph.alias("graph"), "evidence", links.alias("sources"), verdict.alias("verdict"))

    def answer(self, questions: DataFrame, grouped: bool = False) -> DataFrame:
        """One summary for each question.  The payloads are written first: the summary reads them several times."""
        return summarize(materialize(self.ask(questions), "payloads"), self.config.top_k, grouped)
