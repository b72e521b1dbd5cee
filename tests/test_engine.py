"""Golden fixtures of the terminology operators and of the retrieval."""

import pytest
from pyspark.sql import functions as F

from corbel import constants as K
from corbel.operators import concepts, dictionary, drugs, links, names, resolve, vectors
from corbel.plans import answer, evidence, questions
from corbel.plans.engine import Engine
from corbel.sources import files, labels, sinks

TS = "2024-01-01T00:00:00+00:00"


def conso(spark, *rows):
    """Rows of (RXCUI, ISPREF, SAB, TTY, STR, SUPPRESS)."""
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "RXCUI string, ISPREF string, SAB string, TTY string, STR string, SUPPRESS string, ord int")


def test_drug_master(spark):
    rows = conso(
        spark, ("100", "N", "RXNORM", "SY", "Zorvex 10 MG tab", "N"), ("100", "Y", "RXNORM", "SCD", "zorvexil 10 MG Oral Tablet", "N"), ("100", "N", "MTHSPL", "DP", "ZORVEXIL 10 mg ORAL TABLET", "N"), ("100", "N", "RXNORM", "SCD", "zorvexíl 10 MG Oral Tablet", "N"),
        ("101", "Y", "RXNORM", "IN", "zorvexil", "N"), ("101", "N", "RXNORM", "BN", "Zorvex", "O"), ("102", "Y", "MTHSPL", "SU", "excipient only", "N"), ("103", "N", "RXNORM", "XX", '"quoted start', "N"),
    )
    got = {r["rxcui"]: r for r in drugs.drug_master(rows, TS).collect()}
    assert set(got) == {"100", "101", "103"}
    assert got["100"]["preferred_term"] == "zorvexil 10 MG Oral Tablet" and got["100"]["synonyms"] == ["Zorvex 10 MG tab", "zorvexil 10 MG Oral Tablet"]
    assert got["100"]["sab_sources"] == ["MTHSPL", "RXNORM"] and got["100"]["node_kind"] == "product" and got["101"]["brand_generic"] == "ingredient"
    meta = drugs.drug_meta(rows, spark.createDataFrame([("100", ["1"])], "rxcui string, ndc11s array<string>"))
    assert {r["rxcui"]: (r["tty"], r["has_ndc"]) for r in meta.collect()}["101"] == ("BN", False)


def test_relations(spark):
    rows = [("100", "CUI", "101", "CUI", "has_ingredient", "RXNORM", "N"), ("101", "CUI", "100", "CUI", "ingredient_of", "RXNORM", "N"), ("100", "CUI", "200", "CUI", "has_dose_form", "RXNORM", "N"), ("100", "AUI", "101", "CUI", "has_ingredient", "RXNORM", "N"), ("100", "CUI", "101", "CUI", "", "RXNORM", "N"), ("100", "CUI", "105", "CUI", "consists_of", "RXNORM", "N"), ("105", "CUI", "100", "CUI", "constitutes", "RXNORM", "N"), ("100", "CUI", "101", "CUI", "isa", "SNOMEDCT_US", "N"), ("100", "CUI", "106", "CUI", "isa", "RXNORM", "Y"), ("1x0", "CUI", "101", "CUI", "isa", "RXNORM", "N")]
    rel = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "RXCUI1 string, STYPE1 string, RXCUI2 string, STYPE2 string, RELA string, SAB string, SUPPRESS string, ord int")
    got = {tuple(r)[:3] for r in drugs.drug_relations(rel, ["RXNORM"]).collect()}
    # The flipped part-of edge of 105 gives 100 has_part 105 once.
    assert got == {("100", "has_ingredient", "101"), ("100", "has_dose_form", "200"), ("100", "has_part", "105")}


def test_attributes(spark):
    rows = [("100", "NDC", "MTHSPL", "12345-678-90", "N"), ("100", "NDC", "RXNORM", "ABC", "N"), ("100", "RXN_STRENGTH", "RXNORM", "10 MG", "O"), ("", "NDC", "RXNORM", "1", "N"), ("100", "NDC", "MTHSPL", "12345-678-90", "N")]
    sat = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "RXCUI string, ATN string, SAB string, ATV string, SUPPRESS string, ord int")
    assert {(r["atn"], r["atv"]) for r in drugs.drug_attributes(sat, normalize=True, only_valid=True).collect()} == {("NDC11", "12345067890"), ("RXN_STRENGTH", "10 MG")}
    emitted = drugs.drug_attributes_emitting(sat, normalize=True, emit_ndc=True, drop_suppressed=True)
    assert sorted((r["atn"], r["atv"]) for r in emitted.collect()) == [("NDC", "12345-678-90"), ("NDC", "ABC"), ("NDC11", "01234567890")]


def test_names_tell_routes_and_forms(spark):
    df = spark.createDataFrame([("zorvexil 10 MG Oral Tablet",), ("Zorvexil Eye Drops",), ("plain",)], "n string")
    assert [(r[0], r[1]) for r in df.select(drugs.routes_in(F.col("n")), drugs.form_in(F.col("n"))).collect()] == [(["ORAL"], "Tablet"), (["OPHTHALMIC"], "Drops"), ([], None)]


def test_concepts(spark):
    c = spark.createDataFrame([("11", "20240101", "1", "m", K.DEFINED, 0), ("11", "20240301", "0", "m", K.DEFINED, 1), ("12", "20240101", "1", "a", K.PRIMITIVE, 2), ("12", "20240101", "1", "b", K.PRIMITIVE, 3), ("13", "2024-1-1", "1", "m", "000", 4)], "id string, effectiveTime string, active string, moduleId string, definitionStatusId string, ord int")
    d = spark.createDataFrame([("1", "20240101", "1", "m", "12", "en", K.FSN, "Old (disorder)", "", 0), ("2", "20240201", "1", "m", "12", "en", K.FSN, "Zorbitis (disorder)", "", 1), ("3", "20240101", "1", "m", "12", "en", K.SYNONYM, "Zorbitis", "", 2), ("4", "20240301", "1", "m", "12", "en", K.SYNONYM, "Zorbitis", "", 3), ("5", "20240101", "1", "m", "12", "en", K.SYNONYM, "flu", "", 4), ("6", "20240101", "0", "m", "12", "en", K.SYNONYM, "gone", "", 5)], "id string, effectiveTime string, active string, moduleId string, conceptId string, languageCode string, typeId string, term string, caseSignificanceId string, ord int")
    r = spark.createDataFrame([("1", "20240101", "1", "m", "12", "13", "", K.IS_A, K.INFERRED, "x", 0), ("2", "20240201", "1", "m", "12", "13", "1", K.IS_A, K.INFERRED, "x", 1), ("3", "20240101", "1", "m", "12", "10", "0", K.IS_A, K.STATED, "x", 2), ("4", "20240101", "1", "m", "12", "9", "0", "77", K.INFERRED, "x", 3)], "id string, effectiveTime string, active string, moduleId string, sourceId string, destinationId string, relationshipGroup string, typeId string, characteristicTypeId string, modifierId string, ord int")
    docs = concepts.aggregate(concepts.concept_rows(c, TS), concepts.description_rows(d, TS), concepts.relationship_rows(r, TS), TS)
    got = {x["conceptId"]: x for x in docs.collect()}
    assert set(got) == {"12", "13"} and got["12"]["moduleId"] == "b"
    assert got["12"]["terms"]["fsn"]["term"] == "Zorbitis (disorder)" and [s["term"] for s in got["12"]["terms"]["synonyms"]] == ["Zorbitis", "flu"] and got["12"]["terms"]["synonyms"][0]["id"] == "4"
    assert got["12"]["hierarchy"]["parent_ids"] == ["13"] and got["13"]["hierarchy"]["parent_count"] == 0
    chunks = {(x["conceptId"], x["section"]): x["text"] for x in concepts.concept_chunks(docs, TS).collect()}
    assert chunks["12", "synonyms"] == "Synonyms:\n- flu\n- Zorbitis\n" and "Parents:\n- 13: SNOMED 13" in chunks["12", "core"]
    lex = dictionary.lexicon(docs)
    assert {x["term"] for x in lex.collect()} == {"zorbitis", "flu"}
    text = spark.createDataFrame([("c1", "s1", "contraindications", "influenza flu"), ("c2", "s1", "contraindications", "has no flu"), ("c3", "s1", "description", "flu")], "chunk_id string, spl_set_id string, section string, text string")
    found = sorted((x["chunk_id"], x["char_start"], x["char_end"], x["confidence"], x["qualifiers"]["negated"]) for x in dictionary.condition_links(text, lex, TS).collect())
    assert found == [("c1", 2, 5, 0.6, False), ("c1", 10, 13, 0.6, False), ("c2", 7, 10, 0.6, True)]
    assert dictionary.condition_links(text, lex, TS, words=True).count() == 2


def test_resolve_and_crosswalk(spark):
    raw = spark.createDataFrame([("A", "1", "spl_set_id"), ("A", "2", "ndc11"), ("A", "99", "spl_set_id"), ("A", "100", "spl_set_id"), ("A", "x", "spl_set_id")], "spl_set_id string, rxcui string, via string")
    meta = spark.createDataFrame([("1", "IN", False), ("2", "SBD", False), ("99", "SCD", True), ("100", "SCD", True), ("x", "SCD", True)], "rxcui string, tty string, has_ndc boolean")
    got = links.resolve_links(raw, meta).first()
    assert (got["primary"]["rxcui"], got["primary"]["score"]) == ("99", 165)
    assert [(s["rxcui"], s["score"]) for s in got["secondary"]] == [("100", 165), ("x", 165), ("2", 100), ("1", -75)]
    assert links.label_to_drug(links.resolve_links(raw, meta)).first()["spl_set_id"] == "a"
    mention = spark.createDataFrame([("c", "A", "7", "indication", "s", 0.9, "flu", (False,), 1), ("c", "A", "7", "indication", "s", 0.6, "flu", (True,), 2)], "chunk_id string, spl_set_id string, snomed_id string, link_type string, section string, confidence double, match_text string, qualifiers struct<negated:boolean>, ord int")
    rolled = links.rollup(links.crosswalk(mention, links.resolve_links(raw, meta)), TS)
    row = rolled.where("rxcui = '99'").first()
    assert (row["spl_count"], row["chunk_count"], row["max_confidence"], row["examples"][0]["negated"]) == (1, 1, 0.9, False)
    graph = links.edges(rolled)
    assert links.strongest(graph, "snomed_id", min_labels=1, top=2).count() == 2
    assert links.strongest(graph, "rxcui", min_labels=1, blocklist=spark.createDataFrame([("7",)], "id string")).count() == 0
    assert links.generic_statistics(rolled).first()["degree_rx"] == 5


def test_link_fallback(spark):
    lab = spark.createDataFrame([(1, "s1", ["1234567890"]), (2, "s9", ["1234567890"]), (3, None, [])], "row_id int, spl_set_id string, ndcs array<string>")
    keys = spark.createDataFrame([("100", ["S1"], []), ("200", [], ["01234567890"])], "rxcui string, spl_set_ids array<string>, ndc11s array<string>")
    assert sorted(tuple(r) for r in links.label_drug_links(lab, keys).collect()) == [("s1", "100", "spl_set_id"), ("s9", "200", "ndc11")]


GOLD = [
    ("Can I take Zorvex with grapefruit?", "interaction", "zorvex", "grapefruit"), ("side effects of zorvexil extended", "adverse_effect", "zorvexil extended", None), ("Is zorvexil contraindicated in renal failure?", "contraindication", "zorvexil", "renal failure"),
    ("indications for Zorvex", "indication", "zorvex", None), ("dosage of zorvexil for children", "dosage", "zorvexil", "children"), ("boxed warning zorvex", "warning", "zorvex", None), ("tell me about zorvex", "overview", "zorvex", None), ("", "overview", None, None),
]


def test_questions(spark):
    lex = spark.createDataFrame([("zorvex",), ("zorvexil",), ("zorvexil extended",)], "key string")
    rows = spark.createDataFrame([(k, q) for k, (q, *_) in enumerate(GOLD)], "qid int, text string")
    got = {r["qid"]: (r["intent"], r["drug_text"], r["condition_text"]) for r in questions.parse_questions(rows, lex).collect()}
    assert [got[k] for k in range(len(GOLD))] == [g[1:] for g in GOLD]
    assert {r["qid"]: r["name"] for r in questions.names_in_questions(rows, lex).collect()}[1] == "zorvexil extended"
    native = rows.select("qid", questions.intent_of(F.col("text")).alias("i"))
    assert {r["qid"]: r["i"] for r in native.collect()} == {k: g[1] for k, g in enumerate(GOLD)}
    routes = {r["qid"]: r["route"] for r in questions.route_questions(rows).collect()}
    assert routes[2] == "safety" and routes[3] == "drug"
    bare = {r["qid"]: (r["drug_text"], r["condition_text"]) for r in questions.parse_questions(rows).collect()}
    assert bare[0] == ("Zorvex", "grapefruit") and bare[1] == ("zorvexil extended", None) and bare[6] == (None, None)
    again = questions.parse_questions(rows.unionByName(rows).unionByName(spark.createDataFrame([(99, None)], rows.schema)), lex)
    assert again.count() == 2 * len(GOLD) + 1 and again.where("qid = 99").first()["intent"] == "overview"


def test_sections_have_keys():
    keys = labels.heading_keys()
    assert len(keys) == len(K.LABEL_HEADINGS) + 1 and keys["general"] == "general_precautions" and keys["hepatic impairment"] == "hepatic_impairment"
    assert keys["animal pharmacology & or toxicology"] == "animal_pharmacology_and_toxicology" and keys["otc - ask doctor/pharmacist"] == "otc_ask_doctor_or_pharmacist"
    assert labels.slug("A & or B / C") == "a_and_b_c" and labels.slug("x_/_y  z/q") == "x_or_y_z_or_q" and labels.slug(" -- ") == ""


def test_doses():
    guide = "Take care. Recommended starting dose is 5 mg once daily. The maximum dose is 40 mg."
    assert evidence.dose_text(guide) == "Recommended starting dose is 5 mg once daily."
    assert evidence.dose_text("Give 5 mg twice daily.  No units here. Or 10 mg q8h! 3 mg bid.") == "Give 5 mg twice daily. Or 10 mg q8h!"
    assert evidence.dose_text("no dose ") == "no dose " and evidence.dose_text("") == ""


@pytest.fixture(scope="module")
def engine(spark):
    rows = [
        ("AAAAAAAA-0000-0000-0000-000000000001", "contraindications", "Zorvex is contraindicated in patients with severe renal impairment. Other text of no great interest here.", 0), ("AAAAAAAA-0000-0000-0000-000000000001", "dosage and administration", "The recommended starting dose is 10 mg once daily with meals for adults.", 1),
        ("AAAAAAAA-0000-0000-0000-000000000001", "description", "Zorvex is a white powder with no smell that dissolves in water.", 2), ("bbbbbbbb-0000-0000-0000-000000000002", "drug interactions", "Concomitant use with zorvex may increase the risk of bleeding in some patients.", 3),
    ]
    table = evidence.label_rows(spark.createDataFrame(rows, "spl_set_id string, section string, text string, ord int"))
    lex = spark.createDataFrame([("zorvex", "AAAAAAAA-0000-0000-0000-000000000001")], "key string, spl_set_id string")
    known = spark.createDataFrame([("aaaaaaaa-0000-0000-0000-000000000001", "100")], "spl_set_id string, rxcui string")
    return Engine(table, lex, known, encoder=vectors.hashing_encoder())


def test_retrieval(spark, engine):
    asked = spark.createDataFrame([("q1", "Is zorvex contraindicated in renal failure?"), ("q2", "dosage of zorvex"), ("q3", "can i take zorvex with aspirin"), ("q4", "is unknownium contraindicated in children")], "qid string, text string")
    got = {r["qid"]: r for r in engine.ask(asked).collect()}
    assert got["q1"]["drug"]["rxcui"] == "100" and [e["stage"] for e in got["q1"]["evidence"]] == [1]
    assert got["q1"]["evidence"][0]["snippet"].startswith("Zorvex is contraindicated")
    assert [e["stage"] for e in got["q2"]["evidence"]] == [1] and "10 mg" in got["q2"]["evidence"][0]["snippet"]
    assert [e["stage"] for e in got["q3"]["evidence"]] == [21] and got["q3"]["evidence"][0]["spl_set_id"].startswith("bbbb")
    assert got["q4"]["verdict"] == "insufficient-evidence" and got["q4"]["evidence"] == []
    made = {r["qid"]: r for r in engine.answer(asked).collect()}
    assert made["q1"]["title"] == "zorvex — Contraindications" and made["q1"]["bullets"][0]["citations"] == [1]
    assert made["q2"]["answer"].startswith("Usual dosing examples for zorvex: 10 mg once")
    assert [c["label"] for c in made["q1"]["citations"]][0].startswith("DailyMed (SPL")
    out = {r["qid"]: r["output"] for r in answer.format_cli(engine.answer(asked)).collect()}
    assert "Sources:" in out["q1"] and out["q1"].startswith("zorvex — Contraindications\n\n")


def test_grouping(spark):
    rows = spark.createDataFrame([(1, k, t, 1.0, k) for k, t in enumerate(["Acute Otitis Media", "Otitis Media", "Bacterial Otitis Media", "Fever"], 1)], "qid int, pos int, text string, score double, citation int")
    got = answer.group_bullets(rows).orderBy("pos").collect()
    assert [(r["text"], r["citations"]) for r in got] == [("Otitis Media — acute; bacterial", [1, 2, 3]), ("Fever", [4])]


def test_conditions(spark):
    lex = spark.createDataFrame([("renal failure", "1", "Renal failure"), ("otitis media acute", "2", "Acute otitis media")], "key string, snomed_id string, name string")
    terms = spark.createDataFrame([("1", "Renal failure (disorder)")], "snomed_id string, pt string")
    asked = spark.createDataFrame([(1, "Renal  Failure", "indication"), (2, "acute otitis", "indication"), (3, "zzz", "indication"), (4, "", ""), (5, "qqq", "adverse_effect")], "qid int, text string, intent string")
    hits = spark.createDataFrame([(3, 1, 0.0, "9", "Nine", "substance"), (5, 1, 1.0, "8", "Eight", "")], "qid int, rank int, distance double, snomed_id string, name string, tag string")
    got = {r["qid"]: r["condition"] for r in resolve.resolve_conditions(asked, lex, terms, hits).collect()}
    assert (got[1]["sctid"], got[1]["preferred_term"], got[1]["confidence"]) == ("1", "Renal failure (disorder)", 0.92)
    assert got[2]["sctid"] == "2" and got[2]["note"] == "Lexicon-fuzzy"
    assert got[3]["sctid"] is None and got[3]["note"] == "No tag-eligible hit" and got[4]["note"] == "Empty query"
    assert got[5]["sctid"] == "8" and got[5]["confidence"] == 0.75


def test_lexicons(spark):
    rows = spark.createDataFrame([("AAAAAAAA-0000-0000-0000-000000000001", {"title": "Zorvex Tablets", "other": "x"}, 1), ("bbbbbbbb-0000-0000-0000-000000000002", {"brand_name": "ZORVEX", "name": "of"}, 2)], "spl_set_id string, fields map<string,string>, ord int")
    got = {r["key"]: r["spl_set_id"] for r in resolve.drug_lexicon(rows).collect()}
    term = "struct<id:string,term:string,lang:string>"
    docs = spark.createDataFrame([("7", (("", " Fever 0 (finding)", "en"), None, [("", " hot 1", "en"), ("", "2 two 2", "en")]))], f"conceptId string, terms struct<fsn:{term},pt:map<string,struct<id:string,term:string>>,synonyms:array<{term}>>")
    assert [r["name"] for r in resolve.concept_names(docs).orderBy("ord").collect()] == ["Fever 0 (finding)", "hot 1", "2 two 2"]
    assert got == {"zorvex": "aaaaaaaa-0000-0000-0000-000000000001"}
    names_, pt = resolve.chunk_text_names("t")
    row = spark.createDataFrame([("X\nFSN: Zorbitis (disorder)\nSynonyms:\n- flu\n- grippe\n",)], "t string").select(names_.alias("n"), pt.alias("p")).first()
    assert row["n"] == ["Zorbitis (disorder)", "flu", "grippe"] and row["p"] == "Zorbitis (disorder)"


XML = """<document xmlns="urn:hl7-org:v3"><id root="d1"/><setId root="s1"/><versionNumber value="2"/><effectiveTime value="20240101"/><title>ZORVEX <b>x</b></title>
<author><representedOrganization><name>Acme</name></representedOrganization></author>
<component><structuredBody><component><section><code code="1" codeSystemName="LOINC" displayName="CONTRAINDICATIONS SECTION"/><title>4 CONTRAINDICATIONS</title>
<text>Lead<paragraph>one<br/>two <i>three</i> four</paragraph><paragraph>Pregnancy: avoid 1234-567-8</paragraph></text>
<component><section><code code="9" codeSystemName="X"/><text><list><item>a</item><item>b</item></list></text></section></component></section></component></structuredBody></component></document>"""


def test_labels(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.XML").write_text(XML)
    (tmp_path / "b.xml").write_text("<broken")
    row = labels.read_labels(spark, str(tmp_path)).collect()
    assert len(row) == 1 and row[0]["set_id"] == "s1" and row[0]["manufacturer"] == "Acme"
    assert row[0]["sections"] == {"contraindications": "Lead\n\none\ntwo three four", "pregnancy": "avoid 1234-567-8"} and row[0]["unclassified"] == {"9": "a\n\nb"}
    assert row[0]["product_ndc11"] == ["01234-0567-00"] and row[0]["package_ndc11"] == ["01234-0567-08"]
    assert labels.parse_label(XML.encode(), "p", strip_suffix=False)["sections"] == {"pregnancy": "avoid 1234-567-8"}
    assert labels.sections_of({"sections": {"unclassified": {"4 WARNINGS": "w"}, "uses": ["a", {"text": "b"}]}}) == {"uses": "a\n\nb", "warnings": "w"}
    assert labels.sections_of({"sections": {"unclassified": {"W": "w"}, "uses": "a"}}, only_unclassified=True) == {"w": "w"}
    assert labels.first_set_id({"a": {"set-id": ["x"]}}) == "x" and labels.all_packages({"x": {"ndc11s": ["1234-5678-90"]}}) == ["01234567890"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n\nbad\n// no\n[1]\n{"a": 2}\n')
    path = str(tmp_path / "a.jsonl")
    assert [r["a"] for r in files.read_jsonl(spark, path, schema="a int, b string").orderBy("ord").collect()] == [1, 2]
    assert files.read_jsonl(spark, path).count() == 2
    with pytest.raises(Exception):
        files.read_jsonl(spark, path, schema="a int", strict=True).collect()
    (tmp_path / "c.json").write_text('[{"a": 5}, {"a": 6}]')
    assert {r["a"] for r in files.read_json_any(spark, str(tmp_path / "c.json"), "a int").collect()} == {5, 6}
    (tmp_path / "r.rrf").write_text('1|x|"y|\n2|z\n')
    assert [tuple(r)[:3] for r in files.read_rrf(spark, str(tmp_path / "r.rrf"), ["A", "B", "C"]).orderBy("ord").collect()] == [("1", "x", '"y'), ("2", "z", "")]
    (tmp_path / "t.txt").write_text("\ufeffid\tactive\n1\t1\n")
    assert files.read_rf2(spark, str(tmp_path / "t.txt"), ["id", "active"]).first()["id"] == "1"
    with pytest.raises(ValueError):
        files.read_rf2(spark, str(tmp_path / "t.txt"), ["missing"])
    (tmp_path / "b.txt").write_text("# c\n 1 \n\n2\n")
    assert {r["id"] for r in files.read_blocklist(spark, str(tmp_path / "b.txt")).collect()} == {"1", "2"} and files.read_blocklist(spark, str(tmp_path / "none.txt")).count() == 0
    assert files.parse_payload("log {x}\n{'drug': {'a': 1}}\n{\"z\": 1}") == {"drug": {"a": 1}}
    df = spark.createDataFrame([(1, ["b", "a"], None)], "k int, l array<string>, n string")
    sinks.write_tsv(df, str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).where("value like '1%'").first()[0].startswith("1\ta,b")
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"k":1,"l":["b","a"]}'


def test_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "row_id int, vec array<float>")
    asked = spark.createDataFrame([(9, [0.0, 2.0])], "query_id int, qvec array<float>")
    for run in (vectors.search, vectors.search_by_expression):
        assert [(r["row_id"], r["score"]) for r in run(asked, rows, 3).orderBy("rank").collect()] == [(1, 2.0), (2, 2.0), (0, 0.0)]
        assert run(asked, rows, 1, "l2").first()["score"] == 1.0
    made = vectors.encode(spark.createDataFrame([(1, "a b"), (2, None)], "k int, t string"), "t", vectors.hashing_encoder(8)).orderBy("k").collect()
    assert sum(x * x for x in made[0]["vec"]) == pytest.approx(1.0) and set(made[1]["vec"]) == {0.0}


def test_inventories(spark):
    chunks = spark.createDataFrame([(1, "s1", ["Zorvex®", "ZORVEX"], ["zorvexil"]), (2, "s1", ["Zorvex"], []), (3, None, ["x"], [])], "chunk_id int, spl_set_id string, brand_names array<string>, generic_names array<string>")
    found = names.chunk_names(chunks)
    assert [tuple(r) for r in names.name_inventory(found).collect()] == [("zorvex", "mixed", 2, 1), ("zorvexil", "mixed", 1, 1)]
    assert names.coverage(chunks.select("spl_set_id"), found).first()["coverage"] == 100.0
