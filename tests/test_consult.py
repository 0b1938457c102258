import json

import pytest
from pyspark.sql import functions as F

from peerlens.operators import graph, segments
from peerlens.plans import consult

MACROS = {"fin": ["fintech", "payments"], "food": ["food", "delivery"]}
Q = "query_id int, name string, one_liner string, categories array<string>, model string, country string, founded_year string, team_size string, stage string, cause string, secondary array<string>"
C = "company_id int, name string, description string, categories array<string>, macros array<string>, country string, founded_year string, headcount string, status string, cause string, cause_inferred boolean"


@pytest.fixture(scope="module")
def found(spark):
    queries = spark.createDataFrame(
        [
            (1, "Nova", "payments platform for small shops founded 2012 with card terminals and instant loans", ["fintech"], "saas", "Brazil", "", "", "", "Lack of Funds", ["Competition"]),
            (2, "Min", "food", [], "", "", "", "", "", "", []),
        ],
        Q,
    )
    companies = spark.createDataFrame(
        [
            (10, "Twin", "payments platform for shops with card terminals", ["Fintech", "SaaS"], ["fin"], "brazil", "2012", "11-50", "Inactive", "Lack of Funds", False),
            (11, "Far", "space rockets", ["space"], ["space"], "usa", "1990", "1000", "Active", "", False),
            (12, "Peer", "instant loans and payments", ["fintech"], ["fin"], "brazil", "2014", "", "Acquired", "Competition", True),
        ],
        C,
    )
    return queries, companies, consult.consult(queries, companies, MACROS).cache()


def test_matches_are_ranked_and_explained(found):
    _, _, m = found
    rows = m.where("query_id = 1").orderBy("final_rank").collect()
    assert [(r.company_id, r.outcome) for r in rows] == [(10, "dead"), (12, "acquired")]
    # a segment of three peers caps the confidence
    assert rows[0].convergence and rows[0].confidence == "medium" and "cause" in rows[0].reasons
    assert m.where("query_id = 2").count() == 0


def test_payload_report_and_graph(found, spark):
    q, c, m = found
    (p,) = consult.payload(m).collect()
    assert [x["name"] for x in json.loads(p.payload)["matches"]] == ["Twin", "Peer"]
    (r,) = consult.report(m).collect()
    assert r.report.splitlines()[0].startswith(" 1. Twin [dead]")
    from pyspark.sql import functions as F

    edges = graph.resemblance_edges(m, F.concat(F.lit("USER:"), "query_id"), F.concat(F.lit("COMPANY:"), "company_id"))
    assert {(e.target, e.relation) for e in edges.collect()} == {("COMPANY:10", "RESEMBLES_DEAD_CLONE"), ("COMPANY:12", "RESEMBLES_ACQUIRED")}
    d = {x.query_id: x.direction for x in consult.diagnosis(m, c, consult.analyzed(q, MACROS)).collect()}
    assert d[1] == "INCERTO"


def test_blocks_give_the_same(found):
    q, c, m = found
    rows = [r for part in consult.consult_in_blocks(q, c, MACROS, block=1) for r in part.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, m.collect()))


def test_integrated_graph(spark):
    n = spark.createDataFrame([("A", "company", ""), ("B", "company", "b")], "id string, type string, name string")
    e = spark.createDataFrame([("A", "B", "R")], "source string, target string, relation string")
    nodes, edges = graph.integrated(n, e, spark.createDataFrame([("A", "other", "filled"), ("C", "x", "c")], n.schema), e)
    assert {r.id: (r.type, r.name) for r in nodes.collect()} == {"A": ("company", "filled"), "B": ("company", "b"), "C": ("x", "c")}
    assert edges.count() == 1
    assert {(r.kind, r.key): r.n for r in graph.summary(nodes, edges).collect()} == {("node", "company"): 2, ("node", "x"): 1, ("edge", "R"): 1}


def test_words_are_corrected_and_claims_are_held_against_the_text(spark, found):
    q, c, _ = found
    a = consult.analyzed(q.withColumn("one_liner", F.replace("one_liner", F.lit("payments"), F.lit("paymants"))), MACROS)
    fixed = consult.corrected(a, spark.createDataFrame([("payments", 3), ("shops", 2)], "term string, df long"))
    words = {r.query_id: r.words for r in fixed.collect()}
    assert "payments" in words[1] and "paymants" not in words[1] and words[2] == ["min", "food"]
    models, causes = {"saas": ["software", "subscription"]}, {"Lack of Funds": ["ran out of cash"]}
    told = {r.query_id: (r.coherent, r.corroborated) for r in consult.coherence(a, models, causes).collect()}
    assert told == {1: (False, False), 2: (True, True)}
    trust = {r.query_id: r.segment_trust for r in consult.segment_trust(a, segments.cells(c.withColumn('outcome', F.lit('dead')))).collect()}
    assert trust == {1: 0.5, 2: 1.0}


def test_claims_without_words_count_less(found):
    q, c, plain = found
    less = consult.consult(q, c, MACROS, models={"saas": ["software"]}, causes={"Lack of Funds": ["ran out of cash"]})
    a, b = ({r.company_id: r for r in m.where("query_id = 1").collect()} for m in (plain, less))
    assert b[10].score < a[10].score and "model" not in b[10].reasons
    # a segment of three peers never gives high confidence
    assert a[10].confidence == b[10].confidence == "medium"


def test_consultation_reads_its_inputs_once(spark, monkeypatch):
    """What is joined to itself later is stored first, so that plans don't hold the companies' joins many times over."""
    from peerlens.plans import match_queries

    plans = []

    def noted(f):
        def call(first, *rest, **more):
            plans.append(first._jdf.queryExecution().optimizedPlan().toString())
            return f(first, *rest, **more)

        return call

    class Done(Exception):
        pass

    def stop(*_):
        raise Done

    monkeypatch.setattr(consult, "Corpus", noted(consult.Corpus))
    monkeypatch.setattr(consult, "corrected", noted(consult.corrected))
    monkeypatch.setattr(consult, "coherence", noted(stop))
    with pytest.raises(Done):
        match_queries.consult_run(spark, "/root/testdata/sf0.001")
    assert len(plans) == 3 and not any("Join" in p for p in plans)
