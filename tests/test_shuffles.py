"""How often operators deal their rows out."""

from chainproof.operators import chains as C


def test_disambiguation_deals_candidates_by_chain_once(spark):
    rows = [(c, 0, p, e + c, 0.9 - e / 10) for c in range(4) for p in (0, 1, 3) for e in range(3)]
    candidates = spark.createDataFrame(rows, "chain_id long, branch_no int, pos long, entity_id long, score double")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 2)], "student_id long, teacher_id long")
    years = spark.createDataFrame([(e, 100 * e if e % 4 else None) for e in range(6)], "entity_id long, year int")
    hints = spark.createDataFrame([(2, 1)], "entity_id long, student_id long")
    out = C.disambiguate(candidates, edges, years, hints)
    got = {(r["chain_id"], r["pos"]): (r["entity_id"], r["support"]) for r in out.collect()}
    assert [got[0, p] for p in (0, 1, 3)] == [(1, 6), (2, 6), (0, 0)]  # nothing links over the gap before 3
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 2  # pairs with what is known of them, chains with their links
