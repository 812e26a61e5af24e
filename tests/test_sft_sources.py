"""All SFT shapes of the question pairs come from one pass."""

import duckdb

from rewardmill.plans import record_queries as rq

SF_DIR = "/root/testdata/sf0.001"


def test_shapes_of_every_source_from_one_join(spark):
    made = rq.sft_pairs_sources(spark, SF_DIR)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Join ") == 1
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF_DIR}/conversations.parquet'")
    assert sorted(tuple(r) for r in made.collect()) == sorted(con.execute(rq.ORACLES["sft_pairs_sources"]).fetchall())
