"""The registered user reward: its values, and that texts do not become Python objects in its workers."""

import re

from pyspark.sql import functions as F

from rewardmill.plans import scoring_queries as sq
from rewardmill.plans import views as v

SF_DIR = "/root/testdata/sf0.001"


def test_brevity_by_row(spark):
    # A missing reward adds nothing; format adds 1 at most.
    scored = sq.user_reward_udf(spark, SF_DIR)
    rows = v.rollouts(spark, SF_DIR).select(*sq.KEY, (1 - F.length("completion") / F.col("target_length")).alias("share"))
    both = scored.join(rows, sq.KEY)
    wrong = both.filter(~F.col("brevity").eqNullSafe(F.when(F.col("share") >= 0, F.round("share", 6))))
    assert wrong.count() == 0
    assert both.filter("brevity is null").count() > 0 and both.filter("brevity is not null").count() > 0


def test_texts_stay_in_arrow(spark):
    plan = sq.user_reward_udf(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    kinds = re.findall(r"ArrowEvalPython \[brevity.*?\], (\d+)", plan)
    assert kinds and set(kinds) == {"250"}  # a scalar Arrow function; a pandas one is 200
