from pyspark.sql import functions as F

import corpus_pipeline as cp
from rewardmill.llm.mixing import uniform


def test_mixing_does_not_follow_the_draw_of_the_quality_stage(spark):
    """Documents whose number was large in the quality stage (seed 0) are kept as often as others."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    large = docs.filter(uniform(F.col("doc_id"), 0) > 0.9)
    share = cp.mixing(spark, large.union(docs.filter(uniform(F.col("doc_id"), 0) <= 0.9)), "").join(large, "doc_id", "left_semi").count() / large.count()
    assert 0.6 < share < 0.8
