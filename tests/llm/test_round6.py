"""No side of a join that grows with the documents is broadcast."""

from ledgerloom.llm import simhash


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_few_fingerprints_are_not_broadcast(spark, tmp_path):
    # a fingerprint becomes some 70 rows, but Spark takes them for as small as the file of fingerprints
    spark.range(200).selectExpr("xxhash64(id) AS fp").write.parquet(str(tmp_path / "fps"))
    plan = plan_of(simhash.links(spark.read.parquet(str(tmp_path / "fps"))))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_rows_of_all_documents_are_not_broadcast(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('one two ', id % 40) AS text", "'k' AS key")
    got = simhash.near_duplicates(docs, carry="key")
    assert "Broadcast" not in plan_of(got)
    assert got.count() == 300 and got.select("fp").distinct().count() == 40
