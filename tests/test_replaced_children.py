import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_rows_of_reloaded_flyers_are_not_sorted(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()["replaced_children"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if "Join" in line and ("LeftAnti" in line or "LeftSemi" in line)]
    assert len(joins) == 2 and all("ShuffledHashJoin" in line for line in joins)
