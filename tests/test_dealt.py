"""Queries with costly steps on tables of few bytes run in all cores, and what they derive is derived once."""

import pytest

from sparkloom.functions import schema
from sparkloom.plans import catalogue
from sparkloom.sources import shared

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["task_issues", "item_issues", "option_issues", "click_issues", "rule_blocks", "rule_documents", "secret_item", "task_config"])
def test_rows_are_dealt(spark, name):
    """The table is read in one task; its rows go to all cores before the costly step."""
    got = catalogue.QUERIES[name](spark, SF)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["secret_item", "task_config"])
def test_json_is_parsed_once(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and "generate" in plan.lower()


def test_tasks_grow_with_rows(spark):
    assert shared.dealt(spark.range(100), rows=10).rdd.getNumPartitions() == 10
    assert shared.told_apart(spark.range(100).union(spark.range(100)), rows=20).count() == 100


def test_types_of_records_are_not_derived(spark):
    """Whether a value is a record or list is told by taking it apart; what is neither has its type named."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([('{"a":[{"b":1},null,[2]],"c":{"d":{}}}',), ('{"a":{"b":1},"c":null}',), ('[1]',), ('"x"',), ("{",), (None,)], "t string")
    some = schema.Record({"a": schema.Items(schema.Record({"b": schema.Int()})), "c": schema.Entries(schema.Items(schema.Int()))})
    got = [[(".".join(i.path), i.message) for i in r.x] for r in df.select(some.issues_of_json(F.col("t")).alias("x")).collect()]
    say = "Invalid input: expected {}, received {}".format
    assert got == [[("a.1", say("object", "null")), ("a.2", say("object", "array")), ("c.d", say("array", "object"))], [("a", say("array", "object")), ("c", say("record", "null"))], [("", say("object", "array"))], [("", say("object", "string"))], [("", "Invalid JSON")], [("", "Invalid JSON")]]
