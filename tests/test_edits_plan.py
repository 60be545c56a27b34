"""Expressions of edit states name each value once, or nearly so."""

import time

from pyspark.sql import functions as F

from shutterlake.functions import columns as C, edits as E
from shutterlake.plans import registry

SF = "/root/testdata/sf0.001"


def test_texts_are_parsed_once_for_each_state(spark):
    plan = registry.QUERIES["edit_json_round_trip"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 2 and plan.count("not json") == 1


def test_chains_are_parsed_once(spark):
    df = spark.range(1).select(C.filter_steps(F.concat(F.lit("a=1;b=2,x;a="), F.col("id").cast("string"))).alias("m"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert df.first().m == {"a": ["0"], "b": ["2", "x"]}


def test_steps_grow_in_proportion(spark):
    chain = "tilt=1,0.5;finetune2=1,0.9,0.4,-1,0.3;fill=1,0.5;warmth=1,-1;lumi=1,-0.3;autolight=1,1;sat=1,0.9;softfocus=1,0.5"
    began = time.time()
    rows = spark.range(1).select(C.filter_steps(F.lit(chain)).alias("f"))
    steps = rows.select(E.edit_steps(F.lit(1), F.lit(None).cast("struct<left:double,top:double,right:double,bottom:double>"), "f").alias("s"))
    assert len(steps._jdf.queryExecution().analyzed().toString()) < 40_000 and time.time() - began < 60
    got = [(s.label[7:], round(s.state.brightness, 3), round(s.state.contrast, 3), round(s.state.color_red, 3), round(s.state.color_blue, 3), round(s.state.saturation, 3)) for s in steps.first().s]
    assert got == [
        ("rotate", 0, 0, 0, 0, 0), ("tilt", 0, 0, 0, 0, 0), ("finetune2", 0.9, 0.2, -0.15, 0.15, 0.3), ("fill", 1, 0.2, -0.15, 0.15, 0.3), ("warmth", 1, 0.2, -0.35, 0.35, 0.3),
        ("lumi", 0.7, 0.2, -0.35, 0.35, 0.3), ("autolight", 0.85, 0.4, -0.35, 0.35, 0.3), ("sat", 0.85, 0.4, -0.35, 0.35, 1), ("softfocus", 0.85, 0.4, -0.35, 0.35, 1),
    ]
