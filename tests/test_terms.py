"""Mentions against a plain version of the rules."""

import re

from quillgraph.operators.terms import entity_mentions

ENTITIES = [
    ("region", "Region", ["area", "land mass"], None, None, None),
    ("business-date", "Business Date", None, ["business-date"], None, "current"),
    ("date", "Date", [], [], ["business-date"], "current"),
    ("policy", "Policy", None, None, None, "auto"),
    ("ghost", "Ghost", ["spirit"], None, None, "candidate"),
    ("myapp", "MyApp", None, None, None, "current"),
]
FUNCTIONS = [
    ("app/run().", "Returns the regions of MyApp"),
    ("app/BusinessDates#next().", "see [[entity-policy]]"),
    ("app/date/Parser#parse().", None),
    ("app/Policies#list().", "no word"),
    ("app/Ghost#go().", "a spirit of the ghosts"),
    ("myapp/main().", "MyApp itself"),
    ("myapp/Area#size().", ""),
    ("lib/PolicyBook#Page#turn().", "x"),
    ("lib/PolicyBook().", "x"),
    ("a/the_dates().", "of dates"),
    ("a/the_dates().", "of dates"),
]
SCHEMA = "id string, display string, synonyms array<string>, code_terms array<string>, code_veto array<string>, status string"


def mentions(spark, **given):
    entities = spark.createDataFrame(ENTITIES, SCHEMA)
    functions = spark.createDataFrame(FUNCTIONS, "symbol string, doc_comment string")
    found = entity_mentions(functions, entities, **given).collect()
    out = {(r.src, r.dst): r.confidence for r in found}
    assert len(out) == len(found)
    return out


def test_names_phrases_and_vetoes(spark):
    got = mentions(spark)
    assert got == {
        ("app/run().", "region"): "high",
        ("app/run().", "myapp"): "high",
        ("app/BusinessDates#next().", "policy"): "high",
        ("app/BusinessDates#next().", "business-date"): "low",  # bound by its phrase; date is vetoed
        ("app/date/Parser#parse().", "date"): "low",
        ("app/Policies#list().", "policy"): "low",
        ("myapp/main().", "myapp"): "high",
        ("myapp/Area#size().", "region"): "low",
        ("myapp/Area#size().", "myapp"): "low",
        ("lib/PolicyBook#Page#turn().", "policy"): "low",
        ("lib/PolicyBook().", "policy"): "low",
        ("a/the_dates().", "date"): "high",
    }
    assert not any(re.search("ghost", e) for _, e in got)


def test_types_hand_down_and_own_entity_gives_way(spark):
    types = spark.createDataFrame([("app/date#",), ("lib/PolicyBook#",), ("lib/Other#",), ("app/Parser#",)], "symbol string")
    got = mentions(spark, types=types, own="myapp", stop=("area",))
    assert ("app/run().", "myapp") not in got and got["myapp/main().", "myapp"] == "low" and ("myapp/Area#size().", "region") not in got
    assert got["app/date/Parser#parse().", "date"] == "low" and got["lib/PolicyBook#Page#turn().", "policy"] == "low"
    only = spark.createDataFrame([("pricing/date#Sub#",)], "symbol string")
    assert mentions(spark, types=only) == mentions(spark)
    functions = spark.createDataFrame([("m/Policy#x().", ""), ("m/Policyx#y().", ""), ("m/Policy().", "")], "symbol string, doc_comment string")
    entities = spark.createDataFrame([("policy", "policy", None, ["policy"], None, None)], SCHEMA)
    t = spark.createDataFrame([("m/Policy#",)], "symbol string")
    assert sorted(r.src for r in entity_mentions(functions, entities, t).collect()) == ["m/Policy#x().", "m/Policy()."]


def test_nothing(spark):
    entities, functions = spark.createDataFrame([], SCHEMA), spark.createDataFrame(FUNCTIONS, "symbol string, doc_comment string")
    assert entity_mentions(functions, entities).count() == 0
    assert entity_mentions(functions.limit(0), spark.createDataFrame(ENTITIES, SCHEMA)).count() == 0
