"""Commands as plans: what a text is read as, and that each plan runs."""

import pytest
from pyspark.sql import DataFrame

from coordspark.operators.detect import Rules
from coordspark.plans import commands as c
from coordspark.plans import registry, tools

PLANS = {
    "run all clashes": c.Detect(Rules(max_gap=50.0, duplicates=True)),
    "find duplicates": c.Detect(Rules(hard=False, max_gap=0.0, duplicates=True)),
    "detect hard clashes only between west and structural": c.Detect(Rules("west", "structural", max_gap=0.0)),
    "check pipes against beams within 75 mm": c.Detect(Rules("pipes", "beams", max_gap=75.0)),
    "only soft please, run it": c.Detect(Rules(hard=False, max_gap=100.0)),
    "set the gap to 5 cm": c.SetRules(max_gap=50.0),
    "exclude duplicates": c.SetRules(duplicates=False),
    "turn on duplicates": c.SetRules(duplicates=True),
    "show closed clashes": c.Select((("status", "closed"),)),
    "show in progress": c.Select((("status", "in_progress"),)),
    "high priority": c.Select((("priority", "high"),)),
    "clear the filters": c.Select(),
    "sorted by level": c.Select(order=("storey",)),
    "sort by beauty": c.Nothing("sort_by"),
    "group by discipline": c.Group("discipline"),
    "group by distance": c.Nothing("group_by"),
    "analyze clashes": c.Analyse("summary"),
    "analyse the worst area": c.Analyse("worst_area"),
    "analyze by discipline": c.Analyse("by_discipline"),
    "what are the patterns": c.Analyse("patterns"),
    "how many clashes?": c.Metric("clash_count"),
    "how many issues": c.Metric("issue_count"),
    "count open": c.Metric("open_clashes"),
    "count by type": c.Metric("type_breakdown"),
    "make a report": c.Report(),
    "resolve all duplicates": c.Update((("type", "duplicate"),), (("status", "resolved"),)),
    "mark all soft as denied": c.Update((("type", "soft"),), (("status", "denied"),)),
    "color by floor": c.Colour("storey"),
    "export bcf to /x/y as 3.0": c.Exchange(True, "/x/y", "3.0"),
    "import the bcf from file:///a/b": c.Exchange(False, "file:///a/b"),
    "create project tower a": c.Project("tower a"),
    "rename project to bar": c.Project("bar", new=False),
    "top view": c.Nothing("set_view"),
    "hello": c.Nothing("help"),
}


@pytest.mark.parametrize("said", sorted(PLANS))
def test_plan_of_a_command(said):
    assert c.parse(said) == PLANS[said]


def test_duplicates_and_archives_by_command(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    e = registry.elements(spark, d)
    twice = e.unionByName(e.where("express_id < 5").selectExpr(*(f"{x} + 1000000 AS {x}" if x in ("express_id", "pos") else "'M9' AS model_id" if x == "model_id" else x for x in e.columns)))
    state = {"elements": twice, "models": registry.models(spark, d), "clashes": registry.clashes(spark, d).limit(0), "issues": registry.issues(spark, d).where("id < 20")}
    found = c.run("find duplicates", state)
    assert {r.type for r in found.collect()} == {"duplicate"} and found.count() == e.where("express_id < 5").count()
    assert isinstance(tools.call(state, "send_nl_command", text="show closed clashes"), DataFrame)
    c.run(f"export bcf to file://{tmp_path}/x", state)
    other = {**state, "issues": state["issues"].where("id < 10").selectExpr("cast(id as string) AS id", "title", "status", "priority")}
    after = c.run(f"import bcf from file://{tmp_path}/x", other)["issues"]
    assert after.count() == state["issues"].count() and after.where("length(id) = 36").count() == state["issues"].where("id >= 10").count()
