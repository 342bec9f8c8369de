"""The tools that answer or change data, and a deterministic reading of commands.

A tool is a function of a state (DataFrames by name) and arguments; query tools return a DataFrame, change tools a new
state. Viewer-only tools have no data behind them and are not here.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordspark.operators import detect, merge, quality, review, spatial
from coordspark.sources import bcf

State = dict[str, DataFrame]


@dataclass(frozen=True)
class Tool:
    name: str
    run: Callable[..., DataFrame | State]
    changes: bool
    parameters: dict[str, str]


TOOLS: dict[str, Tool] = {}


def tool(name: str, /, changes: bool = False, **parameters: str):
    def register(f):
        TOOLS[name] = Tool(name, f, changes, parameters)
        return f

    return register


def call(state: State, name: str, /, **arguments) -> DataFrame | State:
    return TOOLS[name].run(state, **arguments)


def manifest() -> list[dict]:
    """Tool declarations with their parameters as JSON Schema."""
    return [{"name": t.name, "parameters": {"type": "object", "properties": {k: {"type": v} for k, v in t.parameters.items()}}} for t in TOOLS.values()]


@tool("get_status")
def _status(s):
    return review.session_status(s["models"], s["elements"], s["clashes"], s["issues"])


@tool("get_clashes", status="string", limit="integer")
def _clashes(s, status=None, limit=None):
    return review.clash_list(s["clashes"], status, limit or 50)


@tool("get_issues", status="string")
def _issues(s, status=None):
    return review.issue_list(s["issues"], status)


@tool("list_storeys")
def _storeys(s):
    return review.storeys_seen(s["elements"])


@tool("get_model_info", name="string")
def _model(s, name=""):
    return review.fuzzy(s["models"], name, lone=True)


@tool("get_model_bounds", name="string")
def _bounds(s, name=None):
    models = s["models"] if not name else review.fuzzy(s["models"], name)
    return spatial.model_bounds(s["elements"].join(models.select("model_id"), "model_id", "left_semi"))


@tool("list_2d_sheets")
def _sheets(s):
    return review.annotations_per_sheet(s["sheets"], s["markups"])


@tool("run_data_quality", suite="string")
def _quality(s, suite="general"):
    return quality.run_suite(s["elements"], suite)


@tool("run_detection", modelA="string", modelB="string", maxGap="number", hard="boolean", duplicates="boolean", excludeSelf="boolean")
def _detect(s, **request):
    return detect.run_detection(s["elements"], s["models"], detect.Rules.from_request(request))


@tool("isolate_elements", ifc_type="string", storey="string", discipline="string", material="string", ids="array")
def _isolate(s, **wanted):
    return review.isolate(s["elements"], s["models"], **wanted)


@tool("filter_clashes", status="string", priority="string")
def _filter(s, **wanted):
    return review.with_filter(s["clashes"], **wanted)


@tool("sort_clashes", by="string")
def _sort(s, by="status"):
    return review.sort_clashes(s["clashes"], by)


@tool("group_clashes", by="string")
def _group(s, by="storey"):
    return review.group_clashes(s["clashes"], by)


@tool("color_by", by="string")
def _color(s, by="ifc_type"):
    return s["elements"].select(by).distinct().withColumn("group", F.dense_rank().over(review.Window.orderBy(by)))


@tool("measure_on_sheet", sheet="string")
def _measure(s, sheet=None):
    from coordspark.functions import text

    p = F.col("points")
    length = F.sqrt((p[2] - p[0]) ** 2 + (p[3] - p[1]) ** 2)
    return s["markups"].where(F.col("sheet_id") == sheet).select("id", text.measure_label(length).alias("label"))


def _with(s: State, **frames: DataFrame) -> State:
    return {**s, **frames}


@tool("update_clash", changes=True, id="integer", status="string", priority="string", assignee="string")
def _update_clash(s, id, **values):
    return _with(s, clashes=merge.update_one(s["clashes"], "id", id, **values))


@tool("batch_update_clashes", changes=True, ids="array", status="string", priority="string", assignee="string")
def _batch(s, ids, **values):
    spark = s["clashes"].sparkSession
    frame = ids if isinstance(ids, DataFrame) else spark.createDataFrame([(i,) for i in ids], "id bigint")
    return _with(s, clashes=merge.batch_update(s["clashes"], frame, **values))


@tool("update_issue", changes=True, id="string", status="string", priority="string", assignee="string")
def _update_issue(s, id, **values):
    return _with(s, issues=merge.update_one(s["issues"], "id", id, **values))


@tool("create_issue", changes=True, id="string", title="string", status="string", priority="string")
def _create_issue(s, **values):
    row = {"status": "open", "priority": "normal"} | values
    frame = s["issues"].sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"{k} {s['issues'].schema[k].dataType.simpleString()}" for k in row))
    return _with(s, issues=s["issues"].unionByName(frame, allowMissingColumns=True))


@tool("delete_issue", changes=True, id="string")
def _delete_issue(s, id):
    return _with(s, issues=s["issues"].where(~F.col("id").eqNullSafe(id)))


@tool("delete_model", changes=True, name="string")
def _delete_model(s, name):
    models, elements = merge.delete_cascade(s["models"], s["elements"], review.fuzzy(s["models"], name).select("model_id"), "model_id", "model_id")
    return _with(s, models=models, elements=elements)


@tool("rename_model", changes=True, name="string", to="string")
def _rename(s, name, to):
    hit = review.fuzzy(s["models"], name).select("model_id")
    return _with(s, models=merge.batch_update(s["models"], hit, "model_id", name=to))


@tool("toggle_model", changes=True, name="string", visible="boolean")
def _toggle(s, name, visible=True):
    hit = review.fuzzy(s["models"], name).select("model_id")
    return _with(s, models=merge.batch_update(s["models"], hit, "model_id", visible=visible))


def _append(section: str):
    def run(s, **row):
        frame = s[section].sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"{k} {s[section].schema[k].dataType.simpleString()}" for k in row))
        return _with(s, **{section: s[section].unionByName(frame, allowMissingColumns=True)})

    return run


tool("create_project", changes=True, id="string", name="string")(_append("projects"))
tool("create_2d_sheet", changes=True, id="string", name="string")(_append("sheets"))
tool("add_annotation", changes=True, id="string", sheet_id="string", text="string")(_append("markups"))


@tool("switch_project", name="string")
def _switch(s, name):
    return review.fuzzy(s["projects"], name, order="id")


@tool("delete_sheet", changes=True, id="string")
def _delete_sheet(s, id):
    gone = s["sheets"].where(F.col("id") == id).select("id")
    sheets, markups = merge.delete_cascade(s["sheets"], s["markups"], gone, "id", "sheet_id")
    return _with(s, sheets=sheets, markups=markups)


@tool("set_detection_rules", changes=True, modelA="string", modelB="string", maxGap="number", hard="boolean", duplicates="boolean")
def _rules(s, **request):
    return {**s, "rules": detect.Rules.from_request(request)}


@tool("export_bcf", version="string", path="string")
def _export(s, version="2.1", path=None):
    """Issues if there are any, else clashes: their documents, written as archives where a path is given."""
    rows = s["issues"] if s["issues"].limit(1).count() else s["clashes"]
    for name in ("title", "status", "priority", "description"):
        rows = rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast("string"))
    if path is not None:
        bcf.write_archives(rows, path, version)
    return bcf.topic_documents(rows, version)


@tool("import_bcf", changes=True, path="string")
def _import(s, path):
    """The topics of archives join the issues; an issue that is there already stays as it is."""
    issues = s["issues"]
    found = bcf.read_archives(issues.sparkSession, path).withColumnRenamed("topic", "id")
    kept = [F.col(c).cast(issues.schema[c].dataType).alias(c) for c in issues.columns if c in found.columns]
    own = issues.select(bcf.topic_id(F.col("id").cast("string")).alias("id")).unionByName(issues.select(F.col("id").cast("string")))
    new = found.join(own, "id", "left_anti").select(*kept)
    return _with(s, issues=issues.unionByName(new, allowMissingColumns=True))


@tool("analyze_clashes", focus="string")
def _analyse(s, focus="summary"):
    return review.FOCUS[focus](s["clashes"])


@tool("query_metric", metric="string")
def _metric(s, metric="clash_count"):
    return review.METRICS[metric](s["clashes"], s["issues"])


@tool("generate_report")
def _report(s):
    return review.report(s["clashes"], s["issues"])


@tool("send_nl_command", text="string")
def _command(s, text):
    """The rows, or the state, of the plan that a text is read as."""
    from coordspark.plans import commands

    return commands.run(text, s)


_STATUS = r"\b(open|confirmed|denied|in[_ ]progress|resolved|closed|approved)\b"


# Further intents by phrase, in order of precedence; named groups are their arguments.
PHRASES = (
    ("set_duplicates", r"\b(?:(?P<off>exclude|disable|ignore|without|turn off)|include|enable|turn on)\b.*\bduplicates?\b"),
    ("import_bcf", r"\b(?:import|load|open|bring in)\b.*\bbcf\b"),
    ("load_model", r"\b(?:load|open|add|upload)\b.*\b(?:ifc|models?|file|building)\b"),
    ("create_project", r"\b(?:new|create|start)(?: a)? project(?: called| named)?\s+(?P<name>.+)"),
    ("rename_project", r"\brename(?: this| the)? project(?: to)?\s+(?P<name>.+)"),
    ("batch_update", r"\b(?P<action>resolve|close|mark)\b.*\b(?P<filter>duplicates|soft|hard|all)\b(?:.*\bas (?P<value>\w+))?"),
    ("filter_priority", r"\b(?:show|only|filter)\b.*\b(?P<priority>critical|high|normal|low)\b"),
    ("analyze_clashes", r"\banaly[sz]e\b|\bsummar\w+|\bbreakdown\b|\bpatterns?\b|\bworst\b"),
    ("save_viewpoint", r"\b(?:save|capture|bookmark)\b.*\bview(?:point)?\b"),
    ("measure", r"\b(?P<mode>stop|clear)\b.*\bmeasur\w+|\bmeasure\b"),
    ("set_section", r"\b(?:section|cut)\b(?:.*\b(?P<axis>[xyz])\b)?"),
    ("color_by", r"\bcolou?rs?\b(?: by (?P<by>\w+))?"),
    ("set_theme", r"\b(?P<theme>dark|night|light|bright) mode\b"),
    ("set_render_style", r"\b(?P<style>wire ?frame|shaded|rendered|realistic)\b"),
    ("set_visibility_option", r"\b(?P<do>show|hide)\b.*\b(?P<option>grid|axes|markers)\b"),
    ("restore_visibility", r"\b(?:show|unhide|restore) all\b|\bunghost\b|\bundo hide\b"),
    ("navigate_tab", r"^(?:go to|show|open(?=.* tab$))(?: the)?\s+(?P<tab>models|clashes|issues|navigator|ai)(?: tab)?$"),
    ("set_view", r"\b(?P<view>top|front|back|left|right|isometric|iso|reset)(?: view)\b"),
)


def read_command(text: str) -> dict:
    """The intent of a plain command by fixed phrases; 'help' if none fits."""
    t = text.lower()
    gap = re.search(r"(\d+(?:\.\d+)?)\s*(mm|cm|m)\b", t)
    gap_mm = float(gap[1]) * {"mm": 1, "cm": 10, "m": 1000}[gap[2]] if gap else None
    if re.search(r"\b(run|detect|check|find)\b", t) and not re.search(r"\bquality\b", t):
        out = {"intent": "run_detection", "hard": True, "maxGap": 0.0, "duplicates": False}
        if re.search(r"\ball clashes\b|\beverything\b|\bfull check\b", t):
            out |= {"maxGap": gap_mm or 50.0, "duplicates": True}
        elif re.search(r"\bduplicates?\b", t):
            out |= {"hard": False, "duplicates": True}
        elif re.search(r"\bonly (soft|near misses)\b|\bclearance only\b", t):
            out |= {"hard": False, "maxGap": gap_mm or 100.0}
        elif re.search(r"\bsoft\b|\bnear miss|\bclearance\b|\bproximity\b|\bwithin\b", t):
            out |= {"maxGap": gap_mm or 50.0}
        sides = re.search(r"(?:between|check)\s+(.+?)\s+(?:and|vs\.?|against)\s+(.+?)(?:,|$|\s+within\b|\s+hard\b)", t)
        if sides:
            out |= {"modelA": sides[1], "modelB": sides[2]}
        return out
    if gap_mm is not None and re.search(r"\bgap\b", t):
        return {"intent": "set_max_gap", "maxGap": gap_mm}
    if re.search(r"\bexport\b.*\bbcf\b", t):
        return {"intent": "export_bcf"}
    if m := re.search(r"\bgroup(?:ed)? by (\w+)", t):
        return {"intent": "group_by", "by": m[1]}
    if m := re.search(r"\bsort(?:ed)? by (\w+)", t):
        return {"intent": "sort_by", "by": m[1]}
    if m := re.search(r"\b(critical|high|normal|low)\b.*\bpriority\b|\bpriority\b.*\b(critical|high|normal|low)\b", t):
        return {"intent": "filter_priority", "priority": m[1] or m[2]}
    if re.search(r"\b(reset|clear)\b.*\bfilters?\b", t):
        return {"intent": "reset_filters"}
    if re.search(r"\breport\b", t):
        return {"intent": "generate_report"}
    if re.search(r"\bhow many\b|\bcount\b|\bstatus\?", t):
        return {"intent": "query"}
    for intent, pattern in PHRASES:
        if m := re.search(pattern, t):
            return {"intent": intent} | {k: v for k, v in m.groupdict().items() if v is not None}
    if m := re.search(_STATUS, t):
        return {"intent": "filter_status", "status": m[1].replace(" ", "_")}
    return {"intent": "help"}
