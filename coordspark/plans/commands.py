"""Commands as plans: a text is parsed to a plan object, and a plan compiles to a DataFrame or a new state.

A plan says what is asked for in typed fields and nothing about how it was said, so it can be compared, stored and run on
any state. A state is DataFrames by name (elements, models, clashes, issues, projects) and the detection rules.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordspark.operators import detect, merge, review
from coordspark.plans import tools

State = dict


@dataclass(frozen=True)
class Plan:
    """``compile`` gives the rows that answer, or the state after a change."""

    def compile(self, state: State) -> DataFrame | State:
        raise NotImplementedError


@dataclass(frozen=True)
class Detect(Plan):
    rules: detect.Rules

    def compile(self, state):
        return detect.run_detection(state["elements"], state["models"], self.rules)


@dataclass(frozen=True)
class SetRules(Plan):
    """The rules of later runs, changed in what is given."""

    max_gap: float | None = None
    duplicates: bool | None = None

    def compile(self, state):
        given = {k: v for k, v in (("max_gap", self.max_gap), ("duplicates", self.duplicates)) if v is not None}
        return {**state, "rules": replace(state.get("rules", detect.Rules()), **given)}


@dataclass(frozen=True)
class Select(Plan):
    """Clashes that meet all conditions, in order of the keys."""

    where: tuple[tuple[str, str], ...] = ()
    order: tuple[str, ...] = ()

    def compile(self, state):
        rows = review.with_filter(state["clashes"], **dict(self.where))
        return review.sort_clashes(rows, *self.order) if self.order else rows


@dataclass(frozen=True)
class Group(Plan):
    key: str

    def compile(self, state):
        return review.group_clashes(state["clashes"], self.key)


@dataclass(frozen=True)
class Analyse(Plan):
    focus: str = "summary"

    def compile(self, state):
        return review.FOCUS[self.focus](state["clashes"])


@dataclass(frozen=True)
class Metric(Plan):
    name: str = "clash_count"

    def compile(self, state):
        return review.METRICS[self.name](state["clashes"], state["issues"])


@dataclass(frozen=True)
class Report(Plan):
    def compile(self, state):
        return review.report(state["clashes"], state["issues"])


@dataclass(frozen=True)
class Update(Plan):
    """Set columns of the clashes that meet the conditions."""

    where: tuple[tuple[str, str], ...] = ()
    values: tuple[tuple[str, str], ...] = ()

    def compile(self, state):
        hit = review.with_filter(state["clashes"], **dict(self.where)).select("id")
        return {**state, "clashes": merge.batch_update(state["clashes"], hit, **dict(self.values))}


@dataclass(frozen=True)
class Colour(Plan):
    by: str = "ifc_type"

    def compile(self, state):
        return tools.call(state, "color_by", by=self.by)


@dataclass(frozen=True)
class Exchange(Plan):
    """Issue archives, out or in."""

    out: bool
    path: str | None = None
    version: str = "2.1"

    def compile(self, state):
        if self.out:
            return tools.call(state, "export_bcf", version=self.version, path=self.path)
        return tools.call(state, "import_bcf", path=self.path) if self.path is not None else state


@dataclass(frozen=True)
class Project(Plan):
    """A new project, or a new name for the one at hand (the first, if the state does not say which)."""

    name: str
    new: bool = True
    key: str | None = field(default=None, compare=False)

    def compile(self, state):
        projects = state["projects"]
        if self.new:
            row = projects.sparkSession.createDataFrame([(self.key or self.name, self.name)], "id string, name string")
            return {**state, "projects": projects.unionByName(row, allowMissingColumns=True)}
        current = state.get("project")
        chosen = projects.where(F.col("id") == current) if current is not None else projects.orderBy("id").limit(1)
        return {**state, "projects": merge.batch_update(projects, chosen.select("id"), name=self.name)}


@dataclass(frozen=True)
class Nothing(Plan):
    """A command of the viewer, or one that is not understood: no rows."""

    intent: str = "help"

    def compile(self, state):
        return state["clashes"].limit(0)


#: What people call the keys of sorts and groups.
_KEYS = {"floor": "storey", "level": "storey", "storey": "storey", "status": "status", "priority": "priority", "type": "type", "discipline": "discipline", "distance": "distance", "date": "date", "severity": "severity", "typea": "typeA", "typeb": "typeB"}
_GROUPS = ("storey", "typeA", "typeB", "status", "type", "discipline")
_METRICS = (
    ("worst_storey", r"\bworst\b|\bhot ?spot"), ("discipline_breakdown", r"\bdisciplines?\b"), ("type_breakdown", r"\btypes?\b"), ("status_breakdown", r"\bstatus(es)?\b"),
    ("issue_count", r"\bissues?\b"), ("open_clashes", r"\bopen\b"), ("clash_count", ""),
)
_FOCUS = (("worst_area", r"\bworst\b|\bhot ?spot|\barea\b"), ("by_discipline", r"\bdisciplines?\b"), ("patterns", r"\bpatterns?\b|\bpairs?\b|\btypes?\b"), ("summary", ""))


def _first(table: tuple[tuple[str, str], ...], text: str) -> str:
    return next(name for name, pattern in table if re.search(pattern, text))


def parse(text: str) -> Plan:
    """The plan of a command."""
    said, lower = tools.read_command(text), text.lower()
    intent = said.pop("intent")
    if intent == "run_detection":
        return Detect(detect.Rules.from_request(said))
    if intent == "set_max_gap":
        return SetRules(max_gap=said["maxGap"])
    if intent == "set_duplicates":
        return SetRules(duplicates="off" not in said)
    if intent in ("filter_status", "filter_priority"):
        return Select(where=tuple(said.items()))
    if intent == "reset_filters":
        return Select()
    if intent == "sort_by" and said["by"] in _KEYS:
        return Select(order=(_KEYS[said["by"]],))
    if intent == "group_by" and _KEYS.get(said["by"]) in _GROUPS:
        return Group(_KEYS[said["by"]])
    if intent == "analyze_clashes":
        return Analyse(_first(_FOCUS, lower))
    if intent == "query":
        return Metric(_first(_METRICS, lower))
    if intent == "generate_report":
        return Report()
    if intent == "batch_update":
        where = {"duplicates": (("type", "duplicate"),), "soft": (("type", "soft"),), "hard": (("type", "hard"),), "all": ()}[said["filter"]]
        status = {"resolve": "resolved", "close": "closed"}.get(said["action"], said.get("value", "resolved"))
        return Update(where, (("status", status),))
    if intent == "color_by":
        return Colour({"type": "ifc_type", "floor": "storey", "level": "storey", "model": "model_id"}.get(said.get("by", "type"), said.get("by", "ifc_type")))
    if intent in ("export_bcf", "import_bcf"):
        path = re.search(r"\b(?:from|to|in|into)\s+((?:\w+:)?/\S+)", text)
        return Exchange(intent == "export_bcf", path and path[1], "3.0" if re.search(r"\b3(\.0)?\b", lower) else "2.1")
    if intent in ("create_project", "rename_project"):
        return Project(said["name"].strip(), intent == "create_project")
    return Nothing(intent)


def run(text: str, state: State) -> DataFrame | State:
    return parse(text).compile(state)
