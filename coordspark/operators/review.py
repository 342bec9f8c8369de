"""Review of clashes and issues: lists, filters, sorts, groups, counts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordspark.functions import text

PRIORITIES = ("critical", "high", "normal", "low")
SORT_KEYS = ("status", "priority", "storey", "typeA", "typeB", "type", "date", "distance", "severity")
OPEN_CLASH, OPEN_ISSUE = ("open", "confirmed", "in_progress"), ("open", "in_progress")


def storey(a: str = "elem_a_storey", b: str = "elem_b_storey") -> Column:
    return F.coalesce(F.nullif(F.col(a), F.lit("")), F.nullif(F.col(b), F.lit("")), F.lit("Unknown"))


def priority_rank(c: str = "priority") -> Column:
    out = F.lit(len(PRIORITIES))
    for i, p in reversed(list(enumerate(PRIORITIES))):
        out = F.when(F.col(c) == p, i).otherwise(out)
    return out


def with_filter(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality filters; None and 'all' filter nothing."""
    for column, value in wanted.items():
        if value not in (None, "all"):
            df = df.where(F.col(column) == value)
    return df


def clash_list(clashes: DataFrame, status: str | None = None, limit: int = 50, order: list[str] = ("id",)) -> DataFrame:
    """The first ``limit`` clashes of a status with their index, and the total before the limit. The limit is the feature.

    A clash without a title has its ai_title, or 'Clash n' by its place in the list.
    """
    chosen = with_filter(clashes, status=status)
    total = chosen.count()
    top = chosen.orderBy(*order).limit(limit)
    index = F.row_number().over(Window.orderBy(*order)) - 1  # of at most ``limit`` rows
    titles = [F.nullif(F.col(c), F.lit("")) for c in ("title", "ai_title") if c in clashes.columns]
    title = F.coalesce(*titles, F.concat(F.lit("Clash "), (index + 1).cast("string")))
    return top.select((index).alias("index"), "id", title.alias("title"), F.coalesce("status", F.lit("open")).alias("status"), F.coalesce("priority", F.lit("normal")).alias("priority"), "type", "distance_mm", F.lit(total).cast("bigint").alias("total"))


def issue_list(issues: DataFrame, status: str | None = None, compat: bool = False) -> DataFrame:
    """Issues by status; ``compat`` ignores the status."""
    return issues if compat else with_filter(issues, status=status)


def open_work(clashes: DataFrame, issues: DataFrame) -> DataFrame:
    """id, kind of what is still to do."""
    a = clashes.where(F.col("status").isin(*OPEN_CLASH)).select("id", F.lit("clash").alias("kind"))
    return a.unionByName(issues.where(F.col("status").isin(*OPEN_ISSUE)).select("id", F.lit("issue").alias("kind")))


def reviewed(clashes: DataFrame, issues: DataFrame) -> DataFrame:
    """Clashes, and issues that came from one, that are no longer open."""
    both = clashes.unionByName(issues.where("source = 'clash'"), allowMissingColumns=True)
    return both.where(~F.col("status").eqNullSafe("open"))


def session_status(models: DataFrame, elements: DataFrame, clashes: DataFrame, issues: DataFrame) -> DataFrame:
    """model_id, name, elements per model with the numbers of clashes, open clashes (not resolved, nulls count) and issues."""
    per_model = models.join(elements.groupBy("model_id").agg(F.count("*").alias("elements")), "model_id", "left")
    c = clashes.agg(F.count("*").alias("n"), F.count_if(~F.col("status").eqNullSafe("resolved")).alias("o")).first()
    return per_model.select("model_id", "name", F.coalesce("elements", F.lit(0)).alias("elements"), F.lit(c.n).cast("bigint").alias("clashes"), F.lit(c.o).cast("bigint").alias("open_clashes"), F.lit(issues.count()).cast("bigint").alias("issues"))


def isolate(elements: DataFrame, models: DataFrame, ifc_type: str | None = None, storey: str | None = None, discipline: str | None = None, material: str | None = None, ids: list[int] | None = None) -> DataFrame:
    """Elements that meet all given conditions; material is a case-sensitive part."""
    out = with_filter(elements, ifc_type=ifc_type, storey=storey)
    if discipline is not None:
        out = out.join(models.where(F.col("discipline") == discipline), "model_id", "left_semi")
    if material is not None:
        out = out.where(F.col("material").contains(material))
    if ids is not None:
        out = out.where(F.col("express_id").isin(ids))
    return out


def hidden_groups(elements: DataFrame, chosen: DataFrame, group: str = "ifc_type") -> DataFrame:
    """Classification groups with any chosen element; matches on the id across models."""
    return elements.join(chosen.select("express_id"), "express_id", "left_semi").select(group).distinct()


def fuzzy(df: DataFrame, wanted: str, column: str = "name", order: str = "pos", lone: bool = False) -> DataFrame:
    """The best match: equal without case first, then part of the name, then the first in order. ``lone``: the only row there is matches any name."""
    name = F.lower(F.col(column))
    if lone and df.limit(2).count() == 1:
        return df
    return df.where(name.contains(wanted.lower())).orderBy((name == wanted.lower()).desc(), order).limit(1)


def model_side(models: DataFrame, selector: str) -> DataFrame:
    """Models of one side of a run: 'all', or '+'-joined name parts and disciplines."""
    if selector.strip().lower() == "all":
        return models
    terms = [t.strip().lower() for t in selector.split("+") if t.strip()]
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.lower("name").contains(t) | (F.lower("discipline") == t)
    return models.where(hit)


def storeys_seen(elements: DataFrame) -> DataFrame:
    """model_id, storey, first_pos: distinct storeys in the order they were first seen."""
    return elements.where("storey != ''").groupBy("model_id", "storey").agg(F.min("pos").alias("first_pos"))


def discipline_of(elements: DataFrame, disciplines: dict[str, str]) -> DataFrame:
    """model_id, discipline: that of most elements; architectural if none is known. Ties go to the first by name."""
    kinds = F.create_map(*(F.lit(x) for pair in disciplines.items() for x in pair))
    counted = elements.withColumn("d", kinds[F.col("ifc_type")]).where("d is not null").groupBy("model_id", "d").count()
    best = counted.groupBy("model_id").agg(F.min(F.struct(-F.col("count"), "d")).alias("b"))
    return elements.select("model_id").distinct().join(best, "model_id", "left").select("model_id", F.coalesce("b.d", F.lit("architectural")).alias("discipline"))


def link_key(name: str = "link_name", instance: str = "link_instance_id") -> Column:
    """Which linked model an element belongs to; null is the host."""
    return F.when(F.col(name).isNotNull(), F.concat_ws("#", F.col(name), F.col(instance)))


def shared_record(df: DataFrame) -> DataFrame:
    """The fifteen shared fields with their defaults; empty and zero give way."""
    some = lambda c: F.when(F.col(c).cast("string").isin("", "0", "0.0"), None).otherwise(F.col(c)).alias(c)
    plain = ["global_id_a", "global_id_b", "type", "distance", "assignee", "description", "category", "due_date", "source", "created_at"]
    kept = [some(c) for c in plain if c in df.columns]
    defaults = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)).alias(c) for c, d in (("status", "open"), ("priority", "normal"), ("title", "")) if c in df.columns]
    return df.select("id", *([F.col("point")] if "point" in df.columns else []), *kept, *defaults)


def valid_issues(df: DataFrame) -> DataFrame:
    return df.where((F.col("id") != "") & (F.col("status") != ""))


def count_by(clashes: DataFrame, column: str) -> DataFrame:
    return clashes.groupBy(column).agg(F.count("*").alias("n"))


def count_by_storey(clashes: DataFrame) -> DataFrame:
    return clashes.groupBy(storey().alias("storey")).agg(F.count("*").alias("n"))


def count_by_discipline(clashes: DataFrame) -> DataFrame:
    """Both sides count, also if they are the same."""
    sides = clashes.select(F.explode(F.array("discipline_a", "discipline_b")).alias("discipline"))
    return sides.where("discipline != ''").groupBy("discipline").agg(F.count("*").alias("n"))


def hotspot(clashes: DataFrame) -> DataFrame:
    """The storey with most clashes; 'N/A' without clashes. Ties go to the first by name."""
    top = count_by_storey(clashes).orderBy(F.desc("n"), "storey").limit(1)
    return top.agg(F.coalesce(F.first("storey"), F.lit("N/A")).alias("storey"), F.coalesce(F.first("n"), F.lit(0)).alias("n"))


def top_pairs(clashes: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent unordered type pairs; a missing type is '?'."""
    a, b = F.coalesce(F.nullif("elem_a_type", F.lit("")), F.lit("?")), F.coalesce(F.nullif("elem_b_type", F.lit("")), F.lit("?"))
    return clashes.groupBy(text.type_pair(a, b, " vs ").alias("pair")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pair").limit(k)


def report(clashes: DataFrame, issues: DataFrame) -> DataFrame:
    done = F.col("status").isin("resolved", "closed")
    c = clashes.agg(
        F.count("*").alias("clashes"), F.count_if(F.col("status") == "open").alias("clashes_open"), F.count_if(done).alias("clashes_done"),
        F.count_if(F.col("type") == "hard").alias("hard"), F.count_if(F.col("type") == "soft").alias("soft"),
    )
    i = issues.agg(
        F.count("*").alias("issues"), F.count_if(F.col("status") == "open").alias("issues_open"), F.count_if(F.col("status") == "in_progress").alias("issues_in_progress"), F.count_if(done).alias("issues_done")
    )
    row = i.first()  # one row
    return c.select("*", *(F.lit(row[n]).cast("bigint").alias(n) for n in i.columns))


def report_by_discipline(clashes: DataFrame) -> DataFrame:
    sides = clashes.select("status", "type", F.explode(F.array("discipline_a", "discipline_b")).alias("discipline"))
    return sides.groupBy("discipline").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "open").alias("open"), F.count_if(F.col("type") == "hard").alias("hard"))


def breakdown(clashes: DataFrame) -> DataFrame:
    """Counts by status, type and storey in one pass: dimension, value, n."""
    levels = clashes.withColumn("storey", storey()).groupingSets([["status"], ["type"], ["storey"]], "status", "type", "storey").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return levels.select(F.when(F.col("g") == 3, "status").when(F.col("g") == 5, "type").otherwise("storey").alias("dimension"), F.coalesce("status", "type", "storey").alias("value"), "n")


METRICS = {
    "clash_count": lambda c, i: c.agg(F.count("*").alias("n")),
    "issue_count": lambda c, i: i.agg(F.count("*").alias("n")),
    "open_clashes": lambda c, i: c.where("status = 'open'").agg(F.count("*").alias("n")),
    "status_breakdown": lambda c, i: count_by(c, "status"),
    "type_breakdown": lambda c, i: count_by(c, "type"),
    "discipline_breakdown": lambda c, i: count_by_discipline(c),
    "worst_storey": lambda c, i: hotspot(c),
}
FOCUS = {"worst_area": hotspot, "by_discipline": count_by_discipline, "summary": breakdown, "patterns": top_pairs}


def sort_clashes(clashes: DataFrame, *keys: str, limit: int | None = None) -> DataFrame:
    """Sorted by any of ``SORT_KEYS``, then by id."""
    columns = {"typeA": F.col("elem_a_type"), "typeB": F.col("elem_b_type"), "storey": storey(), "priority": priority_rank(), "distance": F.col("distance_mm"), "status": F.col("status"), "type": F.col("type")}
    columns |= {"severity": F.col("ai_severity") if "ai_severity" in clashes.columns else priority_rank(), "date": F.col("created_at") if "created_at" in clashes.columns else F.col("id")}
    out = clashes.orderBy(*(columns[k] for k in keys), "id")
    return out if limit is None else out.limit(limit)


def group_clashes(clashes: DataFrame, key: str) -> DataFrame:
    """Per group its size, smallest and greatest id. Members stay rows: join on the key to list them."""
    column = {"typeA": F.col("elem_a_type"), "typeB": F.col("elem_b_type"), "storey": storey(), "status": F.col("status"), "type": F.col("type"), "discipline": F.col("discipline_a")}[key]
    return clashes.groupBy(column.alias(key)).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def walkthrough(clashes: DataFrame) -> DataFrame:
    """In order of floor, then element."""
    return clashes.orderBy("elevation", "elem_a", "elem_b")


def run_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("run_id").agg(
        F.countDistinct("model_id").alias("models"), F.count("*").alias("clashes"), F.count_if(F.col("type") == "hard").alias("hard"), F.count_if(F.col("type") == "soft").alias("soft"), F.count_if(F.col("type") == "duplicate").alias("duplicates")
    )


def annotations_per_sheet(sheets: DataFrame, markups: DataFrame) -> DataFrame:
    n = markups.groupBy("sheet_id").agg(F.count("*").alias("n"))
    return sheets.join(n, sheets.id == n.sheet_id, "left").select(sheets["*"], F.coalesce("n", F.lit(0)).alias("annotations"))
