"""Validation suites: every rule of a suite is one predicate, all are evaluated in one pass over the elements.

Elements: express_id, model_id, pos, ifc_type, name, long_name, description, object_type, storey, material, global_id,
host_id, n_meshes, layers (array of struct<width>), psets (map of maps), quantities (map).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordspark.functions import js

# The property set that a type must have.
COMMON_PSET = {
    "IfcWall": "Pset_WallCommon", "IfcWallStandardCase": "Pset_WallCommon", "IfcSlab": "Pset_SlabCommon", "IfcRoof": "Pset_RoofCommon",
    "IfcColumn": "Pset_ColumnCommon", "IfcBeam": "Pset_BeamCommon", "IfcDoor": "Pset_DoorCommon", "IfcWindow": "Pset_WindowCommon",
    "IfcCovering": "Pset_CoveringCommon", "IfcCurtainWall": "Pset_CurtainWallCommon", "IfcPlate": "Pset_PlateCommon", "IfcMember": "Pset_MemberCommon",
    "IfcRailing": "Pset_RailingCommon", "IfcStair": "Pset_StairCommon", "IfcRamp": "Pset_RampCommon", "IfcSpace": "Pset_SpaceCommon",
}
# The types that a rule looks at.
EXTERNAL_TYPES = ["IfcWall", "IfcWallStandardCase", "IfcSlab", "IfcRoof", "IfcDoor", "IfcWindow", "IfcCurtainWall", "IfcPlate"]
LOADBEARING_TYPES = ["IfcWall", "IfcWallStandardCase", "IfcSlab", "IfcColumn", "IfcBeam", "IfcMember"]
FIRE_TYPES = ["IfcWall", "IfcWallStandardCase", "IfcSlab", "IfcDoor", "IfcColumn", "IfcBeam", "IfcCovering"]
QUANTITY_TYPES = ["IfcWall", "IfcWallStandardCase", "IfcSlab", "IfcRoof", "IfcColumn", "IfcBeam", "IfcPlate", "IfcCovering", "IfcSpace"]
PHYSICAL_TYPES = [
    "IfcWall", "IfcWallStandardCase", "IfcSlab", "IfcRoof", "IfcColumn", "IfcBeam", "IfcMember", "IfcWindow", "IfcDoor", "IfcStair", "IfcStairFlight",
    "IfcRamp", "IfcRampFlight", "IfcCurtainWall", "IfcPlate", "IfcCovering", "IfcRailing", "IfcBuildingElementProxy", "IfcPipeSegment", "IfcPipeFitting",
    "IfcDuctSegment", "IfcDuctFitting", "IfcFlowTerminal", "IfcSanitaryTerminal", "IfcLightFixture", "IfcSwitchingDevice", "IfcOutlet",
    "IfcDistributionElement", "IfcFurnishingElement", "IfcFooting", "IfcPile",
]
FLOW_TYPES = ["IfcFlowSegment", "IfcPipeSegment", "IfcDuctSegment", "IfcCableSegment", "IfcCableCarrierSegment"]
# Property keys (lower case) that hold a classification.
CLASS_KEYS = [
    "assemblycode", "assembly code", "assembly_code", "classificationcode", "classification code", "classification", "omniclass", "omniclassnumber",
    "uniclass", "uniformat", "masterformat",
]
SFB_KEYS = ["nl-sfb", "nl/sfb", "nlsfb", "nl_sfb", "sfbcode", "sfb-code", "sfb code", "classificationcode", "classification code", "classification"]
SFB_SET_KEYS = ["code", "value", "elementcode"]
# Main groups of NL/SfB table 1, and those allowed for a type (none: exempt).
SFB_GROUPS = {
    "11": "Grondwerk", "13": "Vloeren op grond", "16": "Funderingen", "21": "Buitenwanden", "22": "Binnenwanden", "23": "Vloeren", "24": "Trappen en hellingen",
    "27": "Daken", "28": "Hoofddraagconstructie", "31": "Buitenramen", "32": "Buitendeuren", "33": "Binnenramen", "34": "Binnendeuren", "37": "Dakramen/lichtkoepels",
    "41": "Wandafwerkingen buiten", "42": "Wandafwerkingen binnen", "43": "Vloerafwerkingen", "44": "Trapafwerkingen", "45": "Plafondafwerkingen", "47": "Dakafwerkingen",
    "52": "Afvoer/riolering", "53": "Watervoorziening", "54": "Gasvoorziening", "55": "Koeling", "56": "Verwarming", "57": "Ventilatie",
    "61": "Elektrische voorziening", "62": "Krachtstroom", "63": "Verlichting", "64": "Communicatie", "66": "Transport (liften)", "68": "Beveiliging",
    "73": "Terreinverharding", "74": "Terreinafscheiding", "90": "Vaste inrichting",
}
SFB_ALLOWED = {
    "IfcWall": "21 22", "IfcWallStandardCase": "21 22", "IfcSlab": "13 23 43", "IfcRoof": "27", "IfcColumn": "28", "IfcBeam": "28", "IfcMember": "28",
    "IfcWindow": "31 33 37", "IfcDoor": "32 34", "IfcStair": "24", "IfcStairFlight": "24", "IfcRamp": "24", "IfcRampFlight": "24", "IfcCurtainWall": "21",
    "IfcPlate": "28", "IfcCovering": "41 42 43 44 45 47", "IfcRailing": "34 28", "IfcPipeSegment": "52 53 54", "IfcPipeFitting": "52 53 54",
    "IfcDuctSegment": "57", "IfcDuctFitting": "57", "IfcFlowTerminal": "53 55 56 57 63", "IfcSanitaryTerminal": "53", "IfcLightFixture": "63",
    "IfcSwitchingDevice": "61 62", "IfcOutlet": "62", "IfcDistributionElement": "52 53 54 55 56 57 61 62 63 64",
}
# Properties that a type must have.
REQUIRED = {
    "IfcWall": ["IsExternal", "LoadBearing", "FireRating", "AcousticRating", "ThermalTransmittance"],
    "IfcWallStandardCase": ["IsExternal", "LoadBearing", "FireRating", "AcousticRating", "ThermalTransmittance"],
    "IfcSlab": ["IsExternal", "LoadBearing", "FireRating", "AcousticRating"], "IfcRoof": ["IsExternal", "ThermalTransmittance"],
    "IfcDoor": ["IsExternal", "FireRating", "AcousticRating"], "IfcWindow": ["IsExternal", "ThermalTransmittance"], "IfcColumn": ["LoadBearing", "FireRating"],
    "IfcBeam": ["LoadBearing", "FireRating"], "IfcMember": ["LoadBearing"], "IfcCurtainWall": ["IsExternal", "ThermalTransmittance"],
    "IfcStair": ["FireRating"], "IfcRamp": ["FireRating"], "IfcCovering": ["FireRating"],
}
# Patterns.
GENERIC_NAME = (
    r"(?i)^(basic\s+)?(wall|floor|ceiling|roof|column|beam|slab|door|window|generic model|furniture|curtain wall|curtain panel|railing|stair|ramp|mass|component|panel"
    r"|mullion|structural framing|structural column)(\s+[\d\-]+)?$"
)
STOREY_NAME = r"^-?\d{2}(\s.+)?$"
DOOR_NAME = r"(?i)^D[\s\-_]?\d{2,4}"
FIRE_VALUE = r"(?i)^(REI|EI|R|E)?\s*-?\s*(30|60|90|120|180|240)$"
STRUCTURAL_MATERIAL = r"(?i)\b(beton|concrete|kalkzandsteen|limestone|cellular|metselwerk|masonry|brick|staal|steel|reinforced)\b"
RENOVATION = r"(?i)^(bestaand|nieuw|te\s+slopen|existing|new|demolish(ed)?|to\s+(be\s+)?demolish(ed)?|retained)$"
YES = r"(?i)^(true|1|yes)$"
THICKNESS = r"(?i)(\d+)\s*(mm|cm|m)\b"

EXAMPLES = {"general": 6, "bim": 8, "ils": 8}

Hit = tuple[str, str, Column, Column | None]  # check, severity, predicate, detail


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def with_props(elements: DataFrame) -> DataFrame:
    """Adds _props: all properties in order as array<struct<s, k, v>> with lower-case set and key names."""
    entries = F.transform(F.map_entries("psets"), lambda e: F.transform(F.map_entries(e.value), lambda kv: F.struct(F.lower(e.key).alias("s"), F.lower(kv.key).alias("k"), kv.value.alias("v"))))
    empty = F.array().cast("array<struct<s:string,k:string,v:string>>")
    return elements.withColumn("_props", F.coalesce(F.flatten(F.filter(entries, lambda x: x.isNotNull())), empty))


def _last(matches: Column) -> Column:
    return F.when(F.size(matches) > 0, F.element_at(matches, -1).v)


def prop(key: str) -> Column:
    """The last value of a property that is not blank, trimmed."""
    return js.trim(_last(F.filter("_props", lambda x: (x.k == key) & ~js.blank(x.v))))


def prop_in_sets(key: str, present_only: bool) -> Column:
    """The type's own set first, then any set; the last match in order. ``present_only``: any value but null counts, else blanks do not."""
    ok = (lambda x: x.v.isNotNull()) if present_only else (lambda x: ~js.blank(x.v))
    own = _last(F.filter("_props", lambda x: (x.s == F.lower(F.col("_common"))) & (x.k == key) & ok(x)))
    return F.coalesce(own, _last(F.filter("_props", lambda x: (x.k == key) & ok(x))))


def quantity_above_zero(part: str) -> Column:
    entries = F.map_entries("quantities")
    return F.coalesce(F.exists(entries, lambda q: F.lower(q.key).contains(part) & (js.parse_float(q.value) > 0)), F.lit(False))


def _hits(elements: DataFrame, rules: list[Hit]) -> DataFrame:
    """check, severity, express_id, model_id, pos, display, detail: one row per element and rule that it breaks."""
    found = [
        F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), (F.lit("") if detail is None else F.coalesce(detail, F.lit(""))).alias("detail")))
        for check, severity, when, detail in rules
    ]
    display = F.when(F.col("name").isNull() | (F.col("name") == ""), F.concat(F.lit("#"), F.col("express_id").cast("string"))).otherwise(F.col("name"))
    return elements.select("express_id", "model_id", "pos", display.alias("display"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("h")).select("h.check", "h.severity", "express_id", "model_id", "pos", "display", "h.detail")


def general_hits(elements: DataFrame) -> DataFrame:
    """The twelve general rules. Collisions and repeated names come from aggregates, the rest from one pass."""
    flags = elements.agg(F.bool_or(F.coalesce(F.col("host_id") != "", F.lit(False))).alias("hosts"), F.bool_or(F.coalesce(F.size("layers") > 0, F.lit(False))).alias("layers")).first()
    zero = F.exists("layers", lambda x: x.width == "0")
    no_sets = F.coalesce(~F.exists(F.map_values("psets"), lambda s: F.size(s) > 0), F.lit(True))
    rules: list[Hit] = [
        ("noGlobalId", "error", js.blank("global_id"), None),
        ("proxy", "warn", F.col("ifc_type") == "IfcBuildingElementProxy", None),
        ("genericName", "warn", js.trim("name").rlike(GENERIC_NAME), None),
        ("noMaterial", "warn", js.blank("material"), None),
        ("noStorey", "warn", js.blank("storey"), None),
        ("emptyGeometry", "warn", F.col("n_meshes") == 0, None),
        ("zeroLayers", "warn", F.lit(bool(flags.layers)) & zero, None),
        ("unhostedOpenings", "warn", F.lit(bool(flags.hosts)) & F.col("ifc_type").isin("IfcDoor", "IfcWindow") & (F.coalesce("host_id", F.lit("")) == ""), None),
        ("noProperties", "info", no_sets & F.col("quantities").isNull(), None),
        ("noDescription", "info", js.blank("description"), None),
    ]
    single = _hits(elements, rules)

    named = elements.withColumn("_name", js.trim("name")).where("_name != ''")
    often = named.groupBy("_name").count().where("count > 5").select("_name")
    first_of = named.join(often, "_name", "left_semi").groupBy("name").agg(F.min_by(F.struct("express_id", "model_id", "pos"), "pos").alias("f"))
    repeated = first_of.select(F.lit("duplicateName").alias("check"), F.lit("warn").alias("severity"), "f.*", F.col("name").alias("display"), F.lit("").alias("detail"))

    known = elements.where("global_id != ''")
    firsts = known.groupBy("global_id").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("global_id", "_first")
    again = known.join(firsts, "global_id").where("pos > _first")
    collisions = _hits(again, [("guidCollision", "error", F.lit(True), None)])
    return single.unionByName(repeated).unionByName(collisions)


def bim_values(elements: DataFrame) -> DataFrame:
    """Elements with the values that the BIM rules and distributions look at."""
    out = with_props(elements).withColumn("_common", _lookup(COMMON_PSET)[F.col("ifc_type")])
    code = _last(F.filter("_props", lambda x: x.k.isin(CLASS_KEYS) & ~js.blank(x.v)))
    by_type = F.when(F.col("object_type").rlike(r"^\d{2}\s?\d{2}\s?\d{2}"), F.col("object_type"))
    return out.withColumns(
        {
            "v_fireRating": js.trim(prop_in_sets("firerating", False)),
            "v_isExternal": prop_in_sets("isexternal", True),
            "v_loadBearing": prop_in_sets("loadbearing", True),
            "v_classification": F.coalesce(js.trim(code), by_type),
            "v_objectType": F.col("object_type"), "v_material": F.col("material"), "v_storey": F.col("storey"),
        }
    )


def bim_hits(elements: DataFrame) -> DataFrame:
    """The ten model rules."""
    kind = F.col("ifc_type")
    has_common = F.exists(F.map_keys("psets"), lambda k: F.lower(k) == F.lower(F.col("_common")))
    number, unit = F.regexp_extract("name", THICKNESS, 1).try_cast("double"), F.lower(F.regexp_extract("name", THICKNESS, 2))
    named = number * F.when(unit == "cm", 10).when(unit == "m", 1000).otherwise(1)
    widths = F.filter(F.transform(F.filter(F.map_entries("quantities"), lambda q: F.lower(q.key).isin("width", "thickness", "depth")), lambda q: js.parse_float(q.value)), lambda v: v.isNotNull())
    raw = F.when(F.size(widths) > 0, F.element_at(widths, -1))
    actual = F.when(raw < 10, raw * 1000).otherwise(raw)
    rules: list[Hit] = [
        ("missingCommonPset", "warn", F.col("_common").isNotNull() & ~F.coalesce(has_common, F.lit(False)), F.col("_common")),
        ("noFireRating", "warn", kind.isin(FIRE_TYPES) & F.col("v_fireRating").isNull(), None),
        ("noIsExternal", "warn", kind.isin(EXTERNAL_TYPES) & F.col("v_isExternal").isNull(), None),
        ("noLoadBearing", "warn", kind.isin(LOADBEARING_TYPES) & F.col("v_loadBearing").isNull(), None),
        ("noClassification", "warn", F.col("v_classification").isNull(), None),
        ("noObjectType", "info", js.blank("object_type"), None),
        ("thicknessMismatch", "error", F.abs(actual - named) > named * 0.15, F.format_string("Name says %.0fmm, actual %.0fmm", named, js.round_half_up(actual).cast("double"))),
        ("invalidName", "warn", js.trim("name").rlike(r"^[\d\-_\s]+$"), None),
        ("missingArea", "info", kind.isin(QUANTITY_TYPES) & ~quantity_above_zero("area"), None),
        ("missingVolume", "info", kind.isin(QUANTITY_TYPES) & (kind != "IfcSpace") & ~quantity_above_zero("volume"), None),
    ]
    return _hits(bim_values(elements), rules)


def sfb_code() -> Column:
    """The NL/SfB code: the last one in the properties, else two digits of the object type."""
    keys = lambda x: x.k.isin(SFB_KEYS) | (x.s.contains("sfb") & x.k.isin(SFB_SET_KEYS))
    of_type = F.coalesce(F.nullif(F.regexp_extract("object_type", r"\((\d{2})\)", 1), F.lit("")), F.nullif(F.regexp_extract("object_type", r"^(\d{2})[.\-\s]", 1), F.lit("")))
    return F.coalesce(js.trim(_last(F.filter("_props", lambda x: keys(x) & ~js.blank(x.v)))), of_type)


def ils_values(elements: DataFrame) -> DataFrame:
    names = sorted({p for needed in REQUIRED.values() for p in needed} | {"RenovationStatus", "Status"})
    out = with_props(elements).withColumns({f"v_{p}": prop(p.lower()) for p in names} | {"v_code": sfb_code()})
    bare = js.trim(F.regexp_replace("v_code", r"[()]", ""))
    return out.withColumns({"v_bare": bare, "v_group": F.nullif(F.regexp_extract(bare, r"^(\d{2})", 1), F.lit(""))})


def _ils_rules() -> list[tuple[str, str, Column, Column | None, Column]]:
    kind, physical = F.col("ifc_type"), F.col("ifc_type").isin(PHYSICAL_TYPES)
    wall = kind.isin("IfcWall", "IfcWallStandardCase")
    net_area = F.coalesce(F.exists(F.map_entries("quantities"), lambda q: q.key.rlike(r"(?i)netfloorarea|net\s*floor\s*area|netarea") & (js.parse_float(q.value) > 0)), F.lit(False))
    lacks = F.filter(F.array(F.when(js.blank("name"), "Name"), F.when(js.blank("long_name"), "LongName"), F.when(~net_area, "NetFloorArea")), lambda x: x.isNotNull())
    allowed = F.split(_lookup(SFB_ALLOWED)[kind], " ")
    valid = F.col("v_bare").rlike(r"^\d{2}(\.\d{1,2})*$")
    renovation = F.coalesce("v_RenovationStatus", "v_Status")
    missing = F.filter(F.array(*(F.when(kind.isin([t for t, needed in REQUIRED.items() if p in needed]) & F.col(f"v_{p}").isNull(), p) for p in ("IsExternal", "LoadBearing", "FireRating", "AcousticRating", "ThermalTransmittance"))), lambda x: x.isNotNull())
    door, fire, one, none = js.trim("name"), F.col("v_FireRating"), F.lit(1), F.lit(0)
    return [
        ("storeyNaming", "info", (kind == "IfcBuildingStorey") & ~F.coalesce(js.trim("name").rlike(STOREY_NAME), F.lit(False)), js.trim("name"), none),
        ("spaceIncomplete", "warn", (kind == "IfcSpace") & (F.size(lacks) > 0), F.array_join(lacks, ", "), none),
        ("doorNaming", "info", (kind == "IfcDoor") & ~F.coalesce(door.rlike(DOOR_NAME), F.lit(False)), door, one),
        ("fireRatingInvalid", "warn", wall & fire.isNotNull() & ~fire.rlike(FIRE_VALUE), fire, one),
        ("extWallNoUValue", "warn", wall & F.col("v_IsExternal").rlike(YES) & F.col("v_ThermalTransmittance").isNull(), None, one),
        ("loadBearingInvalidMaterial", "warn", wall & F.col("v_LoadBearing").rlike(YES) & (F.col("material") != "") & ~F.col("material").rlike(STRUCTURAL_MATERIAL), F.col("material"), one),
        ("mepNoRenovationStatus", "info", physical & kind.isin(FLOW_TYPES) & ~F.coalesce(renovation.rlike(RENOVATION), F.lit(False)), renovation, one),
        ("noNLSfB", "error", physical & F.col("v_code").isNull(), None, F.lit(2)),
        ("invalidNLSfB", "error", physical & F.col("v_code").isNotNull() & ~valid, F.col("v_code"), one),
        ("mismatchNLSfB", "warn", physical & valid & ~F.array_contains(allowed, F.col("v_group")), F.col("v_code"), one),
        ("missingILSProp", "warn", physical & (F.size(missing) > 0), F.array_join(missing, ", "), F.size(missing)),
        ("noDescription", "info", physical & (js.blank("description") | F.coalesce(js.trim("description") == F.col("name"), F.lit(False))), None, one),
        ("noMaterial", "warn", physical & js.blank("material"), None, one),
        ("noStorey", "warn", physical & js.blank("storey"), None, one),
        ("noObjectType", "info", physical & js.blank("object_type"), None, one),
        ("noName", "warn", physical & js.blank("name"), None, one),
    ]


def ils_hits(elements: DataFrame) -> DataFrame:
    """The sixteen delivery-specification rules."""
    return _hits(ils_values(elements), [rule[:4] for rule in _ils_rules()])


SUITES = {"general": general_hits, "bim": bim_hits, "ils": ils_hits}


def run_suite(elements: DataFrame, suite: str) -> DataFrame:
    """check, severity, n and examples of a suite; checks without hits have no row."""
    hits = SUITES[suite](elements)
    return counts(hits).join(first_examples(hits, EXAMPLES[suite]), "check", "left")


def counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("check", "severity").agg(F.count("*").alias("n"))


def first_examples(hits: DataFrame, n: int) -> DataFrame:
    """check, examples: the first n elements of each check by pos. The rank is cut per task first (a group limit), so no group is gathered."""
    ranked = hits.withColumn("_r", F.row_number().over(Window.partitionBy("check").orderBy("pos", "express_id"))).where(F.col("_r") <= n)
    return ranked.groupBy("check").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "express_id"))), lambda x: x.express_id.cast("string")), ",").alias("examples"))


def distributions(elements: DataFrame) -> DataFrame:
    """key, value, n: how often each value of the seven properties occurs; blanks are '(not set)'."""
    keys = ("isExternal", "loadBearing", "fireRating", "classification", "objectType", "material", "storey")
    values = F.array(*(F.struct(F.lit(k).alias("key"), js.not_set(f"v_{k}").alias("value")) for k in keys))
    return bim_values(elements).select(F.inline(values)).groupBy("key", "value").agg(F.count("*").alias("n"))


def sfb_distribution(elements: DataFrame) -> DataFrame:
    """label, n: physical elements per NL/SfB main group."""
    group = F.col("v_group")
    label = F.when(group.isNull(), "(geen code)").otherwise(F.concat_ws(" ", group, F.coalesce(_lookup(SFB_GROUPS)[group], F.lit("Onbekend"))))
    return ils_values(elements).where(F.col("ifc_type").isin(PHYSICAL_TYPES)).groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def compliance(elements: DataFrame) -> DataFrame:
    """bucket, n: physical elements by the weighted number of their issues."""
    issues = F.lit(0)
    for _, _, when, _, weight in _ils_rules():
        issues = issues + F.when(F.coalesce(when, F.lit(False)), weight).otherwise(0)
    bucket = F.when(F.col("issues") == 0, "Compliant").when(F.col("issues") <= 2, "Minor issues").otherwise("Major issues")
    return ils_values(elements).where(F.col("ifc_type").isin(PHYSICAL_TYPES)).withColumn("issues", issues).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
