"""SQL of the registered queries, for an independent engine, over the same tables."""

from __future__ import annotations

from coordspark.functions import text
from coordspark.operators import quality as Q
from coordspark.sources import fixtures as X

STOREY = "coalesce(nullif(elem_a_storey, ''), nullif(elem_b_storey, ''), 'Unknown')"
ISSUES = """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'resolved' ELSE 'closed' END AS status,
  'Issue <' || CAST(o_orderkey AS VARCHAR(20)) || '> & co' AS title, lower(o_orderpriority) AS priority, CASE WHEN o_orderkey % 3 = 0 THEN 'clash' ELSE 'manual' END AS source, o_orderstatus AS description FROM orders"""


def literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(map(literal, values))


def on_elements(q: str) -> str:
    return f"WITH e AS ({X.ELEMENTS}) {q}"


def on_clashes(q: str) -> str:
    return f"WITH c AS ({X.CLASHES}) {q}"


def overlap(gap: int = 0) -> str:
    return " AND ".join(f"a.{k}0 - {gap} <= b.{k}1 AND a.{k}1 + {gap} >= b.{k}0" for k in "xyz")


def pairs(scope: str, gap: int = 0, columns: str = "a.express_id AS a_express_id, b.express_id AS b_express_id") -> str:
    return on_elements(f"SELECT {columns} FROM e AS a JOIN e AS b ON a.express_id < b.express_id AND {overlap(gap)} WHERE {scope}")


ACROSS = "a.model_id <> b.model_id"
CLASH_DETECTION = on_elements(
    f"SELECT coalesce(nullif(a.storey, ''), nullif(b.storey, ''), 'Unknown') AS storey, count(*) AS n FROM e AS a JOIN e AS b ON a.express_id < b.express_id AND {overlap()} WHERE {ACROSS} GROUP BY 1"
)


def _tri() -> str:
    """Crossing triangle pairs, step by step, as cr (a, b, am, bm, len)."""
    cross = lambda u, v: [f"({u}y*{v}z-{u}z*{v}y)", f"({u}z*{v}x-{u}x*{v}z)", f"({u}x*{v}y-{u}y*{v}x)"]
    edges = ", ".join(f"{s}.{k}{i}-{s}.{k}0 AS {s}e{i}{k}" for s in "ab" for i in (1, 2) for k in "xyz")
    normals = ", ".join(f"{c} AS n{s}{k}" for s in "ab" for c, k in zip(cross(f"{s}e1", f"{s}e2"), "xyz", strict=True))
    line = ", ".join(f"{c} AS l{k}" for c, k in zip(cross("na", "nb"), "xyz", strict=True))
    dot = lambda u, s, i: "+".join(f"{u}{k}*{s}{k}{i}" for k in "xyz")
    dist = ", ".join(f"({dot('n' + o, s, i)})-({dot('n' + o, o, 0)}) AS d{s}{i}" for s, o in (("a", "b"), ("b", "a")) for i in range(3))
    place = ", ".join(f"{dot('l', s, i)} AS p{s}{i}" for s in "ab" for i in range(3))
    cut = lambda s, i, j: f"CASE WHEN d{s}{i}*d{s}{j} < 0 THEN p{s}{i}+(p{s}{j}-p{s}{i})*(d{s}{i}/(d{s}{i}-d{s}{j})) END"
    cuts = ", ".join(f"{cut(s, i, j)} AS t{s}{n}" for s in "ab" for n, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))))
    some = lambda f, s: f"{f}(t{s}0, t{s}1, t{s}2)"
    count = lambda s: "+".join(f"(CASE WHEN t{s}{n} IS NULL THEN 0 ELSE 1 END)" for n in range(3))
    corners = ", ".join(f"{s}.{k}{i} AS {s}{k}{i}" for s in "ab" for i in range(3) for k in "xyz")
    return f"""WITH t AS ({X.TRIANGLES}),
s1 AS (SELECT a.express_id AS a, b.express_id AS b, a.model_id AS am, b.model_id AS bm, {corners}, {edges} FROM t AS a JOIN t AS b ON a.express_id < b.express_id AND a.model_id <> b.model_id),
s2 AS (SELECT *, {normals} FROM s1), s3 AS (SELECT *, {line} FROM s2 WHERE nax*nax+nay*nay+naz*naz >= 1e-10 AND nbx*nbx+nby*nby+nbz*nbz >= 1e-10),
s4 AS (SELECT *, lx*lx+ly*ly+lz*lz AS ll, {dist}, {place} FROM s3), s5 AS (SELECT *, {cuts} FROM s4 WHERE ll >= 1e-12),
s6 AS (SELECT *, greatest({some('least', 'a')}, {some('least', 'b')}) AS lo, least({some('greatest', 'a')}, {some('greatest', 'b')}) AS hi FROM s5 WHERE {count('a')} >= 2 AND {count('b')} >= 2),
cr AS (SELECT a, b, am, bm, (hi - lo) / sqrt(ll) AS len FROM s6 WHERE lo < hi) """


TRI_TRI = _tri() + "SELECT a AS a_express_id, b AS b_express_id, round(len, 3) AS seg_len FROM cr"
MESH_SUMMARY = _tri() + "SELECT am AS a_model_id, bm AS b_model_id, count(*) AS pairs, count(*) AS contacts, round(max(len), 3) AS longest FROM cr GROUP BY 1, 2"
MIN_DISTANCE = f"""WITH t AS ({X.TRIANGLES}), p AS ({' UNION ALL '.join(f'SELECT express_id, x{i} AS x, y{i} AS y, z{i} AS z FROM t' for i in range(3))}),
m AS (SELECT a.express_id AS pair, min((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d2 FROM p AS a JOIN p AS b ON a.express_id = b.express_id - 1 GROUP BY 1)
SELECT pair, round(sqrt(d2), 3) AS distance FROM m WHERE d2 <= 3000.0 * 3000.0"""
DUPLICATES = on_elements("SELECT ifc_type, express_id AS first_id, express_id + 1000000 AS last_id, CAST(2 AS BIGINT) AS n FROM e WHERE express_id % 10 = 0")
BOUNDS = on_elements(
    "SELECT model_id, " + ", ".join(f"min({k}0) AS min_{k}, max({k}1) AS max_{k}, (min({k}0) + max({k}1)) / 2.0 AS center_{k}, max({k}1) - min({k}0) AS size_{k}" for k in "xyz") + " FROM e GROUP BY model_id"
)


def _plane(height: float) -> str:
    cut = lambda i, j, k, f: f"({f}(x{i}*0 + {k}{i} + ({k}{j} - {k}{i}) * ((y{i}-{height}) / ((y{i}-{height}) - (y{j}-{height})))))"
    edges = [(0, 1), (0, 2), (1, 2)]
    hit = lambda i, j: f"(y{i}-{height})*(y{j}-{height}) < 0"
    parts = []
    for m in range(3):
        for n in range(m + 1, 3):
            (a, b), (c, d) = edges[m], edges[n]
            parts.append(f"SELECT express_id, round({cut(a, b, 'x', '-')}, 3) AS u0, round({cut(a, b, 'z', '')}, 3) AS v0, round({cut(c, d, 'x', '-')}, 3) AS u1, round({cut(c, d, 'z', '')}, 3) AS v1 FROM t WHERE {hit(a, b)} AND {hit(c, d)}")
    return f"WITH t AS ({X.TRIANGLES}) " + " UNION ALL ".join(parts)


PLANE_CUT = _plane(500.0)
_NICE = lambda c: f"regexp_replace(regexp_replace({c}, '^Ifc', ''), '([a-z])([A-Z])', '\\1 \\2', 'g')"
ENRICH = f"""WITH e AS ({X.ELEMENTS}), m AS ({X.MODELS}),
q AS (SELECT a.*, b.express_id AS bid, b.ifc_type AS bt, b.name AS bn, b.model_id AS bm, b.y0 AS by0, b.y1 AS by1 FROM e AS a JOIN e AS b ON a.express_id < b.express_id AND {overlap()})
SELECT CAST(q.express_id AS VARCHAR) || '_' || CAST(bid AS VARCHAR) AS id,
  {_NICE('q.ifc_type')} || CASE WHEN q.ifc_type = bt THEN ' vs ' ELSE ' × ' END || {_NICE('bt')} || CASE WHEN q.model_id = bm THEN ' (self)' ELSE '' END AS title,
  q.ifc_type || ': ' || q.name || ' (' || ma.name || ') vs ' || bt || ': ' || bn || ' (' || mb.name || ')' AS description, q.model_id = bm AS self_clash,
  ma.discipline AS discipline_a, mb.discipline AS discipline_b, floor((y0 + y1 + by0 + by1) / 4.0 * 1000 + 0.5) / 1000 AS elevation
FROM q JOIN m AS ma ON ma.model_id = q.model_id JOIN m AS mb ON mb.model_id = bm"""
RELATED = pairs(
    f"""{ACROSS} AND NOT EXISTS (SELECT 1 FROM e AS r WHERE (r.global_id = a.global_id AND 'G' || CAST(r.express_id * 2 AS VARCHAR) = b.global_id)
  OR (r.global_id = b.global_id AND 'G' || CAST(r.express_id * 2 AS VARCHAR) = a.global_id))"""
)
DENIED = f"""WITH e AS ({X.ELEMENTS}), f AS (SELECT a.express_id AS a_express_id, b.express_id AS b_express_id, a.global_id AS ga, b.global_id AS gb, (a.x0+b.x0)/2.0 AS x, (a.y0+b.y0)/2.0 AS y, (a.z0+b.z0)/2.0 AS z
  FROM e AS a JOIN e AS b ON a.express_id < b.express_id AND {overlap()} WHERE {ACROSS}),
d AS (SELECT ga, gb, x + a_express_id % 300 AS x, y, z FROM f WHERE (a_express_id + b_express_id) % 3 = 0)
SELECT a_express_id, b_express_id FROM f WHERE NOT EXISTS (SELECT 1 FROM d WHERE least(d.ga, d.gb) = least(f.ga, f.gb) AND greatest(d.ga, d.gb) = greatest(f.ga, f.gb)
  AND (d.x-f.x)*(d.x-f.x)+(d.y-f.y)*(d.y-f.y)+(d.z-f.z)*(d.z-f.z) <= 22500)"""
_SIDE = {k: f"greatest(0, least(a.{k}1, b.{k}1) - greatest(a.{k}0, b.{k}0))" for k in "xyz"}
TOLERANCE = f"""WITH e AS ({X.ELEMENTS}), f AS (SELECT a.express_id AS a_express_id, b.express_id AS b_express_id, least(a.ifc_type, b.ifc_type) || ':' || greatest(a.ifc_type, b.ifc_type) AS k,
  CAST({_SIDE['x']} AS DOUBLE) * {_SIDE['y']} * {_SIDE['z']} AS v, CAST(least({_SIDE['x']}, {_SIDE['y']}, {_SIDE['z']}) AS BIGINT) AS depth_mm FROM e AS a JOIN e AS b ON a.express_id < b.express_id AND {overlap()} WHERE {ACROSS})
SELECT a_express_id, b_express_id, depth_mm FROM f WHERE v >= 1000000 AND depth_mm > CASE k WHEN 'IfcBeam:IfcWall' THEN 200 WHEN 'IfcDoor:IfcWall' THEN 400 ELSE 0 END"""
CLUSTERS = f"""WITH RECURSIVE e AS ({X.ELEMENTS}), g AS (SELECT a.express_id AS a, b.express_id AS b FROM e AS a JOIN e AS b ON a.ifc_type = b.ifc_type AND a.storey = b.storey
  AND (a.x0-b.x0)*(a.x0-b.x0)+(a.y0-b.y0)*(a.y0-b.y0)+(a.z0-b.z0)*(a.z0-b.z0) <= 2250000),
r AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a)
SELECT a AS id, min(b) AS cluster FROM r GROUP BY a"""

REPORT = f"""WITH c AS ({X.CLASHES}), i AS ({ISSUES}) SELECT count(*) AS clashes, count(*) FILTER (WHERE status = 'open') AS clashes_open, count(*) FILTER (WHERE status IN ('resolved', 'closed')) AS clashes_done,
  count(*) FILTER (WHERE type = 'hard') AS hard, count(*) FILTER (WHERE type = 'soft') AS soft, (SELECT count(*) FROM i) AS issues, (SELECT count(*) FROM i WHERE status = 'open') AS issues_open,
  (SELECT count(*) FROM i WHERE status = 'in_progress') AS issues_in_progress, (SELECT count(*) FROM i WHERE status IN ('resolved', 'closed')) AS issues_done FROM c"""
STATUS = f"""WITH e AS ({X.ELEMENTS}), m AS ({X.MODELS}), c AS ({X.CLASHES}) SELECT m.model_id, m.name, (SELECT count(*) FROM e WHERE e.model_id = m.model_id) AS elements, (SELECT count(*) FROM c) AS clashes,
  (SELECT count(*) FROM c WHERE status <> 'resolved') AS open_clashes, (SELECT count(*) FROM orders) AS issues FROM m"""
_ONCE = "o AS (SELECT id, min(status) AS status, min(priority) AS priority, min(type) AS type, min(distance_mm) AS distance_mm FROM c GROUP BY id)"
CLASH_LIST = f"""WITH c AS ({X.CLASHES}), {_ONCE}, p AS (SELECT * FROM o WHERE status = 'open' ORDER BY id LIMIT 50)
SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INT) AS "index", id, 'Clash ' || CAST(row_number() OVER (ORDER BY id) AS VARCHAR) AS title, status, priority, type, distance_mm, (SELECT count(*) FROM o WHERE status = 'open') AS total FROM p"""
SORTED = f"""WITH c AS ({X.CLASHES}), {_ONCE} SELECT id, priority, distance_mm FROM o
ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'normal' THEN 2 ELSE 3 END, distance_mm, id LIMIT 100"""
DISCIPLINES = on_elements("""SELECT model_id, discipline FROM (SELECT model_id, discipline, row_number() OVER (PARTITION BY model_id ORDER BY n DESC, discipline) AS r FROM (
  SELECT model_id, CASE WHEN ifc_type IN ('IfcWall', 'IfcDoor') THEN 'architectural' WHEN ifc_type IN ('IfcSlab', 'IfcBeam') THEN 'structural' ELSE 'mep' END AS discipline, count(*) AS n
  FROM e WHERE ifc_type <> 'IfcBuildingElementProxy' GROUP BY 1, 2) AS s) AS t WHERE r = 1""")
OPEN_WORK = f"""WITH c AS ({X.CLASHES}), i AS ({ISSUES}) SELECT 'clash' AS kind, count(*) AS n FROM c WHERE status = 'open' UNION ALL SELECT 'issue', count(*) FROM i WHERE status IN ('open', 'in_progress')"""
RUN_SUMMARY = on_clashes("SELECT elem_b % 10 AS run_id, count(DISTINCT elem_a % 3) AS models, count(*) AS clashes, count(*) FILTER (WHERE type = 'hard') AS hard, count(*) FILTER (WHERE type = 'soft') AS soft, count(*) FILTER (WHERE type = 'duplicate') AS duplicates FROM c GROUP BY 1")

# --- validation

DQ_PART, DQ_PROPS = X.DQ_ELEMENTS, X.PROPS
_blank = lambda c: f"({c} IS NULL OR trim({c}) = '')"
_last = lambda cond: f"arg_max(p.v, p.pos) FILTER (WHERE {cond} AND trim(p.v) <> '')"
_props = sorted({p for needed in Q.REQUIRED.values() for p in needed} | {"Status", "RenovationStatus"})
_sfb = f"(lower(p.k) IN ({listed(Q.SFB_KEYS)}) OR (lower(p.pset) LIKE '%sfb%' AND lower(p.k) IN ({listed(Q.SFB_SET_KEYS)})))"
_VALUES = f"""p AS ({X.ELEMENT_PROPS}), e0 AS ({X.DQ_ELEMENTS}), l AS (SELECT express_id, count(*) AS n_props,
  {', '.join(f"trim({_last(f'lower(p.k) = {literal(x.lower())}')}) AS v_{x}" for x in _props)},
  trim({_last("lower(p.k) = 'firerating' AND p.pset = 'Pset_WallCommon'")}) AS own_fire, arg_max(p.v, p.pos) FILTER (WHERE lower(p.k) = 'isexternal') AS ext, arg_max(p.v, p.pos) FILTER (WHERE lower(p.k) = 'loadbearing') AS lb,
  trim({_last(f'lower(p.k) IN ({listed(Q.CLASS_KEYS)})')}) AS cls, trim({_last(_sfb)}) AS sfb, count(*) FILTER (WHERE p.pset = 'Pset_WallCommon') AS n_wall FROM p GROUP BY express_id),
e AS (SELECT e0.*, l.n_props, {', '.join(f'l.v_{x}' for x in _props)}, CASE WHEN ifc_type IN ('IfcWall', 'IfcWallStandardCase') THEN coalesce(own_fire, l.v_FireRating) ELSE l.v_FireRating END AS fire, ext, lb,
  coalesce(cls, CASE WHEN regexp_matches(object_type, '^\\d{{2}}\\s?\\d{{2}}\\s?\\d{{2}}') THEN object_type END) AS cls, coalesce(n_wall, 0) AS n_wall,
  coalesce(sfb, nullif(regexp_extract(object_type, '\\((\\d{{2}})\\)', 1), ''), nullif(regexp_extract(object_type, '^(\\d{{2}})[.\\-\\s]', 1), '')) AS code,
  p_partkey % 4 <> 0 AND p_size >= 3 AS has_area, p_partkey % 4 = 1 AND p_size > 0 AS has_volume,
  CASE lower(regexp_extract(name, {literal(Q.THICKNESS)}, 2)) WHEN 'mm' THEN 1 WHEN 'cm' THEN 10 WHEN 'm' THEN 1000 END * TRY_CAST(regexp_extract(name, {literal(Q.THICKNESS)}, 1) AS DOUBLE) AS named,
  CASE WHEN p_partkey % 6 <> 0 THEN CASE WHEN p_size < 10 THEN p_size * 1000 ELSE p_size END END AS actual FROM e0 LEFT JOIN l ON l.express_id = e0.express_id)"""

_GENERAL = {
    ("noGlobalId", "error"): _blank("global_id"), ("proxy", "warn"): "ifc_type = 'IfcBuildingElementProxy'", ("genericName", "warn"): f"regexp_matches(trim(name), {literal(Q.GENERIC_NAME)})",
    ("noMaterial", "warn"): _blank("material"), ("noStorey", "warn"): _blank("storey"), ("emptyGeometry", "warn"): "n_meshes = 0", ("zeroLayers", "warn"): "layer_width = '0'",
    ("unhostedOpenings", "warn"): "ifc_type IN ('IfcDoor', 'IfcWindow') AND coalesce(host_id, '') = '' AND (SELECT count(*) FROM e0 WHERE host_id <> '') > 0",
    ("noProperties", "info"): "n_props IS NULL AND q_width IS NULL AND q_area IS NULL AND q_volume IS NULL", ("noDescription", "info"): _blank("description"),
}
_BIM = {
    ("missingCommonPset", "warn"): f"ifc_type IN ({listed(Q.COMMON_PSET)}) AND NOT (ifc_type IN ('IfcWall', 'IfcWallStandardCase') AND n_wall > 0)",
    ("noFireRating", "warn"): f"ifc_type IN ({listed(Q.FIRE_TYPES)}) AND fire IS NULL", ("noIsExternal", "warn"): f"ifc_type IN ({listed(Q.EXTERNAL_TYPES)}) AND ext IS NULL",
    ("noLoadBearing", "warn"): f"ifc_type IN ({listed(Q.LOADBEARING_TYPES)}) AND lb IS NULL", ("noClassification", "warn"): "cls IS NULL", ("noObjectType", "info"): _blank("object_type"),
    ("thicknessMismatch", "error"): "abs(actual - named) > named * 0.15", ("invalidName", "warn"): "regexp_matches(trim(name), '^[\\d\\-_\\s]+$')",
    ("missingArea", "info"): f"ifc_type IN ({listed(Q.QUANTITY_TYPES)}) AND NOT has_area", ("missingVolume", "info"): f"ifc_type IN ({listed(Q.QUANTITY_TYPES)}) AND ifc_type <> 'IfcSpace' AND NOT has_volume",
}
_PHYSICAL = f"ifc_type IN ({listed(Q.PHYSICAL_TYPES)})"
_WALL = "ifc_type IN ('IfcWall', 'IfcWallStandardCase')"
_BARE = "trim(regexp_replace(code, '[()]', '', 'g'))"
_VALID = f"regexp_matches({_BARE}, '^\\d{{2}}(\\.\\d{{1,2}})*$')"
_LACKS = "(" + " + ".join(f"CASE WHEN ifc_type IN ({listed([t for t, needed in Q.REQUIRED.items() if x in needed])}) AND v_{x} IS NULL THEN 1 ELSE 0 END" for x in _props if x not in ("Status", "RenovationStatus")) + ")"
_ALLOWED = " OR ".join(f"(ifc_type = '{t}' AND substr({_BARE}, 1, 2) NOT IN ({listed(a.split())}))" for t, a in Q.SFB_ALLOWED.items())
_ILS = {
    ("storeyNaming", "info"): (f"ifc_type = 'IfcBuildingStorey' AND NOT coalesce(regexp_matches(trim(name), {literal(Q.STOREY_NAME)}), false)", "0"),
    ("spaceIncomplete", "warn"): (f"ifc_type = 'IfcSpace' AND ({_blank('name')} OR {_blank('long_name')} OR NOT has_area)", "0"),
    ("doorNaming", "info"): (f"ifc_type = 'IfcDoor' AND NOT coalesce(regexp_matches(trim(name), {literal(Q.DOOR_NAME)}), false)", "1"),
    ("fireRatingInvalid", "warn"): (f"{_WALL} AND v_FireRating IS NOT NULL AND NOT regexp_matches(v_FireRating, {literal(Q.FIRE_VALUE)})", "1"),
    ("extWallNoUValue", "warn"): (f"{_WALL} AND regexp_matches(v_IsExternal, {literal(Q.YES)}) AND v_ThermalTransmittance IS NULL", "1"),
    ("loadBearingInvalidMaterial", "warn"): (f"{_WALL} AND regexp_matches(v_LoadBearing, {literal(Q.YES)}) AND material <> '' AND NOT regexp_matches(material, {literal(Q.STRUCTURAL_MATERIAL)})", "1"),
    ("mepNoRenovationStatus", "info"): (f"{_PHYSICAL} AND ifc_type IN ({listed(Q.FLOW_TYPES)}) AND NOT coalesce(regexp_matches(coalesce(v_RenovationStatus, v_Status), {literal(Q.RENOVATION)}), false)", "1"),
    ("noNLSfB", "error"): (f"{_PHYSICAL} AND code IS NULL", "2"), ("invalidNLSfB", "error"): (f"{_PHYSICAL} AND code IS NOT NULL AND NOT {_VALID}", "1"),
    ("mismatchNLSfB", "warn"): (f"{_PHYSICAL} AND {_VALID} AND ({_ALLOWED})", "1"), ("missingILSProp", "warn"): (f"{_PHYSICAL} AND {_LACKS} > 0", _LACKS),
    ("noDescription", "info"): (f"{_PHYSICAL} AND ({_blank('description')} OR trim(description) = name)", "1"), ("noMaterial", "warn"): (f"{_PHYSICAL} AND {_blank('material')}", "1"),
    ("noStorey", "warn"): (f"{_PHYSICAL} AND {_blank('storey')}", "1"), ("noObjectType", "info"): (f"{_PHYSICAL} AND {_blank('object_type')}", "1"), ("noName", "warn"): (f"{_PHYSICAL} AND {_blank('name')}", "1"),
}


def _dq(rules: dict, examples: int, extra: str = "") -> str:
    hits = " UNION ALL ".join(f"SELECT '{c}' AS \"check\", '{s}' AS severity, express_id, pos FROM e WHERE {w if isinstance(w, str) else w[0]}" for (c, s), w in rules.items())
    return f"""WITH {_VALUES}, h AS ({hits}{extra}), r AS (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY pos, express_id) AS rn FROM h)
SELECT "check", severity, count(*) AS n, string_agg(CASE WHEN rn <= {examples} THEN CAST(express_id AS VARCHAR) END, ',' ORDER BY rn) AS examples FROM r GROUP BY "check", severity"""


_DUPLICATE = """ UNION ALL SELECT 'duplicateName', 'warn', min(express_id), min(pos) FROM e WHERE trim(name) IN (SELECT trim(name) FROM e WHERE trim(name) <> '' GROUP BY 1 HAVING count(*) > 5) GROUP BY name
 UNION ALL SELECT 'guidCollision', 'error', express_id, pos FROM e AS g WHERE global_id <> '' AND pos > (SELECT min(pos) FROM e AS f WHERE f.global_id = g.global_id)"""
DQ_SUITES = {"general": _dq(_GENERAL, 6, _DUPLICATE), "bim": _dq(_BIM, 8), "ils": _dq(_ILS, 8)}
_set = lambda c: f"CASE WHEN {c} IS NULL OR {c} = '' THEN '(not set)' ELSE trim({c}) END"
DQ_DISTRIBUTION = f"WITH {_VALUES} SELECT key, value, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS key, {_set(c)} AS value FROM e" for k, c in (("isExternal", "ext"), ("loadBearing", "lb"), ("fireRating", "fire"), ("classification", "cls"), ("objectType", "object_type"), ("material", "material"), ("storey", "storey"))) + ") AS s GROUP BY 1, 2"
_GROUP = f"nullif(regexp_extract({_BARE}, '^(\\d{{2}})', 1), '')"
SFB_DISTRIBUTION = f"WITH {_VALUES} SELECT CASE WHEN {_GROUP} IS NULL THEN '(geen code)' ELSE {_GROUP} || ' ' || CASE {_GROUP} " + " ".join(f"WHEN '{g}' THEN {literal(n)}" for g, n in Q.SFB_GROUPS.items()) + f" ELSE 'Onbekend' END END AS label, count(*) AS n FROM e WHERE {_PHYSICAL} GROUP BY 1"
COMPLIANCE = f"WITH {_VALUES}, w AS (SELECT " + " + ".join(f"CASE WHEN {w} THEN {n} ELSE 0 END" for w, n in _ILS.values()) + f" AS issues FROM e WHERE {_PHYSICAL}) SELECT CASE WHEN issues = 0 THEN 'Compliant' WHEN issues <= 2 THEN 'Minor issues' ELSE 'Major issues' END AS bucket, count(*) AS n FROM w GROUP BY 1"

# --- merges

LABEL_RECORDS = """SELECT CAST(user_id AS BIGINT) AS id, event_id AS pos, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 3 AS INT) END AS label,
  CASE event_id % 7 WHEN 0 THEN 'verdict' WHEN 1 THEN 'explicit_feedback' WHEN 2 THEN 'thumbs_feedback' WHEN 3 THEN 'issue_created' WHEN 4 THEN 'status_change' WHEN 5 THEN 'semantic_filter' ELSE 'other' END AS label_source,
  event_id % 13 = 0 AS synthetic, event_id AS ts FROM events"""
LABEL_MERGE = f"""WITH r AS (SELECT *, CASE label_source WHEN 'verdict' THEN 4 WHEN 'explicit_feedback' THEN 3 WHEN 'thumbs_feedback' THEN 3 WHEN 'issue_created' THEN 2 WHEN 'status_change' THEN 1 ELSE 0 END AS rnk FROM ({LABEL_RECORDS}) AS s WHERE NOT synthetic),
z AS (SELECT id, max(pos) AS zp FROM r WHERE label IS NULL GROUP BY id), g AS (SELECT r.*, row_number() OVER (PARTITION BY r.id ORDER BY CASE WHEN label IS NULL THEN 1 ELSE 0 END, rnk DESC, label DESC, pos) AS k
  FROM r LEFT JOIN z ON z.id = r.id WHERE zp IS NULL OR pos >= zp)
SELECT id, CAST(label AS DOUBLE) AS label, label_source FROM g WHERE k = 1"""
REPLAY = f"""WITH g AS ({X.CHANGELOG}) SELECT target_id, field, arg_max(value, pos) AS value FROM g WHERE NOT is_local GROUP BY 1, 2"""
SERVER = "SELECT o_orderkey AS id, o_orderpriority AS data, o_orderkey % 100 AS updated_at FROM orders WHERE o_orderkey % 5 <> 0"
CLIENT = "SELECT o_orderkey AS id, o_orderstatus AS data, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 90 END AS seen_at, CAST(1000 AS BIGINT) AS now FROM orders WHERE o_orderkey % 3 = 0"
_UPSERT = f"WITH s AS ({SERVER}), c AS ({CLIENT}), j AS (SELECT coalesce(s.id, c.id) AS id, s.data AS sd, c.data AS cd, s.updated_at AS st, c.now AS ct, c.id IS NOT NULL AS sent, coalesce(c.id IS NOT NULL AND s.updated_at > c.seen_at, false) AS clash FROM s FULL JOIN c ON s.id = c.id) "
UPSERT_STATE = _UPSERT + "SELECT id, CASE WHEN sent AND NOT clash THEN cd ELSE sd END AS data, CASE WHEN sent AND NOT clash THEN ct ELSE st END AS updated_at FROM j"
UPSERT_CONFLICTS = _UPSERT + "SELECT id FROM j WHERE clash"
RELATIONAL = _UPSERT + """SELECT 'M' || CAST(id % 3 AS VARCHAR) AS project_id, id, CASE WHEN sent AND NOT clash THEN cd ELSE sd END AS data, CASE WHEN sent AND NOT clash THEN 'second' ELSE 'first' END AS updated_by,
  CASE WHEN sent AND NOT clash THEN ct ELSE st END AS updated_at, clash AS conflict FROM j WHERE id % 3 <> 1"""
DELTA = on_elements("""SELECT global_id, express_id, CASE WHEN express_id % 10 = 0 THEN name || ' v2' ELSE name END AS name FROM e WHERE express_id % 10 = 0
  OR (global_id IN (SELECT global_id FROM e WHERE express_id % 4 <> 0) AND global_id NOT IN (SELECT global_id FROM e WHERE express_id % 10 = 0))""")
CHANGE_COLUMNS = (
    "CAST(event_id % 300 AS BIGINT) AS express_id", "event_id AS pos", "CASE event_id % 5 WHEN 0 THEN 'deleted' WHEN 1 THEN 'modified' ELSE 'properties-only' END AS op",
    "CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS name", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'm' || CAST(event_id AS VARCHAR(20)) END AS material",
)
CHANGES = f"SELECT {', '.join(CHANGE_COLUMNS)} FROM events"
CDC = f"""WITH e AS ({X.ELEMENTS}), s AS (SELECT express_id, name, material FROM e WHERE express_id % 97 <> 0), c AS ({CHANGES}),
r AS (SELECT express_id, arg_max(op, pos) AS op, max(pos) AS rp FROM c WHERE op <> 'properties-only' GROUP BY 1),
m AS (SELECT c.* FROM c JOIN r ON r.express_id = c.express_id AND r.rp = c.pos AND r.op = 'modified'),
q AS (SELECT c.express_id, arg_max(c.name, c.pos) FILTER (WHERE c.name IS NOT NULL) AS name, arg_max(c.material, c.pos) FILTER (WHERE c.material IS NOT NULL) AS material FROM c LEFT JOIN r ON r.express_id = c.express_id
  WHERE c.op = 'properties-only' AND (r.rp IS NULL OR c.pos > r.rp) GROUP BY 1),
k AS (SELECT express_id FROM s UNION SELECT express_id FROM m)
SELECT k.express_id, coalesce(q.name, CASE WHEN m.express_id IS NOT NULL THEN m.name ELSE s.name END) AS name, coalesce(q.material, CASE WHEN m.express_id IS NOT NULL THEN m.material ELSE s.material END) AS material
FROM k LEFT JOIN s ON s.express_id = k.express_id LEFT JOIN m ON m.express_id = k.express_id LEFT JOIN q ON q.express_id = k.express_id LEFT JOIN r ON r.express_id = k.express_id WHERE r.op IS NULL OR r.op <> 'deleted'"""
REDETECT = f"""WITH c AS ({X.CLASHES}), o AS (SELECT elem_a, elem_b, least('G' || CAST(elem_a AS VARCHAR), 'G' || CAST(elem_b AS VARCHAR)) AS lo, greatest('G' || CAST(elem_a AS VARCHAR), 'G' || CAST(elem_b AS VARCHAR)) AS hi, min(status) AS status FROM c GROUP BY 1, 2),
a AS (SELECT * FROM o WHERE (elem_a + elem_b) % 3 <> 0), b AS (SELECT * FROM o WHERE (elem_a + elem_b) % 4 <> 0),
j AS (SELECT a.status AS s, a.lo AS al, b.lo AS bl FROM a FULL JOIN b ON a.lo = b.lo AND a.hi = b.hi)
SELECT CASE WHEN al IS NULL THEN 'new' WHEN bl IS NULL THEN 'resolved' ELSE 'persistent' END AS outcome, coalesce(s, 'open') AS status, count(*) AS n FROM j GROUP BY 1, 2"""
BATCH_UPDATE = on_elements("SELECT CASE WHEN x0 < 20000 THEN 'L9' ELSE storey END AS storey, count(*) AS n FROM e GROUP BY 1")
CHANGED = on_elements("SELECT count(*) AS n FROM e AS a WHERE NOT EXISTS (SELECT 1 FROM e AS b WHERE b.express_id % 3 = 0 AND b.global_id = a.global_id AND b.name = a.name)")
LOOKUP = on_elements("""SELECT CASE WHEN express_id % 2 = 0 AND model_id = 'M2' THEN 'M2' WHEN model_id = 'M0' OR express_id % 5 = 0 THEN 'M0' ELSE model_id END AS model_id, count(*) AS n FROM e WHERE express_id % 7 <> 0 GROUP BY 1""")

# --- curation, text, formats

TRAINABLE = f"SELECT count(*) FILTER (WHERE label_source IN ('verdict', 'thumbs_feedback', 'explicit_feedback')) AS n FROM ({LABEL_RECORDS}) AS r"
TRAINING = on_clashes("""SELECT ifc_type_a, clash_type, verdict, type_pair_tolerance_mm, count(*) AS n, round(sum(depth), 1) AS depth FROM (SELECT elem_a_type AS ifc_type_a, type AS clash_type,
  CASE status WHEN 'resolved' THEN 'acceptable' ELSE 'false_positive' END AS verdict, CASE WHEN least(elem_a_type, elem_b_type) = 'IfcBeam' AND greatest(elem_a_type, elem_b_type) = 'IfcWall' THEN CAST(25 AS DOUBLE) END AS type_pair_tolerance_mm,
  CASE WHEN type = 'hard' AND distance_mm > 0 THEN floor(distance_mm / 8.0 * 10 + 0.5) / 10 ELSE 0 END AS depth FROM c WHERE status <> 'open') AS s GROUP BY 1, 2, 3, 4""")
_redacted = "text"
for _pattern, _to in text.REDACTIONS:
    _redacted = f"regexp_replace({_redacted}, {literal(_pattern)}, {literal(_to)}, 'g')"
REDACT = f"SELECT doc_id, md5({_redacted}) AS redacted FROM documents"
REDUCE = "SELECT p_partkey, coalesce(nullif(regexp_extract(p_type, '(?i)\\b(" + text.PROFILE_WORDS + ")\\b', 1), '') || ' ', '') || 'HEA Beam ' || CAST(p_size AS VARCHAR) || 'x200' AS reduced FROM part"
COMMANDS = "SELECT count(*) AS n FROM conversations WHERE regexp_matches(trim(text), '\\s')"
TOPICS = f"""WITH i AS ({ISSUES}) SELECT id, md5('="Clash" TopicStatus="' || status || '"><Title>Issue &lt;' || CAST(id AS VARCHAR) || '&gt; &amp; co</Title><Priority>' || priority || '</Priority><Description>' || description || '</Description></Topic></Markup>') AS markup FROM i"""
LABELS_JSONL = f"""SELECT count(*) AS n, CAST(sum(length('{{"id":,"label":,"label_source":""}}') + length(CAST(id AS VARCHAR)) + length(CAST(label AS VARCHAR)) + length(label_source)) AS BIGINT) AS chars FROM ({LABEL_RECORDS}) AS r WHERE label IS NOT NULL"""
WIRE_TYPES = on_elements("SELECT CASE WHEN express_id % 6 = 1 THEN 'IfcSpace' ELSE ifc_type END AS ifc_type, count(*) AS n, CAST(sum(CASE WHEN express_id % 6 = 1 THEN 0 ELSE 1 END) AS BIGINT) AS meshes FROM e WHERE express_id % 6 <> 0 GROUP BY 1")
MESH_DECODE = f"WITH t AS ({X.TRIANGLES}) SELECT count(*) AS n, sum(x0) AS x0, sum(z2) AS z2 FROM t"
RATE_LIMIT = """WITH RECURSIVE q AS (SELECT user_id AS ip, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT ip, k, t AS start, 1 AS c FROM q WHERE k = 1 UNION ALL SELECT q.ip, q.k, CASE WHEN q.t - w.start > 86400000 THEN q.t ELSE w.start END, CASE WHEN q.t - w.start > 86400000 THEN 1 ELSE w.c + 1 END FROM w JOIN q ON q.ip = w.ip AND q.k = w.k + 1)
SELECT ip, count(*) AS n, count(*) FILTER (WHERE c > 2) AS rejected FROM w GROUP BY ip"""

_AX = "CASE WHEN {0}.x1 - {0}.x0 >= {0}.z1 - {0}.z0 THEN 1 ELSE 0 END"
_DX, _DY, _DZ = (f"((a.{k}0 + a.{k}1) / 2.0 - (b.{k}0 + b.{k}1) / 2.0)" for k in "xyz")
PARALLEL = pairs(f"{ACROSS} AND NOT ({_AX.format('a')} = {_AX.format('b')} AND sqrt({_DY} * {_DY} + CASE WHEN {_AX.format('a')} = 1 THEN {_DZ} * {_DZ} ELSE {_DX} * {_DX} END) > 500)")
SEGMENTS = f"""WITH RECURSIVE e AS ({X.ELEMENTS}), q AS (SELECT express_id AS id, storey || ':' || ifc_type AS pair, x0 AS x, y0 AS y, z0 AS z FROM e),
g AS (SELECT a.id AS a, b.id AS b FROM q AS a JOIN q AS b ON a.pair = b.pair AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 160000),
r AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a), m AS (SELECT a, min(b) AS cluster FROM r GROUP BY a)
SELECT pair, cluster, count(*) AS n, round(avg(x), 3) AS x, round(avg(y), 3) AS y, round(avg(z), 3) AS z FROM q JOIN m ON m.a = q.id GROUP BY 1, 2"""
SHARED = f"""WITH i AS ({ISSUES}) SELECT status, CASE WHEN id % 7 = 0 THEN 'normal' ELSE priority END AS priority, source, count(*) AS n, count(CASE WHEN id % 3 <> 0 THEN 1 END) AS distances FROM i WHERE id % 6 <> 0 AND id % 5 <> 0 GROUP BY 1, 2, 3"""
WALK = f"""WITH e AS ({X.ELEMENTS}) SELECT a.express_id AS elem_a, b.express_id AS elem_b, floor((a.y0 + a.y1 + b.y0 + b.y1) / 4.0 * 1000 + 0.5) / 1000 AS elevation
FROM e AS a JOIN e AS b ON a.express_id < b.express_id AND {overlap()} WHERE {ACROSS} ORDER BY 3, 1, 2"""
LINKS = on_elements("SELECT CASE WHEN express_id % 3 = 0 THEN 'host' WHEN express_id % 2 = 0 THEN 'L' || CAST(express_id % 4 AS VARCHAR) || '#i1' ELSE 'L' || CAST(express_id % 4 AS VARCHAR) END AS link, count(*) AS n FROM e GROUP BY 1")
SHEETS = "SELECT n_nationkey AS id, n_name AS name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS annotations FROM nation"
VIEWPOINTS = on_elements("SELECT CASE WHEN express_id % 2 = 0 THEN name ELSE 'remote' END AS name, count(*) AS n FROM e WHERE express_id % 2 = 0 OR express_id % 3 = 0 GROUP BY 1")
BATCH_INSERT = "SELECT count(*) FILTER (WHERE event_id % 4 < 2) AS inserted, count(*) FILTER (WHERE event_id % 4 >= 2) AS skipped FROM events"
RESOLVE = on_elements("SELECT a.express_id * 2 AS revit_id, coalesce(b.global_id, CAST(a.express_id * 2 AS VARCHAR)) AS gid FROM e AS a LEFT JOIN e AS b ON b.express_id = a.express_id * 2")
CASCADE = on_elements("SELECT model_id, count(*) AS n FROM e WHERE model_id = 'M1' GROUP BY 1")
SHAPES = f"""WITH q AS (SELECT *, (p_size - 25) / 16.0 AS m, {X.TYPE_SQL.replace("IfcBuildingElementProxy", "IfcSpace")} AS t FROM part)
SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN CASE WHEN m < 0 THEN floor(m * 1000 + 0.5) ELSE -1 END ELSE floor(abs(m) * 1000 + 0.5) END AS BIGINT) AS mm,
  CASE WHEN p_size < 10 THEN CAST(p_size * 100 AS VARCHAR) || ' mm' ELSE printf('%.2f m', p_size / 10.0) END AS label, greatest(0.01, least(0.99, p_size / 40.0)) AS position,
  CAST(floor(10000.0 / (p_size + 1) + 0.5) AS BIGINT) AS pixels, CASE WHEN p_size % 3 <> 2 THEN 'major' WHEN p_size % 2 <> 1 THEN 'minor' ELSE 'ok' END AS protocol,
  CASE WHEN t = 'IfcSpace' THEN 'false_positive' WHEN p_size % 2 = 1 THEN 'minor' WHEN p_size * 5 >= 100 THEN 'critical' WHEN p_size * 5 >= 20 THEN 'major' ELSE 'minor' END AS severity FROM q"""

# --- records on their way in and out

ISSUES_ALL = f"SELECT status, count(*) AS n FROM ({ISSUES}) AS i GROUP BY 1"
REVIEWED = f"""SELECT status, source, count(*) AS n FROM (SELECT status, CAST(NULL AS VARCHAR) AS source FROM ({X.CLASHES}) AS c UNION ALL SELECT status, source FROM ({ISSUES}) AS i WHERE source = 'clash') AS r
WHERE status IS NULL OR status <> 'open' GROUP BY 1, 2"""
SIDES = on_elements("""SELECT side, count(*) AS n FROM e JOIN (VALUES ('west', 'M0'), ('west', 'M2'), ('structural + services', 'M1'), ('structural + services', 'M2'), ('all', 'M0'), ('all', 'M1'), ('all', 'M2')) AS s(side, m) ON m = model_id GROUP BY 1""")
RECORD_TEXTS = """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'soft' ELSE 'hard' END AS kind, 'see [id] of [email] in [path]' AS note,
  upper(substr(regexp_replace(p_name, '[^a-zA-Z0-9]', '', 'g'), 1, 4)) || '-' || translate(substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 6), '01', 'gh') AS project_key,
  CASE p_size % 4 WHEN 0 THEN CAST(0.001 AS DOUBLE) WHEN 1 THEN CAST(0.01 AS DOUBLE) WHEN 2 THEN CAST(0.3048 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS ratio,
  round(p_size * CASE p_size % 4 WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN CAST(10 AS DOUBLE) WHEN 2 THEN CAST(304.8 AS DOUBLE) ELSE CAST(1000 AS DOUBLE) END, 6) AS length,
  CASE WHEN p_size % 3 = 0 THEN '[' || CAST(p_size AS VARCHAR) || ']' END AS found FROM part"""
PLACED = f"""WITH t AS ({X.TRIANGLES}) SELECT express_id, tri_idx, {", ".join(f"2 * z{i} + express_id % 10 AS x{i}, 2 * y{i} + 5 AS y{i}, 0 - 2 * x{i} - express_id % 10 AS z{i}" for i in range(3))} FROM t"""
WIRE = on_elements("""SELECT express_id, global_id, CASE WHEN express_id % 5 = 0 OR express_id % 7 = 0 THEN 'IfcBuildingElementProxy' ELSE ifc_type END AS ifc_type, name,
  CASE WHEN express_id % 3 <> 0 THEN material END AS object_type, storey, material || ', ' || model_id AS material, CASE WHEN express_id % 2 = 0 THEN 1 ELSE 0 END AS sets FROM e""")
UPDATED = on_elements("SELECT express_id, CASE WHEN express_id = 7 THEN 'seven' ELSE name END AS name, CASE WHEN express_id = 7 THEN 'L9' ELSE storey END AS storey FROM e")
COMMANDS_JSONL = """SELECT '{"messages":[{"role":"system","content":"Answer."},{"role":"user","content":"' || p_name || '"}' || CASE WHEN p_partkey % 3 = 0 THEN ',{"role":"assistant","content":"' || p_brand || '"}' ELSE '' END
  || '],"matched":' || CASE WHEN p_partkey % 3 = 0 THEN 'true' ELSE 'false' END || ',"path":"' || CASE WHEN p_size % 2 = 0 THEN 'fast' ELSE 'smart' END || '"}' AS value FROM part"""
IDS = on_elements("""SELECT DISTINCT 'R & D' AS title, 'On <' || ifc_type || '>' AS name, upper(ifc_type) AS entity, CASE ifc_type WHEN 'IfcWall' THEN 'property: Pset_IfcWall.FireRating'
  WHEN 'IfcSlab' THEN 'property: Pset_IfcSlab.*' WHEN 'IfcBeam' THEN 'material' WHEN 'IfcDoor' THEN 'partOf: IFCBUILDINGSTOREY' ELSE 'attribute: GlobalId' END AS requirements FROM e""")
SAMPLED = """WITH p AS (SELECT o_orderkey % 2 AS pair, o_orderkey AS idx, count(*) OVER (PARTITION BY o_orderkey % 2) AS n FROM orders)
SELECT pair, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx FROM p WHERE idx % CASE WHEN n > 500 THEN n // 500 + 1 ELSE 1 END = 0 GROUP BY 1"""
GROUPED = on_clashes(" UNION ALL ".join(f"SELECT '{key}' AS dimension, {column} AS value, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM c GROUP BY 2" for key, column in (("storey", STOREY), ("typeA", "elem_a_type"), ("typeB", "elem_b_type"), ("status", "status"), ("type", "type"), ("discipline", "discipline_a"))))
METRICS = f"""WITH c AS ({X.CLASHES}), i AS ({ISSUES}) SELECT 'clash_count' AS metric, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM c UNION ALL SELECT 'issue_count', NULL, count(*) FROM i
UNION ALL SELECT 'open_clashes', NULL, count(*) FROM c WHERE status = 'open' UNION ALL SELECT 'status_breakdown', status, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'type_breakdown', type, count(*) FROM c GROUP BY 2
UNION ALL SELECT 'discipline_breakdown', side, count(*) FROM (SELECT unnest([discipline_a, discipline_b]) AS side FROM c) AS s WHERE side <> '' GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'worst_storey', {STOREY} AS s, count(*) AS k FROM c GROUP BY 2 ORDER BY k DESC, s LIMIT 1) AS w"""

DOUBLED = f"""WITH e AS ({X.ELEMENTS}), o AS (SELECT express_id, model_id, pos, CASE WHEN express_id % 9 <> 0 THEN ifc_type END AS ifc_type, storey, name, material, global_id, x0, y0, z0, x1, y1, z1 FROM e)
SELECT * FROM o UNION ALL SELECT express_id + 1000000, 'M' || CAST((express_id + 1) % 3 AS VARCHAR(9)), pos + 1000000, ifc_type, storey, name, material, global_id, x0, y0, z0, x1, y1, z1 FROM o WHERE express_id % 10 = 0
UNION ALL SELECT express_id + 2000000, 'M' || CAST((express_id + 1) % 3 AS VARCHAR(9)), pos + 2000000, ifc_type, storey, name, material, global_id, x0, y0, z0, x1, y1, z1 FROM o WHERE express_id % 20 = 0"""
_SAME = "a.ifc_type IS NOT DISTINCT FROM b.ifc_type AND " + " AND ".join(f"a.{k}{i} = b.{k}{i}" for k in "xyz" for i in (0, 1))
_TYPES_OK = "NOT coalesce(least(a.ifc_type, b.ifc_type) = 'IfcBeam' AND greatest(a.ifc_type, b.ifc_type) = 'IfcBeam' AND a.ifc_type IS NOT NULL AND b.ifc_type IS NOT NULL OR a.ifc_type = 'IfcWall' AND b.ifc_type = 'IfcSlab' OR a.ifc_type = 'IfcSlab' AND b.ifc_type = 'IfcWall', false)"
ALL_TYPES = f"""WITH e AS ({DOUBLED}), p AS (SELECT a.express_id AS elem_a, b.express_id AS elem_b, a.ifc_type AS ta, b.ifc_type AS tb, {_SAME} AS same, {overlap()} AS hard, a.express_id < 1000000 AS first
  FROM e AS a JOIN e AS b ON a.pos < b.pos AND a.model_id <> b.model_id AND {overlap(50)} AND {_TYPES_OK})
SELECT elem_a, elem_b, CASE WHEN same THEN 'duplicate' WHEN hard THEN 'hard' ELSE 'soft' END AS type, coalesce({_NICE('ta')}, 'Element') || CASE WHEN ta IS NOT DISTINCT FROM tb THEN ' vs ' ELSE ' × ' END || coalesce({_NICE('tb')}, 'Element') AS title FROM p WHERE NOT same OR first"""
_ENDS = "); it''s \\ #1=IFCWALL(''é'',$);"
STEP = f"""WITH e AS ({X.DQ_ELEMENTS}), p AS (SELECT express_id, count(v) AS properties, count(DISTINCT CASE WHEN v IS NOT NULL THEN pset END) AS sets, max(CASE WHEN pset = 'Pset_WallCommon' AND k = 'FireRating' THEN v END) AS fire_rating FROM ({X.ELEMENT_PROPS}) AS q GROUP BY 1)
SELECT e.express_id, global_id, ifc_type, name || '{_ENDS}' AS name, description, object_type, nullif(storey, '') AS storey, material, fire_rating, coalesce(sets, 0) AS sets, coalesce(properties, 0) AS properties
FROM e LEFT JOIN p ON p.express_id = e.express_id WHERE ifc_type <> 'IfcBuildingStorey'"""
MESSAGE_COLUMNS = (
    "user_id AS model_id", "timestamp_seconds(event_id) AS ts", "event_id AS pos", "CASE event_id % 20 WHEN 0 THEN 'model-start' WHEN 7 THEN 'model-end' WHEN 13 THEN 'error' ELSE 'element-batch' END AS kind", "event_id % 5 AS n",
)
ASSEMBLED = f"""WITH m AS (SELECT {', '.join(c for c in MESSAGE_COLUMNS if ' AS ts' not in c)} FROM events), s AS (SELECT model_id, max(pos) FILTER (WHERE kind = 'model-start') AS begun, arg_max(kind, pos) AS kind FROM m GROUP BY 1),
r AS (SELECT m.model_id, CAST(coalesce(sum(n) FILTER (WHERE m.kind = 'element-batch' AND (begun IS NULL OR pos > begun)), 0) AS BIGINT) AS received, min(s.kind) AS kind FROM m JOIN s ON s.model_id = m.model_id GROUP BY 1)
SELECT model_id, received, CASE kind WHEN 'model-end' THEN 'complete' WHEN 'error' THEN CASE WHEN received > 0 THEN 'partial' ELSE 'failed' END ELSE 'receiving' END AS status FROM r"""
SENT_COLUMNS = ("user_id AS global_id", "timestamp_seconds(event_id) AS ts", "event_id AS pos", "CASE WHEN event_id % 17 <> 0 THEN event_type END AS hash")
CHANGED_CONTENT = f"""WITH s AS (SELECT {', '.join(c for c in SENT_COLUMNS if ' AS ts' not in c)} FROM events) SELECT * FROM s QUALIFY hash IS DISTINCT FROM lag(hash) OVER (PARTITION BY global_id ORDER BY pos)"""
REMOTE = "SELECT o_custkey AS id, o_orderpriority || CAST(o_orderkey AS VARCHAR(20)) AS value, o_orderkey % 1000 AS updated_at FROM orders WHERE o_orderkey % 7 < 3"
SYNCED = f"WITH r AS ({REMOTE}) SELECT id, max(updated_at) AS updated_at, max(value) AS value FROM r AS q WHERE updated_at = (SELECT max(updated_at) FROM r WHERE r.id = q.id) GROUP BY id"
BCF = f"""WITH i AS ({ISSUES}), g AS (SELECT global_id, min(express_id) AS express_id FROM ({X.ELEMENTS}) AS e GROUP BY 1), c AS (SELECT *, id % 7 <> 0 AS listed, 'G' || CAST(id % 150 AS VARCHAR) AS g1, 'G' || CAST(id % 90 AS VARCHAR) AS g2 FROM i)
SELECT v.version, title, 'Clash' AS type, status, priority, description, CASE WHEN id % 2 = 1 THEN 'A. B' END AS assignee, CASE WHEN id % 3 = 0 THEN 'a & b|<' || status || '>' ELSE '' END AS labels, CASE WHEN id % 2 = 0 THEN CAST(id * 10 AS VARCHAR) END AS revit_a, CASE WHEN id % 4 = 0 THEN CAST(id * 10 + 1 AS VARCHAR) END AS revit_b,
  CASE WHEN id % 5 <> 0 THEN CAST(id % 50 AS DOUBLE) END AS x, CASE WHEN id % 5 <> 0 THEN CAST((0 - id) % 7 AS DOUBLE) END AS z, CASE WHEN id % 5 <> 0 THEN CAST(40 + id % 20 AS DOUBLE) END AS angle,
  CASE WHEN NOT listed THEN '' WHEN g1 = g2 THEN g1 || '|unknown' ELSE g1 || '|unknown|' || g2 END AS components,
  CASE WHEN NOT listed THEN '' ELSE concat_ws('|', CAST(a.express_id AS VARCHAR), CASE WHEN g1 <> g2 THEN CAST(b.express_id AS VARCHAR) END) END AS elements
FROM c LEFT JOIN g AS a ON a.global_id = g1 LEFT JOIN g AS b ON b.global_id = g2, (SELECT unnest(['2.1', '3.0']) AS version) AS v"""
PROJECT = f"""SELECT 'clashes' AS section, status, count(*) AS n, count(elem_b_type) AS typed, CAST(sum(id) AS BIGINT) AS ids FROM ({X.CLASHES}) AS c GROUP BY 2 UNION ALL SELECT 'issues', substr(title, 1, 7), count(*), count(title), CAST(sum(id) AS BIGINT) FROM ({ISSUES}) AS i GROUP BY 2"""
_PAIR = "least(elem_a_type, coalesce(elem_b_type, '?')) || ' vs ' || greatest(elem_a_type, coalesce(elem_b_type, '?'))"
FOCUS = on_clashes(f"""SELECT * FROM (SELECT 'worst_area' AS focus, {STOREY} AS value, count(*) AS n FROM c GROUP BY 2 ORDER BY n DESC, value LIMIT 1) AS w
UNION ALL SELECT 'by_discipline', side, count(*) FROM (SELECT unnest([discipline_a, discipline_b]) AS side FROM c) AS s GROUP BY 2
UNION ALL SELECT 'summary', 'status: ' || status, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'summary', 'type: ' || type, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'summary', 'storey: ' || {STOREY}, count(*) FROM c GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'patterns', {_PAIR} AS pair, count(*) AS k FROM c GROUP BY 2 ORDER BY k DESC, pair LIMIT 5) AS p""")
COMMAND_PLANS = f"""WITH c AS ({X.CLASHES}), e AS ({X.ELEMENTS}), i AS ({ISSUES}) SELECT 'show closed clashes' AS said, count(*) AS n FROM c WHERE status = 'closed' UNION ALL SELECT 'show critical', count(*) FROM c WHERE priority = 'critical'
UNION ALL SELECT 'reset all filters', count(*) FROM c UNION ALL SELECT 'sort by priority', count(*) FROM c UNION ALL SELECT 'group by floor', count(DISTINCT {STOREY}) FROM c UNION ALL SELECT 'how many clashes?', 1 UNION ALL SELECT 'how many open clashes?', 1
UNION ALL SELECT 'count by discipline', count(DISTINCT s) FROM (SELECT unnest([discipline_a, discipline_b]) AS s FROM c) AS q UNION ALL SELECT 'make a report', 1 UNION ALL SELECT 'analyze patterns', least(5, count(DISTINCT {_PAIR})) FROM c
UNION ALL SELECT 'color by storey', count(DISTINCT storey) FROM e UNION ALL SELECT 'find hard clashes only', count(*) FROM e AS a JOIN e AS b ON a.pos < b.pos AND a.model_id <> b.model_id AND {overlap()} UNION ALL SELECT 'export bcf 3.0', count(*) FROM i
UNION ALL SELECT 'resolve all soft', count(*) FROM c WHERE status = 'resolved' OR id IN (SELECT id FROM c WHERE type = 'soft') UNION ALL SELECT 'create project tower', 4 UNION ALL SELECT 'rename project to west wing', 1 UNION ALL SELECT 'set the gap to 5 cm', 3"""
