"""STEP text: byte ranges against a plain parser, references, and a round trip."""

import random

import pytest
from pyspark.sql import functions as F

from coordspark.sources import step

HEAD = "ISO-10303-21;\nHEADER;\nFILE_NAME('a;b','2024',('x''y'),(''),'','','');\nENDSEC;\nDATA;\n"


def plain_entities(text):
    """Statement by statement, byte by byte."""
    out, now, state, i = [], "", "plain", 0
    while i < len(text):
        two = text[i : i + 2]
        if state == "plain" and two == "/*":
            state, i = "comment", i + 2
        elif state == "comment" and two == "*/":
            state, i, now = "plain", i + 2, now + " "
        elif state == "comment":
            i += 1
        elif text[i] == ";" and state == "plain":
            out.append(now.strip())
            now, i = "", i + 1
        else:
            if text[i] == "'":
                state = "string" if state == "plain" else "plain"
            now, i = now + text[i], i + 1
    found = []
    for s in out:
        if s.startswith("#") and "=" in s:
            number, body = s[1:].split("=", 1)
            body = body.strip()
            if body[0] != "(":
                kind, rest = body.split("(", 1)
                args, depth, quoted, part = [], 0, False, ""
                for c in rest.rstrip()[:-1]:
                    quoted ^= c == "'"
                    depth += 0 if quoted else (c == "(") - (c == ")")
                    if c == "," and not depth and not quoted:
                        args.append(part.strip())
                        part = ""
                    else:
                        part += c
                found.append((int(number), kind.strip().upper(), [*args, part.strip()]))
    return found


def random_step(rng, n):
    strings = ["", "plain", "It''s", "a;b", "Door (left); new", "); #7=IFCWALL('", "/* no comment", "*/", "''", "é/*ü", "''';"]
    strings = [s for s in strings if s.replace("''", "").count("'") == 0] + ["); #7=IFCWALL(''x'');"]
    out = HEAD
    for i in range(n):
        args = [rng.choice(["$", "*", "#3", "(#1,#2)", ".T.", "1.5", "IFCTEXT('(;')", "((1,2),('a,b'))", f"'{rng.choice(strings)}'", f"'{rng.choice(strings)}'"]) for _ in range(rng.randrange(1, 6))]
        out += rng.choice(["", " ", "\n", "/* a; 'b */", "/**/", "/* x **/"]) + f"#{i}" + rng.choice(["=", " = ", "\n=\n"]) + rng.choice(["IFCWALL", "ifcslab "]) + "(" + rng.choice([",", ", ", ",\n  ", ",/*;*/"]).join(args) + ")" + rng.choice([";", " ;", "\n;", "/*;*/;"])
        if rng.random() < 0.1:
            out += f"#9{i}=(IFCA(1)IFCB('x;'));"
    return out + "\nENDSEC;\nEND-ISO-10303-21;\n"


def test_states_of_ranges_compose():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab'/*;\n") for _ in range(rng.randrange(40))).encode()
        cut = sorted(rng.randrange(len(text) + 1) for _ in range(3))
        for state in range(step.STATES):
            whole = now = state
            for c in (text[i : i + 1] for i in range(len(text))):
                whole = step.end_state(c, whole)
            for a, b in zip([0, *cut], [*cut, len(text)], strict=True):
                now = step.end_state(text[a:b], now)
            assert now == whole == step.end_state(text, state)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 17, 64, 1000, 1 << 20])
def test_ranges_equal_a_plain_parser(tmp_path, monkeypatch, size):
    monkeypatch.setattr(step, "AHEAD_BYTES", 5)
    text = random_step(random.Random(size), 60)
    (tmp_path / "m.ifc").write_text(text, encoding="utf-8")
    raw, uri, state, got = text.encode(), f"file://{tmp_path}/m.ifc", step.PLAIN, []
    for r in step.ranges_of([(uri, len(raw))], size):
        got += step.range_entities(uri, r.start, r.end, r.size, state)
        state = step.end_state(raw[r.start : r.end], state)
    assert got == plain_entities(text) and len(got) == 60


def test_texts():
    for s in ("", "It's", "a\\b", "é €\n\U0001f3e0'", "X2"):
        assert step.plain_text(step.quoted_text(s)) == s
    assert step.plain_text(r"'\X\E9 \S\i \X4\0001F3E0\X0\ \PA\x'") == "é é \U0001f3e0 x" and step.plain_text("$") is None and step.plain_text(None) is None
    assert step.arguments("") == [] and step.arguments("$") == ["$"] and step.arguments("'a,b',(1,(2,3)),#4") == ["'a,b'", "(1,(2,3))", "#4"]


MODEL = HEAD + """
#1=IFCBUILDINGSTOREY('g1',$,'Ground; floor',$,$,$,$,$,.ELEMENT.,-0.5);
#2=IFCSPACE('g2',$,'S1',$,$,$,$,'Hall',.ELEMENT.,.INTERNAL.,$);
#3=IFCRELAGGREGATES('r1',$,$,$,#1,(#2));
#10=IFCWALLSTANDARDCASE('g10',$,'Wall (a); it''s',$,'T1',#90,$,'tag');
#11=IFCDOOR('g11',$,$,'d',$,#90,$,$,2.,1.) ;
#12=IFCOPENINGELEMENT('g12',$,$,$,$,#90,$,$);
#13=IFCFURNISHINGELEMENT('g13',$,'Chair',$,$,#90,$,$);
#14=IFCBEAM('g14',$,'part',$,$,#90,$,$);
#15=IFCELEMENTASSEMBLY('g15',$,'frame',$,$,#90,$,$,$,$);
#16=IFCRELAGGREGATES('r6',$,$,$,#15,(#14));
#20=IFCRELCONTAINEDINSPATIALSTRUCTURE('r2',$,$,$,(#10,#11,#15),#1);
#21=IFCRELCONTAINEDINSPATIALSTRUCTURE('r3',$,$,$,(#13),#2);
#22=IFCRELVOIDSELEMENT('r4',$,$,$,#10,#12);
#23=IFCRELFILLSELEMENT('r5',$,$,$,#12,#11);
#30=IFCPROPERTYSET('p1',$,'Pset_WallCommon',$,(#31,#32,#33,#34,#35));
#31=IFCPROPERTYSINGLEVALUE('IsExternal',$,IFCBOOLEAN(.T.),$);
#32=IFCPROPERTYSINGLEVALUE('FireRating',$,IFCLABEL('REI (60); #31'),$);
#33=IFCPROPERTYSINGLEVALUE('ThermalTransmittance',$,IFCTHERMALTRANSMITTANCEMEASURE(0.24),$);
#34=IFCPROPERTYSINGLEVALUE('Empty',$,$,$);
#35=IFCPROPERTYENUMERATEDVALUE('Status',$,(IFCLABEL('NEW'),IFCLABEL('OLD, x')),$);
#36=IFCRELDEFINESBYPROPERTIES('r7',$,$,$,(#10,#11),#30);
#37=IFCELEMENTQUANTITY('q1',$,'Base',$,$,(#38,#39));
#38=IFCQUANTITYLENGTH('Width',$,$,200.,$);
#39=IFCQUANTITYAREA('NetArea',$,$,12.5,$);
#40=IFCRELDEFINESBYPROPERTIES('r8',$,$,$,(#10),#37);
#41=IFCWALLTYPE('t1',$,'Type',$,$,(#42),$,$,$,.STANDARD.);
#42=IFCPROPERTYSET('p2',$,'Pset_WallCommon',$,(#43,#44));
#43=IFCPROPERTYSINGLEVALUE('FireRating',$,IFCLABEL('of the type'),$);
#44=IFCPROPERTYSINGLEVALUE('LoadBearing',$,IFCBOOLEAN(.F.),$);
#45=IFCRELDEFINESBYTYPE('r9',$,$,$,(#10),#41);
#50=IFCMATERIAL('Brick');
#51=IFCMATERIAL('Wool');
#52=IFCMATERIALLAYER(#50,100.,$);
#53=IFCMATERIALLAYER(#51,80.,$);
#54=IFCMATERIALLAYERSET((#52,#53,#52),$);
#55=IFCMATERIALLAYERSETUSAGE(#54,.AXIS2.,.POSITIVE.,0.);
#56=IFCRELASSOCIATESMATERIAL('r10',$,$,$,(#10),#55);
#57=IFCRELASSOCIATESMATERIAL('r11',$,$,$,(#11),#50);
ENDSEC;
"""


@pytest.mark.parametrize("size", [97, 1 << 20])
def test_elements_with_what_refers_to_them(spark, tmp_path, size):
    (tmp_path / "m.ifc").write_text(MODEL)
    (tmp_path / "n.ifc").write_text(HEAD + "#10=IFCSLAB('other',$,$,$,$,$,$,$);\nENDSEC;")
    (tmp_path / "empty.ifc").write_text("")
    rows = {(r.file[-5], r.express_id): r for r in step.read_elements(spark, f"file://{tmp_path}", range_bytes=size).collect()}
    assert {k: v.ifc_type for k, v in rows.items()} == {
        ("m", 2): "IfcSpace", ("m", 10): "IfcWallStandardCase", ("m", 11): "IfcDoor", ("m", 12): "IfcOpeningElement", ("m", 13): "IfcFurnishingElement", ("m", 14): "IfcBeam", ("m", 15): "IfcElementAssembly", ("n", 10): "IfcSlab",
    }
    wall, door = rows["m", 10], rows["m", 11]
    assert (wall.name, wall.global_id, wall.object_type, wall.storey, wall.material, [x.width for x in wall.layers]) == ("Wall (a); it's", "g10", "T1", "Ground; floor", "Brick, Wool", ["100", "80", "100"])
    assert wall.psets == {"Pset_WallCommon": {"IsExternal": "true", "FireRating": "REI (60); #31", "ThermalTransmittance": "0.24", "Status": "NEW, OLD, x", "LoadBearing": "false"}}
    assert wall.quantities == {"Width": "200", "NetArea": "12.5"}
    assert (door.host_id, door.material, door.name, door.description, door.storey) == ("g10", "Brick", None, "d", "Ground; floor") and door.psets["Pset_WallCommon"]["FireRating"] == "REI (60); #31"
    assert rows["m", 13].storey == rows["m", 14].storey == rows["m", 2].storey == "Ground; floor" and rows["m", 2].long_name == "Hall"
    assert rows["n", 10].psets is None and rows["n", 10].storey is None
    assert [(r.name, r.elevation) for r in step.storeys(step.entities(spark, f"file://{tmp_path}")).collect()] == [("Ground; floor", -0.5)]


def test_step_of_nothing_and_limits(spark, tmp_path):
    (tmp_path / "m.ifc").write_text(HEAD + "ENDSEC;")
    assert step.read_elements(spark, f"file://{tmp_path}").collect() == []
    schema = "express_id bigint, global_id string, ifc_type string, name string, description string, object_type string, storey string, material string, psets map<string,map<string,string>>"
    many = spark.createDataFrame([(1, "g", "IfcWall", None, None, None, None, None, {f"s{i}": {"a": "b"} for i in range(31)})], schema)
    with pytest.raises(Exception, match="more sets or properties"):
        step.statements(many).agg(F.max("value")).collect()
    full = spark.createDataFrame([(1, "g", "IfcWall", "n", None, None, "L", "m", {f"s{i}": {f"k{j}": "v" for j in range(30)} for i in range(30)} | {"s0": {}})], schema)
    step.write_elements(full, f"file://{tmp_path}/w")
    (row,) = step.read_elements(spark, f"file://{tmp_path}/w", one_model=True).collect()
    assert len(row.psets) == 29 and all(len(v) == 30 for v in row.psets.values()) and (row.storey, row.material) == ("L", "m")
