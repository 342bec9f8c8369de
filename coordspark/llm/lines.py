"""Line deduplication by a segment-partition edit join.

All lines with a word are compared. A line is known by 128 bits of hashes, so equal lines of any length are one; of these
the first one of the corpus (by doc_id, then position) stays. Different lines are near if their edit distance is at
most one for each ``EDIT_CHARS`` characters of the shorter one, ``TAU`` at most; below ``EDIT_CHARS`` only equal lines
count. A line of length n is cut into its threshold plus one segments, which lead keys (length, segment, text); each line also probes the
keys of its own and slightly shorter lengths with the substrings that can hold an undamaged segment, so near lines
always share a key. Candidates are verified with a banded bit-parallel edit distance.

Near lines form components. Within one the lines are taken in order of their first place, and a line goes if a line that
stays is near it: every line that is removed has a near (or equal) one that is kept, and a chain of small steps
does not join distant lines. A component beyond ``GREEDY_ROWS`` lines is worked off in ranges: the lines of a range are
judged, and the rest, dealt out in parts, is held against those that stay.

Defined results: lines without a word always stay; a null text stays null and has no lines; documents
whose every line is removed keep what is left, which may be empty; rows that share a doc_id and a text are
deduplicated alike, so a repeated row is no duplicate of itself; null doc_ids come first; an empty table gives an
empty result; other columns are kept as they are, but columns called n_lines or n_removed are replaced. Rows with
different texts are told apart by a digest of the text, also without a doc_id or with the same one. Lines of any length
are compared whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordspark.llm.common import bound_batches, drop, fresh, save, small
from coordspark.llm.similar import link_components

TAU = 2
EDIT_CHARS = 32
GREEDY_ROWS = 4096
SEEN, FLUSH = 300_000, 100_000

_SPACE = " \t\n\x0b\x0c\r"
_ALL = (1 << 64) - 1
_SECOND = 11  # what the second half of a line's hash starts from


def segments(n: int, tau: int = TAU) -> list[tuple[int, int]]:
    """(start, length) of the tau + 1 segments of a line of n characters; lengths differ by one at most."""
    short, longer = divmod(n, tau + 1)
    out, at = [], 0
    for i in range(tau + 1):
        size = short + (i > tau - longer)
        out.append((at, size))
        at += size
    return out


def allowed(n: int, tau: int = TAU) -> int:
    """The edits that a line of n characters may have."""
    return min(tau, n // EDIT_CHARS)


def places(n: int, tau: int = TAU) -> list[tuple[int, int, int, bool]]:
    """(seed, start, end, leads) of each substring by which a line of n characters leads or probes a key."""
    out = []
    for length in range(max(1, n - tau), n + 1):
        shift, most = n - length, allowed(length, tau)
        if not most or shift > most:
            continue
        for i, (p, size) in enumerate(segments(length, most)):
            low = max(0, p - i, p + shift - (most - i))
            high = min(n - size, p + i, p + shift + (most - i))
            out += [(length * (tau + 1) + i, start, start + size, shift == 0 and start == p) for start in range(low, high + 1)]
    return out


class Places(dict):
    """Line length -> places; kept for lengths seen."""

    def __init__(self, tau: int):
        super().__init__()
        self.tau = tau

    def __missing__(self, n: int):
        if len(self) > 20_000:
            self.clear()
        found = self[n] = places(n, self.tau)
        return found


def line_keys(line: str, known: Places) -> list[tuple[int, bool]]:
    hashed = xxhash.xxh64_intdigest
    if line.isascii():
        text = line.encode()
        return [(hashed(text[a:b], seed), leads) for seed, a, b, leads in known[len(line)]]
    return [(hashed(line[a:b].encode(), seed), leads) for seed, a, b, leads in known[len(line)]]


def near(a: str, b: str, tau: int = TAU) -> bool:
    most = allowed(min(len(a), len(b)), tau)
    return edit_distance(a, b, most) <= most


def edit_distance(a: str, b: str, tau: int = TAU) -> int:
    """The edit distance of two lines if it is at most tau (below 31), else tau + 1. Bit-parallel along a diagonal band of one word."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > tau:
        return tau + 1
    if a == b:
        return 0
    # equal ends cost nothing
    low, high = 0, len(b)
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    a, b = a[low:], b[low:]
    low, high = 0, len(b)
    while low < high:
        mid = (low + high + 1) // 2
        if a[len(a) - mid :] == b[len(b) - mid :]:
            low = mid
        else:
            high = mid - 1
    a, b = a[: len(a) - low], b[: len(b) - low]
    if not b:
        return min(len(a), tau + 1)
    return _banded(a, b, tau)


def _banded(a: str, b: str, tau: int) -> int:
    """Hyyro's banded bit-vectors: a word follows the diagonal, its top bit is the lowest row of the band in this column."""
    tau = min(tau, len(a))
    match: dict[str, int] = defaultdict(int)
    for i, c in enumerate(a):
        match[c] |= 1 << i
    rise, fall = _ALL & (_ALL << (63 - tau)), 0
    at, score, bottom = tau - 63, tau, 1 << 62
    limit = tau + len(b) - (len(a) - tau)
    for j, c in enumerate(b):
        eq = (match[c] >> at if at > 0 else match[c] << -at) & _ALL
        same = ((((eq & rise) + rise) & _ALL) ^ rise) | eq | fall
        right_up, right_down = fall | (_ALL & ~(same | rise)), same & rise
        if j < len(a) - tau:  # the band's lowest row still moves down
            score += not same >> 63
        else:  # it is the last row of a from here on
            score += bool(right_up & bottom) - bool(right_down & bottom)
            bottom >>= 1
        if score > limit:
            return tau + 1
        slid = same >> 1
        rise, fall = right_down | (_ALL & ~(slid | right_up)), slid & right_up
        at += 1
    return score if score <= tau else tau + 1


class Index:
    """Lines by the keys that they lead and probe."""

    def __init__(self, tau: int):
        self.tau, self.known, self.lines = tau, Places(tau), []
        self.led, self.probed = defaultdict(list), defaultdict(list)

    def candidates(self, keys: list[tuple[int, bool]]) -> dict[int, None]:
        found: dict[int, None] = {}
        for key, leads in keys:
            found.update(dict.fromkeys(self.led.get(key, ())))
            if leads:
                found.update(dict.fromkeys(self.probed.get(key, ())))
        return found

    def add(self, line: str, keys: list[tuple[int, bool]]) -> None:
        for key, leads in keys:
            self.probed[key].append(len(self.lines))
            if leads:
                self.led[key].append(len(self.lines))
        self.lines.append(line)


def join_lines(nodes: list[int], parts: list[int], sides: list[int], lines: list[str], tau: int = TAU) -> list[tuple[int, int]]:
    """Links that tie the parts of a block together: lines in order of length probe the segments of those before them."""
    names = {c: i for i, c in enumerate(dict.fromkeys(parts))}
    root = np.array([names[c] for c in parts], dtype=np.int64)
    left, side, two = len(names), np.array(sides), len(set(sides)) > 1
    # an edit changes the counts of a line's bytes by 2 at most, or by 8 where characters have up to 4 bytes
    counts = np.array([np.bincount(np.frombuffer(x.encode(), dtype=np.uint8), minlength=256) for x in lines], dtype=np.int32)
    most = np.array([allowed(len(x), tau) * (2 if x.isascii() else 8) for x in lines])
    plain = np.array([x.isascii() for x in lines])
    known, led, found = Places(tau), defaultdict(list), []
    for i in sorted(range(len(lines)), key=lambda k: (len(lines[k]), k)):
        keys = line_keys(lines[i], known)
        if left > 1:
            met = np.array(list({j for key, _ in keys if key in led for j in led[key]}), dtype=np.int64)
            met = met[(root[met] != root[i]) & ((side[met] != side[i]) if two else True)]
            met = met[np.abs(counts[met] - counts[i]).sum(axis=1) <= (most[met] if plain[i] else 8 * tau)]
            for j in met.tolist():
                if root[i] != root[j] and near(lines[i], lines[j], tau):
                    found.append((nodes[i], nodes[j]))
                    root[root == root[j]] = root[i]
                    left -= 1
        for key, leads in keys:
            if leads:
                led[key].append(i)
    return found


def _dealt(docs: DataFrame, tau: int, keys_of=None) -> DataFrame:
    """key and lead of every line, or key, node and lead of the repeated keys; a line that a task has seen of late is not dealt again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = Places(tau), set()
        keys, nodes, leads = [], [], []

        def flush():
            columns = [np.array(keys, dtype=np.uint64).view(np.int64), np.array(nodes, dtype=np.uint64).view(np.int64), np.array(leads, dtype=bool)]
            names = ["key", "node", "lead"]
            if keys_of is None:
                columns, names = columns[::2], names[::2]
            else:
                kept = keys_of.value.repeated(columns[0])
                columns = [c[kept] for c in columns]
            for c in (keys, nodes, leads):
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        for batch in batches:
            for text in batch.column(0):
                for line in (text.as_py() or "").split("\n"):
                    if len(line) < EDIT_CHARS or not line.strip(" \t\n\x0b\x0c\r"):
                        continue
                    node = xxhash.xxh64_intdigest(line.encode(), seed=42)  # as Spark's xxhash64
                    if node in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    for key, lead in line_keys(line, known):
                        keys.append(key)
                        nodes.append(node)
                        leads.append(lead)
                if len(keys) >= FLUSH:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "key bigint, lead boolean" if keys_of is None else "key bigint, node bigint, lead boolean")


def _text_id() -> Column:
    """What tells rows of one doc_id apart: rows that share both are repeats of each other and are treated alike."""
    return F.unhex(F.substring(F.sha2("text", 256), 1, 32))


def _occurrences(docs: DataFrame) -> DataFrame:
    """place (doc_id, text_id, pos), line, node and rest (128 bits of hashes) of every line with a word."""
    # the digest is made below the generator, once a text and not once a line; a line has a word unless white space is all of it
    texts = docs.select("doc_id", _text_id().alias("text_id"), F.split(F.col("text"), "\n").alias("lines"))
    rows = texts.select("doc_id", "text_id", F.posexplode("lines").alias("pos", "line"))
    return rows.where(F.ltrim("line", F.lit(_SPACE)) != "").select(F.struct("doc_id", "text_id", "pos").alias("place"), "line", F.xxhash64("line").alias("node"), F.xxhash64(F.lit(_SECOND), "line").alias("rest"))


_MEMBER = "component bigint, salt int, side int, node bigint, rest bigint, line string"


def _judged(rows: DataFrame, tau: int, grow: bool) -> DataFrame:
    """component, node, rest and gone for the rows of side 1: gone if a line that stays is near. Side 0 stays; of side 1, if ``grow``, what is not gone stays, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index = None, None
        for batch in batches:
            out: list[tuple[int, int, int, bool]] = []
            for component, salt, side, node, rest, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (component, salt) != at:
                    at, index = (component, salt), Index(tau)
                keys = line_keys(line, index.known)
                gone = side == 1 and any(near(line, index.lines[j], tau) for j in index.candidates(keys))
                if side == 0 or (grow and not gone):
                    index.add(line, keys)
                if side == 1:
                    out.append((component, node, rest, gone))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["component", "node", "rest", "gone"])

    dealt = rows.repartition("component", "salt").sortWithinPartitions("component", "salt", "side", "first")
    return dealt.select(*(c.split()[0] for c in _MEMBER.split(", "))).mapInArrow(run, "component bigint, node bigint, rest bigint, gone boolean")


def near_removals(members: DataFrame, tau: int = TAU) -> DataFrame:
    """node and rest of the lines that go. members: component, node, rest, line and first (place) of the lines of components."""
    halves = [1.0 / 2**j for j in range(31)]
    first_doc = F.coalesce("first.doc_id", F.lit(-(1 << 63)))
    alive, out, used = members, [], []

    def kept(df: DataFrame, label: str) -> DataFrame:
        used.append(save(df, label))
        return used[-1]

    while True:
        sizes = alive.groupBy("component").agg(F.count("*").alias("rows"), F.percentile_approx(first_doc, halves).alias("cuts"))
        steps = F.ceil(F.col("rows") / GREEDY_ROWS).cast("int")
        sizes = sizes.select("component", steps.alias("steps"), F.element_at("cuts", F.least(F.lit(len(halves)), F.ceil(F.log2(steps.cast("double"))).cast("int") + 1)).alias("cut"))
        sizes = kept(sizes.where("steps > 1"), "lines-large")
        marked = alive.join(small(sizes), "component", "left").withColumn("now", F.col("cut").isNull() | (first_doc <= F.col("cut")))
        judged = kept(_judged(marked.where("now").withColumns({"salt": F.lit(0), "side": F.lit(1)}), tau, True), "lines-judged")
        out.append(judged.where("gone"))
        if not sizes.stored_rows:
            break
        staying = judged.where("not gone").select("node", "rest").join(marked.where("now and cut is not null"), ["node", "rest"])
        staying = staying.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("steps") - 1))).withColumn("side", F.lit(0))
        others = marked.where("not now").withColumns({"salt": F.pmod(F.xxhash64("node"), F.col("steps")).cast("int"), "side": F.lit(1)})
        checked = kept(_judged(staying.unionByName(others), tau, False), "lines-checked")
        out.append(checked.where("gone"))
        alive = kept(checked.where("not gone").select("node", "rest").join(members, ["node", "rest"]), "lines-alive")
    found = out[0]
    for df in out[1:]:
        found = found.unionByName(df)
    found = save(found.select("node", "rest"), "lines-near")
    for df in used:
        drop(df)
    return found


def removals(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """place and near for every line that is to go: near is true where no equal line stays."""
    occurrences = _occurrences(docs)

    def payloads_of(ids: DataFrame) -> DataFrame:
        one = occurrences.select("node", "line").join(small(ids), "node", "left_semi").groupBy("node").agg(F.min("line").alias("line"))
        return one.select("node", F.length("line").cast("bigint").alias("n"), F.encode("line", "UTF-8").alias("payload"))

    linked = link_components(
        _dealt(docs, tau),
        lambda known: _dealt(docs, tau, known),
        payloads_of,
        lambda a, b: near(a.decode(), b.decode(), tau),
        lambda ids, parts, sides, lines: join_lines(ids, parts, sides, [x.decode() for x in lines], tau),
        F.floor(F.col("n") / max(1, tau)).cast("bigint"),
        "lines",
    )
    seen = save(occurrences.select("place", "node", "rest"), "lines-seen")
    spread = seen.groupBy("node", "rest").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    members = save(occurrences.join(small(linked), "node").groupBy("component", "node", "rest").agg(F.min("line").alias("line"), F.min("place").alias("first")), "lines-members")
    gone = near_removals(members, tau)
    verdicts = spread.join(small(gone).withColumn("near", F.lit(True)), ["node", "rest"], "left").where("near or first != last")
    verdicts = save(verdicts.select("node", "rest", F.coalesce("near", F.lit(False)).alias("near"), "first"), "lines-verdicts")
    found = save(seen.join(small(verdicts), ["node", "rest"]).where(F.col("near") | ~F.col("place").eqNullSafe(F.col("first"))).select("place", "near"), "lines-removals")
    for df in (linked, seen, members, gone, verdicts):
        drop(df)
    return found


def dedup_lines(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """``docs`` with the shortened text, and n_lines and n_removed besides (in place of columns so called)."""
    bound_batches(docs.sparkSession)
    docs = docs.drop("n_lines", "n_removed")
    doc, of_text, at_pos = fresh(docs, "_doc", "_text", "_pos")
    gone = removals(docs, tau)
    lists = gone.groupBy(F.col("place.doc_id").alias(doc), F.col("place.text_id").alias(of_text)).agg(F.collect_set("place.pos").alias(at_pos))
    joined = docs.join(small(save(lists, "lines-gone")), F.col("doc_id").eqNullSafe(F.col(doc)) & (_text_id() == F.col(of_text)), "left").select(*docs.columns, at_pos)
    drop(gone)
    names = docs.columns
    at = names.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines bigint, n_removed bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_removed = [], [], []
            for text, pos in zip(batch.column(at), batch.column(len(names)), strict=True):
                value, cut = text.as_py(), 0
                lines = [] if value is None else value.split("\n")
                if value is not None and pos.is_valid:
                    gone_at = set(pos.as_py())
                    cut = len(gone_at)
                    value = "\n".join(line for i, line in enumerate(lines) if i not in gone_at)
                texts.append(value)
                n_lines.append(len(lines))
                n_removed.append(cut)
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[: len(names)])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], [*names, "n_lines", "n_removed"])

    return joined.mapInArrow(run, schema)
