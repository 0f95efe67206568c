"""Schemas that drift between files: one consistent table, and every change from file to file.

The schema of a file is the tree of its JSON fields. Between consecutive files of a feed a minimum-cost
edit script turns the old tree into the new one: keep (0), rename or move of a field (1) where the values
of records carried in both files prove it, delete (1) and add (1), so an unproven rename costs 2 as a
removal and an addition. Scripts of all files are compiled into one projection per file, which maps the
file's fields to the names they had when they first appeared in the feed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.session import written

KEYS = ("bundle_id", "frame")
SCRIPT = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("change", "field_old", "field_new")]))
STEP = "\u001f"  # between the names of a nested path; a control character cannot occur bare in JSON text
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


class _Written(str):
    """A number with a fraction or exponent, as it was written."""


def _number(text: str) -> str:
    if text.lstrip("+-").isdigit():
        return str(int(text)) if len(text) < 4000 else text.lstrip("+")
    v = float(text)
    return str(int(v)) if v.is_integer() and abs(v) < 1e15 else repr(v)


def _plain(v) -> tuple[str | None, str | None]:
    """Type of a JSON value and a form in which equal values are equal texts."""
    if v is None:
        return None, None
    if v is True or v is False:
        return "boolean", "1" if v else "0"
    if isinstance(v, _Written):
        return "double", _number(v)
    if isinstance(v, int):
        return "long", str(v)
    if isinstance(v, str):
        v = _sound(v)
        low = v.strip().lower()
        if low in ("true", "false"):
            return "string", "1" if low == "true" else "0"
        return "string", _number(v.strip()) if _NUMBER.fullmatch(v.strip()) else v
    return "string", json.dumps(v, sort_keys=True)


def _sound(s: str) -> str:
    """Half surrogate pairs, which JSON escapes can spell but no text column can hold, as replacement characters."""
    try:
        s.encode()
        return s
    except UnicodeEncodeError:
        return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _leaves(v: dict, path: str = "") -> Iterator[tuple[str, object]]:
    for k, x in v.items():
        if isinstance(x, dict) and x:
            yield from _leaves(x, f"{path}{k}{STEP}")
        else:
            yield f"{path}{k}", x


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def _int(text: str):
    return int(text) if len(text) < 4000 else _Written(text)


# Fixed: the left/right names of the exports and the site1/site2 names of the same fields.
SCHEMES = {
    left.format(side): left.format(side).replace(f"site_{side}", f"site{s}").replace(side, f"site{s}")
    for s, side in ((1, "left"), (2, "right"))
    for left in ("site_{}_x_nm", "site_{}_y_nm", "site_{}_valid", "{}_valid_count", "{}_coverage", "longest_{}_run")
}


def parse_records(raw: DataFrame) -> DataFrame:
    """Add bundle_id, frame, types and values (field -> type, field -> comparable text) to the valid records.
    Lines that are not a JSON object, cut ones included, are left out; a null field is kept with null type
    and value. Numbers that overflow stay text."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep, ids, frames, types, values = [], [], [], [], []
            for i, text in enumerate(pdf["payload"]):
                try:
                    record = json.loads(text, parse_float=_Written, parse_int=_int, parse_constant=_refuse)
                except (ValueError, TypeError, RecursionError):
                    continue
                if not isinstance(record, dict):
                    continue
                leaves = {_sound(k): _plain(v) for k, v in _leaves(record)}
                keep.append(i)
                ids.append(leaves.pop(KEYS[0], (None, None))[1])
                frames.append(leaves.pop(KEYS[1], (None, None))[1])
                types.append({k: t for k, (t, _) in leaves.items()})
                values.append({k: v for k, (_, v) in leaves.items()})
            out = pdf.iloc[keep].drop(columns="payload").reset_index(drop=True)
            if len(out):
                text = {"bundle_id": ids, "frame": frames, "types": types, "values": values}
                yield out.assign(**{k: pd.Series(v, dtype=object) for k, v in text.items()})

    columns = ["feed_id", "file_id", "table_name", "exported_at", "line_no"]
    kinds = dict(raw.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns)
    return raw.select(*columns, "payload").mapInPandas(
        parse, f"{schema}, bundle_id string, frame string, types map<string,string>, values map<string,string>"
    )


def _assign(cost: list[list[float]]) -> list[int]:
    """Minimum-cost assignment of rows to columns of a square matrix: successive shortest paths."""
    n = len(cost)
    big = float("inf")
    u, v, match, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [big] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], big, 0
            for j in range(1, n + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    row = [0] * n
    for j in range(1, n + 1):
        row[match[j] - 1] = j - 1
    return row


def _tree(paths) -> dict:
    """Nested dicts of the paths; leaves are their full path."""
    root: dict = {}
    for p in sorted(paths):
        node, *names = root, *p.split(STEP)
        for name in names[:-1]:
            node = node.setdefault((name, "object"), {})
        node[(names[-1], "field")] = p
    return root


def _size(node) -> int:
    return 1 if isinstance(node, str) else sum(map(_size, node.values())) + 1


def _edit(old, new, proven: set) -> tuple[float, list]:
    """Cost and script between the children of two nodes; subtrees map to subtrees (constrained tree edit
    distance): equal names are kept, the others are assigned at minimum cost. A field of equal name whose
    path differs lies below a renamed object, which has been paid for; it too needs its proof."""
    cost, script, settled = 0.0, [], set()
    for name in old.keys() & new.keys():
        x, y = old[name], new[name]
        if name[1] == "object":
            c, s = _edit(x, y, proven)
            cost, script = cost + c, script + s
            settled.add(name)
        elif x == y or (x, y) in proven:
            script += [("renamed", x, y)] if x != y else []
            settled.add(name)
    a, b = sorted(old.keys() - settled), sorted(new.keys() - settled)
    n = len(a) + len(b)
    table, ways = [[0.0] * n for _ in range(n)], {}
    for i in range(n):
        for j in range(n):
            if i < len(a) and j < len(b):
                x, y = old[a[i]], new[b[j]]
                if a[i][1] == b[j][1] == "field":
                    table[i][j] = 1.0 if (x, y) in proven else 1e9
                elif a[i][1] == b[j][1]:
                    c, s = _edit(x, y, proven)
                    ways[i, j] = s
                    table[i][j] = 1.0 + c
                else:
                    table[i][j] = 1e9
            elif i < len(a):
                table[i][j] = _size(old[a[i]]) if j - len(b) == i else 1e9
            elif j < len(b):
                table[i][j] = _size(new[b[j]]) if i - len(a) == j else 1e9
    for i, j in enumerate(_assign(table)):
        cost += table[i][j]
        if i < len(a) and j < len(b):
            script += [("renamed", old[a[i]], new[b[j]])] if a[i][1] == "field" else ways[i, j]
        elif i < len(a):
            script += [("removed", p, "") for p in _paths(old[a[i]])]
        elif j < len(b):
            script += [("added", "", p) for p in _paths(new[b[j]])]
    return cost, script


def _paths(node) -> list[str]:
    return [node] if isinstance(node, str) else [p for x in node.values() for p in _paths(x)]


def edit_script(old, new, proven) -> list[tuple[str, str, str]]:
    """Minimum-cost script from one set of field paths to another: (change, old path, new path). proven:
    pairs of paths whose values agree. A proven pair that the trees could not match, as its ends lie under
    different parents, is a move and is written as a rename of the whole path."""
    proven = set(map(tuple, proven))
    _, script = _edit(_tree(old), _tree(new), proven)
    gone = {o for c, o, _ in script if c == "removed"}
    born = {n for c, _, n in script if c == "added"}
    for o, n in sorted(proven):
        if o in gone and n in born:
            gone.discard(o)
            born.discard(n)
            script = [x for x in script if x not in (("removed", o, ""), ("added", "", n))] + [("renamed", o, n)]
    return script


def file_schemas(records: DataFrame) -> DataFrame:
    """One row per feed, file and field with the field's type in that file (null: only nulls), and the file
    before it in the feed. Strings win over numbers, double over long, numbers over booleans."""
    fields = records.select("feed_id", "file_id", "table_name", "exported_at", F.explode_outer("types").alias("field", "type"))
    rank = {"string": 4, "double": 3, "long": 2, "boolean": 1}
    order = F.coalesce(*[F.when(F.col("type") == t, r) for t, r in rank.items()], F.lit(0))
    of = F.element_at(F.array(F.lit(None).cast("string"), *[F.lit(t) for t in sorted(rank, key=rank.get)]), F.max(order) + 1)
    return fields.groupBy("feed_id", "file_id", "field").agg(
        F.min("table_name").alias("table_name"), F.min("exported_at").alias("exported_at"), of.alias("type")
    )


def _ordered_files(schemas: DataFrame) -> DataFrame:
    """(feed_id, file_id, seq, before): the files of a feed in order of exported_at, ties by file_id."""
    along = Window.partitionBy("feed_id").orderBy("exported_at", "file_id")
    return (
        schemas.groupBy("feed_id", "file_id")
        .agg(F.min("exported_at").alias("exported_at"))
        .select(
            "feed_id",
            "file_id",
            "exported_at",
            F.row_number().over(along).alias("seq"),
            F.lag("file_id").over(along).alias("before"),
        )
    )


@F.pandas_udf(SCRIPT)
def _scripts(old: pd.Series, new: pd.Series, proven: pd.Series) -> pd.Series:
    return pd.Series(
        [
            [{"change": c, "field_old": a, "field_new": b} for c, a, b in edit_script(o, n, [(x["o"], x["n"]) for x in p])]
            for o, n, p in zip(old, new, proven)
        ],
        dtype=object,
    )


def drift(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The changes (feed_id, file_id, change, field_old, field_new) of parsed records, the files and their schemas.

    A rename is proven when, over all pairs of a record of the file before and one of this file with the
    same bundle_id and frame, old and new field agree; fields without any such pair of records are not
    renamed. Agreement is compared by two independent 64-bit hash sums over those pairs, so the work is
    linear in the records, not in pairs of fields.
    """
    schemas = written(file_schemas(records))
    files = written(_ordered_files(schemas))
    named = schemas.where(F.col("field").isNotNull())
    here = files.where("before is not null").select("feed_id", "file_id", "before")
    now = here.join(named.select("feed_id", "file_id", "field", "type"), ["feed_id", "file_id"])
    then = here.join(
        named.select("feed_id", F.col("file_id").alias("before"), "field", F.col("type").alias("type_old")), ["feed_id", "before"]
    )
    both = written(
        now.withColumn("new", F.lit(True))
        .join(then.withColumn("old", F.lit(True)), ["feed_id", "file_id", "before", "field"], "full_outer")
        .withColumn("old", F.coalesce("old", F.lit(False)))
        .withColumn("new", F.coalesce("new", F.lit(False)))
    )
    trees = both.groupBy("feed_id", "file_id", "before").agg(
        F.collect_set(F.when(F.col("old"), F.col("field"))).alias("old_fields"),
        F.collect_set(F.when(F.col("new"), F.col("field"))).alias("new_fields"),
    )
    open_trees = trees.select(
        "*", F.array_except("old_fields", "new_fields").alias("gone"), F.array_except("new_fields", "old_fields").alias("born")
    )
    open_trees = written(open_trees)
    doubtful = open_trees.where((F.size("gone") > 0) & (F.size("born") > 0)).select("feed_id", "file_id", "before", "gone", "born")
    pick = lambda names: F.transform(names, lambda f: F.struct(f.alias("field"), F.element_at("values", f).alias("value")))
    key = ["feed_id", "file_id", "bundle_id", "frame"]
    recs = records.select("feed_id", "file_id", "bundle_id", F.coalesce("frame", F.lit("")).alias("frame"), "values").where(
        F.col("bundle_id").isNotNull()
    )
    left = (
        recs.withColumnRenamed("file_id", "before")
        .join(doubtful, ["feed_id", "before"])
        .select(*key, pick("gone").alias("old"))
        .distinct()
    )
    right = recs.join(doubtful, ["feed_id", "file_id"]).select(*key, pick("born").alias("new")).distinct()
    pairs = left.join(right, key).withColumn("pair", F.xxhash64("bundle_id", "frame", F.to_json("old"), F.to_json("new")))

    def prints(side: str) -> DataFrame:
        long = pairs.select("feed_id", "file_id", "pair", F.explode(side).alias("f"))
        value = F.coalesce(F.concat(F.lit("="), F.col("f.value")), F.lit(""))
        total = lambda *x: F.sum(F.xxhash64("pair", value, *x).cast("decimal(20,0)"))
        return long.groupBy("feed_id", "file_id", F.col("f.field").alias(side)).agg(
            total().alias("print_a"), total(F.lit(1)).alias("print_b")
        )

    proven = (
        prints("old")
        .join(prints("new"), ["feed_id", "file_id", "print_a", "print_b"])
        .groupBy("feed_id", "file_id")
        .agg(F.collect_list(F.struct(F.col("old").alias("o"), F.col("new").alias("n"))).alias("proven"))
    )
    none = F.array().cast("array<struct<o string, n string>>")
    script = (
        open_trees.join(proven, ["feed_id", "file_id"], "left")
        .select("feed_id", "file_id", F.explode(_scripts("old_fields", "new_fields", F.coalesce("proven", none))).alias("s"))
        .select("feed_id", "file_id", "s.*")
    )
    script = written(script)
    kinds = both.select("feed_id", "file_id", "field", "type", "type_old", "old", "new")
    kept = kinds.where("old and new").select("feed_id", "file_id", "type", "type_old", F.col("field").alias("field_old"), F.col("field").alias("field_new"))
    moved = (
        script.where("change = 'renamed'")
        .drop("change")
        .join(kinds.select("feed_id", "file_id", F.col("field").alias("field_old"), "type_old"), ["feed_id", "file_id", "field_old"])
        .join(kinds.select("feed_id", "file_id", F.col("field").alias("field_new"), "type"), ["feed_id", "file_id", "field_new"])
    )
    retyped = kept.unionByName(moved).where("type <> type_old").withColumn("change", F.lit("retyped"))
    columns = ["feed_id", "file_id", "change", "field_old", "field_new"]
    return script.select(*columns).unionByName(retyped.select(*columns)), files, schemas


def changes(raw: DataFrame) -> DataFrame:
    """Every change between consecutive files of a feed: feed_id, file_id (the later), change (added,
    removed, renamed, retyped), field_old, field_new. See drift for when a rename is proven.

    raw: feed_id, file_id, table_name, exported_at, line_no, payload. Lines cut off or null are no records;
    a file without valid records is no file; rows with null feed_id, file_id or exported_at are left out.
    Repeated lines count once. A field with only nulls in a file has no type there and is not retyped. An
    empty table gives an empty result. Nested fields are named by their path with dots.
    """
    found, _, _ = drift(written(parse_records(_rows(raw))))
    dots = lambda c: F.translate(c, STEP, ".").alias(c)
    return found.select("feed_id", "file_id", "change", dots("field_old"), dots("field_new"))


def _rows(raw: DataFrame) -> DataFrame:
    return raw.where("feed_id is not null and file_id is not null and exported_at is not null and payload is not null")


def projections(files: DataFrame, schemas: DataFrame, found: DataFrame) -> DataFrame:
    """(feed_id, file_id, field, canonical): scripts compiled to one projection per file. A field traces
    back over its renames to the name under which it first appeared; the chains of all feeds are followed
    at once by pointer doubling, in as many joins as the logarithm of the longest chain. Feeds that began with
    the left/right names get the site1/site2 names of the others (SCHEMES)."""
    at = files.select("feed_id", "file_id", "seq")
    first = schemas.join(at.where("seq = 1"), ["feed_id", "file_id"]).select("feed_id", "seq", "field", F.lit(None).cast("string").alias("came_from"))
    began = found.where("change in ('added', 'renamed')").join(at, ["feed_id", "file_id"])
    began = began.select("feed_id", "seq", F.col("field_new").alias("field"), F.when(F.col("change") == "renamed", F.col("field_old")).alias("came_from"))
    lives = first.where("field is not null").unionByName(began)
    lives = lives.select("feed_id", F.concat_ws("/", "field", F.col("seq").cast("string")).alias("life"), "field", "seq", "came_from")
    # the life a field is in: the last one of that name that began by then
    until = F.coalesce(F.lead("seq").over(Window.partitionBy("feed_id", "field").orderBy("seq")) - 1, F.lit(2**31 - 1))
    lives = written(lives.withColumn("until", until))
    parents = lives.select("feed_id", F.col("field").alias("came_from"), F.col("life").alias("up"), F.col("seq").alias("up_from"), "until")
    step = lives.drop("until").join(parents, ["feed_id", "came_from"], "left")
    step = step.where("up is null or (up_from <= seq - 1 and until >= seq - 1)").select("feed_id", "life", F.coalesce("up", "life").alias("root"))
    step = written(step)
    while True:
        far = step.select("feed_id", F.col("life").alias("root"), F.col("root").alias("further"))
        leap = written(step.join(far, ["feed_id", "root"]).select("feed_id", "life", F.col("further").alias("root"), (F.col("root") != F.col("further")).alias("moved")))
        if leap.where("moved").isEmpty():
            break
        step = leap.drop("moved")
    names = lives.select("feed_id", F.col("life").alias("root"), F.col("field").alias("canonical"))
    of_life = lives.select("feed_id", "life", "field", "seq", "until").join(step, ["feed_id", "life"]).join(names, ["feed_id", "root"])
    live = schemas.where("field is not null").join(at, ["feed_id", "file_id"]).select("feed_id", "file_id", "seq", "field", "table_name")
    spans = of_life.select("feed_id", "field", F.col("seq").alias("since"), "until", "canonical")
    mapped = live.join(spans, ["feed_id", "field"]).where("since <= seq and seq <= until")
    schemes = F.create_map(*[F.lit(n) for pair in SCHEMES.items() for n in pair])
    mapped = mapped.withColumn("canonical", F.coalesce(F.element_at(schemes, F.col("canonical")), "canonical"))
    # two fields of a file that go back to one name: the one that carries it longer keeps it
    clash = Window.partitionBy("feed_id", "file_id", "canonical").orderBy("since", "field")
    place = F.row_number().over(clash)
    return mapped.select(
        "feed_id",
        "file_id",
        "table_name",
        "field",
        F.when(place == 1, F.col("canonical")).otherwise(F.concat("canonical", F.lit("__"), place.cast("string"))).alias("canonical"),
    )


def _typed(wide: DataFrame, names: list[str], met: dict[str, set[str]]) -> dict[str, Column]:
    """The columns in the widest type that holds every value: boolean or long where each value is one, double where
    each is a number, else text. met: the types in which a field was delivered; one that only ever was text stays it."""
    value = lambda n: F.col(f"`{n}`")
    every = lambda n, c: F.coalesce(F.bool_and(F.coalesce(c, F.lit(True))), F.lit(True)).alias(n)
    checks = []
    for n in names:
        long_ = value(n).rlike(r"^[+-]?\d{1,18}$")
        number = value(n).try_cast("double").isNotNull() & ~value(n).rlike(r"^[+-]?\d{19,}$")
        checks += [every(f"{n}/boolean", value(n).isin("0", "1")), every(f"{n}/long", long_), every(f"{n}/double", F.when(value(n).isNotNull(), number))]
    if not checks:
        return {}
    holds = wide.agg(*checks).first().asDict()
    out = {}
    for n in names:
        kinds = met.get(n, set())
        fit = [k for k in ("boolean", "long", "double") if holds[f"{n}/{k}"]]
        if kinds & {"double", "long"} and "double" in fit:
            kind = "boolean" if "boolean" in kinds and "double" not in kinds and "boolean" in fit else "double" if "double" in kinds or "long" not in fit else "long"
        else:
            kind = "boolean" if "boolean" in kinds and "boolean" in fit else "string"
        # the text form of true and false is 1 and 0
        out[n] = value(n) if kind == "string" else (value(n) == "1") if kind == "boolean" else value(n).cast(kind)
    return out


def consistent_table(raw: DataFrame, table_name: str) -> DataFrame:
    """All files of one table as one table: feed_id, bundle_id, frame and one column per canonical field (see
    projections), in the widest type its values need (see _typed). Of a record delivered again
    each field has its value of the last export in which it is not null; records without a key (bundle_id, and
    frame in frame_table) are not combined but stay by file and line. Only names and types of fields, not rows, pass the driver."""
    records = written(parse_records(_rows(raw.where(F.col("table_name") == table_name))))
    found, files, schemas = drift(records)
    plan = written(projections(files, schemas, written(found)))
    types = plan.join(schemas.select("feed_id", "file_id", "field", "type"), ["feed_id", "file_id", "field"])
    met = {r[0]: set(r[1]) for r in types.groupBy("canonical").agg(F.collect_set("type")).orderBy("canonical").collect()}
    of_file = plan.groupBy("feed_id", "file_id").agg(F.map_from_entries(F.collect_list(F.struct("canonical", "field"))).alias("plan"))
    unkeyed = F.col("bundle_id").isNull() | (F.col("frame").isNull() if table_name == "frame_table" else F.lit(False))
    renamed = records.join(of_file, ["feed_id", "file_id"]).select(
        "feed_id",
        "bundle_id",
        "frame",
        F.when(unkeyed, F.struct("file_id", "line_no")).alias("line"),
        F.struct("exported_at", "file_id", "line_no").alias("at"),
        F.transform_values("plan", lambda _, f: F.element_at("values", f)).alias("row"),
    )
    value = lambda n: F.element_at("row", F.lit(n))
    dots = {n: n.replace(STEP, ".") for n in met}
    last = [F.max_by(value(n), F.when(value(n).isNotNull(), F.col("at"))).alias(dots[n]) for n in met]
    wide = written(renamed.groupBy("feed_id", "bundle_id", "frame", "line").agg(*last).drop("line"))
    typed = _typed(wide, ["frame", *dots.values()], {"frame": {"long"}, **{dots[n]: kinds for n, kinds in met.items()}})
    return wide.select("feed_id", "bundle_id", *[c.alias(n) for n, c in typed.items()])
