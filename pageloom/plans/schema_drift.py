"""Schema drift between the files of a store (problem 4).

Every blob is shredded into field paths; counts per file give each file's schema as a
tree.  Two successive schemas are compared by tree edit distance: a top-down, unordered
alignment in which children under one parent are matched by name at no cost, or - where
the values prove it - by rename at cost 1, and everything left over is deleted or
inserted as a subtree.  The minimum-cost script per file is the change report; the
scripts of a store, composed, become the projection that reads each of its files into
one table.

Where the work is: one shuffle of the blobs by (table, store, file, salt) removes
repeated templates and pre-aggregates counts in the same task; the salt spreads a store
that holds much of the table.  Schema trees are as large as a schema, never as a store.
Values are looked at only for pairs of fields that could be renames.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRESENT, SAME_VALUES = 0.1, 0.9
# Block roles, the keys of maps by role.
ROLES = frozenset(
    "Unknown MainContent Article Heading Summary PrimaryNavigation SecondaryNavigation Breadcrumb Sidebar RelatedLinks Footer Header "
    "Advertisement CookieBanner Form Table CodeBlock Boilerplate RepeatedItem Title".split()
)
FILE = ["blob_table", "store_id", "file_seq"]
_FLUSH = 200_000


def _refuse(name: str):
    raise ValueError(name)


def read_blob(blob: bytes | None):
    """(whether the blob is valid JSON, its value). A leading byte order mark is allowed."""
    if blob is None:
        return False, None
    try:
        return True, json.loads(bytes(blob).decode("utf-8-sig"), parse_constant=_refuse)
    except (ValueError, RecursionError):
        return False, None


def kind_of(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def _is_map(name: str, value: dict, path: str) -> bool:
    """Objects whose keys are data: those by role, and attribute maps inside claims."""
    return name == "byRole" or (name == "data" and ".claims[]" in "." + path) or (bool(value) and all(k in ROLES for k in value))


def walk(value, path: str = "") -> Iterator[tuple[str, object]]:
    """(path, value) of every field with a value other than null, in document order."""
    if isinstance(value, dict):
        for name, v in value.items():
            if v is None:
                continue
            here = f"{path}.{name}" if path else name
            yield here, v
            if isinstance(v, dict):
                if _is_map(name, v, here):
                    for x in v.values():
                        yield from walk(x, here + "{}")
                else:
                    yield from walk(v, here)
            elif isinstance(v, list):
                yield from _items(v, here)
    elif isinstance(value, list):
        yield from _items(value, path)


def _items(values: list, path: str) -> Iterator[tuple[str, object]]:
    for x in values:
        if isinstance(x, (dict, list)):
            yield from walk(x, path + "[]")


def canonical(value) -> str:
    """A value's comparison form: keys sorted, whole floats as integers."""

    def plain(v):
        if isinstance(v, float) and v.is_integer():
            return int(v)
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"))


def parent_of(path: str) -> str:
    """The path of the object that holds a field, item and value marks dropped."""
    head = path.rpartition(".")[0]
    while head.endswith(("[]", "{}")):
        head = head[:-2]
    return head


# ----------------------------------------------------------------------------------- edit scripts


def assign(costs: list[list[float]]) -> list[int]:
    """Minimum-cost assignment of rows to columns (rows <= columns), by shortest augmenting paths."""
    n, m = len(costs), len(costs[0]) if costs else 0
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = [float("inf")] * (m + 1), [False] * (m + 1), [0] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = costs[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            match[j0] = match[j1]
            j0 = j1
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def edit_script(old: dict[str, str], new: dict[str, str], same: dict[tuple[str, str], float] | None = None) -> list[tuple[str, str, str]]:
    """The minimum-cost script (change, old_path, new_path) between two schemas (path -> type).

    ``same`` has, for pairs of paths, the share of templates with equal values.  Costs: a
    match by name 0, a type change 1, a rename 1 (only from SAME_VALUES up), a move to another
    parent 1 (likewise), deleting or inserting a subtree its number of fields.  Nothing below a
    changed field is listed.  Moves are only looked for where ``same`` has values of fields
    under different parents; they are listed as ``moved`` in the place of a removal and an addition.
    """
    same = same or {}
    children: list[dict[str, list[str]]] = []
    for tree in (old, new):
        kids: dict[str, list[str]] = {}
        for path in tree:
            kids.setdefault(parent_of(path), []).append(path)
        children.append(kids)
    sizes = [Counter(), Counter()]
    for side, tree in enumerate((old, new)):
        for path in tree:
            at = path
            while True:
                sizes[side][at] += 1
                if not at:
                    break
                at = parent_of(at)
    script: list[tuple[str, str, str]] = []
    stack = [""]
    while stack:
        here = stack.pop()
        olds, news = children[0].get(here, []), children[1].get(here, [])
        both = set(olds) & set(news)
        for path in both:
            if old[path] != new[path]:
                script.append(("type_changed", path, path))
            else:
                stack.append(path)
        gone, come = sorted(set(olds) - both), sorted(set(news) - both)
        renamed: dict[str, str] = {}
        if gone and come:
            # A square of renames, deletions and insertions; deleting and inserting always costs at least as much as a rename.
            n, m = len(gone), len(come)
            never = 1e9
            costs = [[0.0] * (n + m) for _ in range(n + m)]
            for i, a in enumerate(gone):
                for j, b in enumerate(come):
                    share = same.get((a, b), 0.0)
                    costs[i][j] = 1 - share / 1000 if old[a] == new[b] and share >= SAME_VALUES else never
                for j in range(n):
                    costs[i][m + j] = sizes[0][a] if i == j else never
            for i in range(m):
                for j, b in enumerate(come):
                    costs[n + i][j] = sizes[1][b] if i == j else never
            for i, j in enumerate(assign(costs)[:n]):
                if j < m and costs[i][j] < never:
                    renamed[gone[i]] = come[j]
        script += [("renamed", a, b) for a, b in renamed.items()]
        script += [("removed", a, "") for a in gone if a not in renamed]
        script += [("added", "", b) for b in come if b not in renamed.values()]
    gone, come = sorted(a for c, a, _ in script if c == "removed"), sorted(b for c, _, b in script if c == "added")
    share = lambda a, b: same.get((a, b), 0.0) if parent_of(a) != parent_of(b) and old[a] == new[b] else 0.0
    taken: set[str] = set()
    for _, a, b in sorted((-share(a, b), a, b) for a in gone for b in come if share(a, b) >= SAME_VALUES):
        if a not in taken and b not in taken:  # the surest first
            taken |= {a, b}
            script.remove(("removed", a, ""))
            script.remove(("added", "", b))
            script.append(("moved", a, b))
    return script


# ----------------------------------------------------------------------------------- Spark stages


def blobs_of(df: DataFrame, table: str, blob: str) -> DataFrame:
    """A store table in the common form. Rows with a null store, file or template are left out."""
    return df.where(F.col("store_id").isNotNull() & F.col("file_seq").isNotNull() & F.col("template_id").isNotNull()).select(
        F.lit(table).alias("blob_table"), F.col("store_id").cast("string").alias("store_id"), F.col("file_seq").cast("int").alias("file_seq"), F.col("template_id").cast("string").alias("template_id"), F.col(blob).alias("blob")
    )


def _salts(df: DataFrame) -> int:
    return max(2, df.sparkSession.sparkContext.defaultParallelism // 4)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [*FILE, "path", "type", "n_blobs", "n_values"]
    counts: dict[tuple, list[int]] = {}

    def flush() -> pd.DataFrame:
        rows = [(*k, *v) for k, v in counts.items()]
        counts.clear()
        return pd.DataFrame(rows, columns=names)

    for pdf in batches:
        for table, store, seq, blob in zip(pdf["blob_table"], pdf["store_id"], pdf["file_seq"], pdf["blob"]):
            valid, value = read_blob(blob)
            if not valid:
                continue
            key = (table, store, seq)
            counts.setdefault((*key, "", ""), [0, 0])[0] += 1
            here: Counter = Counter()
            for path, v in walk(value):
                here[path, kind_of(v)] += 1
            for path in {p for p, _ in here}:
                counts.setdefault((*key, path, ""), [0, 0])[0] += 1
            for (path, kind), n in here.items():
                counts.setdefault((*key, path, kind), [0, 0])[1] += n
        if len(counts) > _FLUSH:
            yield flush()
    yield flush()


def file_schemas(blobs: DataFrame) -> DataFrame:
    """``blob_table, store_id, file_seq, path, type``: the fields of every file.

    Each template counts once per file, the largest of its blobs if they differ; unreadable
    blobs do not count.  Ties between types go to the alphabetically first.
    """
    keys = [*FILE, "salt", "template_id"]
    spread = blobs.withColumn("salt", F.pmod(F.xxhash64("template_id"), F.lit(_salts(blobs)))).repartition(*[F.col(c) for c in keys[:4]])
    once = spread.groupBy(*keys).agg(F.max("blob").alias("blob")).select(*FILE, "blob")
    counts = once.mapInPandas(_count, "blob_table string, store_id string, file_seq int, path string, type string, n_blobs long, n_values long")
    sums = counts.groupBy(*FILE, "path", "type").agg(F.sum("n_blobs").alias("n_blobs"), F.sum("n_values").alias("n_values"))
    # One aggregation gives presence and type of every field; the row of the empty path has the file's readable blobs.
    typed = F.col("type") != ""
    fields = sums.groupBy(*FILE, "path").agg(
        F.sum(F.when(typed, 0).otherwise(F.col("n_blobs"))).alias("n_blobs"),
        F.min_by("type", F.when(typed, F.struct(-F.col("n_values"), F.col("type")))).alias("type"),
    )
    readable = F.max(F.when(F.col("path") == "", F.col("n_blobs"))).over(Window.partitionBy(*FILE))
    return fields.withColumn("readable", readable).where((F.col("path") != "") & (F.col("n_blobs") >= F.col("readable") * F.lit(PRESENT) - 1e-9)).select(*FILE, "path", "type")


def _steps(schemas: DataFrame) -> DataFrame:
    """One row per file that has a predecessor: both schemas as arrays of (path, type)."""
    per = schemas.groupBy(*FILE).agg(F.sort_array(F.collect_list(F.struct("path", "type"))).alias("after"))
    store = Window.partitionBy("blob_table", "store_id").orderBy("file_seq")
    both = per.withColumn("before", F.lag("after").over(store)).withColumn("last_seq", F.lag("file_seq").over(store))
    return both.where(F.col("last_seq") == F.col("file_seq") - 1).select(*FILE, "before", "after")


_PAIR = T.ArrayType(T.StructType([T.StructField("old_path", T.StringType()), T.StructField("new_path", T.StringType())]))


def _moves(before: pd.Series, after: pd.Series) -> pd.Series:
    """Pairs of fields of one name and type of which one goes and one comes, under different parents."""
    out = []
    for a, b in zip(before, after):
        old, new = {x["path"]: x["type"] for x in a}, {x["path"]: x["type"] for x in b}
        name = lambda p: p.rpartition(".")[2]
        out.append([{"old_path": p, "new_path": q} for p in old if p not in new for q in new if q not in old and old[p] == new[q] and name(p) == name(q) and parent_of(p) != parent_of(q)])
    return pd.Series(out)


def _candidates(before: pd.Series, after: pd.Series) -> pd.Series:
    """Pairs of fields of which one goes and one comes, under one parent, with one type."""
    out = []
    for a, b in zip(before, after):
        old, new = {x["path"]: x["type"] for x in a}, {x["path"]: x["type"] for x in b}
        gone = [p for p in old if p not in new and (parent_of(p) == "" or (parent_of(p) in new and old.get(parent_of(p)) == new[parent_of(p)]))]
        come = [p for p in new if p not in old and (parent_of(p) == "" or parent_of(p) in old)]
        out.append([{"old_path": p, "new_path": q} for p in gone for q in come if old[p] == new[q] and parent_of(p) == parent_of(q)])
    return pd.Series(out)


def _values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [*FILE, "template_id", "path", "value_hash"]
    for pdf in batches:
        rows = []
        for table, store, seq, template, blob, wanted in zip(pdf["blob_table"], pdf["store_id"], pdf["file_seq"], pdf["template_id"], pdf["blob"], pdf["wanted"]):
            valid, value = read_blob(blob)
            if not valid:
                continue
            want = set(wanted)
            got: dict[str, list] = {}
            for path, v in walk(value):
                if path in want:
                    got.setdefault(path, []).append(v)
            rows += [(table, store, seq, template, p, canonical(v)) for p, v in got.items()]
        yield pd.DataFrame(rows, columns=names)


def schema_changes(blobs: DataFrame, moves: bool = False) -> DataFrame:
    """``blob_table, store_id, file_seq, change, old_path, new_path``: every change of a file against its predecessor.

    A file whose predecessor (file_seq one less) is missing, or either of which has no readable
    blob, has no changes.  Empty tables give none.  With ``moves`` a field that went under another
    parent with its values is ``moved``; without, it is removed and added.
    """
    from ..checkpoints import counted, cut

    steps = cut(_steps(file_schemas(blobs)))
    pairs_of = F.pandas_udf((lambda a, b: pd.Series([x + y for x, y in zip(_candidates(a, b), _moves(a, b))])) if moves else _candidates, _PAIR)
    pairs = steps.select(*FILE, F.explode(pairs_of("before", "after")).alias("p")).select(*FILE, "p.old_path", "p.new_path")
    pairs = counted(cut(pairs))
    # What to look up in which file; a salt on both sides spreads a store that holds much of the table.
    salts = _salts(blobs)
    wanted = pairs.select("blob_table", "store_id", (F.col("file_seq") - 1).alias("file_seq"), F.col("old_path").alias("path")).unionByName(pairs.select(*FILE, F.col("new_path").alias("path")))
    wanted = wanted.groupBy(*FILE).agg(F.collect_set("path").alias("wanted")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    looked = blobs.withColumn("salt", F.pmod(F.xxhash64("template_id"), F.lit(salts))).join(wanted.hint("shuffle_hash"), [*FILE, "salt"])
    values = looked.select(*FILE, "template_id", "blob", "wanted").mapInPandas(_values, "blob_table string, store_id string, file_seq int, template_id string, path string, value_hash string")
    values = values.withColumn("value_hash", F.xxhash64("value_hash")).groupBy(*FILE, "template_id", "path").agg(F.max("value_hash").alias("value_hash"))
    side = lambda role, shift: (
        values.select("blob_table", "store_id", (F.col("file_seq") + shift).alias("file_seq"), "template_id", F.col("path").alias(f"{role}_path"), F.col("value_hash").alias(f"{role}_value"))
        .join(pairs, [*FILE, f"{role}_path"])
    )
    both = side("old", 1).join(side("new", 0), [*FILE, "template_id", "old_path", "new_path"])
    shares = both.groupBy(*FILE, "old_path", "new_path").agg(F.avg((F.col("old_value") == F.col("new_value")).cast("double")).alias("share"))
    evidence = shares.groupBy(*FILE).agg(F.collect_list(F.struct("old_path", "new_path", "share")).alias("evidence"))
    change = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("change", "old_path", "new_path")]))

    def script(before: pd.Series, after: pd.Series, proof: pd.Series) -> pd.Series:
        out = []
        for a, b, e in zip(before, after, proof):
            same = {(x["old_path"], x["new_path"]): x["share"] for x in e} if e is not None else {}
            out.append([dict(zip(("change", "old_path", "new_path"), c)) for c in edit_script({x["path"]: x["type"] for x in a}, {x["path"]: x["type"] for x in b}, same)])
        return pd.Series(out)

    scripts = F.pandas_udf(script, change)
    return steps.join(evidence, FILE, "left").select(*FILE, F.explode(scripts("before", "after", "evidence")).alias("c")).select(*FILE, "c.change", "c.old_path", "c.new_path")


# ----------------------------------------------------------------------------------- one table


def _holders(value, path: str) -> tuple[list[dict], str]:
    """The objects of a blob that can have the field of a path, and its name in them; ``[]`` goes to all items, ``{}`` to all values of a map."""
    steps = path.replace("[]", ".[]").replace("{}", ".{}").split(".")
    spots = [value]
    for name in steps[:-1]:
        if name == "[]":
            spots = [y for x in spots if isinstance(x, list) for y in x]
        elif name == "{}":
            spots = [y for x in spots if isinstance(x, dict) for y in x.values()]
        else:
            spots = [x[name] for x in spots if isinstance(x, dict) and name in x]
    return [x for x in spots if isinstance(x, dict)], steps[-1]


def rewrite(value: dict, renames: list[tuple[str, str]]) -> dict:
    """A blob with its fields under their first names and in their first places: the renames and moves of its files undone, latest first."""
    for old, new in reversed(renames):
        last = old.rpartition(".")[2]
        holders, name = _holders(value, new)
        if parent_of(old) != parent_of(new):  # a move: brought back where both places are single ones
            targets, _ = _holders(value, old)
            if len(holders) == len(targets) == 1 and name in holders[0] and targets[0].get(last) is None:
                targets[0][last] = holders[0].pop(name)
            continue
        for x in holders:
            if name in x and x.get(last) is None:
                x[last] = x.pop(name)
    return value


def as_kind(value, kind: str):
    """A value in another type, where nothing is lost by it; any other value as it is."""
    if value is None or kind_of(value) == kind:
        return value
    if isinstance(value, str):
        text = value.strip()
        if kind == "boolean":
            return {"true": True, "false": False}.get(text.lower(), value)
        if kind == "string" or not text:
            return value
        try:
            made = json.loads(text)
        except ValueError:
            return value
        return made if kind_of(made) == kind else value
    if isinstance(value, list):
        return as_kind(value[0], kind) if len(value) == 1 and kind_of(value[0]) != "array" else value
    if kind == "array":
        return [value]
    if kind == "string":
        return canonical(value) if isinstance(value, (bool, dict)) else str(value)
    if kind == "boolean" and value in (0, 1):
        return bool(value)
    return int(value) if kind == "number" and isinstance(value, bool) else value


def retype(value: dict, kinds: dict[str, str]) -> dict:
    """A blob whose fields are of the wanted types (path -> type) where they can be without loss, outer fields first."""
    for path in sorted(kinds, key=lambda p: p.count(".")):
        holders, name = _holders(value, path)
        for x in holders:
            if name in x:
                x[name] = as_kind(x[name], kinds[path])
    return value


def unify(blobs: DataFrame, changes: DataFrame, fields: list[str], kinds: dict[str, str] | None = None) -> DataFrame:
    """All files as one table: the file's key, ``template_id``, ``fields`` as JSON text under first names, and ``rest``.

    ``kinds`` has the types that fields (paths under first names) have in the table; where a
    file wrote another, the value is brought back as far as nothing is lost.

    The renames reported for a store's files up to a blob's own are undone in the blob; what
    is under none of the wanted names is kept in ``rest``, so nothing is lost.  Unreadable
    blobs give a row with null fields and null rest.  Repeated rows count once.
    """
    renames = changes.where("change IN ('renamed', 'moved')").select("blob_table", "store_id", F.col("file_seq").alias("since"), "old_path", "new_path")
    files = blobs.select(*FILE).distinct()
    scripts = (
        files.join(renames, ["blob_table", "store_id"]).where("since <= file_seq").groupBy(*FILE).agg(F.sort_array(F.collect_list(F.struct("since", "old_path", "new_path"))).alias("script"))
    )
    salts = _salts(blobs)
    scripts = scripts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    rows = blobs.withColumn("salt", F.pmod(F.xxhash64("template_id"), F.lit(salts))).join(scripts, [*FILE, "salt"], "left").groupBy(*FILE, "template_id").agg(F.max("blob").alias("blob"), F.first("script").alias("script"))
    columns = ", ".join(f"`{f}` string" for f in fields)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for table, store, seq, template, blob, script in zip(*(pdf[c] for c in [*FILE, "template_id", "blob", "script"])):
                valid, value = read_blob(blob)
                if not valid or not isinstance(value, dict):
                    out.append((table, store, seq, template, *[None] * len(fields), None))
                    continue
                value = rewrite(value, [(x["old_path"], x["new_path"]) for x in script] if script is not None else [])
                value = retype(value, kinds) if kinds else value
                taken = [canonical(value.pop(f)) if value.get(f) is not None else value.pop(f, None) for f in fields]
                out.append((table, store, seq, template, *taken, canonical(value)))
            yield pd.DataFrame(out, columns=[*FILE, "template_id", *fields, "rest"])

    return rows.select(*FILE, "template_id", "blob", "script").mapInPandas(project, f"blob_table string, store_id string, file_seq int, template_id string, {columns}, rest string")
