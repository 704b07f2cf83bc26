"""Differences between two copies of data, row by row and field by field.

Method: both copies are cut into hash buckets of their keys and cogrouped as Arrow tables. In a bucket
the keys of both sides are coded by one dictionary and aligned by sorted search; columns are compared
through vectorised null-aware masks and only the masked cells are emitted.

A bucket holds about BUCKET_ROWS rows (BUCKET_STATES of JSON states) whatever the size of the data, as their number follows the row
count. Identical rows are collapsed with their number before they are bucketed, so a key repeated
a million times over is one row of its bucket.
"""

from __future__ import annotations

import json
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 4_000
#: The same for rows that hold two JSON states of some KB.
BUCKET_STATES = 256
#: Between the keys of a path inside; a dot may be part of a key.
STEP, RECORD = "\x1f", "\x1e"
_EXACT = Context(prec=20_000, Emax=999_999_999_999, Emin=-999_999_999_999)


def bucket_count(rows: int, per_bucket: int = BUCKET_ROWS) -> int:
    return max(1, -(-rows // per_bucket))


def align(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each left key its row on the right, or -1, and the same of each right key. Keys are unique on each side."""
    codes = pa.chunked_array([left, right]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    a, b = codes[: len(left)], codes[len(left) :]

    def find(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
        order = np.argsort(among, kind="stable")
        if not len(order):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(among[order], keys), len(order) - 1)
        rows = order[at]
        return np.where(among[rows] == keys, rows, -1)

    return find(a, b), find(b, a)


def differs(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Mask of the places at which two columns differ; null equals null, NaN equals NaN."""
    unequal = pc.not_equal(left, right)
    if pa.types.is_floating(left.type):
        unequal = pc.and_(unequal, pc.invert(pc.and_(pc.is_nan(left), pc.is_nan(right))))
    one_null = pc.xor(left.is_null(), right.is_null())
    return pc.or_(pc.fill_null(unequal, False), one_null).to_numpy(zero_copy_only=False)


# --- JSON states -----------------------------------------------------------------------------


def _number(x: int | Decimal) -> str:
    if isinstance(x, Decimal) and not x.is_finite():  # NaN equals itself here
        return f"n{x}"
    if not x:
        return "n0"
    value = Decimal(x) if isinstance(x, int) else x
    return f"n{_EXACT.normalize(value)}"


def canonical(value: object) -> str:
    """A string that is equal for equal values: numbers by value, objects by key, lists in order."""
    if isinstance(value, str):
        return "s" + value
    if value is None:
        return "z"
    if isinstance(value, bool):
        return "t" if value else "f"
    if isinstance(value, (int, Decimal)):
        return _number(value)
    if isinstance(value, list):
        return "a" + json.dumps([canonical(v) for v in value])
    return "o" + json.dumps({k: canonical(value[k]) for k in sorted(value)})


def parse_state(text: str | None) -> object:
    """The parsed state, or Ellipsis for a null or unreadable one."""
    if text is None:
        return ...
    try:
        return json.loads(text, parse_float=Decimal, parse_constant=Decimal)
    except (ValueError, RecursionError, ArithmeticError):
        return ...


def flatten(root: object) -> list[tuple[str, str, str]]:
    """(path, parent's path, value) of every key below the root; the value of an object is 'o'."""
    out, todo = [("", "", "o" if isinstance(root, dict) else canonical(root))], [("", root)] if isinstance(root, dict) else []
    while todo:
        parent, node = todo.pop()
        for key, value in node.items():
            path = f"{parent}{STEP}{key}"
            if isinstance(value, dict):
                out.append((path, parent, "o"))
                todo.append((path, value))
            else:
                out.append((path, parent, canonical(value)))
    return out


def _cells(ids: list[str], states: list[object]) -> tuple[pa.Array, pa.Array, pa.Array]:
    keys, parents, values = [], [], []
    for record, state in zip(ids, states):
        for path, parent, value in flatten(state):
            keys.append(f"{record}{RECORD}{path}")
            parents.append(f"{record}{RECORD}{parent}")
            values.append(value)
    return pa.array(keys, pa.string()), pa.array(parents, pa.string()), pa.array(values, pa.string())


def compare_states(left: pa.Table, right: pa.Table, id_col: str) -> pa.Table:
    """Differences of two tables (id, state), each id once on a side: (id, path, diff_kind)."""
    l_state = {i: parse_state(s) for i, s in zip(*[c.to_pylist() for c in left.select([id_col, "state"]).columns])}
    r_state = {i: parse_state(s) for i, s in zip(*[c.to_pylist() for c in right.select([id_col, "state"]).columns])}
    ids = [i for i, s in l_state.items() if s is not ... and r_state.get(i, ...) is not ...]
    l_key, l_parent, l_value = _cells(ids, [l_state[i] for i in ids])
    r_key, r_parent, r_value = _cells(ids, [r_state[i] for i in ids])
    to_right, to_left = align(l_key, r_key)
    both = np.flatnonzero(to_right >= 0)
    different = both[differs(l_value.take(pa.array(both)), r_value.take(pa.array(to_right[both])))]

    def tops(keys: pa.Array, parents: pa.Array, missing: np.ndarray, other_key: pa.Array, other_value: pa.Array) -> pa.Array:
        """Keys that the other side lacks although it has their parent, as an object."""
        rows = pa.array(np.flatnonzero(missing))
        keys, parents = keys.take(rows), parents.take(rows)
        objects = other_key.filter(pc.equal(other_value, "o"))
        return keys.filter(pc.is_in(parents, value_set=objects))

    found = (
        (l_key.take(pa.array(different)), "DIFFERENT"),
        (tops(l_key, l_parent, to_right < 0, r_key, r_value), "MISSING_IN_GOLD"),
        (tops(r_key, r_parent, to_left < 0, l_key, l_value), "MISSING_IN_AGENT"),
    )
    records, paths, kinds = [], [], []
    for keys, kind in found:
        for key in keys.to_pylist():
            record, _, path = key.partition(RECORD)
            records.append(record)
            paths.append(path[1:].replace(STEP, "."))
            kinds.append(kind)
    return pa.table({id_col: pa.array(records, pa.string()), "path": pa.array(paths, pa.string()), "diff_kind": pa.array(kinds, pa.string())})


def diff_states(replays: DataFrame, id_col: str = "replay_id", left_col: str = "agent_state", right_col: str = "gold_state") -> DataFrame:
    """(id_col, path, diff_kind): the paths at which two JSON states of a record differ.

    A key on one side only is MISSING_IN_AGENT (right only) or MISSING_IN_GOLD (left only), at that key
    and not below it, also with the value null; values on both sides that differ are DIFFERENT.
    Objects are compared by key, lists as a whole and in order, numbers by value, strings exactly; a
    number never equals a string or boolean.

    Defined cases: a record with a null or unreadable state, or a null id, has no rows; records with
    equal states on a repeated row count once; of different states under one id each pair is compared
    and the union of their differences given; of a key repeated within an object the last one holds.
    """
    rows = replays.select(F.col(id_col).cast("string").alias(id_col), F.col(left_col).alias("__l"), F.col(right_col).alias("__r"))
    rows = rows.where(F.col(id_col).isNotNull() & F.col("__l").isNotNull() & F.col("__r").isNotNull())
    # one row for each distinct pair of states; collapsed map-side, by digest, before the states move
    rows = rows.withColumn("__d", F.sha2(F.concat_ws(RECORD, "__l", "__r"), 256))
    # (both states in one value: the two sides below then share this exchange instead of each pruning the other's)
    rows = rows.groupBy(id_col, "__d").agg(F.first(F.struct("__l", "__r")).alias("__v"))
    buckets = bucket_count(replays.count(), BUCKET_STATES)
    rows = rows.select(
        F.concat(id_col, F.lit(RECORD), "__d").alias("__key"), F.col("__v.__l").alias("__l"), F.col("__v.__r").alias("__r"),
        F.pmod(F.xxhash64(id_col, "__d"), F.lit(buckets)).alias("__bucket"),
    )
    left = rows.select("__bucket", "__key", F.col("__l").alias("state"))
    # new names: attributes that both sides share would be pruned from one of them
    right = rows.select(F.col("__bucket").alias("__at"), F.col("__key").alias("__of"), F.col("__r").alias("state"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return compare_keyed(a, b.rename_columns(a.schema.names))

    found = left.groupBy("__bucket").cogroup(right.groupBy("__at")).applyInArrow(run, "record string, path string, diff_kind string")
    # an id with several distinct pairs of states may give a difference more than once
    return found.select(F.col("record").alias(id_col), "path", "diff_kind").distinct()


def compare_keyed(left: pa.Table, right: pa.Table) -> pa.Table:
    """compare_states over composite keys id + digest, giving the id alone."""
    def keyed(t: pa.Table) -> pa.Table:
        return pa.table({"k": pc.replace_substring(t["__key"], RECORD, "\x1d"), "state": t["state"]})

    out = compare_states(keyed(left), keyed(right), "k")
    return pa.table({"record": pc.list_element(pc.split_pattern(out["k"], "\x1d"), 0) if len(out) else out["k"], "path": out["path"], "diff_kind": out["diff_kind"]})


# --- tables ----------------------------------------------------------------------------------


def compare_tables(left: pa.Table, right: pa.Table, keys: list[str], fields: list[str]) -> pa.Table:
    """Cells that differ between two tables with a unique column __key and text columns: (keys, field, diff_kind, left_value, right_value)."""
    left, right = left.combine_chunks(), right.combine_chunks()

    def column(t: pa.Table, name: str) -> pa.Array:
        c = t[name]
        return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c

    to_right, to_left = align(column(left, "__key"), column(right, "__key"))
    parts: dict[str, list] = {c: [] for c in [*keys, "field", "diff_kind", "left_value", "right_value"]}

    def emit(source: pa.Table, rows: np.ndarray, field: str | None, kind: str, l: pa.Array, r: pa.Array) -> None:
        for k in keys:
            parts[k].append(column(source, k).take(pa.array(rows)))
        n = len(rows)
        parts["field"].append(pa.array([field] * n, pa.string()))
        parts["diff_kind"].append(pa.array([kind] * n, pa.string()))
        parts["left_value"].append(l)
        parts["right_value"].append(r)

    both = np.flatnonzero(to_right >= 0)
    l_rows, r_rows = pa.array(both), pa.array(to_right[both])
    for field in fields:
        l, r = column(left, field).take(l_rows), column(right, field).take(r_rows)
        at = np.flatnonzero(differs(l, r))
        emit(left, both[at], field, "DIFFERENT", l.take(pa.array(at)), r.take(pa.array(at)))
    none = lambda n: pa.nulls(n, pa.string())
    only_left, only_right = np.flatnonzero(to_right < 0), np.flatnonzero(to_left < 0)
    emit(left, only_left, None, "ONLY_LEFT", none(len(only_left)), none(len(only_left)))
    emit(right, only_right, None, "ONLY_RIGHT", none(len(only_right)), none(len(only_right)))
    return pa.table({k: pa.chunked_array(v, pa.string()) for k, v in parts.items()})


def diff_tables(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str] | None = None) -> DataFrame:
    """(keys, field, diff_kind, left_value, right_value), all as strings: rows on one side only and cells that differ.

    fields: the columns to compare, by default those of both sides that are no keys. Values are
    compared after a cast to the text of their JSON form for nested types.

    Defined cases: null equals null in keys and fields; rows repeated under one key on a side are
    numbered by their content and the n-th of one side is compared with the n-th of the other, after
    equal rows have been set against each other; an empty side gives all rows of the other.
    """
    fields = fields if fields is not None else [c for c in left.columns if c in right.columns and c not in keys]
    nested = lambda df, c: df.schema[c].dataType.typeName() in ("struct", "array", "map")
    text = lambda df, c: F.to_json(c) if nested(df, c) else F.col(c).cast("string")
    sides = []
    for sign, df in ((1, left), (-1, right)):
        sides.append(df.select(*[text(df, k).alias(f"k{i}") for i, k in enumerate(keys)], *[text(df, f).alias(f"f{i}") for i, f in enumerate(fields)], F.lit(sign).alias("sign")))
    k_cols, f_cols = [f"k{i}" for i in range(len(keys))], [f"f{i}" for i in range(len(fields))]
    # equal rows are set against each other by count, with partial sums on the map side
    net = sides[0].unionAll(sides[1]).groupBy(*k_cols, *f_cols).agg(F.sum("sign").alias("n")).where("n <> 0")
    copies = net.select(*k_cols, *f_cols, (F.col("n") > 0).alias("is_left"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("n"))).alias("copy"))
    order = Window.partitionBy(*k_cols, "is_left").orderBy(*[F.col(c).asc_nulls_first() for c in f_cols], "copy")
    key = F.to_json(F.array(*k_cols), {"ignoreNullFields": "false"})
    rows = copies.withColumn("__at", F.row_number().over(order)).withColumn("__key", F.concat(key, F.lit("#"), F.col("__at")))
    buckets = bucket_count(left.count() + right.count())
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("__key"), F.lit(buckets))).select("__bucket", "__key", "is_left", *k_cols, *f_cols)
    out_schema = ", ".join(f"{c} string" for c in [*k_cols, "field", "diff_kind", "left_value", "right_value"])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return compare_tables(a, b.rename_columns([c.removeprefix("r_") for c in b.schema.names]), k_cols, f_cols)

    right_rows = rows.where("not is_left").select(*[F.col(c).alias(f"r_{c}") for c in rows.columns])
    cells = rows.where("is_left").groupBy("__bucket").cogroup(right_rows.groupBy("r___bucket")).applyInArrow(run, out_schema)
    names = F.create_map(*[x for i, f in enumerate(fields) for x in (F.lit(f"f{i}"), F.lit(f))]) if fields else F.create_map()
    return cells.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], (names[F.col("field")] if fields else F.lit(None).cast("string")).alias("field"), "diff_kind", "left_value", "right_value")
