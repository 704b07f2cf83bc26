"""Problem 5: splits that keep related records together.

Method: an incremental, persisted component table (SplitTable). Three tables are kept in a folder: the
component of each record, the component of each entry, and for each component its root with the root's
split and size. A batch hooks its records to components through shared entries; merges of components form
a parent table that is flattened by pointer jumping. A component that exists already keeps its split, a new
one fills the split with the largest deficit, and a merge of components with different splits is
quarantined; rows of earlier batches whose component or split changes so are issued again.

Members and entries are only ever appended, under the component they had at first; merges rewrite the
component table alone. Components are named "c:" and their smallest record at the time, so that no name is
a record's. Records met again are known by the table of members and counted once.

Entries that a single record holds connect nothing and are dropped by a count before anything is
joined, and a hot entry is only ever reduced to a minimum (map-side combined), never expanded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.consensus import stripped
from quernstone.runtime import discard, materialize, scratch_path

TARGETS = {"TRAIN": 0.8, "VALIDATION": 0.1, "TEST": 0.1}
QUARANTINE = "QUARANTINE"
#: Components with at least this share of all records are placed one by one; there can't be more than its inverse.
LARGE_SHARE = 0.002
#: Hash ranges in which the other components are summed up before they are placed.
RANGES = 512


def latest_rows(decisions: DataFrame, id_col: str, values: list[str]) -> DataFrame:
    """One row per id: that with the latest decided_at, then ingested_at; null ids have none."""
    order = F.struct("decided_at", "ingested_at", *[F.col(v).cast("string") for v in values if v not in ("decided_at", "ingested_at")])
    picked = decisions.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max_by(F.struct(*values), order).alias("v"))
    return picked.select(id_col, *[F.col(f"v.{v}").alias(v) for v in values])


def entries_of(rows: DataFrame, id_col: str, group_col: str = "group_ids") -> DataFrame:
    """Distinct (id_col, entry): entries trimmed of white space, blank and null ones left out."""
    return rows.select(id_col, F.explode(group_col).alias("e")).select(id_col, stripped("e").alias("entry")).where("entry <> ''").distinct()


def _flatten(parents: DataFrame, name: str) -> DataFrame:
    """Pointer jumping: every component's root in a table (component, parent) with parent <= component."""
    before = None
    while True:
        up = parents.select(F.col("component").alias("parent"), F.col("parent").alias("grand"))
        stepped = materialize(parents.join(up, "parent", "left").select("component", F.coalesce("grand", "parent").alias("parent"), (F.coalesce("grand", "parent") != F.col("parent")).alias("moved")), name)
        parents = stepped.select("component", "parent")
        done = not stepped.where("moved").limit(1).count()
        discard(before)
        before = stepped
        if done:
            return parents


def components(ids: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """(id_col, component) of every id: connected through the entries of edges (id_col, entry), directly or through others.

    A component is named after its smallest member, by the order of strings.
    """
    shared = edges.groupBy("entry").agg(F.count("*").alias("n")).where("n > 1").select("entry")
    links = materialize(edges.select(F.col(id_col).alias("node"), "entry").join(shared, "entry", "left_semi"), "links")
    labels = materialize(links.select("node", F.col("node").alias("component")).distinct(), "labels")
    while True:
        labelled = links.join(labels, "node")
        least = labelled.groupBy("entry").agg(F.min("component").alias("least"), F.max("component").alias("most"))
        open_entries = least.where("least <> most")
        # hook: each component to the smallest that any of its entries holds
        hooks = materialize(labelled.join(open_entries, "entry").groupBy("component").agg(F.min("least").alias("parent")).where("parent < component"), "hooks")
        if not hooks.limit(1).count():
            break
        roots = _flatten(hooks, "roots")
        old, labels = labels, materialize(labels.join(roots, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "labels")
        discard(old)
        discard(hooks)
    return ids.select(F.col(id_col).alias("node")).join(labels, "node", "left").select(F.col("node").alias(id_col), F.coalesce("component", "node").alias("component"))


def _place_large(sizes: list[tuple[str, int]], deficits: dict[str, float]) -> dict[str, str]:
    """Largest first, each to the split with the largest deficit."""
    placed = {}
    for component, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        split = max(deficits, key=lambda s: (deficits[s], s))
        deficits[split] -= size
        placed[component] = split
    return placed


def _intervals(deficits: dict[str, float], total: float) -> list[tuple[str, float]]:
    """Splits with the end of their part of [0, total), in proportion to their deficits."""
    open_ = {s: max(0.0, d) for s, d in deficits.items()}
    whole = sum(open_.values()) or 1.0
    out, at = [], 0.0
    for s, d in open_.items():
        if d > 0:
            at += d / whole * total
            out.append((s, at))
    return out or [(max(deficits, key=deficits.get), total)]


def assign(members: DataFrame, id_col: str, known: DataFrame | None = None, targets: dict[str, float] | None = None) -> DataFrame:
    """(component, split, size) of each component of members (id_col, component).

    known (component, split, size): the splits that exist; size counts their records. A component
    that holds known ones under its name has been told so by merge_known.
    """
    targets = targets or TARGETS
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    have = {s: 0 for s in targets}
    if known is not None:
        for r in known.groupBy("split").agg(F.sum("size").alias("n")).collect():  # one row per split
            if r["split"] in have:
                have[r["split"]] += r["n"]
        old = known.select("component", F.col("split").alias("old_split"), F.col("size").alias("old_size"))
        sizes = sizes.join(old, "component", "left")
    else:
        sizes = sizes.withColumns({"old_split": F.lit(None).cast("string"), "old_size": F.lit(0)})
    sizes = materialize(sizes, "sizes")
    for r in sizes.where("old_split is not null").groupBy("old_split").agg(F.sum("size").alias("n")).collect():
        if r["old_split"] in have:
            have[r["old_split"]] += r["n"]
    new = sizes.where("old_split is null")
    fresh = new.agg(F.sum("size")).first()[0] or 0
    total = fresh + sum(have.values())
    deficits = {s: t * total - have[s] for s, t in targets.items()}
    limit = max(1.0, LARGE_SHARE * total)
    large = [(r["component"], r["size"]) for r in new.where(F.col("size") > limit).select("component", "size").collect()]
    placed = _place_large(large, deficits)
    small = new.where(F.col("size") <= limit).withColumn("hash", F.xxhash64("component")).withColumn("range", F.pmod("hash", F.lit(RANGES)))
    offsets, at = {}, 0
    for r in sorted(small.groupBy("range").agg(F.sum("size").alias("n")).collect(), key=lambda r: r["range"]):  # at most RANGES rows
        offsets[r["range"]] = at
        at += r["n"]
    start = F.element_at(F.create_map(*[F.lit(float(x)) if i % 2 else F.lit(x) for kv in offsets.items() for i, x in enumerate(kv)]), F.col("range")) if offsets else F.lit(0.0)
    before = Window.partitionBy("range").orderBy("hash", "component").rowsBetween(Window.unboundedPreceding, -1)
    place = start + F.coalesce(F.sum("size").over(before), F.lit(0)) + F.col("size") / 2
    pick: Column = F.lit(_intervals(deficits, at)[-1][0])
    for s, end in reversed(_intervals(deficits, at)[:-1]):
        pick = F.when(F.col("place") < end, F.lit(s)).otherwise(pick)
    filled = small.withColumn("place", place).select("component", pick.alias("split"), "size")
    kept = sizes.where("old_split is not null").select("component", F.col("old_split").alias("split"), (F.col("size") + F.col("old_size")).alias("size"))
    out = filled.unionByName(kept)
    if placed:
        rows = members.sparkSession.createDataFrame([(c, placed[c], n) for c, n in large], "component string, split string, size bigint")
        out = out.unionByName(rows)
    return out


#: Prefixes of the nodes of a batch's graph: a component that exists sorts before every new record.
COMPONENT, RECORD = "c:", "r:"


@dataclass
class Tables:
    """members (record, component), entries (entry, component), components (component, root, split, size).

    split and size, the number of records, stand in the rows of roots (component = root).
    """

    members: DataFrame
    entries: DataFrame
    components: DataFrame

    def rooted(self, rows: DataFrame) -> DataFrame:
        """rows under the roots of their components."""
        roots = self.components.select("component", "root")
        return rows.join(roots, "component").drop("component").withColumnRenamed("root", "component")

    def splits(self) -> DataFrame:
        return self.components.where("component = root").select("component", "split", "size")


def split_batch(rows: DataFrame, known: Tables, id_col: str = "task_id", group_col: str = "group_ids", targets: dict[str, float] | None = None) -> tuple[Tables, DataFrame]:
    """The rows to append to members and entries, with the components that hold from now on; and the rows issued.

    Issued are (id_col, component, split) of the batch's new records and of earlier ones whose component
    or split has changed.

    Defined cases: a record without entries is a component of its own; null ids have no row; ids that
    repeat count once with the entries of all their rows, in later batches too; an empty batch leaves the
    tables as they are.
    """
    of_batch = entries_of(rows, id_col, group_col).withColumnRenamed(id_col, "record").withColumn("record", F.col("record").cast("string"))
    ids = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("record")).distinct()
    met = known.rooted(known.members.join(ids, "record", "left_semi"))
    node = F.coalesce("component", F.concat(F.lit(RECORD), "record"))
    nodes = materialize(ids.join(met, "record", "left").select("record", node.alias("node"), F.col("component").isNull().alias("is_new")), "nodes")
    edges = materialize(of_batch.join(nodes, "record").select("node", "entry").distinct(), "edges")
    held = materialize(known.rooted(known.entries.join(edges.select("entry").distinct(), "entry", "left_semi")).distinct(), "held")
    graph = edges.unionByName(held.select(F.col("component").alias("node"), "entry")).distinct()
    everyone = nodes.select("node").union(held.select("component")).distinct()
    table = materialize(components(everyone, graph, "node"), "batch")
    name = F.when(F.startswith("component", F.lit(COMPONENT)), F.col("component")).otherwise(F.concat(F.lit(COMPONENT), F.expr(f"substring(component, {len(RECORD) + 1})")))
    table = table.select("node", name.alias("component"))
    members = materialize(nodes.where("is_new").join(table, "node").select("record", "component"), "members")
    # of each component that merges, the root that takes it in
    moves = materialize(table.where((F.startswith("node", F.lit(COMPONENT))) & (F.col("node") != F.col("component"))).select(F.col("node").alias("root"), F.col("component").alias("into")), "moves")
    before = known.splits().withColumnRenamed("component", "root").join(moves, "root", "left").withColumn("component", F.coalesce("into", "root"))
    merged = before.groupBy("component").agg(
        F.when(F.min("split") != F.max("split"), F.lit(QUARANTINE)).otherwise(F.min("split")).alias("split"), F.sum("size").alias("size"))
    merged = materialize(merged, "merged")
    placed = assign(members, "record", merged, targets)
    roots = materialize(placed.unionByName(merged.join(placed.select("component"), "component", "left_anti")), "roots")
    up = known.components.select("component", "root").join(moves, "root", "left").select("component", F.coalesce("into", "root").alias("root"))
    new = roots.select("component").join(known.components.select("component"), "component", "left_anti").select("component", F.col("component").alias("root"))
    all_ = up.unionByName(new).join(roots.withColumnRenamed("component", "of"), F.col("component") == F.col("of"), "left")
    table_now = materialize(all_.select("component", "root", F.when(F.col("component") == F.col("root"), F.col("split")).alias("split"), F.when(F.col("component") == F.col("root"), F.col("size")).alias("size")), "components")
    fresh = edges.join(table, "node").select("entry", "component").distinct().join(held.select("entry"), "entry", "left_anti")
    now = Tables(members, materialize(fresh, "entries"), table_now)
    changed = before.join(roots.select("component", F.col("split").alias("now")), "component").where((F.col("root") != F.col("component")) | (F.col("split") != F.col("now"))).select("root")
    old = known.members.join(known.components.select("component", "root"), "component").join(changed, "root", "left_semi").select("record", "component")
    issued = now.rooted(old.unionByName(members)).join(now.splits().drop("size"), "component")
    return now, issued.select(F.col("record").cast(rows.schema[id_col].dataType).alias(id_col), "component", "split")


class SplitTable:
    """The persisted tables in a folder of the shared storage: members and entries by batch, components by version.

    A batch counts once its version of the components is complete; what a lost batch left behind is
    overwritten by the next.
    """

    MEMBERS, ENTRIES, COMPONENTS = "record string, component string", "entry string, component string", "component string, root string, split string, size bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        """Number of the last complete batch, 0 for none."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/components")
        files = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = [0]
        if files.exists(hadoop):
            for status in files.listStatus(hadoop):
                if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                    done.append(int(status.getPath().getName()))
        return max(done)

    def tables(self) -> Tables:
        last = self.version()
        parts = lambda name, schema: self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}/{k}" for k in range(1, last + 1)])
        if not last:
            return Tables(*[self.spark.createDataFrame([], s) for s in (self.MEMBERS, self.ENTRIES, self.COMPONENTS)])
        return Tables(parts("members", self.MEMBERS), parts("entries", self.ENTRIES), self.spark.read.schema(self.COMPONENTS).parquet(f"{self.path}/components/{last}"))

    def update(self, rows: DataFrame, id_col: str = "task_id", group_col: str = "group_ids", targets: dict[str, float] | None = None) -> DataFrame:
        """Take in a batch; returns the rows issued, see split_batch."""
        batch = self.version() + 1
        now, issued = split_batch(rows, self.tables(), id_col, group_col, targets)
        for name, table in (("members", now.members), ("entries", now.entries), ("components", now.components)):
            table.write.mode("overwrite").parquet(f"{self.path}/{name}/{batch}")
        return issued

    def rows(self, id_col: str = "task_id") -> DataFrame:
        """(id_col, component, split) of every record taken in so far."""
        tables = self.tables()
        return tables.rooted(tables.members).join(tables.splits().drop("size"), "component").select(F.col("record").alias(id_col), "component", "split")


def arrivals(decisions: DataFrame, id_col: str, values: list[str], late: str = "interval 1 day") -> tuple[DataFrame, DataFrame]:
    """The latest row of each id, in two batches: those ingested in time, and those that came late."""
    rows = materialize(latest_rows(decisions, id_col, [*values, "decided_at", "ingested_at"]), "latest")
    is_late = F.coalesce(F.col("ingested_at") > F.col("decided_at") + F.expr(late), F.lit(False))
    return rows.where(~is_late), rows.where(is_late)


def torn_records(decisions: DataFrame, id_col: str = "task_id") -> DataFrame:
    """(id_col, component, split) of records in TRAIN or VALIDATION whose component holds both.

    Components come from a component table that takes the decisions in as they arrived.
    """
    spark = decisions.sparkSession
    table = SplitTable(spark, scratch_path(spark, "components"))
    batches = arrivals(decisions, id_col, ["split", "group_ids"])
    for batch in batches:
        table.update(batch, id_col)
    split = F.upper(stripped("split")).alias("split")
    present = batches[0].unionByName(batches[1]).select(F.col(id_col), split).where(F.col("split").isin("TRAIN", "VALIDATION"))
    both = present.join(table.rows(id_col).drop("split"), id_col)
    torn = both.groupBy("component").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select("component")
    return both.join(torn, "component", "left_semi").select(id_col, "component", "split")


def split_decisions(decisions: DataFrame, id_col: str = "task_id") -> DataFrame:
    """(id_col, component, split) of all records, from a component table that takes the decisions in as they arrived."""
    spark = decisions.sparkSession
    table = SplitTable(spark, scratch_path(spark, "components"))
    for batch in arrivals(decisions, id_col, ["group_ids"]):
        table.update(batch, id_col)
    return table.rows(id_col)
