"""History of changing attributes from snapshots, compared by Merkle trees."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shirabe.tables import Workspace, exists


#: Nodes of a level of the tree that are compared on the driver (16 bytes each); larger levels are joined.
DRIVER_NODES = 4096


class SnapshotHistory:
    """Versions of keyed rows, built from successive snapshots, in a folder that a later session can open again.

    ``keys`` name a row and ``entity``, the first of them or all, what it belongs
    to. Entities fall by hash into ``fanout ** depth`` leaf buckets; without a
    ``depth`` the first snapshot's size decides, for about ``leaf_rows`` rows a
    leaf. A leaf's digest is an order-free hash of its rows; a node's digest is
    made of those of the leaves under it. A new tree is compared with the stored
    one from the root, and only children of nodes that differ are looked at. Rows
    of the changed leaves are then compared by key and their new versions
    appended. Versions are stored in a folder for each top branch, so those under
    equal branches are not read, and those of equal leaves are not compared.

    The appended table has the key and value columns, ``snapshot`` (its number)
    and ``gone`` (the key is missing from that snapshot). All work is spread by
    hash of the key, so no key gathers in a task beyond its own rows. Keys must
    be unique in a snapshot. Null values compare as equal; null keys are keys.
    """

    def __init__(self, workspace: Workspace, keys: list[str], values: list[str], fanout: int = 16, depth: int | None = None, entity: list[str] | None = None, path: str | None = None, leaf_rows: int = 1024):
        """Opens the history under ``path``, or begins one there; without ``path`` it lives as long as ``workspace``."""
        self.workspace, self.keys, self.values, self.fanout, self.leaf_rows = workspace, keys, values, fanout, leaf_rows
        self.entity, self.depth, self.spark = entity or keys, depth, workspace.spark
        self.path = (path or f"{workspace.root}/history").rstrip("/")
        self.done: list[dict] = []
        if exists(self.spark, f"{self.path}/done"):
            self.done = sorted((json.loads(r[0]) for r in self.spark.read.text(f"{self.path}/done", recursiveFileLookup=True).collect()), key=lambda d: d["snapshot"])
            self.fanout, self.depth = self.done[-1]["fanout"], self.done[-1]["depth"]

    @property
    def snapshots(self) -> int:
        return len(self.done)

    def _rows(self, snapshot: DataFrame) -> DataFrame:
        """The snapshot's rows with their leaf, top branch and digest."""
        if self.depth is None:
            snapshot = self.workspace.write(snapshot, "first")
            leaves = max(1.0, snapshot.count() / self.leaf_rows)
            self.depth = max(1, math.ceil(math.log(leaves, self.fanout) - 1e-9))
        leaf = F.pmod(F.xxhash64(*self.entity), F.lit(self.fanout**self.depth)).cast("int")
        return snapshot.select(
            *self.keys,
            *self.values,
            leaf.alias("leaf"),
            self._above(leaf, self.depth - 1).alias("branch"),
            F.xxhash64(*self.keys, *[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in self.values]).alias("digest"),
        )

    def _above(self, node: Column, levels: int) -> Column:
        return F.floor(node / self.fanout**levels).cast("int")

    def tree(self, rows: DataFrame) -> DataFrame:
        """(level, node, digest) of all levels; level 0 is the root. Made in one pass over the leaves."""
        leaves = rows.groupBy("leaf").agg(F.bit_xor("digest").alias("x"), F.sum(F.pmod("digest", F.lit(2**31))).alias("s"), F.count("*").alias("n"))
        leaves = leaves.select("leaf", F.xxhash64("leaf", "x", "s", "n").alias("digest"))
        levels = F.array(*[F.struct(F.lit(at).alias("level"), self._above(F.col("leaf"), self.depth - at).alias("node")) for at in range(self.depth + 1)])
        nodes = leaves.select("digest", F.explode(levels).alias("at")).groupBy("at.level", "at.node")
        return self.workspace.write(nodes.agg(F.bit_xor("digest").alias("digest")), "tree")

    def changed_leaves(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """(leaf,) of the leaf buckets that differ, found by descending from the root."""
        level, differing = -1, [0]
        while differing and level < self.depth and self.fanout ** (level + 1) <= DRIVER_NODES:
            level += 1
            here = lambda t: {r["node"]: r["digest"] for r in self._below(t, level, max(level - 1, 0), differing).collect()}
            before, after = here(old), here(new)
            differing = sorted(n for n in before.keys() | after.keys() if before.get(n) != after.get(n))
        if level == self.depth or not differing:
            return self.spark.createDataFrame([(n,) for n in differing], "leaf int")
        a, b = (self._below(t, self.depth, level, differing).select("node", F.col("digest").alias(name)) for t, name in ((old, "before"), (new, "after")))
        return a.join(b, "node", "full").where(~F.col("before").eqNullSafe(F.col("after"))).select(F.col("node").alias("leaf"))

    def _below(self, tree: DataFrame, level: int, above: int, nodes: list[int]) -> DataFrame:
        """Nodes of a level under those ``nodes`` of the level ``above``."""
        return tree.where((F.col("level") == level) & self._above(F.col("node"), level - above).isin(*nodes)).select("node", "digest")

    def append(self, snapshot: DataFrame) -> DataFrame:
        """Compares a snapshot with the state so far; returns and stores the new versions."""
        rows = self.workspace.write(self._rows(snapshot), "snapshot")
        number = self.snapshots + 1
        tree = self.tree(rows)
        if not self.done:
            fresh = rows.withColumn("gone", F.lit(False))
        else:
            changed = self.workspace.write(self.changed_leaves(self._tree(), tree), "changed")
            now = rows.join(changed, "leaf", "left_semi")
            was = self._current(changed).select(*[F.col(c).alias(f"_{c}") for c in (*self.keys, *self.values, "leaf", "branch", "digest")])
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in self.keys]
            both = now.join(was, [*same, F.col("leaf") == F.col("_leaf")], "full")
            gone = F.col("leaf").isNull()
            pick = lambda c: F.when(gone, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
            fresh = both.where(gone | F.col("_leaf").isNull() | (F.col("digest") != F.col("_digest"))).select(*[pick(c) for c in (*self.keys, *self.values, "leaf", "branch", "digest")], gone.alias("gone"))
        at = f"{self.path}/{uuid.uuid4().hex}"
        fresh = fresh.withColumn("snapshot", F.lit(number))
        fresh.hint("rebalance", "branch").write.partitionBy("branch").parquet(f"{at}/versions")
        tree.write.parquet(f"{at}/tree")
        self.workspace.drop(tree)
        self.workspace.drop(rows)
        done = {"snapshot": number, "at": at, "fanout": self.fanout, "depth": self.depth, "schema": fresh.schema.json()}
        self.spark.createDataFrame([(json.dumps(done),)], "value string").coalesce(1).write.text(f"{self.path}/done/{number:06d}")
        self.done.append(done)
        return self.appended(number)

    def appended(self, number: int) -> DataFrame:
        """The versions that a snapshot added."""
        return self._part(self.done[number - 1]).drop("leaf", "branch", "digest")

    def _tree(self) -> DataFrame:
        return self.spark.read.schema("level int, node int, digest bigint").parquet(f"{self.done[-1]['at']}/tree")

    def _part(self, done: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(done["schema"]))).parquet(f"{done['at']}/versions")

    def _all(self, leaves: DataFrame | None = None) -> DataFrame:
        """All versions, or those of some leaves, of whose branches alone the files are read."""
        branches = None if leaves is None else [r[0] for r in leaves.select(self._above(F.col("leaf"), self.depth - 1)).distinct().collect()]
        whole = None
        for done in self.done:
            part = self._part(done)
            if branches is not None:
                part = part.where(F.col("branch").isin(*branches)).join(leaves, "leaf", "left_semi")
            whole = part if whole is None else whole.unionByName(part)
        return whole

    def _current(self, leaves: DataFrame | None = None) -> DataFrame:
        rows = self._all(leaves)
        if len(self.done) == 1:
            return rows.drop("snapshot", "gone")
        rest = [c for c in rows.columns if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "snapshot").alias("last"))
        return last.where("NOT last.gone").select(*self.keys, *[f"last.{c}" for c in (*self.values, "leaf", "branch", "digest")])

    def current(self) -> DataFrame:
        """The keys and values as of the last snapshot."""
        return self._current().select(*self.keys, *self.values)

    def changed_entities(self) -> tuple[DataFrame, DataFrame]:
        """The entities of which the last snapshot added versions, and all their rows as they now are."""
        fresh = self._part(self.done[-1])
        changed = self.workspace.write(fresh.select(*self.entity, "leaf").distinct(), "changed-entities")
        now = self._current(self.workspace.write(changed.select("leaf").distinct(), "leaves"))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in self.entity]
        rows = now.join(changed.select(*[F.col(c).alias(f"_{c}") for c in self.entity]), same, "left_semi")
        return changed.drop("leaf"), self.workspace.write(rows.select(*self.keys, *self.values), "entity-rows")

    def versions(self) -> DataFrame:
        """Every version with ``first_snapshot`` and ``last_snapshot`` (null while it holds)."""
        w = Window.partitionBy(*self.keys).orderBy("snapshot")
        ended = self._all().withColumn("last_snapshot", F.lead("snapshot").over(w) - 1)
        return ended.where("NOT gone").select(*self.keys, *self.values, F.col("snapshot").alias("first_snapshot"), "last_snapshot")


def micros(moment: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (session zone UTC)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), moment.cast("timestamp_ntz"))


def holding_rows(history: DataFrame) -> DataFrame:
    """One row per term and version: that of the earliest created_at.

    Statuses are trimmed and in lower case. Ties on created_at go to the
    smallest status pair; a null created_at comes last. Rows without a term or a
    version are left out.
    """
    clean = lambda c: F.lower(F.regexp_replace(c, r"^[\s\x{3000}]+|[\s\x{3000}]+$", ""))
    rows = history.where("term_id IS NOT NULL AND review_version IS NOT NULL").select(
        "term_id",
        "review_version",
        F.struct(F.col("created_at").isNull().alias("late"), "created_at", clean("previous_status").alias("previous_status"), clean("new_status").alias("new_status")).alias("row"),
    )
    first = rows.groupBy("term_id", "review_version").agg(F.min("row").alias("row"))
    return first.select("term_id", "review_version", "row.created_at", "row.previous_status", "row.new_status")


def status_periods(rows: DataFrame, block: int = 1024) -> DataFrame:
    """(term_id, review_version, status, valid_from_us, valid_to_us) of holding rows.

    A period starts at a term's first version, where the status changes and
    where the row does not follow on from the version before it; it ends where
    the next one starts (-1: it holds). Versions are looked at in blocks, and
    only a row per block goes into the window over a whole term, so a term with
    very many versions does not gather in one task.
    """
    rows = rows.withColumn("block", F.floor(F.col("review_version") / block))
    inside = Window.partitionBy("term_id", "block").orderBy("review_version")
    across = Window.partitionBy("term_id").orderBy("block")
    here = F.struct("new_status")
    rows = rows.select("*", F.lag(here).over(inside).alias("before"))
    edge = rows.groupBy("term_id", "block").agg(F.max_by(here, "review_version").alias("last"))
    edge = edge.select("term_id", "block", F.lag("last").over(across).alias("before_block"))
    rows = rows.join(edge, ["term_id", "block"]).withColumn("before", F.coalesce("before", "before_block"))
    starts = rows.where(F.col("before").isNull() | ~F.col("new_status").eqNullSafe(F.col("previous_status")) | ~F.col("previous_status").eqNullSafe(F.col("before.new_status")))
    starts = starts.select("term_id", "block", "review_version", F.col("new_status").alias("status"), F.coalesce(micros(F.col("created_at")), F.lit(-1)).alias("valid_from_us"))
    heads = starts.groupBy("term_id", "block").agg(F.min_by("valid_from_us", "review_version").alias("head"))
    heads = heads.select("term_id", "block", F.lead("head").over(across).alias("next_head"))
    ended = starts.select("*", F.lead("valid_from_us").over(inside).alias("next")).join(heads, ["term_id", "block"])
    return ended.select("term_id", "review_version", "status", "valid_from_us", F.coalesce("next", "next_head", F.lit(-1)).alias("valid_to_us"))


def review_snapshots(history: DataFrame, count: int = 3) -> list[DataFrame]:
    """Cumulative snapshots of the review rows, cut at ``count - 1`` even quantiles of created_at."""
    at = micros(F.col("created_at"))
    cuts = history.select(at.alias("at")).agg(F.percentile_approx("at", [i / count for i in range(1, count)], 1000)).first()[0] or []
    return [holding_rows(history.where(at <= cut)) for cut in cuts] + [holding_rows(history)]


def status_history(history: DataFrame, workspace: Workspace, snapshots: int = 3, path: str | None = None) -> DataFrame:
    """Status periods of every term, kept up by ``SnapshotHistory`` over successive snapshots.

    A term is the entity, its review versions are its rows. After each snapshot
    the periods of those terms are made anew and appended whose leaves the
    descent found to differ and whose rows did; a term's periods are those
    appended last. All others stand as they were appended before.
    """
    store = SnapshotHistory(workspace, ["term_id", "review_version"], ["created_at", "previous_status", "new_status"], entity=["term_id"], path=path)
    periods, latest = None, None
    for snapshot in review_snapshots(history, snapshots):
        store.append(snapshot)
        changed, rows = store.changed_entities()
        number = F.lit(store.snapshots).alias("snapshot")
        part = workspace.write(status_periods(rows).select("*", number), "periods")
        changed = changed.select("term_id", number)
        periods, latest = (part, changed) if periods is None else (periods.unionByName(part), latest.unionByName(changed))
    return periods.join(latest.groupBy("term_id").agg(F.max("snapshot").alias("snapshot")), ["term_id", "snapshot"]).drop("snapshot")
