"""Checking new batches of documents for repeats against all accepted ones."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from shirabe.llm.bare import bare_text
from shirabe.llm.chunks import FINE, LENGTH, packed_pieces, packed_rows
from shirabe.operators.history import micros
from shirabe.tables import Workspace

#: Tables of ids of up to this many rows (about 16 bytes each) are broadcast once counted; larger ones are joined by shuffle.
BROADCAST_IDS = 200_000


@dataclass(frozen=True)
class DedupParams:
    """similarity: least share of common pieces of ``piece`` characters; divisor: mean chunk length;
    coverage: least share of each text's chunk bytes that a repeat must have in common with it;
    short: texts of up to so many characters are also chunked into all their pieces, of which ``similarity`` is
    the coverage, so that none of their repeats can be missed; margin: share of a text's bytes that its looked-up
    chunks must have in common with a repeat; heads: documents of one chunk that the others are compared with in one
    round; hot: rows of a chunk from which on a look-up is spread over tasks; common_share: chunks that more of a batch's
    documents have are counted beside each document instead of being shuffled; buckets: of the chunk table, as many as
    the session has shuffle partitions if not given."""

    similarity: float = 0.6
    piece: int = 5
    divisor: int = 11
    coverage: float = 0.45
    short: int = 128
    margin: float = 0.03
    heads: int = 64
    hot: int = 100_000
    common_share: float = 0.001
    buckets: int | None = None


def arrivals(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, at, text): documents that have text, with their run's created_at in microseconds.

    Documents of an unknown run come last. Null or empty texts are left out.
    """
    when = runs.groupBy(F.col("id").alias("extraction_run_id")).agg(F.min(micros(F.col("created_at"))).alias("at"))
    docs = documents.select("doc_id", "extraction_run_id", "text").where("text IS NOT NULL AND text <> ''")
    return docs.join(when, "extraction_run_id", "left").select("doc_id", F.coalesce("at", F.lit(2**62)).alias("at"), "text")


_PREPARED = "doc_id bigint, at bigint, digest binary, bare string, chunks array<bigint>, whole int, pieces int"


def _prepared(docs: DataFrame, params: DedupParams) -> DataFrame:
    """Documents (doc_id, at, text, part) whose bare text isn't empty, with its digest, its chunks, and how many characters and pieces these make up."""
    divisor, piece, short = params.divisor, params.piece, params.short

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bare = [bare_text(t) for t in b.column("text").to_pylist()]
            kept = np.array([bool(t) for t in bare], bool)
            bare = [t for t in bare if t]
            number, chunks = packed_rows(bare, divisor)
            fine, pieces = packed_pieces(bare, piece, short)
            whole = np.bincount(number, weights=chunks & LENGTH, minlength=len(bare)).astype(np.int32)
            many = np.bincount(fine, minlength=len(bare)).astype(np.int32)
            order = np.argsort(np.concatenate([number, fine]), kind="stable")
            values = np.concatenate([chunks, pieces])[order]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(bare)) + many)]).astype(np.int32)
            rows = b.filter(pa.array(kept))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    rows.column("at"),
                    pa.array([hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in bare], pa.binary()),
                    pa.array(bare, pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(values, pa.int64())),
                    pa.array(whole),
                    pa.array(many),
                    rows.column("part"),
                ],
                names=["doc_id", "at", "digest", "bare", "chunks", "whole", "pieces", "part"],
            )

    return docs.select("doc_id", "at", "text", "part").mapInArrow(run, f"{_PREPARED}, part int")


@F.pandas_udf(DoubleType())
def _common_share(a: pd.Series, b: pd.Series, piece: pd.Series) -> pd.Series:
    out, last, kept = [], None, set()
    for x, y, n in zip(a, b, piece):
        if x != last:
            last, kept = x, {x[i : i + n] for i in range(len(x) - n + 1)} or {x}
        other = {y[i : i + n] for i in range(len(y) - n + 1)} or {y}
        both = len(kept & other)
        out.append(both / (len(kept) + len(other) - both))
    return pd.Series(out, dtype="float64")


def _weight(chunk: Column) -> Column:
    return chunk.bitwiseAND(F.lit(LENGTH)).cast("int")


def _is_fine(chunk: Column) -> Column:
    return chunk.bitwiseAND(F.lit(FINE)) != 0


def _bytes(chunks: Column) -> Column:
    """Characters of the chunks that are no pieces."""
    return F.aggregate(chunks, F.lit(0), lambda s, c: s + F.when(_is_fine(c), 0).otherwise(_weight(c)))


def _order(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}at").alias("at"), F.col(f"{prefix}doc_id").alias("doc_id"))


class ChunkHistory:
    """What is kept of the accepted documents between batches, in a folder that a later session can open again.

    ``docs``: the prepared documents of each batch, once written; ``chunks``: the
    chunk-to-record table (chunk, doc_id) of the accepted ones, in buckets by
    chunk; ``seen``: (digest, rep_id) of every text that came, with the accepted
    document that stands for it, in buckets by digest; ``done``: a file per batch
    that is wholly stored. Rows of a batch that was broken off carry its own
    mark, which no such file names, and are never read.

    A new batch reads its own documents, and of the history the chunk and digest
    tables, which stay in their buckets: only the batch is shuffled. Texts of the
    history are read for the pairs that the shared byte totals leave.
    """

    def __init__(self, workspace: Workspace, params: DedupParams = DedupParams(), path: str | None = None):
        """Opens the history under ``path``, or begins one there; without ``path`` it lives as long as ``workspace``."""
        self.workspace, self.params, self.spark = workspace, params, workspace.spark
        self.path = (path or f"{workspace.root}/history").rstrip("/")
        self.batches: list[dict] = []
        if _exists(self.spark, f"{self.path}/done"):
            self.batches = sorted((json.loads(r[0]) for r in self.spark.read.text(f"{self.path}/done", recursiveFileLookup=True).collect()), key=lambda b: b["number"])
            if any(b["params"] != asdict(params) for b in self.batches):
                raise ValueError(f"{self.path} was made with other parameters")
        self.buckets = self.batches[0]["buckets"] if self.batches else params.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables = {name: self._table(name, columns, by) for name, columns, by in (("chunks", "chunk bigint, doc_id bigint", "chunk"), ("seen", "digest binary, rep_id bigint", "digest"))}

    def _table(self, name: str, columns: str, by: str) -> str:
        table = f"shirabe_{name}_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {table} ({columns}, mark bigint) USING parquet CLUSTERED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return table

    def close(self) -> None:
        """Takes the tables' names out of the session's catalog; the files stay."""
        for table in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def _stored(self, name: str) -> DataFrame | None:
        """The rows of a table that belong to stored batches."""
        if not self.batches:
            return None
        return self.spark.table(self.tables[name]).where(F.col("mark").isin(*[b["mark"] for b in self.batches])).drop("mark")

    def _store(self, name: str, rows: DataFrame, by: str, mark: int) -> None:
        rows.withColumn("mark", F.lit(mark)).repartition(self.buckets, by).write.insertInto(self.tables[name])

    def _small(self, ids: DataFrame) -> DataFrame:
        """A written table of ids, to be broadcast if it is small."""
        return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def stage(self, docs: DataFrame) -> dict[int, str]:
        """Prepares documents (doc_id, at, text, part) in one pass; returns the folder of each part's batch."""
        at = f"{self.path}/docs/{uuid.uuid4().hex}"
        _prepared(docs, self.params).write.partitionBy("part").parquet(at)
        parts = [r[0] for r in self.spark.read.schema(f"{_PREPARED}, part int").parquet(at).select("part").distinct().collect()]
        return {part: f"{at}/part={part}" for part in sorted(parts)}

    def add(self, batch: DataFrame) -> DataFrame:
        """Checks a batch (doc_id, at, text) and appends its accepted documents.

        Returns (doc_id, repeats): the documents that are not accepted, with the
        first accepted document that each repeats. Every document of the batch
        must come after all documents added before.
        """
        staged = self.stage(batch.select("doc_id", "at", "text", F.lit(0).alias("part")))
        return self.add_staged(staged.get(0))

    def add_staged(self, folder: str | None) -> DataFrame:
        """``add`` of a batch that ``stage`` has prepared."""
        ws = self.workspace
        if folder is None:
            return self.spark.createDataFrame([], "doc_id bigint, repeats bigint")
        docs = self.spark.read.schema(_PREPARED).parquet(folder)
        classes = docs.groupBy("digest").agg(F.min(F.struct("at", "doc_id", "whole", "pieces")).alias("first"), F.count("*").alias("n"))
        seen = self._stored("seen")
        past = F.lit(None).cast("bigint").alias("past") if seen is None else F.col("rep_id").alias("past")
        classes = (classes if seen is None else classes.join(seen, "digest", "left")).select("digest", "first", "n", past)
        classes = ws.write(classes, "classes")
        known = classes.where("n > 1 OR past IS NOT NULL").select("digest", F.col("first.doc_id").alias("rep_id"), "past")
        copies = docs.select("doc_id", "digest").join(known, "digest").where("past IS NOT NULL OR doc_id <> rep_id").select("doc_id", "rep_id", "past")
        copies = ws.write(copies, "copies")
        opened = classes.where("past IS NULL").select("first.*")
        keys = ws.write(self._keys(docs, opened), "keys")
        found = self._against_past(keys, docs)
        found = self._within(keys, docs, found)
        self._append(docs, classes, copies, found, folder)
        found = found.select("doc_id", F.col("partner.doc_id").alias("repeats"))
        of_copies = copies.join(found.withColumnRenamed("doc_id", "rep_id"), "rep_id", "left").select("doc_id", F.coalesce("past", "repeats", "rep_id").alias("repeats"))
        return found.unionByName(of_copies)

    def _append(self, docs: DataFrame, classes: DataFrame, copies: DataFrame, found: DataFrame, folder: str) -> None:
        mark = uuid.uuid4().int >> 65
        refused = self.workspace.write(copies.select("doc_id").unionByName(found.select("doc_id")), "refused")
        accepted = docs.select("doc_id", "chunks").join(self._small(refused), "doc_id", "left_anti")
        self._store("chunks", accepted.select(F.explode("chunks").alias("chunk"), "doc_id"), "chunk", mark)
        stands = classes.where("past IS NULL").select("digest", F.col("first.doc_id").alias("doc_id")).join(found, "doc_id", "left")
        self._store("seen", stands.select("digest", F.coalesce("partner.doc_id", "doc_id").alias("rep_id")), "digest", mark)
        done = {"number": len(self.batches), "mark": mark, "docs": folder, "buckets": self.buckets, "params": asdict(self.params)}
        self.spark.createDataFrame([(json.dumps(done),)], "value string").coalesce(1).write.text(f"{self.path}/done/{done['number']:06d}")
        self.batches.append(done)

    def _similar(self, likely: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
        """Of pairs (doc_id, a_doc_id) those that are repeats, with ``at`` and ``a_at``.

        The byte totals of all shared chunks decide by coverage; short texts have
        their pieces for that. What they let through is checked exactly on the
        pieces of both bare texts.
        """
        p = self.params
        likely = self.workspace.write(likely, "likely")
        columns = ["doc_id", "at", "chunks", "bare", "whole", "pieces"]
        need = self._small(likely.select("doc_id").distinct())
        a_need = self._small(likely.select(F.col("a_doc_id").alias("doc_id")).distinct())
        mine = left.select(*columns).join(need, "doc_id", "left_semi")
        other = right.select(*columns).join(a_need, "doc_id", "left_semi").select(*[F.col(c).alias(f"a_{c}") for c in columns])
        both = likely.join(mine, "doc_id").join(other, "a_doc_id")
        shared = _bytes(F.array_intersect("chunks", "a_chunks"))
        covered = both.where(((F.col("pieces") > 0) & (F.col("a_pieces") > 0)) | (shared >= F.greatest("whole", "a_whole") * p.coverage))
        return covered.where(_common_share("bare", "a_bare", F.lit(p.piece)) >= p.similarity).select("doc_id", "at", "a_doc_id", "a_at")

    def _keys(self, docs: DataFrame, opened: DataFrame) -> DataFrame:
        """(chunk, doc_id, at, whole, n): the rare chunks by which a repeat must be found.

        Chunks that no other document has are no keys. A document whose other
        chunks make up less than ``coverage`` of it can repeat nothing. Of the
        rest, taken from the rarest on, so many are keys that those left out
        stay below ``coverage`` less ``margin``: two documents that share as much
        as ``coverage`` have ``margin`` in common among their keys, as the order
        is the same for all. ``whole`` is what ``margin`` is taken of. Chunks and
        pieces are looked at apart.
        """
        p, ws = self.params, self.workspace
        rows = docs.select("doc_id", F.explode("chunks").alias("chunk"))
        counts = rows.groupBy("chunk").agg(F.count("*").alias("n"))
        past = self._stored("chunks")
        if past is not None:
            past = past.groupBy("chunk").agg(F.count("*").alias("past"))
            counts = counts.join(past, "chunk", "left").select("chunk", (F.col("n") + F.coalesce("past", F.lit(0))).alias("n"))
        counts = ws.write(counts.where("n > 1"), "counts")
        # Chunks that very many documents have: at most as many as an average document has, over common_share.
        often = max(p.heads, opened.count() * p.common_share)
        top = ws.write(counts.where(F.col("n") > often), "commonest")
        bounded = top.count() <= BROADCAST_IDS
        if not bounded:
            top = top.limit(0)
        fine = _is_fine(F.col("chunk"))
        weight = _weight(F.col("chunk"))
        whole = F.when(F.col("fine"), F.col("pieces")).otherwise(F.col("whole"))
        least = lambda share: F.when(F.col("fine"), p.similarity - share).otherwise(p.coverage - share)
        beside = rows.join(F.broadcast(top), "chunk").groupBy("doc_id", fine.alias("fine")).agg(F.sum(weight).alias("beside"))
        sizes = opened.select("doc_id", "at", "whole", "pieces", F.explode(F.array(F.lit(False), F.lit(True))).alias("fine")).select("doc_id", "at", "fine", whole.alias("whole")).where("whole > 0")
        sizes = sizes.join(beside, ["doc_id", "fine"], "left").select("doc_id", "at", "fine", "whole", F.coalesce("beside", F.lit(0)).alias("beside"))
        # Where these alone could make up enough, they are taken like all others.
        sizes = ws.write(sizes.withColumn("full", F.col("beside") >= F.col("whole") * least(p.margin)), "sizes")
        common = rows.join(F.broadcast(top.select("chunk")), "chunk", "left_anti").join((counts.where(F.col("n") <= often) if bounded else counts).hint("shuffle_hash"), "chunk")
        full = self._small(sizes.where("full").select("doc_id").distinct())
        common = common.select("chunk", "doc_id", "n").unionByName(rows.join(full, "doc_id", "left_semi").join(F.broadcast(top), "chunk").select("chunk", "doc_id", "n"))
        # The sums come before the sizes, so that one shuffle and one sort by document serve both.
        commonest = Window.partitionBy("doc_id", "fine").orderBy(F.desc("n"), F.desc("chunk"))
        upward, through = commonest.rowsBetween(Window.unboundedPreceding, 0), commonest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rare = F.when(F.col("n") <= often, weight).otherwise(0) if bounded else weight
        common = common.select("chunk", "doc_id", "n", fine.alias("fine"))
        summed = common.select("*", F.sum(weight).over(upward).alias("so_far"), F.sum(rare).over(upward).alias("rare_so_far"), F.sum(rare).over(through).alias("rare_total"))
        sized = summed.join(sizes.hint("shuffle_hash"), ["doc_id", "fine"])
        # A document that is full in its chunks need not be so in its pieces.
        so_far = F.when(F.col("full"), F.col("so_far")).otherwise(F.col("beside") + F.col("rare_so_far"))
        sized = sized.where(F.col("full") | (F.col("n") <= often)) if bounded else sized
        kept = sized.where((F.col("beside") + F.col("rare_total") >= F.col("whole") * least(0.0)) & (so_far >= F.col("whole") * least(p.margin)))
        return kept.select("chunk", "doc_id", "at", "whole", "n")

    def _likely(self, joined: DataFrame) -> DataFrame:
        """Pairs (doc_id, a_doc_id) of rows (chunk, doc_id, a_doc_id, whole, partial) whose shared keys make up enough.

        ``partial`` marks chunks of which not all documents are there: their pairs are kept in any case.
        """
        sums = joined.groupBy("doc_id", "a_doc_id", _is_fine(F.col("chunk")).alias("fine")).agg(F.sum(_weight(F.col("chunk"))).alias("shared"), F.max("whole").alias("whole"), F.max("partial").alias("partial"))
        return sums.where(F.col("partial") | (F.col("shared") >= F.col("whole") * self.params.margin)).select("doc_id", "a_doc_id").distinct()

    def _against_past(self, keys: DataFrame, docs: DataFrame) -> DataFrame:
        """(doc_id, partner) of documents that repeat one accepted in an earlier batch.

        Keys go to the buckets of the chunk table. Those that very many documents
        have are joined by a shuffle of their own, which adaptive execution splits.
        """
        partner = "doc_id bigint, partner struct<at:bigint,doc_id:bigint>"
        past = self._stored("chunks")
        if past is None:
            return self.workspace.write(self.spark.createDataFrame([], partner), "found")
        past = past.select("chunk", F.col("doc_id").alias("a_doc_id"))
        columns = ["chunk", "doc_id", "a_doc_id", "whole", F.lit(False).alias("partial")]
        joined = past.join(keys.where(F.col("n") <= self.params.hot).hint("shuffle_hash"), "chunk").select(*columns)
        hot = keys.where(F.col("n") > self.params.hot)
        if not hot.isEmpty():
            wanted = past.join(hot.select("chunk").distinct(), "chunk", "left_semi").repartition("a_doc_id")
            joined = joined.unionByName(hot.join(wanted, "chunk").select(*columns))
        right = self.spark.read.schema(_PREPARED).parquet(*[b["docs"] for b in self.batches])
        similar = self._similar(self._likely(joined), docs, right)
        return self.workspace.write(similar.groupBy("doc_id").agg(F.min(_order("a_")).alias("partner")), "found")

    def _within(self, keys: DataFrame, docs: DataFrame, found: DataFrame) -> DataFrame:
        """Adds the documents that repeat one accepted in the same batch.

        In rounds: of each key chunk, the first ``heads`` open documents are
        compared with all later ones that have it, so a chunk that very many
        documents share costs a multiple of their number, not its square. A
        document is decided once all open documents before it in its chunks are
        among those heads. Accepted documents repel what repeats them at once,
        so a large group of near copies is gone after a round. Chunks of up to
        ``heads`` documents are done with after the first round.
        """
        ws, p = self.workspace, self.params
        keys = ws.write(keys.join(self._small(found.select("doc_id")), "doc_id", "left_anti"), "open-keys")
        crowded = keys.where(F.col("n") > p.heads).groupBy("chunk").agg(F.count("*").alias("m")).where(F.col("m") > p.heads).select("chunk")
        crowded = ws.write(crowded, "crowded")
        columns = ["chunk", "doc_id", "a_doc_id", "whole"]
        named = lambda rows: rows.select("chunk", F.col("doc_id").alias("a_doc_id"), F.col("at").alias("a_at"))
        earlier = _order("a_") < _order()
        if crowded.isEmpty():
            joined = keys.join(named(keys).hint("shuffle_hash"), "chunk").where(earlier).select(*columns, F.lit(False).alias("partial"))
            links = ws.write(self._similar(self._likely(joined), docs, docs), "links")
            linked = links.select("doc_id").union(links.select("a_doc_id")).distinct()
            return self._repelled(found, links, self._decide(ws.write(linked, "linked"), links, None))
        keys = ws.write(keys.join(self._small(crowded).withColumn("_c", F.lit(True)), "chunk", "left").withColumn("partial", F.coalesce("_c", F.lit(False))).drop("_c"), "marked-keys")
        totals = ws.write(keys.groupBy("doc_id").agg(F.count_if("partial").alias("n_long")), "key-counts")
        long, short = keys.where("partial"), keys.where("NOT partial")
        repelled, decided, links = found, None, None
        while True:
            waiting = long if decided is None else long.join(decided, "doc_id", "left_anti")
            rank = F.row_number().over(Window.partitionBy("chunk").orderBy("at", "doc_id"))
            heads = ws.write(named(waiting.withColumn("rank", rank).where(F.col("rank") <= p.heads)), "heads")
            if decided is not None and heads.isEmpty():
                return repelled
            full = heads.groupBy(F.col("a_doc_id").alias("doc_id")).agg(F.count("*").alias("n"))
            ready = totals.join(full, "doc_id", "left").where("n_long = coalesce(n, 0)").select("doc_id")
            later = long if decided is None else long.join(decided.where("accepted"), "doc_id", "left_anti")
            joined = later.join(heads, "chunk").where(earlier).select(*columns, "partial")
            if decided is None:
                joined = joined.unionByName(short.join(named(short), "chunk").where(earlier).select(*columns, "partial"))
            likely = self._likely(joined)
            if links is not None:
                likely = likely.join(links.select("doc_id", "a_doc_id"), ["doc_id", "a_doc_id"], "left_anti")
            fresh = self._similar(likely, docs, docs)
            links = ws.write(fresh if links is None else links.unionByName(fresh), "links")
            ready = ws.write(ready if decided is None else ready.join(decided, "doc_id", "left_anti"), "ready")
            decided = self._decide(ready, links, decided)
            repelled = self._repelled(found, links, decided)

    def _repelled(self, found: DataFrame, links: DataFrame, decided: DataFrame) -> DataFrame:
        """``found`` and the documents that repeat one accepted, each with the first that it repeats."""
        judged = links.join(decided.where("accepted").select(F.col("doc_id").alias("a_doc_id")), "a_doc_id", "left_semi").groupBy("doc_id").agg(F.min(_order("a_")).alias("partner"))
        return self.workspace.write(found.unionByName(judged), "repelled")

    def _decide(self, ready: DataFrame, links: DataFrame, decided: DataFrame | None) -> DataFrame:
        """Accepts ready documents whose earlier partners are all refused, and refuses what repeats an accepted one, until nothing changes."""
        ws = self.workspace
        decided = decided if decided is not None else ws.write(ready.withColumn("accepted", F.lit(True)).limit(0), "decided")
        while True:
            left = ready.join(decided, "doc_id", "left_anti")
            is_open = links.join(decided.where("NOT accepted").select(F.col("doc_id").alias("a_doc_id")), "a_doc_id", "left_anti")
            free = left.join(is_open, "doc_id", "left_anti").withColumn("accepted", F.lit(True))
            free = ws.write(free, "free")
            if free.isEmpty():
                return decided
            refused = links.join(free.select(F.col("doc_id").alias("a_doc_id")), "a_doc_id", "left_semi").select("doc_id").distinct().join(decided, "doc_id", "left_anti").withColumn("accepted", F.lit(False))
            decided = ws.write(decided.unionByName(free).unionByName(refused), "decided")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def repeats(documents: DataFrame, runs: DataFrame, workspace: Workspace, batches: int = 2, params: DedupParams = DedupParams()) -> DataFrame:
    """(doc_id, repeats) over all documents, taken as ``batches`` successive batches of whole runs.

    The documents are read once, and their prepared rows parted by batch.
    """
    docs = arrivals(documents, runs)
    cuts = (docs.agg(F.percentile_approx("at", [i / batches for i in range(1, batches)], 1000)).first()[0] or []) if batches > 1 else []
    part = sum([(F.col("at") > cut).cast("int") for cut in cuts], F.lit(0))
    history = ChunkHistory(workspace, params)
    out = history.add_staged(None)
    for folder in history.stage(docs.withColumn("part", part)).values():
        out = out.unionByName(history.add_staged(folder))
    history.close()
    return out


def found_pairs(documents: DataFrame, runs: DataFrame, workspace: Workspace) -> DataFrame:
    """(doc_id_a, doc_id_b) with a < b: every document that is not accepted and the first accepted one it repeats."""
    return repeats(documents, runs, workspace).select(F.least("doc_id", "repeats").alias("doc_id_a"), F.greatest("doc_id", "repeats").alias("doc_id_b"))
