"""The stored catalogue: immutable folders and numbered snapshots that name them.

A snapshot is a small file ``snapshots/<number>.json``; the largest number is the catalogue. A writer puts its tables into folders of its own and
commits by creating the next number, which only one of two writers can. What a snapshot no longer names stays until ``vacuum`` finds it
older than ``KEEP`` seconds, so a reader that is open goes on reading its own snapshot.

Each table is a list of folders. Batches add folders (``append``), and the index has one segment for each; its numbers add up. Links are small tables
(rid, path) beside the records, joined as these are read; the newest wins. ``compact`` writes one folder for each table again."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from .. import shared
from . import search as Q

SNAPSHOTS = "snapshots"
KEEP = 86400.0
PIECE_RECORDS = 20_000  # that a task sorts, about
MOST_LINKS = 16  # tables of links, before they become one
TABLES = ("records", "record_codes", "index", "links")


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


@dataclass(frozen=True)
class Snapshot:
    """What the catalogue of a target is at one time; paths are below the target."""

    number: int = 0
    records: tuple[str, ...] = ()
    record_codes: tuple[str, ...] = ()
    index: tuple[str, ...] = ()
    links: tuple[str, ...] = ()
    counts: dict = field(default_factory=dict)
    batches: dict = field(default_factory=dict)  # of each stream the last batch that is in

    def folders(self) -> set[str]:
        return {path.split("/")[0] for name in TABLES for path in getattr(self, name)}


@dataclass(frozen=True)
class Catalogue:
    records: DataFrame
    codes: DataFrame
    index: tuple[DataFrame, DataFrame, DataFrame] | None  # none in a catalogue for linking alone
    blocks: DataFrame | None
    size: int = 0  # records

    def search(self, query: str, filters: Q.Filters = Q.Filters()) -> DataFrame:
        """Best rows with bm25_score. What a keyword search of fewer records than the first blocks hold could skip is not worth the looking."""
        worth = self.size > Q.FIRST_BLOCKS << Q.BLOCK_BITS
        return Q.keyword(self.records, query, filters, self.index, self.blocks if worth else None)


def _numbers(spark: SparkSession, target: str) -> list[int]:
    names = shared.names(spark, f"{target}/{SNAPSHOTS}")
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _name(target: str, number: int) -> str:
    return f"{target}/{SNAPSHOTS}/{number:012d}.json"


def _read(spark: SparkSession, target: str, number: int) -> Snapshot:
    said = shared.read_text(spark, _name(target, number))
    if said["version"] != S.VERSION:
        raise ValueError(f"the catalogue has version {said['version']}, not {S.VERSION}: build it again")
    return Snapshot(number, *(tuple(said[name]) for name in TABLES), said["counts"], said["batches"])


def current(spark: SparkSession, target: str) -> Snapshot | None:
    """The newest snapshot, if there is one; one of another version is an error."""
    numbers = _numbers(spark, target)
    return _read(spark, target, numbers[-1]) if numbers else None


def base(spark: SparkSession, target: str, replace: bool = False) -> Snapshot:
    """What a writer begins from. With replace, older tables may be of any version; without, there mustn't be any."""
    numbers = _numbers(spark, target)
    if numbers and not replace:
        raise FileExistsError(target)
    return Snapshot(numbers[-1] if numbers else 0)


def commit(spark: SparkSession, target: str, since: Snapshot, content: Snapshot) -> Snapshot:
    """content as the snapshot after since; Conflict where there is one already."""
    said = {"version": S.VERSION, "at": time.time(), **{name: list(getattr(content, name)) for name in TABLES}, "counts": content.counts, "batches": content.batches}
    if _numbers(spark, target)[-1:] > [since.number] or not shared.write_new(spark, _name(target, since.number + 1), said):
        raise Conflict(f"{target} has changed since snapshot {since.number}")
    return Snapshot(since.number + 1, content.records, content.record_codes, content.index, content.links, content.counts, content.batches)


def written(spark: SparkSession, target: str, since: Snapshot, make: Callable[[str], Snapshot]) -> Snapshot:
    """Commits what make wrote into a folder of its own, whose name it is given; on any error the folder goes."""
    folder = uuid.uuid4().hex
    try:
        return commit(spark, target, since, make(folder))
    except BaseException:
        shared.remove(spark, f"{target}/{folder}")
        raise


def vacuum(spark: SparkSession, target: str, keep: float = KEEP, now: float | None = None) -> list[str]:
    """Removes snapshots that were superseded more than keep seconds ago, and folders as old that no other snapshot names; their names."""
    now, numbers = time.time() if now is None else now, _numbers(spark, target)
    said = {n: shared.read_text(spark, _name(target, n)) for n in numbers}
    gone = [a for a, b in zip(numbers, numbers[1:], strict=False) if said[b]["at"] < now - keep]
    live = {path.split("/")[0] for n in numbers if n not in gone for name in TABLES for path in said[n].get(name, ())}
    old = [f for f in shared.names(spark, target, folders=True) if f != SNAPSHOTS and f not in live and shared.changed(spark, f"{target}/{f}") < now - keep]
    for n in gone:
        shared.remove(spark, _name(target, n))
    for f in old:
        shared.remove(spark, f"{target}/{f}")
    return [*(f"{n:012d}.json" for n in gone), *old]


def at_snapshot(spark: SparkSession, target: str, snapshot: Snapshot) -> Catalogue:
    of = lambda name: [f"{target}/{path}" for path in getattr(snapshot, name)]
    records = spark.read.schema(S.RECORDS).parquet(*of("records"))
    if snapshot.links:
        records = with_local_paths(records, newest(spark, of("links")))
    index = (Q.read_index(spark, *of("index")), Q.read_blocks(spark, *of("index"))) if snapshot.index else (None, None)
    return Catalogue(records, spark.read.schema(S.STORED_CODES).parquet(*of("record_codes")), *index, snapshot.counts.get("records", 0))


def opened(spark: SparkSession, target: str, searched: bool = True) -> Catalogue:
    """The catalogue of target as it is now, and stays for this reader; none is an error. searched: one without an index is an error too."""
    snapshot = current(spark, target)
    if snapshot is None:
        raise FileNotFoundError(f"no catalogue in {target}")
    if searched and not snapshot.index:
        raise ValueError(f"the catalogue in {target} has no index: build it again")
    return at_snapshot(spark, target, snapshot)


def assert_unique(df: DataFrame, *key: str) -> None:
    twice = df.groupBy(*key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"not unique: {twice[0].asDict()}")


def write_tables(records: DataFrame, codes: DataFrame, target: str, folder: str, lap=lambda step: None, in_order: bool = False, indexed: bool = True) -> Snapshot:
    """Records, codes and index of one batch below target/folder, as a snapshot of these alone. in_order: records come in files of
    narrow ranges of rid already and are written as they are. Linking needs no index (indexed)."""
    spark, path = records.sparkSession, f"{target}/{folder}"
    spread = records if in_order else records.repartitionByRange(Q.pieces(spark, records.count(), PIECE_RECORDS), "rid").sortWithinPartitions("rid")
    spread.write.parquet(f"{path}/records")
    stored_records = spark.read.schema(S.RECORDS).parquet(f"{path}/records")
    assert_unique(stored_records, "aa_id")
    lap("records")
    Q.folded(codes).repartitionByRange(Q.pieces(spark, codes.count(), Q.PIECE_TERMS), "kind", "value_lc").sortWithinPartitions("kind", "value_lc").write.parquet(f"{path}/record_codes")
    stored_codes = spark.read.schema(S.STORED_CODES).parquet(f"{path}/record_codes")
    assert_unique(stored_codes, "rid", "kind", "value")
    lap("codes")
    if indexed:
        Q.write_index(stored_records, f"{path}/index")
        lap("index")
    counts = {"records": stored_records.count(), "codes": stored_codes.count(), "last": stored_records.agg(F.coalesce(F.max("rid"), F.lit(0)).alias("last")).head().last}
    return Snapshot(0, (f"{folder}/records",), (f"{folder}/record_codes",), (f"{folder}/index",) if indexed else (), (), counts)


def empty_catalogue(spark: SparkSession, target: str, replace: bool = False) -> Snapshot:
    """A catalogue without records below target."""
    tables = spark.createDataFrame([], S.RECORDS), spark.createDataFrame([], S.RECORD_CODES)
    return written(spark, target, base(spark, target, replace), lambda folder: write_tables(*tables, target, folder))


def append(spark: SparkSession, target: str, batch: Callable[[int], tuple[DataFrame, DataFrame]], stream: str | None = None, number: int | None = None) -> Snapshot:
    """Adds a batch's records and codes, numbered from the rid after which batch is told to begin, with an index segment of its own. A
    batch of a stream that is in already changes nothing."""
    old = current(spark, target) or empty_catalogue(spark, target)
    if stream is not None and old.batches.get(stream, -1) >= number:
        return old

    def make(folder: str) -> Snapshot:
        new = write_tables(*batch(old.counts["last"]), target, folder, indexed=bool(old.index))
        added = spark.read.schema(S.RECORDS).parquet(f"{target}/{folder}/records").select("aa_id")
        twice = added.join(at_snapshot(spark, target, old).records.select("aa_id"), "aa_id", "left_semi").limit(1).collect()
        if twice:
            raise ValueError(f"not unique: {twice[0].asDict()}")
        counts = {"records": old.counts["records"] + new.counts["records"], "codes": old.counts["codes"] + new.counts["codes"], "last": max(old.counts["last"], new.counts["last"])}
        lists = [getattr(old, name) + getattr(new, name) for name in TABLES[:3]]
        return Snapshot(0, *lists, old.links, counts, old.batches | ({stream: number} if stream is not None else {}))

    return written(spark, target, old, make)


def newest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """rid, path of stored links; of several for a record the one written last."""
    return spark.read.schema("rid long, path string, number long").parquet(*paths).groupBy("rid").agg(F.max_by("path", "number").alias("path"))


def with_local_paths(records: DataFrame, links: DataFrame) -> DataFrame:
    """records with the local_path of links (rid, path); others keep theirs."""
    new = links.select("rid", F.col("path").alias("_path"))
    return records.join(new, "rid", "left").withColumn("local_path", F.coalesce("_path", "local_path")).select(*records.columns)


def apply_links(spark: SparkSession, target: str, links: DataFrame) -> Snapshot:
    """Commits links (rid, path) beside the records: what is written is in proportion to the links. More than ``MOST_LINKS`` tables of links become one."""
    old = current(spark, target)
    if old is None:
        raise FileNotFoundError(f"no catalogue in {target}")

    def make(folder: str) -> Snapshot:
        new = links.select(F.col("rid").cast("long").alias("rid"), "path").withColumn("number", F.lit(old.number + 1).cast("long"))
        kept = old.links
        if len(kept) >= MOST_LINKS:
            new = new.unionByName(newest(spark, [f"{target}/{p}" for p in kept]).join(new, "rid", "left_anti").withColumn("number", F.lit(old.number).cast("long")))
            kept = ()
        new.sortWithinPartitions("rid").write.parquet(f"{target}/{folder}/links")
        return Snapshot(0, old.records, old.record_codes, old.index, (*kept, f"{folder}/links"), old.counts, old.batches)

    return written(spark, target, old, make)


def compact(spark: SparkSession, target: str) -> Snapshot:
    """One folder for each table, links in the records."""
    old = current(spark, target)
    if old is None:
        raise FileNotFoundError(f"no catalogue in {target}")
    now = at_snapshot(spark, target, old)

    def make(folder: str) -> Snapshot:
        new = write_tables(now.records, now.codes, target, folder)
        return Snapshot(0, new.records, new.record_codes, new.index, (), new.counts, old.batches)

    return written(spark, target, old, make)
