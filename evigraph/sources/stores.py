"""Tables that persist: manifest, graph, chunk vectors, decision log, benchmark results.

All are files that Spark reads and writes by itself. A keyed table lies in buckets by
linear hashing: there is one for every so many rows, and when the table grows only the
buckets that split are written anew. An upsert writes its own rows and, for the rows that
they replace, bitmaps of their places in their files; what is there stays where it is.
After some upserts, or large ones, the buckets that these touched are folded into one file
set again. A small file, the next version, names all that belongs to it. It appears by one
rename, so readers never see half a version and a writer that comes second is told so.

That holds on file systems whose rename is atomic and does not replace, as HDFS and local
disks. On an object store two writers could both pass; let one write a table there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evigraph import schemas as S
from evigraph.operators.graph import Graph
from evigraph.operators.maintain import merge_edges, merge_nodes
from evigraph.session import materialise

#: Rows in a bucket, about.
BUCKET_ROWS = 1 << 20
#: Upserts, and the share of the folded rows that they may hold, before they are folded in.
MOST_DELTAS, MOST_SHARE = 8, 0.25


def single(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row for each key: that whose other columns are smallest, null first. A null is a key like any other."""
    rest = [c for c in rows.columns if c not in key]
    if not rest:
        return rows.distinct()
    one = rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row"))
    return one.select(*key, "_row.*").select(rows.columns)


def _same(left: DataFrame, right: DataFrame, key: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in key:
        out &= left[c].eqNullSafe(right[f"_{c}"])
    return out


def _renamed(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"_{c}") for c in key))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in or replaced by key, all columns (A12); of rows of ``new`` with one key see single()."""
    new = single(new.select(old.columns), key)
    keys = _renamed(new, key)
    return old.join(keys, _same(old, keys, key), "left_anti").unionByName(new)


class WrittenMeanwhile(Exception):
    """Another writer made the next version first; read again and retry."""


def _level(n: int) -> int:
    return 1 << (n.bit_length() - 1)


def bucket_of(key: Sequence[str], n: int) -> Column:
    """The bucket of a key among n: by its hash's last bits, one bit more for the buckets that have split."""
    h, low = F.xxhash64(*key), _level(n)
    wide = F.pmod(h, F.lit(2 * low))
    return F.when(wide < n, wide).otherwise(F.pmod(h, F.lit(low))).cast("int")


def splitting(n: int, more: int) -> set[int]:
    """The buckets of n that rows leave when there are ``more``."""
    out = set()
    for b in range(n, min(more, 4 * _level(n))):  # beyond that all have split
        while b >= n:
            b -= _level(b)
        out.add(b)
    return out


@dataclass
class _State:
    """A version: number of buckets, file of the folded buckets' folders, their rows, and what came since."""

    buckets: int = 1
    base: str = ""
    rows: int = 0
    deltas: list[dict] = field(default_factory=list)  # folder, rows, buckets
    gone: list[dict] = field(default_factory=list)  # folder, buckets


class KeyedTable:
    """A Parquet table with a key, in buckets and numbered versions."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: Sequence[str], bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.schema, self.key, self.bucket_rows = spark, path.rstrip("/"), schema, list(key), bucket_rows

    # Small files.

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _load(self, path: str):
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _store(self, path: str, what) -> None:
        """Write a small file whole, by a rename that doesn't replace one that is there."""
        fs, p = self._fs(path)
        fs.mkdirs(p.getParent())
        part = self._fs(f"part-{uuid.uuid4().hex}")[1]
        out = fs.create(part)
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        if fs.exists(p) or not fs.rename(part, p):
            fs.delete(part, False)
            raise WrittenMeanwhile(f"{self.path}: {path}")

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("versions") if n.isdigit())

    def version(self) -> int:
        """The newest version, 0 if there is none."""
        return max(self.versions(), default=0)

    def state(self, version: int | None = None) -> _State:
        version = self.version() if version is None else version
        return _State(**self._load(f"versions/{version}")) if version else _State()

    def _base(self, state: _State) -> dict[int, str]:
        """Where each folded bucket lies; empty ones are absent."""
        return {int(k): v for k, v in self._load(state.base).items()} if state.base else {}

    # Reading.

    def _folders(self, state: _State, only: set[int] | None = None) -> list[str]:
        base = [f for k, f in self._base(state).items() if only is None or k in only]
        return base + [f"{d['folder']}/bucket={k}" for d in state.deltas for k in d["buckets"] if only is None or k in only]

    def _placed(self, folders: Iterable[str], columns: Sequence[str]) -> DataFrame:
        """Columns of the rows in some folders, with their file and place."""
        paths = [f"{self.path}/{f}" for f in sorted(folders)]
        if not paths:
            return self.spark.createDataFrame([], self.schema).select(*columns, F.lit("").alias("_file"), F.lit(0).cast("long").alias("_place"))
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        file = F.regexp_extract(F.col("_metadata.file_path"), "(data/[^/]+/[^/]+/[^/]+)$", 1)
        return rows.select(*columns, file.alias("_file"), (F.col("_metadata.row_index") + 1).alias("_place"))

    def _rows(self, state: _State, only: set[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets."""
        rows = self._placed(self._folders(state, only), self.schema.names)
        gone = [g["folder"] for g in state.gone if only is None or only & set(g["buckets"])]
        if gone:
            marks = self.spark.read.schema("_file string, _part long, bits binary").parquet(*(f"{self.path}/{g}" for g in gone))
            marks = marks.groupBy("_file", "_part").agg(F.bitmap_or_agg("bits").alias("bits"))
            rows = rows.withColumn("_part", F.bitmap_bucket_number("_place")).join(marks, ["_file", "_part"], "left")
            bit = F.bitmap_bit_position("_place")
            byte = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(_place) div 8 as int) + 1, 1)")), 16, 10).cast("int")
            set_ = F.pmod(F.floor(byte / F.pow(F.lit(2), bit % 8)), F.lit(2)) == 1
            rows = rows.where(F.col("bits").isNull() | ~set_)
        return rows.select(*self.schema.names)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the newest version, or of another that is still there."""
        return self._rows(self.state(version))

    def count(self) -> int:
        """Number of rows."""
        return self.read().count()

    # Writing.

    def _write(self, rows: DataFrame, n: int) -> tuple[str, list[int]]:
        """(folder, buckets) of rows that were written by bucket."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.select(*self.schema.names, bucket_of(self.key, n).alias("bucket")).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return folder, sorted(int(x[7:]) for x in self._names(folder) if x.startswith("bucket="))

    def _commit(self, state: _State, base: int) -> None:
        self._store(f"versions/{base + 1}", asdict(state))

    def upsert(self, new: DataFrame, gone: DataFrame | None = None) -> None:
        """Put rows in, or in place of those with their keys, and take out the keys that are gone.

        Of several rows with one key see single().
        """
        base = self.version()
        state = self.state(base)
        new = materialise(single(new.select(self.schema.names), self.key), "upsert")
        keys = new.select(*self.key)
        if gone is not None:
            keys = keys.unionByName(gone.select(*self.key)).distinct()
        keys = materialise(keys, "keys")
        n_new = new.count()
        if not state.rows and not state.deltas:
            return self._fold(new, base, _State(), n_new)
        touched = {r["bucket"] for r in keys.select(bucket_of(self.key, state.buckets).alias("bucket")).distinct().collect()}  # buckets at most
        old, wanted = self._placed(self._folders(state, touched), self.key), _renamed(keys, self.key)
        places = old.join(wanted, _same(old, wanted, self.key), "left_semi").groupBy("_file", F.bitmap_bucket_number("_place").alias("_part"))
        folder = f"gone/{uuid.uuid4().hex}"
        places.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("bits")).write.parquet(f"{self.path}/{folder}")
        state.gone.append({"folder": folder, "buckets": sorted(touched)})
        if n_new:
            folder, buckets = self._write(new, state.buckets)
            state.deltas.append({"folder": folder, "rows": n_new, "buckets": buckets})
        self._commit(state, base)
        if len(state.gone) >= MOST_DELTAS or sum(d["rows"] for d in state.deltas) > MOST_SHARE * state.rows:
            self.compact()

    def compact(self) -> None:
        """Fold upserts into the buckets that they touched; split as many buckets as the rows ask for."""
        base = self.version()
        state = self.state(base)
        self._fold(None, base, state, self.read(base).count())

    def replace(self, rows: DataFrame) -> None:
        """A version of these rows only; of several with one key see single()."""
        rows = materialise(single(rows.select(self.schema.names), self.key), "replace")
        self._fold(rows, self.version(), _State(), rows.count())

    def _fold(self, rows: DataFrame | None, base: int, state: _State, n_rows: int) -> None:
        """Commit rows, or those of a version, without anything to be folded in."""
        n = max(state.buckets, -(-n_rows // self.bucket_rows), 1)
        folders = self._base(state)
        if rows is None:
            touched = {k for part in (state.deltas, state.gone) for d in part for k in d["buckets"]} | splitting(state.buckets, n)
            rows = self._rows(state, touched)
            folders = {k: f for k, f in folders.items() if k not in touched}
        folder, buckets = self._write(rows, n)
        named = f"bases/{uuid.uuid4().hex}"
        self._store(named, folders | {k: f"{folder}/bucket={k}" for k in buckets})
        self._commit(_State(n, named, n_rows), base)

    def vacuum(self, keep: int = 2) -> int:
        """Remove all but the newest versions and the folders that only they name; how many of these."""
        versions = self.versions()
        states = [self.state(v) for v in versions[-keep:]]
        used = {f.split("/")[1] for s in states for f in self._folders(s)} | {g["folder"].split("/")[1] for s in states for g in s.gone} | {s.base.split("/")[-1] for s in states}
        for v in versions[:-keep]:
            fs, p = self._fs(f"versions/{v}")
            fs.delete(p, False)
        gone = [f"{kind}/{n}" for kind in ("data", "gone", "bases") for n in self._names(kind) if n not in used]
        for n in gone:
            fs, p = self._fs(n)
            fs.delete(p, True)
        return len(gone)


def built_once(spark: SparkSession, path: str, build: Callable[[str], object]) -> str:
    """``path``, made by ``build`` unless it is there: built beside it, then renamed, so no reader sees half of it."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs, p = at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at(path)
    if not fs.exists(p):
        beside = at(f"{path}-{uuid.uuid4().hex}")
        build(beside.toString())
        if fs.exists(p) or not fs.rename(beside, p):
            fs.delete(beside, True)  # another was first, and made the same
    return path


def manifest(spark: SparkSession, path: str) -> KeyedTable:
    """What was ingested, by fingerprint."""
    return KeyedTable(spark, path, S.MANIFEST, ["hash"])


def not_ingested(docs: DataFrame, ingested: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    """Documents whose fingerprint the manifest lacks."""
    return docs.join(ingested.select(F.col("hash").alias(hash_col)), hash_col, "left_anti")


def firsts(docs: DataFrame, columns: Sequence[str], hash_col: str = "content_hash") -> DataFrame:
    """One document of equal texts: that whose columns, in their order, are smallest; rows without a fingerprint have no text and are left out."""
    one = docs.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min(F.struct(*columns)).alias("_d"))
    return one.select(hash_col, "_d.*")


def chunk_vectors(spark: SparkSession, path: str) -> KeyedTable:
    """Chunks with their metadata and vectors."""
    return KeyedTable(spark, path, S.CHUNK_VECTORS, ["chunk_id"])


def graph_tables(spark: SparkSession, path: str) -> dict[str, KeyedTable]:
    """The four tables of a graph at ``path``, each by its key."""
    kinds = {"nodes": (S.NODES, ["eid"]), "edges": (S.EDGES, ["src", "rel", "dst"]), "mentions": (S.MENTIONS, ["chunk_id", "eid"]), "chunks": (S.CHUNKS, ["chunk_id"])}
    return {name: KeyedTable(spark, f"{path}/{name}", *kind) for name, kind in kinds.items()}


def write_graph(spark: SparkSession, path: str, g: Graph) -> Graph:
    """Merge a graph into the one at ``path``: nodes by id, edges by their ends and relation (A10)."""
    t = graph_tables(spark, path)
    t["nodes"].upsert(merge_nodes(g.nodes))
    # An edge that is there already keeps its least source.
    edges = materialise(merge_edges(g.edges.select("src", "rel", "dst", "triplet_source_id")).select(S.EDGES.names), "edges")
    known = t["edges"].read().join(edges.select("src", "rel", "dst"), ["src", "rel", "dst"], "left_semi").select(S.EDGES.names)
    t["edges"].upsert(merge_edges(edges.unionByName(known)))
    if g.mentions is not None:
        t["mentions"].upsert(g.mentions.distinct())
    if g.chunks is not None:
        # All chunks of a document are replaced, so a shorter text leaves no stale end.
        stale = t["chunks"].read().join(g.chunks.select("doc_id").distinct(), "doc_id", "left_semi")
        t["chunks"].upsert(g.chunks, stale)
    return read_graph(spark, path)


def read_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(*(t.read() for t in graph_tables(spark, path).values()))


def append_log(records: DataFrame, path: str) -> None:
    """Add decision records as JSON lines."""
    records.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All decision records; blank lines give none."""
    return spark.read.schema(S.DECISION_LOG).json(path).where(F.col("question").isNotNull())


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    """The decision log as a stream, file by file (L1)."""
    return spark.readStream.schema(S.DECISION_LOG).json(path)


def write_results(rows: DataFrame, summary: dict, path: str) -> None:
    """Benchmark rows and their summary."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    rows.sparkSession.createDataFrame([(json.dumps(summary),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary")


def read_results(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, dict]:
    """(rows, summary) of a recorded benchmark."""
    return spark.read.schema(schema).json(f"{path}/rows"), json.loads(spark.read.text(f"{path}/summary").first()["value"])
