"""Document sources: ordered Parquet, strict JSONL, file descriptions and budgeted reads.

Results depend on a total order of documents: files by path components, then rows. A
DataFrame has none, so every source carries ``ord``, from 0 without gaps. Where a file or a block
of lines begins is a small table beside the rows; it is broadcast after a check of its size, so
that no text moves for its number.
"""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path, PurePosixPath
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources import storage
from inkwell.sources.pieces import first_pieces, read_pieces

MANIFEST = "manifest.json"
#: Beginnings that are broadcast, at most: some 100 bytes each. Beyond, Spark picks the join.
MOST_BROADCAST = 1 << 20
#: What Spark's whole-file reader holds in a cell, at most.
CELL_BYTES = (1 << 31) - 1


_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?")


def _parts(path: str) -> tuple[str, ...]:
    """Folders and name of a path, with or without a scheme."""
    return PurePosixPath(_SCHEME.sub("", path)).parts


def source_files(src: str | Path) -> list[str]:
    """The file itself, or a folder's Parquet files at any depth, ordered by path components."""
    if not storage.exists(src):
        raise FileNotFoundError(f"{src} doesn't exist")
    found = [path for path, _ in storage.files(src)]
    if storage.is_folder(src):
        found = [path for path in found if path.endswith(".parquet")]
    if not found:
        raise FileNotFoundError(f"{src} holds no Parquet file")
    return sorted(found, key=_parts)


def _beginnings(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of beginnings, to be joined to rows on all its columns but the last."""
    made = spark.createDataFrame(rows, schema)
    return F.broadcast(made) if len(rows) <= MOST_BROADCAST else made


def read_parquet(spark: SparkSession, *paths: str, key_column: str = "id") -> DataFrame:
    """(ord, text, key): key is the column ``id`` where there is one, else the text. Only these columns are read.

    Rows of files before a row's own are counted from file footers: no column is read for it.
    """
    frame = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(*map(str, paths))
    key = F.col(key_column).cast("string") if key_column in frame.columns else F.col("text")
    rows = frame.select("text", key.alias("key"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    counted = sorted((_parts(unquote(r["__file"])), r["__file"], r["n"]) for r in rows.groupBy("__file").agg(F.count(F.lit(1)).alias("n")).collect())
    if len(counted) < 2:
        return required(rows.select(F.col("__row").alias("ord"), "text", "key"))
    begun, total = [], 0
    for _, file, n in counted:
        begun.append((file, total))
        total += n
    based = rows.join(_beginnings(spark, begun, "__file string, __base long"), "__file")
    return required(based.select((F.col("__base") + F.col("__row")).alias("ord"), "text", "key"))


def read_jsonl(spark: SparkSession, *paths: str) -> DataFrame:
    """(ord, text, key) of JSON lines. A blank or malformed line, or one without a text, fails the query."""
    lines = spark.read.text([str(p) for p in paths]).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__seq"))
    # a block's lines are read in order by one task; lines of earlier blocks are counted per block
    counts = lines.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("n"), F.min("__seq").alias("first")).collect()
    begun, total = [], 0
    for r in sorted(counts, key=lambda r: (_parts(unquote(r["__file"])), r["__block"])):
        begun.append((r["__file"], r["__block"], total - r["first"]))
        total += r["n"]
    placed = lines.join(_beginnings(spark, begun, "__file string, __block long, __base long"), ["__file", "__block"])
    parsed = F.from_json("value", "text string", {"mode": "FAILFAST"})
    text = F.when(F.length(F.trim("value")) == 0, F.raise_error(F.lit("a JSON line is blank"))).otherwise(parsed["text"])
    rows = placed.select((F.col("__base") + F.col("__seq")).alias("ord"), text.alias("text"))
    return required(rows.select("ord", "text", F.col("text").alias("key")))


def read_source(spark: SparkSession, *paths: str) -> DataFrame:
    """(ord, text, key) of JSON lines where the paths end so, else of Parquet."""
    return (read_jsonl if str(paths[0]).endswith(".jsonl") else read_parquet)(spark, *map(str, paths))


def read_within(spark: SparkSession, src: str | Path, budget: int, cost: str = "octet_length(text) + 1") -> DataFrame:
    """(ord, text, key) of the source's first documents whose cost uses the budget up, with the one that crosses it; always the first.

    Row groups, or ranges of JSON lines, are taken in order, 1, 2, 4 and so on at a time, and only lengths are added up, until
    they hold the budget; nothing after them is read. On a file system that isn't mounted, whole files are
    taken so. The cut is a number: no text moves.
    """
    from inkwell.operators.prefix import within_budget

    every = source_files(src) if not str(src).endswith(".jsonl") else [storage.qualified(src)]
    if all(map(storage.is_local, every)):
        taken, before = first_pieces(spark, every, budget, cost)
        bases = _beginnings(spark, list(enumerate(before)), "piece long, __base long")
        docs = required(read_pieces(spark, taken).join(bases, "piece").select((F.col("__base") + F.col("row")).alias("ord"), "text", "key"))
    else:
        taken, spent, step = 0, 0, 1
        while taken < len(every) and (spent < budget or not taken):
            part = every[taken : taken + step]
            spent += read_source(spark, *part).select(F.sum(F.expr(cost))).first()[0] or 0
            taken, step = taken + len(part), step * 2
        docs = read_source(spark, *every[:taken])
    return within_budget(docs.withColumn("__cost", F.expr(cost).cast("long")), "__cost", budget).drop("__cost")


def document(docs: DataFrame, number: int) -> DataFrame:
    """The document with this number, if there is one: a filter that a scan can push down."""
    if number < 0:
        raise ValueError("documents are numbered from 0")
    return docs.where(F.col("ord") == number)


def required(docs: DataFrame) -> DataFrame:
    """Nulls have no meaning in a source: a null text or key fails the query."""
    check = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"a document has no {c}")))
    return docs.select("ord", check("text").alias("text"), check("key").alias("key"))


def _streamed(batches):
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with open(_SCHEME.sub("", path), "rb") as f:
                found = hashlib.file_digest(f, "sha256").hexdigest()
            yield pa.RecordBatch.from_pydict({"path": [path], "sha256": [found]})


def _checksums(spark: SparkSession, found: list[tuple[str, int]]) -> dict[str, str]:
    """From path to SHA-256. A task streams a mounted file of any size; a file on another store is read by Spark, or through the driver if it is too large for a cell."""
    local = [path for path, _ in found if storage.is_local(path)]
    out = {}
    if local:
        tasks = spark.createDataFrame([(path,) for path in local], "path string").repartition(min(len(local), 4 * spark.sparkContext.defaultParallelism))
        out |= {r["path"]: r["sha256"] for r in tasks.mapInArrow(_streamed, "path string, sha256 string").collect()}
    small = [path for path, size in found if path not in out and size <= CELL_BYTES // 2]
    if small:
        read = spark.read.format("binaryFile").load(small).select("path", F.sha2("content", 256).alias("sha256"))
        by_parts = {_parts(r["path"]): r["sha256"] for r in read.collect()}
        out |= {path: by_parts[_parts(path)] for path in small}
    return out | {path: storage.sha256(path) for path, _ in found if path not in out}


def file_checksums(spark: SparkSession, *paths: str) -> DataFrame:
    """(name, bytes, sha256) of files of any size: one row a file."""
    found = sorted({path: size for src in paths for path, size in storage.files(src)}.items(), key=lambda x: _parts(x[0]))
    sums = _checksums(spark, found)
    return spark.createDataFrame([(_parts(path)[-1], size, sums[path]) for path, size in found], "name string, bytes long, sha256 string")


def describe_source(spark: SparkSession, src: str | Path) -> dict:
    """What a manifest says of a source."""
    sizes = dict(storage.files(src))
    found = [(path, sizes[path]) for path in source_files(src)]
    sums = _checksums(spark, found)
    top = len(_parts(storage.qualified(src))) if storage.is_folder(src) else len(_parts(found[0][0])) - 1
    return {"path": str(src), "files": [{"name": "/".join(_parts(path)[top:]), "bytes": size, "sha256": sums[path]} for path, size in found]}


def is_cache(path: str | Path) -> bool:
    return storage.is_file(storage.child(path, MANIFEST))


def manifest(path: str | Path) -> dict:
    return json.loads(storage.read_bytes(storage.child(path, MANIFEST)))
