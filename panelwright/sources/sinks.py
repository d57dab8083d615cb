"""Publishing results: everything is written beside its place under a name of its own and then moved there.

Frames go through Spark's committer into a staging folder, small values through the driver; paths are any that Hadoop's
file systems know. A reader meets the old content or the new, never a part; on stores whose move is no single step the
time between the old content's going and the new one's coming is as short as two moves.
"""

from __future__ import annotations

import hashlib
import io
import json
import platform
import uuid
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _beside(path: str) -> str:
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/.{name}.{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def _move_in(spark: SparkSession, staged: str, path: str) -> None:
    fs, source = _fs(spark, staged)
    _, target = _fs(spark, path)
    fs.mkdirs(target.getParent())
    _, old = _fs(spark, _beside(path))
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"cannot set aside {path}")
    if not fs.rename(source, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"cannot publish {path}")
    if had:
        fs.delete(old, True)


def publish(df: DataFrame, path: str, kind: str = "parquet", by: Sequence[str] = (), **options: str) -> None:
    """Writes df (parquet, csv, json, orc) to the folder path, in partitions of these columns if any; replaces what is there."""
    spark, staged = df.sparkSession, _beside(path)
    try:
        df.write.options(**options).format(kind).partitionBy(*by).save(staged)
        _move_in(spark, staged, path)
    finally:
        fs, left = _fs(spark, staged)
        fs.delete(left, True)


def publish_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    staged = _beside(path)
    fs, place = _fs(spark, staged)
    try:
        out = fs.create(place, True)
        try:
            for lo in range(0, len(content), 1 << 20):
                out.write(bytearray(content[lo : lo + (1 << 20)]))
        finally:
            out.close()
        _move_in(spark, staged, path)
    finally:
        fs.delete(place, True)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file's content; what may be large is read by executors instead."""
    row = spark.read.format("binaryFile").load(path).select("content").first()
    return bytes(row[0]) if row else b""  # Spark plans no task for an empty file


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    publish_bytes(spark, path, text.encode())


def publish_json(spark: SparkSession, path: str, value: object) -> None:
    publish_text(spark, path, json.dumps(value, indent=2, default=str) + "\n")


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads(read_bytes(spark, path))


def publish_csv(df: DataFrame, path: str) -> None:
    publish(df, path, "csv", header="true")


def publish_arrays(spark: SparkSession, path: str, **arrays: np.ndarray) -> None:
    """Named dense arrays as one compressed archive; larger tensors are published as frames with array columns."""
    held = io.BytesIO()
    np.savez_compressed(held, **arrays)
    publish_bytes(spark, path, held.getvalue())


def read_arrays(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(read_bytes(spark, path)), allow_pickle=False) as held:
        return {name: held[name] for name in held.files}


def copy_file(spark: SparkSession, source: str, path: str) -> None:
    staged = _beside(path)
    (fs, place), (other, target) = _fs(spark, source), _fs(spark, staged)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, place, other, target, False, spark._jsc.hadoopConfiguration())
    _move_in(spark, staged, path)


def remove_generated(spark: SparkSession, root: str, *names: str) -> list[str]:
    """Deletes these folders under root, and nothing else; returns those that were there."""
    gone = []
    for name in names:
        if not name or name.startswith("/") or {"..", "."} & set(name.split("/")) or ":" in name:
            raise ValueError(f"{name!r} is not a folder under {root}")
        fs, place = _fs(spark, f"{root.rstrip('/')}/{name}")
        if fs.delete(place, True):
            gone.append(name)
    return gone


def value_digest(value: object) -> str:
    """sha256 of the value as JSON with sorted keys and no blanks; other types as their text."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """name (below folder), bytes, sha256 of every file below folder, hashed by the executors; files of 2 GB at most."""
    fs, place = _fs(spark, folder)
    base = fs.makeQualified(place).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    plain = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?/*", "/")
    hashed = files.select(F.substring(plain, len(base) + 2, 1 << 20).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    empty, listed = [], fs.listFiles(place, True)
    while listed.hasNext():  # Spark plans no task for an empty file
        one = listed.next()
        name = one.getPath().toUri().getPath()[len(base) + 1 :]
        if not one.getLen() and not name.rpartition("/")[2].startswith((".", "_")):
            empty.append((name, 0, hashlib.sha256(b"").hexdigest()))
    return hashed.unionByName(spark.createDataFrame(empty, "name string, bytes long, sha256 string"))


def row_digests(tables: Mapping[str, DataFrame]) -> DataFrame:
    """output, rows, sha256 for each table: of its rows as lines (fields joined by a bar, null empty) in ascending order, joined by line feeds.

    The lines of a table meet in one aggregate: for small report tables.
    """
    out = None
    for name, df in tables.items():
        line = F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), "|")
        one = df.agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary"), 256).alias("sha256")).select(F.lit(name).alias("output"), "rows", "sha256")
        out = one if out is None else out.unionByName(one)
    return out


def is_cached(spark: SparkSession, path: str, fingerprint: str) -> bool:
    """False where no record is; True where the record has this fingerprint; another one is an error, never overwritten."""
    if not exists(spark, path):
        return False
    found = read_json(spark, path).get("fingerprint")
    if found != fingerprint:
        raise RuntimeError(f"stale cache: {path} was made by {found}, not by {fingerprint}; move it away or publish elsewhere")
    return True


def missing_keys(wanted: DataFrame, built: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The wanted keys that are not built yet."""
    return wanted.select(*keys).distinct().join(built.select(*keys), list(keys), "left_anti")


def build_missing(spark: SparkSession, folder: str, wanted: DataFrame, key: str, build, recipe: object) -> int:
    """Builds and appends the partitions of key that folder lacks, under one recipe; returns how many keys were built.

    build(keys) gives their rows. A folder without a record of its recipe is built anew, one of another recipe is an error.
    """
    record, data = f"{folder.rstrip('/')}/recipe.json", f"{folder.rstrip('/')}/data"
    known = is_cached(spark, record, value_digest(recipe)) and exists(spark, data)
    todo = missing_keys(wanted, spark.read.parquet(data), [key]) if known else wanted.select(key).distinct()
    n = todo.count()
    if known and n:
        build(todo).write.mode("append").partitionBy(key).parquet(data)
    elif not known:
        publish(build(todo), data, by=[key])
        publish_json(spark, record, {"fingerprint": value_digest(recipe), "recipe": recipe})
    return n


def checked_records(jobs: DataFrame, records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """jobs (keys, fingerprint) with state: missing, stale (made by another recipe), corrupt (its output is not the recorded one) or cached.

    records: keys, fingerprint, recorded (the output's hash when it was recorded), found (its hash now).
    """
    had = records.select(*keys, F.col("fingerprint").alias("made_by"), "recorded", "found")
    state = F.when(F.col("made_by").isNull(), "missing").when(F.col("made_by") != F.col("fingerprint"), "stale").when(~F.col("recorded").eqNullSafe(F.col("found")), "corrupt").otherwise("cached")
    return jobs.join(had, list(keys), "left").select(*jobs.columns, state.alias("state"))


def write_manifest(spark: SparkSession, folder: str, inputs: Mapping[str, str], settings: object, validation: object) -> dict:
    """manifest.json in folder: when and by what it was made, the hashes of the inputs and of every output below folder."""
    import datetime as dt

    sums = {r["name"]: r["sha256"] for r in file_digests(spark, folder).where("name <> 'manifest.json'").orderBy("name").toLocalIterator()}
    value = {"made_at": dt.datetime.now(dt.timezone.utc).isoformat(), "inputs": dict(inputs), "settings": settings, "validation": validation, "python": platform.python_version(), "spark": spark.version, "outputs": sums}
    publish_json(spark, f"{folder.rstrip('/')}/manifest.json", value)
    return value
