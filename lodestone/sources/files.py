"""Sources and sinks: files, key-value tables, vector tables, wire formats."""

from __future__ import annotations

import contextlib
import re
import struct
import tempfile
import uuid

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ignore_rules(lines: list[str]) -> list[tuple[str, bool, bool]]:
    """(regular expression, only folders?, kept again?) of an ignore file's lines: comments, !, /, *, ?, ** and a last / as Git reads them. A folder's name ends with a /; what lies in it has names of its own."""
    out = []
    for line in lines:
        rule = line.rstrip("\n").rstrip()
        if not rule or rule.startswith("#"):
            continue
        again, rule = rule.startswith("!"), rule.removeprefix("!")
        folder, rule = rule.endswith("/"), rule.rstrip("/")
        anchored = "/" in rule
        body, i = "", 0
        rule = rule.lstrip("/")
        while i < len(rule):
            if rule.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
            elif rule.startswith("**", i):
                body, i = body + (".+" if body.endswith("/") and i + 2 == len(rule) else ".*"), i + 2
            else:
                whole = rule[i] == "*" and rule[i - 1 : i] in ("", "/") and rule[i + 1 : i + 2] in ("", "/")  # a name has a letter at least
                body += {"*": "[^/]+" if whole else "[^/]*", "?": "[^/]"}.get(rule[i], re.escape(rule[i]))
                i += 1
        out.append((f"^{'' if anchored else '(?:.*/)?'}{body}{'/' if folder else '/?'}$", folder, again))
    return out


def scan(spark: SparkSession, path: str, extensions: list[str] | None = None, hidden: bool = False, ignored: list[str] | None = None, ignore_file: str | None = ".gitignore") -> DataFrame:
    """(path, content, length, modificationTime) of all files below a folder, by extension, without hidden or ignored ones.

    Every folder's ignore file counts for what is below it. Of all rules that fit a path those of the deepest folder
    decide, and of one folder's the last; but what lies in an ignored folder can't be kept again. ignored: lines that
    come after those of the top folder's own file.
    """
    root = path.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    below = F.substring_index("path", root + "/", -1)
    wanted = files
    if extensions:
        wanted = wanted.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower() for e in extensions]))
    if not hidden:
        wanted = wanted.where(~below.rlike(r"(^|/)\."))
    names = wanted.select("path", below.alias("_name"))
    rules = _rules(names, root, ignore_file, ignored)
    if rules is None:
        return wanted
    gone = _ignored(names, rules).withColumn("_gone", F.lit(True))
    return wanted.join(gone, "path", "left").where("_gone is null").drop("_gone")


RULES = "depth int, place int, regex string, again boolean, folder string"


def _rules(names: DataFrame, root: str, ignore_file: str | None, ignored: list[str] | None) -> DataFrame | None:
    """(depth, place, regex, again, folder) of every rule of all ignore files, a row each; None if there can't be any.

    Spark's listings leave out names with a leading dot, so tasks open the ignore file of each folder that holds a file.
    """
    own = [(0, 1 << 20 | i, regex, again, "") for i, (regex, _, again) in enumerate(ignore_rules(ignored or []))]
    out = names.sparkSession.createDataFrame(own, RULES) if own else None
    if ignore_file:

        @F.pandas_udf("array<struct<place:int,regex:string,again:boolean>>")
        def rules_of(folders: pd.Series) -> pd.Series:
            return folders.map(lambda folder: [(i, regex, again) for i, (regex, _, again) in enumerate(ignore_rules(_lines(f"{root}/{folder}{ignore_file}")))])

        steps = F.split("_name", "/")
        prefixes = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, 1, n), "/"), F.lit("/"))))
        found = names.select(F.explode(prefixes).alias("folder")).distinct().select("folder", F.explode(rules_of("folder")).alias("r"))
        found = found.select((F.size(F.split("folder", "/")) - 1).cast("int").alias("depth"), "r.place", "r.regex", "r.again", "folder")
        out = found if out is None else found.unionByName(out)
    return out


def _lines(path: str) -> list[str]:
    """The lines of a small file, none if there is no such file."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    if store.get_file_info(place).type != fs.FileType.File:
        return []
    with store.open_input_file(place) as f:
        return f.read().decode(errors="replace").splitlines()


def _ignored(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(path) of the ignored ones of (path, _name): each name, and each folder it lies in, meets the rules of the folders above by an equal join on their names."""
    steps = F.split("_name", "/")
    # Every prefix of a name, a folder's with its last /, is judged; every folder above it may hold rules.
    judged = names.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(n.alias("n"), F.concat(F.array_join(F.slice(steps, 1, n), "/"), F.when(n < F.size(steps), F.lit("/")).otherwise(F.lit(""))).alias("part")))).alias("j"))
    judged = judged.select("path", "j.n", "j.part")
    parts = F.split("part", "/")
    above = judged.select("path", "n", "part", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda d: F.when(d == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, d), "/"), F.lit("/"))))).alias("folder"))
    met = above.join(rules, "folder").where(F.rlike(F.expr("substring(part, length(folder) + 1)"), F.col("regex")))
    last = met.groupBy("path", "n").agg(F.max_by("again", F.struct("depth", "place")).alias("again"))
    return last.where(~F.col("again")).select("path").distinct()


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def shared(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share (spark.checkpoint.dir), which goes when the application ends; a local session without one has a temporary folder."""
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        held = tempfile.mkdtemp(prefix="lodestone-")
    path = f"{held.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    fs, place = _fs(spark, path)
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    return path


def written(rows: DataFrame, folder: str, name: str) -> DataFrame:
    """A table written to a folder and read again, so that what follows doesn't compute it anew."""
    rows.write.mode("overwrite").parquet(f"{folder}/{name}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{name}")


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if it isn't there."""
    fs, place = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []


def claimed(spark: SparkSession, path: str) -> bool:
    """Whether this call made the file: of several callers one does."""
    fs, place = _fs(spark, path)
    if fs.exists(place):
        return False
    try:
        fs.create(place, False).close()
    except Py4JJavaError as e:
        if fs.exists(place):
            return False
        raise e
    return True


@contextlib.contextmanager
def locked(spark: SparkSession, path: str):
    """One holder of a file at a time; where a holder died, the file has to be removed by hand."""
    if not claimed(spark, path):
        raise RuntimeError(f"another writer holds {path}")
    try:
        yield
    finally:
        fs, place = _fs(spark, path)
        fs.delete(place, False)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, place = _fs(spark, new)
    fs.mkdirs(place.getParent())
    if fs.exists(place) or not fs.rename(_fs(spark, old)[1], place):
        raise RuntimeError(f"can't rename {old} to {new}")


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _fs(spark, path)
    fs.delete(place, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, place = _fs(spark, path)
    out = fs.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    return "\n".join(r.value for r in spark.read.text(path).collect())


def stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A throttled stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """All collections' vectors: the last generation of each (collection, cid, chunk_index)."""
    rows = spark.read.parquet(path)
    w = Window.partitionBy("collection", "cid", "chunk_index").orderBy(F.desc("generation"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "generation")


def upsert_vectors(rows: DataFrame, path: str) -> int:
    """Writes vectors by collection, one of each (cid, chunk_index), as a generation that stands in for the rows held before; returns its number. Writers at one time each claim their own."""
    spark = rows.sparkSession
    held = [int(n.split("=")[1]) for n in names(spark, path) if "=" in n] + [int(n) for n in names(spark, f"{path}/_claims")]
    number = max(held, default=-1) + 1
    while not claimed(spark, f"{path}/_claims/{number}"):
        number += 1
    rows.dropDuplicates(["collection", "cid", "chunk_index"]).write.partitionBy("collection").parquet(f"{path}/generation={number}")
    return number


def collections(vectors: DataFrame) -> DataFrame:
    return vectors.select("collection").distinct().where(F.col("collection").like("space-%-idx"))


def _head(kind: int, n: int) -> bytes:
    if n < 24:
        return bytes([kind << 5 | n])
    for code, form in ((24, ">B"), (25, ">H"), (26, ">I"), (27, ">Q")):
        if n < 1 << (8 * struct.calcsize(form)):
            return bytes([kind << 5 | code]) + struct.pack(form, n)
    raise ValueError("number too large")


def cbor_encode(value) -> bytes:
    """Deterministic CBOR: map keys by length, then bytes."""
    if value is None or value is True or value is False:
        return {None: b"\xf6", True: b"\xf5", False: b"\xf4"}[value]
    if isinstance(value, int):
        return _head(0, value) if value >= 0 else _head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, bytes):
        return _head(2, len(value)) + value
    if isinstance(value, str):
        raw = value.encode()
        return _head(3, len(raw)) + raw
    if isinstance(value, list | tuple):
        return _head(4, len(value)) + b"".join(map(cbor_encode, value))
    items = sorted(((k.encode(), v) for k, v in value.items()), key=lambda kv: (len(kv[0]), kv[0]))
    return _head(5, len(items)) + b"".join(_head(3, len(k)) + k + cbor_encode(v) for k, v in items)


def cbor_decode(data: bytes):
    value, end = _item(data, 0)
    if end != len(data):
        raise ValueError("bytes after the value")
    return value


def _item(data: bytes, at: int):
    kind, info = data[at] >> 5, data[at] & 31
    at += 1
    if kind == 7:
        if info in (20, 21, 22, 23):
            return {20: False, 21: True}.get(info), at
        form = {25: ">e", 26: ">f", 27: ">d"}[info]
        return struct.unpack_from(form, data, at)[0], at + struct.calcsize(form)
    n = info
    if info >= 24:
        form = {24: ">B", 25: ">H", 26: ">I", 27: ">Q"}[info]
        n = struct.unpack_from(form, data, at)[0]
        at += struct.calcsize(form)
    if kind == 0:
        return n, at
    if kind == 1:
        return -1 - n, at
    if kind in (2, 3):
        if at + n > len(data):
            raise ValueError("short value")
        raw = data[at : at + n]
        return (raw.decode() if kind == 3 else raw), at + n
    if kind == 4:
        out = []
        for _ in range(n):
            value, at = _item(data, at)
            out.append(value)
        return out, at
    if kind == 5:
        held = {}
        for _ in range(n):
            key, at = _item(data, at)
            held[key], at = _item(data, at)
        return held, at
    return _item(data, at)


def frames(data: bytes, most: int = 16 << 20) -> list[bytes]:
    """The bodies of length-prefixed frames (four bytes, big-endian); empty and oversized ones are errors."""
    out, at = [], 0
    while at < len(data):
        n = struct.unpack_from(">I", data, at)[0]
        if not 0 < n <= most or at + 4 + n > len(data):
            raise ValueError(f"bad frame of {n} bytes")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


@F.pandas_udf(T.StringType())
def decode_message(raw: pd.Series) -> pd.Series:
    """JSON text of a JSON or CBOR message, told apart by its first byte; null if it is neither."""
    import json

    def one(b):
        try:
            return json.dumps(json.loads(b) if b[:1] == b"{" else cbor_decode(b), sort_keys=True, separators=(",", ":"))
        except (ValueError, KeyError, IndexError, struct.error, TypeError):
            return None

    return raw.map(one, na_action="ignore")
