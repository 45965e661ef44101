"""Readers and writers of files."""

from __future__ import annotations

import csv
import gzip
import hashlib
import io
import json
import os
import urllib.request
from collections.abc import Iterable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType | str | None = None, strict: bool = True) -> DataFrame:
    """JSON lines, also compressed; blank lines are skipped. Strict: a bad line is an error; else bad lines and non-objects are dropped."""
    r = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return (r.schema(schema) if schema is not None else r).json(paths)


def read_json_container(spark: SparkSession, path: str, element: T.StructType, keys: Iterable[str] = ("data", "samples", "items")) -> DataFrame:
    """Elements of a JSON file that is a list, or an object with the list under the first of the keys that it has."""
    raw = spark.read.option("wholetext", True).text(path)
    arr = T.ArrayType(element)
    as_list = F.when(F.ltrim("value").startswith("["), F.from_json("value", arr))
    obj = F.from_json("value", T.StructType([T.StructField(k, arr) for k in keys]))
    return raw.select(F.explode(F.coalesce(as_list, *[obj[k] for k in keys])).alias("e")).select("e.*")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """CSV with a header line; quotes are doubled inside fields, which may hold line breaks."""
    r = spark.read.options(header=True, multiLine=True, escape='"', **options)
    return (r.schema(schema) if schema is not None else r).csv(path)


def read_splits(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet", column: str = "source_split", rename: dict[str, str] | None = None) -> DataFrame:
    """Files of several splits as one frame with the split's name; columns that a file lacks are null there."""
    out = None
    for split, path in paths.items():
        d = spark.read.format(fmt).load(path).withColumnsRenamed(rename or {}).withColumn(column, F.lit(split))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def read_many(spark: SparkSession, paths: list[str], fmt: str = "parquet", most: int | None = None, order: Column | None = None) -> DataFrame:
    """Files of one kind as one frame; with ``most`` only so many rows, the first in the given order (a seeded hash for a sample)."""
    d = spark.read.format(fmt).load(paths)
    if most is None:
        return d
    return (d.orderBy(order) if order is not None else d).limit(most)


def first_readable(*readers) -> DataFrame:
    """The frame of the first reader that doesn't fail; the last error is raised. Readers should touch their source (its schema)."""
    error: Exception | None = None
    for r in readers:
        try:
            return r()
        except Exception as e:
            error = e
    raise error or ValueError("no reader")


def cached_copy(spark: SparkSession, url: str, folder: str | None = None, refresh: bool = False) -> str:
    """The path of a copy of a file in a folder that all machines see (the shared folder unless given); a file that is there already isn't fetched again.

    Any URL that urllib can open, or a path of Spark's file systems, which is copied as it is. The copy is complete or absent.
    """
    from ..storage import shared_dir

    base = (folder or f"{shared_dir(spark)}/cache").rstrip("/")
    ending = os.path.splitext(url.split("?")[0])[1] if not url.split("?")[0].endswith(".gz") else "".join(("." + x) for x in os.path.basename(url.split("?")[0]).split(".")[1:])
    target = f"{base}/{hashlib.sha256(url.encode()).hexdigest()[:32]}{ending}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path, temp = jvm.org.apache.hadoop.fs.Path(target), jvm.org.apache.hadoop.fs.Path(target + ".part")
    fs = path.getFileSystem(conf)
    if fs.exists(path) and not refresh:
        return target
    if url.split(":")[0] in ("http", "https", "ftp", "data"):
        out = fs.create(temp, True)
        with urllib.request.urlopen(url, timeout=120) as r:
            while block := r.read(1 << 22):
                out.write(bytearray(block))
        out.close()
    else:
        source = jvm.org.apache.hadoop.fs.Path(url)
        jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, fs, temp, False, conf)
    fs.delete(path, False)
    fs.rename(temp, path)
    return target


def read_url(spark: SparkSession, url: str, fmt: str, schema: T.StructType | str | None = None, most: int | None = None, folder: str | None = None) -> DataFrame:
    """CSV ("csv") or JSON lines ("jsonl") behind a URL: fetched once into the shared folder, then read by the executors. ``most``: only the first rows."""
    path = cached_copy(spark, url, folder)
    d = read_csv(spark, path, schema) if fmt == "csv" else read_jsonl(spark, path, schema)
    return d if most is None else d.limit(most)


def read_projected(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, drop: list[str] = (), flags: dict[str, str] | None = None, fmt: str = "parquet") -> DataFrame:
    """Only the given columns (all but ``drop`` unless given) and, for each flag, whether a column isn't null. The scan reads no others."""
    d = spark.read.format(fmt).load(paths)
    kept = [c for c in (columns or d.columns) if c not in drop]
    return d.select(*kept, *[F.col(c).isNotNull().alias(name) for name, c in (flags or {}).items()])


def read_first_wins(spark: SparkSession, paths: list[str], keys: list[str], fmt: str = "json", schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of several files, of those with equal keys the one of the first file in the list (in a file the first by content). Nulls equal nulls."""
    r = spark.read.format(fmt)
    r = r.schema(schema) if schema is not None else r
    rows = None
    for k, p in enumerate(paths):
        d = r.load(p).withColumn("__file", F.lit(k))
        rows = d if rows is None else rows.unionByName(d, allowMissingColumns=True)
    from ..operators.duplicates import keep_first

    return keep_first(rows, keys, "__file").drop("__file")


def tolerant_jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """The objects among the lines, and one row with the numbers of lines, of objects and of lines dropped (blank lines aside)."""
    lines = spark.read.text(paths).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").isNotNull().alias("ok"))
    good = F.col("ok") & F.ltrim("value").startswith("{")
    counts = parsed.agg(F.count("*").alias("lines"), F.coalesce(F.sum(good.cast("long")), F.lit(0)).alias("objects"))
    return parsed.filter(good).select("r.*"), counts.withColumn("dropped", F.col("lines") - F.col("objects"))


def inspect_gzip(path, rows: int | None = None, sha256: str | None = None) -> dict:
    """Rows, bytes and SHA-256 of a compressed JSON-lines file's content, read in blocks; a line that isn't JSON is an error, and so are other rows or another hash than expected.

    A gzip stream can only be read from its start, by one reader; many files are inspected side by side by ``inspect_gzips``.
    """
    digest, size, n = hashlib.sha256(), 0, 0
    with gzip.open(path, "rb") as f:
        for line in f:
            digest.update(line)
            size += len(line)
            if line.strip():
                json.loads(line)
                n += 1
    if rows is not None and n != rows:
        raise ValueError(f"{path} has {n} rows, {rows} were expected")
    if sha256 is not None and digest.hexdigest() != sha256:
        raise ValueError(f"{path} has another content than expected")
    return {"rows": n, "bytes": size, "sha256": digest.hexdigest()}


def _local(path: str) -> str | None:
    """The path of a file of a mounted file system; None for other file systems."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return path if "://" not in path else None


def _opened(paths: list[str], spark: SparkSession) -> DataFrame:
    """(path, content) with one task per file; the content is null for files that tasks open themselves, block by block, and given for those of other file systems."""
    if all(_local(p) for p in paths):
        return spark.createDataFrame([(p, None) for p in paths], "path string, content binary").repartition(max(1, len(paths)))
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def inspect_gzips(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, rows, bytes, sha256, error) of each file in a folder that all machines see, one task per file; a file that can't be read has its error instead."""

    def run(batches):
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    got = inspect_gzip(_local(p) if content is None else io.BytesIO(content))
                    out.append((p, got["rows"], got["bytes"], got["sha256"], None))
                except Exception as e:
                    out.append((p, None, None, None, type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "rows", "bytes", "sha256", "error"]).astype({"rows": "Int64", "bytes": "Int64"})

    return _opened(paths, spark).mapInPandas(run, "path string, rows long, bytes long, sha256 string, error string")


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, bytes and SHA-256 of files as they are, one task per file, read in blocks (files of other file systems than mounted ones whole, up to 2 GB)."""

    def run(batches):
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                digest, size = hashlib.sha256(), 0
                with open(_local(p), "rb") if content is None else io.BytesIO(content) as f:
                    while block := f.read(1 << 22):
                        digest.update(block)
                        size += len(block)
                out.append((p, size, digest.hexdigest()))
            yield pd.DataFrame(out, columns=["path", "bytes", "sha256"])

    return _opened([paths] if isinstance(paths, str) else paths, spark).mapInPandas(run, "path string, bytes long, sha256 string")


def line_digests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row: lines and an order-free digest of text files (the sum of line hashes), for comparing copies of any size."""
    h = F.conv(F.substring(F.sha2("value", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return spark.read.text(paths).agg(F.count("*").alias("lines"), F.sum(h).cast("string").alias("digest"))


#: Elements whose text isn't shown (fixed values).
HIDDEN = frozenset(("script", "style", "template", "noscript"))


def html_lines(html: str | None) -> list[str]:
    """The non-blank texts of a page, stripped, in order; scripts and styles aren't texts."""
    hidden, texts = 0, []
    parser = HTMLParser()

    def opened(tag, attrs):
        nonlocal hidden
        hidden += tag in HIDDEN

    def closed(tag):
        nonlocal hidden
        hidden -= tag in HIDDEN and hidden > 0

    parser.handle_starttag, parser.handle_endtag = opened, closed
    parser.handle_startendtag = lambda tag, attrs: None
    parser.handle_data = lambda data: hidden or texts.append(data.strip())
    parser.feed(html or "")
    parser.close()
    return [t for t in texts if t]


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_text(s: pd.Series) -> pd.Series:
    return s.map(html_lines)


def html_chunks(df: DataFrame, key: str, html: str, marker: str, before: int = 1, after: int = 12, least: int = 500, prefix: int = 1000, tier: str = r"(?i)tier\s*(\d+)") -> DataFrame:
    """(key, position, tier, text): windows of lines around each line with the marker, of ``least`` characters at least, without repeats of the first ``prefix`` characters.

    An explode and a drop of duplicates; only the parsing of HTML runs in Python.
    """
    d = df.select(F.col(key).alias("key"), html_text(html).alias("ls"))
    d = d.select("key", "ls", F.posexplode("ls").alias("position", "line")).filter(F.col("line").contains(marker))
    lo = F.greatest(F.lit(0), F.col("position") - before)
    text = F.array_join(F.slice("ls", lo + 1, F.col("position") - lo + 1 + after), "\n")
    d = d.select("key", "position", text.alias("text")).filter(F.length("text") >= least)
    first = d.groupBy(F.substring("text", 1, prefix).alias("p")).agg(F.min(F.struct("key", "position", "text")).alias("r"))
    return first.select(F.col("r.key").alias(key), "r.position", F.nullif(F.regexp_extract("r.text", tier, 1), F.lit("")).alias("tier"), "r.text")


# writers -------------------------------------------------------------------------------------------------------------


def write_jsonl(df: DataFrame, path: str, compression: str | None = None, files: int | None = None, split: str | None = None, order: list[str] | None = None) -> None:
    """Compact JSON lines; the job's commit makes the folder complete or absent. ``files=1`` gives a single file, for small results.

    With ``split`` and ``order`` each row gets source_split and its place in that order, reader_source_index.
    """
    d = df
    if split is not None:
        from ..operators.batch import with_index

        d = with_index(d, *order).withColumnRenamed("row_index", "reader_source_index").withColumn("source_split", F.lit(split))
    d = d if files is None else d.coalesce(files)
    d.write.option("ignoreNullFields", False).options(**({"compression": compression} if compression else {})).mode("errorifexists").json(path)


def write_parquet(df: DataFrame, path: str, rows: int | None = None, compression: str = "zstd") -> int:
    """Zstandard Parquet; the number of written rows, counted while writing, must be ``rows`` if given."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", compression).mode("errorifexists").parquet(path)
    n = seen.get["n"]
    if rows is not None and n != rows:
        raise ValueError(f"{n} rows written to {path}, {rows} expected")
    return n


def write_routed(df: DataFrame, base: str, routes: dict[str, Column], fmt: str = "parquet") -> None:
    """One folder per route under ``base``; routes may overlap. The frame is staged once, not computed per route."""
    from ..storage import staged

    d = staged(df, "routed")
    for name, cond in routes.items():
        d.filter(F.coalesce(cond, F.lit(False))).write.format(fmt).mode("errorifexists").save(f"{base}/{name}")


def append_csv(df: DataFrame, path: str) -> None:
    """A part file with a header per call; ``read_csv`` reads the folder as one table."""
    df.write.mode("append").option("header", True).option("escape", '"').csv(path)


def append_line(path: str, row: dict) -> None:
    """One line of telemetry at the end of a single CSV file of the driver, with a header where the file is new."""
    new = not os.path.exists(path)
    with open(path, "a", encoding="utf-8", newline="") as f:
        w = csv.DictWriter(f, list(row))
        if new:
            w.writeheader()
        w.writerow(row)
        f.flush()
        os.fsync(f.fileno())


def write_json(path: str, payload) -> None:
    """A small driver-side JSON file, whole or not at all."""
    write_text(path, json.dumps(payload, ensure_ascii=False, indent=2) + "\n")


def write_text(path: str, text: str) -> None:
    temp = path + ".tmp"
    with open(temp, "w", encoding="utf-8", newline="\n") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)


def gzip_bytes(data: bytes) -> bytes:
    """The same bytes for the same content: no time, no name."""
    out = io.BytesIO()
    with gzip.GzipFile(filename="", mode="wb", fileobj=out, mtime=0) as f:
        f.write(data)
    return out.getvalue()


def write_gzip(path: str, lines: Iterable[str], level: int = 9) -> dict:
    """Lines as a gzip file with neither time nor name, so that equal lines give equal files; rows, bytes and SHA-256 of the content. Written as the lines come, whole or not at all."""
    digest, size, rows, temp = hashlib.sha256(), 0, 0, path + ".tmp"
    with open(temp, "wb") as raw, gzip.GzipFile(filename="", mode="wb", compresslevel=level, fileobj=raw, mtime=0) as f:
        for line in lines:
            data = (line + "\n").encode("utf-8")
            digest.update(data)
            f.write(data)
            size, rows = size + len(data), rows + 1
    os.replace(temp, path)
    return {"rows": rows, "bytes": size, "sha256": digest.hexdigest()}


def unpack_gzip(source: str, target: str) -> None:
    """Unpack a file; an existing target is an error."""
    with gzip.open(source, "rb") as f, open(target, "xb") as g:
        while block := f.read(1 << 20):
            g.write(block)


def preview(df: DataFrame, group: str, order: str, k: int, columns: list[str]) -> str:
    """Markdown of the first k rows of each group: a report of a bounded size for a bounded number of groups."""
    from ..operators.partition import top_per_group

    rows = top_per_group(df.select(group, order, *columns), [group], [F.col(order)], k).orderBy(group, "position").collect()
    out, last = [], object()
    for r in rows:
        if r[group] != last:
            out.append(f"## {r[group]}\n")
            last = r[group]
        out.append("\n".join(f"- **{c}**: {r[c]}" for c in columns) + "\n")
    return "\n".join(out)
