"""Delimited text, JSON layouts, Parquet, ORC, Feather, plain text, ZIP batches and SQLite.

Paths are anything Spark can read. Whole-file formats (Feather, ZIP, foreign encodings, JSON documents)
are one file per task and are parsed from ``binaryFile`` or whole-text rows inside the task.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from millrace.plans.counting import num

# fixed values: the encodings the CSV reader takes itself
NATIVE_ENCODINGS = {"utf-8", "utf-16", "utf-32", "utf-16be", "utf-16le", "utf-32be", "utf-32le", "iso-8859-1", "us-ascii"}


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8", header: bool = True,
             skiprows: int = 0, nrows: int | None = None, schema=None, infer: bool = True, multiline: bool = False) -> DataFrame:
    """Delimited text. Without a header the columns are ``_c0``, ``_c1`` ...

    ``skiprows`` drops the first lines of every file and, with a header, takes the names from the line after them; files whose header
    lines differ are an error there, as columns go by position. Lines are found by position, so no quoted line breaks
    there. Encodings the reader lacks are decoded in the tasks, file by file. ``multiline`` keeps quoted line breaks, at one task
    per file; those encodings always do.
    """
    enc = encoding.lower().replace("latin-1", "iso-8859-1").replace("latin1", "iso-8859-1").replace("ascii", "us-ascii") \
        if encoding.lower() != "us-ascii" else "us-ascii"
    multiline = multiline or enc not in NATIVE_ENCODINGS
    options = {"sep": sep, "escape": '"', "multiLine": multiline}
    if enc in NATIVE_ENCODINGS and not skiprows:
        reader = spark.read.options(header=header, encoding=enc, **options)
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", infer).csv(path)
    else:
        lines, names = _lines(spark, path, enc, encoding, skiprows, header, multiline)
        if schema:
            ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            parsed = F.from_csv("value", ddl, {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()})
            df = lines.filter(F.trim("value") != "").select(parsed.alias("r")).select("r.*")
        else:
            reader, as_rdd = spark.read.options(header=False, **options), lambda d: d.rdd.map(lambda r: r[0])  # types are inferred from an RDD alone
            heads = [r["value"] for r in names.collect()] if header else []
            if len(heads) > 1:
                raise ValueError(f"files with different headers: {heads[0]!r} and {heads[1]!r}")
            named = reader.csv(as_rdd(names)).first() if heads else None
            df = reader.option("inferSchema", infer).csv(as_rdd(lines))
            if named:
                df = df.toDF(*[n if n is not None else f"_c{i}" for i, n in enumerate(named)])
    return df.limit(nrows) if nrows is not None else df


def read_tsv(spark: SparkSession, path: str, **kw) -> DataFrame:
    return read_csv(spark, path, sep="\t", **kw)


def _lines(spark: SparkSession, path: str, enc: str, encoding: str, skip: int, header: bool, multiline: bool):
    """(data lines, the files' header line, two if they differ), both in a column ``value``. Nothing is written between."""
    ahead = skip + bool(header)
    if enc in NATIVE_ENCODINGS and not multiline:
        lines = (spark.read.option("encoding", enc).text(path)
                 .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id")))
        place = F.row_number().over(W.partitionBy("file").orderBy("id"))
        # the heads of the first blocks alone: a task hands on at most ``ahead`` lines per file it begins
        heads = lines.filter("start = 0").mapInPandas(lambda it: _first_of_each(it, ahead), lines.schema).withColumn("i", place).filter(F.col("i") <= ahead)
        last = heads.groupBy("file").agg(F.max("id").alias("last"))
        data = lines.join(last, "file", "left").filter((F.col("start") > 0) | F.col("last").isNull() | (F.col("id") > F.col("last"))).select("value")
        names = heads.filter(F.col("i") == ahead).select("value").distinct().limit(2)
    else:
        def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for file, content in zip(pdf["path"], pdf["content"]):
                    text = bytes(content).decode(encoding)
                    parts = _records(text) if multiline else text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                    if parts and parts[-1] == "":
                        parts.pop()
                    yield pd.DataFrame({"value": parts, "i": range(1, len(parts) + 1), "file": file})

        rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "value string, i long, file string")
        data, names = rows.filter(F.col("i") > ahead).select("value"), rows.filter(F.col("i") == ahead).select("value").distinct().limit(2)
    return data, names


def _first_of_each(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    seen: dict[str, int] = {}
    for pdf in batches:
        at = pdf.groupby("file").cumcount() + pdf["file"].map(lambda f: seen.get(f, 0))
        for f, k in pdf["file"].value_counts().items():
            seen[f] = seen.get(f, 0) + k
        yield pdf[at < n]


def _records(text: str) -> list[str]:
    """Lines of a text, those within double quotes joined to the line that opened them."""
    out, held = [], ""
    for line in text.replace("\r\n", "\n").split("\n"):
        held = f"{held}\n{line}" if held else line
        if held.count('"') % 2 == 0:
            out.append(held)
            held = ""
    return out + [held] if held else out


def read_json(spark: SparkSession, path: str, orient: str = "records", lines: bool = False, schema=None) -> DataFrame:
    """``lines`` or records documents through the JSON reader; the layouts columns, index, split, values and
    table as whole documents, one task per file. Cells of those come as text unless ``schema`` casts them."""
    reader = spark.read.schema(schema) if schema else spark.read
    if lines:
        return reader.json(path)
    if orient == "records":
        return reader.option("multiLine", True).json(path)
    docs = spark.read.text(path, wholetext=True)
    return from_json_layout(docs.select(F.col("value").alias("doc")), orient, schema)


def from_json_layout(docs: DataFrame, orient: str, schema=None) -> DataFrame:
    """Rows of JSON documents in a column ``doc``."""
    if orient in ("columns", "index"):
        cells = docs.withColumn("_d", F.monotonically_increasing_id()).select(
            "_d", F.explode(F.from_json("doc", "map<string,map<string,string>>")).alias("outer", "inner"))
        cells = cells.select("_d", "outer", F.explode("inner").alias("k", "value"))
        row, col = ("k", "outer") if orient == "columns" else ("outer", "k")
        names = [r[0] for r in cells.select(col).distinct().orderBy(col).collect()]
        out = cells.groupBy("_d", F.col(row).alias("_index")).pivot(col, names).agg(F.first("value")).drop("_d")
    elif orient == "split":
        parsed = docs.select(F.from_json("doc", "columns array<string>, index array<string>, data array<array<string>>").alias("j"))
        # names belong to their document; the frame has the union of them, in order of name
        names = [r[0] for r in parsed.select(F.explode("j.columns").alias("n")).distinct().orderBy("n").collect()]
        rows = parsed.select("j.columns", F.explode(F.arrays_zip(F.col("j.index").alias("i"), F.col("j.data").alias("d"))).alias("r"))
        cells = rows.select(F.col("r.i").alias("_index"), F.map_from_arrays("columns", F.slice("r.d", F.lit(1), F.size("columns"))).alias("m"))
        out = cells.select("_index", *[F.try_element_at("m", F.lit(n)).alias(n) for n in names])
    elif orient == "values":
        rows = docs.select(F.explode(F.from_json("doc", "array<array<string>>")).alias("d"))
        width = rows.agg(F.max(F.size("d"))).first()[0] or 0
        out = rows.select(*[F.get("d", F.lit(i)).alias(f"_c{i}") for i in range(width)])
    elif orient == "table":
        data = docs.select(F.explode(F.from_json("doc", "data array<map<string,string>>")["data"]).alias("m"))
        names = [r[0] for r in data.select(F.explode(F.map_keys("m")).alias("k")).distinct().orderBy("k").collect()]
        out = data.select(*[F.try_element_at("m", F.lit(n)).alias(n) for n in names])
    else:
        raise ValueError(f"unknown orient {orient!r}")
    if schema is None:
        return out
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return out.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    return parse_feather(spark.read.format("binaryFile").load(path))


def parse_feather(files: DataFrame) -> DataFrame:
    """Rows of Arrow IPC files held in a column ``content``; the schema is that of one of the files."""
    def peek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                empty = pa.ipc.open_file(pa.BufferReader(content.as_py())).schema.empty_table()
                sink = io.BytesIO()
                with pa.ipc.new_stream(sink, empty.schema):
                    pass
                yield pa.RecordBatch.from_pydict({"s": [sink.getvalue()]})

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                yield from pa.ipc.open_file(pa.BufferReader(content.as_py())).read_all().to_batches(max_chunksize=10_000)

    from pyspark.sql.pandas.types import from_arrow_schema
    one = files.select("content").limit(1).mapInArrow(peek, "s binary").first()["s"]
    schema = from_arrow_schema(pa.ipc.open_stream(pa.BufferReader(one)).schema, prefer_timestamp_ntz=True)
    return files.select("content").mapInArrow(load, schema)


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    return unzip(spark.read.format("binaryFile").load(path))


def unzip(archives: DataFrame) -> DataFrame:
    """(archive, member, ordinal, payload) from (path, content); folders and ``__MACOSX`` are left out."""
    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    names = [n for n in z.namelist() if not n.endswith("/") and not n.startswith("__MACOSX")]
                    for i, name in enumerate(names):  # one member in memory at a time
                        yield pd.DataFrame({"archive": [path], "member": [name], "ordinal": [i], "payload": [z.read(name)]})

    return archives.select("path", "content").mapInPandas(members, "archive string, member string, ordinal int, payload binary")


def zip_csv(members: DataFrame, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """Rows of the CSV members with their ``archive`` and ``member``, parsed by the engine line by line."""
    lines = (members.filter(F.lower("member").endswith(".csv"))
             .select("archive", "member", F.posexplode(F.split(F.col("payload").cast("string"), "\r?\n")).alias("i", "line"))
             .filter((F.col("i") >= (1 if header else 0)) & (F.col("line") != "")))
    return lines.select("archive", "member", F.from_csv("line", schema, {"sep": sep}).alias("r")).select("archive", "member", "r.*")


def zip_json(members: DataFrame, schema: str) -> DataFrame:
    rows = F.from_json(F.col("payload").cast("string"), f"array<struct<{schema}>>")
    return (members.filter(F.lower("member").endswith(".json")).select("archive", "member", F.explode(rows).alias("r"))
            .select("archive", "member", "r.*"))


def zip_text(members: DataFrame) -> DataFrame:
    return members.filter(F.lower("member").endswith(".txt")).select("archive", "member", F.col("payload").cast("string").alias("text"))


def read_sqlite(spark: SparkSession, path: str, table: str = "", partitions: int = 8) -> DataFrame:
    """A table of a SQLite file on storage every worker sees; an empty name is the first table.

    Tasks read disjoint rowid ranges.
    """
    from millrace.sources.sqlite import SqliteSource
    spark.dataSource.register(SqliteSource)
    return (spark.read.format("millrace_sqlite").option("path", path).option("table", table)
            .option("partitions", str(partitions)).load())


# after loading ----------------------------------------------------------------------------------------

def use_columns(df: DataFrame, cols: list[str | int]) -> DataFrame:
    """By name or position; unknown ones are ignored, and nothing known keeps everything."""
    names = [df.columns[c] if isinstance(c, int) and -len(df.columns) <= c < len(df.columns) else c for c in cols]
    known = [c for c in dict.fromkeys(names) if c in df.columns]
    return df.select(*known) if known else df


def parse_dates(df: DataFrame) -> DataFrame:
    """A text column becomes a timestamp iff every value parses. One aggregate over all text columns."""
    text = [c for c, t in df.dtypes if t == "string"]
    if not text:
        return df
    row = df.agg(*[a for i, c in enumerate(text) for a in (
        F.count(c).alias(f"n{i}"), F.count(F.col(c).try_cast("timestamp_ntz")).alias(f"k{i}"))]).first()
    good = [c for i, c in enumerate(text) if row[f"n{i}"] and row[f"n{i}"] == row[f"k{i}"]]
    return df.withColumns({c: F.col(c).try_cast("timestamp_ntz") for c in good})


def read_series(spark: SparkSession, path: str, **kw) -> DataFrame:
    """CSV with its time column parsed; the time stays an ordinary column."""
    return parse_dates(read_csv(spark, path, infer=kw.pop("infer", False), **kw))


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """A Bernoulli sample, or exactly round(f·n) rows in hash order when unique ``keys`` are given."""
    if not keys:
        return df.sample(fraction=fraction, seed=seed)
    from millrace.plans.hashing import kth_smallest, within_cutoff
    k = round(fraction * df.count())
    return df.filter(within_cutoff(keys, seed, kth_smallest(df, keys, seed, {None: k})))


def shape(df: DataFrame) -> DataFrame:
    """(rows, columns)"""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def text_preview(df: DataFrame, col: str = "text", length: int = 500) -> DataFrame:
    return df.withColumn(col, F.substring(col, 1, length))


def guarded_preview(df: DataFrame, keys: list[str], threshold: int = 100_000, target: int = 10_000, seed: int = 42) -> DataFrame:
    """The frame itself up to ``threshold`` rows, else about ``target`` of them by hash."""
    from millrace.plans.hashing import hash_unit
    n = df.count()
    return df if n <= threshold else df.filter(hash_unit(keys, seed) < target / n)


def concat_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """Union by name, absent columns null, with the ``source`` of each row."""
    out = None
    for name, df in frames.items():
        one = df.withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def nan_to_null(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({c: num(c).cast(kinds[c]) for c, t in df.dtypes if t in ("double", "float")})

