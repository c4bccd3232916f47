"""Reading and writing tables: sniffed CSV, first sheets of XLSX, SQLite, JDBC, Parquet projects."""

from __future__ import annotations

import json
import re
import sqlite3
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def unique_names(names: list[str]) -> list[str]:
    """Names with blanks filled in and repeats numbered."""
    out: list[str] = []
    for k, name in enumerate(n.strip() or f"column_{i}" for i, n in enumerate(names, 1)):
        base, n = name, 2
        while name in out:
            name, n = f"{base}_{n}", n + 1
        out.append(name)
        del k
    return out


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; the separator is the more frequent of , and ; in the first line."""
    head = spark.read.text(path).limit(1).first()
    line = (head.value if head else "").lstrip("﻿")
    sep = "," if line.count(",") >= line.count(";") else ";"
    df = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True, inferSchema=False, mode="PERMISSIVE")
    return df.toDF(*unique_names([c.lstrip("﻿") for c in df.columns]))


def sheet_rows(path: str) -> Iterator[list[str]]:
    """Rows of the first sheet of an XLSX file as texts; cells in date formats as yyyy-MM-dd HH:mm:ss."""
    with zipfile.ZipFile(path) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{MAIN}t")))
        dated = set()
        if "xl/styles.xml" in names:
            root = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")) for f in root.iter(f"{MAIN}numFmt") if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^]]*\]', "", f.get("formatCode", "")).lower())}
            formats = root.find(f"{MAIN}cellXfs")
            for k, xf in enumerate(formats if formats is not None else []):
                n = int(xf.get("numFmtId", 0))
                if n in own or 14 <= n <= 22 or 45 <= n <= 47:
                    dated.add(k)
        sheet = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        with z.open(sheet) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{MAIN}row":
                    continue
                cells: list[str] = []
                for c in row.iter(f"{MAIN}c"):
                    letters = re.match("[A-Z]+", c.get("r", "")) if c.get("r") else None
                    at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    v, kind = c.find(f"{MAIN}v"), c.get("t")
                    text = "".join(t.text or "" for t in c.iter(f"{MAIN}t")) if kind == "inlineStr" else (v.text or "" if v is not None else "")
                    if kind == "s" and text:
                        text = shared[int(text)]
                    elif kind is None and text and int(c.get("s", 0)) in dated:
                        text = (datetime(1899, 12, 30) + timedelta(days=float(text))).strftime("%Y-%m-%d %H:%M:%S")
                    cells[at] = text
                yield cells
                row.clear()


class _XlsxReader(DataSourceReader):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = sheet_rows(self.path)
        next(rows, None)
        for cells in rows:
            if any(cells):
                yield tuple((cells + [""] * self.width)[: self.width])


class XlsxSource(DataSource):
    """format("xlsx").load(path): the first sheet's columns as text. The file lies where every task can open it."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        return StructType([StructField(n, StringType()) for n in unique_names(next(sheet_rows(self.options["path"]), []))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _XlsxReader(self.options["path"], len(schema.fields))


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.table, self.columns, self.parts = options["path"], options["table"], columns, int(options.get("partitions", 4))

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return []
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            sql = f"SELECT {', '.join(map(quoted, self.columns))} FROM {quoted(self.table)} WHERE rowid BETWEEN ? AND ?"
            for row in db.execute(sql, (partition.low, partition.high)):
                yield tuple(None if v is None else str(v) for v in row)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteSource(DataSource):
    """format("sqlite").option("table", t).load(path): all columns as text, read in ranges of rowid side by side."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            return StructType([StructField(r[1], StringType()) for r in db.execute(f"PRAGMA table_info({quoted(self.options['table'])})")])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(dict(self.options), [f.name for f in schema.fields])


def register(spark: SparkSession) -> None:
    for source in (XlsxSource, SqliteSource):
        spark.dataSource.register(source)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By the file's ending: .xlsx, .parquet, else CSV; .xls is refused."""
    if path.endswith(".xls"):
        raise ValueError("old .xls files are not read; save as .xlsx or CSV")
    if path.endswith(".xlsx"):
        register(spark)
        return spark.read.format("xlsx").load(path)
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_csv(spark, path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A database table; filters, columns and limits are pushed to the database. key and bounds read it in parts."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def save_project(df: DataFrame, path: str, operations: list[dict], pages: dict[str, DataFrame]) -> None:
    """A project folder: data, the list of cleaning operations, and each result page as JSON rows."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    log = df.sparkSession.createDataFrame([(i, json.dumps(o, sort_keys=True)) for i, o in enumerate(operations)], "step int, operation string")
    log.coalesce(1).write.mode("overwrite").json(f"{path}/operations")
    for name, page in pages.items():
        page.write.mode("overwrite").json(f"{path}/pages/{name}")


def load_project(spark: SparkSession, path: str) -> tuple[DataFrame, list[dict]]:
    log = spark.read.schema("step int, operation string").json(f"{path}/operations").orderBy("step").collect()
    return spark.read.parquet(f"{path}/data"), [json.loads(r.operation) for r in log]


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's rows whatever their order: the sum of row hashes, and the number of rows."""
    row = df.agg(F.sum(F.xxhash64(*[F.col(c).cast("string") for c in df.columns]).cast("decimal(38,0)")), F.count("*")).first()
    return f"{int(row[0] or 0) & ((1 << 64) - 1):016x}-{row[1]}"
