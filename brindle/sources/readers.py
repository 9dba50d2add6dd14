"""Files to DataFrames of text columns (or typed ones, for Parquet), by suffix."""

from __future__ import annotations

import csv
import os
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..operators.predicates import col

SUFFIXES = (".csv", ".tsv", ".txt", ".parquet", ".jsonl", ".ndjson", ".xlsx", ".xls")
SNIFF_BYTES = 1 << 16
CORRUPT = "_corrupt_line_"


def head(spark: SparkSession, path: str, size: int = SNIFF_BYTES) -> bytes:
    """The first bytes of a file in any store that Spark reads."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read(size)
    jvm, at = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def encoding_of(raw: bytes) -> str:
    """A byte-order mark decides; else UTF-8 if it decodes, else Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if raw.startswith(mark):
            return name
    for cut in range(4):  # a letter may be cut at the end
        try:
            raw[: len(raw) - cut].decode("utf-8")
            return "UTF-8"
        except UnicodeDecodeError:
            continue
    return "ISO-8859-1"


def delimiter_of(raw: bytes, encoding: str, path: str = "") -> str:
    if path.lower().endswith(".tsv"):
        return "\t"
    try:
        return csv.Sniffer().sniff(raw.decode(encoding, "replace"), delimiters=",\t|;").delimiter
    except csv.Error:
        return ","


def _names(header: list[str | None]) -> list[str]:
    out: list[str] = []
    for j, h in enumerate(header):
        name = (h or "").strip().lstrip("﻿") or f"col_{j}"
        k, base = 2, name
        while name in out:
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return out


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None, header_row: int = 0) -> DataFrame:
    """All columns as text. Rows before a later header row are data, as is all that follows; short rows are filled with nulls."""
    raw = head(spark, path)
    encoding = encoding or encoding_of(raw)
    sep = delimiter or delimiter_of(raw, encoding, path)
    lines = list(csv.reader(raw.decode(encoding, "replace").lstrip("﻿").splitlines(keepends=True)[: header_row + 50], delimiter=sep))
    if len(lines) <= header_row:
        raise QueryError("EMPTY_FILE", path)
    names = _names(lines[header_row])
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    reader = spark.read.schema(schema).option("sep", sep).option("encoding", encoding).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("enforceSchema", True)
    if header_row == 0:
        return reader.option("header", True).csv(path).toDF(*names)
    from ..operators.rows import ROW_ID, with_row_ids

    numbered = with_row_ids(reader.option("header", False).csv(path))
    return numbered.where(col(ROW_ID) != header_row + 1).drop(ROW_ID).toDF(*names)


def read_jsonl(spark: SparkSession, path: str, sample_lines: int | None = None) -> tuple[DataFrame, int]:
    """(rows as text over the union of keys, number of lines that are no objects). Nested values keep their JSON text."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.withColumn("v", F.try_parse_json("value"))
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    bad = lines.count() - parsed.where(is_object).count()
    keyed = parsed.where(is_object).withColumn("m", F.from_json("value", "map<string,string>"))
    source = keyed.limit(sample_lines) if sample_lines else keyed
    keys = [r.k for r in source.select(F.explode(F.map_keys("m")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy("k").collect()]
    first = source.select(F.map_keys("m").alias("k")).first()
    order = list(first.k) if first else []
    names = [k for k in order if k in keys] + [k for k in keys if k not in order]
    return keyed.select(*(F.col("m")[k].alias(k) for k in names)), bad


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def _xlsx_date(serial: float) -> str:
    import datetime as dt

    moment = dt.datetime(1899, 12, 30) + dt.timedelta(days=serial)
    return moment.strftime("%Y-%m-%d") if serial == int(serial) else moment.replace(microsecond=0).isoformat()


def xlsx_rows(path: str, sheet: str | None = None) -> list[list[str | None]]:
    """Cells of a sheet as text, by the standard library alone."""
    with zipfile.ZipFile(path) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): links[s.get(f"{{{_NS['r']}}}id")] for s in book.find("m:sheets", _NS)}
        if sheet is not None and sheet not in sheets:
            raise QueryError("INVALID_SHEET", f"no sheet {sheet!r}")
        active = int((book.find("m:bookViews/m:workbookView", _NS) or {}).get("activeTab", 0)) if book.find("m:bookViews/m:workbookView", _NS) is not None else 0
        target = sheets[sheet] if sheet else list(sheets.values())[min(active, len(sheets) - 1)]
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        dates = set()
        if "xl/styles.xml" in z.namelist():
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iter(f"{{{_NS['m']}}}numFmt")}
            xfs = styles.find("m:cellXfs", _NS)
            for i, xf in enumerate(xfs if xfs is not None else []):
                fmt = int(xf.get("numFmtId", 0))
                if 14 <= fmt <= 22 or 45 <= fmt <= 47 or re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(fmt, "").lower())):
                    dates.add(i)
        rows = []
        data = ElementTree.fromstring(z.read("xl/" + target.removeprefix("/xl/").removeprefix("xl/")))
        for row in data.iter(f"{{{_NS['m']}}}row"):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row):
                letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else k
                v, kind = c.find("m:v", _NS), c.get("t", "n")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                elif v is None or v.text is None or kind == "e":
                    cells[at] = None
                elif kind == "s":
                    cells[at] = shared[int(v.text)]
                elif kind == "b":
                    cells[at] = "True" if v.text == "1" else "False"
                elif kind in ("str", "d"):
                    cells[at] = v.text
                elif int(c.get("s", -1)) in dates:
                    cells[at] = _xlsx_date(float(v.text))
                else:
                    x = float(v.text)
                    cells[at] = str(int(x)) if x.is_integer() and abs(x) < 1e16 else repr(x)
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return rows


def xls_rows(path: str, sheet: str | None = None) -> list[list[str | None]]:
    try:
        import xlrd
    except ImportError as e:
        raise QueryError("MISSING_DEPENDENCY", "reading .xls needs the optional package xlrd") from e
    book = xlrd.open_workbook(path)
    page = book.sheet_by_name(sheet) if sheet else book.sheet_by_index(0)

    def text(c):
        if c.ctype in (xlrd.XL_CELL_EMPTY, xlrd.XL_CELL_BLANK, xlrd.XL_CELL_ERROR):
            return None
        if c.ctype == xlrd.XL_CELL_DATE:
            d = xlrd.xldate_as_datetime(c.value, book.datemode)
            return d.strftime("%Y-%m-%d") if not (d.hour or d.minute or d.second) else d.isoformat()
        if c.ctype == xlrd.XL_CELL_BOOLEAN:
            return "True" if c.value else "False"
        if c.ctype == xlrd.XL_CELL_NUMBER:
            return str(int(c.value)) if float(c.value).is_integer() else repr(c.value)
        return str(c.value)

    return [[text(c) for c in page.row(i)] for i in range(page.nrows)]


def read_excel(spark: SparkSession, path: str, sheet: str | None = None, header_row: int = 0) -> DataFrame:
    """A workbook is one file that only its own reader can split, so the driver reads it."""
    rows = (xls_rows if path.lower().endswith(".xls") else xlsx_rows)(path, sheet)
    if len(rows) <= header_row:
        raise QueryError("EMPTY_FILE", path)
    names = _names(rows[header_row])
    n = len(names)
    data = [tuple((r + [None] * n)[:n]) for i, r in enumerate(rows) if i != header_row]
    return spark.createDataFrame(data, T.StructType([T.StructField(c, T.StringType()) for c in names]))


def read(spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None, header_row: int = 0, sheet: str | None = None, sample_lines: int | None = None) -> tuple[DataFrame, dict]:
    """(DataFrame, {"malformed_rows": n}) of a file of any supported kind."""
    low = path.lower().rstrip("/")
    if low.endswith(".parquet"):
        return spark.read.parquet(path), {"malformed_rows": 0}
    if low.endswith((".jsonl", ".ndjson")):
        df, bad = read_jsonl(spark, path, sample_lines)
        return df, {"malformed_rows": bad}
    if low.endswith((".xlsx", ".xls")):
        return read_excel(spark, path, sheet, header_row), {"malformed_rows": 0}
    if low.endswith((".csv", ".tsv", ".txt")):
        return read_csv(spark, path, encoding, delimiter, header_row), {"malformed_rows": 0}
    raise QueryError("UNSUPPORTED_FORMAT", f"{path}: one of {', '.join(SUFFIXES)}")
