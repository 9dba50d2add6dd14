"""Datasets under a root folder: rows as Parquet, a manifest with the profile, history, fingerprint.

A dataset's manifest is written last, under a name of its own that replaces the old one, so a crash leaves the former
state or the new one. The root may be in any store that Spark reads.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import infer as I
from ..operators.predicates import col
from ..operators.rows import ROW_ID

RULES = 1
HISTORY = 50
FINGERPRINT_ROWS = 1000


def check_id(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]{1,128}", name) or ".." in name:
        raise QueryError("INVALID_DATASET", f"{name!r}: letters, digits, dot, dash, underscore; at most 128")
    return name


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # files ------------------------------------------------------------
    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def read_text(self, path: str) -> str | None:
        fs, at = self._fs(path)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        fs, at = self._fs(f"{path}.{uuid.uuid4().hex[:8]}.tmp")
        stream = fs.create(at, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        # One renaming that replaces what is there: a reader finds the old text or the new one.
        jvm, (_, final) = self.spark._jvm, self._fs(path)
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(at, final, how)

    def remove(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.delete(at, True)

    def names(self) -> list[str]:
        fs, at = self._fs(self.root)
        if not fs.exists(at):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory() and self.exists(f"{self.root}/{s.getPath().getName()}/manifest.json"))

    # datasets ---------------------------------------------------------
    def manifest(self, name: str) -> dict:
        text = self.read_text(f"{self.root}/{check_id(name)}/manifest.json")
        if text is None:
            raise QueryError("NOT_INDEXED", f"dataset {name!r} is not indexed")
        return json.loads(text)

    def rows(self, name: str) -> DataFrame:
        m = self.manifest(name)
        return self.spark.read.parquet(f"{self.root}/{name}/{m['rows']}")

    def profiles(self, name: str) -> list[dict]:
        return self.manifest(name)["columns"]

    def save(self, name: str, rows: DataFrame, columns: list[dict], **more) -> dict:
        """rows: with ``_row_id``. Returns the manifest."""
        check_id(name)
        before = self.read_text(f"{self.root}/{name}/manifest.json")
        version = f"rows-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.root}/{name}/{version}")
        kept = self.spark.read.parquet(f"{self.root}/{name}/{version}")
        m = {"dataset": name, "rows": version, "rules": RULES, "row_count": kept.count(), "column_count": len(columns), "columns": columns, "fingerprint": fingerprint(kept), "indexed_at": dt.datetime.now(dt.UTC).isoformat(timespec="seconds")} | more
        m["checksum"] = checksum(m)
        self.write_text(f"{self.root}/{name}/manifest.json", json.dumps(m, default=str))
        if before:
            self.remove(f"{self.root}/{name}/{json.loads(before)['rows']}")
        self.add_history(name, m)
        return m

    def add_history(self, name: str, m: dict) -> None:
        path = f"{self.root}/{name}/history.json"
        old = json.loads(self.read_text(path) or "[]")
        shot = {"indexed_at": m["indexed_at"], "row_count": m["row_count"], "fingerprint": m["fingerprint"], "columns": {c["name"]: {k: c.get(k) for k in ("type", "null_pct", "cardinality")} for c in m["columns"]}}
        self.write_text(path, json.dumps([*old, shot][-HISTORY:], default=str))

    def history(self, name: str, n: int = 10) -> list[dict]:
        self.manifest(name)
        return json.loads(self.read_text(f"{self.root}/{name}/history.json") or "[]")[-min(max(n, 1), HISTORY) :]

    def delete(self, name: str) -> bool:
        self.manifest(name)
        return self.remove(f"{self.root}/{name}")

    def validate(self, name: str) -> dict:
        """Checksum, rows, columns against the manifest: ok, warning or error."""
        m, problems, warnings = self.manifest(name), [], []
        if m.get("checksum") is None:
            warnings.append("no checksum")
        elif checksum(m) != m["checksum"]:
            problems.append("the manifest's checksum differs")
        if not self.exists(f"{self.root}/{name}/{m['rows']}"):
            problems.append("the rows are missing")
        else:
            df = self.rows(name)
            if (n := df.count()) != m["row_count"]:
                problems.append(f"{n} rows, {m['row_count']} expected")
            if [c for c in df.columns if c != ROW_ID] != [c["name"] for c in m["columns"]]:
                problems.append("the columns differ")
        if m.get("rules") != RULES:
            warnings.append("profiled by older rules")
        return {"status": "error" if problems else "warning" if warnings else "ok", "problems": problems, "warnings": warnings}

    # traffic, embeddings: small tables of their own ---------------------
    def table(self, name: str, what: str) -> DataFrame | None:
        at = (self.read_text(f"{self.root}/{name}/{what}.current") or "").split(" ")[0]
        return self.spark.read.parquet(f"{self.root}/{name}/{at}") if at else None

    def mark(self, name: str, what: str) -> str | None:
        """What ``put_table`` was told beside the table that now holds."""
        at = (self.read_text(f"{self.root}/{name}/{what}.current") or "").split(" ")
        return at[1] if len(at) > 1 else None

    def put_table(self, name: str, what: str, df: DataFrame, mark: str | None = None) -> DataFrame:
        """The table and its mark (no blanks) hold from the same moment; a table without a new mark keeps the old one."""
        old, mark = (self.read_text(f"{self.root}/{name}/{what}.current") or "").split(" ")[0], mark or self.mark(name, what)
        new = f"{what}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.root}/{name}/{new}")
        self.write_text(f"{self.root}/{name}/{what}.current", f"{new} {mark}" if mark else new)
        if old:
            self.remove(f"{self.root}/{name}/{old}")
        return self.spark.read.parquet(f"{self.root}/{name}/{new}")


def checksum(manifest: dict) -> str:
    """Of all of a manifest but its checksum, which stands in the same file."""
    rest = {k: v for k, v in manifest.items() if k != "checksum"}
    return hashlib.sha256(json.dumps(json.loads(json.dumps(rest, default=str)), sort_keys=True).encode()).hexdigest()


def fingerprint(rows: DataFrame) -> str:
    """Hash of the sorted column names and the first rows."""
    names = sorted(c for c in rows.columns if c != ROW_ID)
    text = F.concat_ws("\x1f", *(F.coalesce(I.canonical(col(c), rows.schema[c].dataType), F.lit("\x00")) for c in names))
    first = rows.where(col(ROW_ID) <= FINGERPRINT_ROWS).orderBy(ROW_ID).select(text.alias("t")).collect()
    return hashlib.sha256("\x1e".join(["\x1f".join(names), *(r.t for r in first)]).encode()).hexdigest()


def file_hash(path: str) -> str | None:
    import os

    if not os.path.exists(path):
        return None
    h = hashlib.sha256()
    files = [path] if os.path.isfile(path) else sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs)
    for f in files:
        with open(f, "rb") as s:
            while block := s.read(1 << 20):
                h.update(block)
    return h.hexdigest()
