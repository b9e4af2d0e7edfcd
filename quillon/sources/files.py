"""Alert files: delimited and JSON scans, checks of keys and headers, sinks with manifests."""

from __future__ import annotations

import csv
import hashlib
import json
import math
import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a delimited file may write for a missing value. Fixed values.
MISSING = ("", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: Limits of an imported record.
MAX_RECORDS, MAX_FIELDS, MAX_FIELD_CHARS, MAX_RECORD_CHARS = 1000, 100, 12_000, 60_000


def separator(path: str) -> str:
    name = path.lower()
    if name.endswith(".tsv"):
        return "\t"
    if name.endswith(".csv"):
        return ","
    raise ValueError("only .csv and .tsv files are alert files")


def read_delimited(spark: SparkSession, path: str, line_ends_in_fields: bool = False) -> DataFrame:
    """All columns as strings (so an id 007 stays 007); missing-value words become null.

    Headers must be unique and not empty. A file whose quoted fields hold line ends can't be split and is one task:
    it has to be asked for.
    """
    sep = separator(path)
    first = spark.read.text(path).where(F.trim("value") != "").first()
    if first is not None:
        check_header(next(csv.reader([first["value"].lstrip("\ufeff")], delimiter=sep)))
    df = spark.read.csv(path, header=True, sep=sep, multiLine=line_ends_in_fields, escape='"', quote='"')
    for c in df.columns:
        df = df.withColumn(c, F.when(~F.trim(F.col(f"`{c}`")).isin(*MISSING), F.col(f"`{c}`")))
    return df


def read_alerts(spark: SparkSession, path: str, line_ends_in_fields: bool = False) -> DataFrame:
    """A checked alert file: ids made where absent, trimmed, present and unique otherwise; verdicts in canonical form."""
    df = read_delimited(spark, path, line_ends_in_fields)
    if df.isEmpty():
        raise ValueError("the alert file is empty")
    if "alert_id" not in df.columns:
        df = with_row_ids(df)
    df = df.withColumn("alert_id", F.nullif(F.trim("alert_id"), F.lit("")))
    if not duplicate_keys(df, "alert_id").isEmpty():
        raise ValueError("alert_id must be present and unique")
    return df.withColumn("verdict", canonical(F.col("verdict"))) if "verdict" in df.columns else df


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Dense whole numbers from 0 in file order, without a global sort: rows are counted by partition, and each
    partition starts where the ones before it end. One count a partition comes to the driver."""
    rows = df.select("*", F.monotonically_increasing_id().alias("__m"))
    part = F.call_function("shiftright", F.col("__m"), F.lit(33))
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, total = {}, 0
    for p, n in counts:
        starts[p], total = total, total + n
    offsets = df.sparkSession.createDataFrame(list(starts.items()) or [(0, 0)], "__p long, __start long")
    at = F.col("__start") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(offsets, part == F.col("__p")).select(*df.columns, at.alias(name))


def with_row_ids(df: DataFrame, name: str = "alert_id") -> DataFrame:
    """Dense ids ROW0000000, ROW0000001, ... in file order."""
    return numbered(df, "__n").withColumn(name, F.format_string("ROW%07d", "__n")).drop("__n")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """``key, n`` of keys that are null or occur more than once."""
    return df.groupBy(F.col(key).cast("string").alias(key)).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1))


def canonical(verdict: Column) -> Column:
    return F.upper(F.trim(verdict))


def conform(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns of a schema (name to type), absent ones as typed nulls; others are kept."""
    more = [F.lit(None).cast(t).alias(c) for c, t in columns.items() if c not in df.columns]
    return df.select("*", *more)


def choose_column(columns: list[str], aliases: list[str], role: str) -> str:
    """The column that an alias names, letters and digits only counting; the first alias with exactly one match wins."""
    plain = lambda x: re.sub(r"[^a-z0-9]", "", x.lower())
    for alias in aliases:
        found = [c for c in columns if plain(c) == plain(alias)]
        if len(found) > 1:
            raise ValueError(f"several columns could be the {role}: {found}")
        if found:
            return found[0]
    raise ValueError(f"no column for the {role}")


def check_header(names: list[str]) -> None:
    if any(not n.strip() for n in names) or len({n.strip() for n in names}) != len(names):
        raise ValueError("headers must be unique and not empty")


def records_of(text: Column) -> Column:
    """JSON text as an array of flat records: an object, an array of them, or an object that holds them under ``alerts``."""
    one, many = "map<string,string>", "array<map<string,string>>"
    wrapped = F.from_json(text, "alerts array<map<string,string>>")["alerts"]
    return F.coalesce(F.when(F.ltrim(text).startswith("["), F.from_json(text, many)), wrapped, F.array(F.from_json(text, one)))


def import_records(spark: SparkSession, name: str, text: str) -> DataFrame:
    """``pos, record``: the records of an uploaded JSON or delimited text of at most ``MAX_RECORDS`` records."""
    if format_of(name, text) == "json":
        rows = spark.createDataFrame([(text,)], "text string").select(F.posexplode(records_of(F.col("text"))).alias("pos", "r"))
    else:
        sep = "\t" if name.lower().endswith(".tsv") else ","
        lines = [x for x in csv.reader(text.lstrip("\ufeff").splitlines(keepends=True), delimiter=sep) if any(c.strip() for c in x)]
        if not lines:
            raise ValueError("no records")
        check_header(lines[0])
        pairs = [(i, dict(zip((h.strip() for h in lines[0]), x))) for i, x in enumerate(lines[1:])]
        rows = spark.createDataFrame(pairs, "pos int, r map<string,string>")
    out = rows.select("pos", normalised_record(F.col("r")).alias("record"))
    n, good = out.agg(F.count("*"), F.count("record")).first()
    if not 0 < n <= MAX_RECORDS or good < n:
        raise ValueError(f"an import holds 1 to {MAX_RECORDS} records within the limits of a record")
    return out


def selected(records: DataFrame, pos: int) -> dict[str, str]:
    """One record of an import by its position, as a flat alert."""
    row = records.where(F.col("pos") == pos).select("record").first()
    if row is None:
        raise ValueError("the import has no such record")
    return {"alert_id": "MANUAL"} | dict(row["record"])


def normalised_record(record: Column) -> Column:
    """A flat record without blank values; null if it breaks a limit."""
    kept = F.map_filter(record, lambda k, v: v.isNotNull() & (F.trim(v) != "") & (F.trim(k) != ""))
    longest = F.aggregate(F.map_values(kept), F.lit(0), lambda m, v: F.greatest(m, F.length(v)))
    ok = (F.size(kept) > 0) & (F.size(kept) <= MAX_FIELDS) & (longest <= MAX_FIELD_CHARS) & (F.length(F.to_json(kept)) <= MAX_RECORD_CHARS)
    return F.when(ok, kept)


def format_of(name: str, text: str) -> str:
    """``json`` or ``delimited``: by extension, else by whether the text parses as JSON."""
    if name.lower().endswith((".csv", ".tsv")):
        return "delimited"
    try:
        json.loads(text)
        return "json"
    except ValueError:
        return "delimited"


def strict(value):
    """A value for strict JSON: numbers that aren't finite become null."""
    if isinstance(value, dict):
        return {str(k): strict(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [strict(v) for v in value]
    if hasattr(value, "item"):
        value = value.item()
    return None if isinstance(value, float) and not math.isfinite(value) else value


def strict_json(df: DataFrame) -> DataFrame:
    """``json`` of every row, with NaN and infinities as null."""
    cols = [F.when(~F.isnan(F.col(c)) & (F.abs(F.col(c)) != float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, sha256`` of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_digests(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Rows of ``expected`` (``name, sha256``) that a folder does not match: empty if the bundle is whole."""
    found = file_digests(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("found"))
    return expected.join(found, "name", "left").where(~F.col("sha256").eqNullSafe(F.col("found")))


def safe_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise ValueError("a run name has letters, digits, _ and - only")
    return name


def write_run(tables: dict[str, DataFrame], folder: str, run: str, manifest: dict) -> None:
    """Tables of a run as Parquet below ``folder/run``, and its manifest as one JSON line."""
    spark = next(iter(tables.values())).sparkSession
    digests = {}
    for name, df in tables.items():
        path = f"{folder}/{safe_name(run)}/{safe_name(name)}"
        df.write.mode("errorifexists").parquet(path)
        digests[name] = {r["path"].rpartition("/")[2]: r["sha256"] for r in file_digests(spark, f"{path}/*.parquet").collect()}
    manifest = manifest | {"digests": digests}
    line = json.dumps(strict({"run": run, "created": datetime.now(timezone.utc).isoformat(), "environment": environment(), **manifest}), allow_nan=False, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{folder}/{run}/manifest")


def environment() -> dict[str, str]:
    """Versions to store with a run, and the SHA-256 of every source file of this package."""
    import platform
    from importlib.metadata import version
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    sources = {str(p.relative_to(root)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(root.rglob("*.py"))}
    return {"python": platform.python_version(), "system": platform.platform(), "sources": sources, **{p: version(p) for p in ("pyspark", "numpy", "pandas", "pyarrow")}}


def run_name(prefix: str = "run") -> str:
    """A run's name from the time (UTC) at which it is made."""
    return safe_name(f"{prefix}-{datetime.now(timezone.utc):%Y%m%dT%H%M%S%fZ}")


def read_run(spark: SparkSession, folder: str, run: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/{safe_name(run)}/manifest").first()["value"])
