"""Readers of loosely shaped records: JSON lines, tables, archives and sectioned text."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.operators.joins import small

#: Kinds of files by extension.
EXTENSIONS = {"json": ("json", "jsonl", "ndjson"), "table": ("csv", "tsv", "parquet"), "code": ("c", "h", "cc", "cpp"), "archive": ("zip", "tar", "tgz", "gz")}
#: The columns by which a modality is known, in order of precedence.
MODALITIES = {"patch": ("vulnerable_code", "fixed_code", "func_before", "func_after"), "code": ("code", "func", "function"), "text": ("text", "label", "sentence")}
#: Formats in the order in which they are read.
FORMATS = ("jsonl", "json", "csv", "tsv", "parquet")
_CORRUPT = "_corrupt"


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, glob: str = "*.jsonl", whole: bool = False) -> DataFrame:
    """JSON lines under a folder at any depth, or whole-file arrays; lines that do not parse are left out."""
    own = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=whole)
    if whole:
        return files.select(F.explode(F.from_json("value", T.ArrayType(own))).alias("r")).where("r is not null").select("r.*")
    kept = T.StructType([*own.fields, T.StructField(_CORRUPT, T.StringType())])
    rows = files.select(F.from_json("value", kept, {"columnNameOfCorruptRecord": _CORRUPT}).alias("r"))
    return rows.where(F.col("r").isNotNull() & F.col(f"r.{_CORRUPT}").isNull()).select("r.*").drop(_CORRUPT)


def tabular(spark: SparkSession, path: str, needed: list[str], kind: str = "csv") -> DataFrame | None:
    """A CSV, TSV or Parquet table, malformed lines left out; none when it has no column of those needed."""
    if kind == "parquet":
        df = spark.read.parquet(path)
    else:
        df = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("sep", "\t" if kind == "tsv" else ",").csv(path)
    return df if {c.lower() for c in df.columns} & {c.lower() for c in needed} else None


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one where nothing was written yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def alias(df: DataFrame, names: list[str], default: Column | None = None) -> Column:
    """The first of the named columns that is there and not empty, exact names before others in case."""
    exact = [n for n in names if n in df.columns]
    folded = [c for n in names for c in df.columns if c.lower() == n.lower() and c not in exact]
    found = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).isNotNull() for c in exact + folded]
    picks = [F.when(ok, F.col(f"`{c}`").cast("string")) for c, ok in zip(exact + folded, found)]
    if default is not None:
        picks.append(default)
    return F.coalesce(*picks) if picks else F.lit(None).cast("string")


def patch_records(df: DataFrame, most: int | None = None, seed: str = "0") -> DataFrame:
    """Records of different vulnerable and fixed code under any known column names, the first of each id."""
    code = df.select(
        alias(df, ["cve_id", "cve", "CVE ID", "id"]).alias("cve_id"), alias(df, ["cwe", "cwe_id", "CWE ID"], F.lit("CWE-unknown")).alias("cwe"),
        alias(df, ["vulnerable_code", "func_before", "before", "vul_func"]).alias("vulnerable_code"),
        alias(df, ["official_fixed_code", "func_after", "after", "fixed_code"]).alias("official_fixed_code"),
    )
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+\z", "")
    code = code.where(F.col("vulnerable_code").isNotNull() & F.col("official_fixed_code").isNotNull() & (strip("vulnerable_code") != strip("official_fixed_code")))
    code = code.withColumn("cve_id", F.coalesce("cve_id", F.concat(F.lit("row-"), F.md5("vulnerable_code"))))
    first = code.groupBy("cve_id").agg(F.min(F.struct("cwe", "vulnerable_code", "official_fixed_code")).alias("r")).select("cve_id", "r.*")
    return first if most is None else first.orderBy(F.md5(F.concat_ws("-", F.lit(seed), "cve_id")), "cve_id").limit(most)


def modality(columns: list[str]) -> str | None:
    """The modality whose columns a table shares most, the earlier one among equals."""
    have = {c.lower() for c in columns}
    score = {m: len(have & set(names)) for m, names in MODALITIES.items()}
    best = max(score, key=lambda m: score[m])
    return best if score[best] else None


def discover(spark: SparkSession, path: str, first: tuple[str, ...] = ()) -> DataFrame:
    """``path``, ``length``, ``kind`` and ``priority`` of the files under a folder, without reading them.

    Files in the folders named ``first`` come before others, in that order; among equals the order is that of the kinds
    of formats, then of the paths: ``orderBy("priority", "format", "path")`` is the order of reading.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.coalesce(*(F.when(ext.isin(*names), k) for k, names in EXTENSIONS.items()), F.lit("other"))
    priority = F.coalesce(*(F.when(F.col("path").contains(f"/{name}/"), k) for k, name in enumerate(first)), F.lit(len(first)))
    order = F.array_position(F.array(*map(F.lit, FORMATS)), ext)
    return files.select("path", "length", kind.alias("kind"), priority.alias("priority"), F.when(order > 0, order).otherwise(len(FORMATS) + 1).cast("int").alias("format"))


def archive_members(spark: SparkSession, path: str, most_bytes: int = 64 << 20) -> DataFrame:
    """``path``, ``name``, ``text`` and ``problem`` of the files in zip, tar and gzip files, read in memory on the executors.

    Nothing is written, so names that climb out of a folder can do no harm; they, members larger than ``most_bytes`` and
    archives that cannot be read have a row without a text that says so.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def members(name: str, data: bytes) -> Iterator[tuple[str, bytes | None]]:
        if zipfile.is_zipfile(io.BytesIO(data)):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for info in z.infolist():
                    if not info.is_dir():
                        yield info.filename, z.read(info) if info.file_size <= most_bytes else None
        elif name.endswith((".tar", ".tgz", ".tar.gz")):
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for m in t:
                    if m.isfile():
                        yield m.name, t.extractfile(m).read() if m.size <= most_bytes else None
        elif name.endswith(".gz"):
            with gzip.open(io.BytesIO(data)) as g:
                text = g.read(most_bytes + 1)
            yield name.rsplit("/", 1)[-1].removesuffix(".gz"), text if len(text) <= most_bytes else None

    def rows_of(name: str, data: bytes) -> Iterator[tuple[str, str | None, str | None, str | None]]:
        try:
            for member, content in members(name, data):
                if member.startswith("/") or ".." in member.split("/"):
                    yield name, member, None, "climbs out of the archive"
                elif content is None:
                    yield name, member, None, "too large"
                else:
                    yield name, member, content.decode("utf-8", "replace"), None
        except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, zlib.error) as broken:
            yield name, None, None, f"cannot be read: {type(broken).__name__}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, c in zip(pdf["path"], pdf["content"]) for r in rows_of(p, bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "name", "text", "problem"])

    return files.mapInPandas(run, "path string, name string, text string, problem string")


def sections(spark: SparkSession, path: str, heading: str = r"(?m)^## ") -> DataFrame:
    """``at``, ``title`` and ``body`` of the sections of Markdown files."""
    parts = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", heading)).alias("at", "part")).where("at > 0")
    return parts.select("at", F.regexp_extract("part", r"^([^\n]*)", 1).alias("title"), F.regexp_replace("part", r"^[^\n]*\n?", "").alias("body"))


def preferred_split(df: DataFrame, column: str = "split") -> DataFrame:
    """The rows of the first split that is there: test, validation, valid, train, then by name."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ("test", "validation", "valid", "train"))), F.col(column)), F.lit(0)), F.lit(99))
    best = df.agg(F.min(F.struct(rank.alias("rank"), column)).alias("b")).select(F.col(f"b.{column}").alias(column))
    return df.join(F.broadcast(best), column, "left_semi")


def families(functions: DataFrame, order: list[str]) -> DataFrame:
    """Backport families: functions of one id on two branches or more, the first declared branch as source.

    ``functions`` has ``cve_id``, ``function``, ``branch`` and ``code``.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("branch")), F.lit(0)), F.lit(len(order) + 1))
    g = functions.groupBy("cve_id", "function").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "branch", "code"))).alias("all"))
    return g.where(F.size("all") >= 2).select("cve_id", "function", F.col("all")[0].alias("source"), F.expr("slice(all, 2, size(all) - 1)").alias("targets"))


def source_file(path: Column, own: tuple[str, ...] = ("c",)) -> Column:
    """Whether a path is that of a source file of the wanted kinds that is no test."""
    kind = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return kind.isin(*own) & ~F.contains(path, F.lit("/test")) & ~path.startswith("test")


def names_project(record: Column, aliases: Column) -> Column:
    """Whether a record's text names a project by any of its aliases, in any case."""
    return F.exists(aliases, lambda a: F.contains(F.lower(record), F.lower(a)))


def fixes(commits: DataFrame, before: DataFrame, after: DataFrame, since: str, records: DataFrame | None = None) -> DataFrame:
    """Mined pairs: of commits that name one id, have one parent and come at a date or later, the function that changed most.

    ``commits`` has ``commit``, ``day``, ``message`` and, where known, ``parents`` (a count); ``before`` and ``after`` have
    ``commit``, ``function``, ``code`` and, where known, ``path``: only source files that are no tests count.  ``records``
    (``cve_id``, ``state``, ``published``) keeps published ids of that date or later.
    """
    ids = F.array_distinct(F.regexp_extract_all("message", F.lit(r"CVE-[0-9]{4}-[0-9]{4,}"), F.lit(0)))
    named = commits.where(F.col("day") >= since).withColumn("ids", ids).where(F.size("ids") == 1).withColumn("cve_id", F.col("ids")[0])
    if "parents" in commits.columns:
        named = named.where("parents = 1")
    if records is not None:
        kept = records.where((F.col("state") == "PUBLISHED") & (F.substring("published", 1, 10) >= since)).select("cve_id").distinct()
        named = named.join(kept, "cve_id", "left_semi")
    sides = [side.where(source_file(F.col("path"))) if "path" in side.columns else side for side in (before, after)]
    on = [c for c in ("commit", "path", "function") if all(c in side.columns for side in sides)]
    met = sides[0].select(*on, F.col("code").alias("func_before")).join(sides[1].select(*on, F.col("code").alias("func_after")), on).where("func_before <> func_after")
    a, b = F.split("func_before", "\n"), F.split("func_after", "\n")
    changed = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    best = F.max(F.struct(changed.alias("changed"), "function", "func_before", "func_after")).alias("f")
    return named.join(met, "commit").groupBy("cve_id", "commit", "day").agg(best).select("cve_id", "commit", "day", "f.*")


def vetted_sample(records: DataFrame, kept: Column, n: int, most: int = 3000, seed: str = "0") -> DataFrame:
    """Records that pass a filter, the first of each id (by ``at``), ``most`` of these at most, and of them ``n`` drawn, in order of id.

    The cap and the draw are the sampler's; draws come from a hash of seed and id.
    """
    rest = [c for c in records.columns if c != "cve_id"]
    first = records.where(kept).groupBy("cve_id").agg(F.min(F.struct("at", *(c for c in rest if c != "at"))).alias("r")).select("cve_id", "r.*")
    pool = first.orderBy("at", "cve_id").limit(most)
    return pool.orderBy(F.md5(F.concat_ws("-", F.lit(seed), "cve_id")), "cve_id").limit(n).orderBy("cve_id").select(*records.columns)


def simplified(text: Column) -> Column:
    """Lower-case letters and digits only, so that names match whatever their punctuation."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def resolve_names(keys: DataFrame, entries: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """Left join of keys to the first entry (by ``order``) whose simplified name holds the key's or is held by it, equal names first.

    The entries' side is a manifest of some thousands at most; it is counted before it is broadcast.
    """
    k = keys.withColumn("__k", simplified(F.col(key)))
    e = entries.select(*(F.col(c).alias(f"entry_{c}") for c in entries.columns)).withColumn("__n", simplified(F.col(f"entry_{name}"))).where("__n <> ''")
    met = k.join(small(e), (F.col("__k") != "") & (F.contains("__n", F.col("__k")) | F.contains("__k", F.col("__n"))), "left")
    pick = F.min(F.struct((F.col("__k") != F.col("__n")).alias("other"), F.col(f"entry_{order}").alias("order"), F.col(f"entry_{name}").alias("entry")))
    best = met.groupBy(key).agg(pick.alias("b"))
    return best.select(key, F.col("b.entry").alias("entry"))
