"""Writers of results: fixed column order, finite numbers, idempotent merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities become null."""
    fix = {c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(fix) if fix else df


def require_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fails the job that writes the rows when a required metric is null, NaN or infinite."""
    for c in columns:
        bad = F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        df = df.withColumn(c, F.when(bad, F.raise_error(F.lit(f"{c} is not finite")).cast("double")).otherwise(F.col(c)))
    return df


def write_json_lines(df: DataFrame, path: str) -> None:
    finite(df).write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str, columns: list[str]) -> None:
    """One CSV file of a report, which is small, in a fixed column order."""
    finite(df).select(columns).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def merge_results(df: DataFrame, path: str, key: str = "rq") -> None:
    """Replaces only the partitions of the keys that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows whose key is not in ``new``, and all new rows, as for a manifest."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def insert_new(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows to append to a key-value table where the first write of a key wins."""
    from assayer.operators.windows import first_wins

    return first_wins(new, key, order).join(old.select(key), key, "left_anti")


def with_checksum(df: DataFrame, text: str, out: str = "sha256") -> DataFrame:
    return df.withColumn(out, F.sha2(F.col(text), 256))


def blind_sheet(df: DataFrame, secret: list[str], case: str, seed: str) -> tuple[DataFrame, DataFrame]:
    """A sheet without the secret columns in a hashed order, and the key to it."""
    sheet = df.drop(*secret).withColumn("order", F.md5(F.concat_ws("-", F.lit(seed), F.col(case).cast("string"))))
    return sheet.orderBy("order").drop("order"), df.select(case, *secret)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; more rows than ``most`` are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *map(line, rows)])


def latex(df: DataFrame, most: int = 1000) -> str:
    """A small table as a LaTeX tabular; more rows than ``most`` are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    clean = lambda c: "" if c is None else str(c).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    body = "\n".join(" & ".join(map(clean, r)) + r" \\" for r in [df.columns, *rows])
    return "\\begin{tabular}{" + "l" * len(df.columns) + "}\n" + body + "\n\\end{tabular}"


def require(df: DataFrame, holds: Column, what: str) -> DataFrame:
    """The rows as they are; reading one for which a control does not hold, or is unknown, fails with its name."""
    return df.withColumn("__held", F.assert_true(F.coalesce(holds, F.lit(False)), F.lit(f"control failed: {what}"))).where("__held is null").drop("__held")
