"""SK1, SK3 to SK6: resumable appends, CSV, sheets that are never overwritten, and tables that are replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_new(df: DataFrame, path: str, key: str) -> None:
    """SK1: rows whose key isn't in the table yet are appended, one for each key. Rows without a key are left out: nobody could tell whether they are done."""
    spark = df.sparkSession
    df = df.where(F.col(key).isNotNull()).dropDuplicates([key])
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    (df.join(done, key, "left_anti") if done is not None else df).write.mode("append").parquet(path)


def sheet(df: DataFrame, path: str) -> None:
    """SK3, SK6: a CSV with header; fails if the sheet is there."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """SK4: a small table as Markdown."""
    rows = df.limit(limit).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", r"\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def replaced(df: DataFrame, path: str) -> None:
    """SK5: the table at path becomes df, which may be read from it: written beside it, then moved into its place. Between the two moves the old table
    stands at path + '.old', from where an interrupted run takes it back."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = {name: jvm.org.apache.hadoop.fs.Path(path + name) for name in ("", ".new", ".old")}
    fs = at[""].getFileSystem(conf)
    if not fs.exists(at[""]) and fs.exists(at[".old"]):
        fs.rename(at[".old"], at[""])
    df.write.mode("overwrite").parquet(path + ".new")
    fs.delete(at[".old"], True)
    if fs.exists(at[""]) and not fs.rename(at[""], at[".old"]) or not fs.rename(at[".new"], at[""]):
        raise OSError(f"{path}: the new table couldn't be moved into place")
    fs.delete(at[".old"], True)
