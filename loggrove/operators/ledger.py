"""Import ledger, upserts and replacement of a file's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: max of one struct, which combines
    on the map side where a row number would sort every key's rows."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in (*order, *rest)]).select(*rows.columns)


def attempt(files: DataFrame, attempt_id: int, success: bool, outcome: str | None = None) -> DataFrame:
    """Ledger rows of one attempt at ``files`` (filename, file_hash and, if there
    is one, modified)."""
    now = F.unix_timestamp()
    modified = F.col("modified") if "modified" in files.columns else F.lit(None).cast("bigint")
    return files.select(
        "filename", now.alias("import_timestamp"), "file_hash", F.lit(success).alias("success"), now.alias("last_attempt_timestamp"),
        F.lit(attempt_id).cast("bigint").alias("attempt_id"), modified.alias("modified"), F.lit(outcome).cast("string").alias("outcome"),
    )


def newest_versions(files: DataFrame, filename: str = "filename", file_hash: str = "file_hash", modified: str = "modified") -> DataFrame:
    """One row of each file name: the version that was modified last; of versions
    of one time the one with the largest hash."""
    return latest(files, [filename], [modified, file_hash])


def one_of_content(files: DataFrame, filename: str = "filename", file_hash: str = "file_hash") -> DataFrame:
    """One row of each content: the one with the smallest name."""
    rest = [c for c in files.columns if c not in (filename, file_hash)]
    best = files.groupBy(file_hash).agg(F.min(F.struct(filename, *rest)).alias("best"))
    return best.select(file_hash, *[F.col(f"best.{c}").alias(c) for c in (filename, *rest)]).select(*files.columns)


def older_versions(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """The files whose name has been imported with other content that was modified
    later (or at the same time, with a larger hash)."""
    done = ledger.where("success").select(F.col("filename").alias("own_filename"), F.col("file_hash").alias("own_hash"), F.col("modified").alias("own_modified"))
    behind = F.struct(F.col("own_modified"), F.col("own_hash")) > F.struct("modified", "file_hash")
    return files.join(done, (F.col("filename") == F.col("own_filename")) & (F.col("own_hash") != F.col("file_hash")) & behind, "left_semi")


def not_imported(files: DataFrame, ledger: DataFrame, file_hash: str = "file_hash") -> DataFrame:
    """The files whose content no successful import has had."""
    done = ledger.where("success").select(file_hash).distinct()
    return files.join(done, file_hash, "left_anti")


def already_imported(files: DataFrame, ledger: DataFrame, file_hash: str = "file_hash", filename: str = "filename") -> DataFrame:
    """The other files, each with the first file name of its content."""
    done = ledger.where("success").groupBy(file_hash).agg(F.min(filename).alias("imported_as"))
    return files.join(done, file_hash)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` and those rows of ``old`` whose key is not in it; NULL keys are
    equal, so a second run changes nothing."""
    fresh = new.select(*[F.col(k).alias(f"new_{k}") for k in keys]).distinct()
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"new_{k}"))
    return new.unionByName(old.join(fresh, test, "left_anti"))


def without_files(rows: DataFrame, files: DataFrame, filename: str = "filename") -> DataFrame:
    """The rows of a table but those of ``files``."""
    return rows.join(files.select(filename).distinct(), filename, "left_anti")
