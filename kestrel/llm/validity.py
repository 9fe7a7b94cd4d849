"""Source files that do not parse.

Every text goes through the recursive-descent parser of its path's language
(:mod:`kestrel.syntax`): expressions by precedence climbing, errors by
panic-mode recovery.  All errors are kept, the first one is the cause.

Defined results: a null or empty text parses (it has no error); a row whose
language is null or has no parser yields nothing; repeated rows (same file_id)
count once; CRLF is read as LF; extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.session import spread, text_batches
from kestrel.syntax import LANGUAGES, parse_text

SCHEMA = "file_id bigint, repo string, path string, language string, errors array<struct<line:int,cause:string>>"
_ARROW = pa.schema(
    [("file_id", pa.int64()), ("repo", pa.string()), ("path", pa.string()), ("language", pa.string()),
     ("errors", pa.list_(pa.struct([("line", pa.int32()), ("cause", pa.string())])))]
)


def errors_of(text: str | None, language: str) -> list[dict]:
    """All syntax errors of a text in order of place."""
    if not text:
        return []
    x = parse_text(text, language)
    if not x.errors:
        return []
    src = x.src
    return [{"line": src.line(src.offset(p)), "cause": why} for p, why in sorted(x.errors)]


def _parse_batches(batches):
    for b in batches:
        cols = [b.column(n).to_pylist() for n in ("text", "language")]
        yield pa.RecordBatch.from_arrays(
            [b.column("file_id"), b.column("repo"), b.column("path"), b.column("language"),
             pa.array([errors_of(t, g) for t, g in zip(*cols)], _ARROW.field("errors").type)], schema=_ARROW,
        )


def parsed_files(files: DataFrame) -> DataFrame:
    """One row per row of ``files`` in a known language, with all its errors; texts are not shuffled."""
    text_batches(files.sparkSession)
    f = files.select("file_id", "repo", "path", "language", "text").where(F.col("language").isin(*LANGUAGES))
    return spread(f).mapInArrow(_parse_batches, SCHEMA)


def invalid_files(files: DataFrame) -> DataFrame:
    """file_id of each file whose text is not valid syntax of its language."""
    return parsed_files(files).where(F.size("errors") > 0).select("file_id").distinct()


def file_errors(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per file with errors: their number, the first cause and its line, and the kinds of the file's chunks."""
    bad = (
        parsed_files(files)
        .where(F.size("errors") > 0)
        .groupBy("file_id")
        .agg(F.first("repo").alias("repo"), F.first("path").alias("path"), F.first("language").alias("language"), F.first("errors").alias("errors"))
    )
    kinds = chunks.select("repo", "path", "kind").groupBy("repo", "path").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    return bad.join(kinds, ["repo", "path"], "left").select(
        "file_id", "repo", "path", "language", F.size("errors").alias("n_errors"), F.col("errors")[0]["line"].alias("first_line"),
        F.col("errors")[0]["cause"].alias("first_cause"), F.concat_ws(",", "kinds").alias("chunk_kinds"),
    )


def all_errors(files: DataFrame) -> DataFrame:
    """One row per error of every file, in order of place; the first is the cause."""
    once = parsed_files(files).where(F.size("errors") > 0).groupBy("file_id").agg(
        F.first("repo").alias("repo"), F.first("path").alias("path"), F.first("language").alias("language"), F.first("errors").alias("errors")
    )
    each = once.select("file_id", "repo", "path", "language", F.posexplode("errors").alias("k", "e"))
    return each.select("file_id", "repo", "path", "language", (F.col("k") + 1).alias("error_no"), (F.col("k") == 0).alias("is_first"), F.col("e.line").alias("line"), F.col("e.cause").alias("cause"))


def acceptance(files: DataFrame) -> DataFrame:
    """Per language: files, files that its grammar accepts, their share, errors in the others."""
    one = parsed_files(files).groupBy("file_id").agg(F.first("language").alias("language"), F.max(F.size("errors")).alias("n"))
    return one.groupBy("language").agg(
        F.count("*").alias("n_files"), F.sum((F.col("n") == 0).cast("int")).alias("n_accepted"), F.round(F.avg((F.col("n") == 0).cast("int")), 6).alias("acceptance"), F.sum("n").alias("n_errors")
    )


def error_rates(files: DataFrame) -> DataFrame:
    """Per repository and language: files, files that do not parse, their rate."""
    one = parsed_files(files).groupBy("file_id").agg(
        F.first("repo").alias("repo"), F.first("language").alias("language"), F.max((F.size("errors") > 0).cast("int")).alias("bad")
    )
    return one.groupBy("repo", "language").agg(
        F.count("*").alias("n_files"), F.sum("bad").alias("n_invalid"), F.round(F.avg("bad"), 6).alias("invalid_rate")
    )
