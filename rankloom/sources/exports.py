"""Export files: encoding and header are settled per file on the driver, the rows are read by Spark.

Only the first line of a file ever reaches the driver, that of all files by one job. Files with the same encoding,
separator and header are read by one scan, so neither jobs nor plans grow with the number of files.
"""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import BOM, first_filled

# Byte order marks of UTF-16 and how the text after them is decoded.
UTF16_MARKS = {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}


@dataclass(frozen=True)
class ExportFile:
    """One export file and how to read it; ``headers`` is empty when the file has none."""

    path: str
    encoding: str
    separator: str
    headers: tuple[str, ...]

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]

    def lower_headers(self) -> tuple[str, ...]:
        return tuple(h.lower() for h in self.headers)


def list_files(spark: SparkSession, folder: str, glob: str, recursive: bool = False) -> list[str]:
    """Paths below ``folder`` whose name matches ``glob``, in name order."""
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(folder)
        .inputFiles()
    )
    return sorted(map(unquote, found), key=lambda p: (p.rsplit("/", 1)[-1], p))


def clean_header(name: str | None) -> str:
    return (name or "").replace(BOM, "").strip()


def _csv(spark: SparkSession, encoding: str, separator: str, multi_line: bool):
    return (
        spark.read.option("encoding", encoding)
        .option("sep", separator)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
    )


def file_place(path: str) -> str:
    """One spelling of a path: local files come as /x, as file:/x and as file:///x."""
    return re.sub(r"^file:/+", "/", unquote(path))


@dataclass(frozen=True)
class _Start:
    """How a file begins: the bytes of its first line, and whether all its lines are UTF-8."""

    line: bytes
    utf8: bool


def _starts(spark: SparkSession, paths: Sequence[str]) -> dict[str, _Start]:
    """The start of every file that has a line, by one job for all of them; lines are folded in the tasks that read them."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), place.alias("place"), "value")
    found = lines.groupBy("path").agg(
        F.min_by(F.col("value").cast("binary"), "place").alias("line"), F.bool_and(F.is_valid_utf8("value")).alias("utf8")
    )
    return {file_place(r.path): _Start(bytes(r.line), r.utf8) for r in found.collect()}


def _header(spark: SparkSession, path: str, start: str, encoding: str, separator: str) -> Sequence[str | None]:
    """Header cells, cut from the first line; only a header with a line break inside quotes is read by a job of its own."""
    if not start.strip():
        return ()
    if start.count('"') % 2 == 0:
        return next(csv.reader([start], delimiter=separator))
    head = _csv(spark, encoding, separator, True).option("header", False).csv(path).head(1)
    return tuple(head[0]) if head else ()


def inspect(spark: SparkSession, paths: Sequence[str], latin1_fallback: bool = False) -> list[ExportFile]:
    """Encoding, separator and header of every file; a blank first line is no header.

    A byte order mark says UTF-16 with tabs. With ``latin1_fallback`` a file that is not UTF-8 throughout is Latin-1 with commas.
    """
    starts = _starts(spark, paths) if paths else {}
    files = []
    for path in paths:
        start = starts.get(file_place(path), _Start(b"", True))
        wide = UTF16_MARKS.get(start.line[:2])
        if wide:
            # The line ends before a byte of the line break: a big-endian line has the break's first byte still.
            encoding, separator, line = "UTF-16", "\t", start.line[2 : len(start.line) // 2 * 2].decode(wide, "replace")
        elif latin1_fallback and not start.utf8:
            encoding, separator, line = "ISO-8859-1", ",", start.line.decode("latin-1")
        else:
            encoding, separator = "UTF-8", "\t" if path.lower().endswith(".tsv") else ","
            line = start.line.decode("utf-8", "replace")
        headers = tuple(clean_header(h) for h in _header(spark, path, line, encoding, separator))
        files.append(ExportFile(path, encoding, separator, headers if any(headers) else ()))
    return files


class Fields:
    """Columns of one scan by lower-cased header; the last of several equal headers counts."""

    def __init__(self, headers: Sequence[str], columns: Sequence[str]):
        self.raw = {h: c for h, c in zip(headers, columns) if h}
        self.by_name = {h.lower(): c for h, c in self.raw.items()}

    def has(self, name: str) -> bool:
        return name in self.by_name

    def text(self, *names: str, default: str | None = "") -> Column:
        """First header that exists; an empty cell stays empty, a missing column gives ``default``."""
        for name in names:
            if name in self.by_name:
                return F.coalesce(F.col(self.by_name[name]), F.lit(""))
        return F.lit(default).cast("string")

    def filled(self, *names: str) -> Column:
        """First header whose cell is not empty; NULL when none is."""
        present = [F.col(self.by_name[n]) for n in names if n in self.by_name]
        return first_filled(*present) if present else F.lit(None).cast("string")

    def json(self) -> Column:
        """The whole row as JSON text under its original headers."""
        return F.to_json(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(h) for h, c in self.raw.items()]))


Normaliser = Callable[[DataFrame, Fields], DataFrame]


def read_exports(
    spark: SparkSession, files: Sequence[ExportFile], normalise: Normaliser, multi_line: bool = True
) -> DataFrame | None:
    """Rows of all files with a header, normalised and united; ``None`` when there is no such file.

    Every row carries ``src_file`` and ``src_ord`` (file, block, row in block): the order of arrival. With
    ``multi_line=False`` large clean UTF-8 files are split over tasks and keep that order.
    """
    groups: dict[tuple[str, str, tuple[str, ...]], list[str]] = defaultdict(list)
    for file in files:
        if file.headers:
            groups[(file.encoding, file.separator, file.headers)].append(file.path)
    parts = []
    for (encoding, separator, headers), paths in groups.items():
        columns = [f"c{i}" for i in range(len(headers))]
        whole = multi_line or encoding == "UTF-16"
        rows = (
            _csv(spark, encoding, separator, whole)
            .option("header", True)
            .schema(", ".join(f"{c} string" for c in columns))
            .csv(paths)
            .withColumn("src_file", F.col("_metadata.file_name"))
            .withColumn(
                "src_ord",
                F.struct(
                    F.col("_metadata.file_name").alias("file"),
                    F.col("_metadata.file_path").alias("path"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"),
                ),
            )
        )
        parts.append(normalise(rows, Fields(headers, columns)))
    return reduce(DataFrame.unionByName, parts) if parts else None


def all_headers(files: Sequence[ExportFile]) -> list[str]:
    """Union of the headers in order of first appearance."""
    return list(dict.fromkeys(h for f in files for h in f.headers if h))


def headers_by_file(files: Sequence[ExportFile]) -> Mapping[str, tuple[str, ...]]:
    return {f.name: f.headers for f in files}
