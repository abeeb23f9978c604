"""CSV files of any size whose quoted fields contain line breaks, read in splits.

A split of such a file does not show by itself whether it begins inside quotes.
A first pass works out for each split how it would end from either start, which
is one small row a split; taken in order these say how each split really begins.
A second pass then joins lines into records, each split by itself. Only the
lines of records that cross a border between splits, at most one at either end
of a split, are brought together; all others stay in the task that read them.

Lines end in ``\\n`` or ``\\r\\n``. A quote opens a field only at its start and is
text elsewhere, as for Spark's CSV reader. Where a closing quote is followed by
more text, what the reader makes of it depends on what comes later in the file;
such files are left to it (``read_in_splits`` returns None).
"""

import csv
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Options under which a batch is read, here and as a whole.
OPTIONS = {"header": "true", "enforceSchema": "false", "escape": '"'}


class Malformed(ValueError):
    """A closing quote with more text behind it."""


def inside_after(line: str, inside: bool) -> bool:
    """Whether a line ends inside quotes, given whether it begins there."""
    at, end = 0, len(line)
    while True:
        if not inside:
            if at < end and line[at] == '"':
                inside, at = True, at + 1
            else:
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
        quote = line.find('"', at)
        if quote < 0:
            return True
        rest = line[quote + 1 : quote + 3]
        if rest[:1] == '"':
            at = quote + 2
        elif rest in ("", "\r"):
            return False
        elif rest[0] == ",":
            inside, at = False, quote + 2
        else:
            raise Malformed


@dataclass
class Walk:
    """What one start makes of a split's lines."""

    inside: bool
    lines: int = 0
    #: Lines up to the end of the first and of the last record that ends here.
    first: int | None = None
    last: int = 0
    malformed: bool = False

    def add(self, line: str) -> None:
        self.lines += 1
        if '"' in line and not self.malformed:
            try:
                self.inside = inside_after(line, self.inside)
            except Malformed:
                self.malformed = True
        if not self.inside:
            self.first = self.lines if self.first is None else self.first
            self.last = self.lines


@dataclass(frozen=True)
class Split:
    """How a split really lies in its file, counted in lines."""

    #: Lines that end the record begun in split ``owner``; where an unfinished record begins.
    head: int
    tail: int
    owner: int
    crlf: bool


_WALKS = (
    "path string, start long, crlf boolean, lines long, "
    + ", ".join(f"inside{k} boolean, first{k} long, last{k} long, malformed{k} boolean" for k in (0, 1))
)
_LINES = "file string, path string, start long, value string"
_RECORDS = "file string, start long, seq long, text string"
_PARTS = "file string, path string, owner long, start long, seq long, value string"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


def _batch(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    schema = _schema(ddl)
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, int, int, list[str]]]:
    """(file, path, start of the split, lines of it before, lines); a task may read several splits."""
    current, before = None, 0
    for batch in batches:
        files, paths, starts, values = (batch.column(k) for k in range(4))
        at = 0
        while at < batch.num_rows:
            split = (paths[at].as_py(), starts[at].as_py())
            if split != current:
                current, before = split, 0
            # The rows of this split: all, unless another one begins in the batch.
            end = batch.num_rows
            if (paths[end - 1].as_py(), starts[end - 1].as_py()) != split:
                end = at + 1
                while (paths[end].as_py(), starts[end].as_py()) == split:
                    end += 1
            yield files[at].as_py(), *split, before, values.slice(at, end - at).to_pylist()
            before += end - at
            at = end


def _lines(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(root).select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        "value",
    )


def _walks(lines: DataFrame) -> DataFrame:
    """One row a split: what either start makes of it."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, both, crlf = None, (), False

        def row() -> tuple:
            ends = [x for w in both for x in (w.inside, w.first, w.last, w.malformed)]
            return (*current, crlf, both[0].lines, *ends)

        for _, path, start, before, values in _splits(batches):
            if (path, start) != current:
                if current:
                    yield _batch(_WALKS, [row()])
                current, both = (path, start), (Walk(False), Walk(True))
                crlf = values[0].endswith("\r")
            for line in values:
                for walked in both:
                    walked.add(line)
        if current:
            yield _batch(_WALKS, [row()])

    return lines.mapInArrow(walk, _WALKS)


def place_splits(walks: list) -> dict[tuple[str, int], Split] | None:
    """How each split begins, from the splits before it; None for a malformed file."""
    placed: dict[tuple[str, int], Split] = {}
    path, inside, owner, crlf = None, False, 0, False
    for row in sorted(walks, key=lambda w: (w["path"], w["start"])):
        if row["path"] != path:
            path, inside, owner, crlf = row["path"], False, row["start"], row["crlf"]
        end, first, last, malformed = (
            row[f"{name}{int(inside)}"] for name in ("inside", "first", "last", "malformed")
        )
        if malformed:
            return None
        if first is None:  # no record ends here: all of it belongs to one begun before
            whole = row["lines"]
            placed[path, row["start"]] = (
                Split(whole, whole, owner, crlf) if inside else Split(0, 0, row["start"], crlf)
            )
            owner = owner if inside else row["start"]
        else:
            placed[path, row["start"]] = Split(first if inside else 0, last, owner, crlf)
            owner = row["start"]
        inside = end
    return placed


def _same_header(text: str, columns: list[str]) -> bool:
    """Whether a file's header gives these columns; blank and repeated names are numbered."""
    names = next(csv.reader([text]), [])
    return len(names) == len(columns) and all(
        not name or column.lower() in (name.lower(), f"{name}{at}".lower())
        for at, (name, column) in enumerate(zip(names, columns, strict=True))
    )


def _place(placed: dict[tuple[str, int], Split], path: str, start: int) -> Split:
    if (path, start) not in placed:
        raise RuntimeError(
            f"{path} is split otherwise than before; set spark.sql.files.minPartitionNum"
        )
    return placed[path, start]


def _records(lines: DataFrame, placed: dict[tuple[str, int], Split], columns: list[str]) -> DataFrame:
    """Records that lie in one split, without headers."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, inside, header = None, [], False, False
        for file, path, start, before, values in _splits(batches):
            split = _place(placed, path, start)
            if (path, start) != current:
                current, held, inside, header = (path, start), [], False, start == 0
            out = []
            low, high = max(split.head - before, 0), min(split.tail - before, len(values))
            for at, line in enumerate(values[low:high], before + low):
                if not held:
                    began = at
                if '"' in line:
                    inside = inside_after(line, inside)
                if split.crlf:
                    line = line.removesuffix("\r")
                if inside:
                    held.append(line)
                    continue
                if held:
                    line = "\n".join([*held, line])
                    held = []
                if header and line:
                    header = False
                    if not _same_header(line, columns):
                        raise ValueError(f"{path}: another header than {columns}")
                elif line:
                    out.append((file, start, began, line))
            if out:
                yield _batch(_RECORDS, out)

    return lines.mapInArrow(join, _RECORDS)


def _crossing(lines: DataFrame, placed: dict[tuple[str, int], Split]) -> DataFrame:
    """Records that cross a border between splits, put together from their lines."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, path, start, before, values in _splits(batches):
            split = _place(placed, path, start)
            out = []
            for owner, low, high in (
                (split.owner, 0, split.head),
                (start, split.tail, before + len(values)),
            ):
                low, high = max(low - before, 0), max(high - before, 0)
                for at, line in enumerate(values[low:high], before + low):
                    line = line.removesuffix("\r") if split.crlf else line
                    out.append((file, path, owner, start, at, line))
            if out:
                yield _batch(_PARTS, out)

    part = F.struct("start", "seq", "value")
    parts = F.sort_array(F.collect_list(part))
    return (
        lines.mapInArrow(cut, _PARTS)
        .groupBy("path", F.col("owner").alias("begin"))
        .agg(F.first("file").alias("file"), parts.alias("parts"))
        .select(
            "file",
            F.col("begin").alias("start"),
            F.col("parts")[0]["seq"].alias("seq"),
            F.array_join(F.col("parts.value"), "\n").alias("text"),
        )
    )


def read_in_splits(spark: SparkSession, root: str, columns: list[str]) -> DataFrame | None:
    """(part, seq, columns): the records of a file or folder under its header's names.

    ``part`` and ``seq`` give their order in the files. None where a file's quotes
    can't be followed split by split. The driver gets one row for each split.
    """
    lines = _lines(spark, root)
    placed = place_splits([row.asDict() for row in _walks(lines).collect()])
    if placed is None:
        return None
    # The header itself may cross the first border; then it is the first record put together.
    long_headers = [path for (path, start), s in placed.items() if start == 0 and s.tail == 0]
    if long_headers:
        return None
    crossing = _crossing(lines, placed)
    rows = _records(lines, placed, columns).unionByName(crossing)
    schema = ", ".join(f"c{k} string" for k in range(len(columns)))
    parsed = rows.withColumn("row", F.from_csv("text", schema, {"escape": OPTIONS["escape"]}))
    return parsed.select(
        F.concat("file", F.lit("@"), F.lpad(F.col("start").cast("string"), 19, "0")).alias("part"),
        "seq",
        *(F.col(f"row.c{k}").alias(name) for k, name in enumerate(columns)),
    )
