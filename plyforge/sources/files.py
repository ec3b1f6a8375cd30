"""Readers of the text formats of match evidence. Each names its rows by file and place, never by arrival."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyforge.functions import uci
from plyforge.functions.boards import fen_key
from plyforge.operators.skew import BROADCAST_KEYS
from plyforge.session import cut, map_arrow

#: Columns a rescored table must have.
SELECTOR_COLUMNS = ("fen", "source", "sf_score_type", "sf_score", "sf_bound", "sf_wdl_w", "sf_wdl_d", "sf_wdl_l", "sf_bestmove")


class MissingColumns(ValueError):
    """A table without the columns it must have."""


class NoRows(ValueError):
    """A table that must have rows and has none."""


#: Ends of lines as Spark's reader takes them, and LF alone.
ANY_END, LF = None, "\n"


def block_lines(spark: SparkSession, path: str, line_sep: str | None = ANY_END) -> DataFrame:
    """Written table (``file``, ``block``, ``ln`` from 1, ``line``, ``file_size``): the lines of files of any size, numbered as they stand.

    Files are read in splits. A split is read in order, so a line's place in it
    is known from the running number of rows; its number in the file follows
    from the sizes of the splits before (one row for each split). What was read
    is written down first: splits are planned anew in every job, and numbers of
    two plans needn't agree. A final line end doesn't begin another line.
    """
    reader = spark.read.option("lineSep", line_sep) if line_sep else spark.read
    m = F.col("_metadata")
    raw = reader.text(path).select(
        m["file_path"].alias("file"), m["file_block_start"].alias("block"), m["file_size"].alias("file_size"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line")
    )
    raw = cut(raw, "lines")
    blocks = raw.groupBy("file", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"))
    blocks = cut(blocks, "blocks")
    near = F.broadcast if blocks.count() <= BROADCAST_KEYS else (lambda x: x)
    return raw.join(near(blocks), ["file", "block"]).select("file", "block", (F.col("row") + F.col("shift")).alias("ln"), "line", "file_size")


def numbered_lines(spark: SparkSession, path: str, line_sep: str | None = ANY_END) -> DataFrame:
    """(``file``, ``ln`` from 1, ``line``): the lines of each file, ended by LF, CR LF or CR unless ``line_sep`` says otherwise."""
    return block_lines(spark, path, line_sep).select("file", "ln", "line")


def lines_of(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ``ln`` from 1, ``line``) of a text column; LF, CR LF and CR end lines."""
    t = F.regexp_replace(text, r"(?:\r\n|\n|\r)\z", "")
    return docs.filter(F.col(text) != "").select(
        key, F.posexplode(F.split(t, r"\r\n|\n|\r")).alias("i", "line")
    ).select(key, (F.col("i") + 1).alias("ln"), "line")


def lines_with(docs: DataFrame, key: str, word: str, text: str = "text") -> DataFrame:
    """:func:`lines_of`, of which only those that hold ``word``; texts without it are never split."""
    return lines_of(docs.filter(F.col(text).contains(word)), key, text).filter(F.col("line").contains(word))


#: Where Python's str.splitlines() ends a line, besides those of the reader.
UNICODE_LINES = r"[\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"


def read_epd(spark: SparkSession, path: str) -> DataFrame:
    """(``file``, ``ln``, ``line``, ``key``) of the non-blank lines of opening lists; null key for a malformed one.

    Rarer line ends split a line further: the number of such ends before it in
    its file is added to its own.
    """
    lines = block_lines(spark, path)
    more = lines.filter(F.col("line").rlike(UNICODE_LINES)).select(
        "file", "ln", (F.size(F.split("line", UNICODE_LINES, -1)) - 1).cast("bigint").alias("more")
    )
    more = cut(more, "more")
    if more.limit(1).count():
        # few lines have such ends; each counts for all lines behind it
        order = Window.partitionBy("file").orderBy("ln")
        upto = more.withColumn("before", F.sum("more").over(order) - F.col("more"))
        every = lines.join(upto, ["file", "ln"], "left")
        ahead = F.last(F.col("before") + F.col("more"), ignorenulls=True).over(
            Window.partitionBy("file", "block").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
        )
        within = every.withColumn("shift", F.coalesce(F.col("before"), ahead))
        ends = upto.join(
            lines.select("file", "ln", "block"), ["file", "ln"]
        ).groupBy("file", "block").agg(F.max(F.col("before") + F.col("more")).alias("end"))
        blocks = lines.select("file", "block").distinct().join(ends, ["file", "block"], "left")
        carried = blocks.select(
            "file", "block",
            F.last("end", ignorenulls=True).over(
                Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
            ).alias("carried")
        )
        within = within.join(carried, ["file", "block"]).withColumn("ln", F.col("ln") + F.coalesce("shift", "carried", F.lit(0)))
        lines = within.select(
            "file", "ln", F.posexplode(F.split("line", UNICODE_LINES, -1)).alias("i", "line")
        ).select("file", (F.col("ln") + F.col("i")).alias("ln"), "line")
    lines = lines.select("file", "ln", F.trim("line").alias("line")).filter("line != ''")
    return lines.withColumn("key", fen_key(F.col("line")))


def read_tsv(spark: SparkSession, path: str, required: tuple[str, ...] = (), keep_empty: bool = True, some: bool = False) -> DataFrame:
    """A tab-separated table with header, all columns as text, with ``file``.

    A byte-order mark is skipped. Empty fields are empty texts, as the format
    means them, unless ``keep_empty`` is false. Missing required columns are
    refused before any row is read, and with ``some`` a table without rows.
    """
    df = spark.read.csv(path, sep="\t", header=True, quote="", enforceSchema=False, multiLine=False)
    missing = sorted(set(required) - {c.lstrip("\ufeff") for c in df.columns})
    if missing:
        raise MissingColumns(f"missing columns: {missing}")
    out = df.select(
        *[(F.coalesce(F.col(f"`{c}`"), F.lit("")) if keep_empty else F.col(f"`{c}`")).alias(c.lstrip("\ufeff")) for c in df.columns],
        F.col("_metadata.file_path").alias("file")
    )
    if some and not out.limit(1).count():
        raise NoRows("the table has no rows")
    return out


def read_manifest(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """A batch list: at least one row, and every required column."""
    return read_tsv(spark, path, required, some=True)


def first_row(df: DataFrame, order: list[str]) -> DataFrame:
    """The first row in a stated order, or none."""
    return window_of_rows(df, order, 0, 1)


def read_tsv_numbered(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """As :func:`read_tsv`, with the physical ``row_number`` (the header is row 1).

    Numbers come from :func:`block_lines`; use it where ties are broken by row.
    """
    lines = numbered_lines(spark, path)
    heads = lines.filter("ln = 1").select("file", F.split(F.regexp_replace("line", "^\ufeff", ""), "\t").alias("names"))
    first = heads.first()
    if first is None:
        raise MissingColumns("no header")
    missing = sorted(set(required) - set(first.names))
    if missing:
        raise MissingColumns(f"missing columns: {missing}")
    values = F.split("line", "\t")
    rows = lines.filter("ln > 1 and line != ''")
    return rows.select(
        "file", F.col("ln").alias("row_number"),
        *[F.coalesce(F.get(values, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(first.names)]
    )


def window_of_rows(df: DataFrame, order: list[str], skip: int = 0, limit: int | None = None) -> DataFrame:
    """Rows from the given place on, in a stated order."""
    df = df.orderBy(*order).offset(skip)
    return df if limit is None else df.limit(limit)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Engine transcripts, one search a file: (``file``, ``ln``, ``line``, ``info``, ``best``)."""
    return with_uci(numbered_lines(spark, path))


def with_uci(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"info": uci.mining_info(F.col("line")), "best": uci.best_move(F.col("line"))})


def static_results(lines: DataFrame, by: list[str]) -> DataFrame:
    """Per transcript: ``status`` (ok, in_check, parse_error) and the last raw score of the side to move."""
    score = uci.static_score(F.col("line"))
    g = lines.groupBy(*by).agg(F.max_by(score, F.when(score.isNotNull(), F.col("ln"))).alias("s"), F.bool_or(uci.in_check(F.col("line"))).alias("c"))
    return g.select(
        *by, F.when(F.col("c"), "in_check").when(F.col("s").isNull(), "parse_error").otherwise("ok").alias("status"),
        F.when(~F.col("c"), F.col("s")).alias("score_raw_stm")
    )


def displayed_positions(lines: DataFrame, by: list[str]) -> DataFrame:
    """Per transcript the first position it displays."""
    fen = uci.displayed_fen(F.col("line"))
    return lines.groupBy(*by).agg(F.min_by(fen, F.when(fen.isNotNull(), F.col("ln"))).alias("fen"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(``file``, ``ln``, ``line``, ``record``, ``problem``): one JSON object a line, of files of any size.

    Lines end with LF only. ``problem`` is ``blank``, ``json``, ``unfinished``
    or null; the last is told of the last line of a file that doesn't end with
    LF: its size is one less than its lines and their ends.
    """
    lines = block_lines(spark, path, LF)
    size = F.sum(F.octet_length("line") + 1)
    ends = lines.groupBy("file").agg(F.max("ln").alias("last"), (F.max("file_size") - size).alias("over"))
    lines = lines.join(ends, "file").withColumn("record", F.from_json("line", schema))
    # a byte-order mark of three bytes is skipped by the reader
    cut_off = (F.col("ln") == F.col("last")) & F.col("over").isin(-1, 2)
    problem = F.when(F.trim("line") == "", "blank").when(F.try_parse_json("line").isNull(), "json").when(cut_off, "unfinished")
    return lines.select("file", "ln", "line", "record", problem.alias("problem"))


def ledger_problems(lines: DataFrame, required: tuple[str, ...], unique: tuple[str, ...] = ("run_id", "record_id")) -> DataFrame:
    """(``file``, ``ln``, ``problem``) of everything that makes a ledger (:func:`read_jsonl`) unfit as a whole; empty for a sound one.

    The reader's problems; ``missing <field>`` of a record; ``repeated <field>``
    of every line but the first that holds a value of a unique field.
    """
    found = [lines.filter("problem is not null").select("file", "ln", "problem")]
    sound = lines.filter("problem is null")
    missing = F.array_compact(F.array(*[F.when(F.col(f"record.{c}").isNull(), F.lit(f"missing {c}")) for c in required]))
    found.append(sound.select("file", "ln", F.explode(missing).alias("problem")))
    for c in unique:
        held = sound.filter(F.col(f"record.{c}").isNotNull()).select("file", "ln", F.col(f"record.{c}").alias("value"))
        # lines of values met more than once, less the first of each
        again = held.groupBy("value").agg(F.min(F.struct("file", "ln")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        later = held.join(again, "value").filter(F.struct("file", "ln") != F.col("first"))
        found.append(later.select("file", "ln", F.lit(f"repeated {c}").alias("problem")))
    return reduce(DataFrame.unionByName, found)


def state_problems(lines: DataFrame, states: tuple[str, ...], state: str = "state", name: str = "run_id", suffix: str = ".jsonl") -> DataFrame:
    """(``file``, ``ln``, ``problem``) of state histories, a file for each run: the reader's, ``other run`` and ``unknown state``."""
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), rf"\Q{suffix}\E\z", "")
    own = F.coalesce(F.col(f"record.{name}") == F.url_decode(stem), F.lit(False))
    known = F.coalesce(F.col(f"record.{state}").isin(*states), F.lit(False))
    problem = F.coalesce(F.col("problem"), F.when(~own, "other run").when(~known, "unknown state"))
    return lines.select("file", "ln", problem.alias("problem")).filter("problem is not null")


def read_documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(``file``, ``text``, ``problem``): whole JSON documents; CR bytes and bytes that are no UTF-8 are refused."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    text: Column = F.try_validate_utf8(F.col("content").cast("string"))
    problem = F.when(text.isNull(), "utf8").when(text.contains("\r"), "carriage_return").when(F.try_parse_json(text).isNull(), "json")
    return raw.select(F.col("path").alias("file"), text.alias("text"), problem.alias("problem"))


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(``path`` below the root, ``sha256``, ``size_bytes``) of every file of a tree.

    Names are listed without reading the files; contents of any length are
    hashed in blocks of a mebibyte where the tasks run, a file a row. Links are
    resolved by the file system; callers that must refuse them check on the
    driver with :func:`odd_files`.
    """
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size_bytes"))
    schema = names.schema.add("sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = [sha256_of(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.string())], schema.names)

    spread = names.repartition(max(1, spark.sparkContext.defaultParallelism), "path")
    hashed = map_arrow(spread, run, schema)
    base = "file:" + root.removeprefix("file://").rstrip("/") + "/" if root.startswith(("/", "file://")) else root.rstrip("/") + "/"
    neutral = F.regexp_replace(F.col("path"), r"\Afile:/*", "file:/")
    return hashed.select(F.substr(neutral, F.lit(len(base) + 1)).alias("path"), "sha256", "size_bytes")


def sha256_of(uri: str, block: int = 1 << 20) -> str:
    """Digest of a file on any file system that Arrow can open."""
    import hashlib
    from urllib.parse import unquote

    from pyarrow import fs

    system, path = (fs.LocalFileSystem(), unquote(uri[5:])) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)
    digest = hashlib.sha256()
    with system.open_input_stream("/" + path.lstrip("/") if uri.startswith("file:") else path) as f:
        while data := f.read(block):
            digest.update(data)
    return digest.hexdigest()


def odd_files(root: str) -> list[str]:
    """Links and special files below a root, by relative path; driver-side, names only."""
    import os

    out = []
    for at, folders, files in os.walk(root):
        for name in [*folders, *files]:
            p = os.path.join(at, name)
            if os.path.islink(p) or not (os.path.isdir(p) or os.path.isfile(p)):
                out.append(os.path.relpath(p, root).replace(os.sep, "/"))
    return sorted(out)
