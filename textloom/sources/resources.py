"""Readers and writers of texts, rules, lexicons, lists and counts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.lexicon import Lexicon, Unit
from textloom.operators.rules import Rule, parse
from textloom.operators.vocabulary import load_counts
from textloom.session import checkpointed


def read_documents(spark: SparkSession, path: str, extension: str | None = None) -> DataFrame:
    """path, text: a whole file a row, of a file or a folder, by extension."""
    reader = spark.read.option("recursiveFileLookup", True)
    if extension:
        reader = reader.option("pathGlobFilter", f"*.{extension.lstrip('.')}")
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, text: a line a row."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _text(spark: SparkSession, path: str) -> list[str]:
    """Lines of one resource file, in order."""
    rows = spark.read.text(path, wholetext=True).collect()
    return [line for r in rows for line in r[0].split("\n")]


def read_rules(spark: SparkSession, path: str, **options) -> list[Rule]:
    return parse(_text(spark, path), **options)


def read_list(spark: SparkSession, path: str) -> list[str]:
    """One entry a line; comments and blank lines are skipped."""
    return [x.split("#")[0].rstrip() for x in _text(spark, path) if x.split("#")[0].strip()]


def read_lexicon(spark: SparkSession, words: str, pos: str | None = None, proper: str | None = None) -> Lexicon:
    """Words (first tab column, ``_`` for a blank), parts of speech and proper names.

    Words with a capital are names too.
    """
    entries = [x.split("\t")[0].replace("_", " ") for x in _text(spark, words) if x and not x.startswith("#")]
    tags: dict[str, set[str]] = {}
    for line in _text(spark, pos) if pos else []:
        word, _, kinds = line.partition("\t")
        if word and not word.startswith("#"):
            tags.setdefault(word, set()).update(kinds.split())
    names = {w for w in entries if w[:1].isupper()} | set(read_list(spark, proper) if proper else [])
    for n in names:
        tags.setdefault(n, set()).add("NP")
    return Lexicon(frozenset(entries), {w: frozenset(t) for w, t in tags.items()}, frozenset(names))


def read_units(spark: SparkSession, path: str) -> tuple[Unit, ...]:
    """symbol, expansion, and UNRELIABLE or PLURAL= flags; the last of equal symbols wins."""
    out = {}
    for line in read_list(spark, path):
        fields = [f for f in re.split(r"[ \t]*[,\t][ \t]*", line.strip()) if f]
        if len(fields) < 2:
            continue
        symbol, name = fields[0].replace("\\", ""), fields[1]
        flags = " ".join(fields[2:])
        m = re.search(r"\bPLURAL=(.*?)(?:$|\t)", f"{name} {flags}")
        reliable = "UNRELIABLE" not in f"{name} {flags}"
        name = re.sub(r"\s*(?:UNRELIABLE|PLURAL=.*)$", "", name)
        out[symbol] = Unit(symbol, name, m[1].strip() if m else name + "s", reliable)
    return tuple(sorted(out.values(), key=lambda u: (-len(u.symbol), u.symbol)))


def read_counts(spark: SparkSession, path: str, min_count: int = 1, order: int = 2) -> DataFrame:
    """ngram, c from tab-separated files."""
    raw = spark.read.option("sep", "\t").option("quote", "").schema("ngram string, c long").csv(path)
    return load_counts(raw.where("ngram IS NOT NULL AND c IS NOT NULL"), min_count, order)


def write_texts(df: DataFrame, column: str, path: str, by: str | None = None) -> None:
    """Text files; with ``by``, a folder for each of its values."""
    out = df.select(F.col(column).alias("value"), *([by] if by else []))
    writer = out.write.mode("append")
    (writer.partitionBy(by) if by else writer).text(path)


def write_tag_classes(bodies: DataFrame, path: str) -> None:
    """Bodies (tag, body) in a folder a tag."""
    bodies.select("tag", F.col("body").alias("value")).write.mode("overwrite").partitionBy("tag").text(path)


def write_mirrored(df: DataFrame, path_column: str, column: str, root: str, target: str, extension: str | None = None) -> DataFrame:
    """A file for each row, at its path below ``root`` mirrored below ``target``; path and bytes of each.

    ``extension`` takes the place of the path's own.  Files appear under their names when
    whole, so a task that runs again leaves no part of one.  A null text writes an empty
    file; a path outside ``root``, or a null one, is an error.
    """
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    above, below = (jvm.org.apache.hadoop.fs.Path(p) for p in (root, target))
    above, below = (p.getFileSystem(conf).makeQualified(p).toString().rstrip("/") for p in (above, below))
    place = above.split(":", 1)[-1].lstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = pafs.FileSystem.from_uri(below if "://" in below else below.replace("file:", "file://", 1))
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            sizes, names = [], []
            for path, text in zip(batch["path"].to_pylist(), batch["text"].to_pylist()):
                own = (path or "").split(":", 1)[-1].lstrip("/")
                if not own.startswith(place + "/"):
                    raise ValueError(f"{path} is not below {root}")
                own = own[len(place) + 1 :]
                own = own if extension is None else re.sub(r"\.[^./]*$", "", own) + "." + extension.lstrip(".")
                name = f"{base.rstrip('/')}/{own}"
                fs.create_dir(name.rpartition("/")[0], recursive=True)
                data = (text or "").encode()
                with fs.open_output_stream(f"{name}.{attempt}.part") as out:
                    out.write(data)
                fs.move(f"{name}.{attempt}.part", name)
                names.append(f"{below}/{own}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])

    rows = df.select(F.col(f"`{path_column}`").alias("path"), F.col(f"`{column}`").alias("text"))
    return checkpointed(rows.mapInArrow(write, "path string, bytes long"))
