"""Problem 7: lines that one source repeats in very many documents.

Method: suffix arrays over each source's line identifiers.  A line's identifier is
the hash of its compared form.  Lines that stand in enough documents by
themselves split each document into runs, for only those can be part of a block;
a run's suffixes, of up to ``depth`` lines, are the suffixes of the source's
concatenation.  Equal suffixes are counted together, so a block that a third of
all documents ends with is one row.  The suffixes of one source that begin with
the same line are one bucket of its suffix array: they are sorted, neighbours'
common prefixes make a tree of intervals, and every interval that may span enough
documents is a block.  The documents of each block are then counted exactly,
with map-side combining: no source, however large, is gathered or sorted in one
task.  The lines that blocks cover are the repeated lines.

Defined results: rows without a source or content have no repeated lines; lines
end at LF or CRLF and count from 1, empty ones included; documents of one id
count once; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.chars import transducer
from quern.llm.markup import clean
from quern.runtime import broadcast_below, materialize

#: Dropped at both ends of a line: blanks, brackets, stars and note signs.
EDGE = " \t\r\x0b\x0c[](){}<>【】〔〕「」『』《》〈〉*★☆✱✳※†‡§♪♩♬☞▶■□◆◇●○"
DEPTH = 256  # lines of a suffix: longer blocks come out as overlapping ones of this length
_DIGITS = re.compile(r"\d+")
_BLANKS = re.compile(r"[^\S\n]+")


def line_keys(text: str, least: int = 8) -> list[int]:
    """An identifier for each line of a clean text; 0 for lines with fewer letters and digits than ``least``."""
    out = []
    for ln in _BLANKS.sub(" ", _DIGITS.sub("0", text.lower())).split("\n"):
        ln = ln.strip(EDGE)
        if len(ln) < least or sum(map(str.isalnum, ln)) < least:
            out.append(0)
        else:
            out.append(xxhash.xxh3_64_intdigest(ln) - (1 << 63) or 1)
    return out


def prepared(df: DataFrame, row: str, doc: str, source: str, text: str, title: str | None = None, keep: str | None = None) -> DataFrame:
    """(row_id, id, source, keys[, text]): the identifiers of the lines of contents with consistent characters and no markup.

    ``keep`` adds the "clean" text or the "raw" one.  With ``title`` the text
    begins with the title's line, which has identifier 0.
    """
    kinds = dict(df.select(F.col(row).alias("row_id"), F.col(doc).alias("id")).dtypes)
    src = df.select(F.col(row).alias("row_id"), F.col(doc).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"), *([F.col(title).alias("title")] if title else []))

    def run(batches):
        apply = transducer().apply
        for b in batches:
            texts, keys = [], []
            titles = b.column(4).to_pylist() if title else None
            for i, raw in enumerate(b.column(3).to_pylist()):
                x = clean(apply(raw or ""))
                k = line_keys(x)
                if titles is not None:
                    x = apply(titles[i] or "").replace("\n", " ") + "\n" + x
                    k = [0, *k]
                keys.append(k)
                if keep:
                    texts.append(raw if keep == "raw" else x)
            cols = [b.column(0), b.column(1), b.column(2), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(texts, pa.string())] if keep else []), names=["row_id", "id", "source", "keys"] + ["text"] * bool(keep))

    return src.mapInArrow(run, f"row_id {kinds['row_id']}, id {kinds['id']}, source string, keys array<bigint>" + ", text string" * bool(keep))


def thresholds(df: DataFrame, doc: str, source: str, least_docs: int = 5, least_share: float = 0.05) -> DataFrame:
    """(source, n_docs, need): how many documents a repeated line of each source stands in at least."""
    return (
        df.where(F.col(source).isNotNull())
        .select(F.col(source).alias("source"), F.col(doc).alias("id"))
        .distinct()
        .groupBy("source")
        .agg(F.count("*").alias("n_docs"))
        .withColumn("need", F.greatest(F.lit(least_docs), F.ceil(F.col("n_docs") * F.lit(least_share) - F.lit(1e-9))).cast("long"))
    )


SMALL = 500_000  # rows of a table of sources, lines or blocks that may be broadcast; it is counted first


def _enough(counted: DataFrame, by: list[str], need: DataFrame) -> DataFrame:
    """(by..., need, docs): the groups of rows (source, id, ...) that stand in enough documents.

    Rows are an upper bound of documents: combined on the map side, they leave
    few groups for the exact count.
    """
    rows = counted.groupBy("source", *by).agg(F.count("*").alias("n")).join(need, "source").where("n >= need").drop("n")
    rows = broadcast_below(materialize(rows), SMALL)
    each = counted.select("source", *by, "id").join(rows, ["source", *by]).distinct()
    return each.groupBy("source", *by, "need").agg(F.count("*").alias("docs")).where("docs >= need")


def intervals(suffixes: list[list[int]], docs: list[int], need: int) -> list[tuple[list[int], int]]:
    """(common prefix, documents at most) of the intervals of a suffix array that may span ``need`` documents.

    ``suffixes`` are distinct and begin with the same line; ``docs`` has the
    number of documents of each.  Neighbours' common prefixes are walked with a
    stack of open intervals, so each is closed once.
    """
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    out: list[tuple[list[int], int]] = []
    open_: list[list[int]] = []  # [length, documents, place of a member]

    def close(above: int) -> None:
        while open_ and open_[-1][0] > above:
            length, n, at = open_.pop()
            if n >= need:
                out.append((suffixes[at][:length], n))
            if open_ and open_[-1][0] >= above:
                open_[-1][1] += n
            elif above:
                open_.append([above, n, at])

    for i, at in enumerate(order):
        own = suffixes[at]
        if i:
            before = suffixes[order[i - 1]]
            shared = next((k for k, (x, y) in enumerate(zip(before, own)) if x != y), min(len(before), len(own)))  # the shorter may be all of it
            close(shared)
        open_.append([len(own), docs[at], at])
        if len(open_) > 1 and open_[-2][0] == len(own):  # the one before is a prefix of this length: they are one interval
            length, n, _ = open_.pop()
            open_[-1][1] += n
    close(0)
    return out


def suffix_table(lines: DataFrame, need: DataFrame, depth: int) -> DataFrame:
    """(source, row_id, id, pos, first, suffix, need): the suffixes of every run of lines that stand in enough documents each."""
    spots = lines.where(F.col("source").isNotNull()).withColumn("uid", F.monotonically_increasing_id())
    spots = spots.select("uid", "row_id", "id", "source", F.expr("posexplode(keys) AS (pos, key)")).where("key != 0")
    alive = broadcast_below(materialize(_enough(spots, ["key"], need).drop("docs")), SMALL)
    kept = spots.join(alive, ["source", "key"])
    island = F.col("pos") - F.row_number().over(Window.partitionBy("uid").orderBy("pos"))
    runs = kept.withColumn("island", island).groupBy("uid", "island").agg(F.first("source").alias("source"), F.first("row_id").alias("row_id"), F.first("id").alias("id"), F.first("need").alias("need"), F.sort_array(F.collect_list(F.struct("pos", "key"))).alias("run"))  # a document's lines
    each = runs.select("source", "row_id", "id", "need", F.col("run.pos")[0].alias("start"), F.col("run.key").alias("run"), F.explode(F.sequence(F.lit(1), F.size("run"))).alias("i"))
    return each.select("source", "row_id", "id", "need", (F.col("start") + F.col("i") - 1).alias("pos"), F.get("run", F.col("i") - 1).alias("first"), F.slice("run", F.col("i"), F.lit(depth)).alias("suffix"))


def repeated_blocks(suffixes: DataFrame) -> DataFrame:
    """(source, first, block, length, docs): blocks of successive lines that span enough documents, from a suffix table.

    A block is the common prefix of an interval of the source's suffix array, so
    not all its places go on with the same line.
    """
    distinct = suffixes.select("source", "first", "suffix", "need", "id").distinct().groupBy("source", "first", "suffix", "need").agg(F.count("*").alias("docs"))

    def tree(t: pa.Table) -> pa.Table:
        found = intervals(t.column("suffix").to_pylist(), t.column("docs").to_pylist(), t.column("need")[0].as_py())
        n = len(found)
        return pa.table([pa.array([t.column("source")[0].as_py()] * n, pa.string()), pa.array([t.column("first")[0].as_py()] * n, pa.int64()), pa.array([x for x, _ in found], pa.list_(pa.int64())), pa.array([len(x) for x, _ in found], pa.int32()), pa.array([t.column("need")[0].as_py()] * n, pa.int64())], names=["source", "first", "block", "length", "need"])

    blocks = distinct.groupBy("source", "first").applyInArrow(tree, "source string, first bigint, block array<bigint>, length int, need bigint")
    blocks = broadcast_below(materialize(blocks), SMALL)
    holds = suffixes.drop("need").join(blocks, ["source", "first"]).where(F.slice("suffix", F.lit(1), F.col("length")) == F.col("block"))
    return holds.select("source", "first", "block", "length", "need", "id").distinct().groupBy("source", "first", "block", "length", "need").agg(F.count("*").alias("docs")).where("docs >= need").drop("need")


def _found(df: DataFrame, row: str, doc: str, source: str, text: str, least_docs: int, least_share: float, depth: int, keep: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prepared lines, suffix table, blocks), each written once."""
    need = broadcast_below(materialize(thresholds(df, doc, source, least_docs, least_share).drop("n_docs")), SMALL)
    lines = materialize(prepared(df.where(F.col(source).isNotNull() & F.col(text).isNotNull()), row, doc, source, text, keep=keep))
    suffixes = materialize(suffix_table(lines, need, depth))
    return lines, suffixes, materialize(repeated_blocks(suffixes))


def source_blocks(df: DataFrame, row: str, doc: str, source: str, text: str, least_docs: int = 5, least_share: float = 0.05, depth: int = DEPTH) -> DataFrame:
    """(source, block, length, docs): every source's repeated blocks, lines by identifier, and how many documents have each.

    A block that a longer one with as many documents begins with is left out.
    """
    blocks = _found(df, row, doc, source, text, least_docs, least_share, depth)[2]
    longer = blocks.where("length > 1").select("source", "first", "docs", F.col("block").alias("whole"), F.col("length").alias("more"))
    begins = (F.col("more") > F.col("length")) & (F.slice("whole", F.lit(1), F.col("length")) == F.col("block"))
    every = blocks.join(longer, ["source", "first", "docs"], "left").groupBy("source", "block", "length", "docs").agg(F.coalesce(F.bool_or(begins), F.lit(False)).alias("begins"))
    return every.where("NOT begins").drop("begins")


def repeated_lines(df: DataFrame, row: str, doc: str, source: str, text: str, least_docs: int = 5, least_share: float = 0.05, depth: int = DEPTH) -> DataFrame:
    """(row, line_no) of every line covered by a repeated block of its source."""
    _, suffixes, blocks = _found(df, row, doc, source, text, least_docs, least_share, depth)
    blocks = broadcast_below(blocks.select("source", "first", "block", "length"), SMALL)
    covers = suffixes.join(blocks, ["source", "first"]).where(F.slice("suffix", F.lit(1), F.col("length")) == F.col("block"))
    longest = covers.groupBy("row_id", "pos").agg(F.max("length").alias("length"))
    every = longest.select("row_id", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + F.col("length"))).alias("line_no")).distinct()
    return every.select(F.col("row_id").alias(row), F.col("line_no").cast("long").alias("line_no"))


def source_keys(blocks: DataFrame) -> DataFrame:
    """(source, gone): the identifiers of each source's repeated lines, at most its mean number of lines over ``least_share``."""
    return broadcast_below(materialize(blocks.select("source", F.explode("block").alias("key")).groupBy("source").agg(F.collect_set("key").alias("gone"))), 10_000)


def without_repeated(df: DataFrame, row: str, doc: str, source: str, text: str, least_docs: int = 5, least_share: float = 0.05, depth: int = DEPTH) -> DataFrame:
    """(row, text, removed): every text without its source's repeated lines; the other lines stay as they were."""
    lines, _, blocks = _found(df, row, doc, source, text, least_docs, least_share, depth, keep="raw")
    own = F.split("text", "\n")
    kept = F.filter(own, lambda x, i: ~F.coalesce(F.array_contains("gone", F.get("keys", i)), F.lit(False)))
    cut = lines.join(source_keys(blocks), "source", "left").withColumn("kept", F.when(F.col("gone").isNotNull(), kept)).select(F.col("row_id").alias(row), F.coalesce(F.array_join("kept", "\n"), "text").alias("text"), F.coalesce(F.size(own) - F.size("kept"), F.lit(0)).cast("long").alias("removed"))
    rest = df.where(F.col(source).isNull() | F.col(text).isNull()).select(F.col(row).alias(row), F.col(text).alias("text"), F.lit(0).cast("long").alias("removed"))
    return cut.unionByName(rest)
