"""Problem 3: how often every term occurs, in how many records, and which terms are too rare or too common.

Method: last-seen counters.  Tokens are hash-partitioned by term and ordered by
term and record; a counter for each term holds its occurrences, its records and
the last record seen, and a token of another record than the last adds a record.
No set of records is kept.  A term's tokens are spread over ``salts`` partitions
by a hash of the record, so a term of a third of all tokens burdens no single
task; every record falls into one of them, so the partial counters just add up.
Repeats within one batch are combined before the shuffle.

Defined results: terms compare lower-cased and trimmed; null, empty and blank
terms and null arrays do not count; rows of a null record count as occurrences
but as no record; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"


def _combine(batches):
    """(term, record, n) with the repeats of each batch combined."""
    for b in batches:
        owner = b.column(1).value_parent_indices()
        t = pa.table({"term": b.column(1).flatten(), "record": b.column(0).take(owner)})
        g = t.group_by(["term", "record"]).aggregate([([], "count_all")])
        yield from g.select(["term", "record", "count_all"]).rename_columns(["term", "record", "n"]).to_batches()


def _count(batches):
    """(term, occurrences, records) of tokens ordered by term and record; a run may go on in the next batch."""
    last_term = last_record = None
    occ = rec = 0
    for b in batches:
        if not b.num_rows:
            continue
        term, record, n = b.column(0), b.column(1), b.column(2).to_numpy()
        new_term = np.ones(b.num_rows, bool)
        new_record = np.ones(b.num_rows, bool)
        new_term[1:] = pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
        same = pc.fill_null(pc.equal(record[1:], record[:-1]), False).to_numpy(zero_copy_only=False)
        new_record[1:] = new_term[1:] | ~same
        first_term, first_record = term[0].as_py(), record[0].as_py()
        new_term[0] = first_term != last_term
        new_record[0] = new_term[0] or first_record != last_record
        new_record &= record.is_valid().to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new_term)
        head = int(starts[0]) if len(starts) else b.num_rows
        occ += int(n[:head].sum())
        rec += int(new_record[:head].sum())
        if len(starts):
            o, r = np.add.reduceat(n, starts), np.add.reduceat(new_record.astype(np.int64), starts)
            names = term.take(pa.array(starts))
            done = pa.concat_arrays([pa.array([last_term] if last_term is not None else [], pa.string()), names[:-1]])
            occs, recs = [occ] * (last_term is not None) + o[:-1].tolist(), [rec] * (last_term is not None) + r[:-1].tolist()
            yield pa.RecordBatch.from_arrays([done, pa.array(occs, pa.int64()), pa.array(recs, pa.int64())], names=["term", "occurrences", "records"])
            last_term, occ, rec = names[-1].as_py(), int(o[-1]), int(r[-1])
        last_record = record[b.num_rows - 1].as_py()
    if last_term is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last_term]), pa.array([occ], pa.int64()), pa.array([rec], pa.int64())], names=["term", "occurrences", "records"])


def term_frequencies(df: DataFrame, record: str, arrays: list[str], rare_below: int = 2, common_above: float = 0.6, salts: int | None = None) -> DataFrame:
    """(term, occurrences, df, n_docs, mark): mark is rare, common or kept.

    ``salts`` defaults to the session's number of shuffle partitions, so the
    tokens of one term may spread over all of them.
    """
    salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = df.select(F.col(record).cast("string").alias("record"), F.concat(*(F.coalesce(F.col(a), F.array().cast("array<string>")) for a in arrays)).alias("terms"))
    clean = F.filter(F.transform(F.filter("terms", lambda x: x.isNotNull()), lambda x: F.lower(F.btrim(x, F.lit(BLANKS)))), lambda x: x != "")
    tokens = src.select("record", clean.alias("terms")).where(F.size("terms") > 0).mapInArrow(_combine, "term string, record string, n bigint")
    counters = (
        tokens.repartition("term", F.pmod(F.xxhash64("record"), F.lit(salts)))
        .sortWithinPartitions("term", "record")
        .mapInArrow(_count, "term string, occurrences bigint, records bigint")
        .groupBy("term")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("df"))
    )
    n = df.select(F.col(record).alias("record")).where("record IS NOT NULL").distinct().agg(F.count("*").alias("n_docs"))
    mark = F.when(F.col("df") < rare_below, "rare").when(F.col("df") > F.lit(common_above) * F.col("n_docs"), "common").otherwise("kept")
    return counters.crossJoin(F.broadcast(n)).select("term", "occurrences", "df", "n_docs", mark.alias("mark"))  # one row beside each
