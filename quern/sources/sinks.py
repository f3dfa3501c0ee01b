"""Writers: tables as Parquet, exports as JSON, a report, a page."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.vectors import quantize, scale_of


def store(path: str):
    """(file system, path) of a local path or an address of a shared store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _put(path: str, raw: bytes) -> None:
    files, at = store(path)
    files.create_dir(at.rpartition("/")[0], recursive=True)
    with files.open_output_stream(at) as f:
        f.write(raw)


def _get(path: str) -> bytes:
    files, at = store(path)
    with files.open_input_stream(at) as f:
        return f.read()


def safe_name(c):
    """A file name of an identifier: all but letters, digits, _ and - as _."""
    return F.regexp_replace(c, r"(?U)[^\w-]", "_")


def write_records(df: DataFrame, path: str) -> None:
    """A folder for each article with its JSON record, named by its identifier."""
    df.withColumn("file", safe_name(F.col("id"))).write.mode("overwrite").partitionBy("file").json(path)


def write_index(meta: DataFrame, vectors: DataFrame, tags: DataFrame, related: DataFrame, path: str) -> None:
    """The index: document rows, int8 vectors with their scale, tags, related articles."""
    meta.write.mode("overwrite").parquet(f"{path}/doc_meta")
    scaled = vectors.withColumn("scale", scale_of(F.col("vector")))
    scaled.select("row_id", quantize(F.col("vector"), F.col("scale")).alias("q"), F.round("scale", 8).alias("scale")).write.mode("overwrite").parquet(f"{path}/doc_vectors")
    tags.write.mode("overwrite").parquet(f"{path}/tags")
    related.write.mode("overwrite").parquet(f"{path}/related")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def write_npz(vectors: DataFrame, path: str, key: str = "id", vector: str = "vector") -> DataFrame:
    """(file, rows): an npz archive (ids, vectors) for each partition of (key, vector), on a store that all executors share."""
    import io

    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches):
        ids, parts = [], []
        for b in batches:
            ok = b.filter(b.column(1).is_valid())
            if ok.num_rows:
                ids += [str(x) for x in ok.column(0).to_pylist()]
                parts.append(ok.column(1).flatten().to_numpy(zero_copy_only=False).reshape(ok.num_rows, -1).astype(np.float32))
        if ids:
            raw = io.BytesIO()
            np.savez(raw, ids=np.array(ids), vectors=np.concatenate(parts))
            name = f"part-{TaskContext.get().partitionId():05d}.npz"  # a task that runs again writes the same file
            _put(f"{path}/{name}", raw.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ids)], pa.int64())], names=["file", "rows"])

    return vectors.sparkSession.createDataFrame(vectors.select(key, vector).mapInArrow(run, "file string, rows bigint").collect(), "file string, rows bigint")  # one row for each file


def write_layout(places: DataFrame, path: str) -> None:
    """The places of a drawing (id, x, y) as JSON lines."""
    places.write.mode("overwrite").json(path)


def write_packs(sharded: DataFrame, packs: DataFrame, path: str) -> None:
    """Terms (shard, term, ...) in their packs, each pack sorted by shard and term, beside the index (shard, pack, start, bytes); packs of an earlier build go."""
    placed = sharded.join(packs.select("shard", "pack"), "shard")
    placed.repartition("pack").sortWithinPartitions("pack", "shard", "term").write.mode("overwrite").partitionBy("pack").parquet(f"{path}/packs")
    packs.coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def write_checkpoint(spark, seed: int, member, path: str) -> None:
    """A trained member of a seed as one row of the checkpoint table."""
    row = (seed, member.term_scale.tolist(), member.w.ravel().tolist(), member.b.tolist(), member.fb_weight, member.ext_weight)
    spark.createDataFrame([row], "seed int, term_scale array<double>, w array<double>, b array<double>, fb_weight double, ext_weight double").coalesce(1).write.mode("overwrite").parquet(f"{path}/seed={seed}")


def read_checkpoints(spark, path: str) -> list[tuple]:
    """(seed, member) of every checkpoint, by seed."""
    import numpy as np

    from quern.operators.encoder import Member

    rows = spark.read.parquet(path).orderBy("seed").collect()  # one row for each seed
    return [(r.seed, Member(np.array(r.term_scale), np.array(r.w).reshape(len(r.b), -1), np.array(r.b), r.fb_weight, r.ext_weight)) for r in rows]


def write_student(student, terms: list[str], path: str) -> None:
    """A trained encoder: its terms with their vectors and weights, members and projections; checked again on load."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    def put(name, table):
        raw = pa.BufferOutputStream()
        pq.write_table(table, raw)
        _put(f"{path}/{name}", raw.getvalue().to_pybytes())

    scale = np.maximum(np.abs(student.vectors).max(1) / 127, 1e-12)
    q = np.clip(np.rint(student.vectors / scale[:, None]), -127, 127).astype(np.int8)
    put("vocab.parquet", pa.table({"term": terms, "place": list(range(len(terms))), "scale": scale, "q": q.tolist()}))
    put(
        "members.parquet",
        pa.table({"member": list(range(len(student.members))), "term_scale": [m.term_scale.tolist() for m in student.members], "w": [m.w.ravel().tolist() for m in student.members], "b": [m.b.tolist() for m in student.members], "fb_weight": [m.fb_weight for m in student.members], "ext_weight": [m.ext_weight for m in student.members]}),
    )
    _put(f"{path}/meta.json", json.dumps({"version": 2, "dim": int(student.vectors.shape[1]), "out_dim": len(student.members[0].b) if student.members else 0, "members": len(student.members), "vocab_size": len(terms)}).encode())


def read_student(path: str):
    """The encoder that ``write_student`` wrote; lengths that disagree are an error."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from quern.operators.encoder import Member, Student

    table = lambda name: pq.read_table(pa.BufferReader(_get(f"{path}/{name}")))
    meta, vocab, members = json.loads(_get(f"{path}/meta.json")), table("vocab.parquet").to_pydict(), table("members.parquet").to_pylist()
    vectors = np.array(vocab["q"], np.float32) * np.array(vocab["scale"])[:, None]
    if vectors.shape != (meta["vocab_size"], meta["dim"]) or len(members) != meta["members"]:
        raise ValueError(f"the tables do not have the sizes that meta.json tells: {meta}")
    own = []
    for m in members:
        if len(m["term_scale"]) != meta["vocab_size"] or len(m["w"]) != meta["out_dim"] * meta["dim"] or len(m["b"]) != meta["out_dim"]:
            raise ValueError(f"member {m['member']} has other sizes than meta.json tells")
        own.append(Member(np.array(m["term_scale"]), np.array(m["w"]).reshape(meta["out_dim"], meta["dim"]), np.array(m["b"]), m["fb_weight"], m["ext_weight"]))
    return Student(vectors, own), vocab["term"]


def report(metrics: DataFrame, path: str, title: str = "Evaluation") -> str:
    """A small table of metrics as Markdown and JSON; returns the Markdown."""
    rows = [r.asDict() for r in metrics.collect()]  # one row for each evaluation set
    names = metrics.columns
    show = lambda v: f"{v:.3f}" if isinstance(v, float) else str(v)
    text = "\n".join([f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(show(r[n]) for n in names) + " |" for r in rows), ""])
    _put(f"{path}/report.md", text.encode())
    _put(f"{path}/report.json", json.dumps(rows, ensure_ascii=False, default=str).encode())
    return text


def page(template: str, placeholder: str, data: DataFrame) -> str:
    """A page with a drawing's nodes, a bounded number, in the place of ``placeholder``; text cannot end the script it stands in."""
    rows = [r.asDict(recursive=True) for r in data.collect()]
    return template.replace(placeholder, json.dumps(rows, ensure_ascii=False, default=str).replace("</", "<\\/"))


def escape(text: str) -> str:
    return html.escape(text)
