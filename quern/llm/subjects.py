"""Problem 10: the subjects that a document is about, and each one's share of the corpus.

Method: documents are embedded by term weighting (log frequency times inverse
document frequency) and truncated singular value decomposition, found by
subspace iteration: each pass over all documents multiplies the Gram matrix of
the weighted terms with the current basis, in partial sums that are added up a
tree.  The leading axes, the common words of each script, are left out.  Seed
centroids come from the subjects' cues, one for each script; they are refined
iteratively: every sentence, embedded by its topical terms, goes to the most
similar centroid by cosine, and centroids become the mean of their sentences.
A subject is assigned to a document if its share of the document's sentences is
at least ``least_share`` (between a quarter and the tenth of passing mentions).

Everything counts over all documents; only the vocabulary (terms in at least
``least_df`` of the documents, so at most terms per document / least_df of them)
and matrices of its size times ``rank`` reach the driver.

Defined results: null, empty, blank and general texts have no subject; cues that
several subjects list are no seeds; repeated rows give repeated rows; an empty
table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.hangul import strip_particle
from quern.llm.chars import consistent
from quern.runtime import materialize

_WORD = re.compile(r"[가-힣]+|[a-z][a-z]+")
_SENTENCE = re.compile(r"(?<=[.?!])[ \t]+|[\r\n]+")
_AXES = 2  # one for each script: Hangul and Latin
_SCRIPTS = 2
END, OTHER = -1, -2  # in place of a term's place: a sentence's end, a term outside the vocabulary
ROWS = 1000  # rows of a batch that are handled at once


def term_id(term: str) -> int:
    """A term's identifier, never 0: that ends a sentence."""
    return (xxhash.xxh32_intdigest(term) - (1 << 31)) or 1


class Terms(dict):
    """Word to its term's identifier, remembered within a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        t = self[word] = term_id(strip_particle(word))
        return t


def sentences(text: str, terms: Terms) -> list[int]:
    """Identifiers of the terms of each sentence, each sentence ended by 0; sentences without a word are none."""
    out: list[int] = []
    get = terms.__getitem__
    for s in _SENTENCE.split(consistent(text)):
        if words := _WORD.findall(s.lower()):
            out += map(get, words)
            out.append(0)
    return out


def term_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, terms) of every row with a sentence, written once for all passes."""
    kind = dict(df.select(F.col(key).alias("k")).dtypes)["k"]

    def run(batches):
        terms = Terms()
        for b in batches:
            rows = [sentences(x, terms) if x else [] for x in b.column(1).to_pylist()]
            keep = [i for i, r in enumerate(rows) if r]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([rows[i] for i in keep], pa.list_(pa.int32()))], names=[key, "terms"])

    return materialize(df.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, terms array<int>"))


def slices(batches, rows: int = ROWS):
    """Batches in slices of bounded memory."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def cuts(ends: np.ndarray, most: int, cells: int = 4_000_000):
    """(first, last + 1) of runs of rows whose number times that of their terms, by ``ends`` and ``most`` at the most, is up to ``cells``; a row at least."""
    i = 0
    while i < len(ends) - 1:
        j = i + 1
        while j < len(ends) - 1 and (j + 1 - i) * min(most, ends[j + 1] - ends[i]) <= cells:
            j += 1
        yield i, j
        i = j


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(terms of all rows, the row of each) of a batch whose last column is ``terms``."""
    col = b.column(b.num_columns - 1)
    return col.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy()))


def document_counts(table: DataFrame) -> DataFrame:
    """(term, df): in how many rows each term stands; counted in each batch, then added."""

    def run(batches):
        for b in batches:
            t, own = _flat(b)
            own, t = own[t != 0], t[t != 0]
            pairs = np.unique((own.astype(np.int64) << 32) | t.view(np.uint32))
            term, n = np.unique(pairs & 0xFFFFFFFF, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.uint32).view(np.int32)), pa.array(n)], names=["term", "df"])

    return table.select("terms").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


BLOCK = 4096  # rows of a matrix that one part of it holds


def _parts(total: np.ndarray):
    """A matrix as rows (block, part) of at most BLOCK of its rows each."""
    for a in range(0, len(total), BLOCK):
        yield pa.RecordBatch.from_arrays([pa.array([a // BLOCK], pa.int32()), pa.array([total[a : a + BLOCK].astype(np.float64).tobytes()], pa.binary())], names=["block", "part"])


def tree_sum(parts: DataFrame, fan_in: int = 16) -> np.ndarray | None:
    """The sum of matrices given in blocks (block, part), one a partition, added up a tree whose root is what the driver gets."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(x.as_buffer(), np.float64)
                if k in total:
                    total[k] += x
                else:
                    total[k] = x.copy()
        for k, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "part"])

    n = parts.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // fan_in)
        parts = parts.repartition(n).mapInArrow(add, "block int, part binary")
    rows = sorted((k, x) for k, x in parts.collect())  # each block once
    return np.concatenate([np.frombuffer(x, np.float64) for _, x in rows]) if rows else None


class Space:
    """The fitted embedding: vocabulary, weights, term vectors, and the centroids of subjects by script."""

    def __init__(self, vocab: np.ndarray, idf: np.ndarray) -> None:
        self.vocab, self.idf = vocab, idf  # the vocabulary ascends
        self.vectors: np.ndarray | None = None
        self.centroids: np.ndarray | None = None
        self.weights: np.ndarray | None = None
        self.topical: np.ndarray | None = None

    def places(self, t: np.ndarray) -> np.ndarray:
        """Each term's place in the vocabulary, OTHER if it has none, END for the end of a sentence."""
        at = np.minimum(np.searchsorted(self.vocab, t), len(self.vocab) - 1)
        return np.where(self.vocab[at] == t, at, np.where(t == 0, END, OTHER)).astype(np.int32)

    def settle(self) -> None:
        """Topicality of terms: 0 for those like no centroid, 1 for those clearly like one, times idf."""
        best = (self.vectors @ self.centroids.T).max(1)
        self.weights = ((np.clip((best - 0.45) / 0.2, 0.0, 1.0) * self.idf)[:, None] * self.vectors).astype(np.float32)
        self.topical = np.append(self.weights.any(1), False)  # END and OTHER are no place

    def embed(self, at: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sentence vectors, the row of each sentence) of places; only topical terms are looked up."""
        ends = np.flatnonzero(at == END)
        sentence = np.cumsum(at == END) - (at == END)
        topical = np.flatnonzero((at >= 0) & self.topical[at])
        out = np.zeros((len(ends), self.weights.shape[1]), np.float32)
        if len(topical):
            s = sentence[topical]
            starts = np.flatnonzero(np.diff(s, prepend=-1))
            out[s[starts]] = np.add.reduceat(self.weights[at[topical]], starts, axis=0)
        return out, own[ends]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, cosine) of each vector; cosine 0 for zero vectors."""
        norm = np.linalg.norm(vectors, axis=1)
        cos = (vectors @ self.centroids.T.astype(np.float32)) / np.maximum(norm, 1e-9)[:, None]
        k = cos.argmax(1)
        return k, cos[np.arange(len(k)), k]


def fit(table: DataFrame, seeds: list[list[str]], least_df: float = 0.0005, most_df: float = 0.6, rank: int = 48, passes: int = 2, rounds: int = 2, similar: float = 0.6) -> tuple[Space, DataFrame] | None:
    """The space of a term table, and the table with places for terms; ``seeds`` has the cues of each subject."""
    n = table.count()
    counts = document_counts(table).where((F.col("df") >= max(2, least_df * n)) & (F.col("df") <= max(2, most_df * n)))
    rows = sorted((r.term, r.df) for r in counts.collect())  # bounded by ``least_df``
    if not rows:
        return None
    vocab, df = np.array([r[0] for r in rows], np.int32), np.array([r[1] for r in rows], np.float64)
    space = Space(vocab, np.log((n + 1) / (df + 1)) + 1)
    size = len(vocab)
    width = min(rank + 8, size)
    key = table.columns[0]

    def place(batches):
        for b in slices(batches):
            own = b.column(1)
            at = space.places(own.flatten().to_numpy(zero_copy_only=False))
            offsets = own.offsets.to_numpy() - own.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(at))], names=[key, "terms"])

    table = materialize(table.mapInArrow(place, table.schema))
    weight = space.idf.astype(np.float32)
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(size, width)))[0]

    for p in range(passes + 1):
        last = p == passes
        q = basis.astype(np.float32)

        def run(batches, q=q):
            total = np.zeros((size, width))
            for b in slices(batches):
                at, own = _flat(b)
                own, at = own[at >= 0], at[at >= 0]
                ends = np.searchsorted(own, np.arange(b.num_rows + 1))
                for i, j in cuts(ends.tolist(), size):
                    # The columns that these rows have, not the vocabulary: work and memory follow the rows' own terms.
                    cols, at_ = np.unique(at[ends[i] : ends[j]], return_inverse=True)
                    k = len(cols)
                    if not k:
                        continue
                    x = np.bincount((own[ends[i] : ends[j]] - i) * k + at_, minlength=(j - i) * k).reshape(j - i, k).astype(np.float32)
                    x = np.log1p(x, out=x) * weight[cols]
                    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
                    total[cols] += x.T @ (x @ q[cols])
            yield from _parts(total)

        y = tree_sum(table.select("terms").mapInArrow(run, "block int, part binary")).reshape(size, width)
        if last:
            values, turn = np.linalg.eigh(basis.T @ y)
            basis = basis @ turn[:, np.argsort(-values)]
        else:
            basis = np.linalg.qr(y)[0]
    axes = basis[:, _AXES : _AXES + rank] if width > _AXES + 2 else basis
    space.vectors = axes / np.maximum(np.linalg.norm(axes, axis=1, keepdims=True), 1e-9)

    known = [c for cues in seeds for c in {x.lower() for x in cues if x}]
    c = np.zeros((len(seeds) * _SCRIPTS, axes.shape[1]))
    for k, cues in enumerate(seeds):
        for cue in {x.lower() for x in cues if x}:
            at = space.places(np.array([term_id(cue)], np.int32))[0]
            if at >= 0 and known.count(cue) == 1:
                c[_SCRIPTS * k + cue.isascii()] += space.vectors[at]
    space.centroids = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    space.settle()

    for _ in range(rounds):

        def refine(batches):
            total = np.zeros_like(space.centroids)
            for b in slices(batches):
                v, _ = space.embed(*_flat(b))
                k, cos = space.nearest(v)
                for j in np.unique(k[cos > similar]):
                    total[j] += v[(k == j) & (cos > similar)].sum(0)
            yield from _parts(total)

        c = tree_sum(table.select("terms").mapInArrow(refine, "block int, part binary")).reshape(space.centroids.shape)
        norm = np.linalg.norm(c, axis=1, keepdims=True)
        space.centroids = np.where(norm > 0, c / np.maximum(norm, 1e-9), space.centroids)
        space.settle()
    return space, table


def subject_shares(df: DataFrame, key: str, text: str, subjects: DataFrame, least_share: float = 0.175, similar: float = 0.5) -> DataFrame:
    """(key, subject, share, sentences): the subjects of every row with the share of its sentences about each.

    ``subjects`` has (subject, cues); it is a small fixed table of seeds.
    """
    kind = dict(df.select(F.col(key).alias("k")).dtypes)["k"]
    schema = f"`{key}` {kind}, subject string, share double, sentences bigint"
    rows = sorted((r.subject, list(r.cues or [])) for r in subjects.select("subject", "cues").where(F.col("subject").isNotNull()).collect())
    names = [r[0] for r in rows]
    table = term_table(df, key, text)
    fitted = fit(table, [r[1] for r in rows]) if names else None
    if fitted is None:
        return df.sparkSession.createDataFrame([], schema)
    space, table = fitted

    def run(batches):
        for b in slices(batches):
            v, own = space.embed(*_flat(b))
            k, cos = space.nearest(v)
            n = np.bincount(own, minlength=b.num_rows)
            hit = cos > similar
            share = np.bincount(own[hit] * len(names) + k[hit] // _SCRIPTS, minlength=b.num_rows * len(names)).reshape(b.num_rows, len(names)) / n[:, None]
            at, s = np.nonzero(share >= least_share)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), pa.array([names[i] for i in s], pa.string()), pa.array(share[at, s]), pa.array(n[at])], names=[key, "subject", "share", "sentences"]
            )

    return table.mapInArrow(run, schema)


def composition(shares: DataFrame, docs: DataFrame, key: str, source: str) -> DataFrame:
    """(source, subject, n_docs, doc_share): how many documents of each source, and of all (source null), have each subject.

    Documents without a source count in the total alone.
    """
    placed = shares.select(key, "subject").join(docs.select(F.col(key), F.col(source).alias("source")), key)
    total = docs.select(F.col(source).alias("source")).cube("source").agg(F.count("*").alias("n"), F.grouping("source").alias("all_sources"))
    by = placed.cube("source", "subject").agg(F.count("*").alias("n_docs"), F.grouping("source").alias("all_sources"), F.grouping("subject").alias("all_subjects")).where("all_subjects = 0")
    joined = by.join(total, by["source"].eqNullSafe(total["source"]) & (by["all_sources"] == total["all_sources"]))
    return joined.where((by["all_sources"] == 1) | by["source"].isNotNull()).select(by["source"], "subject", "n_docs", (F.col("n_docs") / F.col("n")).alias("doc_share"))
