"""Training the student: query synthesis, leak removal, ridge start, distillation with early stopping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators.encoder import Member, Student
from quern.runtime import numbered


def near_duplicates(train: DataFrame, held: DataFrame, least: float = 0.6) -> DataFrame:
    """(train_id, eval_id, jaccard): training items whose token set is like an evaluation item's.

    Both sides have (id, tokens).  Items meet by their rarest tokens only: two
    sets of this similarity share one among the first n - ceil(least n) + 1 of
    each, in one order from rare to frequent.  So a token that most items have
    brings none of them together.
    """
    one = lambda df: df.select("id", F.array_distinct("tokens").alias("x")).where(F.size("x") > 0)
    a, b = one(train), one(held)
    counts = a.select(F.explode("x").alias("t")).unionByName(b.select(F.explode("x").alias("t"))).groupBy("t").agg(F.count("*").alias("f"))

    def rare(df, name):
        ranked = df.select("id", F.size("x").alias("n"), F.explode("x").alias("t")).join(counts, "t").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("s"))  # an item's tokens
        return ranked.select(F.col("id").alias(name), F.explode(F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.lit(least) * F.col("n") - F.lit(1e-9)) + 1).cast("int"))).alias("s")).select(name, F.col("s.t").alias("t"))

    pairs = rare(a, "train_id").join(rare(b, "eval_id"), "t").select("train_id", "eval_id").distinct()
    both = pairs.join(a.select(F.col("id").alias("train_id"), F.col("x").alias("l")), "train_id").join(b.select(F.col("id").alias("eval_id"), F.col("x").alias("r")), "eval_id")
    c = F.size(F.array_intersect("l", "r"))
    return both.withColumn("jaccard", c / (F.size("l") + F.size("r") - c)).where(F.col("jaccard") >= least).select("train_id", "eval_id", "jaccard")


def without_leaks(train: DataFrame, held: DataFrame, least: float = 0.6) -> DataFrame:
    """Training items (id, text, tokens) that no evaluation item equals or is like."""
    clean = train.join(held.select("text").distinct(), "text", "left_anti")
    return clean.join(near_duplicates(clean, held, least).select(F.col("train_id").alias("id")).distinct(), "id", "left_anti")


def held_items(sets: list[DataFrame]) -> DataFrame:
    """(id, text, tokens) of several evaluation sets (id, text): the union that training must not see; equal texts once."""
    every = sets[0].select("id", "text")
    for x in sets[1:]:
        every = every.unionByName(x.select("id", "text"))
    first = every.groupBy("text").agg(F.min("id").alias("id"))
    return first.select("id", "text", X.words(F.col("text")).alias("tokens"))


def training_set(articles: DataFrame, sets: list[DataFrame], least: float = 0.6, **how) -> tuple[DataFrame, DataFrame]:
    """(items, counts): the synthesised queries without what the evaluation sets equal or are like, and (kind, n, kept) of each kind."""
    made = synthesize(articles, **how)
    items = made.select(F.col("text").alias("id"), "text", "src", "kind", X.words(F.col("text")).alias("tokens"))
    clean = without_leaks(items, held_items(sets), least)
    counts = made.groupBy("kind").agg(F.count("*").alias("n")).join(clean.groupBy("kind").agg(F.count("*").alias("kept")), "kind", "left").fillna(0, ["kept"])
    return clean.select("text", "src", "kind"), counts


def synthesize(articles: DataFrame, windows: int = 40, pieces: int = 20, seed: int = 77) -> DataFrame:
    """(text, src, kind): training queries from each article: windows of 2 to 5 successive nouns, segments, title parts, tags.

    A text is kept if it has Hangul and 2 to 60 characters; the first of equal
    texts stays.  Draws come from the MD5 of article and number.
    """
    body = articles.select("row_id", "title", "tags", X.body_text(F.col("content")).alias("body"))
    nouns = F.filter(X.extract_terms(F.concat_ws(" ", "title", X.tidy(F.col("body")))), lambda w: F.length(w) >= 2)
    draw = lambda k, n, salt: X.draw(F.greatest(n, F.lit(1)).cast("long"), F.col("row_id"), k, salt, seed).cast("int")
    # the terms and segments come first, so that an article is split once, not once a draw
    w = body.select("row_id", nouns.alias("w")).where(F.size("w") > 3).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))))
    length = draw(F.col("k"), F.lit(4), 1) + 2
    win = w.select(F.array_join(F.slice("w", draw(F.col("k"), F.size("w") - length, 2) + 1, length), " ").alias("text"), F.col("row_id").alias("src"), F.lit("win").alias("kind"), F.col("k"))
    s = body.select("row_id", X.segments(F.col("body")).alias("s")).where(F.size("s") > 0).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    seg = s.select(F.element_at("s", draw(F.col("k"), F.size("s"), 3) + 1).alias("text"), F.col("row_id").alias("src"), F.lit("seg").alias("kind"), F.col("k"))
    title = articles.select(F.posexplode(F.split("title", "·")).alias("k", "p"), "row_id").select(X.clean_title(F.col("p")).alias("text"), F.col("row_id").alias("src"), F.lit("title").alias("kind"), "k")
    tag = articles.select(F.posexplode("tags").alias("k", "text"), "row_id").select("text", F.lit(-1).cast("long").alias("src"), F.lit("tag").alias("kind"), "k")
    every = win.unionByName(seg).unionByName(title).unionByName(tag).withColumn("text", X.tidy(F.col("text")))
    good = every.where(F.length("text").between(2, 60) & X.has_hangul(F.col("text")))
    order = F.struct(F.array_position(F.array(*map(F.lit, ("win", "seg", "title", "tag"))), F.col("kind")).alias("a"), "src", "k")
    return good.groupBy("text").agg(F.min_by(F.struct("src", "kind"), order).alias("b")).select("text", "b.src", "b.kind")


def keyword_covered(queries: DataFrame, meta: DataFrame) -> DataFrame:
    """(query_id, row_id, covered): whether a relevant title holds the joined query or three fifths of its nouns."""
    q = queries.select("query_id", "row_id", X.extract_terms(F.col("text")).alias("nouns"), X.joined(F.lower("text")).alias("whole"))
    m = meta.select("row_id", X.extract_terms(F.col("title")).alias("title_terms"), X.joined(F.lower("title")).alias("title_joined"))
    both = q.join(m, "row_id")
    hit = F.size(F.filter("nouns", lambda t: F.array_contains("title_terms", t) | F.contains(F.col("title_joined"), t)))
    covered = ((F.length("whole") >= 2) & F.contains("title_joined", "whole")) | ((F.size("nouns") > 0) & (hit / F.size("nouns") >= 0.6))
    return both.select("query_id", "row_id", covered.alias("covered"))


def hold_out(items: DataFrame, key: str, share: float = 0.05, least: int = 500, seed: int = 0) -> DataFrame:
    """The items with a column ``held``: those of the smallest hashes, a share of them but ``least`` at least."""
    n = items.count()
    want = min(n, max(least, int(share * n)))
    marks = items.select(F.col(key).alias("_k"), F.xxhash64(key, F.lit(seed)).alias("_h"))
    cut = marks.orderBy("_h").limit(want).agg(F.max("_h").alias("c")).first()["c"]
    return items.withColumn("held", F.xxhash64(key, F.lit(seed)) <= F.lit(cut))


def ridge(pairs: DataFrame, share: float = 1e-2) -> tuple[np.ndarray, np.ndarray]:
    """(w, b) of the affine map from x to y with penalty ``share`` x trace / size; partial sums of one pass, solved on the driver."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
                y = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
                x = np.hstack([x, np.ones((len(x), 1))])
                part = np.hstack([x.T @ x, x.T @ y])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([len(total)])], names=["part", "rows"])

    total = None
    for raw, rows in pairs.select("x", "y").mapInArrow(run, "part binary, rows bigint").toLocalIterator():
        part = np.frombuffer(raw, np.float64).reshape(rows, -1)
        total = part.copy() if total is None else total + part
    p = len(total)
    gram, cross = total[:, :p], total[:, p:]
    solved = np.linalg.solve(gram + share * np.trace(gram) / p * np.eye(p), cross)
    return solved[:-1].T, solved[-1]


def inverse_softplus(y: np.ndarray) -> np.ndarray:
    return np.log(np.expm1(np.maximum(y, 1e-6)))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.log1p(np.exp(-np.abs(x))) + np.maximum(x, 0)


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def loss_and_gradient(q: np.ndarray, teacher: np.ndarray, docs: np.ndarray, src: np.ndarray, tau: float = 0.05, lam: float = 0.5, aux: float = 0.3) -> tuple[float, np.ndarray]:
    """KL(teacher || student) over documents + lam (1 - cosine) + aux cross-entropy of the source; and d/dq of unit rows."""
    n = len(q)
    s, t = _soft(q @ docs.T / tau), _soft(teacher @ docs.T / tau)
    known = src >= 0
    loss = (t * (np.log(np.maximum(t, 1e-12)) - np.log(np.maximum(s, 1e-12)))).sum() / n + lam * (1 - (q * teacher).sum(1)).mean()
    g = (s - t) @ docs / tau / n - lam * teacher / n
    if known.any():
        m = known.sum()
        loss += aux * -np.log(np.maximum(s[known, src[known]], 1e-12)).sum() / m
        one = s.copy()
        one[np.arange(n)[known], src[known]] -= 1
        one[~known] = 0
        g = g + aux * one @ docs / tau / m
    return float(loss), g


def train(pooled: list[tuple], teacher: np.ndarray, docs: np.ndarray, src: np.ndarray, student: Student, idf: np.ndarray, held: np.ndarray, epochs: int = 40, batch: int = 512, patience: int = 5, least_gain: float = 1e-4, rates: tuple[float, float] = (2e-2, 2e-3), seeds: tuple[int, ...] = (0, 1), hidden: np.ndarray | None = None, on_member=None) -> Student:
    """Members by Adam on a bounded set of training queries.

    ``pooled`` has, of each query, its places, which of them are fallbacks and, if
    there is a lexicon, which are places of that.  Term weights go as softplus,
    begun at idf; so does the lexicon's one weight, begun at ln(N + 1) + 1 for N
    documents; the projection begins at ridge.  An epoch walks once through a
    permutation of its rows.  Documents that are ``hidden`` are no column of the
    training loss, only of the held-out one.  Both parameter groups have their own
    rate; the best held-out state stays and goes to ``on_member(seed, member)``.
    """
    vec = student.vectors if student.lexicon is None else np.vstack([student.vectors, student.lexicon])
    width = max((len(p[0]) for p in pooled), default=1)
    place = np.zeros((len(pooled), width), np.int64)
    on, fb, ext = np.zeros((len(pooled), width)), np.zeros((len(pooled), width), bool), np.zeros((len(pooled), width), bool)
    for i, (p, f, *x) in enumerate(pooled):
        n = len(p)
        place[i, :n], on[i, :n], fb[i, :n] = p, 1, f
        if x:
            ext[i, :n] = x[0]
            place[i, :n] += np.where(x[0], len(student.vectors), 0)
    seen = np.ones(len(docs), bool) if hidden is None else ~hidden
    column = np.where(seen, np.cumsum(seen) - 1, -1)
    seen_src = np.where(src >= 0, column[np.maximum(src, 0)], -1)
    core = np.where(ext, 0, place)  # lexicon places have no weight of their own
    for seed in seeds:
        rng = np.random.default_rng(seed)
        start = {"theta": inverse_softplus(idf.astype(np.float64)), "fbw": np.array(-0.5), "extw": inverse_softplus(np.array(np.log(len(docs) + 1) + 1))}

        def pool(rows, params):
            w = np.where(ext[rows], softplus(params["extw"]), softplus(params["theta"])[core[rows]] * np.where(fb[rows], np.exp(params["fbw"]), 1.0)) * on[rows]
            return w, (w[..., None] * vec[place[rows]]).sum(1)

        _, p0 = pool(np.flatnonzero(~held), start)
        x = np.hstack([p0, np.ones((len(p0), 1))])
        gram = x.T @ x
        solved = np.linalg.solve(gram + 1e-2 * np.trace(gram) / len(gram) * np.eye(len(gram)), x.T @ teacher[~held])
        params = start | {"w": solved[:-1].T.copy(), "b": solved[-1].copy()}
        rate = {"theta": rates[0], "fbw": rates[0], "extw": rates[0], "w": rates[1], "b": rates[1]}
        m1, m2, step = {k: np.zeros_like(v) for k, v in params.items()}, {k: np.zeros_like(v) for k, v in params.items()}, 0

        def forward(rows, params=params):
            w, p = pool(rows, params)
            raw = p @ params["w"].T + params["b"]
            norm = np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)
            return w, p, raw / norm, norm

        best, kept, wait = np.inf, {k: v.copy() for k, v in params.items()}, 0
        own = np.flatnonzero(~held)
        for _ in range(epochs):
            order = rng.permutation(own)
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                w, p, q, norm = forward(rows)
                _, g = loss_and_gradient(q, teacher[rows], docs[seen], seen_src[rows])
                g = (g - (g * q).sum(1, keepdims=True) * q) / norm
                gp = g @ params["w"]
                gw = (gp[:, None, :] * vec[place[rows]]).sum(2) * on[rows]
                slope = lambda x: 1 / (1 + np.exp(-x))
                gt = np.zeros_like(params["theta"])
                np.add.at(gt, core[rows], np.where(ext[rows], 0.0, gw * np.where(fb[rows], np.exp(params["fbw"]), 1.0) * slope(params["theta"])[core[rows]]))
                grads = {"theta": gt, "w": g.T @ p, "b": g.sum(0), "fbw": np.array((gw * w * (fb[rows] & ~ext[rows])).sum()), "extw": np.array((gw * ext[rows]).sum() * slope(params["extw"]))}
                step += 1
                for k, gr in grads.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * gr
                    m2[k] = 0.999 * m2[k] + 0.001 * gr * gr
                    params[k] -= rate[k] * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
            rows = np.flatnonzero(held) if held.any() else own
            loss, _ = loss_and_gradient(forward(rows)[2], teacher[rows], docs, src[rows])
            if loss < best - least_gain:
                best, kept, wait = loss, {k: v.copy() for k, v in params.items()}, 0
            else:
                wait += 1
                if wait >= patience:
                    break
        student.members.append(Member(softplus(kept["theta"]), kept["w"], kept["b"], float(np.exp(kept["fbw"])), float(softplus(kept["extw"]))))
        if on_member is not None:
            on_member(seed, student.members[-1])
    return student


def compact(slots: DataFrame) -> DataFrame:
    """(place, row): lexicon places that occur, numbered densely in their order."""
    return numbered(slots.where("kind = 'ext'").select("place").distinct(), ["place"], "row")
