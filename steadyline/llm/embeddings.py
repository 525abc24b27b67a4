"""Embedding near-duplicates by int8 tile products with an error bound for each vector.

Vectors of a label are dealt into blocks; a tile is a pair of blocks. A tile's cosines are first taken from int8
codes. With a unit vector x = code + e, the true cosine lies within |e_a| |code_b| + |code_a| |e_b| + |e_a| |e_b| of
the codes' product (Cauchy-Schwarz), so pairs clearly above or below the threshold are decided; the rest are
recomputed in double precision. A tile returns link counts and a spanning forest of its links, never its pairs.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from steadyline.llm.components import components
from steadyline.sources.staging import staged

BLOCK = 4096  # vectors of a block, on average
STRIP = 512  # rows of a tile whose products are held at once
EXACT_DIMS = 1024  # products of int8 codes over so many dimensions are exact in float32
SLACK = 1e-9  # far above the rounding of the bound itself
RECOMPUTED = 1 << 16  # pairs taken in double precision at once


def quantised(vectors: np.ndarray):
    """(codes as float32 whole numbers, scale, norm of the coded vector, norm of the error), for unit vectors in double."""
    scale = np.abs(vectors).max(axis=1) / 127.0
    codes = np.rint(vectors / scale[:, None])
    coded = codes * scale[:, None]
    return codes.astype(np.float32), scale, np.linalg.norm(coded, axis=1), np.linalg.norm(vectors - coded, axis=1)


def _linked(a, b, rows: slice, threshold: float) -> np.ndarray:
    """Which of a's ``rows`` reach the threshold with which of b."""
    (va, ca, sa, na, ea), (vb, cb, sb, nb, eb) = a, b
    near = np.zeros((len(ca[rows]), len(cb)))
    for d in range(0, ca.shape[1], EXACT_DIMS):
        near += ca[rows, d : d + EXACT_DIMS] @ cb[:, d : d + EXACT_DIMS].T
    near *= sa[rows, None] * sb[None, :]
    bound = ea[rows, None] * (nb + eb)[None, :] + na[rows, None] * eb[None, :] + SLACK
    linked = near - bound >= threshold
    x, y = np.nonzero((near + bound >= threshold) & ~linked)
    for i in range(0, len(x), RECOMPUTED):
        p, q = x[i : i + RECOMPUTED], y[i : i + RECOMPUTED]
        linked[p, q] = np.einsum("ij,ij->i", va[rows][p], vb[q]) >= threshold
    return linked


def _tile(ids, side, times, vectors, diagonal: bool, threshold: float):
    """Link counts of the tile's vectors and edges of a spanning forest of its links."""
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])  # exact; squares then neither overflow nor vanish
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    parts = [np.arange(len(ids))] * 2 if diagonal else [np.flatnonzero(side == s) for s in (0, 1)]
    a, b = ((unit[p], *quantised(unit[p])) for p in parts)
    counts, group, edges = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
    for at in range(0, len(parts[0]), STRIP):
        linked = _linked(a, b, slice(at, at + STRIP), threshold)
        if diagonal:  # each pair once
            linked &= np.arange(len(ids))[None, :] > np.arange(at, at + len(linked))[:, None]
        counts[parts[0][at : at + STRIP]] += linked @ times[parts[1]]
        counts[parts[1]] += times[parts[0][at : at + STRIP]] @ linked
        for r in np.flatnonzero(linked.any(axis=1)):
            row, near = parts[0][at + r], parts[1][np.flatnonzero(linked[r])]
            others, first = np.unique(group[near], return_index=True)
            new = others != group[row]
            if new.any():
                edges += [(ids[row], ids[n]) for n in near[first[new]]]
                group[np.isin(group, others[new])] = group[row]
    return counts, edges


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """One row for each row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of one label and one length link at a cosine of ``threshold`` or more, in double precision. A vector
    that is null, empty or zero, has null or non-finite components or a null label links with nothing. n_links counts
    other rows, equal vectors included; component_id is the least vec_id that links reach, itself included; kept:
    that is the row itself. Rows with a null vec_id link, but lend no id. Equal vectors are one entry, so
    copies make no pairs. Other columns are not looked at.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    # NaN counts as greatest, so the two ends show every non-finite component
    finite = F.col("label").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull())
    finite = finite & (F.array_max("v") < float("inf")) & (F.array_min("v") > float("-inf")) & F.exists("v", lambda x: x != 0)
    good, bad = rows.where(F.coalesce(finite, F.lit(False))), rows.where(~F.coalesce(finite, F.lit(False)))
    classes = good.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")  # the ids are fixed by writing them
    sized = classes.withColumn("dims", F.size("v"))
    blocks = sized.groupBy("label", "dims").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    placed = sized.join(blocks, ["label", "dims"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("n_blocks")).cast("int"))
    tiles = placed.select("label", "dims", "cid", "times", "v", "block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")).select(
        "label", "dims", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "cid", "times", "v",
    )

    def compare(given: pa.Table) -> pa.Table:
        given = given.combine_chunks()
        ids, side, times = (given[c].to_numpy() for c in ("cid", "side", "times"))
        held = given["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        counts, edges = _tile(ids, side, times, held, given["i"][0] == given["j"][0], threshold)
        some = np.flatnonzero(counts)
        x, y = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        return pa.table({
            "cid": np.concatenate([ids[some], x]), "n": np.concatenate([counts[some], np.zeros(len(x), np.int64)]),
            "near": pa.array([None] * len(some) + y.tolist(), pa.int64()),
        })

    found = staged(tiles.groupBy("label", "dims", "i", "j").applyInArrow(compare, "cid bigint, n bigint, near bigint"), "tiles")
    roots = components(found.where("near is not null").select("cid", "near"), "cid", "near").withColumnRenamed("node", "cid")
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    known = classes.select("cid", "least", "times").join(counts, "cid", "left").join(roots, "cid", "left").select(
        "cid", "least", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")
    )
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    judged = known.join(least, "root").select("cid", "n_links", "component_id")
    named = classes.select("cid", F.col("label").alias("l"), F.col("v").alias("w")).join(judged, "cid")
    out = good.join(named, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w"))).select("vec_id", "n_links", "component_id")
    alone = bad.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
