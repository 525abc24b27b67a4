"""Language identification by a linear-chain conditional random field over the words of a text.

A text is a chain of words (runs of letters), each in one of the learned languages; code-switched text changes between
them. What a word says comes from hashed features (affixes, character n-grams, the word itself) and from a lexicon of
smoothed log-shares of its counts by language; what its neighbours say comes from learned transitions. Forward-backward
gives each word's marginal probabilities; a text's language is the one with the largest sum over all its words.

Trained on runs of words that are cut from documents of known language and put together in an order of their hashes, so
that chains change language as code-switched text does. One half of the runs fills the lexicon, the other half trains.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from steadyline.llm.batches import slices, with_column
from steadyline.llm.words import LOWER, hashes, listed, mixed, words_of
from steadyline.sources.staging import staged

UNKNOWN = "und"
#: letters and all bytes of longer characters stay, A-Z lowered; anything else parts words
LETTERS = bytes(LOWER[b] if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
LETTER = r"\pL"
SIZES = (2, 3, 4)  # of character n-grams, word borders included; those at a border are affixes
BORDER = 0x20


class Settings(NamedTuple):
    rows_per_label: int = 400  # training documents of each language, the least by hash of doc_id and text
    bits: int = 17  # 2**bits hashed features
    lexicon: int = 30_000  # words of the lexicon, the most frequent ones
    run: tuple = (12, 90)  # least and most words of one document in a row
    chain: int = 64  # words of a training chain
    batch: int = 32  # chains of an update
    updates: int = 80  # of a shard in a round, at least; a small shard is passed over more than once
    shards: int = 8  # trained side by side and averaged after each round
    rounds: int = 3
    rate: float = 0.3
    l2: float = 1e-6


class Model(NamedTuple):
    labels: list[str]
    weights: np.ndarray  # 2**bits x labels
    lexicon_keys: np.ndarray  # hashes of words, sorted
    lexicon: np.ndarray  # words x labels: log-shares
    lexicon_weights: np.ndarray  # labels + 1 (not in the lexicon) x labels
    transitions: np.ndarray  # labels x labels, from and to
    bits: int


# ---- features of words ----------------------------------------------------------------------------------


def features(vocab: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, number of the word) of each occurrence, and a 64-bit hash of each word. ``vocab``: distinct words, binary."""
    whole, _ = hashes(vocab)
    size = pc.binary_length(vocab).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    text = np.frombuffer(b"".join(b" %b " % w for w in listed(vocab)), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(size)), size)
    end = np.repeat(np.cumsum(size), size)
    start = end - np.repeat(size, size)
    at = np.arange(len(text))
    found = [mixed(whole)]
    owner = [np.arange(len(size))]
    for n in SIZES:
        if len(text) < n:
            continue
        value = np.zeros(len(text) - n + 1, np.uint64)
        for i in range(n):
            value = value << np.uint64(8) | text[i : len(text) - n + 1 + i]
        begins = at[: len(value)]
        inside = begins + n <= end[: len(value)]
        # an n-gram at either end of a word stands for an affix
        place = (begins == start[: len(value)]).astype(np.uint64) + 2 * (begins + n == end[: len(value)]).astype(np.uint64)
        found.append(mixed((value << np.uint64(8) | place << np.uint64(3) | np.uint64(n))[inside]))
        owner.append(word[: len(value)][inside])
    hashed = np.concatenate(found) >> np.uint64(64 - bits)
    return hashed.astype(np.int64), np.concatenate(owner), whole


def lexicon_rows(whole: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Of each word: its log-shares and 0, or zeros and 1 where the lexicon lacks it."""
    out = np.zeros((len(whole), values.shape[1] + 1))
    out[:, -1] = 1.0
    if len(keys):
        at = np.minimum(np.searchsorted(keys, whole), len(keys) - 1)
        known = keys[at] == whole
        out[known, :-1], out[known, -1] = values[at[known]], 0.0
    return out


def emissions(vocab: pa.Array, m: Model) -> np.ndarray:
    """Score of each word for each label."""
    feature, owner, whole = features(vocab, m.bits)
    out = lexicon_rows(whole, m.lexicon_keys, m.lexicon) @ m.lexicon_weights
    for k, weights in enumerate(np.ascontiguousarray(m.weights.T)):
        out[:, k] += np.bincount(owner, weights[feature], minlength=len(whole))
    return out


# ---- forward-backward -------------------------------------------------------------------------------------


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def chain_marginals(score: np.ndarray, transitions: np.ndarray):
    """Marginals (chains x words x labels) of chains of equal length, and the summed pairs' marginals (labels x labels)."""
    e = np.exp(score - score.max(-1, keepdims=True))
    t = np.exp(transitions - transitions.max())
    n = e.shape[1]
    ahead, behind = np.empty_like(e), np.ones_like(e)
    ahead[:, 0] = _scaled(e[:, 0])
    for i in range(1, n):
        ahead[:, i] = _scaled((ahead[:, i - 1] @ t) * e[:, i])
    for i in range(n - 2, -1, -1):
        behind[:, i] = _scaled((behind[:, i + 1] * e[:, i + 1]) @ t.T)
    pairs = ahead[:, :-1, :, None] * t * (e * behind)[:, 1:, None, :]
    return _scaled(ahead * behind), (pairs / pairs.sum((-2, -1), keepdims=True)).sum((0, 1))


BLOCK = 64
EVERY = 8  # steps between rescalings; a step shrinks a sum by the least transition at most


def _step(x: np.ndarray, transitions: np.ndarray, i: int) -> np.ndarray:
    """One step of vectors that lie along the last axis, labels along the one before it."""
    out = transitions @ x
    return out / out.sum(-2, keepdims=True) if i % EVERY == 0 else out


def marginals(score: np.ndarray, start: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Marginals of each word of texts of any length; ``start`` says where each text begins, with the end added.

    Texts are cut into blocks of 64 words. A block is one matrix product, from any label before it to any label at its
    end; these are chained through a text, then all blocks are walked side by side from what is known at their borders.
    """
    labels, counts = score.shape[1], np.diff(start)
    blocks = -(-counts // BLOCK)
    first, most = np.cumsum(blocks) - blocks, int(blocks.max(initial=0))
    total = int(blocks.sum())
    within = np.arange(len(score)) - np.repeat(start[:-1], counts)
    row, place = np.repeat(first, counts) + within // BLOCK, within % BLOCK
    e = np.ones((BLOCK, labels, total))
    e[place, :, row] = np.exp(score - score.max(1, keepdims=True))
    begins, length = np.zeros(total, bool), np.bincount(row, minlength=total)
    begins[first[blocks > 0]] = True
    to = np.exp(transitions - transitions.max()).T.copy()  # label reached by label left
    before, after = np.ones((labels, total)), np.ones((labels, total))
    if most > 1:
        # full blocks: ends[k] holds, for label k before a block, what reaches each label at its end
        full = np.flatnonzero(length == BLOCK)
        number = np.zeros(total, np.int64)
        number[full] = np.arange(len(full))
        own = np.ascontiguousarray(e[:, :, full])
        ends = np.broadcast_to(np.eye(labels)[:, :, None], (labels, labels, len(full))).copy()
        opened = own[0]
        for i in range(BLOCK):
            ends = (to @ ends) * own[i]
            if i % EVERY == 0:
                ends /= ends.sum((0, 1))
            if i:
                opened = _step(opened, to, i) * own[i]
        last = np.flatnonzero(length < BLOCK)  # their steps serve the way back only
        short = np.broadcast_to(np.eye(labels)[:, :, None], (labels, labels, len(last))).copy()
        for i in range(BLOCK):
            at = length[last] > i
            if not at.any():
                break
            moved = (to @ short[:, :, at]) * e[i][:, last[at]]
            short[:, :, at] = moved / moved.sum((0, 1))
        where = np.full(total, -1)
        where[last] = np.arange(len(last))
        for k in range(1, most):
            at = first[blocks > k] + k
            prior = number[at - 1]
            # a text's first block has no label before it
            value = opened[:, prior] if k == 1 else np.einsum("jn,jin->in", before[:, at - 1], ends[:, :, prior])
            before[:, at] = value / value.sum(0)
        for k in range(most - 2, -1, -1):
            at = first[blocks > k + 1] + k
            following = at + 1
            product = np.where(where[following] < 0, ends[:, :, number[following]], short[:, :, where[following]] if len(last) else 0.0)
            value = np.einsum("jin,in->jn", product, after[:, following])
            after[:, at] = value / value.sum(0)
    ahead, behind = np.empty_like(e), np.ones_like(e)
    if total:
        ahead[0] = np.where(begins, e[0], (to @ before) * e[0])
        for i in range(1, BLOCK):
            ahead[i] = _step(ahead[i - 1], to, i) * e[i]
        whole = length == BLOCK
        behind[length - 1, :, np.arange(total)] = after.T
        back = to.T.copy()
        for i in range(BLOCK - 2, -1, -1):
            value = _step(behind[i + 1] * e[i + 1], back, i)
            behind[i] = value if whole.all() else np.where(length > i + 1, value, behind[i])
    found = (ahead[place, :, row]) * (behind[place, :, row])
    return found / found.sum(1, keepdims=True)


# ---- training -----------------------------------------------------------------------------------------------


def _runs(docs: DataFrame, labels: list[str], s: Settings) -> DataFrame:
    """(label, place, fold, words): runs of words of the training documents, as a table."""

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"), LETTERS)
                out = []
                for i, (label, seed) in enumerate(zip(part.column("label").to_pylist(), part.column("seed").to_pylist())):
                    at, z = int(words.start[i]), int(words.start[i + 1])
                    draw = np.random.default_rng(seed & (1 << 63) - 1)
                    while at < z:
                        stop = min(z, at + int(draw.integers(*s.run)))
                        run = words.vocab.take(pa.array(words.code[at:stop])).to_pylist()
                        out.append((label, int(draw.integers(1 << 62)), b" ".join(run)))
                        at = stop
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["label", "place", "words"])

    number = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col("lang")).cast("int") - 1
    given = docs.select("text", number.alias("label"), F.xxhash64("doc_id", "text").alias("seed"))
    rows = given.mapInArrow(cut, "label int, place bigint, words binary")
    return staged(rows.withColumn("fold", (F.col("place") % 2).cast("int")), "runs")


def _sample(docs: DataFrame, counts: dict[str, int], s: Settings) -> DataFrame:
    """Of each language its ``rows_per_label`` rows that are the least by hash.

    A threshold by the language's count comes first, so that few rows are left to rank.
    """
    at = F.xxhash64("doc_id", "text")
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("lang") == label, min(1.0, (1.5 * s.rows_per_label + 50) / n)).otherwise(share)
    low = docs.where((at.cast("double") + 2.0**63) <= share * 2.0**64).select("doc_id", "text", "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(at, "doc_id", "text"))
    few = low.withColumn("_rank", rank).where(F.col("_rank") <= s.rows_per_label).drop("_rank")
    return staged(few.repartition(s.shards, "doc_id"), "sample")


def _lexicon(runs: DataFrame, labels: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and log-shares of the most frequent words of one half of the runs; at most ``lexicon`` words."""
    word = F.explode(F.split(F.col("words").cast("string"), " ")).alias("word")
    counted = runs.where("fold = 0").select("label", word).groupBy("word").agg(
        *[F.count_if(F.col("label") == k).alias(f"n{k}") for k in range(labels)], F.count("*").alias("n")
    )
    rows = counted.where("n >= 2").orderBy(F.desc("n"), "word").limit(s.lexicon).collect()  # bounded by ``lexicon``
    if not rows:
        return np.zeros(0, np.uint64), np.zeros((0, labels))
    keys, _ = hashes(pa.array([r["word"].encode() for r in rows], pa.large_binary()))
    n = np.array([[r[f"n{k}"] for k in range(labels)] for r in rows], float) + 0.5
    value = np.log(n / n.sum(1, keepdims=True))
    order = np.argsort(keys)
    return keys[order], value[order]


def fitted(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from the text and non-null lang of ``docs`` (doc_id, text, lang), all of which may be learnt from.

    At most ``rows_per_label`` documents of each language, whole; their number doesn't grow with the table. Rows without
    a letter are left out. Nothing to learn from: a model without labels.
    """
    s, spark = settings, docs.sparkSession
    rows = docs.where("lang is not null and text is not null").where(F.col("text").rlike(LETTER))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    labels, k = sorted(counts), len(counts)
    size = 1 << s.bits
    empty = Model(labels, np.zeros((size, k)), np.zeros(0, np.uint64), np.zeros((0, k)), np.zeros((k + 1, k)), np.zeros((k, k)), s.bits)
    if k < 2:
        return empty
    runs = _runs(_sample(rows, counts, s), labels, s)
    keys, shares = _lexicon(runs, k, s)
    train = staged(runs.where("fold = 1").withColumn("shard", (F.shiftright("place", 1) % s.shards).cast("int")), "train")
    state = np.zeros((size + k + 1 + k, k)), np.full((size + k + 1 + k, k), 1e-3)
    for round_no in range(s.rounds):
        held = spark.sparkContext.broadcast((state, keys, shares))

        def local(given: pa.Table) -> pa.Table:
            (w, g), keys, shares = held.value
            w, g = _passed(given.sort_by([("place", "ascending"), ("words", "ascending")]).combine_chunks(), w.copy(), g.copy(), keys, shares, s)
            return pa.table({"part": pa.array([0, 1], pa.int32()), "value": pa.array([w.astype(np.float32).tobytes(), g.astype(np.float32).tobytes()], pa.binary())})

        def mean(given: pa.Table) -> pa.Table:
            values = sorted(given["value"].to_pylist())  # any fixed order
            out = np.mean([np.frombuffer(v, np.float32) for v in values], axis=0, dtype=np.float64).astype(np.float32)
            return pa.table({"part": given["part"][:1], "value": pa.array([out.tobytes()], pa.binary())})

        # two parts of the model's fixed size come to the driver
        parts = train.repartition(s.shards, "shard").groupBy("shard").applyInArrow(local, "part int, value binary").groupBy("part").applyInArrow(mean, "part int, value binary").collect()
        held.unpersist()
        if parts:
            state = tuple(np.frombuffer(r["value"], np.float32).astype(np.float64).reshape(-1, k) for r in sorted(parts, key=lambda r: r["part"]))
    w = state[0]
    return Model(labels, w[:size].astype(np.float32), keys, shares, w[size : size + k + 1], w[size + k + 1 :], s.bits)


def _passed(given: pa.Table, w: np.ndarray, g: np.ndarray, keys: np.ndarray, shares: np.ndarray, s: Settings):
    """AdaGrad steps over a shard's chains. Rows of ``w``: features, lexicon values, transitions."""
    k = w.shape[1]
    size = len(w) - 2 * k - 1
    words = words_of(given["words"].combine_chunks().cast(pa.large_string()))
    label = np.repeat(np.array(given["label"].to_pylist(), np.int64), words.counts())
    chains = len(label) // s.chain
    if not chains:
        return w, g
    feature, owner, whole = features(words.vocab, s.bits)
    order = np.argsort(owner, kind="stable")
    feature, bounds = feature[order], np.searchsorted(owner[order], np.arange(len(whole) + 1))
    told = lexicon_rows(whole, keys, shares)
    code = words.code[: chains * s.chain].reshape(chains, s.chain)
    gold = label[: chains * s.chain].reshape(chains, s.chain)
    starts = range(0, chains, s.batch)
    for i in [*starts] * -(-s.updates // len(starts)):
        c, y = code[i : i + s.batch], gold[i : i + s.batch]
        used, back = np.unique(c, return_inverse=True)
        count = bounds[used + 1] - bounds[used]
        at = feature[np.repeat(bounds[used], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        mine = np.repeat(np.arange(len(used)), count)
        score = told[used] @ w[size : size + k + 1]
        for j in range(k):
            score[:, j] += np.bincount(mine, w[at, j], minlength=len(used))
        p, pairs = chain_marginals(score[back.reshape(c.shape)], w[size + k + 1 :])
        residual = p - np.eye(k)[y]
        by_word = np.stack([np.bincount(back.ravel(), residual[..., j].ravel(), minlength=len(used)) for j in range(k)], 1)
        step = np.zeros_like(w)
        for j in range(k):
            step[:size, j] = np.bincount(at, by_word[mine, j], minlength=size)
        step[size : size + k + 1] = told[used].T @ by_word
        seen = np.zeros((k, k))
        np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1.0)
        step[size + k + 1 :] = pairs - seen
        step = step / c.size + s.l2 * w
        g += step * step
        w -= s.rate * step / np.sqrt(g)
    return w, g


# ---- prediction ---------------------------------------------------------------------------------------------


def identified(docs: DataFrame, model: Model, name: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language of each text and the share of its words' probability that falls to it.

    A text that is null or has no letter is ``und`` with score 0, as is any text if the model has no label. Whole
    texts are read, however long.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    k = len(model.labels)

    def compute(texts):
        m = held.value
        lettered = pc.fill_null(pc.match_substring_regex(texts, LETTER), False).to_numpy(zero_copy_only=False)
        pred, value = np.full(len(texts), -1), np.zeros(len(texts))
        words = words_of(texts, LETTERS)
        if k == 1:
            pred[lettered], value[lettered] = 0, 1.0
        elif k and len(words.code):
            p = marginals(emissions(words.vocab, m)[words.code], words.start, m.transitions)
            no, counts = words.text_no(), words.counts()
            mass = np.stack([np.bincount(no, p[:, j], minlength=len(texts)) for j in range(k)], 1)
            best = mass.argmax(1)
            at = np.flatnonzero(lettered & (counts > 0))
            pred[at], value[at] = best[at], np.minimum(1.0, mass[at, best[at]] / counts[at])
        names = np.array([*m.labels, UNKNOWN], object)
        return [pa.array(names[pred], pa.string()), pa.array(value)]

    limit = max(1 << 12, (2 << 20) * 16 // max(16, k * k))  # a word's step is a matrix of labels by labels
    return with_column(docs, "text", {name: T.StringType(), score: T.DoubleType()}, compute, limit)


def held_out(of: int, remainder: int):
    """True for one document in ``of``, by CRC-32 of the doc_id as text (null: as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of == remainder
