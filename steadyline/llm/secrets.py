"""Secret scan with multipart credential linking, on SQL functions only.

Strong kinds are found by shape alone. Weak kinds (an account name, a bare token, an address) mean nothing by
themselves: an interval join within a scope of SCOPE code points reports them only next to their complement.
"""

from pyspark.sql import Column, DataFrame, functions as F

from steadyline.sources.staging import staged

STRONG = {
    "assign": (r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    # runs below the least length are most of a text; the bound in the pattern finds the same runs
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
WEAK = {
    "account": (r"""((?i)user_?name|user|login|account|client_?id)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", 2, 3),
    # of any length, plain or URL-safe, padded or not; a name before its '=' is none, nor is a ruled line
    "part": (r"(?<![A-Za-z0-9+/_-])(?=[+/_-]*[A-Za-z0-9])[A-Za-z0-9+/_-]{32,}+={0,2}+(?![A-Za-z0-9+/_=-])", 0, 32),
    "endpoint": (r"""(?i:https?|ftp|jdbc:[a-z]+|postgres|mysql|redis|amqp)://[^\s"'<>]+""", 0, 8),
}
KINDS = [*STRONG, *WEAK]
ROLE = {"access": "id", "account": "id", "assign": "secret", "hex": "secret", "part": "secret", "endpoint": "endpoint"}
#: the roles that a weak kind needs within its scope
NEEDS = {"account": ["secret"], "part": ["id"], "endpoint": ["id", "secret"]}
SCOPE = 200
BIN = 256
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(kind: str, steps: Column, least: int) -> Column:
    """Spans of all matches from the texts between them; those with too short a value are dropped.

    ``steps`` is a column of its own. They are walked in blocks of about the root of their number, so that no array
    is copied once for each hit of a text with very many.
    """
    n = F.size(steps)
    block = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: F.slice(steps, b * block + 1, block))
    long = lambda s: F.length(s["gap"]) + F.length(s["hit"])
    lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, s: a + long(s)))
    starts = F.aggregate(lengths, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    empty = F.array().cast(SPAN)

    def step(a, s):
        start = a["at"] + F.length(s["gap"])
        end = a["at"] + long(s)
        one = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(s["value"]) >= least, F.array_append(a["spans"], one)).otherwise(a["spans"]).alias("spans"))

    walked = F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(starts) - 1), lambda b, at: F.aggregate(b, F.struct(at.alias("at"), empty.alias("spans")), step)["spans"])
    return F.when(n > 0, F.flatten(walked)).otherwise(empty)


def _scanned(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 and the spans of each kind, each found leftmost and without overlap within its kind."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"k1": F.coalesce("doc_id", F.lit(0)), "k2": F.xxhash64("doc_id", "text")})
    patterns = {**STRONG, **WEAK}
    hits = rows.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"{k}_hit") for k, (p, _, _) in patterns.items()])
    some = lambda k: F.size(f"{k}_hit") > 0
    parts = hits.select("*", *[F.when(some(k), F.split("text", p, -1)).alias(f"{k}_gap") for k, (p, _, _) in patterns.items()], *[
        F.when(some(k), F.regexp_extract_all("text", F.lit(p), F.lit(g))).alias(f"{k}_value") for k, (p, g, _) in patterns.items() if g
    ])
    walked = parts.select("doc_id", "k1", "k2", *[
        F.arrays_zip(
            F.slice(f"{k}_gap", F.lit(1), F.size(f"{k}_hit")).alias("gap"), F.col(f"{k}_hit").alias("hit"), F.col(f"{k}_value" if g else f"{k}_hit").alias("value")
        ).alias(k)
        for k, (_, g, _) in patterns.items()
    ])
    return walked.select("doc_id", "k1", "k2", *[_spans(k, F.col(k), least).alias(k) for k, (_, _, least) in patterns.items()])


def _linked(scan: DataFrame) -> DataFrame:
    """(k1, k2, linked): the weak spans with their complements in scope. A bin holds few spans, so few pairs."""
    has = lambda role: sum(F.size(k) for k in KINDS if ROLE[k] == role) > 0
    spans = scan.where(has("id") & has("secret")).dropDuplicates(["k1", "k2"]).select("k1", "k2", F.inline(F.concat(*KINDS)))
    weak = spans.where(F.col("kind") >= len(STRONG)).withColumn(
        "bin", F.explode(F.sequence(F.floor((F.col("start") - SCOPE) / BIN), F.floor((F.col("end") + SCOPE) / BIN)))
    )
    other = spans.select(
        "k1", "k2", F.col("start").alias("s"), F.col("kind").alias("k"), F.col("end").alias("e"),
        F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN))).alias("bin"),
    )
    pairs = weak.join(other, ["k1", "k2", "bin"]).where((F.col("s") < F.col("end") + SCOPE) & (F.col("e") > F.col("start") - SCOPE))
    apart = (F.col("s") >= F.col("end")) | (F.col("e") <= F.col("start"))
    near = lambda role: F.coalesce(F.bool_or(apart & F.col("k").isin([KINDS.index(k) for k in KINDS if ROLE[k] == role])), F.lit(False))
    judged = pairs.groupBy("k1", "k2", "start", "kind", "end").agg(
        near("id").alias("id"), near("secret").alias("secret"), F.bool_or(~apart & (F.col("k") < len(STRONG))).alias("covered")
    )
    ok = F.lit(False)
    for kind, roles in NEEDS.items():
        here = F.col("kind") == KINDS.index(kind)
        for role in roles:
            here = here & F.col(role)
        ok = ok | here
    return judged.where(ok & ~F.col("covered")).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


def secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, k1, k2, base and spans, both sorted.

    A span is (start, kind, end) in code points, end exclusive, kind a position in KINDS. ``base`` has the strong
    kinds, ``spans`` also the linked weak ones; a weak span over a strong one is left out. Null texts are empty,
    empty texts have no spans, repeated rows get equal results, other columns are not looked at. (k1, k2) stands
    for the row's doc_id and text, so results can be joined to ``keyed`` rows also where doc_id is null or repeated.
    """
    scan = staged(_scanned(docs), "secret_spans")
    every = scan.join(_linked(scan), ["k1", "k2"], "left")
    base = F.concat(*STRONG)
    return every.select(
        "doc_id", "k1", "k2", F.sort_array(base).alias("base"),
        F.sort_array(F.concat(base, F.coalesce("linked", F.array().cast(SPAN)))).alias("spans"),
    )


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


CHUNK = 4096  # code points of a text that are rewritten as one value
FEW = 500_000  # rows with spans up to which their keys are sent to the texts; beyond it texts are shuffled, with the same result


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with all spans of each text, overlapping ones as one, replaced by ``mark``; null texts stay null.

    Texts without spans stay where they are. The others are cut into chunks, which are rewritten side by side.
    """
    found = staged(secrets(docs).where("size(spans) > 0").select("k1", "k2", "spans").dropDuplicates(["k1", "k2"]), "redactions")
    keys = found.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
    keys = F.broadcast(keys) if found.count() <= FEW else keys
    keyed = docs.withColumns({"__k1": F.coalesce("doc_id", F.lit(0)), "__k2": F.xxhash64("doc_id", F.coalesce("text", F.lit("")))})
    clean, hit = (keyed.join(keys, ["__k1", "__k2"], how) for how in ("left_anti", "left_semi"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    texts = hit.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), "text").dropDuplicates(["k1", "k2"])
    chunks = texts.select("k1", "k2", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).alias("c", "part"))
    spans = found.select("k1", "k2", F.explode("spans").alias("s")).select(
        "k1", "k2", F.col("s.start").alias("a"), F.col("s.end").alias("z"), F.explode(F.sequence(F.floor(F.col("s.start") / CHUNK).cast("int"), F.floor((F.col("s.end") - 1) / CHUNK).cast("int"))).alias("c"),
    )
    # within a chunk: where a span lies, and whether it begins here; one that comes from the chunk before is first
    here = spans.select("k1", "k2", "c", F.struct(
        F.greatest(F.col("a") - F.col("c") * CHUNK, F.lit(0)).alias("lo"), (F.col("a") >= F.col("c") * CHUNK).alias("begins"),
        F.least(F.col("z") - F.col("c") * CHUNK, F.lit(CHUNK)).alias("hi"),
    ).alias("s")).groupBy("k1", "k2", "c").agg(F.sort_array(F.collect_list("s")).alias("own"))

    def step(a, s):
        put = F.concat(a["out"], F.substring("part", a["at"] + 1, s["lo"] - a["at"]), F.when(s["begins"], F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.when(s["lo"] >= a["at"], put).otherwise(a["out"]).alias("out"), F.greatest(a["at"], s["hi"]).alias("at"))

    walk = F.aggregate("own", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    met = chunks.join(here, ["k1", "k2", "c"], "left").select("k1", "k2", "c", "part", F.when(F.col("own").isNotNull(), walk).alias("w"))
    new = F.when(F.col("w").isNull(), F.col("part")).otherwise(F.concat(F.col("w.out"), F.substring("part", F.col("w.at") + 1, F.length("part"))))
    rewritten = met.select("k1", "k2", "c", new.alias("new")).groupBy("k1", "k2").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c", "new"))), lambda x: x["new"]), "").alias("__new")
    )
    made = rewritten.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "__new")
    out = hit.drop("text").join(made, ["__k1", "__k2"]).withColumn("text", F.col("__new"))
    return clean.select(*columns).unionByName(out.select(*columns))
