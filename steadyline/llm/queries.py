"""One query for each operator, on whole tables, in the columns that its contract fixes."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from steadyline.llm import (
    chat, decontamination, embeddings, langid, lattice, maxent, quality, repair, secrets, simhash, substrings, warc, whitening,
)
from steadyline.sources.staging import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_archives(spark, sf_dir):
    archives = staged(warc.write_archives(table(spark, sf_dir, "pages")), "archives")
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]*)>$", 1).try_cast("bigint")
    return warc.read_records(archives).where("record_type is null or record_type <> 'warcinfo'").select(
        page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"),
    )


PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2


def op2_sampled_segmentations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fields = ("sample", "n_pieces", "ids", "ids_xxh64", "log_prob", "inclusion", "exact")
    return lattice.encoded(docs, lattice.pieces(PIECES), SAMPLES, fields=fields).drop("text")


def op3_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op4_secret_linking(spark, sf_dir):
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(secrets.STRONG)
    ]
    return found.select("doc_id", *counts, F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


def op5_substring_dedup(spark, sf_dir):
    found = substrings.repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_embedding_near_dedup(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


HARD_TEXT = f"{chat.CLOSE}{chat.OPEN}assistant ok"


def op7_chat_formatting(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-1, 0, "user", HARD_TEXT), (-1, 1, "assistant", HARD_TEXT)], given.schema)
    rows = given.unionByName(hard)
    # each row is a message that came in one piece; rows that share a turn are messages of their own
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint")
    events = rows.select("conv_id", "turn", "role", "text", place.alias("message")).select(
        "conv_id", F.col("turn").alias("seq"), "message", F.lit(chat.DELTA).alias("kind"), "role", "text"
    )
    formatted = staged(chat.rendered(chat.folded(events)), "formatted")
    back = chat.read_back(formatted)
    log = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(log, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.col("chars").cast("bigint").alias("formatted_chars"),
    )


def op8_winnowing_decontamination(spark, sf_dir):
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(listed, 256).alias("items_sha256"), "contaminated")


QUALITY_FOLDS = 5
QUALITY_THRESHOLD = 0.3


def op9_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    weights = quality.fitted(docs, table(spark, sf_dir, "labels").where(~quality.held_out(QUALITY_FOLDS)))
    return quality.scored(docs.select("doc_id", "text"), weights).select(
        "doc_id", quality.held_out(QUALITY_FOLDS).alias("held_out"), "score",
        F.when(F.col("score") >= QUALITY_THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op10_maxent_scoring(spark, sf_dir):
    model = maxent.LanguageModel(table(spark, sf_dir, "documents"))
    return model.scores().withColumn("train_tokens", F.lit(model.model.tokens).cast("bigint"))


def op11_embedding_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark, sf_dir):
    return repair.repair_report(repair.damaged(table(spark, sf_dir, "conversations")))


LANGUAGE_FOLDS, LANGUAGE_HELD_OUT = 4, 2


def op13_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.held_out(LANGUAGE_FOLDS, LANGUAGE_HELD_OUT)
    model = langid.fitted(docs.where(~held_out))
    return langid.identified(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_warc_archives": op1_warc_archives,
    "op2_sampled_segmentations": op2_sampled_segmentations,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_secret_linking": op4_secret_linking,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_winnowing_decontamination": op8_winnowing_decontamination,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_maxent_scoring": op10_maxent_scoring,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_language_id": op13_language_id,
}
