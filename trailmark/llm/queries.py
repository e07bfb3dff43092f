"""One query per operator, over the whole of its table."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import (
    classifier,
    collocations,
    fingerprints,
    licenses,
    lines,
    mixing,
    neardup,
    prefixtrie,
    quality,
    repeats,
    sentencepieces,
    topk,
    warc,
)
from trailmark.operators.freeze import frozen


PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses per document: how many, and the best by score, of equal ones the last by name."""
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    best = F.array_max(
        F.transform("matches", lambda m: F.struct(m["dice"], m["license"], m["word"]))
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_windows",
        F.size("matches").cast("long").alias("n_matches"),
        best["license"].alias("license"),
        F.round(best["dice"], 6).alias("dice"),
        best["word"].alias("word"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text without the words in windows of 35 words that stand elsewhere too, as a hash."""
    kept = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are documents labelled as good and not toxic."""
    labels = _table(spark, sf_dir, "labels")
    trusted = labels.filter("quality = 1 and coalesce(toxic, 0) = 0")
    return classifier.classify(_table(spark, sf_dir, "documents"), trusted)


def op4_sentencepiece(
    spark: SparkSession, sf_dir: str, model_file: str = PIECE_MODEL
) -> DataFrame:
    """Sampled segmentations of each document as sizes, scores and hashes of their ids."""
    return segmentation_digest(_table(spark, sf_dir, "documents"), model_file)


def segmentation_digest(
    docs: DataFrame, model_file: str, carried: tuple[str, ...] = ()
) -> DataFrame:
    """Per row the id, the `carried` columns, whether all its samples decode to the text, and its sampled
    segmentations as scores and as sizes and hashes of their ids."""
    vocabulary = sentencepieces.Vocabulary(model_file)
    found = sentencepieces.sample_segmentations(docs, vocabulary, carried=carried)
    brief = F.transform(
        "samples",
        lambda s: F.struct(
            F.size(s["ids"]).cast("long").alias("n_pieces"),
            F.xxhash64(s["ids"]).alias("ids_hash"),
            F.round(s["logp"], 6).alias("logp"),
            F.round(s["log_inclusion"], 6).alias("log_inclusion"),
        ),
    )
    return found.select("doc_id", *carried, "round_trip", brief.alias("samples"))


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC files, audited against a replica with known damage.

    The replica has a changed byte in every record of a page whose id leaves 7 divided by 101, and
    lacks those that leave 5 divided by 997.
    """
    pages = _table(spark, sf_dir, "pages")
    body = F.coalesce("html", F.lit(""))
    flipped = F.concat(F.lit("~"), F.substring(body, 2, 2**31 - 1))
    whole = warc.record_text(F.col("url"), F.col("html"))
    held = F.when(F.col("page_id") % 101 == 7, warc.record_text(F.col("url"), flipped)).otherwise(whole)
    records = pages.select(
        "page_id",
        "url",
        F.octet_length(whole).cast("long").alias("length"),
        F.sha2(whole, 256).alias("digest"),
        F.sha2(held, 256).alias("_replica"),
    )
    order = [F.col("page_id"), F.col("url"), F.col("digest")]
    index = warc.frozen(warc.record_index(records, order, "length"))
    there = ~F.coalesce(F.col("page_id") % 997 == 5, F.lit(False))
    replica = index.filter(there).select("file", "offset", F.col("_replica").alias("digest"))
    roots, damaged = warc.audit(index, replica)
    sizes = index.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_records"), F.sum("length").alias("n_bytes")
    )
    losses = damaged.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_damaged"),
        F.count(F.when(F.col("replica_digest").isNull(), 1)).alias("n_missing"),
        F.min("offset").alias("first_damaged"),
        F.sum("offset").alias("sum_offsets"),
    )
    return (
        sizes.join(roots, "file")
        .join(losses, "file", "left")
        .select(
            "file",
            "n_records",
            "n_bytes",
            "root",
            "replica_root",
            "intact",
            F.coalesce("n_damaged", F.lit(0)).alias("n_damaged"),
            F.coalesce("n_missing", F.lit(0)).alias("n_missing"),
            "first_damaged",
            "sum_offsets",
        )
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text without its site's boilerplate lines, as a hash."""
    report = lines.line_report(_table(spark, sf_dir, "documents"))
    return report.select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text and of an edited one, and likenesses to that and to the next text."""

    def digest(text: str) -> str:
        return sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    return fingerprints.edit_probe(_table(spark, sf_dir, "documents"), digest)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each text, whether a base rule rejects it, and whether it is kept."""
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a mix at exactly the tempered weights, and how far these can be held."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, mixing.tempered_weights(docs))


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each text under links of a similarity of 0.8 on four-word shingles."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 phrases of two or three words per language that hold together best."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vector whose id is divisible by 50 the five others with the largest inner products."""
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0).select(
        "query_id", "rank", "vec_id", "score"
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt with the first turns of its hundred's first.

    Of a conversation c the first crc32(c) % 6 turns are replaced by those of c - c % 100.
    """
    steps, members = prefixtrie.conversation_steps(_table(spark, sf_dir, "conversations"))
    member = F.col("member")
    heads = F.crc32(member.cast("string").cast("binary")) % 6
    rebuilt = prefixtrie.with_shared_heads(steps, members, member - member % 100, heads, most=5)
    return prefixtrie.prefix_trie(frozen(rebuilt), members).select(
        F.col("member").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n_members").alias("n_convs"),
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        "ends_sha256",
    )


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_warc_fixity": op5_warc_fixity,
    "op6_line_dedup": op6_line_dedup,
    "op7_fingerprints": op7_fingerprints,
    "op8_quality_rules": op8_quality_rules,
    "op9_source_mix": op9_source_mix,
    "op10_minhash_neardup": op10_minhash_neardup,
    "op11_collocations": op11_collocations,
    "op12_top_k": op12_top_k,
    "op13_prefix_trie": op13_prefix_trie,
}
