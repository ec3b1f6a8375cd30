"""The pN_ queries of the training-data operators, each over its whole tables with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions.boards import label, sha_label
from plyforge.llm import copies, crosssplit, cutting, families, mixing, packing, ranking, sample
from plyforge.llm.sql import oracle_sql  # noqa: F401 - read beside queries()
from plyforge.session import cut, scratch, shared_dir, table

#: Shares of the new splits, and of the reproducible sample.
SPLITS = {"train": 0.9, "validation": 0.05, "test": 0.05}
SAMPLE = 0.05


def _sample_key() -> Column:
    """The stated hash of the text, else the text's own; a row without either is a key of its own."""
    return F.coalesce(sha_label(F.col("fen_sha256")), F.sha2(F.col("fen"), 256), F.concat(F.lit("row "), F.col("position_id").cast("string")))


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    chosen = sample.nested_sample(table(spark, d, "positions"), _sample_key(), label(F.col("split")), F.col("intake_no"), SAMPLE)
    return chosen.select("position_id", label(F.col("split")).alias("split"), "intake_no", "sample_bucket", "sample_place")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """Of every split: how many rows and how many keys are in the sample."""
    positions = table(spark, d, "positions")
    counts = lambda df, n: df.groupBy(F.coalesce(label(F.col("split")), F.lit("")).alias("split")).agg(
        F.count(F.lit(1)).alias(f"{n}rows"), F.countDistinct(_sample_key()).alias(f"{n}keys")
    )
    chosen = sample.nested_sample(positions, _sample_key(), label(F.col("split")), F.col("intake_no"), SAMPLE)
    return counts(positions, "").join(counts(chosen, "sample_"), "split", "left").withColumn("share", F.col("sample_keys") / F.col("keys"))


def p1_growth(spark: SparkSession, d: str) -> DataFrame:
    """The sample while the table grows, loses rows, and gets rows of old and unknown intakes, under one kept list."""
    p = table(spark, d, "positions")
    states = [p.filter("coalesce(intake_no, 0) <= 6"), p.filter("intake_no >= 4"), p]
    manifest = f"{shared_dir(spark).rstrip('/')}/sample-list-{uuid.uuid4().hex}"
    return sample.growth(states, _sample_key(), label(F.col("split")), F.col("intake_no"), manifest, share=SAMPLE)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.overlap_pairs(*crosssplit.cross_split(table(spark, d, "positions")))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.overlap_report(*crosssplit.cross_split(table(spark, d, "positions")))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of boards across the splits, copies not expanded."""
    return crosssplit.class_pairs(crosssplit.cross_split(table(spark, d, "positions"))[1])


def p2_members(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the splits concerned with its class and how many boards across the split are linked to it."""
    return crosssplit.class_members(*crosssplit.cross_split(table(spark, d, "positions")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copy_links(table(spark, d, "positions"))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return copies.records(table(spark, d, "positions"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_items(table(spark, d, "records")).select("network_sha256", "rank_no")


def p5_strengths(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_items(table(spark, d, "records"))


def p5_check(spark: SparkSession, d: str) -> DataFrame:
    """Networks at which the loss still slopes, so that the ranking wouldn't be the best one: none."""
    return ranking.slopes(table(spark, d, "records")).filter("not slope < 1e-6").select("network_sha256", "slope")


def _families(spark: SparkSession, d: str) -> DataFrame:
    with scratch() as keep:
        return keep(cut(families.position_families(table(spark, d, "positions"), table(spark, d, "extracted_positions")), "families"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return families.broken_families(_families(spark, d))


def p6_assignment(spark: SparkSession, d: str) -> DataFrame:
    return families.assign_splits(_families(spark, d), SPLITS)


def p6_large(spark: SparkSession, d: str) -> DataFrame:
    """Families of over a thousandth of all rows, with where they go."""
    return families.large_families(p6_assignment(spark, d), 0.001)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.divided(packing.pack_documents(table(spark, d, "documents")))


def p7_contents(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_fill(packing.pack_documents(table(spark, d, "documents")))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """How often the containers break each rule of packing."""
    docs = table(spark, d, "documents")
    return packing.broken_rules(docs, packing.pack_documents(docs))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).report.filter("not reachable").select("source")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).report


def p8_drawn(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).drawn


def p8_margins(spark: SparkSession, d: str) -> DataFrame:
    """Shares of languages and topics, wanted and reached."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).margins


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """How often the drawn texts break each rule of the mixture."""
    return mixing.broken_rules(mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return cutting.cut_documents(table(spark, d, "documents"), with_text=False).filter("piece = 1").select("doc_id", "unbreakable")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return cutting.cut_documents(table(spark, d, "documents"))


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """How often the pieces break each rule of cutting."""
    docs = table(spark, d, "documents")
    return cutting.broken_rules(docs, cutting.cut_documents(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        p1_sample, p1_shares, p1_growth, p2_found, p2_report, p2_classes, p2_members, p3_found, p3_records, p5_found, p5_strengths, p5_check,
        p6_found, p6_assignment, p6_large, p7_found, p7_contents, p7_fill, p7_check, p8_found, p8_shares, p8_drawn, p8_margins, p8_check, p9_found, p9_pieces, p9_check,
    )
    return {f.__name__: f for f in every}
