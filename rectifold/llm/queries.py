"""Queries of the language-data operators over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..functions.text import is_missing, letters_and_digits
from . import bpe, canon, copies, langid, names, packing


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copies(table(spark, sf_dir, "customer_churn"), "row_id", ["customer_id", "name", "city"])


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.records(table(spark, sf_dir, "customer_churn"), "row_id", ["customer_id", "name", "city"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    churn, cars, ref = (table(spark, sf_dir, t) for t in ("customer_churn", "car_data", "ref_values"))
    out = canon.mapped_values(churn, "city", ref)
    return out.unionByName(canon.mapped_values(churn, "department", ref)).unionByName(canon.mapped_values(cars, "fuel_type", ref)).select("field_name", F.col("row_id"), "ref_id")


def meant_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_churn as (row_id, identity, name, place): each value in the column it belongs to, the city as the list means it.

    The account is the one of the three values that looks like an account; of the other two the one that is a known city is the city.
    A city without match stands for itself.
    """
    churn, ref = table(spark, sf_dir, "customer_churn"), table(spark, sf_dir, "ref_values")
    book = canon.dictionary(ref, "city", churn, "city")
    # accounts have digits, so other names and cities need not be folded here
    usual = F.when(F.col("customer_id").rlike(r"^CUST_[0-9]+\z"), F.concat(F.lit("cust"), F.substr("customer_id", F.lit(6))))
    folded = {"customer_id": F.coalesce(usual, letters_and_digits(F.col("customer_id")))} | {c: F.when(F.col(c).rlike("[0-9]"), letters_and_digits(F.col(c))) for c in ("name", "city")}
    rows = churn.select("row_id", "join_date", *[F.col(c).alias(f"_{c}") for c in folded], *[f.alias(f"_k_{c}") for c, f in folded.items()])
    is_account = lambda c: F.col(f"_k_{c}").rlike("^cust[0-9]+$")
    rows = rows.withColumn("_at", F.when(is_account("customer_id"), 0).when(is_account("name"), 1).when(is_account("city"), 2).otherwise(0))
    at = F.col("_at")
    rows = rows.select(
        "row_id", "join_date",
        F.when(at == 1, F.col("_k_name")).when(at == 2, F.col("_k_city")).otherwise(F.col("_k_customer_id")).alias("identity"),
        F.when(at == 1, F.col("_customer_id")).otherwise(F.col("_name")).alias("_x"),
        F.when(at == 2, F.col("_customer_id")).otherwise(F.col("_city")).alias("_y"),
    )
    exact = {r["canonical"]: r["ref_id"] for r in ref.filter(F.col("field_name") == "city").select("canonical", "ref_id").limit(canon.MAX_ENTRIES).collect()}
    known = F.create_map(*[F.lit(x) for pair in exact.items() for x in pair])
    rows = rows.withColumn("_cy", F.try_element_at(known, "_y"))
    open_city = F.col("_cy").isNull() & ~is_missing(F.col("_y"))
    rows = rows.withColumn("_ty", F.when(open_city, F.col("_y"))).withColumn("_tx", F.when(open_city & ~is_missing(F.col("_x")), F.col("_x")))
    rows = canon.map_either(rows, "_ty", "_tx", book, "_r")
    rows = rows.withColumn("_cx", F.when(F.col("_r") < 0, -F.col("_r"))).withColumn("_cy", F.coalesce("_cy", F.when(F.col("_r") > 0, F.col("_r"))))
    swapped = F.col("_cx").isNotNull()
    return rows.select(
        "row_id", "join_date", F.nullif("identity", F.lit("")).alias("identity"), F.when(swapped, F.col("_y")).otherwise(F.col("_x")).alias("name"),
        F.coalesce(F.col("_cy").cast("string"), F.col("_cx").cast("string"), F.when(~is_missing(F.col("_y")), letters_and_digits(F.col("_y")))).alias("place"),
    )


def linked_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = meant_customers(spark, sf_dir)
    return names.link(rows, "row_id", F.col("identity"), F.col("name"), {"_day": names.day(F.col("join_date")), "_place": F.col("place")})


def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each linked row with the row that represents its entity."""
    return names.membership(linked_customers(spark, sf_dir), "row_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = names.linked_pairs(linked_customers(spark, sf_dir), "row_id").select(F.lit("customer_churn.name").alias("field_name"), "id_a", "id_b")
    cars = names.model_pairs(table(spark, sf_dir, "car_name_spellings"), "spelling_id", "car_name")
    return people.unionByName(cars.select(F.lit("car_data.car_name").alias("field_name"), "id_a", "id_b"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


CAPACITY = 2048


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", bpe.sizes_of(spark, F.col("text")).alias("n_tokens"))
    return packing.fill_containers(docs, "doc_id", "n_tokens", CAPACITY)


def p9_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.filling(p9_containers(spark, sf_dir), CAPACITY)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.findings(langid.identify(table(spark, sf_dir, "documents")))


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.posexplode("segments").alias("segment", "s")).select("doc_id", "segment", "s.start", "s.end", "s.lang", F.round("s.confidence", 6).alias("confidence"), "s.sentence")


def p1_sql() -> str:
    fields = ", ".join(f"lower(upper(regexp_replace(coalesce({c}, ''), '[^\\p{{L}}\\p{{N}}]+', '', 'g')))" for c in ("customer_id", "name", "city"))
    return f"SELECT row_id, min(row_id) OVER (PARTITION BY list_sort([{fields}])) AS first_row_id FROM customer_churn"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"SELECT first_row_id, row_id AS copy_row_id FROM ({p1_sql()}) WHERE row_id <> first_row_id",
        "p1_records": f"SELECT first_row_id, count(*) AS n_copies FROM ({p1_sql()}) GROUP BY 1",
    }


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_records, p4_entities, p4_found, p5_found, p8_ids, p9_containers, p9_filling, p10_found, p10_segments)}
