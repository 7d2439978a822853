"""The queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.canonical import Wording, map_to_entries, unmatched_values
from quillgrid.llm.leak import leaks
from quillgrid.llm.packing import fill_report, pack, split_documents
from quillgrid.llm.quantiles import latest, percentiles, value_counts
from quillgrid.llm.reading import reading_levels
from quillgrid.llm.terms import marked_terms, text_records
from quillgrid.session import read


# The wording of printed forms.
FORMS = Wording(
    leads=("please state", "please enter", "please give", "please write", "please fill", "please mention", "kindly fill", "kindly state", "kindly give", "kindly enter", "give your", "enter your", "state your", "write your", "fill in", "enter", "give", "state", "write", "your", "mention"),
    trails=("in full", "in words", "here", "below", "in block letters", "if any", "if applicable", "as per record", "original", "of the above person"),
    short_forms=tuple({"number": ("no", "nr", "num"), "date": ("dt",), "percentage": ("percent", "pct"), "account": ("acct", "ac"), "address": ("add", "addr"), "signature": ("sign", "sig"), "telephone": ("tel", "phone", "ph"), "mobile": ("mob",), "organisation": ("organization", "org"), "department": ("dept",), "certificate": ("cert",), "registration": ("regn",), "qualification": ("qualn",), "photograph": ("photo",), "centimetres": ("cm", "cms"), "kilograms": ("kg", "kgs")}.items()),
    reorder=True,
)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = map_to_entries(read(spark, sf_dir, "mappings"), read(spark, sf_dir, "form_labels"), wording=FORMS)
    return got.select(F.col("id").alias("mapping_id"), "label_id")


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unmatched_values(read(spark, sf_dir, "mappings"), read(spark, sf_dir, "form_labels"), wording=FORMS)


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = latest(read(spark, sf_dir, "result_rows").select("row_id", "station", F.col("confidence").alias("value"), "loaded_at"), "row_id", ["station", "value"])
    dist = latest(read(spark, sf_dir, "mappings").select("mapping_id", "station", F.col("distance").alias("value"), "loaded_at"), "mapping_id", ["station", "value"])
    a = conf.filter("value between 0 and 1").select(F.lit("confidence").alias("measure"), "station", "value")
    b = dist.filter("value between 0 and 10000").select(F.lit("distance").alias("measure"), "station", "value")
    return a.unionByName(b)


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ["measure", "station"]
    return percentiles(value_counts(_measures(spark, sf_dir), groups, "value"), groups, [50, 90, 99]).withColumn("value", F.round("value", 6))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = F.when(F.col("measure") == "confidence", 0.05).otherwise(50.0)
    return p3_percentiles(spark, sf_dir).select("measure", "station", "pct", F.floor(F.col("value") / width).cast("int").alias("bucket"))


def _term_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_records(read(spark, sf_dir, "result_rows").select("row_id", "text", "loaded_at"), "row_id", "text", "result.text", split=True)
    labels = text_records(read(spark, sf_dir, "mappings").select("mapping_id", "label", "loaded_at"), "mapping_id", "label", "mappings.label", split=False)
    return rows.unionByName(labels)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intervals of depth 1 of the same suffix array that gives the phrases."""
    return marked_terms(_term_records(spark, sf_dir), deepest=1).filter("mark is not null").select("src", "term", "occurrences", "records", "mark")


def p4_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All n-grams of up to three tokens, off the array of whole suffixes."""
    return marked_terms(_term_records(spark, sf_dir), deepest=3).select("src", "term", "n", "occurrences", "records", "mark")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(read(spark, sf_dir, "documents"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(pack(read(spark, sf_dir, "documents")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(read(spark, sf_dir, "documents"), read(spark, sf_dir, "reading_labels")).select("doc_id", "reading_level")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_unmatched, p3_found, p3_percentiles, p4_found, p4_phrases, p6_found, p6_containers, p6_fill, p7_found, p8_found)}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": """
            with r as (select row_id, arg_max(station, loaded_at) as station, arg_max(confidence, loaded_at) as value from result_rows where row_id is not null group by row_id),
            m as (select mapping_id, arg_max(station, loaded_at) as station, arg_max(distance, loaded_at) as value from mappings where mapping_id is not null group by mapping_id),
            v as (select 'confidence' as measure, station, value, 0.05 as width from r where value between 0 and 1 and not isnan(value)
                  union all select 'distance', station, value, 50.0 from m where value between 0 and 10000 and not isnan(value)),
            p as (select unnest([50, 90, 99]) as pct),
            o as (select measure, station, width, value, row_number() over (partition by measure, station order by value) as rn, count(*) over (partition by measure, station) as n from v)
            select measure, station, cast(pct as integer) as pct, cast(floor(value / width) as integer) as bucket
            from o, p where rn = greatest(1, (pct * n + 99) // 100)""",
        "p3_percentiles": """
            with r as (select row_id, arg_max(station, loaded_at) as station, arg_max(confidence, loaded_at) as value from result_rows where row_id is not null group by row_id),
            m as (select mapping_id, arg_max(station, loaded_at) as station, arg_max(distance, loaded_at) as value from mappings where mapping_id is not null group by mapping_id),
            v as (select 'confidence' as measure, station, value from r where value between 0 and 1 and not isnan(value)
                  union all select 'distance', station, value from m where value between 0 and 10000 and not isnan(value)),
            o as (select measure, station, value, row_number() over (partition by measure, station order by value) as rn, count(*) over (partition by measure, station) as n from v)
            select measure, station, cast(pct as integer) as pct, case when value = 0 then 0.0 else round(exp((floor(ln(value) / (2 * ln(1.001))) + 0.5) * 2 * ln(1.001)), 6) end as value, n as n_values
            from o, (select unnest([50, 90, 99]) as pct) where rn = greatest(1, (pct * n + 99) // 100)""",
        "p4_found": r"""
            with r as (select row_id, arg_max(text, loaded_at) as text from result_rows where row_id is not null group by row_id),
            m as (select mapping_id, arg_max(label, loaded_at) as label from mappings where mapping_id is not null group by mapping_id),
            rr as (select row_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') as ts from r where regexp_matches(text, '[^\s\p{Z}]')),
            mm as (select mapping_id, trim(regexp_replace(lower(label), '[\s\p{Z}]+', ' ', 'g')) as t from m where regexp_matches(label, '[^\s\p{Z}]')),
            tokens as (select 'result.text' as src, row_id as record, unnest(ts) as term from rr union all select 'mappings.label', mapping_id, t from mm),
            total as (select 'result.text' as src, count(*) as total from rr union all select 'mappings.label', count(*) from mm),
            c as (select src, term, count(*) as occurrences, count(distinct record) as records from tokens group by src, term)
            select c.src, term, occurrences, records, case when records < 3 then 'rare' else 'common' end as mark
            from c join total using (src) where records < 3 or records > 0.01 * total""",
        "p4_phrases": r"""
            with r as (select row_id, arg_max(text, loaded_at) as text from result_rows where row_id is not null group by row_id),
            m as (select mapping_id, arg_max(label, loaded_at) as label from mappings where mapping_id is not null group by mapping_id),
            t as (select 'result.text' as src, row_id as record, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') as ts from r where regexp_matches(text, '[^\s\p{Z}]')
                  union all select 'mappings.label', mapping_id, [trim(regexp_replace(lower(label), '[\s\p{Z}]+', ' ', 'g'))] from m where regexp_matches(label, '[^\s\p{Z}]')),
            total as (select src, count(*) as total from t group by src),
            places as (select src, record, ts, k, unnest(range(1, len(ts) - k + 2)) as p from t, (select unnest([1, 2, 3]) as k)),
            g as (select src, record, k as n, array_to_string(ts[p : p + k - 1], ' ') as term from places),
            c as (select src, term, n, count(*) as occurrences, count(distinct record) as records from g group by src, term, n)
            select c.src, term, cast(n as integer) as n, occurrences, records, case when records < 3 then 'rare' when records > 0.01 * total then 'common' end as mark
            from c join total using (src)""",
    }
