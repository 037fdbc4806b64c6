"""Landed JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Keys that may hold the records of a payload, in order, and keys of the number of pages.
RECORD_KEYS = ("resultado", "content", "results", "resultados", "data", "items", "materiais", "licitacoes")
AUDIT_KEYS = ("resultado", "resultados", "dados", "items", "content")
TOTAL_KEYS = ("totalPaginas", "totalPages", "total_pages")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """arquivo and texto of every JSON file below ``path``."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True).text(path)
    return files.select(F.col("_metadata.file_path").alias("arquivo"), F.col("value").alias("texto"))


def file_report(files: DataFrame) -> DataFrame:
    """Files read and files that are no JSON."""
    bad = F.try_parse_json("texto").isNull()
    return files.agg(F.count(F.lit(1)).alias("arquivos"), F.count_if(bad).alias("invalidos"))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).like(f"{kind}%"), F.lit(False))


def _list(v: Column) -> Column:
    return F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def _first_list(payload: Column, v: Column, key: str) -> Column:
    """The first list among the values of the object under ``key``, in the order of the text, which the parsed value does not keep."""
    names = F.json_object_keys(F.get_json_object(payload, f"$.{key}"))
    values = F.try_variant_get(v, f"$.{key}", "map<string,variant>")
    lists = F.transform(names, lambda k: _list(F.try_element_at(values, k)))
    return F.get(F.filter(lists, lambda a: a.isNotNull()), F.lit(0))


def records_of(payload: Column, keys: tuple[str, ...] = RECORD_KEYS, embedded: str | None = "first", nested: bool = False) -> Column:
    """Array of the record objects of a JSON text.

    A list is the records itself. Of an object they are the first list found under ``keys``, in their order; with ``nested`` an
    object under a key gives its first list. The first list inside _embedded is looked for before the keys, or after them, or, with
    None, not apart from the keys. What is no object is dropped; no JSON and no list give null.
    """
    v = F.try_parse_json(payload)
    under = []
    for k in keys:
        under.append(_list(F.try_variant_get(v, f"$.{k}", "variant")))
        if nested:
            under.append(_first_list(payload, v, k))
    inside = [_first_list(payload, v, "_embedded")] if embedded else []
    found = F.coalesce(_list(v), *(inside if embedded == "first" else []), *under, *(inside if embedded == "last" else []))
    return F.filter(found, lambda r: _is(r, "OBJECT"))


def audit_records(payload: Column) -> Column:
    """Records as the enrichment's audit reads them: lists under its keys or inside objects there, then inside _embedded."""
    return records_of(payload, AUDIT_KEYS, "last", nested=True)


def bronze_audit_records(payload: Column) -> Column:
    """Records as the audit of landed units reads them: as above, and _embedded is a key like the others, so it may be a list."""
    return records_of(payload, (*AUDIT_KEYS, "_embedded"), None, nested=True)


def unwrap(files: DataFrame, schema: str, keys: tuple[str, ...] = RECORD_KEYS) -> DataFrame:
    """One row per record: the other columns of ``files`` and the record's fields by ``schema``."""
    return unwrap_records(files, records_of(F.col("texto"), keys), schema)


def unwrap_records(files: DataFrame, records: Column, schema: str) -> DataFrame:
    each = files.select(*[c for c in files.columns if c != "texto"], F.explode(records).alias("r"))
    return each.withColumn("r", F.from_json(F.to_json("r"), schema)).select(*[c for c in each.columns if c != "r"], "r.*")


def total_pages(payload: Column) -> tuple[Column, Column]:
    """(whether a payload tells a number of pages, that number): the first of its keys that is not zero, false or empty; null where it is no whole number."""
    v = F.try_parse_json(payload)
    told, number = F.lit(False), F.lit(None).cast("long")
    for k in reversed(TOTAL_KEYS):
        x = F.try_variant_get(v, f"$.{k}", "variant")
        text, kind = F.try_variant_get(v, f"$.{k}", "string"), F.schema_of_variant(x)
        nothing = x.isNull() | (kind == "VOID") | (text == "") | ((kind != "STRING") & text.isin("false", "0", "0.0"))
        whole = F.when(kind == "STRING", F.when(F.rlike(text, F.lit(r"^\s*[+-]?\d+\s*$")), F.trim(text).try_cast("long")))
        whole = whole.when(kind == "BOOLEAN", F.lit(1)).otherwise(F.try_variant_get(v, f"$.{k}", "double").try_cast("long"))
        told, number = F.when(nothing, told).otherwise(F.lit(True)), F.when(nothing, number).otherwise(whole)
    return told, number


def cut_repeated_pages(pages: DataFrame, by: str, page: str, payload: str, page_size: int | None = None) -> DataFrame:
    """Pages of each sequence that a reader would have kept, by the order of ``page``.

    It stops before the first page without records or whose records, in their order, were seen before; after the first page that
    is the last by the payload's own count; and, where the payload tells no count, after the first with fewer records than ``page_size``.
    """
    found = F.coalesce(records_of(F.col(payload)), F.array().cast("array<variant>"))
    text = F.array_join(F.transform(found, lambda r: F.to_json(r)), "\n")
    told, number = total_pages(F.col(payload))
    marked = pages.withColumns({"_size": F.size(found), "_f": F.sha2(text, 256), "_told": told, "_total": number})
    seen = marked.withColumn("_r", F.row_number().over(W.partitionBy(by, "_f").orderBy(page)))
    short = F.lit(False) if page_size is None else ~F.col("_told") & (F.col("_size") < page_size)
    ends = seen.groupBy(by).agg(
        F.min(F.when((F.col("_r") > 1) | (F.col("_size") == 0), F.col(page))).alias("_cut"),
        F.min(F.when(F.coalesce(F.col(page) >= F.col("_total"), F.lit(False)) | short, F.col(page))).alias("_last"),
    )
    kept = seen.join(ends, by).where((F.col("_cut").isNull() | (F.col(page) < F.col("_cut"))) & (F.col("_last").isNull() | (F.col(page) <= F.col("_last"))))
    return kept.select(*pages.columns)
