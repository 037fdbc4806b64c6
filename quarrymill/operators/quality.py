"""Row quality rules, duplicates, histories and their reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.functions.keys import first_present
from quarrymill.functions.text import present
from quarrymill.operators.ranks import distinct_counts
from quarrymill.operators.repeats import repeated_rows, with_repeats

TOLERANCE = 0.02
#: Fixed value: columns that together identify an observation.
OBSERVATION = [
    "id_compra_item", "id_item_compra", "id_compra", "numero_item", "codigo_catmat", "data_publicacao", "cnpj_fornecedor", "uasg",
    "quantidade", "valor_unitario", "unidade_comparavel",
]
#: Columns that the rules on single rows and the item key read beside these.
RULED = ["valor_total", "sigla_unidade_fornecimento", "nome_unidade_fornecimento", "purchase_id"]


def _not_positive(c: str) -> Column:
    return F.coalesce(F.col(c) <= 0, F.lit(True)) | F.isnan(F.col(c).cast("double"))


def field_rules(df: DataFrame) -> dict[str, Column]:
    """The rules on single rows; comparisons with null are false."""
    gap = F.try_divide(F.abs(F.col("valor_total") - F.col("quantidade") * F.col("valor_unitario")), F.abs("valor_total"))
    no_unit = present("sigla_unidade_fornecimento").isNull() & present("nome_unidade_fornecimento").isNull()
    return {
        "dq_codigo_ausente": F.col("codigo_catmat").isNull(),
        "dq_data_invalida": F.col("data_publicacao").try_cast("timestamp").isNull(),
        "dq_quantidade_invalida": _not_positive("quantidade"),
        "dq_valor_unitario_invalido": _not_positive("valor_unitario"),
        "dq_valor_total_invalido": _not_positive("valor_total"),
        "dq_unidade_ausente": no_unit,
        "dq_unidade_comparavel_ausente": present("unidade_comparavel").isNull(),
        "dq_valor_inconsistente": F.coalesce(gap > TOLERANCE, F.lit(False)),
    }


def _item_key(df: DataFrame) -> Column:
    return first_present(*[c for c in ("id_compra_item", "id_item_compra", "purchase_id") if c in df.columns])


def item_history(df: DataFrame) -> DataFrame:
    """Adds the item key and whether the item occurs more than once; ``df`` is read three times, so it should be cut."""
    keyed = df.withColumn("chave_item_qualidade", _item_key(df))
    key = F.col("chave_item_qualidade")
    return with_repeats(keyed, {"hist_item_repetido": [key]}, {"hist_item_repetido": key.isNotNull()})


def needed(df: DataFrame, keep: list[str]) -> list[str]:
    """Columns of ``df`` that ``apply_quality`` reads or keeps."""
    return [c for c in df.columns if c in {*OBSERVATION, *RULED, *keep} or c.startswith("dq_")]


def apply_quality(df: DataFrame, history: bool = True, keep: list[str] | None = None) -> DataFrame:
    """All flags; dq_possui_erro is any dq_ column, also one that was there before. ``df`` is read three times, so it should be cut.

    hist_item_repetido, which is no error, costs a count of all keys; without ``history`` it is left out. ``keep`` names the
    columns that stay beside the flags, those of ``df``, diferenca_valor_pct and chave_item_qualidade; without it all stay.
    Histories and duplicates are found by digests, see ``repeats``: rows are neither sorted nor shuffled as a whole.
    """
    there = [c for c in OBSERVATION if c in df.columns]
    gap = F.try_divide(F.abs(F.col("valor_total") - F.col("quantidade") * F.col("valor_unitario")), F.abs("valor_total"))
    flagged = df.withColumns(field_rules(df) | {"diferenca_valor_pct": gap, "chave_item_qualidade": _item_key(df)})
    key = F.col("chave_item_qualidade")
    # the rarer flag first: its digests are dropped before the rows of the other are shuffled
    flags = {"dq_duplicidade": [F.col(c) for c in there], "hist_item_repetido": [key]}
    if not history:
        del flags["hist_item_repetido"]
    keep = keep and [c for c in flagged.columns if c in keep or c.startswith("dq_")]
    flagged = with_repeats(flagged, flags, {"hist_item_repetido": key.isNotNull()}, keep)
    errors = [F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in flagged.columns if c.startswith("dq_") and c != "dq_possui_erro"]
    return flagged.withColumn("dq_possui_erro", reduce(lambda a, b: a | b, errors))


def quality_report(df: DataFrame) -> DataFrame:
    """regra, registros, percentual for each flag, from one aggregation."""
    rules = [c for c in df.columns if c.startswith(("dq_", "hist_")) and dict(df.dtypes)[c] == "boolean"]
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(c) for c in rules])
    long = sums.unpivot(["n"], rules, "regra", "registros")
    return long.select("regra", "registros", F.coalesce(F.try_divide(F.col("registros"), F.col("n")), F.lit(0.0)).alias("percentual"))


def extraction_report(pages: DataFrame, materials: DataFrame, start: str, end: str) -> DataFrame:
    """Per material: pages, rows, rows inside, outside and without a date, rows with a repeated id, rows and items with history.

    Repeats are looked for inside a material; nulls are equal as ids. The item key is that of the two item columns. A material
    without rows has zeros. ``pages`` is read three times, so it should be cut.
    """
    inside = (F.col("data_publicacao") >= F.lit(start).cast("timestamp")) & (
        F.col("data_publicacao") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")
    )
    keyed = pages.withColumn("_item", first_present(*[c for c in ("id_compra_item", "id_item_compra") if c in pages.columns]))
    code, item = F.col("codigo_catmat"), F.col("_item")
    marked = with_repeats(keyed, {"_twice": [code, F.col("purchase_id")], "_history": [code, item]}, {"_history": item.isNotNull()})
    got = marked.groupBy("codigo_catmat").agg(
        F.count(F.lit(1)).alias("registros_api"),
        F.count_if(inside).alias("registros_periodo"),
        F.count_if(F.col("data_publicacao").isNotNull() & ~inside).alias("fora_periodo"),
        F.count_if(F.col("data_publicacao").isNull()).alias("sem_data"),
        F.count_if("_twice").alias("observacoes_duplicadas"),
        F.count_if("_history").alias("linhas_com_item_historico"),
    )
    counts = {"paginas": F.col("pagina"), "itens_unicos_com_historico": F.when(F.col("_history"), item)}
    got = got.join(distinct_counts(marked, ["codigo_catmat"], counts), "codigo_catmat")
    return materials.select("codigo_catmat").distinct().join(got, "codigo_catmat", "left").na.fill(0)


def best_key(df: DataFrame, candidates: list[str]) -> str | None:
    """The column with the highest share of different values among those that are not blank; the first on a tie, none without values.

    One aggregation runs when this is called.
    """
    filled = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in candidates}
    counts = distinct_counts(df, [], filled).first()
    there = df.agg(*[F.count(v).alias(c) for c, v in filled.items()]).first()
    shares = {c: counts[c] / there[c] for c in candidates if there[c]}
    return max(shares, key=shares.get) if shares else None


#: Fixed value: columns of a commercial signature.
SIGNATURE = ["data_publicacao", "codigo_catmat", "quantidade", "valor_unitario", "cnpj_fornecedor", "purchase_id"]


def _kinds(df: DataFrame, key: str | None, signature: list[str] | None, kinds: tuple[str, ...] | None) -> tuple[dict, dict]:
    """Flags of duplicates and the rows that count for each."""
    text = F.trim(F.col(key).cast("string")) if key else F.lit(None).cast("string")
    flags = {
        "dup_confirmada": [text],
        "dup_linha": [F.col(f"`{c}`") for c in df.columns],
        "dup_comercial": [F.col(c) for c in signature or SIGNATURE if c in df.columns],
        "compra_varios_itens": [F.col("id_compra")],
    }
    named = lambda c: F.coalesce(c != "", F.lit(False))
    only = {"dup_confirmada": named(text), "compra_varios_itens": named(F.col("id_compra").cast("string"))}
    return {k: c for k, c in flags.items() if kinds is None or k in kinds}, only


def unrepeated(df: DataFrame, key: str | None, keep: list[str]) -> DataFrame:
    """Rows that are neither dup_confirmada nor dup_linha, see ``duplicate_kinds``, with the columns ``keep``; ``df`` should be cut.

    Equal rows have equal keys, so whole rows are compared only where the key names none.
    """
    flags, only = _kinds(df, key, None, ("dup_confirmada", "dup_linha"))
    marked = with_repeats(df, flags, only | {"dup_linha": ~only["dup_confirmada"]}, keep)
    return marked.where("not (dup_confirmada or dup_linha)").select(*keep)


def duplicate_kinds(df: DataFrame, key: str | None, signature: list[str] | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Adds dup_confirmada (the key, trimmed, is not blank and occurs again), dup_linha (the whole row does), dup_comercial (the
    signature does, nulls being equal) and compra_varios_itens (the purchase, if it is named, has more rows), or those in ``kinds``.

    ``df`` is read three times, so it should be cut.
    """
    return with_repeats(df, *_kinds(df, key, signature, kinds))


def duplicate_counts(df: DataFrame, key: str | None, signature: list[str] | None = None) -> DataFrame:
    """The report of ``duplicate_report`` without the flags of the rows; ``df`` should be cut."""
    return _report(df.agg(F.count(F.lit(1)).alias("registros_totais")).crossJoin(F.broadcast(repeated_rows(df, *_kinds(df, key, signature, None)))), key)  # one row each


#: The metrics of the duplicate report, the flags they count, and what they say.
METRICS = {
    "duplicados_confirmados": ("dup_confirmada", "Mesma chave única repetida"),
    "duplicados_integrais": ("dup_linha", "Linhas integralmente iguais"),
    "repeticoes_comerciais": ("dup_comercial", "Mesma assinatura comercial"),
    "linhas_em_compras_com_multiplos_itens": ("compra_varios_itens", "Repetição esperada de id_compra"),
}


def duplicate_report(df: DataFrame, key: str | None) -> DataFrame:
    """metrica, valor (as text), interpretacao of a table with the flags of ``duplicate_kinds``, from one aggregation."""
    return _report(df.agg(F.count(F.lit(1)).alias("registros_totais"), *[F.count_if(flag).alias(flag) for flag, _ in METRICS.values()]), key)


def _report(one: DataFrame, key: str | None) -> DataFrame:
    """metrica, valor, interpretacao from a row of counts by flag."""
    rows = [("registros_totais", F.col("registros_totais"), "Total de linhas"), ("chave_unica_utilizada", F.lit(key or "NAO_IDENTIFICADA"), "Chave de item")]
    rows += [(k, F.col(flag), says) for k, (flag, says) in METRICS.items()]
    told = F.array(*[F.struct(F.lit(k).alias("metrica"), v.cast("string").alias("valor"), F.lit(says).alias("interpretacao")) for k, v, says in rows])
    return one.select(F.inline(told))


def unit_quality_report(df: DataFrame, outliers: DataFrame) -> DataFrame:
    """metrica, valor: rows, rows with and without a unit and their percentage, outliers of ``outlier_gravidade`` and the critical ones."""
    informed = F.coalesce(F.trim("nome_unidade_fornecimento") != "", F.lit(False))
    a = df.agg(
        F.count(F.lit(1)).alias("registros"),
        F.count_if(informed).alias("unidade_informada"),
        F.count_if(~informed).alias("unidade_nao_informada"),
        F.round(100.0 * F.try_divide(F.count_if(informed), F.count(F.lit(1))), 2).alias("percentual_unidade_informada"),
    )
    b = outliers.agg(F.count(F.lit(1)).alias("outliers_recalculados"), F.count_if(F.col("outlier_gravidade") == "CRITICO").alias("outliers_criticos"))
    one = a.crossJoin(F.broadcast(b))  # one row each
    return one.select([F.col(c).cast("double").alias(c) for c in one.columns]).unpivot([], one.columns, "metrica", "valor")


def field_fill(df: DataFrame, columns: list[str], examples: int = 15) -> DataFrame:
    """Per column: filled, missing, percent, different values, and the least values as examples.

    Values are counted first. The list of least values is cut to ``examples`` in every task before it is shuffled (a rank with a
    limit is applied on both sides of the exchange), so that no task sees a column's values together.
    """
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("campo"), present(c).alias("v")) for c in columns])))
    counts = long.groupBy("campo", "v").agg(F.count(F.lit(1)).alias("n"))
    filled = F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0))
    sums = counts.groupBy("campo").agg(
        filled.alias("preenchidos"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("ausentes"),
        (100.0 * filled / F.sum("n")).alias("percentual"),
        F.count("v").alias("distintos"),
    )
    rank = F.row_number().over(W.partitionBy("campo").orderBy("v"))
    least = counts.where("v is not null").select("campo", "v").withColumn("r", rank).where(F.col("r") <= examples)
    shown = least.groupBy("campo").agg(F.array_join(F.sort_array(F.collect_list("v")), "; ").alias("exemplos"))
    return sums.join(shown, "campo", "left").withColumn("exemplos", F.coalesce("exemplos", F.lit("")))
