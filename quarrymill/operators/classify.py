"""Classification by weighted terms; rule tables are parameters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.keys import coverage_score
from quarrymill.functions.text import has_word, normalize_text, upper_text
from quarrymill.operators.filters import one_per

NO_TEXT, NO_MATCH = "texto vazio", "nenhuma familia atingiu a pontuacao minima"
Family = Mapping[str, object]


def rule_table(spark, families: Mapping[str, Family]) -> DataFrame:
    """Families (label, priority, include [(term, weight)], exclude [term]) as rows, in order."""
    rows = []
    for n, (code, f) in enumerate(families.items()):
        rows += [(n, code, f["label"], f["priority"], k, t, w, False) for k, (t, w) in enumerate(f["include"])]
        rows += [(n, code, f["label"], f["priority"], k, t, 0, True) for k, t in enumerate(f.get("exclude", []))]
    return spark.createDataFrame(rows, "ordem int, familia string, rotulo string, prioridade int, posicao int, termo string, peso int, exclui boolean")


def classify(df: DataFrame, text: str, families: Mapping[str, Family], minimum: int = 2) -> DataFrame:
    """Adds familia_codigo, familia_material, classificacao_score, classificacao_motivo, texto_normalizado.

    Different texts are classified once. The best family has the highest score, then the lower priority, more terms,
    and the earlier rule. The rules are as many as given, so they may be broadcast.
    """
    texts = df.select(F.col(text).alias("_t")).distinct().withColumn("texto_normalizado", normalize_text("_t"))
    rules = F.broadcast(rule_table(df.sparkSession, families))
    hits = texts.join(rules, F.contains("texto_normalizado", F.col("termo")))
    term = F.concat("termo", F.lit(" (+"), F.col("peso").cast("string"), F.lit(")"))
    scored = hits.groupBy("_t", "ordem", "familia", "rotulo", "prioridade").agg(
        F.bool_or("exclui").alias("fora"),
        F.sum("peso").alias("classificacao_score"),
        F.count_if(~F.col("exclui")).alias("n"),
        F.sort_array(F.collect_list(F.when(~F.col("exclui"), F.struct("posicao", term.alias("s"))))).alias("termos"),
    )
    good = scored.where(~F.col("fora") & (F.col("classificacao_score") >= minimum))
    best = one_per(good, ["_t"], F.desc("classificacao_score"), F.asc("prioridade"), F.desc("n"), F.asc("ordem"))
    best = best.select("_t", F.col("familia").alias("familia_codigo"), F.col("rotulo").alias("familia_material"), "classificacao_score", F.array_join(F.transform("termos", lambda x: x["s"]), "; ").alias("classificacao_motivo"))
    told = texts.withColumnRenamed("_t", "_k").join(best, F.col("_k").eqNullSafe(F.col("_t")), "left").drop("_t").withColumns(
        {
            "classificacao_score": F.coalesce("classificacao_score", F.lit(0)),
            "classificacao_motivo": F.coalesce("classificacao_motivo", F.when(F.col("texto_normalizado") == "", NO_TEXT).otherwise(NO_MATCH)),
        }
    )
    return df.join(told, F.col(text).eqNullSafe(F.col("_k")), "left").drop("_k")


def override(classified: DataFrame, overrides: DataFrame, families: Mapping[str, Family], code: str = "codigo") -> DataFrame:
    """Manual decisions: excluir clears the family, incluir sets it with score 999; anything else is an error."""
    o = overrides.select(F.col(code).alias("_o"), F.lower(F.trim("acao")).alias("_a"), F.col("familia_codigo").alias("_f"))
    labels = F.create_map(*[F.lit(x) for k, f in families.items() for x in (k, f["label"])])
    label = F.try_element_at(labels, F.col("_f"))
    out = classified.join(o, F.col(code) == F.col("_o"), "left")
    bad = F.col("_a").isNotNull() & (~F.col("_a").isin("excluir", "incluir") | ((F.col("_a") == "incluir") & label.isNull()))
    action = F.when(bad, F.raise_error(F.concat(F.lit("bad override of "), F.col(code).cast("string"))).cast("string")).otherwise(F.col("_a"))
    out = out.withColumn("_a", action)
    drop_, put = F.col("_a") == "excluir", F.col("_a") == "incluir"
    return out.withColumns(
        {
            "familia_codigo": F.when(drop_, None).when(put, F.col("_f")).otherwise(F.col("familia_codigo")),
            "familia_material": F.when(drop_, None).when(put, label).otherwise(F.col("familia_material")),
            "classificacao_score": F.when(drop_, 0).when(put, 999).otherwise(F.col("classificacao_score")),
            "material_relevante": F.when(drop_, False).when(put, True).otherwise(F.col("familia_codigo").isNotNull()),
        }
    ).drop("_o", "_a", "_f")


def keyword_tier(text: Column, words: list[str]) -> Column:
    """Struct (palavra, score) of the best word: 100 equal, 80 at the start, 60 inside; the first on a tie."""
    def tier(w: str) -> Column:
        return F.when(text == w, 100).when(F.startswith(text, F.lit(w)), 80).when(F.contains(text, F.lit(w)), 60).otherwise(0)

    options = F.array(*[F.struct(tier(w).alias("score"), F.lit(-i).alias("i"), F.lit(w).alias("palavra")) for i, w in enumerate(words)])
    best = F.array_max(options)
    return F.when(best["score"] > 0, F.struct(best["palavra"].alias("palavra"), best["score"].alias("score")))


def term_score(text: Column, terms: Mapping[str, int]) -> tuple[Column, Column]:
    """Sum of the weights of contained terms, and the terms joined by commas."""
    if not terms:
        return F.lit(0), F.lit("")
    hit = [F.when(F.contains(text, F.lit(t)), F.struct(F.lit(t).alias("t"), F.lit(w).alias("w"))) for t, w in terms.items()]
    found = F.array_compact(F.array(*hit))
    return F.aggregate(found, F.lit(0), lambda s, x: s + x["w"]), F.array_join(F.transform(found, lambda x: x["t"]), ", ")


def contains_any(text: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def anchored_score(text: Column, positive: Mapping[str, int], penalty: Mapping[str, int], anchor: str) -> Column:
    """Score with penalties, and 100 less without the anchor word."""
    return term_score(text, positive)[0] + term_score(text, penalty)[0] + F.when(F.contains(text, F.lit(anchor)), 0).otherwise(-100)


def group_eligibility(df: DataFrame, texts: list[str], measure: Mapping[str, int], electric: Mapping[str, int], exclude: Mapping[str, int], least: int = 30) -> DataFrame:
    """Scores of a product group's texts; eligible with both contexts and at least ``least`` in all."""
    text = upper_text(F.concat_ws(" / ", *texts))
    out = df.withColumn("_t", text)
    for name, terms in (("medicao", measure), ("eletrico", electric), ("exclusao", exclude)):
        score, hits = term_score(F.col("_t"), terms)
        out = out.withColumn(f"score_{name}", score).withColumn(f"termos_{name}", hits)
    out = out.withColumn("score_total", F.col("score_medicao") + F.col("score_eletrico") + F.col("score_exclusao"))
    return out.withColumn("elegivel", (F.col("score_medicao") > 0) & (F.col("score_eletrico") > 0) & (F.col("score_total") >= least)).drop("_t")


def item_category(text: Column, ordered: list[tuple[str, list[str]]], active: str, reactive: str, labels: tuple[str, str, str]) -> Column:
    """First label with one of its terms; then by the words for active and reactive energy."""
    out = None
    for label, terms in ordered:
        test = contains_any(text, terms)
        out = F.when(test, label) if out is None else out.when(test, label)
    a, r = has_word(text, active), has_word(text, reactive)
    return out.when(a & r, labels[0]).when(r, labels[1]).otherwise(labels[2])


def item_status(text: Column, score: Column, hard: list[str], meter: list[str], energy: list[str], special: list[str], active: str, reactive: str, good: int = 65) -> Column:
    """DESCARTAR, ESPECIALIZADO, ADERENTE or REVISAR."""
    only_reactive = has_word(text, reactive) & ~has_word(text, active)
    return (
        F.when(contains_any(text, hard) | ~contains_any(text, meter) | ~contains_any(text, energy), "DESCARTAR")
        .when(only_reactive | contains_any(text, special), "ESPECIALIZADO")
        .when(score >= good, "ADERENTE")
        .otherwise("REVISAR")
    )


def best_items(df: DataFrame, keep: tuple[str, ...] = ("ADERENTE", "REVISAR", "ESPECIALIZADO")) -> DataFrame:
    """One row per code, best status, score, category and text first; some statuses only."""
    order = F.array_position(F.array(*map(F.lit, keep)), F.col("status_classificacao"))
    best = one_per(df, ["codigo"], F.when(order == 0, 99).otherwise(order).asc(), F.desc("score_relevancia_tecnica"), F.asc("categoria_tecnica"), F.asc("descricao"))
    return best.where(F.col("status_classificacao").isin(*keep))


def rank_candidates(catalogue: DataFrame, coverage: DataFrame, review_family: str) -> DataFrame:
    """Technical and volume score, need of a review, criterion; best of each family first.

    ``coverage``: codigo, ordem, total_registros_api; the last row of a code counts.
    """
    last = one_per(coverage, ["codigo"], F.desc("ordem")).select("codigo", "total_registros_api")
    out = catalogue.join(last, "codigo", "left").withColumn("total_registros_api", F.coalesce("total_registros_api", F.lit(0)))
    out = out.withColumn("score_volume", coverage_score("total_registros_api"))
    tech = F.col("score_relevancia_tecnica")
    out = out.withColumn("score_preliminar", tech + F.col("score_volume"))
    doubt = (tech < 35) | (F.length(F.coalesce("termos_penalizados", F.lit(""))) > 0)
    out = out.withColumn("revisao_manual_obrigatoria", (F.col("familia_material") == review_family) & doubt)
    why = (
        F.when(F.col("total_registros_api") == 0, "Sem registros de preço")
        .when(tech < 20, "Baixa aderência técnica")
        .when(F.col("revisao_manual_obrigatoria"), "Revisão técnica obrigatória")
        .otherwise("Candidato para auditoria temporal")
    )
    return out.withColumn("criterio_selecao", why).orderBy("familia_material", F.desc("score_preliminar"), F.desc("total_registros_api"))


def family_name(explicit: Column, code: Column, names: Mapping[str, str]) -> Column:
    return F.coalesce(explicit, F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), code))


def best_family_per_group(df: DataFrame) -> DataFrame:
    return one_per(df, ["codigo_pdm"], F.asc("familia_codigo"), F.desc("score_selecao"), F.asc("nome_pdm"))


