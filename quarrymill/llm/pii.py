"""Personal data by fixed patterns and by bootstrapped context patterns, in DataFrame expressions only.

The base finds e-mail addresses, IP addresses, payment cards and telephone numbers. They seed a graph of
lexical patterns (one to three words before an entity, with the quote or bracket after it) and instances (the entities, and
other tokens that look like identifiers; of these, long hexadecimal, mixed and hyphenated ones are seeds as well).
A pattern's score is the mean confidence of the instances that it occurs with; an instance's confidence is 1 for
seeds and otherwise follows from the scores of its accepted patterns. After ROUNDS rounds, identifier-like tokens
behind an accepted pattern are spans as well, of kind "id".

Regular expressions are written so that Java's matcher takes time in proportion to the text: runs are possessive and
begin where no longer run would (or right after the match before, ``\\G``), which finds the same leftmost matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import materialize

KINDS = ("email", "ip", "card", "phone", "id")
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP_VALID = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
#: Tokens that look like identifiers: letters and digits, with single marks inside, and a digit; of any length.
TOKEN = (
    r"(?<![A-Za-z0-9])(?<![A-Za-z0-9][._/-])(?=[A-Za-z]*+(?:[._/-][A-Za-z]++)*+[._/-]?[0-9])"
    r"[A-Za-z0-9]++(?:[._/-][A-Za-z0-9]++)*+"
)
#: Tokens that are seeds by their shape: hexadecimal digits, mixed letters and digits, groups with hyphens.
DISTINCTIVE = (
    r"^(?:(?=[^0-9]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{24,}"
    r"|(?=[^0-9]*[0-9])(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])[A-Za-z0-9]{16,}"
    r"|(?=.{20})(?=(?:[^0-9]*[0-9]){4})(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9]+(?:[_-][A-Za-z0-9]+)+)$"
)
#: A pattern is the last one to three whole words, of at most so many characters, before an entity, and a closing mark after it.
CONTEXT_CHARS, CONTEXT_WORDS, CLOSING = 80, 3, "[\"'`)\\]}>]"
#: One word alone is a pattern only if it assigns or opens a quote or bracket.
SHAPED = "[=:\"'`(\\[{<]\\s*$"
ROUNDS, LEAST_SEEDS, LEAST_SCORE, LEAST_CONFIDENCE = 3, 3, 0.75, 0.8
KEPT_BROADCAST = 100_000


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        v = F.substr(d, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, v).when(v > 4, 2 * v - 9).otherwise(2 * v)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return F.when(n.between(16, 19), total % 10 == 0).otherwise(False)


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is evaluated once: a transform of one element binds it to a name."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _folded_before(values: Column, add: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """For each element of an array of longs the sum (or other fold, from 0) of those before it.

    Folds of blocks give where each block begins, and the same way is gone inside blocks. No step appends to an array
    that it carries along (which would copy it), so time grows with the power 1.25 of the elements at two levels.
    """
    zero = F.lit(0).cast("long")
    fold = lambda x: F.aggregate(x, zero, add)
    if not levels:
        return F.transform(values, lambda n, i: fold(F.slice(values, F.lit(1), i)))

    def cut(all_: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(all_))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(all_), size), lambda i: F.slice(all_, i, size))

    def placed(blocks: Column) -> Column:
        begins = _named(F.transform(blocks, fold), lambda x: _folded_before(x, add, levels - 1))
        inside = lambda block, at: F.transform(_named(block, lambda b: _folded_before(b, add, levels - 1)), lambda n: add(at, n))
        return F.flatten(F.zip_with(blocks, begins, inside))

    return F.when(F.size(values) == 0, values).otherwise(_named(cut(values), placed))


#: Of each kind, the pattern, what texts must hold for it, and what matches must fulfil.
_RULES: list[tuple[str, Callable[[Column], Column], Callable[[Column], Column] | None]] = [
    (EMAIL, lambda t: F.contains(t, F.lit("@")), None),
    (IP, lambda t: F.rlike(t, F.lit("[0-9]")) & F.contains(t, F.lit(".")), lambda m: F.rlike(m, F.lit(IP_VALID))),
    (CARD, lambda t: F.rlike(t, F.lit("[0-9]")), _luhn),
    (PHONE, lambda t: F.contains(t, F.lit("+")), lambda m: F.length(_digits(m)).between(8, 15)),
    (TOKEN, lambda t: F.rlike(t, F.lit("[0-9]")), None),
]


def _entities(text: Column, kinds: range) -> Column:
    """Array of (k, start, end, value, left, right) of valid matches by kind and start; code points, end exclusive.

    The lengths of matches and of the pieces between them give the starts.
    """

    def split(k: int) -> Column:
        pattern, may, _ = _RULES[k]
        there = may(text) & F.rlike(text, F.lit(pattern))
        cut = F.struct(
            F.lit(k).alias("k"), F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")
        )
        return F.when(there, cut)

    def good(k: Column, m: Column) -> Column:
        out = F.when(m.isNull(), False)
        for i in kinds:
            if valid := _RULES[i][2]:
                out = out.when(k == i, valid(m))
        return out.otherwise(True)

    def placed(x: Column) -> Column:
        pieces, matches = x["pieces"], x["found"]
        lengths = F.zip_with(pieces, matches, lambda p, m: (F.length(p) + F.coalesce(F.length(m), F.lit(0))).cast("long"))
        steps = F.arrays_zip(
            pieces.alias("p"),
            matches.alias("m"),
            F.slice(pieces, F.lit(2), F.size(pieces)).alias("q"),
            _named(lengths, lambda n: _folded_before(n, lambda x, y: x + y)).alias("at"),
        )
        return F.transform(
            F.filter(steps, lambda s: good(x["k"], s["m"])),
            lambda s: F.struct(
                x["k"].alias("k"),
                (s["at"] + F.length(s["p"])).cast("long").alias("start"),
                (s["at"] + F.length(s["p"]) + F.length(s["m"])).cast("long").alias("end"),
                s["m"].alias("value"),
                F.right(s["p"], F.lit(CONTEXT_CHARS + 1)).alias("left"),
                F.left(s["q"], F.lit(1)).alias("right"),
            ),
        )

    return F.flatten(F.transform(F.filter(F.array(*map(split, kinds)), lambda x: x.isNotNull()), placed))


def base_entities(text: Column) -> Column:
    """The entities of the four base kinds."""
    return _entities(text, range(4))


#: Beyond every place in a text.
_FAR = 1 << 40


def _apart(all_: Column) -> Column:
    """The tokens of ``all_`` that overlap no base entity, by a running maximum of base ends from the left and of starts from the right."""
    greatest = lambda a, b: F.greatest(a, b)
    base = lambda e, place: F.when(e["k"] < 4, place).otherwise(F.lit(0)).cast("long")
    order = F.sort_array(F.transform(all_, lambda e: F.struct(e["start"].alias("start"), e["k"].alias("k"), *(e[c].alias(c) for c in ("end", "value", "left", "right")))))

    def apart(ordered: Column) -> Column:
        ends = F.transform(ordered, lambda e: base(e, e["end"]))
        starts = F.reverse(F.transform(ordered, lambda e: base(e, F.lit(_FAR) - e["start"])))
        before = _named(ends, lambda x: _folded_before(x, greatest))
        after = F.reverse(_named(starts, lambda x: _folded_before(x, greatest)))
        free = lambda z: (z["e"]["k"] == 4) & (z["b"] <= z["e"]["start"]) & (F.lit(_FAR) - z["a"] >= z["e"]["end"])
        return F.transform(F.filter(F.arrays_zip(ordered.alias("e"), before.alias("b"), after.alias("a")), free), lambda z: z["e"])

    entity = lambda e: F.struct(*(e[c].alias(c) for c in ("k", "start", "end", "value", "left", "right")))
    tokens = F.filter(all_, lambda e: e["k"] == 4)
    mixed = F.exists(all_, lambda e: e["k"] < 4) & (F.size(tokens) > 0)
    return F.when(mixed, F.transform(_named(order, apart), entity)).otherwise(tokens)


def _patterns(left: Column, right: Column) -> Column:
    """The patterns of an entity between ``left`` and ``right``."""
    left = F.when(F.length(left) > CONTEXT_CHARS, F.regexp_replace(left, r"^\S*", "")).otherwise(left)  # whole words
    words = [F.lower(F.regexp_extract(left, rf"((?:\S+\s+){{0,{k}}}\S+\s*)$", 1)) for k in range(CONTEXT_WORDS)]
    some = F.filter(
        F.array_distinct(F.array(*words)), lambda w: (w != "") & (F.rlike(w, F.lit(r"\S\s+\S")) | F.rlike(w, F.lit(SHAPED)))
    )
    after = F.regexp_extract(right, rf"^({CLOSING})", 1)
    return F.transform(some, lambda w: F.concat(w, F.lit("\u2026"), after))


def _occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, h, base, seen: the base spans, and all entities and identifier-like tokens with their patterns."""
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", text.alias("text"))
    all_ = _entities(F.col("text"), range(5))
    with_base = read.withColumn("all", all_).withColumn("base", F.filter("all", lambda e: e["k"] < 4))
    seen = F.transform(
        F.concat("base", _apart(F.col("all"))),
        lambda e: F.struct(
            e["k"].alias("k"),
            e["start"].alias("start"),
            e["end"].alias("end"),
            _patterns(e["left"], e["right"]).alias("patterns"),
            ((e["k"] < 4) | F.rlike(e["value"], F.lit(DISTINCTIVE))).alias("seed"),
            F.xxhash64(F.lower(e["value"])).alias("instance"),
        ),
    )
    return with_base.select(
        "doc_id",
        F.xxhash64("text").alias("h"),
        F.transform("base", lambda e: F.struct(e["k"].alias("k"), e["start"].alias("start"), e["end"].alias("end"))).alias("base"),
        seen.alias("seen"),
    )


def accepted_patterns(seen: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, score) of ``seen`` (pattern, instance, seed) after ``rounds`` rounds of scoring over the whole graph."""
    edges = materialize(seen.groupBy("pattern", "instance").agg(F.max(F.col("seed").cast("int")).alias("seed")), "edges")
    # a pattern of fewer instances can't have LEAST_SEEDS trusted ones
    many = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_SEEDS).select("pattern")
    edges = materialize(edges.join(many, "pattern", "left_semi"), "edges")
    seeds = edges.where("seed = 1").select("instance").distinct()
    trusted = seeds.select("instance", F.lit(1.0).alias("confidence"))
    patterns = None
    for _ in range(rounds):
        scored = edges.join(trusted, "instance", "left").groupBy("pattern").agg(
            F.round(F.sum(F.coalesce("confidence", F.lit(0.0))) / (F.count(F.lit(1)) + 1), 6).alias("score"),
            F.count_if(F.col("confidence") >= LEAST_CONFIDENCE).alias("support"),
        )
        accepted = scored.where((F.col("support") >= LEAST_SEEDS) & (F.col("score") >= LEAST_SCORE))
        patterns = materialize(accepted.select("pattern", "score"), "patterns")
        found = (
            edges.where("seed = 0")
            .join(patterns, "pattern")
            .groupBy("instance")
            .agg(F.round(1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999))))), 6).alias("confidence"))
            .join(seeds, "instance", "left_anti")
        )
        trusted = seeds.select("instance", F.lit(1.0).alias("confidence")).union(found)
    return patterns


def _discovered(occurrences: DataFrame) -> DataFrame:
    """doc_id, h, added: the spans that accepted patterns find."""
    seen = occurrences.select("doc_id", "h", F.explode("seen").alias("s")).select("doc_id", "h", "s.*")
    seen = seen.select("doc_id", "h", "k", "start", "end", "instance", "seed", F.explode("patterns").alias("pattern"))
    patterns = accepted_patterns(seen)
    hits = seen.where("k = 4").join(patterns.select("pattern"), "pattern", "left_semi")
    span = F.struct(F.lit(4).alias("k"), "start", "end")
    return hits.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(span)).alias("added"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["k"]], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id.

    Null texts are empty: no spans. Repeated rows each get their row; rows that share a doc_id but not the text are
    kept apart by the text. An empty table gives an empty result; other columns are ignored.
    """
    occurrences = materialize(_occurrences(docs), "occurrences")
    added = materialize(_discovered(occurrences), "added")
    a = added.select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), "added")
    rows = occurrences.select("doc_id", "h", "base").join(
        a, (F.col("h") == F.col("h2")) & F.col("doc_id").eqNullSafe(F.col("d2")), "left"
    )
    extra = F.coalesce("added", F.array().cast("array<struct<k:int,start:long,end:long>>"))
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    return rows.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", extra)).alias("spans"),
        F.size(extra).cast("long").alias("n_id"),
    )


#: Texts are cut into chunks of this many code points to take parts out of them without walking from their start.
_CHUNK = 4096


def _redacted(text: Column, spans: Column) -> Column:
    """``text`` with spans replaced by their kinds; of overlapping ones the first stands for all."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k"))))

    def part(chunks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / _CHUNK).cast("int")
        last = F.floor(end / _CHUNK).cast("int")
        some = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
        return F.substr(some, (start - first * _CHUNK + 1).cast("int"), (end - start).cast("int"))

    def cut(x: Column) -> Column:
        ends = F.transform(x["spans"], lambda s: s["end"])
        reach = _named(ends, lambda e: _folded_before(e, lambda a, b: F.greatest(a, b)))
        steps = F.filter(F.arrays_zip(x["spans"].alias("s"), reach.alias("at")), lambda z: z["s"]["start"] >= z["at"])
        kept = F.transform(steps, lambda z: F.concat(part(x["chunks"], z["at"], z["s"]["start"]), F.get(names, z["s"]["k"])))
        rest = part(x["chunks"], F.array_max(ends), x["n"])
        return F.concat(F.array_join(kept, ""), rest)

    n = F.length(text).cast("long")
    chunks = F.transform(F.sequence(F.lit(0).cast("long"), n, F.lit(_CHUNK).cast("long")), lambda i: F.substr(text, (i + 1).cast("int"), F.lit(_CHUNK)))
    whole = F.struct(chunks.alias("chunks"), order.alias("spans"), n.alias("n"))
    return F.when(F.size(spans) == 0, text).otherwise(_named(whole, cut))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets, and n_chars, if there, brought up to date.

    Of overlapping spans the first stands for all. Null texts stay null. Repeated rows stay, each redacted. An empty table gives an empty result.
    Other columns stay as they are; the names __spans, __added, __d and __h are taken by the job itself.
    """
    occurrences = materialize(_occurrences(docs).drop("base"), "occurrences")
    added = materialize(_discovered(occurrences), "added")
    spans = F.transform(
        base_entities(F.coalesce("text", F.lit(""))),
        lambda e: F.struct(e["k"].alias("k"), e["start"].alias("start"), e["end"].alias("end")),
    )
    rows = docs.withColumn("__spans", spans)
    # rows and spans together bound the size
    n = added.agg(F.coalesce(F.sum(F.size("added") + 1), F.lit(0))).first()[0]
    if n:
        a = added.select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), F.col("added").alias("__added"))
        same = (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__h")) & docs["doc_id"].eqNullSafe(F.col("__d"))
        a = F.broadcast(a) if n <= KEPT_BROADCAST else a
        rows = rows.join(a, same, "left").withColumn(
            "__spans", F.concat("__spans", F.coalesce("__added", F.array().cast("array<struct<k:int,start:long,end:long>>")))
        )
    text = F.when(F.col("text").isNotNull(), _redacted(F.col("text"), F.col("__spans")))
    out = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        n_chars = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
        out = out.withColumn("n_chars", F.when(F.size("__spans") > 0, n_chars).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
