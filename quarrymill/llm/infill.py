"""Fill-in-middle texts, cut at line ends through a learned index of ranks.

The boundaries of a text are 0 and the end of every line. ``with_boundaries`` fits straight pieces to the offsets of
all of them: a piece grows while some slope from its first boundary stays within ``error`` bytes of every offset
(a cone that narrows), so there are far fewer pieces than lines. What a piece misses is stored as a residual of two
bytes. A cut at rank k is then predicted by the piece that holds k and corrected by the residual, which gives the exact
offset without another look at the text, so the same index serves any number of draws.

Fitting is Arrow code on the column of texts alone; drawing, cutting and rebuilding are column expressions. There is
no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import BATCH_BYTES

#: Bytes that a prediction may be off; residuals are of two bytes, so it must be below 32,000.
ERROR = 128
#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
INDEX = "struct<n: bigint, rank: array<int>, base: array<bigint>, slope: array<double>, residual: array<smallint>>"


def boundaries(text: bytes) -> np.ndarray:
    """0 and the end of each line, a last line without its mark included."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    tail = [len(text)] if len(text) and (not len(ends) or ends[-1] < len(text)) else []
    return np.concatenate([[0], ends, tail]).astype(np.int64)


def pieces(o: np.ndarray, error: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first rank, offset there, slope) of straight pieces that miss no offset by more than ``error``."""
    rank, slope, at, n = [], [], 0, len(o)
    while at < n:
        width, best = 64, (1, 0.0)
        while True:
            y = o[at + 1 : at + width]
            x = np.arange(1, len(y) + 1)
            low = np.maximum.accumulate((y - o[at] - error) / x)
            high = np.minimum.accumulate((y - o[at] + error) / x)
            fits = int(np.argmax(low > high)) if (low > high).any() else len(y)
            best = (fits + 1, float(low[fits - 1] + high[fits - 1]) / 2 if fits else 0.0)
            if fits < len(y) or at + width >= n:
                break
            width *= 4
        rank.append(at)
        slope.append(best[1])
        at += best[0]
    rank = np.array(rank, np.int32)
    return rank, o[rank], np.array(slope)


def predicted(rank: np.ndarray, base: np.ndarray, slope: np.ndarray, k: np.ndarray) -> np.ndarray:
    piece = np.searchsorted(rank, k, "right") - 1
    return base[piece] + np.floor(slope[piece] * (k - rank[piece])).astype(np.int64)


def _index(error: int):
    def run(texts: pa.Array) -> pa.Array:
        cols: list[list] = [[], [], [], [], []]
        for t in texts.cast(pa.binary()):
            o = boundaries(t.as_py() or b"")
            rank, base, slope = pieces(o, error)
            left = o - predicted(rank, base, slope, np.arange(len(o)))
            for c, v in zip(cols, (len(o) - 1, rank, base, slope, left.astype(np.int16)), strict=True):
                c.append(v)
        return pa.StructArray.from_arrays(
            [pa.array(cols[0], pa.int64())] + [_lists(c, kind) for c, kind in zip(cols[1:], (pa.int32(), pa.int64(), pa.float64(), pa.int16()), strict=True)],
            ["n", "rank", "base", "slope", "residual"],
        )

    return run


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=at[1:])
    return pa.ListArray.from_arrays(at, pa.array(np.concatenate(rows) if rows else [], kind))


def with_boundaries(docs: DataFrame, error: int = ERROR) -> DataFrame:
    """(doc_id, text, boundaries): texts, null ones empty, with the index of their lines; other columns are left out.

    Written as a table it serves later draws with other seeds. Each row is worked on alone: repeated rows, null ids and
    an empty table are as they are. Without text there is one boundary, 0.
    """
    if not 0 < error < 32_000:
        raise ValueError("error must be between 1 and 31,999 bytes")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    fit = F.arrow_udf(_index(error), INDEX)
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return whole.withColumn("boundaries", fit("text"))


def cut_at(k: Column, index: Column) -> Column:
    """Offset in bytes of boundary ``k``: the piece's prediction and the stored residual."""
    piece = F.size(F.filter(index["rank"], lambda r: r <= k)) - 1
    ahead = F.get(index["slope"], piece) * (k - F.get(index["rank"], piece))
    return F.get(index["base"], piece) + F.floor(ahead) + F.get(index["residual"], k.cast("int"))


def _draws(seed: int) -> list[Column]:
    """h1 to h4: the first four groups of eight hexadecimal digits of the hash of seed and doc_id (null: no digits)."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(indexed: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output) for each row of ``with_boundaries``.

    ``rate`` of a hundred texts are transformed and ``spm`` of a hundred of these begin with the suffix. Texts that are
    empty or hold one of the marks stay as they are, with form plain and null lengths.
    """
    drawn = indexed.withColumns(dict(zip(("h1", "h2", "h3", "h4"), _draws(seed), strict=True)))
    n = F.col("boundaries.n")
    ranked = drawn.withColumns({"k1": F.least(F.col("h1") % (n + 1), F.col("h2") % (n + 1)), "k2": F.greatest(F.col("h1") % (n + 1), F.col("h2") % (n + 1))})
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    cut = ranked.select(
        "doc_id", "text", n.alias("n"), form.alias("form"), cut_at(F.col("k1"), F.col("boundaries")).alias("a"), cut_at(F.col("k2"), F.col("boundaries")).alias("b")
    )
    piece = lambda a, b: F.decode(F.substring(F.encode("text", "UTF-8"), (a + 1).cast("int"), (b - a).cast("int")), "UTF-8")
    size = F.octet_length("text").cast("long")
    cut = cut.withColumns({"p": piece(F.lit(0), F.col("a")), "m": piece(F.col("a"), F.col("b")), "s": piece(F.col("b"), size)})
    psm = F.concat(F.lit(PREFIX), "p", F.lit(SUFFIX), "s", F.lit(MIDDLE), "m")
    spm_ = F.concat(F.lit(SUFFIX), "s", F.lit(PREFIX), "p", F.lit(MIDDLE), "m")
    made = F.col("form") != "plain"
    return cut.select(
        "doc_id",
        "text",
        "n",
        "form",
        F.when(made, F.char_length("p").cast("long")).alias("prefix_chars"),
        F.when(made, F.char_length("m").cast("long")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("text")).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of; exact, as a transformed text holds no mark."""
    second, body = F.when(form == "psm", SUFFIX).otherwise(PREFIX), F.substr(output, F.lit(4))
    first = F.substr(body, F.lit(1), F.instr(body, second) - 1)
    rest = F.substr(body, F.instr(body, second) + 3)
    next_ = F.substr(rest, F.lit(1), F.instr(rest, F.lit(MIDDLE)) - 1)
    middle = F.substr(rest, F.instr(rest, F.lit(MIDDLE)) + 3)
    return F.when(form == "psm", F.concat(first, middle, next_)).when(form == "spm", F.concat(next_, middle, first)).otherwise(output)


def digest(made: DataFrame) -> DataFrame:
    """Hashes in place of texts."""
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
