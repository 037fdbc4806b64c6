"""Toxicity, fill-in-middle and the filter audit against plain versions."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrymill.llm import filter_audit, infill, toxicity
from quarrymill.llm.common import table

LABELS = "doc_id long, quality int, toxic int"

# toxicity


def plain_grams(text):
    t = " " + "".join(c if c.isalnum() else " " for c in f" {text.lower()} ").strip(" ") + " " if text.strip() else " "
    t = re.sub(" +", " ", t)
    return {t[i : i + n] for n in range(toxicity.LEAST, toxicity.MOST + 1) for i in range(len(t) - n + 1)}


def test_grams_are_those_of_each_text_alone():
    texts = ["An idiot!", "", "ÄB  c-d", "x", "idiot", "an IDIOT", "lío " * 40]
    of, k = toxicity.grams(texts)
    got = [set(k[of == i]) for i in range(len(texts))]
    assert [len(g) for g in got] == [len(plain_grams(t)) for t in texts]  # no two of these few share a number
    assert got[0] == got[5] and got[4] < got[0] | got[4]
    for i, t in enumerate(texts):
        assert set(toxicity.grams([t])[1]) == got[i]
    keep = np.zeros(1 << toxicity.BITS, bool)
    keep[sorted(got[4])[:3]] = True
    assert set(toxicity.grams(texts, keep)[1]) == set(sorted(got[4])[:3])


def test_ratios_and_weights_are_those_of_a_plain_version(spark):
    words = ["red", "green", "blue", "house", "tree", "river", "stone", "cloud"]
    rows = [(i % 5 == 0, " ".join(words[(i * k + k * k) % 8] for k in range(1, 12)) + (" you vile toad" if i % 5 == 0 else "")) for i in range(200)]
    df = spark.createDataFrame([(int(y), t) for y, t in rows], "y int, text string")
    got = {r["number"]: r["ratio"] for r in rows_of(toxicity.log_count_ratios(df))}
    pos, neg = Counter(), Counter()
    for y, t in rows:
        (pos if y else neg).update(set(toxicity.grams([t])[1].tolist()))
    p, q = sum(y for y, _ in rows), sum(not y for y, _ in rows)
    want = {}
    for k in {*pos, *neg}:
        r = np.log((pos[k] + 1) / (p + 2)) - np.log((neg[k] + 1) / (q + 2))
        if abs(r) >= 1 and abs(r) >= 3 * np.sqrt(1 / (pos[k] + 1) + 1 / (neg[k] + 1)):
            want[k] = r
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)

    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(y)) for i, (y, _) in enumerate(rows)], LABELS)
    model = toxicity.Classifier(docs, labels).model.value
    dense = dict(zip(model.number.tolist(), zip(model.scale.tolist(), model.weight, strict=True), strict=True))
    for text in ("you vile toad", "red house and green tree", "", rows[5][1]):
        have = [dense[k] for k in {*toxicity.grams([text])[1].tolist()} & dense.keys()]
        z = sum(r * w for r, w in have) / max(np.sqrt(sum(r * r for r, _ in have)), 1e-9) + model.bias
        assert abs(model.probability([text])[0] - 1 / (1 + np.exp(-z))) < 1e-6
    assert model.probability(["oh you vile toad"])[0] > 0.5 > 0.3 > model.probability(["river stone cloud"])[0]


def test_held_out_toxicity(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.1")
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    got = {r["doc_id"]: r for r in rows_of(toxicity.Classifier(docs, labels).score(docs))}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(p for p, y in held if y) > 0.9 * sum(y for _, y in held)
    assert sum(p for p, y in held if not y) < 0.02 * sum(not y for _, y in held)


def test_odd_rows_and_labels(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 1, 0), (5, None, None), (None, 1, 1), (6, 0, 1), (8, 1, 0), (9, 1, 0)], LABELS)
    model = toxicity.Classifier(odd, labels)
    got = rows_of(model.score(odd))
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows_of(odd))
    assert all(0 <= r["score"] <= 1 for r in got) and not next(r for r in got if r["doc_id"] is None)["held_out"]
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4, 5)}) == 1  # null, empty and blank
    assert model.drop_toxic(odd).columns == odd.columns and model.drop_toxic(odd).count() == sum(r["predicted"] == 0 for r in got)
    assert rows_of(model.score(none)) == []
    empty = toxicity.Classifier(none, labels.where("false"))
    assert {r["score"] for r in rows_of(empty.score(odd))} == {0.5}


# fill-in-middle

lines = st.lists(st.text(st.sampled_from("ab\n é😀"), max_size=60), max_size=80).map("\n".join)


@settings(max_examples=150, deadline=None)
@given(lines, st.integers(1, 300))
def test_boundaries_are_predicted_within_the_error_and_corrected(text, error):
    data = text.encode()
    o = infill.boundaries(data)
    ends = itertools.accumulate(len(x.encode()) for x in re.findall(r"[^\n]*\n|[^\n]+", text))
    assert o.tolist() == [0, *ends]
    rank, base, slope = infill.pieces(o, error)
    left = o - infill.predicted(rank, base, slope, np.arange(len(o)))
    assert abs(left).max() <= error + 1 and rank[0] == 0 and (np.diff(rank) > 0).all()


def test_even_lines_are_one_piece():
    o = infill.boundaries(b"0123456789\n" * 5000)
    assert len(infill.pieces(o, 1)[0]) == 1
    assert len(infill.pieces(infill.boundaries(b"".join(b"x" * (k % 97) + b"\n" for k in range(20_000))), 128)[0]) < 20_000 / 20


def plain_fim(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("seed", "rate", "spm"), [(7, 100, 50), (3, 60, 20)])
def test_fill_in_middle(spark, docs, odd, none, seed, rate, spm):
    more = spark.createDataFrame(
        [(20, "a <P> b\nc", 1), (21, "x\n<\n<P\nS>\n", 2), (22, "\n\n\n", 3), (23, "é😀\n" * 5000 + "end", 4), (24, "<S", 5), (25, "a\r\nb\r", 6)], "doc_id long, text string, n int"
    )
    for df in (docs, odd, more, none):
        source = Counter((r["doc_id"], *plain_fim(r["doc_id"], r["text"], seed, rate, spm)) for r in df.collect())
        made = infill.fill_in_middle(infill.with_boundaries(df), seed, rate, spm)
        assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows_of(made)) == source
        for r in rows_of(infill.digest(made)):
            assert r["output_sha256"] == r["restored_sha256"] if r["form"] == "plain" else r["output_sha256"] != r["restored_sha256"]
        restored = Counter((r["doc_id"], r["restored_sha256"]) for r in rows_of(infill.digest(made)))
        assert restored == Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in df.collect())


# filter audit


def plain_masks(docs, labels):
    out, first = defaultdict(Counter), {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, bad = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t],
        ]
        out[part or ""][frozenset(c for c, f in zip("ABCDE", fails, strict=True) if f), i is not None and i in good, i is not None and i in bad] += 1
    return out


def plain_audit(docs, labels):
    rows = set()
    for part, masks in plain_masks(docs, labels).items():
        removed_by = Counter()
        steps = []
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before, c = set(order[: step - 1]), Counter()
                for (fails, good, bad), n in masks.items():
                    c["kept"] += n * (not fails & (before | {f}))
                    here = f in fails and not fails & before
                    c["removed"] += n * here
                    c["redundant"] += n * (f in fails and bool(fails & before))
                    c["unique"] += n * (fails == {f})
                    c["good"] += n * (here and good)
                    c["toxic"] += n * (here and bad)
                removed_by[f] += c["removed"]
                steps.append(("".join(order), step, f, c))
        rows |= {(part, o, s, c["kept"], c["removed"], c["redundant"], c["unique"], c["good"], c["toxic"], removed_by[f]) for o, s, f, c in steps}
    return rows


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit(spark, docs, odd, none, sf_dir):
    known = table(spark, sf_dir, "labels")
    some = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, None, None), (8, 1, None), (None, 1, 1), (99, 1, 1)], LABELS)
    for df, labels in ((docs, known), (odd, some), (none, some), (odd, some.where("false"))):
        want = plain_audit([(r["doc_id"], r["text"], r["lang"]) for r in df.collect()], [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()])
        got = rows_of(filter_audit.audit(df, labels))
        assert len(got) == len(want) and {tuple(r[c] for c in COLUMNS) for r in got} == want


@pytest.mark.parametrize("blocks", [1, 2, 64])
def test_counters_clear_no_repeat(spark, blocks):
    """With few blocks more unique texts stay open, but never is a repeat cleared, so the result does not depend on it."""
    from pyspark.sql import functions as F

    rows = [(i, f"text {i % 700 if i % 3 else i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    bits = filter_audit.repeated_counters(df.select("h"), blocks)
    left = {r["doc_id"] for r in rows_of(filter_audit._possible(df, bits, blocks))}
    times = Counter(t for _, t in rows)
    assert {i for i, t in rows if times[t] > 1} <= left
    if blocks == 64:
        assert len(left) < sum(times[t] > 1 for _, t in rows) + 20
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert {r["doc_id"] for r in rows_of(filter_audit.repeats(df, df.select("doc_id", "h"), 3000))} == {i for i, t in rows if first[t] != i}
