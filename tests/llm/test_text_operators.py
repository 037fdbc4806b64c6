"""Duplicates, decontamination, personal data, perplexity, quality: against plain versions and on odd tables."""

import hashlib
import time
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from quarrymill.llm import decontaminate, near_dedup, perplexity, pii, quality_classifier


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("size", [4, 5])
@pytest.mark.parametrize("name", ["docs", "odd"])
def test_near_duplicates(name, size, request):
    df = request.getfixturevalue(name)
    source = texts(df)
    groups = brute.groups(source, size)
    want = sorted((str(i), len(brute.shingles(t, size)), str(groups.get(i)), i is None or groups[i] == i) for i, t in source)
    got = sorted(
        (str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in rows_of(near_dedup.near_duplicates(df, size))
    )
    assert got == want
    kept = near_dedup.drop_near_duplicates(df, size)
    assert kept.columns == df.columns
    assert sorted(i for i, _ in texts(kept) if i is not None) == sorted({i for i, c in groups.items() if i == c})


def test_near_duplicates_in_a_large_group_and_a_chain(spark):
    rng = np.random.default_rng(1)
    base = [f"b{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):  # near copies of one text, few of which are near each other
        w = list(base)
        for k in rng.choice(120, 3, replace=False):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(200)]
    for i in range(40):  # each near the next one only
        rows.append((1000 + i, " ".join(chain[4 * i :] + [f"d{k}" for k in range(4 * i)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in rows_of(near_dedup.near_duplicates(df))}
    assert got == brute.groups(rows)


def test_signature_distance_guarantee():
    """All pairs of signatures within LIMIT share a key."""
    rng = np.random.default_rng(3)
    import pyarrow as pa

    a = rng.integers(0, 2**16, near_dedup.K, dtype=np.uint64).astype("<u2")
    for _ in range(200):
        b = a.copy()
        b[rng.choice(near_dedup.K, near_dedup.LIMIT, replace=False)] ^= 1
        batch = pa.RecordBatch.from_arrays([pa.array([a.tobytes(), b.tobytes()]), pa.array([1, 2])], ["signature", "doc_id"])
        out = next(near_dedup._keys(iter([batch]))).to_pandas()
        assert (out.groupby("key")["doc_id"].nunique() > 1).any()


@pytest.mark.parametrize("name", ["docs", "odd"])
@pytest.mark.parametrize("block_words", [10**6, 30])
def test_contamination(name, block_words, request, spark, sf_dir):
    df = request.getfixturevalue(name)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    if name == "odd":
        items = [(1, "Lazy DOG and"), (2, "one"), (3, None), (4, ""), (None, "w5 w6"), (5, "over the lazy dog and runs away from a BIG bear!"), (5, "two")]
    elif block_words == 30:
        all_texts = [t for _, t in texts(df)]
        hit = [i for i in items if any(brute.contamination(t, [i])[-1] for t in all_texts)]
        items = hit[:3] + [i for i in items if i not in hit][:2]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(i), *brute.contamination(t, items)) for i, t in texts(df))
    out = rows_of(decontaminate.contamination(df, bench, block_words=block_words))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out)
    assert got == want
    assert any(w[-1] for w in want)
    assert all((r["longest_match"] > 0) == r["contaminated"] for r in out)
    kept = decontaminate.drop_contaminated(df, bench, block_words=block_words)
    assert kept.columns == df.columns
    assert Counter(str(i) for i, _ in texts(kept)) == Counter(w[0] for w in want if not w[-1])


def test_longest_match(spark):
    words = [f"q{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, "a b " + " ".join(words[3:30]) + " c"), (2, "a " + " ".join(words[:9]))], "doc_id long, text string")
    bench = spark.createDataFrame([("it", " ".join(words))], "item_id string, text string")
    got = {r["doc_id"]: (r["longest_match"], r["longest_at"], r["longest_item"]) for r in rows_of(decontaminate.contamination(docs, bench))}
    assert got == {1: (27, 2, "it"), 2: (0, None, None)}


def plain_longest(words, items, window=10):
    """(length, place, item, place there) by trying all places."""
    best = (0, None, None, None)
    for p in range(len(words)):
        for k, (name, w) in enumerate(items):
            need = min(window, len(w))
            for q in range(len(w) - need + 1):
                n = 0
                while p + n < len(words) and q + n < len(w) and words[p + n] == w[q + n]:
                    n += 1
                if n >= need and n > best[0]:
                    best = (n, p, name, q)
    return best


def test_longest_matches_equal_a_plain_search_on_repetitive_texts(spark):
    rng = np.random.default_rng(11)
    make = lambda n, k: [f"v{x}" for x in rng.integers(0, k, n)]
    items = [(f"i{k}", make(rng.integers(3, 40), 2 + k % 2)) for k in range(12)] + [("same", ["v0"] * 25), ("again", ["v0"] * 25)]
    docs = [(i, make(rng.integers(0, 60), 2)) for i in range(40)] + [(90, ["v0"] * 60), (91, items[3][1] + ["zz"] + items[3][1])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id string, text string").coalesce(1)
    got = {r["doc_id"]: (r["longest_match"], r["longest_at"], r["longest_item"], r["longest_item_at"]) for r in rows_of(decontaminate.contamination(df, bench))}
    assert got == {i: plain_longest(w, items) for i, w in docs}


def test_contamination_of_texts_of_one_word_takes_no_quadratic_time(spark):
    df = spark.createDataFrame([(1, "w " * 1_000_000), (2, "w v " * 300_000)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "w " * 1000), ("b", "w v " * 400), ("c", "w " * 1000)], "item_id string, text string")
    began = time.time()
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["longest_match"]) for r in rows_of(decontaminate.contamination(df, bench))}
    assert got == {1: (1_000_000, 2, 1000), 2: (600_000, 1, 800)}
    assert time.time() - began < 60


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_personal_data(name, request):
    df = request.getfixturevalue(name)
    source = texts(df)
    out = rows_of(pii.find_personal_data(df))
    want, got = [], []
    for i, t in source:
        spans = brute.personal_data(t)
        n = Counter(k for k, _, _ in spans)
        want.append((str(i), n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined(spans).encode()).hexdigest()))
    for r in out:
        got.append((str(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]))
    assert sorted(got) == sorted(want)
    by_id = {i: t for i, t in source}
    for r in pii.redact(df).collect():
        spans = brute.personal_data(by_id[r["doc_id"]])
        if not spans and r["text"] is not None and "[ID]" not in r["text"]:
            assert r["text"] == by_id[r["doc_id"]]
        if r["text"] is not None:
            assert len(brute.personal_data(r["text"])) == 0
    assert pii.redact(df).columns == df.columns


def test_base_patterns_at_their_edges(spark):
    cases = [
        "a@b.c.d_e@f.g %x@y.z a@b@c.d a@b a@b..c x@y-.z- @a.b",
        "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 001.02.3.255 1.2.3.4444 .1.2.3.4.",
        "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112 4111  1111 4111 1111 1111 1111 5",
        "+1 (555) 123-4567. +44 20 7946 0958 99 +1 + 12345678 +123 +49(0)30-1234567) ++12345678-",
        "café ünï 😀 joe@x.org 😀 10.0.0.1 +4930123456",
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in rows_of(pii.find_personal_data(df))}
    assert got == {i: joined(brute.personal_data(t)) for i, t in enumerate(cases)}


def test_context_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"some words {i} customer mail is user{i}@mail.example.org and more") for i in range(12)]
    rows += [(100, "again customer mail is Xk29fhq81 here"), (101, "the chapter is Xk29fhq82 here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows_of(pii.find_personal_data(df))}
    assert got[100]["spans"] == "id:23:32" and got[100]["n_id"] == 1
    assert got[101]["spans"] == "" and got[5]["spans"] == joined(brute.personal_data(rows[5][1]))
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert redacted[100] == "again customer mail is [ID] here"
    assert redacted[3] == "some words 3 customer mail is [EMAIL] and more"


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_base_figures(name, request):
    df = request.getfixturevalue(name)
    out = rows_of(perplexity.quality_rules(df))
    got = sorted((str(r["doc_id"]), *(r[c] for c in perplexity.FIGURES), r["base_failed"]) for r in out)
    want = []
    for i, t in texts(df):
        f = brute.base_figures(t)
        want.append((str(i), *f, f[0] < 50 or 100 * f[4] > 50 * f[0]))
    assert got == sorted(want)
    assert not any(r["kept"] and r["base_failed"] for r in out)
    if name == "docs":
        assert sum(r["kept"] for r in out) > 0.7 * sum(not r["base_failed"] for r in out)


def test_grams_of_a_text_do_not_depend_on_its_neighbours():
    g, at = perplexity.grams(["ab", "", "cde"])
    for k, t in enumerate(["ab", "", "cde"]):
        assert list(g[at[k] : at[k + 1]]) == list(perplexity.grams([t])[0])


def test_perplexity_bands_reject_odd_texts(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 8))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words, 150)), "en") for i in range(200)]
    rows.append((900, " ".join("".join(rng.choice(list("QXZJ#@~%^"), 7)) for _ in range(150)), "en"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["kept"] for r in rows_of(perplexity.quality_rules(df))}
    assert not got[900]
    assert sum(got.values()) == 200


def test_bands(spark):
    rows = [("en", 2 + k / 100, False) for k in range(-10, 11)] + [("en", 9.0, True), (None, 1.0, False), (None, 1.0, False)]
    df = spark.createDataFrame(rows, "lang string, log_perplexity double, base_failed boolean")
    got = {r["of"]: (r["low"], r["high"]) for r in perplexity.bands(df).collect()}
    assert got["en"] == pytest.approx((2 - 6 * 1.4826 * 0.05, 2 + 6 * 1.4826 * 0.05), abs=0.02)
    assert got[None] == pytest.approx((0.6, 1.4), abs=0.01)


def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.01"
    df, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_classifier.Classifier(df, labels)
    got = rows_of(model.score(df))
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    want = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(r["score"], want[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in want]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.9
    assert np.mean([(s >= 0.3) == bool(q) for s, q in held]) > 0.9
    kept = model.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(r["doc_id"] for r in got if r["predicted"])


def test_quality_classifier_on_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (6, None, 0), (None, 1, 0), (8, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    for df in (odd, none):
        for lab in (labels, labels.where("false")):
            model = quality_classifier.Classifier(df, lab)
            got = rows_of(model.score(df))
            assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in texts(df))
            assert all(0 <= r["score"] <= 1 for r in got)
            assert model.keep_good(df).columns == df.columns


def test_empty_tables(spark, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.drop_near_duplicates(none).count() == 0
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.drop_contaminated(none, bench).count() == 0
    assert pii.find_personal_data(none).count() == 0
    assert pii.redact(none).count() == 0
    assert perplexity.quality_rules(none).count() == 0


def test_empty_benchmark_leaves_all_clean(spark, odd):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(odd, bench).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate.drop_contaminated(odd, bench).count() == odd.count()
