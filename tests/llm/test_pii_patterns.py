"""Context patterns of the personal-data operator that start from the shape of tokens."""

import math
import random
import time

import brute
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from quarrymill.llm import pii


def hexes(n):
    return [f"{(i + 3) * 0x9E3779B97F4A7C15F39CC0605CEDC834 % 16**32:032x}" for i in range(n)]


def test_secrets_behind_an_assignment_of_distinctive_tokens(spark):
    rows = [(i, f'word{"abc"[i % 3]} before token = "{h}" and more') for i, h in enumerate(hexes(30))]
    odd = ["ab12", "9f" * 60, "sk-live_77.x/q9", "A1"]
    rows += [(100 + i, f'other place token = "{x}" end') for i, x in enumerate(odd)]
    rows += [(200, 'start of api_key="ab12" end'), (201, "in 1984 the chapter 12 of part-2 was long")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows_of(pii.find_personal_data(df))}
    for i, text in rows:
        if i < 200:
            a = text.index('"') + 1
            assert got[i]["spans"] == f"id:{a}:{text.index(chr(34), a)}"
        else:
            assert got[i]["n_id"] == 0
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert redacted[102] == 'other place token = "[ID]" end' and redacted[201] == rows[-1][1]


@pytest.mark.parametrize(
    ("token", "seed"),
    [("0123abcd" * 3, True), ("aB3" * 6, True), ("9f8e7d6c-1234-abcd-9876", True), ("1" * 40, False), ("2024-01-02", False), ("chapter12", False)],
)
def test_distinctive_shapes(spark, token, seed):
    assert spark.range(1).select(F.rlike(F.lit(token), F.lit(pii.DISTINCTIVE)).alias("x")).first()["x"] == seed


def test_time_grows_with_the_text_and_long_texts_are_redacted_whole(spark):
    """Tens of thousands of tokens and of spans in one text, hardly slower than one."""
    tokens = " ".join(f"w{i % 977}" for i in range(60_000))
    mails = " ".join(f"é{'x' * (i % 7)} u{i}@h{i % 13}.org" for i in range(20_000))
    df = spark.createDataFrame([(1, tokens), (2, mails), (3, "é" * 9000 + " 10.0.0.1")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in rows_of(pii.find_personal_data(df))}
    assert got[1]["spans"] == "" and got[2]["n_email"] == 20_000
    assert got[2]["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in brute.personal_data(mails))
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert redacted[1] == tokens and redacted[3] == "é" * 9000 + " [IP]"
    assert redacted[2] == " ".join(f"é{'x' * (i % 7)} [EMAIL]" for i in range(20_000))
    assert time.time() - began < 90


def test_overlapping_spans_are_replaced_once(spark):
    text = "mail 1.2.3.4@host.org now +49 4111 1111 1111 1111 end"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans, out, at = sorted((a, b, pii.KINDS.index(k)) for k, a, b in brute.personal_data(text)), "", 0
    for a, b, k in spans:
        if a >= at:
            out += text[at:a] + f"[{pii.KINDS[k].upper()}]"
        at = max(at, b)
    assert pii.redact(df).first()["text"] == out + text[at:]


def test_scores_of_the_graph_match_a_plain_version(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        seed = i % 4 == 0
        rows += [(f"p{rng.randrange(5) if seed else rng.randrange(30)}", i, seed) for _ in range(rng.randrange(1, 4))]
    rows += [("q", i, True) for i in range(0, 40, 4)] + [("q", 401, False), ("r", 401, False), ("r", 0, True), ("r", 4, True), ("r", 8, True)]
    got = {r["pattern"]: r["score"] for r in pii.accepted_patterns(spark.createDataFrame(rows, "pattern string, instance long, seed boolean")).collect()}
    edges, seeds = {(p, i) for p, i, _ in rows}, {i for _, i, s in rows if s}
    by = {p: {i for q, i in edges if q == p} for p, _ in edges}
    by = {p: x for p, x in by.items() if len(x) >= pii.LEAST_SEEDS}
    trust = dict.fromkeys(seeds, 1.0)
    for _ in range(pii.ROUNDS):
        good = {}
        for p, x in by.items():
            score = round(sum(trust.get(i, 0.0) for i in x) / (len(x) + 1), 6)
            if score >= pii.LEAST_SCORE and sum(trust.get(i, 0.0) >= pii.LEAST_CONFIDENCE for i in x) >= pii.LEAST_SEEDS:
                good[p] = score
        trust = dict.fromkeys(seeds, 1.0)
        for i in {i for p in good for i in by[p]} - seeds:
            trust[i] = round(1 - math.prod(1 - min(good[p], 0.999) for p in good if i in by[p]), 6)
    assert got == pytest.approx(good, abs=2e-6) and got
