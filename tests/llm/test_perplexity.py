"""The n-gram model of the perplexity filter against a plain modified Kneser-Ney model."""

import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from conftest import rows_of

from quarrymill.llm import perplexity as px

SCHEMA = "doc_id long, text string, lang string"


def sentences(rng, n, letters):
    """Texts of a chain of words, in which each word has three that may follow."""
    words = ["".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(120)]
    after = {w: list(rng.choice(words, 3)) for w in words}
    for _ in range(n):
        text = [words[rng.integers(len(words))]]
        while len(text) < 90:
            text.append(after[text[-1]][rng.integers(3)])
        yield " ".join(text)


def classes(text):
    return "".join(c if ord(c) < 2048 else chr(2048 + ord(c) % 2048) for c in text)


def plain_model(texts):
    """Log probability of a character after the four before it, from dictionaries."""
    count, holders = defaultdict(int), defaultdict(set)
    for t in texts:
        s = "\0" * 4 + classes(t) + "\0"
        for i in range(4, len(s)):
            count[s[i - 4 : i + 1]] += 1
            holders[s[i - 4 : i + 1]].add(t)
    levels = {5: (dict(count), dict(holders))}
    for k in range(4, 0, -1):
        c, h = defaultdict(int), defaultdict(set)
        for g in levels[k + 1][0]:
            c[g[1:]] += 1
            h[g[1:]] |= levels[k + 1][1][g]
        levels[k] = (dict(c), dict(h))
    tables = {}
    for k, (c, h) in levels.items():
        d = px.discounts([float(sum(x == i for x in c.values())) for i in range(1, 5)])
        total, used = defaultdict(float), defaultdict(float)
        for g, n in c.items():
            total[g[:-1]] += n
            used[g[:-1]] += n - d[min(n, 3) - 1] if len(h[g]) > 1 else 0.0
        gain = {g: n - d[min(n, 3) - 1] for g, n in c.items() if len(h[g]) > 1}
        tables[k] = (gain, total, used)

    def p(g):
        if not g:
            return 1 / 4096
        gain, total, used = tables[len(g)]
        ctx = g[:-1]
        if not used.get(ctx):
            return p(g[1:])
        return gain.get(g, 0.0) / total[ctx] + (total[ctx] - used[ctx]) / total[ctx] * p(g[1:])

    return p


@pytest.mark.parametrize("entries", [10**6, 3000])
def test_matches_a_plain_model_in_one_block_and_in_many(spark, entries):
    rng = np.random.default_rng(6)
    english, russian = list(sentences(rng, 40, "etaoins hr")), list(sentences(rng, 30, "оеаинтсрв中"))
    rows = [(i, t, "en") for i, t in enumerate(english)] + [(100 + i, t, None) for i, t in enumerate(russian)]
    unseen = "Ωmega qxj 漢字 etaoin zzz ня"
    rows += [(200, unseen, "en"), (201, unseen, "xx"), (202, None, "en"), (3, english[3], "en"), (100, russian[0], None), (None, english[0], "en")]
    got = sorted((str(r["doc_id"]), r["lang"] or "", r["log_perplexity"]) for r in rows_of(px.scored(spark.createDataFrame(rows, SCHEMA), entries)))
    reference = lambda lang: [t for _, t, x in rows if x == lang and t and px.is_reference(t)]
    models = {"en": plain_model(reference("en")), "": plain_model(reference(None)), "xx": lambda g: 1 / 4096}
    assert len(reference("en")) > 20

    def want(text, lang):
        s = "\0" * 4 + classes(text or "") + "\0"
        return -sum(math.log(models[lang](s[i - 4 : i + 1])) for i in range(4, len(s))) / (len(s) - 4)

    plain = sorted((str(i), lang or "", want(t, lang or "")) for i, t, lang in rows)
    assert [x[:2] for x in got] == [x[:2] for x in plain]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in plain], abs=2e-5)


def plain_symbols(text):
    """Symbols of words and of the marks after them, word by word."""
    marks = ".!?…,;:\"'()[]{}«»„“”‚‘’—–-*#"
    out = []
    for w in re.findall(r"[^\x20\x09-\x0D]+", text):
        core = w.strip(marks)
        low = core.lower()
        stem = 29 if not low else zlib.crc32(low.encode()) % 20 if len(low) <= 4 else 20 + zlib.crc32(low[-2:].encode()) % 9
        out.append(4 + stem + (30 if core and core[0].isupper() else 0))
        tail = w if not core else w[w.rindex(core) + len(core) :]
        if tail:
            out.append(1 if set(tail) & set(".!?…") else 2 if set(tail) & set(",;:") else 3)
    return out


def plain_gain(texts):
    """Mean gain of a text's symbols by their order, from dictionaries."""
    count, holders = defaultdict(int), defaultdict(set)
    for t in texts:
        s = [0, 0, *plain_symbols(t), 0]
        for i in range(2, len(s)):
            count[tuple(s[i - 2 : i + 1])] += 1
            holders[tuple(s[i - 2 : i + 1])].add(t)
    tables = {}
    for k in (3, 2, 1):
        d = px.discounts([float(sum(x == i for x in count.values())) for i in range(1, 5)])
        gain = {g: n - d[min(n, 3) - 1] for g, n in count.items() if len(holders[g]) > 1}
        total, used = defaultdict(float), defaultdict(float)
        for g, n in count.items():
            total[g[:-1]] += n
            used[g[:-1]] += gain.get(g, 0.0)
        tables[k] = (gain, total, used)
        shorter, held = defaultdict(int), defaultdict(set)
        for g in count:
            shorter[g[1:]] += 1
            held[g[1:]] |= holders[g]
        count, holders = shorter, held

    def p(g):
        if not g:
            return 1 / 64
        gain, total, used = tables[len(g)]
        if not used.get(g[:-1]):
            return p(g[1:])
        return gain.get(g, 0.0) / total[g[:-1]] + (total[g[:-1]] - used[g[:-1]]) / total[g[:-1]] * p(g[1:])

    def mean(text):
        s = [0, 0, *plain_symbols(text), 0]
        return sum(math.log(p(tuple(s[i - 2 : i + 1])) / p((s[i],))) for i in range(2, len(s))) / (len(s) - 2)

    return mean


@pytest.mark.parametrize("entries", [10**6, 3000])
def test_gain_of_word_order_matches_a_plain_model(spark, entries):
    rng = np.random.default_rng(8)
    texts = [t[:300].replace(" ", ", ", 3).replace(" ", ". A", 2) + t[300:] + "!" for t in sentences(rng, 40, "etaoins hré")]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    odd = "Ωmega  'qxj' (漢字),\t... étaoin?! zzz — Ab-cd \u00a0x"
    rows += [(200, odd, "en"), (201, odd, "xx"), (202, None, "en"), (203, "", "en"), (3, texts[3], "en")]
    got = sorted((r["doc_id"], r["order_gain"]) for r in rows_of(px.scored(spark.createDataFrame(rows, SCHEMA), entries)))
    mean = plain_gain([t for t in texts if px.is_reference(t)])
    assert sum(map(px.is_reference, texts)) > 20
    plain = sorted((i, mean(t or "") if lang == "en" else 0.0) for i, t, lang in rows)
    assert [x[0] for x in got] == [x[0] for x in plain]
    assert [x[1] for x in got] == pytest.approx([x[1] for x in plain], abs=1e-5)


def test_words_in_another_order_are_rejected(spark):
    """Good texts of the given tables stay, the same words shuffled go."""
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")[["doc_id", "text", "lang"]]
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    good = docs[docs.doc_id.isin(labels[labels.quality == 1].doc_id) & docs.text.notna()]
    rng = np.random.default_rng(4)
    mixed = good.assign(doc_id=good.doc_id + 10**6, text=[" ".join(rng.permutation(t.split())) for t in good.text]).iloc[:100]
    got = pd.DataFrame(rows_of(px.quality_rules(spark.createDataFrame(pd.concat([docs, mixed]), SCHEMA))))
    got = got[~got.base_failed]
    assert got[got.doc_id.isin(good.doc_id)].kept.mean() >= 0.99
    shuffled = got[got.doc_id >= 10**6]
    assert len(shuffled) > 50 and shuffled.kept.mean() <= 0.25  # a tenth of all texts is shuffled here, and learned from


def test_model_is_a_distribution(spark):
    """Over all classes the probabilities after any context add up to one."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(sentences(rng, 30, "abcdeé"))], SCHEMA)
    (block,) = px.train(df)
    parts, layers = block["en"]
    assert parts.all() and len(layers) == px.ORDER
    seen = layers[-1].contexts
    for ctx in [*rng.choice(seen, 10), 0, ord("q"), (ord("a") << 12) | ord("b")]:
        p = np.exp(px.log_prob(layers, (int(ctx) << px.BITS) + np.arange(px.CLASSES)))
        assert abs(p.sum() - 1) < 1e-4


def test_reference_texts():
    good = "Some plain words of a text that goes on and on. " * 1 + " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    assert px.is_reference(good)
    assert not px.is_reference(good.upper()) and not px.is_reference(good.replace(" ", " %%% ")) and not px.is_reference("a b c")
    assert not px.is_reference("one two three four " * 30)


def test_rejects_low_quality_and_keeps_the_others(spark):
    """On the labelled rows of the given tables."""
    sf = "/root/testdata/sf0.01"
    got = pd.DataFrame(rows_of(px.quality_rules(spark.read.parquet(f"{sf}/documents.parquet"))))
    x = got[~got.base_failed].merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert (x.quality == 0).sum() > 10
    assert x[x.quality == 1].kept.mean() > 0.97
    assert x[x.quality == 0].kept.mean() < 0.1
