"""Chats, shards, archives, pages, packing, components and the pipeline."""

import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from conftest import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarrymill.llm import chat, components, packing, sharding, warc, wrapper


def test_perspectives(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "Ann", "héllo"), (1, 2, "Bob", "hi 😀"), (1, 600, "Ann", None),
            (2, None, None, "x"), (2, 1, "Ann", ""), (None, 0, "Bob", "alone"), (3, 0, "system", "only"), (1, 2, "Bob", "hi 😀")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = {(r["conv_id"], r["perspective"], r["part"]): r for r in rows_of(chat.rotate_perspectives(df))}
    assert set(got) == {(1, "Ann", 0), (1, "Bob", 0), (2, "unknown", 0), (2, "Ann", 0), (None, "Bob", 0)}
    r = got[1, "Ann", 0]
    assert r["rendered"] == (
        "<|im_start|>system\nbe nice<|im_end|>\n<|im_start|>assistant\nhéllo<|im_end|>\n"
        "<|im_start|>user name=Bob\nhi 😀<|im_end|>\n<|im_start|>user name=Bob\nhi 😀<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    )
    assert r["n_turns"] == 5 and r["n_masked"] == 5
    for r in got.values():
        own = [r["rendered"][slice(*map(int, m.split(":")))] for m in r["mask"].split(",") if m]
        said = [t or "" for c, n, who, t in rows if c == r["conv_id"] and (who or "unknown") == r["perspective"]]
        assert sorted(own) == sorted(said)
    assert chat.rotate_perspectives(df.where("false")).count() == 0


def test_parts_of_a_conversation_with_equal_and_null_turns(spark):
    """Parts have a bounded number of turns, and in order they are the whole dialogue."""
    rows = [(1, None, "Ann", f"n{i:04}") for i in range(700)] + [(1, 5, "Bob", "same")] * 600 + [(1, 7, "Ann", f"z{i:03}") for i in range(50)] + [(2, 1, "Ann", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = rows_of(chat.rotate_perspectives(df))
    assert sorted((r["conv_id"], r["perspective"], r["part"], r["n_turns"]) for r in got) == [
        (1, p, k, n) for p in ("Ann", "Bob") for k, n in ((0, 512), (1, 512), (2, 326))
    ] + [(2, "Ann", 0, 1)]
    whole = "".join(r["rendered"] for r in sorted((r for r in got if r["conv_id"] == 1 and r["perspective"] == "Bob"), key=lambda r: r["part"]))
    assert whole == "".join(f"<|im_start|>{'assistant' if who == 'Bob' else 'user name=Ann'}\n{t}<|im_end|>\n" for c, _, who, t in rows if c == 1)
    uncut = {(r["conv_id"], r["perspective"]): r for r in rows_of(chat.rotate_perspectives(df, None))}
    assert set(uncut) == {(1, "Ann"), (1, "Bob"), (2, "Ann")} and uncut[1, "Bob"]["rendered"] == whole and uncut[1, "Bob"]["n_turns"] == 1350
    own = [whole[slice(*map(int, m.split(":")))] for m in uncut[1, "Bob"]["mask"].split(",")]
    assert own == ["same"] * 600


def test_perspectives_of_long_texts_and_clashing_columns(spark):
    """Very long texts stay whole; columns named as those of the result and of the steps don't matter."""
    rows = [(1, 0, "Ann", "é" * 300_000), (1, 1, "Bob", "x" * 1_000_000), (2, 0, "Ann", "y")]
    names = ["turns", "t", "part", "perspective", "rendered", "mask", "c", "_c", "_n", "rank"]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", *(f"'z' AS {n}" for n in names))
    got = {(r["conv_id"], r["perspective"]): r for r in rows_of(chat.rotate_perspectives(df))}
    assert set(got) == {(1, "Ann"), (1, "Bob"), (2, "Ann")} and got[1, "Ann"]["n_masked"] == 300_000 and got[1, "Bob"]["n_masked"] == 1_000_000


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_shards(name, request):
    df = request.getfixturevalue(name)
    source = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    got = rows_of(sharding.shard(df))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in source
    )
    of = defaultdict(set)
    for r in got:
        of[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for s in of.values())
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    if name == "docs":
        load = Counter()
        for r in got:
            load[r["shard"]] += r["size"]
        assert max(load.values()) < 1.05 * sum(load.values()) / 8


def plain_longest_first(sizes, shards):
    """Shards of groups in falling order of size, one by one."""
    load, out = [0] * shards, []
    for size in sorted(sizes, reverse=True):
        least = min(range(shards), key=lambda s: (load[s], s))
        load[least] += size
        out.append((size, least))
    return out


@given(st.lists(st.tuples(st.one_of(st.integers(1, 30), st.integers(1, 100_000)), st.integers(1, 60)), max_size=25), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_dealing_in_runs_is_the_plain_heap(counted, shards):
    counts = Counter()
    for size, n in counted:
        counts[size] += n
    got = []
    for size, runs in sharding.longest_first(sorted(counts.items(), reverse=True), shards):
        for rank in range(counts[size]):
            start, cycle = [r for r in runs if r[0] <= rank][-1]
            got.append((size, cycle[(rank - start) % len(cycle)]))
    assert got == plain_longest_first(counts.elements(), shards)


def test_dealing_takes_few_runs():
    heap = [(0, s) for s in range(8)]
    sharding.deal(heap, 10**13, 1)
    runs = sharding.deal(heap, 100, 10**12)
    assert len(runs) < 20 and max(heap)[0] - min(heap)[0] <= 100


@pytest.mark.parametrize("broadcast", [True, False])
def test_shards_of_groups_are_those_of_the_plain_heap(spark, docs, monkeypatch, broadcast):
    """Hot and equal sizes, with runs by broadcast and by a salted join; groups of one size may change places."""
    if not broadcast:
        monkeypatch.setattr(sharding, "BROADCAST_IDS", 0)
        monkeypatch.setattr(sharding, "LARGE_PARTS", 3)
        monkeypatch.setattr(sharding, "BLOCK", 7)
        monkeypatch.setattr(sharding, "PART_ROWS", 50)
    own = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"t{i:05}") for i in range(3000)] + [(-1, None), (-2, "")], "doc_id long, text string")
    for df in (docs, own):
        source = Counter(r["text"] or "" for r in df.collect())
        want = Counter(plain_longest_first([(len(t.encode()) + 1) * n for t, n in source.items()], 8))
        of = {}
        for r in rows_of(sharding.shard(df)):
            of.setdefault((r["text_crc32"], r["size"]), [0, r["shard"]])[0] += 1
        assert Counter((size * n, s) for (_, size), (n, s) in of.items()) == want


def test_archives(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    long = "x" * 200
    rows = [(10, "http://a/\r\nX: y", long), (11, None, long), (12, "u", "s"), (13, "u", "s"), (14, "u", None), (15, "u", ""),
            (None, "u", long), (16, "u", "é" * 50 + "\r\n\r\nWARC/1.1\r\n\r\n"), (16, "u", "é" * 50 + "\r\n\r\nWARC/1.1\r\n\r\n"), (9, "u", "é" * 50 + "\r\n\r\nWARC/1.1\r\n\r\n")]
    own = spark.createDataFrame(rows, "page_id long, url string, html string")
    for df in (pages, own, own.where("false")):
        source = [(r["page_id"], r["html"] or "") for r in df.collect()]
        first = {}
        for i, h in source:
            if len(h.encode()) >= 100 and i is not None:
                first[h] = min(first.get(h, i), i)
        want = []
        for i, h in source:
            b, again = h.encode(), h in first and first[h] != i
            want.append((str(i), len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None))
        got = [tuple(str(v) if k == "page_id" else v for k, v in r.items()) for r in rows_of(warc.round_trip(df))]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_archive_files(spark, tmp_path):
    import gzip

    long = "y" * 150
    pages = spark.createDataFrame([(2, "http://h/2", long), (1, "http://h/1", long)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    records = [r for f in (tmp_path / "w").glob("*.gz") for r in warc.parse(gzip.open(f))]
    by = {h["WARC-Page-ID"]: (h, b) for h, b in records}
    assert by["1"][1] == long.encode() and by["2"][1] == b""
    assert "2024-01-01" not in by["1"][0]["WARC-Date"]
    assert by["2"][0]["WARC-Type"] == "revisit" and by["2"][0]["WARC-Refers-To"] == by["1"][0]["WARC-Record-ID"]


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_archives_of_odd_ids_columns_and_sizes(spark, tmp_path, monkeypatch, broadcast):
    """Any text is an id, other columns are ignored, files are bounded, and both ways of leaving out revisits agree."""
    import gzip

    monkeypatch.setattr(warc, "BROADCAST_REVISITS", broadcast)
    ids = ["", " a ", "a\r\nWARC-Type: x", "50%0A", "é: ü", None, "a%"]
    rows = [(i, "u", c * 300, "1", "2", 3) for i in ids for c in "xy"] + [(f"n{k}", "u", str(k) * (100 + k), None, None, None) for k in range(400)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string, payload_digest string, refers_to string, payload_bytes long")
    first = min(i for i in ids if i is not None)
    got = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows_of(warc.round_trip(df)))
    want = Counter((i, *(("response", None) if i == first else ("revisit", first)), 300) for i in ids for _ in "xy")
    assert got == want + Counter((i, "response", None, len(h)) for i, _, h, *_ in rows if i and i.startswith("n"))
    warc.write_archives(df.coalesce(1), str(tmp_path / "w"), file_classes=((500, 50), (None, 1)))
    sizes = [[len(b) for _, b in warc.parse(gzip.open(f))] for f in (tmp_path / "w").glob("*.gz")]
    assert max(map(len, sizes)) == 50 and all(len(s) == 1 for s in sizes if max(s, default=0) > 500)
    assert sum(map(len, sizes)) == len(rows)


def page(title, body, extra="", article=True):
    a, b = ("<article>", "</article>") if article else ("<div class='content'>", "</div>")
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><script>var a='<p>no</p>'</script></head><body><nav><a href='/'>Home {title}</a></nav>"
        f"<div class='ad-slot'>Buy {title}</div>{a}<h1>{title}</h1>{body}{b}<p>Read our terms</p>{extra}<footer>&copy; {title}</footer></body></html>"
    )


def test_main_text(spark):
    varied = [f"<p>Body {i} &amp; more\n  text<br>line</p><p><b>Un{i}closed<p>Last {i}" for i in range(8)]
    rows = [(i, f"http://x.org/{i}", page(f"T{i}", b)) for i, b in enumerate(varied)]
    rows += [(100 + i, f"http://y.org/{i}", page(f"T{i}", b, article=False)) for i, b in enumerate(varied)]
    rows += [(200, None, None), (201, "", ""), (202, "http://x.org/z", "just text < 5 &lt; x"), (203, "http://x.org/0", rows[0][2]), (203, "http://x.org/0", rows[0][2])]
    rows.append((204, "http://x.org/c", page("T", "<p>Real</p><div class='comments'><article class='comment'>me</article></div><form>f</form><aside>s</aside>")))
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n_chars int")
    out = rows_of(wrapper.extract(df))
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    got = {r["page_id"]: r["text"] for r in out}
    for i in range(8):
        want = f"T{i}\nBody {i} & more text line\nUn{i}closed\nLast {i}"
        assert got[i] == want
        assert got[100 + i] == want  # the constant paragraph of the host is its template
    assert got[200] == got[201] == "" and got[202] == "just text < 5 < x" and got[203] == got[0] and got[204] == "T\nReal"
    assert wrapper.extract(df.where("false")).count() == 0


def test_main_text_of_given_pages(spark, sf_dir):
    """Against the articles as the pages spell them."""
    import html
    import re

    for r in rows_of(wrapper.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id")):
        art = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", art)]
        assert r["text"] == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_packing(name, request):
    df = request.getfixturevalue(name)
    t = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter((r["doc_id"], *p) for r in df.collect() for p in brute.token_pieces(t, r["text"]))
    got = rows_of(packing.pack(df))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    if name == "docs":
        assert len(sequences) <= -(-sum(r["length"] for r in got) // 2048) * 1.01 + 1


def test_added_tokens_are_cut_out_as_spelled(spark):
    """Against the tokenizer as it is loaded."""
    texts = ["end <|endoftext|> start", "a<|ENDOFTEXT|>b<|endoftext|>c", "x<|startoftext|>Y <|StartOfText|>", "<|endoftext|><|endoftext|>",
             "<|endof text|>", "é<|endoftext|>É<|<|startoftext|>", "<|endoftext|", "  <|endoftext|>\n\t", "E\u0301<|endoftext|>\u0301x İ<|ENDOFTEXT|>"]
    t = Tokenizer.from_file(packing.default_tokenizer())
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in rows_of(packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    assert got == {i: brute.token_pieces(t, x)[0][2:] for i, x in enumerate(texts)}


def fewest(sizes, capacity):
    """The least number of bins, by trying all."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


@given(st.lists(st.integers(1, 30), min_size=1, max_size=9))
@settings(max_examples=300, deadline=None)
def test_reduction_keeps_an_optimum(sizes):
    capacity = 30
    sizes = sorted(sizes, reverse=True)
    fixed, rest = packing.reduce_instance(Counter(sizes), capacity)
    taken = Counter()
    for bin_, times in fixed:
        assert sum(bin_) <= capacity and times > 0
        for k in bin_:
            taken[k] += times
    assert taken + Counter(rest) == Counter(sizes)
    left = sorted(itertools.chain(*([k] * n for k, n in rest.items())), reverse=True)
    assert sum(n for _, n in fixed) + fewest(left, capacity) == fewest(sizes, capacity)


@given(st.lists(st.integers(1, 100), max_size=200))
@settings(max_examples=100, deadline=None)
def test_plan_places_every_piece_once(sizes):
    bins = packing.plan(Counter(sizes), 100)
    assert Counter(itertools.chain(*(list(b) * n for b, n in bins))) == Counter(sizes)
    assert all(sum(b) <= 100 for b, _ in bins)
    places, used = packing.Places(bins), Counter()
    for k, n in Counter(sizes).items():
        seq, offset = places.find(np.full(n, k), np.arange(n))
        for s, o in zip(seq, offset):
            for x in range(o, o + k):
                used[s, x] += 1
    assert not used or max(used.values()) == 1


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(7, 7)]
    up = {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        if a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    assert got == {i: top(i) for i in up}
    assert components.connected_components(df.where("false")).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect() if k < 4 else rows["pii_redaction"]
        docs = stage(spark, docs, sf_dir)
        rows[name] = docs.collect()
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = {r["doc_id"] for r in rows[name]}
        if name == "quality_classifier":
            assert len(ids) > 0.8 * sum(labels.get(r["doc_id"], 1) for r in before)
        if name == "near_dedup":
            assert ids == {i for i, c in brute.groups([(r["doc_id"], r["text"]) for r in before]).items() if i == c}
        if name == "decontamination":
            assert ids == {r["doc_id"] for r in before if not brute.contamination(r["text"], items)[-1]}
        if name == "pii_redaction":
            assert ids == {r["doc_id"] for r in before}
            assert not any(brute.personal_data(r["text"]) for r in rows[name])
    assert {r["doc_id"] for r in rows["packing"]} == {r["doc_id"] for r in rows["pii_redaction"]}


def test_pipeline_on_odd_and_empty_tables(spark, sf_dir, docs, odd, none):
    """Nulls, empty and long texts, repeated rows and clashing columns pass through every stage; each keeps the columns of its input."""
    import corpus_pipeline

    for table in (docs.limit(60).unionByName(odd, allowMissingColumns=True), none):
        columns, now = table.columns, table
        for name, stage in corpus_pipeline.STAGES:
            before = rows_of(now)
            now = stage(spark, now, sf_dir)
            rows = rows_of(now)
            ids = Counter(r["doc_id"] for r in before)
            if name == "packing":
                assert {r["doc_id"] for r in rows} == set(ids)
                continue
            assert now.columns == columns
            assert not Counter(r["doc_id"] for r in rows) - ids
            if name == "pii_redaction":
                assert Counter(r["doc_id"] for r in rows) == ids
            elif name != "near_dedup":
                kept = {repr(r) for r in rows}
                assert kept <= {repr(r) for r in before}
            now = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], table.schema)
