"""Each operator on small tables: brute force, and nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import json
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from labelmill.llm import decontaminate, inner_products, language, line_templates, near_dedup, packing, perplexity, site_style, token_counts, toxicity
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a b c d e f g"), (4, "A b c d e f g"), (4, "A b c d e f g"), (5, LONG), (6, LONG), (7, "42 17")]


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("row", "keys", "lines", "score", "lang", "n", "h1", "_hash", "component"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOW)) if w]


@pytest.mark.parametrize("name", sorted(n for n in oracle_sql() if n.startswith("op")))
def test_query_with_sql(spark, name):
    assert compare(spark, connect(FOLDER), name, FOLDER, queries(), oracle_sql()) > 0


def test_near_duplicates(spark):
    rng = random.Random(4)
    base = [rng.choice("abcdefghij") * 2 + str(rng.randrange(50)) for _ in range(120)]
    rows = [(10 + i, " ".join(base[:k] + [f"x{i}"] * (i % 3) + base[k:])) for i, k in enumerate(rng.sample(range(120), 40))]
    rows += [(100 + i, " ".join(base[: 100 - 2 * i])) for i in range(20)] + ODD
    got = near_dedup.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    sets, parent = {}, {}
    for i, text in rows:
        w = words(text)
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
        parent[i] = i

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if i is not None and sets[i][0]]
    for a in ids:
        for b in ids:
            s, t = sets[a][0], sets[b][0]
            if a < b and 100 * len(s & t) >= 85 * len(s | t):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    for r in got:
        want = None if r.doc_id is None else top(r.doc_id)
        assert (r.component_id, r.kept, r.n_shingles) == (want, want is not None and want == r.doc_id, len(sets[r.doc_id][0])), r
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0


def test_small_sets_keep_whole_signatures():
    rng = np.random.default_rng(0)
    missed = 0
    for _ in range(300):
        s = np.unique(rng.integers(0, 1 << 63, 7, dtype=np.uint64) * np.uint64(2))
        missed += not (near_dedup.band_keys(s) == near_dedup.band_keys(s[:-1])).any()
    assert missed == 0 and len(near_dedup.band_keys(s[:1])) == near_dedup.BINS // near_dedup.BAND_BINS


def test_decontamination(spark):
    item = "the quick brown fox jumps over the lazy dog and then sleeps all day long"
    docs = table(spark, [*ODD, (20, "Before. " + item.upper() + " after"), (21, item[:40]), (22, "say rare-word again"), (23, " ".join(item.split()[:12]) + " none")])
    bench = spark.createDataFrame([(1, item), (1, item), (2, "RARE word"), (3, None), (4, ""), (None, "42 17")], "item_id long, text string").withColumn("words", F.lit(0))
    got = {(r.doc_id, r.n_words): r for r in decontaminate.contamination(docs, bench).collect()}
    assert (got[20, 17].n_hit, got[20, 17].n_items, got[20, 17].contaminated) == (15, 1, True)
    assert (got[22, 4].n_hit, got[22, 4].n_items) == (2, 1) and got[21, 8].n_hit == 0 and got[23, 13].n_hit == 0
    assert (got[7, 2].n_hit, got[7, 2].n_items, got[7, 2].contaminated) == (2, 0, True) and got[1, 0].n_words == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta x y gamma"), (2, "alpha beta gamma"), (3, "gamma alpha beta")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    terms, pairs, index = decontaminate.prepare(docs, bench)
    assert {r.doc_id for r in decontaminate.phrase_matches(index, terms, pairs).collect()} == {2}
    near = {s: {r.doc_id for r in decontaminate.proximity_matches(index, terms, pairs, s).collect()} for s in (0, 2, 4)}
    assert 2 in near[0] and near[0] <= near[2] <= near[4]


def test_token_counts(spark):
    docs = table(spark, [*ODD, (30, "one\n\n\n  two\nthrée"), (31, "x" * 50_000)])
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for rule in token_counts.RULES:
        got = token_counts.count_tokens(docs, path, public_tokenizers.PATTERN, fields=("lang", "text"), rule=rule).collect()
        assert len(got) == len(ODD) + 2
        for r in got:
            assert sum(r.field_tokens) == r.n_tokens == sum(s.tokens for s in r.sections) and len(r.field_tokens) == 2
    ends, bounds = np.array([3, 7, 12]), np.array([0, 5, 6])
    assert [token_counts.attribute(ends, bounds, r)[0].tolist() for r in token_counts.RULES] == [[2, 0, 1], [1, 0, 2], [2, 0, 1]]
    assert token_counts.attribute(ends, bounds)[1] == 1 and token_counts.count_tokens(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_language(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.learn(docs)
    held = language.identify(docs.where("crc32(cast(doc_id as string)) % 5 = 0"), model)
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count() > 0
    got = {r.text: r for r in language.identify(table(spark, ODD), model).collect()}
    assert all((got[t].lang_pred, got[t].score) == ("und", 0.0) for t in (None, "", "42 17")) and got[LONG].lang_pred in model["langs"] and got[LONG].lang == "clash"
    assert language.identify(docs, language.learn(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


@pytest.mark.parametrize(("order", "share"), [(3, 20), (2, None), (5, None)])
def test_code_lengths(spark, monkeypatch, order, share):
    """The tree's counts and costs against their definition, for texts in slices of a few bytes."""
    rng = random.Random(order)
    rows = [(i, "".join(rng.choices(["ab", "Ba", "c ", "é", "\0"] if i % 2 else ["ac", "cb", "B", " "], k=rng.randrange(60))), "xy"[i % 2]) for i in range(80)] + [(200, None, "x"), (201, "abc", None), (None, "abcabc", "x")]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), order=order, share=share)
    assert model["langs"] == ["x", "y"]
    seen = {}
    for i, text, lang in rows:
        if None not in (i, text, lang) and zlib.crc32(str(i).encode()) % 5:
            raw = bytes(order) + text.translate(LOW).encode()
            for at in range(order, len(raw)):
                for k in range(order + 1):
                    seen.setdefault((lang, raw[at - k : at]), Counter())[raw[at]] += 1
    whole = {lang: sum(seen[lang, b""].values()) for lang in "xy"}

    def chance(lang, before, byte):
        counts = seen[lang, before]
        total = counts.total() + len(counts)
        shorter = chance(lang, before[1:], byte) if before else 1 / 256
        return counts[byte] / total if counts[byte] else len(counts) / total * shorter

    def bits(lang, text):
        raw, out = bytes(order) + text.translate(LOW).encode(), 0.0
        for at in range(order, len(raw)):
            k = next(k for k in range(order, -1, -1) if (lang, raw[at - k : at]) in seen and (not share or k == 0 or seen[lang, raw[at - k : at]].total() * share >= whole[lang]))
            out -= math.log2(chance(lang, raw[at - k : at], raw[at]))
        return out

    texts = [t for _, t, _ in rows[:30]] + [None, "", "zz", "ABCABC" * 20]
    monkeypatch.setattr(language, "SLICE", 7)
    got, letters = language.code_lengths(pa.array(texts), model)
    assert got == pytest.approx(np.array([[bits(lang, t or "") for lang in "xy"] for t in texts]), rel=1e-5)
    assert letters.tolist() == [any(map(str.isalpha, t or "")) for t in texts]


def test_lines(spark):
    passage = " ".join(f"word{chr(97 + i % 26)}" for i in range(55))
    rows = [(20 + i, f"own line number {chr(97 + i)} of it\n\n{passage}\nPage {i} of 9 here") for i in range(4)] + [(9, "quite another text stays as it is"), (30, passage.replace("wordz", "other", 1)), (31, passage.replace("wordz", "other")), *ODD]
    got = {r.doc_id: r for r in line_templates.drop_recurring(table(spark, rows)).collect()}
    assert got[20].text == rows[0][1] and got[20].n_dropped == 0 and got[20].lines == "clash"
    assert [got[i].text for i in (21, 22, 23)] == [f"own line number {chr(97 + i)} of it\n" for i in (1, 2, 3)]
    assert got[9].n_dropped == got[31].n_dropped == 0 and got[30].text == "" and got[21].n_lines == 4
    assert (got[21].n_dropped, got[5].n_dropped, got[4].text) == (2, 0, "A b c d e f g")
    assert line_templates.drop_recurring(table(spark, [])).count() == 0


def test_short_lines(spark):
    rows = [(i, f"Next\nSee {i}\nown word{chr(97 + i)}\n \n") for i in range(3)] + [(3, "Next"), (4, "once"), (5, "once")]
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_templates.drop_recurring(table(spark, rows)).collect()}
    assert got[0] == (rows[0][1], 0) and got[2] == ("own wordc\n \n", 2)
    assert got[3] == ("", 1) and got[4] == got[5] == ("once", 0)


PAGE = """<html><head><title>No</title><script>if (a<b) document.write("</p><p>no")</script></head><body class=x><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use</div><article><h1>Head &amp; line</h1><p>One <b>bold
word<p>Two&nbsp;&eacute; <a href="#">link</a>s<div class="ad">Buy</div><ul><li>three<li>four</ul><form><input>Send</form></article>
<section id="comments"><p>Nice</p></section><aside>More</aside><footer>&copy; us</footer></body></html>"""


def test_pages(spark):
    assert site_style.main_text(PAGE, set()) == "Head & line One bold word Two é links three four"
    assert site_style.main_text("<p>a<!-- <p>b --><br>c &lt;d&gt;", set()) == "a c <d>"
    rows = [(i, f"http://h.example/{i}", f"<body><p>text {i} of its own</p><div><span>same for all</span></div></body>") for i in range(25)]
    rows += [(30, None, None), (31, "http://h.example/x", ""), (32, "no url", PAGE), (None, "http://h.example/1", rows[1][2]), (33, "http://H.example/", "<p>" + LONG)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("low", F.lit(1))
    got = {r.page_id: r.text for r in site_style.extract_main_text(df).collect()}
    assert [got[i] for i in range(25)] == [f"text {i} of its own" for i in range(25)] and got[None] == got[1]
    assert got[30] == got[31] == "" and got[32].startswith("Head & line") and got[33] == LONG and len(got) == 30
    assert site_style.extract_main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(("page", "want"), [
    *[(f'<div class="{c}">kept</div>', "kept") for c in ("content-related", "form-group", "social-science", "comment-policy article", "post-header", "plain")],
    *[(f'<div class="{c}">cut</div>', "") for c in ("ad", "x ads", "site-footer", "mainNav", "ad-slot", "comment-list", "page-header", "related-posts", "cookie_banner")],
    ('<div id=comments>cut</div><p role=search>cut</p><p hidden>cut<p title="a > b">kept', "kept"), ('<p title="x>cut', ""), ("a < b <3 </ x> c", "a < b <3 c"), ("<p a=b\"c>kept</p>", "kept"),
    ("one<title>cut", "one"), ("one<script>cut</p>", "one"), ("one<!-- cut", "one"), ("one<p cut", "one"), ("<article>one</div><p>two</article>cut", "one two"), ("<div><article>a</div>b</article>", "a b"),
])
def test_page_parts(page, want):
    assert site_style.main_text(page, set()) == want


@pytest.mark.parametrize("part", ["<a ", "<title>", "<div>x", "<!--", "<![CDATA[", "<i>x</b>", '<p a="', "<li>", "<div class=form-group>x", "<article>x", "</p", "&", '<p a="b" ', "<svg>"])
def test_pages_take_linear_time(part):
    import time

    begin = time.perf_counter()
    site_style.main_text(part * 40_000, {1})
    assert time.perf_counter() - begin < 8


def test_style_tree(spark):
    """Contents and builds of nodes against their entropies, computed page by page."""
    rng = random.Random(3)
    pages = []
    for i in range(120):
        own = "".join(f"<p>{i} {k}</p>" for k in range(rng.randrange(1, 9)))
        pages.append((f"h{i % 3}", f"<div class=note>same</div><div class=form-group>{own if i % 3 else '<p>' + str(i)}</div><div class=x>{'same' if i % 30 else i}</div><b>{i // 60}</b>"))
    df = spark.createDataFrame(pages + pages[:50] + [(None, pages[0][1]), ("h0", None)], "host string, html string")
    seen = defaultdict(Counter)
    for host, page in pages:
        for node, content in site_style._nodes(page):
            seen[host, node][content] += 1
    want = set()
    for key, contents in seen.items():
        m = sum(contents.values())
        if m >= site_style.MIN_PAGES and -sum(n / m * math.log(n / m) for n in contents.values()) / math.log(m) < site_style.LEAST:
            want.add(key)
    got = {(r.host, r.path) for r in site_style.low_branches(df).collect()}
    assert got == want and any(n < 0 for _, n in got) and {h for h, n in got if n < 0} == {"h0"}
    low = {h: {n for k, n in got if k == h} for h in ("h0", "h1")}
    assert site_style.main_text(pages[3][1], low["h0"]) == "same 0" and site_style.main_text(pages[4][1], low["h1"]).startswith("4 0 ")


def test_top_products(spark):
    rng = np.random.default_rng(7)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(700, 9)) * rng.exponential(size=(700, 1)))] + [(700 + i, [0.5] * 9) for i in range(12)]
    odd = [(900, None), (901, [1.0, None]), (902, [math.nan] * 9), (903, [math.inf] * 9), (None, [9.0] * 9), (3, vectors[3][1]), (1000, [1.0, 2.0]), (1001, [3.0, 1.0])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("dim", F.lit(1))
    got = defaultdict(list)
    for r in inner_products.top_products(df, F.col("vec_id") % 50 == 0, k=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = np.floor(np.array([v for _, v in vectors]) * 1024).astype(np.int64)
    for q in range(0, len(vectors), 50):
        scores = x @ x[q]
        order = [i for i in np.lexsort((np.arange(len(x)), -scores)) if i != q][:10]
        assert got[q] == [(i, scores[i]) for i in order]
    assert got[1000] == [(1001, 5 * 1024 * 1024)] and len(got) == 16
    assert inner_products.top_products(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def _best_pairs(rows, is_query, k):
    """Brute force, in Python's whole numbers: query id, rank, id and score."""
    out = []
    for query_id in sorted({i for i, _ in rows if is_query(i)}):
        pairs = [(-sum(a * b for a, b in zip(q, v, strict=True)), i) for j, q in rows if j == query_id for i, v in rows if i != j and len(v) == len(q)]
        out += [(query_id, rank, i, -score) for rank, (score, i) in enumerate(sorted(pairs)[:k], 1)]
    return out


@pytest.mark.parametrize("scale", [8.0, 2.0**18])
def test_top_products_in_many_slabs_and_groups(spark, monkeypatch, scale):
    monkeypatch.setattr(inner_products, "BLOCK_ROWS", 16)
    monkeypatch.setattr(inner_products, "SLAB_BYTES", 900)
    rng = np.random.default_rng(11)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.integers(-40, 40, size=(300, 7)) * rng.choice([0.125, 1.0, 64.0], size=(300, 1)))]
    rows += [(300 + i, rows[i % 7][1]) for i in range(40)] + [(20, [1.0] * 7), (400, [0.0] * 7), (405, [3.0, 4.0]), (406, [1.0, -1.0]), (407, [1.0, -1.0]), (410, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = inner_products.top_products(df.union(df.limit(50)), F.col("vec_id") % 5 == 0, k=6, scale=scale).orderBy("query_id", "rank").collect()
    assert list(map(tuple, got)) == _best_pairs([(i, [math.floor(e * scale) for e in v]) for i, v in rows], lambda i: i % 5 == 0, 6)


def test_top_products_of_unit_vectors(monkeypatch):
    # Equal lengths leave no block and no row out: what counts is the time of a pair.
    rng = np.random.default_rng(12)
    x = rng.normal(size=(28_672, 64))
    x = np.floor(x / np.linalg.norm(x, axis=1)[:, None] * 1024).astype(np.int64)
    x[9000] = x[100]
    blocks = [(np.arange(i, i + 4096), x[i : i + 4096].astype(np.int16)) for i in range(0, len(x), 4096)]
    query_ids, q = np.arange(100, 4100), x[100:4100].astype(np.int16)
    turned = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1].copy()
    begun = time.process_time()
    best = inner_products.search(query_ids, q, np.full(len(q), -np.inf), blocks, turned, 10)
    assert time.process_time() - begun < 15
    got = defaultdict(list)
    for query_id, vec_id, score in zip(*(h.tolist() for h in best.hits()), strict=True):
        got[query_id].append((vec_id, score))
    for query_id in range(100, 4100, 13):
        scores = x @ x[query_id]
        order = [i for i in np.lexsort((np.arange(len(x)), -scores))[:11] if i != query_id][:10]
        assert got[query_id] == [(i, scores[i]) for i in order]
    # Floors leave out what is lower, and nothing else; heads change nothing either.
    floors = best.scores[:, 4].astype(float)
    for head in (16, 48):
        monkeypatch.setattr(inner_products, "_cheapest_head", lambda *_, head=head: head)
        again = inner_products.search(query_ids, q, floors, blocks, turned, 10)
        assert (again.ids[:, :5] == best.ids[:, :5]).all() and (again.scores[:, :5] == best.scores[:, :5]).all()
        assert (again.have == (best.scores >= best.scores[:, 4:5]).sum(axis=1)).all()


def test_toxicity(spark):
    rng = random.Random(1)
    plain = ["house", "river", "stone", "green", "water", "letter", "window", "garden", "moment", "paper"]
    rows = [(i, " ".join(rng.choices(plain, k=30) + (["idiot", "moron"] if i % 4 == 0 else []))) for i in range(400)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(None, 1), (500, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, sample=100)
    tests = [(1, "what an 1d10t you are"), (2, "such a m o r o n here"), (3, "iiidiiiot"), (4, "river stone water"), *[(90 + i, t) for i, (_, t) in enumerate(ODD)]]
    got = {r.doc_id: r for r in toxicity.score(table(spark, tests), model).collect()}
    assert [got[i].predicted for i in (1, 2, 3, 4)] == [1, 1, 1, 0] and all(0 <= r.score <= 1 for r in got.values()) and got[90].predicted == 0
    assert toxicity.score(docs, toxicity.learn(docs, labels.where("toxic = 0"))).where("score <> 0").count() == 0


def test_letter_counts_do_not_depend_on_the_split(spark):
    rows = [(i, t) for i, t in enumerate(["Abc de", "", None, "é x", "zz top 9", "a", " b "] * 30)]
    want = Counter()
    for _, text in rows:
        codes = [0, 0, 0, *[c - 96 if 97 <= c <= 122 else 27 if c > 127 else 0 for c in (text or "").lower().encode()], *([0] if text else [])]
        want.update(tuple(codes[i - 3 : i + 1]) for i in range(3, len(codes)))
    for parts in (1, 5, 60):
        counts = toxicity.letter_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))
        assert {g: int(counts[g[0] << 15 | g[1] << 10 | g[2] << 5 | g[3]]) for g in want} == want and counts.sum() == sum(want.values())


@pytest.mark.parametrize("ends", [False, True])
def test_decode_against_all_readings(ends):
    rng = np.random.default_rng(5)
    costs = rng.exponential(3, 32**4)

    def paths(run, last="", at=0, before=(0, 0, 0), letters="", cost=0.0):
        code = lambda b, c: b[0] << 15 | b[1] << 10 | b[2] << 5 | c
        if at == len(run):
            yield cost + costs[code(before, 0)], letters
            return
        char, extra = run[at], toxicity._COST["double"] if collapse and run[at] == last else 0
        read = [(c, extra) for c in char if c.isalpha()] + [(c, extra + toxicity._COST["sign"]) for c in toxicity.READINGS.get(char, "")]
        stays = [toxicity._COST["repeat"]] if extra else []
        if not char.isalpha():
            stays.append(toxicity._COST["skip"] + (2.5 if read else 0))
            read += [(" ", toxicity._COST["end"])] if ends and not read else []
        for c, more in read:
            k = 0 if c == " " else ord(c) - 96
            yield from paths(run, char, at + 1, (*before[1:], k), letters + c, cost + more + costs[code(before, k)])
        if stays:
            yield from paths(run, char, at + 1, before, letters, cost + min(stays))

    for run in ("1d10t", "****", "m.o-r_o n", "iiidd", "@$!1", "f**k", "a  b", "*1*1*", "x"):
        for collapse in (True, False):
            assert toxicity.decode(run, costs, collapse, ends) == min(paths(run))[1]


def test_long_disguises(spark):
    rng = random.Random(1)
    plain = ["house", "river", "stone", "green", "water", "letter", "window", "garden", "moment", "paper"]
    rows = [(i, " ".join(rng.choices(plain, k=30) + (["idiot", "moron"] if i % 4 == 0 else []))) for i in range(400)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    spaced, clean = ("river stone water green moron house paper garden idiot window letter", "river stone water green house paper garden window letter")
    tests = [(1, "  ".join(" ".join(w) for w in spaced.split())), (2, ".".join(spaced.replace(" ", ""))), (3, "i" * 70 + "d" * 50 + "iot"), (4, " ".join(clean.replace(" ", ""))),
             (5, "ab12" * 5000), (6, "1" * 50_000), (7, "a." * 3000)]
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0}


def test_perplexity(spark):
    rng = random.Random(2)
    rows = [(100 + i, " ".join(rng.choices("abcdefgh", weights=range(1, 9), k=rng.randrange(0, 400))).title()) for i in range(60)] + ODD
    model = perplexity.learn(table(spark, rows), where="crc32(cast(doc_id as string)) % 7 <> 2")
    train = [[*words(t), None] for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    unigrams, bigrams = Counter(w for t in train for w in t), Counter()
    for t in train:
        bigrams.update(zip([0, *t], t))
    context, before = defaultdict(lambda: [0, 0, 0, 0]), Counter()
    for (v, w), n in bigrams.items():
        context[v][0] += n
        context[v][min(n, 3)] += 1
        before[w] += 1
    count = lambda c: [sum(n == k for n in c.values()) for k in (1, 2, 3, 4)]
    d, e = perplexity.discounts(count(bigrams)), perplexity.discounts(count(before))
    kinds = [sum(n == 1 for n in before.values()), sum(n == 2 for n in before.values()), sum(n > 2 for n in before.values())]
    total, distinct = sum(unigrams.values()), len(unigrams)

    def want(text):
        tokens, score, base, v = [*words(text), None], 0.0, 0.0, 0
        for w in tokens:
            p = (before[w] - e[min(before[w], 3)]) / len(bigrams) + e[1:] @ kinds / len(bigrams) / (len(before) + 1)
            if v in context:
                n = bigrams[v, w]
                p = (n - d[min(n, 3)]) / context[v][0] + d[1:] @ context[v][1:] / context[v][0] * p
            score, base, v = score + math.log10(p), base + math.log10((unigrams[w] + 1) / (total + distinct + 1)), w
        return [len(tokens), sum(unigrams[w] > 0 for w in tokens), total, pytest.approx(base), pytest.approx(score)]

    texts = {i: t for i, t in rows}
    for r in perplexity.score(table(spark, rows), model).collect():
        assert [r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score] == want(texts[r.doc_id])
    assert model["distinct"] == distinct
    empty = perplexity.learn(table(spark, []))
    assert perplexity.score(table(spark, ODD), empty).where("score <> 0 or base_score <> 0 or n_known <> 0").count() == 0


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [*ODD, (40, "It's a<|endoftext|>b ΣΑΣ É́ \x1c! \x01 x\x01y"), *[(50 + i, "tick " * i) for i in range(60)]]
    got = packing.best_fit_pack(table(spark, rows), path, capacity=64).collect()
    tokenizer, want, texts = Tokenizer.from_file(path), Counter(), {}
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((i, k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64)))
        texts[i] = text
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    room = []
    for length in sorted((r.length for r in got), reverse=True):
        fit = min((i for i, x in enumerate(room) if x >= length), key=room.__getitem__, default=None)
        room.append(64 - length) if fit is None else room.__setitem__(fit, room[fit] - length)
    assert len(bins) == len(room) and packing.best_fit_pack(table(spark, []), path).count() == 0


def test_packing_encodes_each_unit_once():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    texts = [f"tick{i}, ({i * 7919}) Église-{i} naïve{'!' * (i % 4)} tock" for i in range(2000)]
    for text, ids in zip(texts, encoder.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encoder.known) < 40  # 8,000 words


@pytest.mark.parametrize("change", [{}, {"normalizer": {"type": "NFC"}}, {"normalized": True}])
def test_packing_ids_are_the_tokenizers(tmp_path, change):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        told = json.load(file)
    if "normalized" in change:
        told["added_tokens"][0] |= change
    else:
        told |= change
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(told), encoding="utf-8")
    tokenizer, encoder = Tokenizer.from_file(str(path)), packing.WordEncoder(str(path))
    assert encoder.cuts == (not change)
    signs = [*"aHsStT19-.,'=<>|\n\t\v\x01\x1f \xa0", *"ÀÉéß×÷ªµ½İıſǅΣςΩΩKÅẖﬁ٣中가각क़़…—’", *"\u2126\u212a\u212b\u1fef\u037e\u0300\u0308\u0323\u0331\u0338\u0327\u1161\u200d\u2028"]
    signs += ["<|endoftext|>", "<|startoftext|>", "<|STARTOFTEXT|>", "<|endoftext", "|>", "'s", "'re", "'LL", "ΑΣ", "l'système"]
    rng = random.Random(9)
    texts = ["".join(rng.choices(signs, k=rng.choice([0, 1, 3, 30]))) for _ in range(4000)] + [None]
    for text, ids in zip(texts, encoder.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, ascii(text)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before, names = docs, docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, before, FOLDER).cache()
        assert after.columns == names and 0 < after.count() <= before.count(), name
        if name == "minhash_near_dedup":
            assert near_dedup.near_duplicates(after).where("not kept").count() == 0
        if name == "benchmark_decontamination":
            assert decontaminate.contamination(after, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).where("contaminated").count() == 0
        before = after
    packed = corpus_pipeline.run(spark, FOLDER)
    assert packed.select("doc_id").distinct().count() == before.count()


def test_pipeline_on_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        for _, step in corpus_pipeline.STAGES:
            df = step(spark, df, FOLDER)
        assert df.count() >= 0


CLASHING = ("score", "lang_pred", "n_lines", "n_dropped", "key", "component_id", "kept", "n_hit", "_text_hash", "contaminated")


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").drop("n_chars")
    for c in CLASHING:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")))
    for _, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, docs, FOLDER)
        assert after.columns == docs.columns
        assert after.where(" or ".join(f"{c} <> concat('{c} of ', doc_id)" for c in CLASHING)).count() == 0 < after.count()


def test_stages_on_repeated_ids(spark):
    """Rows of one id with different texts are different documents; of equal texts one stays, that of the least id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("length(text) > 300").orderBy("item_id").first().text
    docs = spark.createDataFrame([(7, a), (7, b), (5, a), (5, a), (None, b), (None, c), (8, item), (8, c), (9, None), (9, "")], "doc_id long, text string")
    near = sorted(map(tuple, corpus_pipeline.minhash_near_dedup(spark, docs, FOLDER).collect()), key=str)
    assert near == sorted([(5, a), (7, b), (8, item), (8, c), (9, None), (9, "")], key=str)
    clean = corpus_pipeline.benchmark_decontamination(spark, docs, FOLDER).collect()
    assert sorted(map(str, clean)) == sorted(str(r) for r in docs.collect() if r.text != item)
