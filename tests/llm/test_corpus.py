"""Each corpus operator against a plain version of itself, and on difficult rows."""

import collections
import hashlib
import html
import itertools
import math
import os
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from larkspur.llm import bpe, chat, html_extract, langid, line_rules, minhash, mixing, near_copies, quality_lm, queries, simhash, token_counts

SF = "/root/testdata/sf0.001"
LONG = "Long words here stay. " * 6000
MESSY = [
    (1, "One plain text. It has a few words, and ends.", "en", "a", 1),
    (1, "One plain text. It has a few words, and ends.", "en", "a", 1),
    (2, None, "en", None, 2),
    (3, "", None, "a", 3),
    (None, "Text without an id.", "de", "b", 4),
    (None, None, None, None, None),
    (4, LONG, "en", "b", 5),
    (5, " \t\n\x0b ", "de", "", 6),
    (6, "日本語 😀 <|endoftext|> </s>", "ja", "c", 7),
    (7, "a\n" * 50, "en", "c", 8),
]
SCHEMA = "doc_id long, text string, lang string, source string, size int"


@pytest.fixture(scope="session")
def messy(spark):
    clash = ("score", "kept", "taken", "target", "n_tokens", "fingerprint", "lang_pred", "n_words", "token_ids", "_h", "_words")
    return spark.createDataFrame(MESSY, SCHEMA).select("*", *(F.lit("mine").alias(c) for c in clash))


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id").reset_index(drop=True)


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def shingles(text, n):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def oracle(sql, **own):
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(SF):
        if t.split(".")[0] not in own:
            c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    for name, rows in own.items():
        c.register(name, rows)
    return c.sql(sql).df()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), oracle(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    got, want = (x[sorted(x.columns)].sort_values("doc_id").reset_index(drop=True) for x in (got, want))
    assert got.equals(want[got.columns].astype(got.dtypes))


# mixing


def test_mix_targets(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 10), ("a", 30), ("b", 1000), ("c", 500), (None, 60), ("d", 0)])]
    out = mixing.assign(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    size, weight = {"a": 40, "b": 1000, "c": 500, "d": 0, None: 60}, {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    target = dict.fromkeys(size, 0.0)
    rest, free = 1600.0, set(size)
    while rest > 1e-9 and free:  # reshare the excess until none is above
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        rest = 0.0
        for s in list(free):
            target[s] += share[s]
            if target[s] >= 3 * size[s]:
                rest += target[s] - 3 * size[s]
                target[s] = 3.0 * size[s]
                free.discard(s)
    for r in out.itertuples():
        s = None if r.source is None or r.source != r.source else r.source
        assert r.target == pytest.approx(target[s]) and r.taken <= 3 * r.size
    taken = out.assign(s=out.source.fillna("?")).groupby("s").taken.sum()
    assert all(taken["?" if s is None else s] == round(t) for s, t in target.items())


def test_mix_positions(spark):
    one = spark.range(1).select(F.explode(F.array(*(F.lit(k / 20) for k in range(21)))).alias("q"))
    for knots in (*mixing.CURRICULUM, (0.0, 2.0, 1.0), (1.0, 1.0)):
        at = np.array([r.t for r in one.select(mixing.position(F.col("q"), knots).alias("t")).collect()])
        grid = np.linspace(0, 1, 200_001)
        area = np.cumsum(np.interp(grid, np.linspace(0, 1, len(knots)), knots))
        assert np.abs(np.interp(at, grid, area / area[-1]) - np.arange(21) / 20).max() < 1e-4


def test_mix_messy(messy):
    a, b = (sorted(map(str, mixing.assign(messy).collect())) for _ in range(2))
    assert a == b and len(a) == len(MESSY)
    assert mixing.assign(messy.limit(0)).count() == 0
    rows = mixing.mix(messy).collect()
    assert [r.mix_position for r in rows] == sorted(r.mix_position for r in rows) and all(r.text for r in rows)


# main text


def test_extract_pages(spark):
    got = html_extract.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    for r in got:
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"<(?:p|h1|/p|/h1)>", body))
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_extract_other_layouts(spark):
    say = "The old harbour was rebuilt after the storm, and people came back to it. They opened shops along the quay."
    page = f"""<body><div class="cookie-notice"><p>We use cookies.</p></div><header><h1>Site</h1><a href=/>Home</a></header><main><article><h1>Harbour &amp; town</h1>
      <p>{say}</p><aside class=related><a href=x>More news</a></aside><p>{say}<br>{say}</p></article><section class="comments"><div class="comment"><p>Great post!</p></div></section></main>
      <form><label>Search</label><input></form><footer>&copy; 2020</footer><script>if (a < b) {{}}</script></body>"""
    rows = [(1, page), (2, None), (3, ""), (4, "<p>unclosed <b>text <!-- never"), (5, "<script>var a"), (6, "<p>" + "word " * 50_000)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got[1] == f"Harbour & town\n{say}\n{say} {say}"
    assert got[2] == got[3] == got[5] == ""
    assert len(got[6]) == 249_999


def test_extract_no_text_lost(spark):
    """Offsets, elements that are no raw text, and what browsers skip."""
    say = "This paragraph stays here, whole, from its first word to its last one."
    pages = {
        "İ" * 24 + f" {say}</p><script>x=1</script><p>Next paragraph stays here, whole.": "İ" * 24 + f" {say}\nNext paragraph stays here, whole.",
        f"{say}</p><noscript>n<p>{say} Rest.": None,
        f"{say}</p><svg><path d='M0'><p>{say} Rest.": f"{say}\n{say} Rest.",
        f"{say} Here <math><mi>x</mi><mo>=</mo><mn>2</mn></math> follows.</p><p>{say}": None,
        f"{say}</p><SCRIPT>if (a<b) '</scripty>'</SCRIPT ><p>{say} Rest.": f"{say}\n{say} Rest.",
        f"{say}</p><template><p>{say} Never shown.</p></template><p>{say} Rest.": f"{say}\n{say} Rest.",
    }
    rows = [(k, f"<html><body><article><h1>A title of some words</h1><p>{x}</p></article></body></html>") for k, x in enumerate(pages)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    for k, want in enumerate(pages.values()):
        assert want is None or got[k] == f"A title of some words\n{want}"
    assert say in got[1] and got[1].endswith("Rest.")
    assert got[3].endswith(say) and all(x in got[3] for x in ("x", "=", "2", "follows."))


def scored(pages):
    """Precision and recall over blocks of (page, 1 or 0 for each block's text)."""
    own, hit, wrong, missed = html_extract.trained(), 0, 0, 0
    for page, truth in pages:
        leaves = [t for _, t, _ in html_extract.blocks(page)]
        main = [t for (_, t, _), m in zip(html_extract.blocks(page), next(html_extract.label(own, [html_extract.blocks(page)])), strict=True) if m]
        want = [t for t in leaves if truth[t]]
        both = sum((collections.Counter(main) & collections.Counter(want)).values())
        hit, wrong, missed = hit + both, wrong + len(main) - both, missed + len(want) - both
    return hit / (hit + wrong), hit / (hit + missed)


def test_extract_held_out_layouts():
    r = np.random.default_rng(99)
    assert min(scored(html_extract.made_page(r) for _ in range(400))) >= 0.97


def test_extract_hand_made_layouts():
    """Text between [[ and ]] is main text."""
    a = "[[The mill by the river has stood empty since the flood, and few people remember who owned it.]]"
    b = "[[In spring the council decided to sell it. Three buyers came, looked at the walls, and left again.]]"
    c = "[[Nobody knows what will happen next, but the roof will not last another winter.]]"
    menu = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul>"
    said = "Thanks for this, my uncle worked there for years and often told us about it."
    other = "I do not agree at all. The council had no choice in the matter."
    made = [
        f"<nav>{menu}</nav><article><h1>[[The old mill]]</h1><p>{a}</p><p>{b}</p><p>{c}</p></article><footer>&copy; 2021 Valley Press</footer>",
        f"<header><h1>Valley Press</h1>{menu}</header><main><h1>[[The old mill]]</h1><p>{a}</p><ul><li>[[one wall fell]]</li><li>[[the wheel is gone]]</li></ul><p>{b}</p></main><footer><p>All rights reserved.</p></footer>",
        f"<article><h2>[[The old mill]]</h2><p>{a}</p><p>{b}</p><div id=respond><div class=reaction><p>Anna</p><p>{said}</p></div><div class=reaction><p>Bert</p><p>{other}</p></div></div></article>",
        f"<article><h1>[[The old mill]]</h1><p>{a}</p><p>{c}</p><section class=comments><div class=comment><p>{said}</p></div><div class=comment><p>{other}</p></div></section></article>",
        f"<table><tr><td><p><a href=/>Home</a></p><p><a href=/n>News</a></p><p><a href=/s>Sport</a></p></td><td><h1>[[The old mill]]</h1><p>{a}</p><p>{b}</p></td></tr></table>",
        f"<div class=cookie-banner><p>We use cookies to make this site better.</p></div><div class=content><h1>[[The old mill]]</h1><p>{a}</p><p>{b}</p><p>{c}</p></div><div class=sidebar><h3>Popular</h3>{menu}</div>",
        f"<div id=menu>{menu}</div><div id=main><p>{a}</p><blockquote><p>{b}</p></blockquote><p>{c}</p></div><div id=footer><p>Contact us by mail.</p></div>",
        f"<article><h1>[[The old mill]]</h1><p>{a}</p><div class=ad>Buy new windows now!</div><p>{b}</p><aside class=related><h3>More</h3>{menu}</aside><p>{c}</p></article>",
        f"<article><h1>[[The old mill]]</h1><p>{a}</p><table><tr><td>[[year]]</td><td>[[owners]]</td></tr><tr><td>[[1890]]</td><td>[[three brothers]]</td></tr></table><p>{b}</p></article>",
        f"<form class=search><label>Search the site</label><input></form><section class=post><h1>[[The old mill]]</h1><p>{a}</p><h2>[[What comes next]]</h2><p>{c}</p></section><div class=share><a href=x>Send</a></div>",
        f"<div class=wrapper><nav>{menu}</nav><main><article class=story><p>{a}</p><p>{b}</p><pre>[[wheel = 4 m]]</pre><p>{c}</p></article></main><div class=newsletter><p>Get our letter each week.</p></div></div>",
        f"<body class=home><div class=top><a href=/>Valley Press</a></div><article><h1>[[The old mill]]</h1><p>{a}</p></article><div class=discussion><div class=reply><p>{said}</p></div></div><footer>Valley Press · Mill Lane 4</footer>",
    ]
    pages = []
    for page in made:
        truth = {t.replace("[[", "").replace("]]", ""): int("[[" in t) for _, t, _ in html_extract.blocks(page)}
        pages.append((page.replace("[[", "").replace("]]", ""), truth))
    assert min(scored(pages)) >= 0.97


def test_extract_messy(spark):
    page = "<article><h1>A title of words</h1><p>Some text that is long enough to be read as one.</p></article>"
    rows = spark.createDataFrame([(1, page, "mine", "mine"), (1, page, "mine", "mine"), (None, None, None, None)], "page_id long, html string, text string, n_chars string")
    got = html_extract.extract(rows).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 65), ("1", 65), ("None", 0)] and set(got[0].asDict()) == {"page_id", "html", "text", "n_chars"}
    assert html_extract.extract(rows.limit(0)).count() == 0


def test_labeller_gradient():
    r = np.random.default_rng(0)
    own = html_extract.Labeller()
    own.p = [a.astype(np.float64) for a in own.p]
    x = [r.normal(size=(k, html_extract.WIDTH)) for k in (3, 5)]
    y = [(r.random(k) > 0.5).astype(float) for k in (3, 5)]
    loss = lambda: -sum((t * np.log(p) + (1 - t) * np.log(1 - p)).sum() for p, t in zip(own.run(x), y, strict=True)) / 8
    found = own.gradient(x, y)
    for k, g in enumerate(found):
        i = tuple(r.integers(n) for n in g.shape)
        before = own.p[k][i]
        own.p[k][i] = before + 1e-3
        up = loss()
        own.p[k][i] = before - 1e-3
        assert (up - loss()) / 2e-3 == pytest.approx(g[i], abs=2e-4)
        own.p[k][i] = before


# language


def test_language_accuracy(spark, docs):
    got = queries.op3_language_id(spark, SF).toPandas().merge(docs, on="doc_id")
    assert [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id] == list(got.held_out)
    assert (got.lang == got.lang_pred)[got.held_out].mean() > 0.95
    assert got.score.between(0, 1).all()


@settings(max_examples=30, deadline=None)
@given(st.text("abc ", min_size=1, max_size=60), st.text("abcd ", max_size=80))
def test_cross_parsing(sample, text):
    sample = " ".join(sample.split()) or "a"
    model = langid.Model((("x", (sample, 1)),))
    phrases, chars, _ = model.phrases([text])
    norm = re.sub(" +", " ", text)
    known, n, at = sample, 0, 0
    assert chars[0] == len(norm)
    while at < len(norm):  # longest phrases of the sample, or one unknown letter
        end = at
        while end < len(norm) and norm[at : end + 1] in known:
            end += 1
        n += 1
        at = max(end, at + 1)
    assert abs(phrases[0, 0] - max(n, 1)) <= 1


def test_walker_transitions():
    r = np.random.default_rng(4)
    for letters, n in ((3, 200), (400, 900), (5, 1)):
        sample = r.integers(0, letters, n)
        edges, own = langid.automaton(sample.tolist()), langid.Walker(sample, letters)
        state, letter = (x.ravel() for x in np.meshgrid(np.arange(len(edges)), np.arange(letters), indexing="ij"))
        to, ended = own.step(state, letter)
        for s, c, t, e in zip(state.tolist(), letter.tolist(), to.tolist(), ended.tolist(), strict=True):
            assert t == edges[s].get(c, edges[0].get(c, 0)) and e == (c not in edges[s]) + (s > 0 and c not in edges[s] and c not in edges[0])


def test_language_large_scripts(spark):
    """Two languages of 3,000 letters each beside one of few, and texts of unseen scripts."""
    r = np.random.default_rng(2)
    say = lambda first, n: "".join(chr(first + x % 3000) for x in r.zipf(1.2, n).clip(max=10**6).tolist())
    rows = [(k, lang, say(first, n) if first else " ".join(r.choice(["the", "of", "and", "tion", "ing", "ment"], n))) for k, (lang, first, n) in enumerate([("x", 0x4E00, 200), ("y", 0x4E00 + 3000, 200), ("en", 0, 60)] * 120)]
    rows += [(9000, None, "Жили были дед да баба"), (9001, None, "12 + 3"), (9002, "x", "一二")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, lang string, text string")).toPandas()
    held = got[[zlib.crc32(str(i).encode()) % 5 == 0 and i < 9000 for i in got.doc_id]]
    assert len(held) > 50 and (held.lang == held.lang_pred).mean() >= 0.95
    assert got.lang_pred[got.doc_id == 9001].item() == "und" and got.score[got.doc_id == 9000].item() < 0.5


def test_language_many_labels(spark):
    """More labels than are learned: those of the most documents are; samples share their bound."""
    rows = [(k, f"l{k % 40}", f"word{chr(97 + k % 20)} " * (5 + k % 7)) for k in range(400)] + [(1000 + k, f"rare{k}", "seldom said") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    found = langid.references(docs, languages=40, total=80_000, piece=1024)
    assert set(found) == {f"l{k}" for k in range(40)} and all(len(t) <= 2000 for t, _ in found.values())
    same = docs.select(F.lit(None).cast("long").alias("doc_id"), "lang", "text")
    assert langid.references(same, languages=40, total=80_000, piece=1024).keys() == found.keys()  # without ids


def test_language_messy(spark, messy):
    got = langid.identify(messy).collect()
    assert len(got) == len(MESSY)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if not re.search(r"[^\W\d_]", r.text or ""))
    assert langid.identify(messy.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predict(messy, {}).collect()} == {"und"}


# quality


def test_quality_brute(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op4_quality_lm(spark, SF).toPandas().set_index("doc_id")
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic == 0}
    held_out = {r.doc_id for r in labels.where(quality_lm.only_threshold(F.col("doc_id"))).collect()} & good
    assert 2 < len(held_out) < len(good) / 4
    c = [None, *(collections.Counter() for _ in range(4))]
    for text in docs.text[docs.doc_id.isin(good - held_out)]:
        z = "\x01" * 3 + text
        c[4].update(z[i - 3 : i + 1] for i in range(3, len(z)))
    for k in (3, 2, 1):
        c[k].update(g[1:] for g in c[k + 1])
    cut, total, held = [None], [None], [None]
    for k in range(1, 5):
        n = collections.Counter(c[k].values())
        cut.append(quality_lm.discounts([n[1], n[2], n[3], n[4]]))
        total.append(collections.Counter())
        held.append(collections.Counter())
        for g, m in c[k].items():
            total[k][g[:-1]] += m
            held[k][g[:-1]] += cut[k][min(m, 3) - 1]

    def p(g):
        k, h = len(g), g[:-1]
        less = p(g[1:]) if k > 1 else 1 / (len(c[1]) + 1)
        n = c[k][g]
        return ((n - cut[k][min(n, 3) - 1] if n else 0) + held[k][h] * less) / total[k][h] if total[k][h] else less

    def bits(text):
        z = "\x01" * 3 + text
        return -sum(math.log2(p(z[i - 3 : i + 1])) for i in range(3, len(z)))

    some = {r.doc_id: (r.lang, r.text, bits(r.text)) for r in docs.itertuples() if r.doc_id in held_out or r.Index % 9 == 0}
    groups = collections.defaultdict(list)
    for i in held_out:
        groups[some[i][0]].append(i)
    mean = {lang: sum(some[i][2] for i in ids) / sum(len(some[i][1]) for i in ids) for lang, ids in groups.items()}
    overall = sum(some[i][2] for i in held_out) / sum(len(some[i][1]) for i in held_out)
    score = {i: (b + 200 * mean.get(lang, overall)) / (len(text) + 200) for i, (lang, text, b) in some.items()}
    far = max(score[i] - mean[some[i][0]] for i in held_out)  # the quantile of a few is the greatest
    for i, (lang, text, b) in some.items():
        assert 2 ** (b / len(text)) == pytest.approx(got.perplexity[i], rel=1e-5) and score[i] == pytest.approx(got.score[i], rel=1e-5)
        assert got.threshold[i] == pytest.approx(1.15 * (mean.get(lang, overall) + far), rel=1e-5)
        assert got.kept[i] == (score[i] <= got.threshold[i] * (1 + 1e-7))


def test_quality_verdict(spark):
    """Trusted documents that the counts have not seen stay, as good as all; most labelled as bad go."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op4_quality_lm(spark, sf).join(labels, "doc_id").withColumn("held", quality_lm.only_threshold(F.col("doc_id")))
    rates = {(r.quality, r.toxic, r.held): (r.k, r.n) for r in got.groupBy("quality", "toxic", "held").agg(F.avg(F.col("kept").cast("int")).alias("k"), F.count("*").alias("n")).collect()}
    assert rates[1, 0, True][0] == 1 and rates[1, 0, False][0] > 0.99 and rates[1, 0, True][1] > 20
    bad = [v for k, v in rates.items() if k[0] == 0]
    assert sum(k * n for k, n in bad) / sum(n for _, n in bad) < 0.3


def test_quality_blocks(spark, docs, monkeypatch):
    """Blocks change nothing, and equal rows are spread over them."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    trusted = quality_lm.trusted_ids(spark.read.parquet(f"{SF}/labels.parquet"))
    rows = rows.unionByName(rows.where("doc_id = 5").crossJoin(spark.range(40)).drop("id"))
    want = {(r.doc_id, round(r.score, 9), r.kept) for r in quality_lm.classify(rows, trusted).collect()}
    monkeypatch.setattr(quality_lm, "BLOCK_CHARS", 20_000)
    got = quality_lm.classify(rows, trusted).collect()
    assert len(got) == len(docs) + 40 and {(r.doc_id, round(r.score, 9), r.kept) for r in got} == want
    dealt = quality_lm.packed(rows.where("doc_id = 5").select("doc_id", "text"), 8, "doc_id", "text")
    assert dealt.select("_block").distinct().count() == 8


def test_quality_messy(spark, messy):
    trusted = spark.createDataFrame([(1,), (4,)], "doc_id long")
    got = quality_lm.classify(messy, trusted).collect()
    assert len(got) == len(MESSY) and sum(r.perplexity is None for r in got) == 3
    assert not any(r.kept for r in got if r.perplexity is None)
    assert all(r.kept for r in quality_lm.classify(messy, trusted.limit(0)).collect() if r.perplexity is not None)
    assert quality_lm.classify(messy.limit(0), trusted).count() == 0


# tokens


@pytest.fixture(scope="session")
def library():
    return Tokenizer.from_file(queries.VOCABULARY)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text("ab 'sé1\n<|endoftxt>", max_size=80))
def test_bpe_like_library(library, text):
    own = bpe.codec(open(queries.VOCABULARY).read())
    ids = own.encode([text])[0]
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == text


def test_bpe_all_code_points(library):
    own = bpe.codec(open(queries.VOCABULARY).read())
    every = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    texts = ["".join(f"a{c}b 1{c} {c}" for c in every[k : k + 2000]) for k in range(0, len(every), 2000)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and own.decode(ids) == text


def test_bpe_documents(spark, docs, library):
    got = queries.op5_bpe_round_trip(spark, SF).toPandas().set_index("doc_id")
    for r in docs.itertuples():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert got.n_tokens[r.doc_id] == len(ids)
        assert got.ids_sha256[r.doc_id] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got.decoded_sha256[r.doc_id] == hashlib.sha256(r.text.encode()).hexdigest()


def test_bpe_messy(messy, library):
    got = bpe.decode(bpe.encode(messy, queries.VOCABULARY), queries.VOCABULARY).collect()
    assert len(got) == len(MESSY)
    for r in got:
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    assert bpe.encode(messy.limit(0), queries.VOCABULARY).count() == 0


def test_bpe_refuses_other_orders():
    vocab = {c: k for k, c in enumerate(bpe.byte_alphabet())} | {"ab": 256, "abc": 257}
    import json

    with pytest.raises(ValueError):
        bpe.Codec(json.dumps({"model": {"vocab": vocab, "merges": [["ab", "c"], ["a", "b"]]}, "added_tokens": []}))


def test_counts_brute(spark, docs, messy):
    own = bpe.codec(open(queries.VOCABULARY).read())
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    scores = token_counts.fitted_scores(own, token_counts.sampled_words(rows, queries.VOCABULARY))
    assert sum(map(math.exp, token_counts.zipf_scores(own).values())) == pytest.approx(1) and sum(map(math.exp, scores.values())) == pytest.approx(1)
    got = queries.op6_unigram_counts(spark, SF).toPandas().set_index("doc_id")
    for r in docs[::10].itertuples():
        found = own.pattern.findall(r.text)
        assert got.n_pretokens[r.doc_id] == len(found)
        assert got.n_tokens[r.doc_id] == sum(token_counts.brute_count(w.encode(), scores) for w in found)
    rows = token_counts.count_tokens(messy, queries.VOCABULARY).collect()
    assert len(rows) == len(MESSY) and all(r.n_tokens == 0 for r in rows if not r.text)
    assert token_counts.count_tokens(messy.limit(0), queries.VOCABULARY).count() == 0


def test_counts_fit(docs):
    """Each round makes the sample likelier, and held-out documents are likelier than under the law."""
    own = bpe.codec(open(queries.VOCABULARY).read())
    tally = lambda some: sorted((w.encode(), n) for w, n in collections.Counter(w for t in some for w in own.pattern.findall(t)).items())
    mine, other = tally(docs.text[::2][:40]), tally(docs.text[1::2][:40])
    words = {w.decode(): n for w, n in mine}
    law = token_counts.zipf_scores(own)
    likely = [token_counts.expected(s, mine)[1] for s in (law, *(token_counts.fitted_scores(own, words, rounds=k, prior=1) for k in (1, 2, 3)))]
    assert likely == sorted(likely) and likely[1] > likely[0]
    assert token_counts.expected(token_counts.fitted_scores(own, words), other)[1] > token_counts.expected(law, other)[1]


def test_counts_fit_to_all_texts(spark):
    """Beyond a million characters, and on odd and long words, the fit by Spark is the plain one over all words; null and empty tables keep the law."""
    own = bpe.codec(open(queries.VOCABULARY).read())
    rows = [(k, f" w{k}x" * 1_200) for k in range(250)] + [(900, "a" * 3_000), (901, "日本語 ñandú"), (902, None), (903, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sum(len(t or "") for _, t in rows) > 1_500_000
    words = collections.Counter(w for _, t in rows if t for w in own.pattern.findall(t))
    want, tokens = token_counts.fitted_scores(own, words), token_counts.ordinary(own)
    np.testing.assert_allclose(token_counts.fit(df, queries.VOCABULARY), [want[b] for b in tokens], rtol=1e-9, atol=1e-9)
    law = token_counts.zipf_scores(own)
    for none in (df.limit(0), df.where("doc_id > 901")):
        assert token_counts.fit(none, queries.VOCABULARY).tolist() == [law[b] for b in tokens]


def test_counts_of_many_words_at_once():
    """The fewest tokens of the best score, on words of any length, of equal scores and without a segmentation."""
    scores = {b"a": -1.0, b"b": -2.0, b"ab": -3.0, b"ba": -2.5, b"aba": -4.0, b"bb": -4.0}
    words = [bytes(w) for n in range(1, 8) for w in itertools.product(b"ab", repeat=n)] + [b"ab" * 700]
    lattice, values = token_counts.Lattice(list(scores)), np.array(list(scores.values()))
    assert lattice.fewest(values, words).tolist() == [token_counts.brute_count(w, scores) for w in words]
    assert lattice.fewest(values, [b"", b"c", b"ab"]).tolist() == [0, 0, 1] and lattice.fewest(values, []).tolist() == []


def test_counts_by_chunks(spark, monkeypatch):
    """Chunks give the pre-tokens of whole texts wherever white space stands, and the pattern is sought in each distinct one once."""
    import random

    own, draw = bpe.codec(open(queries.VOCABULARY).read()), random.Random(4)
    signs = [" ", " ", "  ", "\n", "\t", "a", "é", "1", "!", "'s", "\x1c", "\x85", "\u3000", "語", "_"]
    texts = [None, "", " ", "  ", "a ", " a", "\n x", "x\n y", "x\n", "a  b", "\x1c a", *("".join(draw.choices(signs, k=draw.randrange(25))) for _ in range(3000))]
    found = [own.pattern.findall(t or "") for t in texts]
    scores = np.array(list(token_counts.zipf_scores(own).values()))
    law = dict(zip(token_counts.ordinary(own), scores.tolist(), strict=True))
    counts = {w: token_counts.brute_count(w.encode(), law) for words in found for w in words}
    want = [sum(map(counts.get, words)) for words in found], list(map(len, found))
    lattice = token_counts.Lattice(token_counts.ordinary(own))
    counter = token_counts.Counter(lattice, scores, own.pattern)
    assert counter.count(texts) == want and counter.count(texts) == want
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 50)
    some = token_counts.Counter(lattice, scores, own.pattern)
    assert [some.count([t]) for t in texts[:300]] == [([a], [b]) for a, b in zip(*(x[:300] for x in want), strict=True)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert token_counts.sampled_words(df, queries.VOCABULARY) == collections.Counter(w for words in found for w in words)

    class Pattern:
        seen = 0

        def findall(self, text):
            self.seen += len(text)
            return own.pattern.findall(text)

    pattern = Pattern()
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 400_000)
    assert token_counts.Counter(lattice, scores, pattern).count(["one two three " * 1000 + "end"] * 5)[1] == [3001] * 5
    assert pattern.seen < 100


def test_counts_expected():
    """Forward and backward scores against all segmentations."""
    scores = {b"a": -1.0, b"b": -2.0, b"ab": -1.5, b"ba": -2.5, b"aba": -3.0}
    words = sorted((w, n) for w, n in ((b"aba", 2), (b"abab", 1), (b"b", 5)))
    want, total = collections.Counter(), 0.0
    for word, n in words:
        ways = [[word[a:b] for a, b in zip((0, *cut), (*cut, len(word)), strict=True)] for k in range(len(word)) for cut in itertools.combinations(range(1, len(word)), k)]
        ways = [w for w in ways if all(x in scores for x in w)]
        p = [math.exp(sum(scores[x] for x in w)) for w in ways]
        total += n * math.log(sum(p))
        for w, q in zip(ways, p, strict=True):
            for x in w:
                want[x] += n * q / sum(p)
    got, likelihood = token_counts.expected(scores, words)
    assert likelihood == pytest.approx(total) and got == pytest.approx(dict(want))


# near copies


def test_simhash_brute(spark, docs):
    got = queries.op7_simhash_groups(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)

    def fingerprint(text):
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles(text, 4)]
        return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))

    f = np.array([fingerprint(t) for t in docs.text], np.uint64)
    assert [f"{x:016x}" for x in f.tolist()] == list(got.fingerprint)
    assert reachable(f, 4, list(docs.doc_id)) == list(got.component_id)


def reachable(f, radius, ids):
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius
    out = list(ids)
    while True:
        new = [min(out[j] for j in np.flatnonzero(row)) for row in near]
        if new == out:
            return out
        out = new


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 120))
def test_forest(seed, n):
    r = np.random.default_rng(seed)
    f = np.unique(r.integers(0, 4, n).astype(np.uint64) * np.uint64(0x0F0F_3333_5555_00FF) ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (n, 3)).astype(np.uint64), axis=1))
    half = len(f) // 2
    for a, b in ((f, f[:0]), (f[:half], f[half:])):
        u, v = simhash.forest(a, b, 4, tile=8)
        pairs = [(x, y) for x, y in ((i, j) for i in f for j in f if i < j) if np.bitwise_count(x ^ y) <= 4 and (not len(b) or (x in a) != (y in a))]
        assert union(f, zip(u, v, strict=True)) == union(f, pairs)
        assert len(u) < max(1, len(f))


def union(nodes, pairs):
    root = {int(x): int(x) for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(int(a)), find(int(b))
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def one_of_each(rows):
    """Ids that stay of (id, text): groups of likeness 0.8 or more of 5-word shingles, by brute force."""
    sets = [set(shingles(text, 5)) or {""} for _, text in rows]
    pairs = ((i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) * 5 >= len(a | b) * 4)
    root = union(range(len(rows)), pairs)
    groups = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[root[k]].append((i is None, i or 0))
    return sorted(min(g) for g in groups.values())


def test_near_copies_brute(spark, docs):
    r = np.random.default_rng(3)
    base = [f"w{x}" for x in r.integers(0, 300, 400)]
    rows = list(zip(docs.doc_id.tolist(), docs.text, strict=True))
    for k, n in enumerate((0, 1, 4, 7, 9, 11, 14, 20, 30)):  # edits of words, the likeness falls below 0.8
        changed = list(base)
        for at in r.choice(400, n, replace=False):
            changed[at] = f"x{k}"
        rows += [(9000 + k, " ".join(changed)), (9100 + k, " ".join(changed[: 25 + k])), (None, " ".join(changed).upper())]
    rows += [(9000, rows[200][1])] * 3 + [(9500, "only twice"), (9500, "only twice"), (None, "no id"), (None, "no id"), (None, ""), (9600, None)]
    given = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = corpus_pipeline.near_dedup(spark, given, SF).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in got) == one_of_each(rows)


def test_near_copies_all_links_found(spark):
    """Every candidate step lets all pairs through whose likeness is just above 0.8, and no pair of unlike texts stays linked."""
    r = np.random.default_rng(5)
    rows = []
    for k in range(150):
        own = [f"w{x}" for x in r.integers(0, 100_000, 300)]
        at = r.choice(60, 6, replace=False) * 5  # 6 edits change 30 of 296 shingles: 266 of 326 are shared, 0.816
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(f"{w}y" if j in at else w for j, w in enumerate(own)))]
    got = near_copies.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((False, r.doc_id) for r in got.collect()) == one_of_each(rows)


def test_near_copies_messy(spark, messy):
    got = near_copies.deduplicate(messy)
    assert got.columns == messy.columns
    assert sorted((x is None, x or 0) for (x,) in got.select("doc_id").collect()) == one_of_each([(m[0], m[1]) for m in MESSY])
    assert near_copies.deduplicate(messy.limit(0)).count() == 0


def test_simhash_messy(messy):
    got = simhash.groups(messy).collect()
    assert len(got) == len(MESSY)
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {2}
    assert simhash.groups(messy.limit(0)).count() == 0


def test_minhash_likeness(spark, docs):
    got = queries.op10_minhash_fingerprints(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    like = lambda a, b: len(a & b) / len(a | b)
    for k, text in enumerate(docs.text):
        other = docs.text[(k + 1) % len(docs)]
        q = len(text) // 4
        edited = text[: len(text) - q] + other[:q]
        a, b, c = ({*shingles(x, 5)} for x in (text, edited, other))
        assert got.n_chars[k] == len(text) and got.edited_sha256[k] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got.near_edited[k] - like(a, b)) < 0.16 and abs(got.near_next[k] - like(a, c)) < 0.16
    assert got.fingerprint.nunique() == len({tuple(shingles(x, 5)) for x in docs.text})
    plain = minhash.fingerprints(spark.read.parquet(f"{SF}/documents.parquet")).toPandas().set_index("doc_id").fingerprint
    assert list(plain[got.doc_id]) == list(got.fingerprint)


@pytest.mark.parametrize("kind", ["string", "date", "decimal(20, 3)", "int"])
def test_minhash_next_of_any_id(spark, kind, monkeypatch):
    """Many ranges, ids of several types, repeated and null ids: every row once, in one order over all ranges."""
    monkeypatch.setattr(minhash, "RANGE_CHARS", 200)
    rows = [(None if k % 9 == 0 else k % 80, f"text number {k % 50} of words " * 2) for k in range(300)]
    docs = spark.createDataFrame(rows, "k int, text string").repartition(7)
    made = {"date": F.date_add(F.lit("2020-01-01"), F.col("k"))}.get(kind, F.col("k").cast(kind))
    docs = docs.select(made.alias("doc_id"), "text")
    got = minhash.with_next(docs).collect()
    own = [r for r in got if not r["_copy"]]
    assert sorted((str(r.doc_id), r.text) for r in own) == sorted((str(r.doc_id), r.text) for r in docs.collect())
    ranges = sorted({r["_range"] for r in own})
    assert len(ranges) > 5
    order = [r.doc_id for k in ranges for r in own if r["_range"] == k]
    assert order == sorted(order, key=lambda x: (x is None, x if x is not None else 0))
    for k in ranges:  # behind the last row of each range stands the first of the next
        copies, after = [r for r in got if r["_range"] == k and r["_copy"]], [r for r in own if r["_range"] == (k + 1) % len(ranges)]
        assert (copies[0].doc_id, copies[0].text) == (after[0].doc_id, after[0].text)
    compared = minhash.compare_with_next(docs)
    assert compared.count() == 300 and compared.schema["doc_id"].dataType == docs.schema["doc_id"].dataType


def test_minhash_messy(spark, messy):
    got = minhash.compare_with_next(messy).collect()
    assert len(got) == len(MESSY)
    texts = collections.defaultdict(set)
    for r in got:
        texts[r.doc_id].add(r.fingerprint)
    assert len(texts[1]) == 1 and minhash.compare_with_next(messy.limit(0)).count() == 0
    alone = minhash.compare_with_next(messy.where("doc_id = 4")).first()
    assert alone.near_next == 1.0


# rules


def test_rules_lines(spark):
    prose = "The ferry left the old harbour at noon, and nobody on the quay knew when it would come back again."
    other = "By evening the wind had turned, so that the smaller boats stayed in the bay until the morning tide."
    rows = [
        (1, f"{prose}\nHome | News | Sport | Weather\nAll rights reserved.\n{other}"),
        (2, "\n".join(["Home | News | Sport | Weather | Shop | Mail | Maps"] * 5)),
        (3, prose.upper().replace(" ", "!! ")),
        (4, " ".join(["again and"] * 20)),
    ]
    got = {r.doc_id: r for r in line_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].clean_text == f"{prose}\n{other}" and got[1].kept and got[2].n_dup_lines == 4
    assert not got[2].kept and not got[3].kept and got[4].base_failed and got[4].n_repeat_words == 40


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), min_size=1, max_size=12))
def test_rules_repeats(spark, some):
    got = line_rules.apply_rules(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(some)], "doc_id long, text string")).collect()
    for r in got:
        w = some[r.doc_id]
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        inside = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert r.n_repeat_words == len(inside)


@pytest.mark.parametrize("end", ["", "\r", "\t", " ", "\x0b\x0c \r", "\u0085", "\u2028", "\u00a0", " \t\r"])
def test_rules_white_space_like_sql(spark, end):
    """Lines that end in any white space, and in characters that only some engines take for it."""
    marked = ["one two three four.", "say (eight nine).", 'quiet "ten eleven."', "no mark here now", "a | b | c | d", "see\x0b|\x0c>\r/ all of this"]
    rows = [(10 * k + n, "\n".join(f"{line} {j}{line[-2:]}{end}" for j in range(3 * n))) for k, line in enumerate(marked) for n in range(1, 5)]
    rows += [(900, "\n".join([marked[0] + end] * 12)), (901, "\n".join(f"one {j} three four.{end}" for j in range(12)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_rules.apply_rules(docs)
    want = oracle(line_rules.ORACLE_SQL, documents=docs.toPandas()).sort_values("doc_id").reset_index(drop=True)
    got = got.select(*want.columns).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got.equals(want.astype(got.dtypes))
    assert got.kept[got.doc_id == 901].item() == (end not in ("\u0085", "\u2028", "\u00a0"))


def test_rules_messy(messy):
    got = line_rules.apply_rules(messy).collect()
    assert len(got) == len(MESSY) and all(r.n_words == len(words(r.text)) for r in got)
    assert all(r.base_failed and not r.kept for r in got if not r.text)
    assert line_rules.apply_rules(messy.limit(0)).count() == 0


# chat


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("<|[]/\\sINTY>a", max_size=60) | st.lists(st.sampled_from(["</s>", "[INST]", "<|end|>", "<<SYS>>", "\\", "<", "<\\", "[\\/INST]", "|end|>"]), max_size=8).map("".join))
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not re.search(r"<\|\w+\|>|</?s>|\[/?INST\]", chat.escape(text), re.ASCII)


def test_chat_digests(spark):
    got = {r.conv_id: r for r in queries.op9_chat_format(spark, SF).collect()}
    turns = spark.read.parquet(f"{SF}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    assert set(got) == {-1, *turns.conv_id}
    for conv, g in turns.groupby("conv_id"):
        loss = "".join(g.text[g.role == "assistant"])
        whole = "".join(f"{r}\n{t}\n" for r, t in zip(g.role, g.text, strict=True))
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(g), len(loss))
        marked = "".join(f"<|turn|>{chat.escape(r)}<|content|>{chat.escape(t)}<|end|>" for r, t in zip(g.role, g.text, strict=True))
        assert r.formatted_chars == len(marked)
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    bad = "</s>[INST] ok [/INST]"
    assert got[-1].loss_sha256 == hashlib.sha256(bad.encode()).hexdigest()
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{bad}\nassistant\n{bad}\n".encode()).hexdigest()


def test_chat_messy(spark):
    rows = [(1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (1, None, None, "<|end|>", "x"), (None, 1, "assistant", LONG, "x"), (2, 5, "assistant", "", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_turns(turns, queries.VOCABULARY)
    assert all(len(r.token_ids) == len(r.loss_mask) for r in made.collect())
    own = bpe.codec(open(queries.VOCABULARY).read(), chat.RESERVED)
    for r in made.collect():
        role, text, learned, whole = chat.read_back(np.array(r.token_ids), np.array(r.loss_mask), own)
        assert (role, text, whole) == (r.role or "", r.text or "", r.formatted) and learned == (text if role == "assistant" else "")
    got = {r.conv_id: r for r in chat.digest(turns, queries.VOCABULARY).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"\n<|end|>\nuser\n\nuser\n\n").hexdigest() and got[None].loss_chars == len(LONG) and got[2].n_turns == 1
    assert chat.digest(turns.limit(0), queries.VOCABULARY).count() == chat.format_turns(turns.limit(0), queries.VOCABULARY).count() == 0


# pipeline


def plain_passes(rows):
    """How often the mix takes each (id, source, text): a plain version of the mixing stage."""
    size = [len(words(t)) for _, _, t in rows]
    key = lambda s: (s is None, s or "")
    sources = sorted({s for _, s, _ in rows}, key=key)
    whole = {s: sum(n for n, r in zip(size, rows, strict=True) if r[1] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, rest, free = dict.fromkeys(sources, 0.0), float(sum(size)), {s for s in sources if whole[s]}
    while rest > 1e-9 and free:
        shares = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        rest = 0.0
        for s, x in shares.items():
            target[s] += x
            if target[s] >= 3 * whole[s]:
                rest, target[s] = rest + target[s] - 3 * whole[s], 3.0 * whole[s]
                free.discard(s)
    taken = collections.Counter()
    for s in sources:
        stream = sorted((hashlib.md5(f"mix:{'' if i is None else i}:{n}".encode()).hexdigest(), n, i) for n, (i, src, _) in zip(size, rows, strict=True) if src == s)
        left = round(target[s])
        for _ in range(3):
            for _, n, i in stream:
                if left > 0 and n:
                    taken[i] += 1
                left -= n
    return taken


def test_pipeline(spark, docs, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    found = stages["language ID"](spark, rows, SF).toPandas()
    assert set(docs.doc_id[docs.text.str.contains(r"[^\W\d_]")]) == set(found.doc_id)
    assert (found.merge(docs, on="doc_id").eval("lang_x == lang_y")).mean() > 0.97
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")
    kept = {r.doc_id for r in stages["quality classifier"](spark, rows, SF).collect()}
    assert kept <= set(docs.doc_id) and len(kept) > 0.8 * len(docs)
    good = labels.index[(labels.quality == 1) & (labels.toxic == 0)]
    assert np.mean([i in kept for i in good]) > 0.95 and np.mean([i in kept for i in labels.index[labels.quality == 0]]) < 0.5
    assert sorted((False, r.doc_id) for r in stages["SimHash near-dedup"](spark, rows, SF).collect()) == one_of_each(list(zip(docs.doc_id, docs.text, strict=True)))
    assert collections.Counter(r.doc_id for r in stages["mixing sources"](spark, rows, SF).collect()) == plain_passes(list(zip(docs.doc_id, docs.source, docs.text, strict=True)))
    out = corpus_pipeline.run(spark, SF).collect()
    text = dict(zip(docs.doc_id, docs.text, strict=True))
    assert out and all(r.token_ids == library.encode(text[r.doc_id], add_special_tokens=False).ids for r in out)
    for stage in list(stages.values())[:-1]:
        assert stage(spark, rows, SF).columns == rows.columns and stage(spark, rows.limit(0), SF).count() == 0


def test_pipeline_clashing_columns(spark):
    """Columns named as those of the steps come through every stage as they are."""
    names = ("_batch", "size", "mix_pass", "score", "lang_pred", "_row", "_size", "passes", "words", "row", "a.b", "target", "_text", "kept")
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id <= 60")
    rows = rows.select("*", *(F.concat(F.lit(f"{n} of "), F.col("doc_id")).alias(n) for n in names)).unionByName(rows.limit(0), allowMissingColumns=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, rows, SF)
        assert got.columns == rows.columns, name
        some = got.collect()
        assert some and all(r[n] == f"{n} of {r.doc_id}" for r in some for n in names), name


def test_pipeline_rows_without_ids(spark):
    """The quality stage judges such rows one by one."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").drop("doc_id").limit(40).withColumn("doc_id", F.lit(None).cast("long"))
    bad = rows.limit(1).withColumn("text", F.lit("zq | xv | 0931 | #### | wk | " * 60))
    mixed = spark.read.parquet(f"{SF}/documents.parquet").unionByName(rows).unionByName(bad)
    got = corpus_pipeline.quality(spark, mixed, SF).where("doc_id IS NULL").collect()
    assert 20 < len(got) <= 40 and not any("#### | wk" in r.text for r in got)
