"""Operators 11 to 13 against plain versions of themselves, and on difficult rows."""

import collections
import hashlib
import heapq
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm import align, divergence, queries, token_files
from larkspur.llm.bpe import byte_alphabet

SF = "/root/testdata/sf0.001"
ODD = [
    "", None, " ", "   ", "a", " a", "a ", "a  b", "a \n b\t c", "\n\n x", "don't We'LL 'reborn", "x\x00y\x1fz\x0b w", "é ́a", "▁", "a▁ b",
    "日本語 テキスト 😀😀 ❤️", "word,word;(word)--word...\n\nNext", "İstanbul Σίσυφος ΣΑΣ ŉ ſ ß Ⅷ ² ½ ª µ ×÷", "<|endoftext|>", "x<|startoftext|>y <s></s>", "ﬁ ① ｆｕｌｌ", "a b c 　 d\x85 e",
    " " * 500, "ab" * 3000, "1234567890" * 50, "=" * 300 + " " + "-" * 300, "%$#@!" * 80, "Ünïcödé ÀÉÎ école naïve", "ẛ̣ Å Ω", "tab\tsep\r\nline", "é" * 400,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, x) for k, x in enumerate(ODD)] + [(None, "no id here"), (7, "the same id, the same id"), (7, "the same id, the same id"), (8, "the cat, the dog and the cat.")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("n_a", "chunks", "row", "pair", "part", "id", "ids", "n", "term", "count")})


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain_alignment(rows):
    a = Tokenizer.from_file(queries.VOCABULARY)
    a.encode_special_tokens = True
    a.no_truncation()
    b = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    of = byte_alphabet()
    a_bytes = lambda i: bytes(of[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, held, out = [], collections.Counter(), []
    for key, text in rows:
        groups, raw = [], (" " + (text or "")).encode()
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if text and b"".join(map(a_bytes, x)) == raw == b"".join(map(b_bytes, y)):
            i = j = at_a = at_b = 0
            own = ([], [])
            while i < len(x) or j < len(y):
                if at_a <= at_b:
                    own[0].append(x[i])
                    at_a, i = at_a + len(a_bytes(x[i])), i + 1
                else:
                    own[1].append(y[j])
                    at_b, j = at_b + len(b_bytes(y[j])), j + 1
                if at_a == at_b and all(own):
                    groups.append(own)
                    own = ([], [])
        links = collections.Counter((p, q) for g in groups for p in g[0] for q in g[1])
        docs.append((key, groups, links))
        held.update(links.keys())
    best = collections.Counter()
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    for key, groups, links in docs:
        text = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
        sums = sum(n for k, n in links.items() if held[k] == best[k[0]]), sum(n * held[k] for k, n in links.items())
        counts = sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values())
        out.append((key, *counts, *sums, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [align.HEAVY, 40, 0])
def test_alignment_of_odd_texts(docs, most):
    """However many pairs are broadcast."""
    got = rows_of(align.link_tokens(docs, queries.VOCABULARY, queries.PIECES, most=most))
    assert got == plain_alignment([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_alignment_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(align, "ROW_CHARS", 50_000)
    got = rows_of(queries.op11_token_alignment(spark, SF))
    assert got == plain_alignment([tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])


def test_texts_of_a_row_in_parts(docs, monkeypatch):
    """However few chunks are looked at together, below the longest text as well."""
    want = plain_alignment([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    monkeypatch.setattr(align, "AT_ONCE", 5)
    assert rows_of(align.link_tokens(docs, queries.VOCABULARY, queries.PIECES)) == want


def test_written_groups_tell_their_numbers():
    """So that only they go to the rows: tokens under A and B, groups and links, of slices and of chunks without any as well."""
    written = pa.array([b"0|0", b"1,22|3;4|5,6,7", b"", b"8,9|10,11;12|13;14,15,16|17", b""], pa.binary())
    want = [(1, 1, 1, 1), (3, 4, 2, 5), (0, 0, 0, 0), (6, 4, 3, 8), (0, 0, 0, 0)]
    for i, j in ((0, 5), (1, 4), (2, 3), (3, 5), (4, 4)):
        assert list(zip(*(x.tolist() for x in align.numbers_of(written[i:j])), strict=True)) == want[i:j]


def test_chunks_are_aligned_once(spark, monkeypatch):
    """However many rows of texts hold them."""
    real, made = align.align, []
    monkeypatch.setattr(align, "ROW_CHARS", 10)
    monkeypatch.setattr(align, "align", lambda *args, **more: made.append(real(*args, **more)) or made[0])
    rows = [(k, "the cat, the dog") for k in range(40)]
    assert rows_of(align.link_tokens(spark.createDataFrame(rows, "doc_id long, text string"), queries.VOCABULARY, queries.PIECES)) == plain_alignment(rows)
    assert made[0].count() == 4


def test_alignment_of_no_rows(docs):
    assert align.link_tokens(docs.where("false"), queries.VOCABULARY, queries.PIECES).collect() == []


def test_ids_repeated_in_a_group_are_counted(spark):
    """A run without a common end inside: its pairs are named once, with their number."""
    df = spark.createDataFrame([([5, 5, 6], [9, 9, 9, 8])], "a array<int>, b array<int>")
    got = df.select(align.pairs(align.tally(F.col("a")), align.tally(F.col("b"))).alias("p")).first().p
    assert {(x.pair >> 32, x.pair & 0xFFFFFFFF, x.n) for x in got} == {(5, 9, 6), (5, 8, 2), (6, 9, 3), (6, 8, 1)}


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_chunks_have_the_tokens_of_the_whole(text):
    own = align.tokenisers(open(queries.VOCABULARY, encoding="utf-8").read(), open(queries.PIECES, "rb").read())
    (found,) = own.chunks([text])
    a, b = ([int(x) for k in found for x in ids[first[k] : first[k] + counts[k]]] for ids, _, first, counts in own.flat)
    if text:
        assert a == own.a.encode_ordinary(" " + text)
        assert b == own.b.encode(text) or "▁" in text


def plain_audit(rows, min_docs, top):
    counts, of_lang, held = collections.Counter(), collections.Counter(), collections.Counter()
    groups = set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        held.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    kept = collections.defaultdict(list)
    for (lang, t), n in held.items():
        if n >= min_docs:
            kept[lang].append(t)
    out = []
    share = lambda n, total, v: 1 + 10**9 * (n + 2) // (total + 2 * v)
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    for (lang, s, t), n in counts.items():
        of_lang[lang, t] += n
    for lang, s in groups:
        terms = kept[lang]
        size = lambda x: sum(counts[lang, x, t] for t in terms)  # noqa: B023, E731
        sources = [x for k, x in groups if k == lang and x != s]
        p = {t: share(counts[lang, s, t], size(s), len(terms)) for t in terms}
        pairs = [(x, sum(apart(p[t], share(counts[lang, x, t], size(x), len(terms))) for t in terms)) for x in sources]
        q = {t: share(of_lang[lang, t], sum(of_lang[lang, u] for u in terms), len(terms)) for t in terms}
        own = [(t, apart(p[t], q[t])) for t in terms if counts[lang, s, t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", own, top)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out, key=repr)


AUDIT = [
    ("The cat AND the dog", "en", "a"), ("the dog, the dog", "en", "b"), ("a bird", "en", None), ("a bird", "en", ""), (None, "en", "c"), ("", "en", "c"), ("über Éa É é", None, "a"),
    ("über", "", "b"), ("lonely", "de", "a"), ("the the the\x00the~cat", "en", "a"), ("日本 日本 x", "en", "b"), ("12 34 !!", "it", "a"), ("56", "it", "b"), ("cat dog bird", "en", "a"), ("cat dog bird", "en", "a"),
]


@pytest.mark.parametrize("min_docs", [1, 2, 99])
def test_audit(spark, min_docs):
    df = spark.createDataFrame(AUDIT, "text string, lang string, source string").withColumns({c: F.lit(1) for c in ("term", "n", "v", "size", "vector", "terms", "item", "value")})
    assert rows_of(divergence.audit(df, min_docs=min_docs, top=3)) == plain_audit(AUDIT, min_docs, 3)
    assert divergence.audit(df.where("false")).collect() == []


def test_audit_of_large_counts(spark):
    """Counts of a corpus of 10^13 terms go through the same expressions without a loss."""
    kept = spark.createDataFrame([("en", "t", [("a", 7 * 10**12), ("b", 10**12)], 8 * 10**12), ("en", "u", [("b", 3)], 3)], "lang string, term string, vector array<struct<source string, n long>>, total long")
    groups = divergence.sizes(spark.createDataFrame([("en", "a"), ("en", "b")], "lang string, source string"), kept)
    got = {(r.source, r.item): r.value for r in divergence.pair_values(kept.groupBy("lang", "vector").agg(F.count("*").alias("terms")), groups).collect()}
    p = [1 + 10**9 * (n + 2) // (7 * 10**12 + 4) for n in (7 * 10**12, 0)]
    q = [1 + 10**9 * (n + 2) // (10**12 + 3 + 4) for n in (10**12, 3)]
    want = sum((x - y) ** 2 // (x + y) for x, y in zip(p, q, strict=True))
    assert got == {("a", "b"): want, ("b", "a"): want}


def test_audit_of_the_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.op12_source_divergence(spark, SF)
    want = con.execute(divergence.ORACLE_SQL).df()[got.columns]
    assert rows_of(got) == sorted(map(tuple, want.itertuples(index=False)), key=repr)


def plain_files(rows):
    own = Tokenizer.from_file(queries.WORDS)
    own.no_truncation()
    own.no_padding()
    out, start = [], 0
    coded = [(key, np.array([*own.encode(text or "", add_special_tokens=False).ids, 1])) for key, text in rows]
    for key, ids in sorted(coded, key=lambda x: (x[0] is None, x[0], x[1].astype("<u2").tobytes())):
        out.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1, 200, token_files.BLOCK])
def test_token_files(spark, docs, block, monkeypatch):
    monkeypatch.setattr(token_files, "PART", 700)
    at = token_files.folder(spark)
    token_files.write(docs, queries.WORDS, at, block=block)
    got = token_files.read(spark, at, digest=True)
    assert rows_of(got.drop("token_ids")) == plain_files([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    for r in got.collect():
        assert zlib.crc32(np.array(r.token_ids, "<u4").tobytes()) == r.ids_crc32 and len(r.token_ids) == r.n_tokens


def test_token_files_of_the_table(spark):
    got = queries.op13_token_files(spark, SF)
    assert rows_of(got) == plain_files([tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])


def test_token_files_of_no_rows(spark, docs):
    at = token_files.folder(spark)
    token_files.write(docs.where("false"), queries.WORDS, at)
    assert token_files.read(spark, at, digest=True).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_words_have_the_ids_of_the_whole(text):
    own = token_files.words(open(queries.WORDS, encoding="utf-8").read())
    ids, n = own.encode(["", text, None], 1)
    assert n.tolist() == [1, len(ids) - 2, 1] and ids.tolist()[1:-1] == [*own.whole.encode(text, add_special_tokens=False).ids, 1]


def huffman_cost(counts):
    """Bits of a Huffman code without a limit."""
    heap, cost = sorted(counts), 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=2, max_size=60))
def test_code_lengths(counts):
    counts = np.array(counts)
    used = counts > 0
    lengths = token_files.code_lengths(counts, 24).astype(int)
    assert ((lengths > 0) == used).all()
    if used.sum() > 1:
        assert (0.5 ** lengths[used]).sum() == 1
        if lengths.max() < 24:
            assert (lengths * counts).sum() == huffman_cost(counts[used].tolist())
    tight = token_files.code_lengths(counts, 6).astype(int)
    assert tight.max(initial=0) <= 6 and (0.5 ** tight[used]).sum() <= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=700), st.sampled_from([1, 3, 256]))
def test_blocks_come_back(ids, step):
    ids = np.array(ids, np.int64)
    lengths = token_files.code_lengths(np.bincount(ids, minlength=41) * np.arange(1, 42) ** 3, 12)
    own = token_files.Code(lengths)
    assert (own.decode(own.encode(ids, step)) == ids).all()
    if len(ids):
        with pytest.raises(ValueError):
            own.decode(own.encode(ids, step)[:-1])
