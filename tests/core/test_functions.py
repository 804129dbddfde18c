"""Expressions and tokenizers against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from loomtrace.functions import jsons as j
from loomtrace.functions import scores
from loomtrace.functions import text as t
from loomtrace.functions.tokens import Porter, hybrid_tokens, search_terms, short_stem, terms, tokenize


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", expr(F.col("v")).alias("o"))
    return [r.o for r in sorted(rows.collect())]


def cut(s, n):
    b = s.encode()
    if len(b) <= n:
        return s
    while n and b[n] & 0xC0 == 0x80:
        n -= 1
    return b[:n].decode() + "..."


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 10])
def test_cut_bytes(spark, n):
    r = random.Random(n)
    values = ["", "a", "hello", "日本語テキスト", "é" * 9] + ["".join(r.choices("aé日😀", k=r.randrange(8))) for _ in range(60)]
    assert column(spark, values, lambda c: t.cut_bytes(c, n)) == [cut(v, n) for v in values]


def test_preview(spark):
    assert column(spark, ["  1→a\n 22→  b\tc", "\x1b[31mred\x1b[0m", "x" * 300, "a  b\n\n"], t.preview) == ["a b c", "[31mred[0m", "x" * 200 + "...", "a b"]


def test_code_and_errors(spark):
    assert column(spark, ["use `x`", "```", "const a", "constant", "class of", "plain", None], t.has_code) == [True, True, True, False, True, False, False]
    assert column(spark, ["Terror", "it FAILED", "null is not", "fine", None], t.has_error) == [True, True, True, False, False]


def test_elide(spark):
    rows = spark.createDataFrame([("u" * 301, "user", False), ("é" * 200, "assistant", False), ("é" * 201, "assistant", False), ("e" * 801, "user", True)], "v string, role string, e boolean")
    got = [r[0] for r in rows.select(t.elide(F.col("v"), F.col("role"), F.col("e"))).collect()]
    assert got == ["u" * 150 + "...[1 chars omitted]..." + "u" * 150, "é" * 200, "é" * 200 + "...[-398 chars omitted]..." + "é" * 200, "e" * 400 + "...[1 chars omitted]..." + "e" * 400]


def test_estimates(spark):
    assert column(spark, [0, 1, 200, 799, 800, 10**9], t.token_estimate, "bigint") == [33, 33, 100, 299, 300, 300]
    assert column(spark, [0, 200, 240, 10_000], t.target_markers, "bigint") == [5, 5, 6, 20]


def test_titles(spark):
    assert column(spark, ['  "Fix it"  ', "'quoted'", "## Heading ", "word " * 20, "x" * 70], t.clean_title) == ["Fix it", "quoted", "Heading", "word word word word word word word word word word word...", "x" * 57 + "..."]


def test_names(spark):
    assert column(spark, ["Pattern", " fact ", "spec", "idea", None], t.memory_type) == ["fact", "fact", "context", None, None]
    assert column(spark, ["claude_code", "openclaw", "cursor", "mine"], t.tool_display) == ["Claude Code", "OpenClaw", "Cursor", "mine"]
    assert column(spark, ["-", "-tmp", "-TMP-x", "-private-tmp-a", "-var-folders-zz", "-home-me-tmp", "-tmpx"], t.is_temp_folder) == [True, True, True, True, True, False, False]
    assert column(spark, ["/home/me/app"], t.dash_folder) == ["-home-me-app"]
    assert column(spark, ["12345678-1234-1234-1234-123456789012", "x" * 36, "short"], t.looks_like_uuid) == [True, False, False]
    assert column(spark, ["[Mon 2026-02-16 01:47 UTC] hi", "[note] hi"], t.without_time_prefix) == ["hi", "[note] hi"]


def test_strict_json(spark):
    v = '{"i": 5, "s": "5", "b": true, "n": null, "f": 1.5, "a": ["x", 1], "o": {"k": "v"}}'
    rows = spark.createDataFrame([(v,)], "v string").withColumn("v", j.parsed(F.col("v")))
    c = F.col("v")
    got = rows.select(j.whole(c, "$.i"), j.whole(c, "$.s"), j.whole(c, "$.f"), j.text(c, "$.s"), j.text(c, "$.i"), j.flag(c, "$.b"), j.present(c, "$.n"), j.present(c, "$.z"), j.text(c, "$.n"), j.text(c, "$.o.k"), F.size(j.items(c, "$.a")), j.items(c, "$.o")).first()
    assert list(got) == [5, None, None, "5", None, True, True, False, None, "v", 2, None]
    assert column(spark, ['["a","b"]', "oops", None], j.string_list) == [["a", "b"], [], []]


def test_hybrid_tokens(spark):
    cases = {
        "UTF-8 boundary panic in Rust": ["utf", "boundary", "panic", "in", "rust"], "数据库连接池": ["数据", "据库", "库连", "连接", "接池"], "错": ["错"], "用Rust写": ["用", "rust", "写"],
        "a b é": ["é"], "snake_case x1": ["snake", "case", "x1"], "": [], "カタカナ語": ["カタ", "タカ", "カナ", "ナ語"],
    }
    for text, want in cases.items():
        assert hybrid_tokens(text) == want, text
    assert column(spark, [*cases, None], tokenize) == [*cases.values(), []]
    assert [short_stem(w) for w in ("reviewing", "reviews", "requests", "changes", "configured", "sing", "getting", "quickly", "bus", "ting")] == ["review", "review", "request", "chang", "configur", "sing", "gett", "quick", "bus", "ting"]


def test_porter_examples():
    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit valenci valenc digitizer digit radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll".split()
    for word, stem in zip(pairs[::2], pairs[1::2]):
        assert Porter.stem(word) == stem, word


def test_search_terms(spark):
    assert search_terms("Café-Running, the RUNS_of 2nd") == ["cafe", "run", "the", "run", "of", "2nd"]
    assert column(spark, ["Runs running", None], terms) == [["run", "run"], []]


def test_jaccard_and_cosine(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b", "a"]), (["a"], ["b"]), ([], []), ([], ["a"]), (["a", "b", "c"], ["b", "c", "d"])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(scores.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1.0, 0.0, 0.5]
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([], [])], "a array<float>, b array<float>")
    assert [r[0] for r in rows.select(scores.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_project_name_on_disk():
    there = {"/home", "/home/me", "/home/me/app"}
    name = lambda f: t.project_name_on_disk(f, there.__contains__)
    assert [name(x) for x in ("-home-me-app", "-home-me-my-tool", "-gone-away-x", "plain", "-")] == ["app", "my-tool", "x", "plain", "-"]


def test_counts_of_leaves_stem_only_what_can_match(spark, monkeypatch):
    from loomtrace.functions import tokens

    seen = []
    monkeypatch.setattr(tokens, "known_stem", lambda w: seen.append(w) or tokens.Porter.stem(w))
    run = tokens.leaf_counts([(["licens"], False), (["under", "th"], True)])
    counts = run.func.__closure__[0].cell_contents
    assert counts("Under the licence: LICENSED, licensing under  that; zebra, under") == [9, 2, 2] and "zebra" not in seen
    assert counts(None) == [0, 0, 0]


def test_postings_need_no_shuffle(spark):
    from loomtrace.operators import search

    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "b")], "id bigint, text string")
    index = search.postings(docs, "id", "text")
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.term, r.positions, r.n_terms) for r in index.collect()) == [(1, "a", [0, 2], 3), (1, "b", [1], 3), (3, "b", [0], 1)]


def test_token_sets_and_places_learn_a_word_once(spark, monkeypatch):
    import zlib

    from loomtrace.functions import tokens
    from loomtrace.operators import vectors

    cases = ["Testing tests TESTED, and the the Cats 日本語の cats ab é", "日", "x", "", "Ünïted things things", "a b cc cc"]
    assert [tokens.distinct_tokens(x) for x in cases] == [sorted(set(hybrid_tokens(x))) for x in cases]
    assert column(spark, [*cases, None], tokens.token_set) == [*(sorted(set(hybrid_tokens(x))) for x in cases), []]
    calls, real = [], zlib.crc32
    monkeypatch.setattr(zlib, "crc32", lambda b: calls.append(b) or real(b))
    got = vectors.hashed_embedder(8)(["cat cat dog", "dog bird", ""])
    assert sorted(calls) == [b"bird", b"cat", b"dog"]
    for row, words in zip(got, (["cat", "cat", "dog"], ["dog", "bird"], [])):
        own = [0.0] * 8
        for w in words:
            h = real(w.encode())
            own[h % 8] += 1 if h & 1 << 31 else -1
        norm = sum(x * x for x in own) ** 0.5
        assert row.tolist() == pytest.approx([x / norm if norm else 0.0 for x in own])
