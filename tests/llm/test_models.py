"""Trained operators: held-out accuracy, and the parts that have an exact answer."""

import random
import re
from collections import Counter
from math import comb, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.llm import licenses, quality_gam, quality_rules, toxicity
from loomtrace.llm.common import WordIds, fold

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def rude(make, spark, vocabulary):
    """Documents of which some hold one of a few rude words or a phrase of two with another word between."""
    r = random.Random(8)
    bad = ["nasty", "rotten", "vile"]
    rows, labels = [], []
    for i in range(900):
        w = r.choices(vocabulary, k=r.randint(5, 120))
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(bad) + r.choice(["", ",", "!"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return make(rows), spark.createDataFrame(labels, LABELS), dict((i, t) for i, _, t in labels)


def test_toxicity_held_out(rude):
    docs, labels, truth = rude
    held = fold(F.col("doc_id"), 4) == 2
    model = toxicity.train(docs, labels, "toxic", ~held)
    rows = toxicity.score(docs, model).withColumn("held", held).collect()
    hit = Counter((truth[r.doc_id], r.score >= 0.3) for r in rows if r.held)
    assert hit[1, True] / (hit[1, True] + hit[1, False]) > 0.9
    assert hit[0, True] <= 0.02 * hit[0, False]
    assert all(0 <= r.score <= 1 for r in rows)
    kept = {r.doc_id for r in toxicity.keep_clean(docs, model, 0.3).collect()}
    assert kept == {r.doc_id for r in rows if r.score < 0.3}


def test_toxicity_is_sparse_and_repeatable(rude):
    docs, labels, _ = rude
    a, b = (toxicity.train(docs.repartition(n), labels, "toxic", F.lit(True)) for n in (1, 5))
    assert 0 < len(a.index) < 2000
    assert a.bias == b.bias and (a.weight == b.weight).all() and (a.index == b.index).all()


def test_toxicity_features_by_hand():
    ids = WordIds()
    n = len(toxicity.features(b"One, two three", ids))
    assert n == 3 + 2 + 1 + 1
    assert set(toxicity.features(b"ONE two", ids)) == set(toxicity.features(b"one... two!", ids))
    assert len(toxicity.features(b"", ids)) == 0


def test_toxicity_odd_rows(odd, spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 1, 0), (None, 1, 1), (5, None, None), (99, 1, 1)], LABELS)
    model = toxicity.train(odd, labels, "toxic", F.lit(True))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 10
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    none = toxicity.train(odd, labels.limit(0), "toxic", F.lit(True))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}
    assert toxicity.keep_clean(odd, none, 0.3).count() == 10
    assert toxicity.keep_clean(odd, model, 0.3).columns == odd.columns
    assert toxicity.score(odd.limit(0), model).collect() == []


def brute_features(text):
    """The set of features as tuples, unhashed."""
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    out = {("one", x) for x in w} | {("two", a, b) for a, b in zip(w, w[1:])} | {("skip", a, b) for a, b in zip(w, w[2:])}
    return out | {("head", k, x.encode()[:k]) for k in (4, 6) for x in w if len(x.encode()) > k}


def brute_ftrl(rows, labels, f):
    """FTRL-proximal by its definition, a coordinate at a time; a function that scores a text."""
    seen = Counter(x for r in rows for x in r)
    rows = [{x for x in r if seen[x] >= f.min_docs} | {"bias"} for r in rows]
    z, n = Counter(), Counter()

    def weight(x):
        l1 = 0.0 if x == "bias" else f.l1
        return 0.0 if abs(z[x]) <= l1 else -(z[x] - (l1 if z[x] > 0 else -l1)) / ((f.beta + n[x] ** 0.5) / f.alpha + f.l2)

    order = np.arange(len(rows))
    for epoch in range(f.epochs):
        np.random.default_rng(epoch).shuffle(order)
        for i in order.tolist():
            w = {x: weight(x) for x in rows[i]}
            g = 1 / (1 + np.exp(-sum(w.values()))) - labels[i]
            for x in rows[i]:
                sigma = ((n[x] + g * g) ** 0.5 - n[x] ** 0.5) / f.alpha
                z[x] += g - sigma * w[x]
                n[x] += g * g
    return lambda text: 1 / (1 + np.exp(-weight("bias") - sum(weight(x) for x in brute_features(text) if x in z)))


def test_toxicity_matches_brute_force(make, spark, vocabulary):
    """Learned and scored by definition over unhashed features, with texts that hold no word, a long one and repeated ids."""
    r = random.Random(17)
    few = vocabulary[:40] + ["nasty", "vile"]
    rows = [(i, " ".join(r.choices(few, k=r.randint(0, 14)))) for i in range(90)] + [(900, ""), (901, None), (902, "Ünïcode ROTTEN, vile!"), (903, "a b c " * 5000), (7, "zzz"), (7, "yyy")]
    marks = [(i, 1, int("nasty" in t or "vile" in t)) for i, t in rows[:80]] + [(901, 1, 0), (902, 1, 1), (903, 1, 0)]
    docs, labels, ftrl = make(rows), spark.createDataFrame(marks, LABELS), toxicity.Ftrl(l1=0.3, min_docs=2, bits=22)
    model = toxicity.train(docs, labels, "toxic", F.lit(True), ftrl=ftrl)
    chosen = docs.join(labels.select("doc_id", "toxic"), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).alias("text"))
    own = chosen.select(F.xxhash64("doc_id").alias("place"), "toxic", "text").orderBy("place").collect()
    scorer = brute_ftrl([brute_features(x.text) for x in own], [x.toxic for x in own], ftrl)
    want = Counter((i, round(scorer(t), 9)) for i, t in rows)
    assert Counter((x.doc_id, round(x.score, 9)) for x in toxicity.score(docs, model, ftrl.bits).collect()) == want
    assert len({s for _, s in want}) > 20


def test_toxicity_takes_rows_up_to_a_number_of_features(make, spark, monkeypatch):
    """Rows in order of their hashed ids, the first that fills the task the last."""
    texts = {i: ("vile " if i % 2 else "") + " ".join(f"w{k % 7}" for k in range(3 + i)) for i in range(40)}
    docs = make(list(texts.items()))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], LABELS)
    order, total, taken = [x.doc_id for x in labels.orderBy(F.xxhash64("doc_id")).collect()], 0, []
    for i in order:
        if total < 200:
            taken.append(i)
            total += len(np.unique(toxicity.features(texts[i].encode(), WordIds())))
    assert 3 < len(taken) < 30
    want = toxicity.train(docs, labels.where(F.col("doc_id").isin(taken)), "toxic", F.lit(True), ftrl=toxicity.Ftrl(l1=0.1))
    monkeypatch.setattr(toxicity, "MAX_FEATURES", 200)
    got = toxicity.train(docs, labels, "toxic", F.lit(True), ftrl=toxicity.Ftrl(l1=0.1))
    assert got.bias == want.bias and (got.weight == want.weight).all()


def test_gam_learns_curves_and_a_pair():
    r = np.random.default_rng(3)
    x = r.random((4000, 4))
    y = ((np.abs(x[:, 0] - 0.5) < 0.25) ^ ((x[:, 1] > 0.5) & (x[:, 2] > 0.5))).astype(float)
    gam = quality_gam.Boosting().learn(x[:3000], y[:3000])
    s = gam.score(x[3000:])
    assert ((s >= 0.5) == y[3000:]).mean() > 0.85
    assert (1, 2) in gam.pairs
    # A score is the sum of its table entries.
    one = gam.intercept + sum(t[np.searchsorted(e, x[3000, k], side="right")] for k, (e, t) in enumerate(zip(gam.edges, gam.tables, strict=True)))
    for (i, j), grid in gam.pairs.items():
        at = [gam.coarse[k][np.searchsorted(gam.edges[k], x[3000, k], side="right")] for k in (i, j)]
        one += grid[at[0], at[1]]
    assert s[0] == pytest.approx(1 / (1 + np.exp(-one)))


def brute_gam(x, y, s):
    """Cyclic boosting by its definition: every candidate cut is tried on the rows themselves. Returns a function that scores a row."""
    d = x.shape[1]
    edges = [sorted(set(np.quantile(x[:, k], np.linspace(0, 1, s.bins + 1)[1:-1]))) for k in range(d)]
    place = lambda k, v: sum(e <= v for e in edges[k])
    bins = [[place(k, v) for v in x[:, k]] for k in range(d)]
    size = [len(e) + 1 for e in edges]
    rate = y.mean()
    logit = np.full(len(y), log(rate / (1 - rate)))
    tables = [[0.0] * n for n in size]

    def leaf(g, h):
        return g / (h + s.smooth)

    def value(g, h):
        return g * g / (h + s.smooth)

    def tree(g, h, depth):
        """g, h: sums by bin."""
        best = (0.0, None)
        for at in range(1, len(g)) if depth else ():
            left, right = (sum(g[:at]), sum(h[:at])), (sum(g[at:]), sum(h[at:]))
            if min(left[1], right[1]) >= s.least:
                gain = value(*left) + value(*right) - value(sum(g), sum(h))
                if gain > best[0]:
                    best = (gain, at)
        at = best[1]
        return [leaf(sum(g), sum(h))] * len(g) if at is None else tree(g[:at], h[:at], depth - 1) + tree(g[at:], h[at:], depth - 1)

    for _ in range(s.rounds):
        for k in range(d):
            p = 1 / (1 + np.exp(-logit))
            g, h = [0.0] * size[k], [0.0] * size[k]
            for b, r, w in zip(bins[k], y - p, np.maximum(p * (1 - p), 1e-6)):
                g[b] += r
                h[b] += w
            step = [s.rate * v for v in tree(g, h, s.depth)]
            tables[k] = [a + b for a, b in zip(tables[k], step)]
            logit = logit + np.array([step[b] for b in bins[k]])
    return lambda row: 1 / (1 + np.exp(-log(rate / (1 - rate)) - sum(tables[k][place(k, row[k])] for k in range(d))))


def test_gam_matches_brute_force(make, spark, vocabulary):
    """Tables learned by trying every cut, and every document of the query scored by adding entries one by one."""
    r = random.Random(15)
    rows = [(i, " ".join(x + r.choice(["", "", "#", "|"]) * (i % 3) for x in r.choices(vocabulary, k=r.randint(0, 60)))) for i in range(120)] + [(200, None), (201, "A B\nA B\nc1")]
    docs, marks = make(rows), spark.createDataFrame([(i, int(i % 3 < 2), 0) for i in range(120)], LABELS)
    s = quality_gam.Boosting(bins=6, rounds=8, n_pairs=0)
    gam = quality_gam.train(docs, marks, "quality", F.lit(True), boosting=s)
    x = np.array([quality_gam.features((t or "").encode()) for _, t in rows[:120]])
    scorer = brute_gam(x, np.array([float(i % 3 < 2) for i in range(120)]), s)
    got = {d.doc_id: d.score for d in quality_gam.score(docs, gam).collect()}
    assert all(got[i] == pytest.approx(scorer(quality_gam.features((t or "").encode())), abs=1e-9) for i, t in rows)
    assert len({round(v, 6) for v in got.values()}) > 20


def test_gam_scores_are_sums_of_entries(make, spark, vocabulary):
    """With pairs, for every document, one entry at a time."""
    r = random.Random(16)
    rows = [(i, " ".join(x + ("#" if i % 2 and r.random() < 0.5 else "") for x in r.choices(vocabulary, k=r.randint(1, 90)))) for i in range(150)]
    docs, marks = make(rows), spark.createDataFrame([(i, int(i % 2 == 0 or len(rows[i][1]) > 300), 0) for i in range(150)], LABELS)
    gam = quality_gam.train(docs, marks, "quality", F.lit(True), boosting=quality_gam.Boosting(bins=8, rounds=20, pair_rounds=10))
    assert gam.pairs
    for d in quality_gam.score(docs, gam).collect():
        v = quality_gam.features(rows[d.doc_id][1].encode())
        at = [sum(e <= x for e in edges) for x, edges in zip(v, gam.edges)]
        total = gam.intercept + sum(t[b] for t, b in zip(gam.tables, at)) + sum(g[gam.coarse[i][at[i]]][gam.coarse[j][at[j]]] for (i, j), g in gam.pairs.items())
        assert d.score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)


def test_gam_held_out(make, spark, vocabulary):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        w, good = r.choices(vocabulary, k=r.randint(12, 90)), i % 4 > 0
        if not good:
            kind = r.randrange(3)
            w = [x + r.choice("#$%*") * 3 for x in w] if kind == 0 else [w[0]] * len(w) if kind == 1 else [x + " |" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(good), 0))
    docs, marks = make(rows), spark.createDataFrame(labels, LABELS)
    held = fold(F.col("doc_id"), 3) == 1
    gam = quality_gam.train(docs, marks, "quality", ~held)
    truth = {i: q for i, q, _ in labels}
    got = [(r.score >= 0.5) == truth[r.doc_id] for r in quality_gam.score(docs, gam).where(held).collect()]
    assert len(got) > 100 and sum(got) / len(got) > 0.97


def test_gam_odd_rows(odd, spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, 1, 0), (None, 1, 1), (6, None, None)], LABELS)
    gam = quality_gam.train(odd, labels, "quality", F.lit(True))
    rows = quality_gam.score(odd, gam).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    none = quality_gam.train(odd, labels.limit(0), "quality", F.lit(True))
    assert {r.score for r in quality_gam.score(odd, none).collect()} == {0.0}
    assert quality_gam.score(odd.limit(0), gam).collect() == []


def brute_measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), n < 10 or 100 * len(cover) > 20 * n)


def test_rule_measures_match_brute_force(make, vocabulary):
    r = random.Random(7)
    few = vocabulary[:5]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "a a a a a a a"), (4, "a b c d e a b c d e"), (5, "x\n\nx\nx \r\n y"), (6, "é ü #1 <b> $$")]
    rows += [(10 + i, "\n".join(" ".join(r.choices(few if i % 2 else vocabulary, k=r.randint(0, 14))) for _ in range(r.randint(1, 8)))) for i in range(80)]
    got = quality_rules.measures(make(rows), ["doc_id"]).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == {i: brute_measures(t) for i, t in rows}


def test_log_tail_is_the_binomial_tail(spark):
    cases = [(n, k, p) for n in (1, 7, 50, 2000) for k in (0, 1, 3) for p in (0.004, 0.1, 0.3) if k <= n]
    frame = spark.createDataFrame([(n, k) for n, k, _ in cases], "n bigint, k bigint").distinct()
    for p in (0.004, 0.1, 0.3):
        for r in frame.select("n", "k", quality_rules._log_tail(F.col("n"), F.col("k"), p).alias("t")).collect():
            want = sum(comb(r.n, j) * p**j * (1 - p) ** (r.n - j) for j in range(r.k + 1))
            assert r.t == pytest.approx(log(want), rel=1e-9, abs=1e-12) if want > 1e-290 else r.t < -600


@pytest.fixture(scope="module")
def judged(make, spark, vocabulary):
    """en: enough labels, junk has symbols; de: the same with too few labels."""
    r = random.Random(2)
    rows, labels = [], []
    for i in range(2600):
        w, bad = r.choices(vocabulary, k=20), i % 5 == 0
        rows.append((i, " ".join(x + "#" if bad else x for x in w), "de" if i % 26 == 0 else "en", "a"))
        labels.append((i, int(not bad), 0))
    return make(rows), spark.createDataFrame(labels, LABELS)


def test_rules_are_certified_where_labels_suffice(judged):
    docs, labels = judged
    out = quality_rules.apply_rules(docs, labels).collect()
    by = Counter((r.lang, r.doc_id % 5 == 0, r.kept) for r in out)
    assert by["en", False, False] == 0 and by["en", True, True] == 0
    assert by["de", True, False] == 0  # 100 labels certify nothing at this limit


def brute_cutoffs(rows, risk):
    """rows: of judged documents, with good and lang. All rules along the path, each stratum at its share of delta."""
    good = sum(r.good for r in rows)
    path = [(rule, j) for rule, (_, _, c) in quality_rules.RULES.items() for j in range(1, len(c) + 1)]

    def fails(r, rule, j):
        measure, sign, cutoffs = quality_rules.RULES[rule]
        a, b = measure.split(" / ")
        return j > 0 and (r[a] / r[b] if r[b] else 0.0) * sign > cutoffs[j - 1] * sign

    want = {}
    for lang in {r.lang for r in rows}:
        own = [r for r in rows if r.lang == lang]
        n, at = sum(r.good for r in own), dict.fromkeys(quality_rules.RULES, 0)
        for rule, j in path:
            k = sum(r.good and any(fails(r, x, j if x == rule else level) for x, level in at.items()) for r in own)
            if sum(comb(n, i) * risk.limit**i * (1 - risk.limit) ** (n - i) for i in range(k + 1)) > risk.delta * n / good or k >= n * risk.limit:
                break
            at[rule] = j
        for rule, most in at.items():
            gains = [(sum(not r.good and fails(r, rule, j) for r in own) - risk.cost * sum(r.good and fails(r, rule, j) for r in own), -j) for j in range(1, most + 1)]
            if gains and max(gains)[0] > 0:
                want[lang, rule] = -max(gains)[1]
    return want


@pytest.mark.parametrize("risk", [quality_rules.Risk(), quality_rules.Risk(0.05, 0.1, 1.0), quality_rules.Risk(0.3, 0.5, 0.5)])
def test_rules_hold_the_limit_by_brute_force(judged, risk):
    docs, labels = judged
    m = quality_rules.measures(docs, ["doc_id", "lang"]).join(labels.select("doc_id", (F.col("quality") == 1).alias("good")), "doc_id")
    got = {(r["stratum"], r["rule"]): r["level"] for r in quality_rules.cutoffs(m, "lang", risk).collect()}
    assert got == brute_cutoffs([r for r in m.collect() if not r.base_failed], risk) and got


def test_rules_in_use_on_the_given_tables(spark):
    """The cutoffs of sf0.01 by brute force: one stratum has labels enough there; sf0.1 certifies all."""
    for sf, strata in (("sf0.01", {"en"}), ("sf0.1", {"en", "de", "fr", "es"})):
        docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
        m = quality_rules.stored(quality_rules.measures(docs, ["doc_id", "lang"])).join(labels.select("doc_id", (F.col("quality") == 1).alias("good")), "doc_id")
        got = {(r["stratum"], r["rule"]): r["level"] for r in quality_rules.cutoffs(m, "lang").collect()}
        assert {s for s, _ in got} == strata
        if sf == "sf0.01":
            assert got == brute_cutoffs([r for r in m.collect() if not r.base_failed and r.lang is not None], quality_rules.Risk())


def test_rules_odd_rows(odd, spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 1, 1), (5, 1, 0), (None, 1, 1)], LABELS)
    out = quality_rules.apply_rules(odd, labels).collect()
    assert len(out) == 10
    assert all(r.kept == (not r.base_failed) for r in out)
    assert {r.doc_id for r in out if r.kept} == {5, 6}
    assert quality_rules.apply_rules(odd, labels.limit(0)).count() == 10
    assert quality_rules.apply_rules(odd.limit(0), labels).collect() == []


def test_licenses_found_and_confirmed(make, vocabulary):
    r = random.Random(3)
    rows, truth = [], {}
    for i in range(200):
        lines = [" ".join(r.choices(vocabulary, k=r.randint(3, 40))) for _ in range(r.randint(1, 5))]
        if i % 4 == 0:
            family = r.choice([f for f in licenses.TEMPLATES])
            lines.insert(r.randrange(len(lines) + 1), r.choice(licenses.TEMPLATES[family]))
            truth[i] = family
        elif i % 4 == 1:
            lines.append(r.choice(licenses.LOOKALIKES))
        rows.append((i, "\n".join(lines)))
    docs = make(rows)
    got = {x.doc_id: {h.family for h in x.hits if h.confirmed} for x in licenses.scan(docs, licenses.train(docs)).collect()}
    assert sum(truth[i] in got[i] for i in truth) >= 0.95 * len(truth)
    assert not any(got[i] for i in got if i not in truth)


def test_license_inside_a_long_line(make, vocabulary):
    r = random.Random(3)
    text = " ".join([*r.choices(vocabulary, k=500), "This work is licensed under the GNU General Public License, version 3.", *r.choices(vocabulary, k=500)])
    docs = make([(1, text), (2, " ".join(r.choices(vocabulary, k=1000)))])
    got = {x.doc_id: {h.family for h in x.hits if h.confirmed} for x in licenses.scan(docs, licenses.train(docs)).collect()}
    assert got == {1: {"GPL"}, 2: set()}


def test_several_families_in_a_line(make, vocabulary):
    """Far apart in a long line, and side by side within a piece."""
    r = random.Random(3)
    words = lambda n: " ".join(r.choices(vocabulary, k=n))
    rows = [
        (1, f"Released under the MIT License. {words(200)} Licensed under the Apache License, Version 2.0."),
        (2, f"{words(5)} Released under the MIT License. Licensed under the Apache License, Version 2.0. {words(9)}"),
        (3, f"{words(30)}\nAll rights reserved.\n{words(4)} all of the reserved rights {words(4)}"),
    ]
    docs = make(rows)
    got = {x.doc_id: {(h.line, h.family) for h in x.hits if h.confirmed} for x in licenses.scan(docs, licenses.train(docs)).collect()}
    assert got == {1: {(0, "MIT"), (0, "Apache-2.0")}, 2: {(0, "MIT"), (0, "Apache-2.0")}, 3: {(1, "proprietary")}}


def test_license_bound_loses_no_paragraph(vocabulary):
    """Against the full score of every piece, confirmed or not; unconfirmed hits are reported."""
    r = random.Random(6)
    scanner = licenses.learn([" ".join(r.choices(vocabulary, k=30)).encode() for _ in range(200)])
    template_words = [w for ts in licenses.TEMPLATES.values() for t in ts for w in t.split()]
    named = refused = 0
    for _ in range(600):
        words = licenses.words_of(" ".join(r.choices(template_words if r.random() < 0.5 else vocabulary, k=r.randint(1, licenses.PIECE))).encode())[: licenses.PIECE]
        full = scanner.probabilities(words)
        n, hits = scanner.scan(b" ".join(words))
        assert n == 1 and bool(hits) == (full[1:].max() >= scanner.bar)
        named, refused = named + bool(hits), refused + any(not h[4] for h in hits)
    assert named > 20 and refused > 0


def test_licenses_of_the_given_tables(spark):
    """Every family's notices among 10,000 documents, and no other line."""
    notices = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL", "All rights reserved.": "proprietary", "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
        "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    }
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    scanner = licenses.train(docs)
    found, planted, wrong = Counter(), Counter(), 0
    texts = {x.doc_id: x.text for x in docs.where("text IS NOT NULL").collect()}
    for x in licenses.scan(docs, scanner).collect():
        lines = (texts.get(x.doc_id) or "").split("\n")
        want = {(k, f) for k, t in enumerate(lines) for n, f in notices.items() if n in t}
        got = {(h.line, h.family) for h in x.hits if h.confirmed}
        planted.update(f for _, f in want)
        found.update(f for _, f in want & got)
        wrong += len(got - want)
    assert len(planted) == 5 and all(found[f] >= 0.95 * planted[f] for f in planted)
    assert wrong == 0


def test_licenses_odd_rows(odd):
    scanner = licenses.train(odd)
    rows = licenses.scan(odd, scanner).collect()
    assert len(rows) == 10 and not any(r.hits for r in rows)
    assert {r.n_paragraphs for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert licenses.scan(odd.limit(0), licenses.train(odd.limit(0))).collect() == []
