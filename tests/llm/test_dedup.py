"""SimHash, substring and line dedup against brute force."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from loomtrace.llm import line_dedup, simhash, substring_dedup
from loomtrace.llm.automaton import SuffixAutomaton
from loomtrace.llm.components import components
from loomtrace.llm.patience import align, blocks


def corpus(vocabulary, seed=3, n=70):
    """Texts with exact copies, near copies, shared passages with different ends, and chains of them."""
    r = random.Random(seed)
    words = lambda k: r.choices(vocabulary, k=k)
    passages = [words(r.randint(45, 120)) for _ in range(6)]
    docs = [words(r.randint(0, 220)) for _ in range(n)]
    for _ in range(60):
        d = words(r.randint(0, 80))
        for _ in range(r.randint(1, 3)):
            p = r.choice(passages)
            s = r.randrange(0, 10)
            d = d + p[s : len(p) - r.randrange(0, 10)] + words(r.randint(0, 40))
        docs.append(d)
    docs += [list(r.choice(docs)) for _ in range(25)]
    for _ in range(25):
        d = list(r.choice(docs))
        if d:
            d[r.randrange(len(d))] = "changed"
        docs.append(d)
    docs += [["same"] * k for k in (10, 49, 50, 51, 120)]
    r.shuffle(docs)
    return [(i, (" " if i % 3 else " \n").join(d)) for i, d in enumerate(docs)]


def brute_spans(rows):
    first = {}
    for i, t in rows:
        w = t.encode().split()
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in rows:
        w = t.encode().split()
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("seed, small", [(3, False), (4, True)])
def test_substring_dedup_matches_brute_force(make, vocabulary, monkeypatch, seed, small):
    """Also with shards cut into many parts and automata that are large from the start."""
    if small:
        for name, value in {"PART_ANCHORS": 2, "LARGE": 1, "CHUNK": 60}.items():
            monkeypatch.setattr(substring_dedup, name, value)
    rows = corpus(vocabulary, seed)
    got = substring_dedup.remove(make(rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute_spans(rows)


def test_substring_dedup_window_from_a_third_document(make, vocabulary):
    """The first document of an anchor differs around it; the window matches a later, but still earlier, one."""
    r = random.Random(9)
    core, ends = r.choices(vocabulary, k=30), [r.choices(vocabulary, k=80) for _ in range(4)]
    rows = [(1, " ".join(ends[0] + core + ends[1])), (2, " ".join(ends[2] + core + ends[3])), (3, " ".join(ends[2][40:] + core + ends[3][:40])), (4, " ".join(ends[2][60:] + core + ends[1][:60]))]
    got = substring_dedup.remove(make(rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute_spans(rows)


def test_endless_repetition_adds_nothing():
    """A long stretch of one word, or of a period, does not fill an automaton with its length."""
    machine = SuffixAutomaton()
    for words in ([0] * 300_000, [1, 2, 3] * 100_000):
        substring_dedup._learn(machine, words)
    assert len(machine.length) < 25_000
    assert min(machine.matching([2, 3, 1] * 100)[49:]) >= 50


def test_substring_dedup_odd_rows(odd):
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.remove(odd).collect()))
    assert got == [(False, 1, 0, 0), (False, 2, 0, 0), (False, 3, 0, 0), (False, 4, 3, 0), (False, 4, 3, 0), (False, 5, 30_000, 0), (False, 6, 30_000, 30_000), (False, 7, 3, 0), (True, 0, 0, 0), (True, 0, 6, 0)]
    assert substring_dedup.remove(odd.limit(0)).collect() == []


def test_word_hashes(monkeypatch, vocabulary):
    r = random.Random(12)
    texts = [b"", b" \n", b"a", b" a", b"a ", b"\x0ba\x0c\rb\tcc", "é ü\x85x 漢字".encode()] + [" ".join(r.choices(vocabulary, k=r.randint(1, 60))).encode() for _ in range(40)]
    by_word = {}
    for t in texts:
        h = substring_dedup.word_hashes(t).tolist()
        assert len(h) == len(t.split())
        for w, x in zip(t.split(), h):
            assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)
    whole = [substring_dedup.word_hashes(t).tolist() for t in texts]
    monkeypatch.setattr(substring_dedup, "BLOCK", 7)
    assert [substring_dedup.word_hashes(t).tolist() for t in texts] == whole


def test_automaton_matching_statistics():
    r = random.Random(1)
    for _ in range(30):
        seqs = [[r.randrange(3) for _ in range(r.randrange(1, 25))] for _ in range(3)]
        machine = SuffixAutomaton()
        for s in seqs:
            machine.add(s)
        q = [r.randrange(4) for _ in range(30)]
        subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i, len(s) + 1)}
        assert machine.matching(q) == [max(k for k in range(i + 2) if tuple(q[i + 1 - k : i + 1]) in subs) for i in range(len(q))]


def brute_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    """prints: (doc_id, fingerprint) -> doc_id: least id reachable."""
    label = {i: i for i, _ in prints}
    moved = True
    while moved:
        moved = False
        for i, a in prints:
            for j, b in prints:
                if (a ^ b).bit_count() <= 4 and label[j] < label[i]:
                    label[i], moved = label[j], True
    return label


def test_simhash_matches_brute_force(make, vocabulary):
    rows = [(i, t.upper() if i % 7 == 0 else t) for i, t in corpus(vocabulary, 6, 40)] + [(500, ""), (501, " \n"), (502, "Ä b"), (503, "ä b")]
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    got = simhash.near_duplicates(make(rows)).collect()
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == dict(prints)
    assert {r.doc_id: r.component_id for r in got} == brute_groups(prints)


@pytest.mark.parametrize("levels", [1, 3])
def test_simhash_large_buckets_lose_no_link(spark, monkeypatch, levels):
    """With tiny cells every bucket is cut finer, and what stays large dealt out in tiles by population count."""
    monkeypatch.setattr(simhash, "CELL", 6)
    monkeypatch.setattr(simhash, "LEVELS", levels)
    r = random.Random(2)
    fps = {r.getrandbits(64) for _ in range(30)}
    for f in list(fps)[:12]:
        for _ in range(8):
            f ^= 1 << r.randrange(64)
            fps.add(f)
    prints = [(i, f) for i, f in enumerate(sorted(fps))]
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for _, f in prints], "fp bigint")
    star = {u % (1 << 64): v % (1 << 64) for u, v in components(simhash.links(frame, len(prints))).collect()}
    want = brute_groups(prints)
    groups = lambda label: sorted(sorted(f for f in label if label[f] == x) for x in set(label.values()))
    assert groups({f: star.get(f, f) for _, f in prints}) == groups({f: want[i] for i, f in prints})


def test_block_masks_cover_every_pair_within_the_radius():
    r = random.Random(4)
    for n in (10, 1 << 25, 1 << 33):
        masks = simhash.block_masks(n)
        for _ in range(300):
            flips = sum(1 << b for b in r.sample(range(64), 4))
            assert any(flips & m == 0 for m in masks)


def test_finer_parts_cover_every_pair_within_the_radius():
    r = random.Random(4)
    for mask in simhash.block_masks(1 << 25):
        parts = simhash.finer(mask)
        assert sum(parts) == (1 << 64) - 1 - mask
        for _ in range(50):
            flips = sum(1 << b for b in r.sample([b for b in range(64) if not mask >> b & 1], 4))
            assert any(flips & m == 0 for m in parts)


def test_simhash_odd_rows(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 10
    zero = {r.component_id for r in got if r.fp == 0}
    assert zero == {1}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.select("doc_id", "text").collect()) == sorted((r.doc_id or 0, r.text) for r in odd.where("doc_id IN (1, 4, 5, 7) OR length(text) > 20 AND doc_id IS NULL").distinct().select("doc_id", "text").collect())
    assert simhash.near_duplicates(odd.limit(0)).collect() == []


def brute_kept(rows):
    """rows (doc_id, text), repeated ids among them: of each group a row of the least id, null the last."""
    prints = [(k, brute_fingerprint(t)) for k, (_, t) in enumerate(rows)]
    label = brute_groups(prints)
    groups = {}
    for k, row in enumerate(rows):
        groups.setdefault(label[k], []).append(row)
    return [{t for i, t in g if i == min((i for i, _ in g), key=lambda i: (i is None, i))} for g in groups.values()], [min((i for i, _ in g), key=lambda i: (i is None, i)) for g in groups.values()]


def test_keep_one_of_repeated_ids(make):
    """Ids that are repeated with other texts: no text is lost, no copy stays, however the rows lie."""
    a, b, c, d = (" ".join(random.Random(k).choices("abcdefghijklmnop", k=60)) for k in range(4))
    for rows, want in [
        ([(5, a), (5, b), (6, c)], [(5, a), (5, b), (6, c)]),
        ([(1, a), (2, a), (2, b), (3, b)], [(1, a), (2, b)]),
        ([(None, a), (None, a), (7, a), (None, b), (7, c), (7, c), (8, d), (None, d)], [(7, a), (None, b), (7, c), (8, d)]),
    ]:
        for parts in (1, 7):
            got = simhash.keep_one(make(rows).repartition(parts)).select("doc_id", "text").collect()
            assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_keep_one_matches_brute_force(make, vocabulary):
    r = random.Random(3)
    rows = [(r.choice([None, *range(40)]), t) for _, t in corpus(vocabulary, 6, 30)]
    texts, ids = brute_kept(rows)
    kept = []
    for parts in (1, 6):
        kept.append(sorted(map(tuple, simhash.keep_one(make(rows).repartition(parts)).select("doc_id", "text").collect()), key=str))
    assert kept[0] == kept[1]
    assert sorted((i for i, _ in kept[0]), key=str) == sorted(ids, key=str)
    assert sorted(sum(t in own for _, t in kept[0]) for own in texts) == [1] * len(texts)


def test_components_of_a_chain(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "u bigint, v bigint")
    assert {(r.u, r.v) for r in components(edges).collect()} == {(i, 0) for i in range(1, n + 1)}


def test_patience_alignment():
    assert align([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert align([5, 1, 2, 3, 6], [7, 1, 2, 3, 8]) == [(1, 1), (2, 2), (3, 3)]
    assert align([1, 1, 1], [1, 1]) == [(0, 0), (1, 1)]
    assert align([], [1]) == []
    r = random.Random(0)
    for _ in range(200):
        a, b = ([r.randrange(8) for _ in range(r.randrange(14))] for _ in range(2))
        got = align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    assert blocks([(0, 3), (1, 4), (2, 6), (5, 7)]) == [(0, 2), (2, 3), (5, 6)]


def brute_lines(rows):
    """(lines, removed) from the strings alone: every run of two lines, or line of 20 words, that any earlier document has."""
    own = [(i, [x.strip() for x in t.encode().split(b"\n") if x.strip()]) for i, t in rows]
    keys = lambda ls: [(k, k + 1, (x,)) for k, x in enumerate(ls) if len(x.split()) >= 20] + [(k, k + 2, p) for k, p in enumerate(zip(ls, ls[1:]))]
    first = {}
    for i, ls in own:
        for _, _, key in keys(ls):
            first[key] = min(first.get(key, i), i)
    return {i: (len(ls), len({k for s, e, key in keys(ls) if first[key] < i for k in range(s, e)})) for i, ls in own}


def line_rows(seed, n=90):
    r = random.Random(seed)
    pool = [" ".join(r.choices("a b c d e f g h".split(), k=r.randint(1, 24))) + str(i) for i in range(400)]
    shared = [r.choices(pool, k=r.randint(1, 5)) for _ in range(8)]
    rows = []
    for i in range(n):
        ls = r.choices(pool, k=r.randint(0, 9))
        if r.random() < 0.6:
            at = r.randrange(len(ls) + 1)
            ls[at:at] = r.choice(shared)
        if r.random() < 0.3:
            ls.insert(r.randrange(len(ls) + 1), " ")
        rows.append((i, "\n".join(ls)))
    return rows + [(n + i, r.choice(rows)[1]) for i in range(8)]


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_matches_brute_force(make, seed):
    rows = line_rows(seed)
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.remove(make(rows)).collect()}
    assert got == brute_lines(rows)
    assert sum(g for _, g in got.values()) > 50


def test_line_dedup_hot_block(make, monkeypatch):
    """A block in more documents than RARE: every holder but the first loses it."""
    monkeypatch.setattr(line_dedup, "RARE", 5)
    rows = [(i, f"own line {i}\nfirst shared line\nsecond shared line\nlast {i}") for i in range(60)]
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in line_dedup.remove(make(rows)).collect()}
    assert got[0] == (0, rows[0][1])
    assert all(got[i] == (2, f"own line {i}\nlast {i}") for i in range(1, 60))


def in_any_order():
    """Passages twice and in another order, from several holders, among other documents."""
    rows = []
    for seed in (2, 5):
        rows += [(1000 * seed + i, t) for i, t in line_rows(seed)]
    r = random.Random(8)
    passages = [f"first of {k}\nsecond of {k}\nthird of {k}" for k in range(6)]
    for i in range(40):
        held = r.choices(passages, k=r.randint(1, 4))
        rows.append((10_000 + i, "\n".join(x for k, p in enumerate(held) for x in (f"own {i} {k}", p))))
    return rows


@pytest.mark.parametrize("rare", [64, 4])
def test_line_dedup_in_any_order(make, monkeypatch, rare):
    monkeypatch.setattr(line_dedup, "RARE", rare)
    rows = in_any_order()
    got = {x.doc_id: (x.n_lines, x.n_removed) for x in line_dedup.remove(make(rows)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_has_all_that_alignment_with_every_earlier_document_removes():
    """Plain patience diff with each earlier document finds no line that the rule leaves; the rule finds more."""
    rows = [(i, [x.strip() for x in t.split("\n") if x.strip()]) for i, t in in_any_order()]
    plain = closed = 0
    for n, (_, ls) in enumerate(rows):
        words = [len(x.split()) for x in ls]
        lost = lambda runs: {k for s, e in runs for k in range(s, e)}
        enough = lambda s, e, words=words: e - s >= 2 or sum(words[s:e]) >= 20
        one = set().union(*(lost(x for x in blocks(align(ls, e)) if enough(*x)) for _, e in rows[:n]))
        all_ = set().union(*(lost(line_dedup.common(ls, words, e)) for _, e in rows[:n]))
        assert one <= all_
        plain, closed = plain + len(one), closed + len(all_)
    assert 0.8 * closed < plain < closed


def test_line_dedup_of_repeated_ids(make, monkeypatch):
    """Rows of one id do not meet, and still meet the earlier document behind them."""
    monkeypatch.setattr(line_dedup, "RARE", 3)
    shared = "first shared line\nsecond shared line"
    rows = [(3, f"a\n{shared}"), *((5, f"own {k}\n{shared}") for k in range(30))]
    got = sorted((x.doc_id, x.n_removed) for x in line_dedup.remove(make(rows)).collect())
    assert got == [(3, 0), *[(5, 2)] * 30]


def test_line_dedup_odd_rows(odd):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_lines, r.n_removed) for r in line_dedup.remove(odd).collect())
    assert got == [(False, 1, 0, 0), (False, 2, 0, 0), (False, 3, 0, 0), (False, 4, 1, 0), (False, 4, 1, 0), (False, 5, 1, 0), (False, 6, 1, 1), (False, 7, 1, 0), (True, 0, 0, 0), (True, 0, 1, 0)]
    assert line_dedup.remove(odd.limit(0)).collect() == []
