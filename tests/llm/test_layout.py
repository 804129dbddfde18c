"""Sharding, mixing, decontamination, the pipeline and the registered queries."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtrace.llm import decontamination, mixing, queries, sharding

TREE = queries.TREE


def test_shards_follow_weights_and_slots_are_gapless(make):
    docs = make([(i, f"text {i % 7}") for i in range(4000)])
    tree = sharding.Tree({"a": {"a.0": {0: 3.0, 1: 1.0}}, "b": {"b.0": {2: 2.0}, "b.1": {3: 2.0}}})
    rows = sharding.shard(docs, tree, tree.grown(4.0)).collect()
    n = Counter(r.shard for r in rows)
    assert all(abs(n[s] / 4000 - w / 8) < 0.03 for s, w in {0: 3, 1: 1, 2: 2, 3: 2}.items())
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {4} and abs(len(moved) / 4000 - 4 / 12) < 0.03
    assert all(r.size == len(f"text {r.doc_id % 7}") + 1 and r.text_crc32 == zlib.crc32(f"text {r.doc_id % 7}".encode()) for r in rows)


def test_a_weight_moves_rows_within_its_subtree_only(spark):
    ids = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    a = sharding.Tree({"a": {"a.0": {0: 1.0, 1: 1.0}, "a.1": {2: 2.0}}, "b": {"b.0": {3: 4.0}}})
    b = sharding.Tree({"a": {"a.0": {0: 1.5, 1: 0.5}, "a.1": {2: 2.0}}, "b": {"b.0": {3: 4.0}}})
    x, y = ({r.doc_id: r.shard for r in sharding.shard(ids, t).collect()} for t in (a, b))
    assert {(x[i], y[i]) for i in x if x[i] != y[i]} == {(1, 0)}


def test_shard_depends_on_the_id_alone(make):
    few = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard(make([(i, "a") for i in range(50)]), TREE, TREE.grown()).collect()}
    more = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard(make([(i, "b") for i in range(400)]), TREE, TREE.grown()).collect()}
    assert all(more[i] == few[i] for i in few)


def test_shards_odd_rows(odd):
    rows = sharding.shard(odd, TREE, TREE.grown()).collect()
    assert len(rows) == 10
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 2} == {(1, 0)}
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard(odd.limit(0), TREE).collect() == []


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """sizes: source -> words. Share out, cut off at the cap, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > cap * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in free}
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        free -= over
    return out


def test_targets_match_sharing_out_again(spark):
    r = random.Random(1)
    for _ in range(4):
        sizes = {(None if k == 6 else chr(97 + k)): r.choice([1, 10, 100, 1000, 5000]) for k in range(7)}
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
        got = {x.source: x.target for x in mixing.targets(rows).collect()}
        want = brute_targets(sizes)
        assert all(got[s] == pytest.approx(want[s]) for s in sizes)


def mixture(seed=4):
    r = random.Random(seed)
    rows = []
    for i in range(700):
        source = r.choice(["a"] * 9 + ["b", "c", "d", None, "\U0001f600"])
        rows.append((i, " ".join(["w"] * r.choice([0, 1, 5, 40, 300])), "en", source))
    return rows


def test_mix_meets_targets_and_caps(make):
    rows = mixture()
    got = mixing.taken(mixing.mix(make(rows))).collect()
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for i, t, _, s in rows:
        sizes[s] += len(t.split())
    source = {i: s for i, _, _, s in rows}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
        assert r.source_size == sizes[source[r.doc_id]]
    want = brute_targets(sizes)
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], abs=6 * 16)
    assert sorted(map(tuple, mixing.taken(mixing.mix(make(rows).repartition(7))).collect())) == sorted(map(tuple, got))


def test_mix_matches_a_schedule_walked_slot_by_slot(make):
    rows = mixture(9)
    m = mixing.mix(make(rows))
    docs = sorted((r for r in m.docs.collect()), key=lambda r: (r.source_no, r.start))
    sources = {r.source_no: r for r in m.sources.collect()}
    stream = defaultdict(list)
    for r in docs:
        if r["size"]:
            assert r.start == len(stream[r.source_no])
            stream[r.source_no] += [r.doc_id] * r["size"]
    taken, rank = Counter(), Counter()
    total = sum(map(len, stream.values()))
    for slot in range(-(-total // m.block)):
        u = (slot * mixing.GOLDEN) % 1.0
        no = next(k for k, s in sorted(sources.items()) if s.lo <= u < s.hi)
        blocks = -(-len(stream[no]) // m.block)
        if rank[no] < 3 * blocks:
            at = rank[no] % blocks * m.block
            taken.update(stream[no][at : at + m.block])
        rank[no] += 1
    assert {r.doc_id: r.taken for r in mixing.taken(m).collect()} == {i: taken[i] for i, *_ in rows}


def test_small_sources_of_a_large_corpus_reach_their_targets(make, monkeypatch):
    """Blocks far above the small sources' sizes: each takes its target, at most cap times each word."""
    monkeypatch.setattr(mixing, "SLOTS", 256)
    sizes = {"a": 200, "b": 1000, "c": 3000, "d": 20_000, "e": 60_000, "f": 416_000, "g": 7, "h": 2100, "i": 1}
    rows, left = [], dict(sizes)
    while any(left.values()):
        for s in sizes:
            if n := min(left[s], 97 if sizes[s] < 10_000 else 970):
                rows.append((len(rows), " ".join(["w"] * n), "en", s))
                left[s] -= n
    m = mixing.mix(make(rows))
    assert m.block > 1900
    db = duckdb.connect()
    documents = pa.table({k: [r[i] for r in rows] for i, k in enumerate(("doc_id", "text", "lang", "source"))})  # noqa: F841  read by name
    db.register("documents", documents)
    twin = {r[0]: r[4] for r in db.sql(queries.op9_sql()).select("doc_id, size, source_size, target, taken").fetchall()}
    assert {x.doc_id: x.taken for x in mixing.taken(m).collect()} == twin
    source, taken = {i: s for i, _, _, s in rows}, Counter()
    for x in mixing.taken(m).collect():
        taken[source[x.doc_id]] += x.taken
        assert 0 <= x.taken <= 3 * x["size"]
    want = brute_targets(sizes)
    assert all(taken[s] == pytest.approx(want[s], abs=2, rel=0.01) for s in sizes)
    assert {source[x.doc_id] for x in mixing.copies(make(rows)).select("doc_id").collect()} == set(sizes)


def test_copies_are_whole_rows(make):
    docs = make(mixture(5))
    times = {r.doc_id: int(r.taken / r["size"] + 0.5) for r in mixing.taken(mixing.mix(docs)).collect() if r["size"]}
    got = Counter(r.doc_id for r in mixing.copies(docs).collect())
    assert got == {i: n for i, n in times.items() if n}
    assert mixing.copies(docs).columns == docs.columns


def test_mix_odd_rows(odd):
    rows = mixing.taken(mixing.mix(odd)).collect()
    assert len(rows) == 10 and all(r.taken == 0 for r in rows if r["size"] == 0)
    assert mixing.copies(odd).columns == odd.columns
    empty = odd.where("doc_id in (1, 2)")
    assert [(r.target, r.taken) for r in mixing.taken(mixing.mix(empty)).collect()] == [(0.0, 0)] * 2
    assert mixing.taken(mixing.mix(odd.limit(0))).collect() == []


def edits(piece, region):
    """Least edits between piece and any stretch of region, by the full table, a row at a time."""
    c, steps = np.array([*map(ord, region)], dtype=np.int64), np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, dtype=np.int64)
    for i, p in enumerate(piece):
        new = np.concatenate([[i + 1], np.minimum(row[:-1] + (c != ord(p)), row[1:] + 1)])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def test_banded_alignment_matches_the_full_table():
    r = random.Random(6)
    for _ in range(200):
        p = "".join(r.choices("abc", k=r.randint(5, 30)))
        x = list(p)
        for _ in range(r.randrange(6)):
            x[r.randrange(len(x))] = r.choice(["", "a", "bc", "d"])
        region = "".join(r.choices("abc", k=r.randrange(9))) + "".join(x) + "".join(r.choices("abc", k=r.randrange(9)))
        want, k = edits(p, region), 5
        got = decontamination.band_edits(decontamination.codes(p), decontamination.codes(region), k)
        slack = max(0, len(region) - len(p))
        assert got == want if want <= k and slack >= 0 else got > k


def edited(r, text, rate=0.15):
    s = list(text)
    for _ in range(r.randrange(int(len(s) * rate) + 1)):
        s[r.randrange(len(s))] = r.choice(["", "x", "yz", " "])
    return "".join(s)


@pytest.mark.parametrize("hits", [1 << 20, 50])
def test_lemma_filter_loses_no_piece(vocabulary, monkeypatch, hits):
    """Against a full table over every document: pieces within the budget are found, others are not; however few hits are held at once."""
    monkeypatch.setattr(decontamination, "HITS", hits)
    r = random.Random(10)
    common = " ".join(r.choices(vocabulary, k=18))
    items = [(i, decontamination.normal(" ".join(r.choices(vocabulary, k=r.randint(2, 40))) + (f" {common} tail" if i % 3 == 0 else ""))) for i in range(25)]
    items += [(100, items[3][1]), (101, "tail")]
    index = decontamination.Index.build(items)
    pieces = [(index.text[s : s + m], int(e), int(k)) for s, m, e, k in zip(index.start, index.length, index.edits, index.owner)]
    for n in range(60):
        text = decontamination.normal(" ".join(r.choices(vocabulary, k=r.randint(0, 60))))
        if n % 3:
            text = decontamination.normal(text + " " + edited(r, r.choice(items)[1]) + " " + " ".join(r.choices(vocabulary, k=9)))
        want = defaultdict(list)
        for piece, budget, k in pieces:
            e = edits(piece, text)
            if e <= budget:
                for i in index.items[k]:
                    want[i].append(e)
        short = {101} if " tail " in f" {text} " else set()
        got = index.search(text)
        assert {i: (k, e) for i, k, e, _ in got if i != 101} == {i: (len(v), min(v)) for i, v in want.items()}
        assert {i for i, *_ in got} - set(want) == short
        assert index.holds(text) == bool(got)


def test_start_is_where_the_match_begins(vocabulary):
    r = random.Random(4)
    item = decontamination.normal(" ".join(r.choices(vocabulary, k=16)))[: decontamination.PIECE]
    index = decontamination.Index.build([(1, item)])
    for _ in range(40):
        before = decontamination.normal(" ".join(r.choices(vocabulary, k=r.randint(1, 80)))) + " "
        at = r.randrange(10, 60)
        for inside in (item, item[:at] + "#" + item[at + 1 :]):
            [(_, _, e, start)] = index.search(before + inside + " end")
            assert (e, start) == (int(inside != item), len(before))


def test_parts_of_items_at_every_length(make, spark, vocabulary):
    """A document that is itself a part of an item, shorter than a piece: as the full table has it, and no error."""
    r = random.Random(13)
    k = decontamination.budget(decontamination.PIECE)
    item = decontamination.normal(" ".join(r.choices(vocabulary, k=60)))
    piece = item[: decontamination.PIECE]
    docs = [(n, item[at : at + n]) for at in (0, 5, 9) for n in range(1, 140)]
    for _, text in docs:
        want = edits(piece, decontamination.normal(text))
        got = decontamination.band_edits(decontamination.codes(piece), decontamination.codes(decontamination.normal(text)), k)
        assert got == want if want <= k else got > k
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    held = {x.doc_id for x in decontamination.find(make([(n, item[:n]) for n in range(1, 140)]), bench).collect()}
    assert held == set(range(decontamination.PIECE - k, 140))
    # Any passage of PIECE + STRIDE characters holds a whole piece.
    passage = decontamination.PIECE + decontamination.STRIDE
    index = decontamination.Index.build([(1, item)])
    assert all(index.holds(f"xx {item[at : at + passage]} yy") for at in range(len(item) - passage + 1))


def test_decontamination_over_tables(make, spark, vocabulary, monkeypatch):
    """One index, and twenty blocks of the benchmark one after another; short items, null ids, an item in parts."""
    r = random.Random(12)
    items = [(i, " ".join(r.choices(vocabulary, k=30))) for i in range(20)]
    rows = [(i, " ".join(r.choices(vocabulary, k=80))) for i in range(60)]
    for i in range(0, 60, 6):
        rows[i] = (i, rows[i][1] + "\n" + items[i // 6][1].upper().replace(" ", "  ", 3))
    rows += [(60, rows[1][1] + " null id is an item too"), (61, rows[2][1] + " Ab Cde"), (62, rows[3][1] + " abxcde")]
    docs, bench = make(rows), spark.createDataFrame([*items, (90, None), (91, ""), (92, "tiny"), (93, "ab  cde"), (93, "ab  cde"), (None, "null id is an item too")], "item_id bigint, text string")
    want = sorted([*((i, i // 6) for i in range(0, 60, 6)), (60, None), (61, 93)])
    one = sorted((x.doc_id, x.item_id, x.n_pieces, x.edits, x.start) for x in decontamination.find(docs, bench).collect())
    assert [x[:2] for x in one] == want
    assert {x.doc_id for x in decontamination.keep_clean(docs, bench).collect()} == {i for i in range(63) if i > 60 or i % 6}
    assert {x.doc_id for x in decontamination.keep_clean(docs, bench, least=1).collect()} == {i for i in range(63) if i > 61 or i < 60 and i % 6}
    monkeypatch.setattr(decontamination, "BLOCK", 250)
    monkeypatch.setattr(decontamination, "PART", 250)
    n, indexes = decontamination.blocks(bench)
    assert n >= 20 and max(len(x.text) for x in indexes) <= 250
    assert sorted((x.doc_id, x.item_id, x.n_pieces, x.edits, x.start) for x in decontamination.find(docs, bench).collect()) == one
    monkeypatch.setattr(decontamination, "BLOCK", 1500)
    assert decontamination.blocks(bench)[0] >= 3
    assert {x.doc_id for x in decontamination.keep_clean(docs, bench).collect()} == {i for i in range(63) if i > 60 or i % 6}


def test_size_of_an_index(vocabulary):
    """As the docstring has it."""
    import pickle

    r = random.Random(2)
    index = decontamination.Index.build([(i, " ".join(r.choices(vocabulary, k=60))) for i in range(2000)])
    assert 18 < len(pickle.dumps(index)) / len(index.text) < 27


def test_decontamination_odd_rows(odd, spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id bigint, text string")
    assert decontamination.find(odd, bench).collect() == []
    assert decontamination.keep_clean(odd, bench).count() == 10
    assert decontamination.find(odd, bench.limit(0)).collect() == []
    assert decontamination.keep_clean(odd, bench.limit(0)).columns == odd.columns
    assert decontamination.find(odd.limit(0), bench).collect() == []


CONTRACT = {
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op4_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op5_simhash": ["doc_id", "fingerprint", "component_id"],
    "op7_quality_gam": ["doc_id", "held_out", "score", "predicted"],
    "op8_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op9_mixing": ["doc_id", "size", "source_size", "target", "taken"],
}


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract_columns(spark, tmp_path, odd, name):
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path))
    assert got.columns[: len(CONTRACT[name])] == CONTRACT[name]
    assert got.count() == 10


def test_pipeline_by_hand(spark, make, tmp_path, vocabulary):
    """Planted toxic documents, copies and leaks go; clean documents stay up to the mix; every row gets a shard."""
    import corpus_pipeline as cp

    r = random.Random(20)
    rows = [(i, " ".join(r.choices(vocabulary, k=r.randint(20, 80))), "en", f"s{i % 3}") for i in range(400)]
    labels = []
    for i in range(0, 400, 5):
        w = rows[i][1].split()
        w[3:3] = ["nasty", "vile"]
        rows[i] = (i, " ".join(w), "en", rows[i][3])
    labels = [(i, 1, int(i % 5 == 0)) for i in range(400)]
    rows += [(1000 + i, rows[i][1], "en", "s0") for i in range(1, 400, 20)]
    item = " ".join(r.choices(vocabulary, k=30))
    rows += [(2000 + i, " ".join(r.choices(vocabulary, k=50)) + " " + item, "en", "s1") for i in range(5)]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in cp.STAGES:
        docs = cp.stored(stage(spark, docs, str(tmp_path)))
        kept.append(Counter(x.doc_id for x in docs.select("doc_id").collect()))
        assert name == "sharding" or docs.columns == columns
    assert not any(i % 5 == 0 for i in kept[0] if i < 400) and set(kept[0]) >= {i for i in range(400) if i % 5}
    assert set(kept[1]) == {i for i in kept[0] if not 1000 <= i < 2000}
    assert set(kept[2]) == {i for i in kept[1] if i < 1000}
    assert set(kept[3]) <= set(kept[2]) and max(kept[3].values()) <= 3
    assert kept[4] == kept[3]
    assert cp.run(spark, str(tmp_path)).count() == sum(kept[4].values())


def test_every_stage_takes_odd_and_empty_tables(spark, odd, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven"), (None, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in cp.STAGES:
        for docs in (odd, odd.limit(0)):
            got = stage(spark, docs, str(tmp_path))
            assert name == "sharding" or got.columns == docs.columns
            assert got.count() <= 3 * 10


def test_oracles_match(spark, tmp_path):
    """The SQL twins over the smallest tables."""
    d, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, d).toPandas(), db.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        as_text = lambda f: sorted(map(str, f[sorted(f.columns)].astype(str).itertuples(index=False, name=None)))
        assert as_text(got) == as_text(want), name
