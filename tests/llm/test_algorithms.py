"""Operators on records and vectors against brute force, with the awkward rows every table may hold."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm import chunks, components, overlap, pieces, vectors
from scriptorium.operators import graph

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def runs_of(t):
    w = overlap.words_of(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_overlaps_against_brute_force(spark):
    rng = random.Random(1)
    docs = [(f"t{i}", 0, text(rng, rng.randrange(6, 120))) for i in range(60)]
    for i in range(40):
        base = docs[rng.randrange(60)][2].split()
        for _ in range(rng.randrange(0, 8)):
            base[rng.randrange(len(base))] = "changed"
        docs.append((f"e{i}", 1, " ".join(base) + " " + text(rng, rng.randrange(0, 20))))
    hot = text(rng, 30)
    docs += [(f"h{i}", i % 2, hot if i % 3 else hot.upper() + " !") for i in range(30)]  # a third of the rows is one text
    docs += [("short", 0, "two words"), ("empty", 1, ""), ("e0", 1, docs[60][2]), ("漢字", 0, "漢字仮名交り文" * 3), ("漢字2", 1, "漢字仮名交り文" * 3)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "document_id string, side int, text string, id string").repartition(5)
    found = {tuple(r) for r in overlap.document_pairs(*overlap.overlaps(df.drop("id"), 0.6)).select("doc_a", "doc_b").collect()}
    sets = {d: (s, runs_of(t)) for d, s, t in docs}
    want = {(min(a, b), max(a, b)) for a, (s, x) in sets.items() for b, (u, y) in sets.items() if s == 0 and u == 1 and x and len(x & y) >= 0.6 * len(x | y)}
    assert found == want and len(want) > 200
    found = overlap.overlaps(df.drop("id"), 0.6)
    links = {(r.document_id, r.side): r.links for r in overlap.document_links(*found).collect()}
    count = defaultdict(int)
    for a, s, x in [(d, s, runs_of(t)) for d, s, t in docs]:
        count[a, s] += len({b for b, u, t in docs if u != s and x and len(x & runs_of(t)) >= 0.6 * len(x | runs_of(t))})
    assert all(links.get(k, 0) == n for k, n in count.items() if k[0] != "e0")  # e0 has two texts
    assert len({r.class_id for r in overlap.document_links(*found).where("document_id like 'h%' and side = 0").collect()}) == 1
    none = spark.createDataFrame([], "document_id string, side int, text string")
    assert overlap.document_pairs(*overlap.overlaps(none)).count() == 0 and overlap.document_links(*overlap.overlaps(none)).count() == 0


def test_records_that_only_share_frequent_runs_visit_no_shard(spark, monkeypatch):
    rng = random.Random(3)
    pool = [text(rng, 12) for _ in range(40)]  # every sentence stands in many records
    docs = [(f"d{i}", i % 2, " ".join(rng.sample(pool, rng.randrange(6, 12)))) for i in range(200)]
    for i in range(20):
        base = docs[2 * i][2].split()
        for _ in range(rng.randrange(0, 9)):
            base[rng.randrange(len(base))] = "changed"
        docs.append((f"e{i}", 1, " ".join(base[: rng.randrange(60, 140)])))
    visits, write = [], overlap.materialize
    monkeypatch.setattr(overlap, "materialize", lambda df: (visits.append(df.count()) if df.columns == ["id", "bucket"] else None, write(df))[1])
    found = {tuple(r) for r in overlap.document_pairs(*overlap.overlaps(spark.createDataFrame(docs, "document_id string, side int, text string"), 0.6)).select("doc_a", "doc_b").collect()}
    sets = {d: (s, runs_of(t)) for d, s, t in docs}
    want = {(min(a, b), max(a, b)) for a, (s, x) in sets.items() for b, (u, y) in sets.items() if s == 0 and u == 1 and len(x & y) >= 0.6 * len(x | y)}
    assert found == want and len(want) >= 8
    assert len(visits) == 1 and visits[0] < 3 * len(want)


def test_first_runs_hold_enough_of_every_partner():
    rng = np.random.default_rng(2)
    levels = rng.integers(1, 60, 1 << 16).astype(np.uint8)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 200))).astype(np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: int(rng.integers(1, len(a) + 1))], rng.integers(0, 1 << 63, int(rng.integers(0, 60))).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if shared >= 0.6 * (len(a) + len(b) - shared):
            (x, _, top), (y, _, reach) = (overlap.first_runs(z, levels, 0.6) for z in (a, b))
            x, y = x[top >= overlap.size_class(len(b))], y[reach >= overlap.size_class(len(a))]
            assert len(np.intersect1d(x, y)) >= max(overlap.needed(len(a), 0.6), overlap.needed(len(b), 0.6))


def test_run_index_finds_every_run():
    rng = np.random.default_rng(0)
    seqs = [rng.integers(1, 6, n).astype(np.uint64) for n in (40, 7, 5, 60)]
    index = overlap.RunIndex(seqs)
    ask = rng.integers(1, 7, 300).astype(np.uint64)
    have = {tuple(s[i : i + 5]) for s in seqs for i in range(len(s) - 4)}
    found = index.matches(ask)
    names = defaultdict(set)
    for i, m in enumerate(found):
        assert (m >= 0) == (tuple(ask[i : i + 5]) in have)
        if m >= 0:
            names[m].add(tuple(ask[i : i + 5]))
    assert all(len(v) == 1 for v in names.values())


def test_maximal_matches_and_compression():
    rng = np.random.default_rng(1)
    seqs = [rng.integers(1, 4, n).astype(np.uint64) for n in (60, 9, 4, 80)]
    index = overlap.RunIndex(seqs)
    asked = []
    for e, s in enumerate(seqs):
        ask = np.concatenate([rng.integers(1, 5, 30).astype(np.uint64), s[3:40], rng.integers(1, 5, 20).astype(np.uint64), s[:25]])
        have = {tuple(s[i:j]) for i in range(len(s)) for j in range(i + 5, len(s) + 1)}
        inside = {(i, j) for i in range(len(ask)) for j in range(i + 5, len(ask) + 1) if tuple(ask[i:j]) in have}
        want = {(i, j) for i, j in inside if (i - 1, j) not in inside and (i, j + 1) not in inside}
        asked.append((ask, e, want))
        assert bool(want) == (e != 2)
    asked.append((np.zeros(0, np.uint64), 0, set()))
    for (_, _, want), got in zip(asked, index.maximal([(a, e) for a, e, _ in asked]), strict=True):
        assert {tuple(x) for x in got.tolist()} == want
    copy = rng.integers(1, 1 << 60, 400).astype(np.uint64)
    near = [np.concatenate([copy[:i], rng.integers(1, 1 << 60, 1).astype(np.uint64), copy[i:]]) for i in range(0, 400, 20)]
    assert len(overlap.RunIndex(near).keys) < 0.2 * overlap.RunIndex(near).size  # near copies cost little
    assert overlap.merged(np.array([[0, 5], [3, 9], [9, 10], [12, 20]])).tolist() == [[0, 10], [12, 20]]


def test_shared_spans_against_brute_force(spark):
    rng = random.Random(2)
    alphabet = "abcdefghij klmnop漢字é"
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(150, 900))) for _ in range(40)]
    rows = [(f"r{i}", t) for i, t in enumerate(base)]
    for i in range(40):
        src = rng.choice(base)
        n = rng.choice([198, 199, 200, 201, 230, 400])
        a = rng.randrange(0, max(1, len(src) - n))
        rows.append((f"c{i}", "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 200))) + src[a : a + n] + "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 200)))))
    foot = "".join(rng.choice(alphabet) for _ in range(180))
    rows += [(f"f{i}", "".join(rng.choice(alphabet) for _ in range(60)) + foot + "".join(rng.choice(alphabet) for _ in range(60))) for i in range(90)]  # boilerplate under the length
    rows += [("long", "ab" * 3000), ("long2", "ab" * 2000), ("copy1", base[0]), ("copy2", base[0]), ("copy1", base[0]), ("null", None), ("empty", ""), (None, base[1])]
    df = spark.createDataFrame(rows, "record string, text string").repartition(4)
    got = chunks.shared_spans(df)
    found = {tuple(r) for r in chunks.record_pairs(*got).collect()}
    where = defaultdict(set)
    for r, t in rows:
        if r and t:
            for i in range(len(t) - 199):
                where[t[i : i + 200]].add(r)
    want = {(a, b) for s in where.values() for a in s for b in s if a < b}
    assert found == want and len(want) > 20
    cover = {r.record: r.shared_chars for r in chunks.coverage(*got, df).collect()}
    for r, t in rows:
        if r in ("c0", "c3", "r5", "copy1"):
            marks = set()
            for i in range(len(t) - 199):
                if len(where[t[i : i + 200]]) > 1:
                    marks |= set(range(i, i + 200))
            assert cover.get(r, 0) == len(marks)
    text_of = dict((r, t) for r, t in rows if r and t)
    found_stretches = chunks.stretches(*got).collect()
    for r in found_stretches:
        part = text_of[r.record][r.start_char : r.end_char]
        assert len(part) >= 200 and all(part[i : i + 200] in text_of[r.other] for i in range(len(part) - 199))
    copies = {r.record: (r.class_record, r.copies, r.links) for r in chunks.classes(*got).collect()}
    assert copies["copy2"][0] == copies["copy1"][0] == copies["r0"][0] == "copy1" and copies["r0"][1] == 3
    assert {tuple(sorted((r.record, r.other))) for r in found_stretches} <= want and copies["long"][2] == 1
    assert chunks.record_pairs(*chunks.shared_spans(df.where("record = 'x'"))).count() == 0


def test_collisions_of_digests_are_no_hits():
    a, b = chunks._Stretches("abcdefgh", 4), chunks._Stretches("xxabcdyy", 4)
    assert chunks._hits(a, b, 4).tolist() == [0] and chunks._hits(b, a, 4).tolist() == [2]
    b.digests = np.array([a.digests[1], b.digests[1], b.digests[2], a.digests[4], b.digests[4]])  # made to collide
    b.order = np.argsort(b.digests, kind="stable")
    b.sorted = b.digests[b.order]
    assert chunks._hits(a, b, 4).tolist() == [0] and chunks._hits(chunks._Stretches("", 4), a, 4).tolist() == []


def test_components_and_splits(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000, 1000), (5, 5), (None, 3)] + [(2000, 2001 + i) for i in range(300)] + [(3000 + i, 3001 + i) for i in range(50)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            parent[top(a)] = top(b)
    old = graph.LEAST_HOT
    graph.LEAST_HOT = 100  # so that the salted way runs too
    got = graph.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    graph.LEAST_HOT = old
    mine, want = defaultdict(set), defaultdict(set)
    for r in got:
        mine[r.component].add(r.id)
    for x in list(parent):
        want[top(x)].add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))
    assert graph.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_authors_that_share_a_split(spark):
    docs = [("d1", " Ann", "r1"), ("d2", "bob", "r1"), ("d3", "CY", None), ("d4", "dee", "d3"), ("d5", "unknown", "r9"), ("d6", "eve", "r9"), ("d7", None, "r1"), ("d7", None, "r1"), ("d8", "fay", "r8"), (None, "gus", "r1")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "document_id string, author_id string, root_document_id string, label string")
    ps = spark.createDataFrame([("d8", "d3", 1), ("gone", "r1", 2), ("d6", None, 3)], "document_id string, root_document_id string, label int")
    by_doc, by_author = components.tied_groups(df, ps)
    assert {tuple(r) for r in components.authors_that_share(by_author).collect()} == {("ann", "bob"), ("cy", "dee"), ("cy", "fay"), ("dee", "fay")}
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, target_share double")
    out = {r.document_id: (r.component, r.split) for r in components.assign_splits(by_doc, targets).collect()}
    assert len(out) == 8 and len({c for c, _ in out.values()}) == len(set(out.values()))
    many = spark.range(20000).select(F.col("id").cast("string").alias("document_id"), F.col("id").alias("component"))
    share = {r.split: r["count"] / 20000 for r in components.assign_splits(many, targets).groupBy("split").count().collect()}
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["test"] - 0.1) < 0.01


def test_nearest_vectors_recall_ties_and_dirt(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(150, 64))
    x = np.repeat(centres, 12, axis=0) + 0.2 * rng.normal(size=(1800, 64))
    rows = [(i, (v * (1 + i % 5)).astype(float).tolist()) for i, v in enumerate(x)]
    rows += [(5000 + i, rows[7][1]) for i in range(900)]  # a third of the rows is one vector
    dirty = [(9000, None), (9001, [1.0] * 63), (9002, [0.0] * 64), (9003, [float("nan")] + [1.0] * 63), (9004, [None] + [1.0] * 63), (9005, [float("inf")] * 64), (None, [1.0] * 64), rows[3], rows[3]]
    df = spark.createDataFrame(rows + dirty, "vec_id bigint, embedding array<float>").withColumn("near", F.lit("clash"))
    got = defaultdict(list)
    for r in vectors.nearest_vectors(df).collect():
        got[r.vec_id].append((r.near, r.similarity))
    ids = np.array([r[0] for r in rows])
    m = np.array([r[1] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -9)
    hits = total = 0
    for i in range(0, 1800, 7):
        want = np.sort(s[i])[-5]
        near = got[ids[i]]
        assert len(near) == 5 and len({n for n, _ in near}) == 5 and ids[i] not in [n for n, _ in near]
        hits += sum(v >= want - 1e-4 for _, v in near)
        total += 5
    assert hits / total >= 0.95 and set(got) == set(ids.tolist())
    assert {n for n, _ in got[5010]} == {7, 5000, 5001, 5002, 5003}
    assert vectors.nearest_vectors(df.where("vec_id is null")).count() == 0
    assert vectors.neighbour_pairs(vectors.nearest_vectors(df.where("vec_id in (1, 2)"))).collect()[0][:] == (1, 2)


def test_pieces_cover_the_text_within_limits(spark, tmp_path):
    rng = random.Random(5)
    lim = pieces.Limits(words=50, chars=300, overlap=5)
    made = "\n\n".join(". ".join(text(rng, rng.randrange(3, 15)).capitalize() for _ in range(rng.randrange(1, 6))) + "." for _ in range(80))
    items = {1: made, 2: "x" * 2000, 3: "", 4: None, 5: "short one", 6: "a " * 400, 7: "漢字。" * 300}
    df = spark.createDataFrame(list(items.items()), "item bigint, text string")
    for size in (1 << 16, 700):
        got = defaultdict(list)
        for r in pieces.split_items(df, lim, size).orderBy("item", "piece").collect():
            got[r.item].append(r)
        assert set(got) == {1, 2, 6, 7}
        for i, rows in got.items():
            t = items[i]
            assert rows[0].start_char == 0 and rows[-1].end_char == len(t) and [r.piece for r in rows] == list(range(len(rows)))
            for a, b in zip(rows, rows[1:]):
                assert a.start_char < b.start_char <= a.end_char < b.end_char
            for r in rows:
                part = t[r.start_char : r.end_char]
                assert len(part) <= lim.chars and len(pieces.WORD.findall(part)) <= lim.words
                if i == 1:
                    assert r.word_count == len(pieces.WORD.findall(part))
        assert sum(made[: r.end_char].rstrip().endswith(".") for r in got[1]) > 0.6 * len(got[1])  # most end with a sentence
    path = tmp_path / "big.txt"
    path.write_text(made + "\n\n" + "é漢 " * 500, encoding="utf-8")
    whole = path.read_text(encoding="utf-8")
    rows = pieces.split_files(spark, [str(path)], lim, 1000).orderBy("piece").collect()
    assert rows[0].start_char == 0 and rows[-1].end_char == len(whole)
    assert all(r.end_char - r.start_char <= lim.chars and len(pieces.WORD.findall(whole[r.start_char : r.end_char])) <= lim.words for r in rows)


def test_oversized_passages(spark):
    p = [("d", 1, "w " * 701, 0, 9, 3), ("d", 2, "w " * 700, 0, 9, 3), ("d", 3, None, 0, 5001, None), ("d", 4, None, 2, 9, None), ("gone", 1, None, 0, 9999, None), ("d", 1, "w " * 701, 0, 9, 3), ("e", 1, "y" * 5001, 0, 0, 0), ("e", 2, "", 0, 0, 0)]
    ps = spark.createDataFrame(p, "document_id string, passage_id bigint, text string, start_char bigint, end_char bigint, word_count bigint")
    docs = spark.createDataFrame([("d", "z" * 6000, 1), ("e", None, 1)], "document_id string, clean_text string, loaded_at int")
    for size in (1 << 16, 100):
        assert {tuple(r) for r in pieces.oversized_passages(ps, docs, size=size).collect()} == {("d", 1), ("d", 3), ("e", 1)}
    assert pieces.passage_pieces(ps, docs).select("document_id", "passage_id").distinct().count() == 3
