"""Operators 7 and 9 and the pipeline against brute force."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quaylight.llm import minhash, repeats, shingles
from quaylight.llm.suffix_groups import suffix_array


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_by_hand(rows):
    """(n_shingles, component id) of each row."""
    sets = [shingle_set(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = collections.defaultdict(list)
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return [(len(sets[i]), min(least[root(i)], default=None) if sets[i] else rows[i][0]) for i in range(len(rows))]


def edited(text, n, rng):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def family_rows(prose):
    rng = random.Random(3)
    texts = [None, "", " ", "a", "A", "a b", "a b c d e", "A B  c d E", "a b c d e f", "é À x y z", "é à x y z"]
    for f in range(6):
        base = prose(120, 50 + f)
        texts += [base, base.upper()] + [edited(base, k % 5, rng) for k in range(12)]
        chain = base  # neighbours are near, ends are not
        for _ in range(6):
            chain = edited(chain, 2, rng)
            texts.append(chain)
    texts += [prose(200, k) for k in range(40)] + [prose(20_000, 7), edited(prose(20_000, 7), 300, rng)]
    rng.shuffle(texts)
    return [(i, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s"), (None, texts[20], "s"), (None, "lonely words of a row without id", "s"), (4, prose(90, 12345), "s")]


def test_near_components(make, prose):
    rows = family_rows(prose)
    want = [(d, *w) for (d, _, _), w in zip(rows, near_by_hand(rows))]
    got = minhash.near_components(make(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_small_blocks_find_the_same(make, prose, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 2)
    monkeypatch.setattr(minhash, "STREAM", 3)
    monkeypatch.setattr(minhash, "SPREAD", 2)
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 0)
    rows = family_rows(prose)[:70]
    want = sorted(((d, *w) for (d, _, _), w in zip(rows, near_by_hand(rows))), key=repr)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_components(make(rows)).collect()), key=repr) == want


def test_unlike_texts_with_one_boilerplate(make, prose):
    """They fill common buckets without being similar; the similar ones among them are found."""
    boiler = prose(60, 999)
    texts = [f"{boiler} {prose(40, 5000 + i)}" for i in range(250)]
    texts += [t + " end of text" for t in texts[:5]]
    got = {r.doc_id: r.component_id for r in minhash.near_components(make(texts)).collect()}
    assert got == {i: i if i < 250 else i - 250 for i in range(255)}


def test_near_rows_that_repeat_and_clashing_columns(make, prose):
    rows = [(1, prose(40, 1), "a"), (1, prose(40, 1), "a"), (2, prose(40, 1) + " x", "a"), (None, prose(40, 1), "a"), (3, prose(15_000, 2), "a"), (4, prose(15_000, 2) + " y", "b")]
    docs = make(rows).selectExpr("*", "1 AS node", "2 AS label", "3 AS mark", "4 AS digest", "5 AS kept")
    got = minhash.near_components(docs).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == [("1", 1), ("1", 1), ("2", 1), ("3", 3), ("4", 3), ("None", 1)]


def test_near_deduplicated(make, prose):
    docs = make([(0, prose(50, 1), "a"), (1, prose(50, 1), "a"), (2, None, "a"), (3, "", "b"), (4, prose(50, 2), "b"), (4, prose(50, 1) + " x", "b")]).withColumn("id", F.lit(1)).withColumn("node", F.lit(2))
    out = minhash.deduplicated(docs)
    assert out.columns == docs.columns and sorted((r.doc_id, r.text) for r in out.where("text <> ''").collect()) == [(0, prose(50, 1)), (4, prose(50, 2))]
    assert out.count() == 4


def test_signature_agreement_estimates_similarity(prose):
    rng = random.Random(1)
    base = prose(600, 9)
    texts = [base, edited(base, 20, rng), edited(base, 60, rng), "a b c d e f g", "a b c d e f h"]
    sets = shingles.shingle_sets(pa.array(texts))
    sig = minhash.signatures(sets)
    for k in (1, 2):
        exact = len(np.intersect1d(sets[0], sets[k])) / len(np.union1d(sets[0], sets[k]))
        assert abs((sig[0] == sig[k]).mean() - exact) < 0.15
    assert (sig != 0).all()


def test_shingles_do_not_depend_on_their_neighbours(prose):
    texts = [prose(30, k) for k in range(20)] + ["", "a b", None]
    together = shingles.shingle_sets(pa.array(texts))
    assert all(np.array_equal(x, shingles.shingle_sets(pa.array([t], pa.string()))[0]) for x, t in zip(together, texts))
    assert [len(x) for x in together] == [len(shingle_set(t)) for t in texts]


def test_components_of_a_long_path(spark):
    links = spark.range(1, 60).selectExpr("id AS hub", "id - 1 AS node").where("hub <> 30")
    got = {r.node: r.label for r in minhash.components(links).collect()}
    assert got == {i: 0 if i < 30 else 30 for i in range(60)}


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(1500):
        x = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 30))]
        assert suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def repeats_by_hand(texts, w=200):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + w] for r in raws for i in range(len(r) - w + 1))
    out = []
    for r in raws:
        cover = bytearray(len(r))
        for i in range(len(r) - w + 1):
            if seen[r[i : i + w]] > 1:
                cover[i : i + w] = b"\1" * w
        runs = sum(bool(c) and (i == 0 or not cover[i - 1]) for i, c in enumerate(cover))
        out.append((len(r), sum(cover), runs, hashlib.sha256(bytes(b for b, c in zip(r, cover) if not c)).hexdigest()))
    return out


def repeat_texts(prose):
    rng = random.Random(8)
    passage, other = prose(70, 1), prose(45, 2)
    texts = [None, "", "short", "x" * 199, "x" * 200, "x" * 201, "De " * 200, "ab" * 300, passage[:200], passage, passage]
    for k in range(25):
        a = rng.randint(0, 120)
        texts.append(prose(rng.randint(5, 60), 100 + k) + " " + passage[a : a + rng.randint(190, 330)] + " " + prose(rng.randint(5, 60), 200 + k))
    base = prose(400, 5)
    texts += [edited(base, k, rng) for k in range(8)] + [other + "é" + other, "ü" * 150 + other, prose(20_000, 6), prose(20_000, 6)[3000:9000]]
    return texts


@pytest.mark.parametrize("hot, rows", [(1024, 500_000), (2, 0)])
def test_repeats(make, prose, monkeypatch, hot, rows):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "BROADCAST_ITEMS", rows)
    texts = repeat_texts(prose)
    docs = make([(i, t, "s") for i, t in enumerate(texts)]).withColumn("id", F.lit(0)).withColumn("raw", F.lit("x"))
    got = {r.doc_id: tuple(r)[1:] for r in repeats.repeat_report(docs.repartition(3)).collect()}
    for i, want in enumerate(repeats_by_hand(texts)):
        assert got[i] == want, i


def test_repeated_rows_are_repeats(make, prose):
    texts = [prose(60, 1), prose(60, 2)]
    rows = [(0, texts[0], "s"), (0, texts[0], "s"), (1, texts[1], "s"), (None, texts[1][:250], "s")]
    got = sorted((tuple(r) for r in repeats.repeat_report(make(rows)).collect()), key=repr)
    want = [(d, *w) for (d, _, _), w in zip(rows, repeats_by_hand([t for _, t, _ in rows]))]
    assert got == sorted(want, key=repr)


def test_segments_do_not_depend_on_their_neighbours(prose):
    texts = [prose(120, k) for k in range(4)] + ["x" * 250]

    def of(batch):
        data = b"".join(t.encode() for t in batch)
        return repeats.segments(np.frombuffer(data, np.uint8), np.cumsum([0, *(len(t.encode()) for t in batch)]))

    together = of(texts)
    for i, t in enumerate(texts):
        alone, own = of([t]), together[0] == i
        assert all(np.array_equal(x[own], y) for x, y in zip(together[1:], alone[1:]))


@pytest.mark.parametrize("run", [minhash.near_components, minhash.deduplicated, repeats.repeat_report])
def test_empty_tables(make, run):
    assert run(make([])).count() == 0
    assert run(make([None, ""])).count() == 2


def test_pipeline(make, prose, spark, tmp_path):
    rng = random.Random(2)
    bases = [prose(60, k) for k in range(30)]
    texts = bases + bases[:10] + [edited(b, 1, rng) for b in bases[10:20]] + [None, "too short", "again and again " * 30]
    docs = make([(i, t, f"s{i % 3}") for i, t in enumerate(texts)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == columns, name
        ids = {r.doc_id for r in kept.collect()}
        assert ids == (set(range(50)), set(range(30)) | set(range(40, 50)), set(range(30)))[k] if k < 3 else ids <= set(range(30))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = collections.Counter(r.doc_id for r in kept.collect())
    assert collections.Counter(r.doc_id for r in rows) == want and sum(r.n_tokens for r in rows) > 0
    assert all(hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 and len(r.ids) == 4 * r.n_tokens for r in rows)
