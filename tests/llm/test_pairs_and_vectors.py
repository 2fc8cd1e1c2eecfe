"""Operators 11 to 13 against brute force."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from scopeforge.llm import hard_negatives, simhash_pivots, whitening


# -- operator 11 -------------------------------------------------------------

def brute_negatives(rows, scale=256):
    """rows: (vec_id, label, vector); ids may be null."""
    part = []
    for vec_id, label, vector in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        part.append((vec_id, label, [math.floor(scale * float(x)) for x in vector]))
    order = lambda hit: (-hit[0], hit[1] is None, hit[1] or 0)
    out = []
    for i, (vec_id, label, v) in enumerate(part):
        if vec_id is None or vec_id % 50:
            continue
        hits = [(sum(a * b for a, b in zip(v, w)), other, own) for j, (other, own, w) in enumerate(part) if j != i]
        for ps, pid, _ in sorted([h for h in hits if h[2] == label], key=order)[:5]:
            found = sorted([h for h in hits if h[2] != label and 50 * ps <= 100 * h[0] <= 95 * ps], key=order)[:3]
            out += [(vec_id, pid, r + 1, nid, ps, ns) for r, (ns, nid, _) in enumerate(found)]
    return sorted(out, key=str)


def mined(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                                       "negative_score").collect()), key=str)


def test_negatives_of_the_table(spark, sf_dir):
    rows = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pylist()
    want = brute_negatives([(r["vec_id"], r["label"], r["embedding"]) for r in rows])
    assert want and mined(hard_negatives.op11_angular_negatives(spark, sf_dir)) == want


@pytest.mark.parametrize("block", [64, 512])
def test_negatives_of_clusters_in_many_blocks(spark, tmp_path, monkeypatch, block):
    """Vectors of unequal norms in tight clusters, so that blocks and windows are skipped."""
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", (block, block))
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 8)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 16))
    of = rng.integers(0, 12, 1500)
    v = (centre[of] + 0.15 * rng.normal(size=(1500, 16))) * rng.uniform(0.1, 3, (1500, 1))
    v[7::100] = 0
    v[13::90] = v[13]
    rows = [(i if i % 97 else None, int(of[i] % 4), [float(x) for x in v[i]]) for i in range(1500)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5).write.parquet(
        str(tmp_path / "embeddings.parquet"))
    assert mined(hard_negatives.op11_angular_negatives(spark, str(tmp_path))) == brute_negatives(rows)


def test_bounds_hold_and_skip():
    """Every score lies in the bounds; far clusters are not scored."""
    import pyarrow as pa
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=(300, 8)) * 5 + 100 * np.eye(8)[i] for i in (0, 3)]).round().astype(np.int64)
    norm = np.linalg.norm(v, axis=1)
    refs = np.eye(8)[[0, 3]]
    angle = hard_negatives._angles(v, norm, refs)
    block = hard_negatives.Block(pa.table({
        "angles": [a.tobytes() for a in angle], "vec": [x.tobytes() for x in v], "norm": norm, "rid": np.arange(600),
        "label": np.zeros(600, np.int64), "vec_id": np.arange(600)}), 8)
    for low, high in ((-1e9, 1e9), (2000, 1e9), (5000, 9000), (-50, 50)):
        for i in (0, 299, 300, 599):
            kept = set(block.rid[block.overlap(norm[i], angle[i], low, high)])
            score = v @ v[i]
            assert set(np.flatnonzero((score >= low) & (score <= high))) <= kept
    assert len(block.overlap(norm[0], angle[0], 5000, 1e9)) == 300


def test_window_is_exact():
    for score in range(0, 400):
        low, high = hard_negatives.window(score)
        assert [s for s in range(0, 400) if 50 * score <= 100 * s <= 95 * score] == list(range(low, high + 1))


# -- operator 12 -------------------------------------------------------------

def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, radius=2):
    label = list(range(len(values)))
    for i, x in enumerate(values):
        for j in range(i):
            if (x ^ values[j]).bit_count() <= radius and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if n == old else n for n in label]
    return label


def test_simhash_of_the_table(spark, sf_dir, texts):
    got = {r.doc_id: r for r in simhash_pivots.op12_simhash_pivots(spark, sf_dir).collect()}
    ids = sorted(texts)
    prints = [brute_fingerprint(texts[i]) for i in ids]
    assert [got[i].fingerprint for i in ids] == [f"{p:016x}" for p in prints]
    label = brute_components(prints)
    assert [got[i].component_id for i in ids] == [ids[n] for n in label]
    assert len(set(label)) < len(ids)


def test_spark_hashes_shingles_alike(spark):
    row = spark.sql("SELECT xxhash64('a b c') AS h, xxhash64('') AS e").first()
    assert row.h & (1 << 64) - 1 == int(simhash_pivots.shingle_hashes(b" A b\tc ")[0])
    assert len(simhash_pivots.shingle_hashes(b"")) == 0


@pytest.mark.parametrize("block", [40, 10_000])
def test_links_of_clustered_fingerprints(spark, monkeypatch, block):
    """Random fingerprints, balls around some, and chains of close ones; many cells and blocks."""
    monkeypatch.setattr(simhash_pivots, "CELL", (64, 64))
    monkeypatch.setattr(simhash_pivots, "BLOCK", block)
    monkeypatch.setattr(simhash_pivots, "SMALL", 64)
    rng = np.random.default_rng(3)
    values = [int(x) for x in rng.integers(0, 1 << 63, 500)]
    for centre in values[:3]:
        for _ in range(120):
            x = centre
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(bit)
            values.append(x)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(s,) for s in signed], "fp long")
    pairs = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash_pivots.links(prints, len(values)).collect()]
    place = {v: i for i, v in enumerate(values)}
    assert all((a ^ b).bit_count() <= 64 for a, b in pairs)
    label = list(range(len(values)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for a, b in pairs:
        x, y = sorted((root(place[a]), root(place[b])))
        label[y] = x
    assert [root(i) for i in range(len(values))] == brute_components(values)


def test_every_close_pair_meets_once_at_home():
    rng = np.random.default_rng(9)
    fp = rng.integers(0, 1 << 63, 600).astype(np.uint64)
    fp = np.unique(np.concatenate([fp, fp[:300] ^ np.uint64(5), fp[:300] ^ np.uint64(1 << 40)]))
    pivots = simhash_pivots.choose_pivots(fp)
    table = simhash_pivots.distances(fp, pivots)
    nodes = simhash_pivots.draw_tree(table, 0.02)
    row, cell, home = simhash_pivots.deal(nodes, table)
    assert sorted(row[home]) == list(range(len(fp)))
    meet = {}
    for r, c, h in zip(row, cell, home):
        meet.setdefault(c, []).append((r, h))
    times = {}
    for members in meet.values():
        for i, (r, h) in enumerate(members):
            for s, g in members[:i]:
                if h or g:
                    times[frozenset((r, s))] = times.get(frozenset((r, s)), 0) + 1
    close = [frozenset((i, j)) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 2]
    assert len(close) >= 600 and all(times.get(p) == 1 for p in close)
    assert len(meet) > 8


# -- operator 13 -------------------------------------------------------------

def exact_x(vector):
    return tuple(math.floor(64 * float(c)) + 1_000_000 for c in vector)


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_whitening_against_numpy(spark, sf_dir, tmp_path, weights):
    rows = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pylist()
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in rows]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000, None), (2001, [float("nan")] * 64), (2002, [None] * 64),
                                                          (2003, [math.inf] + [0.0] * 63), (2004, [0.5]), (2005, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = whitening.whiten(df, weights=weights).collect()
    x = {i: exact_x(v) for i, v in rows if v and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)}
    fit = list(x.values()) if weights == "counts" else sorted(set(x.values()))
    n, sums = len(fit), [sum(v[d] for v in fit) for d in range(64)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 16 * len(x) and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-9
    sign = {}
    for r in got:
        assert r.deviation == sum((n * c - s) ** 2 for c, s in zip(x[r.vec_id], sums))
        want = (np.array(x[r.vec_id], float) - np.array(sums) / n) @ vectors[:, r.component - 1] / math.sqrt(values[r.component - 1])
        if abs(want) > 1e-3:
            assert sign.setdefault(r.component, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
        assert abs(abs(want) - abs(r.whitened)) < 1e-8
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-10


def test_whitening_of_few_vectors(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<double>")).collect()
    assert len(one) == 6 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained == 0 for r in one)
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.component, r.whitened and round(abs(r.whitened), 9)) for r in two) == [
        (1, 1, 1.0), (1, 2, None), (2, 1, 1.0), (2, 2, None)]


def test_deviations_beyond_doubles():
    x = np.array([[10 ** 6 + 3, 10 ** 6], [10 ** 6 - 900, 10 ** 6 + 7]], np.int64)
    sums = [10 ** 12 + 17, 10 ** 12 - 5]
    n = 10 ** 6
    assert whitening.deviations(x, n, sums) == [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    assert whitening.deviations(x * 1000, 10 ** 9, [0, 0]) == [None, None]
