import numpy as np
import xxhash

from critpath.llm import simhash
from critpath.operators.components import components

SCHEMA = "doc_id long, text string, fp string, u int"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps):
    """Component of each row by comparing all pairs."""
    label = list(range(len(fps)))
    for _ in range(len(fps)):
        before = list(label)
        for i in range(len(fps)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= 4:
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            return label


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 50, n)) for n in (400, 90, 7, 4, 3, 1)]
    rows = [(i, base[i % 6] + (f" extra{i // 6}" if i > 11 else ""), "x", 1) for i in range(60)]
    rows += [(100, None, "x", 1), (101, "", None, 1), (102, " \t\n", "x", None), (7, "dup É", "x", 1), (7, "dup É", "x", 1), (None, base[0], "x", 1), (200, "y " * 30000, "x", 1)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    fps = [plain_fingerprint(t) for _, t, _, _ in rows]
    label, want = brute(fps), []
    for i, (d, _, _, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        want.append((d, fps[i] - (1 << 64) if fps[i] >> 63 else fps[i], min(own, default=None)))
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, want))


def test_links_connect_all_close_pairs(spark):
    """Dense clusters, above the bucket limit, so that buckets are split."""
    rng = np.random.default_rng(6)
    fps = set(rng.integers(0, 1 << 62, 300).tolist())
    for centre in list(fps)[:3]:
        for _ in range(150):
            fps.add(centre ^ sum({1 << int(b) for b in rng.integers(0, 62, int(rng.integers(1, 5)))}))
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for limit in (100, 10_000):
        roots = {r.node: r.root for r in components(simhash.links(df, bucket_rows=limit)).collect()}
        a = np.array(fps)
        close = np.bitwise_count(a[:, None] ^ a[None, :]) <= 4
        reach = np.arange(len(a))
        while True:
            new = np.array([reach[close[i]].min() for i in range(len(a))])
            if (new == reach).all():
                break
            reach = new
        assert [roots.get(x, x) for x in fps] == [fps[i] for i in reach]


def test_every_bit_counts(spark):
    """Fingerprints that differ in any four bits, the sign bit among them, by pivots alone and in buckets."""
    rng = np.random.default_rng(9)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 40)}
    for centre in sorted(fps):
        fps.add(centre ^ 1 << 63 ^ sum({1 << int(b) for b in rng.integers(0, 63, 3)}))
    fps = sorted(fps)
    want = [fps[i] for i in brute(fps)]
    assert len(set(want)) == 40
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    roots = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    assert len({roots.get(x, x) for x in signed}) == 40 and len(roots) == 80
    u = np.array(fps, np.uint64)
    far = simhash.pivot_table(u, 16, 7)
    order = np.lexsort((u, far[:, 0]))
    a, b = simhash._link_runs(np.zeros(80, int), np.zeros(80, int), u[order], far[order], 4)
    assert len(a) == 40 and (np.bitwise_count(a ^ b) <= 4).all()


def test_ids_of_any_type_and_frequent_texts(spark):
    rows = [(f"d{i:04}", "the very same words in each of these", "x", 1) for i in range(1500)] + [(f"e{i:04}", f"a text of its own {i} {i * 7919} {i * 31}", "x", 1) for i in range(600)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string, fp string, component_id int"))
    by = {r.doc_id: r.component_id for r in got.collect()}
    assert len(by) == 2100 and {by[f"d{i:04}"] for i in range(1500)} == {"d0000"}
    assert sum(by[f"e{i:04}"] == f"e{i:04}" for i in range(600)) > 500


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_no_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
