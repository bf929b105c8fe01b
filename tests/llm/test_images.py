import numpy as np

from critpath.llm import images

SCHEMA = "id long, media binary, digest string, n int"


def picture(seed, size=96):
    noise = np.random.default_rng(seed).normal(0, 1, (1, size, size)).astype(np.float32)
    noise = images._box(images._box(noise, 2), 1)
    return 128 + 45 * (noise / noise.std())[0]


def test_crops_and_edits_are_found(spark):
    rng = np.random.default_rng(0)
    rows = {}
    for k in range(6):
        p = picture(k)
        rows[10 * k] = p
        rows[10 * k + 1] = p[14:84, 9:80]  # cropped
        rows[10 * k + 2] = p * 0.8 + 30  # darker and flatter
        rows[10 * k + 3] = p + rng.normal(0, 3, p.shape)  # noisy
        rows[10 * k + 4] = np.rot90(p)
        edited = p.copy()
        edited[30:50, 30:60] = 0
        rows[10 * k + 5] = edited
        rows[10 * k + 6] = p  # the same
    for k in range(40):
        rows[1000 + k] = picture(100 + k)
    data = [(i, images.encode(p), "x", 1) for i, p in rows.items()]
    data += [(2000, None, "x", 1), (2001, None, "x", 1), (2002, b"", None, None), (2003, b"P5\n3 3\n255\n123456789", None, 1), (2004, images.encode(np.full((64, 64), 7.0)), "x", 1), (0, images.encode(rows[0]), "x", 1)]
    got = images.copies(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    by = {r.id: r for r in got}
    for k in range(6):
        assert [by[10 * k + j].component_id for j in range(7)] == [10 * k] * 7
        assert by[10 * k + 6].class_id == 10 * k
    for i in [*range(1000, 1040), 2000, 2001, 2002, 2003, 2004]:
        assert by[i].component_id == i


def test_large_buckets_still_join_their_images(spark):
    p = picture(1)
    data = [(i, images.encode(p + i % 7 * 0.5 + (np.arange(96) == i)[None, :] * 1.0), "x", 1) for i in range(30)]
    got = images.copies(spark.createDataFrame(data, SCHEMA), bucket_points=3).collect()
    assert {r.component_id for r in got} == {0}


def brute_links(described, radius=2, slack=8, agree=4, shift=12):
    rows = sorted((r.id, [(p.descriptor & (1 << 64) - 1, p.check & (1 << 64) - 1, p.place) for p in r.points]) for r in described)
    side = (1 << 24) - 1
    part = lambda p: (p & side, p >> 24 & side, p >> 48 & 15, p >> 52)
    out = {}
    for a, (u, own) in enumerate(rows):
        for v, others in rows[a + 1 :]:
            cells = {}
            for d, c1, p in own:
                for e, c2, q in others:
                    if (d ^ e).bit_count() <= radius and (c1 ^ c2).bit_count() <= slack:
                        (ax, ay, at, ao), (x, y, t, o) = part(p), part(q)
                        turn = (t - at) % 16
                        c, s, k = np.cos(turn * np.pi / 8), np.sin(turn * np.pi / 8), 2.0 ** (o - ao)
                        dx, dy = (int(np.trunc(z + np.copysign(0.5, z))) for z in (x - k * (c * ax - s * ay), y - k * (s * ax + c * ay)))
                        for gy in (0, shift // 2):
                            for gx in (0, shift // 2):
                                cells.setdefault((turn, o - ao, gy, gx, (dx + gx) // shift, (dy + gy) // shift), set()).add(p)
            n = max(map(len, cells.values()), default=0)
            if n >= agree:
                out[u, v] = n
    return out


def brute_roots(links):
    root = {x: x for pair in links for x in pair}
    for _ in range(len(root)):
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    return root


def test_large_buckets_against_brute_force(spark):
    p, rng = picture(1), np.random.default_rng(3)
    data = [(i, images.encode(p[i % 4 : 80 + i % 5, i % 3 :] + rng.normal(0, 1.5, p[i % 4 : 80 + i % 5, i % 3 :].shape)), "x", 1) for i in range(24)]
    data += [(100 + k, images.encode(picture(50 + k)), "x", 1) for k in range(5)]
    described = images.describe(spark.createDataFrame(data, SCHEMA)).cache()
    want = brute_links(described.collect())
    assert len(want) > 200 and max(map(max, want)) < 100
    for how in ({}, {"bucket_points": 3}):
        assert {r.id: r.root for r in images.roots_of(described, **how).collect()} == brute_roots(want)


def test_components_are_those_of_all_links(spark):
    rng = np.random.default_rng(8)
    data = []
    for k in range(5):  # a chain: every image is a noisy crop of the one before
        p = picture(k, 140)
        for j in range(6):
            data.append((10 * k + j, images.encode(p), "x", 1))
            p = p[13:, :-12] + rng.normal(0, 9.0, (p.shape[0] - 13, p.shape[1] - 12))
    data += [(100 + k, images.encode(picture(50 + k)), "x", 1) for k in range(5)]
    described = images.describe(spark.createDataFrame(data, SCHEMA)).cache()
    want = brute_links(described.collect())
    assert 10 < len(want) < 75
    for how in ({}, {"bucket_points": 2}):
        assert {r.id: r.root for r in images.roots_of(described, **how).collect()} == brute_roots(want)


def test_flips_up_to_the_radius_are_always_matched(spark):
    rng = np.random.default_rng(2)
    place = [(20 + 7 * i << 24) + 20 + 5 * i for i in range(4)]
    rows = []
    for k in range(60):
        base = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 4)]
        flip = lambda n: [b ^ sum(1 << int(i) for i in rng.choice(63, n, replace=False)) for b in base]
        for j, d in enumerate((base, flip(k % 3), flip(2 + k % 2 * 8))):
            rows.append((10 * k + j, list(zip(d, [k] * 4, place))))
    described = spark.createDataFrame(rows, f"id long, points {images.POINTS}").cache()
    want = brute_links(described.collect())
    assert len(want) >= 90
    assert {r.id: r.root for r in images.roots_of(described).collect()} == brute_roots(want)
    points, none = described.selectExpr("id", "inline(points)"), spark.createDataFrame([], "id long, root long")
    cross = images._agreeing(images._cross_matches(points, none, 2, 8, 1024), 4, 12)
    assert {(r.u, r.v): r.n for r in cross.collect()} == want


def test_large_buckets_meet_piece_by_piece(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [(7 if rng.random() < 0.8 else int(rng.integers(0, 1 << 62)), 0, (20 + 7 * k << 24) + 20 + 5 * k) for k in range(5)]) for i in range(60)]
    described = spark.createDataFrame(rows, f"id long, points {images.POINTS}").cache()
    want = brute_links(described.collect())
    points = described.selectExpr("id", "inline(points)")
    batch_rows(spark, 8)
    assert {r.id: r.root for r in images.roots_of(described, bucket_points=16).collect()} == brute_roots(want)
    none = spark.createDataFrame([], "id long, root long")
    cross = images._agreeing(images._cross_matches(points, none, 2, 8, 16), 4, 12)
    assert {(r.u, r.v): r.n for r in cross.collect()} == want
    batch_rows(spark, 2000)


def batch_rows(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def test_large_images_have_corners_all_over(spark):
    big = np.full((700, 9300), 128.0)
    big[300:396, 9100:9196] = picture(3)
    big[200:296, 100:196] = picture(4)
    data = [("a", images.encode(big), "x", 1), ("b", images.encode(picture(3)), "x", 1), ("c", images.encode(picture(4)), "x", 1), ("d", images.encode(picture(5)), "x", 1)]
    got = images.copies(spark.createDataFrame(data, "id string, media binary, digest string, n int")).collect()
    assert {r.id: r.component_id for r in got} == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_no_rows(spark):
    assert images.copies(spark.createDataFrame([], SCHEMA)).count() == 0
    assert images.rendered(spark.createDataFrame([(1, None), (2, [0.0, None])], "id long, vector array<float>")).where("media is null").count() == 2
