"""Patch dictionaries: planted patches, and the rounds against taking the best window one at a time."""

import numpy as np

from tessella.operators import patches


def frame(spark, images):
    rows = [(k, 0, y, x, float(v)) for k, g in enumerate(images) for y, line in enumerate(g) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "image_id long, c int, y int, x int, v double")


def greedy(images, side, least):
    found, uses = [], {}
    for k, g in enumerate(images):
        for y in range(g.shape[0] - side + 1):
            for x in range(g.shape[1] - side + 1):
                content = tuple(g[y : y + side, x : x + side].ravel().tolist())
                if min(content) < max(content):
                    uses[content] = uses.get(content, 0) + 1
                    found.append((content, k, y, x))
    taken = []
    for content, k, y, x in sorted((f for f in found if uses[f[0]] >= least), key=lambda f: (-uses[f[0]], f[0], f[2], f[3], f[1])):
        if not any(k == b and abs(y - c) < side and abs(x - d) < side for _, b, c, d in taken):
            taken.append((content, k, y, x))
    return {(k, y, x, content, uses[content]) for content, k, y, x in taken}


def test_rounds_are_one_after_another(spark):
    r = np.random.default_rng(5)
    images = [r.integers(0, 3, (9, 11)) // 2 * 50 for _ in range(3)]
    for side, least in ((2, 3), (3, 2)):
        got = patches.placements(frame(spark, images), 11, 9, side, least).collect()
        assert {(x["image_id"], x["y"], x["x"], tuple(map(int, x["content"])), x["uses"]) for x in got} == greedy(images, side, least)


def test_planted_patches_are_found_and_come_back(spark):
    r = np.random.default_rng(8)
    patch = np.arange(1, 17).reshape(4, 4) * 10
    images = [r.integers(0, 250, (16, 16)) for _ in range(4)]
    places = [(k, y, x) for k in range(4) for y, x in ((1, 2), (9, 7))]
    for k, y, x in places:
        images[k][y : y + 4, x : x + 4] = patch
    cells = frame(spark, images)
    taken = patches.placements(cells, 16, 16, 4, 5)
    assert {(x["image_id"], x["y"], x["x"]) for x in taken.collect()} == set(places)
    left = patches.subtract(cells, taken, 4)
    by_place = {(v["image_id"], v["y"], v["x"]): v["v"] for v in left.collect()}
    assert all(by_place[k, y + i, x + j] == 0 for k, y, x in places for i in range(4) for j in range(4)) and len(by_place) == 4 * 256
    assert patches.subtract(left, taken, 4, 1).exceptAll(cells).count() == 0
    assert patches.placements(cells.where("false"), 16, 16, 4, 5).count() == 0
