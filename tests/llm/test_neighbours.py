import math

import numpy as np

from tidemark.llm.neighbours import near_vectors


def brute(rows, threshold=0.9):
    ok = [v is not None and len(v) > 0 and None not in v and all(map(math.isfinite, v)) and any(v) for _, v in rows]
    cos = [[i != j and ok[i] and ok[j] and len(p) == len(q) and float(np.dot(p, q)) / np.linalg.norm(p) / np.linalg.norm(q) >= threshold for j, (_, q) in enumerate(rows)] for i, (_, p) in enumerate(rows)]
    low = [i for i, _ in rows]
    for _ in rows:
        low = [min([low[i], *(low[j] for j in range(len(rows)) if cos[i][j])]) for i in range(len(rows))]
    return {i: (sum(cos[k]), low[k]) for k, (i, _) in enumerate(rows)}


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(150):
        rows.append((i, rng.normal(size=16).tolist()))
    centre = rng.normal(size=16)
    for i in range(150, 230):
        rows.append((i, (centre + rng.normal(size=16) * 0.1).tolist()))
    for i in range(230, 260):
        rows.append((i, (np.array(rows[i - 230][1]) * 3 + rng.normal(size=16) * 0.2).tolist()))
    rows += [(i, rows[3][1]) for i in range(260, 300)]
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [1.0, None] + [0.0] * 14), (304, [math.nan] * 16), (305, [math.inf] * 16), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (308, [1e-200] * 16), (309, [1e200] * 16)]
    df = spark.createDataFrame([(i, v, "l") for i, v in rows], "vec_id long, embedding array<double>, component_id string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df).collect()}
    want = brute(rows[:308])
    want |= {308: (1, 308), 309: (1, 308)}
    assert got == want


def test_dense_groups_joined_by_one_link(spark):
    rng = np.random.default_rng(6)

    def turned(degrees):  # from the first axis towards the second
        v = np.zeros(16)
        v[:2] = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
        return v

    def group(degrees):
        noise = rng.normal(size=(150, 16)) * [0, 0, *[0.02] * 14]
        return [(turned(degrees) + x).tolist() for x in noise]

    rows = list(enumerate(group(0) + group(40) + [turned(12).tolist(), turned(28).tolist()]))
    want = brute(rows)
    # The link lies behind 150 nearer vectors on both sides.
    assert {c for _, c in want.values()} == {0} and want[300][0] == want[301][0] == 151
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df).collect()} == want


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
