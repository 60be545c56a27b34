import random

from shutterlake.operators.graph import connected_components


def brute(edges):
    label = {}
    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
