import random

from shutterlake.operators import faces


def brute(rows):
    out = []
    for photo in {r[0] for r in rows}:
        used = set()
        for a in sorted({r[1] for r in rows if r[0] == photo}):
            free = [r for r in rows if r[:2] == (photo, a) and r[2] not in used]
            if free:
                best = min(free, key=lambda r: (-r[3], r[2]))
                used.add(best[2])
                out.append(best)
    return sorted(out)


def test_greedy_matches(spark):
    rng = random.Random(1)
    rows = sorted({(rng.randrange(40), rng.randrange(6), rng.randrange(6)) for _ in range(600)})
    rows = [(*r, rng.choice([0.4, 0.5, 1.5])) for r in rows]
    df = faces.greedy_matches(spark.createDataFrame(rows, "photo_id long, annotation long, face long, score double"))
    assert sorted(map(tuple, df.collect())) == brute(rows)
    # One pass over sorted rows: no call of Python for each photo, no window.
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "InPandas" not in plan and "Window" not in plan
