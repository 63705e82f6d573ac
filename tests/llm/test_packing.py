import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from voxloom.llm import packing as P


def one_by_one(lengths, capacities, cost):
    """Best fit of single pieces in falling order; a bin opens by a trial of every capacity on what no trial has claimed."""
    bins, clock = [], 0
    todo = sorted(lengths, reverse=True)
    free = Counter(lengths)
    while todo:
        length = todo[0]
        fit = [b for b in bins if b["room"] >= length]
        if fit:
            b = min(fit, key=lambda b: (b["room"], b["since"]))
            b["room"] -= length
            clock += 1
            b["since"] = clock
            b["inside"].append(length)
            todo.pop(0)
            continue
        free[length] = todo.count(length)
        best = None
        for c in sorted(capacities):
            if c < length:
                continue
            room, inside = c, []
            for x in sorted(free.elements(), reverse=True):
                if x <= min(room, length):
                    inside.append(x)
                    room -= x
            key = (cost(c) / sum(inside), c)
            if best is None or key < best[0]:
                best = key, c, inside
        free.subtract(best[2])
        clock += 1
        bins.append({"room": best[1], "since": clock, "capacity": best[1], "inside": []})
    return bins


def paid(bins, capacities, cost):
    return sum(cost(next(c for c in sorted(capacities) if c >= sum(b))) for b in bins)


def least_paid(lengths, capacities, cost):
    """The cheapest packing, by trying all."""
    lengths = sorted(lengths, reverse=True)
    best = [float("inf")]

    def place(k, bins):
        if k == len(lengths):
            best[0] = min(best[0], paid(bins, capacities, cost))
            return
        for b in bins:
            if sum(b) + lengths[k] <= max(capacities):
                b.append(lengths[k])
                place(k + 1, bins)
                b.pop()
        bins.append([lengths[k]])
        place(k + 1, bins)
        bins.pop()

    place(0, [])
    return best[0]


def planned(lengths, capacities, cost):
    """The contents of each bin of the plan, and the capacities that it opens before bins shrink."""
    placements, bins = P.plan(Counter(lengths), capacities, cost)
    inside = defaultdict(list)
    for length, a, b, first, _, per in placements:
        for k in range(b - a + 1):
            inside[first + k // per].append(length)
    return inside, {k: c for a, b, c in bins for k in range(a, b + 1)}


def quadratic(c):
    return c * (1 + c / 200) + 1.0


def test_the_plan_is_that_of_single_pieces():
    rng = random.Random(3)
    for n in (1, 5, 30, 120):
        for _ in range(25):
            capacities = (8, 20, 64)
            lengths = [rng.choice([1, 2, 3, 5, 8, 13, 30, 64]) if rng.random() < 0.5 else rng.randint(1, 64) for _ in range(n)]
            inside, _ = planned(lengths, capacities, quadratic)
            assert sorted(x for b in inside.values() for x in b) == sorted(lengths)
            want = one_by_one(lengths, capacities, quadratic)
            assert sorted(sum(b) for b in inside.values()) == sorted(sum(b["inside"]) for b in want)


def test_the_plan_costs_little_more_than_the_least():
    rng = random.Random(4)
    paid_all = least_all = 0.0
    for _ in range(40):
        lengths = [rng.randint(1, 40) for _ in range(7)]
        inside, _ = planned(lengths, (8, 20, 64), quadratic)
        paid_all += paid(inside.values(), (8, 20, 64), quadratic)
        least_all += least_paid(lengths, (8, 20, 64), quadratic)
    assert paid_all <= 1.15 * least_all


def test_every_capacity_is_opened_where_it_costs_least():
    lengths = [8000] * 3 + [2000] * 7 + [500] * 50 + [100] * 5
    placements, bins = P.plan(Counter(lengths), P.CAPACITIES)
    opened = Counter()
    for length, a, b, _, offset, per in placements:
        if offset == 0:
            opened[length] += (b - a + 1) // per
    sizes = Counter()
    for a, b, c in bins:
        sizes[c] += b - a + 1
    assert sizes[8192] == 3 and sizes[2048] == 7 and sizes[512] == 51
    assert opened == {8000: 3, 2000: 7, 500: 50, 100: 1}
    # full large bins where the cost is flat and the fixed share counts
    _, bins = P.plan(Counter([500] * 64), P.CAPACITIES, lambda c: c + 16.0)
    assert {c for *_, c in bins} == {8192}


def check(rows, capacities):
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin_id].append((r.bin_offset, r.length, r.bin_capacity))
    for inside in bins.values():
        at = 0
        for offset, length, capacity in sorted(inside):
            assert offset == at
            at += length
        assert len({c for _, _, c in inside}) == 1 and capacity == next(c for c in sorted(capacities) if c >= at)
    return sorted(x[0][2] for x in bins.values())


def test_against_one_by_one(spark):
    rng = random.Random(5)
    capacities = (8, 20, 64)
    for n in (1, 7, 60, 400):
        sizes = [rng.choice([1, 2, 3, 5, 8, 13, 30, 64, 65, 150]) if rng.random() < 0.5 else rng.randint(1, 90) for _ in range(n)]
        df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, s long")
        rows = P.best_fit_packing(spark, df, capacities, F.col("s")).collect()
        pieces = [x for s in sizes for x in [64] * ((s - 1) // 64) + [(s - 1) % 64 + 1]]
        assert sorted(r.length for r in rows) == sorted(pieces)
        want = one_by_one(pieces, capacities, P.bin_cost)
        assert check(rows, capacities) == sorted(next(c for c in capacities if c >= sum(b['inside'])) for b in want)
        whole = defaultdict(int)
        for r in rows:
            whole[r.doc_id] += r.length
            assert r.piece_start == r.piece * 64
        assert [whole[i] for i in range(n)] == sizes


def test_texts_nulls_ties_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 3), (1, "", 3), (None, "é" * 5000, 3), (2, "same", 3), (2, "same", 3)], "doc_id long, text string, length int")
    rows = P.best_fit_packing(spark, df).collect()
    assert sorted(r.length for r in rows) == [1, 1, 5, 5, 1809, 8192]
    check(rows, P.CAPACITIES)
    assert P.best_fit_packing(spark, df.where("false")).collect() == []


def test_the_plan_stays_small():
    rng = random.Random(1)
    histogram = {n: rng.randint(1, 10**9) for n in range(1, 8193)}
    placements, bins = P.plan(histogram, P.CAPACITIES)
    assert len(placements) < 200_000 and len(bins) < 50_000
    assert sum(b - a + 1 for _, a, b, *_ in placements) == sum(histogram.values())
