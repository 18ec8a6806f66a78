"""Interval sets and admission against sets of lines."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.operators.source_ranges import Admission, LineSet, admit_ranges, longest_fit, merge_in_phase

SPANS = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 12)), max_size=25)


@given(SPANS, st.integers(0, 60), st.integers(0, 20))
@settings(max_examples=200, deadline=None)
def test_line_set_is_a_set_of_lines(spans, first, width):
    held, lines = LineSet(), set()
    for s, n in spans:
        held.add(s, s + n)
        lines |= set(range(s, s + n + 1))
    asked = set(range(first, first + width + 1))
    assert [x for s, e in held for x in range(s, e + 1)] == sorted(lines)
    assert all(b > a + 1 for a, b in zip(held.lasts, held.firsts[1:]))
    assert {x for s, e in held.missing(first, first + width) for x in range(s, e + 1)} == asked - lines
    assert held.covers(first, first + width) == (asked <= lines)


def by_lines(ranges, budget):
    """Admission written out over sets of lines."""
    room, shown, out = budget, {}, []
    for name, file, first, costs, atomic, centred in ranges:
        lines = shown.setdefault(file, set())
        free = [x for x in range(first, first + len(costs)) if x not in lines]
        cost = lambda xs: sum(costs[x - first] for x in xs)  # noqa: E731, B023
        if atomic and cost(free) > room:
            continue
        pieces = []
        for x in free:
            if pieces and pieces[-1][-1] == x - 1:
                pieces[-1].append(x)
            else:
                pieces.append([x])
        for piece in pieces:
            fits = [n for n in range(len(piece) + 1) if cost(piece[(len(piece) - n) // 2 if centred else 0 :][:n]) <= room]
            n = max(fits)
            part = piece[(len(piece) - n) // 2 if centred else 0 :][:n]
            room -= cost(part)
            lines |= set(part)
            out += [(name, file, x) for x in part]
            if n < len(piece):
                break
    return out, budget - room


def made(seed, n=60):
    rng = random.Random(seed)
    return [(f"r{i}", f"f{rng.randrange(3)}", rng.randrange(80), [rng.randrange(1, 5) for _ in range(rng.randrange(1, 30))], rng.random() < 0.2, rng.random() < 0.3) for i in range(n)]


@pytest.mark.parametrize("seed", range(8))
def test_admission_equals_sets_of_lines(spark, seed):
    tasks = {f"t{k}": made(seed * 10 + k) for k in range(4)}
    rows = [(t, name, file, first, costs, atomic, centred, place) for t, ranges in tasks.items() for place, (name, file, first, costs, atomic, centred) in enumerate(ranges)]
    df = spark.createDataFrame(rows, "task string, id string, file_path string, first long, costs array<int>, atomic boolean, centred boolean, place int").repartition(5)
    got = admit_ranges(df, 150, ["place"]).collect()
    for t, ranges in tasks.items():
        mine = [r for r in got if r.task == t]
        want, spent = by_lines(ranges, 150)
        lines = [(r.id, r.file_path, x) for r in mine for x in range(r.first, r.last + 1)]
        assert sorted(lines) == sorted(want) and max(r.spent for r in mine) == spent <= 150
        assert len({x[1:] for x in lines}) == len(lines)


def test_what_is_not_shown_hides_nothing():
    held = Admission(50)
    assert list(held.take("f", 1, [10] * 100, True, False)) == []
    assert list(held.take("f", 5, [1] * 10, False, False)) == [(5, 14, 10)]
    assert list(held.take("f", 1, [1] * 20, False, False)) == [(1, 4, 4), (15, 20, 6)]
    assert list(held.take("f", 1, [1] * 20, True, False)) == [] and held.room == 30


def test_longest_fit():
    assert longest_fit([3, 3, 3], 7, False) == (0, 2) and longest_fit([3, 1, 3], 2, True) == (1, 1) and longest_fit([9], 2, False)[1] == 0 and longest_fit([], 2, True) == (0, 0)


def test_merged_phases_by_lines(spark):
    rng = random.Random(5)
    rows = [("t", f"f{rng.randrange(2)}", rng.randrange(2), f"r{i}", s := rng.randrange(200), s + rng.randrange(12), i, rng.random() < 0.5) for i in range(120)]
    got = merge_in_phase(spark.createDataFrame(rows, "task string, file_path string, phase int, id string, first long, last long, place int, atomic boolean")).collect()
    for key in {(r[1], r[2]) for r in rows}:
        mine = sorted((r.first, r.last, r.id, r.place, r.atomic) for r in got if (r.file_path, r.phase) == key)
        assert all(a[1] < b[0] for a, b in zip(mine, mine[1:]))
        for first, last, name, place, atomic in mine:
            held = [r for r in rows if (r[1], r[2]) == key and first <= r[4] <= last]
            assert {x for r in held for x in range(r[4], r[5] + 1)} == set(range(first, last + 1))
            assert (place, name) == min((r[6], r[3]) for r in held) and atomic == all(r[7] for r in held)
