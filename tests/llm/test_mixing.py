import random
import re

import pytest

from tidewire.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Targets by repeated sharing, in order of sources."""
    weights = [[3, 1, 2][i % 3] for i in range(len(sizes))]
    total, fixed = 1.5 * sum(sizes), {}
    while True:
        rest, w = total - sum(fixed.values()), sum(x for i, x in enumerate(weights) if i not in fixed)
        now = [fixed.get(i, rest * weights[i] / w if w else 0) for i in range(len(sizes))]
        over = [i for i in range(len(sizes)) if i not in fixed and now[i] > 2 * sizes[i]]
        if not over:
            return now
        fixed |= {i: 2.0 * sizes[i] for i in over}


def build(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_takes(spark, seed, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 16)
    monkeypatch.setattr(M, "BUCKET", 10)
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["src1", "src1", "src1", "b", "Z", "é", None, "tiny"]), "x") for i in range(300)]
    rows += [(300, None, "b", "x"), (301, "only\tone", "lonely", "x"), (301, "only\tone", "lonely", "x"), (302, "", "empty", None)]
    df = build(spark, rows)
    out = M.mix(df, block=16)
    got = out.documents.collect()
    assert len(got) == len(rows)
    by: dict = {}
    for r in got:
        s = by.setdefault(r.source, [0, r.target, 0, r.source_size])
        s[0] += r.size
        s[2] += r.taken_1 + r.taken_2
        assert r.taken_1 <= r["size"] and r.taken_2 <= r["size"]
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    for name, want in zip(names, targets([by[n][0] for n in names])):
        size, target, taken, told = by[name]
        assert told == size and abs(target - want) < 1e-6 and abs(taken - want) <= 0.5 + 1e-6
    # slots of a source take its blocks in order, and every block once
    slots = sorted(out.schedule.collect(), key=lambda r: (r.source_no, r.slot))
    for no in {r.source_no for r in slots}:
        assert [r.block for r in slots if r.source_no == no] == list(range(sum(r.source_no == no for r in slots)))
    again = M.op2_mixing(df.repartition(7)).collect()
    assert sorted(map(tuple, M.op2_mixing(df).collect())) == sorted(map(tuple, again))


def test_schedule_is_even(spark):
    """Any stretch of the schedule holds each source close to its share."""
    df = build(spark, [(i, " ".join(["w"] * 64), "abc"[i % 3], "") for i in range(300)])
    out = M.mix(df, block=16)
    slots = [r.source_no for r in sorted(out.schedule.collect(), key=lambda r: r.slot)]
    n = len(slots)
    for no in (1, 2, 3):
        share = slots.count(no) / n
        for at in range(0, n - 120, 60):
            assert abs(slots[at : at + 120].count(no) - 120 * share) <= 4


def test_empty(spark):
    assert M.op2_mixing(build(spark, [(1, "a", "s", "")]).limit(0)).count() == 0
    got = M.op2_mixing(build(spark, [(1, None, None, ""), (2, "", "s", "")])).collect()
    assert {(r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in got} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}
