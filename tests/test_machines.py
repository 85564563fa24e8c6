"""Transfers chained over any chunking must equal the plain fold (no Spark needed)."""

import random
from dataclasses import replace

import numpy as np
import pytest

from poselytics.operators.lifecycle import LifecycleMachine
from poselytics.operators.reset_map import reset_map
from poselytics.operators.session_fold import SessionFoldMachine, SessionState


def _chunks(rng, n):
    cuts = sorted(rng.sample(range(1, n), min(n - 1, rng.randint(0, 6))))
    return list(zip([0, *cuts], [*cuts, n]))


def _check(machine, rows, rng, strip=lambda s: s):
    n = len(rows["ts_us"])
    plain = None
    chained = None
    for lo, hi in _chunks(rng, n):
        part = {k: v[lo:hi] for k, v in rows.items()}
        transfer = machine.transfer(part)
        after = machine.apply(transfer, chained)
        plain = machine.run(plain, rows, lo, hi, None)
        if after is None:  # too coarse: replayed with the real entry state
            after = plain
        assert strip(after) == strip(plain), (lo, hi)
        chained = after


def _times(rng, n, scale, inversions):
    out, now = [], 1_000_000
    for _ in range(n):
        now += rng.choice([0, 1, 33_333, scale, rng.randint(0, 3 * scale)])
        out.append(now + (rng.randint(-900, 0) if inversions else 0))
    return out


@pytest.mark.parametrize("seed", range(300))
def test_session_fold_chunks(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 120)
    success = rng.choice([("s1", "s2", "s3", "s1"), ("s1",), ("s1", "s2"), ("s2", "s1", "s3")])
    limit = rng.choice([0, 400_000, 1_500_000, 5_000_000])
    sticky = rng.random()
    states, current = [], "s1"
    for _ in range(n):
        if rng.random() > sticky:
            current = rng.choice(["s1", "s2", "s3", None, "x"])
        states.append(current)
    bad = [rng.random() < 0.3 for _ in range(n)]
    rows = {
        "ts_us": _times(rng, n, 200_000, seed % 3 == 0),
        "bad_posture": bad,
        "state": [None if b else s for s, b in zip(states, bad)],
        "critical": [not b and rng.random() < 0.1 for b in bad],
        "session_exercise": ["e"] * n,
        "session_level": [0] * n,
    }
    machine = SessionFoldMachine({("e", 0): (success, limit)})
    _check(machine, rows, rng, lambda s: replace(s, correct=0, incorrect=0))


@pytest.mark.parametrize("seed", range(300))
def test_lifecycle_chunks(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 120)
    share = rng.choice([0.02, 0.2, 0.9])
    rows = {
        "ts_us": _times(rng, n, 300_000, seed % 3 == 0),
        "is_complete": [rng.random() < share for _ in range(n)],
        "exercise": [rng.choice("ab") for _ in range(n)],
        "level": [0] * n,
    }
    machine = LifecycleMachine(
        timeout_s=rng.choice([0.5, 0.85, 300]),
        grace_s=rng.choice([0.4, 2, 10]),
        state_ttl_s=rng.choice([None, 0.5]),
    )
    _check(machine, rows, rng)


def test_reset_map_is_compact_for_a_regular_frame_rate():
    # 30 frames a second for ten hours: windows never fall into step, yet few pieces are needed
    steps = np.full(30 * 36_000, 33_333, dtype=np.int64)
    described = reset_map(steps, 2_500_000)
    assert len(described.sums) < 200
    acc = resets = 0
    for s in steps.tolist():
        acc += s
        if acc >= 2_500_000:
            acc, resets = 0, resets + 1
    assert described.exit(0, 2_500_000) == (acc, resets)


def test_too_many_pieces_leave_the_chunk_open():
    steps = np.ones(80_000, dtype=np.int64)
    described = reset_map(steps, 60_000)
    assert described.exit(60_000 - 10_000, 60_000) == (10_000, 2)
    assert described.exit(0, 60_000) is None
    assert reset_map(steps, 90_000).exit(100, 90_000) == (80_100, 0)


def test_initial_state():
    start = SessionState()
    assert start.curr_state == "s1" and start.state_seq == () and start.last_us is None
