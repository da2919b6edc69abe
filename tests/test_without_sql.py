"""Queries that SQL cannot express, against plain Python on the smallest tables."""

import math

import numpy as np
import pytest
import xxhash
from scenespark.plans import registry
from scenespark.plans.fixtures import fixture

registry.load()
SF = "/root/testdata/sf0.001"


def _hash(*parts) -> int:
    """Spark's 64-bit hash of longs and 32-bit integers, one after another; parts are (value, bytes)."""
    h = 42
    for value, size in parts:
        h = xxhash.xxh64_intdigest(int(value).to_bytes(size, "little", signed=True), h)
    return h - 2**64 if h >> 63 else h


def _uniform(*parts) -> int:
    return _hash(*parts) % (1 << 40)


def _pairs(spark):
    ref = {r.frame_id: r for r in fixture(spark, SF, "poses").collect()}
    runs = {}
    for r in fixture(spark, SF, "poses_est").collect():
        p = ref[r.frame_id]
        if abs(p.t - r.t) <= 0.1:
            runs.setdefault(r.run_id, []).append(((p.tx, p.ty, p.tz), (r.tx, r.ty, r.tz)))
    return {k: tuple(np.array(x) for x in zip(*v, strict=True)) for k, v in runs.items()}


def _similarity(to, frm):
    mt, mf = to.mean(0), frm.mean(0)
    u, d, vt = np.linalg.svd((to - mt).T @ (frm - mf) / len(to))
    s = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt))])
    r = u @ s @ vt
    scale = (d * np.diag(s)).sum() / ((frm - mf) ** 2).sum(1).mean()
    return r, scale, mt - scale * r @ mf


def test_alignment_and_aligned_errors(spark):
    pairs = _pairs(spark)
    found = {r.run_id: r for r in registry.QUERIES["a8_alignment"](spark, SF).collect()}
    errors = {r.run_id: r for r in registry.QUERIES["a9_aligned_error"](spark, SF).collect()}
    assert set(found) == set(errors) == set(pairs)
    for run, (to, frm) in pairs.items():
        r, scale, shift = _similarity(to, frm)
        got = found[run]
        assert got.scale == pytest.approx(scale) and [got.sx, got.sy, got.sz] == pytest.approx(shift.tolist(), abs=1e-8)
        assert [got[f"m{i}{j}"] for i in range(3) for j in range(3)] == pytest.approx(r.ravel().tolist(), abs=1e-8)
        e = np.linalg.norm(scale * frm @ r.T + shift - to, axis=1)
        assert errors[run].rmse == pytest.approx(np.sqrt((e**2).mean())) and errors[run].median == pytest.approx(np.median(e)) and errors[run].max == pytest.approx(e.max())


def test_bernoulli_sample(spark):
    kept = {r.gaussian_id for r in registry.QUERIES["f13_sampled_points"](spark, SF).collect()}
    points = fixture(spark, SF, "points").collect()
    assert kept == {p.gaussian_id for p in points if _uniform((p.gaussian_id, 8), (0, 4)) / (1 << 40) < p.opacity - 0.1}
    assert 0.3 < len(kept) / len(points) < 0.5


def _chunk(k) -> int:
    x, y, z = (math.floor((v + 5) / 10) + (1 << 20) for v in (k.tx, k.ty, k.tz))
    return (x << 42) + (y << 21) + z


def _picks(keyframes, remaining, seed):
    """The keyframe of each chunk with the smallest -ln(u) / weight."""
    best = {}
    for k in keyframes:
        u = (_uniform((k.fid, 8), (seed, 4)) + 1) / ((1 << 40) + 1)
        best.setdefault(_chunk(k), []).append((-math.log(u) / max(1, remaining[k.fid]), k.fid))
    return {c: min(x)[1] for c, x in best.items()}


def test_weighted_pick(spark):
    keyframes = fixture(spark, SF, "keyframes").collect()
    got = {r.chunk_id: r.fid for r in registry.QUERIES["w4_weighted_pick"](spark, SF).collect()}
    assert got == _picks(keyframes, {k.fid: k.remaining for k in keyframes}, 42)


def test_training_schedule(spark):
    keyframes = fixture(spark, SF, "keyframes").collect()
    chunks = {}
    for k in keyframes:
        chunks.setdefault(_chunk(k), []).append(k)
    remaining = {}
    for some in chunks.values():
        high = {k.fid for k in sorted(some, key=lambda k: (-k.loss, k.fid))[: max(1, len(some) // 4)]}
        spent = max(k.remaining for k in some) <= 0
        remaining |= {k.fid: k.remaining + (1 + (k.fid in high) if spent else 0) for k in some}
    picks = _picks(keyframes, remaining, 7)
    want = {(k.fid, _chunk(k), picks[_chunk(k)], remaining[k.fid] - (k.fid == picks[_chunk(k)] and remaining[k.fid] > 0)) for k in keyframes}
    assert {(r.fid, r.chunk_id, r.picked, r.remaining) for r in registry.QUERIES["z7_training_schedule"](spark, SF).collect()} == want


def test_chunk_lifecycle(spark):
    manifest = {r.chunk_id: r for r in fixture(spark, SF, "manifest").collect()}
    asked = {r.chunk_id for r in registry.QUERIES["j7_visible_chunks"](spark, SF).collect()}
    load = {c for c in asked if manifest[c].on_disk and not manifest[c].loaded}
    held = sum(m.n_points for m in manifest.values() if m.loaded)
    excess = held + sum(manifest[c].n_points for c in load) - 200
    target, evict, taken = int(excess + 10) if excess > 0 else 0, set(), 0
    for m in sorted((m for m in manifest.values() if m.loaded and m.chunk_id not in asked), key=lambda m: (m.last_access or 0.0, m.chunk_id)):
        if taken >= target:
            break
        evict.add(m.chunk_id)
        taken += m.n_points
    got = {r.chunk_id: r for r in registry.QUERIES["z6_chunk_lifecycle"](spark, SF).collect()}
    assert set(got) == set(manifest) and load
    for c, m in manifest.items():
        assert got[c].loaded == (c in load or (m.loaded and c not in evict))
        assert got[c].last_access == (max(m.last_access or 5000.0, 5000.0) if c in asked else m.last_access)
