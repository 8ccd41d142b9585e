"""Convex pieces in numpy: clipping, subtracting and measuring many of them at once.

A set of pieces is an array (n, v, 2) of corners, counter-clockwise, with a count for each piece; corners beyond the count repeat the
last one. Rows are independent, so a step over thousands of pieces is a few array operations.
"""

from __future__ import annotations

import numpy as np

SCALE = 1 << 16  # areas and moments are added up as whole numbers of this fraction, so no sum depends on its order
_LEAST = 1e-9

Pieces = tuple[np.ndarray, np.ndarray]


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def take(pieces: Pieces, at: np.ndarray) -> Pieces:
    return pieces[0][at], pieces[1][at]


def join(parts: list[Pieces]) -> Pieces:
    """Sets of pieces one after another."""
    width = max(p.shape[1] for p, _ in parts)
    padded = [np.concatenate([p, np.repeat(p[:, -1:], width - p.shape[1], axis=1)], axis=1) for p, _ in parts]
    return np.concatenate(padded), np.concatenate([n for _, n in parts])


def convex_parts(quads: np.ndarray) -> tuple[Pieces, np.ndarray]:
    """Quads (n, 4, 2) in either winding as convex pieces, and whose piece each is.

    A quad with one reflex corner is cut from that corner into two triangles. Quads without area have no piece.
    """
    area = _cross(quads - quads[:, :1], np.roll(quads, -1, axis=1) - quads[:, :1]).sum(axis=1)
    quads = np.where((area < 0)[:, None, None], quads[:, ::-1], quads)
    turn = _cross(quads - np.roll(quads, 1, axis=1), np.roll(quads, -1, axis=1) - quads)
    owner = np.arange(len(quads))
    solid = np.abs(area) > _LEAST
    bent = solid & (turn < 0).any(axis=1)
    whole = solid & ~bent
    first = turn[bent].argmin(axis=1)
    ring = quads[bent][np.arange(bent.sum())[:, None], (first[:, None] + np.arange(4)) % 4]
    halves = np.concatenate([ring[:, [0, 1, 2, 2]], ring[:, [0, 2, 3, 3]]])
    pieces = join([(quads[whole], np.full(whole.sum(), 4)), (halves, np.full(len(halves), 3))])
    owner = np.concatenate([owner[whole], owner[bent], owner[bent]])
    kept = measures(pieces)[0] > _LEAST  # where sides cross, a half may be turned over
    return take(pieces, kept), owner[kept]


def clip(pieces: Pieces, start: np.ndarray, along: np.ndarray, inner: bool) -> Pieces:
    """What lies to the left of a line (``inner``) or to its right, one line a piece; empty pieces have count 0."""
    points, count = pieces
    n, v = points.shape[:2]
    place = np.arange(v)
    real = place < count[:, None]
    side = _cross(along[:, None, :], points - start[:, None, :])
    if not inner:
        side = -side
    following = np.where(place + 1 < count[:, None], place + 1, 0)
    rows = np.arange(n)[:, None]
    other = side[rows, following]
    stays = real & (side >= 0)
    crosses = real & (((side > 0) & (other < 0)) | ((side < 0) & (other > 0)))
    share = np.where(crosses, side, 0.0) / np.where(crosses, side - other, 1.0)
    met = points + share[..., None] * (points[rows, following] - points)
    both = np.stack([points, met], axis=2).reshape(n, 2 * v, 2)
    used = np.stack([stays, crosses], axis=2).reshape(n, 2 * v)
    count = used.sum(axis=1)
    count = np.where(count < 3, 0, count)
    width = max(3, int(count.max(initial=0)))
    order = np.argsort(~used, axis=1, kind="stable")[:, :width]
    points = both[rows, order]
    last = points[np.arange(n), np.maximum(count - 1, 0)]
    return np.where((np.arange(width) < count[:, None])[..., None], points, last[:, None, :]), count


def _lines(pieces: Pieces, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k-th sides of pieces, and which pieces have one."""
    points, count = pieces
    rows, has = np.arange(len(points)), count > k
    start = points[:, min(k, points.shape[1] - 1)]
    return start, points[rows, np.where(k + 1 < count, min(k + 1, points.shape[1] - 1), 0)] - start, has


def overlap(pieces: Pieces, others: Pieces) -> Pieces:
    """The shared part of each piece with another one."""
    for k in range(others[0].shape[1]):
        start, along, has = _lines(others, k)
        pieces = clip(pieces, start, np.where(has[:, None], along, 0.0), True)
    return pieces


def bounds(pieces: Pieces) -> np.ndarray:
    """(n, 4) least x, least y, greatest x, greatest y."""
    return np.concatenate([pieces[0].min(axis=1), pieces[0].max(axis=1)], axis=1)


def measures(pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Area and first moments of each piece."""
    points = pieces[0]
    base = points[:, :1]
    rel = points - base
    turn = _cross(rel, np.roll(rel, -1, axis=1))
    area = turn.sum(axis=1) / 2
    mid = ((rel + np.roll(rel, -1, axis=1)) * turn[..., None]).sum(axis=1) / 6 + base[:, 0] * area[:, None]
    area = np.where(pieces[1] >= 3, area, 0.0)
    return area, np.where(area > 0, mid[:, 0], 0.0), np.where(area > 0, mid[:, 1], 0.0)


def subtract(pieces: Pieces, owner: np.ndarray, minus: Pieces, begin: np.ndarray, end: np.ndarray) -> tuple[Pieces, np.ndarray]:
    """What no minus piece of a piece's owner covers, as convex pieces and their owners.

    ``minus[begin[o]:end[o]]`` are those of owner o. They are taken away one by one, for all owners at once: a piece falls into what lies
    outside each side of the minus piece in turn, the rest being inside of the sides before.
    """
    degree = end - begin
    for turn in range(int(degree.max(initial=0))):
        hit = np.flatnonzero(degree[owner] > turn)
        if not len(hit):
            break
        against = take(minus, begin[owner[hit]] + turn)
        a, b = bounds(take(pieces, hit)), bounds(against)
        near = ((a[:, :2] < b[:, 2:]) & (b[:, :2] < a[:, 2:])).all(axis=1)
        hit, against = hit[near], take(against, near)
        if not len(hit):
            continue
        rest, whose = take(pieces, hit), owner[hit]
        away = np.ones(len(owner), bool)
        away[hit] = False
        parts, owners = [take(pieces, away)], [owner[away]]
        for k in range(against[0].shape[1]):
            start, along, has = _lines(against, k)
            along = np.where(has[:, None], along, 0.0)
            outside = clip(rest, start, along, False)
            kept = (measures(outside)[0] > _LEAST) & has
            parts.append(take(outside, kept))
            owners.append(whose[kept])
            rest = clip(rest, start, along, True)
        pieces, owner = join(parts), np.concatenate(owners)
    return pieces, owner


def scaled(values: np.ndarray) -> np.ndarray:
    return np.rint(values * SCALE).astype(np.int64)
