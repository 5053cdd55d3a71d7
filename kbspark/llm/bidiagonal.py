"""Singular values and right singular vectors of a small square matrix, accurate to the last few digits.

Householder reflections make the matrix bidiagonal; the differential quotient-difference algorithm with shifts finds
the squares of the singular values to high relative accuracy; twisted factorisations of ``B'B - value`` give the
vectors. Its size is that of the dimensions, not of the rows.
"""

import numpy as np

EPS = float(np.finfo(float).eps)

# Values closer than this, relatively, share an invariant subspace; their vectors are made orthogonal by hand.
CLUSTER = 1e-3

# Corrections of a value while its vector is sought.
_CORRECTIONS = 4


def _reflector(column: np.ndarray) -> np.ndarray | None:
    """The unit vector whose reflection leaves only the first entry of ``column``."""
    size = np.linalg.norm(column)
    if size == 0 or size == abs(column[0]):
        return None
    v = column.copy()
    v[0] += size if v[0] >= 0 else -size
    return v / np.linalg.norm(v)


def bidiagonal(square: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Diagonal, the entries above it, and the reflections from the right as (first index, vector)."""
    a, size, right = square.astype(float).copy(), len(square), []
    for k in range(size):
        v = _reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        v = _reflector(a[k, k + 1:]) if k + 1 < size else None
        if v is not None:
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
            right.append((k + 1, v))
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), right


def _scale(diagonal: np.ndarray, above: np.ndarray) -> float:
    return float(max([*np.abs(diagonal), *np.abs(above)], default=0.0)) or 1.0


def _step(q: list[float], e: list[float], shift: float) -> bool:
    """One shifted quotient-difference step in place; false, and nothing changed, where the shift was too large."""
    new_q, new_e, d = [0.0] * len(q), [0.0] * len(e), q[0] - shift
    if d < 0:
        return False
    for i in range(len(e)):
        new_q[i] = d + e[i]
        if new_q[i] == 0.0:
            d = q[i + 1] - shift
        else:
            ratio = q[i + 1] / new_q[i]
            new_e[i] = e[i] * ratio
            d = d * ratio - shift
        if d < 0:
            return False
    new_q[-1] = d
    q[:], e[:] = new_q, new_e
    return True


def _lowest(q: list[float], e: list[float]) -> float:
    """The lower eigenvalue of the last two by two block: an upper bound of the smallest one of all."""
    one, other, off = q[-2] + e[-1], q[-1], q[-1] * e[-1]
    middle, half = (one + other) / 2, (one - other) / 2
    high = middle + (half * half + off) ** 0.5
    return max(0.0, (one * other - off) / high) if high > 0 else 0.0


def squares(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The squared singular values of a bidiagonal matrix, largest first."""
    found, negligible = [], EPS * EPS
    scale = _scale(diagonal, above)
    todo = [([float(v) for v in (diagonal / scale) ** 2], [float(v) for v in (above / scale) ** 2], 0.0)]
    while todo:
        q, e, shifted = todo.pop()
        if not q:
            continue
        if q[0] * 1.5 < q[-1]:  # the values come out from the small end
            q, e = q[::-1], e[::-1]
        while len(q) > 1:
            if e[-1] <= negligible * (shifted + q[-1]):
                found.append(shifted + q.pop())
                e.pop()
                continue
            cut = next((i for i in range(len(e) - 1) if e[i] <= negligible * (shifted + min(q[i], q[i + 1]))), None)
            if cut is not None:
                todo.append((q[:cut + 1], e[:cut], shifted))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            shift = 0.98 * _lowest(q, e)
            while not _step(q, e, shift):
                shift = shift / 4 if shift > EPS * q[-1] else 0.0
            shifted += shift
        found.append(shifted + q[0])
    return np.sort(np.array(found))[::-1] * scale ** 2


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``B'B - value``: the multipliers from above and from below, and what is left at each index of a twist."""
    size, tiny = len(a), 1e-290
    s, p, lower, upper = np.empty(size), np.empty(size), np.empty(max(0, size - 1)), np.empty(max(0, size - 1))
    s[0], p[-1] = -value, a[-1] ** 2 - value
    for i in range(size - 1):
        pivot = a[i] ** 2 + s[i] or tiny
        lower[i], s[i + 1] = a[i] * b[i] / pivot, b[i] ** 2 * (s[i] / pivot) - value
    for i in range(size - 2, -1, -1):
        pivot = b[i] ** 2 + p[i + 1] or tiny
        # Where the matrix falls apart the part above does not feel the one below.
        upper[i], p[i] = a[i] * b[i] / pivot, a[i] ** 2 * (p[i + 1] / pivot if b[i] else 1.0) - value
    return lower, upper, s + p + value


def _solved(lower: np.ndarray, upper: np.ndarray, at: int) -> np.ndarray:
    z = np.zeros(len(lower) + 1)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -lower[i] * z[i + 1]
    for i in range(at, len(upper)):
        z[i + 1] = -upper[i] * z[i]
    return z


def _vector(a: np.ndarray, b: np.ndarray, value: float, near: list[np.ndarray]) -> np.ndarray:
    """A unit vector of a squared singular value, orthogonal to those of values ``near`` it."""
    with np.errstate(all="ignore"):
        for _ in range(_CORRECTIONS):
            lower, upper, left = _twisted(a, b, value)
            left = np.where(np.isfinite(left), left, np.inf)
            at = int(np.argmin(np.abs(left)))
            z = _solved(lower, upper, at)
            step = left[at] / (z @ z)
            if near or not np.isfinite(step) or abs(step) <= EPS * value:
                break
            value += step
        best, best_error = None, np.inf
        for at in np.argsort(np.abs(left))[:len(left) if near else 1]:
            z = _solved(lower, upper, int(at))
            size = np.linalg.norm(z)
            if not np.isfinite(size):
                continue
            rest = z / size
            for _ in range(2):
                for other in near:
                    rest = rest - other * (other @ rest)
            apart = np.linalg.norm(rest)
            error = max(abs(left[at]) / size, EPS * value) / apart if apart > EPS else np.inf
            if error < best_error:
                best, best_error = rest / apart, error
    if best is None:  # no twist is apart from the others: any direction that is
        for n in range(len(a)):
            rest = np.eye(len(a))[n]
            for other in near:
                rest = rest - other * (other @ rest)
            if np.linalg.norm(rest) > 0.5 / len(a) ** 0.5:
                return rest / np.linalg.norm(rest)
    return best


def leading(square: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest squared singular values and their right singular vectors, as rows."""
    diagonal, above, right = bidiagonal(square)
    values, vectors = squares(diagonal, above)[:count], []
    scale = _scale(diagonal, above)
    for n, value in enumerate(values):
        near = [vectors[k] for k in range(n) if values[k] - value <= CLUSTER * values[k]]
        vectors.append(_vector(diagonal / scale, above / scale, value / scale ** 2, near))
    back = np.array(vectors).reshape(len(values), len(square)).copy()
    for first, v in reversed(right):
        back[:, first:] -= 2 * np.outer(back[:, first:] @ v, v)
    return values, back
