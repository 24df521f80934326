"""String distances and exact edit-distance indexes used by several operators (driver- and worker-side Python)."""

from __future__ import annotations

#: Up to this length spellings are indexed by deletions (their number grows with the square of the length), beyond it by segments.
DELETION_LENGTH = 24


def osa(a: str, b: str, limit: int) -> int:
    """Optimal string alignment distance (swaps of neighbours cost 1); limit + 1 where it is larger."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    if a == b:
        return 0
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        new = [i] + [0] * len(b)
        for j, cb in enumerate(b, 1):
            cost = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (ca != cb))
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                cost = min(cost, before[j - 2] + 1)
            new[j] = cost
        before, row = row, new
        if min(row) > limit and min(before) > limit:
            return limit + 1
    return min(row[-1], limit + 1)


def deletions(s: str, k: int) -> set[str]:
    """``s`` with up to ``k`` characters left out; two strings within OSA distance k share one of them."""
    out, level = {s}, {s}
    for _ in range(k):
        level = {t[:i] + t[i + 1 :] for t in level for i in range(len(t))}
        out |= level
    return out


def _pieces(n: int, k: int) -> list[tuple[int, int]]:
    """(start, end) of 2k + 1 segments of a string of length n."""
    parts = 2 * k + 1
    edges = [n * i // parts for i in range(parts + 1)]
    return list(zip(edges, edges[1:], strict=False))


def index_keys(s: str, k: int) -> set[str]:
    """Keys under which ``s`` is found by :func:`query_keys` of any string within OSA distance k."""
    out = {"d" + x for x in deletions(s, k)} if len(s) <= DELETION_LENGTH + k else set()
    if len(s) > DELETION_LENGTH - k:
        out |= {f"s{len(s)}|{i}|{s[a:b]}" for i, (a, b) in enumerate(_pieces(len(s), k))}
    return out


def query_keys(s: str, k: int) -> set[str]:
    """Keys of a searched string: deletions, or for long ones its substrings where a segment may have moved.

    k edits touch at most 2k of the 2k + 1 segments (a swap may straddle two), so one stands unchanged, moved by at
    most k places. Keys of a long string number (2k + 1)^3, whatever its length.
    """
    out = {"d" + x for x in deletions(s, k)} if len(s) <= DELETION_LENGTH + k else set()
    if len(s) > DELETION_LENGTH - k:
        for n in range(len(s) - k, len(s) + k + 1):
            for i, (a, b) in enumerate(_pieces(n, k)):
                out |= {f"s{n}|{i}|{s[a + m : b + m]}" for m in range(-k, k + 1) if 0 <= a + m and b + m <= len(s)}
    return out
