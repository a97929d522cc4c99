"""Small grids, written row by row, and brute force for them in plain Python."""

from itertools import product

HAND_MADE = {
    "diagonal": "10001,01000,00100,00010,10001",
    "late_union": "10101,10101,11111",
    "gap": "1001,0000,1010",
    "space_diagonal": "100,000,000/000,010,000/000,000,001",
    "back_row": "000,000,010/000,100,000",
    "split": "1010,0000/0000,0000/1010,1111",
    "full": "11,11/11,11",
    "empty": "000,000",
}


def cells_of(text: str) -> list[tuple[int, int, int]]:
    return [(z, y, x) for z, plane in enumerate(text.split("/")) for y, row in enumerate(plane.split(",")) for x, c in enumerate(row) if c == "1"]


def flood(cells: list[tuple[int, int, int]]) -> dict[tuple[int, int, int], int]:
    """Labels by flood fill over 26 neighbours, numbered in raster order."""
    left, labels, n = set(cells), {}, 0
    for start in sorted(cells):
        if start in labels:
            continue
        n += 1
        stack = [start]
        while stack:
            c = stack.pop()
            if c in labels or c not in left:
                continue
            labels[c] = n
            stack += [(c[0] + a, c[1] + b, c[2] + d) for a, b, d in product((-1, 0, 1), repeat=3)]
    return labels


def features(labels: dict[tuple[int, int, int], int]) -> dict[int, tuple[int, ...]]:
    """label: S, Sx, Sy, Sz, lo_col, lo_row, lo_slice, hi_col, hi_row, hi_slice"""
    out = {}
    for n in set(labels.values()):
        z, y, x = zip(*(c for c, k in labels.items() if k == n), strict=True)
        out[n] = (len(z), sum(x), sum(y), sum(z), min(x), min(y), min(z), max(x) + 1, max(y) + 1, max(z) + 1)
    return out
