"""Odds grids of many pages at once: Arrow columns in, arrays of entries out, every cell's text read.

A page is an element of an Arrow list: of texts, or of a grid's rows as struct<row_no, v>, v its cells by column. Equal texts of a step are read once."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PAGES = 1024  # of a step, so that its arrays stay in the processor's cache
NONE = -(1 << 40)  # no lane; lanes are ints
TEXTS = 1 << 14  # kept by a worker
_BLANK = "".join(map(chr, range(33)))
_QUOTE = re.compile(r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[fFdD]?|inf|infinity)", re.ASCII | re.IGNORECASE)
_LANE = re.compile(r"[+-]?\d+", re.ASCII)


def _quote(text: str) -> float:
    """At least 1.0, else NaN."""
    text = text.strip(_BLANK)
    if not _QUOTE.fullmatch(text):
        return np.nan
    value = float(text if text[-1] in "yY" or text[-3:].lower() == "inf" else text.rstrip("fFdD"))
    return value if value >= 1.0 else np.nan


@lru_cache(TEXTS)
def odds_cell(text: str) -> tuple[float, float]:
    """text.odds_cell of one text: low and high, NaN for none."""
    low, *high = text.strip(" ").split("-")
    return _quote(low), _quote(high[0]) if high else np.nan


@lru_cache(TEXTS)
def lane(text: str) -> int:
    text = text.strip(_BLANK)
    n = int(text) if _LANE.fullmatch(text) else NONE
    return n if -(1 << 31) <= n < 1 << 31 else NONE


class Cells(NamedTuple):
    """Texts by place: the place's code, and what each code's text is as a lane and as odds; null has the last code."""

    codes: np.ndarray
    lanes: np.ndarray
    lows: np.ndarray
    highs: np.ndarray


def _cells(texts: pa.Array) -> Cells:
    d = pc.dictionary_encode(texts)
    words = d.dictionary.to_pylist()
    codes = pc.fill_null(d.indices, len(words)).to_numpy(zero_copy_only=False)
    odds = np.array([*map(odds_cell, words), (np.nan, np.nan)])
    return Cells(codes, np.array([*map(lane, words), NONE]), odds[:, 0].copy(), odds[:, 1].copy())


def _lists(x: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Starts, sizes and elements of a list column, its first element at 0; null is empty."""
    at = x.offsets.to_numpy().astype(np.int64)
    size = np.diff(at)
    if x.null_count:
        size[~x.is_valid().to_numpy(zero_copy_only=False)] = 0
    return at[:-1] - at[0], size, x.values.slice(at[0], at[-1] - at[0])


def _dealt(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every element of groups of these sizes: its group, its place in there."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Grid(NamedTuple):
    """The rows below their page's header: page, places of the row's and the header's first cells, numbers of cells (row: all, and those
    that aren't null; header: all)."""

    cells: Cells
    page: np.ndarray
    start: np.ndarray
    size: np.ndarray
    known: np.ndarray
    head: np.ndarray
    width: np.ndarray


def _grid(grid: pa.Array) -> Grid:
    at, size, rows = _lists(grid)
    of, nth = _dealt(size)
    row = at[of] + nth
    number, (start, length, texts) = rows.field("row_no").to_numpy(zero_copy_only=False)[row], _lists(rows.field("v"))
    start, length = start[row], length[row]
    known = length
    if texts.null_count:
        upto = np.concatenate([[0], np.cumsum(texts.is_valid().to_numpy(zero_copy_only=False))])
        known = upto[start + length] - upto[start]
    first = np.full(len(grid), -1)
    top = np.flatnonzero(number == 0)[::-1]
    first[of[top]] = top  # of several the first
    body = np.flatnonzero((number > 0) & (first[of] >= 0))
    head = first[of[body]]
    return Grid(_cells(texts), of[body], start[body], length[body], known[body], start[head], length[head])


def win_place_odds(win: pa.Array, place: pa.Array) -> dict[str, np.ndarray]:
    """Texts of a page's lanes, in order, to page, lane, win, place_low, place_high."""
    (at, size, w), (other, many, p) = _lists(win), _lists(place)
    page, n = _dealt(np.maximum(size, many))
    w, p = _cells(w), _cells(p)

    def odds(c: Cells, values: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out, known = np.full(len(page), np.nan), n < sizes[page]
        out[known] = values[c.codes[start[page[known]] + n[known]]]
        return out

    return {"page": page, "lane": n + 1, "win": odds(w, w.lows, at, size), "place_low": odds(p, p.lows, other, many), "place_high": odds(p, p.highs, other, many)}


def pair_odds(grid: pa.Array, ordered: bool) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
    """Two columns (second lane, odds) under each header lane; row 0 is the header. Gives page, lanes, odds."""
    g = _grid(grid)
    c = g.cells
    of, b = _dealt(np.minimum(g.width, g.size // 2))
    at = g.start[of] + 2 * b
    i, j, odds = c.lanes[c.codes[g.head[of] + b]], c.lanes[c.codes[at]], c.lows[c.codes[at + 1]]
    keep = np.flatnonzero((i != NONE) & (j != NONE) & (i != j) & (odds >= 1.0))
    i, j = i[keep], j[keep]
    return g.page[of[keep]], (i, j) if ordered else (np.minimum(i, j), np.maximum(i, j)), odds[keep]


def triple_odds(grid: pa.Array, ordered: bool) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
    """Blocks under header lanes: rows of three cells a block start a second lane, rows of two carry it on; a row whose cells don't divide is
    skipped, so is an entry that lacks a lane. Gives page, lanes, odds; a combination once, at its lowest odds."""
    g = _grid(grid)
    c = g.cells
    some = np.flatnonzero((g.width > 0) & ((g.known == 2 * g.width) | (g.known == 3 * g.width)))
    page, start, width, head = g.page[some], g.start[some], g.width[some], g.head[some]
    stride = g.known[some] // width
    of, b = _dealt(width)
    at = start[of] + b * stride[of]
    j = c.lanes[c.codes[at]]
    j[stride[of] != 3] = NONE
    j = _carried(j, page, width, of, b)
    at += stride[of] - 2
    k, odds = c.lanes[c.codes[at]], c.lows[c.codes[at + 1]]
    i = c.lanes[c.codes[head[of] + b]]
    keep = np.flatnonzero((i != NONE) & (j != NONE) & (k != NONE) & (odds >= 1.0))
    lanes, odds, page = (i[keep], j[keep], k[keep]), odds[keep], page[of[keep]]
    if not ordered:
        lo, hi = np.minimum(lanes[0], lanes[1]), np.maximum(lanes[0], lanes[1])
        lanes = np.minimum(lo, lanes[2]), np.maximum(lo, np.minimum(hi, lanes[2])), np.maximum(hi, lanes[2])
    return _once(page, lanes, odds, len(grid))


def _carried(x: np.ndarray, page: np.ndarray, width: np.ndarray, of: np.ndarray, b: np.ndarray) -> np.ndarray:
    """NONE becomes what the page's rows above have last under the same header lane. page and width: of rows; of and b: of x."""
    if not len(x):
        return x
    new = np.concatenate([[True], page[1:] != page[:-1]])
    nth = np.arange(len(page)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    rows = np.bincount(page)[page]
    begin = np.cumsum(width) - width - nth * width  # of the page's first entry
    to = begin[of] + b * rows[of] + nth[of]  # a header lane's entries side by side
    last = np.full(len(x), -1)
    known = np.flatnonzero(x != NONE)
    last[to[known]] = to[known]
    last = np.maximum.accumulate(last)[to]
    down = np.empty_like(x)
    down[to] = x
    return np.where(last >= to - nth[of], down[last], NONE)


def _once(page: np.ndarray, lanes: tuple[np.ndarray, ...], odds: np.ndarray, pages: int):
    """Without repeats of a combination in a page; they are looked for in a table if lanes are below 16, by order if not."""
    low, high = min((x.min() for x in lanes if len(x)), default=0), max((x.max() for x in lanes if len(x)), default=0)
    if low >= 0 and high < 16:
        n, key = high + 1, page
        for x in lanes:
            key = key * n + x
        met = np.zeros(pages * n ** len(lanes), bool)
        met[key] = True
        if np.count_nonzero(met) == len(key):
            return page, lanes, odds
    order = np.lexsort((odds, *lanes[::-1], page))
    page, lanes, odds = page[order], tuple(x[order] for x in lanes), odds[order]
    new = np.ones(len(page), bool)
    new[1:] = (page[1:] != page[:-1]) | np.any([x[1:] != x[:-1] for x in lanes], axis=0)
    return page[new], tuple(x[new] for x in lanes), odds[new]


def combinations(lanes: tuple[np.ndarray, ...]) -> pa.Array:
    return pc.binary_join_element_wise(*[pc.cast(pa.array(x), pa.string()) for x in lanes], "-")
