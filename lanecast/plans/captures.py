"""Files loaded by their content, and odds grids parsed back."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanecast.operators import joint
from lanecast.plans.contest import full_races, table
from lanecast.plans.registry import Registry
from lanecast.sources import grids, ledgers

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL
PAGE_PARTS = 200  # a page is few bytes and much work: a number given is kept; so many parts are dealt without a sort in memory


@R.query("WITH f AS (SELECT n_nationkey % 5 = 4 AS late, count(DISTINCT c_nationkey) AS files, count(*) AS rows FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL) SELECT load, coalesce(sum(files), 0)::BIGINT AS files, coalesce(sum(rows), 0)::BIGINT AS rows FROM (VALUES (1, false), (2, NULL), (3, true)) l(load, late) LEFT JOIN f USING (late) GROUP BY load", base=False)
def content_addressed_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a JSON file a nation, loaded; loaded again; and once more with the files of further nations and a copy of an old one."""
    root, folder = ledgers.shared_folder(spark, "files"), ledgers.shared_folder(spark, "loads")
    c = table(spark, sf_dir, "customer").withColumn("nation", F.col("c_nationkey"))
    late = F.col("nation") % 5 == 4
    write = lambda d, to: d.repartition("nation").write.partitionBy("nation").json(f"{root}/{to}")

    def parse(files: DataFrame) -> DataFrame:
        return files.select(F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).where("line <> ''").select(F.from_json("line", "c_custkey long, c_name string, c_acctbal double").alias("c")).select("c.*")

    write(c.where(~late), "first")
    loads = [ledgers.stored(ledgers.load_new_files(spark, root, folder, "customers", parse, "v1"), "load") for _ in (1, 2)]
    write(c.where(late), "later")
    write(c.where("nation = 0"), "again")
    loads.append(ledgers.load_new_files(spark, root, folder, "customers", parse, "v1"))
    return reduce(DataFrame.unionByName, [d.withColumn("load", F.lit(k + 1)) for k, d in enumerate(loads)])


_TENTHS = "(a * 100 + b * 10 + c + race_id % 7)"
_CANDIDATES = ", ".join(f"('{pool}', {', '.join(str(x) for x in (*lanes, 0, 0)[:3])})" for pool in ("win", "place", "exacta", "quinella", "trifecta", "trio") for _, lanes, _ in joint.candidates_of(pool))


def _layouts() -> dict[str, list[list[str | int]]]:
    """A page's rows of cells by pool: texts, and prices in tenths, which the page's shift moves."""
    lanes = range(1, 7)
    tenths = lambda x, y=0, z=0: x * 100 + y * 10 + z
    cells = {name: {(0, a - 1): str(a) for a in lanes} for name in ("exacta", "quinella", "trifecta", "trio")}
    for name in ("exacta", "quinella"):
        for _, (a, b), _ in joint.candidates_of(name):
            row = b - 1 if b > a else b
            cells[name] |= {(row, 2 * (a - 1)): str(b), (row, 2 * (a - 1) + 1): tenths(a, b)}
    for name in ("trifecta", "trio"):
        for _, (a, b, c), _ in joint.candidates_of("trifecta"):
            at_j, at_k = b - 1 - (b > a), c - 1 - (c > a) - (c > b)
            shown = [str(c), tenths(a, b, c)] if name == "trifecta" or a < b < c else ["", ""]
            block = [str(b), *shown] if at_k == 0 else shown
            cells[name] |= {(1 + 4 * at_j + at_k, len(block) * (a - 1) + n): x for n, x in enumerate(block)}
    rows = {name: [[of[at] for at in sorted(of) if at[0] == row] for row in range(max(of)[0] + 1)] for name, of in cells.items()}
    return {"win": [[tenths(a) for a in lanes]], "place": [[tenths(a) for a in lanes]]} | rows


_LAYOUTS = _layouts()
_SHOWN = [x for rows in _LAYOUTS.values() for row in rows for x in row]
_PRICES = range(min(x for x in _SHOWN if isinstance(x, int)) - 6, max(x for x in _SHOWN if isinstance(x, int)) + 7)
_TEXTS = pa.array([*(f"{x // 10}.{x % 10}" for x in _PRICES), *sorted({x for x in _SHOWN if isinstance(x, str)})])
_PLACES = {x: n for n, x in enumerate(_TEXTS.to_pylist()[len(_PRICES):], len(_PRICES))}


def _rendered(pool: str, shift: np.ndarray) -> pa.Array:
    """The pool's cells of pages with these shifts: win and place a list of texts, else a grid as grids.pair_odds reads it."""
    rows, pages = _LAYOUTS[pool], len(shift)
    flat = [x for row in rows for x in row]
    codes = np.array([x - _PRICES[0] if isinstance(x, int) else _PLACES[x] for x in flat]) + np.outer(shift, [isinstance(x, int) for x in flat])
    texts = _TEXTS.take(pa.array(codes.ravel()))
    ends = np.cumsum([len(row) for row in rows])
    starts = np.concatenate([[0], (ends + len(flat) * np.arange(pages)[:, None]).ravel()]).astype(np.int32)
    v = pa.ListArray.from_arrays(pa.array(starts), texts)
    if pool in ("win", "place"):
        return v
    numbered = pa.StructArray.from_arrays([pa.array(np.tile(np.arange(len(rows), dtype=np.int32), pages)), v], ["row_no", "v"])
    return pa.ListArray.from_arrays(pa.array(np.arange(pages + 1, dtype=np.int32) * len(rows)), numbered)


def _pages_read(batches):
    """race_id to race_id, pool, n, tenths: its page is rendered and parsed, all pages of a step at once."""
    names = pa.array(list(_LAYOUTS))
    for batch in batches:
        for lo in range(0, batch.num_rows, grids.PAGES):
            ids = batch.column(0).slice(lo, grids.PAGES)
            shift = np.fmod(ids.to_numpy(), 7)
            page = {pool: _rendered(pool, shift) for pool in _LAYOUTS}
            single = grids.win_place_odds(page["win"], page["place"])
            found = {"win": (single["page"], single["win"]), "place": (single["page"], single["place_low"])}
            found |= {pool: grids.pair_odds(page[pool], pool == "exacta")[::2] for pool in ("exacta", "quinella")} | {pool: grids.triple_odds(page[pool], pool == "trifecta")[::2] for pool in ("trifecta", "trio")}
            rows, n, tenths = (np.empty((len(ids), len(_LAYOUTS)), np.int64) for _ in range(3))
            for k, (at, odds) in enumerate(found.values()):
                priced = odds >= 1.0
                count = lambda x, of: np.bincount(x, of, len(ids))
                rows[:, k], n[:, k], tenths[:, k] = count(at, None), count(at, priced), count(at, np.where(priced, np.floor(odds * 10 + 0.5), 0))
            has = np.flatnonzero(rows)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(has // len(_LAYOUTS))), names.take(pa.array(has % len(_LAYOUTS))), pa.array(n.ravel()[has]), pa.array(tenths.ravel()[has])], names=["race_id", "pool", "n", "tenths"])


@R.query(f", k(pool, a, b, c) AS (VALUES {_CANDIDATES}) SELECT race_id, pool, count(*) AS n, sum({_TENTHS})::BIGINT AS tenths FROM (SELECT DISTINCT race_id FROM fields), k GROUP BY ALL")
def odds_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every race's win and place cells, pair grids (one triangular) and triple grids (one with blank cells), rendered and parsed back."""
    return full_races(spark, sf_dir, PAGE_PARTS).mapInArrow(_pages_read, "race_id long, pool string, n long, tenths long")
