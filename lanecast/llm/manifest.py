"""Operator 11: Merkle manifest of a dataset, and proofs by content-addressed descent.

Leaves are ranked per source without a task that holds a source (common.numbered); every 16 consecutive nodes become
the next level's node by one bounded aggregate a level, so a level shuffles a sixteenth of the one below. What is stored
are records, digest -> children, a row a digest and level. The subroots of the sources, in order, are the leaves of a tree of
the same kind, whose last node is the root.

Proofs: requests name leaves by (source, rank). Paths descend from the root together: at each level the nodes that
lie above some request are joined with the records by digest, and each child that the next digit of a requested rank (base
16) selects goes on, with the digests left and right of it as one more segment of its path. Thus a node above many
requests is opened once, and only the last level meets single requests. Segments run from the root; reversed they fold
a leaf to the root. A level's join meets a digest once for every place that it stands at (more than once only where
whole runs of rows are repeated); such a digest's partition is split by the adaptive skew join.

Nulls: a null value is `-`; null ids come first in their source; rows without an id are not tampered with; the null source is
a source of its own. Empty and very long texts: hashed like any other, whole. Ties of id and repeated rows: by leaf digest;
rows with equal leaves are interchangeable. Empty table: no rows, no root. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanecast.llm.common import documents, lower_ascii, numbered, stored

FAN_BITS = 4
FAN = 1 << FAN_BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 5  # ids whose crc32 this divides
PATH = "array<struct<left:string,right:string>>"


def joined_hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*values: Column) -> Column:
    """Of each value its UTF-8 bytes' count, a colon and the value; `-` for null."""
    texts = [v.cast("string") for v in values]
    return joined_hash(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def height_of(leaves: Column) -> Column:
    """Levels above so many leaves: the least h with 16^h >= leaves."""
    return sum((leaves > FAN**k).cast("int") for k in range(60 // FAN_BITS))


@dataclass
class Tree:
    """Trees of the values of `gid`. records: by height (1 and up), digest and children; tops: gid, digest, height."""

    tops: DataFrame
    records: dict[int, DataFrame] = field(default_factory=dict)

    @property
    def height(self) -> int:
        return max(self.records, default=0)


def grown(leaves: DataFrame) -> Tree:
    """leaves: gid, rank, digest, height (of the gid's tree); stored."""
    height = leaves.agg(F.max("height")).first()[0] or 0
    nodes = leaves.select("gid", "rank", "digest", "height")
    tops, records = nodes.where("height = 0"), {}
    for level in range(1, height + 1):
        run = F.sort_array(F.collect_list(F.struct((F.col("rank") % FAN).alias("digit"), "digest")))  # at most 16
        up = nodes.where(F.col("height") >= level).groupBy("gid", "height", F.shiftright("rank", FAN_BITS).alias("rank")).agg(run.alias("run"))
        up = up.withColumn("children", F.col("run.digest")).drop("run")
        up = stored(up.withColumn("digest", F.sha2(F.array_join("children", ""), 256)), "tree-level")
        records[level] = up.groupBy("digest").agg(F.first("children").alias("children"))
        nodes = up.drop("children")
        tops = tops.unionByName(nodes.where(F.col("height") == level))
    return Tree(tops.select("gid", "digest", "height"), records)


def opened(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """The nodes with their record's children."""
    return nodes.join(records, "digest")


def segment(digit: Column) -> Column:
    """What stands left and right of the child that is selected."""
    side = lambda start, n: F.array_join(F.slice("children", start, n), "").alias
    return F.array(F.struct(side(F.lit(1), digit)("left"), side(digit + 2, F.lit(FAN))("right")))


def proofs(tree: Tree, starts: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (gid, rank, others) with the columns of starts' top and the path from there down to the leaf.

    starts: gid, digest (the top's), height, path (above it), subroot.
    """
    frontier = starts.where("height = 0").limit(0).select("gid", F.lit(0).cast("long").alias("prefix"), "digest", "path", "subroot")
    lone = starts.where("height = 0").select("gid", F.lit(0).cast("long").alias("prefix"), "path", "subroot", F.array("digest").alias("children"), F.lit(True).alias("lone"))
    lowest = lone
    for level in range(tree.height, 0, -1):
        entering = starts.where(F.col("height") == level).select("gid", F.lit(0).cast("long").alias("prefix"), "digest", "path", "subroot")
        here = frontier.unionByName(entering)
        if level == 1:
            lowest = lone.unionByName(opened(here, tree.records[1]).select("gid", "prefix", "path", "subroot", "children", F.lit(False).alias("lone")))
            break
        wanted = requests.select("gid", F.shiftright("rank", FAN_BITS * (level - 1)).alias("prefix")).distinct()
        each = opened(here, tree.records[level]).select("gid", "prefix", "path", "subroot", "children", F.posexplode("children").alias("digit", "digest"))
        down = each.select("gid", F.shiftleft("prefix", FAN_BITS).bitwiseOR(F.col("digit").cast("long")).alias("prefix"), "digest", F.concat("path", segment(F.col("digit"))).alias("path"), "subroot")
        frontier = stored(down.join(wanted, ["gid", "prefix"], "left_semi"), "descent")
    asked = requests.withColumn("prefix", F.shiftright("rank", FAN_BITS)).join(lowest, ["gid", "prefix"])
    digit = (F.col("rank") % FAN).cast("int")
    path = F.when(F.col("lone"), F.col("path")).otherwise(F.concat("path", segment(digit)))
    return asked.select(*requests.columns, "subroot", path.alias("path"), F.element_at("children", digit + 1).alias("found"))


def siblings_digest(path: Column) -> Column:
    """Of all siblings of the path, which runs from the root, from the leaf's run up."""
    return F.sha2(F.array_join(F.transform(F.reverse(path), lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(path: Column, leaf: Column) -> Column:
    return F.aggregate(F.reverse(path), leaf, lambda x, s: joined_hash(s["left"], x, s["right"]))


@dataclass
class Manifest:
    """leaves: gid, rank, doc_id, digest, height, current; sources: gid, rank, digest (subroot), height; root: hex, None if no rows."""

    leaves: DataFrame
    sources: DataFrame
    tree: Tree
    top: Tree
    root: str | None

    def proofs(self, requests: DataFrame) -> DataFrame:
        """requests: gid, rank and any others; adds subroot, path (root to leaf) and found, the leaf that the descent ends at."""
        spark = requests.sparkSession
        start = spark.createDataFrame([("", self.root, self.top.height, [], "")] if self.root else [], f"gid string, digest string, height int, path {PATH}, subroot string")
        wanted = self.sources.withColumnRenamed("gid", "source").select(F.lit("").alias("gid"), "rank", "source", F.col("height").alias("below"))
        wanted = wanted.join(requests.select(F.col("gid").alias("source")).distinct(), "source", "left_semi")
        above = proofs(self.top, start, wanted)
        starts = stored(above.select(F.col("source").alias("gid"), F.col("found").alias("digest"), F.col("below").alias("height"), "path", F.col("found").alias("subroot")), "subroots")
        return proofs(self.tree, starts, requests)


def manifest(df: DataFrame, source_col: str = "source", id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS, changed: Column | None = None, current: Column | None = None) -> Manifest:
    """changed: which rows' `current` leaf is given apart from the leaf that the tree has."""
    changed = F.lit(False) if changed is None else changed
    source = F.col(source_col).cast("string")
    gid = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))  # null first, then bytewise
    leaves = df.select(gid.alias("gid"), F.col(id_col).cast("long").alias("doc_id"), leaf_digest(*map(F.col, fields)).alias("digest"), F.when(changed, current).cast("string").alias("current"))
    leaves = numbered(stored(leaves, "leaves"), "gid", [F.col("doc_id").asc_nulls_first(), F.col("digest")])
    leaves = stored(leaves.withColumn("height", height_of(F.col("size"))).drop("size"), "ranked-leaves")
    tree = grown(leaves)
    sources = numbered(stored(tree.tops.withColumn("all", F.lit("")), "subroots"), "all", [F.col("gid")])
    sources = stored(sources.withColumn("top_height", height_of(F.col("size"))).drop("size"), "sources")
    top = grown(sources.select(F.lit("").alias("gid"), "rank", "digest", F.col("top_height").alias("height")))
    root = top.tops.first()
    return Manifest(leaves, sources.select("gid", "rank", "digest", "height"), tree, top, root and root["digest"])


def tampered(df: DataFrame) -> tuple[Column, Column]:
    """Which rows, and their leaves: text in lower case (A-Z)."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return F.coalesce(hit, F.lit(False)), leaf_digest(*[lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in FIELDS])


def verify(df: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of df, tampered with as above."""
    changed, current = tampered(df)
    m = manifest(df, changed=changed, current=current)
    found = m.proofs(m.leaves.select("gid", "rank", "doc_id", F.col("digest").alias("leaf"), F.coalesce("current", "digest").alias("current")))
    out = found.select("doc_id", "leaf", "subroot", F.lit(m.root).cast("string").alias("root"), siblings_digest(F.col("path")).alias("proof_sha256"), folded(F.col("path"), F.col("current")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark, sf_dir):
    return verify(documents(spark, sf_dir))


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
CRC32_SQL = "xor(4294967295, list_reduce(flatten([[4294967295]] || list_transform(string_split({0}, ''), lambda b: [ascii(b), -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"
SQL_LEVELS = 7  # of each tree: 16^7 leaves a source and 16^7 sources


def _sql() -> str:
    value = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(value(text if c == "text" else c) for c in FIELDS) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"d AS (SELECT row_number() OVER () AS row, doc_id, source, {leaf('text')} AS leaf, CASE WHEN {CRC32_SQL.format('doc_id::VARCHAR')} % {TAMPERED} = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS current FROM documents)",
        "s0 AS (SELECT row, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n, leaf AS digest FROM d)",
    ]

    def levels(x: str, key: str) -> None:
        for k in range(SQL_LEVELS):
            others = lambda frame: f"coalesce(string_agg(digest, '') OVER (PARTITION BY {key}, rank // 16 ORDER BY rank ROWS BETWEEN {frame}), '')"
            ctes.append(f"{x}{k}s AS (SELECT *, CASE WHEN n > 1 THEN {others('UNBOUNDED PRECEDING AND 1 PRECEDING')} ELSE '' END AS l, CASE WHEN n > 1 THEN {others('1 FOLLOWING AND UNBOUNDED FOLLOWING')} ELSE '' END AS r FROM {x}{k})")
            ctes.append(f"{x}{k + 1} AS (SELECT {key}, rank // 16 AS rank, (any_value(n) + 15) // 16 AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY rank)) ELSE any_value(digest) END AS digest FROM {x}{k} GROUP BY {key}, rank // 16)")

    levels("s", "source")
    ctes.append(f"t0 AS (SELECT source, 1 AS one, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank, count(*) OVER () AS n, digest FROM s{SQL_LEVELS})")
    levels("t", "one")
    joins = " ".join([f"JOIN s{k}s ON s{k}s.source IS NOT DISTINCT FROM d.source AND s{k}s.rank = s0.rank // {16**k}" for k in range(1, SQL_LEVELS)] + ["JOIN t0 ON t0.source IS NOT DISTINCT FROM d.source"] + [f"JOIN t{k}s ON t{k}s.rank = t0.rank // {16**k}" for k in range(SQL_LEVELS)])
    steps = [f"s{k}s" for k in range(SQL_LEVELS)] + [f"t{k}s" for k in range(SQL_LEVELS)]
    lists = ", ".join(f"{s}.l AS l{k}, {s}.r AS r{k}, {s}.n > 1 AS h{k}" for k, s in enumerate(steps))
    ctes.append(f"p AS (SELECT d.doc_id, d.leaf, t0.digest AS subroot, top.digest AS root, d.current AS f, {lists} FROM d JOIN s0s ON s0s.row = d.row JOIN s0 ON s0.row = d.row {joins} CROSS JOIN t{SQL_LEVELS} top)")
    last = "p"
    for k in range(len(steps)):
        ctes.append(f"p{k} AS (SELECT * REPLACE (CASE WHEN h{k} THEN sha256(l{k} || f || r{k}) ELSE f END AS f) FROM {last})")
        last = f"p{k}"
    proof = " || ".join(f"l{k} || r{k}" for k in range(len(steps)))
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, f AS folded_root, f = root AS verified FROM {last}"


SQL = {"op11_merkle_manifest": _sql()}
