"""Merkle manifest of a dataset: a SHA midstate tree over its rows.

Every row is a leaf (SHA-256 of its fields); every ``FAN`` consecutive nodes of a
group become their parent until one is left, the group's subroot; the subroots,
in group order, become the root in the same way.

A parent keeps a copy of its hash state before each child slot (``Parent``), so a
changed child is folded by resuming the state before its slot with the
replacement and the siblings to its right; those to its left are already in the
state.

The tree is cut into pieces of ``FAN ** LEVELS`` consecutive nodes, each built by one
task call of bounded size; the roots of the pieces are the nodes of the next
stage, so a group of any size takes height / LEVELS stages.  Going down
again, each piece is handed the steps from its root to the dataset's root (a
few dozen digests), rebuilds their states once, and proves and folds its leaves
there.  Positions come from a range-partitioned running count, so a hot group is
spread over all tasks.

Defined results: a null field is `-`; leaves with equal ids stand in the order of
their digests, equal rows are interchangeable leaves; null ids and the null group
come first; a row with a null id is never tampered with, one with a null n_chars
stays as it is; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatekit.llm.common import Scratch, running, ship_package, table

FAN = 2                  # children of a parent
LEVELS = 12              # levels of one piece, which has FAN ** LEVELS nodes at most
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 7

NODES = "grp string, idx long, digest string, many long"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Parent:
    """The digest of some children, and the state before each child's slot."""

    def __init__(self, children: Sequence[str]):
        self.children = list(children)
        self.states = []
        state = hashlib.sha256()
        for c in self.children:
            self.states.append(state.copy())
            state.update(c.encode())
        self.digest = state.hexdigest()

    def fold(self, slot: int, digest: str) -> str:
        """The digest with ``digest`` in ``slot``: the state before it, the
        replacement, the right siblings."""
        state = self.states[slot].copy()
        state.update(digest.encode())
        for c in self.children[slot + 1:]:
            state.update(c.encode())
        return state.hexdigest()

    def siblings(self, slot: int) -> str:
        return "".join(c for i, c in enumerate(self.children) if i != slot)


def height(many: int) -> int:
    """Levels above ``many`` nodes."""
    n = 0
    while many > 1:
        many, n = -(-many // FAN), n + 1
    return n


class Piece:
    """The lowest levels, at most ``levels``, over consecutive nodes of a group
    of ``many``."""

    def __init__(self, digests: Sequence[str], many: int, levels: int = LEVELS):
        self.levels: list[list[Parent]] = []
        nodes = list(digests)
        for _ in range(min(levels, height(many))):
            row = [Parent(nodes[i:i + FAN]) for i in range(0, len(nodes), FAN)]
            self.levels.append(row)
            nodes = [p.digest for p in row]
        self.root = nodes[0]

    def steps(self, at: int) -> list[tuple[Parent, int]]:
        """(parent, slot) from node ``at`` up to the piece's root."""
        out = []
        for row in self.levels:
            out.append((row[at // FAN], at % FAN))
            at //= FAN
        return out


def fold(steps: Sequence[tuple[Parent, int]], digest: str) -> str:
    for parent, slot in steps:
        digest = parent.fold(slot, digest)
    return digest


# A path is one string: `slot:child,child` for each step, joined by `;`.
def path_text(steps: Sequence[tuple[Parent, int]]) -> str:
    return ";".join(f"{slot}:{','.join(p.children)}" for p, slot in steps)


def path_steps(text: str) -> list[tuple[Parent, int]]:
    out = []
    for step in text.split(";") if text else []:
        slot, _, children = step.partition(":")
        out.append((Parent(children.split(",")), int(slot)))
    return out


def joined(low: str, high: str) -> str:
    return f"{low};{high}" if low and high else low or high


def _piece(nodes: pa.Table, levels: int) -> Piece:
    return Piece(nodes.column("digest").to_pylist(), nodes.column("many")[0].as_py(), levels)


def _path(above: pa.Table) -> str:
    return above.column("path")[0].as_py() if above.num_rows else ""


def _build(levels: int):
    """The root of one piece as a node of the next stage."""
    def run(key: tuple, nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("idx")
        many = -(-nodes.column("many")[0].as_py() // FAN ** levels)
        return pa.table({"grp": pa.array([key[0].as_py()], pa.string()), "idx": pa.array([key[1].as_py()], pa.int64()),
                         "digest": [_piece(nodes, levels).root], "many": pa.array([many], pa.int64())})
    return run


def _hand_down(levels: int):
    """The path to the root for every node of one piece."""
    def run(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("idx")
        paths: list[str] = []
        if nodes.num_rows:
            piece, up = _piece(nodes, levels), _path(above)
            paths = [joined(path_text(piece.steps(i)), up) for i in range(nodes.num_rows)]
        return pa.table({"grp": nodes.column("grp"), "idx": nodes.column("idx"), "path": pa.array(paths, pa.string())})
    return run


def _prove(levels: int):
    """Proof and folded root of every leaf of one piece."""
    def run(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("idx")
        leaves, changed = nodes.column("digest").to_pylist(), nodes.column("tampered").to_pylist()
        proofs, folded = [], []
        if leaves:
            piece, up = _piece(nodes, levels), path_steps(_path(above))
            top = "".join(p.siblings(s) for p, s in up)
            ends: dict[str, str] = {}        # equal piece roots fold alike above
            for i, leaf_digest in enumerate(leaves):
                steps = piece.steps(i)
                proofs.append(h(*[p.siblings(s) for p, s in steps], top))
                root = fold(steps, changed[i] or leaf_digest)
                if root not in ends:
                    ends[root] = fold(up, root)
                folded.append(ends[root])
        return pa.table({"row_id": nodes.column("row_id"), "proof_sha256": pa.array(proofs, pa.string()),
                         "folded_root": pa.array(folded, pa.string())})
    return run


def _by_piece(df: DataFrame, per: int):
    return df.groupBy("grp", F.expr(f"idx div {per}").alias("piece"))


class Forest:
    """Stages of nodes above the trees of all groups, each a written table."""

    def __init__(self, nodes: DataFrame, scratch: Scratch, name: str, levels: int = LEVELS):
        self.scratch, self.name, self.levels = scratch, name, levels
        self.per = FAN ** levels
        self.stages = [nodes]
        while (self.stages[-1].agg(F.max("many").alias("m")).first()["m"] or 0) > 1:
            up = _by_piece(self.stages[-1].select("grp", "idx", "digest", "many"), self.per).applyInArrow(_build(levels), NODES)
            self.stages.append(scratch.write(up, f"{name}-{len(self.stages)}"))
        # one node a group
        self.roots = self.stages[-1].select("grp", "digest")

    def paths(self, above: DataFrame) -> DataFrame:
        """(grp, idx, path): the path above each piece of the first stage.
        ``above``: that of each group's root, as index 0."""
        path = above
        for k in range(len(self.stages) - 2, 0, -1):     # the last stage's nodes have their groups' paths
            down = _by_piece(self.stages[k], self.per).cogroup(_by_piece(path, 1)).applyInArrow(
                _hand_down(self.levels), "grp string, idx long, path string")
            path = self.scratch.write(down, f"{self.name}-path-{k}")
        return path


def field(c: str) -> Column:
    """`-` for null, else byte count, `:`, value."""
    v = F.col(c).cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf(fields: Sequence[str], replaced: dict[str, Column] | None = None) -> Column:
    parts = []
    for c in fields:
        if replaced and c in replaced:
            v = replaced[c].cast("string")
            parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
        else:
            parts.append(field(c))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang",
             fields: Sequence[str] = FIELDS, tampered: Column | None = None,
             levels: int = LEVELS) -> DataFrame:
    """One row per row: id, leaf, subroot, root, proof_sha256, folded_root,
    verified.  ``tampered``: digest of the leaf as it is found now, null where
    it is unchanged."""
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "merkle")
    found = tampered if tampered is not None else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.concat(F.lit("="), F.col(group_col).cast("string")).alias("g"),
                       leaf(fields).alias("digest"), found.alias("tampered"))
    # the null group's key is the empty string, the others' start with =
    rows = rows.select("id", F.coalesce("g", F.lit("")).alias("grp"), "digest", "tampered",
                       F.monotonically_increasing_id().alias("row_id"))
    rows = scratch.write(rows, "rows")
    many = scratch.write(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("many")), "many")
    order = [F.col("id").asc_nulls_first(), "digest", "row_id"]
    placed = running(rows, ["grp"], order, {"at": F.lit(1)}, scratch, "ranged")
    leaves = scratch.write(placed.join(many, "grp").withColumn("idx", F.col("at") - 1).drop("at"), "leaves")
    scratch.drop("ranged")
    trees = Forest(leaves, scratch, "tree", levels)

    groups = scratch.write(trees.roots, "subroots")
    top = running(groups.select(F.col("grp").alias("own"), "digest"), [], ["own"], {"at": F.lit(1)}, scratch, "groups")
    total = groups.agg(F.count(F.lit(1)).alias("many"))
    top = scratch.write(top.select(F.lit("").alias("grp"), "own", (F.col("at") - 1).alias("idx"), "digest")
                        .crossJoin(F.broadcast(total)), "top")        # one row
    crown = Forest(top, scratch, "crown", levels)
    root = crown.roots.select(F.col("digest").alias("root"))
    none = spark.range(1).select(F.lit("").alias("grp"), F.lit(0).cast("long").alias("idx"), F.lit("").alias("path"))
    above = _by_piece(top.select("grp", "idx", "digest", "many"), crown.per).cogroup(
        _by_piece(crown.paths(none), 1)).applyInArrow(
        _hand_down(levels), "grp string, idx long, path string")
    above = scratch.write(top.select("own", "idx").join(above.select("idx", "path"), "idx")
                          .select(F.col("own").alias("grp"), F.lit(0).cast("long").alias("idx"), "path"), "above")
    path = trees.paths(above)

    proved = scratch.write(
        _by_piece(leaves.select("grp", "idx", "digest", "many", "tampered", "row_id"), trees.per)
        .cogroup(_by_piece(path, 1))
        .applyInArrow(_prove(levels), "row_id long, proof_sha256 string, folded_root string"), "proved")
    out = leaves.join(proved, "row_id").join(groups.select("grp", F.col("digest").alias("subroot")), "grp")
    out = out.crossJoin(F.broadcast(root))                            # one row
    return out.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256",
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPER_EVERY)) == 0
    more = leaf(FIELDS, {"n_chars": F.col("n_chars").cast("long") + 1})
    return manifest(docs, tampered=F.when(hit & F.col("n_chars").isNotNull(), more))


SQL = r"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, n_chars,
    sha256(concat(coalesce(concat(octet_length(encode(doc_id::VARCHAR)), ':', doc_id), '-'),
      coalesce(concat(octet_length(encode(source)), ':', source), '-'),
      coalesce(concat(octet_length(encode(lang)), ':', lang), '-'),
      coalesce(concat(octet_length(encode(n_chars::VARCHAR)), ':', n_chars), '-'),
      coalesce(concat(octet_length(encode(text)), ':', text), '-'))) AS leaf,
    sha256(concat(coalesce(concat(octet_length(encode(doc_id::VARCHAR)), ':', doc_id), '-'),
      coalesce(concat(octet_length(encode(source)), ':', source), '-'),
      coalesce(concat(octet_length(encode(lang)), ':', lang), '-'),
      coalesce(concat(octet_length(encode((n_chars + 1)::VARCHAR)), ':', n_chars + 1), '-'),
      coalesce(concat(octet_length(encode(text)), ':', text), '-'))) AS changed,
    concat('=', lang) || CASE WHEN lang IS NULL THEN NULL ELSE '' END AS tagged
  FROM documents),
-- crc32 of the decimal doc_id, bit by bit
digits AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s FROM leaves WHERE doc_id IS NOT NULL),
crc(doc_id, s, i, c) AS (
  SELECT doc_id, s, 0, 4294967295::BIGINT FROM digits
  UNION ALL
  SELECT doc_id, s, i + 1, CASE WHEN i % 9 = 0 THEN xor(c, ascii(substr(s, i // 9 + 1, 1))::BIGINT)
    WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END
  FROM crc WHERE i < 9 * length(s)),
hits AS (SELECT doc_id FROM crc WHERE i = 9 * length(s) AND xor(c, 4294967295::BIGINT) % 7 = 0),
placed AS (
  SELECT l.doc_id, leaf, coalesce(tagged, '') AS grp,
    CASE WHEN l.doc_id IN (SELECT doc_id FROM hits) THEN changed ELSE leaf END AS found,
    row_number() OVER (PARTITION BY lang ORDER BY l.doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY lang) AS many
  FROM leaves l),
nodes AS (
  SELECT grp, 0 AS lvl, idx, leaf AS digest, many FROM placed
  UNION ALL
  SELECT grp, lvl + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(many) + 1) // 2
  FROM nodes WHERE many > 1 GROUP BY grp, lvl, idx // 2),
subroots AS (SELECT grp, digest, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS many
             FROM nodes WHERE many = 1),
crown AS (
  SELECT 0 AS lvl, idx, digest, many FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(many) + 1) // 2
  FROM crown WHERE many > 1 GROUP BY lvl, idx // 2),
folds(doc_id, grp, first, lvl, idx, cur, proof) AS (
  SELECT doc_id, grp, idx, 0, idx, found, '' FROM placed
  UNION ALL
  SELECT f.doc_id, f.grp, f.first, f.lvl + 1, f.idx // 2,
    sha256(CASE WHEN f.idx % 2 = 0 THEN f.cur || coalesce(s.digest, '') ELSE s.digest || f.cur END),
    f.proof || coalesce(s.digest, '')
  FROM folds f JOIN nodes n ON n.grp = f.grp AND n.lvl = f.lvl AND n.idx = f.idx AND n.many > 1
  LEFT JOIN nodes s ON s.grp = f.grp AND s.lvl = f.lvl AND s.idx = xor(f.idx, 1)),
low AS (SELECT f.doc_id, f.grp, f.first, f.cur, f.proof, r.idx, r.digest AS subroot
        FROM folds f JOIN nodes n ON n.grp = f.grp AND n.lvl = f.lvl AND n.many = 1
        JOIN subroots r ON r.grp = f.grp),
climbs(grp, first, subroot, lvl, idx, cur, proof) AS (
  SELECT grp, first, subroot, 0, idx, cur, proof FROM low
  UNION ALL
  SELECT f.grp, f.first, f.subroot, f.lvl + 1, f.idx // 2,
    sha256(CASE WHEN f.idx % 2 = 0 THEN f.cur || coalesce(s.digest, '') ELSE s.digest || f.cur END),
    f.proof || coalesce(s.digest, '')
  FROM climbs f JOIN crown n ON n.lvl = f.lvl AND n.idx = f.idx AND n.many > 1
  LEFT JOIN crown s ON s.lvl = f.lvl AND s.idx = xor(f.idx, 1))
SELECT p.doc_id, p.leaf, c.subroot, t.digest AS root, sha256(c.proof) AS proof_sha256,
  c.cur AS folded_root, c.cur = t.digest AS verified
FROM climbs c JOIN crown t ON t.lvl = c.lvl AND t.many = 1
JOIN placed p ON p.grp = c.grp AND p.idx = c.first
"""
