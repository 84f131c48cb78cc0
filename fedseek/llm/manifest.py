"""Merkle manifest of a table: a tree of hashes for each source, and one over the sources.

A leaf is the hash of a row's fields. Rows are dealt by ranges of (source,
doc_id), so that a partition has neighbouring leaves of a few trees, and a
source of any size is many partitions. A Forest holds the nodes of a stretch of
leaves that have no parent yet, keyed by (tree, level, index). As the number of
leaves of each tree is known, so is the number of siblings of each run, and a
run becomes its parent as soon as all its nodes are there. Merging forests is
associative and commutative, and the empty forest changes nothing; what is left
of a stretch is a few nodes for each level. Forests of neighbouring partitions
are merged FAN at a time, level by level, down to the root; then the siblings
on the way to the root come back the same way, and each partition proves its
own leaves. No task and no driver holds more than FAN such remainders or one
partition.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fedseek.llm.common import before_blocks, ordered, stored

#: Siblings of a run, leaves of a partition, forests that one task merges.
ARITY, ROWS, FAN = 3, 50_000, 64
#: The tree over the sources.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Key = tuple[int, int, int]
#: What stands left and right of a node in its run.
Step = tuple[str, str]

NODE = "block bigint, tree bigint, level int, idx bigint, leaves bigint, digest string"
PATH = "block bigint, tree bigint, level int, idx bigint, left array<string>, right array<string>"
PROOF = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def folded(leaf: str, path: Iterable[Step]) -> str:
    """What leaf and its siblings come to."""
    for left, right in path:
        leaf = sha256((left + leaf + right).encode()).hexdigest()
    return leaf


def widths(leaves: int) -> list[int]:
    """Nodes of each level of a tree, the root's level last."""
    out = [leaves]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


class Forest:
    """Nodes without a parent yet, and for those that have one: the parent, and the step to it."""

    def __init__(self) -> None:
        self.open: dict[Key, str] = {}
        self.parent: dict[Key, tuple[Key, Step | None]] = {}
        self.widths: dict[int, list[int]] = {}
        self.leaves: dict[int, int] = {}

    def size(self, tree: int, leaves: int) -> None:
        if tree not in self.widths:
            self.widths[tree], self.leaves[tree] = widths(leaves), leaves

    def add(self, tree: int, level: int, idx: int, node: str) -> None:
        """Adds a node and resolves the runs that it completes; the sizes of its tree and of TOP are known."""
        while True:
            self.open[tree, level, idx] = node
            across = self.widths[tree]
            if level == len(across) - 1:
                if tree == TOP:
                    return
                self.parent[tree, level, idx] = (TOP, 0, tree), None  # a subroot is a leaf of the tree over the sources
                del self.open[tree, level, idx]
                tree, level, idx = TOP, 0, tree
                continue
            first = idx - idx % ARITY
            run = [(tree, level, i) for i in range(first, min(first + ARITY, across[level]))]
            if not all(k in self.open for k in run):
                return
            nodes = [self.open.pop(k) for k in run]
            for i, k in enumerate(run):
                self.parent[k] = (tree, level + 1, first // ARITY), ("".join(nodes[:i]), "".join(nodes[i + 1 :]))
            level, idx, node = level + 1, first // ARITY, digest(*nodes)

    def merge(self, nodes: pa.Table, sources: int) -> Forest:
        """Takes in the open nodes of others."""
        self.size(TOP, sources)
        for r in nodes.select(["tree", "level", "idx", "leaves", "digest"]).to_pylist():
            self.size(r["tree"], r["leaves"])
            self.add(r["tree"], r["level"], r["idx"], r["digest"])
        return self

    def path(self, key: Key) -> tuple[Key, list[Step]]:
        """The open node above key and the steps to it."""
        steps = []
        while key in self.parent:
            key, step = self.parent[key]
            if step:
                steps.append(step)
        return key, steps

    def table(self, block: int) -> pa.Table:
        rows = [(block, *k, self.leaves[k[0]], x) for k, x in self.open.items()]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        return _table(rows, kinds, ("block", "tree", "level", "idx", "leaves", "digest"))


def _table(rows: list[tuple], kinds: Iterable[pa.DataType], names: Iterable[str]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * len(list(names))
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=list(names))


def _planted(rows: pa.Table, shape: list[dict], sources: int) -> tuple[Forest, list[tuple[dict, Key]]]:
    """The forest of a partition's leaves, and the leaves in order with their keys."""
    forest, keys = Forest(), []
    forest.size(TOP, sources)
    at = {}
    for s in shape:
        forest.size(s["tree"], s["leaves"])
        at[s["source"]] = [s["tree"], s["first"]]
    for r in rows.sort_by("pos").to_pylist():
        tree, i = at[r["source"]]
        at[r["source"]][1] += 1
        keys.append((r, (tree, 0, i)))
        forest.add(tree, 0, i, r["leaf"])
    return forest, keys


def field(c: Column) -> Column:
    """`-` for null, else the UTF-8 byte count of the decimal or text, a colon, and it."""
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(**changed: Column) -> Column:
    """Hash of a row's fields, some of them changed."""
    return F.sha2(F.concat(*(field(changed.get(c, F.col(c))) for c in FIELDS)), 256)


def _shape(leaves: DataFrame) -> tuple[DataFrame, int]:
    """source, block, tree (rank of the source), leaves (of the source), first (leaf of it in the block); number of sources.

    A row for each source of each block. What one task sorts is a row for each
    block of a source, or the sources that begin in one block; the driver sees
    a number for each block.
    """
    per = stored(leaves.groupBy("source", "block").agg(F.count("*").alias("n")))
    own = Window.partitionBy("source")
    per_source = per.groupBy("source").agg(F.min("block").alias("begins"), F.sum("n").alias("leaves"))
    ranked = stored(per_source.withColumn("tree", F.row_number().over(Window.partitionBy("begins").orderBy(F.asc_nulls_first("source"))).cast("long") - 1))
    before, total = before_blocks(ranked, "begins")
    trees = ranked.join(before, "begins").select(F.col("source").alias("own"), "leaves", (F.col("tree") + F.col("before")).alias("tree"))
    first = per.withColumn("first", F.sum("n").over(own.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    return first.join(trees, F.col("source").eqNullSafe(F.col("own"))).select("source", "block", "tree", "leaves", F.coalesce("first", F.lit(0)).cast("long").alias("first")), total


def manifest(docs: DataFrame, tampered: Column, changed: dict[str, Column], rows: int = ROWS, fan: int = FAN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of docs (doc_id, source, lang, n_chars, text).

    tampered says which rows are checked with `changed` in place of their
    columns; null counts as false. Other columns are not looked at. A null
    source is a source of its own, the first; a null doc_id stands before all
    others of its source. Rows that repeat a doc_id are leaves of their own,
    ordered by their hashes; equal rows have equal leaves and proofs of the
    places they stand at. A null field hashes unlike an empty one. No rows give
    no rows and no root. Texts are hashed whole.
    """
    hashed = docs.select("source", "doc_id", leaf().alias("leaf"), F.when(tampered, leaf(**changed)).alias("found"))
    leaves = ordered(hashed, [F.asc_nulls_first(c) for c in ("source", "doc_id", "leaf")], rows)
    blocks = (leaves.agg(F.max("block")).first()[0] or 0) + 1
    shape, sources = _shape(leaves)
    shape = stored(shape)

    def up(key: tuple[pa.Scalar, ...], leaves: pa.Table, shape: pa.Table) -> pa.Table:
        return _planted(leaves, shape.to_pylist(), sources)[0].table(key[0].as_py())

    def merge(key: tuple[pa.Scalar, ...], nodes: pa.Table) -> pa.Table:
        return Forest().merge(nodes, sources).table(key[0].as_py())

    above = (F.col("block") / fan).cast("long")
    rounds = [stored(leaves.groupBy("block").cogroup(shape.groupBy("block")).applyInArrow(up, NODE))]
    while blocks > 1:
        blocks = -(-blocks // fan)
        rounds.append(stored(rounds[-1].withColumn("block", above).groupBy("block").applyInArrow(merge, NODE)))
    last = [r.digest for r in rounds[-1].select("digest").collect()]  # one: the root
    root = last[0] if last else ""

    def down(key: tuple[pa.Scalar, ...], nodes: pa.Table, paths: pa.Table) -> pa.Table:
        forest = Forest().merge(nodes, sources)
        far = {(r["tree"], r["level"], r["idx"]): (r["left"], r["right"]) for r in paths.to_pylist()}
        out = []
        for r in nodes.to_pylist():
            own = r["tree"], r["level"], r["idx"]
            to, steps = forest.path(own)
            out.append((r["below"], *own, [x for x, _ in steps] + far[to][0], [x for _, x in steps] + far[to][1]))
        texts = pa.list_(pa.string())
        return _table(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), texts, texts), ("block", "tree", "level", "idx", "left", "right"))

    paths = rounds[-1].select("block", "tree", "level", "idx", F.array().cast("array<string>").alias("left"), F.array().cast("array<string>").alias("right"))
    for nodes in rounds[-2::-1]:
        grouped = nodes.withColumn("below", F.col("block")).withColumn("block", above).groupBy("block")
        paths = stored(grouped.cogroup(paths.groupBy("block")).applyInArrow(down, PATH))

    def prove(key: tuple[pa.Scalar, ...], leaves: pa.Table, side: pa.Table) -> pa.Table:
        side = side.to_pylist()
        forest, keys = _planted(leaves, [s for s in side if s["left"] is None], sources)
        far = {(s["tree"], s["level"], s["idx"]): list(zip(s["left"], s["right"], strict=True)) for s in side if s["left"] is not None}
        subroot, out = {}, []
        for r, at in keys:
            to, path = forest.path(at)
            path += far[to]
            tree = at[0]
            if tree not in subroot:
                subroot[tree] = folded(r["leaf"], path[: len(forest.widths[tree]) - 1])
            came = folded(r["leaf"] if r["found"] is None else r["found"], path)
            out.append((r["doc_id"], r["leaf"], subroot[tree], root, digest(*(x for step in path for x in step)), came, came == root))
        text = pa.string()
        return _table(out, (pa.int64(), text, text, text, text, text, pa.bool_()), ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))

    side = shape.unionByName(paths, allowMissingColumns=True)
    return leaves.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(prove, PROOF)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its proof; documents whose id's crc32 is even are checked without their line ends."""
    from fedseek.llm.common import documents

    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(documents(spark, sf_dir), even, {"text": F.replace("text", F.lit("\n"), F.lit(""))})


#: crc32 of the decimal digits, bit by bit; then the trees level by level, the steps of every node, and each document's way up.
ORACLE = """
WITH RECURSIVE hashed AS (
    SELECT row_number() OVER () AS rid, doc_id, source, sha256({leaf}) AS leaf,
        CASE WHEN list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, k: xor(d >> 1, 3988292384 * (d & 1)))) % 2 = 1
            THEN sha256({found}) END AS found
    FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM hashed),
nodes AS (SELECT tree, 0 AS level, idx, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed
    UNION ALL SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 3, n),
tops AS (SELECT 0 AS level, tree AS idx, digest, (SELECT count(DISTINCT tree) FROM placed) AS n FROM nodes WHERE n = 1
    UNION ALL SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, idx // 3, n),
steps AS (SELECT tree, level, idx, coalesce(string_agg(digest, '') OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
        coalesce(string_agg(digest, '') OVER (l ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
    FROM (SELECT tree, level, idx, digest FROM nodes WHERE n > 1 UNION ALL SELECT -1, level, idx, digest FROM tops WHERE n > 1)
    WINDOW l AS (PARTITION BY tree, level, idx // 3 ORDER BY idx)),
ways AS (SELECT rid, list(lft || '|' || rgt ORDER BY s.tree < 0, level) AS way, string_agg(lft || rgt, '' ORDER BY s.tree < 0, level) AS beside
    FROM placed p JOIN steps s ON s.tree = p.tree AND s.idx = p.idx // (3 ** s.level)::bigint OR s.tree = -1 AND s.idx = p.tree // (3 ** s.level)::bigint GROUP BY rid),
ends AS (SELECT p.*, (SELECT digest FROM tops WHERE n = 1) AS root, sha256(coalesce(beside, '')) AS proof_sha256,
        list_reduce(list_prepend(coalesce(found, leaf), coalesce(way, [])), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
    FROM placed p LEFT JOIN ways USING (rid))
SELECT doc_id, leaf, (SELECT digest FROM nodes t WHERE t.n = 1 AND t.tree = e.tree) AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM ends e
"""


def _leaf_sql(text: str) -> str:
    return " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({x}::varchar) || ':' || {x} END" for c, x in [(c, text if c == "text" else c) for c in FIELDS])


ORACLE = ORACLE.format(leaf=_leaf_sql("text"), found=_leaf_sql("replace(text, chr(10), '')"))
