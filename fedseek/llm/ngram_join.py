"""N-gram Jaccard join with several global token orders.

Two sets of likeness t or more have a common token among the first
n - ceil(t n) + 1 of each, in any order of all tokens that is the same for all
sets. Three such orders are used one after the other, so that candidates must
share a prefix token in each, and only then are whole sets compared.

First order: the tokens of a region, a fixed part of the hash space, by how
many sets have them, the rarest first, then the others by hash. The region is
WIDE times as long as a prefix, so counting a part of the tokens is enough.
Most tokens of a document occur nowhere else, fill its prefix and link it with
nothing, so that few documents go on. Second order: all tokens of those that
went on, by how many of them have it, the rarest first. The sets with a token
in their prefix are its bucket. Third order: by another hash. There a prefix of
LONG lengths is kept: all tokens below the end of the shorter one are known of
both sets, which bounds what the sets can have in common.

Documents of equal sets are one node, and buckets of equal nodes one bucket.
In a bucket of up to SMALL nodes pairs are formed by a join; sets are compared
for one pair of each node first, then for the pairs that are not yet
connected. In a larger bucket each node is compared with one pivot, the same
for buckets that share it; what is then in one component needs nothing more,
so that a large group of near copies does not become all its pairs. Buckets
that still hold several components are compared block against block by matrix
products, for the nodes only that the tokens of a part of the third order
allow a partner of another component, and each block returns a spanning forest
of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fedseek.llm import shingles
from fedseek.llm.common import SPACE, dropped, free_name, stored
from fedseek.llm.graph import components

K, NUM, DEN = 3, 90, 100
#: Length of the first order's region in prefixes, and nodes of a bucket whose pairs are formed.
WIDE, SMALL = 1.6, 24
#: Prefix lengths that are kept in the third order.
LONG = 2
#: The part of the third order that the members of a large bucket are held against first: 1/LOW.
LOW = 2
#: Nodes, and tokens of their sets, of a block.
BLOCK, BLOCK_TOKENS = 256, 250_000
#: The low bits of a token that say whether it is in the region.
PLACE = 0xFFFF
#: Ids that may be sent to all tasks.
SENT = 1_000_000
SALT = np.uint64(0xD6E8FEB86659FD93)


def prefix_size(n: int, num: int = NUM, den: int = DEN) -> int:
    return n - -(-n * num // den) + 1


def _node(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))


def region(num: int, den: int) -> int:
    """Tokens whose bits of PLACE are below this are in the region."""
    return min(PLACE + 1, int(WIDE * (den - num) / den * (PLACE + 1)) + 1)


def _first_pass(k: int, num: int, den: int):
    """doc_id, key, size of the set, its node, and its tokens in the region; if these are fewer than a prefix, the others that fill it."""
    end = np.uint64(region(num, den))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shingles.slices(batch, "text"):
                found = shingles.sets(part.column("text"), k)
                some = []
                for s in found:
                    near = (s & np.uint64(PLACE)) < end
                    inside = s[near]
                    p = prefix_size(len(s), num, den) if len(s) else 0
                    some.append(inside if len(inside) >= p else np.concatenate([inside, s[~near][: p - len(inside)]]))
                node = np.array([_node(s) for s in found], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array([len(s) for s in found], pa.int32()), pa.array(node.view(np.int64)), shingles.as_lists(some)],
                    names=["doc_id", "key", "n", "node", "tokens"],
                )

    return scan, "doc_id bigint, key bigint, n int, node bigint, tokens array<bigint>"


def may_link(su: Column, sv: Column, nu: Column, nv: Column, num: int, den: int) -> Column:
    """False only where sets of nu and nv tokens can't link, by their least tokens su and sv in one order (cut, sorted)."""
    end = F.least(F.element_at(su, -1), F.element_at(sv, -1))
    below = lambda s: F.filter(s, lambda x: x < end)
    u, v = below(su), below(sv)
    # tokens of u that are equal when cut all count as common
    known = F.size(F.array_intersect(u, v)) + F.size(u) - F.size(F.array_distinct(u))
    most = known + F.least(nu - F.size(u), nv - F.size(v))
    return F.arrays_overlap(su, sv) & (most * den >= num * (nu + nv - most))


def _text_pass(k: int, num: int, den: int):
    """Of rows (node, text) whose text is the node's: the whole set and, cut to 31 bits as they only filter, its least in the third order (LONG prefixes, sorted) and those in the lowest 1/LOW of that order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shingles.slices(batch, "text"):
                found = shingles.sets(part.column("text"), k)
                # rows of one key may differ in text
                right = np.array([_node(s) for s in found], dtype=np.uint64).view(np.int64) == part.column("node").to_numpy()
                orders = [np.sort(shingles.finish(s * SALT)) for s in found]
                low = [x[: np.searchsorted(x, np.uint64(2**64 // LOW))] >> np.uint64(33) for x in orders]
                least = [x[: LONG * prefix_size(len(x), num, den)] >> np.uint64(33) for x in orders]
                cut = [shingles.as_lists(x).cast(pa.list_(pa.int32()), safe=False) for x in (least, low)]
                yield pa.RecordBatch.from_arrays([part.column("node"), shingles.as_lists(found), *cut], names=["node", "s", "least", "low"]).filter(pa.array(right))

    return scan, "node bigint, s array<bigint>, least array<int>, low array<int>"


def _overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many tokens set i of a and set j of b have in common."""
    sizes = np.array([len(s) for s in sets])
    _, which = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(which) > 1
    column = np.cumsum(often) - 1
    use = often[which] if len(which) else np.zeros(0, dtype=bool)
    row, which = row[use], column[which[use]]
    common = np.zeros((len(a), len(b)), dtype=np.float32)
    for lo in range(0, int(often.sum()), 4096):
        at = (which >= lo) & (which < lo + 4096)
        m = np.zeros((len(sets), min(4096, int(often.sum()) - lo)), dtype=np.float32)
        m[row[at], which[at] - lo] = 1
        common += m[a] @ m[b].T
    return common.astype(np.int64)


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return a, b if len(b) else a


def hopeful(n: np.ndarray, low: list[np.ndarray], side: np.ndarray, kept_apart: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Whether each set of n tokens may link another: by its low tokens, and with no label of kept_apart equal."""
    distinct = [np.unique(x) for x in low]
    a, b = _sides(side)
    got = np.array([len(x) for x in low])
    # tokens that are equal when cut all count as common
    known = _overlaps(distinct, a, b) + (got - [len(x) for x in distinct])[a][:, None]
    most = known + np.minimum((n - got)[a][:, None], (n - got)[b][None, :])
    may = most * den >= num * (n[a][:, None] + n[b][None, :] - most)
    for label in kept_apart:
        may &= label[a][:, None] != label[b][None, :]
    out = np.zeros(len(n), dtype=bool)
    out[a[may.any(axis=1)]] = True
    out[b[may.any(axis=0)]] = True
    return out


def forest(node: np.ndarray, sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect what the links between the nodes connect. side: 0 or 1; links of equal nodes or within side 1 are another block's."""
    sizes = np.array([len(s) for s in sets])
    a, b = _sides(side)
    common = _overlaps(sets, a, b)
    linked = common * den >= num * (sizes[a][:, None] + sizes[b][None, :] - common)
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = find(a[i]), find(b[j])
        if x != y:
            root[x] = y
            out.append((int(node[a[i]]), int(node[b[j]])))
    return out


def _prefixes(tokens: DataFrame, sizes: DataFrame, of_region: bool, num: int, den: int) -> DataFrame:
    """node, token: the prefix of each node as far as other nodes have its tokens, with c, the nodes that have the token in theirs, above 1.

    tokens: node, token, each pair once. sizes: node, n, counted. The order is
    by how many nodes have a token, then by token; with of_region tokens beyond
    the region come last, and counted says how many of a node are within.
    """
    # counts are stored before they are joined: behind an aggregate a token that very many nodes have could not be split
    df = stored(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    last = (F.col("token").bitwiseAND(PLACE) >= region(num, den)) if of_region else F.lit(False)
    met = tokens.join(df, "token").groupBy("node").agg(F.collect_list(F.struct(last.alias("last"), F.when(last, 0).otherwise(F.col("df")).alias("df"), "token")).alias("met"))
    # of the counted tokens, those met nowhere else come before; only the rest of the prefix has partners
    p = F.expr(f"n - (n * {num}L + {den - 1}) div {den} + 1").cast("int")
    inside, beyond = F.filter("met", lambda x: ~x.last), F.filter("met", lambda x: x.last)
    allowed = F.greatest(p - (F.col("counted") - F.size(inside)), F.lit(0))
    first = met.join(sizes, "node").select("node", F.explode(F.concat(F.slice(F.array_sort(inside), 1, allowed), beyond)).alias("x"))
    first = stored(first.select("node", F.col("x.token").alias("token")))
    dropped(df)
    c = stored(first.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"))
    out = stored(first.join(c, "token"))
    dropped(first, c)
    return out


def _one_of_equal(members: DataFrame) -> DataFrame:
    """members (token, node and more) without the buckets that hold the same nodes as one that stays."""
    each = members.groupBy("token").agg(F.count("*").alias("k"), *[F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"h{i}") for i in (1, 2)])
    return members.join(_sent(stored(each.groupBy("k", "h1", "h2").agg(F.min("token").alias("token")).select("token"))), "token")


def _sent(table: DataFrame) -> DataFrame:
    """A stored table, for all tasks if it is small; then a hot token's members need not meet in one task."""
    return F.broadcast(table) if table.count() <= SENT else table


def nodes_and_links(docs: DataFrame, k: int = K, num: int = NUM, den: int = DEN) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node) of each row of docs (doc_id, text), and links (u, v) of nodes that connect what likeness connects."""
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    scan, schema = _first_pass(k, num, den)
    rows = stored(docs.mapInArrow(scan, schema).withColumn("row", F.monotonically_increasing_id()))
    sized = rows.select("doc_id", F.col("n").cast("long").alias("n"), "node")
    # one row stands for each node
    each = rows.where("n > 0").groupBy("node", "key").agg(F.count("*").alias("rows"), F.min("row").alias("row"))
    each = stored(each.groupBy("node").agg(F.min(F.struct("key", "rows", "row")).alias("f"), F.sum("rows").alias("copies")).select("node", "f.*", "copies"))
    several = each.where("copies > 1").select(F.col("node").alias("m"), F.col("row").alias("own"))
    several = F.broadcast(several) if several.count() <= SENT else several
    one = rows.where("n > 0").join(several, F.col("node") == F.col("m"), "left").where("own is null or own = row")
    within = F.size(F.filter("tokens", lambda x: x.bitwiseAND(PLACE) < region(num, den)))
    sizes = one.select("node", "n", within.alias("counted"))
    alive = _prefixes(one.select("node", F.explode("tokens").alias("token")), sizes, True, num, den)

    wanted = stored(alive.select("node").distinct().join(each, "node").select("node", "key", "rows"))
    n, most = wanted.agg(F.count("*"), F.max("rows")).first()
    scan, schema = _text_pass(k, num, den)
    # few: their keys go to all tasks and no text moves; many: a join moves the texts
    ids = wanted.select("node", "key")
    texts = docs.join(F.broadcast(ids) if n <= SENT else ids, "key").select("node", "text").mapInArrow(scan, schema)
    data = stored(texts.dropDuplicates(["node"]) if (most or 1) > 1 else texts)
    sizes = data.select("node", F.size("s").alias("n"), F.size("s").alias("counted"))
    members = _prefixes(data.select("node", F.explode("s").alias("token")), sizes, False, num, den)
    dropped(alive, wanted)
    members = _one_of_equal(members).join(sizes.select("node", "n"), "node")
    members = stored(members.select("token", "node", "n", "c"))
    few, crowd = members.where(F.col("c") <= SMALL), members.where(F.col("c") > SMALL)

    def near(pairs: DataFrame) -> DataFrame:
        """Links among pairs (u, v, nu, nv): by the third order, then by whole sets."""
        second = data.select("node", "least")
        pairs = pairs.where(F.least("nu", "nv").cast("long") * den >= F.greatest("nu", "nv").cast("long") * num)
        pairs = pairs.join(second.toDF("u", "su"), "u").join(second.toDF("v", "sv"), "v").where(may_link(*(F.col(c) for c in ("su", "sv", "nu", "nv")), num, den)).select("u", "v")
        whole = data.select("node", "s")
        both = stored(pairs).join(whole.toDF("u", "su"), "u").join(whole.toDF("v", "sv"), "v")
        common = F.size(F.array_intersect("su", "sv")).cast("long")
        return both.where(common * den >= num * (F.size("su") + F.size("sv") - common)).select("u", "v")

    a, b = few.select("token", F.col("node").alias("u"), F.col("n").alias("nu")), few.select("token", F.col("node").alias("v"), F.col("n").alias("nv"))
    pairs = stored(a.join(b, (a.token == b.token) & (a.u < b.v)).select("u", "v", "nu", "nv").distinct())
    # first each node with one other of its small buckets, and with the pivot of its large ones
    pivot = stored(crowd.groupBy("token").agg(F.min_by(F.struct("node", "n"), F.xxhash64("node")).alias("p")))
    star = crowd.join(_sent(pivot), "token").select(F.col("p.node").alias("u"), F.col("node").alias("v"), F.col("p.n").alias("nu"), F.col("n").alias("nv")).where("u != v")
    start = pairs.groupBy("v").agg(F.min(F.struct("u", "nu", "nv")).alias("x")).select("x.u", "v", "x.nu", "x.nv").unionByName(star).distinct()
    links = stored(near(start))
    # then only pairs that this has not connected
    label = components(links)
    left = pairs.join(label.toDF("u", "cu"), "u", "left").join(label.toDF("v", "cv"), "v", "left")
    more = stored(near(left.where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v", "nu", "nv")))
    links = links.unionByName(more)

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        found = forest(g["node"].to_numpy(), list(g["s"]), g["side"].to_numpy(), num, den)
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    def weigh(g: pd.DataFrame) -> pd.DataFrame:
        may = hopeful(g["n"].to_numpy(), list(g["low"]), g["side"].to_numpy(), [g["component"].to_numpy()], num, den)
        return g.loc[may, ["token", "node"]]

    def blocks(these: DataFrame, part: str):
        """these (token, node, n and more) with part of their data, each bucket grouped block against block."""
        per = these.groupBy("token").agg(F.count("*").alias("k"), F.sum("n").alias("tokens")).where("k > 1")
        per = per.select("token", F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int").alias("blocks"))
        many = these.join(per, "token")
        many = many.withColumn("b", F.expr("pmod(xxhash64(node), blocks)").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        many = many.select(*these.columns, F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") > F.col("o")).cast("int").alias("side"))
        return many.join(data.select("node", part), "node").groupBy("token", "i", "j")

    label = components(links).toDF("node", "component")
    state = crowd.select("token", "node", "n").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_buckets = state.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a != b").select("token")
    state = stored(state.join(_sent(stored(open_buckets)), "token"))
    hope = stored(blocks(state, "low").applyInPandas(weigh, "token bigint, node bigint").distinct())
    hope = stored(_one_of_equal(state.select("token", "node", "n").join(hope, ["token", "node"])))
    return sized, links.unionByName(blocks(hope, "s").applyInPandas(compare, "u bigint, v bigint"))


def grouped(docs: DataFrame, k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text).

    component_id is the smallest doc_id that is reached over links, the
    document itself included. A null or empty text, or one without words, has
    an empty set, no link, and is a component of its own. With fewer than k
    words the whole sequence is the one shingle. Equal sets are linked. Rows
    that repeat a doc_id are linked by it. A row without doc_id belongs to the
    documents with its set; if there is none, it has no link and no component.
    """
    sized, links = nodes_and_links(docs, k, num, den)
    # a node is named by its smallest doc_id; components are of these names
    names = stored(sized.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("name")))
    named = links.join(names.toDF("u", "nu"), "u").join(names.toDF("v", "nv"), "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"))
    comp = components(named).toDF("name", "component")
    out = sized.join(names, F.when(sized.n > 0, sized.node) == names.node, "left").drop(names.node)
    out = out.join(comp, "name", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "name", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each group of near duplicates; columns as they were.

    A document is its doc_id, null or not, with its text: rows that repeat an
    id with another text are other documents, and ids link nothing. Of a group
    the smallest by (doc_id, null last, hash of id and text) stays, in one row
    if several repeat it. Rows without words all stay.
    """
    (key,) = free_name(docs, "row_key")
    hashed = F.xxhash64("doc_id", "text")
    sized, links = nodes_and_links(docs.select(hashed.alias("doc_id"), "text"), k, num, den)
    ids = docs.select(hashed.alias("id_key"), "doc_id").groupBy("id_key").agg(F.first("doc_id").alias("id"), F.count("*").alias("rows"))
    comp = components(links).toDF("node", "component")
    each = sized.where("n > 0").select(F.col("doc_id").alias("key"), "node").distinct()
    each = each.join(comp, "node", "left").join(ids, F.col("key") == F.col("id_key"))
    each = stored(each.select("key", F.coalesce("component", "node").alias("component"), "id", "rows"))
    best = each.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("b"))
    best = each.select("key", "rows").join(best.select(F.col("b.key").alias("b")), F.col("key") == F.col("b"), "left")
    judged = stored(best.select(F.col("key").alias(key), F.col("b").isNull().alias("gone"), "rows").where("gone or rows > 1"))
    out = docs.withColumn(key, hashed).join(judged.where("gone").select(key), key, "left_anti")
    again = judged.where("not gone").select(key)
    if again.isEmpty():
        return out.select(*docs.columns)
    # rows that repeat a document that stays: by a hash of all columns, so that a rerun takes the same; a map has no hash
    order = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])
    once = out.join(again, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*docs.columns), order).alias(key + "_row"))
    return out.join(again, key, "left_anti").select(*docs.columns).unionByName(once.select(f"{key}_row.*"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fedseek.llm.common import documents

    return grouped(documents(spark, sf_dir))


#: The same from all pairs that share a shingle.
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{SPACE}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= {K} THEN list_distinct(list_transform(range(1, len(w) - {K - 2}), lambda i: array_to_string(w[i : i + {K - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {DEN} * count(*) >= {NUM} * (a.n + b.n - count(*))),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.u, r.c FROM r JOIN l ON r.doc_id = l.v)
SELECT s.doc_id, any_value(len(s.s)) AS n_shingles, min(r.c) AS component_id FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id
"""
