"""A Merkle manifest of a dataset, with a proof for every row.

Leaves are ranked by a range sort and cut into aligned blocks. A block's root
comes from a treehash stack; roots of blocks are leaves of the next tree up,
until each tree has one. Paths are then dealt out downwards: in a block, one
treehash a level builds the next run of siblings while the current one is in
use, so a leaf costs one step of each and the state is a few runs a level; the
path of the block itself, which its leaves share, is put behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm import shared

#: Nodes of a run, which one digest stands for; levels of a block.
ARITY, HEIGHT = 8, 3
BLOCK = ARITY**HEIGHT
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PATH = "array<struct<before:string,after:string>>"
_NODE = "tree string, pos long, n long, digest string, name string"
_UPPER = f"tree string, pos long, path {_PATH}, subroot string, root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height_of(n: int) -> int:
    """Levels from n nodes up to one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Treehash:
    """Nodes of one level over the leaves that it is given one by one; holds a run a level at most."""

    def __init__(self, level: int):
        self.runs: list[list[str]] = [[] for _ in range(level + 1)]

    def take(self, leaf: str) -> None:
        self.runs[0].append(leaf)
        for k in range(len(self.runs) - 1):
            if len(self.runs[k]) < ARITY:
                break
            self._close(k)

    def _close(self, k: int) -> None:
        self.runs[k + 1].append(digest("".join(self.runs[k])))
        self.runs[k] = []

    def nodes(self) -> list[str]:
        """What its level has, the last run perhaps short."""
        for k in range(len(self.runs) - 1):
            if self.runs[k]:
                self._close(k)
        return self.runs[-1]


def root_of(leaves: list[str], height: int) -> str:
    stack = Treehash(height)
    for leaf in leaves:
        stack.take(leaf)
    return stack.nodes()[0]


def paths_of(leaves: list[str], height: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf in turn, by level, the siblings before and after the node above it."""
    spans = [ARITY ** (k + 1) for k in range(height)]
    runs, coming = [], []
    for k, span in enumerate(spans):
        stack = Treehash(k)
        for leaf in leaves[:span]:
            stack.take(leaf)
        runs.append(stack.nodes())
        coming.append(Treehash(k))
    for i in range(len(leaves)):
        path = []
        for k, run in enumerate(runs):
            place = i // ARITY**k % ARITY
            path.append(("".join(run[:place]), "".join(run[place + 1 :])))
        yield path
        for k, span in enumerate(spans):
            if i + span < len(leaves):  # the leaf as far ahead as a run of this level reaches
                coming[k].take(leaves[i + span])
            if (i + 1) % span == 0:
                runs[k], coming[k] = coming[k].nodes(), Treehash(k)


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf has with these siblings."""
    for before, after in path:
        leaf = digest(before + leaf + after)
    return leaf


def leaf(text: Column | None = None) -> Column:
    """Digest of a row: byte count, colon and value of each column, or a dash for null."""
    values = [F.col(c).cast("string") if c != "text" or text is None else text for c in COLUMNS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows with pos, their place in their ``tree`` by ``order``, and n, the rows of the tree.

    The rows are sorted by ranges; only the counts of each range and tree are summed further.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = shared.cut_lineage(df.repartitionByRange(width, "tree", *order).sortWithinPartitions("tree", *order)).withColumn("at", F.monotonically_increasing_id())
    sorted_rows = sorted_rows.withColumn("rng", F.shiftright("at", 33))
    counts = sorted_rows.groupBy("tree", "rng").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("c").over(tree.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("tree", "rng", "first", before.alias("before"), F.sum("c").over(tree).alias("n"))
    return sorted_rows.join(counts, ["tree", "rng"]).withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("rng", "at", "first", "before")


def _block() -> Column:
    return F.floor(F.col("pos") / BLOCK).alias("block")


def _leaves(nodes: pa.Table, own: str) -> tuple[pa.Table, list[str], int]:
    """A block's rows in order, their digests and the block's height."""
    nodes = nodes.sort_by("pos")
    n = nodes["n"][0].as_py()
    return nodes, nodes[own].to_pylist(), HEIGHT if n > BLOCK else height_of(n)


def _roots(nodes: DataFrame) -> DataFrame:
    """One node for each block: the leaves of the next tree up."""

    def root(block: pa.Table) -> pa.Table:
        rows, leaves, height = _leaves(block, "digest")
        pos, n, name = rows["pos"][0].as_py() // BLOCK, -(-rows["n"][0].as_py() // BLOCK), rows["name"][0].as_py()
        return pa.table({"tree": [rows["tree"][0].as_py()], "pos": [pos], "n": [n], "digest": [root_of(leaves, height)], "name": pa.array([name], pa.string())})

    return nodes.groupBy("tree", _block()).applyInArrow(root, _NODE)


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, then the roots of their blocks, and so on until each tree has one node left."""
    levels = [nodes]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 1:
        levels.append(shared.cut_lineage(_roots(levels[-1])))
    return levels


def _descend(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """Paths of the nodes from the paths of their blocks; ``name`` stays."""
    arrow = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))), ("subroot", pa.string()), ("root", pa.string()), ("name", pa.string())])

    def extend(block: pa.Table, above: pa.Table) -> pa.Table:
        rows, leaves, height = _leaves(block, "digest")
        shared_path, subroot, root = (above[c][0].as_py() for c in ("path", "subroot", "root"))
        paths = [[{"before": b, "after": a} for b, a in path] + shared_path for path in paths_of(leaves, height)]
        columns = [rows["tree"], rows["pos"], pa.array(paths, arrow.field("path").type), pa.array([subroot] * len(paths), pa.string()), pa.array([root] * len(paths), pa.string()), rows["name"]]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=arrow)

    return nodes.groupBy("tree", _block()).cogroup(upper.groupBy("tree", F.col("pos").alias("block"))).applyInArrow(extend, f"{_UPPER}, name string")


def _all_down(levels: list[DataFrame], upper: DataFrame) -> DataFrame:
    """Paths of the nodes of the second level, or those given if there is one level."""
    for nodes in reversed(levels[1:-1]):
        upper = _descend(nodes, upper)
    return upper


def manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and path (siblings before and after, level by level) of each row.

    Trees are by lang, null first; leaves ascend by doc_id (null first), equal
    ids by digest, so repeated rows have leaves of their own. ``altered`` is
    the digest of a row as found later, null where it is the same; folded_root
    is folded from it. Null values and empty texts have digests of their own,
    long texts are digested whole, an empty table has no rows; other columns
    are ignored.
    """
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0"))
    found = F.lit(None).cast("string") if altered is None else altered
    own = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("digest"), found.alias("altered"))
    leaves = shared.cut_lineage(ranked(shared.cut_lineage(own), ["doc_id", "digest", "altered"]).withColumn("name", F.lit(None).cast("string")))
    levels = _levels(leaves)
    tops = levels[-1]
    subroots = tops.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("name"))
    upper_levels = _levels(shared.cut_lineage(ranked(subroots, ["name"])))
    above = upper_levels[-1].select("tree", "pos", F.array().cast(_PATH).alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"), "name")
    above = _all_down(upper_levels, above)
    if len(upper_levels) > 1:
        above = _descend(upper_levels[0], above)
    # each tree's own root is a leaf of the tree of subroots
    above = above.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", "root").join(tops.select("tree", F.col("digest").alias("subroot")), "tree")
    upper = shared.cut_lineage(_all_down(levels, above.select("tree", "pos", "path", "subroot", "root", F.lit(None).cast("string").alias("name"))))

    schema = f"doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, path {_PATH}"

    def prove(block: pa.Table, above: pa.Table) -> pa.Table:
        rows, leaves, height = _leaves(block, "digest")
        shared_path = [(p["before"], p["after"]) for p in above["path"][0].as_py()]
        subroot, root = above["subroot"][0].as_py(), above["root"][0].as_py()
        out: list[list] = [[] for _ in range(5)]
        for own_leaf, found, path in zip(leaves, rows["altered"].to_pylist(), paths_of(leaves, height)):
            path = path + shared_path
            folded = fold(found or own_leaf, path)
            proof = digest("".join(before + after for before, after in path))
            for column, value in zip(out, (proof, folded, folded == root, subroot, [{"before": b, "after": a} for b, a in path])):
                column.append(value)
        proof, folded, verified, subroots, paths_out = out
        columns = [rows["doc_id"].combine_chunks(), pa.array(leaves, pa.string()), pa.array(subroots, pa.string()), pa.array([root] * len(leaves), pa.string()), pa.array(proof, pa.string()), pa.array(folded, pa.string()), pa.array(verified, pa.bool_()), pa.array(paths_out, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))]
        return pa.Table.from_arrays(columns, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "path"])

    return leaves.groupBy("tree", _block()).cogroup(upper.groupBy("tree", F.col("pos").alias("block"))).applyInArrow(prove, schema)


def tampered() -> Column:
    """Digest of a row whose text's A-Z are lower-cased, for ids whose checksum 3 divides; null for the others, and without an id."""
    picked = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return F.when(picked, leaf(F.translate("text", _CAPITALS, _CAPITALS.lower())))


def verify(docs: DataFrame) -> DataFrame:
    """The manifest's digests and whether the rows, tampered with, still fold to its root."""
    return manifest(docs, altered=tampered()).drop("path")


def _oracle(levels: int = 8) -> str:
    """SQL of ``verify``: levels are written out one by one, enough for 8**levels rows of a language and as many languages."""
    steps = []

    def climb(stem: str, before: str) -> None:
        """Nodes of each level by run; a tree of one node stays as it is."""
        for k in range(levels):
            last = before if k == 0 else f"{stem}{k}"
            steps.append(f"{stem}{k + 1} AS (SELECT tree, pos // 8 AS pos, (any_value(n) + 7) // 8 AS n, CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM {last} GROUP BY tree, pos // 8)")

    def extend(name: str, source: str, key: str, nodes: str, k: int) -> None:
        """Siblings of one level put behind the proof, and the run with the tampered digest folded."""
        runs = f"SELECT tree, pos // 8 AS run, list({{'pos': pos, 'digest': digest}} ORDER BY pos) AS nodes, any_value(n) AS n FROM {nodes} GROUP BY tree, pos // 8"
        place = f"({key} // {8**k})"
        others = f"list_filter(r.nodes, lambda x: x.pos <> {place})"
        folded = f"sha256(array_to_string(list_transform(r.nodes, lambda x: CASE WHEN x.pos = {place} THEN p.folded ELSE x.digest END), ''))"
        steps.append(f"{name} AS (SELECT p.* REPLACE (CASE WHEN r.n > 1 THEN p.proof || array_to_string(list_transform({others}, lambda x: x.digest), '') ELSE p.proof END AS proof, CASE WHEN r.n > 1 THEN {folded} ELSE p.folded END AS folded) FROM {source} p JOIN ({runs}) r ON r.tree = p.{'t' if nodes[0] == 'u' else 'tree'} AND r.run = {place} // 8)")

    def value(c: str) -> str:
        return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"

    head = " || ".join(map(value, COLUMNS[:-1]))
    lowered = f"translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}')"
    bits = "flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END), 4294967295::BIGINT)"
    steps.append(f"a AS (SELECT doc_id, coalesce('1' || lang, '0') AS tree, sha256({head} || {value('text')}) AS digest, CASE WHEN {crc} % 3 = 0 THEN sha256({head} || {value(lowered)}) END AS altered FROM documents)")
    steps.append("l0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM a)")
    climb("l", "l0")
    steps.append(f"u0 AS (SELECT '' AS tree, tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM l{levels})")
    climb("u", "u0")
    steps.append("p0 AS (SELECT l0.doc_id, l0.tree, '' AS t, l0.digest AS leaf, l0.pos, u0.pos AS upos, u0.digest AS subroot, '' AS proof, coalesce(altered, l0.digest) AS folded FROM l0 JOIN u0 ON u0.name = l0.tree)")
    for k in range(levels):
        extend(f"p{k + 1}", f"p{k}", "p.pos", f"l{k}", k)
    for k in range(levels):
        extend(f"p{levels + k + 1}", f"p{levels + k}", "p.upos", f"u{k}", k)
    end = f"SELECT doc_id, leaf, subroot, r.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.digest AS verified FROM p{2 * levels} CROSS JOIN u{levels} r"
    return f"WITH {', '.join(steps)} {end}"


ORACLE = _oracle()
