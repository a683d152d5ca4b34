"""A manifest of a dataset as a Merkle tree, with a proof for each row.

Leaves are digests of rows, ordered within each part; runs of `arity` nodes become their digest until one is left, the part's
subroot, and the subroots likewise become the root. Positions are cut into aligned blocks of arity ** height nodes, and the
blocks' roots are the nodes of the next round, so a part of any size is worked on in tasks of one block each.

A first pass makes each block's root with a stack of unfinished runs, one for each level. Then paths go down from the root: a block's task
walks its nodes from left to right and holds at each level the run around the current node and a treehash that makes the
next run, which takes one leaf for each step of the walk and so is done when it is needed. That is two runs and a stack
for each level, whatever the block holds; what lies above the block is the same for all its nodes and is appended.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agendum.llm import common

#: A path upwards: for each level the run's nodes to the left and to the right, as hex digests one after the other.
PATH = "array<struct<l:string,r:string>>"


def field(c: Column) -> Column:
    """A value as it enters a leaf: '-' if null, else the length of its UTF-8, ':' and the value."""
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def digest(nodes: list[bytes]) -> bytes:
    return sha256(b"".join(nodes)).hexdigest().encode()


def levels_of(n: int, arity: int) -> int:
    """How often runs become one node until a single one is left of n."""
    k = 0
    while n > 1:
        n, k = -(-n // arity), k + 1
    return k


class Treehash:
    """Makes the nodes of one level from the leaves below them, taken one by one; the stack holds the unfinished runs."""

    def __init__(self, level: int, arity: int):
        self.level, self.arity, self.nodes = level, arity, []
        self.stack: list[list[bytes]] = [[] for _ in range(level)]

    def add(self, leaf: bytes) -> None:
        for run in self.stack:
            run.append(leaf)
            if len(run) < self.arity:
                return
            leaf = digest(run)
            run.clear()
        self.nodes.append(leaf)

    def close(self) -> None:
        """After the last leaf: what is left of a run, even one node, becomes its digest, level by level."""
        for level, run in enumerate(self.stack):
            if run:
                node = digest(run)
                run.clear()
                (self.stack[level + 1] if level + 1 < self.level else self.nodes).append(node)


def block_root(leaves: list[bytes], levels: int, arity: int) -> bytes:
    """The node over all leaves, levels up; the leaf itself for no level."""
    made = Treehash(levels, arity)
    for leaf in leaves:
        made.add(leaf)
    made.close()
    return made.nodes[0]


def traversal(leaves: list[bytes], levels: int, arity: int):
    """For each leaf from left to right its path within the block: (left nodes, right nodes) by level."""
    run, ahead = [], []  # for each level the run around the current leaf, and the treehash of the next run
    spans = [arity ** (level + 1) for level in range(levels)]  # leaves under a run

    def begin(level: int, start: int, leaves_now: int) -> Treehash:
        made = Treehash(level, arity)
        for leaf in leaves[start : start + leaves_now]:
            made.add(leaf)
        if start + leaves_now >= len(leaves):
            made.close()
        return made

    for level, span in enumerate(spans):
        run.append(begin(level, 0, span).nodes)
        ahead.append(begin(level, span, 0))
    for i in range(len(leaves)):
        path, below = [], 1
        for level, span in enumerate(spans):
            if i and i % span == 0:
                run[level], ahead[level] = ahead[level].nodes, begin(level, i + span, 0)
            own, at = run[level], i // below % arity
            path.append((b"".join(own[:at]), b"".join(own[at + 1 :])))
            below = span
            nearest = i + span  # one leaf for each step
            if nearest < len(leaves):
                ahead[level].add(leaves[nearest])
                if nearest == len(leaves) - 1:
                    ahead[level].close()
        yield path


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        node = sha256(left + node + right).hexdigest().encode()
    return node


def path_array(paths) -> pa.Array:
    made = [[{"l": left.decode(), "r": right.decode()} for left, right in path] for path in paths]
    return pa.array(made, pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())])))


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds pos, the place of each row in its tree (from 0) by the columns of order, nulls first, and n, the tree's rows.

    Rows are dealt out and sorted by ranges of (tree, order, a salt), so that a large tree and a key that is repeated both spread
    over tasks; rows of equal order columns stand in any order. A task counts within its own runs of trees; what precedes a run
    comes from the runs' counts, a few for each task.
    """
    common.ship(rows.sparkSession)
    rows = common.stored(rows.withColumn("salt", F.monotonically_increasing_id()), name)
    by = ["tree", *order, "salt"]

    def counted(batches):
        last, run, place = None, -1, 0
        for batch in batches:
            trees = batch.column("tree").to_pylist()
            at = []
            for t in trees:
                if run < 0 or t != last:
                    last, run, place = t, run + 1, 0
                at.append(place)
                place += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "place"])

    own = rows.drop("salt").schema
    dealt = rows.repartitionByRange(common.parallelism(rows.sparkSession), *by).sortWithinPartitions(*by).drop("salt").withColumn("task", F.spark_partition_id())
    dealt = common.stored(dealt.mapInArrow(counted, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in own)}, task int, place long"), name)
    runs = dealt.groupBy("tree", "task").agg(F.count(F.lit(1)).alias("size"))
    tree = Window.partitionBy("tree")
    runs = common.stored(runs.select("tree", "task", (F.sum("size").over(tree.orderBy("task")) - F.col("size")).alias("before"), F.sum("size").over(tree).alias("n")), name)
    return dealt.join(runs, ["tree", "task"]).withColumn("pos", F.col("place") + F.col("before")).drop("task", "place", "before")


@dataclass(frozen=True)
class Shape:
    """Runs of arity nodes, and blocks of height levels."""

    arity: int
    height: int

    @property
    def size(self) -> int:
        return self.arity**self.height

    def levels(self, n: int) -> int:
        """Levels within a block of a tree of n nodes."""
        return min(self.height, levels_of(n, self.arity))


def block_roots(nodes: DataFrame, shape: Shape) -> DataFrame:
    """One row for each block of the nodes (tree, pos, n, node), as a node of the next round."""

    def root(table: pa.Table) -> pa.Table:
        n = table["n"][0].as_py()
        leaves = [x.encode() for x in table["node"].take(pa.array(np.argsort(table["pos"].to_numpy()))).to_pylist()]
        node = block_root(leaves, shape.levels(n), shape.arity).decode()
        return pa.table({"tree": table["tree"][:1], "pos": table["block"][:1], "n": pa.array([-(-n // shape.size)]), "node": pa.array([node])})

    return blocked(nodes.select("tree", "pos", "n", "node"), shape).groupBy("tree", "block").applyInArrow(root, "tree string, pos long, n long, node string")


def blocked(nodes: DataFrame, shape: Shape) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {shape.size}"))


def rounds_up(nodes: DataFrame, shape: Shape, name: str) -> list[DataFrame]:
    """The nodes, the roots of their blocks, the roots of the blocks of these, until each tree has one: the last has the roots."""
    rounds = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 1
    while most > 1:
        rounds.append(common.stored(block_roots(rounds[-1], shape), name))
        most = -(-most // shape.size)
    return rounds


def walk_down(rounds: list[DataFrame], upper: DataFrame, finish, schema: str, shape: Shape, name: str) -> DataFrame:
    """What finish(rows of a block by pos, paths, upper row) makes of each block, where paths yields each row's whole path and
    upper has a row for each tree: tree, path, and other strings that finish reads."""
    extra = [f.name for f in upper.schema if f.name not in ("tree", "path")]
    upper = upper.withColumn("block", F.lit(0).cast("long"))

    def rows(table: pa.Table, paths, above: dict) -> pa.Table:
        same = {c: pa.array([above[c]] * len(table), pa.string()) for c in extra}
        return pa.table({"tree": table["tree"], "block": table["pos"], "path": path_array(paths), **same})

    for nodes in rounds[-2:0:-1]:  # the last round has the roots alone
        upper = common.stored(_down(nodes, upper, rows, f"tree string, block long, path {PATH}" + "".join(f", {c} string" for c in extra), shape), name)
    return _down(rounds[0], upper, finish, schema, shape)


def _down(nodes: DataFrame, upper: DataFrame, finish, schema: str, shape: Shape) -> DataFrame:
    def each(key, table: pa.Table, above: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table["pos"].to_numpy())))
        row = above.slice(0, 1).to_pylist()[0]
        rest = [(x["l"].encode(), x["r"].encode()) for x in row["path"]]
        leaves = [x.encode() for x in table["node"].to_pylist()]
        paths = (own + rest for own in traversal(leaves, shape.levels(table["n"][0].as_py()), shape.arity))
        return finish(table, paths, row)

    return blocked(nodes, shape).groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(each, schema)


def manifest(
    docs: DataFrame, fields: list[str], key: str = "doc_id", part: str = "lang", changed: dict[str, Column] | None = None, arity: int = 8, height: int = 3,
) -> DataFrame:
    """For each row of docs its id under the key's name, leaf, subroot, root, proof_sha256 (the digest of all siblings on its way
    up, level by level, left to right), folded_root (from the leaf as it is now and those siblings) and verified.

    changed: columns of docs as they are now, where that may differ; a row whose leaf differs folds from the new one, and the root
    it should reach is that of docs. Leaves ascend by key within a part, rows without a key first and rows of one key by their
    digests; parts ascend by their UTF-8, the null part first and the empty one next. A part of one row has its leaf as subroot,
    a table of one part its subroot as root, without siblings the proof is the digest of nothing. Repeated rows are leaves
    each; an empty table gives no rows. Texts are hashed where they are read and not shuffled.
    """
    shape = Shape(arity, height)
    named = lambda new: [new.get(f, F.col(f"`{f}`")) for f in fields]
    tree = F.when(F.col(f"`{part}`").isNull(), "").otherwise(F.concat(F.lit("="), F.col(f"`{part}`").cast("string")))
    now = leaf_digest(named(changed)) if changed else F.lit(None).cast("string")
    leaves = docs.select(tree.alias("tree"), F.col(f"`{key}`").cast("long").alias("id"), leaf_digest(named({})).alias("node"), now.alias("now"))
    leaves = leaves.withColumn("now", F.when(F.col("now") != F.col("node"), F.col("now")))
    with common.scope():
        parts = rounds_up(placed(leaves, ["id", "node"], "leaves"), shape, "blocks")
        subroots = parts[-1].select(F.lit("").alias("tree"), F.col("tree").alias("part"), "node")
        whole = rounds_up(placed(subroots, ["part"], "subroots"), shape, "parts")
        root = common.stored(whole[-1].select("tree", F.array().cast(PATH).alias("path"), F.col("node").alias("root")), "root")

        def of_part(table: pa.Table, paths, upper: dict) -> pa.Table:
            root = pa.array([upper["root"]] * len(table), pa.string())
            return pa.table({"tree": table["part"], "path": path_array(paths), "root": root, "subroot": table["node"]})

        upper = common.stored(walk_down(whole, root, of_part, f"tree string, path {PATH}, root string, subroot string", shape, "paths"), "paths")

        def proven(table: pa.Table, paths, upper: dict) -> pa.Table:
            proofs, folded = [], []
            for leaf, now, path in zip(table["node"].to_pylist(), table["now"].to_pylist(), paths, strict=True):
                proofs.append(sha256(b"".join(x for level in path for x in level)).hexdigest())
                folded.append(fold((now or leaf).encode(), path).decode())
            same = lambda c: pa.array([upper[c]] * len(proofs), pa.string())
            root = upper["root"]
            return pa.table({
                "id": table["id"], "leaf": table["node"], "subroot": same("subroot"), "root": same("root"), "proof_sha256": pa.array(proofs, pa.string()),
                "folded_root": pa.array(folded, pa.string()), "verified": pa.array([x == root for x in folded], pa.bool_()),
            })

        schema = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        out = walk_down(parts, upper, proven, schema, shape, "paths")
        return common.keep(common.stored(out.withColumnRenamed("id", key), "manifest"))
