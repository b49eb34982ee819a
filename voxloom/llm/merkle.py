"""Merkle manifest of a table, kept as a postorder append log.

Rows are leaves. Every tree (a source) is cut into aligned subtrees of ``FANOUT ** LEVELS`` leaves; a
builder takes the leaves of one in order and appends every node the moment its last child is there,
which is postorder. Where a node lies in the log follows from the sizes of the subtrees before it
(``place``), so a proof addresses its siblings and searches nothing. The tops of the builders are the
leaves of the next stage, until a tree has a single node; the subroots are the leaves of one last tree.

Leaves are hashed where they are read, so only digests and keys are ever sorted or shuffled. A tree that
holds a third of all rows is as many builders as any other tree of the same rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.blocks import by_keys
from voxloom.session import materialize

FANOUT = 16
#: Levels that one builder adds to its leaves.
LEVELS = 3
SPAN = FANOUT**LEVELS
#: Leaves whose proofs leave a task together.
GATHER = 512
_HEX = 64


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def framed_field(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def tree_key(column: Column) -> Column:
    """A key that is never null and sorts as null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("s"), column.cast("string")), F.lit(""))


def height(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def place(n: int, levels: int, level: int, index: np.ndarray) -> np.ndarray:
    """Place of a node in the postorder log of a tree of ``n`` leaves and ``levels`` levels.

    Before it lie its own subtree, and at every level all nodes that end where it starts or earlier.
    """
    first = index * FANOUT**level
    end = np.minimum(first + FANOUT**level, n)
    nodes = sum(-(-end // FANOUT**k) for k in range(level + 1))
    return nodes + sum(first // FANOUT**k for k in range(level + 1, levels + 1)) - 1


def append_log(leaves: list[str], levels: int) -> list[str]:
    """All nodes over the leaves in the order in which they are complete."""
    log: list[str] = []
    waiting: list[list[str]] = [[] for _ in range(levels + 1)]

    def close(level: int) -> None:
        node = hashlib.sha256("".join(waiting[level]).encode()).hexdigest()
        log.append(node)
        waiting[level] = []
        waiting[level + 1].append(node)

    for leaf in leaves:
        log.append(leaf)
        waiting[0].append(leaf)
        level = 0
        while level < levels and len(waiting[level]) == FANOUT:
            close(level)
            level += 1
    for level in range(levels):
        if waiting[level]:
            close(level)
    return log


def runs_of(log: str, n: int, levels: int) -> list[list[str]]:
    """The digests of every run of siblings, by level, taken from their places in the log."""
    found = []
    for level in range(levels):
        at = place(n, levels, level, np.arange(-(-n // FANOUT**level))) * _HEX
        nodes = [log[a : a + _HEX] for a in at.tolist()]
        found.append(["".join(nodes[r : r + FANOUT]) for r in range(0, len(nodes), FANOUT)])
    return found


def positioned(nodes: DataFrame, tie: list[str], label: str) -> DataFrame:
    """Add ``position`` and ``n`` (leaves of the tree) to nodes with ``tree``, in the order of ``tie``.

    Rows are dealt out by ranges and written sorted; a row's place is its number in its file, less the
    first of its tree there, plus the tree's rows in the files before. Rows that are equal in all of
    ``tie`` are spread by a number of their own: their order changes nothing.
    """
    salted = nodes.withColumn("__salt", F.monotonically_increasing_id())
    order = ["tree", *tie]
    ranged = salted.repartitionByRange(*order, "__salt").sortWithinPartitions(*order).drop("__salt")
    stored = materialize(ranged.withColumn("__part", F.spark_partition_id()), label)
    rows = stored.select("*", F.col("_metadata.row_index").alias("__row"))
    parts = rows.groupBy("tree", "__part").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy("tree")
    before = F.sum("__n").over(whole.orderBy("__part")) - F.col("__n")
    starts = parts.select("tree", "__part", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias("n"))
    placed = rows.join(starts, ["tree", "__part"])
    return placed.withColumn("position", F.col("__row") + F.col("__shift")).drop("__row", "__part", "__shift")


_LOG = pa.schema(
    [("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("nodes", pa.binary()), ("keys", pa.list_(pa.int64())), ("other", pa.binary())]
)


def _build(batches):
    for (tree, block, n), rows in by_keys(batches, ["tree", "block", "n"]):
        leaves = rows.column("leaf").to_pylist()
        levels = min(LEVELS, height(n))
        log = "".join(append_log(leaves, levels))
        other = "".join(rows.column("other").to_pylist())
        keys = rows.column("key").to_pylist()
        yield pa.RecordBatch.from_pylist(
            [{"tree": tree, "block": block, "n": n, "nodes": bytes.fromhex(log), "keys": keys, "other": bytes.fromhex(other)}], schema=_LOG
        )


def built(nodes: DataFrame, label: str) -> DataFrame:
    """The log of one stage: a row per builder with its nodes in completion order.

    ``nodes`` has ``tree, position, n, leaf, key, other``; the last two are handed through (a leaf's
    key, and its digest after a change).
    """
    dealt = nodes.select("tree", F.floor(F.col("position") / SPAN).cast("long").alias("block"), "n", "position", "leaf", "key", "other")
    dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "n", "position")
    return materialize(dealt.mapInArrow(_build, "tree string, block long, n long, nodes binary, keys array<long>, other binary"), label)


def _top() -> Column:
    """A builder's last node as hex."""
    return F.lower(F.hex(F.substring("nodes", -32, 32)))


def stages(nodes: DataFrame, label: str) -> list[DataFrame]:
    """Logs from the leaves up; the last one has a single builder for every tree.

    A stage has a ``SPAN``-th of the nodes of the one below: three stages hold any table.
    """
    logs = [built(nodes, f"{label}-0")]
    while logs[-1].where("block > 0").limit(1).count():
        tops = logs[-1].select(
            "tree",
            F.col("block").alias("position"),
            F.ceil(F.col("n") / SPAN).cast("long").alias("n"),
            _top().alias("leaf"),
            F.lit(None).cast("long").alias("key"),
            F.lit("").alias("other"),
        )
        logs.append(built(tops, f"{label}-{len(logs)}"))
    return logs


_PATH = "array<struct<left:string,right:string>>"
_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_PROOFS = pa.schema([("tree", pa.string()), ("position", pa.int64()), ("key", pa.int64()), ("leaf", pa.string()), ("other", pa.string()), ("subroot", pa.string()), ("path", _STEPS)])


def _prove(batches):
    for batch in batches:
        for row in batch.to_pylist():
            n = min(SPAN, row["n"] - row["block"] * SPAN)
            levels = min(LEVELS, height(row["n"]))
            log, other = row["nodes"].hex(), row["other"].hex()
            runs = runs_of(log, n, levels)
            leaf_at = (place(n, levels, 0, np.arange(n)) * _HEX).tolist()
            further = [[step[side] for step in row["way"]] for side in ("left", "right")]
            for a in range(0, n, GATHER):
                own = range(a, min(a + GATHER, n))
                left, right = [], []
                for i in own:
                    for level in range(levels):
                        run, slot = divmod(i // FANOUT**level, FANOUT)
                        left.append(runs[level][run][: slot * _HEX])
                        right.append(runs[level][run][(slot + 1) * _HEX :])
                    left += further[0]
                    right += further[1]
                offsets = pa.array(np.arange(len(own) + 1, dtype=np.int32) * (levels + len(further[0])))
                steps = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["left", "right"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["tree"]] * len(own), pa.string()),
                        pa.array([row["block"] * SPAN + i for i in own], pa.int64()),
                        pa.array([row["keys"][i] for i in own], pa.int64()),
                        pa.array([log[leaf_at[i] : leaf_at[i] + _HEX] for i in own], pa.string()),
                        pa.array([other[i * _HEX : (i + 1) * _HEX] for i in own], pa.string()),
                        pa.array([row["subroot"]] * len(own), pa.string()),
                        pa.ListArray.from_arrays(offsets, steps),
                    ],
                    schema=_PROOFS,
                )


def _climbed(logs: list[DataFrame], above: DataFrame) -> DataFrame:
    """``tree, position, key, leaf, other, subroot, path``: the leaves of the lowest stage with their whole way.

    ``above`` continues the way from each tree's subroot (``tree, way, subroot``). Ways are joined to
    builders, a row each, by tree and block; rows of single leaves are never shuffled.
    """
    above = logs[-1].select("tree", "block").join(above, "tree")
    for stage in range(len(logs) - 1, -1, -1):
        rows = logs[stage].join(above, ["tree", "block"]).select("tree", "block", "n", "nodes", "keys", "other", "way", "subroot")
        proofs = rows.mapInArrow(_prove, f"tree string, position long, key long, leaf string, other string, subroot string, path {_PATH}")
        above = proofs.select("tree", F.col("position").alias("block"), F.col("path").alias("way"), "subroot")
    return proofs


@dataclass(frozen=True)
class Manifest:
    """Logs of all trees and of the tree over their subroots, and the root over everything."""

    logs: list[DataFrame]
    top_logs: list[DataFrame]
    root: str | None
    names: DataFrame  # tree, and its place among the subroots

    def proofs(self) -> DataFrame:
        """A row per leaf: ``tree, position, key, leaf, other, subroot, root, path``.

        ``path`` goes up level by level; each step has the siblings to the left and to the right as
        hex digests, so a digest folds as ``H(left + digest + right)``.
        """
        none = self.top_logs[-1].select("tree", F.array().cast(_PATH).alias("way"), F.lit("").alias("subroot"))
        ways = _climbed(self.top_logs, none).select("position", F.col("path").alias("way"), F.col("leaf").alias("subroot"))
        above = ways.join(self.names, "position").select("tree", "way", "subroot")
        return _climbed(self.logs, above).withColumn("root", F.lit(self.root))


def manifest(rows: DataFrame) -> Manifest:
    """The manifest of rows with ``tree`` (string, not null), ``key`` (long), ``leaf`` and ``other`` (hex digests).

    Leaves of a tree are ordered by ``key``, null first, then by ``leaf``. Rows that repeat a key are all
    leaves. A table without rows has no root (None).
    """
    leaves = materialize(rows.select("tree", "key", "leaf", "other"), "merkle-leaves")
    logs = stages(positioned(leaves, ["key", "leaf", "other"], "merkle-order"), "merkle")
    subroots = logs[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), _top().alias("leaf"))
    named = materialize(positioned(subroots, ["name"], "merkle-names"), "merkle-subroots")
    tops = named.select("tree", "position", "n", "leaf", F.lit(None).cast("long").alias("key"), F.lit("").alias("other"))
    top_logs = stages(tops, "merkle-top")
    found = top_logs[-1].select(_top().alias("root")).first()
    return Manifest(logs, top_logs, found and found["root"], named.select("position", F.col("name").alias("tree")))


def folded(path: Column, leaf: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda h, step: digest(step["left"], h, step["right"]))


def siblings(path: Column) -> Column:
    """All sibling digests on the way, in one string."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    """Every document with its proof, checked against a tampered leaf where 5 divides its checksum.

    Null fields are framed as ``-``. A null ``doc_id`` comes first and is never tampered with; rows that
    repeat a ``doc_id`` are all leaves, ordered by leaf. An empty table has no rows. Other columns are not read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bent = F.translate("text", _UPPER, _LOWER)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    fields = [framed_field(F.col(c)) for c in FIELDS]
    leaf = digest(*fields)
    other = F.when(tampered, digest(*fields[:-1], framed_field(bent))).otherwise(leaf)
    rows = docs.select(tree_key(F.col("source")).alias("tree"), F.col("doc_id").cast("long").alias("key"), leaf.alias("leaf"), other.alias("other"))
    proofs = manifest(rows).proofs()
    result = folded(F.col("path"), F.col("other"))
    return proofs.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), result.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _frame_sql(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _levels_sql(name: str, depth: int) -> str:
    """``{name}0`` up to ``{name}{depth}``, with the siblings of every node below the last."""
    parts = []
    for k in range(depth):
        parts.append(f"""
{name}{k}r as materialized (
  select tree, pos // {FANOUT} as run, max(cnt) as cnt, list(h order by pos) as hs from {name}{k} group by 1, 2),
{name}{k}s as materialized (
  select a.tree, a.pos, r.cnt > 1 as up, array_to_string(hs[1 : a.pos % {FANOUT}], '') as lhs, array_to_string(hs[a.pos % {FANOUT} + 2 :], '') as rhs
  from {name}{k} a join {name}{k}r r on a.tree = r.tree and a.pos // {FANOUT} = r.run),
{name}{k + 1} as materialized (
  select tree, run as pos, case when cnt > 1 then sha256(array_to_string(hs, '')) else hs[1] end as h, count(*) over (partition by tree) as cnt
  from {name}{k}r)""")
    return ",".join(parts)


def _oracle(depth: int = 6, top: int = 4) -> str:
    crc = """xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::ubigint),
      lambda c, x: list_reduce(range(8)::ubigint[], lambda e, i: xor(e >> 1, 3988292384::ubigint * (e & 1::ubigint)), xor(c, x)),
      4294967295::ubigint), 4294967295::ubigint)"""
    head = " || ".join(_frame_sql(f"{c}::varchar") for c in FIELDS[:-1])
    steps = [("d", k) for k in range(depth)] + [("t", k) for k in range(top)]
    proof = " || ".join(f"case when {n}{k}s.up then {n}{k}s.lhs || {n}{k}s.rhs else '' end" for n, k in steps)
    joins = "".join(f"\n  join d{k}s on d{k}s.tree = l.tree and d{k}s.pos = l.pos // {FANOUT**k}" for k in range(depth))
    joins += "\n  join names on names.name = l.tree" + "".join(f"\n  join t{k}s on t{k}s.pos = names.pos // {FANOUT**k}" for k in range(top))
    folds, last = [], "folds0"
    chain = "folds0 as (select doc_id, leaf, subroot, proof, changed as h, steps from way)"
    for i in range(len(steps)):
        folds.append(f"folds{i + 1} as (select * exclude (h), case when steps[{i + 1}].up then sha256(steps[{i + 1}].lhs || h || steps[{i + 1}].rhs) else h end as h from folds{i})")
        last = f"folds{i + 1}"
    listed = ", ".join(f"{{'up': {n}{k}s.up, 'lhs': {n}{k}s.lhs, 'rhs': {n}{k}s.rhs}}" for n, k in steps)
    return f"""
with l0 as materialized (
  select doc_id, coalesce('s' || source, '') as tree, sha256({head} || {_frame_sql("text")}) as leaf,
    case when doc_id is not null and ({crc}) % 5 = 0
      then sha256({head} || {_frame_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")}) end as bent
  from documents),
l as materialized (
  select doc_id, tree, leaf, coalesce(bent, leaf) as changed,
    row_number() over (partition by tree order by doc_id nulls first, leaf, coalesce(bent, leaf)) - 1 as pos, count(*) over (partition by tree) as cnt
  from l0),
d0 as materialized (select tree, pos, leaf as h, cnt from l),{_levels_sql("d", depth)},
names as materialized (select tree as name, h, row_number() over (order by tree) - 1 as pos from d{depth}),
t0 as materialized (select '' as tree, pos, h, count(*) over () as cnt from names),{_levels_sql("t", top)},
way as materialized (
  select l.doc_id, l.leaf, l.changed, names.h as subroot, {proof} as proof, [{listed}] as steps
  from l{joins}),
{chain}, {", ".join(folds)}
select doc_id, leaf, subroot, (select h from t{top}) as root, sha256(proof) as proof_sha256, h as folded_root,
  h = (select h from t{top}) as verified
from {last}"""


QUERIES = {"op13_merkle": op13_merkle}
ORACLE = {"op13_merkle": _oracle()}
