"""Merkle manifest of a dataset: one hash tree per group of rows, a tree over the groups' roots, and a proof for every row.

* Leaves are hashes of a row's fields. They are numbered by a range sort: positions inside the sorted partitions plus the
  partitions' running totals, so no task holds a group.
* The trees are built bottom-up, ``LEVELS`` levels per round: a run of 2**LEVELS neighbours is one Spark group. Every node
  that starts such a run is stored as a row with a link to its parent row, and the siblings on the way there.
* A recursive query climbs from all leaves at once: each step joins the climbers to their stored nodes, adds the siblings on
  the way, folds the hash through them and goes on at the parent, until there is none. The siblings of the steps are put in
  a row at the end, so that a step moves its own ones only.
* Many leaves meet at the upper nodes. A node is stored once for each ``SHARE`` leaves below it and a leaf joins the copy
  of its own number, so no key of the join gets more rows than that, and the copies are a small fraction of the leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rackpulse.llm.scope import derived_session
from rackpulse.session import materialise, work_path

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a tree that one stored row spans, and leaves that climb through one copy of it.
LEVELS, SHARE = 12, 256
#: A proof holds, per level, a byte and the sibling's digest. The byte tells where the sibling stands.
STEP, NONE, LEFT, RIGHT = 33, b"\x00", b"\x01", b"\x02"
#: Number of the tree over the groups' roots.
TOP = -1


def field_text(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    """Binary sha256 of the fields in a row."""
    return F.unhex(F.sha2(F.concat(*[field_text(v) for v in values]).cast("binary"), 256))


def join_digests(digests: list[bytes]) -> bytes:
    """Digest of a run of nodes; digests enter as hexadecimal text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def run_paths(digests: list[bytes], levels: int, to_root: bool) -> tuple[list[bytes], bytes]:
    """Per node of a run the steps to the run's root, and that root.

    A run that is not its whole tree climbs all its levels, also where it has one node left.
    """
    paths: list[list[bytes]] = [[] for _ in digests]
    nodes, level = digests, 0
    while len(nodes) > 1 or not to_root:
        if level == levels:
            break
        for i, steps in enumerate(paths):
            at = i >> level
            if at ^ 1 < len(nodes):
                steps.append((LEFT if at & 1 else RIGHT) + nodes[at ^ 1])
            else:
                steps.append(NONE * STEP)
        nodes = [join_digests(nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        level += 1
    return [b"".join(steps) for steps in paths], nodes[0]


def _numbered(leaves: DataFrame) -> DataFrame:
    """Adds ``tree`` (rank of the group), ``idx`` in it and ``n``, the group's size; order: group, key, leaf.

    Equal rows are told apart by a random number, so that many of them spread over partitions; their results are equal in
    any order.
    """
    order = [F.col("grp"), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("tie")]
    ranged = leaves.withColumn("tie", F.rand(7)).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    rows = materialise(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "leaves")
    # One row per partition and group in it: partitions plus groups.
    totals = rows.groupBy("grp", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    totals = materialise(totals, "leaf-totals")
    earlier = W.partitionBy("grp").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.withColumn("base", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    groups = totals.groupBy("grp").agg(F.min("part").alias("opens"), F.sum("rows").alias("n"))
    # Groups are ranked inside the partition where they begin, behind those of earlier partitions: one row per partition.
    opened = groups.groupBy("opens").agg(F.count("*").alias("groups"))
    before = W.orderBy("opens").rowsBetween(W.unboundedPreceding, -1)
    opened = opened.select("opens", F.coalesce(F.sum("groups").over(before), F.lit(0)).alias("skip"))
    own = F.row_number().over(W.partitionBy("opens").orderBy("grp"))
    ranks = groups.join(opened, "opens").select("grp", "n", (F.col("skip") + own - 1).alias("tree"))
    places = bases.join(ranks, "grp").select("grp", "part", "tree", "n", "first", "base")
    return rows.join(places, ["grp", "part"]).select(
        "key", "leaf", "tampered", "tree", "n", (F.col("base") + F.col("at") - F.col("first")).alias("idx")
    )


_HOP = "tree long, idx long, n long, weight long, start binary, path binary, reaches binary, run_weight long"


def _hop(nodes: DataFrame, levels: int) -> DataFrame:
    """One round: rows (tree, idx, n, digest, weight, start) to their paths, their run's root and its weight."""

    def climb(key: tuple, run: pa.Table) -> pa.Table:
        run = run.sort_by("idx")
        digests, n = run.column("digest").to_pylist(), run.column("n")[0].as_py()
        paths, root = run_paths(digests, levels, to_root=n <= 1 << levels)
        weight = sum(run.column("weight").to_pylist())
        return pa.table(
            {
                **{name: run.column(name) for name in ("tree", "idx", "n", "weight", "start")},
                "path": pa.array(paths, pa.binary()), "reaches": pa.array([root] * len(run), pa.binary()),
                "run_weight": pa.array([weight] * len(run), pa.int64()),
            }
        )

    runs = nodes.withColumn("run", F.shiftright("idx", levels))
    return runs.groupBy("tree", "run").applyInArrow(climb, _HOP)


def _roots(built: DataFrame, levels: int) -> DataFrame:
    """The roots of a round's runs, numbered as the next round's nodes."""
    return built.filter(F.col("idx") % (1 << levels) == 0).select(
        "tree", F.shiftright("idx", levels).alias("idx"),
        F.ceil(F.col("n") / F.lit(1 << levels)).cast("long").alias("n"),
        F.col("reaches").alias("digest"), F.col("run_weight").alias("weight"), F.lit(None).cast("binary").alias("start"),
    )


def _copies(weight: Column) -> Column:
    return F.ceil(weight / F.lit(SHARE)).cast("long")


def _linked(built: DataFrame, hop: int, levels: int) -> DataFrame:
    """Nodes of a round with links to their parents' rows; the last run of a group's tree leads to its leaf in the top one."""
    inside = F.col("n") > (1 << levels)
    top = F.col("tree") == TOP
    return built.select(
        "tree", F.lit(hop).alias("hop"), "idx", "weight", "start", "path", _copies(F.col("run_weight")).alias("up_copies"),
        F.when(inside, F.col("tree")).when(~top, F.lit(TOP)).alias("up_tree"),
        F.when(inside, F.lit(hop + 1)).when(~top, F.lit(0)).alias("up_hop"),
        F.when(inside, F.shiftright("idx", levels)).when(~top, F.col("tree")).alias("up_idx"),
    )


def build_trees(numbered: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of the leaves, copies of the nodes above them (both with links), and the groups' roots (tree, digest)."""
    size = numbered.agg(F.max("n").alias("n"), F.max("tree").alias("last")).first()
    stored: list[DataFrame] = []

    def grow(nodes: DataFrame, largest: int, label: str) -> DataFrame:
        hop, roots = 0, []
        while True:
            built = materialise(_hop(nodes, levels), f"{label}-{hop}")
            stored.append(_linked(built, hop, levels))
            nodes = _roots(built, levels)
            roots.append(nodes.filter("n = 1"))
            nodes, largest, hop = nodes.filter("n > 1"), -(-largest >> levels), hop + 1
            if largest <= 1:
                return reduce(DataFrame.unionByName, roots)

    own = [F.col("leaf").alias("digest"), F.lit(1).cast("long").alias("weight"), F.col("tampered").alias("start")]
    subroots = grow(numbered.select("tree", "idx", "n", *own), size["n"] or 0, "hop")
    trees = (size["last"] if size["last"] is not None else -1) + 1
    number = [F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(trees).cast("long").alias("n")]
    root = grow(subroots.select(*number, "digest", "weight", "start"), trees, "top-hop")
    leaves, *above = stored
    copies = F.explode(F.sequence(F.lit(0).cast("long"), _copies(F.col("weight")) - 1)).alias("copy")
    nodes = reduce(DataFrame.unionByName, above).drop("start").select("*", copies).drop("weight")
    found = root.select("digest").first()
    return leaves, nodes, subroots.select("tree", F.col("digest").alias("subroot"), F.lit(found and bytearray(found["digest"])).cast("binary").alias("root"))


def _folded(digest: str, path: str) -> str:
    """SQL: the digest after all steps of a path."""
    sibling = f"lower(hex(substring({path}, i * {STEP} + 2, 32)))"
    return f"""if(length({path}) = 0, {digest}, aggregate(sequence(0, length({path}) div {STEP} - 1), {digest}, (h, i) -> unhex(sha2(
      case substring({path}, i * {STEP} + 1, 1) when X'01' then concat({sibling}, lower(hex(h))) when X'02' then concat(lower(hex(h)), {sibling})
        else lower(hex(h)) end, 256))))"""


_CLIMB = f"""
with recursive climb(own_tree, own_idx, step, tree, hop, node, copy, path, folded) as (
  select tree, idx, 0, up_tree, up_hop, up_idx, idx % up_copies, path, {_folded("start", "path")} from {{leaves}}
  union all
  select c.own_tree, c.own_idx, c.step + 1, p.up_tree, p.up_hop, p.up_idx, c.own_idx % p.up_copies, p.path, {_folded("c.folded", "p.path")}
  from climb c join {{nodes}} p on c.tree = p.tree and c.hop = p.hop and c.node = p.idx and c.copy = p.copy
)
select own_tree as tree, own_idx as idx, step, path, folded from climb
"""


def prove(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Rows (key, leaf, subroot, root, folded, proof), one per row (grp, key, leaf, tampered) of ``leaves``.

    ``grp`` is a text without nulls, by whose bytes the groups are ordered; ``key`` orders the leaves of a group, nulls first,
    and then ``leaf`` does. ``tampered`` is the digest that the climb starts from. ``folded`` is the root that it leads to, and
    ``proof`` the steps, ``STEP`` bytes for each level. Without rows there is no tree and no row.
    """
    spark = leaves.sparkSession
    numbered = _numbered(leaves)
    written = {"numbered": numbered}
    paths = {"numbered": work_path(spark, "numbered")}
    numbered.write.parquet(paths["numbered"])
    for name, table in zip(("leaves", "nodes", "roots"), build_trees(spark.read.parquet(paths["numbered"]), levels), strict=True):
        written[name], paths[name] = table, work_path(spark, name)
        table.write.parquet(paths[name])
    # The recursion's total of rows is a few per leaf, beyond the setting's default.
    session = derived_session(spark, {"spark.sql.cteRecursionRowLimit": "-1"})
    read = {name: session.read.schema(table.schema).parquet(paths[name]) for name, table in written.items()}
    steps = session.sql(_CLIMB, leaves=read["leaves"], nodes=read["nodes"])
    climbed = steps.groupBy("tree", "idx").agg(
        F.array_sort(F.collect_list(F.struct("step", "path"))).alias("steps"), F.max_by("folded", "step").alias("folded")
    )
    proof = F.aggregate("steps", F.lit(bytearray()), lambda done, step: F.concat(done, step["path"]))
    proven = read["numbered"].join(climbed, ["tree", "idx"]).join(read["roots"], "tree")
    return proven.select("key", "leaf", "subroot", "root", "folded", proof.alias("proof"))


def proof_digest(proof: Column) -> Column:
    """sha256 of the siblings' digests in a row, from the leaf to the root."""
    count = (F.length(proof) / STEP).cast("int")
    steps = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    with_sibling = F.filter(steps, lambda i: F.substring(proof, i * STEP + 1, F.lit(1)) != F.lit(bytearray(NONE)))
    return F.sha2(F.array_join(F.transform(with_sibling, lambda i: F.lower(F.hex(F.substring(proof, i * STEP + 2, F.lit(32))))), ""), 256)


def manifest(docs: DataFrame, tampered: dict[str, Column], key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS) -> DataFrame:
    """Rows (``key``, leaf, subroot, root, proof_sha256, folded_root, verified), digests as hexadecimal text.

    ``tampered`` gives columns their values in the copy of the data that is checked against the manifest. A null field counts
    as ``-``; an empty one as ``0:``. Rows with a null group form a group of their own, the first one. Rows with one key are
    ordered by their leaf; repeated rows are leaves of their own. Columns that are not in ``fields`` have no influence.
    """
    original = [F.col(f) for f in fields]
    changed = [tampered.get(f, F.col(f)) for f in fields]
    name = F.col(group).cast("string")
    leaves = docs.select(
        F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("g"), name)).alias("grp"), F.col(key).alias("key"),
        leaf_digest(original).alias("leaf"), leaf_digest(changed).alias("tampered"),
    )
    proven = prove(leaves)
    text = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "root", "folded")}
    return proven.select(
        F.col("key").alias(key), text["leaf"].alias("leaf"), text["subroot"].alias("subroot"), text["root"].alias("root"),
        proof_digest(F.col("proof")).alias("proof_sha256"), text["folded"].alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


_CRC = """list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::ubigint)),
  lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))"""
ORACLE = """
with recursive f as materialized (
  select doc_id, lang, n_chars, case when doc_id is null then '-' else strlen(doc_id::varchar) || ':' || doc_id end
      || case when source is null then '-' else strlen(source) || ':' || source end
      || case when lang is null then '-' else strlen(lang) || ':' || lang end as a,
    case when text is null then '-' else strlen(text) || ':' || text end as z,
    (xor({crc}, 4294967295) % 7) = 0 as hit
  from documents
),
g as materialized (
  select doc_id, lang, sha256(a || case when n_chars is null then '-' else strlen(n_chars::varchar) || ':' || n_chars end || z) as leaf,
    case when hit and n_chars is not null then sha256(a || strlen((n_chars::hugeint + 1)::varchar) || ':' || (n_chars::hugeint + 1)::varchar || z) end as changed
  from f
),
leaves as materialized (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i,
    count(*) over (partition by lang) as n, dense_rank() over (order by encode(lang) nulls first) - 1 as tree
  from g
),
low(level, tree, i, n, h) as (
  select 0, tree, i, n, leaf from leaves
  union all
  select level + 1, tree, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from low where n > 1 group by level, tree, i // 2, n
),
low_nodes as materialized (select * from low),
subs as materialized (select tree as i, h, (select count(*) from low_nodes where n = 1) as n from low_nodes where n = 1),
high(level, i, n, h) as (
  select 0, i, n, h from subs
  union all
  select level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from high where n > 1 group by level, i // 2, n
),
nodes as materialized (
  select tree, level, i, n, h from low_nodes where n > 1
  union all select -1, level, i, n, h from high where n > 1
),
climb(k, tree, level, i, n, folded, proof, base) as (
  select (tree, i), tree, 0, i, n, coalesce(changed, leaf), '', tree from leaves
  union all
  select k, case when c.n = 1 then -1 else c.tree end, case when c.n = 1 then 0 else c.level + 1 end,
    case when c.n = 1 then c.base else c.i // 2 end, case when c.n = 1 then (select count(*) from subs) else (c.n + 1) // 2 end,
    case when c.n = 1 then c.folded when s.h is null then sha256(c.folded)
      when c.i % 2 = 1 then sha256(s.h || c.folded) else sha256(c.folded || s.h) end,
    case when c.n = 1 then c.proof else c.proof || coalesce(s.h, '') end, c.base
  from climb c left join nodes s on s.tree = c.tree and s.level = c.level and s.i = xor(c.i, 1)
  where not (c.n = 1 and c.tree = -1)
),
ends as (select * from climb where tree = -1 and n = 1),
root as (select h from high where n = 1)
select l.doc_id, l.leaf, s.h as subroot, (select h from root) as root, sha256(e.proof) as proof_sha256, e.folded as folded_root,
  e.folded = (select h from root) as verified
from leaves l join ends e on e.k = (l.tree, l.i) join subs s on s.i = l.tree
""".replace("{crc}", _CRC)
