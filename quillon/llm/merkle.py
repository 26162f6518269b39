"""Merkle manifest of a dataset: a tree of SHA-256 digests over its rows, and a proof for each of them.

Every row is a leaf. The leaves of a source, in order of doc_id, form a tree of fanout 16: while several nodes
remain, each run of 16 neighbours becomes their digest. What remains is the source's subroot; the subroots, in order
of source, form the tree whose root names the dataset.

Positions come from one sort by range and from counts per range, so they are exact and no task sees a whole source.
Leaves then go to aligned blocks of 16^3. In a block, digests are one contiguous matrix of 64-byte hex rows: sixteen
rows reshaped to one are what a node's digest is taken of, level by level, and a sibling's row follows from a node's
index. A block leaves one node, and blocks of such nodes form the next table, so a tree of any size takes a few
rounds. Proofs go the other way: a block hands the path of its node to its members, and leaves fold their own
digest along it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillon.llm.common import quoted, staged, table, without

FANOUT = 16
#: Levels of the tree that one block spans, and the leaves of a block.
LEVELS = 3
BLOCK = FANOUT**LEVELS
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"
#: Rows whose check reads an altered text, in the registered query: those whose id's checksum this divides.
TAMPERED = 5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def leaf_digest(*values: Column) -> Column:
    """Digest of values: ``-`` for a null, else the value's number of UTF-8 bytes, a colon and the value."""
    told = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*told), 256)


def lowered(text: Column) -> Column:
    """A text with A-Z in lower case, all else as it is."""
    return F.translate(text, _UPPER, _UPPER.lower())


# ---- positions


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of each group (the first column) within a sorted partition."""
    part, group, seen = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        groups = b.column(0).to_numpy(zero_copy_only=False)
        heads = np.concatenate([[groups[0] != group], groups[1:] != groups[:-1]])
        at = np.arange(b.num_rows)
        local = at - np.maximum.accumulate(np.where(heads, at, 0))
        if not heads[0]:
            first = int(np.argmax(heads)) if heads.any() else b.num_rows
            local[:first] += seen
        group, seen = groups[-1], int(local[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part)), pa.array(local)], names=[*b.schema.names, "part", "local"])


def positioned(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (grp, ...) with ``pos``, a row's place in its group by ``order``, and ``n``, the rows of its group.

    One sort by range over all groups; a group's places in a range begin after its rows in the ranges before."""
    sorted_ = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    sorted_ = sorted_.select("grp", *[c for c in rows.columns if c != "grp"])
    schema = StructType([*sorted_.schema.fields, StructField("part", LongType()), StructField("local", LongType())])
    local = staged(sorted_.mapInArrow(_numbered, schema), "merkle-sorted")
    counts = local.groupBy("grp", "part").agg(F.count("*").alias("here"))
    of = Window.partitionBy("grp")
    upto = F.sum("here").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("here")
    placed = counts.select("grp", "part", upto.alias("before"), F.sum("here").over(of).alias("n"))
    return local.join(placed, ["grp", "part"]).withColumn("pos", F.col("before") + F.col("local")).drop("part", "local", "before")


# ---- blocks


def block_levels(leaves: np.ndarray, n: int) -> list[np.ndarray]:
    """The levels of an aligned block, from its leaves (a matrix of hex rows) upwards. ``n`` counts the nodes of the
    whole level that the leaves belong to: a level of one node is the top."""
    levels = [leaves]
    while n > 1 and len(levels) <= LEVELS:
        rows, whole = levels[-1], len(levels[-1]) // FANOUT * FANOUT
        of = [*np.ascontiguousarray(rows[:whole]).reshape(-1, FANOUT * HEX)]
        if whole < len(rows):
            of.append(np.ascontiguousarray(rows[whole:]).reshape(-1))
        levels.append(hex_rows([sha256(x).hexdigest() for x in of]))
        n = -(-n // FANOUT)
    return levels


def hex_rows(digests: list[str]) -> np.ndarray:
    return np.frombuffer("".join(digests).encode("ascii"), dtype=np.uint8).reshape(-1, HEX)


def sibling_bytes(nodes: int, at: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """For nodes (by index) of a level of ``nodes``, in bytes of the level's rows: where each one's run of 16 begins,
    where its own row does, and where the run ends."""
    first = at // FANOUT * FANOUT
    return (first * HEX).tolist(), (at * HEX).tolist(), (np.minimum(first + FANOUT, nodes) * HEX).tolist()


def paths_of(levels: list[np.ndarray]) -> list[list[tuple[str, str]]]:
    """Each leaf's path in its block: at every level the siblings before it and those after it."""
    paths: list[list[tuple[str, str]]] = [[] for _ in range(len(levels[0]))]
    at = np.arange(len(levels[0]))
    for level in levels[:-1]:
        rows = level.tobytes().decode("ascii")
        for path, low, own, high in zip(paths, *sibling_bytes(len(level), at)):
            path.append((rows[low:own], rows[own + HEX : high]))
        at = at // FANOUT
    return paths


def folded(levels: list[np.ndarray], digests: np.ndarray, above: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """For every leaf of a block, the digest of its siblings up to the root, and the root that ``digests``, a row a
    leaf in their place, lead to with these siblings."""
    proofs, now, at = [sha256() for _ in digests], [row.tobytes() for row in digests], np.arange(len(digests))
    for level in levels[:-1]:
        rows = memoryview(np.ascontiguousarray(level).reshape(-1))
        for k, (low, own, high) in enumerate(zip(*sibling_bytes(len(level), at))):
            left, right = rows[low:own], rows[own + HEX : high]
            proofs[k].update(left)
            proofs[k].update(right)
            node = sha256(left)
            node.update(now[k])
            node.update(right)
            now[k] = node.hexdigest().encode("ascii")
        at = at // FANOUT
    rest = [(left.encode("ascii"), right.encode("ascii")) for left, right in above]
    tail = b"".join(left + right for left, right in rest)
    roots = []
    for proof, digest in zip(proofs, now):
        proof.update(tail)
        for left, right in rest:
            digest = sha256(left + digest + right).hexdigest().encode("ascii")
        roots.append(digest.decode("ascii"))
    return [p.hexdigest() for p in proofs], roots


def _in_order(block: pa.Table) -> tuple[pa.Table, np.ndarray, int]:
    block = block.sort_by("pos")
    return block, hex_rows(block.column("digest").to_pylist()), block.column("n")[0].as_py()


def _reduced(block: pa.Table) -> pa.Table:
    """The node that a block leaves, in the level above its own."""
    levels = block_levels(*_in_order(block)[1:])
    n, pos = block.column("n")[0].as_py(), block.column("pos")[0].as_py()
    top = levels[-1].tobytes().decode("ascii")
    return pa.table({"grp": block.column("grp").slice(0, 1), "n": [-(-n // BLOCK)], "pos": [pos // BLOCK], "digest": [top]})


def _block_paths(block: pa.Table, above: pa.Table) -> pa.Table:
    """The paths of a block's members, from that of its node."""
    block, digests, n = _in_order(block)
    rest = [(x["left"], x["right"]) for x in above.column("path")[0].as_py()]
    paths = [[{"left": a, "right": b} for a, b in [*path, *rest]] for path in paths_of(block_levels(digests, n))]
    same = {c: [above.column(c)[0].as_py()] * len(paths) for c in ("subroot", "root")}
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    return pa.table({"grp": block.column("grp"), "pos": block.column("pos"), "path": pa.array(paths, kind), **same})


def _proven(block: pa.Table, above: pa.Table) -> pa.Table:
    """The rows of a block with what their proofs give."""
    block, digests, n = _in_order(block)
    rest = [(x["left"], x["right"]) for x in above.column("path")[0].as_py()]
    proofs, roots = folded(block_levels(digests, n), hex_rows(block.column("shown").to_pylist()), rest)
    one = lambda c: [above.column(c)[0].as_py()] * len(proofs)
    return pa.table({"row": block.column("row"), "leaf": block.column("digest"), "subroot": one("subroot"), "root": one("root"), "proof_sha256": proofs, "folded_root": roots})


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """Tables of nodes (grp, n, pos, digest), from the given one up to that of one node a group."""
    tables = [nodes]
    while True:
        blocks = tables[-1].select("grp", "n", "pos", "digest", F.floor(F.col("pos") / BLOCK).alias("block")).groupBy("grp", "block")
        tables.append(staged(blocks.applyInArrow(_reduced, "grp string, n long, pos long, digest string"), "merkle-nodes"))
        if (tables[-1].agg(F.max("n")).first()[0] or 0) <= 1:
            return tables


def _down(tables: list[DataFrame], paths: DataFrame) -> DataFrame:
    """The paths of the nodes of ``tables[1]``, from those (grp, pos, path, subroot, root) of the last table."""
    for nodes in tables[-2:0:-1]:
        blocks = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).groupBy("grp", "block")
        above = paths.withColumnRenamed("pos", "block").groupBy("grp", "block")
        paths = staged(blocks.cogroup(above).applyInArrow(_block_paths, f"grp string, pos long, path {PATH}, subroot string, root string"), "merkle-paths")
    return paths


# ---- manifest


def manifest(docs: DataFrame, shown: Column | None = None) -> DataFrame:
    """The rows of ``docs`` (doc_id, source, lang, n_chars, text, ...), without the last four of these, with ``leaf``, ``subroot`` and ``root``, ``proof_sha256`` (the digest
    of a row's siblings, level by level, from left to right), ``folded_root`` (what the shown text leads to with
    these siblings) and ``verified`` (whether that is the root).

    ``shown`` is the text that rows are checked with, their own unless given. Null values are told from empty ones.
    Leaves of equal doc_id are in order of their digests, null ids come first; equal rows are leaves of their own and
    have neighbouring places. A null source is a source, before all others. A lone leaf is its subroot and a lone
    subroot the root; their rows have no siblings, and the digest of nothing as proof. Texts are read whole, an empty
    table stays empty, input columns of the added names are replaced."""
    added = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "row")
    docs = without(docs, *added)
    own = [quoted(c) for c in FIELDS]
    seen = own if shown is None else [*own[:-1], shown]
    group = F.coalesce(F.concat(F.lit("="), own[1]), F.lit("-"))  # "-" sorts before "="
    told = docs.withColumns({"leaf": leaf_digest(*own), "shown": leaf_digest(*seen)}) if shown is not None else docs.withColumn("leaf", leaf_digest(*own)).withColumn("shown", F.col("leaf"))
    carried = [c for c in docs.columns if c not in FIELDS[1:]]
    leaves = staged(told.select(*[quoted(c) for c in carried], group.alias("grp"), F.col("leaf").alias("digest"), "shown", F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    placed = staged(positioned(leaves.select("grp", F.col("doc_id").alias("id"), "digest", "shown", "row"), "id", "digest", "row"), "merkle-placed")
    up = _rounds(placed)
    subroots = up[-1].select(F.col("grp").alias("of"), F.col("digest").alias("subroot"))
    tops = staged(positioned(subroots.select(F.lit("").alias("grp"), "of", F.col("subroot").alias("digest")), "of"), "merkle-subroots")
    over = _rounds(tops)
    root = over[-1].select("grp", "pos", F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    blocks = tops.withColumn("block", F.floor(F.col("pos") / BLOCK)).groupBy("grp", "block")
    above = _down(over, root).withColumnRenamed("pos", "block").groupBy("grp", "block")
    of_top = staged(blocks.cogroup(above).applyInArrow(_block_paths, f"grp string, pos long, path {PATH}, subroot string, root string"), "merkle-tops")
    named = tops.select("of", "pos", "digest").join(of_top.select("pos", "path", "root"), "pos")
    paths = _down(up, named.select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root"))
    blocks = placed.withColumn("block", F.floor(F.col("pos") / BLOCK)).groupBy("grp", "block")
    proven = blocks.cogroup(paths.withColumnRenamed("pos", "block").groupBy("grp", "block")).applyInArrow(_proven, "row long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    out = proven.withColumn("verified", F.col("folded_root") == F.col("root"))
    return leaves.select("row", *[quoted(c) for c in carried]).join(out, "row").drop("row")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    altered = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    out = manifest(docs, F.when(altered, lowered(F.col("text"))).otherwise(F.col("text")))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _sql(levels: int) -> str:
    """DuckDB SQL of the query, for sources of up to 16^levels rows and as many sources. Checksums are computed bit
    by bit, as SQL has none."""
    told = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    digest = lambda text: "sha256(" + " || ".join([*map(told, FIELDS[:-1]), told(text)]) + ")"
    bits = lambda x: f"list_reduce([{x}] || [CAST(k AS BIGINT) FOR k IN range(8)], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    crc = f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')], lambda a, x: xor(a >> 8, {bits('xor(a, x) & 255')})), 4294967295)"
    lower = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"
    out = [
        f"n0 AS (SELECT doc_id, coalesce('=' || source, '-') AS grp, {digest('text')} AS leaf, {digest(f'CASE WHEN {crc} % {TAMPERED} = 0 THEN {lower} ELSE text END')} AS shown FROM documents)",
        "n1 AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM n0)",
        "a0 AS (SELECT grp, pos, leaf AS digest, count(*) OVER (PARTITION BY grp) AS n FROM n1)",
    ]

    def tree(name: str) -> None:
        for k in range(levels):
            run = "string_agg(digest, '' ORDER BY pos)"
            out.append(f"{name}{k + 1} AS (SELECT grp, p AS pos, digest, count(*) OVER (PARTITION BY grp) AS n FROM (SELECT grp, pos // 16 AS p, CASE WHEN max(n) > 1 THEN sha256({run}) ELSE max(digest) END AS digest FROM {name}{k} GROUP BY grp, pos // 16))")

    tree("a")
    out.append(f"b0 AS (SELECT 0 AS grp, row_number() OVER (ORDER BY grp) - 1 AS pos, digest, count(*) OVER () AS n, grp AS name FROM a{levels})")
    tree("b")
    # the siblings of each level, and a row's digest folded over them
    out.append("f0 AS (SELECT doc_id, leaf, n1.grp, n1.pos, b.pos AS top, '' AS proof, shown AS now, b.digest AS subroot FROM n1 JOIN b0 b ON n1.grp = b.name)")
    step = 0
    for name, grp, at in (("a", "grp", "pos"), ("b", "0", "top")):
        for k in range(levels):
            side = lambda op: f"coalesce((SELECT string_agg(digest, '' ORDER BY pos) FROM {name}{k} s WHERE s.grp = {'f.grp' if grp == 'grp' else 0} AND s.n > 1 AND s.pos // 16 = f.{at} // 16 AND s.pos {op} f.{at}), '')"  # noqa: B023, E731
            more = f"(SELECT max(n) FROM {name}{k} s WHERE s.grp = {'f.grp' if grp == 'grp' else 0})"
            out.append(f"g{step} AS (SELECT *, {side('<')} AS l, {side('>')} AS r, {more} AS m FROM f{step} f)")
            moved = "pos // 16 AS pos, top" if at == "pos" else "pos, top // 16 AS top"
            out.append(f"f{step + 1} AS (SELECT doc_id, leaf, grp, {moved}, proof || l || r AS proof, CASE WHEN m > 1 THEN sha256(l || now || r) ELSE now END AS now, subroot FROM g{step})")
            step += 1
    return (
        "WITH " + ", ".join(out) + f" SELECT doc_id, leaf, subroot, (SELECT digest FROM b{levels}) AS root, sha256(proof) AS proof_sha256, now AS folded_root, "
        f"now = (SELECT digest FROM b{levels}) AS verified FROM f{step}"
    )


#: For up to 65,536 rows a source.
OP11_SQL = _sql(4)
