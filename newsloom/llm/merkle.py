"""Merkle manifest of a dataset: a tree of hashes per source, a tree over the sources' roots, and
the proof of every row, in DataFrame functions alone.

Concatenated-level strings. The nodes of a level are cut into aligned blocks of BLOCK = FAN * FAN
consecutive nodes. A block is one row: its level is one string of hex digests, WIDTH letters
each; the parents are hashes of its fixed-width substrings, joined to the string of the next
level; the hash of that one is the block's root. The siblings of a node are what lies to its left
and right in the substring of its run. Block roots are the nodes of the next round, until every
tree has one node; the paths of the rounds above come down to the blocks by a join.

Places. A node's place in its tree comes from one sort by ranges of (tree, order) over the whole
cluster: rows number themselves within their range, and the few counts per range and tree give
what lies before. So a source with a third of all rows is spread like any other. Everything a
task holds is bounded by a block.

``H`` is the lowercase hex SHA-256 of its inputs, concatenated; digests go in as hex text.

Defined cases: null columns count as ``-`` in a leaf; null sources make a tree of their own, which
comes first; null ids come first in their tree; rows with equal ids follow their leaves, equal
leaves in any order (they are equal); a tree of one leaf has that leaf as its root; an empty table
has no row; other columns are ignored unless ``carry`` names them, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.tables import stored

FAN = 16
BLOCK = FAN * FAN
WIDTH = 64
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
STEP = "struct<left: string, right: string>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*inputs: Column) -> Column:
    """H."""
    return F.sha2(F.concat(*inputs).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as it goes into a leaf: ``-`` if null, else its UTF-8 bytes after their number."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


@dataclass
class Round:
    """One round of a forest: its blocks, and the nodes that they become."""

    blocks: DataFrame  # tree, block, members (place, digest, item), levels, first, second
    nodes: DataFrame  # tree, place, digest, total


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with (place, total): the place from 0 within ``tree`` by ``order``, and the rows
    of that tree."""
    numbered = rows.withColumn("nth", F.monotonically_increasing_id())
    keys = ["tree", *order, "nth"]
    numbered = stored(numbered, "merkle-rows").repartitionByRange(*keys).sortWithinPartitions(*keys)
    # Rows of a task are numbered from its number * 2^33 on.
    at = F.monotonically_increasing_id()
    numbered = numbered.withColumn("part", F.shiftright(at, 33)).withColumn(
        "row", at.bitwiseAND(F.lit((1 << 33) - 1))
    )
    numbered = stored(numbered.drop("nth"), "merkle-order")
    parts = numbered.groupBy("tree", "part").agg(
        F.count("*").alias("n"), F.min("row").alias("first_row")
    )
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "tree",
        "part",
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first_row")).alias("shift"),
        F.sum("n").over(Window.partitionBy("tree")).alias("total"),
    )
    return (
        numbered.join(parts, ["tree", "part"])
        .withColumn("place", F.col("row") + F.col("shift"))
        .drop("part", "row", "shift")
    )


def _runs(level: str, nodes: Column) -> Column:
    """The parents of a level: hashes of its runs of FAN digests, joined."""
    size = FAN * WIDTH
    runs = F.sequence(F.lit(0), F.ceil(nodes / FAN).cast("int") - 1)
    return F.array_join(
        F.transform(runs, lambda i: F.sha2(F.substr(level, i * size + 1, F.lit(size)).cast("binary"), 256)),
        "",
    )


def climb(nodes: DataFrame) -> Round:
    """One round: (tree, place, digest, total, item) to blocks, and their roots as nodes.

    A block of a tree with more than FAN nodes goes up two levels, one of a tree with more than
    one goes up one level, and a tree of one node stays as it is."""
    member = F.struct("place", "digest", "item").alias("member")
    blocks = (
        nodes.withColumn("block", F.floor(F.col("place") / BLOCK))
        .groupBy("tree", "block")
        .agg(F.array_sort(F.collect_list(member)).alias("members"), F.first("total").alias("total"))
        .withColumn("first", F.array_join(F.transform("members", lambda m: m["digest"]), ""))
        .withColumn("levels", F.expr(f"int(total > 1) + int(total > {FAN})"))
        .withColumn("second", _runs("first", F.size("members")))
        .withColumn(
            "root",
            F.when(F.col("levels") == 0, F.col("first"))
            .when(F.col("levels") == 1, F.col("second"))
            .otherwise(digest(F.col("second"))),
        )
    )
    blocks = stored(blocks, "merkle-blocks")
    above = blocks.select(
        "tree",
        F.col("block").alias("place"),
        F.col("root").alias("digest"),
        F.ceil(F.col("total") / BLOCK).alias("total"),
        F.struct(F.lit(0).alias("none")).alias("item"),
    )
    return Round(blocks, above)


def _own_path(place: Column) -> Column:
    """Siblings of the member at a place of its block, from its run upwards."""
    run, within = F.floor(place / FAN).cast("int"), F.pmod(place, F.lit(FAN)).cast("int")
    start = run * FAN * WIDTH

    def step(level: str, before: Column, begin: Column, after: Column) -> Column:
        at = begin + before * WIDTH
        return F.struct(
            F.substr(level, begin + 1, before * WIDTH).alias("left"),
            F.substr(level, at + WIDTH + 1, after * WIDTH).alias("right"),
        )

    low = step("first", within, start, FAN - 1 - within)
    high = step("second", run, F.lit(0), FAN - 1 - run)
    none = F.array().cast(f"array<{STEP}>")
    return (
        F.when(F.col("levels") == 0, none)
        .when(F.col("levels") == 1, F.array(low))
        .otherwise(F.array(low, high))
    )


def descend(one: Round, above: DataFrame) -> DataFrame:
    """Members of a round's blocks with their path: their own siblings, then the path of their
    block (``above``: tree, place, path, and whatever else the trees carry)."""
    rest = [name for name in above.columns if name not in ("tree", "place", "path")]
    over = above.select("tree", F.col("place").alias("block"), F.col("path").alias("upper"), *rest)
    members = one.blocks.drop("root", "total").join(over, ["tree", "block"]).select(
        "tree", "levels", "first", "second", "upper", *rest, F.posexplode("members").alias("i", "member")
    )
    return members.select(
        "tree",
        F.col("member.place").alias("place"),
        F.col("member.digest").alias("digest"),
        F.col("member.item").alias("item"),
        F.concat(_own_path(F.col("i")), "upper").alias("path"),
        *rest,
    )


def forest(nodes: DataFrame) -> list[Round]:
    """All rounds from (tree, place, digest, total, item) to one node per tree."""
    most = nodes.agg(F.max("total")).first()[0] or 1
    rounds = [climb(nodes)]
    while most > BLOCK:
        most = -(-most // BLOCK)
        rounds.append(climb(rounds[-1].nodes))
    return rounds


def paths(rounds: list[Round], tops: DataFrame) -> DataFrame:
    """From the top nodes with their paths down to the members of the first round."""
    above = tops
    for one in reversed(rounds):
        above = descend(one, above)
        if one is not rounds[0]:
            above = above.drop("digest", "item")
    return above


def manifest(leaves: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``leaves`` (doc_id, source, leaf): doc_id, source, leaf, the columns
    ``carry`` names as struct ``carried``, place in the source, subroot, root, and path, the
    siblings as (left, right) per level from the leaf to the root."""
    # A null source is '', any other has a sign before it: null first, then bytewise.
    tree = F.coalesce(F.concat(F.lit(":"), F.col("source")), F.lit(""))
    carried = F.struct(*carry) if carry else F.struct(F.lit(0).alias("none"))
    rows = leaves.select(
        tree.alias("tree"),
        F.col("leaf").alias("digest"),
        "doc_id",
        F.struct("doc_id", "source", carried.alias("carried")).alias("item"),
    )
    sources = forest(placed(rows, ["doc_id", "digest"]).drop("doc_id"))
    subroots = sources[-1].nodes.select(
        F.lit(0).alias("tree"), F.col("tree").alias("name"), "digest",
        F.struct(F.col("tree").alias("name")).alias("item"),
    )
    whole = forest(placed(subroots, ["name"]).drop("name"))
    top = whole[-1].nodes.select(
        "tree", "place", F.col("digest").alias("root"), F.array().cast(f"array<{STEP}>").alias("path")
    )
    tops = paths(whole, top).select(
        F.col("item.name").alias("tree"),
        F.lit(0).cast("bigint").alias("place"),
        F.col("digest").alias("subroot"),
        "root",
        "path",
    )
    return paths(sources, stored(tops, "merkle-subroots")).select(
        "item.doc_id",
        "item.source",
        F.col("digest").alias("leaf"),
        "item.carried",
        "place",
        "subroot",
        "root",
        "path",
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def siblings(path: Column) -> Column:
    """All siblings of a path in one string, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def verified(documents: DataFrame) -> DataFrame:
    """The manifest of ``documents``, and what its proofs say after a tampering: every fifth row
    (by CRC-32 of its id) has the letters A-Z of its text lower-cased."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    hit = F.coalesce(crc % 5 == 0, F.lit(False))
    others = [F.col(name) for name in FIELDS[:-1]]
    # None where nothing was tampered with: the leaf is taken as it is.
    changed = F.when(hit, leaf(*others, lower_ascii(F.col("text"))))
    leaves = documents.select(
        "doc_id", "source", leaf(*others, F.col("text")).alias("leaf"), changed.alias("tampered")
    )
    proofs = manifest(leaves, carry=["tampered"])
    found = proofs.withColumn(
        "folded_root", folded(F.coalesce("carried.tampered", "leaf"), F.col("path"))
    )
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        digest(siblings(F.col("path"))).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _sql_climb(name: str, levels: int) -> list[str]:
    """CTEs from ``name``_0 (tree, place, h, total, tie) up; a tree of one node stays."""
    out = []
    for k in range(levels):
        out.append(
            f"{name}_{k + 1} AS MATERIALIZED (SELECT tree, place // {FAN} AS place, CASE WHEN max(total) = 1 "
            f"THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY place)) END AS h, "
            f"max((total + {FAN - 1}) // {FAN}) AS total FROM {name}_{k} GROUP BY ALL)"
        )
    return out


def twin_sql(levels: int = 6) -> str:
    """DuckDB SQL of ``verified``, for sources, and numbers of sources, of up to FAN^levels."""

    def steps(name: str, start: str, key: str) -> list[str]:
        """Siblings (left, right) of each level, joined to the rows of ``start``."""
        joins, columns = [], []
        for k in range(levels):
            run = f"{start}.{key} // {FAN**k}"
            joins.append(
                f"LEFT JOIN {name}_run_{k} AS {name}{k} ON {name}{k}.tree = {start}.{name}_tree "
                f"AND {name}{k}.run = {run} // {FAN} AND {name}{k}.total > 1"
            )
            within = f"(({run}) % {FAN})"
            columns.append(
                f"CASE WHEN {name}{k}.run IS NULL THEN NULL ELSE {{'l': substr({name}{k}.hs, 1, "
                f"CAST({within} * {WIDTH} AS BIGINT)), 'r': substr({name}{k}.hs, CAST({within} * {WIDTH} AS BIGINT) + {WIDTH + 1})}} END"
            )
        return [" ".join(joins), ", ".join(columns)]

    def runs(name: str) -> list[str]:
        return [
            f"{name}_run_{k} AS MATERIALIZED (SELECT tree, place // {FAN} AS run, string_agg(h, '' ORDER BY place) "
            f"AS hs, max(total) AS total FROM {name}_{k} GROUP BY ALL)"
            for k in range(levels)
        ]

    def leaf_sql(text: str) -> str:
        parts = [*FIELDS[:-1], text]
        joined = " || ".join(
            f"coalesce(strlen(CAST({p} AS VARCHAR)) || ':' || CAST({p} AS VARCHAR), '-')" for p in parts
        )
        return f"sha256({joined})"

    polynomial = 0xEDB88320
    bit = f"(CASE WHEN c % 2 = 1 THEN xor(c // 2, {polynomial}) ELSE c // 2 END)"
    crc_table = ", ".join(
        ["crc_0 AS (SELECT i, CAST(i AS BIGINT) AS c FROM range(256) AS r(i))"]
        + [f"crc_{k + 1} AS (SELECT i, {bit} AS c FROM crc_{k})" for k in range(8)]
        + ["crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM crc_8)"]
    )
    lowered = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    crc = (
        "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), "
        "lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"
    )
    s_joins, s_columns = steps("s", "rows_", "place")
    g_joins, g_columns = steps("g", "rows_", "g_place")
    return (
        f"WITH {crc_table}, "
        f"leaves AS MATERIALIZED (SELECT doc_id, coalesce(':' || source, '') AS tree, {leaf_sql('text')} AS h, "
        f"CASE WHEN {crc} % 5 = 0 THEN {leaf_sql(lowered)} END AS tampered FROM documents, crc), "
        "s_0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS place, "
        "count(*) OVER (PARTITION BY tree) AS total FROM leaves), "
        + ", ".join(_sql_climb("s", levels) + runs("s"))
        + ", g_0 AS MATERIALIZED (SELECT 0 AS tree, tree AS name, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, "
        f"count(*) OVER () AS total FROM s_{levels}), "
        + ", ".join(_sql_climb("g", levels) + runs("g"))
        + ", rows_ AS MATERIALIZED (SELECT s_0.*, s_0.tree AS s_tree, 0 AS g_tree, g_0.place AS g_place, g_0.h AS subroot, "
        f"(SELECT max(h) FROM g_{levels}) AS root FROM s_0 JOIN g_0 ON g_0.name = s_0.tree), "
        f"steps AS MATERIALIZED (SELECT rows_.doc_id, rows_.h, rows_.tampered, rows_.subroot, rows_.root, "
        f"list_filter([{s_columns}, {g_columns}], lambda x: x IS NOT NULL) AS path FROM rows_ {s_joins} {g_joins}), "
        "folds AS (SELECT *, list_reduce(path, lambda n, x: {'l': sha256(x.l || n.l || x.r), 'r': ''}, "
        "{'l': coalesce(tampered, h), 'r': ''}).l AS folded_root FROM steps) "
        "SELECT doc_id, h AS leaf, subroot, root, sha256(list_aggregate(list_transform(path, lambda x: x.l || x.r) || [''], "
        "'string_agg', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folds"
    )
