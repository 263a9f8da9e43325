"""Documents whose sets of word n-grams are similar: exact Jaccard self-join.

Method: the n-grams of a document are ordered rare first; two sets that reach the threshold must
share an n-gram of their prefixes. Prefix n-grams are joined under length, positional and suffix
filters, and every candidate pair is verified once on the whole texts.

Order. Any order known to all tasks gives the same result. Here it is the rank of a counter table
of fixed size (COUNTERS buckets, filled with all n-grams of all documents), then a hash. With many
n-grams a bucket a rare n-gram is no longer told from another, but one shared by many documents
still stands out, and those must stay out of the prefixes.

Groups. Equal sets form one class and go on as one. A large group of near copies shares its
prefix n-grams, so all pairs of a list are never written: first each member of a list is verified
with one hub of the list only (the set with most copies, then one chosen by hash), links are
joined to components, and then only members of *different* components of a list are paired: pairs
within a component can't change the result. Lists longer than SMALL_LIST are paired in blocks of
about BLOCK members, and only pairs that pass the suffix filter leave the task.

Defined cases: only A-Z are lower-cased; fewer words than n: the whole sequence is the one n-gram;
no words or a null text: no n-gram, linked with nothing; a null id: returned, in no component, and
linked with nothing; rows with the same id: each counted on its own text, their components meet in
that id only if the texts link; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.arrays import LOWER, Piece, Rolling, frugal, gram_hashes, mix, pieces, words
from newsloom.llm.components import components
from newsloom.llm.tables import forget, prune, stored

# Buckets of the counter table: 4 MB of counters a task while counting, 1 MB of ranks in the end.
COUNTERS = 1 << 20
# Cells of a set's histogram, for the suffix filter; a full cell (255) counts as without bound.
CELLS = 128
SMALL_LIST = 16
BLOCK = 512
# A list that may be longer than this is read in parts of about this size.
LIST_PART = 100_000
# Pairs verified at a time in a task.
VERIFY_ROWS = 256


def shingles(piece: Piece, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text: (hash, owner), sorted by owner and hash."""
    data = LOWER[piece.data]
    found = words(Piece(piece.first, data, piece.offsets))
    hashes = Rolling(data).hashes(found.starts, found.ends)
    owner, counts = found.owner, found.counts
    grams = gram_hashes(hashes, size)
    at = np.flatnonzero(owner[: len(grams)] == owner[len(owner) - len(grams) :])
    parts, owners = [grams[at]], [owner[at]]
    for short in range(1, size):
        texts = np.flatnonzero(counts == short)
        if len(texts):
            key = gram_hashes(hashes, short)[found.first[texts]]
            parts.append(mix(key + np.uint64(short)))
            owners.append(texts)
    grams, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[fresh], owner[fresh]


def signatures(grams: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and signature of each set; equal sets have equal ones."""
    n = np.bincount(owner, minlength=texts)
    sums = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(mix(grams ^ np.uint64(0x9E3779B97F4A7C15)), out=sums[1:])
    ends = np.cumsum(n)
    return n, mix(sums[ends] - sums[ends - n]).view(np.int64)


def _surveyed(documents: DataFrame, size: int) -> DataFrame:
    """Per document its set's size, signature and histogram; per task one row of counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.uint32)
        names = ["doc_id", "n", "sig", "cells", "counters"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            for piece in pieces(batch.column("text")):
                texts = len(piece)
                grams, owner = shingles(piece, size)
                np.add.at(counters, (grams & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
                n, sig = signatures(grams, owner, texts)
                cell = owner * CELLS + (grams >> np.uint64(57)).astype(np.int64)
                cells = np.minimum(np.bincount(cell, minlength=texts * CELLS), 255)
                cells = cells.astype(np.uint8).tobytes()
                columns = [
                    batch.column("doc_id").slice(piece.first, texts).cast(pa.int64()),
                    pa.array(n.astype(np.int64)), pa.array(sig),
                    pa.array([cells[k : k + CELLS] for k in range(0, len(cells), CELLS)], kinds[3]),
                    pa.nulls(texts, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
        last = [pa.nulls(1, kind) for kind in kinds[:4]] + [pa.array([counters.tobytes()])]
        yield pa.RecordBatch.from_arrays(last, names)

    return documents.select("doc_id", "text").mapInArrow(
        frugal(run), "doc_id bigint, n bigint, sig bigint, cells binary, counters binary"
    )


def _summed(counters: DataFrame) -> np.ndarray:
    """Sum of all counter rows: in about sqrt(rows) tasks, then in one; each holds one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for value in batch.column(0):
                total += np.frombuffer(value.as_buffer(), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["counters"])

    parts = max(1, int(counters.count() ** 0.5))
    once = counters.repartition(parts).mapInArrow(run, "counters binary")
    total = once.coalesce(1).mapInArrow(run, "counters binary").first()
    return np.frombuffer(bytes(total[0]), np.uint32)


def ranks_of(counters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each bucket in the order, and parts that a list of it is read in."""
    usual = counters.mean()
    excess = np.maximum(counters - usual - 4 * np.sqrt(usual), 0)
    ranks = np.minimum(np.floor(8 * np.log2(1 + excess)), 255)
    return ranks.astype(np.uint8), (1 + excess // LIST_PART).astype(np.int32)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Rarest n-grams of a set of which a linked set must share one."""
    return n - (percent * n + 99) // 100 + 1


def _postings(documents: DataFrame, size: int, percent: int, counters: np.ndarray) -> DataFrame:
    ranks, parts = ranks_of(counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                grams, owner = shingles(piece, size)
                n, sig = signatures(grams, owner, len(piece))
                bucket = (grams & np.uint64(COUNTERS - 1)).astype(np.int64)
                token = (ranks[bucket].astype(np.uint64) << np.uint64(56)) | (
                    grams >> np.uint64(8)
                )
                order = np.lexsort((token, owner))
                place = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
                chosen = place < prefix_length(n, percent)[owner]
                at, who = order[chosen], owner[chosen]
                part = (sig[who] & 0x7FFFFFFF) % parts[bucket[at]]
                columns = [
                    token[at].view(np.int64), part.astype(np.int32) + (parts[bucket[at]] << 16),
                    n[who].astype(np.int32), sig[who], place[chosen].astype(np.int32),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], ["token", "part", "n", "sig", "place"]
                )

    known = documents.where(F.col("doc_id").isNotNull())
    return known.select("text").mapInArrow(
        frugal(run), "token bigint, part int, n int, sig bigint, place int"
    )


def _may_link(percent: int, n_a: Column, n_b: Column) -> Column:
    return percent * F.greatest(n_a, n_b) <= 100 * F.least(n_a, n_b)


def _in_reach(percent: int, a: str, b: str) -> Column:
    """Length and positional filters: enough n-grams are left from this common one on."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(n_a - F.col(f"{a}.place"), n_b - F.col(f"{b}.place"))
    return _may_link(percent, n_a, n_b) & ((100 + percent) * left >= percent * (n_a + n_b))


def overlaps(
    left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], texts: int
) -> np.ndarray:
    """Size of the intersection of the two sets of each text."""
    grams = np.concatenate([left[0], right[0]])
    owner = np.concatenate([left[1], right[1]])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    same = (grams[1:] == grams[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(owner[1:][same], minlength=texts)


def _batch_shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    grams, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for piece in pieces(texts):
        g, owner = shingles(piece, size)
        grams.append(g)
        owners.append(owner + piece.first)
    return np.concatenate(grams), np.concatenate(owners)


def _cells(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(v.as_buffer(), np.uint8) for v in column]).reshape(-1, CELLS)


def shared_at_most(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Suffix filter: a bound of the common n-grams, as a common one lies in the same cell of
    both histograms; arrays of cells, whose leading dimensions broadcast."""
    least = np.minimum(x, y)
    bound = least.sum(-1, dtype=np.int64)
    return np.where((least == 255).any(-1), np.iinfo(np.int64).max >> 8, bound)


def _far_members(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in long lists: every two blocks of a list meet in one
    group, which has two blocks' rows at most."""

    def run(table: pa.Table) -> pa.Table:
        rep, n, place, component, block = (
            table.column(c).to_numpy() for c in ("rep", "n", "place", "component", "block")
        )
        cells = _cells(table.column("cells").combine_chunks())
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        same = bool(block.min() == block.max())
        if same and table.column("i")[0] != table.column("j")[0]:
            right = right[:0]  # the other block is empty
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first in range(0, len(left), 32):
            some = left[first : first + 32]
            n_a, n_b = n[some][:, None], n[right][None]
            ok = component[some][:, None] != component[right][None]
            ok &= percent * np.maximum(n_a, n_b) <= 100 * np.minimum(n_a, n_b)
            rest = np.minimum(n_a - place[some][:, None], n_b - place[right][None])
            ok &= (100 + percent) * rest >= percent * (n_a + n_b)
            if same:
                ok &= rep[some][:, None] < rep[right][None]
            x, y = np.nonzero(ok)
            for at in range(0, len(x), 8192):
                p, q = some[x[at : at + 8192]], right[y[at : at + 8192]]
                most = shared_at_most(cells[p], cells[q])
                close = (100 + percent) * most >= percent * (n[p] + n[q])
                out_a.append(np.minimum(rep[p], rep[q])[close])
                out_b.append(np.maximum(rep[p], rep[q])[close])
        return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    member = lists.withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.hash("rep"), F.col("blocks"))
    )
    met = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return (
        met.withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .groupBy("token", "i", "j")
        .applyInArrow(run, "a bigint, b bigint")
    )


def verified(
    pairs: DataFrame, documents: DataFrame, classes: DataFrame, size: int, percent: int
) -> DataFrame:
    """Pairs (a, b) of class ids that reach the threshold, stored.

    First the suffix filter on histograms (a common n-gram lies in the same cell of both), then
    the sets themselves, from the texts of the two representatives."""
    a = classes.select(F.col("rep").alias("a"), F.struct("n", "sig", "cells").alias("x"))
    b = classes.select(F.col("rep").alias("b"), F.struct("n", "sig", "cells").alias("y"))

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            most = shared_at_most(_cells(batch.column("x")), _cells(batch.column("y")))
            yield batch.filter(pa.array((100 + percent) * most >= percent * n)).select(
                ["a", "b", "sig_a", "sig_b"]
            )

    close = (
        pairs.join(a, "a")
        .join(b, "b")
        .selectExpr(
            "a", "b", "x.sig AS sig_a", "y.sig AS sig_b", "x.n AS n_a", "y.n AS n_b",
            "x.cells AS x", "y.cells AS y",
        )
        .mapInArrow(frugal(filtered), "a bigint, b bigint, sig_a bigint, sig_b bigint")
    )
    close = stored(close, "close")
    wanted = close.select(F.col("a").alias("doc_id")).union(close.select("b")).distinct()

    def with_signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                _, sig = signatures(*shingles(piece, size), len(piece))
                part = batch.slice(piece.first, len(piece))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(sig), part.column("text")],
                    ["doc_id", "sig", "text"],
                )

    texts = prune(documents.select("doc_id", "text"), "doc_id", wanted).mapInArrow(
        frugal(with_signature), "doc_id bigint, sig bigint, text string"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), VERIFY_ROWS):
                batch = whole.slice(first, VERIFY_ROWS)
                left = _batch_shingles(batch.column("text_a"), size)
                right = _batch_shingles(batch.column("text_b"), size)
                both = overlaps(left, right, len(batch))
                union = (
                    np.bincount(left[1], minlength=len(batch))
                    + np.bincount(right[1], minlength=len(batch))
                    - both
                )
                linked = pa.array((100 * both >= percent * union) & (union > 0))
                yield batch.select(["a", "b"]).filter(linked)

    text_a = texts.select(
        F.col("doc_id").alias("a"), F.col("sig").alias("sig_a"), F.col("text").alias("text_a")
    )
    text_b = texts.select(
        F.col("doc_id").alias("b"), F.col("sig").alias("sig_b"), F.col("text").alias("text_b")
    )
    joined = close.join(text_a, ["a", "sig_a"]).join(text_b, ["b", "sig_b"])
    links = stored(
        joined.select("a", "b", "text_a", "text_b").mapInArrow(frugal(compare), "a bigint, b bigint"), "links"
    )
    del joined, text_a, text_b, texts, wanted
    forget(close)
    return links


def _open_lists(shared: DataFrame, links: DataFrame) -> DataFrame:
    """Members of the lists that span several components, with component and list size."""
    labels = components(links).select(F.col("id").alias("rep"), "component")
    members = shared.join(labels, "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")
    )
    spans = members.groupBy("token").agg(
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.count("*").alias("size"),
    )
    return members.join(spans.where("low <> high").select("token", "size"), "token")


def linked_components(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document."""
    surveyed = stored(_surveyed(documents, size), "survey")
    per_document = surveyed.where("counters IS NULL").select("doc_id", "n", "sig", "cells")
    counters = _summed(surveyed.where("counters IS NOT NULL").select("counters"))
    classes = (
        per_document.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("n", "sig")
        .agg(
            F.min("doc_id").alias("rep"),
            F.first("cells").alias("cells"),
            F.count("*").alias("copies"),
        )
    )
    classes = stored(classes, "classes")

    # Prefix n-grams that two classes share.
    lists = Window.partitionBy("token", "part")
    shared = (
        _postings(documents, size, percent, counters)
        .withColumn("least", F.min("sig").over(lists))
        .withColumn("most", F.max("sig").over(lists))
        .where("least <> most OR part >= 131072")
        .select("token", "n", "sig", "place")
        .distinct()
    )
    shared = stored(
        shared.join(classes.select("n", "sig", "rep", "copies"), ["n", "sig"]).select(
            "token", "n", "place", "rep", "copies"
        ),
        "shared",
    )

    # Each member of a list with a hub of the list, as long as the list is not one component.
    links = documents.sparkSession.createDataFrame([], "a bigint, b bigint")
    met = links
    for hub in (F.struct(-F.col("copies"), "rep"), F.struct(F.hash("rep"), "rep")):
        members = stored(_open_lists(shared, links), "open")
        hubs = members.groupBy("token").agg(
            F.min(F.struct(hub.alias("by"), "rep", "n", "place", "component")).alias("hub")
        )
        ends = F.col("hub.rep"), F.col("member.rep")
        stars = (
            members.select("token", F.struct("n", "rep", "place", "component").alias("member"))
            .join(hubs, "token")
            .where(F.col("member.component") != F.col("hub.component"))
            .where(_in_reach(percent, "hub", "member"))
            .select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
            .distinct()
            .join(met, ["a", "b"], "left_anti")
        )
        stars = stored(stars, "stars")
        links = links.union(verified(stars, documents, classes, size, percent))
        met = met.union(stars)
        del hubs
        forget(members)

    # Members of different components, all of them.
    members = stored(_open_lists(shared, links), "open")
    small = members.where(F.col("size") <= SMALL_LIST).select(
        "token", F.struct("n", "rep", "place", "component").alias("x")
    )
    near = (
        small.join(small.withColumnRenamed("x", "y"), "token")
        .where("x.rep < y.rep AND x.component <> y.component")
        .where(_in_reach(percent, "x", "y"))
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    )
    long = members.where(F.col("size") > SMALL_LIST).join(classes.select("rep", "cells"), "rep")
    pairs = near.union(_far_members(long, percent)).distinct().join(met, ["a", "b"], "left_anti")
    pairs = stored(pairs, "pairs")
    del small, near, long, met
    forget(members, shared)
    links = links.union(verified(pairs, documents, classes, size, percent))
    forget(pairs)
    labels = components(links).select(F.col("id").alias("rep"), "component")
    grouped = classes.join(labels, "rep", "left").select(
        "n", "sig", F.coalesce("component", "rep").alias("component_id")
    )
    return (
        per_document.join(grouped, ["n", "sig"], "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")),
        )
        .toDF("doc_id", "n_shingles", "component_id")
        .withColumn(
            "component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
        )
    )
