"""Near-duplicate lines over a whole corpus, in DataFrame functions alone.

An exact set-similarity join. A line's tokens are its distinct runs of SHINGLE words, lower-cased.
They are ordered by rarity over all lines of all documents; two lines of Jaccard similarity of at
least PERCENT share a token of their prefixes. Prefix tokens are joined under length and
positional filters, and candidates are verified on the whole token sets. A line goes if an
earlier line (by document id, then line number) is similar to it or equal.

Rarity is counted per bucket of a table of fixed size (BUCKETS), which fits a plan; any order is
right as long as it is the same everywhere, and the tokens that many lines share stand out.

Groups. Equal lines form one class, of which the first line stands for all. To remove a line, one
similar earlier line is enough: each member of a list meets the list's first line only, and those
left over then meet the earlier members. All pairs of a group are never written.

Short lines. With ``short``, a line of fewer than SHINGLE words has one token, its whole word
sequence; it is similar to the lines of equal words alone, so it needs its class, no join.

Defined cases: without ``short``, lines of fewer than SHINGLE words stay; lines without words and
line ends always do; a null text stays null; rows equal in id and text are one document, and each
gets its result; null ids come first; a document travels as one value, so no name of its columns
can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.tables import bucket_of, forget, forget_shuffles, stored

SHINGLE = 5
PERCENT = 80
BUCKETS = 1 << 16
# A list that may be longer than this is read in parts of about this size.
LIST_PART = 100_000
TOKEN_BITS = 56

KEY = "_line_key"
SPACE = "[\\x20\\x09-\\x0D]+"
OTHER_SPACE = "[\\x09-\\x0D]"


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias(KEY))


def _lines(keyed: DataFrame) -> DataFrame:
    return keyed.select("doc_id", KEY, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _words(lines: DataFrame, least: int = SHINGLE) -> DataFrame:
    """Lines of ``least`` words or more with their words; exploding an array of one keeps the
    optimizer from splitting every line twice. Most lines have no white space but blanks and are
    split without a pattern."""
    line = F.lower("line")
    plain = F.when(line.rlike(OTHER_SPACE), F.split(line, SPACE)).otherwise(F.split(line, " "))
    words = F.array_remove(plain, "")
    return lines.select("doc_id", KEY, "line_no", F.explode(F.array(words)).alias("words")).where(
        F.size("words") >= least
    )


def _grams(words: DataFrame) -> DataFrame:
    """doc_id, key, line_no, short, grams: the token of each run of words, or the one of all words
    of a line that is too short for a run; distinct ones, in the order of their hashes.

    Words are laid beside those that follow them, so that a run is hashed by one call."""
    n = F.size("words")
    runs = F.arrays_zip(*(F.slice("words", k + 1, n - SHINGLE + 1).alias(f"w{k}") for k in range(SHINGLE)))
    grams = F.when(n < SHINGLE, F.array(F.xxhash64("words"))).otherwise(
        F.transform(runs, lambda run: F.xxhash64(run))
    )
    return words.select(
        "doc_id", KEY, "line_no", (n < SHINGLE).alias("short"),
        F.sort_array(F.array_distinct(grams)).alias("grams"),
    )


def _tokens(words: DataFrame) -> DataFrame:
    """The same tokens, one a row, in compiled code."""
    place = words.select("words", F.explode(F.sequence(F.lit(0), F.size("words") - SHINGLE)).alias("i"))
    run = [F.col("words")[F.col("i") + k] for k in range(SHINGLE)]
    return place.select(F.xxhash64(*run).alias("token"))


def _number(token: Column) -> Column:
    """The upper bits of a token's hash, from 0, in the order of the hashes."""
    return F.shiftright(token, 64 - TOKEN_BITS) + F.lit(1 << (TOKEN_BITS - 1))


def _bucket(number: Column) -> Column:
    return F.pmod(number, F.lit(BUCKETS)).cast("int")


def _order(keyed: DataFrame) -> tuple[Column, Column]:
    """Rank of each bucket, and parts its lists are read in, as constant arrays: the more often
    its tokens occur beyond what an average bucket holds and usually varies by, the later."""
    counts = (
        _tokens(_words(_lines(keyed)))
        .groupBy(_bucket(_number(F.col("token"))).alias("bucket"))
        .count()
        .collect()  # BUCKETS rows at most
    )
    usual = sum(row["count"] for row in counts) / BUCKETS
    ranks, parts = [0] * BUCKETS, [1] * BUCKETS
    for row in counts:
        excess = max(0, int(row["count"] - usual - usual**0.5))
        ranks[row["bucket"]] = min(4 * (excess + 1).bit_length() - 4, 127)
        parts[row["bucket"]] = 1 + excess // LIST_PART

    def constant(values: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")

    return constant(ranks), constant(parts)


def _prefixes(grams: DataFrame, ranks: Column, percent: int) -> DataFrame:
    """Lines with the size and hash of their token set and its prefix, rarest first.

    Most tokens have rank 0. Where enough of the lowest hashes have, they are the prefix, and no
    other token needs its rank."""

    def ranked(token: Column) -> Column:
        number = _number(token)
        rank = F.coalesce(ranks[_bucket(number)], F.lit(0)).cast("bigint")
        return F.shiftleft(rank, TOKEN_BITS).bitwiseOR(number)

    sets = grams.withColumn("n", F.size("grams")).withColumn(
        "length", (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    )
    head = F.sort_array(F.transform(F.slice("grams", F.lit(1), F.col("length") + 4), ranked))
    sets = sets.select("*", F.explode(F.array(F.when(~F.col("short"), head))).alias("head"))
    every = F.sort_array(F.transform("grams", ranked))
    common = F.element_at("head", F.least("length", "n")) >= F.lit(1 << TOKEN_BITS)
    prefix = F.slice(F.when(common, every).otherwise(F.col("head")), F.lit(1), F.col("length"))
    # Short lines are equal or not similar: nothing to join.
    prefix = F.when(F.col("short"), F.array().cast("array<bigint>")).otherwise(prefix)
    return sets.select(
        "doc_id", KEY, "line_no", "n", F.xxhash64("grams").alias("sig"), prefix.alias("prefix")
    )


def _in_reach(percent: int, a: str, b: str) -> Column:
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(n_a - F.col(f"{a}.place"), n_b - F.col(f"{b}.place"))
    return (percent * F.greatest(n_a, n_b) <= 100 * F.least(n_a, n_b)) & (
        (100 + percent) * left >= percent * (n_a + n_b)
    )


def _in_length(percent: int) -> Column:
    return percent * F.greatest("x.n", "y.n") <= 100 * F.least("x.n", "y.n")


def _enough(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that may be similar, from ``met``: the earlier line ``y`` and the
    later ``x`` for every prefix token that they share.

    Of the set whose prefix ends first, tokens of the prefix that are common stand in the other
    prefix too, so that the others can only be beyond its end."""
    ends = [F.struct(*(F.col(f"{side}.{c}") for c in ("sig", "at", "n", "edge"))) for side in "yx"]
    pairs = met.select(ends[0].alias("y"), ends[1].alias("x")).groupBy("y", "x").count()

    def rest(side: str) -> Column:
        return F.ceil(F.col(f"{side}.n") * percent / 100).cast("int") - 1

    beyond = F.when(F.col("x.edge") <= F.col("y.edge"), rest("x")).otherwise(rest("y"))
    most = F.col("count") + beyond
    return pairs.where((100 + percent) * most >= percent * (F.col("x.n") + F.col("y.n"))).select(
        *(F.struct(f"{side}.sig", f"{side}.at.{KEY}", f"{side}.at.line_no").alias(end) for side, end in ("ya", "xb"))
    )


def _similar(pairs: DataFrame, keyed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose sets reach the similarity, stored: b with its first line."""
    pairs = stored(pairs, "line-pairs")
    wanted = pairs.select("a.*").union(pairs.select("b.*")).distinct()
    place = F.xxhash64(KEY, "line_no")
    buckets = wanted.select(bucket_of(place).alias("_bucket")).distinct()
    lines = _lines(keyed).withColumn("_bucket", bucket_of(place))
    lines = lines.join(F.broadcast(buckets), "_bucket", "left_semi")
    lines = lines.join(wanted.select(KEY, "line_no"), [KEY, "line_no"], "left_semi")
    sets = (
        _grams(_words(lines.select("doc_id", KEY, "line_no", "line").dropDuplicates([KEY, "line_no"])))
        .select(F.xxhash64("grams").alias("sig"), "grams")
    )
    sets = stored(sets, "line-sets")
    both = pairs.join(
        sets.select(F.col("sig").alias("_a"), F.col("grams").alias("x")), F.col("a.sig") == F.col("_a")
    ).join(sets.select(F.col("sig").alias("_b"), F.col("grams").alias("y")), F.col("b.sig") == F.col("_b"))
    common = F.size(F.array_intersect("x", "y"))
    enough = (100 + percent) * common >= percent * (F.size("x") + F.size("y"))
    links = stored(both.where(enough).select("a.sig", "b"), "line-links")
    del both
    forget(pairs, sets)
    return links


def repeated_lines(
    documents: DataFrame, percent: int = PERCENT, short: bool = False
) -> DataFrame:
    """(key, line_no) of every line that an earlier line makes superfluous, stored; the key is the
    hash of id and text. ``short`` takes in the lines of fewer than SHINGLE words."""
    keyed = _keyed(documents)
    ranks, parts = _order(keyed)
    # The first line of each class stands for it and has its prefix; equal later ones are copies.
    at = F.struct("doc_id", KEY, "line_no")
    equal = Window.partitionBy("sig").orderBy("doc_id", KEY, "line_no")
    equal = equal.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = stored(
        _prefixes(_grams(_words(_lines(keyed), 1 if short else SHINGLE)), ranks, percent)
        .withColumn("copy", F.first(at).over(equal) != at)
        .withColumn("leads", F.row_number().over(equal) == 1)
        .withColumn("prefix", F.when(F.col("leads"), F.col("prefix"))),
        "lines",
    )
    forget_shuffles(lines.sparkSession)
    firsts = lines.where("leads").select("sig", at.alias("at"), F.try_element_at("prefix", F.lit(-1)).alias("edge"))

    # Prefix tokens that two classes share: in the order of tokens their postings are neighbours.
    bucket = _bucket(F.col("token").bitwiseAND(F.lit((1 << TOKEN_BITS) - 1)))
    lists = Window.partitionBy("bucket", "part").orderBy("token")
    near = F.lag("token").over(lists), F.lead("token").over(lists)
    shared = (
        lines.where("leads")
        .select("n", "sig", F.posexplode("prefix").alias("place", "token"))
        .withColumn("bucket", bucket)
        .withColumn("parts", parts[F.col("bucket")])
        .withColumn("part", F.pmod("sig", F.col("parts")))
        .withColumns({"before": near[0], "after": near[1]})
        .where("token = before OR token = after OR parts > 1")
        .select("token", "sig", "n", "place")
        .join(firsts, "sig")
    )
    shared = stored(
        shared.select("token", F.struct("at", "sig", "n", "place", "edge").alias("x")), "shared"
    )
    forget_shuffles(lines.sparkSession)

    # Each member of a list with the list's first line.
    hubs = shared.groupBy("token").agg(F.min("x").alias("hub"))
    stars = (
        shared.join(hubs, "token")
        .where("x.sig <> hub.sig")
        .where(_in_reach(percent, "hub", "x"))
        .select(F.col("hub.sig").alias("a"), F.col("x.sig").alias("b"))
        .distinct()
    )
    stars = stored(stars, "line-stars")
    # All their common tokens, also those of lists with another first line.
    postings = shared.select("token", F.col("x.sig").alias("b"), "x")
    met = (
        stars.join(shared.select(F.col("x.sig").alias("a"), "token", F.col("x").alias("y")), "a")
        .join(postings, ["token", "b"])
    )
    links = _similar(_enough(met, percent), keyed, percent)
    found = links.select("b.*")

    # Those left over with all earlier members.
    left = postings.join(found.select(F.col("sig").alias("b")).distinct(), "b", "left_anti")
    met = (
        left.join(shared.withColumnRenamed("x", "y"), "token")
        .where("y.at < x.at AND y.sig <> x.sig")
        .where(_in_length(percent))
    )
    # Pairs of stars have been compared.
    pairs = (
        _enough(met, percent)
        .withColumns({"_a": F.col("a.sig"), "_b": F.col("b.sig")})
        .join(stars.toDF("_a", "_b"), ["_a", "_b"], "left_anti")
        .select("a", "b")
    )
    more = _similar(pairs, keyed, percent)
    del pairs, left, met, postings
    forget(shared, stars)
    found = found.union(more.select("b.*")).select(KEY, "line_no").distinct()
    gone = stored(lines.where("copy").select(KEY, "line_no").union(found), "gone-lines")
    forget(lines, links, more)
    return gone


def remove_lines(documents: DataFrame, percent: int = PERCENT, short: bool = False) -> DataFrame:
    """The documents as ``document``, with ``kept_text`` without the superfluous lines, and
    ``removed_lines``, their numbers in order (an empty array where nothing goes)."""
    gone = repeated_lines(documents, percent, short)
    by_text = gone.groupBy(KEY).agg(F.array_sort(F.collect_set("line_no")).alias("removed_lines"))
    buckets = gone.select(bucket_of(F.col(KEY)).alias("_bucket")).distinct()
    key = F.xxhash64("doc_id", "text")
    keyed = documents.select(
        F.struct("*").alias("document"), key.alias(KEY), bucket_of(key).alias("_bucket")
    )
    kept = F.array_join(
        F.filter(
            F.split("document.text", "\n"),
            lambda line, i: ~F.array_contains(F.col("removed_lines"), i),
        ),
        "\n",
    )
    none = F.array().cast("array<int>")
    touched = keyed.join(F.broadcast(buckets), "_bucket", "left_semi").join(by_text, KEY, "left")
    touched = touched.select(
        "document",
        F.when(F.col("removed_lines").isNull(), F.col("document.text")).otherwise(kept).alias("kept_text"),
        F.coalesce("removed_lines", none).alias("removed_lines"),
    )
    clean = keyed.join(F.broadcast(buckets), "_bucket", "left_anti").select(
        "document", F.col("document.text").alias("kept_text"), none.alias("removed_lines")
    )
    return touched.union(clean)


def digest(removed: DataFrame) -> DataFrame:
    """Per document: its number of lines, the numbers of those removed, a hash of what is left."""
    text = F.col("document.text")
    lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n")))
    return removed.select(
        "document.doc_id",
        lines.cast("bigint").alias("n_lines"),
        F.size("removed_lines").cast("bigint").alias("n_removed"),
        F.array_join("removed_lines", ",").alias("removed_lines"),
        F.md5(F.coalesce("kept_text", F.lit(""))).alias("kept_md5"),
    )
