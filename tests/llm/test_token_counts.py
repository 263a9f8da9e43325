import collections

from newsloom.llm import queries
from newsloom.llm.tables import new_folder
from newsloom.llm.token_counts import Rollup, changes, counted, estimated, later_copies
from newsloom.llm.tokens import Encoder, default_path

SCHEMA = "op string, doc_id bigint, source string, lang string, tokenizer string, tokens bigint, seq int"


def test_batches(spark):
    rollup = Rollup(spark, new_folder(spark, "rollup"))

    def apply(name, *rows):
        return rollup.apply(name, spark.createDataFrame(rows, SCHEMA))

    def totals():
        return {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}

    assert totals() == {}
    assert apply(
        "a",
        ("insert", 1, "s", "en", "v1", 10, 0), ("insert", 2, "s", "en", "v1", 5, 0),
        ("insert", 3, None, "de", "v1", None, 0), ("insert", None, "s", "en", "v1", 1, 0),
    )
    assert totals() == {("s", "en", "v1"): (3, 16), (None, "de", "v1"): (1, 0)}
    assert not apply("a", ("insert", 9, "s", "en", "v1", 99, 0))
    # A revision moves counts between groups; of two changes the later one counts.
    assert apply(
        "b",
        ("revise", 1, "t", "en", "v1", 12, 0), ("delete", 2, None, None, "v1", 0, 1),
        ("revise", 2, "s", "en", "v1", 7, 0), ("delete", 77, "s", "en", "v1", 0, 0),
        ("insert", 1, "s", "en", "v2", 3, 0), ("revise", 3, None, "de", "v1", 4, 0),
    )
    assert totals() == {
        ("s", "en", "v1"): (1, 1), ("t", "en", "v1"): (1, 12), ("s", "en", "v2"): (1, 3),
        (None, "de", "v1"): (1, 4),
    }
    rollup = Rollup(spark, rollup.folder)  # the state is in the folder
    assert apply("c", ("delete", None, "s", "en", "v1", 0, 0))
    assert ("s", "en", "v1") not in totals()
    assert rollup.apply("d", spark.createDataFrame([], SCHEMA))
    assert len(totals()) == 3


def test_a_batch_without_commit_is_not_seen(spark):
    rollup = Rollup(spark, new_folder(spark, "rollup"))
    lost = spark.createDataFrame([(1, "s", "en", "v1", 1, 10)], "doc_id bigint, source string, lang string, tokenizer string, docs bigint, tokens bigint")
    lost.write.parquet(f"{rollup.folder}/counts-lost/signed")
    rows = spark.createDataFrame([("insert", 1, "s", "en", "v1", 10, 0)], SCHEMA)
    assert rollup.apply("a", rows)
    assert tuple(rollup.totals().first()) == ("s", "en", "v1", 1, 10)


def all_rows(spark, documents):
    """The fixture's rows, a text under a second text's id, and equal rows without an id."""
    more = [(3, "another text", "fr", "src9", 0), (None, "no id", "fr", "src9", 0)] + [
        (None, "no id", "fr", "src9", 0)
    ] * 4
    base = documents.select("doc_id", "text", "lang", "source", "n_chars")
    return base.union(spark.createDataFrame(more, base.schema))


def test_totals_over_all_rows(spark, documents):
    """Totals after each step against plain Python over all rows, null and repeated ids included."""
    encoder = Encoder.at(default_path())
    table = all_rows(spark, documents)
    rows = [tuple(r) for r in table.collect()]
    rollup = Rollup(spark, new_folder(spark, "rollup"))

    def totals():
        return {tuple(r)[:2]: (r["docs"], r["tokens"]) for r in rollup.totals().collect()}

    def expected(rows, measure):
        out = collections.Counter(), collections.Counter()
        for _, text, lang, source, _ in rows:
            out[0][source, lang] += 1
            out[1][source, lang] += measure(text or "")
        return {k: (n, out[1][k]) for k, n in out[0].items()}

    rollup.apply("load", changes(estimated(table), "insert", "v"))
    assert totals() == expected(rows, lambda text: -(-len(text.encode()) // 4))
    exact = changes(counted(table, default_path()), "revise", "v")
    assert rollup.apply("count", exact) and not rollup.apply("count", exact)
    assert totals() == expected(rows, lambda text: len(encoder.ids(text)))
    rollup.apply("copies", later_copies(table, "v"))
    firsts = {}
    for row in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        firsts.setdefault(row[1] or "", row)
    assert totals() == expected(firsts.values(), lambda text: len(encoder.ids(text)))


def test_query_equals_plain_python(spark):
    folder = "/root/testdata/sf0.001"
    encoder = Encoder.at(default_path())
    firsts = {}
    for row in sorted(spark.read.parquet(f"{folder}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        firsts.setdefault(row["text"] or "", row)
    want = collections.Counter()
    for text, row in firsts.items():
        want[row["source"], row["lang"], "docs"] += 1
        want[row["source"], row["lang"], "tokens"] += len(encoder.ids(text))
    got = {}
    for row in queries.op3_token_counts(spark, folder).collect():
        for name in ("docs", "tokens"):
            got[row["source"], row["lang"], name] = row[name]
    assert got == dict(want)


def test_empty_table(spark, nothing):
    rollup = Rollup(spark, new_folder(spark, "rollup"))
    assert rollup.apply("a", changes(counted(nothing, default_path()), "insert", "v"))
    assert rollup.apply("b", later_copies(nothing, "v"))
    assert rollup.totals().count() == 0
