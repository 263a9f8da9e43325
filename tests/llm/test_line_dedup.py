from brute import WORD, lines_gone
from newsloom.llm import line_dedup, queries, tables


def test_equals_brute_force(documents, texts):
    rows = line_dedup.remove_lines(documents).collect()
    assert len(rows) == len(texts) + 3
    # A null id comes first; a row equal in id and text is the same document.
    order = [(None, texts[1])] + list(enumerate(texts))
    gone = dict(zip([k for k, _ in order], lines_gone(order), strict=True))
    for row in rows:
        document = row["document"]
        want = gone[document["doc_id"]] if document["text"] is not None else []
        assert row["removed_lines"] == want
        if document["text"] is not None:
            lines = document["text"].split("\n")
            kept = "\n".join(x for k, x in enumerate(lines) if k not in want)
            assert row["kept_text"] == kept
        else:
            assert row["kept_text"] is None
        assert document["sig"] == 2 and document["kept"] == 9


def test_callers_columns_stay(spark):
    line = "one two three four five six"
    rows = [(1, f"{line}\n{line}", "mine", "x"), (2, "c", "too", "y")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, kept_text string, removed_lines string")
    got = {r["document"]["doc_id"]: r for r in line_dedup.remove_lines(table).collect()}
    assert got[1]["document"]["kept_text"] == "mine" and got[1]["document"]["removed_lines"] == "x"
    assert got[1]["kept_text"] == line and got[1]["removed_lines"] == [1]


def test_lists_in_parts(documents, monkeypatch):
    usual = sorted(line_dedup.repeated_lines(documents).collect())
    monkeypatch.setattr(line_dedup, "LIST_PART", 1)
    assert sorted(line_dedup.repeated_lines(documents).collect()) == usual


def test_no_python_in_the_plan(documents):
    plan = line_dedup.digest(line_dedup.remove_lines(documents))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(nothing):
    assert line_dedup.remove_lines(nothing).count() == 0


def test_short_lines_go(spark):
    """Brute force of its own: a line of fewer than five words has one token, all of its words."""
    long = "one two three four five six"
    rows = [
        (1, f"Share this\n{long}\n\nshare  THIS"),
        (2, f"a\nshare this story\n{long}\nshare this"),
        (3, "A\nb\n \none two three four"),
        (4, "one two three four\none two three four five\nthis share"),
        (5, "ab\na b\nb\none two three four five"),
    ]
    seen, want = set(), {}
    for k, text in rows:
        want[k] = []
        for n, line in enumerate(text.split("\n")):
            words = tuple(line.lower().split())
            if words and words in seen:
                want[k].append(n)
            seen.add(words)
    assert sum(map(len, want.values())) == 7
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = line_dedup.remove_lines(documents, short=True).collect()
    assert {r["document"]["doc_id"]: r["removed_lines"] for r in got} == want


def test_query_removes_short_lines(spark):
    folder = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    seen, equal = set(), set()
    for k in sorted(texts):
        for n, line in enumerate((texts[k] or "").split("\n")):
            words = tuple(WORD.findall(line.lower()))
            if 0 < len(words) < 5:
                if words in seen:
                    equal.add((k, n))
                seen.add(words)
    got = set()
    for row in queries.op10_line_dedup(spark, folder).collect():
        lines = (texts[row["doc_id"]] or "").split("\n")
        for n in map(int, filter(None, row["removed_lines"].split(","))):
            if len(WORD.findall(lines[n])) < 5:
                got.add((row["doc_id"], n))
    assert got == equal and equal


def test_pairs_without_enough_common_tokens_are_not_compared(spark, monkeypatch):
    """With one bucket the order is that of the hashes, so that common tokens come first, too."""
    pairs = []

    def counted(table, name):
        out = tables.stored(table, name)
        if name == "line-pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "BUCKETS", 1)
    monkeypatch.setattr(line_dedup, "stored", counted)
    rest = [" ".join(f"w{k}x{n}" for n in range(30)) for k in range(30)]
    rows = [(k, f"a b c d e f g h i j k l m n {words}") for k, words in enumerate(rest)]
    rows.append((99, rows[0][1] + " more"))
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    removed = line_dedup.remove_lines(documents).where("size(removed_lines) > 0").collect()
    assert [r["document"]["doc_id"] for r in removed] == [99]
    assert sum(pairs) == 1


def test_tokens_a_little_more_frequent_come_later(spark, monkeypatch):
    """Two buckets of about 200 tokens; one token occurs 45 times more, less than four deviations."""
    monkeypatch.setattr(line_dedup, "BUCKETS", 2)
    rows = [(k, f"a{k} b{k} c{k} d{k} e{k}") for k in range(400)]
    rows += [(400 + k, "one two\tthree  FOUR five") for k in range(45)]
    keyed = line_dedup._keyed(spark.createDataFrame(rows, "doc_id bigint, text string"))
    ranks, _ = line_dedup._order(keyed)
    assert len(set(spark.range(1).select(ranks.alias("ranks")).first()["ranks"])) == 2


def test_lines_of_blanks_are_split_without_a_pattern(spark):
    lines = ["a  b c", " A b\tc ", "a\x0bb\x0c c\r", "", "  ", "a\u00a0b c"]
    frame = spark.createDataFrame([(k, 0, k, x) for k, x in enumerate(lines)], f"doc_id int, {line_dedup.KEY} int, line_no int, line string")
    words = line_dedup._words(frame, 0)
    got = {r["doc_id"]: r["words"] for r in words.collect()}
    assert got == {k: WORD.findall(x.lower()) for k, x in enumerate(lines)}
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert "split(lower(line" in plan and "RLIKE" in plan
