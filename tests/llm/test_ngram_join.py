import pytest

from brute import components, shingles, similar
from newsloom.llm import ngram_join


def expected(texts, size, percent):
    sets = {k: shingles(t, size) for k, t in enumerate(texts)}
    groups = components(list(sets), lambda a, b: similar(sets[a], sets[b], percent))
    return {k: (len(sets[k]), groups[k]) for k in sets}


@pytest.mark.parametrize("size, percent, small", [(4, 85, 64), (2, 60, 1)])
def test_equals_brute_force(documents, texts, size, percent, small, monkeypatch):
    # small = 1 sends every list through the blocks of long lists.
    monkeypatch.setattr(ngram_join, "SMALL_LIST", small)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rows = ngram_join.linked_components(documents, size, percent).collect()
    assert len(rows) == len(texts) + 3
    want = expected(texts, size, percent)
    for row in rows:
        if row["doc_id"] is None:
            assert row["component_id"] is None
        else:
            assert (row["n_shingles"], row["component_id"]) == want[row["doc_id"]]


def test_lists_in_parts(documents, texts, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIST_PART", 2)
    rows = ngram_join.linked_components(documents, 4, 85).where("doc_id IS NOT NULL").collect()
    want = expected(texts, 4, 85)
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in rows)


def test_empty_table(nothing):
    assert ngram_join.linked_components(nothing).count() == 0
