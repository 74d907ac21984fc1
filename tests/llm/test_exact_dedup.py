from envspark.llm.exact_dedup import drop_exact, exact_groups


def test_largest_and_smallest_stay(odd_docs):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(odd_docs, keep="largest").collect()}
    assert {(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 4, 2, False), (4, 4, 2, True), (6, 6, 1, True), (7, 7, 1, True), (8, 8, 2, True)} <= got
    assert (1, 1, 3, True) in {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(odd_docs).collect()}


def test_rows_that_stay_keep_all_columns(odd_docs, clashing):
    docs = clashing(odd_docs)
    got = drop_exact(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 5, 6, 7, 8, 9]


def test_null_ids_alone_stay(make_docs):
    assert [r.text for r in drop_exact(make_docs([(None, "a"), (None, "A")])).collect()] in (["a"], ["A"])
