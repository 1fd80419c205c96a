from linkwright.llm import decontaminate


def test_marked_passages_are_cut_out_of_texts(spark):
    item = " ".join(f"item{i}" for i in range(15))
    filler = " ".join(f"word{i}" for i in range(400))
    texts = [
        None, "", "nothing, of it", f"Über é: {item.upper()}! the end.", f"{filler} ({item}) {filler}",
        f"{item}; between {item}", " ".join(item.split()[:12]),
    ]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    documents = documents.selectExpr("text", "doc_id", "doc_id as spans", "'k' as `a.b`")
    benchmark = spark.createDataFrame([(1, item)], "item_id int, text string")
    got = decontaminate.remove_spans(documents, benchmark)
    assert got.columns == documents.columns
    want = [None, "", "nothing, of it", "Über é: ! the end.", f"{filler} () {filler}", "; between ", texts[6]]
    assert sorted(tuple(r) for r in got.drop("text").collect()) == [(i, i, "k") for i in range(len(texts))]
    assert {r.doc_id: r.text for r in got.collect()} == dict(enumerate(want))
    # the long document is not contaminated as a whole and would keep its passage
    assert 4 in {r.doc_id for r in decontaminate.remove_contaminated(documents, benchmark).collect()}
