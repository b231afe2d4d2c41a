from convarchive.llm import decontamination as d


def slow(text, items, window=10):
    words = d.doc_words(text)
    hit, found = set(), set()
    for item_id, item in items:
        w = d.doc_words(item)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            part = w[i : i + window]
            for k in range(len(words) - len(part) + 1):
                if words[k : k + len(part)] == part:
                    hit |= set(range(k, k + len(part)))
                    found.add(str(item_id))
    return len(words), len(hit), sorted(found)


ITEMS = [(1, "a b c d e f g h i j k l"), (2, "Z-Y x"), (3, ""), (4, None), (5, "the the the the the the the the the the the the"), (6, "Z-Y x"), (2, "one more")]
DOCS = [(1, "A, b c d e f g h i j zz k l"), (2, None), (3, ""), (4, "z y X z y x"), (5, "the " * 5000), (6, "...") , (7, "one more a b c d e f g h i j k l one more"), (7, "one more"), (None, "q z y x")]


def test_against_brute_force_in_any_number_of_blocks(spark):
    docs = spark.createDataFrame([(*x, 1, "a") for x in DOCS], "doc_id long, text string, row int, words string")
    items = spark.createDataFrame([(*x, None) for x in ITEMS], "item_id long, text string, block int")
    want = sorted((str(i), *slow(t, ITEMS)) for i, t in DOCS)
    for block in (200_000, 2):
        got = d.decontaminate(docs, items, block=block).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in got) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in d.decontaminate(docs, items).collect()] == [False]
    assert d.decontaminate(docs.where("false"), items).count() == 0


def test_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, "q z y x")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "z y"), (None, "nowhere")], "item_id long, text string")
    (row,) = d.decontaminate(docs, items).collect()
    assert (row.n_hit, row["items"], row.contaminated) == (2, [], True)
