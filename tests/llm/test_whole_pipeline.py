"""Null doc_id, null item_id and repeated rows in the stages of the pipeline."""

from tracewright.llm import decontaminate, near_join, pii

SCHEMA = "doc_id long, text string, row string"
PASSAGE = "one two three four five six seven eight nine ten"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_redact_null_and_repeated(spark):
    docs = spark.createDataFrame([(None, "mail a@b.org now", "x"), (1, "mail c@d.org", "y"), (1, "mail c@d.org", "y"), (1, "other text", None), (None, None, "z")], SCHEMA)
    assert rows(pii.redact(docs)) == sorted([(None, "mail [email] now", "x"), (1, "mail [email]", "y"), (1, "mail [email]", "y"), (1, "other text", None), (None, None, "z")], key=repr)


def test_contamination_is_judged_by_row(spark):
    docs = spark.createDataFrame([(None, f"so {PASSAGE} end", "x"), (None, "clean", "x"), (1, PASSAGE, "y"), (1, "clean too", "y"), (None, None, None)], SCHEMA)
    for item in (7, None):
        items = spark.createDataFrame([(item, PASSAGE)], "item_id long, text string")
        assert rows(decontaminate.remove_documents(docs, items)) == sorted([(None, "clean", "x"), (1, "clean too", "y"), (None, None, None)], key=repr)
        assert sorted(r["contaminated"] for r in decontaminate.contamination(docs, items).collect()) == [False, False, False, True, True]
        assert (None, "so end", "x") in rows(decontaminate.remove_spans(docs, items))


def test_one_row_of_each_group(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = spark.createDataFrame([(5, a, "x"), (3, a + " more", "x"), (3, a + " more", "x"), (None, a, "x"), (None, b, "x"), (None, b, "x"), (9, c, "x"), (9, b + " " + c, "x"), (None, None, "x"), (None, None, "x")], SCHEMA).repartition(3)
    assert rows(near_join.keep_one(docs)) == sorted([(3, a + " more", "x"), (None, b, "x"), (9, c, "x"), (9, b + " " + c, "x"), (None, None, "x"), (None, None, "x")], key=repr)
