import re
import zlib

import pytest
import sentencepiece

import corpus_pipeline
import public_tokenizers
from tests.llm.test_native import base_spans, contamination
from tests.llm.test_near_join import shingles
from tests.llm.conftest import rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.staged(stage(spark, docs, SF), name)
        out.append((docs, after))
        docs = after
    return out


def test_columns_and_order(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "benchmark_decontamination", "personal_data", "sentencepiece"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns and 0 < after.count() <= before.count()
    assert stages[-1][1].count() == stages[-1][0].count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_language_keeps_texts_with_letters(stages):
    before, after = (rows_of(df, "text") for df in stages[0])
    assert set(before) - set(after) <= {d for d, (t,) in before.items() if len(re.findall(r"[^\W\d_]+", t or "")) < 5}


def test_one_document_of_each_group_stays(stages):
    before, after = (rows_of(df, "text") for df in stages[1])
    sets = {d: shingles(t, 5) for d, (t,) in sorted(before.items())}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, a in sets.items():
        for e, b in sets.items():
            if e < d and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(d), root(e)))
                parent[y] = x
    assert set(after) == {d for d in sets if root(d) == d}


def test_contaminated_documents_go(spark, stages):
    before, after = (rows_of(df, "text") for df in stages[2])
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    dirty = {d for d, x in contamination([(d, t) for d, (t,) in before.items()], items) if x[-1]}
    assert set(after) == set(before) - dirty


def test_personal_data_are_replaced(stages):
    before, after = (rows_of(df, "text", "n_chars") for df in stages[3])
    assert set(before) == set(after) and all(len(t) == n for t, n in after.values())
    for d, (text, _) in before.items():
        if base_spans(text):
            assert not base_spans(after[d][0])
        elif not re.search("token|password|AKIA", text):
            assert after[d][0] == text


def test_token_ids(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    before, after = stages[4]
    got = rows_of(after)
    for d, (text,) in rows_of(before, "text").items():
        ids = library.encode(text)
        assert got[d] == (len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)), True)


def clashing(spark, rows):
    """Rows with columns named as the operators name their own."""
    names = ["lang_pred", "score", "row", "own", "spans", "blocks", "_row", "group", "_group", "t1", "t2", "_t1", "words", "n_words", "hash", "sig1", "n", "rep", "lost", "a.b"]
    kinds = ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(*r, *(f"{n} of {r[0]}" if r[0] else None for n in names)) for r in rows], f"doc_id long, text string, lang string, n_chars long, source string, {kinds}")


def test_stages_take_odd_rows(spark):
    prose = "the quick brown fox and the lazy dog went over the hill to see what they could see and then came home "
    rows = [(1, prose * 3 + "mail a@b.org", "en", 9, "s"), (None, "der schnelle braune Fuchs und der faule Hund gehen nach Hause und " * 4, None, None, None), (2, None, None, None, "s"), (3, "", "en", 0, None), (4, "12 34", None, 5, "s"), (5, prose * 3 + "mail a@b.org", "en", 9, "s"), (5, prose * 3 + "mail a@b.org", "en", 9, "s"), (6, "x" * 70_000, None, 1, "s")]
    docs = clashing(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        for part in (docs, docs.where("false"), docs.where("doc_id in (1, 2, 3)")):
            after = stage(spark, part, SF)
            found = after.collect()
            assert len(found) <= part.count()
            if name == "sentencepiece":
                assert sum(r["returns"] for r in found) == len(found) == part.count()
                continue
            assert after.columns == docs.columns and [t for _, t in after.dtypes] == [t for _, t in docs.dtypes]
            assert all(r["own"] == (f"own of {r['doc_id']}" if r["doc_id"] else None) and r["score"] == (f"score of {r['doc_id']}" if r["doc_id"] else None) for r in found)
            if part is not docs:
                assert name == "language_id" or len(found) == part.count()
            elif name == "near_duplicates":
                assert sorted(r["doc_id"] or 0 for r in found) == [0, 1, 2, 3, 4, 6]
            elif name == "benchmark_decontamination":
                assert len(found) == len(rows)
            elif name == "personal_data":
                texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in found}
                assert len(found) == len(rows) and texts[5] == (prose * 3 + "mail [email]", len(prose) * 3 + 12) and texts[2] == (None, None)
            elif name == "language_id":
                assert {2, 3, 4}.isdisjoint({r["doc_id"] for r in found})


def test_stages_start_by_giving_heap_back(spark):
    collectors = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if re.search("Old|MarkSweep", b.getName()))
    before = collectors()
    stages = dict(corpus_pipeline.STAGES)
    assert stages["personal_data"](spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0
    assert collectors() > before
