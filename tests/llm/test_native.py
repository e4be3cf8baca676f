"""Native operators against plain Python."""

import hashlib
import re
import time
from collections import Counter
from itertools import accumulate

import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import rows_of
from tracewright.llm import decontaminate, pii, rules, scans


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def base_spans(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if ok(m[0])]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


def test_pii_base(documents):
    got = {r["doc_id"]: r for r in pii.personal_data(documents).collect()}
    n = 0
    for doc_id, text in documents.select("doc_id", "text").collect():
        want, row = base_spans(text), got[doc_id]
        n += len(want)
        assert row["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (text[:300], row["spans"], want)
        assert set(want) <= set(filter(None, row["spans"].split(",")))
        for kind, *_ in PATTERNS:
            assert row[f"n_{kind}"] == sum(x.startswith(f"{kind}:") for x in want)
    assert n > 20


def test_pii_learns_and_redacts(spark, documents, empty):
    assert pii.personal_data(empty).count() == 0
    rows = [(i, f"text {i} token = \"{'ab12' * 8}\" mail me {i}@x.org end") for i in range(20)] + [(20, "clean text of no one"), (21, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(pii.personal_data(df), "spans")
    assert all("secret:" in got[i][0] and "email:" in got[i][0] for i in range(20)) and got[20] == got[21] == ("",)
    red = rows_of(pii.redact(df), "text")
    assert "[secret]" in red[3][0] and "[email] end" in red[3][0] and red[20] == ("clean text of no one",) and red[21] == (None,)


def test_pii_has_no_length_limit(spark, tmp_path):
    dump = ", ".join(str(i * 7919 % 100_000) for i in range(1_000_000))
    phones = "; ".join(f"+1 {i % 900 + 100} 555 {i % 10_000:04d}" for i in range(30_000))
    rows = [(1, f"my token = {'a1' * 150} end"), (2, "password: hunter2hunter2hunter2"), (3, "key AKIA" + "Q7" * 8 + " end"), (4, "mail " + "x" * 300 + " (at) " + "y" * 300 + " (dot) com"), (5, dump), (6, phones)]
    pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}), f"{tmp_path}/t.parquet")
    docs = spark.read.parquet(f"{tmp_path}/t.parquet")
    began = time.time()
    red, got = rows_of(pii.redact(docs), "text"), rows_of(pii.personal_data(docs), "n_phone", "n_spans")
    assert time.time() - began < 60
    assert [red[i][0] for i in range(1, 5)] == ["my [secret] end", "[secret]", "key [secret] end", "mail [email_spelled]"]
    assert red[5] == (dump,) and red[6][0] == "; ".join(["[phone]"] * 30_000) and got[6] == (30_000, 30_000)


def test_redacted_overlaps(spark):
    texts = ["😀 a.b@c.de, 4111 1111 1111 1111 ü +1 (743) 555-3824", "x" * 5000 + " 1.2.3.4 " + "é" * 700 + " a@b.org", "a@1.2.3.4 z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans, red = rows_of(pii.personal_data(df), "spans"), rows_of(pii.redact(df), "text")
    for i, text in enumerate(texts):
        out, at = "", 0
        for kind, a, b in (x.split(":") for x in spans[i][0].split(",")):
            if int(a) >= at:
                out += text[at : int(a)] + f"[{kind}]"
            at = max(at, int(b))
        assert red[i][0] == out + text[at:]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=9000))
def test_running(spark, numbers):
    df = spark.createDataFrame([(numbers,)], "x array<int>").select(scans.running(F.col("x"), lambda a, b: a + b), scans.running(F.col("x"), F.greatest))
    assert tuple(df.first()) == (list(accumulate(numbers)), list(accumulate(numbers, max)))


def test_votes_of_added_kinds(spark):
    rows = [(0, "call 415-234-9876"), (1, "order 115-034-9876"), (2, "ssn 123-45-6780"), (3, "part 000-00-0000"), (4, "such as password: changeme")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    votes = {r["doc_id"]: [(s["kind"], s["v_regex"], s["v_gazetteer"], s["v_context"]) for s in r["spans"]] for r in pii.spans_with_votes(docs).collect()}
    assert votes == {0: [("phone_local", 1, 0, 1)], 1: [("phone_local", -1, 0, -1)], 2: [("id_number", 1, 0, 1)], 3: [("id_number", -1, 0, -1)], 4: [("secret", -1, -1, 0)]}


def test_labelers_outvote(spark):
    good = [(i, f"call {400 + i % 90}-{234 + i % 700}-{1000 + i}") for i in range(200)]
    bad = [(1000 + i, f"order {100 + i % 90}-0{10 + i % 80}-{1000 + i}") for i in range(200)]
    got = rows_of(pii.personal_data(spark.createDataFrame(good + bad, "doc_id long, text string")), "n_spans")
    assert all(got[i] == (1,) for i, _ in good) and all(got[i] == (0,) for i, _ in bad)


def test_expectation_maximisation_trusts_the_better_labeler():
    counts = [("secret", 1, 1, 1, 2, 400), ("secret", -1, 1, 0, 2, 300), ("secret", -1, -1, 0, 2, 300), ("secret", 1, -1, 1, 2, 100)]
    model = pii.expectation_maximisation(counts)
    (tp, fp), (gtp, gfp) = model.accuracy["secret", "v_regex"], model.accuracy["secret", "v_gazetteer"]
    assert tp - fp > gtp - gfp
    assert model.weights["v_regex"] > 0


def contamination(docs, items, window=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    grams = {}
    for i, t in items:
        w = words(t)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            grams.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    sizes = {len(g) for g in grams}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if (own := grams.get(tuple(w[a : a + k]))) is not None:
                    hit.update(range(a, a + k))
                    found |= own
        yield d, (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))


def test_contamination(spark, documents, corpus, empty):
    benchmark = spark.read.parquet(f"{corpus}/benchmark.parquet").select("item_id", "text")
    odd = spark.createDataFrame([(900, "Éa éb"), (901, None), (902, "..."), (903, "one"), (904, "a b c d e f g h i j k l"), (905, "zz a b c d e f g h i j"), (906, "a b c d e f g h i j k l")], "item_id long, text string")
    for items in (benchmark, benchmark.unionByName(odd), odd.where("item_id in (901, 902)")):
        want = dict(contamination(documents.select("doc_id", "text").collect(), items.collect()))
        for limit in (64 << 20, 0):
            assert rows_of(decontaminate.contamination(documents, items, broadcast_bytes=limit)) == want
    assert decontaminate.contamination(empty, benchmark).count() == 0


def test_decontaminated(spark):
    docs = spark.createDataFrame([(1, "Start, one two three four five six seven eight nine ten; the End.", "x"), (2, "clean", "y"), (3, None, None)], "doc_id long, text string, at string")
    items = spark.createDataFrame([(1, "ONE two three four five six seven eight nine TEN")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.remove_documents(docs, items).collect()) == [2, 3]
    assert rows_of(decontaminate.remove_spans(docs, items), "text", "at") == {1: ("Start, the End.", "x"), 2: ("clean", "y"), 3: (None, None)}


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    inside = {j for i, w in enumerate(windows) if count[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), failed


def test_rules(documents, empty):
    got = rows_of(rules.quality_rules(documents), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {d: measures(t) for d, t in documents.select("doc_id", "text").collect()}
    assert rules.quality_rules(empty).count() == 0


def test_boilerplate(spark):
    own = lambda i: " ".join("".join(chr(97 + int(c)) for c in str(1000 * i + j)) for j in range(30))  # noqa: E731  digits would be normalised
    menu = " ".join(f"menu{j}" for j in range(40))
    rows = [(i, f"{menu}\n{menu.upper()}\n{own(i)}", "a") for i in range(12)] + [(100 + i, f"{own(i)} {own(i + 50)}\n{menu}", "b") for i in range(3)]
    rows += [(200, f"{own(200)} {own(201)}\n{menu}", "a"), (300, f"{own(300)} {own(301)}", None)]
    got = rows_of(rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), least=5), "base_failed", "kept", "n_boilerplate_words")
    assert got[3] == (False, False, 80) and got[101] == (False, True, 0) and got[200] == (False, True, 40) and got[300] == (False, True, 0)


def test_native_plans_hold_no_python(documents, spark, corpus):
    for df in (pii.personal_data(documents), rules.quality_rules(documents), decontaminate.contamination(documents, spark.read.parquet(f"{corpus}/benchmark.parquet"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|ArrowEval", plan)
    assert F is not None
