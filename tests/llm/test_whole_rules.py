"""Boilerplate lines are removed, and the verdict is on what is left."""

from tests.llm.conftest import rows_of
from tracewright.llm import rules


def prose(i, n=30):
    """n words of their own; digits would be normalised."""
    return " ".join("".join(chr(97 + int(c)) for c in str(1000 * i + j)) for j in range(n))


def test_planted_menu_line_is_removed(spark):
    menu = "Home | News 12 | Contact us"
    rows = [(i, f"{prose(i)}\n\n{menu.upper()}\n{prose(i + 50)}\n  home | news 7 |  contact us ", "a") for i in range(12)]
    rows += [(100, f"{menu}\n{prose(200, 60)}", "b"), (101, None, "a"), (102, "", "a"), (103, f"{prose(300, 60)}\n{menu}", None)]
    rows += [(104, f"{menu}\n" * 8 + prose(400, 52), "a"), (105, f"{menu}\n" * 2 + prose(500, 45), "a"), (0, rows[0][1], "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = rules.quality_rules(df, least=10)
    assert found.count() == len(rows)
    got = rows_of(found, "kept", "n_boilerplate_words", "text")
    for i in range(12):
        assert got[i] == (True, 14, f"{prose(i)}\n\n{prose(i + 50)}")
    assert got[100] == (True, 0, f"{menu}\n{prose(200, 60)}") and got[103] == (True, 0, f"{prose(300, 60)}\n{menu}")
    assert got[101] == (False, 0, None) and got[102] == (False, 0, "")
    # half of the words are gone; under 50 are left
    assert not got[104][0] and got[104][2] == prose(400, 52) and not got[105][0] and got[105][2] == prose(500, 45)


def test_limit_is_the_same_in_a_large_host(spark):
    menu = " ".join(f"menu{chr(97 + j)}" for j in range(40))
    rows = [(i, f"{prose(i)}\n{menu}", host) for host, first in (("large", 0), ("small", 20)) for i in range(first, first + 10)]
    rows += [(1000 + i, f"{prose(100 + i, 1)} alone", "large") for i in range(2_500)]
    got = rows_of(rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")), "kept", "n_boilerplate_words")
    assert {got[i] for i in range(30) if i in got} == {(False, 40)} and got[1000] == (False, 0)
