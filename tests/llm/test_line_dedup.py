from orderlens.llm.line_dedup import line_dedup
from tests.llm import brute


def run(df):
    return [tuple(r) for r in line_dedup(df).select("doc_id", "text", "n_lines", "n_dropped").collect()]


def test_against_plain_version(docs, rows):
    want = brute.line_dedup([(i, t) for i, t, *_ in rows])
    assert sorted(run(docs)) == sorted(want)
    assert sum(x[3] for x in want) > 50


def test_templates_generalise_fields(spark):
    rows = [(1, "Released under version 2.0 of the terms\nfirst of all"), (2, "own words of two\nReleased under version 3 of the terms"),
            (3, "user root logged in from the host alpha today again"), (4, "user root logged in from the host beta today again"),
            (5, "user root logged in at noon by way of another door")]
    got = {r[0]: r for r in run(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[1][3] == 0 and got[2][1] == "own words of two"  # numbers are fields from the start
    assert got[3][3] == 0 and got[4][1:] == ("", 1, 1)  # one place differs: 8 of 9 are fixed
    assert got[5][3] == 0  # too unlike


def test_odd_rows(odd, none, docs):
    got = line_dedup(odd)
    assert got.columns == [c for c in odd.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    by = {(r.doc_id, r.text): r for r in got.collect()}
    assert got.count() == odd.count()
    assert by[1000, None].n_lines == 0 and by[1001, ""].n_lines == 1 and by[1002, " \n\t\n "].n_dropped == 0
    assert all(r.n_dropped == 0 for r in by.values())
    assert line_dedup(none).count() == 0


def test_null_ids_and_repeats(spark):
    line = "the very same line of words in all"
    df = spark.createDataFrame([(None, line), (1, line), (1, line), (2, f"{line}\nown line\n\n{line}\n")], "doc_id long, text string")
    assert sorted(run(df), key=str) == sorted([(None, line, 1, 0), (1, line, 1, 0), (1, line, 1, 0), (2, "own line\n\n", 5, 2)], key=str)


def test_short_lines(spark):
    """Recurring lines of one or two tokens go too, long ones without white space among them; blank ones stay."""
    passage = "\u6f22\u5b57\u4eee\u540d" * 50
    rows = [(1, f"Les.\nAnd ornd.\n\nown"), (2, f" Les. \nAnd  ornd.\n\n{passage}"), (3, f"les.\n{passage}\n\nAnd other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(run(df)) == [(1, rows[0][1], 4, 0), (2, f"\n{passage}", 4, 2), (3, "les.\n\nAnd other", 4, 1)]


def test_rows_of_numbers(spark):
    """Rows of numbers are equal only if the numbers are; a field among enough words is still one."""
    rows = [(1, "12 45 78\n| 12 | 34 |\n7\nUp to version 2 of these terms"), (2, "99 3 41\n| 56 | 7 |\n8\nUp to version 3 of these terms"),
            (3, "12  45 78\n| 12 | 35 |\n7\nTable 1 of 2"), (4, "Table 2 of 2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(run(df)) == [(1, rows[0][1], 4, 0), (2, "99 3 41\n| 56 | 7 |\n8", 4, 1), (3, "| 12 | 35 |\nTable 1 of 2", 4, 2), (4, "Table 2 of 2", 1, 0)]
    both = [(1, "12 45 78\n100 200 300"), (2, "99 3 41\n7 8 9")]  # no number in common: nothing goes
    assert sorted(run(spark.createDataFrame(both, "doc_id long, text string"))) == [(1, both[0][1], 2, 0), (2, both[1][1], 2, 0)]


def test_copies_never_bring_a_line_back(spark):
    """A field whose values occur in several documents stays a field."""
    alpha, beta = "user root logged in from the host alpha today again", "user root logged in from the host beta today again"
    rows = [(3, alpha), (4, beta)]
    for more in ([], [(6, alpha), (7, beta)], [(6, alpha), (7, beta), (8, alpha.replace("alpha", "gamma"))]):
        got = {r[0]: r[1] for r in run(spark.createDataFrame(rows + more, "doc_id long, text string"))}
        assert got == {3: alpha, **{i: "" for i, _ in (rows + more)[1:]}}


def test_two_unlike_places_are_no_template(spark):
    rows = [(1, "one two three four five six seven"), (2, "one two three four FIVE SIX seven"), (3, "one TWO three four five six seven"),
            (4, "a b c d"), (5, "a b c e")]  # a leading token differs; four tokens are too few
    assert all(r[3] == 0 for r in run(spark.createDataFrame(rows, "doc_id long, text string")))
