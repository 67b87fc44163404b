"""Queries take all rows and whole texts, beyond what the given tables hold."""

from rollsift.plans import queries

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_text_functions_keep_every_document(spark, tmp_path):
    rows = [(1, "a", "en", "src12", 128657), (2, "", "en", "web", 0), (3, None, "en", None, None), (4, "b", "en", "src1", 80001), (5, "c", "en", "x", 59)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["short"], r["duration"], r["cut"]) for r in queries.QUERIES["s8_text_functions"](spark, str(tmp_path)).collect()}
    assert got == {1: ("128.66K", "1d 11h", "2"), 2: ("0.00", "0ms", "web"), 3: (None, None, None), 4: ("80.00K", "22h 13m", ""), 5: ("59.00", "59.00s", "x")}


def test_longest_prefix_compares_whole_texts(spark, tmp_path):
    head = "https://example.org/" + "a" * 60
    rows = [(5, f"{head}/x one", "en", "s", 0), (6, f"{head}/y one", "en", "s", 0), (7, f"{head}/x one", "en", "s", 0), (10, "short words here", "en", "s", 0)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.QUERIES["j9_longest_prefix"](spark, str(tmp_path)).collect()}
    # every document gives a prefix: 6 its own, 7 the same one as 5
    assert got == {(5, 5), (6, 6), (7, 5), (10, 10)}
