"""Benchmark items that a document holds in part, with few literal words, or with equal numbers changed apart."""

from trialspark.llm import decontam

FILLER = "some quiet words stand here before and after it all "


def found(spark, docs: dict[int, str], items: dict[int, str]) -> set[tuple]:
    d = spark.createDataFrame([(k, FILLER + v + " " + FILLER) for k, v in docs.items()], "doc_id long, text string")
    i = spark.createDataFrame(list(items.items()), "item_id long, text string")
    return {(r.doc_id, r.item_id, r.kind) for r in decontam.contaminated(d, i).collect()}


SHORT = "the old river carries cold water down toward green fields where farmers plant their wheat"
LONG = " ".join(f"{a}{b}" for a in ("mor", "tal", "ven", "sig", "pol") for b in ("ane", "ist", "orm", "ude", "eck", "all", "ibe", "unt"))


def test_one_changed_word_and_long_quotes(spark):
    w, long = SHORT.split(), LONG.split()
    docs = {1: SHORT.replace("toward", "beside"), 2: SHORT.replace("green", "yellow"), 3: " ".join(long[5:19]), 4: " ".join(long[5:15]),
            5: " ".join(w[:6]), 6: " ".join([*w[3:8], "and", *w[10:]])}
    assert len(w) == 15
    assert {x[:2] for x in found(spark, docs, {7: SHORT, 8: LONG})} == {(1, 7), (2, 7), (3, 8)}


def test_items_with_few_literal_words_are_found_as_exact_copies(spark):
    items = {1: "What is 12 * 7 + 30 / 5 ?", 2: "12 kg 7 kg 30 kg 5 kg 9 kg 4 kg 8"}
    docs = {1: "what is 12 * 7 + 30 / 5 ?", 2: "What is 13 * 7 + 30 / 5 ?", 3: items[2], 4: items[2].replace("30", "31")}
    assert found(spark, docs, items) == {(1, 1, "verbatim"), (3, 2, "verbatim")}


EQUAL = "a boy picks 2 apples from the garden tree and then rests under its shade for 2 hours before going home"


def test_equal_numbers_changed_apart(spark):
    docs = {1: EQUAL.replace("2 hours", "3 hours"), 2: EQUAL.replace("2 apples", "3 apples").replace("2 hours", "5 hours"), 3: EQUAL.replace("2", "4")}
    assert {x[:2] for x in found(spark, docs, {9: EQUAL})} == {(1, 9), (2, 9), (3, 9)}


def test_rarer_mappings_lose_only_their_windows():
    held = decontam.occurrence([(0, 8, [("2", "2")]), (1, 8, [("2", "3")]), (2, 8, [("2", "3")]), (3, 8, [("2", "4"), ("7", "7")])])
    assert sorted(held) == [(0, 8, False), (1, 8, True), (2, 8, True)]
    name = decontam.NAME + "anna"
    assert decontam.occurrence([(0, 8, [("2", "2")]), (1, 8, [(name, " berta")]), (2, 8, [(name, " carla")])]) == [(0, 8, False)]
