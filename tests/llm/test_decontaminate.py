import pytest

from postmill.llm import decontaminate

ITEM = (
    "Farmer Ruth sells pears at the market of Lund every spring. A basket costs 30 cents and she walks 90 miles in 3 hours to get there. "
    "How much does she earn if she sells 12 baskets and gives 4 of them to her friend Olaf for half the price?"
)
FILLER = "the weather was mild and nobody on the road had seen such a quiet morning before"


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM), (2, "Another question that has words of its own, which no document holds, about rivers and bridges in winter.")], "item_id long, text string")


@pytest.mark.parametrize(
    "change",
    [
        lambda t: t, str.lower, str.upper, str.title, lambda t: t.replace("cents", "dollars"), lambda t: t.replace("30 cents", "$30"), lambda t: t.replace("90 miles in 3 hours", "ninety miles in three hours"),
        lambda t: t.replace("Ruth", "Agnes").replace("Olaf", "Ben").replace("12", "15").replace("30", "45"), lambda t: t.replace("30 cents", "0.30 euro").upper(),
    ],
)
def test_changed_copies_are_found(spark, benchmark, change):
    docs = spark.createDataFrame([(7, f"{FILLER}. {change(ITEM)} {FILLER}"), (8, f"{FILLER}. {FILLER}"), (9, None)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.benchmark_hits(docs, benchmark).collect()} == {(7, 1)}


def test_values_that_do_not_fit_each_other_are_no_copy(spark, benchmark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 20)  # several passes over written windows of the documents
    docs = spark.createDataFrame([(7, ITEM), (8, " ".join(sorted(ITEM.split())))], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.benchmark_hits(docs, benchmark).collect()} == {(7, 1)}
