"""The name of a law is found wherever it stands in a document."""

from lexloom.plans import document_plans as P


def test_name_after_a_cover_and_the_earlier_of_equals(spark, tmp_path):
    cover = ["notice to readers."] * 12
    docs = [(1, [*cover, "Harbour Custody Act 1975"]), (2, ["Forest Code", *cover, "Forest Code 1999", "Water Code 1980"]), (3, [*cover * 6, "Ledger Rules 2001"]), (4, cover)]
    spark.createDataFrame([(i, "\n".join(t)) for i, t in docs], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["law_name"] for r in P.law_name_recovery(spark, str(tmp_path)).collect()}
    assert got == {1: "Harbour Custody Act 1975", 2: "Forest Code 1999", 3: "Ledger Rules 2001"}
