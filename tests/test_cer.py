"""Error rates of names of any script, by characters."""

from lexloom.plans import text_plans as P


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_names_of_any_script(spark, tmp_path):
    names = ["Harbour Act", "Закон о лесах", "工业审计条例", "Luật Bảo vệ", "Асt", "", None, "á Act", "😀 Act"]
    labels = ["harbour act", "Закон о лесе", "工业监督条例", "Luat Bao ve", "Act", "Акт", "", None, "á act", "😁 act"]
    spark.createDataFrame([("w", "i", n, x) for n, x in enumerate(names)] + [("v", "i", 99, "Act")], "workbook_id string, indicator_id string, ref_id long, law_name string").write.parquet(f"{tmp_path}/ref_row.parquet")
    spark.createDataFrame([("w", "i", n, x) for n, x in enumerate(labels)], "workbook_id string, indicator_id string, target_id long, law_label string").write.parquet(f"{tmp_path}/trace_target.parquet")
    got = {(r["ref_id"], r["target_id"]): r["cer"] for r in P.cer_levenshtein(spark, str(tmp_path)).collect()}
    # the k-th name that is not null meets the k-th label; of what has no partner nothing is said
    said, heard = ([(i, x) for i, x in enumerate(side) if x is not None] for side in (names, labels))
    want = {(i, j): distance(a.lower(), b.lower()) / max(len(a), 1) for (i, a), (j, b) in zip(said, heard)}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 6e-5 for k in want)
