from litloom.plans import corpus
from litloom.plans.bib import documents



def test_texts_and_first_lines_are_whole(spark, tmp_path):
    text = "head " * 60 + "end\n" + "filler " * 900 + "idiot"
    spark.createDataFrame([(1, text, "en", "src1", len(text)), (2, None, None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    a, b = documents(spark, tmp_path).orderBy("idx").collect()
    assert (a.title, a.abstract) == (text.split("\n")[0], text) and (b.title, b.abstract) == ("", None)
    reason = {r.idx: r.reason for r in corpus.heuristic_screen_reason(spark, tmp_path).collect()}
    assert reason[1] == "Matched exclude pattern: idiot"
