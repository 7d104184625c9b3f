import pytest

from litloom.plans import papers as P
from litloom.plans import records as R
from litloom.plans import structure as S
from litloom.plans import tables as T

FOLDER = "/root/testdata/sf0.001"


def write(spark, folder, rows):
    schema = "doc_id long, text string, source string, n_chars long"
    spark.createDataFrame([(i, t, "s", len(t or "")) for i, t in rows], schema).write.parquet(f"{folder}/documents.parquet")


@pytest.mark.parametrize("query, table", [(T.parse_author_name_documents, "documents"), (T.batch_assign_documents, "documents"), (T.value_classes_events, "events"), (P.cited_numbers, "documents"), (P.captions_found, "documents"), (R.identifiers, "documents"), (P.boxes_plausible, "events")])
def test_every_row_is_read(spark, query, table):
    assert query(spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_chunk_selection_grows_with_the_documents(spark, tmp_path):
    write(spark, tmp_path, [(i, f"text {i} " * 40) for i in range(300)] + [(i, "long " * 9000) for i in range(300, 340)])
    rows = S.chunk_selection(spark, tmp_path).collect()
    papers = {r.paper_id for r in rows}
    assert len(papers) > 100 and papers <= {str(i) for i in range(300)}
    assert all(sum(r.tokens for r in rows if r.paper_id == p) <= 6000 for p in papers)
