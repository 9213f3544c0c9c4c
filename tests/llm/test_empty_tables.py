"""Every operator on empty tables: no row, the columns as ever."""

import pytest

from limnos.llm import queries as Q

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id string, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}
FULL = {"benchmark": [("b1", "ten words of a test item stand here in order now")], "labels": [(1, 1, 0), (2, 1, 1)]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(FULL.get(name, []), schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.mark.parametrize("name", [n for n in Q.queries() if n != "pipeline"])
def test_empty_tables_give_no_rows(spark, folder, name):
    out = Q.queries()[name](spark, folder)
    assert out.collect() == [] and len(out.columns) >= 3
