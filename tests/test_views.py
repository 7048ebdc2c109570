"""Pages and lines of odd texts against the SQL twins and plain slices."""

import duckdb
import pytest

import __spark_entry__ as entry
from leafmill.plans import views

from .compare import rows

SMILE = "\U0001f600"
TEXTS = [
    None, "", " ", "\n\t ", "x", "a" * 600, "b" * 601, "ab " * 400, ("c" * 59 + " ") * 25, ("d" * 60 + " ") * 25, "e" * 1200, "f" * 1201, SMILE * 1300, ("Ä" * 58 + ".  ") * 45,
    "ends here. " * 300, " lead\r\n\ttabs  and   runs \n" * 90, ("ß" + SMILE + " ") * 500, "\n" * 700 + "tail", "word" + " " * 1300 + "far", "\ufeff" * 1201 + "x",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    docs = [(i, text, ("en", "de", "fr")[i % 3]) for i, text in enumerate(TEXTS * 4)]
    docs += [docs[7], docs[13]]  # rows that are there twice
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


def test_pages_are_slices(spark, folder):
    got = {}
    for r in views.v_pages(spark, folder).orderBy("tag_id", "page_number").collect():
        got.setdefault(r["tag_id"], []).append(r["text"])
    want = {}
    for i, text in sorted([*enumerate(TEXTS * 4), (7, TEXTS[7]), (13, TEXTS[13])], key=lambda x: x[0]):
        cut = [None] if text is None else [text[k : k + 600] for k in range(0, max(len(text), 1), 600)]
        want.setdefault(f"{('EN', 'DE', 'FR')[i % 3]}-{i // 64}", []).append((i, cut))
    for tag, docs in want.items():
        pages = []
        for i in sorted({i for i, _ in docs}):
            cuts = [c for k, c in docs if k == i]
            pages += [c[k] for k in range(len(cuts[0])) for c in cuts]
        assert got[tag] == pages
    assert set(got) == set(want)


@pytest.mark.parametrize("name", ["line_remap", "orientation_best", "recognised_lines"])
def test_odd_texts_against_twins(spark, folder, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    want, got = db.execute(entry.oracle_sql()[name]).df(), entry.queries()[name](spark, folder).toPandas()
    assert rows(want, sorted(want.columns)) == rows(got, sorted(want.columns))
