"""Whole reports through ingestion, and sections from pages."""

import json

import pytest
from pyspark.sql import functions as F

from leafmill.operators import sections, structure
from leafmill.plans.ingest import ingest
from leafmill.sources.readers import REPORT


def line(text, top, bottom):
    return {"text": text, "bbox": [[100, top], [500, top], [500, bottom], [100, bottom]]}


def reports(spark, *given):
    rows = [(tag, scan, when, "de", json.dumps({"pages": pages})) for tag, scan, when, pages in given]
    own = spark.createDataFrame(rows, "tag_id string, scan_id string, created_at string, language string, j string")
    return own.withColumn("r", F.from_json("j", REPORT)).select("tag_id", "scan_id", "created_at", "language", "r.pages")


def page(slot, *lines, **more):
    return {"page_id": "page_1" if slot == "left" else "page_2", "slot": slot, "ocr_lines": [line(*x) for x in lines], **more}


def pages_of(spark, *given):
    return {(r["tag_id"], r["page_id"]): r for r in ingest(reports(spark, *given))[0].collect()}


def test_numbers_heading_and_tail(spark):
    got = pages_of(spark, ("HARBOUR", "s1", "t1", [page("left", ("Kapitel 5", 40, 70), ("Am alten Hafen", 90, 120), ("12", 970, 1000)), page("right", ("Der Kahn lag am Steg.", 60, 90), ("Vom Ufer rief jemand", 110, 140), ("13", 970, 1000))]))
    left, right = got["HARBOUR", "page_0012"], got["HARBOUR", "page_0013"]
    assert (left["chapter_number"], left["chapter_heading"], left["clean_text"], left["speak_text"], left["tail_fragment"]) == (5, "Am alten Hafen", "Kapitel 5\nAm alten Hafen", "Kapitel 5\nAm alten Hafen", None)
    assert (right["tail_fragment"], right["speak_text"], right["clean_text"]) == ("Vom Ufer rief jemand", "Der Kahn lag am Steg.", "Der Kahn lag am Steg.\nVom Ufer rief jemand")


def test_several_markers_and_inferred_number(spark):
    got = pages_of(spark, ("B", "s", "t", [page("left", ("31", 40, 80), ("Gefunden wird das Netz erst Wochen danach, am 9. No-", 160, 200), ("32", 840, 880), ("Im Frühling liegt hinter der Mühle ein Brief mit", 960, 1000), ("132", 1760, 1790)), page("right", ("ZWISCHENSPIEL", 420, 500))]))
    left, right = got["B", "page_0132"], got["B", "page_0133"]
    assert [(m["chapter_number"], m["line_index"]) for m in left["chapter_markers"]] == [(31, 0), (32, 2)]
    assert (right["chapter_heading"], right["chapter_number"], right["speak_text"], right["tail_fragment"], right["inferred"]) == ("ZWISCHENSPIEL", None, "ZWISCHENSPIEL", None, True)
    assert left["speak_text"].startswith("Kapitel einunddreissig.\n\nGefunden wird") and "\n\nKapitel zweiunddreissig.\n\n" in left["speak_text"]


def test_cardinal_and_hyphens(spark):
    got = pages_of(spark, ("A", "s", "t", [page("left", ("2", 40, 80), ("Die Flut kam früh.", 160, 200), ("44", 1760, 1790))]), ("C", "s", "t", [page("left", ("stand lange so, bis ein Fischer-", 220, 260), ("boot vom Sand kam.", 270, 310), ("132", 1760, 1790))]))
    assert got["A", "page_0044"]["speak_text"] == "Kapitel zwei.\n\nDie Flut kam früh."
    assert got["C", "page_0132"]["clean_text"] == "stand lange so, bis ein Fischer-\nboot vom Sand kam."
    assert got["C", "page_0132"]["speak_text"] == "stand lange so, bis ein Fischerboot vom Sand kam."


def test_right_tail_goes_to_the_next_left_page(spark):
    first = ("B", "s1", "t1", [page("left", ("Der Tag begann.", 100, 130), ("10", 970, 1000)), page("right", ("Der Wind stand. Bald kam", 100, 130), ("11", 970, 1000))])
    second = ("B", "s2", "t2", [page("left", ("ein Segel näher. Ruhe.", 100, 130), ("12", 970, 1000))])
    assert pages_of(spark, first, second)["B", "page_0012"]["speak_text"] == "Bald kam ein Segel näher. Ruhe."


def test_pending_tail_is_held_and_cleared(spark):
    first = ("B", "s1", "t1", [page("left", ("Der Tag begann.", 100, 130)), page("right", ("Der Wind stand. Bald kam", 100, 130))])
    second = ("B", "s2", "t2", [page("left", ("ein Segel näher. Ruhe.", 100, 130)), page("right", ("Alle schliefen.", 100, 130))])
    third = ("B", "s3", "t3", [page("left", ("am Morgen weiter.", 100, 130))])
    found, _ = ingest(reports(spark, first, second, third))
    del found
    from leafmill.plans.ingest import drafts, finished, stitched

    said = {(r["scan_id"], r["side"]): r["speak_text"] for r in stitched(finished(drafts(reports(spark, first, second, third))[0])).collect()}
    assert said["s2", "left"] == "Bald kam ein Segel näher. Ruhe."
    assert said["s3", "left"] == "am Morgen weiter."


def test_refused_pages(spark):
    _, refused = ingest(reports(spark, ("B", "s", "t", [page("middle", ("x", 1, 2)), page("left")])))
    assert refused.count() == 2


@pytest.mark.parametrize(("language", "label"), [("de", "Kapitel zwei."), ("en", "Chapter two.")])
def test_language(spark, language, label):
    got = ingest(reports(spark, ("B", "s", "t", [page("left", ("2", 40, 80), ("Text.", 160, 200), ("44", 900, 950))])).withColumn("language", F.lit(language)))[0].first()
    assert got["speak_text"] == f"{label}\n\nText."


def book(spark, texts, marks=()):
    kind = f"array<{structure.MARKER}>"
    rows = [("B", f"s{(i + 1) // 2:03d}", "left" if i % 2 else "right", i, f"page_{i:04d}", "t", t, [(0, i, None, 1, "explicit_label")] if i in marks else []) for i, t in enumerate(texts, 1)]
    pages = spark.createDataFrame(rows, f"tag_id string, scan_id string, side string, page_number int, page_id string, created_at string, clean_text string, chapter_markers {kind}")
    return sections.assembly_order(pages)


def test_section_ends_at_the_first_marker_after_ten_pages(spark):
    pages = book(spark, [*(f"Seite {i}." for i in range(1, 12)), "Kapitel 12\nAm Meer war es still."], {5, 12})
    got = sections.section_text(pages, sections.boundaries(pages)).collect()
    assert [(r["chapter_id"], r["start_page"], r["end_page"], r["content_page_count"], r["page_span"]) for r in got] == [("chapter_0001", 1, 11, 11, 12)]
    assert "Kapitel 12" not in got[0]["text"]
    rest = sections.section_text(pages, sections.pending(pages, sections.boundaries(pages))).first()
    assert rest["text"] == "Kapitel 12\nAm Meer war es still."


def test_section_falls_back_within_page_twenty_and_resumes_there(spark):
    texts = [*(f"Seite {i}." for i in range(1, 20)), "Das Netz war voll.\n\nHinter dem Deich wartete", *(f"Seite {i}." for i in range(21, 30)), "Kapitel 30\nAm Meer."]
    pages = book(spark, texts, {30})
    got = sections.section_text(pages, sections.boundaries(pages)).orderBy("sequence").collect()
    assert got[0]["text"].endswith("Das Netz war voll.") and "Hinter" not in got[0]["text"]
    assert got[1]["text"].startswith("Hinter dem Deich wartete") and (got[1]["start_page"], got[1]["end_page"]) == (20, 29)


def test_boundaries_always_advance():
    assert list(sections.boundaries_of([[]] * 3, [0] * 3, [0] * 3, least=1, most=1)) == []
