"""Plans: no step is pushed into another so that it would run anew for every line."""

import pytest

import __spark_entry__ as entry

BY_LINE = [
    "box_measures", "box_top3", "chapter_markers", "footer_artifact", "heading_predicates", "hyphen_bridge", "layout_paragraphs", "line_order", "line_remap", "orientation_vote",
    "page_number_line", "page_number_pick", "page_speech", "paragraph_islands", "plausibility_score", "recognised_lines", "capture_report",
]


@pytest.mark.parametrize("name", BY_LINE)
def test_pages_are_cut_into_lines_once(spark, name):
    """A filter that holds the cutting of a page is one that Spark has pushed below it."""
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if line.lstrip(" +-:").startswith("Filter") and "sequence(0" in line]


def test_pauses_of_a_page_are_found_once(spark):
    plan = entry.queries()["ssml_to_text"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def plan_of(spark, name, which="optimizedPlan"):
    return getattr(entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution(), which)().toString()


@pytest.mark.parametrize("name", [*BY_LINE, "orientation_best", "page_kinds", "quoted_dialogue"])
def test_no_filter_makes_a_text_once_more(spark, name):
    """Neither the cutting of pages nor the repair of paragraphs stands in a filter, where it would run besides the projection."""
    assert not [line for line in plan_of(spark, name).split("\n") if line.lstrip(" +-:").startswith("Filter") and ("regexp_replace(" in line or "split(" in line)]


@pytest.mark.parametrize("name", ["box_top3", "line_remap", "orientation_vote"])
def test_a_page_is_walked_once_for_all_its_lines(spark, name):
    """Lines come from breaks set within the page's text, not from a substring for each of them."""
    plan = plan_of(spark, name)
    assert plan.count("split(") == 1 and plan.count("substring(") == 1


def test_lines_of_a_page_are_sorted_once(spark):
    """By book for the numbers of pages, by page for the ends; the last line needs no order of its own."""
    assert plan_of(spark, "page_number_line", "sparkPlan").count("DESC") == 0


@pytest.mark.parametrize("name", ["chapter_markers", "page_kinds", "page_number_pick", "page_speech"])
def test_lines_that_are_no_number_are_not_cast(spark, name):
    """A try_cast that fails throws inside, for every line of running text."""
    assert "cast(regexp_extract(" not in plan_of(spark, name).replace("THEN try_cast(regexp_extract(", "").replace("THEN cast(regexp_extract(", "")


def test_places_of_lines_need_no_boxes(spark):
    """line_remap asks for indices alone, so no tops are counted nor boxes made, and its generator holds no lambda."""
    plan = plan_of(spark, "line_remap")
    assert "bit_count(" not in plan and "endswith(" not in plan.lower()
    assert not [line for line in plan.split("\n") if line.lstrip(" +-:").startswith("Generate") and "lambdafunction(" in line]


def test_pages_are_cut_out_of_texts_of_fixed_width(spark):
    """A substring of text walks all characters before it, so cutting pages out takes time with the square of a text's length."""
    plan = plan_of(spark, "orientation_best")
    assert "substring(wide" in plan and plan.count("substring(") == 1


def test_a_page_passes_three_expressions(spark):
    """Blanks, breaks and hyphens; none of them tries a lookbehind at every character."""
    plan = plan_of(spark, "orientation_best")
    assert plan.count("regexp_replace(") == 3 and ", (?<=" not in plan


@pytest.mark.parametrize("name", ["box_measures", "recognised_lines"])
def test_ends_of_sentences_are_found_once_a_page(spark, name):
    """Which lines end a sentence is a column: within the lambda that makes a line it would be found for each of them."""
    assert "shiftright(aggregate(" not in plan_of(spark, name)


def test_a_result_is_read_once(spark):
    """Scores and boxes of a result aren't read anew for each of its texts, and entries are read by compiled code."""
    plan = plan_of(spark, "recognised_lines")
    assert not [x for x in plan.split("lambdafunction(")[1:] if "try_variant_get(" in x.split(" AS ")[0]]
    assert not [line for line in plan.split("\n") if line.lstrip(" +-:").startswith("Generate") and "lambdafunction(" in line]
