"""Section boundaries block by block against the loop over whole books."""

import random

import pytest

from leafmill.operators import sections


@pytest.mark.parametrize(("least", "most", "block"), [(2, 3, 4), (3, 7, 8), (10, 20, 64), (2, 20, 20)])
def test_boundaries_equal_the_loop(spark, monkeypatch, least, most, block):
    rng = random.Random(block)
    books = {f"b{k}": [([rng.randrange(50) for _ in range(rng.choice([0, 0, 0, 1, 2]))] if k % 3 else [], (f := rng.randrange(50)), f + rng.randrange(9)) for _ in range(rng.choice([0, 1, 5, 19, 20, 63, 64, 65, 130, 400]))] for k in range(14)}
    facts = spark.createDataFrame([(t, p, sorted(m), f, r) for t, pages in books.items() for p, (m, f, r) in enumerate(pages)], "tag_id string, position int, markers array<int>, fallback int, resume int")
    monkeypatch.setattr(sections, "page_facts", lambda pages: pages)
    got = {tuple(r) for r in sections.boundaries(facts, least, most, block).collect()}
    want = {(t, s, *a, *b, *c, kind) for t, pages in books.items() for s, a, b, c, kind in sections.boundaries_of([sorted(m) for m, _, _ in pages], [f for _, f, _ in pages], [r for _, _, r in pages], least=least, most=most)}
    assert got == want and len(want) > 20


def test_bounds_of_sections(spark):
    with pytest.raises(ValueError, match="pages in blocks"):
        sections.boundaries(spark.range(1), least=1)
