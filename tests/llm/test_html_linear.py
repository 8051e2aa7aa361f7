import random
import time

import numpy as np
import pytest

from filterlab.llm import html_extract

ODD = ["<div>x", "<script ", '<a "', "<!", "<!--", "<div>x</p>", "<a '\"", "<li>x", "<p class='a' b=\"", "<", "&amp", "<td></td><b>", "<div 'x\" <p \"y' >", "<div></section></p>"]


@pytest.mark.parametrize("part", ODD)
def test_pages_of_a_megabyte(part):
    def took(size):
        page, began = part * (size // len(part)), time.process_time()
        html_extract.main_text(page)
        return time.process_time() - began

    assert took(1_000_000) < max(10.0, 40 * took(125_000))  # eight times the page: quadratic work would take 64 times as long


def test_deep_and_unmatched():
    assert html_extract.main_text("<div>" * 50_000 + "A text of the article that is long enough to be kept.") == "A text of the article that is long enough to be kept."
    assert html_extract.main_text("<p>5 < 6 and a <b c> d</p>") == "5 < 6 and a d"
    assert html_extract.main_text("<p>An <i title='a > b'>italic</i> word <a href=\"x>y\">here</a> and more of the sentence") == "An italic word here and more of the sentence"


def test_surge_and_dive_points():
    rng = random.Random(4)
    for _ in range(400):
        lengths = np.array([rng.choice([0, 0, 0, 1, 15, 90]) for _ in range(rng.randrange(1, 30))])
        if not lengths.any():
            continue
        sums = [sum(lengths[k : k + html_extract.WINDOW]) for k in range(len(lengths))]
        limit, want, begin = min(html_extract.SURGE, max(sums)), [], None
        for k in range(len(lengths)):
            if begin is None:
                if lengths[k] and sums[k] >= limit:
                    begin = k
            elif not lengths[k] and not sums[k]:
                want.append((begin, k))
                begin = None
        assert html_extract.stretches(lengths) == want + ([(begin, len(lengths))] if begin is not None else [])


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", None, "t", 1), (1, "u", "", "t", 1), (None, None, "<p>Text of a page without an id.</p>", None, None), (2, "u", "<p>Twice</p>", "t", 1), (2, "u", "<p>Twice</p>", "t", 1)]
    pages = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in html_extract.extracted(pages).collect()]
    assert sorted(got, key=repr) == sorted([(1, "u", ""), (1, "u", ""), (None, None, "Text of a page without an id."), (2, "u", "Twice"), (2, "u", "Twice")], key=repr)
    assert html_extract.extracted(pages.limit(0)).collect() == []
