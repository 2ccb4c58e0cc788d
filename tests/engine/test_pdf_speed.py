"""Reading takes about a step per shown string, however many codes it has and however often it is shown."""

import sys

from corrobora.plans import made_pdf
from corrobora.sources import pdf, pdf_filters


def steps(f) -> int:
    """Python calls that ``f`` makes, as they do not depend on the machine."""
    n = 0

    def count(_frame, event, _arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        f()
    finally:
        sys.setprofile(None)
    return n


def test_words_that_are_shown_again_take_few_steps():
    text = " ".join(f"word{k % 50} again{k % 30}" for k in range(600))
    # The calls a word, each shown in two strings at a place of its own, and each line of the other ways.
    for how, most in ((0, 20), (1, 70), (2, 20), (3, 70), (4, 10)):
        content = made_pdf.made(text, how)
        assert steps(lambda content=content: pdf.read_pdf(content)) < most * 1200
        assert " ".join(t for t, _ in pdf.read_pdf(content)[0]) == text


def test_rows_of_one_predictor_are_undone_together():
    data = bytes(range(256)) * 40
    packed = made_pdf.up(data)
    assert pdf_filters.flate(packed, {"/Predictor": 12.0, "/Columns": 7.0})[: len(data)] == data
    assert steps(lambda: pdf_filters.flate(packed, {"/Predictor": 12.0, "/Columns": 7.0})) < 100
