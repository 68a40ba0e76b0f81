import pytest

from waylace.llm import pii


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("call (415) 555-2671 (415) 555-9999 now", [("phone", "(415) 555-2671"), ("phone", "(415) 555-9999")]),
        ("phone 415-555-2671 2024-01-05 ok", [("phone", "415-555-2671")]),
        ("card 3782 822463 10005 12/25 ok", [("card", "3782 822463 10005")]),
        ("tel 555-123-4567 24 hours", [("phone", "555-123-4567")]),
    ],
)
def test_numbers_beside_other_digits(text, wanted):
    proposed = {(k, text[a:b]) for k, a, b in pii.candidates(text)}
    assert set(wanted) <= proposed
    found = [(k, text[a:b]) for k, a, b in pii.all_spans(text, pii.trained_model())[1]]
    assert found == wanted
