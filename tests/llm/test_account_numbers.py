"""Account numbers among words of capitals and digits."""

import pytest

from factweave.llm import pii

DE = "DE89 3704 0044 0532 0130 00"


@pytest.mark.parametrize("number", [DE, DE.replace(" ", ""), "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606"])
@pytest.mark.parametrize("before", ["IBAN ", "konto AB12 ", "account DE88 3704 0044 "])
@pytest.mark.parametrize("after", ["", " BIC COBADEFFXXX", " A new", " 2024 now", ", 12", " and"])
def test_number_and_followers(number, before, after):
    spans = [(s["start"], s["end"]) for s in pii.spans_of(before + number + after) if s["kind"] == "iban"]
    assert spans == [(len(before), len(before) + len(number))]


def test_two_in_a_row_and_none():
    both = f"iban {DE} GB82 WEST 1234 5698 7654 32"
    assert [both[a:b] for a, b in pii.ibans(both)] == [DE, both[6 + len(DE) :]]
    assert list(pii.ibans("DE88370400440532013000 A B")) == [] and list(pii.ibans(DE + "A")) == [] and list(pii.ibans("x" + DE)) == []


def test_country_without_a_fixed_length():
    checked = next(f"XX{k:02d} 1234 5678 9012" for k in range(2, 99) if pii.mod97(f"XX{k:02d}123456789012"))
    assert [checked] == [t[a:b] for t in [f"bank {checked} BIC X"] for a, b in pii.ibans(t)]


def test_many_starts_are_linear():
    assert list(pii.ibans("DE12 " * 200_000)) == []
