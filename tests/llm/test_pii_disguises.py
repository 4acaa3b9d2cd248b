"""Spoken addresses with any end or a plain dot, and digit words between any of the separators."""

import pytest

from tracewell.llm import pii


@pytest.mark.parametrize(
    ("text", "value"),
    [(f"write to jane at example dot {end} soon", f"jane@example.{end}") for end in ("be", "ca", "ru", "museum")]
    + [
        ("write to jane at example.com, please", "jane@example.com"),
        ("jane dot doe at mail.example dot co dot uk", "jane.doe@mail.example.co.uk"),
        ("host one.two.three.four", "1.2.3.4"),
        ("card (four) (five) (three) (two) (zero) (one) (five) (one) (one) (two) (eight) (three) (zero) (three) (six) (six)", "4532015112830366"),
    ],
)
def test_disguises(text, value):
    assert [s[4] for s in pii.scan(text) if not s[3]] == [value]


@pytest.mark.parametrize("text", ["it is available at example.com", "look at the dot on the map", "he was at home.Then he left", "failed at main.py", "see us at example.org"])
def test_other_text_stays(text):
    assert not pii.scan(text)
