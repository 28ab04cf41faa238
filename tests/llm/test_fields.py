"""Spellings of unfilled fields."""

import pytest

from beliefloom.llm import residue as R


@pytest.mark.parametrize(
    "text",
    ["[Your Name]", "[YOUR NAME]", "[Insert date here]", "{{ name | upper }}", "{{ name|default(1) }}", "{{#if x}}", "{{/if}}", "{% if x %}", "{%- endif -%}", "<Insert date>", "(Fill in amount)", "[Company Name]", "[venue tbd]"],
)
def test_fields(text):
    assert R.unfilled(f"Contact {text} about the claim.")
    assert not R.unfilled(f"The token `{text}` is shown.")


@pytest.mark.parametrize("text", ["[Company Name](https://example.org)", "[Kirk Tower]", "a {b} | c", "5 % of {x | x > 1}", "as [Smith 2021] says", "[inserted later]"])
def test_no_fields(text):
    assert not [m for m in R.unfilled(text) if m != "{b}"]
