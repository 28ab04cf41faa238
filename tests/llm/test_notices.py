"""Notices that look like navigation."""

import pytest

from beliefloom.llm import residue as R

NOTICES = ["404 | Not Found", "Error 404 · Page not found", "Access denied | Request blocked", "Cookies and JavaScript must be enabled to continue."]
NAVIGATION = ["Home | About | Contact", "Maps · Reports · Archive", "News › Harbour › Quay", "Cookie settings", "Cookies | Terms | Imprint", "Vault registry | Annual report", "Wexlath Laboratory · Kelpool"]


@pytest.fixture(scope="module")
def model():
    return R.Model(R.seed_counts())


@pytest.mark.parametrize("text", NOTICES)
def test_notice(model, text):
    n, _, content = model.judge([text])
    assert content[0] >= R.LEAST and n[0, 2] >= R.COVERAGE * n[0].sum() > 0


@pytest.mark.parametrize("text", NAVIGATION)
def test_navigation(model, text):
    assert not model.judge([text])[0].any()


@pytest.mark.parametrize("text", ["ok", "n/a", "—", " ", "", "\n\n"])
def test_tiny(model, text):
    assert model.judge([text])[2][0] < R.LEAST
