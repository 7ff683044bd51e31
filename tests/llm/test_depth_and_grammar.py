"""Depth without a limit, all errors of a text, and forms that grammars allow or forbid."""

import pytest

from tracelake.llm import broken

TEAMS = """? - Detroit Tigers
  - Chicago cubs
: - 2001-07-23
  - 2001-07-24

? [ New York Yankees,
    Atlanta Braves ]
: [ 2001-07-02, 2001-08-12,
    2001-08-14 ]
"""
VALID = [
    ("yaml", TEAMS), ("yaml", "k: &a !t c\n"), ("yaml", "? key\n: - item\n  - more\n"),
    ("javascript", "(a ?? b) || c; a ?? (b && c); a ?? b ?? c"), ("javascript", "new a()?.b"), ("javascript", "<!-- old\nx = 1\n--> end\ny = 2"), ("javascript", "while (x --> 0) {}"),
    ("python", "\u2118 = 1\n\u00e9\u00b7x = \u2118\n"), ("python", "x = " + "not " * 5000 + "y\n"), ("python", "x = " + "(" * 200 + ")" * 200 + "\n"),
]
INVALID = [
    ("yaml", "k: &a &b c\n"), ("javascript", "a ?? b || c"), ("javascript", "a && b ?? c"), ("javascript", "new a?.b()"), ("json", "[NaN]"),
    ("python", "x = " + "(" * 201 + ")" * 201 + "\n"), ("python", "".join(" " * i + "if x:\n" for i in range(101)) + " " * 101 + "pass\n"),
]


@pytest.mark.parametrize(("language", "text"), VALID)
def test_valid(language, text):
    assert broken.find_problems(text, language) == []


@pytest.mark.parametrize(("language", "text"), INVALID)
def test_invalid(language, text):
    assert broken.find_problems(text, language)


@pytest.mark.parametrize(("language", "head"), [("yaml", ""), ("json", ""), ("toml", "x = "), ("javascript", "x = ")])
def test_depth_is_no_error(language, head):
    n = 20_000
    assert broken.find_problems(head + "[" * n + "]" * n, language) == []
    assert broken.find_problems(head + "[" * n, language)


def test_every_error_is_kept():
    text = "".join(f"a{i}: 'x' y\n" for i in range(500))
    assert len(broken.find_problems(text, "yaml")) == 500
