import ast
import datetime as dt

import pytest

from tracelake.llm import pairs
from tracelake.llm.syntax import pylexer

FILES = "file_id bigint, repo string, rel_path string, content string, loaded_at timestamp_ntz"

#: Functions whose documentation or header is written in an unusual way, and the names that must come out with their lines.
ODD = [
    ('def f():\n    ("Closes the file.")\n', {("f", 1)}),
    ('def f(): (("Closes " "the file.")); x = 1\n', {("f", 1)}),
    ('def f():\n    (\n        # so\n        "Closes"  # so\n        " the file."\n    )\n    def g(): ("Opens it again.")', {("f", 1), ("f.g", 3 + 4)}),
    ('def f():\n    ("Closes the file.").strip()\ndef g():\n    ("Closes the file.",)\ndef h():\n    ["Closes the file."]\ndef i(): ("Closes " + "the file.")\ndef j(): ("Closes the file.")("x")\n', set()),
    ('def f():\n    ()\n    ("Closes the file.")\ndef g(): x: "Closes the file."\ndef h(): x = lambda: "Closes the file."\nif x:\n    ("Closes the file.")\n', set()),
    ('def f() -> lambda: 0: "Closes the file."\n', {("f", 1)}),
    ('def f() -> lambda: lambda x=lambda: 0: 1:\n    "Closes the file."\n    class K:\n        def g(self) -> lambda x, y: x:\n            ("Opens it again.")\n', {("f", 1), ("f.K.g", 4)}),
    ('def f() -> dict[str, Config]:\n    "Config."\ndef g() -> (a, Config):\n    "Config."\n', {("f", 1), ("g", 3)}),
    ('def f[T, Closes, Files](a):\n    "Closes files."\ndef g[T, U](cats, dogs):\n    "cats dogs"\n', {("f", 1)}),
    ('def f(a=lambda x, files: 1, b=2):\n    "Files."\ndef g(a=lambda x, y: 1, cats=2):\n    "Cats."\n', {("f", 1)}),
    ('class A:\n    # above\n    async \\\n    def f(self):\n        "Closes the file."\n', {("A.f", 3)}),
    ('def \ufb01le():\n    "Closes the door."\n', {("file", 1)}),
]


def files(spark, *texts):
    return spark.createDataFrame([(i, "r", "a.py", t, dt.datetime(2031, 1, 1)) for i, t in enumerate(texts)], FILES)


def test_no_documented_function_is_left_out(spark):
    tokens = pairs.token_rows(files(spark, *(t for t, _ in ODD)))
    got = {(r.file_id, r.qualified_name, r.start_line) for r in pairs.documented_functions(tokens).collect()}
    assert got == {(i, *w) for i, (_, want) in enumerate(ODD) for w in want}
    comments = {(r.name, r.start_line, r.comment) for r in pairs.leading_comments(tokens).collect()}
    assert comments == {("f", 3, "# above")}


@pytest.mark.parametrize("n", range(len(ODD)))
def test_lines_are_those_of_the_language(n):
    text, want = ODD[n]
    found = {(c.name, c.lineno) for c in ast.walk(ast.parse(text)) if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef))}
    assert {(q.rpartition(".")[2], line) for q, line in want} <= found


def test_every_token_is_a_row(spark):
    text = 'def f(a, b=1 + 2):\n    return a.b.c - 3 if not a else b\nx = "a" "b"\n'
    rows = pairs.token_rows(files(spark, text)).collect()
    assert len(rows) == len(pylexer.Tokens(text).kinds) - 1  # strings side by side are one literal
    assert [r.w for r in rows if r.line == 2 and r.w] == ["return", "a", ".", "b", ".", "c", "-", "3", "if", "not", "a", "else", "b"]
