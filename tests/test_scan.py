"""A folder of sources and reports, from end to end."""

import json

import pytest

from tracelake import cli
from tracelake.plans import scan

CODE = {
    "app/web.py": "from app import db\nimport wares\n@app.post('/x')\ndef create(r):\n    db.save(r)\n    wares.put(r)\ndef idle():\n    db.drop()\n",
    "app/db.py": "def save(x):\n    run('insert ' + x)\ndef drop():\n    run('drop')\n",
    "app/__init__.py": "",
}
BANDIT = {"results": [{"filename": "app/db.py", "line_number": n, "line_range": [n], "test_id": "B608", "issue_severity": "MEDIUM", "issue_confidence": "LOW", "issue_cwe": {"id": 89}, "issue_text": "sql"} for n in (2, 4)], "errors": []}
OSV = {"results": [{"source": {"path": "req.txt"}, "packages": [{"package": {"name": n, "version": "1.0"}, "groups": [{"ids": [f"GHSA-{n}"], "max_severity": "9.8"}], "vulnerabilities": []} for n in ("wares", "below", "unused")]}]}


@pytest.fixture
def folder(tmp_path):
    for path, text in CODE.items():
        (tmp_path / "src" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / path).write_text(text)
    (tmp_path / "bandit.json").write_text(json.dumps(BANDIT))
    (tmp_path / "osv.json").write_text(json.dumps(OSV))
    info = tmp_path / "site" / "wares-1.0.dist-info"
    info.mkdir(parents=True)
    (info / "METADATA").write_text("Name: wares\nRequires-Dist: below\n")
    return tmp_path


def test_scan(spark, folder):
    got = scan.scan(spark, str(folder / "src"), {"bandit": str(folder / "bandit.json"), "osv": str(folder / "osv.json")}, str(folder / "site"))
    rows = got["findings"].collect()
    told = [(r.source, r.package or r.line, r.reachable, [x.split("::")[-2] if "::L" in x else x for x in r.path], r.blast_radius, list(r.via or [])) for r in rows]
    assert told[0][:4] == ("bandit", 2, "reachable", ["create", "save"])
    by = {t[1]: t for t in told}
    assert by[4][2] == "unreachable" and by["wares"][5] == [] and by["below"][5] == ["wares"] and by["unused"][2] == "unknown"
    assert by["wares"][2:4] == by["below"][2:4] == ("reachable", ["create"])  # the route calls into the package
    m = got["mapping"].first()
    assert (m.total, m.to_def, m.to_package, m.via_dependency, m.unused_dependency, m.ratio) == (5, 2, 1, 1, 1, 1.0)
    s = got["summary"].first()
    assert (s.n_file, s.n_function, s.entry_points, s.imports_resolved, s.imports_unknown) == (3, 4, 1, 1, 0)
    assert len({r.finding_id for r in rows}) == 5
    assert got["report_findings"].count() == 5


def test_commands(spark, folder, capsys):
    assert cli.main(["index", str(folder / "src"), "--out", str(folder / "out"), "--json"]) == 0
    assert {p.name for p in (folder / "out").iterdir()} == {"nodes", "edges", "refs", "call_refs", "entry_points", "summary"}
    with pytest.raises(SystemExit):
        cli.main(["scan", str(folder / "src")])
