"""The command line over a small crate."""

import json

import pytest

from lathe.__main__ import main
from lathe.sources import files


@pytest.fixture
def crate(tmp_path, monkeypatch):
    (tmp_path / "src").mkdir()
    (tmp_path / "Cargo.toml").write_text("[package]\nname = 'x'\n")
    (tmp_path / "src" / "lib.rs").write_text("pub(crate) mod m;\n")
    (tmp_path / "src" / "m.rs").write_text("fn b() {}\n/// Doc.\npub fn a() { b() }\n")
    (tmp_path / "note.md").write_text("|a|\n|-|\n|bb|\n")
    monkeypatch.chdir(tmp_path)
    return tmp_path


def test_apply(spark, crate, capsys):
    assert main(["src", "note.md", "--json"], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert [(r["code"], r["path"].rsplit("/", 1)[1]) for r in got] == [("FIX", "note.md"), ("REORDER", "m.rs"), ("VIS", "m.rs")]
    assert (crate / "src" / "m.rs").read_text() == "/// Doc.\npub(crate) fn a() { b() }\n\nfn b() {}\n"
    assert (crate / "note.md").read_text() == "| a  |\n| -- |\n| bb |\n"
    assert main(["src", "note.md", "--json"], spark) == 0 and json.loads(capsys.readouterr().out) == []


def test_dry_run_and_errors(spark, crate, capsys):
    (crate / "src" / "bad.rs").write_text("pub struct S;\n")
    before = (crate / "src" / "m.rs").read_text()
    assert main(["src", "--dry-run"], spark) == 1  # a lint is an error
    out = capsys.readouterr().err.splitlines()
    assert any("error[DOC001]" in line and "bad.rs:1: " in line for line in out) and (crate / "src" / "m.rs").read_text() == before
    assert main(["src", "--dry-run", "--include", "tables"], spark) == 0
    assert main(["--validate", "--config", "none.yaml"], spark) == 2
    (crate / ".lathe.yaml").write_text("nope: 1\n")
    assert main(["--validate"], spark) == 2 and main(["--validate", "--no-config"], spark) == 2
    assert main(["src", "--no-config", "--include", "nope"], spark) == 2
    assert main(["missing"], spark) == 2
    (crate / "x.txt").write_text("")
    assert main(["x.txt", "--json", "--no-config"], spark) == 0 and capsys.readouterr().out.strip().endswith("[]")


def test_ignored_files_stay_as_they_are(spark, crate, capsys):
    (crate / ".git").mkdir()
    (crate / ".gitignore").write_text("target/\n*.gen.md\n!keep.gen.md\n/top.md\n")
    for name in ("target/x.rs", "deep/target/y.md", "a.gen.md", "keep.gen.md", "top.md", "deep/top.md", "deep/no.md", ".hidden/h.md"):
        (crate / name).parent.mkdir(parents=True, exist_ok=True)
        (crate / name).write_text("|a|\n|-|\n|bb|\n")
    (crate / "deep" / ".gitignore").write_text("no.md\n")
    found = {p.removeprefix("./") for p in files.resolve(".")}
    assert found == {"src/lib.rs", "src/m.rs", "note.md", "keep.gen.md", "deep/top.md", ".hidden/h.md"}
    assert files.resolve("deep") == ["deep/top.md"] and files.resolve("target/x.rs") == ["target/x.rs"]
    assert main([".", "--include", "tables"], spark) == 0
    assert (crate / "target/x.rs").read_text() == (crate / "top.md").read_text() == "|a|\n|-|\n|bb|\n" != (crate / "deep/top.md").read_text()


def test_validation_and_dead_patterns(spark, crate, capsys):
    assert main(["--validate"], spark) == 2  # there is none
    (crate / ".lathe.yaml").write_text("exclude:\n- files: ['src/**/*.rs', 'note.{md,txt}']\n  rules: [tables]\n")
    assert main(["--validate"], spark) == 0
    assert capsys.readouterr().out.strip() == f"config valid: {crate / '.lathe.yaml'}"
    (crate / ".lathe.yaml").write_text("exclude_files: ['gone/**']\n")
    for argv in (["--validate"], ["note.md"]):
        assert main(argv, spark) == 2 and "matched no files" in capsys.readouterr().err
    assert main(["note.md", "--no-config", "--dry-run"], spark) == 0


def test_warnings_of_the_module_tree(spark, crate, capsys):
    (crate / "src" / "lib.rs").write_text("pub(crate) mod m;\nmod gone;\n")
    main(["src/m.rs", "--dry-run"], spark)
    assert "warning: " in (err := capsys.readouterr().err) and "`mod gone;` resolves to no `gone.rs`" in err
