"""Ignore files in every folder, with exceptions."""

import pytest

from corpusflow.sources import files


@pytest.mark.parametrize(
    "lines,path,gone",
    [
        ([(".gitignore", "", "*.log")], "a/b.log", True),
        ([(".gitignore", "", "*.log"), (".gitignore", "", "!keep.log")], "a/keep.log", False),
        ([(".gitignore", "", "!keep.log"), (".gitignore", "", "*.log")], "keep.log", True),
        ([(".gitignore", "a/", "*.md")], "a/x/y.md", True),
        ([(".gitignore", "a/", "*.md")], "b/y.md", False),
        ([(".gitignore", "", "*.md"), (".gitignore", "a/", "!y.md")], "a/y.md", False),
        ([(".gitignore", "a/", "!y.md"), (".gitignore", "", "*.md")], "a/y.md", False),
        ([(".gitignore", "", "build/"), (".gitignore", "", "!build/keep.md")], "build/keep.md", True),
        ([(".gitignore", "", "build/")], "build", False),
        ([(".gitignore", "", "/top.md")], "a/top.md", False),
        ([(".gitignore", "", "doc/*.md")], "x/doc/a.md", False),
        ([(".gitignore", "", "doc/*.md")], "doc/a.md", True),
        ([(".gitignore", "", "doc/*.md")], "doc/b/a.md", False),
        ([(".gitignore", "", "**/tmp/**")], "x/y/tmp/z/a.md", True),
        ([(".gitignore", "", "a?c")], "abc", True),
        ([(".kbignore", "", "*.md"), (".gitignore", "a/", "!y.md")], "a/y.md", True),
        ([(".gitignore", "", "*.md"), (".kbignore", "", "!y.md")], "a/y.md", False),
        ([], "a.md", False),
    ],
)
def test_rules(lines, path, gone):
    assert files.Ignored(lines)(path) is gone


def test_walk_reads_ignore_files_of_all_folders(spark, tmp_path):
    for name in ("a.md", "keep/b.md", "keep/c.md", "keep/deep/d.md", "build/e.md", "x/build/f.md", ".hid/g.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("t")
    (tmp_path / ".gitignore").write_text("# c\n\n/build/\nc.md\n")
    (tmp_path / "keep" / ".kbignore").write_text("!c.md\nd.md\n")
    assert {r.path for r in files.walk(spark, str(tmp_path), "*.md").collect()} == {"a.md", "keep/b.md", "keep/c.md", "x/build/f.md"}
    assert {r.path for r in files.walk(spark, str(tmp_path), "*.md", ["x/**"]).collect()} == {"a.md", "keep/b.md", "keep/c.md"}
