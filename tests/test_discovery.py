"""The tree source: what it lists, what it leaves out before listing, links, warnings."""

import os

import pytest

from archsieve.plans.engine import Project
from archsieve.sources import discovery
from archsieve.sources import project as sources


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "top"
    for name in ("src/a.ts", "src/deep/er/b.tsx", "src/ignored/skip.ts", "src/x.md", "dist/out.js", "node_modules/p/i.js", "src/node_modules/q/j.js", "z.mjs", "src/a-b/c.cts"):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(f"export const here = '{name}';\n")
    (tmp_path / "outside.ts").write_text("x")
    (top / "src/none.ts").symlink_to("nowhere.ts")
    (top / "src/again.ts").symlink_to("a.ts")
    (top / "src/out.ts").symlink_to(tmp_path / "outside.ts")
    (top / "src/deep/up").symlink_to(top / "src", target_is_directory=True)
    (top / "node_modules/p/loop").symlink_to(top / "node_modules", target_is_directory=True)
    (top / "linked").symlink_to(top / "src/deep", target_is_directory=True)
    return str(top)


@pytest.mark.parametrize("parts", [1, 2, 3, 64])
def test_tree(spark, root, parts):
    found = discovery.tree(spark, root, r"\.(ts|tsx|cts|mjs|js)$", ("src/ignored/**",), parts=parts).collect()
    files = {r.path: r for r in found if r.warning is None}
    assert sorted(files) == sorted([os.path.join(os.path.dirname(root), "outside.ts"), "src/a-b/c.cts", "src/a.ts", "src/deep/er/b.tsx", "z.mjs"])
    assert all(len(r.content) == r.length for r in files.values()) and b"'src/a.ts'" in files["src/a.ts"].content
    # the loop below node_modules is not seen, for nothing there is listed; the link beside src leads to a loop of src
    assert {r.path for r in found if r.warning} == {"src/none.ts", "src/deep/up"} | {r.path for r in found if r.warning and r.path.startswith("linked/")}
    assert len(found) == len({(r.path, r.warning) for r in found})


def test_partitions_are_directories(root):
    walk = discovery.Walk({"path": root, "parts": "3", "skipped": '["node_modules", "dist"]'})
    parts = walk.partitions()
    assert [p.path for p in parts if not p.whole][:1] == [""] and not any("node_modules" in p.path for p in parts)
    assert len({(p.path, p.whole) for p in parts}) == len(parts)


def test_included_directories_and_a_missing_root(spark, root):
    settings = sources.Config(include_dirs=("dist",), exclude=("**/dist/**",))
    assert "dist/out.js" in {r.path for r in sources.source_files(spark, root, settings).collect()}
    assert [r.path for r in discovery.tree(spark, root + "/none").collect()] == [""]


def test_warnings_of_a_project(spark, root):
    project = Project(spark, root)
    assert {r.path for r in project.warnings().collect()} >= {"src/none.ts", "src/deep/up"}
    assert "src/deep/er/b.tsx" in {r.path for r in project.files.collect()} and not any("node_modules" in r.path for r in project.files.collect())
