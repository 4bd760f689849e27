"""Listings of folders against os.walk, with budgets, pages and what they leave out."""

import os

import pytest

from skein.sources import listing


def made(root, files):
    for path in files:
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        open(f"{root}/{path}", "w").write(path)
    return str(root)


def walked(root):
    """All entries below root, folders with 0 bytes."""
    out = []
    for top, folders, files in os.walk(root):
        at = os.path.relpath(top, root)
        out += [(os.path.normpath(f"{at}/{f}"), True, 0) for f in folders]
        out += [(os.path.normpath(f"{at}/{f}"), False, os.path.getsize(f"{top}/{f}")) for f in files]
    return sorted(out, key=lambda r: r[0].encode())


def found(rows):
    return sorted(((r["path"], r["directory"], r["bytes"]) for r in rows.collect()), key=lambda r: r[0].encode())


TREE = ["a.txt", "b/c.txt", "b/d/e/f.txt", "b/é.txt", "b/z", "B/upper", "ö/𝄞.txt", "ö/\uffee.txt", *(f"many/{i:03d}.md" for i in range(30))]


def test_walk_is_whole(spark, tmp_path):
    root = made(tmp_path, TREE)
    os.makedirs(tmp_path / "empty")
    rows, cut = listing.walk(spark, root)
    assert not cut and found(rows) == walked(root) and rows.where("omitted").isEmpty()
    rows, _ = listing.walk(spark, f"file://{root}", "b", recursive=False)
    assert [r[0] for r in found(rows)] == ["b/c.txt", "b/d", "b/z", "b/é.txt"]
    assert found(listing.walk(spark, root, "empty")[0]) == []


def test_order_is_by_bytes(spark, tmp_path):
    got = listing.list_files(spark, made(tmp_path, TREE), "ö")
    assert [r["path"] for r in got.entries.collect()] == ["ö/\uffee.txt", "ö/𝄞.txt"]  # by UTF-16 units it would be the other way round


def test_pages_join_to_the_whole(spark, tmp_path):
    root = made(tmp_path, TREE)
    rows, cut = listing.walk(spark, root)
    got, after, reasons = [], None, []
    while True:
        one = listing.page(rows, cut, 7, after)
        got += [tuple(r) for r in one.entries.collect()]
        reasons.append(one.reason)
        after = one.after
        if after is None:
            break
    assert got == walked(root) and set(reasons[:-1]) == {"max_results"} and reasons[-1] is None


def test_entry_budget_is_breadth_first(spark, tmp_path):
    root = made(tmp_path, TREE)
    top = [r for r in walked(root) if "/" not in r[0]]
    second = [r for r in walked(root) if r[0].count("/") == 1]
    for most in (1, len(top), len(top) + 3, len(top) + len(second)):
        got = listing.list_files(spark, root, recursive=True, max_entries=most)
        want = sorted((top + second)[:most], key=lambda r: r[0].encode())
        assert found(got.entries) == want and got.reason == "entry_budget"
    whole = listing.list_files(spark, root, recursive=True, max_entries=len(walked(root)))
    assert found(whole.entries) == walked(root) and whole.reason is None and whole.after is None
    both = listing.list_files(spark, root, recursive=True, max_results=2, max_entries=3)
    assert both.reason == "entry_budget" and both.entries.count() == 2


def test_what_is_left_out(spark, tmp_path):
    root = made(tmp_path, ["ok.txt", ".git/config", "x/.GIT/y", "x/.env", ".env.example", ".env.local", "x/.agent-tmp-1", "runtime_data/log", "back\\slash", "x/.netrc"])
    os.symlink(tmp_path / "ok.txt", tmp_path / "link")
    os.symlink(tmp_path / "x", tmp_path / "folder-link")
    open(os.fsencode(f"{root}/") + b"bad\xff", "w").close()
    got = listing.list_files(spark, root, recursive=True)
    assert [r["path"] for r in got.entries.collect()] == [".env.example", "ok.txt", "x"] and got.reason is None
    assert got.omitted == 11  # .git, runtime_data, .env.local, back\slash, link, folder-link, bad; in x: .GIT, .env, .agent-tmp-1, .netrc


@pytest.mark.parametrize("path", ["/etc", "..", "a/../b", "a//b", "./a", "a\\b", "C:/x", "x" * 300, "a/.git", "\ud800"])
def test_paths_that_are_refused(spark, tmp_path, path):
    with pytest.raises(ValueError, match="can't be listed"):
        listing.walk(spark, str(tmp_path), path)


@pytest.mark.parametrize("n", [0, 201])
def test_number_of_results_is_checked(spark, tmp_path, n):
    with pytest.raises(ValueError, match="max_results"):
        listing.list_files(spark, str(tmp_path), max_results=n)


def test_a_missing_folder_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="No such file"):
        listing.walk(spark, str(tmp_path), "missing")
