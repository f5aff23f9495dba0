import hashlib
import random

from factloom.operators import trees

ENTRIES = "path string, kind string, digest string"
TREE = "path string, is_dir boolean, head string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_digests(entries):
    """The tree as nested dictionaries, folded by recursion."""
    root, total = {}, {}
    for path, kind, digest in sorted(entries, key=lambda e: (e[1], e[2] or "")):
        at = root
        *dirs, name = path.split("/")
        for d in dirs:
            at = at.setdefault(d, {})
        if kind == "dir":
            at.setdefault(name, {})
        else:
            at[name] = (kind, digest or "")

    def fold(at, path):
        files, parts = 0, {}
        for name, child in sorted(at.items()):
            if isinstance(child, dict):
                n, digest = fold(child, f"{path}/{name}".lstrip("/"))
                kind = "dir"
            else:
                n, (kind, digest) = 1, child
            files += n
            parts.setdefault(sha(name)[:4], []).append(f"{name}/{kind}/{digest}/")
        digest = sha("directory" + "".join(f"{p}:{sha(''.join(parts[p]))}/" for p in sorted(parts)))
        total[path] = (files, digest)
        return files, digest

    fold(root, "")
    return total


def test_digests_equal_a_recursion(spark):
    rng = random.Random(1)
    names = "a b c d é".split()
    entries = []
    for _ in range(150):
        dirs = ["/".join(rng.choice(names) + "0" for _ in range(rng.randrange(5)))]
        path = "/".join(filter(None, [*dirs, rng.choice(names) + rng.choice(["1.txt", "2.txt"])]))
        entries.append((path, rng.choice(["file", "symlink"]), rng.choice(["x", "y", None])))
    entries += [("e0/e0/e0/empty", "dir", None), ("a0", "dir", "ignored"), entries[0], (None, "file", "x"), ("", "dir", None)]
    got = {r.path: (r.files, r.digest) for r in trees.folder_digests(spark.createDataFrame(entries, ENTRIES)).collect()}
    assert got == brute_digests([e for e in entries if e[0]])


def test_equal_trees_have_equal_digests_wherever_they_are(spark):
    entries = [(f"{top}/x/{k}.txt", "file", str(k)) for top in ("one", "two") for k in range(300)] + [("three/x/0.txt", "file", "0")]
    got = {r.path: r.digest for r in trees.folder_digests(spark.createDataFrame(entries, ENTRIES)).collect()}
    assert got["one"] == got["two"] and got["one/x"] == got["two/x"] and got["one"] != got["three"] and len(got) == 7
    assert trees.folder_digests(spark.createDataFrame([], ENTRIES)).count() == 0


def walked(spark, entries, **names):
    return sorted((r.path, r.is_dir, r.reason, r.project) for r in trees.walk(spark.createDataFrame(entries, TREE), **names).collect())


def brute_walk(entries, max_depth=3, ignore=()):
    """From the root down, as a walk would go."""
    children, heads = {"": set()}, {}
    for path, is_dir, head in entries:
        parts = path.split("/")
        for n in range(1, len(parts) + 1):
            children.setdefault("/".join(parts[:n - 1]), set()).add(parts[n - 1])
            if n < len(parts) or is_dir:
                children.setdefault("/".join(parts[:n]), set())
        heads[path] = max(head or "", heads.get(path, ""))
    join = lambda d, n: f"{d}/{n}" if d else n

    def project(d):
        low = [n.lower() for n in children[d]]
        for kind, names, ends in trees.PROJECT_MARKERS:
            if any(n in names or n.endswith(ends) for n in low):
                return kind
        if any(n.endswith(trees.LATEX_COMPANIONS) for n in low) and any(n.lower().endswith(".tex") and "\\documentclass" in heads.get(join(d, n), "") for n in children[d]):
            return "latex"

    out, todo = [], [("", 0)]
    while todo:
        d, depth = todo.pop()
        for n in children[d]:
            p = join(d, n)
            if p not in children:
                out.append((p, False, None, None))
            elif n.lower() in trees.PACKAGE_NAMES or n.lower().endswith(trees.PACKAGE_ENDS):
                out.append((p, True, "package directory", None))
            elif n.startswith(".") or n in ignore:
                continue
            elif project(p):
                out.append((p, True, "project folder", project(p)))
            elif max_depth == 0:
                out.append((p, True, "top-level inbox folder", None))
            elif depth < max_depth:
                todo.append((p, depth + 1))
    return sorted(out)


def test_walks_equal_one_from_the_root(spark):
    rng = random.Random(2)
    folders = ["docs", "Films", "A.app", ".hidden", "build", "VIDEO_TS", "src", "x.framework"]
    files = ["a.txt", "package.json", "song.RPP", "cv.tex", "own.cls", "Makefile", ".git", "b.psd", "lone.tex", "noext"]
    entries = []
    for _ in range(120):
        path = "/".join([*(rng.choice(folders[:1] * 4 + folders) + str(rng.randrange(2)) * (rng.random() < 0.6) for _ in range(rng.randrange(6))), rng.choice(files[:1] * 6 + files)])
        entries.append((path, False, "% x\n\\documentclass{a}" if path.endswith("cv.tex") else None))
    entries += [("docs/empty", True, None), ("docs0/.git", True, None), (entries[0][0], False, None)]
    for names in ({}, {"max_depth": 0}, {"max_depth": 1, "ignore": ("build",)}):
        assert walked(spark, entries, **names) == brute_walk(entries, **names)


def test_the_root_is_no_project_and_nested_ones_are_handed_out_once(spark):
    entries = [("package.json", False, None), ("p/.git", True, None), ("p/q/package.json", False, None), ("p/q/A.app/x", False, None), ("p/q/r.txt", False, None), ("s/t.txt", False, None)]
    assert walked(spark, entries) == [("p", True, "project folder", "repository"), ("package.json", False, None, None), ("s/t.txt", False, None, None)]
    assert walked(spark, []) == []


def test_subtitles_with_a_tag_go_to_what_they_subtitle(spark):
    names = ["Song.wav", "Song.ass", "Song.face.ass", "Song.face.en.srt", "Other.face.ass", "My.Song.ass", "Doc.pdf", "Doc.notes.txt", "Only.srt", "Only.later.srt", ".hidden", "Film-poster.jpg", "Film.en.forced.srt"]
    rows = [("d", n) for n in names] + [("e", "Song.face.ass"), ("e", None)]
    got = {(r.dir, r.name): r.stem for r in trees.stems_with_adopted(spark.createDataFrame(rows, "dir string, name string")).collect()}
    stems = {n: got["d", n] for n in names}
    assert stems == {
        "Song.wav": "song", "Song.ass": "song", "Song.face.ass": "song", "Song.face.en.srt": "song", "Other.face.ass": "other.face", "My.Song.ass": "my.song", "Doc.pdf": "doc",
        "Doc.notes.txt": "doc.notes", "Only.srt": "only", "Only.later.srt": "only.later", ".hidden": ".hidden", "Film-poster.jpg": "film", "Film.en.forced.srt": "film",
    }
    assert got["e", "Song.face.ass"] == "song.face" and got["e", None] is None
