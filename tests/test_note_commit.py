"""The commit of notes makes a folder once, however many files it gets."""

from pyarrow import fs

from corpuskit.sources import note_writer as W


def test_a_folder_is_made_once(tmp_path, monkeypatch):
    root, calls = str(tmp_path / "vault"), []

    class Counted:
        def __init__(self):
            self.own = fs.LocalFileSystem()

        def __getattr__(self, name):
            return getattr(self.own, name)

        def create_dir(self, path, recursive=True):
            calls.append(path)
            self.own.create_dir(path, recursive=recursive)

    writer = W.NoteWriter(root)
    staged = []
    for task in range(3):
        folder = tmp_path / "vault" / writer.staging.rsplit("/", 1)[1] / f"task{task}"
        for i in range(300):
            (folder / f"a/b{i % 4}").mkdir(parents=True, exist_ok=True)
            (folder / f"a/b{i % 4}/{task}_{i}.md").write_text(f"{task} {i}")
        staged.append(W._Staged(str(folder), 300))
    monkeypatch.setattr(W, "file_system", lambda path: (Counted(), path))
    writer.commit([*staged, None])
    assert sorted(calls) == [f"{root}/a/b{i}" for i in range(4)]
    found = {p.relative_to(root).as_posix(): p.read_text() for p in tmp_path.rglob("*.md")}
    assert found == {f"a/b{i % 4}/{t}_{i}.md": f"{t} {i}" for t in range(3) for i in range(300)}
    assert [p.name for p in (tmp_path / "vault").iterdir()] == ["a"]
