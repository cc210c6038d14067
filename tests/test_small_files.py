"""Very many small files are opened without what Arrow sets up for each of them."""

import hashlib

from framewright.sources import files


def test_local_files_are_probed_without_arrow(tmp_path, monkeypatch):
    bodies = {"a.jpg": b"x" * 700, "b.jpg": b"", "c.jpg": bytes(range(256)) * 9}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    (tmp_path / "folder").mkdir()
    monkeypatch.setattr(files, "open_file", lambda path: 1 / 0)
    monkeypatch.setattr(files, "READ_BYTES", 100)  # several blocks
    for name, body in bodies.items():
        assert files._probe(f"{tmp_path}/{name}", ("md5", "sha256"))[1:3] == (hashlib.md5(body).hexdigest(), hashlib.sha256(body).hexdigest())
        assert files.file_head(f"{tmp_path}/{name}")[0] == body
    for missing in ("none.jpg", "folder"):
        assert files._probe(f"{tmp_path}/{missing}", ("md5",)) == (f"{tmp_path}/{missing}", None, None)
        assert files.file_head(f"{tmp_path}/{missing}") == (b"", {})
