import os
from datetime import datetime, timedelta

import pytest

from sparkloom.plans.refresh import Chunking, Corpus

T0 = datetime(2025, 1, 1)
HOUR = timedelta(hours=1)


def write(root, name, text):
    (root / name).parent.mkdir(parents=True, exist_ok=True)
    (root / name).write_bytes(text if isinstance(text, bytes) else text.encode())


def held(corpus):
    return {r.relative_path: r.content for r in corpus.chunks().collect()}


def test_runs_read_only_what_changed(spark, tmp_path):
    root = tmp_path / "w"
    for name, text in (("a.py", "def a():\n    pass\n"), ("b.md", "# B\n\ntext\n"), ("out.lock", "x"), ("bad.docx", b"no archive")):
        write(root, name, text)
    corpus = Corpus(spark, str(root), str(tmp_path / "store"))
    first = corpus.refresh("w1", T0)
    assert first.counts == {"listed": 3, "settled": 0, "same content": 0, "indexed": 2, "failed": 1, "deleted": 0}
    assert set(held(corpus)) == {"a.py", "b.md"} and "def a()" in held(corpus)["a.py"]
    again = corpus.refresh("w1", T0 + HOUR)
    assert again.counts["indexed"] == again.counts["failed"] == 0 and again.counts["settled"] == 3
    os.utime(root / "a.py", (1, 1))  # touched, not changed
    write(root, "b.md", "# B\n\nother\n")
    write(root, "c/d.py", "x = 1\n")
    third = corpus.refresh("w1", T0 + 2 * HOUR)
    assert (third.counts["indexed"], third.counts["same content"]) == (2, 1)
    assert "other" in held(corpus)["b.md"] and set(held(corpus)) == {"a.py", "b.md", "c/d.py"}
    (root / "a.py").unlink()
    assert corpus.refresh("w1", T0 + 3 * HOUR).counts["deleted"] == 1
    assert set(held(corpus)) == {"b.md", "c/d.py"}
    # another chunking reads all again
    other = Corpus(spark, str(root), str(tmp_path / "store"), Chunking(size=128))
    assert other.refresh("w1", T0 + 4 * HOUR).counts["indexed"] == 2


def test_a_run_that_dies_leaves_its_files_pending(spark, tmp_path, monkeypatch):
    root = tmp_path / "w"
    write(root, "a.py", "x = 1\n")
    corpus = Corpus(spark, str(root), str(tmp_path / "store"))
    plain = corpus.book.commit
    monkeypatch.setattr(corpus.book, "commit", lambda lease: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        corpus.refresh("w1", T0)
    monkeypatch.setattr(corpus.book, "commit", plain)
    assert corpus.chunks().count() == 0
    assert corpus.refresh("w2", T0).counts["indexed"] == 0  # still leased
    assert corpus.refresh("w2", T0 + 2 * HOUR).counts["indexed"] == 1 and corpus.chunks().count() == 1
