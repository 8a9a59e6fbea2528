from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from sparkloom.operators import ledger

T0 = datetime(2025, 1, 1)
CANDIDATES = "candidate_id long, job_id string, source_id string, relative_path string, sha256 string, recorded_at timestamp, path string, token int"
PROGRESS = "report_id long, job_id string, source_id string, seq_no int, job_state string, files_total int, files_skipped int, started_at timestamp, committed string"


def progress(spark, *jobs):
    rows = []
    for n, (job, source, state, day) in enumerate(jobs):
        rows.append((2 * n, job, source, 1, "Running", 1, 0, T0 + timedelta(day), "x"))
        rows.append((2 * n + 1, job, source, 2, state, 1, 0, T0 + timedelta(day), None))
    return spark.createDataFrame(rows, PROGRESS)


def listing(spark, *rows):
    return spark.createDataFrame([(i, job, "s", path, sha, T0, None, 1) for i, (job, path, sha) in enumerate(rows, 1)], CANDIDATES)


def cases(spark, rows, jobs):
    return sorted(map(tuple, ledger.to_process(listing(spark, *rows), progress(spark, *jobs)).collect()))


def test_unchanged_files_are_skipped_and_case_of_hash_and_separator_do_not_matter(spark):
    rows = [("a", "x\\1", "AB"), ("b", "x/1", "ab"), ("b", "x/2", "cd")]
    assert cases(spark, rows, [("a", "s", "Succeeded", 0), ("b", "s", "Succeeded", 1)]) == [("a", 1), ("b", 3)]


def test_a_failed_job_leaves_its_items_pending(spark):
    rows = [("a", "x", "1"), ("b", "x", "1"), ("c", "x", "1")]
    jobs = [("a", "s", "Failed", 0), ("b", "s", "Succeeded", 1), ("c", "s", "Succeeded", 2)]
    assert cases(spark, rows, jobs) == [("a", 1), ("b", 2)]
    states = {(r.job_id, r.item_state) for r in ledger.replay(listing(spark, *rows), progress(spark, *jobs)).collect()}
    assert states == {("a", "pending"), ("b", "done"), ("c", "done")}


def test_null_hash_is_no_case_and_keeps_the_record_and_an_unlisted_file_is_forgotten(spark):
    jobs = [(j, "s", "Succeeded", i) for i, j in enumerate("abcde")]
    rows = [("a", "x", "1"), ("b", "x", None), ("c", "x", "1"), ("d", "y", "9"), ("e", "x", "1")]
    assert cases(spark, rows, jobs) == [("a", 1), ("d", 4), ("e", 5)]


def test_repeated_rows_count_once_with_the_lowest_id_and_nulls_are_left_out(spark):
    rows = [("a", "x", "1"), ("a", "x", "2"), ("a", None, "3"), (None, "x", "4")]
    assert cases(spark, rows, [("a", "s", "Succeeded", 0)]) == [("a", 1)]


def test_empty_tables(spark):
    none = listing(spark, ("a", "x", "1")).limit(0)
    assert ledger.to_process(none, progress(spark, ("a", "s", "Succeeded", 0))).count() == 0
    unreported = ledger.to_process(listing(spark, ("a", "x", "1")), progress(spark, ("b", "s", "Succeeded", 0)))
    assert unreported.count() == 1


def test_against_a_plain_replay(spark):
    import random

    rng = random.Random(3)
    jobs = [(f"j{i}", "s", rng.choice(["Succeeded", "Succeeded", "Failed", "Cancelled"]), i // 2) for i in range(14)]
    rows = [(j[0], f"p{rng.randrange(6)}", rng.choice(["1", "2", None])) for j in jobs for _ in range(5)]
    record, want, ids = {}, [], list(enumerate(rows, 1))
    for job, _, state, day in sorted(jobs, key=lambda j: (j[3], j[0])):
        files = defaultdict(list)
        for i, (own, path, sha) in ids:
            if own == job:
                files[path].append((i, sha))
        fresh = {}
        for path, seen in files.items():
            i, sha = min(seen)
            if sha is not None and record.get(path) != sha:
                want.append((job, i))
            fresh[path] = sha or record.get(path)
        if state == "Succeeded":
            record = fresh
    assert cases(spark, rows, jobs) == sorted(want)


def test_a_running_job_holds_its_leases(spark):
    rows = [("a", "x", "1"), ("b", "x", "2")]
    jobs = [("a", "s", "Succeeded", 0), ("b", "s", "Running", 1)]
    got = {(r.job_id, r.item_state, r.recorded_token) for r in ledger.replay(listing(spark, *rows), progress(spark, *jobs)).collect()}
    assert got == {("a", "done", None), ("b", "leased", 1)}


HOUR = timedelta(hours=1)


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "item string, version string")


def test_live_ledger_survives_failures(spark, tmp_path):
    book = ledger.WorkLedger(spark, str(tmp_path / "ledger"))
    listed = files(spark, ("a", "1"), ("b", "1"), ("b", "1"), ("c", None))
    first, items = book.lease(listed, "w1", T0, T0 + HOUR)
    assert sorted(r.item for r in items.collect()) == ["a", "b"]
    assert book.pending(listed, T0).count() == 0  # leased
    late = T0 + 2 * HOUR
    assert book.pending(listed, late).count() == 2  # expired: pending again
    second, again = book.lease(listed, "w2", late, late + HOUR)
    assert second.token > first.token and again.count() == 2
    with pytest.raises(ledger.StaleWriter):
        book.commit(first)
    with pytest.raises(ledger.StaleWriter):
        book.renew(first, late + HOUR)
    book.commit(second)
    book.commit(second)  # a retried commit changes nothing
    assert book.pending(listed, late).count() == 0
    changed = files(spark, ("a", "2"), ("b", "1"))
    assert [r.item for r in book.pending(changed, late).collect()] == ["a"]
    assert book.output_path(second) == book.output_path(second)
    # folded, the record is the same and goes on
    assert book.fold() == second.token
    third, _ = book.lease(changed, "w3", late, late + HOUR)
    book.commit(third)
    assert {(r.item, r.version) for r in book.done().collect()} == {("a", "2"), ("b", "1")}


def test_a_holder_that_dies_before_its_lease_stands_leaves_no_trace(spark, tmp_path, monkeypatch):
    book = ledger.WorkLedger(spark, str(tmp_path / "ledger"))
    plain = book._create
    monkeypatch.setattr(book, "_create", lambda name, text: (_ for _ in ()).throw(OSError("lost")) if name.startswith("leases") else plain(name, text))
    with pytest.raises(OSError):
        book.lease(files(spark, ("a", "1")), "w1", T0, T0 + HOUR)
    monkeypatch.setattr(book, "_create", plain)
    _, items = book.lease(files(spark, ("a", "1")), "w2", T0, T0 + HOUR)
    assert items.count() == 1


def test_of_two_holders_that_read_the_same_pending_items_one_gives_up(spark, tmp_path, monkeypatch):
    book, rival = (ledger.WorkLedger(spark, str(tmp_path / "ledger")) for _ in range(2))
    listed = files(spark, ("a", "1"), ("b", "1"))
    plain, got = book._create, []

    def slow(name, text):
        if name.startswith("leases") and not got:
            got.append(rival.lease(listed, "w2", T0, T0 + HOUR))  # between this holder's reading and its lease
        return plain(name, text)

    monkeypatch.setattr(book, "_create", slow)
    mine, items = book.lease(listed, "w1", T0, T0 + HOUR)
    assert got[0][1].count() == 2 and items.count() == 0 and mine.token > got[0][0].token
    rival.commit(got[0][0])
    book.commit(mine)
    assert {r.token for r in book.done().collect()} == {got[0][0].token}


def test_a_heartbeat_keeps_a_lease(spark, tmp_path):
    book = ledger.WorkLedger(spark, str(tmp_path / "ledger"))
    listed = files(spark, ("a", "1"))
    first, _ = book.lease(listed, "w1", T0, T0 + HOUR)
    book.renew(first, T0 + 5 * HOUR)
    assert book.lease(listed, "w2", T0 + 2 * HOUR, T0 + 3 * HOUR)[1].count() == 0
    book.commit(first)
