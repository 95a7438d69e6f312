"""Claims and commits with writers that meet."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest

from tidemark.streaming import commits


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/shared"


def test_of_many_claims_one_wins(spark, folder):
    for round_ in range(5):
        with ThreadPoolExecutor(12) as pool:
            won = list(pool.map(lambda k, r=round_: commits.claim(spark, folder, f"w{r}", "send", f"run{k}"), range(12)))
        assert sum(won) == 1
        holder = commits.text_at(spark, f"{folder}/w{round_}/send")
        assert won[int(holder.removeprefix("run"))]
        assert commits.claim(spark, folder, f"w{round_}", "send", holder)  # it may go on after a restart
        assert not commits.release(spark, folder, f"w{round_}", "send", "another")
        assert commits.release(spark, folder, f"w{round_}", "send", holder)
        assert commits.claim(spark, folder, f"w{round_}", "send", "another")


def add(spark, rows):
    new = spark.createDataFrame(rows, "k int, v string")
    return lambda now: new if now is None else now.unionByName(new)


def test_a_commit_that_meets_another_is_computed_anew(spark, folder):
    def slow(now):
        if not met:
            met.append(commits.commit(spark, folder, {"rows": add(spark, [(1, "other")])}))
        return add(spark, [(2, "mine")])(now)

    met = []
    assert commits.commit(spark, folder, {"rows": slow, "log": add(spark, [(0, "mine")])}) == 2
    assert met == [1]
    assert sorted(map(tuple, commits.read(spark, folder, "rows").collect())) == [(1, "other"), (2, "mine")]
    assert commits.read(spark, folder, "log").count() == 1
    assert commits.read(spark, folder, "none") is None


def test_a_writer_that_always_loses_gives_up_and_changes_nothing(spark, folder):
    def meets(now):
        commits.commit(spark, folder, {"rows": add(spark, [(1, "other")])})
        return add(spark, [(2, "mine")])(now)

    with pytest.raises(commits.Lost):
        commits.commit(spark, folder, {"rows": meets}, attempts=3)
    assert [r["v"] for r in commits.read(spark, folder, "rows").collect()] == ["other"] * 3


def test_concurrent_writers_lose_no_row(spark, folder):
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda k: commits.commit(spark, folder, {"rows": add(spark, [(k, "x")])}, attempts=30), range(6)))
    assert sorted(numbers) == [1, 2, 3, 4, 5, 6]
    assert sorted(r["k"] for r in commits.read(spark, folder, "rows").collect()) == [0, 1, 2, 3, 4, 5]
    commits.forget(spark, folder)
    assert sorted(r["k"] for r in commits.read(spark, folder, "rows").collect()) == [0, 1, 2, 3, 4, 5]
    assert commits.latest(spark, folder)[0] == 6
