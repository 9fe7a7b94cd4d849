"""The model of credentials is fitted on every labelled candidate, wherever it lies."""

import random

import numpy as np

from kestrel.functions.linear import bucket, newton
from kestrel.llm import secrets

REPOS = [r for r in (f"r{i}" for i in range(60)) if bucket("held:" + r, 8) % 5][:12] + ["held" + str(next(i for i in range(99) if bucket(f"held:held{i}", 8) % 5 == 0))]


def _value(rng, n=30):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))


def _table(spark, rows):
    """rows: name, value, path, repo, label."""
    full = [(i, repo, path, 1, 0, len(value), "literal", name, value, "", label) for i, (name, value, path, repo, label) in enumerate(rows)]
    return spark.createDataFrame(full, secrets.CANDIDATE_SCHEMA)


def test_no_labelled_candidate_is_left_out(spark):
    """12,000 candidates without a credential: words that only four of them have, each in another repository, are all known."""
    rng = random.Random(1)
    rare = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(30)]
    rows = [(f"title_{w}", f"some-words-{i}", "a/b.py", REPOS[i], 0) for w in rare for i in range(4)]
    rows += [("title", f"some-words-{i}", "a/b.py", REPOS[i % len(REPOS)], 0) for i in range(12_000 - len(rows))]
    rows += [("api_token", _value(rng), "a/b.py", REPOS[i % len(REPOS)], 1) for i in range(60)]
    m = secrets.fit(_table(spark, rows).repartition(3))
    assert {"n:" + w for w in rare} <= m.known
    assert m.n_rows == 12_060 and m.report["accuracy"] == 1.0


def test_long_values_are_fitted_on(spark):
    """All credentials with a label are long; without them nothing could be fitted."""
    rng = random.Random(2)
    rows = [("api_token", _value(rng, 20_100), "a/b.py", REPOS[i % len(REPOS)], 1) for i in range(26)]
    rows += [("title", f"some-words-{i}", "a/b.py", REPOS[i % len(REPOS)], 0) for i in range(100)]
    m = secrets.fit(_table(spark, rows))
    assert m.fitted and m.score("literal", "api_token", _value(rng, 20_100), "a/b.py") > 0.5 > m.score("literal", "title", "some-words-7", "a/b.py")


def test_sums_of_the_cluster_are_those_of_one_table(spark, monkeypatch):
    """Whatever the partitions, blocks and tasks, the model is the one of the same rows in memory."""
    rng = random.Random(3)
    rows = []
    for i in range(500):
        name, value = [("api_token", _value(rng)), ("commit", f"{rng.randrange(16**39, 16**40):040x}"), ("title", f"some-name-{i}"), ("db_url", "ghp_" + _value(rng))][i % 4]
        rows.append((name, value, f"a/f{i}.py", REPOS[i % len(REPOS)], int(i % 4 in (0, 3))))
    monkeypatch.setattr(secrets, "STEPS", 30)
    here = secrets.Model([("literal", *r[:3], "", *r[3:]) for r in rows])
    for task_rows in (100, 1_000):  # several tasks, then one
        monkeypatch.setattr(secrets, "TASK_ROWS", task_rows)
        there = secrets.fit(_table(spark, rows + [("x", _value(rng), "a/b.py", "r", -1)]).repartition(7))
        assert here.known == there.known and here.n_rows == there.n_rows and np.array_equal(here.chain.logs, there.chain.logs)
        asked = [("literal", *r[:3]) for r in rows]
        assert np.allclose([here.score(*a) for a in asked], [there.score(*a) for a in asked], atol=1e-6)


def test_one_repository_and_few_rows():
    """Without repositories to hold back, other ways to calibrate are taken; with one class nothing is fitted."""
    rng = random.Random(4)
    for n in (1, 2, 40):
        rows = [("literal", "api_token", _value(rng), "a/b.py", "", "r", 1) for _ in range(n)] + [("literal", "title", f"some-words-{i}", "a/b.py", "", "r", 0) for i in range(n)]
        m = secrets.Model(rows)
        assert m.fitted and all((m.score(*r[:5]) > 0.5) == bool(r[6]) for r in rows)
        assert not secrets.Model(rows[:n]).fitted


def test_newton_finds_the_least_loss():
    rng = np.random.default_rng(5)
    a, y = rng.normal(size=(40, 2)), rng.normal(size=40)
    assert np.allclose(newton(lambda w: (a.T @ (a @ w - y), a.T @ a), 2), np.linalg.lstsq(a, y, rcond=None)[0], atol=1e-6)
