"""Fits in segments: the draws of a fit in one go, whatever ended in between."""

import os
import shutil

import pytest

from quadrat.plans.durable import fit_durably
from quadrat.plans.fit import fit
from test_fit import small

SIZE = dict(chains=2, samples=4, transient=3, thin=2, seed=9)


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(path) for f in fs}


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).isEmpty()


@pytest.mark.parametrize("how", [{}, {"hmc_every": 2, "leaps": 3}])
def test_a_fit_that_was_ended_goes_on_with_equal_draws(spark, tmp_path, how):
    whole = fit(spark, small(), **SIZE, **how)
    path = str(tmp_path / "chains")
    assert same(fit_durably(spark, small(), path, every=4, **SIZE, **how), whole)
    # it was ended while its last segment was written: no mark, half a table
    before = files(path)
    last = f"{path}/segment-000002"
    os.remove(f"{last}/_SUCCESS")
    for f in os.listdir(last)[:1]:
        os.remove(f"{last}/{f}")
    again = fit_durably(spark, small(), path, every=4, **SIZE, **how)
    assert same(again, whole)
    after = files(path)
    assert all(after[f] == t for f, t in before.items() if "segment-000002" not in f)
    # complete: nothing runs again
    assert same(fit_durably(spark, small(), path, every=4, **SIZE, **how), whole) and files(path) == after
    # only the first segment is left
    for k in (1, 2):
        shutil.rmtree(f"{path}/segment-{k:06d}")
    assert same(fit_durably(spark, small(), path, every=4, **SIZE, **how), whole)


def test_a_folder_of_another_fit_is_refused(spark, tmp_path):
    path = str(tmp_path / "chains")
    fit_durably(spark, small(), path, every=100, **SIZE)
    with pytest.raises(ValueError, match="another fit"):
        fit_durably(spark, small(), path, every=100, **SIZE | {"seed": 10})


def test_a_lost_task_repeats_its_segment(spark, tmp_path, monkeypatch):
    import quadrat.plans.durable as durable

    path, flag = str(tmp_path / "chains"), str(tmp_path / "failed")
    plain = durable.run

    def failing(model, chain, *a, held=None, **k):
        if held and chain == 1 and not os.path.exists(flag):
            open(flag, "w").close()
            raise OSError("an executor went")
        yield from plain(model, chain, *a, held=held, **k)

    from pyspark import cloudpickle

    monkeypatch.setattr(durable, "run", failing)
    cloudpickle.register_pickle_by_value(durable)
    try:
        with pytest.raises(Exception, match="executor went"):  # one process tries a task once
            fit_durably(spark, small(), path, every=4, **SIZE)
        assert same(fit_durably(spark, small(), path, every=4, **SIZE), fit(spark, small(), **SIZE))
    finally:
        cloudpickle.unregister_pickle_by_value(durable)
