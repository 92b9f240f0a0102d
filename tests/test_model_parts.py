"""Models as folders of JSON lines."""

import json

import pytest

from quadrat.sources import model_parts


def put(path, key, *files):
    (path / key).mkdir(parents=True)
    for n, lines in enumerate(files):
        (path / key / f"{n}.json").write_text("".join(json.dumps(x) + "\n" for x in lines))


def test_lines_in_any_order_and_file(spark, tmp_path):
    put(tmp_path, "YScaled", [{"row": 3, "v": [1.5, "NA", None]}, {"row": 1, "v": [0, 1, "NaN"], "note": "x"}], [{"row": 2, "v": [2]}], [])
    put(tmp_path, "Pi", [{"row": i, "v": [i, 1]} for i in (2, 1, 3)])
    put(tmp_path, "distr", [{"row": 1, "v": [1, 1]}], [{"row": 2, "v": [2, 0]}, {"row": 3, "v": [3, 0]}])
    t = model_parts.tables(spark, str(tmp_path))
    assert sorted(tuple(r) for r in t["y"].filter("y is not null").collect()) == [(0, 0, 0.0), (0, 1, 1.0), (1, 0, 2.0), (2, 0, 1.5)]
    assert t["y"].count() == 7 and t["x"].isEmpty() and t["similarity"].isEmpty()
    assert sorted(tuple(r) for r in t["pi"].collect()) == [(0, 0, 0), (0, 1, 0), (1, 0, 1), (1, 1, 0), (2, 0, 2), (2, 1, 0)]
    assert sorted(tuple(r) for r in t["species"].collect()) == [(0, 1, 1), (1, 2, 0), (2, 3, 0)]
    assert tuple(model_parts.dims(spark, str(tmp_path)).first()) == (3, 3, 0, 0, 2)
    put(tmp_path / "b", "YScaled", [{"row": 1, "v": [0]}], [{"row": 1, "v": [0]}])
    with pytest.raises(Exception, match="row 1 of YScaled is there twice"):
        model_parts.dims(spark, str(tmp_path / "b")).collect()
    put(tmp_path / "c", "YScaled", [])
    assert tuple(model_parts.dims(spark, str(tmp_path / "c")).first()) == (0, 0, 0, 0, 0)
    assert model_parts.levels(spark, str(tmp_path)).isEmpty() and model_parts.state(spark, str(tmp_path)).isEmpty()


def test_missing_cells_are_written_as_null(spark, tmp_path):
    cells = spark.createDataFrame([(0, 2, 1.0), (0, 0, None), (5, 1, 3.0)], "site long, species int, y double")
    model_parts.write_matrix(cells, str(tmp_path), "YScaled", "site", "species", "y")
    got = model_parts.matrix(spark, str(tmp_path), "YScaled", "site", "species", "y")
    assert sorted((tuple(r) for r in got.collect()), key=str) == [(0, 0, None), (0, 1, None), (0, 2, 1.0), (5, 0, None), (5, 1, 3.0)]
