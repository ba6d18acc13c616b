import numpy as np
import pytest

from oddsloom.llm import embedding_dedup as ed


def data():
    r = np.random.default_rng(1)
    rows = [(i, r.standard_normal(32).astype(np.float32).tolist()) for i in range(300)]
    base = r.standard_normal(32)
    rows += [(300 + i, (base + 0.05 * r.standard_normal(32)).astype(np.float32).tolist()) for i in range(80)]
    for i in range(60):
        v = np.array(rows[i][1])
        rows.append((400 + i, (v + 0.18 * r.standard_normal(32)).astype(np.float32).tolist()))
    rows += [(500, rows[7][1]), (501, rows[7][1]), (502, None), (503, []), (504, [0.0] * 32), (505, [float("nan")] * 32), (506, [1.0, None]), (507, [1.0, float("inf")]), (508, [1.0, 2.0]), (509, [2.0, 4.0]), (510, (np.array(rows[8][1]) * 3).tolist()), (511, (np.array(rows[8][1]) * -1).tolist())]
    return rows


def brute(rows):
    good = {i: np.array(v, dtype=float) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {i: set() for i, _ in rows}
    for i, x in good.items():
        for j, y in good.items():
            if i < j and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                links[i].add(j)
                links[j].add(i)
    component = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in component:
                component[k] = i
                todo += links[k]
    return links, component


@pytest.mark.parametrize("block", [512, 20])
def test_recall_and_exactness(spark, monkeypatch, block):
    monkeypatch.setattr(ed, "BLOCK", block)
    rows = data()
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, bucket string").repartition(4)
    found = {r["id"]: r for r in ed.embedding_components(frame).collect()}
    links, component = brute(rows)
    assert sum(r["n_links"] for r in found.values()) >= 0.97 * sum(map(len, links.values()))
    assert all(r["n_links"] <= len(links[i]) for i, r in found.items())
    assert sum(r["component_id"] != component[i] for i, r in found.items()) <= 3
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())
    assert found[501]["component_id"] == 7 and found[508]["n_links"] == 1 and found[502]["n_links"] == 0


def test_empty_and_one(spark):
    kind = "vec_id long, embedding array<float>"
    assert ed.embedding_components(spark.createDataFrame([], kind)).count() == 0
    assert ed.embedding_components(spark.createDataFrame([(1, [1.0])], kind)).first()["kept"]


def test_pairs_at_the_threshold_and_next_to_it(spark):
    """Cosines of 0.9 exactly, a hair below, and of scaled vectors."""
    one = [1.0] + [0.0] * 7
    at = [9.0, 3.0, 3.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    below = [9.0, 3.0, 3.0, 1.0 + 1e-12, 0.0, 0.0, 0.0, 0.0]
    rows = [(0, one)] + [(1 + k, [v * s for v in at]) for k, s in enumerate((1.0, 3.0, 2.0**-40, 1e150))] + [(9, below)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r["id"]: r["n_links"] for r in ed.embedding_components(frame).collect()}
    links, _ = brute([(i, v if max(v) < 1e100 else at) for i, v in rows])
    assert found == {i: len(x) for i, x in links.items()} and 9 not in links[0] and {1, 2, 3, 4} <= links[0]


def test_an_id_on_different_vectors(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [1.0, 0.01]), (8, [0.01, 1.0]), (8, [0.01, 1.0])]
    found = sorted((r["id"], r["n_links"], r["component_id"]) for r in ed.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert found == [(5, 1, 5), (5, 2, 5), (7, 1, 5), (8, 2, 5), (8, 2, 5)]


def test_a_dense_group_sends_a_row_a_vector(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 64)
    r = np.random.default_rng(3)
    base = r.standard_normal(16)
    frame = spark.createDataFrame([(i, (base + 0.01 * r.standard_normal(16)).tolist(), 1) for i in range(300)], "id long, vector array<double>, copies long")
    sent = ed.links_and_edges(frame, 1, 3, 0.9).collect()
    assert len(sent) <= 3 * 300 * 5 and sum(x["links"] for x in sent) == 300 * 299
