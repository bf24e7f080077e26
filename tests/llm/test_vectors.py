import numpy as np
import pytest

from arrears.llm import neardup_vectors as nv


def brute(rows, t=0.93):
    n = len(rows)
    ok = [lab is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                link[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= t
    comp = [r[0] for r in rows]
    for _ in range(n):
        for i in range(n):
            for j in np.flatnonzero(link[i]):
                comp[i] = min(comp[i], comp[j])
    return sorted((rows[i][0], int(link[i].sum()), comp[i], rows[i][0] == comp[i]) for i in range(n))


def data(dim=6, groups=25):
    rnd = np.random.default_rng(8)
    rows = []
    for g in range(groups):
        base = rnd.standard_normal(dim)
        for _ in range(rnd.integers(1, 9)):
            rows.append([float(x) for x in np.float32(base + rnd.standard_normal(dim) * 0.25)])
            if rnd.random() < 0.2:
                rows.append(rows[-1])
            if rnd.random() < 0.1:
                rows.append([x * 3 for x in rows[-1]])
    rows += [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0] * (dim + 1), [1.0] * (dim + 1), [1e30] * dim, [1e-30] * dim]
    return [(i, v, None if i % 17 == 0 else i % 3 and int(rnd.integers(0, 2))) for i, v in enumerate(rows)]


@pytest.mark.parametrize("kw", [{}, {"cell_goal": 12, "tile_rows": 5}, {"cell_goal": 4}])
def test_matches_brute_force(spark, kw):
    rows = data()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, cell string")
    got = sorted(tuple(r) for r in nv.near_duplicates(df, **kw).collect())
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert got == brute(rows)


def test_copies_leave_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(nv, "PLACED_VALUES", 30)
    df = spark.createDataFrame(data(), "vec_id long, embedding array<float>, label int")
    few = sorted(map(tuple, nv.near_duplicates(df, cell_goal=4).collect()))
    monkeypatch.undo()
    assert few == sorted(map(tuple, nv.near_duplicates(df, cell_goal=4).collect()))


def test_copies_are_made_in_rounds(spark, monkeypatch):
    """Without clusters all cells are near: no table grows with their number, rounds and slices look at each pair once, and results stay whole."""
    rnd, saved, save = np.random.default_rng(4), [], nv.Scratch.save
    rows = [(i, [float(x) for x in np.float32(rnd.standard_normal(16))], 1) for i in range(400)]
    rows += [(400 + i, [float(np.float32(x + 0.2 * rnd.standard_normal())) for x in rows[i // 3][1]], 1) for i in range(200)]

    def counted(self, df, name, **kw):
        out = save(self, df, name, **kw)
        saved.append((name, out.count()))
        return out

    monkeypatch.setattr(nv.Scratch, "save", counted)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, nv.near_duplicates(df, cell_goal=20, tile_rows=120, round_values=16 * 600).collect()))
    assert got == brute(rows)
    assert max(n for _, n in saved) <= len(rows)
    assert sum(name == "met" for name, _ in saved) >= 3


def test_small_margin_keeps_most_links(spark):
    df = spark.createDataFrame(data(16, 60), "vec_id long, embedding array<double>, label int")
    whole, fast = (sum(r.n_links for r in nv.near_duplicates(df, cell_goal=40, margin=m).collect()) for m in (None, 0.1))
    assert 0.9 * whole <= fast <= whole


def test_no_rows_and_repeated_rows(spark):
    ddl = "vec_id long, embedding array<float>, label int"
    assert nv.near_duplicates(spark.createDataFrame([], ddl)).count() == 0
    got = nv.near_duplicates(spark.createDataFrame([(7, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], ddl)).collect()
    assert sorted(map(tuple, got), key=str) == [(7, 2, 7, True), (7, 2, 7, True), (None, 2, 7, False)]
