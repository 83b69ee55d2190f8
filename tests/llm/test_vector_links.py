"""Search over inverted lists and product codes against comparing all pairs."""

from pathlib import Path

import numpy as np
import pytest

from ledgerlake.llm import vector_links
from ledgerlake.session import ensure_checkpoint_dir

COS = 0.95


def brute(rows, similar=COS):
    good = {}
    for i, (_, v) in enumerate(rows):
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float)
    links = {i: set() for i in range(len(rows))}
    for i, a in good.items():
        for j, b in good.items():
            if i != j and len(a) == len(b) and (a / np.linalg.norm(a)) @ (b / np.linalg.norm(b)) >= similar:
                links[i].add(j)
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((str(vec_id), len(links[i]), component, vec_id == component))
    return sorted(out, key=str)


def run(spark, rows, parts=3, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as id", "'k' as key", "'v' as vector")
    out = vector_links.linked_vectors(df.repartition(parts))
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted([(str(r[0]), *r[1:]) for r in out.collect()], key=str)


def planted(n, dims, groups, seed, close=0.3):
    """Random vectors, and groups of vectors at cosines around the threshold with their centre."""
    r = np.random.default_rng(seed)
    rows = [r.normal(size=dims) for _ in range(n)]
    for g in range(groups):
        for _ in range(g + 2):
            a = rows[g] / np.linalg.norm(rows[g])
            side = r.normal(size=dims)
            side -= (side @ a) * a
            side /= np.linalg.norm(side)
            cosine = r.uniform(0.9, 1.0)
            rows.append((cosine * a + (1 - cosine**2) ** 0.5 * side) * r.uniform(0.1, 9))
    rows += [rows[0].copy() for _ in range(4)]
    order = r.permutation(len(rows))
    return [(int(i) * 3, [float(x) for x in rows[j]]) for i, j in enumerate(order)]


@pytest.mark.parametrize("dims", [2, 16, 64])
def test_equals_comparing_all_pairs(spark, dims):
    rows = planted(150, dims, 8, dims)
    assert run(spark, rows) == brute(rows)


def test_small_blocks_split_lists_and_queries(spark, monkeypatch):
    monkeypatch.setattr(vector_links, "BLOCK", 16)
    rows = planted(120, 16, 9, 4)
    assert run(spark, rows) == brute(rows)


def test_vectors_without_links_lengths_and_ids(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [-0.0, 0.0])]
    rows += [(8, [1.0, 0.0]), (9, [1.0, -0.0]), (10, [2.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [1.0]), (13, [-1.0]), (12, [5.0])]
    rows += [(None, [0.0, 1.0]), (None, [0.0, 1.0]), (20, [1e-200, 1e-200]), (21, [1e200, 1e200]), (22, [-1.0, 0.001]), (None, [-1.0, 0.0])]
    assert run(spark, rows) == brute([(i, None if v is None else [x if x is None or not 1e99 < abs(x) < inf else x / 1e200 for x in v]) if i == 21 else (i, v) for i, v in rows if i != 20] + [(20, [1.0, 1.0])])


def test_lengths_that_the_sample_lacks(spark, monkeypatch):
    """Nothing is sampled: every vector lies in a list of its length, compared without codes."""
    monkeypatch.setattr(vector_links, "SAMPLE", 0)
    rows = planted(40, 5, 4, 6) + [(1000 + i, v) for i, v in planted(40, 7, 4, 7)]
    assert run(spark, rows) == brute(rows)


def test_empty_tables_and_layout(spark):
    assert run(spark, []) == []
    assert run(spark, [(5, None)]) == [("5", 0, 5, True)]
    rows = planted(80, 24, 5, 1)
    assert run(spark, rows, parts=1, kind="float") == run(spark, rows, parts=7, kind="float")


def test_recall_of_the_probes():
    """Pairs right at the threshold, in many lists: the share that at least one side's probes reach."""
    r = np.random.default_rng(5)
    a = vector_links.units(r.normal(size=(20_000, 64)))
    side = r.normal(size=a.shape)
    side -= np.einsum("ij,ij->i", side, a)[:, None] * a
    b = COS * a + (1 - COS**2) ** 0.5 * vector_links.units(side)
    index = vector_links.Index(np.concatenate([a, b]), 512, 0)
    distance = (2 - 2 * COS) ** 0.5
    found = 0
    for lo in range(0, 4000, 1000):
        la, _, _, _, pa_ = index.code(a[lo : lo + 1000], distance)
        lb, _, _, _, pb = index.code(b[lo : lo + 1000], distance)
        found += sum(y in set(p) or x in set(q) for x, y, p, q in zip(la, lb, pa_, pb, strict=True))
    assert found / 4000 > 0.995


def test_codes_rule_no_partner_out():
    """|x - q| <= r + e for every pair within r."""
    r = np.random.default_rng(2)
    a = vector_links.units(r.normal(size=(3000, 32)))
    b = vector_links.units(a + 0.05 * r.normal(size=a.shape))
    index = vector_links.Index(a, 64, 0)
    near, codes, norm, away, _ = index.code(b, 0.3)
    q = index.coarse[near].astype(float)
    for m, (p, w) in enumerate(zip(index.parts, index.words, strict=True)):
        q[:, p] += w[codes[:, m]]
    assert np.allclose(norm, (q * q).sum(axis=1))
    assert (np.sqrt(((a - q) ** 2).sum(axis=1)) <= np.sqrt(((a - b) ** 2).sum(axis=1)) + away + 1e-9).all()


def test_bins_take_turns_and_leave_no_vectors(spark, monkeypatch):
    """Every turn deals a part of the bins, and no working table with vectors stays."""
    monkeypatch.setattr(vector_links, "BLOCK", 64)
    monkeypatch.setattr(vector_links, "TURN", 1, raising=False)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in planted(600, 64, 20, 3)]
    at = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    there = set(at.iterdir())
    assert run(spark, rows, kind="float") == brute(rows)
    new = set(at.iterdir()) - there
    assert sum(p.name.startswith("vector-links") for p in new) > 3
    assert sum(f.stat().st_size for p in new if "vector" in p.name for f in p.rglob("*.parquet") if "links" not in p.name) < 256 * len(rows)


def test_components_of_32_bits(spark):
    """Kept as they are, whatever their size."""
    values = [[1e-40, 3e-40], [3e38, -3e38], [1.5, float("inf")], [2e-45, 0.0], [-0.0, 7.0], [0.0, 0.1], [1e-40, None], [1e38, -1e38]]
    rows = [(i, [x if x is None else float(np.float32(x)) for x in v]) for i, v in enumerate(values)]
    assert run(spark, rows, kind="float") == brute(rows)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """All pairs of the group are links; several blocks find parts of it."""
    monkeypatch.setattr(vector_links, "BLOCK", 32)
    r = np.random.default_rng(8)
    middle = r.normal(size=24)
    rows = [(i, [float(x) for x in middle + 0.01 * r.normal(size=24)]) for i in range(150)]
    rows += [(1000 + i, [float(x) for x in r.normal(size=24)]) for i in range(50)]
    assert run(spark, rows) == brute(rows)
