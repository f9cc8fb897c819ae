"""Registered graph and statistics queries against their SQL."""

from __future__ import annotations

import duckdb
import pytest

from meshwork import registry

FOLDER = "/root/testdata/sf0.001"
#: Loops of many rounds, held against plain Python on small graphs in test_operators and test_structure; of the orders, stops and
#: overlap rules of expansion, which share their code, a few are compared here.
KEPT = {"expansion_breadth_first", "expansion_path_preserving", "expansion_pairwise", "heterogeneity_aware", "threshold_overlaps"}
LOOPS = {n for n in registry.SQL if n.startswith("expansion_") or n in ("seed_overlaps", "sphere_overlaps")} - KEPT
LOOPS |= {"ego_network", "strong_components", "weighted_distances", "topological_levels", "page_rank", "page_rank_ranking", "vertex_importance", "betweenness_ranking", "degree_mean_ranking", "length_ranking", "path_length_diversity", "bidirectional_search", "lightest_paths", "k_truss", "single_linkage_size", "complete_linkage", "elimination_order"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v) -> str:
    return f"{v:.7g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(set(registry.SQL) - LOOPS))
def test_as_sql_says(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = con.execute(registry.SQL[name])
    names = [x[0] for x in got.description]
    want = sorted(tuple(shown(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall())
    df = registry.QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(shown(v) for v in r) for r in df.select(*sorted(names)).collect()) == want
