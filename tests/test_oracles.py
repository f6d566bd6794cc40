"""Queries against their DuckDB SQL at sf0.001."""

import math

import duckdb
import pytest

from cellweave.jobs.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"
PICKED = ["s1_flatten_arrays", "s2_shape_violations", "s4_wide_cells", "a1_intensity_std", "a2_listed_cells", "a5_perimeter", "a6_p1_p2_features", "a7_hodges_lehmann", "g1_g2_kernel_sum", "g3_weighted_kernel", "j2_cells_with_metadata", "r8_resampled", "r9_to_scaled_grid", "g3_g5_g6_g9_analytic", "g4_radius", "g12_heteroscedasticity", "g14_fdr_column", "g14_fdr_plane", "c1_smooth_max", "c2_smoother", "r1_r2_r4_radial", "r11_shift_similarity", "b9_b10_what_if", "t5_closing",
          "a2_listed_areas", "a8_core_edge_permutation", "b1_subset_sums", "b10_sliding_what_if", "b11_histogram_by_angle", "b12_summaries_by_angle", "c5_bootstrap_share", "c6_marker_location", "a10_scored_features_job", "c7_marker_location_job", "w2_boundary_what_if_job", "r4_scaled", "t1_t2_random_transforms_of_cells", "t2_t3_padding", "t4_random_masks", "t6_affine_medians"]


def _value(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", PICKED)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    want = sorted((tuple(_value(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()), key=str)
    got = sorted((tuple(_value(r[c]) for c in sorted(names)) for r in QUERIES[name](spark, D).collect()), key=str)
    assert got == want


def test_every_query_is_registered():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
