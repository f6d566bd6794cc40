"""The registered queries over the operators, each beside its DuckDB SQL where SQL can express it.

Doubles are rounded to six places on both sides, zero is written without a sign.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.special import phi_sql
from cellweave.jobs import workloads
from cellweave.operators import affine, cells, hotspot, polar, scores, shapes, stencil
from cellweave.sources import fixtures as fx
from cellweave.sources import images

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(F.col(f"`{c}`"), 6) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(f"`{c}`").cast("bigint").alias(c) if t in ("int", "bigint") else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, d: rounded(f(spark, d))
        if sql:
            # every column of the select list is rounded as on the Spark side
            SQL[name] = f"{fx.SQL}, " + sql.strip() if sql.strip().lower().startswith("w ") else f"{fx.SQL} {sql.strip()}"
        return f

    return register


def D(x: str, name: str) -> str:
    """A rounded double column."""
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0 AS {name}"


def L(x: str, name: str) -> str:
    return f'CAST({x} AS BIGINT) AS {name}'


O = '"ObjectNumber"'  # noqa: E741
KEYS = f"image_id, {L(O, O)}, channel"
_PIX = f"image_id, channel, {L('row', 'row')}, {L('col', 'col')}"


# --- sources and per-cell aggregates ---------------------------------------------------------------------------------


@query("s1_flatten_arrays", f"SELECT image_id, channel, {L('row', 'row')}, {L('col', 'col')}, {D('value', 'value')}, {L(O, 'label')} FROM cl")
def s1(spark, d):
    p = fx.pixels(spark, d)
    arrays = p.groupBy("image_id", "channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "value"))), lambda s: s["value"]).alias("data"))
    dense = arrays.withColumn("height", F.lit(fx.SIDE)).withColumn("width", F.lit(fx.SIDE))
    return images.foreground(images.pixels_from_arrays(dense), fx.mask(spark, d))


@query("s2_shape_violations", f"w AS (SELECT * FROM px WHERE NOT (channel = 'R' AND value = 0)) SELECT p.image_id, 'R' AS channel, {L('(SELECT count(*) FROM w x WHERE x.image_id = p.image_id AND x.channel = chr(82))', 'n_pixels')}, {L('count(*)', 'n_mask')}, {L('count(*) FILTER (p.value = 0)', 'missing')}, {L('0', 'extra')} FROM px p WHERE channel = 'R' GROUP BY p.image_id HAVING count(*) FILTER (p.value = 0) > 0")
def s2(spark, d):
    return images.shape_violations(fx.pixels(spark, d).where("not (channel = 'R' and value = 0)"), fx.mask(spark, d))


@query("s3_channel_names", f"SELECT {L('p_partkey', 'idx')}, p_brand AS name, CASE WHEN count(*) OVER (PARTITION BY p_brand) > 1 THEN p_brand || '_' || row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) ELSE p_brand END AS channel FROM part")
def s3(spark, d):
    return images.unique_names(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("idx"), F.col("p_brand").alias("name")))


_WIDE = ", ".join(f"{D(f'avg(value) FILTER (channel = {chr(39)}{c}{chr(39)})', f'{chr(34)}{c}_MEAN{chr(34)}')}, {D(f'max(value) FILTER (channel = {chr(39)}{c}{chr(39)})', f'{chr(34)}{c}_MAX{chr(34)}')}" for c in fx.CHANNELS)


@query("s3_chosen_channels", f"SELECT {_PIX}, {D('value', 'value')} FROM px WHERE channel IN ('A', 'R')")
def s3_chosen(spark, d):
    return images.chosen_channels(fx.pixels(spark, d), ["A", "R"])


@query("j2_cells_with_metadata", f"w AS (SELECT image_id, l_suppkey % 50 AS o, count(*) AS n, sum(CAST(l_quantity AS DOUBLE)) AS q FROM ln GROUP BY ALL) SELECT {KEYS}, {D('avg(value)', 'value')}, {L('any_value(n)', 'lines')}, {D('any_value(q)', 'quantity')} FROM cl JOIN w ON w.image_id = cl.image_id AND w.o = cl.{O} GROUP BY cl.image_id, cl.{O}, channel".replace("SELECT image_id, CAST", "SELECT cl.image_id, CAST"))
def j2(spark, d):
    info = fx._lines(spark, d).groupBy("image_id", (F.col("l_suppkey") % 50).cast("int").alias("ObjectNumber")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("double")).alias("quantity"))
    return images.with_metadata(cells.cell_intensities(fx.pixels(spark, d), fx.mask(spark, d)).select(*cells.KEY, "value"), info)


@query("s4_wide_cells", f"SELECT image_id, {L(O, O)}, {_WIDE} FROM cl GROUP BY image_id, {O}")
def s4(spark, d):
    p, m = fx.pixels(spark, d), fx.mask(spark, d)
    both = cells.cell_intensities(p, m).join(cells.cell_intensities(p, m, "max").select(*cells.KEY, F.col("value").alias("top")), cells.KEY)
    return images.wide(both, fx.CHANNELS, {"value": "MEAN", "top": "MAX"})


for _kind, _agg in (("mean", "avg(value)"), ("max", "max(value)"), ("std", "stddev_pop(value)")):

    @query(f"a1_intensity_{_kind}", f"SELECT {KEYS}, {D(_agg, 'value')}, {L('count(*)', 'area')}, {D('avg(row)', 'x')}, {D('avg(col)', 'y')} FROM cl GROUP BY image_id, {O}, channel")
    def a1(spark, d, kind=_kind):
        return cells.cell_intensities(fx.pixels(spark, d), fx.mask(spark, d), kind)


@query("a2_listed_cells", f"w AS (SELECT DISTINCT image_id, l_suppkey % 50 AS o FROM ln), a AS (SELECT image_id, {O}, channel, avg(value) AS v FROM cl GROUP BY ALL), ch AS (SELECT DISTINCT image_id, channel FROM px) SELECT w.image_id, {L('o', O)}, ch.channel, {D('v', 'value')} FROM w JOIN ch USING (image_id) LEFT JOIN a ON a.image_id = w.image_id AND a.channel = ch.channel AND a.{O} = o")
def a2(spark, d):
    listed = fx._lines(spark, d).select("image_id", (F.col("l_suppkey") % 50).cast("int").alias("ObjectNumber")).distinct()
    return cells.listed_intensities(fx.pixels(spark, d), fx.mask(spark, d), listed)


@query("a2_listed_areas", f"w AS (SELECT DISTINCT image_id, label + 10 AS o FROM mk WHERE label <> 0), c AS (SELECT w.image_id, o, u.c AS channel FROM w, (VALUES ('A'), ('N'), ('R')) u(c)) SELECT c.image_id, {L('o', O)}, c.channel, {D('count(cl.value)', 'value')} FROM c LEFT JOIN cl ON cl.image_id = c.image_id AND cl.{O} = o AND cl.channel = c.channel GROUP BY c.image_id, o, c.channel")
def a2_areas(spark, d):
    m = fx.mask(spark, d)
    listed = m.where("label <> 0").select("image_id", (F.col("label") + 10).alias("ObjectNumber"))
    return cells.listed_intensities(fx.pixels(spark, d), m, listed, "area")


@query("a3_a4_boxes_centroids", f"SELECT image_id, {L('label', O)}, {D('avg(row)', 'x')}, {D('avg(col)', 'y')}, {L('min(row)', 'r0')}, {L('min(col)', 'c0')}, {L('max(row) + 1', 'r1')}, {L('max(col) + 1', 'c1')} FROM mk WHERE label <> 0 GROUP BY image_id, label")
def a3(spark, d):
    return cells.boxes(fx.mask(spark, d))


_EDGE = """pe AS (SELECT a.image_id, a.row, a.col, a.label, count(b.label) < 4 AS is_edge FROM mk a LEFT JOIN mk b ON a.image_id = b.image_id AND a.label = b.label AND abs(a.row - b.row) + abs(a.col - b.col) = 1
 WHERE a.label <> 0 GROUP BY ALL),
ec AS (SELECT image_id, channel, label AS "ObjectNumber", row, col, value, is_edge FROM px JOIN pe USING (image_id, row, col))"""


@query("a5_perimeter", f"w AS (SELECT 1), {_EDGE} SELECT image_id, {L('row', 'row')}, {L('col', 'col')}, {L('label', 'label')}, is_edge FROM pe")
def a5(spark, d):
    return stencil.perimeter(fx.mask(spark, d))


_FEATURES = f"""fe AS (SELECT image_id, {O}, channel, count(*) AS a, count(*) FILTER (is_edge) AS ae, sum(value) AS s, sum(value) FILTER (is_edge) AS se,
 quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95]) FILTER (is_edge) AS q FROM ec GROUP BY ALL),
iq AS (SELECT image_id, {O}, channel, avg(value) FILTER (value <= q[4] + 1.5 * (q[4] - q[2])) AS iqm FROM ec JOIN fe USING (image_id, {O}, channel) WHERE is_edge GROUP BY ALL)"""
_FEATURE_COLUMNS = f"""{L('a', '"AREA"')}, {L('ae', '"AREA_EDGE"')}, {L('a - ae', '"AREA_CORE"')}, {D('s / a', '"MEAN"')}, {D('se / nullif(ae, 0)', '"EDGE_MEAN"')},
 {D('coalesce((s - coalesce(se, 0)) / nullif(a - ae, 0), 0)', '"CORE_MEAN"')}, {', '.join(D(f'q[{i + 1}]', f'"EDGE_Q{n}"') for i, n in enumerate((5, 25, 50, 75, 95)))}, {D('iqm', '"EDGE_IQMEAN"')}"""


@query("a6_p1_p2_features", f"w AS (SELECT 1), {_EDGE}, {_FEATURES} SELECT {KEYS}, {_FEATURE_COLUMNS} FROM fe LEFT JOIN iq USING (image_id, {O}, channel)")
def a6(spark, d):
    return cells.features(fx.pixels(spark, d), stencil.perimeter(fx.mask(spark, d)))


@query("a7_hodges_lehmann", f"w AS (SELECT 1), {_EDGE}, ks AS (SELECT DISTINCT image_id, {O}, channel FROM ec), hl AS (SELECT c.image_id, c.{O}, c.channel, median(c.value - e.value) AS h FROM ec c JOIN ec e ON c.image_id = e.image_id AND c.channel = e.channel AND c.{O} = e.{O} WHERE NOT c.is_edge AND e.is_edge GROUP BY ALL) SELECT {KEYS}, {D('h', 'hl')} FROM ks LEFT JOIN hl USING (image_id, {O}, channel)")
def a7(spark, d):
    return cells.hodges_lehmann(fx.pixels(spark, d), stencil.perimeter(fx.mask(spark, d)))


@query("a8_core_edge_permutation", f"""w AS (SELECT 1), {_EDGE},
tot AS (SELECT image_id, {O}, channel, count(*) FILTER (is_edge) AS ne, count(*) AS n, sum(value) AS s, sum(value) FILTER (is_edge) AS se FROM ec GROUP BY ALL),
dealt AS (SELECT image_id, {O}, channel, b.b AS b, value, row_number() OVER (PARTITION BY image_id, {O}, channel, b.b ORDER BY md5('42|' || image_id || '|' || {O} || '|' || channel || '|' || b.b || '|' || row || '|' || col)) AS k FROM ec, range(99) b(b)),
pe2 AS (SELECT image_id, {O}, channel, b, sum(value) FILTER (k <= ne) AS pse FROM dealt JOIN tot USING (image_id, {O}, channel) GROUP BY ALL),
df AS (SELECT *, CASE WHEN ne > 0 AND n > ne THEN (s - se) / (n - ne) - se / ne END AS diff FROM tot)
SELECT {KEYS}, {D('any_value(diff)', 'diff')}, {D('CASE WHEN any_value(diff) IS NOT NULL THEN (1 + count(*) FILTER (abs((s - pse) / (n - ne) - pse / ne) > abs(diff))) / 100.0::DOUBLE END', 'p')} FROM df JOIN pe2 USING (image_id, {O}, channel) GROUP BY image_id, {O}, channel""")
def a8(spark, d):
    return cells.core_edge_difference(fx.pixels(spark, d), stencil.perimeter(fx.mask(spark, d)))


# --- grid statistics ---------------------------------------------------------------------------------------------------

def _near(source: str, value: str, name: str, queen: bool = True) -> str:
    """CTE: 3 x 3 sums (rook: cross) with the border repeated, centre included."""
    shape = "" if queen else "WHERE dr * dc = 0"
    return f"""{name} AS (SELECT a.image_id, a.channel, a.row, a.col, sum(b.{value}) AS xns FROM {source} a CROSS JOIN (SELECT dr, dc FROM (VALUES (-1), (0), (1)) x(dr), (VALUES (-1), (0), (1)) y(dc) {shape}) k
 JOIN {source} b ON b.image_id = a.image_id AND b.channel = a.channel AND b.row = greatest(0, least({fx.SIDE - 1}, a.row + dr)) AND b.col = greatest(0, least({fx.SIDE - 1}, a.col + dc)) GROUP BY ALL)"""


def _g(centre: bool, queen: bool) -> str:
    w1, i = (8 if queen else 4) + centre, 0 if centre else 1
    n, x = f"(nn - {i})", "value"
    m = f"((sx - {x} * {i}) / {n})"
    s2 = f"((sx2 - {x} * {x} * {i}) / {n} - {m} * {m})"
    xns = "xns" if centre else "(xns - value)"
    return f"""gs AS (SELECT image_id, channel, sum(value) AS sx, sum(value * value) AS sx2, CAST(count(*) AS DOUBLE) AS nn FROM px GROUP BY ALL),
g0 AS (SELECT image_id, channel, row, col, value, {s2} * ({n} * {w1}.0 - {w1 * w1}.0) / ({n} - 1) AS spread, {xns} - {m} * {w1}.0 AS top, {xns} / (sx - value * {i}) AS raw FROM px JOIN nb USING (image_id, channel, row, col) JOIN gs USING (image_id, channel)),
g1 AS (SELECT image_id, channel, row, col, raw, CASE WHEN spread > 1e-12 THEN top / sqrt(spread) END AS g FROM g0)"""


@query("g2_neighbourhood_sum", f"w AS (SELECT 1), {_near('px', 'value', 'nb', False)} SELECT {_PIX}, {D('xns', 'xns')} FROM nb")
def g2(spark, d):
    return stencil.neighbourhood_sum(fx.pixels(spark, d), queen=False).select("image_id", "channel", "row", "col", "xns")


@query("g1_g2_kernel_sum", f"w AS (SELECT dr, dc, exp(-sqrt(dr * dr + dc * dc)) AS w FROM (SELECT unnest(range(-2, 3)) AS dr) x, (SELECT unnest(range(-2, 3)) AS dc) y WHERE dr * dr + dc * dc <= 4 AND NOT (dr = 0 AND dc = 0)) SELECT a.image_id, a.channel, {L('a.row', 'row')}, {L('a.col', 'col')}, {D('sum(b.value * w)', 'xns')} FROM px a CROSS JOIN w JOIN px b ON b.image_id = a.image_id AND b.channel = a.channel AND b.row = greatest(0, least({fx.SIDE - 1}, a.row + dr)) AND b.col = greatest(0, least({fx.SIDE - 1}, a.col + dc)) GROUP BY a.image_id, a.channel, a.row, a.col")
def g1(spark, d):
    return stencil.kernel_sum(fx.pixels(spark, d), stencil.circular_kernel(2, centre=False, weight="exp")).select("image_id", "channel", "row", "col", "xns")


_P = f"{D('2 * (1 - ' + phi_sql('abs(g)') + ')', 'p_both')}, {D(phi_sql('g'), 'p_cold')}, {D('1 - ' + phi_sql('g'), 'p_hot')}"


@query("g3_g5_g6_g9_analytic", f"w AS (SELECT 1), {_near('px', 'value', 'nb')}, {_g(True, True)} SELECT {_PIX}, {D('g', 'g')}, {_P} FROM g1")
def g3(spark, d):
    return hotspot.g_statistic(fx.pixels(spark, d))


@query("g3_rook_without_centre", f"w AS (SELECT 1), {_near('px', 'value', 'nb', False)}, {_g(False, False)} SELECT {_PIX}, {D('g', 'g')} FROM g1")
def g3_rook(spark, d):
    return hotspot.g_classical(fx.pixels(spark, d), queen=False, centre=False).drop("value")


@query("g3_raw", f"w AS (SELECT 1), {_near('px', 'value', 'nb')}, {_g(True, True)} SELECT {_PIX}, {D('raw', 'g')} FROM g1")
def g3_raw(spark, d):
    return hotspot.g_classical(fx.pixels(spark, d), normalize=False).drop("value")


@query("g4_radius", f"""w AS (SELECT 1), {_near('px', 'value', 'nb')}, ds AS (SELECT a.image_id, a.channel, a.row, a.col, sum(b.value) AS sx, sum(b.value * b.value) AS sx2, CAST(count(*) AS DOUBLE) AS n
 FROM px a JOIN px b ON b.image_id = a.image_id AND b.channel = a.channel AND b.row BETWEEN a.row - 5 AND a.row + 5 AND (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) <= 25 GROUP BY ALL),
 z AS (SELECT *, (sx2 / n - (sx / n) * (sx / n)) * (n * 9.0 - 81.0) / (n - 1) AS spread FROM ds JOIN nb USING (image_id, channel, row, col)) SELECT {_PIX}, {D('CASE WHEN spread > 1e-12 THEN (xns - sx / n * 9.0) / sqrt(spread) END', 'g')} FROM z""")
def g4(spark, d):
    return hotspot.g_radius(fx.pixels(spark, d), 5).drop("value")


@query("g4_radius_50", f"""w AS (SELECT 1), {_near('px', 'value', 'nb')}, ds AS (SELECT a.image_id, a.channel, a.row, a.col, sum(b.value) AS sx, sum(b.value * b.value) AS sx2, CAST(count(*) AS DOUBLE) AS n
 FROM px a JOIN px b ON b.image_id = a.image_id AND b.channel = a.channel AND (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) <= 2500 GROUP BY ALL),
 z AS (SELECT *, (sx2 / n - (sx / n) * (sx / n)) * (n * 9.0 - 81.0) / (n - 1) AS spread FROM ds JOIN nb USING (image_id, channel, row, col)) SELECT {_PIX}, {D('CASE WHEN spread > 1e-12 THEN (xns - sx / n * 9.0) / sqrt(spread) END', 'g')} FROM z""")
def g4_default(spark, d):
    return hotspot.g_radius(fx.pixels(spark, d)).drop("value")


#: Offsets and weights within a distance of 2, exp(-distance), and sums with them; the centre is among them.
_WIDE_KERNEL = "w AS (SELECT dr, dc, exp(-sqrt(dr * dr + dc * dc)) AS w FROM (SELECT unnest(range(-2, 3)) AS dr) x, (SELECT unnest(range(-2, 3)) AS dc) y WHERE dr * dr + dc * dc <= 4), w1 AS (SELECT sum(w) AS w1 FROM w)"


def _weighted(source: str, value: str, name: str) -> str:
    return f"""{name} AS (SELECT a.image_id, a.channel, a.row, a.col, sum(b.{value} * w) AS xns FROM {source} a CROSS JOIN w JOIN {source} b ON b.image_id = a.image_id AND b.channel = a.channel
 AND b.row = greatest(0, least({fx.SIDE - 1}, a.row + dr)) AND b.col = greatest(0, least({fx.SIDE - 1}, a.col + dc)) GROUP BY ALL)"""


def _wide_kernel():
    return stencil.circular_kernel(2, weight="exp")


@query("g3_weighted_kernel", f"""{_WIDE_KERNEL}, {_weighted('px', 'value', 'nb')}, gs AS (SELECT image_id, channel, avg(value) AS m, avg(value * value) AS m2, CAST(count(*) AS DOUBLE) AS n FROM px GROUP BY ALL),
 z AS (SELECT *, (m2 - m * m) * (n * w1 - w1 * w1) / (n - 1) AS spread FROM nb JOIN gs USING (image_id, channel), w1) SELECT {_PIX}, {D('CASE WHEN spread > 1e-12 THEN (xns - m * w1) / sqrt(spread) END', 'g')} FROM z""")
def g3_kernel(spark, d):
    return hotspot.g_classical(fx.pixels(spark, d), kernel=_wide_kernel()).drop("value")


@query("g4_raw", f"""w AS (SELECT 1), {_near('px', 'value', 'nb')}, ds AS (SELECT a.image_id, a.channel, a.row, a.col, sum(b.value) AS sx
 FROM px a JOIN px b ON b.image_id = a.image_id AND b.channel = a.channel AND b.row BETWEEN a.row - 5 AND a.row + 5 AND (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) <= 25 GROUP BY ALL)
 SELECT {_PIX}, {D('xns / nullif(sx, 0)', 'g')} FROM ds JOIN nb USING (image_id, channel, row, col)""")
def g4_raw(spark, d):
    return hotspot.g_radius(fx.pixels(spark, d), 5, normalize=False).drop("value")


@query("g12_weighted_kernel", f"""{_WIDE_KERNEL}, {_weighted('px', 'value', 'nb')}, rr AS (SELECT image_id, channel, row, col, pow(abs(value - xns / w1), 2.0) AS r FROM px JOIN nb USING (image_id, channel, row, col), w1), {_weighted('rr', 'r', 'rn')},
 hs AS (SELECT image_id, channel, avg(r) AS mr, avg(r * r) AS mr2, CAST(count(*) AS DOUBLE) AS n FROM rr GROUP BY ALL),
 hh AS (SELECT image_id, channel, row, col, xns / nullif(mr * w1, 0) AS h, 1.0 / (n - 1) * pow(1.0 / (mr * w1), 2.0) * (mr2 - mr * mr) * (n * w1 - w1 * w1) AS v FROM rn JOIN hs USING (image_id, channel), w1) SELECT {_PIX}, {D('h', 'h')}, {D('v', 'h_var')}, {D('2 * h / v', 'hz')} FROM hh""")
def g12_kernel(spark, d):
    return hotspot.h_classical(fx.pixels(spark, d), kernel=_wide_kernel()).select("image_id", "channel", "row", "col", "h", "h_var", "hz")


@query("g13a_h_permuted")
def g13a_permuted(spark, d):
    return hotspot.h_statistic(fx.pixels(spark, d))


_PERMUTED = "g7_shuffle_permutation g8_resampled_permutation g10_disc_permutation g11_radii_mean g11_radii_min g13_h_permutation".split()


@query(_PERMUTED[0])
def g7(spark, d):
    return hotspot.g_permutation(fx.pixels(spark, d))


@query(_PERMUTED[1])
def g8(spark, d):
    return hotspot.g_permutation(fx.pixels(spark, d), whole_image=False)


@query(_PERMUTED[2])
def g10(spark, d):
    return hotspot.g_disc_permutation(fx.pixels(spark, d), 50)


@query(_PERMUTED[3])
def g11(spark, d):
    return hotspot.g_radii(fx.pixels(spark, d), merge="mean")


@query(_PERMUTED[4])
def g11_min(spark, d):
    return hotspot.g_radii(fx.pixels(spark, d), merge="min")


@query(_PERMUTED[5])
def g13(spark, d):
    return hotspot.h_permutation(fx.pixels(spark, d))


@query("g12_heteroscedasticity", f"""w AS (SELECT 1), {_near('px', 'value', 'nb')}, rr AS (SELECT image_id, channel, row, col, pow(abs(value - xns / 9.0), 2.0) AS r FROM px JOIN nb USING (image_id, channel, row, col)), {_near('rr', 'r', 'rn')},
 hs AS (SELECT image_id, channel, avg(r) AS mr, avg(r * r) AS mr2, CAST(count(*) AS DOUBLE) AS n FROM rr GROUP BY ALL),
 hh AS (SELECT image_id, channel, row, col, xns / nullif(mr * 9.0, 0) AS h, 1.0 / (n - 1) * pow(1.0 / (mr * 9.0), 2.0) * (mr2 - mr * mr) * (n * 9.0 - 81.0) AS v FROM rn JOIN hs USING (image_id, channel)) SELECT {_PIX}, {D('h', 'h')}, {D('v', 'h_var')}, {D('2 * h / v', 'hz')} FROM hh""")
def g12(spark, d):
    return hotspot.h_classical(fx.pixels(spark, d)).drop("value").select("image_id", "channel", "row", "col", "h", "h_var", "hz")


@query("g13a_h_chi_square")
def g13a(spark, d):
    return hotspot.h_with_p(fx.pixels(spark, d)).drop("value")


def _bh(key: str) -> str:
    return f"""w AS (SELECT l_returnflag AS channel, l_suppkey AS col, l_orderkey || '-' || l_linenumber AS row, CAST(l_quantity AS DOUBLE) / 50 AS p FROM lineitem),
 r AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS m, count(*) OVER (PARTITION BY {key} ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM w),
 q AS (SELECT *, least(1.0, min(p * m / i) OVER (PARTITION BY {key} ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM r) SELECT channel, {L('col', 'col')}, row, {D('p', 'p')}, {D('q', 'q')} FROM q"""


@query("g14_fdr_column", _bh("channel, col"))
def g14(spark, d):
    return hotspot.false_discovery(fx.pvalues(spark, d)).select("channel", "col", "row", "p", "q")


@query("g14_fdr_plane", _bh("channel"))
def g14_plane(spark, d):
    return hotspot.false_discovery(fx.pvalues(spark, d), scope="image").select("channel", "col", "row", "p", "q")


@query("p3_p4_weighted_planes", f"w AS (SELECT 1), {_near('px', 'value', 'nb')}, {_g(True, True)}, h AS (SELECT *, 1 - {phi_sql('g')} AS p FROM g1) SELECT {_PIX}, {D('CASE WHEN p IS NOT NULL THEN least(1.0, greatest(0.1, 1 - least(p, 0.1) / 0.1)) END', 'weight')}, {D('value * least(1.0, greatest(0.1, 1 - least(p, 0.1) / 0.1))', 'weighted')} FROM h JOIN px USING (image_id, channel, row, col)")
def p3(spark, d):
    p = fx.pixels(spark, d)
    w = cells.p_weights(hotspot.with_p(hotspot.g_classical(p), hotspot.HOT))
    return w.select("image_id", "channel", "row", "col", "weight", (F.col("value") * F.col("weight")).alias("weighted"))


# --- scores ------------------------------------------------------------------------------------------------------------

_PEAK = """w AS (SELECT p_brand AS channel, p_partkey AS o, CAST(p_retailprice AS DOUBLE) AS x, p_size / 50.0::DOUBLE AS y FROM part),
n AS (SELECT channel, count(*) AS n, quantile_cont(x, 0.99) AS q99 FROM w GROUP BY channel),
t AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY y, o) AS rk FROM w JOIN n USING (channel)),
t2 AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY channel) AS m FROM t WHERE rk > round_even(0.95 * n, 0)),
x0 AS (SELECT channel, x AS x0 FROM t2 WHERE i = m // 2 AND n > 10),
dd AS (SELECT w.channel, x, y, x0, q99, abs(x - x0) AS d FROM w JOIN n USING (channel) JOIN x0 USING (channel)),
wd AS (SELECT channel, greatest(least(quantile_cont(d, 0.01), min(q99) / 10), min(q99) / 25) AS width FROM dd GROUP BY channel),
pk AS (SELECT n.channel, min(x0) AS x0, sum(greatest(0, 1 - d / width) * y) / nullif(sum(greatest(0, 1 - d / width)), 0) AS y0 FROM n LEFT JOIN dd USING (channel) LEFT JOIN wd USING (channel) GROUP BY n.channel)"""


@query("c1_smooth_max", f"{_PEAK} SELECT channel, {D('x0', 'x0')}, {D('y0', 'y0')} FROM pk")
def c1(spark, d):
    return scores.smooth_max(fx.scores(spark, d)).drop("image_id")


@query("c3_score", f"{_PEAK}, yy AS (SELECT channel, o, CASE WHEN x0 IS NULL THEN NULL WHEN y > y0 OR x < x0 THEN y0 ELSE y END AS yc FROM w JOIN pk USING (channel)) SELECT channel, {L('o', O)}, {D('1 - yc / nullif(max(yc) OVER (PARTITION BY channel), 0)', 'score')} FROM yy")
def c3(spark, d):
    xy = fx.scores(spark, d)
    return scores.score(xy, scores.smooth_max(xy)).select("channel", "ObjectNumber", "score")


@query("c2_smoother", f"""w AS (SELECT p_brand AS channel, p_partkey AS o, CAST(p_retailprice AS DOUBLE) AS x, p_size / 50.0::DOUBLE AS y FROM part),
n AS (SELECT channel, quantile_cont(x, 0.99) AS q FROM w GROUP BY channel),
d AS (SELECT a.channel, a.o, a.x, quantile_cont(abs(a.x - b.x), 0.01) AS dq FROM w a JOIN w b USING (channel) GROUP BY ALL),
wd AS (SELECT channel, o, greatest(least(dq, q / 10), q / 25) AS width FROM d JOIN n USING (channel))
SELECT a.channel, {L('a.o', O)}, {D('sum(greatest(0, 1 - abs(a.x - b.x) / width) * b.y) / sum(greatest(0, 1 - abs(a.x - b.x) / width))', 'ys')} FROM w a JOIN wd ON wd.channel = a.channel AND wd.o = a.o JOIN w b ON b.channel = a.channel GROUP BY a.channel, a.o""")
def c2(spark, d):
    return scores.smoothed(fx.scores(spark, d)).select("channel", "ObjectNumber", "ys")


_SHARE = "w AS (SELECT p_type AS channel, CAST(l_quantity AS DOUBLE) - 25 AS v, CAST(p_size AS DOUBLE) AS wt FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query("c4_weighted_share", f"{_SHARE} SELECT channel, {L('count(*)', 'n')}, {D('coalesce(sum(CASE WHEN v > 0 THEN wt ELSE 0 END) / nullif(sum(wt), 0), 0)', 'proportion')} FROM w GROUP BY channel")
def c4(spark, d):
    return scores.weighted_share(fx.areas(spark, d)).drop("image_id")


def _intervals(values: str) -> str:
    """CTE ci: the interval of the weighted share of values(image_id, channel, o, v, wt) over 1,000 resamples."""
    mixed = lambda x: f"(xor({x}, {x} >> 16) * 73244475) % 4294967296"
    return f"""vl AS (SELECT *, row_number() OVER (PARTITION BY image_id, channel ORDER BY o, v, wt) - 1 AS k, count(*) OVER (PARTITION BY image_id, channel) AS n FROM {values}),
gp AS (SELECT DISTINCT image_id, channel, n, b.b AS b, ('0x' || substr(md5('42|' || image_id || '|' || channel || '|' || b.b), 1, 8))::BIGINT AS key FROM vl, range(1000) b(b)),
x0 AS (SELECT image_id, channel, n, b, (key + unnest(range(n)) * 2654435769) % 4294967296 AS x FROM gp), x1 AS (SELECT * REPLACE ({mixed("x")} AS x) FROM x0), x2 AS (SELECT * REPLACE ({mixed("x")} AS x) FROM x1),
dw AS (SELECT image_id, channel, b, (xor(x, x >> 16) * n) >> 32 AS k FROM x2),
sh2 AS (SELECT image_id, channel, b, coalesce(sum(CASE WHEN v > 0 THEN wt ELSE 0 END) / nullif(sum(wt), 0), 0) AS s FROM dw JOIN vl USING (image_id, channel, k) GROUP BY ALL),
ci AS (SELECT image_id, channel, quantile_cont(s, 0.025) AS ci_low, quantile_cont(s, 0.975) AS ci_high FROM sh2 GROUP BY ALL)"""


@query("c5_bootstrap_share", f"""w AS (SELECT 'part' AS image_id, p_type AS channel, l_orderkey || '-' || l_linenumber AS o, CAST(l_quantity AS DOUBLE) - 25 AS v, CAST(p_size AS DOUBLE) AS wt FROM lineitem JOIN part ON l_partkey = p_partkey),
{_intervals("w")} SELECT image_id, channel, {D('ci_low', 'ci_low')}, {D('ci_high', 'ci_high')} FROM ci""")
def c5(spark, d):
    return scores.bootstrap_share(fx.areas(spark, d))


def _bands(spark, d):
    s = fx.scores(spark, d)
    return s.select("image_id", "channel", "ObjectNumber", F.col("y").alias("edge"), (F.col("x") % 100 / 100).alias("core"), F.col("x").alias("AREA"), (F.col("x") % 40).alias("AREA_EDGE"), (F.col("x") % 60).alias("AREA_CORE"))


@query("p5_p6_p7_bands", f"w AS (SELECT p_brand AS channel, p_partkey AS o, p_size / 50.0::DOUBLE AS e, CAST(p_retailprice AS DOUBLE) % 100 / 100 AS c, CAST(p_retailprice AS DOUBLE) % 40 AS ae, CAST(p_retailprice AS DOUBLE) % 60 AS ac FROM part) SELECT channel, {L('o', O)}, {D('c - e', 'diff')}, {D('least(ae, ac)', 'area')} FROM w WHERE (e > 0.5 OR c > 0.5) AND e < 1 AND c < 1 AND least(ae, ac) > 5")
def p5(spark, d):
    return scores.band(_bands(spark, d), min_area=5).select("channel", "ObjectNumber", (F.col("core") - F.col("edge")).alias("diff"), F.least("AREA_EDGE", "AREA_CORE").alias("area"))


@query("p8_location_rule", f"{_SHARE}, s AS (SELECT channel, sum(CASE WHEN v > 0 THEN wt ELSE 0 END) / sum(wt) AS p FROM w GROUP BY channel) SELECT channel, CASE WHEN p - 0.02 > 0.5 THEN 'Nuclear' WHEN p + 0.02 < 0.5 THEN 'Membrane' ELSE 'Whole_cell' END AS location FROM s")
def p8(spark, d):
    s = scores.weighted_share(fx.areas(spark, d)).withColumn("ci_low", F.col("proportion") - 0.02).withColumn("ci_high", F.col("proportion") + 0.02)
    return scores.location_rule(s).select("channel", "location")


@query("p9_asinh", f"SELECT {KEYS}, {D('avg(ln(value + sqrt(value * value + 1)))', 'value')} FROM cl GROUP BY image_id, {O}, channel")
def p9(spark, d):
    return cells.cell_intensities(fx.pixels(spark, d).withColumn("value", F.asinh("value")), fx.mask(spark, d)).select(*cells.KEY, "value")


def _located(cells: str, min_p: float) -> str:
    """The located channels of cells(image_id, channel, o, e, c, area), area the smaller one of edge and core."""
    return f"""kp AS (SELECT *, c - e AS v FROM {cells} WHERE (e > 0.5 OR c > 0.5) AND e < 1 AND c < 1),
kw AS (SELECT image_id, channel, o, v, coalesce(area * count(*) OVER (PARTITION BY image_id, channel) / nullif(sum(area) OVER (PARTITION BY image_id, channel), 0), 0) AS wt FROM kp), {_intervals("kw")},
ws AS (SELECT image_id, channel, count(*) AS n, coalesce(sum(CASE WHEN v > 0 THEN wt ELSE 0 END) / nullif(sum(wt), 0), 0) AS proportion FROM kw GROUP BY ALL)
SELECT image_id, channel, CASE WHEN ci_low > {min_p} THEN 'Nuclear' WHEN ci_high < 1 - {min_p} THEN 'Membrane' ELSE 'Whole_cell' END AS location, {L('n', 'n')}, {D('proportion', 'proportion')}, {D('ci_low', 'ci_low')}, {D('ci_high', 'ci_high')} FROM ws JOIN ci USING (image_id, channel)"""


@query("c6_marker_location", f"w AS (SELECT 'part' AS image_id, p_brand AS channel, p_partkey AS o, p_size / 50.0::DOUBLE AS e, CAST(p_retailprice AS DOUBLE) % 100 / 100 AS c, least(CAST(p_retailprice AS DOUBLE) % 40, CAST(p_retailprice AS DOUBLE) % 60) AS area FROM part), {_located('w', 0.5)}")
def c6(spark, d):
    return scores.marker_location(_bands(spark, d))


def _adjusted(p: str, name: str) -> str:
    """CTE: p of gp, adjusted within image columns."""
    return f"""{name}r AS (SELECT image_id, channel, row, col, p, count(p) OVER (PARTITION BY image_id, channel, col) AS m, count(p) OVER (PARTITION BY image_id, channel, col ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM (SELECT *, {p} AS p FROM g1 WHERE g IS NOT NULL)),
{name} AS (SELECT image_id, channel, row, col, least(1.0, min(p * m / i) OVER (PARTITION BY image_id, channel, col ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS value FROM {name}r)"""


_PLANES = f"""{_near('px', 'value', 'nb')}, {_g(True, True)}, {_adjusted(f'2 * (1 - {phi_sql("abs(g)")})', 'fb')}, {_adjusted(f'1 - {phi_sql("g")}', 'fh')},
pl AS (SELECT image_id, channel, row, col, value FROM px UNION ALL SELECT image_id, channel || '_GP', row, col, value FROM fb UNION ALL SELECT image_id, channel || '_GPhot', row, col, value FROM fh)"""


@query("a9_features_job", f"w AS (SELECT 1), {_PLANES}, {_EDGE.replace('FROM px JOIN pe', 'FROM pl JOIN pe')}, {_FEATURES} SELECT {KEYS}, {_FEATURE_COLUMNS} FROM fe LEFT JOIN iq USING (image_id, {O}, channel)")
def a9(spark, d):
    return workloads.calculate_features(fx.pixels(spark, d), fx.mask(spark, d))


#: fs: features of all planes of W1, planes weighted by p among them; sc: scores of each cell and channel.
_SCORED = f"""{_PLANES}, wp AS (SELECT * FROM pl UNION ALL SELECT image_id, channel || '_weighted', row, col, px.value * least(1.0, greatest(0.1, 1 - least(fh.value, 0.1) / 0.1)) FROM fh JOIN px USING (image_id, channel, row, col)),
{_EDGE.replace('FROM px JOIN pe', 'FROM wp JOIN pe')}, {_FEATURES},
fs AS (SELECT image_id, {O}, channel, a, ae, s / a AS m, se / nullif(ae, 0) AS em, CASE WHEN a > ae THEN (s - coalesce(se, 0)) / (a - ae) ELSE 0 END AS cm FROM fe),
bo AS (SELECT x.image_id, x.{O}, x.channel, x.m, x.em, x.cm, y.m AS pm, y.em AS pem, y.cm AS pcm FROM fs x JOIN fs y ON y.image_id = x.image_id AND y.{O} = x.{O} AND y.channel = x.channel || '_GP'),
n1 AS (SELECT image_id, channel, count(*) AS n, quantile_cont(m, 0.99) AS q99 FROM bo WHERE m IS NOT NULL AND pm IS NOT NULL GROUP BY ALL),
t1 AS (SELECT bo.*, n, q99, row_number() OVER (PARTITION BY image_id, channel ORDER BY pm, {O}) AS rk FROM bo JOIN n1 USING (image_id, channel) WHERE m IS NOT NULL AND pm IS NOT NULL),
t2 AS (SELECT *, row_number() OVER (PARTITION BY image_id, channel ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY image_id, channel) AS mm FROM t1 WHERE rk > round_even(0.95 * n, 0)),
pk0 AS (SELECT image_id, channel, m AS x0 FROM t2 WHERE i = mm // 2 AND n > 10),
pk1 AS (SELECT t1.image_id, t1.channel, x0, greatest(least(quantile_cont(abs(m - x0), 0.01), min(q99) / 10), min(q99) / 25) AS width FROM t1 JOIN pk0 USING (image_id, channel) GROUP BY ALL),
pk AS (SELECT image_id, channel, x0, sum(greatest(0, 1 - abs(m - x0) / nullif(width, 0)) * pm) / nullif(sum(greatest(0, 1 - abs(m - x0) / nullif(width, 0))), 0) AS y0 FROM t1 JOIN pk1 USING (image_id, channel) GROUP BY ALL),
cy AS (SELECT image_id, {O}, channel, {", ".join(f"CASE WHEN x0 IS NULL THEN NULL WHEN {y} > y0 OR {x} < x0 THEN y0 ELSE {y} END AS {y}" for x, y in (("m", "pm"), ("em", "pem"), ("cm", "pcm")))} FROM bo LEFT JOIN pk USING (image_id, channel)),
sc AS (SELECT image_id, {O}, channel, {", ".join(f"1 - {y} / nullif(max({y}) OVER (PARTITION BY image_id, channel), 0) AS s{y}" for y in ("pm", "pem", "pcm"))} FROM cy)"""


@query("a10_scored_features_job", f"""w AS (SELECT 1), {_SCORED} SELECT {KEYS}, {_FEATURE_COLUMNS}, {D('spm', '"GP_SCORE"').replace('GP_SCORE', 'MEAN_GP_SCORE')}, {D('spem', '"EDGE_GP_SCORE"')}, {D('spcm', '"CORE_GP_SCORE"')}, {D('spcm - spem', '"SCORE_DIFF"')}, {L('least(ae, a - ae)', '"AREA_MIN_EDGE_CORE"')}
FROM fe LEFT JOIN iq USING (image_id, {O}, channel) LEFT JOIN sc USING (image_id, {O}, channel)""")
def a10(spark, d):
    return workloads.calculate_features(fx.pixels(spark, d), fx.mask(spark, d), include_scores=True, weighted=True)


@query("c7_marker_location_job", f"""w AS (SELECT 1), {_SCORED}, cc AS (SELECT image_id, channel, {O} AS o, spem AS e, spcm AS c, least(ae, a - ae) AS area FROM sc JOIN fs USING (image_id, {O}, channel) WHERE spcm IS NOT NULL), {_located('cc', 0.75)}""")
def c7(spark, d):
    return workloads.marker_location(fx.pixels(spark, d), fx.mask(spark, d))


# --- polar profiles ----------------------------------------------------------------------------------------------------


def _profile(spark, d):
    m, n = fx.mask(spark, d), fx.mask_nuc(spark, d)
    return polar.radial(fx.pixels(spark, d), cells.boxes(n).select("image_id", "ObjectNumber", "x", "y"), polar.lookup(8, 6), polar.membership(m, n))


_LUT = "lut(dr, dc, angle, ring) AS (VALUES " + ", ".join(map(str, polar.lookup(8, 6))) + ")"
_RADIAL = f"""w AS (SELECT 1), {_LUT}, ce AS (SELECT image_id, label AS {O}, CAST(round_even(avg(row), 0) AS INT) AS cx, CAST(round_even(avg(col), 0) AS INT) AS cy FROM mkn WHERE label <> 0 GROUP BY ALL),
al AS (SELECT image_id, row, col, a.label AS cell, b.label AS nuc FROM mk a JOIN mkn b USING (image_id, row, col)),
ap AS (SELECT ce.image_id, {O}, angle, ring, cx + dr AS row, cy + dc AS col FROM ce CROSS JOIN lut),
lg AS (SELECT ap.image_id, {O}, channel, angle, ring, value FROM ap JOIN px USING (image_id, row, col)
 UNION ALL SELECT ap.image_id, {O}, u.c, angle, ring, CASE u.c WHEN 'any_cell' THEN CAST(cell <> 0 AS INT) WHEN 'own_cell' THEN CAST(cell = {O} AS INT) WHEN 'other_cell' THEN CAST(cell <> 0 AND cell <> {O} AS INT) WHEN 'any_nucleus' THEN CAST(nuc <> 0 AS INT) WHEN 'own_nucleus' THEN CAST(nuc = {O} AS INT) ELSE CAST(nuc <> 0 AND nuc <> {O} AS INT) END
 FROM ap JOIN al USING (image_id, row, col) CROSS JOIN (VALUES ('any_cell'), ('own_cell'), ('other_cell'), ('any_nucleus'), ('own_nucleus'), ('other_nucleus')) u(c)),
sm2 AS (SELECT image_id, {O}, channel, angle, ring, sum(value) AS s, count(*) AS n FROM lg GROUP BY ALL),
bn AS (SELECT DISTINCT angle, ring FROM lut), ks AS (SELECT DISTINCT image_id, {O}, channel FROM sm2),
fl AS (SELECT ks.image_id, ks.{O}, ks.channel, bn.angle, bn.ring, coalesce(s, 0) AS s, coalesce(n, 0) AS n FROM ks CROSS JOIN bn LEFT JOIN sm2 USING (image_id, {O}, channel, angle, ring)),
rp AS (SELECT *, s / greatest(n, 1) AS value, sum(s) OVER wd / greatest(sum(n) OVER wd, 1) AS cumulative FROM fl WINDOW wd AS (PARTITION BY image_id, {O}, channel, angle ORDER BY ring ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_BIN = f"{KEYS}, {L('angle', 'angle')}, {L('ring', 'ring')}"


@query("r1_r2_r4_radial", f"{_RADIAL} SELECT {_BIN}, {D('value', 'value')}, {D('cumulative', 'cumulative')}, {L('n', 'n')} FROM rp")
def r4(spark, d):
    return _profile(spark, d)


#: Sub-pixels, three to a pixel, of 16 angles and 16 rings around each nucleus: linear for channels, nearest for planes.
_SCALED = f"""w AS (SELECT 1), lut3(dr, dc, angle, ring) AS (VALUES {", ".join(map(str, polar.lookup(16, 16, 3)))}),
ce AS (SELECT image_id, label AS {O}, avg(row) AS x, avg(col) AS y, greatest(0, min(row) - 16) AS r0, greatest(0, min(col) - 16) AS c0, least({fx.SIDE}, max(row) + 17) AS r1, least({fx.SIDE}, max(col) + 17) AS c1 FROM mkn WHERE label <> 0 GROUP BY ALL),
sp AS (SELECT image_id, {O}, angle, ring, r0, c0, r1 - r0 AS h, c1 - c0 AS wd, CAST(round_even((x - r0) * 3, 0) AS INT) + dr AS r, CAST(round_even((y - c0) * 3, 0) AS INT) + dc AS c FROM ce CROSS JOIN lut3),
sub AS (SELECT *, (r + 0.5::DOUBLE) / 3 - 0.5::DOUBLE AS sy, (c + 0.5::DOUBLE) / 3 - 0.5::DOUBLE AS sx FROM sp WHERE r >= 0 AND c >= 0 AND r < h * 3 AND c < wd * 3),
fw AS (SELECT image_id, {O}, angle, ring, CAST(r0 + greatest(0, least(h - 1, floor(sy) + i.i)) AS INT) AS row, CAST(c0 + greatest(0, least(wd - 1, floor(sx) + j.j)) AS INT) AS col, sum((1 - abs(sy - floor(sy) - i.i)) * (1 - abs(sx - floor(sx) - j.j))) AS wt FROM sub, range(2) i(i), range(2) j(j) GROUP BY ALL),
nn AS (SELECT image_id, {O}, angle, ring, CAST(r0 + r // 3 AS INT) AS row, CAST(c0 + c // 3 AS INT) AS col, count(*) AS n FROM sub GROUP BY ALL),
cnt AS (SELECT image_id, {O}, angle, ring, sum(n) AS n FROM nn GROUP BY ALL),
alm AS (SELECT image_id, row, col, a.label AS cell, b.label AS nuc FROM mk a JOIN mkn b USING (image_id, row, col)),
sm2 AS (SELECT fw.image_id, {O}, channel, angle, ring, sum(value * wt) AS s FROM fw JOIN px USING (image_id, row, col) GROUP BY ALL
 UNION ALL SELECT nn.image_id, {O}, u.c, angle, ring, sum(n * CASE u.c WHEN 'any_cell' THEN CAST(cell <> 0 AS INT) WHEN 'own_cell' THEN CAST(cell = {O} AS INT) WHEN 'other_cell' THEN CAST(cell <> 0 AND cell <> {O} AS INT) WHEN 'any_nucleus' THEN CAST(nuc <> 0 AS INT) WHEN 'own_nucleus' THEN CAST(nuc = {O} AS INT) ELSE CAST(nuc <> 0 AND nuc <> {O} AS INT) END)
 FROM nn JOIN alm USING (image_id, row, col) CROSS JOIN (VALUES ('any_cell'), ('own_cell'), ('other_cell'), ('any_nucleus'), ('own_nucleus'), ('other_nucleus')) u(c) GROUP BY ALL),
ks AS (SELECT DISTINCT image_id, {O}, channel FROM sm2),
fl AS (SELECT ks.image_id, ks.{O}, ks.channel, CAST(a.a AS INT) AS angle, CAST(r.r AS INT) AS ring, coalesce(s, 0) AS s, coalesce(n, 0) AS n FROM ks CROSS JOIN range(16) a(a) CROSS JOIN range(16) r(r) LEFT JOIN sm2 ON sm2.image_id = ks.image_id AND sm2.{O} = ks.{O} AND sm2.channel = ks.channel AND sm2.angle = a.a AND sm2.ring = r.r LEFT JOIN cnt ON cnt.image_id = ks.image_id AND cnt.{O} = ks.{O} AND cnt.angle = a.a AND cnt.ring = r.r),
rp AS (SELECT *, s / greatest(n, 1) AS value, sum(s) OVER wd / greatest(sum(n) OVER wd, 1) AS cumulative FROM fl WINDOW wd AS (PARTITION BY image_id, {O}, channel, angle ORDER BY ring ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("r4_scaled", f"{_SCALED} SELECT {_BIN}, {D('value', 'value')}, {D('cumulative', 'cumulative')}, {L('n', 'n')} FROM rp")
def r4_scaled(spark, d):
    m, n = fx.mask(spark, d), fx.mask_nuc(spark, d)
    return polar.radial_scaled(fx.pixels(spark, d), cells.boxes(n), 16, 16, 3, members=polar.membership(m, n))


def _edge_of(plane: str, name: str) -> str:
    return f"""{name}0 AS (SELECT image_id, {O}, angle, ring, value >= 1.0 AS v, lead(value >= 1.0) OVER (PARTITION BY image_id, {O}, angle ORDER BY ring) AS nx FROM rp WHERE channel = '{plane}'),
{name} AS (SELECT image_id, {O}, angle, coalesce(min(ring) FILTER (v <> nx AND ring >= 1), 1) AS {name} FROM {name}0 GROUP BY ALL)"""


_PARTS = f"{_RADIAL}, {_edge_of('own_nucleus', 'nb')}, {_edge_of('own_cell', 'cb')}, bo AS (SELECT * FROM rp JOIN nb USING (image_id, {O}, angle) JOIN cb USING (image_id, {O}, angle))"


@query("r5_nucleus_part", f"{_PARTS} SELECT {_BIN}, {D('CASE WHEN ring <= nb THEN value ELSE 0 END', 'value')} FROM bo")
def r5(spark, d):
    return polar.nucleus_part(_profile(spark, d))


def _moved(where: str, shift: str) -> str:
    return f"{_PARTS}, mv AS (SELECT image_id, {O}, channel, angle, ring - {shift} - 1 AS ring, value AS v FROM bo WHERE {where}) SELECT {_BIN}, {D('coalesce(v, 0)', 'value')} FROM rp LEFT JOIN mv USING (image_id, {O}, channel, angle, ring)"


@query("r6_cytoplasm_part", _moved("ring > nb AND ring <= cb", "nb"))
def r6(spark, d):
    return polar.cytoplasm_part(_profile(spark, d))


@query("r7_outside_part", _moved("ring > cb", "cb"))
def r7(spark, d):
    return polar.outside_part(_profile(spark, d))


#: From the first to the last ring of the own cell; six rings at most, so that all of it is linear interpolation.
_RESAMPLED = f"""{_RADIAL}, en AS (SELECT image_id, {O}, angle, coalesce(min(ring) FILTER (value > 0), 0) AS lo, coalesce(max(ring) FILTER (value > 0), 0) AS hi FROM rp WHERE channel = 'own_cell' GROUP BY ALL),
fd AS (SELECT rp.image_id, rp.{O}, channel, angle, ring - lo AS j, hi - lo + 1 AS n, CASE WHEN channel IN ('any_cell', 'own_cell', 'any_nucleus', 'own_nucleus') THEN 1.0 ELSE value END AS value FROM rp JOIN en USING (image_id, {O}, angle) WHERE ring BETWEEN lo AND hi)"""


@query("r8_resampled", f"""{_RESAMPLED} SELECT {KEYS}, {L('angle', 'angle')}, {L('k.k', 'bin')}, {D('sum(value * greatest(0, 1 - abs(k.k * (n - 1) / 5.0::DOUBLE - j)))', 'value')} FROM fd, range(6) k(k) GROUP BY image_id, {O}, channel, angle, k.k""")
def r8(spark, d):
    return polar.scaled(_profile(spark, d), 6).select("image_id", "ObjectNumber", "channel", "angle", F.posexplode("values").alias("bin", "value"))


@query("r9_to_grid", f"{_RADIAL} SELECT {KEYS}, {L('dr', 'drow')}, {L('dc', 'dcol')}, {D('value', 'value')} FROM rp JOIN lut USING (angle, ring)")
def r9(spark, d):
    return polar.to_grid(_profile(spark, d), polar.lookup(8, 6))


_FINE = "fine(dr, dc, angle, ring) AS (VALUES " + ", ".join(map(str, polar.lookup(8, 12))) + ")"


@query("r9_to_scaled_grid", f"""{_RADIAL}, {_FINE}, fr AS (SELECT image_id, {O}, channel, angle, k.k AS ring, sum(value * greatest(0, 1 - abs(k.k * 5.0 / 11.0::DOUBLE - ring))) AS value FROM rp, range(12) k(k) GROUP BY ALL)
SELECT {KEYS}, {L('dr', 'drow')}, {L('dc', 'dcol')}, {D('value', 'value')} FROM fr JOIN fine USING (angle, ring)""")
def r9_scaled(spark, d):
    return polar.to_grid(_profile(spark, d), polar.lookup(8, 12), 2)


_CROP = f"w AS (SELECT image_id, label AS {O}, min(row) AS r0, min(col) AS c0, max(row) AS r1, max(col) AS c1 FROM mk WHERE label <> 0 GROUP BY ALL), cr AS (SELECT image_id, {O}, channel, row - r0 + 1 AS row, col - c0 + 1 AS col, value FROM w JOIN px USING (image_id) WHERE row BETWEEN r0 - 1 AND r1 + 1 AND col BETWEEN c0 - 1 AND c1 + 1)"


@query("r10_crops", f"{_CROP} SELECT {KEYS}, {L('row', 'row')}, {L('col', 'col')}, {D('value', 'value')} FROM cr")
def r10(spark, d):
    return polar.crops(fx.pixels(spark, d), cells.boxes(fx.mask(spark, d)), 1)


@query("r3_upscaled", f"""{_CROP}, mx AS (SELECT image_id, {O}, channel, max(row) AS mr, max(col) AS mc FROM cr GROUP BY ALL),
up AS (SELECT cr.image_id, cr.{O}, cr.channel, cr.row * 2 + i AS row, cr.col * 2 + j AS col, greatest(0, least((cr.row * 2 + i + 0.5) / 2 - 0.5, mr)) AS y, greatest(0, least((cr.col * 2 + j + 0.5) / 2 - 0.5, mc)) AS x FROM cr JOIN mx USING (image_id, {O}, channel), range(2) a(i), range(2) b(j))
SELECT up.image_id, {L('up.' + O, O)}, up.channel, {L('up.row', 'row')}, {L('up.col', 'col')}, {D('sum(value * (1 - abs(y - s.row)) * (1 - abs(x - s.col)))', 'value')} FROM up JOIN cr s ON s.image_id = up.image_id AND s.{O} = up.{O} AND s.channel = up.channel AND abs(y - s.row) < 1 AND abs(x - s.col) < 1 GROUP BY ALL""")
def r3(spark, d):
    return polar.upscaled(polar.crops(fx.pixels(spark, d), cells.boxes(fx.mask(spark, d)), 1), 2)


@query("r11_shift_similarity", f"""w AS (SELECT a.{O}, a.ring, s.s AS shift, a.value AS v, b.value AS v2 FROM rad a CROSS JOIN range(8) s(s) JOIN rad b ON b.{O} = a.{O} AND b.ring = a.ring AND b.angle = (a.angle + s.s) % 8)
SELECT 'emb' AS image_id, {L(O, O)}, 'emb' AS channel, {L('ring', 'ring')}, {L('shift', 'shift')}, {D('CASE WHEN stddev_pop(v) * stddev_pop(v2) > 1e-12 THEN corr(v, v2) END', 'acf')}, {D('covar_samp(v, v2)', 'cov')}, {D('sum(abs(v - v2))', 'difl1')}, {D('sqrt(sum((v - v2) * (v - v2)))', 'difl2')} FROM w GROUP BY {O}, ring, shift""")
def r11(spark, d):
    return polar.shift_similarity(fx.radial(spark, d).where("channel = 'emb'"), 8)


# --- boundary shapes ---------------------------------------------------------------------------------------------------

#: sh: angles and depths of the shapes; those of width 0, with the ids 0 to 7, have none.
_SHAPES = """sh0 AS (SELECT w.w AS wd, s.s AS start, c.c AS code, CAST(CASE w.w WHEN 1 THEN 8 + s.s * 2 + c.c WHEN 2 THEN 24 + s.s * 4 + c.c ELSE 56 + s.s * 8 + c.c END AS INT) AS shape_id FROM range(1, 4) w(w), range(8) s(s), range(8) c(c) WHERE c.c < CAST(pow(2, w.w) AS INT)),
sh AS (SELECT shape_id, CAST((start + i.i) % 8 AS INT) AS angle, CAST((code // CAST(pow(2, i.i) AS INT)) % 2 + 1 AS INT) AS depth FROM sh0, range(3) i(i) WHERE i.i < wd)"""
_BOUND = f"""bd AS (SELECT {O}, angle, coalesce(min(ring) FILTER (own >= 0.5), 0) AS inner_, coalesce(max(ring) FILTER (own >= 0.5) + 1, 0) AS outer_ FROM rad GROUP BY ALL)"""
_WHATIF = f"""w AS (SELECT 1), {_SHAPES}, {_BOUND}, nu AS (SELECT {O}, sum(value) AS ns, count(*) AS nn FROM rad JOIN bd USING ({O}, angle) WHERE ring BETWEEN inner_ AND outer_ GROUP BY {O}),
ly AS (SELECT {O}, angle, ring - outer_ + 1 AS depth, sum(value) OVER (PARTITION BY {O}, angle ORDER BY ring) AS s FROM rad JOIN bd USING ({O}, angle) WHERE ring - outer_ BETWEEN 0 AND 1),
ss AS (SELECT {O}, shape_id, sum(s) AS sm, sum(depth) AS sn FROM ly JOIN sh USING (angle, depth) GROUP BY ALL UNION ALL SELECT DISTINCT {O}, CAST(i.i AS INT), 0, 0 FROM rad, range(8) i(i)),
wi AS (SELECT {O}, shape_id, sn AS n, (ns + sm) / (nn + sn) AS marker FROM ss JOIN nu USING ({O}))"""


def _all_shapes(spark):
    return shapes.shapes(spark, 8, 2, 0, 0.4)


def _what_if(spark, d, s):
    return shapes.what_if(fx.radial(spark, d), s, 2)


@query("b2_b3_shape_stats_of_cells", f"w AS (SELECT 1), {_SHAPES}, e AS (SELECT {O}, max({O}) % 132 AS k FROM rad GROUP BY {O}) SELECT {L(O, O)}, {L('shape_id', 'shape_id')}, {L('sum(depth)', 'covered')}, {L('max(depth)', 'max_depth')}, {D('avg(depth)', 'mean_depth')}, {D('CASE WHEN round(atan2(sum(sin(angle * tau) * depth), sum(cos(angle * tau) * depth)) / tau, 9) < 0 THEN 8 - 1e-12::DOUBLE ELSE 0 END + atan2(sum(sin(angle * tau) * depth), sum(cos(angle * tau) * depth)) / tau', 'mean_angle')}, {D('sqrt(-2 * ln(greatest(1e-300::DOUBLE, least(1, sqrt(pow(sum(sin(angle * tau) * depth), 2) + pow(sum(cos(angle * tau) * depth), 2)) / sum(depth))))) / tau', 'sd_angle')} FROM e JOIN sh ON shape_id = 8 + k, (SELECT 2 * pi() / (8 - 1e-12::DOUBLE) AS tau) GROUP BY {O}, shape_id, tau")
def b2(spark, d):
    ids = fx.radial(spark, d).select("ObjectNumber").distinct().withColumn("shape_id", (8 + F.col("ObjectNumber") % 132).cast("int"))
    return ids.join(shapes.shape_stats(_all_shapes(spark)), "shape_id").select("ObjectNumber", "shape_id", "covered", "max_depth", "mean_depth", "mean_angle", "sd_angle")


@query("b4_boundary", f"w AS (SELECT 1), {_BOUND} SELECT 'emb' AS image_id, {L(O, O)}, {L('angle', 'angle')}, {L('inner_', chr(34) + 'inner' + chr(34))}, {L('outer_', chr(34) + 'outer' + chr(34))}, {L('outer_ + 2', 'outmost')} FROM bd")
def b4(spark, d):
    return shapes.nucleus_boundary(fx.radial(spark, d), maxdist=2)


@query("b5_shrinkage", f"w AS (SELECT 1), {_BOUND} SELECT 'emb' AS image_id, {L(O, O)}, {L('min(outer_ - inner_)', 'shrinkage')} FROM bd GROUP BY {O}")
def b5(spark, d):
    return shapes.max_shrinkage(shapes.nucleus_boundary(fx.radial(spark, d)))


@query("b6_nucleus_sums", f"w AS (SELECT 1), {_BOUND} SELECT 'emb' AS image_id, {L(O, O)}, 'emb' AS channel, {D('sum(value)', 'nuc_sum')}, {L('count(*)', 'nuc_n')} FROM rad JOIN bd USING ({O}, angle) WHERE ring BETWEEN inner_ AND outer_ GROUP BY {O}")
def b6(spark, d):
    r = fx.radial(spark, d)
    return shapes.nucleus_sums(r.where("channel = 'emb'"), shapes.nucleus_boundary(r))


@query("b7_layers", f"w AS (SELECT 1), {_BOUND} SELECT 'emb' AS image_id, {L(O, O)}, 'emb' AS channel, {L('angle', 'angle')}, {L('ring - outer_', 'layer')}, {D('value', 'value')} FROM rad JOIN bd USING ({O}, angle) WHERE ring - outer_ BETWEEN 0 AND 2")
def b7(spark, d):
    r = fx.radial(spark, d)
    return shapes.layers(r.where("channel = 'emb'"), shapes.nucleus_boundary(r), 3).drop("ring")


@query("b8_shape_sums", f"{_WHATIF} SELECT 'emb' AS image_id, {L(O, O)}, 'emb' AS channel, {L('shape_id', 'shape_id')}, {D('sm', 'shape_sum')}, {L('sn', 'shape_n')} FROM ss")
def b8(spark, d):
    r = fx.radial(spark, d)
    return shapes.shape_sums(shapes.layers(r.where("channel = 'emb'"), shapes.nucleus_boundary(r), 2), _all_shapes(spark))


@query("b8a_sliding_sums", f"""w AS (SELECT 1), {_SHAPES}, {_BOUND}, ly AS (SELECT {O}, angle, ring - outer_ AS layer, value FROM rad JOIN bd USING ({O}, angle) WHERE ring - outer_ BETWEEN 0 AND 2),
inn AS (SELECT {O}, t.t AS start, coalesce(sum(value) FILTER (layer < t.t), 0) AS s, count(*) FILTER (layer < t.t) AS n FROM ly, range(2) t(t) GROUP BY ALL),
own AS (SELECT {O}, shape_id, t.t AS start, sum(value) AS s, count(*) AS n FROM ly JOIN sh USING (angle), range(2) t(t) WHERE layer BETWEEN t.t AND t.t + depth - 1 GROUP BY ALL),
al AS (SELECT DISTINCT shape_id FROM sh UNION ALL SELECT CAST(i.i AS INT) FROM range(8) i(i))
SELECT 'emb' AS image_id, {L('inn.' + O, O)}, 'emb' AS channel, {L('al.shape_id', 'shape_id')}, {L('inn.start', 'start')}, {D('inn.s + coalesce(own.s, 0)', 'shape_sum')}, {L('inn.n + coalesce(own.n, 0)', 'shape_n')}
 FROM inn CROSS JOIN al LEFT JOIN own ON own.{O} = inn.{O} AND own.shape_id = al.shape_id AND own.start = inn.start""")
def b8a(spark, d):
    r = fx.radial(spark, d)
    return shapes.sliding_sums(shapes.layers(r.where("channel = 'emb'"), shapes.nucleus_boundary(r), 3), _all_shapes(spark), 3)


@query("b9_b10_what_if", f"{_WHATIF} SELECT 'emb' AS image_id, {L(O, O)}, 'emb' AS channel, {L('shape_id', 'shape_id')}, {L('n', 'n')}, {D('marker', 'marker')}, 'ok' AS status FROM wi")
def b10(spark, d):
    return _what_if(spark, d, _all_shapes(spark))


_HIST = f"""{_WHATIF}, me AS (SELECT {O}, avg(value) AS mean FROM rad GROUP BY {O}), ow AS (SELECT {O}, min(marker) AS lo, max(marker) AS hi, min(mean) AS mean FROM wi JOIN me USING ({O}) GROUP BY {O}),
en AS (SELECT min(lo - mean) AS a, max(hi - mean) AS b FROM ow),
fi AS (SELECT {O}, lo, hi, mean, CASE WHEN hi > lo THEN least(999, floor((marker - lo) * (1000 / (hi - lo)))) ELSE 500 END AS j FROM wi JOIN ow USING ({O})),
po AS (SELECT {O}, a, b, (lo - mean) + j * ((hi - lo) / 999) AS x FROM fi, en),
bi AS (SELECT {O}, a, b, CASE WHEN b > a THEN least(100, ceil(round((x - a) / ((b - a) / 100), 9))) - 1 ELSE -1 END AS i FROM po),
hi AS (SELECT {O}, a, b, CASE WHEN i < 0 THEN 99 ELSE i END AS bin FROM bi),
hg AS (SELECT {O}, CAST(bin AS INT) AS bin, a + bin * ((b - a) / 99) AS grid, count(*) AS n FROM hi GROUP BY ALL)"""


@query("b11_histogram", f"{_HIST} SELECT 'emb' AS image_id, {L(O, O)}, 'emb' AS channel, {L('bin', 'bin')}, {D('grid', 'grid')}, {L('n', 'n')} FROM hg")
def b11(spark, d):
    return shapes.histogram(_what_if(spark, d, _all_shapes(spark)), _means(spark, d), shapes.n_shapes(8, 2, 0, 0.4))


def _means(spark, d):
    return fx.radial(spark, d).where("channel = 'emb'").groupBy("image_id", "ObjectNumber", "channel").agg(F.avg("value").alias("value"))


@query("b13_histogram_mean", f"{_HIST} SELECT 'emb' AS image_id, {L(O, O)}, 'emb' AS channel, {D('sum(n * grid) / sum(n)', 'mean')} FROM hg GROUP BY {O}")
def b13(spark, d):
    return shapes.histogram_mean(shapes.histogram(_what_if(spark, d, _all_shapes(spark)), _means(spark, d), shapes.n_shapes(8, 2, 0, 0.4)))


_SUM = f"{D('max(marker)', 'max')}, {D('min(marker)', 'min')}, {D('avg(marker)', 'mean')}, {D('median(marker)', 'median')}, {D('stddev_pop(marker)', 'sd')}, {D('max(marker) - min(marker)', 'range')}, {D('stddev_pop(marker) / nullif(avg(marker), 0)', 'cv')}"


@query("b12_summaries", f"{_WHATIF} SELECT 'emb' AS image_id, {L(O, O)}, 'emb' AS channel, {_SUM} FROM wi GROUP BY {O}")
def b12(spark, d):
    return shapes.marker_summaries(_what_if(spark, d, _all_shapes(spark)))


def _listed_shapes(dmax: int) -> str:
    """CTE sh: angles and depths of the shapes of widths 1 to 3 of 8 angles; those of width 0, with the ids 0 to 7, have none."""
    first = [8, 8 + 8 * dmax, 8 + 8 * dmax + 8 * dmax**2]
    ids = " ".join(f"WHEN {w} THEN {first[w - 1]} + s.s * {dmax**w} + c.c" for w in (1, 2, 3))
    power = lambda x: f"CAST(pow({dmax}, {x}) AS INT)"
    return f"""sh0 AS (SELECT w.w AS wd, s.s AS start, c.c AS code, CAST(CASE w.w {ids} END AS INT) AS shape_id FROM range(1, 4) w(w), range(8) s(s), range({dmax**3}) c(c) WHERE c.c < {power("w.w")}),
sh AS (SELECT shape_id, CAST((start + i.i) % 8 AS INT) AS angle, CAST((code // {power("i.i")}) % {dmax} + 1 AS INT) AS depth FROM sh0, range(3) i(i) WHERE i.i < wd)"""


#: prof: the profiles of the embeddings with their own nucleus.
_EMB = f"prof AS (SELECT 'emb' AS image_id, {O}, 'emb' AS channel, angle, ring, value, own FROM rad)"


def _listed_markers(prof: str, dmax: int, maxdist: int) -> str:
    """CTE wi: the marker of each cell, channel, shape and (where two-layer patterns are moved) start."""
    starts = maxdist - 1 if shapes.slides(dmax, maxdist) else 1
    return f"""w AS (SELECT 1), {prof}, {_listed_shapes(dmax)},
bd AS (SELECT image_id, {O}, angle, coalesce(min(ring) FILTER (own >= 1), 0) AS inner_, coalesce(max(ring) FILTER (own >= 1) + 1, 0) AS outer_ FROM prof GROUP BY ALL),
ok AS (SELECT image_id, {O}, max(outer_) + {maxdist} <= (SELECT max(ring) FROM prof) AS fits FROM bd GROUP BY ALL),
nu AS (SELECT image_id, {O}, channel, sum(value) AS ns, count(*) AS nn FROM prof JOIN bd USING (image_id, {O}, angle) WHERE ring BETWEEN inner_ AND outer_ GROUP BY ALL),
ly AS (SELECT image_id, {O}, channel, angle, ring - outer_ AS layer, value FROM prof JOIN bd USING (image_id, {O}, angle) WHERE ring - outer_ BETWEEN 0 AND {maxdist - 1}),
inn AS (SELECT image_id, {O}, channel, t.t AS start, coalesce(sum(value) FILTER (layer < t.t), 0) AS s, count(*) FILTER (layer < t.t) AS n FROM ly, range({starts}) t(t) GROUP BY ALL),
sr AS (SELECT ly.*, t.t AS start, layer - t.t + 1 AS depth, sum(value) OVER (PARTITION BY image_id, {O}, channel, angle, t.t ORDER BY layer) AS run FROM ly, range({starts}) t(t) WHERE layer >= t.t),
oo AS (SELECT image_id, {O}, channel, shape_id, start, sum(run) AS s, sum(depth) AS n FROM sr JOIN sh USING (angle, depth) GROUP BY ALL),
every AS (SELECT DISTINCT shape_id FROM sh UNION ALL SELECT CAST(i.i AS INT) FROM range(8) i(i)),
wi AS (SELECT image_id, {O}, channel, shape_id, start, inn.n + coalesce(oo.n, 0) AS n, CASE WHEN fits THEN (ns + inn.s + coalesce(oo.s, 0)) / (nn + inn.n + coalesce(oo.n, 0)) END AS marker, CASE WHEN fits THEN 'ok' ELSE 'past_last_ring' END AS status
 FROM inn CROSS JOIN every LEFT JOIN oo USING (image_id, {O}, channel, shape_id, start) JOIN nu USING (image_id, {O}, channel) JOIN ok USING (image_id, {O}))"""


@query("b1_subset_sums", f"""w AS (SELECT 1), {_EMB}, m AS (SELECT s.s AS bits, list_filter(range(8), lambda x: (s.s >> x) & 1 = 1) AS angles FROM range(256) s(s)),
su AS (SELECT angles, row_number() OVER (ORDER BY len(angles), angles) - 1 AS subset_id FROM m)
SELECT image_id, {L(O, O)}, channel, {L('subset_id', 'subset_id')}, {L('len(angles)', 'size')}, {D('coalesce(sum(value) FILTER (list_contains(angles, angle)), 0)', 'total')} FROM prof, su WHERE ring = 0 GROUP BY image_id, {O}, channel, subset_id, angles""")
def b1(spark, d):
    inner = fx.radial(spark, d).where("channel = 'emb' and ring = 0").groupBy(*shapes.PROFILE).agg(F.map_from_entries(F.collect_list(F.struct("angle", "value"))).alias("v"))
    pick = F.transform("angles", lambda a: F.coalesce(F.try_element_at("v", a), F.lit(0.0)))
    every = inner.join(F.broadcast(shapes.angle_subsets(spark, 8)))  # 2^8 subsets, fixed by the number of angles
    return every.select(*shapes.PROFILE, "subset_id", "size", F.aggregate(pick, F.lit(0.0), lambda a, b: a + b).alias("total"))


@query("b10_sliding_what_if", f"{_listed_markers(_EMB, 2, 3)} SELECT image_id, {L(O, O)}, channel, {L('shape_id', 'shape_id')}, {L('start', 'start')}, {L('n', 'n')}, {D('marker', 'marker')}, status FROM wi")
def b10_sliding(spark, d):
    return shapes.what_if(fx.radial(spark, d), _all_shapes(spark), 3)


@query("b12_summaries_by_angle", f"{_listed_markers(_EMB, 3, 3)} SELECT image_id, {L(O, O)}, channel, {_SUM} FROM wi WHERE marker IS NOT NULL GROUP BY image_id, {O}, channel")
def b12_by_angle(spark, d):
    return shapes.what_if_summaries(fx.radial(spark, d))


@query("b11_histogram_by_angle", f"{_listed_markers(_EMB, 3, 3)}, " + _HIST[_HIST.index("me AS"):] + f" SELECT 'emb' AS image_id, {L(O, O)}, 'emb' AS channel, {L('bin', 'bin')}, {D('grid', 'grid')}, {L('n', 'n')} FROM hg")
def b11_by_angle(spark, d):
    return shapes.what_if_histogram(fx.radial(spark, d), _means(spark, d))


@query("b12_widest", f"{_listed_markers(_EMB, 3, 3)}, sd AS (SELECT image_id, {O}, channel, round(stddev_pop(marker), 9) AS sd FROM wi WHERE marker IS NOT NULL GROUP BY ALL) SELECT image_id, channel, {L(f'arg_min({O}, (-sd, {O}))', O)}, {D('max(sd)', 'sd')} FROM sd GROUP BY image_id, channel")
def b12_widest(spark, d):
    return shapes.widest(shapes.what_if_summaries(fx.radial(spark, d)).withColumn("sd", F.round("sd", 9)))


#: prof: the profiles of all channels with their own nucleus, 12 rings.
_TWELVE = _RADIAL.removeprefix("w AS (SELECT 1), ").replace(_LUT, "lut(dr, dc, angle, ring) AS (VALUES " + ", ".join(map(str, polar.lookup(8, 12))) + ")").replace("bn AS (SELECT DISTINCT angle, ring FROM lut)", "bn AS (SELECT CAST(a.a AS INT) AS angle, CAST(r.r AS INT) AS ring FROM range(8) a(a), range(12) r(r))") + f""",
prof AS (SELECT a.image_id, a.{O}, a.channel, a.angle, a.ring, a.value, b.value AS own FROM rp a JOIN rp b USING (image_id, {O}, angle, ring) WHERE b.channel = 'own_nucleus' AND NOT regexp_matches(a.channel, '_(cell|nucleus)$'))"""


@query("r1_r2_r4_twelve_rings", f"w AS (SELECT 1), {_TWELVE} SELECT {_BIN}, {D('value', 'value')}, {D('cumulative', 'cumulative')}, {L('n', 'n')} FROM rp")
def r4_twelve(spark, d):
    m, n = fx.mask(spark, d), fx.mask_nuc(spark, d)
    return polar.radial(fx.pixels(spark, d), cells.boxes(n).select("image_id", "ObjectNumber", "x", "y"), polar.lookup(8, 12), polar.membership(m, n), (8, 12))


@query("w2_boundary_what_if_job", f"{_listed_markers(_TWELVE, 3, 3)} SELECT image_id, {L(O, O)}, channel, {_SUM} FROM wi WHERE marker IS NOT NULL GROUP BY image_id, {O}, channel")
def w2(spark, d):
    return workloads.boundary_what_if(fx.pixels(spark, d), fx.mask(spark, d), fx.mask_nuc(spark, d))


# --- affine jitter -----------------------------------------------------------------------------------------------------


@query("u2_t3_largest_cells", f"""w AS (SELECT image_id, label AS o, max(row) - min(row) + 1 AS h, max(col) - min(col) + 1 AS wd, count(*) AS a FROM mk WHERE label <> 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY h DESC, o) AS rh, row_number() OVER (PARTITION BY image_id ORDER BY wd DESC, o) AS rw, row_number() OVER (PARTITION BY image_id ORDER BY a DESC, o) AS ra, count(*) OVER (PARTITION BY image_id) AS n FROM w)
SELECT image_id, {L('o', O)}, {L('h', 'height')}, {L('wd', 'width')}, {L('a', 'area')} FROM r WHERE n < 10 OR (rh <= floor(n * 0.1) AND rw <= floor(n * 0.1) AND ra <= floor(n * 0.1))""")
def u2(spark, d):
    return affine.largest_cells(fx.mask(spark, d))


def _unit(ids: str, name: str) -> str:
    return f"((('0x' || substr(md5({ids} || '|42:{name}'), 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52})"


def _params(ids: str) -> str:
    """tx .. shy of rows, hashed from ids."""
    return ", ".join(f"{lo!r}::DOUBLE + {_unit(ids, n)} * ({hi!r}::DOUBLE - ({lo!r}::DOUBLE)) AS {n}" for n, (lo, hi) in affine.RANGES.items())


#: The matrix of a row's tx .. shy, and its offset about a centre cx, cy.
_MATRIX = "cos(rot) * sx - sin(rot) * shy * sx AS m00, cos(rot) * shx * sy - sin(rot) * sy AS m01, sin(rot) * sx + cos(rot) * shy * sx AS m10, sin(rot) * shx * sy + cos(rot) * sy AS m11"
_OFFSET = "cx - (m00 * cx + m01 * cy) + tx AS m02, cy - (m10 * cx + m11 * cy) + ty AS m12"


@query("t1_t2_random_transforms_of_cells", f"""w AS (SELECT DISTINCT image_id, label, 4.0::DOUBLE AS cx, 4.0::DOUBLE AS cy FROM mk WHERE label <> 0), j AS (SELECT *, {_params("image_id || '|' || label")} FROM w), m AS (SELECT *, {_MATRIX} FROM j), o AS (SELECT *, {_OFFSET} FROM m)
SELECT image_id, {L('label', 'label')}, {", ".join(D(c, c) for c in ("tx", "ty", "rot", "sx", "sy", "shx", "shy", "m00", "m01", "m02", "m10", "m11", "m12"))} FROM o""")
def t1(spark, d):
    c = fx.mask(spark, d).where("label <> 0").select("image_id", "label").distinct()
    return affine.with_matrix(affine.random_transforms(c), 4.0, 4.0)


#: most: how far large cells get out of their boxes under the extreme transforms.
_PADS = f"""w AS (SELECT image_id, label AS o, max(row) - min(row) + 1 AS h, max(col) - min(col) + 1 AS wd, count(*) AS a FROM mk WHERE label <> 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY h DESC, o) AS rh, row_number() OVER (PARTITION BY image_id ORDER BY wd DESC, o) AS rw, row_number() OVER (PARTITION BY image_id ORDER BY a DESC, o) AS ra, floor(count(*) OVER (PARTITION BY image_id) * 0.1) AS n FROM w),
big AS (SELECT DISTINCT image_id, h, wd FROM r WHERE n < 1 OR (rh <= n AND rw <= n AND ra <= n)),
tf AS (SELECT 2.0 * (g // 64 % 2) - 1 AS tx, 2.0 * (g // 32 % 2) - 1 AS ty, (2 * (g // 16 % 2) - 1) * pi() / 12 AS rot, 0.8::DOUBLE + 0.4::DOUBLE * (g // 8 % 2) AS sx, 0.8::DOUBLE + 0.4::DOUBLE * (g // 4 % 2) AS sy, 0.2::DOUBLE * (g // 2 % 2) - 0.1::DOUBLE AS shx, 0.2::DOUBLE * (g % 2) - 0.1::DOUBLE AS shy FROM range(128) t(g)),
mt AS (SELECT tx, ty, cos(rot) * sx - sin(rot) * shy * sx AS m00, cos(rot) * shx * sy - sin(rot) * sy AS m01, sin(rot) * sx + cos(rot) * shy * sx AS m10, sin(rot) * shx * sy + cos(rot) * sy AS m11 FROM tf),
co AS (SELECT image_id, h, wd, (wd - 1) / 2.0::DOUBLE AS cx, (h - 1) / 2.0::DOUBLE AS cy, i * h - (wd - 1) / 2.0::DOUBLE AS dx, j * wd - (h - 1) / 2.0::DOUBLE AS dy FROM big, range(2) a(i), range(2) b(j)),
ov AS (SELECT image_id, max(greatest(0, -(cx + tx + m00 * dx + m01 * dy), cx + tx + m00 * dx + m01 * dy - h, -(cy + ty + m10 * dx + m11 * dy), cy + ty + m10 * dx + m11 * dy - wd)) AS most FROM co, mt GROUP BY image_id)"""


@query("t2_t3_padding", f"""{_PADS} SELECT img.image_id, {L('coalesce(ceil(round(most, 9)) + 1, 1)', 'pad')} FROM img LEFT JOIN ov USING (image_id)""")
def t3(spark, d):
    return affine.padding(fx.mask(spark, d), affine.transform_grid(spark, 2))


@query("t5_closing", f"w AS (SELECT a.image_id, a.row, a.col, max(b.label) AS label FROM mk a JOIN mk b ON a.image_id = b.image_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL) SELECT a.image_id, {L('a.row', 'row')}, {L('a.col', 'col')}, {L('min(b.label)', 'label')} FROM w a JOIN w b ON a.image_id = b.image_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a.image_id, a.row, a.col")
def t5(spark, d):
    return stencil.closing(fx.mask(spark, d))


def _masks(n: int) -> str:
    """CTE rm: n random masks of each image (iter, row, col, label), closed."""
    near = lambda name, source, f: f"{name} AS (SELECT a.image_id, a.iter, a.row, a.col, {f}(b.label) AS label FROM {source} a JOIN {source} b ON a.image_id = b.image_id AND a.iter = b.iter AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL)"
    ids = "image_id || '|' || o || '|' || iter"
    return f"""{_PADS},
bx AS (SELECT image_id, label AS o, min(row) AS r0, min(col) AS c0, max(row) + 1 - min(row) AS h, max(col) + 1 - min(col) AS wd FROM mk WHERE label <> 0 GROUP BY ALL),
pd AS (SELECT img.image_id, coalesce(ceil(round(most, 9)) + 1, 1) AS pad FROM img LEFT JOIN ov USING (image_id)),
ji AS (SELECT image_id, o, i.i AS iter, c0 + h / 2.0::DOUBLE + least(r0, pad) - least(c0, pad) AS cx, r0 + wd / 2.0::DOUBLE + least(c0, pad) - least(r0, pad) AS cy FROM bx JOIN pd USING (image_id), range({n}) i(i)),
jp AS (SELECT *, {_params(ids)} FROM ji), jm AS (SELECT *, {_MATRIX} FROM jp), jo AS (SELECT *, {_OFFSET} FROM jm),
tg AS (SELECT jo.image_id, o, iter, row, col, (m11 * (col - m02) - m01 * (row - m12)) / (m00 * m11 - m01 * m10) AS x, (m00 * (row - m12) - m10 * (col - m02)) / (m00 * m11 - m01 * m10) AS y FROM jo JOIN gr USING (image_id)),
tn AS (SELECT tg.* FROM tg JOIN bx USING (image_id, o) WHERE x > c0 - 1 AND x < c0 + wd AND y > r0 - 1 AND y < r0 + h),
tk AS (SELECT image_id, o, iter, row, col, x, y, CAST(floor(y) + a.a AS INT) AS sr, CAST(floor(x) + b.b AS INT) AS sc FROM tn, range(2) a(a), range(2) b(b)),
pt AS (SELECT tk.image_id, o, iter, tk.row, tk.col FROM tk JOIN mk ON mk.image_id = tk.image_id AND mk.row = sr AND mk.col = sc AND mk.label = o GROUP BY tk.image_id, o, iter, tk.row, tk.col HAVING sum((1 - abs(y - sr)) * (1 - abs(x - sc))) >= 0.5 - 1e-9),
la AS (SELECT image_id, iter, row, col, arg_max(o, (md5(image_id || '|' || iter || '|' || o || '|42:paint'), o)) AS label FROM pt GROUP BY ALL),
dn AS (SELECT gr.image_id, i.i AS iter, gr.row, gr.col, coalesce(label, 0) AS label FROM gr CROSS JOIN range({n}) i(i) LEFT JOIN la ON la.image_id = gr.image_id AND la.iter = i.i AND la.row = gr.row AND la.col = gr.col),
{near("hi", "dn", "max")}, {near("rm", "hi", "min")}"""


@query("t4_random_masks", f"{_masks(3)} SELECT image_id, {L('iter', 'iter')}, {L('row', 'row')}, {L('col', 'col')}, {L('label', 'label')} FROM rm")
def t4(spark, d):
    return affine.random_masks(fx.mask(spark, d), 3)


@query("t6_affine_medians", f"""{_masks(10)}, ar AS (SELECT image_id, label AS o, count(*) AS area FROM mk WHERE label <> 0 GROUP BY ALL),
me AS (SELECT rm.image_id, label AS o, iter, channel, avg(value) AS m FROM rm JOIN px USING (image_id, row, col) WHERE label <> 0 GROUP BY ALL),
md AS (SELECT image_id, o, channel, median(m) AS med FROM me GROUP BY ALL)
SELECT ar.image_id, {L('ar.o', O)}, {L('area', 'area')}, c.channel, {D('med', 'median')} FROM ar CROSS JOIN (VALUES ('A'), ('N'), ('R')) c(channel) LEFT JOIN md ON md.image_id = ar.image_id AND md.o = ar.o AND md.channel = c.channel""")
def t6(spark, d):
    return affine.affine_medians(fx.pixels(spark, d), fx.mask(spark, d))


def _grid(names: dict[str, tuple[float, float]]) -> str:
    return ", ".join(f"{lo!r}::DOUBLE + (g // {3 ** (len(names) - 1 - i)} % 3) * ({(hi - lo) / 2!r}::DOUBLE) AS {n}" for i, (n, (lo, hi)) in enumerate(names.items()))


#: The masks of all images are alike, so targets are found for one of them; cells of 8 pixels move by fewer than 8.
_DIRECT = f"""{_PADS.replace("mt AS (SELECT tx, ty, ", f"t3 AS (SELECT {_grid(affine.RANGES)} FROM range(2187) t(g)), mt AS (SELECT tx, ty, ").replace("FROM tf)", "FROM t3)")},
o1 AS (SELECT min(image_id) AS image_id, max(coalesce(ceil(round(most, 9)) + 1, 1)) AS pad FROM img LEFT JOIN ov USING (image_id)),
m1 AS (SELECT mk.row, mk.col, label AS o, pad FROM mk JOIN o1 USING (image_id) WHERE label <> 0),
bx AS (SELECT o, any_value(pad) AS pad, min(row) AS r0, min(col) AS c0, max(row) + 1 - min(row) AS h, max(col) + 1 - min(col) AS wd FROM m1 GROUP BY o),
ce AS (SELECT *, c0 + (h - 1) / 2.0::DOUBLE + least(r0, pad) - least(c0, pad) AS cx, r0 + (wd - 1) / 2.0::DOUBLE + least(c0, pad) - least(r0, pad) AS cy FROM bx),
tm AS (SELECT *, row_number() OVER () AS k FROM mt), jo AS (SELECT ce.*, k, m00, m01, m10, m11, {_OFFSET} FROM ce, tm),
tg AS (SELECT jo.*, r0 - 8 + i.i AS row, c0 - 8 + j.j AS col FROM jo, range(24) i(i), range(24) j(j)),
tn AS (SELECT o, k, row, col, r0, c0, h, wd, (m11 * (col - m02) - m01 * (row - m12)) / (m00 * m11 - m01 * m10) AS x, (m00 * (row - m12) - m10 * (col - m02)) / (m00 * m11 - m01 * m10) AS y FROM tg WHERE row BETWEEN 0 AND {fx.SIDE - 1} AND col BETWEEN 0 AND {fx.SIDE - 1}),
tk AS (SELECT o, k, row, col, x, y, CAST(floor(y) + a.a AS INT) AS sr, CAST(floor(x) + b.b AS INT) AS sc FROM tn, range(2) a(a), range(2) b(b) WHERE x > c0 - 1 AND x < c0 + wd AND y > r0 - 1 AND y < r0 + h),
pt AS (SELECT tk.o, k, tk.row, tk.col FROM tk JOIN m1 ON m1.row = sr AND m1.col = sc AND m1.o = tk.o GROUP BY tk.o, k, tk.row, tk.col HAVING sum((1 - abs(y - sr)) * (1 - abs(x - sc))) >= 0.5 - 1e-9),
me AS (SELECT image_id, o, k, channel, avg(value) AS m FROM pt JOIN px USING (row, col) GROUP BY ALL),
md AS (SELECT image_id, o, channel, median(m) AS med FROM me GROUP BY ALL),
ar AS (SELECT image_id, label AS o, count(*) AS area FROM mk WHERE label <> 0 GROUP BY ALL)"""


@query("t7_direct_medians", f"{_DIRECT} SELECT image_id, {L('o', O)}, {L('area', 'area')}, channel, {D('med', 'median')} FROM ar JOIN md USING (image_id, o)")
def t7(spark, d):
    return affine.direct_affine_medians(fx.pixels(spark, d), fx.mask(spark, d), affine.transform_grid(spark))
