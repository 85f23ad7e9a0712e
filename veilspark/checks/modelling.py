"""Counts, noise, dependence, networks and conditional tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import marginals as M
from ..operators.encode import fit_codec
from ..operators.model import fit_codes, fit_table, release_share
from .encoding import binned, bounds_cte
from .fixtures import CAT, DRAWS, NUM, PRIORITIES
from .registry import check, laplace_sql, q6, quoted, r6, table, u_sql

LINE_ROLES = {"l_linenumber": CAT, "l_quantity": NUM, "l_discount": NUM, "l_tax": NUM, "l_returnflag": CAT, "l_linestatus": CAT}
LINE = list(LINE_ROLES)
EPS = 0.5


def line_codes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    codec = fit_codec(lines, LINE_ROLES, LINE, 32)
    return codec.encode(lines), codec.sizes


LINE_CODES = f"""{bounds_cte('lineitem', [c for c in LINE if LINE_ROLES[c] == NUM])},
codes AS (SELECT {", ".join(f"{binned(c, 32)} AS {c}" if LINE_ROLES[c] == NUM
                            else f"(dense_rank() OVER (ORDER BY {c}) - 1)::INTEGER AS {c}" for c in LINE)} FROM lineitem, b)"""
PAIRS = "pairs AS (" + " UNION ALL ".join(
    f"SELECT '{a}|{b}' AS family, {a}::BIGINT AS pidx, {b} AS code, count(*) AS cnt FROM codes GROUP BY {a}, {b}"
    for a, b in combinations(LINE, 2)) + ")"


def line_pairs(spark, sf_dir):
    codes, sizes = line_codes(spark, sf_dir)
    families = M.layout(M.all_pairs(LINE), sizes)
    return M.dense_counts(spark, families, M.cell_counts(codes, families))


@check(" UNION ALL ".join(f"SELECT '{c}' AS family, {c} AS code, count(*) AS cnt FROM (WITH {LINE_CODES} SELECT * FROM codes) GROUP BY {c}" for c in LINE))
def marginals_1way(spark, sf_dir):
    codes, sizes = line_codes(spark, sf_dir)
    families = M.layout([(c,) for c in LINE], sizes)
    return M.dense_counts(spark, families, M.cell_counts(codes, families)).filter("cnt > 0").select("family", "code", "cnt")


@check(f"WITH {LINE_CODES}, {PAIRS} SELECT * FROM pairs")
def marginals_2way(spark, sf_dir):
    return line_pairs(spark, sf_dir).filter("cnt > 0").select("family", "pidx", "code", "cnt")


@check(f"WITH {LINE_CODES}, {PAIRS} SELECT family, pidx, code, {q6('cnt / sum(cnt) OVER (PARTITION BY family)')} AS freq FROM pairs")
def marginal_freq(spark, sf_dir):
    return M.frequencies(line_pairs(spark, sf_dir)).filter("cnt > 0").select("family", "pidx", "code", r6("freq").alias("freq"))


MI = """freq AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY family) AS p FROM pairs),
margins AS (SELECT *, sum(p) OVER (PARTITION BY family, pidx) AS px, sum(p) OVER (PARTITION BY family, code) AS py FROM freq),
mi AS (SELECT family, sum(p * ln(p / (px * py + 1e-15::DOUBLE) + 1e-15::DOUBLE)) AS mi FROM margins GROUP BY family),
scores AS (SELECT split_part(family, '|', 1) AS a, split_part(family, '|', 2) AS b, mi FROM mi
  UNION ALL SELECT split_part(family, '|', 2), split_part(family, '|', 1), mi FROM mi)"""
ORDINAL = "list_position([" + ", ".join(map(quoted, LINE)) + "], a)"


def line_mi(spark, sf_dir):
    return M.mutual_information(M.frequencies(line_pairs(spark, sf_dir)), "freq")


@check(f"WITH {LINE_CODES}, {PAIRS}, {MI} SELECT family, {q6('mi')} AS mi FROM mi")
def mutual_information(spark, sf_dir):
    return line_mi(spark, sf_dir).select("family", r6("mi").alias("mi"))


def best_sql(where=""):
    return f"""SELECT a AS column_name, {q6('sum(mi)')} AS score FROM scores {where} GROUP BY a
    ORDER BY round(sum(mi), 12) DESC, {ORDINAL} LIMIT 1"""


@check(f"WITH {LINE_CODES}, {PAIRS}, {MI} {best_sql()}")
def bn_root(spark, sf_dir):
    return M.rank_root(M.symmetric_scores(line_mi(spark, sf_dir)), LINE).select("column_name", r6("score").alias("score"))


CHOSEN = ["l_quantity", "l_discount", "l_linestatus"]


@check(f"""WITH {LINE_CODES}, {PAIRS}, {MI}
{best_sql("WHERE b IN ('l_discount', 'l_linestatus') AND a NOT IN ('l_quantity', 'l_discount', 'l_linestatus')")}""")
def bn_next_column(spark, sf_dir):
    return M.rank_next(M.symmetric_scores(line_mi(spark, sf_dir)), LINE, CHOSEN, 2).select("column_name", r6("score").alias("score"))


@check(f"""SELECT o_orderkey, {q6(laplace_sql(u_sql("'row'", "o_orderkey"), "2.0::DOUBLE"))} AS noise FROM orders""")
def laplace_noise(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", r6(DRAWS.laplace(2.0, "row", F.col("o_orderkey"))).alias("noise"))


STATES = ["F", "O", "P", "X"]  # X never occurs


def status_by_priority(spark, sf_dir):
    """Noisy marginal over a public domain with a value that no row has."""
    orders = table(spark, sf_dir, "orders")
    codec = fit_codec(orders, {}, ["o_orderstatus", "o_orderpriority"], 32,
                      domains={"o_orderstatus": STATES, "o_orderpriority": PRIORITIES})
    families = M.layout([("o_orderstatus", "o_orderpriority")], codec.sizes)
    dense = M.dense_counts(spark, families, M.cell_counts(codec.encode(orders), families))
    return M.noisy_marginals(dense, orders.agg(F.count(F.lit(1))).scalar(), EPS, DRAWS)


NOISY = f"""grid AS (SELECT 'o_orderstatus|o_orderpriority' AS family, s AS pidx, p::INTEGER AS code,
    [{', '.join(map(quoted, STATES))}][s + 1] AS sv, [{', '.join(map(quoted, PRIORITIES))}][p + 1] AS pv FROM range({len(STATES)}) a(s), range(5) b(p)),
  total AS (SELECT count(*) AS n FROM orders),
  dense AS (SELECT family, pidx, code, coalesce(cnt, 0) AS cnt FROM grid LEFT JOIN (
    SELECT o_orderstatus AS sv, o_orderpriority AS pv, count(*) AS cnt FROM orders GROUP BY 1, 2) USING (sv, pv)),
  noisy AS (SELECT family, pidx, code, cnt, cnt / n + {laplace_sql(u_sql("'marginal'", "family", "pidx", "code"),
                                                                   f"(1.0::DOUBLE / n) / {EPS}::DOUBLE")} AS noisy FROM dense, total)"""


@check(f"WITH {NOISY} SELECT pidx, code, cnt, {q6('noisy')} AS noisy FROM noisy")
def noisy_marginal(spark, sf_dir):
    return status_by_priority(spark, sf_dir).select("pidx", "code", "cnt", r6("noisy").alias("noisy"))


@check(f"WITH {NOISY} SELECT pidx, code, {q6('greatest(noisy, 0) / sum(greatest(noisy, 0)) OVER ()')} AS p FROM noisy")
def marginal_postprocess(spark, sf_dir):
    return status_by_priority(spark, sf_dir).select("pidx", "code", r6("p").alias("p"))


# --- conditional tables of orders with a given network ---------------------------------------

ORDER_ROLES = {"o_orderpriority": CAT, "o_orderstatus": CAT, "o_totalprice": NUM}
ORDER_COLUMNS = list(ORDER_ROLES)
NETWORK = [("o_orderpriority", ()), ("o_orderstatus", ("o_orderpriority",)),
           ("o_totalprice", ("o_orderpriority", "o_orderstatus"))]


def order_codes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    codec = fit_codec(orders, ORDER_ROLES, ORDER_COLUMNS, 8)
    return codec.encode(orders), codec


CPT_COUNTS = f"""{bounds_cte('orders', ['o_totalprice'])},
  ocodes AS (SELECT (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS p,
    (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::INTEGER AS s, {binned('o_totalprice', 8)} AS t FROM orders, b),
  counted AS (SELECT 'o_orderpriority' AS family, 0 AS pidx, p AS code, count(*) AS cnt FROM ocodes GROUP BY p
    UNION ALL SELECT 'o_orderstatus', p, s, count(*) FROM ocodes GROUP BY p, s
    UNION ALL SELECT 'o_totalprice', p * 3 + s, t, count(*) FROM ocodes GROUP BY p, s, t),
  grid AS (SELECT 'o_orderpriority' AS family, 0::BIGINT AS pidx, c::INTEGER AS code FROM range(5) r(c)
    UNION ALL SELECT 'o_orderstatus', p, c::INTEGER FROM range(5) a(p), range(3) r(c)
    UNION ALL SELECT 'o_totalprice', p, c::INTEGER FROM range(15) a(p), range(8) r(c)),
  dense AS (SELECT g.*, coalesce(cnt, 0) AS cnt FROM grid g LEFT JOIN counted USING (family, pidx, code)),
  total AS (SELECT count(*) AS n FROM orders)"""


def cpt_sql(mode: str, eps: float, seed: str = "42", suffix: str = "") -> str:
    u = u_sql("'cpt'", "family", "pidx", "code", seed=seed)
    if mode == "joint":
        noisy = f"cnt + {laplace_sql(u, f'1.0::DOUBLE / {eps!r}::DOUBLE')}"
    else:
        share = "CASE WHEN sum(cnt) OVER w > 0 THEN cnt / sum(cnt) OVER w ELSE 0 END"
        noisy = f"{share} + {laplace_sql(u, f'(1.0::DOUBLE / n) / {eps!r}::DOUBLE')}"
    return f"""clipped{suffix} AS (SELECT family, pidx, code, greatest({noisy}, 0.0::DOUBLE) AS v FROM dense, total
    WINDOW w AS (PARTITION BY family, pidx)),
  cpt{suffix} AS (SELECT family, pidx, code, CASE WHEN sum(v) OVER w > 0 THEN v / sum(v) OVER w
    ELSE 1.0::DOUBLE / count(*) OVER w END AS p FROM clipped{suffix} WINDOW w AS (PARTITION BY family, pidx))"""


@check(f"WITH {CPT_COUNTS} SELECT family, pidx, code, cnt FROM dense")
def cpt_counts(spark, sf_dir):
    codes, codec = order_codes(spark, sf_dir)
    families = M.cpt_families(NETWORK, codec.sizes)
    return M.dense_counts(spark, families, M.cell_counts(codes, families)).select("family", "pidx", "code", "cnt")


def both_modes(spark, sf_dir, network):
    codes, codec = order_codes(spark, sf_dir)
    n = codes.agg(F.count(F.lit(1))).scalar()
    frames = [fit_codes(codes, codec.sizes, network, n, EPS, DRAWS, mode).select(F.lit(mode).alias("noise_on"), "*")
              for mode in ("joint", "row")]
    return frames[0].unionByName(frames[1]).select("noise_on", "family", "pidx", "code", r6("p").alias("p"))


BOTH = f"""WITH {CPT_COUNTS}, {cpt_sql('joint', EPS)}, {cpt_sql('row', EPS, suffix='_row')}
SELECT 'joint' AS noise_on, family, pidx, code, {q6('p')} AS p FROM cpt {{where}} UNION ALL
SELECT 'row', family, pidx, code, {q6('p')} FROM cpt_row {{where}}"""


@check(BOTH.format(where="WHERE family = 'o_orderpriority'"))
def cpt_root(spark, sf_dir):
    return both_modes(spark, sf_dir, NETWORK[:1])


@check(BOTH.format(where=""))
def cpt_conditional(spark, sf_dir):
    return both_modes(spark, sf_dir, NETWORK)


MODEL_EPS = 1.0
SHARE = release_share(3, MODEL_EPS)
MODEL = f"{CPT_COUNTS}, {cpt_sql('joint', SHARE, '42/orders')}"


def order_model(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return fit_table(orders, "orders", ORDER_ROLES, MODEL_EPS, orders.count(), ORDER_COLUMNS, 8,
                     draws=DRAWS, network=NETWORK)


@check(f"WITH {MODEL} SELECT family, pidx, code, {q6('p')} AS p FROM cpt")
def fit_table_model(spark, sf_dir):
    return order_model(spark, sf_dir).cpt.select("family", "pidx", "code", r6("p").alias("p"))


# --- three parents at full resolution ----------------------------------------------------------

WIDE_ROLES = {"l_quantity": NUM, "l_extendedprice": NUM, "l_discount": NUM, "l_tax": CAT, "l_linenumber": CAT, "l_returnflag": CAT}
WIDE = list(WIDE_ROLES)
WIDE_NETWORK = [(c, tuple(WIDE[max(0, i - 3):i])) for i, c in enumerate(WIDE)]


def wide_sql() -> str:
    codes = ", ".join(f"{binned(c, 32)} AS {c}" if WIDE_ROLES[c] == NUM else f"(dense_rank() OVER (ORDER BY {c}) - 1)::INTEGER AS {c}" for c in WIDE)
    size = {c: "32" if WIDE_ROLES[c] == NUM else f"(SELECT count(DISTINCT {c}) FROM lineitem)" for c in WIDE}
    counted, grid = [], []
    for child, parents in WIDE_NETWORK:
        flat = "0::BIGINT"
        for p in parents:
            flat = f"({flat} * {size[p]} + {p})"
        rows = " * ".join([size[p] for p in parents] or ["1"])
        counted.append(f"SELECT '{child}' AS family, {flat} AS pidx, {child} AS code, count(*) AS cnt FROM wide GROUP BY 2, 3")
        grid.append(f"SELECT '{child}' AS family, p::BIGINT AS pidx, c::INTEGER AS code FROM range(({rows})::BIGINT) a(p), range(({size[child]})::BIGINT) r(c)")
    return f"""WITH {bounds_cte('lineitem', [c for c in WIDE if WIDE_ROLES[c] == NUM])}, wide AS (SELECT {codes} FROM lineitem, b),
counted AS ({' UNION ALL '.join(counted)}), grid AS ({' UNION ALL '.join(grid)}),
dense AS (SELECT g.*, coalesce(cnt, 0) AS cnt FROM grid g LEFT JOIN counted USING (family, pidx, code)),
{cpt_sql('joint', EPS).replace('FROM dense, total', 'FROM dense')} SELECT family, pidx, code, {q6('p')} AS p FROM cpt"""


@check(wide_sql())
def cpt_three_parents(spark, sf_dir):
    """Every cell of six columns' tables at 32 bins, with three parents each where there are three."""
    lines = table(spark, sf_dir, "lineitem")
    codec = fit_codec(lines, WIDE_ROLES, WIDE, 32)
    n = lines.agg(F.count(F.lit(1))).scalar()
    return fit_codes(codec.encode(lines), codec.sizes, WIDE_NETWORK, n, EPS, DRAWS).select("family", "pidx", "code", r6("p").alias("p"))
