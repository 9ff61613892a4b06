"""SQL twins for readers, clean-up, dedupe, joins and lineage. They state the expected values straight from the tables
rather than taking the printed texts apart again."""
from __future__ import annotations

from ..operators.cleaning import (AIRY, GRID_EAST, GRID_LON, GRID_NORTH, SHIFT, SHIFT_SCALE, grid_constants)

MEASURES = [f"{m}_{g}" for m in ("score", "progress", "basics") for g in ("all", "focus", "rest")]
STOP = "['the', 'school', 'academy', 'college', 'of', 'and', 'a', 'st', 'saint']"


def _printed(value: str) -> str:
    return f"CAST(CAST(round({value}, 1) AS DECIMAL(18, 1)) AS VARCHAR)"


def _tokens(name: str) -> str:
    return (f"[w FOR w IN list_distinct(regexp_extract_all(lower(coalesce({name}, '')), '[a-z0-9]+')) "
            f"IF NOT list_contains({STOP}, w)]")


def _jaccard(a: str, b: str) -> str:
    return (f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / "
            f"CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE) END")


ROUNDED = ", ".join(f"round({m}, 1) AS {m}" for m in MEASURES)


def _locate() -> str:
    k = grid_constants()
    xi = " - ".join(["xi", *[f"{k[f'i{j}']!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j in range(1, 5)]])
    eta = " - ".join(["eta", *[f"{k[f'i{j}']!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j in range(1, 5)]])
    phi = " + ".join(["chi", *[f"({k[f'd{j}']!r}) * sin({2 * j} * chi)" for j in range(1, 5)]])
    s = 1 + SHIFT_SCALE
    return f"""
        SELECT c_custkey,
               degrees(atan2(z2 + {k['s2'] * k['b2']!r} * sin(th) ** 3, p - {k['f2'] * k['a2']!r} * cos(th) ** 3))
                   AS latitude, degrees(atan2(y2, x2)) AS longitude
        FROM (SELECT *, atan2(z2 * {k['a2']!r}, p * {k['b2']!r}) AS th
        FROM (SELECT *, sqrt(x2 * x2 + y2 * y2) AS p
        FROM (SELECT c_custkey, {SHIFT[0]} + {s!r} * x - {k['rz']!r} * y + {k['ry']!r} * z AS x2,
                     {SHIFT[1]} + {k['rz']!r} * x + {s!r} * y - {k['rx']!r} * z AS y2,
                     {SHIFT[2]} - {k['ry']!r} * x + {k['rx']!r} * y + {s!r} * z AS z2
        FROM (SELECT c_custkey, nu * cos(phi) * cos(lam) AS x, nu * cos(phi) * sin(lam) AS y,
                     {1 - k['e2']!r} * nu * sin(phi) AS z
        FROM (SELECT *, {AIRY[0]!r} / sqrt(1 - {k['e2']!r} * sin(phi) ** 2) AS nu
        FROM (SELECT c_custkey, lam, {phi} AS phi
        FROM (SELECT c_custkey, asin(sin(u) / cosh(v)) AS chi, radians({GRID_LON}) + atan2(sinh(v), cos(u)) AS lam
        FROM (SELECT c_custkey, {xi} AS u, {eta} AS v
        FROM (SELECT c_custkey, (100000.0 + (c_custkey * 53) % 500000 - ({GRID_NORTH})) / {k['radius']!r}
                                    + {k['origin']!r} AS xi,
                     (200000.0 + (c_custkey * 37) % 400000 - {GRID_EAST}) / {k['radius']!r} AS eta
              FROM customer)))))))))"""


def _components(edges: str, a: str, b: str) -> str:
    return f"""
        SELECT node, max(other) AS component
        FROM (WITH RECURSIVE both_ways AS (SELECT {a} AS x, {b} AS y FROM {edges} UNION SELECT {b}, {a} FROM {edges}),
                   reach(node, other) AS (SELECT x, x FROM both_ways UNION
                                          SELECT r.node, e.y FROM reach r JOIN both_ways e ON e.x = r.other)
              SELECT * FROM reach) AS r GROUP BY node"""


def _lineage(prefix: str, register: str) -> dict[str, tuple[str, str]]:
    """The lineage relations for one register."""
    p = prefix
    return {
        f"{p}alone": ("first_groups", "SELECT max(unit_id) AS unit_id FROM first_groups GROUP BY component "
                                      "HAVING count(*) = 1"),
        f"{p}met": (f"{p}alone {register}", f"""
            SELECT a.unit_id AS old_unit, b.unit_id AS new_unit FROM {register} a JOIN {register} b USING (postcode)
            WHERE a.unit_id <> b.unit_id AND a.unit_id IN (SELECT unit_id FROM {p}alone)
              AND b.unit_id IN (SELECT unit_id FROM {p}alone)
              AND abs(date_diff('day', a.close_date, b.open_date)) <= 60
              AND {_jaccard('a.tokens', 'b.tokens')} >= 0.5"""),
        f"{p}second": (f"{p}met", _components(f"{p}met", "old_unit", "new_unit")),
        f"{p}joined": (f"{p}second first_groups", f"""
            SELECT f.unit_id, f.period, CASE WHEN s.node IS NOT NULL THEN 'b' || CAST(s.component AS VARCHAR)
                                             ELSE 'a' || CAST(f.component AS VARCHAR) END AS component,
                   CASE WHEN s.node IS NOT NULL THEN 'postcode_match' WHEN f.is_linked THEN 'gias_link'
                        ELSE 'self' END AS method
            FROM first_groups f LEFT JOIN {p}second s ON s.node = f.unit_id"""),
        f"{p}lineages": (f"{p}joined", f"""
            SELECT unit_id, CASE WHEN bad OR n = 1 THEN unit_id ELSE top END AS lineage_id,
                   CASE WHEN bad OR n = 1 THEN 'self' ELSE method END AS lineage_method
            FROM (SELECT unit_id, method, count(*) OVER c AS n, max(unit_id) OVER c AS top,
                         component IN (SELECT component FROM {p}joined GROUP BY component, period HAVING count(*) > 1)
                             AS bad
                  FROM {p}joined WINDOW c AS (PARTITION BY component)) AS j"""),
    }


_LONG_COLUMNS = """period_label, period, unit_id, 'Unit ' || CAST(unit_id AS VARCHAR) AS result_name,
    CAST(NULL AS VARCHAR) AS result_postcode, is_special, n_total, n_focus, n_rest, pct_focus"""

RELATIONS = {
    "order_dim": ("", f"""
        SELECT o_orderkey AS unit_id, CAST(o_custkey AS VARCHAR) AS postcode, o_orderpriority AS unit_name,
               {_tokens('o_orderpriority')} AS tokens, CAST(o_orderdate AS DATE) AS open_date, close_date,
               CAST(year(o_orderdate) AS INTEGER) AS period, o_orderstatus, o_totalprice
        FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, CAST(max(l_shipdate) AS DATE) AS close_date
                               FROM lineitem GROUP BY 1) AS c USING (o_orderkey)"""),
    "order_kept": ("order_dim", "SELECT * FROM order_dim WHERE o_totalprice > 20000"),
    "pairs": ("", """
        SELECT o_orderkey AS pred, o_orderkey + 1 AS succ FROM orders WHERE o_orderstatus <> 'P'
        UNION SELECT o_orderkey, o_orderkey - o_orderkey % 10 FROM orders
        WHERE o_totalprice > 450000 AND o_orderkey % 10 <> 0"""),
    "single_pairs": ("pairs", """
        SELECT pred, succ FROM pairs
        WHERE pred IN (SELECT pred FROM pairs GROUP BY pred HAVING count(*) = 1)
          AND succ IN (SELECT succ FROM pairs GROUP BY succ HAVING count(*) = 1)"""),
    "link_groups": ("single_pairs", _components("single_pairs", "pred", "succ")),
    "first_groups": ("link_groups order_dim", """
        SELECT unit_id, period, coalesce(component, unit_id) AS component, node IS NOT NULL AS is_linked
        FROM order_dim LEFT JOIN link_groups ON node = unit_id"""),
    **_lineage("", "order_dim"),
    **_lineage("kept_", "order_kept"),
    "near_pairs": ("order_dim", f"""
        SELECT a.unit_id AS old_unit, b.unit_id AS new_unit FROM order_dim a JOIN order_dim b USING (postcode)
        WHERE a.unit_id <> b.unit_id AND abs(date_diff('day', a.close_date, b.open_date)) <= 60
          AND {_jaccard('a.tokens', 'b.tokens')} >= 0.5"""),
    "near_groups": ("near_pairs", _components("near_pairs", "old_unit", "new_unit")),
    "near_parts": ("", f"""
        SELECT unit_id, match_id, similarity, area_code, latitude
        FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY similarity DESC, match_id) AS place
              FROM (SELECT m.p_partkey AS unit_id, r.p_partkey AS match_id, r.p_type AS area_code,
                           r.p_retailprice AS latitude, {_jaccard('m.tokens', 'r.tokens')} AS similarity
                    FROM (SELECT *, {_tokens('p_name')} AS tokens FROM part WHERE p_size <= 5) AS m
                    JOIN (SELECT *, {_tokens('p_name')} AS tokens FROM part WHERE p_size > 5) AS r USING (p_brand))
                    AS c) AS ranked WHERE place = 1"""),
    "worded_parts": ("", f"""
        SELECT p_partkey AS unit_id, p_brand, p_type = 'PROMO' AS is_missing, {_tokens("name")} AS tokens
        FROM (SELECT *, CASE WHEN p_size < 3 THEN split_part(p_name, ' ', 1) ELSE p_name || ' ' || p_type || ' ' || p_brand
                  || CASE WHEN p_size > 9 THEN ' size ' || CAST(p_size AS VARCHAR) ELSE '' END
                  || CASE WHEN p_size > 20 THEN ' price ' || CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR)
                       || ' group ' || CAST(CAST(floor(floor(p_retailprice) / 100) AS BIGINT) AS VARCHAR) ELSE '' END
                  || CASE WHEN p_size > 35 THEN ' lot ' || CAST(p_partkey % 17 AS VARCHAR) || ' shelf '
                       || CAST(CAST(floor(p_retailprice) AS BIGINT) % 5 AS VARCHAR) ELSE '' END END AS name
              FROM part) AS n"""),
    "long_names": ("worded_parts", f"""
        SELECT unit_id, arg_max(match_id, (similarity, -match_id)) AS match_id, max(similarity) AS similarity
        FROM (SELECT m.unit_id, r.unit_id AS match_id, {_jaccard('m.tokens', 'r.tokens')} AS similarity
              FROM worded_parts m JOIN worded_parts r USING (p_brand) WHERE m.is_missing AND NOT r.is_missing) AS c
        GROUP BY unit_id HAVING max(similarity) >= 0.1"""),
    "worded_orders": ("order_dim", f"""
        SELECT unit_id, postcode, open_date, close_date, {_tokens("name")} AS tokens
        FROM (SELECT *, unit_name || ' grade ' || o_orderstatus
                  || CASE WHEN o_totalprice > 150000 THEN ' month ' || strftime(open_date, '%m') ELSE '' END
                  || CASE WHEN o_totalprice > 300000 THEN ' size ' || CAST(CAST(floor(o_totalprice / 50000) AS BIGINT)
                                                                        AS VARCHAR) ELSE '' END AS name
              FROM order_dim) AS o"""),
    "worded_pairs": ("worded_orders", f"""
        SELECT a.unit_id AS old_unit, b.unit_id AS new_unit FROM worded_orders a JOIN worded_orders b USING (postcode)
        WHERE a.unit_id <> b.unit_id AND abs(date_diff('day', a.close_date, b.open_date)) <= 60
          AND {_jaccard('a.tokens', 'b.tokens')} >= 0.5"""),
    "near_orders": ("order_dim order_kept", f"""
        SELECT unit_id, match_id FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY similarity DESC, match_id)
                                                     AS place
              FROM (SELECT m.unit_id, r.unit_id AS match_id, {_jaccard('m.tokens', 'r.tokens')} AS similarity
                    FROM order_dim m JOIN order_kept r USING (postcode) WHERE m.o_totalprice <= 20000) AS c) AS ranked
        WHERE place = 1"""),
    "unit_table": ("kept_lineages near_orders order_dim", """
        SELECT o.unit_id, l.lineage_id, l.lineage_method, o.unit_name, o.postcode,
               CASE WHEN k.unit_id IS NOT NULL THEN left(k.unit_name, 1) END AS area_code, k.unit_name AS area_name,
               k.o_orderstatus AS region,
               CASE WHEN o.o_totalprice > 20000 THEN 'LA maintained' ELSE 'Other' END AS unit_type,
               coalesce(CASE WHEN k.o_orderstatus <> 'P' THEN 'Z' || k.postcode END,
                        CASE WHEN c_acctbal > 0 THEN 'D' || CAST(c_nationkey AS VARCHAR) END) AS zone_code,
               CASE WHEN o.o_totalprice > 20000 THEN strftime(o.open_date, '%Y-%m-%d') END AS open_date,
               CASE WHEN o.o_totalprice > 20000 THEN strftime(o.close_date, '%Y-%m-%d') END AS close_date,
               CASE WHEN o.o_totalprice > 20000 THEN 'gias_urn' WHEN k.unit_id IS NOT NULL THEN 'gias_postcode' END
                   AS location_source
        FROM order_dim o LEFT JOIN near_orders n ON n.unit_id = o.unit_id
        LEFT JOIN order_dim k ON k.unit_id = CASE WHEN o.o_totalprice > 20000 THEN o.unit_id ELSE n.match_id END
        LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = o.postcode
        LEFT JOIN kept_lineages l ON l.unit_id = o.unit_id"""),
    "wide_printed": ("results", f"""
        SELECT CAST(is_special + 1 AS VARCHAR) AS RECTYPE, '300' AS LEA, CAST(unit_id AS VARCHAR) AS URN,
               'Unit ' || CAST(unit_id AS VARCHAR) AS SCHNAME, 'u' || lpad(CAST(unit_id AS VARCHAR), 5, '0') AS PCODE,
               CAST(n_total AS VARCHAR) AS TPUP,
               CASE WHEN score_focus IS NULL THEN 'NA' ELSE CAST(n_focus AS VARCHAR) END AS TFSM6CLA1A,
               CASE WHEN period >= 1999 THEN CAST(n_rest AS VARCHAR) ELSE '' END AS TNOTFSM6CLA1A,
               {_printed('pct_focus')} || '%' AS PTFSM6CLA1A, {_printed('score_all')} AS ATT8SCR,
               coalesce({_printed('score_focus')}, 'SUPP') AS ATT8SCR_FSM6CLA1A,
               {_printed('score_rest')} AS ATT8SCR_NFSM6CLA1A, {_printed('progress_all')} AS P8MEA,
               {_printed('progress_focus')} AS P8MEA_FSM6CLA1A, {_printed('progress_rest')} AS P8MEA_NFSM6CLA1A,
               {_printed('basics_all')} AS PTL2BASICS_94, {_printed('basics_focus')} AS PTFSM6CLA1ABASICS_94,
               {_printed('basics_rest')} AS PTNOTFSM6CLA1ABASICS_94, n_total AS size FROM results"""),
}

QUERIES = {
    "wide_results": ("results", f"""(SELECT *, CASE WHEN period >= 1999 THEN n_rest_in ELSE n_total - n_focus END AS n_rest
        FROM (SELECT period_label, period, unit_id, 'Unit ' || CAST(unit_id AS VARCHAR) AS result_name,
                     'U' || left(lpad(CAST(unit_id AS VARCHAR), 5, '0'), 2) || ' '
                         || right(lpad(CAST(unit_id AS VARCHAR), 5, '0'), 3) AS result_postcode,
                     is_special, n_total, n_rest AS n_rest_in, round(pct_focus, 1) AS pct_focus,
                     CASE WHEN score_focus IS NULL THEN round_even(n_total * round(pct_focus, 1) / 100.0, 0)
                          ELSE n_focus END AS n_focus, {ROUNDED} FROM results) AS r) AS q"""),
    "long_to_wide": ("results", f"(SELECT {_LONG_COLUMNS}, {ROUNDED} FROM results) AS q"),
    "source_precedence": ("results", f"""(SELECT {_LONG_COLUMNS}, {', '.join(MEASURES)}, 'long' AS source
        FROM results WHERE period >= 1999 UNION ALL SELECT {_LONG_COLUMNS}, {ROUNDED}, 'wide' AS source
        FROM results WHERE period < 1999) AS q"""),
    "slim_wide": ("wide_printed results", """(SELECT * EXCLUDE (size) FROM wide_printed
        UNION ALL SELECT * EXCLUDE (size) REPLACE ('1' AS TPUP) FROM wide_printed WHERE size < 75
        UNION ALL SELECT '5', '', '', '', '', CAST(sum(n_total) AS VARCHAR), '', '', '', '', '', '', '', '', '', '', '', ''
        FROM results GROUP BY period) AS q"""),
    "slim_long": ("results", f"""(SELECT CAST(period AS VARCHAR) || right(CAST(period + 1 AS VARCHAR), 2) AS time_period,
        CAST(unit_id AS VARCHAR) AS school_urn, 'Unit ' || CAST(unit_id AS VARCHAR) AS school_name,
        CASE WHEN is_special = 1 THEN 'Special schools' ELSE 'Academies' END AS establishment_type_group, g.*
        FROM results, LATERAL (VALUES
            ('Total', 'Total', CAST(n_total AS VARCHAR), {_printed('score_all')}, {_printed('progress_all')},
             {_printed('basics_all')}),
            ('Disadvantage status', 'Disadvantaged', CAST(n_focus AS VARCHAR),
             coalesce({_printed('score_focus')}, 'c'), {_printed('progress_focus')}, {_printed('basics_focus')}),
            ('Disadvantage status', 'Not known to be disadvantaged',
             CASE WHEN period >= 1999 THEN CAST(n_rest AS VARCHAR) ELSE 'z' END, {_printed('score_rest')},
             {_printed('progress_rest')}, {_printed('basics_rest')}))
            AS g(breakdown_topic, disadvantage_status, pupil_count, attainment8_average, progress8_average,
                 engmath_94_percent)) AS q"""),
    "clean_numeric": ("", """(SELECT c_custkey, CASE WHEN c_custkey % 7 IN (0, 4, 5) THEN NULL
            WHEN c_custkey % 7 = 6 THEN c_acctbal ELSE floor(abs(c_acctbal)) END AS amount,
        CASE c_mktsegment WHEN 'FURNITURE' THEN c_nationkey * 1000.0
            WHEN 'HOUSEHOLD' THEN CAST('-.' || CAST(c_nationkey AS VARCHAR) AS DOUBLE) END AS share
        FROM customer) AS q"""),
    "clean_code": ("", """(SELECT c_custkey, CASE WHEN c_acctbal >= 0 AND c_acctbal <= 9000 THEN
            left(c_mktsegment, 2) || CAST(c_nationkey AS VARCHAR) || ' ' || CAST(c_custkey % 10 AS VARCHAR) || 'XY' END
        AS code FROM customer) AS q"""),
    "period_label": ("", """(SELECT o_orderkey, year(o_orderdate) AS period, CAST(year(o_orderdate) AS VARCHAR) || '-'
        || right(CAST(year(o_orderdate) + 1 AS VARCHAR), 2) AS period_label FROM orders) AS q"""),
    "sentinel_null": ("", """(SELECT c_custkey,
        CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'HOUSEHOLD') THEN c_name END AS region,
        CASE WHEN c_nationkey <> 7 THEN 'not applicable' END AS area_name,
        CASE WHEN c_acctbal > 0 AND c_nationkey > 2 THEN c_acctbal END AS easting,
        CASE WHEN c_acctbal > 0 AND c_nationkey > 2 THEN c_nationkey - 2 END AS northing FROM customer) AS q"""),
    "parse_dates": ("", """(SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN
        strftime(o_orderdate, '%Y-%m-%d') END AS open_date FROM orders) AS q"""),
    "categorise": ("", """(SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' OR p_brand = 'Brand#4' THEN 'Special'
            WHEN p_brand = 'Brand#3' THEN 'Independent' WHEN p_type = 'LARGE' THEN 'Academy (converter)'
            WHEN p_type = 'STANDARD' THEN 'Academy (sponsor led)'
            WHEN p_brand = 'Brand#5' OR p_type = 'PROMO' THEN 'Free school / UTC / studio'
            WHEN p_brand LIKE 'Brand#2%' THEN 'LA maintained' ELSE 'Other' END AS unit_type FROM part) AS q"""),
    "rank_to_score": ("", """(SELECT c_name AS zone_code, c_custkey + 1.0 AS zone_rank,
        100.0 * (n - c_custkey - 1) / (n - 1) AS zone_score, ceil(10.0 * (c_custkey + 1) / n) AS zone_decile
        FROM customer, (SELECT CAST(max(c_custkey) + 1 AS DOUBLE) AS n FROM customer) AS s) AS q"""),
    "derive_counts": ("results", """(SELECT unit_id, period, n_total, focus AS n_focus,
        CASE WHEN period = 2000 THEN n_rest ELSE n_total - focus END AS n_rest,
        CASE WHEN period = 1999 THEN 100.0 * focus / CAST(n_total AS DOUBLE) ELSE round(pct_focus, 1) END AS pct_focus
        FROM (SELECT *, CASE WHEN period >= 1998 THEN n_focus
                             ELSE round_even(n_total * round(pct_focus, 1) / 100.0, 0) END AS focus FROM results) AS r)
        AS q"""),
    "locate_points": ("", f"({_locate()}) AS q"),
    "coalesce_attrs": ("", """(SELECT p_partkey AS unit_id, p_name AS unit_name, p_brand AS postcode,
        CASE WHEN p_size > 5 AND p_type <> 'PROMO' THEN p_type ELSE 'Other' END AS unit_type FROM part) AS q"""),
    "join_with_source": ("", """(SELECT p_partkey AS unit_id, CASE WHEN p_size > 8 THEN p_name END AS unit_name,
        CASE WHEN p_size > 5 THEN 'gias_urn' END AS location_source FROM part) AS q"""),
    "units_missing": ("", """(SELECT p_partkey AS unit_id, p_name AS result_name, p_brand AS result_postcode FROM part
        WHERE p_size <= 5) AS q"""),
    "best_name_match": ("near_parts", "near_parts"),
    "interval_similarity_join": ("near_groups", "near_groups"),
    "long_name_match": ("long_names", "long_names"),
    "similar_partners": ("worded_pairs", """(SELECT unit, sum(n_after) AS n_after, sum(n_before) AS n_before
        FROM (SELECT old_unit AS unit, 1 AS n_after, 0 AS n_before FROM worded_pairs
              UNION ALL SELECT new_unit, 0, 1 FROM worded_pairs) AS p GROUP BY unit) AS q"""),
    "tidy_register": ("", """(SELECT c_custkey AS unit_id, c_name AS unit_name,
        'AB' || CAST(c_nationkey AS VARCHAR) || ' ' || CAST(c_custkey % 10 AS VARCHAR) || 'CD' AS postcode,
        CAST(c_nationkey AS VARCHAR) AS area_code, nullif(c_mktsegment, 'BUILDING') AS region,
        CASE c_mktsegment WHEN 'FURNITURE' THEN 'Independent' WHEN 'MACHINERY' THEN 'Academy (sponsor led)'
            ELSE 'Other' END AS unit_type,
        CASE WHEN c_acctbal > 0 THEN make_date(2000 + c_nationkey, 3, CAST(c_custkey % 28 + 1 AS INTEGER)) END AS open_date
        FROM customer) AS q"""),
    "tidy_links": ("", """(SELECT o_orderkey AS unit_id, o_custkey AS link_id, o_orderpriority AS link_type FROM orders
        WHERE o_totalprice > 50000) AS q"""),
    "tidy_zones": ("", """(SELECT 'E' || CAST(c_custkey AS VARCHAR) AS zone_code, c_mktsegment AS district_name,
        CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE NULL END AS zone_score, c_custkey + 1 AS zone_rank,
        c_custkey % 10 + 1 AS zone_decile, c_nationkey * 1000 AS population FROM customer) AS q"""),
    "tidy_directory": ("", """(SELECT chr(CAST(65 + c_custkey % 26 AS INTEGER))
        || chr(CAST(65 + c_custkey // 26 % 26 AS INTEGER)) || CAST(c_custkey // 676 % 100 AS VARCHAR) || ' '
        || CAST(c_custkey // 67600 AS VARCHAR) || 'AA' AS postcode,
        'E' || CAST(c_nationkey AS VARCHAR) AS zone_code FROM customer WHERE c_acctbal > 0) AS q"""),
    "unit_sources": ("unit_table", """(SELECT lineage_method, location_source, count(*) AS n FROM unit_table GROUP BY ALL)
        AS q"""),
    "lookup_fill": ("", """(SELECT p_partkey AS unit_id, p_brand AS postcode, CASE WHEN p_size > 10 THEN p_type ELSE
        min(p_type) OVER (PARTITION BY p_brand) END AS zone_code FROM part) AS q"""),
    "coverage_rates": ("", """(SELECT count(*) AS n_rows, avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END) AS rate,
        CASE WHEN avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END) < 0.9 THEN 1 ELSE 0 END AS is_low
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey) AS q"""),
    "units": ("unit_table", "unit_table"),
    "dedupe_largest": ("", """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
        ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) AS o WHERE place = 1) AS q"""),
    "latest_per_unit": ("results", """(SELECT unit_id, period, n_total FROM results r
        WHERE period = (SELECT max(period) FROM results s WHERE s.unit_id = r.unit_id)) AS q"""),
    "dedupe_first": ("", """(SELECT * FROM orders WHERE o_orderkey IN
        (SELECT min(o_orderkey) FROM orders GROUP BY o_custkey)) AS q"""),
    "first_non_null": ("", """(SELECT o_custkey, arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus <> 'P')
        AS price, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderpriority <> '5-LOW') AS priority
        FROM orders GROUP BY o_custkey) AS q"""),
    "one_to_one_links": ("single_pairs", "single_pairs"),
    "components": ("link_groups", "link_groups"),
    "lineage": ("lineages", "lineages"),
    "lineage_clashes": ("first_groups", """(SELECT component, period, count(*) AS n_units FROM first_groups
        GROUP BY component, period HAVING count(*) > 1) AS q"""),
    "lineage_units": ("lineages order_dim", """(SELECT l.*, count(*) OVER (PARTITION BY lineage_id) AS n_periods
        FROM lineages l) AS q"""),
    "extract_units": ("rounded_units", "rounded_units"),
    "extract_areas": ("rounded_areas", "rounded_areas"),
}
