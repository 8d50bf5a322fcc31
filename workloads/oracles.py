"""For each query the same result as SQL over the given tables."""

from __future__ import annotations

from collections.abc import Sequence

PLAIN_ORDERS = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority
FROM orders"""

CHANGED_ORDERS = """
SELECT CASE WHEN o_orderkey % 10 = 4 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey,
       o_custkey,
       CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 0.01::DOUBLE
            WHEN o_orderkey % 11 = 0 THEN o_totalprice + 0.00001::DOUBLE
            ELSE o_totalprice END AS o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority
FROM orders"""

OLD_ORDERS, NEW_ORDERS = (
    f"SELECT * REPLACE (o_custkey::DOUBLE AS o_custkey) FROM ({rows})"
    for rows in (PLAIN_ORDERS, CHANGED_ORDERS)
)

OLD_LINES = """
SELECT l_orderkey, l_linenumber, l_partkey::DOUBLE AS l_partkey, l_quantity, l_extendedprice,
       l_returnflag
FROM lineitem"""

NEW_LINES = """
SELECT l_orderkey,
       CASE WHEN l_partkey % 11 = 0 THEN l_linenumber + 1 ELSE l_linenumber END AS l_linenumber,
       l_partkey::DOUBLE AS l_partkey, l_quantity,
       CASE WHEN l_partkey % 5 = 0 THEN l_extendedprice + 1.5::DOUBLE
            WHEN l_partkey % 7 = 0 THEN l_extendedprice + 0.00001::DOUBLE
            ELSE l_extendedprice END AS l_extendedprice,
       l_returnflag
FROM lineitem"""

OLD_EVENTS = """
SELECT CASE WHEN event_id % 100 = 0 THEN event_id + 1 ELSE event_id END AS event_id,
       user_id, event_type, value
FROM events"""

NEW_EVENTS = f"""
SELECT event_id, user_id, event_type,
       CASE WHEN user_id % 3 = 0 THEN value + 0.00001::DOUBLE
            WHEN user_id % 7 = 0 THEN value + 2 ELSE value END AS value
FROM ({OLD_EVENTS})"""

ORDER_VALUES = ("o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice")
ORDER_NUMBERS = ("o_custkey", "o_totalprice")
LINE_KEYS = ("l_orderkey", "l_linenumber")
LINE_VALUES = ("l_extendedprice", "l_partkey", "l_quantity", "l_returnflag")
LINE_NUMBERS = ("l_extendedprice", "l_partkey", "l_quantity")


def _equal(value: str, number: bool) -> str:
    same = f"l.{value} IS NOT DISTINCT FROM r.{value}"
    return f"coalesce({same} OR abs(l.{value} - r.{value}) < 0.0001, false)" if number else same


def compared(
    old: str, new: str, keys: Sequence[str], values: Sequence[str], numbers: Sequence[str],
    also_on: str = "", null_key: str | None = None,
) -> str:
    """``old`` and ``new`` fully joined, with both values and a flag per value column."""
    on = " AND ".join(f"l.{k} IS NOT DISTINCT FROM r.{k}" for k in keys) + also_on
    stand_in = "" if null_key is None else f", '{null_key}'"
    columns = [f"coalesce(l.{k}::VARCHAR, r.{k}::VARCHAR{stand_in}) AS {k.upper()}" for k in keys]
    for v in values:
        name = v.upper()
        columns += [
            f"l.{v} AS {name}_OLD", f"r.{v} AS {name}_NEW",
            f"{_equal(v, v in numbers)} AS {name}_COMPARE",
        ]
    side = (
        "CASE WHEN r.here IS NULL THEN 'left_only' WHEN l.here IS NULL THEN 'right_only' "
        "ELSE 'both' END AS _SIDE"
    )
    return (
        f"SELECT {', '.join(columns)}, {side} FROM (SELECT *, true AS here FROM ({old})) l "
        f"FULL OUTER JOIN (SELECT *, true AS here FROM ({new})) r ON {on}"
    )


def differing(values: Sequence[str]) -> str:
    flags = [f"NOT {v.upper()}_COMPARE" for v in values]
    return " OR ".join(["_SIDE <> 'both'", *flags])


def mismatches(joined: str, values: Sequence[str]) -> str:
    return f"SELECT * FROM ({joined}) WHERE {differing(values)}"


ORDERS = compared(OLD_ORDERS, NEW_ORDERS, ["o_orderkey"], ORDER_VALUES, ORDER_NUMBERS)


def _numeric_only(rows: str) -> str:
    texts = ("o_orderdate", "o_orderpriority", "o_orderstatus")
    nulls = ", ".join(f"NULL::DOUBLE AS {t}" for t in texts)
    return f"SELECT o_orderkey, o_custkey::DOUBLE AS o_custkey, o_totalprice, {nulls} FROM ({rows})"


def _as_text(rows: str) -> str:
    return (
        "SELECT o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderdate, o_orderpriority, "
        f"o_orderstatus, o_totalprice FROM ({rows})"
    )


def _null_keys(rows: str) -> str:
    return (
        "SELECT * REPLACE (CASE WHEN o_orderkey % 3 <> 1 THEN o_orderkey END AS o_orderkey), "
        f"o_orderkey AS ref FROM ({rows})"
    )


NULL_KEYS = ("o_orderkey", "ref")
OLD_NULL, NEW_NULL = _null_keys(OLD_ORDERS), _null_keys(NEW_ORDERS)


def _surplus(rows: str, other: str, keys: Sequence[str], values: Sequence[str]) -> str:
    """Copies with no equal copy on the other side."""
    twin = f"row_number() OVER (PARTITION BY {', '.join((*keys, *values))}) AS twin"
    same = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in (*keys, *values, "twin"))
    return (
        f"SELECT a.* EXCLUDE (twin) FROM (SELECT *, {twin} FROM ({rows})) a "
        f"ANTI JOIN (SELECT *, {twin} FROM ({other})) b ON {same}"
    )


def paired(
    old: str, new: str, keys: Sequence[str], values: Sequence[str], numbers: Sequence[str]
) -> str:
    """Copies without an equal copy, each beside one of the other side.

    A copy meets one whose exact values are the same and whose numbers lie in the same cell of
    0.0001; then in the cells moved by half; what is left meets in value order.
    """
    exact = [v for v in values if v not in numbers]
    order = ", ".join(f"{v} NULLS FIRST" for v in [*exact, *[v for v in values if v in numbers]])
    by_key = ", ".join(keys)
    same = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in (*keys, "nth"))

    def place(shift: float) -> str:
        cells = [f"floor({v} / 0.0001::DOUBLE + {shift}::DOUBLE)" if v in numbers else v for v in values]
        label = " || '|' || ".join(f"coalesce(({c})::VARCHAR, '-')" for c in cells)
        among = f"PARTITION BY {by_key}, {', '.join(cells)} ORDER BY {order}"
        return f"'{shift}|' || {label} || '|' || row_number() OVER ({among}) AS nth"

    steps = [f"a0 AS ({_surplus(old, new, keys, values)}), b0 AS ({_surplus(new, old, keys, values)})"]
    for i, shift in enumerate((0.0, 0.5)):
        for mine in "ab":
            steps.append(f"{mine}_at{i} AS (SELECT *, {place(shift)} FROM {mine}{i})")
        for mine, other in ("ab", "ba"):
            match = same if mine == "a" else same.replace("a.", "x.").replace("b.", "a.").replace("x.", "b.")
            joined = f"FROM {mine}_at{i} {mine} {{}} JOIN {other}_at{i} {other} ON {match}"
            steps.append(f"{mine}_met{i} AS (SELECT {mine}.* {joined.format('SEMI')})")
            steps.append(f"{mine}{i + 1} AS (SELECT {mine}.* EXCLUDE (nth) {joined.format('ANTI')})")

    def side(mine: str) -> str:
        left = f"SELECT *, 'left|' || row_number() OVER (PARTITION BY {by_key} ORDER BY {order}) AS nth FROM {mine}2"
        return (
            f"WITH {', '.join(steps)} SELECT * FROM {mine}_met0 UNION ALL BY NAME "
            f"SELECT * FROM {mine}_met1 UNION ALL BY NAME {left}"
        )

    return compared(side("a"), side("b"), keys, values, numbers, also_on=" AND l.nth = r.nth")


def _equal_lines() -> str:
    """Copies that do have an equal copy on the other side, as report rows."""
    both = f"SELECT * FROM ({OLD_LINES}) INTERSECT ALL SELECT * FROM ({NEW_LINES})"
    columns = [f"{k}::VARCHAR AS {k.upper()}" for k in LINE_KEYS]
    for v in LINE_VALUES:
        name = v.upper()
        columns += [f"{v} AS {name}_OLD", f"{v} AS {name}_NEW", f"true AS {name}_COMPARE"]
    return f"SELECT {', '.join(columns)}, 'both' AS _SIDE FROM ({both})"


PAIRED_LINES = paired(OLD_LINES, NEW_LINES, LINE_KEYS, LINE_VALUES, LINE_NUMBERS)
FANNED_LINES = compared(OLD_LINES, NEW_LINES, LINE_KEYS, LINE_VALUES, LINE_NUMBERS)

# Long ids, codes and padded numbers are compared as text, prices as decimals.
TEXT_CODES = """
WITH o AS (
  SELECT o_orderkey AS k, 9007199254740992::BIGINT + o_orderkey AS id, o_custkey::VARCHAR AS c,
         o_totalprice::DECIMAL(18,5) AS price FROM orders),
v AS (
  SELECT k::VARCHAR AS "K",
         c || 'd' AS "CODE_OLD", c || CASE WHEN k % 5 = 0 THEN 'f' ELSE 'd' END AS "CODE_NEW",
         id::VARCHAR AS "ID_OLD", (id + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END)::VARCHAR AS "ID_NEW",
         '00' || c AS "PADDED_OLD", CASE WHEN k % 3 = 0 THEN c ELSE '00' || c END AS "PADDED_NEW",
         price::VARCHAR AS "PRICE_OLD",
         (price + CASE WHEN k % 7 = 0 THEN 0.00001 WHEN k % 11 = 0 THEN 0.01 ELSE 0 END::DECIMAL(18,5))
           ::DECIMAL(18,5)::VARCHAR AS "PRICE_NEW"
  FROM o)
SELECT *, "CODE_OLD" = "CODE_NEW" AS "CODE_COMPARE", "ID_OLD" = "ID_NEW" AS "ID_COMPARE",
       "PADDED_OLD" = "PADDED_NEW" AS "PADDED_COMPARE",
       abs("PRICE_OLD"::DECIMAL(18,5) - "PRICE_NEW"::DECIMAL(18,5)) < 0.0001 AS "PRICE_COMPARE",
       'both' AS _SIDE
FROM v WHERE NOT ("CODE_COMPARE" AND "ID_COMPARE" AND "PADDED_COMPARE" AND "PRICE_COMPARE")"""

# A copy with a near twin is no mismatch: copies of a key agree by line and price in thousands.
NEAR_COPIES = """
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS line, floor(l_extendedprice / 1000) * 1000 AS p,
                  l_partkey % 11 = 0 AS moved FROM lineitem),
old AS (SELECT k, line, p, count(*) AS n FROM l GROUP BY ALL),
new AS (SELECT k, line, p + CASE WHEN moved THEN 500 ELSE 0 END AS p, count(*) AS n FROM l GROUP BY ALL),
alone AS (
  SELECT k, greatest(coalesce(old.n, 0) - coalesce(new.n, 0), 0) AS a,
         greatest(coalesce(new.n, 0) - coalesce(old.n, 0), 0) AS b
  FROM old FULL OUTER JOIN (SELECT k, line, p, sum(n) AS n FROM new GROUP BY ALL) new USING (k, line, p))
SELECT k::VARCHAR AS "L_ORDERKEY", greatest(sum(a), sum(b))::BIGINT AS reported
FROM alone GROUP BY k HAVING greatest(sum(a), sum(b)) > 0"""

IN_SAMPLE = "('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 10000 < 1000"
IN_RANGE = "o_orderdate BETWEEN '1996-01-01' AND '1997-12-31'"


def _where(rows: str, condition: str) -> str:
    return f"SELECT * FROM ({rows}) WHERE {condition}"


RANGED = compared(
    _where(OLD_ORDERS, IN_RANGE), _where(NEW_ORDERS, IN_RANGE), ["o_orderkey", "o_orderdate"],
    ("o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice"), ORDER_NUMBERS,
)
SAMPLED = compared(
    _where(OLD_ORDERS, IN_SAMPLE), _where(NEW_ORDERS, IN_SAMPLE), ["o_orderkey"],
    ORDER_VALUES, ORDER_NUMBERS,
)

EVENT_TEXT = """
SELECT event_id,
       CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y%m%d')
                         WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
                         WHEN 2 THEN strftime(ts, '%Y-%m-%d')
                         ELSE strftime(ts, '%d/%m/%Y') END AS day
FROM events"""
EVENT_DAY = "try_strptime(substr(replace(day, '-', ''), 1, 8), '%Y%m%d')::DATE"


def _token(name: str, width: int = 10, salt: str = "") -> str:
    salted = f"'{salt}' || {name}" if salt else name
    return f"substr(sha256({salted}), 1, {width})"


QUOTED = "'\"[^\"]*\"'"
FOUND = f"regexp_extract_all(html, {QUOTED})"
NAMES = (
    f"SELECT DISTINCT substr(match, 2, length(match) - 2) AS term "
    f"FROM (SELECT unnest({FOUND}) AS match FROM pages)"
)
TOKENIZED = f"""
SELECT page_id, array_to_string(list_transform(
    list_zip(
        string_split_regex(html, {QUOTED}),
        list_transform({FOUND},
            lambda m: '"' || {_token("substr(m, 2, length(m) - 2)")} || '"')),
    lambda piece: piece[1] || coalesce(piece[2], '')), '') AS html
FROM pages"""


def _replaced(column: str, term: str, **style) -> str:
    return f"regexp_replace({column}, '\\b{term}\\b', {_token(repr(term), **style)}, 'g')"


NULLS = " UNION ALL ".join(
    f"SELECT '{k.upper()}' AS \"column\", '{side}' AS side, "
    f"count(*) FILTER (WHERE {k} IS NULL) AS null_count FROM ({rows})"
    for side, rows in (("_OLD", OLD_NULL), ("_NEW", NEW_NULL))
    for k in NULL_KEYS
)
MISMATCH_COUNTS = " UNION ALL ".join(
    f"SELECT '{v.upper()}_COMPARE' AS \"column\", "
    f"count(*) FILTER (WHERE NOT {v.upper()}_COMPARE) AS mismatches FROM ({ORDERS})"
    for v in ORDER_VALUES
)
LINE_COPIES = f"""
SELECT coalesce(l.l_orderkey, r.l_orderkey)::VARCHAR AS L_ORDERKEY,
       coalesce(l.l_linenumber, r.l_linenumber)::VARCHAR AS L_LINENUMBER,
       coalesce(l.n, 0) AS rows_left, coalesce(r.n, 0) AS rows_right
FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM ({OLD_LINES}) GROUP BY ALL) l
FULL OUTER JOIN (SELECT l_orderkey, l_linenumber, count(*) AS n FROM ({NEW_LINES}) GROUP BY ALL) r
  ON l.l_orderkey = r.l_orderkey AND l.l_linenumber = r.l_linenumber"""

# What contract_violations puts in: column, rule, and the rows it happens to.
BROKEN = (
    ("o_orderstatus", "not_null", "o_orderkey % 17 = 0"),
    ("o_totalprice", "type", "o_orderkey % 19 = 0"),
    ("o_orderdate", "type", "o_orderkey % 23 = 0"),
    ("o_orderpriority", "not_null", "o_orderkey % 29 = 0"),
)
VIOLATIONS = " UNION ALL ".join(
    f"SELECT 'orders' AS \"table\", '{column}' AS \"column\", '{rule}' AS rule, "
    f"count(*) AS cells FROM orders WHERE {rows}"
    for column, rule, rows in BROKEN
)

ORACLES: dict[str, str] = {
    "reconcile_rows": mismatches(ORDERS, ORDER_VALUES),
    "reconcile_keep_equal": ORDERS,
    "reconcile_digest_first": mismatches(ORDERS, ORDER_VALUES),
    "reconcile_unique_keys": mismatches(ORDERS, ORDER_VALUES),
    "reconcile_text_keys": mismatches(
        compared(
            _as_text(PLAIN_ORDERS), _as_text(CHANGED_ORDERS),
            ["o_orderkey", "o_orderdate", "o_orderpriority"],
            ("o_custkey", "o_orderstatus", "o_totalprice"), ["o_totalprice"],
        ),
        ("o_custkey", "o_orderstatus", "o_totalprice"),
    ),
    "reconcile_numeric_only": mismatches(
        compared(
            _numeric_only(OLD_ORDERS), _numeric_only(NEW_ORDERS), ["o_orderkey"],
            ORDER_VALUES, ORDER_VALUES,
        ),
        ORDER_VALUES,
    ),
    "reconcile_text_numbers": mismatches(
        compared(
            _as_text(PLAIN_ORDERS), _as_text(CHANGED_ORDERS), ["o_orderkey"], ORDER_VALUES,
            ["o_totalprice"],
        ),
        ORDER_VALUES,
    ),
    "reconcile_null_keys": mismatches(
        compared(OLD_NULL, NEW_NULL, NULL_KEYS, ORDER_VALUES, ORDER_NUMBERS), ORDER_VALUES
    ),
    "reconcile_null_key_text": mismatches(
        compared(
            OLD_NULL, NEW_NULL, NULL_KEYS, ["o_totalprice"], ["o_totalprice"], null_key="(none)"
        ),
        ["o_totalprice"],
    ),
    "reconcile_duplicate_keys": mismatches(PAIRED_LINES, LINE_VALUES),
    "reconcile_duplicate_keep_equal": f"{PAIRED_LINES} UNION ALL {_equal_lines()}",
    "reconcile_duplicate_fanout": mismatches(FANNED_LINES, LINE_VALUES),
    "reconcile_few_duplicates": mismatches(
        paired(
            OLD_EVENTS, NEW_EVENTS, ["event_id"], ("event_type", "user_id", "value"),
            ("user_id", "value"),
        ),
        ("event_type", "user_id", "value"),
    ),
    "reconcile_hot_key": mismatches(
        paired(
            f"SELECT * EXCLUDE (ref) FROM ({OLD_NULL})", f"SELECT * EXCLUDE (ref) FROM ({NEW_NULL})",
            ["o_orderkey"], ORDER_VALUES, ORDER_NUMBERS,
        ),
        ORDER_VALUES,
    ),
    "duplicate_key_report": (
        "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem "
        "GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"
    ),
    "duplicate_keys_both_sides": _where(LINE_COPIES, "rows_left > 1 OR rows_right > 1"),
    "mismatch_counts": MISMATCH_COUNTS,
    "key_null_counts": NULLS,
    "one_sided_rows": f"SELECT O_ORDERKEY, _SIDE FROM ({ORDERS}) WHERE _SIDE <> 'both'",
    "shape_and_summary": f"""
SELECT (SELECT count(*) FROM orders) AS rows_left, (SELECT count(*) FROM orders) AS rows_right,
       count(*) FILTER (WHERE _SIDE = 'left_only') AS left_only,
       count(*) FILTER (WHERE _SIDE = 'right_only') AS right_only,
       count(*) FILTER (WHERE {differing(ORDER_VALUES)}) AS mismatched_rows,
       1::BIGINT AS schema_differences, 'different' AS verdict
FROM ({ORDERS})""",
    "reconcile_date_range": mismatches(
        RANGED, ("o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    ),
    "date_range_rows": (
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders "
        "WHERE o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'"
    ),
    "date_standardize": (
        f"SELECT event_id, strftime({EVENT_DAY}, '%Y-%m-%d') AS day FROM ({EVENT_TEXT})"
    ),
    "unparsed_dates": (
        f"SELECT 'day' AS \"column\", count(*) FILTER (WHERE {EVENT_DAY} IS NULL) AS unparsed "
        f"FROM ({EVENT_TEXT})"
    ),
    "date_max": "SELECT max(strftime(o_orderdate, '%Y-%m-%d')) AS latest FROM orders",
    "hash_sample": _where(PLAIN_ORDERS, IN_SAMPLE),
    "stratified_counts": (
        "SELECT o_orderstatus AS stratum, count(*) AS rows, "
        f"count(*) FILTER (WHERE {IN_SAMPLE}) AS sampled FROM orders GROUP BY o_orderstatus"
    ),
    "reconcile_sampled": mismatches(SAMPLED, ORDER_VALUES),
    "reconcile_from_files": mismatches(
        compared(
            _as_text(PLAIN_ORDERS), _as_text(CHANGED_ORDERS), ["o_orderkey"], ORDER_VALUES,
            ["o_totalprice"],
        ),
        ORDER_VALUES,
    ),
    "report_roundtrip": mismatches(ORDERS, ORDER_VALUES),
    "stamped_report": mismatches(ORDERS, ORDER_VALUES),
    "verdicts": """
SELECT pair, equal, n AS rows_left, n AS rows_right
FROM (VALUES ('same', true), ('changed', false)) v(pair, equal), (SELECT count(*) AS n FROM orders)
UNION ALL
SELECT 'half', false, count(*), count(*) FILTER (WHERE o_orderkey % 2 = 0) FROM orders""",
    "reconcile_text_codes": TEXT_CODES,
    "reconcile_near_copies": NEAR_COPIES,
    "reconcile_noisy_copies": NEAR_COPIES,
    "contract_ingest": PLAIN_ORDERS,
    "contract_tables": (
        "SELECT 'customer' AS source, c_custkey AS id, c_name AS name, c_acctbal AS balance "
        "FROM customer UNION ALL SELECT 'nation', n_nationkey, n_name, NULL FROM nation"
    ),
    "archive_ingest": PLAIN_ORDERS,
    "contract_violations": _where(VIOLATIONS, "cells > 0"),
    "partitioned_write": PLAIN_ORDERS,
    "tokenize_pages": TOKENIZED,
    "tokenize_terms": f"SELECT page_id, {_replaced('url', 'utm_source')} AS url FROM pages",
    "tokenize_all_terms": (
        "SELECT page_id, "
        + _replaced(_replaced("url", "utm_source", width=12, salt="s-"), "http", width=12, salt="s-")
        + " AS url FROM pages"
    ),
    "term_presence": " UNION ALL ".join(
        f"SELECT '{term}' AS term, count(*) FILTER (WHERE contains(url, '{term}')) AS texts "
        "FROM pages"
        for term in ("utm_source", "http", "nowhere_at_all")
    ),
    "token_dictionary": f"SELECT term, {_token('term')} AS token FROM ({NAMES})",
    "token_collisions": (
        f"SELECT {_token('term', width=3)} AS token, count(*) AS terms, "
        f"min(term) AS first_term, max(term) AS last_term FROM ({NAMES}) "
        "GROUP BY 1 HAVING count(*) > 1"
    ),
    "restore_pages": "SELECT page_id, html FROM pages",
    "restore_pages_by_join": "SELECT page_id, html FROM pages",
    "restore_urls": "SELECT page_id, url FROM pages",
    "round_trip": (
        "SELECT 'texts' AS what, count(*) AS n FROM pages UNION ALL "
        "SELECT 'failures', count(*) FILTER (WHERE html <> html) FROM pages"
    ),
    "text_files": f"SELECT {_replaced('url', 'utm_source')} AS url FROM pages",
    "whole_texts": "SELECT sum(length(url) + 1)::BIGINT AS characters FROM pages",
}
