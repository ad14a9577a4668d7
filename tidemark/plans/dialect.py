"""One SQL text for Spark and for the check's database: macros where the two differ.

A query is written once with ``$name(arguments)`` macros; ``spark_text`` and ``check_text``
expand them.  Macros nest.  Common table expressions of the domain are put before it.
"""

from __future__ import annotations

import re

# name: (Spark, DuckDB), with numbered arguments.
MACROS: dict[str, tuple[str, str]] = {
    "ms": ("unix_millis(CAST({0} AS TIMESTAMP))", "(epoch_us({0}) // 1000)"),
    "hour": ("(unix_millis(CAST({0} AS TIMESTAMP)) div 3600000) * 3600000", "(epoch_us({0}) // 3600000000) * 3600000"),
    "div": ("({0} div {1})", "({0} // {1})"),
    # Of doubles, by zero too: infinite, or NaN for zero by zero.
    "over": ("CASE WHEN {1} = 0 THEN {0} * power({1}, -1) ELSE {0} / {1} END", "{0} / {1}"),
    # The first and the last known value: nulls don't count.
    "min_by": ("min_by({0}, CASE WHEN {0} IS NOT NULL THEN struct({1}) END)", "arg_min({0}, ({1}))"),
    "max_by": ("max_by({0}, CASE WHEN {0} IS NOT NULL THEN struct({1}) END)", "arg_max({0}, ({1}))"),
    "pct": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "k": ("CAST(get_json_object({0}, '$.k') AS INT)", "CAST(json_extract_string({0}, '$.k') AS INTEGER)"),
    "day": ("CAST({0} AS DATE)", "CAST({0} AS DATE)"),
    "ym": ("date_format({0}, 'yyyy-MM')", "strftime({0}, '%Y-%m')"),
    "ymd": ("date_format({0}, 'yyyy-MM-dd')", "strftime({0}, '%Y-%m-%d')"),
    "hm": ("date_format({0}, 'HH:mm')", "strftime({0}, '%H:%M')"),
    "plus_days": ("date_add({0}, {1})", "CAST({0} + {1} * INTERVAL 1 DAY AS DATE)"),
    "days": ("datediff({0}, {1})", "date_diff('day', {1}, {0})"),
    "int": ("CAST({0} AS BIGINT)", "CAST({0} AS BIGINT)"),
    "try_double": ("try_cast({0} AS DOUBLE)", "TRY_CAST({0} AS DOUBLE)"),
    "r": ("(round(CAST({0} AS DOUBLE), 5) + CAST(0 AS DOUBLE))", "(round(CAST({0} AS DOUBLE), 5) + CAST(0 AS DOUBLE))"),
    # As r, but halves are found by doubles on both sides: Spark's own round goes by decimal digits.
    "r_half": ("(round(CAST({0} AS DOUBLE) * 100000) / 100000 + CAST(0 AS DOUBLE))", "(round(CAST({0} AS DOUBLE), 5) + CAST(0 AS DOUBLE))"),
    "list": ("sort_array(collect_list({0}))", "list_sort(list({0}))"),
    "r6": ("(round(CAST({0} AS DOUBLE), 6) + CAST(0 AS DOUBLE))", "(round(CAST({0} AS DOUBLE), 6) + CAST(0 AS DOUBLE))"),
    "r8": ("(round(CAST({0} AS DOUBLE), 8) + CAST(0 AS DOUBLE))", "(round(CAST({0} AS DOUBLE), 8) + CAST(0 AS DOUBLE))"),
    "join_list": ("array_join({0}, ',')", "array_to_string({0}, ',')"),
    "extract": ("regexp_extract({0}, {1}, {2})", "regexp_extract({0}, {1}, {2})"),
    "explode_range": ("explode(sequence({0}, {1}))", "unnest(range({0}, {1} + 1))"),
    "last": ("last_value({0}) IGNORE NULLS OVER {1}", "last_value({0} IGNORE NULLS) OVER {1}"),
    "skew": ("CASE WHEN count({0}) OVER {1} > 2 AND stddev_pop({0}) OVER {1} > 0 THEN skewness({0}) OVER {1} * sqrt(count({0}) OVER {1} * (count({0}) OVER {1} - 1)) / (count({0}) OVER {1} - 2) END", "CASE WHEN count({0}) OVER {1} > 2 AND stddev_pop({0}) OVER {1} > 0 THEN skewness({0}) OVER {1} END"),
    "kurt": ("CASE WHEN count({0}) OVER {1} > 3 AND stddev_pop({0}) OVER {1} > 0 THEN (count({0}) OVER {1} - 1) / ((count({0}) OVER {1} - 2) * (count({0}) OVER {1} - 3)) * ((count({0}) OVER {1} + 1) * kurtosis({0}) OVER {1} + 6) END", "CASE WHEN count({0}) OVER {1} > 3 AND stddev_pop({0}) OVER {1} > 0 THEN kurtosis({0}) OVER {1} END"),
    "full": ("CASE WHEN count({1}) OVER {2} = {3} THEN {0}({1}) OVER {2} END", "CASE WHEN count({1}) OVER {2} = {3} THEN {0}({1}) OVER {2} END"),
    "weekday": ("weekday({0})", "(isodow({0}) - 1)"),
    "filter_pct": ("percentile({0}, {1}) FILTER (WHERE {2})", "quantile_cont({0}, {1}) FILTER (WHERE {2})"),
    "stddev_pop": ("stddev_pop({0})", "stddev_pop({0})"),
}

#: Bars, daily bars and the like from the driver's tables, as common table expressions.
TABLES = {
    "bars": """SELECT event_type AS symbol, $hour(ts) AS ts_ms, $min_by(value; ts, event_id) AS open, max(value) AS high, min(value) AS low,
        $max_by(value; ts, event_id) AS close, sum(value) AS volume, count(*) AS trades, sum(CASE WHEN $k(props) >= 50 THEN value ELSE 0 END) AS taker
        FROM events GROUP BY 1, 2""",
    "user_bars": """SELECT user_id AS symbol, $hour(ts) AS ts_ms, $min_by(value; ts, event_id) AS open, max(value) AS high, min(value) AS low,
        $max_by(value; ts, event_id) AS close, sum(value) AS volume, count(*) AS trades FROM events GROUP BY 1, 2""",
    "daily": """SELECT p_brand AS symbol, $day(l_shipdate) AS day, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
        avg(l_extendedprice / l_quantity) AS close, sum(l_quantity) AS volume, count(*) AS trades
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "caps": "SELECT p_brand AS base, max(p_retailprice) * 1000 AS cap FROM part WHERE p_size > 5 GROUP BY 1",
    "tickers": """SELECT p_brand AS base, p_brand || '/USDT' AS symbol, sum(l_extendedprice) AS quote_volume, (max(l_tax) - min(l_discount)) * 100 AS percentage,
        sum(l_quantity) AS fut_volume, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice) AS taker
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "samples": """SELECT d.doc_id, d.lang, d.source, CAST(d.n_chars AS DOUBLE) AS score, CAST(length(d.text) - length(replace(d.text, 'e', '')) AS DOUBLE) / greatest(length(d.text), 1) AS x1,
        CAST(length(d.text) - length(replace(d.text, ' ', '')) AS DOUBLE) AS x2, l.quality AS label, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
}


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """Arguments from the bracket at ``at``, parted by ; if there is one outside brackets, else by commas."""
    depth, parts, start = 0, [], at + 1
    cuts: dict[str, list[int]] = {";": [], ",": []}
    quoted = False
    for i in range(at, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        if quoted:
            continue
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                edges = cuts[";"] or cuts[","]
                for e in [*edges, i]:
                    parts.append(text[start:e].strip())
                    start = e + 1
                return parts, i + 1
        elif depth == 1 and c in cuts:
            cuts[c].append(i)
    raise ValueError(f"unclosed bracket: {text[at:at + 60]}")


def expand(text: str, which: int) -> str:
    while m := re.search(r"\$(\w+)\(", text):
        # The last macro holds no other.
        m = list(re.finditer(r"\$(\w+)\(", text))[-1]
        arguments, end = _arguments(text, m.end() - 1)
        text = text[: m.start()] + MACROS[m[1]][which].format(*arguments) + text[end:]
    return text


def text(query: str, which: int) -> str:
    """The query with the domain's tables that it names as common table expressions."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", query)]
    head = ", ".join(f"{t} AS ({TABLES[t]})" for t in used)
    query = query.strip()
    if head:
        query = f"WITH {head}, {query[5:]}" if query.upper().startswith("WITH ") else f"WITH {head} {query}"
    return expand(query, which)


def spark_text(query: str) -> str:
    return text(query, 0)


def check_text(query: str) -> str:
    return text(query, 1)
