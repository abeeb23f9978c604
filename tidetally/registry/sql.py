"""SQL over the driver tables that must give what ``queries.py`` gives."""

SQL: dict[str, str] = {}

# --- the mappings of fixtures.py ---------------------------------------------

SURVEY = """survey AS (
  SELECT CASE WHEN l_partkey % 97 = 0 THEN '' ELSE strftime(l_shipdate, '%b %-d, %Y') END AS sample_date,
    'Ramp ' || (l_suppkey % 23) AS ramp_site,
    CASE WHEN l_partkey % 11 = 0 THEN ''
         WHEN l_partkey % 7 = 3 THEN 'NATION_' || (14 + l_partkey % 5)
         ELSE 'Area ' || (l_partkey % 13) || ', Zone ' || (l_partkey % 13) END AS catch_area,
    CAST(l_linenumber AS BIGINT) AS interviews,
    CASE WHEN l_orderkey % 19 <> 0 THEN CAST(l_quantity AS BIGINT) END AS anglers,
    CAST(CASE WHEN l_orderkey % 17 <> 0 THEN l_orderkey % 7 END AS DOUBLE) AS chinook,
    CAST(l_orderkey % 4 AS DOUBLE) / 4 AS chinook_per_angler,
    CAST(l_suppkey % 5 AS DOUBLE) AS coho,
    CAST(l_partkey % 3 AS DOUBLE) AS chum,
    CAST(l_linenumber % 2 AS DOUBLE) AS pink,
    CAST(CASE WHEN l_partkey % 23 <> 0 THEN (l_orderkey + l_partkey) % 4 END AS DOUBLE) AS sockeye,
    CAST(l_quantity % 3 AS DOUBLE) AS lingcod,
    CAST((l_suppkey + l_linenumber) % 2 AS DOUBLE) AS halibut,
    l_orderkey % 5 = 0 AND l_linenumber > 0 AS changed
  FROM lineitem)"""

_VALUES = "chinook chinook_per_angler coho chum pink sockeye lingcod halibut".split()


def _hash(present: list[str]) -> str:
    texts = [
        f"coalesce(CAST({name} AS VARCHAR), 'None')" if name in present else "'None'"
        for name in _VALUES
    ]
    return f"substr(sha256(concat_ws('|', {', '.join(texts)})), 1, 16)"


MONTH_NO = (
    "nullif(list_position(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'],"
    " substr({d}, 1, 3)), 0)"
)


def month_no(d: str) -> str:
    return f"CAST({MONTH_NO.format(d=d)} AS INTEGER)"


def month_text(d: str) -> str:
    return f"lpad(CAST({month_no(d)} AS VARCHAR), 2, '0')"


def day_text(d: str) -> str:
    """Of texts that are blank or have their comma at position 5 or later."""
    inner = f"CASE WHEN {d} = '' THEN '' ELSE substr({d}, 5, instr({d}, ',') - 5) END"
    return f"right('0' || {inner}, 2)"


def date_text(d: str) -> str:
    return f"right({d}, 4) || '-' || {month_text(d)} || '-' || {day_text(d)}"


def week_key(d: str) -> str:
    t = f"({date_text(d)})"
    first = f"make_date(CAST(substr({t},1,4) AS INT), CAST(substr({t},6,2) AS INT), 1)"
    return (
        f"CASE WHEN regexp_matches({t}, '^[0-9]{{4}}-[0-9]{{2}}-(0[1-9]|[12][0-9]|3[01])$') THEN"
        f" strftime({first} + (CAST(substr({t},9,2) AS INT) - 1), '%Y-W%W') END"
    )


def period(d: str, unit: str) -> str:
    return {
        "daily": date_text(d),
        "weekly": week_key(d),
        "monthly": f"right({d}, 4) || '-' || {month_text(d)}",
        "yearly": f"right({d}, 4)",
    }[unit]


def week_label(p: str) -> str:
    year, week = f"substr({p}, 1, 4)", f"CAST(substr({p}, 7) AS INT)"
    monday = (
        f"(CAST(date_trunc('week', make_date(CAST({year} AS INT), 1, 4)) AS DATE)"
        f" + ({week} - 1) * 7)"
    )
    return (
        f"{year} || '-' || month({monday}) || '-w' || CAST(ceil(day({monday}) / 7.0) AS INT)"
    )


RAW = """raw AS (
  SELECT CAST(2002 - year(o_orderdate) AS INTEGER) AS batch_no, o_orderkey AS seq,
    strftime(date_trunc('month', o_orderdate), '%b %-d, %Y') AS sample_date,
    'Ramp ' || (o_custkey % 4) AS ramp_site,
    CASE o_custkey % 6 WHEN 0 THEN 'N/A' WHEN 1 THEN '' WHEN 2 THEN ' Area 2, Zone 2 '
      ELSE 'Area ' || (o_custkey % 6) || ', Zone ' || (o_custkey % 6) END AS area,
    CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE CAST(o_orderkey % 3 AS VARCHAR) END AS interviews,
    CASE WHEN o_orderkey % 29 = 0 THEN '3.0' ELSE ' ' || (o_custkey % 2) || ' ' END AS anglers,
    CASE WHEN o_orderkey % 11 = 0 THEN 'abc' ELSE CAST(o_orderkey % 3 AS VARCHAR) END AS chinook,
    ((o_orderkey // 5) % 2) || '.5' AS coho
  FROM orders)"""

_INT = "CASE WHEN regexp_matches(trim({c}), '^[+-]?[0-9]+$') THEN CAST(trim({c}) AS BIGINT) END"

TYPED = f"""typed AS (
  SELECT batch_no, seq, sample_date, ramp_site,
    CASE WHEN trim(area) IN ('', 'N/A') THEN '' ELSE trim(area) END AS catch_area,
    {_INT.format(c="interviews")} AS interviews,
    {_INT.format(c="anglers")} AS anglers,
    TRY_CAST(chinook AS DOUBLE) AS chinook, CAST(coho AS DOUBLE) AS coho
  FROM raw)"""

REC = f"rec AS (SELECT *, {_hash(['chinook', 'coho'])} AS data_hash FROM typed)"

KEY = "sample_date, ramp_site, catch_area, interviews, anglers"
WHOLE_KEY = "interviews IS NOT NULL AND anglers IS NOT NULL"


def classified(rows: str = "rec", name: str = "cls") -> str:
    return f"""{name} AS (
  SELECT batch_no, seq, {KEY}, data_hash,
    CASE WHEN {WHOLE_KEY} THEN
      lag(data_hash) OVER (PARTITION BY {KEY} ORDER BY batch_no, seq) END AS old_hash
  FROM {rows}),
{name}_status AS (
  SELECT *, CASE WHEN old_hash IS NULL THEN 'inserted' WHEN old_hash <> data_hash THEN 'updated'
    ELSE 'duplicate' END AS status FROM {name})"""


def latest(rows: str = "rec", name: str = "state") -> str:
    return f"""{name} AS (
  SELECT {KEY}, chinook, coho, data_hash, changed FROM (
    SELECT *,
      row_number() OVER (PARTITION BY {KEY} ORDER BY batch_no DESC, seq DESC) AS rn,
      min(data_hash) OVER (PARTITION BY {KEY}) <> max(data_hash) OVER (PARTITION BY {KEY}) AS changed
    FROM {rows} WHERE {WHOLE_KEY}) WHERE rn = 1
  UNION ALL
  SELECT {KEY}, chinook, coho, data_hash, false FROM {rows} WHERE NOT ({WHOLE_KEY}))"""


def add(name: str, body: str, *ctes: str) -> None:
    SQL[name] = f"WITH {', '.join(ctes)} {body}" if ctes else body


def of_survey(name: str, body: str, *ctes: str) -> None:
    add(name, body, SURVEY, *ctes)


def of_rec(name: str, body: str, *ctes: str) -> None:
    add(name, body, RAW, TYPED, REC, *ctes)


HASHED = f"hashed AS (SELECT *, {_hash(_VALUES)} AS data_hash FROM survey)"
SALMON = "chinook coho chum pink sockeye".split()
SUM5 = "chinook + coho + chum + pink + sockeye"
YEARS = "right(sample_date, 4) >= '1997' AND right(sample_date, 4) <= '1999'"
PICKED = "('Area 4, Zone 4', 'NATION_15', 'Area 9, Zone 9')"
SURVEY_YEAR = (
    "CASE WHEN regexp_matches(right(sample_date, 4), '^[0-9]{4}$')"
    " THEN right(sample_date, 4) ELSE '_other' END"
)

# --- sources and sinks -------------------------------------------------------

add(
    "scan_csv_batches",
    "SELECT batch_no, sample_date, area, interviews, anglers, chinook, coho, count(*) AS n"
    " FROM raw GROUP BY ALL",
    RAW,
)
of_survey(
    "scan_store",
    f"SELECT {SURVEY_YEAR} AS survey_year, catch_area, count(*) AS n, sum(coho) AS coho"
    f" FROM survey WHERE {YEARS} GROUP BY ALL",
)
of_survey(
    "init_store",
    f"SELECT {SURVEY_YEAR} AS survey_year, count(*) AS n, count(anglers) AS with_anglers"
    " FROM survey GROUP BY ALL",
)
# A change is one between the loads or within one of them.
of_rec("sink_store", "SELECT * FROM state", latest())
SQL["scan_metadata"] = (
    "SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_update"
    " FROM events WHERE event_type = 'click'"
)
SQL["sink_metadata"] = """
WITH log AS (
  SELECT CASE WHEN event_type = 'click' THEN 'last_update' ELSE event_type END AS key,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS value FROM events
  UNION ALL SELECT 'last_update', '2025-06-01T12:00:00+00:00'
  UNION ALL SELECT 'last_update', '2024-06-01T12:00:00+00:00')
SELECT key, count(*) AS entries, max(value) AS value FROM log GROUP BY key"""
of_survey(
    "export_json",
    "SELECT catch_area, count(*) AS n, count(anglers) AS with_anglers, sum(chinook) AS chinook,"
    " sum(sockeye) AS sockeye, CAST(0 AS BIGINT) AS with_hash, CAST(0 AS BIGINT) AS with_created"
    " FROM survey GROUP BY catch_area",
)
of_survey(
    "snapshot_save",
    "SELECT catch_area, 2 * count(*) AS n, 2 * sum(coho) AS coho, CAST(2 AS BIGINT) AS copies"
    " FROM survey GROUP BY catch_area",
)
of_survey(
    "snapshot_restore",
    f"SELECT {SURVEY_YEAR} AS survey_year, count(*) AS n, sum(pink) AS pink FROM survey GROUP BY ALL",
)
SQL["scan_features"] = """
SELECT CAST(s_nationkey AS VARCHAR) AS ma_number, s_name AS ma_name,
  CASE WHEN s_suppkey % 2 = 0 THEN 'WAC ' || s_suppkey END AS wac,
  CASE WHEN s_suppkey % 3 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind FROM supplier"""
SQL["scan_custom_areas"] = """
SELECT s_name AS name, 'Waters of ' || s_name AS description,
  CASE WHEN s_suppkey % 3 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind FROM supplier"""
SQL["sink_features"] = "SELECT count(*) AS features, count(*) > 0 AS has_bytes FROM supplier"
of_survey(
    "result_json",
    """SELECT '{"sample_date":"' || sample_date || '","catch_area":"' || catch_area
      || '","interviews":' || interviews || ',"anglers":' || coalesce(CAST(anglers AS VARCHAR), 'null')
      || '}' AS json FROM (SELECT DISTINCT sample_date, catch_area, interviews, anglers FROM survey)""",
)

# --- projections and scalar functions ----------------------------------------

MESSY = """messy AS (SELECT CASE o_orderkey % 12
    WHEN 0 THEN CAST(o_totalprice AS VARCHAR) WHEN 1 THEN ' ' || o_custkey || ' '
    WHEN 2 THEN o_custkey || '.0' WHEN 3 THEN '1,' || o_custkey WHEN 4 THEN '' WHEN 5 THEN NULL
    WHEN 6 THEN '+' || o_custkey WHEN 7 THEN 'abc' WHEN 8 THEN o_custkey || 'd'
    WHEN 9 THEN (o_custkey % 9) || 'e3' WHEN 10 THEN '.' || o_custkey ELSE 'N/A' END AS text
  FROM orders)"""
add(
    "safe_float",
    "SELECT text, CASE WHEN regexp_matches(trim(text), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[0-9]+)?$')"
    " THEN TRY_CAST(trim(text) AS DOUBLE) END AS value, count(*) AS n FROM messy GROUP BY ALL",
    MESSY,
)
add(
    "safe_int",
    f"SELECT text, {_INT.format(c='text')} AS value, count(*) AS n FROM messy GROUP BY ALL",
    MESSY,
)
SQL["normalize_area"] = """
WITH t AS (SELECT CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'N/A'
    WHEN 3 THEN ' NA ' WHEN 4 THEN 'null' WHEN 5 THEN 'n/a'
    WHEN 6 THEN ' Area ' || (o_custkey % 20) || ', East ' ELSE o_orderpriority END AS text FROM orders)
SELECT text, CASE WHEN text IS NULL OR trim(text) IN ('', 'N/A', 'n/a', 'NA', 'null') THEN ''
  ELSE trim(text) END AS area, count(*) AS n FROM t GROUP BY ALL"""
of_survey("data_hash", "SELECT data_hash, count(*) AS n FROM hashed GROUP BY ALL", HASHED)
of_rec(
    "project_record",
    f"""SELECT batch_no, seq, {KEY}, chinook, CAST(NULL AS DOUBLE) AS chinook_per_angler, coho,
      CAST(NULL AS DOUBLE) AS chum, CAST(NULL AS DOUBLE) AS pink, CAST(NULL AS DOUBLE) AS sockeye,
      CAST(NULL AS DOUBLE) AS lingcod, CAST(NULL AS DOUBLE) AS halibut, data_hash FROM rec""",
)
DATES = """dates AS (SELECT CASE interviews
    WHEN 1 THEN regexp_replace(sample_date, ' [0-9]+,', ' 30,') WHEN 2 THEN lower(sample_date)
    WHEN 3 THEN regexp_replace(sample_date, '^Apr', 'April') ELSE sample_date END AS d FROM survey)"""


def of_dates(name: str, columns: str) -> None:
    of_survey(name, f"SELECT d, {columns}, count(*) AS n FROM dates GROUP BY ALL", DATES)


of_dates("year_of", "right(d, 4) AS year")
of_dates("month_no", f"{month_no('d')} AS month")
of_dates("month_text", f"{month_text('d')} AS month")
of_dates("day_text", f"{day_text('d')} AS day")
of_dates("date_text", f"{date_text('d')} AS date")
of_dates(
    "period_key",
    ", ".join(f"{period('d', u)} AS {u}" for u in ("daily", "weekly", "monthly", "yearly"))
    + ", right(d, 4) AS other",
)
of_survey(
    "week_label",
    f"SELECT period, {week_label('period')} AS label, count(*) AS n"
    f" FROM (SELECT {week_key('d')} AS period FROM dates) GROUP BY ALL",
    DATES,
)
of_survey(
    "species_sum",
    "SELECT ramp_site, sum(chinook + sockeye + halibut) AS of_rows,"
    " sum(chinook) + sum(sockeye) + sum(halibut) AS of_species FROM survey GROUP BY ALL",
)
of_survey(
    "species_list",
    f"SELECT ramp_site, sum({SUM5}) AS sum_none, sum({SUM5}) AS sum_all, sum({SUM5}) AS sum_blank,"
    " sum(coho + lingcod) AS sum_two FROM survey GROUP BY ALL",
)
of_survey(
    "area_number",
    "SELECT catch_area AS area, regexp_extract(catch_area, '^Area\\s+(\\d+),', 1) AS number,"
    " count(*) AS n FROM survey GROUP BY ALL",
)
of_survey(
    "area_label",
    "SELECT area, CASE WHEN length(area) > 30 THEN left(area, 30) || '...' ELSE area END AS label,"
    " count(*) AS n FROM (SELECT ramp_site || ' off the shore of ' || catch_area AS area FROM survey)"
    " GROUP BY ALL",
)
of_survey(
    "species_label",
    " UNION ALL ".join(
        f"SELECT '{s.capitalize()}' AS label, sum({s}) AS catch FROM survey"
        for s in (*SALMON, "lingcod", "halibut")
    ),
)
SQL["display_name"] = (
    "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Zone ' || s_suppkey"
    " ELSE s_name || ' (Area ' || s_nationkey || ')' END AS display_name FROM supplier"
)
SQL["format_count"] = (
    "SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice + CAST(0.5 AS DOUBLE)) AS BIGINT))"
    " AS text FROM orders"
)
of_survey(
    "coalesce_zero",
    "SELECT coalesce(chinook, 0) AS chinook, coalesce(anglers, 0) AS anglers, count(*) AS n"
    " FROM survey GROUP BY ALL",
)
SQL["rounding"] = """
SELECT value, CAST(round_even(value, 0) AS BIGINT) AS half_even,
  CAST(floor(value + CAST(0.5 AS DOUBLE)) AS BIGINT) AS half_up, count(*) AS n
FROM (SELECT CAST(o_orderkey % 41 - 20 AS DOUBLE) / 4 AS value FROM orders) GROUP BY ALL"""

TOTALS = f"""totals AS (SELECT catch_area AS area, coalesce(sum({SUM5}), 0) AS total,
    count(*) AS surveys FROM survey WHERE catch_area <> '' GROUP BY catch_area)"""
SHARE = "least(total / greatest((SELECT max(total) FROM totals), 1), 1)"
OPACITY = f"CAST(0.3 AS DOUBLE) + {SHARE} * CAST(0.5 AS DOUBLE)"
of_survey(
    "intensity",
    f"SELECT area, total, surveys, {SHARE} AS intensity, {OPACITY} AS fill_opacity FROM totals",
    TOTALS,
)

# --- filters -----------------------------------------------------------------

of_survey(
    "where_clause",
    f"SELECT {KEY}, {', '.join(_VALUES)} FROM survey WHERE right(sample_date, 4) >= '1996'"
    f" AND right(sample_date, 4) <= '1999' AND catch_area IN {PICKED}",
)
of_survey(
    "filter_year_range",
    " UNION ALL ".join(
        f"SELECT '{name}' AS bounds, sample_date, count(*) AS n FROM survey WHERE {where} GROUP BY ALL"
        for name, where in {
            "upper": "right(sample_date, 4) <= '1997'",
            "lower": "right(sample_date, 4) >= '1997'",
            "both": YEARS,
            "crossed": "false",
        }.items()
    ),
)
of_survey(
    "filter_areas",
    f"SELECT catch_area, count(*) AS n FROM survey WHERE catch_area IN {PICKED} GROUP BY ALL",
)
of_survey(
    "filter_area_present",
    "SELECT catch_area, ramp_site, count(*) AS n FROM survey WHERE catch_area <> '' GROUP BY ALL",
)
of_survey(
    "filter_date_present",
    "SELECT sample_date, count(*) AS n FROM survey WHERE length(sample_date) > 0 GROUP BY ALL",
)
of_survey(
    "filter_month_known",
    f"SELECT {month_no('d')} AS month, count(*) AS n FROM dates"
    f" WHERE {month_no('d')} IS NOT NULL GROUP BY ALL",
    DATES,
)
of_survey(
    "filter_updated", "SELECT interviews, count(*) AS n FROM survey WHERE changed GROUP BY ALL"
)
of_survey(
    "filtered_records",
    f"SELECT {KEY}, {', '.join(_VALUES)}, data_hash FROM hashed"
    f" WHERE right(sample_date, 4) >= '1998' AND catch_area IN {PICKED}",
    HASHED,
)

# --- joins -------------------------------------------------------------------

of_rec(
    "key_match",
    f"""SELECT r.batch_no, r.seq, r.data_hash, s.data_hash AS stored_hash
      FROM rec r LEFT JOIN (SELECT * FROM stored WHERE {WHOLE_KEY}) s
        ON {" AND ".join(f"r.{k.strip()} = s.{k.strip()}" for k in KEY.split(","))}
      WHERE r.batch_no > 3""",
    "early AS (SELECT * FROM rec WHERE batch_no <= 3)",
    latest("early", "stored"),
)
CANONICAL = """canonical AS (
  SELECT regexp_extract(catch_area, '^Area\\s+(\\d+),', 1) AS number, max(catch_area) AS canonical_area
  FROM survey WHERE regexp_matches(catch_area, '^Area\\s+(\\d+),') GROUP BY 1)"""
of_survey("canonical_areas", "SELECT * FROM canonical", CANONICAL)
FEATURES = """feat AS (SELECT CAST(n_nationkey AS VARCHAR) AS ma_number, n_name AS ma_name,
    'WAC ' || n_regionkey AS wac FROM nation)"""
MATCHED = """named AS (
  SELECT f.*, (SELECT t.area FROM totals t WHERE t.area = f.ma_name) AS exact_area,
    (SELECT min(t.area) FROM totals t WHERE starts_with(t.area, 'Area ' || f.ma_number || ',')) AS prefix_area,
    (SELECT c.canonical_area FROM canonical c WHERE c.number = f.ma_number) AS canonical_area
  FROM feat f),
matched AS (
  SELECT n.ma_number, n.ma_name, n.wac,
    coalesce(exact_area, prefix_area, canonical_area, 'Area ' || ma_number || ', ' || ma_name) AS area,
    coalesce(t.total, 0) AS total, coalesce(t.surveys, 0) AS surveys
  FROM named n LEFT JOIN totals t ON t.area = coalesce(exact_area, prefix_area))"""
SOME_TOTALS = f"""totals AS (SELECT catch_area AS area, coalesce(sum({SUM5}), 0) AS total,
    count(*) AS surveys FROM survey
    WHERE catch_area IN ('Area 4, Zone 4', 'NATION_15', 'Area 9, Zone 9', 'Area 1, Zone 1')
    GROUP BY catch_area)"""
of_survey("area_match", "SELECT * FROM matched", SOME_TOTALS, CANONICAL, FEATURES, MATCHED)
of_survey(
    "custom_area_match",
    "SELECT n_name AS name, coalesce(total, 0) AS total, coalesce(surveys, 0) AS surveys"
    " FROM nation LEFT JOIN totals ON area = n_name",
    TOTALS,
)
of_survey(
    "selected_flag",
    f"SELECT catch_area AS area, catch_area IN {PICKED} AS selected, count(*) AS n"
    " FROM survey GROUP BY ALL",
)
of_survey(
    "dense_months",
    f"""SELECT CAST(m AS INTEGER) AS month, coalesce(total, 0) AS total
      FROM range(1, 13) r(m) LEFT JOIN (
        SELECT {month_no('sample_date')} AS month, sum({SUM5}) AS total FROM survey
        WHERE right(sample_date, 4) >= '2001' GROUP BY 1) t
      ON t.month = m""",
)

# --- aggregates, sorts, limits -----------------------------------------------


def stats(where: str = "true") -> str:
    def figure(column: str) -> str:
        return f"CAST(round_even(coalesce(sum({column}), 0), 0) AS BIGINT)"

    total = " + ".join(f"coalesce(sum({s}), 0)" for s in SALMON)
    return f"""SELECT CAST(round_even({total}, 0) AS BIGINT) AS total_catch, count(*) AS surveys,
      count(*) AS total_records, CAST(coalesce(sum(anglers), 0) AS BIGINT) AS total_anglers,
      {figure("chinook")} AS total_chinook, {figure("coho")} AS total_coho,
      coalesce(nullif(min(right(sample_date, 4)), ''), 'N/A') AS min_year,
      coalesce(nullif(max(right(sample_date, 4)), ''), 'N/A') AS max_year,
      count(DISTINCT nullif(catch_area, '')) AS areas FROM survey WHERE {where}"""


of_survey("stats", stats())
of_survey("stats_filtered", stats(YEARS))
of_survey("stats_no_rows", stats("false"))
of_survey(
    "count_areas",
    f"SELECT count(DISTINCT catch_area) AS areas FROM survey WHERE catch_area <> '' AND {YEARS}",
)
AREAS = "SELECT catch_area AS area, sum({s}) AS total FROM survey WHERE catch_area <> '' GROUP BY 1"
of_survey("areas", AREAS.format(s=SUM5))
of_survey("areas_two_species", AREAS.format(s="coho + lingcod"))
of_survey("top_areas", AREAS.format(s=SUM5) + " ORDER BY total DESC NULLS LAST, area LIMIT 10")
of_survey("map_data", "SELECT * FROM totals", TOTALS)
of_survey(
    "map_data_filtered",
    "SELECT catch_area AS area, coalesce(sum(chinook + sockeye), 0) AS total, count(*) AS surveys"
    " FROM survey WHERE right(sample_date, 4) <= '1997' AND catch_area <> '' GROUP BY 1",
)
of_survey(
    "yearly",
    "SELECT right(sample_date, 4) AS year, "
    + ", ".join(f"coalesce(sum({s}), 0) AS {s}" for s in SALMON)
    + " FROM survey WHERE length(sample_date) > 0 GROUP BY 1",
)


def trend(unit: str, species: list[str], where: str = "true") -> str:
    sums = ", ".join(f"sum({s}) AS {s}" for s in species)
    return (
        f"SELECT {period('sample_date', unit)} AS period, {sums} FROM survey"
        f" WHERE length(sample_date) > 0 AND {where} GROUP BY 1"
    )


for _unit in ("daily", "weekly", "monthly", "yearly"):
    of_survey(f"trend_{_unit}", trend(_unit, SALMON))
of_survey(
    "trend_weekly_filtered",
    trend("weekly", ["coho", "lingcod"], f"{YEARS} AND catch_area IN {PICKED}"),
)
of_survey(
    "species",
    "SELECT "
    + ", ".join(f"coalesce(sum({s}), 0) AS {s}" for s in (*SALMON, "lingcod", "halibut"))
    + " FROM survey",
)
MONTHLY = f"""monthly AS (SELECT CAST(m AS INTEGER) AS month, coalesce(total, 0) AS total
    FROM range(1, 13) r(m) LEFT JOIN (
      SELECT {month_no('sample_date')} AS month, sum({SUM5}) AS total FROM survey GROUP BY 1) t
    ON t.month = m)"""
of_survey("monthly", "SELECT * FROM monthly", MONTHLY)
of_survey("record_count", "SELECT count(*) AS records FROM survey")
of_survey(
    "effort_totals",
    "SELECT CAST(coalesce(sum(anglers), 0) AS BIGINT) AS total_anglers,"
    " CAST(coalesce(sum(interviews), 0) AS BIGINT) AS total_interviews FROM survey",
)
of_survey(
    "records_by_year",
    "SELECT right(sample_date, 4) AS year, count(*) AS records FROM survey"
    " WHERE length(sample_date) > 0 GROUP BY 1",
)
of_survey(
    "top_areas_by_records",
    "SELECT catch_area, count(*) AS records FROM survey WHERE catch_area <> '' GROUP BY 1"
    " ORDER BY records DESC, catch_area LIMIT 5",
)
of_survey("updated_count", "SELECT count(*) AS updated FROM survey WHERE changed")
of_survey("max_area_total", "SELECT greatest(max(total), 1) AS max_total FROM totals", TOTALS)
of_survey(
    "filter_options_years",
    "SELECT DISTINCT right(sample_date, 4) AS year FROM survey WHERE length(sample_date) > 0",
)
of_survey(
    "filter_options_areas", "SELECT DISTINCT catch_area FROM survey WHERE catch_area <> ''"
)
of_survey(
    "filter_options",
    "SELECT (SELECT string_agg(y, '|' ORDER BY y) FROM (SELECT DISTINCT right(sample_date, 4) AS y"
    " FROM survey WHERE length(sample_date) > 0)) AS years,"
    " (SELECT string_agg(a, '|' ORDER BY a) FROM (SELECT DISTINCT catch_area AS a"
    " FROM survey WHERE catch_area <> '')) AS areas",
)

# --- change detection --------------------------------------------------------

CLASSES = f"batch_no, seq, {KEY}, data_hash, old_hash, status"
of_rec("upsert_classify", f"SELECT {CLASSES} FROM cls_status", classified())
SQL["upsert_classify_hot"] = SQL["upsert_classify"]
of_rec(
    "upsert_classify_existing",
    f"SELECT {CLASSES} FROM cls_status WHERE batch_no > 3",
    classified(),
)
of_rec(
    "upsert_classify_null_safe",
    f"""SELECT batch_no, seq, {KEY}, data_hash, old_hash,
      CASE WHEN old_hash IS NULL THEN 'inserted' WHEN old_hash <> data_hash THEN 'updated'
        ELSE 'duplicate' END AS status
      FROM (SELECT *, lag(data_hash) OVER (PARTITION BY {KEY} ORDER BY batch_no, seq) AS old_hash
            FROM rec)""",
)
of_rec("upsert_latest", "SELECT * FROM state", latest())
CONFLICTS = f"""log AS (SELECT batch_no, seq, sample_date, ramp_site,
    CASE WHEN catch_area = '' THEN 'N/A' ELSE catch_area END AS catch_area, interviews, anglers,
    old_hash, data_hash AS new_hash FROM cls_status WHERE status = 'updated')"""
of_rec("conflicts", "SELECT * FROM log", classified(), CONFLICTS)
of_rec(
    "first_conflicts",
    "SELECT *, (SELECT greatest(count(*) - 10, 0) FROM log) AS more FROM log"
    " ORDER BY batch_no, seq LIMIT 10",
    classified(),
    CONFLICTS,
)


def outcomes(rows: str = "cls_status", name: str = "outcomes") -> str:
    return f"""{name} AS (SELECT batch_no, count(*) AS total,
    count(*) FILTER (status = 'inserted') AS new, count(*) FILTER (status = 'updated') AS updated,
    count(*) FILTER (status = 'duplicate') AS duplicates FROM {rows} GROUP BY batch_no)"""


of_rec("batch_outcomes", "SELECT * FROM outcomes", classified(), outcomes())
STOPPED = f"""more AS (
  SELECT * FROM rec
  UNION ALL SELECT * REPLACE (8 AS batch_no) FROM rec WHERE batch_no = 7 AND seq IN (
    SELECT max(seq) FROM rec WHERE batch_no = 7 AND {WHOLE_KEY} GROUP BY {KEY})
  UNION ALL SELECT * REPLACE (9 AS batch_no, 'Ramp 9' AS ramp_site) FROM rec WHERE batch_no = 1)"""
STOP_AT = (
    "(SELECT coalesce(min(batch_no), 99) FROM outcomes WHERE total > 10 AND total = duplicates)"
)
of_rec(
    "stop_on_all_duplicates",
    f"SELECT * FROM outcomes WHERE batch_no <= {STOP_AT}",
    STOPPED,
    classified("more"),
    outcomes(),
)
of_rec(
    "run_totals",
    f"""SELECT (SELECT count(*) FROM state) AS records, CAST(sum(new) AS BIGINT) AS new,
      CAST(sum(updated) AS BIGINT) AS updated, CAST(sum(duplicates) AS BIGINT) AS duplicates,
      CAST(CASE WHEN {STOP_AT} < 99 THEN {STOP_AT} - 1 ELSE 9 END AS INTEGER) AS years_fetched
      FROM outcomes WHERE batch_no <= {STOP_AT}""",
    STOPPED,
    classified("more"),
    outcomes(),
    f"kept AS (SELECT * FROM more WHERE batch_no <= {STOP_AT})",
    latest("kept"),
)
add(
    "stop_on_gap",
    "SELECT batch_no, count(*) AS rows FROM raw WHERE batch_no < 5 GROUP BY batch_no",
    RAW,
)
NUMBERED = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY batch_no ORDER BY seq) AS row FROM rec)"""
of_rec("seq_in_batch", "SELECT batch_no, seq, row FROM numbered", NUMBERED)
REPEATS = f"""firsts AS (
  SELECT batch_no, {KEY}, row, data_hash AS current_hash,
    first_value(row) OVER w AS first_row, first_value(data_hash) OVER w AS first_hash
  FROM numbered WINDOW w AS (PARTITION BY batch_no, {KEY} ORDER BY row)),
repeats AS (SELECT *, current_hash = first_hash AS same_data FROM firsts WHERE row > first_row)"""
of_rec("inspect_duplicates", "SELECT * FROM repeats", NUMBERED, REPEATS)
SQL["inspect_duplicates_hot"] = SQL["inspect_duplicates"]
of_rec(
    "duplicate_summary",
    "SELECT batch_no, count(*) FILTER (same_data) AS exact,"
    " count(*) FILTER (NOT same_data) AS conflicting FROM repeats GROUP BY batch_no",
    NUMBERED,
    REPEATS,
)
of_rec(
    "first_duplicates",
    """SELECT same_data, batch_no, row, first_row, sample_date, ramp_site,
      CASE WHEN catch_area = '' THEN 'N/A' ELSE catch_area END AS catch_area,
      greatest(n - 5, 0) AS more
      FROM (SELECT *, row_number() OVER (PARTITION BY same_data ORDER BY batch_no, row) AS place,
              count(*) OVER (PARTITION BY same_data) AS n FROM repeats) WHERE place <= 5""",
    NUMBERED,
    REPEATS,
)

# --- polygons ----------------------------------------------------------------

SQL["explode_features"] = """
SELECT s_name AS ma_name, 'maNumber' AS property, CAST(s_nationkey AS VARCHAR) AS value FROM supplier
UNION ALL SELECT s_name, 'maName', s_name FROM supplier
UNION ALL SELECT s_name, 'WAC', CASE WHEN s_suppkey % 2 = 0 THEN 'WAC ' || s_suppkey END FROM supplier"""
VERTICES = """corners(dx, dy) AS (VALUES (0, 0), (1, 0), (0, 1), (0, 0)),
shifts(shift) AS (VALUES (0), (3)),
vertices AS (
  SELECT s_name AS ma_name,
    CAST((-(s_suppkey % 180) + dx + shift) || '.5' AS DOUBLE) AS lon,
    CAST((s_suppkey % 90 + dy + shift) || '.25' AS DOUBLE) AS lat
  FROM supplier, corners, shifts WHERE shift = 0 OR s_suppkey % 3 = 0)"""
add("explode_vertices", "SELECT * FROM vertices", VERTICES)
add(
    "map_extent",
    "SELECT min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat"
    " FROM vertices",
    VERTICES,
)
SQL["feature_stats"] = """
SELECT (SELECT count(*) FROM supplier) AS features, CAST(pos AS INTEGER) AS pos, key
FROM (VALUES (0, 'maNumber'), (1, 'maName'), (2, 'WAC')) v(pos, key)"""
of_survey(
    "choropleth",
    f"""SELECT *, {SHARE} AS intensity, {OPACITY} AS fill_opacity, area IN {PICKED} AS selected FROM (
      SELECT false AS custom, ma_number, ma_name, wac, area, area AS display_name, total, surveys
      FROM matched
      UNION ALL
      SELECT true, NULL, NULL, NULL, n_name, n_name, coalesce(total, 0), coalesce(surveys, 0)
      FROM nation LEFT JOIN totals ON area = n_name)""",
    f"""totals AS (SELECT catch_area AS area, coalesce(sum({SUM5}), 0) AS total, count(*) AS surveys
      FROM survey WHERE catch_area IN {PICKED} AND {YEARS} GROUP BY catch_area)""",
    CANONICAL,
    FEATURES,
    MATCHED,
)

# --- reshapes ----------------------------------------------------------------

of_survey("area_lookup", "SELECT * FROM totals", TOTALS)
HALF_UP = "CAST(floor({v} + CAST(0.5 AS DOUBLE)) AS BIGINT)"
of_survey(
    "trend_series",
    " UNION ALL ".join(
        f"SELECT period, {week_label('period')} AS label, '{s.capitalize()}' AS series,"
        f" {HALF_UP.format(v=f'coalesce({s}, 0)')} AS value FROM weekly"
        for s in ("chinook", "sockeye", "halibut")
    ),
    f"weekly AS ({trend('weekly', ['chinook', 'sockeye', 'halibut'])})",
)
of_survey(
    "species_series",
    " UNION ALL ".join(
        f"SELECT {place} AS place, '{s.capitalize()}' AS label, "
        + (
            HALF_UP.format(v=f"coalesce(sum({s}), 0)") + " AS value FROM survey"
            if s in SALMON
            else "CAST(NULL AS BIGINT) AS value"
        )
        for place, s in enumerate((*SALMON, "lingcod", "halibut"), 1)
    ),
)
of_survey(
    "area_series",
    f"SELECT CASE WHEN length(area) > 30 THEN left(area, 30) || '...' ELSE area END AS label,"
    f" {HALF_UP.format(v='total')} AS value FROM ({AREAS.format(s=SUM5)})",
)
of_survey(
    "monthly_series",
    "SELECT month, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month]"
    f" AS label, {HALF_UP.format(v='total')} AS value FROM monthly",
    MONTHLY,
)

# --- refresh and composites --------------------------------------------------

SQL["refresh_due"] = """
WITH last AS (SELECT max(ts) AS t FROM events WHERE event_type = 'click')
SELECT '23 hours' AS case, false AS due, strftime(t + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS next_update,
  'Data is current (updated 23.0 hours ago)' AS message FROM last
UNION ALL SELECT '24 hours', true, NULL, NULL
UNION ALL SELECT 'never', true, NULL, NULL"""
of_rec("refresh", "SELECT * FROM state", latest())
SQL["stream_refresh"] = SQL["refresh"]


def long(section: str, key: str, measures: list[str], table: str) -> list[str]:
    return [
        f"SELECT '{section}' AS section, {key} AS key, '{m}' AS measure,"
        f" CAST({m} AS DOUBLE) AS value FROM {table}"
        for m in measures
    ]


PAGE = "right(sample_date, 4) >= '1996' AND right(sample_date, 4) <= '2000'"
FIGURES = "total_catch surveys total_records total_anglers total_chinook total_coho areas".split()
SQL["dashboard"] = (
    f"WITH {SURVEY.replace('survey AS', 'every_row AS', 1)},"
    f" survey AS (SELECT * FROM every_row WHERE {PAGE}), {TOTALS}, {MONTHLY},"
    f" headline AS ({stats()}), weekly AS ({trend('weekly', SALMON)}),"
    f" by_area AS ({AREAS.format(s=SUM5)}),"
    f" all_species AS (SELECT {', '.join(f'coalesce(sum({s}), 0) AS {s}' for s in SALMON)} FROM survey) "
    + " UNION ALL ".join(
        [
            *long("stats", "min_year || '-' || max_year", FIGURES, "headline"),
            *long("trend", "period", SALMON, "weekly"),
            *long("species", "'all'", SALMON, "all_species"),
            *long("areas", "area", ["total"], "by_area"),
            *long("monthly", "CAST(month AS VARCHAR)", ["total"], "monthly"),
            *long("map_data", "area", ["total", "surveys"], "totals"),
        ]
    )
)
SQL["dashboard_stored"] = SQL["dashboard"]
of_survey(
    "collection_report",
    """SELECT 'effort' AS section, 'total_anglers' AS key, CAST(coalesce(sum(anglers), 0) AS BIGINT) AS value FROM survey
    UNION ALL SELECT 'effort', 'total_interviews', CAST(sum(interviews) AS BIGINT) FROM survey
    UNION ALL SELECT 'by_year', right(sample_date, 4), count(*) FROM survey
      WHERE length(sample_date) > 0 GROUP BY 2
    UNION ALL SELECT 'top_areas', * FROM (SELECT catch_area, count(*) FROM survey WHERE catch_area <> ''
      GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
    UNION ALL SELECT 'updated', 'records', count(*) FROM survey WHERE changed""",
)
